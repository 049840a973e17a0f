"""Entity analytics on Spark: knowledge-graph records, candidate generation, linking, clustering and metrics."""
