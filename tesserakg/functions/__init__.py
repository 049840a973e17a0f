"""Functions on columns: text similarity and clean-up, vectors, formats."""
