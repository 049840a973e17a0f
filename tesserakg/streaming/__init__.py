"""Annotated texts as streams: counts over windows of event time."""
