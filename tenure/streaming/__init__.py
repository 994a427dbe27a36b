"""Streaming jobs; each brings its tables to the state of the batch query."""
