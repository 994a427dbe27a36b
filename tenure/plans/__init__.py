"""The named business queries, each a function from tables to a DataFrame."""
