"""Reusable keyed-table operators."""
