"""Subscription-lifecycle analytics as Spark DataFrame and streaming jobs."""
