"""Spark operators for recurring service calendars and municipal statistics."""
