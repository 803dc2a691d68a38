"""Turns messy listing data into clean, queryable tables, as Spark jobs."""
