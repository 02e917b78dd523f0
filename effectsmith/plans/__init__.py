"""Queries registered in __spark_entry__.py and their SQL."""
