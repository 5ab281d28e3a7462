"""Threaded-discussion analytics on Spark: sources, operators, plans and streaming."""
