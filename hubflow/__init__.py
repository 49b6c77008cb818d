"""Routing and analytics of streaming-pipeline packets as Spark DataFrames."""
