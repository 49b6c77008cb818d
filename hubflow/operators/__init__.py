"""Operators on packets, pipelines, runs, workers and links."""
