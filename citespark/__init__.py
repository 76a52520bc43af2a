"""Bibliometric, network and topic analytics over Spark DataFrames."""
