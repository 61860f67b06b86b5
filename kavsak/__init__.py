"""Kavsak: cleaning, parsing, matching, retrieval and profiling of address text as Spark DataFrame operations."""
