"""Statute structuring and hybrid retrieval expressed as Spark DataFrame transformations."""
