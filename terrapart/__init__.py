"""Spark-first clustering and evaluation of gridded environmental data."""
