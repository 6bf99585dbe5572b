"""Corpus jobs on Spark."""
