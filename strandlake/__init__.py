"""Compressive similarity search over nucleotide sequence collections, on Spark."""
