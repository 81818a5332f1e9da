"""Approximate motifs in sequence data, as Spark DataFrame plans."""
