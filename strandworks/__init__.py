"""Spark jobs for nucleotide-sequence corpora and for training text."""
