"""Codon-aware analytics on Spark DataFrames: sequences, alignments, annotations, protein features and evaluation."""
