"""Readers and writers: Newick text, derived trees, run statistics."""
