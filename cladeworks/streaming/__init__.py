"""Incremental maintenance of split counts."""
