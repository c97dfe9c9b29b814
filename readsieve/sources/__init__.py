"""Readers and writers."""

from .readers import read_alignments, read_mapping
from .writers import output_names, write_parquet, write_tsv

__all__ = ["output_names", "read_alignments", "read_mapping", "write_parquet", "write_tsv"]
