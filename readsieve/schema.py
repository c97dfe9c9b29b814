"""Schemas of the alignment table, the mapping and the outputs."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _L = T.StringType(), T.IntegerType(), T.DoubleType(), T.LongType()

# The columns of a tabular alignment file, in order; the last three are optional.
_ALIGNMENT = {
    "queryId": _S,
    "subjectId": _S,
    "percIdentity": _D,
    "alnLength": _I,
    "mismatchCount": _I,
    "gapOpenCount": _I,
    "queryStart": _I,
    "queryEnd": _I,
    "subjectStart": _I,
    "subjectEnd": _I,
    "eVal": _D,
    "bitScore": _D,
    "qlen": _I,
    "slen": _I,
}
_WIDE = {"cigar": _S, "qaln": _S, "taln": _S}

ALIGNMENT = T.StructType([T.StructField(n, t) for n, t in _ALIGNMENT.items()])
ALIGNMENT_WIDE = T.StructType([T.StructField(n, t) for n, t in (_ALIGNMENT | _WIDE).items()])
BY_ARITY = {len(ALIGNMENT): ALIGNMENT, len(ALIGNMENT_WIDE): ALIGNMENT_WIDE}
MAPPING = T.StructType([T.StructField("reference", _S), T.StructField("group", _S)])

#: The place of a row in its input; decides which of equal alignments is the first.
ORDINAL = "ordinal"
#: What statistics and the resolver read; the other columns of wide inputs never leave their partition before the end.
ANALYTIC = ["queryId", "subjectId", "percIdentity", "alnLength", "subjectStart", "subjectEnd", "bitScore", "qlen", "slen"]

# Output columns and what they are called in the statistics table.
COV_STATS = {
    "reference": "subjectId",
    "depth_mean": "avg_depth",
    "depth_std": "std_coverage",
    "depth_evenness": "depth_evenness",
    "breadth": "breadth",
    "n_alns": "num_alignments",
    "avg_read_length": "avg_read_length",
    "stdev_read_length": "std_read_length",
    "avg_alignment_length": "avg_alignment_length",
    "avg_identity": "avg_identity",
    "stdev_identity": "std_identity",
}
