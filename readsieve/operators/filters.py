"""Filters on reference statistics."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import with_breadth_expected

# Filter names, the column each compares, and how.
FILTERS = {
    "avgAlnLength": ("avg_alignment_length", ">="),
    "nAlns": ("num_alignments", ">="),
    "avgReadLength": ("avg_read_length", ">="),
    "avgIdentity": ("avg_identity", ">="),
    "breadth": ("breadth", ">="),
    "covMean": ("mean_coverage", ">="),
    "avgDepth": ("avg_depth", ">="),
    "covStd": ("std_coverage", ">="),
    "breadthExpectedRatio": ("breadth_expected_ratio", ">="),
    "depthEvenness": ("depth_evenness", "<="),
}
_COMPARE = {">=": operator.ge, "<=": operator.le}


def parse_filters(text: str | None) -> dict[str, float]:
    """``name=value,name=value``; nothing gives no filter."""
    found = {}
    for part in (text or "").split(","):
        if part.strip():
            name, given, value = (x.strip() for x in part.partition("="))
            if not given:
                raise ValueError(f"filter {part.strip()!r} has no value")
            found[name] = value
    return validate_filters(found)


def validate_filters(filters: dict[str, float | str]) -> dict[str, float]:
    """Known names, numbers, none negative."""
    out = {}
    for name, value in filters.items():
        if name not in FILTERS:
            raise ValueError(f"unknown filter {name!r}; known are {', '.join(FILTERS)}")
        try:
            number = float(value)
        except (TypeError, ValueError):
            raise ValueError(f"filter {name}: {value!r} is not a number") from None
        if math.isnan(number) or number < 0:
            raise ValueError(f"filter {name}: {value!r} must be 0 or more")
        out[name] = number
    return out


def apply_filters(stats: DataFrame, filters: dict[str, float | str] | None) -> DataFrame:
    """References that pass all filters; an undefined value passes none."""
    filters = validate_filters(filters or {})
    if not filters:
        return stats
    columns = stats.columns
    if "breadthExpectedRatio" in filters:
        stats = with_breadth_expected(stats)
    tests = [_COMPARE[FILTERS[name][1]](F.col(FILTERS[name][0]), F.lit(value)) for name, value in filters.items()]
    return stats.where(reduce(operator.and_, tests)).select(*columns)


def on_references(alignments: DataFrame, stats: DataFrame) -> DataFrame:
    """Alignments whose reference is in ``stats``."""
    return alignments.join(stats.select("subjectId"), "subjectId", "left_semi").select(*alignments.columns)
