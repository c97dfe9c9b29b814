"""Keeping the rows whose keys are among others', with little moved.

A semi join whose key side is too large to be broadcast moves all rows of the other side, be they ever so
wide.  A Bloom filter of the keys, of a bounded size, tells nearly all rows that can't be among them where they are
scanned, so what is moved follows the rows that stay.

The filter is a table of segments of ``SEGMENT_WORDS`` longs.  A key belongs to one segment, by its hash, and sets
three bits there; tasks set them in parts, and these are combined by ``bit_or`` before and after the
shuffle.  Nothing of it passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace

SEGMENT_WORDS = 8192
BITS_PER_KEY, BITS_SET = 12, 3
_WORD_BITS = 6  # 2^6 bits in a long
_PLACE_BITS = 13 + _WORD_BITS  # 2^13 words in a segment
#: Of more keys the filter would have more than 64 MB, and of fewer a semi join is broadcast by itself.
MOST_BYTES = 64 * 2**20
MOST_KEYS = MOST_BYTES * 8 // BITS_PER_KEY
LEAST_KEYS = 200_000
#: If more rows than this share may stay, moving the rest matters little.
MOST_SHARE = 0.5
#: Tells whether a row's key may be among the keys.
MET = "_met"


def _hashes(columns: list[str]) -> tuple[Column, Column]:
    return F.xxhash64(*columns), F.xxhash64(F.lit("places"), *columns)


def _places(h: Column) -> list[Column]:
    """Three numbers below 2^19 from one hash."""
    return [F.shiftrightunsigned(h, _PLACE_BITS * i).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int") for i in range(BITS_SET)]


def _mask(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit((1 << _WORD_BITS) - 1)))


def bloom_filter(keys: DataFrame, segments: int) -> DataFrame:
    """(segment, words): one row for each segment, all of the same size."""
    a, b = _hashes(keys.columns)
    marked = keys.select(F.pmod(a, F.lit(segments)).alias("segment"), F.explode(F.array(*_places(b))).alias("place"))
    marked = marked.select("segment", F.shiftright("place", _WORD_BITS).alias("word"), _mask(F.col("place")).alias("bits"))
    every = keys.sparkSession.range(segments * SEGMENT_WORDS)
    empty = every.select(F.floor(F.col("id") / SEGMENT_WORDS).alias("segment"), F.pmod("id", F.lit(SEGMENT_WORDS)).cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = marked.unionByName(empty).groupBy("segment", "word").agg(F.bit_or("bits").alias("bits"))
    listed = words.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return listed.select("segment", F.transform("words", lambda w: w.bits).alias("words"))


def may_be_among(rows: DataFrame, keys: DataFrame, work: Workspace) -> DataFrame:
    """The rows less most of those whose key columns are not among ``keys``; no row whose key is among them is lost.

    Rows with a null in a key column may go, as no join finds them.  All rows come back if a filter
    would not pay: few keys, too many for its size, or a large share of the rows. ``rows`` and ``keys`` are best saved tables.
    """
    n = keys.count()
    if not LEAST_KEYS < n <= MOST_KEYS or n > MOST_SHARE * rows.count():
        return rows
    return met(rows, keys, n, work).where(MET).drop(MET)


def met(rows: DataFrame, keys: DataFrame, n: int, work: Workspace) -> DataFrame:
    """Adds ``MET``: false where a row's key columns are not among the n ``keys``, true where they are and for a few of the others. No row is moved."""
    segments = -(-n * BITS_PER_KEY // (SEGMENT_WORDS << _WORD_BITS)) or 1
    built = work.save(bloom_filter(keys, segments))  # at most MOST_BYTES
    a, b = _hashes(keys.columns)
    words = F.col("words")
    found = [F.get(words, F.shiftright(p, _WORD_BITS)).bitwiseAND(_mask(p)) != 0 for p in _places(b)]
    joined = rows.join(F.broadcast(built), F.pmod(a, F.lit(segments)) == built["segment"])
    return joined.select(*(rows[c] for c in rows.columns), (found[0] & found[1] & found[2]).alias(MET))
