"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits: word shingles are hashed with XXH64 (seed 42), and a bit is 1 if it
is set in over half of the hashes.  Two fingerprints link at ``MAX_BITS`` or fewer differing
bits, and a component is what links reach.

Candidates come from the pigeonring principle.  The fingerprint is a ring of 8 one-byte
segments.  If two fingerprints differ in at most 3 bits, then some start exists from which every
chain of l consecutive segments differs in at most l*3/8 bits: none in the first two segments,
one in the first three to five, two in the first six or seven.  Of segments three to five at
least two are then equal, so each fingerprint is filed under 8 starts x 3 pairs = 24 keys of 32
equal bits.  Rows that share a key are compared only if the whole chain from that start keeps
its budgets; the full Hamming check comes last.  The filter loses no link.

A key of more than ``BLOCK`` fingerprints is extended first: the chain's budgets leave at most two
differing bits in the remaining one of segments three to five, the sixth and the seventh, so one of
these three is equal as well, and each row is filed again under three keys of 40 equal bits.  What is
still larger is cut into blocks and block pairs.

Within a key the links are walked breadth first over the fingerprints not yet reached, and only
the links walked are kept (at most n-1 of n rows), so a dense group of near copies never becomes
all its pairs.  Components follow from ``components.connected_components``.

Edge cases: null and empty texts have fingerprint zero and link like any other; equal
fingerprints are one node; repeated doc_ids are separate rows with equal results; a null doc_id
keeps its fingerprint, and its component is the smallest non-null doc_id reachable (null if there
is none); an empty table gives an empty result; other columns are ignored by ``near_duplicates``
and kept as they are by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .common import LONG_ROWS, id_and_text, map_arrow, numbered, own_columns, text_bytes, words_of
from .components import connected_components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = 8
#: Of the third to fifth segment of a chain, the pairs that may be the equal ones.
PAIRS = ((2, 3), (2, 4), (3, 4))
#: Rows of one key that one task compares; larger keys are extended, and cut if that is not enough.
BLOCK = 4096

_BITS = np.array([[(byte >> bit) & 1 for bit in range(8)] for byte in range(256)], dtype=np.int64)
_POPCOUNT = np.array([bin(x).count("1") for x in range(1 << 16)], dtype=np.uint8)


def fingerprint(data: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of one text in UTF-8."""
    words = words_of(data.lower()) if data else []
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(SHINGLE_WORDS, len(words)) - 1 :].tolist()
    hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8").view(np.uint8).reshape(n, 8)
    value = 0
    for k in range(8):
        counts = np.bincount(hashes[:, k], minlength=256) @ _BITS
        for bit in np.flatnonzero(counts * 2 > n).tolist():
            value |= 1 << (8 * k + bit)
    return value


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(x) for x in text_bytes(batch.column("text"))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def popcount(values: np.ndarray) -> np.ndarray:
    """Bits set in each unsigned 64-bit value."""
    return _POPCOUNT[values.view(np.uint16).reshape(-1, 4)].sum(axis=1)


def chain_keeps(xor: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain from ``start`` keeps the budget l*MAX_BITS/SEGMENTS at every length l."""
    by_segment = _POPCOUNT[xor.view(np.uint8)].reshape(-1, SEGMENTS)
    ring = (start[:, None] + np.arange(SEGMENTS)) % SEGMENTS
    reached = np.take_along_axis(by_segment, ring, axis=1).cumsum(axis=1)
    return (reached * SEGMENTS <= np.arange(1, SEGMENTS + 1) * MAX_BITS).all(axis=1)


def _walk(prints: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that span the components among the fingerprints of one key."""
    links, left = [], prints.copy()
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            xor = left ^ at
            near = chain_keeps(xor, np.full(len(left), start))
            near &= popcount(xor) <= MAX_BITS
            if near.any():
                links += [(int(at), int(x)) for x in left[near]]
                queue += list(left[near])
                left = left[~near]
    return links


def _links(batches):
    """Rows sorted by (key, part): the links within each group. A group may span batches."""

    def found(keys, starts, prints):
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
        length = end - begin
        two = begin[length == 2]
        a, b = prints[two], prints[two + 1]
        good = chain_keeps(a ^ b, starts[two]) & (popcount(a ^ b) <= MAX_BITS)
        pairs = [np.stack([a[good], b[good]], axis=1)]
        for i in np.flatnonzero(length > 2).tolist():
            if links := _walk(np.unique(prints[begin[i] : end[i]]), int(starts[begin[i]])):
                pairs.append(np.array(links, dtype=np.uint64))
        pairs = np.concatenate(pairs)
        pairs = np.unique(np.sort(pairs.view(np.int64), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "part", "start", "fp")]
        columns[3] = columns[3].view(np.uint64)
        if kept is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(kept, columns)]
        keys = np.stack(columns[:2], axis=1)
        last = int(np.flatnonzero((keys != keys[-1]).any(axis=1)).max(initial=-1)) + 1
        kept = [x[last:] for x in columns]
        if last:
            yield found(keys[:last], columns[2][:last], columns[3][:last])
    if kept is not None:
        yield found(np.stack(kept[:2], axis=1), kept[2], kept[3])


def _ring_keys(fp):
    """24 keys of 40 bits: start and pair above four bytes that must be equal."""
    segment = lambda i: F.shiftrightunsigned(fp, 8 * (i % SEGMENTS)).bitwiseAND(F.lit(255))
    keys = []
    for start in range(SEGMENTS):
        for pair, (a, b) in enumerate(PAIRS):
            key = F.lit(start * len(PAIRS) + pair).cast("long")
            for i in (start, start + 1, start + a, start + b):
                key = F.shiftleft(key, 8).bitwiseOR(segment(i))
            keys.append(F.struct(key.alias("key"), F.lit(start).alias("start")))
    return F.array(*keys)


def _extensions(key, start, fp):
    """1 to 768: which of the three further segments of the chain, and its value."""
    pair = F.pmod(F.shiftright(key, 32), F.lit(len(PAIRS))).cast("int")
    third = F.element_at(F.array(*(F.lit(9 - a - b) for a, b in PAIRS)), pair + 1)
    value = lambda place: F.call_function("shiftrightunsigned", fp, (8 * F.pmod(start + place, F.lit(SEGMENTS))).cast("int")).bitwiseAND(F.lit(255))
    return F.array(*(1 + 256 * i + value(place) for i, place in enumerate((third, F.lit(5), F.lit(6)))))


def _with_shared(filed: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key others have as well, with their number ``n``.

    The planner sizes exploded rows as if there were one for each fingerprint, and would broadcast them; so the join is named.
    """
    return filed.join(filed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").hint("merge"), key)


def link_fingerprints(prints: DataFrame, work: Workspace) -> DataFrame:
    """Links (u, v), u < v, that span the components of the distinct values of ``fp``; a saved table."""
    filed = prints.select("fp", F.explode(_ring_keys(F.col("fp"))).alias("k")).select("fp", "k.*")
    filed = work.save(_with_shared(filed, ["key"]))
    usual = filed.where(F.col("n") <= BLOCK).select("key", F.lit(0).cast("long").alias("part"), "start", "fp")
    # the part of an extended key, above those of its blocks: which segment it has besides, and that one's value
    extended = filed.where(F.col("n") > BLOCK).select("key", F.explode(_extensions(F.col("key"), F.col("start"), F.col("fp"))).alias("more"), "start", "fp")
    extended = _with_shared(extended, ["key", "more"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.shiftleft("more", 48) + (F.least(own, other).cast("long") * blocks + F.greatest(own, other)),
    )
    parted = usual.unionByName(extended.select("key", F.explode(pair).alias("part"), "start", "fp"))
    dealt = parted.repartition("key", "part").sortWithinPartitions("key", "part")
    links = work.save(map_arrow(dealt, _links, "u long, v long").distinct())
    work.drop(filed)
    return links


def _components(prints: DataFrame, chosen, work: Workspace) -> DataFrame:
    """(fp, chosen): for each fingerprint the least value of ``chosen`` in its component."""
    nodes = work.save(prints.groupBy("fp").agg(F.min(chosen).alias("own")))
    member = connected_components(link_fingerprints(nodes.select("fp"), work), work)  # only of linked nodes
    labelled = nodes.join(member, nodes.fp == member.node, "left").select("fp", "own", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("own").alias("chosen"))
    return labelled.join(least, "component").select("fp", "chosen")


def near_duplicates(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    work = work or Workspace(docs.sparkSession, "simhash", LONG_ROWS)
    prints = work.save(map_arrow(id_and_text(docs), _fingerprints, "doc_id long, fp long"))
    first = _components(prints, F.col("doc_id"), work)
    return prints.join(first, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("chosen").alias("component_id"))


def keep_one(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """The documents with all their columns, one of each component: that of the smallest doc_id.

    Rows without a doc_id come last; of repeated rows one stays.  Texts are read twice and not moved:
    only fingerprints are saved, and the rows that go are left out of the second reading.
    """
    work = work or Workspace(docs.sparkSession, "simhash", LONG_ROWS)
    known, (file, row) = numbered(docs, work)

    def add_print(batches):
        for batch in batches:
            prints = np.array([fingerprint(x) for x in text_bytes(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("file", "row", "doc_id")), pa.array(prints.view(np.int64))], names=["file", "row", "doc_id", "fp"])

    narrow = known.select(F.col(file).alias("file"), F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    printed = work.save(map_arrow(narrow, add_print, "file long, row long, doc_id long, fp long"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row")
    chosen = _components(printed, order, work)
    lost = printed.join(chosen, "fp").where((F.col("chosen.file") != F.col("file")) | (F.col("chosen.row") != F.col("row")))
    lost = work.save(lost.select(F.col("file").alias(file), F.col("row").alias(row)))
    return known.join(lost, [file, row], "left_anti").select(*own_columns(docs))
