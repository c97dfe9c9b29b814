"""Runs of repeated words, found with recompression grammars.

A run is a stretch of words with a period q (words q apart are the same), q its smallest, of at least
``LEAST_WORDS`` words and two periods, that can't be extended to either side.

1. Grammar.  The words of many documents, each document ended by a symbol of its own, are one
   sequence of numbers.  Its length shrinks level by level: runs of one symbol become a symbol for the symbol
   and its count (block compression); then symbols are split at random into left and right
   ones, and each left one followed by a right one becomes a symbol for the pair (pair compression).  Equal
   stretches get equal symbols on all levels, but for some at their ends, so the levels are a run-length grammar.
2. Extensions.  How far two places agree, forward or backward, is asked of the grammar for millions of
   pairs of places at once: each pair climbs while the symbols agree, at most one step aside on a
   level, and then comes down to the word that differs.  So the answers are exact and take
   steps by the number of levels, not by the length of what agrees.
3. Grid.  A run with period q agrees with itself q words on for a stretch of max(q, LEAST_WORDS - q) words, so
   that stretch has a place whose number is a multiple of that.  For each q these places are tried: for all q,
   n/1 + n/2 + ... pairs.  Pairs of different words are dropped at once; the others are extended both ways.
4. Of equal stretches the smallest period counts; others are its multiples.

A document is the work of the task that reads it, together with others of about its length: nothing is shuffled. Time
is in proportion to n log n for n words, whatever repeats; memory to the words of
``WORDS_TOGETHER``, or of the longest document.

Edge cases: null and empty texts have no words and no runs; repeated rows give equal rows; overlapping runs all
count; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, let, map_arrow, text_bytes, words_of

LEAST_WORDS = 12
#: Words of documents that share a grammar, about, and pairs of places that are extended together.
WORDS_TOGETHER, PAIRS_TOGETHER = 200_000, 500_000
#: The grammar ends where a level has fewer symbols than this for each document, or hardly shrinks.
LAST_SYMBOLS, LEAST_SHRINK = 4, 0.97
RUN = "struct<start:long,length:long,period:long>"
FOUND = f"doc_id long, n long, runs array<{RUN}>, collapsed string"


class Level(NamedTuple):
    """One level of a grammar, and how the one above is made of it."""

    symbols: np.ndarray
    same_on: np.ndarray | None  # block levels: how many equal symbols follow from here on, itself counted
    same_back: np.ndarray | None
    parent: np.ndarray | None  # of each symbol; None on the last level
    first: np.ndarray | None  # of each symbol above, the first here; one more at the end


def _joined(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents and first children, for symbols that begin where ``begins`` says."""
    return np.cumsum(begins, dtype=np.int32) - np.int32(1), np.append(np.flatnonzero(begins), len(begins)).astype(np.int32)


def _named(old: np.ndarray, keys: np.ndarray, at: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """``old`` with new symbols at some places, equal ones for equal keys."""
    distinct, number = np.unique(keys, return_inverse=True)
    out = old.copy()
    out[at] = number + fresh
    return out, fresh + len(distinct)


def grammar(words: np.ndarray, documents: int) -> list[Level]:
    """Levels from words to few symbols. ``words``: numbers from 0 on."""
    rng = np.random.default_rng(len(words))
    symbols, fresh = words.astype(np.int64), int(words.max(initial=0)) + 1
    levels: list[Level] = []
    while len(symbols) > LAST_SYMBOLS * documents:
        equal = symbols[1:] == symbols[:-1]
        if equal.any():  # block compression
            begins = np.append(True, ~equal)
            parent, first = _joined(begins)
            counts = np.diff(first)
            place = np.arange(len(symbols), dtype=np.int32)
            levels.append(Level(symbols, first[parent + 1] - place, place - first[parent] + 1, parent, first))
            blocks = np.flatnonzero(counts > 1)
            base = symbols[first[:-1]]
            symbols, fresh = _named(base, base[blocks] * (len(symbols) + 1) + counts[blocks], blocks, fresh)
            continue
        distinct, number = np.unique(symbols, return_inverse=True)
        left = (rng.random(len(distinct)) < 0.5)[number]
        forth, back = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        pairs = np.flatnonzero(forth if forth.sum() >= back.sum() else back)
        begins = np.ones(len(symbols), dtype=bool)
        begins[pairs + 1] = False
        if begins.sum() > LEAST_SHRINK * len(symbols) and len(symbols) < 1000:
            break
        parent, first = _joined(begins)
        levels.append(Level(symbols, None, None, parent, first))
        base = symbols[first[:-1]]
        symbols, fresh = _named(base, symbols[pairs] * fresh + symbols[pairs + 1], parent[pairs], fresh)
    levels.append(Level(symbols, None, None, None, None))
    return levels


def _advance(level: Level, x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray | int:
    """How many symbols agree from here on, of those that make one symbol above."""
    if level.same_on is None:
        return 1
    on = level.same_back if back else level.same_on
    return np.minimum(on[x], on[y])


def agreement(levels: list[Level], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words agree from places i and j on; ``back``: up to and including them, going backward.

    Every document ends with a symbol that occurs nowhere else, so i and j that differ come to a
    difference; before the first word there must be such a symbol too.
    """
    sign = -1 if back else 1
    x, y = i.copy(), j.copy()
    height = np.zeros(len(i), dtype=np.int32)
    live = np.arange(len(i))
    for k, level in enumerate(levels[:-1]):  # climb
        a, b = x[live], y[live]
        same = level.symbols[a] == level.symbols[b]
        live, a, b = live[same], a[same], b[same]
        edge = level.first[1:] - 1 if back else level.first[:-1]
        aside = (edge[level.parent[a]] != a) | (edge[level.parent[b]] != b)
        if aside.any():
            which = np.flatnonzero(aside)
            step = sign * _advance(level, a[which], b[which], back)
            a[which] += step
            b[which] += step
            x[live], y[live] = a, b
            whole = (edge[level.parent[a]] == a) & (edge[level.parent[b]] == b) & (level.symbols[a] == level.symbols[b])
            live, a, b = live[whole], a[whole], b[whole]
        x[live], y[live] = level.parent[a], level.parent[b]
        height[live] = k + 1
        if not len(live):
            break
    symbols = levels[-1].symbols
    while len(live):  # along the last level
        live = live[symbols[x[live]] == symbols[y[live]]]
        x[live] += sign
        y[live] += sign
    for k in range(int(height.max(initial=0)), -1, -1):  # come down to the difference
        level = levels[k]
        at = np.flatnonzero(height >= k)
        a, b = x[at], y[at]
        for _ in range(1 if k == len(levels) - 1 else 2):
            same = np.flatnonzero(level.symbols[a] == level.symbols[b])
            if not len(same):
                break
            step = sign * _advance(level, a[same], b[same], back)
            a[same] += step
            b[same] += step
        if k:
            below = levels[k - 1].first
            a, b = (below[1:][a] - 1, below[1:][b] - 1) if back else (below[a], below[b])
        x[at], y[at] = a, b
    return i - x if back else x - i


def find(numbers: np.ndarray, owner: np.ndarray, longest: int) -> np.ndarray:
    """Runs of a sequence of documents: rows of (first word, word after the last, period), by first word and period.

    ``numbers`` begins with a symbol of its own and has one after each document; ``owner``: each word's document.
    """
    levels = grammar(numbers, int(owner[-1]) + 1)
    n, found, waiting, held = len(numbers), [], [], 0

    def extend():
        i = np.concatenate([p for p, _ in waiting]).astype(np.int32)
        q = np.concatenate([np.full(len(p), q, dtype=np.int32) for p, q in waiting])
        least = np.maximum(q, LEAST_WORDS - q)
        on = agreement(levels, i, i + q)
        back = agreement(levels, i, i + q, back=True)
        good = on + back - 1 >= least
        begin = i[good] - back[good] + 1
        found.append(np.unique(np.column_stack([begin, i[good] + on[good] + q[good], q[good]]), axis=0))
        waiting.clear()

    for q in range(1, longest // 2 + 1):
        grid = max(q, LEAST_WORDS - q)
        places = np.flatnonzero(numbers[:-q:grid] == numbers[q::grid]) * grid
        if len(places):
            waiting.append((places, q))
            held += len(places)
        if held > PAIRS_TOGETHER:
            extend()
            held = 0
    if waiting:
        extend()
    runs = np.unique(np.concatenate([np.zeros((0, 3), dtype=np.int32), *found]), axis=0)  # by begin, end, period: the smallest period comes first
    if not len(runs):
        return runs
    smallest = np.append(True, (np.diff(runs[:, :2], axis=0) != 0).any(axis=1))
    runs = runs[smallest]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _sequence(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words with a symbol before, between and after documents; each one's document; where documents begin."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    lengths = np.array([len(t) for t in texts])
    begins = 1 + np.cumsum(np.append(0, lengths[:-1] + 1))
    out = np.empty(1 + int((lengths + 1).sum()), dtype=np.int64)
    inside = np.ones(len(out), dtype=bool)
    inside[0] = False
    inside[begins + lengths] = False
    out[inside] = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
    out[~inside] = len(known) + np.arange(len(out) - int(lengths.sum()))
    owner = np.repeat(np.arange(-1, len(texts)), np.append(1, lengths + 1))
    return out, owner, begins


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each document its runs: rows of (start, length, period)."""
    out: list[np.ndarray] = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if len(t) >= LEAST_WORDS), key=lambda i: len(texts[i]))
    while order:
        group, total = [], 0
        while order and (not group or total < WORDS_TOGETHER and len(texts[order[-1]]) > len(texts[group[0]]) // 2):  # longest first, none of less than half its length
            group.append(order.pop())
            total += len(texts[group[-1]])
        numbers, owner, begins = _sequence([texts[i] for i in group])
        found = find(numbers, owner, len(texts[group[0]])).astype(np.int64)
        of = owner[found[:, 0]]
        cuts = np.searchsorted(of, np.arange(len(group) + 1))
        for k, i in enumerate(group):
            own = found[cuts[k] : cuts[k + 1]]
            out[i] = np.column_stack([own[:, 0] - begins[k], own[:, 1] - own[:, 0], own[:, 2]])
    return out


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run repeats."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _scan(batches):
    for batch in batches:
        texts = [words_of(data) for data in text_bytes(batch.column("text"))]
        runs = runs_of(texts)
        offsets = pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32))
        columns = np.concatenate([np.zeros((0, 3), np.int64), *runs])
        listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(3)], names=["start", "length", "period"]))
        collapsed = pa.array([b" ".join(_kept(t, r)) for t, r in zip(texts, runs)], pa.binary()).cast(pa.string())
        n = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, listed, collapsed], names=["doc_id", "n", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n (its words), runs (start, length, period; by start, then period), collapsed.

    ``collapsed``: the words, joined by one space, without those that a run has after its first period.
    """
    return map_arrow(id_and_text(docs), _scan, FOUND)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; one in ten documents, by its doc_id, is made to repeat itself from some word on.

    With h the CRC-32 of doc_id in decimal and g = floor(h / 10), if h is a multiple of 10: each of the n words from a = g mod n on
    becomes word a + (i - a) mod p, where p = 1 + floor((n - a) / (3 + g mod 8)).
    """
    c = F.col
    h = F.crc32(c("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\x09-\\x0D]+"), lambda w: w != "")

    def repeated(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + F.pmod(i - a, p)).cast("int"))).otherwise(x)), " ")).otherwise(F.lit(""))

    return id_and_text(docs).select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, let(words, repeated)).otherwise(c("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    c = F.col
    found = find_runs(with_repeats(docs))
    longest = F.sort_array(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    best = found.withColumn("best", F.get(longest, F.lit(0)))
    length, period = -c("best.less"), c("best.period")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        c("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.call_function("div", 1000 * length, period).alias("exponent_milli"),
        digest(lines).alias("runs_sha256"),
        digest(c("collapsed")).alias("collapsed_sha256"),
    )


# doc_id is unique in the tables; a run with period q is a stretch of words that equal the word q places on
ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w,
    xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, step: xor(x >> 1, (x & 1) * 3988292384)))) AS h
  FROM documents),
drawn AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM base),
spread AS (SELECT doc_id, w, a, 1 + (n - a) // (3 + g % 8) AS p, unnest(range(n)) AS i FROM drawn),
placed AS (SELECT doc_id, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM spread),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM placed x JOIN placed y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
stretches AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM pairs),
repeats AS (SELECT doc_id, q, min(i) AS s, max(i) + q + 1 AS e FROM stretches GROUP BY doc_id, q, stretch HAVING count(*) >= greatest(q, 12 - q)),
runs AS (SELECT doc_id, s, e - s AS l, min(q) AS q FROM repeats GROUP BY doc_id, s, e),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, min({'less': -l, 's': s, 'q': q}) AS best FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(-best.less AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST((1000 * -best.less) // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)"""
