"""Benchmark decontamination: passages of documents within an edit distance of a benchmark item.

Words are runs of letters, digits and non-ASCII bytes with A-Z lower-cased; other ASCII characters
separate them.  A document holds an item of n words if some passage of it is at most
floor((1 - SIMILARITY) * n) word edits away.

1. Windows.  A passage that close shares an unbroken run of ``run_words(n)`` words with the item
   (the edits cut the item into one part more than there are edits), so only windows of n words
   that line up with such a run are looked at.  None is lost by this.
2. CGK embedding.  A random walk reads a window: at step t it writes the word it is at and moves
   on by a random bit that depends on t and the word's group.  A small edit distance becomes a small
   Hamming distance.
3. Bit-sampling LSH.  Each repetition takes ``SAMPLED`` positions of the embedding as a key and
   looks it up among the items' keys.  For each length of items, repetitions are added until ``RECALL`` of
   randomly edited items (at the largest distance allowed) are found in the windows that they really give, and
   ``MARGIN`` times as many are made.  Items of lengths for which ``MOST_REPETITIONS`` don't do are compared
   with every window that has one of their runs at its place.
4. Candidates are confirmed by the exact edit distance of the item to the best passage around
   the window.

Items are broadcast in blocks of at most ``BLOCK_BYTES`` of text; all documents pass each block.  Of
several blocks one is in memory at a time: its results are saved before the next one is sent.

Edge cases: items without words match nothing, and items of up to four words match only
themselves; null and empty texts hold nothing; repeated documents and items each give their own
rows; a null doc_id or item_id is kept; an empty table on either side gives an empty result;
texts are read whole; other columns are ignored by ``find`` and kept by ``clean``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .common import LONG_ROWS, id_and_text, map_arrow, text_bytes, without_rows

SIMILARITY = 0.8
RECALL = 0.99
SAMPLED = 2
#: Steps of the walk for each word of the window.
STEPS_PER_WORD = 3
MOST_REPETITIONS = 512
#: Keys that are sampled from one walk.
KEYS_PER_WALK = 32
#: A step's random bits are drawn for so many groups of words.
WORD_GROUPS = 4096
#: Edited items of a length by which its repetitions are set, fewer of long items, and by how much these are then raised.
MOST_TRIALS, LEAST_TRIALS, TRIAL_WORDS = 120, 50, 24_000
MARGIN = 1.5
BLOCK_BYTES = 4_000_000
#: Cells of embeddings, and bytes of documents, at a time: bounds a worker's memory.
CELLS_TOGETHER, BYTES_TOGETHER = 2_000_000, 8_000_000
PADDING = 1
_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(_SPACES).split() if data else []


def most_edits(n: int) -> int:
    return int((1 - SIMILARITY) * n + 1e-9)


def run_words(n: int) -> int:
    """Words of an unbroken run that any passage close enough shares with an item of n words; 3 at most."""
    k = most_edits(n)
    return min(3, -(-(n - k) // (k + 1)))


def edit_distance(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: the least distance of the item to any part of the passage, and where that part ends."""
    count, width = passages.shape
    steps = np.arange(width + 1)
    row = np.zeros((count, width + 1), dtype=np.int64)
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (passages != items[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    end = row.argmin(axis=1)
    return row[np.arange(count), end], end


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Lsh:
    """CGK walks, and the keys sampled from each: repetition r is key r % KEYS_PER_WALK of walk r // KEYS_PER_WALK."""

    def __init__(self, longest: int):
        self.steps = STEPS_PER_WORD * longest

    def walk(self, windows: np.ndarray, lengths: np.ndarray, number: int) -> np.ndarray:
        """The embeddings: windows are rows of words, padded beyond their length with at least one column."""
        turns = np.random.default_rng([self.steps, number]).integers(0, 2, (self.steps, WORD_GROUPS), dtype=np.int64)
        group = (_mixed(windows.astype(np.uint64) + np.uint64(1)) % np.uint64(WORD_GROUPS)).astype(np.int64).ravel()
        flat, first = windows.ravel(), np.arange(len(windows)) * windows.shape[1]
        at, last = first.copy(), first + lengths
        out = np.empty((STEPS_PER_WORD * int(lengths.max(initial=0)), len(windows)), dtype=np.int32)
        for t in range(len(out)):
            out[t] = flat[at]
            at = np.minimum(last, at + turns[t][group[at]])
        return out

    def keys(self, embedded: np.ndarray, lengths: np.ndarray, r: int) -> np.ndarray:
        """The key of repetition r: a hash of the length and of SAMPLED positions, which depend on the length."""
        rng = np.random.default_rng([self.steps, 1 + r])
        share, factor = rng.random(SAMPLED), rng.integers(0, 1 << 62, SAMPLED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        key, column = _mixed(lengths.astype(np.uint64)), np.arange(len(lengths))
        for x, f in zip(share.tolist(), factor):
            key = key + _mixed(embedded[(x * STEPS_PER_WORD * lengths).astype(np.int64), column].astype(np.uint64) + np.uint64(1)) * f
        return key

    def all_keys(self, windows: np.ndarray, lengths: np.ndarray, repetitions: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(r, rows, keys) of each repetition r, for the rows that have more than r of them."""
        for number in range(-(-int(repetitions.max(initial=0)) // KEYS_PER_WALK)):
            rows = np.flatnonzero(repetitions > number * KEYS_PER_WALK)
            own, most = lengths[rows], repetitions[rows]
            embedded = self.walk(windows[rows], own, number)
            for r in range(number * KEYS_PER_WALK, min(int(most.max()), (number + 1) * KEYS_PER_WALK)):
                use = most > r
                yield r, rows[use], self.keys(embedded, own, r)[use]


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    out = np.full((len(rows), int(lengths.max(initial=0)) + 1), PADDING, dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


class Index:
    """A block of items: their words, the runs they are found by, and their LSH tables."""

    def __init__(self, items: list[tuple[int, bytes | None]]):
        self.numbers: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.items: list[np.ndarray] = []
        for item_id, text in items:
            if words := words_of(text):
                # 0: no item's word; 1: padding
                self.items.append(np.array([self.numbers.setdefault(w, len(self.numbers) + 2) for w in words], dtype=np.int64))
                self.ids.append(item_id)
        self.base = len(self.numbers) + 2
        runs: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for item in self.items:
            q = run_words(len(item))
            for j, code in enumerate(self._runs(item, q).tolist()):
                runs[q][code].add((len(item), j))
        self.runs = {}
        for q, found in runs.items():
            codes = np.array(sorted(found), dtype=np.int64)
            places = [sorted(found[c]) for c in codes.tolist()]
            first = np.cumsum([0, *map(len, places)])
            self.runs[q] = codes, first, np.array([x for p in places for x in p], dtype=np.int64).reshape(-1, 2)
        self.lsh = Lsh(max(map(len, self.items), default=1))
        #: by length of items: trials, and those found; repetitions; and the runs of lengths that are compared without keys
        self.trials: dict[int, tuple[int, int]] = {}
        self.exact: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.repetitions: dict[int, int] = {}
        by_length = defaultdict(list)
        for k, item in enumerate(self.items):
            by_length[len(item)].append(k)
        for n, same in sorted(by_length.items()):
            self._enough(n, same)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        if self.items:
            padded, lengths = _padded(self.items)
            for _, rows, keys in self.lsh.all_keys(padded, lengths, self._repetitions(lengths)):
                order = np.argsort(keys, kind="stable")
                self.tables.append((keys[order], rows[order]))

    def _repetitions(self, lengths: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(lengths, return_inverse=True)
        return np.array([self.repetitions[n] for n in distinct.tolist()], dtype=np.int64)[at]

    def _runs(self, numbers: np.ndarray, q: int) -> np.ndarray:
        """Codes of the runs of q words; base**3 stays below 2**63 for two million words."""
        code = np.zeros(max(0, len(numbers) - q + 1), dtype=np.int64)
        for j in range(q):
            code = code * self.base + numbers[j : j + len(code)]
        return code

    def _enough(self, n: int, same: list[int]) -> None:
        """Sets the repetitions of a length, so that RECALL of items edited as much as is allowed share a key with their original."""
        if not most_edits(n):
            self.repetitions[n] = 1
            return
        rng = np.random.default_rng([7, n])
        trials = max(LEAST_TRIALS, min(MOST_TRIALS, TRIAL_WORDS // n))
        together = max(1, min(trials, CELLS_TOGETHER // (STEPS_PER_WORD * n * (2 * most_edits(n) + 1))))
        first = np.concatenate([self._first_hits(n, same, rng, together) for _ in range(-(-trials // together))])
        last = int(np.sort(first)[int(np.ceil(RECALL * len(first))) - 1])
        if last < MOST_REPETITIONS:
            self.repetitions[n] = min(MOST_REPETITIONS, int(np.ceil(MARGIN * (last + 1))))
        else:
            self.repetitions[n] = 0
            q = run_words(n)
            codes = np.array([self._runs(self.items[k], q) for k in same])
            orders = [np.argsort(column, kind="stable") for column in codes.T]
            self.exact[n] = [(column[order], np.array(same)[order]) for column, order in zip(codes.T, orders)]
        self.trials[n] = len(first), int((first < self.repetitions[n]).sum()) if self.repetitions[n] else len(first)

    def _first_hits(self, n: int, same: list[int], rng: np.random.Generator, trials: int) -> np.ndarray:
        """The first repetition that finds each of some edited items, in the windows that it gives among words of no item."""
        chosen, owner, rows = rng.choice(same, trials), [], []
        for t, k in enumerate(chosen.tolist()):
            edited = self.items[k].tolist()
            for _ in range(most_edits(n)):
                where, kind = int(rng.integers(0, len(edited))), int(rng.integers(0, 3))
                edited[where : where + (kind != 1)] = [] if kind == 2 else [0]
            text = np.concatenate([np.zeros(n, np.int64), np.array(edited, np.int64), np.zeros(n, np.int64)])
            sizes, starts = self.windows(text)
            mine = starts[sizes == n]
            owner += [t] * len(mine)
            rows.append(self._cut({0: text}, np.zeros(len(mine), np.int64), mine, np.full(len(mine), n)))
        originals, (edited, owner) = _padded([self.items[k] for k in chosen.tolist()])[0], (np.concatenate(rows), np.array(owner, np.int64))
        first = np.full(trials, MOST_REPETITIONS)
        for r in range(MOST_REPETITIONS):
            if r % KEYS_PER_WALK == 0:
                left = first[owner] == MOST_REPETITIONS
                edited, owner = edited[left], owner[left]
                if not len(owner):
                    break
                sizes = np.full(trials, n), np.full(len(owner), n)
                x, y = (self.lsh.walk(part, size, r // KEYS_PER_WALK) for part, size in zip((originals, edited), sizes))
            hit = owner[self.lsh.keys(y, sizes[1], r) == self.lsh.keys(x, sizes[0], r)[owner]]
            first[hit] = np.minimum(first[hit], r)
        return first

    def windows(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and starts of the windows that line up with a run of some item. A start may be negative."""
        found = [np.zeros((0, 2), dtype=np.int64)]
        for q, (codes, first, places) in self.runs.items():
            if len(numbers) < q:
                continue
            known = np.flatnonzero(np.logical_and.reduce([numbers[j : len(numbers) - q + 1 + j] for j in range(q)]))
            code = self._runs(numbers, q)[known]
            at = np.searchsorted(codes, code)
            hit = at < len(codes)
            hit[hit] = codes[at[hit]] == code[hit]
            if not hit.any():
                continue
            known, at = known[hit], at[hit]
            count = first[at + 1] - first[at]
            which = np.repeat(first[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            found.append(np.stack([places[which, 0], np.repeat(known, count) - places[which, 1]], axis=1))
        both = np.concatenate(found)
        both = np.unique(both, axis=0) if len(both) > 1 else both
        return both[:, 0], both[:, 1]

    def search(self, texts: list[bytes | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, end, distance): the best passage for each item that a text holds."""
        get = self.numbers.get
        numbers, rows = {}, [np.zeros((0, 3), dtype=np.int64)]
        for i, text in enumerate(texts):
            if words := words_of(text):
                own = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
                lengths, starts = self.windows(own)
                if len(starts):
                    numbers[i] = own
                    rows.append(np.stack([lengths, np.full(len(starts), i), starts], axis=1))
        rows = np.concatenate(rows)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        at = 0
        while at < len(rows):
            end = min(len(rows), at + max(1, CELLS_TOGETHER // int(rows[at, 0] * STEPS_PER_WORD)))
            while end - at > 1 and (end - at) * int(rows[end - 1, 0]) * STEPS_PER_WORD > 2 * CELLS_TOGETHER:
                end = at + (end - at) // 2
            for i, item, first, stop, distance in self._confirmed(numbers, *rows[at:end].T):
                if (i, item) not in best or (distance, first) < (best[i, item][2], best[i, item][0]):
                    best[i, item] = first, stop, distance
            at = end
        return [(i, item, *found) for (i, item), found in best.items()]

    @staticmethod
    def _cut(numbers: dict[int, np.ndarray], text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The words from each start on, as many as length says, padded to one column more than the longest."""
        out = np.full((len(text), int(length.max(initial=0)) + 1), PADDING, dtype=np.int64)
        for row, (i, s, n) in enumerate(zip(text.tolist(), start.tolist(), length.tolist())):
            own = numbers[i][max(0, s) : max(0, s + n)]
            out[row, max(0, -s) : max(0, -s) + len(own)] = own
        return out

    def _confirmed(self, numbers: dict[int, np.ndarray], length: np.ndarray, text: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        pairs = [np.zeros((0, 2), dtype=np.int64)]

        def met(keys: np.ndarray, items: np.ndarray, key: np.ndarray, rows: np.ndarray) -> None:
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            while (more := np.flatnonzero(low < high)).size:
                pairs.append(np.stack([items[low[more]], rows[more]], axis=1))
                low[more] += 1

        windows = self._cut(numbers, text, start, length)
        for r, rows, key in self.lsh.all_keys(windows, length, self._repetitions(length)):
            met(*self.tables[r], key, rows)
        for n, places in self.exact.items():
            at = np.flatnonzero(length == n)
            q = run_words(n)
            for j, (codes, items) in enumerate(places if len(at) else ()):
                part = windows[at, j : j + q]
                known = (part > PADDING).all(axis=1)
                code = np.zeros(int(known.sum()), dtype=np.int64)
                for column in part[known].T:
                    code = code * self.base + column
                met(codes, items, code, at[known])
        item, row = np.unique(np.concatenate(pairs), axis=0).T
        same = np.array([len(self.items[k]) for k in item.tolist()], dtype=np.int64) == length[row]  # else hashes met by chance
        item, row, out = item[same], row[same], []
        for n in np.unique(length[row]).tolist():
            own, at, k = item[length[row] == n], row[length[row] == n], most_edits(n)
            step = max(1, CELLS_TOGETHER // (n + 2 * k))
            for c in range(0, len(own), step):
                part, rows = own[c : c + step], at[c : c + step]
                wide = self._cut(numbers, text[rows], start[rows] - k, np.full(len(rows), n + 2 * k))[:, :-1]
                distance, end = edit_distance(np.stack([self.items[x] for x in part.tolist()]), wide)
                for g in np.flatnonzero(distance <= k).tolist():
                    stop = int(start[rows[g]] - k + end[g])
                    out.append((int(text[rows[g]]), int(part[g]), max(0, stop - n), stop, int(distance[g])))
        return out


def blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items, in blocks of at most about BLOCK_BYTES of text."""
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r["item_id"], r["text"].encode()) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _in_parts(batches, *columns: str):
    """Record batches of about BYTES_TOGETHER of text, with their texts."""
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        at = 0
        while at < len(texts):
            begin, held = at, 0
            while at < len(texts) and held < BYTES_TOGETHER:
                held += len(texts[at] or b"") + 100
                at += 1
            yield batch.slice(begin, at - begin), texts[begin:at]


FOUND = "doc_id long, item_id long, first_word long, end_word long, distance int, similarity double"


def find(docs: DataFrame, items: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row per document and item that it holds: the best passage and its distance in words.

    first_word is end_word less the item's length; the passage may be up to ``distance`` words shorter or longer.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs)
    found = _each_block(items, lambda sent: map_arrow(docs, _finder(sent), FOUND), work or Workspace(spark, "decontam", LONG_ROWS))
    return reduce(DataFrame.union, found, spark.createDataFrame([], FOUND))


def recall(items: DataFrame) -> list[tuple[int, int, int]]:
    """(words, trials, found): of items of a length, edited as much as is allowed, how many share a key with a window."""
    total: Counter = Counter()
    for block in blocks(items):
        for n, (trials, found) in Index(block).trials.items():
            total[n, "trials"] += trials
            total[n, "found"] += found
    return [(n, total[n, "trials"], total[n, "found"]) for n in sorted({n for n, _ in total})]


def _each_block(items: DataFrame, search, work: Workspace) -> list[DataFrame]:
    """``search(broadcast index)`` of each block, saved before the next block is sent."""
    out = []
    for block in blocks(items):
        index = Index(block)
        if index.items:
            sent = items.sparkSession.sparkContext.broadcast(index)
            out.append(work.save(search(sent)))
            sent.destroy()
    return out


def _finder(sent):
    def search(batches):
        index = sent.value
        for batch, texts in _in_parts(batches):
            found = index.search(texts)
            doc = batch.column("doc_id").take(pa.array([i for i, *_ in found], pa.int64()))
            item = [index.ids[k] for _, k, *_ in found]
            share = [1 - d / len(index.items[k]) for _, k, _, _, d in found]
            rest = [pa.array([x[c] for x in found], t) for c, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.int32()))]
            yield pa.RecordBatch.from_arrays([doc, pa.array(item, pa.int64()), *rest, pa.array(share, pa.float64())], names=[x.split()[0] for x in FOUND.split(", ")])

    return search


def clean(docs: DataFrame, items: DataFrame, work: Workspace | None = None) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    work = work or Workspace(docs.sparkSession, "decontam", LONG_ROWS)

    def holders(sent):
        def hold(batches):
            index = sent.value
            for batch, texts in _in_parts(batches):
                bad = {i for i, *_ in index.search(texts)}
                yield batch.filter(pa.array([i in bad for i in range(len(texts))], pa.bool_())).select(["file", "row"])

        return hold

    def lost(rows: DataFrame) -> DataFrame:
        found = _each_block(items, lambda sent: map_arrow(rows, holders(sent), "file long, row long"), work)
        return reduce(DataFrame.union, found, rows.select("file", "row").limit(0))

    return without_rows(docs, lost, work)
