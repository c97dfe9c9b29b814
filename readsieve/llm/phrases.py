"""Removing repeated passages with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of one document.  A word goes if some window covers it
whose word sequence also starts in a document with a smaller doc_id; all windows are judged on the
input.

1. Seeds.  Of the 8 runs of 6 words in a window, the one with the least hash is its seed; equal
   windows have equal seeds, and neighbouring windows mostly share theirs, so there are few.  Seeds
   that occur in one document only are dropped: no window with such a seed recurs.
2. Recurring windows.  Only windows with a recurring seed are hashed (64 bits) and counted, and the
   text around them is kept aside.  Of each window that occurs in two documents or more, the smallest
   doc_id is its source.
3. Passages.  The text of all source windows is cut out of what was kept aside; windows that follow on
   each other form one passage.
4. Automata.  Documents are dealt into shards of about ``SHARD_DOCUMENTS``, and as many tasks as these
   ask for, whatever the session's number of partitions. Each shard gets the
   passages that some document of it may repeat, compiles phrases of them into an Aho-Corasick
   automaton, and streams all its documents through it.  The windows around each occurrence of a
   phrase are looked up among those of the passages.  Words are compared, not hashes, so what is
   removed really is repeated.

Hot passages: counting combines before the shuffle, joins on seeds and windows are plain
equi-joins that adaptive execution splits, and a passage reaches a shard once, however many
documents repeat it.  Rows of one doc_id are dealt by their text as well.

Edge cases: null and empty texts have no words; documents of less than ``WINDOW`` words keep all;
rows of the same doc_id are one document for the comparison, so they don't shorten each other;
rows without a doc_id keep their words and are nobody's source; an empty table gives an empty
result; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .common import LONG_ROWS, id_and_text, map_arrow, text_bytes, words_of

WINDOW = 13
SEED_WORDS = 6
SHARD_DOCUMENTS = 1000
#: Shards that one task streams, one after the other, at most.
SHARDS_IN_TASK = 16
#: A word's number within an automaton has so many digits of this base.
LETTERS, BASE = 3, 100
MOST_WORDS = BASE**LETTERS - 200_000  # the last passage may add more
_FACTORS = np.random.default_rng(13).integers(0, 1 << 62, (2, WINDOW), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _runs(hashes: np.ndarray, length: int, factors: np.ndarray) -> np.ndarray:
    """A hash of each run of so many words."""
    n = len(hashes) - length + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(length):
        out += hashes[j : j + n] * factors[j]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def _seeds(hashes: np.ndarray) -> np.ndarray:
    """The seed of each window."""
    grams = _runs(hashes, SEED_WORDS, _FACTORS[0])
    have = 1
    while have < WINDOW - SEED_WORDS + 1:  # least of 2, 4, 8 runs
        step = min(have, WINDOW - SEED_WORDS + 1 - have)
        grams = np.minimum(grams[: len(grams) - step], grams[step:])
        have += step
    return grams


def _emit_seeds(batches):
    for batch in batches:
        docs, found = batch.column("doc_id"), []
        for data in text_bytes(batch.column("text")):
            words = words_of(data)
            found.append(np.unique(_seeds(_hashes(words))) if len(words) >= WINDOW else np.zeros(0, np.uint64))
        if found:
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), docs.take(pa.array(rows))], names=["seed", "doc_id"])


def _lists(column):
    """A sorted array for each list of an Arrow column of lists of longs."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (np.sort(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:]))


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where values are among the sorted ones, of which there is at least one."""
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values)


#: Two kinds of rows: windows, and the text of windows that follow on each other.
MET = "w long, doc_id long, shard int, text string"


def _passages(words: list[bytes], starts: np.ndarray) -> list[bytes]:
    """The text of windows that follow on each other."""
    parts = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else []
    return [b" ".join(words[part[0] : part[-1] + WINDOW]) for part in parts]


def _emit_windows(batches):
    for batch in batches:
        docs, shards = batch.column("doc_id"), batch.column("shard")
        found, texts, owner = [], [], []
        for i, (data, seeds) in enumerate(zip(text_bytes(batch.column("text")), _lists(batch.column("seeds")))):
            words = words_of(data)
            at = np.zeros(0, np.int64)
            if len(words) >= WINDOW:
                hashes = _hashes(words)
                at = _within(_seeds(hashes).view(np.int64), seeds)
                found.append(np.unique(_runs(hashes, WINDOW, _FACTORS[1])[at]))
            else:
                found.append(np.zeros(0, np.uint64))
            own = _passages(words, at)
            texts += own
            owner += [i] * len(own)
        if found:
            rows = pa.array(np.concatenate([np.repeat(np.arange(len(found)), list(map(len, found))), np.array(owner, np.int64)]))
            windows = np.concatenate(found).view(np.int64)
            w = pa.concat_arrays([pa.array(windows), pa.nulls(len(texts), pa.int64())])
            text = pa.concat_arrays([pa.nulls(len(windows), pa.string()), pa.array(texts, pa.binary()).cast(pa.string())])
            yield pa.RecordBatch.from_arrays([w, docs.take(rows), shards.take(rows), text], names=["w", "doc_id", "shard", "text"])


def _cut_passages(batches):
    for batch in batches:
        out, docs = [], []
        for doc, data, sources in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), _lists(batch.column("sources"))):
            words = words_of(data)
            if len(words) < WINDOW:
                continue
            own = _passages(words, _within(_runs(_hashes(words), WINDOW, _FACTORS[1]).view(np.int64), sources))
            out += own
            docs += [doc] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "text"])


class Automaton:
    """Finds phrases of passages in a text, and the passages' windows around them.

    The phrases are every eighth run of 6 words of a passage, so each window holds one.

    A word is written as LETTERS characters, as the automaton looks through a node's edges one by one.
    """

    def __init__(self):
        self.numbers: dict[bytes, str] = {}
        self.phrases: set[str] = set()
        self.sources: dict[str, int] = {}  # window -> the smallest document that it is known from
        self.compiled = None

    def full(self) -> bool:
        return len(self.numbers) > MOST_WORDS

    def _number(self, n: int) -> str:
        return chr(1 + n // BASE**2) + chr(1 + n // BASE % BASE) + chr(1 + n % BASE)

    def add(self, source: int, words: list[bytes]) -> None:
        for word in words:
            if word not in self.numbers:
                self.numbers[word] = self._number(len(self.numbers))
        text = "".join([self.numbers[w] for w in words])
        known = self.sources.get
        for i in range(0, len(text) - LETTERS * SEED_WORDS + 1, LETTERS * (WINDOW - SEED_WORDS + 1)):
            self.phrases.add(text[i : i + LETTERS * SEED_WORDS])
        for i in range(0, len(text) - LETTERS * WINDOW + 1, LETTERS):
            window = text[i : i + LETTERS * WINDOW]
            if known(window, source) >= source:
                self.sources[window] = source

    def compile(self) -> None:
        self.compiled = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for phrase in self.phrases:
            self.compiled.add_word(phrase, 1)
        self.compiled.make_automaton()
        self.phrases = set()

    def starts(self, doc: int, words: list[bytes]) -> list[int]:
        """Where windows start that a smaller document holds as well."""
        get, known = self.numbers.get, self.sources.get
        text = "".join([get(w, "\0" * LETTERS) for w in words])
        found, looked, last_start = [], 0, len(words) - WINDOW
        for end, _ in self.compiled.iter(text):
            at, aside = divmod(end + 1 - LETTERS * SEED_WORDS, LETTERS)
            if aside:
                continue  # not at a word
            # windows that hold this phrase and no earlier one
            for i in range(max(looked, at - WINDOW + SEED_WORDS), min(at, last_start) + 1):
                if known(text[LETTERS * i : LETTERS * (i + WINDOW)], doc) < doc:
                    found.append(i)
            looked = max(looked, at + 1)
        return found


def covered(n: int, starts: list[int]) -> np.ndarray:
    """Which of n words the windows cover."""
    change = np.zeros(n + 1, dtype=np.int64)
    change[starts] = 1
    np.subtract.at(change, np.array(starts, dtype=np.int64) + WINDOW, 1)
    return np.cumsum(change[:n]) > 0


def _stream(batches):
    """Rows by shard: first its passages, then its documents."""
    shard, automata = None, []
    for batch in batches:
        out: list[tuple] = []
        for own, kind, doc, data in zip(*(batch.column(k).to_pylist() for k in ("shard", "kind", "doc_id")), text_bytes(batch.column("text"))):
            if own != shard:
                shard, automata = own, []
            words = words_of(data)
            if kind == 0:
                if not automata or automata[-1].full():
                    automata.append(Automaton())
                automata[-1].add(doc, words)
                continue
            for a in automata:
                if a.compiled is None:
                    a.compile()
            found = sorted({i for a in automata for i in a.starts(doc, words)}) if doc is not None and len(words) >= WINDOW else []
            kept = [words[i] for i in np.flatnonzero(~covered(len(words), found)).tolist()] if found else words
            out.append((doc, b" ".join(kept), len(words), len(words) - len(kept)))
        if out:
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
            arrays[1] = arrays[1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, text (the words kept, joined by one space), n_words, n_removed."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "phrases", LONG_ROWS)
    docs = id_and_text(docs)
    shards = max(1, -(-docs.count() // SHARD_DOCUMENTS))
    docs = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"), "text")
    named = docs.where("doc_id is not null")
    c = F.col

    seeds = work.save(map_arrow(named.select("doc_id", "text"), _emit_seeds, "seed long, doc_id long"))
    recurring = seeds.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("seed")
    own = work.save(seeds.join(recurring, "seed").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds")))
    work.drop(seeds)

    met = work.save(map_arrow(named.join(own, "doc_id"), _emit_windows, MET))
    work.drop(own)
    windows = met.where("w is not null").select("w", "doc_id", "shard")
    sources = windows.groupBy("w").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("high")).where("source < high")
    sources = work.save(sources.select("w", "source"))
    needed = windows.join(sources, "w").where("doc_id > source").select("shard", c("source").alias("doc_id")).distinct()
    needed = work.save(needed)
    by_document = sources.groupBy(c("source").alias("doc_id")).agg(F.collect_list("w").alias("sources"))
    kept = met.where("w is null").select("doc_id", "text")
    passages = work.save(map_arrow(kept.join(by_document, "doc_id"), _cut_passages, "doc_id long, text string"))
    work.drop(met)
    work.drop(sources)

    patterns = needed.join(passages, "doc_id").select("shard", F.lit(0).alias("kind"), "doc_id", "text")
    dealt = patterns.union(docs.select("shard", F.lit(1), "doc_id", "text"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // SHARDS_IN_TASK))
    dealt = dealt.repartition(tasks, "shard").sortWithinPartitions("shard", "kind")
    return map_arrow(dealt, _stream, "doc_id long, text string, n_words long, n_removed long")


def report(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    work = work or Workspace(docs.sparkSession, "phrases", LONG_ROWS)
    return work.save(remove_repeats(docs, work).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")))


# doc_id is unique in the tables
ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i+12], ' ') AS seq FROM (SELECT *, unnest(generate_series(1, len(words) - 12)) AS i FROM docs)),
first AS (SELECT seq, min(doc_id) AS source FROM windows GROUP BY seq),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS place FROM windows JOIN first USING (seq) WHERE source < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS place FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""
