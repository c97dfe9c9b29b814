"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

1. Documents are tokenised; only those longer than the capacity are cut into pieces.
2. The histogram of piece lengths goes to the driver: at most ``capacity`` rows, however many
   documents there are.
3. Best-fit decreasing runs over the counts.  Bins with the same contents form one group, so a
   step places all pieces of a length in a group at once.  The plan is a table of runs: a range
   of ranks within a length goes to a range of sequences at one offset.  A length either uses up
   a group or splits it, so the number of runs depends on the capacity, not on the corpus.
4. Pieces get a rank within their length and take the planned slot by a join on it.  Ranks come
   from counts of parts of each length, dealt by the row's number in the saved table, so a length
   that many documents share, or one document many times repeated, is ranked by many tasks.

Edge cases: a null text counts as empty; an empty text is one piece that holds only the end
token; repeated documents are packed each on its own; a null doc_id is kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import Workspace
from .common import LONG_ROWS, id_and_text, map_arrow, text_bytes

CAPACITY = 4096
END_ID = 1
#: Plain words: Latin letters that no normalization form changes, and at most one mark.
PLAIN_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
MARK_BYTES = (b".", b",", b";", b":", b"!", b"?")
MARKS = frozenset(b"".join(MARK_BYTES))
#: The letters by which byte-level vocabularies name bytes: printable Latin-1 stands for itself, the others follow from U+0100 on.
BYTE_LETTERS = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else "" for b in range(256)]
for _i, _b in enumerate([b for b in range(256) if not BYTE_LETTERS[b]]):
    BYTE_LETTERS[_b] = chr(256 + _i)
#: Words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED_WORDS = 600_000
#: Runs of letters that the tokenizer gets as one text.
JOINED = 500
#: Longer words are forgotten with the texts that hold them.
LONGEST_REMEMBERED = 100
#: Bytes of text that are split into words together.
SPLIT_TOGETHER = 2_000_000
#: Pieces of one length that one task ranks, about.
RANKED_TOGETHER = 2000
#: A plan of more runs is joined by a shuffle. A capacity of 4,096 gives some tens of thousands at most.
BROADCAST_RUNS = 200_000


class Run(NamedTuple):
    """Ranks [first, last) of a length: ``per_sequence`` to each sequence from ``sequence`` on, side by side from ``offset``."""

    length: int
    first: int
    last: int
    sequence: int
    per_sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over the counts of each length."""
    runs: list[Run] = []
    room: list[int] = []  # remaining capacities in use, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> (first sequence, sequences)
    opened = 0

    def put(left: int, sequence: int, n: int) -> None:
        if left and n:
            if left not in groups:
                groups[left] = []
                bisect.insort(room, left)
            groups[left].append((sequence, n))

    for length in sorted(histogram, reverse=True):
        left_over, rank = histogram[length], 0
        while left_over:
            at = bisect.bisect_left(room, length)
            if at < len(room):
                left = room[at]
                sequence, n = groups[left].pop()
                if not groups[left]:
                    del groups[left], room[at]
            else:
                left, sequence, n = capacity, opened, -(-left_over // (capacity // length))
                opened += n
            each = left // length
            full = min(n, left_over // each)
            if full:
                runs.append(Run(length, rank, rank + full * each, sequence, each, capacity - left))
                put(left - each * length, sequence, full)
                rank += full * each
                left_over -= full * each
            if full < n and left_over:
                runs.append(Run(length, rank, rank + left_over, sequence + full, left_over, capacity - left))
                put(left - left_over * length, sequence + full, 1)
                full, left_over = full + 1, 0
            put(left, sequence + full, n - full)
    return runs


class WordIds:
    """Packed ids (unsigned 32-bit, little-endian) of words, remembered. All come from ``tokenizers``.

    Only for tokenizers that drop white space: there a text's ids are those of its words in turn.
    Plain words, Latin letters with at most one mark after them, need nothing of the tokenizer's
    normalizer and splitter but the lower case.  So they go to the same model without these two, many
    as one text; the tokens that end a word tell where each one's ids end.  Whether that gives the same
    ids is tried at the start; if not, and for all other words, the whole tokenizer is asked.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[bytes, bytes] = {}
        self.long: list[bytes] = []
        self.plain = False
        content = json.loads(vocabulary)
        model = content["model"]
        if model.get("type") == "BPE" and model.get("end_of_word_suffix"):
            content |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
            self.model = Tokenizer.from_str(json.dumps(content))
            self.ends = np.zeros(1 + max(model["vocab"].values()), dtype=bool)
            self.ends[[i for token, i in model["vocab"].items() if token.endswith(model["end_of_word_suffix"])]] = True
            samples = [w.encode() for w in ("the", "Lyestion,", "Élève.", "straße;", "ÜBER", "a", "enenreintion", "ñandúes!", "queeau:")]
            self.plain = True
            self.learn(set(samples))
            self.plain = [self.known[w] for w in samples] == self._full([w.decode() for w in samples])
            self.known.clear()

    def _full(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _learn_runs(self, runs: list[bytes]) -> None:
        """Runs of lower-case letters, or single marks."""
        for i in range(0, len(runs), JOINED):
            some = runs[i : i + JOINED]
            # byte-level vocabularies name each byte by a letter; ASCII ones stand for themselves
            text = " ".join([r.decode() if r.isascii() else "".join([BYTE_LETTERS[b] for b in r]) for r in some])
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(some):
                packed = ids.tobytes()
                self.runs.update(zip(some, [packed[a:b] for a, b in zip([0, *stops], stops)]))
            else:  # another kind of vocabulary
                self.runs.update(zip(some, self._full([r.decode() for r in some])))

    def _plain(self, words: list[bytes], rest: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Each plain word with its letters in lower case, whose ids are known afterwards; ``rest`` gets the others."""
        found, unknown, runs = [], set(), self.runs
        for word in words:
            run = word[:-1] if word[-1] in MARKS else word
            if run.isalpha():  # of bytes: ASCII letters only
                run = run.lower()
            elif PLAIN_LETTERS(run.decode("utf-8", "replace")):
                run = run.decode().lower().encode()
            else:
                rest.append(word)
                continue
            if len(run) > LONGEST_REMEMBERED:
                rest.append(word)
                continue
            if run not in runs:
                unknown.add(run)
            found.append((word, run))
        self._learn_runs([*unknown, *(m for m in MARK_BYTES if m not in runs)])
        return found

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        if len(self.runs) > REMEMBERED_WORDS // 2:
            self.runs.clear()
        known, runs = self.known, self.runs
        new = [w for w in words if w not in known]  # a difference of sets would walk through all that are known
        rest: list[bytes] = []
        if self.plain:
            for word, run in self._plain(new, rest):
                known[word] = runs[run] if len(word) == len(run) else runs[run] + runs[word[-1:]]
        else:
            rest = new
        known.update(zip(rest, self._full([w.decode("utf-8", "replace") for w in rest])))
        self.long += [w for w in rest if len(w) > LONGEST_REMEMBERED]

    def forget(self) -> None:
        """A worker lives on after its task, and needn't hold the words."""
        self.known.clear()
        self.runs.clear()

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """The packed ids of each text."""
        at = 0
        while at < len(texts):
            split, held = [], 0
            while at < len(texts) and held < SPLIT_TOGETHER:
                held += len(texts[at] or b"")
                split.append((texts[at] or b"").split())
                at += 1
            self.learn(set(chain.from_iterable(split)))
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))
            for word in self.long:
                del self.known[word]
            self.long.clear()


_loaded: dict[int, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    """The worker's instance for a vocabulary."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _loaded:
        _loaded[key] = WordIds(vocabulary)
    return _loaded[key]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of each document; with ``with_ids`` also their token ids.

    ``tokenizer``: the path of a ``tokenizers`` file whose pre-tokenizer drops white space. The
    driver reads it and sends it to the workers; such files have a few MB.
    """
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches):
        encoder = word_ids(vocabulary.value)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(text_bytes(batch.column("text")))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4")] if with_ids else [])))
            columns = list(zip(*rows)) or [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)
        encoder.forget()

    return map_arrow(id_and_text(docs), cut, PIECE + ", ids array<int>" * with_ids)


def ranked(lengths: DataFrame, parts: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each length. Each length is ranked in ``parts`` parts by the column ``row``."""
    dealt = lengths.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("row")
    return (
        dealt.withColumn("own", F.row_number().over(within) - 1)
        .join(base, ["length", "part"])
        .withColumn("rank", F.col("base") + F.col("own"))
        .drop("part", "own", "base")
    )


RUNS = T.StructType([T.StructField(f"run_{name}", T.LongType()) for name in Run._fields])


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to saved pieces; their column ``row`` numbers them and is left out."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = plan(histogram, capacity)
    runs = spark.createDataFrame(planned, RUNS)
    runs = F.broadcast(runs) if len(planned) <= BROADCAST_RUNS else runs
    parts = max(16, -(-max(histogram.values(), default=0) // RANKED_TOGETHER))
    c = F.col
    slot = c("rank") - c("run_first")
    return (
        ranked(cut, parts)
        .join(runs, (c("length") == c("run_length")) & (c("rank") >= c("run_first")) & (c("rank") < c("run_last")))
        .withColumn("sequence_id", c("run_sequence") + F.floor(slot / c("run_per_sequence")).cast("long"))
        .withColumn("offset", c("run_offset") + F.pmod(slot, c("run_per_sequence")) * c("length"))
        .select(*(x for x in cut.columns if x != "row"), "sequence_id", "offset")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, work: Workspace | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    work = work or Workspace(docs.sparkSession, "packing", LONG_ROWS)
    return place(work.save(pieces(docs, tokenizer, capacity, end_id, with_ids).withColumn("row", F.monotonically_increasing_id())), capacity)
