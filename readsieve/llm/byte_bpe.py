"""Byte-level BPE: texts to token ids and back.

A pattern splits a text into pre-tokens, and each pre-token is merged by itself.  The pattern never
looks back, so two runs over a text that agree on one boundary agree on all that follow.

1. Texts of up to ``CHUNK`` code points are one chunk, encoded by the task that reads them.
2. Longer texts are cut into chunks that overlap by ``OVERLAP`` code points and are dealt to all tasks.  Each is
   pre-tokenised from its start, which may lie within a pre-token of the text, so its first boundaries
   may be wrong.  Boundaries too near to the chunk's end to be sure are left out.
3. Stitching: where the boundaries of a chunk and of the one before meet for the first time within the overlap, the
   later chunk takes over.  By induction all boundaries from there on are those of the whole text.
   Only the boundaries within overlaps are looked at, so a text of a gigabyte has some tens of MB for this.
4. Chunks that never meet the one before, as a pre-token covers the whole overlap, are one piece with it and
   split anew together: a pre-token is merged as a whole, so one task must have it anyway.
5. Each piece's pre-tokens are encoded, and a text's ids are put together in order.

Decoding looks up each id's bytes and joins them; tokens may end within a character, so the result is binary.

The documents are read twice, for short and for long texts, as no text is moved unless it is long.
``tokenizer``: the path of a file with lines of a token in base64 and its rank.  The driver reads it (about
a megabyte) and sends it to the workers.

Edge cases: null and empty texts have no ids and decode to no bytes; ids that are not in the vocabulary
make the decoded value null; repeated rows give equal rows; a null doc_id is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace
from .common import LONG_ROWS, map_arrow, numbered

PATTERN = public_tokenizers.PATTERN
#: Code points of a chunk, and of the next chunk that it also has.
CHUNK, OVERLAP = 1 << 16, 512
#: A boundary depends on so many code points after it at most, and the pattern's longest fixed part on some more.
LOOKAHEAD = 4
#: Pre-tokens whose ids a worker remembers, and how long they are at most; beyond it the memory starts anew.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 64
#: A batch of results has about so many ids.
RETURNED_TOGETHER = 2_000_000


def ranks_of(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Codec:
    """One vocabulary's pre-tokens, ids and bytes."""

    def __init__(self, content: bytes, pattern: str = PATTERN):
        ranks = ranks_of(content)
        # all of what it gets is one match: pre-tokens come from here, their merges from the library
        self.merger = tiktoken.Encoding("pre-token", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        # the same pattern for texts of ASCII only, for a faster engine
        ascii_pattern = pattern.replace(r"\p{L}+", "[A-Za-z]+").replace(r"\p{N}+", "[0-9]+").replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
        self.split_ascii = self.split if r"\p" in ascii_pattern else re.compile(ascii_pattern, re.ASCII).findall
        self.known: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> list[str]:
        return self.split_ascii(text) if text.isascii() else self.split(text)

    def ids(self, pre_tokens: list[str]) -> np.ndarray:
        known = self.known
        found = [known.get(p) for p in pre_tokens]
        for i, ids in enumerate(found):
            if ids is None:
                p = pre_tokens[i]
                found[i] = ids = known.get(p) or np.array(self.merger.encode_ordinary(p), dtype="<i4").tobytes()
                if len(p) <= LONGEST_REMEMBERED:
                    known[p] = ids
        if len(known) > REMEMBERED:
            known.clear()
        return np.frombuffer(b"".join(found), "<i4")

    def bytes_of(self, ids: list[int]) -> bytes | None:
        try:
            return b"".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return None


_loaded: dict[tuple[int, str], Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """The worker's instance for a vocabulary."""
    key = zlib.crc32(content), pattern
    if key not in _loaded:
        _loaded[key] = Codec(content, pattern)
    return _loaded[key]


def _vocabulary(docs: DataFrame, tokenizer: str):
    with open(tokenizer, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *values]), kind))


def _encoded(batch: pa.RecordBatch, ids: list[np.ndarray], first: int) -> pa.RecordBatch:
    """The rows from ``first`` on that have ids, the text left out."""
    rows = batch.slice(first, len(ids)).drop_columns(["text"])
    return pa.RecordBatch.from_arrays([*rows.columns, _lists(ids, pa.int32())], names=[*rows.schema.names, "ids"])


def chunks_of(text: str, size: int, overlap: int) -> list[str]:
    return [text[at : at + size + overlap] for at in range(0, len(text), size)]


def _sure_ends(sizes: np.ndarray, length: int, last: bool) -> np.ndarray:
    """Where pre-tokens end whatever follows the chunk, with the chunk's start."""
    ends = np.cumsum(sizes)
    return np.concatenate([[0], ends if last else ends[ends <= length - LOOKAHEAD]])


def _within(sizes: np.ndarray, text: str, begin: int, end: int) -> list[str]:
    ends = np.cumsum(sizes)
    starts = ends - sizes
    use = (starts >= begin) & (ends <= end)
    return [text[a:b] for a, b in zip(starts[use].tolist(), ends[use].tolist())]


CHUNKS = "file long, row long, doc_id long, chunk int, last boolean, text string"
BOUNDS = CHUNKS + ", sizes array<int>, head array<long>, tail array<long>"


def _long_texts(long: DataFrame, vocabulary, pattern: str, work: Workspace) -> DataFrame:
    """doc_id and ids of texts in several chunks; columns file, row, doc_id, text."""
    size, overlap = CHUNK, OVERLAP
    c = F.col

    def cut(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                parts = chunks_of(text.as_py(), size, overlap)
                for k in range(0, len(parts), 64):
                    some = parts[k : k + 64]
                    numbers = list(range(k, k + len(some)))
                    known = [batch.column(name).take(pa.array([i] * len(some))) for name in ("file", "row", "doc_id")]
                    lasts = pa.array([n == len(parts) - 1 for n in numbers])
                    yield pa.RecordBatch.from_arrays([*known, pa.array(numbers, pa.int32()), lasts, pa.array(some, pa.string())], names=["file", "row", "doc_id", "chunk", "last", "text"])

    def pre_tokenise(batches):
        own = codec(vocabulary.value, pattern)
        for batch in batches:
            sizes, heads, tails = [], [], []
            for k, last, text in zip(*(batch.column(name).to_pylist() for name in ("chunk", "last", "text"))):
                found = own.pre_tokens(text)
                sizes.append(np.fromiter(map(len, found), np.int32, len(found)))
                sure = _sure_ends(sizes[-1], len(text), last) + k * size
                heads.append(sure[sure < k * size + overlap])
                tails.append(sure[sure >= (k + 1) * size])
            added = [_lists(sizes, pa.int32()), _lists(heads, pa.int64()), _lists(tails, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "sizes", "head", "tail"])

    def encode_pieces(batches):
        own = codec(vocabulary.value, pattern)
        for batch in batches:
            ids = []
            for parts, first, begin, end in zip(*(batch.column(name).to_pylist() for name in ("parts", "piece", "begin", "end"))):
                begin, end = begin - first * size, (1 << 62) if end is None else end - first * size
                if len(parts) == 1:
                    text, sizes = parts[0]["text"], np.array(parts[0]["sizes"], np.int64)
                else:
                    text = "".join([p["text"][:size] for p in parts[:-1]] + [parts[-1]["text"]])
                    before, text = begin, text[begin:]
                    begin, end = 0, end - before
                    sizes = np.array([len(p) for p in own.pre_tokens(text)], np.int64)
                ids.append(own.ids(_within(sizes, text, begin, end)))
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in ("file", "row", "doc_id", "piece")), _lists(ids, pa.int32())], names=["file", "row", "doc_id", "piece", "ids"])

    key = ["file", "row"]
    dealt = map_arrow(long, cut, CHUNKS).repartition(*key, "chunk")
    chunks = work.save(map_arrow(dealt, pre_tokenise, BOUNDS))
    along = Window.partitionBy(*key).orderBy("chunk")
    meet = F.array_min(F.array_intersect("head", F.lag("tail").over(along)))
    met = chunks.select(*key, "chunk", F.when(c("chunk") == 0, 0).otherwise(meet).cast("long").alias("begin"))
    placed = met.withColumn("piece", F.max(F.when(c("begin").isNotNull(), c("chunk"))).over(along)).withColumn("sure", c("begin"))
    pieces = placed.where("sure is not null").select(*key, "piece", "begin", F.lead("begin").over(along).alias("end"))
    members = chunks.select(*key, "doc_id", "chunk", "text", "sizes").join(placed.select(*key, "chunk", "piece"), [*key, "chunk"])
    parts = members.groupBy(*key, "piece").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("chunk", "text", "sizes"))).alias("parts"))
    done = map_arrow(parts.join(pieces, [*key, "piece"]), encode_pieces, "file long, row long, doc_id long, piece int, ids array<int>")
    whole = done.groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    return whole.select("doc_id", F.flatten(F.transform("parts", lambda p: p.ids)).alias("ids"))


def encode(docs: DataFrame, tokenizer: str, pattern: str = PATTERN, work: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, and ids, an array of int."""
    work = work or Workspace(docs.sparkSession, "byte_bpe", LONG_ROWS)
    vocabulary = _vocabulary(docs, tokenizer)
    known, (file, row) = numbered(docs, work)
    texts = known.select(F.col(file).alias("file"), F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def encode_whole(batches):
        own = codec(vocabulary.value, pattern)
        for batch in batches:
            ids, first, n = [], 0, 0
            for text in batch.column("text").to_pylist():
                ids.append(own.ids(own.pre_tokens(text)))
                n += len(ids[-1])
                if n > RETURNED_TOGETHER:
                    yield _encoded(batch, ids, first)
                    first, ids, n = first + len(ids), [], 0
            yield _encoded(batch, ids, first)

    short = map_arrow(texts.where(F.length("text") <= CHUNK).select("doc_id", "text"), encode_whole, "doc_id long, ids array<int>")
    return short.unionByName(_long_texts(texts.where(F.length("text") > CHUNK), vocabulary, pattern, work))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``data`` to doc_id and ids: the bytes of the ids, one after the other."""
    vocabulary = _vocabulary(encoded, tokenizer)

    def join_bytes(batches):
        own = codec(vocabulary.value, PATTERN)
        for batch in batches:
            data, first, n = [], 0, 0
            for ids in batch.column("ids").to_pylist():
                data.append(own.bytes_of(ids or []))
                n += len(ids or [])
                if n > RETURNED_TOGETHER:
                    yield _decoded(batch, data, first)
                    first, data, n = first + len(data), [], 0
            yield _decoded(batch, data, first)

    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), join_bytes, "doc_id long, ids array<int>, data binary")


def _decoded(batch: pa.RecordBatch, data: list, first: int) -> pa.RecordBatch:
    rows = batch.slice(first, len(data))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    both = decode(encode(docs, tokenizer), tokenizer)
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said.cast("binary"), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
