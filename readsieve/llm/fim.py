"""Fill-in-the-middle: documents are cut into prefix, middle and suffix and put together anew.

Units are lines.  Where a document is cut follows from its doc_id alone, so a rerun gives the same.
To find a cut, a document's units need counting, and its text a look for the markers:

1. A rolling hash of the last 32 bytes cuts each text into chunks by its content: a passage that
   several documents share gives the same chunks in all of them, wherever it stands.
2. A chunk's summary (code points, line ends, whether it holds a marker, and the bytes at its ends, in
   which a marker may begin that the next chunk ends) is found once and remembered by the chunk's
   content; a chunk that comes again is compared byte by byte, so the hash decides nothing but the cuts.
3. The summaries' running totals say in which chunk a unit ends; only that chunk is searched.

All is within the task that reads a document: nothing is shuffled, whatever repeats how often.  What
a worker remembers is bounded by ``REMEMBERED_BYTES``; beyond that it begins anew.

Edge cases: a null text counts as empty; an empty text, and one that holds a marker, stays as it is
(form ``plain``); so do the texts that the rate leaves out.  Prefix, middle or suffix may be empty.  A null
doc_id is taken for empty text.  Repeated rows give equal rows; very long texts are hashed in blocks; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, text_bytes

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
MARKER_BYTES = tuple(m.encode() for m in MARKERS)
SEED = 7
#: Of a hundred documents, so many are rearranged, and of these so many with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: A cut follows where the hash of the last bytes is below 2^32 / MEAN_CHUNK; chunks have so many bytes at least and at most.
MEAN_CHUNK, LEAST_CHUNK, MOST_CHUNK = 2048, 64, 16_384
HASHED_BYTES = 32
HASHED_TOGETHER = 4_000_000
REMEMBERED_BYTES = 32_000_000
#: A batch of results has about so many bytes.
RETURNED_TOGETHER = 16_000_000
GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
FORMS = "doc_id long, text string, form string, n long, prefix_chars long, middle_chars long"


def _starts_inside(data: bytes, at: int) -> bool:
    """Whether a cut before this byte would split a character."""
    return at < len(data) and data[at] & 0xC0 == 0x80


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of a text end."""
    ends, last = [], 0
    for at in range(0, len(data), HASHED_TOGETHER):
        lead = min(at, HASHED_BYTES - 1)
        h = GEAR[np.frombuffer(data, np.uint8, min(HASHED_TOGETHER, len(data) - at) + lead, at - lead)]
        for shift in (1, 2, 4, 8, 16):  # from one byte to thirty-two
            h[shift:] += h[:-shift] << np.uint32(shift)
        here = np.flatnonzero(h[lead:] < (1 << 32) // MEAN_CHUNK) + (at + 1)
        for end in [*here.tolist(), min(len(data), at + HASHED_TOGETHER)]:
            while end - last > MOST_CHUNK:
                last += MOST_CHUNK
                while _starts_inside(data, last):
                    last -= 1
                ends.append(last)
            if end == len(data) or end - last >= LEAST_CHUNK and end < at + HASHED_TOGETHER and not _starts_inside(data, end):
                ends.append(end)
                last = end
    return ends


class Summary(NamedTuple):
    """Of a stretch of text."""

    chars: int
    lines: int
    marked: bool
    head: bytes
    tail: bytes


class Chunks:
    """Summaries by content."""

    def __init__(self):
        self.known: dict[bytes, Summary] = {}
        self.held = self.asked = self.remembered = 0

    def summary(self, chunk: bytes) -> Summary:
        self.asked += 1
        found = self.known.get(chunk)
        if found is not None:
            self.remembered += 1
            return found
        if self.held > REMEMBERED_BYTES:
            self.known, self.held = {}, 0
        found = Summary(len(chunk.decode()), chunk.count(b"\n"), any(m in chunk for m in MARKER_BYTES), chunk[:2], chunk[-2:])
        self.known[chunk] = found
        self.held += len(chunk)
        return found


class Counted:
    """A text's chunks with the totals before each of them."""

    def __init__(self, data: bytes, chunks: Chunks):
        self.data, self.starts, self.chars, self.lines, self.marked = data, [0], [0], [0], False
        tail = b""
        for end in chunk_ends(data):
            s = chunks.summary(data[self.starts[-1] : end])
            self.marked = self.marked or s.marked or any(m in tail + s.head for m in MARKER_BYTES)
            tail = (tail + s.tail)[-2:]
            self.starts.append(end)
            self.chars.append(self.chars[-1] + s.chars)
            self.lines.append(self.lines[-1] + s.lines)
        self.units = self.lines[-1] + (bool(data) and not data.endswith(b"\n"))

    def after(self, unit: int) -> tuple[int, int]:
        """Bytes and code points up to the end of so many units."""
        if unit > self.lines[-1]:
            return len(self.data), self.chars[-1]
        k = bisect.bisect_left(self.lines, unit)  # the least k whose total has the unit: it ends in chunk k-1
        if k == 0:
            return 0, 0
        at = self.starts[k - 1]
        for _ in range(unit - self.lines[k - 1]):
            at = self.data.index(b"\n", at) + 1
        return at, self.chars[k - 1] + len(self.data[self.starts[k - 1] : at].decode())


def rearranged(data: bytes, draws: list[int], chunks: Chunks, rate: int, suffix_first: int) -> tuple:
    """text, form, n, prefix_chars, middle_chars."""
    counted = Counted(data, chunks)
    n = counted.units
    if not data or counted.marked or draws[2] % 100 >= rate:
        return data, "plain", n, None, None
    (a, before), (b, until) = (counted.after(k) for k in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = MARKER_BYTES
    if draws[3] % 100 < suffix_first:
        return b"".join((s, suffix, p, prefix, m, middle)), "spm", n, before, until - before
    return b"".join((p, prefix, s, suffix, m, middle)), "psm", n, before, until - before


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, text, form, *numbers = (list(c) for c in zip(*rows))
    arrays = [pa.array(doc, pa.int64()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(form, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "form", "n", "prefix_chars", "middle_chars"])


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per document: doc_id, text (rearranged), form (psm, spm or plain), n (its units), prefix_chars, middle_chars."""

    def rearrange(batches):
        chunks = Chunks()
        for batch in batches:
            rows, size = [], 0
            for doc, drawn, data in zip(batch.column("doc_id").to_pylist(), batch.column("drawn").to_pylist(), text_bytes(batch.column("text"))):
                draws = [int(drawn[i : i + 8], 16) for i in range(0, 32, 8)]
                rows.append((doc, *rearranged(data or b"", draws, chunks, rate, suffix_first)))
                size += len(rows[-1][1])
                if size > RETURNED_TOGETHER:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return map_arrow(id_and_text(docs, F.sha2(named.cast("binary"), 256).alias("drawn")), rearrange, FORMS)


def restored(text, form):
    """The text that a rearranged one came from: columns in, column out. A marker's first place is always the right one."""
    inner = lambda x, skip: F.substr(x, F.lit(skip + 1))
    after = lambda x, found: F.substr(x, F.length(found) + F.lit(len(PREFIX) + 1))
    rest = inner(text, len(PREFIX))
    first = F.substring_index(rest, SUFFIX, 1)
    psm_rest = after(rest, first)
    psm = F.concat(first, after(psm_rest, F.substring_index(psm_rest, MIDDLE, 1)), F.substring_index(psm_rest, MIDDLE, 1))
    last = F.substring_index(rest, PREFIX, 1)
    spm_rest = after(rest, last)
    spm = F.concat(F.substring_index(spm_rest, MIDDLE, 1), after(spm_rest, F.substring_index(spm_rest, MIDDLE, 1)), last)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    done = transform(docs)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("text")).alias("output_sha256"), digest(restored(F.col("text"), F.col("form"))).alias("restored_sha256")
    )


ORACLE_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (SELECT *, len(units) AS n, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || h[8*i+1 : 8*i+8] AS BIGINT)) AS d FROM drawn),
cuts AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a+1:b], '') AS middle, array_to_string(units[b+1:], '') AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""
