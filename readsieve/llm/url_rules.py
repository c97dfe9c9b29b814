"""URL filters by a bit-parallel wildcard automaton.

A rule is a glob over the canonical form ``.host#path`` of a url: ``*`` is any run of characters,
``?`` any one; all else stands for itself.  The host is what follows the first ``://`` up to
``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path follows up to ``?``, ``#`` or the
end.  Neither holds a ``#``, so it separates them; the leading dot lets ``*.example.org#`` fit a
host and all its subdomains.

All rules run at once (Shift-And): each pattern of m tokens has m+1 bits, packed next to each
other into 64-bit words.  For each character the states move up one bit, carrying over from word
to word, and stay where that character's mask has a bit; states before a star stay as well.  The
bits move for a whole batch of urls at a time.

Edge cases: a null url, or one without ``://``, has an empty host and path, and its canonical form
is ``.#``; urls of any length are read whole; repeated rows give equal results; a null page_id is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
LOWER = {c: c + 32 for c in range(65, 91)}
#: Characters of urls that move together: bounds a worker's memory.
TOGETHER = 2_000_000


class Rule(NamedTuple):
    """A host with all its subdomains, and what the path starts with."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}#{self.path}*"


# The rules by host and path that the query is asked for.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: What decides where no rule fits: urls that one of these globs fits are blocked, all others allowed.
BLOCKED = ("*.*casino*#*", "*.*free-bets*#*", "*.*bets.*#*", "*.*adult*#*", "*.*spam*#*", "*.*porn*#*", "*.*#*/casino/*", "*.*#*/adult/*")


class Automaton:
    """All globs as masks of one row of bits."""

    def __init__(self, globs: tuple[str, ...]):
        tokens: list[list[str]] = []
        stars: list[set[int]] = []
        for glob in globs:
            own, loop = [], set()
            for c in glob:
                if c == "*":
                    loop.add(len(own))
                else:
                    own.append(c)
            tokens.append(own)
            stars.append(loop)
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for t in tokens for c in t if c != "?"}))}
        bits = sum(len(t) + 1 for t in tokens)
        self.words = max(1, -(-bits // 64))
        self.start, self.stay = (np.zeros(self.words, np.uint64) for _ in range(2))
        self.move = np.zeros((len(self.alphabet) + 1, self.words), np.uint64)  # by character; 0: one in no glob
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for own, loop in zip(tokens, stars):
            self.start[at // 64] |= self._bit(at)
            for i in loop:
                self.stay[(at + i) // 64] |= self._bit(at + i)
            for i, c in enumerate(own, at + 1):
                self.move[slice(None) if c == "?" else self.alphabet[c], i // 64] |= self._bit(i)
            at += len(own)
            self.final.append((at // 64, self._bit(at)))
            at += 1

    @staticmethod
    def _bit(i: int) -> np.uint64:
        return np.uint64(1 << (i % 64))

    def _run(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """codes: a row of characters per string, padded; strings by descending length."""
        state = np.tile(self.start, (len(codes), 1))
        live = len(codes)
        for p in range(codes.shape[1]):
            while live and lengths[live - 1] <= p:
                live -= 1
            now = state[:live]
            up = now << np.uint64(1)
            up[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (up & self.move[codes[:live, p]]) | (now & self.stay)
        return np.stack([state[:, word] & bit != 0 for word, bit in self.final], axis=1)

    def fits(self, strings: list[str]) -> np.ndarray:
        """Which glob fits which string: a row per string."""
        out = np.zeros((len(strings), len(self.final)), dtype=bool)
        length = np.array([len(s) for s in strings], dtype=np.int64)
        order, at = np.argsort(-length, kind="stable"), 0
        while at < len(order):
            most = int(length[order[at]])
            rows = order[at : at + max(1, TOGETHER // max(1, most))]
            codes = np.zeros((len(rows), most), dtype=np.int32)
            for i, r in enumerate(rows.tolist()):
                codes[i, : length[r]] = [self.alphabet.get(c, 0) for c in strings[r]]
            out[rows] = self._run(codes, length[rows])
            at += len(rows)
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """Host and path."""
    found = SPLIT.search(url) if url else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """page_id, host, path, rule, verdict, and the blocking glob if it was that which decided.

    Of the rules that fit, the longest decides; of equally long ones a blocking one, else the first.
    """
    best_first = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block"))

    def judged(batches):
        automaton = Automaton((*(r.glob for r in best_first), *blocked))
        for batch in batches:
            parts = [canonical(u) for u in batch.column("url").to_pylist()]
            fits = automaton.fits([f".{host}#{path}" for host, path in parts])
            n = len(best_first)
            rule = [best_first[x.argmax()] if x.any() else None for x in fits[:, :n]]
            glob = [blocked[x.argmax()] if r is None and x.any() else None for r, x in zip(rule, fits[:, n:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([r and r.name for r in rule], pa.string()),
                    pa.array([r.verdict if r else "block" if g else "allow" for r, g in zip(rule, glob)], pa.string()),
                    pa.array(glob, pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict", "pattern"],
            )

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), judged, "page_id long, host string, path string, rule string, verdict string, pattern string")


def _like_sql() -> str:
    fits = lambda r: f"((host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}'))"
    best_first = sorted(RULES, key=lambda r: (-len(r.name), r.verdict != "block"))
    like = lambda g: g.replace("*", "%")
    return f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
named AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
         CASE {' '.join(f"WHEN {fits(r)} THEN '{r.name}'" for r in best_first)} END AS rule
  FROM parts),
globbed AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
                 {' '.join(f"WHEN '.' || host || '#' || path LIKE '{like(g)}' THEN '{g}'" for g in BLOCKED)} END AS pattern
  FROM named)
SELECT page_id, host, path, rule,
       CASE {' '.join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in RULES)} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       pattern
FROM globbed"""


ORACLE_SQL = _like_sql()
