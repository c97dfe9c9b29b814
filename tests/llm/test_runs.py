"""Runs of repeated words against their definition, by trying all periods at all places."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from readsieve.llm import runs

from ..oracles import assert_same
from .data import frame, odd_documents, small, words


def brute(w):
    smallest = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(12, 2 * q):
                smallest.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, q) for (s, e), q in smallest.items())


def random_words(rng):
    kinds, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 5, 11, 12, 13, 30, 100, 300])
    w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    if n > 20 and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(2, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize(("together", "pairs"), [(1, 10), (200, 500_000), (200_000, 50), (200_000, 500_000)])
def test_runs_equal_brute_force(monkeypatch, together, pairs):
    monkeypatch.setattr(runs, "WORDS_TOGETHER", together)
    monkeypatch.setattr(runs, "PAIRS_TOGETHER", pairs)
    rng = random.Random(together + pairs)
    for _ in range(60):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 12))]
        for w, found in zip(texts, runs.runs_of(texts)):
            assert list(map(tuple, found.tolist())) == brute(w)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_many_overlapping_runs():
    texts = [list(fibonacci(900)), list(fibonacci(31)), ["x"] * 700, list("aab" * 40 + "aac" * 40), list("ab" * 6), list("ab" * 5 + "a")]
    texts = [[c.encode() for c in t] for t in texts]
    for w, found in zip(texts, runs.runs_of(texts)):
        assert list(map(tuple, found.tolist())) == brute(w)
    assert len(runs.runs_of(texts)[0]) > 20 and len(runs.runs_of(texts)[5]) == 0


def test_grammar_answers_are_exact():
    rng = np.random.default_rng(5)
    for kinds in (1, 2, 6):
        w = np.concatenate([[90], np.tile(rng.integers(0, kinds, 37), 9), [91], np.zeros(50, int), rng.integers(0, kinds, 200), [92]])
        levels = runs.grammar(w, 2)
        assert len(levels) > (1 if kinds == 1 else 3) and len(levels[-1].symbols) < 30
        ends = np.flatnonzero(w >= 90)
        i = rng.integers(1, len(w) - 1, 400)
        j = rng.integers(1, len(w) - 1, 400)
        keep = (i < j) & ~np.isin(i, ends) & ~np.isin(j, ends)
        i, j = i[keep].astype(np.int32), j[keep].astype(np.int32)
        on, back = runs.agreement(levels, i, j), runs.agreement(levels, i, j, back=True)
        for a, b, forth, rear in zip(i, j, on, back):
            want = next(k for k in range(len(w)) if w[a + k] != w[b + k])
            assert forth == want
            assert rear == next(k for k in range(len(w)) if w[a - k] != w[b - k])


def with_repeats(doc, text):
    w = words(text)
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def expected(doc, text):
    w = with_repeats(doc, text)
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(((-n, s, q) for s, n, q in found), default=None)
    told = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return doc, len(found), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def rows():
    rng = random.Random(2)
    out = [r for r in odd_documents() if r[0] != 7] + [(7, " ".join(rng.choice("abc") for _ in range(2500)), None, None, None)]
    out += [(2000 + i, " \n".join(x.decode() for x in random_words(rng)), None, None, None) for i in range(200)]
    return out + [(9000 + r[0], *r[1:]) for r in small(columns="doc_id, text, lang, source, n_chars") if len(r[1]) < 20_000]


def test_report_equals_brute_force(spark):
    given = rows()
    out = runs.report(frame(spark, given).repartition(3)).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(repr(expected(*r[:2])) for r in given)


def test_report_equals_sql(spark):
    given = [r for i, r in enumerate(rows()) if r[0] is not None and r[0] != 2]  # the SQL takes doc_id for unique
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in given])
    assert assert_same(runs.report(frame(spark, given)), runs.ORACLE_SQL, con) == len(given)


def test_find_runs(spark):
    text = "intro " + "Home About Contact " * 5 + "outro"
    r = runs.find_runs(frame(spark, [(1, text, None, None, None)])).first()
    assert (r["n"], r["collapsed"]) == (17, "intro Home About Contact outro")
    assert [tuple(x) for x in r["runs"]] == [(1, 15, 3)]


def test_long_text_that_repeats(spark):
    text = "the same words again " * 60_000
    r = runs.find_runs(frame(spark, [(1, text, None, None, None)])).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 240_000, 4)] and r["collapsed"] == "the same words again"


def test_empty_table(spark):
    assert runs.report(frame(spark, [])).count() == 0
