"""Fill-in-the-middle against its definition, and the chunks that it counts by."""

import hashlib
import random
import re

import duckdb
import pytest

from readsieve.llm import fim

from ..oracles import assert_same
from .data import frame, odd_documents, small


def cases():
    rng = random.Random(3)
    pieces = ["\n", "a", "é", "💥", "line of words ", "<P", ">", "<", "S>", "\r", "\t", "\n\n"]
    rows = [(3000 + i, "".join(rng.choice(pieces) for _ in range(rng.randrange(60))), None, None, None) for i in range(300)]
    rows += [(4000, "x" * 63 + "<" + "P>", None, None, None), (4001, "ends\n", None, None, None), (4002, "\n" * 50_000, None, None, None), (4003, "é" * 40_000, None, None, None)]
    rows += [(4010 + i, "".join(f"row {j} of {i % 2}\n" for j in range(9000)), None, None, None) for i in range(4)]
    return rows


def expected(doc, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc, n, "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 50:
        return doc, n, "spm", len(prefix), len(middle), sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text)
    return doc, n, "psm", len(prefix), len(middle), sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text)


def same(found, want):
    assert sorted(map(repr, found)) == sorted(map(repr, want))


def test_report_equals_definition(spark):
    rows = odd_documents() + cases() + [(9000 + r[0], *r[1:]) for r in small(columns="doc_id, text, lang, source, n_chars")]
    out = fim.report(frame(spark, rows).repartition(3)).collect()
    same([tuple(r) for r in out], [expected(*r[:2]) for r in rows])
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_report_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = [r for r in odd_documents() + cases() if r[0] != 4002]
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert assert_same(fim.report(frame(spark, rows)), fim.ORACLE_SQL, con) == len(rows)


def test_transform_keeps_the_text(spark):
    df = frame(spark, [(i, f"a{i}\nb\nc<\n>d", None, None, None) for i in range(40)] + [(99, "has <M> in it", None, None, None)])
    done = fim.transform(df, seed=3, rate=50, suffix_first=100)
    out = {r["doc_id"]: r for r in done.withColumn("back", fim.restored(done["text"], done["form"])).collect()}
    assert all(r["back"] == (f"a{i}\nb\nc<\n>d" if i < 99 else "has <M> in it") for i, r in out.items())
    assert {r["form"] for r in out.values()} == {"plain", "spm"}
    assert all(len(r["text"]) == len(r["back"]) + 9 * (r["form"] == "spm") for r in out.values())


def test_empty_table(spark):
    assert fim.report(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [fim.HASHED_TOGETHER, 5000])
def test_chunks_follow_content(monkeypatch, block):
    monkeypatch.setattr(fim, "HASHED_TOGETHER", block)
    rng = random.Random(1)
    prose = lambda n: "".join(rng.choice("abcdé fgh\n💥") for _ in range(n))
    shared = prose(60_000)
    texts = [(prose(rng.randrange(5000)) + shared + prose(900)).encode() for _ in range(3)] + [b"", b"x", b"y" * 100_000, ("é" * 50_000).encode()]
    cut = []
    for data in texts:
        ends = fim.chunk_ends(data)
        cut.append([data[a:b] for a, b in zip([0, *ends], ends)])
        assert b"".join(cut[-1]) == data and all(0 < len(c) <= fim.MOST_CHUNK for c in cut[-1])
        assert [c.decode() for c in cut[-1]] is not None  # no character is split
    if block > len(shared):
        assert len(set(cut[0]) & set(cut[1]) & set(cut[2])) > 0.8 * len(cut[0])
    chunks = fim.Chunks()
    for data in texts:
        counted = fim.Counted(data, chunks)
        lines = re.findall("[^\n]*\n|[^\n]+", data.decode())
        assert counted.units == len(lines)
        for k in sorted({0, len(lines), *(rng.randrange(len(lines) + 1) for _ in range(30))}):
            before = "".join(lines[:k])
            assert counted.after(k) == (len(before.encode()), len(before))
    assert chunks.remembered > 0.4 * chunks.asked if block > len(shared) else True


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(fim, "REMEMBERED_BYTES", 1000)
    chunks = fim.Chunks()
    for i in range(500):
        assert chunks.summary(b"%d\n" % i * 20).lines == 20
        assert chunks.held <= 1000 + 100 and sum(map(len, chunks.known)) == chunks.held
