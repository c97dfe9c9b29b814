"""Byte-level BPE against the library on whole texts, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from readsieve.llm import byte_bpe

from .data import frame, odd_documents, small

TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(TOKENIZER, "rb") as f:
        return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(f.read()), special_tokens={})


def odd_texts(n, seed, longest):
    rng = random.Random(seed)
    parts = ["a", "'s", "'re", "'", "word", " the", "  ", " \n", "\t", "1", "23", "é", "ß", "日本", "💥", "!", "...", "\x1c", "\xa0", " ", "<|endoftext|>", "-", "\r\n", "' s", "'ll"]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(longest)):
            text += rng.choice(parts) * rng.choice([1, 1, 1, 1, 2, 9])
        out.append(text)
    return out


def expected(library, doc, text):
    ids = library.encode_ordinary(text or "")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return doc, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def same(found, want):
    assert sorted(map(repr, found)) == sorted(map(repr, want))


def test_report_equals_library(spark, library):
    rows = odd_documents() + [(3000 + i, t, None, None, None) for i, t in enumerate(odd_texts(300, 1, 60))]
    rows += [(9000 + r[0], *r[1:]) for r in small(columns="doc_id, text, lang, source, n_chars")]
    out = byte_bpe.report(frame(spark, rows).repartition(3), TOKENIZER).collect()
    same([tuple(r) for r in out], [expected(library, *r[:2]) for r in rows])


@pytest.mark.parametrize(("size", "overlap"), [(40, 16), (64, 30), (200, 8)])
def test_overlapping_chunks_are_stitched(spark, library, monkeypatch, size, overlap):
    """Small chunks, so that nearly all texts are stitched, and runs longer than overlaps and chunks."""
    monkeypatch.setattr(byte_bpe, "CHUNK", size)
    monkeypatch.setattr(byte_bpe, "OVERLAP", overlap)
    texts = odd_texts(150, size, 120) + ["A" * n for n in (size, size + 1, 2 * size, 1000)] + [" " * 700 + "x", "x" + "\n" * 500 + " y", "it's " * 200, "ab" * 400 + " c" * 300, "!" * 300 + "'s" * 300, "word " * 100 + "é" * 500 + " word" * 100]
    rows = [(i // 2, t, None, None, None) for i, t in enumerate(texts)]  # two rows of each doc_id
    out = byte_bpe.report(frame(spark, rows).repartition(3), TOKENIZER).collect()
    same([tuple(r) for r in out], [expected(library, *r[:2]) for r in rows])


def test_long_texts(spark, library, tmp_path):
    """At the real chunk size, from Parquet files; nearly all within one table of a single file."""
    rng = random.Random(4)
    words = ["the", "Lyestion", "naïve", "42", "it's", "\n\n", "日本語", "--"]
    prose = " ".join(rng.choice(words) for _ in range(120_000))
    rows = [(1, prose, None, None, None), (2, prose[: byte_bpe.CHUNK], None, None, None), (3, prose[: byte_bpe.CHUNK + 1], None, None, None), (4, "z" * 200_000 + prose[:70_000], None, None, None), (5, None, None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/docs")
    out = byte_bpe.report(spark.read.parquet(f"{tmp_path}/docs"), TOKENIZER).collect()
    same([tuple(r) for r in out], [expected(library, *r[:2]) for r in rows])


def test_decode(spark):
    df = spark.createDataFrame([(1, [31373, 995]), (2, []), (3, None), (4, [50256]), (5, [128])], "doc_id long, ids array<int>")
    out = {r["doc_id"]: r["data"] for r in byte_bpe.decode(df, TOKENIZER).collect()}
    assert bytes(out[1]) == b"hello world" and bytes(out[2]) == bytes(out[3]) == b"" and out[4] is None and len(out[5]) == 1


def test_empty_table(spark):
    assert byte_bpe.report(frame(spark, []), TOKENIZER).count() == 0


def test_other_vocabularies(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(f.read()), special_tokens={})
    texts = odd_texts(40, 8, 40)
    out = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), path).collect()}
    assert [list(out[i]) for i in range(len(texts))] == [whole.encode_ordinary(t) for t in texts]


def test_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    with open(TOKENIZER, "rb") as f:
        codec = byte_bpe.Codec(f.read())
    for text in odd_texts(30, 2, 80):
        assert codec.ids(codec.pre_tokens(text)).tolist() == library.encode_ordinary(text)
        assert len(codec.known) <= 10
