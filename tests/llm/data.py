"""Documents for the tests: a mix of edge cases, and some of the small table."""

import random

import duckdb

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def small(table="documents", columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{SMALL}/{table}.parquet'").fetchall()


def odd_documents():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = [f"wort{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    rows = [(1, base), (2, base), (2, base), (3, base + " end"), (4, None), (5, ""), (6, " \t\n"), (7, prose(20_000)), (8, "one"), (9, "one two"), (10, "é ñ 💥 ü x"), (None, base), (None, None)]
    rows += [(20 + i, prose(rng.randrange(1, 80))) for i in range(30)]
    rows += [(60 + i, prose(5) + " " + base[: rng.randrange(100, len(base))] + "\n" + prose(5)) for i in range(10)]
    rows += [(200, "A" * 50_000), (201, "\u0001\u0002\u0003   x"), (-5, base.upper())]
    lang = ["en", "de", None]
    return [(d, t, lang[i % 3], None if i % 4 else f"s{i}", None if t is None else len(t)) for i, (d, t) in enumerate(rows)]


def frame(spark, rows=None):
    """With columns whose names some operators use themselves."""
    df = spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "source AS rank", "n_chars AS score", "lang AS page", "lang AS component", "lang AS fp", "1 AS piece", "lang AS pii")


def words(text):
    """Words by their definition, one character at a time."""
    out, now = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out, now = out + [now] * bool(now), ""
        else:
            now += c
    return out + [now] * bool(now)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
