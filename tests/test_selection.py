"""Exact quantiles of groups, by buffers and by digits."""

import math
import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from readsieve.operators import groups, ingest, selection
from readsieve.storage import Workspace

from .test_operators import rows

ODD = [0.0, -0.0, 1.0, -1.0, 1.5, 2.0, math.nextafter(2.0, 0), math.nextafter(2.0, 3), 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1e-300, 1e300, 0.1, 1 / 3, math.inf, -math.inf]


def test_ordered_bits(spark):
    rng = random.Random(1)
    values = ODD + [math.ldexp(rng.choice([1, -1]) * (1 + rng.random()), rng.randrange(-1074, 1023)) for _ in range(3000)] + [s * 2.0**e for e in range(-1074, 1024) for s in (1, -1)]
    values += [math.nextafter(2.0**e, 0) for e in range(-1000, 1024, 7)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", selection.ordered_bits(F.col("x")).alias("b"))
    for r in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r["x"])))[0]
        assert r["b"] == (-bits if r["x"] < 0 else bits), r
    last = spark.createDataFrame([(math.nan,)], "x double").select(selection.ordered_bits(F.col("x"))).first()[0]
    assert last > max(r["b"] for r in df.collect())


def data(seed, n=600):
    rng = random.Random(seed)
    kinds = {"odd": 101, "even": 100, "one": 1, "two": 2, "tied": 90, None: 40}
    out = []
    for k, size in kinds.items():
        out += [(k, float(rng.randrange(3)) if k == "tied" else rng.choice(ODD[:-2]) if rng.random() < 0.2 else rng.gauss(0, 100)) for _ in range(size)]
    return out + [("nulls", None), ("odd", None)]


@pytest.mark.parametrize("gathered", [0, 50, selection.GATHERED])
@pytest.mark.parametrize("share", [0.5, 0.0, 1.0, 0.37])
def test_quantiles_equal_sql(spark, monkeypatch, gathered, share):
    monkeypatch.setattr(selection, "GATHERED", gathered)
    given = data(int(share * 100))
    found = selection.quantiles(spark.createDataFrame(given, "k string, v double").repartition(3), ["k"], F.col("v"), share)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", given)
    want = dict(con.sql(f"SELECT k, quantile_cont(v, {share}) FROM t WHERE v IS NOT NULL GROUP BY k").fetchall())
    got = {r["k"]: r["quantile"] for r in found.collect()}
    assert got.keys() == want.keys() and "nulls" not in got
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-300) for k in want)


def test_empty(spark):
    assert selection.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], F.col("v"), 0.5).count() == 0


def test_a_group_with_millions_of_values(spark):
    """Beside small groups; no aggregate holds values of the large one."""
    n = 5_000_001
    df = spark.range(n).selectExpr("'hot' AS `group`", "CAST(id * 7919 % 5000001 AS DOUBLE) / 7 AS depth_mean", "1.0D AS avg_read_length", "0.0D AS stdev_read_length", "90.0D AS avg_identity", "1.0D AS stdev_identity")
    small = df.limit(5).withColumn("group", F.lit("small"))
    out = {r["group"]: r for r in groups.aggregate_groups(df.union(small)).collect()}
    assert out["hot"]["coverage_median"] == 2_500_000 / 7 and out["hot"]["n_genes"] == n
    assert out["small"]["coverage_median"] == pytest.approx(2 * 7919 / 7)


def test_digit_counts_are_bounded(spark, monkeypatch):
    """The tables between the passes have a row for each wanted rank, and values that share more and more digits."""
    saved = []
    work = Workspace(spark, "test")
    save = work.save
    monkeypatch.setattr(work, "save", lambda df, *a: saved.append(out := save(df, *a)) or out)
    monkeypatch.setattr(work, "drop", lambda df: None)
    monkeypatch.setattr(selection, "GATHERED", 1000)
    df = spark.range(200_000).selectExpr("'k' AS k", "sqrt(id) AS v")
    assert selection.quantiles(df, ["k"], F.col("v"), 0.25, work).first()["quantile"] == pytest.approx(0.25 * math.sqrt(49999) + 0.75 * math.sqrt(50000))
    sizes, *rest = [x.count() for x in saved]
    assert sizes == 1 and rest[0::2] == [2, 2, 2, 2]
    assert 200_000 > rest[1] > rest[3] >= rest[5] >= 2 and rest[3] < 20


def test_retention_of_a_large_reference(spark, monkeypatch):
    df = rows(spark, *({"queryId": f"q{i}", "subjectId": f"s{i % 2 * (i % 7)}", "subjectStart": i + 1, "eVal": 10.0 ** -(20 + i / 10)} for i in range(400)))
    kept = lambda: sorted((r["queryId"], r["subjectId"]) for r in ingest.retain_by_evalue(df, 0.3).collect())
    buffered = kept()
    monkeypatch.setattr(selection, "GATHERED", 40)
    assert kept() == buffered and 120 <= len(buffered) <= 130
