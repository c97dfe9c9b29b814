import collections
import math
import random

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readsieve.operators import coverage, groups, membership, resolve, stats
from readsieve.operators.filters import FILTERS, apply_filters, parse_filters, validate_filters
from readsieve.operators.ingest import _told_apart, analytic_columns, drop_duplicates, threshold_filter
from readsieve.plans import oracle, pipeline
from readsieve.storage import Workspace
from readsieve.schema import ALIGNMENT


def rows(spark, *given, **more):
    """Rows of an alignment table; what is not given has a default."""
    base = dict(queryId="q", subjectId="s", percIdentity=95.0, alnLength=10, mismatchCount=0, gapOpenCount=0, queryStart=1, queryEnd=30, subjectStart=1, subjectEnd=10, eVal=1e-20, bitScore=70.0, qlen=30, slen=100)
    return spark.createDataFrame([tuple({**base, **more, **g}[f.name] for f in ALIGNMENT.fields) for g in given], ALIGNMENT)


@pytest.mark.parametrize(
    ("slen", "spans", "aln", "expected"),
    [
        (20, [(5, 9)], 5, (0, 0, 0, 0, 0, None)),
        (15, [(5, 9)], 5, (4, 4, 0.266667, 0.266667, 0.442217, 1.658312)),
        (100, [(20, 49), (50, 79)], 30, (19, 19, 0.19, 0.19, 0.392301, 2.064742)),
        (12, [(1, 12)], 12, (10, 10, 0.833333, 0.833333, 0.372678, 0.447214)),
    ],
)
def test_coverage_fixtures(spark, slen, spans, aln, expected):
    df = rows(spark, *({"subjectStart": a, "subjectEnd": b, "queryId": f"q{a}"} for a, b in spans), slen=slen, alnLength=aln)
    r = stats.reference_stats(df).first()
    found = [r["total_covered_bases"], r["total_depth"], r["breadth"], r["mean_coverage"], r["std_coverage"], r["depth_evenness"]]
    assert [x if x is None else round(x, 6) for x in found] == list(expected)
    assert r["avg_depth"] == (1 if expected[0] else 0)


def by_positions(data, trim=True):
    """Depth at each position, one by one."""
    out = {}
    for subject in {d["subjectId"] for d in data}:
        own = [d for d in data if d["subjectId"] == subject]
        length = max(d["slen"] for d in own)
        depth = [0] * length
        for d in own:
            a, b = d["subjectStart"], min(d["subjectEnd"], length - 1)
            for p in range(min(a, b), max(a, b)):
                if p < length:
                    depth[p] += 1 if a < b else -1
        t = math.ceil(sum(d["alnLength"] for d in own) / len(own)) + 10
        if trim and t < length:
            depth = [0 if p < t or p >= length - t else x for p, x in enumerate(depth)]
        mean = sum(depth) / length
        out[subject] = (sum(1 for x in depth if x), sum(depth), math.sqrt(max(0, sum(x * x for x in depth) / length - mean * mean)))
    return out


@pytest.mark.parametrize("trim", [True, False])
def test_segments_equal_positions(spark, trim):
    rng = random.Random(3)
    data = []
    for i in range(300):
        a = rng.randrange(1, 90)
        data.append({"queryId": f"q{i}", "subjectId": f"s{rng.randrange(12)}", "subjectStart": a, "subjectEnd": max(1, a + rng.randrange(-5, 30)), "alnLength": rng.randrange(5, 30), "slen": 95})
    found = {r["subjectId"]: r for r in stats.reference_stats(rows(spark, *data), trim).collect()}
    for subject, (covered, total, std) in by_positions(data, trim).items():
        assert (found[subject]["total_covered_bases"], found[subject]["total_depth"]) == (covered, total)
        assert found[subject]["std_coverage"] == pytest.approx(std)


def test_segments_do_not_depend_on_length(spark):
    df = rows(spark, {"subjectStart": 5, "subjectEnd": 9}, slen=2_000_000_000)
    assert coverage.segments(df, stats.alignment_stats(df)).count() == 2


@pytest.mark.parametrize("block", [1, 7, 64])
@pytest.mark.parametrize("trim", [True, False])
def test_blocks_of_a_reference(spark, monkeypatch, block, trim):
    rng = random.Random(block)
    data = [{"queryId": f"q{i}", "subjectId": f"s{rng.randrange(6)}", "subjectStart": (a := rng.randrange(1, 110)), "subjectEnd": max(1, a + rng.randrange(-5, 40)), "alnLength": rng.randrange(5, 30), "slen": 95} for i in range(150)]
    data += [{"subjectId": "empty", "subjectStart": 150, "subjectEnd": 160, "slen": 95}, {"subjectId": "short", "subjectStart": 1, "subjectEnd": 4, "slen": 5}]
    df = rows(spark, *data)
    key = lambda x: sorted(map(repr, x.collect()))
    own = stats.alignment_stats(df)
    at_once = key(coverage.segments(df, own)), key(stats.reference_stats(df, trim))
    monkeypatch.setattr(coverage, "BLOCK", block)
    assert (key(coverage.segments(df, own)), key(stats.reference_stats(df, trim))) == at_once


def test_a_long_reference_is_the_work_of_many_tasks(spark):
    """Half a million changes of one reference; no window is over all of them."""
    n, length = 250_000, 300_000_000
    place = lambda c: f"CAST({c} AS INT)"
    df = spark.range(n).selectExpr("'q' || id AS queryId", "'chr' AS subjectId", "95.0D AS percIdentity", "100 AS alnLength", f"{place('1 + id * 1200')} AS subjectStart", f"{place('1 + id * 1200 + 600')} AS subjectEnd", "100 AS qlen", f"{length} AS slen")
    segments = coverage.segments(df, stats.alignment_stats(df))
    counts = segments.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert sum(r["count"] for r in counts) == 2 * n and len(counts) > 1
    r = stats.reference_stats(df, trim=False).first()
    assert (r["total_depth"], r["total_covered_bases"], r["breadth"]) == (600 * n, 600 * n, 0.5)


def test_start_beyond_the_reference(spark):
    r = stats.reference_stats(rows(spark, {"subjectStart": 150, "subjectEnd": 160}, slen=100), trim=False).first()
    assert (r["total_covered_bases"], r["total_depth"]) == (0, 0)
    both = rows(spark, {"subjectStart": 150, "subjectEnd": 160}, {"subjectStart": 90, "subjectEnd": 160, "queryId": "r"}, slen=100)
    r = stats.reference_stats(both, trim=False).first()
    assert (r["total_covered_bases"], r["total_depth"]) == (9, 9)


RESOLVER = {
    "shares": ([("r1", "A", 90), ("r1", "B", 60), ("r2", "A", 90)], [("r1", "B"), ("r2", "A")]),
    "tie": ([("r1", "A", 70), ("r1", "B", 70)], [("r1", "A"), ("r1", "B")]),
    "idle": ([("r1", "A", 100), ("r1", "B", 96), ("rX", "B", 4)], [("r1", "A"), ("r1", "B"), ("rX", "B")]),
    "kept_alive": (
        [("r1", "A", 100), ("r1", "B", 96), ("rX", "B", 4), ("r2", "C", 100), ("r2", "D", 50), ("r3", "D", 50)],
        [("r1", "A"), ("r2", "C"), ("r3", "D"), ("rX", "B")],
    ),
}


@pytest.mark.parametrize("form", [resolve.resolve, resolve.resolve_stepwise])
@pytest.mark.parametrize("case", RESOLVER)
def test_resolver_fixtures(spark, form, case):
    data, expected = RESOLVER[case]
    df = rows(spark, *({"queryId": q, "subjectId": s, "bitScore": float(b)} for q, s, b in data))
    assert sorted((r["queryId"], r["subjectId"]) for r in form(df).collect()) == expected


def random_hits(seed, n=400):
    rng = random.Random(seed)
    return [{"queryId": f"r{rng.randrange(n // 4)}", "subjectId": f"s{rng.randrange(20)}", "bitScore": rng.choice([40.0, 55.0, 60.0, 61.0, 70.0, 90.5]), "slen": 50 + 10 * rng.randrange(5), "subjectStart": i} for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_resolver_forms_agree(spark, monkeypatch, seed):
    df = rows(spark, *random_hits(seed))
    key = lambda x: sorted((r["queryId"], r["subjectId"], r["subjectStart"]) for r in x.collect())
    once = key(resolve.resolve(df))
    assert once == key(resolve.resolve_stepwise(df))
    assert {r[0] for r in once} == {r["queryId"] for r in df.collect()}
    monkeypatch.setattr(resolve, "GATHERED", 3)  # reads with more alignments take the iterative way
    assert once == key(resolve.resolve(df))
    assert once == key(resolve.resolve(df.repartition(7)))


def slow_hits(pairs):
    """Reads of two alignments each, the second of which goes in iteration 1, 2, ... and the last in ``pairs``."""
    hits = []
    for k in range(1, pairs + 1):
        # after k iterations the ratio is (1 - d)^(2^k); each reference has a score of its own that makes up the total
        d = 0.15 * 2.0**-k
        for s, score in (("a", 0.5), ("b", 0.5 * (1 - d))):
            hits += [{"queryId": f"r{k}", "subjectId": f"{s}{k}", "bitScore": score}, {"queryId": f"f{s}{k}", "subjectId": f"{s}{k}", "bitScore": 1 - score}]
    return hits


@pytest.mark.parametrize("gathered,n", [(10_000, 45), (1, 8)])
def test_many_iterations(spark, monkeypatch, gathered, n):
    df = rows(spark, *slow_hits(n))
    key = lambda x: sorted((r["queryId"], r["subjectId"]) for r in x.collect())
    steps = []
    step = resolve._step_apart
    monkeypatch.setattr(resolve, "_step_apart", lambda live, k, scale: steps.append(k) or step(live, k, scale))
    monkeypatch.setattr(resolve, "GATHERED", gathered)
    found = key(resolve.resolve(df, iterations=100_000))
    assert found == sorted([(f"r{k}", f"a{k}") for k in range(1, n + 1)] + [(f"f{s}{k}", f"{s}{k}") for k in range(1, n + 1) for s in "ab"])
    assert len(steps) == (n + 1 if gathered == 1 else 0)  # up to the stop
    if gathered > 1:
        stepwise = {k: key(resolve.resolve_stepwise(rows(spark, *slow_hits(4)), k)) for k in (2, 100_000)}
        assert stepwise == {k: key(resolve.resolve(rows(spark, *slow_hits(4)), k)) for k in stepwise}


def test_ties_up_to_rounding(spark):
    """Weights in the ratio of lengths that are near each other: equal but for rounding, so neither ever goes."""
    few = [{"queryId": f"r{i}", "subjectId": f"{s}{i}", "bitScore": 1.0 * n, "slen": n} for i in range(1, 40) for s, n in (("a", 100 + i), ("b", 101 + i))]
    # the other reads of each reference make its total the same
    fill = [{"queryId": f"f{s}{i}", "subjectId": f"{s}{i}", "bitScore": 1000.0 - n, "slen": n} for i in range(1, 40) for s, n in (("a", 100 + i), ("b", 101 + i))]
    slow = [h | {"queryId": "s" + h["queryId"], "subjectId": "s" + h["subjectId"]} for h in slow_hits(48)]
    kept = resolve.resolve(rows(spark, *few, *fill, *slow), iterations=1000)
    assert kept.where("queryId rlike '^r'").count() == len(few)


def test_resolver_zero_scores(spark):
    df = rows(spark, {"queryId": "a", "subjectId": "x", "bitScore": 0.0}, {"queryId": "a", "subjectId": "y", "bitScore": 5.0}, {"queryId": "b", "subjectId": "x", "bitScore": 0.0}, {"queryId": "b", "subjectId": "y", "bitScore": 5.0})
    for form in (resolve.resolve, resolve.resolve_stepwise):
        assert sorted((r["queryId"], r["subjectId"]) for r in form(df).collect()) == [("a", "y"), ("b", "y")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(1, 6)), min_size=1, max_size=25))
def test_resolver_properties(spark, data):
    df = rows(spark, *({"queryId": f"r{q}", "subjectId": f"s{s}", "bitScore": b * 10.0, "subjectStart": i} for i, (q, s, b) in enumerate(data)))
    kept = resolve.resolve(df).collect()
    assert {r["subjectStart"] for r in kept} <= set(range(len(data)))
    assert {r["queryId"] for r in kept} == {f"r{q}" for q, _, _ in data}


def test_scale_and_iterations_change_the_result(spark):
    df = rows(spark, *random_hits(7))
    count = lambda **o: pipeline.run(df, trim=False, **o).no_multimap.count()
    default, one, none = count(), count(iterations=1), count(scale=0.0)
    assert default < one < none == df.where("bitScore >= 60").count()


def test_best_alignments_only(spark):
    df = rows(spark, *({"queryId": f"q{i}", "subjectStart": i + 1, "eVal": 10.0 ** -(20 + i)} for i in range(10)))
    kept = pipeline.run(df, trim=False, retain=0.3).no_multimap
    assert {r["queryId"] for r in kept.collect()} == {"q7", "q8", "q9"}


def test_thresholds_are_inclusive(spark):
    df = rows(spark, {"eVal": 1e-10, "bitScore": 60.0}, {"eVal": 1.1e-10}, {"bitScore": 59.9}, {"eVal": None}, {"bitScore": None})
    assert threshold_filter(df).count() == 1


def test_first_duplicate_stays(spark):
    df = rows(spark, {"queryId": "q2"}, {"queryId": "q1"}, {"queryId": "q3", "subjectId": "t"}, {"queryId": "q3", "subjectId": "t"})
    place = F.when(F.col("queryId") == "q2", 0).when(F.col("queryId") == "q1", 1).otherwise(F.monotonically_increasing_id() + 2)
    assert sorted(r["queryId"] for r in drop_duplicates(df.withColumn("ordinal", place)).collect()) == ["q2", "q3"]
    assert sorted(r["queryId"] for r in drop_duplicates(df).collect()) == ["q1", "q3"]


@pytest.mark.parametrize("copies", [0, 25, 390])
@pytest.mark.parametrize("placed", [True, False])
def test_rows_without_copies_are_not_moved(spark, copies, placed):
    """Only those go to the aggregate whose hash may occur twice; results are those of the aggregate of all."""
    work = Workspace(spark, "unique")
    data = [{"queryId": f"q{i * 7 % 400}", "subjectId": f"s{i if i >= copies else i % 5}", "slen": None if i % 3 == 0 else 100} for i in range(400)]
    df = rows(spark, *data)
    df = work.save(analytic_columns(df.withColumn("ordinal", F.monotonically_increasing_id()) if placed else df))
    key = lambda x: sorted(map(repr, x.collect()))
    found = drop_duplicates(df, work)
    assert found.columns == df.columns and key(found) == key(drop_duplicates(df)) and (copies or len(key(found)) == 400)
    alone, rest = _told_apart(df, [c for c in df.columns if c not in ("queryId", "ordinal")], work)
    if copies == 390:
        assert alone is None and rest.count() == 400
    else:
        seen = collections.Counter((d["subjectId"], d["slen"]) for d in data)
        copied = sum(n for n in seen.values() if n > 1)
        assert copied <= rest.count() <= copied + 10 and alone.count() + rest.count() == 400
    # neither an exchange nor a sort of all rows: those stand above the filter
    if alone is not None:
        plan = alone._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Sort" not in plan


def test_the_resolver_moves_what_it_reads(spark):
    """Logarithms are taken after a read is gathered, and of the hashes one goes along."""
    weighted = resolve.initial_weights(rows(spark, *random_hits(3)))
    plan = resolve.removal_iterations(weighted.select("queryId", "slen", "p"), 5, 0.9)._jdf.queryExecution().optimizedPlan().toString()
    gathered = plan[plan.index("collect_list"):]
    assert "ln(" not in gathered.lower() and "log(" not in gathered.lower() and "collect_list(struct(slen" in gathered
    steps = pipeline.resolve_alignments(rows(spark, *random_hits(3)))
    assert steps.surviving.columns == ["queryId", "slen", "hash_a"] and "hash_b" not in steps.unique.columns


def test_bloom_filter(spark, monkeypatch):
    """No row that is among the keys is lost, and few of the others stay."""
    work = Workspace(spark, "bloom")
    df = work.save(spark.range(60_000).selectExpr("'q' || id AS q", "id * 7 AS n", "repeat('w', 10) AS wide"))
    keys = work.save(df.where("n % 10 = 0").select("q", "n"))
    assert membership.may_be_among(df, keys, work) is df  # so few keys are broadcast anyway
    monkeypatch.setattr(membership, "LEAST_KEYS", 0)
    near = membership.may_be_among(df, keys, work)
    assert near.columns == df.columns and near.join(keys, ["q", "n"], "left_semi").count() == keys.count() == 6000
    assert near.count() < 6000 + 0.03 * 54_000
    assert membership.may_be_among(df, keys.limit(0), work) is df and membership.may_be_among(keys, keys, work) is keys
    built = membership.bloom_filter(keys, 5)
    assert [(r["segment"], len(r["words"])) for r in built.orderBy("segment").collect()] == [(i, membership.SEGMENT_WORDS) for i in range(5)]
    assert sum(bin(w & (1 << 64) - 1).count("1") for r in built.collect() for w in r["words"]) > 2.9 * 6000
    null = spark.createDataFrame([(None, 1)], "q string, n long")
    assert membership.may_be_among(df.select("q", "n").union(null), keys, work).where("q is null").count() <= 1


def test_run_with_a_bloom_filter(spark, monkeypatch):
    df = rows(spark, *random_hits(5))
    once = sorted(map(repr, pipeline.run(df, trim=False, iterations=2).no_multimap.collect()))
    monkeypatch.setattr(membership, "LEAST_KEYS", 0)
    monkeypatch.setattr(membership, "MOST_SHARE", 1)
    assert sorted(map(repr, pipeline.run(df, trim=False, iterations=2).no_multimap.collect())) == once and once


def test_repeated_rows_come_back(spark):
    df = rows(spark, {"queryId": "q3"}, {"queryId": "q3"}, {"queryId": "q4", "subjectId": "t"})
    out = pipeline.run(df, trim=False)
    assert out.no_multimap.count() == 3
    assert {r["reference"]: r["n_alns"] for r in out.cov_stats.collect()} == {"s": 2, "t": 1}
    assert out.no_multimap.columns == df.columns


def test_keep_duplicates(spark):
    df = rows(spark, {"queryId": "q1"}, {"queryId": "q2"})
    count = lambda **o: pipeline.run(df, trim=False, **o).no_multimap.count()
    assert (count(), count(keep_duplicates=True)) == (1, 2)


def test_empty_stages(spark):
    df = rows(spark, {"eVal": 1.0})
    mapping = spark.createDataFrame([("s", "g")], "reference string, grp string")
    out = pipeline.run(df, mapping, filters={"breadth": 0.5})
    assert (out.cov_stats.count(), out.no_multimap.count(), out.gene_abundances) == (0, 0, None)


def test_filters(spark):
    df = stats.reference_stats(rows(spark, {"subjectStart": 1, "subjectEnd": 40}, {"subjectId": "empty", "subjectStart": 5, "subjectEnd": 5}), trim=False)
    assert [r["subjectId"] for r in apply_filters(df, {"depthEvenness": 100}).collect()] == ["s"]
    for name in FILTERS:
        apply_filters(df, {name: 0}).count()
    assert apply_filters(df, None).count() == 2
    assert parse_filters("breadth=0.5, nAlns=3") == {"breadth": 0.5, "nAlns": 3.0}
    assert parse_filters("") == {} == parse_filters(None)
    for bad in ({"nope": 1}, {"breadth": "x"}, {"breadth": -1}, {"breadth": "nan"}):
        with pytest.raises(ValueError):
            validate_filters(bad)
    with pytest.raises(ValueError):
        parse_filters("breadth")


def test_groups(spark):
    columns = "reference string, depth_mean double, avg_read_length double, stdev_read_length double, avg_identity double, stdev_identity double, breadth double"
    genes = spark.createDataFrame([("a", 2.0, 1.0, 0.0, 90.0, 1.0, 0.5), ("b", 4.0, 3.0, 0.0, 80.0, 1.0, 0.5)], columns)
    mapping = spark.createDataFrame([("a", "ko:K1;ko:K2"), ("a", "two"), ("b", "two"), ("z", "none")], "reference string, group string")
    joined = groups.join_mapping(genes, mapping)
    assert joined.columns[:2] == ["reference", "group"] and joined.count() == 3
    out = {r["group"]: r for r in groups.aggregate_groups(joined).collect()}
    assert out["ko:K1;ko:K2"]["coverage_stdev"] is None
    assert (out["two"]["coverage_median"], out["two"]["n_genes"], out["two"]["coverage_sum"]) == (3.0, 2, 6.0)
    assert {r["enzyme_accession"] for r in groups.to_anvio(joined).collect()} == {"K1;K2", "two"}


def test_read_multiplicity(spark):
    df = rows(spark, {"queryId": "a"}, {"queryId": "a"}, {"queryId": "b"})
    assert tuple(stats.read_multiplicity(df).first()) == (2, 1, 1, 3)


def test_a_weight_of_just_the_threshold(spark):
    """Lengths as 9 to 10: rounding decides, so the step must do the SQL's arithmetic."""
    pairs = [(share, length) for share in (1.0, 1 / 2, 1 / 3, 2 / 3, 3 / 4) for length in range(180, 541, 90)]
    given = [{"queryId": f"q{i}", "subjectId": f"s{i}-{slen}", "slen": slen} for i, (_, n) in enumerate(pairs) for slen in (n, n // 9 * 10)]
    shares = spark.createDataFrame([(f"q{i}", share) for i, (share, _) in enumerate(pairs)], "queryId string, p double")
    before = rows(spark, *given).join(shares, "queryId").select(*ALIGNMENT.names, "p")
    con = duckdb.connect()
    i_0 = before.toArrow()  # noqa: F841
    con.sql("CREATE TABLE i_0 AS SELECT * FROM i_0")
    steps = oracle.Steps()
    steps.iteration(1)
    want = con.sql(steps.select("SELECT queryId, subjectId, p FROM i_1")).fetchall()
    assert sorted(map(tuple, resolve.step(before).select("queryId", "subjectId", "p").collect())) == sorted(want)


def test_the_order_of_rows_decides_nothing(spark):
    """At weights of just the threshold the order in which a read's weights are added up may decide."""
    lengths = ([180, 200, 600, 500], [300, 270, 320, 590, 500], [500, 450, 380, 480], [450, 300, 270], [540, 600, 110, 350, 490, 230])
    tied = [(f"q{i}-{k}", n, 1 / (k + 3) if n in some[:2] or n in (270, 300) else 1 / (k + 3.5)) for i, some in enumerate(lengths) for k in range(40) for n in some]
    schema = "queryId string, slen int, p double"
    given = [sorted(tied, key=lambda x: (x[1] * a) % m) for a, m in ((1, 1000), (-1, 1000), (7, 19), (13, 29))]
    found = [sorted(map(tuple, resolve.step(spark.createDataFrame(x, schema).coalesce(n)).collect())) for x in given for n in (1, 4)]
    assert all(x == found[0] for x in found)
    # one of the orders in which the SQL may add
    want = []
    for read in dict.fromkeys(q for q, _, _ in tied):
        own = [(n, p * p / n) for q, n, p in tied if q == read]
        total = 0.0
        for x in sorted(x for _, x in own):
            total += x
        want += [(read, n, x / total) for n, x in own if x / total >= 0.9 * max(x / total for _, x in own)]
    assert found[0] == sorted(want)


def test_the_sweep_is_in_parts_that_follow_the_rows(spark, monkeypatch):
    """A task's share of the sweep stays as it is when there are more alignments; what is beyond a reference or missing counts at its end."""
    rng = random.Random(5)
    place = lambda: rng.choice([None, rng.randrange(1, 140)])
    data = [{"queryId": f"q{i}", "subjectId": f"s{i % 40}", "subjectStart": place(), "subjectEnd": place(), "slen": rng.choice([None, 90, 100])} for i in range(400)]
    df = rows(spark, *data, {"subjectId": None}, {"subjectId": "unknown", "slen": None, "subjectEnd": None})
    own = stats.alignment_stats(df)
    key = lambda x: sorted(map(repr, x.collect()))
    whole = key(coverage.segments(df, own)), key(stats.reference_stats(df, False))
    monkeypatch.setattr(coverage, "TASK_ROWS", 10)
    parts = coverage.segments(df, own)
    assert (key(parts), key(stats.reference_stats(df, False))) == whole
    assert parts.rdd.getNumPartitions() == 41
    monkeypatch.setattr(coverage, "BLOCK", 7)
    assert (key(coverage.segments(df, own)), key(stats.reference_stats(df, False))) == whole


def test_rows_are_moved_after_the_filter_of_survivors(spark, monkeypatch):
    """The join with the survivors stands above the Bloom filter; the optimizer moves a semi join below it."""
    monkeypatch.setattr(membership, "LEAST_KEYS", 0)
    monkeypatch.setattr(membership, "MOST_SHARE", 1)
    saved, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, *a, **b: saved.append(df) or save(self, df, *a, **b))
    data = [{"queryId": f"q{i // 2}", "subjectId": f"s{i % 3}", "subjectStart": 20 + i, "subjectEnd": 60 + i, "alnLength": 40} for i in range(30)]
    found = pipeline.resolve_alignments(rows(spark, *data)).rejoined
    plan = saved[-1]._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 2 and "hash_a" in joins[0] and "segment" in joins[1]
    assert 0 < found.count() <= 30


def test_only_reads_of_many_alignments_are_counted_apart(spark, monkeypatch):
    """Without such reads no row is joined to a count: weights given, a read's rows are moved once."""
    saved, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, *a, **b: saved.append(df) or save(self, df, *a, **b))
    data = [{"queryId": q, "subjectId": f"s{i}", "slen": 100 + i} for i, q in enumerate(["a", "a", "b", None])]
    weighted = Workspace(spark, "test").save(resolve.initial_weights(rows(spark, *data)))
    saved.clear()
    found = resolve.resolve(weighted)
    assert found.columns == ALIGNMENT.names and {r["queryId"] for r in found.collect()} == {"a", "b"}
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in saved]
    assert plans and not any("Join" in p for p in plans)
