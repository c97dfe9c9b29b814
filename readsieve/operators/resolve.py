"""Assigning reads that align to several references.

Weights start as the share of a score among all scores of its reference.  In each iteration a
weight becomes its square divided by the reference's length, normalised within the read; of a read's
alignments those below ``scale`` times the best go.  All stops at the first iteration that removes
nothing anywhere.

Within a read nothing depends on other reads but the time of that stop, and normalising does not
change which alignments go.  With a = ln(weight / length) and b = ln(length), the logarithm of the
weight after k iterations is 2^k a + b up to a constant of the read.  So each read is gathered
once, and the iteration in which each alignment would go is found for it at once; the stop is the
least iteration that no alignment of any read has.  Alignments that go after it stay.

What counts is an alignment's distance from the best, so a and b are taken relative to the best of the
iteration before.  There the distances of all that are left are small, so 2^k swamps nothing, whatever k is.
Two alignments whose weight / length agree up to ``TIE`` are tied: rounding can't tell them apart, and
the order in which scores were added up must not decide.  All others are ``TIE`` apart at least, and as distances
double, none can go after iteration ``LAST_REMOVAL``: there every run has stopped, so the number of
jobs does not follow ``iterations``.

Reads of more than ``GATHERED`` alignments are not gathered; for them each iteration up to the stop is an
aggregate and a join over what is left of them.  The stepwise form is what tests compare with.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace

SCALE, ITERATIONS = 0.9, 25
GATHERED = 10_000
#: Relative difference of weight / length up to which two alignments are tied.
TIE = 2.0**-50
#: 2^k TIE is then beyond the logarithm of any scale and of any two lengths' ratio (745 and 44 at most).
LAST_REMOVAL = 60


def initial_weights(alignments: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Adds ``p``: a score's share of all scores of its reference, null if these are all 0. Hot references are combined before the shuffle, and the join can be split.

    ``references``: only alignments to these, found by the same join.
    """
    totals = alignments.groupBy("subjectId").agg(F.sum("bitScore").alias("total"))
    if references is not None:
        totals = totals.join(references.select("subjectId"), "subjectId", "left_semi")
    return alignments.join(totals, "subjectId").withColumn("p", F.try_divide("bitScore", "total")).select(*alignments.columns, "p")


def _sums_in_order(raised: DataFrame) -> DataFrame:
    """(queryId, in_order): sums of x from the least on, for reads of three alignments and more; those of over ``GATHERED`` are not gathered."""
    gathered = raised.where(F.col("live").between(3, GATHERED)).groupBy("queryId").agg(F.sort_array(F.collect_list("x")).alias("all"))
    return gathered.select("queryId", F.aggregate("all", F.lit(0.0), lambda so_far, x: so_far + x).alias("in_order"))


def step(live: DataFrame, scale: float = SCALE) -> DataFrame:
    """One iteration over rows with p, n: new p, and n, the read's alignments before it; rows that go are left out.

    Normalised weights are compared, as the method says: where one is exactly ``scale`` times the best (equal shares, lengths
    as 9 to 10), rounding decides, and it falls otherwise for weights that are not normalised.  There the order of adding may
    decide as well, so weights are added from the least on: how rows are dealt out never tells which stay.
    """
    raised = live.withColumn("x", F.try_divide(F.col("p") * F.col("p"), F.col("slen")))
    per_read = raised.groupBy("queryId").agg(F.sum("x").alias("any_order"), F.max("x").alias("max_x"), F.count("*").alias("live"))
    raised = raised.join(per_read, "queryId")
    rows = raised.join(_sums_in_order(raised), "queryId", "left").withColumn("sum_x", F.coalesce("in_order", "any_order"))
    rows = rows.withColumn("p", F.try_divide("x", "sum_x"))
    # dividing keeps the order, so this is the greatest of the new p
    best = F.try_divide("max_x", "sum_x")
    kept = (F.col("live") == 1) | (F.col("p") >= best * scale) & (F.col("max_x") > 0)
    return rows.where(kept).select(*live.columns)


def resolve_stepwise(alignments: DataFrame, iterations: int = ITERATIONS, scale: float = SCALE, work: Workspace | None = None) -> DataFrame:
    """One iteration after the other; each is written to the shared folder."""
    work = work or Workspace(alignments.sparkSession, "resolve")
    live = work.save(initial_weights(alignments))
    before = live.count()
    for _ in range(iterations):
        after = work.save(step(live, scale))
        now = after.count()
        work.drop(live)
        live = after
        if now == before:
            break
        before = now
    return live.select(*alignments.columns)


def _log(scale: float):
    return F.lit(math.log(scale) if scale > 0 else -math.inf)


def _without(p, scale: float):
    """Whether an alignment without a weight above 0 goes: at a scale of 0 only one without any."""
    return F.lit(True) if scale > 0 else p.isNull()


def _known(p, slen):
    """What distances are told by. a is null for an alignment without a weight."""
    a = F.when((p > 0) & (slen > 0), F.log(p) - F.log(slen))
    return F.struct(p.alias("p"), slen.cast("double").alias("slen"), a.alias("a"), F.log(slen).alias("b"))


def _nothing():
    """What distances are from before the first iteration."""
    return _known(F.lit(1.0), F.lit(1.0))


def _distance(x, best, k):
    """By how much the logarithm of x's weight after k iterations is above that of ``best``; null if x has no weight."""
    off = (x.p * best.slen - best.p * x.slen) / (best.p * x.slen)
    near = F.when(F.abs(off) <= TIE, 0.0).otherwise(F.log1p(off))
    a = x.a - best.a
    return F.pow(F.lit(2.0), k) * F.when(F.abs(a) < 0.5, near).otherwise(a) + (x.b - best.b)


def _goes(distance, greatest, p, scale: float):
    """Whether one of several alignments goes, by its distance and the greatest."""
    return F.coalesce(distance < greatest + _log(scale), _without(p, scale))


def _removal(known, iterations: int, scale: float):
    """known: an array. For each of it the iteration in which it goes; 0: never."""
    one_of = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  value is computed once
    start = F.struct(F.transform(known, lambda _: F.lit(0)).alias("gone"), _nothing().alias("best"))

    def one(state, k):
        distances = F.transform(state.gone, lambda gone, i: F.when(gone == 0, _distance(F.get(known, i), state.best, k)))

        def after(d):
            goes = lambda gone, i: (gone == 0) & _goes(F.get(d.all, i), d.greatest, F.get(known, i).p, scale)
            gone = F.transform(state.gone, lambda gone, i: F.when(goes(gone, i), k).otherwise(gone))
            # without a weight in the whole read there is nothing to be near to
            best = F.coalesce(F.get(known, (F.array_position(d.all, d.greatest) - 1).cast("int")), state.best)
            return F.struct(gone.alias("gone"), best.alias("best"))

        found = one_of(distances, lambda all: F.struct(all.alias("all"), F.array_max(all).alias("greatest")))
        several = F.size(F.filter(state.gone, lambda gone: gone == 0)) > 1
        return F.when(several, one_of(found, after)).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, one, lambda state: state.gone)


def removal_iterations(weighted: DataFrame, iterations: int, scale: float) -> DataFrame:
    """Adds ``gone``: the iteration in which an alignment would go if nothing stopped the loop; 0: never. Each read is gathered."""
    columns = [x for x in weighted.columns if x != "queryId"]
    row = F.struct(*columns)
    rows = weighted.groupBy("queryId").agg(F.collect_list(row).alias("rows"))
    # found after the rows are moved, as it follows from p and slen
    rows = rows.withColumn("known", F.transform("rows", lambda x: _known(x.p, x.slen)))
    marked = F.arrays_zip(F.col("rows").alias("row"), _removal(F.col("known"), iterations, scale).alias("gone"))
    return rows.select("queryId", F.inline(marked).alias("row", "gone")).select("queryId", "row.*", "gone")


def _step_apart(live: DataFrame, k: int, scale: float) -> DataFrame:
    """Iteration k over rows of any number for each read; ``before``: the read's best of the iteration before."""
    c = F.col
    scored = live.withColumn("known", _known(c("p"), c("slen"))).withColumn("distance", _distance(c("known"), c("before"), F.lit(k)))
    best = scored.groupBy("queryId").agg(F.max(F.struct("distance", "known")).alias("best"), F.count("*").alias("live"))
    goes = (c("live") > 1) & _goes(c("distance"), c("best.distance"), c("p"), scale)
    kept = scored.join(best, "queryId").where(~goes)
    before = F.when(c("best.distance").isNull(), c("before")).otherwise(c("best.known"))
    return kept.withColumn("before", before).select(*live.columns)


def resolve(alignments: DataFrame, iterations: int = ITERATIONS, scale: float = SCALE, work: Workspace | None = None) -> DataFrame:
    """The alignments that survive. Ties do, and so do those that only a later iteration would have removed.

    ``alignments`` are best a saved table; those with a column ``p`` have their weights already, and come back without it.
    """
    work = work or Workspace(alignments.sparkSession, "resolve")
    c = F.col
    columns = [x for x in alignments.columns if x != "p"]
    weighted = alignments if "p" in alignments.columns else initial_weights(alignments)
    weighted = weighted.where("queryId is not null")  # there is no read to be resolved
    # reads of so many alignments are few, mostly none: only then are rows joined to them
    large = work.save(alignments.groupBy("queryId").agg(F.count("*").alias("_n")).where((c("_n") > GATHERED) & c("queryId").isNotNull()).select(c("queryId").alias("_large")))
    left = large.count()
    many = None
    if left:
        weighted = work.save(weighted.join(large, c("queryId") == c("_large"), "left"))
        many = weighted.where("_large is not null").drop("_large")
        weighted = weighted.where("_large is null").drop("_large")
        left = many.count()
        many = many.withColumn("before", _nothing())
    most = min(iterations, LAST_REMOVAL + 1)
    rows = work.save(removal_iterations(weighted, most, scale).select(*columns, "gone"))
    seen = {r["gone"] for r in rows.select("gone").distinct().collect()}  # LAST_REMOVAL + 1 at most
    last = most
    for k in range(1, most + 1):
        before = left
        if left:
            after = work.save(_step_apart(many, k, scale))
            left = after.count()
            if k > 1:
                work.drop(many)
            many = after
        if left == before and k not in seen:
            last = k
            break
    kept = rows.where((c("gone") == 0) | (c("gone") > last)).drop("gone")
    return kept.unionByName(many.select(*columns)) if left else kept
