"""Depth along references as run-length segments.

An alignment covers [subjectStart, min(subjectEnd, L-1)), L being the reference's length: the
last position it names is not counted, nor is the reference's last.  Only where the depth
changes is a row made, so the cost does not depend on the references' lengths.

Changes are added up by position before they are gathered by reference: a reference with very many
alignments has at most one row for each of its positions.  Where some reference may have more than ``BLOCK`` of these,
depths are added up in two levels: within blocks of so many positions, each the work of one task at a time, and
over the blocks' totals, a row for each block.  So no task has a whole long reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trim_length
from ..storage import Workspace

#: Positions of a reference that one task takes in order.
BLOCK = 1 << 16
#: Where a missing position is: after all others.
BEYOND = 1 << 40
#: Alignments whose changes are the work of one task.
TASK_ROWS = 1 << 17


def changes(alignments: DataFrame) -> DataFrame:
    """(subjectId, pos, change, slen): where the depth changes, and by how much; the greatest length that its alignments name.

    Positions are not cut at the reference's end yet.  A missing one counts as beyond it.
    """
    place = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(BEYOND))
    ends = F.array(F.struct(place("subjectStart").alias("pos"), F.lit(1).alias("by")), F.struct(place("subjectEnd").alias("pos"), F.lit(-1).alias("by")))
    each = alignments.select("subjectId", "slen", F.explode(ends).alias("e"))
    return each.groupBy("subjectId", "e.pos").agg(F.sum("e.by").alias("change"), F.max("slen").alias("slen"))


def segments(alignments: DataFrame, lengths: DataFrame, keep_empty: bool = False, work: Workspace | None = None) -> DataFrame:
    """(subjectId, L, ..., pos, next_pos, depth): from pos up to next_pos the depth is the same.

    ``lengths``: one row per reference with its length ``L``, the greatest that its alignments name; other columns are carried along.
    ``keep_empty`` keeps a row with a null pos for references without any change.  Whether a reference is too
    long for one task is looked up in ``alignments`` first, so these are best a saved table.

    The sweep has three numbers a row; ``lengths`` are joined to its results, which are in the order that the join needs.
    """
    most, n = _most_changes(alignments)
    if most > BLOCK:
        swept = _swept_by_block(changes(alignments), lengths, work or Workspace(alignments.sparkSession, "segments"))
    else:
        # a number of partitions that follows the rows, so that a task's share stays as it is
        tasks = -(-n // TASK_ROWS) or 1
        swept = _swept(changes(alignments).repartition(tasks, "subjectId"))
        lengths = lengths.repartition(tasks, "subjectId")
    found = lengths.join(swept, "subjectId", "left" if keep_empty else "inner")
    return found.select(*lengths.columns, "pos", "next_pos", F.when(F.col("pos").isNull(), 0).otherwise(F.col("depth")).alias("depth"))


def _swept(rows: DataFrame) -> DataFrame:
    """(subjectId, pos, next_pos, depth). A reference's length is found in the same pass; of positions that are cut to the same one, the last row has all their changes."""
    c = F.col
    along = Window.partitionBy("subjectId").orderBy("pos")
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.where("subjectId is not null").select("subjectId", "pos", F.max("slen").over(every).alias("L"), F.lead("pos").over(along).alias("next"), _running(along).alias("depth"))
    cut = rows.select("subjectId", _cut("pos").alias("pos"), F.coalesce(F.when(c("next").isNotNull(), _cut("next")), c("L")).alias("next_pos"), (c("next").isNotNull() & _cut("pos").eqNullSafe(_cut("next"))).alias("goes_on"), "depth")
    return cut.where(~c("goes_on") & c("pos").isNotNull()).drop("goes_on")


def _cut(name: str):
    """A position, the reference's last at most; null if neither is known."""
    pos = F.when(F.col(name) < BEYOND, F.col(name).cast("int"))
    return F.least(pos, F.col("L") - 1)


def _most_changes(alignments: DataFrame) -> tuple[int, int]:
    """A bound for the positions of a reference where its depth changes, and the number of alignments."""
    longest, n = alignments.agg(F.max("slen"), F.count("*")).first()
    if (longest or 0) <= BLOCK:
        return longest or 0, n
    counted = alignments.groupBy("subjectId").agg(F.least(F.max("slen"), 2 * F.count("*")).alias("most"))
    return counted.agg(F.max("most")).first()[0], n


def _running(along):
    """The sum of changes so far."""
    return F.sum("change").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _swept_by_block(rows: DataFrame, lengths: DataFrame, work: Workspace) -> DataFrame:
    """As ``_swept``; positions are cut and added up first, so that blocks hold ``BLOCK`` of them at most."""
    key = ["subjectId", "block"]
    rows = rows.join(lengths.select("subjectId", "L"), "subjectId").withColumn("pos", _cut("pos")).where("pos is not null")
    rows = rows.groupBy("subjectId", "L", "pos").agg(F.sum("change").alias("change"))
    rows = work.save(rows.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")))
    over = Window.partitionBy("subjectId").orderBy("block")
    totals = rows.groupBy(*key).agg(F.sum("change").alias("total"), F.min("pos").alias("first_pos"))
    bases = totals.select(
        *key,
        F.coalesce(F.sum("total").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.lead("first_pos").over(over).alias("next_block_pos"),
    )
    along = Window.partitionBy(*key).orderBy("pos")
    return rows.join(bases, key).select(
        "subjectId",
        "pos",
        F.coalesce(F.lead("pos").over(along), "next_block_pos", "L").alias("next_pos"),
        (F.col("base") + _running(along)).alias("depth"),
    )


def trimmed(segmented: DataFrame, trim: bool = True) -> DataFrame:
    """Adds ``length``: the positions of each segment that lie between the trimmed ends."""
    t = trim_length(F.col("avg_alignment_length"), F.col("L")) if trim else F.lit(0)
    length = F.greatest(F.lit(0), F.least("next_pos", F.col("L") - t) - F.greatest("pos", t))
    return segmented.withColumn("length", F.when(F.col("pos").isNull(), 0).otherwise(length).cast("long"))
