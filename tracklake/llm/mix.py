"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ragged import ranked
from .common import discard, materialize, partitions, unused, word_count

#: Weights by source in code-point order, repeating; the share of all words to take; the most of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
FEW = 10_000  # sources that are broadcast; more are joined
SEED = 20


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, rank, source_size, target) of a table (source, n) of sources and their words.

    By weight, none above ``most`` times its size; what a full source leaves goes to the others by
    weight, again until none is above. Sources without words get 0; the null source ranks last.
    Each round moves the words a unit of weight gets and is one aggregation: the table, of any
    number of sources, never comes to the driver.
    """
    order = ranked(sizes.withColumn("none", F.col("source").isNull()), ["none", "source"], "rank").drop("none")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(order.select("source", F.col("rank").cast("int").alias("rank"), F.col("n").alias("source_size"), F.when(F.col("n") > 0, weight).otherwise(0.0).alias("weight")), "mix-sources")
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, cap = 0.0, most * F.col("source_size")
    while True:
        full = F.col("weight") * level > cap
        spent, open_ = table.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_:
            break
        new = (budget - (spent or 0.0)) / open_
        if new <= level:
            break
        level = new
    return table.select("source", "rank", "source_size", F.least(F.col("weight") * level, cap).cast("double").alias("target"))


@dataclass
class Plan:
    """A schedule: rows with virtual times, the copies in global order of their finish times, the last one taken, the sources' table."""

    rows: DataFrame
    copies: DataFrame
    sources: DataFrame
    last: tuple[float, int, int] | None

    def taken(self) -> Column:
        """How many copies of a row of ``rows`` stand before the cut."""
        if self.last is None:
            return F.lit(0)
        one = lambda e: F.when(F.col("size") == 0, 0).otherwise((F.struct(finish(e), F.col("rank"), F.lit(e)) <= F.struct(*map(F.lit, self.last))).cast("int"))
        return sum((one(e) for e in range(1, int(MOST))), one(0))


def finish(copy: int) -> Column:
    """Virtual finish time of a copy: words of the source up to it, over the source's target."""
    return F.when(F.col("target") > 0, (F.col("upto") + F.lit(copy) * F.col("source_size")) / F.col("target"))


def shuffle_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.lit(SEED), F.col(doc_id), F.col(text))


def plan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Plan:
    """Give each shuffled document its virtual finish times, sort all copies by them, cut at the total budget.

    Documents stand in a hash order within their source. Running sums are made in two levels,
    over hash ranges of a source and within a range, so no source has to fit in one task. Copies
    (numbers only, no texts) are sorted by range over all partitions; the partition sums tell in
    which of them the budget ends, and the copy is looked up there. Texts are read once and never
    shuffled. Null sources form one source; null texts and texts without words are never taken;
    equal rows are interchangeable; without words nothing is taken.
    """
    small = materialize(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), shuffle_key(doc_id, text).alias("h")), "mix")
    by_range = materialize(small.groupBy("source", F.shiftright("h", 52).alias("part")).agg(F.sum("size").alias("words")), "mix-ranges")
    sources = materialize(targets(by_range.groupBy("source").agg(F.sum("words").alias("n"))), "mix-targets")
    few = F.broadcast if sources.count() <= FEW else (lambda d: d)
    w = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_range.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0))).drop("words")
    inner = Window.partitionBy("source", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = small.withColumn("part", F.shiftright("h", 52)).withColumn("within", F.sum("size").over(inner))
    # a row for each range of each source, whose first row takes the offset along: no join by a hot source
    offsets = before.select(F.col("source").alias("o_source"), F.col("part").alias("o_part"), "before")
    joined = rows.join(offsets, rows["source"].eqNullSafe(F.col("o_source")) & (rows["part"] == F.col("o_part")), "left")
    joined = joined.withColumn("upto", F.col("within") + F.col("before")).select("doc_id", F.col("source").alias("r_source"), "size", "h", "upto")
    rows = materialize(joined.join(few(sources), F.col("r_source").eqNullSafe(F.col("source"))).drop("r_source"), "mix-times")
    each = F.explode(F.array(*(F.struct(finish(e).alias("finish"), F.lit(e).alias("copy")) for e in range(int(MOST)))))
    copies = rows.filter(F.col("size") > 0).select("doc_id", "size", "rank", "h", each.alias("x")).select("doc_id", "size", "rank", "h", "x.finish", "x.copy")
    key = ["finish", "rank", "copy", "h", "doc_id"]
    copies = copies.repartitionByRange(partitions(df.sparkSession), *key).sortWithinPartitions(*key)
    copies = materialize(copies.withColumn("part", F.spark_partition_id()), "mix-order")
    discard(small, by_range)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    return Plan(rows, copies, sources, _cut(copies, SHARE * total))


def _cut(copies: DataFrame, budget: float) -> tuple[float, int, int] | None:
    """The last (finish, rank, copy) in global order whose running sum of words is within the budget.

    The driver gets a sum a partition; the one where the budget ends is summed by a task.
    """
    last, left = None, budget
    for r in sorted(copies.groupBy("part").agg(F.sum("size").alias("w"), F.max(F.struct("finish", "rank", "copy")).alias("m")).collect()):
        if r.w <= left:
            last, left = tuple(r.m), left - r.w
            continue
        sums = Window.partitionBy("part").orderBy("finish", "rank", "copy", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        inside = copies.filter(F.col("part") == r.part).withColumn("sum", F.sum("size").over(sums)).filter(F.col("sum") <= left)
        found = inside.agg(F.max(F.struct("finish", "rank", "copy"))).first()[0]
        return tuple(found) if found else last
    return last


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents that the mix takes, as often as it takes them, with the columns of ``df``.

    A copy is taken exactly when its document's hash lies at or before the last one taken of its
    source, so the schedule's cut comes back as two hashes a source and texts stay where they
    are. Rows of null or empty text are not taken; repeated rows are taken alike; without rows
    there are none.
    """
    p = plan(df, doc_id, text, source)
    key, at, of, copy, *cut = (unused(df, n) for n in ("mix_key", "mix_n", "mix_source", "mix_copy", *(f"mix_h{e}" for e in range(int(MOST)))))
    cuts = p.rows.withColumn(at, p.taken()).filter(F.col(at) > 0).groupBy("rank").agg(*(F.max(F.when(F.col(at) > e, F.col("h"))).alias(c) for e, c in enumerate(cut)))
    cuts = cuts.join(p.sources, "rank").select(F.col("source").alias(of), *cut)
    few = F.broadcast if p.sources.count() <= FEW else (lambda d: d)
    out = df.withColumn(key, shuffle_key(doc_id, text)).join(few(cuts), F.col(source).eqNullSafe(F.col(of)))
    copies = sum((F.coalesce(F.col(key) <= F.col(c), F.lit(False)).cast("int") for c in cut[1:]), F.coalesce(F.col(key) <= F.col(cut[0]), F.lit(False)).cast("int"))
    out = out.filter(word_count(F.col(text)) > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies)))
    return out.select(*df.columns)


def ordered(p: Plan) -> DataFrame:
    """(doc_id, copy, finish) in training order: the copies before the cut, in the global order of finish times.

    The order is that of the written, range-sorted table: a hot source is spread by finish time.
    Ties go by source, copy, hash and id; a repeated row stands there once for each; an empty
    schedule has no rows.
    """
    taken = p.copies.filter(F.lit(False)) if p.last is None else p.copies.filter(F.struct("finish", "rank", "copy") <= F.struct(*map(F.lit, p.last)))
    return taken.orderBy("part", "finish", "rank", "copy", "h", "doc_id").select("doc_id", "copy", "finish")
