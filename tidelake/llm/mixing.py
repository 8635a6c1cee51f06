"""Mixing of sources to target weights, with weights that change in the course of training.

Every source has a weight and a schedule: how the weight is spread over training time 0 to 1. The
integral of the schedule is the source's cumulative demand in words. A document's place in its
source's supply (documents in the order of a hash, repeated in passes) is put through the inverse
of that demand, which gives the time at which training reaches it. Sorting by that time gives the
order of training.

Everything is DataFrame expressions. The running sums over a source are made in two steps, over
4096 ranges of a hash over doc_id and text and within each, so that no source is in one task, nor
are rows without ids or with one id. Nulls: a null text has no words; null sources form one source,
last in order; a null doc_id hashes like an empty one. Texts count whole, whatever their length.
Repeated rows are documents of their own and may change places with each other. A document without
words is never taken. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, packed, text_or_empty, words

#: Knots (time, relative weight) for the sources of weight 1, 2, 3: early, even, late.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
)


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (1, 2, 3)
    schedules: tuple[tuple[tuple[float, float], ...], ...] = SCHEDULES
    max_repeats: int = 3


def integrated(schedule: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(start, end, weight at start, slope, demand at start) of each segment, the total demand being 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        w0, w1 = w0 / area, w1 / area
        out.append((t0, t1, w0, (w1 - w0) / (t1 - t0), done))
        done += (t1 - t0) * (w0 + w1) / 2
    return out


def inverse_demand(schedule: tuple[tuple[float, float], ...], demand: Column) -> Column:
    """The time at which a share (0 to 1) of the source's demand has been met."""
    out = None
    for t0, t1, w0, slope, before in reversed(integrated(schedule)):
        more = demand - F.lit(before)
        step = more / F.lit(w0) if slope == 0 else (
            F.lit(2.0) * more / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * more, F.lit(0.0)))))
        here = F.lit(t0) + step
        out = here if out is None else F.when(demand < F.lit(nxt), here).otherwise(out)
        nxt = before
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size, kind (0, 1, 2, ...: the place in mix.weights), target.

    sizes: source, source_size; one row for each source. Targets are in proportion to the weights,
    but none is above max_repeats times the source's size. The sources are filled in the order in
    which they reach that limit; what they leave is shared among the rest, in closed form.
    The windows run over sources, of which there are few, not over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    kinds = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("kind") + 1).cast("int"))
    df = (sizes.withColumn("kind", (F.row_number().over(order) - 1) % len(mix.weights))
          .withColumn("weight", kinds.cast("long"))
          .withColumn("cap", F.lit(mix.max_repeats).cast("long") * F.col("source_size")))
    by_limit = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = (df.withColumn("total", F.sum("source_size").over(everything))
          .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
          .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
          .withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("open")))
    # the first source that does not reach its limit fixes the level for all that follow; "open" falls along the order
    first = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("open", "level"))).over(everything)
    level = first.level
    return df.select("source", "source_size", "kind",
                     F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.lit(0.0))).alias("target"))


def assign_positions(docs: DataFrame, mix: Mix = Mix(), carry: list[str] | None = None) -> DataFrame:
    """row, size, source_size, target, passes (times taken), taken (words), positions (one for each time).

    carry: the columns that row keeps (all). A document is taken in a pass if the middle of its words
    lies below the source's target, so a source misses its target by half a document at most.
    """
    text, doc = text_or_empty("row.text"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))
    kept = [F.col(f"row.`{c}`").alias(c) for c in (docs.columns if carry is None else carry)]
    base = (packed(docs)
            .select(F.struct(*kept).alias("row"), F.col("row.source").isNull().alias("sn"),
                    F.coalesce("row.source", F.lit("")).alias("sk"), F.size(words(text)).cast("long").alias("size"),
                    F.md5(F.concat_ws("|", F.lit("mix"), doc, text)).alias("hash"))
            .withColumn("part", F.substring("hash", 1, 3)))
    if "text" not in (docs.columns if carry is None else carry):  # narrow rows: words are counted once
        base = materialise(base, "mix-sizes")
    sums = base.groupBy("sn", "sk", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("sn", "sk").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    sizes = (sums.groupBy("sn", "sk").agg(F.sum("part_size").alias("source_size"))
             .withColumn("source", F.when(~F.col("sn"), F.col("sk"))))
    targets = (source_targets(sizes.select("source", "source_size"), mix)
               .select(F.col("source").isNull().alias("sn"), F.coalesce("source", F.lit("")).alias("sk"),
                       "source_size", "kind", "target"))
    plan = sums.select("sn", "sk", "part", "offset").join(targets, ["sn", "sk"])
    placed = base.join(plan, ["sn", "sk", "part"])
    within = (Window.partitionBy("sn", "sk", "part").orderBy("hash")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = placed.withColumn("middle", start + F.col("size") / F.lit(2.0))
    at = lambda i: i * F.col("source_size") + F.col("middle")
    passes = F.filter(F.sequence(F.lit(0), F.lit(mix.max_repeats - 1)),
                      lambda i: (F.col("size") > 0) & (at(i) <= F.col("target")))

    def time(i: Column) -> Column:
        share = at(i) / F.col("target")
        out = F.lit(None).cast("double")
        for k in range(len(mix.weights)):
            out = F.when(F.col("kind") == k, inverse_demand(mix.schedules[k], share)).otherwise(out)
        return out

    return (placed.withColumn("passes", passes)
            .select("row", "size", "source_size", "target", F.size("passes").alias("passes"),
                    (F.size("passes") * F.col("size")).cast("long").alias("taken"),
                    F.transform("passes", time).alias("positions")))


def in_training_order(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row for each time that a document is taken, sorted by position: row, position, pass."""
    placed = assign_positions(docs, mix)
    return placed.select("row", F.posexplode("positions").alias("pass", "position")).orderBy("position", "row.doc_id", "pass")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents taken, in training order, each as often as it is taken, with their own columns."""
    return in_training_order(docs, mix).select("row.*")
