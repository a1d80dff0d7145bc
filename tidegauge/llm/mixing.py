"""Mixing sources to target weights by capped water-filling.

Every source wants its weight's share of all words. A source may be repeated
``max_epochs`` times at most; what it cannot give is shared out again among the
others by weight until no source is above its limit. At that level the target of
an unclamped source is ``weight * level``, so that the level follows from one
pass over the sources in order of limit by weight.

Cases: a null text has no words; documents without words take nothing; a text of any
length is counted whole, and may be the one that is taken in part; a null source is a
source of its own, last in order; rows without an id are ordered by their text, rows
of one id by size and text; equal rows are rows like any other, of which the mix may
take different numbers; an empty table gives an empty result; further columns are
ignored unless named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import WORD, query, table

#: The seeded order of a source is cut into this many ranges, so that no task sorts a whole source.
RANGES_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row per source: known, source, source_size, weight, target, from columns known, source, size.

    Only sums by source meet in one task.
    """
    sources = sizes.groupBy("known", "source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.desc("known"), "source")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = sources.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    ranked = ranked.withColumn("limit", F.col("source_size") * max_epochs)
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.desc("known"), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(rest))
        .withColumn("free", F.col("left") * F.col("weight") <= F.col("limit") * F.col("rest_weight"))
    )
    opened = F.when(F.col("free"), F.struct("left", "rest_weight"))
    ranked = ranked.withColumn("level", F.min_by(opened, F.when(F.col("free"), F.col("limit") / F.col("weight"))).over(everything))
    level = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.rest_weight").cast("double")
    target = F.when(F.col("free"), level).otherwise(F.col("limit").cast("double"))
    return ranked.select("known", "source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every document with the words that the mix takes of it.

    Result: ``key``, size, source_size, target (of the source), whole (full
    repetitions), part (words of one more, partial repetition), taken
    (``whole * size + part``), and the columns in ``carry``. Each source takes
    its rounded target exactly: all documents as often as it goes in whole, then
    documents in seeded order until the rest is used up, the last of them in
    part.
    """
    number: Column = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    own_text = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    # rows without an id are told apart by text, so that they do not all fall into one range
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), own_text))))
    rows = docs.select(
        F.col(key).alias("own_key"),
        number.alias("size"),
        F.col(source).isNotNull().alias("known"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        order.alias("order"),
        own_text.alias("own_text"),
        F.substring(order, 1, RANGES_DIGITS).alias("range"),
        F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.lit(None).alias("carried"),
    )
    targets = source_targets(rows, weights, max_epochs)
    budget = F.floor(F.col("target") + 0.5)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("spare", budget - F.col("whole") * F.col("source_size"))
    along = Window.partitionBy("known", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("known", "source", "range").agg(F.sum("size").alias("words"))
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("words").over(along), F.lit(0)))
    ranges = ranges.join(targets, ["known", "source"]).select(
        "known", "source", "range", "source_size", "target", "whole", (F.col("spare") - F.col("ahead")).alias("spare")
    )
    inside = Window.partitionBy("known", "source", "range").orderBy("order", "size", "own_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.least(F.greatest(F.col("spare") - F.col("ahead"), F.lit(0)), F.col("size"))
    out = rows.join(ranges, ["known", "source", "range"]).withColumn("part", part)
    return out.select(
        F.col("own_key").alias(key),
        "size",
        "source_size",
        "target",
        "whole",
        "part",
        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"),
        *[F.col(f"carried.{c}").alias(c) for c in carry if c != key],
    )


SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(text, '')) as own_text,
         md5('0:' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))) as seeded
  from documents),
sources as (
  select source, sum(size)::bigint as source_size from sized group by source),
weighted as (
  select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from sources),
filled as (
  select *, 3 * source_size as lim,
         sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source nulls last
           rows between unbounded preceding and 1 preceding), 0) as remaining,
         sum(weight) over (order by 3 * source_size / weight, source nulls last
           rows between current row and unbounded following) as rest_weight
  from weighted),
free as (select *, remaining * weight <= lim * rest_weight as open from filled),
level as (select arg_min(remaining, lim / weight) as remaining, arg_min(rest_weight, lim / weight) as rest_weight from free where open),
targets as (
  select f.source, f.source_size,
         case when f.open then (f.weight * l.remaining)::bigint::double / l.rest_weight::bigint::double else f.lim::double end as target
  from free f, level l),
budgets as (
  select *, case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end as whole,
         floor(target + 0.5)::bigint as budget from targets),
ordered as (
  select *, coalesce(sum(size) over (partition by source order by seeded, size, own_text rows between unbounded preceding and 1 preceding), 0) as ahead
  from sized)
select o.doc_id, o.size, b.source_size, b.target,
       (b.whole * o.size + least(greatest(b.budget - b.whole * b.source_size - o.ahead, 0), o.size))::bigint as taken
from ordered o join budgets b on o.source is not distinct from b.source
"""


@query("op10_mixing", SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
