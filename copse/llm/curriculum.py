"""Mixing sources to target weights with a time-varying curriculum.

Targets come from the sources' weights by water-filling: a source stops at a multiple of
its size and the excess is reshared by weight. Each source has a schedule, the relative
rate at which its tokens are wanted over training time 0 to 1. The integral of the schedule
is the source's cumulative token demand; inverting it at a document's cumulative token
offset gives the document's training position, and documents are range-sorted by position.

Offsets are prefix sums in two steps, so that a source with a third of all rows is no
single task: bins of a hash order are summed first, then the few thousand rows of a bin.
All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copse.llm._shared import WORD, table, text_of, written

Schedule = Sequence[tuple[float, float]]

#: Relative rates at times 0 to 1, repeating over the sources like the weights: fading, steady, growing.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))
_BIN_ROWS = 20_000


def cumulative(schedule: Schedule) -> list[tuple[float, float, float]]:
    """(time, rate, demand so far) at each knot; rates are scaled to a demand of 1 over the whole time."""
    if len(schedule) < 2 or [t for t, _ in schedule] != sorted({t for t, _ in schedule}) or schedule[0][0] != 0 or schedule[-1][0] != 1 or min(w for _, w in schedule) < 0:
        raise ValueError("a schedule has rising times from 0 to 1 and no negative rate")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])]
    if not sum(areas) > 0:
        raise ValueError("a schedule needs a rate above 0 somewhere")
    done, out = 0.0, []
    for (t, w), area in zip(schedule, [*areas, 0.0]):
        out.append((t, w / sum(areas), done))
        done += area / sum(areas)
    return out


def inverse(schedule: Schedule, demand: Column) -> Column:
    """The time at which the schedule's cumulative demand (0 to 1) is reached."""
    knots = cumulative(schedule)
    out = F.lit(1.0)
    for (t, r, d), (t2, r2, _) in reversed(list(zip(knots, knots[1:]))):
        half = (r2 - r) / (t2 - t) / 2
        x = F.greatest(demand - F.lit(d), F.lit(0.0))
        step = x / F.lit(r) if half == 0 and r else 2 * x / (F.lit(r) + F.sqrt(F.greatest(F.lit(r * r) + 4 * half * x, F.lit(0.0)))) if r or half else F.lit(0.0)
        step = F.when(x > 0, step).otherwise(0.0)
        out = F.when(demand < F.lit(knots[knots.index((t, r, d)) + 1][2]), F.lit(t) + step).otherwise(out)
    return F.least(out, F.lit(1.0))


def source_targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``key, rank, source_size, target`` of each source: one row a source throughout."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(every) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    ranked = ranked.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - before) / after)
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(whole)["level"]
    return ranked.select("key", "rank", "source_size", F.coalesce(F.least("cap", level * F.col("weight")), "cap").alias("target"))


def curriculum(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    schedules: Sequence[Schedule] = SCHEDULES,
    seed: str = "mix",
) -> DataFrame:
    """The plan of a mix, one row a document: ``doc_id, size, source_size, target, taken, copies, positions, row_key``.

    ``size`` is the number of words, ``target`` the words wanted of its source, ``copies``
    how often the mix takes the document (at most ``most`` times), ``taken`` the words that
    makes, ``positions`` the training time of each copy. Sources are ranked by code point
    with null last; weights and schedules repeat over the ranks.

    A source's documents stand in the order of a seeded digest of their id. The mix takes
    the order as often as it fits the target, then its front part: a document is in that
    if its middle is. So a source's taken words miss the target by half a document at most.

    Null and empty texts have size 0 and add nothing; a null source is a source of its own;
    null or repeated ids are documents of their own, ordered by size among themselves.
    Extra columns are not read. An empty table gives an empty plan. No source reaches its
    target if ``share`` exceeds ``most``: then each is taken ``most`` times.
    """
    if int(most) != most:
        raise ValueError("most is a whole number of copies")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("order"),
        row_key().alias("row_key"),
    )
    sized = written(sized, "sizes")
    digits = max(0, math.ceil(math.log(max(1, sized.count() / _BIN_ROWS), 16)))
    sized = sized.withColumn("bin", F.substring("order", 1, digits))

    bins = sized.groupBy("key", "bin").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    bins = written(bins, "bins")
    sources = bins.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(sources, weights, share, most)
    before = F.sum("words").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    placed = bins.select("key", "bin", before.alias("bin_offset")).join(targets, "key")

    in_bin = Window.partitionBy("key", "bin").orderBy("order", "size", "row_key")
    rows = sized.withColumn("offset", F.sum("size").over(in_bin.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(placed, ["key", "bin"])
    middle = F.col("bin_offset") + F.col("offset") + F.col("size") / 2
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - full * F.col("source_size")
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, full + F.when(middle < rest, 1).otherwise(0)).otherwise(0).cast("int"))

    def position(copy: Column) -> Column:
        demand = F.when(F.col("target") > 0, (copy * F.col("source_size") + middle) / F.col("target")).otherwise(0.0)
        out = inverse(schedules[0], demand)
        for i, s in enumerate(schedules[1:], 1):
            out = F.when(F.col("rank") % len(schedules) == i, inverse(s, demand)).otherwise(out)
        return F.round(out, 9)

    times = F.array(*[position(F.lit(k)) for k in range(int(most))])
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "copies", F.slice(times, F.lit(1), F.col("copies")).alias("positions"), "row_key",
    )


def row_key() -> Column:
    """Digest of a document's id, source and text; equal rows share it."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return F.md5(F.concat_ws("\n", part("doc_id"), part("source"), part("text")))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of a mix, once a copy, range-sorted by training position; the columns are those of ``docs``.

    Documents that the plan takes no copy of are left out, which is what the weights ask for.
    """
    plan = written(curriculum(docs, **how).select(F.col("row_key").alias("__key"), "copies", F.col("positions").alias("__positions")), "plan")
    keyed, on, taken = docs.withColumn("__key", row_key()), ["__key"], plan
    if not plan.groupBy("__key").count().filter("count > 1").isEmpty():  # equal rows are told apart by number
        by_key = Window.partitionBy("__key").orderBy("__key")
        taken, keyed = (x.withColumn("__n", F.row_number().over(by_key)) for x in (plan, keyed))
        on = ["__key", "__n"]
    taken = taken.filter("copies > 0").drop("copies")
    out = keyed.join(taken, on)  # no broadcast asked for: whole texts move at any size, as they must in a large table
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode("__positions").alias("__position"))
    return out.repartitionByRange("__position").sortWithinPartitions("__position").drop("__position")


def op9_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum(table(spark, sf_dir, "documents")).drop("row_key")
    plan = plan.withColumn("first_position", F.get("positions", F.lit(0))).drop("positions")
    return plan.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix of what is left, in training order; a document taken twice is there twice."""
    return mixed(docs)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(rank % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, rank, source_size,
         coalesce(least(cap, weight * (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1)), cap) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rank,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.size ROWS UNBOUNDED PRECEDING) - s.size + s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copied AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE floor(target / source_size)
              + (middle < target - floor(target / source_size) * source_size)::INT END::INT AS copies,
         middle / target AS u
  FROM placed)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies,
  CASE WHEN copies > 0 THEN round(least(1.0::DOUBLE, CASE rank % 3
    WHEN 0 THEN 2 * u / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2 * u))
    WHEN 1 THEN u
    ELSE CASE WHEN u < 0.25 THEN 2 * u / (0.25::DOUBLE + sqrt(0.0625::DOUBLE + 2 * u))
              ELSE 0.5 + 2 * (u - 0.25) / (0.75::DOUBLE + sqrt(0.5625::DOUBLE + 6 * (u - 0.25))) END END), 9) END AS first_position
FROM copied
"""
