"""Preparation: column kinds, dictionaries, bins, bags, synthetic rows, masks, splits and weights.

Features are wide columns of numbers. Missing values are null (NaN is turned into null on
ingest). Rows that take part in sampling have a dense ``row_id`` from 0.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions.portable import draw, uniform
from copse.operators.prefix import running_sums
from copse.plans.storage import materialised

#: Distinct values of a feature up to which one task ranks them.
RANK_ROWS = 1_000_000


# -- ingest -----------------------------------------------------------------------------

def as_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The features as doubles with NaN as null, and the columns to keep."""
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features]
    return df.select(*keep, *clean)


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """A dense number from 0 in the order of the columns, without sorting in one task.

    Rows are range-partitioned and numbered within a partition; the partitions' sizes (a
    row each) give the offsets.
    """
    part = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    part = part.withColumn("__place", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    part = materialised(part, "numbered")
    sizes = sorted((r["__part"], r["n"]) for r in part.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, done = [], 0
    for p, n in sizes:
        starts += [F.lit(p), F.lit(done).cast("long")]
        done += n
    offset = F.element_at(F.create_map(*starts), F.col("__part")) if starts else F.lit(0).cast("long")
    return part.withColumn(name, offset + F.col("__place")).drop("__part", "__place")


def long_form(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """One row a value: the kept columns, feature, value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]))
    return df.select(*keep, pairs.alias("__v")).select(*keep, "__v.feature", "__v.value")


def from_sparse(entries: DataFrame, features: Sequence[str], rows: DataFrame) -> DataFrame:
    """Wide rows from entries (row_id, feature, value); what is not stored is 0."""
    wide = entries.groupBy("row_id").pivot("feature", list(features)).agg(F.first("value"))
    out = rows.select("row_id").join(wide, "row_id", "left")
    return out.select("row_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in features])


# -- kinds and names --------------------------------------------------------------------

def kinds(df: DataFrame, features: Sequence[str], most: int = 10, for_imputer: bool = False) -> DataFrame:
    """``feature, n_unique, categorical`` by one aggregation.

    For a forest, a feature is categorical if all its values are whole (to 1e-5), it has
    more than 2 and at most ``most`` of them and they lie in [0, most). For the imputer, at
    most ``most`` distinct whole values are enough.
    """
    stats = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.count_distinct(F.col(c)).alias("n_unique"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"),
            F.max(F.abs(F.col(c) - F.rint(F.col(c).cast("double")))).cast("double").alias("off"),
        ) for c in features
    ])
    long = df.agg(stats.alias("s")).select(F.explode("s").alias("s")).select("s.*")
    whole = F.coalesce(F.col("off") <= 1e-5, F.lit(False))
    if for_imputer:
        yes = whole & (F.col("n_unique") <= most)
    else:
        yes = whole & (F.col("n_unique") > 2) & (F.col("n_unique") <= most) & (F.col("lo") >= 0) & (F.col("hi") < most)
    return long.select("feature", F.col("n_unique").cast("long").alias("n_unique"), yes.alias("categorical"))


def feature_indices(names: Sequence[str | int], columns: Sequence[str]) -> list[int]:
    """Positions of features given by name or position; unknown names and positions out of range are errors."""
    out = []
    for x in names:
        if isinstance(x, str):
            if x not in columns:
                raise ValueError(f"unknown feature {x!r}; there are {list(columns)}")
            out.append(list(columns).index(x))
        elif not 0 <= x < len(columns):
            raise ValueError(f"feature {x} is out of range; there are {len(columns)}")
        else:
            out.append(int(x))
    return out


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """``label, code``: codes from 0 in label order; nulls have none."""
    labels = df.select(F.col(column).alias("label")).filter("label is not null").distinct()
    return with_row_id(labels, ["label"], "code").select("label", F.col("code").cast("long").alias("code"))


def encode(df: DataFrame, column: str, labels: DataFrame, name: str = "code") -> DataFrame:
    """The column's code; null where the dictionary has no such label."""
    return df.join(labels.select(F.col("label").alias("__label"), F.col("code").alias(name)), F.col(column) == F.col("__label"), "left").drop("__label")


def decode(df: DataFrame, column: str, labels: DataFrame, name: str = "label") -> DataFrame:
    """The label of a code, rounded to a whole number; null where it is out of range."""
    return df.join(labels.select(F.col("code").alias("__code"), F.col("label").alias(name)), F.rint(F.col(column).cast("double")).cast("long") == F.col("__code"), "left").drop("__code")


# -- bins -------------------------------------------------------------------------------

def bin_edges(df: DataFrame, features: Sequence[str], n_bins: int = 256, categorical: Sequence[str] = ()) -> DataFrame:
    """``feature, bin, lo, hi`` of quantile bins over the distinct values.

    Up to n_bins bins, the b-th beginning at the distinct value of rank ``b * n / k`` (whole
    division), so bins hold about as many distinct values each; the first begins 1 below the
    least value. Two values: two bins that meet midway. A category is a bin of its own, with
    the value itself as both ends. A single value has one bin.
    """
    distinct = long_form(df, features, ()).filter("value is not null").distinct()
    sizes = distinct.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    cats = F.col("feature").isin(list(categorical)) if categorical else F.lit(False)
    placed = _ranked(distinct, sizes).join(sizes, "feature")
    by_category = placed.filter(cats).select("feature", F.col("rank").cast("int").alias("bin"), F.col("value").alias("lo"), F.col("value").alias("hi"))
    two = sizes.filter(~cats & (F.col("n") == 2)).withColumn("mid", (F.col("least") + F.col("most")) / 2)
    two = two.select("feature", F.explode(F.array(
        F.struct(F.lit(0).alias("bin"), (F.col("least") - 1).alias("lo"), F.col("mid").alias("hi")),
        F.struct(F.lit(1).alias("bin"), F.col("mid").alias("lo"), (F.col("most") + 1).alias("hi")))).alias("e")).select("feature", "e.*")
    many = placed.filter(~cats & (F.col("n") != 2)).withColumn("k", F.least(F.lit(n_bins), F.col("n")))
    # The value of rank r begins a bin if it is the first rank of one: b = ceil(r * k / n) with b * n / k = r.
    b = F.ceil(F.col("rank") * F.col("k") / F.col("n"))
    begins = many.withColumn("bin", b.cast("int")).filter(F.floor(F.col("bin") * F.col("n") / F.col("k")) == F.col("rank"))
    along = Window.partitionBy("feature").orderBy("bin")
    begins = begins.withColumn("lo", F.when(F.col("bin") == 0, F.col("value") - 1).otherwise(F.col("value")))
    edged = begins.select("feature", "bin", "lo", F.coalesce(F.lead("lo").over(along), F.col("most")).alias("hi"))
    return by_category.union(two).union(edged)


def _ranked(distinct: DataFrame, sizes: DataFrame) -> DataFrame:
    """Values with their rank in their feature, from 0. Beyond RANK_ROWS values (counted) no task ranks a feature alone."""
    counts = {r["feature"]: r["n"] for r in sizes.orderBy("feature").collect()}  # a row a feature
    if max(counts.values(), default=0) <= RANK_ROWS:
        return distinct.withColumn("rank", F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1)
    before = dict(zip(counts, itertools.accumulate(counts.values(), initial=0)))
    first = F.element_at(F.create_map(*[F.lit(x) for item in before.items() for x in item]), F.col("feature"))
    at = running_sums(distinct.withColumn("one", F.lit(1).cast("long")), ["feature", "value"], ["one"], ["at"])
    return at.select("feature", "value", (F.col("at") - 1 - first).alias("rank"))


def edge_arrays(edges: DataFrame) -> dict[str, list[tuple[float, float]]]:
    """Bins of each feature on the driver: at most n_bins a feature, however many rows."""
    out: dict[str, list[tuple[float, float]]] = {}
    for r in edges.orderBy("feature", "bin").collect():
        out.setdefault(r["feature"], []).append((r["lo"], r["hi"]))
    return out


def bin_of(value: Column, bins: Sequence[tuple[float, float]], categorical: bool = False) -> Column:
    """The bin of a number as an expression: a balanced search over the bins' lower ends, a lookup for categories. Null stays null."""
    starts = [lo for lo, _ in bins]
    if categorical:
        out = F.element_at(F.create_map(*[x for i, s in enumerate(starts) for x in (F.lit(float(s)), F.lit(i))]), value) if starts else F.lit(None).cast("int")
        return F.when(value.isNotNull(), F.coalesce(out, F.lit(0)))

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(value >= F.lit(float(starts[mid])), search(mid, high)).otherwise(search(low, mid - 1))

    two = len(bins) == 2
    if two:  # the lower bin holds its end
        return F.when(value > F.lit(float(starts[1])), 1).when(value.isNotNull(), 0)
    if len(starts) > 64:  # a search over arrays: so many branches would be too large to compile
        reached = lambda x: F.size(F.filter(x, lambda s: s <= value))
        whole = 16 * reached(F.lit([float(s) for s in starts[15::16]]))
        count = whole + reached(F.slice(F.lit([float(s) for s in starts]), whole + 1, F.lit(16)))
        return F.when(value.isNotNull(), F.greatest(count - 1, F.lit(0)))
    return F.when(value.isNotNull(), search(0, max(0, len(starts) - 1)))


def binned(df: DataFrame, edges: Mapping[str, Sequence[tuple[float, float]]], keep: Sequence[str] = ("row_id",), categorical: Sequence[str] = ()) -> DataFrame:
    """The kept columns and the bin of every feature."""
    return df.select(*keep, *[bin_of(F.col(c).cast("double"), e, c in categorical).alias(c) for c, e in edges.items()])


# -- bags and synthetic rows ------------------------------------------------------------

def bootstrap(df: DataFrame, n_trees: int, seed: int | str = 12345, n: int | None = None) -> DataFrame:
    """``tree_id, row_id, nin``: n draws with replacement for each tree; rows that are not drawn are out of bag and not listed."""
    n = df.count() if n is None else n
    draws = df.sparkSession.range(n_trees * n).select((F.col("id") % n_trees).cast("int").alias("tree_id"), F.floor(F.col("id") / n_trees).alias("d")) if n else df.sparkSession.createDataFrame([], "tree_id int, d long")
    picked = draws.select("tree_id", (draw(seed, F.col("tree_id"), F.col("d")) % max(n, 1)).alias("row_id"))
    return picked.groupBy("tree_id", "row_id").agg(F.count(F.lit(1)).alias("nin"))


def weighted_bootstrap(df: DataFrame, weight: str, n_trees: int, seed: int | str = 12345, bucket_rows: int = 128) -> DataFrame:
    """:func:`bootstrap` in which a row's chance is its weight.

    A draw is a point on the running sum of the weights in row order. Runs of rows are
    summed first, so the running sum and the search for a draw's row are distributed: a draw
    finds its run among the runs' sums and its row within the run.
    """
    rows = materialised(df.select("row_id", F.col(weight).cast("double").alias("w")).withColumn("run", F.floor(F.col("row_id") / bucket_rows)), "weights")
    if rows.filter("w < 0 or w is null").limit(1).count():
        raise ValueError("weights must be numbers of at least 0")
    runs = rows.groupBy("run").agg(F.sum("w").alias("w"))
    along = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    runs = materialised(runs.select("run", "w", F.sum("w").over(along).alias("to")).withColumn("from", F.col("to") - F.col("w")), "runs")
    n, total = rows.count(), runs.agg(F.max("to")).first()[0] or 0.0
    if not total:
        raise ValueError("no weight is above 0")
    inside = Window.partitionBy("run").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.join(runs.select("run", "from"), "run").withColumn("to", F.col("from") + F.sum("w").over(inside)).select("run", "row_id", "w", "to")
    ends = ends.withColumn("from", F.col("to") - F.col("w"))
    draws = df.sparkSession.range(n_trees * n).select((F.col("id") % n_trees).cast("int").alias("tree_id"), F.floor(F.col("id") / n_trees).alias("d"))
    draws = draws.select("tree_id", (uniform(seed, F.col("tree_id"), F.col("d")) * F.lit(total)).alias("u"))
    # Runs are few (rows / bucket_rows); each draw meets one of them, then the rows of that run only.
    width = total / max(1, runs.count())
    cells = runs.select("run", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor(F.col("to") / width))).alias("cell"))
    in_run = draws.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").filter("u >= from and u < to").select("tree_id", "u", "run")
    picked = in_run.join(ends, "run").filter("u >= from and u < to")
    return picked.groupBy("tree_id", "row_id").agg(F.count(F.lit(1)).alias("nin"))


def in_bag(df: DataFrame, bag: DataFrame) -> DataFrame:
    """Rows of each tree's bag with their multiplicity."""
    return bag.join(df, "row_id")


def oob(rows: DataFrame, bag: DataFrame, n_trees: int) -> DataFrame:
    """``tree_id, row_id`` of rows that a tree has not drawn."""
    trees = rows.sparkSession.range(n_trees).select(F.col("id").cast("int").alias("tree_id"))
    every = rows.select("row_id").withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))) if n_trees else rows.select("row_id").crossJoin(trees)
    return every.join(bag.select("tree_id", "row_id"), ["tree_id", "row_id"], "left_anti").select("tree_id", "row_id")


def oob_counts(rows: DataFrame, bag: DataFrame, n_trees: int) -> DataFrame:
    """``row_id, nout``: the number of trees a row is out of bag in, 0 included."""
    drawn = bag.groupBy("row_id").agg(F.count(F.lit(1)).alias("k"))
    return rows.select("row_id").join(drawn, "row_id", "left").select("row_id", (F.lit(n_trees) - F.coalesce("k", F.lit(0))).cast("long").alias("nout"))


def bag_weight(bag: DataFrame, casewise: bool) -> DataFrame:
    """The weight of an in-bag row in splits: its multiplicity if casewise, else 1."""
    return bag.withColumn("w", F.col("nin").cast("double") if casewise else F.lit(1.0))


def synthetic_union(df: DataFrame, features: Sequence[str], ratio: float = 1.0, seed: int | str = 12345) -> DataFrame:
    """Real rows (``is_real`` 1) and synthetic ones (0) in which each column is shuffled on its own.

    ``max(1, int(n * ratio))`` synthetic rows follow the real ones' numbers. Up to a ratio of
    1 each column is a permutation's front part, above it draws with replacement.
    """
    n = df.count()
    real = df.select("row_id", *features, F.lit(1).alias("is_real"))
    if not n:
        return real
    m = max(1, int(n * ratio))
    out = df.sparkSession.range(m).select(F.col("id").alias("at"))
    if ratio > 1:
        for c in features:
            donors = df.select(F.col("row_id").alias("__d"), F.col(c))
            out = out.withColumn("__d", draw(seed, c, F.col("at")) % n).join(donors, "__d").drop("__d")
    else:
        for c in features:
            donors = with_row_id(df.select("row_id", c).withColumn("h", draw(seed, c, F.col("row_id"))), ["h", "row_id"], "at").select("at", c)
            out = out.join(donors, "at")
    fake = out.select((F.col("at") + n).alias("row_id"), *features, F.lit(0).alias("is_real"))
    return real.unionByName(fake)


def synthetic_sparse(entries: DataFrame, n: int, features: Sequence[str], ratio: float = 1.0, seed: int | str = 12345) -> DataFrame:
    """Synthetic entries (row_id from n on, feature, value): each cell copies the feature of a random row; cells that copy nothing are 0 and not stored."""
    m = max(1, int(n * ratio)) if n else 0
    names = F.explode(F.array(*[F.lit(c) for c in features]))
    cells = entries.sparkSession.range(m).select(F.col("id").alias("at"), names.alias("feature"))
    cells = cells.withColumn("row_id", draw(seed, F.col("feature"), F.col("at")) % max(n, 1))
    return cells.join(entries, ["row_id", "feature"]).select((F.col("at") + n).alias("row_id"), "feature", "value")


# -- masks, anomalies, splits, weights ---------------------------------------------------

def mask_cells(df: DataFrame, features: Sequence[str], share: float = 0.15, seed: int | str = 42) -> DataFrame:
    """Cells nulled completely at random."""
    return df.select(*[F.when(uniform(seed, c, F.col("row_id")) >= share, F.col(c)).alias(c) if c in features else F.col(c) for c in df.columns])


def inject_anomalies(df: DataFrame, features: Sequence[str], share: float, kind: str = "mixed", seed: int | str = 42) -> DataFrame:
    """Rows made anomalous, flagged by ``is_anomaly``.

    point: one to three features moved by 5 to 10 standard deviations; contextual: half the
    features (at least one) taken from another row; collective: all features moved the same
    way by 2 to 4 standard deviations; mixed: a third of each.
    """
    if kind not in ("point", "contextual", "collective", "mixed"):
        raise ValueError(f"unknown kind {kind!r}")
    n = max(df.count(), 1)
    stats = df.agg(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in features]).first()
    rid = F.col("row_id")
    hit = uniform(seed, "hit", rid) < share
    pick = F.floor(uniform(seed, "kind", rid) * 3)
    as_kind = {"point": F.lit(0), "contextual": F.lit(1), "collective": F.lit(2)}.get(kind, pick)
    donors = df.select(F.col("row_id").alias("__d"), *[F.col(c).alias(f"__{c}") for c in features])
    out = df.withColumn("__d", draw(seed, "donor", rid) % n).join(donors, "__d", "left")
    count = 1 + F.floor(uniform(seed, "count", rid) * 3)
    changed = []
    for i, c in enumerate(features):
        sign = F.when(uniform(seed, c, "sign", rid) < 0.5, -1.0).otherwise(1.0)
        near = F.pmod(F.lit(i) - draw(seed, "first", rid), F.lit(len(features))) < count
        point = F.when(near, F.col(c) + sign * (5 + 5 * uniform(seed, c, "size", rid)) * stats[c]).otherwise(F.col(c))
        swap = F.when(F.pmod(F.lit(i) + draw(seed, "swap", rid), F.lit(len(features))) < max(1, len(features) // 2), F.col(f"__{c}")).otherwise(F.col(c))
        shift = F.col(c) + (2 + 2 * uniform(seed, "shift", c)) * stats[c]
        value = F.when(as_kind == 0, point).when(as_kind == 1, swap).otherwise(shift)
        changed.append(F.when(hit, value).otherwise(F.col(c)).alias(c))
    rest = [c for c in df.columns if c not in features]
    return out.select(*rest, *changed, hit.cast("int").alias("is_anomaly"))


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int | str = 12345, stratify: str | None = None) -> DataFrame:
    """``split`` is 'test' for exactly int(n * test_size) rows, of each stratum if asked for, in the order of a seeded draw."""
    keyed = df.withColumn("__h", draw(seed, F.col("row_id")))
    if stratify is None:
        numbered = with_row_id(keyed, ["__h", "row_id"], "__at")
        n = int(df.count() * test_size)
        return numbered.withColumn("split", F.when(F.col("__at") < n, "test").otherwise("train")).drop("__h", "__at")
    at = Window.partitionBy(stratify, "__slice").orderBy("__h", "row_id")
    keyed = keyed.withColumn("__slice", F.floor(F.col("__h") / (1 << 22)))  # a thousandth of a stratum is sorted at once
    slices = keyed.groupBy(stratify, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(stratify)
    before = F.sum("__n").over(whole.orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    slices = slices.select(F.col(stratify).alias("__st"), F.col("__slice").alias("__sl"), before.alias("__before"), F.sum("__n").over(whole).alias("__all"))
    out = keyed.join(slices, F.col(stratify).eqNullSafe(F.col("__st")) & (F.col("__slice") == F.col("__sl")))
    place = F.col("__before") + F.row_number().over(at) - 1
    out = out.withColumn("split", F.when(place < F.floor(F.col("__all") * test_size), "test").otherwise("train"))
    return out.drop("__h", "__slice", "__st", "__sl", "__before", "__all")


def balanced_split(df: DataFrame, label: str, share: float = 0.8, seed: int | str = 42) -> DataFrame:
    """``split`` 'train' for the given share of the positives and as many negatives, else 'test'."""
    drawn = df.withColumn("__h", draw(seed, F.col("row_id")))
    sizes = {bool(r[0]): r[1] for r in df.groupBy(F.col(label) == 1).count().collect() if r[0] is not None}
    n = int(sizes.get(True, 0) * share)
    parts = []
    for positive in (True, False):
        side = drawn.filter((F.col(label) == 1) == F.lit(positive))
        parts.append(with_row_id(side, ["__h", "row_id"], "__at"))
    out = parts[0].unionByName(parts[1])
    return out.withColumn("split", F.when(F.col("__at") < n, "train").otherwise("test")).drop("__h", "__at")


def chronological_split(df: DataFrame, at: str, train: float | None = None, before: str | None = None) -> DataFrame:
    """``split`` by time: 'train' for the earliest share (ties by time go together), or for all before a moment."""
    if (train is None) == (before is None):
        raise ValueError("give either a share or a moment")
    if before is not None:
        return df.withColumn("split", F.when(F.col(at) < F.lit(before).cast(dict(df.dtypes)[at]), "train").otherwise("test"))
    days = df.groupBy(F.col(at).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    along = Window.orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)
    days = days.select("__t", (F.sum("__n").over(along) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    out = df.join(days, F.col(at) == F.col("__t"))
    return out.withColumn("split", F.when(F.col("__before") < train * F.col("__all"), "train").otherwise("test")).drop("__t", "__before", "__all")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, weight``: rows over classes times the class's rows."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    return counts.select("label", "n", (F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))).alias("weight"))


def recency_weights(df: DataFrame, age: str, decay: float) -> DataFrame:
    """``weight`` is exp(decay * age) over its mean."""
    mean = df.agg(F.avg(F.exp(F.lit(decay) * F.col(age)))).first()[0]
    return df.withColumn("weight", F.exp(F.lit(decay) * F.col(age)) / F.lit(mean))


def winsorised(df: DataFrame, features: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values beyond the interpolated percentiles are set to them."""
    ends = df.agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(c) for c in features]).first()
    return df.select(*[F.least(F.greatest(F.col(c), F.lit(ends[c][0])), F.lit(ends[c][1])).alias(c) if c in features and ends[c] else F.col(c) for c in df.columns])


def sentinels_to_null(df: DataFrame, columns: Sequence[str], values: Sequence[float]) -> DataFrame:
    return df.select(*[F.when(~F.col(c).isin(list(values)), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def cut(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the interval (edges[i], edges[i+1]] that holds the value."""
    out = F.lit(None).cast("string")
    for lo, hi, label in zip(edges, edges[1:], labels):
        out = F.when((value > lo) & (value <= hi), label).otherwise(out)
    return out


def one_hot(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values])


def ratio(a: Column, b: Column) -> Column:
    """a over b; null where b is 0."""
    return F.when(b != 0, a / b)
