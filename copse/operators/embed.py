"""Low-dimensional coordinates of proximity: classical scaling, low-rank factors, k-means."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.functions.portable import uniform
from copse.operators.proximity import finished_proximity, kind_proximity
from copse.plans.storage import materialised


def weighed(leaves: DataFrame, casewise: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``row_id, kind, size`` of the rows, kinds as ``row_id, size``, and ``i, j, p, w`` of kinds.

    A row has the same proximity to all ``w`` rows of a kind, and 1 with itself but nothing with its own
    kind. So P times a vector that is the same within kinds is a product over kinds, and its leading
    eigenvectors are such vectors: all others, that sum to 0 within each kind, have the eigenvalue 1.
    """
    kinds, pairs = kind_proximity(leaves, casewise)
    sizes = kinds.filter("row_id = kind").select("row_id", "size")
    many = pairs.join(sizes.select(F.col("row_id").alias("j"), F.col("size").alias("w")), "j").select("i", "j", "p", "w")
    own = sizes.select(F.col("row_id").alias("i"), F.col("row_id").alias("j"), F.lit(1.0).alias("p"), F.lit(1).cast("long").alias("w"))
    return kinds, sizes, materialised(many.union(own), "kind-pairs")


def _spread(kinds: DataFrame, by_kind: DataFrame) -> DataFrame:
    names = [c for c in by_kind.columns if c != "row_id"]
    return kinds.select("row_id", "kind").join(by_kind.withColumnRenamed("row_id", "kind"), "kind").select("row_id", *names)


def _sized(rows: DataFrame) -> DataFrame:
    """``row_id, size``; 1 where there is no size."""
    return rows.select("row_id", (F.col("size") if "size" in rows.columns else F.lit(1)).cast("double").alias("size"))


def _weight(pairs: DataFrame) -> Column:
    return F.col("w").cast("double") if "w" in pairs.columns else F.lit(1.0)


def squared_distances(pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, float, float]:
    """Row sums of squared distances max - p, without listing pairs of proximity 0.

    Returns the entries ``i, j, e`` by which a pair's squared distance differs from max
    squared (times the pair's ``w``, if it has one), ``row_id, size, m`` row means, their mean, and max.
    """
    top = pairs.agg(F.max("p")).first()[0] or 0.0
    rows = _sized(rows)
    n = max(rows.agg(F.sum("size")).first()[0] or 0.0, 1.0)
    differs = pairs.select("i", "j", (_weight(pairs) * (F.when(F.col("i") == F.col("j"), 0.0).otherwise((F.lit(top) - F.col("p")) ** 2) - F.lit(top * top))).alias("e"))
    sums = differs.groupBy(F.col("i").alias("row_id")).agg(F.sum("e").alias("e"))
    means = materialised(rows.join(sums, "row_id", "left").select("row_id", "size", (F.lit(top * top) + F.coalesce("e", F.lit(0.0)) / n).alias("m")), "means")
    return differs, means, (means.agg(F.sum(F.col("m") * F.col("size"))).first()[0] or 0.0) / n, top


def leaf_scaling(leaves: DataFrame, k: int = 3, casewise: bool = False, **how) -> DataFrame:
    """What :func:`scaling` gives for the rows' finished proximity, from kinds of rows.

    Where too few kinds lead (others have half the squared maximum as eigenvalue), rows are asked.
    """
    kinds, sizes, pairs = weighed(leaves, casewise)
    if sizes.count() > k + 4:
        top = pairs.agg(F.max("p")).first()[0] or 0.0
        found, least = _scaling(pairs, sizes, k, **how)
        if least > top * top / 2:
            return _spread(kinds, materialised(found, "axes"))
    return scaling(finished_proximity(leaves, casewise), kinds.select("row_id"), k, **how)


def leaf_factors(leaves: DataFrame, rank: int = 32, casewise: bool = False, **how) -> DataFrame:
    """What :func:`factors` gives for the rows' finished proximity, from kinds of rows. Where fewer kinds than factors lead (others have the eigenvalue 1), rows are asked."""
    kinds, sizes, pairs = weighed(leaves, casewise)
    if sizes.count() > rank:
        found, least = _factors(pairs, sizes, rank, **how)
        if least > 1:
            return _spread(kinds, materialised(found, "factors"))
    return factors(finished_proximity(leaves, casewise), kinds.select("row_id"), rank, **how)


def scaling(pairs: DataFrame, rows: DataFrame, k: int = 3, rounds: int = 60, seed: int | str = 1) -> DataFrame:
    """``row_id, c0, ..., c{k-1}``: coordinates of classical scaling of distances max - p.

    ``pairs`` (i, j, p) holds both directions and the diagonal; what is not listed is 0. The
    doubly centred matrix is never built: its product with a vector is the product of the
    listed entries, corrected by row means. Subspace iteration finds the leading
    eigenvectors; only k by k matrices reach the driver. Axes of an eigenvalue that is not
    positive are left out with an error. Eigenvalues that have not
    converged after ``rounds`` rounds give a warning.
    """
    return _scaling(pairs, rows, k, rounds, seed)[0]


def _scaling(pairs: DataFrame, rows: DataFrame, k: int, rounds: int = 60, seed: int | str = 1) -> tuple[DataFrame, float]:
    """The coordinates and the least eigenvalue taken; rows count by their ``size``, pairs by their ``w``."""
    import numpy as np

    n = rows.count()
    if n < k + 1:
        raise ValueError(f"{k} axes need more than {k} rows")
    differs, means, grand, top = squared_distances(pairs, rows)
    differs = materialised(differs, "entries")
    q = min(n, k + 4)
    names = [f"v{t}" for t in range(q)]
    v = materialised(means.select("row_id", "size", "m", *[(uniform(seed, t, F.col("row_id")) - 0.5).alias(names[t]) for t in range(q)]), "vectors")

    def product(v: DataFrame) -> DataFrame:
        """B v with B = -1/2 (D - m_i - m_j + grand)."""
        total = v.agg(*[F.sum(F.col("size") * F.col(c)).alias(c) for c in names], *[F.sum(F.col("size") * F.col("m") * F.col(c)).alias(f"m{c}") for c in names]).first()
        sparse = differs.join(v.select(F.col("row_id").alias("j"), *names), "j").groupBy(F.col("i").alias("row_id")).agg(*[F.sum(F.col("e") * F.col(c)).alias(f"s{c}") for c in names])
        out = v.select("row_id", "size", "m").join(sparse, "row_id", "left")
        return out.select("row_id", "size", "m", *[
            (-0.5 * (F.coalesce(F.col(f"s{c}"), F.lit(0.0)) + F.lit(top * top * total[c]) - F.col("m") * total[c] - F.lit(total[f"m{c}"]) + F.lit(grand * total[c]))).alias(c)
            for c in names])

    def gram(v: DataFrame, w: DataFrame | None = None) -> np.ndarray:
        both = v if w is None else v.join(w.select("row_id", *[F.col(c).alias(f"w{c}") for c in names]), "row_id")
        pre = "" if w is None else "w"
        row = both.agg(*[F.sum(F.col("size") * F.col(a) * F.col(f"{pre}{b}")) for a in names for b in names]).first()
        return np.array(row, float).reshape(q, q)

    def mixed(v: DataFrame, m: np.ndarray) -> DataFrame:
        return v.select("row_id", "size", "m", *[sum((F.col(names[a]) * float(m[a, b]) for a in range(q)), F.lit(0.0)).alias(names[b]) for b in range(q)])

    def orthonormal(v: DataFrame) -> DataFrame:
        values, vectors = np.linalg.eigh(gram(v))
        keep = np.maximum(values, values.max() * 1e-14)
        return mixed(v, vectors / np.sqrt(keep))

    last = None
    for _ in range(rounds):
        v = materialised(orthonormal(v), "vectors")
        w = materialised(product(v), "vectors")
        values = np.sort(np.linalg.eigvalsh((lambda g: (g + g.T) / 2)(gram(v, w))))[::-1][:k]
        if last is not None and np.all(np.abs(values - last) <= 1e-9 * np.abs(values).max()):
            break
        last, v = values, w
    else:
        warnings.warn(f"scaling: eigenvalues had not converged after {rounds} rounds", stacklevel=2)
    v = materialised(orthonormal(v), "vectors")
    w = product(v)
    g = gram(v, w)
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    order = np.argsort(values)[::-1][:k]
    if values[order].min() <= 1e-12:
        raise ValueError(f"fewer than {k} positive eigenvalues")
    axes = vectors[:, order] * np.sqrt(values[order])
    # Signs are free; the axis is turned so that its largest entry's side is positive by the sum of cubes.
    out = v.select("row_id", "size", *[sum((F.col(names[a]) * float(axes[a, b]) for a in range(q)), F.lit(0.0)).alias(f"c{b}") for b in range(k)])
    cubes = out.agg(*[F.sum(F.col("size") * F.col(f"c{b}") ** 3) for b in range(k)]).first()
    return out.select("row_id", *[(F.col(f"c{b}") * (-1.0 if (cubes[b] or 0.0) < 0 else 1.0)).alias(f"c{b}") for b in range(k)]), float(values[order].min())


def factors(pairs: DataFrame, rows: DataFrame, rank: int = 32, rounds: int = 30, seed: int | str = 1) -> DataFrame:
    """``row_id, f0, ..., f{rank-1}``: P is about the product of the factors with themselves (the leading positive eigenpairs)."""
    return _factors(pairs, rows, rank, rounds, seed)[0]


def _factors(pairs: DataFrame, rows: DataFrame, rank: int, rounds: int = 30, seed: int | str = 1) -> tuple[DataFrame, float]:
    """The factors and the least size of an eigenvalue; rows count by their ``size``, pairs by their ``w``."""
    import numpy as np

    names = [f"v{t}" for t in range(rank)]
    rows = _sized(rows)
    entries = materialised(pairs.select("i", "j", (F.col("p") * _weight(pairs)).alias("p")), "entries")
    v = materialised(rows.select("row_id", "size", *[(uniform(seed, t, F.col("row_id")) - 0.5).alias(names[t]) for t in range(rank)]), "vectors")

    def turned(v: DataFrame, m: np.ndarray, out: list[str]) -> DataFrame:
        return v.select("row_id", "size", *[sum((F.col(names[a]) * float(m[a, b]) for a in range(rank)), F.lit(0.0)).alias(out[b]) for b in range(len(out))])

    def gram(v: DataFrame) -> np.ndarray:
        return np.array(v.agg(*[F.sum(F.col("size") * F.col(a) * F.col(b)) for a in names for b in names]).first(), float).reshape(rank, rank)

    def product(v: DataFrame) -> DataFrame:
        sums = entries.join(v.select(F.col("row_id").alias("j"), *names), "j").groupBy(F.col("i").alias("row_id")).agg(*[F.sum(F.col("p") * F.col(c)).alias(c) for c in names])
        return rows.join(sums, "row_id", "left").fillna(0.0)

    for _ in range(rounds):
        values, vectors = np.linalg.eigh(gram(v))
        v = materialised(turned(v, vectors / np.sqrt(np.maximum(values, max(values.max(), 1e-300) * 1e-14)), names), "vectors")
        w = materialised(product(v), "vectors")
        both = v.join(w.select("row_id", *[F.col(c).alias(f"w{c}") for c in names]), "row_id")
        t = np.array(both.agg(*[F.sum(F.col("size") * F.col(a) * F.col(f"w{b}")) for a in names for b in names]).first(), float).reshape(rank, rank)
        basis, v = v, w
    values, vectors = np.linalg.eigh((t + t.T) / 2)
    order = np.argsort(values)[::-1]
    return turned(basis, vectors[:, order] * np.sqrt(np.maximum(values[order], 0.0)), [f"f{b}" for b in range(rank)]).drop("size"), float(np.abs(values).min())


def scaling_of_factors(factor_rows: DataFrame, k: int = 3) -> DataFrame:
    """``row_id, c0, ...``: the leading axes of centred factors, from their covariance (rank by rank)."""
    import numpy as np

    names = [c for c in factor_rows.columns if c != "row_id"]
    mean = factor_rows.agg(*[F.avg(c) for c in names]).first()
    centred = factor_rows.select("row_id", *[(F.col(c) - F.lit(float(m or 0.0))).alias(c) for c, m in zip(names, mean)])
    g = np.array(centred.agg(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names]).first(), float).reshape(len(names), len(names))
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(values)[::-1][:k]
    return centred.select("row_id", *[sum((F.col(names[a]) * float(vectors[a, o]) for a in range(len(names))), F.lit(0.0)).alias(f"c{b}") for b, o in enumerate(order)])


def elbow_clusters(points: DataFrame, columns: list[str], most: int = 8, least_gain: float = 0.05, seed: int = 42) -> tuple[DataFrame, int]:
    """Points with ``cluster`` for the first k after which the cost falls by less than ``least_gain``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=columns, outputCol="__x").transform(points)
    before, model = None, None
    for k in range(2, most + 1):
        fitted = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="cluster").fit(data)
        cost = fitted.summary.trainingCost
        if before is not None and (before <= 0 or (before - cost) / before < least_gain):
            break
        before, model = cost, fitted
    return model.transform(data).drop("__x"), model.getK() if hasattr(model, "getK") else len(model.clusterCenters())
