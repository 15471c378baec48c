"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two values, its minimum and its maximum,
so a signature of 2K values costs K hash evaluations a shingle and its match rate is an
unbiased estimate of the Jaccard similarity with less variance than 2K minima. Bands of
the signature propose pairs; every link is confirmed on the full shingle sets.

How a crowded band is searched without all its pairs: documents with equal sets are
one class first. Then every class is compared with the hub of each of its bands, the
member whose bands are the most crowded (the original of a family of near copies).
Only bands that still hold several components compare members across components, in
blocks that return a forest. So every candidate pair is either confirmed or refused on its
full sets, or its ends are already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm._shared import table, text_of, written
from copse.llm.components import connected_components

PERMUTATIONS = 63
_MEMO = 400_000
BLOCK_SHINGLES = 500_000


class WordHashes(dict):
    """64-bit hash by word; kept between texts and emptied when it grows past a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than ``size``: the whole sequence as one; none: empty."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signature(shingles: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Minimum and maximum of the shingles under each permutation, side by side: 2 * permutations values."""
    a, b = _factors(permutations)
    low = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(permutations, np.uint64)
    for at in range(0, len(shingles), 1024):
        x = shingles[None, at : at + 1024] * a[:, None] + b[:, None]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_rows(threshold: float, values: int = 2 * PERMUTATIONS, miss: float = 1e-3) -> int:
    """The most rows a band may have for a pair at the threshold to be missed by all bands with chance ``miss`` at most."""
    return max(r for r in range(1, 17) if r == 1 or (1 - threshold**r) ** (values // r) <= miss)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band, different between bands."""
    n = len(sig) // rows
    parts = sig[: n * rows].reshape(n, rows)
    out = np.arange(1, n + 1, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return out


def _signed(batches: Iterator[pa.RecordBatch], size: int, rows: int) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        n, keys, found = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text, size, words)
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            found.append(bands(signature(s), rows).view(np.int64) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
            ["doc_id", "digest", "n_shingles", "class", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        sets = [shingle_set(t, size, words) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), batch.column("class"), pa.array([s.tobytes() for s in sets], pa.binary())],
            ["found", "class", "shingles"],
        )


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``class, shingles`` of the wanted classes, from the text of each one's first document."""
    first = wanted.distinct().join(classes.select("class", "first_id"), "class")
    texts = docs.select(F.col("doc_id").alias("first_id"), "text").join(first, "first_id")
    sets = texts.select("class", "text").mapInArrow(lambda it: _sets(it, size), "found binary, class binary, shingles binary")
    return written(sets.filter("found = class").select("class", "shingles").dropDuplicates(["class"]), "sets")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose full shingle sets reach the threshold."""
    sets = full_sets(pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))), classes, docs, size)
    joined = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(lambda it: _confirmed(it, percent), "a binary, b binary")


def _block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between components within two blocks of a band, as a forest: no link whose ends are connected already."""
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    holders, ends = owner[order], np.cumsum(np.bincount(shingle))
    block, classes = rows["block"].to_numpy(), rows["class"].tolist()
    up = {r: r for r in rows["root"]}

    def top(r):
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    roots, out, at = rows["root"].tolist(), [], np.cumsum(sizes) - sizes
    for v in range(len(sets)):
        if i != j and block[v] != i:
            continue
        mine = shingle[at[v] : at[v] + sizes[v]]
        both = np.bincount(np.concatenate([holders[ends[s - 1] if s else 0 : ends[s]] for s in mine]), minlength=len(sets))
        near = 100 * both >= percent * (sizes + sizes[v] - both)
        near[v] = False
        if i != j:
            near &= block != i
        for u in np.flatnonzero(near):
            x, y = top(roots[v]), top(roots[u])
            if x != y:
                up[x] = y
                out.append((classes[v], classes[u]))
    return pd.DataFrame(out, columns=["a", "b"])


def blockwise(left: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components in bands ``(band, class, n, root, mass)``.

    A band's members are dealt into blocks of bounded mass (shingles) and each pair of blocks is
    searched by one task, which returns a forest. Every pair of members of other components is
    compared on its full sets; what grows is a row for each member and block, not for each pair.
    """
    blocks = F.ceil(F.col("mass") / BLOCK_SHINGLES).cast("int")
    rows = left.withColumn("block", F.pmod(F.hash("class"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("band", "class", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.join(full_sets(left.select("class"), classes, docs, size), "class")
    return rows.groupBy("band", "i", "j").applyInPandas(lambda r: _block_links(r, percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if ``100 * |intersection| >= percent * |union|`` of their sets of
    distinct ``shingle``-word shingles (ASCII lower case, ASCII white space); a text with
    fewer words has its whole sequence as one shingle. ``component_id`` is the least doc_id
    reachable, ``kept`` says whether that is the document itself.

    Null and empty texts: an empty set, linked with nothing, kept. Null doc_id: the row
    takes part in no group and is kept with a null component_id. Rows that repeat a doc_id
    with one text are one document repeated: all have the same component. Extra columns are
    not read. An empty table gives an empty table.
    """
    return _grouped(docs, shingle, percent).drop("digest", "root")


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The rows of :func:`near_duplicates` with ``digest`` of the text and ``root``, the group (null without words)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(text_of()).alias("digest"))
    rows = band_rows(percent / 100)
    signed = written(docs.mapInArrow(lambda it: _signed(it, shingle, rows), "doc_id long, digest long, n_shingles long, class binary, bands array<long>"), "signed")
    named = signed.filter("class is not null and doc_id is not null")
    classes = named.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"))
    classes = written(classes, "classes")

    crowded = written(
        classes.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1"), "crowded")
    members = classes.select("class", "n", F.explode("bands").alias("band")).join(crowded, "band")
    weight = members.groupBy("class").agg(F.sum("crowd").alias("weight"))
    members = written(members.join(weight, "class").select("band", "class", "n", "weight"), "members")

    close = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    hubs = members.groupBy("band").agg(F.max(F.struct("weight", "class", "n")).alias("hub")).select("band", F.col("hub.class").alias("hub"), F.col("hub.n").alias("m"))
    stars = members.join(hubs, "band").filter(f"class <> hub and {close}").select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()
    stars = written(stars, "stars")
    links = written(confirm(stars, classes, docs, shingle, percent), "confirmed")
    found = written(connected_components(links), "components")

    # What the hubs have not connected: members of other components in the same band, block against block.
    placed = members.join(found.withColumnRenamed("node", "class"), "class", "left").select("band", "class", "n", F.coalesce("root", "class").alias("root"))
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("crowd"), F.sum("n").alias("mass"))
    left = written(placed.join(split.filter("lo <> hi and crowd > 2").select("band", "mass"), "band"), "left")
    if not left.isEmpty():
        links = links.union(blockwise(left, classes, docs, shingle, percent))
        found = written(connected_components(links), "components")

    ids = classes.join(found.withColumnRenamed("node", "class"), "class", "left").select("class", "first_id", F.coalesce("root", "class").alias("root"))
    least = ids.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = ids.join(least, "root").select("class", "component_id", "root")
    out = signed.select("doc_id", "digest", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")).join(of_class, "class", "left")
    out = out.select("doc_id", "digest", "root", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays (five-word shingles, similarity 0.8).

    A row is known by its doc_id and a digest of its text: repeated rows stay once, other texts
    under the same doc_id are judged on their own. Rows without a doc_id stay.
    """
    found = written(_grouped(docs, 5, 80).filter("doc_id is not null").select("doc_id", "digest", "root", "kept"), "verdicts")
    group = F.coalesce("root", F.col("digest").cast("string").cast("binary"))
    stay = found.filter("kept").groupBy("doc_id", group.alias("group")).agg(F.min("digest").alias("digest")).select("doc_id", "digest")
    gone = found.select("doc_id", "digest").distinct().join(stay, ["doc_id", "digest"], "left_anti").toDF("__gone", "__text")
    keyed = docs.withColumn("__digest", F.xxhash64(text_of()))
    left = keyed.join(gone, (F.col("doc_id") == F.col("__gone")) & (F.col("__digest") == F.col("__text")), "left_anti")
    return left.filter("doc_id is not null").dropDuplicates(["doc_id", "__digest"]).unionByName(left.filter("doc_id is null")).drop("__digest")


#: All pairs with a shingle in common, and all that can be reached.
ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least_of AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)"""
