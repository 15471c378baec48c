"""Quality rules whose cutoffs are chosen under a guarantee.

Each rule refuses documents whose signal exceeds a cutoff. The rules' cutoffs form a ladder: step
by step each rule's gets stricter, so what a step refuses the next one refuses too. On labelled documents (all of them
held out, as nothing else is learnt from them), and for each stratum, the false rejections of a whole step
(good documents that any rule refuses) are tested against the allowed rate with the exact
binomial tail. Steps are tested from the loosest to the strictest and the last before the first
failure is used (a fixed sequence needs no correction); over strata the level is divided (Bonferroni).
So with probability ``1 - delta`` no stratum loses more than ``alpha`` of its good documents to the rules. A
stratum in which no step passes has no rule; the least number of good labels that can prove anything is
log(strata / delta) / -log(1 - alpha), 217 for four strata.

Signals are computed once, row by row, in DataFrame functions: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm._shared import SPACE, WORD, table, text_of, written

WINDOW = 8

#: Cutoffs of each rule's signal, loosest first.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.0, 0.5, 0.3, 0.2, 0.1),
    "dup_line_share": (0.9, 0.7, 0.5, 0.4, 0.3),
    "repeat_word_share": (0.9, 0.7, 0.5, 0.3, 0.2, 0.15),
    "word_length": (30.0, 20.0, 15.0, 12.0),
}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, though the lambdas inside refer to it often."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words that the text holds twice or more."""
    zero = F.lit(0)

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(zero, F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(ordered: Column) -> Column:
        same = lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(ordered, lambda x, i: F.coalesce(same(x, i), F.get(ordered, i + 1)["h"] == x["h"], F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))), lambda x: x["at"]))

    def repeated(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), bound(bound(ordered, twice), covered)).otherwise(F.lit(0).cast("long"))

    hashed = bound(F.transform(words, lambda w: F.xxhash64(w)), lambda x: bound(windows(x), repeated))
    return F.when(F.size(words) > WINDOW, hashed).otherwise(F.lit(0).cast("long"))


def signals(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each whole text.

    Null and empty texts have 0 of each. Words are runs of other than ASCII white space,
    lines are split at \\n and count if they hold a word.
    """
    text = text_of()
    rows = docs.select(*keep, text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    return rows.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    ).select(*keep, "n_words", "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words")


def ratio(rule: str) -> Column:
    """The signal of a rule; 0 where the text has no word or line."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols_per_word": over("n_symbols", "n_words"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_word_share": over("n_repeat_words", "n_words"),
        "word_length": over("word_chars", "n_words"),
    }[rule]


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x >= 1, by Stirling's series from x + 8 on."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + 0.918938533204672741780 + series - shift


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X of n draws at ``rate``, exactly: the term of k, and from it downwards the terms of k-1, ..., 0.

    1 where k is not below the mean, which no level asked for here accepts.
    """
    import math

    n, k = n.cast("double"), k.cast("double")
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate))
    step = lambda acc, i: F.struct(
        (acc["sum"] + acc["term"] * i * ((1 - rate) / rate) / (n - i + 1)).alias("sum"),
        (acc["term"] * i * ((1 - rate) / rate) / (n - i + 1)).alias("term"),
    )
    down = F.when(k >= 1, F.transform(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), lambda j: k - j)).otherwise(F.array().cast("array<double>"))
    total = F.aggregate(down, F.struct(top.alias("sum"), top.alias("term")), step, lambda acc: acc["sum"])
    return F.when(n <= 0, 1.0).when(k >= n * rate, 1.0).otherwise(F.least(total, F.lit(1.0)))


def ladder(cutoffs: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    """Each step's cutoff by rule; a rule with fewer cutoffs stays at its last."""
    return [{r: float(cs[min(i, len(cs) - 1)]) for r, cs in cutoffs.items() if cs} for i in range(max(map(len, cutoffs.values()), default=0))]


def choose_cutoffs(
    rows: DataFrame, labels: DataFrame, stratum: str, cutoffs: Mapping[str, Sequence[float]] = CUTOFFS, alpha: float = 0.02, delta: float = 0.05,
) -> DataFrame:
    """``stratum, step, n_good, n_refused, tail`` of the step in use in each stratum that has one, from signals and labels (doc_id, quality).

    Labelled documents that fail the base rules are no evidence, as the base refuses them
    anyway. A doc_id labelled twice counts as good only if all its labels say so.
    """
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).filter("doc_id is not null and quality = 1").select("doc_id")
    seen = rows.filter(~base_failed()).join(good, "doc_id", "left_semi")
    counts = [F.sum(refused(step).cast("long")).alias(f"step{i}") for i, step in enumerate(ladder(cutoffs))]
    wide = seen.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_good"), *counts)
    tests = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"step{i}").alias("n_refused")) for i in range(len(counts))]))
    long = wide.select(stratum, "n_good", tests.alias("t")).select(stratum, "n_good", "t.*")
    strata = rows.select(stratum).distinct().agg(F.count(F.lit(1)).alias("strata"))
    long = long.withColumn("tail", binomial_tail(F.col("n_good"), F.col("n_refused"), alpha)).crossJoin(F.broadcast(strata))  # one row
    passed = F.col("tail") <= F.lit(delta) / F.col("strata")
    used = long.groupBy(stratum).agg(
        F.min(F.when(~passed, F.col("step"))).alias("fails_at"), F.sort_array(F.collect_list(F.struct("step", "n_good", "n_refused", "tail"))).alias("steps"))  # a row a step
    used = used.withColumn("u", F.get("steps", F.coalesce(F.col("fails_at"), F.size("steps")) - 1)).filter("u is not null")
    return used.select(stratum, "u.step", "u.n_good", "u.n_refused", "u.tail")


def refused(step: Mapping[str, float]) -> Column:
    """Whether any rule refuses the document at this step of the ladder."""
    out = F.lit(False)
    for r, c in step.items():
        out = out | (ratio(r) > c)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how) -> DataFrame:
    """Signals and verdict of each document: ``doc_id, stratum, n_words, ..., base_failed, kept``.

    Null and empty texts fail the base (under 20 words). A null doc_id is judged like any
    other but never joins a label; a null stratum is a stratum of its own; repeated rows
    are judged alike. Without labels no cutoff is in use and the base alone decides. Extra
    columns are not read. An empty table gives an empty table.
    """
    return _judged(docs, labels, stratum, **how).drop("digest")


def _digest(stratum: str) -> Column:
    return F.xxhash64(F.col("text").cast("string"), F.col(stratum).cast("string"))


def _judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how) -> DataFrame:
    """The rows of :func:`quality_rules` with ``digest`` of the text and the stratum."""
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__s": F.col(stratum).cast("string"), "__d": _digest(stratum)})
    rows = rows.select(F.col("__id").alias("doc_id"), F.col("__s").alias("stratum"), F.col("__d").alias("digest"), "text")
    rows = written(signals(rows, "doc_id", "stratum", "digest"), "signals")
    # One row a stratum: strata are few, the join decides by measured size.
    chosen = written(choose_cutoffs(rows, labels, "stratum", **how), "cutoffs").select(F.col("stratum").alias("__s"), F.col("step").alias("__step"))
    out = rows.join(chosen, F.col("stratum").eqNullSafe(F.col("__s")), "left")
    steps = ladder(how.get("cutoffs", CUTOFFS))
    bad = F.lit(False)
    for i, step in enumerate(steps):  # a step refuses what the ones before it refuse
        bad = bad | ((F.coalesce("__step", F.lit(-1)) >= i) & refused(step))
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~bad).drop("__s", "__step")


def op4_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go, each by its doc_id and text. A row without a doc_id is judged by the base alone."""
    verdict = _judged(docs, table(spark, sf_dir, "labels"))
    gone = verdict.filter("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__text")).distinct()
    left = docs.join(gone, (docs["doc_id"] == F.col("__gone")) & (_digest("lang") == F.col("__text")), "left_anti")
    named, bare = left.filter("doc_id is not null"), left.filter("doc_id is null")
    columns = list(docs.columns)
    bare = signals(bare.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in columns])), "__row").filter(~base_failed()).select("__row.*")
    return named.unionByName(bare)


_RULES = {
    "symbols_per_word": "CASE WHEN n_words > 0 THEN n_symbols / n_words::DOUBLE ELSE 0 END",
    "dup_line_share": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines::DOUBLE ELSE 0 END",
    "repeat_word_share": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words::DOUBLE ELSE 0 END",
    "word_length": "CASE WHEN n_words > 0 THEN word_chars / n_words::DOUBLE ELSE 0 END",
}

ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, ws[i:i + 7] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lined AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
f AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN lined USING (doc_id) LEFT JOIN covered USING (doc_id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
signals AS (SELECT doc_id, lang, base_failed, unnest([{", ".join(f"{{'rule': '{r}', 'x': {x}}}" for r, x in _RULES.items())}], recursive := true) FROM g),
cutoffs AS (SELECT unnest([{", ".join(f"{{'rule': '{r}', 'step': {i}, 'cutoff': {c}::DOUBLE}}" for i, step in enumerate(ladder(CUTOFFS)) for r, c in step.items())}], recursive := true)),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
judged AS (SELECT doc_id, lang, base_failed, step, bool_or(x > cutoff) AS bad FROM signals JOIN cutoffs USING (rule) GROUP BY ALL),
counted AS (SELECT lang, step, count(*) AS n, count(*) FILTER (bad) AS k FROM judged JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
tested AS (SELECT *, CASE WHEN k >= n * 0.02 THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i:
              exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(1 - 0.02)))) END
              <= 0.05 / (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents)) AS passed FROM counted),
used AS (SELECT lang, max(step) AS step FROM (SELECT *, bool_and(passed) OVER (PARTITION BY lang ORDER BY step) AS ok FROM tested) WHERE ok GROUP BY lang),
refused AS (SELECT DISTINCT doc_id FROM judged j JOIN used u ON j.step = u.step AND j.lang IS NOT DISTINCT FROM u.lang WHERE bad)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM refused) AS kept
FROM g
"""
