"""Fuzzy line deduplication over all documents, in DataFrame functions only.

Lines are normalised to lower-case words. Two lines are linked if the edit similarity of their
words (1 less the edit distance over the longer length) reaches SIMILARITY. A 64-bit SimHash of
a line's distinct words refuses a pair that differs in more than MOST_BITS bits before its words are
compared: lines at the similarity differ in some 13 bits, give or take 3. Where all pairs of a key are
compared, a pair must agree in 256 parities of its words, too, as far as the allowed edits can change
them: an exact bound, so that lines around a passage that many share make no pairs, and no link is lost.

Blocks of the SimHash cannot propose such pairs: with 13 bits changed, hardly a block of 16 is
whole, and smaller ones tell no lines apart. Instead a line's keys are hashes of its runs of three
words. A line of up to ALL words has all its runs (and runs of two, under eight words); lines at
the similarity always share one of them. A longer line has its first run and those of its
runs with long words whose hash is below a bound that gives KEYS of them; about half the runs of two lines
at the similarity agree, so they miss each other with a chance of some 5 %, nearer ones hardly ever. Where
a run stands tells a pair, too: the words before it and those after it may differ in number by
the allowed edits only.

How crowded keys are searched: lines with equal words are one class first. Every class is compared
with the hub of each of its keys, the class whose keys are the most crowded. Where that leaves
several components, more hubs are drawn for the keys concerned that hold more than DENSE rows (at most
ROUNDS times). Then those that share a key of up to CROWD classes are compared with each other, and those
of more crowded keys are proposed again by prefixes: of all runs, ordered from the rarest, two lines
at the similarity share one among the first six tenths. Runs that many lines hold come last and count
only for lines made of little else; of these, what hubs do not connect is compared whole.

Of each connected group of lines one occurrence is kept, the first by doc_id and line number.
Lines under LEAST_WORDS words go only if all words are equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copse.llm._shared import WORD, drop_tables, maybe_broadcast, table, text_of, written
from copse.llm.components import connected_components

MOST_BITS, SIMILARITY, LEAST_WORDS = 21, 0.8, 5
KEYS, ALL, CROWD, FEATURES = 6, 16, 2048, 0x7FFF
DENSE, ROUNDS = 8, 3
PARITIES = ("p0", "p1", "p2", "p3")


_ASCII = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OTHER = r"[^\p{L}\p{M}\p{N}]+"
_UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def words_of(line: Column) -> Column:
    """Lower-case words: runs of letters, marks and digits.

    In lines of more than two bytes a character, each character of a script that is written
    without spaces is a word.
    """
    low, size, chars = F.lower(line), F.octet_length(line), F.length(line)
    wide = F.split(F.regexp_replace(low, _UNSPACED, " $1 "), _OTHER)
    words = F.when(size == chars, F.split(low, _ASCII)).when(size <= 2 * chars, F.split(low, _OTHER)).otherwise(wide)
    return F.array_remove(words, "")


def _document() -> list[Column]:
    """A document's key: its id (null least) and a digest of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text_of()).alias("k2")]


def _run(at: Column, words: int) -> Column:
    return F.xxhash64(*[F.get("words", at + k) for k in range(words)])


def _runs(rows: DataFrame, sampled: bool, least_words: int, *keep: str) -> DataFrame:
    """The kept columns of lines (``words``) with ``n`` words, and a row for each run of words that is a ``key``, at word ``i``, and one with null.

    Everything is made row by row in generated code: a generator counts through the runs.
    """
    n = F.size("words")
    rows = rows.withColumn("bytes", F.octet_length(F.array_join("words", "")))
    last = F.when(n < least_words, -1).when(n < 8, 2 * n - 4).otherwise(n - 3)
    rows = rows.select(*keep, "words", "bytes", n.alias("n"), F.explode(F.sequence(F.lit(-1), F.greatest(last, F.lit(-1)))).alias("i"))
    n, i = F.col("n"), F.col("i")
    if sampled:
        long = sum((F.octet_length(F.get("words", i + k)) for k in (1, 2)), F.octet_length(F.get("words", i))) * n >= 3 * F.col("bytes")
        rows = rows.filter((i <= 0) | (n <= ALL) | long)
    key = F.when((i >= 0) & (i <= n - 3), _run(i, 3)).when((i >= 0) & (i > n - 3), _run(i - n + 2, 2))
    rows = rows.select(*keep, "n", "i", key.alias("key"))
    if sampled:
        below = F.shiftrightunsigned("key", 1) < F.lit(float(1 << 63) * 2 * KEYS) / n
        rows = rows.filter((i <= 0) | (n <= ALL) | below)
    place = F.when(i <= n - 3, i).otherwise(i - n + 2).alias("i")
    return rows.select(*keep, "n", place, "key")


def line_keys(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``k1, k2, pos, lid, n, i, key``: digest and number of words of each line with a word, once with a null key and, without k1, k2 and pos, once with each of its keys and its place.

    Words come out of a generator, so that no later condition makes them a second time.
    """
    rows = docs.select(*_document(), F.posexplode(F.split(text_of(), "\n")).alias("pos", "line"))
    lines = rows.select("k1", "k2", "pos", F.explode(F.array(words_of(F.col("line")))).alias("words")).filter(F.size("words") > 0)
    rows = _runs(lines.withColumn("lid", F.xxhash64("words")), True, least_words, "k1", "k2", "pos", "lid")
    return rows.select(*[F.when(F.col("key").isNull(), F.col(c)).alias(c) for c in ("k1", "k2", "pos")], "lid", "n", "i", "key")


def _as_characters(hashes: Column) -> Column:
    """A text with one character for each word (one of 983,040, by the word's hash), so that edits are counted in words."""
    points = F.transform(hashes, lambda h: F.concat(F.lit("000"), F.hex(F.lit(0x10000) + F.pmod(h, F.lit(0xF0000)))))
    return F.decode(F.unhex(F.array_join(points, "")), "UTF-32")


def _simhash(hashes: Column, lane: int) -> Column:
    """Each bit's majority over up to 2 ** (lane - 1) - 1 hashes, ties as 0.

    Counters of ``lane`` bits lie side by side in longs, so a hash is added to all 64 counters by
    ``lane`` additions; adding half a counter's range less the majority sets its last bit but one where it has won.
    """
    names = [f"s{j}" for j in range(lane)]
    ones = F.lit(sum(1 << k for k in range(0, 64, lane)))
    start = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])
    bias = (F.lit((1 << lane - 2) - 1) - F.floor(F.size(hashes) / 2)) * ones

    def won(acc: Column) -> Column:
        out = None
        for j, n in enumerate(names):
            bits = F.shiftleft(F.shiftrightunsigned(acc[n] + bias, lane - 2).bitwiseAND(ones), j)
            out = bits if out is None else out.bitwiseOR(bits)
        return out

    return F.aggregate(hashes, start, lambda acc, h: F.struct(*[(acc[n] + F.shiftrightunsigned(h, j).bitwiseAND(ones)).alias(n) for j, n in enumerate(names)]), won)


def _parities(hashes: Column) -> list[Column]:
    """Four longs of 64 bits: for each of 256 parts of all words, whether the line's words in it are odd in number."""
    one = F.lit(1).cast("long")
    flipped = lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", one, h.bitwiseAND(63).cast("int")))
    part = lambda j: F.filter(hashes, lambda h: h.bitwiseAND(192) == 64 * j)
    return [F.aggregate(part(j), F.lit(0).cast("long"), flipped).alias(p) for j, p in enumerate(PARITIES)]


def simhashes(rows: DataFrame) -> DataFrame:
    """``lid, sim, line, p0, p1, p2, p3`` of rows ``lid, words``: SimHash of the distinct words, the words as characters, and the parities of the words.

    A line of more than FEATURES distinct words is counted by its FEATURES least hashes.
    """
    hashed = rows.select("lid", F.explode(F.array(F.transform("words", lambda w: F.xxhash64(w)))).alias("hashes"))  # made once
    features = F.array_distinct("hashes")
    features = F.when(F.size(features) <= FEATURES, features).otherwise(F.slice(F.sort_array(features), 1, FEATURES))
    made = hashed.select("lid", _as_characters(F.col("hashes")).alias("line"), *_parities(F.col("hashes")), F.explode(F.array(features)).alias("features"))
    return made.select("lid", F.when(F.size("features") < 128, _simhash(F.col("features"), 8)).otherwise(_simhash(F.col("features"), 16)).alias("sim"), "line", *PARITIES)


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _texts(wanted: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of :func:`simhashes` of the wanted classes, from the text of one occurrence each."""
    at = lines.join(maybe_broadcast(wanted), "lid").groupBy("lid").agg(*[F.first(c).alias(c) for c in ("k1", "k2", "pos")])  # of the same row
    places = written(at.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "lid")).alias("places")), "places")  # lines of one document
    keyed = docs.select(*_document(), F.split(text_of(), "\n").alias("lines"))
    found = keyed.join(places, ["k1", "k2"])  # no broadcast asked for: whole texts move at any size, as they must in a large table
    found = found.select("lines", F.explode("places").alias("p")).select("p.lid", F.get("lines", F.col("p.pos")).alias("line"))
    return written(simhashes(found.select("lid", words_of(F.col("line")).alias("words"))).dropDuplicates(["lid"]), "line-texts")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sequences of words reach the edit similarity."""
    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b")
    longest = F.greatest(F.length("x"), F.length("y"))
    both = both.withColumn("allowed", F.floor((1 - F.lit(similarity)) * longest + F.lit(1e-9)).cast("int")).filter(F.abs(F.length("x") - F.length("y")) <= F.col("allowed"))
    near = F.lit(False)
    for step in (16, 64, 256):  # a narrow band settles nearly all
        near = near | ((F.lit(step) <= F.col("allowed")) & (F.levenshtein("x", "y", step) >= 0))
    return both.filter(near | (F.expr("levenshtein(x, y, allowed)") >= 0)).select("a", "b")


def _alike(similarity: float) -> Column:
    """Whether two lines (the second ``_b``) can be so similar by their numbers of words before and after the run that they share."""
    before, after = F.abs(F.col("i") - F.col("i_b")), F.abs((F.col("n") - F.col("i")) - (F.col("n_b") - F.col("i_b")))
    return before + after <= (1 - F.lit(similarity)) * F.greatest("n", "n_b") + F.lit(1e-9)


def _agree(similarity: float) -> Column:
    """Whether the parities of two lines' words (the second ``_b``) differ in no more parts than the allowed edits can change.

    A replaced word changes two parts at most, one that goes or comes changes one, and as many go or come
    as the numbers of words differ by, at least.
    """
    differ = sum((_differ(p, f"{p}_b") for p in PARITIES[1:]), _differ(PARITIES[0], f"{PARITIES[0]}_b"))
    return differ <= 2 * F.floor((1 - F.lit(similarity)) * F.greatest("n", "n_b") + F.lit(1e-9)) - F.abs(F.col("n") - F.col("n_b"))


def _with_company(keys: DataFrame, similarity: float) -> DataFrame:
    """``key, lid, n, i, crowd`` of the keys that several classes share; in keys of up to CROWD only classes with another of like length and place."""
    crowds = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1"), "line-crowds")
    shared = keys.join(maybe_broadcast(crowds), "key")
    other = keys.select(F.col("key").alias("key_b"), F.col("lid").alias("lid_b"), F.col("n").alias("n_b"), F.col("i").alias("i_b"))
    company = (F.col("key") == F.col("key_b")) & (F.col("lid") != F.col("lid_b")) & _alike(similarity)
    small = shared.filter(F.col("crowd") <= CROWD).join(other, company, "left_semi")
    return written(small.unionByName(shared.filter(F.col("crowd") > CROWD)), "line-members")


def _each_other(members: DataFrame, most_bits: int, similarity: float) -> DataFrame:
    """Pairs of classes of several components with a key in common, near in bits and place, whose words' parities agree."""
    other = members.select("key", F.col("lid").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("sim", "n", "i", "root", *PARITIES)])
    near = (_differ("sim", "sim_b") <= most_bits) & _alike(similarity) & (F.col("root") != F.col("root_b")) & _agree(similarity)
    return members.join(other, (members["key"] == other["key"]) & (F.col("lid") < F.col("b")) & near).select(F.col("lid").alias("a"), "b").distinct()


def _stars(members: DataFrame, most_bits: int, similarity: float) -> DataFrame:
    """Pairs of each class with the hubs of its keys: the class whose keys are the most crowded."""
    weights = members.groupBy("lid").agg(F.sum("crowd").alias("weight"))
    hubs = members.join(weights, "lid").groupBy("key").agg(F.max(F.struct("weight", "lid", "sim", "n", "i")).alias("hub"))
    hubs = hubs.select("key", F.col("hub.lid").alias("b"), *[F.col(f"hub.{c}").alias(f"{c}_b") for c in ("sim", "n", "i")])
    pairs = members.join(hubs, "key").filter((F.col("lid") != F.col("b")) & (_differ("sim", "sim_b") <= most_bits) & _alike(similarity))
    return pairs.select(F.least("lid", "b").alias("a"), F.greatest("lid", "b").alias("b")).distinct()


def _drawn_stars(left: DataFrame, number: int, most_bits: int, similarity: float) -> DataFrame:
    """Pairs of each class with a hub of each of its keys, drawn anew for each number, if they are in different components."""
    hubs = left.groupBy("key").agg(F.max(F.struct(F.xxhash64("lid", F.lit(number)).alias("h"), "lid", "sim", "n", "i", "root")).alias("hub"))
    hubs = hubs.select("key", F.col("hub.lid").alias("b"), *[F.col(f"hub.{c}").alias(f"{c}_b") for c in ("sim", "n", "i", "root")])
    pairs = left.join(hubs, "key").filter((F.col("root") != F.col("root_b")) & (_differ("sim", "sim_b") <= most_bits) & _alike(similarity))
    return pairs.select(F.least("lid", "b").alias("a"), F.greatest("lid", "b").alias("b")).distinct()


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components with more links: only their roots are connected anew."""
    of = lambda end: found.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    ends = written(ends.filter("a <> b").distinct(), "line-roots")
    if ends.isEmpty():
        return found
    roots = written(connected_components(ends), "line-components").toDF("at", "to")
    out = found.join(roots, found["root"] == roots["at"], "left").select("node", F.coalesce("to", "root").alias("root"))
    alone = roots.join(found.select(F.col("node").alias("at")), "at", "left_anti")
    return written(out.union(alone.select("at", "to")), "line-components")


def _left(members: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of keys whose classes are in several components, with ``root``."""
    placed = members.join(maybe_broadcast(found.withColumnRenamed("node", "lid")), "lid", "left").withColumn("root", F.coalesce("root", "lid"))
    several = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    return written(placed.join(several, "key"), "line-left")


def _prefixes(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``key, lid, n, i``: the rarest six tenths of each wanted class's distinct runs, rarity counted among the wanted."""
    lines = texts.join(maybe_broadcast(wanted), "lid").select("lid", F.explode(F.array(F.array_remove(F.split("line", ""), ""))).alias("words"))
    runs = written(_runs(lines, False, 1, "lid").filter("key is not null").distinct(), "line-runs")
    held = runs.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    here = Window.partitionBy("lid")  # runs of one line
    ranked = runs.join(held, "key").select("key", "lid", "n", "i", F.row_number().over(here.orderBy("held", "key")).alias("at"), F.count(F.lit(1)).over(here).alias("of"))
    return ranked.filter(F.col("at") <= 0.6 * F.col("of") + 3).select("key", "lid", "n", "i")


def _thinned(found: DataFrame, left: DataFrame, verified: Callable[[DataFrame], DataFrame], most_bits: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """More rounds of hubs for keys left in pieces that hold more than DENSE rows: families of lines some of which are alike.

    A round in which hardly a pair is a link is the last: what shares those keys is not alike.
    """
    for number in range(ROUNDS):
        dense = left.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > DENSE).select("key")
        pairs = written(_drawn_stars(left.join(dense, "key"), number, most_bits, similarity), "line-pairs")
        links = None if pairs.isEmpty() else verified(pairs)
        if links is None or (more := _joined(found, links)) is found:
            break
        found, left = more, _left(left.drop("root"), more)
        if 10 * links.count() < pairs.count():
            break
    return found, left


def line_components(keys: DataFrame, lines: DataFrame, docs: DataFrame, most_bits: int = MOST_BITS, similarity: float = SIMILARITY) -> DataFrame:
    """``node, root`` of the classes with a link, from distinct ``key, lid, n, i``."""
    members = _with_company(keys, similarity)
    texts = _texts(written(members.select("lid").distinct(), "wanted"), lines, docs)
    sims = texts.select("lid", "sim", *PARITIES)
    members = written(members.join(sims, "lid"), "line-members")
    verified = lambda pairs: written(_verified(pairs, texts, similarity), "line-links")
    found = written(connected_components(verified(_stars(members, most_bits, similarity))), "line-components")
    left = _left(members, found)
    wanted = written(left.select("lid").distinct(), "wanted")
    texts = written(texts.join(maybe_broadcast(wanted), "lid"), "line-texts")  # no other is compared from here on
    found, left = _thinned(found, left, verified, most_bits, similarity)
    if left.isEmpty():
        return found
    links = verified(_each_other(left.filter(F.col("crowd") <= CROWD), most_bits, similarity))
    wanted = written(left.filter(F.col("crowd") > CROWD).select("lid").distinct(), "wanted")
    found = _joined(found, links)
    if wanted.isEmpty():
        return found
    members = written(_with_company(_prefixes(wanted, texts), similarity).join(sims, "lid"), "line-members")
    found = _joined(found, verified(_stars(members, most_bits, similarity)))
    found, left = _thinned(found, _left(members, found), verified, most_bits, similarity)
    return _joined(found, verified(_each_other(left, most_bits, similarity)))


def dropped_lines(docs: DataFrame, least_words: int = LEAST_WORDS, most_bits: int = MOST_BITS, similarity: float = SIMILARITY) -> DataFrame:
    """``k1, k2, dropped``: the numbers (from 0) of the lines that each document loses."""
    keyed = written(line_keys(docs, least_words), "lines", "snappy")
    lines = keyed.filter("key is null").select("k1", "k2", "pos", "lid")
    each = keyed.filter("key is not null").select("key", "lid", "n", "i")
    shared = written(each.groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi")).filter("lo <> hi").select("key"), "line-shared")
    keys = written(each.join(maybe_broadcast(shared), "key").distinct(), "line-keys")
    found = line_components(keys, lines, docs, most_bits, similarity)
    # Occurrences of the classes that are linked or stand more than once.
    often = lines.groupBy("lid").agg(F.count(F.lit(1)).alias("times"))
    groups = often.join(maybe_broadcast(found.withColumnRenamed("node", "lid")), "lid", "left").filter("times > 1 or root is not null")
    groups = written(groups.select("lid", F.coalesce("root", "lid").alias("root")), "line-groups")
    each = written(lines.join(maybe_broadcast(groups), "lid").drop("lid"), "line-occurrences")
    firsts = each.groupBy("root").agg(F.min(F.struct("k1", "k2", "pos")).alias("first"))
    gone = each.join(firsts, "root").filter(F.struct("k1", "k2", "pos") != F.col("first"))
    out = written(gone.groupBy("k1", "k2").agg(F.collect_set("pos").alias("dropped")), "dropped")  # lines of one document
    drop_tables(keyed, shared, keys, found, groups, each)
    return out


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, most_bits: int = MOST_BITS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with the columns they have, ``text`` without repeated lines, and ``n_lines, n_dropped``.

    Lines are separated by \\n; the others keep their order and their exact characters. Lines
    with fewer than ``least_words`` words go only if all words are equal, lines without a word
    are left alone. Null and empty texts stay as they
    are (n_lines 0 for null, 1 for empty). Rows that repeat an id and a text are one document
    and are treated alike; a null id comes before all others. Extra columns are passed on,
    but for clashes with n_lines and n_dropped, which are replaced. An empty table gives an
    empty table.
    """
    gone = dropped_lines(docs, least_words, most_bits, similarity)
    gone = gone.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("dropped").alias("__dropped"))
    keyed = docs.drop("n_lines", "n_dropped")
    columns = [c for c in keyed.columns]
    joined = keyed.join(gone, (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) == F.col("__k1")) & (F.xxhash64(text_of()) == F.col("__k2")), "left")
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("__dropped"), i)), "\n")
    text = F.when(F.col("__dropped").isNotNull(), kept).otherwise(F.col("text"))
    counts = [F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in columns], *counts)


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go; a document that loses lines and has no word left goes with them.

    ``n_chars``, if there, is that of the new text.
    """
    out = dedup_lines(docs).filter((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
