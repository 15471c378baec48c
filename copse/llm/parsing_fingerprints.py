"""Document fingerprints by locally consistent parsing.

A text's code points are cut into phrases, phrases into longer phrases, and so on to one
name. Cuts come from deterministic coin tossing: a symbol's label is the lowest bit in which
it differs from the symbol before it, repeated until labels are few, then recoloured to
three; a phrase begins at each local maximum. A cut so depends on a few symbols around it
only, and a phrase's name on its content only: equal substrings have the same names inside,
wherever they stand, but for a few symbols at either end.

A fingerprint is the root name with a sketch (the least hashes) of the names from the third
level on, phrases of some twenty characters; short texts add a sketch of the lower levels.
The likeness of two fingerprints estimates the share of common names, and is 1 for equal
texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm._shared import table, text_of

COARSE, COARSE_LEVEL, FINE, FINE_CHARS, FEW = 48, 3, 16, 256, 4
BATCH_CHARS, PARTITION_ROWS, MOST_GROUPS = 400_000, 8_000, 1 << 15
_U = np.uint64
_ONE = _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def runs_named(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of an equal symbol as one symbol, so that neighbours differ."""
    begins = first.copy()
    begins[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(begins)
    length = np.diff(at, append=len(x))
    y = x[at]
    long = length > 1
    if long.any():
        y = y.copy()
        y[long] = mixed(y[long] ^ mixed(length[long].astype(_U) + _U(0xA5A5)))
    return y, first[at]


def tossed(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit that differs from the label before, plus that bit; place 0 for a text's first."""
    differ = np.empty_like(label)
    differ[1:] = label[1:] ^ label[:-1]
    differ[first] = 1
    low = differ & (~differ + differ.dtype.type(1))
    place = np.bitwise_count(low - low.dtype.type(1))  # 64 or 8 where nothing differs, by chance of the hash only
    bit = (label & low) != 0
    return (place << np.uint8(1)) | bit


def three_coloured(label: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Labels 3 and above take the least colour that neither neighbour in the same text has."""
    c = np.minimum(label, 5).astype(np.uint8)
    for high in (5, 4, 3):
        at = np.flatnonzero(c == high)
        if len(at):
            left = np.where(first[at], 6, c[np.maximum(at - 1, 0)]).astype(np.uint8)
            right = np.where(last[at], 6, c[np.minimum(at + 1, len(c) - 1)]).astype(np.uint8)
            used = (np.uint8(1) << left) | (np.uint8(1) << right)
            c[at] = np.where(used & 1 == 0, 0, np.where(used & 2 == 0, 1, 2))
    return c


def phrase_starts(y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True at each phrase's first symbol: local maxima of the colours, and each text's first symbol."""
    label = tossed(y, first)
    for _ in range(3):
        label = tossed(label.astype(np.uint8), first)
    last = np.empty_like(first)
    last[:-1], last[-1] = first[1:], True
    c = three_coloured(label, first, last)
    starts = np.zeros(len(c), bool)
    starts[1:-1] = (c[1:-1] > c[:-2]) & (c[1:-1] >= c[2:])
    starts &= ~last
    starts[1:] &= ~first[:-1]
    return starts | first


def level_up(x: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of the next level."""
    y, first = runs_named(x, first)
    at = np.flatnonzero(phrase_starts(y, first))
    length = np.diff(at, append=len(y))
    name = np.full(len(at), level * 0x9E37 + 1, _U)
    for k in range(int(length.max(initial=0))):
        rows = slice(None) if k == 0 else np.flatnonzero(length > k)
        name[rows] = mixed(name[rows] * _U(0x9E3779B97F4A7C15) + y[at[rows] + k])
    return mixed(name + length.astype(_U)), first[at]


def _sketches(names: list[np.ndarray], owners: list[np.ndarray], n: int, size: int) -> list[np.ndarray]:
    """By text: its least ``size`` distinct 32-bit hashes, ascending."""
    if not names:
        return [np.empty(0, np.uint32)] * n
    key = np.unique((np.concatenate(owners).astype(_U) << _U(32)) | (mixed(np.concatenate(names)) >> _U(32)))
    owner, value = (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.uint32)
    begin = np.searchsorted(owner, np.arange(n))
    end = np.searchsorted(owner, np.arange(n), side="right")
    return [value[b : min(b + size, e)] for b, e in zip(begin, end)]


def parsed(texts: Sequence[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Root name, coarse and fine sketch of each text."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    n = len(codes)
    sizes = np.array([len(c) for c in codes])
    root = np.zeros(n, _U)
    coarse: list[np.ndarray] = []
    fine: list[np.ndarray] = []
    coarse_of: list[np.ndarray] = []
    fine_of: list[np.ndarray] = []
    filled = np.flatnonzero(sizes)
    if len(filled):
        x = np.concatenate([codes[i] for i in filled]).astype(_U) + _ONE
        owner = filled  # of each text that is still parsed
        size = sizes[filled]
        first = np.zeros(len(x), bool)
        first[np.cumsum(size) - size] = True
        level = 0
        while len(owner):
            level += 1
            x, first = level_up(x, first, level)
            begin = np.flatnonzero(first)
            size = np.diff(begin, append=len(x))
            of = np.repeat(owner, size)
            if level >= COARSE_LEVEL:
                coarse.append(x)
                coarse_of.append(of)
            else:
                short = sizes[of] < FINE_CHARS
                fine.append(x[short])
                fine_of.append(of[short])
            done = size == 1
            if done.any():
                root[owner[done]] = x[begin[done]]
                stay = np.repeat(~done, size)
                x, first, owner = x[stay], first[stay], owner[~done]
    a, b = _sketches(coarse, coarse_of, n, COARSE), _sketches(fine, fine_of, n, FINE)
    return [(int(r), c, f) for r, c, f in zip(root, a, b)]


def fingerprint(parse: tuple[int, np.ndarray, np.ndarray]) -> str:
    """Root, coarse and fine sketch in hexadecimal."""
    return ":".join([f"{parse[0]:016x}", parse[1].astype(">u4").tobytes().hex(), parse[2].astype(">u4").tobytes().hex()])


def read_fingerprint(value: str) -> tuple[int, np.ndarray, np.ndarray]:
    root, a, b = value.split(":")
    return int(root, 16), np.frombuffer(bytes.fromhex(a), ">u4"), np.frombuffer(bytes.fromhex(b), ">u4")


def _common(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Estimated Jaccard similarity from the least hashes of the union; exact for sets smaller than the sketch."""
    both = set(a.tolist()) & set(b.tolist())
    union = sorted(set(a.tolist()) | set(b.tolist()))
    if len(a) >= size or len(b) >= size:  # what lies beyond a full sketch's last hash is not known
        top = min(int(x[-1]) for x in (a, b) if len(x) >= size)
        union = [x for x in union if x <= top]
    return sum(x in both for x in union) / len(union) if union else 0.0


def likeness(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> float:
    """1 for equal texts, else the estimated share of names in common: of long phrases, or of short ones where either text has few long ones."""
    if a[0] == b[0]:
        return 1.0
    if min(len(a[1]), len(b[1])) < FEW and len(a[2]) and len(b[2]):
        return _common(a[2], b[2], FINE)
    return _common(a[1], b[1], COARSE)


def edited(text: str, other: str) -> str:
    """The text with its last third (rounded down) replaced by the first as many code points of the other."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def _compared(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Rows (doc_id, text, next text), each text followed by the next unless a group ends there."""
    texts: dict[str, int] = {}
    number = lambda t: texts.setdefault(t, len(texts))
    new = [edited(t, o) for _, t, o in rows]
    at = [(number(t), number(e), number(o)) for (_, t, o), e in zip(rows, new)]
    parses = parsed(list(texts))
    prints = [fingerprint(p) for p in parses]
    return pa.RecordBatch.from_arrays([
        pa.array([d for d, _, _ in rows], pa.int64()), pa.array([len(t) for _, t, _ in rows], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in new]),
        pa.array([prints[a] for a, _, _ in at]), pa.array([prints[b] for _, b, _ in at]),
        pa.array([likeness(parses[a], parses[b]) for a, b, _ in at], pa.float64()),
        pa.array([likeness(parses[a], parses[c]) for a, _, c in at], pa.float64()),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (group, guest, doc_id, text): each own row with the text after it; guests only stand in as next."""
    before, rows, chars = None, [], 0
    for batch in batches:
        for group, guest, doc, text in zip(*(batch.column(c).to_pylist() for c in ("group", "guest", "doc_id", "text"))):
            if before and before[0] == group and not before[1]:
                rows.append((before[2], before[3], text))
                chars += len(before[3]) + len(text) + 100
                if chars >= BATCH_CHARS:
                    yield _compared(rows)
                    rows, chars = [], 0
            before = group, guest, doc, text
    if rows:
        yield _compared(rows)


def _below(k: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are less than ``k``: by blocks of 256, then in one block."""
    count = lambda x: F.size(F.filter(x, lambda c: c < k))
    if len(cuts) <= 256:
        return count(F.lit(cuts)) if cuts else F.lit(0)
    whole = count(F.lit(cuts[255::256]))
    return 256 * whole + count(F.slice(F.lit(cuts), 256 * whole + 1, F.lit(256)))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``group, guest, doc_id, text`` in which each document is followed by the next one of descending doc_id.

    Ranges of ids are groups. The first document of each is sent to the group before it as
    well, the very first one to the last group, so no group needs another one's rows.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ids = docs.select(order.alias("k"))
    count = ids.count()
    n = max(1, min(-(-count // PARTITION_ROWS), MOST_GROUPS))  # a group streams, so its size costs no memory
    cuts = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n).alias("x")).first()["x"] if n > 1 else []
    cuts = sorted(set(cuts or []))
    above = lambda k: F.lit(len(cuts)) - _below(k, cuts)
    first = {r["g"]: r["k"] for r in ids.groupBy(above(F.col("k")).alias("g")).agg(F.max("k").alias("k")).collect()}  # a row a group
    groups = sorted(first)
    heads = [first.get(g) for g in range(len(cuts) + 1)]
    previous = {g: groups[i - 1] for i, g in enumerate(groups)}
    rows = docs.select("doc_id", "text", order.alias("k")).withColumn("g", above(F.col("k")))
    head = F.get(F.array(*[F.lit(h).cast("long") for h in heads]), F.col("g")) == F.col("k")
    to = F.get(F.array(*[F.lit(previous.get(g)).cast("int") for g in range(len(cuts) + 1)]), F.col("g"))
    own = F.struct(F.col("g").cast("int").alias("group"), F.lit(False).alias("guest"))
    rows = rows.withColumn("to", F.explode(F.when(head, F.array(own, F.struct(to.alias("group"), F.lit(True).alias("guest")))).otherwise(F.array(own))))
    rows = rows.select("to.group", "to.guest", "doc_id", "k", "text").repartitionById(len(cuts) + 1, "group")
    return rows.sortWithinPartitions("group", "guest", F.desc("k"), "text").select("group", "guest", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each document.

    The next document is that of the next lower doc_id; after the last comes the first. The
    edited text has its last third replaced by the beginning of the next document's.

    Null and empty texts have the fingerprint of the empty text, likeness 1 to each other
    and 0 to any other. Null ids come last; rows that repeat an id are documents of their
    own, ordered by text. A lone document is its own next. Extra columns are not read. An
    empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(_stream, schema)


def op8_parsing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
