"""Token ids in range asymmetric numeral system (rANS) blocks.

One frequency table, counted over all ids, is shared by all blocks. A block holds the ids
of whole documents in ascending order of doc_id, dealt to interleaved lanes, each a 64-bit
rANS state that is renormalised by 32 bits. Every few steps the block keeps a checkpoint:
the lanes' states, the place in the word stream and a checksum of the ids up to the next
one. So blocks decode independently, and parts of a block as well.

Layout of a block, little-endian: magic, version, lanes, ids, checkpoints (u32 each) and
steps between checkpoints (u32); for each checkpoint its word offset (u64), checksum (u32)
and ids (u32); the lanes' states of each checkpoint (u64); the words (u32); a CRC-32 of all
before. A file is a Parquet table with a row a block: part, seq, start in the part, the
documents' ids and lengths, and the block.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm._shared import Memo, byte_characters, drop_tables, scratch, table, text_of, written

MAGIC, VERSION = b"CRAN", 1
PRECISION = 20  # bits of the frequency table
MAX_LANES, STEPS = 4096, 64
BLOCK_IDS, RANGE_ROWS, MOST_RANGES = 1 << 20, 10_000, 1 << 15
_HEAD = struct.Struct("<4sIIIII")
_MEMO = 600_000
#: White space other than space and line feed, by any of the libraries' definitions.
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_U = np.uint64


class Corrupt(ValueError):
    """A block fails its checksum or its layout."""


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**PRECISION; every id that occurs keeps at least 1."""
    counts = np.asarray(counts, np.int64)
    used = counts > 0
    m, total = int(used.sum()), int(counts.sum())
    if m > 1 << PRECISION:
        raise ValueError("more distinct ids than the table has places")
    out = np.zeros(len(counts), np.int64)
    if total:
        room = (1 << PRECISION) - m
        out[used] = 1 + np.array([c * room // total for c in counts[used].tolist()], np.int64)
        out[int(counts.argmax())] += (1 << PRECISION) - int(out.sum())
    return out


class Table:
    """Frequencies, their running sums and the id of each place."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(_U)
        self.start = (np.cumsum(freq) - freq).astype(_U)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_block(ids: np.ndarray, t: Table) -> bytes:
    """One block; ids must all have a frequency."""
    n = len(ids)
    lanes = max(1, min(MAX_LANES, n // 64))
    steps = -(-n // lanes)
    state = np.full(lanes, 1 << 31, _U)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    freq, start = t.freq[ids], t.start[ids]
    if n and not freq.all():
        raise ValueError("an id is not in the frequency table")
    for step in range(steps - 1, -1, -1):
        f, c = freq[step * lanes : (step + 1) * lanes], start[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        full = x >= f << _U(63 - PRECISION)
        words.append((x[full] & _U(0xFFFFFFFF)).astype("<u4"))
        x[full] >>= _U(32)
        q = x // f
        state[: len(f)] = (q << _U(PRECISION)) + (x - q * f) + c
        if step % STEPS == 0:
            marks.append((step, state.copy()))
    words.reverse()
    marks.reverse()
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    out = [_HEAD.pack(MAGIC, VERSION, lanes, n, len(marks), STEPS)]
    for step, _ in marks:
        part = ids[step * lanes : (step + STEPS) * lanes]
        out.append(struct.pack("<QII", int(ends[step]), zlib.crc32(part.astype("<u4").tobytes()), len(part)))
    out += [s.astype("<u8").tobytes() for _, s in marks]
    out += [w.tobytes() for w in words]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


def checkpoints(block: bytes) -> int:
    """The number of parts of a block that :func:`decode_part` can decode on their own."""
    if len(block) < _HEAD.size + 4 or block[:4] != MAGIC:
        raise Corrupt("not a block")
    return _HEAD.unpack_from(block)[4]


def decode_part(block: bytes, part: int, t: Table) -> np.ndarray:
    """Ids from one checkpoint to the next."""
    n_marks = checkpoints(block)
    _, version, lanes, _, _, every = _HEAD.unpack_from(block)
    if version != VERSION or not 0 <= part < n_marks:
        raise Corrupt("no such version or part")
    at, check, n = struct.unpack_from("<QII", block, _HEAD.size + 16 * part)
    states_at = _HEAD.size + 16 * n_marks
    state = np.frombuffer(block, "<u8", lanes, states_at + 8 * lanes * part).astype(_U)
    words_at = states_at + 8 * lanes * n_marks
    words = np.frombuffer(block, "<u4", (len(block) - 4 - words_at) // 4, words_at)
    low, out, done = _U((1 << PRECISION) - 1), np.empty(n, np.uint32), 0
    while done < n:
        x = state[: n - done]
        place = x & low
        s = t.symbol[place]
        x = t.freq[s] * (x >> _U(PRECISION)) + place - t.start[s]
        need = np.flatnonzero(x < _U(1 << 31))
        if len(need):
            if at + len(need) > len(words):
                raise Corrupt("the words end early")
            x[need] = x[need] << _U(32) | words[at : at + len(need)]
            at += len(need)
        state[: len(x)] = x
        out[done : done + len(s)] = s
        done += len(s)
    if zlib.crc32(out.astype("<u4").tobytes()) != check:
        raise Corrupt("a checkpoint's checksum differs")
    return out


def decode_block(block: bytes, t: Table) -> np.ndarray:
    """All ids of a block."""
    if len(block) < 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise Corrupt("the block's checksum differs")
    parts = [decode_part(block, k, t) for k in range(checkpoints(block))]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them.

    Where no token can lead from letters into the space, digit or mark after them, a text is cut there
    and the library is asked once for each unit. A unit of letters, with a space before it or
    not, is one pre-token, for which the library's model is asked directly.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(content.decode())
        self.dtype = np.uint16 if self.t.get_vocab_size(True) <= 1 << 16 else np.uint32
        self.code = "H" if self.dtype is np.uint16 else "I"
        self.model = self.t.model
        self.by_word = splits_at_space(content)
        self.units = re.compile(r"[ \n]*+[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\x00-\x7F])|[ \n]*+[^ \n]++|[ \n]++").findall
        self.mapped = dict(enumerate(byte_characters()))
        self.memo = Memo(self.unit, _MEMO)

    def library(self, text: str) -> bytes:
        return np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def unit(self, unit: str) -> bytes:
        if (unit[1:] if unit[0] == " " else unit).isalpha():
            mapped = "Ġ" + unit[1:] if unit.isascii() and unit[0] == " " else unit.encode().decode("latin-1").translate(self.mapped)
            return array(self.code, [x.id for x in self.model.tokenize(mapped)]).tobytes()
        return self.library(unit)

    def encode(self, text: str) -> bytes:
        if not self.by_word or any(c in text for c in OTHER_SPACE):
            return self.library(text)
        return b"".join(map(self.memo.__getitem__, self.units(text)))


def splits_at_space(content: bytes) -> bool:
    """Whether the file is plain byte-level BPE with the usual split, which ends a match before each white space that follows another character."""
    t = json.loads(content)
    pre = t.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and pre.get("add_prefix_space") is False and t.get("normalizer") is None
    return plain and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or any(c.isspace() for c in a["content"]) or a["content"][:1].isalpha() for a in t["added_tokens"])


def _ids(batches: Iterator[pa.RecordBatch], content: bytes, end: int, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ids of each document and its range, and at a task's end how often it has seen each id (rows without ``ids``)."""
    e = Encoder(content)
    last = np.array([end], e.dtype).tobytes()
    counts = np.zeros(e.t.get_vocab_size(True), np.int64)
    names = ["range", "doc_id", "ids", "id", "n"]
    for batch in batches:
        ids = [e.encode(t) + last for t in batch.column("text").to_pylist()]
        for at in range(0, len(ids), 256):
            counts += np.bincount(np.frombuffer(b"".join(ids[at : at + 256]), e.dtype), minlength=len(counts))
        m = len(ids)
        lowest = np.iinfo(np.int64).min
        of = np.searchsorted(cuts, np.array([lowest if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), batch.column("doc_id"), pa.array(ids, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names)
    used = np.flatnonzero(counts)
    m = len(used)
    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(used, pa.int32()), pa.array(counts[used])], names)


def _cuts(docs: DataFrame) -> np.ndarray:
    """Ids between the ranges of ids, ascending; null ids are in the first range."""
    n = max(1, min(-(-docs.count() // RANGE_ROWS), MOST_RANGES))  # a range streams, so its size costs no memory
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    return np.array(sorted(set(cuts or [])), np.int64)


BLOCK_SCHEMA = "part int, seq int, start_in_part long, doc_ids binary, no_id binary, lengths binary, block binary"


def _blocks(batches: Iterator[pa.RecordBatch], dtype: type, freq: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of documents that come in the order of range and id."""
    t, part, seq, start = Table(freq), None, 0, 0
    docs: list[int | None] = []
    ids: list[np.ndarray] = []

    def row():
        whole = np.concatenate(ids)
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()),
            pa.array([np.array([d or 0 for d in docs], "<i8").tobytes()]), pa.array([np.array([d is None for d in docs], bool).tobytes()]),
            pa.array([np.array([len(x) for x in ids], "<i8").tobytes()]), pa.array([encode_block(whole, t)]),
        ], ["part", "seq", "start_in_part", "doc_ids", "no_id", "lengths", "block"]), len(whole)

    held = 0
    for batch in batches:
        for range_, doc, raw in zip(batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
            if docs and (held >= BLOCK_IDS or range_ != part):
                out, n = row()
                yield out
                seq, start, held, docs, ids = seq + 1, start + n, 0, [], []
            if range_ != part:
                part, seq, start = range_, 0, 0
            x = np.frombuffer(raw.as_py(), dtype)
            docs.append(doc)
            ids.append(x)
            held += len(x)
    if docs:
        yield row()[0]


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0) -> None:
    """Encode the documents and write blocks and frequency table below ``path``.

    Documents are ordered by doc_id, null ids first; rows that repeat an id stand side by
    side, ordered by their ids' bytes. Null and empty texts have the end id only. Extra
    columns are not read. An empty table writes no block.
    """
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    e = Encoder(content)
    dtype, size = e.dtype, e.t.get_vocab_size(True)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    cuts = _cuts(docs)
    both = written(docs.mapInArrow(lambda it: _ids(it, content, end_id, cuts), "range int, doc_id long, ids binary, id int, n long"), "ids")
    counts = np.zeros(size, np.int64)
    for row in both.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row an id at most
        counts[row["id"]] = row["n"]
    ids = both.filter("ids is not null").select("range", "doc_id", "ids")
    freq = scaled(counts)
    spark.createDataFrame([(json.dumps({"version": VERSION, "end_id": end_id, "freq": freq.tolist()}),), ], "meta string").coalesce(1).write.json(f"{path}/meta")
    ordered = ids.repartitionById(len(cuts) + 1, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(lambda it: _blocks(it, dtype, freq), BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_tables(both)


def _documents(batches: Iterator[pa.RecordBatch], freq: np.ndarray, before: dict[int, int], keep_ids: bool) -> Iterator[pa.RecordBatch]:
    t = Table(freq)
    for batch in batches:
        for r in batch.to_pylist():
            ids = decode_block(r["block"], t)
            lengths = np.frombuffer(r["lengths"], "<i8")
            ends = np.cumsum(lengths)
            if len(ids) != (ends[-1] if len(ends) else 0):
                raise Corrupt("the documents' lengths differ from the block's")
            first = before[r["part"]] + r["start_in_part"]
            raw, starts = ids.astype("<u4").tobytes(), ends - lengths
            doc = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["no_id"], bool))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            columns, names = [doc, pa.array(starts + first), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``, little-endian u32) of each document, decoded from the files below ``path``.

    ``start`` is the number of ids of all documents before it. A damaged block raises
    :class:`Corrupt`.
    """
    meta = json.loads(json.loads(spark.read.text(f"{path}/meta").first()[0])["meta"])
    freq = np.array(meta["freq"], np.int64)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    last = blocks.groupBy("part").agg(F.max(F.struct("seq", "start_in_part", "lengths")).alias("x")).select("part", "x.start_in_part", "x.lengths")
    before, total = {}, 0
    for row in sorted(last.collect()):  # a row a partition that the writer chose
        before[row["part"]] = total
        total += row["start_in_part"] + int(np.frombuffer(row["lengths"], "<i8").sum())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    return blocks.mapInArrow(lambda it: _documents(it, freq, before, keep_ids), schema)


def op2_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = scratch(spark, "rans")
    write_ids(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), path)
    return read_ids(spark, path)
