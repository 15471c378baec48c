"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary.

The rank file is rewritten, byte by byte, as a sentencepiece ModelProto: every token is a
piece of byte-mapped characters whose score is its negative rank, the model type is BPE and
the normaliser is the identity. Pre-tokens are encoded one by one and decoded by the inverse
mapping. Nothing is trained.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm._shared import byte_characters, table

_MEMO = 400_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in content.splitlines() if line)}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bool | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model in which the id of a piece is its rank.

    Numbers of fields and of types are those of sentencepiece's public model schema:
    pieces (1: piece, 2: score, 3: type; type 1 is normal, 2 unknown), trainer (2) and
    normalizer (3).
    """
    mapped = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    out = bytearray()
    for token, rank in by_rank:
        piece = "".join(mapped[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(by_rank)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = read_ranks(content)
        self.split = regex.compile(pattern).findall
        self.to_char = {i: c for i, c in enumerate(byte_characters())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        back = {c: b for b, c in self.to_char.items()}
        self.bytes_of = {i: bytes(map(back.__getitem__, self.model.id_to_piece(i))) for i in range(len(self.ranks))}  # pieces, unmapped
        self.memo: dict[str, tuple[str, int]] = {}

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        raw = piece.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.model.encode(raw.decode("latin-1").translate(self.to_char))

    def ids_text(self, text: str) -> tuple[str, int]:
        """Decimal ids joined by commas, and their number."""
        memo, out, n = self.memo, [], 0
        for piece in self.split(text):
            hit = memo.get(piece)
            if hit is None:
                if len(memo) >= _MEMO:
                    memo.clear()
                ids = self.encode_piece(piece)
                hit = ",".join(map(str, ids)), len(ids)
                if len(piece) <= 64:
                    memo[piece] = hit
            out.append(hit[0])
            n += hit[1]
        return ",".join(out), n

    def encode(self, text: str) -> list[int]:
        ids = self.ids_text(text)[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def codec(content: bytes, pattern: str) -> Codec:
    """The codec of this worker process."""
    return Codec(content, pattern)


def _encoded(batches: Iterator[pa.RecordBatch], content: bytes, pattern: str, ids: bool) -> Iterator[pa.RecordBatch]:
    c = codec(content, pattern)
    bytes_of = {str(r): t for r, t in c.bytes_of.items()}
    for batch in batches:
        n, sha, back, lists = [], [], [], []
        for text in batch.column("text").to_pylist():
            joined, k = c.ids_text(text or "")
            each = joined.split(",") if joined else []
            n.append(k)
            sha.append(hashlib.sha256(joined.encode()).hexdigest())
            back.append(hashlib.sha256(b"".join(map(bytes_of.__getitem__, each))).hexdigest())
            if ids:
                lists.append(list(map(int, each)))
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
        for at in range(0, len(n), 256) if ids else [0]:
            yield pa.RecordBatch.from_arrays([x.slice(at, 256) if ids else x for x in columns], names)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` of each document.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the
    bytes that the ids decode to (the text's UTF-8). Special tokens are never made.

    Null and empty texts have no ids. Every row gives one row, repeated rows too; a null
    doc_id stays null; extra columns are not read. The vocabulary (under 2 MB) travels in
    the task, so executors need no file.
    """
    with open(ranks_path, "rb") as f:
        content = f.read()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: _encoded(it, content, pattern, ids), schema)


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, text`` from the ``ids`` of :func:`bpe_encode`. Null ids give a null text, no ids the empty text."""
    with open(ranks_path, "rb") as f:
        content = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content, ".")
        for batch in batches:
            texts = [None if x is None else c.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return bpe_encode(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ids=False)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: token ids of every document that is left. Returns doc_id, n_tokens, ids and the two digests."""
    import public_tokenizers as P

    return bpe_encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
