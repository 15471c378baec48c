"""Token counts behind a cache of digests.

A text's key is the digest of its normalised content, the cache's name the digest of the
tokenizer (its file, library and settings). Keys are joined to the stored counts, only
distinct misses are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm._shared import Memo, byte_characters, scratch, shared_dir, table, text_of, written

_MEMO = 200_000
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_UNITS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\x00-\x7F])|[^\x20\x09-\x0D]++").findall


def tokenizer_version(content: bytes, kind: str) -> str:
    """Digest of what decides the counts."""
    import sentencepiece
    import tokenizers

    library = {"json": f"tokenizers {tokenizers.__version__}", "model": f"sentencepiece {sentencepiece.__version__}"}[kind]
    return hashlib.sha256(f"{kind}|{library}|plain|".encode() + content).hexdigest()


class Counter:
    """Number of tokens of a text, as the library gives it, without truncation, padding or added begin and end.

    A tokenizer that drops white space cannot make a token of two words, nor of letters and the
    digit or mark after them: these are counted once each. For a word of Latin letters, which is one
    pre-token, the library's model is asked directly.
    """

    def __init__(self, content: bytes, kind: str):
        if kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.by_word = False
            return
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(content.decode())
        self.t.no_truncation()
        self.t.no_padding()
        self.whole = lambda texts: [len(x.ids) for x in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        self.by_word = drops_space(content)
        self.model = self.t.model
        self.mapped = dict(enumerate(byte_characters()))
        self.memo = Memo(self.word, _MEMO)

    def word(self, word: str) -> int:
        if _LATIN(word):
            word = word.lower()
            return len(self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.mapped)))
        return self.whole([word])[0]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.whole(texts)
        return [sum(map(self.memo.__getitem__, _UNITS(text))) for text in texts]


def drops_space(content: bytes) -> bool:
    """Whether white space only separates words, for a tokenizers file: its split keeps no white space and nothing is prefixed."""
    import json

    t = json.loads(content)
    steps = (t.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = steps[0] if steps else {}
    # Normalisers that a Latin word's lower case stands for, and that make no space and no word of two.
    norms = (t.get("normalizer") or {}).get("normalizers", [])
    plain = [n["type"] for n in norms] == ["NFC", "Replace", "Lowercase"] and norms[1]["pattern"] == {"Regex": r"\s+"} and norms[1]["content"] == " "
    return (
        plain and split.get("type") == "Split" and split.get("invert") is True and split.get("behavior") == "Removed"
        and split.get("pattern", {}).get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps[1:])
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or any(c.isspace() for c in a["content"]) or a["content"][:1].isalpha() for a in t["added_tokens"])
    )


def normalised(by_word: bool, text: str = "text"):
    """Content that counts alike: where white space only separates, its ASCII runs are one space; else the text itself."""
    x = text_of(text)
    return F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")) if by_word else x


def _misses(batches: Iterator[pa.RecordBatch], content: bytes, kind: str, version: str) -> Iterator[pa.RecordBatch]:
    counter, last = Counter(content, kind), None
    for batch in batches:
        digests, texts = [], []
        for digest, text in zip(batch.column("digest").to_pylist(), batch.column("content").to_pylist()):
            if digest != last:  # sorted: equal digests are neighbours
                digests.append(digest)
                texts.append(text)
                last = digest
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array([version] * len(digests), pa.string()), pa.array(counter.counts(texts), pa.int64())], ["digest", "version", "n_tokens"])


def _first_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows whose digest this task has already sent on: a hot text is shuffled once a task."""
    seen: set[str] = set()
    for batch in batches:
        keep = []
        for digest in batch.column("digest").to_pylist():
            keep.append(digest not in seen)
            if len(seen) < _MEMO:
                seen.add(digest)
        yield batch.filter(pa.array(keep, pa.bool_()))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """``digest, version, n_tokens``; empty where there is no cache yet. A count that was appended twice is read once."""
    schema = "digest string, version string, n_tokens long"
    try:
        return spark.read.schema(schema).parquet(path).dropDuplicates(["digest", "version"])
    except (AnalysisException, Py4JJavaError) as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each document; the cache below ``cache_path`` grows by the misses.

    Null and empty texts: 0 bytes and the count of the empty text. Every row gives one row;
    texts that repeat are encoded once. A null doc_id stays null. Extra columns are not
    read. An empty table gives an empty table and leaves the cache as it is. A second run
    over the same texts encodes nothing.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    kind = tokenizer_path.rpartition(".")[2]
    version = tokenizer_version(content, kind)
    by_word = kind == "json" and drops_space(content)
    norm = normalised(by_word)
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), F.sha2(norm, 256).alias("digest"))
    keys = written(keys, "digests")

    stored = read_cache(spark, cache_path).filter(F.col("version") == version).select("digest", "n_tokens")
    wanted = written(keys.select("digest").distinct().join(stored, "digest", "left_anti"), "misses")
    if not wanted.isEmpty():
        texts = docs.select(F.sha2(norm, 256).alias("digest"), norm.alias("content"))
        texts = texts.mapInArrow(_first_here, "digest string, content string").join(wanted.hint("merge"), "digest", "left_semi")
        # The join leaves equal digests in one partition; sorted, they are neighbours.
        texts = texts.sortWithinPartitions("digest")
        counted = texts.mapInArrow(lambda it: _misses(it, content, kind, version), "digest string, version string, n_tokens long")
        counted.write.mode("append").parquet(cache_path)
        stored = read_cache(spark, cache_path).filter(F.col("version") == version).select("digest", "n_tokens")
    out = keys.join(stored, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a cache of this run's own, so that a measured run does all its work."""
    import public_tokenizers as P

    return token_counts(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), scratch(spark, "token-cache"))


def default_cache(spark: SparkSession) -> str:
    """Where counts are kept between runs."""
    return f"{shared_dir(spark)}/copse-token-cache"
