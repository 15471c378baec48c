"""Likelihood of texts under a subword lattice.

The pieces and their scores come from an existing vocabulary; nothing adds or drops a
piece. Scores of a BPE file are negative ranks, no log probabilities, so they are normalised as such:
probability falling as one over the rank. On request ``vocabulary_score`` is the marginal under these
weights alone, with nothing learnt.

``score`` is that of the model adapted to the training documents. Weights are re-estimated from their
distinct words by expectation over all segmentations (forward-backward), which keeps every
piece possible.

A text is a sequence of words, each with a word mark in front, and an end. A word's
probability is the sum over all paths through its lattice, found by a forward recursion in
log space. Paths are its segmentations into pieces (characters without a piece are spelt in byte
pieces) and one arc for the whole word, weighted by how often the training documents hold
it; the word's count and the pieces share the mass as by Witten and Bell. As no arc crosses
a word mark, a text's probability is a product over its words, and the pieces of each
distinct word are summed once, whatever the number of texts that hold it.

Whole-word arcs depend on the text's class (its language), which is a hidden variable: the
text's marginal probability is the sum over classes, weighted by their share of the training
documents. A class's counts are smoothed by those of all.

Texts are cut into chunks of bounded size. Each chunk has a dictionary of its own, and only
dictionaries meet in the join on words: the shuffle carries distinct words of a chunk, not
words.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm._shared import table, text_of, written

MARK = "▁"
CHUNK_BYTES, CHUNK_WORDS = 32 << 20, 600_000


class Vocabulary:
    """Pieces of a sentencepiece file in id order, with what the lattice needs."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        ids = range(n)
        self.size = n
        self.end = sp.eos_id()
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scored = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        plain = [i for i in scored if not sp.is_byte(i)]
        self.usable = np.zeros(n, bool)
        self.usable[scored] = True
        self.usable[self.end] = True
        self.id_of = {sp.id_to_piece(i): i for i in plain}
        self.scores = np.array([sp.get_score(i) for i in ids])

    def first_weights(self) -> np.ndarray:
        """Log probability by piece: one over the rank of its score, ties sharing a rank; the end is as likely as the best."""
        rank = np.zeros(self.size)
        use = np.flatnonzero(self.usable)
        _, at = np.unique(-self.scores[use], return_inverse=True)
        rank[use] = at + 2.0
        rank[self.end] = 2.0
        return self.normalised(np.where(self.usable, 1 / np.maximum(rank, 1), 0.0))

    def weights(self, expected: np.ndarray, smooth: float = 0.01) -> np.ndarray:
        """Log probability by piece from expected counts; every usable piece keeps some."""
        return self.normalised(np.where(self.usable, expected + smooth, 0.0))

    @staticmethod
    def normalised(mass: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(mass / mass.sum())


class Lattice:
    """All segmentations of a word, under the log probabilities of each class."""

    def __init__(self, vocabulary: Vocabulary, log_p: np.ndarray):
        self.v = vocabulary
        self.log_p = [p.tolist() for p in log_p]
        self.trie: dict = {}  # by character; the piece's id at ""
        for piece, i in vocabulary.id_of.items():
            at = self.trie
            for c in piece:
                at = at.setdefault(c, {})
            at[""] = i

    def arcs(self, word: str) -> list[list[tuple[int, tuple[int, ...]]]]:
        """By end position: (start, ids) of each arc. Characters without a piece, and word marks inside a word, are spelt in bytes."""
        s = MARK + word.replace(MARK, "\0")
        n, trie = len(s), self.trie
        into: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            at = trie
            for j in range(i, n):
                at = at.get(s[j])
                if at is None:
                    break
                k = at.get("")
                if k is not None:
                    into[j + 1].append((i, (k,)))
            first = trie.get(s[i])
            if first is None or "" not in first:
                into[i + 1].append((i, tuple(self.v.byte[b] for b in (word[i - 1] if i else MARK).encode("utf-8", "replace"))))
        return into

    def forward(self, into, of: int) -> list[float]:
        """Log of the summed probability of all paths to each position, in a class."""
        exp, log, p = math.exp, math.log, self.log_p[of]
        alpha = [0.0]
        for arcs in into[1:]:
            terms = [alpha[i] + (p[ids[0]] if len(ids) == 1 else sum([p[k] for k in ids])) for i, ids in arcs]
            if len(terms) == 1:
                alpha.append(terms[0])
            elif terms:
                m = max(terms)
                alpha.append(m + log(sum([exp(t - m) for t in terms])))
            else:
                alpha.append(-math.inf)
        return alpha

    def log_probability(self, word: str) -> list[float]:
        """By class."""
        into = self.arcs(word)
        return [self.forward(into, of)[-1] for of in range(len(self.log_p))]

    def expect(self, word: str, of: list[int], counts: list[list[float]]) -> None:
        """Add the expected number of uses of each piece, over all segmentations, in each of the classes ``of``."""
        into = self.arcs(word)
        n, exp = len(into) - 1, math.exp
        for z in of:
            alpha, p, into_counts = self.forward(into, z), self.log_p[z], counts[z]
            share = [0.0] * n + [1.0]  # of the paths through each position
            for j in range(n, 0, -1):
                at, base = share[j], alpha[j]
                if at:
                    for i, ids in into[j]:
                        x = at * exp(alpha[i] + (p[ids[0]] if len(ids) == 1 else sum([p[k] for k in ids])) - base)
                        share[i] += x
                        for k in ids:
                            into_counts[k] += x


class Batch:
    """The lattices of many words at once: arcs as arrays, positions one after another, all classes together.

    What :class:`Lattice` does word by word, for words of up to LONG characters.
    """

    def __init__(self, lattice: Lattice, words: list[str]):
        self.lattice, self.n = lattice, len(words)
        keys: list[int] = []  # end and word of each arc
        starts: list[int] = []
        pieces: list[int] = []
        spelt: dict[tuple[int, ...], int] = {}
        trie, size, byte = lattice.trie, lattice.v.size, lattice.v.byte
        for w, word in enumerate(words):
            s = MARK + word.replace(MARK, "\0")
            n = len(s)
            for i in range(n):
                at = trie
                for j in range(i, n):
                    at = at.get(s[j])
                    if at is None:
                        break
                    k = at.get("")
                    if k is not None:
                        keys.append((j + 1 << 24) + w)
                        starts.append(i)
                        pieces.append(k)
                first = trie.get(s[i])
                if first is None or "" not in first:
                    ids = tuple(byte[b] for b in (word[i - 1] if i else MARK).encode("utf-8", "replace"))
                    keys.append((i + 1 << 24) + w)
                    starts.append(i)
                    pieces.append(spelt.setdefault(ids, size + len(spelt)))
        key = np.array(keys)
        order = np.argsort(key, kind="stable")
        key = key[order]
        self.end, self.word = key >> 24, key & 0xFFFFFF
        self.start, self.piece = np.array(starts)[order], np.array(pieces)[order]
        self.spelt = list(spelt)
        self.length = np.array([len(w) + 1 for w in words])
        self.cuts = np.searchsorted(self.end, np.arange(self.length.max(initial=0) + 2))
        p = np.array(lattice.log_p).T
        extra = [p[list(ids)].sum(axis=0) for ids in spelt]
        self.p = np.vstack([p, *extra]) if extra else p
        self.alpha = np.zeros((self.n, int(self.length.max(initial=0)) + 1, p.shape[1]))
        for j in range(1, len(self.cuts) - 1):
            at = slice(self.cuts[j], self.cuts[j + 1])
            w = self.word[at]
            if len(w):
                terms = self.alpha[w, self.start[at]] + self.p[self.piece[at]]
                first = np.flatnonzero(np.diff(w, prepend=-1))
                most = np.maximum.reduceat(terms, first, axis=0)
                sums = np.add.reduceat(np.exp(terms - np.repeat(most, np.diff(first, append=len(w)), axis=0)), first, axis=0)
                self.alpha[w[first], j] = most + np.log(sums)

    def log_probability(self) -> np.ndarray:
        """Words by classes."""
        return self.alpha[np.arange(self.n), self.length]

    def expect(self, in_class: np.ndarray, counts: np.ndarray) -> None:
        """Add the expected uses of each piece (classes by pieces) for the words in their classes (words by classes, 0 or 1)."""
        share = np.zeros_like(self.alpha)
        share[np.arange(self.n), self.length] = in_class
        used = np.zeros((len(self.word), self.alpha.shape[2]))
        for j in range(len(self.cuts) - 2, 0, -1):
            at = slice(self.cuts[j], self.cuts[j + 1])
            w, start = self.word[at], self.start[at]
            if len(w):
                x = share[w, j] * np.exp(self.alpha[w, start] + self.p[self.piece[at]] - self.alpha[w, j])
                share[w, start] += x  # a word has one arc from a start to an end
                used[at] = x
        for z in range(used.shape[1]):
            sums = np.bincount(self.piece, used[:, z], len(self.p))
            counts[z] += sums[: counts.shape[1]]
            for ids, x in zip(self.spelt, sums[counts.shape[1] :]):
                for k in ids:
                    counts[z, k] += x


LONG, BATCH_WORDS = 64, 4096


def _batches(words: list[str]) -> Iterator[list[int]]:
    """Numbers of words of like length, few enough at once; a longer word stands alone."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for at in range(0, len(order), BATCH_WORDS):
        part = order[at : at + BATCH_WORDS]
        yield [i for i in part if len(words[i]) <= LONG]
        yield from ([i] for i in part if len(words[i]) > LONG)


def _chunks(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (their words as numbers in the chunk's dictionary) and of dictionaries."""
    names = ["chunk", "doc_id", "held_out", "numbers", "word", "number", "train"]
    lists = pa.list_(pa.int64())

    def fresh():
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__  # a new word has the next number
        return index, [], 0

    task, chunks = TaskContext.get().partitionId(), itertools.count()

    def flush(index, docs):
        chunk = (task << 20) + next(chunks)  # small numbers take little room in a shuffle
        train = np.zeros((len(index), classes), np.int64)
        for z in range(classes):
            of_class = [ids for _, held, of, ids in docs if of == z and not held]
            if of_class:
                train[:, z] = np.bincount(np.concatenate(of_class), minlength=len(index))
        for at in range(0, len(docs), 512):
            part = docs[at : at + 512]
            m = len(part)
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk] * m, pa.int64()), pa.array([d[0] for d in part], pa.int64()), pa.array([d[1] for d in part], pa.bool_()),
                pa.array([d[3].tobytes() for d in part], pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, lists),
            ], names)
        words = list(index)
        for at in range(0, len(words), 16384):
            part = words[at : at + 16384]
            m = len(part)
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk] * m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()),
                pa.array(part, pa.binary()), pa.array(range(at, at + m), pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * classes, pa.int32()), pa.array(train[at : at + m].ravel())),
            ], names)

    index, docs, size = fresh()
    for batch in batches:
        for doc, held, of, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "class", "text"))):
            raw = text.encode("utf-8", "replace")
            words = raw.lower().split()
            docs.append((doc, held, of, np.fromiter(map(index.__getitem__, words), np.uint32, len(words))))
            size += len(raw) + 64
            if size >= CHUNK_BYTES or len(index) >= CHUNK_WORDS:
                yield from flush(index, docs)
                index, docs, size = fresh()
    if docs:
        yield from flush(index, docs)


def _expected(batches: Iterator[pa.RecordBatch], model: bytes, log_p: np.ndarray) -> Iterator[pa.RecordBatch]:
    lattice = Lattice(Vocabulary(model), log_p)
    found = np.zeros((len(log_p), lattice.v.size))
    for batch in batches:
        words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
        seen = np.array(batch.column("c").to_pylist(), dtype=np.int64).reshape(len(words), -1) > 0
        for part in _batches(words):
            if part and len(words[part[0]]) <= LONG:
                Batch(lattice, [words[i] for i in part]).expect(seen[part].astype(float), found)
            elif part:
                counts = [[0.0] * lattice.v.size for _ in log_p]
                lattice.expect(words[part[0]], np.flatnonzero(seen[part[0]]).tolist(), counts)
                found += np.array(counts)
    of, used = np.nonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(used, pa.int32()), pa.array(found[of, used], pa.float64())], ["class", "piece", "expected"])


def _scored_words(batches: Iterator[pa.RecordBatch], model: bytes, log_p: np.ndarray, word_model: WordModel, own: bool) -> Iterator[pa.RecordBatch]:
    """Each word's count, its log probability in each class, and if asked for that under the vocabulary's weights."""
    vocabulary, k = Vocabulary(model), len(log_p)
    lattice = Lattice(vocabulary, np.vstack([log_p, vocabulary.first_weights()]) if own else log_p)
    names = ["word", "c", *[f"l{z}" for z in range(k)], *["own"] * own]
    for batch in batches:
        words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
        c = np.array(batch.column("c").to_pylist(), dtype=float).reshape(len(words), k)
        pieces = np.zeros((len(words), k + own))
        for part in _batches(words):
            if part and len(words[part[0]]) <= LONG:
                pieces[part] = Batch(lattice, [words[i] for i in part]).log_probability()
            elif part:
                pieces[part[0]] = lattice.log_probability(words[part[0]])
        logs = np.hstack([word_model.log_words(c, pieces[:, :k]), pieces[:, k:]])
        yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(c.sum(axis=1).astype(np.int64)), *[pa.array(x, pa.float64()) for x in logs.T]], names)


class WordModel:
    """Counts of all training tokens and of those of each class, for smoothing."""

    def __init__(self, tokens: list[int], types: list[int], ends: list[int], all_types: int):
        self.tokens, self.types, self.ends = (np.array(x, float) for x in (tokens, types, ends))
        self.n, self.v = int(self.tokens.sum()), all_types  # with ends
        self.known_end = self.ends.sum() > 0
        share = self.ends + 1
        self.log_class = np.log(share / share.sum())

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))

    def log_words(self, by_class: np.ndarray, log_pieces: np.ndarray) -> np.ndarray:
        """Log probability of words (rows) in each class: the whole-word arc with the counts, and the pieces."""
        least = max(self.v, 1)
        with np.errstate(divide="ignore"):
            pooled = np.logaddexp(np.log(by_class.sum(axis=1, keepdims=True)), math.log(least) + log_pieces) - math.log(self.n + least)
            back = np.maximum(self.types, 1)
            return np.logaddexp(np.log(by_class), np.log(back) + pooled) - np.log(self.tokens + back)

    def log_end(self) -> np.ndarray:
        """The end has no pieces; without training documents it is as likely as not."""
        if not self.known_end:
            return np.full(len(self.ends), math.log(0.5))
        return self.log_words(self.ends[None, :], np.full((1, len(self.ends)), -np.inf))[0]


def _scored_docs(docs: pd.DataFrame, words: pd.DataFrame, model: WordModel, own_end: float) -> pd.DataFrame:
    """One chunk: its documents and its dictionary with counts and log probabilities."""
    size, k = (0 if words.empty else int(words["number"].max()) + 1), len(model.ends)
    base, known, logs, own = np.zeros(size), np.zeros(size, bool), np.zeros((k, size)), np.zeros(size)
    if size:
        at, c = words["number"].to_numpy(), words["c"].to_numpy().astype(float)
        base[at], known[at] = model.base(c), c > 0
        if "own" in words:
            own[at] = words["own"].to_numpy()
        for z in range(k):
            logs[z, at] = words[f"l{z}"].to_numpy()
    end_base, end = float(model.base(model.ends.sum())), model.log_end()
    rows = []
    for raw in docs["numbers"]:
        ids = np.frombuffer(raw, np.uint32)
        joint = model.log_class + np.array([x[ids].sum() for x in logs]) + end
        rows.append((len(ids) + 1, int(known[ids].sum()) + int(model.known_end), base[ids].sum() + end_base, np.logaddexp.reduce(joint) / math.log(10), (own[ids].sum() + own_end) / math.log(10)))
    out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base_score", "score", "vocabulary_score"])
    out.insert(0, "held_out", docs["held_out"].to_numpy())
    out.insert(0, "doc_id", docs["doc_id"].to_numpy())
    return out


def lattice_scores(docs: DataFrame, model_path: str, held_out, class_col: str | None = None, rounds: int = 1, most_classes: int = 32, vocabulary_score: bool = False) -> DataFrame:
    """Each text's score: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, and ``vocabulary_score`` if asked for.

    ``held_out`` is a condition on the documents; the others are learnt from. Tokens are
    words (ASCII lower case, ASCII white space) and one end. ``score`` is the log10
    marginal probability of the text under the adapted lattice, ``vocabulary_score`` that under
    the vocabulary's own weights, ``base_score`` the sum of
    log10((c + 1) / (N + V + 1)) over tokens, with c the token's count, N all and V distinct
    training tokens. ``n_known`` counts tokens with c > 0. ``class_col`` names the hidden
    class; where it has more than ``most_classes`` values, the rarer ones are one class.

    Null and empty texts have the end as their only token. A null doc_id stays null and is
    treated as the empty id; a null class is a class like any other; repeated rows count as
    often as they stand. Without training documents the first weights hold and N and V are 0.
    Extra columns are not read. An empty table gives an empty table.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    vocabulary = Vocabulary(model)
    of = F.coalesce(F.concat(F.lit("="), F.col(class_col).cast("string")), F.lit("")) if class_col else F.lit("")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), of.alias("of"), text_of().alias("text"))
    names = [r["of"] for r in docs.filter("not held_out").groupBy("of").count().orderBy(F.desc("count"), "of").limit(most_classes).collect()]
    k = max(1, len(names))
    number = F.greatest(F.array_position(F.array(*[F.lit(x) for x in names]), F.col("of")).cast("int"), F.lit(1)) - 1 if names else F.lit(0)
    if len(names) == most_classes:  # the rarest listed class takes all that are not listed
        number = F.when(F.col("of").isin(names), number).otherwise(k - 1)
    schema = "chunk long, doc_id long, held_out boolean, numbers binary, word binary, number int, train array<long>"
    rows = docs.select("doc_id", "held_out", number.alias("class"), "text")
    parts = written(rows.mapInArrow(lambda it: _chunks(it, k), schema), "chunks")
    entries = parts.filter("word is not null").select("chunk", "number", "word", "train")
    texts = parts.filter("numbers is not null").select("chunk", "doc_id", "held_out", "numbers")

    sums = entries.groupBy("word").agg(*[F.sum(F.get("train", F.lit(i))).alias(f"c{i}") for i in range(k)])
    words = written(sums.select("word", F.array(*[f"c{i}" for i in range(k)]).alias("c")), "words")
    each = [x for i in range(k) for x in (F.sum(F.get("c", F.lit(i))), F.sum((F.get("c", F.lit(i)) > 0).cast("long")))]
    seen = F.exists("c", lambda x: x > 0)
    found = [x or 0 for x in words.agg(*each, F.sum(seen.cast("long"))).first()]
    ended = {r["class"]: r["n"] for r in rows.filter("not held_out").groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = [ended.get(i, 0) for i in range(k)]
    any_end = int(sum(ends) > 0)
    word_model = WordModel([found[2 * i] + ends[i] for i in range(k)], [found[2 * i + 1] + (ends[i] > 0) for i in range(k)], ends, found[-1] + any_end)

    log_p = np.stack([vocabulary.first_weights()] * k)
    for _ in range(rounds if found[-1] else 0):
        learnt = words.filter(seen).mapInArrow(lambda it, w=log_p: _expected(it, model, w), "class int, piece int, expected double")
        expected = np.zeros((k, vocabulary.size))
        for row in learnt.groupBy("class", "piece").agg(F.sum("expected").alias("x")).collect():  # a row a class and piece at most
            expected[row["class"], row["piece"]] = row["x"]
        expected[:, vocabulary.end] = [found[2 * i + 1] * ends[i] / max(1, found[2 * i]) for i in range(k)]  # ends are as rare as among tokens
        log_p = np.stack([vocabulary.weights(x + 0.001 * expected.sum(axis=0)) for x in expected])
    own = vocabulary_score
    logs = [*[f"l{z}" for z in range(k)], *["own"] * own]
    scored = words.mapInArrow(lambda it: _scored_words(it, model, log_p, word_model, own), "word binary, c long, " + ", ".join(f"{x} double" for x in logs))
    filled = entries.select("chunk", "number", "word").join(scored, "word").select(F.col("chunk").alias("of"), "number", "c", *logs)
    own_end = float(vocabulary.first_weights()[vocabulary.end])
    names = ["n_tokens long", "n_known long", "base_score double", "score double", "vocabulary_score double"]
    spread = 4 * max(1, texts.select("chunk").distinct().count())  # so that few chunks meet in a task
    out = texts.repartition(spread, "chunk").groupBy("chunk").cogroup(filled.repartition(spread, "of").groupBy("of")).applyInPandas(
        lambda d, w: _scored_docs(d, w, word_model, own_end), "doc_id long, held_out boolean, " + ", ".join(names))
    columns = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(word_model.n).cast("long").alias("train_tokens"), "base_score", "score"]
    return out.select(*columns, *["vocabulary_score"] * own)


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return lattice_scores(table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"), held, class_col="lang")
