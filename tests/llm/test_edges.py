"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from copse.llm import bpe_codec, curriculum, fuzzy_lines, lattice_lm, minmax_dedup, parsing_fingerprints, rans, risk_rules, token_cache, wrappers
from copse.llm._shared import scratch
from tests.llm.conftest import PROSE, rows

P = pytest.importorskip("public_tokenizers")
N = len(rows())


PAGE_SCHEMA = "page_id long, url string, html string, host string, wrapper string, text string"


def run_all(spark, docs):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    path = scratch(spark, "edge")
    rans.write_ids(docs, P.path("byte_bpe_50k.json"), path)
    return {
        1: lattice_lm.lattice_scores(docs, P.path("piece_bpe_32k.model"), F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == 2, "lang"),
        2: rans.read_ids(spark, path, keep_ids=True),
        4: risk_rules.quality_rules(docs, labels),
        5: fuzzy_lines.dedup_lines(docs),
        6: minmax_dedup.near_duplicates(docs),
        7: bpe_codec.bpe_encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
        8: parsing_fingerprints.fingerprints(docs),
        9: curriculum.curriculum(docs),
        10: token_cache.token_counts(docs, P.path("word_bpe_49k.json"), scratch(spark, "cache")),
    }


@pytest.fixture(scope="module")
def found(spark, edge):
    return {k: df.collect() for k, df in run_all(spark, edge).items()}


def test_one_row_for_each(found):
    assert {k: len(v) for k, v in found.items()} == dict.fromkeys(found, N)


def test_empty_tables(spark, none):
    assert {k: df.count() for k, df in run_all(spark, none).items()} == dict.fromkeys((1, 2, 4, 5, 6, 7, 8, 9, 10), 0)
    assert wrappers.main_text(spark.createDataFrame([], PAGE_SCHEMA)).count() == 0
    assert curriculum.mixed(none).count() == 0


def test_without_training_documents(spark, edge):
    got = lattice_lm.lattice_scores(edge, P.path("piece_bpe_32k.model"), F.lit(True), "lang").collect()
    assert len(got) == N and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in got)


def test_scores_of_empty_texts(found):
    empty = [r for r in found[1] if r["n_tokens"] == 1]
    assert len(empty) == 4 and len({r["score"] for r in empty}) == 1
    assert all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in found[1])


def test_ids_of_empty_texts(found):
    got = sorted((r["start"], r["n_tokens"]) for r in found[2])
    assert all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))  # the ids lie end to end
    assert sum(r["ids"] == b"\0\0\0\0" for r in found[2]) == 3  # null, empty and null without an id


def test_rules(found):
    kept = {r["doc_id"]: r["kept"] for r in found[4] if r["doc_id"] != 1}
    assert kept[2] and not kept[4] and not kept[5] and not kept[10]
    assert all(not r["base_failed"] for r in found[4] if r["n_words"] == len(PROSE.split()))


def test_lines(found):
    by = {}
    for r in found[5]:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2][0]["text"] == "" and by[2][0]["n_dropped"] == 1  # a copy loses its line
    assert by[4][0]["text"] is None and by[4][0]["n_lines"] == 0
    assert by[5][0]["text"] == "" and by[5][0]["n_lines"] == 1
    assert by[6][0]["text"] == " \t\n\n "
    assert by[11][0]["text"].count("comes twice") == 1
    assert sum(r["text"] == PROSE for r in found[5]) == 1  # the one without an id comes first
    assert "class" in found[5][0].asDict()


def test_near_duplicates(found):
    by = {r["doc_id"]: r for r in found[6] if r["doc_id"] not in (None, 1)}
    assert by[2]["component_id"] == by[3]["component_id"] == 1 and not by[2]["kept"]
    for i in (4, 5, 6):
        assert by[i]["n_shingles"] == 0 and by[i]["kept"] and by[i]["component_id"] == i
    assert by[10]["n_shingles"] == 1
    assert all(r["kept"] and r["component_id"] is None for r in found[6] if r["doc_id"] is None)


def test_bpe_round_trip(spark, edge, found):
    want = sorted(str(hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows())
    assert sorted(r["decoded_sha256"] for r in found[7]) == want
    enc = bpe_codec.bpe_encode(edge, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    back = sorted(r["text"] for r in bpe_codec.bpe_decode(enc, P.path("byte_bpe_multi_50k.tiktoken")).collect())
    assert back == sorted(r[1] or "" for r in rows())


def test_fingerprints(found):
    by_text = {}
    for r in found[8]:
        by_text.setdefault(r["doc_id"], []).append(r)
    assert by_text[2][0]["fingerprint"] in {r["fingerprint"] for r in by_text[1]}
    assert by_text[4][0]["n_chars"] == by_text[5][0]["n_chars"] == 0 and by_text[4][0]["fingerprint"] == by_text[5][0]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found[8])


def test_curriculum(found):
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] and len(r["positions"]) == r["copies"] for r in found[9])
    assert all(r["taken"] == 0 for r in found[9] if r["size"] == 0)


def test_mixed_keeps_columns_and_counts(spark, edge, found):
    out = curriculum.mixed(edge)
    assert out.columns == edge.columns
    assert out.count() == sum(r["copies"] for r in found[9])


def test_counts(found):
    by = {r["doc_id"]: r for r in found[10]}
    assert by[4]["n_tokens"] == by[5]["n_tokens"] == by[6]["n_tokens"] == 0
    assert by[7]["over_limit"] and not by[10]["over_limit"]


def test_pages(spark):
    long = "<article>" + "".join(f"<p>paragraph {i}</p>" for i in range(20_000)) + "</article>"
    pages = [
        (1, "http://a.example/1", "<article><p>One</p></article>"), (1, "http://a.example/1", "<article><p>One</p></article>"),  # a repeated row
        (1, "http://a.example/1", "<article><p>Other</p></article>"), (None, "http://a.example/2", "<article><p>No id</p></article>"),
        (2, None, None), (3, "http://a.example/3", ""), (4, "http://long.example/", long), (5, "::::", "&lt;text&gt;"), (6, None, "<article></article>"),
    ]
    got = wrappers.main_text(spark.createDataFrame([(*p, "x", None, "y") for p in pages], PAGE_SCHEMA)).collect()
    found = sorted((-1 if r["page_id"] is None else r["page_id"], r["text"]) for r in got if r["page_id"] != 4)
    assert found == [(-1, "No id"), (1, "One"), (1, "One"), (1, "Other"), (2, ""), (3, ""), (5, "<text>"), (6, "")]
    whole = next(r for r in got if r["page_id"] == 4)
    assert whole["text"].count("\n") == 19_999 and whole["n_chars"] == len(whole["text"])


def test_stages(spark, edge, none, tmp_path):
    """Every stage and the whole pipeline on the edge rows and on an empty table."""
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    left = {}
    for name, docs in (("edge", edge), ("none", none)):
        at = str(tmp_path / name)
        docs.write.parquet(os.path.join(at, "documents.parquet"))
        labels.write.parquet(os.path.join(at, "labels.parquet"))
        for stage, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, at)
            assert sorted(out.columns) == sorted(docs.columns), stage
            left[name, stage] = out.collect()
        left[name, "run"] = corpus_pipeline.run(spark, at).collect()
    assert not any(v for (name, _), v in left.items() if name == "none")
    ids = lambda stage: sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "")[:20]) for r in left["edge", stage])
    assert (10, "one two three") not in ids("quality_rules") and (2, PROSE[:20]) in ids("quality_rules")
    # other texts under one doc_id are judged on their own: the copy of doc 1 goes, its other text stays
    assert [x for x in ids("minhash_near_dedup") if x[0] in (1, 2, 3)] == [(1, "another text under t"), (1, PROSE[:20])]
    assert sum(i == -1 for i, _ in ids("minhash_near_dedup")) == 2  # rows without an id stay
    assert all(r["n_tokens"] > 0 for r in left["edge", "run"])


def test_a_text_under_an_id_does_not_decide_another(spark, tmp_path):
    """A short row and a clean one share an id, and a copy shares an id with a text of its own."""
    clean, own = PROSE + " " + PROSE.upper()[::-1], " ".join(f"own{i}" for i in range(60))
    docs = spark.createDataFrame([(1, clean, "en", "a", 1), (1, "too short", "en", "a", 1), (2, clean, "en", "a", 1), (2, own, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = risk_rules.quality_stage(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted([(1, clean), (2, clean), (2, own)])
    assert sorted((r["doc_id"], r["text"]) for r in minmax_dedup.minhash_stage(spark, out, "").collect()) == sorted([(1, clean), (2, own)])
