"""The operators against brute force, exact round trips and held-out likelihood."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import json
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from copse.llm import bpe_codec, components, curriculum, fuzzy_lines, lattice_lm, minmax_dedup, parsing_fingerprints, rans, risk_rules, token_cache, wrappers
from copse.llm import queries as registered
from copse.llm._shared import scratch
from tests.oracle import assert_same, connection

P = pytest.importorskip("public_tokenizers")


class Union:
    def __init__(self):
        self.up = {}

    def top(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.top(a), self.top(b)))
        self.up[b] = a


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_matches_sql(spark, small, name):
    assert_same(registered.QUERIES[name](spark, small), registered.ORACLES[name], connection(small))


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 540)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    df = spark.createDataFrame([*edges, (None, 1), (7, None)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert got == {x: u.top(x) for x in u.up}
    assert components.connected_components(df.limit(0)).count() == 0


# 1 -------------------------------------------------------------------------------------------

def test_lattice_sums_all_segmentations():
    v = lattice_lm.Vocabulary(open(P.path("piece_bpe_32k.model"), "rb").read())
    lattice = lattice_lm.Lattice(v, np.stack([v.first_weights(), v.weights(np.arange(v.size) % 7.0)]))
    words = ["the", "unhappily", "ça", "漢字x", "▁odd▁", "\0", "zzzqqq", "a" * 70]
    p = [np.exp(x) for x in lattice.log_p]

    def brute(s, z):
        """By recursion on the first piece, in plain probabilities."""
        if not s:
            return 1.0
        total = 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in v.id_of:
                total += p[z][v.id_of[s[:k]]] * brute(s[k:], z)
        if s[0] not in v.id_of:
            total += math.prod(p[z][v.byte[b]] for b in s[0].encode()) * brute(s[1:], z)
        return total

    for w in words[:3] + ["zzzqqq"]:
        for z in (0, 1):
            assert math.isclose(lattice.log_probability(w)[z], math.log(brute("▁" + w, z)), rel_tol=1e-9)
    batch = lattice_lm.Batch(lattice, words)
    single = np.array([lattice.log_probability(w) for w in words])
    assert np.allclose(batch.log_probability(), single, rtol=1e-9)
    counts = np.zeros((2, v.size))
    batch.expect(np.ones((len(words), 2)), counts)
    alone = [[0.0] * v.size for _ in range(2)]
    for w in words:
        lattice.expect(w, [0, 1], alone)
    assert np.allclose(counts, alone, rtol=1e-7, atol=1e-12)


def test_lattice_scores(spark, small, documents, texts):
    got = {r["doc_id"]: r for r in lattice_lm.op1_lattice_lm(spark, small).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    c = collections.Counter(x for i, ts in tokens.items() if not held[i] for x in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(c[x] > 0 for x in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts), rel_tol=1e-9)
        assert r["score"] < 0
    # real text is likelier than the same letters in words that are reversed
    turned = documents.select("doc_id", "lang", F.array_join(F.transform(F.split("text", " "), lambda w: F.reverse(w)), " ").alias("text"))
    both = documents.select((F.col("doc_id") + 10_000).alias("doc_id"), "lang", "text").union(turned.select("doc_id", "lang", "text"))
    again = {r["doc_id"]: r for r in lattice_lm.lattice_scores(both, P.path("piece_bpe_32k.model"), F.col("doc_id") < 10_000, "lang").collect()}
    worse = sum(again[i]["score"] < again[i + 10_000]["score"] for i in texts if len(texts[i]) > 100)
    assert worse >= 0.98 * sum(len(t) > 100 for t in texts.values())


def test_score_is_the_sum_over_segmentations_and_classes(spark):
    """The score of tiny texts by enumeration: one round of estimation, whole-word arcs, hidden classes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = [(1, "the cat sat", "x"), (2, "The mat the", "x"), (3, "le chat", "y"), (4, "", "y"), (5, "the chat", "x"), (6, "ça cat cat", None)]
    held = {5, 6}
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    steps = {x: k + 2 for k, x in enumerate(sorted({sp.get_score(i) for i in ids}, reverse=True))}
    first = {i: 1 / steps[sp.get_score(i)] for i in ids} | {sp.eos_id(): 0.5}
    first = {i: x / sum(first.values()) for i, x in first.items()}
    piece = {sp.id_to_piece(i): i for i in ids if not sp.is_byte(i)}

    def ways(s):
        """All segmentations as tuples of ids; characters without a piece in bytes."""
        if not s:
            yield ()
            return
        for k in range(1, len(s) + 1):
            if s[:k] in piece:
                yield from ((piece[s[:k]], *rest) for rest in ways(s[k:]))
        if s[0] not in piece:
            spelt = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in s[0].encode())
            yield from (spelt + rest for rest in ways(s[1:]))

    def chance(word, weights):
        return sum(math.prod(weights[i] for i in way) for way in ways("▁" + word))

    train = [(t.lower().split(), z) for i, t, z in docs if i not in held]
    classes = ["x", "y"]
    c = {z: collections.Counter(w for ws, of in train if of == z for w in ws) for z in classes}
    ends = {z: sum(of == z for _, of in train) for z in classes}
    expected = {}
    for z in classes:
        e = collections.Counter()
        for w in c[z]:
            every = [(math.prod(first[i] for i in way), way) for way in ways("▁" + w)]
            for p, way in every:
                for i in way:
                    e[i] += p / sum(q for q, _ in every)
        e[sp.eos_id()] = len(c[z]) * ends[z] / sum(c[z].values())
        expected[z] = e
    both = collections.Counter()
    for e in expected.values():
        both.update(e)
    weights = {}
    for z in classes:
        mass = {i: expected[z][i] + 0.001 * both[i] + 0.01 for i in first}
        weights[z] = {i: x / sum(mass.values()) for i, x in mass.items()}
    n = {z: sum(c[z].values()) + ends[z] for z in classes}
    types = {z: len(c[z]) + 1 for z in classes}
    all_types, total = len(set(c["x"]) | set(c["y"])) + 1, sum(n.values())

    def in_class(counts, z, pieces):
        pooled = (sum(counts.values()) + all_types * pieces) / (total + all_types)
        return (counts[z] + types[z] * pooled) / (n[z] + types[z])

    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in lattice_lm.lattice_scores(df, P.path("piece_bpe_32k.model"), F.col("doc_id").isin(*held), "lang", vocabulary_score=True).collect()}
    for i, t, _ in docs:
        words = t.lower().split()
        of = {z: (ends[z] + 1) / (sum(ends.values()) + 2) * in_class(ends, z, 0.0) * math.prod(in_class({y: c[y][w] for y in classes}, z, chance(w, weights[z])) for w in words) for z in classes}
        assert math.isclose(got[i]["score"], math.log10(sum(of.values())), rel_tol=1e-9)
        own = first[sp.eos_id()] * math.prod(chance(w, first) for w in words)
        assert math.isclose(got[i]["vocabulary_score"], math.log10(own), rel_tol=1e-9)


# 2 -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 70_000, 600_000])
def test_rans_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 5000).astype(np.uint16)
    t = rans.Table(rans.scaled(np.bincount(ids, minlength=5001)))
    block = rans.encode_block(ids, t)
    assert np.array_equal(rans.decode_block(block, t), ids)
    parts = [rans.decode_part(block, k, t) for k in reversed(range(rans.checkpoints(block)))]  # any order, each on its own
    assert np.array_equal(np.concatenate(parts[::-1]) if parts else np.empty(0), ids)
    if n > 1000:
        entropy = -sum(c / n * math.log2(c / n) for c in np.bincount(ids) if c)
        assert len(block) * 8 < 1.25 * n * entropy + 200_000
        damaged = bytearray(block)
        damaged[len(block) // 2] ^= 1
        with pytest.raises(rans.Corrupt):
            rans.decode_block(bytes(damaged), t)
    with pytest.raises(rans.Corrupt):
        rans.decode_block(b"nothing", t)


def test_frequencies():
    f = rans.scaled(np.array([0, 1, 10**12, 5, 0]))
    assert f.sum() == 1 << rans.PRECISION and f[0] == f[4] == 0 and f[1] >= 1


def test_rans_files(spark, small, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, start = {r["doc_id"]: r for r in rans.op2_rans_ids(spark, small).collect()}, 0
    for i in sorted(texts):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 0]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_units_give_the_librarys_ids():
    from tokenizers import Tokenizer

    content = open(P.path("byte_bpe_50k.json"), "rb").read()
    e, t = rans.Encoder(content), Tokenizer.from_str(content.decode())
    parts = ["word", "  two", "\n\nline", " it's", "'s", " x²", " naïve,", "ñ.", " <|endoftext|>", "\t", " ", " 12,5", "...", " \n ", "漢字", "é", " a_b", "×", "", " ", "\x1c", " z", "don't!", " l'été?"]
    for combo in itertools.chain(itertools.permutations(parts, 2), itertools.islice(itertools.permutations(parts, 3), 0, 12_000, 7)):
        text = "".join(combo)
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


# 3 -------------------------------------------------------------------------------------------

def page(article: str, extra: str = "") -> str:
    return f"""<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>no</article>";</script><style>p{{}}</style></head><body>
<header><h2>Site &amp; more</h2></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class=ad>Buy</div>{article}<aside><p>Side</p></aside>{extra}<form><p>Your name</p><input></form><footer>&copy; site</footer></body></html>"""


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host string")
    return {r["page_id"]: r["text"] for r in wrappers.main_text(df).collect()}


def test_extracts_articles(spark):
    body = "<article><h1>Head &lt;1&gt;</h1><p>One  <b>bold</b>\n line<br>two.<p>Open &eacute;<ul><li>x<li>y</ul><div class='comments'><p>Nice!</p></div></article>"
    plain = "<div id=content><h1>Story {i}</h1><p>Some long and varying text number {i} that fills the page with words.</p><p>More of text {i} here.</p></div>"
    pages = [("http://a.example/1", page(body)), ("https://user@A.example:80/2", page(body, "<section id=comments><article><p>Reader</p></article></section>"))]
    pages += [(f"http://b.example/{i}", page(plain.format(i=i) + "<p>The same on all pages.</p>")) for i in range(10)]
    pages += [(None, None), ("", ""), ("not a url", "plain text only"), ("http://c.example", "<p>unclosed <b>markup <a href='x"), ("http://d.example", "<div>" * 3000 + "deep" + "</p>" * 50)]
    got = texts_of(spark, pages)
    want = "Head <1>\nOne bold line two.\nOpen é\nx\ny"
    assert got[0] == got[1] == want
    for i in range(10):
        assert got[2 + i] == f"Story {i}\nSome long and varying text number {i} that fills the page with words.\nMore of text {i} here."
    assert got[12] == got[13] == "" and got[14] == "plain text only" and got[16] == "deep"
    assert len(got) == len(pages)


def test_articles_are_taken_whole(spark):
    article = "<article><h1>Weekly</h1><h2>Summary</h2><p>Body {i}</p></article>"
    plain = "<div id=c><p>Some text of page {i} that fills it</p><ul><li>same<li>same<li>same</ul></div>"
    pages = [("http://a.example", page(article.format(i=i))) for i in range(9)] + [("http://b.example", page(plain.format(i=i))) for i in range(3)]
    got = texts_of(spark, pages)
    assert all(got[i] == f"Weekly\nSummary\nBody {i}" for i in range(9))
    assert all(got[9 + i] == f"Some text of page {i} that fills it\nsame\nsame\nsame" for i in range(3))  # nine blocks, but three pages


def alone(h):
    """The main text's blocks of a page that is all of its host."""
    return wrappers.Placed(wrappers.skeleton(wrappers.parse(h))).text(wrappers.parse(h)).split("\n")


def test_names_do_not_cut_articles():
    article = "<article class='post category-notices tag-social has-comments'><p>Story</p></article>"
    for around in ("<div class='content with-sidebar'>%s</div>", "<section id='comments-enabled-post'>%s</section>", "<div class='no-header'>%s</div>", "<div class=widget><div class=header>%s</div></div>"):
        assert alone("<html><body>" + around % article + "</body></html>") == ["Story"]
    assert alone("<article class=promo><p>Story</p></article>") == ["Story"]
    assert alone("<section id=comments><article><p>A long reply of a reader</p></article></section><article><p>Story</p></article>") == ["Story"]
    assert alone("<article><p>Story</p><div class='related-posts'>x</div><ul class=share-buttons><li>y</ul></article>") == ["Story"]
    assert alone("<div class=widget><p>All the text of the page</p></div><div class=widget><p>less</p></div>") == ["All the text of the page"]


def test_wrappers_fold_and_align():
    def inferred(*pages):
        return wrappers.expression(json.loads(wrappers._aligned_all([json.dumps(wrappers.skeleton(wrappers.parse(h))) for h in pages])))

    a, b, c = "<div><h2>x</h2><p>1</p><p>2</p></div>", "<div><h2>y</h2><p>1</p><table><td>z</table></div>", "<div><p>1</p></div>"
    assert inferred(a, b, c) == "#(div(h2(#)? p(#)+ table(td(=))?))"
    assert inferred(a, a) == "#(div(h2(=) p(=)+))" and inferred(a, a.replace(">2<", ">3<")) == "#(div(h2(=) p(#)+))"
    assert inferred("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "#(dl((dt(=) dd(=))+))"
    assert inferred("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl>") == "#(dl((dt(#) dd(#))+))"
    assert inferred("<p>same<div>x</div>", "<p>same<div>y</div>") == "#(p(=) div(#))"  # equal text is template
    many = ["<div>" + "".join(f"<p class='n{chr(97 + (7 * i + k) % 26)}{chr(97 + k % 26)}{chr(97 + i % 26)}'>{i}</p>" for i in range(60)) + "</div>" for k in range(20)]
    assert inferred(*many) == "#(div(p.*(#)*))"


def nameless(i, body="div"):
    """A page without article, roles or names: links, a constant notice, a line that varies, the story, and a foot."""
    links = "".join(f"<li><a href=/{i}{k}>Section {i} {k}</a>" for k in range(30))
    story = f"<h2>Story {i}</h2><p>Text number {i} says something that no other page says, at length.</p><p>And so does paragraph two of {i}.</p>"
    notice = "<div><p>This notice is the same on every page.</p><p>" + "It is as long as stories are, and longer still. " * 8 + "</p></div>"
    return f"<html><body><div><ul>{links}</ul></div>{notice}<table><td>Seen {i} times</table><{body}>{story}<p>Our paper</p></{body}><center>About {i}</center></body></html>"


def test_wrappers_decide_without_names(spark, monkeypatch):
    pages = [(f"http://n.example/{i}", nameless(i)) for i in range(24)] + [(f"http://n.example/{i}", nameless(i, "section")) for i in range(24, 30)]
    want = {i: f"Story {i}\nText number {i} says something that no other page says, at length.\nAnd so does paragraph two of {i}." for i in range(30)}
    got = texts_of(spark, pages)
    assert all(got[i].startswith(want[i]) and "notice" not in got[i] and "longer still" not in got[i] and "Section" not in got[i] and "Seen" not in got[i] and "About" not in got[i] for i in range(30))
    with monkeypatch.context() as m:  # each page a host of its own: nothing tells the notice from the story
        m.setattr(wrappers, "host_of", lambda url: F.coalesce(url, F.lit("")))
        alone = texts_of(spark, pages)
    assert all("notice" in alone[i] for i in range(30))


def test_wrappers_do_not_depend_on_tasks(spark):
    pages = [(i, f"http://n.example/{i}", nameless(i)) for i in range(60)]
    of = lambda n: {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(n)).collect()}
    assert of(1) == of(37)


def test_all_pages_of_the_table(spark, small):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in wrappers.op3_wrappers(spark, small).collect()}
    for i, h in pages.items():
        inside = re.search(r"<article>(.*)</article>", h, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inside.replace("<br>", " "))]
        assert got[i]["text"] == "\n".join(x for x in parts if x)
        assert got[i]["n_chars"] == len(got[i]["text"])


# 4 -------------------------------------------------------------------------------------------

def test_binomial_tail(spark):
    def exact(n, k, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))

    cases = [(0, 0), (1, 0), (50, 0), (461, 0), (1000, 5), (1000, 12), (1000, 13), (200_000, 2300), (5, 5)]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("t", risk_rules.binomial_tail(F.col("n"), F.col("k"), 0.0125))
    for r in df.collect():
        want = 1.0 if r["n"] == 0 or r["k"] >= r["n"] * 0.0125 else exact(r["n"], r["k"], 0.0125)
        assert math.isclose(r["t"], want, rel_tol=1e-8)


def test_cutoffs_keep_the_good(spark):
    text = lambda i, junk: " ".join(f"w{i}q{k}{'###' if junk else ''}" for k in range(40))
    docs = spark.createDataFrame([(i, text(i, i % 4 == 0), "x" if i % 2 else "y") for i in range(4000)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    got = risk_rules.quality_rules(docs, labels).groupBy((F.col("doc_id") % 4 == 0).alias("junk"), "kept").count().collect()
    assert {(r["junk"], r["kept"]): r["count"] for r in got} == {(True, False): 1000, (False, True): 3000}
    # too few labels prove nothing: only the base decides
    few = risk_rules.quality_rules(docs, labels.limit(50))
    assert few.filter("not kept").count() == 0


def test_cutoffs_act_by_stratum(spark, tmp_path):
    """Strata of other sizes and dirt: the ladder's step in each by brute force, and the SQL's verdicts."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for lang, n, dirty in (("a", 900, 0.0), ("b", 900, 0.01), ("c", 900, 0.3), ("d", 100, 0.0)):
        for _ in range(n):
            i = len(rows)
            good = rng.random() < 0.7
            marks = "##" if (rng.random() < dirty if good else rng.random() < 0.8) else ""
            rows.append((i, " ".join(f"w{i}q{k}{marks}" for k in range(30)), lang, "s", 1))
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in risk_rules.quality_rules(docs, truth).collect()}
    for lang in "abcd":
        mine = [(t.count("#") / 30, y) for (_, t, at, *_), (_, y, _) in zip(rows, labels) if at == lang]
        n, step = sum(y for _, y in mine), None
        for cut in [s["symbols_per_word"] for s in risk_rules.ladder(risk_rules.CUTOFFS)]:
            k = sum(y and x > cut for x, y in mine)
            tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98)) for i in range(k + 1))
            if k >= n * 0.02 or tail > 0.05 / 4:
                break
            step = cut
        refused = {i for (i, t, at, *_) in rows if at == lang and step is not None and t.count("#") / 30 > step}
        assert {i for (i, _, at, *_) in rows if at == lang and not got[i]} == refused, lang
        assert (lang in "ab") == bool(refused)  # dirt among the good, or too few labels, forbids the cut
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    truth.write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert_same(risk_rules.op4_risk_rules(spark, str(tmp_path)), risk_rules.ORACLE, con)


def test_stage_drops_what_fails(spark, small, documents):
    out = risk_rules.quality_stage(spark, documents, small)
    assert out.columns == documents.columns
    kept = {r["doc_id"] for r in risk_rules.op4_risk_rules(spark, small).filter("kept").collect()}
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == kept


# 5 -------------------------------------------------------------------------------------------

def distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_truth(docs):
    """Occurrences (doc_id, position) that go, and the linked pairs of different lines, by edit similarity of words alone."""
    at = collections.defaultdict(list)
    for i, text in docs:
        for p, line in enumerate((text or "").split("\n")):
            rest = "" if line.isascii() else r"\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}"
            w = tuple(x for x in regex.split(rf"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f{rest}]+", line.lower()) if x)
            if w:
                at[w].append((i, p))
    u, pairs = Union(), []
    lines = sorted((w for w in at if len(w) >= 5), key=len)
    bags = [collections.Counter(w) for w in lines]
    holders = collections.defaultdict(list)
    for n, (w, bag) in enumerate(zip(lines, bags)):
        common = collections.Counter()
        for x, k in bag.items():
            for m, j in holders[x]:
                common[m] += min(k, j)
            holders[x].append((n, k))
        for m, k in common.items():
            allowed = math.floor(0.2 * len(w) + 1e-9)
            if k >= len(w) - allowed and distance(w, lines[m]) <= allowed:
                u.join(w, lines[m])
                pairs.append((lines[m], w))
    groups = collections.defaultdict(list)
    for w in at:
        groups[u.top(w)] += at[w]
    return {x for g in groups.values() for x in sorted(g)[1:]}, [(at[a], at[b]) for a, b in pairs]


def lost(spark, docs):
    out = fuzzy_lines.dropped_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    return {(r["k1"], p) for r in out.collect() for p in r["dropped"]}


def test_fuzzy_lines(spark, texts):
    lines = [" ".join(f"item{(7 * i + k * k) % 1000}" for k in range(30)) for i in range(40)]
    variants = [l.replace(l.split()[5], "other", 1) for l in lines] + ["short line"] * 3
    made = [(500_000 + i, "\n".join(x)) for i, x in enumerate(zip(lines, variants))] + [(600_000 + i, v) for i, v in enumerate(variants)]
    docs = [*texts.items(), *made]
    gone, pairs = line_truth(docs)
    assert len(pairs) >= 40 and lost(spark, docs) == gone
    got = fuzzy_lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for r in got:
        text = dict(docs)[r["doc_id"]]
        assert r["text"] == (text and "\n".join(l for p, l in enumerate(text.split("\n")) if (r["doc_id"], p) not in gone))


def test_fuzzy_lines_find_the_pairs_of_a_larger_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    gone, pairs = line_truth(docs)
    got = lost(spark, docs)
    assert len(pairs) > 300
    found = sum(min(b) in got or min(a) in got for a, b in pairs) / len(pairs)  # at most one line of a linked pair is a first
    assert found >= 0.97 and len(got - gone) == 0


def test_crowded_runs(spark):
    """One passage stands in many lines, with little or much else; only lines that are alike are grouped."""
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(1 << 40):x}"
    passage = [f"passage{i}of{i * i}" for i in range(24)]
    docs = []
    for i in range(150):  # the passage in lines of their own: not alike
        own = [word() for _ in range(int(rng.integers(12, 30)))]
        docs.append(" ".join(own[:6] + passage + own[6:]))
        if i % 5 == 0:  # and alike
            own[2] = word()
            docs.append(" ".join(own[:6] + passage + own[6:]))
    for i in range(60):  # little else than the passage: all alike
        docs.append(" ".join([word()] + passage + [word() for _ in range(i % 3)]))
    for i in range(80):  # alike to none, half of what others have
        docs.append(" ".join([word() for _ in range(20)] + passage[:12]))
    order = rng.permutation(len(docs))
    docs = [(int(i), docs[i]) for i in order]
    gone, _ = line_truth(docs)
    assert 80 <= len(gone) <= 95
    assert lost(spark, docs) == gone


def test_lines_around_a_passage_make_few_pairs(spark, monkeypatch):
    """Lines that share much, though too little to be alike, are refused before their words are compared; those that are alike are not."""
    rng = np.random.default_rng(12)
    word = lambda: f"w{rng.integers(1 << 40):x}"
    passage, docs = [f"passage{i}of{i * i}" for i in range(18)], []
    for i in range(240):
        own = [word() for _ in range(8)]
        docs.append((len(docs), " ".join(own[:4] + passage + own[4:])))
        if i % 6 == 0:
            docs.append((len(docs), " ".join(own[:4] + passage + [word(), *own[5:]])))
    compared, verified = [], fuzzy_lines._verified
    monkeypatch.setattr(fuzzy_lines, "_verified", lambda pairs, *more: compared.append(pairs.count()) or verified(pairs, *more))
    gone, pairs = line_truth(docs)
    assert lost(spark, docs) == gone and len(gone) == len(pairs) == 40
    assert sum(compared) <= 3000  # of 39,060


def test_whole_texts_are_joined_alike_at_any_size(spark, documents):
    """No broadcast is forced where whole texts meet their lines or places, so shuffles of small tables tell those of large ones."""
    docs = documents.select("doc_id", "text", "source")
    for out in (fuzzy_lines.dedup_lines(docs), curriculum.mixed(docs)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan and "strategy=broadcast" not in plan


def test_parities_refuse_no_line_at_the_similarity(spark):
    rng = np.random.default_rng(13)
    rows = []
    for n in (5, 9, 16, 30, 80, 300, 1500):
        for k in range(30):
            a = [f"w{x}" for x in rng.integers(0, 3 * n, n)]  # words repeat
            b = list(a)
            for _ in range(n // 5 if k % 3 else 1):  # edits of any kind, as many as are allowed for the length of a
                at, kind = int(rng.integers(len(b))), rng.integers(3)
                b[at : at + (kind != 1)] = [] if kind == 0 else [f"x{rng.integers(1 << 40)}"]
            if n - len(b) <= 0 or distance(a, b) <= len(a) // 5:
                rows.append((len(rows), a, b))
    df = spark.createDataFrame(rows, "lid long, a array<string>, b array<string>")
    of = lambda side, end: fuzzy_lines.simhashes(df.select("lid", F.col(side).alias("words"))).select("lid", F.length("line").alias(f"n{end}"), *[F.col(p).alias(p + end) for p in fuzzy_lines.PARITIES])
    got = of("a", "").join(of("b", "_b"), "lid").withColumn("agree", fuzzy_lines._agree(0.8)).collect()
    assert len(got) == len(rows) > 180 and all(r["agree"] for r in got)


def test_lines_at_the_similarity_are_linked(spark):
    rng = np.random.default_rng(5)
    docs, longest = [], (5, 8, 10, 14, 20, 30, 60, 100)
    for n in longest:
        for k in range(25):
            words = [f"w{x:x}" for x in rng.integers(0, 1 << 40, n)]
            other = list(words)
            for at in rng.choice(n, n // 5, replace=False):  # the most edits that 0.8 allows
                other[at] = f"x{at}y{k}"
            docs += [(1000 * n + 2 * k, " ".join(words)), (1000 * n + 2 * k + 1, " ".join(other))]
    got = fuzzy_lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).filter("n_dropped = 1").collect()
    assert all(r["doc_id"] % 2 for r in got)
    assert len(got) >= 0.97 * 25 * len(longest)
    assert sum(r["doc_id"] < 15_000 for r in got) == 100  # up to 14 words all are found


def test_short_and_unspaced_lines_repeat(spark):
    han = "我们今天在这里讨论数据清洗的方法和结果"
    docs = [(1, "All rights reserved.\n--\nalpha"), (2, "beta\n--\nall rights reserved"), (3, han + "。"), (4, han), (5, han.replace("今", "明")), (6, "beta gamma"), (7, "“Quoted” —word…"), (8, "quoted word"), (9, "完全不同的另一句话没有相同内容")]
    got = {r["doc_id"]: r["text"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = dict(docs) | {2: "beta\n--", 4: "", 5: "", 8: ""}
    assert got == want


def test_simhash_is_the_majority(spark):
    rng = np.random.default_rng(9)
    words = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in (1, 2, 3, 62, 63, 500, 3000)]
    rows = spark.createDataFrame(list(enumerate(words)), "lid long, words array<string>")
    got = {r["lid"]: r["sim"] & (1 << 64) - 1 for r in fuzzy_lines.simhashes(rows).collect()}
    for r in rows.select("lid", F.transform(F.array_distinct("words"), lambda w: F.xxhash64(w)).alias("h")).collect():
        ones = [sum(x >> b & 1 for x in r["h"]) for b in range(64)]
        assert got[r["lid"]] == sum(1 << b for b, k in enumerate(ones) if 2 * k > len(r["h"]))


def test_line_stage(spark, small, documents):
    out = fuzzy_lines.lines_stage(spark, documents, small)
    assert out.columns == documents.columns
    assert out.filter("n_chars <> length(text)").count() == documents.filter("n_chars <> length(text)").count()


# 6 -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, copies, size, percent):
    texts = {r["doc_id"]: r["text"] for r in copies.collect()}
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    u = Union()
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            u.join(a, b)
    for r in minmax_dedup.near_duplicates(copies, size, percent).collect():
        assert r["component_id"] == u.top(r["doc_id"]) and r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (u.top(r["doc_id"]) == r["doc_id"])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    b = np.concatenate([a[:1500], np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))])
    true = 1500 / (len(a) + 500)
    found = np.mean(minmax_dedup.signature(np.sort(a), 400) == minmax_dedup.signature(np.sort(b), 400))
    assert abs(found - true) < 0.06
    assert minmax_dedup.band_rows(0.8) <= minmax_dedup.band_rows(0.85)


def test_one_of_each_group_stays(spark, copies, small):
    out = [r["doc_id"] for r in minmax_dedup.minhash_stage(spark, copies.withColumn("n_chars", F.length("text")), small).collect()]
    assert len(out) == len(set(out)) < copies.count()
    assert sorted(out) == sorted(r["doc_id"] for r in minmax_dedup.near_duplicates(copies).filter("kept").collect())


def test_texts_under_one_id_are_judged_apart(spark, small):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in ("left", "right"))
    docs = spark.createDataFrame([(0, a, "en"), (1, a + " end", "en"), (1, b, "en"), (1, b, "en"), (2, b + " end", "en"), (2, "too short", "en")], "doc_id long, text string, lang string")
    got = sorted(tuple(r) for r in minmax_dedup.minhash_stage(spark, docs, small).select("doc_id", "text").collect())
    assert got == [(0, a), (1, b), (2, "too short")]
    left = risk_rules.quality_stage(spark, docs, small).filter("doc_id = 2").select("text").collect()
    assert [r["text"] for r in left] == [b + " end"]


# 7 -------------------------------------------------------------------------------------------

def test_bpe_is_tiktokens(spark, small, texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe_codec.op7_bpe_codec(spark, small).collect()}
    for i, t in texts.items():
        ids = enc.encode_ordinary(t)
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    c = bpe_codec.codec(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN)
    for token, rank in list(ranks.items())[::41]:
        assert c.decode([rank]) == token


def test_model_needs_whole_ranks():
    with pytest.raises(ValueError):
        bpe_codec.model_proto({b"a": 0, b"b": 2})


# 8 -------------------------------------------------------------------------------------------

def test_equal_parts_have_equal_names():
    rng = np.random.default_rng(2)
    draw = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    part = draw(4000)
    for before, after in ((draw(1), draw(300)), (draw(777), ""), ("", draw(50))):
        a, b = parsing_fingerprints.parsed([part, before + part + after])
        assert parsing_fingerprints.likeness(a, b) > 0.7
    x, y, z = parsing_fingerprints.parsed([part, part, draw(4000)])
    assert parsing_fingerprints.fingerprint(x) == parsing_fingerprints.fingerprint(y) and parsing_fingerprints.likeness(x, z) < 0.1
    # a text's parse does not depend on what it is parsed with
    alone = [parsing_fingerprints.fingerprint(parsing_fingerprints.parsed([t])[0]) for t in (part, "ab", "", "aaaa" * 50, part[:77])]
    together = list(map(parsing_fingerprints.fingerprint, parsing_fingerprints.parsed([part, "ab", "", "aaaa" * 50, part[:77]])))
    assert alone == together
    read = parsing_fingerprints.read_fingerprint(alone[0])
    assert parsing_fingerprints.likeness(read, x) == 1.0


def test_likeness_estimates_the_share_of_names(texts, monkeypatch):
    """Against the names of both texts in full: the estimate's error is that of a sample of 48."""
    long = [t for t in texts.values() if len(t) > 1500][:40]
    pairs = [(t, parsing_fingerprints.edited(t, o)) for t, o in zip(long, long[1:])] + list(zip(long, long[1:])) + [(t, t[: len(t) * 9 // 10]) for t in long]
    every = [x for pair in pairs for x in pair]
    guess = parsing_fingerprints.parsed(every)
    monkeypatch.setattr(parsing_fingerprints, "COARSE", 1 << 20)
    monkeypatch.setattr(parsing_fingerprints, "FINE", 1 << 20)
    whole = [set(p[1].tolist()) for p in parsing_fingerprints.parsed(every)]
    monkeypatch.undo()
    errors = []
    for k in range(0, len(every), 2):
        a, b = whole[k], whole[k + 1]
        true = len(a & b) / len(a | b)
        errors.append(parsing_fingerprints.likeness(guess[k], guess[k + 1]) - true)
    assert np.sqrt(np.mean(np.square(errors))) < 0.08 and abs(np.mean(errors)) < 0.02


def test_places_among_many_cuts(spark):
    cuts = sorted({int(x) for x in np.random.default_rng(3).integers(-(10**9), 10**9, 2000)})
    values = [*cuts[:50], *(c + 1 for c in cuts[::37]), -(10**10), 10**10, *cuts[250:260], cuts[-1]]
    got = spark.createDataFrame([(v,) for v in values], "k long").select("k", parsing_fingerprints._below(F.col("k"), cuts).alias("n")).collect()
    assert all(r["n"] == sum(c < r["k"] for c in cuts) for r in got)


def test_fingerprints(spark, small, texts):
    got = {r["doc_id"]: r for r in parsing_fingerprints.op8_parsing_fingerprints(spark, small).collect()}
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        t = texts[i]
        new = t[: len(t) - len(t) // 3] + texts[j][: len(t) // 3]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        p, q, s = parsing_fingerprints.parsed([t, new, texts[j]])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (parsing_fingerprints.fingerprint(p), parsing_fingerprints.fingerprint(q))
        assert r["near_edited"] == parsing_fingerprints.likeness(p, q) and r["near_next"] == parsing_fingerprints.likeness(p, s)
    long = [r for r in got.values() if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] for r in long]) > 0.35 and np.mean([r["near_next"] for r in long]) < 0.05


def test_next_document_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(parsing_fingerprints, "PARTITION_ROWS", 7)
    ids = [*range(0, 300, 3), 50, 50, 51]
    df = spark.createDataFrame([(i, f"text {i} {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    got = parsing_fingerprints.with_next(df).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["group"]].append(r)
    want = sorted(((i, f"text {i} {n}") for n, i in enumerate(ids)), key=lambda x: (-x[0], x[1]))
    follows = {}
    for part in by.values():
        for a, b in zip(part, part[1:]):
            if not a["guest"]:
                follows[a["doc_id"], a["text"]] = (b["doc_id"], b["text"])
    assert follows == dict(zip(want, want[1:] + want[:1]))


# 9 -------------------------------------------------------------------------------------------

def test_schedules_are_inverted(spark):
    df = spark.range(1001).select((F.col("id") / 1000).alias("u"))
    for s in (*curriculum.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (0.6, 0.0), (1.0, 1.0))):
        got = [(r["u"], r["t"]) for r in df.withColumn("t", curriculum.inverse(s, F.col("u"))).collect()]
        knots = curriculum.cumulative(s)

        def demand(t):
            for (a, ra, d), (b, rb, _) in zip(knots, knots[1:]):
                if t <= b:
                    r = ra + (rb - ra) * (t - a) / (b - a)
                    return d + (t - a) * (ra + r) / 2
            return 1.0

        assert all(abs(demand(t) - u) < 1e-6 for u, t in got)
        assert [t for _, t in got] == sorted(t for _, t in got)
    with pytest.raises(ValueError):
        curriculum.cumulative(((0.0, 1.0), (0.5, 1.0)))


def test_mix(spark, documents):
    plan = curriculum.curriculum(documents).cache()
    per = plan.join(documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"))
    assert all(abs(r["taken"] - r["target"]) <= r["most"] for r in per.collect())
    total = plan.agg(F.sum("size")).first()[0]
    assert math.isclose(per.agg(F.sum("target")).first()[0], 1.5 * total)
    out = curriculum.mixed(documents)
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    assert curriculum.curriculum(documents).exceptAll(plan).count() == 0


def test_small_bins_give_the_same_plan(spark, documents, monkeypatch):
    plan = curriculum.curriculum(documents).cache()
    plan.count()
    monkeypatch.setattr(curriculum, "_BIN_ROWS", 5)
    again = curriculum.curriculum(documents)
    pick = ["doc_id", "copies", "taken", "target"]
    assert again.select(*pick).exceptAll(plan.select(*pick)).count() == 0


# 10 ------------------------------------------------------------------------------------------

def test_counts_and_cache(spark, documents, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = scratch(spark, "cache")
    got = {r["doc_id"]: r for r in token_cache.token_counts(documents, P.path("word_bpe_49k.json"), path).collect()}
    for i, text in texts.items():
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len(text.encode()), n, n > 2048)
    stored = token_cache.read_cache(spark, path)
    distinct = documents.select(token_cache.normalised(True)).distinct().count()
    assert stored.count() == distinct == spark.read.parquet(path).count()  # each text was encoded once
    more = documents.union(spark.createDataFrame([(10**6, "brand new words", "en", "s", 1)], documents.schema))
    token_cache.token_counts(more, P.path("word_bpe_49k.json"), path).count()
    assert spark.read.parquet(path).count() == distinct + 1
    token_cache.token_counts(documents.limit(3), P.path("piece_bpe_32k.model"), path).count()
    assert spark.read.parquet(path).select("version").distinct().count() == 2


def test_a_second_run_encodes_nothing(spark, documents, monkeypatch):
    path = scratch(spark, "cache")
    first = sorted(map(tuple, token_cache.token_counts(documents, P.path("word_bpe_49k.json"), path).collect()))

    def never(*_):
        raise AssertionError("a miss")

    monkeypatch.setattr(token_cache, "_misses", never)
    assert sorted(map(tuple, token_cache.token_counts(documents, P.path("word_bpe_49k.json"), path).collect())) == first


def test_other_settings_go_to_the_library():
    """The short cuts hold for the files' own settings only."""
    t = json.load(open(P.path("word_bpe_49k.json")))
    assert token_cache.drops_space(json.dumps(t).encode())
    for change in ({"normalizer": None}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [t["added_tokens"][0] | {"content": "abc"}]}):
        assert not token_cache.drops_space(json.dumps(t | change).encode())
    t = json.load(open(P.path("byte_bpe_50k.json")))
    assert rans.splits_at_space(json.dumps(t).encode())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"added_tokens": [t["added_tokens"][0] | {"content": "abc"}]}):
        assert not rans.splits_at_space(json.dumps(t | change).encode())


def test_words_give_the_librarys_counts():
    content = open(P.path("word_bpe_49k.json"), "rb").read()
    c = token_cache.Counter(content, "json")
    parts = ["Word", " two,", "\n", " it's", "'S", " x²", " NAÏVE,", "ñ.", "<|endoftext|>", " ", " 12,5", "...", "漢字", "é", " a_b", "ΣΑΣ", "İ", "ß", "", "\x1c", "don't!", " l'été?"]
    for combo in itertools.chain(itertools.permutations(parts, 2), itertools.islice(itertools.permutations(parts, 3), 0, 9000, 5)):
        text = "".join(combo)
        assert c.counts([text]) == c.whole([text]), repr(text)
        squeezed = " ".join(re.split(r"[\x20\x09-\x0d]+", text)).strip(" ")
        assert c.whole([squeezed]) == c.whole([text]), repr(text)


# pipeline ------------------------------------------------------------------------------------

def test_pipeline(spark, small, documents, texts):
    import corpus_pipeline
    from copse.llm._shared import written

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "source_mixing", "byte_bpe"]
    docs, sizes = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, small), f"test-{name}")
        if name != "byte_bpe":
            assert out.columns == documents.columns
        if name == "source_mixing":
            plan = curriculum.curriculum(docs)
            assert out.count() == plan.agg(F.sum("copies")).first()[0]
        else:
            assert out.count() <= docs.count()
        docs = out
        sizes.append(out.count())
    assert corpus_pipeline.run(spark, small).count() == sizes[-1] > 0
    assert docs.filter("size(ids) <> n_tokens").count() == 0
