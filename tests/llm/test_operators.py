"""Each operator against its plain form, over real and odd rows."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from brute import SF
from pyspark.sql import functions as F

from tracewright.llm import bpe, decontaminate, html, jaccard, licences, lm, pii, quality, substrings


@pytest.fixture(scope="session")
def reference_encoding():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pii(documents, corpus):
    got = {r.doc_id: r for r in pii.digest(pii.extract(documents)).collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        want = brute.pii(t)
        assert got[i].base_sha256 == brute.sha(brute.listed(want))
        assert set(filter(None, brute.listed(want).split(","))) <= set(got[i].spans.split(","))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]


def test_pii_edges(spark):
    texts = ["a@b.co_x@y.com zz a@b..c 1.2.3.4.5.6.7.8 +1 (017) 555-7713 é😀 4785380592391139-12 x@y.z, 300.1.1.1 000255.1.1.1", "7" * 30_000, "a" * 50_000 + "@", "1.2.3.4 " * 2000, "9 9" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(pii.extract(df)).collect():
        assert r.base_sha256 == brute.sha(brute.listed(brute.pii(texts[r.doc_id])))
    assert pii.digest(pii.extract(df.limit(0))).count() == 0


def twin(texts):
    return brute.bootstrapped(texts, pii.TOKEN, pii.NUMBERS, pii.CREDENTIALS)


def test_pii_spans_equal_the_plain_form(spark, documents, corpus):
    """The whole corpus, and a text with contexts, forms, ties and short values of its own."""
    got = {r.doc_id: r.spans for r in pii.digest(pii.extract(documents)).collect()}
    assert [got[i] for i, _ in corpus] == twin([t for _, t in corpus])
    rng = random.Random(8)
    texts = [f"mail me: {a}{n}@site.org or ring extension {n % 7}{n} now" for n, a in enumerate("abcdefghijkl")]
    texts += [f"ring extension {rng.randrange(100, 9999)} now; room {n} of 12345{n}" for n in range(9)] + [f"contact user{n}@localhost or mail me: root{n}@localhost" for n in range(5)]
    texts += [f"password={rng.randrange(16**18):018x} and pin: {n}{n}99" for n in range(6)] + [f'session = "{rng.randrange(16**40):040x}" then' for n in range(5)]
    texts += [f"call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} or call (020) 7946 {rng.randrange(1000, 9999)} today" for _ in range(8)]
    texts += ["version 2.0, see 3.1.4 and 1.2.3.4.5; 9 9 9", "call 12 call 13 call 14", None, "", "x" * 3000 + " password=abc123" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.spans for r in pii.digest(pii.extract(df)).collect()}
    want = twin(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum("secret" in x for x in want) >= 11


def test_pii_adds_secrets_and_leaves_clean_documents_alone(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.spans for r in pii.digest(pii.extract(docs)).collect()}
    added = {i: set(filter(None, s.split(","))) - set(filter(None, brute.listed(brute.pii(texts[i])).split(","))) for i, s in got.items()}
    assert sum(map(len, added.values())) >= 12
    for i, spans in added.items():
        assert bool(spans) == ("token = " in (texts[i] or ""))


def test_pii_redact_odd_rows(spark):
    rows = [(1, "write to a@b.co now", "x"), (1, "write to a@b.co now", "y"), (None, "1.2.3.4", "z"), (2, None, None), (3, "", "w"), (4, "password=hunter22 " * 2000, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _spans string").withColumns({"spans": F.lit(1), "text_hash": F.lit(2), "_doc_id": F.lit(3)})
    out = pii.redact(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r._spans) for r in out.collect()), key=str)
    want = [(1, "write to <email> now", "x"), (1, "write to <email> now", "y"), (None, "<ip>", "z"), (2, None, None), (3, "", "w"), (4, "password=<secret> " * 2000, "v")]
    assert got == sorted(want, key=str)
    assert pii.redact(df.limit(0)).count() == 0


def test_pii_context_finds_unseen_identifiers(spark):
    rng = random.Random(5)
    known = [f"my number is +1 {rng.randrange(10**9, 10**10)} thanks" for _ in range(12)]
    unseen = [f"my number is {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)} thanks" for _ in range(4)]
    clean = [f"chapter {n} of the book has 12345{n} words" for n in range(20)]
    texts = known + unseen + clean
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.extract(df)).collect()}
    for i, t in enumerate(texts):
        extra = set(filter(None, got[i].spans.split(","))) - set(filter(None, brute.listed(brute.pii(t)).split(",")))
        assert len(extra) == (12 <= i < 16), (t, got[i].spans)
    assert "<phone> thanks" in {r.doc_id: r.text for r in pii.redact(df).collect()}[13]


def test_pii_bootstraps_until_no_instance_is_added(spark):
    """Each step of the chain is trusted by the instances of the step before: five rounds."""
    rng = random.Random(6)
    words, sizes = ("alpha", "beta", "gamma", "delta", "eta", "theta"), (121, 40, 13, 4, 1)
    texts = [f"my alpha is +1 {rng.randrange(10**9, 10**10)} thanks" for _ in range(364)]
    values = [[f"id{k}q{n:05d}" for n in range(size)] for k, size in enumerate(sizes)]
    texts += [f"my {words[k + d]} is {v} thanks" for k, step in enumerate(values) for v in step for d in (0, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all("is <phone> thanks" in r.text for r in pii.redact(df).collect())


def test_bpe(documents, corpus, reference_encoding):
    got = {r.doc_id: r for r in bpe.digests(documents).collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        ids = reference_encoding.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or ""))
    assert bpe.digests(documents.limit(0)).count() == 0


def test_bpe_odd_texts(reference_encoding):
    encode = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "a", "the", "é", "1", "²", "Ⅷ", "!", "日本", "😀", "​", "'s", "'", "\r\n", "<|endoftext|>", "x" * 70]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert encode(t).tolist() == reference_encoding.encode_ordinary(t)
    long = "".join(rng.choice("abcdé") for _ in range(30_000))
    assert encode(long).tolist() == reference_encoding.encode_ordinary(long)


def test_html():
    page = "<title>T</title><h1>Hi &amp; you</h1><p>One <b>two</b>three<p>Four<br>five<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><table><tr><th>Name<th>N<tr><td>Al<td>10<tr><td>Barbara<td>7</table><div style='display:none'>no</div><pre>  keep\n   this</pre>a < b<script>var t='</p>'</script>end<p hidden>zz</p>tail"
    assert html.render(page) == "Hi & you\n\nOne twothree\n\nFour\nfive\n\n- a\n- b\n  3. x\n  4. y\n\nName     N\nAl       10\nBarbara  7\n\n  keep\n   this\n\na < bendtail"
    assert html.render(None) == html.render("") == ""


def test_html_keeps_all_visible_words(spark):
    import html as references
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        shown = re.sub(r"<head>.*?</head>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->", "", r.html, flags=re.S)
        assert re.findall(r"\w+", references.unescape(re.sub(r"<[^>]+>", " ", shown))) == re.findall(r"\w+", got[r.page_id])


def test_html_equals_the_plain_layout():
    """Random trees of blocks, lists, tables with spans, preformatted and hidden parts."""
    rng = random.Random(12)
    for _ in range(600):
        markup, items = brute.page(rng)
        assert html.render(markup) == brute.laid_out(items).strip("\n"), markup


def test_html_layout_details():
    assert html.render("<div>" * 300 + "<div style='display:none'>SECRET</div>ok") == "ok"
    assert html.render("<div>" * 300 + "<ul><li>a<li>b</ul>") == "- a\n- b"
    assert html.render("<button>a</button><button>b</button><select><option>c<option>d</select>") == "a b c d"
    assert html.render("<pre><div>a</div><div>b</div></pre>") == "a\nb"
    long, wide = " ".join(["word"] * 90), "x" * 300
    lines = html.render(f"<table><tr><td>{long}<td>B<tr><td>{wide}<td>D<tr><td>e<td>F</table>").split("\n")
    assert [x.index(c) for x, c in ((lines[0], "B"), (lines[-1], "F"))] == [201, 201] and lines[-2] == f"{wide}  D"
    assert html.render("<table><tr><td colspan=1000000>a<td rowspan=0>b<td colspan=x>c</table>") == "a  b  c"
    assert html.render("<p>" + "</p><b></b>" * 20_000 + "<td>" * 5000 + "z").endswith("z")


def test_html_odd_rows(spark):
    rows = [(None, "<p>a"), (1, None), (1, "<p>b"), (1, "<p>b"), (2, ""), (3, "<p>" + "long text " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1))
    assert sorted((len(r.text) for r in html.extract(df).collect())) == [0, 0, 1, 1, 1, 999_999]
    assert html.extract(df.limit(0)).count() == 0


def test_html_never_fails():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "</table>", "<tr>", "<td>", "x", " y ", "<b", "<", ">", "&amp", "&#x41;", "<!--", "-->", "<pre>", '"', "'", "<script>", "<br/>", "<a href="]
    for _ in range(3000):
        html.render("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))
    assert html.render("<div>" * 20_000 + "x") == "x"
    html.render('<a "' * 20_000 + ">")


def test_substrings(documents, corpus):
    want = brute.substrings(corpus)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedupe(documents).collect()}
    assert got == want
    assert substrings.dedupe(documents.limit(0)).count() == 0


def test_substrings_beyond_the_bits(documents, corpus, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_BITS", 10)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedupe(documents).collect()}
    assert got == brute.substrings(corpus)


@pytest.mark.parametrize(("width", "chunk"), [(1 << 16, 1 << 21), (1 << 20, 1 << 21), (1 << 20, 1000)])
def test_sketch_never_underestimates(spark, monkeypatch, width, chunk):
    """Many blocks or one, partitions in many pieces; keys in one list only pass by a collision at most."""
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = np.random.default_rng(9)
    pool = rng.integers(-(2**62), 2**62, 20_000)
    lists = [np.unique(rng.choice(pool, 50)).tolist() for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in lists], "anchors array<long>").repartition(5)
    n = Counter(k for x in lists for k in x)
    got = [k for r in substrings.estimated(df, width).collect() for k in r.anchors]
    assert len(got) == len(set(got)) and {k for k in n if n[k] > 1} <= set(got) <= set(n)
    assert len(got) < 1.5 * sum(x > 1 for x in n.values())
    keys = spark.createDataFrame([(0, got)], "block int, anchors array<long>")
    bits = substrings.Estimates(substrings.cells_of(keys, width).collect(), width)
    assert bits.repeated(np.array(got).view(np.uint64)).all()


def test_anchor_is_the_least_gram():
    words = np.random.default_rng(1).integers(0, 2**63, 400).astype(np.uint64)
    grams = substrings.gram_hashes(words, 10)
    assert substrings.anchors(words).tolist() == [grams[i : i + 41].min() for i in range(351)]


def test_language_model(documents, corpus):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in corpus}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter()
    for i, w in tokens.items():
        if not held[i]:
            c.update(w)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm.score(documents).collect()}
    for i, w in tokens.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    assert lm.score(documents.limit(0)).count() == 0


def test_language_model_learns_topics(spark):
    """Texts that stay with one of two vocabularies: held-out ones are likelier than by counts alone."""
    rng = random.Random(7)
    texts = [" ".join(f"{topic}{rng.randrange(40)}" for _ in range(80)) for topic in ("a", "b") for _ in range(150)]
    out = lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("held_out").collect()
    n = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / n > sum(r.base_score for r in out) / n + 0.1


@pytest.mark.parametrize(("known", "own"), [(0, 0), (30, 0), (50, 20), (200_000, 60_000)])
def test_language_model_equals_the_plain_form(spark, monkeypatch, known, own):
    """Training and scores of a small corpus against recursions word by word, wherever the dictionary ends."""
    rng = random.Random(11)
    texts = [" ".join(f"{topic}{rng.randrange(40)}" for _ in range(rng.randrange(40))) + f" unique{i}" for topic in ("a", "b") for i in range(40)] + [None, "", "never seen", "a1 A1 unique3 " * 60]
    monkeypatch.setattr(lm, "KNOWN", known)
    monkeypatch.setattr(lm, "OWN", own)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"row": F.lit(1), "rare": F.lit("x"), "word": F.lit(2)}).repartition(3)
    got = {r.doc_id: r for r in lm.score(df).collect()}
    want = brute.hidden_markov(texts, lm, known, own)
    for i in range(len(texts)):
        assert got[i].score == pytest.approx(want[i], abs=1e-3, rel=1e-5)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    """On the given documents held-out texts gain at least 0.1 a token, and those with many unseen words too."""
    out = lm.op6_lm(spark, "/root/testdata/sf0.001").where("held_out AND n_tokens > 1").collect()
    n = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / n >= sum(r.base_score for r in out) / n + 0.1
    strange = [r for r in out if r.n_known < 0.7 * r.n_tokens]
    assert all(r.score > r.base_score for r in strange)


def test_language_model_without_training_texts(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    df = spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")
    out = lm.score(df).collect()
    assert len(out) == len(held) and all((r.n_known, r.train_tokens, r.held_out) == (0, 0, True) and math.isfinite(r.score) for r in out)


def test_hmm_recursions():
    rng = np.random.default_rng(1)
    model = lm.Model.first(np.full(300, 1 / 300))
    texts = [rng.integers(0, 300, n).astype(np.uint16) for n in (1, 2, 127, 128, 129, 300)]
    batch = lm.Batch(texts)
    _, total = batch.forward(*batch.transfers(model))
    start, moves, emits = batch.expected(model)
    s0, m0, e0 = 0, 0, np.zeros_like(model.emits)
    for d, o in enumerate(texts):
        o = o.astype(int)
        a, c = [model.start * model.emits[o[0]]], []
        for t in range(len(o)):
            if t:
                a.append((a[-1] @ model.moves) * model.emits[o[t]])
            c.append(a[-1].sum())
            a[-1] = a[-1] / c[-1]
        b = [np.ones(lm.STATES)]
        for t in range(len(o) - 1, 0, -1):
            b.insert(0, model.moves @ (model.emits[o[t]] * b[0]) / c[t])
        assert total[d] == pytest.approx(np.log(c).sum())
        g = np.array(a) * np.array(b)
        s0 = s0 + g[0]
        m0 = m0 + sum((np.outer(a[t], model.emits[o[t + 1]] * b[t + 1]) * model.moves / c[t + 1] for t in range(len(o) - 1)), np.zeros((lm.STATES, lm.STATES)))
        np.add.at(e0, o, g)
    assert np.allclose(start, s0) and np.allclose(moves, m0) and np.allclose(emits, e0)


def test_licences(spark):
    q = licences.op7_licences(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, q.select("doc_id", "licences", "n_sentences", "sentence_ids").collect())) == sorted(con.execute(f"SELECT doc_id, licences, n_sentences, sentence_ids FROM ({licences.ORACLE})").fetchall())


def test_licence_rules(spark):
    whole = ". ".join(licences.SENTENCES[x] for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"))
    isc = [licences.SENTENCES[x] for x in ("isc-grant", "isc-as-is")]
    texts = ["Text.\nReleased under the MIT License.\nMore.", whole, licences.SENTENCES["bsd-source"] + ".", None, "", "no licence here.", "Permission is hereby granted to all."]
    texts += [". ".join([isc[0], "One", "Two", isc[1]]), ". ".join([isc[0], *["Another"] * 3000, isc[1]])]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (1, texts[0])], "doc_id long, text string").withColumns({"sentence_ids": F.lit(1), "licences": F.lit(2)})
    got = licences.scan(df).collect()
    assert [r.licences for r in got[:9]] == [["MIT"], ["BSD-3-Clause"], ["partial"], [], [], [], [], ["ISC"], ["partial"]]
    assert [(r.doc_id, r.licences) for r in got[9:]] == [(None, ["MIT"]), (1, ["MIT"])]
    assert licences.scan(df.limit(0)).count() == 0


def test_published_notices(spark):
    """Notices as they are published, plain, as comments of several styles, and one after the other."""
    from notices import NOTICES

    texts, want = [], []
    for licence, text in NOTICES:
        lines = text.split("\n")
        for form in (text, "\n".join(f"# {x}" for x in lines), "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */", "\n".join(f"// {x}".rstrip() for x in lines), "code before\n\n" + text + "\n\nand behind"):
            texts.append(form)
            want.append([licence])
    texts.append("\n\n".join(text for _, text in NOTICES))
    want.append(sorted({x for x, _ in NOTICES}))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    assert {r[0]: r[1] for r in con.execute(f"SELECT doc_id, licences FROM ({licences.ORACLE})").fetchall()} == {i: ",".join(x) for i, x in enumerate(want)}


def test_jaccard(documents, corpus):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(documents).collect()}
    assert got == brute.jaccard(corpus)
    assert jaccard.join(documents.limit(0)).count() == 0


def near_copies(rng, base, n, most):
    """Copies of a list of words with up to ``most`` words changed."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(w)
    return out


def test_jaccard_over_many_blocks(spark, monkeypatch):
    """A large group of near copies of several lengths, cut into blocks that are much smaller."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 7)
    rng = random.Random(2)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    texts = near_copies(rng, base, 60, 3) + [w[: rng.randrange(70, 120)] for w in near_copies(rng, base, 40, 1)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard(rows)


def test_jaccard_of_texts_that_share_boilerplate(spark):
    """Chains of texts that share half of their words: prefix groups meet, few pairs are links."""
    rng = random.Random(3)
    halves = [[f"h{k}x{i}" for i in range(60)] for k in range(12)]
    rows = []
    for i in range(150):
        k = rng.randrange(12)
        rows.append((i, " ".join(halves[k] + halves[(k + rng.randrange(3)) % 12] + [f"own{i}x{j}" for j in range(rng.randrange(60))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "key": F.lit(2), "labels": F.lit("x"), "_doc_id": F.lit(3)})
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(df).collect()}
    assert got == brute.jaccard(rows)


def test_jaccard_recall_by_similarity(spark):
    """Pairs of every hundredth from 0.8 on: all of them are found, at a prefix that the links decide."""
    rng = random.Random(4)
    rows = []
    for k in range(400):
        own = [f"p{k}w{j}" for j in range(200)]
        cut = rng.randrange(0, 23)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[: 200 - cut] + [f"q{k}w{j}" for j in range(cut)]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.pairs(rows)


def test_jaccard_prefix_follows_the_links():
    assert jaccard.prefix_length({}) == 5
    assert jaccard.prefix_length({80: 500}) == 5
    assert jaccard.prefix_length({99: 100_000}) == 7
    assert all(jaccard.found_at(0.8, jaccard.prefix_length({b: 1000})) >= 0.99 for b in range(80, 100))


def test_jaccard_met_before():
    rng = np.random.default_rng(5)
    label = rng.integers(0, 3, (30, jaccard.TREES, jaccard.DEPTH)).astype("<u2")
    for depth in (1, 3, 4, 5, 8):
        want = [[any((label[i, t, :depth] == label[j, t, :depth]).all() for t in range(4)) for j in range(30)] for i in range(30)]
        assert jaccard.met_before(label, depth, range(4)).tolist() == want


def test_jaccard_of_repeated_ids(spark):
    """Rows of one id are judged by their texts; no text is lost, and of equal rows one stays."""
    t, u = " ".join(f"t{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(1, t), (1, u), (2, t + " x"), (3, u + " y"), (4, None), (4, None), (None, t + " z"), (None, "quite alone"), (5, "quite alone"), (7, "seven"), (7, "seven")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text_hash", F.lit(1))
    got = jaccard.join(df).collect()
    assert len(got) == len(rows)
    assert len({r.class_key for r in got if r.class_id == 1}) == 2 and sorted(r.n_links for r in got if r.class_id == 1) == [1, 1, 2, 2, 2]
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(df).collect()), key=str)
    assert kept == sorted([(1, t), (1, u), (4, None), (4, None), (5, "quite alone"), (7, "seven")], key=str)


def test_quality(documents, corpus):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.statistics(documents).collect()}
    assert got == {i: brute.quality(t) for i, t in corpus}


def test_decision_list_learns_thresholds(spark):
    good = [(i, " ".join(f"word{i}x{j}" for j in range(60)), 1) for i in range(120)]
    junk = [(1000 + i, " ".join(f"word{i}y{j}###" for j in range(60)), 0) for i in range(60)]
    short = [(2000, "a b c", 1)]
    df = spark.createDataFrame(good + junk + short, "doc_id long, text string, quality int")
    kept = {r.doc_id: r.kept for r in quality.judge(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i, _, _ in junk) and not kept[2000]
    none = quality.judge(df.select("doc_id", "text"), df.select("doc_id", "quality").limit(0))
    assert {r.doc_id for r in none.collect() if not r.kept} == {2000}
    assert quality.keep(df.drop("quality"), df.select("doc_id", "quality")).count() == 120


def test_decision_list_of_several_conjunctions(spark):
    """Junk that takes two thresholds at once, and another kind that takes a rule of its own; odd labels don't teach."""
    rng = random.Random(13)
    rows = []
    for i in range(900):
        shout, marked = rng.random() < 0.5, rng.random() < 0.5
        words = [f"{'W' if shout else 'w'}{rng.randrange(10**6)}x{j}{'$' if marked and j % 2 else ''}" for j in range(60)]
        lines = i % 9 == 0
        rows.append((i, "\n".join(["same line here"] * 15 + words) if lines else " ".join(words), int(not (lines or (shout and marked)))))
    df = spark.createDataFrame(rows, "id long, body string, quality int").repartition(3)
    labels = df.select(F.col("id").alias("doc_id"), "quality").unionByName(spark.createDataFrame([(0, 1), (None, 0), (1, None)], "doc_id long, quality int"))
    rules = quality.learn(df, labels, id_col="id", text_col="body")
    assert len(rules) >= 2 and any(len(r) >= 2 for r in rules)
    kept = {r.id for r in quality.keep(df, labels, "id", "body").collect()}
    want = {i for i, t, q in rows if q and not brute.base_failed(t)}
    assert kept == {i for i, t, _ in rows if brute.kept(t, rules)} and len(kept ^ want) <= 9


def test_quality_kept_equals_the_plain_form(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()} == {i: brute.kept(t, rules) for i, t in texts.items()}


def test_bpe_of_another_pattern(spark, reference_encoding):
    pattern = r"\S+ \S+|\s+|\S+"
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(1, "some words and more of them\n"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in bpe.encode(df, pattern=pattern).collect()} == {1: other.encode_ordinary("some words and more of them\n"), 2: []}


def test_contamination(spark, documents, corpus):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "One, TWO"), (901, None), (902, ""), (903, items[0][1]), (904, "words at its end")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(corpus, items)
    got = {r.doc_id: r for r in decontaminate.report(documents, bench).collect()}
    assert len(got) == len(corpus)
    for i, (n, hit, ids) in want.items():
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (n, hit, len(ids), brute.sha(",".join(ids)), hit > 0)
    assert decontaminate.report(documents, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.keep_clean(documents, bench).count() == sum(hit == 0 for _, hit, _ in want.values())


def test_contamination_of_documents_shorter_than_a_window(spark):
    """An item of five words makes documents keep all five-word hashes, which meet those of long items."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    items = [(1, " ".join(long)), (2, "one two three four five")]
    docs = [(i, " ".join(long[i : i + 7])) for i in range(8)] + [(20, "so one two three four five then"), (21, " ".join(long[:9])), (22, " ".join(long[:10])), (23, "x y " + " ".join(long))]
    want = brute.contamination(docs, items)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.report(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256) for r in got} == {i: (n, hit, brute.sha(",".join(ids))) for i, (n, hit, ids) in want.items()}
    assert {i for i, (_, hit, _) in want.items() if hit} == {20, 22, 23}


def test_contamination_counts_an_item_id_once(spark):
    """An id on several texts, short and long, and windows that several ids share."""
    long = [f"v{i}" for i in range(14)]
    items = [(7, "alpha beta gamma"), (7, "delta eps zeta eta"), (8, "alpha beta gamma"), (9, " ".join(long)), (10, " ".join(long[2:])), (9, " ".join(long[1:12])), (None, "no id here")]
    docs = [(1, "alpha beta gamma delta eps zeta eta"), (2, " ".join(long)), (3, " ".join(long[:10])), (4, "so no id here"), (5, "delta eps zeta eta " * 300), (6, None)]
    df = spark.createDataFrame(docs + [(1, "unlike all others")], "doc_id long, text string")
    df = df.withColumns({"window": F.lit(1), "ids": F.lit("x"), "prints": F.lit(2), "text_hash": F.lit(3)})
    got = decontaminate.report(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == 7
    for i, (n, hit, ids) in brute.contamination(docs, [x for x in items if x[0] is not None]).items():
        if i != 4:
            assert (n, hit, len(ids), brute.sha(",".join(ids))) in {(r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got if r.doc_id == i}
    assert {(r.n_hit, r.n_items) for r in got if r.doc_id == 4} == {(3, 0)}
    assert {(r.n_items, r.items_sha256) for r in got if r.doc_id == 5} == {(1, brute.sha("7"))}


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a@b.co and some text"), (None, None), (1, "same words here now ok then"), (1, "same words here now ok then")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "and some text")], "item_id long, text string")
    assert sorted(r.n_email for r in pii.digest(pii.extract(df)).collect()) == [0, 0, 0, 1]
    assert bpe.digests(df).count() == jaccard.join(df).count() == substrings.dedupe(df).count() == lm.score(df).count() == 4
    assert decontaminate.report(df, bench).where(F.col("contaminated")).count() == 1
    assert jaccard.keep_one(df).count() == 3
    assert hashlib.sha256(b"").hexdigest() in {r.ids_sha256 for r in bpe.digests(df).collect()}


def test_worker_remembers_for_one_operator():
    from tracewright.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some text"])], ["doc_id", "text"])
    first = next(bpe._encoded(iter([batch]), public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN))
    assert bpe._ENCODERS and bpe._LOADED
    common.begin("bpe")
    assert bpe._ENCODERS
    common.begin("jaccard")
    assert not bpe._ENCODERS and not bpe._LOADED
    assert first.equals(next(bpe._encoded(iter([batch]), public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)))
