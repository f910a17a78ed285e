"""Stages one after the other: columns stay, decisions take effect, each keeps what a plain form keeps."""

import base64

import brute
import corpus_pipeline
import public_tokenizers
import tiktoken
from brute import SF
from pyspark.sql import functions as F

from tracewright.llm import bpe, pii, quality


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k == len(corpus_pipeline.STAGES) - 1:
            assert docs.count() == len(before)
            continue
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            assert all(brute.quality(t)[0] >= 50 for t in after.values()) and len(after) > len(before) // 2
        if name == "near_duplicates":
            assert set(after) == {c for c, _ in brute.jaccard(before).values()}
        if name == "decontamination":
            assert set(after) == {i for i, (_, hit, _) in brute.contamination(before, items).items() if not hit}
        if name == "personal_data":
            assert len(after) == len(before) and not any(brute.pii(t) for t in after.values())


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_run_equals_the_plain_forms(spark, tmp_path):
    """The whole pipeline over real and odd rows: nulls, repeated rows and ids, a long text, extra columns with clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    long = " ".join(t for _, t in rows[:30])
    odd = [(None, None), (900, ""), (901, None), (902, long), (903, rows[3][1]), (None, rows[150][1] + " and a null id"), rows[0], rows[0]]
    clash = {"spans": F.lit(1), "node": F.lit("x"), "window": F.lit(2), "_doc_id": F.lit(3), "ids": F.lit(4)}
    odd = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("odd"), "n_chars": F.lit(1).cast("long")})
    docs.unionByName(odd.select(docs.columns)).withColumns(clash).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").withColumn("text_hash", F.lit(1)).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rules = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = [(r.doc_id, r.text) for r in docs.collect() if brute.kept(r.text, rules)]
    # Plain classes need ids of their own: nulls last, rows of equal id and text as one.
    left = sorted(set(left), key=lambda r: (r[0] is None, r[0]))
    numbered = list(enumerate(t for _, t in left))
    lead = {c for c, _ in brute.jaccard(numbered).values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, (_, hit, _) in brute.contamination(numbered, items).items() if hit}
    left = [left[i] for i, _ in numbered if i in lead and i not in dirty]
    spans = brute.bootstrapped([t for _, t in left], pii.TOKEN, pii.NUMBERS, pii.CREDENTIALS)
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(i, encoding.encode_ordinary(brute.redacted(t, s))) for (i, t), s in zip(left, spans, strict=True)]
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(want, key=str)


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
