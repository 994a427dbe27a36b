"""The pipeline's stages against plain Python on whole tables."""

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F
from test_operators import slow_classes, slow_fingerprint, slow_spans

from tenure.llm import decontamination, quality_classifier
from tenure.llm.columns import saved


def test_run_equals_brute_force(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = quality_classifier.classify(documents, labels).filter("kept").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in kept}
    classes = slow_classes(list(texts), [slow_fingerprint(t) for t in texts.values()])
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    plain = lambda t: " ".join(t.lower().split())
    items = [plain(t) for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").fetchall()]
    texts = {i: t for i, t in texts.items() if not any(x in plain(t) for x in items)}
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(documents.columns) < set(out.columns)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= set(texts)
    total = sum(len(t.split()) for t in texts.values())
    assert abs(sum(r["size"] for r in rows) - 1.5 * total) <= 0.1 * total
    for r in rows:
        assert not slow_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not slow_spans(texts[r["doc_id"]]):
            assert r["text"] == texts[r["doc_id"]]
    copies = {(r["doc_id"], r["copy"]) for r in rows}
    assert len(copies) == len(rows) and max(c for _, c in copies) <= 2


def test_each_stage_equals_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, given):
        out = saved(stages[name](spark, given, sf_dir))
        found = {r["doc_id"]: r["text"] or "" for r in out.collect()}
        assert out.count() == len(found) and out.columns == docs.columns
        return out, found

    docs, texts = after("quality_classifier", docs)
    classes = slow_classes(list(texts), [slow_fingerprint(t) for t in texts.values()])
    docs, found = after("simhash_dedup", docs)
    assert found == {i: t for i, t in texts.items() if classes[i] == i}
    # The operator's own spans are held against whole edit tables elsewhere; here each
    # row with one goes, and none of the others, whether it holds a passage as it stands or not.
    marks = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = {r["doc_id"] for r in marks.filter("contaminated").collect()}
    plain = lambda t: " ".join(t.lower().split())
    items = [plain(t) for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").fetchall()]
    assert {i for i, t in found.items() if any(x in plain(t) for x in items)} <= dirty
    docs, clean = after("decontamination", docs)
    assert clean == {i: t for i, t in found.items() if i not in dirty}
    docs, redacted = after("secret_scan", docs)
    assert redacted.keys() == clean.keys()
    for i, text in clean.items():
        spans = slow_spans(text)
        assert (redacted[i] == text) == (not spans)
        assert not slow_spans(redacted[i])


def test_stages_take_odd_rows(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = documents.limit(3).select(
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in documents.schema)
    )
    docs = documents.unionByName(documents.limit(5)).unionByName(odd).withColumns(
        {n: F.lit(1) for n in ("kept", "found", "size", "_row", "fp", "_scale", "_cut", "_closing", "_u")}
    )
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0
        out = stage(spark, docs, sf_dir)
        assert out.count() > 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
