"""The classifier by its held-out accuracy and as a column against numpy; the pipeline against what each stage promises."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meridian.llm import quality_classifier as qc
from meridian.llm import queries

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    n = labels.sum()
    return (rank[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op3_quality_classifier(spark, SF).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(got[i]["score"], got[i]["predicted"], q) for i, q in labels if got[i]["held_out"]]
    assert len(held) > 50 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    s, p, q = (np.array(x, float) for x in zip(*held, strict=True))
    assert auc(s, q) > 0.97 and (p == q).mean() > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_held_out_labels_and_other_columns_have_no_part(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    first = qc.score(docs, labels, ["doc_id"]).collect()
    turned = labels.withColumn("quality", __import__("pyspark.sql.functions", fromlist=["x"]).when(qc.held_out("doc_id"), 1 - labels["quality"]).otherwise(labels["quality"]))
    other = docs.selectExpr("doc_id", "text", "'zz' as lang", "'q' as source", "1.5D as upper", "doc_id as _label")
    assert qc.score(other, turned, ["doc_id", "upper", "_label"]).select("doc_id", "score").collect() == first


def test_column_is_the_model(spark, documents):
    rng = np.random.default_rng(0)
    x = np.array([qc.statistics_of((r["text"] or "").encode()) for r in documents.collect()])
    y = (x[:, 0] + rng.normal(0, 0.3, len(x)) > np.median(x[:, 0])).astype(float)
    model = qc.fit(x, y)
    assert 0 < len(model.rules) < 300
    got = qc.statistics(documents, ["doc_id"]).select("doc_id", model.column().alias("s")).collect()
    want = dict(zip((r["doc_id"] for r in documents.collect()), model.scores(x), strict=True))
    assert {r["doc_id"]: r["s"] for r in got} == pytest.approx(want)


def test_odd_rows_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 0), (99, 1)], "doc_id long, quality int")
    for wanted in (labels, labels.where("quality = 0"), labels.limit(0)):
        got = qc.score(odd, wanted, odd.columns)
        assert got.columns == [*odd.columns, "score"] and got.count() == odd.count() and got.where("score between 0 and 1").count() == odd.count()
    assert qc.score(odd, labels.limit(0), ["doc_id"]).where("score < 0.7").count() == 0
    assert qc.score(none, labels, ["doc_id"]).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        after = {r["doc_id"]: r for r in rows}
        if name != "pack":
            assert out.columns == columns and len(after) == len(rows) and after.keys() <= before.keys()
            assert all(len(r["text"]) == r["n_chars"] for r in rows)
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = Counter((labels[i], i in after) for i in labels)
            assert kept[1, True] >= 0.98 * (kept[1, True] + kept[1, False]) and kept[0, False] >= 0.95 * (kept[0, True] + kept[0, False])
        elif name == "lines":
            holders = Counter(x for r in rows for x in set(r["text"].split("\n")) if x.strip())
            sites = {x: {r["source"] for r in before.values() if x in r["text"].split("\n")} for x, n in holders.items() if n > 1}
            assert after.keys() == before.keys() and all(len(s) < queries.MIN_SITES for s in sites.values())
        elif name == "near_duplicates":
            shingles = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, r in before.items() if (w := r["text"].lower().split())}
            ids = [i for i in after if i in shingles]
            assert not any(5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]) for n, a in enumerate(ids) for b in ids[:n] if 5 * min(len(shingles[a]), len(shingles[b])) >= 4 * max(len(shingles[a]), len(shingles[b])))
            for i in before.keys() - after.keys():
                assert any(5 * len(shingles[i] & s) >= 4 * len(shingles[i] | s) for j, s in shingles.items() if j != i)
        elif name == "decontaminate":
            words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
            windows = {tuple(w[k : k + 8]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r["text"])] for k in range(max(len(w) - 7, 1))}
            leaked = {i for i, r in before.items() if any(tuple(w[k : k + 8]) in windows for w in [words(r["text"])] for k in range(len(w) - 7))}
            assert leaked and after.keys() == before.keys() - leaked
        else:
            assert after.keys() == before.keys()
        before, docs = after, spark.createDataFrame(rows, out.schema)


def test_pipeline_of_odd_rows(spark, odd, none):
    """Nulls, long and repeated rows and empty tables, with columns that carry names of the operators' own."""
    clashing = ["id", "th", "size", "sid", "root", "key", "n", "score", "items", "spans", "n_hit", "removed_lines", "window", "piece", "label"]
    for docs in (odd, none):
        docs = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clashing)))
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, SF)
            if name != "pack":
                assert docs.columns == before.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert name == "pack" or not docs.count() or docs.select(*clashing).distinct().collect() == [tuple(range(len(clashing)))]
