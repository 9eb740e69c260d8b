"""The whole pipeline on odd rows, repeated rows, other columns and empty tables."""

import glob
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm.quality_rules import judged
from test_pairs import edited, groups, repeats


@pytest.fixture
def folder(spark, frame, label_frame, tmp_path):
    def build(rows, labels):
        frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
        label_frame(labels).write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return build


def corpus(odd, prose):
    rows = [(*row, "a") for row in odd]
    for family in range(4):
        base = prose(700 + family, 90 + 30 * family)
        rows += [(2000 + 10 * family + k, edited(base, range(2 * k)), "abc"[k % 3]) for k in range(5)]
    passage = prose(790, 60)
    rows += [(3000 + k, f"{prose(800 + k, 70)} {passage} {prose(830 + k, 40)}", None) for k in range(6)]
    return rows


def texts(table):
    return Counter((r.doc_id, r.text) for r in table.select("doc_id", "text").collect())


def test_each_stage_does_its_part(spark, folder, odd, prose):
    # Two texts of one doc_id are two components of one name, which would not be told apart here.
    sf_dir = folder(corpus([r for r in odd if r[0] != 11], prose), [(2000, 1, 0), (3001, 1, 0), (4, 0, 1), (None, 1, 0)])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{sf_dir}/{name}.parquet")
        docs = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        assert docs.columns == names
        kept[name] = (before, docs)
    before, after = kept["quality_rules"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = judged(before, labels).filter("kept").groupBy("doc_id").count().collect()
    assert Counter(r.doc_id for r in after.collect()) == Counter({r.doc_id: r["count"] for r in good})

    before, after = kept["jaccard_join"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert len({c for _, _, c in groups(rows, 5, 80)}) == after.count() < before.count()

    before, after = kept["substring_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = Counter((i, left) for i, left, had in repeats(rows)[1] if left or not had)
    assert Counter((r.doc_id, b" ".join(r.text.encode().split())) for r in after.collect()) == want

    before, after = kept["source_mix"]
    assert set(texts(after)) <= set(texts(before)) and max(texts(after).values()) <= 3

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    spans = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert spans.filter("n != end or n > 2048").isEmpty()
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_leave_their_results_only(spark, folder, prose):
    sf_dir = folder([(k, prose(900 + k, 80)) for k in range(5)], [(1, 1, 0)])
    root = f"{spark.conf.get('spark.checkpoint.dir')}/faultline"
    before = set(glob.glob(f"{root}/*"))
    pieces = corpus_pipeline.run(spark, sf_dir)
    names = {os.path.basename(f).rsplit("-", 1)[0] for f in set(glob.glob(f"{root}/*")) - before}
    assert names == {*(f"llm-stage-{name}" for name, _ in corpus_pipeline.STAGES[:-1]), "llm-packing-items"}
    assert {r.doc_id for r in pieces.collect()} <= set(range(5))


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).collect() == []


def test_nothing_is_kept(spark, folder):
    """Every document fails the base rules: null, blank and short texts only."""
    rows = [(1, None), (2, ""), (None, " \n"), (4, "too short"), (4, "too short")]
    assert corpus_pipeline.run(spark, folder(rows, [(1, 1, 0)])).collect() == []
