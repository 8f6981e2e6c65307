import os

import corpus_pipeline
import pytest
from brute import boilerplate, leaked, near_groups, without_lines
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate as dec
from quillgraph.llm import packing as pk
from quillgraph.llm import registry
from quillgraph.llm import toxicity as tx


@pytest.fixture(scope="module")
def staged(spark, sf_tiny, tmp_path_factory):
    """Each stage's output, every stage on all that the one before kept."""
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_tiny}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_tiny).write.parquet(str(base / name))
        out[name] = docs = spark.read.parquet(str(base / name))
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert set(registry.queries()) == {"pipeline", *(k for k in registry.queries() if k.startswith("op"))}
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries() if k.startswith("op")) == list(range(1, 11))


def test_columns_stay(spark, sf_tiny, staged):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet")
    for name, df in staged.items():
        if name != "packing":
            assert df.dtypes == docs.dtypes


def test_against_brute_force(spark, sf_tiny, staged):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()}
    model = tx.train(spark.read.parquet(f"{sf_tiny}/documents.parquet"), spark.read.parquet(f"{sf_tiny}/labels.parquet"))
    scorer = tx.Scorer(model)
    docs = {i: t for i, t in docs.items() if scorer.score(t)[0] < model.threshold}
    assert docs == {r["doc_id"]: r["text"] for r in staged["toxicity"].collect()}
    bad = boilerplate(list(docs.values()))
    docs = {i: without_lines(t, bad)[0] for i, t in docs.items()}
    assert docs == {r["doc_id"]: r["text"] for r in staged["line_dedup"].collect()}
    ids = sorted(docs)
    docs = {ids[k]: docs[ids[k]] for k, first in enumerate(near_groups([docs[i] for i in ids])) if first == k}
    assert docs == {r["doc_id"]: r["text"] for r in staged["near_dedup"].collect()}
    items = [dec.normalise(r["text"]) for r in spark.read.parquet(f"{sf_tiny}/benchmark.parquet").collect()]
    grams = {tuple(x[i : i + dec.MIN_SHORT]) for x in items for i in range(len(x) - dec.MIN_SHORT + 1)}
    got = {r["doc_id"]: r["text"] for r in staged["decontamination"].collect()}
    for i, t in docs.items():
        tokens = dec.normalise(t)
        if not any(tuple(tokens[k : k + dec.MIN_SHORT]) in grams for k in range(len(tokens))):
            assert got[i] == t
        elif len(tokens) < 400:  # brute force is slow
            covered = leaked(tokens, items)
            if sum(covered) >= dec.DROP_SHARE * len(tokens):
                assert i not in got
            else:
                assert dec.normalise(got[i]) == [x for x, c in zip(tokens, covered) if not c]
    counter = pk.TokenCounter(pk.load_encoding())
    sizes = {i: counter.count(t) + 1 for i, t in got.items() if t}
    rows = staged["packing"].collect()
    assert sum(r["used"] for r in rows) == sum(sizes.values())
    assert {d for r in rows for d in r["doc_ids"]} == set(sizes)


def test_run_is_the_stages_in_turn(spark, sf_tiny, staged):
    got = corpus_pipeline.run(spark, sf_tiny)
    assert sorted(map(str, got.collect())) == sorted(map(str, staged["packing"].collect()))


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, start in (("odd", odd_docs), ("none", no_docs)):
        docs = start
        for stage, f in corpus_pipeline.STAGES:
            out = os.path.join(tmp_path, name, stage)
            f(spark, docs, str(tmp_path)).write.parquet(out)
            docs = spark.read.parquet(out)
            if stage != "packing":
                assert docs.columns == start.columns
        assert (docs.count() > 0) == (name == "odd")
    assert docs.where(F.size("doc_ids") == 0).count() == 0
