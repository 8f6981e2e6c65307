import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import quality as q


def sample(n=600, seed=2):
    rng = np.random.default_rng(seed)
    x = {k: np.round(rng.random(n), 6) for k in q.STATISTICS}
    bad = ((x["symbol_share"] > 0.7) & (x["words"] <= 0.5)) | (x["distinct_lines"] <= 0.2)
    return x, bad


def test_conjunctions_are_found():
    x, bad = sample()
    rules = q.learn(x, bad)
    assert rules and all(1 <= len(r) <= q.MAX_LITERALS for r in rules)
    x, bad = sample(seed=9)
    found = np.zeros(len(bad), bool)
    for r in rules:
        found |= q.covers(r, x)
    assert (found == bad).mean() > 0.95


def best_by_hand(x, bad):
    p0, n0 = bad.sum(), (~bad).sum()
    best = (0.0, None)
    for name, v in x.items():
        values = np.unique(v)
        for op in ("<=", ">"):
            for a, b in zip(values, values[1:]):
                inside = v <= (a + b) / 2 if op == "<=" else v > (a + b) / 2
                p, n = bad[inside].sum(), (~bad[inside]).sum()
                if p >= q.MIN_COVER and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > best[0] + 1e-9:
                    best = (g, (name, op))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_each_literal_has_the_greatest_gain(seed):
    x, bad = sample(80, seed)
    gain, literal = q._best_literal(x, bad)
    want, which = best_by_hand(x, bad)
    assert gain == pytest.approx(want)
    assert (literal.name, literal.op) == which if literal else which is None


def test_statistics_by_hand(spark):
    text = "Hello, World! 42\nHello, World! 42\n\nx"
    row = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    row = q.with_statistics(row, F.col("text"), {k: k for k in q.STATISTICS}).drop("text").collect()
    assert row[0]["chars"] == len(text) and row[0]["words"] == 7
    assert row[0]["letter_share"] == round(21 / len(text), 6) and row[0]["digit_share"] == round(4 / len(text), 6)
    assert row[0]["distinct_lines"] == 0.75 and row[0]["capital_share"] == round(4 / 21, 6) and row[0]["stops_per_word"] == round(2 / 7, 6)
    assert set(row[1].asDict().values()) <= {0.0, 1.0} and row[1] == row[2]


def test_the_first_rule_that_holds_is_named(spark):
    rules = [(q.Literal("chars", ">", 5.0), q.Literal("words", "<=", 1.0)), (q.Literal("words", ">", 2.0),)]
    df = spark.createDataFrame([("abcdefgh",), ("a b c d e f",), ("a b",), (None,)], "text string")
    got = [(r["rule"], r["keep"]) for r in q.apply_rules(df, rules).collect()]
    assert got == [("chars > 5 AND words <= 1", False), ("words > 2", False), (None, True), (None, True)]


def test_held_out_documents(spark, sf_small):
    docs, labels = spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet")
    rules = q.train(docs, labels.where("pmod(xxhash64(doc_id), 2) = 0"))
    rest = labels.where("pmod(xxhash64(doc_id), 2) = 1")
    got = q.apply_rules(docs.join(rest, "doc_id"), rules).select("quality", "keep").toPandas()
    assert ((got.quality == 1) == got.keep).mean() >= 0.85
    assert got[got.quality == 1].keep.mean() >= 0.95


def test_rules_agree_with_the_masks(spark, sf_tiny):
    docs, labels = spark.read.parquet(f"{sf_tiny}/documents.parquet"), spark.read.parquet(f"{sf_tiny}/labels.parquet")
    rules = q.train(docs, labels)
    pdf = q.op3_quality_rules(spark, sf_tiny).toPandas()
    x = {k: pdf[f"stat_{k}"].to_numpy() for k in q.STATISTICS}
    rejected = np.zeros(len(pdf), bool)
    for r in rules:
        rejected |= q.covers(r, x)
    assert (pdf["keep"].to_numpy() == ~rejected).all()


def test_odd_rows(odd_docs, no_docs, odd_labels, no_labels):
    assert q.train(odd_docs, no_labels) == [] and q.train(no_docs, odd_labels) == []
    rules = q.train(odd_docs, odd_labels)
    got = q.apply_rules(odd_docs, rules or [(q.Literal("chars", ">", 1e6),)])
    assert len(got.columns) == len({c.lower() for c in got.columns}) and got.count() == odd_docs.count()
    assert {r["keep"] for r in got.collect() if r["doc_id"] == 5} == {False}
    assert q.apply_rules(no_docs, []).count() == 0
