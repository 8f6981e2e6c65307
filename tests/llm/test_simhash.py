import numpy as np
import pandas as pd
import pytest
from brute import hamming, near_groups, roots
from pyspark.sql import functions as F

from quillgraph.llm import simhash as sh


def random_prints(n, seed=3):
    """Fingerprints in clusters, so that pairs lie on both sides of the budget."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2, (max(1, n // 4), 128), np.uint8)
    bits = centres[rng.integers(0, len(centres), n)]
    flips = rng.integers(0, 16, n)
    for row, k in zip(bits, flips):
        row[rng.choice(128, k, replace=False)] ^= 1
    return [tuple(int(x) for x in np.packbits(r).view(">i8")) for r in bits]


@pytest.mark.parametrize("start", sh.STARTS)
def test_rotation_keeps_all_bits(start):
    hi, lo = (np.array([x], np.int64) for x in random_prints(1)[0])
    a, b = sh.rotate(hi, lo, start)
    whole = (int(hi.astype(np.uint64)[0]) << 64) | int(lo.astype(np.uint64)[0])
    turned = ((whole << start) | (whole >> (128 - start))) & ((1 << 128) - 1)
    assert (int(a[0]) << 64) | int(b[0]) == turned


@pytest.mark.parametrize("deep", [0, 2, 4])
def test_join_connects_exactly_the_pairs_within_the_budget(spark, deep):
    prints = sorted(set(random_prints(240)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(prints)], "id long, hi long, lo long")
    edges = sh.near_edges(df, sh.SUBTREE << deep).collect()
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if hamming(prints[i], prints[j]) <= sh.BUDGET]
    assert roots(len(prints), [(e["id"], e["root"]) for e in edges]) == roots(len(prints), pairs)
    assert len(set(roots(len(prints), pairs))) not in (1, len(prints))


def family(n, seed=5, flips=8):
    """Distinct fingerprints that differ from one in ``flips`` bits."""
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2, 128, np.uint8)
    out = set()
    while len(out) < n:
        row = centre.copy()
        row[rng.choice(128, flips, replace=False)] ^= 1
        out.add(tuple(int(x) for x in np.packbits(row).view(">i8")))
    return sorted(out)


@pytest.mark.parametrize("subtree", [10, 25, 60])
def test_large_subtrees_in_parts_connect_the_same_pairs(spark, subtree):
    prints = sorted({*random_prints(200), *family(80), *family(40, 6, 12)})
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(prints)], "id long, hi long, lo long")
    edges = sh.near_edges(df, 4 * subtree, subtree).collect()
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if hamming(prints[i], prints[j]) <= sh.BUDGET]
    assert roots(len(prints), [(e["id"], e["root"]) for e in edges]) == roots(len(prints), pairs)


def test_a_large_family_is_not_compared_pair_by_pair():
    import time

    prints = np.array([*family(30_000), *random_prints(2_000)], np.int64).astype(np.uint64)
    for start in sh.STARTS[:2]:
        hi, lo = sh.rotate(prints[:, 0], prints[:, 1], start)
        pdf = pd.DataFrame({"id": np.arange(len(hi)), "side": 0, "hi": hi.astype(np.int64), "lo": lo.astype(np.int64)})
        began = time.process_time()
        got = sh._join_group(0)((start, 0, 0, 0, 0), pdf)
        assert time.process_time() - began < 15  # pair by pair it is minutes
        assert len(set(got["id"])) >= 29_999


def test_some_rotation_keeps_within_its_budget():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        differ = np.zeros(128, np.int64)
        differ[rng.choice(128, sh.BUDGET, replace=False)] = 1
        assert any((np.cumsum(np.roll(differ, -start)) <= sh.depth_budget(start)[1:]).all() for start in sh.STARTS)


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(100, 101), (7, 7)], "id long, root long")
    found = {r["id"]: r["group"] for r in sh.components(edges).collect()}
    assert found == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_matches_brute_force_over_documents(spark, sf_tiny):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    first = near_groups([r["text"] for r in rows])
    sizes = np.bincount(first, minlength=len(rows))
    expected = {(r["doc_id"], rows[f]["doc_id"], int(sizes[f]), f == i) for i, (r, f) in enumerate(zip(rows, first))}
    found = {tuple(r) for r in sh.op1_simhash(spark, sf_tiny).collect()}
    assert found == expected
    assert any(n > 1 for _, _, n, _ in found)


def test_many_copies_cost_few_edges(spark):
    text = " ".join(f"word{i}" for i in range(200))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    got = sh.near_duplicates(df)
    assert got.where("keep").count() == 1 and got.agg(F.max("group_size")).first()[0] == 3000


def test_odd_rows(odd_docs):
    got = [tuple(r) for r in sh.near_duplicates(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    blank = [r for r in got if r[0] in (2, 3, 4)] + [r for r in got if r[0] is None and r[2] == 4]
    assert {r[1] for r in blank} == {2} and {r[2] for r in blank} == {4} and sum(r[3] for r in blank) == 1
    assert sorted(r[2] for r in got if r[0] == 1) == [1, 2, 2]
    kept = sh.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 1, 2, 5, 6, 7]


def test_empty_table(no_docs):
    assert sh.near_duplicates(no_docs).count() == 0
    assert sh.drop_near_duplicates(no_docs).columns == no_docs.columns
    assert sh.drop_near_duplicates(no_docs).count() == 0
