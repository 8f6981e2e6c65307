import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import packing as pk


@pytest.fixture(scope="module")
def counter():
    return pk.TokenCounter(pk.load_encoding())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t.,'s  1x ", max_size=60))
def test_counts_are_those_of_the_whole_text(text):
    counter = test_counts_are_those_of_the_whole_text.__dict__.setdefault("counter", pk.TokenCounter(pk.load_encoding()))
    assert counter.count(text) == len(counter.encode(text))


def test_counts_over_documents(spark, sf_tiny, counter):
    for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").select("text").collect():
        assert counter.count(r["text"]) == len(counter.encode(r["text"]))


def by_hand(items, size, space):
    """Bounded-space best fit as lists, written out plainly."""
    opened, closed = [], []
    for n, what in items:
        if n == size:
            closed.append([n, [what]])
            continue
        fits = [w for w in opened if w[0] + n <= size]
        if fits:
            w = max(fits, key=lambda w: w[0])
            w[0] += n
            w[1].append(what)
        else:
            if len(opened) == space:
                full = max(opened, key=lambda w: w[0])
                opened.remove(full)
                closed.append(full)
            w = [n, [what]]
            opened.append(w)
        if w[0] == size:
            opened.remove(w)
            closed.append(w)
    return closed, opened


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5))
def test_best_fit_in_bounded_space(lengths, space):
    packer, closed = pk.Packer(20, space), []
    for i, n in enumerate(lengths):
        assert len(packer.open) <= space
        if gone := packer.add(n, [i]):
            closed.append(gone)
    want_closed, want_open = by_hand(list(zip(lengths, range(len(lengths)))), 20, space)
    assert sorted(map(list, closed)) == sorted(want_closed)
    assert sorted(map(list, packer.open)) == sorted(want_open)
    assert sorted(i for _, p in closed + packer.open for i in p) == list(range(len(lengths)))
    assert all(used <= 20 and used == sum(lengths[i] for i in p) for used, p in closed + packer.open)


def check_windows(rows, sizes, window):
    covered = defaultdict(list)
    for r in rows:
        assert r["used"] == sum(r["lengths"]) <= window and len(r["doc_ids"]) == len(r["starts"]) == len(r["lengths"])
        for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]):
            covered[d].append((s, n))
    for d, parts in covered.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at and n > 0
            at += n
        assert at == sizes[d]
    assert covered.keys() == sizes.keys()
    assert len({r["window_id"] for r in rows}) == len(rows)


@pytest.mark.parametrize("partition_docs", [7, 20_000])
def test_every_token_is_in_one_window(spark, sf_tiny, counter, partition_docs, monkeypatch):
    monkeypatch.setattr(pk, "FAN_IN", 4)  # several rounds of merging
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "text")
    sizes = {r["doc_id"]: counter.count(r["text"]) + 1 for r in docs.collect() if r["text"]}
    rows = pk.pack(docs, partition_docs=partition_docs).collect()
    check_windows(rows, sizes, pk.WINDOW)
    least = -(-sum(sizes.values()) // pk.WINDOW)
    assert len(rows) <= least * 1.1 + pk.OPEN
    again = pk.pack(docs.repartition(3).orderBy("text"), partition_docs=partition_docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_odd_rows(odd_docs, no_docs, counter):
    rows = pk.pack(odd_docs).collect()
    ids = [d for r in rows for d in r["doc_ids"]]
    assert ids.count(1) == 3 and ids.count(None) == 1 and 2 not in ids and 3 not in ids and 4 in ids
    total = sum(counter.count(r["text"]) + 1 for r in odd_docs.collect() if r["text"])
    assert sum(r["used"] for r in rows) == total
    assert pk.pack(no_docs).count() == 0
    assert pk.pack(no_docs).columns == ["window_id", "used", "doc_ids", "starts", "lengths"]


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)", "int"])
def test_ids_of_any_type_and_their_tokens(spark, sf_tiny, counter, kind):
    prefix = "doc-" if kind == "string" else ""
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").selectExpr(f"CAST(concat('{prefix}', doc_id) AS {kind}) AS doc_id", "text")
    windows = pk.pack(docs, window=512)
    assert windows.schema["doc_ids"].dataType.elementType == docs.schema["doc_id"].dataType
    texts = {r["doc_id"]: counter.encode(r["text"]) + [-1] for r in docs.collect()}
    got = {r["window_id"]: r["tokens"] for r in pk.window_tokens(docs, windows, end_of_text=-1).collect()}
    for r in windows.collect():
        want = [t for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]) for t in texts[d][s : s + n]]
        assert got[r["window_id"]] == want and len(want) == r["used"]


def test_leftovers_merge(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "word " * rng.randrange(1, 300)) for i in range(400)], "doc_id long, text string")
    rows = pk.pack(docs, window=512, space=2, partition_docs=20).collect()
    total = sum(r["used"] for r in rows)
    assert total / (len(rows) * 512) > 0.8
