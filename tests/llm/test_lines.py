import re

import numpy as np
import pytest
from brute import boilerplate, without_lines

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import lines as ln

FOOT = "Copyright 2019 by the authors, all rights reserved worldwide"


def fixture_rows():
    rows = []
    for i in range(12):
        body = [" ".join(f"{w}{chr(97 + i)}{chr(97 + k)}" for w in ("story", "about", "river", "stone", "cloud")) for k in range(5)]
        if i < 6:
            body.insert(2, FOOT.replace("2019", str(2010 + i)))
        if i in (7, 8, 9):
            body.append(f"Posted by user {'anna bert carl'.split()[i - 7]} in the general forum section today")
        rows.append((i, "\n".join(body)))
    rows += [(100 + k, "one document\nthat was copied as it is\nwith all its many lines") for k in range(5)]  # copies are not boilerplate
    return rows


def test_templates_that_recur_are_cut(spark):
    df = spark.createDataFrame(fixture_rows(), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["dropped_lines"]) for r in ln.dedup_lines(df).collect()}
    bad = boilerplate([t for _, t in fixture_rows()])
    for i, text in fixture_rows():
        assert got[i] == without_lines(text, bad)
    assert all(got[i][1] == [2] for i in range(6))
    assert all(got[i][1] == [5] for i in (7, 8, 9))
    assert all(not got[100 + k][1] for k in range(5))


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_matches_brute_force_over_documents(spark, sf_tiny, monkeypatch, limit):
    monkeypatch.setattr(ln, "BROADCAST_ROWS", limit)  # 0: by shuffled joins
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet")
    bad = boilerplate([r["text"] for r in docs.collect()])
    got = {r["doc_id"]: (r["text"], r["dropped_lines"]) for r in ln.op6_line_dedup(spark, sf_tiny).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == without_lines(r["text"], bad)
    assert any(at for _, at in got.values())


def test_number_of_characters_follows_the_text(spark):
    df = spark.createDataFrame([(i, t, len(t), len(t)) for i, t in fixture_rows()], "doc_id long, text string, n_chars long, other long")
    for r in ln.dedup_lines(df, dropped=None).collect():
        assert r["n_chars"] == len(r["text"])
        assert r["other"] >= r["n_chars"]


def test_odd_rows(odd_docs, no_docs):
    got = ln.dedup_lines(odd_docs)
    assert got.columns == [*odd_docs.columns, "dropped_lines"]
    rows = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert rows == {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    assert got.count() == odd_docs.count()
    assert ln.dedup_lines(no_docs).count() == 0
    again = ln.dedup_lines(got)  # a column of the output's name is replaced
    assert again.columns == got.columns and again.count() == got.count()


def test_wildcards_and_short_lines():
    assert ln.masked("  at 10:32  user42 came ") == "at <*> <*> came"
    assert ln.parse("two words") is None and ln.parse("") is None
    assert ln.parse("now three words")[2] == "now three words"


def by_comparing_all(lines):
    """Templates of a leaf, each line compared with each."""
    templates, out = [], {}
    for h, line in sorted(lines, key=lambda x: (x[1], x[0])):
        tokens = line.split(" ")
        scores = [sum(a in (b, "<*>") for a, b in zip(t, tokens)) / len(tokens) for _, t in templates]
        best = max(scores, default=0.0)
        if best >= ln.SIMILAR:
            i = scores.index(best)
            root, t = templates[i]
            templates[i] = (root, [a if a == b else "<*>" for a, b in zip(t, tokens)])
            out[h] = root
        else:
            templates.append((h, tokens))
            out[h] = h
    return out


@pytest.mark.parametrize("seed", range(40))
def test_templates_of_a_leaf_are_those_of_comparing_all(seed):
    rng = np.random.default_rng(seed)
    n, words = int(rng.integers(3, 25)), int(rng.choice([2, 3, 5, 30]))
    lines = {}
    for i in range(int(rng.integers(1, 120))):
        tokens = [f"w{rng.integers(words)}" if rng.random() < 0.9 else "<*>" for _ in range(n)]
        if lines and rng.random() < 0.6:
            tokens = list(lines)[int(rng.integers(len(lines)))].split(" ")
            for _ in range(int(rng.integers(0, n // 2 + 1))):
                tokens[int(rng.integers(n))] = f"w{rng.integers(words)}"
        tokens[: ln.DEPTH] = ["a", "b", "<*>"]
        lines.setdefault(" ".join(tokens), i)
    lines = [(i, t) for t, i in lines.items()]
    assert ln.merge_leaf(lines) == by_comparing_all(lines)


def test_a_large_leaf_takes_seconds():
    import time

    rng = np.random.default_rng(0)
    lines = [(i, "a b c " + " ".join(f"w{x}" for x in row)) for i, row in enumerate(rng.integers(0, 20_000, (100_000, 12)))]
    began = time.process_time()
    assert len(ln.merge_leaf(lines)) == 100_000
    assert time.process_time() - began < 30


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab é1\t  \u3000٣²5\xa0\x85\xad\x1c", max_size=20))
def test_masking_is_by_tokens(line):
    assert ln.masked(line) == " ".join("<*>" if re.search(r"\d", t) else t for t in line.split())


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(n))


def kept_of(spark, texts, line):
    """In how many texts the line is left, and the lines dropped besides."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = ln.dedup_lines(df).collect()
    left = sum(line in r["text"].split("\n") for r in rows)
    return left, sum(len(r["dropped_lines"]) for r in rows) - sum(line in t.split("\n") for t in texts) + left


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_near_copies_of_one_host_do_not_keep_a_passage(spark, monkeypatch, limit):
    monkeypatch.setattr(ln, "BROADCAST_ROWS", limit)
    rng = np.random.default_rng(1)
    passage = prose(rng, 60)
    base = [prose(rng, 12) for _ in range(20)]
    texts = ["\n".join([prose(rng, 12) for _ in range(6)] + [passage]) for _ in range(5)]
    for _ in range(300):
        copy = [x.split(" ") for x in base]
        for k in rng.integers(0, 20, 4):
            copy[k][rng.integers(0, 12)] = prose(rng, 1)  # also among the first words, which make another leaf
        texts.append("\n".join([" ".join(x) for x in copy] + [passage]))
    assert kept_of(spark, texts, passage) == (0, 0)
    assert kept_of(spark, texts[5:], passage)[0] == 300  # copies alone keep it


@pytest.mark.parametrize("n_block, n_own", [(15, 2), (30, 2), (30, 10)])
def test_a_block_of_lines_goes_from_its_hosts(spark, n_block, n_own):
    rng = np.random.default_rng(2)
    block = [prose(rng, 10) for _ in range(n_block)]
    texts = ["\n".join([prose(rng, 10) for _ in range(n_own)] + block) for _ in range(60)]
    for line in block[:: n_block - 1]:
        assert kept_of(spark, texts, line) == (0, 60 * (n_block - 1))


def test_texts_of_one_line_do_not_keep_it_elsewhere(spark):
    rng = np.random.default_rng(3)
    notice = "This notice number 7 is sent with every one of our messages"
    alone = [notice.replace("7", str(10 + i)) for i in range(40)]
    hosts = ["\n".join([prose(rng, 12), prose(rng, 12), notice]) for _ in range(4)]
    assert kept_of(spark, alone + hosts, notice)[0] == 0
    df = spark.createDataFrame(list(enumerate(alone)), "doc_id long, text string")
    assert ln.dedup_lines(df).where("text = ''").count() == 0  # copies of one text, for near-duplicate removal
