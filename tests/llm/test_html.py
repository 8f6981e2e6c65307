import itertools
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import html as h


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=25))
def test_best_run_is_that_of_all_runs(scores):
    a, b = h.best_run([float(s) for s in scores])
    want = max((sum(scores[i:j]) for i, j in itertools.combinations(range(len(scores) + 1), 2)), default=0)
    assert sum(scores[a:b]) == max(0, want)


@pytest.mark.parametrize(
    "page, tokens",
    [
        ("<p class='a'>one two</p>", [("t", "p"), ("w", "one"), ("w", "two"), ("t", "/p")]),
        ("<script>if (a<b) x();</script>end", [("t", "script"), ("w", "end")]),
        ("<!-- <p>no</p> -->yes", [("t", "!--"), ("w", "yes")]),
        ("<style>p{}", [("t", "style")]),
        ("a < b", [("w", "a"), ("w", "<"), ("w", "b")]),
        ("<!DOCTYPE html>", [("t", "!")]),
    ],
)
def test_tokens(page, tokens):
    assert [t if t[1] != "doctype" else ("t", "!") for t in h.tokenize(page)] == tokens


def page(words, nav=8):
    menu = "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(nav))
    body = "".join(f"<p>{' '.join(words[i : i + 12])}</p>" for i in range(0, len(words), 12))
    return f"<html><head><title>t</title></head><body><nav><ul>{menu}</ul></nav><article>{body}</article><footer><a>about</a> <a>terms</a></footer></body></html>"


def test_content_of_marked_and_unmarked_pages():
    pages = [page([f"w{i}x{k}" for k in range(60)]) for i in range(20)]
    model = h.learn(pages)
    words = [f"new{k}" for k in range(48)]
    for p in (page(words), page(words).replace("article", "div")):
        assert h.extract(p, model).split() == words
    assert h.extract(page(words), h.ContentModel()).split()[-48:] == words


def test_documents_of_the_test_data(spark, sf_tiny):
    pages = spark.read.parquet(f"{sf_tiny}/pages.parquet").collect()
    got = {r["page_id"]: r["content"] for r in h.op10_html_content(spark, sf_tiny).collect()}
    assert len(got) == len(pages)
    hits = total = wrong = 0
    for p in pages:
        tokens = h.tokenize(p["html"])
        inside = h.label_tokens(tokens)
        if inside is None:
            continue
        want = h._html.unescape(" ".join(s for (k, s), i in zip(tokens, inside) if k == "w" and i)).split()
        have = got[p["page_id"]].split()
        same = (Counter(want) & Counter(have)).total()
        total += len(want)
        hits += same
        wrong += len(have) - same
    assert total and hits / total > 0.95 and wrong / total < 0.1


def test_query_is_that_of_all_runs_compared(spark, sf_tiny):
    """The whole query by brute force: of all runs of a page's tokens that with the greatest sum."""
    pages = spark.read.parquet(f"{sf_tiny}/pages.parquet")
    model = h.train(pages)
    texts = {r["page_id"]: r["html"] for r in pages.collect()}
    compared = 0
    for r in h.op10_html_content(spark, sf_tiny).collect():
        tokens = h.tokenize(texts[r["page_id"]])
        if len(tokens) > 1500:
            continue
        sums = np.concatenate([[0.0], np.cumsum(h.score_tokens(tokens, model))])
        gain = sums[None, :] - sums[:, None]
        best = np.triu(gain).max()
        if best <= 0:
            assert r["content"] == ""
            continue
        runs = [(int(i), int(j)) for i, j in np.argwhere(np.triu(gain) >= best - 1e-9)]
        words = [h._html.unescape(" ".join(s for k, s in tokens[i:j] if k == "w")).split() for i, j in runs]
        assert r["content"].split() in words
        compared += 1
    assert compared > 20


def test_odd_rows(spark, widened):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<<<>>><p"), (None, None, "<p>words in here"), (4, "u", "<div>" * 50_000 + "deep words"), (5, "u", "plain words only"), (5, "u", "plain words only"), (6, "u", "<p></p>"), (7, "u", "<article>a</article><article>b</article>")]
    df = widened(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = h.extract_content(df, h.train(df))
    assert len(got.columns) == len({c.lower() for c in got.columns})
    out = {r["page_id"]: r["content"] for r in got.collect()}
    assert out[1] is None and out[2] == "" and out[6] == "" and out[5] == "plain words only" and out[4] == "deep words"
    assert got.count() == len(rows)
    none = df.limit(0)
    assert h.extract_content(none, h.train(none)).count() == 0
