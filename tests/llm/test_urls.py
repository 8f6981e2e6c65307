import numpy as np
import pandas as pd
import pytest

from quillgraph.llm import urls as u


@pytest.mark.parametrize(
    "url, host, path",
    [
        ("https://User:pw@WWW.Example.com:8080/A/b?x=1#frag", "www.example.com", "/a/b?x=1"),
        ("//host.org", "host.org", ""), ("host.org?q", "host.org", "?q"), ("", "", ""), (None, "", ""), ("http://h/p?u=http://x/", "h", "/p?u=http://x/"),
    ],
)
def test_parts(url, host, path):
    assert u.host_and_path(url) == (host, path)


def by_hand(url):
    out = []
    for space, part in enumerate(u.host_and_path(url)):
        data = bytes(48 if 48 <= b <= 57 else b for b in ("^" + part + "$").encode())
        for n in u.SIZES:
            for i in range(len(data) - n + 1):
                h = 1469598103934665603 + 31 * n + 7 * space
                for b in data[i : i + n]:
                    h = ((h ^ b) * 1099511628211) % (1 << 64)
                out.append((h ^ (h >> 29)) % u.BUCKETS)
    return sorted(out)


def test_ngrams_by_hand():
    urls = ["https://blog.example.com/en/12.html", None, "é", "a.b/c", ""]
    rows, buckets = u.hashed_ngrams(urls)
    for i, url in enumerate(urls):
        assert sorted(buckets[rows == i].tolist()) == by_hand(url)


def test_held_out_accuracy_on_unseen_hosts():
    table = u.labelled_urls()
    host = table["url"].map(lambda x: u.host_and_path(x)[0])
    table["name"] = host.str.replace(r"^(www|m|blog)\.", "", regex=True).str.rpartition(".")[0]
    right = []
    for part in range(5):
        held = table["name"].map(lambda x: hash_of(x) % 5 == part)
        assert set(table[held]["name"]).isdisjoint(table[~held]["name"])
        p = u.fit(table[~held]).probability(list(table[held]["url"]))
        right += list((p >= u.THRESHOLD) == (table[held]["label"] == 1))
    assert len(right) == len(table) and np.mean(right) >= 0.9, np.mean(right)


def hash_of(s):
    return sum((i + 1) * ord(c) for i, c in enumerate(str(s)))


def test_gradient_is_that_of_the_loss():
    rows = pd.DataFrame({"url": ["http://casino.com/x", "http://library.org/y", "http://a.net/slots?q"], "label": [1, 0, 1]})
    l2 = 1e-2
    model = u.fit(rows, steps=4000, rate=4.0, l2=l2)
    grams, w, b = [by_hand(x) for x in rows["url"]], model.weights.astype(float), model.bias

    def loss(w, b):
        z = np.array([b + sum(w[g] for g in gs) / np.sqrt(len(gs)) for gs in grams])
        return np.mean(np.log1p(np.exp(-z * (2 * rows["label"].to_numpy() - 1)))) + l2 / 2 * (w**2).sum()

    at = loss(w, b)
    for k in {grams[0][0], grams[1][3], grams[2][-1]}:  # at the minimum no weight has a slope
        up, down = w.copy(), w.copy()
        up[k] += 1e-3
        down[k] -= 1e-3
        assert abs(loss(up, b) - loss(down, b)) / 2e-3 < 2e-3
    assert at < loss(np.zeros_like(w), 0.0)


def test_odd_rows(spark, widened):
    long = "http://x.org/" + "a" * 300_000
    df = widened(spark.createDataFrame([(1, None), (2, ""), (3, "  "), (None, "http://casino.example.com/"), (4, long), (5, "ü:// /é"), (5, "ü:// /é")], "page_id long, url string"))
    model = u.fit(u.labelled_urls())
    got = u.score_urls(df, model)
    assert len(got.columns) == len({c.lower() for c in got.columns})
    rows = {r["page_id"]: r for r in got.collect()}
    assert got.count() == 7
    assert all(rows[i]["url_score"] is None and rows[i]["keep"] for i in (1, 2, 3))
    assert rows[None]["url_score"] > 0.5 and not rows[None]["keep"]
    assert 0 <= rows[4]["url_score"] <= 1
    assert u.score_urls(df.limit(0), model).count() == 0


def test_no_labels_tell_nothing(spark):
    none = spark.createDataFrame([("a", None)], "url string, label int")
    assert u.fit_table(none).probability(["http://a"])[0] == 0.5
    table = spark.createDataFrame([("http://casino.com", 1), (None, 0), ("http://casino.com", 1), ("http://books.org", 0), ("http://books.org", None)], "url string, label int")
    p = u.fit_table(table).probability(["http://casino.com", "http://books.org"])
    assert p[0] > p[1]


def test_every_page_is_scored_as_alone(spark, sf_tiny):
    model = u.fit(u.labelled_urls())
    got = u.op2_url_filter(spark, sf_tiny).collect()
    assert len(got) == spark.read.parquet(f"{sf_tiny}/pages.parquet").count()
    for r in got[:100]:
        x = sum(model.weights[b] for b in by_hand(r["url"])) / np.sqrt(max(1, len(by_hand(r["url"]))))
        assert r["url_score"] == pytest.approx(1 / (1 + np.exp(-(model.bias + x))), abs=2e-5)
