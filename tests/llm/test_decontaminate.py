import random

from brute import leaked
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate as dec

WORDS = st.lists(st.sampled_from("a b c d".split()), max_size=40)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.lists(WORDS.filter(bool), min_size=1, max_size=4))
def test_automaton_finds_what_brute_force_finds(tokens, items):
    (automaton,) = dec.batched([" ".join(x) for x in items])
    spans = automaton.spans(tokens)
    covered = [any(a <= i < b for a, b in spans) for i in range(len(tokens))]
    assert covered == leaked(tokens, items)
    assert spans == dec.merged(spans)


def planted():
    rng = random.Random(5)
    vocabulary = [f"w{'abcdefghijklmnop'[i % 16]}{'qrstuvwxyz'[i // 16]}" for i in range(160)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(30), text(12), "only five words in here", text(60)]
    docs = [(0, text(200)), (1, text(50) + " " + items[0].upper() + ". " + text(50)), (2, items[3]), (3, text(20) + ", Only five -- words in HERE! " + text(20)), (4, items[1][: len(items[1]) // 2] + " zz"), (5, items[0] + " " + items[1])]
    return items, docs


def test_planted_passages(spark):
    items, docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(enumerate(items), "item_id long, text string")
    got = {r["doc_id"]: r for r in dec.decontaminate(df, bench).collect()}
    normal = [dec.normalise(x) for x in items]
    for i, text in docs:
        tokens = dec.normalise(text)
        covered = leaked(tokens, normal)
        assert dec.normalise(got[i]["clean"]) == [t for t, c in zip(tokens, covered) if not c]
        assert got[i]["leaked"] == sum(covered) / len(tokens)
    assert got[0]["clean"] == docs[0][1] and got[0]["spans"] == []
    assert "ONLY" not in got[3]["clean"].upper()
    left = {r["doc_id"] for r in dec.remove_leaks(df, bench).collect()}
    assert left == {0, 1, 3, 4}


def test_matches_brute_force_over_documents(spark, sf_tiny):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").orderBy("doc_id").limit(60).collect()  # brute force is slow
    items = sorted({tuple(dec.normalise(r["text"])) for r in spark.read.parquet(f"{sf_tiny}/benchmark.parquet").collect()})
    got = {r["doc_id"]: r for r in dec.op9_decontaminate(spark, sf_tiny).collect()}
    grams = {tuple(x[i : i + dec.MIN_SHORT]) for x in items for i in range(len(x) - dec.MIN_SHORT + 1)}
    for r in docs:
        tokens = dec.normalise(r["text"])
        starts = [i for i in range(len(tokens)) if tuple(tokens[i : i + dec.MIN_SHORT]) in grams]
        keep = {k for i in starts for k in range(max(0, i - 80), i + 80)}  # only near a shared run
        covered = [False] * len(tokens)
        part = []
        for i in range(len(tokens) + 1):
            if i in keep and i < len(tokens):
                part.append(i)
            elif part:
                for k, c in zip(part, leaked([tokens[k] for k in part], [list(x) for x in items])):
                    covered[k] = c
                part = []
        assert got[r["doc_id"]]["leaked"] == (sum(covered) / len(tokens) if tokens else 0.0)


def test_a_large_benchmark_is_streamed_in_passes(spark, monkeypatch):
    items, docs = planted()
    df = spark.createDataFrame(docs + docs[:1] + [(9, None)], "doc_id long, text string")
    bench = spark.createDataFrame(enumerate(items), "item_id long, text string")
    one = sorted(map(str, dec.decontaminate(df, bench).collect()))
    monkeypatch.setattr(dec, "AUTOMATON_TOKENS", 40)
    assert sorted(map(str, dec.decontaminate(df, bench).collect())) == one


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "quick brown fox jumps over the lazy sleeping dog"), (3, "quick brown fox jumps over the lazy sleeping dog"), (None, "??")], "item_id long, text string")
    got = dec.decontaminate(odd_docs, bench)
    assert len(got.columns) == len({c.lower() for c in got.columns}) and got.count() == odd_docs.count()
    fox = [r for r in got.collect() if r["leaked"] > 0]
    assert [r["doc_id"] for r in fox] == [1, 1] and {r["clean"] for r in fox} == {"the  near the river bank"}
    cut = dec.remove_leaks(odd_docs, bench)
    assert cut.schema.names == odd_docs.schema.names and cut.count() == odd_docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["doc_id"] == 1)
    none = bench.limit(0)
    assert dec.decontaminate(odd_docs, none).where(F.col("leaked") > 0).count() == 0
    assert dec.remove_leaks(no_docs, bench).count() == 0 and dec.decontaminate(no_docs, none).count() == 0


def test_lower_case_of_another_length(spark):
    text = "İstanbul quick brown fox jumps over the lazy dog İ end"
    (automaton,) = dec.batched(["quick brown fox jumps over the lazy dog"])
    clean, spans, _ = dec.clean(text, automaton.spans(dec.normalise(text)), dec.normalise(text))
    assert clean == "İstanbul  İ end" and [text[a:b] for a, b in spans] == ["quick brown fox jumps over the lazy dog"]
