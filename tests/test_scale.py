"""What keeps queries within bounds on larger tables, and gives the same."""

import random

import pyarrow as pa
import pytest
import yaml
from pyspark.sql import functions as F

from quillgraph.functions import markdown as md
from quillgraph.functions import text as tx
from quillgraph.functions import vectors
from quillgraph.operators import context, fts, resolve
from quillgraph.plans import catalog, catalog_library
from quillgraph.sources import markdown


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def packed(spark, folder):
    return [tuple(r) for r in catalog.QUERIES["packed_context"](spark, folder).collect()]


def test_packing_takes_only_texts_that_can_fit(spark, tmp_path, monkeypatch):
    rows = [(i, f"{i} " + "x" * 990, "en", "web") for i in range(700)] + [(None, "late", "en", "web"), (3_000, "", "en", "web")]
    seen = []
    real = context.pack
    monkeypatch.setattr(catalog_library.context, "pack", lambda items, n: seen.append(sum(len(c.content) for c in items)) or real(items, n))
    got = packed(spark, documents(spark, tmp_path, rows))
    assert [i for i, _ in got] == list(range(len(got))) and sum(len(t) for _, t in got) == 50_000 and got[-1][1].endswith("...")
    assert seen[0] <= 100_000


def test_packing_takes_all_of_few_or_many_short_texts(spark, tmp_path):
    few = [(2, "b", "en", "web"), (None, "c", "en", "web"), (1, "a" * 60, "en", "web")]
    assert packed(spark, documents(spark, tmp_path / "few", few)) == [(1, "a" * 60), (2, "b"), (None, "c")]
    many = packed(spark, documents(spark, tmp_path / "many", [(i, "ab", "en", "web") for i in range(26_000)]))
    assert many == [(i, "ab") for i in range(25_000)]
    assert packed(spark, documents(spark, tmp_path / "long", [(1, "y" * 70_000, "en", "web"), (2, "z", "en", "web")])) == [(1, "y" * 49_997 + "...")]


def test_nothing_is_packed_behind_the_text_that_is_cut(spark, tmp_path):
    rows = [(1, "y" * 40_000, "en", "web"), (2, "z" * 9_990 + " " * 20, "en", "web"), (3, "tail", "en", "web")]
    assert packed(spark, documents(spark, tmp_path, rows)) == [(1, "y" * 40_000), (2, "z" * 9_990 + "...")]


ODD = ["", None, "aİb İ KİLO Straße ΣΑΣ Žž ǅ Ⅷ", "The the THE then", "café Cafe CAFÉS ecole École", "ユーザー認証 ab ユーザ 한국어 漢 x漢字x", "ab the-the_the thé \U00010400the \U00010428\U00010428 the\U00010428", "—the “nicht” 10the 1٠the", "že ž Žluť ž", "x" * 200 + " the"]
PREFIXES = ["the", "cafe", "café", "th", "ユー", "認証", "漢字x", "漢", "국어", "1", "\U00010428", "ž", "no such", "the-", "b", "ecole", "aé"]


@pytest.mark.parametrize("indexed", [False, True])
def test_prefixes_are_counted_as_tokens_would_be(spark, indexed):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    tokens = {r["id"]: r for r in df.select("id", tx.words(F.col("text")).alias("plain"), tx.index_tokens(F.col("text")).alias("stream")).collect()}
    cols = [c for i, p in enumerate(PREFIXES) for c in (tx.count_prefix(F.col("text"), p).alias(f"n{i}"), tx.has_prefix(F.col("text"), p).alias(f"h{i}"))]
    for r in df.select("id", tx.count_words(F.col("text")).alias("words"), tx.count_index_tokens(F.col("text")).alias("tokens"), *cols).collect():
        own = tokens[r["id"]]
        assert (r["words"], r["tokens"]) == (len(own["plain"]), len(own["stream"]))
        for i, p in enumerate(PREFIXES):
            assert r[f"n{i}"] == sum(t.startswith(p) for t in own["plain"]), (p, own)
            assert r[f"h{i}"] == any(t.startswith(p) for t in own["stream"]), (p, own)


def test_postings_hold_each_token(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    want = {}
    for r in df.select("id", tx.words(F.col("text")).alias("plain"), tx.index_tokens(F.col("text")).alias("stream")).collect():
        for k, tokens in enumerate((r["stream"], r["plain"])):
            for t in tokens:
                want.setdefault((t, r["id"]), [0, 0, len(r["stream"])])[k] += 1
    got = {(r["term"], r["id"]): [r["indexed"], r["plain"], r["len"]] for r in fts.postings(df, "id", "text").collect()}
    assert got == want and ("認証", 5) in got and ("漢字", 5) in got


def test_texts_with_one_id_or_none_in_term_statistics(spark):
    rows = [(1, "a a b"), (2, "a"), (None, "b c"), (None, "c")]
    count = lambda rows: {r["term"]: (r["tf"], r["df"]) for r in fts.term_statistics(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert count(rows) == {"a": (3, 2), "b": (2, 1), "c": (2, 0)}
    assert count([*rows, (1, "a c")]) == {"a": (4, 2), "b": (2, 1), "c": (3, 1)}


def test_plain_front_matter_is_read_as_yaml_reads_it():
    rng = random.Random(7)
    words = ["a", "Zé", "x y", "./src/en.ts", "1", "1.5", "true", "Null", "2026-01-01", "a-b_c", "中文", "-", "~", ".5", "a:b", "no", "a  b", "#x", "'q'", "a #b"]
    plain = 0
    for _ in range(3_000):
        lines = [f"{rng.choice(['title', 'tags', 'true', 'x-y'])}:{rng.choice([' ', '  '])}{rng.choice([rng.choice(words), '[' + ', '.join(rng.choices(words, k=2)) + ' ]'])}{rng.choice(['', ' ', chr(13)])}" for _ in range(2)]
        fast = md._plain_mapping(lines)
        if fast is not None:
            plain += 1
            assert fast == yaml.load("\n".join(lines), Loader=md._Loader), lines  # noqa: S506
    assert plain > 100


def test_files_are_parsed_in_small_slices(spark, monkeypatch):
    held = []
    monkeypatch.setattr(markdown, "_stored", lambda records, kind, real=markdown._stored: held.append(len(records)) or real(records, kind))
    schema = markdown.to_arrow_schema(spark.createDataFrame([], md.PARSED_SCHEMA).schema)
    batch = pa.record_batch({"path": [f"{i}.md" for i in range(2_500)], "updated_at": ["t"] * 2_500, "content": [b"# A"] * 2_500})
    got = list(markdown._parser(schema)([batch]))
    assert max(held) == max(b.num_rows for b in got) == markdown.SLICE and sum(b.num_rows for b in got) == 2_500


def test_a_record_that_cannot_be_stored_fails_alone(spark):
    files = [("a.md", b"# A"), ("b.md", b'---\ntitle: "\\ud800"\n---\n# B'), ("c.md", None), ("d.md", b"# D")]
    df = spark.createDataFrame(files, "path string, content binary").withColumn("modified", F.lit("2026-01-01").cast("timestamp"))
    got = {r["path"]: r for r in markdown.parse_files(df.coalesce(1)).collect()}
    assert [p for p in sorted(got) if got[p]["error"] is None] == ["a.md", "d.md"] and got["a.md"]["title"] == "A"
    assert got["b.md"]["error"].startswith("Unicode") and got["c.md"]["error"].startswith("TypeError")


def test_texts_go_to_the_embedder_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    vectors.embed_column(F.col("x"), "local-hash", "local-hash-v1", 8)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000


def test_only_rows_of_repeated_keys_are_sorted(spark):
    rows = [(i, i, "x") for i in range(50)] + [(7, 1, "y"), (7, 99, "z"), (None, 2, "n"), (None, 1, "m")]
    order = [F.col("at")]
    for given in (rows, rows[:50], rows[:50] + rows[-1:], rows[:50] + rows[-2:]):
        df = spark.createDataFrame(given, "id long, at long, t string")
        as_before = resolve.first_by(df, ["id"], order)
        got = resolve.first_by_rare(df, ["id"], order)
        assert sorted(map(str, got.collect())) == sorted(map(str, as_before.collect()))
    plain = resolve.first_by_rare(spark.createDataFrame(rows[:50], "id long, at long, t string"), ["id"], order)
    assert "Window" not in plain._jdf.queryExecution().optimizedPlan().toString()
