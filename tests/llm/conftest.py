import pytest

#: Columns that clash with names used inside or added by the operators.
CLASHING = (
    "k1 string, k2 long, hi long, lo long, id string, member int, line string, leaf int, sketch int, template string, "
    "clean string, spans string, leaked string, toxicity string, restored int, is_toxic string, part int, window string, n int, h string, "
    "rule int, keep string, stat_chars string, entities string, terms string, term string, content int, url_score string, __text string, "
    "`a.b` string, `odd ``name` string"
)


@pytest.fixture(scope="session")
def widened():
    """Adds null columns of clashing names, but those in ``keep``."""
    from pyspark.sql import functions as F

    def widen(df, *keep):
        have = {c.lower() for c in df.columns}
        for part in CLASHING.split(", "):
            name, kind = part.rsplit(" ", 1)
            name = name.strip("`").replace("``", "`")
            if name.lower() not in have and name not in keep:
                df = df.withColumn(name, F.lit(None).cast(kind))
        return df

    return widen


LONG = "alpha beta gamma delta epsilon zeta eta theta " * 25_000  # 1.2 MB


@pytest.fixture(scope="session")
def odd_docs(spark, widened):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy sleeping dog near the river bank", "en", "a", 72),
        (1, "the quick brown fox jumps over the lazy sleeping dog near the river bank", "en", "a", 72),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, "   \n\n ", None, "b", 6),
        (None, "a text that carries no identifier whatsoever but many useful words", "en", None, 65),
        (None, None, None, None, None),
        (5, LONG, "en", "c", len(LONG)),
        (6, "x", "en", "c", 1),
        (7, "\u0000 ퟿ é ß \U0001f600 ẞİ", "xx", "d", 12),
        (1, "another text under the same identifier with entirely different words inside", "en", "a", 75),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return widened(df)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'z' AS text", "'z' AS feature")
