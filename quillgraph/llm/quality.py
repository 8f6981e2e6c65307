"""Quality rules: decision lists learned by sequential covering.

Statistics of a text are built-in Spark expressions.  From labelled
documents, rules are learned one after another: a conjunction of thresholds
grows literal by literal (by FOIL's information gain), is pruned on held-out
rows, and the documents it covers are set aside before the next is grown.
The list becomes one ordered ``CASE WHEN`` over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, others, quoted

#: Bound on the labelled documents that rules are learned from.
MAX_LABELLED = 16_000
MAX_RULES, MAX_LITERALS, MIN_COVER, MIN_PRECISION = 12, 4, 5, 0.9


def with_statistics(df: DataFrame, text: Column, names: dict[str, str]) -> DataFrame:
    """``df`` with numbers about a text, under ``names``; null counts as empty, shares of an empty text are 0.

    Words, lines and letters are columns of a projection below that of the
    numbers, which use them several times, so each is made once a row.
    """
    t, n, words, lines, letters, digits, symbols = fresh(df.select("*", *[F.lit(0).alias(x) for x in names.values()]), "text", "n", "words", "lines", "letters", "digits", "symbols")
    kept = [F.col(quoted(c)) for c in df.columns]
    first = df.select(*kept, F.coalesce(text, F.lit("")).alias(t))
    without = lambda pattern: F.length(F.regexp_replace(F.col(t), pattern, ""))
    second = first.select(
        *kept, t, F.length(t).alias(n), F.array_remove(F.split(F.col(t), r"\s+"), "").alias(words), F.split(F.col(t), "\n").alias(lines),
        without(r"[^\p{L}]+").alias(letters), without(r"[^0-9]+").alias(digits), without(r"[\p{L}0-9\s.,;:!?'\"()-]+").alias(symbols),
    )
    n, words, lines, letters, digits, n_words = F.col(n), F.col(words), F.col(lines), F.col(letters), F.col(digits), F.size(words)
    share = lambda part, whole: F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))
    numbers = {
        "chars": n.cast("double"),
        "words": n_words.cast("double"),
        "word_length": share(letters, n_words),
        "letter_share": share(letters, n),
        "digit_share": share(digits, n),
        "symbol_share": share(F.col(symbols), n),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "capital_share": share(without(r"[^\p{Lu}]+"), letters),
        "stops_per_word": share(without(r"[^.!?]+"), n_words),
    }
    return second.select(*kept, *[numbers[k].alias(names[k]) for k in STATISTICS])


STATISTICS = ("chars", "words", "word_length", "letter_share", "digit_share", "symbol_share", "distinct_words", "distinct_lines", "capital_share", "stops_per_word")


@dataclass(frozen=True)
class Literal:
    name: str
    op: str  # "<=" or ">"
    value: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] <= self.value if self.op == "<=" else x[self.name] > self.value

    def column(self, stats: dict[str, Column]) -> Column:
        return stats[self.name] <= self.value if self.op == "<=" else stats[self.name] > self.value

    def __str__(self) -> str:
        return f"{self.name} {self.op} {self.value:.6g}"


Rule = tuple[Literal, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for literal in rule:
        out &= literal.mask(x)
    return out


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0)))
    return np.where(p >= MIN_COVER, np.nan_to_num(g, nan=-np.inf, neginf=-np.inf), -np.inf)


def _best_literal(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Literal | None]:
    """The threshold with the greatest gain; the first of equals in the order of the statistics."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best: tuple[float, Literal | None] = (0.0, None)
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        s, b = v[order], bad[order]
        cut = np.flatnonzero(s[1:] > s[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
        middle = (s[cut] + s[cut + 1]) / 2
        for op, gains in (("<=", _gain(p0, n0, p, n)), (">", _gain(p0, n0, p0 - p, n0 - n))):
            i = int(np.argmax(gains))
            if gains[i] > best[0] + 1e-9:
                best = (float(gains[i]), Literal(name, op, round(float(middle[i]), 6)))
    return best


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_LITERALS and (~bad[inside]).any() and bad[inside].any():
        _, literal = _best_literal({k: v[inside] for k, v in x.items()}, bad[inside])
        if literal is None:
            break
        rule += (literal,)
        inside &= literal.mask(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest prefix that is best on held-out rows."""

    def worth(r: Rule) -> float:
        c = covers(r, x)
        p, n = int(bad[c].sum()), int((~bad[c]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules for unwanted documents; every third row prunes, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < MAX_RULES:
        grow, prune = left & ~third, left & third
        if bad[grow].sum() < MIN_COVER:
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if rule and prune.any():
            rule = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        inside = covers(rule, x) & left
        if not rule or bad[inside].sum() < MIN_COVER or bad[inside].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> list[Rule]:
    """Rules from at most ``max_rows`` labelled documents, the first by a hash of the id.

    Rows with a null id or label are left out; an id with both labels counts
    as unwanted.  Without labels the list is empty and everything is kept.
    """
    lab = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).toPandas()
    spark = docs.sparkSession
    small = spark.createDataFrame(list(zip(map(str, ids["doc_id"]), map(int, ids["quality"]))), "doc_id string, quality int")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(F.broadcast(small), "doc_id")  # at most max_rows ids
    pdf = with_statistics(rows, F.col("text"), {k: k for k in STATISTICS}).drop("text").toPandas()
    pdf = pdf.drop_duplicates(list(STATISTICS) + ["quality"])  # copies count once
    if pdf.empty:
        return []
    pdf = pdf.sort_values(["doc_id", *STATISTICS], kind="stable")
    return learn({k: pdf[k].to_numpy(float) for k in STATISTICS}, (pdf["quality"] == 0).to_numpy())


def rule_column(rules: list[Rule], stats: dict[str, Column]) -> Column:
    """The text of the first rule that holds, null where none does."""
    out: Column | None = None
    for rule in rules:
        held = rule[0].column(stats)
        for literal in rule[1:]:
            held = held & literal.column(stats)
        text = F.lit(" AND ".join(map(str, rule)))
        out = F.when(held, text) if out is None else out.when(held, text)
    return F.lit(None).cast("string") if out is None else out


def apply_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", out: tuple[str, str] = ("rule", "keep")) -> DataFrame:
    """``docs`` with the statistics, the rule that rejects (null: none) and ``keep``.

    Statistics are added under names that clash with no column of ``docs``
    (``stat_chars`` and so on where free).  Null and empty texts have zeros;
    equal texts get equal rules; columns named like an output are replaced.
    No rows give none.
    """
    names = {}
    taken = {c.lower() for c in docs.columns}
    for k in STATISTICS:
        name = f"stat_{k}"
        while name.lower() in taken:
            name += "_"
        names[k] = name
    with_stats = with_statistics(docs, F.col(quoted(text_col)), names)
    (tmp,) = fresh(with_stats, "rule")
    ruled = with_stats.withColumn(tmp, rule_column(rules, {k: F.col(v) for k, v in names.items()}))
    return ruled.select(*others(with_stats, *out), F.col(tmp).alias(out[0]), F.col(tmp).isNull().alias(out[1]))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the statistics, rule and keep of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, rules).drop("text")
