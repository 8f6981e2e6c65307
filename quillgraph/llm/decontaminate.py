"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of tokens of every normalised test item.  A
document's tokens are streamed through it; the state's length is the longest
run, ending at this token, that some test item has too.  Where it reaches
``MIN_LENGTH``, or a run that ends here covers most of an item, the run is cut
out of the text; a document made up mostly of such runs goes.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean, materialize, objects, others, quoted, small_batches, text_key

#: A match of so many tokens is removed.
MIN_LENGTH = 8
#: So is a shorter one, of at least MIN_SHORT tokens, over this share of an item.
COVERAGE, MIN_SHORT = 0.8, 4
#: A document with this share of its tokens in removed spans goes whole.
DROP_SHARE = 0.8
#: Tokens of the test items in one automaton (some 100 MB in a worker); more items are streamed in more passes.
AUTOMATON_TOKENS = 200_000
_TOKEN = re.compile(r"\w+")


def normalise(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _TOKEN.findall(text.lower()) if text else []


@dataclass
class SuffixAutomaton:
    """Generalised suffix automaton over token ids.

    ``next``: transitions; ``link``: suffix links; ``length``: longest run;
    ``shortest``: tokens of the shortest item that the longest run occurs in;
    ``covering``: the longest run, among those of the state's suffix links and
    its own, that covers enough of an item.
    """

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    shortest: list[int] = field(default_factory=lambda: [1 << 60])
    covering: list[int] = field(default_factory=list)
    ids: dict[str, int] = field(default_factory=dict)

    def _state(self, length: int, link: int, edges: dict[int, int], shortest: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.shortest.append(shortest)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.shortest[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # this run is known from another item
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        cur = self._state(self.length[last] + 1, 0, {}, 1 << 60)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def add(self, tokens: list[str]) -> None:
        last = 0
        for t in tokens:
            last = self._extend(last, self.ids.setdefault(t, len(self.ids)))
        # occurrences of this item: all suffix-link ancestors of its prefixes
        state = 0
        for t in tokens:
            state = self.next[state][self.ids[t]]
            s = state
            while s > 0 and self.shortest[s] > len(tokens):
                self.shortest[s] = len(tokens)
                s = self.link[s]

    def finish(self) -> SuffixAutomaton:
        self.covering = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            n = self.length[s]
            self.covering[s] = n if n >= MIN_SHORT and n >= COVERAGE * self.shortest[s] else self.covering[self.link[s]]
        return self

    def spans(self, tokens: list[str]) -> list[tuple[int, int]]:
        """Runs of tokens [start, end) to remove, merged where they touch."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out: list[tuple[int, int]] = []
        for i, c in enumerate(map(self.ids.get, tokens), 1):
            if c is None:
                state = size = 0
                continue
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(c)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            if size >= MIN_SHORT:
                n = size if size >= MIN_LENGTH or size >= COVERAGE * self.shortest[state] else self.covering[link[state]]
                if n:
                    a = i - n
                    while out and a <= out[-1][1]:
                        a = min(a, out.pop()[0])
                    out.append((a, i))
        return out


def batched(items: Iterable[str | None]) -> Iterator[SuffixAutomaton]:
    """Automata of bounded size over all items."""
    automaton, room = SuffixAutomaton(), AUTOMATON_TOKENS
    for x in items:
        tokens = normalise(x)
        if not tokens:
            continue
        if automaton.ids and room < len(tokens):
            yield automaton.finish()
            automaton, room = SuffixAutomaton(), AUTOMATON_TOKENS
        automaton.add(tokens)
        room -= len(tokens)
    if automaton.ids:
        yield automaton.finish()


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def clean(text: str | None, spans: list[tuple[int, int]], tokens: list[str]) -> tuple[str | None, list[tuple[int, int]], float]:
    """The text without the spans of its tokens, the spans in characters, their share of the tokens."""
    if not text or not spans:
        return text, [], 0.0
    low = text.lower()
    if len(low) == len(text):
        at = [m.span() for m in _TOKEN.finditer(low)]
    else:  # lower case has another length here; find the same tokens letter by letter
        back = [i for i, ch in enumerate(text) for _ in ch.lower()] + [len(text)]
        at = [(back[a], back[b - 1] + 1) for a, b in (m.span() for m in _TOKEN.finditer(low))]
    chars, parts, end = [], [], 0
    for a, b in spans:
        x, y = at[a][0], at[b - 1][1]
        while y < len(text) and text[y] in ".,;:!?":
            y += 1
        chars.append((x, y))
        parts.append(text[end:x])
        end = y
    parts.append(text[end:])
    return "".join(parts), chars, sum(b - a for a, b in spans) / len(tokens)


_CLEAN = "text string, starts array<int>, ends array<int>, share double"


def _cleaned(rows: list[tuple[str | None, list[tuple[int, int]], float]]) -> pd.DataFrame:
    return pd.DataFrame({
        "text": objects(r[0] if r[1] else None for r in rows),  # unchanged texts are not sent back
        "starts": objects(np.array([s[0] for s in r[1]], np.int32) for r in rows),
        "ends": objects(np.array([s[1] for s in r[1]], np.int32) for r in rows),
        "share": [r[2] for r in rows],
    })


def _in_one_pass(docs: DataFrame, automaton: SuffixAutomaton, text_col: str, tmp: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # at most AUTOMATON_TOKENS tokens

    @lean
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        for texts in batches:
            split = [normalise(t) for t in texts]
            yield _cleaned([clean(t, automaton.spans(x), x) for t, x in zip(texts, split)])

    return docs.withColumn(tmp, F.pandas_udf(cleaned, _CLEAN)(F.col(quoted(text_col))))


def _in_passes(docs: DataFrame, automata: Iterable[SuffixAutomaton], text_col: str, tmp: str) -> DataFrame:
    """A pass for each automaton writes the spans of the texts that have any; the last joins and cuts them."""
    text = F.col(quoted(text_col))
    k1, k2 = text_key(text)
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text")).where("text <> ''")
    found: DataFrame | None = None
    for automaton in automata:
        shared = docs.sparkSession.sparkContext.broadcast(automaton)  # at most AUTOMATON_TOKENS tokens

        @lean
        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(a, b, s) for a, b, t in zip(pdf["k1"], pdf["k2"], pdf["text"]) if (s := shared.value.spans(normalise(t)))]
                yield pd.DataFrame({"k1": np.array([r[0] for r in rows], np.int64), "k2": np.array([r[1] for r in rows], np.int64), "at": objects(np.array(r[2], np.int32).ravel() for r in rows)})

        one = materialize(texts.mapInPandas(find, "k1 long, k2 long, at array<int>"))
        found = one if found is None else found.union(one)
    a, b, n1, n2, at = fresh(docs, "k1", "k2", "h1", "h2", "at")
    by_text = found.groupBy("k1", "k2").agg(F.flatten(F.collect_set("at")).alias(at))
    by_text = by_text.select(F.col("k1").alias(n1), F.col("k2").alias(n2), at)
    joined = docs.withColumns({a: k1, b: k2}).join(by_text, (F.col(a) == F.col(n1)) & (F.col(b) == F.col(n2)), "left")

    @lean
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, places in batches:
            rows = []
            for t, p in zip(texts, places):
                own = merged(map(tuple, np.reshape(p, (-1, 2)).tolist())) if p is not None and len(p) else []
                rows.append(clean(t, own, normalise(t) if own else []))
            yield _cleaned(rows)

    return joined.withColumn(tmp, F.pandas_udf(cut, _CLEAN)(F.when(F.col(at).isNotNull(), text), F.col(at)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: tuple[str, str, str] = ("clean", "spans", "leaked")) -> DataFrame:
    """``docs`` with the cleaned text, the removed character spans [start, end) and their share of tokens.

    Null and empty texts stay as they are with no spans; null, empty and
    repeated test items are ignored; with no items nothing changes.  Texts are
    streamed whole; repeated rows are cleaned alike; columns of ``docs`` that
    are named like an output are replaced, all others are untouched.
    """
    text = F.col(quoted(text_col))
    small_batches(docs.sparkSession)
    items = benchmark.select("text").where(F.col("text").isNotNull()).distinct().orderBy("text")
    automata = batched(r[0] for r in items.toLocalIterator())
    first = next(automata, None) or SuffixAutomaton().finish()
    second = next(automata, None)
    (tmp,) = fresh(docs, "leak")
    if second is None:
        df = _in_one_pass(docs, first, text_col, tmp)
    else:
        df = _in_passes(docs, itertools.chain((first, second), automata), text_col, tmp)
    hit = F.col(tmp)
    return df.select(
        *others(docs, *out),
        F.when(hit["share"] > 0, hit["text"]).otherwise(text).alias(out[0]),
        F.arrays_zip(hit["starts"].alias("start"), hit["ends"].alias("end")).alias(out[1]),
        hit["share"].alias(out[2]),
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents with leaked spans cut out; those leaked for DROP_SHARE of their tokens go.

    All columns kept; ``n_chars`` is set anew where the text changed.  Null
    and empty texts stay, an empty table stays empty.
    """
    a, b, c = fresh(docs, "clean", "spans", "leaked")
    df = decontaminate(docs, benchmark, out=(a, b, c)).where(F.col(c) < DROP_SHARE)
    new = {"text": F.col(a), "n_chars": F.when(F.col(c) > 0, F.length(a)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return df.select(*[(new[x].cast(docs.schema[x].dataType).alias(x) if x in new else F.col(quoted(x))) for x in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, clean, spans, leaked, drop of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "clean", "spans", "leaked", (F.col("leaked") >= DROP_SHARE).alias("drop"))
