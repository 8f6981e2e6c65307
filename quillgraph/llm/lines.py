"""Line dedup with a log-template tree.

Lines are parsed as log parsers do: tokens with digits become the wildcard
``<*>``; the tree's levels are the number of tokens and the first ``DEPTH``
tokens; in a leaf, lines that agree in a share ``SIMILAR`` of their tokens
are one template whose differing tokens become wildcards as well.  Templates
that recur in at least ``MIN_DOCS`` unrelated documents are boilerplate and
their lines are dropped wherever they stand.

Copies of one document repeat all its lines; that is for near-duplicate
removal to settle, not a reason to empty them.  So support is counted over
distinct texts, and first told by a one-hash MinHash of all but the line in
question: a template with at least ``MIN_DOCS`` different MinHash values, and
as many as a share ``UNRELATED`` of its texts, recurs.  Where that doesn't
tell, because near copies swell the texts or a shared block makes its hosts
alike, the texts are compared: two are related when most of the lines that
one doesn't share with ``MIN_DOCS`` texts are found in the other (of a text
that shares all its lines, the rest but the line in question).  The template
recurs when ``MIN_DOCS`` of its texts are unrelated, however many copies
there are.  Texts that are nothing but the line count as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean, materialize, objects, quoted, small_batches, text_key

DEPTH = 3
MIN_DOCS = 3
MIN_TOKENS = 3
SIMILAR = 0.7
UNRELATED = 0.3
#: Hashes kept of a whole text and of the part looked for in others; share found from which texts are related.
WHOLE, PROBE, RELATED = 256, 32, 0.5
#: Hashes of a long text that are put in order at first.
_HEAD = 2_048
#: Lines for which a task remembers texts, to send on only unrelated ones.
REMEMBERED = 50_000
#: Hashes up to which a set of lines is broadcast (16 MB); a larger one is joined by shuffling.
BROADCAST_ROWS = 2_000_000
_VARIABLE, _DIGIT = re.compile(r"(?<!\S)[^\s\d]*+\d\S*+"), re.compile(r"\d")


def has_digit(line: str) -> bool:
    for d in "0123456789":
        if d in line:
            return True
    try:
        line.encode("latin-1")  # has no other digits
    except UnicodeEncodeError:
        return _DIGIT.search(line) is not None
    return False


def masked(line: str) -> str:
    """The line with single spaces, its tokens with digits as wildcards."""
    if not line.isprintable() or "  " in line or line[:1] == " " or line[-1:] == " ":  # white space but for a space isn't printable
        line = " ".join(line.split())
    return _VARIABLE.sub("<*>", line) if has_digit(line) else line


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line) - (1 << 63)


def parse(line: str) -> tuple[int, int, str] | None:
    """(hash, leaf of the tree, masked line); None for lines of too few tokens."""
    line = masked(line)
    n = line.count(" ") + 1
    if n < MIN_TOKENS or not line:
        return None
    return line_hash(line), line_hash(f"{n} " + " ".join(line.split(" ", DEPTH)[:DEPTH])), line


def sketches(text: str) -> np.ndarray:
    """For each line, a one-hash MinHash of the runs of eight bytes of all the other lines.

    The line itself is left out, else one with a small hash would make all
    documents that hold it look alike.  A single line has 0.
    """
    data = text.encode() + b"\n"
    size = len(data)
    grams = np.ndarray((size,), np.uint64, data + b"\0" * 8, strides=(1,))
    mixed = grams * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    for back in range(7):  # runs that reach over the end of a line are not of it
        mixed[np.maximum(ends - back, 0)] = np.uint64(0xFFFFFFFFFFFFFFFF)
    if len(ends) == 1:
        return np.zeros(1, np.int64)
    least = np.minimum.reduceat(mixed, np.concatenate([[0], ends[:-1] + 1]))
    none = np.array([0xFFFFFFFFFFFFFFFF], np.uint64)
    before = np.concatenate([none, np.minimum.accumulate(least)[:-1]])
    after = np.concatenate([np.minimum.accumulate(least[::-1])[::-1][1:], none])
    return np.minimum(before, after).astype(np.int64)


def key(line: str) -> int | None:
    """The hash that ``parse`` gives."""
    line = masked(line)
    return line_hash(line) if line.count(" ") + 1 >= MIN_TOKENS else None


class Lines:
    """A set of line hashes, 8 bytes each, with a flag for each."""

    def __init__(self, hashes: np.ndarray, flags: np.ndarray | None = None):
        hashes = np.asarray(hashes, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.flags = np.ones(len(order), bool) if flags is None else np.asarray(flags, bool)[order]

    def find(self, keys: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the set, and which of them are flagged; None is in none."""
        if not len(self.hashes):
            return np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        known = np.array([k is not None for k in keys], bool)
        wanted = np.array([0 if k is None else k for k in keys], np.int64)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        found = known & (self.hashes[at] == wanted)
        return found, found & self.flags[at]


class Portrait:
    """The least hashes of the runs of 16 bytes in a text, with the lines they stand in.

    ``whole`` has the least of all, ``own`` those of lines that aren't shared;
    ``probe(i)`` is what another text must hold to be related, where line
    ``i`` is in question.
    """

    def __init__(self, text: str, shared: np.ndarray, short: np.ndarray):
        data = text.encode() + b"\n"
        size = len(data)
        grams = np.ndarray((size + 8,), np.uint64, data + b"\0" * 16, strides=(1,))
        mixed = grams * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        after = mixed[8:] * np.uint64(0x94D049BB133111EB)
        mixed = mixed[:-8]
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= after
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        widths = np.diff(ends, prepend=-1)
        runs = np.maximum(widths - 16, 0)  # runs that reach over the end of a line are not of it
        self.n_lines = len(ends)
        mixed &= np.uint64(0xFFFFFFFF00000000)
        mixed |= np.repeat(np.arange(self.n_lines, dtype=np.uint64), widths)
        if self.n_lines > 1 or widths[0] > 16:
            inside = np.repeat(np.tile([True, False], self.n_lines), np.stack([runs, widths - runs], axis=1).ravel())
            mixed = mixed[inside]
        else:
            mixed = mixed[:0]
        self.sorted, self.all = mixed, False
        if len(mixed) > 8 * _HEAD:  # most hashes are never looked at
            few = mixed[mixed < np.uint64(2 * _HEAD * (1 << 64) // len(mixed))]
            self.sorted = few
        else:
            self.all = True
        self.rest = mixed
        self.sorted.sort()
        self.whole = self.least(None, WHOLE)
        free = ~(np.asarray(shared, bool) | np.asarray(short, bool))
        self.own = self.least(free, PROBE) if free.any() else np.zeros(0, np.uint32)

    def least(self, lines: np.ndarray | None, n: int) -> np.ndarray:
        """The ``n`` least distinct hashes in those lines, in order."""
        upto = 4 * n
        while True:
            head = self.sorted[:upto]
            if lines is not None:
                head = head[lines[(head & np.uint64(0xFFFFFFFF)).astype(np.int64)]]
            head = (head >> np.uint64(32)).astype(np.uint32)
            fresh = np.ones(len(head), bool)
            np.not_equal(head[1:], head[:-1], out=fresh[1:])
            head = head[fresh][:n]
            if len(head) == n or (upto >= len(self.sorted) and self.all):
                return head
            if upto >= len(self.sorted):
                self.rest.sort()
                self.sorted, self.all = self.rest, True
            upto *= 8

    def probe(self, same: list[int]) -> np.ndarray:
        if len(self.own):
            return self.own
        others = np.ones(self.n_lines, bool)
        others[same] = False
        return self.least(others, PROBE)


def _found(probe: np.ndarray, whole: np.ndarray) -> float | None:
    """The share of ``probe`` in the text of ``whole``; None where the hashes kept don't tell."""
    if len(whole) == WHOLE:
        probe = probe[probe <= whole[-1]]
    if not len(probe) or not len(whole):
        return None if not len(probe) else 0.0
    at = np.minimum(np.searchsorted(whole, probe), len(whole) - 1)
    return float((whole[at] == probe).mean())


def related(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether texts, given as (probe, whole), are copies of one another as far as told by their probes."""
    if not len(a[0]) or not len(b[0]):  # nothing but the line in question
        return len(a[0]) == len(b[0])
    shares = [s for s in (_found(a[0], b[1]), _found(b[0], a[1])) if s is not None]
    return not shares or max(shares) >= RELATED


def join_unrelated(kept: list[tuple[np.ndarray, np.ndarray]], one: tuple[np.ndarray, np.ndarray]) -> bool:
    """Add a text to up to MIN_DOCS mutually unrelated ones; whether it was added."""
    if len(kept) >= MIN_DOCS or any(related(one, x) for x in kept):
        return False
    kept.append(one)
    return True


class Leaf:
    """The templates of a leaf, found by the parts of a line that must agree.

    A line may differ from a template in ``spare`` tokens.  So when the places
    behind the leading tokens are dealt into ``spare`` + 1 blocks, one block at
    least agrees as a whole: templates are filed under their tokens in each
    block (with the places of wildcards left out), and a line is compared only
    with those filed where one of its blocks leads.  The outcome is that of
    comparing it with all.
    """

    def __init__(self, n: int):
        self.n = n
        need = next(a for a in range(n + 1) if a / n >= SIMILAR)
        fixed = min(DEPTH, n)  # equal throughout the leaf
        spare = n - need
        self.all = spare >= n - fixed  # any line agrees with any template
        m = min(spare + 1, max(1, n - fixed))
        self.blocks = [list(range(fixed + i, n, m)) for i in range(m)] if not self.all else []
        self.block_of = {at: i for i, block in enumerate(self.blocks) for at in block}
        self.need, self.count = need, 0
        self.tokens = np.zeros((4, n), np.int32)
        self.roots: list[int] = []
        # for each block: places that are not wildcards -> their tokens -> templates
        self.filed: list[dict[tuple[int, ...], dict[tuple[int, ...], list[int]]]] = [{} for _ in self.blocks]

    def best(self, line: np.ndarray, own: list[int]) -> int:
        """The most similar template, the first of equals; -1 where none is similar enough."""
        if self.all:
            at = np.arange(self.count)
        else:
            near: set[int] = set()
            for filed in self.filed:
                for places, by in filed.items():
                    near.update(by.get(tuple([own[i] for i in places]), ()))
            at = np.array(sorted(near), np.int64)
        if not len(at):
            return -1
        held = self.tokens[at]
        agree = ((held == line) | (held == 0)).sum(1)
        i = int(agree.argmax())
        return int(at[i]) if agree[i] >= self.need else -1

    def file(self, i: int, blocks: list[int]) -> None:
        held = self.tokens[i].tolist()
        for b in blocks:
            places = tuple(at for at in self.blocks[b] if held[at])
            self.filed[b].setdefault(places, {}).setdefault(tuple([held[at] for at in places]), []).append(i)

    def add(self, root: int, line: np.ndarray) -> None:
        if self.count == len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
        self.tokens[self.count] = line
        self.roots.append(root)
        self.count += 1
        self.file(self.count - 1, list(range(len(self.blocks))))

    def widen(self, i: int, line: np.ndarray) -> None:
        """The tokens in which the template and ``line`` differ become wildcards."""
        differ = np.flatnonzero((self.tokens[i] != line) & (self.tokens[i] != 0))
        self.tokens[i, differ] = 0
        if not self.all and len(differ):
            self.file(i, sorted({self.block_of[at] for at in differ.tolist()}))


def merge_leaf(lines: list[tuple[int, str]]) -> dict[int, int]:
    """Line hash -> hash of the first line of its template, for the lines of one leaf.

    Lines come in the order of their text, so ties go to the template that
    was there first and the outcome doesn't depend on partitions.
    """
    out: dict[int, int] = {}
    numbers = {"<*>": 0}
    leaf: Leaf | None = None
    for h, text in sorted(lines, key=lambda x: (x[1], x[0])):
        own = [numbers.setdefault(t, len(numbers)) for t in text.split(" ")]
        line = np.array(own, np.int32)
        leaf = leaf or Leaf(len(own))
        at = leaf.best(line, own)
        if at >= 0:
            leaf.widen(at, line)
            out[h] = leaf.roots[at]
        else:
            leaf.add(h, line)
            out[h] = h
    return out


@lean
def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaf by leaf over rows sorted by leaf."""
    leaf, lines = None, []

    def done() -> pd.DataFrame:
        found = merge_leaf(lines)
        return pd.DataFrame({"line": np.array(list(found), np.int64), "template": np.array(list(found.values()), np.int64)})

    ready: list[pd.DataFrame] = []
    for pdf in batches:
        for f, h, text in zip(pdf["leaf"], pdf["line"], pdf["masked"]):
            if f != leaf:
                if lines:
                    ready.append(done())
                leaf, lines = f, []
            lines.append((h, text))
        if ready:
            yield pd.concat(ready)
            ready = []
    if lines:
        yield done()


@lean
def _parse_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        doc, lines, leaves, rest = [], [], [], []
        for i, text in enumerate(pdf["text"]):
            others = sketches(text)
            found = {p[0]: (p[1], r) for raw, r in zip(text.split("\n"), others) if (p := parse(raw))}
            lines += found.keys()
            leaves += [f[0] for f in found.values()]
            rest += [f[1] for f in found.values()]
            doc += [i] * len(found)
        at = np.array(doc, np.int64)
        yield pd.DataFrame({
            "k1": pdf["k1"].to_numpy()[at], "k2": pdf["k2"].to_numpy()[at], "sketch": np.array(rest, np.int64),
            "line": np.array(lines, np.int64), "leaf": np.array(leaves, np.int64),
        })


def _occurrences(docs: DataFrame, text_col: str) -> DataFrame:
    """k1, k2, sketch, line, leaf: the distinct lines of each distinct text."""
    text = F.col(quoted(text_col))
    k1, k2 = text_key(text)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text")).where("text <> ''")
    return rows.mapInPandas(_parse_texts, "k1 long, k2 long, sketch long, line long, leaf long").distinct()


def _line_texts(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """line, leaf, masked: the text of each of the lines ``wanted``."""
    shared = None
    if wanted.count() <= BROADCAST_ROWS:  # else all lines are sent to the join
        shared = docs.sparkSession.sparkContext.broadcast(Lines(wanted.select("line").toPandas()["line"].to_numpy()))

    @lean
    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[int, tuple[int, int, str]] = {}
            for text in pdf["text"]:
                parsed = [p for raw in text.split("\n") if (p := parse(raw))]
                if shared is not None and parsed:
                    held = shared.value.find([p[0] for p in parsed])[0]
                    parsed = [parsed[i] for i in np.flatnonzero(held)]
                for p in parsed:
                    found[p[0]] = p
            rows = list(found.values())
            yield pd.DataFrame({
                "line": np.array([r[0] for r in rows], np.int64), "leaf": np.array([r[1] for r in rows], np.int64), "masked": objects(r[2] for r in rows),
            })

    rows = docs.select(F.col(quoted(text_col)).alias("text")).where("text <> ''").mapInPandas(texts, "line long, leaf long, masked string")
    if shared is None:
        rows = rows.join(wanted.select("line"), "line", "left_semi")
    return rows.dropDuplicates(["line"])


def _recurring(support: DataFrame) -> Column:
    return (F.col("keys") >= MIN_DOCS) & (F.col("keys") >= UNRELATED * F.col("texts"))


def _portraits(docs: DataFrame, lines: DataFrame, text_col: str) -> DataFrame:
    """line, probe, whole: mutually unrelated texts (of a task) that hold one of ``lines``.

    ``lines``: line, open; all lines of templates with MIN_DOCS texts, and
    whether theirs isn't settled yet.
    """
    text = F.col(quoted(text_col))
    k1, k2 = text_key(text)
    rows = docs.where(text != "").select(k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    shared = None
    if lines.count() <= BROADCAST_ROWS:
        pdf = lines.toPandas()
        shared = docs.sparkSession.sparkContext.broadcast(Lines(pdf["line"].to_numpy(), pdf["open"].to_numpy()))
    else:
        held = _occurrences(docs, text_col).join(lines, "line").groupBy("k1", "k2").agg(F.collect_list("line").alias("lines"), F.collect_list("open").alias("opens"))
        rows = rows.dropDuplicates(["k1", "k2"]).join(held, ["k1", "k2"])

    @lean
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for pdf in batches:
            line, probe, whole = [], [], []
            for i, text in enumerate(pdf["text"]):
                own = shared.value if shared is not None else Lines(pdf["lines"].iloc[i], pdf["opens"].iloc[i])
                parsed = [key(raw) for raw in text.split("\n")]
                held, unsettled = own.find(parsed)
                places: dict[int, list[int]] = {}
                for at in np.flatnonzero(unsettled).tolist():
                    places.setdefault(parsed[at], []).append(at)
                todo = [h for h in places if len(seen.get(h, ())) < MIN_DOCS]
                if not todo:
                    continue
                portrait = Portrait(text, held, np.array([h is None for h in parsed], bool))
                for h in todo:
                    one = (portrait.probe(places[h]), portrait.whole)
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    if join_unrelated(seen.setdefault(h, []), one):
                        line.append(h), probe.append(one[0].view(np.int32)), whole.append(one[1].view(np.int32))
                if len(line) >= 1_000:  # a row is about a kilobyte
                    yield frame(line, probe, whole)
                    line, probe, whole = [], [], []
            yield frame(line, probe, whole)

    def frame(line: list[int], probe: list[np.ndarray], whole: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"line": np.array(line, np.int64), "probe": objects(probe), "whole": objects(whole)})

    return rows.mapInPandas(draw, "line long, probe array<int>, whole array<int>")


@lean
def _unrelated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The templates with MIN_DOCS unrelated texts, over rows sorted by template."""
    template, kept = None, []
    for pdf in batches:
        out = []
        for t, probe, whole in zip(pdf["template"], pdf["probe"], pdf["whole"]):
            if t != template:
                template, kept = t, []
            if join_unrelated(kept, (np.array(probe, np.int32).view(np.uint32), np.array(whole, np.int32).view(np.uint32))) and len(kept) == MIN_DOCS:
                out.append(t)
        yield pd.DataFrame({"template": np.array(out, np.int64)})


def boilerplate(docs: DataFrame, occurrences: DataFrame, text_col: str = "text") -> DataFrame:
    """line: hashes of the masked lines whose template recurs."""
    by_sketch = materialize(occurrences.groupBy("line", "leaf", "sketch").agg(F.count(F.lit(1)).alias("texts")))
    lines = by_sketch.groupBy("line", "leaf").agg(F.sum("texts").alias("texts"))
    leaves = lines.groupBy("leaf").agg(F.sum("texts").alias("texts"), F.count(F.lit(1)).alias("lines"))
    shared = leaves.where((F.col("texts") >= MIN_DOCS) & (F.col("lines") > 1)).select("leaf")
    mixed = materialize(lines.join(shared, "leaf", "left_semi").select("line", "leaf"))
    texts = _line_texts(docs, mixed, text_col)
    merged = texts.repartition("leaf").sortWithinPartitions("leaf", "line").mapInPandas(_merge, "line long, template long")
    merged = materialize(merged)
    support = (
        by_sketch.join(merged, "line", "left")
        .groupBy(F.coalesce("template", "line").alias("template"), "sketch").agg(F.sum("texts").alias("texts"))
        .groupBy("template").agg(F.sum("texts").alias("texts"), F.count(F.lit(1)).alias("keys"))
    )
    many = support.where(F.col("texts") >= MIN_DOCS).select("template", (~_recurring(support)).alias("open"))
    members = by_sketch.select("line").distinct().join(merged, "line", "left").select("line", F.coalesce("template", "line").alias("template"))
    members = materialize(members.join(many, "template"))
    portraits = _portraits(docs, members.select("line", "open"), text_col).join(members.where("open").select("line", "template"), "line")
    found = portraits.select("template", "probe", "whole").repartition("template").sortWithinPartitions("template", "probe", "whole")
    more = found.mapInPandas(_unrelated, "template long")
    bad = members.where("NOT open").select("template").union(more).distinct()
    return members.join(bad, "template", "left_semi").select("line")


_CUT = "text string, at array<int>"


def _cut_all(rows: list[tuple[str | None, Lines | None]]) -> pd.DataFrame:
    """Texts without their bad lines (null where nothing changed) and the positions of those."""
    texts, places = [], []
    for text, bad in rows:
        at: list[int] = []
        if text and bad is not None and len(bad.hashes):
            lines = text.split("\n")
            at = np.flatnonzero(bad.find([key(raw) for raw in lines])[0]).tolist()
            gone = set(at)
            text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        texts.append(text if at else None)
        places.append(np.array(at, np.int32))
    return pd.DataFrame({"text": objects(texts), "at": objects(places)})


def dedup_lines(docs: DataFrame, text_col: str = "text", dropped: str | None = "dropped_lines") -> DataFrame:
    """``docs`` without the lines of recurring templates.

    Adds ``dropped`` (unless None): positions of the dropped lines, from 0.  Null texts
    stay null, empty ones empty; lines under ``MIN_TOKENS`` tokens and blank
    lines are never dropped; repeated rows are cleaned alike; ``n_chars`` is
    set anew where the text changed; a column named like ``dropped`` is
    replaced, all others are untouched.  No rows give none.
    """
    small_batches(docs.sparkSession)
    occurrences = _occurrences(docs, text_col)
    bad = materialize(boilerplate(docs, occurrences, text_col))
    text = F.col(quoted(text_col))
    (tmp,) = fresh(docs, "lines")
    if bad.count() <= BROADCAST_ROWS:
        shared = docs.sparkSession.sparkContext.broadcast(Lines(bad.toPandas()["line"].to_numpy()))

        @lean
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield _cut_all([(t, shared.value) for t in texts])

        cleaned = docs.withColumn(tmp, F.pandas_udf(cut, _CUT)(text))
    else:
        a, b, n1, n2, lines = fresh(docs, "k1", "k2", "h1", "h2", "bad")
        k1, k2 = text_key(text)
        hits = occurrences.join(bad, "line", "left_semi").groupBy("k1", "k2").agg(F.collect_set("line").alias("bad"))
        hits = hits.select(F.col("k1").alias(n1), F.col("k2").alias(n2), F.col("bad").alias(lines))

        @lean
        def cut_own(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for texts, own in batches:
                yield _cut_all([(t, Lines(x) if x is not None else None) for t, x in zip(texts, own)])

        joined = docs.withColumns({a: k1, b: k2}).join(hits, (F.col(a) == F.col(n1)) & (F.col(b) == F.col(n2)), "left")
        cleaned = joined.withColumn(tmp, F.pandas_udf(cut_own, _CUT)(F.when(F.col(lines).isNotNull(), text), F.col(lines)))
    hit = F.col(tmp)
    out = []
    for c in docs.columns:
        if dropped and c.lower() == dropped.lower():  # replaced
            continue
        if c == text_col:
            out.append(F.coalesce(hit["text"], text).alias(c))
        elif c == "n_chars" and text_col == "text":
            out.append(F.when(hit["text"].isNotNull(), F.length(hit["text"]).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(quoted(c)))
    if dropped:
        out.append(hit["at"].alias(dropped))
    return cleaned.select(*out)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, dropped_lines of every document."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
