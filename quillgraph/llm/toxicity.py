"""Toxicity by noisy-channel deobfuscation.

A word such as ``1d10t``, ``s t u p i d`` or ``looooser`` is read as a lattice:
each written character may stand for several letters (leetspeak), for nothing
(spacing) or for a repetition of its neighbour.  Viterbi decoding picks the
letters that a character trigram model, counted over the whole corpus, finds
most likely; the restored words are then scored with a lexicon of words,
word stems and stems that recur in a text, learned from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean, materialize, objects, others, quoted, small_batches

#: Letters that the language model knows; everything else ends a word.
ALPHABET = " abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
N_SYMBOLS = 64
_INDEX = {c: i for i, c in enumerate(ALPHABET)}

#: What a written character may stand for besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "x": "xc", "v": "vu", "z": "zs",
}
#: Characters put between letters that may stand for nothing.
SEPARATORS = " .-_*~/\\,'`^:;#=​‌‍­"
_LOG_SUB, _LOG_DROP, _LOG_REPEAT = math.log(0.1), math.log(0.3), math.log(0.25)
_STRIP = ".,;:!?\"'()[]{}<>|%&*#=~`^…“”«»¿¡-_/\\"
#: Numbers of different words with a stem from which it weighs more.
RECURRENCES = (2, 3, 4)
#: Feature rows that a worker of the training sample sends on at a time.
_SLICE = 20_000
#: Tokens whose outcome is kept: the first ones, among them all that are frequent.
_CACHE_LIMIT = 200_000


@dataclass(frozen=True)
class ToxicityModel:
    """trigram: log-probabilities of the character model; weights: log-odds of
    words (``=word``), stems (``stem*``) and stems of at least k different words
    of a text (``stem*k``); threshold on a document's score."""

    trigram: np.ndarray
    weights: dict[str, float]
    threshold: float


def _codes_table() -> np.ndarray:
    table = np.zeros(0x250, np.uint8)
    for ch, i in _INDEX.items():
        table[ord(ch)] = i
        up = ch.upper()
        if len(up) == 1 and ord(up) < len(table):
            table[ord(up)] = i
    return table


@lean
def _count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = _codes_table()
    total = np.zeros(N_SYMBOLS**3, np.int64)
    for pdf in batches:
        for text in pdf.iloc[:, 0]:
            if not text:
                continue
            points = np.frombuffer(("  " + text + " ").encode("utf-32-le"), np.uint32)
            codes = table[np.where(points < len(table), points, 0)].astype(np.int32)
            keep = np.ones(len(codes), bool)
            keep[2:] = (codes[2:] > 0) | (codes[1:-1] > 0) | (codes[:-2] > 0)
            codes = codes[keep]
            grams = (codes[:-2] * N_SYMBOLS + codes[1:-1]) * N_SYMBOLS + codes[2:]
            if len(grams) > 50_000:
                total += np.bincount(grams, minlength=len(total))
            else:
                np.add.at(total, grams, 1)
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"gram": seen.astype(np.int32), "n": total[seen]})


def train_char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Character trigram log-probabilities from every text of ``docs``.

    Counts are added per partition and merged by key, so what reaches the
    driver is bounded by the alphabet (64^3 counts), not by the corpus.
    Null and empty texts add nothing; on an empty table all letters are
    equally likely.
    """
    counts = (
        docs.select(F.col(quoted(text_col)).alias("text"))
        .where(F.col("text").isNotNull())
        .mapInPandas(_count_trigrams, "gram int, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    tri = np.zeros(N_SYMBOLS**3)
    if len(counts):
        tri[counts["gram"].to_numpy()] = counts["n"].to_numpy()
    tri = tri.reshape(N_SYMBOLS, N_SYMBOLS, N_SYMBOLS)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    size = len(ALPHABET)
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * size)
    p2 = (bi + 4 * p1[None, :]) / (bi.sum(1, keepdims=True) + 4)
    p3 = (tri + 4 * p2[None, :, :]) / (tri.sum(2, keepdims=True) + 4)
    return np.log(np.maximum(p3, 1e-12)).astype(np.float32)


def features(word: str) -> list[str]:
    """A word and its stems of 4 to 7 letters."""
    return ["=" + word] + [word[:n] + "*" for n in (4, 5, 6, 7) if len(word) > n]


def stems(word: str) -> list[str]:
    """The beginnings of a word that count where they recur in a text."""
    return [word[:n] for n in range(3, 9) if len(word) > n]


def plain_words(text: str) -> set[str]:
    return {w.strip(_STRIP) for w in text.lower().split()}


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> DataFrame:
    """text, toxic of a bounded sample of labelled documents.

    ``max_rows`` bounds the labelled rows (the first by a hash of the id, half
    of them toxic where there are enough); texts that repeat count once.
    Documents without label, null labels and null texts are left out.
    """
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    half = max_rows // 2
    picked = (
        lab.where("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(half)
        .unionByName(lab.where("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(half))
    )
    ids = picked.toPandas()
    spark = docs.sparkSession
    small = spark.createDataFrame(list(zip(map(str, ids["doc_id"]), map(int, ids["toxic"]))), "doc_id string, toxic int")
    return (
        docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text"))
        .where(F.col("text").isNotNull())
        .join(F.broadcast(small), "doc_id")  # at most max_rows rows
        .groupBy("text").agg(F.max("toxic").alias("toxic"))
    )


def train_lexicon(
    sample: DataFrame, min_docs: int = 4, min_share: float = 0.01, min_odds: float = 3.5, min_words: int = 8
) -> dict[str, float]:
    """Weights of words and stems from the labelled sample.

    A feature counts when at least ``min_docs`` and a share of ``min_share``
    of the toxic documents hold it and its log-odds reach ``min_odds``; a
    stem also needs ``min_words`` different toxic words behind it, so that
    one frequent word does not turn all words that begin like it into
    offences.  A word with a recurring stem counts by its recurrence alone:
    one of them is in many a harmless text.  With no toxic example the
    lexicon is empty.
    """
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}  # two rows
    n_bad, n_good = n.get(1, 0), n.get(0, 0)
    least = max(min_docs, min_share * n_bad)
    rows = sample.where("toxic = 1").select("text").mapInPandas(_toxic_features, "feature string, word string")
    counted = (
        rows.groupBy("feature")
        .agg(F.count(F.lit(1)).alias("bad"), F.countDistinct("word").alias("words"))
        .where(F.col("feature").startswith("=") | (F.col("words") >= min_words))
        .where(F.col("bad") >= least)
        .select("feature", "bad").toPandas()
    )  # each is in a share min_share of the toxic documents, so there are at most 1 / min_share times a document's features
    shared = sample.sparkSession.sparkContext.broadcast(frozenset(counted["feature"]))

    @lean
    def of_harmless(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times: dict[str, int] = {}
        for pdf in batches:
            for text in pdf["text"]:
                for f in document_features(text).keys() & shared.value:
                    times[f] = times.get(f, 0) + 1
        yield pd.DataFrame({"feature": objects(times.keys()), "good": np.array(list(times.values()), np.int64)})

    harmless = sample.where("toxic = 0").select("text").mapInPandas(of_harmless, "feature string, good long")
    seen = dict(harmless.groupBy("feature").agg(F.sum("good").alias("good")).toPandas().itertuples(index=False))
    weights: dict[str, float] = {}
    for f, bad in zip(counted["feature"], counted["bad"]):
        if bad <= 8 * (good := int(seen.get(f, 0))):
            continue
        odds = math.log((bad + 0.5) / (n_bad + 1)) - math.log((good + 0.5) / (n_good + 1))
        if odds >= min_odds and f.strip("=*234"):
            weights[f] = round(odds, 6)
    recurring = {f.partition("*")[0] for f in weights if f[0] != "=" and f[-1] != "*"}
    return {f: w for f, w in weights.items() if f[0] != "=" or recurring.isdisjoint(stems(f[1:]))}


def best_threshold(scores: pd.DataFrame) -> float:
    """The score, midway between two seen ones, with the best F1 (the lowest of equals)."""
    s = scores.sort_values("score", ascending=False, kind="stable")
    bad, hits, best, at = int((s["toxic"] == 1).sum()), 0, -1.0, math.inf
    values, toxic = s["score"].to_numpy(), s["toxic"].to_numpy()
    for i, (v, t) in enumerate(zip(values, toxic), 1):
        hits += int(t == 1)
        below = values[i] if i < len(values) else 0.0
        if v > 0 and below < v and (f1 := 2 * hits / max(1, bad + i)) >= best:
            best, at = f1, float((v + below) / 2)
    return at


def document_features(text: str) -> dict[str, str]:
    """The features of a text, each with one of the words that it was found in."""
    words = [w for w in plain_words(text) if len(w) >= 3]
    found = {f: w for w in words for f in features(w)}
    times: dict[str, int] = {}
    for w in words:
        for s in stems(w):
            times[s] = n = times.get(s, 0) + 1
            if n in RECURRENCES:
                found[f"{s}*{n}"] = w
    return found


@lean
def _toxic_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """feature, word of each text, sent on in slices so that a batch of long texts is never held as a whole."""
    feature: list[str] = []
    word: list[str] = []
    for pdf in batches:
        for text in pdf["text"]:
            found = document_features(text)
            feature += found.keys()
            word += found.values()
            if len(feature) >= _SLICE:
                yield pd.DataFrame({"feature": objects(feature), "word": objects(word)})
                feature, word = [], []
    yield pd.DataFrame({"feature": objects(feature), "word": objects(word)})


def readings(ch: str) -> str:
    """The letters that a written character may stand for, itself first."""
    return "".join(dict.fromkeys((ch if ch in _INDEX and ch != " " else "") + LEET.get(ch, "")))


def decode(written: str, trigram: np.ndarray) -> str:
    """The most likely letters behind ``written`` (Viterbi over the lattice).

    State: the last two letters and the last written character's reading.
    Ties go to the reading listed first.
    """
    # beam of states: (letter before last, last letter) -> (score, (letters before, letter))
    beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for ch in written:
        options = [(c, _INDEX[c], 0.0 if c == ch else _LOG_SUB) for c in readings(ch)]
        drop = not options or ch in SEPARATORS or ch in _STRIP
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, out) in beam.items():
            for c, i, cost in options:
                s = score + cost + float(trigram[a, b, i])
                if (b, i) not in nxt or s > nxt[b, i][0]:
                    nxt[b, i] = (s, (out, c))
                if i == b:  # a repetition of the letter before
                    s = score + cost + _LOG_REPEAT
                    if (a, b) not in nxt or s > nxt[a, b][0]:
                        nxt[a, b] = (s, out)
            if drop:
                s = score + _LOG_DROP
                if (a, b) not in nxt or s > nxt[a, b][0]:
                    nxt[a, b] = (s, out)
        beam = nxt
    path = max(((s + float(trigram[a, b, 0]), i, out) for i, ((a, b), (s, out)) in enumerate(beam.items())), key=lambda x: (x[0], -x[1]))[2]
    letters = []
    while path:
        path, c = path
        letters.append(c)
    return "".join(reversed(letters))


def squeeze(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def shortened(written: str) -> str:
    """``written`` with runs of one character of at most three, which read alike, and separators not repeated."""
    return re.sub(r"(.)\1{3,}", r"\1\1\1", written)


class Reach:
    """Which written characters can be read as a lexicon entry.

    A tree of the entries without repetitions; a character leads on by each
    of its readings, and stays where it may stand for nothing or repeat.
    Readings that don't lead to an entry end early, so long tokens and texts
    cost little, and whatever the decoder could restore to an entry is let through.
    """

    def __init__(self, entries: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.letter = [""]
        self.word: set[int] = set()
        self.stem: set[int] = set()
        for f in entries:
            is_word = f[0] == "="
            at = 0
            for c in squeeze(f[1:] if is_word else f.partition("*")[0]):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.letter.append(c)
                at = self.next[at][c]
            (self.word if is_word else self.stem).add(at)
        self.cache: dict[str, tuple[str, bool]] = {}

    def step(self, states: set[int], written: str) -> tuple[set[int], bool]:
        """The places after ``written``, and whether a stem was passed."""
        passed = False
        for ch in written:
            got = self.cache.get(ch)
            if got is None:
                letters = readings(ch)
                got = self.cache[ch] = (letters, not letters or ch in SEPARATORS or ch in _STRIP)
            letters, drop = got
            new = set(states) if drop else set()
            for at in states:
                for c in letters:
                    if c in self.next[at]:
                        new.add(self.next[at][c])
                    if c == self.letter[at]:
                        new.add(at)
            states = new
            if not states:
                break
            passed = passed or not states.isdisjoint(self.stem)
        return states, passed


class Scorer:
    """Scores texts; keeps the scores of words seen before."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.squeezed = {("=" + squeeze(f[1:]) if f[0] == "=" else squeeze(f[:-1]) + "*"): w for f, w in model.weights.items()}
        self.recurring: dict[str, dict[int, float]] = {}
        for f, w in model.weights.items():
            stem, star, k = f.partition("*")
            if star and k and f[0] != "=":
                self.recurring.setdefault(stem, {})[int(k)] = w
        self.known: dict[str, tuple[float, str, tuple[str, ...]] | None] = {}
        self.reach = Reach(list(model.weights))
        self.longest = 2 * max(map(len, model.weights), default=0)
        self.starts: dict[str, bool] = {}

    def weight(self, word: str) -> float:
        return max((self.model.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def restored_weight(self, word: str) -> float:
        """Also against the lexicon with repetitions squeezed on both sides."""
        return max(self.weight(word), max((self.squeezed.get(f, 0.0) for f in features(squeeze(word))), default=0.0))

    def look(self, token: str) -> tuple[float, str, tuple[str, ...]] | None:
        """(weight, word, its stems that may recur); None for a harmless token."""
        word = token.strip(_STRIP)
        own = tuple(s for s in stems(word) if s in self.recurring) if len(word) >= 3 else ()
        w = self.weight(word) if len(word) >= 3 else 0.0
        if w or own:
            return w, word, own
        core = token.rstrip(".,;:!?%&\"')]}").lstrip("\"'([{<.,;:%&*#")
        if len(core) < 3:
            return None
        ends, passed = self.reach.step({0}, core)
        if not passed and ends.isdisjoint(self.reach.word):
            return None
        restored = decode(shortened(core), self.model.trigram)
        w = self.restored_weight(restored) if len(restored) >= 3 else 0.0
        own = tuple(s for s in stems(restored) if s in self.recurring)
        return (w, restored, own) if w or own else None

    def split_words(self, tokens: list[str]) -> Iterator[tuple[str, float]]:
        """Offending words that are spelled over several tokens, wherever they begin, and their weights.

        One pass: each place in the tree of entries goes with the latest token from which it is reached.
        """
        starts, reach = self.starts, self.reach
        places: dict[int, int] = {}
        for j, token in enumerate(tokens):
            try:
                begins = starts[token]
            except KeyError:
                begins = tuple(reach.step({0}, token)[0] - {0})
                if len(starts) < _CACHE_LIMIT:
                    starts[token] = begins
            if not places and not begins:
                continue
            now: dict[int, int] = {}
            for at, start in places.items():
                for to in reach.step({at}, token)[0]:
                    now[to] = max(start, now.get(to, -1))
            for at, start in now.items():
                if at in places:  # told before
                    continue
                if at in reach.word and (hit := self.joined(tokens[start : j + 1])):
                    yield hit
                if at in reach.stem and all(len(t) == 1 for t in tokens[start : j + 1]):
                    # on to the last single letter, or until there are more letters than any stem has, repetitions aside
                    end, more = j + 1, 0
                    while end < len(tokens) and len(tokens[end]) == 1 and more < self.longest:
                        more += tokens[end] != tokens[end - 1]
                        end += 1
                    if hit := self.joined(tokens[start:end]):
                        yield hit
            for at in begins:
                now[at] = j
            places = now

    def joined(self, pieces: list[str]) -> tuple[str, float] | None:
        restored = decode(shortened("".join(pieces)), self.model.trigram)
        w = self.restored_weight(restored) if len(restored) >= 3 else 0.0
        return (restored, w) if w else None

    def score(self, text: str | None) -> tuple[float, list[str]]:
        """The sum of the weights of the distinct offending words and of the heaviest recurring stem, and the words."""
        if not text or not self.model.weights:
            return 0.0, []
        found: dict[str, float] = {}
        groups: dict[str, set[str]] = {}
        low = text.lower()
        known = self.known
        tokens = low.split()
        for token in set(tokens):
            try:
                hit = known[token]
            except KeyError:
                hit = self.look(token)
                if len(known) < _CACHE_LIMIT:
                    known[token] = hit
            if hit:
                if hit[0]:
                    found[hit[1]] = hit[0]
                for s in hit[2]:
                    groups.setdefault(s, set()).add(hit[1])
        for word, w in self.split_words(tokens):
            found[word] = w
        best, stem = max(((max((w for k, w in self.recurring[s].items() if k <= len(ws)), default=0.0), s) for s, ws in groups.items()), default=(0.0, ""))
        return round(sum(found.values()) + best, 6), sorted(set(found) | (groups[stem] if best else set()))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, **options: float) -> ToxicityModel:
    """The character model from all of ``docs``; lexicon and threshold from the labelled sample."""
    small_batches(docs.sparkSession)
    sample = materialize(labelled_sample(docs, labels, max_rows))
    model = ToxicityModel(train_char_model(docs), train_lexicon(sample, **options), math.inf)
    scores = score_documents(sample, model).select("toxic", F.col("toxicity").alias("score")).toPandas()  # at most max_rows rows
    return replace(model, threshold=best_threshold(scores))


def score_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: tuple[str, str, str] = ("toxicity", "restored", "is_toxic")) -> DataFrame:
    """``docs`` with a score, the restored offending words and the decision.

    Null and empty texts score 0 and are not toxic; texts are read whole;
    repeated rows get equal scores; columns named like an output are replaced, all
    others are untouched.  No rows give none.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 64^3 floats and the lexicon

    @F.pandas_udf("score double, words array<string>")
    @lean
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            rows = [scorer.score(t) for t in texts]
            yield pd.DataFrame({"score": [r[0] for r in rows], "words": [r[1] for r in rows]})

    (tmp,) = fresh(docs, "toxicity")
    df = docs.withColumn(tmp, scored(F.col(quoted(text_col))))
    hit = F.col(tmp)
    return df.select(
        *others(docs, *out),
        hit["score"].alias(out[0]),
        hit["words"].alias(out[1]),
        (hit["score"] >= F.lit(model.threshold)).alias(out[2]),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, all columns kept.

    Null and empty texts stay; equal texts share their fate; without labels
    nothing is toxic; an empty table stays empty.
    """
    a, b, c = fresh(docs, "tox_score", "tox_words", "tox_flag")
    scored = score_documents(docs, train(docs, labels), out=(a, b, c))
    return scored.where(~F.col(c)).select(*[F.col(quoted(x)) for x in docs.columns])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, toxicity, restored, is_toxic of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels)
    return score_documents(docs.select("doc_id", "text"), model).select("doc_id", "toxicity", "restored", "is_toxic")
