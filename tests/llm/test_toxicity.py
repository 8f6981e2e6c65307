import itertools
import math

import numpy as np
import pytest

from quillgraph.llm import toxicity as tx


def uniform():
    return np.full((tx.N_SYMBOLS,) * 3, math.log(1 / len(tx.ALPHABET)), np.float32)


def random_model(seed=0):
    rng = np.random.default_rng(seed)
    p = rng.random((tx.N_SYMBOLS,) * 3)
    return np.log(p / p.sum(2, keepdims=True)).astype(np.float32)


def best_reading(written, trigram):
    """The best score over all readings of each character, one by one."""
    choices = []
    for ch in written:
        letters = list(dict.fromkeys((ch if ch in tx._INDEX and ch != " " else "") + tx.LEET.get(ch, "")))
        mine = [("letter", c, 0.0 if c == ch else tx._LOG_SUB) for c in letters] + [("repeat", c, 0.0 if c == ch else tx._LOG_SUB) for c in letters]
        if ch in tx.SEPARATORS or ch in tx._STRIP or not letters:
            mine.append(("drop", "", tx._LOG_DROP))
        choices.append(mine)
    best = -math.inf
    for path in itertools.product(*choices):
        a, b, s = 0, 0, 0.0
        for kind, c, cost in path:
            s += cost
            if kind == "letter":
                i = tx._INDEX[c]
                s += float(trigram[a, b, i])
                a, b = b, i
            elif kind == "repeat":
                if tx._INDEX[c] != b:
                    break
                s += tx._LOG_REPEAT
        else:
            best = max(best, s + float(trigram[a, b, 0]))
    return best


@pytest.mark.parametrize("written", ["1d10t", "aab", "s.t-u", "l00ser", "b@@d", "v1x3n", "a  b"])
def test_viterbi_is_as_good_as_any_reading(written):
    trigram = random_model()
    out = tx.decode(written, trigram)
    assert best_reading(written, trigram) == pytest.approx(path_score(written, out, trigram), abs=1e-4)


def path_score(written, out, trigram):
    """The best score of readings that give ``out``."""
    beam = {(0, 0, 0): 0.0}  # letters of out read, last two letters
    for ch in written:
        nxt = {}
        letters = list(dict.fromkeys((ch if ch in tx._INDEX and ch != " " else "") + tx.LEET.get(ch, "")))
        for (n, a, b), s in beam.items():
            for c in letters:
                cost, i = (0.0 if c == ch else tx._LOG_SUB), tx._INDEX[c]
                if n < len(out) and out[n] == c:
                    k = (n + 1, b, i)
                    nxt[k] = max(nxt.get(k, -math.inf), s + cost + float(trigram[a, b, i]))
                if i == b:
                    nxt[n, a, b] = max(nxt.get((n, a, b), -math.inf), s + cost + tx._LOG_REPEAT)
            if ch in tx.SEPARATORS or ch in tx._STRIP or not letters:
                nxt[n, a, b] = max(nxt.get((n, a, b), -math.inf), s + tx._LOG_DROP)
        beam = nxt
    return max(s + float(trigram[a, b, 0]) for (n, a, b), s in beam.items() if n == len(out))


def test_trigrams_are_those_of_the_whole_corpus(spark):
    df = spark.createDataFrame([("abc",), ("abd",), (None,), ("",), ("a" * 200_000,)], "text string").repartition(3)
    model = tx.train_char_model(df)
    a, b, c, d, e = (tx._INDEX[x] for x in "abcde")
    assert model[a, b, c] == model[a, b, d] > model[a, b, e]
    assert model[a, a, a] > math.log(0.99)


@pytest.mark.xfail(reason="half of the labels of this size hold about 20 toxic documents in four languages: 15 of 21 are caught", strict=False)
def test_held_out_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    model = tx.train(docs, labels.where("pmod(xxhash64(doc_id), 2) = 0"))
    rest = labels.where("pmod(xxhash64(doc_id), 2) = 1")
    got = tx.score_documents(docs.join(rest, "doc_id"), model).select("toxic", "is_toxic").toPandas()
    hit = int(((got.toxic == 1) & got.is_toxic).sum())
    assert hit >= 0.9 * (got.toxic == 1).sum()
    assert int(((got.toxic == 0) & got.is_toxic).sum()) <= 0.02 * (got.toxic == 0).sum()


def test_held_out_documents_with_more_labels(spark, sf_small):
    larger = sf_small.replace("sf0.01", "sf0.1")
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    model = tx.train(docs, labels.where("pmod(xxhash64(doc_id), 2) = 0"))
    got = tx.score_documents(docs.join(labels.where("pmod(xxhash64(doc_id), 2) = 1"), "doc_id"), model).select("toxic", "is_toxic").toPandas()
    assert ((got.toxic == 1) & got.is_toxic).sum() >= 0.92 * (got.toxic == 1).sum()
    assert ((got.toxic == 0) & got.is_toxic).sum() <= 0.01 * (got.toxic == 0).sum()


def test_a_stem_weighs_when_it_recurs():
    scorer = tx.Scorer(tx.ToxicityModel(uniform(), {"grum*3": 5.0, "=dolt": 6.0}, 4.0))
    assert scorer.score("grumble and grumpy words")[0] == 0
    assert scorer.score("grumble grumpy grumly") == (5.0, ["grumble", "grumly", "grumpy"])
    assert scorer.score("grumble grumble grumble")[0] == 0
    assert scorer.score("a dolt, grumble grumpy grumly")[0] == 11.0


def test_obfuscated_words_are_restored(spark, sf_small):
    model = tx.train(spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet"))
    scorer = tx.Scorer(model)
    words = [f[1:] for f in model.weights if f[0] == "=" and f[1:].isalpha() and len(f) > 5][:20]
    assert words
    leet = str.maketrans({"a": "@", "e": "3", "i": "1", "o": "0", "s": "$"})
    found = 0
    forms = 0
    for w in words:
        for text in (w.translate(leet), " ".join(w), ".".join(w), "".join(c * 3 for c in w)):
            forms += 1
            found += scorer.score(f"hello {text} there")[0] > 0
    assert found >= 0.85 * forms, (found, forms)
    assert scorer.score("a quite harmless sentence, with 10 numbers & a.b.c.")[0] == 0


def test_odd_rows(spark, odd_docs, no_docs, odd_labels, no_labels):
    for labels in (odd_labels, no_labels):
        model = tx.train(odd_docs, labels)
        got = tx.score_documents(odd_docs, model)
        assert len(got.columns) == len({c.lower() for c in got.columns})
        rows = got.collect()
        assert len(rows) == odd_docs.count()
        assert all(r["toxicity"] == 0 and r["restored"] == [] and r["is_toxic"] is False for r in rows if not (r["text"] or "").strip())
        kept = tx.drop_toxic(odd_docs, labels)
        assert kept.schema.names == odd_docs.schema.names
    assert tx.drop_toxic(odd_docs, no_labels).count() == odd_docs.count()
    assert tx.drop_toxic(no_docs, odd_labels).count() == 0


def test_equal_rows_score_equal(spark):
    model = tx.ToxicityModel(uniform(), {"=dreadfool": 4.0}, 2.0)
    df = spark.createDataFrame([(1, "you dreadfool")] * 5 + [(2, "d r e a d f o o l")], "doc_id long, text string").repartition(4)
    assert {(r["toxicity"], r["is_toxic"]) for r in tx.score_documents(df, model).collect()} == {(4.0, True)}


LEXICON = {"=idiot": 5.0, "=loser": 5.0, "=stupid": 5.0}


def english():
    """A character model of a few sentences that hold the words of LEXICON."""
    total = np.zeros((tx.N_SYMBOLS,) * 3)
    codes = [0, 0, *(tx._INDEX[c] for c in "you are an idiot and a loser and so stupid that nobody is as stupid a loser or an idiot as you " * 20)]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        total[a, b, c] += 1
    return np.log((total + 0.01) / (total + 0.01).sum(2, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize(
    "written, word",
    [("1d107", "idiot"), ("1053r", "loser"), ("10$3r", "loser"), ("stuupid", "stupid"), ("iddiot", "idiot"), ("loozer", "loser"), ("i" * 90 + "diot", "idiot")],
)
def test_words_of_few_letters_and_single_changes_are_decoded(written, word):
    score, found = tx.Scorer(tx.ToxicityModel(english(), LEXICON, 4.0)).score(f"well {written} there")
    assert score == 5.0 and [tx.squeeze(w) for w in found] == [word]


@pytest.mark.parametrize("length", [49, 500, 50_000])
def test_tokens_of_any_length_are_decoded(length):
    scorer = tx.Scorer(tx.ToxicityModel(english(), LEXICON | {"grum*": 4.5, "blat*3": 4.0}, 4.0))
    assert scorer.score("s" * (length - 5) + "tupid")[0] == 5.0
    assert scorer.score("1d" + "-" * length + "10t")[0] == 5.0
    assert scorer.score("grum" + "xo" * (length // 2))[0] == 4.5  # plain
    assert scorer.score("gru.m" + "xo" * (length // 2))[0] == 4.5  # to be decoded
    assert scorer.score(" ".join("blat" + c * length for c in "xyz"))[0] == 4.0
    assert scorer.score(" ".join("i" * length + "diot"))[0] == 5.0
    assert scorer.score(" ".join("grum" + "xo" * (length // 2)))[0] == 4.5


@pytest.mark.parametrize(
    "written",
    ["y o u i d i o t", "a b c " * 100 + "i d i o t", "i  d \n i  o  t", "idi ot", "i - d - i - o - t", "1 d 1 0 t", "i d" + " -" * 200 + " i o t"],
)
def test_words_spelled_over_tokens_are_found(written):
    assert tx.Scorer(tx.ToxicityModel(english(), LEXICON, 4.0)).score(f"well {written} there") == (5.0, ["idiot"])


def test_words_that_go_on_are_not_joined():
    assert tx.Scorer(tx.ToxicityModel(english(), LEXICON, 4.0)).score("an idi otter, a lo serving, st up idle")[0] == 0
