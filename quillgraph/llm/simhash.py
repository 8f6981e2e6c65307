"""Near-duplicate documents: SimHash and a binary-trie self-join.

Every text gets a 128-bit SimHash of its set of words.  Two texts are near
duplicates when their fingerprints differ in at most ``BUDGET`` bits.  The
join is exact: fingerprints are cut into ``BLOCKS`` blocks, and of two within
the budget at least one block starts a rotation in which every run of blocks
from the start keeps within its share of the budget.  So for each block a
binary trie is built over the fingerprints rotated to begin there, and the
trie is joined with itself by walking pairs of nodes together: each step
down adds the bits in which the two paths differ, and a pair is left as soon
as it exceeds the budget of its depth.  Only connected groups are wanted, so
a pair of nodes is left as well when all of it is connected already; for a
family of near copies, comparing each with the next few in order sees to that.

Subtrees are the unit of distribution: a task holds one pair of subtrees of
one rotation.  Only edges of a spanning forest leave a task, so a group of
thousands of copies costs thousands of edges, not millions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, lean, materialize, quoted, small_batches, text_key

BITS = 128
BUDGET = 20
BLOCKS = 7
STARTS = [i * BITS // BLOCKS for i in range(BLOCKS)]
#: Fingerprints in a subtree; beyond it the trie is cut one bit deeper.
SUBTREE = 200_000
#: Node pairs walked, and fingerprint pairs compared, at a time; successors in order that are compared first.
_WALK, _COMPARE, _NEXT = 200_000, 500_000, 4
#: Words whose hashes are kept: the first ones, among them all that are frequent.
_CACHE_LIMIT = 200_000


# ---------------------------------------------------------------- fingerprints
class Fingerprinter:
    """SimHash of the set of lower-case words of a text.

    Words of at least four letters are used where there are any, so that
    function words do not pull unrelated texts together.  A text without
    words has the fingerprint 0.
    """

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        found = set(text.lower().replace(".", " ").replace(",", " ").split())
        return [w for w in found if len(w) > 3] or list(found)

    def __call__(self, text: str | None) -> tuple[int, int]:
        words = self.words(text) if text else []
        if not words:
            return 0, 0
        known, total = self.known, np.zeros(BITS, np.int64)
        for at in range(0, len(words), 65_536):
            digests = []
            for w in words[at : at + 65_536]:
                d = known.get(w)
                if d is None:
                    d = xxhash.xxh3_128_digest(w)
                    if len(known) < _CACHE_LIMIT:
                        known[w] = d
                digests.append(d)
            bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, BITS // 8), axis=1)
            total += bits.sum(0, dtype=np.int64)
        hi, lo = np.packbits(2 * total > len(words)).view(">i8")
        return int(hi), int(lo)


@lean
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    make = Fingerprinter()
    for texts in batches:
        found = np.array([make(t) for t in texts], np.int64).reshape(-1, 2)
        yield pd.DataFrame({"hi": found[:, 0], "lo": found[:, 1]})


# ------------------------------------------------------------------- the trie
def rotate(hi: np.ndarray, lo: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits beginning at ``start``, as two unsigned halves."""
    hi, lo = hi.astype(np.uint64), lo.astype(np.uint64)
    if start >= 64:
        hi, lo, start = lo, hi, start - 64
    if not start:
        return hi, lo
    s, r = np.uint64(start), np.uint64(64 - start)
    return (hi << s) | (lo >> r), (lo << s) | (hi >> r)


def depth_budget(start: int) -> np.ndarray:
    """Bits that may differ among the first d of a rotation, for each d."""
    ends = [((STARTS + [BITS])[i + 1] - STARTS[i]) for i in range(BLOCKS)]
    k = STARTS.index(start)
    lengths = ends[k:] + ends[:k]
    out, depth = np.zeros(BITS + 1, np.int64), 0
    for i, n in enumerate(lengths, 1):
        out[depth + 1 : depth + n + 1] = i * BUDGET // BLOCKS
        depth += n
    return out


class _Trie:
    """A binary trie as sorted keys; a node is a range [left, right) at a depth."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.order = np.lexsort((lo, hi))
        self.hi, self.lo = hi[self.order], lo[self.order]
        self._bit, self._ones = -1, np.zeros(0, np.int32)

    def split(self, left: np.ndarray, right: np.ndarray, bit: int) -> np.ndarray:
        """Where the children of the nodes part."""
        if self._bit != bit:  # the walk stays at a depth for long, so one is kept
            word, at = (self.hi, 63 - bit) if bit < 64 else (self.lo, 127 - bit)
            self._ones = np.zeros(len(word) + 1, np.int32)
            np.cumsum((word >> np.uint64(at)) & np.uint64(1), out=self._ones[1:], dtype=np.int32)
            self._bit = bit
        ones = self._ones
        return right - (ones[right] - ones[left])


class Forest:
    """The smallest position connected with each of n, by hooking and jumping."""

    def __init__(self, n: int):
        self.root, self.changes = np.arange(n), 0

    def add(self, e: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[e[0]], root[e[1]]
            differ = x != y
            if not differ.any():
                break
            e, x, y = e[:, differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (jumped := root[root] != root).any():
                root = np.where(jumped, root[root], root)
            self.changes += 1
        self.root = root


def neighbours(hi: np.ndarray, lo: np.ndarray, leading: int = 0) -> np.ndarray:
    """Pairs of positions within the budget among those that follow each other in the order of the bits from ``leading`` on.

    They connect most of a family of near copies, so that the walk can leave
    whatever lies within it.
    """
    order = np.lexsort((lo, hi & np.uint64((1 << (64 - leading)) - 1)))
    found = [np.zeros((2, 0), np.int64)]
    for step in range(1, 1 + min(_NEXT, len(order) - 1)):
        i, j = order[:-step], order[step:]
        near = np.bitwise_count(hi[i] ^ hi[j]).astype(np.int64) + np.bitwise_count(lo[i] ^ lo[j]) <= BUDGET
        found.append(np.stack([i[near], j[near]]))
    return np.concatenate(found, axis=1)


def _compare(a: _Trie, b: _Trie, pairs: np.ndarray, same: bool, at_a: np.ndarray, at_b: np.ndarray, forest: Forest) -> None:
    la, ra, lb, rb = pairs[:4]
    width = rb - lb
    n = (ra - la) * width
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + _COMPARE, "right")))
        size = n[at:upto]
        which = np.repeat(np.arange(at, upto), size)
        within = np.arange(len(which)) - np.repeat(ends[at:upto] - size - base, size)
        i, j = la[which] + within // width[which], lb[which] + within % width[which]
        if same:
            ok = i < j
            i, j = i[ok], j[ok]
        near = np.bitwise_count(a.hi[i] ^ b.hi[j]).astype(np.int64) + np.bitwise_count(a.lo[i] ^ b.lo[j]) <= BUDGET
        if near.any():
            forest.add(np.stack([at_a[i[near]], at_b[j[near]]]))
        at = upto


def join_subtrees(a: _Trie, b: _Trie, depth: int, differ: int, start: int, forest: Forest, at_a: np.ndarray, at_b: np.ndarray) -> None:
    """Connect in ``forest`` all pairs within the budget; ``at_a`` and ``at_b``: positions there.

    Walks pairs of nodes from ``depth`` down, accumulating differing bits, and
    leaves a pair over the budget of its depth, or whose fingerprints are all
    connected already.
    """
    if not len(a.hi) or not len(b.hi):
        return
    same, budget = a is b, depth_budget(start)
    at_a, at_b = at_a[a.order], at_b[b.order]
    seen, roots_a, roots_b, steps_a, steps_b = -1, *[np.zeros(0, np.int64)] * 4
    stack = [(depth, np.array([[0], [len(a.hi)], [0], [len(b.hi)], [differ]], np.int64))]
    while stack:
        depth, nodes = stack.pop()
        if nodes.shape[1] > _WALK:
            half = nodes.shape[1] // 2
            stack += [(depth, nodes[:, :half]), (depth, nodes[:, half:])]
            continue
        if seen != forest.changes:
            seen, roots_a, roots_b = forest.changes, forest.root[at_a], forest.root[at_b]
            steps_a, steps_b = (np.concatenate([[0], np.cumsum(r[1:] != r[:-1])]) for r in (roots_a, roots_b))
        la, ra, lb, rb, _ = nodes
        one = (steps_a[ra - 1] == steps_a[la]) & (steps_b[rb - 1] == steps_b[lb]) & (roots_a[la] == roots_b[lb])
        nodes = nodes[:, ~one]
        if depth == BITS:
            done = np.ones(nodes.shape[1], bool)
        elif depth >= STARTS[1]:
            done = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) <= (4 if depth < 64 else 256)
        else:
            done = np.zeros(nodes.shape[1], bool)
        if done.any():
            _compare(a, b, nodes[:, done], same, at_a, at_b, forest)
            nodes = nodes[:, ~done]
        if not nodes.shape[1]:
            continue
        la, ra, lb, rb, d = nodes
        ma, mb = a.split(la, ra, depth), b.split(lb, rb, depth)
        kids = [(la, ma, lb, mb, d), (ma, ra, mb, rb, d), (la, ma, mb, rb, d + 1)]
        cross = (ma, ra, lb, mb, d + 1)
        if same:  # below a node paired with itself, the two crossings are one
            twin = (la == lb) & (ra == rb)
            kids.append(tuple(x[~twin] for x in cross))
        else:
            kids.append(cross)
        nxt = np.concatenate([np.stack(k) for k in kids], axis=1)
        ok = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget[depth + 1])
        if same:
            ok &= ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1) & (nxt[3] - nxt[2] == 1))
        if ok.any():
            stack.append((depth + 1, nxt[:, ok]))


def _prefixes(bits: int) -> list[tuple[int, int]]:
    """Masks of ``bits`` bits with as many ones as the first block may differ in."""
    out = []
    for mask in range(1 << bits):
        if mask.bit_count() <= BUDGET // BLOCKS:
            out.append((mask, mask.bit_count()))
    return out


def _own_prefix(rh: np.ndarray, bits: int) -> np.ndarray:
    return (rh >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(rh), np.int64)


def _count_subtrees(bits: int):
    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hi, lo = pdf["hi"].to_numpy(), pdf["lo"].to_numpy()
            for start in STARTS:
                own, n = np.unique(_own_prefix(rotate(hi, lo, start)[0], bits), return_counts=True)
                yield pd.DataFrame({"start": np.full(len(own), start, np.int32), "a": own, "n": n})

    return count


def _to_subtrees(bits: int, parts: dict[tuple[int, int], int]):
    """``parts``: into how many parts (start, prefix) is dealt, where more than one."""
    masks = _prefixes(bits)

    @lean
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, hi, lo = pdf["id"].to_numpy(), pdf["hi"].to_numpy(), pdf["lo"].to_numpy()
            mixed = ((hi ^ (lo * 31)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for start in STARTS:
                rh, rl = rotate(hi, lo, start)
                own = _own_prefix(rh, bits)
                hot = np.array([p for s, p in parts if s == start], np.int64)
                for mask, _ in masks:
                    other = own ^ mask
                    row, part, theirs = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                    if len(hot) and (touched := np.isin(own, hot) | np.isin(other, hot)).any():
                        mine = np.array([parts.get((start, p), 1) for p in own.tolist()])
                        many = np.where(touched, [parts.get((start, p), 1) for p in other.tolist()], 1)
                        row = np.repeat(row, many)
                        theirs = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                        part = (mixed % mine)[row]
                    x, y = own[row], other[row]
                    second = (x > y) | ((x == y) & (part > theirs))
                    yield pd.DataFrame({
                        "start": np.full(len(row), start, np.int32), "a": np.minimum(x, y), "b": np.maximum(x, y),
                        "pa": np.where(second, theirs, part), "pb": np.where(second, part, theirs), "side": second.astype(np.int8),
                        "id": ids[row], "hi": rh.astype(np.int64)[row], "lo": rl.astype(np.int64)[row],
                    })

    return spread


def _join_group(bits: int):
    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start, ka, kb, pa, pb = (int(x) for x in key)
        pdf = pdf.sort_values("id", kind="stable")  # the smallest position is the smallest id
        ids, side = pdf["id"].to_numpy(), pdf["side"].to_numpy()
        hi, lo = pdf["hi"].to_numpy().astype(np.uint64), pdf["lo"].to_numpy().astype(np.uint64)
        at_a, at_b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        forest = Forest(len(ids))
        for at in (at_a, at_b):
            if len(at) > 1:
                forest.add(at[neighbours(hi[at], lo[at])])
        a = _Trie(hi[at_a], lo[at_a])
        if (ka, pa) == (kb, pb):
            before = np.arange(len(ids))
            b, at_b = a, at_a
        else:  # what is connected within one side is told by other tasks
            before = forest.root.copy()
            b = _Trie(hi[at_b], lo[at_b])
            forest.add(neighbours(hi, lo, bits))
        join_subtrees(a, b, bits, (ka ^ kb).bit_count(), start, forest, at_a, at_b)
        tied = np.flatnonzero((before == np.arange(len(ids))) & (forest.root != before))
        return pd.DataFrame({"id": ids[tied], "root": ids[forest.root[tied]]})

    return join


def near_edges(fingerprints: DataFrame, n: int, subtree: int = SUBTREE) -> DataFrame:
    """id, root: edges that connect all of (id, hi, lo) within the budget.

    ``n``: how many there are; it sets how deep the trie is cut.  A subtree of
    more than twice ``subtree`` fingerprints, such as a family of near copies,
    is dealt into parts, and each pair of parts is a task of its own.
    """
    bits = min(STARTS[1], max(0, math.ceil(math.log2(max(1, n) / subtree))))
    sizes = fingerprints.mapInPandas(_count_subtrees(bits), "start int, a long, n long").groupBy("start", "a").agg(F.sum("n").alias("n"))
    large = sizes.where(F.col("n") > 2 * subtree).collect()  # at most 7 n / (2 subtree)
    parts = {(r["start"], r["a"]): -(-r["n"] // subtree) for r in large}
    return (
        fingerprints.mapInPandas(_to_subtrees(bits, parts), "start int, a long, b long, pa long, pb long, side byte, id long, hi long, lo long")
        .groupBy("start", "a", "b", "pa", "pb")
        .applyInPandas(_join_group(bits), "id long, root long")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """id, group: the smallest id connected with each id of (id, root).

    Minimum labels spread over the edges and then jump to the label of the
    label, so long chains close in a logarithmic number of rounds.
    """
    edges = materialize(edges.where("id <> root").select("id", "root").distinct())
    both = edges.select(F.col("id").alias("x"), F.col("root").alias("y")).union(edges.select("root", "id"))
    labels = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")))
    while True:
        seen = both.join(labels.select(F.col("x").alias("y"), F.col("l")), "y").groupBy("x").agg(F.min("l").alias("m"))
        spread = labels.join(seen, "x", "left").select("x", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        to = spread.select(F.col("x").alias("l"), F.col("l").alias("ll"))
        new = materialize(spread.join(to, "l", "left").select("x", F.least("l", "ll").alias("l"), "old"))
        changed = new.where("l < old").limit(1).count()
        labels = new.select("x", "l")
        if not changed:
            return labels.select(F.col("x").alias("id"), F.col("l").alias("group"))


# ------------------------------------------------------------------ documents
def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, k1, k2, member: a row for each of ``docs``; near duplicates share member."""
    small_batches(docs.sparkSession)
    k1, k2 = text_key(F.col(quoted(text_col)))
    rows = docs.select(F.col(quoted(id_col)).alias("doc"), k1.alias("k1"), k2.alias("k2"), F.pandas_udf(_fingerprints, "hi long, lo long")(F.col(quoted(text_col))).alias("f"))
    rows = materialize(rows.select("doc", "k1", "k2", "f.hi", "f.lo"))
    prints = materialize(rows.select("hi", "lo").distinct().withColumn("id", F.monotonically_increasing_id()))
    found = components(near_edges(prints, prints.count()))
    member = prints.join(found, "id", "left").select("hi", "lo", F.coalesce("group", "id").alias("member"))
    return rows.join(member, ["hi", "lo"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept_id, group_size, keep: a row for each row of ``docs``.

    ``kept_id`` is the smallest id of the group (its own where a document has
    no near duplicate); ``keep`` is true in one row of each group.  Null and
    empty texts, and texts of white space, are one group.  Null ids come after
    all others.  Of repeated rows one is kept.  An empty table gives none.
    """
    g = _groups(docs, id_col, text_col)
    order = Window.partitionBy("member").orderBy(F.col("doc").asc_nulls_last(), "k1", "k2")
    whole = Window.partitionBy("member")
    return g.select(
        F.col("doc").alias("doc_id"),
        F.first("doc").over(order).alias("kept_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        (F.row_number().over(order) == 1).alias("keep"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates, all columns kept.

    The smallest id stays (null ids after all others); of repeated rows one
    stays; null, empty and blank texts are one group.
    """
    g = _groups(docs, id_col, text_col)
    best = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "k1", "k2"))
    kept = g.groupBy("member").agg(best.alias("best")).select("best.doc", "best.k1", "best.k2")
    a, b, n = fresh(docs, "k1", "k2", "nth")
    k1, k2 = text_key(F.col(quoted(text_col)))
    keyed = docs.withColumns({a: k1, b: k2})
    ours = keyed.join(
        kept, (keyed[a] == kept["k1"]) & (keyed[b] == kept["k2"]) & keyed[quoted(id_col)].eqNullSafe(kept["doc"]), "left_semi"
    )
    once = Window.partitionBy(F.col(a), F.col(b), F.col(quoted(id_col))).orderBy(F.col(a))
    return ours.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(*[F.col(quoted(c)) for c in docs.columns])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kept_id, group_size, keep of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
