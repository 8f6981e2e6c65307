"""Plain Python versions of the operators, over lists held in memory."""

import itertools
import math
from collections import defaultdict

from quillgraph.llm import decontaminate as dec
from quillgraph.llm import lines as ln
from quillgraph.llm import pii
from quillgraph.llm import simhash as sh


def hamming(a, b):
    mask = (1 << 64) - 1
    return (((a[0] & mask) ^ (b[0] & mask)).bit_count()) + (((a[1] & mask) ^ (b[1] & mask)).bit_count())


def roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_groups(texts):
    """For each text the position of the first of its group: all pairs are compared."""
    make = sh.Fingerprinter()
    prints = [make(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if hamming(prints[i], prints[j]) <= sh.BUDGET]
    return roots(len(texts), pairs)


def boilerplate(texts):
    """Hashes of masked lines whose template recurs."""
    seen = defaultdict(set)  # line -> {(text, sketch)}
    masked, leaf = {}, {}
    for text in {t for t in texts if t}:
        for raw, sketch in zip(text.split("\n"), ln.sketches(text)):
            p = ln.parse(raw)
            if p:
                seen[p[0]].add((text, int(sketch)))
                leaf[p[0]], masked[p[0]] = p[1], p[2]
    # a line that repeats in a text counts with the sketch of its last place
    for line, where in seen.items():
        last = {}
        for text in {t for t, _ in where}:
            for raw, sketch in zip(text.split("\n"), ln.sketches(text)):
                p = ln.parse(raw)
                if p and p[0] == line:
                    last[text] = int(sketch)
        seen[line] = set(last.items())
    by_leaf = defaultdict(list)
    for line, f in leaf.items():
        by_leaf[f].append((line, masked[line]))
    template = {}
    for members in by_leaf.values():
        if len(members) > 1 and sum(len(seen[line]) for line, _ in members) >= ln.MIN_DOCS:
            template.update(ln.merge_leaf(members))
    support = defaultdict(lambda: [0, set()])
    for line, where in seen.items():
        s = support[template.get(line, line)]
        s[0] += len(where)
        s[1] |= {k for _, k in where}
    bad = {t for t, (n, keys) in support.items() if len(keys) >= ln.MIN_DOCS and len(keys) >= ln.UNRELATED * n}
    many = {t for t, (n, _) in support.items() if n >= ln.MIN_DOCS}
    holders = defaultdict(list)
    for text in {t for t in texts if t}:
        parsed = [ln.key(raw) for raw in text.split("\n")]
        shared = [h is not None and template.get(h, h) in many for h in parsed]
        own = {h for h in parsed if h is not None and template.get(h, h) in many - bad}
        if own:
            portrait = ln.Portrait(text, shared, [h is None for h in parsed])
            for h in own:
                holders[template.get(h, h)].append((portrait.probe([i for i, x in enumerate(parsed) if x == h]), portrait.whole))
    for t, portraits in holders.items():  # three texts of which no two are related
        if any(not ln.related(a, b) and not ln.related(a, c) and not ln.related(b, c) for a, b, c in itertools.combinations(portraits[:60], 3)):
            bad.add(t)
    return {line for line in seen if template.get(line, line) in bad}


def without_lines(text, bad):
    if not text:
        return text, []
    lines = text.split("\n")
    at = [i for i, raw in enumerate(lines) if (p := ln.parse(raw)) and p[0] in bad]
    return "\n".join(x for i, x in enumerate(lines) if i not in set(at)), at


def leaked(tokens, items):
    """Which tokens lie in a run that an item has too and that is long or covers enough of that item."""
    covered = [False] * len(tokens)
    for item in items:
        row = [0] * len(item)
        for i, t in enumerate(tokens):
            row = [((row[j - 1] if j else 0) + 1) if item[j] == t else 0 for j in range(len(item))]
            n = max(row, default=0)
            if n >= dec.MIN_LENGTH or n >= max(dec.MIN_SHORT, dec.COVERAGE * len(item)):
                covered[i + 1 - n : i + 1] = [True] * n
    return covered


def disclosures(texts):
    """(entity, term) -> disclosure, by counting in every distinct text."""
    texts = list({t for t in texts if t})
    n_all = len(set(texts))
    n_e, n_t, joint, names = defaultdict(int), defaultdict(int), defaultdict(int), set()
    for t in texts:
        near = defaultdict(set)
        for e, terms in pii.terms_near(t, pii.find_entities(t)):
            near[e] |= terms.keys()
            names |= {(e, w) for w, named in terms.items() if named}
        for e, terms in near.items():
            n_e[e] += 1
            for w in terms:
                joint[e, w] += 1
        for w in set(pii._WORD.findall(t.lower())):
            n_t[w] += 1
    out = {}
    for (e, w), n in joint.items():
        rare = e.split(":")[0].isalpha() and ":" in e and n_e[e] < pii.MIN_JOINT and (e, w) in names
        if n >= pii.MIN_JOINT or rare:
            total = max(n_all, n_e[e])
            ic = math.log(total / n_e[e])
            d = round(math.log(total * n / (n_e[e] * (max(n_t[w], n) + pii.PRIOR * rare))) / ic, 6) if ic > 0 else 0.0
            out[e, w] = min(d, pii.REMOVE - 1e-6) if rare else d
    return {k: v for k, v in out.items() if v >= pii.GENERALISE}
