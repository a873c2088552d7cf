"""Ranked search, spelling variants and decontamination against brute force, on hard tables and small bounds."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

SCHEMA = "source int, doc_id long, text string, item_id string"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def tables(spark):
    """Documents with copies, a very long text, nulls, repeated and missing ids and clashing names; items of all lengths."""
    rng = random.Random(7)
    vocabulary = [a + b + c for a in ("al", "ben", "Ćor", "dé", "İst", "ΟΣ") for b in ("", "ta", "ro") for c in ("s", "mi", "n3")]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    say = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    items = [("a", say(30)), ("b", say(12)), ("b", say(14)), ("c", "Alone"), ("d", "two Words,here"), ("e", None), ("f", " ..! "), (None, say(20)), ("g", say(10)), ("h", "never occurring words"), ("i", say(25))]
    texts = [None, "", " . ", "alone", "x two-words HERE two words here", say(4000)] + [say(rng.randint(1, 60)) for _ in range(150)]
    copied = say(50)
    for i in range(160):
        part = items[rng.choice((0, 1, 2, 8, 10))][1].split()
        a, b = sorted(rng.choices(range(len(part) + 1), k=2))
        texts.append(copied if i % 2 else say(5) + ". " + "\n".join(part[a:b]).upper() + " " + say(3))
    rows = [(0, i, t, "x") for i, t in enumerate(texts)] + [(1, 7, say(20), "y"), (1, 7, copied, "y"), (2, None, items[0][1], "z")]
    return rows, items, spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(items, "item_id string, text string")


def test_ranking_equals_brute_force(tables, monkeypatch):
    from quiverlake.llm import lexical

    rows, items, docs, asked = tables
    words = [WORD.findall(lowered(t)) for _, _, t, _ in rows]
    n, total = sum(map(bool, words)), sum(map(len, words))
    df = Counter(w for own in words for w in set(own))
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for w, d in df.items()}
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(WORD.findall(lowered(t)))
    want = {}
    for i, own in terms.items():
        scores = []
        for (_, doc, _, _), w in zip(rows, words):
            tf, m = Counter(w), 50 + 50 * len(w) * n // total
            score = sum(weight[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in own if tf[t])
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        if i is not None and scores:
            want[i] = [(d, -s) for s, d in sorted(scores)[:8]]
    for bounds in ({}, {"POSTINGS": 60, "NODES": 40}):
        for name, value in bounds.items():
            monkeypatch.setattr(lexical, name, value)
        for block in (1 << 20, 20):
            got = {}
            for r in sorted(lexical.rank_documents(docs, asked, k=8, block=block).collect(), key=lambda r: (r.item_id, r.rank)):
                got.setdefault(r.item_id, []).append((r.doc_id, r.score))
                assert r.rank == len(got[r.item_id])
            assert got == want


def test_treaps_are_search_trees_and_heaps():
    from quiverlake.llm.lexical import treaps

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 400):
        for key in (rng.integers(0, 5, n), np.arange(n), np.arange(n)[::-1], np.full(n, 4)):
            begins = rng.random(n) < 0.1
            begins[0] = True
            left, right, root = treaps(begins, key.astype(np.int64))
            seen = []

            def walk(x):
                if x < 0:
                    return []
                for child in (left[x], right[x]):
                    assert child < 0 or key[child] <= key[x]
                return [*walk(left[x]), x, *walk(right[x])]

            if n < 400 or key[0] != key[-1]:
                import sys

                sys.setrecursionlimit(5000)
            for r in np.flatnonzero(root):
                seen += walk(r)
            assert seen == list(range(n)) and root.sum() == begins.sum()


def test_ranking_prunes_and_copies_make_no_path():
    """Few documents are scored where few can enter, and equal documents don't make deep treaps."""
    from quiverlake.llm import lexical

    rng, n = np.random.default_rng(1), 20_000
    impact = np.concatenate([rng.integers(1, 1000, n), rng.integers(1, 1000, n // 50)])
    document = np.concatenate([np.arange(n), np.sort(rng.choice(n, n // 50, replace=False))])
    term = np.repeat([0, 1], [n, n // 50])
    ranking = lexical.Ranking(np.array([0, 2]), np.array([0, 1]), 10)
    ranking.add(lexical.Block(np.arange(n), document, term, impact, 2))
    score = np.bincount(document, impact, n)
    best = np.lexsort((np.arange(n), -score))[:10]
    assert ranking.doc.tolist() == best.tolist() and ranking.score.tolist() == score[best].astype(int).tolist()
    assert ranking.scored < n / 20
    same = lexical.Block(np.arange(n), np.arange(n), np.zeros(n, np.int64), np.full(n, 5), 1)
    depth, node = 0, np.flatnonzero(same.root >= 0) * 0 + same.root[0]
    while len(node):
        node = np.concatenate([same.left[node], same.right[node]])
        node, depth = node[node >= 0], depth + 1
    assert depth < 60


def test_spelling_equals_brute_force(spark, monkeypatch):
    from quiverlake.llm import spelling

    rng = random.Random(5)
    stems = ["étude", "language", "aaaaaa", "storm", "storms", "stormy", "lange", "langue", "×÷×÷×", "x" * 90]
    texts = [None, "", "12 ?", "ab", "y" * 3000 + " storm"]
    for _ in range(500):
        words = []
        for _ in range(rng.randint(1, 12)):
            w = rng.choices(stems, [len(stems) - i for i in range(len(stems))])[0]
            if rng.random() < 0.4:
                i, x = rng.randrange(len(w)), rng.choice("aeéms")
                w = rng.choice((w[:i] + w[i + 1 :], w[:i] + x + w[i + 1 :], w[:i] + x + w[i:]))
            words.append(w.capitalize() if rng.random() < 0.2 else w)
        texts.append(rng.choice((" ", "-", "é ")).join(words))
    rows = [(0, i % 300, t, "x") for i, t in enumerate(texts)] + [(0, None, "storm étude étude", "x")] * 2
    counts = Counter()
    for _, i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    want, form = {}, {}
    for w in n:
        own = [o for o in n if near(w, o)]
        best = min(own, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        want[w] = (form[w], len(own))
    root = lambda w: root(form[w]) if form[w] else w
    want = {w: (f, root(w), n[w], m, n[f] if f else None) for w, (f, m) in want.items()}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, value in {"HELD": spelling.HELD, "PLACES": 16}.items():
        monkeypatch.setattr(spelling, name, value)
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs).collect()}
        assert got == want
    assert any(f and form[f] for f in form.values() if f)  # a chain
    monkeypatch.setattr(spelling, "HELD", 20)
    assert {r.word: r.n for r in spelling.spelling_variants(docs).collect()} == n
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_neighbourhoods_are_whole_and_distinct():
    from quiverlake.llm.spelling import neighbours

    words, letters = ["aabba", "q", "ééx"], "abé"
    for step in (3, 2048):
        made = {}
        for numbers, candidates in neighbours(words, np.array([ord(c) for c in letters])):
            for k, c in zip(numbers, candidates):
                made.setdefault(words[k], []).append(c)
        for w in words:
            want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + x + w[i + 1 :] for i in range(len(w)) for x in letters if x != w[i]} | {w[:i] + x + w[i:] for i in range(len(w) + 1) for x in letters}
            assert sorted(made[w]) == sorted(want), w


def test_checksums_of_long_and_short_runs():
    from quiverlake.llm.spelling import checksums

    data = np.frombuffer(b"abc" + b"z" * 200 + b"q", np.uint8)
    start, end = np.array([0, 3, 203]), np.array([3, 203, 204])
    before = np.array([zlib.crc32(b"5:"), zlib.crc32(b"77:"), zlib.crc32(b":")], np.uint32)
    assert checksums(data, start, end, before).tolist() == [zlib.crc32(b"5:abc"), zlib.crc32(b"77:" + b"z" * 200), zlib.crc32(b":q")]


@pytest.mark.parametrize("width", [10, 4])
def test_decontamination_equals_brute_force(tables, width):
    from quiverlake.llm.decontaminate import decontaminate

    rows, items, docs, asked = tables
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
    windows = {}
    for i, t in items:
        w = split(t)
        size = min(width, len(w))
        for a in range(len(w) - size + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[a : a + size]), set()).add(i)
    want = []
    for _, doc, t, _ in rows:
        w, hit, met = split(t), set(), set()
        for size in {len(k) for k in windows}:
            for a in range(len(w) - size + 1):
                if own := windows.get(tuple(w[a : a + size])):
                    hit.update(range(a, a + size))
                    met |= own
        want.append((doc, len(w), len(hit), sorted(met)))
    assert any(h for _, _, h, _ in want)
    got = [tuple(r) for r in decontaminate(docs, asked, width).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_decontamination_is_native_and_handles_nothing(spark, tables):
    from quiverlake.llm.decontaminate import decontaminate

    _, _, docs, asked = tables
    none = decontaminate(docs, asked.limit(0)).collect()
    assert len(none) == docs.count() and all(r.n_hit == 0 and r.items == [] for r in none)
    out = decontaminate(docs.limit(0), asked)
    assert out.collect() == [] and "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_ranking_of_nothing(spark, tables):
    from quiverlake.llm.lexical import rank_documents

    _, _, docs, asked = tables
    assert rank_documents(docs.limit(0), asked).collect() == [] and rank_documents(docs, asked.limit(0)).collect() == []
