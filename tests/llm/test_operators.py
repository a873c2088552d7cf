"""Corpus operators: hard tables (nulls, empty and long texts, repeats, clashing columns), brute force, round trips."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import licenses, pii, secrets
from quiverlake.llm.common import maybe_in
from quiverlake.llm.components import components
from quiverlake.llm.jpeg import Decoder, media_columns, store_text, write_payload
from quiverlake.llm.licenses import find_licenses
from quiverlake.llm.neardup import near_duplicates, super_minhash
from quiverlake.llm.packing import hilbert_key, pack_documents, word_bpe
from quiverlake.llm.pieces import Normalizer, encode_documents, piece_encoder
from quiverlake.llm.queries import ORACLE_SQL, PIECE_MODEL, QUERIES, WORD_MODEL, tokenizer_path
from quiverlake.llm.substrings import remove_repeats
from quiverlake.llm.topk import top_k
from quiverlake.llm.toxicity import fit, score_documents, score_rows

LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
HARD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, LONG), (5, LONG), (6, PASSAGE + " tail"), (7, "head " + PASSAGE),
    (8, PASSAGE + " " + PASSAGE), (9, "é€😀▁ x  y\x01\x02"), (10, 'api_key: "abcDEF123/+" AKIA' + "Z9" * 9 + " " + "0af3" * 8 + " mail a@b.c%d@e.fr"),
    (11, "one two"), (12, "Released under the MIT License. All rights reserved."), (None, "no id here"),
]
TEXTS = {i: t for i, t in HARD if i is not None}


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "en", "s", 0, 1, b"x", 0.5) for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int, bands binary, component double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pieces_equal_the_library(hard, empty):
    path = tokenizer_path(PIECE_MODEL)
    model = piece_encoder(path).model
    got = by_id(encode_documents(hard, path))
    assert len(got) == len(HARD)
    for i, t in HARD:
        assert got[i].ids == model.encode(t or "") and got[i].decoded == model.decode(got[i].ids)
        proto = model.encode(t or "", out_type="proto")
        assert [(p.begin, p.end) for p in proto.pieces] == list(zip(got[i].begins, got[i].ends)) or i == 9  # bytes of one character share its span there
    assert encode_documents(empty, path).count() == 0


def test_normalizer_equals_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    for rule in ("nmt_nfkc", "nfkc_cf", "identity"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(library.serialized_model_proto())
        s = proto.normalizer_spec
        own = Normalizer(s.precompiled_charsmap, s.add_dummy_prefix, s.remove_extra_whitespaces, s.escape_whitespaces)
        for text in ("ＡＢＣ ｱ ﬁ", " a  b ", "①②③", "가나다 ", "é　z", ""):
            out, source = own(text.encode())
            assert out.decode() == library.normalize(text) and len(source) == len(out) + 1


def test_top_k_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in QUERIES["op2_no_random_access"](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(con.sql(ORACLE_SQL["op2_no_random_access"]).fetchall())


def test_top_k_ties_nulls_and_repeats(spark):
    rows = [(i, [1.0, 0.5], "a") for i in range(30)] + [(40, None, "b"), (41, [None, 1.0], "b"), (42, [float("nan"), 1.0], "b"), (60, [-1.0, 2.0], "c"), (None, [9.0, 9.0], "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = top_k(df, "vec_id % 20 = 0", k=20).collect()
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r["rank"])] == list(range(1, 21))
    assert {r.query_id for r in got} == {0, 20, 60} and all(r.vec_id != r.query_id for r in got)
    assert top_k(df.limit(0), "vec_id % 20 = 0").count() == 0
    odd = spark.createDataFrame([(0, []), (1, []), (20, [float("inf")]), (21, [-float("inf"), 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in top_k(odd, "vec_id % 20 = 0").collect()] == [(0, 1, 0)]


def _brute_top(ids, x, asked, k):
    score = x[asked] @ x.T
    want = {}
    for q, row in zip(ids[asked], score):
        order = [j for j in np.lexsort((ids, -row)) if ids[j] != q][:k]
        want[int(q)] = [(int(ids[j]), int(row[j])) for j in order]
    return want


@pytest.mark.parametrize("kind", ["given", "clustered"])
def test_top_k_stops_by_its_bounds(spark, kind, monkeypatch):
    """Queries stop before the ends of their lists, on the given table and much sooner on a clustered one."""
    if kind == "given":
        df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
        rows = df.orderBy("vec_id").collect()
        ids, x = np.array([r.vec_id for r in rows]), np.floor(64 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64)
    else:
        rng = np.random.default_rng(4)
        ids, own = np.arange(3000), rng.integers(0, 60, 3000)
        x = (rng.normal(size=(60, 8)) * 3)[own] + rng.normal(size=(3000, 8)) * 0.05
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
        x = np.floor(64 * x).astype(np.int64)
        monkeypatch.setattr("quiverlake.llm.topk.QUERIES", 40)  # several blocks of queries, of candidates and lanes
    got, depth = {}, {}
    for r in sorted(top_k(df, "vec_id % 20 = 0", block=4096 if kind == "given" else 500).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        depth[r.query_id] = r.depth
    assert got == _brute_top(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    assert all(0 < d <= 1 for d in depth.values())
    assert np.mean([d < 1 for d in depth.values()]) > 0.9 and np.median(list(depth.values())) < (0.99 if kind == "given" else 0.8)


def test_toxicity_learns_and_handles_hard_tables(spark, hard, empty):
    rng = np.random.default_rng(1)
    text = lambda bad: " ".join(rng.choice([f"w{i}" for i in range(60)], 40)) + (" vile " + " ".join(rng.choice([f"w{i}" for i in range(60)], 5)) if bad else "")
    docs = spark.createDataFrame([(i, text(i % 3 == 0)) for i in range(240)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(999, None), (None, 1)], "doc_id long, toxic int")
    learn = "pmod(crc32(cast(doc_id as string)), 5) <> 0"
    net = fit(docs, labels, learn=learn)
    scores = by_id(score_documents(docs, net))
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i].score >= 0.5) == (i % 3 == 0) for i in held]) >= 0.9
    got = score_documents(hard, net).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
    assert score_rows(hard, net).columns == [*hard.columns, "toxicity"]
    assert score_documents(empty, net).count() == 0
    assert fit(docs, labels.limit(0)) is None and score_documents(docs, None).agg(F.max("score")).first()[0] == 0


def test_licenses_equal_brute_force(spark, hard, empty):
    own = next(w for name, _, w in licenses.chunks(licenses.TEMPLATES) if name == "apache-2.0-notice")
    near = " ".join([*own[:20], "that", *own[21:]])
    docs = spark.createDataFrame([(100, "x " * 30 + near + " y" * 9), (101, "Licensed under CC BY-NC 4.0"), (102, "a license"), (103, "z " * 990 + near + " z" * 1500 + near)], "doc_id long, text string").union(hard.select("doc_id", "text"))
    got = {(r.doc_id, r.template, r.chunk): (r.containment, r.start_word) for r in find_licenses(docs).collect()}
    want = {}
    for r in docs.collect():
        w = licenses.words_of(r.text or "")
        for name, k, own in licenses.chunks(licenses.TEMPLATES):
            s = set(licenses.shingles(own))
            near = [(len(s & set(licenses.shingles(w[a : a + len(own)]))) / len(s), -a) for a in range(len(w) - len(own) + 1)]
            if near and max(near)[0] >= 0.8:
                want[r.doc_id, name, k] = max(near)[0], -max(near)[1]
    assert got == want and len(want) >= 4
    assert find_licenses(empty).count() == 0 and find_licenses(hard, {}).count() == 0


def test_licenses_of_texts_shorter_than_the_notice(spark):
    texts = [" ".join(own[a : len(own) - b]) for _, _, own in licenses.chunks(licenses.TEMPLATES) for a in range(5) for b in range(5) if len(own) > a + b]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.template, r.chunk): (r.containment, r.start_word) for r in find_licenses(docs).collect()}
    want, short = {}, 0
    for i, t in enumerate(texts):
        w = licenses.words_of(t)
        for name, k, own in licenses.chunks(licenses.TEMPLATES):
            s = set(licenses.shingles(own))
            near = max((len(s & set(licenses.shingles(w[a : a + len(own)]))) / len(s), -a) for a in range(max(1, len(w) - len(own) + 1)))
            if near[0] >= 0.8:
                want[i, name, k] = near[0], -near[1]
                short += len(w) < len(own)
    assert got == want and short >= 20


def brute_components(texts, width, percent):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = {}
    for i, t in texts.items():
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_copies():
    rng = np.random.default_rng(5)
    texts = dict(TEXTS)
    for g in range(6):
        first = [f"g{g}v{i}" for i in range(120)]
        for c in range(12):
            copy = list(first)
            for at in rng.choice(120, int(rng.integers(0, 8)), replace=False):
                copy[at] = f"new{g}{c}{at}"
            texts[1000 + 100 * g + c] = " ".join(copy)
    return texts


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, hard, width):
    texts = near_copies()
    docs = spark.createDataFrame(list(texts.items()) + [(None, "x y z")], "doc_id long, text string").withColumn("component", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, width=width).collect()}
    assert got == brute_components(texts, width, 80) | {None: (1, None, None)}


def test_large_group_is_dealt_in_blocks(spark, monkeypatch):
    from quiverlake.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 5)
    texts = near_copies()
    rng = np.random.default_rng(9)
    for g in range(3):  # families that drift apart, in no order of ids: long chains of links and many that nearly are
        own, ids = [f"z{g}v{i}" for i in range(100)], rng.permutation(25)
        for c in ids:
            texts[5000 + 100 * g + int(c)] = " ".join(own)
            for at in rng.choice(100, int(rng.integers(1, 3)), replace=False):
                own[at] = f"n{g}{c}{at}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, width=4).collect()} == brute_components(texts, 4, 80)


def test_a_repeated_id_links_its_sets(spark):
    a, b = PASSAGE, " ".join(f"q{i}" for i in range(60))
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (9, "alone in all the world")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True)]


def test_chained_chance_collisions_make_no_common_unit(spark, monkeypatch):
    """A long chain of texts of which neighbours are half alike: the pairs compared stay near the number of shared bands."""
    from quiverlake.llm import neardup

    step = [[f"s{i}x{j}" for j in range(30)] for i in range(241)]
    rows = [(i, " ".join(step[i] + step[i + 1])) for i in range(240)]
    met = []
    plain = neardup.stage_table

    def watched(df, name, like=None):
        out = plain(df, name, like)
        if name == "units":
            met.extend(out.collect())
        return out

    monkeypatch.setattr(neardup, "stage_table", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, width=4, percent=80, rows=1, bands=36).collect()  # bands of one slot: half alike, many bands shared
    assert all(r.kept for r in got)
    assert sum(u.n * (u.n - 1) // 2 for u in met) < 4 * 240 and max(u.n for u in met) < 12


def test_equal_sets_have_equal_keys_wherever_they_stand():
    import pyarrow as pa

    from quiverlake.llm.neardup import _bands

    texts = [f"{w} a b c d e f" for w in ("x", "y", "z", "x", "y", "x")]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    (made,) = _bands(iter([batch]), 4, 5, 4)
    keys = list(zip(made.column("key1").to_pylist(), made.column("key2").to_pylist()))
    assert [keys.index(k) for k in keys] == [0, 1, 2, 0, 1, 0]


def test_near_duplicates_of_nothing(empty):
    assert near_duplicates(empty).count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    s = super_minhash(np.concatenate([a, b]), np.array([0, 2000, 4000]), 1000)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.06
    one = super_minhash(np.array([7], np.uint64), np.array([0, 1]), 64)[0] >> np.uint64(56)
    assert sorted(one.tolist()) == list(range(64))  # one element walks the whole permutation


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long").repartition(6)
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_personal_data(hard, empty):
    got = by_id(pii.find_personal_data(hard))
    assert len(got) == len(HARD) and got[0].findings == [] and got[1].findings == []
    text = "call +1 (389) 555-5010 or 4111 1111 1111 1111, 4111 1111 1111 1112, 1.2.3.4 1.2.3.999 x@y.z%a@b.co iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789 or 987-65-4321x"
    found = [(k, text[a:b]) for k, a, b, _ in pii.find(text)]
    assert ("phone", "+1 (389) 555-5010") in found and ("ip", "1.2.3.4") in found and ("iban", "DE89 3704 0044 0532 0130 00") in found and ("ssn", "123-45-6789") in found
    assert [f for f in found if f[0] == "card"] == [("card", "4111 1111 1111 1111"), ("card", "3704 0044 0532 0130 00")] or [f for f in found if f[0] == "card"] == [("card", "4111 1111 1111 1111")]
    assert [t for k, t in found if k == "email"] == [m[0] for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert pii.find_personal_data(empty).count() == 0


def test_kinds_of_personal_data_in_the_docstring_exist():
    assert {k for part in re.findall(r"`([a-z ]+)`", pii.__doc__) for k in part.split()} == set(pii.KINDS)
    kinds = lambda t: [k for k, *_ in pii.find(t)]
    assert kinds("x DE89370400440532013000") == ["iban"] and kinds("x 123-45-6789") == [] and kinds("ssn 123-45-6789") == ["ssn"]


def brute_repeats(texts, width):
    seen, out = {}, {}
    for i in sorted(texts):
        w = words(texts[i])
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[k : k + width]), (i, k)) != (i, k):
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_bitmap_loses_no_key_and_has_a_bound(spark, monkeypatch):
    keys = [*range(0, 3000, 7), -5, 2**62]
    rows = [(i, "near") for i in [*range(3000), -5, 2**62, None]]
    df, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k in [*keys, None]], "doc_id long")
    got = {r.doc_id: r.maybe for r in maybe_in(df, wanted, "doc_id", "maybe").collect()}
    assert len(got) == len(rows) and all(got[k] for k in keys) and got[None] is False
    assert sum(got.values()) < len(keys) + 20
    assert not any(r.maybe for r in maybe_in(df, wanted.limit(0), "doc_id", "maybe").collect())
    monkeypatch.setattr("quiverlake.llm.common.WORDS", 2)  # full: all pass, none is lost
    got = {r.doc_id: r.maybe for r in maybe_in(df, wanted, "doc_id", "maybe").collect()}
    assert len(got) == len(rows) and all(got[k] for k in keys)


def test_repeats_equal_brute_force(spark, hard, empty):
    texts = near_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("runs", F.lit(1)).repartition(4)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs).collect()} == brute_repeats(texts, 20)
    got = by_id(remove_repeats(hard, carry=True))
    assert len(got) == len(HARD) and got[None].n_removed == 0 and got[7].row.text == HARD[7][1]
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in got.items() if i is not None} == brute_repeats(TEXTS, 20)
    assert remove_repeats(empty).count() == 0


def brute_repeats_of_rows(rows, width=20):
    """As brute_repeats, for rows that may repeat an id: a window's first start is its smallest (id, place) over all rows."""
    least, out = {}, []
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1 if i is not None else 0):
            least[tuple(w[k : k + width])] = min(least.get(tuple(w[k : k + width]), (i, k)), (i, k))
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1 if i is not None else 0):
            if least[tuple(w[k : k + width])] != (i, k):
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bounds", [{}, {"salt": 3, "held": 50, "slice_bytes": 600}])
def test_repeats_of_rows_that_repeat_an_id(spark, bounds):
    """Small bounds send windows through every step: slices, groups of a minimiser, and the last sort."""
    a = " ".join(f"a{i}" for i in range(300))
    rows = [(1, a), (1, a), (1, " ".join(f"u{i}" for i in range(40))), (2, " ".join(a.split()[10:40])), (2, "b c"), (3, a[:500]), (None, a), (5000, None), (5000, a + " " + a), (5000, "x " * 30)]
    rng = np.random.default_rng(3)
    for k in range(60):  # copies with an edit each: one minimiser has many different windows
        own = a.split()
        own[int(rng.integers(0, 300))] = f"e{k}"
        rows.append((7000 + k % 50, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a b", F.lit(1)).withColumn("n-x", F.lit("q")).withColumn("key", F.lit("k")).repartition(5)
    got = remove_repeats(docs, carry=True, **bounds).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_repeats_of_rows(rows)
    assert set(got[0].row.asDict()) == {"doc_id", "text", "a b", "n-x", "key"}


def test_words_with_equal_hashes_are_told_apart():
    import pyarrow as pa

    from quiverlake.llm.substrings import _decided
    from quiverlake.llm.wordtable import WordTable

    text = "a bb a cc bb dd a bb a dd"
    table, texts = WordTable(pa.array([text])), text.split()
    one, other = (x.ravel() for x in np.meshgrid(range(10), range(10)))
    want = [texts[i] == texts[j] for i, j in zip(one, other)]
    assert table.same(one, other, step=7).tolist() == want
    table.hashes[:] = 7  # as if all words collided: only equal words are called repeats
    assert table.same(one, other).tolist() == want
    at = np.arange(8)
    gone = _decided(table, at, np.zeros(8, np.int64), at, 3)
    assert all(texts[k : k + 3] == texts[:3] for k in np.flatnonzero(gone)) and gone[6]


def test_media_round_trip(hard, empty):
    got = by_id(media_columns(hard))
    for i, t in HARD:
        raw = (t or "").encode()
        r = got[i]
        assert r.n_bytes == len(raw) and bytes(r.payload) == raw + b"\xff" * (len(r.payload) - len(raw))
        assert len(r.payload) % 576 == 0 and len(r.payload) - len(raw) < 577 and len(r.rgb) == r.height * r.width * 3
    assert got[4].media == got[5].media and got[4].feature == got[5].feature
    assert media_columns(empty).count() == 0


def test_general_decoder_agrees_with_whole_arrays(monkeypatch):
    media = write_payload(bytes(range(256)) * 9)
    fast = Decoder(media)
    monkeypatch.setattr(Decoder, "_whole", lambda *a: False)
    slow = Decoder(media)
    assert all((p["coefs"] == q["coefs"]).all() for p, q in zip(fast.parts, slow.parts)) and fast.payload() == bytes(range(256)) * 9
    assert store_text("")["payload"] == b"\xff" * 576


def test_packing_is_exact_and_unpadded(hard, empty):
    path = tokenizer_path(WORD_MODEL)
    library = word_bpe(path).library
    rows = pack_documents(hard, path).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in HARD}
    for i, own in ids.items():
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist() and sum(r.length for r in pieces) == len(own) == pieces[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        total = sum(n for _, n in parts)
        assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
        assert total <= 2048 and total & (total - 1) == 0
    assert pack_documents(empty, path).count() == 0


def test_ids_take_two_bytes_or_four():
    import pyarrow as pa

    from quiverlake.llm.packing import _ids_of, _tokenized

    for kind, own in (("<u4", [1, 70_000]), ("<u2", [1, 700])):
        assert _ids_of(pa.py_buffer(np.array(own, kind).tobytes()), 2).tolist() == own
    texts = ["some words", None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], names=["doc_id", "text"])
    path = tokenizer_path(WORD_MODEL)
    for end in (1, 1 << 17):
        (out,) = _tokenized(iter([batch]), path, end)
        got = [_ids_of(r.as_buffer(), n).tolist() for r, n in zip(out.column("ids"), out.column("tokens").to_pylist())]
        assert got == [word_bpe(path).library.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def test_word_ids_equal_the_library():
    bpe = word_bpe(tokenizer_path(WORD_MODEL))
    for t in ("it's we'll I'D  é́ Ελλάς ΣΑΣ <|endoftext|>x a\x1cb　c ½²x İ ǅ 你好", "\n\n", " a\tb\r\n", "don't'S'll ...!!! a1b22", "\x85a\xa0b\x00c"):
        assert np.frombuffer(bpe.encode([t])[0], "<u4").tolist() == bpe.library.encode(t, add_special_tokens=False).ids


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert_key(grid, 3)
    assert sorted(keys) == list(range(512)) and np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1).max() == 1


def brute_secrets(text):
    out = []
    for order, (kind, pattern, ok) in enumerate((
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "", re.I if kind == "assign" else 0) if ok(m)]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secrets_equal_brute_force(spark, hard, empty):
    extra = ["secret=token =abcdefgh", "😀\x01 PASSWORD: 'a_b.c=d' token=short", "AKIAAKIA" + "B" * 20, "x, " + "0123456789abcdef" * 3, "key Zx9Qw7Lk3Vb5Nm1Pq8Rt2Ys4 and get_user_name_list_value ordinary", "token=abcdef" * 50]
    docs = spark.createDataFrame([(200 + i, t) for i, t in enumerate(extra)], "doc_id long, text string").union(hard.select("doc_id", "text"))
    got = by_id(secrets.find_secrets(docs))
    texts = dict(HARD) | {200 + i: t for i, t in enumerate(extra)}
    for i, t in texts.items():
        assert [(f.kind, f.start, f.end) for f in got[i].findings if f.kind != "random"] == brute_secrets(t)
        assert all(f.match == t[f.start : f.end] or "\x01" in t for f in got[i].findings)
    random = [f.match for r in got.values() for f in r.findings if f.kind == "random"]
    assert "Zx9Qw7Lk3Vb5Nm1Pq8Rt2Ys4" in random and "get_user_name_list_value" not in random
    out = secrets.find_secrets(docs.withColumn("kept", F.lit(1)), keep=("text", "kept")).withColumn("text", secrets.redact(F.col("text"), F.col("findings")))
    left = by_id(out)
    assert left[203].text == "x, [SECRET]" and left[0].text is None and left[3].text == "one two"
    assert secrets.find_secrets(empty).count() == 0


def test_random_keys_of_lower_case_letters_are_secrets(spark):
    rng = np.random.default_rng(4)
    keys = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n)) for n in (20, 24, 28, 32)]
    plain = ["donaudampfschifffahrtsgesellschaft", "internationalization", "antidisestablishmentarianism", "getusernamelistvalueindex"]
    docs = spark.createDataFrame([(i, f"the {k}, {w} and {k[:19]}") for i, (k, w) in enumerate(zip(keys, plain))], "doc_id long, text string")
    got = by_id(secrets.find_secrets(docs, keep=("text",)).withColumn("clean", secrets.redact(F.col("text"), F.col("findings"))))
    for i, (k, w) in enumerate(zip(keys, plain)):
        assert [(f.kind, f.match, f.start) for f in got[i].findings] == [("random", k, 4)]
        assert got[i].clean == f"the [SECRET], {w} and {k[:19]}"


def test_pipeline_stages_keep_the_columns(spark, hard, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    hard.select(*P.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(P.COLUMNS), name
        rows = out.collect()
        assert None in {r.doc_id for r in rows}
        if name == "near_dedup":
            kept = brute_components(TEXTS, 5, 80)
            assert {r.doc_id for r in rows} == {None} | {i for i in TEXTS if kept[i][2]}
    assert P.toxicity(spark, docs, str(tmp_path)).columns == list(P.COLUMNS)
    packed = P.run(spark, str(tmp_path))
    assert {"doc_id", "start", "length", "sequence_id"} <= set(packed.columns) and None in {r.doc_id for r in packed.collect()}
