"""The queries opN_ themselves against brute force or SQL, every column, on the smallest tables and on a hard one; very long texts."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.llm.common import table
from quiverlake.llm.queries import LEARN, ORACLE_SQL, PIECE_MODEL, QUERIES, WORD_MODEL, tokenizer_path

SMALL = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"p{i}" for i in range(60))
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """A folder of tables with null, empty, odd, repeated and near equal texts, and columns beyond the known ones."""
    at = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(2)
    texts = [None, "", " \n\t ", "one two", "one two", PASSAGE + " tail", "head " + PASSAGE, PASSAGE + " " + PASSAGE, "é€😀▁ x  y\x01\x02 ½²İ", GRANT, " ".join(GRANT.split()[2:]),
             'mail a@b.c%d@e.fr 1.2.3.4.5 1.2.3.999 card 4111 1111 1111 1111 iban DE89 3704 0044 0532 0130 00 +1 (389) 555-5010 ssn 123-45-6789',
             'api_key: "abcDEF123/+" AKIA' + "Z9" * 9 + " " + "0af3" * 8 + " token=é Password = hunter2secret", "<|endoftext|> it's don't ...!!! 你好 世界"]
    base = [f"w{i}" for i in range(200)]
    for k in range(30):
        own = list(base)
        for i in rng.choice(200, int(rng.integers(0, 9)), replace=False):
            own[i] = f"e{k}x{i}"
        texts.append(" ".join(own))
    rows = [(i, t, "en", "s", len(t or ""), 0.5) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    items = [(0, GRANT + " x"), (1, PASSAGE), (2, "one two"), (3, ""), (4, None), (5, "ONE"), (6, " ".join(base[20:45])), (7, "é€ two")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def documents(spark, at):
    return {r.doc_id: r.text or "" for r in table(spark, at, "documents").select("doc_id", "text").collect()}


def rows_of(spark, name, at):
    return {r.doc_id: r for r in QUERIES[name](spark, at).collect()}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(params=["small", "hard"])
def at(request, hard):
    return SMALL if request.param == "small" else hard


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"op2_no_random_access"}))
def test_equals_sql(spark, at, name):
    import duckdb

    con = duckdb.connect()
    for name_ in ("documents", "benchmark"):
        con.execute(f"create view {name_} as select * from '{at}/{name_}.parquet{'' if at == SMALL else '/*.parquet'}'")
    df = QUERIES[name](spark, at)
    cols = sorted(df.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(want.select(*cols).fetchall(), key=str)


def test_op1(spark, at):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    got, texts = rows_of(spark, "op1_sentencepiece", at), documents(spark, at)
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = model.encode(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


def test_op1_with_a_character_map(spark, tmp_path):
    """The given model has an empty map; one with the library's own map goes through the longest-prefix lookup end to end."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    from quiverlake.llm.pieces import encode_documents

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(tokenizer_path(PIECE_MODEL), "rb").read())
    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.CopyFrom(rules.normalizer_spec)
    proto.normalizer_spec.add_dummy_prefix = True
    (tmp_path / "mapped.model").write_bytes(proto.SerializeToString())
    model = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "mapped.model"))
    texts = ["", "ＡＢＣ ｱ ﬁ  x", " a  b ", "①②③ é　z", "plain words here", None]
    got = {r.doc_id: r for r in encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "mapped.model")).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == model.encode(t or "") and got[i].decoded == model.decode(got[i].ids)
        raw = (t or "").encode()
        assert all(0 <= a <= b <= len(raw) for a, b in zip(got[i].begins, got[i].ends))
    assert [raw for raw in ("ＡＢＣ ｱ ﬁ  x".encode()[a:b].decode() for a, b in zip(got[1].begins, got[1].ends))][-1].strip() == "x"


def test_op3(spark, at):
    from quiverlake.llm import toxicity as X

    got, docs = rows_of(spark, "op3_toxicity", at), table(spark, at, "documents")
    net, texts = X.fit(docs, table(spark, at, "labels"), learn=LEARN), documents(spark, at)
    assert set(got) == set(texts)
    for i, t in list(texts.items())[:60]:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert abs(r.score - _brute_score(net, t)) < 1e-4


def _brute_score(net, text):
    """Every window by itself: the words of one window are a text of their own."""
    import pyarrow as pa

    words = re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.encode())
    best = 0.0
    for a in range(0, max(1, len(words) - 12), 12):
        own = b" ".join(words[a : a + 24])
        best = max(best, net.scores(pa.array([own], pa.large_binary()))[0])
        if a + 24 >= len(words):
            break
    return best


def test_op6(spark, at):
    got, texts = rows_of(spark, "op6_pii", at), documents(spark, at)
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    assert set(got) == set(texts)
    for i, t in texts.items():
        _same_spans(got[i], t, kinds)
    if at != SMALL:
        assert (got[11].n_email, got[11].n_ip, got[11].n_card, got[11].n_phone) == (2, 1, 1, 1) and "iban:" in got[11].spans and "ssn:" in got[11].spans


def _same_spans(row, text, kinds, flags={}):
    found = [(m.start(), k, name, m.end()) for k, (name, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text, flags.get(name, 0)) if ok(m)]
    base = [f"{name}:{a}:{b}" for a, _, name, b in sorted(found)]
    assert row.base_sha256 == sha(",".join(base))
    assert all(row[f"n_{name}"] == sum(f[2] == name for f in found) for name, *_ in kinds)
    spans = row.spans.split(",") if row.spans else []
    assert [s for s in spans if s.split(":")[0] in {k[0] for k in kinds}] == base
    assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_op10(spark, at):
    got, texts = rows_of(spark, "op10_markov_secrets", at), documents(spark, at)
    kinds = (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    assert set(got) == set(texts)
    for i, t in texts.items():
        _same_spans(got[i], t, kinds, {"assign": re.I | re.ASCII})


def test_op8(spark, at):
    from quiverlake.llm.jpeg import media_columns

    got, texts = rows_of(spark, "op8_progressive_jpeg", at), documents(spark, at)
    stored = {r.doc_id: bytes(r.media) for r in media_columns(table(spark, at, "documents")).select("doc_id", "media").collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        raw, r = t.encode(), got[i]
        payload = raw + b"\xff" * (576 - len(raw) if not raw else -len(raw) % 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), sha(stored[i]))
    same = {}
    for i, t in texts.items():
        assert same.setdefault(t, (got[i].media_sha256, got[i].feature, got[i].rgb_crc32)) == (got[i].media_sha256, got[i].feature, got[i].rgb_crc32)


def _image_io(spark):
    """The Java image library, a reader and writer that share nothing with ours."""
    jvm = spark.sparkContext._jvm
    jvm.javax.imageio.ImageIO.setUseCache(False)
    return jvm


def _decoded_by_java(spark, media):
    jvm = _image_io(spark)
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(media))
    w, h = image.getWidth(), image.getHeight()
    flat = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64)
    return np.stack([flat >> 16 & 255, flat >> 8 & 255, flat & 255], -1).reshape(h, w, 3)


def test_stored_files_read_the_same_elsewhere(spark):
    """An independent reader sees the same picture but for rounding and its smoother chroma."""
    from quiverlake.llm.jpeg import Decoder, store_text

    row = store_text("some text to store, " * 80)
    ours = Decoder(row["media"]).rgb().astype(int)
    theirs = _decoded_by_java(spark, row["media"])
    assert ours.shape == theirs.shape
    luma = lambda x: x @ [0.299, 0.587, 0.114]
    inside = ((ours > 0) & (ours < 255) & (theirs > 0) & (theirs < 255)).all(-1)
    if inside.any():
        assert np.abs(luma(ours) - luma(theirs))[inside].mean() < 12


@pytest.mark.parametrize("grey", [False, True])
def test_files_of_another_writer_are_read(spark, grey):
    """A progressive file by the Java library: the general reader gives the picture that the Java reader gives."""
    from quiverlake.llm.jpeg import Decoder

    jvm = _image_io(spark)
    w, h = 40, 24
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
    for y in range(h):
        for x in range(w):
            v = 4 * x + 2 * y
            image.setRGB(x, y, v << 16 | (v if grey else 128) << 8 | (v if grey else 200 - v // 2))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1)  # the writer's own scan script
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    writer.getOutput().flush()
    media = bytes(out.toByteArray())
    assert b"\xff\xc2" in media
    ours = Decoder(media).rgb().astype(int)
    if grey:  # its samples, since the Java library gives grey another gamma in RGB
        raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(media)).getRaster()
        theirs = np.repeat(np.frombuffer(bytes(raster.getDataBuffer().getData()), np.uint8).astype(int).reshape(h, w, 1), 3, -1)
    else:
        theirs = _decoded_by_java(spark, media)
    assert ours.shape == theirs.shape == (h, w, 3) and np.abs(ours - theirs).mean() < (1 if grey else 8)


def test_op9(spark, at):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(WORD_MODEL))
    rows, texts = QUERIES["op9_hilbert_packing"](spark, at).collect(), documents(spark, at)
    _is_packed(rows, {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()})


def _is_packed(rows, ids):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, own in ids.items():
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist() and sum(r.length for r in mine) == len(own)
        assert all(r.doc_tokens == len(own) and r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
    padding = 0
    for parts in sequences.values():
        total = sum(n for _, n in parts)
        assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist() and total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding == 0


def test_pipeline_equals_its_stages_by_brute_force(spark, hard):
    """run() against plain Python: the network's scores, all pairs, all windows, the findings of each text, the library's ids."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from quiverlake.llm import secrets, toxicity
    from test_operators import brute_components, brute_repeats

    docs = documents(spark, hard)
    net = toxicity.fit(table(spark, hard, "documents"), table(spark, hard, "labels"), learn=LEARN)
    ids = sorted(docs)
    kept = {i: docs[i] for i, s in zip(ids, net.scores(pa.array([docs[i] for i in ids]))) if s < 0.5}
    kept = {i: kept[i] for i, (_, _, own) in brute_components(kept, 5, 80).items() if own}
    kept = {i: left if removed else kept[i] for i, (_, removed, left) in brute_repeats(kept, 20).items()}
    found = {r.doc_id: r.findings for r in secrets.find_secrets(spark.createDataFrame(list(kept.items()), "doc_id long, text string")).collect()}
    library, want = Tokenizer.from_file(tokenizer_path(WORD_MODEL)), {}
    for i, t in kept.items():
        out, at = [], 0
        for f in found[i]:
            out += [t[at : f.start], "[SECRET]"] if f.start >= at else []
            at = max(at, f.end)
        want[i] = library.encode("".join(out) + t[at:], add_special_tokens=False).ids + [1]
    assert len(want) >= 8
    _is_packed(P.run(spark, hard).collect(), want)


def test_rows_that_repeat_an_id_are_documents_by_themselves(spark, tmp_path):
    import corpus_pipeline as P

    a, b = PASSAGE, " ".join(f"q{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (5, b), (7, b), (9, "alone in all the world"), (None, a), (None, None), (11, None), (11, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    left = sorted(((r.doc_id, r.text) for r in P.near_dedup(spark, docs, str(tmp_path)).collect()), key=str)
    assert left == sorted([(3, a), (7, b), (9, "alone in all the world"), (None, a), (None, None), (11, None), (11, "")], key=str)
    assert P.substring_dedup(spark, docs, "").count() == P.secret_scan(spark, docs, "").count() == len(rows)
    assert {r.doc_id for r in P.packing(spark, docs, "").collect()} == {i for i, _ in rows}


def test_every_operator_takes_repeated_and_null_ids(spark):
    from quiverlake.llm.jpeg import media_columns
    from quiverlake.llm.licenses import find_licenses
    from quiverlake.llm.packing import pack_documents
    from quiverlake.llm.pieces import encode_documents
    from quiverlake.llm.pii import find_personal_data
    from quiverlake.llm.secrets import find_secrets
    from quiverlake.llm.toxicity import score_documents, score_rows, train

    import pyarrow as pa

    rows = [(1, "mail a@b.co"), (1, "mail a@b.co"), (1, "token=abcdefgh"), (None, "All rights reserved."), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxicity", F.lit("x")).withColumn("findings", F.lit(1)).withColumn("a b", F.lit(2))
    net = train(pa.array(["good day", "bad day"] * 4), np.array([0, 1] * 4, np.float32), np.ones(8, np.float32))
    assert sorted(str(r.doc_id) for r in score_documents(docs, net).collect()) == ["1", "1", "1", "2", "None", "None"]
    assert score_rows(docs, net).columns == ["doc_id", "text", "findings", "a b", "toxicity"]
    got = sorted((str(r.doc_id), [f.kind for f in r.findings]) for r in find_personal_data(docs).collect())
    assert got == [("1", []), ("1", ["email"]), ("1", ["email"]), ("2", []), ("None", []), ("None", [])]
    got = sorted((str(r.doc_id), [f.kind for f in r.findings]) for r in find_secrets(docs).collect())
    assert got == [("1", []), ("1", []), ("1", ["assign"]), ("2", []), ("None", []), ("None", [])]
    assert [(r.doc_id, r.template) for r in find_licenses(docs).collect()] == [(None, "reserved")]
    assert media_columns(docs).count() == encode_documents(docs, tokenizer_path(PIECE_MODEL)).count() == len(rows)
    assert pack_documents(docs, tokenizer_path(WORD_MODEL)).agg(F.count_if(F.col("start") == 0)).first()[0] == len(rows)


LONG = {
    "letters": "a" * 2_000_000, "digits": "7" * 2_000_000, "dots": "1." * 500_000, "spaces": "x" + " " * 1_000_000 + "y", "words": " ".join(f"w{i % 5000}" for i in range(300_000)),
    "chinese": "".join(chr(0x4E00 + random.Random(1).randrange(2000)) for _ in range(1000)) * 300, "random": "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=1_000_000)),
}


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "op2_no_random_access"])
def test_very_long_texts_take_seconds(spark, tmp_path, name):
    rows = [(i, t) for i, t in enumerate([*LONG.values(), *(f"{'bad' if k % 2 else 'good'} words {k}" for k in range(40))])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(len(LONG) + k, k % 2) for k in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    began = time.time()
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert time.time() - began < 90
    if name not in ("op4_license_windows", "op9_hilbert_packing"):
        assert len(got) == len(rows)
    if name == "op7_super_kmers":
        word = dict(zip(range(7), LONG.values()))[4].split()
        seen, gone = set(), np.zeros(len(word), bool)
        for k in range(len(word) - 19):
            own = tuple(word[k : k + 20])
            if own in seen:
                gone[k : k + 20] = True
            seen.add(own)
        row = next(r for r in got if r.doc_id == 4)
        assert (row.n_words, row.n_removed) == (len(word), int(gone.sum()))


def test_caches_hold_short_chunks_only():
    from quiverlake.llm.packing import word_bpe
    from quiverlake.llm.pieces import piece_encoder

    pieces, words = piece_encoder(tokenizer_path(PIECE_MODEL)), word_bpe(tokenizer_path(WORD_MODEL))
    texts = [LONG["chinese"][k : k + 5000] for k in range(20)]
    assert [i.tolist() for i in pieces.ids(texts)] == pieces.model.encode(texts)
    words.encode(texts)
    assert all(len(c) <= 64 for c in [*pieces.cache, *words.cache, *words.cache.old])
