"""Spelling variants by full neighbourhood generation.

Words are the maximal letter runs of all texts, A-Z in lower case; every run whose
checksum with its document's id is divisible by `noise` has lost one code point (a planted
slip).  Frequent, long enough words are the vocabulary.  Two words are near if one
insertion, deletion or replacement of a code point makes one the other.

1. Tasks count words in their batches first; one grouping by word adds the counts up.
2. For each word all distinct deletions, replacements and insertions over the alphabet seen
   in the vocabulary are generated, each once: a rolling hash gives every candidate's hash
   in one step.  A Bloom filter of the vocabulary (BITMAP words of 64 bits, whatever its
   size, two bits a word) lets few others through, and only what it lets through becomes a
   string.
3. A hash join of candidates with the vocabulary, on the strings, leaves the near words; no
   distance is computed.
4. A word's form is its near word with the largest count (the smaller word on ties), where
   that is at least `ratio` times its own.  Counts grow from form to form, so chains are
   short and cannot close; pointers are doubled until each stands on its root.

Nulls and texts without runs have no words.  A row with a null id counts with an empty id;
rows that repeat an id or a text are counted each by itself.  A very long text or run is
one batch by itself, its candidates are made in pieces.  An empty table has no words.
Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_stage, gathered, id_and_text, partitions, slices, stage_table
from .wordtable import LOWER, mix, utf8_column

#: Words of 64 bits of the Bloom filter.
BITMAP = 1 << 20
#: Counted words that a task holds before it hands them on, places whose candidates are made at once, and vocabulary words of a task.
HELD, PLACES, TASK = 400_000, 2048, 10_000
LETTER = np.array([chr(b).isalpha() if b < 128 else b == 0xC3 for b in range(256)])  # 0xC3 leads U+00C0 to U+00FF and nothing else
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    """The rolling hash's first n powers."""
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def letter_runs(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z in lower case, start, end, text number) of the runs of ASCII letters and U+00C0 to U+00FF."""
    data, offsets = utf8_column(column)
    inside = LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner], stops[inner - 1] = inside[inner], inside[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return LOWER[data], start, end, np.searchsorted(offsets, start, side="right") - 1


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray, long: int = 64) -> np.ndarray:
    """crc32 of each run, continued from the checksum `before` of what stands before it."""
    state, size = before ^ np.uint32(0xFFFFFFFF), end - start
    on = np.flatnonzero(size <= long)
    for k in range(int(size[on].max(initial=0))):
        on = on[size[on] > k]
        state[on] = CRC[(state[on] ^ data[start[on] + k]) & 0xFF] ^ state[on] >> np.uint32(8)
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > long):
        out[i] = zlib.crc32(data[start[i] : end[i]], int(before[i]))
    return out


def _words(batch: pa.RecordBatch, least: int, noise: int) -> pa.Array:
    """Every word of a batch with at least `least` code points, slips made."""
    data, start, end, text = letter_runs(batch.column("text"))
    points = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    keep = points[end] - points[start] >= least
    start, end, text = start[keep], end[keep], text[keep]
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("doc_id").to_pylist()], np.uint32)
    crc = checksums(data, start, end, before[text])
    slip = crc % noise == 0
    slipped = []
    for a, b, c in zip(start[slip].tolist(), end[slip].tolist(), crc[slip].tolist()):
        word = data[a:b].tobytes().decode()
        if len(word) > least:
            slipped.append(word[: c % len(word)] + word[c % len(word) + 1 :])
    start, end = start[~slip], end[~slip]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    kept = data[np.cumsum(edge[:-1]) > 0]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    whole = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(kept))
    return pa.concat_arrays([whole, pa.array(slipped, pa.large_string())])


def _counted(batches, least: int, noise: int):
    """(word, n), counted over as many batches as HELD words allow."""
    held = pa.table({"word": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})

    def added(pairs):
        return pa.concat_tables([held, *pairs]).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def rows(table):
        for made in table.cast(pa.schema({"word": pa.string(), "n": pa.int64()})).combine_chunks().to_batches(max_chunksize=50_000):
            yield made

    new, size = [], 0
    for whole in batches:
        for batch in slices(whole):
            seen = pc.value_counts(_words(batch, least, noise))
            new.append(pa.table({"word": seen.field("values"), "n": seen.field("counts")}))
            size += len(seen)
            if size > HELD:
                held, new, size = added(new), [], 0
                if len(held) > HELD // 2:
                    yield from rows(held)
                    held = held.slice(0, 0)
    yield from rows(added(new))


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, bits) in the filter of each hash; its two bits lie in one word."""
    one = np.uint64(1)
    return (hashes >> np.uint64(24)).astype(np.int64) % BITMAP, one << (hashes & np.uint64(63)) | one << (hashes >> np.uint64(6) & np.uint64(63))


def _places(words: list[str], step: int = PLACES):
    """Runs of places of words: (word numbers, place in the word, code points there, the hash of what stands before, whole hashes, powers)."""
    at, rows = 0, []
    for number, word in enumerate(words):
        points = np.frombuffer(word.encode("latin-1"), np.uint8)
        powers, before = _powers(len(points) + 1), np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_VALUE[points] * powers[:-1], out=before[1:])
        n = len(points) + 1  # the last place is after the word's end
        rows.append((np.full(n, number), np.arange(n), np.append(points.astype(np.int64), -1), before, np.full(n, before[-1]), powers))
        at += n
        if at >= step:
            yield from _pieces(rows, step)
            at, rows = 0, []
    if rows:
        yield from _pieces(rows, step)


def _pieces(rows, step):
    columns = [np.concatenate(c) for c in zip(*rows)]
    previous = np.where(columns[1] > 0, np.concatenate([[-1], columns[2][:-1]]), -1)
    for a in range(0, len(previous), step):
        yield [c[a : a + step] for c in (*columns, previous)]


def neighbours(words: list[str], alphabet: np.ndarray, filter_: np.ndarray | None = None):
    """(word numbers, candidates) of all distinct neighbours of the words that the filter lets through, piece by piece."""
    base, back = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))

    def passing(hashes, real):
        if filter_ is not None:
            place, bits = _bits(mix(hashes))
            real = real & (filter_[place] & bits == bits)
        return np.nonzero(real)

    for number, i, point, before, whole, power, previous in _places(words):
        inside = point >= 0
        after = whole - before - np.where(inside, _VALUE[point] * power, 0).astype(np.uint64)
        out, gone = [], passing(before + after * back, inside & (point != previous))[0]  # of equal neighbours one is deleted
        for k in gone.tolist():
            word, p = words[number[k]], int(i[k])
            out.append((number[k], word[:p] + word[p + 1 :]))
        letters = _VALUE[alphabet] * power[:, None]
        for k, x in zip(*(v.tolist() for v in passing((before + after)[:, None] + letters, inside[:, None] & (alphabet != point[:, None])))):
            word, p = words[number[k]], int(i[k])
            out.append((number[k], word[:p] + chr(alphabet[x]) + word[p + 1 :]))
        for k, x in zip(*(v.tolist() for v in passing((before + (whole - before) * base)[:, None] + letters, alphabet != previous[:, None]))):  # behind its equal a letter makes the same word
            word, p = words[number[k]], int(i[k])
            out.append((number[k], word[:p] + chr(alphabet[x]) + word[p:]))
        if out:
            yield [k for k, _ in out], [c for _, c in out]


def word_hash(word: str) -> np.uint64:
    points = np.frombuffer(word.encode("latin-1"), np.uint8)
    return (_VALUE[points] * _powers(len(points))).sum(dtype=np.uint64)


def _filter_rows(batches):
    """(place, bits) of the filter for the words of a task."""
    own = np.zeros(BITMAP, np.uint64)
    for batch in batches:
        place, bits = _bits(mix(np.array([word_hash(w) for w in batch.column("word").to_pylist()], np.uint64)))
        np.bitwise_or.at(own, place, bits)
    place = np.flatnonzero(own)
    for a in range(0, len(place), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(place[a : a + 100_000]), pa.array(own[place[a : a + 100_000]].view(np.int64))], names=["place", "bits"])


def _candidates(batches, alphabet: np.ndarray, sent):
    for batch in batches:
        words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        for numbers, made in neighbours(words, alphabet, sent.value):
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in numbers]), pa.array(counts[numbers]), pa.array(made)], names=["word", "n", "near"])


def spelling_variants(docs: DataFrame, least: int = 5, seen: int = 3, ratio: int = 2, noise: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least `least` code points and `seen` occurrences."""
    spark, source = docs.sparkSession, id_and_text(docs, id_col, text_col)
    counted = arrow_stage(source, lambda b: _counted(b, least, noise), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)
    known = stage_table(counted, "words", source)
    size = known.count()
    dealt = known.repartition(max(partitions(known), -(-size // TASK)), "word")
    letters = known.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct().collect()  # 90 at most
    alphabet = np.array(sorted(ord(r.letter) for r in letters if r.letter), np.int64)
    bits = arrow_stage(known, _filter_rows, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # BITMAP rows at most
    own = np.zeros(BITMAP, np.uint64)
    own[bits.column("place").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(own)
    made = arrow_stage(dealt, lambda b: _candidates(b, alphabet, sent), "word string, n long, near string")
    near = made.join(known.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    form = -F.col("best.m") >= ratio * F.col("n")
    out = known.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.m")).alias("form_n"))
    out = stage_table(out, "forms", source)
    return gathered(out.join(_roots(out.where("form is not null"), source), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), source)


def _roots(forms: DataFrame, like: DataFrame) -> DataFrame:
    """(word, root): pointers doubled until all stand; counts at least double from form to form, so 64-bit counts allow 6 rounds."""
    at = stage_table(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("stands")), "pointers", like)
    while not at.where("not stands").isEmpty():
        to = at.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("stands").alias("last"))
        moved = at.where("not stands").join(to, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.coalesce("last", F.lit(True)).alias("stands"))
        at = stage_table(at.where("stands").unionByName(moved), "pointers", like)
    return at.select("word", "root")
