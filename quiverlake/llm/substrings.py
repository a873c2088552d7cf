"""Removal of word sequences that occur earlier, by super-k-mer partitioning.

A window is `width` consecutive words of one document.  A word goes if a window that
covers it has the same words as a window that starts earlier (in a smaller id, or in the
same document before it).  Windows are judged on the input.

1. Each window has a minimiser, the smallest hash among its runs of MER words.
   Consecutive windows that share it form a super-k-mer.  Within a slice of the input
   windows are sorted, and one whose words an earlier one of the slice has is decided at
   once and does not travel, so that a passage in a third of all rows costs each bucket
   one entry a slice.
2. Minimisers are dealt to buckets by hash; super-k-mers whose minimiser occurs once
   cannot hold a repeated window and stop here.  Windows decided in step 1 pass through.
   The others of a minimiser are numbered, and every SALT of them are a group.
3. They are cut from their documents as packed strings and travel to their group, where
   sorting brings equal windows together, earliest first.
4. Of a minimiser with several groups the first window of each kind and group travels on
   by itself, and a last sort by the window's words decides.
5. Ranges of repeated windows return to their documents, whose other words are kept.

Hashes propose, words decide: a window only goes where its words have been compared.  In
steps 3 and 5 a bitmap of document ids, of bounded size, tells which texts may be
concerned; the others stay where they are read.

Nulls, empty texts and texts of fewer words lose nothing.  Kept words are joined by one
space.  Rows with a null id take no part and lose nothing.  Rows that repeat an id are
told apart by their texts; none of them starts earlier than another at the same word, so
rows equal in id and text are treated alike.  A very long text is one slice by itself
and its windows are spread over all buckets; a very long word is compared as any other.
An empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import arrow_stage, gathered, id_and_text, maybe_in, partitions, slices, stage_table
from .wordtable import WordTable, window_hashes

WIDTH, MER = 20, 8
#: Super-k-mers of one minimiser that meet in one group.
SALT = 400
#: Runs or windows that a task holds before it reduces them to what is distinct.
HELD = 200_000
#: Bytes of text that are looked at together before anything travels.
SLICE = 2 << 20
_RUN = np.dtype([("minimiser", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("first", "<i4"), ("count", "<i4")])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _pack(runs: np.ndarray) -> bytes:
    """Column by column, which compresses better than row by row."""
    return b"".join(np.ascontiguousarray(runs[c]).tobytes() for c in _RUN.names)


def _unpack(raw: bytes) -> np.ndarray:
    n, at = len(raw) // _RUN.itemsize, 0
    out = np.empty(n, _RUN)
    for c in _RUN.names:
        size = _RUN[c].itemsize * n
        out[c] = np.frombuffer(raw[at : at + size], _RUN[c])
        at += size
    return out


def _ranges(row: np.ndarray, place: np.ndarray, minimiser: np.ndarray, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Runs of consecutive windows (places) of one row with one minimiser; doc and key are of the rows."""
    if not len(row):
        return np.zeros(0, _RUN)
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (minimiser[1:] != minimiser[:-1])])
    at = np.flatnonzero(new)
    out = np.empty(len(at), _RUN)
    out["minimiser"], out["doc"], out["key"], out["first"], out["count"] = minimiser[at], doc[row[at]], key[row[at]], place[at], np.diff(np.append(at, len(row)))
    return out


def _window_order(doc: np.ndarray, place: np.ndarray, same) -> np.ndarray:
    """Windows sorted by `same`, ties by document and place."""
    first = np.lexsort((place, doc))
    return first[np.argsort(same[first], kind="stable")]


def _decided(words: WordTable, at: np.ndarray, doc: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Which windows of a slice repeat an earlier one of it; `at` are their first words."""
    same = window_hashes(words.hashes, width)[at]
    order = _window_order(doc, place, same)
    begins = np.concatenate([[True], same[order][1:] != same[order][:-1]])
    head = np.empty(len(order), np.int64)
    head[order] = order[np.flatnonzero(begins)][np.cumsum(begins) - 1]
    later = np.flatnonzero((doc != doc[head]) | (place != place[head]))
    if not len(later):
        return np.zeros(len(at), bool)
    # Runs of windows that repeat the windows at one distance before: their words are compared once.
    own, far = at[later], at[later] - at[head[later]]
    new = np.concatenate([[True], (own[1:] != own[:-1] + 1) | (far[1:] != far[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(later))) + width - 1
    begin = np.cumsum(size) - size
    word = np.arange(int(size.sum())) + np.repeat(own[first] - begin, size)
    unlike = np.concatenate([[0], np.cumsum(~words.same(word, word - np.repeat(far[first], size)))])
    run = np.cumsum(new) - 1
    place_in = begin[run] + own - own[first[run]]
    out = np.zeros(len(at), bool)
    out[later[unlike[place_in + width] == unlike[place_in]]] = True
    return out


def _super_kmers(batches, width: int, mer: int, buckets: int, slice_bytes: int):
    """(bucket, runs): undecided super-k-mers by bucket; negative buckets have windows that repeat within the slice."""
    for whole in batches:
        for batch in slices(whole, most=slice_bytes):
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
            words = WordTable(batch.column("text"))
            per = np.maximum(np.diff(words.first) - width + 1, 0)
            if not per.sum():
                continue
            row = np.repeat(np.arange(len(per)), per)
            place = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            at = words.first[row] + place
            least = _sliding_min(window_hashes(words.hashes, mer), width - mer + 1)[at]
            gone = _decided(words, at, ids[row], place, width)
            decided = _ranges(row[gone], place[gone], np.zeros(int(gone.sum()), np.uint64), ids, keys)
            runs = _ranges(row[~gone], place[~gone], least[~gone], ids, keys)
            bucket = (runs["minimiser"] % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) != 0])) if len(by) else []
            parts = np.split(runs[by], cuts[1:]) if len(by) else []
            names = [int(bucket[by[c]]) for c in cuts]
            if len(decided):
                names.append(-1 - int((ids[0] * 31 + len(ids)) % buckets))  # any one will do: spread over the tasks
                parts.append(decided)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([_pack(p) for p in parts], pa.binary())], names=["bucket", "runs"])


RUN_ROWS = "doc_id long, key long, first int, count int, minimiser long, salt int, decided boolean"


def _run_rows(runs: np.ndarray, salt: np.ndarray | None) -> pa.RecordBatch:
    salts = pa.array(np.zeros(len(runs), np.int32) if salt is None else salt.astype(np.int32))
    columns = [pa.array(runs[c]) for c in ("doc", "key", "first", "count")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(runs["minimiser"].view(np.int64)), salts, pa.array(np.full(len(runs), salt is None))], names=["doc_id", "key", "first", "count", "minimiser", "salt", "decided"])


class _Minimisers:
    """The minimisers of a bucket so far, how often each has come, and the runs of those that came once."""

    def __init__(self):
        self.names, self.times, self.lone = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, _RUN)

    def add(self, runs: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """The runs whose minimiser is not alone any more, and their groups."""
        runs = runs[np.argsort(runs["minimiser"], kind="stable")]
        names, begins, counts = np.unique(runs["minimiser"], return_index=True, return_counts=True)
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == names[inside]
        before = np.zeros(len(names), np.int64)
        before[known] = self.times[at[known]]
        total = before + counts
        rank = np.arange(len(runs)) - np.repeat(begins, counts) + np.repeat(before, counts)
        leaves = np.repeat(total > 1, counts)
        met = self.lone[np.isin(self.lone["minimiser"], names[known], assume_unique=True)]
        out, group = np.concatenate([met, runs[leaves]]), np.concatenate([np.zeros(len(met), np.int64), rank[leaves] // salt])
        self.lone = np.concatenate([self.lone[~np.isin(self.lone["minimiser"], names[known], assume_unique=True)], runs[~leaves]])
        self.times[at[known]] = total[known]
        fresh = ~known
        merged = np.concatenate([self.names, names[fresh]])
        order = np.argsort(merged, kind="stable")
        self.names, self.times = merged[order], np.concatenate([self.times, total[fresh]])[order]
        return out, group


def _repeated(batches, salt: int, most: int):
    """Decided windows, and super-k-mers whose minimiser another one shares; rows come sorted by bucket."""
    held, n, bucket, seen = [], 0, None, _Minimisers()

    def reduced():
        runs = np.concatenate(held)
        return _run_rows(runs, None) if bucket < 0 else _run_rows(*seen.add(runs, salt))

    for batch in batches:
        for name, raw in zip(batch.column("bucket").to_pylist(), batch.column("runs")):
            if held and (name != bucket or n > max(most, len(seen.names))):
                yield reduced()
                held, n = [], 0
            if name != bucket:
                bucket, seen = name, _Minimisers()
            held.append(_unpack(raw.as_py()))
            n += len(held[-1])
    if held:
        yield reduced()


def _cut(batches, width: int, buckets: int):
    """Super-k-mers as packed strings: the words of all their windows, joined by one space."""
    names = ["bucket", "salt", "hot", "doc_id", "key", "first", "packed"]
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for whole in batches:
        for batch in slices(whole):
            rows = []
            for doc, key, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text", "runs"))):
                words = text.encode().split()
                for run in runs:
                    packed = b" ".join(words[run["first"] : run["first"] + run["count"] + width - 1])
                    rows.append((run["minimiser"] % buckets, run["salt"], run["hot"], doc, key, run["first"], packed))
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


PACKED = "bucket int, salt int, hot boolean, doc_id long, key long, first int, packed binary"
COUNTED = "doc_id long, key long, first int, count int, window binary"


def _count(batches, width: int, most: int):
    """Ranges of a group's windows that an equal one precedes, and the other windows of hot minimisers.

    Rows come sorted by group, id and place.  A group's windows are sorted in lots of whole
    documents; of the lots before, the first of all equal windows is kept.
    """
    group, held, n, heads = None, [], 0, {}

    def reduced(more: bool):
        keep = more or bool(heads)
        windows, docs, keys, places, hot = [], [], [], [], []
        for doc, key, first, packed, warm in held:
            starts, at = [0], packed.find(b" ")
            while at >= 0:
                starts.append(at + 1)
                at = packed.find(b" ", at + 1)
            starts.append(len(packed) + 1)
            m = len(starts) - width
            windows += [packed[starts[k] : starts[k + width] - 1] for k in range(m)]
            docs += [doc] * m
            keys += [key] * m
            places += range(first, first + m)
            hot += [warm] * m
        doc, key, place = np.array(docs, np.int64), np.array(keys, np.int64), np.array(places, np.int32)
        order = sorted(np.lexsort((place, key, doc)).tolist(), key=windows.__getitem__)
        later = np.zeros(len(docs), bool)
        window = head = None
        for x in order:
            if windows[x] != window:
                window = windows[x]
                head = heads.setdefault(window, (docs[x], places[x])) if keep else (docs[x], places[x])
            later[x] = (docs[x], places[x]) != head
        number = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
        at = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1])
        runs = _ranges(number[later], place[later], np.zeros(int(later.sum()), np.uint64), doc[at], key[at])
        on = np.flatnonzero(np.array(hot, bool) & ~later)
        columns = [np.concatenate([runs[c], x]) for c, x in (("doc", doc[on]), ("key", key[on]), ("first", place[on]), ("count", np.ones(len(on), np.int32)))]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([None] * len(runs) + [windows[x] for x in on], pa.binary())], names=["doc_id", "key", "first", "count", "window"])

    for whole in batches:
        for batch in slices(whole, "packed"):
            for bucket, salt, warm, doc, key, first, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((bucket, salt) != group or n > most and doc != held[-1][0]):
                    yield reduced((bucket, salt) == group)
                    held, n = [], 0
                if (bucket, salt) != group:
                    group, heads = (bucket, salt), {}
                held.append((doc, key, first, packed, warm))
                n += packed.count(b" ") + 2 - width
    if held:
        yield reduced(False)


def _keep(batches, width: int):
    for whole in batches:
        for batch in slices(whole):
            rows = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                words = (text or "").encode().split()
                kept = words
                if ranges:
                    edge = np.zeros(len(words) + 1, np.int32)
                    first = np.array([r["first"] for r in ranges])
                    np.add.at(edge, first, 1)
                    np.add.at(edge, np.minimum(first + [r["count"] + width - 1 for r in ranges], len(words)), -1)
                    stay = np.cumsum(edge[:-1]) <= 0
                    kept = [w for w, s in zip(words, stay.tolist()) if s]
                rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            cols = list(zip(*rows)) or [[]] * 3
            own = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *own, *([batch.column("row")] if "row" in batch.schema.names else [])], names=["doc_id", "n_words", "n_removed", "kept", *["row"] * ("row" in batch.schema.names)])


def remove_repeats(docs: DataFrame, width: int = WIDTH, mer: int = MER, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, salt: int = SALT, held: int = HELD, slice_bytes: int = SLICE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): one row for each row of docs; with `carry` also that whole row, as a struct."""
    if not 0 < mer <= width:
        raise ValueError("a minimiser lies inside a window")
    source = like = id_and_text(docs, id_col, text_col)
    parts = partitions(like)
    out = StructType([StructField("doc_id", LongType()), *(StructField(c, LongType()) for c in ("n_words", "n_removed")), StructField("kept", StringType())])
    if carry:
        source = gathered(docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
        out = out.add(StructField("row", docs.schema))
    again = stage_table(source.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is not null and n > 1").select("doc_id"), "again", like)
    source = maybe_in(source, again, "doc_id", "again").withColumn("key", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0))).drop("again")
    there = source.where("doc_id is not null and text is not null").select("doc_id", "key", "text")
    buckets = 4 * parts
    found = arrow_stage(there, lambda b: _super_kmers(b, width, mer, buckets, slice_bytes), "bucket int, runs binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    runs = stage_table(arrow_stage(found, lambda b: _repeated(b, salt, held), RUN_ROWS), "superkmers", like)
    open_ = runs.where("not decided")
    flagged = maybe_in(open_, open_.where("salt > 0").select("minimiser").distinct(), "minimiser", "hot")
    repeated = flagged.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "count", "minimiser", "salt", "hot")).alias("runs"))
    near = maybe_in(there, open_, "doc_id", "near").where("near").drop("near")
    packed = arrow_stage(near.join(repeated, ["doc_id", "key"]), lambda b: _cut(b, width, buckets), PACKED)
    packed = packed.repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", "doc_id", "first")
    counted = stage_table(arrow_stage(packed, lambda b: _count(b, width, held), COUNTED), "counted", like)
    spans = ("doc_id", "key", "first", "count")
    start = F.struct("doc_id", "first")
    last = counted.where("window is not null").withColumn("start", start)
    heads = last.groupBy("window").agg(F.min("start").alias("head"), F.max("start").alias("last")).where("head <> last").select("window", "head")
    last = last.join(heads, "window").where("start <> head")
    ranges = counted.where("window is null").select(*spans).unionByName(runs.where("decided").select(*spans)).unionByName(last.select(*spans))
    ranges = stage_table(ranges, "ranges", like)
    source = maybe_in(source, ranges, "doc_id", "near")
    ranges = ranges.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "count")).alias("ranges"))
    touched = source.where("near").drop("near").join(ranges, ["doc_id", "key"], "left")
    untouched = source.where("not near").drop("near").withColumn("ranges", F.lit(None).cast("array<struct<first:int,count:int>>"))
    return gathered(arrow_stage(touched, lambda b: _keep(b, width), out).unionByName(arrow_stage(untouched, lambda b: _keep(b, width), out)), like)
