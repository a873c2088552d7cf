"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

1. Every document becomes its set of distinct word shingles (64-bit hashes).  Documents
   with equal sets form one class, which its smallest id represents from here on.
2. A representative's SuperMinHash signature (each shingle walks a random permutation of
   the slots; its j-th step offers j plus a random fraction to the slot reached; a set
   stops when no slot can improve) is cut into bands.  Representatives that agree in a
   band are candidates.
3. Every candidate is compared with one head, the smallest representative of a band, that
   it shares the most bands with: a star whose rows a hot head deals out in blocks, so its
   work grows with the number of copies and not with their square.
4. What that links falls together.  Only bands whose members still lie apart are left; each
   is a unit by itself (one for all bands with the same members), so no two sets meet that
   share no band.  A unit's members are compared in pairs of blocks of bounded size; it
   returns a spanning forest of its links, not all links.
5. Union-find gives the components.  Every pair that shares a band is so either linked
   through others or compared on its full shingle sets.

Nulls, empty texts and texts without words have empty sets and are linked with nothing.
With fewer words than a shingle has, the whole sequence is one shingle.  Equal texts are
one class, whatever their number.  A row with a null id is linked with nothing; its
component and `kept` are null.  If an id repeats, its sets are linked through it
(`numbered` gives rows ids of their own).  A very long text is one block by itself.  An
empty table gives an empty result.  Other columns are ignored, whatever their names.

Two sets at similarity s share one of `bands` bands of `rows` slots with probability
1 - (1 - s^rows)^bands: with the defaults 1 - 6e-7 at 0.8 and more above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_stage, gathered, id_and_text, maybe_in, partitions, slices, stage_table
from .components import components
from .wordtable import WordTable, mix, window_hashes

ROWS, BANDS = 5, 36
#: Representatives in a block, and their shingles; a unit of work holds two blocks.
BLOCK, BLOCK_SHINGLES = 256, 400_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after another, and their offsets."""
    words = WordTable(column, lower=True)
    n = len(words.first) - 1
    sets = []
    for i in range(n):
        own = words.hashes[words.first[i] : words.first[i + 1]]
        sets.append(np.unique(window_hashes(own, min(width, len(own)))) if len(own) else own)
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def super_minhash(values: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures (sets x slots) of sets of 64-bit hashes.

    The walk over a permutation is Fisher-Yates with the swaps replayed from the steps so
    far, so an element that stops early costs only its steps.  A slot value holds the step
    number in its top bits and a random fraction below.
    """
    sets = len(offsets) - 1
    signature = np.full(sets * slots, np.uint64(0xFFFFFFFFFFFFFFFF))
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    values, swapped, moved = values.copy(), [], []
    for j in range(slots):
        if j:
            worst = signature.reshape(sets, slots).max(1) >> np.uint64(56)
            on = worst[owner] >= j
            if not on.all():
                owner, values = owner[on], values[on]
                swapped, moved = [k[on] for k in swapped], [w[on] for w in moved]
        if not len(owner):
            break
        draw = mix(values + np.uint64((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        pick = (j + (mix(draw) >> np.uint64(32)) * np.uint64(slots - j) // np.uint64(1 << 32)).astype(np.int16)
        slot, own = pick.copy(), np.full(len(pick), j, np.int16)
        for k, w in zip(swapped, moved):  # the latest swap that touched a place counts
            np.copyto(slot, w, where=k == pick)
            np.copyto(own, w, where=k == j)
        np.minimum.at(signature, owner * slots + slot, np.uint64(j) << np.uint64(56) | draw >> np.uint64(8))
        swapped.append(pick)
        moved.append(own)
    return signature.reshape(sets, slots)


def _bands(batches, width: int, rows: int, bands: int):
    for whole in batches:
        for batch in slices(whole, most=1 << 20):
            values, offsets = shingle_sets(batch.column("text"), width)
            sizes = np.diff(offsets)
            signature = super_minhash(values, offsets, rows * bands)
            band = np.zeros((len(sizes), bands), np.uint64)
            for r in range(rows):
                band = mix(band * _GOLD + signature[:, r::rows]) + np.arange(bands, dtype=np.uint64)
            sums = [np.cumsum(np.append(np.uint64(0), mix(values + np.uint64(seed))), dtype=np.uint64) for seed in (11, 23)]
            keys = [(s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums]  # of the set, in any order
            lists = pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * bands, band.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), *map(pa.array, keys), lists], names=["doc_id", "n_shingles", "key1", "key2", "bands"])


def _links(sets: list[np.ndarray], split: int, percent: int) -> np.ndarray:
    """Boolean matrix of the links among sets; with split > 0 only between those before and from it."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
        common[1] = common[0, ::-1]
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        shared = np.repeat(np.diff(np.append(begins, len(flat))), np.diff(np.append(begins, len(flat)))) > 1
        column = (np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1)[shared]
        owner = owner[shared]
        common = np.zeros((n, n), np.float32)
        at = 0
        while at < len(column):  # few columns of the incidence matrix at a time
            low = column[at]
            to = np.searchsorted(column, low + 4096)
            part = np.zeros((n, int(column[to - 1] - low) + 1), np.float32)
            part[owner[at:to], column[at:to] - low] = 1
            common += part @ part.T
            at = to
        common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    link = 100 * common >= percent * union
    np.fill_diagonal(link, False)
    if split:
        link[:split, :split] = link[split:, split:] = False
    return link


def _spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a link matrix."""
    todo, out = np.ones(len(link), bool), []
    for root in range(len(link)):
        if not todo[root]:
            continue
        todo[root] = False
        stack = [root]
        while stack:
            x = stack.pop()
            new = np.flatnonzero(link[x] & todo)
            todo[new] = False
            out += [(x, int(y)) for y in new]
            stack += new.tolist()
    return out


def _common(one: np.ndarray, other: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(other, one)
    at[at == len(other)] = 0
    return int((other[at] == one).sum()) if len(other) else 0


def _verify_stars(batches, width: int, percent: int):
    """Rows come sorted by unit and block, the unit's head (role 0) first; links of members with their head."""
    unit, heads = None, []  # more than one head only where an id repeats
    for whole in batches:
        for batch in slices(whole):
            values, offsets = shingle_sets(batch.column("text"), width)
            a, b = [], []
            for at, (own, block, role, rep) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("unit", "block", "role", "rep")))):
                one = values[offsets[at] : offsets[at + 1]]
                if role == 0:
                    heads = [*(heads if unit == (own, block) else []), one.copy()]
                    unit = (own, block)
                elif any(100 * (n := _common(one, head)) >= percent * (len(one) + len(head) - n) for head in heads):
                    a.append(rep)
                    b.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verify(batches, width: int, percent: int):
    """Rows come sorted by unit of work; a unit's links leave as a spanning forest."""
    unit, held = None, []

    def done():
        if len(held) < 2:
            return None
        texts = pa.array([h[2] for h in held], pa.large_string())
        values, offsets = shingle_sets(texts, width)
        split = sum(h[0] == held[0][0] for h in held) if unit[1] != unit[2] else 0
        edges = _spanning(_links([values[a:b] for a, b in zip(offsets, offsets[1:])], split, percent))
        if not edges:
            return None
        return pa.RecordBatch.from_arrays([pa.array([held[x][1] for x, _ in edges], pa.int64()), pa.array([held[y][1] for _, y in edges], pa.int64())], names=["a", "b"])

    for whole in batches:
        for batch in slices(whole):
            for group, low, high, block, rep, text in zip(*(batch.column(c).to_pylist() for c in ("unit", "low", "high", "block", "rep", "text"))):
                if (group, low, high) != unit:
                    if held and (made := done()):
                        yield made
                    unit, held = (group, low, high), []
                held.append((block, rep, text))
    if held and (made := done()):
        yield made


def _rank(keys: DataFrame) -> DataFrame:
    """Each member's head (a, b): the one it shares the most bands with, the smallest on ties."""
    shared = keys.groupBy("a", "b").agg(F.count("*").alias("n"))
    return shared.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))


def _with_texts(dealt: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of work (rep, ...) with the text of each; the other texts do not travel."""
    there = maybe_in(source.select(F.col("doc_id").alias("rep"), "text"), dealt, "rep", "near")
    return there.where("near").drop("near").join(dealt, "rep")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets.
    """
    source = id_and_text(docs, id_col, text_col)
    parts = partitions(source)
    signed = stage_table(arrow_stage(source, lambda b: _bands(b, width, rows, bands), "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stage_table(full.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep")), "classes", source)
    reps = full.join(classes.withColumnRenamed("rep", "doc_id"), ["key1", "key2", "doc_id"], "left_semi")
    banded = reps.select(F.col("doc_id").alias("rep"), "n_shingles", F.explode("bands").alias("bucket"))  # the hash has its band's number in it
    heads = banded.groupBy("bucket").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").select("bucket", "head")
    met = stage_table(banded.join(heads, "bucket"), "met", source)  # bands with two members or more
    # Stars.
    star = stage_table(_rank(met.where("rep > head").select(F.col("rep").alias("a"), F.col("head").alias("b"))), "stars", source)
    sizes = star.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = star.join(sizes, "b").select(F.col("b").alias("unit"), F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), F.col("a").alias("rep"))
    middle = sizes.select(F.col("b").alias("unit"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("b").alias("rep"))
    work = _with_texts(member.unionByName(middle), source.where("doc_id is not null")).select("unit", "block", "role", "rep", "text")
    work = work.repartition(parts, "unit", "block").sortWithinPartitions("unit", "block", "role")
    links = stage_table(arrow_stage(work, lambda b: _verify_stars(b, width, percent), "a long, b long"), "links", source)
    # Bands whose members still lie apart.
    first = components(links)
    lies = met.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n_shingles", F.coalesce("component", "rep").alias("lot"))
    lies = stage_table(lies, "lots", source)
    both = [F.bit_xor(F.xxhash64("rep", F.lit(seed))).alias(f"k{seed}") for seed in (1, 2)]
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    apart = lies.groupBy("bucket").agg(F.min("lot").alias("low"), F.max("lot").alias("high"), F.count("*").alias("n"), blocks, *both).where("low < high")
    units = stage_table(apart.groupBy("n", "k1", "k2").agg(F.min("bucket").alias("unit"), F.first("blocks").alias("blocks")), "units", source)
    dealt = lies.withColumnRenamed("bucket", "unit").join(units.select("unit", "blocks"), "unit")
    dealt = dealt.select("unit", "rep", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    pairs = _with_texts(dealt, source.where("doc_id is not null")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("unit", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "text")
    pairs = pairs.repartition(parts, "unit", "low", "high").sortWithinPartitions("unit", "low", "high", "block")
    links = links.unionByName(arrow_stage(pairs, lambda b: _verify(b, width, percent), "a long, b long"))
    same = full.join(classes, ["key1", "key2"]).select("doc_id", "rep")
    own = same.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("doc_id")  # only if an id repeats
    links = links.unionByName(same.join(own, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    linked = components(stage_table(links, "links", source))  # a table, so that no task runs two Python stages
    out = signed.join(classes, ["key1", "key2"], "left").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return gathered(out.withColumn("kept", F.col("doc_id") == F.col("component_id")), source)


def numbered(docs: DataFrame, id_col: str = "doc_id", name: str = "row_id") -> DataFrame:
    """docs with an id for each row: its own where that occurs once, one above all ids where it repeats; null stays null."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null")
    again = stage_table(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again", docs)
    marked = maybe_in(docs.withColumn(name, F.col(id_col).cast("long")), again.withColumnRenamed("doc_id", name), name, "__again")
    above = ids.agg(F.coalesce(F.max("doc_id"), F.lit(0)) + 1).first()[0]
    more = marked.where("__again").drop("__again").withColumn(name, F.lit(above) + F.monotonically_increasing_id())
    return marked.where("not __again").drop("__again").unionByName(stage_table(more, "numbered", docs))
