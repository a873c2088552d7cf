"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

Items become windows of `width` consecutive words (an item of fewer is one window), and a
window becomes its shingles of SHINGLE words with their places.

1. One scan of the documents keeps the places where a shingle of some window stands.  A
   bitmap of bounded size (`maybe_in`) drops the others before anything is shuffled, and a
   join on the shingle's own words decides.
2. The kept places count how often each shingle occurs in all documents; each window's
   shingles are ordered by that.  A window occurs only where all its shingles stand, so its
   necessary prefix is one shingle, the rarest: |window| - |window| + 1.
3. Prefix shingles are joined with the kept places.  Each meeting proposes one start, from
   the shingle's place in the window (positional bound); a start before the text or an end
   after it goes (length bound).
4. A proposal is verified by the window's other shingles, which must all stand at their
   places.

Kept places are the only thing of the size of the corpus that is stored: a row of a few
bytes and a shingle for each, so a benchmark of common phrases costs more than one of rare
ones, and never more than a constant times the input.

Null and empty texts have no words.  A row with a null id is a document like others;
rows that repeat an id or a text are judged each by itself.  An item without id or words
is ignored; rows that repeat an item's id add their windows to it.  Without items every
document is clean.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, id_and_text, maybe_in, split_words, stage_table

SHINGLE = 5


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: a plain projection may be folded into each of its uses."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def item_windows(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, window, size, shingles): the windows of every item; `window` is its words, joined by a space."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null")
    rows = rows.select("item_id", F.filter(split_words("text"), lambda w: w != "").alias("words")).where("size(words) > 0")
    size = F.least(F.lit(width), F.size("words"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))
    rows = rows.select("item_id", F.explode(cuts).alias("words")).select("item_id", "words", F.size("words").alias("size"))
    least = F.least(F.lit(SHINGLE), F.col("size"))
    shingles = F.transform(F.sequence(F.lit(1), F.col("size") - least + 1), lambda i: F.array_join(F.slice("words", i, least), " "))
    return rows.select("item_id", F.array_join("words", " ").alias("window"), "size", shingles.alias("shingles")).distinct()


def _places(docs: DataFrame, tokens: DataFrame, widths: list[int]) -> DataFrame:
    """(row, doc_id, n_words, pos, shingle): every document once with pos -1, and the places where a token may stand."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    rows = _held(rows, "w", split_words("text")).drop("text")
    rows = rows.withColumn("first", (F.get("w", F.lit(0)) == "").cast("int")).withColumn("last", F.size("w") - (F.element_at("w", -1) == "").cast("int"))
    rows = _held(rows, "hashes", F.transform("w", lambda x: F.xxhash64(x)))
    rows = rows.withColumn("i", F.explode(F.sequence(F.col("first") - 1, F.greatest(F.col("first"), "last") - 1)))
    key = lambda k: F.xxhash64(F.lit(k), *(F.get("hashes", F.col("i") + j) for j in range(k)))
    if len(widths) == 1:
        rows = rows.withColumn("width", F.lit(widths[0])).withColumn("key", key(widths[0]))
    else:
        rows = rows.select("*", F.inline(F.array(*(F.struct(F.lit(k).alias("width"), key(k).alias("key")) for k in widths or [1]))))
    words = F.split("shingle", " ")
    keys = tokens.select(F.xxhash64(F.size(words), F.transform(words, lambda x: F.xxhash64(x))).alias("key"))
    there = (F.col("i") >= F.col("first")) & (F.col("i") + F.col("width") <= F.col("last"))
    rows = maybe_in(rows.withColumn("key", F.when(there, F.col("key"))), keys, "key", "near")
    base = (F.col("i") < F.col("first")) & (F.col("width") == (widths or [1])[0])
    shingle = F.when(F.col("near"), F.array_join(F.slice("w", F.col("i") + 1, F.col("width")), " "))
    return rows.where(F.col("near") | base).select("row", "doc_id", F.greatest(F.lit(0), F.col("last") - F.col("first")).alias("n_words"), (F.col("i") - F.col("first")).alias("pos"), shingle.alias("shingle"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items) for every row of docs: its words, those inside an occurrence of a window, and the sorted ids of the items met."""
    source = id_and_text(docs, id_col, text_col)
    windows = stage_table(item_windows(items, width, item_col, item_text_col), "windows", items)
    unique = windows.groupBy("window").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))  # a function of the window
    tokens = unique.select(F.explode("shingles").alias("shingle")).distinct()
    widths = sorted(r[0] for r in windows.select(F.least(F.lit(SHINGLE), "size")).distinct().collect())  # SHINGLE values at most
    places = stage_table(_places(source, tokens, widths), "places", source)
    hits = stage_table(places.where("pos >= 0").join(tokens, "shingle").select("row", "n_words", "pos", "shingle"), "hits", source)
    # Shingles by rarity, and each window's rarest.
    counts = hits.groupBy("shingle").agg(F.count("*").alias("n"))
    order = unique.select("window", "size", F.posexplode("shingles").alias("offset", "shingle")).join(counts, "shingle", "left")
    prefix = order.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset", "size")).alias("p")).where("p.n > 0").select("window", "p.shingle", "p.offset", "p.size")
    # Proposals within the bounds, then the other shingles.
    start = F.col("pos") - F.col("offset")
    proposed = hits.join(prefix, "shingle").select("row", "window", "size", start.alias("start"), "n_words").where("start >= 0 and start + size <= n_words")
    proposed = stage_table(proposed.select("row", "window", "size", "start"), "proposed", source)
    wanted = proposed.join(unique.select("window", "shingles"), "window").select("row", "window", "size", "start", F.size("shingles").alias("wanted"), F.posexplode("shingles").alias("offset", "shingle"))
    wanted = wanted.select("row", "window", "size", "start", "wanted", (F.col("start") + F.col("offset")).alias("pos"), "shingle")
    met = wanted.join(hits.select("row", "pos", "shingle"), ["row", "pos", "shingle"]).groupBy("row", "window", "size", "start", "wanted").agg(F.count("*").alias("n")).where("n = wanted")
    found = stage_table(met.select("row", "window", "size", "start"), "found", source)
    # Words under windows, and the items of the windows.
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    under = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")))
    hit = found.groupBy("row").agg(spans.alias("spans")).select("row", under["n"].alias("n_hit"))
    named = found.select("row", "window").distinct().join(windows.select("window", F.col("item_id").cast("string").alias("item")), "window")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = places.where("pos < 0").select("row", "doc_id", "n_words").join(hit, "row", "left").join(named, "row", "left")
    n_hit, there = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return gathered(out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), there.alias("items")), source)
