"""Secrets, by DataFrame functions alone: patterns, and character Markov models for what has no pattern.

Base kinds are `assign` (a value given to a name such as password or token), `access`
(AKIA keys) and `hex` (runs of 24 or more).  The method adds `random`: tokens of MIN_RANDOM
or more characters whose log-likelihood under a bigram model of random strings exceeds that
under a model of ordinary identifiers by THRESHOLD nats a character.

Matches get their offsets from a marked copy of the text: each match is put between
marks, the copy is split at them, and the lengths of the parts before a match add up to
its start, by prefix sums over runs of parts.  The mark is a control character that no
pattern can match; where a text holds it, another of one byte takes its place first.
Offsets are code points, ends exclusive; byte_start and byte_end are UTF-8 bytes.

A very long text or token takes time in proportion to its length: tokens are scored a
stretch at a time, texts are cut by bytes.  An empty table gives an empty result.  Nulls
and empty texts have no findings.  Spans sort by start, then in the order of KINDS.
Rows with equal or null ids are scanned each by itself.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, id_and_text

KINDS = ("assign", "access", "hex", "random")
MARK, INNER, OTHER = "\u0001", "\u0002", "\u0003"
MIN_VALUE, MIN_RANDOM, THRESHOLD = 6, 20, 0.5
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": (ASSIGN, f"{MARK}$1{INNER}$2{MARK}"),
    "access": (r"AKIA[A-Z0-9]{16,}", f"{MARK}$0{MARK}"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", f"{MARK}$0{MARK}"),
    "random": (rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_RANDOM},}}", f"{MARK}$0{MARK}"),
}
#: Texts without this have no match of the kind; it spares copying them.
HINTS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{24}", "random": rf"[A-Za-z0-9+/_-]{{{MIN_RANDOM}}}"}

#: Symbols of the models; any other character is the last symbol.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Words from which the labelled samples of ordinary identifiers are put together.
STEMS = (
    "get set user name value index count list item data file path size type node list table field order total price date time "
    "read write open close start stop begin end first last next before after with from into over under main test case error "
    "message status code number string buffer stream server client request response handler manager factory service config "
    "the and that this which there their other would about between through because people place work part world house water "
    "der die das und nicht werden haben eine einen sich auch nach bei aus wenn nur noch kann sein schon mehr zeit jahr land "
    "les des une dans pour avec plus tout fait comme mais nous vous leur bien sans deux temps monde jour vie main chose "
    "los las una para como pero sus este entre cuando muy sin sobre tiempo donde desde todo parte vida mundo casa agua"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, random): n random strings in base 64 and hexadecimal, and n identifiers in common styles."""
    ids = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    coin = F.pmod("id", F.lit(3))
    base64 = F.translate(F.base64(F.unhex(digest)), "=", "")
    random = ids.select(F.when(coin == 0, F.substring(digest, 1, 40)).when(coin == 1, base64).otherwise(F.translate(base64, "+/", "xQ")).alias("text"), F.lit(True).alias("random"))
    stems = F.array(*map(F.lit, STEMS))

    def pick(k: int) -> Column:
        return F.element_at(stems, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(STEMS))) + 1).cast("int"))

    style, words = F.pmod("id", F.lit(5)), [pick(k) for k in range(5)]
    plain = (
        F.when(style == 0, F.concat_ws("_", *words))
        .when(style == 1, F.concat(words[0], *(F.initcap(w) for w in words[1:])))
        .when(style == 2, F.concat_ws("-", *words))
        .when(style == 3, F.concat_ws("/", *words[:4], F.concat(words[4], (F.col("id") % 100).cast("string"))))
        .otherwise(F.concat(*words))
    )
    return random.unionByName(ids.select(plain.alias("text"), F.lit(False).alias("random")))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _symbols(text: Column) -> Column:
    """Numbers of a string's characters, from 0; the last number stands for all that the alphabet lacks."""
    codes = F.array(*(F.lit(ALPHABET.find(chr(c)) % (len(ALPHABET) + 1)) for c in range(128)))
    return F.transform(F.split(text, ""), lambda c: F.when(F.octet_length(c) == 1, F.get(codes, F.ascii(c))).otherwise(F.lit(len(ALPHABET))))


def _pairs(text: Column) -> Column:
    """Number of each pair of neighbouring characters."""
    size = len(ALPHABET) + 1
    return _let(_symbols(text), lambda s: F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda x, y: x * size + y))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs, random against ordinary; their number is that of the symbols squared."""
    size = len(ALPHABET) + 1
    pairs = samples.where(F.length("text") > 1).select("random", F.explode(_pairs(F.col("text"))).alias("pair"))
    counts = {(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    from math import log

    def logs(kind: bool) -> list[float]:
        rows = [[counts.get((kind, a * size + b), 0) + 0.5 for b in range(size)] for a in range(size)]
        return [log(x / sum(row)) for row in rows for x in row]

    return [r - o for r, o in zip(logs(True), logs(False))]


def ratio(text: Column, table: list[float], most: int = 4096) -> Column:
    """Mean log-likelihood ratio of the character pairs of an ASCII string of two characters or more, `most` pairs at a time."""
    values, raw = F.array(*(F.lit(round(v, 6)) for v in table)), text.cast("binary")

    def part(i: Column) -> Column:
        piece = F.substring(raw, i * most + 1, F.lit(most + 1)).cast("string")
        return F.aggregate(_pairs(piece), F.lit(0.0), lambda acc, p: acc + F.get(values, p))

    parts = F.sequence(F.lit(0), F.floor((F.length(text) - 2) / most).cast("int"))
    return F.aggregate(F.transform(parts, part), F.lit(0.0), lambda acc, x: acc + x) / (F.length(text) - 1)


#: Values of an array whose prefix is taken one by one.
RUN = 64


def _before(values: Column, join, none: Column) -> Column:
    """For each place of an array, what `join` makes of all values before it, by prefixes of runs of RUN values."""
    fold = lambda xs: F.aggregate(xs, none, join)
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / RUN).cast("int")), lambda r: fold(F.slice(values, r * RUN + 1, F.lit(RUN))))

    def places(tops: Column) -> Column:
        heads = F.transform(tops, lambda _, r: fold(F.slice(tops, F.lit(1), r)))
        return _let(heads, lambda h: F.transform(values, lambda _, i: join(F.get(h, F.floor(i / RUN).cast("int")), fold(F.slice(values, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN)))))

    return _let(runs, places)


def _sums(lengths: Column) -> Column:
    return _before(lengths, lambda x, y: x + y, F.lit(0))


def _spans(kind: str, parts: Column) -> Column:
    """Structs of every second part, with offsets in code points and in bytes from the lengths of the parts before."""
    order = F.lit(KINDS.index(kind))

    def all_of(plain: Column) -> Column:
        def one(starts: Column, bytes_: Column) -> Column:
            def span(i: Column) -> Column:
                at, own = 2 * i - 1, F.get(plain, 2 * i - 1)
                start, byte = F.get(starts, at), F.get(bytes_, at)
                return F.struct(start.alias("start"), order.alias("order"), F.lit(kind).alias("kind"), (start + F.length(own)).alias("end"), F.get(parts, at).alias("match"), byte.alias("byte_start"), (byte + F.octet_length(own)).alias("byte_end"))

            return F.transform(F.sequence(F.lit(1), F.floor((F.size(plain) - 1) / 2).cast("int")), span)

        lengths, octets = (F.transform(plain, f) for f in (F.length, F.octet_length))
        return _let(_let(lengths, _sums), lambda starts: _let(_let(octets, _sums), lambda bytes_: one(starts, bytes_)))

    return _let(F.transform(parts, lambda p: F.translate(p, INNER, "")), all_of)


SPAN = "array<struct<start:int,order:int,kind:string,end:int,match:string,byte_start:int,byte_end:int>>"


def redact(text: Column, findings: Column, instead: str = "[SECRET]") -> Column:
    """The text with every finding, or run of overlapping ones, replaced."""
    raw = text.cast("binary")
    cut = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")

    def pieces(ends: Column) -> Column:
        done = _let(ends, lambda e: _before(e, lambda x, y: F.greatest(x, y), F.lit(0)))
        whole = _let(done, lambda d: F.transform(findings, lambda s, i: F.when(s["byte_start"] >= F.get(d, i), F.concat(cut(F.get(d, i), s["byte_start"]), F.lit(instead))).otherwise("")))
        return F.concat(F.array_join(whole, ""), cut(F.array_max(ends), F.octet_length(text)))

    return F.when(F.size(findings) > 0, _let(F.transform(findings, lambda s: s["byte_end"]), pieces)).otherwise(text)


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, findings) and the columns in `keep`: one row for each row of docs.

    A finding is a struct of start, order (of its kind), kind, end, match, byte_start and byte_end.
    """
    spark = docs.sparkSession
    table = train(samples if samples is not None else labelled_samples(spark))
    named = gathered(docs.select(F.struct(*keep).alias("kept"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))) if keep else id_and_text(docs, id_col, text_col)
    out = named.withColumn("clean", F.translate(F.coalesce("text", F.lit("")), MARK + INNER, OTHER * 2))
    for kind, (pattern, marked) in PATTERNS.items():
        parts = F.split(F.regexp_replace("clean", pattern, marked), MARK, -1)
        out = out.withColumn(f"{kind}_parts", F.when(F.col("clean").rlike(HINTS[kind]), parts))
    out = out.drop("clean", "text")
    for kind in KINDS:
        parts = F.col(f"{kind}_parts")
        spans = F.when(F.size(parts) >= 3, _spans(kind, parts)).otherwise(F.array().cast(SPAN))
        if kind == "assign":
            spans = F.filter(spans, lambda s: F.length(F.substring_index(s["match"], INNER, -1)) >= MIN_VALUE)
        if kind == "random":
            spans = F.filter(spans, lambda s: ratio(s["match"], table) > threshold)
        out = out.withColumn(kind, spans)
    found = F.array_sort(F.concat(*KINDS))
    clean = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["kind"].alias("kind"), s["end"].alias("end"), F.translate(s["match"], INNER, "").alias("match"), s["byte_start"].alias("byte_start"), s["byte_end"].alias("byte_end")))
    return out.select("doc_id", *(F.col(f"kept.{k}").alias(k) for k in keep), clean.alias("findings"))
