"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the embedding of the word (of a vocabulary learned from the sample) and
the mean embeddings of its runs of three and of five characters (bytes).  A forward and a backward GRU read windows of
WINDOW words that overlap by half; attention pools each window's states, and a document's
score is that of its worst window.  Training back-propagates through each document's worst
window.  Scoring covers every window of every whole text.

Labels are learned from whole texts of a bounded sample of labelled rows, whose bounds are
parameters of `fit`: at most `positives` + `negatives` documents, those with the smallest
hash of their id, and of these as many as `most_bytes` of text allow.  The loss weighs
them back to the labels' own share.  No other column is an input.

Null, empty and wordless texts are scored as a window without words.  Equal texts have
equal scores but for rounding.  A very long text is scored whole, some thousand windows at
a time; a very long word is one word.  Rows that repeat an id are scored each by itself,
and are all texts of a label of that id.  Without any label all scores are 0; an empty
table has no scores.  Other columns pass through `score_rows`, where one that has the
name of the score is replaced, and are ignored by `score_documents`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import arrow_stage, gathered, id_and_text, release, slices
from .wordtable import LOWER, NOT_ALNUM, WordTable, mix

WINDOW, STEP = 24, 12
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 6, 8, 8
#: Buckets (as a power of two) of hashed runs of three and of five bytes.
GRAMS = ((3, 10), (5, 13))


#: Bytes of text that are scored together, which bounds the scratch space of a worker.
SLICE = 512 << 10


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


class Words:
    """The words of a text column, as numbers of distinct words, and the distinct words' inputs."""

    def __init__(self, column):
        table = WordTable(column, lower=True, separators=NOT_ALNUM)
        self.first = table.first
        self.hashes, at, self.number = np.unique(table.hashes, return_index=True, return_inverse=True)
        start, end = table.start[at], table.end[at]
        lengths = end - start
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, lengths)
        text = LOWER[table.data[flat]].astype(np.uint64) if len(flat) else np.zeros(0, np.uint64)
        place = np.arange(len(text)) - np.repeat(offsets[:-1], lengths)
        left = np.repeat(lengths, lengths) - 1 - place
        self.grams = []
        for width, bits in GRAMS:  # the run around each byte; past the word's ends it reads spaces
            code, half = np.zeros(len(text), np.uint64), width // 2
            for k in range(-half, half + 1):
                code = code * np.uint64(259) + np.where((place + k >= 0) & (left - k >= 0), np.roll(text, -k), np.uint64(32))
            self.grams.append((mix(code) >> np.uint64(64 - bits)).astype(np.int32))
        self.offsets, self.lengths = offsets, lengths

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, first word) of each window; every document has one at least."""
        counts = np.diff(self.first)
        per = np.maximum(1, -(-(counts - WINDOW) // STEP) + 1)
        doc = np.repeat(np.arange(len(per)), per)
        return doc, self.first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * STEP

    def numbers(self, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """(windows x WINDOW) numbers of words, -1 past a document's end."""
        place = start[:, None] + np.arange(WINDOW)
        inside = place < self.first[doc + 1][:, None]
        place[~inside] = 0
        return np.where(inside, self.number[place] if len(self.number) else 0, -1)


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = np.sort(vocabulary)
        draw = lambda *shape, s=0.3: (rng.standard_normal(shape) * s).astype(np.float32)
        n, h = WORD_DIM + CHAR_DIM * len(GRAMS), HIDDEN
        self.p = {"word": draw(len(vocabulary) + 1, WORD_DIM), **{f"char{w}": draw(1 << bits, CHAR_DIM, s=0.1) for w, bits in GRAMS}, "att": draw(2 * h, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": draw(ATTENTION), "out": draw(2 * h), "out_b": np.array([-1], np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(n, 3 * h), f"h{d}": draw(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}
            self.p[f"c{d}"][:h] = 1  # remember at first

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary rows of the distinct words, and their input vectors."""
        at = np.searchsorted(self.vocabulary, words.hashes)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == words.hashes if len(self.vocabulary) else np.zeros(len(at), bool)
        row = np.where(known, at, len(self.vocabulary))
        parts = [self.p["word"][row]]
        for (w, _), grams in zip(GRAMS, words.grams):
            sums = np.add.reduceat(self.p[f"char{w}"][grams], words.offsets[:-1]) if len(row) else np.zeros((0, CHAR_DIM))
            parts.append((sums / words.lengths[:, None]).astype(np.float32))
        return row, np.concatenate(parts, 1)

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input parts of all gates for the distinct words; the last row stands for no word."""
        return {d: np.concatenate([x @ self.p[f"x{d}"] + self.p[f"c{d}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"}

    def forward(self, projected: dict[str, np.ndarray], numbers: np.ndarray, keep: bool = False):
        """Logit of each window, and what the gradients need."""
        n, h = len(numbers), HIDDEN
        there = (numbers >= 0).astype(np.float32)
        states = np.zeros((n, WINDOW, 2 * h), np.float32)
        tape = []
        for d in "fb":
            state, u, off = np.zeros((n, h), np.float32), self.p[f"h{d}"], 0 if d == "f" else h
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                g, r = projected[d][numbers[:, t]], state @ u
                zr = _sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
                new = np.tanh(g[:, 2 * h :] + zr[:, h:] * r[:, 2 * h :])
                take = (1 - zr[:, :h]) * there[:, t, None]
                if keep:
                    tape.append((d, t, state, zr, new, r[:, 2 * h :], take))
                state = state + take * (new - state)
                states[:, t, off : off + h] = state
        hidden = np.tanh(states @ self.p["att"] + self.p["att_b"])
        score = hidden @ self.p["att_v"] - 1e4 * (1 - there)
        weight = np.exp(score - score.max(1, keepdims=True)) * there
        weight /= np.maximum(weight.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,ntk->nk", weight, states)
        logit = pooled @ self.p["out"] + self.p["out_b"][0]
        return logit, (states, hidden, weight, pooled, there, tape)

    def gradients(self, words: Words, row, x, projected, numbers, loss_of) -> dict[str, np.ndarray]:
        """Gradients of the loss whose derivative by the logits is loss_of(logits)."""
        p, h = self.p, HIDDEN
        logit, (states, hidden, weight, pooled, there, tape) = self.forward(projected, numbers, keep=True)
        dl = loss_of(logit).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["out_b"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dp = dl[:, None] * p["out"]
        dw = np.einsum("nk,ntk->nt", dp, states)
        ds = weight * (dw - (weight * dw).sum(1, keepdims=True))
        dh = ds[:, :, None] * p["att_v"] * (1 - hidden**2)
        g["att_v"] = np.einsum("nt,nta->a", ds, hidden)
        g["att"], g["att_b"] = np.einsum("ntk,nta->ka", states, dh), dh.sum((0, 1))
        dstates = weight[:, :, None] * dp[:, None] + dh @ p["att"].T
        dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        back = {"f": np.zeros((len(numbers), h), np.float32), "b": np.zeros((len(numbers), h), np.float32)}
        xs = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        for d, t, state, zr, new, rn, take in reversed(tape):
            u, off = p[f"h{d}"], 0 if d == "f" else h
            do = back[d] + dstates[:, t, off : off + h]
            z, r = zr[:, :h], zr[:, h:]
            dnew = do * take * (1 - new**2)
            dz = -do * (new - state) * there[:, t, None] * z * (1 - z)
            dr = dnew * rn * r * (1 - r)
            gates = np.concatenate([dz, dr, dnew], 1)
            through = np.concatenate([dz, dr, dnew * r], 1)
            g[f"h{d}"] += state.T @ through
            g[f"x{d}"] += xs[numbers[:, t]].T @ gates
            g[f"c{d}"] += gates.sum(0)
            np.add.at(dx, numbers[:, t], gates @ p[f"x{d}"].T)
            back[d] = do * (1 - take) + through @ u.T
        np.add.at(g["word"], row, dx[:-1, :WORD_DIM])
        for k, ((w, _), grams) in enumerate(zip(GRAMS, words.grams)):
            part = dx[:-1, WORD_DIM + k * CHAR_DIM :][:, :CHAR_DIM] / words.lengths[:, None]
            moved = part.any(1)
            np.add.at(g[f"char{w}"], grams[np.repeat(moved, words.lengths)], np.repeat(part[moved], words.lengths[moved], 0))
        return g

    def scores(self, column, chunk: int = 4096) -> np.ndarray:
        """Probability for each text of a column."""
        words = Words(column)
        _, x = self.inputs(words)
        projected = self.projected(x)
        doc, start = words.windows()
        worst = np.full(len(words.first) - 1, -np.inf, np.float32)
        for a in range(0, len(doc), chunk):
            part = doc[a : a + chunk]
            np.maximum.at(worst, part, self.forward(projected, words.numbers(part, start[a : a + chunk]))[0])
        return 1 / (1 + np.exp(-worst.astype(np.float64)))


def _odds(yes: np.ndarray, no: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Smoothed log odds of the labels of the documents that hold each item, from their numbers with label 1 and without."""
    toxic, clean = max(1, (labels == 1).sum()), max(1, (labels == 0).sum())
    return np.clip(np.log((yes + 0.5) / toxic) - np.log((no + 0.5 * clean / toxic) / clean), -3, 3) / 3


def _start(net: Network, words: Words, doc: np.ndarray, labels: np.ndarray, step: int = 1 << 14) -> None:
    """The first dimension of every embedding starts as the log odds of its documents' labels."""
    pairs = np.unique(words.number.astype(np.int64) * len(labels) + doc)
    word, doc = pairs // len(labels), pairs % len(labels)
    row = np.searchsorted(net.vocabulary, words.hashes[word])
    row[row == len(net.vocabulary)] = 0
    known = net.vocabulary[row] == words.hashes[word] if len(net.vocabulary) else np.zeros(len(word), bool)
    yes, no = (np.bincount(row[known & (labels[doc] == 1) if y else known & (labels[doc] != 1)], minlength=len(net.vocabulary)) for y in (1, 0))
    net.p["word"][:-1, 0] = _odds(yes, no, labels)
    net.p["word"][-1, 0] = 0
    for (w, bits), grams in zip(GRAMS, words.grams):
        there = np.zeros((1 << bits, len(labels)), bool)
        for at in range(0, len(word), step):
            own = word[at : at + step]
            size = words.lengths[own]
            flat = np.arange(int(size.sum())) + np.repeat(words.offsets[own] - (np.cumsum(size) - size), size)
            there[grams[flat], np.repeat(doc[at : at + step], size)] = True
        net.p[f"char{w}"][:, 0] = _odds(there[:, labels == 1].sum(1), there[:, labels != 1].sum(1), labels)


def _inputs_of(net: Network, words: Words, numbers: np.ndarray):
    """(distinct words, vocabulary rows, inputs, numbers among them) of some windows."""
    used, local = np.unique(numbers, return_inverse=True)
    used = used[used >= 0]
    part = _subset(words, used)
    return part, *net.inputs(part), local.reshape(numbers.shape) - int(numbers.min() < 0)


def _worst(net: Network, words: Words, docs: np.ndarray, of: np.ndarray, start: np.ndarray, begins: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """The window of each document that scores highest, of all its windows."""
    at = np.concatenate([np.arange(begins[d], begins[d + 1]) for d in docs])
    logit = np.empty(len(at), np.float32)
    for a in range(0, len(at), chunk):
        own = at[a : a + chunk]
        _, _, x, local = _inputs_of(net, words, words.numbers(of[own], start[own]))
        logit[a : a + chunk] = net.forward(net.projected(x), local)[0]
    owner = np.repeat(np.arange(len(docs)), begins[docs + 1] - begins[docs])
    return at[np.lexsort((-logit, owner))[np.searchsorted(owner, np.arange(len(docs)))]]


def train(texts, labels: np.ndarray, weights: np.ndarray, steps: int = 300, batch: int = 32, rate: float = 0.02, min_docs: int = 3, most_words: int = 20_000, seed: int = 7, odds: bool = True, most_windows: int = 1_000_000) -> Network:
    """Adam on the weighted log loss of each document's worst window; texts: an Arrow column; without `odds` all embeddings start at random.

    Every epoch looks at all windows of all texts; there are at least three, and more as
    long as `most_windows` are not looked at.
    """
    words = Words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
    pairs = np.unique(words.number.astype(np.int64) * len(texts) + doc) // max(len(texts), 1)
    frequency = np.bincount(pairs, minlength=len(words.hashes))
    common = np.argsort(-frequency, kind="stable")[:most_words]
    net = Network(words.hashes[common[frequency[common] >= min_docs]], seed)
    if odds:
        _start(net, words, doc, labels)
    of, start = words.windows()
    begins = np.searchsorted(of, np.arange(len(texts) + 1))
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    step = 0
    epochs = max(3, min(30, -(-steps * batch // max(len(texts), 1)), most_windows // len(of)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            docs = order[a : a + batch]
            at = _worst(net, words, docs, of, start, begins)
            part, row, x, local = _inputs_of(net, words, words.numbers(of[at], start[at]))
            hidden = rng.random(len(row)) < 0.3  # some words are read by their letters only
            row = np.where(hidden, len(net.vocabulary), row)
            x[:, :WORD_DIM] = net.p["word"][row]
            projected = net.projected(x)
            y, w = labels[docs], weights[docs]
            g = net.gradients(part, row, x, projected, local, lambda z: w * (_sigmoid(z) - y) / len(docs))
            step += 1
            slow = rate * (1 - 0.8 * epoch / epochs)
            for k in net.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                net.p[k] -= slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6) + (slow * 1e-3) * net.p[k] * (net.p[k].ndim > 1)
    return net


def _subset(words: Words, used: np.ndarray) -> Words:
    """The distinct words `used` only."""
    part = Words.__new__(Words)
    part.hashes, part.lengths = words.hashes[used], words.lengths[used]
    part.offsets = np.concatenate([[0], np.cumsum(part.lengths)])
    flat = np.arange(part.offsets[-1]) - np.repeat(part.offsets[:-1] - words.offsets[used], part.lengths)
    part.grams = [g[flat] for g in words.grams]
    return part


def fit(docs: DataFrame, labels: DataFrame, positives: int = 800, negatives: int = 1600, most_bytes: int = 16 << 20, learn: str = "pmod(crc32(cast(doc_id as string)), 5) <> 0", id_col: str = "doc_id", text_col: str = "text", **training) -> Network | None:
    """A network from a bounded sample of the labelled documents for which the predicate `learn` holds; `training` goes to `train`."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(learn)
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    named = id_and_text(docs, id_col, text_col)
    chosen = [known.where(F.col("toxic") == y).join(named.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((0, negatives), (1, positives))]
    wanted = chosen[0].unionByName(chosen[1])  # so few that a broadcast has a bound
    texts = named.join(F.broadcast(wanted), "doc_id").withColumn("key", F.xxhash64("text"))
    # An id may have many rows: the sample is bounded again, in rows and in bytes.
    order = (F.xxhash64("doc_id"), "doc_id", "toxic", "key")
    sizes = texts.select("doc_id", "toxic", "key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).orderBy(*order).limit(positives + negatives).collect()
    total, few = 0, set()
    for r in sizes:
        total += r.bytes
        if total > most_bytes and few:
            break
        few.add((r.doc_id, r.toxic, r.key))
    if not few:
        return None
    columns = [pa.array(c, t) for c, t in zip(zip(*sorted(few)), (pa.int64(), pa.int32(), pa.int64()))]
    ids = docs.sparkSession.createDataFrame(pa.table(columns, names=["doc_id", "toxic", "key"]))  # a list would go through Python workers
    rows = texts.join(F.broadcast(ids), ["doc_id", "toxic", "key"]).select("doc_id", "toxic", "key", "text").distinct().toArrow()
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "toxic", "key")])
    y = rows.column("toxic").to_numpy().astype(np.float32)
    share = np.array([counts.get(k, 0) for k in (0, 1)]) / sum(counts.values())
    own = np.array([(y == k).mean() for k in (0, 1)])
    weights = (share / np.maximum(own, 1e-9))[y.astype(int)].astype(np.float32)
    network = train(rows.column("text"), y, weights, **training)
    del rows
    release()
    return network


def score_rows(docs: DataFrame, network: Network | None, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """The rows of docs with a score beside their own columns; a column that has the score's name is replaced."""
    docs = gathered(docs.drop(score_col))
    if network is None:
        return docs.withColumn(score_col, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(network)  # bounded: vocabulary and layer sizes are parameters
    names, at = docs.columns, docs.columns.index(text_col)

    def scored(batches):
        for whole in batches:
            for batch in slices(whole, text_col, most=SLICE):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column(at)))], names=[*names, score_col])

    return arrow_stage(docs, scored, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def score_documents(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row for each row of docs."""
    named = id_and_text(docs, id_col, text_col)
    return named.select("doc_id", F.lit(0.0).alias("score")) if network is None else _scored(named, network)


def _scored(named: DataFrame, network: Network) -> DataFrame:
    """As score_rows, without sending the texts back."""
    shared = named.sparkSession.sparkContext.broadcast(network)

    def scored(batches):
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")))], names=["doc_id", "score"])

    return arrow_stage(named, scored, "doc_id long, score double")
