"""Ranked lexical search on inverted treaps.

1. One scan turns documents into the occurrences of the items' terms; what is counted over
   all documents (documents, terms, documents of each term) are plain aggregates of that
   table.  A term's weight and a document's length make every posting's impact a number
   that no query changes.
2. A task reads its documents in blocks and builds one treap for each term of a block: a
   search tree by document, a heap by impact (a hash of the document breaks ties, so that
   copies of one text do not make a path).
3. All items are answered by walking the treaps of their terms together.  An interval of
   documents has one node of each term, the largest impact that the term has there; their
   sum bounds every document of the interval.  An interval whose bound cannot enter the
   item's top k goes, with its subtrees; else the document of the largest root is scored in
   all terms, and splits the interval and the treaps in two.  The k-th best so far is
   carried from block to block.
4. Each task hands on k rows an item; a last window takes the best.

No term's list is ever in one place: documents stay where they are, so a term that stands
everywhere costs each task its share.  Items travel to the tasks in blocks of TERMS terms
at most (one item at least), whatever their number.

Null and empty texts have no terms and are never found; a row with a null id counts in the
statistics only.  Rows that repeat an id or a text are found each by itself.  Rows that
repeat an item's id are one item with the terms of all; items without id or terms find
nothing.  Equal scores go to the smaller id.  A very long text is a row of its terms.
Empty tables give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_stage, gathered, id_and_text, slices, split_words, stage_table
from .wordtable import NOT_ALNUM, WordTable, mix

#: Terms of a block of items; postings and documents of a block that a task indexes at once; treap nodes of a step of the walk.
TERMS, POSTINGS, DOCUMENTS, NODES = 1 << 20, 400_000, 1 << 16, 200_000
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Terms of a block of items by number; finds them among the words of a batch, by their bytes."""

    def __init__(self, terms: list[str]):
        table = WordTable(pa.array(terms, pa.large_string()), separators=NOT_ALNUM)
        order = np.argsort(table.hashes)
        self.hashes, self.number, self.size = table.hashes[order], order, len(terms)
        self.data, self.start, self.length = table.data, table.start[order], (table.end - table.start)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms have one 64-bit hash")

    def numbers(self, words: WordTable) -> tuple[np.ndarray, np.ndarray]:
        """(places among the words, numbers of terms) of the words that are terms."""
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), self.size - 1)
        where = np.flatnonzero((self.hashes[at] == words.hashes) & (self.length[at] == words.end - words.start))
        at = at[where]
        size = self.length[at]
        flat = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        lower = words.data[flat + np.repeat(words.start[where], size)]
        lower = np.where((lower >= 65) & (lower <= 90), lower + 32, lower)
        wrong = np.repeat(np.arange(len(at)), size)[lower != self.data[flat + np.repeat(self.start[at], size)]]
        same = np.ones(len(at), bool)
        same[wrong] = False
        return where[same], self.number[at[same]]


def _occurrences(batches, sent):
    """(doc_id, n, terms, counts): a document's number of words, and how often which terms stand there."""
    known = Vocabulary(sent.value)
    for whole in batches:
        for batch in slices(whole):
            words = WordTable(batch.column("text"), lower=True, separators=NOT_ALNUM)
            where, number = known.numbers(words)
            owner = np.searchsorted(words.first, where, side="right") - 1
            key, count = np.unique(owner * known.size + number, return_counts=True)
            owner, number = key // known.size, key % known.size
            offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, v.astype(np.int32)) for v in (number, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.first)), *lists], names=["doc_id", "n", "terms", "counts"])


def treaps(begins: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, is root) of the postings of all terms: `begins` marks each term's first, `key` is the heap order.

    A node's parent is the smaller of the nearest greater nodes before and after it, found
    by pointers that jump over what is known to be smaller.  -1 is none.
    """
    n = len(key)
    high = np.append(key, _NONE)  # at -1: greater than all
    before, after = np.arange(n) - 1, np.append(np.arange(1, n), -1)
    before[begins] = -1
    after[np.flatnonzero(begins)[1:] - 1] = -1
    on = np.arange(n)
    while len(on := on[high[before[on]] < key[on]]):
        before[on] = before[before[on]]
    on = np.arange(n)
    while len(on := on[high[after[on]] <= key[on]]):
        after[on] = after[after[on]]
    left, right = np.full(n, -1), np.full(n, -1)
    by_left = high[before] < high[after]
    root = (before < 0) & (after < 0)
    inner = np.flatnonzero(by_left)
    right[before[inner]] = inner
    inner = np.flatnonzero(~by_left & ~root)
    left[after[inner]] = inner
    return left, right, root


class Block:
    """The treaps of a block of documents."""

    def __init__(self, ids: np.ndarray, document: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        self.ids, self.n = ids, len(ids)
        at = np.argsort(term * self.n + document)
        self.pos, self.impact, term = document[at], impact[at], term[at]
        self.key = term * self.n + self.pos
        self.term = term
        order = self.impact << 24 | (mix(self.pos.astype(np.uint64) + np.uint64(1)) >> np.uint64(40)).astype(np.int64)
        begins = np.concatenate([[True], term[1:] != term[:-1]])
        self.left, self.right, root = treaps(begins, order)
        self.root = np.full(terms, -1)
        self.root[term[root]] = np.flatnonzero(root)

    def settled(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first node of each treap in its interval of documents, from a node above it on; -1 if none."""
        node = node.copy()
        on = np.flatnonzero(node >= 0)
        while len(on):
            at = self.pos[node[on]]
            under, over = at < low[on], at >= high[on]
            node[on] = np.where(under, self.right[node[on]], np.where(over, self.left[node[on]], node[on]))
            on = on[(under | over) & (node[on] >= 0)]
        return node

    def scores(self, term: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The impact of a term in a document, 0 where it does not stand."""
        want = term * self.n + pos
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.impact[at], 0)


class Ranking:
    """The k best documents of every item of a block, over one block of documents after another."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, k: int):
        self.offsets, self.terms, self.k = offsets, terms, k
        self.query, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))  # best first in each query
        self.floor, self.worst = np.zeros(len(offsets) - 1, np.int64), np.full(len(offsets) - 1, _NONE)
        self.scored = 0

    def offer(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        self.scored += len(query)
        good = (score > self.floor[query]) | (score == self.floor[query]) & (doc < self.worst[query])
        if not good.any():
            return
        query, score, doc = (np.concatenate(pair) for pair in ((self.query, query[good]), (self.score, score[good]), (self.doc, doc[good])))
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.score, self.doc = query[keep], score[keep], doc[keep]
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[query[last]], self.worst[query[last]] = score[last], doc[last]

    def add(self, block: Block) -> None:
        """Walk the treaps of every item's terms over the block."""
        node = block.root[self.terms]
        query = np.repeat(np.arange(len(self.floor)), np.diff(self.offsets))[node >= 0]
        node = node[node >= 0]
        own, owner = np.unique(query, return_inverse=True)
        stack = [(own, np.zeros(len(own), np.int64), np.full(len(own), block.n), owner, node)]
        while stack:
            query, low, high, owner, node = stack.pop()
            if len(node) > NODES and len(query) > 1:
                half = len(query) // 2
                cut = np.searchsorted(owner, half)
                stack.append((query[half:], low[half:], high[half:], owner[cut:] - half, node[cut:]))
                stack.append((query[:half], low[:half], high[:half], owner[:cut], node[:cut]))
            elif len(node):
                stack.append(self._step(block, query, low, high, owner, node))

    def _step(self, block: Block, query, low, high, owner, node):
        """Drop what cannot enter; score one document of each other interval and split it there."""
        bound = np.bincount(owner, minlength=len(query))
        first = np.cumsum(bound) - bound
        bound = np.add.reduceat(block.impact[node], first)
        alive = (bound > self.floor[query]) | (bound == self.floor[query]) & (block.ids[low] < self.worst[query])
        on = alive[owner]
        query, low, high, node, owner = query[alive], low[alive], high[alive], node[on], (np.cumsum(alive) - 1)[owner[on]]
        if not len(node):
            return query, low, high, owner, node
        first = np.searchsorted(owner, np.arange(len(query)))
        pivot = np.maximum.reduceat(block.impact[node] << 20 | block.pos[node], first) & (1 << 20) - 1
        at = pivot[owner]
        self.offer(query, np.add.reduceat(block.scores(block.term[node], at), first), block.ids[pivot])
        pos, low_, high_ = block.pos[node], low[owner], high[owner]
        before = block.settled(np.where(pos < at, node, block.left[node]), low_, at)
        after = block.settled(np.where(pos > at, node, block.right[node]), at + 1, high_)
        keep = np.concatenate([before, after]) >= 0
        node, owner = np.concatenate([before, after])[keep], np.concatenate([owner, owner + len(query)])[keep]
        there, owner = np.unique(owner, return_inverse=True)
        query, low, high = np.tile(query, 2)[there], np.concatenate([low, pivot + 1])[there], np.concatenate([pivot, high])[there]
        return query, low, high, owner, node


def _search(batches, sent, k: int):
    names, offsets, terms, weight, documents, words = sent.value
    ranking, held, size = Ranking(offsets, terms, k), [], 0

    def flush():
        nonlocal held, size
        if held:
            ids, n, lengths, term, count = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            length = 50 + 50 * n * documents // words
            owner = np.repeat(np.arange(len(ids)), lengths)
            impact = weight[term] * (1_000_000_000 * count // (1000 * count + 20 * length[owner]))
            real = impact > 0
            if real.any():
                ranking.add(Block(ids[order], place[owner[real]], term[real], impact[real], len(weight)))
        held, size = [], 0

    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid())
        for a in range(0, batch.num_rows, 1000):
            rows = batch.slice(a, 1000)
            lists = [rows.column(c) for c in ("terms", "counts")]
            columns = [rows.column(c).to_numpy() for c in ("doc_id", "n")]
            held.append((*columns, np.diff(lists[0].offsets.to_numpy()).astype(np.int64), *(c.flatten().to_numpy().astype(np.int64) for c in lists)))
            size += len(held[-1][3])
            if size >= POSTINGS or len(held) >= DOCUMENTS // 1000:
                flush()
    flush()
    yield pa.RecordBatch.from_arrays([names.take(pa.array(ranking.query)), pa.array(ranking.doc), pa.array(ranking.score)], names=["item_id", "doc_id", "score"])


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k best documents with a score above 0."""
    spark, source = docs.sparkSession, id_and_text(docs, id_col, text_col)
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null")
    asked = asked.select("item_id", F.explode(split_words("text")).alias("term")).where("term <> ''").distinct()
    asked = stage_table(asked.groupBy("item_id").agg(F.collect_list("term").alias("terms")), "items", items)
    kind = asked.schema["item_id"].dataType
    found = spark.createDataFrame([], f"item_id {kind.simpleString()}, doc_id long, score long")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block)
    for number in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).toArrow()
        if not own.num_rows:
            continue
        lists = own.column("terms").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        offsets, terms = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64), coded.indices.to_numpy().astype(np.int64)
        words = spark.sparkContext.broadcast(coded.dictionary.to_pylist())
        index = stage_table(arrow_stage(source, lambda b, w=words: _occurrences(b, w), "doc_id long, n long, terms array<int>, counts array<int>"), "occurrences", source)
        total = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        holders = index.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row a term of the block
        weight = np.zeros(len(words.value), np.int64)
        for term, held in zip(holders.column("term").to_pylist(), holders.column("count").to_pylist()):
            weight[term] = math.floor(1000 * math.log((2 * total.documents + 2) / (2 * held + 1)))
        if total.words:
            sent = spark.sparkContext.broadcast((own.column("item_id").combine_chunks(), offsets, terms, weight, total.documents, total.words))
            found = found.unionByName(arrow_stage(gathered(index, source), lambda b, s=sent: _search(b, s, k), found.schema))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
