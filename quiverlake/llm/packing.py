"""Packing of token sequences in the order of a space-filling curve.

Each document's token ids are hashed into a vector, projected to a few dimensions and
given a Hilbert key.  Documents are range-sorted by that key, so that neighbours on the
curve (similar documents) share a sequence, and each range is packed without gaps: a
document is cut where a sequence is full.  What remains at the end of a range is cut
into sequences whose lengths are powers of two, so nothing is padded.

Null and empty texts consist of the end id alone.  Repeated texts have equal keys; the
document id breaks ties and lets a range border fall among them.  Rows with equal or
null ids are packed each by itself.  A very long text is one row of ids, whole in one
range; a very long word goes to the tokenizer as it is and is not cached.  An empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_stage, id_and_text, partitions, slices, stage_table

PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PACKED = pa.schema([(c.split()[0], pa.int64()) for c in PACKED.split(", ")])

DIMENSIONS, BITS, BUCKETS = 4, 15, 256


def _lower(text: str) -> str:
    """A text of Latin-1 characters in lower case, where that cannot make a special token: one cache entry for both cases."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text if "<|" in text else text.lower()


class WordBpe:
    """Ids of a lower-casing word BPE with word-end symbols, exactly as the tokenizers library gives them.

    Words never interact across white space, so each distinct chunk is encoded once and
    kept in a bounded cache.  Chunks of Latin-1 characters go to a byte-pair core whose
    ranks are the model's merges (the last byte of a word first joins the end mark, an
    impossible UTF-8 byte); any other chunk goes to the tokenizers library itself.
    """

    END = b"\xff"

    def __init__(self, path: str, most_cached: int = 100_000):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        chars = {b: c for c, b in _byte_chars().items()}
        to_bytes = lambda piece: bytes(_byte_chars()[c] for c in piece.removesuffix("</w>")) + (self.END if piece.endswith("</w>") else b"")
        ranks: dict[bytes, int] = {}
        self.to_id: list[int] = []

        def rank(raw: bytes, piece: str) -> None:
            if raw not in ranks:
                ranks[raw] = len(self.to_id)
                self.to_id.append(model["vocab"].get(piece, -1))

        for b in range(256):  # ends of words join before all merges
            rank(bytes([b]) + self.END, chars[b] + "</w>")
        for b in range(256):
            rank(bytes([b]), chars[b])
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            rank(to_bytes(a) + to_bytes(b), a + b)
        self.core = tiktoken.Encoding("words", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.cache = _Chunks(self._encoder([np.array([i], dtype="<i4").tobytes() if i >= 0 else None for i in self.to_id]), most_cached)

    def _encoder(self, as_bytes: list[bytes | None]):
        """The function that gives a chunk's ids, by the byte-pair core or, where only the library can tell, by that."""
        core, name, library, split, end = self.core.encode_single_piece, as_bytes.__getitem__, self.library, self.split.findall, self.END

        def by_library(chunk: str) -> bytes:
            return np.array(library.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

        def latin(chunk: str) -> bytes:
            low = chunk.lower()
            if low.isalpha():
                return b"".join(map(name, core(low.encode() + end)))
            if "<|" in low:
                return by_library(chunk)
            if low[-1] in ".,|" and low[:-1].isalpha():
                return b"".join(map(name, core(low[:-1].encode() + end) + core(low[-1].encode() + end)))
            return b"".join([name(r) for word in split(low) for r in core(word.encode() + end)])

        def encode(chunk: str) -> bytes:
            try:
                if chunk.isascii():
                    if chunk.isalpha():  # most of them
                        ids = core(chunk.lower().encode() + end)
                        return name(ids[0]) + b"" if len(ids) == 1 else b"".join(map(name, ids))
                    return latin(chunk) if chunk else b""
                chunk.encode("latin-1")
                return latin(chunk)
            except (TypeError, UnicodeEncodeError):  # a symbol that the vocabulary lacks, or another script
                return by_library(chunk)

        return encode

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out, get = [], self.cache.__getitem__
        for text in texts:
            out.append(b"".join(map(get, _lower(text).replace("\n", " ").split(" "))))
        return out


#: Characters of a chunk that is worth keeping: longer ones (whole texts of scripts without spaces, say) seldom come again.
LONGEST = 64


class _Chunks(dict):
    """Ids of short chunks in two generations: a full one becomes the old one, and what comes again moves back to the new one."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST:
            return self.make(chunk)
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """One for each Python worker, which keeps its cache from task to task."""
    return WordBpe(path)


def _byte_chars() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others follow from U+0100."""
    global _alphabet
    if _alphabet is None:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        _alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    return _alphabet


_alphabet: dict[str, int] | None = None


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows), by the public transpose algorithm of Skilling."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


_direction = np.random.default_rng(20240229).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def curve_keys(ids: list[bytes]) -> np.ndarray:
    """Hilbert keys of documents given as little-endian 32-bit ids."""
    if not ids:
        return np.zeros(0, np.int64)
    lengths = np.array([len(i) // 4 for i in ids])
    bucket = np.frombuffer(b"".join(ids), dtype="<u4") * np.uint32(2654435761) >> np.uint32(24)  # BUCKETS of them
    vectors = np.bincount(np.repeat(np.arange(len(ids)), lengths) * BUCKETS + bucket, minlength=len(ids) * BUCKETS).reshape(-1, BUCKETS).astype(np.float32)
    vectors = np.sqrt(vectors)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    low = np.einsum("nb,bd->nd", vectors, _direction)  # no BLAS: the same text has the same key in any batch
    grid = np.clip((np.tanh(low) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(grid)


TOKENS = "doc_id long, curve long, tokens int, ids binary"


def _tokenized(batches, path: str, end_id: int):
    """Each document's curve key, number of ids and ids, in two bytes an id where all of them fit."""
    bpe, end = word_bpe(path), np.array([end_id], dtype="<u4").tobytes()
    for whole in batches:
        for batch in slices(whole, most=1 << 20):
            ids = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            keys = curve_keys(ids)
            raw = [i + end for i in ids]
            tokens = np.array([len(r) // 4 for r in raw], np.int32)
            flat = np.frombuffer(b"".join(raw), "<u4")
            if len(flat) and flat.max() < 1 << 16:
                packed, at = flat.astype("<u2").tobytes(), np.concatenate([[0], np.cumsum(2 * tokens)]).tolist()
                raw = [packed[x:y] for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(tokens), pa.array(raw, pa.binary())], names=["doc_id", "curve", "tokens", "ids"])


def _ids_of(raw, tokens: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * tokens else "<u2").astype("<u4")


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Cuts one range's stream of documents into sequences; holds less than one sequence of ids."""

    def __init__(self, size: int, first: int):
        self.size, self.sequence = size, first
        self.held: list[tuple] = []  # (doc_id, start, ids, doc_tokens) not yet in a full sequence
        self.filled = 0

    def _emit(self, rows: list[tuple], take: int) -> None:
        """Move `take` ids from what is held to one sequence."""
        offset = 0
        while offset < take:
            doc, start, ids, tokens = self.held[0]
            n = min(len(ids), take - offset)
            rows.append((doc, start, n, zlib.crc32(ids[:n]), tokens, self.sequence, offset))
            self.held[0] = (doc, start + n, ids[n:], tokens)
            if n == len(ids):
                self.held.pop(0)
            offset += n
        self.filled -= take
        self.sequence += 1

    def add(self, rows: list[tuple], doc, ids: np.ndarray) -> None:
        self.held.append((doc, 0, ids, len(ids)))
        self.filled += len(ids)
        while self.filled >= self.size:
            self._emit(rows, self.size)

    def finish(self, rows: list[tuple]) -> None:
        for n in _powers(self.filled):
            self._emit(rows, n)


def _pack(batches, size: int):
    from pyspark import TaskContext

    packer = Packer(size, TaskContext.get().partitionId() << 40)
    rows: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_PACKED)
    for batch in batches:
        for doc, tokens, raw in zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist(), batch.column("ids")):
            packer.add(rows, doc, _ids_of(raw.as_buffer(), tokens))
        if rows:
            yield made()
            rows.clear()
    packer.finish(rows)
    if rows:
        yield made()


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents."""
    source = id_and_text(docs, id_col, text_col)
    tokens = stage_table(arrow_stage(source, lambda b: _tokenized(b, tokenizer_path, end_id), TOKENS), "tokens")
    ranges = tokens.repartitionByRange(partitions(tokens), "curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    return arrow_stage(ranges, lambda b: _pack(b, size), PACKED)
