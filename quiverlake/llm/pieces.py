"""SentencePiece encoding with byte offsets into the original text, and decoding.

Encoding has three steps.  `Normalizer` rewrites the text by longest-prefix lookup in
the model's compiled character map and records for every normalised byte the original
byte that it came from.  The model then cuts the normalised text into pieces; the cut is
cached per chunk where the vocabulary proves that no piece crosses a chunk border.  At
last every piece's normalised byte range is projected to a byte span of the original.

Nulls are empty texts; an empty text has no ids and decodes to the empty string.
Repeated rows, and rows with equal or null ids, are encoded each by itself.  A very long
text is a slice by itself; a very long word goes to the model whole and is not cached.
An empty table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_stage, id_and_text, slices

SPACE = "▁"
_SPACE = SPACE.encode()
SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


class CharsMap:
    """The compiled character map: a double-array trie from byte strings to replacements.

    Layout (public): uint32 size of the trie, the trie's uint32 units, then the
    replacements, each ended by a zero byte.  An empty map replaces nothing.
    """

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units, self.pool = struct.unpack_from(f"<{n // 4}I", blob, 4), blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that data has at `at`, and its replacement."""
        units = self.units
        if not units:
            return None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        found = None
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = i + 1 - at, value
        if found is None:
            return None
        length, value = found
        return length, self.pool[value : self.pool.index(b"\0", value)]


class Normalizer:
    """Normalised bytes of a text, and for each of them (and the end) an original byte offset."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, trim: bool = False, escape: bool = True, suffix: bool = False):
        self.map, self.prefix, self.trim, self.suffix = CharsMap(charsmap), dummy_prefix, trim, suffix
        self.space = _SPACE if escape else b" "

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        return self._mapped(text) if self.map.units or self.trim or self.suffix else self._plain(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map each character stands for itself; only spaces change."""
        raw = np.frombuffer(text, np.uint8)
        width = np.where(raw == 32, len(self.space), 1)
        source = np.repeat(np.arange(len(raw)), width)
        head = len(self.space) if self.prefix else 0
        out = self.space * bool(head) + text.replace(b" ", self.space)
        return out, np.concatenate([np.zeros(head, np.int64), source, [len(raw)]])

    def _next(self, text: bytes, at: int) -> tuple[int, bytes]:
        hit = self.map.longest(text, at)
        if hit:
            return hit
        lead = text[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, text[at : at + n]

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        at, end = 0, len(text)
        if self.trim:
            while at < end and (hit := self._next(text, at))[1] == b" ":
                at += hit[0]
            if at == end:
                return b"", np.array([end])
        out, source = bytearray(), []

        def put(piece: bytes, origin: int) -> None:
            out.extend(piece)
            source.extend([origin] * len(piece))

        if self.prefix and not self.suffix:
            put(self.space, at)
        was_space = self.trim
        while at < end:
            n, piece = self._next(text, at)
            while was_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                for byte in piece:
                    put(self.space if byte == 32 else bytes([byte]), at)
                was_space = piece.endswith(b" ")
            at += n
            if not self.trim:
                was_space = False
        if self.trim:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                at = source[len(out)]
                del source[len(out) :]
        if self.prefix and self.suffix:
            put(self.space, at)
        return bytes(out), np.array([*source, at], np.int64)


#: Characters of a chunk that is worth keeping: longer ones (whole texts of scripts without spaces, say) seldom come again.
LONGEST = 64


class PieceEncoder:
    """Exact ids and original byte spans; `most_cached` chunks of up to LONGEST characters bound the memory of the cache."""

    def __init__(self, model_path: str, most_cached: int = 150_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        spec = proto.normalizer_spec
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, proto.trainer_spec.treat_whitespace_as_suffix)
        kinds = np.array([p.type for p in proto.pieces])
        self.lengths = np.where(kinds == 6, 1, [len(p.piece.encode()) for p in proto.pieces]).astype(np.int64)  # 6: a byte
        self.starts = np.array([p.piece.startswith(SPACE) for p in proto.pieces])
        self.fallback = proto.trainer_spec.byte_fallback
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        #: No piece holds a space after another character, so none crosses the start of a run of spaces.
        self.chunked = self.fallback and not self.normalizer.map.units and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix and not any(inner.search(p.piece) for p in proto.pieces) and 4 not in kinds
        self.most = most_cached
        self.cache: dict[str, bytes] = {}  # ids as 32-bit integers; bytes cost the garbage collector nothing

    def _chunks(self, text: str) -> list[str]:
        """Chunks without the space that starts each in the normalised text."""
        plain = text.replace(SPACE, " ") if SPACE in text else text
        if not plain:
            return []
        if "  " in plain or plain[0] == " " or plain[-1] == " ":
            return [c[1:] for c in re.findall(" +[^ ]*", " " + plain)]
        return plain.split(" ")

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of unseen chunks, the plain short ones encoded as one text that is cut again where pieces start with a space."""
        out = {}
        plain = [c for c in new if c and " " not in c and len(c) <= LONGEST]
        for k in range(0, len(plain), 1000):  # short joined texts: the model's time is above linear
            part = plain[k : k + 1000]
            ids = np.array(self.model.encode(" ".join(part)), dtype=np.int32)
            cuts = (np.flatnonzero(self.starts[ids]) * 4).tolist() + [len(ids) * 4]
            if len(cuts) != len(part) + 1:
                raise ValueError("a piece crosses a chunk border")
            raw = ids.tobytes()
            out.update((c, raw[i:j]) for c, i, j in zip(part, cuts, cuts[1:]))
        for c in new:
            if not c:
                out[c] = np.int32(self.model.piece_to_id(SPACE)).tobytes()
            elif c not in out:
                out[c] = np.array(self.model.encode(c), dtype=np.int32).tobytes()
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a call's texts share one lookup of unseen chunks."""
        if not self.chunked:
            return [np.array(i, dtype=np.int32) for i in self.model.encode(texts, num_threads=1)]
        cut = [self._chunks(t) for t in texts]
        seen = set().union(*cut)
        long = {c for c in seen if len(c) > LONGEST}  # of this call only
        new = seen - long - self.cache.keys()
        if len(self.cache) + len(new) > self.most:
            self.cache.clear()
            new = seen - long
        if new:
            self.cache.update(self._learn(list(new)))
        here = self._learn(list(long))
        get = (lambda c: here[c] if c in here else self.cache[c]) if here else self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), dtype=np.int32) for c in cut]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the original text, one for each id."""
        normal, source = self.normalizer(text.encode())
        if self.fallback:
            ends = np.cumsum(self.lengths[ids])
        else:  # an unknown piece is as long as the text says
            got = self.model.encode(text, out_type="proto")
            ends = np.cumsum([len(p.piece.encode()) for p in got.pieces]).astype(np.int64)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return source[begins] if len(ids) else begins[:0], source[ends] if len(ids) else ends


@functools.cache
def piece_encoder(model_path: str) -> PieceEncoder:
    """One for each Python worker, which keeps its cache from task to task."""
    return PieceEncoder(model_path)


def encode_batches(batches, model_path: str):
    encoder = piece_encoder(model_path)
    for whole in batches:
        for batch in slices(whole, most=1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = encoder.ids(texts)
            spans = [encoder.spans(t, i) for t, i in zip(texts, ids)]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, np.concatenate(xs).astype(np.int32)) for xs in (ids, [s[0] for s in spans], [s[1] for s in spans])]
            decoded = encoder.model.decode([i.tolist() for i in ids], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends, decoded): one row for each row of docs, in no order."""
    return arrow_stage(id_and_text(docs, id_col, text_col), lambda b: encode_batches(b, model_path), SCHEMA)
