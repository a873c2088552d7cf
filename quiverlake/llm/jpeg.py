"""Payload bytes in progressive JPEG files, and a progressive decoder with numpy transforms.

The writer stores each payload byte as one quantised coefficient of size category 8
(sign and seven bits), in zigzag positions 1 to 48 of every block, with 4:2:0 chroma:
576 bytes fill two MCUs.  It writes spectral selection (positions 1-24 and 25-48) and
successive approximation (a first pass without the lowest bit, then a refinement) as
twelve AC scans besides two DC scans, so the file is an ordinary progressive JPEG.

The reader accumulates scans of any Huffman-coded progressive file with 8-bit samples
into coefficient arrays, inverse-transforms them in numpy, upsamples chroma and returns a
full-resolution RGB tensor.  Scans whose codes have one width are read by whole arrays;
all others symbol by symbol.

Null texts are empty; an empty text is one unit of 576 bytes 255.  A file depends on its
text alone, so equal texts have equal files, tensors and features.  Rows that repeat, and
rows with equal or null ids, are stored each by itself.  A very long text is one file of
as many units as it needs (up to 4,000 rows of them a column of units, then wider); its
arrays are a small multiple of its size.  An empty table gives an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_stage, id_and_text, slices

UNIT = 576
SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary, feature string"


def _zigzag() -> np.ndarray:
    """Natural position of each zigzag index, from the rule: diagonals in turn, alternating direction."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
BANDS = ((1, 24), (25, 48))


def _idct_matrix() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return np.kron(basis, basis).astype(np.float32)  # coefficients (64) @ matrix = samples (64)


IDCT = _idct_matrix()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _single_code(kind: int, number: int, symbol: int) -> bytes:
    """A Huffman table with one symbol, whose code is the bit 0."""
    return _segment(0xC4, bytes([kind << 4 | number, 1, *[0] * 15, symbol]))


def _stuffed(bits_or_bytes: np.ndarray) -> bytes:
    return bits_or_bytes.tobytes().replace(b"\xff", b"\xff\x00")


def _packed_bits(bits: np.ndarray) -> bytes:
    bits = bits.ravel()
    return _stuffed(np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])))


def _scan(components: list[tuple[int, int, int]], low: int, high: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *[x for c, d, a in components for x in (c, d << 4 | a)], low, high, ah << 4 | al]))


def write_payload(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload (a positive multiple of 576 bytes)."""
    units = len(payload) // UNIT
    across = -(-units // 4000)
    rows, cols = -(-units // across), 2 * across
    mcus = rows * cols
    data = np.full(mcus * 288, 255, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    parts = np.split(data.reshape(-1, 48), [4 * mcus, 5 * mcus])
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xDB, bytes([0, *[1] * 64]))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_single_code(0, 0, 0), _single_code(1, 0, 7), _single_code(1, 1, 0)]
    everything = [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    zeros = _packed_bits(np.zeros(6 * mcus, np.uint8))
    out += [_scan(everything, 0, 0, 0, 1), zeros]
    for low, high in BANDS:  # first pass: bit 0 (the code), then seven magnitude bits
        for c, part in enumerate(parts, 1):
            out += [_scan([(c, 0, 0)], low, high, 0, 1), _stuffed(part[:, low - 1 : high] >> 1)]
    out += [_scan(everything, 0, 0, 1, 0), zeros]
    for low, high in BANDS:  # refinement: bit 0 (end of block), then a correction for each coefficient
        for c, part in enumerate(parts, 1):
            bits = np.zeros((len(part), high - low + 2), np.uint8)
            bits[:, 1:] = part[:, low - 1 : high] & 1
            out += [_scan([(c, 0, 1)], low, high, 1, 0), _packed_bits(bits)]
    return b"".join([*out, b"\xff\xd9"])


class _Bits:
    """Bit reader over unstuffed entropy-coded bytes; past the end it reads ones."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist() + [1] * 64
        self.at = 0

    def one(self) -> int:
        self.at += 1
        return self.bits[self.at - 1]

    def many(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.one()
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.one()
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        value = self.many(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


#: Value of seven magnitude bits in size category 7.
_FIRST = np.array([x if x >= 64 else x - 127 for x in range(128)], np.int16)


class Decoder:
    """Accumulates the scans of one progressive file."""

    def __init__(self, data: bytes):
        self.comment = b""
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
        self.parts: list[dict] = []
        self.restart = 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at = 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            (n,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._tables(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDA:
                at = self._scan(body, data, at)
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("not a Huffman-coded progressive file")

    def _tables(self, body: bytes) -> None:
        while body:
            wide, number = body[0] >> 4, body[0] & 15
            n = 64 * (1 + wide)
            self.quant[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
            body = body[1 + n :]

    def _huffman(self, body: bytes) -> None:
        while body:
            counts, at, code, codes = body[1:17], 17, 0, {}
            for n, count in enumerate(counts, 1):
                for _ in range(count):
                    codes[n, code] = body[at]
                    code += 1
                    at += 1
                code <<= 1
            self.codes[body[0] >> 4, body[0] & 15] = codes
            body = body[at:]

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, count = struct.unpack_from(">BHHB", body)
        if bits != 8:
            raise ValueError("samples of 8 bits only")
        self.parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(count)]
        self.hmax, self.vmax = max(p["h"] for p in self.parts), max(p["v"] for p in self.parts)
        self.cols, self.rows = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for p in self.parts:
            p["across"], p["down"] = self.cols * p["h"], self.rows * p["v"]
            p["own"] = -(-(-(-self.width * p["h"] // self.hmax)) // 8), -(-(-(-self.height * p["v"] // self.vmax)) // 8)
            p["coefs"] = np.zeros((p["across"] * p["down"], 64), np.int16)  # in zigzag order

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        count = body[0]
        used = [(next(p for p in self.parts if p["id"] == body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(count)]
        low, high, ah, al = body[1 + 2 * count], body[2 + 2 * count], body[3 + 2 * count] >> 4, body[3 + 2 * count] & 15
        runs, begin = [], at
        while True:
            at = data.index(b"\xff", at)
            if data[at + 1] == 0:
                at += 2
            elif 0xD0 <= data[at + 1] <= 0xD7:
                runs.append(data[begin:at])
                begin = at = at + 2
            else:
                runs.append(data[begin:at])
                break
        runs = [r.replace(b"\xff\x00", b"\xff") for r in runs]
        if len(runs) == 1 and self._whole(used, low, high, ah, al, runs[0]):
            return at
        order = self._order(used)
        step = len(order) if not self.restart else self.restart * (sum(p["h"] * p["v"] for p, *_ in used) if count > 1 else 1)
        for k, run in enumerate(runs):
            self._symbols(used, order[k * step : (k + 1) * step], low, high, ah, al, _Bits(run))
        return at

    def _order(self, used) -> list[tuple[int, int]]:
        """(component of the scan, block) in coded order."""
        if len(used) == 1:
            p = used[0][0]
            return [(0, r * p["across"] + c) for r in range(p["own"][1]) for c in range(p["own"][0])]
        return [(i, (r * p["v"] + y) * p["across"] + c * p["h"] + x) for r in range(self.rows) for c in range(self.cols) for i, (p, *_) in enumerate(used) for y in range(p["v"]) for x in range(p["h"])]

    def _whole(self, used, low, high, ah, al, run: bytes) -> bool:
        """Read a scan with codes of one width by arrays; False if its layout is another."""
        width = high - low + 1
        n = sum(len(p["coefs"]) for p, *_ in used)
        if low == 0:
            if ah == 0 and any(self.codes.get((0, d)) != {(1, 0): 0} for _, d, _ in used):
                return False
            if len(used) == 1 and used[0][0]["own"] != (used[0][0]["across"], used[0][0]["down"]):
                return False
            head, rest = run[: n // 8], run[n // 8 : n // 8 + 1]
            return len(run) >= -(-n // 8) and not head.strip(b"\0") and (n % 8 == 0 or not rest[0] >> (8 - n % 8))  # no difference, or no correction, anywhere
        part, _, table = used[0]
        if part["own"] != (part["across"], part["down"]):
            return False
        codes, coefs = self.codes.get((1, table)), part["coefs"][:, low : high + 1]
        if ah == 0 and codes == {(1, 0): 7} and len(run) == n * width:
            raw = np.frombuffer(run, np.int8).reshape(n, width)
            if raw.min() < 0 or coefs.any():
                return False
            np.left_shift(_FIRST[raw], al, out=coefs)
            return True
        if ah and codes == {(1, 0): 0} and len(run) == -(-n * (width + 1) // 8) and coefs.all():
            bits = np.unpackbits(np.frombuffer(run, np.uint8), count=n * (width + 1)).reshape(n, width + 1)
            if bits[:, 0].any():
                return False
            step = bits[:, 1:].astype(np.int16) << al
            coefs += np.where(coefs > 0, step, -step)
            return True
        return False

    def _symbols(self, used, order, low, high, ah, al, bits: _Bits) -> None:
        last, runs = [0] * len(used), 0
        for i, block in order:
            part, dc, ac = used[i]
            row = part["coefs"][block]
            if low == 0:
                if ah:
                    row[0] |= bits.one() << al
                else:
                    last[i] += bits.signed(bits.symbol(self.codes[0, dc]))
                    row[0] = last[i] << al
            elif ah == 0:
                if runs:
                    runs -= 1
                    continue
                k = low
                while k <= high:
                    s = bits.symbol(self.codes[1, ac])
                    r, size = s >> 4, s & 15
                    if size:
                        k += r
                        row[k] = bits.signed(size) << al
                        k += 1
                    elif r == 15:
                        k += 16
                    else:
                        runs = (1 << r) + bits.many(r) - 1
                        break
            else:
                runs = self._refine(row, low, high, al, bits, self.codes[1, ac], runs)

    @staticmethod
    def _refine(row, low: int, high: int, al: int, bits: _Bits, codes, runs: int) -> int:
        def correct(z: int) -> None:
            if bits.one():
                row[z] += (1 << al) if row[z] > 0 else -(1 << al)

        k = low
        if not runs:
            while k <= high:
                s = bits.symbol(codes)
                r, size = s >> 4, s & 15
                if not size and r < 15:
                    runs = (1 << r) + bits.many(r)
                    break
                value = (1 << al) * (1 if bits.one() else -1) if size else 0
                while k <= high:
                    z = k
                    if row[z]:
                        correct(z)
                    elif r == 0:
                        if value:
                            row[z] = value
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
        if runs:
            for j in range(k, high + 1):
                if row[j]:
                    correct(j)
            runs -= 1
        return runs

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor (height, width, 3); a grey file has equal channels."""
        planes = []
        for p in self.parts:
            blocks = p["coefs"] @ (self.quant[p["q"]][:, None] * IDCT[ZIGZAG])
            blocks += 128
            plane = blocks.reshape(p["down"], p["across"], 8, 8).transpose(0, 2, 1, 3).reshape(p["down"] * 8, p["across"] * 8)
            planes.append(plane.repeat(self.vmax // p["v"], 0).repeat(self.hmax // p["h"], 1)[: self.height, : self.width])
        if len(planes) == 1:
            rgb = np.stack(planes * 3, -1)
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            rgb = np.empty((*y.shape, 3), np.float32)
            rgb[..., 0] = y + 1.402 * cr
            rgb[..., 1] = y - 0.344136 * cb - 0.714136 * cr
            rgb[..., 2] = y + 1.772 * cb
        rgb += 0.5
        return np.clip(rgb, 0, 255, out=rgb).astype(np.uint8)

    def payload(self) -> bytes:
        """The payload of a file that write_payload made."""
        (length,) = struct.unpack(">Q", self.comment)
        values = np.concatenate([p["coefs"][:, 1:49].ravel() for p in self.parts])
        size = np.abs(values)
        return np.where(values > 0, size, size ^ 254).astype(np.uint8)[:length].tobytes()


_VALUES = np.arange(256)


def store_text(text: str | None) -> dict:
    """One document's media column: the stored file, what it reads back as, its tensor and features."""
    raw = (text or "").encode()
    padded = raw + b"\xff" * (UNIT - len(raw) if not raw else -len(raw) % UNIT)
    media = write_payload(padded)
    decoder = Decoder(media)
    rgb = decoder.rgb()
    flat = rgb.reshape(-1, 3)
    counts = [np.bincount(flat[:, c], minlength=256) for c in range(3)]  # exact, so equal tensors have equal features
    moments = [(int(c @ _VALUES), int(c @ _VALUES**2)) for c in counts]
    feature = ";".join([f"{decoder.width}x{decoder.height}", *(f"{a / len(flat):.4f}/{max(b / len(flat) - (a / len(flat)) ** 2, 0) ** 0.5:.4f}" for a, b in moments)])
    return {"n_bytes": len(raw), "media": media, "payload": decoder.payload(), "height": decoder.height, "width": decoder.width, "rgb": rgb.tobytes(), "feature": feature}


_TYPES = {"n_bytes": pa.int64(), "media": pa.binary(), "payload": pa.binary(), "height": pa.int32(), "width": pa.int32(), "rgb": pa.binary(), "feature": pa.string()}


def _batches(batches):
    for whole in batches:
        for batch in slices(whole, most=1 << 20):
            rows = [store_text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in _TYPES.items())], names=["doc_id", *_TYPES])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, payload, height, width, rgb, feature): one row for each row of docs."""
    return arrow_stage(id_and_text(docs, id_col, text_col), _batches, SCHEMA)
