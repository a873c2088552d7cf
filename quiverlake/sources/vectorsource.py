"""A Spark data source for vector files, read in byte ranges and written by the tasks.

    spark.read.format("vectors").option("kind", "fvecs").load(path)
    rows.write.format("vectors").option("kind", "fbin").mode("overwrite").save(path)

Planning reads names, sizes and a header of at most 8 bytes for each file; splits lie on
record borders, and a task reads its range in batches.  Tasks write their files under
`_temporary`; the commit renames them all, an abort deletes them, so a file is there whole
or not at all.  No bytes of vectors pass through the driver.

Kinds: fvecs, bvecs and ivecs repeat (dimension, values) for each record; fbin has one
header (number, dimension); uint64 and uint8 are raw arrays of `width` numbers a record.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

KINDS = {"fvecs": "<f4", "bvecs": "u1", "ivecs": "<i4"}
RAW = {"uint64": "<u8", "uint8": "u1"}
#: Bytes of a split and of a batch.
SPLIT_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def kind_of(path: str) -> str:
    """The kind of a file, by the ending of its name."""
    kind = path.rsplit(".", 1)[-1]
    if kind not in (*KINDS, "fbin"):
        raise ValueError(f"not a vector file: {path}")
    return kind


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[fs.FileInfo]:
    """A file, or the files of a folder in order of name, without hidden ones."""
    store, at = store_of(path)
    (info,) = store.get_file_info([at])
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(at))
    return sorted((f for f in found if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.base_name)


@dataclass(frozen=True)
class Layout:
    """Where a file's records lie."""

    dtype: str
    dim: int
    begin: int  # bytes before the first record
    prefix: int  # bytes before the values of a record
    count: int

    @property
    def size(self) -> int:
        return self.prefix + self.dim * np.dtype(self.dtype).itemsize


def layout_of(store: fs.FileSystem, info: fs.FileInfo, kind: str, width: int) -> Layout:
    """A file's layout, checked: 0 < dimension < 1e6 and a whole number of records."""
    with store.open_input_file(info.path) as file:
        head = file.read(8)
    if kind == "fbin":
        if len(head) < 8:
            raise ValueError(f"fbin without a header: {info.path}")
        n, d = (int(v) for v in np.frombuffer(head, "<i4"))
        if n < 0 or d < 0 or info.size != 8 + 4 * n * d:
            raise ValueError(f"fbin size does not match its header: {info.path}")
        return Layout("<f4", d, 8, 0, n)
    if kind in RAW:
        layout = Layout(RAW[kind], width, 0, 0, 0)
    else:
        d = int(np.frombuffer(head[:4], "<i4")[0]) if len(head) >= 4 else 1
        layout = Layout(KINDS[kind], d, 0, 4, 0)
    if not 0 < layout.dim < 1_000_000 or info.size % layout.size:
        raise ValueError(f"not a whole number of records: {info.path}")
    return Layout(layout.dtype, layout.dim, 0, layout.prefix, info.size // layout.size)


@dataclass
class Split(InputPartition):
    """Records first .. last - 1 of a file; `id` is the first one's id."""

    file: str
    layout: Layout
    first: int
    last: int
    id: int

    def batches(self, store: fs.FileSystem, most: int = BATCH_BYTES) -> Iterator[np.ndarray]:
        own = self.layout
        step = max(1, most // max(1, own.size))
        with store.open_input_file(self.file) as file:
            file.seek(own.begin + self.first * own.size)
            for a in range(self.first, self.last, step):
                n = min(step, self.last - a)
                raw = np.frombuffer(file.read(n * own.size), np.uint8)
                if len(raw) != n * own.size:
                    raise ValueError(f"the file has become shorter: {self.file}")
                raw = raw.reshape(n, own.size)
                if own.prefix and (np.ascontiguousarray(raw[:, :4]).view("<i4") != own.dim).any():
                    raise ValueError(f"records of several dimensions: {self.file}")
                yield np.ascontiguousarray(raw[:, own.prefix :]).view(own.dtype)


#: Kinds whose numbers are ids or counts.
WHOLE = ("ivecs", *RAW)


def _lists(x: np.ndarray, whole: bool) -> pa.Array:
    values = pa.array(x.astype(np.int64 if whole else np.float32).ravel())
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], values)


class VectorReader(DataSourceReader):
    def __init__(self, options: dict, whole: bool):
        self.path, self.options, self.whole = options["path"], options, whole

    def _kind(self, name: str) -> str:
        return self.options.get("kind") or kind_of(name)

    def partitions(self) -> list[Split]:
        """Splits of about `splitbytes` bytes; of each file the first `maxrows` records, of the folder the first `maxfiles` files."""
        get, (store, _) = self.options.get, store_of(self.path)
        found, out, total = files_of(self.path), [], 0
        for info in found[: int(get("maxfiles", len(found)))]:
            layout = layout_of(store, info, self._kind(info.path), int(get("width", 0)))
            count = min(layout.count, int(get("maxrows", layout.count)))
            step = max(1, int(get("splitbytes", SPLIT_BYTES)) // max(1, layout.size))
            start = total if get("ids", "file") == "all" else 0
            out += [Split(info.path, layout, a, min(a + step, count), start + a) for a in range(0, count, step)]
            total += count
        return out or [Split("", Layout("<f4", 1, 0, 0, 0), 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        at = split.id
        for x in split.batches(store) if split.last > split.first else ():
            yield pa.RecordBatch.from_arrays([pa.array([split.file] * len(x)), pa.array(np.arange(at, at + len(x))), _lists(x, self.whole)], names=["file", "vec_id", "embedding"])
            at += len(x)


@dataclass
class Written(WriterCommitMessage):
    """A task's file, under `_temporary`."""

    part: int
    file: str | None


def records(x: np.ndarray, kind: str) -> bytes:
    """Bytes of a file's records; bvecs values are clamped to 0..255 and truncated."""
    if kind == "fbin" or kind in RAW:
        return np.ascontiguousarray(x, RAW.get(kind, "<f4")).tobytes()
    values = np.clip(x, 0, 255) if kind == "bvecs" else x
    body = np.ascontiguousarray(values.astype(KINDS[kind])).view(np.uint8).reshape(len(x), -1)
    head = np.tile(np.array([x.shape[1]], "<i4").view(np.uint8), (len(x), 1))
    return np.concatenate([head, body], 1).tobytes()


def _matrix(column: pa.Array, dim: int | None) -> np.ndarray:
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if column.null_count or len(sizes) != 1 or dim not in (None, int(sizes[0])):
        raise ValueError("a file has vectors of one dimension, and no nulls")
    values = column.flatten()
    if values.null_count:
        raise ValueError("a vector with null components cannot be written")
    return values.to_numpy().reshape(len(column), int(sizes[0]))


class VectorWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, column: int, overwrite: bool):
        self.path, self.kind, self.column, self.overwrite = options["path"].rstrip("/"), options["kind"], column, overwrite
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One file of a task's vectors, in their order; none for a task without rows."""
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        store, at = store_of(self.path)
        folder = f"{at}/_temporary/{self.job}"
        name = f"{folder}/{part:05d}-{context.attemptNumber() if context else 0}-{uuid.uuid4().hex}"
        count, dim, out = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(self.column), dim)
            if out is None:
                store.create_dir(folder, recursive=True)
                dim, out = x.shape[1], store.open_output_stream(name)
            out.write(records(x, self.kind))
            count += len(x)
        if out is None:
            return Written(part, None)
        out.close()
        if self.kind == "fbin":  # its header needs the number of records
            with store.open_output_stream(f"{name}.whole") as whole, store.open_input_stream(name) as body:
                whole.write(np.array([count, dim], "<i4").tobytes())
                while piece := body.read(BATCH_BYTES):
                    whole.write(piece)
            name = f"{name}.whole"
        return Written(part, name)

    def commit(self, messages: list[Written | None]) -> None:
        """Rename the files part-N.<kind> in order of their tasks; with append N goes on after those that are there."""
        store, at = store_of(self.path)
        store.create_dir(at, recursive=True)
        there = [f for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name.startswith("part-")]
        first = 0 if self.overwrite else max([int(f.base_name[5:10]) + 1 for f in there], default=0)
        for old in there if self.overwrite else ():
            store.delete_file(old.path)
        done = sorted((m for m in messages if m and m.file), key=lambda m: m.part)
        for n, message in enumerate(done, first):
            store.move(message.file, f"{at}/part-{n:05d}.{self.kind}")
        self._clear(store, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*store_of(self.path))

    def _clear(self, store: fs.FileSystem, at: str) -> None:
        for folder in (f"{at}/_temporary/{self.job}", f"{at}/_temporary"):
            (info,) = store.get_file_info([folder])
            if info.type == fs.FileType.Directory and (folder.endswith(self.job) or not store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


class VectorFiles(DataSource):
    """The data source `vectors`."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def _whole(self) -> bool:
        kind = self.options.get("kind")
        return (kind or next((kind_of(f.path) for f in files_of(self.options["path"])), "")) in WHOLE

    def schema(self) -> str:
        """Numbers are floats, or whole where the kind (of the first file, if none is given) has whole ones."""
        return f"file string, vec_id long, embedding array<{'long' if self._whole() else 'float'}>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(dict(self.options), self._whole())

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        if self.options.get("kind") not in (*KINDS, *RAW, "fbin"):
            raise ValueError("option kind: fvecs, bvecs, ivecs, fbin, uint64 or uint8")
        names = [f.name for f in schema.fields]
        column = names.index("embedding") if "embedding" in names else len(names) - 1
        return VectorWriter(dict(self.options), column, overwrite)
