"""Packed shot files (b8, ptb64, r8) as a Spark data source.

``spark.read.format("shots")`` plans byte ranges of whole records into partitions of the session's split size; a task decodes
its ranges a few megabytes at a time. ``df.write.format("shots")`` takes rows (shot_id, pos: sorted bit positions), range partitioned and
sorted by shot; tasks write into a hidden folder, and the files appear together when the job commits, or not at all.

Options: ``encoding``; ``n_meas``, ``n_det``, ``n_obs``; ``split_bytes`` and ``parallelism`` (by ``session_options``); ``index`` for hits of r8 files,
whose ranges cannot be read without the position at which each begins (see ``shots.index_runs``). The option ``view`` says what is read:

* ``hits`` (default): shot_id, kind, idx
* ``chunks``: first_shot, content; whole records of a range, at most CHUNK bytes a row, or the option ``piece_bytes`` if it is less (b8, ptb64)
* ``ranges``: first_shot, shots; from file lengths alone (b8, ptb64)
* ``advance``: file, start, size, total; how far the bytes of a range move on (r8)
* ``files``: file, shots, bytes; what the last write into the folder committed

Paths carry a scheme. Names that begin with ``_`` or ``.`` are not read.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Bytes fetched and bytes decoded at a time. A set bit takes some 60 bytes while its piece is turned into rows, so a piece is small.
FETCH = 4 << 20
CHUNK = 128 << 10
SPLIT = 128 << 20
LEAST_SPLIT = 64 << 10
MANIFEST = "_manifest.json"
VIEWS = {
    "hits": "shot_id bigint, kind string, idx int",
    "chunks": "first_shot bigint, content binary",
    "ranges": "first_shot bigint, shots bigint",
    "advance": "file string, start bigint, size bigint, total bigint",
    "files": "file string, shots bigint, bytes bigint",
}


# ---- files ---------------------------------------------------------------------------------------


def open_path(uri: str):
    """File system and name of a path with a scheme."""
    scheme, sep, rest = uri.partition(":")
    if not sep or "/" in scheme:
        raise ValueError(f"a path with its scheme is needed, not {uri}")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


def list_files(uri: str) -> list[tuple[str, int]]:
    """(name, length) of the files under a folder, a file or a pattern, in name order."""
    head, star, _ = uri.partition("*")
    fs, name = open_path(head.rsplit("/", 1)[0] if star else uri)
    pattern = open_path(uri)[1] if star else None
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.File:
        return [(name, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = fs.get_file_info(pafs.FileSelector(name, recursive=True))
    hidden = lambda path: any(part.startswith(("_", ".")) for part in path[len(name) :].split("/"))
    wanted = [f for f in found if f.type == pafs.FileType.File and f.size and not hidden(f.path)]
    return sorted((f.path, f.size) for f in wanted if pattern is None or fnmatch.fnmatch(f.path, pattern) or fnmatch.fnmatch(f.path, f"{pattern}/*"))


@dataclass(frozen=True)
class Range:
    """Bytes of one file. ``first`` is the first shot, for r8 with an index the first shot of the file; ``at`` the position in the file (r8)."""

    file: str
    start: int
    size: int
    first: int = 0
    at: int = 0


@dataclass
class Ranges(InputPartition):
    pieces: list[Range]


def cut_files(files: list[tuple[str, int]], align: int, per: int, step: int) -> list[Range]:
    """Ranges of at most ``step`` bytes, cut at multiples of ``align`` bytes that hold ``per`` shots each."""
    out, first = [], 0
    step = max(align, step // align * align)
    for name, length in files:
        if length % align:
            raise ValueError(f"length is not a multiple of {align} bytes: {name}")
        for start in range(0, length, step):
            out.append(Range(name, start, min(step, length - start), first + start // align * per))
        first += length // align * per
    return out


def packed_together(ranges: list[Range], limit: int) -> list[Ranges]:
    """Neighbouring ranges in partitions of about ``limit`` bytes."""
    out: list[Ranges] = []
    room = 0
    for r in ranges:
        if not out or r.size > room:
            out.append(Ranges([]))
            room = limit
        out[-1].pieces.append(r)
        room -= r.size
    return out


# ---- bytes to positions --------------------------------------------------------------------------


def advance(data: np.ndarray) -> np.ndarray:
    """How far each run-length byte moves on."""
    return np.where(data == 255, 255, data.astype(np.int64) + 1)


@dataclass(frozen=True)
class Shape:
    """Bits of a record by kind, and the encoding of the records."""

    encoding: str
    n_meas: int = 0
    n_det: int = 0
    n_obs: int = 0

    @property
    def bits(self) -> int:
        return self.n_meas + self.n_det + self.n_obs

    @property
    def align(self) -> int:
        """Smallest number of bytes that can be read alone."""
        return {"b8": (self.bits + 7) // 8, "ptb64": 8 * self.bits, "r8": 1}[self.encoding]

    @property
    def per(self) -> int:
        """Shots in these bytes."""
        return {"b8": 1, "ptb64": 64, "r8": 0}[self.encoding]

    def positions(self, data: np.ndarray, first: int, at: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(shot, position) of the set bits in a piece, and where the next piece of an r8 file begins."""
        if self.encoding == "b8":
            row, pos = np.nonzero(np.unpackbits(data.reshape(-1, self.align), axis=1, bitorder="little")[:, : self.bits])
            return row + first, pos, 0
        if self.encoding == "ptb64":
            group, pos, lane = np.nonzero(np.unpackbits(data.reshape(-1, self.bits, 8), axis=2, bitorder="little"))
            return group * 64 + lane + first, pos, 0
        moved = np.cumsum(advance(data)) + at
        # Every record ends one bit past its width, so record and bit follow by division.
        where = moved[data != 255] - 1
        shot, pos = where // (self.bits + 1), where % (self.bits + 1)
        real = pos < self.bits
        return shot[real] + first, pos[real], int(moved[-1])

    def hits(self, shot: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        edges = np.array([self.n_meas, self.n_meas + self.n_det])
        kind = np.searchsorted(edges, pos, side="right")
        idx = pos - np.concatenate([[0], edges])[kind]
        names = pa.DictionaryArray.from_arrays(pa.array(kind.astype(np.int8)), pa.array(["M", "D", "L"])).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(shot.astype(np.int64)), names, pa.array(idx.astype(np.int32))], names=["shot_id", "kind", "idx"])


# ---- positions to bytes --------------------------------------------------------------------------


def _flatten(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    col = batch.column("pos")
    sizes = np.asarray(col.value_lengths())
    return np.repeat(np.arange(len(sizes)), sizes), col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), len(sizes)


def _pack_b8(batch: pa.RecordBatch, bits: int) -> bytes:
    row, pos, n = _flatten(batch)
    grid = np.zeros((n, (bits + 7) // 8 * 8), dtype=np.uint8)
    grid[row, pos] = 1
    return np.packbits(grid, axis=1, bitorder="little").tobytes()


def _pack_r8(batch: pa.RecordBatch, bits: int) -> bytes:
    row, pos, n = _flatten(batch)
    # The end mark is a bit just past the record.
    row = np.concatenate([row, np.arange(n)])
    pos = np.concatenate([pos, np.full(n, bits)])
    order = np.lexsort((pos, row))
    at = (row * (bits + 1) + pos)[order]
    gaps = np.diff(np.concatenate([[-1], at])) - 1
    full = gaps // 255
    out = np.full(int((full + 1).sum()), 255, dtype=np.uint8)
    out[np.cumsum(full + 1) - 1] = gaps % 255
    return out.tobytes()


def _pack_ptb64(batch: pa.RecordBatch, bits: int) -> bytes:
    row, pos, n = _flatten(batch)
    groups = (n + 63) // 64
    grid = np.zeros((groups, bits, 64), dtype=np.uint8)
    grid[row // 64, pos, row % 64] = 1
    return np.packbits(grid, axis=2, bitorder="little").tobytes()


PACKERS = {"b8": _pack_b8, "r8": _pack_r8, "ptb64": _pack_ptb64}


# ---- reader --------------------------------------------------------------------------------------


class ShotReader(DataSourceReader):
    def __init__(self, path: str, shape: Shape, view: str, options: dict[str, str]):
        self.path, self.shape, self.view = path, shape, view
        self.split, self.parallelism = int(options.get("split_bytes", SPLIT)), int(options.get("parallelism", 1))
        self.index, self.piece = options.get("index"), int(options.get("piece_bytes", FETCH))
        if view == "hits" and shape.encoding == "r8" and not self.index:
            raise ValueError("hits of r8 files need the option index, see index_runs")
        if shape.encoding == "r8" and view in ("chunks", "ranges") or shape.encoding != "r8" and view == "advance":
            raise ValueError(f"{shape.encoding} files have no view {view}")

    def partitions(self) -> list[InputPartition]:
        if self.view == "files":
            return [Ranges([])]
        if self.index:
            # Every planning step runs in a process of its own; only this one needs the module.
            import pyarrow.dataset as pads

            fs, name = open_path(self.index)
            rows = pads.dataset(name, filesystem=fs, format="parquet").to_table().to_pylist()
            ranges = sorted((Range(r["file"], r["start"], r["size"], r["file_shots"], r["at"]) for r in rows), key=lambda r: (r.file, r.start))
        else:
            files = list_files(self.path)
            limit = self._limit(sum(size for _, size in files))
            return list(packed_together(cut_files(files, self.shape.align, self.shape.per, limit), limit)) or [Ranges([])]
        return list(packed_together(ranges, self._limit(sum(r.size for r in ranges)))) or [Ranges([])]

    def _limit(self, total: int) -> int:
        """Split size: the session's, or less where that leaves tasks without work."""
        return min(self.split, max(min(LEAST_SPLIT, self.split), total // max(1, self.parallelism)))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        shape = self.shape
        if self.view == "files":
            yield from self._manifest()
        for r in partition.pieces:
            if self.view == "ranges":
                yield pa.RecordBatch.from_pydict({"first_shot": [r.first], "shots": [r.size // shape.align * shape.per]})
                continue
            if self.view == "advance":
                total = sum(int(advance(data).sum()) for _, data in self._pieces(r))
                yield pa.RecordBatch.from_pydict({"file": [r.file], "start": [r.start], "size": [r.size], "total": [total]})
                continue
            at = r.at
            for offset, data in self._pieces(r):
                first = r.first + offset // shape.align * shape.per
                if self.view == "chunks":
                    step = max(shape.align, self.piece // shape.align * shape.align)
                    starts = range(0, len(data), step)
                    yield pa.RecordBatch.from_pydict({"first_shot": [first + s // shape.align * shape.per for s in starts], "content": [data[s : s + step].tobytes() for s in starts]})
                else:
                    shot, pos, at = shape.positions(data, first, at)
                    yield shape.hits(shot, pos)

    def _pieces(self, r: Range) -> Iterator[tuple[int, np.ndarray]]:
        fs, _ = open_path(self.path)
        step = max(self.shape.align, CHUNK // self.shape.align * self.shape.align)
        fetch = max(step, FETCH // step * step)
        with fs.open_input_file(r.file) as f:
            for start in range(0, r.size, fetch):
                block = np.frombuffer(f.read_at(min(fetch, r.size - start), r.start + start), dtype=np.uint8)
                for at in range(0, len(block), step):
                    yield start + at, block[at : at + step]

    def _manifest(self) -> Iterator[pa.RecordBatch]:
        fs, base = open_path(self.path)
        with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
            rows = json.loads(f.read())
        if rows:
            schema = pa.schema([("file", pa.string()), ("shots", pa.int64()), ("bytes", pa.int64())])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


# ---- writer --------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    temp: str
    first: int
    shots: int
    bytes: int


class ShotWriter(DataSourceArrowWriter):
    """Tasks write hidden files; ``commit`` names them by their first shot, so that name order is shot order."""

    def __init__(self, path: str, shape: Shape, overwrite: bool):
        self.path, self.shape, self.overwrite = path, shape, overwrite
        fs, base = open_path(path)
        if not overwrite and fs.get_file_info(base).type == pafs.FileType.Directory and list_files(path):
            raise FileExistsError(f"{path} already holds files")
        # Made here and nowhere else: a task that outlives a failed job finds no folder to write into.
        self.staging = f"{base}/_temporary-{uuid.uuid4().hex}"
        fs.create_dir(self.staging, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        step = 64 if self.shape.encoding == "ptb64" else 1
        pack, bits = PACKERS[self.shape.encoding], self.shape.bits
        fs, _ = open_path(self.path)
        out, rest, message = None, None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    message = Written(f"{self.staging}/{uuid.uuid4().hex}", batch.column("shot_id")[0].as_py(), 0, 0)
                    out = fs.open_output_stream(message.temp)
                if rest is not None:
                    batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
                whole = batch.num_rows // step * step
                rest = batch.slice(whole) if whole < batch.num_rows else None
                for at in range(0, whole, 4096):
                    self._put(out, message, pack(batch.slice(at, min(4096, whole - at)), bits), min(4096, whole - at))
            if rest is not None:
                self._put(out, message, pack(rest, bits), rest.num_rows)
        finally:
            if out is not None:
                out.close()
        return message

    @staticmethod
    def _put(out, message: Written, data: bytes, shots: int) -> None:
        out.write(data)
        message.bytes += len(data)
        message.shots += shots

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = open_path(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.first)
        names = [f"{base}/shots-{m.first:020d}.{self.shape.encoding}" for m in done]
        if len(set(names)) < len(names):
            raise ValueError("two tasks hold the same shot: range partition the rows by shot first")
        old = [name for name, _ in list_files(self.path)] if self.overwrite else []
        moved: list[tuple[str, str]] = []
        try:
            for name in old:
                fs.move(name, hidden := f"{self.staging}-old-{len(moved)}")
                moved.append((hidden, name))
            for m, name in zip(done, names, strict=True):
                fs.move(m.temp, name)
                moved.append((name, m.temp))
            with fs.open_output_stream(f"{base}/{MANIFEST}") as f:
                f.write(json.dumps([{"file": n, "shots": m.shots, "bytes": m.bytes} for m, n in zip(done, names, strict=True)]).encode())
        except Exception:
            for now, before in reversed(moved):
                fs.move(now, before)
            raise
        for hidden, _ in moved[: len(old)]:
            fs.delete_file(hidden)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, _ = open_path(self.path)
        if fs.get_file_info(self.staging).type == pafs.FileType.Directory:
            fs.delete_dir(self.staging)


class ShotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shots"

    def schema(self) -> str:
        return VIEWS[self.options.get("view", "hits")]

    def _shape(self) -> Shape:
        return Shape(self.options["encoding"], *[int(self.options.get(k, 0)) for k in ("n_meas", "n_det", "n_obs")])

    def reader(self, schema) -> ShotReader:
        return ShotReader(self.options["path"], self._shape(), self.options.get("view", "hits"), dict(self.options))

    def writer(self, schema, overwrite: bool) -> ShotWriter:
        return ShotWriter(self.options["path"], self._shape(), overwrite)


def session_options(spark: SparkSession) -> dict[str, str]:
    """Split size and parallelism of the session, which a data source cannot see by itself."""
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return {"split_bytes": str(split), "parallelism": str(spark.sparkContext.defaultParallelism)}
