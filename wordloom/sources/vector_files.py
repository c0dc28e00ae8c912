"""Vector files as a data source: read in pieces, written by tasks and committed in two steps.

A vector file is a line with the number of its rows and their length, then for each row a
word, a space, its numbers (32-bit floats, or decimals) and a line feed.  A model is one
such file or a folder of them.

Reading: a file is cut at every PIECE bytes and each cut moved to the start of a row,
which is found by a chain of whole rows.  A piece has to end exactly where the next one
starts, so a cut that was moved to a wrong place is an error and never a wrong row.
Writing: each task writes files of bounded size under names of its attempt; the driver
moves those of the attempts that count, and deletes the others.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a piece that a task reads, rows that must follow each other at a cut, and the longest word, in bytes, at a cut.
PIECE, CHAIN, LONGEST = 64 << 20, 8, 1 << 16
#: Rows of a written file.
FILE_ROWS = 1 << 16


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(path)


def _header(line: bytes) -> tuple[int, int]:
    rows, dim = map(int, line.split())
    return rows, dim


def _row_end(data: bytes, at: int, dim: int, binary: bool) -> int | None:
    """Where the row at a place ends; None if the data end before it; -1 if there is none."""
    space = data.find(b" ", at, at + LONGEST)
    if space < 0:
        return None if len(data) - at < LONGEST else -1
    if space == at or b"\n" in data[at:space]:
        return -1
    end = space + 1 + 4 * dim if binary else data.find(b"\n", space)
    if not binary and end >= 0:
        return end + 1 if len(data[space:end].split()) == dim else -1
    if end < 0 or end >= len(data):
        return None
    return end + 1 if data[end : end + 1] == b"\n" else -1


def row_start(data: bytes, dim: int, binary: bool, whole: bool) -> int | None:
    """The first place, after a line feed of the data, from which rows follow each other; whole: the data go to the file's end."""
    at = data.find(b"\n")
    while at >= 0:
        place, rows = at + 1, 0
        while rows < CHAIN:
            if whole and place == len(data):
                return at + 1
            end = _row_end(data, place, dim, binary)
            if end is None or end < 0:
                break
            place, rows = end, rows + 1
        if rows == CHAIN:
            return at + 1
        at = data.find(b"\n", at + 1)
    return None


def parse_rows(data: bytes, dim: int, binary: bool) -> tuple[list[str], np.ndarray]:
    """Words and vectors of whole rows; an error if the data are anything else."""
    words, places, at = [], [], 0
    while at < len(data):
        end = _row_end(data, at, dim, binary)
        if end is None or end < 0:
            raise ValueError("a vector file's rows do not follow each other")
        space = data.index(b" ", at)
        words.append(data[at:space].decode())
        places.append((space + 1, end - 1))
        at = end
    if binary:
        raw = np.frombuffer(data, np.uint8)
        starts = np.array([a for a, _ in places], np.int64)
        return words, raw[starts[:, None] + np.arange(4 * dim)].copy().view("<f4").reshape(len(words), dim) if words else np.zeros((0, dim), np.float32)
    return words, np.array([data[a:b].split() for a, b in places], np.float32).reshape(len(words), dim)


@dataclass
class Piece(InputPartition):
    path: str
    piece: int
    start: int
    end: int
    dim: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.binary, self.piece = options["path"], options.get("binary", "true") == "true", int(options.get("piece", PIECE))

    def partitions(self):
        fs, inner = file_system(self.path)
        info = fs.get_file_info(inner)
        files = [info] if info.is_file else sorted((f for f in fs.get_file_info(pa.fs.FileSelector(inner)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        if not files and not info.is_file:
            raise FileNotFoundError(self.path)
        out = []
        for f in files:
            with fs.open_input_file(f.path) as source:
                line = source.read(64).partition(b"\n")[0]
                rows, dim = _header(line)
                cuts = [len(line) + 1]
                for place in range(self.piece, f.size, self.piece):
                    if place <= cuts[-1]:
                        continue
                    size = LONGEST + (CHAIN + 2) * ((4 if self.binary else 32) * dim + 256)
                    source.seek(place)
                    data = source.read(size)
                    found = row_start(data, dim, self.binary, place + len(data) == f.size)
                    if found is not None and cuts[-1] < place + found < f.size:
                        cuts.append(place + found)
            out += [Piece(f.path, i, a, b, dim) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], f.size], strict=True))] if rows else []
        return out or [Piece("", 0, 0, 0, 0)]

    def read(self, partition):
        if partition.end <= partition.start:
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.path) as source:
            source.seek(partition.start)
            words, vectors = parse_rows(source.read(partition.end - partition.start), partition.dim, self.binary)
        for a in range(0, len(words), 10_000):
            part, n = vectors[a : a + 10_000], len(words[a : a + 10_000])
            listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * partition.dim, pa.int32()), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n, pa.string()), pa.array([partition.piece] * n, pa.int32()), pa.array(np.arange(a, a + n)), pa.array(words[a : a + n], pa.string()), listed], names=["path", "piece", "row", "word", "vec"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.binary, self.overwrite = options["path"], options.get("binary", "true") == "true", overwrite
        self.rows = int(options.get("file_rows", FILE_ROWS))
        self.waiting = f"_waiting-{uuid.uuid4().hex}"

    def write(self, iterator):
        fs, inner = file_system(self.path)
        fs.create_dir(f"{inner}/{self.waiting}", recursive=True)
        context = TaskContext.get()
        attempt, files, held = uuid.uuid4().hex, [], []

        def flush(batch: pa.Table) -> None:
            words = batch["word"].to_pylist()
            if any(w is None or not w or " " in w or "\n" in w for w in words):
                raise ValueError("a word of a vector file has signs, and neither spaces nor line feeds")
            vectors = [np.asarray(v, "<f4") for v in batch["vec"].to_pylist()]
            sizes = {len(v) for v in vectors}
            if len(sizes) != 1:
                raise ValueError("vectors of one file have one length")
            name = f"part-{context.partitionId():06d}-{len(files):06d}.bin"
            with fs.open_output_stream(f"{inner}/{self.waiting}/{name}-{attempt}", compression=None) as out:
                out.write(f"{len(words)} {sizes.pop()}\n".encode())
                for word, v in zip(words, vectors, strict=True):
                    out.write(word.encode() + b" " + (v.tobytes() if self.binary else " ".join(f"{x:f}" for x in v).encode()) + b"\n")
            files.append((f"{name}-{attempt}", name))

        for batch in iterator:
            held.append(batch)
            while sum(b.num_rows for b in held) >= self.rows:
                whole = pa.Table.from_batches(held)
                flush(whole.slice(0, self.rows))
                held = whole.slice(self.rows).to_batches()
        if sum(b.num_rows for b in held):
            flush(pa.Table.from_batches(held))
        return _Written(files)

    def commit(self, messages):
        fs, inner = file_system(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pa.fs.FileSelector(inner, allow_not_found=True)):
                if f.is_file:
                    fs.delete_file(f.path)
        fs.create_dir(inner, recursive=True)
        written = [x for m in messages if m is not None for x in m.files]
        for temporary, name in written:
            fs.move(f"{inner}/{self.waiting}/{temporary}", f"{inner}/{name}")
        if not written:
            with fs.open_output_stream(f"{inner}/part-000000-000000.bin", compression=None) as out:
                out.write(b"0 0\n")
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self) -> None:
        fs, inner = file_system(self.path)
        if fs.get_file_info(f"{inner}/{self.waiting}").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{inner}/{self.waiting}")


class VectorFiles(DataSource):
    """spark.read.format("word_vectors").load(path) and df.write.format("word_vectors").save(path); options: binary, piece (bytes), file_rows."""

    @classmethod
    def name(cls) -> str:
        return "word_vectors"

    def schema(self) -> str:
        return "path string, piece int, row long, word string, vec array<float>"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)
