"""Text files of fixed format as Spark data sources: k-mer files read by byte ranges, numbered lines, and lines written with a commit.

Paths are URIs that pyarrow can open (``file:``, ``s3:``, ``hdfs:`` and others) or plain ones; on a cluster all executors
and the driver must reach them. A folder stands for the files in it, by name, without those that begin with ``_`` or a dot.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a file that a task reads, and of these in memory at a time.
SPLIT, READ = 64 << 20, 4 << 20
#: What a k-mer line has besides its k letters: a separator, two extensions, the line's end.
REST = 4
NEWLINE = 10


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files that ``path`` stands for."""
    system, place = opened(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else sorted((x for x in system.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.File and x.base_name[0] not in "_."), key=lambda x: x.path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    return [(prefix + x.path, x.size) for x in found]


@dataclass
class Range(InputPartition):
    path: str
    number: int
    begin: int
    end: int
    before: int = 0


def ranges(path: str, split: int, unit: int = 1) -> list[Range]:
    """The byte ranges of whole units of each file, in order; what is left of a file after its last whole unit is in none."""
    out: list[Range] = []
    step = max(1, split // unit) * unit
    for at, size in listed(path):
        for begin in range(0, size // unit * unit, step):
            out.append(Range(at, len(out), begin, min(begin + step, size // unit * unit)))
    return out


def _read(path: str, begin: int, end: int, piece: int = READ) -> Iterator[bytes]:
    system, place = opened(path)
    with system.open_input_file(place) as f:
        for at in range(begin, end, piece):
            yield f.read_at(min(piece, end - at), at)


class _Ranged(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.split)


class KmerFiles(DataSource):
    """(kmer, b_ext, f_ext) of fixed-width lines. Options: path, k (the first word's length if not given), split.

    A partition is a byte range of whole lines, so no line is read twice or sought. What follows a file's last line end is
    not a line, and is not read if it is shorter than a line. Anywhere else a line of another length is an error that names its place.
    """

    @classmethod
    def name(cls) -> str:
        return "kmers"

    def schema(self) -> str:
        return "kmer string, b_ext string, f_ext string"

    def reader(self, schema) -> DataSourceReader:
        return _KmerReader(self.options)


class _KmerReader(_Ranged):
    def __init__(self, options: dict):
        super().__init__(options)
        self.k = int(options.get("k") or width(self.path))

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.split, self.k + REST)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        k, unit, at = self.k, self.k + REST, part.begin
        for data in _read(part.path, part.begin, part.end, READ // unit * unit or unit):
            lines = np.frombuffer(data, np.uint8).reshape(-1, unit)
            odd = np.flatnonzero((lines[:, -1] != NEWLINE) | (lines[:, :-1] == NEWLINE).any(axis=1))
            if len(odd):
                raise ValueError(f"{part.path}: the line at byte {at + int(odd[0]) * unit} has not {unit} bytes")
            yield pa.RecordBatch.from_arrays([_strings(lines[:, :k]), _strings(lines[:, k + 1 : k + 2]), _strings(lines[:, k + 2 : k + 3])], ["kmer", "b_ext", "f_ext"])
            at += len(data)


def _strings(letters: np.ndarray) -> pa.Array:
    """Rows of letters as strings of one length."""
    n, size = letters.shape
    offsets = np.arange(n + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(letters).tobytes())])


class Newlines(DataSource):
    """(number, n): the line ends in each byte range of the files. Options: path, split."""

    @classmethod
    def name(cls) -> str:
        return "newlines"

    def schema(self) -> str:
        return "number long, n long"

    def reader(self, schema) -> DataSourceReader:
        return _NewlineReader(self.options)


class _NewlineReader(_Ranged):
    def read(self, part: Range) -> Iterator[tuple[int, int]]:
        yield part.number, sum(data.count(b"\n") for data in _read(part.path, part.begin, part.end))


class NumberedLines(DataSource):
    """(line_no, value): the lines of the files one after another, from 0. Options: path, split, before: as JSON the number of line ends before each range.

    A line belongs to the range that its first byte is in. An unterminated last line of a file is a line here.
    """

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "line_no long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


class _LineReader(_Ranged):
    def __init__(self, options: dict):
        super().__init__(options)
        self.before = json.loads(options["before"])

    def partitions(self) -> list[Range]:
        found = ranges(self.path, self.split)
        for part, before in zip(found, self.before, strict=True):
            part.before = before
        return found

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, place = opened(part.path)
        with system.open_input_file(place) as f:
            # from the byte before the range, so that the first line is the one after the first line end
            number, start, held, within = part.before, max(0, part.begin - 1), b"", part.begin == 0
            f.seek(start)
            while start < part.end:
                data = f.read(READ)
                if not data:
                    if held and within:
                        yield _numbered(number, [held])
                    return
                held += data
                if not within:
                    k = held.find(b"\n") + 1
                    number += k > 0 and start + k > part.begin
                    start, held, within = start + (k or len(held)), held[k:] if k else b"", k > 0
                    if not within:
                        continue
                last = held.rfind(b"\n") + 1
                lines = held[:last].split(b"\n")[:-1]
                begins = start + np.cumsum([0, *(len(x) + 1 for x in lines)])[:-1]
                own = int(np.searchsorted(begins, part.end))
                if own:
                    yield _numbered(number, lines[:own])
                if own < len(lines):
                    return
                number, start, held = number + own, start + last, held[last:]


def _numbered(first: int, lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines, pa.binary()).cast(pa.string())], ["line_no", "value"])


@dataclass
class Part(WriterCommitMessage):
    number: int
    staged: str


class LineFiles(DataSource):
    """A sink for one column, value: a line for each row, a file ``<prefix>_<n>.dat`` for the n-th partition. Options: path, prefix.

    Tasks write to a staging folder; the commit moves what succeeded to its place and removes the folder, so neither a failed or repeated
    task nor an aborted job leaves a part. The folder must be new, or ``overwrite`` asked for: its files then go at the commit.
    """

    @classmethod
    def name(cls) -> str:
        return "line_files"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if schema.names != ["value"]:
            raise ValueError("line files have one column, value")
        return _LineWriter(self.options, overwrite)


class _LineWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.prefix, self.overwrite = options["path"].rstrip("/"), options.get("prefix", "part"), overwrite
        self.staging = f"{self.path}/_staged-{uuid.uuid4().hex}"
        if not overwrite and (old := self._old()):
            raise FileExistsError(f"{self.path} holds {old[0]}")

    def _old(self) -> list[str]:
        system, place = opened(self.path)
        return [x.path for x in system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if x.type == fs.FileType.File]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        system, folder = opened(self.staging)
        system.create_dir(folder, recursive=True)
        staged = f"{folder}/{number}-{uuid.uuid4().hex}"
        with system.open_output_stream(staged) as out:
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    out.write((text or "").encode() + b"\n")
        return Part(number, staged)

    def commit(self, messages: list[Part | None]) -> None:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in self._old():
                system.delete_file(old)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        digits = len(str(max((p.number for p in parts), default=0)))
        for p in parts:
            system.move(p.staged, posixpath.join(folder, f"{self.prefix}_{p.number:0{digits}d}.dat"))
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = opened(self.staging)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def register(spark: SparkSession) -> SparkSession:
    for source in (KmerFiles, Newlines, NumberedLines, LineFiles):
        spark.dataSource.register(source)
    return spark


def width(path: str) -> int:
    """The length of the first word of the first file: k of a k-mer file. 0 for a file without a word."""
    for at, size in listed(path)[:1]:
        word = b""
        for data in _read(at, 0, size, 4096):
            word = (word + data).lstrip()
            if word and len(found := word.split(None, 1)) > 1 or word and word[-1:].isspace():
                return len(found[0])
        return len(word.split(None, 1)[0]) if word else 0
    return 0


def read_kmers(spark: SparkSession, path: str, k: int | None = None, split: int = SPLIT) -> DataFrame:
    """(kmer, b_ext, f_ext) of a k-mer file or a folder of them."""
    reader = register(spark).read.format("kmers").option("path", path).option("split", split)
    return (reader.option("k", k) if k else reader).load()


def line_count(spark: SparkSession, path: str, split: int = SPLIT) -> int:
    """The number of line ends; an unterminated last line is not counted."""
    return register(spark).read.format("newlines").option("path", path).option("split", split).load().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def numbered_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(line_no, value): the lines of all files, numbered from 0 through them in order. Line ends are counted first, for each range; a file that ends without one ends a line all the same only if it is the last."""
    counts = register(spark).read.format("newlines").option("path", path).option("split", split).load().orderBy("number").collect()  # one row for each ``split`` bytes
    before, total = [], 0
    for r in counts:
        before.append(total)
        total += r.n
    return spark.read.format("numbered_lines").option("path", path).option("split", split).option("before", json.dumps(before)).load()


def write_lines(lines: DataFrame, path: str, prefix: str = "part", overwrite: bool = False) -> None:
    """The column value of ``lines`` to ``<path>/<prefix>_<n>.dat``, a file for each partition in their order."""
    register(lines.sparkSession)
    lines.select("value").write.format("line_files").option("path", path).option("prefix", prefix).mode("overwrite" if overwrite else "append").save()


def write_contigs(contigs: DataFrame, path: str, prefix: str = "contigs") -> None:
    """One contig a line, one file per partition."""
    write_lines(contigs.select(F.col("contig").alias("value")), path, prefix)


def write_trajectory(frames: DataFrame, path: str, n: int, size: float) -> None:
    """``n size`` once, then for each frame of (frame, id, x, y) a line ``x y`` for every particle in order of id and an empty line; numbers with up to six significant digits. The files' order is that of their names."""

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [f"{x:g} {y:g}" for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["frame", "id", "value"])

    rows = frames.select(F.col("frame").cast("long").alias("frame"), F.col("id").cast("long").alias("id"), "x", "y")
    lines = rows.mapInArrow(shown, "frame long, id long, value string").withColumn("last", F.lit(False))
    ends = rows.select("frame").distinct().select("frame", F.lit(None).cast("long").alias("id"), F.lit("").alias("value"), F.lit(True).alias("last"))
    head = frames.sparkSession.createDataFrame([(None, None, f"{n} {size:g}", False)], lines.schema)
    write_lines(head.unionAll(lines).unionAll(ends).orderBy(F.asc_nulls_first("frame"), "last", "id"), path, "frames")


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """(frame, nth, x, y) of a trajectory, both numbered from 0. A frame is as many lines as the first line says, and an empty one."""
    lines = numbered_lines(spark, path)
    head = lines.where("line_no = 0").first()
    n = int(head.value.split()[0]) if head else 0
    at, words = F.col("line_no") - 1, F.split("value", " ")
    frame = F.floor(at / (n + 1)).cast("long")
    return lines.where((F.col("line_no") > 0) & (at % (n + 1) < n)).select(frame.alias("frame"), (at % (n + 1)).alias("nth"), words[0].cast("double").alias("x"), words[1].cast("double").alias("y"))


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames as Parquet, a folder for each."""
    frames.write.partitionBy("frame").parquet(path)
