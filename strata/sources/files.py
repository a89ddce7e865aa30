"""Discovering, reading and writing files of the binary format with Spark.

Files are read through ``binaryFile``, one row per file, and decoded in the tasks, so any number of
files on any file system is read in parallel. Element ids come out as signed BIGINT.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strata.errors import ArgError, PathError, ReadOnly
from strata.functions.text import LOG_NAME, SNAPSHOT_NAME, file_parts
from strata.sources import codec, streams

ELEMENTS = "path string, ss bigint, statesum string, elt_id bigint, data binary"
COMMITS = "path string, ss bigint, cl bigint, seq bigint, statesum string, parents array<string>, number bigint, ts bigint, ext_flags int, extra string, n_changes bigint"
CHANGES = "path string, ss bigint, cl bigint, seq bigint, statesum string, elt_id bigint, op string, data binary"
STATES = "path string, ss bigint, statesum string, parents array<string>, number bigint, ts bigint, ext_flags int, extra string, n_elements bigint"
SCHEMAS = {"elements": ELEMENTS, "states": STATES, "commits": COMMITS, "changes": CHANGES}
OF_SNAPSHOTS = ("elements", "states")
#: Rows handed on at once.
ROWS = 4096
#: Bytes of a file that the driver holds at once while it writes them, about.
PASSED = 16 << 20


def _signed(i: int) -> int:
    return i - 2**64 if i >= 2**63 else i


def decoded(what: str, path: str, ss: int, cl: int | None, data: bytes | codec.Input) -> Iterator[tuple]:
    """Rows of one file; files of the other kind give none. Of an open file, what is larger than its window is never held."""
    src = data if isinstance(data, codec.Input) else codec.Input(data)
    header = codec.read_header(src)
    if what in OF_SNAPSHOTS and header.kind == "snapshot":
        s, n, start = codec.scan_snapshot(src, header.version)
        name = s.statesum.hex().upper()
        if what == "states":
            m = s.meta
            yield path, ss, name, [p.hex().upper() for p in s.parents], m.number, m.timestamp, m.flags, m.extra, n
            return
        src.seek(start)  # once more, as the sum comes after the elements
        for i, x, _ in codec.elements_at(src, n):
            yield path, ss, name, _signed(i), x
    elif what not in OF_SNAPSHOTS and header.kind == "log":
        for seq, (c, n, start) in enumerate(codec.scan_log(src, header.version)):
            name = c.statesum.hex().upper()
            if what == "commits":
                m = c.meta
                yield path, ss, cl, seq, name, [p.hex().upper() for p in c.parents], m.number, m.timestamp, m.flags, m.extra, n
            else:  # once more, as the sum comes after the changes
                src.seek(start)
                for i, op, x in codec.changes_at(src, n):
                    yield path, ss, cl, seq, name, _signed(i), op, x


def frames_of(what: str, path: str, ss: int, cl: int | None, data: bytes | codec.Input) -> Iterator[pd.DataFrame]:
    """The rows of one file as frames of at most ``ROWS`` rows."""
    names = [x.split()[0] for x in SCHEMAS[what].split(", ")]
    rows = decoded(what, path, ss, cl, data)
    while part := list(islice(rows, ROWS)):
        yield pd.DataFrame(part, columns=names)


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, basename, ss, cl, kind) of the snapshot and log files of a folder, not of its subfolders."""
    found = spark.read.format("binaryFile").load(folder).select("path")
    named = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("p", file_parts(F.col("name")))
    return named.where("p.kind IS NOT NULL").select("path", "name", "p.basename", "p.ss", "p.cl", "p.kind")


def lengths(files: DataFrame) -> DataFrame:
    """(ss_len, cl_len, n_snapshots, n_logs): the largest snapshot's and log's number plus one, and the counts."""
    return files.agg(
        (F.coalesce(F.max("ss"), F.lit(-1)) + 1).alias("ss_len"), (F.coalesce(F.max("cl"), F.lit(-1)) + 1).alias("cl_len"), F.count_if(F.col("kind") == "snapshot").alias("n_snapshots"), F.count_if(F.col("kind") == "log").alias("n_logs")
    )


def read(spark: SparkSession, folder: str | list[str], what: str, basename: str | None = None) -> DataFrame:
    """'elements' or 'states' of snapshots, 'commits' or 'changes' of logs.

    Files of the local file system, or mounted, are read by the tasks through a window of some MB.
    Those of other file systems come as one value each, which is at most 2 GB.
    """
    found = spark.read.format("binaryFile").load(folder)
    opened = all(x.startswith("file:") for x in found.inputFiles())
    rows = found.select("path", F.lit(None).cast("binary").alias("content") if opened else "content")
    rows = rows.withColumn("p", file_parts(F.element_at(F.split("path", "/"), -1)))
    wanted = rows.where(F.col("p.kind") == ("snapshot" if what in OF_SNAPSHOTS else "log"))
    if basename is not None:
        wanted = wanted.where(F.col("p.basename") == basename)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, ss, cl, data in zip(f["path"], f["ss"], f["cl"], f["content"]):
                number = int(ss), None if pd.isna(cl) else int(cl)
                if opened:
                    with open(re.sub("^file:/*", "/", path), "rb") as file:
                        yield from frames_of(what, path, *number, codec.FileInput(file))
                else:
                    yield from frames_of(what, path, *number, bytes(data))

    return wanted.select("path", "p.ss", "p.cl", "content").mapInPandas(run, SCHEMAS[what])


class FileSource(DataSource):
    """``spark.read.format("strata").option("what", ...).load(folder)``; register with ``register``."""

    @classmethod
    def name(cls) -> str:
        return "strata"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "elements")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in discover(self.options["path"]).files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        p = Path(partition.value)
        parts = Path(p).name
        m = re.match(SNAPSHOT_NAME, parts) or re.match(LOG_NAME, parts)
        cl = int(m[3]) if m.re.groups == 3 else None
        with p.open("rb") as file:
            yield from decoded(self.options.get("what", "elements"), str(p), int(m[2]), cl, codec.FileInput(file))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSource)


class Found:
    """Files of one repository in a folder; numbers are sparse. Writing never replaces a file."""

    def __init__(self, folder: Path, basename: str, readonly: bool = False):
        self.folder, self.basename, self.readonly = folder, basename, readonly
        self.snapshots: dict[int, Path] = {}
        self.logs: dict[tuple[int, int], Path] = {}

    @property
    def files(self) -> list[Path]:
        return [*self.snapshots.values(), *self.logs.values()]

    def ss_len(self) -> int:
        return max([*self.snapshots, *(s for s, _ in self.logs)], default=-1) + 1

    def cl_len(self, ss: int) -> int:
        return max((c for s, c in self.logs if s == ss), default=-1) + 1

    def has_snapshot(self, ss: int) -> bool:
        return ss in self.snapshots

    def read_snapshot(self, ss: int) -> bytes | None:
        return self.snapshots[ss].read_bytes() if ss in self.snapshots else None

    def read_log(self, ss: int, cl: int) -> bytes | None:
        return self.logs[ss, cl].read_bytes() if (ss, cl) in self.logs else None

    def _create(self, name: str, data: bytes | Iterable[bytes]) -> Path | None:
        if self.readonly:
            raise ReadOnly("the repository is read-only")
        path = self.folder / ((self.basename + "-" if self.basename else "") + name)
        try:
            with path.open("xb") as f:
                f.writelines(streams.pieces(data))
        except FileExistsError:
            return None
        return path

    def new_snapshot(self, ss: int, data: bytes) -> bool:
        """False if the number is taken."""
        if ss in self.snapshots or not (p := self._create(f"ss{ss}.pip", data)):
            return False
        self.snapshots[ss] = p
        return True

    def new_log(self, ss: int, cl: int, data: bytes) -> bool:
        if (ss, cl) in self.logs or not (p := self._create(f"ss{ss}-cl{cl}.piplog", data)):
            return False
        self.logs[ss, cl] = p
        return True

    def append_log(self, ss: int, cl: int, data: bytes) -> bool:
        """Adds commits to a log; False if there is none."""
        if self.readonly:
            raise ReadOnly("the repository is read-only")
        if (ss, cl) not in self.logs:
            return False
        with self.logs[ss, cl].open("ab") as f:
            f.write(data)
        return True


def basename_of(name: str) -> str | None:
    m = re.match(SNAPSHOT_NAME, name) or re.match(LOG_NAME, name)
    return None if not m else m[1] or ""


def discover(path: str, readonly: bool = False) -> Found:
    """The files of a folder, or those that share a given file's base name.

    In a folder the base name of the first file by name wins.
    """
    p = Path(path.removeprefix("file://").removeprefix("file:"))
    wanted = None
    if p.is_file():
        wanted, p = basename_of(p.name), p.parent
        if wanted is None:
            raise PathError("no file of this format", path)
    elif not p.is_dir():
        raise PathError("neither a file nor a folder", path)
    found = None
    for f in sorted(p.iterdir()):
        own = basename_of(f.name) if f.is_file() else None
        if own is None or own != (wanted if wanted is not None else own):
            continue
        wanted = own
        found = found or Found(p, own, readonly)
        if m := re.match(SNAPSHOT_NAME, f.name):
            found.snapshots[int(m[2])] = f
        else:
            m = re.match(LOG_NAME, f.name)
            found.logs[int(m[2]), int(m[3])] = f
    return found or Found(p, wanted or "", readonly)


class HadoopFiles(streams.MemoryStore):
    """Files of one repository in a folder of any file system that Spark reaches; the driver lists and writes them, the tasks read them."""

    def __init__(self, spark: SparkSession, folder: str, basename: str | None = None, readonly: bool = False):
        self.spark, self.folder, self.readonly = spark, folder.rstrip("/"), readonly
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        where = self._path(self.folder)
        self.fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.basename = basename
        self.snapshots, self.logs = {}, {}
        found = sorted(f.getPath().getName() for f in self.fs.listStatus(where) if f.isFile()) if self.fs.exists(where) else []
        for name in found:
            own = basename_of(name)
            if own is None or own != (self.basename if self.basename is not None else own):
                continue
            self.basename = own  # the first one by name wins
            if m := re.match(SNAPSHOT_NAME, name):
                self.snapshots[int(m[2])] = name
            else:
                m = re.match(LOG_NAME, name)
                self.logs[int(m[2]), int(m[3])] = name
        self.basename = self.basename or ""

    def _bytes(self, name: str | None) -> bytes | None:
        if name is None:
            return None
        stream = self.fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_snapshot(self, ss: int) -> bytes | None:
        return self._bytes(self.snapshots.get(ss))

    def read_log(self, ss: int, cl: int) -> bytes | None:
        return self._bytes(self.logs.get((ss, cl)))

    def rows(self, spark: SparkSession, what: str, numbers: list[tuple[int, int | None]]) -> DataFrame:
        """What the files of these numbers hold, decoded in the tasks."""
        if not numbers:
            return spark.createDataFrame([], SCHEMAS[what])
        names = [self.snapshots.get(ss) if cl is None else self.logs.get((ss, cl)) for ss, cl in numbers]
        return read(spark, [f"{self.folder}/{n}" for n in names if n], what, self.basename)

    def _create(self, name: str, data: bytes | Iterable[bytes]) -> str | None:
        from py4j.protocol import Py4JJavaError

        self._writable()
        name = (self.basename + "-" if self.basename else "") + name
        path = self._path(f"{self.folder}/{name}")
        try:
            out = self.fs.create(path, False)
        except Py4JJavaError:
            if self.fs.exists(path):
                return None
            raise
        for piece in streams.pieces(data):
            out.write(bytearray(piece))
        out.close()
        return name

    def new_snapshot(self, ss: int, data: bytes | Iterable[bytes]) -> bool:
        if ss in self.snapshots or not (name := self._create(f"ss{ss}.pip", data)):
            return False
        self.snapshots[ss] = name
        return True

    def new_log(self, ss: int, cl: int, data: bytes | Iterable[bytes]) -> bool:
        if (ss, cl) in self.logs or not (name := self._create(f"ss{ss}-cl{cl}.piplog", data)):
            return False
        self.logs[ss, cl] = name
        return True

    def append_log(self, ss: int, cl: int, data: bytes) -> bool:
        self._writable()
        if (ss, cl) not in self.logs:
            return False
        out = self.fs.append(self._path(f"{self.folder}/{self.logs[ss, cl]}"))
        out.write(bytearray(data))
        out.close()
        return True


def _ranges(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``data`` in that order, in as many partitions as keep the bytes of each, once encoded, to about ``PASSED``."""
    size = rows.agg(F.sum(F.coalesce(F.octet_length("data"), F.lit(0)) + 80)).first()[0] or 0  # the format adds 80 bytes at most
    return rows.repartitionByRange(-(-size // PASSED) or 1, *order).sortWithinPartitions(*order)


def export_snapshot(state: DataFrame, store, ss: int, header: codec.Header, meta: codec.Meta, parents: list[bytes] = (), word: bytes = codec.WORD) -> bool:
    """Writes (elt_id, data) as snapshot ``ss``, one file whatever number of tasks encode it; False if the number is taken.

    Elements are sorted and encoded by ranges of their ids in the tasks, and pass through the driver
    in pieces of at most ``ROWS`` elements, of which it holds one partition of about ``PASSED`` bytes at a time.
    """
    wanted = state.select("elt_id", "data").withColumn("high", F.col("elt_id") < 0)
    encoded = _ranges(wanted, "high", "elt_id").select("elt_id", "data")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), ROWS):
                part = f.iloc[at : at + ROWS]
                raw, total = [], codec.ZERO
                for i, d in zip(part["elt_id"], part["data"]):
                    x, own = codec.element_bytes(int(i) % 2**64, bytes(d))
                    raw.append(x)
                    total = codec.xor_bytes(total, own)
                yield pd.DataFrame({"raw": [b"".join(raw)], "total": [total], "n": [len(part)]})

    pieces = encoded.mapInPandas(run, "raw binary, total binary, n bigint").persist()  # counted first, then passed on
    n = pieces.agg(F.sum("n")).first()[0] or 0
    parts = ((bytes(r["raw"]), bytes(r["total"])) for r in pieces.select("raw", "total").toLocalIterator())
    try:
        return store.new_snapshot(ss, chain([codec.write_header(header, word)], codec.snapshot_stream(parts, n, parents, meta)))
    finally:
        pieces.unpersist()


def export_log(changes: DataFrame, commits: list[codec.Commit], store, ss: int, cl: int, header: codec.Header, word: bytes = codec.WORD) -> bool:
    """Writes (seq, elt_id, op, data) as log ``cl`` of snapshot ``ss``; False if the number is taken.

    ``seq`` is the position among ``commits``, whose own changes are not looked at. Changes are sorted
    and encoded in the tasks and pass through the driver as elements do in ``export_snapshot``.
    """
    order = ("seq", "high", "elt_id")
    encoded = _ranges(changes.select("seq", "elt_id", "op", "data").withColumn("high", F.col("elt_id") < 0), *order).select("seq", "elt_id", "op", "data")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for seq, own in f.groupby("seq"):
                for at in range(0, len(own), ROWS):
                    part = own.iloc[at : at + ROWS]
                    raw = [codec.change_bytes(int(i) % 2**64, op, None if d is None else bytes(d)) for i, op, d in zip(part["elt_id"], part["op"], part["data"])]
                    out.append((seq, b"".join(raw), len(part)))
            yield pd.DataFrame(out, columns=["seq", "raw", "n"])

    pieces = encoded.mapInPandas(run, "seq bigint, raw binary, n bigint").persist()  # counted first, then passed on
    try:
        n = {r["seq"]: r["n"] for r in pieces.groupBy("seq").agg(F.sum("n").alias("n")).toLocalIterator()}
        if not all(0 <= seq < len(commits) for seq in n):
            raise ArgError("a change of a commit that is not among those to be written")
        by = groupby(((r["seq"], bytes(r["raw"])) for r in pieces.select("seq", "raw").toLocalIterator()), lambda x: x[0])

        def stream() -> Iterator[bytes]:
            yield codec.write_header(header, word) + codec.LOG_START
            for seq, c in enumerate(commits):
                parts = (raw for _, raw in next(by)[1]) if seq in n else ()
                yield from codec.commit_stream(parts, n.get(seq, 0), c)

        return store.new_log(ss, cl, streams.joined(stream()))
    finally:
        pieces.unpersist()


def roundtrip_snapshot(state: DataFrame, meta: codec.Meta) -> DataFrame:
    """(elt_id, data) after encoding into snapshot files, one per Arrow batch, and decoding them again, in the tasks."""
    header = codec.Header("snapshot", "roundtrip")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = codec.write_snapshot_file([(int(i), bytes(d)) for i, d in zip(f["elt_id"], f["data"])], [], meta, header)
            _, s = codec.read_snapshot_file(raw)
            yield pd.DataFrame({"elt_id": [_signed(i) for i in s.elements], "data": list(s.elements.values())})

    out = state.select("elt_id", "data").mapInPandas(run, "elt_id bigint, data binary")
    return out.select("elt_id", F.col("data").cast("string").alias("elt"))


def roundtrip_log(changes: DataFrame, meta: codec.Meta) -> DataFrame:
    """(elt_id, op, data) after encoding into logs, a commit per Arrow batch, and decoding them again."""
    header = codec.Header("log", "roundtrip")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = tuple((int(i), op, None if d is None else bytes(d)) for i, op, d in zip(f["elt_id"], f["op"], f["data"]))
            _, got = codec.read_log_file(codec.write_log([codec.Commit(codec.ZERO, (codec.ZERO,), meta, rows)], header))
            yield pd.DataFrame([(_signed(i), op, d) for i, op, d in got[0].changes], columns=["elt_id", "op", "data"])

    out = changes.select("elt_id", "op", "data").mapInPandas(run, "elt_id bigint, op string, data binary")
    return out.select("elt_id", "op", F.col("data").cast("string").alias("elt"))
