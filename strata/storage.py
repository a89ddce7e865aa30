"""Where a repository keeps its snapshots and logs: Parquet folders, or files of the binary format behind any provider.

A storage gives frames of what is stored and takes new logs and snapshots under free numbers:

    read_meta, write_meta      name, type of elements, digest, user fields
    index()                    (statesum, ss) of the snapshots
    commits(), changes(kind)   the logs
    snapshot(ss, kind)         (elt_id, elt)
    log_numbers(), new_log(ss, cl, rows, changes), new_snapshot(ss, row, state)

``new_log`` and ``new_snapshot`` give False where the number is taken; nothing is ever replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import ArgError, OtherError
from strata.functions import sequences
from strata.sources import codec, files

COMMITS = "statesum string, parents array<string>, number bigint, ts bigint, ext_flags int, extra string, n_changes bigint, seq bigint, ss bigint, cl bigint"
INDEX = "statesum string, ss bigint"

#: How elements of a type become bytes and come back. A NULL element has no bytes: writing one is an error.
Codec = tuple[Callable[[Column], Column], Callable[[Column], Column]]
ELEMENTS: dict[str, Codec] = {
    "string": (lambda c: F.encode(c, "utf-8"), lambda c: F.decode(c, "utf-8")),
    "binary": (lambda c: c, lambda c: c),
    "array<double>": (sequences.to_bytes, sequences.from_bytes),
}


def element_codec(kind: str, codecs: dict[str, Codec] | None = None) -> Codec:
    known = {**ELEMENTS, **(codecs or {})}
    if kind not in known:
        raise ArgError(f"no bytes for elements of type {kind}")
    return known[kind]


class ParquetStorage:
    """Folders of Parquet files on any file system that Spark reaches.

    A number is taken by creating a file that must not exist, so that of two writers one gets it.
    Changes are written before their commits and snapshots before their index, so that a reader who
    starts from commits and index sees whole ones only.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _claim(self, name: str) -> bool:
        from py4j.protocol import Py4JJavaError

        p, fs = self._fs(f"{self.root}/claims/{name}")
        try:
            fs.create(p, False).close()
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        return True

    def exists(self) -> bool:
        return self._exists(f"{self.root}/meta")

    def read_meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/meta").first()[0])

    def write_meta(self, meta: dict) -> None:
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{self.root}/meta")

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.root}/snapshot_index")

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")

    def changes(self, kind: str) -> DataFrame:
        schema = f"statesum string, elt_id bigint, op string, elt {kind}, ss bigint, cl bigint"
        path = f"{self.root}/changes"
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def snapshot(self, ss: int, kind: str) -> DataFrame:
        return self.spark.read.schema(f"elt_id bigint, elt {kind}").parquet(f"{self.root}/snapshots/ss={ss}")

    def log_numbers(self) -> DataFrame:
        return self.commits().select("ss", "cl").distinct()

    def new_log(self, ss: int, cl: int, rows: list[dict], changes: DataFrame | None) -> bool:
        if not self._claim(f"ss{ss}-cl{cl}"):
            return False
        if changes is not None:
            changes.sortWithinPartitions("elt_id").write.mode("errorifexists").parquet(f"{self.root}/changes/ss={ss}/cl={cl}")
        bare = ", ".join(COMMITS.split(", ")[:-2])
        self.spark.createDataFrame(rows, bare).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/commits/ss={ss}/cl={cl}")
        return True

    def new_snapshot(self, ss: int, row: dict, state: DataFrame) -> bool:
        if not self._claim(f"ss{ss}"):
            return False
        state.select("elt_id", "elt").repartitionByRange("elt_id").sortWithinPartitions("elt_id").write.mode("errorifexists").parquet(f"{self.root}/snapshots/ss={ss}")
        one = self.spark.createDataFrame([(row["statesum"],)], "statesum string").coalesce(1)
        one.write.mode("errorifexists").parquet(f"{self.root}/snapshot_index/ss={ss}")
        return True


class BinaryStorage:
    """Files of the binary format in any provider of numbered byte strings (see :mod:`strata.sources.streams`).

    Files are decoded in the tasks, a file by a task. A snapshot's elements and a log's changes are
    encoded in the tasks, by ranges of their ids, and pass through the driver piece by piece, as the
    format wants one file with one checksum.
    """

    def __init__(self, spark: SparkSession, provider, *, elt_type: str = "binary", word: bytes = codec.WORD, codecs: dict[str, Codec] | None = None):
        self.spark, self.provider, self.elt_type, self.word, self.codecs = spark, provider, elt_type, word, codecs
        self._header: codec.Header | None = None

    def _numbers(self, what: str) -> list[tuple[int, int | None]]:
        n = self.provider.ss_len()
        if what in ("elements", "states"):
            return [(ss, None) for ss in range(n) if self.provider.has_snapshot(ss)]
        return [(ss, cl) for ss in range(n) for cl in range(self.provider.cl_len(ss))]

    def _read(self, what: str, only: int | None = None) -> DataFrame:
        numbers = [x for x in self._numbers(what) if only is None or x[0] == only]
        schema, provider = files.SCHEMAS[what], self.provider
        if hasattr(provider, "rows"):
            return provider.rows(self.spark, what, numbers)
        todo = self.spark.createDataFrame(numbers, "ss bigint, cl bigint").repartition(max(1, len(numbers)))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for ss, cl in zip(f["ss"], f["cl"]):
                    cl = None if pd.isna(cl) else int(cl)
                    data = provider.read_snapshot(int(ss)) if cl is None else provider.read_log(int(ss), cl)
                    if data is not None:
                        yield from files.frames_of(what, "", int(ss), cl, data)

        return todo.mapInPandas(run, schema)

    def exists(self) -> bool:
        return self.provider.ss_len() > 0

    def read_meta(self) -> dict:
        """From the header of the newest snapshot."""
        for ss in reversed(range(self.provider.ss_len())):
            if (data := self.provider.read_snapshot(ss)) is not None:
                self._header = codec.read_header(codec.Input(data))
                user = {f"field{i}": f.value if f.kind == "text" else f.value.hex() for i, f in enumerate(self._header.user)}
                return {"name": self._header.name, "elt_type": self.elt_type, "digest": "blake2", "user": user}
        raise OtherError("no snapshot to read a header from")

    def write_meta(self, meta: dict) -> None:
        """The header is part of every file."""

    def header(self, kind: str, name: str, user: dict | None = None) -> codec.Header:
        own = self._header.user if self._header else tuple(codec.Field("text", f"{k}={v}") for k, v in (user or {}).items())
        return codec.Header(kind, name, own)

    def use(self, name: str, user: dict) -> None:
        self._header = self.header("snapshot", name, user)

    def index(self) -> DataFrame:
        return self._read("states").select("statesum", "ss")

    def commits(self) -> DataFrame:
        """Those of the logs, and those that snapshots bring along."""
        names = [x.split()[0] for x in COMMITS.split(", ")]
        at = F.lit(-1).cast("bigint")
        states = self._read("states").withColumns({"n_changes": F.lit(0).cast("bigint"), "seq": at, "cl": at})
        return self._read("commits").select(*names).unionByName(states.select(*names))

    def changes(self, kind: str) -> DataFrame:
        decode = element_codec(kind, self.codecs)[1]
        return self._read("changes").select("statesum", "elt_id", "op", decode(F.col("data")).alias("elt"), "ss", "cl")

    def snapshot(self, ss: int, kind: str) -> DataFrame:
        return self._read("elements", ss).select("elt_id", element_codec(kind, self.codecs)[1](F.col("data")).alias("elt"))

    def log_numbers(self) -> DataFrame:
        return self.spark.createDataFrame(self._numbers("commits"), "ss bigint, cl bigint")

    def _bytes(self, kind: str) -> Column:
        missing = F.raise_error(F.lit("a NULL element has no bytes")).cast("binary")
        return F.coalesce(element_codec(kind, self.codecs)[0](F.col("elt")), missing)

    def new_log(self, ss: int, cl: int, rows: list[dict], changes: DataFrame | None) -> bool:
        rows = [r for r in rows if r["parents"]]  # the blank state is its snapshot's
        if not rows:
            return True
        commits = [codec.Commit(bytes.fromhex(r["statesum"]), tuple(map(bytes.fromhex, r["parents"])), codec.Meta(r["number"], r["ts"], r["ext_flags"], r["extra"])) for r in rows]
        header = self.header("log", self._header.name)
        if changes is None:
            return self.provider.new_log(ss, cl, codec.write_log(commits, header, self.word))
        data = F.when(F.col("op") != "DEL", self._bytes(self.elt_type))
        at = self.spark.createDataFrame([(r["statesum"], i) for i, r in enumerate(rows)], "statesum string, seq bigint")
        seq = F.coalesce("seq", F.raise_error(F.lit("a change of a commit that the log does not hold")).cast("bigint"))
        own = changes.select("statesum", "elt_id", "op", data.alias("data")).join(F.broadcast(at), "statesum", "left").withColumn("seq", seq)
        return files.export_log(own, commits, self.provider, ss, cl, header, self.word)

    def new_snapshot(self, ss: int, row: dict, state: DataFrame) -> bool:
        rows = state.select("elt_id", self._bytes(self.elt_type).alias("data"))
        meta = codec.Meta(row["number"], row["ts"], row["ext_flags"], row["extra"])
        return files.export_snapshot(rows, self.provider, ss, self.header("snapshot", self._header.name), meta, list(map(bytes.fromhex, row["parents"])), self.word)
