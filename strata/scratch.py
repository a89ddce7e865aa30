"""Tables written in the shared folder, which cut lineage and survive the loss of an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.errors import OtherError

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset a folder of this machine serves, but only in local mode: executors elsewhere
    would each write to a disk of their own. The session's configuration is never changed.
    """
    global _own
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise OtherError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="strata-")
        atexit.register(shutil.rmtree, _own, True)
    return f"file://{_own}"


class Scratch:
    """Intermediate tables of one operator run.

    ``cut`` writes a frame as Parquet and reads it back: later steps neither recompute it nor hold
    its plan. ``drop`` deletes a table that no later step reads. What a lazy result still reads is
    deleted by ``clear``, at the end of a ``with`` block, or when the driver ends: pass an own
    Scratch to an operator, consume the result inside the block, and a long session keeps nothing.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/strata-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.clear)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def cut(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def counted(self, df: DataFrame, **where) -> tuple[DataFrame, int, dict[str, int]]:
        """``cut``, with the number of rows, and of those for which each condition holds: counted as they are written."""
        seen = Observation()
        back = self.cut(df.observe(seen, F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(name) for name, c in where.items()]))
        got = dict(seen.get)
        return back, got.pop("_n"), got

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := df.__dict__.pop("_scratch_path", None):  # only frames that cut() returned have one
                self._delete(path)

    def clear(self) -> None:
        atexit.unregister(self.clear)
        try:
            self._delete(self.root)
        except Exception:  # the session has ended; the folder goes with the cluster's clean-up
            pass
