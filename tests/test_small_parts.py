"""Metadata functions, classifiers, stores of byte strings, the examples."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from conftest import rows
from strata.errors import ArgError, ReadOnly
from strata.functions import meta
from strata.sources import codec
from strata.sources.streams import MemoryStore, NullStore

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_meta(spark):
    df = spark.createDataFrame([(0, 946684800, 2), (2**32 - 1, 0, 1), (5, 1, 0x8000 | 4)], "number bigint, ts bigint, ext_flags int")
    got = df.select(meta.next_number(F.col("number")), meta.date_time(F.col("ts")).cast("string"), meta.unknown_essential(F.col("ext_flags"))).collect()
    assert [tuple(r) for r in got] == [(1, "2000-01-01 00:00:00", False), (2**32 - 1, "1970-01-01 00:00:00", False), (6, "1970-01-01 00:00:01", True)]
    with pytest.raises(ArgError):
        meta.checked_flags(4)
    assert meta.checked_flags(3) == 3 and meta.timestamp_now() > 946684800
    c = df.withColumn("parents", F.array(F.lit("x")))
    assert meta.explicit_commit(c.where("ext_flags < 4")).count() == 2
    with pytest.raises(Exception, match="can't be read"):
        meta.explicit_commit(c).collect()


def test_property(spark, tmp_path):
    state = spark.createDataFrame([(i, "x" * (i % 3)) for i in range(9)], "elt_id bigint, elt string")
    size = meta.Property("size", F.length)
    assert rows(size.counts(state)) == [(0, 3), (1, 3), (2, 3)]
    assert rows(size.select(state, 2), "elt_id") == [(2,), (5,), (8,)]
    size.write(state, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("size = 1").count() == 3


def test_stores():
    s = MemoryStore()
    assert s.ss_len() == 0 and not s.new_log(0, 0, b"")
    snap = codec.write_snapshot_file([], [], codec.Meta(0, 0), codec.Header("snapshot", "m"))
    assert s.new_snapshot(0, snap) and not s.new_snapshot(0, b"") and s.new_log(0, 3, b"a") and s.append_log(0, 3, b"b") and not s.append_log(0, 4, b"")
    assert (s.ss_len(), s.cl_len(0), s.read_log(0, 3), s.read_log(1, 1), s.read_snapshot(0), s.has_snapshot(1)) == (1, 4, b"ab", None, snap, False)
    with pytest.raises(ReadOnly):
        MemoryStore(readonly=True).new_snapshot(0, b"")
    n = NullStore()
    assert n.new_snapshot(0, b"x") and n.new_log(5, 5, b"") and n.append_log(1, 1, b"") and n.read_snapshot(0) is None and n.ss_len() == 0


def test_nothing_outside_llm_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "strata")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "strata.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()


def test_examples(tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT}
    for args in (["hello.py", str(tmp_path / "h"), "first text"], ["sequences.py", str(tmp_path / "s"), "--rows", "20", "--snapshot", "--list", "2"]):
        done = subprocess.run([sys.executable, os.path.join(ROOT, "examples", args[0]), *args[1:]], env=env, capture_output=True, text=True, timeout=240)
        assert done.returncode == 0, done.stderr[-2000:]
