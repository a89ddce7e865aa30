"""Files of the binary format pass through the driver, and through a task, in pieces."""

import pytest

from strata.errors import ArgError, IdClash
from strata.plans import store
from strata.sources import codec, files
from strata.sources.streams import MemoryStore


@pytest.fixture
def orders(spark, tmp_path):
    """A folder with 4000 orders, of ids of either sign."""
    spark.range(-1000, 3000).selectExpr("id AS o_orderkey", "id * 1.25D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_export_in_pieces(spark, orders, monkeypatch):
    passed = []
    for name in ("new_snapshot", "new_log"):
        plain = getattr(files.HadoopFiles, name)

        def noted(self, *args, plain=plain):
            assert not isinstance(args[-1], bytes | bytearray), "the driver holds a whole file"
            passed.append(parts := list(args[-1]))
            return plain(self, *args[:-1], parts)

        monkeypatch.setattr(files.HadoopFiles, name, noted)
    monkeypatch.setattr(files, "PASSED", 20_000)
    most, by_range = [], files._ranges

    def measured(*args):
        df = by_range(*args)
        most.append(max(df.rdd.glom().map(len).collect()) * 96)  # bytes of the largest partition, once encoded
        return df

    monkeypatch.setattr(files, "_ranges", measured)
    store._exported(spark, orders)
    # what one partition holds is what the driver holds at once: no more than some times PASSED, whatever the file's size
    assert len(passed) == len(most) == 3 and all(sum(map(len, x)) > 50_000 for x in passed) and max(most) < 50_000
    assert all(len(x) > 1 for x in passed[:2])


def test_export_log_is_the_plain_log(spark, monkeypatch):
    monkeypatch.setattr(files, "PASSED", 500)
    monkeypatch.setattr(files, "ROWS", 7)
    header, rows = codec.Header("log", "n"), [(seq, i, op, None if op == "DEL" else b"x" * (i % 40)) for seq in (0, 2) for i, op in zip(range(-20, 20), ["INS", "DEL", "REPL"] * 20)]
    commits = [codec.Commit(bytes([k]) * 32, (b"\7" * 32,) * (k + 1), codec.Meta(k, k)) for k in range(4)]
    want = codec.write_log([codec.Commit(c.statesum, c.parents, c.meta, tuple(r[1:] for r in rows if r[0] == k)) for k, c in enumerate(commits)], header)
    changes = spark.createDataFrame(rows, "seq bigint, elt_id bigint, op string, data binary").repartition(3)
    kept = MemoryStore()
    kept.new_snapshot(0, b"")
    assert files.export_log(changes, commits, kept, 0, 1, header) and not files.export_log(changes, commits, kept, 0, 1, header)
    assert kept.read_log(0, 1) == want
    assert files.export_log(changes.limit(0), commits[:1], kept, 0, 2, header) and kept.read_log(0, 2) == codec.write_log(commits[:1], header)
    with pytest.raises(ArgError):
        files.export_log(changes, commits[:2], kept, 0, 3, header)


def _log(n):
    header = codec.Header("log", "n")
    rows = tuple((3 * i, ("INS", "DEL", "REPL")[i % 3], None if i % 3 == 1 else b"%d" % i) for i in range(n))
    commits = [codec.Commit(bytes([k]) * 32, (b"\7" * 32,), codec.Meta(k, k), rows[k * n // 8 : (k + 1) * n // 8]) for k in range(8)]
    return codec.write_log(commits, header), [(k, r[0], r[1], r[2]) for k, c in enumerate(commits) for r in c.changes]


def _peak(work):
    """MB of Python's memory that ``work`` takes at most."""
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_log_through_a_window(tmp_path, monkeypatch):
    monkeypatch.setattr(codec.FileInput, "WINDOW", 50)
    raw, want = _log(100)
    (tmp_path / "f").write_bytes(raw)

    def read(data):
        (tmp_path / "f").write_bytes(data)
        with (tmp_path / "f").open("rb") as f:
            return list(files.decoded("changes", "", 0, 1, codec.FileInput(f))), list(files.decoded("commits", "", 0, 1, codec.Input(data)))

    got, commits = read(raw)
    assert [(x[3], *x[5:]) for x in got] == want and [c[-1] for c in commits] == [12, 13, 12, 13, 12, 13, 12, 13]
    for at in range(80, len(raw), 37):  # every kind of damage is found, at the byte where it is found in memory
        for bad in (raw[:at], raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]):
            said = []
            for src in (codec.Input(bad), "file"):
                (tmp_path / "f").write_bytes(bad)
                with (tmp_path / "f").open("rb") as f:
                    try:
                        said.append((list(files.decoded("changes", "", 0, 1, codec.FileInput(f) if src == "file" else src)), None))
                    except Exception as e:
                        said.append((str(e), type(e)))
            assert said[0] == said[1]
    twice = codec.Commit(bytes(32), (bytes(32),), codec.Meta(1, 1), ((5, "DEL", None), (1, "DEL", None), (5, "INS", b"x")))
    for c in (twice, codec.Commit(bytes(32), (bytes(32),), codec.Meta(1, 1), twice.changes[1:])):
        parts = [codec.change_bytes(*x) for x in c.changes]  # not in order
        data = codec.write_log([], codec.Header("log", "n")) + b"".join(codec.commit_stream(parts, len(parts), c))
        if c is twice:
            with pytest.raises(IdClash):
                read(data)
        else:
            assert [x[5] for x in read(data)[0]] == [1, 5]


def test_log_is_not_held(tmp_path):
    one = codec.Commit(bytes(32), (bytes(32),), codec.Meta(1, 1), tuple((i, "INS", b"0123456789") for i in range(200_000)))
    path = tmp_path / "n-ss0-cl1.piplog"
    path.write_bytes(codec.write_log([one], codec.Header("log", "n")))

    def read():
        reader = files._Reader({"path": str(tmp_path), "what": "changes"})
        assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 200_000

    assert path.stat().st_size > 15e6 and _peak(read) < 15  # held as a whole it took 79 MB


def test_snapshot_through_a_window(tmp_path, monkeypatch):
    monkeypatch.setattr(codec.FileInput, "WINDOW", 50)
    header, meta, parents = codec.Header("snapshot", "n"), codec.Meta(3, 4, 0, "x"), [b"\7" * 32]
    rows = [(3 * i, b"%d" % i * (i % 20)) for i in range(40)] + [(-1, b"")]
    raw = codec.write_snapshot_file(rows, parents, meta, header)

    def read(what, data, opened):
        (tmp_path / "f").write_bytes(data)
        with (tmp_path / "f").open("rb") as f:
            try:
                return list(files.decoded(what, "", 0, None, codec.FileInput(f) if opened else data))
            except Exception as e:
                return type(e), str(e)

    assert [x[3:] for x in read("elements", raw, True)] == rows
    assert read("states", raw, True) == read("states", raw, False) and read("states", raw, True)[0][3:] == (["07" * 32], 3, 4, 0, "x", 41)
    for at in range(80, len(raw), 29):  # every kind of damage is found, at the byte where it is found in memory
        for bad in (raw[:at], raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]):
            for what in ("elements", "states"):
                assert isinstance(read(what, bad, True), tuple) and read(what, bad, True) == read(what, bad, False)
    for ids in ((5, 1, 5), (5, 1, 4), (5, 5)):  # not in order
        parts = [codec.element_bytes(i, b"x") for i in ids]
        data = codec.write_header(header) + b"".join(codec.snapshot_stream(parts, len(ids), parents, meta))
        got = read("states", data, True)
        assert got == (IdClash, "element 5 comes twice") if len(set(ids)) < len(ids) else got[0][-1] == 3


@pytest.mark.parametrize("what", ["states", "elements"])
def test_snapshot_is_not_held(tmp_path, what):
    path = tmp_path / "n-ss0.pip"
    path.write_bytes(codec.write_snapshot_file([(i, b"0123456789") for i in range(200_000)], [], codec.Meta(1, 1), codec.Header("snapshot", "n")))

    def read():
        reader = files._Reader({"path": str(tmp_path), "what": what})
        assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == (1 if what == "states" else 200_000)

    assert path.stat().st_size > 15e6 and _peak(read) < 15  # held as a whole it took 57 MB
