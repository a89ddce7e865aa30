"""Repositories on disk, the command line and the stream of logs."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from strata import cli
from strata.errors import WrongParent, ArgError, EltNotFound, IdClash, MergeRequired, NoMatch, NotSolved, OtherError, PatchApply, ReadOnly
from strata.operators import merge
from strata.repository import Config, Repository
from strata.streaming import tail


class Clock:
    now = 946684800

    def __call__(self):
        self.now += 3600
        return self.now


def elts(spark, d):
    return spark.createDataFrame(list(d.items()), "elt_id bigint, elt string")


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "elt_id bigint")


def content(repo, state=None):
    return dict(rows(repo.state(state)))


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo") / "r")
    repo = Repository.create(spark, root, "sample", config=Config(clock=Clock()))
    s = [repo.tip_key()]
    s.append(repo.draft().insert(elts(spark, {1: "one", 2: "two", 3: None})).push())
    s.append(repo.draft().replace(elts(spark, {2: "TWO"})).remove(ids(spark, 3)).insert(elts(spark, {4: ""})).push())
    repo.write_fast()
    return root, s


def test_states_and_reads(spark, history):
    root, s = history
    repo = Repository.open(spark, root, name="sample")
    assert content(repo, s[0]) == {} and content(repo, s[1]) == {1: "one", 2: "two", 3: None} and content(repo) == {1: "one", 2: "TWO", 4: ""}
    assert repo.tip_key() == s[2] and repo.is_ready() and repo.is_loaded() and not repo.merge_required()
    assert all(repo.verify(x) for x in s)
    assert content(repo, s[1][:12].lower()) == content(repo, s[1])
    assert repo.get(2) == "TWO"
    with pytest.raises(EltNotFound):
        repo.get(3)
    with pytest.raises(NoMatch):
        repo.state_from_string("zz")
    assert [r["number"] for r in repo.commits().orderBy("number").collect()] == [0, 1, 2]
    assert {r["statesum"]: r["is_tip"] for r in repo.states().collect()} == {s[0]: False, s[1]: False, s[2]: True}
    with pytest.raises(OtherError):
        Repository.open(spark, root, name="another")
    with pytest.raises(OtherError):
        Repository.create(spark, root, "sample")
    with pytest.raises(ReadOnly):
        Repository.open(spark, root, config=Config(readonly=True)).draft().insert(elts(spark, {9: "x"})).push()


def test_drafts(spark, history):
    root, _ = history
    repo = Repository.open(spark, root)
    assert repo.draft().push() is None
    assert repo.draft().replace(elts(spark, {1: "one"})).push() is None
    assert repo.draft().insert(elts(spark, {8: "x"})).remove(ids(spark, 8)).push() is None
    for bad, error in ((repo.draft().insert(elts(spark, {1: "x"})), IdClash), (repo.draft().remove(ids(spark, 77)), EltNotFound), (repo.draft().insert(elts(spark, {8: "x"})).insert(elts(spark, {8: "y"})), IdClash)):
        with pytest.raises(error):
            bad.push()
    d = repo.draft()
    assert d.insert_new("new", near=1) == 3
    assert dict(rows(d.state()))[3] == "new"
    assert repo.unsaved_len == 0 and d.push() and repo.unsaved_len == 1
    assert not repo.unload() and repo.unload(force=True)


def test_branches_merge_and_snapshots(spark, tmp_path):
    root = str(tmp_path / "r")
    repo = Repository.create(spark, root, "m", config=Config(clock=Clock()))
    base = repo.draft().insert(elts(spark, {i: f"v{i}" for i in range(6)})).push()
    a = repo.draft(base).replace(elts(spark, {1: "a1"})).remove(ids(spark, 2)).insert(elts(spark, {10: "from a", 12: "a"})).push()
    b = repo.draft(base).replace(elts(spark, {3: "b3"})).insert(elts(spark, {11: "from b", 12: "b"})).push()
    assert repo.tips() == sorted([a, b]) and repo.merge_required()
    with pytest.raises(MergeRequired):
        repo.tip_key()
    assert repo.latest_common_ancestor(a, b) == base
    with pytest.raises(NotSolved):
        repo.merge(merge.ancestor)
    (made,) = repo.merge(merge.chain(merge.ancestor, merge.renaming))
    got = content(repo)
    kept = {got.pop(12), got.pop(13)}
    assert kept == {"a", "b"} and got == {0: "v0", 1: "a1", 3: "b3", 4: "v4", 5: "v5", 10: "from a", 11: "from b"}
    assert repo.verify(made)
    assert repo.write_fast() and not repo.write_fast()
    assert repo.write_snapshot() == 1
    again = Repository.open(spark, root)
    assert content(again) == content(repo) and again.verify()
    last = again.draft().remove(ids(spark, 0)).push()
    again.config.policy.force_snapshot()
    assert again.write_full() and rows(again.snapshot_index()) == sorted([(repo.commits().where("number = 0").first()["statesum"], 0), (made, 1), (last, 2)], key=str)
    again.load_latest()
    assert content(again) == content(Repository.open(spark, root)) and again.oldest_ss_loaded == 2
    again.load_range(1, 3)
    assert content(again) == content(Repository.open(spark, root))
    again.load_all()
    assert content(again, base)[0] == "v0"
    # a commit made elsewhere: known ones are ignored, wrong ones refused
    c = again.commits().where(F.col("statesum") == last).first()
    delta = again.changes().where(F.col("statesum") == last).select("elt_id", "op", "elt")
    assert not again.push_commit(last, list(c["parents"]), delta, number=c["number"], ts=c["ts"])
    with pytest.raises(PatchApply):
        again.push_commit("F" * 64, [last], elts(spark, {50: "x"}).select("elt_id", F.lit("INS").alias("op"), "elt"), number=9, ts=1)


def test_numbers_are_raised_until_the_sum_is_new(spark, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "r"), "n", config=Config(clock=lambda: 5))
    known = set()
    repo._commit, real = (lambda s: {"x": 1} if not known and not known.add(s) else None), repo._commit
    tip = real(repo.spark.read.parquet(f"{repo.root}/snapshot_index").first()["statesum"])
    row = repo._seal([tip], 0, "0" * 64, None, 1)
    assert row["number"] == tip["number"] + 2


def test_command_line(spark, tmp_path, monkeypatch):
    out, root = [], str(tmp_path / "a very long name of a folder")
    call = lambda *a: (out.clear(), cli.run(spark, list(a), out.append), list(out))[-1]
    call("new", root)
    assert Repository.open(spark, root).name == "a very long name"
    f = tmp_path / "v.txt"
    f.write_text("")
    first = call("set", root, "5", "--file", str(f))[0]
    f.write_text("full")
    call("set", root, "5", "--file", str(f))  # the empty element is there: it is replaced
    assert call("get", root, "5") == ["full"] and call("list", root) == ["5"]
    with pytest.raises(ArgError):
        call("rm", root, "5", "--commit", first[:10])
    call("rm", root, "5", "--commit", first[:10], "--force")
    assert len(call("heads", root)) == 2 and len(call("states", root)) == 4
    monkeypatch.setenv("EDITOR", "false")
    monkeypatch.delenv("VISUAL", raising=False)
    from strata.errors import CmdFailed

    with pytest.raises(CmdFailed):
        cli.edited("x")
    monkeypatch.setenv("EDITOR", "true")
    assert cli.edited("same") == "same"
    with pytest.raises(MergeRequired):
        call("snapshot", root)


def test_stream_of_changes(spark, tmp_path):
    data = [("s1", 1, "INS", "a"), ("s1", 1, "INS", "a"), ("s1", 2, "INS", "b"), ("s2", 1, "DEL", None)]
    df = spark.createDataFrame(data, "statesum string, elt_id bigint, op string, elt string").withColumn("received_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    df.write.parquet(str(tmp_path / "in"))
    stream = tail.known_once(tail.changes_stream(spark, str(tmp_path / "in")))
    seen = []
    q = tail.fold_into(stream, lambda batch, n: seen.extend(rows(batch, "statesum", "elt_id", "op")), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == [("s1", 1, "INS"), ("s1", 2, "INS"), ("s2", 1, "DEL")]
    q2 = tail.counts(tail.changes_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q2.awaitTermination(120)
    assert dict(rows(spark.table("counted"), "op", "n")) == {"INS": 3, "DEL": 1}


def test_binary_repositories(spark, tmp_path):
    """Created, edited, merged, written and opened again behind a store in memory and behind files."""
    from strata.operators import merge
    from strata.sources import codec, files
    from strata.sources.streams import MemoryStore
    from strata.storage import BinaryStorage

    (tmp_path / "bin").mkdir()
    elts = lambda *x: spark.createDataFrame(x, "elt_id bigint, elt string")
    for provider in (MemoryStore(), files.HadoopFiles(spark, f"file://{tmp_path}/bin", "book")):
        ticks = iter(range(10**6))
        config = lambda: Config(clock=lambda: next(ticks))
        storage = BinaryStorage(spark, provider, elt_type="string")
        repo = Repository.create(spark, storage, "book", user={"by": "me"}, config=config())
        first = repo.draft().insert(elts((1, "one"), (-2, "m\u00e4x"), (3, "three"))).push()
        assert repo.write_fast() and not repo.write_fast()
        again = Repository.open(spark, BinaryStorage(spark, provider, elt_type="string"), name="book", config=config())
        assert rows(again.state()) == sorted([(1, "one"), (-2, "m\u00e4x"), (3, "three")], key=str) and again.verify()
        if isinstance(provider, files.HadoopFiles):  # merged behind the other store
            assert again.write_snapshot() == 1 and files.HadoopFiles(spark, provider.folder).ss_len() == 2
            continue
        a = again.draft(first).replace(elts((1, "uno"))).insert(elts((9, "a"))).push()
        b = again.draft(first).remove(elts((3, ""))).insert(elts((9, "b"))).push()
        assert sorted((a, b)) == again.tips() and again.merge_required()
        again.merge(merge.chain(merge.ancestor, merge.renaming))
        assert again.is_ready()
        got = dict(rows(again.state()))
        assert got.pop(1) == "uno" and got.pop(-2) == "m\u00e4x" and sorted(got.values()) == ["a", "b"] and 3 not in got
        ss = again.write_snapshot()
        last = Repository.open(spark, BinaryStorage(spark, provider, elt_type="string"), config=config())
        last.load_latest()
        assert last.range == (ss, ss + 1) and last.verify() and dict(rows(last.state())).items() >= got.items()
        head, snap = codec.read_snapshot_file(provider.read_snapshot(ss))
        assert head.name == "book" and head.user == (codec.Field("text", "by=me"),) and len(snap.elements) == 4 and len(snap.parents) == 2
        # a writer that did not see the last number takes the next
        late = Repository.open(spark, BinaryStorage(spark, provider, elt_type="string"), config=config())
        tip = late.tip_key()
        late.draft(tip).insert(elts((77, "late"))).push()
        assert provider.new_log(ss, 1, codec.write_log([], codec.Header("log", "book")))
        assert late.write_fast() and (ss, 2) in provider.logs and dict(rows(late.state()))[77] == "late"


def test_numbers_taken_by_another_writer_and_gaps(spark, tmp_path):
    elts = lambda *x: spark.createDataFrame(x, "elt_id bigint, elt string")
    repo = Repository.create(spark, str(tmp_path / "r"), "r")
    for i in range(3):
        repo.draft().insert(elts((i, "x"))).push()
        assert repo.write_snapshot() == i + 1
    repo.draft().insert(elts((7, "y"))).push()
    assert repo.storage._claim("ss3-cl1") and repo.storage._claim("ss4")  # another writer has these
    assert repo.write_fast() and rows(repo.storage.log_numbers().where("ss = 3")) == [(3, 2)]
    assert repo.write_snapshot() == 5
    one = Repository.open(spark, str(tmp_path / "r"))
    one.load_range(4, 99)
    assert one.range == (3, 6) and len(rows(one.state())) == 4  # 4 is missing: back to 3
    one.load_range(1, 2)
    assert one.range == (1, 6) and one.oldest_ss_loaded == 1  # what lies between is loaded too
    with pytest.raises(WrongParent):
        one.push_commit("A" * 64, [one.tip_key()], elts(), number=9, ts=1, onto="B" * 64)
    new = one.draft().insert_all_new(spark.createDataFrame([("p",), ("p",), ("q",)], "elt string"))
    assert sorted(r["elt_id"] for r in new.collect()) == [8, 9, 10]
