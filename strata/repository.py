"""A repository: states with their history, stored as Parquet or as files of the binary format.

As Parquet:

    meta/                    one row: name, type of elements, digest, user fields
    commits/ss=N/cl=M/       one row per commit
    changes/ss=N/cl=M/       their changes
    snapshots/ss=N/          full states; snapshot_index/ss=N/ names the state of each

Logs M of snapshot N hold the commits made after it was written. Nothing is ever rewritten: changes
are written before their commits and snapshots before their index, so that a reader who starts from
commits and index sees whole ones only, and two writers at most make two tips.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import (
    ArgError, EltNotFound, IdClash, MergeRequired, NoCommonAncestor, NoParent, NoState, NotReady, OtherError, PatchApply, ReadOnly, WrongParent,
)
from strata.functions import sums
from strata.operators import changes as ch
from strata.operators import dag, merge, replay
from strata.operators.hierarchy import way_from
from strata.policy import SnapshotPolicy
from strata.scratch import Scratch
from strata.sources.codec import valid_name
from strata.storage import COMMITS, BinaryStorage, ParquetStorage, element_codec

PROBES = 1_000_000


@dataclass
class Config:
    """Callbacks and limits; the clock and the texts of commits may be replaced, as tests do."""

    readonly: bool = False
    policy: SnapshotPolicy = field(default_factory=SnapshotPolicy)
    clock: Callable[[], int] = lambda: int(time.time())
    extra: Callable[[int, list[str]], str | None] = lambda number, parents: None
    #: Further user fields of the header, by kind of file and name.
    header: Callable[[str, str], dict] = lambda kind, name: {}


def _zero() -> str:
    return "0" * 64


def _xor(a: str, b: str) -> str:
    return sums.xor_bytes(bytes.fromhex(a), bytes.fromhex(b)).hex().upper()


def _meta_sum(number: int, ts: int, parents: list[str], extra: str | None) -> str:
    return sums.meta_digest(number, ts, [bytes.fromhex(p) for p in parents], extra).hex().upper()


class Repository:
    def __init__(self, spark: SparkSession, storage, meta: dict, config: Config):
        self.spark, self.storage, self.meta, self.config = spark, storage, meta, config
        self.scratch = Scratch(spark)
        self.range: tuple[int, int] | None = None
        self._queue: list[tuple[dict, DataFrame]] = []
        self._ways: dict[tuple, DataFrame] = {}

    # ---- opening ----

    @classmethod
    def create(
        cls, spark, where, name: str, elt_type: str = "string", *, digest: str = "sha2", user: dict | None = None, config: Config | None = None
    ) -> Repository:
        """A new repository with the blank state, number 0, as snapshot 0; ``where`` is a folder for Parquet, or a storage."""
        valid_name(name)
        config = config or Config()
        if config.readonly:
            raise ReadOnly("the repository is read-only")
        storage = ParquetStorage(spark, where) if isinstance(where, str) else where
        if storage.exists():
            raise OtherError(f"there is a repository already: {where}")
        user = {**(user or {}), **config.header("snapshot", name)}
        if isinstance(storage, BinaryStorage):
            storage.use(name, user)
            elt_type, digest = storage.elt_type, "blake2"
        repo = cls(spark, storage, {"name": name, "elt_type": elt_type, "digest": digest, "user": user}, config)
        ts = config.clock()
        blank = {"statesum": _meta_sum(0, ts, [], None), "parents": [], "number": 0, "ts": ts, "ext_flags": 0, "extra": None, "n_changes": 0, "seq": 0}
        storage.new_log(0, 0, [blank], None)
        if not storage.new_snapshot(0, blank, spark.createDataFrame([], f"elt_id bigint, elt {elt_type}")):
            raise OtherError(f"another writer was first: {where}")
        storage.write_meta(repo.meta)
        return repo

    @classmethod
    def open(cls, spark, where, *, name: str | None = None, config: Config | None = None) -> Repository:
        """Reads the header only; states stay lazy until they are used."""
        storage = ParquetStorage(spark, where) if isinstance(where, str) else where
        if not storage.exists():
            raise OtherError(f"no repository: {where}")
        meta = storage.read_meta()
        if name is not None and name != meta["name"]:
            raise OtherError(f"the repository is named {meta['name']!r}, not {name!r}")
        return cls(spark, storage, meta, config or Config())

    @property
    def root(self) -> str | None:
        return getattr(self.storage, "root", None)

    @property
    def name(self) -> str:
        return self.meta["name"]

    @property
    def unsaved_len(self) -> int:
        return len(self._queue)

    def load_range(self, ss0: int, ss1: int) -> None:
        """Only the history of snapshots ss0 to ss1 - 1: directories outside are not read.

        The range ends with the newest snapshot and begins with one that is there: missing ones are
        walked back over. What is loaded already stays, and so does all between it and the range.
        """
        if ss0 > ss1:
            raise ArgError("an empty range")
        have = sorted(r[0] for r in self.storage.index().select("ss").distinct().collect())
        lo = max((s for s in have if s <= ss0), default=0)
        hi = max(min(ss1, (have[-1] if have else 0) + 1), lo + 1)
        if self.range:
            lo, hi = min(lo, self.range[0]), max(hi, self.range[1])
        self.range = (lo, hi)
        logs = self.storage.log_numbers().agg(F.max("ss")).first()[0]
        if logs is not None and logs > (have[-1] if have else -1):
            self.config.policy.force_snapshot()  # the head's snapshot is missing

    def load_latest(self) -> None:
        last = self.storage.index().agg(F.max("ss")).first()[0] or 0
        self.range = None
        self.load_range(last, last + PROBES)

    def load_all(self) -> None:
        self.range = None

    @property
    def oldest_ss_loaded(self) -> int:
        return self.range[0] if self.range else 0

    def unload(self, force: bool = False) -> bool:
        """Forgets unsaved commits only if forced; False if there are some."""
        if self._queue and not force:
            return False
        self._queue.clear()
        return True

    def _ranged(self, df: DataFrame) -> DataFrame:
        return df if not self.range else df.where(F.col("ss").between(self.range[0], self.range[1] - 1))

    # ---- frames ----

    def commits(self) -> DataFrame:
        every = self.storage.commits()
        saved = self._ranged(every)
        if self.range:  # a snapshot brings the commit of its own state along
            saved = saved.unionByName(every.join(self.snapshot_index().select("statesum"), "statesum", "left_semi").select(*saved.columns))
        if self._queue:
            saved = saved.unionByName(self.spark.createDataFrame([{**c, "ss": -1, "cl": -1} for c, _ in self._queue], COMMITS))
        return dag.known_once(saved)

    def changes(self) -> DataFrame:
        out = self._ranged(self.storage.changes(self.meta["elt_type"]))
        for c, rows in self._queue:
            out = out.unionByName(rows.select(F.lit(c["statesum"]).alias("statesum"), "elt_id", "op", "elt", F.lit(-1).cast("bigint").alias("ss"), F.lit(-1).cast("bigint").alias("cl")))
        return out

    def snapshot_index(self) -> DataFrame:
        return self._ranged(self.storage.index())

    def _commit(self, statesum: str) -> dict | None:
        got = self.commits().where(F.col("statesum") == statesum).limit(1).collect()
        return got[0].asDict() if got else None

    # ---- tips and states ----

    def tips(self) -> list[str]:
        return [r[0] for r in dag.tips(self.commits()).select("statesum").orderBy("statesum").collect()]

    def _up_to_two_tips(self) -> int:
        return dag.tips(self.commits()).limit(2).count()

    def is_loaded(self) -> bool:
        return self._up_to_two_tips() > 0

    def is_ready(self) -> bool:
        return self._up_to_two_tips() == 1

    def merge_required(self) -> bool:
        return self._up_to_two_tips() > 1

    def tip_key(self) -> str:
        found = self.tips()
        if not found:
            raise NotReady("no state is loaded")
        if len(found) > 1:
            raise MergeRequired(f"{len(found)} tips")
        return found[0]

    def states(self) -> DataFrame:
        return dag.with_tip_flag(self.commits())

    def state_from_string(self, text: str) -> str:
        return dag.named_state(self.commits(), text)

    def state(self, statesum: str | None = None) -> DataFrame:
        """(elt_id, elt) of a state, the tip if none is named: the nearest snapshot on its first-parent
        way and the changes since. A full sum is looked up, a shorter text is taken as a prefix."""
        key = statesum or self.tip_key()
        commits = self.commits()
        if len(key) < 64 or self._commit(key) is None:
            key = dag.named_state(commits, key)
        way = self._way(key, commits)
        at = way.join(self.snapshot_index(), F.col("id") == F.col("statesum")).orderBy("dist", "ss").select("ss", "dist").limit(1).collect()
        if at:
            ss, dist = at[0]
            base = self.storage.snapshot(ss, self.meta["elt_type"])
        else:
            first = way.orderBy(F.col("dist").desc()).join(commits.where("number = 0").select(F.col("statesum").alias("id")), "id", "left_semi")
            unknown = way.join(commits.select(F.col("statesum").alias("id"), "number"), "id", "left").where("number IS NULL").count()
            if self.range and self.range[0] > 0 or not (unknown or first.count()):
                raise NoParent("no snapshot below this state is loaded")
            # the first snapshot is missing: history begins with the blank state
            dist, base = 2**62, self.spark.createDataFrame([], f"elt_id bigint, elt {self.meta['elt_type']}")
        since = way.where(F.col("dist") < dist).select(F.col("id").alias("statesum"), (-F.col("dist")).alias("pos"))
        rows = self.changes().join(since, "statesum").select("elt_id", "op", "elt", "pos")
        return replay.replay(rows, ["pos"], base)

    def _way(self, key: str, commits: DataFrame) -> DataFrame:
        """The first-parent way of a state. It never changes, so it is followed once for each range that is loaded."""
        if (key, self.range) not in self._ways:
            links = commits.where(F.size("parents") > 0).select(F.col("statesum").alias("id"), F.col("parents")[0].alias("parent"))
            head = self.spark.createDataFrame([(0, key)], "key bigint, id string")
            self._ways[key, self.range] = self.scratch.cut(way_from(head, links, scratch=self.scratch))
        return self._ways[key, self.range]

    def get(self, elt_id: int, statesum: str | None = None):
        got = self.state(statesum).where(F.col("elt_id") == elt_id).limit(1).collect()
        if not got:
            raise EltNotFound(f"no element {elt_id}")
        return got[0]["elt"]

    # ---- sums ----

    def _digest(self) -> F.Column:
        if self.meta["digest"] == "blake2":
            return F.hex(sums.element_blake2("elt_id", element_codec(self.meta["elt_type"], getattr(self.storage, "codecs", None))[0](F.col("elt"))))
        return sums.element_digest("elt_id", "elt")

    def _elements_sum(self, rows: DataFrame) -> str:
        return sums.state_sum(rows, self._digest()).first()["elt_sum"]

    def verify(self, statesum: str | None = None) -> bool:
        """Does the state's content give its sum?"""
        c = self._commit(statesum or self.tip_key())
        return _xor(self._elements_sum(self.state(c["statesum"])), _meta_sum(c["number"], c["ts"], c["parents"], c["extra"])) == c["statesum"]

    def _sum_after(self, parent: dict, base: DataFrame, delta: DataFrame) -> str:
        """The element sum of the patched base, from that of the base and the touched elements only."""
        before = _xor(parent["statesum"], _meta_sum(parent["number"], parent["ts"], parent["parents"], parent["extra"]))
        gone = base.join(delta.where("op <> 'INS'").select("elt_id"), "elt_id", "left_semi").select("elt_id", "elt")
        return _xor(before, self._elements_sum(gone.unionByName(delta.where("op <> 'DEL'").select("elt_id", "elt"))))

    # ---- writing ----

    def _writable(self) -> None:
        if self.config.readonly:
            raise ReadOnly("the repository is read-only")

    def draft(self, statesum: str | None = None) -> Draft:
        return Draft(self, statesum or self.tip_key())

    def _seal(self, parents: list[dict], flags: int, elements_sum: str, extra: str | None, n_changes: int) -> dict:
        """A commit's row; the number is raised until the sum is new."""
        number = min(max(p["number"] for p in parents) + 1, dag.MAX_NUMBER)
        names, ts = [p["statesum"] for p in parents], self.config.clock()
        for _ in range(PROBES):
            text = extra if extra is not None else self.config.extra(number, names)
            statesum = _xor(elements_sum, _meta_sum(number, ts, names, text))
            if self._commit(statesum) is None:
                return {"statesum": statesum, "parents": names, "number": number, "ts": ts, "ext_flags": flags, "extra": text, "n_changes": n_changes, "seq": 0}
            number += 1
        raise OtherError("no free number for the commit")

    def _enqueue(self, row: dict, delta: DataFrame) -> str:
        self._queue.append((row, delta))
        self.config.policy.count(1, row["n_changes"])
        return row["statesum"]

    def push_commit(
        self, statesum: str, parents: list[str], delta: DataFrame, *, number: int, ts: int, ext_flags: int = 0, extra: str | None = None, onto: str | None = None
    ) -> bool:
        """Adds a commit made elsewhere; False if it is known. It must apply to its first parent and give its sum.

        ``onto`` names the state that it is meant for; WrongParent if that is not its first parent.
        """
        self._writable()
        if onto is not None and parents[:1] != [onto]:
            raise WrongParent(f"the commit is not relative to {onto}")
        if self._commit(statesum) is not None:
            return False
        first = self._commit(parents[0]) if parents else None
        if first is None:
            raise NoParent("the first parent is not known")
        if ext_flags & dag.UNKNOWN_ESSENTIAL:
            raise ArgError("unknown essential flags")
        base, delta = self.state(parents[0]), self.scratch.cut(delta.select("elt_id", "op", "elt"))
        if bad := ch.violations(base, delta).limit(1).collect():
            raise PatchApply(bad[0]["problem"])
        if _xor(self._sum_after(first, base, delta), _meta_sum(number, ts, parents, extra)) != statesum:
            raise PatchApply("the commit does not give its sum")
        n = delta.count()
        self._enqueue({"statesum": statesum, "parents": parents, "number": number, "ts": ts, "ext_flags": ext_flags, "extra": extra, "n_changes": n, "seq": 0}, delta)
        return True

    def write_fast(self) -> bool:
        """Writes the unsaved commits as one new log; False if there are none."""
        self._writable()
        if not self._queue:
            return False
        # numbers as written, whatever range is loaded; should another writer take one, the next is tried
        ss = self.storage.index().agg(F.max("ss")).first()[0] or 0
        cl = 1 + (self.storage.log_numbers().where(F.col("ss") == ss).agg(F.max("cl")).first()[0] or 0)
        rows = [{**c, "seq": i} for i, (c, _) in enumerate(self._queue)]
        named = [delta.select(F.lit(c["statesum"]).alias("statesum"), "elt_id", "op", "elt") for c, delta in self._queue]
        out = reduce(DataFrame.unionByName, named)
        for cl in range(cl, cl + PROBES):
            if self.storage.new_log(ss, cl, rows, out):
                self._queue.clear()
                return True
        raise OtherError("no free number for the log")

    def write_snapshot(self) -> int:
        """The single tip under the next free number; raises if there is none or more than one."""
        self._writable()
        self.write_fast()
        tip = self.tip_key()
        row, state = self._commit(tip), self.state(tip)
        ss = 1 + (self.storage.index().agg(F.max("ss")).first()[0] or 0)
        for ss in range(ss, ss + PROBES):
            if self.storage.new_snapshot(ss, row, state):
                self.config.policy.reset()
                return ss
        raise OtherError("no free number for the snapshot")

    def write_full(self) -> bool:
        """``write_fast``, then a snapshot if the policy wants one and there is one tip."""
        wrote = self.write_fast()
        if self.config.policy.want_snapshot() and self.is_ready():
            self.write_snapshot()
            wrote = True
        return wrote

    # ---- merging ----

    def latest_common_ancestor(self, one: str, two: str) -> str:
        known = self.commits()
        for s in (one, two):
            if self._commit(s) is None:
                raise NoState(s)
        found = dag.common_ancestors(known, one, two, scratch=self.scratch).limit(1).collect()
        if not found:
            raise NoCommonAncestor(f"{one} and {two}")
        return found[0]["statesum"]

    def conflicts(self, one: str, two: str, ids=None) -> DataFrame:
        c = self.latest_common_ancestor(one, two)
        return merge.conflicts(self.state(one), self.state(two), self.state(c), ids)

    def merge(self, solver: merge.Solver, auto_load: bool = True) -> list[str]:
        """Merges the two tips of least sum until one is left; the sums of the merge commits."""
        self._writable()
        made = []
        while len(pair := self.tips()[:2]) == 2:
            try:
                c = self.latest_common_ancestor(*pair)
                states = [self.state(x) for x in (*pair, c)]
            except (NoCommonAncestor, NoParent):
                if not auto_load or not self.range or self.range[0] == 0:
                    raise
                self.load_range(self.range[0] - 1, self.range[1])
                continue
            a, b = states[:2]
            got = merge.make_commit(merge.with_new_ids(merge.solve(merge.conflicts(*states), solver), states, scratch=self.scratch))
            order = pair if got.first_is_a else pair[::-1]
            parents = [self._commit(p) for p in order]
            delta = self.scratch.cut(got.changes)
            total = self._sum_after(parents[0], a if got.first_is_a else b, delta)
            flags = parents[0]["ext_flags"] | parents[1]["ext_flags"]
            made.append(self._enqueue(self._seal(parents, flags, total, None, got.n_changes), delta))
        return made


class Draft:
    """Pending changes on top of a state; nothing is copied until it is pushed."""

    def __init__(self, repo: Repository, parent: str):
        self.repo, self.parent = repo, repo._commit(parent)
        if self.parent is None:
            raise NoParent(parent)
        self.flags, self.extra = self.parent["ext_flags"], None
        self._steps: list[DataFrame] = []

    def _add(self, rows: DataFrame, op: str) -> Draft:
        kind = self.repo.meta["elt_type"]
        elt = F.col("elt").cast(kind) if op != "DEL" else F.lit(None).cast(kind)
        self._steps.append(rows.select(F.col("elt_id").cast("bigint").alias("elt_id"), F.lit(op).alias("op"), elt.alias("elt"), F.lit(len(self._steps)).alias("step")))
        return self

    def insert(self, rows: DataFrame) -> Draft:
        return self._add(rows, "INS")

    def replace(self, rows: DataFrame) -> Draft:
        return self._add(rows, "REPL")

    def remove(self, rows: DataFrame) -> Draft:
        return self._add(rows, "DEL")

    def base(self) -> DataFrame:
        return self.repo.state(self.parent["statesum"])

    def insert_new(self, elt, near: int | None = None) -> int:
        """Inserts one element under a free id."""
        import random

        start = random.getrandbits(63) if near is None else near
        i = ch.free_id_near([self.base(), *self._steps], start)
        self.insert(self.repo.spark.createDataFrame([(i, elt)], f"elt_id bigint, elt {self.repo.meta['elt_type']}"))
        return i

    def insert_all_new(self, rows: DataFrame) -> DataFrame:
        """Inserts every row's elt under an id of its own that is free in the state and the draft; the rows with their ids."""
        scratch = self.repo.scratch
        numbered = scratch.cut(rows.select("elt").withColumn("elt_id", F.monotonically_increasing_id()))
        ids = ch.ranked_new_ids(numbered, [self.base(), *self._steps], scratch=scratch)
        new = scratch.cut(numbered.join(ids, "elt_id").select(F.col("new_id").alias("elt_id"), "elt"))
        self.insert(new)
        return new

    def state(self) -> DataFrame:
        return ch.patch(self.base(), self._delta(self.base()))

    def _pending(self) -> DataFrame:
        out = self._steps[0]
        for x in self._steps[1:]:
            out = out.unionByName(x)
        return out

    def _delta(self, base: DataFrame) -> DataFrame:
        return ch.effective(base, ch.composed(self._pending(), "step"))

    def push(self) -> str | None:
        """The new state's sum; None if nothing changes. Raises IdClash or EltNotFound where a step can't apply."""
        self.repo._writable()
        if not self._steps:
            return None
        base = self.base()
        twice = self._pending().groupBy("elt_id", "step").count().where("count > 1").limit(1).collect()
        bad = replay.broken_preconditions(self._pending(), ["step"], base).limit(1).collect()
        if twice or bad and bad[0]["op"] == "INS":
            raise IdClash(str((twice or bad)[0]["elt_id"]))
        if bad:
            raise EltNotFound(str(bad[0]["elt_id"]))
        delta = self.repo.scratch.cut(self._delta(base))
        n = delta.count()
        if not n:
            return None
        total = self.repo._sum_after(self.parent, base, delta)
        return self.repo._enqueue(self.repo._seal([self.parent], self.flags, total, self.extra, n), delta)
