"""History of changing entities: every version with the stretch in which it was valid.

Rows are co-partitioned by entity and sorted by entity and time; each task walks its sorted runs as
an iterator over Arrow batches, and emits a version as soon as a change of payload, a deletion or
the next entity closes it. Only the last row and the open version are held, never a history.

A long history is cut into blocks of ``block`` positions, so that one entity with very many changes
spreads over many tasks. A task that begins inside such a history can't know the state it meets; it
emits a summary of the block, and the summaries, one row per block, are stitched afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.scratch import Scratch

BLOCK = 4096
OUT = (
    "repo_id long, elt_id long, block long, from_number long, to_number long, "
    "head_number long, head_alive boolean, head_elt string, event_number long, tail_alive boolean, tail_elt string, summary boolean"
)
OUT_FIELDS = [
    ("repo_id", pa.int64()), ("elt_id", pa.int64()), ("block", pa.int64()), ("from_number", pa.int64()), ("to_number", pa.int64()),
    ("head_number", pa.int64()), ("head_alive", pa.bool_()), ("head_elt", pa.string()), ("event_number", pa.int64()),
    ("tail_alive", pa.bool_()), ("tail_elt", pa.string()), ("summary", pa.bool_()),
]


def history(rows: DataFrame, scratch: Scratch, *, block: int = BLOCK) -> DataFrame:
    """(repo_id, elt_id, from_number, to_number); to_number is -1 while still valid.

    ``rows``: repo_id, elt_id, pos (BIGINT from 0, the order), number, op, elt, received_at, and
    last_pos, the largest pos that the repository may have. Repeated rows of one entity and pos
    count once, the row received last. The same payload again begins no version; NULL is a payload
    and equals only NULL. An insertion after a deletion always begins one. A NULL number comes out
    as -2. An empty table has no versions.
    """
    keyed = rows.select(
        "repo_id", "elt_id", F.expr(f"pos div {int(block)}").alias("block"), "pos", "number", (F.col("op") != "DEL").alias("alive"), "elt",
        F.col("received_at").alias("at"), (F.col("last_pos") >= block).alias("long"),
    )
    parts = keyed.repartition("repo_id", "elt_id", "block").sortWithinPartitions("repo_id", "elt_id", "block", "pos", F.col("at").desc_nulls_last())
    out = scratch.cut(parts.drop("at").mapInArrow(_walk, OUT))
    closed = out.where("NOT summary").select("repo_id", "elt_id", "from_number", "to_number")
    return closed.unionByName(_stitched(out.where("summary")))


def _stitched(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy("repo_id", "elt_id").orderBy("block")
    before_alive, before_elt = F.coalesce(F.lag("tail_alive").over(w), F.lit(False)), F.lag("tail_elt").over(w)
    b = blocks.withColumn("was", before_alive).withColumn("was_elt", before_elt)
    begins = F.col("head_alive") & ~(F.col("was") & F.col("was_elt").eqNullSafe(F.col("head_elt")))
    b = b.withColumn("begins", begins).withColumn("changes", begins | (~F.col("head_alive") & F.col("was")))
    b = b.withColumn("first", F.when(F.col("changes"), F.col("head_number")).otherwise(F.col("event_number")))
    later = F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    b = b.withColumn("later", F.coalesce(later, F.lit(-1)))
    at_head = F.when(F.col("begins"), F.struct(F.col("head_number").alias("f"), F.coalesce("event_number", "later").alias("t")))
    at_tail = F.when(F.col("from_number").isNotNull(), F.struct(F.col("from_number").alias("f"), F.col("later").alias("t")))
    return b.select("repo_id", "elt_id", F.explode(F.array_compact(F.array(at_head, at_tail))).alias("x")).select(
        "repo_id", "elt_id", F.col("x.f").alias("from_number"), F.col("x.t").alias("to_number")
    )


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Null-safe equality."""
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


class _Open:
    """What the walk holds between rows: the last row, the open version, the block's first row and event."""

    key = pos = elt = start = head = event = None
    alive = long = False


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Open()
    for batch in batches:
        if batch.num_rows:
            out, held = _step(batch, held)
            yield _emit(*out)
    rows: list[tuple] = []
    _close(held, rows)
    yield _emit([], [], [], [], [], rows)


def _step(batch: pa.RecordBatch, held: _Open) -> tuple[tuple, _Open]:
    """The versions that one batch closes, as columns and as single rows, and what stays open."""
    col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    repo, elt_id, block, pos = (col[x].to_numpy(zero_copy_only=False) for x in ("repo_id", "elt_id", "block", "pos"))
    number = pc.fill_null(col["number"], -2).to_numpy(zero_copy_only=False)
    alive, long = (col[x].to_numpy(zero_copy_only=False).astype(bool) for x in ("alive", "long"))
    elt = col["elt"]
    n = batch.num_rows
    new_key, again = np.ones(n, bool), np.zeros(n, bool)
    new_key[1:] = (repo[1:] != repo[:-1]) | (elt_id[1:] != elt_id[:-1]) | (block[1:] != block[:-1])
    again[1:] = ~new_key[1:] & (pos[1:] == pos[:-1])
    if held.key == (int(repo[0]), int(elt_id[0]), int(block[0])):
        new_key[0] = False
        again[0] = int(pos[0]) == held.pos
    last_pos = int(pos[-1])
    if again.any():
        keep = np.flatnonzero(~again)
        repo, elt_id, block, number, alive, long, new_key = (x[keep] for x in (repo, elt_id, block, number, alive, long, new_key))
        elt = elt.take(pa.array(keep))
        n = len(keep)
        if not n:
            return ([], [], [], [], [], []), held
    was_alive, same = np.zeros(n, bool), np.zeros(n, bool)
    was_alive[1:] = alive[:-1]
    same[1:] = _same(elt.slice(1), elt.slice(0, n - 1))
    if not new_key[0]:
        was_alive[0], same[0] = held.alive, held.elt == elt[0].as_py()
    was_alive &= ~new_key
    begins = alive & ~(was_alive & same)
    # the state before the head of a block of a long history is unknown here
    event = (begins | (~alive & was_alive)) & ~(new_key & long)
    marks = np.flatnonzero(event | new_key)
    at, follows = marks[:-1], marks[1:]
    closes = event[at] & begins[at] & ~(long[at] & new_key[follows])
    done, to = at[closes], np.where(new_key[follows], -1, number[follows])[closes]

    rows: list[tuple] = []
    edges = np.flatnonzero(new_key)
    stop = int(edges[0]) if len(edges) else n
    if stop:  # the held entity goes on
        own = marks[: np.searchsorted(marks, stop)]
        if len(own):
            if held.start is not None:
                rows.append((*held.key, held.start, int(number[own[0]]), *[None] * 6, False))
            if held.event is None:
                held.event = int(number[own[0]])
            held.start = int(number[own[-1]]) if begins[own[-1]] else None
        held.alive, held.elt = bool(alive[stop - 1]), elt[stop - 1].as_py()
        if stop < n and (held.long or not len(own)):
            _close(held, rows)
    else:
        _close(held, rows)

    def block_of(start: int, stop: int) -> _Open:
        own = marks[np.searchsorted(marks, start) : np.searchsorted(marks, stop)]  # the head and the events after it
        x = _Open()
        x.key, x.long = (int(repo[start]), int(elt_id[start]), int(block[start])), bool(long[start])
        x.alive, x.elt = bool(alive[stop - 1]), elt[stop - 1].as_py()
        x.start = int(number[own[-1]]) if event[own[-1]] and begins[own[-1]] else None
        if x.long:
            x.head = (int(number[start]), bool(alive[start]), elt[start].as_py())
            x.event = int(number[own[1]]) if len(own) > 1 else None
        return x

    for i in np.flatnonzero(long[edges[:-1]]) if len(edges) else ():
        _close(block_of(int(edges[i]), int(edges[i + 1])), rows)
    if len(edges):
        held = block_of(int(edges[-1]), n)
    held.pos = last_pos
    return (repo[done], elt_id[done], block[done], number[done], to, rows), held


def _close(held: _Open, rows: list[tuple]) -> None:
    if held.long:
        rows.append((*held.key, held.start, None, *held.head, held.event, held.alive, held.elt, True))
    elif held.start is not None:
        rows.append((*held.key, held.start, -1, *[None] * 6, False))


def _emit(repo, elt_id, block, begin, end, rows) -> pa.RecordBatch:
    few = list(zip(*rows)) if rows else [()] * len(OUT_FIELDS)
    n = len(repo)
    cols = []
    for i, (_, kind) in enumerate(OUT_FIELDS):
        first = (repo, elt_id, block, begin, end)[i] if i < 5 else [None] * n if i < 11 else [False] * n
        cols.append(pa.concat_arrays([pa.array(first, kind), pa.array(few[i], kind)]))
    return pa.RecordBatch.from_arrays(cols, [name for name, _ in OUT_FIELDS])
