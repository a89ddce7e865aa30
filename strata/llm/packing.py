"""Filling containers of fixed capacity, by bin completion with branch and bound.

Items are spread over blocks by a hash of their id, each block holding about ``BLOCK_CONTAINERS``
containers' worth, and each block is solved by itself: no task ever holds more than its block. What
a block leaves not well filled is unpacked and goes to a further round over fewer blocks.

Within a block, best-fit decreasing gives the first incumbent. If it needs more containers than the
lower bound, completions are searched: around the largest item left, the undominated fillings are
tried, the fullest first; a branch is cut once its waste exceeds what an improvement could afford.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.scratch import Scratch

BLOCK_CONTAINERS = 256
#: So many of the least filled containers are searched first.
WORST = 8


@dataclass(frozen=True)
class Limits:
    """How far the search goes. None lifts a limit; :data:`EXACT` lifts all, so that a block comes out with the fewest containers."""

    #: Fillings tried per container.
    fillings: int | None = 16
    #: Containers completed per search before the incumbent stands.
    steps: int | None = 1024
    #: Items up to which the second lower bound, a pass per large item, is computed in full.
    bounded: int | None = 400
    #: A container filled less than this after a round is unpacked for the next one.
    well_filled: float = 0.98
    #: After this many rounds every container stands as it is.
    rounds: int = 3


EXACT = Limits(None, None, None)


def lower_bound(sizes: list[int], capacity: int, bounded: int | None = None) -> int:
    """The better of two bounds: total size, and items of over half a container with what fits beside none."""
    best = -(-sum(sizes) // capacity)
    order = sorted(sizes, reverse=True)
    for k in [0, *sorted({capacity - x for x in order if 2 * x > capacity})]:
        large = [x for x in order if x > capacity - k]
        middle = [x for x in order if capacity - k >= x > capacity / 2]
        small = sum(x for x in order if capacity / 2 >= x >= max(k, 1))
        room = len(middle) * capacity - sum(middle)
        best = max(best, len(large) + len(middle) + max(0, -(-(small - room) // capacity)))
        if bounded is not None and len(order) > bounded:
            break  # on many items the first bound is as good
    return best


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the indices of the items in each container."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - sizes[i], len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        if left > 0:
            insort(room, (left, b))
    return bins


def fillings(largest: int, have: Counter, distinct: list[int], capacity: int, most: int | None = None) -> list[tuple[int, ...]]:
    """Undominated fillings of a container that holds ``largest``, the fullest first.

    A filling is dominated if an item left out would fit in addition, or could take the place of a
    smaller item that is in: the other container that has it could then hold the smaller one.
    With ``most`` the fullest of those that a bounded search meets, at least one.
    """
    found: set[tuple[int, tuple[int, ...]]] = set()
    spare: list[tuple[int, ...]] = []
    budget = [math.inf if most is None else most * 20]
    negated = [-x for x in distinct]

    def extend(at: int, room: int, chosen: tuple[int, ...]) -> None:
        budget[0] -= 1
        if budget[0] < 0 or most is not None and len(found) >= most * 4:
            return
        grown = False
        for at in range(max(at, bisect_left(negated, -room)), len(distinct)):
            x = distinct[at]
            if chosen.count(x) < have[x]:
                grown = True
                extend(at, room - x, (*chosen, x))
                if room == x or budget[0] < 0:
                    return
        if not grown:
            if not spare:
                spare.append(chosen)
            if not (room and _dominated(chosen, room, have, distinct, negated)):
                found.add((room, chosen))

    extend(0, capacity - largest, ())
    return [c for _, c in sorted(found)][:most] or spare


def _dominated(chosen: tuple[int, ...], room: int, have: Counter, distinct: list[int], negated: list[int]) -> bool:
    """Could an item left out, larger by no more than the room, take the place of one that is in?"""
    for y in set(chosen):
        for x in distinct[bisect_left(negated, -(y + room)) : bisect_left(negated, -y)]:
            if chosen.count(x) < have[x]:
                return True
    return False


def complete(sizes: list[int], capacity: int, limits: Limits = Limits()) -> list[list[int]]:
    """Containers as lists of item indices; every size is between 1 and the capacity.

    Completion is tried on the items of the least filled containers first, where a container can be
    saved, then on more of them, and at last on all items. With :data:`EXACT` no solution has fewer.
    """
    best = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity, limits.bounded)
    open_ = WORST
    while len(best) > bound:
        best.sort(key=lambda b: sum(sizes[i] for i in b))
        part = best[:open_]
        items = [i for b in part for i in b]
        shorter = _searched([sizes[i] for i in items], capacity, len(part), limits)
        if shorter:
            best = [[items[j] for j in b] for b in shorter] + best[open_:]
        elif open_ >= len(best):
            break
        else:
            open_ *= 4
    return best


def _searched(sizes: list[int], capacity: int, known: int, limits: Limits) -> list[list[int]] | None:
    """A solution with fewer than ``known`` containers by branch and bound, None if none was met."""
    bound = lower_bound(sizes, capacity, limits.bounded)
    if known <= bound:
        return None
    total, steps, target, found = sum(sizes), math.inf if limits.steps is None else limits.steps, known, None
    # explicit stack: a block may have more containers than Python has frames
    stack = [(Counter(sizes), total, (), 0, None, 0)]
    while stack and steps > 0 and target > bound:
        have, left, done, waste, options, at = stack.pop()
        if not left:
            found, n = done, 0
            while done:
                done, n = done[0], n + 1
            target = n
            continue
        if waste > (target - 1) * capacity - total:
            continue
        if options is None:
            largest = max(have)
            rest = have.copy()
            rest[largest] -= 1
            if not rest[largest]:
                del rest[largest]
            options = [(largest, *f) for f in fillings(largest, rest, sorted(rest, reverse=True), capacity, limits.fillings)]
        if at + 1 < len(options):
            stack.append((have, left, done, waste, options, at + 1))
        steps -= 1
        filling = options[at]
        after = have.copy()
        for x in filling:
            after[x] -= 1
            if not after[x]:
                del after[x]
        size = sum(filling)
        stack.append((after, left - size, (done, filling), waste + (capacity - size if left > size else 0), None, 0))
    if found is None:
        return None
    where: dict[int, list[int]] = {}
    for i, x in enumerate(sizes):
        where.setdefault(x, []).append(i)
    out = []
    while found:
        found, filling = found
        out.append([where[x].pop() for x in filling])
    return out


def _solve(items: pd.DataFrame, limits: Limits) -> pd.DataFrame:
    capacity = int(items["capacity"].iat[0])
    sizes = items["n_tokens"].astype(int).tolist()
    full = [i for i, x in enumerate(sizes) if x > 0]
    bins = [[full[j] for j in b] for b in complete([sizes[i] for i in full], capacity, limits)] if full else []
    none = [i for i, x in enumerate(sizes) if x <= 0]
    if none:  # texts without tokens take no room
        bins = bins or [[]]
        bins[0] = bins[0] + none
    number, filled = [0] * len(sizes), [0] * len(sizes)
    for b, members in enumerate(bins):
        used = sum(sizes[i] for i in members)
        for i in members:
            number[i], filled[i] = b, used
    return items.assign(number=number, filled=filled)


def pack(items: DataFrame, capacities: DataFrame, *, limits: Limits = Limits(), scratch: Scratch | None = None) -> DataFrame:
    """(pack_id, container, id, piece, start, n_tokens): where each item, or piece of one, lies.

    ``items``: id (BIGINT, unique), n_tokens; ``capacities``: pack_id, capacity, few rows. Only an
    item larger than the capacity is split: into full containers and one rest, which is packed like
    an item. An item without tokens takes no room and lies in a container of its block. NULL ids,
    NULL or non-positive capacities are ignored, a NULL size counts as 0. ``limits`` bounds the search
    within a block; whatever they are, every item is packed.
    """
    scratch = scratch or Scratch(items.sparkSession)
    out_schema = "pack_id int, capacity int, id bigint, piece int, start bigint, n_tokens bigint, block bigint, number int, filled bigint"
    sized = items.select(F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("size")).where("id IS NOT NULL")
    sized = scratch.cut(sized)
    caps = [(int(r[0]), int(r[1])) for r in capacities.select("pack_id", "capacity").where("pack_id IS NOT NULL AND capacity > 0").distinct().collect()]
    each = F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).alias("capacity")) for p, c in caps]) if caps else F.array().cast("array<struct<pack_id:int,capacity:int>>")
    per_pack = sized.select("id", "size", F.explode(each).alias("c")).select("id", "size", "c.pack_id", "c.capacity")
    whole = F.expr("size div capacity")
    cut_up = per_pack.withColumn("whole", whole)
    # full pieces fill a container each
    full = cut_up.where("whole > 0 AND size > capacity").select(
        "pack_id", "capacity", "id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece")
    )
    full = full.select(
        "pack_id", F.concat_ws("-", F.lit("d"), "id", "piece").alias("container"), "id", F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").cast("bigint").alias("n_tokens"),
    )
    rest = cut_up.select(
        "pack_id", "capacity", "id",
        F.when(F.col("size") > F.col("capacity"), F.col("whole")).otherwise(0).cast("int").alias("piece"),
        F.when(F.col("size") > F.col("capacity"), F.col("whole") * F.col("capacity")).otherwise(0).cast("bigint").alias("start"),
        F.when(F.col("size") > F.col("capacity"), F.col("size") % F.col("capacity")).otherwise(F.col("size")).cast("bigint").alias("n_tokens"),
    ).where("n_tokens > 0 OR piece = 0")
    rest = scratch.cut(rest)
    done = [full]
    for level in range(limits.rounds):
        totals = {r[0]: (int(r[1]), int(r[2])) for r in rest.groupBy("pack_id").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()}
        if not totals:
            break
        # a block is bounded by its containers' worth of tokens and, for small items, by their number
        blocks = {p: max(1, -(-totals[p][0] // (BLOCK_CONTAINERS * c)), -(-totals[p][1] // (64 * BLOCK_CONTAINERS))) for p, c in caps if p in totals}
        n = F.create_map(*[x for p, b in blocks.items() for x in (F.lit(p), F.lit(b).cast("bigint"))])[F.col("pack_id")]
        blocked = rest.withColumn("block", F.pmod(F.xxhash64("id", F.lit(level)), n))
        solved = scratch.cut(blocked.groupBy("pack_id", "block").applyInPandas(lambda items: _solve(items, limits), out_schema))
        stays = (F.col("filled") >= limits.well_filled * F.col("capacity")) | (n == 1) | F.lit(level == limits.rounds - 1)
        container = F.concat_ws("-", F.lit(f"r{level}"), "block", "number").alias("container")
        done.append(solved.where(stays).select("pack_id", container, "id", "piece", "start", "n_tokens"))
        rest = scratch.cut(solved.where(~stays).select("pack_id", "capacity", "id", "piece", "start", "n_tokens"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out
