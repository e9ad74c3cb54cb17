"""Filling fixed-capacity containers by linear grouping.

Only the histogram of sizes is needed to plan: it has at most ``capacity`` entries however
many items there are. Large sizes are sorted, cut into groups of equal cardinality and
rounded up to the largest of their group; the few rounded sizes are packed by
configurations (which sizes share a container), each chosen by dynamic programming and
repeated as often as supplies last; actual sizes take the places of the rounded ones; the
small items go by best fit into the room that is left. The plan maps ranks of items within
their size to containers, so it is applied to the items by one broadcast join of bounded
size, without ever collecting items.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.staging import Stage

CAPACITY = 2048
#: Number of groups of large sizes; sizes up to capacity / SMALL_PART are small.
GROUPS, SMALL_PART = 48, 8
#: Items of one size that one task sorts.
SLICE = 500_000


def _configuration(left: dict[int, int], capacity: int) -> list[int]:
    """The fullest multiset of the rounded sizes still in supply that fits, larger sizes first."""
    best: dict[int, tuple[int, ...]] = {0: ()}
    for size in sorted(left, reverse=True):
        for total, used in sorted(best.items(), reverse=True):
            most = min(left[size], (capacity - total) // size)
            for k in range(1, most + 1):
                best.setdefault(total + k * size, used + (size,) * k)
        if capacity in best:
            break
    top = max(best)
    return list(best[top])


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int]]:
    """Runs (size, first_rank, count, first_container): of the items of ``size``, those with
    ranks first_rank .. first_rank + count - 1 go, in order, one to each container from
    first_container on. Covers every item of sizes 1 .. capacity exactly once."""
    small_limit = capacity // SMALL_PART
    large = sorted(((s, n) for s, n in histogram.items() if s > small_limit), reverse=True)
    total = sum(n for _, n in large)
    used = dict.fromkeys(histogram, 0)
    runs: list[tuple[int, int, int, int]] = []
    containers = 0
    rooms: list[tuple[int, int, int]] = []  # (room, first container, how many), by room

    # Linear grouping: equal cardinality, from the largest down
    supply: dict[int, list[list[int]]] = {}
    per = max(1, -(-total // groups))
    bucket, held, rounded = [], 0, 0
    for size, n in large:
        while n:
            if not bucket:
                rounded = size
            take = min(n, per - held)
            bucket.append([size, take])
            held, n = held + take, n - take
            if held == per:
                supply.setdefault(rounded, []).extend(bucket)
                bucket, held = [], 0
    if bucket:
        supply.setdefault(rounded, []).extend(bucket)

    left = {r: sum(n for _, n in parts) for r, parts in supply.items()}
    while left:
        config = _configuration(left, capacity)
        need = {r: config.count(r) for r in set(config)}
        times = min(left[r] // k for r, k in need.items())
        # substitute actual sizes: each slot is a step function over the containers
        steps: list[list[tuple[int, int]]] = []
        for r in config:
            slot, want = [], times
            parts = supply[r]
            while want:
                size, n = parts[0]
                take = min(n, want)
                slot.append((size, take))
                want -= take
                parts[0][1] -= take
                if not parts[0][1]:
                    parts.pop(0)
            steps.append(slot)
        for slot in steps:
            at = containers
            for size, n in slot:
                runs.append((size, used[size], n, at))
                used[size] += n
                at += n
        at, rest = 0, [list(map(list, slot)) for slot in steps]
        while at < times:
            n = min(slot[0][1] for slot in rest)
            room = capacity - sum(slot[0][0] for slot in rest)
            if room:
                insort(rooms, (room, containers + at, n))
            for slot in rest:
                slot[0][1] -= n
                if not slot[0][1]:
                    slot.pop(0)
            at += n
        containers += times
        for r, k in need.items():
            left[r] -= k * times
            if not left[r]:
                del left[r]

    # Best fit of the small sizes, largest first
    for size in sorted((s for s in histogram if 0 < s <= small_limit), reverse=True):
        n = histogram[size]
        while n:
            k = bisect_left(rooms, (size, -1, 0))
            if k == len(rooms):
                fit = capacity // size
                opened = -(-n // fit)
                insort(rooms, (capacity, containers, opened))
                containers += opened
                continue
            room, at, have = rooms.pop(k)
            take = min(have, n)
            runs.append((size, used[size], take, at))
            used[size] += take
            n -= take
            if room > size:
                insort(rooms, (room - size, at, take))
            if have > take:
                insort(rooms, (room, at + take, have - take))
    return runs


def pack(sizes: DataFrame, capacity: int = CAPACITY, stage: Stage | None = None, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(id_col, piece, size, container): where each item lies.

    Items of size 0 or null need no room and are left out. An item larger than the
    capacity, and no other, is cut into full pieces and a rest; pieces are numbered from
    0, all others have piece 0. Repeated ids are items of their own. Containers are
    numbered from 0 without gaps; no container exceeds the capacity. Extra columns are
    ignored; an empty table gives an empty result.
    """
    stage = stage or Stage(sizes.sparkSession, "packing")
    spark = sizes.sparkSession
    items = sizes.select(F.col(id_col), F.col(size_col).cast("long").alias("whole")).where("whole > 0")
    last = F.floor((F.col("whole") - 1) / capacity).cast("int")
    pieces = items.select(id_col, "whole", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select(id_col, "piece", F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("piece").cast("long") * capacity).cast("int").alias("size"))
    # ranks within a size without gathering a size: number the rows of (size, slice), then add
    # the slices before; a size has a slice for every SLICE items
    pieces = stage.write(pieces, "pieces")
    slices = [(r["size"], -(-r["count"] // SLICE)) for r in pieces.groupBy("size").count().collect()]  # at most capacity rows
    slices = spark.createDataFrame(slices, "size int, slices int")
    pieces = pieces.join(F.broadcast(slices), "size").withColumn("slice", F.pmod(F.xxhash64(id_col, "piece"), F.col("slices")).cast("int")).drop("slices")
    counts = pieces.groupBy("size", "slice").count()
    counted = [(r["size"], r["slice"], r["count"]) for r in counts.collect()]  # at most capacity rows and one for every SLICE items
    histogram: dict[int, int] = {}
    before = []
    for size, part, n in sorted(counted):
        before.append((size, part, histogram.get(size, 0)))
        histogram[size] = histogram.get(size, 0) + n
    runs = plan(histogram, capacity)
    starts = spark.createDataFrame(before, "size int, slice int, before long")
    within = Window.partitionBy("size", "slice").orderBy(id_col, "piece")
    ranked = pieces.withColumn("_r", F.row_number().over(within)).join(F.broadcast(starts), ["size", "slice"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("_r") - 1)
    # runs of a size are consecutive in rank: find an item's run by its start
    table = spark.createDataFrame([(s, r, n, c) for s, r, n, c in runs], "size int, first long, n long, at long")
    table = table.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("first", "n", "at"))).alias("runs"))
    placed = ranked.join(F.broadcast(table), "size").withColumn(
        "run", F.element_at(F.filter("runs", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["first"] + x["n"])), 1)
    )
    return placed.select(id_col, "piece", "size", (F.col("run.at") + F.col("rank") - F.col("run.first")).alias("container"))
