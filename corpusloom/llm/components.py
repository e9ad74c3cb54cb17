"""Consolidating pairwise matches into groups.

Union-find runs inside each edge partition and keeps only a spanning forest: one edge from
every node to the smallest node of its tree. Forests of several partitions merge in
partitions of at most ``bound`` edges, level by level. When the forests of one level are
still larger than one bounded partition may hold, the graph is contracted: nodes that met
in one place only take their label from their root and leave, and the rest go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import Stage

#: Edges that one merging task takes: about 200 MB of its worker.
BOUND = 2_000_000


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star forest of the edges: (node, smallest node of its tree) for each node that is
    not the smallest one itself. Union-find with path halving, the smaller root wins."""
    if not len(src):
        return src, dst
    nodes, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = code[: len(src)], code[len(src) :]
    once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    parent = list(range(len(nodes)))
    for x, y in once.tolist():
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.array(parent)
    while True:  # codes follow the order of nodes, so every parent is the smaller one
        up = root[root]
        if (up == root).all():
            break
        root = up
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["node", "root"])


def _partition_forest(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0

        def flush() -> tuple[np.ndarray, np.ndarray]:
            return forest(np.concatenate([a, *(x.column(0).to_numpy() for x in held)]), np.concatenate([b, *(x.column(1).to_numpy() for x in held)]))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 200_000:
                a, b = flush()
                held, size = [], 0
                if len(a) > bound:  # hand on what was found and start a new forest
                    yield _edges(a, b)
                    a, b = a[:0], b[:0]
        a, b = flush()
        for begin in range(0, len(a), 50_000):
            yield _edges(a[begin : begin + 50_000], b[begin : begin + 50_000])

    return run


def _forests(edges: DataFrame, bound: int) -> DataFrame:
    return edges.mapInArrow(_partition_forest(bound), "node bigint, root bigint")


def _merged(stage: Stage, star: DataFrame, bound: int, tag: str) -> tuple[DataFrame, bool]:
    """Merge forests in partitions of about ``bound`` edges, until one partition is left or
    a level frees too little and leaves more than one partition may hold. With the forests,
    whether they are one, merged in a single partition."""
    n = star.count()
    for level in range(64):
        parts = -(-n // bound)
        if not n:
            return star, True
        merged = stage.write(_forests(star.repartition(parts) if parts > 1 else star.coalesce(1), bound), f"{tag}-{level}")
        m = merged.count()
        if parts == 1:
            return merged, True
        star, freed, n = merged, m <= 0.7 * n, m
        if m > bound and not freed:
            break
    return star, False


def _contract(star: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, edges): the smallest root that each node met (a root meets itself), and
    between its roots the edges that remain."""
    star = star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
    label = star.groupBy("node").agg(F.min("root").alias("up"), F.count_distinct("root").alias("n"))
    several = label.where("n > 1").select("node", "up")
    rest = star.join(several, "node").where("root <> up").select(F.col("root").alias("node"), F.col("up").alias("root")).distinct()
    return label.select("node", "up"), rest


def connected_components(edges: DataFrame, stage: Stage | None = None, bound: int = BOUND) -> DataFrame:
    """(node, component) of every node with an edge to another node; component is its
    smallest node.

    ``edges`` has two long columns (any names). Null ends and loops tie nothing, repeats
    and either order change nothing, an empty table gives an empty result. No task holds
    more than about ``2 * bound`` edges.
    """
    stage = stage or Stage(edges.sparkSession, "components")
    src, dst = edges.columns[:2]
    edges = edges.select(F.col(src).alias("node"), F.col(dst).alias("root")).where("node <> root")
    star = stage.write(_forests(edges, bound), "level-0")
    labels: list[DataFrame] = []
    for turn in range(64):
        star, whole = _merged(stage, star, bound, f"merge-{turn}")
        if whole:
            break
        label, rest = _contract(star)
        labels.append(stage.write(label, f"label-{turn}"))
        star = stage.write(_forests(rest, bound), f"rest-{turn}")
    else:
        raise RuntimeError("the graph did not contract")
    out = star.select("node", F.col("root").alias("component"))
    for label in reversed(labels):
        top = out.select(F.col("node").alias("_n"), "component")
        out = label.join(top, label.up == F.col("_n"), "left").select("node", F.coalesce("component", "up").alias("component"))
        out = out.where("node <> component")
    roots = out.select(F.col("component").alias("node"), "component").distinct()
    return out.unionByName(roots)


def _member_forest(bound: int):
    """Union-find over nodes and keys of one partition: (key, node) and (node, root) stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            node = rows.column(0).to_numpy()
            coded = rows.column(1).combine_chunks().dictionary_encode()
            code = np.asarray(coded.indices)
            order = np.lexsort((node, code))
            node, code = node[order], code[order]
            first = np.ones(len(code), dtype=bool)
            first[1:] = code[1:] != code[:-1]
            least = node[first][np.cumsum(first) - 1]
            a, b = forest(node, least)
            up = dict(zip(a.tolist(), b.tolist(), strict=True))
            keys = coded.dictionary.take(pa.array(code[first]))
            heads = pa.array([up.get(x, x) for x in node[first].tolist()], pa.int64())
            empty = pa.nulls(len(a), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([keys, empty]), pa.concat_arrays([heads, pa.array(a, pa.int64())]), pa.concat_arrays([pa.nulls(len(keys), pa.int64()), pa.array(b, pa.int64())])],
                names=["key", "node", "root"],
            )

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= bound:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def member_forests(members: DataFrame, stage: Stage, bound: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(node, root) edges and (key, node) heads that together tie all nodes of one key, from
    rows (node long, key string).

    Each partition runs union-find over its own rows, so that a key, however many rows it
    has, leaves one head per partition (and ``bound`` rows).
    """
    node, key = members.columns[:2]
    rows = members.select(F.col(node).alias("node"), F.col(key).cast("string").alias("key")).where("node is not null and key is not null")
    local = stage.write(rows.mapInArrow(_member_forest(bound), "key string, node bigint, root bigint"), "members")
    return local.where("key is null").select("node", "root"), local.where("key is not null").select("key", "node")


def key_edges(heads: DataFrame) -> DataFrame:
    """(node, root) edges between the heads of one key."""
    least = heads.groupBy("key").agg(F.min("node").alias("root"))
    return heads.join(least, "key").where("node <> root").select("node", "root")


def member_edges(members: DataFrame, stage: Stage, bound: int = 200_000) -> DataFrame:
    """Edges (node, root) that tie all nodes of one key, from rows (node long, key string)."""
    edges, heads = member_forests(members, stage, bound)
    return edges.unionByName(key_edges(heads))
