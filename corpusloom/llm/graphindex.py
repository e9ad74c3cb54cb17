"""Near-duplicates of new batches against all history, on shards of a small-world graph.

Every accepted batch becomes one or more shards: its distinct texts with their sketches as a
navigable graph (each node linked to the nearest ones that a beam search found when it was
inserted, both ways, to its neighbours in the order of a shared band key, and to a few far
ones), their hashed words for the exact comparison, and which of them are known to be linked
to each other. A new batch visits the shards of the history in which one of its band keys
occurs; there beams find what is near, and what is near is compared word by word on the
spot. Small shards are merged on a schedule, from their own content, so no text of the
history is read again.

Sketches of unrelated texts are all equally far apart, so a beam that starts anywhere does
not come nearer to a duplicate except by chance (``recall`` measures it). Beams therefore
start at nodes that share a band key with the query, and the graph leads from there to the
rest of its neighbourhood. A beam that fills up with hits goes on: components that the
query has been linked to are closed to it, since further links into them tell nothing new,
and if none could be closed the beam is widened. So every component of a shard that a text
is linked to gives one link, and a cluster of many near texts gives a spanning set.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.staging import Stage
from . import text as T
from .bitslice import RADIUS

#: Rows of a shard (about 200 bytes each) and words (4 bytes each) as far as rows can be
#: parted, and queries that one search task takes.
SHARD_ROWS, SHARD_WORDS, QUERY_ROWS = 50_000, 16_000_000, 20_000
#: Places of all beams that are held at once.
HELD = 1 << 22
#: Nearest nodes searched for at insertion; links per node: far ones, neighbours in order, places in all.
NEAR, FAR, ORDER, LINKS = 8, 2, 2, 18
BEAM = 32
#: Shards of one tier (sizes within a factor TIER) that are merged into one.
TIER = 4
_FREE = np.int64(2**62)
_NODE = 32


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Texts:
    """What is known of texts, by number: id, kind, sketch (uint64 [n, 2]), folded band keys
    (uint32 [n, bands]) and hashed words in order."""

    def __init__(self, ids: np.ndarray, kinds: np.ndarray, codes: np.ndarray, bands: np.ndarray, words: np.ndarray, ends: np.ndarray):
        self.ids, self.kinds, self.codes, self.bands, self.words, self.ends = ids, kinds, codes, bands, words, ends

    def __len__(self) -> int:
        return len(self.ids)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.ids, self.kinds, self.codes, self.bands, self.words, self.ends

    def words_of(self, k: int) -> np.ndarray:
        return self.words[self.ends[k - 1] if k else 0 : self.ends[k]]

    def take(self, at: np.ndarray) -> Texts:
        own = [self.words_of(k) for k in at.tolist()]
        ends = np.cumsum([len(w) for w in own], dtype=np.int64)
        return Texts(self.ids[at], self.kinds[at], self.codes[at], self.bands[at], np.concatenate(own) if own else self.words[:0], ends)

    @classmethod
    def of(cls, rows: pa.Table | pa.RecordBatch) -> Texts:
        n = rows.num_rows
        whole = [c.combine_chunks() if isinstance(c := rows.column(name), pa.ChunkedArray) else c for name in ("rep", "kind", "s0", "s1", "bands", "words")]
        ids, kinds, s0, s1 = (c.to_numpy(zero_copy_only=False) for c in whole[:4])
        bands = whole[4].flatten().to_numpy().view(np.uint32)  # folded to their low half
        words = [np.frombuffer(w, np.uint32) for w in whole[5].to_pylist()]
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        codes = np.stack([s0, s1], axis=1).view(np.uint64) if n else np.zeros((0, 2), np.uint64)
        return cls(ids, kinds.astype(bool), codes, bands.reshape(n, -1) if n else bands.reshape(0, 1), np.concatenate(words) if n else np.zeros(0, np.uint32), ends)

    @classmethod
    def joined(cls, parts: list[Texts]) -> Texts:
        before = np.cumsum([0, *(len(p.words) for p in parts[:-1])])
        return cls(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("ids", "kinds", "codes", "bands", "words")), np.concatenate([p.ends + b for p, b in zip(parts, before, strict=True)]))


def _same(a: Texts, i: int, b: Texts, j: int) -> bool:
    """The exact comparison."""
    return bool(a.kinds[i] == b.kinds[j]) and T.same_up_to_edits(a.words_of(i).astype(np.uint64), b.words_of(j).astype(np.uint64))


class _Groups:
    """Union-find over nodes; the smallest node stands for its group."""

    def __init__(self, up: np.ndarray):
        self.up = up.tolist()

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)

    def tops(self) -> np.ndarray:
        return np.array([self.top(x) for x in range(len(self.up))], np.int64)


class Shard:
    """Texts with links between near ones, and for each the component (its smallest node) of
    those known to be linked. ``pairs`` are the links of which the components were made."""

    def __init__(self, texts: Texts, links: np.ndarray | None = None, component: np.ndarray | None = None):
        self.texts, self.ids, self.codes, self.bands = texts, texts.ids, texts.codes, texts.bands
        self.pairs: list[tuple[int, int]] = []
        width = self.bands.shape[1] if len(self.ids) else 1
        flat = self.bands.ravel() if len(self.ids) else np.zeros(0, np.uint32)
        # the band number is part of the key already; sorting all keys together is enough
        order = np.argsort(flat, kind="stable")
        self.sorted_keys, self.sorted_nodes = flat[order], (order // width).astype(np.int64)
        if links is not None:
            self.links, self.component = links, component
            self._group()
            return
        self.links = np.full((len(self.ids), LINKS), -1, np.int32)
        self.component = np.arange(len(self.ids)) if component is None else component
        self._group()
        near = self._link_buckets()
        self._insert_all()
        self._connect(*near)

    def _group(self) -> None:
        """Nodes of each band key in order of their component, and where each (key, component) ends."""
        order = np.lexsort((self.sorted_nodes, self.component[self.sorted_nodes], self.sorted_keys))
        self.keys, self.nodes = self.sorted_keys[order], self.sorted_nodes[order]
        if not len(order):
            self.starts = np.zeros(0, np.int64)
            return
        of = self.component[self.nodes]
        self.starts = np.flatnonzero(np.concatenate([[True], (self.keys[1:] != self.keys[:-1]) | (of[1:] != of[:-1])]))
        self.start_keys, self.start_component = self.keys[self.starts], of[self.starts]
        self.start_ends = np.append(self.starts[1:], len(order))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        for x in (*self.texts.arrays(), self.links, self.component):
            np.save(out, x, allow_pickle=False)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        src = io.BytesIO(data)
        held = [np.load(src, allow_pickle=False) for _ in range(8)]
        return cls(Texts(*held[:6]), *held[6:])

    @classmethod
    def merged(cls, shards: list[Shard]) -> Shard:
        """One shard of all, repeated texts left out, built from what the shards hold."""
        before = np.cumsum([0, *(len(s.ids) for s in shards[:-1])])
        component = np.concatenate([s.component + b for s, b in zip(shards, before, strict=True)])
        return cls.distinct(Texts.joined([s.texts for s in shards]), component)

    @classmethod
    def distinct(cls, texts: Texts, component: np.ndarray | None = None) -> Shard:
        """A shard of the distinct texts, with what is known of their components."""
        component = np.arange(len(texts)) if component is None else component
        first: dict[bytes, int] = {}
        groups = _Groups(component)
        keep = []
        for k in range(len(texts)):
            same = first.setdefault(texts.words_of(k).tobytes() + bytes([int(texts.kinds[k])]), k)
            if same == k:
                keep.append(k)
            else:
                groups.join(same, k)
        kept, tops = np.array(keep, np.int64), groups.tops()
        _, where, own = np.unique(tops[kept], return_index=True, return_inverse=True)
        return cls(texts.take(kept), component=where[own].astype(np.int64))

    def _connect(self, u: np.ndarray, v: np.ndarray) -> None:
        """Components of the shard: neighbours of a band key are compared first, so that a
        cluster is one before its members are searched for links to others."""
        groups = _Groups(self.component)
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            if groups.top(a) != groups.top(b) and _same(self.texts, a, self.texts, b):
                groups.join(a, b)
                self.pairs.append((a, b))
        self.component = groups.tops()
        self._group()
        for a, b in zip(*self.linked(self.texts, own=True), strict=True):
            if groups.top(a) != groups.top(b):
                groups.join(a, b)
                self.pairs.append((a, b))
        self.component = groups.tops()
        self._group()

    def _insert_all(self) -> None:
        n, done = len(self.ids), 0
        rng = np.random.default_rng(7)
        while done < n:
            upto = min(n, done + max(256, min(done, 8192)))
            new = np.arange(done, upto)
            if done:
                beam = self.search(self.codes[new], self.bands[new], below=done, start=self.first_entries(self.bands[new], done))
                near = np.where(beam < _FREE, (beam >> 1) & (2**_NODE - 1), -1)[:, :NEAR].ravel()
                self.links[new, :FAR] = rng.integers(0, done, (len(new), FAR))
                source = np.repeat(new, len(near) // len(new))[near >= 0]
                self._link(source, near[near >= 0])
            done = upto

    def _link_buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Link nodes that follow each other under a band key and are close, and give those
        within the radius. The next and the one before in order of nodes have places of
        their own, so that however many nodes are equally near, a search that reaches one
        of them can walk to all."""
        u, v = self.sorted_nodes[:-1], self.sorted_nodes[1:]
        ok = (self.sorted_keys[:-1] == self.sorted_keys[1:]) & (u < v)
        both = np.unique(u[ok] * np.int64(2**_NODE) + v[ok])
        u, v = both >> _NODE, both & (2**_NODE - 1)
        apart = _distance(self.codes[u], self.codes[v])
        close = apart <= RADIUS + 4
        u, v, apart = u[close], v[close], apart[close]
        after, before = np.full(len(self.ids), 2**_NODE, np.int64), np.full(len(self.ids), -1, np.int64)
        np.minimum.at(after, u, v)
        np.maximum.at(before, v, u)
        self.links[:, FAR] = np.where(after < 2**_NODE, after, -1)
        self.links[:, FAR + 1] = before
        self._link(u, v)
        near = np.flatnonzero(apart <= RADIUS)
        near = near[np.argsort(apart[near], kind="stable")]
        return u[near], v[near]

    def _link(self, u: np.ndarray, v: np.ndarray) -> None:
        """Make u and v neighbours of each other; every node keeps its nearest ones."""
        if not len(u):
            return
        head = FAR + ORDER
        touched = np.unique(np.concatenate([u, v]))
        old = self.links[touched, head:].astype(np.int64)
        a = np.concatenate([u, v, np.repeat(touched, old.shape[1])])
        b = np.concatenate([v, u, old.ravel()])
        a, b = a[b >= 0], b[b >= 0]
        d = _distance(self.codes[a], self.codes[b])
        order = np.lexsort((b, d, a))
        a, b = a[order], b[order]
        fresh = np.ones(len(a), dtype=bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[fresh], b[fresh]
        place = np.arange(len(a)) - np.searchsorted(a, a, side="left")
        keep = place < LINKS - head
        self.links[touched, head:] = -1
        self.links[a[keep], place[keep] + head] = b[keep]

    def first_entries(self, bands: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs where beams start at insertion: of each band key of the query
        the first, second and last of the nodes below ``below``."""
        flat = bands.ravel()
        lo = np.searchsorted(self.sorted_keys, flat, side="left")
        hi = np.searchsorted(self.sorted_keys, flat, side="right")
        hit = np.flatnonzero(hi > lo)
        query = hit // bands.shape[1]
        at = np.concatenate([lo[hit], hi[hit] - 1, np.minimum(lo[hit] + 1, hi[hit] - 1)])
        query, node = np.tile(query, 3), self.sorted_nodes[at]
        query, node = query[node < below], node[node < below]
        both = np.unique(query * np.int64(2**_NODE) + node)
        return both >> _NODE, both & (2**_NODE - 1)

    def _holding(self, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each band key of each query where the (key, component) groups with that key
        begin, and how many they are."""
        flat = bands.ravel()
        lo = np.searchsorted(self.start_keys, flat, side="left")
        return lo, np.searchsorted(self.start_keys, flat, side="right") - lo

    def entries(self, bands: np.ndarray, closed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs where beams start: of each component that holds a band key of
        the query and is not closed to it, the first, second and last node with that key."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, n = self._holding(bands)
        hit = np.flatnonzero(n)
        query = np.repeat(hit // bands.shape[1], n[hit])
        group = np.repeat(lo[hit] - np.cumsum(n[hit]) + n[hit], n[hit]) + np.arange(n[hit].sum())
        if closed is not None and len(closed):
            ok = ~_within(query * np.int64(2**_NODE) + self.start_component[group], closed)
            query, group = query[ok], group[ok]
        start, last = self.starts[group], self.start_ends[group] - 1
        query, node = np.tile(query, 3), self.nodes[np.concatenate([start, last, np.minimum(start + 1, last)])]
        both = np.unique(query * np.int64(2**_NODE) + node)
        return both >> _NODE, both & (2**_NODE - 1)

    def search(self, codes: np.ndarray, bands: np.ndarray, beam: int = BEAM, stop: int = RADIUS + 4, below: int | None = None, start: tuple[np.ndarray, np.ndarray] | None = None, closed: np.ndarray | None = None) -> np.ndarray:
        """int64 [queries, beam]: (distance, node) packed and sorted, free places last. Nodes
        further than ``stop`` are not expanded. ``start`` gives other (query, node) entries,
        ``closed`` the sorted (query, component) that no beam enters."""
        query, node = self.entries(bands, closed) if start is None else start
        key = (_distance(self.codes[node], codes[query]) << (_NODE + 1)) | (node << 1) | 1
        order = np.lexsort((key, query))
        query, key = query[order], key[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        out = np.full((len(codes), beam), _FREE, np.int64)
        ok = place < beam
        out[query[ok], place[ok]] = key[ok]
        active = np.unique(query)
        while len(active):
            now = out[active]
            open_ = (now & 1).astype(bool) & (now < _FREE)
            first = open_.argmax(axis=1)
            best = now[np.arange(len(active)), first]
            go = open_.any(axis=1) & ((best >> (_NODE + 1)) <= stop)
            active, first, best = active[go], first[go], best[go]
            if not len(active):
                break
            out[active, first] -= 1  # expanded
            near = self.links[(best >> 1) & (2**_NODE - 1)].astype(np.int64)
            if below is not None:
                near[near >= below] = -1
            d = _distance(self.codes[near], codes[active][:, None, :])
            if closed is not None and len(closed):
                near[_within(active[:, None] * np.int64(2**_NODE) + self.component[near], closed)] = -1
            fresh = np.where(near >= 0, (d << (_NODE + 1)) | (near << 1) | 1, _FREE)
            merged = np.sort(np.concatenate([out[active], fresh], axis=1), axis=1)
            again = (merged[:, 1:] >> 1) == (merged[:, :-1] >> 1)
            merged[:, 1:][again] = _FREE
            merged.sort(axis=1)
            out[active] = merged[:, :beam]
        return out

    def linked(self, asked: Texts, own: bool = False, radius: int = RADIUS, beam: int = BEAM) -> tuple[list[int], list[int]]:
        """(query, node), the nodes that the texts are the same as up to small edits: of each
        component that a query is linked to at least one. With ``own`` the queries are the
        nodes themselves, and their own components are closed to them from the start."""
        queries, nodes = [], []
        shut = np.arange(len(asked)) * np.int64(2**_NODE) + self.component if own else np.zeros(0, np.int64)
        work = [(np.arange(len(asked)), beam)] if len(self.ids) else []
        failed: set[tuple[int, int]] = set()
        while work:
            todo, beam = work.pop()
            held = np.cumsum(3 * self._holding(asked.bands[todo])[1].reshape(len(todo), -1).sum(axis=1) + beam + LINKS)
            if len(todo) > 1 and held[-1] > HELD:  # a query alone holds no more than its shard
                cuts = np.unique(np.searchsorted(held, np.arange(HELD, held[-1], HELD)) + 1)
                work += [(part, beam) for part in np.split(todo, cuts) if len(part)]
                if len(work[-1][0]) < len(todo):
                    continue
                work.pop()
            place = np.searchsorted(shut, todo << _NODE), np.searchsorted(shut, (todo + 1) << _NODE)
            n = place[1] - place[0]
            at = np.repeat(place[0] - np.cumsum(n) + n, n) + np.arange(n.sum())
            closed = np.repeat(np.arange(len(todo)) << _NODE, n) + (shut[at] & (2**_NODE - 1))
            out = self.search(asked.codes[todo], asked.bands[todo], beam, closed=closed)
            near = (out >> (_NODE + 1)) <= radius
            full = near.all(axis=1) & (beam < len(self.ids))
            row, k = np.nonzero(near)
            node = (out[row, k] >> 1) & (2**_NODE - 1)
            fresh: set[tuple[int, int]] = set()
            for q, x, c in zip(todo[row].tolist(), node.tolist(), self.component[node].tolist(), strict=True):  # nearest first
                if (q, c) in fresh or (q, x) in failed or (own and q == x):
                    continue
                if _same(asked, q, self.texts, x):
                    fresh.add((q, c))
                    queries.append(q)
                    nodes.append(x)
                else:
                    failed.add((q, x))
            if full.any():
                again = {q for q, _ in fresh}
                more = np.array(sorted((q << _NODE) + c for q, c in fresh), np.int64)
                shut = np.unique(np.concatenate([shut, more]))
                goes = np.array([q in again for q in todo.tolist()])
                if (full & goes).any():
                    work.append((todo[full & goes], beam))
                if (full & ~goes).any():
                    work.append((todo[full & ~goes], beam * 4))
        return queries, nodes

    def recall(self, codes: np.ndarray, bands: np.ndarray, radius: int = RADIUS, beam: int = BEAM, routed: bool = True, seed: int = 3) -> tuple[int, int]:
        """(found, all) neighbours within ``radius`` by beam search against exhaustive search;
        with ``routed`` false beams start at ``beam`` random nodes and expand all the way."""
        start, stop = None, RADIUS + 4
        if not routed:
            rng = np.random.default_rng(seed)
            start = (np.repeat(np.arange(len(codes)), 8), rng.integers(0, len(self.ids), 8 * len(codes)))
            stop = 128
        out = self.search(codes, bands, beam, stop, start=start)
        got = int(((out >> (_NODE + 1)) <= radius).sum())
        every = sum(int((_distance(self.codes, c[None, :]) <= radius).sum()) for c in codes)
        return got, every


def _within(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[at] == values


_OUT = pa.schema([("part", pa.string()), ("name", pa.string()), ("shard", pa.int64()), ("n", pa.int64()), ("graph", pa.binary()), ("keys", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])
_OUT_DDL = "part string, name string, shard bigint, n bigint, graph binary, keys binary, a bigint, b bigint"
_SHARD_DDL = "name string, shard bigint, n bigint, graph binary, keys binary"
_PAIR_DDL = "a bigint, b bigint"


def _rows(shard: Shard, name: str, number: int) -> pa.RecordBatch:
    """A shard as it is stored: a row for the graph with the distinct band keys, one per link."""
    a = [min(shard.ids[x], shard.ids[y]) for x, y in shard.pairs]
    b = [max(shard.ids[x], shard.ids[y]) for x, y in shard.pairs]
    m = len(a)
    keys = np.unique(shard.bands).astype(np.uint32).tobytes() if len(shard.ids) else b""
    return pa.RecordBatch.from_pydict({
        "part": ["graph"] + ["pairs"] * m, "name": [name] * (m + 1), "shard": [number] * (m + 1), "n": [len(shard.ids)] + [None] * m,
        "graph": [shard.to_bytes()] + [None] * m, "keys": [keys] + [None] * m, "a": [None, *a], "b": [None, *b],
    }, schema=_OUT)


def _build(name: str):
    """Over rows sorted by shard: each shard built once its rows are complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for s in np.unique(shard).tolist():
                if s != number and held:
                    yield _rows(Shard.distinct(Texts.of(pa.Table.from_batches(held))), name, number)
                    held = []
                number = s
                held.append(batch.filter(pa.array(shard == s)))
        if held:
            yield _rows(Shard.distinct(Texts.of(pa.Table.from_batches(held))), name, number)

    return run


def _merge(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [Shard.from_bytes(g) for b in batches for g in b.column("graph").to_pylist()]
        if shards:
            built = Shard.merged(shards)
            yield _rows(built, name, 0)

    return run


def _sliced(keys: np.ndarray, ranges: int) -> list[tuple[int, int]]:
    """Where each of ``ranges`` equal ranges of the key space begins and ends in sorted keys."""
    cuts = np.searchsorted(keys, np.arange(1, ranges) * (2**32 // ranges)).tolist()
    return list(zip([0, *cuts], [*cuts, len(keys)], strict=True))


def _pack_queries(ranges: int):
    """Band keys of queries in blobs, one per range of keys, each with the number of its
    query, and the ids and own places of the queries: few rows to shuffle, not one per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2**16):
                batch = whole.slice(begin, 2**16)
                keys = batch.column("bands").flatten().to_numpy().view(np.uint32)
                order = np.argsort(keys, kind="stable")
                row = (order // (len(keys) // batch.num_rows)).astype(np.uint16)
                keys, rep, own = keys[order], batch.column("rep").to_numpy(), batch.column("own").to_numpy().astype(np.int32)
                cut = []
                for r, (a, b) in enumerate(_sliced(keys, ranges)):
                    asked, at = np.unique(row[a:b], return_inverse=True)
                    cut.append((r, keys[a:b].tobytes(), at.astype(np.uint16).tobytes(), rep[asked].tobytes(), own[asked].tobytes()))
                types = (pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cut], t) for k, t in enumerate(types)], names=["r", "keys", "row", "rep", "own"])

    return run


def _pack_shards(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for place, data in zip(batch.column("place").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                keys = np.frombuffer(data, np.uint32)
                rows += [(r, place, keys[a:b].tobytes()) for r, (a, b) in enumerate(_sliced(keys, ranges)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["r", "place", "keys"])

    return run


def _route(queries: pa.Table, shards: pa.Table) -> pa.Table:
    """(rep, place): the shards before its own that hold a band key of a query."""
    reps, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    held = [(p, np.frombuffer(k, np.uint32)) for p, k in zip(shards.column("place").to_pylist(), shards.column("keys").to_pylist(), strict=True)]
    for data in zip(*(queries.column(c).to_pylist() for c in ("keys", "row", "rep", "own")), strict=True):
        keys, row, rep, own = (np.frombuffer(d, t) for d, t in zip(data, (np.uint32, np.uint16, np.int64, np.int32), strict=True))
        for place, theirs in held:
            asked = np.unique(row[_within(keys, theirs)])
            found = rep[asked[own[asked] > place]]
            reps.append(found)
            places.append(np.full(len(found), place, np.int32))
    return pa.table({"rep": np.concatenate(reps), "place": np.concatenate(places)})


def _search(queries: pa.Table, shards: pa.Table) -> pa.Table:
    a, b = [], []
    if queries.num_rows:
        asked = Texts.of(queries)
        for data in shards.column("graph").to_pylist():
            shard = Shard.from_bytes(data)
            q, node = shard.linked(asked)
            x, y = asked.ids[q], shard.ids[node]
            a.append(np.minimum(x, y)[x != y])
            b.append(np.maximum(x, y)[x != y])
    return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})


class HistoryIndex:
    """Shards of all accepted texts in a folder, with a manifest of the live ones.

    ``compact`` merges small ones, ``add`` searches batches in them and makes these shards of
    their own; ``commit`` writes the manifest, and only then does it all count. Folders that
    no manifest names (of a call that failed, or merged into others) go with the next commit.
    """

    def __init__(self, spark: SparkSession, path: str, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS):
        self.spark, self.path, self.shard_rows, self.query_rows = spark, path.rstrip("/"), shard_rows, query_rows
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        manifest = self._load()
        self.live: list[dict] = manifest["live"]
        self.calls: list[str] = manifest["calls"]

    def _load(self) -> dict:
        manifest = self._path(f"{self.path}/manifest.json")
        if not self._fs.exists(manifest):
            return {"live": [], "calls": []}
        stream = self._fs.open(manifest)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, call: str) -> None:
        """The last step of a call: what it added and kept under ``call`` counts from now on."""
        self.calls.append(call)
        fresh, manifest = self._path(f"{self.path}/manifest.new"), self._path(f"{self.path}/manifest.json")
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps({"live": self.live, "calls": self.calls}).encode()))
        finally:
            stream.close()
        self._fs.delete(manifest, False)
        self._fs.rename(fresh, manifest)
        named = {*self.calls, *(e["name"] for e in self.live)}
        for held in self._fs.listStatus(self._path(self.path)):
            if held.isDirectory() and held.getPath().getName() not in named:
                self._fs.delete(held.getPath(), True)

    def _shards(self, entries: list[dict], *columns: str) -> DataFrame:
        """(place, columns) of live shards, place being their number in ``entries``."""
        folders = sorted({f"{self.path}/{e['name']}/part=graph" for e in entries})
        places = self.spark.createDataFrame([(e["name"], e["shard"], k) for k, e in enumerate(entries)], "name string, shard bigint, place int")
        held = self.spark.read.schema(_SHARD_DDL).parquet(*folders).select("name", "shard", *columns)
        return held.join(F.broadcast(places), ["name", "shard"]).select("place", *columns)  # one row per shard

    def _write(self, df: DataFrame, name: str) -> list[dict]:
        df.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}")
        rows = self.spark.read.schema(_SHARD_DDL).parquet(f"{self.path}/{name}/part=graph").select("shard", "n").collect()  # one row per shard
        return [{"name": name, "shard": r["shard"], "n": r["n"]} for r in rows]

    def add(self, texts: DataFrame, sizes: list[tuple[int, int, int]], name: str, stage: Stage) -> DataFrame:
        """Links (a, b) of some batches to the history, to each other and within themselves;
        the batches become shards under ``name``.

        ``texts`` is a stored table (batch_no, rep, kind, spread, s0, s1, bands, words); rows
        of one text in a batch have the same ``spread``, and it should have few of them.
        ``sizes`` has (batch_no, rows, words) of each batch in order. A shard belongs to one
        batch. All are built side by side; then every text is searched in the shards before
        its own.
        """
        if not sizes:
            return self.spark.createDataFrame([], _PAIR_DDL)
        first, plan = 0, []
        for number, n, words in sizes:
            plan.append((number, first, count := max(1, -(-n // self.shard_rows), -(-words // SHARD_WORDS))))
            first += count
        numbers = self.spark.createDataFrame(plan, "batch_no int, first int, parts int")
        parted = texts.join(F.broadcast(numbers), "batch_no")  # one row per batch
        parted = parted.withColumn("shard", (F.col("first") + F.pmod("spread", F.col("parts"))).cast("int")).drop("batch_no", "spread", "first", "parts")
        built = parted.repartitionById(first, "shard").mapInArrow(_build(name), _OUT_DDL)
        history = list(self.live)
        self.live += self._write(built, name)
        links = self.spark.read.schema(f"part string, {_PAIR_DDL}").parquet(f"{self.path}/{name}").where("part = 'pairs'").select("a", "b")
        if len(self.live) < 2:
            return links
        queries = parted.withColumn("own", F.col("shard") + len(history)).drop("shard")
        return links.unionByName(self.search(queries, sorted(self.live[len(history):], key=lambda e: e["shard"]), history, stage))

    def search(self, queries: DataFrame, own: list[dict], history: list[dict], stage: Stage) -> DataFrame:
        """Links (a, b) of the queries with the shards before their own."""
        entries = [*history, *own]
        ranges = max(self.spark.sparkContext.defaultParallelism, -(-sum(e["n"] for e in entries) // 400_000))
        asked = queries.select("rep", "own", "bands").mapInArrow(_pack_queries(ranges), "r int, keys binary, row binary, rep binary, own binary")
        held = self._shards(entries, "keys").mapInArrow(_pack_shards(ranges), "r int, place int, keys binary")
        found = stage.write(asked.groupBy("r").cogroup(held.groupBy("r")).applyInArrow(_route, "rep bigint, place int").distinct(), "routes")
        wanted = [tuple(r) for r in found.groupBy("place").count().collect()]  # one row per shard
        if not wanted:
            return self.spark.createDataFrame([], _PAIR_DDL)
        visited = self._shards([entries[p] for p, _ in wanted], "graph").withColumnRenamed("place", "now")
        numbers = [(k, p, -(-n // self.query_rows)) for k, (p, n) in enumerate(wanted)]
        numbers = self.spark.createDataFrame(numbers, "now int, place int, blocks int")
        graphs = visited.join(F.broadcast(numbers), "now").select("place", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "graph")
        rows = found.join(F.broadcast(numbers.drop("now")), "place").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        rows = rows.drop("blocks").join(queries.drop("own"), "rep")
        return stage.write(rows.groupBy("place", "block").cogroup(graphs.groupBy("place", "block")).applyInArrow(_search, _PAIR_DDL), "across")

    def compact(self, name: str) -> None:
        """Merge the shards of a tier once there are TIER of them, as long as they fit in one."""
        for turn in range(16):
            tiers: dict[int, list[dict]] = {}
            for e in self.live:
                tiers.setdefault(int(np.log(max(e["n"], 1)) / np.log(TIER)), []).append(e)
            full = next((t for _, t in sorted(tiers.items()) if len(t) >= TIER and sum(e["n"] for e in t) <= self.shard_rows), None)
            if not full:
                return
            merged = f"{name}-{turn}"
            built = self._shards(full, "graph").select("graph").coalesce(1).mapInArrow(_merge(merged), _OUT_DDL)
            self.live = [e for e in self.live if e not in full] + self._write(built, merged)
