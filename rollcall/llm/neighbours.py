"""Problem 2: the k most similar vectors of every vector, by cosine.

A robust-pruned directed graph per shard. Vectors are inserted in batches: a greedy beam search from a few entry points
proposes neighbours among those inserted before, the batch's own vectors propose each other, and relaxed distance
pruning (a candidate goes if one already kept is alpha times closer to it) keeps diverse edges; reverse edges are added
and pruned alike. As every vector searches the graph when it is inserted, every pair is looked for by its later member,
so insertion finds the neighbours of all vectors; vectors of other shards of a large cell are beam-searched in the
finished graph. A batch is as large as a shard, in which comparing all vectors costs a fraction of the search and misses
none; so edges are made, and followed, where a cell has several shards, and elsewhere not at all.

Shards: centroids fitted on a bounded sample (SAMPLE rows) cut the space into cells, about as many as shards are needed:
up to CELLS of a first level, and for larger tables up to FINE shifts from each, a table all cells share. Every
vector joins its nearest cell and up to OVERLAP - 1 others almost as near, so pairs near a border meet in one of them.
Shifts part pairs far more often than as many centroids would, so they only come where the sample has no more centroids
to give. Cells above SHARD rows are split by
hash into shards of bounded size; each of its vectors is inserted in one and searched in all others, in chunks. Every
row is indexed; equal vectors are one node and get their places back at the end, each copy linked to the first k.
Vectors travel as whole millionths of three bytes each, which is what they are rounded to.

The index is approximate by nature; tests measure its recall against brute force (at least 0.9).

Defined results: null, all-zero, NaN, infinite and wrong-length vectors take no part; norms don't matter; ties in
similarity go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import broadcast_if_small, cut, shuffle_width

DIM = 64
#: Rows the centroids are fitted on, most centroids of the first and of the second level, cells a vector joins at most (those whose centroid is at most MARGIN less similar than the nearest) and about, and rows of a shard at most.
SAMPLE, CELLS, FINE, OVERLAP, MARGIN, COPIES, SHARD = 32768, 32768, 1024, 5, 0.06, 3.5, 8192
#: Edges per node, beam width, nodes expanded at once, pruning slack, vectors inserted at once (a shard, where comparing them all costs a quarter of a beam search), entry points.
DEGREE, BEAM, WIDE, ALPHA, BATCH, ENTRIES = 16, 26, 4, 1.2, 8192, 12
#: Vectors of a batch compared with all of it at once, and queries that search the graph at once.
OWN, ASKED = 512, 2048


class Graph:
    """Robust-pruned graph over unit vectors, built by batch insertion."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7):
        self.n, self.degree, self.beam, self.alpha = len(vectors), degree, beam, alpha
        self.room = degree + degree // 2
        self.x = np.vstack([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)]).astype(np.float32)
        self.edges = np.full((self.n + 1, self.room), self.n, np.int32)
        self.used = np.zeros(self.n + 1, np.int32)
        self.entries = np.random.default_rng(seed)

    def build(self, found: Callable[[np.ndarray, np.ndarray, np.ndarray], None], least: float = -1.0, searched: bool = True) -> None:
        """Inserts all vectors; found(nodes, neighbours, similarities) is called with what each batch's search proposes.

        If the finished graph isn't searched, nobody follows the edges of the last batch: it gets none, and proposals under
        `least` are left out there.
        """
        for lo in range(0, self.n, BATCH):
            hi = min(lo + BATCH, self.n)
            linked = searched or hi < self.n
            ids, sims = self._own(lo, hi, -2 if linked else least)
            if lo:
                there, how = self.search(self.x[lo:hi], lo)
                ids, sims = np.hstack([ids, there]), np.hstack([sims, how])
            order = np.argsort(-sims, axis=1, kind="stable")[:, : self.beam + 8]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            nodes = np.arange(lo, hi, dtype=np.int32)
            found(nodes, ids, sims)
            if linked:
                kept = self.prune(ids, sims)
                self.edges[lo:hi, : self.degree] = kept
                self.used[lo:hi] = (kept < self.n).sum(1)
                self._reverse(nodes, kept)

    def _own(self, lo: int, hi: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities): the most similar vectors of a batch for each of its vectors, exact; n and -2 for a vector that has none of at least `least`."""
        width, x = min(self.beam, hi - lo), self.x[lo:hi]
        ids, sims = np.full((hi - lo, width), self.n, np.int32), np.full((hi - lo, width), -2, np.float32)
        for at in range(0, hi - lo, OWN):
            own = x[at : at + OWN] @ x.T
            own[np.arange(len(own)), np.arange(at, at + len(own))] = -2
            rows = np.flatnonzero(own.max(1) >= least)
            own = own[rows] if len(rows) < len(own) else own
            near = np.argpartition(own, own.shape[1] - width, axis=1)[:, own.shape[1] - width :]
            ids[at + rows], sims[at + rows] = near + lo, np.take_along_axis(own, near, 1)
        ids[sims <= -2] = self.n
        return ids, sims

    def prune(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """For rows of candidates by falling similarity: the diverse ones kept, n where none is left."""
        rows, width = ids.shape
        out = np.full((rows, self.degree), self.n, np.int32)
        for lo in range(0, rows, 512):
            i, s = ids[lo : lo + 512], sims[lo : lo + 512]
            v = self.x[i]
            between = v @ v.transpose(0, 2, 1)
            free = (i < self.n) & (s > -2)
            at = np.zeros(len(i), np.int64)
            for _ in range(min(self.degree, width)):
                pick = free.argmax(1)
                some = np.flatnonzero(free[np.arange(len(i)), pick])
                if not len(some):
                    break
                p = pick[some]
                out[lo + some, at[some]] = i[some, p]
                at[some] += 1
                # Distances are 1 - similarity: a candidate goes if alpha times its distance to the one kept is no more than to the node.
                free[some] &= self.alpha * (1 - between[some, p]) > 1 - s[some]
                free[some, p] = False
        return out

    def _reverse(self, nodes: np.ndarray, kept: np.ndarray) -> None:
        to, frm = kept.ravel(), np.repeat(nodes, kept.shape[1])
        frm, to = frm[to < self.n], to[to < self.n]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        target, start, count = np.unique(to, return_index=True, return_counts=True)
        fits = self.used[target] + count <= self.room
        nth = np.arange(len(to)) - np.repeat(start, count)
        small = np.repeat(fits, count)
        self.edges[to[small], self.used[to[small]] + nth[small]] = frm[small]
        self.used[target[fits]] += count[fits]
        full = target[~fits]
        if not len(full):
            return
        more = int(count[~fits].max())
        extra = np.full((len(full), more), self.n, np.int32)
        extra[np.repeat(np.arange(len(full)), count[~fits]), nth[~small]] = frm[~small]
        ids = np.hstack([self.edges[full], extra])
        sims = np.einsum("rd,rcd->rc", self.x[full], self.x[ids])
        sims[ids >= self.n] = -2
        order = np.argsort(-sims, axis=1, kind="stable")[:, : self.room + 10]
        kept = self.prune(np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1))
        self.edges[full] = self.n
        self.edges[full, : self.degree] = kept
        self.used[full] = (kept < self.n).sum(1)

    def search(self, queries: np.ndarray, among: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of the first `among` nodes: (ids, similarities) by falling similarity; n and -2 where none."""
        among = self.n if among is None else among
        out = np.full((len(queries), self.beam), self.n, np.int32), np.full((len(queries), self.beam), -2, np.float32)
        for lo in range(0, len(queries), ASKED):
            ids, sims = self._search(queries[lo : lo + ASKED], among)
            out[0][lo : lo + ASKED], out[1][lo : lo + ASKED] = ids, sims
        return out

    def _search(self, q: np.ndarray, among: int) -> tuple[np.ndarray, np.ndarray]:
        b, beam = len(q), self.beam
        ids = np.full((b, beam), self.n, np.int32)
        sims = np.full((b, beam), -2, np.float32)
        start = np.unique(self.entries.integers(0, among, ENTRIES)).astype(np.int32)
        ids[:, : len(start)], sims[:, : len(start)] = start, q @ self.x[start].T
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        stamp = np.full((b, self.n + 1), -1, np.int16)
        stamp[:, start] = 0
        stamp[:, self.n] = 0
        stamps = stamp.ravel()
        done = ids == self.n
        live = np.arange(b)
        result = ids.copy(), sims.copy()
        wide = np.arange(WIDE * self.room, dtype=np.int16) + 1
        for _ in range(4 * beam):
            pick = np.argsort(done, axis=1, kind="stable")[:, :WIDE]
            fresh = ~np.take_along_axis(done, pick, 1)
            going = fresh.any(1)
            if not going.all():
                result[0][live[~going]], result[1][live[~going]] = ids[~going], sims[~going]
                live, ids, sims, done, pick, fresh = live[going], ids[going], sims[going], done[going], pick[going], fresh[going]
                if not len(live):
                    return result
            expand = np.where(fresh, np.take_along_axis(ids, pick, 1), self.n)
            np.put_along_axis(done, pick, True, 1)
            near = self.edges[expand].reshape(len(live), -1)
            places = (live * (self.n + 1))[:, None] + near
            at = np.flatnonzero(stamps.take(places) < 0)
            place, mark = places.ravel().take(at), wide.take(at % near.shape[1])
            stamps[place] = mark
            first = stamps.take(place) == mark
            at = at[first]
            how = np.full(near.shape, -2, np.float32)
            how.ravel()[at] = np.einsum("id,id->i", q.take(live.take(at // near.shape[1]), 0), self.x.take(near.ravel().take(at), 0))
            every = np.hstack([sims, how])
            top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(every, top, 1), axis=1), 1)
            sims = np.take_along_axis(every, top, 1)
            ids = np.take_along_axis(np.hstack([ids, near]), top, 1)
            done = np.take_along_axis(np.hstack([done, np.zeros(near.shape, bool)]), top, 1)
            ids[sims <= -2], done[sims <= -2] = self.n, True
        result[0][live], result[1][live] = ids, sims
        return result


def best_of(nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int, least: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, neighbour, similarity) of both directions of the proposals, the k best of every node at or above least."""
    rows = np.repeat(nodes, ids.shape[1])
    ids, sims = ids.ravel(), sims.ravel()
    ok = (ids < n) & (sims >= least) & (ids != rows)
    rows, ids, sims = rows[ok], ids[ok], sims[ok]
    return _top(np.concatenate([rows, ids]), np.concatenate([ids, rows]), np.concatenate([sims, sims]), k)


def _top(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar b of every a, each once."""
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    if not len(a):
        return a, b, s
    same = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
    a, b, s = a[~same], b[~same], s[~same]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    nth = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    return a[nth < k], b[nth < k], s[nth < k]


def _shard(k: int, least: float, dim: int) -> Callable[[pa.Table], pa.Table]:
    """A function that gives a row per vector of a shard and the k neighbours found for it there."""

    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        x = unpacked(b"".join(table.column("v").to_pylist()), dim)
        keys = table.column("id").to_numpy()
        mine, asked = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        n, got = len(mine), []

        def note(nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
            got.append(best_of(nodes, ids, sims, 2 * k, least, n))

        graph = Graph(x[mine])
        if n:
            graph.build(note, least, bool(len(asked)))
        if n and len(asked):
            # Numbered after the shard's own vectors.
            ids, sims = graph.search(x[asked])
            r, c = np.nonzero((ids < n) & (sims >= least) & (np.arange(ids.shape[1]) < 2 * k))
            a, b, s = (r + n).astype(np.int64), ids[r, c].astype(np.int64), sims[r, c]
            found = (np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s]))
            got = [*got, found] if table.column("chunk")[0].as_py() == 0 else [found]
        elif n and table.column("chunk")[0].as_py():
            got = []
        a, b, s = (np.concatenate([g[i] for g in got]) for i in range(3)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        a, b, s = _top(a, b, s, k)
        names = keys[np.concatenate([mine, asked])]
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        ends = pa.array(np.r_[start, len(a)].astype(np.int32))
        return pa.Table.from_arrays([pa.array(names[a[start]], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(names[b], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(s.astype(np.float32)))], ["a", "b", "similarity"])

    return run


def centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means on a bounded sample; of less than half the rounds where a centroid stands for a few rows of it only."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    step = _rows_at_once(len(c))
    for _ in range(rounds if 16 * len(c) <= len(sample) else rounds * 3 // 8):
        at = np.concatenate([(sample[i : i + step] @ c.T).argmax(1) for i in range(0, len(sample), step)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-6, sums / np.maximum(norms, 1e-9), c)
    return c.astype(np.float32)


def shifts(rest: np.ndarray, many: int, rounds: int = 6, seed: int = 13) -> np.ndarray:
    """Centroids of what vectors differ from their first-level centroid by: one table for all cells, so cells times shifts grow with the table while the sample stays bounded."""
    rng = np.random.default_rng(seed)
    c = rest[rng.choice(len(rest), min(many, len(rest)), replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([((rest[i : i + 4096] @ c.T) - (c**2).sum(1) / 2).argmax(1) for i in range(0, len(rest), 4096)])
        sums, count = np.zeros_like(c), np.bincount(at, minlength=len(c))
        np.add.at(sums, at, rest)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c.astype(np.float32)


def unit_vectors(batch: pa.RecordBatch, dim: int) -> tuple[pa.Array, np.ndarray]:
    """(ids, vectors at length one) of the valid rows of a batch (id, vector)."""
    lists = batch.column(1)
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False).to_numpy(zero_copy_only=False))
    lists = lists.take(pa.array(right))
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    # Rounded, so that equal directions of different norm are equal bytes.
    x = np.round(x[good] / norm[good, None], 6).astype(np.float32) + np.float32(0)
    return batch.column(0).take(pa.array(right[good])), x


def packed(x: np.ndarray) -> np.ndarray:
    """Unit vectors rounded to six places as three bytes a number."""
    whole = np.rint(x.astype(np.float64) * 1e6).astype("<i4")
    return np.ascontiguousarray(whole[:, :, None].view(np.uint8)[:, :, :3]).reshape(len(x), 3 * x.shape[1])


def unpacked(data: bytes, dim: int) -> np.ndarray:
    three = np.frombuffer(data, np.uint8).reshape(-1, dim, 3)
    four = np.zeros((*three.shape[:2], 4), np.uint8)
    four[:, :, 1:] = three
    return ((four.view("<i4")[:, :, 0] >> 8) / 1e6).astype(np.float32)


def _rows_at_once(many: int) -> int:
    """Rows whose similarities to so many centroids are held at once: 16 MB of them."""
    return max(32, min(4096, (4 << 20) // many))


def _nearest_cells(sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the OVERLAP nearest of many centroids, their similarities): of those within MARGIN, which are few; -9 where there is none."""
    row, cell = np.divmod(np.flatnonzero(sims >= sims.max(1, keepdims=True) - MARGIN), sims.shape[1])
    how = sims[row, cell]
    order = np.lexsort((-how, row))
    row, cell, how = row[order], cell[order], how[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    ok = nth < OVERLAP
    top, best = np.zeros((len(sims), OVERLAP), np.int64), np.full((len(sims), OVERLAP), -9, np.float32)
    top[row[ok], nth[ok]], best[row[ok], nth[ok]] = cell[ok], how[ok]
    return top, best


def _cells(x: np.ndarray, middle: np.ndarray, fine: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(cells, whether they are near enough) of unit vectors: the OVERLAP nearest centroids of the first level, or with a second level the nearest pairs of one of those and a shift from it."""
    sims = x @ middle.T
    if fine is None:
        top, how = _nearest_cells(sims)
    else:
        m = min(OVERLAP, sims.shape[1])
        top = np.argpartition(-sims, m - 1, axis=1)[:, :m].astype(np.int64)
        how = np.take_along_axis(sims, top, 1)
        lengths = (middle**2).sum(1)[:, None] + 2 * middle @ fine.T + (fine**2).sum(1)[None, :]
        # Similarity less half the square of the centroid's length: the nearest centroid has the most of it.
        pair = how[:, :, None] + (x @ fine.T)[:, None, :] - lengths[top] / 2
        flat = pair.reshape(len(x), -1)
        best = np.argpartition(-flat, min(OVERLAP, flat.shape[1]) - 1, axis=1)[:, : min(OVERLAP, flat.shape[1])]
        how = np.take_along_axis(flat, best, 1)
        top = np.take_along_axis(top, best // len(fine), 1) * len(fine) + best % len(fine)
    return top.astype(np.int32), how >= how.max(1, keepdims=True, initial=-9) - MARGIN


def _placed(df: DataFrame, dim: int, middle: np.ndarray, fine: np.ndarray | None = None) -> DataFrame:
    """(id, v, cells): the unit vector, as bytes, and the cells of every valid row. One Arrow pass."""

    rows = min(1024, _rows_at_once(len(middle)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), rows):
                ids, x = unit_vectors(whole.slice(lo, rows), dim)
                top, near = _cells(x, middle, fine)
                ends = np.r_[0, np.cumsum(near.sum(1))].astype(np.int32)
                at = (np.arange(len(x) + 1) * 3 * dim).astype(np.int32)
                v = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(packed(x))])
                yield pa.RecordBatch.from_arrays([ids, v, pa.ListArray.from_arrays(pa.array(ends), pa.array(top[near]))], ["id", "v", "cells"])

    return df.mapInArrow(run, "id string, v binary, cells array<int>")


def nearest(df: DataFrame, k: int, least: float = -1.0, key: str = "id", vector: str = "embedding", dim: int = DIM, shard: int = SHARD, most_cells: int | None = None) -> DataFrame:
    """(a, b, similarity, rank): for each row a the k most similar rows b with at least the given similarity."""
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("e"))
    total = rows.count()
    wanted = max(1, math.ceil(COPIES * total / (0.75 * shard)))
    cells = min(most_cells or CELLS, wanted)
    middle, fine = np.zeros((1, dim), np.float32), None
    if cells > 1:
        share = max(1, total // SAMPLE)
        drawn = rows.filter((F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(share)) == 0) & F.col("e").isNotNull()).limit(2 * SAMPLE).toArrow().combine_chunks()
        sample = [unit_vectors(b, dim)[1] for b in drawn.to_batches()]
        if sample and sum(map(len, sample)):
            sample = np.concatenate(sample)
            middle = centroids(sample, cells)
            if wanted > 1.5 * cells:
                step = _rows_at_once(len(middle))
                at = np.concatenate([(sample[i : i + step] @ middle.T).argmax(1) for i in range(0, len(sample), step)])
                fine = shifts(sample - middle[at], min(FINE, math.ceil(wanted / cells)))
    placed = cut(_placed(rows, dim, middle, fine).withColumns({"h": F.xxhash64("v"), "n": F.monotonically_increasing_id()}))
    # Equal vectors are one node, that of the smallest id; only the hashes of vectors that occur twice are looked up.
    twice = cut(placed.groupBy("h").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "node"))
    copied = twice.limit(1).count() > 0
    nodes = placed.join(broadcast_if_small(twice), "h", "left").filter("node is null or node = id").drop("node") if copied else placed
    own = nodes.select(F.col("n").alias("id"), "v", F.explode("cells").alias("cell"))
    # One row per cell, at most CELLS times FINE.
    parts = {r["cell"]: math.ceil(r["count"] / shard) for r in placed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}
    many = {c: p for c, p in parts.items() if p > 1}
    role, chunk = F.lit(0).alias("role"), F.lit(0).alias("chunk")
    if many:
        of_cell = F.try_element_at(F.create_map(*(F.lit(x) for cp in many.items() for x in cp)), F.col("cell"))
        own = own.withColumn("_p", F.coalesce(of_cell, F.lit(1))).withColumn("sub", F.pmod(F.xxhash64("id", F.lit("shard")), F.col("_p")).cast("int"))
        hot = own.filter("_p > 1").withColumn("_c", F.ceil(F.col("_p") / 4).cast("int"))  # the rows of four shards search a shard in one task
        copies = hot.filter("_c > 1").select("id", "v", "cell", "sub", role, F.explode(F.sequence(F.lit(1), F.col("_c") - 1)).alias("chunk"))
        asked = hot.select("id", "v", "cell", F.col("sub").alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("sub"), F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("_c")).cast("int").alias("chunk")).filter("sub <> _own")
        spread = own.select("id", "v", "cell", "sub", role, chunk).unionByName(copies).unionByName(asked.select("id", "v", "cell", "sub", F.lit(1).alias("role"), "chunk"))
    else:
        spread = own.select("id", "v", "cell", F.lit(0).alias("sub"), role, chunk)
    tasks = max(1, min(4096, sum(parts.values())))
    lists = spread.repartition(tasks, "cell", "sub", "chunk").groupBy("cell", "sub", "chunk").applyInArrow(_shard(k, least, dim), "a long, b array<long>, similarity array<float>")
    # A vector's lists of its cells and shards travel as numbers, once; only the k best of them get their ids back.
    pairs = lists.repartition(shuffle_width(df.sparkSession), "a").select("a", F.explode(F.arrays_zip("b", "similarity")).alias("x")).select("a", "x.b", "x.similarity")
    best = _ranked(pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), k).drop("rank")
    name = lambda c: placed.select(F.col("n").alias(c), F.col("id").alias("_" + c))
    ranked = _ranked(best.join(name("b"), "b").join(name("a"), "a").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "similarity"), k)
    return _with_copies(ranked, placed, twice, k, least) if copied else ranked


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("a", "b", "similarity", "rank")


def _with_copies(ranked: DataFrame, placed: DataFrame, twice: DataFrame, k: int, least: float) -> DataFrame:
    """The k best of every row when equal vectors are nodes: a row's copies come first, then its node's neighbours and their copies.

    Of a node's copies only the first k + 1 can be among anyone's k best.
    """
    copies = cut(placed.select("id", "h").join(broadcast_if_small(twice), "h").select("id", "node"))
    first = copies.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("_r") <= k + 1).select("node", F.col("id").alias("b"))
    same = copies.join(first, "node").filter("id <> b").select(F.col("id").alias("a"), "b", F.lit(1.0).cast("float").alias("similarity"))
    wide = ranked.join(first.select(F.col("node").alias("b"), F.col("b").alias("_b")), "b", "left").select("a", F.coalesce("_b", "b").alias("b"), "similarity")
    full = wide.join(copies.select(F.col("node").alias("a"), F.col("id").alias("_a")), "a", "left").select(F.coalesce("_a", "a").alias("a"), "b", "similarity")
    return _ranked(full.unionByName(same).filter(F.col("similarity") >= least), k)


def similar_pairs(df: DataFrame, k: int = 5, least: float = 0.9, **options) -> DataFrame:
    """(record_a, record_b): pairs of at least the similarity of which one is among the k most similar of the other."""
    found = nearest(df, k, least, **options)
    return found.select(F.least("a", "b").alias("record_a"), F.greatest("a", "b").alias("record_b")).distinct()
