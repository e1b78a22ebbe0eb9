"""Most similar vectors for every vector (problem 7).

Vectors are scaled to unit length and projected on a few random directions. The directions are Gaussian, made orthonormal and
scaled back, so that the squared projected distance over the squared distance is close to a chi-square variable with as many
degrees of freedom. Centres fitted on a bounded sample cut the collection into groups of similar vectors, and planes over the
centres gather whole groups into cells, so that a row and its neighbours mostly share one. Each cell holds its own kd-tree of
small leaves. A query takes leaves by projected distance and verifies their vectors until the chi-square test says that a better
neighbour further out is improbable. Queries first search their own cell; those that may have better neighbours beyond the plane
between their centre and another one are sent on to that one's cell with the distance reached so far, in rounds of about twice as
many sendings as there are rows. In a round a cell's data is sent once, and again only for each further ``4 * cell_rows``
queries that other cells send it.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.llm.common import hot_join
from sedgewren.session import small, written

LEAF = 192


def chi_square_quantile(p: float, m: int) -> float:
    """Wilson and Hilferty's approximation of the chi-square quantile."""
    from statistics import NormalDist

    return m * (1 - 2 / (9 * m) + NormalDist().inv_cdf(p) * (2 / (9 * m)) ** 0.5) ** 3


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    """(dim, m) orthonormal Gaussian directions, scaled so that squared lengths are those of m unscaled Gaussian ones."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, m)))
    return (q * np.sqrt(dim)).astype(np.float32)


class Cells:
    """Upper levels of the kd-tree: planes by median of the widest direction of a sample, and each cell's box."""

    def __init__(self, sample: np.ndarray, depth: int):
        m = sample.shape[1]
        self.axis, self.cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1, np.float32)
        self.depth = depth
        self.low, self.high = np.full((1 << depth, m), -np.inf, np.float32), np.full((1 << depth, m), np.inf, np.float32)
        self._split(sample, 0, 0, np.full(m, -np.inf, np.float32), np.full(m, np.inf, np.float32))

    def _split(self, x: np.ndarray, node: int, level: int, low: np.ndarray, high: np.ndarray) -> None:
        if level == self.depth:
            k = node - ((1 << self.depth) - 1)
            self.low[k], self.high[k] = low, high
            return
        a = int(np.argmax(np.percentile(x, 95, axis=0) - np.percentile(x, 5, axis=0))) if len(x) else level % x.shape[1]
        c = float(np.median(x[:, a])) if len(x) else 0.0
        self.axis[node], self.cut[node] = a, c
        less, more = high.copy(), low.copy()
        less[a], more[a] = c, c
        self._split(x[x[:, a] < c], 2 * node + 1, level + 1, low, less)
        self._split(x[x[:, a] >= c], 2 * node + 2, level + 1, more, high)

    def of(self, z: np.ndarray) -> np.ndarray:
        node = np.zeros(len(z), np.int64)
        for _ in range(self.depth):
            right = z[np.arange(len(z)), self.axis[node]] >= self.cut[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)

    def near(self, z: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of every cell whose box lies within a query's squared projected distance ``reach``.

        Queries go down the tree together; a branch takes only those that it may concern.
        """
        out_q, out_c = [], []
        open_ = [(0, 0, np.arange(len(z)), np.zeros(z.shape, np.float32), np.zeros(len(z), np.float32))]
        while open_:
            node, level, q, off, total = open_.pop()
            if not len(q):
                continue
            if level == self.depth:
                out_q.append(q)
                out_c.append(np.full(len(q), node - ((1 << self.depth) - 1)))
                continue
            a = self.axis[node]
            gap = z[q, a] - self.cut[node]
            for child, beyond in ((2 * node + 1, gap >= 0), (2 * node + 2, gap < 0)):
                # on the other side of the plane the distance along its direction is that to the plane
                side = np.where(beyond, gap * gap, off[:, a])
                far = total - off[:, a] + side
                ok = far <= reach[q]
                held = off[ok]
                held[:, a] = side[ok]
                open_.append((child, level + 1, q[ok], held, far[ok]))
        return (np.concatenate(out_q), np.concatenate(out_c)) if out_q else (np.empty(0, np.int64), np.empty(0, np.int64))


class Regions:
    """Centres of groups of similar vectors, fitted on a sample, and the cell that holds each group."""

    def __init__(self, sample: np.ndarray, depth: int, project: np.ndarray, per_cell: int = 16, rounds: int = 6):
        levels = max(0, min(int(np.log2(max(1, per_cell << depth))), int(np.log2(max(1, len(sample) // 4)))))
        group = Cells(sample @ project, levels).of(sample @ project)
        self.centres = np.zeros((0, sample.shape[1]), np.float32)
        for _ in range(rounds):
            total = np.zeros((group.max() + 1, sample.shape[1]), np.float64)
            np.add.at(total, group, sample)
            length = np.sqrt((total**2).sum(1))
            self.centres = (total[length > 0] / length[length > 0, None]).astype(np.float32)
            group = self.group(sample)
        # planes between centres, each counting as often as it has sampled rows
        z = self.centres @ project
        self.cell = Cells(z[group], depth).of(z)

    def group(self, x: np.ndarray) -> np.ndarray:
        step = max(1, 4_000_000 // len(self.centres))
        return np.concatenate([np.argmax(x[lo : lo + step] @ self.centres.T, axis=1) for lo in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.cell[self.group(x)]

    def near(self, x: np.ndarray, reach: np.ndarray, deviations: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of every other cell that may hold rows within a query's distance ``reach``.

        The part along one direction of a displacement of length ``reach`` deviates by ``reach / sqrt(dim)``; beyond
        ``deviations`` of them to the plane between two centres a row is improbable.
        """
        order = np.argsort(self.cell, kind="stable")
        cells, first = np.unique(self.cell[order], return_index=True)
        group, out_q, out_c = self.group(x), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for g in np.unique(group):
            apart = np.sqrt(np.maximum(2 - 2 * self.centres @ self.centres[g], 1e-12))
            who, step = np.flatnonzero(group == g), max(1, 4_000_000 // len(apart))
            for lo in range(0, len(who), step):
                q = who[lo : lo + step]
                s = x[q] @ self.centres.T
                gap = (s[:, g, None] - s) / apart
                open_ = np.minimum.reduceat(gap[:, order], first, axis=1) <= (deviations / np.sqrt(x.shape[1])) * reach[q, None]
                open_[:, cells == self.cell[g]] = False
                line, c = np.nonzero(open_)
                out_q.append(q[line])
                out_c.append(cells[c])
        return np.concatenate(out_q), np.concatenate(out_c)


def box_distances(z: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(z), len(low)), np.float32)
    for a in range(z.shape[1]):
        gap = np.maximum(low[None, :, a] - z[:, None, a], z[:, None, a] - high[None, :, a])
        np.maximum(gap, 0, out=gap)
        out += gap * gap
    return out


class Tree:
    """A cell's kd-tree, flat: rows in leaf order, leaf bounds and tight boxes."""

    def __init__(self, x: np.ndarray, z: np.ndarray):
        parts, order = [np.arange(len(x))], []
        while parts:
            at = parts.pop()
            if len(at) <= LEAF:
                order.append(at)
                continue
            a = int(np.argmax(z[at].max(0) - z[at].min(0)))
            mid = len(at) // 2
            split = np.argpartition(z[at, a], mid)
            parts += [at[split[mid:]], at[split[:mid]]]
        self.rows = np.concatenate(order) if order else np.empty(0, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum([len(o) for o in order])]).astype(np.int64)
        self.x = x[self.rows]
        self.low = np.stack([z[o].min(0) for o in order])
        self.high = np.stack([z[o].max(0) for o in order])

    def search(self, q: np.ndarray, zq: np.ndarray, own: np.ndarray, k: int, quantile: float, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best ``k`` rows of each query and their similarities (-2 where there are fewer).

        ``own`` is the row that a query is itself, or -1. ``start`` is the similarity to beat. Leaves are taken several at a time
        by projected distance; a group of queries leaves out those whose distance over the k-th distance exceeds the quantile for all.
        """
        rows, sims = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -2.0, np.float32)
        sims_floor = start.astype(np.float32)
        # queries near to each other share leaves: they are taken in groups
        for at in _groups(zq):
            self._group(q, zq, own, k, quantile, sims_floor, at, rows, sims)
        return rows, sims

    def _group(self, q, zq, own, k, quantile, floor, at, rows, sims) -> None:
        near = box_distances(zq[at], self.low, self.high)
        ahead = np.argsort(near.min(axis=0), kind="stable")
        qa, mine = q[at], own[at]
        best_r, best_s = rows[at], sims[at]
        kth, several = np.maximum(best_s[:, -1], floor[at]), 8
        while True:
            # squared distance of unit vectors; the test of the projected against the k-th distance reached
            ahead = ahead[(near[:, ahead] <= quantile * np.maximum(2 - 2 * kth, 1e-6)[:, None]).any(axis=0)]
            if not len(ahead):
                break
            now, ahead, several = np.sort(ahead[:several]), ahead[several:], 16
            place = np.concatenate([np.arange(self.bounds[x], self.bounds[x + 1]) for x in now])
            s = qa @ self.x[place].T
            col = np.minimum(np.searchsorted(place, mine), len(place) - 1)
            inside = np.flatnonzero(place[col] == mine)
            s[inside, col[inside]] = -3
            better = s > kth[:, None]
            w = np.flatnonzero(better.any(axis=1))
            if not len(w):
                continue
            if np.count_nonzero(better) > better.size // 16 and len(place) > k:
                top = np.argpartition(s[w], -k, axis=1)[:, -k:]
                part = np.take_along_axis(s[w], top, 1)
            else:
                line, c = np.nonzero(better[w])
                v = s[w[line], c]
                by = np.lexsort((-v, line))
                line, c, v = line[by], c[by], v[by]
                n = np.arange(len(line)) - np.searchsorted(line, line)
                line, c, v, n = (x[n < k] for x in (line, c, v, n))
                top, part = np.zeros((len(w), k), np.int64), np.full((len(w), k), -3.0, np.float32)
                top[line, n], part[line, n] = c, v
            all_s = np.concatenate([best_s[w], part], axis=1)
            all_r = np.concatenate([best_r[w], place[top]], axis=1)
            pick = np.argsort(-all_s, axis=1, kind="stable")[:, :k]
            best_s[w], best_r[w] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_r, pick, 1)
            kth[w] = np.maximum(best_s[w, -1], floor[at[w]])
        rows[at], sims[at] = best_r, best_s


def _groups(z: np.ndarray, size: int = 256):
    """Cut queries into groups that lie together."""
    parts = [np.arange(len(z))]
    while parts:
        at = parts.pop()
        if len(at) <= size:
            if len(at):
                yield at
            continue
        a = int(np.argmax(z[at].max(0) - z[at].min(0)))
        mid = len(at) // 2
        split = np.argpartition(z[at, a], mid)
        parts += [at[split[:mid]], at[split[mid:]]]


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are usable (right length, no NULL, finite, not all zero) and their unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(sizes == dim)
    x = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) if len(right) else np.zeros((0, dim), np.float32)
    length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    ok = np.isfinite(length) & (length > 0)
    return right[ok], (x[ok] / length[ok, None]).astype(np.float32)


def nearest(
    rows: DataFrame,
    k: int = 5,
    id_col: str = "id",
    vector_col: str = "dense_vector",
    dim: int = 64,
    m: int = 16,
    confidence: float = 0.1,
    cell_rows: int = 32768,
    sample_per_cell: int = 256,
    most_sample: int = 2_000_000,
    seed: int = 7,
    deviations: float = 2.25,
) -> DataFrame:
    """(id, neighbour, similarity, rank): for each row with a usable vector its ``k`` most similar other rows.

    Rows with a NULL, all-zero, non-finite or wrongly sized vector are left out. Copies of one vector are searched once; equal
    similarities are ranked by id. ``confidence`` is the chi-square stopping probability: a query stops when a better neighbour
    would lie as near in projection only with that probability; ``deviations`` is the same for other cells (``Regions.near``). Centres
    are fitted on about ``sample_per_cell`` vectors for each cell, at most about ``most_sample``; every vector is indexed and
    searched. Fewer than two usable rows give no rows.
    """
    spark = rows.sparkSession
    project = directions(dim, m, seed)
    quantile = chi_square_quantile(confidence, m)
    kind = rows.schema[id_col].dataType.simpleString()

    def usable(batches):
        for b in batches:
            at, x = unit_vectors(b.column(1), dim)
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
            yield pa.record_batch([b.column(0).take(pa.array(at)), blob], names=["id", "v"])

    vectors = rows.select(id_col, vector_col).mapInArrow(usable, f"id {kind}, v binary")
    # classes of equal vectors: the k + 1 smallest ids stand for all members
    member = written(vectors.select("id", F.xxhash64("v").alias("h")))
    classes = member.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    count = member.count()
    if count == 0:
        return spark.createDataFrame([], f"id {kind}, neighbour {kind}, similarity double, rank int")
    depth = max(0, int(np.ceil(np.log2(count / cell_rows))))
    sample = min(most_sample, sample_per_cell << depth)

    regions = None
    if depth:
        some = vectors.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000_000)) < F.lit(int(min(1.0, sample / count) * 1_000_000_000))).select("v")
        picked = np.unique(_floats(some.limit(2 * sample).toArrow()["v"], dim), axis=0)
        if len(picked):
            regions = Regions(picked, depth, project)
        else:
            depth = 0
    shared = spark.sparkContext.broadcast((project, regions))

    def route(batches):
        _, c = shared.value
        for b in batches:
            h, first = np.unique(b.column("h").to_numpy(), return_index=True)  # copies are sent once
            v = b.column("v").take(pa.array(first))
            cell = c.of(_floats(v, dim)) if c else np.zeros(len(h))
            yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(h), v], names=["cell", "h", "v"])

    routed = vectors.select(F.xxhash64("v").alias("h"), "v").mapInArrow(route, "cell int, h long, v binary").repartition(max(1, 1 << depth), "cell")
    placed = written(routed.groupBy("cell", "h").agg(F.first("v").alias("v")))
    hit = "h long, other long, s float"

    def home(t: pa.Table) -> pa.Table:
        proj, c = shared.value
        x = _floats(t["v"], dim)
        z = x @ proj
        tree, h = Tree(x, z), t["h"].to_numpy()
        place = np.empty(len(x), np.int64)
        place[tree.rows] = np.arange(len(x))
        found, s = tree.search(x, z, place, k, quantile, np.full(len(x), -2.0))
        ours = h[tree.rows]
        ok = s > -1.5
        line = np.nonzero(ok)[0]
        hits = (h[line], ours[found[ok]], s[ok])
        # one row for each query that other cells may answer, with the similarity reached
        q, to = c.near(x, np.sqrt(np.maximum(2 - 2 * s[:, -1], 1e-6)), deviations) if c else (np.empty(0, np.int64),) * 2
        by = np.argsort(q, kind="stable")
        q, start = np.unique(q[by], return_index=True)
        ends = pa.array([None] * len(line) + np.concatenate([start, [len(to)]]).astype(np.int32).tolist(), pa.int32())
        return pa.table(
            {
                "h": pa.array(np.concatenate([hits[0], h[q]])),
                "other": pa.array(np.concatenate([hits[1], np.zeros(len(q), np.int64)])),
                "s": pa.array(np.concatenate([hits[2], s[q, -1]]).astype(np.float32)),
                "cells": pa.ListArray.from_arrays(ends, pa.array(to[by].astype(np.int32))),
                "v": pa.concat_arrays([pa.nulls(len(line), pa.binary()), t["v"].combine_chunks().take(pa.array(q))]),
            }
        )

    first = written(placed.groupBy("cell").applyInArrow(home, hit + ", cells array<int>, v binary"))

    def visit(_key, data: pa.Table, asked: pa.Table) -> pa.Table:
        proj, _ = shared.value
        if not data.num_rows or not asked.num_rows:
            return pa.table({"h": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "s": pa.array([], pa.float32())})
        x, q = _floats(data["v"], dim), _floats(asked["v"], dim)
        tree = Tree(x, x @ proj)
        found, s = tree.search(q, q @ proj, np.full(len(q), -1), k, quantile, asked["s"].to_numpy())
        ok = s > -1.5
        return pa.table({"h": asked["h"].to_numpy()[np.nonzero(ok)[0]], "other": data["h"].to_numpy()[tree.rows][found[ok]], "s": s[ok]})

    hits = first.where("cells IS NULL").select("h", "other", "s")
    sent = first.where("cells IS NOT NULL")
    rounds = -(-(sent.agg(F.sum(F.size("cells")).alias("n")).first()["n"] or 0) // (2 * count))
    for n in range(rounds):
        # no task gets more than a bounded part of a cell's queries; a cell is sent once for each part
        asked = sent.select("h", "s", "v", F.explode("cells").alias("cell")).where(F.col("cell") % rounds == n)
        parts = written(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (4 * cell_rows)).cast("int").alias("parts")))
        parts = small(parts)
        asked = asked.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("h"), "parts").cast("int"))
        data = placed.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        found = written(data.select("cell", "part", "h", "v").groupBy("cell", "part").cogroup(asked.select("cell", "part", "h", "v", "s").groupBy("cell", "part")).applyInArrow(visit, hit))
        hits = hits.unionByName(found)
        if rounds > 1:  # a round's shuffle is deleted when the driver collects its garbage
            del asked, parts, data
            gc.collect()
            spark.sparkContext._jvm.System.gc()
    by_class = Window.partitionBy("h").orderBy(F.desc("s"), "other")
    best = hits.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k).select("h", "other", "s")
    few = member.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("place") <= k + 1).select("h", "id")
    around = best.join(few.select(F.col("h").alias("other"), F.col("id").alias("n")), "other").select("h", "n", F.col("s").cast("double").alias("s"))
    same = few.join(classes.where("c > 1").select("h"), "h").select("h", F.col("id").alias("n"), F.lit(1.0).alias("s"))
    lists = around.unionByName(same).withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("s"), "n"))).where(F.col("r") <= 2 * k + 1)
    # one list for each class, in order; a member takes the first k that are not itself
    near = lists.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("r", "n", "s"))).alias("near")).join(classes, "h")
    own = hot_join(member, written(near), ["h"], "c")
    ranked = own.select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["n"] != F.col("id")), 1, k)).alias("p", "x"))
    return ranked.select("id", F.col("x.n").alias("neighbour"), F.col("x.s").alias("similarity"), (F.col("p") + 1).alias("rank"))


def _floats(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, dim), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)
