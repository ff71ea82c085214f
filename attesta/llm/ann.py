"""Approximate nearest neighbours by balanced posting lists.

Vectors are grouped by centroids that are refined over all of them; a list much longer than the
average is split. A vector near a boundary is posted to several lists. The centroids, about a square
root of the vectors, are searched by walks over an in-memory neighbour graph that go on until no open
centroid is within the distance ratio; a query visits every list within that ratio of the nearest one.

Neighbouring lists form regions of bounded size. A query travels once to each region that it visits,
with a bit for each list there, streams past the region's members, and leaves with its best few.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import checkpointed, hash_sample, mix64, quoted

NEIGHBOURS = 10
#: Lists a square root of the vectors.
LISTS = 1.0
#: A list longer than this many times the average is split.
LONGEST = 2.0
#: A vector is posted to lists, and a query visits lists, up to so many times the nearest centroid's distance.
POST_RATIO, VISIT_RATIO = 1.01, 1.2
#: A query visits lists that hold this many times the neighbours asked for, whatever the ratio.
ENOUGH = 8
ROUNDS = 2
#: Links of a centroid, and the nearest centroids that a walk goes through at least.
DEGREE, BEAM = 24, 16
#: Ratio up to which the search for the nearest centroid alone looks around.
NEAR_RATIO = 1.05
SEED = 1
#: Bytes of vectors in a region, about; a longer list is cut into several.
REGION_BYTES = 4 << 20
#: Members that one step of a scan compares with a block of queries, and the rows of that block.
SCAN, BLOCK = 8192, 512


class Graph:
    """Centroids with links both ways to near ones (pruned to differ in direction) and entry points."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.c = c = np.ascontiguousarray(centroids, np.float32)
        self.norm = (c**2).sum(axis=1)
        n = len(c)
        most = min(n - 1, 2 * degree)
        ahead = np.full((n, degree), -1, np.int64)
        for lo in range(0, n if most else 0, 512):
            d = self.norm[lo : lo + 512, None] + self.norm[None] - 2 * c[lo : lo + 512] @ c.T
            at = np.arange(len(d))
            d[at, lo + at] = np.inf
            near = np.argpartition(d, most - 1, axis=1)[:, :most]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
            d = np.take_along_axis(d, near, 1)
            between = self.norm[near][:, :, None] + self.norm[near][:, None] - 2 * c[near] @ c[near].transpose(0, 2, 1)
            taken = np.zeros(d.shape, bool)
            for j in range(most):  # in order of distance; one that a taken one is nearer to waits
                taken[:, j] = ~((between[:, j] <= d[:, j, None]) & taken).any(axis=1)
            own = np.argsort(~taken, axis=1, kind="stable")[:, :degree]
            ahead[lo : lo + 512, : own.shape[1]] = np.take_along_axis(near, own, 1)
        a, b = np.repeat(np.arange(n), degree), ahead.ravel()
        a, b = a[b >= 0], b[b >= 0]
        pair = np.unique(np.concatenate([a * n + b, b * n + a]))
        self.first = np.searchsorted(pair, np.arange(n + 1) * n)
        self.links = pair % n
        part = np.arange(n)  # least centroid of each connected part
        while len(pair):
            low = part.copy()
            np.minimum.at(low, pair // n, part[pair % n])
            low = low[low]
            if (low == part).all():
                break
            part = low
        step = max(1, math.isqrt(n))
        self.entries = np.union1d(np.arange(0, n, step), np.unique(part))

    def around(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in nodes, linked node) of every link."""
        size = self.first[nodes + 1] - self.first[nodes]
        i = np.repeat(np.arange(len(nodes)), size)
        return i, self.links[self.first[nodes][i] + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)]

    def _walk(self, q: np.ndarray, entry: int, ratio: float, held: np.ndarray | None, least: float):
        """Nodes, squared distances and which of them each query reached. Queries that start at one entry walk side by
        side, each along its own links: it goes through every node within the ratio, and the nearest ``BEAM``."""
        n, qn = len(self.c), (q**2).sum(axis=1)
        place = np.full(n, -1, np.int64)
        nodes = np.array([entry])
        place[entry] = 0
        far = lambda x: np.maximum(0, self.norm[x][None] + qn[:, None] - 2 * q @ self.c[x].T)
        d, reached, gone = far(nodes), np.ones((len(q), 1), bool), np.zeros((len(q), 1), bool)
        wide = np.zeros(len(q), bool)
        while True:
            own = np.where(reached, d, np.inf)
            bound = own.min(axis=1) * ratio**2
            if len(nodes) > BEAM:
                bound = np.maximum(bound, np.partition(own, BEAM - 1, axis=1)[:, BEAM - 1])
            else:
                bound[:] = np.inf
            bound[wide] = np.inf
            open_ = reached & ~gone & (d <= bound[:, None])
            at = np.flatnonzero(open_.any(axis=0))
            if len(at):
                i, to = self.around(nodes[at])
            else:
                short = ~wide & (reached @ held[nodes] < least) & (reached.sum(axis=1) < n) if held is not None else wide[:0]
                if not short.any():
                    return nodes, own
                wide |= short
                i, to = np.empty(0, np.int64), self.entries
            new = np.unique(to[place[to] < 0])
            if len(new):
                place[new] = len(nodes) + np.arange(len(new))
                nodes = np.concatenate([nodes, new])
                d = np.hstack([d, far(new)])
                reached, gone = (np.hstack([x, np.zeros((len(q), len(new)), bool)]) for x in (reached, gone))
            if len(at):
                step = np.zeros((len(at), len(nodes)), np.float32)
                step[i, place[to]] = 1
                reached |= open_[:, at].astype(np.float32) @ step > 0
                gone[:, : open_.shape[1]] |= open_
            else:
                reached[np.ix_(wide, place[to])] = True

    def _groups(self, q: np.ndarray):
        """(rows, entry): the rows whose nearest entry that is, in bounded blocks."""
        e = self.entries
        start = (self.norm[e][None] - 2 * q @ self.c[e].T).argmin(axis=1)
        most = max(64, 20_000_000 // len(self.c))
        for j in np.unique(start):
            rows = np.flatnonzero(start == j)
            for lo in range(0, len(rows), most):
                yield rows[lo : lo + most], int(e[j])

    def nearest(self, q: np.ndarray, ratio: float = NEAR_RATIO) -> np.ndarray:
        """The nearest centroid of each row."""
        out = np.zeros(len(q), np.int64)
        for rows, entry in self._groups(q):
            nodes, d = self._walk(q[rows], entry, ratio, None, 0)
            out[rows] = nodes[d.argmin(axis=1)]
        return out

    def within(self, q: np.ndarray, ratio: float, held: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, distance over the row's least) of every centroid within the ratio, and of the next ones
        while the nearer ones hold less than ``least``; sorted by row."""
        found = []
        for rows, entry in self._groups(q):
            nodes, d = self._walk(q[rows], entry, ratio, held.astype(np.float32), least)
            near = np.sqrt(d.min(axis=1))[:, None]
            ok = d <= (near * ratio) ** 2 * (1 + 1e-6) + 1e-30
            for r in np.flatnonzero(ok.astype(np.float32) @ held[nodes] < least):
                order = np.argsort(d[r], kind="stable")
                order = order[np.isfinite(d[r, order])]
                before = np.cumsum(held[nodes[order]]) - held[nodes[order]]
                ok[r, order[before < least]] = True
            r, s = np.nonzero(ok)
            x = np.sqrt(d[r, s])
            far = np.divide(x, near[r, 0], out=np.where(x > 0, np.inf, 1.0), where=near[r, 0] > 0)
            found.append((rows[r], nodes[s], far))
        row, node, far = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.argsort(row, kind="stable")
        return row[order], node[order], far[order]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def _finite(batches):
    """Rows with a key and a vector of finite numbers only."""
    for batch in batches:
        k, v = batch.column(0), batch.column(1)
        size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
        flat = v.flatten()
        x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
        bad = np.concatenate([[0], np.cumsum(~(np.abs(x) < 1e18))])
        end = np.cumsum(size)
        ok = (size > 0) & (bad[end] == bad[end - size]) & k.is_valid().to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(ok))


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int]:
    """(k, v) with v as array<float> of the commonest length, all finite, one row a key; that length; how many rows.

    Vectors are shuffled only where a key repeats, which a narrow count of the keys tells.
    """
    rows = vectors.select(quoted(key).try_cast("long").alias("k"), quoted(vector).cast("array<float>").alias("v")).where("k is not null and v is not null")
    rows = checkpointed(rows.mapInArrow(_finite, "k long, v array<float>"))
    top = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if top is None:
        return rows, 0, 0
    rows = rows.where(F.size("v") == top["w"])
    if rows.groupBy("k").count().where("count > 1").limit(1).count():
        rows = checkpointed(rows.groupBy("k").agg(F.min("v").alias("v")))
        return rows, top["w"], rows.count()
    return rows, top["w"], top["count"]


def _totalled(width: int):
    """Sums by centroid of what tasks have summed."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            i, n, s = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.asarray(batch.column(2).flatten()).reshape(-1, width)
            for j, row in zip(i.tolist(), np.hstack([n[:, None], s])):
                total[j] = total[j] + row if j in total else row
        if total:
            x = np.array(list(total.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(x[:, 0].astype(np.int64)), _lists(x[:, 1:])], names=["i", "n", "s"])

    return run


def centroids(rows: DataFrame, width: int, n: int, lists: float = LISTS, longest: float = LONGEST, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Balanced centroids and how many vectors are nearest to each: seeds by key hash, refined over all vectors; in
    place of a long list's centroid come members of it, by key hash, and all are refined again.

    The driver gets one row a centroid, a vector and a count.
    """
    k = max(1, min(n, int(lists * math.sqrt(n))))
    c = np.array([r["v"] for r in hash_sample(rows, "k", k, SEED, n).collect()], np.float32)

    def moved(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        graph = Graph(c)

        def sums(batches):
            total, count = np.zeros((len(graph.c), width)), np.zeros(len(graph.c), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), width)
                near = graph.nearest(x)
                order = np.argsort(near, kind="stable")
                at = np.flatnonzero(np.diff(near[order], prepend=-1))
                if len(at):
                    total[near[order][at]] += np.add.reduceat(x[order].astype(np.float64), at, axis=0)
                count += np.bincount(near, minlength=len(count))
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), _lists(total[at])], names=["i", "n", "s"])

        schema = "i int, n long, s array<double>"
        merged = rows.select("v").mapInArrow(sums, schema).repartition("i").mapInArrow(_totalled(width), schema).collect()
        merged.sort(key=lambda r: r["i"])
        count = np.array([r["n"] for r in merged], np.int64)
        return (np.array([r["s"] for r in merged]).reshape(-1, width) / count[:, None]).astype(np.float32), count

    for _ in range(max(1, rounds)):
        c, count = moved(c)
    for _ in range(rounds):
        most = max(4.0, longest * n / len(c))
        parts = np.where(count > most, np.ceil(count / (most / 2)), 0)
        if not parts.any():
            break
        graph, share = Graph(c), np.minimum(1.0, 2 * parts / count)

        def members(batches, graph=graph, share=share):
            for batch in batches:
                x, h = _matrix(batch.column(1), width), mix64(batch.column(0).to_numpy().view(np.uint64) + np.uint64(SEED + 2))
                near = graph.nearest(x)
                at = np.flatnonzero((h >> np.uint64(11)).astype(float) * 2.0**-53 < share[near])
                yield pa.RecordBatch.from_arrays([pa.array(near[at].astype(np.int32)), pa.array(h[at].view(np.int64)), _lists(x[at])], names=["i", "h", "v"])

        chosen: dict[int, list] = {}
        for r in sorted(rows.select("k", "v").mapInArrow(members, "i int, h long, v array<float>").collect(), key=lambda r: (r["i"], r["h"] % (1 << 64))):
            own = chosen.setdefault(r["i"], [])
            if len(own) < parts[r["i"]]:
                own.append(r["v"])
        new = np.array([v for own in chosen.values() for v in own], np.float32).reshape(-1, width)
        c, count = moved(np.unique(np.vstack([c[parts == 0], new]), axis=0))
    return c, count


def regions(c: np.ndarray, sizes: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """First region, number of regions, and place in its region, of each list; and how many regions there are.

    Lists are halved by where they lie along the direction that they differ in most, until what a
    part holds is not more than ``most``; a list that holds more alone is spread over several regions.
    """
    first, parts, place = (np.zeros(len(c), np.int64) for _ in range(3))
    parts[:] = 1
    todo, n = [np.arange(len(c))], 0
    while todo:
        own = todo.pop()
        total = sizes[own].sum()
        if len(own) == 1 or total <= most:
            first[own], place[own] = n, np.arange(len(own))
            if len(own) == 1:
                parts[own] = max(1, math.ceil(total / most))
            n += int(parts[own[0]])
            continue
        x = (c[own] - c[own].mean(axis=0)).astype(np.float64)
        axis = x[(x**2).sum(axis=1).argmax()]
        for _ in range(8):
            axis = x.T @ (x @ axis)
            axis /= np.sqrt((axis**2).sum()) or 1.0
        own = own[np.argsort(x @ axis, kind="stable")]
        held = np.cumsum(sizes[own])
        cut = min(len(own) - 1, max(1, int(np.searchsorted(held, held[-1] / 2)) + 1))
        todo += [own[cut:], own[:cut]]
    return first, parts, place, n


class Region:
    """The members of one region, by list, and the scan of queries past them."""

    def __init__(self, slots: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.lexsort((ids, slots))
        self.slots, self.ids, self.x, self.k = slots[order], ids[order], x[order], k
        norm = (self.x**2).sum(axis=1)
        self.norm = norm.max(initial=0)
        self.side = np.hstack([self.x, norm[:, None], np.ones((len(norm), 1), np.float32)])

    def _merged(self, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, pool: tuple, rows: np.ndarray, at: np.ndarray) -> tuple:
        """The pool with the members ``at`` measured, k a row; ``bound`` follows."""
        d = np.empty(len(rows))
        for lo in range(0, len(rows), 16_384):
            s = slice(lo, lo + 16_384)
            d[s] = ((q[rows[s]].astype(np.float64) - self.x[at[s]]) ** 2).sum(axis=1)
        other = ids[rows] != self.ids[at]
        row, d, o = (np.concatenate(z) for z in zip(pool, (rows[other], d[other], self.ids[at][other])))
        order = np.lexsort((o, d, row))
        row, d, o = row[order], d[order], o[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (o[1:] != o[:-1])
        row, d, o = row[new], d[new], o[new]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        bound[row[rank == self.k - 1]] = d[rank == self.k - 1]
        keep = rank < self.k
        return row[keep], d[keep], o[keep]

    def best(self, ids: np.ndarray, q: np.ndarray, visits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, distance, id) of the k nearest members, in the lists that it visits, of each query; ties by id.

        Single precision only rules members out, with a margin; what is left is measured in double.
        """
        qn = (q**2).sum(axis=1)
        side = np.hstack([-2 * q, np.ones((len(q), 1), np.float32), qn[:, None]])
        slack = 4e-6 * (qn + self.norm)
        bound = np.full(len(q), np.inf)
        pool = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        for lo in range(0, len(self.ids), SCAN):
            slots = self.slots[lo : lo + SCAN]
            heads = np.flatnonzero(np.diff(slots, prepend=-1))
            tails = np.append(heads[1:], len(slots))
            asked = np.zeros((len(q), len(heads)), bool)
            known = slots[heads] < visits.shape[1]
            asked[:, known] = visits[:, slots[heads][known]]
            rows = np.flatnonzero(asked.any(axis=1))
            if not len(rows):
                continue
            d = side[rows] @ self.side[lo : lo + SCAN].T
            for j, (a, b) in enumerate(zip(heads, tails)):
                out = np.flatnonzero(~asked[rows, j])
                if len(out):
                    d[out, a:b] = np.inf
            limit = bound[rows]
            fresh = np.flatnonzero(np.isinf(limit))
            if len(fresh):  # the least of each few members: so many of these are under the limit at least
                few = max(1, d.shape[1] // 256)
                whole = d.shape[1] // few * few
                least = d[:, :whole].reshape(len(d), -1, few).min(axis=2)[fresh]
                if least.shape[1] > 2 * self.k:
                    limit[fresh] = np.partition(least, 2 * self.k, axis=1)[:, 2 * self.k]
            limit = np.minimum(limit + slack[rows], 3e38).astype(np.float32)
            near = np.flatnonzero((d <= limit[:, None]).ravel())
            pool = self._merged(ids, q, bound, pool, rows[near // d.shape[1]], lo + near % d.shape[1])
            short = fresh[np.isinf(bound[rows[fresh]]) & (limit[fresh] < 3e38)]
            if len(short):  # itself, or one that stands in several lists, took places
                r, s = np.nonzero(np.isfinite(d[short]))
                pool = self._merged(ids, q, bound, pool, rows[short[r]], lo + s)
        return pool[0], np.sqrt(pool[1]), pool[2]


def nearest(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    lists: float = LISTS,
    post_ratio: float = POST_RATIO,
    visit_ratio: float = VISIT_RATIO,
    region_bytes: int = REGION_BYTES,
) -> DataFrame:
    """(key, neighbour, rank, distance): each vector's k nearest others by Euclidean distance.

    Every vector is a query. Vectors that are null, empty, of another length than most (of lengths
    equally common the greater counts), or that hold nulls, numbers that are not finite or of 1e18
    and more (their squares leave single precision), and rows whose key is null or no whole number,
    are left out; rows that repeat a key are one vector, the least. Equal distances rank by key. A
    table of fewer than k + 1 vectors gives what there is, an empty one an empty one. Other columns
    are not read.

    The ratios are what limits the search, there is no other bound; every table takes the same way.
    """
    rows, width, n = usable(vectors, key, vector)
    other = f"neighbour_{key}"
    if n < 2:
        return rows.sparkSession.createDataFrame([], f"{'`' + key.replace('`', '``') + '`'} long, {'`' + other.replace('`', '``') + '`'} long, rank int, distance double")
    c, sizes = centroids(rows, width, n, lists)
    graph = Graph(c)
    first, parts, place, count = regions(c, sizes, max(1.0, region_bytes / (4 * width)))

    def posted(batches):
        names = ["region", "kind", "k", "v", "slot", "visits"]
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), batch.column(1)
            row, node, far = graph.within(_matrix(v, width), visit_ratio, sizes, ENOUGH * k)
            post = np.flatnonzero(far <= post_ratio)
            r, j = row[post], node[post]
            chunk = (mix64(ids[r].view(np.uint64)) % parts[j].astype(np.uint64)).astype(np.int64)
            at = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array((first[j] + chunk).astype(np.int32)), pa.array(np.zeros(len(r), np.int8)), batch.column(0).take(at), v.take(at), pa.array(place[j].astype(np.int32)), pa.nulls(len(r), pa.binary())], names=names
            )
            for lo in range(0, batch.num_rows, 1000):
                a, b = np.searchsorted(row, [lo, lo + 1000])
                times = parts[node[a:b]]
                r, j = np.repeat(row[a:b], times), np.repeat(node[a:b], times)
                to = first[j] + np.arange(len(j)) - np.repeat(np.cumsum(times) - times, times)
                pair, u = np.unique(r * count + to, return_inverse=True)
                bits = int(place[j].max(initial=0)) // 8 + 1
                flat = np.bincount(u * bits + place[j] // 8, weights=1 << (place[j] % 8), minlength=len(pair) * bits).astype(np.uint8)
                masks = pa.Array.from_buffers(pa.binary(), len(pair), [None, pa.py_buffer((np.arange(len(pair) + 1) * bits).astype(np.int32)), pa.py_buffer(flat)])
                at = pa.array(pair // count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((pair % count).astype(np.int32)), pa.array(np.ones(len(pair), np.int8)), batch.column(0).take(at), v.take(at), pa.array(np.zeros(len(pair), np.int32)), masks], names=names
                )

    def searched(batches):
        """Members of a region come before its queries."""
        now, members, region = -1, [], None
        for batch in batches:
            where, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(where) != 0) | (np.diff(kind) != 0)) + 1, [len(where)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if lo == hi:
                    continue
                if where[lo] != now:
                    now, members, region = int(where[lo]), [], None
                run = batch.slice(lo, hi - lo)
                ids, x = run.column(2).to_numpy(), _matrix(run.column(3), width)
                if not kind[lo]:
                    members.append((run.column(4).to_numpy(), ids, x))
                    continue
                if not members:
                    continue
                if region is None:
                    region = Region(*(np.concatenate(z) for z in zip(*members)), k)
                masks = run.column(5).to_pylist()
                bits = max(map(len, masks))
                packed = np.frombuffer(b"".join(m.ljust(bits, b"\0") for m in masks), np.uint8).reshape(-1, bits)
                for at in range(0, len(ids), BLOCK):
                    s = slice(at, at + BLOCK)
                    row, d, o = region.best(ids[s], x[s], np.unpackbits(packed[s], axis=1, bitorder="little").astype(bool))
                    heads = np.flatnonzero(np.diff(row, prepend=-1))
                    best = pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(d), pa.array(o)], names=["d", "o"]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s][row[heads]]), best], names=["k", "best"])

    sent = rows.mapInArrow(posted, "region int, kind tinyint, k long, v array<float>, slot int, visits binary")
    found = sent.repartitionById(count, F.col("region")).sortWithinPartitions("region", "kind").mapInArrow(searched, "k long, best array<struct<d:double,o:long>>")
    merged = found.groupBy("k").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best"))
    out = merged.select("k", F.posexplode("best").alias("i", "b"))
    return out.select(F.col("k").alias(key), F.col("b.o").alias(other), (F.col("i") + 1).alias("rank"), F.col("b.d").alias("distance"))
