"""Exact nearest neighbours in delay space, cross mapping and twin walks by them.

In a task, points of up to four axes are kept in grids of boxes, each grid's larger than the last's: a query looks at the boxes around its own, and
goes to a larger grid only where its neighbours can be beyond them. Points of more axes, and those that crowd, are kept in a k-d tree with boxes.
There queries are taken in groups of near ones: the tree's part next to a group bounds how far its neighbours can be, and only leaves within that
bound are looked at. Either way the work is about n log n.

For series of any length, a bounded sample parts space into cells. A query first asks the cell it lies in, which bounds its
neighbours' distance, and then just the other cells whose boxes reach within that bound; the lists are merged by query. Cells with many
queries are asked by several tasks, and of equal points a library keeps as many as can be neighbours at all.

Neighbours are ordered by distance, then by place. A query's own place and those within `theiler` of it are no neighbours.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.operators import series
from seqsieve.sources.shared import written

LEAF = 48
#: Points of a cell, of the sample that parts space, and queries that a task asks together.
CELL, SAMPLE, ASKED = 1 << 14, 20_000, 1 << 13
#: Rows of a neighbour table that are made together.
TOGETHER = 1 << 16
#: Pairs of a query and a point that are looked at together, and points around a query beyond which it goes by the tree.
PAIRS, CROWD = 1 << 19, 1 << 12


class Tree:
    """A k-d tree of points with ids. Nodes are stretches of `order`; children of node i are at left[i] and left[i] + 1."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids, self.left = points, ids, None

    def _parted(self, leaf: int = LEAF) -> "Tree":
        """The tree itself, which is made when it is first needed."""
        if self.left is not None:
            return self
        points, self.order = self.points, np.arange(len(self.points))
        starts, stops, left, low, high = [0], [len(points)], [], [], []
        at = 0
        while at < len(starts):
            own = self.order[starts[at] : stops[at]]
            here = points[own]
            a, z = (here.min(0), here.max(0)) if len(own) else (np.zeros(points.shape[1]),) * 2
            low.append(a)
            high.append(z)
            axis = int((z - a).argmax())
            if len(own) <= leaf or z[axis] == a[axis]:
                left.append(-1)
            else:
                mid = len(own) // 2
                self.order[starts[at] : stops[at]] = own[np.argpartition(here[:, axis], mid)]
                left.append(len(starts))
                starts += [starts[at], starts[at] + mid]
                stops += [starts[at] + mid, stops[at]]
            at += 1
        self.start, self.stop, self.left, self.low, self.high = (np.array(v) for v in (starts, stops, left, low, high))
        return self

    def leaves(self) -> list[np.ndarray]:
        return [self.order[a:z] for a, z in zip(self.start[self.left < 0], self.stop[self.left < 0])]

    def gaps(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Distances from a box to the nodes' boxes."""
        return np.sqrt((np.maximum(0, np.maximum(self.low[nodes] - high, low - self.high[nodes])) ** 2).sum(1))

    def _distances(self, some: np.ndarray, points: np.ndarray, ids: np.ndarray, theiler: int) -> np.ndarray:
        there = self.points[some]
        out = (points[:, :1] - there[:, 0]) ** 2
        for axis in range(1, points.shape[1]):
            out += (points[:, axis : axis + 1] - there[:, axis]) ** 2
        np.sqrt(out, out)
        out[np.abs(ids[:, None] - self.ids[some][None]) <= theiler] = np.inf
        return out

    def nearest(self, points: np.ndarray, ids: np.ndarray, k: int, theiler: int = 0, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest of each query, -1 and inf where there are fewer. `within`: no query asks farther."""
        near, dist = np.full((len(points), k), -1), np.full((len(points), k), np.inf)
        rest = np.arange(len(points))
        if len(points) and len(self.points) and points.shape[1] <= 4:
            rest = self._by_boxes(points, ids, k, theiler, within, near, dist)
        if len(rest):
            near[rest], dist[rest] = self._by_leaves(points[rest], ids[rest], k, theiler, None if within is None else within[rest])
        return near, dist

    def _by_boxes(self, points: np.ndarray, ids: np.ndarray, k: int, theiler: int, within: np.ndarray | None, near: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Fills near and dist for the queries that grids of boxes can answer, and returns the others, whose boxes hold too many points.

        A query looks at the boxes around its own. It is answered if its k nearest there are nearer than any point beyond them can be; else,
        or where they hold too few, it waits for a grid of larger boxes. All queries of a grid are looked up together."""
        dim, many = points.shape[1], len(self.points)
        need = k + 2 * theiler + 1
        wanted = min(many, 3 * need)
        low = np.minimum(points.min(0), self.points.min(0))
        width = float((np.maximum(points.max(0), self.points.max(0)) - low).max())
        if not np.isfinite(width):
            return np.arange(len(points))
        most = int(2.0 ** (60 / dim)) - 8  # boxes along an axis, so that a box has a number
        sides = [width * 1.01 if width > 1e-290 else 1.0]
        while len(sides) < 100 and sides[-1] * 0.7 * most > width > 1e-290:
            sides.append(sides[-1] * 0.7)
        offsets = np.array(list(itertools.product((-1, 0, 1), repeat=dim - 1)), np.int64).reshape(3 ** (dim - 1), dim - 1)

        def boxes(side, what):
            """(box of each point by axis, counted from 1, where in it the point lies)."""
            at = (what - low) / side
            box = at.astype(np.int64)
            return box + 1, at - box

        def grid(side):
            """(multipliers of a box's number, the library's points in order of these, the numbers in order)."""
            axis = int(width / side) + 4
            steps = np.array([axis**i for i in range(dim - 1, -1, -1)], np.int64)
            number = boxes(side, self.points)[0] @ steps
            order = np.argsort(number, kind="stable")
            return steps, order, number[order]

        def looked_up(number, steps, numbers):
            """(first, end) of the library's points by query and row of boxes."""
            first = np.empty((len(number), len(offsets)), np.int64)
            end = np.empty_like(first)
            for i, o in enumerate(offsets):
                row = number + o @ steps[:-1]
                first[:, i], end[:, i] = np.searchsorted(numbers, row - 1), np.searchsorted(numbers, row + 1, "right")
            return first, end

        # The first grid: the smallest boxes by which a quarter of some queries have enough points, found by halving.
        some = points[:: max(1, len(points) // 1000)]
        a, z = 0, len(sides) - 1
        while a < z:
            mid = (a + z + 1) // 2
            steps, _, numbers = grid(sides[mid])
            first, end = looked_up(boxes(sides[mid], some)[0] @ steps, steps, numbers)
            a, z = (mid, z) if np.quantile((end - first).sum(1), 0.75) >= wanted else (a, mid - 1)
        level = np.full(len(points), a)
        bound = np.full(len(points), np.inf) if within is None else within.astype(float)
        among = bool((ids >= -theiler).any())  # whether any query is a place of the series
        seen, rest = np.zeros(len(points), bool), []  # one that has looked once need only look as far as what it found
        for at in range(a, -1, -1):
            open_ = np.flatnonzero(level >= at)
            if not len(open_):
                continue
            side = sides[at]
            steps, order, numbers = grid(side)
            box, part = boxes(side, points[open_])
            number = box @ steps
            by = np.argsort(number, kind="stable")
            open_, number, part = open_[by], number[by], part[by]
            reach = np.full(len(open_), np.inf) if at == 0 else side * (1 - 1e-9 + np.minimum(part, 1 - part).min(1)) - 1e-12 * width
            first, end = looked_up(number, steps, numbers)
            held = (end - first).sum(1)
            ready = ((held >= wanted) & ~seen[open_]) | (bound[open_] < reach) | (at == 0)
            crowd = ready & (held > CROWD)
            rest.append(open_[crowd])
            level[open_[crowd]] = -1
            ready &= ~crowd
            rows = np.flatnonzero(ready)
            rows = rows[np.argsort(held[rows], kind="stable")]
            start = 0
            while start < len(rows):
                # Queries with about as many points each share a table of them.
                stop = start + 1 + int(np.searchsorted(np.cumsum(np.maximum(1, held[rows[start : start + PAIRS]])), PAIRS))
                here = rows[start:stop]
                start = stop
                q, counts = open_[here], (end - first)[here]
                total = counts.sum(1)
                wide = max(int(total.max()), k)
                flat = counts.reshape(-1)
                begin = np.cumsum(flat) - flat
                candidate = np.arange(int(flat.sum())) + np.repeat(first[here].reshape(-1) - begin, flat)
                row = np.repeat(np.arange(len(here)), total)
                place = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
                candidate = order[candidate]
                d = (points[q, 0][row] - self.points[candidate, 0]) ** 2
                for axis in range(1, dim):
                    d += (points[q, axis][row] - self.points[candidate, axis]) ** 2
                np.sqrt(d, d)
                if among:
                    d[np.abs(ids[q][row] - self.ids[candidate]) <= theiler] = np.inf
                table = np.full((len(here), wide), np.inf)
                table[row, place] = d
                kth = np.partition(table, k - 1, 1)[:, k - 1]
                upto = np.minimum(kth, bound[q])
                done = (upto < reach[here]) | (at == 0)
                bound[q] = upto
                seen[q] = True
                level[q[done]] = -1
                keep = np.flatnonzero((d <= upto[row]) & done[row] & np.isfinite(d))
                row, d, found = row[keep], d[keep], self.ids[candidate[keep]]
                by = np.lexsort((found, d, row))
                row, d, found = row[by], d[by], found[by]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                in_ = place < k
                near[q[row[in_]], place[in_]], dist[q[row[in_]], place[in_]] = found[in_], d[in_]
        return np.concatenate(rest)

    def _by_leaves(self, points: np.ndarray, ids: np.ndarray, k: int, theiler: int, within: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The same by the tree, a group of near queries at a time: for more than four axes, and points that crowd."""
        near, dist = np.full((len(points), k), -1), np.full((len(points), k), np.inf)
        need = k + 2 * theiler + 1
        for group in Tree(points, ids)._parted().leaves() if len(points) and len(self._parted().points) else []:
            own, own_ids = points[group], ids[group]
            low, high = own.min(0), own.max(0)
            at = 0
            while self.left[at] >= 0:
                children = self.left[at] + np.arange(2)
                child = children[self.gaps(children, low, high).argmin()]
                if self.stop[child] - self.start[child] < need:
                    break
                at = child
            d = self._distances(self.order[self.start[at] : self.stop[at]], own, own_ids, theiler)
            bound = np.partition(d, k - 1, 1)[:, k - 1] if d.shape[1] >= k else np.full(len(own), np.inf)
            if within is not None:
                bound = np.minimum(bound, within[group])
            most, front, hit = bound.max(), np.zeros(1, np.int64), []
            while len(front):
                front = front[self.gaps(front, low, high) <= most]
                end = self.left[front] < 0
                hit.append(front[end])
                front = (self.left[front[~end]][:, None] + np.arange(2)).reshape(-1)
            hit = np.concatenate(hit)
            some = np.concatenate([self.order[a:z] for a, z in zip(self.start[hit], self.stop[hit])]) if len(hit) else np.zeros(0, np.int64)
            d = self._distances(some, own, own_ids, theiler)
            bound = np.minimum(bound, np.partition(d, k - 1, 1)[:, k - 1]) if d.shape[1] >= k else bound
            row, column = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
            found_d, found = d[row, column], self.ids[some[column]]
            order = np.lexsort((found, found_d, row))
            row, found_d, found = row[order], found_d[order], found[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            first = place < k
            near[group[row[first]], place[first]], dist[group[row[first]], place[first]] = found[first], found_d[first]
        return near, dist


def library(points: np.ndarray, ids: np.ndarray, k: int, theiler: int = 0) -> Tree:
    """A tree of the points; of equal ones only the first that can be among k neighbours of anyone."""
    order = np.lexsort((ids, *points.T))
    same = np.concatenate(([False], (points[order[1:]] == points[order[:-1]]).all(1))) if len(order) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else np.zeros(0, np.int64)
    kept = np.sort(order[np.arange(len(order)) - begin < k + 2 * theiler + 1])
    return Tree(points[kept], ids[kept])


def sizes(n: int, dim: int) -> list[int]:
    """Lengths of the libraries of cross mapping: eight on a logarithmic grid from 2 (dim + 1) to n, without repeats."""
    return sorted({int(v) for v in np.geomspace(2 * (dim + 1), n, 8)})


def ccm_packed(x: np.ndarray, y: np.ndarray, dim: int = 3, tau: int = 1) -> float:
    """Largest cross-map skill: how well neighbours in y's delay space tell x, over libraries of the first points."""
    n = len(y) - (dim - 1) * tau
    if n < 4 * (dim + 1):
        return np.nan
    w, target, ids = np.stack([y[i * tau : i * tau + n] for i in range(dim)], 1), x[:n], np.arange(n)
    best = 0.0
    # Equal points ask once, for a neighbour more than they need, and each leaves out itself.
    points, which = _different(w)
    for size in sizes(n, dim):
        near, dist = library(w[:size], ids[:size], dim + 1).nearest(points, np.full(len(points), -1), dim + 2)
        near, dist = _but_itself(near[which], dist[which], ids)
        weight = np.exp(-dist / np.maximum(dist[:, :1], 1e-12))
        guess = (weight * target[near]).sum(1) / weight.sum(1)
        if guess.std() > 0 and target.std() > 0:
            best = max(best, float(np.corrcoef(guess, target)[0, 1]))
    return best


def _different(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different points, which of them each point is)."""
    order = np.lexsort(w.T)
    new = np.concatenate(([True], (w[order[1:]] != w[order[:-1]]).any(1)))
    which = np.empty(len(w), np.int64)
    which[order] = np.cumsum(new) - 1
    return w[order[new]], which


def _but_itself(near: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of neighbours without the query's own place, or without the last where that is not among them."""
    own = near == ids[:, None]
    at = np.where(own.any(1), own.argmax(1), near.shape[1] - 1)
    kept = np.arange(near.shape[1])[None] != at[:, None]
    return near[kept].reshape(len(near), -1), dist[kept].reshape(len(dist), -1)


def twin_table(x: np.ndarray, m: int = 3, theiler: int = 1, neighbours: int = 10) -> np.ndarray | None:
    """For each state of m values, the nearest states outside the Theiler window; None for a short series."""
    n = len(x) - m + 1
    if n < neighbours + 2 * theiler + 2:
        return None
    states, ids = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, m)), np.arange(n)
    # Equal states ask once, for as many neighbours more as a place and those beside it are, and each leaves out its own.
    points, which = _different(states)
    many = neighbours + 2 * theiler + 1
    near = library(states, ids, many).nearest(points, np.full(len(points), -2 - theiler), many)[0]
    form = np.int32 if n < 1 << 31 else np.int64
    near, out = near.astype(form), np.empty((n, neighbours), form)
    for a in range(0, n, TOGETHER):
        mine, here = near[which[a : a + TOGETHER]], ids[a : a + TOGETHER, None]
        out[a : a + TOGETHER] = np.take_along_axis(mine, np.argsort((np.abs(mine - here) <= theiler) | (mine < 0), 1, kind="stable")[:, :neighbours], 1)
    return out


# ---- series of any length


def _partition(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Splits (axis, value) of a complete tree over about `cells` cells, in heap order; axis -1 where there is nothing to split."""
    depth = max(0, int(np.ceil(np.log2(max(1, cells)))))
    parts, out = [points], []
    for _ in range(depth):
        after = []
        for p in parts:
            axis, value = -1, 0.0
            if len(p) > 1 and (width := p.max(0) - p.min(0)).max() > 0:
                axis = int(width.argmax())
                value = float(np.median(p[:, axis]))
                if not (p[:, axis] > value).any():  # more than half are the largest
                    value = float(np.nextafter(value, -np.inf))
            out.append((axis, value))
            right = p[:, axis] > value if axis >= 0 else np.zeros(len(p), bool)
            after += [p[~right], p[right]]
        parts = after
    return out


def _cell(splits: list[tuple[int, float]], points: np.ndarray) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if not splits:
        return at
    axis, value = (np.array(v) for v in zip(*splits))
    for _ in range((len(splits) + 1).bit_length() - 1):
        here = axis[at]
        right = (here >= 0) & (points[np.arange(len(points)), np.maximum(here, 0)] > value[at])
        at = 2 * at + 1 + right
    return at - len(splits)


def _points(batch, column="v"):
    values = batch.column(column)
    values = values.combine_chunks() if hasattr(values, "combine_chunks") else values
    return values.flatten().to_numpy().reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def nearest(held: DataFrame, asked: DataFrame, k: int, *, theiler: int = 0, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(id, near array<bigint>, dist array<double>) of every row of asked(id long, v array<double>): its k nearest of
    held(id, v), fewer if there are not so many. Vectors have one length and no nulls. Cells are at most sample / 16, so beyond
    cell * sample / 16 points they grow. If held has a column u double, the neighbours' u come as told array<double>, and same
    array<boolean> says which of them are at the query's own point."""
    import pyarrow as pa

    need, told = k + 2 * theiler + 1, ["u"] if "u" in held.columns else []
    held = written(enough_of_each(held.select("id", "v", *told), need), "different")
    n = held.count()
    cells = max(1, min(sample // 16, -(-n // cell)))
    splits: list[tuple[int, float]] = []
    if cells > 1:
        some = held.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))).limit(2 * sample)
        splits = _partition(np.array([r.v for r in some.select("v").collect()], float), cells)

    def placed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_cell(splits, _points(batch)))], [*batch.schema.names, "cell"])

    inside = written(held.mapInArrow(placed, "id long, v array<double>, " + "u double, " * len(told) + "cell long"), "library")
    dim = len((held.select("v").first() or [[0.0]])[0])
    edges = [f(F.col("v")[i]).alias(f"{name}{i}") for i in range(dim) for name, f in (("a", F.min), ("z", F.max))]
    boxes = inside.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *edges).collect()  # a row for each cell
    if not boxes:
        empty = {"near": "bigint", "dist": "double"} | ({"told": "double", "same": "boolean"} if told else {})
        return asked.select("id", *[F.array().cast(f"array<{kind}>").alias(c) for c, kind in empty.items()])
    names, counts = np.array([b.cell for b in boxes]), np.array([b.n for b in boxes])
    low, high = (np.array([[b[f"{c}{i}"] for i in range(dim)] for b in boxes], float) for c in "az")
    enough = np.flatnonzero(counts >= need)

    def gaps(points, some):
        return np.sqrt((np.maximum(0, np.maximum(low[some][None] - points[:, None], points[:, None] - high[some][None])) ** 2).sum(2))

    def homes(batches):
        """A query's own cell, or the nearest that has enough points, or (none has) a first one."""
        for batch in batches:
            points = _points(batch)
            home = _cell(splits, points)
            poor = ~np.isin(home, names[enough])
            if poor.any():
                for rows in np.array_split(np.flatnonzero(poor), -(-int(poor.sum()) // 1024)):
                    home[rows] = names[enough[gaps(points[rows], enough).argmin(1)]] if len(enough) else names[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(np.full(len(home), np.inf))], [*batch.schema.names, "cell", "within"])

    def others(batches):
        """The other cells within a query's bound."""
        for batch in batches:
            points, home, bound = _points(batch), batch.column("cell").to_numpy(), batch.column("within").to_numpy()
            for a in range(0, len(points), 1024):
                rows, to = np.nonzero((gaps(points[a : a + 1024], np.arange(len(names))) <= bound[a : a + 1024, None]) & (names[None, :] != home[a : a + 1024, None]))
                part = batch.slice(a, 1024).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(names[to]), part.column("within")], ["id", "v", "cell", "within"])

    def search(queries, points):
        ids = queries.column("id").to_numpy()
        tree = library(_points(points), points.column("id").to_numpy(), k, theiler)
        near, dist = tree.nearest(_points(queries), ids, k, theiler, queries.column("within").to_numpy())
        there = near >= 0
        ends = pa.array(np.concatenate(([0], np.cumsum(there.sum(1)))), pa.int32())
        full = there.all(1)
        within = np.minimum(np.where(full, dist[:, -1], np.inf), queries.column("within").to_numpy())
        lists = {"near": near, "dist": dist}
        if told:
            lists["told"], lists["same"] = beside(points.column("id").to_numpy(), points.column("u").to_numpy(), _points(points), _points(queries), near)
        made = [queries.column("id"), queries.column("v"), queries.column("cell"), pa.array(within), *(pa.ListArray.from_arrays(ends, pa.array(v[there])) for v in lists.values())]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made], ["id", "v", "cell", "within", *lists])

    def looked_up(queries: DataFrame, label: str) -> DataFrame:
        """Each cell's points go to as many tasks as its queries fill."""
        queries = written(queries, label)
        salts = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("salts"))  # a row for each cell
        dealt = queries.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
        points = inside.join(F.broadcast(salts), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        points = points.select(F.col("cell").alias("of"), F.col("salt").cast("long").alias("part"), "id", "v", *told)
        found = "id long, v array<double>, cell long, within double, near array<bigint>, dist array<double>" + ", told array<double>, same array<boolean>" * len(told)
        return dealt.groupBy("cell", "salt").cogroup(points.groupBy("of", "part")).applyInArrow(search, found)

    schema = "id long, v array<double>, cell long, within double"
    first = written(looked_up(asked.select("id", "v").mapInArrow(homes, schema), "queries"), "first")
    lists = ["dist", "near", *(["told", "same"] if told else [])]
    if len(names) == 1:
        return first.select("id", "near", "dist", *lists[2:])
    more = looked_up(first.select("id", "v", "cell", "within").mapInArrow(others, schema), "others")
    every = first.select("id", *lists).unionByName(more.select("id", *lists))
    best = every.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip(*lists)))), 1, k).alias("b"))
    return best.select("id", *[F.col(f"b.{c}").alias(c) for c in ("near", "dist", *lists[2:])])


def enough_of_each(held: DataFrame, need: int) -> DataFrame:
    """Of equal points, as many as can be neighbours; Spark keeps no more of each already before it moves them."""
    return held.withColumn("_k", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_k") <= need).drop("_k")


def beside(ids: np.ndarray, u: np.ndarray, held: np.ndarray, asked: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u of the neighbours, whether they are at the query's point); anything where there is none."""
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids, near, sorter=order), len(ids) - 1)]
    return u[at], (held[at] == asked[:, None]).all(2)


#: What a library's correlation is made of.
_SUMS = ("n", "g", "gg", "gx", "low", "high")


def _guessed(near: np.ndarray, dist: np.ndarray, told: np.ndarray, same: np.ndarray, c: np.ndarray, sx: np.ndarray, mean: float) -> tuple:
    """_SUMS of the rows at some points, from each point's nearest, one more than are asked: c rows are there, whose x less the mean
    sum to sx. All of them make one guess, but for those that are among the nearest themselves and leave themselves out. A row
    without x is told, but not compared, and as a neighbour it has a weight only."""
    known, value = ~np.isnan(told), np.nan_to_num(told, nan=0.0)

    def guess(kept):
        d = dist[:, kept]
        w = np.exp(-d / np.maximum(d[:, :1], 1e-12))
        return (w * value[:, kept]).sum(1) / w.sum(1) - mean

    k = dist.shape[1] - 1
    common, many, x = guess(list(range(k))), c.astype(float), sx.astype(float)
    parts = []
    for j in range(k):
        own = same[:, j] & known[:, j]
        parts.append((guess([i for i in range(k + 1) if i != j])[own], np.ones(int(own.sum())), told[own, j] - mean))
        many, x = many - own, x - np.where(own, value[:, j] - mean, 0.0)
    # A point whose rows have all left themselves out makes no guess for anyone; what is left of its x is rounding.
    parts.append((common[many > 0], many[many > 0], x[many > 0]))
    g, m, x = (np.concatenate(v) for v in zip(*parts))
    return (float(m.sum()), float((m * g).sum()), float((m * g * g).sum()), float((g * x).sum()), float(g.min(initial=np.inf)), float(g.max(initial=-np.inf)))


def ccm(df: DataFrame, *, dim: int = 3, tau: int = 1, cell: int = CELL) -> DataFrame:
    """One row (stat) of (t, x, y), of any length: the largest cross-map skill of ccm_packed. Equal points ask once, for one more
    neighbour than they need, and their rows are told by sums. Libraries that fit a cell are asked together."""
    import pyarrow as pa

    lead = {f"_y{i}": -i * tau for i in range(1, dim)}
    rows = series.shifted_all(df.select("t", F.col("x").cast("double").alias("u"), F.col("y").cast("double").alias("_y0")), lead, "_y0").where(F.col(f"_y{dim - 1}").isNotNull())
    rows = written(rows.select(F.col("t").alias("id"), F.array(*[f"_y{i}" for i in range(dim)]).alias("v"), "u"), "delays")
    k, none = dim + 2, df.sparkSession.createDataFrame([(None,)], "stat double")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("mean"), F.min("u").alias("low"), F.max("u").alias("high")).first()
    n = whole.n
    if n < 4 * (dim + 1):
        return none
    if whole.low is None or not whole.low < whole.high:
        return none.select(F.lit(0.0).alias("stat"))
    mean = whole.mean
    off = F.col("u") - F.lit(mean)
    square = rows.agg(F.sum(off).alias("x"), F.sum(off * off).alias("xx"))
    asked = rows.groupBy("v").agg((-2 - F.min("id")).alias("id"), F.count("u").alias("c"), F.coalesce(F.sum(off), F.lit(0.0)).alias("sx"))
    asked, held = written(asked, "asked"), written(enough_of_each(rows, k + 1), "held")
    lengths = sizes(n, dim)
    short, schema = [s for s in lengths if s <= cell], "size long, " + ", ".join(f"{c} double" for c in _SUMS)

    def few(queries, points):
        ids, u, v, at = (points.column("id").to_numpy(), points.column("u").to_numpy(), _points(points), _points(queries))
        c, sx, out = queries.column("c").to_numpy(), queries.column("sx").to_numpy(), []
        for size in short:
            there = ids < size
            near, dist = library(v[there], ids[there], k).nearest(at, np.full(len(at), -2), k)
            out.append((size, *_guessed(near, dist, *beside(ids[there], u[there], v[there], at, near), c, sx, mean)))
        return pa.table([pa.array(column) for column in zip(*out)], ["size", *_SUMS])

    salts = -(-asked.count() // ASKED)
    dealt = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    points = held.where(F.col("id") < short[-1]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    out = dealt.groupBy("salt").cogroup(points.groupBy("part")).applyInArrow(few, schema)
    for size in lengths[len(short) :]:

        def told(batches, size=size):
            for batch in batches:
                if batch.num_rows:
                    near, dist, u, same = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k) for c in ("near", "dist", "told", "same"))
                    made = _guessed(near, dist, u, same, batch.column("c").to_numpy(), batch.column("sx").to_numpy(), mean)
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (size, *made)], ["size", *_SUMS])

        found = nearest(held.where(F.col("id") < size), asked, k, cell=cell)
        out = out.unionByName(found.join(asked.select("id", "c", "sx"), "id").mapInArrow(told, schema))
    every = out.groupBy("size").agg(*[F.sum(c).alias(c) for c in _SUMS[:4]], F.min("low").alias("low"), F.max("high").alias("high"))
    every = every.where("low < high").crossJoin(F.broadcast(square))
    value = lambda a, ab, b: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    skill = value("g", "gx", "x") / F.sqrt(value("g", "gg", "g") * value("x", "xx", "x"))
    return every.agg(F.coalesce(F.greatest(F.lit(0.0), F.max(F.when(~F.isnan(skill), skill))), F.lit(0.0)).alias("stat"))
