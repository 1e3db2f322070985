"""Exact top-k by integer inner product: a ball tree in each shard, searched by branch and bound.

Vectors are dealt by place: a bounded number of pivots, drawn by a hash, parts the space into cells, and a cell is dealt into
shards of about `shard_rows` rows, so a vector that a third of all rows hold fills many shards and no task. Each shard's tree is
built once and written. A node of a tree knows its centre, radius and least id; no vector in it scores above
q . centre + |q| * radius. A query opens nodes in descending order of that bound and stops at the first that cannot
beat its current kth score (nor tie it with a smaller id). First each query searches its own shard; the kth score found
there is shared: it goes with the query, but only to shards of cells whose ball may hold something better, where it prunes
from the root on. Queries travel in blocks, beside which a tree is small.

Components are whole numbers. Where all products of a shard and its queries fit a double (below 2^53 in sum), scores are
exact in double; else doubles, with a margin for their rounding, only prune, and scores are taken in Python's whole numbers.

Cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows without vec_id; vectors of
any finite size do; a score beyond the range of a long is ranked exactly and reported as the nearest long; vectors of
different lengths are not compared; rows that share a vec_id are candidates of each other; fewer candidates give fewer
ranks; ties go to the smaller vec_id; empty vectors score 0 among themselves; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

EXACT = float(1 << 53)
TOP = (1 << 63) - 1
#: Bytes of a score that is beyond a long: 2 * 1024 bits of two doubles' product, and room for 8 bits of scale and the sum.
WIDE = 272


def _packed(score: int) -> tuple[int, bytes]:
    """(nearest long, bytes that order scores beyond the range of a long; none within it)."""
    if -TOP < score < TOP:
        return score, b""
    return max(-TOP - 1, min(TOP, score)), (score + (1 << (8 * WIDE - 1))).to_bytes(WIDE, "big")


def _unpacked(score: int, beyond: bytes | None) -> int:
    return int.from_bytes(beyond, "big") - (1 << (8 * WIDE - 1)) if beyond else int(score)


class BallTree:
    """Over float64 rows that hold whole numbers of any size."""

    PARTS = ("vectors", "ids", "rows", "first", "last", "left", "right", "centre", "radius", "least")

    def __init__(self, **parts):
        for name in self.PARTS:
            setattr(self, name, parts[name])
        # Work in doubles on vectors scaled by a power of two, so that no square overflows.
        top = float(np.abs(self.vectors).max(initial=0.0))
        self.scale = 1.0 if top < 2.0**400 else float(2.0 ** -np.frexp(top)[1])
        self.top = top
        self.scaled = self.vectors if self.scale == 1.0 else self.vectors * self.scale

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = 64) -> "BallTree":
        order = np.lexsort((rows, ids))
        vectors, ids, rows = vectors[order], ids[order], rows[order]
        top = float(np.abs(vectors).max(initial=0.0))
        scaled = vectors if top < 2.0**400 else vectors * float(2.0 ** -np.frexp(top)[1])
        place = np.arange(len(ids))
        first, last, left, right, centre, radius, least = [], [], [], [], [], [], []
        stack = [(0, len(ids), -1, False)]
        while stack:
            a, z, parent, second = stack.pop()
            at = len(first)
            if parent >= 0:
                (right if second else left)[parent] = at
            part = scaled[place[a:z]]
            c = part.mean(0)
            away = np.sqrt(((part - c) ** 2).sum(1))
            first.append(a)
            last.append(z)
            left.append(-1)
            right.append(-1)
            centre.append(c)
            radius.append(away.max())
            least.append(ids[place[a:z]].min())
            if z - a > leaf and away.max() > 0:
                far = part[away.argmax()]
                along = part @ (part[((part - far) ** 2).sum(1).argmax()] - far)
                place[a:z] = place[a:z][np.argsort(along, kind="stable")]
                mid = (z - a) // 2
                stack += [(a, a + mid, at, False), (a + mid, z, at, True)]
        kept = {"vectors": vectors[place], "ids": ids[place], "rows": rows[place], "centre": np.array(centre), "radius": np.array(radius), "least": np.array(least)}
        kept |= {"first": np.array(first), "last": np.array(last), "left": np.array(left), "right": np.array(right)}
        return cls(**kept)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in self.PARTS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "BallTree":
        with np.load(io.BytesIO(data)) as parts:
            return cls(**{n: parts[n] for n in cls.PARTS})

    def search(self, queries: np.ndarray, own_rows: np.ndarray, k: int, floors: list[tuple[int, int] | None]) -> list[list[tuple[int, int]]]:
        """Up to k (score, id) of each query, best first, without its own row. A floor (score, id) is a kth result from
        elsewhere: only better ones are of use."""
        dim = self.vectors.shape[1]
        top = float(np.abs(queries).max(initial=0.0))
        exact = self.top * top * max(1, dim) < EXACT
        scale = 1.0 if top < 2.0**400 else float(2.0 ** -np.frexp(top)[1])
        scaled = queries * scale
        norm = np.sqrt((scaled**2).sum(1))
        reach = np.sqrt((self.centre**2).sum(1)) + self.radius
        bound = scaled @ self.centre.T + norm[:, None] * self.radius + norm[:, None] * reach * 1e-9
        unit = self.scale * scale  # a scaled score is a score times this
        if exact:
            bound = np.floor(bound + 1e-6)  # scores are whole numbers
        lengths = None if exact else np.sqrt((self.scaled**2).sum(1))
        out = []
        for i, q in enumerate(scaled):
            whole = None if exact else [int(x) for x in queries[i]]
            best: list[tuple[int, int]] = []  # a heap with the worst result on top, as (score, -id)
            floor = None if floors[i] is None else (floors[i][0], -floors[i][1])
            open_nodes = [(-bound[i, 0], int(self.least[0]), 0)]
            while open_nodes:
                top_score, least, node = heapq.heappop(open_nodes)
                worst = best[0] if len(best) == k else floor
                if worst is not None:
                    limit = worst[0] if exact else _scaled(worst[0], unit)
                    if -top_score < limit:
                        break  # no other open node has a higher bound
                    if exact and -top_score == limit and -least <= worst[1]:
                        continue
                if self.left[node] >= 0:
                    for c in (int(self.left[node]), int(self.right[node])):
                        heapq.heappush(open_nodes, (-bound[i, c], int(self.least[c]), c))
                    continue
                a, z = int(self.first[node]), int(self.last[node])
                scores = self.scaled[a:z] @ q
                if worst is None:
                    near = range(z - a)
                elif exact:
                    near = np.flatnonzero(scores >= limit)
                else:
                    near = np.flatnonzero(scores + lengths[a:z] * norm[i] * 1e-9 >= limit)
                for j in near:
                    score = int(scores[j]) if exact else sum(x * int(y) for x, y in zip(whole, self.vectors[a + j]))
                    item = (score, -int(self.ids[a + j]))
                    if self.rows[a + j] == own_rows[i] or (floor is not None and item <= floor):
                        continue
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            out.append([(s, -v) for s, v in sorted(best, reverse=True)])
        return out


def _scaled(score: int, unit: float) -> float:
    """score * unit as a double that is not above it by more than a rounding; the margins of bounds cover that."""
    mantissa, exponent = np.frexp(unit)
    shift = max(0, score.bit_length() - 60) if score >= 0 else max(0, (-score).bit_length() - 60)
    value = np.ldexp(float(score >> shift) * mantissa, int(exponent) + shift)
    return float(value - abs(value) * 1e-12)


def integer_vectors(table: DataFrame, *, factor: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vec_id, v array<double> of whole numbers) of the rows that take part."""
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    rows = rows.where(F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    # Beyond 2^52 a double is whole, and times a power of two stays so; a product beyond the range of a double is its largest.
    most = F.lit(1.7976931348623157e308)
    whole = lambda x: F.when(F.abs(x) < float(1 << 52) / factor, F.floor(x * factor).cast("double")).otherwise(F.greatest(-most, F.least(most, x * factor)))
    return rows.select("vec_id", F.transform("x", whole).alias("v")).withColumn("row", F.monotonically_increasing_id())


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def _pivots(vectors: DataFrame, most: int, shard_rows: int, floats: int) -> dict[int, np.ndarray]:
    """Pivots by vector length: about one for each shard of rows, at most `most` together, and at most `floats` numbers."""
    sizes = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).orderBy(F.col("n").desc(), "dim").limit(64).collect()
    out, left = {}, most
    for dim, n in sizes:
        want = int(min(-(-n // shard_rows), left, floats // len(sizes) // max(1, dim)))
        if want < 2:
            continue
        share = F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 3.0 * want / n + 30.0 / n))
        seen = sorted({tuple(r.v) for r in vectors.where((F.col("dim") == dim) & share).select("v").limit(8 * want + 200).collect()})
        if len(seen) > 1:
            out[dim] = np.array(seen)[np.random.default_rng(0).permutation(len(seen))[:want]]
            left -= len(out[dim])
    return out


def nearest(table: DataFrame, *, every: int = 50, k: int = 5, shard_rows: int = 8192, block: int = 8192, factor: int = 256, pivots: int = 1024, pivot_floats: int = 1 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries whose id is divisible by `every`.

    At most `pivots` cells with `pivot_floats` numbers in all are known to the driver and broadcast, at any size of data.
    """
    import pandas as pd

    spark = table.sparkSession
    vectors = written(integer_vectors(table, factor=factor).withColumn("dim", F.size("v")), "vectors")
    places = spark.sparkContext.broadcast(_pivots(vectors, pivots, shard_rows, pivot_floats))

    def settle(batches):
        for pdf in batches:
            pdf["cell"] = 0
            for dim, own in pdf.groupby("dim"):
                if dim in places.value:
                    c = places.value[dim]
                    x = _matrix(own["v"])
                    size = max(1e-300, float(np.abs(c).max()), float(np.abs(x).max()))
                    c, x = c / size, x / size
                    pdf.loc[own.index, "cell"] = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
            yield pdf

    celled = written(vectors.mapInPandas(settle, "vec_id long, v array<double>, row long, dim int, cell int"), "celled")
    shards = celled.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = celled.join(written(shards, "cells"), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")).drop("shards")
    dealt = written(dealt, "dealt")

    def plant(pdf):
        if not pdf["dim"].iloc[0]:
            v = np.zeros((len(pdf), 1))
        else:
            v = _matrix(pdf["v"])
        tree = BallTree.build(v, pdf["vec_id"].to_numpy(), pdf["row"].to_numpy())
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "cell": pdf["cell"].iloc[:1], "shard": pdf["shard"].iloc[:1], "tree": [tree.to_bytes()], "n": [len(pdf)], "centre": [(tree.centre[0] / tree.scale).tolist()], "radius": [float(tree.radius[0] / tree.scale)]})

    trees = written(dealt.groupBy("dim", "cell", "shard").applyInPandas(plant, "dim int, cell int, shard int, tree binary, n long, centre array<double>, radius double"), "trees")
    key = ["dim", "cell", "shard", "block"]
    found = "query long, query_id long, vec_id long, score long, beyond binary"

    def run(tree_rows, query_rows):
        flat = []
        if len(tree_rows) and len(query_rows):
            tree = BallTree.from_bytes(tree_rows["tree"].iloc[0])
            floors = [None if pd.isna(v) else (_unpacked(s, b), int(v)) for s, b, v in zip(query_rows["kth"], query_rows["kth_beyond"], query_rows["kth_id"])]
            q = _matrix(query_rows["v"]) if query_rows["dim"].iloc[0] else np.zeros((len(query_rows), 1))
            got = tree.search(q, query_rows["row"].to_numpy(), k, floors)
            flat = [(r, i, v, *_packed(s)) for r, i, hits in zip(query_rows["row"], query_rows["vec_id"], got) for s, v in hits]
        out = pd.DataFrame(flat, columns=["query", "query_id", "vec_id", "score", "beyond"])
        return out.astype({c: "int64" for c in ("query", "query_id", "vec_id", "score")})

    def searched(asked: DataFrame, label: str) -> DataFrame:
        """asked(dim, cell, shard, row, vec_id, v, kth, kth_beyond, kth_id) against the trees of its shards, in blocks."""
        # A null in a column of whole numbers would turn all of it to doubles in pandas, so these travel as text.
        asked = asked.withColumn("kth_id", F.col("kth_id").cast("string")).withColumn("kth", F.col("kth").cast("string"))
        asked = written(asked, f"asked-{label}")
        blocks = asked.groupBy("dim", "cell", "shard").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        asked = asked.join(blocks, ["dim", "cell", "shard"]).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.col("blocks")).cast("int")).drop("blocks")
        copies = trees.select("dim", "cell", "shard", "tree").join(blocks, ["dim", "cell", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return written(copies.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, found), f"found-{label}")

    queries = dealt.where(F.col("vec_id") % every == 0)
    no_kth = [F.lit(None).cast("long").alias("kth"), F.lit(None).cast("binary").alias("kth_beyond"), F.lit(None).cast("long").alias("kth_id")]
    first = searched(queries.select("dim", "cell", "shard", "row", "vec_id", "v", *no_kth), "own")
    ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), F.coalesce("beyond", F.lit(b"")).desc(), "vec_id")
    kth = first.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") == k).select(F.col("query").alias("row"), F.col("score").alias("kth"), F.col("beyond").alias("kth_beyond"), F.col("vec_id").alias("kth_id"))
    # The balls of cells: of those with pivots at most `pivots`, broadcast; vectors of other lengths have one cell each.
    counts = trees.groupBy("dim", "cell").agg(F.count(F.lit(1)).cast("int").alias("shards"))
    balls: dict[int, list] = {}
    if places.value:
        known = trees.where(F.col("dim").isin(*places.value)).select("dim", "cell", "centre", "radius")
        ball = written(known.groupBy("dim", "cell").applyInPandas(_enclosing, "dim int, cell int, centre array<double>, radius double"), "balls")
        for r in ball.orderBy("dim", "cell").collect():
            balls.setdefault(r.dim, []).append((r.cell, r.centre, r.radius))
    told = spark.sparkContext.broadcast({d: (np.array([b[0] for b in bs]), np.array([b[1] for b in bs]), np.array([b[2] for b in bs])) for d, bs in balls.items()})

    def route(batches):
        for pdf in batches:
            cells = [[0]] * len(pdf)
            for dim, own in pdf.groupby("dim"):
                if dim not in told.value:
                    continue
                names, centre, radius = told.value[dim]
                q = _matrix(own["v"])
                size = max(1.0, float(np.abs(centre).max(initial=0.0)), float(radius.max(initial=0.0)))
                high = np.abs(q).max(1, initial=1.0)
                unit = q / high[:, None]
                norm = np.sqrt((unit**2).sum(1))
                c, r = centre / size, radius / size
                bound = unit @ c.T + norm[:, None] * r * (1 + 1e-9) + norm[:, None] * (np.sqrt((c**2).sum(1)) + r) * 1e-9
                for i, at in enumerate(own.index):
                    s, b = own["kth"].iloc[i], own["kth_beyond"].iloc[i]
                    if s is None or pd.isna(s):
                        use = names
                    else:
                        low = _scaled(_unpacked(int(s), b), 1.0 / size) / high[i]  # a rounding below the kth score
                        use = names[(bound[i] + abs(low) * 1e-9 >= low) | (radius >= 1e307)]
                    cells[pdf.index.get_loc(at)] = use.tolist()
            pdf["to"] = cells
            yield pdf

    asked = queries.join(kth, "row", "left").withColumn("kth", F.col("kth").cast("string")).withColumn("kth_id", F.col("kth_id").cast("string"))
    fields = "row long, dim int, cell int, vec_id long, v array<double>, shard int, kth string, kth_beyond binary, kth_id string"
    asked = asked.select(*[f.strip().split(" ")[0] for f in fields.split(",")]).mapInPandas(route, fields + ", to array<int>")
    asked = asked.withColumn("own_cell", F.col("cell")).withColumn("own_shard", F.col("shard")).drop("shard").withColumn("cell", F.explode("to")).drop("to")
    asked = asked.join(counts, ["dim", "cell"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("cell <> own_cell or shard <> own_shard")
    rest = searched(asked.select("dim", "cell", "shard", "row", "vec_id", "v", "kth", "kth_beyond", "kth_id"), "rest")
    best = first.union(rest).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _enclosing(pdf):
    """One row: a ball around the balls of a cell's shards."""
    import pandas as pd

    centres, radius = _matrix(pdf["centre"]), np.minimum(pdf["radius"].to_numpy(), 1.7e308)
    size = max(1e-300, float(np.abs(centres).max(initial=0.0)), float(radius.max(initial=0.0)))
    c = (centres / size).mean(0)
    reach = (np.sqrt((((centres / size) - c) ** 2).sum(1)) + radius / size).max() * (1 + 1e-9) + 1e-12
    return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "cell": pdf["cell"].iloc[:1], "centre": [(c * size).tolist()], "radius": [float(min(reach * size, 1.7e308))]})
