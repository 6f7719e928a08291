"""Vector operators: near-duplicate vectors and approximate nearest neighbours.

Vectors that are null or zero, or hold null or non-finite components, take no part in
either. Components count as doubles.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, by_key, checkpoint, components, group_edges, in_blocks, lean, mix, unpack

BLOCK_ROWS = 1024


def usable(vector: str) -> Column:
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column as matrices of doubles, one for each length: (row numbers, matrix)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(sizes) - sizes
    return [(rows, flat[(begin[rows][:, None] + np.arange(d))]) for d in np.unique(sizes) for rows in [np.flatnonzero(sizes == d)]]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two, so that the largest component of each is about 1 and no product of two overflows or vanishes; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def hyperplane_plan(rows: int, threshold: float, recall: float, bucket: int = 64) -> tuple[int, int]:
    """Bits a table and tables, for buckets of about ``bucket`` rows and this recall at the threshold."""
    bits = min(max(4, round(math.log2(max(2, rows / bucket)))), 24)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def width_of(vectors: DataFrame, vector: str) -> str:
    """How components travel: four bytes where the column holds floats, which a scale of their own does not hurt, else eight."""
    return "<f4" if "array<float>" in vectors.schema[vector].dataType.simpleString() else "<f8"


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """The hyperplanes of all tables, table by table, as columns."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def codes_of(x: np.ndarray, normals: np.ndarray, bits: int) -> np.ndarray:
    """The signs of some rows at the hyperplanes, as one number a table."""
    return ((x @ normals > 0).reshape(len(x), -1, bits) @ (1 << np.arange(bits))).astype(np.uint32)


def sign(bits: int, tables: int, seed: int, kind: str):
    """mapInArrow: classes (rep, n, label, vec) to one row a table: (key, grp, tab, rep, n, vec)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rep, n, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for rows, x in matrix(batch.column(3)):
                x = scaled(x)
                code = codes_of(x, planes(x.shape[1], bits, tables, seed), bits)
                grp = mix(label[rows].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x.shape[1]))
                key = mix(grp[:, None] + (np.arange(tables, dtype=np.uint64) << np.uint64(32))[None, :] + code.astype(np.uint64)).view(np.int64)
                vecs = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[:, t]), pa.array(grp.view(np.int64)), pa.array(np.full(len(rows), t, np.int32)), pa.array(rep[rows]), pa.array(n[rows]), vecs],
                        ["key", "grp", "tab", "rep", "n", "vec"],
                    )

    return run


def flood(near: np.ndarray) -> np.ndarray:
    """Labels of the connected components of a symmetric boolean matrix: the first row of each."""
    label = np.full(len(near), -1)
    for i in range(len(near)):
        if label[i] < 0:
            label[i] = i
            edge = np.array([i])
            while len(edge):
                new = np.flatnonzero(near[edge].any(axis=0) & (label < 0))
                label[new] = i
                edge = new
    return label


def verify(threshold: float, bits: int, tables: int, seed: int, kind: str):
    """Of whole buckets, rows (rep, n, root): links first found here, and a spanning set of them.

    Whether a pair met in an earlier table is told by its signs there, drawn anew for the
    few rows that have links at all.
    """

    def fn(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ("gkey", "grp", "tab", "rep", "n", "own", "lo", "hi")}
        vecs = table.column("vec").to_pylist()
        edges = group_edges(col["gkey"])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2:
                continue
            t = int(col["tab"][a])
            for grp in np.unique(col["grp"][a:b]):
                rows = np.arange(a, b)[col["grp"][a:b] == grp]
                x = scaled(np.frombuffer(b"".join(vecs[i] for i in rows), kind).reshape(len(rows), -1).astype(np.float64))
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                near = x @ x.T >= threshold * norm[:, None] * norm[None, :]
                np.fill_diagonal(near, False)
                if col["lo"][a] != col["hi"][a]:  # only across the two blocks
                    own = col["own"][rows]
                    near &= own[:, None] != own[None, :]
                linked = np.flatnonzero(near.any(axis=1))
                if len(linked) == 0:
                    continue
                near = near[np.ix_(linked, linked)]
                rows = rows[linked]
                c = codes_of(x[linked], planes(x.shape[1], bits, tables, seed)[:, : t * bits], bits) if t else None
                rep, n = col["rep"][rows], col["n"][rows]
                label = flood(near)
                least = np.full(len(rows), np.iinfo(np.int64).max)
                np.minimum.at(least, label, rep)
                for earlier in range(t):  # a pair counts in the first table where it meets
                    near &= c[:, earlier][:, None] != c[:, earlier][None, :]
                found.append((rep, near @ n, least[label]))
        if not found:
            found.append((np.zeros(0, np.int64),) * 3)
        return pa.table({k: np.concatenate([f[i] for f in found]).astype(np.int64) for i, k in enumerate(("rep", "n", "root"))})

    return fn


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 11) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Rows are compared within a label by cosine in doubles; pairs that share the signs of
    all hyperplanes of some table are verified exactly. The number of tables gives each
    pair at the threshold the stated chance to be found. Equal vectors are one class, so
    copies cost nothing; n_links still counts each row of a class. A bucket over
    BLOCK_ROWS is compared block by block in separate tasks, each reporting counts and a
    spanning set of links rather than pairs.

    Rows with a null label, null id or an unusable vector have no links and are their own
    component. Vectors of different lengths never link. An id names one vector; repeated
    rows count as two linked vectors. Extra columns are ignored. An empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("vec"), F.col(label).cast("long").alias("label"))
    rows = rows.withColumn("ok", usable("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = checkpoint(rows.where("ok").groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = hyperplane_plan(most, threshold, recall)
    kind = width_of(vectors, vector)
    schema = "key long, grp long, tab int, rep long, n long, vec binary"
    signed = classes.select("rep", "n", "label", "vec").mapInArrow(lean(sign(bits, tables, seed, kind)), schema)
    hot = checkpoint(signed.groupBy("key").count().where(F.col("count") > BLOCK_ROWS).select("key", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")))
    blocked = in_blocks(signed, "key", "rep", hot).drop("key")
    met = by_key(blocked, "gkey").mapInArrow(lean(unpack(verify(threshold, bits, tables, seed, kind), "gkey")), "rep long, n long, root long")
    met = checkpoint(met.groupBy("rep", "root").agg(F.sum("n").alias("n")))
    links = met.groupBy("rep").agg(F.sum("n").alias("links"))
    roots = components(met.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("rep"), "component")
    known = classes.join(links, "rep", "left").join(roots, "rep", "left")
    known = known.select(F.col("label").alias("_l"), F.col("vec").alias("_v"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(known, (rows["label"] == known["_l"]) & (rows["vec"] == known["_v"]) & rows["ok"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


class Forest:
    """Random-projection trees over the rows of a matrix, searched through one priority queue.

    Each inner node draws lines between pairs of its rows and splits at the median along
    the one on which they spread most. All trees are full and equally deep: nodes are
    stored level by level, and leaf i of a tree holds ``order[edge[i] : edge[i + 1]]``.
    """

    def __init__(self, x: np.ndarray, trees: int, depth: int, rng: np.random.Generator, lines: int = 12):
        self.depth, self.inner = depth, (1 << depth) - 1
        self.edge = (len(x) * np.arange((1 << depth) + 1)) >> depth
        x = x.astype(np.float32)
        grown = [self.grow(x, rng, lines) for _ in range(trees)]
        self.normal, self.cut, self.order = (np.stack(part) for part in zip(*grown, strict=True))

    def grow(self, x: np.ndarray, rng: np.random.Generator, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One tree, a level at a time; the nodes of a level differ by one row at most and are split together."""
        n, d = x.shape
        normal, cut = np.zeros((self.inner, d), np.float32), np.zeros(self.inner, np.float32)
        order = np.arange(n)
        for level in range(self.depth):
            m = 1 << level
            edge = (n * np.arange(m + 1)) >> level
            size = np.diff(edge)
            width = max(int(size.max()), 1)
            rows = order[np.minimum(edge[:-1, None] + np.minimum(np.arange(width), np.maximum(size, 1)[:, None] - 1), n - 1)]
            node = np.arange(m)[:, None]
            ends = rng.integers(0, width, (2, m, lines))
            drawn = x[rows[node, ends[0]]] - x[rows[node, ends[1]]]
            length = np.linalg.norm(drawn, axis=2, keepdims=True)
            drawn /= np.where(length > 0, length, 1)
            some = rows[:, rng.integers(0, width, min(width, 128))]
            best = drawn[np.arange(m), np.argmax(np.var(x[some] @ drawn.transpose(0, 2, 1), axis=1), axis=1)]
            along = (x[rows] @ best[:, :, None])[:, :, 0]
            along[np.arange(width) >= size[:, None]] = np.inf
            sort = np.argsort(along, axis=1, kind="stable")
            half = ((n * (2 * np.arange(m) + 1)) >> (level + 1)) - edge[:-1]
            normal[m - 1 : 2 * m - 1] = best
            cut[m - 1 : 2 * m - 1] = np.take_along_axis(along, sort, 1)[np.arange(m), np.minimum(half, width - 1)]
            order = np.take_along_axis(rows, sort, 1)[np.arange(width) < size[:, None]]
        return normal, cut, order

    def margins(self, q: np.ndarray) -> np.ndarray:
        """How far each query lies past the split of each node: (queries, trees, nodes)."""
        return np.einsum("qd,tnd->qtn", q.astype(np.float32), self.normal, optimize=True) - self.cut

    def queue(self, margins: list[list[float]]) -> Iterator[tuple[int, int]]:
        """Leaves (tree, leaf) in the order in which the one queue of all trees hands them out for a query.

        A node's priority falls by the squared margin of each split on its path that has the
        query on its other side, as the square of a distance would. No other node is looked at
        before the one that the queue hands out.
        """
        heap = [(0.0, tree, 0) for tree in range(len(margins))]
        while heap:
            far, tree, node = heapq.heappop(heap)
            margin = margins[tree]
            while node < self.inner:
                m = margin[node]
                near = 2 * node + (2 if m >= 0 else 1)
                heapq.heappush(heap, (far + m * m, tree, 4 * node + 3 - near))
                node = near
            yield tree, node - self.inner

    def leaf(self, tree: int, i: int) -> np.ndarray:
        return self.order[tree, self.edge[i] : self.edge[i + 1]]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of the first tree that each row falls into by its splits."""
        node = np.zeros(len(x), np.int64)
        x = x.astype(np.float32)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normal[0, node]) >= self.cut[0, node])
        return node - self.inner

    def leaves_for(self, x: np.ndarray, k: int, recall: float, probes: int, rng: np.random.Generator) -> int:
        """Leaves to take from the queue so that this share of the k nearest rows is met, as ``probes`` of the rows show.

        The probes' nearest are found by brute force; each counts at the leaf that first holds it.
        """
        at = rng.permutation(len(x))[:probes]
        near = x[at] @ x.T
        near[np.arange(len(at)), at] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1 or self.depth == 0:
            return max(1, len(self.order))
        wanted = np.argpartition(-near, k - 1, axis=1)[:, :k]
        home = np.argsort(self.order, axis=1, kind="stable")
        home = np.searchsorted(self.edge, home, side="right") - 1  # the leaf of each row in each tree
        met = []
        for margins, rows in zip(self.margins(x[at]), wanted, strict=True):
            missing: dict[tuple[int, int], list[int]] = {}
            for tree, leaves in enumerate(home[:, rows].tolist()):
                for row, leaf in zip(rows.tolist(), leaves, strict=True):
                    missing.setdefault((tree, leaf), []).append(row)
            left = set(rows.tolist())
            for taken, place in enumerate(self.queue(margins.tolist()), 1):
                found = left.intersection(missing.get(place, ()))
                met += [taken] * len(found)
                left -= found
                if not left:
                    break
        return int(np.quantile(met, recall, method="higher"))


def search_cell(k: int, trees: int, leaf: int, recall: float, probes: int, seed: int):
    """Of whole cells of rows and queries: each query's k nearest among the rows of the leaves it took.

    Rows (query_id, vec_id, score, ranked); ranked is the number of rows that a query met
    in the cell, on its first row, and 0 on the others.
    """

    def fn(table: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        edges = group_edges(table.column("gkey").to_numpy())
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = table.slice(a, b - a)
            ids, asks = part.column("vec_id").to_numpy(), part.column("ask").to_numpy()
            for rows, x in matrix(part.column("vec")):
                here, ask = ids[rows], asks[rows]
                order = np.argsort(here, kind="stable")
                x, here, ask = x[order], here[order], ask[order]
                base, base_ids, q, q_ids = x[~ask], here[~ask], x[ask], here[ask]
                if len(base) == 0 or len(q) == 0:
                    continue
                rng = np.random.default_rng([seed, x.shape[1]])
                forest = Forest(base, trees, max(0, math.ceil(math.log2(max(1, len(base) / leaf)))), rng)
                take = forest.leaves_for(base, k, recall, probes, rng)
                for lo in range(0, len(q), 64):
                    for i, margins in enumerate(forest.margins(q[lo : lo + 64])):
                        seen = np.zeros(len(base), bool)
                        seen[np.concatenate([forest.leaf(*place) for place in islice(forest.queue(margins.tolist()), take)])] = True
                        found = np.flatnonzero(seen)
                        met = len(found)
                        found = found[base_ids[found] != q_ids[lo + i]]
                        rough = base[found] @ q[lo + i]
                        if len(found) > k:
                            bar = np.partition(rough, len(rough) - k)[len(rough) - k]
                            found = found[rough >= bar - 1e-9 * max(1.0, float(np.abs(rough).max()))]
                        # summed in one order for every row, so that equal vectors tie
                        score = (base[found] * q[lo + i]).sum(axis=1)
                        best = np.lexsort((base_ids[found], -score))[:k]
                        ranked = np.zeros(len(best), np.int64)
                        ranked[:1] = met
                        out.append((np.full(len(best), q_ids[lo + i]), base_ids[found][best], score[best], ranked))
        if not out:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)))
        return pa.table({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("query_id", "vec_id", "score", "ranked"))})

    return fn


def top_trees(base: DataFrame, k: int, shard_rows: int, sample_rows: int, recall: float, seed: int) -> dict[int, tuple[Forest, int]]:
    """For each length of vector with more rows than a shard: the tree whose leaves are shards, and how many of them a query takes.

    The tree is fitted on the driver, on about ``sample_rows`` rows drawn by a hash of the
    id, and so is the number of leaves that meets ``recall`` of the nearest rows.
    """
    out = {}
    for dim, n in base.groupBy(F.size("vec")).count().where(F.col("count") > shard_rows).collect():
        rate = min(1.0, sample_rows / n)
        drawn = base.where((F.size("vec") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(math.ceil(rate * (1 << 30)))))
        drawn = drawn.select("vec_id", F.col("vec").cast("array<float>").alias("vec")).toArrow().combine_chunks().sort_by("vec_id")
        x = drawn.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        depth = min(math.ceil(math.log2(n / shard_rows)), int(math.log2(max(1, len(x) / 16))))
        if depth:
            rng = np.random.default_rng([seed, dim])
            tree = Forest(x, 1, depth, rng)
            out[dim] = tree, tree.leaves_for(x, max(1, math.ceil(k * len(x) / n)), recall, 200, rng)
    return out


def route(tops: dict[int, tuple[Forest, int]], ask: bool):
    """mapInArrow: (vec_id, vec) with the cells that a row lies in (one) or a query takes (some)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for rows, x in matrix(batch.column(1)):
                dim = x.shape[1]
                tree, take = tops.get(dim, (None, 1))
                if tree is None:
                    at, cell = rows, np.zeros(len(rows), np.int64)
                elif ask:
                    cell = np.array([leaf for m in tree.margins(x) for _, leaf in islice(tree.queue(m.tolist()), take)], np.int64)
                    at = np.repeat(rows, len(cell) // len(rows))
                else:
                    at, cell = rows, tree.leaf_of(x)
                yield pa.RecordBatch.from_arrays([pa.array(cell + (dim << 32)), *(c.take(pa.array(at)) for c in batch.columns)], ["cell", "vec_id", "vec"])

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    trees: int = 16,
    leaf: int = 32,
    recall: float = 0.93,
    probes: int = 64,
    id_col: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = 16_384,
    sample_rows: int = 32_768,
    query_rows: int = 2_048,
    seed: int = 5,
) -> DataFrame:
    """The k nearest rows of ``vectors`` found for each row of ``queries``, by inner product.

    A tree over the whole table, fitted on about ``sample_rows`` of its rows, deals all rows
    into shards of about ``shard_rows`` (a shard that comes out over twice as large is parted
    by a hash), and a query takes the shards that its queue hands out first. Each shard has
    a forest of ``trees`` trees with leaves of ``leaf`` rows; a query takes leaves from the
    queue that they share, and what those hold is ranked exactly. How many leaves are taken
    comes from ``probes`` rows of the shard, whose nearest are known by brute force: as many as
    meet ``recall`` of those. The same is done for shards, at half the loss. Every row is
    indexed. More than ``query_rows`` queries in a shard are split, each part with the rows.

    Result: (query_id, rank, vec_id, score), ties to the smaller id. A row isn't its own
    neighbour. Null ids and unusable vectors take no part; neither do pairs of different
    lengths. Rows that repeat an id count once for each row. Of equal vectors the k + 1
    smallest ids are indexed: no other can be among a query's k nearest. Equal queries
    are one; different vectors under one id are answered together, with the k best of what
    any of them finds. Extra columns are ignored; an empty table on either side gives an empty result.
    """
    found = found_in_cells(vectors, queries, k, trees, leaf, recall, probes, id_col, vector, shard_rows, sample_rows, query_rows, seed)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def found_in_cells(vectors, queries, k, trees, leaf, recall, probes, id_col, vector, shard_rows, sample_rows, query_rows, seed) -> DataFrame:
    """Rows (query_id, vec_id, score, ranked): the k nearest that each query finds in each cell it takes."""

    def named(df: DataFrame) -> DataFrame:
        return df.where(usable(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("vec"))

    alike = Window.partitionBy("vec").orderBy("vec_id")
    base = checkpoint(named(vectors).withColumn("r", F.dense_rank().over(alike)).where(F.col("r") <= k + 1).drop("r"))
    asks = named(queries).distinct()
    tops = top_trees(base, k, shard_rows, sample_rows, 1 - (1 - recall) / 2, seed)
    schema = f"cell long, vec_id long, vec {vectors.schema[vector].dataType.simpleString()}"
    rows = base.mapInArrow(lean(route(tops, ask=False)), schema)
    wants = asks.select("vec_id", F.col("vec").cast(vectors.schema[vector].dataType)).mapInArrow(lean(route(tops, ask=True)), schema)
    # a row for each shard: how many parts its rows make, and how many its queries
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(2.0 * shard_rows)).cast("int").alias("parts"))
    blocks = wants.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(float(query_rows))).cast("int").alias("blocks"))
    plan = checkpoint(parts.join(blocks, "cell"))
    cells = plan.agg(F.sum(F.col("parts") * F.col("blocks"))).first()[0] or 1
    plan = F.broadcast(plan) if plan.count() <= HOT_KEYS else plan
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    rows = rows.join(plan, "cell").withColumn("part", one("parts")).withColumn("block", every("blocks")).withColumn("ask", F.lit(False))
    wants = wants.join(plan, "cell").withColumn("block", one("blocks")).withColumn("part", every("parts")).withColumn("ask", F.lit(True))
    both = rows.unionByName(wants).withColumn("gkey", F.xxhash64("cell", "part", "block")).select("gkey", "vec_id", "vec", "ask")
    dealt = both.repartition(max(1, min(int(cells), 100_000)), "gkey").sortWithinPartitions("gkey", "ask", "vec_id")
    return dealt.mapInArrow(lean(unpack(search_cell(k, trees, leaf, recall, probes, seed), "gkey")), "query_id long, vec_id long, score double, ranked long")


def op2_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(e, e.where("vec_id % 20 = 0"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), p AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS node, vec_id AS root FROM v
  UNION
  SELECT p.u AS node, r.root FROM p JOIN r ON p.v = r.node WHERE r.root < p.u
)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.u = v.vec_id) AS n_links, min(r.root) AS component_id, min(r.root) = v.vec_id AS kept
FROM v JOIN r ON v.vec_id = r.node GROUP BY v.vec_id
"""
