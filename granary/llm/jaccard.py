"""N-gram Jaccard join on a prefix tree.

A document is the set of its word n-grams, held as 64-bit hashes and ordered by them, one
order for all documents. Equal sets are one class. Sets that may be similar are brought
together by bands of minwise hashes: each order of a band puts one n-gram of a set first,
and sets that agree on the first n-grams of a band's orders meet. Of those that meet, a
sketch of all minwise hashes tells which can be similar at all, and these alone make
clusters: sets that merely share a passage or a form do not run together. In each cluster
the sets are stored in a trie; a set is joined with those stored in it by one walk that
counts the overlap of a shared path once and leaves a subtree when the n-grams that remain
cannot reach the required overlap. Links are verified exactly and all are counted.

Why clusters and not the tries' leading n-grams bring sets together: any two sets that share
a passage of a few dozen words share a leading n-gram under any order in which that passage
is not among the commonest of the corpus, and a list of those is bounded while the corpus
is not. At any size some passage is held by a great many unlike documents just below the
list, and each of them would be sent, whole, to the trie of that passage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, checkpoint, components, group_edges, hash_words, in_blocks, lean, mix, rolling, row_blocks, seeds, text_buffers, unpack, window_starts

BANDS, ROWS = 24, 3
SKETCH = BANDS * ROWS
SKETCH_LOSS = 1e-9
CLUSTER_BLOCK = 1024
CLUSTER_GRAMS = 1 << 20
BUCKET_BLOCK = 1024
BROADCAST_ROWS = 200_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The ordered n-gram set of each row; a text with fewer words is one n-gram, one without words none."""
    h, counts = hash_words(data, offsets, lower=True)
    at, _ = window_starts(counts, width)
    grams = rolling(h, width)[at] if len(at) else h[:0]
    ends = np.cumsum(np.maximum(counts - width + 1, 0))
    words = np.cumsum(counts)
    salt = seeds(width, 23)
    out = []
    for i, n in enumerate(counts.tolist()):
        if n >= width:
            out.append(np.unique(grams[ends[i] - (n - width + 1) : ends[i]]))
        elif n:
            part = h[words[i] - n : words[i]] * salt[:n]
            out.append(mix(part.sum(keepdims=True) + salt[n - 1 : n]))
        else:
            out.append(h[:0])
    return out


def sketch(width: int):
    """mapInArrow: (doc_id, text) to (doc_id, n, f1, f2, bands, sketch); a sketch has a byte of each minwise hash."""
    odd = seeds(BANDS * ROWS, 31) | np.uint64(1)
    salt = seeds(BANDS, 37)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in row_blocks(offsets):
                sets = shingle_sets(data, offsets[a : b + 1], width)
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                f = np.zeros((2, len(sets)), np.uint64)
                bands = np.zeros((len(sets), BANDS), np.uint64)
                drawn = np.zeros((len(sets), SKETCH), np.uint8)
                if len(some):
                    flat = np.concatenate(sets)
                    begin = (np.cumsum(n) - n)[some]
                    f[0, some] = np.add.reduceat(mix(flat), begin)
                    f[1, some] = np.add.reduceat(mix(flat ^ salt[0]), begin)
                    for band in range(BANDS):
                        key = np.full(len(some), salt[band])
                        for r in range(ROWS):
                            least = mix(np.minimum.reduceat(flat * odd[band * ROWS + r], begin))
                            drawn[some, band * ROWS + r] = least & np.uint64(255)
                            key = mix(key + least)
                        bands[some, band] = key
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), lists, pa.array([d.tobytes() for d in drawn], pa.binary())], ["doc_id", "n", "f1", "f2", "bands", "sketch"])

    return run


def least_agreement(percent: int) -> int:
    """Bytes in which two sketches agree at least: sets at the threshold agree in fewer with chance SKETCH_LOSS at most."""
    p, below = percent / 100, 0.0
    for k in range(SKETCH + 1):
        below += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if below > SKETCH_LOSS:
            return k
    return SKETCH


def near_sketches(bar: int):
    """Of whole buckets, edges (u, v): members and the least one that agreements of ``bar`` bytes reach.

    Buckets of one size are compared together.
    """

    def fn(table: pa.Table) -> pa.Table:
        keys, rep, own, lo, hi = (table.column(c).to_numpy() for c in ("gkey", "rep", "own", "lo", "hi"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        edges = group_edges(keys)
        size = np.diff(edges)
        found: list[tuple[np.ndarray, np.ndarray]] = [(rep[:0], rep[:0])]
        for s in np.unique(size[size > 1]).tolist():
            starts = edges[:-1][size == s]
            together = max(1, (4 << 20) // (s * s * SKETCH))
            for part in np.split(starts, np.arange(together, len(starts), together)):
                rows = part[:, None] + np.arange(s)
                x = sketch[rows]
                step = max(1, (4 << 20) // (len(part) * s * SKETCH))
                near = np.concatenate([(x[:, i : i + step, None, :] == x[:, None, :, :]).sum(axis=3, dtype=np.int16) >= bar for i in range(0, s, step)], axis=1)
                same = own[rows][:, :, None] == own[rows][:, None, :]
                near &= ~same | (lo[part] == hi[part])[:, None, None]
                names = rep[rows]
                least = names
                while True:
                    reached = np.minimum(least, np.where(near, least[:, None, :], np.iinfo(np.int64).max).min(axis=2))
                    if (reached == least).all():
                        break
                    least = reached
                moved = least != names
                found.append((names[moved], least[moved]))
        return pa.table({c: np.concatenate([f[i] for f in found]) for i, c in enumerate("uv")})

    return fn


def member_sets(width: int):
    """mapInArrow: (rep, cluster, f1, text, copies) to (rep, cluster, f1, copies, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            wanted = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in row_blocks(offsets):
                sets = shingle_sets(data, offsets[a : b + 1], width)
                keep = [i for i, s in enumerate(sets) if len(s) and int(mix(s).sum().view(np.int64)) == wanted[a + i]]
                at = pa.array([a + i for i in keep], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in (0, 1, 2, 4)), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["rep", "cluster", "f1", "copies", "grams"])

    return run


class Node:
    __slots__ = ("hi", "kids", "lo", "own", "seg", "table")

    def __init__(self, seg: np.ndarray, size: int, own: int = -1):
        self.seg = seg
        self.kids: dict[int, Node] = {}
        self.own = own  # the set that ends here
        self.lo = self.hi = size
        self.table: tuple[list[Node], np.ndarray, np.ndarray, np.ndarray] | None = None

    def below(self) -> tuple[list[Node], np.ndarray, np.ndarray, np.ndarray]:
        """Kids, their segments end to end, where each begins, and rows (length, last, lo, hi, own, has kids)."""
        if self.table is None:
            kids = list(self.kids.values())
            rows = np.array([(len(k.seg), k.seg[-1], k.lo, k.hi, k.own, len(k.kids) > 0) for k in kids], np.int64).T
            self.table = kids, np.concatenate([k.seg for k in kids]), np.cumsum(rows[0]) - rows[0], rows
        return self.table


class Trie:
    """Ordered sets of small numbers on shared paths."""

    def __init__(self, percent: int):
        self.percent = percent
        self.root = Node(np.zeros(0, np.int32), 0)

    def insert(self, x: np.ndarray, which: int) -> None:
        node, i, n = self.root, 0, len(x)
        while True:
            node.table = None
            if i == n:
                node.own = which
                return
            kid = node.kids.get(int(x[i]))
            if kid is None:
                node.kids[int(x[i])] = Node(x[i:], n, which)
                return
            m = min(len(kid.seg), n - i)
            differs = np.flatnonzero(kid.seg[:m] != x[i : i + m])
            same = int(differs[0]) if len(differs) else m
            if same < len(kid.seg):  # the segment is parted where the sets part
                upper = Node(kid.seg[:same], n)
                upper.lo, upper.hi = kid.lo, kid.hi
                node.kids[int(x[i])] = upper
                kid.seg = kid.seg[same:]
                upper.kids[int(kid.seg[0])] = kid
                kid = upper
            kid.lo, kid.hi = min(kid.lo, n), max(kid.hi, n)
            node, i = kid, i + same

    def links(self, x: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """All stored sets that are similar to x; ``mark`` tells which numbers x holds."""
        p, n = self.percent, len(x)
        out = []
        stack = [(self.root, 0, 0)] if self.root.kids else []
        while stack:
            node, overlap, depth = stack.pop()
            kids, flat, begin, (size, last, lo, hi, own, inner) = node.below()
            o = overlap + np.add.reduceat(mark[flat], begin, dtype=np.int64)
            d = depth + size
            j = np.searchsorted(x, last, side="right")
            # a set of size m below needs (100 + p) * overlap >= p * (n + m)
            near = (100 * np.minimum(n, hi) >= p * np.maximum(n, lo)) & ((100 + p) * (o + np.minimum(n - j, hi - d)) >= p * (n + lo))
            out.append(own[near & (own >= 0) & ((100 + p) * o >= p * (n + d))])
            stack.extend((kids[k], int(o[k]), int(d[k])) for k in np.flatnonzero(near & (inner > 0)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def join_cluster(percent: int):
    """Of whole clusters, rows (u, v, f1, links): each set's links, and the least set that they reach.

    Links are in documents: each counts the copies of the set it leads to.
    """

    def fn(table: pa.Table) -> pa.Table:
        keys, reps, own, lo, hi, cluster, f1, copies = (table.column(c).to_numpy() for c in ("gkey", "rep", "own", "lo", "hi", "cluster", "f1", "copies"))
        blobs = table.column("grams")
        edges = group_edges(keys)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for c in np.unique(cluster[a:b]):
                rows = np.arange(a, b)[cluster[a:b] == c]
                rows = rows[np.lexsort((f1[rows], reps[rows]))]
                fresh = np.ones(len(rows), bool)
                fresh[1:] = (reps[rows[1:]] != reps[rows[:-1]]) | (f1[rows[1:]] != f1[rows[:-1]])
                rows = rows[fresh]  # by id; a repeated row is met once
                across = lo[a] != hi[a]
                sets = [np.frombuffer(blobs[int(r)].as_py(), np.uint64) for r in rows]
                size = np.array([len(x) for x in sets])
                every, flat = np.unique(np.concatenate(sets), return_inverse=True)
                sets = np.split(flat.astype(np.int32), np.cumsum(size)[:-1])
                trie, mark = Trie(percent), np.zeros(len(every), bool)
                for i, r in enumerate(rows):
                    if not across or own[r] == lo[a]:
                        trie.insert(sets[i], i)
                weight, links, least = copies[rows], np.zeros(len(rows), np.int64), np.arange(len(rows))
                for i, r in enumerate(rows):
                    if across and own[r] == lo[a]:
                        continue
                    mark[sets[i]] = True
                    found = trie.links(sets[i], mark)
                    mark[sets[i]] = False
                    found = found if across else found[found < i]  # a pair is met once
                    if len(found):
                        links[i] += weight[found].sum()
                        links[found] += weight[i]
                        joined = np.unique(least[np.append(found, i)])
                        if len(joined) > 1:
                            least[np.isin(least, joined)] = joined[0]
                some = np.flatnonzero(links)
                for column, values in zip(out, (reps[rows[some]], reps[rows[least[some]]], f1[rows[some]], links[some]), strict=True):
                    column.append(values)
        return pa.table({k: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for k, x in zip(("u", "v", "f1", "links"), out, strict=True)})

    return fn


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (rep, cluster): sets that may have a link, from (rep, bands, sketch)."""
    keys = sets.select("rep", F.explode("bands").alias("band"))
    met = keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    hot = checkpoint(met.where(F.col("n") > BUCKET_BLOCK).select("band", F.ceil(F.col("n") / F.lit(float(BUCKET_BLOCK))).cast("int").alias("blocks")))
    buckets = keys.join(met.select("band"), "band").join(sets.select("rep", "sketch"), "rep")
    edges = by_key(in_blocks(buckets, "band", "rep", hot).drop("band"), "gkey").mapInArrow(lean(unpack(near_sketches(least_agreement(percent)), "gkey")), "u long, v long")
    return components(edges.distinct()).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))


def similar_documents(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, n_links), one for each row of ``docs``.

    Two documents link when 100 * intersection >= percent * union of their sets of
    ``width``-word n-grams, A-Z lower-cased; component_id is the smallest id that links
    reach, and n_links the number of documents that link with one, copies among them. Each
    link is verified exactly. That sets meet at all has a chance: with s the similarity, a
    pair is missed with chance (1 - s**ROWS)**BANDS, 1e-10 at 85 % and 3e-8 at 80 %, or
    SKETCH_LOSS at the threshold, and a component only if no other links hold it together.

    Null and empty texts have no n-grams and no links, and are their own component. A
    null id has a null component and links with nothing. Copies are one class, however
    many. Rows that repeat an id with the same text are one document; with another text they
    are documents apart that share a component. A cluster over CLUSTER_BLOCK different sets or
    CLUSTER_GRAMS n-grams is joined block by block in separate tasks. Extra columns are
    ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    drawn = checkpoint(rows.mapInArrow(lean(sketch(width)), "doc_id long, n long, f1 long, f2 long, bands array<long>, sketch binary"))
    some = drawn.where("n > 0 and doc_id is not null")
    sets = some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    copies = some.select("f1", "f2", "doc_id").distinct().groupBy("f1", "f2").agg(F.count("*").alias("copies"))
    sets = checkpoint(sets.join(copies, ["f1", "f2"]))
    clusters = checkpoint(candidates(sets, percent).join(sets.select("rep", "f1", "copies", "n"), "rep"))
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(float(CLUSTER_BLOCK)), F.sum("n") / F.lit(float(CLUSTER_GRAMS)))).cast("int")
    hot = checkpoint(clusters.groupBy("cluster").agg(blocks.alias("blocks")).where("blocks > 1"))
    few = F.broadcast(clusters) if clusters.count() <= BROADCAST_ROWS else clusters
    members = rows.join(few, rows["doc_id"] == few["rep"]).select("rep", "cluster", "f1", "text", "copies")
    members = members.mapInArrow(lean(member_sets(width)), "rep long, cluster long, f1 long, copies long, grams binary")
    blocked = in_blocks(members, "cluster", "rep", hot)
    links = checkpoint(by_key(blocked, "gkey").mapInArrow(lean(unpack(join_cluster(percent), "gkey")), "u long, v long, f1 long, links long"))
    counted = links.groupBy(F.col("u").alias("rep"), "f1").agg(F.sum("links").alias("links"))
    roots = components(links.select("u", "v")).select(F.col("node").alias("rep"), "component")
    classes = sets.select("f1", "f2", "rep", "copies").join(roots, "rep", "left").join(counted, ["rep", "f1"], "left")
    classes = classes.select("f1", "f2", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = drawn.drop("bands", "sketch").withColumn("own", F.when(F.col("n") > 0, F.col("f1")))
    out = out.join(classes.withColumnsRenamed({"f1": "own", "f2": "_f2"}), ["own"], "left").where(F.col("_f2").isNull() | (F.col("f2") == F.col("_f2")))
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(F.lit(0))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), n_links.alias("n_links"))


def with_keys(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, bool]:
    """``docs`` with column _key, the id; rows of an id that has several texts get one of their own for each text. And whether there are such."""
    own = F.xxhash64(F.col(text), F.col(id_col), F.col(text).isNull())
    several = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(own).alias("_a"), F.max(own).alias("_b")).where("_a <> _b")
    several = checkpoint(several.select("_id"))
    n = several.count()
    if n == 0:
        return docs.withColumn("_key", F.col(id_col).cast("long")), False
    marked = docs.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, F.col(id_col) == F.col("_id"), "left")
    return marked.withColumn("_key", F.when(F.col("_id").isNotNull(), own).otherwise(F.col(id_col).cast("long"))).drop("_id"), True


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of similar texts, that of the smallest id.

    An id may have several texts: each is judged apart, and goes only for a text that it is
    similar or equal to. Of rows equal in id and text one stays, the least by its other
    columns (maps aside). Texts without words are similar to nothing. Rows with a null id all stay.
    """
    keyed, several = with_keys(docs, id_col, text)
    known = keyed.where(F.col("_key").isNotNull())
    found = similar_documents(known, width, percent, "_key", text).groupBy(F.col("doc_id").alias("_k"), "component_id").agg(F.count("*").alias("n"))
    if several:  # keys are no ids here: the first of a component goes by id
        found = checkpoint(found.join(known.select(F.col("_key").alias("_k"), F.col(id_col).alias("_own")).distinct(), "_k"))
        firsts = found.groupBy("component_id").agg(F.min(F.struct("_own", "_k")).alias("first")).select("component_id", F.col("first._k").alias("_first"))
        found = found.join(firsts, "component_id")
    else:
        found = found.withColumn("_first", F.col("component_id"))
    marked = checkpoint(found.where("_k <> _first or n > 1").select("_k", (F.col("_k") == F.col("_first")).alias("_stays")))
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked
    out = keyed.join(marked, F.col("_key") == F.col("_k"), "left").where("_k is null or _stays")
    if marked.where("_stays").isEmpty():
        return out.select(*docs.columns)
    ordered = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    least = out.where("_stays").groupBy("_k").agg(F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias("row"))
    return out.where("_k is null").select(*docs.columns).unionByName(least.select("row.*"))


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_links")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(words[p + 1 : p + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 3, 1))) AS p FROM w WHERE len(words) > 0)
), n AS (SELECT w.doc_id, count(g.gram) AS n FROM w LEFT JOIN g ON w.doc_id = g.doc_id GROUP BY w.doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs JOIN n a ON pairs.u = a.doc_id JOIN n b ON pairs.v = b.doc_id WHERE 100 * shared >= 85 * (a.n + b.n - shared)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM n
  UNION
  SELECT links.u AS node, reach.root FROM links JOIN reach ON links.v = reach.node WHERE reach.root < links.u
)
SELECT n.doc_id, n.n AS n_shingles, min(reach.root) AS component_id FROM n JOIN reach ON n.doc_id = reach.node GROUP BY n.doc_id, n.n
"""
