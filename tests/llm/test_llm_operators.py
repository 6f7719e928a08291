"""Each operator against brute force, with nulls, blanks, ties, copies, repeats and extra columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import common, jaccard, licenses, lm, mixing, packing, quality, repeats, tokens, vectors

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    """Rows (id, text, source) with extra columns whose names clash with those of the operators."""
    full = [(i, t, "en", s, None, 1, 2, "x", 3.0) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n long, key long, rep string, score double")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    base = [prose(rng, rng.choice([3, 20, 80, 200])) for _ in range(60)]
    passage = prose(rng, 60)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "s0") for i in range(10)]  # copies
    rows += [(200 + i, base[5 + i] + " tail", "s1") for i in range(10)]  # near copies
    rows += [(300 + i, f"{prose(rng, 30)} {passage} {prose(rng, 30)}", "s2") for i in range(5)]
    rows += [(400, None, "s0"), (401, "", None), (402, " \n\t ", "s1"), (403, "One", None), (404, "A B C d", "s2"), (405, prose(rng, 30_000), "s1")]
    rows += [(406, "same same", "s1"), (406, "same same", "s1"), (None, base[0], "s0")]
    return rows


def split(text):
    return (text or "").encode().split()


def empty(spark):
    return documents(spark, [])


def test_words_hash_like_split():
    import pyarrow as pa

    texts = ["a  b", None, "", "\x0bx\x1cy z ", "a", "B b"]
    data, offsets = common.text_buffers(pa.array(texts))
    h, n = common.hash_words(data, offsets, lower=True)
    want = [w.lower() for t in texts for w in split(t)]
    assert n.tolist() == [len(split(t)) for t in texts]
    assert len(set(zip(want, h.tolist(), strict=True))) == len(set(want)) == len(set(h.tolist()))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in up}


# ------------------------------------------------------------------ mixing


def test_mixing(spark, corpus):
    got = mixing.mix_sources(documents(spark, corpus), cell_rows=5).collect()
    assert len(got) == len(corpus)
    size = collections.Counter()
    for _, t, s in corpus:
        size[s] += len(split(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:  # reshare until none is over its cap
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= share
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[r.source] += r.taken
    largest = {s: max(len(split(t)) for _, t, x in corpus if x == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in size)
    again = mixing.mix_sources(documents(spark, list(reversed(corpus))), cell_rows=1000).collect()
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r["size"], r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_sources(empty(spark)).count() == 0


# ------------------------------------------------------------------ vectors


def vector_rows(rng, n=300, dim=16):
    base = rng.standard_normal((n, dim))
    rows = [(i, v.astype(np.float32).tolist(), int(i % 3)) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[i] + 0.12 * rng.standard_normal(dim)).astype(np.float32).tolist(), int(i % 3)) for i in range(60)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(5)]
    rows += [(3000, None, 0), (3001, [0.0] * dim, 0), (3002, [float("nan")] * dim, 0), (3003, rows[0][1], None), (3004, [None, *rows[0][1][1:]], 0), (3005, [1.0, 2.0], 0), (3006, [1.0, 2.0], 0)]
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [1024, 4])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rows = vector_rows(np.random.default_rng(1))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rep long, n long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if usable(v)}
    label = {i: x for i, _, x in rows}
    near = {i: {j for j in unit if j != i and label[i] is not None and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93} for i in unit}
    root = {i: i for i, _, _ in rows}
    for _ in rows:
        new = {i: min([root[i], *(root[j] for j in near.get(i, ()))]) for i in root}
        if new == root:
            break
        root = new
    assert got == {i: (len(near.get(i, ())), root[i], root[i] == i) for i, _, _ in rows}


def test_nearest_is_exact_when_all_is_met(spark):
    """One leaf holds all rows. Rows that repeat an id, query ids that repeat, and clashing column names."""
    rows = vector_rows(np.random.default_rng(2))
    rows += [rows[21], rows[40], (None, rows[5][1], 0)]
    df = spark.createDataFrame([(*r, 1.0, 2, "x") for r in rows], "vec_id long, embedding array<float>, label int, score double, rank int, cell string")
    got = collections.defaultdict(list)
    for r in vectors.nearest(df, df.where("vec_id % 20 = 0"), leaf=10_000, query_rows=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    arrays = [(i, np.array(v, np.float64)) for i, v, _ in rows if usable(v) and i is not None]
    some = dict(arrays)
    assert set(got) == {i for i in some if i % 20 == 0}
    for q in got:
        want = sorted((-float(some[q] @ v), i) for i, v in arrays if i != q and len(v) == len(some[q]))[:20]
        assert [i for i, _ in got[q]] == [i for _, i in want]
        assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in want], abs=1e-12)


def recall_and_share(spark, df, **settings):
    """Recall of the 20 nearest, and the share of rows that a query ranked."""
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    given = {"k": 20, "trees": 16, "leaf": 32, "recall": 0.93, "probes": 64, "id_col": "vec_id", "vector": "embedding", "shard_rows": 16_384, "sample_rows": 65_536, "query_rows": 2_048, "seed": 5}
    found, ranked = collections.defaultdict(list), collections.Counter()
    for r in vectors.found_in_cells(df, df.where("vec_id % 20 = 0"), **(given | settings)).collect():
        found[r.query_id].append((-r.score, r.vec_id))
        ranked[r.query_id] += r.ranked
    best = {int(q): [int(i) for i in ids[np.argsort(-(m @ x[q]))] if i != q][:20] for q in ids[ids % 20 == 0]}
    return np.mean([len({i for _, i in sorted(found[q])[:20]} & set(b)) / 20 for q, b in best.items()]), np.mean([ranked[q] for q in best]) / len(ids)


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 600, "recall": 0.96, "query_rows": 30}])
def test_nearest_recall(spark, settings):
    """Vectors that lie far apart: much must be ranked, but not all."""
    recall, share = recall_and_share(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), **settings)
    assert recall >= 0.9 and share < 0.9


def test_nearest_ranks_little_where_vectors_cluster(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((80, 32))
    x = centres[rng.integers(0, 80, 6000)] + 0.2 * rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for settings in ({}, {"shard_rows": 1000}):
        recall, share = recall_and_share(spark, df, **settings)
        assert recall >= 0.9 and share < 0.1


def test_near_vectors_of_odd_ids(spark):
    """Null ids link with nothing; an id that repeats is two vectors that share a component; columns may clash."""
    v, w = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    rows = [(None, v, 0), (None, v, 0), (5, v, 0), (5, v, 0), (7, v, 0), (9, w, 0), (9, w, 1), (11, w, 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep long, n long, key long, component_id string")
    got = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect())
    assert got == collections.Counter({(None, 0, None): 2, (5, 2, 5): 2, (7, 2, 5): 1, (9, 0, 9): 1, (9, 1, 9): 1, (11, 1, 9): 1})


def test_near_vectors_of_any_magnitude(spark):
    """Products of components neither vanish nor overflow; cosines are 0, 1 and 0.71."""
    rows = [(1, [1e-200, 0.0]), (2, [0.0, 1e-200]), (3, [3e-200, 0.0]), (4, [1e200, 1e200]), (5, [1e200, -1e190]), (6, [5e-324, 0.0]), (7, [1.7e308, 1.7e308])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, recall=1 - 1e-9).collect()}
    assert got == {1: (3, 1), 3: (3, 1), 5: (3, 1), 6: (3, 1), 2: (0, 2), 4: (1, 4), 7: (1, 4)}


def test_bounded_words_of_long_texts(monkeypatch):
    """Texts read in parts have the words and windows that they have whole."""
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(prose(rng, 5) for _ in range(300)), "x" * 700 + " y", "  "]
    whole = [(h.tolist(), n.tolist(), common.rolling(h, 7).tolist()) for t in texts for h, n in [common.hash_words(*common.text_buffers(pa.array([t])))]]
    monkeypatch.setattr(common, "LONG_BYTES", 100)
    monkeypatch.setattr(common, "LONG_WORDS", 50)
    assert whole == [(h.tolist(), n.tolist(), common.rolling(h, 7).tolist()) for t in texts for h, n in [common.hash_words(*common.text_buffers(pa.array([t])))]]


def test_vectors_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(none).count() == 0 and vectors.nearest(none, none).count() == 0


# ------------------------------------------------------------------ documents


def grams(text, width):
    w = [x.lower() for x in split(text)]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def linked(a, b, percent):
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 1024), (5, 80, 2)])
def test_jaccard(spark, corpus, monkeypatch, width, percent, block):
    monkeypatch.setattr(jaccard, "CLUSTER_BLOCK", block)
    rng = random.Random(9)
    edited = [(500 + k, " ".join(w if rng.random() > 0.02 else "changed" for w in corpus[40][1].split()), "s0") for k in range(12)]
    rows = corpus + edited
    assert jaccard.similar_documents(empty(spark)).count() == 0 and jaccard.keep_one(empty(spark)).count() == 0
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(documents(spark, rows), width, percent).collect()}
    sets = {i: grams(t, width) for i, t, _ in rows if i is not None}
    root = {i: i for i in sets}
    for _ in sets:
        new = {i: min([root[i], *(root[j] for j in sets if linked(sets[i], sets[j], percent))]) for i in sets}
        if new == root:
            break
        root = new
    want = {(i, len(sets[i]), root[i]) for i in sets} | {(None, len(grams(rows[0][1], width)), None)}
    assert got == want
    kept = jaccard.keep_one(documents(spark, rows), width, percent)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({root[i] for i in root})
    assert kept.where("doc_id is null").count() == 1


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_counts_all_links(spark, corpus, monkeypatch, block):
    """Groups of near copies and of exact copies: each link is counted, also between sets of one component."""
    monkeypatch.setattr(jaccard, "CLUSTER_BLOCK", block)
    rng = random.Random(11)
    words = corpus[40][1].split() + prose(rng, 120).split()
    edited = [(500 + k, " ".join(w if rng.random() > 0.015 else f"changed{k}" for w in words), "s0") for k in range(40)]
    rows = [r for r in corpus if r[0] not in (405,)] + edited + [(600 + k, edited[3][1], "s1") for k in range(5)]
    sets = {i: grams(t, 4) for i, t, _ in rows if i is not None}
    want = {i: sum(j != i and linked(sets[i], sets[j], 85) for j in sets) for i in sets}
    assert max(want.values()) > 8 and len(set(want.values())) > 4
    got = {(r.doc_id, r.n_links) for r in jaccard.similar_documents(documents(spark, rows)).collect()}
    assert got == set(want.items()) | {(None, 0)}


def test_repeats(spark, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(documents(spark, corpus)).collect()}
    first = {}
    for i, t, _ in corpus:
        w = split(t)
        for p in range(len(w) - 49) if i is not None else ():
            key = tuple(w[p : p + 50])
            first[key] = min(first.get(key, i), i)
    for i, t, _ in corpus:
        w = split(t)
        gone = {q for p in range(len(w) - 49) if i is not None and first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        assert got[i] == (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    assert any(n for _, n, _ in got.values())
    apart = documents(spark, [(1, corpus[8][1] + " " + corpus[4][1], "s"), (1, corpus[4][1], "s"), (2, corpus[4][1], "s")])
    assert len(split(corpus[4][1])) >= 50
    assert sorted((r.doc_id, r.n_removed) for r in repeats.remove_repeats(apart).collect()) == [(1, 0), (1, 0), (2, len(split(corpus[4][1])))]
    assert repeats.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("step", [1, 2, 7, 1000])
def test_seeds_pass_through_in_order(monkeypatch, step):
    """Whatever the batches, all seeds of anchors that two documents hold are handed on once, hot ones as hot."""
    monkeypatch.setattr(repeats, "HOT", 4)
    monkeypatch.setattr(repeats, "SEEDS", 5)
    rng = np.random.default_rng(step)
    for anchors in (1, 3, 40):
        rows = np.stack([rng.integers(-anchors, anchors, 200), rng.integers(0, 5, 200), rng.integers(0, 2, 200), rng.integers(0, 3, 200)], axis=1)
        rows = sorted(tuple(map(int, r)) for r in rows if r[0] % 3 or r[1] == 1)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + step], strict=True), kinds, strict=True)], ["anchor", "doc", "tag", "at"]) for i in range(0, len(rows), step)]
        empty = pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], ["anchor", "doc", "tag", "at"])
        got = []
        for b in repeats.shared_seeds(iter([empty, *batches, empty])):
            for doc, tag, marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got += [(int(np.uint64(a).view(np.int64)), doc, tag, at, n > 4) for a, at, n in np.frombuffer(marks, repeats._MARK).tolist()]
        of = {a: {r for r in rows if r[0] == a} for a, *_ in rows}
        want = [(*r, len(s) > 4) for s in of.values() if len({r[1] for r in s}) > 1 for r in s]
        assert sorted(got) == sorted(want)


def test_an_anchor_of_very_many_documents_never_gathers():
    """One anchor of 300 000 documents, and a text repeated 300 000 times: what a task holds stays small."""
    def batches(documents):
        for k in range(0, 300_000, 10_000):
            doc = np.arange(k, k + 10_000) if documents else np.zeros(10_000, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(10_000, 7)), pa.array(doc), pa.array(np.full(10_000, 3)), pa.array(np.full(10_000, 1, "<i4"))], ["anchor", "doc", "tag", "at"])

    tracemalloc.start()
    rows = sum(b.num_rows for b in repeats.shared_seeds(batches(False)))
    once = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 0 and once < 4 << 20
    sizes = []
    for b in repeats.shared_seeds(batches(True)):
        sizes.append(b.num_rows)
        assert all(n > repeats.HOT for m in b.column(2).to_pylist()[::1000] for _, _, n in np.frombuffer(m, repeats._MARK).tolist())
    assert sum(sizes) == 300_000 and max(sizes) <= repeats.SEEDS + 10_000


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeats_go_by_words_not_by_hashes(spark, corpus, monkeypatch, hot):
    """With the same hash for all windows, what goes is still what an earlier document has, also around hot anchors."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(17)
    one, two, head = prose(rng, 70), prose(rng, 30), prose(rng, 12)
    texts = {1: f"{head} {one}", 2: f"{two} {head} {two}", 3: f"x {head} {one}", 4: f"{head} {one}", 5: f"{two} {head} {prose(rng, 50)}", 6: one[: len(one) // 2], 7: "a " * 300, 8: "b " + "a " * 120, 9: " ".join(f"{head} {one}".split()[8:70])}
    want = {}
    for i, t in texts.items():
        w = t.split()
        windows = {tuple(w[p : p + 50]) for p in range(len(w) - 49)}
        earlier = {tuple(u.split()[p : p + 50]) for j, u in texts.items() if j < i for p in range(len(u.split()) - 49)}
        want[i] = {q for p in range(len(w) - 49) if tuple(w[p : p + 50]) in earlier for q in range(p, p + 50)}
        assert windows or i == 6
    real = repeats.rolling
    for forced in (False, True):
        monkeypatch.setattr(repeats, "rolling", lambda h, k, *base: real(h, k, *base) * np.uint64(0 if forced and k == 50 else 1))
        ids = list(texts)
        seeds = [b for part in ([1, 2, 3], [4, 5], [6, 7, 8, 9]) for b in repeats.ship_seeds(50, 10)(iter([pa.RecordBatch.from_arrays([pa.array(part), pa.array([0] * len(part)), pa.array([texts[i] for i in part])], ["id", "tag", "text"])]))]
        marks = collections.defaultdict(list)
        ordered = pa.Table.from_batches(seeds).sort_by([(c, "ascending") for c in ("anchor", "doc", "tag", "at")])
        for b in repeats.shared_seeds(iter(ordered.to_batches(11))):
            for i, m in zip(b.column("id").to_pylist(), b.column("marks").to_pylist(), strict=True):
                marks[i].append(m)
        sent = []
        for part in ([1, 2, 3, 4], [5, 6], [7, 8, 9]):
            rows = [i for i in part if i in marks]
            batch = pa.RecordBatch.from_arrays([pa.array([texts[i] for i in rows], pa.string()), pa.array(rows, pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array([marks[i] for i in rows], pa.list_(pa.binary()))], ["text", "id", "tag", "marks"])
            sent += [r for b in repeats.send_contexts(50, 10, 0)(iter([batch])) for r in b.to_pylist()]
        sent.sort(key=lambda r: (r["gkey"], r["left"], r["context"] or b"", r["id"]))
        met = pa.RecordBatch.from_pylist(sent, pa.schema([("gkey", pa.int64()), ("left", pa.int32()), ("context", pa.binary()), ("id", pa.int64()), ("tag", pa.int64()), ("places", pa.binary())]))
        got = {i: set() for i in ids}
        for b in repeats.repeats(50)(iter([met])):
            for i, blob in zip(b.column("id").to_pylist(), b.column("spans").to_pylist(), strict=True):
                for x, y in np.frombuffer(blob, "<i4").reshape(-1, 2):
                    got[i] |= set(range(x, y))
        assert got == want


def test_token_counts(spark, corpus):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = [(600, "  two  spaces \n<s>日本 𝔘▁x", "s"), (601, "a" * 3000, "s"), (602, "\U0001f600‍", "s")]
    rows = corpus + odd
    got = collections.Counter(tuple(r) for r in tokens.count_tokens(documents(spark, rows)).collect())
    assert tokens.count_tokens(empty(spark)).count() == 0
    size = lambda t: len((t or "").encode())
    count = lambda t: len(sp.encode(t or ""))
    assert got == collections.Counter((i, size(t), count(t), count(t) > 4096) for i, t, _ in rows)


def test_packing(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r for r in corpus if r[0] not in (406, None)] + [(700, "é <|endoftext|> 日本\t\n  x 12's", "s")]
    pieces = packing.pack(documents(spark, rows)).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert p.length * 4 == len(p.ids) > 0
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, t, _ in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[i], key=lambda p: p.start)
        assert [x for p in parts for x in np.frombuffer(bytes(p.ids), "<u4").tolist()] == ids
        assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts[:-1])]).tolist()
        assert all(p.doc_tokens == len(ids) for p in parts)
    for parts in by_seq.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts[:-1])]).tolist()
        total = sum(p.length for p in parts)
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack(empty(spark)).count() == 0


def test_packing_deals_by_content(spark, monkeypatch):
    """Near copies share a shard wherever it can hold them, and a large group of copies is spread."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 32)
    rng = random.Random(13)
    base = [" ".join(f"v{rng.randrange(20_000)}" for _ in range(100)) for _ in range(150)]
    rows = [(i, t, "s") for i, t in enumerate(base)] + [(1000 + i, f"{t} tail{i}", "s") for i, t in enumerate(base)]
    rows += [(2000 + i, base[0] + " copied", "s") for i in range(300)] + [(3000, None, "s"), (3001, " ", "s")]
    shard = {p.doc_id: p.sequence_id >> 32 for p in packing.pack(documents(spark, rows)).collect()}
    assert len(shard) == len(rows)
    assert np.mean([shard[i] == shard[1000 + i] for i in range(1, 150)]) > 0.7
    assert max(collections.Counter(shard.values()).values()) <= 4 * 32


def test_packing_takes_the_nearest_first():
    import pyarrow as pa

    texts = pa.array(["apple pear fig", "stone rock", "fig pear plum", "rock hill"])
    index = packing.Index(*packing.word_slots(texts), np.ones(packing.SLOTS, np.int64), 4, 2.5)
    assert packing.order_of(index, np.array([3, 3, 3, 3]), 8) == [0, 2, 1, 3]


def test_lm_base_is_exact_and_model_is_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in lm.op7_lm_scores(spark, "/root/testdata/sf0.001").collect()}
    told = [(r.doc_id, [w.lower() for w in split(r.text)] + [b" "]) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in told if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in told:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), abs=1e-6)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def hashes(texts):
    """Token hashes of each text, with its end."""
    import pyarrow as pa

    h, n = lm.tokens(*common.text_buffers(pa.array(texts)))
    return [x.tolist() for x in np.split(h, np.cumsum(n)[:-1])]


def bits_by_hand(coder, codes, h):
    """(token, node, bit, level, slots) of one text, a bit at a time."""
    one32 = lambda x: int(lm.spread(np.array([x & 0xFFFFFFFF], np.uint32))[0])
    lone = [one32(x) for x in h]
    symbols = coder.place(np.array(h, np.uint64)).tolist()
    for t, symbol in enumerate(symbols):
        one, two = lone[t - 1] if t > 0 else 1, lone[t - 2] if t > 1 else 2
        contexts = [one32(one + 0x51ED270B), one32(one * 0x85EBCA6B + two)]
        rare = symbol > coder.k
        path = list(codes[coder.k + 1 if rare else symbol])
        if rare:
            code = h[t] >> (64 - lm.RARE_BITS)
            bits = [code >> (lm.RARE_BITS - 1 - k) & 1 for k in range(lm.RARE_BITS)]
            path += [(len(codes) - 1 + int("1" + "".join(map(str, bits[:k])), 2), b) for k, b in enumerate(bits)]
        for level, (node, bit) in enumerate(path):
            salt = one32(node + 0x9E3779B1)
            yield t, node, bit, level, [(c + salt & 0xFFFFFFFF) >> int(coder.shift) for c in contexts]


@pytest.fixture(scope="module")
def small_model(spark):
    rng = random.Random(23)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, range(60, 0, -1), k=rng.randrange(0, 60))) for _ in range(40)]
    texts[7] = texts[8] = " ".join(rng.choices(words, k=80))
    df = spark.createDataFrame([(i, t, i % 5 != 2) for i, t in enumerate(texts)], "doc_id long, text string, training boolean")
    told = [hashes([t])[0] for t in texts]
    count = collections.Counter(x for i, h in enumerate(told) if i % 5 != 2 for x in h[:-1])
    old = lm.KNOWN, lm.NEAR
    lm.KNOWN, lm.NEAR = 20, 35
    try:
        counts = lm.word_counts(df.where("training"), "text", 3)
        keys, n = lm.most_frequent(counts, lm.KNOWN)
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)).items() <= count.items() and 0 < len(keys) <= 20
        coder = lm.Coder(keys, n, sum(count.values()), 32, 1 << 16)
        model = lm.train(df.where("training").select("text"), coder, 2)
        scored = {r.doc_id: r for r in lm.score_texts(df).collect()}
    finally:
        lm.KNOWN, lm.NEAR = old
    weights = np.concatenate([n, [32], [sum(count.values()) - int(n.sum())]])
    return df, told, count, coder, lm.huffman(weights), model, scored


def test_lm_tables_hold_what_was_seen(small_model):
    _, told, _, coder, codes, model, _ = small_model
    seen = [collections.Counter() for _ in range(3)]
    for i, h in enumerate(told):
        if i % 5 != 2:
            for _, node, bit, _, slots in bits_by_hand(coder, codes, h):
                for c, at in zip(seen, [node, *slots], strict=True):
                    c[at, bit] += 1
    for c, table in zip(seen, model.tables, strict=True):
        both = np.array([[c[at, 0], c[at, 1]] for at in range(len(table))])
        assert (lm.encode(both) == table).all()


def test_lm_scores_by_hand(small_model):
    """Every score again from the model's tables, one bit and one word at a time."""
    _, told, count, coder, codes, model, scored = small_model
    known = set(coder.keys.tolist())
    shares = collections.Counter()
    for w, c in count.items():
        if w not in known:
            shares[w >> (64 - lm.RARE_BITS)] += c + 1
    context_hash = lambda h, t: int(common.rolling(np.array(h[t - lm.MATCH_WORDS : t], np.uint64), lm.MATCH_WORDS)[0])
    symbols = [coder.place(np.array(h, np.uint64)).tolist() for h in told]
    follows = collections.defaultdict(list)
    for i, h in enumerate(told):
        if i % 5 != 2:
            for t in range(lm.MATCH_WORDS, len(h)):
                follows[context_hash(h, t)].append((i, symbols[i][t]))
    gained = 0
    for i, h in enumerate(told):
        cost = [0.0] * len(h)
        for t, node, bit, level, slots in bits_by_hand(coder, codes, h):
            told3 = [int(table[at]) for table, at in zip(model.tables, [node, *slots], strict=True)]
            g = (min(level, lm.LEVELS - 1) * lm.GRADES_OF_EVIDENCE + (told3[2] >> 8)) * lm.GRADES_OF_EVIDENCE + (told3[1] >> 8)
            z = float(model.w[3][g]) + sum(float(model.w[k][g]) * ((c & 255) - 128) * lm.ODDS_STEP for k, c in enumerate(told3))
            step = math.floor((min(max(z, -12), 12) + 12) * lm.FINE + 0.5)
            cost[t] += float(model.cost[(min(level, lm.MAP_LEVELS - 1) * (24 * lm.FINE + 1) + step) * 2 + bit])
        total = 0.0
        for t, w in enumerate(h):
            p = 10 ** cost[t]
            if t >= lm.MATCH_WORDS and (c := context_hash(h, t)) % lm.MATCH_EVERY == 0:
                # a document is none to itself; the two that are alike are two
                others = [s for j, s in follows[c] if j != i]
                trust = lm.MATCH_TRUST * len(others) / (len(others) + 1)
                gained += bool(others)
                p = (1 - trust) * p + (trust * others.count(symbols[i][t]) / len(others) if others else 0)
            total += math.log10(p)
            if symbols[i][t] > coder.k:
                total += math.log10((count[w] + 1) / (shares[w >> (64 - lm.RARE_BITS)] + 1))
        assert scored[i].score == pytest.approx(total, rel=2e-3)
    assert gained > 10


def test_lm_is_a_distribution(small_model):
    """Over all next words, an unknown one for each setting of the rare bits, and the end, the chances add up to one."""
    _, told, count, coder, _, model, _ = small_model
    known = set(coder.keys.tolist())
    shares = collections.Counter()
    for w, c in count.items():
        if w not in known:
            shares[w >> (64 - lm.RARE_BITS)] += c + 1
    unknown = [(code << (64 - lm.RARE_BITS)) + 5 for code in range(1 << lm.RARE_BITS)]
    total = 0.0
    for last in [*count, int(lm.END), *unknown]:
        cost, symbol = model.costs(np.array([told[0][0], told[1][1], last], np.uint64), np.array([3]))
        p = 10 ** cost[2]
        if symbol[2] > coder.k:
            p *= (count[last] + 1) / (shares[last >> (64 - lm.RARE_BITS)] + 1)
        total += p
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_tells_documents_that_occur_twice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 600 and 3000").limit(300).select("doc_id", "text").dropDuplicates(["text"])
    twice = docs.where("doc_id % 4 = 0").selectExpr("doc_id + 1000000 as doc_id", "concat(text, ' again') as text")
    apart = lambda df: {r.doc_id: r.bits_per_byte for r in lm.score_texts(df.withColumn("training", F.lit(True))).collect()}
    alone, both = apart(docs), apart(docs.unionByName(twice))
    change = {k: [both[i] / alone[i] for i in alone if (i % 4 == 0) == k] for k in (True, False)}
    assert np.mean(change[True]) < np.mean(change[False]) - 0.1


def test_lm_edges(spark, corpus):
    docs = documents(spark, corpus)
    all_in = lm.score_texts(docs.withColumn("training", F.lit(True))).collect()
    assert len(all_in) == len(corpus) and all(r.n_known == r.n_tokens for r in all_in)
    none_in = lm.score_texts(docs.withColumn("training", F.lit(False))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == pytest.approx(0) for r in none_in)
    assert lm.score_texts(empty(spark).withColumn("training", F.lit(True))).count() == 0


@pytest.mark.parametrize("literal", [20_000, 10])
def test_licenses(spark, monkeypatch, literal):
    monkeypatch.setattr(licenses, "LITERAL_SHINGLES", literal)
    mit, isc = licenses.TEMPLATES["mit"], licenses.TEMPLATES["isc"]
    words = mit.split()
    rng = random.Random(5)
    worn = " ".join(words[:20] + ["edited"] + words[21:])
    half = " ".join(words[: len(words) // 2])
    rows = [(1, f"{prose(rng, 90)} {worn} {prose(rng, 50)}", "s"), (2, half, "s"), (3, f"{isc.upper()} Released under the MIT License.", "s"), (4, None, "s"), (5, "", "s"), (6, prose(rng, 500), "s"), (None, licenses.TEMPLATES["zlib"], "s"), (7, "released under the", "s"), (8, f"{prose(rng, 20_000)} {licenses.TEMPLATES['bsd-3']} {prose(rng, 20_000)}", "s")]
    named = {r: set() for r in (1, 2, 3, 4, 5, 6, 7, 8, None)}
    for i, t, _ in rows:  # brute force: containment of each template's shingles
        for name, text in licenses.TEMPLATES.items():
            want = grams(text, 5)
            if len(want & grams(t, 5)) >= 0.8 * len(want):
                named[i].add(name)
    assert named[1] >= {"mit"} and named[3] >= {"isc", "mit-notice"} and named[8] >= {"bsd-2", "bsd-3"} and named[None] == {"zlib"} and not named[2]
    got = {r.doc_id: r.licenses for r in licenses.scan(documents(spark, rows + rows[:1])).collect()}
    assert got == {i: sorted(x) for i, x in named.items()}
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(documents(spark, rows), {}).where("n_licenses > 0").count() == 0


def test_quality(spark):
    got = quality.op9_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.97


def test_quality_messages_are_marginals():
    rng = np.random.default_rng(4)
    n = np.array([1, 4, 3])
    z, t = rng.normal(size=8), rng.normal(size=(2, 2))
    fore, back = quality.messages(z, n, t)
    got = quality.sigmoid(fore + back)
    at = 0
    for size in n:
        p = np.zeros(size)
        total = 0.0
        for code in range(1 << size):
            y = [code >> k & 1 for k in range(size)]
            w = math.exp(sum(z[at + k] * y[k] for k in range(size)) + sum(t[y[k], y[k + 1]] for k in range(size - 1)))
            total += w
            p += w * np.array(y)
        assert got[at : at + size] == pytest.approx(p / total)
        at += size


def test_quality_edges(spark, corpus):
    docs = documents(spark, corpus)
    field = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.score(docs, field).where("score between 0 and 1").count() == len(corpus)
    assert quality.score(empty(spark), field).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 1), (None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, labels)).count() == len(corpus)
