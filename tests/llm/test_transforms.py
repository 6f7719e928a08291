"""Fill-in-middle, whitening and fingerprints against brute force, with nulls, blanks, ties, repeats and extra columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import fingerprints, infill, whitening

DATA = "/root/testdata/sf0.001"


def documents(spark, rows):
    """Rows (id, text) with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, "x", 4) for i, t in rows], "doc_id long, text string, lang string, n long, k1 long, _part int, form string, n_chars long")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["über ", "a", " \n\t", "𝄞𝄞 ", "\x0bword", "<", "P>", " "]) for _ in range(rng.choice([0, 1, 2, 9, 60])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "  \n"), (203, "one"), (204, "a<P>b"), (205, "c <M> d"), (206, "<S>"), (207, " ".join(map(str, range(60_000))))]
    rows += [(300, "same words here"), (300, "same words here"), (300, "other words"), (None, "no id, one"), (None, "no id, one"), (None, "no id, two "), (None, None), (-7, "below zero it goes on ")]
    rows += [(400 + i, "copies of one text\tstand here ") for i in range(50)]
    return rows


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def infilled(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, lo), (lo, hi), (hi, n)))
    if h[3] % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill(spark, texts):
    made = infill.fill_in_middle(documents(spark, texts))
    got = made.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == collections.Counter(infilled(*r) for r in texts)
    assert collections.Counter((r.doc_id, r.back) for r in got) == collections.Counter((i, t or "") for i, t in texts)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_infill_deals_its_texts_once(spark):
    plan = infill.op11_infill(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "ENSURE_REQUIREMENTS" not in plan.replace("BroadcastExchange", "")


def test_infill_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(infill.OP11_SQL).fetchall()
    assert sorted(map(tuple, infill.op11_infill(spark, DATA).collect())) == sorted(want)


def test_infill_of_other_ids_and_an_empty_table(spark):
    named = spark.createDataFrame([("a", "words that stand here"), (None, "x")], "doc_id string, text string")
    assert sorted(map(tuple, infill.fill_in_middle(named).collect()), key=str) == sorted((infilled(*r) for r in [("a", "words that stand here"), (None, "x")]), key=str)
    assert infill.fill_in_middle(documents(spark, [])).count() == 0


# ------------------------------------------------------------------ whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id long, embedding array<float>, n long, deviation double, component int")


def whitened(rows, k=8):
    """Exact sums in integers; eigenvectors of the centred covariance."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(np.array([v for _, v in ok], np.float32).astype(np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    centred = x - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return [i for i, _ in ok], deviation, centred @ v / np.sqrt(e), e / (sum(deviation) / n**3)


@pytest.mark.parametrize("dim", [5, 40])
def test_whitening(spark, dim):
    rng = np.random.default_rng(3)
    scale = 2.0 ** -np.arange(dim) if dim < 10 else 1 + np.arange(dim) / 7
    rows = [(i, [float(c) for c in rng.standard_normal(dim) * scale + 3]) for i in range(500)]
    rows += [(900, None), (901, [float("nan")] * dim), (902, [float("inf")] + [0.0] * (dim - 1)), (903, [None] + [1.0] * (dim - 1)), (904, [0.0] * dim), (7, rows[7][1]), (None, rows[3][1])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    ids, deviation, want, explained = whitened(rows)
    k = min(8, dim)
    assert len(got) == len(ids) * k and {(r.n, type(r.deviation)) for r in got} == {(len(ids), int)}
    table = collections.defaultdict(list)
    for r in got:
        table[r.component].append((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened))
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-4 and r.identity_error < 1e-6
    for c, column in table.items():
        mine = sorted(column)
        for turn in (1, -1):
            other = sorted((i is None, i or 0, d, w) for i, d, w in zip(ids, deviation, turn * want[:, c - 1], strict=True))
            if np.allclose([m[3] for m in mine], [o[3] for o in other], atol=1e-6):
                break
        else:
            raise AssertionError(f"component {c}")
        assert [m[:3] for m in mine] == [o[:3] for o in other]


def test_whitening_centres_before_it_multiplies(spark):
    """A far mean and a small spread: products of uncentred rows would lose it."""
    rows = [(i, [1000.0 + i % 2 / 1024, -1000.0 + i % 3 / 1024]) for i in range(600)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    _, _, want, explained = whitened(rows)
    by = {(r.vec_id, r.component): r.whitened for r in got}
    assert np.allclose(np.abs([[by[i, 1], by[i, 2]] for i in range(600)]), np.abs(want), atol=1e-9)
    assert got[0].identity_error < 1e-9


def test_whitening_of_few_directions(spark):
    flat = [(i, [float(i % 5), 2.0 * (i % 5), 1.0]) for i in range(40)]
    got = whitening.whiten(vectors(spark, flat)).collect()
    assert {r.component for r in got} == {1} and len(got) == 40 and abs(got[0].explained - 1) < 1e-9
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    mixed = whitening.whiten(vectors(spark, [(i, [float(i), 1.0][: 1 + i % 2]) for i in range(10)])).collect()
    assert {(r.n, r.component) for r in mixed} == {(5, 1)} and len(mixed) == 10


def test_whitening_of_large_deviations(spark):
    df = spark.createDataFrame([(i, [float((-1) ** i * 2**20), float(i)]) for i in range(64)], "vec_id long, embedding array<double>")
    ids = [r for r in whitening.whiten(df).collect() if r.component == 1]
    assert len(ids) == 64 and {r.deviation for r in ids} == {None}
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>"))


# ------------------------------------------------------------------ fingerprints


def slow_fingerprint(data):
    """Byte by byte: the hash of each window, its last ones, the chunks between."""
    mask = (1 << 64) - 1

    def scrambled(w):
        w ^= w >> 30
        w = w * 0xBF58476D1CE4E5B9 & mask
        w ^= w >> 27
        w = w * 0x94D049BB133111EB & mask
        return w ^ w >> 31

    windows = [int.from_bytes((bytes(7) + data)[i : i + 8], "little") for i in range(len(data))]
    ones = [len(b) - len(b.rstrip("1")) for b in (bin(scrambled(w))[2:].zfill(64) for w in windows)]
    k = next(k for k in itertools.count() if len(data) <= 64 << k)
    while k and sum(o >= k for o in ones) < 16:
        k -= 1
    alphabet = base64.b64encode(bytes(b for i in range(0, 64, 4) for b in ((i << 2 | (i + 1) >> 4) & 255, ((i + 1) << 4 | (i + 2) >> 2) & 255, ((i + 2) << 6 | (i + 3)) & 255))).decode()

    def signature(least):
        out, begin = "", 0
        for i, o in enumerate(ones):
            if o >= least and len(out) < 63:
                out += alphabet[zlib.crc32(data[begin : i + 1]) % 64]
                begin = i + 1
        return out + (alphabet[zlib.crc32(data[begin:]) % 64] if begin < len(data) else "")

    return f"{k}:{signature(k)}:{signature(k + 1)}"


def distance(a, b):
    """Edit distance where symbols are put in or taken out."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] if x == y else 1 + min(last[j], row[-1]))
    return row[-1]


def slow_likeness(one, other):
    if one == other:
        return 1.0
    best = 0.0
    sizes = [(int(k) + d, re.sub(r"(.)\1{3,}", r"\1\1\1", s)) for f in (one, other) for k, *both in [f.split(":")] for d, s in enumerate(both)]
    for (k, a), (m, b) in itertools.product(sizes[:2], sizes[2:]):
        run = min(7, max(1, min(len(a), len(b)) // 2))
        if k == m and a and b and {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}:
            best = max(best, 1 - distance(a, b) / (len(a) + len(b)))
    return best


def test_fingerprints(spark, texts, monkeypatch):
    monkeypatch.setattr(fingerprints, "SEGMENT", 1000)  # the long text is read in parts
    monkeypatch.setattr(fingerprints, "PART_BYTES", 100)  # and the table in many
    rows = [(i, t if i != 207 else t[:20_000]) for i, t in texts]
    got = fingerprints.edited_by_next(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    unique = [r for r in rows if r[0] is not None and r[0] != 300]
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True)
    by_id = collections.defaultdict(list)
    for i, t in rows:
        by_id[i].append(t or "")
    found = {r.doc_id: r for r in got}
    prints = {t: slow_fingerprint(t.encode()) for _, t in rows if t} | {"": slow_fingerprint(b"")}
    for i, t in unique:
        t, r = t or "", found[i]
        at = ids.index(i) + 1
        m = len(t) // 3
        edits = [(t[: len(t) - m] + n[:m], n) for n in by_id[ids[at] if at < len(ids) else None]]
        assert r.n_chars == len(t) and r.fingerprint == prints[t] and r.edited in {e for e, _ in edits}
        assert r.edited_fingerprint == slow_fingerprint(r.edited.encode())
        assert abs(r.near_edited - slow_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert any(abs(r.near_next - slow_likeness(r.fingerprint, prints[n])) < 1e-12 for e, n in edits if e == r.edited)
    for i in (300, None):  # rows that share an id follow each other, and each is followed by one row
        mine = collections.Counter(r.fingerprint for r in got if r.doc_id == i)
        assert mine == collections.Counter(prints[t] for t in by_id[i])


def test_fingerprints_are_alike_for_edits_alone(spark):
    got = fingerprints.op13_fingerprints(spark, DATA).collect()
    long = [r for r in got if r.n_chars > 60]
    assert sum(r.near_edited > 0.5 for r in long) > 0.95 * len(long) and sum(r.near_next < 0.2 for r in long) > 0.98 * len(long)
    assert all(0 <= p <= 1 for r in got for p in (r.near_edited, r.near_next))


def test_fingerprints_of_one_and_of_no_document(spark):
    (one,) = fingerprints.edited_by_next(documents(spark, [(1, "abcdefghi")])).collect()
    assert one.edited == "abcdefabc" and one.near_next == 1.0
    (none,) = fingerprints.edited_by_next(documents(spark, [(None, None)])).collect()
    assert (none.n_chars, none.edited, none.fingerprint, none.near_edited) == (0, "", "0::", 1.0)
    assert fingerprints.edited_by_next(documents(spark, [])).count() == 0


def test_common_symbols_and_distances():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 65))) for _ in "ab")
        assert len(a) + len(b) - 2 * fingerprints.common_symbols(a, b) == distance(a, b)
