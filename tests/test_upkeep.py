"""Stamped vaults: older schemas, stale texts and lost writes; and text in images, against a flood fill."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.sources import detect as O
from granary.sources import layout as L
from granary.sources import stamps as Z

OLD = "id long, title string, kind string, source string, content string, hash string, added_at long"
ROWS = [(1, "a", "pdf", "/a", "old a", "h1", 1), (2, "b", "image", "/b", "old b", "h2", 2), (3, "c", "text", "/c", "old c", "h3", 3), (4, "d", "pdf", None, None, "h4", 4), (5, "e", "pdf", "/a", "other", "h5", 5)]


def whole(items):
    return items.where("content is not null").select(F.col("id").alias("item_id"), F.lit(0).alias("ord"), F.col("content").alias("text"))


def extract(sources):
    return sources.select(F.col("source").alias("path"), F.concat(F.lit("new "), "source").alias("content"), F.when(F.col("source") == "/b", "gone").alias("error"))


def test_older_vaults_are_brought_up(spark, tmp_path):
    path = str(tmp_path / "vault")
    with pytest.raises(FileNotFoundError):
        Z.open_vault(spark, path, "m", "1")
    old = spark.createDataFrame(ROWS, OLD)
    Z.write(path, old, whole, "m", "1")
    same = Z.open_vault(spark, path, "m", "1")
    assert (same.stale, same.renewed, same.chunks.count()) == (False, False, 4)
    assert {(r.custom_title, tuple(r.tags), r.cursor, r.stored) for r in same.items.collect()} == {(False, (), "", "")}
    assert Z.to_read(same).count() == 0 and Z.settle(same, extract, whole) is same

    later = Z.open_vault(spark, path, "m", "2")
    assert (later.stale, later.chunks.count()) == (True, 0)
    assert {r.id for r in Z.to_read(later).collect()} == {1, 2, 5}
    assert Z.open_vault(spark, path, "m", "2").stale  # opening alone settles nothing

    def fails(sources):
        raise OSError("lost")

    with pytest.raises(OSError):
        Z.settle(later, fails, whole)
    assert Z.open_vault(spark, path, "m", "1").chunks.count() == 4
    now = Z.settle(later, extract, whole)
    assert (now.stale, now.renewed, now.chunks.count()) == (False, False, 4)
    assert {r.id: r.content for r in now.items.collect()} == {1: "new /a", 2: "old b", 3: "old c", 4: None, 5: "new /a"}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        Z.settle(later, extract, whole)  # another writer was first

    other = Z.open_vault(spark, path, "m2", "2")
    assert (other.stale, other.renewed, other.chunks.count()) == (False, True, 0)
    kept = other.items.withColumn("tags", F.when(F.col("id") == 1, F.array(F.lit("x"))))
    Z.write(path, kept, None, "m2", "2", other.commit)
    after = Z.open_vault(spark, path, "m2", "2")
    assert (after.commit, after.renewed, Z.open_vault(spark, path, "m", "2").chunks.count()) == (3, True, 4)  # chunks are still of the first model
    assert {r.id: r.tags for r in after.items.collect()} == {1: ["x"], 2: [], 3: [], 4: [], 5: []}


def flood(prob, width, height):
    """Boxes by filling from every pixel."""
    h, w = prob.shape
    seen, out = set(), []
    for start in np.ndindex(h, w):
        if prob[start] <= 0.3 or start in seen:
            continue
        part, todo = [], [start]
        seen.add(start)
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for n in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= n[0] < h and 0 <= n[1] < w and prob[n] > 0.3 and n not in seen:
                    seen.add(n)
                    todo.append(n)
        ys, xs = [p[0] for p in part], [p[1] for p in part]
        score = np.mean([prob[p] for p in part])
        if len(part) < 10 or score < 0.5:
            continue
        bw, bh = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
        d = bw * bh * 1.6 / (2 * (bw + bh))
        out.append((max(min(xs) - d, 0) * width / w, max(min(ys) - d, 0) * height / h, min(max(xs) + 1 + d, w) * width / w, min(max(ys) + 1 + d, h) * height / h, score))
    return sorted(out)


@pytest.mark.parametrize("density", [0.2, 0.5, 0.6, 0.8])
def test_boxes_equal_a_flood_fill(density):
    rng = np.random.default_rng(int(density * 10))
    for h, w in ((1, 40), (40, 1), (23, 31), (64, 64)):
        prob = np.where(rng.random((h, w)) < density, 0.3 + 0.7 * rng.random((h, w)), 0.3)
        got = sorted(O.text_boxes(prob, 100, 50).itertuples(index=False, name=None))
        np.testing.assert_allclose(np.array(got).reshape(-1, 5), np.array(flood(prob, 100, 50)).reshape(-1, 5), rtol=1e-12)


def test_boxes_of_a_spiral_and_of_odd_maps(spark):
    spiral = np.zeros((15, 15))
    spiral[::2] = 0.9
    spiral[1::4, -1] = spiral[3::4, 0] = 0.9
    assert len(O.text_boxes(spiral, 15, 15)) == 1
    rows = [(1, 4, 8.0, 8.0, [0.9] * 16), (2, 4, 8.0, 8.0, [0.9] * 9), (3, 4, 8.0, 8.0, None), (4, 4, 8.0, 8.0, []), (5, None, 8.0, 8.0, [0.9]), (6, 4, 8.0, 8.0, [None] * 16), (None, 4, 8.0, 8.0, [0.9] * 16)]
    maps = spark.createDataFrame(rows, "img long, w int, width double, height double, prob array<double>")
    assert sorted((r.x0, r.y0, r.x1, r.y1, round(r.score, 9)) for r in O.find_boxes(maps).collect()) == [(0.0, 0.0, 8.0, 8.0, 0.9)] * 2
    assert O.find_boxes(maps.where("img = 3")).count() == 0 and O.find_boxes(maps.limit(0)).count() == 0


def test_resize_and_spell():
    flat = np.full((7, 5, 3), 9)
    assert (O.resize(flat, 11, 3) == 9).all() and O.resize(flat, 11, 3).shape == (3, 11, 3)
    ramp = np.repeat(np.arange(4.0)[None, :, None], 2, axis=0)
    assert O.resize(ramp, 2, 1)[0, :, 0].tolist() == [0.5, 2.5]
    assert O.resize(ramp, 8, 1)[0, :, 0].tolist() == [0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3]
    scores = np.eye(4)[[0, 1, 1, 0, 1, 2, 3, 3]] * 0.8
    assert O.spell(scores, ["a", "b"]) == ("aab ", pytest.approx(0.8))
    assert O.spell(np.eye(4)[[0, 0]], ["a", "b"]) == ("", 0.0)
    assert O.detector_input(np.zeros((2000, 100, 3), np.uint8)).shape == (3, 1280, 64)
    assert O.recogniser_input(np.zeros((60, 200, 3), np.uint8), (0, 0, 200, 50)).shape == (3, 48, 192)
    assert O.recogniser_input(np.zeros((60, 200, 3), np.uint8), (0, 0, 1, 50)) is None


def test_images_to_laid_out_text(spark):
    def networks():
        """A detector of dark pixels, and a recogniser that is sure of dark lines alone."""

        def recognise(line):
            return np.eye(3)[[0, 1, 1, 2]] * (0.9 if (line < -0.5).mean() > 0.2 else 0.2)

        return (lambda x: (x[0] < 0).astype(float) * 0.9), recognise

    page = np.full((64, 192, 3), 255, np.uint8)
    page[8:24, 8:56] = page[8:24, 120:184] = page[40:56, 8:56] = 0
    rows = [(1, 192, 64, page.tobytes()), (2, 192, 64, b"short"), (3, 192, 64, None), (4, 192, 64, bytes([255]) * page.size)]
    images = spark.createDataFrame(rows, "img long, width int, height int, pixels binary")
    lines = O.read_images(images, networks, ["t", "o"])
    assert {(r.img, r.text, round(r.confidence, 6)) for r in lines.collect()} == {(1, "to", 0.9)} and lines.count() == 3
    assert [(r.img, r.text) for r in L.lay_out_images(lines).collect()] == [(1, "to to\nto")]
