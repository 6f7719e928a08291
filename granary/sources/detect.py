"""Text in images: boxes from a detector's maps, what a recogniser reads in them, and both over a table of images.

The two networks are the caller's; what goes in and what is made of what comes out is
here. Images are dealt over tasks, and a task holds one at a time with its map.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A pixel of text, the least box and its mean, how far a box is widened, the least confidence of a line.
THRESHOLD, LEAST_PIXELS, LEAST_SCORE, UNCLIP, LEAST_CONFIDENCE = 0.3, 10, 0.5, 1.6, 0.3
#: Fixed values of the networks' inputs: longest side and step of the detector; height and widths of the recogniser.
LONGEST, STEP, LINE_HEIGHT, LINE_WIDTHS = 1280, 32, 48, (64, 128, 192, 256, 384, 512, 768)
MEAN, SPREAD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)

BOXES = "x0 double, y0 double, x1 double, y1 double, score double"
LINES = "x0 double, y0 double, x1 double, y1 double, text string, confidence double"

Network = Callable[[np.ndarray], np.ndarray]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one places of the runs of set pixels of each row, counted through the whole mask."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, at = np.nonzero(edge == 1)
    _, to = np.nonzero(edge == -1)
    return row * mask.shape[1] + at, row * mask.shape[1] + to


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a mask and for each the number of its component of pixels side by side or one above the other.

    Runs of a row touch those of the next that overlap them, which are neighbours in the
    list of runs; touching runs take the least number among them until nothing changes.
    """
    at, to = runs(mask)
    width = mask.shape[1]
    low, high = np.searchsorted(to, at + width, "right"), np.searchsorted(at, to + width, "left")
    n = np.maximum(high - low, 0)
    upper = np.repeat(np.arange(len(at)), n)
    lower = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(low, n)
    root = np.arange(len(at))
    while True:
        least = np.minimum(root[upper], root[lower])
        new = root.copy()
        np.minimum.at(new, root[upper], least)
        np.minimum.at(new, root[lower], least)
        new = new[new]
        if (new == root).all():
            return at, to, np.unique(root, return_inverse=True)[1]
        root = new


def text_boxes(prob: np.ndarray, width: float, height: float) -> pd.DataFrame:
    """Boxes (x0, y0, x1, y1, score) of an image from the probabilities of its pixels, in the image's own measures.

    A box bounds a component over the threshold of at least ten pixels, widened on all sides by its area
    over its perimeter; its score is the mean of its pixels. Pixels that are no numbers count as none.
    """
    prob = np.nan_to_num(np.asarray(prob, float), nan=0.0, posinf=0.0, neginf=0.0)
    if not prob.size:
        return pd.DataFrame({c: [] for c in ("x0", "y0", "x1", "y1", "score")}, dtype=float)
    h, w = prob.shape
    at, to, part = components(prob > THRESHOLD)
    total = np.concatenate([[0.0], prob.ravel().cumsum()])
    r = pd.DataFrame({"part": part, "x0": at % w, "x1": (to - 1) % w + 1, "y0": at // w, "y1": at // w + 1, "n": to - at, "sum": total[to] - total[at]})
    b = r.groupby("part").agg(x0=("x0", "min"), y0=("y0", "min"), x1=("x1", "max"), y1=("y1", "max"), n=("n", "sum"), sum=("sum", "sum")).astype(float)
    b = b.assign(score=b["sum"] / b.n)
    b = b[(b.n >= LEAST_PIXELS) & (b.score >= LEAST_SCORE)]
    wide, tall = b.x1 - b.x0, b.y1 - b.y0
    more = wide * tall * UNCLIP / (2 * (wide + tall))
    sides = {"x0": (b.x0 - more).clip(lower=0) * width / w, "y0": (b.y0 - more).clip(lower=0) * height / h, "x1": (b.x1 + more).clip(upper=w) * width / w, "y1": (b.y1 + more).clip(upper=h) * height / h}
    return b.assign(**sides)[["x0", "y0", "x1", "y1", "score"]].reset_index(drop=True)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image (rows, columns, colours) in another size, each pixel mixed of the four around its middle."""

    def places(old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        first = at.astype(int)
        return first, np.minimum(first + 1, old - 1), at - first

    top, bottom, down = places(pixels.shape[0], height)
    left, right, along = places(pixels.shape[1], width)
    along, down = along[None, :, None], down[:, None, None]
    mixed = lambda rows: rows[:, left] * (1 - along) + rows[:, right] * along
    p = pixels.astype(float)
    return mixed(p[top]) * (1 - down) + mixed(p[bottom]) * down


def detector_input(pixels: np.ndarray) -> np.ndarray:
    """What a detector takes (colours, rows, columns): at most 1 280 pixels a side, sides in steps of 32, centred and scaled."""
    h, w = pixels.shape[:2]
    scale = min(LONGEST / max(h, w), 1.0)
    side = lambda n: max(int(np.floor(n * scale / STEP + 0.5)) * STEP, STEP)
    return ((resize(pixels, side(w), side(h)) / 255 - MEAN) / SPREAD).transpose(2, 0, 1).astype(np.float32)


def recogniser_input(pixels: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray | None:
    """What a recogniser takes of a box: 48 rows, columns up to the next of its widths, from -1 to 1 with zeros beside; None for boxes of a pixel."""
    x0, y0 = (int(v) for v in np.floor(box[:2]))
    x1, y1 = min(int(np.ceil(box[2])), pixels.shape[1]), min(int(np.ceil(box[3])), pixels.shape[0])
    if min(x1 - x0, y1 - y0) <= 1:
        return None
    wide = max(int(np.floor((x1 - x0) * LINE_HEIGHT / (y1 - y0) + 0.5)), 16)
    room = next((b for b in LINE_WIDTHS if b >= wide), LINE_WIDTHS[-1])
    line = resize(pixels[y0:y1, x0:x1], min(wide, room), LINE_HEIGHT) / 127.5 - 1
    return np.pad(line, ((0, 0), (0, room - line.shape[1]), (0, 0))).transpose(2, 0, 1).astype(np.float32)


def spell(scores: np.ndarray, symbols: list[str]) -> tuple[str, float]:
    """The text of a recogniser's scores (steps, classes) and its mean confidence. Class 0 is no symbol, those past the list are spaces, and a class that goes on counts once."""
    best = scores.argmax(axis=1)
    said = (best != 0) & (best != np.concatenate([[0], best[:-1]]))
    text = "".join(symbols[i - 1] if i <= len(symbols) else " " for i in best[said])
    return text, float(scores.max(axis=1)[said].mean()) if said.any() else 0.0


def find_boxes(maps: DataFrame) -> DataFrame:
    """Rows (img, x0, y0, x1, y1, score) from maps (img, w, width, height, prob): ``prob`` is an array of rows of ``w`` pixels. Null, empty and ragged maps have no boxes."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m in batch.itertuples(index=False):
                if m.prob is None or not len(m.prob) or not m.w > 0 or len(m.prob) % int(m.w):
                    continue
                found = text_boxes(np.asarray(m.prob, float).reshape(-1, int(m.w)), m.width, m.height)
                found.insert(0, "img", m.img)
                yield found

    return maps.select("img", "w", "width", "height", "prob").mapInPandas(fn, f"img {maps.schema['img'].dataType.simpleString()}, {BOXES}")


def read_images(images: DataFrame, networks: Callable[[], tuple[Network, Network]], symbols: list[str]) -> DataFrame:
    """Rows (img, x0, y0, x1, y1, text, confidence) from images (img, width, height, pixels), which ``layout.lay_out_images`` makes a text of.

    ``pixels`` are bytes of red, green and blue, row by row. ``networks`` makes the detector
    (an input to a map) and the recogniser (an input to scores) once a task. Lines that are blank
    or of little confidence are left out, and so are images whose bytes do not fit their size.
    """

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect, recognise = networks()
        for batch in batches:
            for i in batch.itertuples(index=False):
                if i.pixels is None or not i.width > 0 or not i.height > 0 or len(i.pixels) != 3 * i.width * i.height:
                    continue
                pixels = np.frombuffer(i.pixels, np.uint8).reshape(int(i.height), int(i.width), 3)
                lines = []
                for x0, y0, x1, y1, _ in text_boxes(detect(detector_input(pixels)), i.width, i.height).itertuples(index=False):
                    if (line := recogniser_input(pixels, (x0, y0, x1, y1))) is not None:
                        text, confidence = spell(recognise(line), symbols)
                        if text.strip() and confidence > LEAST_CONFIDENCE:
                            lines.append((i.img, x0, y0, x1, y1, text, confidence))
                if lines:
                    yield pd.DataFrame(lines, columns=["img", "x0", "y0", "x1", "y1", "text", "confidence"])

    return images.select("img", "width", "height", "pixels").mapInPandas(fn, f"img {images.schema['img'].dataType.simpleString()}, {LINES}")
