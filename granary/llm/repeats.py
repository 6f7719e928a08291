"""Substring dedup: seed and extend.

Seeds are winnowed anchors: of the k-word grams inside every window of ``min_words`` words
the leftmost of the smallest hash. Equal windows have equal anchors, so documents that
share a window meet at its anchor. Seeds are sorted by anchor and pass through in that
order, so that no task holds all of an anchor's; those that one document alone holds are
dropped before any text moves. The others are sent with the words around them, as far as a window
can reach, and matches are extended both ways on those words: no word goes because hashes
agree. Matches that touch make up the maximal repeats, and all but the occurrence in the
smallest document goes.

Equal surroundings of an anchor are one: each batch sends those of its smallest document
alone, and where they meet again the stream passes on the first and marks the others. An
anchor with over HOT occurrences is parted by some forty words around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, lean, mix, rolling, row_blocks, shuffle_width, text_buffers, text_bytes, whole_groups, window_starts

BUCKET_BYTES = 16 << 20
BLOCK = 2 << 20
CONTEXT_BYTES = 32 << 20
HOT, PART = 1_000, 10
SEEDS = 1 << 19
_SEED = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<i4")])
_MARK = np.dtype([("anchor", "<u8"), ("at", "<i4"), ("n", "<u4")])
_SPAN = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("end", "<i4")])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    span, m = 1, a
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(a) - width + 1], m[width - span : len(a) - span + 1]) if span < width else m


def spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Word ranges covered by windows, in order; ranges that touch become one."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    cut = np.empty(len(doc), bool)
    cut[:1] = True
    cut[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + width)
    first = np.flatnonzero(cut)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    out = np.empty(len(first), _SPAN)
    out["doc"], out["tag"], out["start"], out["end"] = doc[first], tag[first], start[first], start[last] + width
    return out


def seeds_of(doc: np.ndarray, tag: np.ndarray, data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The anchors of some rows, each once: of every window the leftmost gram of the smallest hash."""
    h, counts = hash_words(data, offsets)
    at, row = window_starts(counts, width)
    if len(at) == 0:
        return np.zeros(0, _SEED)
    grams = rolling(h, gram, 0xE7037ED1A0B428DB)
    reach = width - gram + 1
    least = sliding_min(grams, reach)[at]
    # the place of the smallest: the first gram at or after the window's start that equals it
    order = np.argsort(grams, kind="stable")
    found = np.searchsorted(grams[order], least, side="left")
    begin = found.copy()
    place = order[found]
    late = np.flatnonzero(place < at)
    while len(late):  # the same gram stands earlier in the rows too: on to its next place
        begin[late] += 1
        place[late] = order[begin[late]]
        late = late[place[late] < at[late]]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    place, row = place[fresh], row[fresh]
    out = np.empty(len(place), _SEED)
    out["anchor"], out["doc"], out["tag"] = grams[place], doc[row], tag[row]
    out["at"] = place - (np.cumsum(counts) - counts)[row]
    return out


def ship_seeds(width: int, gram: int):
    """mapInArrow: rows (id, tag, text) to seeds (anchor, doc, tag, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = text_buffers(batch.column(2))
            for a, b in row_blocks(offsets, BLOCK):
                found = seeds_of(doc[a:b], tag[a:b], data, offsets[a : b + 1], width, gram)
                yield pa.RecordBatch.from_arrays([pa.array(found["anchor"].view(np.int64)), *[pa.array(found[c].copy()) for c in ("doc", "tag", "at")]], list(_SEED.names))

    return run


def marks_of(seeds: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Seeds, with how many their anchor has, as one row (id, tag, marks) for each text."""
    order = np.lexsort((seeds["tag"], seeds["doc"]))
    seeds, n = seeds[order], n[order]
    marks = np.empty(len(seeds), _MARK)
    marks["anchor"], marks["at"], marks["n"] = seeds["anchor"], seeds["at"], np.minimum(n, (1 << 32) - 1)
    first = np.flatnonzero((seeds["doc"] != np.roll(seeds["doc"], 1)) | (seeds["tag"] != np.roll(seeds["tag"], 1)) | (np.arange(len(seeds)) == 0))
    ends = np.append(first, len(seeds))[1:]
    return pa.RecordBatch.from_arrays([pa.array(seeds["doc"][first]), pa.array(seeds["tag"][first]), pa.array([marks[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary())], ["id", "tag", "marks"])


def shared_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over seeds sorted by (anchor, doc, tag, at): marks (id, tag, marks) of the anchors that two documents hold.

    Equal seeds, those of repeated rows, are one. An anchor's seeds wait until it is known
    whether a second document holds it, and whether it is hot; from there on they pass through.
    """
    wait, passing = np.zeros(0, _SEED), np.zeros(0, _SEED)  # passing: the last seed handed on of a hot anchor that may go on
    ready: list[tuple[np.ndarray, np.ndarray]] = []

    def decide(seeds: np.ndarray, whole: bool) -> int:
        """Hands on the seeds of anchors that are decided; gives how many those were."""
        first = np.flatnonzero(np.concatenate([[True], seeds["anchor"][1:] != seeds["anchor"][:-1]]))
        size = np.diff(np.append(first, len(seeds)))
        n, shared = size.copy(), seeds["doc"][first] < seeds["doc"][first + size - 1]
        if len(passing) and seeds["anchor"][0] == passing["anchor"][0]:
            n[0], shared[0] = HOT + 1, True
        done = len(seeds) if whole or (n[-1] > HOT and shared[-1]) else int(first[-1])
        kept = np.repeat(shared, size)[:done]
        ready.append((seeds[:done][kept], np.repeat(n, size)[:done][kept]))
        return done

    def packed() -> pa.RecordBatch:
        out = marks_of(*(np.concatenate(c) for c in zip(*ready, strict=True)))
        ready.clear()
        return out

    for batch in batches:
        new = np.empty(batch.num_rows, _SEED)
        for name, column in zip(_SEED.names, batch.columns, strict=True):
            new[name] = column.to_numpy().view(_SEED[name])
        seeds = np.concatenate([passing, wait, new])
        seeds = seeds[np.concatenate([[True], seeds[1:] != seeds[:-1]])[: len(seeds)]][len(passing) :]
        if len(seeds) == 0:
            continue
        done = decide(seeds, False)
        wait, passing = seeds[done:], seeds[-1:] if done == len(seeds) else seeds[:0]
        if sum(len(x) for x, _ in ready) > SEEDS:
            yield packed()
    if len(wait):
        decide(wait, True)
    if ready:
        yield packed()


def contexts(anchor: int, n: int, words: list[bytes], at: int, width: int, gram: int) -> list[tuple[int, int, bytes]]:
    """The groups in which an occurrence meets others, with the words it brings: (key, words before the anchor, words).

    That is its anchor and all that windows around it reach. Around a hot anchor windows are
    parted by how many words they have before it, PART numbers together: each part is keyed
    by the words that all its windows share, and brings no more than those reach.
    """
    reach = width - gram
    if n <= HOT:
        left = min(at, reach)
        return [(anchor, left, b" ".join(words[at - left : at + width]))]
    out = []
    for first in range(0, reach + 1, PART):
        last = min(first + PART - 1, reach)
        if first <= at and at + width - last <= len(words):
            key = blake2b(b"%d " % first + b" ".join(words[at - first : at + width - last]), digest_size=8).digest()
            left = min(at, last)
            out.append((int.from_bytes(key, "little", signed=True), left, b" ".join(words[at - left : at + width - first])))
    return out


_SENT = "gkey long, left int, context binary, id long, tag long, places binary"


def send_contexts(width: int, gram: int, where: int):
    """mapInArrow: documents with their marks to contexts, the words around shared anchors.

    Rows (gkey, left, context, id, tag, places): left is the number of words before the
    anchor. Of equal contexts in a batch those of the smallest document are sent. Of the
    others all windows are known to go: such rows have no context, and places holds spans.
    """
    def flush(held: dict[tuple[int, int, bytes], dict[int, list[tuple[int, int]]]]) -> pa.RecordBatch:
        rows = []
        for (key, left, context), docs in held.items():
            least = min(docs)
            size = context.count(b" ") + 1
            for doc, found in docs.items():
                tags: dict[int, list[int]] = {}
                for tag, at in found:
                    tags.setdefault(tag, []).append(at)
                for tag, places in tags.items():
                    at = np.array(places, "<i4")
                    if doc == least:
                        rows.append((key, left, context, doc, tag, at.tobytes()))
                    elif size >= width:
                        rows.append((doc, 0, None, doc, tag, np.stack([at - left, at - left + size], axis=1).astype("<i4").tobytes()))
        held.clear()
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["gkey", "left", "context", "id", "tag", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, bytes], dict[int, list[tuple[int, int]]]] = {}
        size = 0
        for batch in batches:
            ids, tags, lists = (batch.column(batch.num_columns - k) for k in (3, 2, 1))
            for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
                doc, tag = ids[i].as_py(), tags[i].as_py()
                words = (batch.column(where)[i].as_py() or "").encode("utf-8", "surrogatepass").split()
                for anchor, at, n in np.frombuffer(b"".join(lists[i].as_py()), _MARK).tolist():
                    for found in contexts(anchor - (1 << 64) if anchor >> 63 else anchor, n, words, at, width, gram):
                        held.setdefault(found, {}).setdefault(doc, []).append((tag, at))
                        size += len(found[2]) + 100
                if size > CONTEXT_BYTES:
                    yield flush(held)
                    size = 0
        yield flush(held)

    return run


def one_of_each(batches: Iterator[pa.RecordBatch], known: list[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (gkey, left, context, id): the first of each equal context; spans of other documents go to ``known``."""
    last: tuple = ()
    for batch in batches:
        keep = []
        for i, (key, left, context, doc, tag, places) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if context is None:
                known.append(as_spans(doc, tag, np.frombuffer(places, "<i4").reshape(-1, 2)))
            elif last[:3] != (key, left, context):
                last = (key, left, context, doc)
                keep.append(i)
            elif doc == last[3]:  # the same document again, with another text
                keep.append(i)
            elif (size := context.count(b" ") + 1) >= width:
                at = np.frombuffer(places, "<i4")
                known.append(as_spans(doc, tag, np.stack([at - left, at - left + size], axis=1)))
        yield batch.take(pa.array(keep, pa.int32()))


def as_spans(doc: int, tag: int, pairs: np.ndarray) -> np.ndarray:
    out = np.empty(len(pairs), _SPAN)
    out["doc"], out["tag"], out["start"], out["end"] = doc, tag, pairs[:, 0], pairs[:, 1]
    return out


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """How many words two lists have in common from their beginnings on."""
    for k, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return k
    return min(len(a), len(b))


def extend(table: pa.Table, width: int) -> np.ndarray:
    """Of whole groups of contexts: spans of words that a smaller document has around the same anchor.

    Hashes of all windows of a group tell which occurrence each window may match; the match
    is then extended word by word, left and right of the anchor, and windows beyond it stay.
    """
    key, left, doc, tag = (table.column(c).to_numpy().astype(np.int64) for c in ("gkey", "left", "id", "tag"))
    texts = table.column("context").to_pylist()
    data, offsets = text_buffers(pa.array(texts, pa.binary()).cast(pa.large_binary()).view(pa.large_string()))
    h, counts = hash_words(data, offsets)
    at, row = window_starts(counts, width)
    if len(at) == 0:
        return np.zeros(0, _SPAN)
    begin = (at - (np.cumsum(counts) - counts)[row]).astype(np.int64)
    told = mix(rolling(h, width)[at] ^ mix(key.view(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15) + (begin - left[row] + width).astype(np.uint64)))
    order = np.lexsort((doc[row], told))
    head = np.concatenate([[True], told[order][1:] != told[order][:-1]])
    first = np.flatnonzero(head)
    lead = order[np.repeat(first, np.diff(np.append(first, len(order))))]  # the window of the smallest document that hashes alike
    later = doc[row[order]] > doc[row[lead]]
    mine, other = order[later], lead[later]
    pairs, which = np.unique(row[mine] * len(texts) + row[other], return_inverse=True)
    words: dict[int, list[bytes]] = {}
    reach = np.empty((len(pairs), 2), np.int64)
    for k, (i, j) in enumerate(zip(*divmod(pairs, len(texts)), strict=True)):
        if left[i] == left[j] and texts[i] == texts[j]:
            reach[k] = left[i], counts[i] - left[i]
        else:
            a, b = (words.setdefault(x, texts[x].split()) for x in (int(i), int(j)))
            reach[k] = common_words(a[: left[i]][::-1], b[: left[j]][::-1]), common_words(a[left[i] :], b[left[j] :])
    before = left[row[mine]] - begin[mine]
    sure = (before <= reach[which, 0]) & (width - before <= reach[which, 1])
    gone = [mine[sure]]
    if not sure.all():  # windows that only hash alike: among those, equal words decide
        odd = np.unique(told[mine[~sure]])
        some = order[np.isin(told[order], odd)]  # by hash, and then by document
        least: dict[tuple, int] = {}
        again = []
        for w in some.tolist():
            i = int(row[w])
            cut = words.setdefault(i, texts[i].split())[begin[w] : begin[w] + width]
            smallest = least.setdefault((int(key[i]), int(begin[w] - left[i]), *cut), int(doc[i]))
            if doc[i] > smallest:
                again.append(w)
        gone.append(np.array(again, np.int64))
    gone = np.unique(np.concatenate(gone))
    if len(gone) == 0:
        return np.zeros(0, _SPAN)
    found = spans(row[gone], np.zeros(len(gone), np.int64), begin[gone], width)
    places = [np.frombuffer(table.column("places")[int(i)].as_py(), "<i4") for i in found["doc"]]
    n = np.array([len(p) for p in places])
    shift = np.concatenate(places) - np.repeat(left[found["doc"]], n)
    out = np.empty(len(shift), _SPAN)
    out["doc"], out["tag"] = doc[np.repeat(found["doc"], n)], tag[np.repeat(found["doc"], n)]
    out["start"], out["end"] = np.repeat(found["start"], n) + shift, np.repeat(found["end"], n) + shift
    return out


def repeats(width: int):
    """mapInArrow over contexts sorted by (gkey, left, context, id): spans (id, tag, spans) that go."""

    def by_document(found: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate([np.zeros(0, _SPAN), *found])
        every = every[np.lexsort((every["tag"], every["doc"]))]
        first = np.flatnonzero((every["doc"] != np.roll(every["doc"], 1)) | (every["tag"] != np.roll(every["tag"], 1)) | (np.arange(len(every)) == 0))
        ends = np.append(first, len(every))[1:]
        pairs = np.stack([every["start"], every["end"]], axis=1).astype("<i4")
        return pa.RecordBatch.from_arrays([pa.array(every["doc"][first]), pa.array(every["tag"][first]), pa.array([pairs[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary())], ["id", "tag", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[np.ndarray] = []
        for table in whole_groups(one_of_each(batches, known, width), "gkey"):
            known.append(extend(table, width))
            if sum(map(len, known)) > 1 << 16:
                yield by_document(known)
                known.clear()
        yield by_document(known)

    return run


def cut_words(text: str | None, blobs: list[bytes] | None) -> tuple[int, int, bytes]:
    """Words, words removed, and the words kept joined by one space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not blobs:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int32)
    for a, b in np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 2):
        gone[a] += 1
        gone[b] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove_repeats(docs: DataFrame, min_words: int = 50, gram: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with columns n_words, n_removed and kept_text added.

    A word goes when a window of ``min_words`` words around it also starts in a document
    with a smaller id; windows are judged on the input, on their words. Texts with fewer
    words lose none. Null texts have no words and an empty kept_text. Rows with a null id
    lose nothing and are nobody's earlier copy. Rows that repeat an id with the same text
    share its result, with another text they are judged apart, and neither is the other's
    earlier copy. Extra columns are kept; columns named n_words, n_removed or kept_text are
    replaced. An empty table gives an empty result.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    where = names.index(at[text])
    # the texts are dealt by id once, for both joins below
    wide = docs.toDF(*names).withColumn("id", F.col(at[id_col]).cast("long")).withColumn("tag", F.xxhash64(F.col(at[text])))
    buckets = max(shuffle_width(docs.sparkSession), -(-text_bytes(docs, text) // (4 * BUCKET_BYTES)))
    marks = (
        wide.where("id is not null").select("id", "tag", at[text]).where(F.col(at[text]).isNotNull())
        .mapInArrow(lean(ship_seeds(min_words, gram)), "anchor long, doc long, tag long, at int")
        .repartition(buckets, "anchor")
        .sortWithinPartitions("anchor", "doc", "tag", "at")
        .mapInArrow(lean(shared_seeds), "id long, tag long, marks binary")
    )
    marks = marks.groupBy("id", "tag").agg(F.collect_list("marks").alias("marks"))
    # a left join, as below, so that one exchange serves both; documents without marks are passed over
    marked = wide.join(marks, ["id", "tag"], "left").select(*names, "id", "tag", "marks")
    sent = marked.mapInArrow(lean(send_contexts(min_words, gram, where)), _SENT)
    met = sent.repartition(buckets, "gkey").sortWithinPartitions("gkey", "left", "context", "id").mapInArrow(lean(repeats(min_words)), "id long, tag long, spans binary")
    gone = met.groupBy("id", "tag").agg(F.collect_list("spans").alias("spans"))
    joined = wide.join(gone, ["id", "tag"], "left").select(*names, "spans")
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [cut_words(t.as_py(), s.as_py()) for t, s in zip(batch.column(where), batch.column(len(names)), strict=True)]
            kept = pa.array([k for _, _, k in done], pa.binary()).cast(pa.string())
            more = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), kept]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], [*names, "n_words", "n_removed", "kept_text"])

    out = joined.mapInArrow(lean(apply), f"{fields}, n_words long, n_removed long, kept_text string")
    return out.toDF(*docs.columns, "n_words", "n_removed", "kept_text")


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, CAST(p AS BIGINT) AS p, array_to_string(words[p + 1 : p + 50], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS p FROM w WHERE len(words) >= 50)
), least AS (SELECT win, min(doc_id) AS m FROM win GROUP BY win),
bad AS (SELECT DISTINCT w.doc_id, w.p FROM win w JOIN least l ON w.win = l.win WHERE l.m < w.doc_id),
gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(p + 1, p + 51)) AS i FROM bad) GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, w.words, CASE WHEN g.gone IS NULL THEN w.words ELSE
    list_transform(list_filter(range(1, len(w.words) + 1), lambda i: NOT list_contains(g.gone, i)), lambda i: w.words[i]) END AS kept
  FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(kept) AS BIGINT) AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM kept
"""
