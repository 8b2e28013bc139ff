"""Substring dedup: similar paragraphs by MinHash banding, and repeated runs of words wherever they stand.

A paragraph is a line of at least min_words words. Paragraphs of equal words are one at once. The others are posted
under bands of MinHash values over their five-word shingles, with as many bands as a recall at the similarity asks for
(`bands_for`). Paragraphs that collide are verified by exact Jaccard similarity of their shingles, and verified links
make clusters. Of each cluster the first occurrence, by (id, paragraph), stays; the others are removals.

A passage is a run of at least WINDOW words that stands elsewhere word for word (A-Z counting as a-z, any white space
between the words), in whatever lines. Every window of WINDOW words is known by the least hash among its runs of GRAM
words, its anchor; equal windows have equal anchors, so only windows whose anchor occurs twice are counted (`passages`).

Edge cases: null and empty texts and texts without a long enough line have no paragraphs and no rows; a paragraph that
repeats within one document counts as an occurrence each time; a null id comes first in order; other columns are ignored;
an empty table gives no rows. Rows are known by id and text_hash (the xxhash64 of the text), so texts of one id aren't
mixed up. Rows that are equal in both count as occurrences each; where parts are removed, one of them counts as the first
and the others lose all that repeats. Occurrences of a window that overlap in one document are one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._links import bitmap, linked_components
from ._shared import _ODD, _shingled, cut, first_of_equals, forget, hashed_words, id_filter, mixed, set_id, ship, shingle_sets, signed, slices, utf8
from .ngram_jaccard_join import ids_of, verified

#: MinHash values of a band.
ROWS = 4
#: Words of the shortest passage, and of the runs that lead to it.
WINDOW, GRAM = 50, 26


def bands_for(percent: int, recall: float, rows: int = ROWS) -> int:
    """Least number of bands that finds a pair of exactly this similarity with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


def min_hashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n MinHash values of each set (none of them empty), as a matrix."""
    whole = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    rng = np.random.default_rng(20240229)
    out = np.empty((len(sets), n), np.uint64)
    for i in range(n):
        factor, shift = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
        out[:, i] = np.minimum.reduceat((whole ^ shift) * (factor << np.uint64(1) | np.uint64(1)), starts)
    return out


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each set."""
    keys = np.empty((len(values), values.shape[1] // rows), np.uint64)
    for b in range(keys.shape[1]):
        key = np.full(len(values), b + 1, np.uint64)
        for i in range(rows):
            key = mixed(key + values[:, b * rows + i])
        keys[:, b] = key
    return keys


def _paragraphs(texts: list[bytes | None], min_words: int, k: int):
    """(text number, line number, start and end byte in the text, number of the words, set of shingles) of every
    paragraph of some texts."""
    hashes, starts, offsets, whole = hashed_words(texts)
    ends = np.flatnonzero(np.frombuffer(whole, np.uint8) == 10)  # each text ends with a line feed of its own
    begins = np.append(0, ends[:-1] + 1)
    bounds = np.searchsorted(starts, np.append(begins, len(whole)))
    text_of = np.searchsorted(offsets, begins, "right") - 1
    first_line = np.searchsorted(begins, offsets[:-1])
    long = np.flatnonzero(np.diff(bounds) >= min_words)
    for i, s in zip(long.tolist(), shingle_sets(hashes, bounds, k, long), strict=True):
        t = int(text_of[i])
        yield t, i - int(first_line[t]), int(begins[i] - offsets[t]), int(ends[i] - offsets[t]), set_id(hashes[bounds[i] : bounds[i + 1]]), s


def paragraphs(docs: DataFrame, min_words: int, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, start, end, sid: number of its words, size: of its set of shingles, th: hash of its text, bits) of
    every paragraph; start and end in code points."""

    def find(batches):
        for b in batches:
            texts = utf8(b.column(1))
            for lo, hi in slices(texts):
                out: list[list] = [[] for _ in range(7)]
                points, of = None, -1
                for t, i, start, end, sid, s in _paragraphs(texts[lo:hi], min_words, k):
                    if t != of:
                        of, text = t, texts[lo + t] or b""
                        points = None if text.isascii() else np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                    if points is not None:
                        start, end = int(points[start]), int(points[end])
                    for column, value in zip(out, (lo + t, i, start, end, sid, len(s), bitmap(s)), strict=True):
                        column.append(value)
                at = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:6]), b.column(2).take(at), pa.array(out[6], pa.binary())],
                    ["id", "paragraph", "start", "end", "sid", "size", "th", "bits"],
                )

    kind, text = docs.schema[id_col].dataType.simpleString(), F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    return picked.mapInArrow(find, f"id {kind}, paragraph int, start long, end long, sid long, size long, th long, bits binary")


def _new_paragraphs(texts: list[bytes | None], min_words: int, seen: set[int], k: int) -> list[tuple[int, np.ndarray]]:
    found = []
    for *_, sid, s in _paragraphs(texts, min_words, k):
        if sid not in seen:
            seen.add(sid)
            found.append((sid, s))
    return found


def postings(docs: DataFrame, min_words: int, bands: int, k: int, text_col: str) -> DataFrame:
    """(key, id: number of the paragraph's words, size) for every band, once for equal paragraphs of a partition."""

    def post(batches):
        seen: set[int] = set()
        for b in batches:
            texts = utf8(b.column(0))
            for lo, hi in slices(texts):
                found = _new_paragraphs(texts[lo:hi], min_words, seen, k)
                if found:
                    keys = band_keys(min_hashes([s for _, s in found], bands * ROWS))
                    ids, sizes = np.array([i for i, _ in found]), np.array([len(s) for _, s in found], np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(keys.ravel()), pa.int64()), pa.array(np.repeat(ids, bands), pa.int64()), pa.array(np.repeat(sizes, bands), pa.int32())], ["key", "id", "size"]
                    )

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(post, "key long, id long, size int")


def members(docs: DataFrame, wanted: DataFrame, min_words: int, k: int, text_col: str) -> DataFrame:
    """(id, members) of the wanted (id, th) paragraphs, made again from texts of the hash th."""
    texts_pass, ids_pass = id_filter(wanted, "th"), id_filter(wanted, "id")

    def make(batches):
        text_ok, id_ok, seen = texts_pass(), ids_pass(), set()
        for b in batches:
            b = b.filter(pa.array(text_ok(b.column(1).to_numpy(zero_copy_only=False))))
            texts = utf8(b.column(0))
            for lo, hi in slices(texts):
                found = _new_paragraphs(texts[lo:hi], min_words, seen, k)
                if found:
                    keep = id_ok(np.array([i for i, _ in found], np.int64))
                    found = [f for f, x in zip(found, keep, strict=True) if x]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["id", "members"])

    text = F.col(text_col).cast("string")
    made = docs.select(text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(make, "id long, members binary")
    return made.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])


def repeats(docs: DataFrame, min_words: int = 30, percent: int = 80, recall: float = 0.999, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, paragraph, start, end, first_id, first_paragraph, n_occurrences, removed) of every paragraph that
    occurs more than once; a cluster is known by its first occurrence."""
    ship(docs.sparkSession)
    found = cut(paragraphs(docs, min_words, k, id_col, text_col), "paragraphs")
    features = cut(found.groupBy(F.col("sid").alias("id")).agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("th").alias("th")), "features")

    def verify(pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        wanted = cut(ids_of(pairs).join(features.select("id", "th"), "id"), "wanted")
        content = cut(members(docs, wanted, min_words, k, text_col), "members")
        return verified(pairs, content, percent), [wanted, content]

    roots = linked_components(postings(docs, min_words, bands_for(percent, recall), k, text_col), features, verify, percent)
    forget(features)
    rooted = found.select("id", "paragraph", "start", "end", "sid", "th").join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    place = F.struct("id", "paragraph", "start", "th")
    first = cut(rooted.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n_occurrences")).where("n_occurrences > 1"), "firsts")
    whole = cut(rooted.join(first, "root").select(
        F.col("id").alias(id_col), F.col("th").alias("text_hash"), "paragraph", "start", "end", F.col("first.id").alias("first_id"), F.col("first.paragraph").alias("first_paragraph"),
        "n_occurrences", (~place.eqNullSafe(F.col("first"))).alias("removed"),
    ), "repeats")
    forget(found, first)
    return whole


def _windows(texts: list[bytes | None]):
    """Of all windows of some texts: text number, word number in the joined texts, hash, hash of the anchor; and the
    joined texts, the words' starts in them and the texts' offsets."""
    hashes, starts, offsets, whole = hashed_words(texts)
    n = len(hashes) - WINDOW + 1
    if n < 1:
        empty = np.empty(0, np.uint64)
        return empty.astype(np.int64), empty.astype(np.int64), empty, empty, whole, starts, offsets
    grams = _shingled(hashes, GRAM)
    anchor, width = grams, 1
    while width < WINDOW - GRAM + 1:  # minima of ever wider stretches
        step = min(width, WINDOW - GRAM + 1 - width)
        anchor, width = np.minimum(anchor[:-step], anchor[step:]), width + step
    text_of = np.searchsorted(offsets, starts, "right") - 1
    at = np.flatnonzero(text_of[:n] == text_of[WINDOW - 1 :])
    return text_of[at], at, mixed(grams[at] * _ODD[43] + grams[at + WINDOW - GRAM] * _ODD[44]), anchor[at], whole, starts, offsets


def _apart(row: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which windows stay if those that overlap an equal one before them in their text are left out."""
    keep = np.ones(len(at), bool)
    order = np.lexsort((at, h, row))
    same = (row[order[1:]] == row[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
    if (same & (at[order[1:]] - at[order[:-1]] < WINDOW)).any():
        last = 0
        for j, equal in zip(order.tolist(), [False, *same.tolist()], strict=True):
            if equal and at[j] - last < WINDOW:
                keep[j] = False
            else:
                last = int(at[j])
    return keep


def _anchors(docs: DataFrame, text_col: str) -> DataFrame:
    """(id) of every anchor that leads to windows at two places or more."""

    def post(batches):
        for b in batches:
            texts = utf8(b.column(0))
            for lo, hi in slices(texts):
                row, _, _, anchor, *_ = _windows(texts[lo:hi])
                if len(anchor):
                    # One place leads to so many neighbouring windows at most; a longer stretch holds the anchor again.
                    lead = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
                    n = -(-np.diff(np.append(lead, len(anchor))) // (WINDOW - GRAM + 1))
                    found, of = np.unique(anchor[lead], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(np.bincount(of, n).astype(np.int64))], ["id", "n"])

    made = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(post, "id long, n long")
    return made.groupBy("id").agg(F.sum("n").alias("n")).where("n > 1").select("id")


def _candidates(docs: DataFrame, anchors: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, th, id, at, place) of every window of those anchors (and maybe others): the hash of the document's text, the
    window's first word there and its line, and its start and end in code points, two numbers in one long each."""
    passes, kind = id_filter(anchors, "id"), docs.schema[id_col].dataType.simpleString()

    def find(batches):
        ok = passes()
        for b in batches:
            texts = utf8(b.column(1))
            for lo, hi in slices(texts):
                row, at, h, anchor, whole, starts, offsets = _windows(texts[lo:hi])
                if len(at):
                    few, back = np.unique(anchor, return_inverse=True)
                    keep = ok(signed(few))[back]
                    row, at, h = row[keep], at[keep], h[keep]
                keep = _apart(row, at, h)
                row, at, h = row[keep], at[keep], h[keep]
                if not len(at):
                    continue
                data = np.frombuffer(whole, np.uint8)
                space = np.flatnonzero(np.isin(data, [9, 10, 11, 12, 13, 32]))
                first, last = starts[at], starts[at + WINDOW - 1]
                end = space[np.searchsorted(space, last)]
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                feeds = np.flatnonzero(data == 10)
                base = offsets[row]
                line = np.searchsorted(feeds, first) - np.searchsorted(feeds, base)
                words = at - np.searchsorted(starts, base)
                place = points[first] - points[base] << 32 | points[end] - points[base]
                of = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), b.column(2).take(of), pa.array(words << 32 | line), pa.array(place), b.column(0).take(of)], ["h", "th", "at", "place", "id"])

    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    return picked.mapInArrow(find, f"h long, th long, at long, place long, id {kind}")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of repeats() for every passage: a row for each stretch of neighbouring windows that are all first
    occurrences, or that all occur first in one other place's document. first_paragraph is the line in which the first
    of the windows begins there, n_occurrences that of the window that occurs most often."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    anchors = cut(_anchors(docs, text_col), "anchors")
    same = Window.partitionBy("h").orderBy("id", "th", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = _candidates(docs, anchors, id_col, text_col).withColumns(
        {"n": F.count(F.lit(1)).over(same), **{f"first_{c}": F.first(c).over(same) for c in ("id", "th", "at")}}
    )
    removed = ~F.struct("id", "th", "at").eqNullSafe(F.struct(F.col("first_id").alias("id"), F.col("first_th").alias("th"), F.col("first_at").alias("at")))
    whole = found.where("n > 1").select("th", "at", "id", "place", "first_id", F.xxhash64("first_id", "first_th").alias("of"), F.col("first_at").alias("first"), "n", removed.alias("removed"))
    names = [id_col, "text_hash", "paragraph", "start", "end", "first_id", "first_paragraph", "n_occurrences", "removed"]

    def merge(batches):
        held = None  # the last stretch so far, which may go on in the next batch
        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            th, at = (b.column(i).to_numpy() for i in (0, 1))
            again = np.append(False, (th[1:] == th[:-1]) & (at[1:] == at[:-1]) & equal_ids(b.column(2)))  # rows equal in id and text
            if again.any():
                b = b.filter(pa.array(~again))
            th, at, place, of, n, removed = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 5, 7, 8))
            word = at >> 32
            new = np.append(True, (th[1:] != th[:-1]) | (of[1:] != of[:-1]) | (removed[1:] != removed[:-1]) | ~equal_ids(b.column(2)))
            new[1:] |= word[1:] != word[:-1] + 1
            lead = np.flatnonzero(new)
            tail = np.append(lead[1:], len(th)) - 1
            yield shown(b, lead[:-1], place[tail[:-1]], np.maximum.reduceat(n, lead)[:-1])
            held = b.slice(int(lead[-1]))
        if held is not None:
            yield shown(held, np.zeros(1, np.int64), held.column(3).to_numpy()[-1:], held.column(7).to_numpy().max(keepdims=True))

    def equal_ids(ids: pa.Array) -> np.ndarray:
        """Whether each id but the first is the one before it, nulls being equal."""
        before, after = ids.slice(0, max(0, len(ids) - 1)), ids.slice(1)
        nulls = pc.and_(pc.is_null(before), pc.is_null(after))
        return pc.or_(nulls, pc.fill_null(pc.equal(before, after), False)).to_numpy(zero_copy_only=False)

    def shown(b: pa.RecordBatch, lead: np.ndarray, end: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        b = b.take(pa.array(lead))
        at, place, first = (b.column(i).to_numpy() for i in (1, 3, 6))
        line = lambda x: pa.array((x & 0xFFFFFFFF).astype(np.int32))
        return pa.RecordBatch.from_arrays([b.column(2), b.column(0), line(at), pa.array(place >> 32), pa.array(end & 0xFFFFFFFF), b.column(4), line(first), pa.array(n), b.column(8)], names)

    dealt = whole.repartition("id", "th").sortWithinPartitions("id", "th", "at")
    return dealt.mapInArrow(merge, f"`{id_col}` {kind}, text_hash long, paragraph int, start long, end long, first_id {kind}, first_paragraph int, n_occurrences long, removed boolean")


def _with_removals(docs: DataFrame, found: DataFrame, part: Column, id_col: str, text_col: str) -> DataFrame:
    """docs and _sd_gone: the sorted parts of found that a row loses, null where it loses none."""
    gone = found.groupBy(F.col(id_col).alias("id"), F.col("text_hash").alias("th")).agg(
        F.sort_array(F.collect_set(F.when(F.col("removed"), part))).alias("_sd_some"), F.sort_array(F.collect_set(part)).alias("_sd_every")
    )
    hashed = docs.withColumn("_sd_text", F.xxhash64(F.col(text_col).cast("string")))
    many = cut(hashed.groupBy(F.col(id_col).alias("id"), F.col("_sd_text").alias("th")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "th"), "equals")
    marked = first_of_equals(hashed, many, id_col, "_sd_text", "_sd_first")
    joined = marked.join(gone, marked[id_col].eqNullSafe(gone["id"]) & (marked["_sd_text"] == gone["th"]), "left")
    parts = F.when(F.col("_sd_first"), F.col("_sd_some")).otherwise(F.col("_sd_every"))
    return joined.select(*(marked[c] for c in docs.columns), F.when(F.size(parts) > 0, parts).alias("_sd_gone"))


def without_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed places taken from their texts; found is what passages() or repeats() gave, or both."""
    joined = _with_removals(docs, found, F.struct("start", "end"), id_col, text_col)
    piece = f"substring(`{text_col}`, int(a.at) + 1, int(greatest(x.start - a.at, 0L)))"
    step = f"named_struct('kept', concat(a.kept, {piece}), 'at', greatest(a.at, x.end))"
    left = F.expr(f"aggregate(_sd_gone, named_struct('kept', '', 'at', 0L), (a, x) -> {step}, a -> concat(a.kept, substring(`{text_col}`, int(a.at) + 1)))")
    return joined.withColumn(text_col, F.when(F.col("_sd_gone").isNull(), F.col(text_col)).otherwise(left)).select(*(F.col(f"`{c}`") for c in docs.columns))


def without_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with removed paragraphs, and their line ends, taken from their texts; found is what repeats() gave."""
    joined = _with_removals(docs, found, F.col("paragraph"), id_col, text_col)
    left = F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), (x, i) -> not array_contains(_sd_gone, i)), '\\n')")
    return joined.withColumn(text_col, F.when(F.col("_sd_gone").isNull(), F.col(text_col)).otherwise(left)).select(*(F.col(f"`{c}`") for c in docs.columns))
