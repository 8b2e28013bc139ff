"""Best-fit packing of token sequences by the sum-of-squares rule.

Documents become token ids, then an end id; one longer than the capacity is cut into full pieces and a rest. A piece is
placed in that open bin with room for it by which the squared counts of open bins per residual gap become smallest; a
new bin is opened only where none has room. With N(g) open bins of gap g, a piece of s tokens put into gap g changes the
sum by 2 * (N(g - s) - N(g)) + 2 (full bins count nothing), so one vector operation over the gaps finds the place.

Pieces are dealt by a hash of their content into groups of bounded size (GROUP_PIECES), each packed by one task from its
longest piece to its shortest; only ids, lengths and checksums are shuffled, never text or tokens. What lies in the
emptiest bins at a group's end, a share LOOSE of its pieces at most, is packed again together with that of the other
groups, in rounds that end with a single group. So what is lost doesn't grow with the number of groups.

Edge cases: null and empty texts are one end id; repeated rows are packed each; a null id is packed under null; other
columns are ignored; an empty table gives no rows. Ties go to the smaller gap, so equal input gives equal output; only
rows that are equal in id and tokens are dealt by their place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, ship, slices, utf8
from .token_counts import BATCH_BYTES, merger

#: Pieces that one task packs, at most about.
GROUP_PIECES = 65_536
#: Part of a group's pieces that is packed again with those of other groups, at most: 1 in so many.
LOOSE = 16


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, deal): every document's ids and its end id, cut at the capacity.

    deal is a hash of the id and the ids, and for a repetition within a task also of its place."""
    end = np.array([end_id], "<u4").tobytes()

    def make(batches):
        own, task, seen = merger(vocabulary), TaskContext.get().partitionId(), set()
        for b in batches:
            texts, keys = utf8(b.column(1)), b.column(0)
            names = keys.cast(pa.string()).to_pylist()
            at, piece, start, length, crc, deal = [], [], [], [], [], []
            for i, j in slices(texts, BATCH_BYTES):
                flat, bounds = own.encode([t or b"" for t in texts[i:j]])
                for k in range(i, j):
                    ids = flat[bounds[k - i] : bounds[k - i + 1]].tobytes() + end
                    dealt = zlib.crc32(ids, zlib.crc32(repr(names[k]).encode()))
                    if (len(ids), dealt) in seen:
                        dealt = zlib.crc32(b"%d %d" % (task, len(seen)), dealt)
                    seen.add((len(ids), dealt))
                    for p, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[lo : lo + 4 * capacity]
                        at.append(k)
                        piece.append(p)
                        start.append(lo // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        deal.append(zlib.crc32(b"%d" % p, dealt))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, deal))],
                [id_col, "piece", "start", "length", "ids_crc32", "deal"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(
        make, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, deal long"
    )


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; a new bin has the gap `capacity` and is none of them
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    none = np.iinfo(np.int64).max
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # What the sum of squares gains by each gap from s to the capacity; a bin that gets full leaves the sum.
        gain = 2 * (count[: capacity - s + 1] - count[s:]) + 2
        gain[0] = 1 - 2 * count[s]
        gain[count[s:] == 0] = none
        best = int(gain.argmin())
        if gain[best] < none:
            gap = best + s
            bins[i] = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, bins[i], made = capacity, made, made + 1
        offsets[i] = capacity - gap
        if gap > s:
            open_bins[gap - s].append(int(bins[i]))
            count[gap - s] += 1
    return bins, offsets


def loose_bins(bins: np.ndarray, lengths: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """Which pieces lie in the emptiest of the bins that aren't full, as far as these hold at most so many pieces."""
    if not len(bins):
        return np.zeros(0, bool)
    filled, held = np.bincount(bins, lengths).astype(np.int64), np.bincount(bins)
    order = np.argsort(filled, kind="stable")
    order = order[(filled[order] < capacity) & (np.cumsum(held[order]) <= most)]
    return np.isin(bins, order)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32", "deal", "sequence_id", "offset"]
    types = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, deal long, sequence_id long, offset long, _loose boolean"

    def packed(made: DataFrame, groups: int, turn: int) -> DataFrame:
        def place(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "deal", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
            lengths = pdf["length"].to_numpy()
            bins, pdf["offset"] = sum_of_squares(lengths, capacity)
            pdf["sequence_id"] = turn << 58 | pdf["_group"].to_numpy() << 26 | bins
            pdf["_loose"] = loose_bins(bins, lengths, capacity, len(bins) // LOOSE) if groups > 1 else False
            return pdf[[*names, "_loose"]]

        return made.withColumn("_group", F.pmod(F.col("deal"), F.lit(groups))).groupBy("_group").applyInPandas(place, types)

    made, parts, turn = cut(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces"), [], 0
    while True:
        groups = max(1, -(-made.count() // GROUP_PIECES))
        whole = packed(made, groups, turn)
        if groups > 1:
            whole = cut(whole, "packed")
        parts.append(whole.where("not _loose"))
        if groups == 1:
            break
        made, turn = whole.where("_loose"), turn + 1
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    return whole.drop("deal", "_loose")
