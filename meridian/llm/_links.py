"""From postings to links and components, without cross joins and without all pairs of a group of copies.

Postings (key, id, size) name sets that may be similar: sets of equal key. The work goes in rounds, so that a large
group of similar sets costs one comparison a member and not one a pair, and yet no link between components is lost:

1. In each key's tile, cut into bands of size, every set is compared with the smallest of its band. Tiles whose members
   then lie in one component are done.
2. In a share of the others, every set is compared with one that is drawn by a hash of tile and id. A group of similar
   sets has another such pivot in each tile, so it falls together even if its smallest set is an outlier.
3. In tiles that still hold several components, every set is compared with the one of another component of which sizes
   and bitmaps promise most.
4. In what then is left all pairs of different components whose sizes and bitmaps allow enough overlap are compared. So
   no link between components is lost, whatever the rounds before have found.

Comparisons are exact; the caller brings them as `verify`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, forget

#: Least bits of a set's bitmap. A set has twice to four times its size, in powers of two, so that bitmaps never fill up.
BITMAP_BITS = 512
#: Rows compared at a time with what a tile holds so far; bounds the memory of a comparison.
TILE_ROWS = 512
#: Rows of a tile in which every row is looked at for a partner, at most.
SMALL_TILE = 24
#: Pairs that a comparison holds before it hands them on.
PAIR_BATCH = 50_000
#: Pivots by chance are drawn in one tile of so many.
CHANCE_SHARE = 4


def bitmap(members: np.ndarray) -> bytes:
    """Each member toggles one bit, so the bits that differ between two sets are at most the members that differ."""
    bits = max(BITMAP_BITS, 2 << len(members).bit_length())
    flips = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (one a row) of fewer 64-bit words: as if made with fewer bits at once."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def most_overlap(bits_a: np.ndarray, bits_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """An upper bound of the overlap: bits that differ are members that differ."""
    apart = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1).astype(np.int64)
    return np.minimum((size_a.astype(np.int64) + size_b - apart) // 2, np.minimum(size_a, size_b))


def overlap_possible(bits_a: np.ndarray, bits_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * overlap >= percent * union can hold."""
    most = most_overlap(bits_a, bits_b, size_a, size_b)
    return 100 * most >= percent * (size_a.astype(np.int64) + size_b - most)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def partnered(of: np.ndarray, size: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of small groups (of: group numbers, rows in order of size) have another row in their group with which
    the similarity can hold, if the group's key is the first that the two sets share: then the overlap is at most what is
    left of either set from the key on."""
    ok = np.zeros(len(of), bool)
    for d in range(1, SMALL_TILE):
        if d >= len(of):
            break
        same = of[d:] == of[:-d]
        if not same.any():
            break
        most = np.minimum(left[d:], left[:-d])
        fits = same & (100 * most >= percent * (size[d:] + size[:-d] - most))
        ok[d:] |= fits
        ok[:-d] |= fits
    return ok


def tiles(postings: DataFrame, percent: int, prune: bool = True) -> DataFrame:
    """(key, id, size, pivot) of keys with at least two ids; pivot is the smallest set of the row's band of sizes.

    Postings may have a column `left`: members from the key on, in the order in which keys are posted. Rows of small
    tiles that no other row can be similar to are left out."""
    step = math.log(100 / percent)

    def group(batches):
        held = None  # the last row so far; whether its key goes on isn't known yet
        first_size, band, pivot, many = 0, -1, 0, False  # of the held row's key; many: it has had rows before
        for batch in batches:
            key, ids, packed = _columns(batch)
            if held is not None:
                key, ids, packed = (np.append(h, x) for h, x in zip(held, (key, ids, packed), strict=True))
            if not len(key):
                continue
            new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
            key, ids, packed = key[new], ids[new], packed[new]
            size, left = packed >> 32, packed & 0xFFFFFFFF
            starts = np.append(True, key[1:] != key[:-1])
            begin = np.flatnonzero(starts)
            of = np.cumsum(starts) - 1
            firsts = size[begin].astype(np.int64)
            carried = held is not None and many
            if carried:
                firsts[0] = first_size
            bands = np.floor(np.log(np.maximum(size, 1) / np.maximum(firsts[of], 1)) / step + 1e-9).astype(np.int64)
            lead = starts | np.append(True, bands[1:] != bands[:-1])
            pivots = ids[np.flatnonzero(lead)][np.cumsum(lead) - 1]
            if carried and bands[0] == band:
                same = (of == 0) & (bands == band)
                pivots[same] = pivot
            follows = np.append(~starts[1:], False)
            alone = starts & ~follows
            if carried:
                alone[0] = False
            keep = ~alone
            keep[-1] = False
            if prune and keep.any():
                at = np.flatnonzero(keep)
                members = np.bincount(of[at], minlength=int(of[-1]) + 1)
                whole = (members <= SMALL_TILE) & (np.arange(len(members)) < of[-1])  # the last one may go on
                whole[0] &= not carried
                keep[at] = ~whole[of[at]] | partnered(of[at], size[at], left[at], percent)
            if keep.any():
                yield _tile_batch(key[keep], ids[keep], size[keep], pivots[keep])
            many = bool(not starts[-1] or (carried and of[-1] == 0))
            held = (key[-1:], ids[-1:], packed[-1:])
            first_size, band, pivot = int(firsts[of[-1]]), int(bands[-1]), pivots[-1]
        if held is not None and many:
            yield _tile_batch(held[0], held[1], held[2] >> 32, np.array([pivot], np.int64))

    left = F.col("left" if "left" in postings.columns else "size").cast("long")
    packed = (F.shiftleft(F.col("size").cast("long"), 32) + left).alias("packed")  # in the order of sizes
    dealt = postings.select("key", "id", packed).repartition("key").sortWithinPartitions("key", "packed", "id")
    return dealt.mapInArrow(group, "key long, id long, size int, pivot long")


def _tile_batch(key, ids, size, pivot) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(size, pa.int32()), pa.array(pivot, pa.int64())], ["key", "id", "size", "pivot"])


def _by_length(rows: list[bytes]) -> dict[int, np.ndarray]:
    """Row numbers by the length of their bitmaps in 64-bit words."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows)) // 8
    return {int(m): np.flatnonzero(lengths == m) for m in np.unique(lengths)}


def _matrix(rows: list[bytes], at: np.ndarray, words: int) -> np.ndarray:
    return np.frombuffer(b"".join([rows[i] for i in at.tolist()]), np.uint64).reshape(len(at), words)


def promising(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps of features (id, size, bits) allow."""

    def test(batches):
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            size_a, size_b = (b.column(i).to_numpy() for i in (4, 5))
            ok = np.zeros(b.num_rows, bool)
            for m, rows in _by_length(x).items() if x else ():
                for n, of in _by_length([y[i] for i in rows.tolist()]).items():
                    at, words = rows[of], min(m, n)
                    ok[at] = overlap_possible(folded(_matrix(x, at, m), words), folded(_matrix(y, at, n), words), size_a[at], size_b[at], percent)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])

    of = lambda side: features.select(F.col("id").alias(side), F.col("bits").alias(f"bits_{side}"), F.col("size").cast("int").alias(f"size_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "bits_a", "bits_b", "size_a", "size_b")
    return both.mapInArrow(test, "a long, b long")


class Tile:
    """What of one key has been seen, in order of size, by the length of the bitmaps."""

    def __init__(self):
        self.seen: dict[int, list[np.ndarray]] = {}

    def pairs(self, ids: np.ndarray, size: np.ndarray, root: np.ndarray, bits: np.ndarray, percent: int, best: bool):
        """Add rows of bitmaps of one length; pairs of ids of different roots with them that may be similar: all, or
        that of the greatest bound for each row."""
        words, least = bits.shape[1], int(size[0]) * percent
        self.seen = {m: [x[keep] for x in rows] for m, rows in self.seen.items() if (keep := rows[1].astype(np.int64) * 100 >= least).any()}
        before = {m: len(rows[0]) for m, rows in self.seen.items()}
        own = self.seen.setdefault(words, [x[:0] for x in (ids, size, root, bits)])
        self.seen[words] = [np.concatenate(x) for x in zip(own, (ids, size, root, bits), strict=True)]
        for m, (ids_m, size_m, root_m, bits_m) in self.seen.items():
            mine = folded(bits, m) if m < words else bits
            for t in range(len(ids)):
                n = before.get(m, 0) + (t if m == words else 0)
                at = np.flatnonzero((root_m[:n] != root[t]) & (size_m[:n].astype(np.int64) * 100 >= int(size[t]) * percent))
                if len(at):
                    most = most_overlap(bits_m[at], mine[t], size_m[at], np.full(len(at), size[t]))
                    ok = 100 * most >= percent * (size_m[at].astype(np.int64) + int(size[t]) - most)
                    at, most = at[ok], most[ok]
                    if best and len(at):
                        at = at[[int(most.argmax())]]
                    if len(at):
                        yield ids_m[at], np.full(len(at), ids[t])


def cross_pairs(rest: DataFrame, percent: int, best: bool) -> DataFrame:
    """Distinct pairs (a, b) of different roots in a tile that sizes and bitmaps allow, or the best of them for each row;
    rest: key, id, size, root, bits."""

    def batch(found):
        x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def compare(batches):
        key, tile, found, held = None, Tile(), [], 0
        for b in batches:
            keys, ids, size, root = (b.column(i).to_numpy() for i in range(4))
            rows = b.column(4).to_pylist()
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (lengths[1:] != lengths[:-1]))) if len(keys) else keys
            for lo, hi in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
                if keys[lo] != key:
                    key, tile = keys[lo], Tile()
                for s in range(lo, hi, TILE_ROWS):
                    at = np.arange(s, min(s + TILE_ROWS, hi))
                    for pair in tile.pairs(ids[at], size[at], root[at], _matrix(rows, at, int(lengths[lo]) // 8), percent, best):
                        found.append(pair)
                        held += len(pair[0])
                        if held >= PAIR_BATCH:
                            yield batch(found)
                            found, held = [], 0
        if found:
            yield batch(found)

    dealt = rest.select("key", "id", "size", "root", "bits").repartition("key").sortWithinPartitions("key", "size", "id")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every linked id: root is the smallest id that can be reached. Large and small stars in turn."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    sums = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = sums(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, edges = edges, cut(small.distinct(), "edges")
        forget(old)
        now = sums(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def linked_components(postings: DataFrame, features: DataFrame, verify: Callable[[DataFrame], tuple[DataFrame, list[DataFrame]]], percent: int) -> DataFrame:
    """(id, root) of all ids with a link. postings: key, id, size; features: id, size, bits of every id, once; verify
    takes pairs (a, b) and returns those that are truly similar, and tables that it has written for that."""

    def checked(pairs: DataFrame, links: DataFrame | None) -> DataFrame:
        similar, tables = verify(pairs)
        made = cut(links.unionByName(similar) if links is not None else similar, "links")
        forget(pairs, *tables, *([links] if links is not None else []))
        return made

    grouped = cut(tiles(postings, percent), "tiles")
    stars = grouped.where("id != pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    links = checked(cut(promising(stars, features, percent), "pairs"), None)
    found = cut(components(links), "components")
    rest = _several(grouped, found)
    some = rest.where(F.pmod(F.xxhash64("key"), F.lit(CHANCE_SHARE)) == 0)
    drawn = some.groupBy("key", "pivot").agg(F.min(F.struct(F.xxhash64("key", "id"), F.col("id").alias("other"), F.col("root").alias("other_root"))).alias("p"))
    stars = some.join(drawn, ["key", "pivot"]).where("root != p.other_root").select(F.least("id", "p.other").alias("a"), F.greatest("id", "p.other").alias("b")).distinct()
    pairs = promising(stars, features, percent)
    for turn in ("chance", "best", "all"):
        if turn != "chance":
            rest = _several(rest, found)
            pairs = cross_pairs(rest.join(features.select("id", "bits"), "id"), percent, best=turn == "best")
        pairs = cut(pairs, "pairs")
        if not pairs.isEmpty():
            links, old = checked(pairs, links), found
            found = cut(components(links), "components")
            forget(old)
    forget(rest, links)
    return found


def _several(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """Tiles whose members lie in several components, with each member's root; the written table takes the place of
    `tiles`. Components only grow together, so a tile that is left out needn't be looked at again."""
    rooted = tiles.select("key", "id", "size", "pivot").join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = cut(rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key"), "mixed")
    made = cut(rooted.join(mixed, "key"), "rest")
    forget(tiles, mixed)
    return made
