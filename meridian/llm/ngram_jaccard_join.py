"""N-gram Jaccard join: which documents share at least 80 % of their distinct five-word shingles.

A document is the sorted array of its shingles' 64-bit hashes. Documents of equal sets are one class at once. Two sets
of 80 % similarity share a shingle among the first fifth of either, in any order that is the same for both; rare
shingles come first here, as shingles that many documents of a partition share are counted and put last by how frequent
they are. Each set is posted under those shingles, and what meets under one makes a tile, worked in bands of size:
bitmaps of hashed members bound the overlap from above, and the sorted arrays of what is left are intersected exactly.
The order changes only how much there is to compare, never the result.

Edge cases: null and empty texts (or white space alone) have no shingles, are linked with nothing and form their own
class; a text of fewer words is one shingle; repeated rows give a row each; a null id is never a class's number; rows of
one id and different texts are each in their own text's class; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._links import bitmap, linked_components
from ._shared import cut, first_of_equals, forget, hashed_words, id_filter, jaccard_at_least, set_id, ship, shingle_sets, signed, slices, utf8

#: Shingles are counted over so many at a time within a partition; those met fewer times there aren't reported.
COUNT_BLOCK, COUNT_LEAST = 2_000_000, 2
#: Frequent shingles that are put last, at most; 9 bytes each in memory. Which they are changes the cost alone.
MOST_FREQUENT, FREQUENT_LEAST = 500_000, 8


def prefix_length(n: np.ndarray | int, percent: int):
    """Any set that reaches the similarity shares a shingle among the first so many of n."""
    return n - -(-n * percent // 100) + 1


def set_arrays(texts: list[bytes | None], k: int):
    hashes, starts, offsets, _ = hashed_words(texts)
    return shingle_sets(hashes, np.searchsorted(starts, offsets), k)


def signatures(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document: (id, size, sid: number of its set, th: hash of its text, bits); and rows (key, n) of
    frequent shingles."""

    def sign(batches):
        block, held, seen = [], 0, set()

        def frequent():
            values = np.concatenate(block)
            values.sort()
            starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            values, counts = values[starts], np.diff(np.append(starts, len(values)))
            keep = counts >= COUNT_LEAST
            n = int(keep.sum())
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, key_type), none, none, none, pa.nulls(n, pa.binary()), pa.array(signed(values[keep]), pa.int64()), pa.array(counts[keep], pa.int64())], names
            )

        names, key_type = ["id", "size", "sid", "th", "bits", "key", "n"], None
        for b in batches:
            key_type, texts = b.column(0).type, utf8(b.column(1))
            for lo, hi in slices(texts):
                sizes, sids, bits = [], [], []
                for s in set_arrays(texts[lo:hi], k):
                    sizes.append(len(s))
                    sids.append(set_id(s))
                    bits.append(bitmap(s))
                    if sids[-1] not in seen:
                        seen.add(sids[-1])
                        block.append(s)
                        held += len(s)
                        if held >= COUNT_BLOCK:
                            yield frequent()
                            block, held = [], 0
                n = hi - lo
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), b.column(2)[lo:hi], pa.array(bits, pa.binary()), none, none], names)
        if block:
            yield frequent()

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    return picked.mapInArrow(sign, f"id {kind}, size long, sid long, th long, bits binary, key long, n long")


def frequent_shingles(signed_rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and frequency classes (log2) of the most frequent shingles."""
    counted = signed_rows.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST)
    counted = cut(counted, "frequent")
    if counted.count() > MOST_FREQUENT:
        counted = counted.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT)
    got = counted.toPandas()
    order = np.argsort(got["key"].to_numpy(np.int64).view(np.uint64))
    return got["key"].to_numpy(np.int64).view(np.uint64)[order], np.log2(got["n"].to_numpy(np.float64)[order]).astype(np.uint64)


def postings(docs: DataFrame, frequent, percent: int, k: int, text_col: str) -> DataFrame:
    """(key, id: number of the set, size, left: members from this one on in the order of keys) for the rarest shingles of
    each set, once for equal sets of a partition."""

    def post(batches):
        known, classes = frequent.value
        seen: set[int] = set()
        for b in batches:
            texts = utf8(b.column(0))
            for lo, hi in slices(texts):
                keys, left, ids, sizes, counts = [], [], [], [], []
                for s in set_arrays(texts[lo:hi], k):
                    if not len(s) or (sid := set_id(s)) in seen:
                        continue
                    seen.add(sid)
                    order = s >> np.uint64(6)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        order = order | np.where(known[at] == s, classes[at], np.uint64(0)) << np.uint64(58)
                    m = int(prefix_length(len(s), percent))
                    keys.append(np.sort(np.partition(order, m - 1)[:m]))
                    left.append(len(s) - np.arange(m))
                    ids.append(sid)
                    sizes.append(len(s))
                    counts.append(m)
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(np.concatenate(keys)), pa.int64()), pa.array(np.repeat(ids, counts), pa.int64()), pa.array(np.repeat(sizes, counts), pa.int32()), pa.array(np.concatenate(left), pa.int32())],
                        ["key", "id", "size", "left"],
                    )

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(post, "key long, id long, size int, left int")


def verified(pairs: DataFrame, content: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sorted arrays, by content (id, members), reach the similarity."""

    def check(batches):
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = pa.array([jaccard_at_least(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    of = lambda side: content.select(F.col("id").alias(side), F.col("members").alias(f"members_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "members_a", "members_b").mapInArrow(check, "a long, b long")


def members(docs: DataFrame, wanted: DataFrame, k: int, text_col: str) -> DataFrame:
    """(id, members) of the wanted (id, th) sets: one row for each, made again from texts of the hash th."""
    passes = id_filter(wanted, "th")

    def make(batches):
        ok, seen = passes(), set()
        for b in batches:
            b = b.filter(pa.array(ok(b.column(1).to_numpy(zero_copy_only=False))))
            texts = utf8(b.column(0))
            for lo, hi in slices(texts):
                ids, rows = [], []
                for s in set_arrays(texts[lo:hi], k):
                    if len(s) and (sid := set_id(s)) not in seen:
                        seen.add(sid)
                        ids.append(sid)
                        rows.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["id", "members"])

    text = F.col(text_col).cast("string")
    made = docs.select(text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(make, "id long, members binary")
    return made.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def classes(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th: hash of the text, size, root: number of the class, null without shingles) for every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    rows = cut(signatures(docs, k, id_col, text_col), "signatures")
    sent = spark.sparkContext.broadcast(frequent_shingles(rows))
    sets = rows.where("sid is not null")
    features = cut(sets.where("size > 0").groupBy(F.col("sid").alias("id")).agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("th").alias("th")), "features")

    def verify(pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        wanted = cut(ids_of(pairs).join(features.select("id", "th"), "id"), "wanted")
        content = cut(members(docs, wanted, k, text_col), "members")
        return verified(pairs, content, percent), [wanted, content]

    found = linked_components(postings(docs, sent, percent, k, text_col), features, verify, percent)
    forget(features)
    rooted = sets.where("size > 0").select("id", "th", "size", "sid").join(found.withColumnRenamed("id", "sid"), "sid", "left")
    return rooted.select("id", "th", "size", F.coalesce("root", "sid").alias("root")).unionByName(sets.where("size = 0").select("id", "th", "size", F.lit(None).cast("long").alias("root")))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs."""
    rows = classes(docs, percent, k, id_col, text_col)
    linked = rows.where("root is not null")
    least = cut(linked.groupBy("root").agg(F.min("id").alias("component_id")), "least")  # so that Spark can split a large class
    whole = linked.join(least, "root").select("id", "size", "component_id").unionByName(rows.where("root is null").select("id", "size", F.col("id").alias("component_id")))
    return whole.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def without_near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, that of the smallest id (nulls last; of one id, that of the smallest hash of the
    text), and all rows without shingles. A row goes by its id and text, so another text of the same id isn't touched."""
    rows = cut(classes(docs, percent, k, id_col, text_col), "classes")
    texts = rows.where("root is not null").groupBy("id", "th").agg(F.first("root").alias("root"), F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("id").isNull(), "id", "th")
    least = cut(texts.groupBy("root").agg(F.min(rank).alias("least")), "least")
    gone = texts.join(least, "root").where(rank != F.col("least")).select("id", "th")
    hashed = docs.withColumn("_nj_text", F.xxhash64(F.col(text_col).cast("string")))
    kept = hashed.join(gone, hashed[id_col].eqNullSafe(gone["id"]) & (hashed["_nj_text"] == gone["th"]), "left_anti")
    return first_of_equals(kept, texts.where("n > 1").select("id", "th"), id_col, "_nj_text", "_nj_first").where("_nj_first").select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
with recursive docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct r, array_to_string(list_slice(w, i, i + 4), ' ') as s from (select r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from docs where len(w) > 0)
), sizes as (select r, count(*) as n from shingles group by r),
links as (
  select x.r as a, y.r as b from shingles x join shingles y on x.s = y.s join sizes m on m.r = x.r join sizes n on n.r = y.r
  where x.r < y.r and 100 * least(m.n, n.n) >= 80 * greatest(m.n, n.n) group by x.r, y.r having 100 * count(*) >= 80 * (any_value(m.n) + any_value(n.n) - count(*))
), edges as (select a, b from links union all select b, a from links),
reached(a, b) as (select r, r from docs union select c.a, e.b from reached c join edges e on e.a = c.b),
least_id as (select c.a as r, min(d.doc_id) as component_id from reached c join docs d on d.r = c.b group by c.a)
select d.doc_id, coalesce(s.n, 0) as n_shingles, l.component_id from docs d left join sizes s on s.r = d.r join least_id l on l.r = d.r
"""
