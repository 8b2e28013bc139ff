"""What the operators of this folder share: lineage cuts, byte-level words, hashing, table access."""

from __future__ import annotations

import atexit
import hashlib
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Bytes of text that a Python worker splits into words at a time; bounds its memory whatever the Arrow batch holds.
SLICE_BYTES = 1_000_000
#: Longer words and chunks are never kept in a worker's caches.
CACHE_WORD_BYTES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the plan restarts from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written = path
    return made


def forget(*frames: DataFrame) -> None:
    """Remove tables that cut() wrote and that nothing will read again."""
    for df in frames:
        _remove(df.sparkSession, df._written)


def first_of_equals(docs: DataFrame, many: DataFrame, id_col: str, hash_col: str, flag: str) -> DataFrame:
    """docs with a flag that is true for one row of each (id, hash) of `many` (columns id, th), and for all rows of others.

    Rows that stand in `many` are numbered in a written table, so that one is chosen by aggregation and stays chosen."""
    same = docs[id_col].eqNullSafe(many["id"]) & (docs[hash_col] == many["th"])
    again = cut(docs.join(many, same, "left_semi").withColumn("_again", F.monotonically_increasing_id()), "again")
    least = again.groupBy(id_col, hash_col).agg(F.min("_again").alias("_again")).select("_again", F.lit(True).alias(flag))
    marked = again.join(least, "_again", "left").drop("_again").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return docs.join(many, same, "left_anti").withColumn(flag, F.lit(True)).unionByName(marked)


def _separators(keep: bytes) -> bytes:
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    return bytes(lower[c] if c >= 128 or lower[c] in keep else 32 for c in range(256))


#: Byte tables for bytes.translate: A-Z to a-z, and for words of letters and digits all other ASCII to a space.
#: They work on UTF-8, as every byte of a longer sequence is above 127.
WORD_TABLE = _separators(b"abcdefghijklmnopqrstuvwxyz0123456789")
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def alnum_words(data: bytes) -> list[bytes]:
    """Lower-cased (A-Z) maximal runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]."""
    return data.translate(WORD_TABLE).split()


def space_words(data: bytes) -> list[bytes]:
    """Lower-cased (A-Z) maximal runs of [^\\x20\\x09-\\x0D]."""
    return data.translate(LOWER_TABLE).split()


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(texts: list[bytes | None], most: int = SLICE_BYTES):
    """(from, to) over rows with about `most` bytes of text each; one row may hold more."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit counts."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = [np.uint64(2 * int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=7).digest(), "little") + 1) for i in range(64)]
#: Bytes whose words are hashed at once; a piece goes on to the end of its last word.
HASH_BYTES = 4_000_000
#: Longer words are hashed one by one.
BLOCK_WORD_BYTES = 64
#: White space to a space, and A-Z to a-z.
_WORDS = bytes(32 if c in b"\x09\x0a\x0b\x0c\x0d\x20" else c for c in LOWER_TABLE)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words between spaces. A word's state takes in eight bytes at a time and is mixed
    after each, so words that differ are told apart but for the chance of 64 bits."""
    inside = np.frombuffer(b" " + data + b" ", np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    blocks = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    state = mixed(sizes.astype(np.uint64) * _ODD[40] + _ODD[41])
    for i in np.flatnonzero(sizes > BLOCK_WORD_BYTES).tolist():
        state[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + sizes[i]], digest_size=8).digest(), "little")
    todo = np.flatnonzero(sizes <= BLOCK_WORD_BYTES)
    at, left = starts[todo], sizes[todo]
    while len(todo):
        state[todo] = mixed((state[todo] ^ (blocks[at] & _FIRST_BYTES[np.minimum(left, 8)])) * _ODD[42])
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return state, starts


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, A-Z counting as a-z, their offsets in the joined texts, the
    texts' offsets there (one more than texts), and the texts joined by line feeds."""
    whole = b"\n".join(t or b"" for t in texts) + b"\n"
    offsets = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    data, hashes, places, at = whole.translate(_WORDS), [], [], 0
    while at < len(data):
        end = data.find(b" ", min(at + HASH_BYTES, len(data)) - 1) + 1
        h, s = _hashed(data[at:end])
        hashes.append(h)
        places.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places), offsets, whole


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, k: int = 5, only: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """shingles() of hashes[bounds[i] : bounds[i + 1]] for each i (or those of `only`), hashed together."""
    every = _shingled(hashes, k) if len(hashes) >= k else hashes[:0]
    ends = list(itertools.pairwise(bounds.tolist()))
    for lo, hi in ends if only is None else [ends[i] for i in only.tolist()]:
        yield distinct(every[lo : hi - k + 1]) if hi - lo >= k else shingles(hashes[lo:hi], k)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])]


def _shingled(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    out = hashes[:n] * _ODD[0]
    for i in range(1, k):
        out += hashes[i : n + i] * _ODD[i]
    return mixed(out)


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words count as one shingle, none as none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < k:
        out = np.full(1, n, np.uint64)
        for i in range(n):
            out = mixed(out + hashes[i : i + 1] * _ODD[32 + i])
        return out
    return distinct(_shingled(hashes, k))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_id(members: np.ndarray) -> int:
    """A positive 63-bit identity of a sorted set of hashes."""
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little") >> 1


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, for sorted arrays of distinct values."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (len(a) + len(b) - inter)


#: log2 of a Bloom filter's bits, at most (32 MiB).
FILTER_BITS = 28


def id_filter(ids: DataFrame, column: str):
    """A broadcast Bloom filter of a column of longs, as a test over numpy arrays.

    It only spares work: whoever uses it joins exactly afterwards. Its size is bounded; with ever more ids than bits, ever
    more of the others pass as well.
    """
    spark, n = ids.sparkSession, ids.count()
    bits = 1 << min(FILTER_BITS, max(16, (16 * max(n, 1)).bit_length()))

    def fill(batches):
        got = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in _places(b.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(got, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary())], ["bits"])

    total = np.zeros(bits // 8, np.uint8)
    for row in ids.select(F.col(column).cast("long")).coalesce(4).mapInArrow(fill, "bits binary").toLocalIterator():
        total |= np.frombuffer(row[0], np.uint8)
    sent = spark.sparkContext.broadcast(total)
    return lambda: IdFilter(sent.value, bits)


def _places(x: np.ndarray, bits: int) -> list[np.ndarray]:
    h, most = mixed(x.astype(np.int64).view(np.uint64)), np.uint64(bits - 1)
    return [h & most, (h >> np.uint64(20)) * _ODD[1] >> np.uint64(13) & most, mixed(h + _ODD[2]) & most]


class IdFilter:
    def __init__(self, filled: np.ndarray, bits: int):
        self.filled, self.bits = filled, bits

    def __call__(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for at in _places(x, self.bits):
            ok &= (self.filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return ok
