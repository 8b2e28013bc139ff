"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions and answers.

A window is `width` consecutive words of an item; an item of fewer words (but not none) is one window. All windows are
keys of one automaton, each between spaces; a text is normalised and scanned once. Hits are word numbers, and the
offsets of those words in the original text are found again where they are asked for.

An automaton takes some 45 bytes for each byte of its windows, so at most about AUTOMATON_BYTES of windows go into one.
Where all windows are more, they are dealt by a hash into several automata, and the texts are scanned once with each, in
one pass after the other; a worker holds one automaton at a time and builds it once.

Edge cases: null and empty texts have no words and no hits; an item of null or no words has no window; an item whose id
is null marks words but isn't listed; repeated items count once, repeated rows give a row each; a null id stays null;
columns other than the two named are carried only by `clean`; empty tables give no rows or no hits.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import WORD_TABLE, alnum_words, cut, ship, utf8

#: Bytes of the windows of one automaton, with the ids of their items, about.
AUTOMATON_BYTES = 4_000_000


def item_windows(items: DataFrame, width: int = 8, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (window, item): the words joined by single spaces; item as a string."""

    def make(batches):
        for b in batches:
            keys, windows = [], []
            for k, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                words = alnum_words(t or b"")
                for i in range(max(len(words) - width + 1, 1) if words else 0):
                    keys.append(k)
                    windows.append(b" ".join(words[i : i + width]))
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(keys, pa.string())], ["window", "item"])

    picked = items.select(F.col(item_id).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(make, "window binary, item string").distinct()


def automaton(windows: list[tuple[bytes, list[str]]]):
    """Keys are the windows' bytes read as Latin-1, so that text positions are byte positions."""
    import ahocorasick

    built = ahocorasick.Automaton()
    for i, (w, _) in enumerate(windows):
        built.add_word(f" {w.decode('latin-1')} ", (i, w.count(b" ") + 1))
    if windows:
        built.make_automaton()
    return built


def scan(built, text: bytes) -> tuple[int, np.ndarray, set[int]]:
    """Words of the text, the numbers of hit words, and the windows that occur."""
    words = alnum_words(text)
    n = len(words)
    if not n or not len(built):
        return n, np.empty(0, np.int64), set()
    joined = b" " + b" ".join(words) + b" "
    found = list(built.iter(joined.decode("latin-1")))
    if not found:
        return n, np.empty(0, np.int64), set()
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    after = np.searchsorted(gaps, [e for e, _ in found])  # the space that ends a match follows word number after - 1
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, after - np.array([k for _, (_, k) in found]), 1)
    np.add.at(edges, after, -1)
    return n, np.flatnonzero(np.cumsum(edges[:-1]) > 0), {i for _, (i, _) in found}


def word_spans(text: bytes, numbers: np.ndarray) -> list[tuple[int, int]]:
    """Runs of the numbered words as (start, end) offsets in code points of the original text."""
    kept = np.frombuffer(text.translate(WORD_TABLE), np.uint8) > 32
    padded = np.concatenate(([False], kept, [False]))
    starts, ends = np.flatnonzero(~padded[:-1] & padded[1:]), np.flatnonzero(padded[:-1] & ~padded[1:])
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    if not len(numbers):
        return []
    new = np.flatnonzero(np.append(True, np.diff(numbers) != 1))
    last = np.append(new[1:] - 1, len(numbers) - 1)
    return [(int(points[starts[numbers[a]]]), int(points[ends[numbers[b]]])) for a, b in zip(new, last, strict=True)]


RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_built: dict[str, tuple] = {}


def _held(key: str, windows) -> tuple:
    """A worker's automaton and the windows' items; the one of another key goes first."""
    if key not in _built:
        _built.clear()
        listed = windows.value
        _built[key] = automaton(listed), [items for _, items in listed]
    return _built[key]


def find(docs: DataFrame, items: DataFrame, width: int = 8, keep: list[str] | None = None, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", prefix: str = "") -> DataFrame:
    """The keep columns (doc_id, if none are named) and n_words, n_hit, items, spans for every row of docs: sorted ids
    of items with occurring windows, and the hit stretches as offsets in the original text. The prefix goes before the
    names of the new columns."""
    spark = docs.sparkSession
    ship(spark)
    keep = keep or ["doc_id"]
    windows = cut(item_windows(items, width, item_id, item_text), "windows")
    size = windows.agg(F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0)))).first()[0] or 0
    shards = max(1, -(-size // AUTOMATON_BYTES))
    dealt = windows.withColumn("shard", F.pmod(F.xxhash64("window"), F.lit(shards)))

    def scanner(shard: int):
        by_window: dict[bytes, list[str]] = {}
        for w, item in dealt.where(F.col("shard") == shard).select("window", "item").toLocalIterator():
            by_window.setdefault(bytes(w), []).extend([item] if item is not None else [])
        sent, key = spark.sparkContext.broadcast(sorted(by_window.items())), uuid.uuid4().hex

        def hits(texts):
            built, of = _held(key, sent)
            for t in texts:
                n, hit, which = scan(built, t or b"")
                yield n, hit, sorted({x for i in which for x in of[i]})

        return hits

    picked, text = [F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_bd_text")
    schema = docs.select(*picked).schema
    for f in StructType.fromDDL(RESULT):
        schema = schema.add(prefix + f.name, f.dataType)

    def result(kept, texts, found) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for t, (n, hit, of) in zip(texts, found, strict=True):
            for column, value in zip(out, (n, len(hit), of, [{"start": s, "end": e} for s, e in word_spans(t or b"", hit)]), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        return pa.RecordBatch.from_arrays([*kept, *map(pa.array, out, kinds)], schema.names)

    if shards == 1:
        hits = scanner(0)

        def look(batches):
            for b in batches:
                texts = utf8(b.column(len(keep)))
                yield result(b.columns[: len(keep)], texts, hits(texts))

        return docs.select(*picked, text).mapInArrow(look, schema)

    rows = cut(docs.select(F.monotonically_increasing_id().alias("_bd_row"), F.struct(*picked).alias("_bd_kept"), text), "decontaminate")
    parts = [cut(_hits_of(rows, scanner(shard)), "hits") for shard in range(shards)]
    every = functools.reduce(DataFrame.unionByName, parts).groupBy(F.col("row").alias("_bd_row"))
    every = every.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_bd_items"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("_bd_hit"))

    def merge(batches):
        for b in batches:
            texts, of, hit = utf8(b.column(len(keep))), b.column(len(keep) + 1).to_pylist(), b.column(len(keep) + 2).to_pylist()
            found = ((len(alnum_words(t or b"")), np.array(h or [], np.int64), o or []) for t, o, h in zip(texts, of, hit, strict=True))
            yield result(b.columns[: len(keep)], texts, found)

    return rows.join(every, "_bd_row", "left").select("_bd_kept.*", "_bd_text", "_bd_items", "_bd_hit").mapInArrow(merge, schema)


def _hits_of(rows: DataFrame, hits) -> DataFrame:
    """(row, hit: numbers of hit words, items) of the rows (_bd_row, _bd_text) with hits."""

    def look(batches):
        for b in batches:
            found = list(hits(utf8(b.column(1))))
            some = [i for i, (_, hit, _) in enumerate(found) if len(hit)]
            columns = [b.column(0).take(pa.array(some, pa.int64())), pa.array([found[i][1] for i in some], pa.list_(pa.int64())), pa.array([found[i][2] for i in some], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "hit", "items"])

    return rows.select("_bd_row", "_bd_text").mapInArrow(look, "row long, hit array<long>, items array<string>")


def contaminated(found: DataFrame, least_items: int = 2) -> DataFrame:
    """found with n_items, items_sha256 and whether at least so many items occur."""
    return (
        found.withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256))
        .withColumn("contaminated", F.col("n_items") >= least_items)
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with docs as (select row_number() over () as r, doc_id, {_WORDS_SQL} as w from documents),
items as (select cast(item_id as varchar) as item, {_WORDS_SQL} as w from benchmark),
windows as (
  select distinct item, list_slice(w, i, least(i + 7, len(w))) as win from (select item, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) as i from items where len(w) > 0)
), sizes as (select distinct len(win) as k from windows),
places as (select r, i, k, list_slice(w, i, i + k - 1) as win from (select r, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from docs, sizes where len(w) >= k)),
hits as (select p.r, p.i, p.k, x.item from places p join windows x on x.win = p.win),
hit_words as (select r, count(distinct word) as n from (select r, unnest(generate_series(i, i + k - 1)) as word from hits) group by r),
found as (select r, count(*) as n, string_agg(item, ',' order by item) as listed from (select distinct r, item from hits where item is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(h.n, 0) as n_hit, coalesce(f.n, 0) as n_items, sha256(coalesce(f.listed, '')) as items_sha256, coalesce(f.n, 0) >= 2 as contaminated
from docs left join hit_words h on h.r = docs.r left join found f on f.r = docs.r
"""
