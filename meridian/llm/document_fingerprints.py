"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions alone.

Every paragraph (line) is hashed to a wide vector of 32-bit lanes, and a document's fingerprint is the sum of its
paragraphs' vectors modulo 2**32. The order of paragraphs doesn't matter, and one is inserted or deleted by adding or
subtracting its vector (`combined`). A vector has DENSE lanes, each a hash of the whole paragraph of its own, which
decide equality; a lane that counts the paragraph's features; and sketch lanes, of which each counts the features that
have a certain bit set in their hashes. Twice such a count less the number of features is a sum of random signs, so the
products of two documents' lanes give the cosine of their multisets of features (`likeness`): 0 for what shares nothing,
1 for equal texts, with a standard error of 0.09 and less for alike ones. Features are the runs of WORDS successive words
of a line, words of more than WORD_CHARS characters counting as several; those of a line shorter than SHORT characters
are its runs of three characters, as few words would say too little.

`fingerprint_edits` makes a corpus's fingerprints by aggregation: features are exploded and their bits summed where the
rows lie, so text is shuffled once, to bring each document beside its successor.

Edge cases: null texts count as empty, which is one empty paragraph; repeated rows give a row each; a null id sorts
before all others; other columns are ignored; an empty table gives no rows; one document is its own successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dense lanes; and the hashes of a feature, of each of which 62 bits are counted.
DENSE, HASHES = 8, 2
WORDS, WORD_CHARS, SHORT = 3, 16, 48
MASK = (1 << 32) - 1
#: Two bits of a hash, and the shifts that bring two others there each: counts of two lanes go into one long.
PAIR, SHIFTS = 1 << 32 | 1, range(1, 32)
#: Documents of a bucket of neighbours in id order, about; a window puts each beside its successor. Beyond the number of
#: buckets that one list of bounds may have, buckets grow, and Spark sorts them on disk.
BUCKET_ROWS, MOST_BUCKETS = 1024, 65_536


def _dense(text: str) -> str:
    """SQL: the dense lanes as an array of longs."""
    return f"transform(array(split({text}, '\\n')), ps -> transform(sequence(0, {DENSE - 1}), i -> aggregate(ps, 0L, (a, p) -> (a + (xxhash64(i, p) & {MASK}L)) & {MASK}L)))[0]"


def _features(text: str) -> str:
    """SQL: hashes of all features as an array of longs."""
    words = f"transform(regexp_extract_all(p, '[^ \\t\\r]{{1,{WORD_CHARS}}}', 0), w -> xxhash64(w))"
    following = ", ".join(f"w[i + {k}]" for k in range(1, WORDS))
    runs = f"if(size(w) < {WORDS}, if(size(w) = 0, array(), array(xxhash64(w))), transform(slice(w, 1, greatest(size(w) - {WORDS - 1}, 0)), (x, i) -> xxhash64(x, {following})))"
    characters = "transform(sequence(1, greatest(length(p) - 2, 1)), i -> xxhash64(substring(p, i, 3)))"
    short = f"if(length(p) = 0, cast(array() as array<bigint>), {characters})"
    return f"flatten(transform(split({text}, '\\n'), p -> if(length(p) < {SHORT}, {short}, transform(array({words}), w -> {runs})[0])))"


def _hash(x: str, k: int) -> str:
    """SQL: the k-th hash of a feature, 0 for 0; bit 0 has no part in any, nor bit 32 in the counts."""
    return x if k == 0 else f"if(shiftrightunsigned({x}, 1) = 0, 0L, xxhash64(shiftrightunsigned({x}, 1), {k}))"


def _unpacked(sums: list[str]) -> str:
    return ", ".join(f"{s} & {MASK}L, shiftrightunsigned({s}, 32) & {MASK}L" for s in sums)


def lanes(text: str) -> Column:
    """The fingerprint of a text column (or SQL expression) as an array of longs below 2**32."""
    counted = [f"aggregate(s, 0L, (a, x) -> a + (shiftright({_hash('x', k)}, {by}) & {PAIR}L))" for k in range(HASHES) for by in SHIFTS]
    sketch = f"transform(array(array({', '.join(counted)})), c -> array({_unpacked([f'c[{i}]' for i in range(len(counted))])}))[0]"
    return F.expr(f"transform(array({_features(text)}), s -> concat({_dense(text)}, array(cast(size(s) as bigint)), {sketch}))[0]")


def combined(a: str, b: str, sign: int = 1) -> Column:
    """Fingerprint of a document with b's paragraphs inserted (sign 1) or deleted (-1)."""
    return F.expr(f"zip_with({a}, {b}, (x, y) -> (x + {sign} * y + {MASK + 1}L) & {MASK}L)")


def text_of(fingerprint: str) -> Column:
    return F.expr(f"array_join(transform({fingerprint}, x -> lpad(lower(hex(x)), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """0 to 1: the estimated cosine of two documents' multisets of features; 1 if the dense lanes are equal."""
    first = DENSE + 2
    signs = lambda x: f"transform(slice({x}, {first}, {HASHES * 2 * len(SHIFTS)}), c -> 2D * c - {x}[{DENSE}])"
    product = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0D, (t, p) -> t + p)"
    cosine = f"{product('v.a', 'v.b')} / nullif(sqrt({product('v.a', 'v.a')}) * sqrt({product('v.b', 'v.b')}), 0D)"
    share = f"transform(array(named_struct('a', {signs(a)}, 'b', {signs(b)})), v -> least(1D, greatest(0D, coalesce({cosine}, 0D))))[0]"
    return F.expr(f"case when slice({a}, 1, {DENSE}) = slice({b}, 1, {DENSE}) then 1D else {share} end")


def _bucket(bounds: list[int]) -> str:
    """SQL for the number of bounds (after the first) that are at most _key, by halving; and the bounds themselves."""
    listed = f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)"
    steps = ", ".join(str(1 << k) for k in reversed(range(max(1, (len(bounds) - 1).bit_length()))))
    return f"aggregate(array({steps}), 0, (at, step) -> if(at + step < {len(bounds)} and {listed}[least(at + step, {len(bounds) - 1})] <= _key, at + step, at))", listed


def beside_successor(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """docs and the text that follows in id order (the first follows the last) as next_text, dealt by _in into buckets of
    neighbouring ids: each bucket is in order of (_guest, _key, _th).

    The bounds of buckets are ids of the table; the row that starts a bucket is also sent to the bucket before it, as a
    guest. So one shuffle and a window within buckets are all it takes."""
    keyed = docs.withColumn("_key", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63) + 1))).withColumn("_th", F.xxhash64(text_col))
    n, least = keyed.agg(F.count(F.lit(1)), F.min("_key")).first()
    buckets = min(MOST_BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    cuts = keyed.select(F.percentile_approx("_key", [k / buckets for k in range(1, buckets)], min(1_000_000, 100 * buckets))).first()[0] if buckets > 1 else []
    bounds = sorted({least or 0, *cuts})
    which, listed = _bucket(bounds)
    before = F.when(F.col("_key") == bounds[0], F.lit(len(bounds) - 1)).otherwise(F.col("_bucket") - 1)
    place = lambda guest, bucket: F.struct(F.lit(guest).alias("_guest"), bucket.alias("_in"))
    own = place(False, F.col("_bucket"))
    places = F.when(F.expr(f"_key = {listed}[_bucket]"), F.array(own, place(True, before))).otherwise(F.array(own))
    dealt = keyed.withColumn("_bucket", F.expr(which)).withColumn("_place", F.explode(places)).select(*docs.columns, "_key", "_th", "_place._guest", "_place._in")
    return dealt.withColumn("next_text", F.lead(text_col).over(Window.partitionBy("_in").orderBy("_guest", "_key", "_th")))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: its last quarter replaced by the start of its successor's."""
    rows = beside_successor(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")), "_text", "_id")
    rows = rows.withColumn("_n", F.char_length("_text").cast("long")).withColumn("_quarter", F.expr("cast(_n div 4 as int)"))
    rows = rows.withColumn("_edited", F.expr("concat(left(_text, cast(_n as int) - _quarter), left(coalesce(next_text, ''), _quarter))"))
    # What a row carries through the aggregation is longs, as these are aggregated in place. Bit 0 of a feature tells of
    # which text it is; the first two stand for texts without features.
    sha = [F.expr(f"cast(conv(substring(_sha, {16 * i + 1}, 16), 16, -10) as bigint)").alias(f"sha{i}") for i in range(4)]
    halves = lambda c: [F.expr(f"shiftleft({c}[{2 * i}], 32) | {c}[{2 * i + 1}]").alias(f"{c}{i}") for i in range(DENSE // 2)]
    rows = rows.withColumns({"_sha": F.sha2(F.col("_edited"), 256), "own": F.expr(_dense("_text")), "new": F.expr(_dense("_edited"))})
    every = f"concat(array(0L, 1L), transform({_features('_text')}, x -> x & -2L), transform({_features('_edited')}, x -> x | 1L))"
    keys = ["_in", "_guest", "_key", "_th", "_row", "_id"]
    rows = rows.select(*keys[:4], F.monotonically_increasing_id().alias("_row"), "_id", "_n", *sha, *halves("own"), *halves("new"), F.expr(every).alias("_x"))
    rows = rows.select(*(c for c in rows.columns if c != "_x"), F.explode("_x").alias("x"))
    carried = [F.max(c).alias(c) for c in ("_n", *(f"{c}{i}" for c in ("sha", "own", "new") for i in range(4)))]
    hashed = rows.withColumn("h1", F.expr(_hash("x", 1)))
    counted = [F.sum(F.expr(f"shiftright({'x' if k == 0 else 'h1'}, {by}) & {PAIR}L")).alias(f"c{k}_{by}") for k in range(HASHES) for by in SHIFTS]
    sums = hashed.groupBy(*keys, F.expr("x & 1L").alias("_which")).agg(F.count(F.lit(1)).alias("features"), *carried, *counted)
    dense = ", ".join(f"{part}" for i in range(DENSE // 2) for part in (f"shiftrightunsigned(if(_which = 0, own{i}, new{i}), 32)", f"if(_which = 0, own{i}, new{i}) & {MASK}L"))
    made = f"array({dense}, features - 1, {_unpacked([f'c{k}_{by}' for k in range(HASHES) for by in SHIFTS])})"
    hexed = "concat(" + ", ".join(f"lpad(lower(hex(sha{i})), 16, '0')" for i in range(4)) + ")"
    prints = sums.select(*keys, "_which", "_n", F.expr(hexed).alias("_sha"), F.expr(made).alias("_print"))
    order = Window.partitionBy("_in").orderBy("_guest", "_key", "_th", "_row", "_which")
    whole = prints.withColumns({"_edited_print": F.lead("_print", 1).over(order), "_next_print": F.lead("_print", 2).over(order)}).where("_which = 0 and not _guest")
    return whole.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), F.col("_sha").alias("edited_sha256"), text_of("_print").alias("fingerprint"), text_of("_edited_print").alias("edited_fingerprint"),
        likeness("_print", "_edited_print").alias("near_edited"), likeness("_print", "_next_print").alias("near_next"),
    )
