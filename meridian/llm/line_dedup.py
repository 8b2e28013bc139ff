"""Line dedup by distinct-site spread, in DataFrame functions alone.

For each line hash a HyperLogLog sketch of the sites that hold it is merged by aggregation, before any shuffle and
after. Lines whose estimate is clear of the threshold are decided by it; lines near it get exact distinct counts. A line
of at least min_sites sites is boilerplate: it goes from every document but the first that holds it.

Edge cases: null and empty texts are kept as they are; blank lines are never boilerplate; null sites count as one site
of their own; a document left without lines has an empty text; rows that repeat id and text are treated alike; the
first holder is the smallest (id, line number), a null id being the smallest; other columns are kept as they are, and
names the operator adds start with an underscore and two letters and are dropped; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut

#: log2 of a sketch's registers, and the share of the threshold by which an estimate must clear it. The standard error
#: of 2**12 registers is 1.6 %, a fifteenth of that share, and small sets are held exactly.
SKETCH_BITS, MARGIN = 12, 0.25


def line_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(_ld_a, _ld_b: 128-bit line hash; _ld_site; id; _ld_text: hash of the text; _ld_pos) of every line that isn't blank."""
    text = F.col(text_col).cast("string")
    return (
        docs.select(
            F.col(id_col).alias("_ld_id"), F.coalesce(F.col(site_col).cast("string"), F.lit("\x00none")).alias("_ld_site"),
            F.xxhash64(text).alias("_ld_text"), F.posexplode(F.split(text, "\n")).alias("_ld_pos", "_ld_line"),
        )
        .where(F.trim("_ld_line") != "")
        .select(F.xxhash64("_ld_line").alias("_ld_a"), F.xxhash64("_ld_line", F.lit(1)).alias("_ld_b"), "_ld_site", "_ld_id", "_ld_text", "_ld_pos")
    )


def boilerplate(places: DataFrame, min_sites: int) -> DataFrame:
    """(_ld_a, _ld_b, first) of the lines that stand on at least min_sites sites."""
    spread = (
        places.groupBy("_ld_a", "_ld_b")
        .agg(
            F.hll_sketch_agg("_ld_site", F.lit(SKETCH_BITS)).alias("sites"), F.count(F.lit(1)).alias("n"),
            F.min(F.struct("_ld_id", "_ld_pos")).alias("first"),
        )
        .where(F.col("n") >= min_sites)
        .select("_ld_a", "_ld_b", "first", F.hll_sketch_estimate("sites").alias("estimate"))
        .where(F.col("estimate") >= min_sites * (1 - MARGIN))
    )
    spread = cut(spread, "line-spread")
    near = spread.where(F.col("estimate") <= min_sites * (1 + MARGIN))
    exact = (
        places.join(near.select("_ld_a", "_ld_b"), ["_ld_a", "_ld_b"], "left_semi")
        .groupBy("_ld_a", "_ld_b").agg(F.countDistinct("_ld_site").alias("exact"))
        .where(F.col("exact") >= min_sites).select("_ld_a", "_ld_b")
    )
    sure = spread.where(F.col("estimate") > min_sites * (1 + MARGIN))
    return sure.select("_ld_a", "_ld_b", "first").unionByName(near.join(exact, ["_ld_a", "_ld_b"], "left_semi").select("_ld_a", "_ld_b", "first"))


def without_boilerplate(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", removed_col: str = "removed_lines") -> DataFrame:
    """docs with boilerplate lines taken from the text, and their numbers (from 0, ascending) in removed_col."""
    places = cut(line_places(docs, id_col, text_col, site_col), "line-places")
    removed = (
        places.join(boilerplate(places, min_sites), ["_ld_a", "_ld_b"])
        .where(~F.struct("_ld_id", "_ld_pos").eqNullSafe(F.col("first")))
        .groupBy("_ld_id", "_ld_text").agg(F.sort_array(F.collect_set("_ld_pos")).alias(removed_col))
    )
    kept = docs.withColumn("_ld_text", F.xxhash64(F.col(text_col).cast("string"))).alias("d")
    joined = kept.join(removed.alias("r"), F.col(f"d.{id_col}").eqNullSafe(F.col("r._ld_id")) & (F.col("d._ld_text") == F.col("r._ld_text")), "left")
    left = F.expr(f"array_join(filter(split(d.`{text_col}`, '\\n'), (x, i) -> not array_contains(r.`{removed_col}`, i)), '\\n')")
    text = F.when(F.col(f"r.{removed_col}").isNull(), F.col(f"d.{text_col}")).otherwise(left).alias(text_col)
    return joined.select(*(text if c == text_col else F.col(f"d.`{c}`") for c in docs.columns), F.coalesce(F.col(f"r.{removed_col}"), F.expr("cast(array() as array<int>)")).alias(removed_col))


ORACLE = """
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from documents where text is not null
), bad as (
  select line, min(struct_pack(d := doc_id, p := pos)) as f from lines where trim(line) <> '' group by line
  having count(distinct coalesce(source, chr(1) || 'none')) >= {min_sites}
), marked as (
  select l.doc_id, l.pos, l.line, b.line is not null and not (b.f.d = l.doc_id and b.f.p = l.pos) as gone
  from lines l left join bad b on b.line = l.line
), kept as (
  select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text,
         coalesce(string_agg(cast(pos as varchar), ',' order by pos) filter (where gone), '') as removed_lines,
         count(*) as n_lines, count(*) filter (where gone) as n_removed
  from marked group by doc_id
)
select doc_id, n_lines, n_removed, removed_lines, text from kept
union all select doc_id, 0, 0, '', null from documents where text is null
"""
