"""Secret scans in DataFrame functions alone: fixed kinds by pattern, others by sliding-window entropy.

Candidate strings are unbroken runs of at least WINDOW key characters that hold a digit, or letters of both cases. The
counts of each character and of each character class are kept up to date as one character enters the window of WINDOW
characters and one leaves it; they give the window's Shannon entropy and its class, which is the narrowest that holds all
of the window (so a prefix such as ghp_ doesn't hide the hexadecimal digits after it). A candidate is a secret where a
window reaches its class's least entropy and no allow-list pattern matches the candidate. Candidates are scored wherever
they stand, also beside or inside spans of the fixed kinds.

Edge cases: null texts count as empty; repeated rows give a row each; a null id stays null; other columns are ignored;
an empty table gives no rows. Positions are code points; spans of one kind never overlap, those of different kinds may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed kinds in their order: pattern, group and least characters of that group; and a pattern without which none is.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, r"(?i:passw|secret|token|api_?key)"),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    "hex": (r"[0-9a-f]{24,}+", 0, 24, r"[0-9a-f]{24}"),
}
WINDOW = 20
#: Key characters: the ten digits, the other hexadecimal digits, the other letters, the rest.
ALPHABET = "0123456789" + "abcdefABCDEF" + "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ" + "+/_=-"
DIGITS, HEXADECIMAL, LETTERS = 10, 22, 62
#: Least bits of a window that is all hexadecimal, of letters alone, of letters and digits, or has other characters.
LEAST = {"hexadecimal": 3.0, "letters": 4.0, "alphanumeric": 3.7, "base64": 3.9}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Candidates that match any of these are no secrets: UUIDs, dates and times, placeholders, counting runs, paths and
#: hyphenated or underscored words, version-like slugs.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9TZ/_=-]+$",
    r"(?i:example|sample|placeholder|changeme|dummy|redacted|xxxx|0000)",
    r"(?i:0123456789|abcdefgh|12345678)",
    r"^/?[A-Za-z]{2,15}([/_-][A-Za-z]{2,15})+([/_-][0-9]{1,4})?/?$",
)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(text: str, pattern: str, group: int) -> str:
    """SQL: array<struct<start,end,size,value>> of a pattern's matches, from the text between them."""
    gaps, whole, part = (f"{f}({text}, {_sql(pattern)}{x})" for f, x in (("split", ", -1"), ("regexp_extract_all", ", 0"), ("regexp_extract_all", f", {group}")))
    empty = "cast(array() as array<struct<start:long,end:long,size:int,value:string>>)"
    step = (
        "named_struct('at', a.at + length(z.gap) + length(z.whole), 'out', concat(a.out, array(named_struct("
        "'start', a.at + length(z.gap), 'end', a.at + length(z.gap) + length(z.whole), 'size', length(z.part), 'value', z.part))))"
    )
    zipped = f"filter(transform(arrays_zip({gaps}, {whole}, {part}), z -> named_struct('gap', z['0'], 'whole', z['1'], 'part', z['2'])), z -> z.whole is not null)"
    return f"aggregate({zipped}, named_struct('at', 0L, 'out', {empty}), (a, z) -> {step}, a -> a.out)"


def window_margin(value: str, window: int = WINDOW) -> str:
    """SQL: struct (margin, entropy) of the window of a string whose entropy is furthest above its class's least one;
    null for a shorter string.

    With c of each character, a window's entropy is log2(w) - sum(c * log2(c)) / w; one step changes two terms of that sum."""
    gain = lambda c: f"(({c} + 1) * log2({c} + 1) - if({c} > 0, {c} * log2(greatest({c}, 1)), 0D))"
    entering, leaving = "element_at(s.codes, i)", f"element_at(s.codes, i - {window})"
    classes = lambda x, code, by: ", ".join(  # noqa: E731  digits, characters that are not hexadecimal, neither letters nor digits
        f"'{name}', {x}.{name} {by} if({code} {test}, 1, 0)" for name, test in (("digits", f"<= {DIGITS}"), ("wide", f"> {HEXADECIMAL}"), ("odd", f"> {LETTERS}"))
    )
    added = f"transform(a.n, (c, k) -> if(k = {entering} - 1, c + 1, c))"
    first = f"named_struct('n', {added}, 'sum', a.sum + {gain(f'element_at(a.n, {entering})')}, {classes('a', entering, '+')}, 'best', a.best)"
    dropped = f"transform(b.n, (c, k) -> if(k = {leaving} - 1, c - 1, c))"
    slid = f"if(i > {window}, named_struct('n', {dropped}, 'sum', b.sum - {gain(f'(element_at(b.n, {leaving}) - 1)')}, {classes('b', leaving, '-')}, 'best', b.best), b)"
    least = f"case when d.odd > 0 then {LEAST['base64']}D when d.wide = 0 then {LEAST['hexadecimal']}D when d.digits = 0 then {LEAST['letters']}D else {LEAST['alphanumeric']}D end"
    bits = f"log2({window}D) - d.sum / {window}"
    best = f"if(i >= {window}, greatest(d.best, named_struct('margin', {bits} - {least}, 'entropy', {bits})), d.best)"
    seen = f"named_struct('n', d.n, 'sum', d.sum, 'digits', d.digits, 'wide', d.wide, 'odd', d.odd, 'best', {best})"
    step = f"transform(transform(array({first}), b -> {slid}), d -> {seen})[0]"
    none = "cast(null as struct<margin:double,entropy:double>)"
    start = f"named_struct('n', array_repeat(0, {len(ALPHABET)}), 'sum', 0D, 'digits', 0, 'wide', 0, 'odd', 0, 'best', {none})"
    run = f"aggregate(sequence(1, size(s.codes)), {start}, (a, i) -> {step}, a -> a.best)"
    codes = f"transform(filter(split({value}, ''), x -> x != ''), x -> instr({_sql(ALPHABET)}, x))"
    return f"transform(array(named_struct('codes', {codes})), s -> if(size(s.codes) < {window}, {none}, {run}))[0]"


SPAN = "struct<start:long,kind:int,end:long,entropy:double>"


def scan(docs: DataFrame, allow: tuple[str, ...] = ALLOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row of docs: spans as array of (start, kind, end, entropy), in order; kind is the place in
    KINDS, or their number for a string found by its entropy."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    none = f"cast(array() as array<{SPAN}>)"
    fixed = []
    for k, (pattern, group, least, needed) in enumerate(KINDS.values()):
        found = f"transform(filter({spans_of('_text', pattern, group)}, m -> m.size >= {least}), m -> named_struct('start', m.start, 'kind', {k}, 'end', m.end, 'entropy', cast(null as double)))"
        fixed.append(f"if(_text rlike {_sql(needed)}, {found}, {none})")
    rows = rows.withColumn("_fixed", F.expr(f"concat({', '.join(fixed)})"))
    mixed = "(m.value rlike '[0-9]' or m.value rlike '[a-z]' and m.value rlike '[A-Z]')"
    likely = f"filter({spans_of('_text', CANDIDATE, 0)}, m -> {mixed} and not ({' or '.join(f'm.value rlike {_sql(p)}' for p in allow) or 'false'}))"
    rows = rows.withColumn("_likely", F.expr(f"if(_text rlike {_sql(CANDIDATE)}, {likely}, cast(array() as array<struct<start:long,end:long,size:int,value:string>>))"))
    rows = rows.withColumn("_scored", F.expr(f"transform(_likely, m -> named_struct('m', m, 'e', {window_margin('m.value')}))"))
    secret = f"transform(filter(_scored, x -> x.e.margin >= 0), x -> named_struct('start', x.m.start, 'kind', {len(KINDS)}, 'end', x.m.end, 'entropy', x.e.entropy))"
    return rows.select(id_col, F.expr(f"array_sort(concat(_fixed, {secret}))").alias("spans"))


def listed(spans: str) -> str:
    """SQL: kind:start:end of each, comma-joined."""
    names = ", ".join(f"'{k}'" for k in (*KINDS, "entropy"))
    return f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')"


def digest(scanned: DataFrame) -> DataFrame:
    fixed = f"filter(spans, s -> s.kind < {len(KINDS)})"
    counts = {f"n_{name}": F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as long)") for k, name in enumerate(KINDS)}
    return scanned.withColumns(counts | {"base_sha256": F.expr(f"sha2({listed(fixed)}, 256)"), "spans": F.expr(listed("spans"))})


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    plain = lambda x: x.replace("{24,}+", "{24,}")  # noqa: E731  runs are as long as they can be either way
    found, spans = [], []
    patterns = [(name, plain(pattern), group) for name, (pattern, group, _, _) in KINDS.items()] + [("entropy", "[A-Za-z0-9+/_=-]+", 0)]
    for k, (name, pattern, group) in enumerate(patterns):
        found.append(
            f"""{name}_lists as (select r, string_split_regex(text, {quoted(pattern)}) as g, regexp_extract_all(text, {quoted(pattern)}, 0) as m, regexp_extract_all(text, {quoted(pattern)}, {group}) as v from docs),
{name}_matches as (select r, i, g[i] as gap, m[i] as whole, v[i] as part from (select r, g, m, v, unnest(generate_series(1, len(m))) as i from {name}_lists)),
{name}_spans as (select r, {k} as kind, part, finish - length(whole) as start, finish from (select *, sum(length(gap) + length(whole)) over (partition by r order by i) as finish from {name}_matches))"""
        )
        if name != "entropy":
            spans.append(f"select r, kind, start, finish from {name}_spans where length(part) >= {KINDS[name][2]}")
    allowed = " or ".join(f"regexp_matches(part, {quoted(x)})" for x in ALLOW)
    least = f"case when regexp_matches(w, '[^0-9A-Za-z]') then {LEAST['base64']} when not regexp_matches(w, '[^0-9a-fA-F]') then {LEAST['hexadecimal']} when not regexp_matches(w, '[0-9]') then {LEAST['letters']} else {LEAST['alphanumeric']} end"
    spans.append(f"""select distinct r, kind, start, finish from (
    select *, substring(part, i, {WINDOW}) as w from (select *, unnest(generate_series(1, length(part) - {WINDOW - 1})) as i from entropy_spans
      where length(part) >= {WINDOW} and (regexp_matches(part, '[0-9]') or regexp_matches(part, '[a-z]') and regexp_matches(part, '[A-Z]')) and not ({allowed}))
  ) where list_entropy(string_split(w, '')) >= {least}""")
    names = ", ".join(f"'{n}'" for n, _, _ in patterns)
    text = f"list_value({names})[kind + 1] || ':' || cast(start as bigint) || ':' || cast(finish as bigint)"
    counts = ", ".join(f"count(*) filter (where kind = {k}) as n_{n}" for k, n in enumerate(KINDS))
    return f"""with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
{", ".join(found)},
spans as ({" union all ".join(spans)}),
listed as (
  select r, {counts}, coalesce(string_agg({text}, ',' order by start, kind, finish) filter (where kind < {len(KINDS)}), '') as base, string_agg({text}, ',' order by start, kind, finish) as spans
  from spans group by r
)
select doc_id, {", ".join(f"coalesce(n_{n}, 0) as n_{n}" for n in KINDS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs left join listed on listed.r = docs.r
"""


def redacted(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> Column | DataFrame:
    """docs (id, text) with every span replaced by the mark."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col))
    found = scan(rows.select(F.struct(id_col, text_col).alias("_row"), F.col(text_col)), id_col="_row", text_col=text_col)
    step = (
        f"named_struct('at', greatest(a.at, s.end), 'out', if(s.start < a.at, a.out, concat(a.out, substring(t, cast(a.at as int) + 1, cast(s.start - a.at as int)), {_sql(mark)})))"
    )
    whole = f"transform(array(_row.`{text_col}`), t -> aggregate(spans, named_struct('at', 0L, 'out', ''), (a, s) -> {step}, a -> concat(a.out, substring(t, cast(a.at as int) + 1))))[0]"
    return found.select(F.col(f"_row.{id_col}").alias(id_col), F.expr(whole).alias(text_col))


ORACLE = _oracle()
