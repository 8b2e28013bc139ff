"""License scans by template-markup matching.

A template is its mandatory words with marked regions: <<optional>> .. <</optional>> may be left out,
<<alt one|two words>> stands for exactly one of its phrases and <<any 0 6>> for so many words of any kind. Each template
is compiled into a token automaton that starts at any word; it accepts a stretch of words only if all mandatory wording
is there exactly. The longest accepted stretch of each start counts.

A text is looked at word by word only if it holds the anchor (the longest mandatory word) of some template.

Edge cases: null and empty texts have no words and no matches; a match may lie at a text's very end; overlapping
matches all count; repeated rows give a row each; a null id stays null; other columns are ignored; an empty table gives
no rows. Words are runs of letters, digits and non-ASCII characters, A-Z in lower case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WORD_TABLE, alnum_words, ship, utf8


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    base: bool = False


# The wording of public licenses and of the notices that their texts recommend.
_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the <<any 1 8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the software "
) + _WARRANTY
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<optional>><<alt 1|a>><</optional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<optional>><<alt 2|b>><</optional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_NAMES = "<<optional>><<alt 3|c>><</optional>> neither the name of <<any 1 12>> nor the names of <<alt its|their>> contributors may be used to endorse or promote products derived from this software without specific prior written permission "
_BSD_END = (
    "this software is provided by <<any 1 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<any 1 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC = (
    "permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and <<any 1 8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall <<any 1 8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<alt http|https>> www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license"
)
_GNU = "redistribute it and or modify it under the terms of <<alt the gnu|version 2 of the gnu|version 3 of the gnu>> {} public license as published by the free software foundation <<optional>>either<</optional>> version {} of the license <<optional>>or at your option any later version<</optional>>"
_GNU_SHORT = "licensed under the <<alt gnu {0} public license|gnu {1}|{1}>> <<optional>>as published by the free software foundation<</optional>> <<alt version {2}|v{2}>> <<optional>>or <<optional>>at your option<</optional>> any later version<</optional>>"
_MPL = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<alt http|https>> mozilla org mpl 2 0"
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
    "for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
    "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity "
    "of all present and future rights to this software under copyright law "
) + _WARRANTY
_CC = "licensed under <<optional>><<alt a|the>><</optional>> <<alt cc {}|creative commons {}>> <<alt 4 0|3 0|2 5|2 0>> <<optional>><<alt international|unported|generic>><</optional>> <<optional>>license<</optional>>"
_CC_NAMES = {
    "cc-by": "attribution", "cc-by-sa": "attribution sharealike", "cc-by-nd": "attribution noderivatives", "cc-by-nc": "attribution noncommercial",
    "cc-by-nc-sa": "attribution noncommercial sharealike", "cc-by-nc-nd": "attribution noncommercial noderivatives",
}
_GNU_NAMES = (
    ("gpl-2", "general", "gpl", "2"), ("gpl-3", "general", "gpl", "3"), ("lgpl-2.1", "lesser general", "lgpl", "2 1"),
    ("lgpl-3", "lesser general", "lgpl", "3"), ("agpl-3", "affero general", "agpl", "3"),
)

TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", _MIT),
    Template("bsd-2", _BSD + _BSD_END),
    Template("bsd-3", _BSD + _BSD_NAMES + _BSD_END),
    Template("isc", _ISC),
    Template("apache-2", _APACHE),
    Template("mpl-2", _MPL),
    Template("unlicense", _UNLICENSE),
    *(Template(label, _GNU.format(name, version)) for label, name, _, version in _GNU_NAMES),
    *(Template(label, _GNU_SHORT.format(name, short, version)) for label, name, short, version in _GNU_NAMES),
    *(Template(label, _CC.format(label[3:].replace("-", " "), name)) for label, name in _CC_NAMES.items()),
    Template("cc0", "licensed under <<optional>><<alt a|the>><</optional>> <<alt cc0|creative commons cc0|creative commons zero>> <<alt 1 0|v1 0>> <<optional>>universal<</optional>>"),
)


class TokenAutomaton:
    """States are numbers; state 0 starts, the last one accepts. Empty moves are resolved when it is built."""

    def __init__(self, markup: str):
        self.words: list[dict[bytes, set[int]]] = [{}]
        self.anything: list[set[int]] = [set()]
        self.empty: list[set[int]] = [set()]
        mandatory: list[bytes] = []
        stack: list[int] = []
        at, depth = 0, 0
        for part in re.split(r"(<<[^>]*>>)", markup):
            command = part[2:-2].split(" ") if part.startswith("<<") else None
            if command is None:
                words = alnum_words(part.encode())
                mandatory += words if not depth else []
                at = self._chain(at, words)
            elif command[0] == "optional":
                stack.append(at)
                at, depth = self._chain(at, []), depth + 1
            elif command[0] == "/optional":
                depth -= 1
                end = self._new()
                self.empty[at].add(end)
                self.empty[stack.pop()].add(end)
                at = end
            elif command[0] == "alt":
                ends = [self._chain(at, alnum_words(p.encode())) for p in part[6:-2].split("|")]
                at = self._new()
                for e in ends:
                    self.empty[e].add(at)
            elif command[0] == "any":
                low, high = int(command[1]), int(command[2])
                skips = []
                for k in range(high):
                    if k >= low:
                        skips.append(at)
                    to = self._new()
                    self.anything[at].add(to)
                    at = to
                for s in skips:
                    self.empty[s].add(at)
            else:
                raise ValueError(f"unknown region {part}")
        if stack:
            raise ValueError("an optional region isn't closed")
        if not mandatory:
            raise ValueError("a template needs mandatory words")
        self.accept = at
        self.anchor = max(mandatory, key=len)
        self.start = self._closed({0})
        if any(self.anything[s] for s in self.start) or self.accept in self.start:
            raise ValueError("a template can't start with any words, nor be empty")
        self.first = {w for s in self.start for w in self.words[s]}

    def _new(self) -> int:
        self.words.append({})
        self.anything.append(set())
        self.empty.append(set())
        return len(self.words) - 1

    def _chain(self, at: int, words: list[bytes]) -> int:
        if not words:
            to = self._new()
            self.empty[at].add(to)
            return to
        for w in words:
            to = self._new()
            self.words[at].setdefault(w, set()).add(to)
            at = to
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()] - found:
                found.add(t)
                todo.append(t)
        return frozenset(found)

    def match(self, words: list[bytes], start: int) -> int:
        """End (exclusive) of the longest accepted stretch from `start`, or -1."""
        states, end = self.start, -1
        for i in range(start, len(words)):
            states = self._closed({t for s in states for t in (*self.words[s].get(words[i], ()), *self.anything[s])})
            if not states:
                break
            if self.accept in states:
                end = i + 1
        return end


MATCHES = "n_words long, matches array<struct<label:string,base:boolean,first:long,end:long>>"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, matches) for every row of docs; matches as word numbers, end exclusive."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def look(batches):
        compiled = [(t, TokenAutomaton(t.markup)) for t in templates]
        anchors = {a.anchor for _, a in compiled}
        for b in batches:
            counts, found = [], []
            for text in utf8(b.column(1)):
                text = (text or b"").translate(WORD_TABLE)
                words, own = text.split(), []
                there = {a for a in anchors if a in text}
                for t, a in compiled if there else ():
                    if a.anchor in there:
                        for i in [i for i, w in enumerate(words) if w in a.first]:
                            if (end := a.match(words, i)) >= 0:
                                own.append({"label": t.label, "base": t.base, "first": i, "end": end})
                counts.append(len(words))
                found.append(own)
            item = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(item))], [id_col, "n_words", "matches"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(look, f"`{id_col}` {kind}, {MATCHES}")


def digest(scanned: DataFrame) -> DataFrame:
    """Labels and places of scan(). The score is n / (n + 4) for the n words of the longest accepted stretch: 0 without
    one, 0.4 to 0.9 for a notice, over 0.95 for a whole license."""
    base = "filter(matches, m -> m.base)"
    longest = "coalesce(array_max(transform(matches, m -> m.end - m.first)), 0)"
    return scanned.withColumns(
        {
            "n_base": F.expr(f"cast(size({base}) as long)"),
            "first_word": F.expr(f"array_min(transform({base}, m -> m.first))"),
            "last_word": F.expr(f"array_max(transform({base}, m -> m.first))"),
            "base_labels": F.expr(f"array_join(array_sort(array_distinct(transform({base}, m -> m.label))), ',')"),
            "labels": F.expr("array_join(array_sort(array_distinct(transform(matches, m -> m.label))), ',')"),
            "score": F.expr(f"cast({longest} as double) / ({longest} + 4)"),
        }
    )


def _pattern(markup: str) -> str:
    """A template as a regular expression over words that each have a space behind them."""
    out = []
    for part in re.split(r"(<<[^>]*>>)", markup):
        command = part[2:-2].split(" ") if part.startswith("<<") else None
        plain = lambda text: "".join(f"{w.decode()} " for w in alnum_words(text.encode()))
        if command is None:
            out.append(plain(part))
        elif command[0] == "any":
            out.append(f"(?:[^ ]+ ){{{command[1]},{command[2]}}}")
        elif command[0] == "alt":
            out.append(f"(?:{'|'.join(sorted(map(plain, part[6:-2].split('|')), key=len, reverse=True))})")
        else:
            out.append("(?:" if command[0] == "optional" else ")?")
    return "".join(out)


def _oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    base = [(t.label, alnum_words(t.markup.encode())) for t in templates if t.base]
    places = " union all ".join(
        f"select r, '{label}' as label, i - 1 as first from (select r, w, unnest(generate_series(1, len(w) - {len(words) - 1})) as i from docs) where list_slice(w, i, i + {len(words) - 1}) = [{', '.join(repr(w.decode()) for w in words)}]"
        for label, words in base
    )
    whole = " union all ".join(f"select r, '{t.label}' as label, unnest(regexp_extract_all(joined, ' {_pattern(t.markup)}')) as part from docs" for t in templates if not t.base)
    sizes = " union all ".join(f"select r, label, {len(words)} as n from places where label = '{label}'" for label, words in base)
    return f"""with docs as (
  select r, doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as joined from (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents)
), places as ({places}), matches as ({sizes} union all select r, label, length(part) - length(replace(part, ' ', '')) - 1 as n from ({whole})),
b as (select r, count(*) as n, min(first) as low, max(first) as high, string_agg(distinct label, ',' order by label) as labels from places group by r),
m as (select r, max(n) as n, string_agg(distinct label, ',' order by label) as labels from matches group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(b.n, 0) as n_base, b.low as first_word, b.high as last_word, coalesce(b.labels, '') as base_labels, coalesce(m.labels, '') as labels,
  cast(coalesce(m.n, 0) as double) / (coalesce(m.n, 0) + 4) as score
from docs left join b on b.r = docs.r left join m on m.r = docs.r
"""


ORACLE = _oracle()
