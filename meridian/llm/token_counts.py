"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut where the vocabulary never joins two characters, and each distinct chunk of a batch is looked at once. New
ones are pre-tokens themselves if they are plain letters, and go through the library's own normalizer and splitter
otherwise. Pre-tokens are held as one ragged numpy array of symbols: in each round every sequence merges its
lowest-ranked pair at all places at once, and only pairs beside a merge are looked up again. What survives is counted.

Edge cases: null and empty texts count 0 tokens and 0 bytes; special strings in a text are one token each, as is the
library's default; repeated rows give a row each; a null id stays null; other columns are ignored, so their names cannot
clash; an empty table gives an empty result. A text of any length is counted whole.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import distinct_chunks
from ._shared import CACHE_WORD_BYTES, ship, slices, utf8

#: Chunks of which a worker's newer cache takes no batch more; about 200 bytes each. It then becomes the older one.
CACHE_CHUNKS = 200_000
#: Bytes of text whose chunks are looked at together.
BATCH_BYTES = 4_000_000
#: Bytes that the vocabulary's alphabet shows as themselves; the others are U+0100 and the following characters.
SHOWN = (*range(33, 127), *range(161, 173), *range(174, 256))
#: Bytes of letters that are in lower case and composed, in words of ASCII and of U+00DF to U+00FF but U+00F7.
_PLAIN = np.isin(np.arange(256), [*range(97, 123), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)])
_NONE = np.iinfo(np.int64).max


class PairTable:
    """Ranks of pairs of symbols, in a hash table of arrays with open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys = left << 32 | right
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[taken], self.ranks[taken] = keys[todo[put]], todo[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], slot[rest] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], _NONE)
        on = np.flatnonzero((found != keys) & (found >= 0))
        while len(on):
            slot[on] = slot[on] + 1 & self.mask
            found = self.keys[slot[on]]
            hit = found == keys[on]
            out[on[hit]] = self.ranks[slot[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out


class RankMerger:
    """Token ids of texts by byte-pair merging of many pre-tokens at a time."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = {t["content"].encode(): t["id"] for t in model["added_tokens"] if t["special"]}
        ordered = sorted(self.special, key=len, reverse=True)
        self.special_at = re.compile(b"(" + b"|".join(map(re.escape, ordered)) + b")") if ordered else None
        model = model["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, self.made = (np.array([ids[x] for x in column], np.int64) for column in zip(*((a, b, a + b) for a, b in merges), strict=True))
        self.ranks = PairTable(left, right)
        hidden = iter(range(256, 512))
        alphabet = [chr(c) if c in SHOWN else chr(next(hidden)) for c in range(256)]
        self.byte = {c: i for i, c in enumerate(alphabet)}
        self.inner, self.last = (np.array([ids[c + end] for c in alphabet], np.int64) for end in ("", suffix))
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of all pre-tokens, one after the other, and how many of each."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(n), lengths)
        rank = np.full(len(symbols), _NONE, np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        finished = []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            low = np.repeat(lowest, np.diff(np.append(starts, len(symbols))))
            over = low == _NONE  # sequences without a pair to merge
            finished.append((owner[over], symbols[over]))
            places = np.flatnonzero((rank == low) & ~over)
            # In a run of overlapping hits (aaaa) every second one counts, from the left.
            run = np.append(True, np.diff(places) != 1)[: len(places)]
            if not run.all():
                first = places[run][np.cumsum(run) - 1]
                places = places[(places - first) % 2 == 0]
            symbols[places] = self.made[rank[places]]
            keep = ~over
            keep[places + 1] = False
            places = (np.cumsum(keep) - 1)[places]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            changed = np.zeros(len(symbols) + 1, bool)
            changed[places] = changed[places - 1] = True  # -1 is past the end
            again = np.flatnonzero(changed[: len(symbols)])
            rank[again] = _NONE
            again = again[again < len(symbols) - 1]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self.ranks(symbols[again], symbols[again + 1])
        if not finished:
            return symbols, np.zeros(n, np.int64)
        owner, symbols = (np.concatenate(x) for x in zip(*finished, strict=True))
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)

    def chunk_ids(self, new: list[bytes]) -> list[bytes]:
        """Token ids of distinct chunks, as little-endian unsigned 32-bit bytes."""
        odd = np.add.reduceat(~_PLAIN[np.frombuffer(b"".join(new), np.uint8)], np.cumsum([0, *map(len, new[:-1])])) > 0
        plain, rest = ([new[i] for i in np.flatnonzero(x).tolist()] for x in (~odd, odd))
        rows, index = [], {}
        for chunk in rest:
            row: list[int | bytes] = []
            for part in self.special_at.split(chunk) if self.special_at is not None and b"<" in chunk else (chunk,):
                if part in self.special:
                    row.append(np.array([self.special[part]], "<u4").tobytes())
                elif part:
                    for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part.decode())):
                        row.append(index.setdefault(bytes(map(self.byte.__getitem__, piece)), len(plain) + len(index)))
            rows.append(row)
        symbols, counts = self.merged([*plain, *index])
        whole, ends = symbols.astype("<u4").tobytes(), np.cumsum(4 * counts).tolist()
        found = [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        plain, rest = iter(found), (b"".join(x if isinstance(x, bytes) else found[x] for x in row) for row in rows)
        return [next(rest if x else plain) for x in odd.tolist()]

    def _known(self, distinct: list[bytes]) -> list[bytes]:
        got = list(map(self.young.get, distinct))
        late = [i for i, x in enumerate(got) if x is None]
        chunks = [distinct[i] for i in late]
        ids = list(map(self.old.get, chunks))
        new = [k for k, x in enumerate(ids) if x is None]
        if new:
            for k, x in zip(new, self.chunk_ids([chunks[k] for k in new]), strict=True):
                ids[k] = x
        for i, x in zip(late, ids, strict=True):
            got[i] = x
        if len(self.young) > CACHE_CHUNKS:
            self.young, self.old = {}, self.young
        self.young.update(x for x in zip(chunks, ids, strict=True) if len(x[0]) <= CACHE_WORD_BYTES)
        return got

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text."""
        distinct, which, bounds = distinct_chunks(texts)
        lengths = np.fromiter(map(len, self._known(distinct)), np.int64, len(distinct)) // 4
        sums = np.zeros(len(which) + 1, np.int64)
        np.cumsum(lengths[which], out=sums[1:])
        return np.diff(sums[bounds]).tolist()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and each text's bounds among them."""
        distinct, which, bounds = distinct_chunks(texts)
        known = self._known(distinct)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = lengths[which]
        sums = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes, out=sums[1:])
        first = np.cumsum(lengths) - lengths
        at = np.repeat(first[which] - sums[:-1], sizes) + np.arange(sums[-1])
        return flat[at], sums[bounds]


@functools.lru_cache(1)
def merger(vocabulary: str) -> RankMerger:
    """One for each worker process, with what earlier tasks of it have found."""
    return RankMerger(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs, with the vocabulary file at a path that workers can read."""
    ship(docs.sparkSession)

    def count(batches):
        own = merger(vocabulary)
        for b in batches:
            texts = utf8(b.column(1))
            counts: list[int] = []
            for i, j in slices(texts, BATCH_BYTES):
                counts += own.count([t or b"" for t in texts[i:j]])
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), n, pa.array([c > limit for c in counts], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(
        count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
