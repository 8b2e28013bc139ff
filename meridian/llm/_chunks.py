"""Cuts texts where the word-level BPE vocabulary can never join two characters, so that chunks can be counted or
encoded once each: the tokens of a text are those of its chunks, one after the other.

White space always separates. In a text whose letters are ASCII or U+00C0-U+00FF the letters are put in lower case, as
the vocabulary's normalizer does (they are all composed already), and where commas and full stops stand beside no other
punctuation they are chunks of their own. All other texts are cut at ASCII white space alone.

Chunks of many texts are found at once: their bytes make one Arrow array, whose dictionary holds each chunk once.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa

_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0x80 <= c <= 0x9E else c for c in range(256))
_COMMON = bytes(c for c in range(256) if c < 0xC0 or c == 0xC3)
_KINDS = bytes(
    32 if chr(c).isspace() and c < 128 else 44 if c in b",." else 97 if c >= 128 or chr(c).isalnum() else 59 for c in range(256)
)
_BLANK = bytes(32 if c in b" \t\n\r\x0b\x0c" else c for c in range(256))


def separated(data: bytes) -> bytes:
    """A text with its chunks apart by ASCII white space."""
    if b"<|" in data:
        return data
    if not data.isascii() and (data.translate(None, _COMMON) or b"\xc3\x97" in data or b"\xc3\xb7" in data or b"\xc2" in data):
        return data
    data = data.translate(_LOWER)
    kinds = data.translate(_KINDS)
    if not (b",," in kinds or b",;" in kinds or b";," in kinds):
        data = data.replace(b",", b" , ").replace(b".", b" . ")
    return data


def distinct_chunks(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct chunks of some texts, the number there of every chunk, and each text's bounds among all chunks."""
    parts = [separated(t) for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]).translate(_BLANK), np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in parts)]))
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    encoded = chunks.dictionary_encode()
    found = encoded.dictionary
    if not len(found):
        return [], encoded.indices.to_numpy(), bounds
    _, ends, held = found.buffers()
    ends, held = np.frombuffer(ends, np.int64)[found.offset : found.offset + len(found) + 1].tolist(), held.to_pybytes()
    return [held[a:b] for a, b in itertools.pairwise(ends)], encoded.indices.to_numpy(), bounds
