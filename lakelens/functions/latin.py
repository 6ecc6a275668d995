"""BM25 tokens of a whole batch of texts at once, for texts of Latin letters; others keep the regular expression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

#: Characters that are left to BM25_TOKEN: outside Latin letters and common marks, or with a lower case longer in UTF-8.
#: Most texts have none beyond the first range, which is a faster test.
BEYOND, OTHERS = r"[^\x00-į]", r"[İȺȾɐ-‏‿-₫₭-\x{10ffff}]"
LAST = 0x250
_ASCII = [chr(i) if i < 128 else " " for i in range(256)]
_WORD = np.array([c.isalnum() or c == "_" for c in _ASCII])
_LOWER = np.array([ord(c.lower()) if i < 128 else i for i, c in enumerate(_ASCII)], np.uint8)
_LETTER = np.array([chr(i).isalpha() for i in range(LAST)])
_SMALL = np.array([ord(c) if len(c := chr(i).lower()) == 1 and ord(c) < 0x800 else i for i in range(LAST)], np.uint16)


def is_other(text: Column) -> Column:
    return text.rlike(BEYOND) & text.rlike(OTHERS)


def _after(marks: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether the byte before is marked and of the same text."""
    before = np.zeros(len(marks), bool)
    before[1:] = marks[:-1]
    before[firsts] = False
    return before


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many tokens each text without ``OTHERS`` has (null: none), and the tokens one after another, in lower case."""
    texts = texts.cast(pa.string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    word, low = _WORD[data], _LOWER[data]
    pairs = np.flatnonzero((data >= 0xC2) & (data < 0xE0))  # letters of two bytes; longer characters are no letters here
    codes = (data[pairs] & 31).astype(np.uint16) << 6 | data[pairs + 1] & 63
    word[pairs] = word[pairs + 1] = _LETTER[codes]
    low[pairs], low[pairs + 1] = 0xC0 | _SMALL[codes] >> 6, 0x80 | _SMALL[codes] & 63
    firsts, ends = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0]
    followed = np.zeros(len(data), bool)
    followed[:-1] = word[1:]
    followed[ends - 1] = False
    dollar = (data == ord("$")) & followed
    kept = word | dollar | (data == ord("-")) & followed & _after(word, firsts)
    starts = kept & (dollar | ~_after(kept, firsts))
    low = low[kept]
    offsets = np.append(np.flatnonzero(starts[kept]), len(low)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(low))
    return np.diff(np.searchsorted(np.flatnonzero(starts), at)), found
