"""Per-document statistics, computed on UTF-8 buffers.

`text_stats(text)` is an Arrow UDF giving a struct of long counts. A word is a
run of bytes other than space and \\t\\n\\v\\f\\r. Null and empty texts have zero
everywhere; a text of any length is read whole.

n_words         words
word_chars      code points in words
n_symbols       characters of #*$%&|<>
n_lines         \\n-split lines that hold a word
n_dup_lines     those equal to an earlier line of the text
n_repeat_words  words in 5-word windows found twice or more in the text
n_upper         letters A-Z
n_stops         characters of .!?
n_bangs         exclamation marks
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.llm.textscan import NON_SPACE, Words, cover, inside, mix, slices, windows

FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_stops", "n_bangs")
SCHEMA = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])
REPEAT = 5

_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[0x0A] = False
_CLASS = np.zeros(256, np.uint8)  # bit 0: symbol, 1: upper, 2: stop, 3: bang
for _c in b"#*$%&|<>":
    _CLASS[_c] |= 1
_CLASS[0x41:0x5B] |= 2
for _c in b".!?":
    _CLASS[_c] |= 4
_CLASS[0x21] |= 8


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys equal an earlier one, and which occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    return later, many


def stats_of(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    n = len(offs) - 1
    words = Words(buf, offs, NON_SPACE)
    nonspace = NON_SPACE[buf]
    chars = _per_text(nonspace & ((buf & 0xC0) != 0x80), offs)
    kind = _CLASS[buf]

    lines = Words(buf, offs, _NOT_NEWLINE)
    has_word = np.concatenate([[0], np.cumsum(nonspace)])
    real = np.flatnonzero(has_word[lines.end] > has_word[lines.start])
    owner = lines.doc[real]
    later, _ = _repeated(mix(lines.hashes()[real] ^ mix(owner.astype(np.uint64) + np.uint64(1))))

    total = len(words)
    wins = windows(words.hashes(), REPEAT)
    at = np.flatnonzero(inside(words.first, REPEAT, total))
    doc = words.doc
    _, many = _repeated(mix(wins[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1))))
    covered = cover(at[many], REPEAT, total)
    return [
        words.counts,
        chars,
        _per_text(kind & 1, offs),
        np.bincount(owner, minlength=n),
        np.bincount(owner[later], minlength=n),
        np.bincount(doc[covered], minlength=n),
        *(_per_text((kind >> b) & 1, offs) for b in (1, 2, 3)),
    ]


@F.arrow_udf(SCHEMA)
def text_stats(texts: pa.Array) -> pa.Array:
    parts = [stats_of(buf, offs) for _, _, buf, offs in slices(texts)]
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(FIELDS)
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(FIELDS))
