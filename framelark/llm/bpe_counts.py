"""Token counts by heap-and-linked-list byte-pair merging.

`token_counts(text)` is an Arrow UDF that gives the number of tokens of each
text under a byte-level BPE vocabulary with word ends (a `tokenizers` .json
file). For each piece of text the symbols stand in a linked list and their
adjacent pairs in a heap; the pair of lowest rank (leftmost first) is popped
and merged until no pair is left in the merge table. The count is the number of
initial symbols minus the merges; no ids are made.

The rules around the merging are those of the file: special strings in the text
are one token each; the rest is put in NFC and lower case and cut into letters
runs, single digits and other runs, with white space dropped.

Edge cases: null and empty texts have 0 tokens. Repeated rows are counted each
for itself. A text of any length is processed whole. Only the text column is
read; other columns pass through.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.llm.common import bounded_batches

CACHE = 1 << 19  # pieces remembered by a Python worker before it starts anew

_loaded: dict[str, PieceCounter] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class PieceCounter:
    """Counts the tokens of texts; remembers pieces it has met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\v\f\r a-z0-9]+").findall
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.known: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece."""
        data = piece.encode()
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        n = len(ids)
        if n == 1:
            return 1
        merges = self.merges
        heap = []
        for i in range(n - 1):
            found = merges.get(ids[i] << 20 | ids[i + 1])
            if found is not None:
                heap.append((found >> 20, i, ids[i], ids[i + 1], found & 0xFFFFF))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        count = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two symbols has been merged since
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                found = merges.get(new << 20 | ids[k])
                if found is not None:
                    heapq.heappush(heap, (found >> 20, i, new, ids[k], found & 0xFFFFF))
            h = before[i]
            if h >= 0:
                found = merges.get(ids[h] << 20 | new)
                if found is not None:
                    heapq.heappush(heap, (found >> 20, h, ids[h], new, found & 0xFFFFF))
        return count

    def plain(self, text: str) -> int:
        if text.isascii():
            pieces = self.ascii_pieces(text.lower())
        else:
            # lower case by single characters: no context rule for a final sigma
            pieces = self.pieces(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        known = self.known
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            missing = {p: self.merged(p) for p in set(pieces) if p not in known}
            total = sum(missing[p] if p in missing else known[p] for p in pieces)
            known.update(missing)
            return total

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(self.plain(p) for p in parts[::2] if p) + len(parts) // 2


def counter(path: str) -> PieceCounter:
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def token_counts(text: Column, vocabulary: str) -> Column:
    """Number of tokens of each text under the vocabulary file at `vocabulary` (a path on every executor)."""

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        tokens = counter(vocabulary)
        return pa.array([tokens(t.as_py()) for t in texts], pa.int64())

    return count(text)


def count_documents(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: its bytes, its tokens, and whether it has more than `limit` tokens."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col(key),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_counts(F.col(text), vocabulary).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
