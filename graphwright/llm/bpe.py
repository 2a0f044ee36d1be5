"""Byte-pair encoding of whole corpora with a public vocabulary.

Short words are merged over a contiguous rank array: part boundaries and the
rank of each pair of adjacent parts lie side by side, the least rank is looked
for again and again, its boundary deleted and the two neighbouring ranks looked
up anew.  That is quadratic, so words above SHORT_WORD bytes take a heap with
the same result.  Each task keeps the encodings of the words it has met.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie unless a caller names another place.
TOKENIZER_DIR = "/opt/tokenizers"
#: Words above so many bytes take the heap.
SHORT_WORD = 96
#: Words above so many bytes are not kept.
KEPT_WORD = 2048
#: Words whose encodings a task keeps; beyond it the memory is emptied and filled anew.
MEMORY_WORDS = 400_000
#: Ids per output batch.
BATCH_IDS = 2_000_000
# Fixed value: the pattern that splits text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for ASCII texts, in classes that the standard library's faster engine has.
_ASCII_WORDS = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+""").findall

NONE = 1 << 60


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by the contiguous rank array."""
    n = len(word)
    bound = list(range(n + 1))
    rank = [ranks.get(word[i : i + 2], NONE) for i in range(n - 1)]
    while rank:
        least = min(rank)
        if least == NONE:
            break
        i = rank.index(least)
        del bound[i + 1], rank[i]
        if i < len(rank):
            rank[i] = ranks.get(word[bound[i] : bound[i + 2]], NONE)
        if i:
            rank[i - 1] = ranks.get(word[bound[i - 1] : bound[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bound, bound[1:], strict=False)]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by a heap of pairs over linked parts; the leftmost of equal ranks goes first."""
    n = len(word)
    end = list(range(1, n + 1))
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != e:
            continue
        j = nxt[i]
        if alive[j]:
            alive[j], end[i], nxt[i] = False, end[j], nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prev[i]) >= 0 and (r := ranks.get(word[p : end[i]])) is not None:
                heapq.heappush(heap, (r, p, end[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Memory(dict):
    """word -> ids, filled when a word is first met."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        one = self.ranks.get(raw)
        ids = [one] if one is not None else merge_short(raw, self.ranks) if len(raw) <= SHORT_WORD else merge_long(raw, self.ranks)
        if len(raw) <= KEPT_WORD:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Tokenizer:
    """A vocabulary file of ranks; no special tokens, strings that look like them are ordinary text."""

    def __init__(self, directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> None:
        import regex

        with open(f"{directory}/{name}.tiktoken", "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self._words = regex.compile(PATTERN).findall
        self.memory = _Memory(self.ranks)

    def words(self, text: str) -> list[str]:
        """The parts that are merged one by one; together they are the text."""
        return _ASCII_WORDS(text) if text.isascii() else self._words(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memory.__getitem__, self.words(text))))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)


_LOADED: dict[tuple[str, str], Tokenizer] = {}


def load(directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> Tokenizer:
    """The vocabulary, read once per process."""
    if (directory, name) not in _LOADED:
        _LOADED[directory, name] = Tokenizer(directory, name)
    return _LOADED[directory, name]


def encode_documents(documents: DataFrame, directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, ids array<int>) of every document, one row per input row.

    Empty and null texts give an empty list.  Nothing is shuffled; other
    columns of the input are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(directory, name)
        get, words = tok.memory.__getitem__, tok.words

        def pack(keys: list, lists: list[list[int]]) -> pa.RecordBatch:
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids.cast(pa.list_(pa.field("element", pa.int32())))], ["doc_id", "ids"])

        for b in batches:
            keys, lists, size = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py()
                ids = list(chain.from_iterable(map(get, words(t)))) if t else []
                keys.append(doc)
                lists.append(ids)
                size += len(ids)
                if size >= BATCH_IDS:
                    yield pack(keys, lists)
                    keys, lists, size = [], [], 0
            yield pack(keys, lists)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")
