"""Content-defined pieces of long texts.

A rolling hash over the last HASH_CHARS characters marks landmarks that depend
on nearby content only.  Each piece ends at the natural boundary nearest to the
first landmark beyond its least size, so an edit moves only the pieces around
it.  Sizes are tokens of a public tokenizer, counted as the piece itself
encodes.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.llm import bpe

#: Most tokens of a piece, tokens carried over from the piece before, least tokens of a piece that has a successor.
MAX_TOKENS, OVERLAP, MIN_TOKENS = 512, 64, 288
#: Characters under the rolling hash, and one of how many positions is a landmark on average.
HASH_CHARS, LANDMARK_EVERY = 16, 256
_BASE = np.uint64(0x9E3779B97F4A7C15)

_BLANKS = re.compile(r"\s+")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_WIDE_END = re.compile(r"[。！？][」』）]*")
_STOPS, _CLOSERS = frozenset(".!?…。！？"), frozenset("\"'”’)]»」』）")


def boundaries(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """(kind, position) of the natural ends in [low, high]: 0 paragraph, 1 line, 2 sentence, 3 word.  A piece ends before the white space."""
    out = []
    for m in _BLANKS.finditer(text, max(low, 1), min(high + 1, len(text))):
        p = m.start()
        if text[p - 1].isspace():
            continue
        run = m[0] if m.end() <= high else _BLANKS.match(text, p)[0]
        breaks = 0 if run == " " else len(_BREAK.findall(run))
        q = p - 1
        while q > 0 and text[q] in _CLOSERS:
            q -= 1
        out.append((0 if breaks > 1 else 1 if breaks else 2 if text[q] in _STOPS else 3, p))
    if not text.isascii():
        out += [(2, m.end()) for m in _WIDE_END.finditer(text, max(low - 1, 0), min(high, len(text))) if low <= m.end() <= high and m.end() < len(text)]
    return out


def landmarks(text: str) -> np.ndarray:
    """Character positions after which the rolling hash of the preceding characters is a landmark."""
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(u)
    h = np.zeros(n, dtype=np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(min(HASH_CHARS, n)):
            h[k:] += u[: n - k] * power
            power = power * _BASE
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.flatnonzero(h % np.uint64(LANDMARK_EVERY) == 0) + 1


def split(text: str | None, tok: bpe.Tokenizer, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, min_tokens: int = MIN_TOKENS) -> list[tuple[int, int]]:
    """(start, end) of the pieces; none for a text of at most ``max_tokens`` tokens.

    Every piece encodes to at most ``max_tokens`` tokens and the pieces cover
    the text.  A piece ends at a paragraph, line, sentence or word end, in that
    order of preference and nearest to a landmark, if one lies between its
    least and most size; else at any word end below the limit, and where there
    is none at a whole character.  Each piece but the first begins with the
    last ``overlap`` tokens of the one before, or the most below that which are
    whole characters and shorter than the piece.
    """
    if not text or len(text.encode("utf-8", "surrogatepass")) <= max_tokens:
        return []
    get, words = tok.memory.__getitem__, tok.words
    n, start, covered, out = len(text), 0, 0, []
    marks: np.ndarray | None = None
    while True:
        size = max_tokens * 4
        while True:
            ws = words(text[start : start + size])
            parts = list(map(get, ws))
            counts = list(accumulate(map(len, parts)))
            if counts[-1] > max_tokens or start + size >= n:
                break
            size *= 2
        if counts[-1] <= max_tokens:
            if out:
                out.append((start, n))
            return out
        if marks is None:
            marks = landmarks(text)
        ends = list(accumulate(map(len, ws), initial=start))
        fit = bisect.bisect_right(counts, max_tokens)  # words that fit
        last = ends[fit]
        least = max(ends[min(bisect.bisect_left(counts, min_tokens) + 1, fit)], covered + 1)
        cut = _cut(text, least, last, covered, marks)
        while cut is not None:
            k = bisect.bisect_left(ends, cut)
            # at the end of a word before white space the piece encodes as these words do
            ids = list(chain.from_iterable(parts[:k])) if ends[k] == cut and text[cut].isspace() else tok.encode(text[start:cut])
            if len(ids) <= max_tokens:
                break
            cut = _cut(text, covered + 1, cut - 1, covered, marks)
        if cut is None:
            cut, ids = _whole_characters(text, start, covered, size, max_tokens, tok)
        out.append((start, cut))
        covered = cut
        start = cut - _overlap(ids, overlap, tok)


def _cut(text: str, least: int, last: int, covered: int, marks: np.ndarray) -> int | None:
    """The best kind of end in [least, last], of these the one nearest to the first landmark; else the last end after ``covered``."""
    if last <= covered:
        return None
    if last >= least:
        k = int(np.searchsorted(marks, least))
        aim = int(marks[k]) if k < len(marks) and marks[k] <= last else last
        if ends := boundaries(text, least, last):
            return min(ends, key=lambda e: (e[0], abs(e[1] - aim), e[1]))[1]
    return max((p for _, p in boundaries(text, covered + 1, min(last, least))), default=None)


def _whole_characters(text: str, start: int, covered: int, size: int, max_tokens: int, tok: bpe.Tokenizer) -> tuple[int, list[int]]:
    """The longest part that fits where no boundary does, found on the tokens of the text ahead."""
    ids = tok.encode(text[start : start + size])
    k = max_tokens
    while True:
        raw = tok.decode_bytes(ids[:k])
        part = raw.decode("utf-8", "ignore")
        cut = start + len(part)
        own = tok.encode(text[start:cut])
        if len(own) <= max_tokens and cut > covered:
            return cut, own
        k -= 1
        if k < 1:
            return covered + 1, tok.encode(text[start : covered + 1])


def _overlap(ids: list[int], overlap: int, tok: bpe.Tokenizer) -> int:
    """Characters of the most last tokens, ``overlap`` at most, that decode to whole characters."""
    for k in range(min(overlap, len(ids) - 1), 0, -1):
        raw = tok.decode_bytes(ids[-k:])
        if raw[0] & 0xC0 != 0x80:
            return len(raw.decode("utf-8", "surrogatepass"))
    return 0


def split_documents(documents: DataFrame, directory: str = bpe.TOKENIZER_DIR, name: str = "byte_bpe_50k", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, piece_no, text) of the documents above ``max_tokens`` tokens; piece numbers begin at 0.

    Null, empty and short texts give no row; repeated rows give repeated
    pieces; other columns are ignored.  Nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = bpe.load(directory, name)
        for b in batches:
            rows = [(d, k, t[a:z]) for d, t in zip(b["doc_id"], b["text"], strict=True) for k, (a, z) in enumerate(split(t, tok, max_tokens, overlap, min_tokens))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "text"])

    long = documents.select("doc_id", "text").filter(F.octet_length("text") > max_tokens)
    return long.mapInPandas(run, "doc_id bigint, piece_no int, text string")
