"""Evaluation texts that leak into a corpus.

One Aho-Corasick automaton holds the word windows of all evaluation items,
reduced to letters and digits.  Every document is reduced the same way and
scanned once; hits are chained in the item's order and mapped back to offsets
of the original text.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.session import cut

#: Consecutive item words in one pattern, and item words that a document must hold.
WINDOW, LEAST_WORDS = 3, 40
#: Letters that may stand in the place of a single changed word.
LONGEST_WORD = 24
#: A first or last line that so many items share is an instruction, not the item's own text.
SHARED_BY = 3
#: Characters of items in one automaton; larger evaluation sets take one scan of the documents per so many characters.
PART_CHARS = 2_000_000

# Letters that look like Latin ones, in the case in which they do.
LOOKALIKES = (
    dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝкмтвн", "abesijkmhopctxyaesijopcxyhdqwkmtbh", strict=True))
    | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιονρτυχ", "abezhikmnoptyxaionptux", strict=True))
    | {"ı": "i", "ł": "l", "Ł": "l", "ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ɑ": "a", "ɡ": "g", "ℓ": "l", "ß": "ss"}
)
# Digits that look like letters, applied to both sides.
_DIGITS = {"0": "o", "1": "l"}
_LOOK = re.compile(f"[{''.join(LOOKALIKES)}]")
_DROP = bytes(c for c in range(128) if not chr(c).isalnum())
_LOWER = bytes(ord(_DIGITS.get(chr(c).lower(), chr(c).lower())) if c < 128 else c for c in range(256))
_OTHER = re.compile(r"[\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def skeleton(text: str) -> str:
    """Letters and digits only: no layout, markup, case, punctuation, accents, look-alikes or invisible characters."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if text.isascii():
        return text.encode("ascii").translate(_LOWER, _DROP).decode("ascii")
    text = _LOOK.sub(lambda m: LOOKALIKES[m[0]], unicodedata.normalize("NFKD", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.casefold())
    text = text.encode("utf-8", "surrogatepass").translate(_LOWER, _DROP).decode("utf-8", "surrogatepass")
    return text if text.isascii() else _OTHER.sub("", text)


_ONE: dict[str, str] = {}


def skeleton_offsets(text: str) -> tuple[str, list[int]]:
    """The skeleton and, for each of its characters, the offset of the original character it comes from."""
    out, at, i = [], [], 0
    skip = [(m.start(), m.end(), "") for m in _TAG.finditer(text)]
    skip += [(m.start(), m.end(), html.unescape(m[0])) for m in _ENTITY.finditer(text)]
    skip.sort()
    k = 0
    while i < len(text):
        if k < len(skip) and skip[k][0] <= i:
            start, end, put = skip[k]
            k += 1
            if start < i:
                continue
            s = skeleton(put.replace("<", " ").replace("&", " "))
            out.append(s)
            at += [start] * len(s)
            i = end
            continue
        c = text[i]
        s = _ONE.get(c)
        if s is None:
            s = _ONE[c] = skeleton(c) if c not in "<&" else ""
        out.append(s)
        at += [i] * len(s)
        i += 1
    return "".join(out), at


def _lines(text: str) -> list[tuple[str, list[str]]]:
    """(skeleton, own words as skeletons) of every line with a letter or digit."""
    return [(k, [w for w in map(skeleton, x.split()) if w]) for x in text.splitlines() if (k := skeleton(x))]


def _trim(lines: list[tuple[bool, list[str]]]) -> list[str]:
    """Words of (shared, words) lines without the shared ones at either end; one line always stays."""
    first, last = 0, len(lines)
    while last - first > 1 and lines[first][0]:
        first += 1
    while last - first > 1 and lines[last - 1][0]:
        last -= 1
    return [w for _, ws in lines[first:last] for w in ws]


def item_words(texts: dict[int, str]) -> dict[int, list[str]]:
    """Own words of each item as skeletons; first and last lines that SHARED_BY or more items have are left out."""
    lines = {i: _lines(t) for i, t in texts.items()}
    seen = Counter(s for ls in lines.values() if ls for s in {ls[0][0], ls[-1][0]})
    return {i: _trim([(seen[s] >= SHARED_BY, ws) for s, ws in ls]) for i, ls in lines.items()}


def own_words(items: DataFrame) -> DataFrame:
    """(item_id, words): the same for a table of (item_id, text), one row per item; counts of lines cover all items."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, s, ws, n in (0, len(ls) - 1)) for i, t in zip(b["item_id"], b["text"], strict=True) for ls in [_lines(t)] for n, (s, ws) in enumerate(ls)]
            yield pd.DataFrame(rows, columns=["item_id", "n", "line", "words", "edge"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "words": [_trim([(x["shared"], list(x["words"])) for x in ls]) for ls in b["lines"]]})

    lines = cut(items.select("item_id", "text").mapInPandas(split, "item_id bigint, n int, line string, words array<string>, edge boolean"))
    shared = lines.filter("edge").select("item_id", "line").distinct().groupBy("line").agg(F.count("*").alias("k")).filter(F.col("k") >= SHARED_BY).select("line", F.lit(True).alias("shared"))
    flagged = lines.join(shared, "line", "left").select("item_id", F.struct("n", F.coalesce("shared", F.lit(False)).alias("shared"), "words").alias("x"))
    return flagged.groupBy("item_id").agg(F.sort_array(F.collect_list("x")).alias("lines")).mapInPandas(join, "item_id bigint, words array<string>")


def build_automaton(words: dict[int, list[str]], window: int = WINDOW):
    """Automaton over all windows of all items; a pattern's value is (length, [(item, position), ...])."""
    import ahocorasick

    where: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for item, ws in words.items():
        for p in range(len(ws) - window + 1):
            where["".join(ws[p : p + window])].append((item, p))
    auto = ahocorasick.Automaton()
    for pattern, at in where.items():
        auto.add_word(pattern, (len(pattern), at))
    if where:
        auto.make_automaton()
    return auto if where else None


def chain(hits: list[tuple[int, int, int]], window: int = WINDOW) -> tuple[int, int, int]:
    """(item words held in order, first offset, last offset) of hits (start, end, position in the item).

    The longest chain that goes forward in both texts; words between two
    windows of it that are one apart and whose places in the document are close
    count as single changed words.
    """
    hits = sorted(hits, key=lambda h: (h[1], -h[2]))
    tails: list[int] = []
    tail_at: list[int] = []
    back = [-1] * len(hits)
    for n, (_, _, p) in enumerate(hits):
        k = bisect.bisect_left(tails, p)
        back[n] = tail_at[k - 1] if k else -1
        if k == len(tails):
            tails.append(p)
            tail_at.append(n)
        else:
            tails[k], tail_at[k] = p, n
    n, path = tail_at[-1], []
    while n >= 0:
        path.append(hits[n])
        n = back[n]
    path.reverse()
    held, before = set(), None
    for s, e, p in path:
        held.update(range(p, p + window))
        # one item word is skipped and something of a word's size stands in its place
        if before and p == before[2] + window + 1 and 0 < s - before[1] <= LONGEST_WORD:
            held.add(p - 1)
        before = (s, e, p)
    return len(held), path[0][0], path[-1][1]


def find_leaks(documents: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, item_id, words, start, end) of the documents that hold ``least_words`` words of an item.

    ``words`` counts the item's own words found in the item's order; ``start``
    and ``end`` are code-point offsets of the original text.  Items with fewer
    own words than ``least_words`` cannot leak.  Null, empty and blank texts on
    either side give no row; repeated documents and items with equal texts each
    give their own rows.  Of several rows of one item_id the smallest text
    counts.  Other columns are ignored.  Items are held in tasks by parts of
    about ``part_chars`` characters, each of which scans the documents once; an
    item is never divided.
    """
    items = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    words = cut(own_words(items).filter(F.size("words") >= least_words))
    size = words.agg(F.coalesce(F.sum(F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.length(w))), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_chars))
    schema = "doc_id bigint, item_id bigint, words int, start int, end int"
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    out = None
    for part in range(parts):
        mine = {r.item_id: list(r.words) for r in words.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()}
        found = texts.mapInPandas(_scanner(documents.sparkSession.sparkContext.broadcast(mine), least_words), schema)
        out = found if out is None else out.unionByName(found)
    return out


_AUTOMATA: dict[str, object] = {}


def _scanner(words, least_words: int):
    """Scan of document batches for the items of a broadcast; the automaton is built once per process."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[name] = build_automaton(words.value)
        auto = _AUTOMATA[name]
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                if auto is not None and text:
                    rows += [(doc, *r) for r in scan(auto, text, least_words)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "start", "end"])

    return run


def _chains(auto, flat: str, least_words: int, window: int) -> list[tuple[int, int, int, int]]:
    """(item, words, start, end) in offsets of a skeleton."""
    hits = list(auto.iter(flat))
    # so many hits hold at most their windows and one changed word between each two
    if (window + 1) * len(hits) - 1 < least_words:
        return []
    by_item: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for last, (size, at) in hits:
        for item, p in at:
            by_item[item].append((last - size + 1, last + 1, p))
    found = []
    for item, hs in by_item.items():
        if (window + 1) * len({p for _, _, p in hs}) - 1 >= least_words:
            n, start, end = chain(hs, window)
            if n >= least_words:
                found.append((item, n, start, end))
    return found


def scan(auto, text: str, least_words: int = LEAST_WORDS, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(item, words, start, end) of the items that a text gives away."""
    flat = skeleton(text)
    found = _chains(auto, flat, least_words, window)
    if not found:
        return []
    again, at = skeleton_offsets(text)
    if again == flat:
        return [(i, n, at[s], at[e - 1] + 1) for i, n, s, e in found]
    # characters that compose with their neighbours: the spans are looked for again in the reduction that has offsets
    own = {i: (at[s], at[e - 1] + 1) for i, _, s, e in _chains(auto, again, 1, window)}
    return [(i, n, *own.get(i, (0, len(text)))) for i, n, _, _ in found]
