"""Tokenizer, chunking and leakage against brute force and public libraries."""

import random

import pytest
from pyspark.sql import functions as F

from graphwright.llm import bpe, chunk, leakage

tiktoken = pytest.importorskip("tiktoken")
TOK = bpe.load()
ENC = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=TOK.ranks, special_tokens={})
ODD = ["", " ", "\n\n ", "<|endoftext|>", "naïve café", "検査記録と語彙" * 30, "a" * 3000, "it's we'll 'S", "\u0000\x1c\x85 x", "👩‍👩‍👧 ok", "0" * 400 + "é" * 200, "tab\there\r\nthere  \n"]


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_public_library(text):
    assert TOK.encode(text) == ENC.encode_ordinary(text)


def test_short_and_long_merges_agree():
    rnd = random.Random(1)
    for _ in range(300):
        w = "".join(rnd.choice("abcdeésth語 ") for _ in range(rnd.randint(1, 60))).encode()
        assert bpe.merge_short(w, TOK.ranks) == bpe.merge_long(w, TOK.ranks)


def test_encode_frame(spark):
    rows = [(i, t, 1) for i, t in enumerate([*ODD, None])] + [(0, "again", 1)]
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string, ids int")).collect())
    assert got == sorted((i, ENC.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def texts():
    rnd = random.Random(2)
    words = ["ledger", "epoch", "näher", "Prüfteam", "n=469", "snapshot", "it's", "記録", "3.14"]
    sent = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 18))) + rnd.choice([". ", "! ", "? ", ".\n", ".\n\n", ".\r\n\r\n"])
    return ["".join(sent() for _ in range(n)) for n in (5, 90, 300)] + ["x" * 9000, "語彙。" * 900, "a b" * 10 + "Q7" * 4000 + " end of it. " * 300, " " * 6000, "\n" * 3000, "👩‍👩‍👧" * 700]


@pytest.mark.parametrize("n", range(9))
def test_pieces(n):
    text = texts()[n]
    ids = ENC.encode_ordinary(text)
    spans = chunk.split(text, TOK)
    if len(ids) <= 512:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for k, (a, z) in enumerate(spans):
        assert len(ENC.encode_ordinary(text[a:z])) <= 512
        if k:
            pa, pz = spans[k - 1]
            prev = ENC.encode_ordinary(text[pa:pz])
            whole = next((j for j in range(min(64, len(prev) - 1), 0, -1) if TOK.decode_bytes(prev[-j:])[0] & 0xC0 != 0x80), 0)
            assert text[a:pz] == (TOK.decode_bytes(prev[-whole:]).decode() if whole else "") and z > pz
        if z < len(text) and not any(p == z for _, p in chunk.boundaries(text, z, z)):
            low = spans[k - 1][1] if k else 0
            assert not chunk.boundaries(text, low + 1, z)


def test_an_edit_moves_only_near_pieces():
    text = texts()[2]
    cut = text.index(" ", 400)
    other = text[:cut] + " inserted words here" + text[cut:]
    a = {text[s:e] for s, e in chunk.split(text, TOK)}
    b = {other[s:e] for s, e in chunk.split(other, TOK)}
    assert len(b - a) <= 4 < len(a)


def test_pieces_frame(spark):
    long = texts()[2]
    df = spark.createDataFrame([(1, long, 7), (1, long, 8), (2, None, 0), (3, "", 0), (4, "short", 0)], "doc_id bigint, text string, piece_no int")
    got = chunk.split_documents(df).collect()
    n = len(chunk.split(long, TOK))
    assert len(got) == 2 * n and {r.doc_id for r in got} == {1} and {r.piece_no for r in got} == set(range(n))


ITEM = "Between Nadrailtesk and Nekeimotte plies a barge whose diary of 1954 counts 271 crossings, though Vouklouello charged 79 and Sheikiltdan billed nobody. Each legacy sheet carries a record sign, the cross-tenant column is burnt at row 53, and the binder of folder 246 sewed Nadrailtesk before Sheikiltdan. Pick the schema that Vouklouello would lose first."
TAIL = "Answer with exactly one option and cite the evidence ids you relied on."
OTHERS = [f"Item {k} about number {k * 7} " + " ".join(f"w{k}x{j}" for j in range(60)) + "\n" + TAIL for k in range(4)]


def leak(text, least=40):
    words = leakage.item_words({1: ITEM + "\n" + TAIL, **{k + 2: t for k, t in enumerate(OTHERS)}})
    return {i for i, *_ in leakage.scan(leakage.build_automaton(words), text, least)}


def test_leaks():
    w = ITEM.split()
    assert leak("Before. " + ITEM + " After.") == {1}
    assert leak(ITEM.upper().replace(" ", "\n> ")) == {1}
    assert leak("<p>" + ITEM.replace(" ", "&nbsp;").replace("barge", "<b>barge</b>") + "</p>") == {1}
    assert leak(ITEM.replace("a", "а").replace("o", "о").replace("tenant", "te­na​nt").replace("-", "")) == {1}
    assert leak(" ".join("changed" if k % 9 == 5 else x for k, x in enumerate(w))) == {1}
    assert leak(" ".join(w[:22]) + " filler text between " * 40 + " ".join(w[22:45])) == {1}
    assert leak(" ".join(w[5:46])) == {1} and leak(" ".join(w[5:40])) == set()
    assert leak(" ".join(reversed(w))) == set() and leak(TAIL * 5) == set()
    assert leak(" ".join(x for x in w if x[0].isupper()) * 20) == set() and leak("") == set()


def test_leak_offsets_and_frame(spark):
    docs = spark.createDataFrame([(1, "Intro — " + ITEM + " end", "c"), (2, None, "c"), (3, "", "c"), (4, "   ", "c"), (1, "Intro — " + ITEM + " end", "c")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM + "\n" + TAIL), (9, None), (8, ""), (7, "too short")] + [(k + 20, t) for k, t in enumerate(OTHERS)], "item_id bigint, text string")
    got = leakage.find_leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.start, r.end) for r in got] == [(1, 1, 8, 8 + len(ITEM) - 1)] * 2
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0 and leakage.find_leaks(docs.filter(F.lit(False)), items).count() == 0


def test_leak_with_every_fourth_word_changed():
    w = ["changed" if k % 4 == 3 else x for k, x in enumerate(ITEM.split())]
    assert leak(" ".join(w[:43])) == {1} and leak(" ".join(w[:39])) == set()
