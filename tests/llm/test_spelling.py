"""Spelling variants against a plain version: every pair of words compared, every form followed by hand."""

import re
import zlib
from collections import Counter
from random import Random

import pytest

from heliodor.llm import spelling
from heliodor.llm.common import written

SCHEMA = "doc_id bigint, text string, word string, n int, form string, key int"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def counted(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def plain(rows):
    n = counted(rows)
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def corpus(seed):
    r = Random(seed)
    letters = "abcÀÿéß"
    bases = ["".join(r.choice(letters[: 3 + k % 5]) for _ in range(r.randrange(6, 14))) for k in range(60)] + ["aaaaaaaa", "abababababab", "x" * 3000]
    out = []
    for base in bases:
        out += [base] * r.choice((2, 3, 40, 400))
        for _ in range(12):
            w = list(base)
            for _ in range(r.randrange(1, 3)):
                at = r.randrange(len(w))
                w[at : at + r.randrange(2)] = r.choice(letters) * r.randrange(2)
            out += ["".join(w)] * r.choice((1, 2, 4, 30))
    out = [w.upper() if r.random() < 0.1 and "ÿ" not in w and "ß" not in w and "é" not in w else w for w in out]
    r.shuffle(out)
    rows = [(k, r.choice((" ", "1", "\n", "-")).join(out[k::150])) for k in range(150)]
    return [*rows, rows[3], rows[3], (None, rows[5][1]), (200, None), (201, ""), (202, " \t1234 ÷×÷×÷×÷×÷ ÷×÷×÷×÷×÷"), (203, "words: short one two")]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_groups(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "x", 1, "y", 2) for k, t in rows], SCHEMA).repartition(4)
    got = [tuple(x) for x in spelling.spelling_groups(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = plain(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] == 0 for w in want)


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(spelling, "DEALT", 3)
    n = counted(corpus(3))
    words = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(written(words, "words")).collect()}
    want = {(a, b) for a in n for b in n if one_edit(a, b)}
    assert {frozenset(p) for p in got} == {frozenset(p) for p in want} and 2 * len(got) == len(want)


def test_near_words_share_a_key():
    """Each near pair shares a key, however the bigrams are ordered."""
    r = Random(7)
    for _ in range(3000):
        a = "".join(r.choice("ab" if r.random() < 0.5 else "abcd") for _ in range(r.randrange(7, 12)))
        at, kind = r.randrange(len(a)), r.randrange(3)
        b = a[:at] + ("" if kind == 0 else r.choice("abcd")) + a[at + (kind != 1) :]
        if not one_edit(a, b) or min(len(a), len(b)) < 7:
            continue
        grams = [x + y for x in "abcd" for y in "abcd"]
        r.shuffle(grams)
        ranks = {g: k for k, g in enumerate(grams)}
        short, long = sorted((a, b), key=len)
        offers = lambda w, longer: {k for rank, place in spelling.rarest(w, ranks) for k in spelling.keys_of(w, rank, place, longer)}
        assert offers(short, False) & offers(long, len(short) < len(long))


def test_nothing(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], SCHEMA)).collect() == []
