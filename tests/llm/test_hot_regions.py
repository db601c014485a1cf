"""Hot shingles: what very many texts share heads no list, and slices are thinned by sketches before texts move."""

from random import Random

import numpy as np
import pytest
from test_operators import SCHEMA, check, plain_components, planted_sets

from heliodor.llm import jaccard


@pytest.fixture
def moved(monkeypatch):
    """Counts the rows of texts that are sent to regions and slices."""
    seen = []
    plain = jaccard._with_texts

    def counting(rows, texts, keys, order, columns):
        out = plain(rows, texts, keys, order, columns)
        seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_with_texts", counting)
    return seen


def short_texts(n, phrase, seed):
    r = Random(seed)
    return [(k, f"{phrase} " + " ".join(f"w{r.randrange(10**7)}" for _ in range(7)), *[None] * 8) for k in range(n)]


def test_a_hot_phrase_moves_no_texts(spark, moved):
    rows = short_texts(20_000, "all of these begin alike here", 3)
    rows += [(30_000 + k, rows[k][1] + ("" if k % 2 else " more"), *[None] * 8) for k in range(40)]
    got = {x["doc_id"]: x["component_id"] for x in jaccard.shingle_components(spark.createDataFrame(rows, SCHEMA).repartition(8), 4, 85, 100).collect()}
    assert got == {k: k if k < 30_000 else k - 30_000 for k in got} and len(got) == 20_040
    assert sum(moved) < 3 * 20_040


def test_texts_of_hot_shingles_alone(spark, monkeypatch, moved):
    """Where nothing but hot shingles is there, the regions stay large; the result is the same, and sketches let go most texts."""
    r = Random(4)
    words = [f"v{k}" for k in range(14)]
    rows = [(k, " ".join(r.sample(words, 12)), *[None] * 8) for k in range(250)]
    for name, value in (("HOT_KEY", 3), ("SLICE", 40), ("FIT_POINTS", 30)):
        monkeypatch.setattr(jaccard, name, value)
    rows += [(300 + k, rows[k][1] + " v0", *[None] * 8) for k in range(20)]
    check(map(tuple, jaccard.shingle_components(spark.createDataFrame(rows, SCHEMA), 2, 80, 100).collect()), plain_components(rows, 2, 80, 100))


@pytest.mark.parametrize("num", [85, 80, 60])
def test_linked_sets_share_a_token_whatever_is_hot(num):
    r = Random(num)
    sets = planted_sets(r, 120)
    tokens = np.unique(np.concatenate([t for s in sets for t, _ in jaccard.token_lists(s, num, 100)]))
    for share in (0.1, 0.5, 0.9):
        hot = np.sort(np.array(r.sample(tokens.tolist(), int(share * len(tokens))), np.uint64))
        keys = [set(jaccard.signature_keys(s, num, 100, hot).tolist()) for s in sets]
        for i in range(len(sets)):
            for j in range(i):
                if jaccard.linked(sets[i], sets[j], num, 100):
                    assert keys[i] & keys[j]
