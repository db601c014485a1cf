"""MinHash near-copies against all pairs of full sets."""

from random import Random

import numpy as np
import pytest
from test_operators import SCHEMA, check, corpus, plain_components

from heliodor.llm import jaccard, minhash


def with_kept(rows):
    return [(k, n, c, k is None or k == c) for k, n, c in rows]


def plain(rows, n, num=80):
    return with_kept(plain_components(rows, n, num, 100))


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_components(spark, n):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check(map(tuple, minhash.minhash_components(docs, n).collect()), plain(rows, n))


def near_groups(seed):
    """Groups of edits of one text: hubs, chains, groups that share much but do not link."""
    r = Random(seed)
    out, k = [], 0
    for size, edits in ((60, 6), (40, 14), (30, 25), (50, 0), (12, 3)):
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(120)] = f"e{r.randrange(10**6)}"
            if edits == 3:
                base = w  # a chain
            out.append((k, " ".join(w), *[None] * 8))
            k += 1
    r.shuffle(out)
    return out


@pytest.mark.parametrize("piece", [7, jaccard.SLICE])
def test_groups_of_near_copies(spark, monkeypatch, piece):
    """Groups in slices and in one piece; links that no head of a group has are found too."""
    monkeypatch.setattr(minhash, "SLICE", piece)
    monkeypatch.setattr(jaccard, "SLICE", piece)
    rows = near_groups(5)
    want = plain(rows, 2)
    check(map(tuple, minhash.minhash_components(spark.createDataFrame(rows, SCHEMA), 2).collect()), want)
    assert len({r[2] for r in want}) not in (len(rows), 1)


def test_repeated_ids(spark):
    own = lambda name, k: " ".join(f"{name}{j}" for j in range(k))
    rows = [(1, own("a", 40)), (2, own("a", 40)), (2, own("b", 40)), (3, own("b", 41)), (4, own("b", 41)), (4, ""), (5, own("c", 9)), (5, own("c", 9)), (6, None), (None, own("a", 40)), (None, None)]
    t = spark.createDataFrame([(*x, *[None] * 8) for x in rows], SCHEMA)
    got = sorted((tuple(r) for r in minhash.minhash_components(t, 2).collect()), key=repr)
    top = {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, None: None}
    size = lambda x: max(0, len((x or "").split()) - 1)
    assert got == sorted(((k, size(x), top[k], k is None or top[k] == k) for k, x in rows), key=repr)


def test_nothing(spark):
    assert minhash.minhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_minima_estimate_the_similarity():
    rng = np.random.default_rng(1)
    places = minhash.BANDS * minhash.ROWS
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(20):
            a = rng.integers(0, 1 << 64, 1000, np.uint64)
            common = int(2000 * share / (1 + share))
            b = np.concatenate([a[:common], rng.integers(0, 1 << 64, 1000 - common, np.uint64)])
            errors.append((minhash.minima(a) == minhash.minima(b)).sum() / places - common / (2000 - common))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_bands_and_signatures_catch_linked_sets():
    """At a similarity of 0.8 all of 400 pairs share a band and agree often enough; of unlike pairs few do."""
    rng = np.random.default_rng(2)
    met = passed = 0
    for k in range(400):
        size = int(rng.integers(9, 400))
        a = rng.integers(0, 1 << 64, size, np.uint64)
        b = np.concatenate([a[: size - size // 9], rng.integers(0, 1 << 64, size // 9, np.uint64)])
        x, y = minhash.minima(a), minhash.minima(b)
        met += bool(set(minhash.band_keys(x).tolist()) & set(minhash.band_keys(y).tolist()))
        passed += ((x & np.uint64(255)) == (y & np.uint64(255))).sum() >= minhash.least_agreement(80, 100)
    assert met == passed == 400
    other = [minhash.minima(rng.integers(0, 1 << 64, 100, np.uint64)) for _ in range(60)]
    assert all(not set(minhash.band_keys(p).tolist()) & set(minhash.band_keys(q).tolist()) for k, p in enumerate(other) for q in other[:k])
