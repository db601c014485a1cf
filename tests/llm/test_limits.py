"""Limits of ratios against a plain version over all labelled rows."""

from random import Random

import numpy as np

from heliodor.llm import quality


def test_limits_come_from_all_labelled_rows(spark):
    r = Random(3)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(2000)]
    texts = [" ".join(r.choices(words, k=r.randrange(60, 150))) for _ in range(22_000)]
    texts += [" ".join(r.choices(words[: 5 + k % 20], k=70)) for k in range(100)]
    labels = spark.range(len(texts)).selectExpr("id as doc_id", "1 as quality")
    xs, limits, first, last = quality.fit_limits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8), labels)
    packer = quality.new_packer()
    seen = {(len(t), quality.ratio_of(t.encode(), packer)) for t in texts if len(t) >= 256}
    x, ratio = np.log2([n for n, _ in seen]), np.array([q for _, q in seen])
    power = np.floor(x).astype(int)
    ok = [p for p in sorted(set(power.tolist())) if (power == p).sum() >= quality.LEAST_ROWS]
    middle, trend = ([np.median(v[power == p]) for p in ok] for v in (x, ratio))
    slope = np.gradient(trend, middle)
    wanted = [t + np.quantile((ratio[power == p] - t - g * (x[power == p] - m)), 0.998) * (1 + quality.SLACK) for p, m, t, g in zip(ok, middle, trend, slope, strict=True)]
    assert (first, last) == (1 << ok[0], 2 << ok[-1])
    assert np.allclose(xs[1:-1], middle, atol=0.01) and np.allclose(limits[1:-1], wanted, atol=0.01)
