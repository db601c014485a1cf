"""Parts of the operators' queries that were only held by tolerances: fitted limits, likeness from digits, the mix's readings, unknown ids."""

import hashlib
import json
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_operators import SCHEMA, WORD, corpus

from heliodor.llm import bpe, fingerprints, mixing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_unknown_ids_raise(spark):
    top = len(bpe.token_table(RANKS))
    t = spark.createDataFrame([(1, np.array([5, top], "<u4").tobytes())], "doc_id bigint, ids binary")
    with pytest.raises(PySparkException, match="IndexError"):
        bpe.decode(t, RANKS).collect()
    assert bpe.decode(t.withColumn("ids", F.lit(np.array([top - 1], "<u4").tobytes())), RANKS).count() == 1


def test_likeness_is_the_corrected_share_of_equal_digits(spark):
    rows = corpus(8)
    got = fingerprints.compare_with_edits(spark.createDataFrame(rows, SCHEMA)).collect()
    bits = fingerprints.BITS

    def likeness(a, b):
        if not a or not b:
            return 1.0 if a == b else 0.0
        width = max(1, len(a) * 4 // (fingerprints.BINS * bits))
        assert width == 1 and len(a) == len(b) == fingerprints.BINS
        share = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
        chance = 2.0**-bits
        return max(0.0, (share - chance) / (1 - chance))

    assert len(got) == len(rows)
    for r in got:
        assert abs(r["near_edited"] - likeness(r["fingerprint"], r["edited_fingerprint"])) < 1e-9


def test_readings_of_the_mix(spark):
    """Positions, readings and cut texts of the mix stage against a plain walk through each source."""
    rows = [r for r in corpus(9) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    text = {r[0]: r[1] or "" for r in rows}
    want = defaultdict(list)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r[0])

    for own in by_source.values():
        own.sort(key=lambda k: (hashlib.md5(str(k).encode()).hexdigest(), k))
        left = int(np.floor(mixed[own[0]]["target"]))
        while left > 0 and any(mixed[k]["size"] for k in own):
            for k in own:
                n = min(left, mixed[k]["size"])
                if n:
                    want[k].append(text[k] if n == mixed[k]["size"] else " ".join(WORD.findall(text[k])[:n]))
                left -= n
    got = defaultdict(list)
    order = mixing.mixed_documents(docs).select("doc_id", "text").collect()
    for r in order:
        if mixed[r["doc_id"]]["size"]:  # texts without words come along as often as their source is read whole
            got[r["doc_id"]].append(r["text"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(got[k] == want[k] for k in want)  # whole readings come first
    assert json.dumps(sorted(got)) == json.dumps(sorted(k for k in mixed if mixed[k]["taken"]))
