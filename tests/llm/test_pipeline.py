"""The pipeline's stages against plain versions, each on what the stage before it kept."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from test_operators import SCHEMA, WORD, corpus, plain_components, plain_spans

import corpus_pipeline
from heliodor.llm import bpe, mixing, quality
from heliodor.llm.common import written


def test_stages(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "secrets", "mix", "tokens"]
    step = lambda name, t: written(stages[name](spark, t, ""), f"test-{name}")
    good = step("quality", docs)
    assert sorted(r["doc_id"] or -1 for r in good.collect()) == sorted(r["doc_id"] or -1 for r in quality.quality_bands(docs).collect() if r["kept"])
    held = [tuple(r) for r in good.collect()]
    single = step("near_copies", good)
    want = {c for k, _, c in plain_components(held, 5, 80, 100) if k is not None}
    assert {r["doc_id"] for r in single.collect()} - {None} == want
    clean = step("secrets", single)
    assert all("assign" not in plain_spans(r["text"] or "") for r in clean.collect())
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    assert all(r["text"] == before[r["doc_id"]] for r in clean.collect() if "[SECRET]" not in r["text"])
    mixed = step("mix", clean)
    taken = sum(r["taken"] for r in mixing.mix_sources(clean).collect())
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == taken
    assert good.columns == single.columns == clean.columns == mixed.columns == docs.columns
    tokens = step("tokens", mixed)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expect = sorted((r["doc_id"] or -1, hashlib.sha256(np.array(own.encode_ordinary(r["text"]), "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r["doc_id"] or -1, r["ids_sha256"], r["decoded_sha256"]) for r in tokens.collect()) == expect


def test_empty_tables_pass_through(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), f"test-empty-{name}")
        assert docs.count() == 0


def test_odd_ids_pass_through_all_stages(spark, tmp_path):
    """Many rows without ids, ids with several texts, clashing names, and labels beside the documents."""
    rows = corpus()
    texts = [r[1] for r in rows]
    rows += [(None, t, *r[2:]) for t, r in zip(texts[:30], rows[:30], strict=True)] + [(k, texts[k + 1], *rows[k][2:]) for k in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(k, 1) for k in range(40)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, str(tmp_path)), f"test-odd-{name}")
        made[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == before.columns
    limits = quality.fit_limits(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(str(tmp_path / "labels.parquet")))
    packer = quality.new_packer()
    assert len(made["quality"]) == sum(quality.measure((r[1] or "").encode(), packer, limits)[-1] for r in rows)
    ids = [r["doc_id"] for r in made["near_copies"] if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in made["quality"]}
    assert sum(r["doc_id"] is None for r in made["near_copies"]) == sum(r["doc_id"] is None for r in made["quality"]) > 20
    assert len(made["secrets"]) == len(made["near_copies"])
    assert len(made["tokens"]) == len(made["mix"])
