"""The pipeline stage by stage against brute force."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from loadgauge.llm import pieces
from test_operators import WORD, brute_components, brute_fingerprint, brute_quality, brute_substrings

pytestmark = pytest.mark.skipif(not Path(pieces.MODEL).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_stay(stages):
    for docs in stages[1:-1]:
        assert docs.schema.names == stages[0].schema.names


def test_quality_stage(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    base = {r.doc_id for r in stages[0].collect() if not brute_quality(r.text)[-1]}
    assert kept <= base and len(kept) > 0.85 * len(base)


def test_near_dedup_stage(stages):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in stages[1].collect()}
    assert {r.doc_id for r in stages[2].collect()} == set(brute_components(fps).values())


def test_substring_stage(stages):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    after = {r.doc_id: len(WORD.findall(r.text)) for r in stages[3].collect()}
    want = {i: n - gone for i, (n, gone, _) in brute_substrings(before).items() if n > gone}
    assert after == want


def test_mix_stage(stages):
    before = {r.doc_id: len(WORD.findall(r.text)) for r in stages[3].collect()}
    after = Counter()
    for r in stages[4].collect():
        after[r.doc_id] += len(WORD.findall(r.text))
    assert all(n <= 3 * before[i] for i, n in after.items())
    assert abs(sum(after.values()) - sum(before.values())) <= 20


def test_encoding_stage(stages):
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and all(r.decodes and r.n_tokens == len(r.token_ids) for r in rows)


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
