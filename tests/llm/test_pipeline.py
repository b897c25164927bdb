"""Each stage of the pipeline against a plain version on its own input, and the whole on untidy and empty tables."""

import zlib

import numpy as np
import pytest
import corpus_pipeline
from tests.llm.test_corpus_operators import expected_ids, plain_set_components, words
from tidemark.llm import langid, mixing, secrets
from tidemark.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, messy):
    docs, out = spark.read.parquet(f"{messy}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, messy))
        out.append((name, docs, made))
        docs = made
    return out


def test_order_and_columns(stages):
    assert [n for n, *_ in stages] == ["language_id", "near_dedup", "secret_scan", "mix_sources", "pack_windows"]
    for _, before, after in stages[:-1]:
        assert before.columns == after.columns and before.dtypes == after.dtypes and after.count() > 0


def test_language_stage(stages):
    _, before, after = stages[0]
    model = langid.fit(before)
    rows = before.collect()
    found, _, unsure = langid.predictions(before.select("text").toArrow().column(0).combine_chunks(), model)
    kept = sorted(repr(r) for r, p, u in zip(rows, found.to_pylist(), unsure.to_pylist(), strict=True) if p != "und" and not u)
    assert kept == sorted(map(repr, after.collect()))


def test_dedup_stage(stages):
    _, before, after = stages[1]
    rows, least = before.collect(), {}
    for r, c in zip(rows, plain_set_components([r.text for r in rows]), strict=True):
        least[c] = min(least.get(c, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after.collect()) == sorted(least.values())


def test_secret_stage(stages):
    _, before, after = stages[2]
    model = secrets.fit(before)
    want = sorted(repr((r.doc_id, secrets.redact(r.text, secrets.find_secrets(r.text, model)))) for r in before.collect())
    assert want == sorted(repr((r.doc_id, r.text)) for r in after.collect())


def test_mixing_stage(stages):
    _, before, after = stages[3]
    size, taken = {}, {}
    for r in before.collect():
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    for r in after.collect():
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    assert {s: taken.get(s, 0) for s in names} == {s: int(t + 1e-9) for s, t in zip(names, mixing.targets([size[s] for s in names]), strict=True)}


def test_packing_stage(stages):
    _, before, after = stages[4]
    want = sorted((r.doc_id is None, r.doc_id or 0, zlib.crc32(np.array(expected_ids(r.text), "<u4").tobytes())) for r in before.collect())
    pieces = sorted(after.collect(), key=lambda r: (r.sequence_id, r.offset))
    assert sum(r.length for r in pieces) == sum(len(expected_ids(r.text)) for r in before.collect())
    whole = [(r.doc_id is None, r.doc_id or 0, zlib.crc32(bytes(r.ids))) for r in pieces if r.length == r.doc_tokens]
    assert set(whole) <= set(want) and all(len(r.ids) == 4 * r.length for r in pieces)


def test_run(spark, messy, empty, stages):
    got = corpus_pipeline.run(spark, messy)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, stages[4][2].collect()))
    assert corpus_pipeline.run(spark, empty).collect() == [] and corpus_pipeline.ORACLE_SQL is None
