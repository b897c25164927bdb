"""What all corpus operators share: slices by rows and bytes, the shared folder, folders that are deleted, registration; and texts of tens of megabytes."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, gru_lm, langid, licenses, matroska, packing, secrets, simhash

ROOT = Path(__file__).resolve().parents[2]


def test_slices_are_whole_and_bounded():
    texts = ["x" * n for n in (0, 5, 3000, 10, 0, 900, 900, 900, 1, 8000, 2)] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([{"t": t} for t in texts])], ["n", "t", "s"])
    for rows, most in ((512, 1 << 20), (3, 1 << 20), (512, 4000), (4, 1)):
        parts = list(common.slices(batch, rows, most))
        assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches([batch]).to_pylist()
        assert all(p.num_rows <= rows and (p.num_rows == 1 or p.nbytes <= most) for p in parts)
    assert list(common.slices(batch.slice(0, 0))) == []


def test_shared_folder_is_never_local_on_a_cluster():
    made = []
    session = lambda master, folder: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append), conf=SimpleNamespace(get=lambda *_: folder))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]", "k8s://https://host"):
        with pytest.raises(RuntimeError):
            common.shared_folder(session(master, None))
    assert common.shared_folder(session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    made.clear()
    assert common.shared_folder(session("local[4]", None)).startswith("/")


def test_written_rows_can_be_discarded(spark):
    before = common.made(spark)
    df = common.written(spark.range(5).toDF("n"))
    (folder,) = [f for f in common.made(spark) if f not in before]
    assert df.count() == 5
    common.discard(spark, [folder])
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and common.made(spark) == before


def test_pipeline_leaves_nothing_but_its_last_input(spark, messy):
    import corpus_pipeline

    before = common.made(spark)
    out = corpus_pipeline.run(spark, messy)
    assert len([f for f in common.made(spark) if f not in before]) == 1 and out.count() > 0


def test_queries_register_without_a_library(tmp_path):
    """Without one of the libraries the engine's queries are there still."""
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here')\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 55 and not any(n.startswith('op') for n in q), sorted(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"})


def test_texts_of_tens_of_megabytes(spark):
    """One row of 24 MB beside small ones, through every map of whole texts."""
    long = ("people of the house by the water " * 20 + "\n") * 37_000
    docs = spark.createDataFrame([(1, "the people"), (2, long), (3, "another text of the house")], "doc_id long, text string").coalesce(1)
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    n = len(long.split())
    assert len(long) > 24_000_000
    got = {r.id: r.payload_bytes for r in matroska.read_media(matroska.store_payloads(docs)).select("id", F.octet_length("payload").alias("payload_bytes")).collect()}
    assert got[2] == -(-len(long) // 64) * 64
    pieces = packing.pack_documents(docs).where("id = 2").agg(F.sum("length"), F.max("doc_tokens"), F.count("*")).first()
    assert pieces[0] == pieces[1] > n and pieces[2] >= pieces[0] // 4096
    prints = {r.id: r.fp for r in simhash.fingerprints(docs).collect()}
    assert bytes(prints[2]) == simhash.fingerprint(long)[0]
    assert licenses.scan_licenses(docs).count() == 3 and secrets.scan_secrets(docs, secrets.fit(docs)).where("size(spans) > 0").count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs)).collect()} == {"en"}
    layout = gru_lm.Layout.make([b"the", b"of", gru_lm.END], np.array([9, 8, 7]), np.ones(gru_lm.TAIL))
    at, rest, ids = layout.find(gru_lm.tokens(long))
    assert len(ids) == n + 1 and len(rest) == (at < 0).sum() and set(ids[at >= 0].tolist()) == {0, 1, 2}
