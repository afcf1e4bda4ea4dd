"""The pipeline against its stages by hand, and the guard of the driver contract."""

import subprocess
import sys

import corpus_pipeline
import __spark_entry__ as entry

from cartolith.llm import line_dedup, packing, pii, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, SF)
        assert done.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = done.cache()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    run = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(*key).collect())) == sorted(map(tuple, packed.select(*key).collect()))


def test_stages_take_rows_of_their_own(spark):
    from .fixture import frame

    docs = frame(spark)
    lab = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for done in (toxicity.stage(docs, lab), line_dedup.stage(docs), simhash.stage(docs), pii.stage(docs)):
        assert done.columns == docs.columns and done.count() > 0
    assert packing.pack_documents(docs, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).count() >= docs.count()
    empty = frame(spark, [])
    for done in (toxicity.stage(empty, lab), line_dedup.stage(empty), simhash.stage(empty), pii.stage(empty)):
        assert done.columns == docs.columns and done.count() == 0


def test_eleven_queries():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    dealt = range(1, 11)
    assert set(dealt) <= {int(n[2:].split("_")[0]) for n in names} and "pipeline" in entry.queries()


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree("cartolith", tmp_path / "cartolith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy("__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1') or n == 'pipeline' for n in q); print(len(q), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
