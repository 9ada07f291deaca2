"""The pipeline: stages against brute force, and the library without its optional folders."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, sf):
    import corpus_pipeline as P
    from maskwright.llm.blob_ledger import ASSIGN
    from maskwright.llm.decontam import shingles_of

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    first = P.language_id(spark, docs.unionByName(spark.createDataFrame([(9999, "12 !!", "en", "s", 5)], docs.schema)), sf)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()}
    second = P.near_duplicates(spark, docs, sf)
    assert second.columns == columns and 0 < second.count() <= docs.count()
    items = [shingles_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in docs.collect() if any(len(i & shingles_of(r.text)) >= 0.8 * len(i) for i in items)}
    third = P.decontamination(spark, docs, sf)
    assert bad and third.columns == columns and {r.doc_id for r in third.collect()} == {r.doc_id for r in docs.collect()} - bad
    fourth = P.secrets(spark, docs, sf)
    assert fourth.columns == columns and fourth.count() == docs.count() and fourth.where(F.regexp_extract("text", ASSIGN, 1).rlike(".{12}")).count() == 0
    both = fourth.alias("a").join(docs.alias("b"), "doc_id")
    changed = both.where("a.text <> b.text")
    assert changed.where("a.text not like '%[SECRET]%'").count() == 0 and both.where("a.n_chars <> length(a.text)").count() == both.where("b.n_chars <> length(b.text) and a.text = b.text").count()


def test_run_and_empty(spark, sf, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "packing"]
    rows = P.run(spark, sf)
    assert rows.count() > 0 and rows.groupBy("doc_id", "start").count().where("count > 1").count() == 0
    for name in ("documents", "benchmark"):
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        (table.limit(0) if name == "documents" else table).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0


def test_entry_without_the_folders(tmp_path):
    for p in ("__spark_entry__.py", "maskwright"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    import shutil

    shutil.copytree(ROOT / "maskwright", tmp_path / "maskwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "__spark_entry__.py").unlink()
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
