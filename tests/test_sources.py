import glob
import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from labelloom.plans import catalog
from labelloom.plans import staging
from labelloom.sources import paths, tables
from labelloom.sources.quoted import _lines, read_quoted_csv

CSV = '''count,hate_speech,offensive_language,neither,class,tweet
3,0,0,3,2,"said ""hi"", twice
and more"
3,3,0,0,0,NA
3,0,3,0,1,
3,0,3,0,1,null
'''


@pytest.fixture()
def csv_path(tmp_path):
    path = tmp_path / "labeled_data.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path)


def test_read_csv(spark, csv_path):
    df = tables.read_labeled_csv(spark, csv_path)
    assert dict(df.dtypes)["class"] == "int"
    assert [r["tweet"] for r in df.collect()] == ['said "hi", twice\nand more', "NA", None, "null"]
    strict = tables.read_labeled_csv(spark, csv_path, tables.CORPUS_SCHEMA, na_values=["NA", "null"])
    assert [r["tweet"] for r in strict.collect()] == ['said "hi", twice\nand more', None, None, None]
    assert strict.columns == df.columns


def test_first_existing(spark, csv_path):
    assert paths.first_existing(spark, csv_path) == csv_path
    assert paths.first_existing(spark, csv_path + ".no", ["/nowhere", csv_path]) == csv_path
    assert paths.first_existing(spark, None, [csv_path]) == csv_path
    with pytest.raises(FileNotFoundError):
        paths.first_existing(spark, "/nowhere", [])


def test_run_path(spark, tmp_path):
    base, now = str(tmp_path), datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    assert paths.run_path(spark, "r", base, now=now) == f"{base}/r"
    os.mkdir(f"{base}/r")
    assert paths.run_path(spark, "r", base, now=now) == f"{base}/r_20240102T030405Z"
    assert paths.run_path(spark, "r", base, force=True) == f"{base}/r"
    assert paths.run_path(spark, "r", base, reuse=True) == f"{base}/r"
    assert paths.run_path(spark, None, base, now=now) == f"{base}/run_20240102T030405Z"
    assert paths.run_path(spark, None, base, reuse=True, now=now) == f"{base}/20240102_030405"


def test_write_table_refuses_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b')], "n int, t string")
    path = tables.write_table(df, str(tmp_path), "t", "csv")
    assert tables.read_labeled_csv(spark, path).collect() == df.collect()
    with pytest.raises(Exception, match="already exists"):
        tables.write_table(df, str(tmp_path), "t", "csv")
    tables.write_table(df, str(tmp_path), "t", "csv", mode="overwrite")


def test_metrics_document(spark, tmp_path):
    document = {"LogisticRegression": {"accuracy": 0.5, "precision": 0.25, "recall": 0.5, "f1": 0.75}, "LinearSVC": {"accuracy": 1.0, "precision": 1.0, "recall": 1.0, "f1": 1.0}}
    path = tmp_path / "metrics_summary.json"
    path.write_text(json.dumps(document, indent=2))
    rows = tables.read_metrics(spark, str(path))
    assert [(r["model"], r["ordinal"], r["f1"]) for r in rows.collect()] == [("LogisticRegression", 0, 0.75), ("LinearSVC", 1, 1.0)]
    assert json.loads(tables.metrics_document(rows).first()["value"]) == document


def test_missing_metrics_are_skipped(spark, capsys):
    assert tables.read_metrics(spark, "/nowhere/metrics.json") is None
    assert "no baseline metrics" in capsys.readouterr().out


def test_head_sample(spark):
    df = spark.range(100).withColumn("t", F.lit("x"))
    assert [r["id"] for r in tables.head_sample(df, 3, "id").collect()] == [0, 1, 2]
    plan = tables.head_sample(df, 3, "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_staging(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    staged = staging.stage(spark.range(10))
    assert staged.count() == 10
    if root:
        assert staging.staging_root(spark) == root.rstrip("/")
        assert root.rstrip("/") in staged.inputFiles()[0]
    assert staging.fits_in_memory(staged) and not staging.fits_in_memory(staged, max_rows=9)
    words = spark.createDataFrame([("x" * 50,)], "w string")
    assert not staging.fits_in_memory(words, max_bytes=60) and staging.fits_in_memory(words, max_bytes=70)


def test_spread_only_small_inputs(spark):
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(0, 10, 1, 1)
    assert staging.spread(few, "id").rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores * 2)
    assert staging.spread(many, "id") is many


@pytest.mark.parametrize("size", [40, 97, 1_000, 100_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_do_not_keep_a_file_whole(spark, tmp_path, size, end):
    texts = ["plain", 'said ""hi"", twice', "two\nlines", "\n", "a\n\n\nb,c", '""', "é" * 30, "x\n" * 80, "last, one"]
    rows = [(i, texts[i % len(texts)]) for i in range(60)]
    quoted = lambda t: f'"{t}"' if set(t) & set('",\n') else t
    for k in (0, 1):
        lines = [f"{i},{quoted(t)},{i % 3}" for i, t in rows[k * 30 : k * 30 + 30]] + [f"{100 + k},,", f'{102 + k},"",2']
        (tmp_path / f"part{k}.csv").write_bytes((end.join(["id,text,class", *lines]) + (end if k else "")).encode())
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = read_quoted_csv(spark, str(tmp_path))
        many = _lines(spark, str(tmp_path)).rdd.getNumPartitions()
        plain = tables.read_labeled_csv(spark, str(tmp_path), na_values=["plain"])
        assert found.dtypes == plain.dtypes == [("id", "int"), ("text", "string"), ("class", "int")]
        assert read_quoted_csv(spark, str(tmp_path), na_values=["plain"]).orderBy("id").collect() == plain.orderBy("id").collect()
        assert read_quoted_csv(spark, str(tmp_path), plain.schema).count() == 64
        assert many > 20 or size > 97
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_quoted_names_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeff"the, id",,"b""q"\n1,2.5,"x\ny"\n')
    found = read_quoted_csv(spark, str(tmp_path / "a.csv"))
    assert found.dtypes == [("the, id", "int"), ("_c1", "double"), ('b"q', "string")] and [tuple(r) for r in found.collect()] == [(1, 2.5, "x\ny")]
    (tmp_path / "b.csv").write_text("")
    assert read_quoted_csv(spark, str(tmp_path / "b.csv")).collect() == []


def test_no_task_writes_the_whole_quoted_file(spark, tmp_path, monkeypatch):
    written = []
    plain = catalog.tables.write_table
    monkeypatch.setattr(catalog.tables, "write_table", lambda *a, **b: written.append(plain(*a, **b)) or written[-1])
    rows = [(i, f'a "quoted"\nline, {i}') for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = catalog.QUERIES["csv_quoted_split"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == rows
    assert len(glob.glob(f"{written[0].removeprefix('file:')}/part-*")) > 1
