"""The entry module: every query against its SQL on the smallest tables, and what must work without the llm folders."""

import glob
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessella.functions.safe import readable
from tessella.plans import pipeline
from tessella.sources import tables
from tessella.streaming.rates import windowed_rate

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(pipeline.all_sql()))
def test_query_matches_sql(spark, duck, name):
    df = pipeline.all_queries()[name](spark, DATA)
    want = duck.sql(pipeline.all_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rows = sorted((tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert len(got) == len(rows)
    for a, b in zip(got, rows, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(pipeline.all_queries()) - set(pipeline.all_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert pipeline.all_queries()[name](spark, DATA).limit(1).count() == 1


def test_works_without_the_llm_folders(tmp_path):
    for name in ("tessella", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tessella" / "llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op')])"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split()[0] == str(len(pipeline.all_queries())) and "[]" in said.stdout


def test_sinks(spark, tmp_path):
    results = pipeline.run_all(spark, DATA, ["rate_by_group", "group_mean_std"])
    pipeline.save(results, str(tmp_path))
    again = tables.csv(spark, f"{tmp_path}/rate_by_group.csv", "event_type string, rate_pct double, n long")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, results["rate_by_group"].collect()))
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == ["group_mean_std: 3 rows", "rate_by_group: 5 rows"]


def test_streamed_rates_equal_batch(spark, tmp_path):
    events = tables.table(spark, DATA, "events")
    flag = events.value > 10
    want = {tuple(r) for r in windowed_rate(events, "ts", ["event_type"], flag, "1 day").collect()}
    stream = spark.readStream.schema(events.schema).parquet(f"{DATA}/events.parquet*")
    query = windowed_rate(stream, "ts", ["event_type"], stream.value > 10, "1 day").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("rates").collect()} == want


def test_readable_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("normal_texture_contrast_d1_a45",), ("sem_morph_num_objects",)], "c string")
    assert [r[0] for r in df.select(readable(F.col("c"))).collect()] == ["Optical Texture Contrast D1 A45", "Sem Morph Num Objects"]
