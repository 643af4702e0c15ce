import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from textloom.operators import evaluate, report


@pytest.mark.parametrize("adjacent", [True, False])
def test_islands_of_a_large_document_equal_the_window(spark, adjacent):
    rng = random.Random(1)
    rows = []
    for _ in range(900):
        key = rng.choice([1, 1, 2, 3, 4, 5, None])
        start = rng.randint(0, 2000)
        rows.append((key, start, start + rng.choice([1, 2, 5, 30]) + (1900 if rng.random() < 0.002 else 0), "x"))
    rows += rows[:40]
    ranges = spark.createDataFrame(rows, "doc_id int, start long, end long, _x string")

    def groups(heavy):
        out = report.islands(ranges, "doc_id", merge_adjacent=adjacent, heavy=heavy)
        assert out.columns == [*ranges.columns, "island"]
        return sorted(((r["doc_id"], r["island"], r["start"], r["end"]) for r in out.collect()), key=str)

    assert groups(50) == groups(10_000)
    assert report.islands(ranges.limit(0), "doc_id", heavy=1).count() == 0


def test_pages_by_key_equal_pages_by_offset(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"m{i}", rng.randint(1, 5), float(Decimal(rng.randint(7500, 7600)) / 10_000), rng.randint(0, 50), i) for i in range(3000)]
    matches = spark.createDataFrame(rows, "match_id string, source_id int, score double, start long, end long")
    path = str(tmp_path / "report")
    report.store_report(matches, path, rows=100)
    order = sorted(rows, key=lambda r: (-r[2], r[3], r[0]))

    def key(row):
        return row[2], row[3], row[0]

    for begin in (0, 20, 1000, 2980, 3000):
        page = report.next_page(spark, path, key(order[begin - 1]) if begin else None)
        assert [tuple(r) for r in page.collect()] == order[begin : begin + 20] and len(page.inputFiles()) <= 3
    assert [tuple(r) for r in report.next_page(spark, path, key(order[1999]), limit=7).collect()] == [tuple(r) for r in report.evidence_page(matches, 2000, 7).collect()]
    # one row per score and page among rows of other sources
    rare = [r for r in order if r[1] == 3 and r[2] >= 0.755]
    page = report.next_page(spark, path, key(rare[4]), limit=100, source_id=3, minimum=0.755)
    assert [tuple(r) for r in page.collect()] == rare[5:105]
    assert report.next_page(spark, path, source_id=9).count() == 0 and report.next_page(spark, path, minimum=0.9).count() == 0
    with pytest.raises(ValueError):
        report.next_page(spark, path, limit=0)
    report.store_report(matches.limit(0), str(tmp_path / "none"))
    assert report.next_page(spark, str(tmp_path / "none")).count() == 0


def test_small_files_of_a_report_are_bounded(spark, tmp_path):
    assert [report.report_files(n, 50) for n in (0, 1, 120, 3200, 10**6, 2**24, 2**25)] == [1, 1, 3, 64, 64, 64, 128]
    assert report.report_files(2**26, 2**20) == 64 and report.report_files(2**30, 2**20) == 1024
    matches = spark.range(20_000).select(F.concat(F.lit("m"), "id").alias("match_id"), F.lit(1).alias("source_id"), (F.col("id") * 7919 % 1009 / 1009).alias("score"), (F.col("id") % 13).alias("start"))
    path = str(tmp_path / "report")
    report.store_report(matches, path, rows=10)
    files = spark.read.parquet(f"{path}/files")
    assert files.count() <= report.REPORT_FILES and files.agg(F.sum("n")).first()[0] == 20_000
    want, after = [tuple(r) for r in report.evidence_page(matches, 0, 60).collect()], None
    for at in (0, 20, 40):
        page = [tuple(r) for r in report.next_page(spark, path, after).collect()]
        assert page == want[at : at + 20]
        after = page[-1][2], page[-1][3], page[-1][0]


def test_a_sweep_is_written_and_read_back(spark, tmp_path):
    rows = [(i, (i * 37 % 101) / 101, "match" if i % 3 else "no_match") for i in range(60)]
    scored = spark.createDataFrame(rows, "case_id int, score double, label string")
    at = spark.createDataFrame([(Decimal("0.5"),), (Decimal("0.123456"),)], "threshold decimal(20,12)")
    path = str(tmp_path / "sweep")
    evaluate.export_sweep(scored, evaluate.threshold_set(scored), at, path, {"algorithm_version": "hybrid-v2", "baseline_threshold": "0.7500"})
    metrics = {Decimal(r["threshold"]): r for r in spark.read.option("header", True).csv(f"{path}/metrics").collect()}
    decided = spark.read.json(f"{path}/decisions").collect()
    assert len(metrics) == evaluate.threshold_set(scored).count() + 1 and len(decided) == 120
    labels = {i: label for i, _, label in rows}
    for t in (Decimal("0.5"), Decimal("0.123456")):
        own = [(r["decision"], labels[r["case_id"]]) for r in decided if Decimal(str(r["threshold"])) == t]
        counts = {"tp": ("match", "match"), "fp": ("match", "no_match"), "fn": ("no_match", "match"), "tn": ("no_match", "no_match")}
        assert {n: int(metrics[t][n]) for n in counts} == {n: own.count(c) for n, c in counts.items()}
    assert spark.read.json(f"{path}/settings").first().asDict() == {"algorithm_version": "hybrid-v2", "baseline_threshold": "0.7500", "comparison": "score >= threshold"}
