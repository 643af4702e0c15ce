from pyspark.sql import functions as F

from textloom.operators import evaluate, evidence, lifecycle, report
from textloom.sources import files


def test_coverage_joins_touching_ranges(spark):
    ranges = spark.createDataFrame([(1, 10, 30), (1, 20, 40), (1, 10, 30), (1, 60, 70), (2, 5, 25), (2, 10, 15), (2, 25, 30), (2, 30, 31)], "doc_id long, start long, end long")
    lengths = spark.createDataFrame([(1, 100), (2, 40), (3, 0)], "doc_id long, length long")
    got = {r["doc_id"]: r for r in report.document_coverage(ranges, lengths).collect()}
    assert (got[1]["covered"], got[1]["ratio"], got[1]["raw_count"]) == (40, 0.4, 4)
    assert [tuple(m) for m in got[2]["merged"]] == [(5, 31)]
    assert got[3]["ratio"] == 0
    strict = report.islands(ranges.where("doc_id = 2"), "doc_id", merge_adjacent=False).select("island").distinct().count()
    assert strict == 3
    bad = spark.createDataFrame([(1, 4, 4), (1, -1, 4), (1, 5, 11), (1, 0, 10)], "doc_id long, start long, end long")
    assert report.invalid_ranges(bad, "doc_id", spark.createDataFrame([(1, 10)], "doc_id long, length long")).count() == 3


def test_token_blocks_follow_difflib(spark):
    left = spark.createDataFrame([(1, "Bir iki üç, dört beş altı yedi")], "id long, content string")
    right = spark.createDataFrame([(2, "iki üç beş altı BİR")], "id long, content string")
    pairs = spark.createDataFrame([(1, 2)], "l long, r long")
    got = sorted((r["doc_from"], r["doc_to"], r["src_from"], r["src_to"], r["tokens"]) for r in evidence.token_blocks(pairs, left, right).collect())
    assert got == [(4, 10, 0, 6, 2), (17, 25, 7, 15, 2)]


def test_threshold_is_inclusive_and_ratios_null_on_zero(spark):
    scored = spark.createDataFrame([("a", 0.800889, "match"), ("b", 0.2, "no_match")], "case_id string, score double, label string")
    at = spark.createDataFrame([(0.800889,), (0.8009,)], "threshold double").select(F.col("threshold").cast("decimal(20,12)").alias("threshold"))
    got = {float(r["threshold"]): r for r in evaluate.threshold_sweep(scored, at).collect()}
    assert got[0.800889]["tp"] == 1 and got[0.8009]["fn"] == 1 and got[0.8009]["precision"] is None


def test_decode(spark):
    rows = [(1, "düz".encode()), (2, "şey".encode("cp1254")), (3, "çok".encode("utf-16")), (4, b""), (5, None)]
    got = {r["id"]: r for r in files.decode_text(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert [got[i]["text"] for i in (1, 2, 3)] == ["düz", "şey", "çok"]
    assert got[4]["decode_error"] == "empty" and got[5]["decode_error"] == "empty"


def test_admission_and_partition_replace(spark, tmp_path):
    rows = [("a.txt", "text/plain", b"abc"), ("a.txt", "text/plain", b"a\x00b"), ("a.txt", "text/plain", b"\x01" * 5 + b"a" * 5), ("a.exe", "text/plain", b"x"), ("a.pdf", "text/plain", b"x"), ("a.txt", "text/plain", b"")]
    df = spark.createDataFrame(rows, "f string, t string, c binary")
    got = [r[0] for r in df.select(lifecycle.admission_code(F.col("f"), F.col("t"), F.col("c"))).collect()]
    assert got == ["accepted", "signature_mismatch", "signature_mismatch", "unsupported_file_type", "unsupported_file_type", "empty_file"]
    path = str(tmp_path / "sink")
    files.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, x string"), path, "doc_id")
    files.replace_partitions(spark.createDataFrame([(2, "c")], "doc_id int, x string"), path, "doc_id")
    assert {(r["doc_id"], r["x"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
