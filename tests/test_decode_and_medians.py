import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from textloom.operators import evaluate
from textloom.sources import files

TURKISH = "Türkiye'de eğitim, öğretim ve bilimsel araştırma önemlidir. ÖĞRENCİLER özgün düşünceler geliştirir. "
FRENCH = "L'élève était là où l'on parlait « français » ; ça coûtait 5 £ à Noël."
RUSSIAN = "Съешь ещё этих мягких французских булок, да выпей чаю. "


def test_bytes_sort_by_what_they_are(spark):
    rng = random.Random(4)
    texts = [TURKISH.encode("cp1254"), TURKISH.encode("iso8859-9") * 5, FRENCH.encode("cp1252"), RUSSIAN.encode("koi8-r"), "20 \u00b0C bei klarem Wetter".encode("cp1254"), "şöyle".encode("cp1254"), "ÖĞÜŞ".encode("cp1254"), b"caf\xe9"]
    noise = [bytes(range(1, 256)), bytes([0xA2, 0xA5, 0xB1, 0xBF] * 30), *(rng.randbytes(200) for _ in range(60)), TURKISH.encode("cp1254") + rng.randbytes(300)]
    assert all(files.text_odds(t) >= files.LEAST_ODDS for t in texts) and all(files.text_odds(t) < files.LEAST_ODDS for t in noise)
    # what the first encoding leaves undefined is refused, however likely
    noise.append(bytes(range(128, 256)))
    marked = [(TURKISH.encode(codec), TURKISH) for codec in ("utf-16", "utf-32", "utf-8-sig")] + [("\ufeff".encode("utf-16-be") + TURKISH.encode("utf-16-be"), TURKISH), (b"\xff\xfe\x00", None)]
    rows = [(i, c) for i, c in enumerate([*texts, *noise, *(c for c, _ in marked)])]
    got = {r["id"]: (r["text"], r["decode_error"]) for r in files.decode_text(spark.createDataFrame(rows, "id int, content binary")).collect()}
    want = [t.decode("cp1254") for t in texts] + [None] * len(noise) + [t for _, t in marked]
    assert got == {i: (t, None if t is not None else "undecodable") for i, t in enumerate(want)}


@pytest.mark.parametrize("margin", [0.002, 0.0])
def test_medians_are_exact(spark, margin):
    rng = random.Random(5)
    rows = [("hot", rng.lognormvariate(0, 9)) for _ in range(20_001)] + [("even", float(rng.randint(0, 9))) for _ in range(1000)] + [("two", 1.0), ("two", 4.0), ("one", -3.0), ("none", None), (None, 2.0), (None, 3.0), (None, None)]
    rows += [("skew", 0.0)] * 700 + [("skew", rng.random()) for _ in range(699)] + [("big", -1e300), ("big", 1e300), ("big", 5.0)]
    got = {r["k"]: r["median"] for r in evaluate.exact_medians(spark.createDataFrame(rows, "k string, x double"), "k", "x", margin).collect()}
    assert got == {k: statistics.median(x for key, x in rows if key == k and x is not None) for k in {k for k, x in rows if x is not None}}
    summary = evaluate.run_summary(spark.createDataFrame([(k, x, "failed") for k, x in rows[-4:]] + [("none", None, "completed")], "k string, seconds double, status string"), "k")
    assert {r["k"]: (r["median"], r["failed"], r["completed"]) for r in summary.collect()} == {"skew": (rows[-4][1], 1, 0), "big": (5.0, 3, 0), "none": (None, 0, 1)}


def test_grid_of_weights(spark):
    rows = [tuple(r) for r in evaluate.weight_grid(spark, (Decimal("0.50"), Decimal("0.25"), Decimal("0.25"))).collect()]
    assert [r[0] for r in rows] == list(range(7)) and all(sum(r[1:4]) == pytest.approx(1) for r in rows)
    assert [(round(r[1], 2), round(r[2], 2), round(r[4], 2)) for r in rows] == [(0.45, 0.25, 0.1), (0.45, 0.3, 0.1), (0.5, 0.2, 0.1), (0.5, 0.25, 0.0), (0.5, 0.3, 0.1), (0.55, 0.2, 0.1), (0.55, 0.25, 0.1)]
    assert evaluate.weight_grid(spark, (Decimal("0.95"), Decimal("0.03"), Decimal("0.02"))).where(F.col("w1") >= 1).isEmpty()
