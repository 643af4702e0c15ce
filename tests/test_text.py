import random
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from textloom.config import Config
from textloom.functions import text as T
from textloom.operators import chunks
from textloom.operators import similarity as S


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]


def test_words_fold_turkish(spark):
    assert one(spark, T.words, "Türkçe METİN, sayı 42! Straße IŞIK") == ["türkçe", "metin", "sayı", "42", "strasse", "ışık"]


def test_normalize(spark):
    assert one(spark, T.normalize_text, " a\t b c \r\n\r\n d\x07e ") == "a b c\n\nd e"
    rows = spark.createDataFrame([("İü",), (None,), ("düz",)], "s string")
    assert {r[0] for r in T.nfc(rows, "s").collect()} == {"İü", None, "düz"}


def test_chunks_keep_offsets_and_pages(spark):
    parts = spark.createDataFrame([(1, 0, 1, ""), (1, 1, 2, "Dr. Ayşe geldi. Sonra ayrıldı.\n\nA. Ünal! İ. Kaya? B"), (2, 0, None, None)], "doc_id long, part_no int, page_number int, text string")
    rows = chunks.chunk_corpus(parts).orderBy("chunk_index").collect()
    text = chunks.join_parts(parts).where("doc_id = 1").first()["text"]
    assert [r["content"] for r in rows] == ["Dr. Ayşe geldi.", "Sonra ayrıldı.", "A. Ünal!", "İ.", "Kaya?", "B"]
    assert all(text[r["char_start"] : r["char_end"]] == r["content"] and r["page_number"] == 2 for r in rows)
    assert rows[0]["char_start"] == 1


def test_pair_scores_equal_a_model_fitted_on_the_pair(spark):
    import math
    from collections import Counter

    def grams(t, low, high, n):
        return Counter(t[i : i + k] for k in range(low, high + 1) for i in range(len(t) - k + 1)) if n else None

    def cosine(a, b):
        both = set(a) | set(b)
        idf = {g: math.log(3 / (1 + (g in a) + (g in b))) + 1 for g in both}
        x, y = ({g: c * idf[g] for g, c in t.items()} for t in (a, b))
        dot = sum(x[g] * y[g] for g in set(x) & set(y))
        return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    left, right = "bu metin ortak bir ifade taşır ve sürer", "bu metin ortak başka ifade taşır ve biter"
    a = spark.createDataFrame([(1, left), (2, "ilgisiz")], "id long, text string")
    b = spark.createDataFrame([(7, right), (8, left)], "id long, text string")
    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "l long, r long")
    got = {(r["l"], r["r"]): r for r in S.score_pairs(pairs, a, b, prune=False).collect()}
    words = [tuple(t.split()) for t in (left, right)]
    assert got[1, 7]["word"] == pytest.approx(cosine(*(grams(w, 1, 3, 1) for w in words)), abs=1e-9)
    assert got[1, 7]["char"] == pytest.approx(cosine(*(grams(t, 3, 5, 1) for t in (left, right))), abs=1e-9)
    assert got[1, 8]["score"] == 1 and got[2, 7]["score"] == 0
    assert {(r["l"], r["r"]) for r in S.match_pairs(a, b).collect()} == {(1, 8)} | ({(1, 7)} if got[1, 7]["score"] >= Decimal("0.75") else set())


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Config(word_weight=Decimal("0.6"))
    with pytest.raises(ValueError):
        Config(word_range=(3, 1))
    with pytest.raises(ValueError):
        Config.from_snapshot({"algorithm_version": "other"})


def test_folding_equals_full_case_folding(spark):
    letters = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000 and chr(c) not in "Iİ"]
    texts = ["".join(letters[i : i + 50]) for i in range(0, len(letters), 50)] + ["Straße µ “IŞIK” İzmir", ""]
    df = spark.createDataFrame([(t, t.replace("I", "ı").replace("İ", "i").lower()) for t in texts], "text string, low string")
    low = {r["text"]: r["folded"] for r in df.select("text", T.fold(F.col("text")).alias("folded")).collect()}
    assert low[""] == "" and low["Straße µ “IŞIK” İzmir"] == "strasse μ “ışık” izmir"
    for text, folded in low.items():
        # Java and Python may know letters of different Unicode versions
        odd = [c for c in text if c not in "Iİ" and unicodedata.category(c) != "Cn" and c.lower().casefold() not in folded]
        assert not odd or all(ord(c) > 0x1C80 for c in odd), odd


def test_blanks_and_ends_of_lines(spark):
    cases = [("  a \t b\u3000c  \n \n x ", "a b c\n\nx"), ("\n\n \r\n q\xa0", "q"), (" ", ""), ("a  ", "a"), ("a \u2028 b", "a b")]
    got = {r["t"]: r["n"] for r in spark.createDataFrame([(t,) for t, _ in cases], "t string").select("t", T.normalize_text(F.col("t")).alias("n")).collect()}
    assert got == dict(cases)


def test_texts_left_alone_are_those_that_normalizing_keeps(spark):
    rng = random.Random(3)
    signs = ["a", "b", " ", "\n", "\r", "\t", "\x85", "\xa0", "\xad", "é", "ſ", "ΰ", "͸", " ", "…", "”", " ", " ", "語", "\U0001f600", "\U000e0001"]
    rows = [("".join(rng.choice(signs[: rng.choice((4, 6, 21))]) for _ in range(rng.randrange(7))),) for _ in range(3000)] + [(None,)]
    out = spark.createDataFrame(rows, "t string").select("t", T.normalize_text(F.col("t")).alias("got"), T._normalized(F.col("t")).alias("want")).collect()
    assert not [r for r in out if r["got"] != r["want"]]
    assert sum(r["t"] == r["want"] for r in out) > 100
