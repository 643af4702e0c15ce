"""Contiguous equal token blocks of text pairs, longest first, as joins and columns.

In the window of two whole texts the longest equal run of tokens is a block
(of equally long ones the first on the left side, then on the right); so in
the two windows before and behind it, and so on. What one block crosses out is
never looked at again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.similarity import by_firsts, small
from textloom.tables import dealt, keep

#: Token pairs of a window that one row may compare by itself; larger windows go by joins.
CELLS = 1 << 16
#: Times that a row's windows are split between two written tables.
ROUNDS = 3
_WINDOW = "array<struct<alo:int,ahi:int,blo:int,bhi:int>>"
_BLOCK = "array<struct<i:int,j:int,size:int>>"


def token_spans(chunks: DataFrame) -> DataFrame:
    """``id, spans``: the words of each row of ``id, content`` in order, folded, with their range in code points.

    Rows are dealt by id before they are cut, so the words meet again without a shuffle.
    """

    def run(piece: Column) -> Column:
        token = F.when(piece.rlike(r"^[\p{L}\p{N}_]"), F.get(T.words(piece), F.lit(0)))
        return F.struct(F.length(piece).alias("length"), token.alias("token"))

    runs = dealt(chunks, "id").select("id", F.posexplode(F.transform(T.token_runs(F.col("content")), run)).alias("at", "run"))
    end = F.sum("run.length").over(Window.partitionBy("id").orderBy("at"))
    words = runs.withColumn("end", end).where("run.token is not null")
    span = F.struct("at", (F.col("end") - F.col("run.length")).alias("from"), F.col("end").alias("to"), F.col("run.token").alias("token"))
    return words.groupBy("id").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def _tokens(spans: str) -> Column:
    return F.transform(spans, lambda s: s["token"])


def _runs(a: Column, b: Column) -> Column:
    """All maximal runs ``i, j, size`` of equal tokens of two arrays, each by its first token pair."""

    def size(i: Column, j: Column) -> Column:
        same = F.zip_with(F.slice(a, i + 1, F.size(a) - i), F.slice(b, j + 1, F.size(b) - j), lambda x, y: F.coalesce(x == y, F.lit(False)))
        return (F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)) - 1).cast("int")

    def starts(i: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda j: (F.get(b, j) == F.get(a, i)) & ~F.coalesce(F.get(b, j - 1) == F.get(a, i - 1), F.lit(False)))
        return F.transform(first, lambda j: F.struct(i.alias("i"), j.alias("j"), size(i, j).alias("size")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(a) - 1), starts))


def _best(window: Column, runs: Column) -> Column:
    """The longest piece ``size, i, j`` of a run inside a window, as its sort key with i and j negative."""

    def clipped(run: Column) -> Column:
        late = F.greatest(F.lit(0), window["alo"] - run["i"], window["blo"] - run["j"])
        size = F.least(run["size"], window["ahi"] - run["i"], window["bhi"] - run["j"]) - late
        return F.struct(size.alias("size"), (-(run["i"] + late)).alias("i"), (-(run["j"] + late)).alias("j"))

    return F.array_max(F.transform(runs, clipped))


def _split(rows: DataFrame) -> DataFrame:
    """Blocks of all ``windows`` of each row added to ``blocks``, and the windows around them."""

    def around(x: Column) -> Column:
        w, i, j, size = x["w"], -x["b"]["i"], -x["b"]["j"], x["b"]["size"]
        return F.array(
            F.struct(w["alo"].alias("alo"), i.alias("ahi"), w["blo"].alias("blo"), j.alias("bhi")),
            F.struct((i + size).alias("alo"), w["ahi"].alias("ahi"), (j + size).alias("blo"), w["bhi"].alias("bhi")),
        )

    found = F.filter(F.transform("windows", lambda w: F.struct(w.alias("w"), _best(w, F.col("runs")).alias("b"))), lambda x: x["b"]["size"] > 0)
    rows = rows.withColumn("found", found)
    blocks = F.transform("found", lambda x: F.struct((-x["b"]["i"]).alias("i"), (-x["b"]["j"]).alias("j"), x["b"]["size"].alias("size")))
    windows = F.filter(F.flatten(F.transform("found", around)), lambda w: (w["alo"] < w["ahi"]) & (w["blo"] < w["bhi"]))
    return rows.withColumns({"blocks": F.concat("blocks", blocks), "windows": windows}).drop("found")


def _by_row(rows: DataFrame, rounds: int) -> DataFrame:
    """``*, i, j, size`` of the blocks of ``*, a, b``, small arrays of tokens; nothing is shuffled."""
    whole = F.array(F.struct(F.lit(0).alias("alo"), F.size("a").alias("ahi"), F.lit(0).alias("blo"), F.size("b").alias("bhi")))
    rows = rows.withColumns({"runs": _runs(F.col("a"), F.col("b")), "windows": whole.cast(_WINDOW), "blocks": F.array().cast(_BLOCK)}).drop("a", "b")
    done = []
    while True:
        for _ in range(rounds):
            rows = _split(rows)
        rows = keep(rows, "blocks")
        done.append(rows.select("*", F.inline("blocks")).drop("runs", "windows", "blocks"))
        rows = rows.where(F.size("windows") > 0)
        if rows.isEmpty():
            return reduce(DataFrame.union, done)
        rows = rows.withColumn("blocks", F.array().cast(_BLOCK))


def _names(spans: DataFrame, levels: int) -> DataFrame:
    """``id, at, names``: for each power of two, a 128-bit name of so many tokens from a place on; null beyond the end."""
    order = Window.partitionBy("id").orderBy("at")
    rows = spans.select("id", F.posexplode(_tokens("spans")).alias("at", "token"))

    def name(*parts: Column) -> Column:
        return F.struct(F.xxhash64(*parts).alias("u"), F.xxhash64(F.lit(1), *reversed(parts)).alias("v"))

    rows = rows.select("id", "at", name(F.col("token")).alias("n0"))
    for k in range(1, levels):
        before = F.col(f"n{k - 1}")
        behind = F.lead(before, 1 << (k - 1)).over(order)
        rows = rows.withColumn(f"n{k}", F.when(behind.isNotNull(), name(before["u"], before["v"], behind["u"], behind["v"])))
    return rows.select("id", "at", F.array(*(f"n{k}" for k in range(levels))).alias("names"))


def _longest(windows: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``l, r, w, i, j, size`` of the first longest block of each window ``l, r, w, alo, ahi, blo, bhi`` that has any.

    The length is found by halving: equal texts of one length have equal
    names, of which only the first places on both sides are compared, so no
    pair of places is ever listed.
    """
    key = ["l", "r", "w"]
    # lengths below low are reached, those from high on are not; the whole shorter side is tried first
    least = F.least(F.col("ahi") - F.col("alo"), F.col("bhi") - F.col("blo"))
    state = windows.withColumns({"low": F.lit(0), "high": least + 1, "length": least, "i": F.lit(-1), "j": F.lit(-1)})
    while True:
        state = keep(state, "lengths")
        going = state.where("high - low > 1")
        if going.isEmpty():
            return state.where("low > 0").select(*key, "i", "j", F.col("low").alias("size"))
        # the greatest power of two within the length, and what it leaves
        going = going.withColumn("level", F.length(F.bin("length")) - 1).withColumn("shift", F.expr("length - shiftleft(1, level)"))

        def side(names: DataFrame, chunk: str, lo: str, hi: str, place: str, going: DataFrame = going) -> DataFrame:
            head = going.select(*key, F.col(chunk).alias("id"), lo, hi, "length", "level", "shift").join(names, "id").where((F.col("at") >= F.col(lo)) & (F.col("at") + F.col("length") <= F.col(hi)))
            head = head.select(*key, "id", "at", "level", (F.col("at") + F.col("shift")).alias("second"), F.get("names", F.col("level")).alias("x"))
            tail = names.select("id", F.col("at").alias("second"), F.col("names").alias("behind"))
            named = head.join(tail, ["id", "second"]).select(*key, "at", "x", F.get("behind", F.col("level")).alias("y"))
            return named.groupBy(*key, "x", "y").agg(F.min("at").alias(place))

        both = side(left, "l", "alo", "ahi", "i").join(side(right, "r", "blo", "bhi", "j"), [*key, "x", "y"])
        best = both.groupBy(*key).agg(F.min(F.struct("i", "j")).alias("found"))
        state = state.join(best, key, "left")
        hit, going_on = F.col("found").isNotNull(), F.col("high") - F.col("low") > 1
        state = state.withColumns(
            {
                "i": F.when(hit, F.col("found.i")).otherwise(F.col("i")),
                "j": F.when(hit, F.col("found.j")).otherwise(F.col("j")),
                "low": F.when(hit, F.col("length")).otherwise(F.col("low")),
                "high": F.when(going_on & ~hit, F.col("length")).otherwise(F.col("high")),
            }
        ).drop("found")
        state = state.withColumn("length", F.expr("(low + high) div 2").cast("int"))


def _by_joins(pairs: DataFrame, left: DataFrame, right: DataFrame, cells: int) -> tuple[DataFrame, DataFrame]:
    """Blocks ``l, r, i, j, size`` of long ``pairs`` (``l, r, m, n``: ids and token counts), and the windows left that are small."""
    levels = int(pairs.agg(F.max(F.greatest("m", "n"))).first()[0]).bit_length()
    names = [keep(_names(spans.join(pairs.select(F.col(c).alias("id")).distinct(), "id", "left_semi"), levels), "names") for spans, c in ((left, "l"), (right, "r"))]
    windows = pairs.select("l", "r", F.lit("").alias("w"), F.lit(0).alias("alo"), F.col("m").alias("ahi"), F.lit(0).alias("blo"), F.col("n").alias("bhi"))
    area = (F.col("ahi") - F.col("alo")).cast("long") * (F.col("bhi") - F.col("blo"))
    blocks, small = [], []
    while True:
        windows = keep(windows.where(area > 0), "windows")
        small.append(windows.where(area <= cells))
        windows = windows.where(area > cells)
        if windows.isEmpty():
            return reduce(DataFrame.union, blocks), reduce(DataFrame.union, small)
        found = keep(_longest(windows, *names), "found")
        blocks.append(found.select("l", "r", "i", "j", "size"))
        cut = windows.join(found, ["l", "r", "w"])
        before = cut.select("l", "r", F.concat("w", F.lit("0")).alias("w"), "alo", F.col("i").alias("ahi"), "blo", F.col("j").alias("bhi"))
        behind = cut.select("l", "r", F.concat("w", F.lit("1")).alias("w"), (F.col("i") + F.col("size")).alias("alo"), "ahi", (F.col("j") + F.col("size")).alias("blo"), "bhi")
        windows = before.union(behind)


def token_blocks(pairs: DataFrame, left: DataFrame, right: DataFrame, cells: int = CELLS, rounds: int = ROUNDS) -> DataFrame:
    """``l, r, doc_from, doc_to, src_from, src_to, tokens``: contiguous equal token runs of ``l, r`` pairs of ``id, content`` rows.

    Offsets are code points inside the two contents. Pairs of equal token
    sequences are one block. In windows of at most ``cells`` token pairs a row
    compares its own tokens; larger ones are split by joins over names of
    their tokens, in space that grows with their lengths, until what is left
    is small. Pairs of the same two contents are compared once. Repeated pairs
    count once; pairs with a text without words, null or missing have no block.
    """
    named, left, right = by_firsts(pairs.select("l", "r").distinct(), left, right, lambda texts: texts["content"])
    found = _token_blocks(named.select(F.col("l0").alias("l"), F.col("r0").alias("r")).distinct(), left, right, cells, rounds)
    found = keep(found, "found").withColumnsRenamed({"l": "l0", "r": "r0"})
    return named.join(small(found), ["l0", "r0"]).drop("l0", "r0")


def _token_blocks(pairs: DataFrame, left: DataFrame, right: DataFrame, cells: int, rounds: int) -> DataFrame:
    a, b = (keep(token_spans(c.join(pairs.select(F.col(n).alias("id")).distinct(), "id", "left_semi")), "spans") for c, n in ((left, "l"), (right, "r")))
    both = pairs.select("l", "r").distinct().join(a.withColumnRenamed("id", "l").withColumnRenamed("spans", "ls"), "l").join(b.withColumnRenamed("id", "r").withColumnRenamed("spans", "rs"), "r")
    same, few = _tokens("ls") == _tokens("rs"), F.size("ls").cast("long") * F.size("rs") <= cells
    kinds = F.when(same, "same").when(few, "few").otherwise("long")
    both = keep(both.withColumn("kind", kinds), "pairs")
    key, ranges = ["l", "r"], ["ls", "rs"]
    blocks = both.where("kind = 'same'").select(*key, *ranges, F.lit(0).alias("i"), F.lit(0).alias("j"), F.size("ls").alias("size"))
    rows = both.where("kind = 'few'").select(*key, *ranges, _tokens("ls").alias("a"), _tokens("rs").alias("b"))
    blocks = blocks.union(_by_row(rows, rounds).select(*key, *ranges, "i", "j", "size"))
    long = both.where("kind = 'long'")
    if not long.isEmpty():
        found, rest = _by_joins(long.select(*key, F.size("ls").alias("m"), F.size("rs").alias("n")), a, b, cells)

        def piece(spans: str, low: str, high: str) -> Column:
            return F.transform(F.slice(spans, F.col(low) + 1, F.col(high) - F.col(low)), lambda s: s["token"])

        parts = rest.join(long, key).select(*key, "alo", "blo", piece("ls", "alo", "ahi").alias("a"), piece("rs", "blo", "bhi").alias("b"))
        parts = _by_row(parts, rounds).select(*key, (F.col("i") + F.col("alo")).alias("i"), (F.col("j") + F.col("blo")).alias("j"), "size")
        blocks = blocks.union(found.union(parts).join(long, key).select(*key, *ranges, "i", "j", "size"))

    def place(spans: str, first: Column, end: bool) -> Column:
        return F.get(spans, first + F.col("size") - 1)["to"] if end else F.get(spans, first)["from"]

    i, j = F.col("i"), F.col("j")
    return blocks.select(*key, place("ls", i, False).alias("doc_from"), place("ls", i, True).alias("doc_to"), place("rs", j, False).alias("src_from"), place("rs", j, True).alias("src_to"), F.col("size").cast("long").alias("tokens"))
