"""Near-duplicate vectors by quantised tiles, nearest neighbours by stable projections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, connected_components, read

#: Cosine from which two vectors of one label link.
THRESHOLD = 0.93
#: Vector components of a tile of one label, about, and vectors of either side that are multiplied at once.
TILE_VALUES, BLOCK = 1 << 20, 1500
#: Covers the rounding of double products and sums in a bound.
SLACK = 1e-9
#: Components whose int8 products sum to less than 2**24, up to which single precision is exact.
EXACT = 1024


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components that is not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that each one reaches by earlier links, kept in ``root``, and the links a[i]-b[i]."""
    while len(a):
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if np.array_equal(after, root):
            break
        root = after
    return root


def _quantised(v: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unit vectors, their scales and int8 codes, and the norms of what the codes give and miss."""
    # squares of the largest and smallest doubles leave their range
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    kept = code * scale[:, None]
    return unit, scale, code, np.linalg.norm(kept, axis=1), np.linalg.norm(unit - kept, axis=1)


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i, j with cosine at or above the threshold.

    Unit vectors are quantised to int8; the product of two quantised vectors
    differs from the cosine by no more than the error norms allow. Only pairs
    whose bounds enclose the threshold are computed in double precision.
    """
    (ux, sx, qx, nx, ex), (uy, sy, qy, ny, ey) = _quantised(x), _quantised(y)
    about = np.zeros((len(x), len(y)))
    for s in range(0, x.shape[1], EXACT):
        about += qx[:, s : s + EXACT].astype(np.float32) @ qy[:, s : s + EXACT].astype(np.float32).T
    about *= sx[:, None] * sy[None, :]
    error = nx[:, None] * ey[None, :] + ex[:, None] * (ny + ey)[None, :] + SLACK
    sure = about - error >= threshold
    i, j = np.nonzero((about + error >= threshold) & ~sure)
    hit = np.zeros(len(i), bool)
    for s in range(0, len(i), 100_000):
        part = slice(s, s + 100_000)
        hit[part] = (ux[i[part]] * uy[j[part]]).sum(axis=1) >= threshold
    si, sj = np.nonzero(sure)
    return np.concatenate([si, i[hit]]), np.concatenate([sj, j[hit]])


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, tile_values: int = TILE_VALUES, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding, label``.

    Only vectors of one label and length are compared. Exact copies are one
    class, compared once and counted as often as they occur. A tile task gives
    each vector's number of links and one link to its group's smallest
    member, never the pairs, of which it holds those of one block at a time.
    Rows with a null id, label or unusable vector have no links and their own
    id. Rows of one id are compared and counted each by itself, but reach what
    any of them links with. Other columns are left out; no rows give none.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    classes = scratch.save(rows.where(fit).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    sized = classes.withColumn("dim", F.size("embedding"))
    count = sized.groupBy("label", "dim").count().select("label", "dim", F.ceil(F.col("count") * F.col("dim") / tile_values).cast("int").alias("tiles"))
    tiled = sized.join(count, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    met = tiled.withColumn("other", other).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        first = (pdf["tile"] == pdf["i"]).to_numpy()
        rep, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        at_a, at_b = np.flatnonzero(first), np.flatnonzero((pdf["tile"] == pdf["j"]).to_numpy())
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for s in range(0, len(at_a), block):
            for t in range(s if same else 0, len(at_b), block):
                rows, columns = at_a[s : s + block], at_b[t : t + block]
                a, b = close_pairs(x[rows], x[columns], threshold)
                a, b = rows[a], columns[b]
                a, b = (a[a < b], b[a < b]) if same else (a, b)
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                root = _roots(root, a, b)
        some = np.flatnonzero(links)
        return pd.DataFrame({"cls": pdf["cls"].to_numpy()[some], "rep": rep[some], "links": links[some], "root": rep[root[some]]})

    found = scratch.save(met.select("label", "dim", "i", "j", "tile", "cls", "rep", "copies", "embedding").groupBy("label", "dim", "i", "j").applyInPandas(compare, "cls long, rep long, links long, root long"), "found")
    edges = found.select(F.col("rep").alias("u"), F.col("root").alias("v"))
    repeated = scratch.save(rows.where(fit).groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if not repeated.isEmpty():
        # an id under several vectors ties their classes together
        own = rows.where(fit).join(repeated, "vec_id", "left_semi").join(classes.select("label", "embedding", "rep"), ["label", "embedding"])
        edges = edges.union(own.select(F.col("vec_id").alias("u"), F.col("rep").alias("v")))
    component = connected_components(edges, scratch)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.join(links, "cls", "left").join(component.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    keyed = known.withColumn("key", F.xxhash64("label", "embedding"))
    out = rows.withColumn("key", F.when(fit, F.xxhash64("label", "embedding"))).alias("a").join(
        keyed.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.embedding") == F.col("b.embedding")), "left"
    )
    component_id = F.coalesce("b.component_id", "a.vec_id")
    return out.select("a.vec_id", F.coalesce("b.n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), (F.col("a.vec_id") == component_id).alias("kept"))


def op3_int8_tile_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 or more between all vectors of one label."""
    return near_duplicates(read(spark, sf_dir, "embeddings"), Scratch(spark, "op3"))


OP3_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), r AS (SELECT a AS id, a AS z FROM p UNION SELECT r.id, p.b FROM r JOIN p ON r.z = p.a),
c AS (SELECT id, min(z) AS c FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, e.vec_id) AS component_id,
  e.vec_id = coalesce(c.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = c.id LEFT JOIN n ON e.vec_id = n.id
"""

#: Dimensions of the stable projection.
PROJECTED = 32
#: A neighbour as near as the k-th found lies in the searched part with this probability.
CONFIDENCE = 0.9
#: Projections are so much smaller than vectors, a power of two, that none overflows.
SHRINK = 2.0**-64
#: Vectors on which the regions are fitted, at most, by least hash.
FIT_ROWS = 20_000
#: Vector components of a region, about, and regions of one vector length, at most; larger regions are dealt over slots.
REGION_VALUES, MAX_REGIONS = 1 << 20, 4096
#: Queries that one task takes with a block, about.
QUERIES_PER_TASK = 100_000
#: Rows of a leaf, and rows verified between two tests.
LEAF, STEP = 256, 256
SEED = 20240229


def chi_square_quantile(p: float, m: int = PROJECTED) -> float:
    """The p quantile of the chi-square distribution of an even number m of degrees."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - math.exp(-x / 2) * total < p else (low, x)
    return low


def projection(dim: int, m: int = PROJECTED, seed: int = SEED) -> np.ndarray:
    """A 2-stable projection: squared projected distances are chi-square times the true ones, times ``SHRINK`` squared."""
    return np.random.default_rng(seed).standard_normal((dim, m)) * SHRINK


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, also where squares would leave its range."""
    with np.errstate(over="ignore"):
        apart = np.abs(rows - query)
    most = apart.max(axis=1, initial=0.0)
    odd = (most > 1e140) | ((most < 1e-140) & (most > 0))
    if not odd.any():
        return np.sqrt((apart**2).sum(axis=1))
    unit = np.where(odd & np.isfinite(most), most, 1.0)
    with np.errstate(over="ignore"):
        return np.sqrt(((apart / unit[:, None]) ** 2).sum(axis=1)) * unit


def within(gap: np.ndarray, limit: float, factor: float) -> np.ndarray:
    """Which rows of projected gaps the test at distance ``limit`` leaves."""
    limit = limit * SHRINK
    if not np.isfinite(limit):
        return np.ones(len(gap), bool)
    unit = max(limit, float(gap.max(initial=0.0))) or 1.0
    return ((gap / unit) ** 2).sum(axis=1) <= factor * (limit / unit) ** 2 * (1 + 1e-9)


def fit_regions(points: np.ndarray, regions: int) -> list[tuple]:
    """Median splits of the widest dimension, to so many leaves: ``(dimension, value, left, right)`` or a region number."""
    tree: list = [None]
    todo, made = [(0, points, regions)], 0
    while todo:
        at, part, leaves = todo.pop()
        if leaves <= 1 or len(part) < 2:
            tree[at] = made
            made += 1
            continue
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        value = float(np.median(part[:, axis]))
        tree[at] = (axis, value, len(tree), len(tree) + 1)
        tree += [None, None]
        todo += [(len(tree) - 2, part[part[:, axis] < value], leaves // 2), (len(tree) - 1, part[part[:, axis] >= value], leaves - leaves // 2)]
    return tree


def region_of(tree: list, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if isinstance(tree[at], int):
            out[rows] = tree[at]
            continue
        axis, value, left, right = tree[at]
        below = points[rows, axis] < value
        todo += [(left, rows[below]), (right, rows[~below])]
    return out


class KdTree:
    """Vectors of one block in the order of the leaves of a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            part = points[rows]
            spread = part.max(axis=0) - part.min(axis=0)
            if len(rows) <= LEAF or not spread.any():
                leaves.append(rows)
                continue
            order = np.argpartition(part[:, int(np.argmax(spread))], len(rows) // 2)
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        order = np.concatenate(leaves)
        self.start = np.cumsum([0, *map(len, leaves)])
        # a power of two, so that squares of points in it are of moderate size
        self.unit = 2.0 ** float(np.frexp(np.abs(points).max())[1])
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order] / self.unit
        self.low = np.minimum.reduceat(self.points, self.start[:-1])
        self.high = np.maximum.reduceat(self.points, self.start[:-1])
        self.norms = (self.points * self.points).sum(axis=1)


def search_block(tree: KdTree, query_id: int, query: np.ndarray, projected: np.ndarray, k: int, limit: float, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Distances and ids of a block's k nearest, verified in projected order until the chi-square test stops.

    ``limit``: distance of the k-th neighbour known from elsewhere. The test:
    a vector as near as the k-th would be projected farther than what is left
    with a probability below 1 - confidence. The nearest leaf comes first, then
    what the test leaves of all others. Also returns how many were verified.
    """
    projected, scale = projected / tree.unit, SHRINK / tree.unit
    if np.abs(projected).max() > 1e100:
        # the block is a point beside the query: its projections tell nothing
        projected, factor = np.zeros_like(projected), math.inf
    gap = np.maximum(np.maximum(tree.low - projected, projected - tree.high), 0.0)
    gap = (gap * gap).sum(axis=1)
    own = projected @ projected
    # covers the rounding of differences of squares
    slack = 1e-13 * (own + tree.norms.max())

    def bound() -> float:
        return math.inf if math.isinf(limit) or math.isinf(factor) else factor * (limit * scale) ** 2 + slack

    distance, ids = np.zeros(0), np.zeros(0, np.int64)
    verified, home = 0, int(np.argmin(gap))
    for others in (False, True):
        leaves = np.flatnonzero(gap <= bound()) if others else np.array([home])
        whole = others and 2 * len(leaves) > len(gap)
        spans = [slice(0, len(tree.ids))] if whole else [slice(tree.start[i], tree.start[i + 1]) for i in leaves if i != home or not others]
        if not spans:
            break
        apart = np.concatenate([tree.norms[s] - 2 * (tree.points[s] @ projected) for s in spans]) + own
        if whole:
            apart[tree.start[home] : tree.start[home + 1]] = np.inf
        keep = np.flatnonzero(apart <= min(bound(), 1e300))
        keep = keep[np.argsort(apart[keep], kind="stable")]
        apart, rows = apart[keep], np.concatenate([np.arange(s.start, s.stop) for s in spans])[keep]
        rows, apart = rows[tree.ids[rows] != query_id], apart[tree.ids[rows] != query_id]
        for s in range(0, len(rows), STEP):
            part = rows[s : s + STEP][apart[s : s + STEP] <= bound()]
            if not len(part):
                break
            verified += len(part)
            found = distances(tree.vectors[part], query)
            good = found <= limit
            distance, ids = np.concatenate([distance, found[good]]), np.concatenate([ids, tree.ids[part[good]]])
            best = np.lexsort((ids, distance))[:k]
            distance, ids = distance[best], ids[best]
            if len(ids) == k:
                limit = min(limit, float(distance[-1]))
    return distance, ids, verified


def least_of_equal(rows: DataFrame, k: int) -> DataFrame:
    """``vec_id, embedding``: of each group of equal vectors the k smallest ids, each once.

    Tasks keep only so many of a group before the shuffle.
    """
    same = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    few = rows.select("vec_id", "embedding", F.dense_rank().over(same).alias("r")).where(F.col("r") <= k)
    return few.withColumn("before", F.lag("vec_id").over(same)).where("before is null or before <> vec_id").select("vec_id", "embedding")


def nearest_neighbours(queries: DataFrame, vectors: DataFrame, scratch: Scratch, k: int = 10, confidence: float = CONFIDENCE, region_values: int = REGION_VALUES, queries_per_task: int = QUERIES_PER_TASK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of ``vectors`` (``vec_id, embedding``) to each query.

    All rows are indexed, equal vectors by their k + 1 smallest ids, beyond
    which none can be among the k nearest: regions of the projected space are
    fitted on a bounded sample and each block of a region has its own kd-tree.
    A query is first answered by its home region; then by the regions that
    the test at its k-th distance cannot rule out. Distances are those of the
    original vectors in double precision, ties go to the smaller id, rows with
    the query's own id are left out. Null ids and null, zero and non-finite
    vectors take no part; vectors of different lengths have no distance and
    never meet. Rows equal in id and vector count once; an id under several
    vectors is as many candidates, and each is a query with ranks of its own.
    Other columns are left out; no rows give none.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"

    def sound(table: DataFrame, name: str, vector: str) -> DataFrame:
        return table.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias(name), F.col("embedding").cast(kind).alias(vector))

    rows = scratch.save(least_of_equal(sound(vectors, "vec_id", "embedding"), k + 1), "kept")
    asked = scratch.save(sound(queries, "query_id", "query").distinct().withColumn("ask", F.xxhash64("query")), "asked")
    factor = chi_square_quantile(confidence)
    slices = max(1, math.ceil(asked.count() / queries_per_task))
    counts = {r["dim"]: r["count"] for r in rows.groupBy(F.size("embedding").alias("dim")).count().collect()}
    matrices: dict[int, np.ndarray] = {}

    def project(batch: pd.Series) -> list[np.ndarray]:
        out: list = [None] * len(batch)
        sizes = batch.map(len).to_numpy()
        for dim in np.unique(sizes):
            if dim not in matrices:
                matrices[dim] = projection(int(dim))
            at = np.flatnonzero(sizes == dim)
            for i, point in zip(at, np.stack(batch.to_numpy()[at]).astype(np.float64) @ matrices[dim], strict=True):
                out[i] = point
        return out

    def lower(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"dim": pdf["embedding"].map(len), "low": project(pdf["embedding"])})

    # FIT_ROWS short points, whatever the data
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").mapInPandas(lower, "dim int, low array<double>").toPandas()
    trees = {}
    for dim, part in sample.groupby("dim"):
        regions = 2 ** math.ceil(math.log2(max(1, counts[dim] * dim / region_values)))
        trees[int(dim)] = fit_regions(np.stack(part["low"]), min(MAX_REGIONS, regions))

    def place(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            low, dims = project(pdf["embedding"]), pdf["embedding"].map(len).to_numpy()
            region = np.zeros(len(pdf), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                region[at] = region_of(trees.get(int(dim), [0]), np.stack([low[i] for i in at]))
            yield pdf.assign(dim=dims, region=region, low=low)

    placed = scratch.save(rows.mapInPandas(place, f"vec_id long, embedding {kind}, dim int, region long, low array<double>"), "placed")
    axis = range(PROJECTED)
    ends = [F.min(F.col("low")[i]).alias(f"l{i}") for i in axis] + [F.max(F.col("low")[i]).alias(f"h{i}") for i in axis]
    boxes: dict[int, list] = {}
    deal = []
    for r in placed.groupBy("dim", "region").agg(F.count("*"), *ends).collect():
        boxes.setdefault(r[0], []).append((r[1], r[3 : 3 + PROJECTED], r[3 + PROJECTED :]))
        # a region's rows are dealt over slots by its own count
        deal.append((r[0], r[1], math.ceil(r[2] * r[0] / (4 * region_values))))
    corners = {dim: tuple(np.array(c) for c in zip(*rows_, strict=True)) for dim, rows_ in boxes.items()}
    dealt_over = F.broadcast(spark.createDataFrame(deal, "dim int, region long, slots int"))  # MAX_REGIONS rows for each length
    blocks = placed.drop("low").join(dealt_over, ["dim", "region"]).withColumn("slot", F.pmod(F.xxhash64("vec_id"), F.col("slots")).cast("int")).drop("slots")
    blocks = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))) if slices > 1 else blocks.withColumn("slice", F.lit(0))

    def route(first: bool):
        def go(batches):
            for pdf in batches:
                out = []
                for row, point in zip(pdf.itertuples(index=False), project(pdf["query"]), strict=True):
                    dim = len(row.query)
                    if dim not in corners:
                        continue
                    names, low, high = corners[dim]
                    gap = np.maximum(np.maximum(low - point, point - high), 0.0)
                    size = gap.max() or 1.0
                    home = int(np.argmin(((gap / size) ** 2).sum(axis=1)))
                    visit = [home] if first else [b for b in np.flatnonzero(within(gap, row.limit, factor)) if b != home]
                    out += [(row.query_id, row.ask, row.query, row.limit, dim, int(names[b])) for b in visit]
                yield pd.DataFrame(out, columns=["query_id", "ask", "query", "limit", "dim", "region"])

        return go

    def search(asked_pdf: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked_pdf) and len(block):
            x = np.stack(block["embedding"]).astype(np.float64)
            matrix = projection(x.shape[1])
            index = KdTree(block["vec_id"].to_numpy(), x, x @ matrix)
            for row in asked_pdf.itertuples(index=False):
                q = np.asarray(row.query, np.float64)
                distance, ids, _ = search_block(index, row.query_id, q, q @ matrix, k, row.limit, factor)
                out += [(row.query_id, row.ask, d, i) for d, i in zip(distance.tolist(), ids.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "ask", "distance", "vec_id"])

    def answers(routed: DataFrame) -> DataFrame:
        # each slot of a region answers the query
        dealt = routed.join(dealt_over, ["dim", "region"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots").withColumn("slice", F.pmod(F.xxhash64("query_id", "ask"), F.lit(slices)).cast("int"))
        key = ["dim", "region", "slot", "slice"]
        return dealt.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInPandas(search, "query_id long, ask long, distance double, vec_id long")

    routed_schema = f"query_id long, ask long, query {kind}, limit double, dim int, region long"
    start = asked.withColumn("limit", F.lit(float("inf")))
    near = scratch.save(answers(start.mapInPandas(route(True), routed_schema)), "near")
    order = Window.partitionBy("query_id", "ask").orderBy("distance", "vec_id")
    kth = near.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", "ask", F.col("distance").alias("limit"))
    again = asked.join(kth, ["query_id", "ask"], "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    far = answers(again.mapInPandas(route(False), routed_schema))
    merged = near.union(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").alias("score"))


def op2_stable_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    table = read(spark, sf_dir, "embeddings")
    return nearest_neighbours(table.where("vec_id % 100 = 0"), table, Scratch(spark, "op2"))
