"""Toxicity by a classifier chain of linear models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, read
from textloom.llm.shingles import chunks, word_hashes

#: Labelled documents that the models are fitted on, at most, by least hash of their id.
#: The driver holds which chosen features each of them has, so this bounds its memory.
FIT_ROWS = 10_000
#: Folds for the out-of-fold probabilities.
FOLDS = 3
#: Features of a model, at most, and the least chi-square value of one.
MOST_FEATURES, LEAST_CHI = 4096, 10.8
#: Strength of the squared penalty, and steps of the fit.
PENALTY, STEPS = 1.0, 400
#: Probability of the last category from which a document is rejected.
REJECT = 0.4
#: Categories in the order of the chain: name and expression over a row of ``labels``.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))
#: Lengths in bytes of word beginnings that are features beside whole words, for inflected forms.
BEGINNINGS = (4, 5, 6)
#: Bytes that part words: all of ASCII but letters and digits.
_PARTS = np.array([not (chr(i).isalnum() or i > 127) for i in range(256)])
_FILTER = np.uint64((1 << 20) - 1)


def text_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of words and word beginnings and the text number of each, with repeats."""
    return word_hashes(texts, _PARTS, BEGINNINGS)


def _distinct(feature: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, owner))
    feature, owner = feature[order], owner[order]
    new = np.ones(len(feature), bool)
    new[1:] = (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])
    return feature[new], owner[new]


@dataclass
class Linear:
    """A logistic model over sorted feature fingerprints, then over the earlier categories' probabilities."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, feature: np.ndarray, owner: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        """``feature, owner``: distinct features of n texts; ``earlier``: n rows of probabilities."""
        at = np.minimum(np.searchsorted(self.features, feature), max(0, len(self.features) - 1))
        hit = self.features[at] == feature if len(self.features) else np.zeros(len(feature), bool)
        total = np.bincount(owner[hit], weights=self.weights[at[hit]], minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(total + earlier @ self.earlier, -500, 500)))


def fit_linear(features: np.ndarray, column: np.ndarray, owner: np.ndarray, earlier: np.ndarray, label: np.ndarray) -> Linear:
    """Penalised maximum likelihood by accelerated gradient steps.

    ``column, owner``: the distinct (feature, row) incidences, sorted fingerprints in
    ``features``. With labels of one kind the probability is 0 or 1 throughout.
    """
    n, k, m = len(label), len(features), earlier.shape[1]
    if not n or label.min() == label.max():
        return Linear(features[:0], np.zeros(0), np.zeros(m), -500.0 if not n or label[0] == 0 else 500.0)
    # a feature's curvature grows with its rows: scaled steps, one for each weight
    width = np.bincount(owner, minlength=n).max(initial=0) + m + 1
    scale = np.concatenate([np.bincount(column, minlength=k), (earlier**2).sum(axis=0), [n]]) * min(width, 64) / 4 + PENALTY
    w = seen = np.zeros(k + m + 1)
    pace = 1.0
    for _ in range(STEPS):
        total = np.bincount(owner, weights=seen[column], minlength=n) + earlier @ seen[k : k + m] + seen[-1]
        error = 1 / (1 + np.exp(-np.clip(total, -500, 500))) - label
        slope = np.concatenate([np.bincount(column, weights=error[owner], minlength=k), earlier.T @ error, [error.sum()]])
        slope[:-1] += PENALTY * seen[:-1]
        after = seen - slope / scale
        if slope @ (after - w) > 0:
            pace = 1.0
        quicker = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        seen = after + (pace - 1) / quicker * (after - w)
        w, pace = after, quicker
    return Linear(features, w[:k], w[k : k + m], float(w[-1]))


def chosen_features(counts: np.ndarray, positives: np.ndarray, rows: int, positive_rows: int) -> np.ndarray:
    """Positions of the features that best part the two kinds by chi-square."""
    a, b = positives.astype(float), (counts - positives).astype(float)
    c, d = positive_rows - a, (rows - positive_rows) - b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = rows * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    chi = np.where(np.isfinite(chi) & (counts >= max(3, rows / 4000)), chi, 0.0)
    best = np.argsort(-chi, kind="stable")[:MOST_FEATURES]
    return np.sort(best[chi[best] >= LEAST_CHI])


def fit_chain(sample: DataFrame, names: list[str]) -> list[Linear]:
    """Fit one model per category on ``doc_id, text, _fold`` and a column ``_is_<name>`` (0, 1 or null) each.

    Features are counted by fold and label on Spark, so that each fit chooses
    its own; of the texts the driver sees only which chosen features each has.
    A later model learns from earlier probabilities by models fitted without
    the row's fold, as it will meet them in new rows.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select([n for n in batch.schema.names if n not in ("doc_id", "text")])
            for first, texts in chunks(batch, batch.schema.get_field_index("text")):
                feature, owner = _distinct(*text_features(texts))
                taken = pa.Table.from_batches([rest]).take(pa.array(first + owner)).combine_chunks()
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns]
                yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), *columns], names=["feature", *rest.schema.names])

    labels = [f"_is_{n}" for n in names]
    long = sample.select("doc_id", "text", "_fold", *labels).mapInArrow(explode, "feature long, _fold int, " + ", ".join(f"{x} int" for x in labels))
    sums = [F.sum(F.when((F.col("_fold") == f) & ((F.col(x) == 1) if y else F.col(x).isNotNull()), 1).otherwise(0)).alias(f"{x}_{f}_{y}") for x in labels for f in range(FOLDS) for y in (0, 1)]
    truth = sample.select("doc_id", "_fold", *labels).toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)
    # only features that reach half the least value over all folds come to the driver
    hopeful = F.lit(False)
    for x in labels:
        rows, yes = int(truth[x].notna().sum()), int(truth[x].sum())
        n, a = (sum((F.col(f"{x}_{f}_{y}") for f in range(FOLDS)), F.lit(0.0)) for y in (0, 1))
        lead = a * (rows - yes) - (n - a) * yes
        hopeful |= lead * lead * rows >= F.lit(LEAST_CHI / 2) * n * (rows - n) * float(yes) * float(rows - yes)
    table = long.groupBy("feature").agg(F.count("*").alias("n"), *sums).where("n >= 3").where(hopeful).toPandas()
    table = table.assign(feature=table["feature"].to_numpy().view(np.uint64)).sort_values("feature", kind="stable")
    known = table["feature"].to_numpy()
    chosen: dict[tuple, np.ndarray] = {}
    for x in labels:
        for out in (*range(FOLDS), None):
            inside = [f for f in range(FOLDS) if f != out]
            rows = truth[truth["_fold"].isin(inside) & truth[x].notna()]
            chosen[x, out] = chosen_features(sum(table[f"{x}_{f}_0"].to_numpy() for f in inside), sum(table[f"{x}_{f}_1"].to_numpy() for f in inside), len(rows), int(rows[x].sum()))
    union = np.unique(np.concatenate(list(chosen.values()))) if chosen else np.zeros(0, np.int64)
    wanted = known[union]

    def incidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in chunks(batch, 1):
                feature, owner = _kept(*text_features(texts), wanted)
                at, ends = np.searchsorted(wanted, feature).astype(np.int32), np.searchsorted(owner, np.arange(1, len(texts)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + len(texts)], pa.int64()), pa.array([x.tobytes() for x in np.split(at, ends)], pa.binary())], names=["doc_id", "at"])

    seen = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(incidences, "doc_id long, at binary").toPandas()
    fold, n = truth["_fold"].to_numpy(), len(truth)
    lists = [np.frombuffer(x, np.int32) for x in seen["at"]]
    owner = np.repeat(np.searchsorted(truth["doc_id"].to_numpy(), seen["doc_id"].to_numpy()), [len(x) for x in lists]).astype(np.int32)
    column = union[np.concatenate(lists)].astype(np.int32) if lists else np.zeros(0, np.int32)
    del seen, lists
    earlier, models = np.zeros((n, 0)), []

    def fit(x: str, out: int | None) -> Linear:
        use = truth[x].notna().to_numpy() & (fold != (-1 if out is None else out))
        place = np.cumsum(use) - 1
        pick = chosen[x, out]
        at = np.minimum(np.searchsorted(pick, column), max(0, len(pick) - 1))
        hit = use[owner] & (pick[at] == column if len(pick) else False)
        return fit_linear(known[pick], at[hit], place[owner[hit]], earlier[use], truth[x].to_numpy()[use].astype(float))

    for x in labels:
        held = np.zeros(n)
        # the last category has no later one to feed
        if x != labels[-1]:
            for out in range(FOLDS):
                p = fit(x, out).probability(known[column], owner, n, earlier)
                held[fold == out] = p[fold == out]
        models.append(fit(x, None))
        earlier = np.column_stack([earlier, held])
    return models


def _kept(feature: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct wanted features of each text; a bitmap drops most others unsorted."""
    bits = np.zeros(1 << 20, bool)
    bits[(wanted & _FILTER).astype(np.int64)] = True
    maybe = bits[(feature & _FILTER).astype(np.int64)]
    feature, owner = feature[maybe], owner[maybe]
    if len(wanted):
        exact = wanted[np.minimum(np.searchsorted(wanted, feature), len(wanted) - 1)] == feature
        feature, owner = feature[exact], owner[exact]
    return _distinct(feature, owner)


def toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch, chain: tuple = CHAIN, fit_on: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` (``doc_id, text, ...``) with each category's probability and ``rejected``.

    The models are fitted on at most ``FIT_ROWS`` labelled documents of
    ``fit_on`` (by default ``docs``); every row is scored on its whole text. A
    null or empty text scores like one without any known word. Without labels
    of both kinds a category has the probability of the only kind, or 0. A
    document is rejected if its last category has a probability of ``REJECT``
    or more. Columns with the added names are replaced.
    """
    names = [name for name, _ in chain]
    docs = docs.drop(*names, "rejected")
    kinds = labels.where("doc_id is not null").select("doc_id", *(F.expr(e).cast("int").alias(f"_is_{n}") for n, e in chain))
    kinds = kinds.groupBy("doc_id").agg(*(F.max(f"_is_{n}").alias(f"_is_{n}") for n in names))
    picked = kinds.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    known = docs if fit_on is None else fit_on
    # at most FIT_ROWS labels, each with the text of one row
    rows = known.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *(F.first(f"_is_{n}").alias(f"_is_{n}") for n in names))
    sample = scratch.save(rows.withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")), "sample")
    models = fit_chain(sample, names)
    wanted = np.unique(np.concatenate([m.features for m in models]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, texts in chunks(batch, batch.schema.get_field_index("text")):
                feature, owner = _kept(*text_features(texts), wanted)
                earlier = np.zeros((len(texts), 0))
                for model in models:
                    earlier = np.column_stack([earlier, model.probability(feature, owner, len(texts), earlier[:, : len(model.earlier)])])
                found.append(earlier)
            p = np.concatenate(found) if found else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= REJECT)], names=[*batch.schema.names, *names, "rejected"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{n} double" for n in names), "rejected boolean"])
    return docs.mapInArrow(score, schema)


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of low quality and of toxicity of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, read(spark, sf_dir, "labels"), Scratch(spark, "op10")).select("doc_id", "low_quality", F.col("toxic").alias("toxicity"), F.col("rejected").alias("toxic"))
