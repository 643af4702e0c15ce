import math
import random
import re

import numpy as np
import pytest

from textloom.llm import toxicity
from textloom.llm.common import Scratch


def marks(text):
    """Fingerprints of a text's words and word beginnings, word by word."""
    out = set()
    for word in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower()):
        out.update(toxicity.text_features([word])[0].tolist())
    return out


def test_chain_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    common = [f"word{i}ing" for i in range(30)]
    rows, labels = [], []
    for i in range(240):
        bad, toxic = rng.random() < 0.4, rng.random() < 0.4
        text = [rng.choice(common) for _ in range(rng.randint(3, 12))]
        text += ["spam", "Clicked"] * (bad and rng.random() < 0.9) + [rng.choice(["hate", "HATEFUL", "häss!"]) for _ in range(2)] * (toxic and rng.random() < 0.9)
        rng.shuffle(text)
        rows.append((i, rng.choice([" ", "-", ", "]).join(text)))
        if i % 4:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None), (1001, ""), (5, rows[5][1]), (None, "hate hate"), (1002, "hate " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = []
    fit = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda *a: kept.append(fit(*a)) or kept[-1])
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), Scratch(spark, "t")).collect()
    [models] = kept
    assert len(got) == len(rows)
    for r in got:
        own, earlier = marks(r["text"]), []
        for model in models:
            total = model.bias + sum(w for f, w in zip(model.features.tolist(), model.weights.tolist(), strict=True) if f in own)
            total += sum(w * p for w, p in zip(model.earlier.tolist(), earlier, strict=True))
            earlier.append(1 / (1 + math.exp(-total)))
        assert (r["low_quality"], r["toxic"]) == pytest.approx(earlier, abs=1e-9) and r["rejected"] == (r["toxic"] >= toxicity.REJECT)

    # the features of each model by counting, and its weights by the slope of the penalised likelihood
    text_of = dict(rows[:240])
    sets = {i: marks(text_of[i]) for i, *_ in labels}
    for model, label in zip(models, (lambda q, t: 1 - q, lambda q, t: t), strict=True):
        y = {i: label(q, t) for i, q, t in labels}
        chosen = set()
        for f in set().union(*sets.values()):
            a = sum(y[i] for i in y if f in sets[i])
            b = sum(f in sets[i] for i in y) - a
            c, d = sum(y.values()) - a, len(y) - sum(y.values()) - b
            if a + b >= 3 and (c + d) and len(y) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)) >= toxicity.LEAST_CHI:
                chosen.add(f)
        assert set(model.features.tolist()) == chosen and chosen
    x = np.array([[f in sets[i] for f in models[0].features.tolist()] for i, *_ in labels], float)
    truth = np.array([1 - q for _, q, _ in labels])
    error = 1 / (1 + np.exp(-(x @ models[0].weights + models[0].bias))) - truth
    assert np.abs(x.T @ error + toxicity.PENALTY * models[0].weights).max() < 1e-3 and abs(error.sum()) < 1e-3
