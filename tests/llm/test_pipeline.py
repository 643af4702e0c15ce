import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute_force import brute_components, brute_passages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def planted(rng):
    """Rows of ``documents``, their labels, and what is planted: toxic ids, a long passage, groups of copies."""
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = "\n".join(" ".join(word() for _ in range(30)) for _ in range(3))
    rows, labels, toxic = [], [], set()
    for i in range(240):
        lines = [" ".join(word() for _ in range(rng.randint(6, 20))) for _ in range(rng.randint(1, 6))]
        if i % 6 == 0:
            lines[0] += " vilest"
            toxic.add(i)
        if i % 10 == 1:
            lines.insert(rng.randint(0, len(lines)), passage)
        rows.append([i, "\n".join(lines), "xx", ["a", "b", None][i % 3], 0])
        if i < 200:
            labels.append((i, 1, int(i in toxic)))
    for k, i in enumerate((3, 3, 9, 15, 21)):
        words = rows[i][1].split(" ")
        rows.append([300 + k, " ".join(words if k < 2 else [*words, "more"]), "xx", "a", 0])
    rows += [[400, None, "xx", "a", 0], [401, "", None, None, None], [None, rows[5][1], "xx", "b", 0], list(rows[7]), [13, "another text under an id that is taken", "xx", "b", 0]]
    return [tuple(r) for r in rows], labels, toxic, passage


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    rows, labels, toxic, passage = planted(random.Random(12))
    # further columns, whose names some stages use inside
    clashing = {n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for n in ("copies", "toxic", "removed_lines", "place", "component_id")}
    spark.createDataFrame(rows, SCHEMA).withColumns(clashing).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, toxic, passage


def test_every_stage_on_planted_documents(spark, tables):
    folder, rows, toxic, passage = tables
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    scratch = corpus_pipeline.Scratch(spark, "stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.save(stage(spark, docs, folder), f"s{k}")
        seen.append([r.asDict() for r in docs.collect()])
    ids = lambda k: sorted((r["doc_id"] for r in seen[k]), key=str)

    # toxicity: exactly the planted ones go, held-out ones among them
    assert ids(0) == sorted((r[0] for r in rows if r[0] not in toxic or "vilest" not in (r[1] or "")), key=str)
    # line dedup: no row goes; texts are those of the brute-force version, row by row
    apart = [(r["doc_id"], r["text"]) for r in seen[0] if r["doc_id"] is not None]
    single = {d for d, _ in apart if sum(d == e for e, _ in apart) == 1}
    assert ids(1) == ids(0)
    want = brute_passages([x for x in apart if x[0] in single or x == (7, rows[7][1])][: len(apart)])
    got = {r["doc_id"]: r for r in seen[1] if r["doc_id"] in single}
    assert all(got[d]["text"] == t and got[d]["n_chars"] == len(t) for d, (t, _) in want.items() if d in single)
    assert sum(passage in (r["text"] or "") for r in seen[1] if r["doc_id"] is not None) == 1
    # n-gram Jaccard join: one document of each brute-force group
    left = [(r["doc_id"], r["text"]) for r in seen[1] if r["doc_id"] is not None]
    root = brute_components(list(dict(sorted(left, key=lambda x: x[0] in single)).items()))
    keep = {d for d in single if root[d][1] == d}
    stays = sorted(r["doc_id"] for r in seen[2] if r["doc_id"] is not None)
    assert keep <= set(stays) and len(stays) == len(set(stays)) and not {d for d in single - keep} & set(stays)
    assert {7, 13} <= set(stays) and None in ids(2) and {400, 401} <= set(stays)
    # mixing: whole rows, at most three times; sources near their targets
    sizes = {s: 0 for s in ("a", "b", None)}
    for r in seen[2]:
        sizes[r["source"]] += len((r["text"] or "").split())
    targets = corpus_pipeline.mix.__globals__["source_targets"](list(sizes.items()))
    before = [tuple(sorted(r.items())) for r in seen[2]]
    after = [tuple(sorted(r.items())) for r in seen[3]]
    assert set(after) <= set(before) and all(after.count(x) <= 3 * before.count(x) for x in set(after))
    for source, target in targets.items():
        taken = sum(len((r["text"] or "").split()) for r in seen[3] if r["source"] == source)
        assert abs(taken - target) <= max(len((r["text"] or "").split()) for r in seen[2])
    assert all(r[n] == f"{n}{'' if r['doc_id'] is None else r['doc_id']}" for r in seen[3] for n in ("copies", "toxic", "removed_lines", "place", "component_id"))
    # packing: every document of the mix, whole, as often as it stands there
    starts = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in seen[4] if r["start"] == 0)
    assert starts == sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in seen[3])
    ends = {}
    for r in sorted(seen[4], key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024
    assert sum(r["length"] for r in seen[4]) == sum(r["doc_tokens"] for r in seen[4] if r["start"] == 0)


def test_pipeline_over_no_documents(spark, tables, tmp_path):
    spark.read.parquet(f"{tables[0]}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{tables[0]}/labels.parquet").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
