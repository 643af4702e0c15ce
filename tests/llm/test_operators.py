import hashlib
import heapq
import math
import random
import time
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat, embeddings, fixity, html, jaccard, lines, mixing, packing, shingles, toxicity
from brute_force import brute_components, brute_passages
from textloom.llm.common import Scratch, connected_components


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_components(spark, scratch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 90), (None, 3)], "u long, v long")
    got = {r["id"]: r["component"] for r in connected_components(edges, scratch).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90}


def test_minimum_cut_equals_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 7)
        gains = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 6)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(kept, gains=gains, edges=edges):
            return sum(g for g, k in zip(gains, kept, strict=True) if g > 0 and not k) + sum(-g for g, k in zip(gains, kept, strict=True) if g < 0 and k) + sum(c for a, b, c in edges if kept[a] != kept[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert cost(html.minimum_cut(gains, edges)) == best


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li><a href=/a>A</a></ul></nav><div class='cookie-notice'>We use cookies. Accept.</div>"
        "<article><h1>A title</h1><p><b>First &amp; <i>long</i>\n  paragraph, with words. It goes on.<br><p>Second.</p></article>"
        "<section id=comments><p>Nice text, I like it. Really. Thanks.</p></section><form><p>Mail</p></form><footer>&copy; me</footer></body>"
    )
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>One sentence alone, here it is. Two.</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(rows).collect()}
    text = "A title\nFirst & long paragraph, with words. It goes on.\nSecond."
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0), None: ("One sentence alone, here it is. Two.", 36)}


def test_html_wrappers_keep_their_article():
    text = "The first paragraph of the article, which says something. It goes on for a while."
    for named in ("content has-sidebar", "main-content with-sidebar", "entry comments-open", "post hentry category-social tag-popular", "page sidebar", "widget"):
        for inner in ("<article><p>{}</p></article>", "<main><p>{}</p></main>", "<div><p>{}</p></div>"):
            page = f"<body><nav><a href=/>Home</a></nav><div class='{named}'>{inner.format(text)}</div><div class='sidebar-left'><p>Buy this now. It is good.</p></div></body>"
            assert html.main_text(page) == text, (named, inner)
        assert html.main_text(f"<body><article class='{named}'><p>{text}</p></article></body>") == text
    comments = "<section id=comments><article class=comment><p>Nice text, I like it a lot. Really. Thanks.</p></article></section>"
    assert html.main_text(f"<body><div class='site has-sidebar'><article><p>{text}</p></article>{comments * 3}</div></body>") == text


LONG = "A long paragraph of the article, which says a lot of things. It goes on for a while, and then ends here."


def test_html_names_and_forms_keep_their_article():
    body, want = f"<h1>Title here</h1><p>{LONG}</p><p>{LONG}</p>", f"Title here\n{LONG}\n{LONG}"
    for page in (
        f"<article class='post no-comments'>{body}</article>",
        f"<main class='category-legal'>{body}</main>",
        f"<main><div class='topic social'>{body}</div></main>",
        f"<div class='layout has-sidebar'><main>{body}</main></div>",
        f"<main><section id='search-algorithms search'>{body}</section></main>",
        f"<form action=x><div>{body}</div><input name=q></form>",
        f"<form><nav>Menu</nav><main>{body}</main><footer>Imprint</footer></form>",
        f"<article><h1>Title here</h1><p title='the hidden gem'>{LONG}</p><p>{LONG}</p></article>",
        f"<div role=main><h1>Title here</h1><p>{LONG}<p>{LONG}<div hidden>{LONG}</div></div><div class=ad><p>{LONG}</p></div>",
        f"<article><h1>Title here</h1><p>{LONG}</p><div class='ad-box'><p>{LONG}</p></div><p>{LONG}</p><div class=share>Share this</div><section class='reader comments'><p>{LONG}</p></section></article>",
    ):
        assert html.main_text(f"<body>{page}</body>") == want, page
    assert html.main_text("<body><h2>Steps</h2><ul><li>Mix the flour.<li>Bake it.</ul>") == "Steps\nMix the flour.\nBake it."


def test_html_hyphenated_wrappers_inside_main_keep_their_article():
    body, want = f"<h1>Title here</h1><p>{LONG}</p><p>{LONG}</p>", f"Title here\n{LONG}\n{LONG}"
    beside = "<div class='sidebar-box'><p>Buy this now. It is good, and cheap too.</p></div><div class=notice><p>We use cookies here. Accept them all.</p></div>"
    names = ("layout sidebar-right", "two-col sidebar-left-layout", "ad-free-content", "share-wrapper", "menu-page", "copyright-law", "story-with-banner", "promo-article", "newsletter-issue body", "notice", "sidebar")
    for named in names:
        for outer in ("main", "article"):
            for extra in ("", beside):
                assert html.main_text(f"<body><nav>Home</nav><{outer}><div class='{named}'>{body}</div>{extra}</{outer}></body>") == want, (named, outer, extra)
        twice = f"<main><div class='{named}'><div id='{named}'>{body}</div></div></main>"
        assert html.main_text(f"<body>{twice}</body>") == want, named
        if named not in ("notice", "sidebar"):
            assert html.main_text(f"<body><div>{LONG}</div><div class='{named}'>{body * 3}</div></body>") == "\n".join([LONG, *[want] * 3]), named
    # what readers wrote, and lists of links, stay out however long they are
    for named in ("comments", "comment-list", "user-comments"):
        assert html.main_text(f"<body><main>{body}<div class='{named}'>{f'<p>{LONG}</p>' * 9}</div></main></body>") == want
    links = f"<div class=related>{f'<p><a href=/>{LONG}</a></p>' * 9}</div>"
    assert html.main_text(f"<body><main>{body}{links}</main></body>") == want


def planted_page(rng):
    """Blocks of a page without telling elements, each with its label."""
    line = lambda n: " ".join(rng.choice(["river", "stone", "of", "the", "winter", "light"]) for _ in range(n))
    menu = [("Topics", 0), *((f"<a href=/{i}>{line(2)}</a>", 0) for i in range(rng.randint(3, 6)))]
    story = [(f"{line(rng.randint(20, 60))}. {line(9)}.", 1) for _ in range(rng.randint(3, 6))]
    story.insert(rng.randint(1, len(story) - 1), (f"<a href=/r>{line(4)}</a>", 1))
    ends = [(f"<a href=/{i}>{line(1)}</a>", 0) for i in range(4)] + [("Imprint", 0)]
    parts = [("div", menu), ("p", story), ("span", ends)]
    return "<body>" + "".join(f"<div>{''.join(f'<{'div' if tag == 'span' else tag}>{t}</{'div' if tag == 'span' else tag}>' for t, _ in rows)}</div>" for tag, rows in parts), [label for _, rows in parts for _, label in rows]


def test_html_cut_betters_the_signs():
    rng, wrong = random.Random(6), {"signs": 0, "cut": 0}
    for _ in range(40):
        page, truth = planted_page(rng)
        blocks = html.blocks_of(page)
        assert len(blocks) == len(truth)
        gains = [html.log_odds(b) for b in blocks]
        kept = html.minimum_cut([round(1000 * g) for g in gains], html.smoothness(blocks))
        wrong["signs"] += sum((g > 0) != bool(t) for g, t in zip(gains, truth, strict=True))
        wrong["cut"] += sum(k != bool(t) for k, t in zip(kept, truth, strict=True))
        assert html.main_text(page) == "\n".join(b["text"] for b, k in zip(blocks, kept, strict=True) if k)
    assert wrong["signs"] >= 80 and wrong["cut"] <= 4, wrong


def test_html_labels_of_whole_pages_equal_brute_force():
    rng = random.Random(7)
    for _ in range(25):
        rows = "".join(f"<{e}>{t}</{e}>" for e, t in ((rng.choice(["p", "div", "h2", "li", "section"]), rng.choice([LONG, "Short.", "<a href=/>Link here</a>", "Word", f"<div class=widget>{LONG}</div>"])) for _ in range(rng.randint(1, 9))))
        page = f"<body>{rng.choice(['', '<nav>N</nav>', '<article>'])}{rows}"
        blocks = html.blocks_of(page)
        gains, edges = [round(1000 * html.log_odds(b)) for b in blocks], html.smoothness(blocks)

        def cost(kept, gains=gains, edges=edges):
            return sum(abs(g) for g, k in zip(gains, kept, strict=True) if (g > 0) != k) + sum(c for a, b, c in edges if kept[a] != kept[b])

        best = min(([bool(m >> i & 1) for i in range(len(blocks))] for m in range(2 ** len(blocks))), key=lambda k: (cost(k), sum(k)))
        assert html.main_text(page) == "\n".join(b["text"] for b, k in zip(blocks, best, strict=True) if k)


def test_html_broken_deep_and_odd_pages(spark):
    for page, want in (("<div>a b. " * 90_000, "\n".join(["a b."] * 90_000)), ("<a '" * 200_000, ""), ("<!--" * 200_000, ""), ("<" * 100_000, "<" * 100_000), ("<p>one. two. <b", "one. two."), ("<p a='x>Said so. Yes.</p>", "Said so. Yes.")):
        assert html.main_text(page) == want
    rows = spark.createDataFrame([(1, "u", f"<p>{LONG}", "x", 7)] * 2 + [(None, None, " ", None, None)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html.extract(rows).collect()) == [("1", LONG, len(LONG))] * 2 + [("None", "", 0)]
    assert html.extract(rows.where("false")).count() == 0


def test_neighbours_recall_and_bad_vectors(spark, scratch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(1500)] + [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] * 24), (2300, [None] * 24), (2400, x[0].tolist()), (2500, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embeddings.nearest_neighbours(df.where("vec_id % 100 = 0"), df, scratch).toPandas()
    assert set(got["query_id"]) == {*range(0, 1500, 100), 2400}
    data, ids = np.vstack([x, x[:1]]).astype(np.float64), np.array([*range(1500), 2400])
    hits = 0
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((data - data[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len(set(ids[order]) & set(part["vec_id"]))
        for r in part.itertuples():
            assert r.score == pytest.approx(d[ids == r.vec_id][0], abs=1e-12)
        assert list(part.sort_values("rank")["rank"]) == list(range(1, 11))
    assert hits >= 0.9 * 10 * got["query_id"].nunique()
    few = df.where("vec_id < 4")
    assert embeddings.nearest_neighbours(few, few, scratch).count() == 12
    assert embeddings.nearest_neighbours(df.where("false"), df.where("false"), scratch).count() == 0


def test_neighbours_in_many_regions_with_equal_vectors(spark, scratch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[::3] = x[0]
    # a dense group of different vectors
    x = np.vstack([x, x[1] + np.float32(1e-6) * rng.normal(size=(400, 12)).astype(np.float32)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert sorted(r["vec_id"] for r in embeddings.least_of_equal(df.union(df).where("vec_id % 3 = 0 and vec_id < 900"), 11).collect()) == list(range(0, 33, 3))
    got = embeddings.nearest_neighbours(df.where("vec_id % 50 = 0"), df, scratch, region_values=64 * 12, queries_per_task=10).toPandas()
    data, hits = x.astype(np.float64), 0
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        hits += len(set(want) & set(part["vec_id"]))
        if q < 900 and q % 3 == 0:
            assert list(part.sort_values("rank")["vec_id"]) == want
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in part.itertuples())
    assert got["query_id"].nunique() == 26 and hits >= 0.9 * 260


def test_neighbours_keep_doubles_lengths_and_repeated_rows(spark, scratch):
    # distances of 1e-9, ties, an id under two vectors, a repeated row, another length
    rows = [(i, [1.0 + i * 1e-9, 2.0, 3.0]) for i in range(5)] + [(10, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.0]), (20, [5.0, 5.0, 5.0]), (20, [6.0, 5.0, 5.0]), (30, [1.0, 0.0]), (31, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"region": F.lit("clash"), "rank": F.lit("x")})
    got = embeddings.nearest_neighbours(df.where("vec_id in (0, 20, 30)"), df, scratch, k=4).collect()
    nearest = lambda q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: (r["rank"], r["score"])) if r["query_id"] == q]
    assert [(a, b) for a, b, _ in nearest(0)] == [(1, 10), (2, 1), (3, 2), (4, 3)]
    assert [d for *_, d in nearest(0)] == [0.0, *(abs(rows[i][1][0] - 1.0) for i in (1, 2, 3))]
    assert [(a, b) for a, b, _ in nearest(20)] == [(1, 4), (1, 4), (2, 3), (2, 3), (3, 2), (3, 2), (4, 1), (4, 1)]
    assert nearest(30) == [(1, 31, 2**0.5)]


def test_the_stopping_test_prunes_and_finds():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    x = np.vstack([centres[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 64)), rng.normal(size=(4000, 64))])
    ids, points, factor = np.arange(8000), x @ embeddings.projection(64), embeddings.chi_square_quantile(embeddings.CONFIDENCE, embeddings.PROJECTED)
    tree, hits, verified = embeddings.KdTree(ids, x, points), 0, {True: 0, False: 0}
    for q in range(0, 8000, 80):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        distance, found, seen = embeddings.search_block(tree, q, x[q], points[q], 10, math.inf, factor)
        kth = np.sort(d)[10]
        hits += len(set(found) & {i for i in np.flatnonzero(d <= kth) if i != q})
        verified[q < 4000] += seen
        assert np.array_equal(distance, d[found])
    assert hits >= 0.9 * 10 * 100
    # of the grouped half, and of vectors that lie nowhere near another
    assert verified[True] < 0.1 * 50 * 8000 and verified[False] < 0.6 * 50 * 8000


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_neighbours_recall_on_the_given_tables(spark, sf):
    got = embeddings.op2_stable_projection_ann(spark, f"/root/testdata/{sf}").toPandas()
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").where(embeddings.usable(F.col("embedding"))).toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(np.float64)
    hits = asked = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [ids[i] for i in np.lexsort((ids, d)) if i != q][:10]
        hits, asked = hits + len(set(want) & set(got["vec_id"][got["query_id"] == ids[q]])), asked + len(want)
    assert hits >= 0.9 * asked > 0, (hits, asked)


def test_vectors_of_the_largest_and_smallest_doubles(spark, scratch):
    base = [[1.0, 2.0, 2.0], [2.0, 4.0, 4.1], [-1.0, 0.5, 3.0], [4.0, 4.0, 8.0]]
    rows = [(100 * k + i, [x * scale for x in v], k) for k, scale in enumerate((1e180, 1e-180, 1e-320, 1.0, 4e307 / 8)) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embeddings.nearest_neighbours(df.where("vec_id % 100 = 0"), df, scratch, k=19).collect()
    assert len(got) == 5 * 19
    for q in (0, 400):
        own = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q and q <= r["vec_id"] < q + 100]
        scale = rows[q // 100 * 4][1][0]
        apart = {q + i: math.dist(base[0], base[i]) * scale for i in (1, 2, 3)}
        assert [i for i, _ in own] == sorted(apart, key=apart.get) and all(d == pytest.approx(apart[i], rel=1e-12) for i, d in own)
    tiny = {r["vec_id"]: r["score"] for r in got if r["query_id"] == 100}
    assert tiny[101] == pytest.approx(math.dist(base[0], base[1]) * 1e-180, rel=1e-12)
    links = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df, scratch).collect()}
    # subnormal numbers keep a few digits only
    assert [[links[100 * k + i] for i in range(4)] for k in range(5)] == [[2, 2, 0, 2]] * 5


@pytest.mark.parametrize("dim", [1536, 4096, 16384])
def test_quantised_bounds_hold_in_many_dimensions(dim):
    rng = np.random.default_rng(dim)
    # codes are the numbers themselves, so the bound has nothing to spare
    x = rng.integers(60, 127, (20, dim)) * rng.choice([1, -1], dim)
    x[:, 0] = 127
    x = x.astype(np.float64)
    exact = x.astype(np.int64) @ x.astype(np.int64).T
    cosine = exact / np.sqrt(np.outer(np.diag(exact), np.diag(exact)).astype(np.float64))
    for i, j in zip(rng.integers(0, 20, 30), rng.integers(0, 20, 30), strict=True):
        for off in (1e-8, 1e-9, -1e-9, -1e-8):
            a, b = embeddings.close_pairs(x[[i]], x[[j]], cosine[i, j] + off)
            assert len(a) == len(b) == (off < 0)


def test_quantised_pairs_equal_brute_force():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    x = np.vstack([base + rng.normal(size=base.shape) * s for s in (0, 0.25, 0.4)])
    i, j = embeddings.close_pairs(x, x, 0.93)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(unit @ unit.T >= 0.93)), strict=True))


def test_vector_components_over_many_tiles(spark, scratch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(25, 8))
    x = np.vstack([base[rng.integers(0, 25, 260)] + 0.12 * rng.normal(size=(260, 8)), np.repeat(base[:1], 130, axis=0)])
    # ids repeat here and there, and so do whole rows
    rows = [(int(i - (i % 40 == 1)), v.tolist(), int(i % 2)) for i, v in enumerate(x)] + [(0, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"tile": F.lit("clash"), "rep": F.lit("x")})
    small = embeddings.near_duplicates(df, scratch, tile_values=30 * 8, block=13).collect()
    ids, labels, v = np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    links = near.sum(axis=1) - 1
    comp = ids.copy()
    for _ in range(60):
        low = np.array([comp[near[k]].min() for k in range(len(ids))])
        for i in np.unique(ids):
            low[ids == i] = low[ids == i].min()
        if np.array_equal(low, comp):
            break
        comp = low
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in small)
    assert got == sorted((i, n, c, i == c) for i, n, c in zip(ids.tolist(), links.tolist(), comp.tolist(), strict=True))
    assert embeddings.near_duplicates(df.where("false"), scratch).count() == 0


def test_vector_components(spark, scratch):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, 0.0], None), (8, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("copies", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, scratch).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), **{i: (0, i, True) for i in (4, 5, 6, 7, 8)}}


def test_packing_round_trip(spark, scratch):
    rng = random.Random(5)
    texts = [None, "", "a  b\n\n c <|endoftext|> d", *(" ".join(rng.choice(["alpha", "été", "über.", "42", "x-y"]) for _ in range(rng.randint(1, 900))) for _ in range(40)), "word " * 5000]
    rows = docs_of(spark, [(i % 43, t) for i, t in enumerate(texts)])
    pieces = packing.cut_documents(rows, keep_ids=True).toPandas()
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i % 43, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in enumerate(texts))
    got = sorted((d, [i for part in p.sort_values("start")["ids"] for i in part]) for (d, _), p in pieces.groupby(["doc_id", "doc_tokens"]))
    assert got == want
    assert all(zlib.crc32(array("I", r.ids)) == r.ids_crc32 for r in pieces.itertuples())
    packed = packing.pack_documents(rows, scratch).toPandas()
    assert sorted(zip(packed["doc_id"], packed["start"], packed["ids_crc32"], strict=True)) == sorted(zip(pieces["doc_id"], pieces["start"], pieces["ids_crc32"], strict=True))
    for _, s in packed.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s["offset"]) == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 1024
    assert packing.pack_documents(rows.where("false"), scratch).count() == 0


def test_ids_of_long_runs_equal_the_tokenizers_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    encode, known = packing._encoder("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "\u200b", "a", "été", "42", "x.", "'s", "^", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    for text in [*texts, *(run * 1_000_000 + "x" for run in (" ", "\n", "^", "a", "\xa0"))]:
        assert encode(text) == known.encode(text, add_special_tokens=False).ids


def test_packing_by_salts_places_every_piece_once(spark, scratch):
    # a third of the rows without an id, repeated rows and one hot length
    rows = spark.createDataFrame([(None if i % 3 else i % 4, f"w{i % 50} " * (i % 7)) for i in range(300)], "doc_id long, text string").withColumn("sequence_id", F.lit("clash"))
    pieces = scratch.save(packing.cut_documents(rows), "salted")
    got = packing.pack(pieces, rows_per_task=20).toPandas()
    assert len(got) == 300 and got["sequence_id"].max() + 1 == len(packing.pack(pieces).toPandas()["sequence_id"].unique())
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert list(part["offset"]) == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() <= 1024


def test_patterns_place_every_piece():
    histogram = {1024: 3, 700: 5, 512: 2, 300: 9, 100: 4, 1: 50}
    table = packing.packing_patterns(histogram)
    for length, n in histogram.items():
        assert sum(x[2] for x in table if x[0] == length) == n
    used = {}
    for length, _, count, first, _ in table:
        for s in range(first, first + count):
            used[s] = used.get(s, 0) + length
    assert max(used.values()) <= 1024 and sorted(used) == list(range(len(used)))


def test_packs_of_hot_lengths_are_full():
    def fill(histogram):
        table = packing.packing_patterns(histogram)
        used, starts = {}, {}
        for length, _, count, first, offset in table:
            for s in range(first, first + count):
                used[s] = used.get(s, 0) + length
                starts.setdefault(s, []).append((offset, length))
        assert {n: sum(x[2] for x in table if x[0] == n) for n in histogram} == histogram and sorted(used) == list(range(len(used)))
        for parts in starts.values():
            parts.sort()
            assert parts[0][0] == 0 and sum(parts[-1]) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        # one by one into the shortest open pack, longest pieces first
        spaces = []
        for length in sorted((n for n in histogram for _ in range(histogram[n])), reverse=True):
            if spaces and spaces[0] <= -length:
                heapq.heapreplace(spaces, spaces[0] + length)
            else:
                heapq.heappush(spaces, length - 1024)
        assert sorted(1024 + x for x in spaces) == sorted(used.values())
        return sum(n * c for n, c in histogram.items()) / 1024 / len(used)

    assert fill({100: 5003}) > 0.97 and fill({1: 3000}) > 0.97 and fill({512: 7}) == 0.875
    rng = np.random.default_rng(6)
    lengths, times = np.unique(np.clip(rng.lognormal(5.5, 1, 20_000).astype(int), 2, 1024), return_counts=True)
    usual = dict(zip(lengths.tolist(), times.tolist(), strict=True))
    for hot in (60, 150, 300):
        assert fill(usual | {hot: usual.get(hot, 0) + 10_000}) > 0.9


def test_fixity(spark, scratch):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i % 300 * 40)) for i in range(2500)] + [(None, None, None)], "page_id long, url string, html string")
    records = scratch.save(fixity.warc_records(pages), "records")
    assert fixity.audit(records, records, scratch).count() == 0
    hurt = records.where("page_id <> 17 OR page_id IS NULL").withColumn("digest", F.when(F.col("page_id").isin(5, 2400), "bad").otherwise(F.col("digest")))
    got = {(r["page_id"], r["status"]) for r in fixity.audit(records, hurt, scratch).collect()}
    assert got == {(5, "changed"), (2400, "changed"), (17, "missing")}
    assert {r["status"] for r in fixity.audit(records, records.where("false"), scratch).collect()} == {"missing"}


def test_fixity_of_pages_without_ids(spark, scratch):
    """Rows without an id lie in many files; names that the operator uses itself change nothing."""
    rows = [(None, f"http://h/{i}", "x" * (i % 50)) for i in range(6000)] + [(i % 40, f"http://h/{i}", None) for i in range(80)] + [(7, None, "")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"file": F.lit(0), "offset": F.lit("o"), "digest": F.lit("d"), "size": F.lit(1)})
    records = scratch.save(fixity.warc_records(pages), "records")
    assert records.count() == len(rows) and records.where("file < 0").select("file").distinct().count() > 2000
    assert records.groupBy("file").count().where("file < 0").agg(F.max("count")).first()[0] < 20
    ends = records.selectExpr("offset + size AS end", "coalesce(lead(offset) OVER (PARTITION BY file ORDER BY offset), offset + size) AS next")
    assert ends.where("end <> next").isEmpty()
    assert fixity.audit(records, records, scratch).isEmpty()
    lost = records.where("page_id is null").orderBy("digest").first()
    hurt = records.where(F.col("digest") != lost["digest"])
    found = fixity.audit(records, hurt, scratch).collect()
    assert [(r["file"], r["offset"], r["status"]) for r in found] == [(lost["file"], lost["offset"], "missing")]
    nothing = records.where("false")
    assert fixity.audit(nothing, nothing, scratch).isEmpty() and fixity.audit(fixity.warc_records(pages.where("false")), nothing, scratch).isEmpty()
    assert {r["status"] for r in fixity.audit(nothing, records, scratch).collect()} == {"extra"}


def test_long_texts_are_hashed_in_steps(monkeypatch):
    rng = random.Random(11)
    cases = [[], [b""], [b"", b"a b c d e f", b" x ", b"y" * 400 + b" z", b"q" * 64]]
    cases += [["".join(rng.choice("aAb \n\té") for _ in range(rng.randrange(200))).encode() for _ in range(rng.randrange(5))] for _ in range(60)]
    blank = shingles._BLANK
    for texts in cases:
        whole = [*shingles.word_hashes(texts, blank, (2, 3)), *shingles.shingle_sets(texts, 5)]
        for size in (4, 7, 64):
            monkeypatch.setattr(shingles, "CHUNK", size)
            steps = [*shingles.word_hashes(texts, blank, (2, 3)), *shingles.shingle_sets(texts, 5)]
            assert all(np.array_equal(a, b) for a, b in zip(whole, steps, strict=True))
        monkeypatch.undo()


def test_mix_meets_targets(spark, scratch):
    rows = [(i, "b" if i % 3 else "a", "w " * (i % 7)) for i in range(600)] + [(1000, None, "x y"), (1001, "c", None), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("clash"))
    got = mixing.mix(df, scratch).toPandas()
    assert len(got) == len(rows) and (got["copies"] <= 3).all() and (got.loc[got["size"] == 0, "copies"] == 0).all()
    total = got["size"].sum()
    by = got.assign(taken=got["size"] * got["copies"]).groupby("source", dropna=False).agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "max"))
    assert by["target"].sum() == pytest.approx(total) and (by["target"] <= 3 * by["size"] + 1e-6).all()
    assert ((by["taken"] - by["target"]).abs() <= 7).all()
    again = mixing.mix(df, scratch).toPandas()
    assert sorted(map(str, zip(got["doc_id"], got["copies"], strict=True))) == sorted(map(str, zip(again["doc_id"], again["copies"], strict=True)))
    assert mixing.mix(df.where("false"), scratch).count() == 0


def test_mix_is_alike_with_any_buckets(spark, scratch):
    rows = [(i // 2 if i % 5 == 0 else i, "hot" if i % 3 else "b", "w " * (i % 9)) for i in range(500)] + [(None, "hot", "a b c")] * 40
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"_key": F.lit("k"), "last": F.lit("l"), "rest": F.lit(0)})
    one, many = (sorted((str(r["doc_id"]), r["source"], r["size"], r["copies"], r["_key"], r["last"]) for r in mixing.mix(df, scratch, bucket_rows=n).collect()) for n in (50_000, 3))
    assert one == many and len(one) == 540
    by = {}
    for _, source, size, copies, *_ in one:
        by.setdefault(source, []).append(size * copies)
    assert sum(map(sum, by.values())) == pytest.approx(sum(len(r[2].split()) for r in rows), abs=130)


def test_targets_are_shared_anew():
    got = mixing.source_targets([("a", 10), ("b", 10), (None, 80)])
    assert got["a"] == 30 and got["b"] == 30 and got[None] == pytest.approx(40)


NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", r"<\|im_end|> [\\INST] \ ", "<<SYS>> <</SYS>>", "", None, "ş" * 9]


def test_chat_round_trip(spark, scratch):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [(2, None, None, "x"), (None, 0, "a\nb%0A", "y"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    nodes = chat.linear_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = chat.format_paths(chat.reply_paths(nodes, scratch), nodes)
    got = {r["tree"]: r for r in made.select("tree", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [t or "" for t in NASTY]
    assert got[1]["loss"] == "".join(t or "" for t in NASTY[1::2])
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("a\nb%0A", "y")] and got[3]["n_turns"] == 2 and got[2]["turns"][0]["role"] == ""


def test_best_branches(spark, scratch):
    nodes = spark.createDataFrame([(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "good"), (1, 3, 1, 0.0, "assistant", "bad"), (1, 4, 3, 5.0, "user", "late"), (1, 8, 9, 1.0, "user", "c"), (1, 9, 8, 1.0, "user", "c")], "tree long, node long, parent long, score double, role string, text string")
    paths = chat.reply_paths(nodes, scratch, top_k=2)
    got = {r["branch_rank"]: r["formatted"] for r in chat.format_paths(paths, nodes).collect()}
    assert "late" in got[1] and "bad" in got[1] and "good" in got[2] and len(got) == 2


def test_jaccard_equals_brute_force(spark, scratch):
    rng = random.Random(11)
    word = lambda: "w%d" % rng.randint(0, 400)
    common = [word() for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, "one two three"), (None, "one two")]
    for g in range(12):
        base = common[: rng.choice([0, 40, 60])] + [word() for _ in range(rng.choice([5, 10, 40, 120]))]
        for _ in range(rng.choice([1, 2, 8])):
            text = [word() if rng.random() < 0.015 else w for w in base]
            rows.append((len(rows), " ".join(text + [word() for _ in range(rng.choice([0, 0, 5]))])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs_of(spark, rows), scratch).collect()}
    assert got.pop(None) == (1, None)
    assert got == brute_components(rows)
    assert jaccard.jaccard_components(docs_of(spark, []), scratch).count() == 0


def test_line_passages_go_once(spark, scratch):
    passage = "\n".join(f"shared line {i}" for i in range(12))
    rows = [(1, f"own a\n{passage}\nend a"), (2, f"start b\nmore b\n{passage}\nend b"), (3, None), (4, ""), (None, passage), (5, "own a\nsolo")]
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs_of(spark, rows).withColumn("removed_lines", F.lit(0)), scratch).collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] is None and got[None]["text"] == passage and got[4]["text"] == ""
    # brute force: in order of documents, a chunk of several lines stays where it stands first
    seen, want = set(), {}
    for d, text in sorted((d, t) for d, t in rows if d is not None and t is not None):
        own = text.split("\n")
        kept = []
        for s, e in lines.chunk_lines(own):
            if e - s >= 2 and tuple(own[s:e]) in seen:
                continue
            seen.add(tuple(own[s:e]))
            kept += own[s:e]
        want[d] = "\n".join(kept)
    assert {d: got[d]["text"] for d in want} == want and got[2]["removed_lines"] > 0


def test_jaccard_where_every_text_stands_twice(spark, scratch):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    for rows in ([(1, a), (1, a), (2, b), (2, b)], [(1, a), (2, a), (3, b), (4, b)]):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs_of(spark, rows).withColumn("own", F.lit("clash")), scratch).collect())
        assert got == brute_repeated(rows)


def test_jaccard_over_many_ranges(spark, scratch):
    rng = random.Random(3)
    base = [[f"g{g}w{rng.randint(0, 90)}" for _ in range(50)] for g in range(10)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else "z" for w in base[i % 10]) + f" end{rng.randint(0, 2)}") for i in range(50)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs_of(spark, rows), scratch, per_range=40).collect()}
    assert got == brute_components(rows)


def test_chunks_of_hot_passages_go_in_groups(spark, scratch, monkeypatch):
    monkeypatch.setattr(lines, "REPEATS_PER_GROUP", 7)
    passage = "\n".join(f"hot line {i}" for i in range(9))
    rows = [(i, f"own {i}\n{passage}\nend {i}") for i in range(60)] + [(5, f"own 5\n{passage}\nend 5")] * 2
    got = lines.dedup_lines(docs_of(spark, rows).withColumns({"_id": F.lit("kept"), "_gone": F.lit("too")}), scratch).collect()
    assert len(got) == 62 and all((r["_id"], r["_gone"]) == ("kept", "too") for r in got)
    kept = {r["doc_id"]: r["text"] for r in got}
    assert kept[0] == rows[0][1] and all(r["removed_chunks"] > 0 for r in got if r["doc_id"])
    inner = [tuple(passage.split("\n")[s - 1 : e - 1]) for s, e in lines.chunk_lines(rows[1][1].split("\n")) if s > 1 and e <= 10 and e - s > 1]
    assert inner and not any("\n".join(c) in t for d, t in kept.items() if d for c in inner)
    assert lines.dedup_lines(docs_of(spark, []), scratch).count() == lines.dedup_passages(docs_of(spark, []), scratch).count() == 0


def brute_repeated(rows, percent=75):
    """Components of ids where each row is compared by itself and rows of one id stand together."""
    apart = [(k, t) for k, (_, t) in enumerate(rows)]
    found, ids = brute_components(apart, percent), [d for d, _ in rows]
    edges, root = [(ids[k], ids[c]) for k, (_, c) in found.items()], {d: d for d in ids}
    for _ in ids:
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    return sorted((d, found[k][0], root[d]) for k, d in enumerate(ids))


def test_jaccard_with_repeated_ids(spark, scratch):
    def text(own, shared=""):
        return f"{shared} " + " ".join(f"{own}{i}" for i in range(30))

    shared = " ".join(f"s{i}" for i in range(20))
    # Jaccard of 1 and 2 about 0.2 with rows of both repeated; 5 joins 3 and 6 by its two texts
    rows = [(1, text("a", shared)), (1, text("a", shared)), (2, text("b", shared)), (2, text("b", shared)), (3, text("c")), (5, text("c") + " x"), (5, text("d")), (5, text("d")), (6, "y " + text("d")), (7, text("e", shared)), (8, None), (8, ""), (9, text("f")), (9, text("g"))]
    # with one side repeated too: about a half in common
    rows += [(20, " ".join(f"h{i}" for i in range(60))), (20, " ".join(f"h{i}" for i in range(60))), (21, " ".join(f"h{i}" for i in range(20, 80)))]
    rng = random.Random(4)
    for d in range(30, 42):
        base = [f"r{d // 4}w{i}" for i in range(60)]
        rows += [(d - rng.choice([0, 0, 1]), " ".join(w if rng.random() > 0.02 else f"z{rng.random()}" for w in base)) for _ in range(2)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs_of(spark, rows), scratch).collect())
    assert got == brute_repeated(rows)
    with_null = [*rows, (None, rows[0][1])]
    got = jaccard.jaccard_components(docs_of(spark, with_null), scratch).collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(46, None)] and len(got) == len(with_null)


def passage_rows():
    rng = random.Random(9)
    serial = iter(range(10**6))
    fresh = lambda n: [f"own line {next(serial)}" for _ in range(n)]
    planted = [[" ".join(f"p{n}w{k}" for k in range(51))] if n == 1 else [f"passage {n} line {k}" for k in range(n)] for n in (1, 2, 5, 20)]
    planted += [["short one"], ["", "", "after blanks", "", "", "", "again"], ["tail", "", ""], ["", " "]]
    rows = []
    for _ in range(60):
        parts = [fresh(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(planted), fresh(rng.choice([0, 1, 3]))]
        rows.append((len(rows), "\n".join(line for part in parts for line in part)))
    return planted, [*rows, (100, rows[7][1]), (101, "a\na\na\na"), (102, ""), (103, None)]


def test_passages_go_whole(spark, scratch):
    planted, rows = passage_rows()
    # an id under two texts: what goes from one does not go from the other
    twice = [(200, "zero\none\ntwo"), (200, "own line 0\n" + "\n".join(planted[2]))]
    df = docs_of(spark, [*rows, *twice, (None, rows[3][1])])
    got = lines.dedup_passages(df.withColumn("removed_lines", F.lit("clash")), scratch).collect()
    want = brute_passages(rows)
    assert {r["doc_id"]: (r["text"], r["removed_lines"]) for r in got if r["doc_id"] in want} == want
    assert {r["text"] for r in got if r["doc_id"] == 200} == {"zero\none\ntwo", "own line 0"}
    assert {r["text"] for r in got if r["doc_id"] is None} == {rows[3][1]} and len(got) == len(df.collect())
    left = "\n".join(t for t, _ in want.values())
    assert all(left.count("\n".join(p)) == 1 for p in planted[:4]) and left.count("short one") > 1


def test_blank_runs_go_as_far_as_they_repeat(spark, scratch):
    rng = random.Random(11)
    rows = []
    for d in range(40):
        text = []
        for _ in range(rng.randint(1, 4)):
            text += [rng.choice(["x", "y", f"own {d}"])] + rng.choice([[""], [" "]]) * rng.randint(0, 5) + [""] * rng.randint(0, 3)
        rows.append((d, "\n".join(text)))
    rows += [(100, "x" + "\n" * 9), (101, "x" + "\n" * 12), (102, "x" + "\n" * 7), (103, "\n" * 5 + "x"), (104, "\n" * 8 + "x"), (105, "\n" * 3)]
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in lines.dedup_passages(docs_of(spark, rows), scratch).collect()}
    assert got == brute_passages(rows)


def test_a_megabyte_of_line_ends(spark, scratch):
    rows = [(i, "x" + "\n" * 1_000_000 + f"own {i}") for i in range(2)]
    began = time.time()
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in lines.dedup_passages(docs_of(spark, rows), scratch).collect()}
    assert got[0] == (rows[0][1], 0) and got[1] == ("own 1", 1_000_000) and time.time() - began < 60


def test_pipeline_stage_removes_passages(spark):
    import corpus_pipeline

    _, rows = passage_rows()
    df = docs_of(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    assert got == {d: (t, len(t)) for d, (t, _) in brute_passages(rows).items()} | {103: (None, None)}


def test_chunk_borders_shift_with_the_text():
    body = [hashlib.md5(str(i).encode()).hexdigest() for i in range(60)]
    a = {tuple(body[s:e]) for s, e in lines.chunk_lines(body)}
    moved = ["x", "y", "z", *body]
    b = {tuple(moved[s:e]) for s, e in lines.chunk_lines(moved)}
    assert len(a & b) >= len(a) - 2


def test_toxicity_learns_words_and_beginnings(spark, scratch):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = ["ab%d" % rng.randint(0, 80) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randint(0, 29)] = "nasty" if i % 10 else "bah" + "xyzw"[rng.randint(0, 3)] * 3
        rows.append((i, " ".join(words)))
        if i < 450:
            labels.append((i, 1, int(toxic)))
    rows += [(9000, None), (9001, "")]
    df = docs_of(spark, rows).withColumn("toxic", F.lit("clash"))
    got = {r["doc_id"]: r["rejected"] for r in toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), scratch).collect()}
    assert sum(got[i] == (i % 5 == 0) for i in range(450, 600)) >= 145 and not got[9000] and not got[9001]
    none = toxicity.toxicity(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"), scratch)
    assert none.where("rejected").count() == 0 and none.count() == len(rows)


def test_passages_grow_from_chunks(spark, scratch):
    # few different lines: chunks repeat often, next to other chunks and to blank lines, within documents too
    rng = random.Random(21)
    rows = [(i, "\n".join(rng.choice([*(f"line {k}" for k in range(25)), "", " "]) for _ in range(rng.randint(1, 14)))) for i in range(70)]
    rows += [(70 + i, rows[i][1]) for i in range(5)] + [(80 + i, f"new {i}\n{rows[8][1]}\nend {i}") for i in range(5)]
    got = {r["doc_id"]: r for r in lines.dedup_passages(docs_of(spark, rows), scratch).collect()}
    assert {d: (r["text"], r["removed_lines"]) for d, r in got.items()} == brute_passages(rows)
    chunks = {r["doc_id"]: r["removed_chunks"] for r in lines.dedup_lines(docs_of(spark, rows), scratch).collect()}
    assert {d: r["removed_chunks"] for d, r in got.items()} == chunks and sum(chunks.values()) > 20


def test_texts_of_one_id_are_documents_of_their_own(spark, scratch):
    passage = "\n".join(f"line {k}" for k in range(9))
    rows = [(1, f"a\n{passage}")] * 3 + [(1, f"b\n{passage}\nc")]
    for dedup in (lines.dedup_lines, lines.dedup_passages):
        got = [r["text"] for r in dedup(docs_of(spark, rows), scratch).collect()]
        assert len(got) == 4 and len(set(got)) == 2
    # whichever of the two texts counts as the earlier one keeps the passage
    assert sorted(passage in t for t in set(got)) == [False, True]
