"""Queries on texts, chunks, scores and evidence, with DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import Config
from textloom.functions import text as T
from textloom.operators import chunks, evidence, report
from textloom.operators import similarity as S
from textloom.tables import dealt as deal
from textloom.tables import keep, shared_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def normalized(spark: SparkSession, sf_dir: str, table: str, key: str, dealt: bool = False) -> DataFrame:
    """``doc_id`` and normalized text; dealt by id first if what follows needs that anyway, so that few large row groups keep all tasks busy."""
    rows = T.nfc(read(spark, sf_dir, table).select(F.col(key).alias("doc_id"), "text"), "text")
    rows = deal(rows, "doc_id") if dealt else rows
    return rows.withColumn("text", T.normalize_text(F.col("text")))


def chunked(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """Sentence chunks of a table with one number per chunk."""
    parts = normalized(spark, sf_dir, table, key, dealt=True).withColumns({"part_no": F.lit(0), "page_number": F.lit(None).cast("int")})
    return chunks.chunk_corpus(parts).withColumn("id", F.col("doc_id") * 1_000_000 + F.col("chunk_index"))


def sides(spark: SparkSession, sf_dir: str, overlap: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of both sides with the columns that matching needs, cut once for the several joins of a query.

    Chunks of documents that no chunk of the corpus can match, by the word
    cosine of a match or by an ``overlap`` of words, are not kept.
    """
    left, right = streamed_sides(spark, sf_dir, overlap)
    return left.drop("stream"), right.drop("stream")


def streamed_sides(spark: SparkSession, sf_dir: str, overlap: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``sides`` with the ``stream`` of each chunk, by which matching folds nothing again."""
    left, right = (chunked(spark, sf_dir, table, key).select("id", "doc_id", "content", "char_start", "char_end") for table, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    right, config = keep(S.with_stream(right), "chunks"), Config()
    bound = (*config.word_range, config.prefix_share(config.least_word_cosine)) if overlap is None else (1, 1, overlap, False)
    return keep(S.matchable(left, right, *bound), "chunks"), right


def as_text(rows: DataFrame) -> DataFrame:
    return S.text_rows(rows)


def normalize_text(spark, sf_dir):
    return normalized(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", F.length("text").cast("long").alias("chars"))


def sentence_chunks(spark, sf_dir):
    return chunked(spark, sf_dir, "documents", "doc_id").select("doc_id", "chunk_index", "content", "char_start", "char_end", "token_count", "content_sha256")


def chunk_stats(spark, sf_dir):
    rows = chunked(spark, sf_dir, "documents", "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max(F.col("char_end") - F.col("char_start")).alias("longest"))


def chunk_audit(spark, sf_dir):
    rows = chunks.constraint_audit(chunked(spark, sf_dir, "documents", "doc_id"))
    return rows.groupBy("valid").agg(F.count("*").alias("chunks"))


def part_offsets(spark, sf_dir):
    parts = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part_no"), "text")
    return chunks.place_parts(parts).select("doc_id", "part_no", "part_start")


def joined_parts(spark, sf_dir):
    parts = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part_no"), "text")
    return chunks.join_parts(parts).select("doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


def _grams(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.replace("gram", F.lit("\x01"), F.lit(" ")).alias("gram")).agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("tf"))


def word_ngrams(spark, sf_dir):
    return _grams(S.word_counts(normalized(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("doc_id", "id")))


def char_ngrams(spark, sf_dir):
    return _grams(S.char_counts(normalized(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("doc_id", "id")))


def corpus_tfidf(spark, sf_dir):
    counts = S.gram_counts(normalized(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("doc_id", "id"), T.ngrams(T.words(F.col("text")), 1, 1))
    vocabulary, vectors = S.corpus_tfidf(counts, counts)
    return vectors.join(vocabulary, "idx").select("id", "gram", F.col("idx").cast("long").alias("idx"), F.round("weight", 8).alias("weight"))


def word_overlap(spark, sf_dir):
    left, right = streamed_sides(spark, sf_dir, overlap=0.5)
    return S.overlap_pairs(as_text(left), as_text(right), 0.5)


def candidate_pairs(spark, sf_dir):
    left, right = streamed_sides(spark, sf_dir)
    return S.word_pairs(as_text(left), as_text(right))


def word_cosine(spark, sf_dir):
    left, right = streamed_sides(spark, sf_dir)
    return S.word_pairs(as_text(left), as_text(right), least=0.5).select("l", "r", F.round("word", 8).alias("word"))


def hybrid_scores(spark, sf_dir):
    left, right = streamed_sides(spark, sf_dir)
    found = S.match_pairs(as_text(left), as_text(right))
    return found.select("l", "r", *(F.round(c, 8).alias(c) for c in ("word", "char", "overlap")), T.score_round(F.col("score")).cast("double").alias("score"), T.score_level(F.col("score")).alias("level"), T.percent_label(F.col("overlap")).alias("overlap_label"))


def score_components(spark, sf_dir):
    left, right = streamed_sides(spark, sf_dir)
    found = S.match_pairs(as_text(left), as_text(right))
    parts = found.select("l", "r", S.score_components(F.col("word"), F.col("char"), F.col("overlap")).alias("x"))
    return parts.select("l", "r", *(F.round(F.col(f"x.{n}.contribution").cast("double"), 8).alias(n) for n in ("word_tfidf", "character_tfidf", "word_overlap")))


def snapshot_replay(spark, sf_dir):
    """The pairs of the present profile, rescored under the stored first one."""
    left, right = (as_text(x) for x in streamed_sides(spark, sf_dir))
    snapshot = {"algorithm_version": "hybrid-v1", "word_tfidf_weight": "0.50", "character_tfidf_weight": "0.30", "word_overlap_weight": "0.20", "similarity_threshold": "0.8000"}
    pairs = S.match_pairs(left, right)
    return evidence.replay_snapshot(pairs, left, right, snapshot).select("l", "r", T.score_round(F.col("score")).cast("double").alias("score"))


def _evidence(spark, sf_dir):
    left, right = streamed_sides(spark, sf_dir)
    return evidence.match_evidence(left, right)


def token_blocks(spark, sf_dir):
    return _evidence(spark, sf_dir).drop("score_components").withColumn("similarity_score", F.col("similarity_score").cast("double"))


def coverage(spark, sf_dir):
    """Documents by the share of their text that corpus passages cover."""
    ranges = _evidence(spark, sf_dir).select(F.col("document_id").alias("doc_id"), F.col("document_match_start").alias("start"), F.col("document_match_end").alias("end"))
    lengths = normalized(spark, sf_dir, "documents", "doc_id").select("doc_id", F.length("text").cast("long").alias("length"))
    return report.document_coverage(ranges, lengths).select("doc_id", "covered", "length", "ratio", "raw_count", F.size("merged").alias("ranges"))


def _matched_chunks(spark, sf_dir):
    left, right = streamed_sides(spark, sf_dir)
    found = S.match_pairs(as_text(left), as_text(right))
    return found.join(left.select(F.col("id").alias("l"), "doc_id", "char_start", "char_end", "content"), "l").select("doc_id", F.col("l").alias("chunk"), F.expr("r div 1000000").alias("source_id"), F.concat_ws("-", "l", "r").alias("match_id"), F.col("char_start").alias("start"), F.col("char_end").alias("end"), T.score_round(F.col("score")).cast("double").alias("score"), F.lit(None).cast("int").alias("page_number"))


def chunk_coverage(spark, sf_dir):
    lengths = normalized(spark, sf_dir, "documents", "doc_id").select("doc_id", F.length("text").cast("long").alias("length"))
    return report.document_coverage(_matched_chunks(spark, sf_dir), lengths).select("doc_id", "covered", "length", F.round("ratio", 9).alias("ratio"), "raw_count")


def evidence_page(spark, sf_dir):
    return report.evidence_page(_matched_chunks(spark, sf_dir), 0, 20).select("match_id", "doc_id", "source_id", "start", "end", "score")


def next_page(spark, sf_dir):
    """The third page of a stored report, by the key of the second one's last row."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    report.store_report(_matched_chunks(spark, sf_dir), path, rows=50)
    after = None
    for _ in range(2):
        last = report.next_page(spark, path, after).collect()[-1]
        after = last["score"], last["start"], last["match_id"]
    return report.next_page(spark, path, after).select("match_id", "doc_id", "source_id", "start", "end", "score")


def report_sources(spark, sf_dir):
    titles = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_id"), F.concat(F.lit("Kaynak "), F.col("item_id").cast("string")).alias("title"))
    return report.report_sources(_matched_chunks(spark, sf_dir), titles)


def report_texts(spark, sf_dir):
    """Sections with their text, from the matched chunks."""
    found = _matched_chunks(spark, sf_dir)
    texts = normalized(spark, sf_dir, "documents", "doc_id")
    return report.report_sections(found, texts).select("doc_id", "start", "end", "score", "level", "section_text", F.size("members").cast("long").alias("members"))


def best_scores(spark, sf_dir):
    """Best chunk score of every document; 0 and no match where no pair reached the threshold."""
    best = _matched_chunks(spark, sf_dir).groupBy("doc_id").agg(F.max("score").alias("best"))
    out = read(spark, sf_dir, "documents").select("doc_id").join(best, "doc_id", "left")
    return out.select("doc_id", F.coalesce("best", F.lit(0.0)).alias("best"), F.when(F.col("best").isNull(), "no_match").otherwise("match").alias("decision"))


QUERIES = {f.__name__: f for f in (normalize_text, sentence_chunks, chunk_stats, chunk_audit, part_offsets, joined_parts, word_ngrams, char_ngrams, corpus_tfidf, word_overlap, candidate_pairs, word_cosine, hybrid_scores, score_components, snapshot_replay, token_blocks, coverage, chunk_coverage, evidence_page, next_page, report_sources, report_texts, best_scores)}


def _norm(name: str, table: str, key: str) -> str:
    return rf"""{name} AS (
  SELECT {key} AS doc_id, regexp_replace(array_to_string(list_transform(
    string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)),
    lambda x: trim(regexp_replace(regexp_replace(x, '\pC', ' ', 'g'), '[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{2028}}\x{{2029}}]+', ' ', 'g'))), chr(10)), '^\n+|\n+$', '', 'g') AS text
  FROM {table})"""


def _chunks(name: str, table: str, key: str) -> str:
    abbreviations = ", ".join(f"'{a}'" for a in T.ABBREVIATIONS)
    return rf"""{_norm(name + "_n", table, key)},
{name}_l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ln FROM {name}_n),
{name}_s AS (SELECT doc_id, ln, string_split(regexp_replace(line, '([.!?…]+)(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS f FROM {name}_l),
{name}_f AS (SELECT doc_id, ln, unnest(f) AS frag, unnest(range(1, len(f) + 1)) AS k, len(f) AS nf FROM {name}_s),
{name}_o AS (
  SELECT *, coalesce(sum(length(frag) + CASE WHEN k = nf THEN 1 ELSE 0 END) OVER w, 0) AS pos,
    regexp_extract(frag, '(\S+)$', 1) AS tok FROM {name}_f
  WINDOW w AS (PARTITION BY doc_id ORDER BY ln, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_g AS (
  SELECT *, CASE WHEN lower(tok) IN ({abbreviations}) OR (regexp_matches(tok, '^\p{{L}}\.$') AND tok NOT IN ('ß.', 'İ.')) THEN 1 ELSE 0 END AS glue FROM {name}_o),
{name}_i AS (SELECT *, sum(1 - glue) OVER (PARTITION BY doc_id, ln ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS isl FROM {name}_g),
{name}_r AS (SELECT doc_id, ln, coalesce(isl, 0) AS isl, min(pos) AS pos, string_agg(frag, '' ORDER BY k) AS raw FROM {name}_i GROUP BY doc_id, ln, coalesce(isl, 0)),
{name} AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS chunk_index, trim(raw) AS content,
    CAST(pos + length(raw) - length(ltrim(raw)) AS BIGINT) AS char_start, CAST(pos + length(raw) - length(ltrim(raw)) + length(trim(raw)) AS BIGINT) AS char_end,
    doc_id * 1000000 + row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS id
  FROM {name}_r WHERE trim(raw) <> '')"""


_FOLD = "replace(replace(lower(translate({}, 'Iİ', 'ıi')), 'ß', 'ss'), 'ς', 'σ')"


def _words(column: str) -> str:
    return f"regexp_extract_all({_FOLD.format(column)}, '[\\p{{L}}\\p{{N}}_]+')"


_SIDES = _chunks("d", "documents", "doc_id") + ",\n" + _chunks("b", "benchmark", "item_id")
_WORD_GRAMS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || chr(1) || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2]))"
_CHAR_GRAMS = "list_concat(" + ", ".join(f"list_transform(range(1, greatest(1, length(c) - {n - 2})), lambda i: substr(c, i, {n}))" for n in (3, 4, 5)) + ")"


def _counts(name: str, source: str, grams: str, extra: str) -> str:
    return f"""{name}_t AS (SELECT id, unnest({grams}) AS g FROM (SELECT id, {extra} FROM {source})),
{name} AS (SELECT id, g, CAST(count(*) AS DOUBLE) AS t FROM {name}_t GROUP BY id, g),
{name}_q AS (SELECT id, sum(t * t) AS q FROM {name} GROUP BY id)"""


_K2 = "power(ln(1.5) + 1, 2)"


def _cosine(name: str, left: str, right: str, keep: str) -> str:
    return f"""{name} AS (
  SELECT a.id AS l, b.id AS r, least(1.0, greatest(0.0, round(sum(a.t * b.t) / sqrt(({_K2} * max(qa.q) - ({_K2} - 1) * sum(a.t * a.t)) * ({_K2} * max(qb.q) - ({_K2} - 1) * sum(b.t * b.t))), 12))) AS c
  FROM {left} a JOIN {right} b ON a.g = b.g JOIN {left}_q qa ON qa.id = a.id JOIN {right}_q qb ON qb.id = b.id {keep}
  GROUP BY a.id, b.id)"""


_WORD_PAIRS = _SIDES + ",\n" + _counts("dw", "d", _WORD_GRAMS, _words("content") + " AS w") + ",\n" + _counts("bw", "b", _WORD_GRAMS, _words("content") + " AS w") + ",\n" + _cosine("wp", "dw", "bw", "") + ",\nw5 AS (SELECT * FROM wp WHERE c >= 0.5)"
_STREAM = "trim(regexp_replace(" + _FOLD.format("content") + ", '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS c"
_MATCHES = (
    _WORD_PAIRS
    + ",\ndl AS (SELECT * FROM d WHERE id IN (SELECT l FROM w5)),\nbl AS (SELECT * FROM b WHERE id IN (SELECT r FROM w5)),\n"
    + _counts("dc", "dl", _CHAR_GRAMS, _STREAM)
    + ",\n"
    + _counts("bc", "bl", _CHAR_GRAMS, _STREAM)
    + ",\n"
    + _cosine("cp", "dc", "bc", "JOIN w5 ON w5.l = a.id AND w5.r = b.id")
    + f""",
ov AS (
  SELECT w5.l, w5.r, len(list_intersect(list_distinct({_words("dl.content")}), list_distinct({_words("bl.content")}))) AS s,
    len(list_distinct(list_concat({_words("dl.content")}, {_words("bl.content")}))) AS u
  FROM w5 JOIN dl ON dl.id = w5.l JOIN bl ON bl.id = w5.r),
sc AS (
  SELECT w5.l, w5.r, w5.c AS word, coalesce(cp.c, 0) AS char, CASE WHEN ov.u > 0 THEN ov.s / ov.u ELSE 0 END AS overlap
  FROM w5 LEFT JOIN cp ON cp.l = w5.l AND cp.r = w5.r JOIN ov ON ov.l = w5.l AND ov.r = w5.r),
hs AS (SELECT *, round(least(1.0, 0.5 * word + 0.25 * char + 0.25 * overlap), 12) AS score FROM sc),
m AS (SELECT * FROM hs WHERE score >= 0.75),
mc AS (
  SELECT d.doc_id, m.l AS chunk, CAST(floor(m.r / 1000000) AS BIGINT) AS source_id, CAST(m.l AS BIGINT) || '-' || CAST(m.r AS BIGINT) AS match_id,
    d.char_start AS start, d.char_end AS stop, d.content, round(m.score, 4) AS score FROM m JOIN d ON d.id = m.l)"""
)



def _spans(name: str, chunks: str, side: str) -> str:
    """Tokens of the matched chunks, numbered, with their ranges."""
    return rf"""{name}_w AS (
  SELECT id, regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+') AS w, regexp_split_to_array(content, '[\p{{L}}\p{{N}}_]+') AS s FROM {chunks} WHERE id IN (SELECT {side} FROM m)),
{name}_u AS (SELECT id, unnest(w) AS w, unnest(s[1:len(w)]) AS s, unnest(range(0, len(w))) AS k FROM {name}_w),
{name} AS (
  SELECT id, k, regexp_extract({_FOLD.format("w")}, '[\p{{L}}\p{{N}}_]+') AS token, sum(length(s) + length(w)) OVER (PARTITION BY id ORDER BY k) AS stop,
    sum(length(s) + length(w)) OVER (PARTITION BY id ORDER BY k) - length(w) AS start FROM {name}_u)"""


#: Windows are split by their longest run until none holds any, all pairs at a time.
_CLIPPED = """SELECT w.*, greatest(0, alo - i, blo - j) AS late, least(size, ahi - i, bhi - j) - greatest(0, alo - i, blo - j) AS n, i + greatest(0, alo - i, blo - j) AS bi, j + greatest(0, alo - i, blo - j) AS bj
  FROM w JOIN runs ON runs.l = w.l AND runs.r = w.r WHERE least(size, ahi - i, bhi - j) > greatest(0, alo - i, blo - j)"""
_BEST = f"SELECT l, r, alo, ahi, blo, bhi, max({{'n': n, 'i': -bi, 'j': -bj}}) AS x FROM ({_CLIPPED}) GROUP BY l, r, alo, ahi, blo, bhi"
_BLOCKS = (
    "RECURSIVE "
    + _MATCHES
    + ",\n"
    + _spans("ds", "d", "l")
    + ",\n"
    + _spans("bs", "b", "r")
    + f""",
cells AS (SELECT m.l, m.r, a.k AS i, z.k AS j FROM m JOIN ds a ON a.id = m.l JOIN bs z ON z.id = m.r AND z.token = a.token),
marked AS (SELECT *, i - row_number() OVER (PARTITION BY l, r, i - j ORDER BY i) AS island FROM cells),
runs AS (SELECT l, r, min(i) AS i, min(j) AS j, count(*) AS size FROM marked GROUP BY l, r, i - j, island),
w AS (
  SELECT l, r, CAST(0 AS BIGINT) AS alo, (SELECT count(*) FROM ds WHERE ds.id = l) AS ahi, CAST(0 AS BIGINT) AS blo, (SELECT count(*) FROM bs WHERE bs.id = r) AS bhi FROM m
  UNION ALL
  SELECT l, r, unnest([alo, x.n - x.i]), unnest([-x.i, ahi]), unnest([blo, x.n - x.j]), unnest([-x.j, bhi]) FROM ({_BEST})),
blocks AS (SELECT l, r, -x.i AS i, -x.j AS j, x.n AS n FROM ({_BEST})),
ev AS (
  SELECT d.doc_id AS document_id, b.doc_id AS source_id, CAST(k.l AS BIGINT) AS document_chunk_id, CAST(k.r AS BIGINT) AS source_chunk_id, round(m.score, 4) AS similarity_score,
    CAST(d.char_start + a0.start AS BIGINT) AS document_match_start, CAST(d.char_start + a1.stop AS BIGINT) AS document_match_end,
    CAST(b.char_start + z0.start AS BIGINT) AS source_match_start, CAST(b.char_start + z1.stop AS BIGINT) AS source_match_end, k.n AS matched_token_count
  FROM blocks k JOIN m ON m.l = k.l AND m.r = k.r JOIN d ON d.id = k.l JOIN b ON b.id = k.r
  JOIN ds a0 ON a0.id = k.l AND a0.k = k.i JOIN ds a1 ON a1.id = k.l AND a1.k = k.i + k.n - 1
  JOIN bs z0 ON z0.id = k.r AND z0.k = k.j JOIN bs z1 ON z1.id = k.r AND z1.k = k.j + k.n - 1)"""
)

SQL = {
    "normalize_text": "WITH " + _norm("n", "documents", "doc_id") + " SELECT doc_id, text, CAST(length(text) AS BIGINT) AS chars FROM n",
    "sentence_chunks": "WITH " + _chunks("d", "documents", "doc_id") + r" SELECT doc_id, chunk_index, content, char_start, char_end, CAST(len(regexp_extract_all(content, '[\p{L}\p{N}_]+')) AS BIGINT) AS token_count, sha256(content) AS content_sha256 FROM d",
    "chunk_stats": "WITH " + _chunks("d", "documents", "doc_id") + r" SELECT doc_id, count(*) AS chunks, CAST(sum(len(regexp_extract_all(content, '[\p{L}\p{N}_]+'))) AS BIGINT) AS tokens, max(char_end - char_start) AS longest FROM d GROUP BY doc_id",
    "chunk_audit": "WITH " + _chunks("d", "documents", "doc_id") + " SELECT char_start >= 0 AND char_end > char_start AS valid, count(*) AS chunks FROM d GROUP BY 1",
    "part_offsets": "SELECT conv_id AS doc_id, turn AS part_no, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS part_start FROM conversations",
    "joined_parts": "SELECT conv_id AS doc_id, CAST(length(string_agg(text, chr(10) ORDER BY turn)) AS BIGINT) AS chars, sha256(string_agg(text, chr(10) ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id",
    "word_ngrams": "WITH " + _norm("n", "benchmark", "item_id") + ", x AS (SELECT doc_id AS id, text AS content FROM n), " + _counts("c", "x", _WORD_GRAMS, _words("content") + " AS w") + " SELECT replace(g, chr(1), ' ') AS gram, count(*) AS df, CAST(sum(t) AS BIGINT) AS tf FROM c GROUP BY g",
    "char_ngrams": "WITH " + _norm("n", "benchmark", "item_id") + ", x AS (SELECT doc_id AS id, text AS content FROM n), " + _counts("c", "x", _CHAR_GRAMS, _STREAM) + " SELECT g AS gram, count(*) AS df, CAST(sum(t) AS BIGINT) AS tf FROM c GROUP BY g",
    "corpus_tfidf": "WITH " + _norm("n", "benchmark", "item_id") + ", x AS (SELECT doc_id AS id, text AS content FROM n), " + _counts("c", "x", "w", _words("content") + " AS w") + """,
v AS (SELECT g, ln((1.0 + (SELECT count(DISTINCT id) FROM c)) / (1 + count(*))) + 1 AS idf, row_number() OVER (ORDER BY g) - 1 AS idx FROM c GROUP BY g),
z AS (SELECT id, g, idx, t * idf AS w FROM c JOIN v USING (g))
SELECT id, g AS gram, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 8) AS weight FROM z""",
    "word_overlap": "WITH " + _SIDES + f""",
dx AS (SELECT id, list_distinct({_words("content")}) AS w FROM d), bx AS (SELECT id, list_distinct({_words("content")}) AS w FROM b),
de AS (SELECT id, len(w) AS n, unnest(w) AS w FROM dx), be AS (SELECT id, len(w) AS n, unnest(w) AS w FROM bx),
p AS (SELECT de.id AS l, be.id AS r, count(*) AS shared, max(de.n) + max(be.n) - count(*) AS total FROM de JOIN be USING (w) GROUP BY 1, 2)
SELECT l, r, shared, total, shared / total AS score FROM p WHERE shared / total >= 0.5""",
    "word_cosine": "WITH " + _WORD_PAIRS + " SELECT l, r, round(c, 8) AS word FROM w5",
    "hybrid_scores": "WITH " + _MATCHES + " SELECT l, r, round(word, 8) AS word, round(char, 8) AS char, round(overlap, 8) AS overlap, round(score, 4) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level, regexp_replace(printf('%.1f', round(overlap * 100, 1)), '\\.0$', '') || '%' AS overlap_label FROM m",
    "score_components": "WITH " + _MATCHES + " SELECT l, r, round(word * 0.5, 8) AS word_tfidf, round(char * 0.25, 8) AS character_tfidf, round(overlap * 0.25, 8) AS word_overlap FROM m",
    "snapshot_replay": "WITH " + _MATCHES + " SELECT l, r, round(round(0.5 * word + 0.3 * char + 0.2 * overlap, 12), 4) AS score FROM m WHERE round(0.5 * word + 0.3 * char + 0.2 * overlap, 12) >= 0.8",
    "chunk_coverage": "WITH " + _MATCHES + ", u AS (SELECT doc_id, sum(stop - start) AS covered FROM (SELECT DISTINCT doc_id, start, stop FROM mc) GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n FROM mc GROUP BY doc_id) SELECT d_n.doc_id, CAST(coalesce(covered, 0) AS BIGINT) AS covered, CAST(length(text) AS BIGINT) AS length, round(CASE WHEN length(text) > 0 THEN coalesce(covered, 0) / length(text) ELSE 0 END, 9) AS ratio, coalesce(n, 0) AS raw_count FROM d_n LEFT JOIN u USING (doc_id) LEFT JOIN c USING (doc_id)",
    "token_blocks": "WITH " + _BLOCKS + " SELECT * FROM ev",
    "coverage": "WITH " + _BLOCKS + """, o AS (
  SELECT document_id AS doc_id, document_match_start AS s, document_match_end AS e,
    document_match_start > max(document_match_end) OVER (PARTITION BY document_id ORDER BY document_match_start, document_match_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opens
  FROM (SELECT DISTINCT document_id, document_match_start, document_match_end FROM ev)),
g AS (SELECT *, sum(CASE WHEN coalesce(opens, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o),
u AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM g GROUP BY doc_id, island),
c AS (SELECT doc_id, sum(e - s) AS covered, count(*) AS ranges FROM u GROUP BY doc_id),
q AS (SELECT document_id AS doc_id, count(*) AS raw_count FROM ev GROUP BY 1)
SELECT doc_id, CAST(coalesce(covered, 0) AS BIGINT) AS covered, CAST(length(text) AS BIGINT) AS length, CASE WHEN length(text) > 0 THEN coalesce(covered, 0) / length(text) ELSE 0 END AS ratio,
  coalesce(raw_count, 0) AS raw_count, CAST(coalesce(ranges, 0) AS INTEGER) AS ranges
FROM d_n LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id)""",
    "evidence_page": "WITH " + _MATCHES + ' SELECT match_id, doc_id, source_id, start, stop AS "end", score FROM mc ORDER BY score DESC, start, match_id LIMIT 20',
    "next_page": "WITH " + _MATCHES + ' SELECT match_id, doc_id, source_id, start, stop AS "end", score FROM mc ORDER BY score DESC, start, match_id LIMIT 20 OFFSET 40',
    "report_sources": "WITH " + _MATCHES + " SELECT source_id, count(*) AS matches, max(score) AS best_score, 'Kaynak ' || source_id AS title FROM mc GROUP BY source_id",
    "report_texts": "WITH " + _MATCHES + ' SELECT doc_id, start, stop AS "end", max(score) AS score, CASE WHEN max(score) >= 0.8 THEN \'high\' ELSE \'medium\' END AS level, content AS section_text, count(*) AS members FROM mc GROUP BY doc_id, start, stop, content',
    "best_scores": "WITH " + _MATCHES + ", x AS (SELECT doc_id, max(score) AS best FROM mc GROUP BY doc_id) SELECT doc_id, coalesce(best, 0) AS best, CASE WHEN best IS NULL THEN 'no_match' ELSE 'match' END AS decision FROM documents LEFT JOIN x USING (doc_id)",
}
