"""The operators applied to the shared tables, with the columns that a check can compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.plans.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tallyfold.llm.packing import pack

    rows = pack(table(spark, folder, "documents"), vocabulary(BYTES))
    return rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tallyfold.llm.simhash import near_duplicates

    rows = near_duplicates(table(spark, folder, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_class_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    from tallyfold.llm import toxicity

    docs = table(spark, folder, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query
def op8_language_bitmasks(spark: SparkSession, folder: str) -> DataFrame:
    from tallyfold.llm import language

    docs = table(spark, folder, "documents")
    return language.predict_language(docs, language.train(docs))


@query
def op3_winnowed_lines(spark: SparkSession, folder: str) -> DataFrame:
    from tallyfold.llm.lines import without_repeated_runs

    rows = without_repeated_runs(table(spark, folder, "documents"))
    return rows.select("doc_id", "text", F.col("removed").cast("long").alias("n_removed"))


# The same rule on the texts themselves: runs of lines are compared as text.
LINES_SQL = r"""
cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {docs}),
numbered AS (SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS content FROM cut),
counted AS (SELECT *, len(regexp_extract_all(content, '[^\x20\x09-\x0D]+')) AS n FROM numbered),
placed AS (
  SELECT doc_id, line, content, n, sum(n) OVER (PARTITION BY doc_id ORDER BY line)::BIGINT AS ends FROM counted WHERE n > 0
),
spanned AS (
  SELECT doc_id, line, ends, ends - n AS starts,
    list(content) OVER ahead AS fore, max(line) OVER ahead AS last, max(ends) OVER ahead AS top,
    list(content) OVER behind AS back, min(line) OVER behind AS first, min(ends - n) OVER behind AS bottom
  FROM placed
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY ends - n RANGE BETWEEN 0 PRECEDING AND 49 FOLLOWING),
         behind AS (PARTITION BY doc_id ORDER BY ends RANGE BETWEEN 49 PRECEDING AND 0 FOLLOWING)
),
runs AS (
  SELECT doc_id, line AS first, last, fore AS run FROM spanned WHERE top - starts >= 50
  UNION
  SELECT doc_id, first, line AS last, back AS run FROM spanned WHERE ends - bottom >= 50
),
ranked AS (
  SELECT *, first_value(doc_id) OVER early AS doc0, first_value(last) OVER early AS last0
  FROM runs WINDOW early AS (PARTITION BY run ORDER BY doc_id, first, last)
),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS line FROM ranked WHERE doc_id <> doc0 OR first > last0
),
left_over AS (
  SELECT m.doc_id, string_agg(m.content, chr(10) ORDER BY m.line) FILTER (WHERE g.line IS NULL) AS text,
    count(g.line) AS n_removed
  FROM numbered m LEFT JOIN gone g ON m.doc_id = g.doc_id AND m.line = g.line GROUP BY m.doc_id
)
"""
ORACLES["op3_winnowed_lines"] = f"""
WITH {LINES_SQL.format(docs="documents")}
SELECT doc_id, coalesce(text, '') AS text, n_removed FROM left_over
"""


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


@query
def op2_repair_grammar(spark: SparkSession, folder: str) -> DataFrame:
    from tallyfold.llm import repair

    files = repair.write_blocks(table(spark, folder, "documents"), vocabulary(WORDS))
    return repair.read_documents(files).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op7_tree_concatenation(spark: SparkSession, folder: str) -> DataFrame:
    from tallyfold.llm import bpe

    rows = bpe.decode(bpe.encode(table(spark, folder, "documents"), vocabulary(BYTES)), vocabulary(BYTES))
    return rows.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"),
    )


@query
def op5_k_means_tree(spark: SparkSession, folder: str) -> DataFrame:
    from tallyfold.llm.neighbours import nearest

    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op9_consistent_parsing(spark: SparkSession, folder: str) -> DataFrame:
    from tallyfold.llm.parsing import fingerprint_documents

    rows = fingerprint_documents(table(spark, folder, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query
def op1_bradley_terry(spark: SparkSession, folder: str) -> DataFrame:
    from tallyfold.llm import quality

    docs = table(spark, folder, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, folder, "labels")))


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    from tallyfold.llm.audit import audit

    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


# Every document goes through every order by itself; no coalitions and no Shapley formula.
ORACLES["op13_filter_audit"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
failed AS (
  SELECT doc_id, part, list_filter([
      CASE WHEN len(words) < 50 THEN 'A' END,
      CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' END,
      CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' END,
      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
      CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END
    ], lambda x: x IS NOT NULL) AS fails
  FROM texts
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
steps AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
),
marked AS (
  SELECT d.*, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM failed d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY ALL) l USING (doc_id)
),
-- Documents of a part that fail the same filters and bear the same labels go through the orders together.
alike AS (SELECT part, fails, good, toxic, count(*) AS n FROM marked GROUP BY ALL),
fates AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails,
    list_contains(fails, f) AS failing, len(list_filter(fails, lambda x: contains(earlier, x))) > 0 AS gone
  FROM alike, steps
),
counted AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER (WHERE NOT gone AND NOT failing) AS kept,
    sum(n) FILTER (WHERE NOT gone AND failing) AS removed,
    sum(n) FILTER (WHERE gone AND failing) AS redundant,
    sum(n) FILTER (WHERE fails = [f]) AS unique_fails,
    sum(n) FILTER (WHERE NOT gone AND failing AND good) AS good_lost,
    sum(n) FILTER (WHERE NOT gone AND failing AND toxic) AS toxic_lost
  FROM fates GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


@query
def op12_phrase_stripes(spark: SparkSession, folder: str) -> DataFrame:
    from tallyfold.llm.collocations import best_phrases

    return best_phrases(table(spark, folder, "documents"))


ORACLES["op12_phrase_stripes"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
pieces AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM cut),
placed AS (SELECT id, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM pieces),
runs AS (SELECT lang, w AS w1, lead(w) OVER piece AS w2, lead(w, 2) OVER piece AS w3 FROM placed WINDOW piece AS (PARTITION BY id ORDER BY i)),
ones AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM runs GROUP BY ALL),
twos AS (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
threes AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
sizes AS (SELECT lang, sum(f) AS n FROM ones GROUP BY lang),
over AS (
  SELECT lang, w1, w2, max(f) AS f
  FROM (SELECT lang, w1, w2, f FROM threes UNION ALL SELECT lang, w2 AS w1, w3 AS w2, f FROM threes) GROUP BY ALL
),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM twos c JOIN ones l ON l.lang = c.lang AND l.w1 = c.w1 JOIN ones r ON r.lang = c.lang AND r.w1 = c.w2
    LEFT JOIN over o ON o.lang = c.lang AND o.w1 = c.w1 AND o.w2 = c.w2
  WHERE c.f >= 10 AND (o.f IS NULL OR 100 * o.f < 50 * c.f)
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, l.f, r.f
  FROM threes c JOIN ones l ON l.lang = c.lang AND l.w1 = c.w1
    JOIN twos r ON r.lang = c.lang AND r.w1 = c.w2 AND r.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, l.f, r.f
  FROM threes c JOIN twos l ON l.lang = c.lang AND l.w1 = c.w1 AND l.w2 = c.w2
    JOIN ones r ON r.lang = c.lang AND r.w1 = c.w3
),
scored AS (SELECT *, 1000000 * a * a // (l * r) AS score FROM cuts),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
ranked AS (
  SELECT lang, phrase, a, l, r, n, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM lowest JOIN sizes USING (lang) WHERE place = 1
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


@query
def op11_voronoi_join(spark: SparkSession, folder: str) -> DataFrame:
    from tallyfold.llm.voronoi import best_by_product

    return best_by_product(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op11_voronoi_join"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
