"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embedding_dedup, hard_negatives, language_id, license_scan, line_dedup, ngram_lm, periodic_runs, quality, simhash, suffix_dedup, url_filters
from .common import remainder, table

#: The tokenizer file's name; its folder is found by the package that holds it.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_deleted", F.sha2("text", 256).alias("text_sha256"))


#: Runs from each line over the lines' texts instead of hashes, found by a range over the words before a line.
RUNS_ON_SQL = """
WITH texts AS (
  SELECT DISTINCT doc_id, text,
    string_split(replace(replace(replace(replace(text, chr(10), chr(10) || chr(1)), '. ', '. ' || chr(1)), '! ', '! ' || chr(1)), '? ', '? ' || chr(1)), chr(1)) AS parts
  FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, text, unnest(parts) AS part, unnest(range(len(parts))) AS place FROM texts
), own AS (
  SELECT doc_id, text, part, place, trim(part, ' ' || chr(10)) AS line FROM lines
), counted AS (
  SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS n FROM own WHERE line <> ''
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id, text ORDER BY place) - n AS before FROM counted
), runs AS (
  SELECT doc_id, text, place, max(place) OVER run AS last, sum(n) OVER run AS words, list(line) OVER run AS content
  FROM placed WINDOW run AS (PARTITION BY doc_id, text ORDER BY before RANGE BETWEEN CURRENT ROW AND 39 FOLLOWING)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, place) AS nth FROM runs WHERE words >= 40
), gone AS (
  SELECT DISTINCT doc_id, text, unnest(range(place, last + 1)) AS place FROM ranked WHERE nth > 1
), rebuilt AS (
  SELECT o.doc_id, o.text, count(g.place) AS n_deleted,
    coalesce(string_agg(o.part, '' ORDER BY o.place) FILTER (g.place IS NULL), '') AS kept
  FROM own o LEFT JOIN gone g ON g.doc_id = o.doc_id AND g.text = o.text AND g.place = o.place GROUP BY o.doc_id, o.text
)
SELECT d.doc_id, CAST(coalesce(r.n_deleted, 0) AS BIGINT) AS n_deleted, sha256(r.kept) AS text_sha256
FROM documents d LEFT JOIN rebuilt r ON r.doc_id = d.doc_id AND r.text = d.text
"""


#: The rule: those and the runs that go back from each line.
LINE_DEDUP_SQL = RUNS_ON_SQL.replace(
    "), ranked AS (",
    """), back AS (
  SELECT doc_id, text, min(place) OVER run AS place, place AS last, sum(n) OVER run AS words, list(line) OVER run AS content, sum(n) OVER run - n AS words_before
  FROM placed WINDOW run AS (PARTITION BY doc_id, text ORDER BY before + n RANGE BETWEEN 39 PRECEDING AND CURRENT ROW)
), both_ways AS (
  SELECT * FROM runs WHERE words >= 40 UNION ALL SELECT doc_id, text, place, last, words, content FROM back WHERE words_before >= 40
), ranked AS (""",
).replace("FROM runs WHERE words >= 40\n", "FROM both_ways\n")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, tokenizer_path(), keep=["doc_id"], with_ids=False)


#: The written rules of operator 8: (verdict, host/path).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    model = ngram_lm.train(docs.filter(~held))
    found = ngram_lm.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per stretch of a document that is a benchmark item within the edit budget."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand as files of a tree: source / thousand / hundred / file, every tenth a file named LICENSE.

    The LICENSE of a number divisible by 1000 lies in the thousand's directory, by 10,000 in the source's.
    """
    i = F.coalesce(F.col("doc_id"), F.lit(1))
    is_license = i % 10 == 0
    folder = F.when(is_license & (i % 10000 == 0), F.col("source")).when(is_license & (i % 1000 == 0), F.concat_ws("/", "source", F.floor(i / 1000).cast("string")))
    folder = F.coalesce(folder, F.concat_ws("/", "source", F.floor(i / 1000).cast("string"), F.floor(i / 100).cast("string")))
    name = F.concat(F.col("doc_id").cast("string"), F.when(is_license, F.lit(".LICENSE")).otherwise(F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", folder, name).alias("path"), is_license.alias("is_license_file"), "text")
    return license_scan.inherit(license_scan.own_licenses(files))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


EMBEDDING_DEDUP_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(node, got) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.got
), least AS (SELECT node, min(got) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.node = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""


#: A document is rejected if the scorer gives either fault this probability.
REJECT = 0.5


def rejected(prefix: str = "") -> Column:
    return F.greatest(*[F.col(prefix + c) for c in ("poor", "toxic")]) >= REJECT


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.train(docs, labels=table(spark, sf_dir, "labels"))).drop("text")
    return judged.select("doc_id", "poor", "toxic", "poor_label", "toxic_label", (~rejected()).alias("kept"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lambda c: F.coalesce(remainder(F.col(c), 4) == 2, F.lit(False))  # noqa: E731  a row without id trains, as in op1
    found = language_id.identify(docs, language_id.train(docs.filter(~held("doc_id"))))
    return found.select(F.col("id").alias("doc_id"), held("id").alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the document with a page's id say whether its URL is to be blocked (poor quality or toxic)."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    mined = url_filters.mine_rules(pages.join(marks, "page_id"), "url", F.col("block"))
    return url_filters.judge(pages, mined, url_filters.written_rules(spark, URL_RULES), keep=["page_id"])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = periodic_runs.made_periodic(F.col("text"), F.col("doc_id"))
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), text=text)
    # The runs lie by start and period, so of equal exponents the first stays.
    greater = lambda best, r: best.isNull() | (r.length * best.period > best.length * r.period)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(greater(best, r), r).otherwise(best))
    line = lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    return found.select("id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        F.col("id").alias("doc_id"), "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.hard_negatives(vectors, F.col("id") % 50 == 0)


HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
  n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed")
    return left.select(F.col("id").alias("doc_id"), "n_bytes", removed, F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_lm": op1_ngram_lm,
    "op2_decontaminate": op2_decontaminate,
    "op3_license_scan": op3_license_scan,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_url_filters": op8_url_filters,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe": op10_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_dedup": op13_suffix_dedup,
}
ORACLES: dict[str, str] = {"op4_embedding_dedup": EMBEDDING_DEDUP_SQL, "op9_line_dedup": LINE_DEDUP_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
