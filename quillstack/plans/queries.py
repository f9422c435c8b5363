"""Registered queries of the retrieval operators over the test tables, each with its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..operators import retrieval as R
from ..operators.lineage import measured_broadcasts
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DOCS = "(SELECT doc_id AS entry_id, text FROM documents)"
ASKED = "(SELECT item_id AS question_id, text FROM benchmark)"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    measured_broadcasts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")


@query(f"WITH {O.terms('e', DOCS, 'entry_id', 'text').strip()} SELECT term, count(DISTINCT entry_id) AS df, count(*) AS cf FROM e GROUP BY term")
def token_df(spark, sf_dir):
    flat = R.postings(terms.vectors(docs(spark, sf_dir), {"body": {"text": 1}}), "body")
    return flat.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {O.terms('e', DOCS, 'entry_id', 'text').strip()} SELECT source AS package, count(*) AS n_entries, CAST(sum(len) AS BIGINT) AS total_len, max(len) AS max_len FROM (SELECT doc_id, source, greatest(count(term), 1) AS len FROM documents LEFT JOIN e ON doc_id = entry_id GROUP BY ALL) GROUP BY 1")
def entry_len_stats(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.struct("doc_id", F.col("source").alias("package")).alias("entry_id"), "text")
    return terms.vectors(own, {"body": {"text": 1}}, frozenset()).select("entry_id.package", F.col("body_len").alias("len")).groupBy("package").agg(F.count("*").alias("n_entries"), F.sum("len").alias("total_len"), F.max("len").alias("max_len"))


@query(f"WITH {O.bm25('h', DOCS, ASKED, False).strip()} SELECT question_id, entry_id, round(score, 6) AS score, matched, rank FROM {O.best('h', 20)}")
def bm25_topk(spark, sf_dir):
    hits = R.bm25(docs(spark, sf_dir), asked(spark, sf_dir), {"text": 1})
    return R.top(hits, ["question_id"], 20).withColumn("score", F.round("score", 6))


@query(f"WITH {O.bm25('h', DOCS, ASKED, True).strip()} SELECT question_id, entry_id, round(score, 6) AS score, matched, rank FROM {O.best('h', 20)}")
def bm25_synonym_topk(spark, sf_dir):
    hits = R.bm25(docs(spark, sf_dir), asked(spark, sf_dir), {"text": 1}, synonyms=True)
    return R.top(hits, ["question_id"], 20).withColumn("score", F.round("score", 6))


HEADS = r"(SELECT page_id AS entry_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS text FROM pages)"


@query(f"WITH {O.bm25('h', HEADS, ASKED, False).strip()} SELECT question_id, entry_id, round(score, 6) AS score, matched, rank FROM {O.best('h', 20)}")
def bm25_head_topk(spark, sf_dir):
    heads = table(spark, sf_dir, "pages").select(F.col("page_id").alias("entry_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("text"))
    return R.top(R.bm25(heads, asked(spark, sf_dir), {"text": 1}), ["question_id"], 20).withColumn("score", F.round("score", 6))


@query(f"WITH {O.terms('e', DOCS, 'entry_id', 'text').strip()},{O.question_terms('q', ASKED, 'question_id', False)} SELECT question_id, term, coalesce(df, 0) AS df FROM q LEFT JOIN (SELECT term, count(DISTINCT entry_id) AS df FROM e GROUP BY 1) USING (term) WHERE coalesce(df, 0) < 0.03 * (SELECT count(*) FROM documents)")
def rare_terms(spark, sf_dir):
    return R.rare_terms(docs(spark, sf_dir), asked(spark, sf_dir), {"text": 1})


#: Vectors asked for: every 50th.
NEAR = "(SELECT q.vec_id AS question_id, v.vec_id AS entry_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)"


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector")), v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))


@query(f"SELECT question_id, entry_id, round(score, 6) AS cos, rank FROM {O.best(NEAR, 20)}")
def cosine_topk(spark, sf_dir):
    near = R.dense(*vectors(spark, sf_dir)).filter("rank < 20")
    return near.select("question_id", "entry_id", F.round("cos", 6).alias("cos"), "rank")


DENSE = f"""n AS (SELECT * FROM {O.best(NEAR, 301)}),
f AS (SELECT question_id, coalesce(max(CASE WHEN rank = 300 THEN score END), 0) AS low, max(score) AS high FROM n GROUP BY 1),
d AS (SELECT question_id, entry_id, rank, score AS cos, greatest((score - low) / greatest(high - low, 1e-6), 0) AS dense FROM n JOIN f USING (question_id) WHERE rank < 300)"""


@query(f"WITH {DENSE} SELECT question_id, entry_id, rank, round(dense, 6) AS dense FROM d")
def dense_minmax_pool(spark, sf_dir):
    return R.dense(*vectors(spark, sf_dir)).select("question_id", "entry_id", "rank", F.round("dense", 6).alias("dense"))


@query(f"WITH {DENSE} SELECT question_id, entry_id, rank, round(dense, 6) AS dense FROM d")
def quantised_pool(spark, sf_dir):
    """``dense_minmax_pool`` from a byte a component, with the exact vectors of what the bounds admit."""
    own, asked = vectors(spark, sf_dir)
    near = R.dense_by_codes(R.quantised(own), own, asked)
    return near.select("question_id", "entry_id", "rank", F.round("dense", 6).alias("dense"))


@query("SELECT vec_id AS entry_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE / 127, 9) AS scale, TRUE AS close FROM embeddings WHERE len(embedding) > 0")
def quantised_vectors(spark, sf_dir):
    """Bytes, scale and length of each vector, and whether every component is within half a scale of its byte's."""
    own, _ = vectors(spark, sf_dir)
    code = F.transform(F.sequence(F.lit(1), F.size("vector")), lambda i: F.conv(F.hex(F.substr("codes", i, F.lit(1))), 16, 10).cast("int"))
    signed = F.transform(code, lambda c: F.when(c > 127, c - 256).otherwise(c))
    off = F.zip_with(signed, "vector", lambda c, x: F.abs(c * F.col("scale") - x) <= F.col("scale") * 0.5000001)
    # In a step of its own: beside a column of its name, the scale within a lambda would be the rounded one.
    both = R.quantised(own).join(own, "entry_id").withColumn("close", F.forall(off, lambda x: x))
    return both.select("entry_id", F.round("norm", 6).alias("norm"), F.round("scale", 9).alias("scale"), "close")


# Fusion asks the vectors of every 50th id and the texts of documents of these ids, against all of either.
VASKED = "(SELECT doc_id AS question_id, text FROM documents WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings))"
VDOCS = "(SELECT doc_id AS entry_id, text FROM documents)"
LEX = f"{O.bm25('h', VDOCS, VASKED, True).strip()}, l AS (SELECT question_id, entry_id, rank, score / greatest(max(score) OVER (PARTITION BY question_id), 1e-6) AS lex FROM {O.best('h', 1500)})"


def fusion_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v, q = vectors(spark, sf_dir)
    entries = docs(spark, sf_dir)
    questions = entries.withColumnRenamed("entry_id", "question_id").filter("question_id % 50 = 0").join(v, F.col("question_id") == v["entry_id"], "left_semi")
    lex = R.normalized(R.bm25_pool(entries, questions, {"text": 1}, R.LEXICAL_POOL, synonyms=True)).withColumnRenamed("score", "lex")
    return lex, R.dense(v, q.join(questions, "question_id", "left_semi"))


FUSED = f"WITH {LEX}, {DENSE}, v AS (SELECT * FROM d WHERE question_id IN (SELECT question_id FROM {VASKED}))"


@query(f"""{FUSED}, s AS (SELECT question_id, entry_id, 0.9 * coalesce(1 / (10.0 + l.rank), 0) + 0.1 * coalesce(1 / (10.0 + v.rank), 0) AS s FROM l FULL JOIN v USING (question_id, entry_id)),
r AS (SELECT question_id, entry_id, round(s / greatest(max(s) OVER (PARTITION BY question_id), 1e-9), 9) AS score FROM s) SELECT question_id, entry_id, round(score, 6) AS score, rank FROM {O.best('r', 20)}""")
def rrf_fusion(spark, sf_dir):
    fused = R.reciprocal_rank(*fusion_inputs(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return R.top(fused, ["question_id"], 20).withColumn("score", F.round("score", 6))


@query(f"""{FUSED}, s AS (SELECT question_id, entry_id, 0.55 * coalesce(lex, 0) + 0.45 * coalesce(dense, 0) AS s FROM l FULL JOIN v USING (question_id, entry_id)),
r AS (SELECT question_id, entry_id, round(s / greatest(max(s) OVER (PARTITION BY question_id), 1e-9), 9) AS score FROM s) SELECT question_id, entry_id, round(score, 6) AS score, rank FROM {O.best('r', 20)}""")
def score_mix_fusion(spark, sf_dir):
    fused = R.score_mix(*fusion_inputs(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return R.top(fused, ["question_id"], 20).withColumn("score", F.round("score", 6))


@query(f"WITH {O.bm25('h', DOCS, ASKED, True).strip()} SELECT question_id, entry_id AS leader, second IS NULL OR score >= 2 * second AS decisive FROM (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rn FROM h WINDOW w AS (PARTITION BY question_id ORDER BY score DESC, entry_id)) WHERE rn = 1")
def decisive_leader(spark, sf_dir):
    hits = R.bm25(docs(spark, sf_dir), asked(spark, sf_dir), {"text": 1}, synonyms=True)
    return R.decisive(hits.withColumnRenamed("score", "lex"))
