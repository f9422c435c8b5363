"""MinHash near-dedup: banded candidates, sequential Bayesian verification of signature batches, exact confirmation, components."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut
from .near_duplicates import SIMILARITY, TOLERANCE, Reading, sketches, texts_of, verified_texts
from .rows import fitting, keep_rows

#: Words of a shingle.
SHINGLE = 2
_GAP = re.compile(rb"[\x20\x09-\x0D]+")


def plain_words(text: str | None) -> list[bytes]:
    """Runs of what isn't ASCII white space, A-Z lower-cased."""
    return [w for w in _GAP.split((text or "").encode("utf-8", "surrogatepass").lower()) if w]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, miss: float = TOLERANCE) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept, text_hash``.

    A text's words are runs of what isn't ASCII white space, A-Z lower-cased; its set is that of its distinct
    ``shingle``-word runs. Documents are linked whose sets have a Jaccard similarity of at least ``similarity``;
    ``component_id`` is the least id that a document reaches over links, and ``kept`` marks it.

    Texts of the same words collapse first. Others meet in buckets of MinHash bands, where their signatures are compared
    a batch of values at a time: after each batch the similarity has a Beta posterior, and a pair goes when the
    probability of reaching the threshold is under ``miss``. What survives is confirmed on full sets, in blocks of linked
    groups, until every group is whole: pairs that confirmed links connect already need none of their own.

    Defined cases: null, empty and word-free texts have an empty set and are linked with nothing; a text of fewer words
    than a shingle is one; null ids come last, so a document with one gets null only if all it reaches have none;
    repeated rows are copies and both kept if theirs is the least id; an empty table gives an empty result; further
    columns are ignored. Ids are longs.
    """
    reading = Reading(plain_words, shingle)
    own = cut(sketches(docs, id_col, text_col, reading).withColumn("row", F.monotonically_increasing_id()))
    texts = cut(texts_of(own))
    found = verified_texts(docs, texts, id_col, text_col, similarity, miss, reading, count=False)
    roots = cut(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = roots.join(texts.select("node", "id"), "node")
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    linked = cut(named.join(least, "root").select("node", "least"))
    whole = texts.filter("sig is not null").join(fitting(linked, 24), "node", "left").filter("docs > 1 or least is not null").select("digest", F.coalesce("least", "id").alias("least"))
    joined = own.select("id", "text_hash", "digest", "n_shingles").join(fitting(cut(whole), 48), "digest", "left")
    component = F.coalesce("least", "id")
    return joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_hash")


def report(docs: DataFrame) -> DataFrame:
    return near_copies(docs).drop("text_hash")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, miss: float = TOLERANCE) -> DataFrame:
    """``docs`` with one row of the least id of each component of ``near_copies``; all columns stay."""
    verdict = near_copies(docs, id_col, text_col, shingle, similarity, miss).select(F.col(id_col).alias("__i"), F.col("text_hash").alias("__h"), "kept")
    return keep_rows(docs, verdict, id_col, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


#: Every pair of documents that share a shingle is counted, so this suits small tables only.
SQL = r"""
WITH RECURSIVE parted AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
spans AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM parted WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g FROM spans),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS MATERIALIZED (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
firsts AS MATERIALIZED (SELECT h, min(doc_id) AS d FROM sets GROUP BY h),
t AS MATERIALIZED (SELECT s.doc_id, s.g, n FROM s JOIN firsts f ON f.d = s.doc_id JOIN sizes z ON z.doc_id = s.doc_id),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT d AS x, d AS y FROM firsts UNION SELECT r.x, e.b FROM reach r JOIN edges e ON e.a = r.y),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, d.doc_id = coalesce(r.root, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN sets h USING (doc_id) LEFT JOIN firsts f ON f.h = h.h LEFT JOIN roots r ON r.x = f.d
"""
