"""Symbol lookup: scores, ambiguity, members, overloads and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X

CONTAINERS = ("class", "interface", "struct", "trait", "enum", "module")


def api_score(exact: Column, quals: Column) -> Column:
    """How well an entry (``kind, name, path, file, doc, legacy``) answers to a symbol with ``quals`` before its name."""
    kind, path, file = F.col("kind"), F.col("path"), F.lower("file")
    segs = F.transform(X.split_symbol(path), F.lower)
    when = lambda test, w: F.when(test, F.lit(w)).otherwise(F.lit(0.0))
    per = F.aggregate(quals, F.lit(0.0), lambda a, q: a + F.when(F.array_contains(segs, q), 3.0).when(file.contains(q), 1.0).otherwise(0.0))
    direct = F.coalesce(F.try_element_at(quals, F.lit(-1)) == F.try_element_at(segs, F.lit(-2)), F.lit(False))
    bare = F.when(F.size(quals) > 0, 0.0).when(kind.isin("method", "field"), -1.5).otherwise(1.5)
    return F.when(exact, 10.0).otherwise(7.0) + bare + per + when(direct, 2.0) + when(F.col("doc") != "", 2.0) - when(X.private_path(F.col("file"), path), 3.0) - when(F.col("legacy"), 5.0) - when(X.tooling_path(F.col("file")), 3.0) - when(kind == "re-export", 0.5) - 0.2 * F.size(segs)


def lookup(entries: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbol, entry_id, score``: entries named like the last segment of each symbol, best first within a symbol."""
    parts = X.split_symbol(F.regexp_replace("symbol", r"(\(\))+$", ""))
    wanted = symbols.select("symbol", parts.alias("p")).select("symbol", F.element_at("p", -1).alias("last"), F.transform(F.slice("p", 1, F.size("p") - 1), F.lower).alias("quals")).withColumn("key", F.lower("last"))
    own = entries.filter("kind <> 'doc'").withColumn("key", F.lower(F.regexp_replace("name", "!+$", "")))
    hits = own.join(wanted, "key").withColumn("score", F.round(api_score(F.regexp_replace("name", "!+$", "") == F.col("last"), F.col("quals")), 6))
    return hits.select("symbol", "package", "entry_id", "score")


def ambiguous(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Whether symbols are ambiguous: several places (package, file, path) and several signatures."""
    own = hits.join(entries, ["package", "entry_id"])
    return own.groupBy("symbol").agg(((F.countDistinct("package", "file", "path") > 1) & (F.countDistinct("sig") > 1)).alias("ambiguous"))


def members(entries: DataFrame, most: int = 80) -> DataFrame:
    """``package, container_id, entry_id, n``: members directly under containers, by an equi-join on the parent's path."""
    inner = entries.filter("kind <> 'doc'").withColumn("up", X.parent(F.col("path"))).filter("up <> ''").select("package", "entry_id", F.col("up").alias("path"))
    outer = entries.filter(F.col("kind").isin(*CONTAINERS)).select("package", F.col("entry_id").alias("container_id"), "path")
    pairs = outer.join(inner, ["package", "path"])
    return pairs.withColumn("n", F.row_number().over(W.partitionBy("package", "container_id").orderBy("entry_id"))).filter(F.col("n") <= most).select("package", "container_id", "entry_id", "n")


def overloads(entries: DataFrame, most: int = 8) -> DataFrame:
    """``package, path, file, sigs``: other declarations of one path in one file."""
    own = entries.filter("kind not in ('doc', 're-export')")
    each = own.withColumn("n", F.row_number().over(W.partitionBy("package", "path", "file").orderBy("entry_id"))).filter(F.col("n").between(2, most + 1))
    return each.groupBy("package", "path", "file").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "sig"))), lambda x: x["sig"]).alias("sigs"))


def resolve_aliases(entries: DataFrame) -> DataFrame:
    """``package, entry_id, target_id``: what re-exports stand for: of the same name, in the same file and documented first, of equals the last."""
    alias = entries.filter("alias_of is not null").select("package", "entry_id", F.col("file").alias("own_file"), F.col("alias_of").alias("name"))
    real = entries.filter("kind not in ('doc', 're-export')").select("package", "name", "file", "doc", F.col("entry_id").alias("target"))
    best = F.max_by("target", F.struct(F.col("file") == F.col("own_file"), F.col("doc") != "", F.col("target")))
    return alias.join(real, ["package", "name"]).groupBy("package", "entry_id").agg(best.alias("target_id"))


def stand_ins(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """``cell, entry_id, real``: what re-exports (``cell, entry_id, file, alias_of``) stand for among the entries of their cell, as ``resolve_aliases`` picks it."""
    told = ["entry_id", "kind", "name", "path", "file", "line", "sig", "doc"]
    aims = entries.filter("kind not in ('doc', 're-export')").select("cell", F.struct(*told).alias("real"))
    pairs = aims.join(hits.withColumnRenamed("file", "own_file").distinct(), (aims["cell"] == hits["cell"]) & (F.col("real.name") == F.col("alias_of"))).drop(aims["cell"])
    return pairs.groupBy("cell", "entry_id").agg(F.max_by("real", F.struct(F.col("real.file") == F.col("own_file"), F.col("real.doc") != "", F.col("real.entry_id"))).alias("real"))
