"""Relational building blocks of the engine: first-wins, priorities, caps, running budgets, picks and grades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .lineage import cut, fitting


#: Share of the best score under which a result is too weak to be shown.
SHARE = 0.3


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row of each key that comes first by ``order`` (total within a key); combines before the shuffle, so a hot key is cheap."""
    ranks = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[r.alias(f"o{i}") for i, r in enumerate(ranks)])).alias("__best"))
    return best.select(*keys, "__best.*").select(*df.columns)


def cap(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """At most ``k`` rows of each key, the first by ``order``, with their 1-based ``n``."""
    return df.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= k)


def pack_budget(ranked: DataFrame, key: str, order: list[Column], text: str, budget: int) -> DataFrame:
    """Rows of each key, in order, while their estimated tokens (ceil(chars / 3) + 1 each) fit a budget; then none.

    Adds ``used``, the tokens up to and with the row.
    """
    cost = F.ceil(F.length(text) / 3) + 1
    window = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(cost).over(window)).filter(F.col("used") <= budget)


def pack_blocks(ranked: DataFrame, key: str, order: list[Column], block: str, budget: int, ahead: Column | None = None, made: Column | None = None) -> DataFrame:
    """Blocks of text of each key, in order, while they fit a token budget (a third of the characters, rounded up, and one for each block).

    The first that doesn't fit is cut at the end of a line if over 120 tokens are left, and nothing follows; an open code
    fence is closed. ``ahead`` counts characters that stand before the first block. Adds ``trimmed``.
    A ``block`` that is ``made`` of other columns is made before rows are shuffled for its length, and again of those that are kept; no text is shuffled or sorted.
    """
    ranked = ranked.withColumn("__size", F.length(F.col(block) if made is None else made))
    window = W.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.sum(F.col("__size") + 1).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + (F.lit(0) if ahead is None else ahead)
    left = F.greatest(F.lit(budget) - F.ceil(before / 3), F.lit(0))
    sized = ranked.withColumn("__left", left).withColumn("trimmed", F.ceil(F.col("__size") / 3) + 1 > F.col("__left"))
    missed = F.coalesce(F.max(F.col("trimmed").cast("int")).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def grow(acc: Column, line: Column) -> Column:
        fits = acc["open"] & (F.length(acc["t"]) + F.length(line) + 1 <= F.col("__left") * 3)
        return F.when(fits, F.struct(F.concat(acc["t"], line, F.lit("\n")).alias("t"), (acc["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(acc["t"].alias("t"), acc["n"].alias("n"), F.lit(False).alias("open")))

    kept = sized.withColumn("__missed", missed).filter((F.col("__missed") == 0) & (~F.col("trimmed") | (F.col("__left") > 120)))
    kept = kept if made is None else kept.withColumn(block, made)
    cut_ = kept.withColumn("__cut", F.when(F.col("trimmed"), F.aggregate(F.split(block, "\n"), start, grow)))
    fence = F.when(F.regexp_count(F.col("__cut.t"), F.lit("```")) % 2 == 1, F.lit("```\n")).otherwise(F.lit(""))
    shown = F.when(F.col("trimmed"), F.concat("__cut.t", fence, F.lit("[cut to fit the budget]\n"))).otherwise(F.col(block))
    return cut_.filter(~F.col("trimmed") | (F.col("__cut.n") > 1)).withColumn(block, shown).drop("__size", "__left", "__missed", "__cut")


def relevance_floor(ranked: DataFrame, key: str, order: list[Column], score: str = "score", least: int = 3, share: float = SHARE) -> DataFrame:
    """Stops at the first row beyond ``least`` whose score is under ``share`` of the first row's."""
    ordered = W.partitionBy(key).orderBy(*order)
    weak = (F.row_number().over(ordered) > least) & (F.col(score) < share * F.first(score).over(ordered))
    flagged = ranked.withColumn("__weak", weak.cast("int"))
    stopped = F.max("__weak").over(ordered.rowsBetween(W.unboundedPreceding, 0))
    return flagged.withColumn("__weak", stopped).filter("__weak = 0").drop("__weak")


def running_include(files: DataFrame, key: str, path: str, size: str, most_files: int, most_bytes: int) -> DataFrame:
    """Files of each key by path that a size budget admits: one that would exceed it is skipped, later ones may fit.

    In rounds, for all keys at once: what comes before a key's first file that doesn't fit is in, and of what comes after
    it files that exceed the budget that is left are out for good, as it only shrinks. A round either at least halves
    that budget or drops a file of more than half of it.
    """
    slim = files.select(key, path, F.col(size).cast("long").alias(size))
    order = W.partitionBy(key).orderBy(path, size, "__row").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(key)
    left = cut(slim.filter(F.col(size) <= most_bytes).withColumns({"__left": F.lit(most_bytes).cast("long"), "__row": F.monotonically_increasing_id()}))
    parts = [left.limit(0).select(key, path, size, "__row")]
    while not left.isEmpty():
        over = left.withColumn("__run", F.sum(size).over(order)).withColumn("__out", F.max((F.col("__run") > F.col("__left")).cast("int")).over(order) == 1)
        used = over.withColumn("__used", F.coalesce(F.max(F.when(~F.col("__out"), F.col("__run"))).over(whole), F.lit(0)))
        done = cut(used)
        parts.append(done.filter(~F.col("__out")).select(key, path, size, "__row"))
        rest = F.col("__left") - F.col("__used")
        left = cut(done.filter(F.col("__out") & (F.col(size) <= rest)).select(key, path, size, "__row", rest.alias("__left")))
    first = W.partitionBy(key).orderBy(path, size, "__row")
    return reduce(DataFrame.unionByName, parts).withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= most_files).select(key, path, size)


def index_pick(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """By key, a column for each of ``shares``: the value at index int(share * n) of the sorted values, without interpolation.

    Equal values are counted first; the counts are dealt into ranges, and only the ranges that hold a wanted index are
    ordered, so that no task sorts all values of a key. Null values are passed over.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    parts = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = cut(counts.repartitionByRange(parts, *keys, "__v").withColumn("__part", F.spark_partition_id()))
    renamed = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    whole = W.partitionBy(*[f"__k{i}" for i in range(len(keys))])
    sizes = dealt.groupBy(*renamed, F.col("__part").alias("__p")).agg(F.sum("__n").alias("__size"))
    upto = sizes.withColumn("__upto", F.sum("__size").over(whole.orderBy("__p"))).withColumn("__all", F.sum("__size").over(whole))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.col("__all") * share).alias("at")) for name, share in shares.items()])
    wanted = upto.withColumn("__w", F.explode(asked)).filter((F.col("__w.at") < F.col("__upto")) & (F.col("__w.at") >= F.col("__upto") - F.col("__size")))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__part") == F.col("__p"))
    near = dealt.join(fitting(cut(wanted)), same)
    seen = F.sum("__n").over(W.partitionBy(*keys, "__part", "__w.name").orderBy("__v")) + F.col("__upto") - F.col("__size")
    found = near.withColumn("__seen", seen).filter((F.col("__w.at") < F.col("__seen")) & (F.col("__w.at") >= F.col("__seen") - F.col("__n")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__w.name") == name, F.col("__v"))).alias(name) for name in shares])


def grade(answers: DataFrame) -> DataFrame:
    """Adds ``passed``: every group of ``expect`` (array of arrays) has a hit in ``answer`` and no ``reject`` occurs, without case."""
    has = lambda s: F.lower("answer").contains(F.lower(s))
    return answers.withColumn("passed", F.forall("expect", lambda g: F.exists(g, has)) & ~F.exists("reject", has))


def html_headings(pages: DataFrame) -> DataFrame:
    """``page_id, n, level, heading``: headings of HTML pages in order, without inner tags and with single spaces."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"), 0)
    each = pages.select("page_id", F.posexplode(found).alias("n", "raw"))
    level = F.regexp_extract("raw", r"(?i)^<h([1-6])", 1).cast("int")
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", ""), r"\s+", " "))
    return each.select("page_id", "n", level.alias("level"), text.alias("heading"))


def resolve_status(deps: DataFrame, sources: DataFrame) -> DataFrame:
    """``deps`` with ``status``: ready (the exact version is there), drift (only ``found``, another one), or missing.

    ``sources``: ``eco, norm_name, version, priority``; of several the exact version wins, then the least priority.
    """
    both = deps.join(sources.select("eco", "norm_name", F.col("version").alias("__v"), "priority"), ["eco", "norm_name"], "left")
    exact = F.col("__v") == F.col("version")
    best = both.groupBy(*deps.columns).agg(F.min_by(F.struct(F.col("__v").alias("v"), exact.alias("e")), F.struct((~exact).alias("drift"), "priority", "__v")).alias("b"))
    return best.select(*deps.columns, F.when(F.col("b.v").isNull(), "missing").when(F.col("b.e"), "ready").otherwise("drift").alias("status"), F.col("b.v").alias("found"))


def tag_for(packages: DataFrame, refs: DataFrame) -> DataFrame:
    """The ref that a package version is tagged with: ``v<version>``, then the version, then ``<name>@``, ``<name>-v`` and ``<name>-``; peeled ids first.

    ``packages``: ``name, version``; ``refs``: ``ref, oid, peeled``.
    """
    v = F.col("version")
    base = F.regexp_extract("name", r"([^/]*)$", 1)
    candidates = F.array(F.concat(F.lit("v"), v), v, F.concat("name", F.lit("@"), v), F.concat(base, F.lit("@"), v), F.concat(base, F.lit("-v"), v), F.concat(base, F.lit("-"), v))
    each = packages.select("name", "version", F.posexplode(candidates).alias("priority", "ref"))
    return each.join(refs, "ref").groupBy("name", "version").agg(F.min_by(F.struct("ref", "oid"), F.struct("priority", (~F.col("peeled")).alias("p"), "oid")).alias("b")).select("name", "version", "b.ref", "b.oid")
