"""What entrypoints export: names, files and declarations, followed through the module graph of whole packages at once.

All tables are those of ``sources.modules``: ``roots`` (``package, import, conditions, file``), ``modules``, ``exports``,
``imports`` and ``stars``. Loops are semi-naive: each round joins only what the round before added, drops what was
reached already, and is cut, so cycles end and plans stay short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .lineage import cut

#: Longest way over re-exports by which names are told for sure, and rounds of a closure after which chains are passed over.
DEPTH, SHALLOW = 128, 10
#: Rows of a round up to which they are broadcast to the ways on; doubled ways that are followed in one plan.
FEW, LEVELS = 20_000, 4


def name_of(df: DataFrame, column: str = "package") -> Column:
    """The name of a package, which may be a struct with its ecosystem and version, too."""
    kind = df.schema[column.split(".")[-1]].dataType
    return F.col(f"{column}.name") if isinstance(kind, StructType) else F.col(column)


def doubled(edges: DataFrame, most: int | None = None) -> list[DataFrame]:
    """``package, file, target, w, on``, each cut: ways from files that have one way on, apart from dead ends, over up to 1, 2, 4, 8 ... steps (``w``).

    ``on`` tells that the chain goes on there: it doesn't for the longest way of a file, to where the chain ends (a file with another number of ways
    on), but does for chains that go round. Pointers are doubled, so a chain of n files takes log2(n) rounds. With ``most``, rounds end where ways are longer than that.
    """
    step = edges.select("package", "file", "target").distinct()
    onward = step.join(step.select("package", F.col("file").alias("target")).distinct(), ["package", "target"], "left_semi")
    one = onward.groupBy("package", "file").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1").select("package", "file", "target")
    inner = one.select("package", F.col("file").alias("target"), F.lit(True).alias("on"))
    parts = [cut(one.withColumn("w", F.lit(1).cast("long")).join(inner, ["package", "target"], "left").select("package", "file", "target", "w", F.coalesce("on", F.lit(False)).alias("on")))]
    for _ in range((parts[0].count() if most is None else most).bit_length()):
        now = parts[-1]
        if now.filter("on").isEmpty():
            break
        further = now.select("package", F.col("file").alias("target"), F.col("target").alias("far"), F.col("w").alias("more"), F.col("on").alias("still"))
        both = now.join(further, ["package", "target"], "left")
        moves = F.col("on") & F.col("far").isNotNull()
        parts.append(cut(both.select("package", "file", F.when(moves, F.col("far")).otherwise(F.col("target")).alias("target"), (F.col("w") + F.when(moves, F.col("more")).otherwise(0)).alias("w"), F.when(moves, F.col("still")).otherwise(F.col("on")).alias("on"))))
    return parts


def chains(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``package, file, target, w, last``: all ways of ``doubled``.

    ``last`` marks the longest way: to where the chain ends, or, of a chain that goes round, one as long as there are such files.
    With ``most``, the longest way of a file that is further from the end stops within its chain.
    """
    parts = doubled(edges, most)
    marked = [p.select("package", "file", "target", "w", F.lit(n == len(parts) - 1).alias("last")) for n, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, marked)


def reach(start: DataFrame, edges: DataFrame, shallow: int = SHALLOW) -> DataFrame:
    """``start`` (``package, file`` and further columns) and every ``file`` reached over ``edges``: ``closure`` without distances.

    Beyond ``shallow`` rounds a chain is passed over to its end, and its files are marked once at the end: from where it was entered over
    the longest of its doubled ways, from all these over the next shorter ones, and so on. So n files of a chain are n rows, where all ways of all files are n log2(n).
    """
    keys = start.columns
    step = cut(edges.select("package", "file", "target").distinct())
    ways, parts = step, []
    reached = cut(start.select(*keys).distinct().withColumn("fresh", F.lit(True)))
    rounds = 0
    while (n := reached.filter("fresh").count()) > 0:
        rounds += 1
        if rounds == shallow:
            parts = doubled(step)
            ends = parts[-1].select("package", "file", F.when(~F.col("on"), F.col("target")).alias("end"), F.lit(True).alias("inner"))
            # A chain that goes round has no end; all that leads out of it are dead ends.
            apart = step.join(ends.select("package", "file"), ["package", "file"], "left_anti")
            ways = cut(apart.unionByName(ends.filter("end is not null").select("package", "file", F.col("end").alias("target"))))
        fresh = reached.filter("fresh").drop("fresh")
        found = ways.join(F.broadcast(fresh) if n <= FEW else fresh, ["package", "file"]).drop("file").withColumnRenamed("target", "file").select(*keys)
        both = reached.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True)))
        reached = cut(both.groupBy(*keys).agg(F.bool_and("fresh").alias("fresh")))
    reached = reached.drop("fresh")
    if not parts:
        return reached
    for at in range(len(parts) - 1, -1, -LEVELS):
        for k in range(at, max(at - LEVELS, -1), -1):
            there = parts[k].filter(F.col("w") == 1 << k).select("package", "file", F.col("target").alias("far"))
            reached = reached.join(there, ["package", "file"], "left").withColumn("file", F.explode(F.when(F.col("far").isNull(), F.array("file")).otherwise(F.array("file", "far")))).select(*keys)
        reached = cut(reached.distinct())
    return reached.unionByName(reached.join(step, ["package", "file"]).drop("file").withColumnRenamed("target", "file").select(*keys)).distinct()


def closure(start: DataFrame, edges: DataFrame, shallow: int = SHALLOW, passed: DataFrame | None = None) -> DataFrame:
    """``start`` (``package, file`` and further columns, all of which tell starts apart) and every ``file`` reached over ``edges`` (``package, file, target``), with its distance ``d``.

    Rounds go on until nothing new is found, each from what the round before found. Beyond ``shallow`` rounds, ways along
    ``chains`` are taken too, so that deep graphs, which are chains in the main, take about log2(depth) more. Where ``passed`` has them, they are taken from the first.
    """
    keys = [c for c in start.columns if c != "d"]
    ways = edges.select("package", "file", "target", F.lit(1).cast("long").alias("w"))
    ways = ways.distinct() if passed is None else cut(ways.unionByName(passed.select("package", "file", "target", "w")).distinct())
    reached = cut(start.select(*keys).distinct().withColumns({"d": F.lit(0).cast("long"), "fresh": F.lit(True)}))
    rounds = 0
    while True:
        rounds += 1
        if rounds == shallow and passed is None:
            ways = cut(ways.unionByName(chains(edges).select("package", "file", "target", "w")).distinct())
        found = reached.filter("fresh").join(ways, ["package", "file"]).withColumn("d", F.col("d") + F.col("w")).drop("file", "w", "fresh").withColumnRenamed("target", "file").groupBy(*keys).agg(F.min("d").alias("d"))
        both = reached.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True)))
        reached = cut(both.groupBy(*keys).agg(F.min(F.struct("d", "fresh")).alias("e")).select(*keys, "e.*"))
        if reached.filter("fresh").isEmpty():
            return reached.drop("fresh").withColumn("d", F.col("d").cast("int"))


def heights(edges: DataFrame, most: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """``package, file, h``, cut: the longest way on from each file, if it has at most ``most`` steps; files without it go on for longer, or into a cycle.
    And the ``chains`` of at most ``most`` steps.

    Chains are passed over as a whole; what is left is settled from its ends on, a layer a round. A chain of over ``most`` steps is passed over
    to a place within it, for which nothing is ever settled.
    """
    step = edges.select("package", "file", "target").distinct()
    jumps = chains(edges, most)
    ends = cut(jumps.filter("last").select("package", F.col("file").alias("inner"), F.col("target").alias("end"), "w"))
    short = ends.select("package", "inner").withColumnRenamed("inner", "file")
    over = step.join(ends.withColumnRenamed("inner", "target"), ["package", "target"], "left").select("package", "file", F.coalesce("end", "target").alias("target"), (F.coalesce("w", F.lit(0)) + 1).alias("w"))
    left = cut(over.join(short, ["package", "file"], "left_anti").groupBy("package", "file", "target").agg(F.max("w").alias("w")))
    known = cut(step.select("package", F.col("target").alias("file")).distinct().join(step.select("package", "file").distinct(), ["package", "file"], "left_anti").withColumn("h", F.lit(0).cast("long")))
    for _ in range(most + 1):
        at = left.join(known.withColumnRenamed("file", "target"), ["package", "target"], "left").groupBy("package", "file").agg(F.bool_and(F.col("h").isNotNull()).alias("all"), F.max(F.col("h") + F.col("w")).alias("h"))
        new = cut(at.filter(F.col("all") & (F.col("h") <= most)).select("package", "file", "h"))
        if new.isEmpty():
            break
        known, left = cut(known.unionByName(new)), cut(left.join(new.select("package", "file"), ["package", "file"], "left_anti"))
    along = ends.join(known.withColumnRenamed("file", "end"), ["package", "end"]).select("package", F.col("inner").alias("file"), (F.col("h") + F.col("w")).alias("h"))
    return cut(known.unionByName(along.filter(F.col("h") <= most))), jumps.filter(F.col("w") <= most)


def search_files(roots: DataFrame, graph: dict[str, DataFrame]) -> DataFrame:
    """``package, import, file``: files whose declarations an import shows or refers to; all files of a package that exports by path, for its root."""
    named = graph["exports"].unionByName(graph["imports"]).filter("target_file is not null").select("package", "file", F.col("target_file").alias("target"))
    found = reach(roots.select("package", "import", "file"), named.unionByName(graph["stars"])).select("package", "import", "file")
    if "legacy" not in roots.columns:
        return found
    loose = roots.filter(F.col("legacy") & (F.col("import") == name_of(roots))).select("package", "import").distinct()
    return found.unionByName(loose.join(graph["modules"].select("package", "file"), "package").select("package", "import", "file")).distinct()


def offered(roots: DataFrame, graph: dict[str, DataFrame]) -> DataFrame:
    """``package, import, name, file, target_file, target_name, kind``: the names that imports offer, nearest first: an
    entrypoint's own, then those of stars but ``default``."""
    near = closure(roots.select("package", "import", "file"), graph["stars"])
    own = near.join(graph["exports"], ["package", "file"]).filter("d = 0 or name <> 'default'")
    return own.groupBy("package", "import", "name").agg(F.min_by(F.struct("file", "kind", "target_file", "target_name"), F.struct("d", "file")).alias("e")).select("package", "import", "name", "e.*")


def surface(roots: DataFrame, graph: dict[str, DataFrame]) -> DataFrame:
    """``package, import, names``: the names that an import exports, where they are fully known: no module on its way over stars is
    missing, unreadable, assigned as a whole, in a cycle, or over ``DEPTH`` steps away by any way."""
    starts = roots.select("package", "import", F.col("file").alias("root"), "file").distinct()
    told, jumps = heights(graph["stars"])
    tall = starts.join(graph["stars"].select("package", "file").distinct(), ["package", "file"], "left_semi").join(told, ["package", "file"], "left_anti").select("package", "import").distinct()
    # What a file that isn't tall leads to isn't either.
    short = lambda ways: ways.join(told, ["package", "file"], "left_semi")
    deep = not told.filter(F.col("h") > SHALLOW).isEmpty()
    near = closure(starts.join(tall, ["package", "import"], "left_anti"), short(graph["stars"]), passed=short(jumps) if deep else None)
    known = near.join(graph["modules"], ["package", "file"], "left").groupBy("package", "import").agg(F.bool_and(F.coalesce(~F.col("incomplete") & F.col("assignment").isNull(), F.lit(False))).alias("known"))
    names = near.join(graph["exports"].select("package", "file", "name"), ["package", "file"]).filter("d = 0 or name <> 'default'").groupBy("package", "import").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return names.join(known.filter("known"), ["package", "import"], "left_semi")


def canonical(graph: dict[str, DataFrame]) -> DataFrame:
    """``package, file, canonical``: where a chain of modules that only pass on all of one other module ends; those of a chain that never ends are left out.

    Pointers are doubled each round, so a chain of n modules takes about log2(n) rounds.
    """
    whole = graph["modules"].filter(~F.col("incomplete") & F.col("assignment").isNull()).select("package", "file")
    one = graph["stars"].groupBy("package", "file").agg(F.count("*").alias("n"), F.min("target").alias("next")).filter("n = 1").drop("n").join(whole, ["package", "file"], "left_semi")
    one = one.join(graph["modules"].select("package", F.col("file").alias("next")), ["package", "next"], "left_semi")
    via = graph["imports"].filter("kind = 'named'").select("package", "file", F.col("name").alias("target_name"), F.col("target_file").alias("via_file"), F.col("target_name").alias("via_name"))
    kept = graph["exports"].join(via, ["package", "file", "target_name"], "left").join(one, ["package", "file"])
    passes = F.when(F.col("kind") == "named", (F.col("target_file") == F.col("next")) & (F.col("target_name") == F.col("name"))).when(F.col("kind") == "local", (F.col("via_file") == F.col("next")) & (F.col("via_name") == F.col("name"))).otherwise(False)
    own = kept.filter(~F.coalesce(passes & (F.col("name") != "default"), F.lit(False))).select("package", "file").distinct()
    step = one.join(own, ["package", "file"], "left_anti")
    jump = cut(graph["modules"].select("package", "file").join(step, ["package", "file"], "left").select("package", "file", F.coalesce("next", "file").alias("to"), F.col("next").isNull().alias("end")))
    ends = jump.filter("end").select("package", F.col("file").alias("to"))
    for _ in range(max(1, jump.count().bit_length()) + 1):
        if jump.join(ends, ["package", "to"], "left_anti").isEmpty():
            break
        further = jump.select("package", F.col("file").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(further, ["package", "to"]).select("package", "file", F.col("far").alias("to")))
    return jump.join(ends, ["package", "to"], "left_semi").select("package", "file", F.col("to").alias("canonical"))


def compatible_imports(roots: DataFrame, graph: dict[str, DataFrame]) -> DataFrame:
    """``package, import, other``: imports whose prose suits a question about ``import``: itself, one of the same single
    module, and, for a package's root, helpers whose fully known names are disjoint from its own."""
    places = roots.join(canonical(graph), ["package", "file"], "left").groupBy("package", "import").agg(F.bool_and(F.col("canonical").isNotNull()).alias("known"), F.sort_array(F.collect_set("canonical")).alias("files"))
    names = surface(roots, graph).select("package", "import", "names")
    own = cut(places.join(names, ["package", "import"], "left").withColumn("files", F.when(F.col("known"), F.col("files"))).drop("known"))
    there, named = own.filter("files is not null"), own.filter("names is not null")
    alone = there.filter("size(files) = 1").select("package", "import", F.col("files")[0].alias("file"))
    same = alone.join(alone.withColumnRenamed("import", "other"), ["package", "file"]).select("package", "import", "other")
    # Only a package's root has helpers, so its names meet those of each other import once.
    root = named.filter(F.col("files").isNotNull() & (F.col("import") == name_of(named))).select("package", "import", "names")
    apart = root.join(named.select("package", F.col("import").alias("other"), F.col("names").alias("others")), "package").filter(~F.arrays_overlap("names", "others")).select("package", "import", "other")
    return there.select("package", "import", F.col("import").alias("other")).unionByName(same).unionByName(apart).distinct()


def resolve(asked: DataFrame, roots: DataFrame, graph: dict[str, DataFrame], entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Follows symbols from every entrypoint of their package to declarations.

    ``asked``: ``package, symbol``; ``entries``: ``package, entry_id, kind, path, file``. Returns ``found`` (``package,
    symbol, import, conditions, root, entry_id``) and ``open`` (``package, symbol, import, conditions, root``): where
    something on the way is missing, unreadable or too long.
    """
    state = ["package", "symbol", "import", "conditions", "root", "file", "path"]
    group = state[:5]
    now = cut(asked.select("package", "symbol").distinct().join(roots, "package").select("package", "symbol", "import", "conditions", F.col("file").alias("root"), "file", F.col("symbol").alias("path")).distinct())
    seen, declared, lost = now, [now.limit(0).select(*group, "file", "path")], []
    exports = graph["exports"].select("package", "file", "name", F.struct("kind", "target_file", "target_name").alias("e"))
    imports = graph["imports"].select("package", "file", F.col("name").alias("local"), F.struct("kind", "target_file", "target_name").alias("i"))
    modules = graph["modules"].select("package", "file", "incomplete", "assignment", F.lit(True).alias("there"))
    for _ in range(DEPTH):
        if now.isEmpty():
            break
        parted = now.withColumns({"name": F.substring_index("path", ".", 1), "tail": F.when(F.col("path").contains("."), F.expr("substr(path, locate('.', path) + 1)")).otherwise("")})
        at = parted.join(modules, ["package", "file"], "left").join(exports, ["package", "file", "name"], "left")
        whole = F.col("e").isNull() & F.col("assignment").isNotNull()
        inside = F.when(F.col("path").startswith(F.concat("assignment", F.lit("."))), F.col("path")).otherwise(F.concat_ws(".", "assignment", "path"))
        bound = at.withColumn("local", F.when(whole, inside).when(F.col("e.kind") == "local", F.col("e.target_name"))).withColumn("tail", F.when(whole, "").otherwise(F.col("tail")))
        both = cut(bound.join(imports, ["package", "file", "local"], "left").withColumn("b", F.coalesce("i", "e")))
        extended = lambda c: F.concat(c, F.when(F.col("tail") != "", F.concat(F.lit("."), F.col("tail"))).otherwise(""))
        is_local = F.col("local").isNotNull() & F.col("i").isNull()
        lost.append(both.filter("there is null or incomplete").select(*group))
        lost.append(both.filter(~is_local & (F.col("b.kind") == "namespace") & (F.col("tail") == "")).select(*group))
        declared.append(both.filter(is_local).select(*group, "file", extended(F.col("local")).alias("path")))
        onward = both.filter(~is_local & F.col("b").isNotNull() & ((F.col("b.kind") == "named") | (F.col("tail") != "")))
        linked = onward.select(*group, F.col("b.target_file").alias("file"), F.when(F.col("b.kind") == "named", extended(F.col("b.target_name"))).otherwise(F.col("tail")).alias("path"))
        through = both.filter(F.col("e").isNull() & F.col("assignment").isNull() & F.col("there") & (F.col("name") != "default")).join(graph["stars"], ["package", "file"]).select(*group, F.col("target").alias("file"), "path")
        now = cut(linked.unionByName(through).distinct().join(seen, state, "left_anti"))
        seen = cut(seen.unionByName(now))
    lost.append(now.select(*group))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    ends = cut(union(declared).distinct())
    own = entries.filter("kind not in ('doc', 're-export')").select("package", "entry_id", "file", "path")
    met = ends.join(own, ["package", "file", "path"], "left")
    found = cut(met.filter("entry_id is not null").select(*group, "entry_id").distinct())
    return found, cut(union([*lost, met.filter("entry_id is null").select(*group)]).distinct())


def statuses(asked: DataFrame, roots: DataFrame, graph: dict[str, DataFrame], entries: DataFrame, most: int = 8) -> DataFrame:
    """``package, import, symbol, status, entry_ids, alternatives`` of asked symbols (``package, import, symbol``).

    exact: all entrypoints of the import agree; ambiguous: several places and signatures; unresolved: something on the
    way could not be read, or there is no such import; not_exported otherwise. ``alternatives``: up to ``most`` other
    imports that offer the symbol, with the declaration's signature and place.
    """
    found, open_ = resolve(asked, roots, graph, entries)
    meta = entries.select("package", "entry_id", "file", "path", "sig", "line")
    wanted = asked.select("package", "import", "symbol").distinct()
    hits = wanted.join(found, ["package", "import", "symbol"]).join(meta, ["package", "entry_id"])
    seen = hits.groupBy("package", "import", "symbol").agg(F.sort_array(F.collect_set("entry_id")).alias("entry_ids"), ((F.countDistinct("file", "path") > 1) & (F.countDistinct("sig") > 1)).alias("ambiguous"))
    stuck = open_.select("package", "import", "symbol").distinct().withColumn("open", F.lit(True))
    rooted = roots.select("package", "import").distinct().withColumn("rooted", F.lit(True))
    sure = found.join(open_, ["package", "symbol", "import", "conditions", "root"], "left_anti")
    others = wanted.join(sure.withColumnRenamed("import", "offer"), ["package", "symbol"]).filter(F.col("offer") != F.col("import")).join(meta, ["package", "entry_id"]).select("package", "import", "symbol", F.struct("offer", "conditions", "sig", "file", "line").alias("a")).distinct()
    listed_ = others.groupBy("package", "import", "symbol").agg(F.slice(F.sort_array(F.collect_list("a")), 1, most).alias("alternatives"))
    key = ["package", "import", "symbol"]
    whole = wanted.join(seen, key, "left").join(stuck, key, "left").join(rooted, ["package", "import"], "left").join(listed_, key, "left")
    status: Column = F.when(F.coalesce("ambiguous", F.lit(False)), "ambiguous").when(F.coalesce("open", F.lit(False)) | F.col("rooted").isNull(), "unresolved").when(F.col("entry_ids").isNull(), "not_exported").otherwise("exact")
    none = lambda c: F.coalesce(c, F.array())
    return whole.select(*key, status.alias("status"), none(F.col("entry_ids")).alias("entry_ids"), none(F.col("alternatives")).alias("alternatives"))
