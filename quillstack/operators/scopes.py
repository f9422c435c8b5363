"""Which entries may answer a question: import scopes, called APIs, sections around a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import exports, relational


def import_base(path: Column) -> Column:
    """The package of an import path: of ``@a/b/c``, ``@a/b``."""
    return F.regexp_extract(path, r"^(@[^/]+/[^/]+|[^/]+)", 1)


def base_of(path: str) -> str:
    """``import_base`` of a path at hand."""
    return "/".join(path.split("/")[: 2 if path.startswith("@") else 1])


def docs_entries(entries: DataFrame, roots: DataFrame, graph: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """``entries`` (``package, entry_id, kind, path, sig, doc, file, imports``) that suit an import, with ``import``; ``wanted``: ``package, import``.

    Prose suits if all packages' own imports in it are compatible with the wanted one, declarations if its module graph
    reaches their file. Of equal declarations and sections the first counts, once the import is chosen. Packages without
    entrypoints have one scope, all of their entries.
    """
    graphed = roots.select("package").distinct()
    asked = wanted.select("package", "import").distinct()
    files = exports.search_files(roots, graph).join(asked, ["package", "import"], "left_semi")
    pairs = exports.compatible_imports(roots, graph).groupBy("package", "import").agg(F.collect_set("other").alias("others"))
    inside = asked.join(graphed, "package", "left_semi").join(pairs, ["package", "import"], "left").withColumn("others", F.coalesce("others", F.array().cast("array<string>")))
    own = F.filter("imports", lambda i: import_base(i) == exports.name_of(entries))
    prose = entries.filter("kind = 'doc'").join(inside, "package").filter(F.forall(own, lambda i: F.array_contains("others", i))).drop("others")
    code = entries.filter("kind <> 'doc'").join(files, ["package", "file"])
    rest = entries.join(asked.join(graphed, "package", "left_anti"), "package")
    suited = prose.unionByName(code.select(prose.columns)).unionByName(rest.select(prose.columns))
    return relational.first_wins(suited, ["package", "import", "path", "sig", "doc"], ["entry_id"]).select(prose.columns)


def mentions_import(text: Column, path: Column) -> Column:
    """Whether a text names an import path as a whole module token; a full stop may end it."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}@/_.-])\Q"), path, F.lit(r"\E(?:(?![\p{L}\p{N}@/_.-])|\.(?![\p{L}\p{N}@/_.-]))"))
    return F.regexp(text, quoted)


#: What a module token in a text is made of.
_TOKEN = r"[\p{L}\p{N}@/_.-]"


def wanted_imports(questions: DataFrame, packages: DataFrame, roots: DataFrame) -> DataFrame:
    """``question_id, package, import``: imports that a question names of a package that it searches (``packages``: ``question_id, package``), else the package's root.

    A question's module tokens, with and without a full stop at the end, meet imports by equality; only imports with
    other characters are looked for one by one (``mentions_import``).
    """
    own = roots.select("package", "import").distinct()
    tokens = F.regexp_extract_all("text", F.lit(f"({_TOKEN}+)"), 1)
    both = F.array_distinct(F.concat(tokens, F.transform(tokens, lambda t: F.regexp_replace(t, r"\.$", ""))))
    told = questions.select("question_id", F.explode(both).alias("import")).join(packages, "question_id")
    odd = own.filter(~F.col("import").rlike(f"^{_TOKEN}+$"))
    searched = packages.join(odd, "package").join(questions.select("question_id", "text"), "question_id").filter(mentions_import(F.col("text"), F.col("import")))
    named = told.join(own, ["package", "import"]).select("question_id", "package", "import").unionByName(searched.select("question_id", "package", "import"))
    named = named.filter(F.col("import") != exports.name_of(named)).distinct()
    rest = packages.join(named.select("question_id", "package").distinct(), ["question_id", "package"], "left_anti").withColumn("import", exports.name_of(packages))
    return named.unionByName(rest.select("question_id", "package", "import"))


def called(text: Column) -> Column:
    """Names that are called in a text: what stands right before a ``(``, whole."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_$.:/@-]+)\("), 1))


def public_calls(questions: DataFrame, wanted: DataFrame, roots: DataFrame, graph: dict[str, DataFrame], entries: DataFrame) -> DataFrame:
    """``question_id, package, entry_id``: declarations that a question calls by name or path and that the import it asks about exports without doubt.

    ``wanted``: ``question_id, package, import``. A name counts only if all entrypoints of the import lead to the same declarations.
    """
    calls = questions.select("question_id", F.explode(called(F.col("text"))).alias("symbol"))
    known = entries.filter("kind <> 'doc'").select("package", F.explode(F.array("name", "path")).alias("symbol")).distinct()
    asked = calls.join(wanted, "question_id").join(known, ["package", "symbol"])
    found, open_ = exports.resolve(asked.select("package", "symbol").distinct(), roots, graph, entries)
    group = ["package", "symbol", "import"]
    places = found.groupBy(*group, "conditions", "root").agg(F.sort_array(F.collect_set("entry_id")).alias("ids"))
    n = roots.select("package", "import", "conditions", F.col("file").alias("root")).distinct().groupBy("package", "import").agg(F.count("*").alias("n"))
    agreed = places.groupBy(*group).agg(F.count("*").alias("m"), F.collect_set("ids").alias("sets")).join(n, ["package", "import"]).filter("m = n and size(sets) = 1").join(open_.select(*group).distinct(), group, "left_anti")
    return asked.join(agreed.select(*group, F.col("sets")[0].alias("ids")), group).select("question_id", "package", F.explode("ids").alias("entry_id")).distinct()


def lead(doc: Column, most: int = 320) -> Column:
    """The first paragraph of a section's text, on one line; empty where code comes first."""
    lines = F.transform(F.split(doc, "\n"), F.trim)
    plain = F.filter(lines, lambda t: ~t.rlike("^<.*>$"))
    body = F.array_join(plain, "\n")
    first = F.regexp_extract(F.regexp_replace(body, r"^\n+", ""), r"(?s)^(.*?)(?:\n\n|$)", 1)
    joined = F.regexp_replace(F.split(first, r"(?m)^(```|~~~)")[0], "\n", " ")
    text = F.trim(F.when(F.regexp(first, F.lit(r"^(```|~~~)")), "").otherwise(joined))
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def context(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """``hits`` (``question_id, package, entry_id``, and the ``cell`` that both are in, if any) that are sections, with ``context``: the leads of their page and of the closest section above, each on a quoted line.

    ``entries`` is the scope of the question: an ancestor outside of it isn't quoted; neither is one that says little or
    nothing else than the section does. Ancestors meet sections by (package, file, line).
    """
    within = [c for c in ("cell", "package") if c in hits.columns and c in entries.columns]
    prose = entries.filter("kind = 'doc'")
    ends = F.array_distinct(F.array(F.element_at("parents", 1), F.element_at("parents", -1)))
    own = hits.join(prose.select(*within, "entry_id", "file", "doc", "parents"), [*within, "entry_id"]).filter(F.size("parents") > 0)
    each = own.select("question_id", *within, "entry_id", "file", "doc", F.posexplode(ends).alias("k", "line"))
    above = relational.first_wins(prose.select(*within, "file", "line", "entry_id", lead(F.col("doc")).alias("lead")), [*within, "file", "line"], ["entry_id"]).drop("entry_id")
    told = each.join(above, [*within, "file", "line"]).filter((F.length("lead") >= 20) & ~F.col("doc").contains(F.col("lead")))
    line = F.concat(F.lit("> line "), F.col("line").cast("string"), F.lit(": "), "lead")
    once = told.withColumn("before", F.first("lead").over(W.partitionBy("question_id", *within, "entry_id").orderBy("k"))).filter((F.col("lead") == F.col("before")) & (F.col("k") == 0) | ~F.col("before").contains(F.col("lead")))
    return once.groupBy("question_id", *within, "entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("t")))), lambda e: e["t"]), "\n").alias("context"))
