"""The engine over index tables: resolve, docs, overview, api and upgrade, for one question or a batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import exports, packages, relational, retrieval, scopes, symbols, upgrade
from ..operators.lineage import cut, fitting
from ..sources import markdown, pages
from ..sources import symbols as extract
from ..sources.files import content_stamps
from .index import Index, Snapshot

#: Weights of the columns of ``with_fields`` in the body and in the heading index.
BODY = {"f_name": 8, "f_head": 6, "f_summary": 4, "f_path": 2, "f_prose": 2, "f_sig": 1, "f_code": 1, "f_file": 1}
HEAD = {"f_topic": 2, "f_first": 1}
MIN_TOKENS, MAX_TOKENS, DEFAULT_TOKENS = 200, 20_000, 1200
#: Characters of the first result's text, of others', of a context that lessens the first, of a README block; names in an overview and README blocks.
FIRST, OTHERS, CONTEXT, README, NAMES, BLOCKS = 2000, 800, 800, 1500, 60, 3


def with_fields(entries: DataFrame) -> DataFrame:
    """Adds the columns that are searched: a symbol's name, path, signature and first sentence, a section's headings below
    its page's and its file, and of both the prose and the code; ``f_topic`` is the last heading that says something, or the name."""
    fence = r"(?s)```[^\n]*\n(.*?)```"
    heads = F.split("name", " › ")
    last = F.element_at(heads, -1)
    general = F.lower(F.regexp_replace(F.trim(last), ":+$", "")).isin(*retrieval.GENERIC_HEADINGS) & (F.size(heads) > 1)
    prose = F.regexp_replace("doc", fence, " ")
    first = F.left(F.regexp_extract(F.ltrim(prose), r"(?s)^(.*?)(?:[.!?](?:\s|$)|\n\n|$)", 1), F.lit(300))
    section = F.col("kind") == "doc"
    return entries.withColumns({
        "f_name": F.when(~section, F.col("name")), "f_head": F.when(section, F.array_join(F.slice(heads, F.lit(2), F.size(heads)), " ")), "f_summary": F.when(~section, first), "f_path": F.when(~section, F.col("path")),
        "f_prose": prose, "f_sig": F.col("sig"), "f_code": F.array_join(F.regexp_extract_all("doc", F.lit(fence), 1), "\n"), "f_file": F.when(section, F.col("file")), "f_first": first,
        "f_topic": F.when(section, F.when(general, F.try_element_at(heads, F.lit(-2))).otherwise(last)).otherwise(F.col("name")),
    })


def embed_text(entries: DataFrame) -> Column:
    """What an entry's vector is made of: its heading or name and the start of its prose, or of its code or signature where it has none. Needs ``with_fields``."""
    section = F.col("kind") == "doc"
    body = F.left("f_prose", F.lit(600))
    instead = F.when(section, F.left("f_code", F.lit(600))).otherwise(F.left("sig", F.lit(200)))
    tail = F.array_join(F.slice(F.split("name", " › "), -F.least(F.lit(2), F.size(F.split("name", " › "))), 2), " ")
    name = F.when(section, tail).otherwise(F.concat_ws(" ", "name", F.regexp_extract("path", r"([^.:]*)[.:]+[^.:]*$", 1)))
    return F.concat(name, F.lit(". "), F.when(F.trim(body) == "", instead).otherwise(body))


def identified(entries: DataFrame) -> DataFrame:
    """``entries`` whose ``package`` is the exact one: a struct ``eco, name, version``. Entries without an ecosystem are npm's."""
    eco = F.col("eco") if "eco" in entries.columns else F.lit("npm")
    return entries.withColumn("package", F.struct(eco.alias("eco"), F.col("package").alias("name"), F.col("version").alias("version")))


def flat(rows: DataFrame) -> DataFrame:
    """``rows`` with ``eco, package, version`` in place of the exact package."""
    return rows.withColumns({"eco": F.col("package.eco"), "version": F.col("package.version"), "package": F.col("package.name")})


def package_id(package: Column) -> Column:
    return F.concat(package["name"], F.lit("@"), package["version"])


def rendered(most: Column) -> Column:
    """A result with its place: heading, signature and text, of at most ``most`` characters. Needs an ``identified`` package."""
    place = F.concat(F.lit(" — "), package_id(F.col("package")), F.lit(" "), "file", F.lit(":"), F.col("line").cast("string"))
    doc = F.when(F.length("doc") > most, F.concat(F.left("doc", most), F.lit("…"))).otherwise(F.col("doc"))
    section = F.concat(F.lit("### "), "name", place, F.lit("\n"), F.coalesce(F.concat("context", F.lit("\n\n")), F.lit("")), doc, F.lit("\n"))
    symbol = F.concat(F.lit("### "), "path", F.lit(" ("), "kind", F.lit(")"), place, F.lit("\n```\n"), "sig", F.lit("\n```\n"), F.when(F.col("doc") == "", "").otherwise(F.concat(doc, F.lit("\n"))))
    return F.when(F.col("kind") == "doc", section).otherwise(symbol)


@dataclass
class Engine:
    """Tables: ``deps`` (rows of ``lockfiles.dependencies``), ``sources`` and ``entries`` (rows of ``build_index``).

    A package is told by its ecosystem, name and exact version throughout: a question is answered from the versions that
    the project pins, whatever else is indexed. Optional: ``vectors`` (``entry_id, vector``), ``indexed`` (the ``Snapshot``
    that the entries are from, or ``terms.vectors`` of them; else each batch of questions makes one pass over the entries
    in scope), and for npm packages the entrypoints (``roots``) and module graph (``graph``) of ``sources.modules``, with a
    ``version`` where several versions of a package have them.
    """

    spark: SparkSession
    deps: DataFrame
    sources: DataFrame
    entries: DataFrame
    vectors: DataFrame | None = None
    body: dict[str, int] = field(default_factory=lambda: dict(BODY))
    head: dict[str, int] = field(default_factory=lambda: dict(HEAD))
    indexed: DataFrame | Snapshot | None = None
    roots: DataFrame | None = None
    graph: dict[str, DataFrame] | None = None

    @staticmethod
    def build_index(files: DataFrame, versions: DataFrame, by_file: bool = False) -> DataFrame:
        """Entries of package files (``package, file, how, text``): sections of prose, component pages, examples and modules' own docs, and symbols of sources, with fields to search.

        ``imports`` and ``parents`` say which packages a section's code imports and where the sections above it begin.
        """
        prose = markdown.sections(files.filter("how in ('prose', 'metadata')")).unionByName(pages.sections(files)).unionByName(extract.module_docs(files))
        kept = prose.select("package", "file", "line", F.lit("doc").alias("kind"), "name", F.col("name").alias("path"), F.lit("").alias("sig"), "doc", F.lit(None).cast("string").alias("alias_of"), "imports", "parents")
        own = extract.symbols(files).withColumns({"imports": F.array().cast("array<string>"), "parents": F.array().cast("array<int>")})
        return with_fields(extract.entries(kept.unionByName(own), versions, by_file))

    @staticmethod
    def write_index(entries: DataFrame, path: str, body: dict[str, int] | None = None, head: dict[str, int] | None = None) -> int:
        """``Index.write``: replaces the exact versions of packages in ``entries``, entries and posting lists; others stay."""
        return Index(entries.sparkSession, path).write(entries, body or BODY, head or HEAD)

    @staticmethod
    def refresh(files: DataFrame, versions: DataFrame, path: str, body: dict[str, int] | None = None, head: dict[str, int] | None = None) -> int:
        """Brings an index up to date with package files (``package, file, how, text``) and ``versions`` (``eco, package, version``): only packages whose
        files hold something else than when they were written are extracted. The snapshot's number, the same as before if nothing changed."""
        index = Index(files.sparkSession, path)
        stamps = versions.select("eco", "package", "version").join(content_stamps(files), "package")
        stale = cut(index.stale(stamps.select("eco", "package", "version", "stamp")))
        if stale.isEmpty():
            return index.at().number
        entries = Engine.build_index(files.join(fitting(stale.select("package").distinct()), "package", "left_semi"), stale.select("eco", "package", "version"))
        return index.write(entries, body or BODY, head or HEAD, stale)

    @staticmethod
    def read_index(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
        """The entries of the latest snapshot, or of an earlier one."""
        return Index(spark, path).at(number).entries()

    @staticmethod
    def open(spark: SparkSession, path: str, deps: DataFrame, sources: DataFrame, number: int | None = None, **more) -> Engine:
        """An engine over a snapshot of written index tables, whose posting lists answer its questions."""
        snapshot = Index(spark, path).at(number)
        return Engine(spark, deps, sources, snapshot.entries(), indexed=snapshot, **more)

    def resolve(self, filter: str | None = None) -> DataFrame:  # noqa: A002
        """Pinned dependencies with the state of their docs; a filter also searches indirect ones."""
        chosen = self.deps.filter("direct") if not filter else self.deps.filter(F.lower("name").contains(filter.lower()))
        return relational.resolve_status(chosen.select("eco", "name", "norm_name", "version", "direct"), self.sources)

    def own(self) -> DataFrame:
        return identified(self.entries)

    def there(self) -> DataFrame:
        """``package`` (exact) of all that is indexed."""
        return self.own().select("package").distinct()

    def picked(self, package: str) -> list[tuple[str, str, str, str | None]]:
        """``eco, name, version, import`` of each specification in a comma-joined list (``name``, ``eco:name``, ``name@version``, of npm ``name/sub``).

        The version that the project pins is meant, if it fits; else an indexed one that the specification names exactly,
        or the only one that fits of a package that the project doesn't have. What can't be told raises a ``LookupError``
        that says what there is.
        """
        out = []
        for text in filter(None, (p.strip() for p in package.split(","))):
            asked = packages.Spec.parse(text)
            base = packages.Spec(asked.eco, scopes.base_of(asked.name), asked.version)
            pinned = [] if self.deps is None else packages.find(self.deps, asked).limit(2).collect() or packages.find(self.deps.filter("eco = 'npm'"), base).limit(2).collect()
            fits = [r for r in pinned if r["fits"]]
            if fits:
                chosen = (fits[0]["eco"], fits[0]["name"], fits[0]["version"])
            else:
                rows = self.there().select("package.*")
                meant = rows.filter((asked.names(F.col("eco"), F.col("name")) | base.names(F.col("eco"), F.col("name")) & (F.col("eco") == "npm")) & asked.fits(F.col("version")))
                some = sorted((r["eco"], r["name"], r["version"]) for r in meant.limit(9).collect())
                exact = [s for s in some if asked.exact() and s[2].lstrip("v") == asked.version]
                if pinned and not exact:
                    raise LookupError(f"this project pins {pinned[0]['name']} {pinned[0]['version']}, which does not match `{text}`")
                if not some:
                    raise LookupError(self.unknown(asked.name))
                if not exact and len(some) > 1:
                    raise LookupError(f"`{text}` is not pinned here, and several are indexed: {', '.join(f'{e}:{n}@{v}' for e, n, v in some)}")
                chosen = (exact or some)[0]
            inner = asked.name if chosen[0] == "npm" and asked.name != base.name and not asked.name == chosen[1] else None
            if inner and self.roots is not None and self.exact(self.roots).filter((F.col("package.name") == chosen[1]) & (F.col("package.version") == chosen[2]) & (F.col("import") == inner)).isEmpty():
                raise LookupError(f"`{inner}` has no public declaration entrypoint in {chosen[1]}@{chosen[2]}")
            out.append((*chosen, inner))
        return out

    def unknown(self, name: str) -> str:
        """What to say of a package that is neither pinned nor indexed: names near it, if there are any."""
        near = [] if self.deps is None else [r["id"] for r in packages.similar(self.deps, self.spark.createDataFrame([(name,)], "asked string")).orderBy("n").collect()]
        return f"`{name}` is not a dependency here" + (f"; did you mean {', '.join(near)}?" if near else "")

    def exact(self, rows: DataFrame) -> DataFrame:
        """A table of npm packages (``package``, and ``version``, if known) by their exact ones; without a version, those of every indexed one."""
        there = self.there().filter("package.eco = 'npm'").select(F.col("package").alias("__p"))
        same = F.col("package") == F.col("__p.name")
        if "version" in rows.columns:
            same = same & (F.col("version") == F.col("__p.version"))
        return rows.join(F.broadcast(there) if there.count() <= 100_000 else there, same).withColumn("package", F.col("__p")).drop("__p", "version")

    def modules(self) -> tuple[DataFrame, dict[str, DataFrame]]:
        return self.exact(self.roots), {k: self.exact(v) for k, v in self.graph.items()}

    def select(self, questions: DataFrame, package: str | None = None) -> DataFrame:
        """``question_id, package, import, broad``: what each question searches: the packages (or, of npm, imports like ``name/sub``)
        that ``package`` lists, else those that it mentions, else all direct ones, in the versions that the project pins; an
        import that it names narrows a search of its package. Packages that aren't indexed are among them (``provenance``)."""
        exact = F.struct("eco", "name", "version").alias("package")
        if package:
            chosen = self.spark.createDataFrame(self.picked(package), "eco string, name string, version string, asked string").select(exact, "asked")
            own = questions.select("question_id").crossJoin(F.broadcast(chosen)).withColumn("broad", F.lit(False))
        else:
            own = packages.choose(questions, self.deps).select("question_id", exact, F.lit(None).cast("string").alias("asked"), "broad")
        if self.roots is None:
            return own.select("question_id", "package", F.coalesce("asked", "package.name").alias("import"), "broad")
        free = own.filter("asked is null").select("question_id", "package").distinct()
        named = scopes.wanted_imports(questions, free, self.modules()[0]).join(own.select("question_id", "package", "broad").distinct(), ["question_id", "package"])
        return named.select("question_id", "package", "import", "broad").unionByName(own.filter("asked is not null").select("question_id", "package", F.col("asked").alias("import"), "broad"))

    def provenance(self, questions: DataFrame, package: str | None = None) -> DataFrame:
        """``question_id, broad, searched, missing``: ids of the packages that answer each question, and of those that it needs but that aren't indexed."""
        chosen = self.select(questions, package).select("question_id", "package", "broad").distinct()
        known = chosen.join(self.there().withColumn("there", F.lit(True)), "package", "left")
        listed = lambda test: F.sort_array(F.collect_set(F.when(test, F.concat("package.eco", F.lit(":"), package_id(F.col("package"))))))
        return known.groupBy("question_id").agg(F.bool_or("broad").alias("broad"), listed(F.col("there")).alias("searched"), listed(F.col("there").isNull()).alias("missing"))

    def places(self, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What questions search as cells: ``cells`` (``question_id, scope, cell``), and each cell's ``package`` and ``import``s. A cell is a package with
        certain imports; questions of the same cells share a scope."""
        imports = F.sort_array(F.collect_set("import"))
        per = chosen.groupBy("question_id", "package").agg(imports.alias("imports")).withColumn("cell", F.xxhash64("package", "imports"))
        scope = per.groupBy("question_id").agg(F.xxhash64(F.sort_array(F.collect_set("cell"))).alias("scope"))
        per = cut(per.join(scope, "question_id"))
        return per.select("question_id", "scope", "cell"), cut(per.select("cell", "package", F.explode("imports").alias("import")).distinct())

    def within(self, places: DataFrame) -> DataFrame:
        """Entries of cells, each with its ``cell``: all of a package, or those that suit its imports."""
        wanted = places.select("cell", "package").distinct()
        if self.roots is None:
            return self.own().join(fitting(wanted), "package")
        roots, graph = self.modules()
        inside = self.own().join(fitting(wanted.select("package").distinct()), "package", "left_semi")
        suited = scopes.docs_entries(inside, roots, graph, places.select("package", "import"))
        return cut(suited.join(fitting(places), ["package", "import"]).drop("import").dropDuplicates(["cell", "entry_id"]))

    def postings(self, own: DataFrame) -> DataFrame | Callable[[DataFrame], retrieval.Postings] | None:
        """Written posting lists of the cells, by the terms that are asked for."""
        if isinstance(self.indexed, Snapshot):
            snapshot, plain = self.indexed, own.withColumn("package", F.col("package.name"))
            return lambda q: snapshot.postings(plain, q)
        return None if self.indexed is None else self.indexed.drop("package", "version", "eco").join(own.select("cell", "entry_id"), "entry_id")

    def docs(self, questions: DataFrame, package: str | None = None, tokens: int = DEFAULT_TOKENS, query_vectors: DataFrame | None = None) -> DataFrame:
        """Ranked blocks for each question (``question_id, text``), as many as a token budget holds; for an empty one, an overview of its packages.

        All questions are ranked in one plan, each among the exact packages and imports that it searches, with the statistics
        of these. APIs that a question calls come first; a re-export is shown as what it stands for; the first block quotes
        the page and section that it is in. The result stops at weak matches once three good ones are in; the block that
        crosses the budget is cut.
        """
        budget = min(max(tokens, MIN_TOKENS), MAX_TOKENS)
        chosen = cut(self.select(questions, package))
        blank = F.trim(F.coalesce("text", F.lit(""))) == ""
        answered = self.answer(questions.filter(~blank), chosen, budget, query_vectors)
        if questions.filter(blank).isEmpty():
            return answered
        over = flat(self.overview_of(chosen.join(questions.filter(blank).select("question_id"), "question_id", "left_semi")))
        lines = F.array(F.concat("package", F.lit("@"), "version", F.lit(" · "), "eco", F.lit("\nIndexed "), F.col("n_symbols").cast("string"), F.lit(" API symbols and "), F.col("n_sections").cast("string"), F.lit(" doc sections.\n"), F.when(F.size("symbols") > 0, F.concat(F.lit("Key API: "), F.array_join("symbols", ", "), F.lit("\n"))).otherwise("")))
        each = over.select("question_id", "eco", "package", "version", F.posexplode(F.concat(lines, F.coalesce("blocks", F.array().cast("array<string>")))).alias("k", "rendered"))
        ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy("eco", "package", "version", "k")) - 1).drop("k")
        return answered.unionByName(relational.pack_blocks(ranked, "question_id", [F.col("rank")], "rendered", budget), allowMissingColumns=True)

    def ranked(self, questions: DataFrame, chosen: DataFrame, query_vectors: DataFrame | None = None, wanted: retrieval.Wanted | None = None) -> tuple[DataFrame, DataFrame]:
        """``question_id, cell, package, entry_id, score, called`` of questions, and the entries that they search. What is ``wanted`` counts where nothing can be called."""
        return self.ranked_in(*self.searched(chosen), questions, chosen, query_vectors, wanted)

    def searched(self, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``places``' cells, and the entries in them."""
        cells, places = self.places(chosen)
        return cells, self.within(places)

    def ranked_in(self, cells: DataFrame, own: DataFrame, questions: DataFrame, chosen: DataFrame, query_vectors: DataFrame | None, wanted: retrieval.Wanted | None) -> tuple[DataFrame, DataFrame]:
        """``ranked`` in the cells and entries that are ``searched``."""
        wanted = wanted if self.roots is None else None
        scored = retrieval.hybrid(own, questions, self.body, self.head, self.vectors, query_vectors, indexed=self.postings(own), cells=cells, wanted=wanted).withColumn("score", F.round("score", 9))
        if self.roots is None:
            return scored.withColumn("called", F.lit(0)), own
        roots, graph = self.modules()
        calls = scopes.public_calls(questions, chosen.select("question_id", "package", "import"), roots, graph, own).withColumn("called", F.lit(1))
        return scored.join(calls, ["question_id", "package", "entry_id"], "left").withColumn("called", F.coalesce("called", F.lit(0))), own

    def answer(self, questions: DataFrame, chosen: DataFrame, budget: int, query_vectors: DataFrame | None) -> DataFrame:
        """``docs`` for questions that ask something."""
        cells, own = self.searched(chosen)
        # A block takes two tokens at least, and none is shorter than the shortest of all without its context: so many can be shown at most.
        alone = own.withColumn("context", F.lit(None).cast("string"))
        least = alone.agg(F.min(F.coalesce(F.length(rendered(F.lit(OTHERS))), F.lit(0)))).first()[0] or 0
        most = min(budget // 2, -(-3 * budget // (least + 1)))
        place = ["package", "file", "line"]
        scored, own = self.ranked_in(cells, own, questions, chosen, query_vectors, retrieval.Wanted(most, tuple(place), relational.SHARE))
        order = [F.desc("called"), F.desc("score"), F.col("entry_id")]
        once = relational.cap(scored.join(own.select("cell", "entry_id", "file", "line"), ["cell", "entry_id"]), ["question_id", *place], order, 1).drop("n")
        best = cut(relational.cap(once, ["question_id"], order, most).withColumn("rank", F.col("n") - 1).drop("n"))
        floored = cut(relational.relevance_floor(best, "question_id", [F.col("rank")]))
        kept = cut(floored.join(own.select("cell", "entry_id", "kind", "name", "path", "sig", "doc", "alias_of"), ["cell", "entry_id"]))
        real = symbols.stand_ins(kept.filter("alias_of is not null").select("cell", "entry_id", "file", "alias_of"), own)
        told = ["kind", "name", "path", "file", "line", "sig", "doc"]
        both = kept.join(real, ["cell", "entry_id"], "left")
        meant = both.withColumns({c: F.when(F.col("real").isNull(), F.col(c)).otherwise(F.col(f"real.{c}")) for c in told}).drop("real", "alias_of")
        around = scopes.context(kept.filter("rank = 0").select("question_id", "cell", "package", "entry_id"), own)
        whole = meant.join(around, ["question_id", "cell", "package", "entry_id"], "left")
        most = F.when(F.col("rank") == 0, FIRST - F.least(F.coalesce(F.length("context"), F.lit(0)), F.lit(CONTEXT)) / 2).otherwise(OTHERS).cast("int")
        return flat(relational.pack_blocks(whole.withColumn("rendered", rendered(most)), "question_id", [F.col("rank")], "rendered", budget).drop("cell"))

    def overview(self, package: str | None = None) -> DataFrame:
        """``eco, package, version, n_symbols, n_sections, symbols, blocks`` of the packages that ``package`` lists, else of all indexed ones: counts
        of symbols and sections, the shortest documented top-level symbols, and the first README sections."""
        if package:
            chosen = self.spark.createDataFrame([(*p, p[1]) if p[3] is None else (*p, p[3]) for p in self.picked(package)], "eco string, name string, version string, asked string, import string").select(F.struct("eco", "name", "version").alias("package"), "import")
        else:
            chosen = self.there().withColumn("import", F.col("package.name"))
        return flat(self.overview_of(chosen.withColumn("question_id", F.lit(0)))).drop("question_id")

    def overview_of(self, chosen: DataFrame) -> DataFrame:
        """``overview`` by ``question_id`` and exact ``package``."""
        cells, places = self.places(chosen)
        own = self.within(places)
        open_ = ~X.private_path(F.col("file"), F.col("path"))
        separators = F.length("path") - F.length(F.regexp_replace("path", "[.:]", ""))
        top = own.filter((F.col("kind") != "doc") & open_ & ~F.col("legacy") & (F.col("doc") != ""))
        first = relational.cap(top, ["cell"], [separators, F.length("path"), F.col("path"), F.col("entry_id")], NAMES)
        listed = lambda rows, c: rows.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(c).alias("x")))), lambda e: e["x"]))
        names = listed(first, "path").toDF("cell", "symbols")
        readme = relational.cap(own.filter((F.col("kind") == "doc") & F.upper("file").startswith("README")), ["cell"], [F.col("file"), F.col("line"), F.col("entry_id")], BLOCKS)
        blocks = listed(readme.withColumn("context", F.lit(None).cast("string")).withColumn("block", rendered(F.lit(README))), "block").toDF("cell", "blocks")
        symbol = (F.col("kind") != "doc") & (F.col("kind") != "re-export") & open_
        counts = own.groupBy("cell", "package").agg(F.count_if(symbol).alias("n_symbols"), F.count_if(~symbol).alias("n_sections"))
        return cells.select("question_id", "cell").join(counts, "cell").join(names, "cell", "left").join(blocks, "cell", "left").drop("cell")

    def exported(self, wanted: DataFrame) -> DataFrame:
        """``exports.statuses`` of symbols (``package, import, symbol``, and ``version``, if known) of npm packages; their entries must be those by file."""
        return flat(exports.statuses(self.exact(wanted), *self.modules(), self.own()))

    def api(self, wanted: DataFrame, package: str | None = None) -> DataFrame:
        """One row a ``symbol``: ``status``, its best declaration (``eco, package, version, import, entry_id, kind, path, file, line, sig, doc``), ``stands_for``
        (``path, file, line`` of what a re-export leads to), ``members``, ``overloads``, ``others`` (further declarations that match) and ``alternatives`` (other imports that offer it).

        Symbols are searched in the packages that ``package`` lists, else in those that they begin with, else in all direct
        ones (all indexed ones, if none of these is). Of npm packages with entrypoints only what the import exports counts:
        exact, ambiguous (places and signatures differ), unresolved (something on the way can't be read) or not_exported;
        then nothing is picked. Elsewhere names decide, best score first, and a name that isn't found is unresolved.
        """
        asked = cut(wanted.select(F.col("symbol").alias("question_id"), F.regexp_replace(F.trim("symbol"), r"(\(\))+$", "").alias("text")).distinct())
        chosen = self.select(asked, package)
        if package is None:
            known = cut(chosen.join(self.there(), "package", "left_semi"))
            lost = asked.join(known.select("question_id").distinct(), "question_id", "left_anti")
            everywhere = lost.select("question_id").crossJoin(F.broadcast(self.there())).select("question_id", "package", F.col("package.name").alias("import"), F.lit(True).alias("broad"))
            chosen = known.unionByName(everywhere)
        led = F.coalesce(F.col("text").startswith(F.concat("import", F.lit("."))) | F.col("text").startswith(F.concat("import", F.lit("::"))), F.lit(False))
        bare = F.when(led, F.regexp_replace(F.expr("substr(text, length(import) + 1)"), "^[.:]+", "")).otherwise(F.col("text"))
        each = cut(chosen.join(asked, "question_id").select("question_id", "package", "import", bare.alias("bare"), F.array_join(X.split_symbol(bare), ".").alias("path")))
        own = self.own().join(fitting(each.select("package").distinct()), "package", "left_semi")
        graphed = None if self.roots is None else self.modules()[0].select("package").distinct()
        plain = each if graphed is None else each.join(graphed, "package", "left_anti")
        found = symbols.lookup(own, plain.select(F.col("bare").alias("symbol")).distinct()).withColumnRenamed("symbol", "bare")
        cands = plain.join(found, ["package", "bare"]).select("question_id", "package", "import", "entry_id", "score")
        state = asked.select("question_id", F.lit(False).alias("scoped"), F.lit(False).alias("open"), F.array().cast("array<struct<offer: string, conditions: string, sig: string, file: string, line: int>>").alias("alternatives"))
        if graphed is not None:
            scoped = each.join(graphed, "package", "left_semi")
            told = cut(exports.statuses(scoped.select("package", "import", F.col("path").alias("symbol")).distinct(), *self.modules(), own).withColumnRenamed("symbol", "path"))
            by = cut(scoped.join(told, ["package", "import", "path"]))
            cands = cands.unionByName(by.select("question_id", "package", "import", F.explode("entry_ids").alias("entry_id"), F.lit(10.0).alias("score")))
            flags = by.groupBy("question_id").agg(F.lit(True).alias("scoped"), F.bool_or(F.col("status") == "unresolved").alias("open"), F.slice(F.sort_array(F.flatten(F.collect_list("alternatives"))), 1, 8).alias("alternatives"))
            state = flags.unionByName(state.join(flags, "question_id", "left_anti").select(flags.columns))
        meta = own.select("package", "entry_id", "kind", "path", "file", "line", "sig", "doc", "alias_of")
        cands = cut(cands.distinct().join(meta, ["package", "entry_id"]))
        seen = cands.groupBy("question_id").agg((F.countDistinct("package", "file", "path") > 1).alias("places"), (F.countDistinct("sig") > 1).alias("sigs"), F.count("*").alias("n"))
        order = W.partitionBy("question_id").orderBy(F.desc("score"), "package", "entry_id")
        placed = cands.withColumn("n", F.row_number().over(order))
        others = placed.filter(F.col("n").between(2, 9)).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.struct("path", "kind", "file", "line", "sig").alias("o")))), lambda e: e["o"]).alias("others"))
        best = placed.filter("n = 1").drop("n", "score")
        inner = symbols.members(own).join(own.select("package", "entry_id", F.col("name").alias("member")), ["package", "entry_id"]).groupBy("package", F.col("container_id").alias("entry_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "member"))), lambda e: e["member"]).alias("members"))
        real = symbols.stand_ins(best.filter("alias_of is not null").select(F.xxhash64("package").alias("cell"), "entry_id", "file", "alias_of"), own.withColumn("cell", F.xxhash64("package")))
        shown = best.withColumn("cell", F.xxhash64("package")).join(real.select("cell", "entry_id", F.struct("real.path", "real.file", "real.line").alias("stands_for")), ["cell", "entry_id"], "left").drop("cell", "alias_of")
        shown = shown.join(inner, ["package", "entry_id"], "left").join(symbols.overloads(own).withColumnRenamed("sigs", "overloads"), ["package", "path", "file"], "left")
        none = lambda c: F.coalesce(c, F.array())
        status = F.when(F.col("scoped") & F.coalesce(F.col("places") & F.col("sigs"), F.lit(False)), "ambiguous").when(F.col("scoped") & F.col("open"), "unresolved").when(F.col("n").isNull(), F.when(F.col("scoped"), "not_exported").otherwise("unresolved")).otherwise("exact")
        whole = flat(asked.select("question_id").join(state, "question_id").join(seen, "question_id", "left").join(shown, "question_id", "left").join(others, "question_id", "left").withColumn("status", status))
        sure = (F.col("status") == "exact") | ~F.col("scoped")
        picked = ["eco", "package", "version", "import", "entry_id", "kind", "path", "file", "line", "sig", "doc", "stands_for"]
        return whole.select(
            F.col("question_id").alias("symbol"), "status", *[F.when(sure, F.col(c)).alias(c) for c in picked], F.when(sure, none(F.col("members"))).alias("members"), F.when(sure, none(F.col("overloads"))).alias("overloads"),
            none(F.col("others")).alias("others"), none(F.col("alternatives")).alias("alternatives"), F.coalesce(F.col("places") & F.col("sigs") & F.col("scoped"), F.lit(False)).alias("ambiguous"),
        )

    def upgrade(self, old: DataFrame, new: DataFrame, project: DataFrame, marker: str) -> dict[str, DataFrame]:
        """``changes`` between two versions' entries, the ``sites`` in project files (``file, text``) that use changed symbols, ``guides`` that mention them, the first ``sections`` of guides, and a ``summary``."""
        changes = upgrade.diff(old, new)
        names = changes.select("package", "entry_id").join(old, ["package", "entry_id"]).select("path", "name", "kind")
        sites = upgrade.call_sites(project, names, marker)
        return {"changes": changes, "sites": sites, "guides": upgrade.guides(new, names.select("path", "name")), "sections": upgrade.guide_sections(new), "summary": upgrade.summary(changes, sites)}
