"""Which packages a question is about: specifications, names that resemble one another, names that a question mentions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X

# What ecosystems are called, and the most direct dependencies that a question without a package searches.
ECOSYSTEMS = {"npm": "npm", "node": "npm", "pypi": "pypi", "py": "pypi", "python": "pypi", "cargo": "cargo", "crates": "cargo", "rust": "cargo", "go": "go", "golang": "go"}
MOST_PACKAGES, MOST_SIMILAR = 80, 6
# The order of ecosystems where a name is in several.
ORDER = ("npm", "pypi", "cargo", "go")


def eco_rank(eco: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(e) for e in ORDER]), eco), F.lit(0)), F.lit(len(ORDER) + 1))


@dataclass(frozen=True)
class Spec:
    """``eco:name@version`` or ``name==version``; without a version any one fits."""

    eco: str | None
    name: str
    version: str | None

    @staticmethod
    def parse(text: str) -> Spec:
        text = text.strip()
        lead, colon, rest = text.partition(":")
        eco = ECOSYSTEMS.get(lead.lower()) if colon else None
        rest = rest if eco else text
        at = rest.find("@", 1)
        name, version = (rest[:at], rest[at + 1 :].lstrip("v")) if at > 0 else rest.partition("==")[::2]
        return Spec(eco, name.strip(), version.strip() or None)

    def exact(self) -> bool:
        """Whether the version can only mean one: it has three parts, or is a Go module's."""
        return self.version is not None and (self.version.count(".") >= 2 or self.eco == "go")

    def names(self, eco: Column, name: Column) -> Column:
        """Whether a package is meant: its name as its ecosystem compares names, or a Go module's last parts (without ``/vN``)."""
        same = X.norm_name(eco, name) == X.norm_name(eco, F.lit(self.name))
        go = (eco == "go") & ((go_short(name) == self.name) | name.endswith(f"/{self.name}"))
        return F.coalesce((same | go) & (F.lit(self.eco is None) | (eco == self.eco)), F.lit(False))

    def fits(self, version: Column) -> Column:
        """Whether it is the version itself, or one that it begins at a ``.`` or ``-``: 3 is 3.23.8 but not 30.0.0."""
        if self.version is None:
            return F.lit(True)
        bare = F.regexp_replace(version, "^v+", "")
        return (bare == self.version) | bare.startswith(f"{self.version}.") | bare.startswith(f"{self.version}-")


def go_short(name: Column) -> Column:
    """The last part of a module's path, or the one before a ``vN``."""
    return F.regexp_extract(F.regexp_replace(name, r"(?<=.)/v\d+$", ""), r"([^/]*)$", 1)


def find(deps: DataFrame, spec: Spec) -> DataFrame:
    """Dependencies that a specification names with their ``rank``: those of its version first, then direct ones."""
    own = deps.filter(spec.names(F.col("eco"), F.col("name"))).withColumn("fits", spec.fits(F.col("version")))
    return own.withColumn("rank", F.row_number().over(W.orderBy(F.desc("fits"), F.desc("direct"), "eco", "name", "version")))


def grams(text: Column) -> Column:
    """All parts of one to three characters, and the empty one."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(starts, lambda i: F.array(*[F.substr(text, i, F.lit(k)) for k in (1, 2, 3)])))))


def similar(deps: DataFrame, asked: DataFrame, most: int = MOST_SIMILAR) -> DataFrame:
    """``asked, id, n``: for each asked name up to ``most`` dependencies whose name contains it, or whose last part it contains.

    What contains a name has its first three characters, so names meet by these.
    """
    own = deps.select("eco", "name", "version", "direct", F.lower("name").alias("low"), F.regexp_extract(F.lower("name"), r"([^/]*)$", 1).alias("last")).distinct()
    wanted = asked.select("asked", F.lower("asked").alias("want")).distinct()
    inside = own.withColumn("key", F.explode(grams(F.col("low")))).join(wanted.withColumn("key", F.left("want", F.lit(3))), "key").filter(F.col("low").contains(F.col("want")))
    around = own.withColumn("key", F.left("last", F.lit(3))).join(wanted.filter(F.length("asked") >= 3).withColumn("key", F.explode(grams(F.col("want")))), "key").filter(F.col("want").contains(F.col("last")))
    named = inside.unionByName(around).select("asked", F.concat("eco", F.lit(":"), "name", F.lit("@"), "version").alias("id"), "direct", "eco", "name", "version").distinct()
    order = W.partitionBy("asked").orderBy(F.desc("direct"), "eco", "name", "version")
    return named.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("asked", "id", "n")


def mentioned(questions: DataFrame, deps: DataFrame) -> DataFrame:
    """``question_id, eco, name``: direct dependencies that a question names: as a word, as what a word has before a ``.`` or
    ``::``, and Go modules by their last part. Words and their beginnings meet names by an equi-join."""
    words = F.array_distinct(F.split(F.lower("text"), r"""[\s,?()`'"]+"""))
    each = questions.select("question_id", F.explode(words).alias("word")).filter("word <> ''")
    marks = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: (F.substr("word", i, F.lit(1)) == ".") | (F.substr("word", i, F.lit(2)) == "::"))
    keys = each.select("question_id", "word", F.explode(F.concat(F.array("word"), F.transform(marks, lambda i: F.substr("word", F.lit(1), i - 1)))).alias("key"))
    direct = deps.filter("direct").select("eco", "name").distinct()
    named = direct.select("eco", "name", F.lower("name").alias("key"), F.lit(False).alias("whole"))
    short = direct.filter("eco = 'go'").select("eco", "name", F.regexp_extract(F.lower("name"), r"([^/]*)$", 1).alias("key"), F.lit(True).alias("whole"))
    hits = keys.filter("key <> ''").join(named.unionByName(short), "key").filter(~F.col("whole") | (F.col("key") == F.col("word")))
    return hits.groupBy("question_id", "name").agg(F.min_by("eco", F.struct(eco_rank(F.col("eco")), "eco")).alias("eco")).select("question_id", "eco", "name")


def first_direct(direct: DataFrame, most: int = MOST_PACKAGES) -> DataFrame:
    """Which of the ``direct`` packages a question is about that mentions none."""
    return direct.withColumn("n", F.row_number().over(W.orderBy("eco", "name"))).filter(F.col("n") <= most).drop("n")


def choose(questions: DataFrame, deps: DataFrame, most: int = MOST_PACKAGES) -> DataFrame:
    """``question_id, eco, name, broad``: the packages to search for each question: those that it mentions, else up to ``most``
    direct ones; with the ``version`` that is pinned (of several the first), if ``deps`` have any."""
    named = mentioned(questions, deps).withColumn("broad", F.lit(False))
    direct = deps.filter("direct").select("eco", "name").distinct()
    if "version" in deps.columns:
        pinned = deps.filter("direct").groupBy("eco", "name").agg(F.min("version").alias("version"))
        named = named.join(pinned, ["eco", "name"]).select("question_id", "eco", "name", "version", "broad")
        direct = pinned
    first = first_direct(direct, most)
    rest = questions.select("question_id").join(named.select("question_id").distinct(), "question_id", "left_anti").crossJoin(F.broadcast(first)).withColumn("broad", F.lit(True))
    return named.unionByName(rest.select(named.columns))


def broad_counts(questions: DataFrame, deps: DataFrame, sources: DataFrame) -> DataFrame:
    """``question_id, searched, local, registry, upstream, notes, unavailable``: where the packages of broad answers (those of ``choose``) come from.

    ``sources``: ``eco, name, fetched, upstream, note``, one row a package whose files are there. All broad answers have the same packages, so these are counted once.
    """
    first = first_direct(deps.filter("direct").select("eco", "name").distinct())
    both = first.join(sources.select("eco", "name", "fetched", "upstream", "note", F.lit(True).alias("there")), ["eco", "name"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    counts = {
        "searched": yes(F.col("there")), "local": yes(F.col("there") & ~F.col("fetched")), "registry": yes(F.col("fetched")),
        "upstream": yes(F.col("upstream")), "notes": F.col("note").isNotNull(), "unavailable": F.col("there").isNull(),
    }
    once = both.agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).filter("searched + unavailable > 0")
    broad = questions.select("question_id").join(mentioned(questions, deps).select("question_id").distinct(), "question_id", "left_anti").groupBy("question_id").agg(F.count("*").alias("times"))
    return broad.crossJoin(F.broadcast(once)).select("question_id", *[(F.col("times") * F.col(n)).alias(n) for n in counts])
