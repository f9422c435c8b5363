"""What changes between two versions of a package: classification, renames, call sites and guides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from .lineage import cut

SIMILAR, SITES, GUIDES, GUIDE_SECTIONS = 0.7, 20, 2, 5
#: Symbols of a group that have a word, beyond which those that have a further one in common are made pairs of.
COMMON = 64
# What names of files with changes and ways to upgrade contain.
GUIDE_FILES = ("CHANGELOG", "MIGRAT", "UPGRAD", "BREAKING", "HISTORY", "NEWS")


def is_guide(file: Column) -> Column:
    return F.regexp(F.upper(F.regexp_extract(file, r"([^/]*)$", 1)), F.lit("|".join(GUIDE_FILES)))


def deprecated(doc: Column, sig: Column) -> Column:
    doc, sig = F.lower(doc), F.lower(sig)
    return doc.contains("@deprecated") | doc.contains("deprecated:") | doc.contains(".. deprecated::") | sig.contains("#[deprecated") | sig.contains("@deprecated")


def api(entries: DataFrame) -> DataFrame:
    return entries.filter("kind <> 'doc' and not legacy")


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """``package, entry_id, path, change, new_id`` of old symbols: deprecated, signature_changed, same or gone.

    Both have ``package, entry_id, kind, name, path, sig, doc, alias_of, legacy``. Of old symbols at one path the first
    counts, of new ones the last.
    """
    o = api(old).groupBy("package", "path").agg(F.min_by(F.struct("*"), "entry_id").alias("o"))
    n = api(new).groupBy("package", "path").agg(F.max_by(F.struct("*"), "entry_id").alias("n"))
    both = o.join(n, ["package", "path"], "left")
    newly = deprecated(F.col("n.doc"), F.col("n.sig")) & ~deprecated(F.col("o.doc"), F.col("o.sig"))
    differs = F.col("o.alias_of").isNull() & F.col("n.alias_of").isNull() & (X.squash(F.col("o.sig")) != X.squash(F.col("n.sig")))
    change = F.when(F.col("n").isNull(), "gone").when(newly, "deprecated").when(differs, "signature_changed").otherwise("same")
    return both.select("package", F.col("o.entry_id").alias("entry_id"), "path", change.alias("change"), F.col("n.entry_id").alias("new_id"))


def rename_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """``package, old_id, new_id, similarity`` of alike gone and added symbols; see ``alike``."""
    return alike(old, new).select("package", "old_id", "new_id", "similarity")


def alike(old: DataFrame, new: DataFrame) -> DataFrame:
    """``package, kind, parent, old_id, new_id, similarity`` of gone and added symbols of one kind and parent that are alike.

    Alike: the same signature apart from the name (1.0), or docs whose words have a Jaccard similarity of 0.7. Only
    pairs of equal signatures and pairs that share one of their rarest words (of n words, one of the n - ceil(0.7 n) + 1
    rarest, as any pair that alike does) are made at all; of words that over ``COMMON`` symbols of the group have, pairs
    that share a second one, too. Words travel with what is met by them, so a pair is told where it is made, at the first
    words that both have, and only alike ones are shuffled.
    """
    o, n = api(old), api(new)
    gone = o.join(n.select("package", "path"), ["package", "path"], "left_anti").groupBy("package", "path").agg(F.min_by(F.struct("*"), "entry_id").alias("o")).select("o.*")
    added = n.filter("alias_of is null").join(o.select("package", "path"), ["package", "path"], "left_anti")
    side = lambda df, p: df.select("package", "kind", X.parent(F.col("path")).alias("parent"), F.col("entry_id").alias(f"{p}_id"), F.col("sig").alias(f"{p}_sig"), X.shape(F.col("sig"), F.col("name")).alias(f"{p}_shape"), X.plain_words(F.col("doc")).alias(f"{p}_words"))
    group = ["package", "kind", "parent"]
    a, b = cut(side(gone, "old")), cut(side(added, "new"))
    each = lambda df, p: df.select(*group, f"{p}_id", F.explode(f"{p}_words").alias("word"))
    df = each(a, "old").select(*group, "word").unionByName(each(b, "new").select(*group, "word")).groupBy(*group, "word").agg(F.count("*").alias("df"))

    def rarest(side_: DataFrame, p: str) -> DataFrame:
        found = each(side_, p).join(df, [*group, "word"]).groupBy(*group, f"{p}_id").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("w"))
        sized = found.withColumn("most", (F.size("w") - F.ceil(F.size("w") * SIMILAR)).cast("int"))
        at = lambda i: F.col("w")[i]["word"]
        key = lambda i, j: F.struct(at(i).alias("word"), (at(j) if j is not i else F.lit("")).alias("next"), j.alias(f"{p}_at"))
        alone = lambda i: (F.col("w")[i]["df"] <= COMMON) | (F.size("w") == 1)
        keys = F.flatten(F.transform(F.sequence(F.lit(0), F.col("most")), lambda i: F.when(alone(i), F.array(key(i, i))).otherwise(F.transform(F.sequence(i + 1, F.col("most") + 1), lambda j: key(i, j)))))
        return sized.select(*group, f"{p}_id", F.col("w.word").alias(f"{p}_words"), F.inline(keys))

    by_shape = a.filter("old_sig <> ''").select(*group, F.col("old_shape").alias("shape"), "old_id").join(b.select(*group, F.col("new_shape").alias("shape"), "new_id"), [*group, "shape"]).select(*group, "old_id", "new_id", F.lit(1.0).alias("similarity"))
    n, m = F.size("old_words"), F.size("new_words")
    # What both can have from the last word of the key on, with what they have before it, and what they need for their sizes.
    before = F.when(F.col("next") == "", 0).otherwise(1)
    within = F.least(n - F.col("old_at"), m - F.col("new_at")) + before >= (n + m) * (SIMILAR / (1 + SIMILAR)) - 0.01
    first = F.size(F.array_intersect(F.slice("old_words", F.lit(1), F.col("old_at")), F.slice("new_words", F.lit(1), F.col("new_at")))) == before
    both = F.size(F.array_intersect("old_words", "new_words"))
    met = rarest(a, "old").join(rarest(b, "new"), [*group, "word", "next"]).filter(within).filter(first)
    by_word = met.select(*group, "old_id", "new_id", F.round(both / (n + m - both), 6).alias("similarity")).filter(F.col("similarity") >= SIMILAR)
    return by_shape.unionByName(by_word).groupBy(*group, "old_id", "new_id").agg(F.max("similarity").alias("similarity"))


def renames(candidates: DataFrame) -> DataFrame:
    """``package, old_id, new_id``: old symbols in order each take the most similar new one that is left (of equals the last).

    In rounds, all at once: each old symbol asks for the best one that may still be its own, each new one holds the first
    that asks, and pairs of it with later ones are struck out, as what it holds is only ever replaced by an earlier one.
    When nothing more is struck out, the holders are what taking turns gives. Candidates are rows of ``alike``.
    """
    group = ["package", "kind", "parent"]
    left = cut(candidates.select(*group, "old_id", "new_id", "similarity"))
    while True:
        asked = left.groupBy(*group, "old_id").agg(F.max(F.struct("similarity", "new_id")).alias("best")).select(*group, "old_id", F.col("best.new_id").alias("new_id"))
        held = cut(asked.groupBy(*group, "new_id").agg(F.min("old_id").alias("holder")))
        both = left.join(held, [*group, "new_id"], "left")
        if both.filter("old_id > holder").isEmpty():
            return held.select("package", F.col("holder").alias("old_id"), "new_id")
        left = cut(both.filter("holder is null or old_id <= holder").drop("holder"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``package, entry_id, path, change, new_id``: removed, renamed, signature_changed and deprecated symbols."""
    found = classify(old, new)
    named = renames(alike(old, new)).select("package", F.col("old_id").alias("entry_id"), F.col("new_id").alias("to"))
    both = found.filter("change <> 'same'").join(named, ["package", "entry_id"], "left")
    change = F.when(F.col("change") != "gone", F.col("change")).when(F.col("to").isNotNull(), "renamed").otherwise("removed")
    return both.select("package", "entry_id", "path", change.alias("change"), F.coalesce("new_id", "to").alias("new_id"))


def call_sites(files: DataFrame, symbols: DataFrame, marker: str, sites: int = SITES) -> DataFrame:
    """``path, file, line``: up to ``sites`` lines that use each symbol, in files that mention the package.

    ``files``: ``file, text``; ``symbols``: ``path, name, kind``. Lines are cut into identifiers and joined with names,
    then tested for the identifier's boundaries, and for ``.`` or ``::`` before a member.
    """
    lines = files.filter(F.col("text").contains(marker)).select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "content"))
    words = lines.select("file", (F.col("n") + 1).alias("line"), "content", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([\p{L}\p{N}_$]+)"), 1))).alias("name"))
    hits = words.join(symbols.filter("name <> ''"), "name").filter(X.mentions(F.col("content"), F.col("name"), F.col("kind").isin("method", "field")))
    return hits.withColumn("k", F.row_number().over(W.partitionBy("path").orderBy("file", "line"))).filter(F.col("k") <= sites).select("path", "file", "line")


def guides(prose: DataFrame, symbols: DataFrame, most: int = GUIDES) -> DataFrame:
    """``path, entry_id``: up to ``most`` sections of changelogs and upgrade guides that mention each symbol."""
    own = prose.filter(F.col("kind") == "doc").filter(is_guide(F.col("file")))
    words = own.select("entry_id", F.explode(F.array_distinct(F.regexp_extract_all("doc", F.lit(r"([\p{L}\p{N}_$]+)"), 1))).alias("name"))
    hits = words.join(symbols, "name").select("path", "entry_id").distinct()
    return hits.withColumn("k", F.row_number().over(W.partitionBy("path").orderBy("entry_id"))).filter(F.col("k") <= most).select("path", "entry_id")


def guide_sections(entries: DataFrame, most: int = GUIDE_SECTIONS) -> DataFrame:
    """``package, entry_id, n``: the first ``most`` sections of each package's changelogs and upgrade guides."""
    own = entries.filter(F.col("kind") == "doc").filter(is_guide(F.col("file")))
    return own.withColumn("n", F.row_number().over(W.partitionBy("package").orderBy("entry_id"))).filter(F.col("n") <= most).select("package", "entry_id", "n")


def summary(changes: DataFrame, sites: DataFrame) -> DataFrame:
    """Counts of changed symbols and of their call sites by kind of change."""
    n = sites.groupBy("path").agg(F.count("*").alias("n"))
    return changes.join(n, "path", "left").groupBy("change").agg(F.count("*").alias("symbols"), F.count_if(F.col("n") > 0).alias("affected"), F.coalesce(F.sum("n"), F.lit(0)).alias("sites"))
