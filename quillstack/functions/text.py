"""Text expressions: tokens, stems, stop words, names and sizes, all evaluated inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that carry no meaning in a question.
STOP = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "get", "how", "i", "if", "in", "is", "it", "me", "my", "of", "on",
    "or", "should", "that", "the", "this", "to", "using", "what", "when", "where", "which", "with", "you", "your", "we", "our", "way", "want", "need", "there",
    "their", "into", "vs", "versus", "about", "example", "show",
)
# Words, as stems, that documentation uses for one another.
SYNONYMS = {
    "dict": ("dictionary", "dump", "mapping"), "dictionary": ("dict",), "convert": ("dump", "serializ", "transform", "cast"), "serializ": ("dump", "json", "encod"),
    "deserializ": ("pars", "load", "decod", "validat"), "pars": ("validat", "decod", "load"), "validat": ("pars", "check"), "remov": ("delet", "drop"),
    "delet": ("remov", "drop"), "creat": ("new", "build", "mak", "init"), "async": ("await", "promis", "futur"), "error": ("except", "err", "fail"),
    "except": ("error",), "config": ("setting", "option", "configur"), "setting": ("config",), "option": ("config", "param"), "fetch": ("request", "get"),
    "request": ("fetch",), "redirect": ("navigat",), "navigat": ("redirect", "router"), "spawn": ("task",), "finish": ("complet", "done"), "complet": ("finish", "done"),
    "first": ("race", "select"), "route": ("router", "path"), "middleware": ("layer",), "layer": ("middleware",), "state": ("extension",),
    "parameter": ("param", "arg", "argument"), "param": ("parameter",), "argument": ("arg", "param"), "arg": ("argument",), "javascript": ("js",), "js": ("javascript",),
    "typescript": ("ts",), "ts": ("typescript",), "databas": ("db",), "db": ("databas",), "unknown": ("extra", "strict"), "extra": ("unknown",),
}
SYNONYM_WEIGHT = 0.35
# A question with a word of each group asks for strict validation.
STRICT = (("reject", "forbid", "disallow"), ("unknown", "extra", "unrecogniz"), ("key", "field", "property", "properti"))


#: Where an identifier has parts: before a capital, between letters and digits, around underscores.
PARTS = ((r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2"), (r"(\p{L})(\p{N})", "$1 $2"), (r"(\p{N})(\p{L})", "$1 $2"))
_COMPOUND = r"(?<![\p{L}\p{N}_])((?=[\p{L}\p{N}_]*?(?:[\p{Ll}\p{N}]\p{Lu}|\p{Lu}\p{Lu}\p{Ll}|\p{L}\p{N}|\p{N}\p{L}|[\p{L}\p{N}]_+[\p{L}\p{N}]))[\p{L}\p{N}_]+)"


def tokens(text: Column) -> Column:
    """Identifiers' camelCase, snake_case and digit parts and, where they have several, the whole; lower case."""
    text = F.coalesce(text, F.lit(""))
    spaced = reduce(lambda c, p: F.regexp_replace(c, *p), PARTS, text)
    parts = F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.concat(parts, F.transform(F.regexp_extract_all(text, F.lit(_COMPOUND), 1), F.lower))


# English endings and what stands for them, one after another; each needs so many letters before it.
ENDINGS = (
    (r"^(.{3,})ies$", "$1y"), (r"^(?:(.+(?:ss|sh|ch)|..+x)es|(..+[^sui])s|(.{4,})ing|(.{3,}[^e])ed)$", "$1$2$3$4"),
    (r"^(..+[ai]b)ility$", "$1l"), (r"^(.{3,}at)ion$", "$1"), (r"^(.{4,})e$", "$1"),
)


def stem(t: Column) -> Column:
    """The token without an English suffix: plurals, -ing, -ed, -ation, -ability, a final e; ASCII only."""
    return F.when(F.octet_length(t) == F.length(t), reduce(lambda c, p: F.regexp_replace(c, *p), ENDINGS, t)).otherwise(t)


def stemmed(df: DataFrame, token: str = "token", out: str = "term") -> DataFrame:
    return df.withColumn(out, stem(F.col(token)))


def question_terms(questions: DataFrame, synonyms: bool) -> DataFrame:
    """``question_id, term, weight, n_full``: distinct stems without stop words, all of full weight.

    With ``synonyms``, words that documentation uses for them join at a lower weight if they aren't terms already, and
    where a question rejects unknown keys, ``strict`` has full weight. ``n_full`` counts terms of full weight.
    """
    from .terms import asked

    spark = questions.sparkSession
    full = asked(questions)
    if synonyms:
        groups = [F.max(F.col("term").isin(*g)).alias(f"g{i}") for i, g in enumerate(STRICT)]
        strict = full.groupBy("question_id").agg(*groups).filter("g0 and g1 and g2").select("question_id", F.lit("strict").alias("term"))
        pairs = spark.createDataFrame([(k, s) for k, v in SYNONYMS.items() for s in v], "term string, other string")
        more = full.join(F.broadcast(pairs), "term").select("question_id", F.col("other").alias("term")).distinct()
        weighed = full.unionByName(strict).withColumn("weight", F.lit(1.0)).unionByName(more.withColumn("weight", F.lit(SYNONYM_WEIGHT)))
        full = weighed.groupBy("question_id", "term").agg(F.max("weight").alias("weight"))
    else:
        full = full.withColumn("weight", F.lit(1.0))
    n = F.greatest(F.count_if(F.col("weight") >= 1).over(Window.partitionBy("question_id")), F.lit(1))
    return full.withColumn("n_full", n)


def est_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3)


def norm_name(eco: Column, name: Column) -> Column:
    """The name under which an ecosystem compares packages; Go's are as they are."""
    return F.when(eco == "pypi", F.regexp_replace(F.lower(name), r"[-_.]+", "-")).when(eco == "cargo", F.replace(F.lower(name), F.lit("_"), F.lit("-"))).when(eco == "npm", F.lower(name)).otherwise(name)


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def parent(path: Column) -> Column:
    """A symbol's path without its last segment (after ``.`` or ``::``)."""
    return F.regexp_extract(path, r"^(.*?):*[.:][^.:]*$", 1)


def shape(sig: Column, name: Column) -> Column:
    """A signature with the symbol's own name, where it first occurs, blanked."""
    at = F.position(name, sig)
    return squash(F.when((F.length(name) > 0) & (at > 0), F.concat(F.left(sig, at - 1), F.lit("_"), F.substr(sig, at + F.length(name)))).otherwise(sig))


def plain_words(text: Column) -> Column:
    """Distinct lower-case words of over two bytes."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: F.lower(w)), lambda w: F.octet_length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def mentions(line: Column, name: Column, member: Column) -> Column:
    """Whether a line uses ``name`` as a whole identifier; a member's must follow ``.`` or ``::``."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    free = F.concat(F.lit(r"(?<![\p{L}\p{N}_$])"), quoted, F.lit(r"(?![\p{L}\p{N}_$])"))
    of = F.concat(F.lit(r"(?<=\.|::)"), quoted, F.lit(r"(?![\p{L}\p{N}_$])"))
    return F.when(F.length(name) == 0, False).otherwise(F.regexp(line, F.when(member, of).otherwise(free)))


def go_escape(path: Column) -> Column:
    """Module cache spelling: an upper-case letter becomes ``!`` and its lower case."""
    return F.lower(F.regexp_replace(path, "([A-Z])", "!$1"))


def major_of(version: Column) -> Column:
    return F.coalesce(F.regexp_extract(version, r"^v*(\d+)(?:\.|$)", 1).try_cast("long"), F.lit(0))


def split_symbol(symbol: Column) -> Column:
    dotted = F.replace(F.replace(symbol, F.lit("::"), F.lit(".")), F.lit("#"), F.lit("."))
    return F.filter(F.transform(F.split(dotted, r"\."), lambda s: F.regexp_replace(F.trim(s), r"(\(\))+$", "")), lambda s: s != "")


def private_path(file: Column, path: Column) -> Column:
    hidden = F.exists(F.split(file, "/"), lambda s: s.startswith("_") & ~s.startswith("__init__"))
    return hidden | path.contains("._") | file.contains("/internal/")


# Directories and files of tools shipped inside a package.
TOOLING = ("mypy", "pylint", "plugin", "plugins", "testing", "conftest", "scripts", "codemod", "codemods", "eslint", "babel")


def tooling_path(file: Column) -> Column:
    return F.exists(F.split(file, "/"), lambda s: F.split(s, r"\.")[0].isin(*TOOLING))


def legacy_file(file: Column, major: Column) -> Column:
    """A file under a directory ``vN`` of an earlier major than the pinned one."""
    old = F.exists(F.split(file, "/"), lambda s: F.regexp_extract(s, r"^v(\d+)$", 1).try_cast("long") < major)
    return F.coalesce(old, F.lit(False)) & (major > 1)


# Words of a question about what changed between versions.
CHANGE_WORDS = ("change", "migrat", "upgrad", "breaking", "deprecat", "removed", "renamed", "new in", "since", "release", "what's new", "differen")


def change_intent(question: Column) -> Column:
    return F.regexp(F.lower(question), F.lit("|".join(CHANGE_WORDS)))


def identifiers(question: Column) -> Column:
    """Identifier-like words of a question and their last segments, lower case; a lone word is one."""
    words = F.filter(F.split(question, r"[\s,?'\"\[\]]+"), lambda w: w != "")
    looks = lambda w: (F.size(words) == 1) | w.startswith("`") | F.regexp(w, F.lit(r"[_.($]|::")) | F.regexp(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), F.lit("^.+[A-Z]"))
    bare = lambda w: F.regexp_replace(w, r"^[`().:!;]+|[`().:!;]+$", "")
    found = F.filter(F.transform(F.filter(words, looks), bare), lambda w: (F.octet_length(w) >= 2) & F.regexp(w, F.lit("[A-Za-z]")))
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.array_compact(F.array(F.lower(w), F.lower(F.try_element_at(split_symbol(w), F.lit(-1))))))))


# Phrases after which a doc names what to use instead.
REDIRECT_CUES = ("use ", "consider ", "renamed to ", "replaced by ", "in favor of ", "in favour of ", "instead use ")


def redirects(text: Column) -> Column:
    """API names that a doc points readers to: quoted, or with a ``_``, ``.``, ``$`` or inner capital; last segments."""
    cue = "|".join(c.strip() for c in REDIRECT_CUES)
    found = F.regexp_extract_all(text, F.lit(rf"(?i:{cue}) ([`'\"* ]*[\p{{L}}\p{{N}}_.:$]+)"), 1)
    bare = lambda w: F.regexp_replace(F.regexp_replace(w, r"^[`'\"* ]+", ""), r"[.:]+$", "")
    looks = lambda w: w.startswith("`") | F.regexp(bare(w), F.lit(r"[_.$]|^.+[A-Z]"))
    names = F.transform(F.filter(found, lambda w: looks(w) & (F.octet_length(bare(w)) >= 3)), lambda w: F.regexp_extract(bare(w), r"([^.:]*)$", 1))
    return F.array_distinct(F.filter(names, lambda n: F.octet_length(n) >= 3))


def url_escaped(text: Column) -> Column:
    """Percent-encoded UTF-8: all but ASCII letters, digits and ``-._~``."""
    own = F.url_encode(text)
    for found, instead in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        own = F.replace(own, F.lit(found), F.lit(instead))
    return own


def github_repository(url: Column) -> Column:
    """``owner, name`` of a repository that a manifest names: by a ``github:`` shorthand, any URL of the host, or ``owner/name``; else null."""
    url = F.trim(url)
    at = F.position(F.lit("github.com"), url)
    short = ~url.contains(":") & (F.regexp_count(url, F.lit("/")) == 1) & ~url.startswith(".")
    rest = F.when(url.startswith("github:"), F.regexp_replace(url, "^github:", "")).when(at > 0, F.regexp_replace(F.substr(url, at + 10), "^[:/]+", "")).when(short, url)
    parts = F.filter(F.split(rest, "[/#?]"), lambda x: x != "")
    owner, name = F.try_element_at(parts, F.lit(1)), F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"(\.git)+$", "")
    safe = lambda x: F.regexp(x, F.lit(r"^[A-Za-z0-9_.-]+$")) & ~x.isin(".", "..")
    return F.when(safe(owner) & safe(name), F.struct(owner.alias("owner"), name.alias("name")))
