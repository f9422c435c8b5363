"""Documentation from upstream: component pages as Markdown, included examples, example files, and which files count."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import relational
from .files import EXAMPLE_EXTENSIONS, base_name, extension
from .markdown import SCHEMA, split

#: Longest component page that is read, longest example, and characters of an included example.
MAX_PAGE, MAX_EXAMPLE, INCLUDED = 200_000, 12_000, 3000
# Roots of documentation in a repository, folders that may stand before one, and limits on what is kept.
DOC_ROOTS, WRAPPERS = ("docs", "doc", "documentation", "guide", "guides", "docs_src"), ("website", "site", "www", "apps", "packages", "content", "src")
MOST_ROOTS, MOST_FILES, MOST_BYTES, MOST_FILE = 4, 2500, 40 << 20, 3 << 20
# Extensions of documentation, and folders of a repository that hold none.
DOC_FILES, NO_DOCS = ("md", "mdx", "rst", "markdown", "mdoc", "txt"), ("blog", "node_modules", "i18n", "_snippets", "images", "public", ".github", "test", "tests")
# How names of files near a package that are documentation begin.
NEAR_DOCS = ("README", "CHANGELOG", "CHANGES", "HISTORY", "MIGRAT", "UPGRAD", "RELEASE")

_STRING = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|(?:[\w.]+\s*)?`(?:[^`\\]|\\.)*`)"""
_TOKEN = re.compile(
    rf"""(?P<skip>^import\b[^;\n]*[;\n]|\{{?/\*.*?\*/\}}?|^\s*//[^\n]*)|(?P<key>\b(?:title|heading|description|code|lang)\b)\s*:\s*(?P<value>\(?\s*{_STRING})|(?P<open>[\[\]])
    |<(?P<head>h[1-6])\b[^>]*>(?P<text>.*?)</(?P=head)>|<code\b[^>]*>(?P<ticks>[^<{{]*)</code>|<(?P<tag>/?[A-Za-z][\w.]*)(?:[^<>"'{{}}]|"[^"]*"|'[^']*'|\{{[^{{}}]*\}})*>|(?P<plain>(?<=>)[^<>{{}}]+(?=[<{{]))""",
    re.S | re.M | re.X,
)


def literal(raw: str) -> str:
    """The value of a quoted or template string; a template's lines lose their common indentation."""
    raw = raw.lstrip("( \n\t")
    quote = raw.find("`") if raw[0] not in "\"'" else 0
    inner = raw[quote + 1 : -1]
    if raw[quote] == "`":
        return textwrap.dedent(inner.strip("\n")).rstrip()
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), inner)


def squashed(text: str) -> str:
    return " ".join(re.sub(r"<[^>]*>", "", re.sub(r"\{\s*[\"'`]([^\"'`]*)[\"'`]\s*\}", r"\1", text)).split())


def page_markdown(text: str) -> tuple[str, str | None]:
    """Markdown of a page written as a component, and its title.

    Titles of listed steps become headings, descriptions and text paragraphs, ``code`` fenced code in the language of
    the ``lang`` beside it, and headings stay; lines keep their place where they can. A token scan, not a parser: text
    inside expressions with nested braces is passed over.
    """
    if len(text) > MAX_PAGE:
        return "", None
    out: list[tuple[int, str]] = []
    title, depth, words, at, lang = None, 0, [], 0, "text"

    def flush() -> None:
        if joined := " ".join(" ".join(words).split()):
            out.append((at, joined))
        words.clear()

    for m in _TOKEN.finditer(text):
        line = text.count("\n", 0, m.start()) + 1
        if m["key"]:
            value = literal(m["value"])
            if m["key"] == "lang":
                lang = value
                if out and out[-1][1].startswith("```text\n"):
                    out[-1] = (out[-1][0], out[-1][1].replace("```text", f"```{lang}", 1))
            elif m["key"] == "code":
                flush()
                out.append((line, f"```{lang}\n{value}\n```"))
                lang = "text"
            elif m["key"] == "description":
                flush()
                out.append((line, squashed(value)))
            elif depth:
                flush()
                out.append((line, f"## {squashed(value)[:200]}"))
            else:
                title = title or value
        elif m["open"]:
            depth += 1 if m["open"] == "[" else -1
        elif m["head"]:
            flush()
            out.append((line, f"{'#' * int(m['head'][1])} {squashed(m['text'])}"))
        elif m["plain"] is not None and re.match(r"\s*[,;:)\]}=&|?]", m["plain"]):
            flush()  # code between components
        elif m["ticks"] is not None or m["plain"] is not None:
            at = at if words else line
            words.append(f"`{m['ticks']}`" if m["ticks"] is not None else m["plain"])
        elif m["tag"] and m["tag"].lstrip("/") in ("p", "div", "li", "ul", "ol", "section"):
            flush()
    flush()
    lines: list[str] = []
    for line, part in out:
        lines += [""] * (line - 1 - len(lines)) + part.split("\n")
    return "\n".join(lines), title


def route(file: str) -> str:
    """What a page without a title is called: the last parts of its route, without groups and file names."""
    parts = [p for p in file.split("/") if not (p.startswith("(") and p.endswith(")"))][-3:]
    if parts and parts[-1].startswith(("page.", "index.")):
        parts.pop()
    return re.sub(r"\.(tsx|jsx|js)$", "", "/".join(parts))


def sections(files: DataFrame) -> DataFrame:
    """Sections of component pages and example files (``package, file, how, text``; how is page or example), in the rows of ``markdown.SCHEMA``.

    An example is one section of code under its file's name; long ones are passed over.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for package, file, how, text in zip(frame.package, frame.file, frame.how, frame.text, strict=True):
                text = text or ""
                if how == "page":
                    body, title = page_markdown(text)
                    rows += [(package, file, line, name, doc, parents, imports) for line, name, doc, parents, imports in split(body, title or route(file))]
                elif text.strip() and len(text.encode()) <= MAX_EXAMPLE:
                    stem, _, lang = file.rpartition("/")[2].rpartition(".")
                    rows.append((package, file, 1, f"example › {re.sub('[_-]', ' ', stem or lang)}", f"```{lang}\n{text.rstrip()}\n```", [], []))
            yield pd.DataFrame(rows, columns=["package", "file", "line", "name", "doc", "parents", "imports"])

    return files.filter("how in ('page', 'example')").select("package", "file", "how", "text").mapInPandas(run, SCHEMA)


def with_includes(pages: DataFrame, examples: DataFrame) -> DataFrame:
    """``pages`` (``package, file, text``) with lines that include an example replaced by its code.

    ``{! path !}``, ``{* path *}`` and ``--8<-- "path"`` mean the example (``package, file, text``) whose path without
    its extension ends, alone of all, with the longest of the last three, two or one parts of the path. References meet
    examples by an equi-join on these endings.
    """
    lines = pages.select("package", "file", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    raw = F.regexp_extract("line", r"^\s*(?:\{!(.*)!\}|\{\*(.*)\*\}|--8<--(.*))\s*$", 0)
    asked = lines.filter(raw != "").withColumn("ref", F.regexp_replace(F.lower(F.trim(F.regexp_replace(raw, r"^\s*(\{[!*]|--8<--)|([!*]\}|)\s*$", ""))), r"""^["']|["'].*$|\s.*$""", ""))
    parts = F.filter(F.split(F.regexp_replace("ref", r"\.[^./]*$", ""), "/"), lambda s: ~s.isin("", "..", ".", ".tmp_examples"))
    suffix = lambda p, k: F.when(F.size(p) >= k, F.array_join(F.slice(p, -k, k), "/"))
    wanted = asked.withColumn("p", parts).select("package", "file", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), suffix(F.col("p"), k).alias("end")) for k in (3, 2, 1)])).alias("e")).select("package", "file", "n", "e.k", "e.end").filter("end is not null")
    stems = examples.filter(extension(F.col("file")).isin(*EXAMPLE_EXTENSIONS)).select("package", F.col("file").alias("example"), "text", F.split(F.regexp_replace(F.lower(F.regexp_replace("file", "^upstream:", "")), r"\.[^./]*$", ""), "/").alias("p"))
    ends = stems.select("package", "example", F.explode(F.array(*[suffix(F.col("p"), k) for k in (3, 2, 1)])).alias("end")).filter("end is not null")
    alone = ends.groupBy("package", "end").agg(F.count("*").alias("hits"), F.min("example").alias("example")).filter("hits = 1")
    found = wanted.join(alone, ["package", "end"]).groupBy("package", "file", "n").agg(F.max_by("example", "k").alias("example"))
    lang = F.regexp_extract("example", r"\.([^./]*)$", 1)
    code = F.concat(F.lit("```"), lang, F.lit("\n"), F.regexp_replace(F.left(F.col("text"), F.lit(INCLUDED)), r"\s+$", ""), F.lit("\n```"))
    filled = found.join(stems.select("package", "example", "text"), ["package", "example"]).select("package", "file", "n", code.alias("code"))
    whole = lines.join(filled, ["package", "file", "n"], "left").groupBy("package", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("code", "line").alias("x")))), lambda e: e["x"]), "\n").alias("text"))
    return pages.drop("text").join(whole, ["package", "file"])


def doc_file(file: Column) -> Column:
    """Whether a repository's file is documentation: by its extension, or an example in a folder of examples, outside of folders that hold none."""
    low = F.lower(file)
    example = (low.contains("example") | low.contains("snippet") | low.startswith("docs_src/")) & extension(low).isin("py", "ts", "tsx", "js", "jsx", "rs", "go")
    folders = F.slice(F.split(low, "/"), 1, F.size(F.split(low, "/")) - 1)
    return (example | extension(low).isin(*DOC_FILES)) & ~F.exists(folders, lambda d: d.isin(*NO_DOCS))


def is_lang(part: Column) -> Column:
    return part.rlike(r"^([a-z]{2}|..-..)$")


def doc_root(file: Column, package: Column, subdir: Column) -> Column:
    """The folder of documentation that a path of a repository is under, or null: one of ``DOC_ROOTS`` among the first three, after wrapping folders or the package's own."""
    dirs = F.slice(F.split(file, "/"), 1, F.size(F.split(file, "/")) - 1)
    short = F.lower(base_name(package))
    names = F.transform(F.slice(dirs, 1, 3), F.lower)

    def opens(i: int) -> Column:
        name, full = F.get(names, i), F.array_join(F.slice(dirs, 1, i + 1), "/")
        own = (name == short) | (name == F.lower(base_name(subdir))) | name.contains("docs") if i else F.lit(False)
        return F.coalesce(name.isin(*WRAPPERS) | own | (subdir == full) | subdir.startswith(F.concat(full, F.lit("/"))), F.lit(False))

    is_root = [F.coalesce(F.get(names, i).isin(*DOC_ROOTS), F.lit(False)) for i in range(3)]
    found = F.when(is_root[0], 1).when(is_root[1] & opens(0), 2).when(is_root[2] & opens(0) & opens(1), 3)
    return F.when(found.isNotNull(), F.array_join(F.slice(dirs, 1, found), "/"))


def package_docs(files: DataFrame) -> DataFrame:
    """``package, file, bytes`` of a repository's files (``package, subdir, file, bytes``) that document a package.

    Files under up to four roots of documentation, and notes beside the package. Where a root has folders of several
    languages, English among them, only English counts. Files are taken by path while their bytes fit; one that does
    not is passed over.
    """
    subdir = F.coalesce("subdir", F.lit(""))
    own = files.withColumns({"root": doc_root(F.col("file"), F.col("package"), F.nullif(subdir, F.lit(""))), "upper": F.upper(base_name(F.col("file"))), "dir": F.regexp_replace("file", r"/?[^/]*$", "")})
    inside = F.substr("file", F.length("root") + 2)
    near = ((F.col("dir") == "") | (F.col("dir") == subdir)) & doc_file(base_name(F.col("file"))) & F.col("upper").rlike("^(" + "|".join(NEAR_DOCS) + ")")
    rows = own.withColumns({"inside": inside, "near": near, "first": F.when(inside.contains("/"), F.substring_index(inside, "/", 1))})
    langs = rows.filter("root is not null and first is not null").groupBy("package", "root").agg(F.countDistinct(F.when(is_lang(F.col("first")), F.col("first"))).alias("langs"), F.max(F.col("first") == "en").alias("en"))
    roots = rows.filter("root is not null").select("package", "root").distinct().withColumn("k", F.row_number().over(W.partitionBy("package").orderBy("root"))).filter(F.col("k") <= MOST_ROOTS).drop("k")
    chosen = roots.join(langs, ["package", "root"], "left").withColumn("only_en", F.coalesce((F.col("langs") >= 2) & F.col("en"), F.lit(False))).select("package", "root", "only_en", F.lit(True).alias("chosen"))
    foreign = F.coalesce(F.col("only_en") & is_lang(F.col("first")) & (F.col("first") != "en"), F.lit(False))
    kept = rows.filter(F.col("bytes") <= MOST_FILE).join(chosen, ["package", "root"], "left").filter(F.col("near") | (F.coalesce("chosen", F.lit(False)) & doc_file(F.col("inside")) & ~foreign))
    return relational.running_include(kept.select("package", "file", "bytes").distinct(), "package", "file", "bytes", MOST_FILES, MOST_BYTES)


def later_major(file: Column, major: Column) -> Column:
    """Whether a path speaks of a later major than the pinned one (``v4-beta.md`` for 3)."""
    words = F.split(F.lower(file), "[^a-z0-9]+")
    return F.exists(words, lambda w: F.coalesce(F.regexp_extract(w, r"^v(\d+)$", 1).try_cast("long") > major, F.lit(False)))


def page_file(file: Column) -> Column:
    """Whether a file is a page written as a component, not a layout or helper."""
    base = base_name(file)
    return extension(file).isin("tsx", "jsx", "js") & ~base.startswith("layout.") & ~base.startswith("index.ts") & ~file.contains("/@") & ~file.contains("[")


# Sites of documentation in repositories of their own. (ecosystem, package, repository, branch, folders of
# each major's pages, folders of the current major's pages, folders of component pages, whether an older major's pages
# are those before the next major was released)
SITES = (
    ("npm", "react", "reactjs/react.dev", "main", (), ("src/content/reference", "src/content/learn"), (), False),
    ("npm", "react-dom", "reactjs/react.dev", "main", (), ("src/content/reference", "src/content/learn"), (), False),
    ("npm", "@types/react", "reactjs/react.dev", "main", (), ("src/content/reference", "src/content/learn"), (), False),
    ("npm", "express", "expressjs/expressjs.com", "main", ("src/content/api/{major}x",), ("src/content/docs/en",), (), False),
    ("npm", "@types/express", "expressjs/expressjs.com", "main", ("src/content/api/{major}x",), ("src/content/docs/en",), (), False),
    ("npm", "tailwindcss", "tailwindlabs/tailwindcss.com", "main", (), ("src/docs", "src/pages/docs"), ("src/app/(docs)/docs/installation", "src/pages/docs/installation"), True),
    ("npm", "prisma", "prisma/docs", "main", (), ("apps/docs/content/docs/orm", "content/200-orm"), (), True),
    ("npm", "@prisma/client", "prisma/docs", "main", (), ("apps/docs/content/docs/orm", "content/200-orm"), (), True),
    ("cargo", "tokio", "tokio-rs/website", "master", (), ("content/tokio/tutorial", "content/tokio/topics"), (), False),
)
# The archive, with its branches by major, that stands for the first site's older majors.
ARCHIVE, ARCHIVE_OF, ARCHIVES, ARCHIVE_DIRS = "reactjs/legacy.reactjs.org", "reactjs/react.dev", {16: "16.reactjs.org", 17: "17.reactjs.org", 18: "main"}, ("content/docs",)


def site_reference(deps: DataFrame, latest: DataFrame, branches: DataFrame, releases: DataFrame, commits: DataFrame) -> DataFrame:
    """Which state of which site describes each dependency (``eco, name, version``): ``repo, reference, how, dirs, pages``.

    ``latest``: ``eco, name, major``; ``branches``: ``repo, branch``; ``releases``: ``eco, name, version, at``, when
    versions came out; ``commits``: ``repo, sha, at``. An archive counts for its majors; the default branch for the
    latest major; else a branch ``v<major>`` or ``<major>.x``; else, where a site allows it, the last commit up to the
    next major's release (an as-of lookup: the greatest commit not after it); else only the folders of that major.
    """
    spark = deps.sparkSession
    sites = F.broadcast(spark.createDataFrame([(e, n, r, b, list(v), list(c), list(p), o) for e, n, r, b, v, c, p, o in SITES], "eco string, name string, site string, default_branch string, versioned array<string>, current array<string>, component array<string>, before boolean"))
    archives = F.broadcast(spark.createDataFrame([(ARCHIVE_OF, m, b) for m, b in ARCHIVES.items()], "site string, major long, archive string"))
    major = F.coalesce(F.regexp_extract("version", r"^(\d+)", 1).try_cast("long"), F.lit(0))
    own = deps.select("eco", "name", "version").distinct().withColumn("major", major).join(sites, ["eco", "name"]).join(archives, ["site", "major"], "left").join(latest.select("eco", "name", F.col("major").alias("newest")), ["eco", "name"], "left")
    named = branches.select(F.col("repo").alias("site"), "branch")
    at_branch = own.select("site", "major", F.explode(F.array(F.concat(F.lit("v"), F.col("major").cast("string")), F.concat(F.col("major").cast("string"), F.lit(".x")))).alias("branch")).distinct().join(named, ["site", "branch"]).groupBy("site", "major").agg(F.max("branch").alias("of_major"))
    next_ = releases.select("eco", "name", F.col("version").alias("next"), F.col("at").alias("until"))
    dated = own.filter("before").withColumn("next", F.concat((F.col("major") + 1).cast("string"), F.lit(".0.0"))).join(next_, ["eco", "name", "next"]).select("eco", "name", "version", "site", "until")
    as_of = dated.join(commits.select(F.col("repo").alias("site"), "sha", "at"), "site").filter("at <= until").groupBy("eco", "name", "version").agg(F.max_by("sha", F.struct("at", "sha")).alias("sha"), F.max("until").alias("until"))
    all_ = own.join(at_branch, ["site", "major"], "left").join(as_of, ["eco", "name", "version"], "left")
    is_latest = F.coalesce(F.col("major") >= F.col("newest"), F.lit(False))
    known = F.col("newest").isNotNull()
    kind = F.when(F.col("archive").isNotNull(), "archive").when(is_latest, "current").when(known & F.col("of_major").isNotNull(), "branch").when(known & F.col("sha").isNotNull(), "as of").when(F.size("versioned") > 0, "versioned")
    picked = all_.withColumn("kind", kind).filter("kind is not null")
    reference = F.when(F.col("kind") == "archive", F.col("archive")).when(F.col("kind") == "branch", F.col("of_major")).when(F.col("kind") == "as of", F.col("sha")).otherwise(F.col("default_branch"))
    none = F.array().cast("array<string>")
    of_major = F.transform("versioned", lambda d: F.replace(d, F.lit("{major}"), F.col("major").cast("string")))
    dirs = F.when(F.col("kind") == "archive", F.array(*[F.lit(d) for d in ARCHIVE_DIRS])).otherwise(F.concat(F.when(reference == F.col("default_branch"), of_major).otherwise(none), F.when(F.col("kind") == "versioned", none).otherwise(F.col("current"))))
    pages = F.when(F.col("kind").isin("archive", "versioned"), none).otherwise(F.col("component"))
    return picked.select("eco", "name", "version", "major", F.when(F.col("kind") == "archive", ARCHIVE).otherwise(F.col("site")).alias("repo"), reference.alias("reference"), F.col("kind").alias("how"), dirs.alias("dirs"), pages.alias("pages"))


def site_files(states: DataFrame, files: DataFrame) -> DataFrame:
    """``eco, name, version, file, page``: files (``repo, reference, file``) of the states of ``site_reference`` that count, and whether each is a component page."""
    under = lambda dirs: F.exists(dirs, lambda d: F.col("file").startswith(F.concat(d, F.lit("/"))))
    prose = doc_file(F.col("file")) & ~F.col("file").endswith(".txt") & under(F.col("dirs"))
    page = page_file(F.col("file")) & under(F.col("pages"))
    return states.join(files, ["repo", "reference"]).filter(~later_major(F.col("file"), F.col("major")) & (prose | page)).select("eco", "name", "version", "file", (~prose).alias("page"))


#: Version of cached documentation, and the oldest whose commit came from an exact release.
CACHE_FORMAT, TRUSTED_FORMAT = 7, 4


def refresh(cached: DataFrame, attempts: DataFrame, explicit: bool) -> DataFrame:
    """Manifests after an attempt to refresh: ``key, format, commit, site, files, note, refreshed``.

    ``cached``: ``key, format, commit, site, files, sites_checked``; ``attempts``: ``key, ok, error`` and the new
    manifest's ``commit, site, files``. An explicit request refreshes what is of an older format or had its sites
    unchecked, an automatic one only what cannot be trusted; a failed attempt keeps the earlier copy and says so, if
    that can be trusted, and has no row otherwise.
    """
    new = attempts.select("key", "ok", "error", F.col("commit").alias("new_commit"), F.col("site").alias("new_site"), F.col("files").alias("new_files"), F.lit(True).alias("tried"))
    trusted = F.coalesce((F.col("format") >= TRUSTED_FORMAT) & (F.col("commit").isNotNull() | F.col("site").isNotNull() | (F.col("files") == 0)), F.lit(False))
    due = F.coalesce((F.col("format") < CACHE_FORMAT) | ~F.col("sites_checked"), F.lit(True)) if explicit else ~trusted
    both = cached.join(new, "key", "full").withColumns({"due": due, "trusted": trusted})
    takes = F.coalesce(F.col("due") & F.col("ok"), F.lit(False))
    failed = F.coalesce(F.col("due") & F.col("tried") & ~F.col("ok"), F.lit(False))
    pick = lambda new_, old: F.when(takes, new_).otherwise(old)
    note = F.when(failed, F.concat(F.lit("refresh failed: "), F.coalesce("error", F.lit("unknown")), F.lit("; earlier copy kept")))
    return both.filter(takes | ~failed & F.col("format").isNotNull() | failed & trusted).select("key", pick(F.lit(CACHE_FORMAT), F.col("format")).alias("format"), pick(F.col("new_commit"), F.col("commit")).alias("commit"), pick(F.col("new_site"), F.col("site")).alias("site"), pick(F.col("new_files"), F.col("files")).alias("files"), note.alias("note"), takes.alias("refreshed"))
