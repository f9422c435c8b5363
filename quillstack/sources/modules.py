"""Module graphs of declaration files: what each exports and imports, and the entrypoints of a package manifest."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut, spread

SCHEMA = "package string, file string, n int, what string, name string, kind string, source string, candidates array<string>, assignment string, incomplete boolean"
# What a script's suffix in an import stands for, and what may be added to a path without one.
SIBLINGS = {".mjs": (".d.mts", ".d.ts"), ".cjs": (".d.cts", ".d.ts"), ".js": (".d.ts",)}
ADDED = ("", ".d.ts", "/index.d.ts", ".ts", "/index.ts")
#: Suffixes of files that can be imported by path where a manifest has no export map.
IMPORTABLE = (".d.ts", ".d.cts", ".d.mts", ".tsx", ".ts", ".cts", ".mts", ".js", ".cjs", ".mjs")

_COMMENT = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|/\*.*?\*/|//[^\n]*""", re.S)
_STATEMENT = re.compile(r"^[ \t]*(import|export)\b(?!\s*\()", re.M)
_FROM = re.compile(r"""\bfrom\s*['"]([^'"]+)['"]""")
_DECLARED = re.compile(r"^(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:(function\s*\*?|class|interface|type|enum|const\s+enum|namespace|module)\s+([\w$.]+)|(?:const|let|var)\s+(.+))", re.S)


def candidates(file: str, spec: str) -> tuple[str, list[str]]:
    """The module that an import of ``spec`` in ``file`` means if no such file is there, and the files that it may mean, in order."""
    if not spec.startswith("."):
        return f"external:{spec}", []
    base = posixpath.normpath(posixpath.join(posixpath.dirname(file), spec))
    if base == ".." or base.startswith("../"):
        return "", []
    stem, suffix = posixpath.splitext(base)
    return base, [*(stem + s for s in SIBLINGS.get(suffix, ())), *(base + a for a in ADDED)]


def listed(clause: str) -> Iterator[tuple[str, str]]:
    """Pairs (name in the module, name given) of ``{a, b as c, type d}``."""
    for item in clause.strip().strip("{}").split(","):
        names = re.sub(r"^type\s+(?=\S)(?!as\b)", "", item.strip()).split(" as ")
        if names[0].strip():
            yield names[0].strip().strip("'\""), names[-1].strip().strip("'\"")


def statements(text: str) -> Iterator[tuple[str, str]]:
    """Top-level import and export statements: their keyword and what follows it, up to a body or the end."""
    depth, at = 0, 0
    for m in _STATEMENT.finditer(text):
        between = text[at : m.start()]
        depth += between.count("{") - between.count("}")
        at = m.start()
        if depth <= 0:
            yield m[1], text[m.end() :].lstrip()


def variables(rest: str) -> Iterator[str]:
    """Names declared by ``a: T, b = 1;``, with commas inside brackets passed over."""
    depth, name = 0, True
    for token in re.finditer(r"[\w$]+|[(\[{<]|[)\]}>]|[,;\n=]|.", rest):
        t = token[0]
        depth += t in "([{<"
        depth -= t in ")]}>"
        if depth == 0 and t in ";\n":
            return
        if depth == 0 and t == ",":
            name = True
        elif name and re.match(r"[\w$]", t):
            yield t
            name = False


def parse(file: str, text: str) -> list[tuple]:
    """Rows (what, name, kind, source name, module, candidates) of one file, and whether something could not be read."""
    text = _COMMENT.sub(lambda m: m[1] or " ", text)
    rows: list[tuple] = []
    incomplete, assignment = file.endswith((".js", ".cjs", ".mjs")) and "exports." in text.replace("module.exports", "exports."), None

    def add(what: str, name: str, kind: str, source: str | None, spec: str | None) -> None:
        base, files = candidates(file, spec) if spec is not None else (None, [])
        rows.append((what, name, kind, source, base, files))

    for word, rest in statements(text):
        rest = re.sub(r"^type\s+(?=[{*\w])(?![\w$]+\s*(?:=|<))", "", rest) if word == "import" or rest.startswith(("type {", "type *")) else rest
        end = re.search(r"""['"][^'"\n]*['"]|;|\n\s*\n""", rest)
        head = rest[: end.end()] if end else rest
        found = _FROM.search(head)
        clause = head[: found.start()].strip() if found else head
        spec = found[1] if found else None
        if word == "import":
            if spec is None:
                incomplete = True
                continue
            if m := re.search(r"\*\s*as\s+([\w$]+)", clause):
                add("import", m[1], "namespace", None, spec)
            if m := re.search(r"\{[^}]*\}", clause):
                for source, name in listed(m[0]):
                    add("import", name, "named", source, spec)
            if m := re.match(r"([\w$]+)\s*(?:,|$)", clause):
                add("import", m[1], "named", "default", spec)
        elif rest.startswith("as namespace "):
            continue
        elif rest.startswith("*"):
            m = re.match(r"\*\s*as\s+([\w$]+)", clause)
            if spec is None:
                incomplete = True
            elif m:
                add("export", m[1], "namespace", None, spec)
            else:
                add("star", "", "star", None, spec)
        elif rest.startswith("{"):
            body = re.match(r"\{[^}]*\}", rest)
            after = _FROM.match(rest[body.end() :].lstrip()) if body else None
            for source, name in listed(body[0]) if body else ():
                add("export", name, "named" if after else "local", source, after[1] if after else None)
            incomplete |= body is None
        elif m := re.match(r"=\s*([^;\n]+)", rest):
            assignment = m[1].strip()
            add("export", "default", "local", assignment, None)
        else:
            default = rest.startswith("default ")
            own = _DECLARED.match(rest.removeprefix("default ").lstrip())
            names = ([own[2]] if own[2] else list(variables(own[3]))) if own else []
            if default and not names:
                value = re.match(r"default\s+([^;\n]+)", rest)
                names = [value[1].strip()] if value else []
            for name in names:
                add("export", "default" if default else name, "local", name, None)
            incomplete |= not names
    return [*rows, ("module", "", "", None, assignment, None, incomplete)]


def read(files: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` for declaration files (``package, file, text``): a ``module`` row a file, and its exports, imports and stars."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for package, file, text in zip(frame.package, frame.file, frame.text, strict=True):
                for n, row in enumerate(parse(file, text or "")):
                    if row[0] == "module":
                        out.append((package, file, n, "module", None, None, None, None, row[4], row[6]))
                    else:
                        what, name, kind, source, base, options = row
                        out.append((package, file, n, what, name, kind, source, [*options, base] if base is not None else None, None, None))
            yield pd.DataFrame(out, columns=["package", "file", "n", "what", "name", "kind", "source", "candidates", "assignment", "incomplete"])

    return spread(files.select("package", "file", "text")).mapInPandas(run, SCHEMA)


def graph(files: DataFrame) -> dict[str, DataFrame]:
    """The module graph of declaration files: ``modules`` (``package, file, incomplete, assignment``), ``exports`` and
    ``imports`` (``package, file, name, kind, target_file, target_name``; kind is local, named or namespace) and ``stars``
    (``package, file, target``).

    The candidates of an import meet the package's files by an equi-join; the first that exists counts, else the path
    itself. Of several exports of a name the last counts.
    """
    rows = cut(read(files))
    there = files.select("package", F.col("file").alias("option")).distinct()
    options = rows.filter("candidates is not null").select("package", "file", "n", F.posexplode("candidates").alias("k", "option"))
    met = options.join(there, ["package", "option"]).groupBy("package", "file", "n").agg(F.min_by("option", "k").alias("found"))
    targets = rows.join(met, ["package", "file", "n"], "left").withColumn("target_file", F.coalesce("found", F.element_at("candidates", -1)))
    bindings = targets.filter("what in ('export', 'import')").groupBy("package", "file", "what", "name").agg(F.max_by(F.struct("kind", "target_file", F.col("source").alias("target_name")), "n").alias("b")).select("package", "file", "what", "name", "b.*")
    return {
        "modules": rows.filter("what = 'module'").select("package", "file", "incomplete", "assignment"), "exports": bindings.filter("what = 'export'").drop("what"),
        "imports": bindings.filter("what = 'import'").drop("what"), "stars": targets.filter("what = 'star'").select("package", "file", F.col("target_file").alias("target")).distinct(),
    }


def leaves(value: object, condition: str = "") -> Iterator[tuple[str, str]]:
    """Targets of an export map's value with the conditions that lead to each; ``types`` beside others stands for all of them."""
    if isinstance(value, str):
        yield condition, value
    elif isinstance(value, dict):
        for key, inner in ({"types": value["types"]} if "types" in value else value).items():
            yield from leaves(inner, f"{condition}/{key}")
    elif isinstance(value, list):
        for i, inner in enumerate(value):
            yield from leaves(inner, f"{condition}/fallback-{i}")


def routes_of(manifest: str | None) -> list[tuple[str, str, str | None, list[str], bool]]:
    """Routes (path, conditions, target, candidates, whether paths are importable as they are) of a manifest's text."""
    try:
        own = json.loads(manifest or "{}")
    except ValueError:
        own = {}
    own = own if isinstance(own, dict) else {}
    mapped = own.get("exports")
    if mapped is None:
        entry = next((own[k] for k in ("types", "typings", "main") if isinstance(own.get(k), str)), "./index.d.ts")
        paths = {".": "./" + entry.removeprefix("./")}
    else:
        paths = mapped if isinstance(mapped, dict) and any(k.startswith(".") for k in mapped) else {".": mapped}
    out = []
    for path, value in sorted(paths.items()):
        if path == "./package.json":
            continue
        found = list(leaves(value))
        for conditions, target in found:
            base, files = candidates("", "./" + target.removeprefix("./"))
            out.append((path, conditions, target.removeprefix("./"), [*files, base], mapped is None))
        if not found:
            out.append((path, "", None, [], mapped is None))  # blocked: a route without a target still takes its paths
    return out


def roots(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """``package, import, conditions, file, legacy`` of packages' entrypoints, from ``manifests`` (``package, manifest``) and ``files`` (``package, file``).

    A pattern with ``*`` meets the package's files; where several routes fit a path, an exact one counts, then the one
    with the longest part before its ``*``, then after it. Without an export map every importable file is an entrypoint too.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(p, *r) for p, m in zip(frame.package, frame.manifest, strict=True) for r in routes_of(m)]
            yield pd.DataFrame(out, columns=["package", "path", "conditions", "target", "candidates", "legacy"])

    schema = "package string, path string, conditions string, target string, candidates array<string>, legacy boolean"
    routes = cut(manifests.select("package", "manifest").mapInPandas(run, schema).withColumn("route", F.monotonically_increasing_id()))
    own = files.select("package", "file").distinct()
    before, after = lambda c: F.substring_index(c, "*", 1), lambda c: F.substring_index(c, "*", -1)
    public = lambda path: F.concat("package", F.regexp_replace(path, r"^\.", ""))

    plain = routes.filter("target is not null and not (path like '%*%' and target like '%*%')")
    met = plain.select("route", "package", F.posexplode("candidates").alias("k", "file")).join(own, ["package", "file"]).groupBy("route").agg(F.min_by("file", "k").alias("found"))
    direct = plain.join(met, "route", "left").select("package", public(F.col("path")).alias("import"), "conditions", F.coalesce("found", F.element_at("candidates", -1)).alias("file"), "legacy")

    wild = routes.filter("target is not null and path like '%*%' and target like '%*%'")
    fits = own.join(wild, "package").filter(F.col("file").startswith(before("target")) & F.col("file").endswith(after("target")) & (F.length("file") >= F.length("target") - 1))
    middle = F.substr("file", F.length(before("target")) + 1, F.length("file") - F.length("target") + 1)
    opened = fits.withColumn("public", F.concat(before("path"), middle, after("path")))
    rivals = routes.select("package", F.col("path").alias("other")).distinct()
    suits = F.when(F.col("other").contains("*"), F.col("public").startswith(before("other")) & F.col("public").endswith(after("other"))).otherwise(F.col("other") == F.col("public"))
    rank = F.struct((~F.col("other").contains("*")).alias("exact"), F.length(before("other")).alias("a"), F.length(after("other")).alias("b"))
    best = opened.select("package", "public").distinct().join(rivals, "package").filter(suits).groupBy("package", "public").agg(F.max_by("other", rank).alias("path"))
    matched = opened.join(best, ["package", "public", "path"]).select("package", public(F.col("public")).alias("import"), "conditions", "file", "legacy")

    free = own.join(routes.filter("legacy").select("package").distinct(), "package", "left_semi")
    suffix = "(" + "|".join(s.replace(".", r"\.") for s in IMPORTABLE) + ")$"
    stems = free.filter(F.col("file").rlike(suffix)).withColumn("stem", F.regexp_replace("file", suffix, ""))
    names = F.array_compact(F.array(F.col("stem"), F.when(F.col("stem").endswith("/index"), F.regexp_replace("stem", "/index$", ""))))
    loose = stems.select("package", F.explode(names).alias("path"), F.lit("legacy").alias("conditions"), "file").select("package", F.concat_ws("/", "package", "path").alias("import"), "conditions", "file", F.lit(True).alias("legacy"))
    return direct.unionByName(matched).unionByName(loose).distinct()
