"""Dependencies from lockfiles: native expressions where a format is line- or JSON-shaped, small parsers elsewhere."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X

SCHEMA = "file string, eco string, name string, version string, direct boolean, origin string"
# Lockfiles of each ecosystem by priority; the first that can be parsed counts.
PRIORITY = {
    "npm": ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "bun.lock", "yarn.lock"), "pypi": ("uv.lock", "poetry.lock", "pdm.lock", "Pipfile.lock"),
    "cargo": ("Cargo.lock",), "go": ("go.mod",),
}
DECLARED = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
Row = tuple[str, str, str, bool, str]


def is_git(url: object) -> bool:
    return isinstance(url, str) and bool(re.match(r"(git[+@:]|git://|github:|gitlab:|bitbucket:)|.*\.git(#|$)", url))


def name_and_version(spec: str) -> tuple[str, str] | None:
    """``name@version``; the name of a scoped package starts with an ``@`` itself."""
    at = spec.find("@", 1)
    return (spec[:at], spec[at + 1 :]) if at > 0 else None


def without_peers(version: str) -> str:
    return version.partition("(")[0]


def py_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name.lower())


def declared(manifest: dict) -> set[str]:
    return {n for k in DECLARED for n in (manifest.get(k) or {})}


def npm(text: str, file: str, manifest: str | None) -> Iterator[Row]:
    lock = json.loads(text)
    mark = lambda p: f"{file} (git)" if is_git(p.get("resolved")) or is_git(p.get("version")) else file
    if isinstance(lock.get("packages"), dict):
        direct = {n for k, p in lock["packages"].items() if "node_modules/" not in k for n in declared(p)}
        for key, p in lock["packages"].items():
            name = key.removeprefix("node_modules/")
            if name == key or "/node_modules/" in name or p.get("link") is True or not isinstance(p.get("version"), str):
                continue
            name = p.get("name") or name
            yield "npm", name, p["version"], name in direct, mark(p)
    else:
        for name, p in (lock.get("dependencies") or {}).items():
            if isinstance(p.get("version"), str):
                yield "npm", name, p["version"], True, mark(p)


def pnpm(text: str, file: str, manifest: str | None) -> Iterator[Row]:
    import yaml

    lock = yaml.load(text, Loader=yaml.BaseLoader) or {}
    direct: dict[str, str] = {}
    for importer in (lock.get("importers") or {"": lock}).values():
        for part in ("dependencies", "devDependencies", "optionalDependencies"):
            for name, v in (importer.get(part) or {}).items():
                version = without_peers(v.get("version", "") if isinstance(v, dict) else v)
                if version and not version.startswith(("link:", "file:")):
                    direct.setdefault(name, version)
    seen = set()
    for name, version in sorted(direct.items()):
        seen.add((name, version.rpartition("/")[2]))
        yield "npm", name, version.rpartition("/")[2], True, file
    for key in lock.get("packages") or lock.get("snapshots") or {}:
        key = without_peers(key.lstrip("/"))
        name, version = name_and_version(key) or (key.rpartition("/")[0], key.rpartition("/")[2])
        if name and ":" not in version and (name, version) not in seen:
            seen.add((name, version))
            yield "npm", name, version, False, file


def bun(text: str, file: str, manifest: str | None) -> Iterator[Row]:
    plain = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)
    lock = json.loads(plain)
    direct = {n for w in (lock.get("workspaces") or {}).values() for n in declared(w)}
    for key, entry in (lock.get("packages") or {}).items():
        if key.count("/") > key.startswith("@") or not entry or not isinstance(entry[0], str):
            continue
        found = name_and_version(entry[0])
        if found and ":" not in found[1]:
            yield "npm", *found, found[0] in direct, file


def yarn(text: str, file: str, manifest: str | None) -> Iterator[Row]:
    direct, seen = declared(json.loads(manifest)) if manifest else set(), set()
    for block in re.split(r"\n(?=[^\s#])", text):
        head, _, body = block.lstrip("\n").partition("\n")
        version = re.search(r'^\s+version:? "?([^"\n]+?)"?\s*$', body, re.M)
        if head.startswith(("#", "__metadata")) or not version:
            continue
        names = dict.fromkeys(s[0] for x in head.rstrip(":").split(", ") if (s := name_and_version(x.strip().strip('"'))))
        for name in names:
            if (name, version[1]) not in seen:
                seen.add((name, version[1]))
                yield "npm", name, version[1], name in direct, f"{file} (git)" if any(is_git(x.partition("@")[2] or x) for x in re.findall(r"@(\S+?)[\",:]*(?:,|$)", head)) else file


def cargo(text: str, file: str, manifest: str | None) -> Iterator[Row]:
    packages = tomllib.loads(text).get("package", [])
    direct = {d.split(" ")[0] for p in packages if "source" not in p for d in p.get("dependencies", [])}
    for p in packages:
        source = p.get("source", "")
        if source.startswith(("registry+", "sparse+", "git+")) and "name" in p and "version" in p:
            yield "cargo", p["name"], p["version"], p["name"] in direct, f"{file} (git)" if source.startswith("git+") else file


def uv(text: str, file: str, manifest: str | None) -> Iterator[Row]:
    packages = tomllib.loads(text).get("package", [])
    local = [p for p in packages if {"editable", "virtual", "directory"} & p.get("source", {}).keys()]
    lists = [a for p in local for a in [p.get("dependencies", []), *(x for k in ("optional-dependencies", "dev-dependencies") for x in p.get(k, {}).values())]]
    direct, own = {py_name(d["name"]) for a in lists for d in a if "name" in d}, {p.get("name") for p in local}
    for p in packages:
        if "name" in p and "version" in p and p["name"] not in own:
            yield "pypi", p["name"], p["version"], py_name(p["name"]) in direct, f"{file} (git)" if "git" in p.get("source", {}) else file


def pyproject_names(text: str | None) -> set[str]:
    """Declared by a pyproject file: project, optional and grouped requirements, and Poetry's tables."""
    project = tomllib.loads(text) if text else {}
    listed = [project.get("project", {}).get("dependencies", []), *project.get("project", {}).get("optional-dependencies", {}).values(), *project.get("dependency-groups", {}).values()]
    names = {py_name(m[0]) for a in listed for r in a if isinstance(r, str) and (m := re.match(r"[A-Za-z0-9._-]+", r.strip()))}
    poetry = project.get("tool", {}).get("poetry", {})
    tables = [poetry.get("dependencies", {}), poetry.get("dev-dependencies", {}), *(g.get("dependencies", {}) for g in poetry.get("group", {}).values())]
    return (names | {py_name(n) for t in tables for n in t}) - {"python"}


def poetry(text: str, file: str, manifest: str | None) -> Iterator[Row]:
    direct = pyproject_names(manifest)
    for p in tomllib.loads(text).get("package", []):
        if "name" in p and "version" in p:
            source = p.get("source", {})
            git = "git" in p or "git" in source or source.get("type") == "git"
            yield "pypi", p["name"], p["version"], not direct or py_name(p["name"]) in direct, f"{file} (git)" if git else file


def pipfile(text: str, file: str, manifest: str | None) -> Iterator[Row]:
    lock = json.loads(text)
    for part in ("default", "develop"):
        for name, p in (lock.get(part) or {}).items():
            if isinstance(p.get("version"), str):
                yield "pypi", name, p["version"].lstrip("="), True, f"{file} (git)" if "git" in p else file


PARSERS = {"package-lock.json": npm, "npm-shrinkwrap.json": npm, "pnpm-lock.yaml": pnpm, "bun.lock": bun, "yarn.lock": yarn, "Cargo.lock": cargo, "uv.lock": uv, "poetry.lock": poetry, "pdm.lock": poetry, "Pipfile.lock": pipfile}


ECOSYSTEM = {name: eco for eco, names in PRIORITY.items() for name in names}


def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ``SCHEMA`` for each ``file, text, manifest``, and one without a name that says that the file was parsed; one that can't be gives only its name."""
    for frame in frames:
        rows = []
        for file, text, manifest in zip(frame.file, frame.text, frame.manifest, strict=True):
            base = file.rpartition("/")[2]
            try:
                rows += [(file, *r) for r in [*PARSERS[base](text, base, manifest), (ECOSYSTEM[base], None, None, None, base)]]
            except (ValueError, KeyError, TypeError, AttributeError):
                rows.append((file, None, None, None, None, None))
        yield pd.DataFrame(rows, columns=["file", "eco", "name", "version", "direct", "origin"])


def bare(line: str | Column) -> Column:
    """A line without white space around it, tabs included."""
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def requirements(files: DataFrame) -> DataFrame:
    """Pinned lines (``name==version``) of requirement files (``file, text``), in the rows of ``SCHEMA`` with their ``line``."""
    lines = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    plain = lines.withColumn("raw", bare(F.split("raw", " #")[0])).filter(~F.regexp("raw", F.lit("^(#|-|$)"))).withColumn("raw", F.split("raw", ";")[0])
    name = F.trim(F.regexp_extract("raw", r"^([^\[=]*)(?:\[[^=]*)?==", 1))
    version = F.regexp_extract("raw", r"==\s*=*([^,\s\\=][^,\s\\]*)", 1)
    base = F.regexp_extract("file", r"([^/]*)$", 1)
    return plain.select("file", F.lit("pypi").alias("eco"), name.alias("name"), version.alias("version"), F.lit(True).alias("direct"), base.alias("origin"), "line").filter("name <> '' and version <> ''")


def go_mod(files: DataFrame) -> DataFrame:
    """Requirements of go.mod files (``file, text``): a running block keyword marks lines inside parentheses.

    A replacement by another version of the same module overrides its version.
    """
    lines = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "raw")).withColumn("raw", bare("raw"))
    opened = F.when(F.regexp("raw", F.lit(r"^(require|replace)\s*\($")), F.regexp_extract("raw", r"^(\w+)", 1)).when((F.col("raw") == ")") | F.regexp("raw", F.lit(r"^\w+\s*\($")), "none")
    block = F.coalesce(F.last(opened, ignorenulls=True).over(W.partitionBy("file").orderBy("n")), F.lit("none"))
    single = F.regexp_extract("raw", r"^(require|replace)\s+[^(]", 1)
    each = lines.withColumn("kind", F.when(single != "", single).when(opened.isNull(), block).otherwise("none")).withColumn("spec", F.regexp_replace("raw", r"^(require|replace)\s+", ""))
    required = each.filter("kind = 'require'").withColumn("p", F.split(F.trim(F.split("spec", "//")[0]), r"\s+")).filter(F.size("p") >= 2)
    replaced = each.filter("kind = 'replace'").withColumn("o", F.regexp_extract("spec", r"^(\S+).*=>", 1)).withColumn("m", F.regexp_extract("spec", r"=>\s*(\S+)", 1)).withColumn("v", F.regexp_extract("spec", r"=>\s*\S+\s+(\S+)", 1)).filter("o = m and v <> ''")
    new = replaced.groupBy("file", F.col("o").alias("name")).agg(F.max_by("v", "n").alias("__v"))
    deps = required.select("file", "n", F.col("p")[0].alias("name"), F.col("p")[1].alias("version"), (~F.col("raw").contains("// indirect")).alias("direct"))
    return deps.join(new, ["file", "name"], "left").select("file", F.lit("go").alias("eco"), "name", F.coalesce("__v", "version").alias("version"), "direct", F.lit("go.mod").alias("origin"), F.col("n").alias("line"))


def npm_packages(files: DataFrame) -> DataFrame:
    """Package-lock files (``file, text``) through ``VARIANT``: ``file, name, version`` of hoisted packages, with ``direct``."""
    locks = files.select("file", F.try_parse_json("text").alias("v"))
    each = files.sparkSession.sql("SELECT file, e.key, e.value FROM {locks}, LATERAL variant_explode_outer(variant_get(v, '$.packages')) AS e", locks=locks)
    str_ = lambda p: F.try_variant_get("value", p, "string")
    own = each.filter(F.col("key").startswith("node_modules/") & ~F.col("key").contains("/node_modules/")).filter(~F.coalesce(F.try_variant_get("value", "$.link", "boolean"), F.lit(False)))
    packages = own.select("file", F.coalesce(str_("$.name"), F.substr("key", F.lit(14))).alias("name"), str_("$.version").alias("version")).filter("version is not null")
    sections = [F.coalesce(F.map_keys(F.from_json(F.try_variant_get("value", f"$.{k}", "string"), "map<string,string>")), F.array().cast("array<string>")) for k in DECLARED]
    declared_ = each.filter(~F.col("key").contains("node_modules/")).select("file", F.explode(F.flatten(F.array(*sections))).alias("name")).distinct().withColumn("direct", F.lit(True))
    return packages.join(declared_, ["file", "name"], "left").select("file", "name", "version", F.coalesce("direct", F.lit(False)).alias("direct"))


def dependencies(files: DataFrame) -> DataFrame:
    """All dependencies of projects' files (``project, depth, file, text, manifest``), one row for a package and version.

    In each project, ecosystem and directory depth the first lockfile that can be parsed counts, be it empty; requirement files
    count together where a project has no other Python lockfile. Direct dependencies come before others, then nearer ones.
    """
    base = F.regexp_extract("file", r"([^/]*)$", 1)
    rank = F.coalesce(*[F.when(base == n, i) for names in PRIORITY.values() for i, n in enumerate(names)], F.lit(0))
    keyed = files.withColumns({"base": base, "rank": rank})
    locks = keyed.filter(F.col("base").isin(*PARSERS)).select("file", "text", "manifest").mapInPandas(parse, SCHEMA)
    lined = requirements(keyed.filter(F.col("base").rlike(r"^requirements.*\.txt$"))).drop("line").unionByName(go_mod(keyed.filter("base = 'go.mod'")).drop("line"))
    empty = keyed.filter("base = 'go.mod'").select("file", F.lit("go").alias("eco"), *[F.lit(None).cast(t).alias(n) for n, t in (("name", "string"), ("version", "string"), ("direct", "boolean"))], F.lit("go.mod").alias("origin"))
    all_ = locks.filter("eco is not null").unionByName(lined).unionByName(empty).join(keyed.select("project", "depth", "file", "base", "rank"), "file")
    loose = F.col("base").rlike(r"^requirements.*\.txt$")
    first = F.min(F.when(~loose, F.struct("depth", "rank"))).over(W.partitionBy("project", "eco"))
    kept = all_.withColumn("first", first).filter(F.when(loose, F.col("first").isNull()).otherwise(F.struct("depth", "rank") == F.col("first")))
    kept = kept.filter("name is not null")
    order = F.struct((~F.col("direct")).alias("d"), "depth", "file", "name")
    best = kept.withColumn("norm_name", X.norm_name(F.col("eco"), F.col("name"))).groupBy("project", "eco", "norm_name", "version").agg(F.min_by(F.struct("name", "direct", "origin"), order).alias("b"))
    return best.select("project", "eco", "b.name", "version", "b.direct", "b.origin", "norm_name")
