"""Projects on a machine: which lockfiles count, what is installed, and where each pinned package's files are.

All operators work on one listing of files, ``path, text`` (text where a file's content is needed: manifests, lockfiles,
``RECORD``, ``Cargo.toml``), and on many projects at once (``project, root``). Places that could hold something are
computed as paths and met with the listing by equi-joins; the first place in order wins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators.lineage import cut
from . import lockfiles

# Directories above a project that are searched, files that declare an ecosystem, names of virtual environments.
ABOVE = 5
DECLARES = {"npm": ("package.json",), "cargo": ("Cargo.toml",), "go": ("go.mod",), "pypi": ("pyproject.toml", "setup.py", "setup.cfg", "Pipfile")}
VENVS, VENDORED, NEAR = (".venv", "venv", "env", ".env"), ("vendor", "third_party"), 3


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def ancestors(roots: DataFrame, most: int) -> DataFrame:
    """``project, k, dir``: a project's directory (k = 0) and those above it."""
    parts = F.split("root", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.size(parts) - 2)), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))
    return roots.select("project", F.posexplode(dirs).alias("k", "dir"))


def discover(roots: DataFrame, files: DataFrame, home: str | None = None) -> DataFrame:
    """Rows for ``lockfiles.dependencies`` (``project, depth, file, text, manifest``).

    A project's directory and up to five above it, not the home directory, up to the first that holds a repository;
    above the project only lockfiles of ecosystems that it declares itself. Lockfiles of an ecosystem found nearer win there.
    """
    up = ancestors(roots, ABOVE)
    own = files.select("path", "text").withColumns({"dir": parent(F.col("path")), "base": F.regexp_extract("path", r"([^/]*)$", 1)})
    stops = own.filter(F.col("path").rlike(r"/\.git(/|$)")).select(F.regexp_replace("path", r"/\.git(/.*)?$", "").alias("dir")).distinct()
    last = up.join(stops, "dir").groupBy("project").agg(F.min("k").alias("last"))
    if home is not None:
        last = last.unionByName(up.filter((F.col("dir") == home) & (F.col("k") > 0)).select("project", (F.col("k") - 1).alias("last"))).groupBy("project").agg(F.min("last").alias("last"))
    reach = up.join(last, "project", "left").filter(F.col("last").isNull() | (F.col("k") <= F.col("last"))).drop("last")
    locks = [(name, eco) for eco, names in lockfiles.PRIORITY.items() for name in names]
    eco = F.coalesce(*[F.when(F.col("base") == n, e) for n, e in locks], F.when(F.col("base").rlike(r"^requirements.*\.txt$"), "pypi"))
    found = reach.join(own.withColumn("eco", eco).filter("eco is not null"), "dir")
    declared = F.coalesce(*[F.when(F.col("base") == n, e) for e, names in DECLARES.items() for n in names])
    declares = roots.select("project", F.col("root").alias("dir")).join(own.withColumn("eco", declared).filter("eco is not null"), "dir").select("project", "eco").distinct()
    near = found.filter("k = 0").unionByName(found.filter("k > 0").join(declares, ["project", "eco"], "left_semi").select(found.columns))
    manifest = F.when(F.col("base") == "yarn.lock", "package.json").when(F.col("base").isin("poetry.lock", "pdm.lock"), "pyproject.toml")
    beside = own.select(F.col("dir").alias("__d"), F.col("base").alias("__b"), F.col("text").alias("manifest"))
    both = near.withColumn("wants", manifest).join(beside, (F.col("dir") == F.col("__d")) & (F.col("wants") == F.col("__b")), "left")
    return both.select("project", F.col("k").alias("depth"), F.col("path").alias("file"), "text", "manifest")


def npm_installed(roots: DataFrame, files: DataFrame) -> DataFrame:
    """``project, name, k, dir, version``: packages in the ``node_modules`` of a project's directory and those above it."""
    own = files.withColumns({"base": F.regexp_extract("path", r"^(.*)/node_modules/((?:@[^/]+/)?[^/@.][^/]*)/package\.json$", 1), "name": F.regexp_extract("path", r"^(.*)/node_modules/((?:@[^/]+/)?[^/@.][^/]*)/package\.json$", 2)}).filter("name <> ''")
    version = F.get_json_object("text", "$.version")
    return ancestors(roots, 64).join(own.select(F.col("base").alias("dir"), "name", version.alias("version"), parent(F.col("path")).alias("place")).filter("version is not null"), "dir").select("project", "name", "k", F.col("place").alias("dir"), "version")


def site_packages(roots: DataFrame, files: DataFrame, prefixes: list[str] | None = None, system: list[str] | None = None) -> DataFrame:
    """``project, rank, site``: a project's folders of installed Python packages: virtual environments in and up to two
    directories above it, then active environments (``prefixes``), then the system's (``system``)."""
    spark = roots.sparkSession
    sites = files.select(F.regexp_extract("path", r"^(.*/(?:lib(?:64)?/python[^/]*|Lib)/site-packages)/", 1).alias("site")).filter("site <> ''").distinct()
    prefix = F.regexp_replace("site", r"/(lib(64)?/python[^/]*|Lib)/site-packages$", "")
    venvs = ancestors(roots, NEAR - 1).select("project", "k", F.posexplode(F.array(*[F.concat("dir", F.lit(f"/{v}")) for v in VENVS])).alias("v", "prefix"))
    real = files.filter(F.col("path").endswith("/pyvenv.cfg")).select(parent(F.col("path")).alias("prefix")).distinct()
    local = venvs.join(real, "prefix").select("project", F.struct(F.lit(0).alias("of"), "k", "v").alias("place"), "prefix")
    rows = [(1, i, p) for i, p in enumerate(prefixes or [])]
    active = roots.select("project").crossJoin(F.broadcast(spark.createDataFrame(rows, "of int, k int, prefix string"))).select("project", F.struct("of", "k", F.lit(0).alias("v")).alias("place"), "prefix")
    by_prefix = local.unionByName(active).join(sites.withColumn("prefix", prefix), "prefix").select("project", "place", "site")
    whole = spark.createDataFrame([(2, i, p) for i, p in enumerate(system or [])], "of int, k int, site string")
    rest = roots.select("project").crossJoin(F.broadcast(whole)).select("project", F.struct("of", "k", F.lit(0).alias("v")).alias("place"), "site")
    first = by_prefix.unionByName(rest).groupBy("project", "site").agg(F.min("place").alias("place"))
    return first.select("project", F.row_number().over(W.partitionBy("project").orderBy("place", "site")).alias("rank"), "site")


def dist_infos(files: DataFrame) -> DataFrame:
    """``site, norm_name, version, info, record, metadata``: installed Python distributions, with the text of their ``RECORD`` and whether they have ``METADATA``."""
    pattern = r"^(.*/site-packages)/([^/]+)-([^-/]+)\.dist-info/([^/]+)$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    own = files.select(part(1).alias("site"), part(2).alias("name"), part(3).alias("version"), part(4).alias("base"), parent(F.col("path")).alias("info"), "text").filter("site <> ''")
    return own.groupBy("site", X.norm_name(F.lit("pypi"), F.col("name")).alias("norm_name"), "version", "info").agg(F.max(F.when(F.col("base") == "RECORD", F.col("text"))).alias("record"), F.bool_or(F.col("base") == "METADATA").alias("metadata"))


def fallbacks(roots: DataFrame, files: DataFrame, found: DataFrame, prefixes: list[str] | None = None, system: list[str] | None = None) -> DataFrame:
    """Dependencies (rows of ``lockfiles.dependencies``) of projects without a lockfile of an ecosystem, from what is installed.

    ``found``: ``project, eco`` of lockfiles that count. npm: what ``package.json`` declares, in the nearest
    ``node_modules``; Python: the distributions of the first folder of packages, direct if ``pyproject.toml`` names them or names none.
    """
    here = roots.select("project", F.col("root").alias("dir"))
    own = files.select(parent(F.col("path")).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("base"), "text")
    missing = lambda eco: roots.join(found.filter(F.col("eco") == eco).select("project").distinct(), "project", "left_anti")
    keys = [F.coalesce(F.map_keys(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>")), F.array().cast("array<string>")) for k in lockfiles.DECLARED]
    declared = here.join(own.filter("base = 'package.json'"), "dir").join(missing("npm"), "project", "left_semi").select("project", F.explode(F.array_distinct(F.flatten(F.array(*keys)))).alias("name"))
    nearest = npm_installed(roots, files).groupBy("project", "name").agg(F.min_by("version", "k").alias("version"))
    npm = declared.join(nearest, ["project", "name"]).select("project", F.lit("npm").alias("eco"), "name", "version", F.lit(True).alias("direct"), F.lit("node_modules").alias("origin"), X.norm_name(F.lit("npm"), F.col("name")).alias("norm_name"))

    def names(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for project, text in zip(pdf.project, pdf.text, strict=True):
            try:
                rows.append((project, sorted(lockfiles.pyproject_names(text))))
            except (ValueError, AttributeError, TypeError):
                rows.append((project, []))
        return pd.DataFrame(rows, columns=["project", "named"])

    python = here.join(own.filter(F.col("base").isin("pyproject.toml", "setup.py", "setup.cfg")), "dir").select("project").unionByName(here.join(files.filter(F.col("path").contains("/.venv/")).select(F.regexp_replace("path", r"/\.venv/.*$", "").alias("dir")).distinct(), "dir").select("project")).distinct().join(missing("pypi"), "project", "left_semi")
    named = here.join(own.filter("base = 'pyproject.toml'"), "dir").select("project", "text").mapInPandas(lambda it: map(names, it), "project string, named array<string>")
    first = site_packages(roots, files, prefixes, system).filter("rank = 1").join(python, "project", "left_semi")
    direct = F.coalesce((F.size("named") == 0) | F.array_contains("named", F.col("norm_name")), F.lit(True))
    pypi = first.join(dist_infos(files), "site").join(named, "project", "left").select("project", F.lit("pypi").alias("eco"), F.col("norm_name").alias("name"), "version", direct.alias("direct"), F.lit("site-packages").alias("origin"), "norm_name")
    return npm.unionByName(pypi)


def load(roots: DataFrame, files: DataFrame, home: str | None = None, prefixes: list[str] | None = None, system: list[str] | None = None) -> DataFrame:
    """All dependencies of projects: of the lockfiles that count, and of what is installed where there is none."""
    locked = cut(lockfiles.dependencies(discover(roots, files, home)))
    rest = fallbacks(roots, files, locked.select("project", "eco").distinct(), prefixes, system)
    return locked.unionByName(rest.select(locked.columns))


def locate(deps: DataFrame, roots: DataFrame, files: DataFrame, cargo_home: str | None = None, go_cache: str | None = None, yarn_cache: str | None = None, prefixes: list[str] | None = None, system: list[str] | None = None) -> DataFrame:
    """``deps`` (``project, eco, name, norm_name, version, origin``) with ``status, found, dir, how`` and ``archive``, where the files of each are.

    npm: ``node_modules`` of the project and above it, the exact version before any other, pnpm's store beside each, then
    Yarn's archives (``how`` is ``pnp``, ``archive`` the zip to unpack), then another version. Python: the first
    distribution of that version in the project's folders of packages, else the first of that name. Cargo: vendored
    crates, checkouts of git dependencies, the registry's sources. Go: vendored modules, the module cache.
    status is ready, drift (only another version is there, which must not stand for it) or missing.
    """
    deps = cut(deps.select("project", "eco", "name", "norm_name", "version", "origin").distinct())
    of = lambda eco: deps.filter(F.col("eco") == eco)
    up = ancestors(roots, 64)
    near = up.filter(F.col("k") < NEAR)
    there = lambda rank, found, dir_, how, archive=None: [rank.alias("rank"), found.alias("found"), dir_.alias("dir"), F.lit(how).alias("how"), (F.lit(None).cast("string") if archive is None else archive).alias("archive")]
    key = ["project", "eco", "name", "version"]
    rank = lambda *parts: F.struct(*[(F.lit(p) if isinstance(p, int) else p).cast("string" if i == 3 else "int").alias(f"r{i}") for i, p in enumerate([*parts, *[0] * (3 - len(parts)), F.lit("")][:4])])

    installed = npm_installed(roots, files).select("project", "name", "k", "dir", F.col("version").alias("has"))
    npm = of("npm").join(installed, ["project", "name"])
    parts = [npm.select(*key, *there(rank(F.when(F.col("has") == F.col("version"), 0).otherwise(3), F.col("k"), 0), F.col("has"), F.col("dir"), "installed"))]

    pattern = r"^(.*)/node_modules/\.pnpm/(@?[^@/]+@[^_(/]+)([^/]*)/node_modules/((?:@[^/]+/)?[^/]+)/package\.json$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    store = files.select(part(1).alias("dir"), part(2).alias("slot"), part(4).alias("name"), parent(F.col("path")).alias("place"), F.get_json_object("text", "$.version").alias("has")).filter("dir <> '' and has is not null")
    slot = F.concat(F.replace("name", F.lit("/"), F.lit("+")), F.lit("@"), "version")
    stored = of("npm").withColumn("slot", slot).join(up, "project").join(store, ["dir", "slot", "name"])
    parts.append(stored.select(*key, *there(rank(0, F.col("k"), 1), F.col("has"), F.col("place"), "store")))

    zips = files.select(parent(F.col("path")).alias("cache"), F.regexp_extract("path", r"([^/]+)-npm-[^/]*\.zip$", 1).alias("slug"), F.col("path").alias("zip")).filter("slug <> ''")
    caches = up.select("project", "k", F.concat("dir", F.lit("/.yarn/cache")).alias("cache"))
    if yarn_cache:
        caches = caches.unionByName(roots.select("project", F.lit(1000).alias("k"), F.lit(yarn_cache).alias("cache")))
    slug = F.replace("name", F.lit("/"), F.lit("-"))
    packed = of("npm").withColumn("slug", slug).join(caches, "project").join(zips, ["cache", "slug"]).filter(F.regexp_extract("zip", r"([^/]*)$", 1).startswith(F.concat("slug", F.lit("-npm-"), "version", F.lit("-"))))
    parts.append(packed.select(*key, *there(F.struct(F.lit(2).cast("int").alias("r0"), F.col("k").cast("int").alias("r1"), F.lit(0).cast("int").alias("r2"), F.col("zip").alias("r3")), F.col("version"), F.lit(None).cast("string"), "pnp", F.col("zip"))))

    sites = site_packages(roots, files, prefixes, system)
    dists = dist_infos(files).select("site", "norm_name", F.col("version").alias("has"), "info")
    python = of("pypi").join(sites.withColumnRenamed("rank", "k"), "project").join(dists, ["site", "norm_name"])
    parts.append(python.select(*key, *there(rank(F.when(F.col("has") == F.col("version"), 0).otherwise(3), F.col("k"), 0), F.col("has"), F.col("site"), "site-packages")))

    named = F.concat("name", F.lit("-"), "version")
    manifests = files.filter(F.col("path").endswith("/Cargo.toml")).select(parent(F.col("path")).alias("place"), "text")
    spots = F.array(*[F.concat("dir", F.lit(f"/{v}/"), n) for v in VENDORED for n in (named, F.col("name"))])
    vendored = of("cargo").join(near, "project").select(*key, "k", F.posexplode(spots).alias("i", "place")).join(manifests, "place")
    parts.append(vendored.select(*key, *there(rank(0, F.col("k"), F.col("i")), F.col("version"), F.col("place"), "vendor")))
    if cargo_home:
        git = F.col("origin").endswith("(git)")
        registry = manifests.filter(F.col("place").startswith(f"{cargo_home}/registry/src/")).select("place", F.regexp_extract("place", r"/registry/src/[^/]+/([^/]+)$", 1).alias("crate")).filter("crate <> ''")
        parts.append(of("cargo").filter(~git).withColumn("crate", named).join(registry, "crate").select(*key, *there(rank(1, 0, 0), F.col("version"), F.col("place"), "registry")))
        section = F.regexp_extract("text", r"(?ms)^\[package\]\s*$(.*?)(?=^\[|\z)", 1)
        value = lambda k: F.regexp_extract(section, rf"""(?m)^\s*{k}\s*=\s*["']([^"']*)["']""", 1)
        checkouts = manifests.filter(F.col("place").startswith(f"{cargo_home}/git/checkouts/")).filter((F.size(F.split(F.substr("place", F.lit(len(f"{cargo_home}/git/checkouts/") + 1)), "/")) <= 4) & ~F.col("place").rlike(r"/(target|\.[^/]*)(/|$)")).select("place", value("name").alias("name"), value("version").alias("version"))
        checked = of("cargo").filter(git).join(checkouts, ["name", "version"])
        parts.append(checked.select(*key, *there(F.struct(F.lit(1).cast("int").alias("r0"), F.lit(0).cast("int").alias("r1"), F.lit(0).cast("int").alias("r2"), F.col("place").alias("r3")), F.col("version"), F.col("place"), "checkout")))

    folders = files.select(F.regexp_extract("path", r"^(.*/vendor/.+|.*@v[^/]*)/[^/]+$", 1).alias("place")).filter("place <> ''").distinct()
    at_vendor = of("go").join(near, "project").select(*key, "k", F.concat("dir", F.lit("/vendor/"), "name").alias("place")).join(folders, "place")
    parts.append(at_vendor.select(*key, *there(rank(0, F.col("k"), 0), F.col("version"), F.col("place"), "vendor")))
    if go_cache:
        spot = F.concat(F.lit(f"{go_cache}/"), X.go_escape(F.col("name")), F.lit("@"), X.go_escape(F.col("version")))
        parts.append(of("go").withColumn("place", spot).join(folders, "place").select(*key, *there(rank(1, 0, 0), F.col("version"), F.col("place"), "modules")))

    everywhere = parts[0]
    for p in parts[1:]:
        everywhere = everywhere.unionByName(p)
    best = everywhere.groupBy(*key).agg(F.min_by(F.struct("found", "dir", "how", "archive"), F.struct("rank", "dir", "archive")).alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("b.found") == F.col("version"), "ready").otherwise("drift")
    return deps.join(best, key, "left").select(*deps.columns, status.alias("status"), "b.found", "b.dir", "b.how", "b.archive")


def recorded(files: DataFrame) -> DataFrame:
    """``info, site, file``: the files of Python distributions by their ``RECORD``, without metadata, caches and what lies outside."""
    lines = dist_infos(files).filter("record is not null").select("info", "site", F.explode(F.split("record", r"\r?\n")).alias("line"))
    file = F.regexp_replace(F.substring_index("line", ",", 1), r'^"|"$', "")
    return lines.select("info", "site", file.alias("file")).filter("file <> '' and not startswith(file, '..') and not contains(file, '.dist-info/') and not contains(file, '__pycache__')")
