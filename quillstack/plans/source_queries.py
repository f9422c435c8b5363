"""Registered queries of sources and of page context, on texts generated from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relational
from ..operators.lineage import spread
from ..sources import files, lockfiles, markdown, pages, projects
from ..sources import symbols as extract
from .generated import frame, sql
from .queries import query, table

DEPS = sql("deps")


def joined(rows: DataFrame, by: list[str], **lines) -> DataFrame:
    """A text column for each of ``lines`` (an expression, or an expression and a filter), its rows in order of ``p``, joined by line breaks."""
    parts = {}
    for name, line in lines.items():
        text, only = line if isinstance(line, tuple) else (line, F.lit(True))
        kept = F.collect_list(F.when(only, F.struct("p", text.alias("t"))))
        parts[name] = F.transform(F.array_sort(kept), lambda e: e["t"])
    return rows.groupBy(*by).agg(*[F.array_join(v, "\n").alias(k) for k, v in parts.items()])


def fmt(template: str) -> Column:
    """``{n}`` and ``{v}`` stand for name and version."""
    return F.replace(F.replace(F.lit(template), F.lit("{n}"), F.col("name")), F.lit("{v}"), F.col("version"))


def locks(spark, sf_dir, eco: str, file: str, head: str, line: str, tail: str, first: str | None = None, between: str = "", manifest: tuple[str, str, str] | None = None) -> DataFrame:
    """A lockfile of each project: ``head``, a line for each direct dependency (``first``), ``between``, a line for each dependency, ``tail``."""
    rows = frame(spark, sf_dir, "deps").filter(F.col("eco") == eco)
    text = joined(rows, ["project"], own=(fmt(first or ""), F.col("direct")), all=fmt(line), told=(fmt(manifest[1] if manifest else ""), F.col("direct")))
    whole = F.concat(F.lit(head), F.col("own") if first else F.lit(""), F.lit(between), "all", F.lit(tail))
    beside = F.concat(F.lit(manifest[0]), "told", F.lit(manifest[2])) if manifest else F.lit(None).cast("string")
    return text.select(F.concat("project", F.lit(f"/{file}")).alias("file"), whole.alias("text"), beside.alias("manifest"))


def parsed(df: DataFrame) -> DataFrame:
    own = df.mapInPandas(lockfiles.parse, lockfiles.SCHEMA).filter("name is not null")
    return own.select(F.regexp_extract("file", "^([^/]*)", 1).alias("project"), "name", "version", "direct", "origin")


def lock_sql(eco: str, file: str, direct: str = "direct") -> str:
    return f"SELECT project, name, version, {direct} AS direct, '{file}' AS origin FROM {DEPS} d WHERE eco = '{eco}'"


@query(lock_sql("npm", "package-lock.json"))
def npm_lock_rows(spark, sf_dir):
    head, between = '{"packages": {"": {"dependencies": {', '"zz": "1"}}, "packages/w": {"devDependencies": {"none": "1"}}, "node_modules/l": {"link": true, "version": "1"}, "node_modules/a/node_modules/b": {"version": "1"},'
    return parsed(locks(spark, sf_dir, "npm", "package-lock.json", head, '"node_modules/{n}": {"version": "{v}"},', '"node_modules/none2": {}}}', first='"{n}": "*",', between=between))


@query(lock_sql("npm", "pnpm-lock.yaml"))
def pnpm_lock_rows(spark, sf_dir):
    return parsed(locks(spark, sf_dir, "npm", "pnpm-lock.yaml", "importers:\n  .:\n    dependencies:\n", "  '{n}@{v}(peer@1.0.0)': {}", "\n", first="      {n}:\n        version: {v}(peer@1.0.0)", between="\n      zz:\n        version: link:../zz\npackages:\n"))


@query(lock_sql("npm", "bun.lock"))
def bun_lock_rows(spark, sf_dir):
    return parsed(locks(spark, sf_dir, "npm", "bun.lock", '{"workspaces": {"": {"dependencies": {', '"{n}": ["{n}@{v}", ",}"],', '"a/b": ["b@1.0.0"], "w": ["w@workspace:w"],},}', first='"{n}": "1",', between='},},}, "packages": {'))


@query(lock_sql("npm", "yarn.lock"))
def yarn_lock_rows(spark, sf_dir):
    return parsed(locks(spark, sf_dir, "npm", "yarn.lock", "# yarn lockfile v1\n\n", '"{n}@^1.0.0", "{n}@^1.1.0":\n  version "{v}"\n  resolved "x"\n', "\n", manifest=('{"dependencies": {', '"{n}": "1",', '"zz": "1"}}')))


@query(lock_sql("cargo", "Cargo.lock"))
def cargo_lock_rows(spark, sf_dir):
    line = '[[package]]\nname = "{n}"\nversion = "{v}"\nsource = "registry+https://index"'
    return parsed(locks(spark, sf_dir, "cargo", "Cargo.lock", '[[package]]\nname = "me"\nversion = "0.1.0"\ndependencies = [\n', line, "\n", first='"{n} {v}",', between="]\n"))


@query(lock_sql("pypi", "uv.lock"))
def uv_lock_rows(spark, sf_dir):
    line = '[[package]]\nname = "{n}"\nversion = "{v}"'
    return parsed(locks(spark, sf_dir, "pypi", "uv.lock", '[[package]]\nname = "me"\nversion = "0"\nsource = { editable = "." }\ndependencies = [\n', line, "\n", first='{ name = "{n}" },', between="]\n"))


@query(lock_sql("pypi", "poetry.lock", "direct OR NOT any_direct").replace(f"FROM {DEPS} d", f"FROM (SELECT *, bool_or(direct) OVER (PARTITION BY project, eco) AS any_direct FROM {DEPS} e) d"))
def poetry_lock_rows(spark, sf_dir):
    line = '[[package]]\nname = "{n}"\nversion = "{v}"'
    return parsed(locks(spark, sf_dir, "pypi", "poetry.lock", "", line, "\n", manifest=('[tool.poetry.dependencies]\npython = "^3"\n', '"{n}" = "1"', "\n")))


@query(lock_sql("pypi", "Pipfile.lock", "TRUE"))
def pipfile_lock_rows(spark, sf_dir):
    return parsed(locks(spark, sf_dir, "pypi", "Pipfile.lock", '{"develop": {}, "default": {', '"{n}": {"version": "=={v}"},', '"zz": {"git": "u"}}}'))


@query(f"SELECT project, name, version, TRUE AS direct, 'requirements.txt' AS origin FROM {DEPS} d WHERE eco = 'pypi'")
def requirements_pins(spark, sf_dir):
    text = locks(spark, sf_dir, "pypi", "requirements.txt", "# pinned\n-r other.txt\n", "{n}[fast]=={v} ; python_version > '3' # why", "\ngamma>=1\n")
    return lockfiles.requirements(text).select(F.regexp_extract("file", "^([^/]*)", 1).alias("project"), "name", "version", "direct", "origin")


@query(f"SELECT project, name, CASE WHEN p % 5 = 0 THEN version || '-fork' ELSE version END AS version, TRUE AS direct, 'go.mod' AS origin FROM {DEPS} d WHERE eco = 'go'")
def go_mod_requirements(spark, sf_dir):
    rows = frame(spark, sf_dir, "deps").filter("eco = 'go'")
    text = joined(rows, ["project"], need=fmt("\t{n} {v}"), other=(fmt("\t{n} => {n} {v}-fork"), F.col("p") % 5 == 0))
    mods = text.select(F.concat("project", F.lit("/go.mod")).alias("file"), F.concat(F.lit("module m\n\nrequire (\n"), "need", F.lit("\n)\nreplace (\n"), "other", F.lit("\n)\n")).alias("text"))
    return lockfiles.go_mod(mods).select(F.regexp_extract("file", "^([^/]*)", 1).alias("project"), "name", "version", "direct", "origin")


@query(lock_sql("npm", "package-lock.json").replace(", 'package-lock.json' AS origin", ""))
def npm_lock_packages(spark, sf_dir):
    head, between = '{"packages": {"": {"dependencies": {', '"zz": "1"}}, "node_modules/l": {"link": true, "version": "1"},'
    text = locks(spark, sf_dir, "npm", "package-lock.json", head, '"node_modules/{n}": {"version": "{v}"},', '"node_modules/none": {}}}', first='"{n}": "*",', between=between)
    return lockfiles.npm_packages(text).select(F.regexp_extract("file", "^([^/]*)", 1).alias("project"), "name", "version", "direct")


#: Every third project has its npm dependencies in a lockfile above it, which counts only if it declares the ecosystem; every fifth an empty uv.lock beside a poetry.lock.
LISTED = f"SELECT *, CAST(substr(project, 5) AS BIGINT) AS k FROM {DEPS} d"


def listing(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Projects under ``/w/<project>/app`` and the files of a machine."""
    number = F.regexp_extract("file", "^proj([0-9]+)", 1).cast("long")
    at = lambda df, above, keep=F.lit(True): df.filter(keep).select(F.concat(F.lit("/w/"), F.regexp_extract("file", "^([^/]*)", 1), F.when(above, F.lit("/")).otherwise(F.lit("/app/")), F.regexp_extract("file", r"([^/]*)$", 1)).alias("path"), "text")
    npm = locks(spark, sf_dir, "npm", "package-lock.json", '{"packages": {"": {"dependencies": {', '"node_modules/{n}": {"version": "{v}"},', '"node_modules/none": {}}}', first='"{n}": "*",', between='"zz": "1"}},')
    poetry = locks(spark, sf_dir, "pypi", "poetry.lock", "", '[[package]]\nname = "{n}"\nversion = "{v}"', "\n")
    go = joined(frame(spark, sf_dir, "deps").filter("eco = 'go'"), ["project"], need=fmt("\t{n} {v}")).select(F.concat("project", F.lit("/go.mod")).alias("file"), F.concat(F.lit("require (\n"), "need", F.lit("\n)\n")).alias("text"))
    projects_ = frame(spark, sf_dir, "deps").select("project").distinct()
    roots = projects_.select("project", F.concat(F.lit("/w/"), "project", F.lit("/app")).alias("root"))
    num = F.substring("project", 5, 10).cast("long")
    manifest = projects_.filter(num % 6 != 0).select(F.concat(F.lit("/w/"), "project", F.lit("/app/package.json")).alias("path"), F.lit("{}").alias("text"))
    empty = projects_.filter(num % 5 == 0).select(F.concat(F.lit("/w/"), "project", F.lit("/app/uv.lock")).alias("path"), F.lit("").alias("text"))
    broken = projects_.filter(num % 7 == 0).select(F.concat(F.lit("/w/"), "project", F.lit("/app/Cargo.lock")).alias("path"), F.lit("[[broken").alias("text"))
    git = projects_.filter(num % 4 == 0).select(F.concat(F.lit("/w/"), "project", F.lit("/app/.git/HEAD")).alias("path"), F.lit("").alias("text"))
    parts = [at(npm, number % 3 == 0), at(poetry, F.lit(False)), at(go, F.lit(False)), manifest, empty, broken, git]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return roots, out


@query(f"""SELECT project, eco, name, version, direct, CASE eco WHEN 'npm' THEN 'package-lock.json' WHEN 'pypi' THEN 'poetry.lock' ELSE 'go.mod' END AS origin FROM
 (SELECT project, eco, name, version, CASE WHEN eco = 'npm' THEN direct ELSE TRUE END AS direct, k FROM ({LISTED}) l WHERE eco <> 'cargo') m
WHERE CASE eco WHEN 'npm' THEN k % 3 <> 0 OR (k % 6 <> 0 AND k % 4 <> 0) WHEN 'pypi' THEN k % 5 <> 0 ELSE TRUE END""")
def project_dependencies(spark, sf_dir):
    roots, listed = listing(spark, sf_dir)
    return projects.load(roots, listed).select("project", "eco", "name", "version", "direct", "origin")


PLACE = {
    "npm": [("CASE WHEN p % 9 < 4 THEN '/w/' || project || '/app/node_modules/' || name ELSE '/w/' || project || '/node_modules/' || name END", "p % 9 < 6", "CASE WHEN p % 9 IN (0, 5) THEN '0.0.1' ELSE version END"), ("'/w/' || project || '/node_modules/.pnpm/' || name || '@' || version || '_peer@1/node_modules/' || name", "p % 9 = 0", "version")],
    "cargo": [("'/home/.cargo/registry/src/index/' || name || '-' || version", "p % 5 < 3", None), ("'/w/' || project || '/app/vendor/' || name", "p % 5 = 2", None)],
    "go": [("'/go/mod/' || escaped || '@' || version", "p % 5 < 3", None)],
    "pypi": [("'/w/' || project || '/app/.venv/lib/python3.12/site-packages'", "p % 7 < 5", "CASE WHEN p % 7 = 1 THEN '0.0.1' ELSE version END")],
}


@query(f"""WITH d AS (SELECT *, regexp_replace(name, '([A-Z])', '!\\1', 'g') AS e0, lower(regexp_replace(name, '([A-Z])', '!\\1', 'g')) AS escaped FROM {DEPS} x)
SELECT project, eco, name, version,
 CASE eco WHEN 'npm' THEN CASE WHEN p % 9 IN (0, 1, 2, 3, 4) THEN 'ready' WHEN p % 9 = 5 THEN 'drift' WHEN p % 9 = 6 THEN 'ready' ELSE 'missing' END
  WHEN 'cargo' THEN CASE WHEN p % 5 < 3 THEN 'ready' ELSE 'missing' END WHEN 'go' THEN CASE WHEN p % 5 < 3 THEN 'ready' ELSE 'missing' END ELSE CASE WHEN p % 7 = 1 THEN 'drift' WHEN p % 7 < 5 THEN 'ready' ELSE 'missing' END END AS status,
 CASE eco WHEN 'npm' THEN CASE WHEN p % 9 IN (1, 2, 3, 4) THEN 'installed' WHEN p % 9 = 0 THEN 'store' WHEN p % 9 = 5 THEN 'installed' WHEN p % 9 = 6 THEN 'pnp' END
  WHEN 'cargo' THEN CASE WHEN p % 5 = 2 THEN 'vendor' WHEN p % 5 < 2 THEN 'registry' END WHEN 'go' THEN CASE WHEN p % 5 < 3 THEN 'modules' END ELSE CASE WHEN p % 7 < 5 THEN 'site-packages' END END AS how,
 CASE eco WHEN 'npm' THEN CASE WHEN p % 9 IN (1, 2, 3) THEN '/w/' || project || '/app/node_modules/' || name WHEN p % 9 IN (4, 5) THEN '/w/' || project || '/node_modules/' || name WHEN p % 9 = 0 THEN '/w/' || project || '/node_modules/.pnpm/' || name || '@' || version || '_peer@1/node_modules/' || name END
  WHEN 'cargo' THEN CASE WHEN p % 5 = 2 THEN '/w/' || project || '/app/vendor/' || name WHEN p % 5 < 2 THEN '/home/.cargo/registry/src/index/' || name || '-' || version END
  WHEN 'go' THEN CASE WHEN p % 5 < 3 THEN '/go/mod/' || escaped || '@' || version END ELSE CASE WHEN p % 7 < 5 THEN '/w/' || project || '/app/.venv/lib/python3.12/site-packages' END END AS dir
FROM d""")
def locate_packages(spark, sf_dir):
    """Packages of generated projects, installed in turn in one place or another, in another version, in an archive, or nowhere."""
    deps = frame(spark, sf_dir, "deps").withColumn("escaped", F.expr("lower(regexp_replace(name, '([A-Z])', '!$1'))"))
    roots = deps.select("project").distinct().select("project", F.concat(F.lit("/w/"), "project", F.lit("/app")).alias("root"))
    own = lambda eco, only: deps.filter((F.col("eco") == eco) & F.expr(only))
    manifest = F.concat(F.lit('{"version": "'), F.col("has"), F.lit('"}'))
    parts = [own("npm", only).select(F.expr(place).alias("dir"), F.expr(has).alias("has")).select(F.concat("dir", F.lit("/package.json")).alias("path"), manifest.alias("text")) for place, only, has in PLACE["npm"]]
    parts.append(own("npm", "p % 9 = 6").select(F.expr("'/w/' || project || '/.yarn/cache/' || name || '-npm-' || version || '-abc123-9.zip'").alias("path"), F.lit(None).cast("string").alias("text")))
    parts += [own("cargo", only).select(F.concat(F.expr(place), F.lit("/Cargo.toml")).alias("path"), F.lit("[package]").alias("text")) for place, only, _ in PLACE["cargo"]]
    parts += [own("go", only).select(F.concat(F.expr(place), F.lit("/go.mod")).alias("path"), F.lit("").alias("text")) for place, only, _ in PLACE["go"]]
    for place, only, has in PLACE["pypi"]:
        parts.append(own("pypi", only).select(F.concat(F.expr(place), F.lit("/"), F.replace("plain", F.lit("-"), F.lit("_")), F.lit("-"), F.expr(has), F.lit(".dist-info/METADATA")).alias("path"), F.lit("").alias("text")))
    parts.append(roots.select(F.concat("root", F.lit("/.venv/pyvenv.cfg")).alias("path"), F.lit("").alias("text")))
    files_ = parts[0]
    for p in parts[1:]:
        files_ = files_.unionByName(p)
    wanted = deps.select("project", "eco", "name", F.col("plain").alias("norm_name"), "version", F.lit("lock").alias("origin"))
    return projects.locate(wanted, roots, files_, cargo_home="/home/.cargo", go_cache="/go/mod").select("project", "eco", "name", "version", "status", "how", "dir")


PAGE = "SELECT CAST(p_partkey AS BIGINT) AS p, p_name, p_type, p_size FROM part"


@query(f"""WITH p AS ({PAGE}), t AS (SELECT *, 'docs/a' || p || '.md' AS file, 'a' || p || '.md' AS title FROM p)
SELECT file, CAST(1 AS INT) AS line, title AS name, 'About ' || p_name || '.' AS doc, '' AS parents, '' AS imports FROM t
UNION ALL SELECT file, 3, title || ' › ' || p_type || ' part', 'Body of ' || p_type || '.' || chr(10) || '```ts' || chr(10) || '# no heading' || chr(10) || 'import x from ''kit' || p || '/sub''' || chr(10) || '```', '1', 'kit' || p || '/sub' FROM t
UNION ALL SELECT file, 9, title || ' › ' || p_type || ' part › Use it', 'Text ' || p_size || '.', '1,3', 'kit' || p || '/sub' FROM t
UNION ALL SELECT file, 11, title || ' › Other', 'Last.', '1', '' FROM t""")
def markdown_sections(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p", "p_name", "p_type", "p_size"), compact=True)
    text = F.expr("""concat('About ', p_name, '.\n\n# ', p_type, ' part {#id}\nBody of ', p_type, '.\n```ts\n# no heading\nimport x from \\'kit', p, '/sub\\'\n```\n## [Use](x) `it`\nText ', p_size, '.\nOther\n=====\nLast.\n')""")
    found = markdown.sections(p.select(F.lit("tiny").alias("package"), F.concat(F.lit("docs/a"), "p", F.lit(".md")).alias("file"), F.lit("prose").alias("how"), text.alias("text")))
    return found.select("file", "line", "name", "doc", F.array_join(F.col("parents").cast("array<string>"), ",").alias("parents"), F.array_join("imports", ",").alias("imports"))


@query(f"""WITH p AS ({PAGE}) SELECT 'docs/long' || p || '.md' AS file, count(*) AS parts, CAST(sum(n) AS BIGINT) AS chars, max(line) AS last_line FROM
 (SELECT p, part, min(line) AS line, count(*) * 400 AS n FROM (SELECT p, i, 3 + 2 * i AS line, i // 3 AS part FROM p, (SELECT unnest(range(12)) AS i)) GROUP BY ALL) GROUP BY p""")
def markdown_chunks(spark, sf_dir):
    """Sections of twelve paragraphs of 400 characters: a part ends at the first blank line beyond 1,200 bytes, so each holds three."""
    p = spread(table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p"), compact=True)
    text = F.concat(F.lit("# Long\n\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.repeat(F.lit("x"), 400)), "\n\n"))
    found = markdown.sections(p.select(F.lit("tiny").alias("package"), F.concat(F.lit("docs/long"), "p", F.lit(".md")).alias("file"), F.lit("prose").alias("how"), text.alias("text")))
    first = F.when(F.col("line") == 1, 3).otherwise(F.col("line"))
    return found.groupBy("file").agg(F.count("*").alias("parts"), F.sum(F.length(F.regexp_replace("doc", "[^x]", ""))).alias("chars"), F.max(first).alias("last_line"))


@query(f"""WITH p AS ({PAGE}), c AS (
 SELECT 'm' || p || '.py' AS file, 'class' AS kind, 'Model' || p AS path, 'class Model' || p || '(Base)' AS sig, 'A ' || p_name || '.' AS doc, CAST(1 AS INT) AS line FROM p
 UNION ALL SELECT 'm' || p || '.py', 'method', 'Model' || p || '.size', '@property def size(self) -> int', 'How big.', 4 FROM p UNION ALL SELECT 'm' || p || '.py', 'function', 'build' || p, 'async def build' || p || '(x, *, y=' || p_size || ')', '', 7 FROM p
 UNION ALL SELECT 'm' || p || '.go', 'method', 'Ctx' || p || '.JSON', 'func (c *Ctx' || p || ') JSON(code int) error', 'JSON writes ' || p_type || '.', 4 FROM p UNION ALL SELECT 'm' || p || '.go', 'interface', 'Router' || p, 'type Router' || p || ' interface', '', 6 FROM p
 UNION ALL SELECT 'src/m' || p || '.rs', 'function', 'spawn' || p, 'pub fn spawn' || p || '(f: F) -> Handle', 'Spawns ' || p_name || '.', 2 FROM p UNION ALL SELECT 'src/m' || p || '.rs', 'struct', 'Run' || p, 'pub struct Run' || p, '', 4 FROM p UNION ALL SELECT 'src/m' || p || '.rs', 'method', 'Run' || p || '::block', 'pub fn block(&self)', '', 6 FROM p
 UNION ALL SELECT 'm' || p || '.d.ts', 'function', 'object' || p, 'function object' || p || '(shape: T): Schema', 'Makes ' || p_type || '.', 2 FROM p UNION ALL SELECT 'm' || p || '.d.ts', 'interface', 'Schema' || p, 'interface Schema' || p, '', 3 FROM p
 UNION ALL SELECT 'm' || p || '.d.ts', 'method', 'Schema' || p || '.strict', 'strict(): Schema', '', 4 FROM p UNION ALL SELECT 'm' || p || '.d.ts', 're-export', 'made' || p, 'export {{ object' || p || ' as made' || p || ' }}', '', 6 FROM p)
SELECT * FROM c""".replace("{{", "{").replace("}}", "}"))
def source_symbols(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p", "p_name", "p_type", "p_size")
    texts = {
        ("m{}.py", "python"): "concat('class Model', p, '(Base):\n    \"\"\"A ', p_name, '.\"\"\"\n    @property\n    def size(self) -> int:\n        \"\"\"How big.\"\"\"\n    def _hidden(self): ...\nasync def build', p, '(x, *, y=', p_size, '): ...\n')",
        ("m{}.go", "go"): "concat('package web\n\n// JSON writes ', p_type, '.\nfunc (c *Ctx', p, ') JSON(code int) error {\n}\ntype Router', p, ' interface {\n}\nfunc private() {}\n')",
        ("src/m{}.rs", "rust"): "concat('/// Spawns ', p_name, '.\npub fn spawn', p, '(f: F) -> Handle {\n}\npub struct Run', p, ' {}\nimpl Run', p, ' {\n    pub fn block(&self) {}\n}\n#[doc(hidden)]\npub fn secret() {}\n')",
        ("m{}.d.ts", "ts"): "concat('/** Makes ', p_type, '. */\nexport declare function object', p, '(shape: T): Schema;\nexport interface Schema', p, ' {\n  strict(): Schema;\n}\nexport { object', p, ' as made', p, ' };\n')",
    }
    made = F.explode(F.array(*[F.struct(F.concat(F.lit(f.split("{}")[0]), "p", F.lit(f.split("{}")[1])).alias("file"), F.lit(how).alias("how"), F.expr(text).alias("text")) for (f, how), text in texts.items()]))
    return extract.symbols(p.select(F.lit("tiny").alias("package"), made.alias("e")).select("package", "e.*")).select("file", "kind", "path", "sig", "doc", "line")


@query(f"""WITH p AS ({PAGE}), c AS (
 SELECT 'web/m' || p || '.go' AS file, 'const' AS kind, 'Max' || p AS path, 'const Max' || p || ' = ' || p_size AS sig, 'Max of ' || p_type || '.' AS doc, CAST(6 AS INT) AS line FROM p
 UNION ALL SELECT 'web/m' || p || '.go', 'const', 'Least' || p, 'const Least' || p, '', 7 FROM p UNION ALL SELECT 'web/m' || p || '.go', 'interface', 'Handler' || p, 'type Handler' || p || ' interface {{ Serve(c *Ctx) error }}', '', 10 FROM p
 UNION ALL SELECT 'web/m' || p || '.go', 'method', 'Handler' || p || '.Serve', 'Serve(c *Ctx) error', 'Serve serves ' || p_name || '.', 12 FROM p UNION ALL SELECT 'web/m' || p || '.go', 'method', 'Ctx' || p || '.Get', 'func (c *Ctx' || p || '[K]) Get(key string, other interface{{ X() }}) error', '', 15 FROM p
 UNION ALL SELECT 'src/m' || p || '.rs', 'function', 'spawn' || p, 'pub fn spawn' || p || '<F>(f: F) -> Handle where F: Send,', 'Spawns ' || p_name || '.', 4 FROM p UNION ALL SELECT 'src/m' || p || '.rs', 'function', 'outer' || p || '::inner::run', 'pub unsafe fn run()', '', 9 FROM p
 UNION ALL SELECT 'src/m' || p || '.rs', 'trait', 'Visit' || p, 'pub trait Visit' || p, '', 10 FROM p UNION ALL SELECT 'src/m' || p || '.rs', 'method', 'Visit' || p || '::visit', 'fn visit(&self)', '', 10 FROM p
 UNION ALL SELECT 'src/m' || p || '.rs', 'macro', 'select' || p || '!', 'macro_rules! select' || p || ' {{ () => {{}}; }}', 'Waits.', 16 FROM p UNION ALL SELECT 'src/m' || p || '.rs', 'struct', 'Run' || p, 'pub struct Run' || p || ' {{ size: [u8; ' || p_size || '] }}', '', 17 FROM p
 UNION ALL SELECT 'm' || p || '.d.ts', 'module', 'z' || p, 'namespace z' || p, '', 1 FROM p UNION ALL SELECT 'm' || p || '.d.ts', 'function', 'z' || p || '.text', 'function text(how: {{ size: ' || p_size || ' }}): Text', 'A ' || p_type || '.', 3 FROM p
 UNION ALL SELECT 'm' || p || '.d.ts', 'class', 'z' || p || '.Box', 'class Box<T = {{ a: 1 }}> extends Base', '', 6 FROM p UNION ALL SELECT 'm' || p || '.d.ts', 'method', 'z' || p || '.Box.open', 'open(cb: (e: {{ kind: string }}) => void): this', '', 9 FROM p UNION ALL SELECT 'm' || p || '.d.ts', 'field', 'z' || p || '.Box.map', 'map: Map<string, number>', '', 10 FROM p
 UNION ALL SELECT 'm' || p || '.d.ts', 'function', 'made' || p, 'const made' || p || ': <T>(x: T) => Box<T>', '', 14 FROM p UNION ALL SELECT 'm' || p || '.d.ts', 'const', 'size' || p, 'const size' || p || ' = ' || p_size, '', 14 FROM p UNION ALL SELECT 'm' || p || '.d.ts', 're-export', 'make' || p, 'export {{ made' || p || ' as make' || p || ' }}', '', 16 FROM p
 UNION ALL SELECT 'm' || p || '.d.ts', 'module', 'all' || p, 'export * as all' || p || ' from "./x"', '', 18 FROM p)
SELECT * FROM c""".replace("{{", "{").replace("}}", "}"))
def nested_declarations(spark, sf_dir):
    """Declarations that no single line shows: grouped, nested, over several lines, in macro bodies, beside strings and comments that look like some."""
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p", "p_name", "p_type", "p_size")
    texts = {
        ("web/m{}.go", "go"): "concat('package web\n\n/* func Fake() {} */\nconst (\n\t// Max of ', p_type, '.\n\tMax', p, ' = ', p_size, ' // and more\n\tLeast', p, '\n)\ntype (\n\tHandler', p, ' interface {\n\t\t// Serve serves ', p_name, '.\n\t\tServe(c *Ctx) error\n\t}\n)\nfunc (c *Ctx', p, '[K]) Get(\n\tkey string,\n\tother interface{ X() },\n) error {\n\tx := `\nfunc Raw() {}\n`\n}\n')",
        ("src/m{}.rs", "rust"): "concat('cfg_rt! {\n    /// Spawns ', p_name, '.\n    #[track_caller]\n    pub fn spawn', p, '<F>(f: F) -> Handle\n    where\n        F: Send,\n    { let s = \"pub fn fake() {\"; }\n}\npub mod outer', p, ' { pub mod inner { pub unsafe fn run() {} } }\npub trait Visit', p, ' { fn visit(&self); }\nimpl fmt::Debug for Run', p, ' { pub fn no() {} }\nmacro_rules! doc { ($x:item) => {\n    /// Waits.\n    #[macro_export]\n    $x }; }\ndoc! {macro_rules! select', p, ' { () => {}; }}\npub struct Run', p, ' { size: [u8; ', p_size, '] }\n')",
        ("m{}.d.ts", "ts"): "concat('export declare namespace z', p, ' {\n  /** A ', p_type, '. */\n  function text(\n    how: { size: ', p_size, ' },\n  ): Text;\n  class Box<T = { a: 1 }>\n    extends Base {\n    private hidden: number;\n    open(cb: (e: { kind: string }) => void): this\n    map: Map<string, number>\n  }\n}\n// function no() {}\nexport declare const made', p, ': <T>(x: T) => Box<T>, size', p, ' = ', p_size, ';\nexport {\n  made', p, ' as make', p, '\n};\nexport * as all', p, ' from \"./x\";\n')",
    }
    made = F.explode(F.array(*[F.struct(F.concat(F.lit(f.split("{}")[0]), "p", F.lit(f.split("{}")[1])).alias("file"), F.lit(how).alias("how"), F.expr(text).alias("text")) for (f, how), text in texts.items()]))
    return extract.symbols(p.select(F.lit("tiny").alias("package"), made.alias("e")).select("package", "e.*")).select("file", "kind", "path", "sig", "doc", "line")


@query(f"""WITH p AS ({PAGE}), t AS (
 SELECT 'pkg/m' || p || '/__init__.py' AS file, 'pkg.m' || p AS name, 'About ' || p_name || '.' AS doc, CAST(2 AS INT) AS line, '' AS parents FROM p UNION ALL SELECT 'pkg/m' || p || '/__init__.py', 'pkg.m' || p || ' › Use', 'Size ' || p_size || '.', 4, '2' FROM p
 UNION ALL SELECT 'web/m' || p || '.go', 'package web (web)', 'Package web serves ' || p_type || '.', 3, '' FROM p
 UNION ALL SELECT 'src/task/m' || p || '.rs', 'tiny_rt::task::m' || p, 'Runs ' || p_name || '.', 1, '' FROM p UNION ALL SELECT 'src/task/m' || p || '.rs', 'tiny_rt::task::m' || p || ' › Usage', 'Call it ' || p_size || ' times.', 3, '1' FROM p)
SELECT * FROM t""")
def module_docs(spark, sf_dir):
    """Docstrings, package comments and inner docs as sections titled by their modules; comments on items and ``main`` packages are none."""
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p", "p_name", "p_type", "p_size")
    texts = {
        ("pkg/m{}/__init__.py", "python"): "concat('# coding\n\"\"\"About ', p_name, '.\n\n# Use\nSize ', p_size, '.\n\"\"\"\nx = 1\n')",
        ("web/m{}.go", "go"): "concat('// Copyright.\n\n// Package web serves ', p_type, '.\npackage web\n')",
        ("cmd/m{}.go", "go"): "concat('// Command ', p, '.\npackage main\n')",
        ("src/task/m{}.rs", "rust"): "concat('//! Runs ', p_name, '.\n//!\n//! # Usage\n//! Call it ', p_size, ' times.\n\nfn f() {\n    //! inner\n}\n/// of g\nfn g() {}\n')",
    }
    made = F.explode(F.array(*[F.struct(F.concat(F.lit(f.split("{}")[0]), "p", F.lit(f.split("{}")[1])).alias("file"), F.lit(how).alias("how"), F.expr(text).alias("text")) for (f, how), text in texts.items()]))
    found = extract.module_docs(p.select(F.lit("tiny-rt").alias("package"), made.alias("e")).select("package", "e.*"))
    return found.select("file", "name", "doc", "line", F.array_join(F.col("parents").cast("array<string>"), ",").alias("parents"))


@query(f"""WITH s AS (SELECT *, 'src/' || CASE WHEN entry_id % 5 = 0 THEN 'v1/' ELSE '' END || 'f.ts' AS place FROM {sql('old_entries')} x UNION ALL SELECT *, 'src/zz.ts' AS place FROM {sql('old_entries')} y WHERE entry_id % 3 = 0)
SELECT package, path, line, place AS file, contains(place, '/v1/') AS legacy FROM s QUALIFY row_number() OVER (PARTITION BY package, path, sig, length(doc) ORDER BY place, line) = 1""")
def entry_dedupe(spark, sf_dir):
    own = frame(spark, sf_dir, "old_entries").select("package", "entry_id", "line", "kind", "name", "path", "sig", "doc", "alias_of")
    at = own.withColumn("file", F.concat(F.lit("src/"), F.when(F.col("entry_id") % 5 == 0, "v1/").otherwise(""), F.lit("f.ts"))).unionByName(own.filter("entry_id % 3 = 0").withColumn("file", F.lit("src/zz.ts")))
    versions = own.select("package", F.lit("2.0.0").alias("version")).distinct()
    return extract.entries(at.drop("entry_id"), versions).select("package", "path", "line", "file", "legacy")


EXT = "CASE WHEN regexp_matches(lower(file), '\\.d\\.[mc]?ts$') THEN regexp_extract(lower(file), '\\.(d\\.[mc]?ts)$', 1) ELSE regexp_extract(lower(file), '\\.([^./]+)$', 1) END"


@query(f"""WITH f AS (SELECT package, file, regexp_extract(file, '([^/]*)$', 1) AS base, {EXT} AS ext, len(string_split(file, '/')) - 1 AS depth FROM {sql('files')}),
u AS (SELECT *, regexp_replace(file, '\\.(pyi?|d\\.[mc]?ts)$', '') AS stem FROM f WHERE NOT regexp_matches(file, '^(tests|node_modules)/')),
t AS (SELECT package, bool_or(starts_with(ext, 'd.')) AS typed FROM u GROUP BY 1),
h AS (SELECT u.*, CASE WHEN ext IN ('md', 'mdx') THEN CASE WHEN regexp_matches(base, '^(README|NEWS)') OR depth = 0 OR starts_with(file, 'docs/') THEN 'prose' END WHEN ext IN ('d.ts', 'd.mts', 'd.cts') THEN 'ts' WHEN ext = 'js' AND NOT typed THEN 'ts' WHEN ext IN ('py', 'pyi') THEN 'python' WHEN ext = 'go' AND NOT ends_with(base, '_test.go') THEN 'go' END AS how FROM u JOIN t USING (package))
SELECT package, file, how FROM h WHERE how IS NOT NULL AND NOT (ext = 'pyi' AND EXISTS (SELECT 1 FROM u o WHERE o.package = h.package AND o.stem = h.stem AND o.ext = 'py')) AND NOT (ext IN ('d.mts', 'd.cts') AND EXISTS (SELECT 1 FROM u o WHERE o.package = h.package AND o.stem = h.stem AND o.ext = 'd.ts'))""")
def plan_files(spark, sf_dir):
    return files.plan(frame(spark, sf_dir, "files"))


@query("SELECT source AS package, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def cache_usage(spark, sf_dir):
    return files.usage(table(spark, sf_dir, "documents").select(F.col("source").alias("package"), F.octet_length("text").cast("long").alias("bytes")))


@query("SELECT source, lang, sha256(source || chr(0) || lang || chr(0) || CAST(count(*) AS VARCHAR) || chr(0) || CAST(max(doc_id) AS VARCHAR)) AS key FROM documents GROUP BY 1, 2")
def content_key(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").cast("string").alias("n"), F.max("doc_id").cast("string").alias("last"))
    return rows.select("source", "lang", F.sha2(F.concat_ws("\0", "source", "lang", "n", "last"), 256).alias("key"))


@query(r"""WITH h AS (SELECT page_id, unnest(hs) AS raw, generate_subscripts(hs, 1) - 1 AS n FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS hs FROM pages)),
t AS (SELECT page_id, n, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS heading FROM h)
SELECT t.page_id, t.n, t.heading, p.heading AS page_heading FROM t LEFT JOIN t p ON p.page_id = t.page_id AND p.n = 0""")
def section_context(spark, sf_dir):
    heads = relational.html_headings(table(spark, sf_dir, "pages")).withColumn("n", F.col("n").cast("long")).select("page_id", "n", "heading")
    first = heads.filter("n = 0").select("page_id", F.col("heading").alias("page_heading"))
    return heads.join(first, "page_id", "left")


@query(f"""WITH p AS ({PAGE}) SELECT 'docs/p' || p || '.md' AS file, CASE WHEN p % 4 = 3 THEN 'Intro' || chr(10) || '--8<-- "nowhere/x' || p || '.py"' ELSE 'Intro' || chr(10) || '```py' || chr(10) || 'print(' || p || ')' || chr(10) || '```' END || chr(10) || 'End' AS text FROM p""")
def inlined_examples(spark, sf_dir):
    """Pages that include an example by a path of which more or fewer last parts are real; every fourth names none."""
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p")
    line = F.expr("CASE p % 4 WHEN 0 THEN concat('{! ../.tmp_examples/ex/a', p, '.py !}') WHEN 1 THEN concat('{* ../../docs_src/ex/a', p, '.py hl[1] *}') WHEN 2 THEN concat('--8<-- \"other/ex/a', p, '.py\"') ELSE concat('--8<-- \"nowhere/x', p, '.py\"') END")
    text = p.select(F.lit("k").alias("package"), F.concat(F.lit("docs/p"), "p", F.lit(".md")).alias("file"), F.concat(F.lit("Intro\n"), line, F.lit("\nEnd")).alias("text"))
    code = p.filter("p % 4 <> 3").select(F.lit("k").alias("package"), F.concat(F.lit("upstream:docs_src/ex/a"), "p", F.lit(".py")).alias("file"), F.concat(F.lit("print("), "p", F.lit(")\n")).alias("text"))
    return pages.with_includes(text, code).select("file", "text")


@query(f"""WITH p AS ({PAGE}) SELECT 'ex/my_demo-' || p || '.py' AS file, 'example › my demo ' || p AS name, '```py' || chr(10) || 'run(' || p || ')' || chr(10) || '```' AS doc FROM p WHERE p % 5 <> 0
UNION ALL SELECT 'app/(docs)/install/page' || p || '.tsx', 'Install ' || p_type || CASE i WHEN 0 THEN '' WHEN 1 THEN ' › Get ' || p_name ELSE ' › More' END, CASE i WHEN 0 THEN 'How to use ' || p_size || '.' WHEN 1 THEN 'Run the `add` command.' || chr(10) || '```shell' || chr(10) || 'npm i tool' || p || chr(10) || '```' ELSE 'Text after.' END FROM p, (SELECT unnest([0, 1, 2]) AS i)""")
def component_pages(spark, sf_dir):
    """Component pages and example files as sections; over-long examples are passed over."""
    p = spread(table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p", "p_name", "p_type", "p_size"), compact=True)
    page = F.expr("""concat('import X from "y";\nexport const metadata = { title: "Install ', p_type, '", description: "How to use ', p_size, '." };\nconst steps = [\n  { title: "Get ', p_name, '",\n body: <p>Run the <code>add</code> command.</p>,\n code: { lang: "shell", code: "npm i tool', p, '" } },\n];\nexport default function Page() { return <div>\n<h2 id="x">More</h2>\n<p>Text after.</p>\n</div>; }\n')""")
    code = F.when(F.col("p") % 5 == 0, F.repeat(F.lit("x = 1\n"), 2500)).otherwise(F.concat(F.lit("run("), "p", F.lit(")\n")))
    both = p.select(F.concat(F.lit("app/(docs)/install/page"), "p", F.lit(".tsx")).alias("file"), F.lit("page").alias("how"), page.alias("text")).unionByName(p.select(F.concat(F.lit("ex/my_demo-"), "p", F.lit(".py")).alias("file"), F.lit("example").alias("how"), code.alias("text")))
    return pages.sections(both.withColumn("package", F.lit("k"))).select("file", "name", "doc")


REPO = f"""SELECT 'kit' || (p // 60) AS package, CASE WHEN (p // 60) % 2 = 0 THEN 'packages/kit' || (p // 60) ELSE NULL END AS subdir, CASE p % 12 WHEN 0 THEN 'README.md' WHEN 1 THEN 'docs/en/a' || p || '.md' WHEN 2 THEN 'docs/de/a' || p || '.md' WHEN 3 THEN 'docs/fr/a' || p || '.rst' WHEN 4 THEN 'website/docs/b' || p || '.mdx' WHEN 5 THEN 'docs/blog/c' || p || '.md'
 WHEN 6 THEN 'src/main' || p || '.py' WHEN 7 THEN 'packages/kit' || (p // 60) || '/CHANGELOG.md' WHEN 8 THEN 'docs/examples/e' || p || '.py' WHEN 9 THEN 'guide/t' || p || '.txt' WHEN 10 THEN 'docs/big' || p || '.md' ELSE 'other/x' || p || '.md' END AS file, CASE WHEN p % 12 = 10 THEN 4000000 ELSE p_size * 1000 END AS bytes FROM ({PAGE}) q"""


@query(f"""WITH r AS (SELECT DISTINCT * FROM ({REPO}) z)
SELECT package, file, CAST(bytes AS BIGINT) AS bytes FROM r WHERE bytes <= 3 * 1024 * 1024 AND (file = 'README.md' OR (subdir IS NOT NULL AND file = subdir || '/CHANGELOG.md') OR regexp_matches(file, '^(docs/en/|website/docs/|docs/examples/|guide/)'))""")
def repository_docs(spark, sf_dir):
    """Which files of a repository document a package: languages beside English, blogs, large files and sources don't."""
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p", "p_size")
    rows = p.selectExpr("concat('kit', p div 60) AS package", "CASE WHEN (p div 60) % 2 = 0 THEN concat('packages/kit', p div 60) END AS subdir", """CASE p % 12 WHEN 0 THEN 'README.md' WHEN 1 THEN concat('docs/en/a', p, '.md') WHEN 2 THEN concat('docs/de/a', p, '.md') WHEN 3 THEN concat('docs/fr/a', p, '.rst') WHEN 4 THEN concat('website/docs/b', p, '.mdx') WHEN 5 THEN concat('docs/blog/c', p, '.md')
      WHEN 6 THEN concat('src/main', p, '.py') WHEN 7 THEN concat('packages/kit', p div 60, '/CHANGELOG.md') WHEN 8 THEN concat('docs/examples/e', p, '.py') WHEN 9 THEN concat('guide/t', p, '.txt') WHEN 10 THEN concat('docs/big', p, '.md') ELSE concat('other/x', p, '.md') END AS file""", "cast(CASE WHEN p % 12 = 10 THEN 4000000 ELSE p_size * 1000 END as bigint) AS bytes")
    return pages.package_docs(rows.distinct())


@query(f"""WITH p AS ({PAGE}), d AS (SELECT DISTINCT CASE p % 4 WHEN 0 THEN 'react' WHEN 1 THEN 'express' WHEN 2 THEN 'tailwindcss' ELSE 'unmapped' END AS name, (14 + p_size % 6) AS major, (14 + p_size % 6) || '.' || p % 3 || '.0' AS version FROM p)
SELECT 'npm' AS eco, name, version, CASE name WHEN 'react' THEN CASE WHEN major IN (16, 17, 18) THEN 'reactjs/legacy.reactjs.org' ELSE 'reactjs/react.dev' END WHEN 'express' THEN 'expressjs/expressjs.com' ELSE 'tailwindlabs/tailwindcss.com' END AS repo,
 CASE WHEN name = 'react' AND major IN (16, 17) THEN major || '.reactjs.org' WHEN name = 'tailwindcss' AND major = 15 THEN 'v15' WHEN name = 'tailwindcss' AND major < 19 THEN 'sha' || (major + 1) ELSE 'main' END AS reference,
 CASE WHEN name = 'react' AND major IN (16, 17, 18) THEN 'archive' WHEN major >= 19 THEN 'current' WHEN name = 'express' THEN 'versioned' WHEN major = 15 THEN 'branch' ELSE 'as of' END AS how FROM d
WHERE name <> 'unmapped' AND NOT (name = 'react' AND major IN (14, 15))""")
def docs_site_reference(spark, sf_dir):
    """Which state of a documentation site describes a version; the last commit before the next major is an as-of lookup."""
    deps = table(spark, sf_dir, "part").selectExpr("'npm' AS eco", "CASE p_partkey % 4 WHEN 0 THEN 'react' WHEN 1 THEN 'express' WHEN 2 THEN 'tailwindcss' ELSE 'unmapped' END AS name", "concat(14 + p_size % 6, '.', p_partkey % 3, '.0') AS version").distinct()
    latest = spark.createDataFrame([("npm", n, 19) for n in ("react", "express", "tailwindcss")], "eco string, name string, major long")
    branches = spark.createDataFrame([("tailwindlabs/tailwindcss.com", b) for b in ("v15", "main", "next")], "repo string, branch string")
    releases = spark.createDataFrame([("npm", "tailwindcss", f"{m}.0.0", f"20{m}-06-01") for m in range(15, 20)], "eco string, name string, version string, at string")
    commits = spark.createDataFrame([("tailwindlabs/tailwindcss.com", f"sha{m}", f"20{m}-05-30") for m in range(14, 20)] + [("tailwindlabs/tailwindcss.com", f"late{m}", f"20{m}-06-02") for m in range(14, 20)], "repo string, sha string, at string")
    return pages.site_reference(deps, latest, branches, releases, commits).select("eco", "name", "version", "repo", "reference", "how")


@query(f"""WITH p AS ({PAGE}) SELECT p, p % 3 = 2 AND p_size > 20 AS later, p % 5 IN (0, 3) AS page FROM p""")
def later_and_page_files(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p", "p_size")
    file = F.expr("CASE p % 3 WHEN 2 THEN concat('docs/V', p_size, '-beta.mdx') ELSE concat('docs/v3/x', p, '.md') END")
    page = F.expr("CASE p % 5 WHEN 0 THEN 'app/install.tsx' WHEN 1 THEN 'app/layout.tsx' WHEN 2 THEN 'app/@slot/x.tsx' WHEN 3 THEN 'a/b.js' ELSE 'app/[id]/x.jsx' END")
    return p.select("p", pages.later_major(file, F.lit(20)).alias("later"), pages.page_file(page).alias("page"))


@query(f"""WITH p AS ({PAGE}), m AS (SELECT p, p_size % 9 AS format, CASE WHEN p % 3 = 0 THEN 'c' || p END AS "commit", CASE WHEN p % 2 = 0 THEN 0 ELSE 5 END AS files, p % 7 <> 0 AS checked, p % 4 <> 1 AS ok FROM p),
s AS (SELECT *, format >= 4 AND ("commit" IS NOT NULL OR files = 0) AS trusted, format < 7 OR NOT checked AS due FROM m)
SELECT p AS key, CASE WHEN due AND ok THEN 7 ELSE format END AS format, CASE WHEN due AND ok THEN 'new' || p ELSE "commit" END AS "commit", CASE WHEN due AND NOT ok THEN 'refresh failed: offline; earlier copy kept' END AS note, due AND ok AS refreshed FROM s WHERE ok OR NOT due OR trusted""")
def refresh_cached_docs(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p", "p_size")
    cached = p.selectExpr("p AS key", "p_size % 9 AS format", "CASE WHEN p % 3 = 0 THEN concat('c', p) END AS commit", "cast(null as string) AS site", "CASE WHEN p % 2 = 0 THEN 0 ELSE 5 END AS files", "p % 7 <> 0 AS sites_checked")
    tried = p.selectExpr("p AS key", "p % 4 <> 1 AS ok", "'offline' AS error", "concat('new', p) AS commit", "cast(null as string) AS site", "9 AS files")
    return pages.refresh(cached, tried, explicit=True).select("key", "format", "commit", "note", "refreshed")


@query(f"""WITH p AS ({PAGE}), f AS (SELECT 'kit' || (p // 8) AS package, CASE p % 4 WHEN 0 THEN 'package.json' WHEN 1 THEN 'x/METADATA' ELSE 'src/a' || p || '.ts' END AS file, p_size AS bytes, p AS modified FROM p),
s AS (SELECT package, sha256(string_agg(file || ':' || bytes || ':' || modified, ';' ORDER BY file || ':' || bytes || ':' || modified)) AS stamp, CAST(substr(package, 4) AS BIGINT) AS k FROM f WHERE NOT starts_with(file, 'src/') GROUP BY package)
SELECT package, CASE k % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' WHEN 2 THEN 'format' ELSE 'gone' END AS state FROM s WHERE k % 5 < 4""")
def stale_packages(spark, sf_dir):
    """Packages whose index must be built anew or dropped, by format and by a stamp of their manifests."""
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p", "p_size")
    own = p.selectExpr("concat('kit', p div 8) AS package", "CASE p % 4 WHEN 0 THEN 'package.json' WHEN 1 THEN 'x/METADATA' ELSE concat('src/a', p, '.ts') END AS file", "p_size AS bytes", "p AS modified")
    k = F.substring("package", 4, 20).cast("long") % 5
    now = files.stamps(own).withColumn("format", F.lit(2))
    indexed = now.filter(k != 0).withColumns({"stamp": F.when(k == 1, "other").otherwise(F.col("stamp")), "format": F.when(k == 2, 1).otherwise(F.col("format"))})
    return files.stale(indexed, now.filter(k != 3))
