"""Tables that operators of the engine are shown on, generated from the test tables and growing with them.

Each is one portable SELECT, the same for Spark and for the SQL that results are compared with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import measured_broadcasts


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


_P = "SELECT CAST(p_partkey AS BIGINT) AS p, CAST(floor(p_partkey / 6) AS BIGINT) AS g, p_name, p_brand, p_type, p_size, p_partkey % 11 AS v FROM {part}"
_K = f"SELECT *, CASE WHEN p % 6 = 0 THEN 'class' WHEN p % 6 < 3 THEN 'method' WHEN p % 6 = 5 AND g % 3 = 0 THEN 'doc' ELSE 'function' END AS kind FROM ({_P}) q0"
_N = f"""SELECT *, CASE kind WHEN 'class' THEN 'C' || {_s("g")} WHEN 'method' THEN 'm' || {_s("p")} WHEN 'doc' THEN 'Guide ' || {_s("g")} ELSE 'fn' || {_s("p")} END AS name,
 p_name || ' of ' || p_brand || ' sized ' || {_s("p_size")} || ' and kind ' || p_type || ' number ' || {_s("p")} AS words FROM ({_K}) q1"""
_PATH = "CASE kind WHEN 'method' THEN 'C' || " + _s("g") + " || '.' || {name} ELSE {name} END"
_SIG = "CASE kind WHEN 'class' THEN 'class ' || {name} WHEN 'method' THEN {name} || '(a:  ' || p_type || '): void' WHEN 'doc' THEN '' ELSE 'function ' || {name} || '(b: ' || p_brand || ', c: ' || " + _s("p_size") + " || '): ' || p_type END"
_DOC = f"CASE kind WHEN 'doc' THEN 'Replace fn' || {_s('p - 1')} || ' by something else; C' || {_s('g')} || ' is going away.' ELSE words END"
_FILE = f"CASE WHEN kind <> 'doc' THEN 'src/f' || {_s('g % 40')} || '.ts' WHEN g % 2 = 0 THEN 'CHANGELOG.md' ELSE 'README.md' END"
_PKG = f"'pkg' || {_s('g % 20')}"
_COLUMNS = "package, entry_id, kind, name, path, file, sig, doc, alias_of, legacy, line, version, major"
_OLD = f"""SELECT {_PKG} AS package, p AS entry_id, kind, name, {_PATH.replace('{name}', 'name')} AS path, {_FILE} AS file, {_SIG.replace('{name}', 'name')} AS sig, {_DOC} AS doc, CAST(NULL AS STRING) AS alias_of, p % 97 = 0 AS legacy,
 CAST(p AS INT) AS line, '1.2.0' AS version, CAST(1 AS BIGINT) AS major FROM ({_N}) q2"""
_NEW_NAME = "CASE WHEN kind IN ('class', 'doc') THEN name WHEN v = 1 THEN 'x' || name WHEN v = 4 THEN 'y' || name ELSE name END"
_M = f"SELECT *, {_NEW_NAME} AS fresh FROM ({_N}) q2 WHERE kind IN ('class', 'doc') OR v <> 0"
_NEW_SIG = f"CASE WHEN kind IN ('class', 'doc') THEN {_SIG.replace('{name}', 'fresh')} WHEN v = 2 THEN {_SIG.replace('{name}', 'fresh')} || ' | null' WHEN v = 4 THEN 'other(z: ' || {_s('p')} || ')' ELSE {_SIG.replace('{name}', 'fresh')} END"
_NEW_DOC = f"CASE WHEN kind IN ('class', 'doc') THEN {_DOC} WHEN v = 1 THEN 'quite another text' WHEN v = 3 THEN words || ' @deprecated use fn1' WHEN v = 4 THEN words || ' too' ELSE words END"
_NEW = f"""SELECT {_PKG} AS package, p + 10000000 AS entry_id, kind, fresh AS name, {_PATH.replace('{name}', 'fresh')} AS path, {_FILE} AS file, {_NEW_SIG} AS sig, {_NEW_DOC} AS doc, CAST(NULL AS STRING) AS alias_of, p % 97 = 0 AS legacy,
 CAST(p AS INT) AS line, '2.0.0' AS version, CAST(2 AS BIGINT) AS major FROM ({_M}) q3
UNION ALL SELECT {_PKG} AS package, p + 20000000 AS entry_id, 're-export' AS kind, 'also' || {_s('p')} AS name, 'also' || {_s('p')} AS path, 'src/index.ts' AS file, 'export' AS sig, '' AS doc, name AS alias_of, FALSE AS legacy,
 CAST(p AS INT) AS line, '2.0.0' AS version, CAST(2 AS BIGINT) AS major FROM ({_N}) q4 WHERE kind = 'function' AND p % 17 = 5"""

_ECO = "CASE p_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'cargo' ELSE 'go' END"
_NAME = f"CASE WHEN p_partkey % 4 = 3 THEN 'Example.com/' || replace(p_name, ' ', '/') || '/M' || {_s('p_partkey')} ELSE replace(p_name, ' ', CASE WHEN p_partkey % 8 < 4 THEN '_' ELSE '.' END) || '-' || {_s('p_partkey')} END"
_VERSION = f"{_s('p_size % 7')} || '.' || {_s('p_size % 10')} || '.' || {_s('p_partkey % 5')}"
_DEPS = f"SELECT 'proj' || {_s('CAST(floor(p_partkey / 40) AS BIGINT)')} AS project, CAST(p_partkey AS BIGINT) AS p, {_ECO} AS eco, {_NAME} AS name, lower(replace(replace({_NAME}, '_', '-'), '.', '-')) AS plain, CASE WHEN p_partkey % 4 = 3 THEN 'v' ELSE '' END || {_VERSION} AS version, p_partkey % 3 <> 0 AS direct FROM {{part}}"

GENERATED: dict[str, str] = {
    "old_entries": f"SELECT {_COLUMNS} FROM ({_OLD}) z", "new_entries": f"SELECT {_COLUMNS} FROM ({_NEW}) z", "deps": _DEPS,
    "sources": f"""SELECT eco, plain, CASE WHEN p % 10 < 6 THEN version ELSE '9.' || version END AS version, CAST(p % 3 AS INT) AS priority FROM ({_DEPS}) d WHERE p % 10 < 9
      UNION ALL SELECT eco, plain, '8.' || version AS version, CAST(1 AS INT) AS priority FROM ({_DEPS}) d WHERE p % 5 = 0""",
    "sources_text": f"""SELECT 'app' || {_s('p')} || '.ts' AS file, CASE WHEN p % 9 = 0 THEN '' ELSE 'import x from ''pkg''' END || chr(10) || 'const v = fn' || {_s('p')} || '(1); fn' || {_s('p')} || 'x' || chr(10) || 'o.m' || {_s('p + 1')} || '(2)' || chr(10) || 'm' || {_s('p + 1')} || '(3); new C' || {_s('g')} || '()' || chr(10) || 'fn3(4)' AS text FROM ({_P}) q0""",
    "guides": f"""SELECT CAST(p % 40 AS BIGINT) AS question_id, {_PKG} AS package, p AS entry_id, name, kind, p % 97 = 0 AS legacy, CASE p % 5 WHEN 0 THEN 'Deprecated: use `fn' || {_s('p + 3')} || '` instead.' WHEN 1 THEN 'Renamed to m' || {_s('p + 1')} || '. ' WHEN 2 THEN 'You can use this too' WHEN 3 THEN 'Consider a.b.fn' || {_s('p + 1')} || '(x) or `C' || {_s('g')} || '`' ELSE words END AS text, CAST(p % 101 AS DOUBLE) / 100 AS score FROM ({_N}) q2""",
    "asked_symbols": f"SELECT DISTINCT CASE p % 4 WHEN 0 THEN 'C' || {_s('g')} || '.m' || {_s('p + 1')} WHEN 1 THEN 'M' || {_s('p')} || '()' WHEN 2 THEN 'fn' || {_s('p + 1')} ELSE 'none' || {_s('p')} END AS symbol FROM ({_P}) q0",
    "files": f"""SELECT 'pkg' || {_s('g % 20')} AS package, CASE p % 12 WHEN 0 THEN 'README' || {_s('p')} || '.md' WHEN 1 THEN 'src/a' || {_s('p')} || '.py' WHEN 2 THEN 'src/a' || {_s('p - 1')} || '.pyi' WHEN 3 THEN 'src/own' || {_s('p')} || '.pyi' WHEN 4 THEN 'lib/b' || {_s('p')} || '.d.ts' WHEN 5 THEN 'lib/b' || {_s('p - 1')} || '.d.mts'
      WHEN 6 THEN 'dist/c' || {_s('p')} || '.d.cts' WHEN 7 THEN CASE WHEN g % 2 = 0 THEN 'tests/x' ELSE 'node_modules/y' END || {_s('p')} || '.py' WHEN 8 THEN 'docs/guide' || {_s('p')} || '.mdx' WHEN 9 THEN 'src/m' || {_s('p')} || '_test.go' WHEN 10 THEN 'deep/notes' || {_s('p')} || '.md' ELSE 'lib/s' || {_s('p')} || '.js' END AS file FROM ({_P}) q0""",
    "stars": f"SELECT 'f' || {_s('CAST(floor(p / 60) AS BIGINT)')} AS package, 's' || {_s('p')} AS file, 's' || {_s('p + 1')} AS target FROM ({_P}) q0 WHERE p % 6 < 4 UNION ALL SELECT 'f' || {_s('CAST(floor(p / 60) AS BIGINT)')} AS package, 's' || {_s('p')} AS file, 's' || {_s('p - 2')} AS target FROM ({_P}) q0 WHERE p % 6 = 3 AND g % 4 = 0 UNION ALL SELECT 'f' || {_s('CAST(floor(p / 60) AS BIGINT)')} AS package, 's' || {_s('p')} AS file, 's' || {_s('p + 2')} AS target FROM ({_P}) q0 WHERE p % 6 < 2",
    "modules": f"SELECT 'f' || {_s('CAST(floor(p / 60) AS BIGINT)')} AS package, 's' || {_s('p')} AS file, p % 29 = 28 AS incomplete, CAST(NULL AS STRING) AS assignment FROM ({_P}) q0",
    "exports": f"""SELECT 'f' || {_s('CAST(floor(p / 60) AS BIGINT)')} AS package, 's' || {_s('p')} AS file, CASE p % 4 WHEN 3 THEN 'default' ELSE 'v' || {_s('p')} END AS name, CASE WHEN p % 5 = 0 THEN 'named' ELSE 'local' END AS kind, CASE WHEN p % 5 = 0 THEN 's' || {_s('CAST(floor(p / 60) AS BIGINT) * 60 + (p + 7) % 60')} END AS target_file, CASE WHEN p % 5 = 0 THEN 'v' || {_s('CAST(floor(p / 60) AS BIGINT) * 60 + (p + 7) % 60')} ELSE 'w' || {_s('p')} END AS target_name FROM ({_P}) q0""",
    "roots": f"SELECT 'f' || {_s('CAST(floor(p / 60) AS BIGINT)')} AS package, CASE WHEN p % 60 = 0 THEN 'f' || {_s('CAST(floor(p / 60) AS BIGINT)')} ELSE 'f' || {_s('CAST(floor(p / 60) AS BIGINT)')} || '/' || {_s('p')} END AS import, '' AS conditions, 's' || {_s('p')} AS file FROM ({_P}) q0 WHERE p % 6 = 0",
    "declared": f"SELECT 'f' || {_s('CAST(floor(p / 60) AS BIGINT)')} AS package, p AS entry_id, CASE WHEN p % 31 = 30 THEN 'doc' ELSE 'function' END AS kind, 'w' || {_s('p')} AS name, 'w' || {_s('p')} AS path, 's' || {_s('p')} AS file, 'w(' || {_s('p % 3')} || ')' AS sig, CAST(p AS INT) AS line FROM ({_P}) q0",
    "answers": f"SELECT {_s('p')} AS id, CASE p % 3 WHEN 0 THEN 'Use ' || p_name || ' instead of DICT()' WHEN 1 THEN upper(p_name) || ' works; ' || p_brand || ' does not' ELSE p_type END AS answer, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_brand AS reject FROM ({_P}) q0",
    "packages": f"SELECT CASE WHEN p % 3 = 0 THEN '@scope/' ELSE '' END || 'kit' || {_s('p')} AS name, {_s('p_size % 5')} || '.' || {_s('p % 7')} || '.0' AS version FROM ({_P}) q0",
    "refs": f"""SELECT CASE p % 6 WHEN 0 THEN '@scope/kit' || {_s('p')} || '@' || w WHEN 1 THEN 'kit' || {_s('p')} || '@' || w WHEN 2 THEN 'kit' || {_s('p')} || '-v' || w WHEN 3 THEN 'kit' || {_s('p')} || '-' || w WHEN 4 THEN 'main' || {_s('p')} ELSE 'v' || {_s('p')} END AS ref, {_s('p')} AS oid, p % 2 = 0 AS peeled FROM (SELECT *, {_s('p_size % 5')} || '.' || {_s('p % 7')} || '.0' AS w FROM ({_P}) q0) q1
      UNION ALL SELECT CASE p % 6 WHEN 3 THEN 'kit' || {_s('p')} || '@' || w ELSE 'x' || {_s('p')} END AS ref, 'z' || {_s('p')} AS oid, FALSE AS peeled FROM (SELECT *, {_s('p_size % 5')} || '.' || {_s('p % 7')} || '.0' AS w FROM ({_P}) q0) q1""",
    "archive_files": f"SELECT 'pkg' || {_s('CAST(floor(p / 50) AS BIGINT)')} AS package, 'docs/' || {_s('p % 50')} || '.md' AS path, CAST(p_size * 10 + p % 7 AS BIGINT) AS bytes FROM ({_P}) q0",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    measured_broadcasts(spark)
    return spark.sql(GENERATED[name], part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def sql(name: str) -> str:
    """The table as a SQL subquery."""
    return f"({GENERATED[name].format(part='part')})"
