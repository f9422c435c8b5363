"""Registered queries of export graphs, import scopes, package choice and answer assembly, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import exports, packages, relational, retrieval, scopes, symbols, upgrade
from ..operators.lineage import shared_folder
from ..sources import modules
from . import bench
from . import oracle as O
from .generated import frame, sql
from .index import Index
from .queries import ASKED, asked, docs, query, table

STARS, MODULES, EXPORTS, ROOTS, DECLARED = (sql(n) for n in ("stars", "modules", "exports", "roots", "declared"))
NO_IMPORTS = "package string, file string, name string, kind string, target_file string, target_name string"


def graph(spark, sf_dir):
    return {"stars": frame(spark, sf_dir, "stars"), "modules": frame(spark, sf_dir, "modules"), "exports": frame(spark, sf_dir, "exports"), "imports": spark.createDataFrame([], NO_IMPORTS)}


REACH = f"reach AS (SELECT import, file FROM {ROOTS} r UNION SELECT r.import, s.target FROM reach r JOIN {STARS} s ON s.file = r.file)"


@query(f"WITH RECURSIVE edges AS (SELECT file, target FROM {STARS} s UNION SELECT file, target_file FROM {EXPORTS} e WHERE target_file IS NOT NULL), reach AS (SELECT import, file FROM {ROOTS} r UNION SELECT r.import, s.target FROM reach r JOIN edges s ON s.file = r.file) SELECT import, file FROM reach")
def import_files(spark, sf_dir):
    return exports.search_files(frame(spark, sf_dir, "roots"), graph(spark, sf_dir)).select("import", "file")


DIST = f"""steps AS (SELECT import, file, 0 AS d FROM {ROOTS} r UNION SELECT r.import, s.target, r.d + 1 FROM steps r JOIN {STARS} s ON s.file = r.file WHERE r.d < 12), near AS (SELECT import, file, min(d) AS d FROM steps GROUP BY ALL)"""


@query(f"WITH RECURSIVE {DIST} SELECT import, name, n.file, target_name FROM near n JOIN {EXPORTS} e USING (file) WHERE d = 0 OR name <> 'default' QUALIFY row_number() OVER (PARTITION BY import, name ORDER BY d, n.file) = 1")
def export_closure(spark, sf_dir):
    return exports.offered(frame(spark, sf_dir, "roots"), graph(spark, sf_dir)).select("import", "name", "file", "target_name")


SURFACE = f"""{DIST}, loops AS (SELECT s.file AS origin, s.target AS file FROM {STARS} s UNION SELECT l.origin, s.target FROM loops l JOIN {STARS} s ON s.file = l.file),
known AS (SELECT import FROM near n LEFT JOIN {MODULES} m USING (file) GROUP BY import HAVING bool_and(coalesce(NOT incomplete, FALSE)) AND bool_and(file NOT IN (SELECT file FROM loops WHERE origin = file))),
surface AS (SELECT import, list_sort(list(DISTINCT name)) AS names FROM near n JOIN {EXPORTS} e USING (file) JOIN known USING (import) WHERE d = 0 OR name <> 'default' GROUP BY import)"""


@query(f"WITH RECURSIVE {SURFACE} SELECT import, array_to_string(names, ',') AS names FROM surface")
def export_names(spark, sf_dir):
    return exports.surface(frame(spark, sf_dir, "roots"), graph(spark, sf_dir)).select("import", F.array_join("names", ",").alias("names"))


#: A package whose files are one chain, with a dead end at each, and one that goes round 500 files.
DEEP = "(SELECT 'chain' AS package, 'c' || p_partkey AS file, 'c' || (p_partkey + 1) AS target FROM part WHERE p_partkey < (SELECT max(p_partkey) FROM part) UNION ALL SELECT 'chain', 'c' || p_partkey, 'leaf' || p_partkey FROM part UNION ALL SELECT 'ring', 'r' || (p_partkey % 500), 'r' || ((p_partkey + 1) % 500) FROM part GROUP BY ALL)"
DEEP_ROOTS = "(SELECT 'chain' AS package, 'chain' || CASE WHEN k = 0 THEN '' ELSE '/' || k END AS import, 'c' || CASE WHEN k = 0 THEN 1 ELSE m - k END AS file FROM (SELECT max(p_partkey) AS m FROM part), (SELECT unnest([0, 10, 126, 127, 128, 129]) AS k) UNION ALL SELECT 'ring', 'ring', 'r0')"


def deep(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) AS p")
    most = p.agg(F.max("p").alias("m"))
    name = lambda k, c: F.concat(F.lit(k), c.cast("string"))
    chain = p.crossJoin(F.broadcast(most)).filter("p < m").select(F.lit("chain").alias("package"), name("c", F.col("p")).alias("file"), name("c", F.col("p") + 1).alias("target"))
    leaves = p.select(F.lit("chain"), name("c", F.col("p")), name("leaf", F.col("p")))
    ring = p.select(F.lit("ring"), name("r", F.col("p") % 500), name("r", (F.col("p") + 1) % 500)).distinct()
    stars = chain.union(leaves).union(ring)
    files = stars.select("package", "file").union(stars.select("package", "target")).distinct()
    starts = most.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (0, 10, 126, 127, 128, 129)])))
    roots = starts.select(F.lit("chain").alias("package"), F.when(F.col("k") == 0, "chain").otherwise(name("chain/", F.col("k"))).alias("import"), F.when(F.col("k") == 0, "c1").otherwise(name("c", F.col("m") - F.col("k"))).alias("file"))
    roots = roots.union(spark.createDataFrame([("ring", "ring", "r0")], "package string, import string, file string"))
    modules_ = files.withColumns({"incomplete": F.lit(False), "assignment": F.lit(None).cast("string")})
    exported = files.select("package", "file", F.concat(F.lit("v"), "file").alias("name"), F.lit("local").alias("kind"), F.lit(None).cast("string").alias("target_file"), F.col("file").alias("target_name"))
    return roots, {"stars": stars, "modules": modules_, "exports": exported, "imports": spark.createDataFrame([], NO_IMPORTS)}


@query(f"WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM {DEEP}), reach AS (SELECT import, file FROM {DEEP_ROOTS} r UNION SELECT r.import, s.target FROM reach r JOIN s ON s.file = r.file) SELECT import, count(*) AS files, md5(string_agg(file, ',' ORDER BY file)) AS listed FROM reach GROUP BY import")
def deep_import_files(spark, sf_dir):
    """All files of imports in a chain as long as the table and in a ring, however deep."""
    found = exports.search_files(*deep(spark, sf_dir))
    return found.groupBy("import").agg(F.count("*").alias("files"), F.md5(F.array_join(F.sort_array(F.collect_list("file")), ",")).alias("listed"))


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM {DEEP}), walk AS (SELECT import, file, 0 AS d FROM {DEEP_ROOTS} r UNION SELECT w.import, s.target, w.d + 1 FROM walk w JOIN s ON s.file = w.file WHERE w.d < 129)
SELECT import, count(DISTINCT file) AS names, md5(string_agg(DISTINCT 'v' || file, ',' ORDER BY 'v' || file)) AS listed FROM walk GROUP BY import HAVING max(d) <= 128""")
def deep_export_names(spark, sf_dir):
    """Names of imports that are known for sure: not those of a ring, nor beyond 128 steps."""
    found = exports.surface(*deep(spark, sf_dir))
    return found.select("import", F.size("names").cast("long").alias("names"), F.md5(F.array_join("names", ",")).alias("listed"))


#: Modules that pass on all of one other: a third of a chain of files has no exports of its own.
PASSING = f"(SELECT * FROM {EXPORTS} e WHERE CAST(substr(file, 2) AS BIGINT) % 3 = 0)"


@query(f"""WITH RECURSIVE one AS (SELECT file, min(target) AS next FROM {STARS} s GROUP BY file HAVING count(*) = 1), step AS (SELECT o.* FROM one o JOIN {MODULES} m USING (file) WHERE NOT incomplete AND next IN (SELECT file FROM {MODULES} m2) AND file NOT IN (SELECT file FROM {PASSING} e)),
walk AS (SELECT file, file AS place, 0 AS d FROM {MODULES} m UNION SELECT w.file, s.next, w.d + 1 FROM walk w JOIN step s ON s.file = w.place WHERE w.d < 60) SELECT file, place AS canonical FROM walk WHERE place NOT IN (SELECT file FROM step)""")
def canonical_barrels(spark, sf_dir):
    own = graph(spark, sf_dir)
    own["exports"] = own["exports"].filter("cast(substr(file, 2) as bigint) % 3 = 0").withColumn("kind", F.lit("local"))
    return exports.canonical(own).select("file", "canonical")


@query(f"""WITH RECURSIVE {SURFACE}, one AS (SELECT file, min(target) AS next FROM {STARS} s GROUP BY file HAVING count(*) = 1), own AS (SELECT r.package, r.import, r.file, s.names FROM {ROOTS} r LEFT JOIN surface s USING (import) JOIN {MODULES} m ON m.file = r.file)
SELECT a.import, b.import AS other FROM own a JOIN own b USING (package) WHERE a.import = b.import OR a.file = b.file OR (a.import = package AND a.names IS NOT NULL AND b.names IS NOT NULL AND NOT list_has_any(a.names, b.names))""")
def compatible_imports(spark, sf_dir):
    return exports.compatible_imports(frame(spark, sf_dir, "roots"), graph(spark, sf_dir)).select("import", "other")


RESOLVE = f"""q AS (SELECT DISTINCT package, 'v' || CAST(substr(file, 2) AS BIGINT) AS symbol FROM {EXPORTS} e WHERE CAST(substr(file, 2) AS BIGINT) % 3 = 0),
state AS (SELECT symbol, r.import, r.file, symbol AS path FROM q JOIN {ROOTS} r USING (package) UNION
 SELECT s.symbol, s.import, n.file, n.path FROM state s, LATERAL (SELECT e.target_file AS file, e.target_name AS path FROM {EXPORTS} e WHERE e.file = s.file AND e.name = s.path AND e.kind = 'named'
   UNION ALL SELECT t.target, s.path FROM {STARS} t WHERE t.file = s.file AND EXISTS (SELECT 1 FROM {MODULES} m WHERE m.file = s.file) AND NOT EXISTS (SELECT 1 FROM {EXPORTS} e WHERE e.file = s.file AND e.name = s.path)) n),
ends AS (SELECT DISTINCT s.symbol, s.import, e.file, e.target_name AS path FROM state s JOIN {EXPORTS} e ON e.file = s.file AND e.name = s.path WHERE e.kind = 'local'),
met AS (SELECT n.*, d.entry_id, d.sig FROM ends n LEFT JOIN {DECLARED} d ON d.file = n.file AND d.path = n.path AND d.kind <> 'doc'),
stuck AS (SELECT DISTINCT symbol, import FROM state s LEFT JOIN {MODULES} m USING (file) WHERE coalesce(incomplete, TRUE) UNION SELECT symbol, import FROM met WHERE entry_id IS NULL)"""


@query(f"""WITH RECURSIVE {RESOLVE}, seen AS (SELECT symbol, import, count(DISTINCT entry_id) AS n, count(DISTINCT file || '|' || path) > 1 AND count(DISTINCT sig) > 1 AS amb FROM met WHERE entry_id IS NOT NULL GROUP BY ALL)
SELECT import, symbol, CASE WHEN amb THEN 'ambiguous' WHEN (symbol, import) IN (SELECT (symbol, import) FROM stuck) THEN 'unresolved' WHEN n IS NULL THEN 'not_exported' ELSE 'exact' END AS status, coalesce(n, 0) AS n_entries FROM q JOIN (SELECT DISTINCT package, import FROM {ROOTS} r) USING (package) LEFT JOIN seen USING (symbol, import)""")
def export_statuses(spark, sf_dir):
    """What each import makes of each symbol: exact, ambiguous, unresolved or not exported."""
    roots, own = frame(spark, sf_dir, "roots"), graph(spark, sf_dir)
    wanted = own["exports"].filter("cast(substr(file, 2) as bigint) % 3 = 0").select("package", F.concat(F.lit("v"), F.substring("file", 2, 20)).alias("symbol")).distinct().join(roots.select("package", "import").distinct(), "package")
    return exports.statuses(wanted, roots, own, frame(spark, sf_dir, "declared")).select("import", "symbol", "status", F.size("entry_ids").cast("long").alias("n_entries"))


GRAPH = "SELECT CAST(p_partkey AS BIGINT) AS p FROM part"


@query(f"""WITH p AS ({GRAPH}) SELECT 'f' || p || '.d.ts' AS file, 'export' AS what, 'a' || p AS name, 'local' AS kind, CAST(NULL AS VARCHAR) AS target_file, 'a' || p AS target_name FROM p UNION ALL SELECT 'f' || p || '.d.ts', 'export', 'alias' || p, 'named', 'f' || (p + 1) || '.d.ts', 'a' || (p + 1) FROM p WHERE p < (SELECT max(p) FROM p)
UNION ALL SELECT 'f' || p || '.d.ts', 'export', 'alias' || p, 'named', 'f' || (p + 1) || '.js', 'a' || (p + 1) FROM p WHERE p = (SELECT max(p) FROM p) UNION ALL SELECT 'f' || p || '.d.ts', 'import', 'ns', 'namespace', 'external:react', NULL FROM p UNION ALL SELECT 'f' || p || '.d.ts', 'export', 'default', 'local', NULL, 'K' || p FROM p
UNION ALL SELECT 'f' || p || '.d.ts', 'star', NULL, NULL, 'f' || (p - 1) || '.d.ts', NULL FROM p WHERE p > 0 AND p % 3 = 0""")
def module_graph(spark, sf_dir):
    """Bindings and stars read from generated declaration files, with import paths resolved against the package's files."""
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p")
    text = F.expr("concat('import * as ns from \"react\";\nexport declare const a', p, ': Map<string, number>;\nexport { a', p + 1, ' as alias', p, ' } from ''./f', p + 1, '.js'';\nexport default class K', p, ' {\n  export: string;\n}\n', CASE WHEN p > 0 AND p % 3 = 0 THEN concat('export * from ''./f', p - 1, ''';\n') ELSE '' END)")
    own = modules.graph(p.select(F.lit("k").alias("package"), F.concat(F.lit("f"), "p", F.lit(".d.ts")).alias("file"), text.alias("text")))
    none = F.lit(None).cast("string")
    bound = own["exports"].withColumn("what", F.lit("export")).unionByName(own["imports"].withColumn("what", F.lit("import"))).select("file", "what", "name", "kind", "target_file", "target_name")
    return bound.unionByName(own["stars"].select("file", F.lit("star").alias("what"), none.alias("name"), none.alias("kind"), F.col("target").alias("target_file"), none.alias("target_name")))


@query(f"""WITH p AS ({GRAPH}), k AS (SELECT DISTINCT 'kit' || (p // 10) AS package FROM p) SELECT package, package AS import, '/types' AS conditions, 'index.d.ts' AS file FROM k
UNION ALL SELECT package, package || '/old', c, 'old.' || split_part(c, '/', 2) || '.d.ts' FROM k, (SELECT unnest(['/import', '/require']) AS c) UNION ALL SELECT 'kit' || (p // 10), 'kit' || (p // 10) || '/parts/p' || p, '', 'lib/p' || p || '.d.ts' FROM p WHERE p % 10 NOT IN (7, 8)
UNION ALL SELECT 'kit' || (p // 10), 'kit' || (p // 10) || '/parts/p' || p, '', 'special.d.ts' FROM p WHERE p % 10 = 8""")
def package_entrypoints(spark, sf_dir):
    """Entrypoints of generated export maps: conditions, a pattern over files, one path of it blocked and one that has a target of its own."""
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p", "concat('kit', p_partkey div 10) AS package")
    manifest = F.expr("""concat('{"exports": {".": {"types": "./index.d.ts", "default": "./index.js"}, "./old": {"import": "./old.import.d.ts", "require": "./old.require.d.ts"}, "./parts/*": "./lib/*.d.ts", "./package.json": "./package.json"', array_join(transform(array_sort(collect_list(p)), x -> CASE WHEN x % 10 = 7 THEN concat(', "./parts/p', x, '": null') WHEN x % 10 = 8 THEN concat(', "./parts/p', x, '": "./special.d.ts"') ELSE '' END), ''), '}}')""")
    files_ = p.select("package", F.concat(F.lit("lib/p"), "p", F.lit(".d.ts")).alias("file")).unionByName(p.select("package", F.lit("index.d.ts").alias("file")).distinct())
    return modules.roots(p.groupBy("package").agg(manifest.alias("manifest")), files_).select("package", "import", "conditions", "file")


WORDS_OF = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s,?()`''\"]+'), lambda w: w <> ''))"


def named_questions(spark, sf_dir):
    """A question for each generated dependency: by its name, as the head of a call, by a part that only Go's modules go by, or not at all."""
    return frame(spark, sf_dir, "deps").selectExpr("p AS question_id", "CASE p % 5 WHEN 0 THEN concat('How does ', name, ' work?') WHEN 1 THEN concat('what is ', name, '.parse(x)') WHEN 2 THEN concat('use m', p, ' now') WHEN 3 THEN concat('call ', name, '::new(`a`)') ELSE 'nothing here' END AS text")


QUESTIONS = f"(SELECT p AS question_id, CASE p % 5 WHEN 0 THEN 'How does ' || name || ' work?' WHEN 1 THEN 'what is ' || name || '.parse(x)' WHEN 2 THEN 'use m' || p || ' now' WHEN 3 THEN 'call ' || name || '::new(`a`)' ELSE 'nothing here' END AS text FROM {sql('deps')} d)"
MENTIONED = f"""w AS (SELECT question_id, unnest({WORDS_OF}) AS word FROM {QUESTIONS} q), direct AS (SELECT DISTINCT eco, name FROM {sql('deps')} d WHERE direct),
hit AS (SELECT question_id, name, min(eco) AS eco FROM w JOIN direct d ON w.word = lower(d.name) OR starts_with(w.word, lower(d.name) || '.') OR starts_with(w.word, lower(d.name) || '::') OR (d.eco = 'go' AND w.word = regexp_extract(lower(d.name), '([^/]*)$', 1)) GROUP BY ALL)"""


@query(f"WITH {MENTIONED} SELECT question_id, eco, name FROM hit")
def mentioned_packages(spark, sf_dir):
    return packages.mentioned(named_questions(spark, sf_dir), frame(spark, sf_dir, "deps"))


@query(f"""WITH {MENTIONED}, first80 AS (SELECT * FROM direct ORDER BY eco, name LIMIT 80) SELECT question_id, count(*) AS n, bool_and(broad) AS broad, md5(string_agg(eco || ':' || name, ',' ORDER BY eco, name)) AS chosen FROM (SELECT question_id, eco, name, FALSE AS broad FROM hit
 UNION ALL SELECT question_id, eco, name, TRUE FROM {QUESTIONS} q, first80 WHERE question_id NOT IN (SELECT question_id FROM hit)) GROUP BY question_id""")
def chosen_packages(spark, sf_dir):
    rows = packages.choose(named_questions(spark, sf_dir), frame(spark, sf_dir, "deps"))
    named = F.array_sort(F.collect_list(F.struct("eco", "name")))
    return rows.groupBy("question_id").agg(F.count("*").alias("n"), F.bool_and("broad").alias("broad"), F.md5(F.array_join(F.transform(named, lambda e: F.concat(e["eco"], F.lit(":"), e["name"])), ",")).alias("chosen"))


@query(f"""WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS asked FROM part), d AS (SELECT DISTINCT eco, name, version, direct FROM {sql('deps')} x)
SELECT asked, eco || ':' || name || '@' || version AS id, n FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY direct DESC, eco, name, version) AS n FROM a JOIN d ON contains(lower(name), lower(asked)) OR (length(asked) >= 3 AND contains(lower(asked), regexp_extract(lower(name), '([^/]*)$', 1)))) WHERE n <= 6""")
def similar_packages(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("asked")).distinct()
    return packages.similar(frame(spark, sf_dir, "deps"), names).withColumn("n", F.col("n").cast("long"))


@query(f"""SELECT eco, name, version, row_number() OVER (ORDER BY starts_with(regexp_replace(version, '^v+', ''), '3.') DESC, direct DESC, eco, name, version) AS rank FROM {sql('deps')} d WHERE eco = 'go' AND (ends_with(name, '/M3') OR regexp_extract(name, '([^/]*)$', 1) = 'M3') OR eco = 'npm' AND lower(name) = lower('M3') OR eco = 'pypi' AND plain = 'm3' OR eco = 'cargo' AND replace(lower(name), '_', '-') = 'm3'""")
def find_package(spark, sf_dir):
    return packages.find(frame(spark, sf_dir, "deps"), packages.Spec.parse("M3@3")).select("eco", "name", "version", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {MENTIONED}, first80 AS (SELECT * FROM direct ORDER BY eco, name LIMIT 80), s AS (SELECT eco, name, min(p) % 3 = 0 AS fetched, min(p) % 4 = 1 AS upstream, CASE WHEN min(p) % 5 = 0 THEN 'note' END AS note FROM {sql('deps')} d WHERE p % 6 <> 0 GROUP BY ALL)
SELECT question_id, count(fetched) AS searched, count(*) FILTER (WHERE NOT fetched) AS local, count(*) FILTER (WHERE fetched) AS registry, count(*) FILTER (WHERE upstream) AS upstream, count(note) AS notes, count(*) FILTER (WHERE fetched IS NULL) AS unavailable
FROM {QUESTIONS} q CROSS JOIN first80 LEFT JOIN s USING (eco, name) WHERE question_id NOT IN (SELECT question_id FROM hit) GROUP BY question_id""")
def broad_answer_counts(spark, sf_dir):
    deps = frame(spark, sf_dir, "deps")
    there = deps.filter("p % 6 <> 0").groupBy("eco", "name").agg((F.min("p") % 3 == 0).alias("fetched"), (F.min("p") % 4 == 1).alias("upstream"), F.when(F.min("p") % 5 == 0, "note").alias("note"))
    return packages.broad_counts(named_questions(spark, sf_dir), deps, there)


PROSE = """SELECT CAST(p_partkey AS BIGINT) AS p, 'k' || (p_partkey % 20) AS package, p_type, p_size, p_name FROM part"""


@query(f"""WITH p AS ({PROSE}) SELECT p, package || '/sub' AS import, p % 4 IN (0, 1) AS named FROM p""")
def names_import(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p", "concat('k', p_partkey % 20) AS package")
    text = F.expr("CASE p % 4 WHEN 0 THEN concat('see ', package, '/sub.') WHEN 1 THEN concat('(', package, '/sub) is') WHEN 2 THEN concat('see ', package, '/sub/x') ELSE concat('see a', package, '/sub') END")
    return p.select("p", F.concat("package", F.lit("/sub")).alias("import"), scopes.mentions_import(text, F.concat("package", F.lit("/sub"))).alias("named"))


@query(f"""WITH RECURSIVE {SURFACE}, edges AS (SELECT file, target FROM {STARS} s UNION SELECT file, target_file FROM {EXPORTS} e WHERE target_file IS NOT NULL), reach2 AS (SELECT import, file FROM {ROOTS} r WHERE import = package UNION SELECT r.import, s.target FROM reach2 r JOIN edges s ON s.file = r.file),
own AS (SELECT r.package, r.import, s.names FROM {ROOTS} r LEFT JOIN surface s USING (import)), ok AS (SELECT package, b.import FROM own a JOIN own b USING (package) WHERE a.import = package AND (b.import = package OR (a.names IS NOT NULL AND b.names IS NOT NULL AND NOT list_has_any(a.names, b.names)))),
e AS (SELECT 'f' || p // 60 AS package, p AS entry_id, CASE WHEN p % 2 = 0 THEN 'doc' ELSE 'function' END AS kind, 'e' || (p % 40) AS path, 's' || p AS file, CASE WHEN p % 4 = 0 THEN 'f' || p // 60 || '/' || p ELSE 'other/x' END AS imp FROM (SELECT CAST(p_partkey AS BIGINT) AS p FROM part) z),
k AS (SELECT * FROM e WHERE CASE WHEN kind = 'doc' THEN NOT starts_with(imp, 'f') OR (package, imp) IN (SELECT (package, import) FROM ok) ELSE file IN (SELECT file FROM reach2) END)
SELECT package, min(entry_id) AS entry_id, path, kind FROM k GROUP BY package, path, kind""")
def import_scope(spark, sf_dir):
    """Entries that suit the root import: prose whose imports are compatible, declarations that it reaches, without repetitions."""
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p")
    entries = p.selectExpr("concat('f', p div 60) AS package", "p AS entry_id", "CASE WHEN p % 2 = 0 THEN 'doc' ELSE 'function' END AS kind", "concat('e', p % 40) AS path", "CASE WHEN p % 2 = 0 THEN 'prose' ELSE 'code' END AS sig", "'' AS doc", "concat('s', p) AS file", "array(CASE WHEN p % 4 = 0 THEN concat('f', p div 60, '/', p) ELSE 'other/x' END) AS imports")
    wanted = entries.select("package", F.col("package").alias("import")).distinct()
    return scopes.docs_entries(entries, frame(spark, sf_dir, "roots"), graph(spark, sf_dir), wanted).select("package", "entry_id", "path", "kind")


@query(f"""WITH RECURSIVE ask AS (SELECT CAST(substr(file, 2) AS BIGINT) AS question_id, 'w' || substr(file, 2) AS called, 'v' || substr(file, 2) AS other, r.import, r.file FROM {ROOTS} r), {RESOLVE.replace(f"SELECT symbol, r.import, r.file, symbol AS path FROM q JOIN {ROOTS} r USING (package) UNION", "SELECT called AS symbol, a.import, a.file, called AS path FROM ask a UNION").replace("q AS (", "q0 AS (").replace(EXPORTS, f"(SELECT * REPLACE (CASE WHEN kind = 'local' THEN target_name ELSE name END AS name) FROM {EXPORTS} y)")}
SELECT a.question_id, m.entry_id FROM ask a JOIN met m ON m.symbol = a.called AND m.import = a.import WHERE m.entry_id IS NOT NULL AND (a.called, a.import) NOT IN (SELECT (symbol, import) FROM stuck)""")
def called_exports(spark, sf_dir):
    """APIs that a question calls by name and that its import exports without doubt."""
    roots, own = frame(spark, sf_dir, "roots"), graph(spark, sf_dir)
    # Exports under the name of the declaration, so that what is called is what is declared.
    own["exports"] = own["exports"].withColumn("name", F.when(F.col("kind") == "local", F.col("target_name")).otherwise(F.col("name")))
    questions = roots.select(F.substring("file", 2, 20).cast("long").alias("question_id"), F.concat(F.lit("how do I use w"), F.substring("file", 2, 20), F.lit("(x) or aw"), F.substring("file", 2, 20), F.lit("x(1)?")).alias("text"), "package", "import")
    return scopes.public_calls(questions.select("question_id", "text"), questions.select("question_id", "package", "import"), roots, own, frame(spark, sf_dir, "declared")).select("question_id", "entry_id")


@query(f"""WITH p AS ({PROSE}) SELECT p AS question_id, '> line 1: The whole page is about ' || p_type || ' things.' || CASE WHEN p % 3 = 0 THEN '' ELSE chr(10) || '> line 5: This part sets up ' || p_name || ' first.' END AS context FROM p""")
def quoted_context(spark, sf_dir):
    """Leads of the page and of the section above a hit; a short one and one that the hit repeats aren't quoted."""
    p = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) p", "p_type", "p_name")
    page = p.selectExpr("p * 3 AS entry_id", "1 AS line", "concat('<Note>\nThe whole page is\nabout ', p_type, ' things.\n\nMore text.') AS doc", "array() AS parents", "p")
    part = p.selectExpr("p * 3 + 1 AS entry_id", "5 AS line", "CASE WHEN p % 3 = 0 THEN 'Short.' ELSE concat('This part sets up ', p_name, ' first.\n```js\nx\n```') END AS doc", "array(1) AS parents", "p")
    hit = p.selectExpr("p * 3 + 2 AS entry_id", "9 AS line", "'The hit.' AS doc", "array(1, 5) AS parents", "p")
    entries = page.withColumn("parents", F.col("parents").cast("array<int>")).unionByName(part).unionByName(hit).select(F.lit("k").alias("package"), "entry_id", F.lit("doc").alias("kind"), F.concat(F.lit("d"), "p", F.lit(".md")).alias("file"), "line", "doc", "parents")
    hits = p.select(F.col("p").alias("question_id"), F.lit("k").alias("package"), (F.col("p") * 3 + 2).alias("entry_id"))
    return scopes.context(hits, entries).select("question_id", "context")


@query("""WITH b AS (SELECT l_orderkey AS q, l_linenumber AS n, repeat('line of text ' || l_linenumber || chr(10), CAST(l_quantity AS INT)) AS t FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1),
s AS (SELECT *, greatest(400 - CAST(ceil(coalesce(sum(length(t) + 1) OVER (PARTITION BY q ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 3) AS BIGINT), 0) AS left_ FROM b),
f AS (SELECT *, ceil(length(t) / 3) + 1 > left_ AS trimmed FROM s), g AS (SELECT *, coalesce(max(CAST(trimmed AS INT)) OVER (PARTITION BY q ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missed FROM f)
SELECT q AS question_id, n AS rank, trimmed, CAST(CASE WHEN trimmed THEN left_ * 3 // length('line of text ' || n || chr(10)) ELSE length(t) // length('line of text ' || n || chr(10)) END AS BIGINT) AS lines FROM g
WHERE missed = 0 AND (NOT trimmed OR left_ > 120 AND left_ * 3 // length('line of text ' || n || chr(10)) > 1)""")
def pack_trimmed_blocks(spark, sf_dir):
    """Blocks of lines by order, packed into 400 tokens; the one that crosses the budget is cut at a line's end."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("times"))
    first = relational.first_wins(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    blocks = first.select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("rank"), "times")
    packed = relational.pack_blocks(blocks, "question_id", [F.col("rank")], "block", 400, made=F.expr("repeat(concat('line of text ', rank, '\n'), times)"))
    return packed.select("question_id", "rank", "trimmed", F.regexp_count("block", F.lit("line of text")).cast("long").alias("lines"))


OLD = sql("old_entries")
IDENT = "list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda w: lower(w)), lambda w: length(w) >= 4))"


def entry_questions(spark, sf_dir):
    """A question about every 25th generated entry: by its words, by its name, about changes or to reject unknown keys."""
    return frame(spark, sf_dir, "old_entries").filter("entry_id % 25 = 0").selectExpr("entry_id AS question_id", "CASE entry_id % 4 WHEN 0 THEN concat('which ', split(doc, ' ')[0], ' is ', name) WHEN 1 THEN concat('What changed in ', name, '?') WHEN 2 THEN concat('reject unknown keys of ', split(doc, ' ')[1]) ELSE concat('sized number ', entry_id, ' kind') END AS text")


EQ = f"(SELECT entry_id AS question_id, CASE entry_id % 4 WHEN 0 THEN 'which ' || split_part(doc, ' ', 1) || ' is ' || name WHEN 1 THEN 'What changed in ' || name || '?' WHEN 2 THEN 'reject unknown keys of ' || split_part(doc, ' ', 2) ELSE 'sized number ' || entry_id || ' kind' END AS text FROM {OLD} o WHERE entry_id % 25 = 0)"


@query(f"""SELECT question_id, n.name FROM (SELECT question_id, unnest({IDENT}) AS word FROM {EQ} q) w JOIN (SELECT DISTINCT lower(name) AS name FROM {OLD} o WHERE kind IN ('function', 'class') AND doc <> '' AND NOT legacy AND NOT contains(path, '._') AND length(path) - length(replace(path, '.', '')) <= 2) n ON n.name = w.word""")
def api_words(spark, sf_dir):
    return retrieval.api_words(frame(spark, sf_dir, "old_entries"), entry_questions(spark, sf_dir)).select("question_id", F.explode("names").alias("name"))


def weighed(fields: dict[str, int], name: str) -> str:
    """CTEs ending in ``name(entry_id, term, tf)`` and ``name_len``: weighted terms of several columns of the entries."""
    parts = [O.terms(f"{name}_{c}", f"(SELECT entry_id, {c} AS text FROM {OLD} o)", "entry_id", "text").strip() for c in fields]
    each = " UNION ALL ".join(f"SELECT entry_id, term, {w} AS w FROM {name}_{c}" for c, w in fields.items())
    return ",\n".join(parts) + f", {name}_all AS ({each}), {name} AS (SELECT entry_id, term, least(sum(w), 65535) AS tf FROM {name}_all GROUP BY ALL), {name}_len AS (SELECT entry_id, greatest(coalesce(sum(w), 0), 1) AS len FROM (SELECT entry_id FROM {OLD} o) LEFT JOIN {name}_all USING (entry_id) GROUP BY entry_id)"


def scored(tf: str, name: str) -> str:
    return f"""{name}_raw AS (SELECT question_id, entry_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_))) * weight) * (0.4 + count(*) FILTER (WHERE weight >= 1) / n_full), 9) AS score
 FROM q JOIN {tf} USING (term) JOIN (SELECT term, count(*) AS df FROM {tf} GROUP BY 1) USING (term) JOIN {tf}_len USING (entry_id), (SELECT count(*) AS n, avg(len) AS avg_ FROM {tf}_len) GROUP BY question_id, entry_id, n_full),
{name} AS (SELECT question_id, entry_id, score / greatest(max(score) OVER (PARTITION BY question_id), 1e-6) AS s FROM {O.best(f'{name}_raw', 1500)})"""


BODY, HEAD = {"name": 8, "doc": 2}, {"name": 2}
RANK = f"""{weighed(BODY, 'bt')}, {weighed(HEAD, 'ht')}, {O.question_terms('q', EQ, 'question_id', True).strip()}, {O.question_terms('qp', EQ, 'question_id', False).strip()},
{scored('bt', 'b')}, {scored('ht', 'h')}, lex AS (SELECT question_id, entry_id, 0.75 * coalesce(b.s, 0) + 0.25 * coalesce(h.s, 0) AS lex FROM b FULL JOIN h USING (question_id, entry_id)),
rare AS (SELECT question_id, term FROM qp LEFT JOIN (SELECT term, count(*) AS df FROM bt GROUP BY 1) USING (term) WHERE coalesce(df, 0) < 0.03 * (SELECT count(*) FROM {OLD} o)),
nt AS (SELECT DISTINCT entry_id, term FROM nm), hits AS (SELECT question_id, entry_id, CASE WHEN count(*) = 1 THEN 1.5 ELSE 1.9 END AS hit FROM nt JOIN rare USING (term) GROUP BY ALL),
idents AS (SELECT question_id, list(DISTINCT i) AS ids FROM (SELECT question_id, unnest(list_concat(list_filter({IDENT}, lambda w: FALSE), list_transform(list_filter(regexp_split_to_array(text, '[\\s,?]+'), lambda w: regexp_matches(w, '[_.($]|^.+[A-Z]')), lambda w: lower(w)))) AS i FROM {EQ} z
  UNION ALL SELECT question_id, n.name FROM (SELECT question_id, unnest({IDENT}) AS word FROM {EQ} q1) w JOIN (SELECT DISTINCT lower(name) AS name FROM {OLD} o WHERE kind IN ('function', 'class') AND doc <> '' AND NOT legacy) n ON n.name = w.word) GROUP BY 1),
w AS (SELECT l.question_id, l.entry_id, e.package, lex * CASE WHEN e.kind = 'doc' THEN CASE WHEN e.file = 'CHANGELOG.md' THEN CASE WHEN contains(lower(qq.text), 'change') THEN 1.5 ELSE 0.5 END ELSE 1.15 END
  ELSE CASE WHEN list_contains(coalesce(ids, []), lower(e.name)) THEN 1.8 ELSE 1 END * CASE WHEN len(list_filter(coalesce(ids, []), lambda i: strlen(i) > strlen(e.name) AND (ends_with(lower(e.path), i) OR ends_with(i, '.' || lower(e.name))))) > 0 THEN 1.4 ELSE 1 END END
  * CASE WHEN e.legacy THEN 0.35 ELSE 1 END * coalesce(hit, 1.0) AS score FROM lex l JOIN {OLD} e USING (entry_id) JOIN {EQ} qq USING (question_id) LEFT JOIN idents USING (question_id) LEFT JOIN hits USING (question_id, entry_id))"""
#: Names are terms whole; of headings capitalized words are, as they are here.
NAMES = O.terms("nm", f"(SELECT entry_id, CASE WHEN kind <> 'doc' THEN name ELSE lower(name) END AS text FROM {OLD} o)", "entry_id", "text").strip()


@query(f"WITH {NAMES}, {RANK} SELECT question_id, entry_id, round(score, 6) AS score, rank FROM {O.best('(SELECT question_id, entry_id, round(score, 9) AS score FROM w)', 20)}")
def hybrid_rank(spark, sf_dir):
    """Keyword ranking of generated entries with name hits and boosts, end to end."""
    ranked = retrieval.hybrid(frame(spark, sf_dir, "old_entries"), entry_questions(spark, sf_dir), BODY, HEAD, wanted=retrieval.Wanted(20)).withColumn("score", F.round("score", 9))
    return retrieval.top(ranked, ["question_id"], 20).select("question_id", "entry_id", F.round("score", 6).alias("score"), "rank")


@query(f"""SELECT package, count(*) FILTER (WHERE kind <> 'doc') AS n_symbols, count(*) FILTER (WHERE kind = 'doc') AS n_sections FROM {OLD} o GROUP BY package""")
def package_overview(spark, sf_dir):
    from .engine import Engine

    entries = frame(spark, sf_dir, "old_entries")
    return Engine(spark, None, None, entries).overview().select("package", "n_symbols", "n_sections")


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY length(path) - length(replace(path, '.', '')), length(path), path, entry_id) AS n FROM {OLD} o WHERE kind <> 'doc' AND NOT legacy AND doc <> '')
SELECT package, array_to_string(list(path ORDER BY n), ',') AS symbols FROM t WHERE n <= 60 GROUP BY package""")
def overview_symbols(spark, sf_dir):
    from .engine import Engine

    return Engine(spark, None, None, frame(spark, sf_dir, "old_entries")).overview().select("package", F.array_join("symbols", ",").alias("symbols"))


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY file, line, entry_id) AS n FROM {OLD} o WHERE kind = 'doc' AND file = 'README.md')
SELECT package, list(('### ' || name || ' — ' || package || '@' || version || ' ' || file || ':' || line || chr(10) || doc || chr(10)) ORDER BY n)[1] AS first_block, count(*) AS blocks FROM t WHERE n <= 3 GROUP BY package""")
def readme_blocks(spark, sf_dir):
    from .engine import Engine

    found = Engine(spark, None, None, frame(spark, sf_dir, "old_entries")).overview().filter("blocks is not null")
    return found.select("package", F.col("blocks")[0].alias("first_block"), F.size("blocks").cast("long").alias("blocks"))


@query(f"SELECT package, path, file, array_to_string(list(sig ORDER BY entry_id), '|') AS sigs FROM (SELECT *, row_number() OVER (PARTITION BY package, path, file ORDER BY entry_id) AS n FROM (SELECT * REPLACE ('same' || (entry_id % 15) AS path) FROM {OLD} o WHERE kind NOT IN ('doc', 're-export'))) WHERE n BETWEEN 2 AND 9 GROUP BY ALL")
def symbol_overloads(spark, sf_dir):
    own = frame(spark, sf_dir, "old_entries").withColumn("path", F.concat(F.lit("same"), (F.col("entry_id") % 15).cast("string")))
    return symbols.overloads(own).select("package", "path", "file", F.array_join("sigs", "|").alias("sigs"))


@query(f"""WITH h AS (SELECT symbol, o.* FROM {sql('asked_symbols')} a JOIN {OLD} o ON lower(o.name) = lower(regexp_extract(regexp_replace(symbol, '(\\(\\))+$', ''), '([^.]*)$', 1)) WHERE kind <> 'doc' UNION ALL SELECT 'many' || entry_id % 9, o.* FROM {OLD} o WHERE entry_id % 40 < 2 AND kind <> 'doc')
SELECT symbol, count(DISTINCT package || '|' || file || '|' || path) > 1 AND count(DISTINCT sig) > 1 AS ambiguous FROM h GROUP BY symbol""")
def ambiguous_symbols(spark, sf_dir):
    own = frame(spark, sf_dir, "old_entries")
    hits = symbols.lookup(own, frame(spark, sf_dir, "asked_symbols")).select("symbol", "package", "entry_id")
    more = own.filter("entry_id % 40 < 2 and kind <> 'doc'").select(F.concat(F.lit("many"), (F.col("entry_id") % 9).cast("string")).alias("symbol"), "package", "entry_id")
    return symbols.ambiguous(hits.unionByName(more), own)


@query(f"""WITH c AS (SELECT entry_id % 4 AS k, package, path FROM {OLD} o WHERE kind <> 'doc' AND NOT legacy), s AS (SELECT DISTINCT path, entry_id % 3 AS n FROM {OLD} o2 WHERE entry_id % 2 = 0)
SELECT CASE k WHEN 0 THEN 'removed' WHEN 1 THEN 'renamed' WHEN 2 THEN 'deprecated' ELSE 'signature_changed' END AS change, count(*) AS symbols, count(*) FILTER (WHERE n > 0) AS affected, CAST(coalesce(sum(n), 0) AS BIGINT) AS sites FROM c LEFT JOIN (SELECT path, max(n) AS n FROM s GROUP BY path) USING (path) GROUP BY 1""")
def upgrade_summary(spark, sf_dir):
    """Changes and call sites counted by kind of change."""
    own = frame(spark, sf_dir, "old_entries")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("removed", "renamed", "deprecated", "signature_changed")]), (F.col("entry_id") % 4 + 1).cast("int"))
    changes = own.filter("kind <> 'doc' and not legacy").select("package", "path", kinds.alias("change"))
    counts = own.filter("entry_id % 2 = 0").groupBy("path").agg(F.max(F.col("entry_id") % 3).alias("n")).filter("n > 0")
    sites = counts.select("path", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("line"))
    return upgrade.summary(changes, sites)


RESULTS = "SELECT CASE event_id % 4 WHEN 0 THEN 'fetched' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'keyword' ELSE 'fetched-keyword' END AS variant, event_id % 105 AS id, value * 10 AS tokens, value AS ms, event_id % 11 <> 0 AS passed, event_id % 13 = 0 AS error, event_id % 7 AS calls, CASE event_id % 3 WHEN 0 THEN 'older' WHEN 1 THEN 'newer' ELSE 'single' END AS line, event_id % 5 = 0 AS held_out FROM events"


def results(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "CASE event_id % 4 WHEN 0 THEN 'fetched' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'keyword' ELSE 'fetched-keyword' END AS variant", "event_id % 105 AS id", "value * 10 AS tokens", "value AS ms", "event_id % 11 <> 0 AS passed", "event_id % 13 = 0 AS error", "event_id % 7 AS calls",
        "CASE event_id % 3 WHEN 0 THEN 'older' WHEN 1 THEN 'newer' ELSE 'single' END AS line", "event_id % 5 = 0 AS held_out",
    )


@query(f"""WITH r AS ({RESULTS}), v AS (SELECT variant, list_sort(list(tokens)) AS t, list_sort(list(ms)) AS m, count(*) AS answered, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE error) AS errors, round(avg(calls), 6) AS mean_calls FROM r WHERE ms IS NOT NULL GROUP BY variant)
SELECT variant, answered, passed, errors, mean_calls, round(t[answered // 2 + 1], 6) AS median_tokens, round(m[answered // 2 + 1], 6) AS median_ms, round(m[CAST(least(answered - 1, floor(answered * 0.95)) AS BIGINT) + 1], 6) AS p95_ms FROM v""")
def bench_summary(spark, sf_dir):
    return bench.summary(results(spark, sf_dir).filter("ms is not null"))


@query(f"""WITH r AS ({RESULTS}), s AS (SELECT variant, count(*) FILTER (WHERE passed) AS passed FROM r GROUP BY 1), f(variant, floor_) AS (VALUES ('fetched', 96), ('hybrid', 62), ('first-use-default', 88)), h(variant, keyword) AS (VALUES ('hybrid', 'keyword'), ('fetched', 'fetched-keyword'))
SELECT variant AS subject, 'floor' AS rule, passed, CAST(floor_ AS BIGINT) AS least, passed >= floor_ AS ok FROM f JOIN s USING (variant) UNION ALL SELECT h.variant, 'keyword', a.passed, b.passed, a.passed >= b.passed FROM h JOIN s a ON a.variant = h.variant JOIN s b ON b.variant = h.keyword""")
def bench_floors(spark, sf_dir):
    return bench.floors(results(spark, sf_dir).groupBy("variant").agg(F.count_if("passed").alias("passed")))


@query(f"""WITH r AS ({RESULTS}), g AS (SELECT variant, line AS grp, passed FROM r UNION ALL SELECT variant, 'held-out', passed FROM r WHERE held_out) SELECT variant, grp AS "group", count(*) FILTER (WHERE passed) || '/' || count(*) AS share FROM g GROUP BY ALL""")
def bench_table(spark, sf_dir):
    return bench.by_group(results(spark, sf_dir))


@query(f"""SELECT entry_id, CASE WHEN kind = 'doc' THEN name || '. ' || left(doc, 600) ELSE name || ' ' || regexp_extract(path, '([^.:]*)[.:]+[^.:]*$', 1) || '. ' || left(doc, 600) END AS text FROM {OLD} o""")
def embedding_texts(spark, sf_dir):
    from .engine import embed_text, with_fields

    entries = with_fields(frame(spark, sf_dir, "old_entries"))
    return entries.select("entry_id", embed_text(entries).alias("text"))


@query(f"""SELECT entry_id, concat(CASE WHEN kind = 'doc' THEN '' ELSE name END, '|', CASE WHEN kind = 'doc' THEN '' ELSE path END, '|', sig, '|', CASE WHEN kind = 'doc' THEN file ELSE '' END, '|', CASE WHEN kind = 'doc' THEN regexp_extract(doc, '^(.*?)(?:[.!?](?:\\s|$)|$)', 1) ELSE doc END, '|', name) AS fields FROM {OLD} o WHERE NOT contains(doc, '. ') OR kind = 'doc'""")
def entry_fields(spark, sf_dir):
    from .engine import with_fields

    rows = with_fields(frame(spark, sf_dir, "old_entries").filter("not contains(doc, '. ') or kind = 'doc'"))
    e = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("entry_id", F.concat_ws("|", e("f_name"), e("f_path"), "f_sig", e("f_file"), "f_first", "f_topic").alias("fields"))


@query(f"SELECT question_id, ids FROM (SELECT item_id AS question_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(list_filter(regexp_split_to_array(text, '[\\s,?''\"\\[\\]]+'), lambda w: w <> '' AND (starts_with(w, '`') OR regexp_matches(w, '[_.($]|::') OR regexp_matches(regexp_replace(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}]+$', ''), '^.+[A-Z]'))), lambda w: regexp_replace(regexp_replace(w, '^[`().:!;]+', ''), '[`().:!;]+$', '')), lambda w: strlen(w) >= 2 AND regexp_matches(w, '[A-Za-z]') AND NOT contains(w, '.') AND NOT contains(w, '#')), lambda w: lower(w)))), ',') AS ids FROM benchmark)")
def question_identifiers(spark, sf_dir):
    """Identifier-like words of questions (those without dots, whose last part is themselves)."""
    found = X.identifiers(F.col("text"))
    plain = F.array_sort(F.filter(found, lambda w: ~w.contains(".") & ~w.contains("#")))
    return asked(spark, sf_dir).select("question_id", F.array_join(plain, ",").alias("ids"))


@query(r"SELECT item_id AS question_id, coalesce(first_number < 7, FALSE) AS old FROM (SELECT item_id, TRY_CAST(list_filter(regexp_extract_all(text, '\d+'), lambda d: length(d) <= 3)[1] AS BIGINT) AS first_number FROM (SELECT item_id, 'Migrating to version ' || item_id % 12 || ' from ' || item_id AS text FROM benchmark))")
def old_guides(spark, sf_dir):
    n = asked(spark, sf_dir).select("question_id", F.concat(F.lit("Migrating to version "), (F.col("question_id") % 12).cast("string"), F.lit(" from "), F.col("question_id").cast("string")).alias("name"))
    return n.select("question_id", retrieval.old_guide(F.col("name"), F.lit("x.md"), F.lit(7)).alias("old"))


@query(f"WITH {O.bm25('h', '(SELECT doc_id AS entry_id, text FROM documents)', ASKED, True).strip()} SELECT question_id, entry_id, rank FROM {O.best('h', 5)}")
def indexed_questions(spark, sf_dir):
    """Questions asked of posting lists that ``Index.write`` wrote: only the buckets of their terms are read."""
    index = Index(spark, f"{shared_folder(spark)}/questions-{uuid.uuid4().hex}")
    own = docs(spark, sf_dir).withColumns({"eco": F.lit("texts"), "package": F.lit("documents"), "version": F.lit("1")})
    index.write(own, {"text": 1}, {"eco": 0})
    q = retrieval.cut(X.question_terms(asked(spark, sf_dir), True))
    there = index.at()
    post = there.lists(retrieval.cut(q.select("term").distinct())).filter("g = 0").select("entry_id", "len", "term", "tf")
    hits = retrieval.bm25_of(post, there.entries().select(F.col("body_len").alias("len")), q)
    return retrieval.top(hits, ["question_id"], 5).select("question_id", "entry_id", "rank")


@query(f"SELECT package, entry_id, n FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY entry_id) AS n FROM {sql('new_entries')} e WHERE kind = 'doc' AND file = 'CHANGELOG.md') WHERE n <= 5")
def upgrade_guide_sections(spark, sf_dir):
    return upgrade.guide_sections(frame(spark, sf_dir, "new_entries")).withColumn("n", F.col("n").cast("long"))
