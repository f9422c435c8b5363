"""Registered queries of the engine's calls over generated packages of several ecosystems and versions, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.lineage import shared_folder
from . import oracle as O
from .engine import Engine
from .generated import frame, sql
from .index import Index
from .queries import query
from .scope_queries import BODY, DECLARED, HEAD, IDENT, RESOLVE, graph

OLD, NEW = sql("old_entries"), sql("new_entries")
_COLUMNS = "package, entry_id, kind, name, path, file, sig, doc, alias_of, legacy, line, version, major"
#: Every package in two npm versions, and every other one in a PyPI one of the same name.
_PYPI = "'pypi' AS eco, package, entry_id + 30000000 AS entry_id, kind, name, path, file, sig, doc || ' from elsewhere' AS doc, alias_of, legacy, line, '9.9.9' AS version, CAST(9 AS BIGINT) AS major"
E = f"(SELECT 'npm' AS eco, {_COLUMNS} FROM {OLD} o UNION ALL SELECT 'npm', {_COLUMNS} FROM {NEW} n UNION ALL SELECT {_PYPI} FROM {OLD} o2 WHERE CAST(substr(package, 4) AS BIGINT) % 2 = 0)"
#: What the project pins: of each package one npm version, of some the PyPI one too.
PINNED = f"(SELECT DISTINCT 'npm' AS eco, package AS name, CASE WHEN CAST(substr(package, 4) AS BIGINT) % 3 = 0 THEN '2.0.0' ELSE '1.2.0' END AS version FROM {OLD} o UNION ALL SELECT DISTINCT 'pypi', package, '9.9.9' FROM {OLD} o3 WHERE CAST(substr(package, 4) AS BIGINT) % 4 = 0)"
#: Questions about an entry in its package; every fourth names none.
Q = f"(SELECT entry_id AS question_id, CASE WHEN entry_id % 4 = 0 THEN name || ' sized ' || entry_id WHEN entry_id % 4 = 1 THEN 'What changed in ' || name || ' of ' || package || '?' ELSE 'which ' || split_part(doc, ' ', 1) || ' ' || package || ' kind' END AS text FROM {OLD} o WHERE entry_id % 20 < 4 AND entry_id % 100 < 20)"


def entries(spark, sf_dir) -> DataFrame:
    old, new = frame(spark, sf_dir, "old_entries"), frame(spark, sf_dir, "new_entries")
    names = ["eco", *old.columns]
    there = old.filter("cast(substr(package, 4) as bigint) % 2 = 0")
    pypi = there.withColumns({"eco": F.lit("pypi"), "entry_id": F.col("entry_id") + 30_000_000, "doc": F.concat("doc", F.lit(" from elsewhere")), "version": F.lit("9.9.9"), "major": F.lit(9).cast("long")})
    both = old.unionByName(new).withColumn("eco", F.lit("npm")).select(names).unionByName(pypi.select(names))
    return both.withColumns({"parents": F.array().cast("array<int>"), "imports": F.array().cast("array<string>")})


def pinned(spark, sf_dir) -> DataFrame:
    own = frame(spark, sf_dir, "old_entries").select("package").distinct().withColumn("k", F.expr("cast(substr(package, 4) as bigint)"))
    npm = own.select(F.lit("npm").alias("eco"), F.col("package").alias("name"), F.when(F.col("k") % 3 == 0, "2.0.0").otherwise("1.2.0").alias("version"))
    return npm.unionByName(own.filter("k % 4 = 0").select(F.lit("pypi").alias("eco"), F.col("package").alias("name"), F.lit("9.9.9").alias("version"))).withColumns({"norm_name": F.col("name"), "direct": F.lit(True)})


def questions(spark, sf_dir) -> DataFrame:
    text = "CASE WHEN entry_id % 4 = 0 THEN concat(name, ' sized ', entry_id) WHEN entry_id % 4 = 1 THEN concat('What changed in ', name, ' of ', package, '?') ELSE concat('which ', split(doc, ' ')[0], ' ', package, ' kind') END AS text"
    return frame(spark, sf_dir, "old_entries").filter("entry_id % 20 < 4 and entry_id % 100 < 20").selectExpr("entry_id AS question_id", text)


def engine(spark, sf_dir) -> Engine:
    return Engine(spark, pinned(spark, sf_dir), None, entries(spark, sf_dir), body=BODY, head=HEAD)


def weighed(fields: dict[str, int], name: str) -> str:
    parts = [O.terms(f"{name}_{c}", f"(SELECT entry_id, {c} AS text FROM e)", "entry_id", "text").strip() for c in fields]
    each = " UNION ALL ".join(f"SELECT entry_id, term, {w} AS w FROM {name}_{c}" for c, w in fields.items())
    return ",\n".join(parts) + f", {name}_all AS ({each}), {name} AS (SELECT entry_id, term, least(sum(w), 65535) AS tf FROM {name}_all GROUP BY ALL), {name}_len AS (SELECT entry_id, greatest(coalesce(sum(w), 0), 1) AS len FROM (SELECT entry_id FROM e) LEFT JOIN {name}_all USING (entry_id) GROUP BY entry_id)"


def scored(tf: str, name: str) -> str:
    """CTEs ending in ``name(question_id, entry_id, s)``: BM25 with the statistics of what each question searches."""
    return f"""{name}_n AS (SELECT question_id, count(*) AS n, avg(len) AS avg_ FROM se JOIN {tf}_len USING (entry_id) GROUP BY 1), {name}_df AS (SELECT question_id, term, count(*) AS df FROM q JOIN {tf} USING (term) JOIN se USING (question_id, entry_id) GROUP BY ALL),
{name}_raw AS (SELECT question_id, entry_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_))) * weight) * (0.4 + count(*) FILTER (WHERE weight >= 1) / n_full), 9) AS score
 FROM q JOIN {tf} USING (term) JOIN se USING (question_id, entry_id) JOIN {name}_df USING (question_id, term) JOIN {tf}_len USING (entry_id) JOIN {name}_n USING (question_id) GROUP BY question_id, entry_id, n_full),
{name} AS (SELECT question_id, entry_id, score / greatest(max(score) OVER (PARTITION BY question_id), 1e-6) AS s FROM {O.best(f'{name}_raw', 1500)})"""


RANKED = f"""WITH e AS MATERIALIZED (SELECT * FROM {E} z), qs AS MATERIALIZED (SELECT * FROM {Q} z), pins AS MATERIALIZED (SELECT * FROM {PINNED} z),
scope AS (SELECT question_id, eco, name AS package, version FROM qs JOIN pins ON eco = 'npm' AND list_contains(regexp_split_to_array(lower(text), '[\\s,?()`''"]+'), name) UNION ALL SELECT question_id, eco, name, version FROM qs, pins WHERE question_id % 4 = 0),
se AS MATERIALIZED (SELECT question_id, entry_id FROM scope JOIN e USING (eco, package, version)),
{weighed(BODY, 'bt')}, {weighed(HEAD, 'ht')}, {O.question_terms('q', 'qs', 'question_id', True).strip()}, {O.question_terms('qp', 'qs', 'question_id', False).strip()},
{scored('bt', 'b')}, {scored('ht', 'h')}, lex AS (SELECT question_id, entry_id, 0.75 * coalesce(b.s, 0) + 0.25 * coalesce(h.s, 0) AS lex FROM b FULL JOIN h USING (question_id, entry_id)),
rare AS (SELECT question_id, term FROM qp JOIN b_n USING (question_id) LEFT JOIN b_df USING (question_id, term) WHERE coalesce(df, 0) < 0.03 * n),
{O.terms("nm", "(SELECT entry_id, CASE WHEN kind <> 'doc' THEN name ELSE lower(name) END AS text FROM e)", "entry_id", "text").strip()},
nt AS (SELECT DISTINCT entry_id, term FROM nm), hits AS (SELECT question_id, entry_id, CASE WHEN count(*) = 1 THEN 1.5 ELSE 1.9 END AS hit FROM nt JOIN rare USING (term) JOIN se USING (question_id, entry_id) GROUP BY ALL),
idents AS (SELECT question_id, list(DISTINCT i) AS ids FROM (SELECT question_id, unnest(list_transform(list_filter(regexp_split_to_array(text, '[\\s,?]+'), lambda w: regexp_matches(w, '[_.($]|^.+[A-Z]')), lambda w: lower(w))) AS i FROM qs
  UNION ALL SELECT w.question_id, n.name FROM (SELECT question_id, unnest({IDENT}) AS word FROM qs) w JOIN (SELECT DISTINCT question_id, lower(name) AS name FROM e JOIN se USING (entry_id) WHERE kind IN ('function', 'class') AND doc <> '' AND NOT legacy) n ON n.name = w.word AND n.question_id = w.question_id) GROUP BY 1),
w AS (SELECT l.question_id, l.entry_id, round(lex * CASE WHEN e.kind = 'doc' THEN CASE WHEN e.file = 'CHANGELOG.md' THEN CASE WHEN contains(lower(qs.text), 'change') THEN 1.5 ELSE 0.5 END ELSE 1.15 END
  ELSE CASE WHEN list_contains(coalesce(ids, []), lower(e.name)) THEN 1.8 ELSE 1 END * CASE WHEN len(list_filter(coalesce(ids, []), lambda i: strlen(i) > strlen(e.name) AND (ends_with(lower(e.path), i) OR ends_with(i, '.' || lower(e.name))))) > 0 THEN 1.4 ELSE 1 END
    * CASE WHEN e.doc = '' THEN 0.6 ELSE 1 END * CASE WHEN e.kind = 're-export' THEN 0.6 ELSE 1 END END
  * CASE WHEN e.legacy THEN 0.35 ELSE 1 END * coalesce(hit, 1.0), 9) AS score FROM lex l JOIN e USING (entry_id) JOIN qs USING (question_id) LEFT JOIN idents USING (question_id) LEFT JOIN hits USING (question_id, entry_id))"""


@query(f"{RANKED} SELECT question_id, eco, package, version, entry_id, round(score, 6) AS score, rank FROM {O.best('w', 20)} JOIN e USING (entry_id)")
def scoped_rank(spark, sf_dir):
    """Questions of many scopes in one plan, each ranked with the statistics of the exact packages that it searches."""
    own, asked = engine(spark, sf_dir), questions(spark, sf_dir)
    ranked, _ = own.ranked(asked, own.select(asked), wanted=retrieval.Wanted(20))
    best = retrieval.top(ranked, ["question_id"], 20)
    return best.select("question_id", "package.eco", F.col("package.name").alias("package"), "package.version", "entry_id", F.round("score", 6).alias("score"), "rank")


DOCS_SQL = f"""{RANKED}, once AS (SELECT question_id, entry_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, entry_id) - 1 AS rank FROM (SELECT w.*, row_number() OVER (PARTITION BY question_id, eco, package, version, file, line ORDER BY score DESC, entry_id) AS n FROM w JOIN e USING (entry_id)) WHERE n = 1),
weak AS (SELECT *, max(CAST(rank >= 3 AND score < 0.3 * top AS INT)) OVER (PARTITION BY question_id ORDER BY rank) AS stop FROM (SELECT *, first_value(score) OVER (PARTITION BY question_id ORDER BY rank) AS top FROM once)),
real AS (SELECT a.entry_id, arg_max(r.entry_id, {{'s': r.file = a.file, 'd': r.doc <> '', 'i': r.entry_id}}) AS meant FROM e a JOIN e r USING (eco, package, version) WHERE r.name = a.alias_of AND r.kind NOT IN ('doc', 're-export') GROUP BY 1),
shown AS (SELECT question_id, rank, score, e.*, CASE WHEN kind = 'doc' THEN length('### ' || name || ' — ' || package || '@' || version || ' ' || file || ':' || line || doc) + 2 ELSE length('### ' || path || ' (' || kind || ')' || ' — ' || package || '@' || version || ' ' || file || ':' || line || sig || doc) + 10 + CASE WHEN doc = '' THEN 0 ELSE 1 END END AS chars
  FROM weak LEFT JOIN real USING (entry_id) JOIN e ON e.entry_id = coalesce(meant, weak.entry_id) WHERE stop = 0 AND rank < 300),
sized AS (SELECT *, greatest(600 - CAST(ceil(coalesce(sum(chars + 1) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 3) AS BIGINT), 0) AS left_ FROM shown),
cut_ AS (SELECT *, ceil(chars / 3) + 1 > left_ AS trimmed FROM sized), kept AS (SELECT *, coalesce(max(CAST(trimmed AS INT)) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missed FROM cut_)
SELECT question_id, rank, eco, package, version, path, file, line, round(score, 6) AS score, trimmed FROM kept WHERE missed = 0 AND (NOT trimmed OR left_ > 120)"""


@query(DOCS_SQL)
def engine_docs(spark, sf_dir):
    """What ``Engine.docs`` answers within 600 tokens: from the pinned version and ecosystem only, re-exports as what they stand for."""
    found = engine(spark, sf_dir).docs(questions(spark, sf_dir), tokens=600)
    return found.select("question_id", "rank", "eco", "package", "version", "path", "file", "line", F.round("score", 6).alias("score"), "trimmed")


@query(f"""WITH e AS (SELECT * FROM {E} z), pins AS (SELECT * FROM {PINNED} z), s AS (SELECT question_id, FALSE AS broad, eco, name, version FROM {Q} q JOIN pins ON eco = 'npm' AND list_contains(regexp_split_to_array(lower(text), '[\\s,?()`''"]+'), name) UNION ALL SELECT question_id, TRUE, eco, name, version FROM {Q} q2, pins WHERE question_id % 4 = 0),
k AS (SELECT s.*, EXISTS (SELECT 1 FROM e WHERE e.eco = s.eco AND e.package = s.name AND e.version = s.version AND NOT (e.eco = 'npm' AND e.package = 'pkg7')) AS there FROM s)
SELECT question_id, bool_or(broad) AS broad, count(*) FILTER (WHERE there) AS searched, coalesce(string_agg(eco || ':' || name || '@' || version, ',' ORDER BY eco, name) FILTER (WHERE NOT there), '') AS missing FROM k GROUP BY 1""")
def answer_provenance(spark, sf_dir):
    """Which packages answer each question and which aren't indexed; one package is left out of the index here."""
    own = engine(spark, sf_dir)
    own.entries = own.entries.filter("not (eco = 'npm' and package = 'pkg7')")
    return own.provenance(questions(spark, sf_dir)).select("question_id", "broad", F.size("searched").cast("long").alias("searched"), F.array_join("missing", ",").alias("missing"))


@query(f"""WITH e AS (SELECT * FROM {E} z WHERE NOT (eco = 'npm' AND version = '2.0.0') UNION ALL SELECT * FROM {E} z2 WHERE eco = 'npm' AND version = '2.0.0' AND package = 'pkg3')
SELECT eco, package, version, count(*) AS n_entries, sum(entry_id)::BIGINT AS ids FROM e GROUP BY ALL""")
def index_snapshot(spark, sf_dir):
    """What the index holds after one write of all but the newest versions and another of one of these: packages of the same name don't replace one another."""
    whole = entries(spark, sf_dir)
    index = Index(spark, f"{shared_folder(spark)}/index-snapshot-{uuid.uuid4().hex}")
    index.write(whole.filter("not (eco = 'npm' and version = '2.0.0')"), BODY, HEAD)
    index.write(whole.filter("eco = 'npm' and version = '2.0.0' and package = 'pkg3'"), BODY, HEAD)
    return index.at().entries().groupBy("eco", "package", "version").agg(F.count("*").alias("n_entries"), F.sum("entry_id").alias("ids"))


@query(f"{RANKED} SELECT question_id, eco, package, version, entry_id, round(score, 6) AS score, rank FROM {O.best('w', 5)} JOIN e USING (entry_id)")
def indexed_scoped_rank(spark, sf_dir):
    """``scoped_rank`` from the posting lists that ``write_index`` wrote: only buckets of asked terms and folders of live writes are read."""
    own = engine(spark, sf_dir)
    path = f"{shared_folder(spark)}/index-rank-{uuid.uuid4().hex}"
    Engine.write_index(own.entries, path, BODY, HEAD)
    again, asked = Engine.open(spark, path, own.deps, None, body=BODY, head=HEAD), questions(spark, sf_dir)
    ranked, _ = again.ranked(asked, again.select(asked), wanted=retrieval.Wanted(5))
    best = retrieval.top(ranked, ["question_id"], 5)
    return best.select("question_id", "package.eco", F.col("package.name").alias("package"), "package.version", "entry_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH RECURSIVE {RESOLVE}, seen AS (SELECT symbol, import, count(DISTINCT entry_id) AS n, count(DISTINCT file || '|' || path) > 1 AND count(DISTINCT sig) > 1 AS amb, min(entry_id) AS entry_id FROM met WHERE entry_id IS NOT NULL GROUP BY ALL),
offers AS (SELECT q.package, q.symbol, count(*) AS n FROM q JOIN (SELECT DISTINCT m.symbol, m.import, d.sig, d.file, d.line FROM met m JOIN {DECLARED} d USING (entry_id) WHERE (m.symbol, m.import) NOT IN (SELECT (symbol, import) FROM stuck)) o ON o.symbol = q.symbol AND o.import <> q.package GROUP BY ALL)
SELECT q.package || '.' || q.symbol AS symbol, CASE WHEN amb THEN 'ambiguous' WHEN (q.symbol, q.package) IN (SELECT (symbol, import) FROM stuck) THEN 'unresolved' WHEN seen.n IS NULL THEN 'not_exported' ELSE 'exact' END AS status,
 CASE WHEN NOT coalesce(amb, FALSE) AND (q.symbol, q.package) NOT IN (SELECT (symbol, import) FROM stuck) THEN seen.entry_id END AS entry_id, least(coalesce(offers.n, 0), 8) AS alternatives
FROM q LEFT JOIN seen ON seen.symbol = q.symbol AND seen.import = q.package LEFT JOIN offers ON offers.symbol = q.symbol AND offers.package = q.package""")
def engine_api_exports(spark, sf_dir):
    """``Engine.api`` of names that begin with their package: what its root exports, with all four statuses, and other imports that offer them."""
    roots, own = frame(spark, sf_dir, "roots"), graph(spark, sf_dir)
    declared = frame(spark, sf_dir, "declared").withColumns({"eco": F.lit("npm"), "version": F.lit("1.0.0"), "doc": F.lit("x"), "alias_of": F.lit(None).cast("string"), "legacy": F.lit(False), "major": F.lit(1).cast("long")})
    deps = roots.select(F.lit("npm").alias("eco"), F.col("package").alias("name"), F.col("package").alias("norm_name"), F.lit("1.0.0").alias("version"), F.lit(True).alias("direct")).distinct()
    wanted = own["exports"].filter("cast(substr(file, 2) as bigint) % 3 = 0").select(F.concat("package", F.lit(".v"), F.substring("file", 2, 20)).alias("symbol")).distinct()
    found = Engine(spark, deps, None, declared, roots=roots, graph=own).api(wanted)
    return found.select("symbol", "status", "entry_id", F.size("alternatives").cast("long").alias("alternatives"))


@query(f"""WITH e AS (SELECT * FROM {OLD} o), a AS (SELECT symbol, list_filter(string_split(replace(regexp_replace(symbol, '(\\(\\))+$', ''), '::', '.'), '.'), lambda x: x <> '') AS p FROM {sql('asked_symbols')}),
w AS (SELECT symbol, p[-1] AS last, list_transform(p[:-2], lambda x: lower(x)) AS quals FROM a), h AS (SELECT *, list_transform(string_split(path, '.'), lambda x: lower(x)) AS segs FROM e WHERE kind <> 'doc'),
s AS (SELECT symbol, h.*, round(CASE WHEN name = last THEN 10.0 ELSE 7.0 END + CASE WHEN len(quals) > 0 THEN 0 WHEN kind IN ('method', 'field') THEN -1.5 ELSE 1.5 END
  + coalesce(list_sum(list_transform(quals, lambda q: CASE WHEN list_contains(segs, q) THEN 3.0 WHEN contains(lower(file), q) THEN 1.0 ELSE 0.0 END)), 0) + CASE WHEN len(quals) > 0 AND len(segs) > 1 AND quals[-1] = segs[-2] THEN 2 ELSE 0 END
  + CASE WHEN doc <> '' THEN 2 ELSE 0 END - CASE WHEN legacy THEN 5 ELSE 0 END - 0.2 * len(segs), 6) AS score FROM h JOIN w ON lower(h.name) = lower(last)),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, package, entry_id) AS n, count(*) OVER (PARTITION BY symbol) AS matches FROM s),
m AS (SELECT package, regexp_extract(path, '^(.*?):*[.:][^.:]*$', 1) AS up, least(count(*), 80) AS n FROM e WHERE kind <> 'doc' GROUP BY ALL HAVING up <> '')
SELECT a.symbol, CASE WHEN b.entry_id IS NULL THEN 'unresolved' ELSE 'exact' END AS status, b.package, b.entry_id, b.line, CASE WHEN b.kind IN ('class', 'interface', 'struct', 'trait', 'enum', 'module') THEN coalesce(m.n, 0) ELSE 0 END AS members, least(coalesce(matches, 1) - 1, 8) AS others
FROM a LEFT JOIN b ON b.symbol = a.symbol AND b.n = 1 LEFT JOIN m ON m.package = b.package AND m.up = b.path""")
def engine_api_symbols(spark, sf_dir):
    """``Engine.api`` of packages without entrypoints: the best declaration of each symbol, how many members it has and what else matches."""
    own = frame(spark, sf_dir, "old_entries").withColumn("eco", F.lit("pypi"))
    deps = own.select("eco", F.col("package").alias("name"), F.col("package").alias("norm_name"), "version", F.lit(True).alias("direct")).distinct()
    found = Engine(spark, deps, None, own).api(frame(spark, sf_dir, "asked_symbols"))
    return found.select("symbol", "status", "package", "entry_id", "line", F.size("members").cast("long").alias("members"), F.size("others").cast("long").alias("others"))
