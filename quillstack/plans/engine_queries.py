"""Registered queries of the resolve, answer, symbol and upgrade operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators import retrieval, symbols, upgrade
from ..streaming import incremental
from . import oracle as O
from .generated import frame, sql
from .queries import ASKED, DOCS, asked, docs, query, table

WORDS = "list_distinct(list_filter(list_transform(regexp_split_to_array({c}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)), lambda w: strlen(w) > 2))"
PARENT = "regexp_extract({c}, '^(.*?):*[.:][^.:]*$', 1)"
SQUASH = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
API = "kind <> 'doc' AND NOT legacy"


@query("SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, h AS text_hash FROM (SELECT *, md5(text) AS h FROM documents) GROUP BY source, h")
def dedupe_first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.md5("text").alias("text_hash"), "doc_id", "lang")
    return R.first_wins(rows, ["source", "text_hash"], ["doc_id"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def priority_join_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate", "l_suppkey", "l_extendedprice")
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    return R.first_wins(rows, ["l_orderkey"], [rank, "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 20")
def cap_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return R.cap(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 20).select("l_suppkey", "l_orderkey", "l_linenumber", F.col("n").cast("long").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def anti_join_stale(spark, sf_dir):
    fresh = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select("l_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(fresh, F.col("p_partkey") == F.col("l_partkey"), "left_anti")


TOP = f"WITH {O.bm25('h', DOCS, ASKED, True).strip()}, t AS (SELECT * FROM {O.best('h', 20)})"


def best_hits(spark, sf_dir):
    return retrieval.top(retrieval.bm25(docs(spark, sf_dir), asked(spark, sf_dir), {"text": 1}, synonyms=True), ["question_id"], 20)


@query(f"{TOP} SELECT question_id, entry_id, rank, used FROM (SELECT t.*, CAST(sum(ceil(length(text) / 3) + 1) OVER (PARTITION BY question_id ORDER BY rank) AS BIGINT) AS used FROM t JOIN {DOCS} d USING (entry_id)) WHERE used <= 1200")
def pack_running_budget(spark, sf_dir):
    hits = best_hits(spark, sf_dir).join(docs(spark, sf_dir), "entry_id")
    return R.pack_budget(hits, "question_id", [F.col("rank")], "text", 1200).select("question_id", "entry_id", "rank", F.col("used").cast("long").alias("used"))


@query(f"{TOP}, f AS (SELECT *, rank >= 3 AND score < 0.3 * first_value(score) OVER (PARTITION BY question_id ORDER BY rank) AS weak FROM t) SELECT question_id, entry_id, rank FROM (SELECT *, max(CAST(weak AS INT)) OVER (PARTITION BY question_id ORDER BY rank) AS stop FROM f) WHERE stop = 0")
def relevance_floor(spark, sf_dir):
    return R.relevance_floor(best_hits(spark, sf_dir), "question_id", [F.col("rank")]).select("question_id", "entry_id", "rank")


@query(f"""{TOP}, a AS (SELECT doc_id AS entry_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1)
SELECT question_id, entry_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, entry_id) - 1 AS rank FROM (
  SELECT question_id, entry_id, round(score * CASE WHEN a.q = 1 THEN 1.15 WHEN a.q = 0 THEN 0.6 ELSE 1 END * CASE WHEN a.t = 1 THEN 0.35 ELSE 1 END, 9) AS s FROM t LEFT JOIN a USING (entry_id)))""")
def boosted_rank(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("entry_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    # Labels stand for what weighs a section: good ones for a README's, bad ones for a deprecated page's, toxic ones for an older major's.
    page = F.when(F.col("q") == 0, "Notes (deprecated)").otherwise("Notes")
    shown = best_hits(spark, sf_dir).drop("rank").join(marks, "entry_id", "left").withColumns({"kind": F.lit("doc"), "name": page, "path": page, "file": F.when(F.col("q") == 1, "README.md").otherwise("notes.md"), "doc": F.lit("x"), "legacy": F.coalesce(F.col("t") == 1, F.lit(False)), "major": F.lit(2)})
    weight = retrieval.boost(F.array().cast("array<string>"), F.lit(False))
    scored = shown.withColumns(retrieval.boost_marks()).withColumn("score", F.round(F.col("score") * weight, 9)).select("question_id", "entry_id", "score")
    return retrieval.top(scored, ["question_id"], 20).select("question_id", "entry_id", F.round("score", 6).alias("score"), "rank")


@query(r"""WITH h AS (SELECT page_id, unnest(hs) AS raw, generate_subscripts(hs, 1) - 1 AS n FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS hs FROM pages))
SELECT page_id, n, CAST(regexp_extract(raw, '(?i)^<h([1-6])', 1) AS INT) AS level, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS heading FROM h""")
def html_heading_sections(spark, sf_dir):
    return R.html_headings(table(spark, sf_dir, "pages")).withColumn("n", F.col("n").cast("long"))


@query("SELECT event_type, picked_median, picked_p95 FROM (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1), LATERAL (SELECT v[CAST(floor(n * 0.5) AS BIGINT) + 1] AS picked_median, v[CAST(floor(n * 0.95) AS BIGINT) + 1] AS picked_p95)")
def latency_percentile_pick(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    return R.index_pick(rows, ["event_type"], "value", {"picked_median": 0.5, "picked_p95": 0.95})


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def incremental_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return incremental.latest(rows, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT doc_id, CAST(ceil(length(text) / 3) AS BIGINT) AS est_tokens, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS n_words FROM documents")
def est_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.est_tokens(F.col("text")).cast("long").alias("est_tokens"), F.size(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), 1)).cast("long").alias("n_words"))


@query(f"SELECT item_id AS question_id, regexp_matches(lower(text), '{"|".join(X.CHANGE_WORDS).replace("'", "''")}') AS changes FROM benchmark")
def change_intent(spark, sf_dir):
    return asked(spark, sf_dir).select("question_id", X.change_intent(F.col("text")).alias("changes"))


@query(f"SELECT eco, name, CASE eco WHEN 'pypi' THEN regexp_replace(lower(name), '[-_.]+', '-', 'g') WHEN 'cargo' THEN replace(lower(name), '_', '-') WHEN 'npm' THEN lower(name) ELSE name END AS norm_name, lower(regexp_replace(name, '([A-Z])', '!\\1', 'g')) AS escaped FROM {sql('deps')}")
def norm_name(spark, sf_dir):
    return frame(spark, sf_dir, "deps").select("eco", "name", X.norm_name(F.col("eco"), F.col("name")).alias("norm_name"), X.go_escape(F.col("name")).alias("escaped"))


@query(f"""SELECT d.eco, d.name, plain AS norm_name, d.version, direct, CASE WHEN s.version IS NULL THEN 'missing' WHEN s.version = d.version THEN 'ready' ELSE 'drift' END AS status, s.version AS found FROM {sql('deps')} d
LEFT JOIN {sql('sources')} s USING (eco, plain) QUALIFY row_number() OVER (PARTITION BY d.eco, d.name ORDER BY s.version <> d.version, priority, s.version) = 1""")
def resolve_status(spark, sf_dir):
    deps = frame(spark, sf_dir, "deps").select("eco", "name", F.col("plain").alias("norm_name"), "version", "direct")
    return R.resolve_status(deps, frame(spark, sf_dir, "sources").withColumnRenamed("plain", "norm_name"))


@query(f"SELECT id, (contains(lower(answer), lower(w1)) OR contains(lower(answer), lower(w2))) AND contains(lower(answer), 'dict') AND NOT contains(lower(answer), lower(reject)) AS passed FROM {sql('answers')}")
def bench_grade(spark, sf_dir):
    rows = frame(spark, sf_dir, "answers").select("id", "answer", F.array(F.array("w1", "w2"), F.array(F.lit("Dict"))).alias("expect"), F.array("reject").alias("reject"))
    return R.grade(rows).select("id", "passed")


@query(f"""WITH c AS (SELECT name, version, unnest(['v' || version, version, name || '@' || version, b || '@' || version, b || '-v' || version, b || '-' || version]) AS ref, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS p FROM (SELECT *, regexp_extract(name, '([^/]*)$', 1) AS b FROM {sql('packages')}))
SELECT name, version, ref, oid FROM c JOIN {sql('refs')} r USING (ref) QUALIFY row_number() OVER (PARTITION BY name, version ORDER BY p, NOT peeled, oid) = 1""")
def tag_priority_join(spark, sf_dir):
    return R.tag_for(frame(spark, sf_dir, "packages"), frame(spark, sf_dir, "refs"))


@query(f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY path) AS n FROM {sql('archive_files')}),
r AS (SELECT package, path, bytes, n, CASE WHEN bytes <= 5000 THEN bytes ELSE 0 END AS total, bytes <= 5000 AS kept FROM f WHERE n = 1
 UNION ALL SELECT f.package, f.path, f.bytes, f.n, r.total + CASE WHEN r.total + f.bytes <= 5000 THEN f.bytes ELSE 0 END, r.total + f.bytes <= 5000 FROM r JOIN f ON f.package = r.package AND f.n = r.n + 1)
SELECT package, path, bytes FROM r WHERE kept""")
def running_include(spark, sf_dir):
    return R.running_include(frame(spark, sf_dir, "archive_files"), "package", "path", "bytes", 2500, 5000)


def _dep(p: str) -> str:
    return f"(contains(lower({p}.doc), '@deprecated') OR contains(lower({p}.doc), 'deprecated:') OR contains(lower({p}.doc), '.. deprecated::') OR contains(lower({p}.sig), '#[deprecated') OR contains(lower({p}.sig), '@deprecated'))"


SIDES = f"""o AS (SELECT * FROM {sql('old_entries')} WHERE {API} QUALIFY row_number() OVER (PARTITION BY package, path ORDER BY entry_id) = 1),
n AS (SELECT * FROM {sql('new_entries')} WHERE {API} QUALIFY row_number() OVER (PARTITION BY package, path ORDER BY entry_id DESC) = 1)"""


@query(f"""WITH {SIDES} SELECT o.package, o.entry_id, o.path, CASE WHEN n.path IS NULL THEN 'gone' WHEN {_dep('n')} AND NOT {_dep('o')} THEN 'deprecated'
 WHEN o.alias_of IS NULL AND n.alias_of IS NULL AND {SQUASH.format(c='o.sig')} <> {SQUASH.format(c='n.sig')} THEN 'signature_changed' ELSE 'same' END AS change, n.entry_id AS new_id FROM o LEFT JOIN n USING (package, path)""")
def diff_classify(spark, sf_dir):
    return upgrade.classify(frame(spark, sf_dir, "old_entries"), frame(spark, sf_dir, "new_entries"))


SHAPE = "trim(regexp_replace(CASE WHEN name <> '' AND strpos(sig, name) > 0 THEN concat(sig[:strpos(sig, name) - 1], '_', sig[strpos(sig, name) + length(name):]) ELSE sig END, '\\s+', ' ', 'g'))"
RENAMES = f"""WITH {SIDES}, g AS (SELECT *, {PARENT.format(c='path')} AS up, {SHAPE} AS shape, {WORDS.format(c='doc')} AS w FROM o ANTI JOIN n USING (package, path)),
a AS (SELECT *, {PARENT.format(c='path')} AS up, {SHAPE} AS shape, {WORDS.format(c='doc')} AS w FROM {sql('new_entries')} e ANTI JOIN o USING (package, path) WHERE {API} AND alias_of IS NULL),
c AS (SELECT g.package, g.entry_id AS old_id, a.entry_id AS new_id, round(CASE WHEN g.sig <> '' AND g.shape = a.shape THEN 1.0 WHEN len(g.w) = 0 OR len(a.w) = 0 THEN 0 ELSE len(list_intersect(g.w, a.w)) / len(list_distinct(list_concat(g.w, a.w))) END, 6) AS similarity
 FROM g JOIN a ON g.package = a.package AND g.kind = a.kind AND g.up = a.up)"""


@query(f"{RENAMES} SELECT * FROM c WHERE similarity >= 0.7")
def jaccard_rename_candidates(spark, sf_dir):
    return upgrade.rename_candidates(frame(spark, sf_dir, "old_entries"), frame(spark, sf_dir, "new_entries"))


@query(f"""{RENAMES}, s AS (SELECT c.*, g.package || ':' || g.kind || ':' || g.up AS grp FROM c JOIN g ON g.entry_id = c.old_id WHERE similarity >= 0.7),
l AS (SELECT grp, old_id, list({{'s': similarity, 'n': new_id}} ORDER BY similarity DESC, new_id DESC) AS options, row_number() OVER (PARTITION BY grp ORDER BY old_id) AS k FROM s GROUP BY grp, old_id),
r AS (SELECT grp, 0 AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS old_id, CAST(NULL AS BIGINT) AS pick FROM (SELECT DISTINCT grp FROM l)
 UNION ALL SELECT r.grp, l.k, CASE WHEN o.pick IS NULL THEN taken ELSE list_append(taken, o.pick) END, l.old_id, o.pick FROM r JOIN l ON l.grp = r.grp AND l.k = r.k + 1, LATERAL (SELECT list_filter(l.options, lambda x: NOT list_contains(r.taken, x.n))[1].n AS pick) o),
f AS (SELECT o.package, o.entry_id, o.path, CASE WHEN n.path IS NULL THEN 'gone' WHEN {_dep('n')} AND NOT {_dep('o')} THEN 'deprecated' WHEN o.alias_of IS NULL AND n.alias_of IS NULL AND {SQUASH.format(c='o.sig')} <> {SQUASH.format(c='n.sig')} THEN 'signature_changed' ELSE 'same' END AS change, n.entry_id AS new_id FROM o LEFT JOIN n USING (package, path))
SELECT f.package, f.entry_id, f.path, CASE WHEN change <> 'gone' THEN change WHEN pick IS NOT NULL THEN 'renamed' ELSE 'removed' END AS change, coalesce(f.new_id, pick) AS new_id FROM f LEFT JOIN r ON r.old_id = f.entry_id WHERE change <> 'same'""".replace("WITH o AS", "WITH RECURSIVE o AS"))
def upgrade_diff(spark, sf_dir):
    return upgrade.diff(frame(spark, sf_dir, "old_entries"), frame(spark, sf_dir, "new_entries"))


@query(f"""WITH l AS (SELECT file, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {sql('sources_text')} WHERE contains(text, '''pkg''')),
s AS (SELECT DISTINCT path, name, kind FROM {sql('old_entries')} WHERE {API})
SELECT path, file, CAST(line AS INT) AS line FROM l, s WHERE regexp_matches(content, concat(CASE WHEN kind IN ('method', 'field') THEN '(\\.|::)' ELSE '(^|[^A-Za-z0-9_$])' END, name, '($|[^A-Za-z0-9_$])')) QUALIFY row_number() OVER (PARTITION BY path ORDER BY file, line) <= 20""")
def call_sites(spark, sf_dir):
    names = upgrade.api(frame(spark, sf_dir, "old_entries")).select("path", "name", "kind").distinct()
    return upgrade.call_sites(frame(spark, sf_dir, "sources_text"), names, "'pkg'")


@query(f"""SELECT s.path, g.entry_id FROM {sql('new_entries')} g, (SELECT DISTINCT path, name FROM {sql('old_entries')} WHERE {API}) s
WHERE g.kind = 'doc' AND regexp_matches(upper(g.file), 'CHANGELOG|MIGRAT|UPGRAD|BREAKING|HISTORY|NEWS') AND list_contains(regexp_extract_all(g.doc, '[\\p{{L}}\\p{{N}}_$]+'), s.name) QUALIFY row_number() OVER (PARTITION BY s.path ORDER BY g.entry_id) <= 2""")
def upgrade_guides(spark, sf_dir):
    names = upgrade.api(frame(spark, sf_dir, "old_entries")).select("path", "name").distinct()
    return upgrade.guides(frame(spark, sf_dir, "new_entries"), names)


@query(f"""WITH m AS (SELECT * FROM {sql('guides')}), said AS (
 SELECT question_id, package, name AS own, score * 0.95 AS score, unnest(regexp_extract_all(text, '(?i:use|consider|renamed to|replaced by|in favor of|in favour of|instead use) ([`''"* ]*[\\p{{L}}\\p{{N}}_.:$]+)', 1)) AS raw FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, entry_id) <= 30)),
t AS (SELECT *, regexp_replace(regexp_replace(raw, '^[`''"* ]+', ''), '[.:]+$', '') AS bare FROM said),
u AS (SELECT DISTINCT question_id, package, own, score, regexp_extract(bare, '([^.:]*)$', 1) AS target FROM t WHERE (starts_with(raw, '`') OR regexp_matches(bare, '[_.$]|^.+[A-Z]')) AND strlen(bare) >= 3),
l AS (SELECT u.question_id, u.package, m.entry_id, u.score FROM u JOIN m ON m.package = u.package AND m.name = u.target WHERE target <> own AND strlen(target) >= 3 AND kind NOT IN ('doc', 're-export') AND NOT legacy)
SELECT question_id, package, entry_id, round(max(score), 6) AS score FROM (SELECT question_id, package, entry_id, score FROM m UNION ALL SELECT * FROM l) GROUP BY ALL""")
def redirect_lift(spark, sf_dir):
    rows = frame(spark, sf_dir, "guides")
    return retrieval.lift_redirects(rows, rows.drop("question_id", "score")).withColumn("score", F.round("score", 6))


@query(f"""WITH e AS (SELECT *, {PARENT.format(c='path')} AS up FROM {sql('old_entries')} WHERE kind <> 'doc')
SELECT o.package, o.entry_id AS container_id, i.entry_id, row_number() OVER (PARTITION BY o.package, o.entry_id ORDER BY i.entry_id) AS n FROM e o JOIN e i ON i.package = o.package AND i.up = o.path WHERE o.kind IN ('class', 'interface', 'struct', 'trait', 'enum', 'module')""")
def symbol_members(spark, sf_dir):
    return symbols.members(frame(spark, sf_dir, "old_entries")).withColumn("n", F.col("n").cast("long"))


@query(f"""WITH a AS (SELECT symbol, list_filter(string_split(replace(regexp_replace(symbol, '(\\(\\))+$', ''), '::', '.'), '.'), lambda x: x <> '') AS p FROM {sql('asked_symbols')}),
w AS (SELECT symbol, p[-1] AS last, list_transform(p[:-2], lambda x: lower(x)) AS quals FROM a),
h AS (SELECT *, list_transform(string_split(path, '.'), lambda x: lower(x)) AS segs FROM {sql('old_entries')} WHERE kind <> 'doc'),
s AS (SELECT symbol, package, entry_id, CASE WHEN name = last THEN 10.0 ELSE 7.0 END + CASE WHEN len(quals) > 0 THEN 0 WHEN kind IN ('method', 'field') THEN -1.5 ELSE 1.5 END
  + coalesce(list_sum(list_transform(quals, lambda q: CASE WHEN list_contains(segs, q) THEN 3.0 WHEN contains(lower(file), q) THEN 1.0 ELSE 0.0 END)), 0) + CASE WHEN len(quals) > 0 AND len(segs) > 1 AND quals[-1] = segs[-2] THEN 2 ELSE 0 END
  + CASE WHEN doc <> '' THEN 2 ELSE 0 END - CASE WHEN legacy THEN 5 ELSE 0 END - CASE WHEN kind = 're-export' THEN 0.5 ELSE 0 END - 0.2 * len(segs) AS score FROM h JOIN w ON lower(h.name) = lower(last))
SELECT symbol, package, entry_id, round(score, 6) AS score FROM s""")
def symbol_lookup(spark, sf_dir):
    return symbols.lookup(frame(spark, sf_dir, "old_entries"), frame(spark, sf_dir, "asked_symbols"))


@query(f"""SELECT a.package, a.entry_id, r.entry_id AS target_id FROM {sql('new_entries')} a JOIN {sql('new_entries')} r ON r.package = a.package AND r.name = a.alias_of AND r.kind NOT IN ('doc', 're-export')
WHERE a.alias_of IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.package, a.entry_id ORDER BY r.file = a.file DESC, r.doc <> '' DESC, r.entry_id DESC) = 1""")
def alias_target(spark, sf_dir):
    return symbols.resolve_aliases(frame(spark, sf_dir, "new_entries"))
