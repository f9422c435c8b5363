"""DuckDB counterparts of text expressions, for comparing results."""

from __future__ import annotations

from ..functions import text as X


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def tokens(c: str) -> str:
    spaced = "w"
    for pattern in (r"([\p{Ll}\p{N}])(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        spaced = f"regexp_replace({spaced}, '{pattern}', '\\1 \\2', 'g')"
    parts = f"list_filter(string_split(lower(regexp_replace({spaced}, '_+', ' ', 'g')), ' '), lambda p: p <> '')"
    return f"flatten(list_transform(regexp_extract_all(coalesce({c}, ''), '[\\p{{L}}\\p{{N}}_]+'), lambda w: CASE WHEN len({parts}) > 1 THEN list_prepend(lower(w), {parts}) ELSE {parts} END))"


def terms(name: str, source: str, key: str, text: str) -> str:
    """CTEs ending in ``name(key, term)``: a row for each stemmed token of ``text``, and ``name_w(key, t, term)``."""
    ends = lambda c, *ss: "(" + " OR ".join(f"ends_with({c}, '{s}')" for s in ss) + ")"
    return f"""
{name}_raw AS (SELECT {key}, unnest({tokens(text)}) AS t FROM {source}),
{name}_s0 AS (SELECT t, strlen(t) = length(t) AS asc_, CASE WHEN length(t) <= 3 OR strlen(t) <> length(t) THEN t
  WHEN length(t) > 5 AND ends_with(t, 'ies') THEN concat(t[:-4], 'y') WHEN length(t) > 4 AND {ends("t", "sses", "shes", "ches", "xes")} THEN t[:-3]
  WHEN ends_with(t, 's') AND NOT {ends("t", "ss", "us", "is")} THEN t[:-2] WHEN length(t) > 6 AND ends_with(t, 'ing') THEN t[:-4]
  WHEN length(t) > 5 AND ends_with(t, 'ed') AND NOT ends_with(t, 'eed') THEN t[:-3] ELSE t END AS s FROM (SELECT DISTINCT t FROM {name}_raw)),
{name}_s1 AS (SELECT t, asc_, CASE WHEN asc_ AND length(s) > 8 AND {ends("s", "ability", "ibility")} THEN concat(s[:-6], 'l') WHEN asc_ AND length(s) > 7 AND ends_with(s, 'ation') THEN s[:-4] ELSE s END AS s FROM {name}_s0),
{name}_st AS (SELECT t, CASE WHEN asc_ AND length(s) > 4 AND ends_with(s, 'e') THEN s[:-2] ELSE s END AS term FROM {name}_s1),
{name}_w AS (SELECT {key}, t, term FROM {name}_raw JOIN {name}_st USING (t)),
{name} AS (SELECT {key}, term FROM {name}_w)"""


def question_terms(name: str, source: str, key: str, synonyms: bool) -> str:
    """CTEs ending in ``name(key, term, weight, n_full)``."""
    base = terms(f"{name}_t", source, key, "text")
    full = f"{name}_f AS (SELECT DISTINCT {key}, term, 1.0 AS weight FROM {name}_t_w WHERE t NOT IN ({quoted(X.STOP)}))"
    if synonyms:
        pairs = ", ".join(f"('{k}', '{s}')" for k, v in X.SYNONYMS.items() for s in v)
        strict = " INTERSECT ".join(f"SELECT {key} FROM {name}_f0 WHERE term IN ({quoted(g)})" for g in X.STRICT)
        full = full.replace(f"{name}_f AS", f"{name}_f0 AS") + f""",
{name}_strict AS (SELECT {key}, 'strict' AS term, 1.0 AS weight FROM ({strict})),
{name}_f1 AS (SELECT * FROM {name}_f0 UNION SELECT * FROM {name}_strict),
{name}_syn AS (SELECT DISTINCT {key}, s AS term, {X.SYNONYM_WEIGHT} AS weight FROM {name}_f0 JOIN (VALUES {pairs}) v(k, s) ON term = k),
{name}_f AS (SELECT * FROM {name}_f1 UNION ALL SELECT * FROM {name}_syn ANTI JOIN {name}_f1 USING ({key}, term))"""
    return f"""{base},
{full},
{name} AS (SELECT *, greatest(count(*) FILTER (WHERE weight >= 1) OVER (PARTITION BY {key}), 1) AS n_full FROM {name}_f)"""


def bm25(name: str, entries: str, questions: str, synonyms: bool) -> str:
    """CTEs ending in ``name(question_id, entry_id, score, matched)``; ``entries`` has ``entry_id, text``, ``questions`` ``question_id, text``."""
    return f"""{terms(f"{name}_e", entries, "entry_id", "text")},{question_terms(f"{name}_q", questions, "question_id", synonyms)},
{name}_tf AS (SELECT entry_id, term, least(count(*), 65535) AS tf FROM {name}_e GROUP BY ALL),
{name}_len AS (SELECT entry_id, greatest(count(term), 1) AS len FROM (SELECT entry_id FROM {entries}) LEFT JOIN {name}_e USING (entry_id) GROUP BY entry_id),
{name}_n AS (SELECT count(*) AS n, avg(len) AS avg_ FROM {name}_len),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name} AS (SELECT question_id, entry_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_))) * weight) * (0.4 + count(*) FILTER (WHERE weight >= 1) / n_full), 9) AS score,
   count(*) FILTER (WHERE weight >= 1) AS matched
   FROM {name}_q JOIN {name}_tf USING (term) JOIN {name}_df USING (term) JOIN {name}_len USING (entry_id), {name}_n GROUP BY question_id, entry_id, n_full)"""


def best(source: str, k: int, score: str = "score") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {score} DESC, entry_id) - 1 AS rank FROM {source} QUALIFY rank < {k})"
