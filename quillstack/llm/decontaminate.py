"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread

#: Bytes of benchmark text whose automaton a Python worker may hold; a larger benchmark is scanned in blocks of this size.
AUTOMATON_BYTES = 4 << 20
#: In UTF-8, words are runs of digits, ASCII letters and bytes from 0x80 on; all else separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def automaton(items: list[tuple[str, str | None]], window: int) -> ahocorasick.Automaton:
    """Maps each window (``window`` consecutive words, or a shorter item whole) to its length and items."""
    owners: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            owners.setdefault(b" ".join([b"", *part, b""]).decode("latin-1"), (len(part), set()))[1].add(item)
    found = ahocorasick.Automaton()
    for key, (n, ids) in owners.items():
        found.add_word(key, (len(key), n, tuple(ids)))
    found.make_automaton()
    return found


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged hit runs as [first, last) word numbers, and the items that occur."""
    w = words(text)
    if not w or not len(machine):
        return len(w), [], set()
    flat = b" ".join([b"", *w, b""]).decode("latin-1")
    items: set[str] = set()
    runs: list[tuple[int, int]] = []
    at = done = 0
    # Ends of matches come in ascending order, so words are counted forward, once.
    for end, (length, n, ids) in machine.iter(flat):
        items.update(ids)
        done += flat.count(" ", at, end)
        at = end
        start = done - n
        while runs and runs[-1][1] >= start:
            start = min(start, runs.pop()[0])
        runs.append((start, done))
    return len(w), runs, items


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of runs of words."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, carry: list[str] | None = None, with_spans: bool = False, clean_only: bool = False) -> DataFrame:
    """One row per document: its columns in ``carry``, ``n_words``, ``hit_runs`` (word numbers) and ``hit_items``.

    The benchmark's size is checked first. Up to ``AUTOMATON_BYTES`` of text it is one automaton, in the task closure;
    beyond that it is dealt into blocks of that size by item, documents are scanned once for each block, and the
    blocks' runs and items are merged, with the same result. ``with_spans`` adds ``hit_spans`` (character offsets);
    ``clean_only`` leaves the columns in ``carry`` of documents without a hit.
    """
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).filter("item is not null and text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // AUTOMATON_BYTES) if size else 1
    carry = [id_col] if carry is None else carry
    kept = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], *([] if text_col in carry else [F.col(text_col).alias("__text")]))
    text_name = f"__c{carry.index(text_col)}" if text_col in carry else "__text"
    runs = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    schema = T.StructType([*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_runs", runs), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", runs)])
    pairs = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    inputs, outputs = kept.columns, schema.names
    out = spread(kept)
    for block in range(blocks):
        part = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        items = [(r["item"], r["text"]) for r in part.collect()]
        first, last = block == 0, block == blocks - 1

        def run(batches: Iterator[pa.RecordBatch], items=items, first=first, last=last) -> Iterator[pa.RecordBatch]:
            machine = automaton(items, window)
            for batch in batches:
                texts = batch.column(text_name)
                before = [None] * len(texts) if first else zip(batch.column("hit_runs").to_pylist(), batch.column("hit_items").to_pylist(), strict=True)
                counts, all_runs, all_items, all_spans = [], [], [], []
                for text, old in zip((x.as_py() for x in texts), before, strict=True):
                    n, found, ids = scan(text, machine)
                    if old:
                        found, ids = merge([(r["first"], r["last"]) for r in old[0]] + found), ids | set(old[1])
                    counts.append(n)
                    all_runs.append([{"first": a, "last": b} for a, b in found])
                    all_items.append(sorted(ids))
                    all_spans.append([{"first": a, "last": b} for a, b in spans(text, found)] if last and with_spans and found else [])
                columns = [batch.column(c) for c in inputs] + [pa.array(counts, pa.int64()), pa.array(all_runs, pairs), pa.array(all_items, pa.list_(pa.string())), pa.array(all_spans, pairs)]
                yield pa.RecordBatch.from_arrays(columns, names=outputs)

        out = out.mapInArrow(run, schema)
    if clean_only:
        return out.filter(F.size("hit_runs") == 0).select(*[f"__c{i}" for i in range(len(carry))]).withColumnsRenamed({f"__c{i}": c for i, c in enumerate(carry)})
    drop = ["__text"] + ([] if with_spans else ["hit_spans"])
    return out.drop(*drop).withColumnsRenamed({f"__c{i}": c for i, c in enumerate(carry)})


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Defined cases: a null or word-free text has no words; a null item id or item text has no window; repeated
    documents are reported once each; an empty benchmark hits nothing; an empty table gives an empty result.
    """
    found = hits(docs, benchmark, window=window)
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda acc, r: acc + r["last"] - r["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without documents in which a benchmark window occurs; all columns stay, texts are read once."""
    return hits(docs, benchmark, carry=docs.columns, window=window, clean_only=True)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
starts AS (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT n FROM wins),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
grams AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM pos, sizes WHERE i + n - 1 <= len(ws)),
m AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
