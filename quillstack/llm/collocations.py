"""Phrase collocations by hierarchical pair naming: a k-gram is the pair of the names of its two (k-1)-grams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window as W

from ..operators.lineage import remove
from .common import cut, shared_folder, spread

#: Longest phrase in words, least count of a candidate, share (per cent) of a longer one's count that makes it stand for a shorter one, phrases a language.
LONGEST, LEAST, COVERED, MOST, FACTOR = 4, 30, 80, 2000, 2_000_000
#: Words of a block, bytes of text that a task takes in at once, and items of a page.
BLOCK, BYTES, PAGE = 1 << 19, 8 << 20, 1 << 20
_SPACE, _BREAK = 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, one after another, A-Z lower-cased, and at which of them a piece begins (of a text or after a break)."""
    flat = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    kind = _KIND[flat]
    inside = kind == 0
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1
    breaks = np.flatnonzero(kind == _BREAK)
    piece = np.searchsorted(breaks, starts)
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat[inside].tobytes())])
    return found, np.concatenate([[True], piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, dtype=bool)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, by byte planes, compressed."""
    kind = np.dtype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)
    planes = x.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), dtype=np.uint8).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(np.dtype(f"u{raw[0]}")).ravel().astype(np.int64)


def page_of(left: np.ndarray, right: np.ndarray, pages: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ x >> np.uint64(32)) % np.uint64(pages)).astype(np.int64)


def pairs_of(codes: np.ndarray, ids: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a sequence of names (``ids[code]``, -1: none): the pair at each position as a number (-1: none), and the pairs, ordered by page, left and right."""
    both = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    found, local = np.unique(codes[both] * len(ids) + codes[both + 1], return_inverse=True)
    left, right = ids[found // max(len(ids), 1)], ids[found % max(len(ids), 1)]
    page = page_of(left, right, pages)
    order = np.argsort(page, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    sequence = np.full(max(len(codes) - 1, 0), -1, dtype=np.int64)
    sequence[both] = place[local]
    return sequence, page[order], left[order], right[order]


#: A block's own row (``codes`` plus one, the ``ids`` that they number, if they are names, and how many positions count here), and one for each page of
#: what it counts: the first number there, the items (words, or left and right names) and their counts.
BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("ids", pa.binary()), ("owned", pa.int32()), ("page", pa.int32()), ("start", pa.int32()), ("items", pa.binary()), ("others", pa.binary()), ("counts", pa.binary())])
#: What a page has found: a frequent item with its name and count, the names of a block's numbers, or the count of all words of a language.
FOUND = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("left", pa.int64()), ("right", pa.int64()), ("f", pa.int64()), ("total", pa.int64())])


def batch_of(schema: pa.Schema, n: int, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def paged(block: int, lang: str, page: np.ndarray, items: Callable[[slice], bytes], others: Callable[[slice], bytes | None], counts: np.ndarray) -> pa.RecordBatch:
    starts = np.flatnonzero(np.diff(page, prepend=-1))
    parts = [slice(s, e) for s, e in zip(starts, np.append(starts, len(page))[1:], strict=True)]
    n = len(parts)
    return batch_of(BLOCKS, n, block=[block] * n, lang=[lang] * n, page=page[starts], start=starts, items=[items(p) for p in parts], others=[others(p) for p in parts], counts=[packed(counts[p]) for p in parts])


def first_blocks(docs: DataFrame, lang_col: str, text_col: str, reach: int, pages: int, most: int = BLOCK) -> DataFrame:
    """``BLOCKS`` of up to ``most`` words of one language; a block goes on for ``reach`` positions into the next of its text."""
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def emit(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal block
            found, begins = words_of(held.pop(lang))
            del size[lang]
            # A break takes a position of its own, so that nothing is named across it.
            at = np.arange(len(begins)) + np.cumsum(begins)
            coded = found.dictionary_encode()
            codes = np.full(len(found) + int(begins.sum()), -1, dtype=np.int64)
            codes[at] = coded.indices.to_numpy()
            words = np.array(coded.dictionary.to_pylist(), dtype=object)
            page = np.array([crc32(w) % pages for w in words], dtype=np.int64)
            for start in range(0, len(codes), most):
                own = codes[start : start + most + reach]
                owned = min(most, len(codes) - start)
                used, local = np.unique(own[own >= 0], return_inverse=True)
                order = np.argsort(page[used], kind="stable")
                place = np.empty(len(order), dtype=np.int64)
                place[order] = np.arange(len(order))
                sequence = np.full(len(own), -1, dtype=np.int64)
                sequence[own >= 0] = place[local]
                mine = sequence[:owned]
                ordered, raw = words[used[order]], zstandard.ZstdCompressor(level=1)
                yield batch_of(BLOCKS, 1, block=[block], lang=[lang], codes=[packed(sequence + 1)], owned=[owned])
                yield paged(block, lang, page[used[order]], lambda p, w=ordered, raw=raw: raw.compress(b"\n".join(w[p])), lambda p: None, np.bincount(mine[mine >= 0], minlength=len(used)))
                block += 1

        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(raw)
                size[lang] = size.get(lang, 0) + len(raw) + 1
                if size[lang] >= BYTES:
                    yield from emit(lang)
                elif sum(size.values()) >= 4 * BYTES:
                    yield from emit(max(size, key=size.get))
        for lang in list(held):
            yield from emit(lang)

    return spread(source).mapInArrow(run, from_arrow_schema(BLOCKS))


def named_pages(blocks: DataFrame, least: int, pages: int, of_words: bool) -> DataFrame:
    """``FOUND`` of the blocks' pages: items counted over all blocks, those with ``least`` or more named, and these names by block."""

    def run(t: pa.Table) -> pa.Table:
        page, out = t["page"][0].as_py(), []
        counts = [unpacked(x.as_py()) for x in t["counts"]]
        n = np.concatenate(counts)
        if of_words:
            langs, lang = np.unique(np.repeat(t["lang"].to_pylist(), [len(c) for c in counts]), return_inverse=True)
            parts = [zstandard.ZstdDecompressor().decompress(x.as_py()).split(b"\n") for x in t["items"]]
            coded = pa.chunked_array([pa.array(w, pa.binary()) for w in parts]).combine_chunks().dictionary_encode()
            key, where = np.unique(coded.indices.to_numpy().astype(np.int64) * len(langs) + lang, return_inverse=True)
            named = {"lang": langs[key % len(langs)], "word": np.array([w.decode("utf-8", "replace") for w in coded.dictionary.to_pylist()], dtype=object)[key // len(langs)]}
            total = np.zeros(len(langs), dtype=np.int64)
            np.add.at(total, lang, n)
            out.append(batch_of(FOUND, len(langs), lang=langs.tolist(), total=total))
        else:
            left = np.concatenate([np.cumsum(unpacked(x.as_py())) for x in t["items"]])
            right = np.concatenate([unpacked(x.as_py()) for x in t["others"]])
            order = np.lexsort((right, left))
            new = np.concatenate([[True], (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])])
            where = np.empty(len(order), dtype=np.int64)
            where[order] = np.cumsum(new) - 1
            named = {"left": left[order][new], "right": right[order][new]}
        f = np.zeros(int(where.max()) + 1, dtype=np.int64)
        np.add.at(f, where, n)
        often = np.flatnonzero(f >= least)
        ids = np.full(len(f), -1, dtype=np.int64)
        ids[often] = np.arange(len(often)) * pages + page
        out.append(batch_of(FOUND, len(often), id=ids[often], f=f[often], **{c: v[often].tolist() for c, v in named.items()}))
        own, at = ids[where], np.concatenate([np.arange(s, s + len(c)) for s, c in zip(t["start"].to_pylist(), counts, strict=True)])
        ends = np.cumsum([len(c) for c in counts])
        rows = [(b, e - len(c) + np.flatnonzero(own[e - len(c) : e] >= 0)) for b, c, e in zip(t["block"].to_pylist(), counts, ends, strict=True)]
        rows = [(b, r) for b, r in rows if len(r)]
        out.append(batch_of(FOUND, len(rows), block=[b for b, _ in rows], at=[packed(at[r]) for _, r in rows], ids=[packed(own[r]) for _, r in rows]))
        return pa.Table.from_batches(out, schema=FOUND)

    return blocks.filter("page is not null").select("block", "lang", "page", "start", "items", "others", "counts").groupBy("page").applyInArrow(run, from_arrow_schema(FOUND))


def next_blocks(blocks: DataFrame, found: DataFrame, pages: int, before: int | None, last: bool) -> DataFrame:
    """``BLOCKS`` of the next length: a block's numbers get their names, and its pairs of these are counted by page.

    The numbers are those of its words, or (where ``before`` is that length's number of pages) of the pairs of the names that it keeps.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        at = np.concatenate([unpacked(x.as_py()) for x in right["at"]] or [np.zeros(0, dtype=np.int64)])
        ids = np.concatenate([unpacked(x.as_py()) for x in right["ids"]] or [np.zeros(0, dtype=np.int64)])
        for r in left.to_pylist():
            sequence = unpacked(r["codes"]) - 1
            if before is not None:
                sequence = pairs_of(sequence, unpacked(r["ids"]), before)[0]
            known = np.full(int(max(sequence.max(initial=-1), at.max(initial=-1))) + 2, -1, dtype=np.int64)  # the last one is that of positions without a number
            known[at] = ids
            names = known[sequence]
            used, local = np.unique(names[names >= 0], return_inverse=True)
            codes = np.full(len(names), -1, dtype=np.int64)
            codes[names >= 0] = local
            pair, page, first, second = pairs_of(codes, used, pages)
            mine = pair[: r["owned"]]
            counts = np.bincount(mine[mine >= 0], minlength=len(first))
            if not last:
                out.append(batch_of(BLOCKS, 1, block=[r["block"]], lang=[r["lang"]], codes=[packed(codes + 1)], ids=[packed(used)], owned=[r["owned"]]))
            out.append(paged(r["block"], r["lang"], page, lambda p, x=first: packed(np.diff(x[p], prepend=0)), lambda p, x=second: packed(x[p]), counts))
        return pa.Table.from_batches(out, schema=BLOCKS)

    state = blocks.filter("codes is not null").select("block", "lang", "codes", "ids", "owned")
    names = found.filter("at is not null").select(F.col("block").alias("of"), "at", "ids")
    return state.groupBy("block").cogroup(names.groupBy("of")).applyInArrow(run, from_arrow_schema(BLOCKS))


def whole(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def ratio(a: Column, l: Column, r: Column, factor: int) -> Column:  # noqa: E741
    """floor(factor * a / (l + r)), exactly; it is at most ``factor``."""
    top = F.lit(factor).cast("decimal(10,0)") * a.cast("decimal(19,0)")
    return F.call_function("div", top, l.cast("decimal(19,0)") + r.cast("decimal(19,0)"))


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, most: int = MOST, factor: int = FACTOR, block: int = BLOCK) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best ``most`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?`` and line ends ``]`` and these into words. a counts a
    phrase's occurrences (overlaps included), n the words of its language. Candidates have a >= ``least``. Of a
    candidate's cuts into two the one of least floor(factor a / (l + r)) counts, of equals the first. One that lies in a
    longer candidate with at least ``covered`` per cent of its count is dropped. Ties go by a, then by the phrase's bytes.

    Words get names first: of all that are in ``least`` places or more. Then, length by length, neighbouring names of
    (k-1)-grams that overlap by k-2 words are counted as pairs, and pairs that are frequent get a name of their own,
    joined back into the texts in place of the shorter ones. As a part is at least as frequent as the whole, no other
    k-gram can be a candidate. The table of pairs (``id, left, right``) leads from a phrase to its parts, whose counts
    (``heads``: of its beginnings, ``tails``: of its ends) are those of all cuts. A longer candidate that covers a phrase
    has a part one word longer that covers it too, so only direct parents are looked up.

    Texts are worked on in blocks of ``block`` words of one language. A block's different words or pairs are counted there
    and dealt by hash into pages, as sorted and compressed lists; a page (one task, of some ``PAGE`` items, as there are
    more of them the more text there is) adds up the lists of all blocks, names what is frequent, and sends each block the
    names of its own numbers. Blocks keep names only, not what was counted in vain. A long text goes over several blocks,
    each of which sees a few positions of the next, so no phrase is lost.

    Defined cases: a null language is ``und``; null and empty texts have no words; words hold any other character;
    repeated rows count again; an empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # of rows that are no files Spark doesn't know it
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    pages, before = max(tasks, size // (8 * PAGE)), None
    blocks = written(first_blocks(docs, lang_col, text_col, longest - 1, pages, block), "blocks-1")
    found = written(named_pages(blocks, least, pages, True), "names-1")
    totals = cut(found.filter("total is not null").groupBy(F.col("lang").alias("total_lang")).agg(F.sum("total").alias("n")))
    known = found.filter("id is not null").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    every = max(tasks, (totals.agg(F.sum("n")).first()[0] or 0) // PAGE)
    scored: list[DataFrame] = []
    for k in range(2, longest + 1):
        blocks, before = written(next_blocks(blocks, found, every, before, k == longest), f"blocks-{k}"), every
        remove(spark, f"{folder}/blocks-{k - 1}")
        found = written(named_pages(blocks, least, every, False), f"names-{k}")
        pairs = found.filter("id is not null").select("id", "left", "right", "f")
        one, two = (known.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("lang", "phrase", "last", "f", "heads", "tails")]) for side in ("left", "right"))
        joined = pairs.join(one, "left").join(two, "right")
        parents = cut(joined.select("id", F.col("left_lang").alias("lang"), F.concat_ws(" ", "left_phrase", "right_last").alias("phrase"), F.col("right_last").alias("last"), "f", F.concat("left_heads", F.array("f")).alias("heads"), F.concat("right_tails", F.array("f")).alias("tails"), "left", "right"))
        if k > 2:
            above = parents.select("f", F.explode(F.array_distinct(F.array("left", "right"))).alias("part")).groupBy("part").agg(F.max("f").alias("above"))
            scored[-1] = scored[-1].join(above, F.col("id") == F.col("part"), "left")
        scored.append(parents)
        known = parents
    remove(spark, f"{folder}/blocks-{longest}")
    scored[-1] = scored[-1].withColumns({"part": F.lit(None).cast("long"), "above": F.lit(None).cast("long")})

    def cuts(k: int) -> Column:
        """The best cut of a k-gram: heads[j - 1] counts its first j words, tails[k - j - 1] the rest."""
        each = [F.struct(ratio(F.col("f"), F.col("heads")[j - 1], F.col("tails")[k - j - 1], factor).alias("score"), F.lit(j).alias("k"), F.col("heads")[j - 1].alias("l"), F.col("tails")[k - j - 1].alias("r")) for j in range(1, k)]
        return F.least(*each) if len(each) > 1 else each[0]

    parts = [df.filter(F.col("above").isNull() | (whole(F.col("above")) * 100 < whole(F.col("f")) * covered)).select("lang", "phrase", F.col("f").alias("a"), cuts(k).alias("c")) for k, df in enumerate(scored, 2)]
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = reduce(DataFrame.unionByName, parts).select("lang", "phrase", "a", "c.*").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return best.join(totals, F.col("lang") == F.col("total_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
parted AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spans AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM parted),
parts AS (SELECT lang, w[i:i + 3] AS w, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS k FROM spans),
grams AS (SELECT lang, array_to_string(w[1:k], ' ') AS phrase, k FROM parts),
f AS (SELECT lang, phrase, k, count(*) AS a FROM grams GROUP BY lang, phrase, k),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
places AS (SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS j FROM candidates),
ends AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:k], ' ') AS rest FROM places),
cuts AS (SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
    FROM ends c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
lengths AS (SELECT lang, w, k, a, unnest(range(2, k)) AS m FROM candidates WHERE k > 2),
starts AS (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM lengths),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM starts),
above AS (SELECT lang, phrase, max(a) AS a FROM inner_ GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN above o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100::HUGEINT * o.a < 80::HUGEINT * b.a),
placed AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT p.lang, p.rank, p.phrase, p.a, p.l, p.r, t.n, p.score FROM placed p JOIN total t ON t.lang = p.lang WHERE rank <= 2000
"""
