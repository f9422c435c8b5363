"""Packing token sequences: best-two-fit over the lengths of all pieces."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ranked, slices, spread

#: Characters of a long text that are encoded at a time.
LONG = 1 << 20
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]{{2}}")
_BEFORE_LAST = re.compile(f"(?<=[{_SPACE}])(?=[{_SPACE}][^{_SPACE}])")
#: The byte-level pattern without its look-ahead, which makes matching linear; texts are split where it would act.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer JSON file, whose ids are the ranks of its merges; its added tokens are special."""
    with open(vocabulary, encoding="utf-8") as f:
        whole = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"]: t["id"] for t in whole.get("added_tokens") or []}
    if odd := [t["content"] for t in whole.get("added_tokens") or [] if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"])]:
        raise ValueError(f"added tokens with white space or for whole words only are not supported: {odd}")
    ranks = {bytes(byte_of[c] for c in token): i for token, i in whole["model"]["vocab"].items() if all(c in byte_of for c in token) and token not in added}
    return tiktoken.Encoding("bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=2)
def added_pattern(enc: tiktoken.Encoding) -> re.Pattern | None:
    """Finds the literals of added tokens, the longest first."""
    return re.compile("|".join(re.escape(t) for t in sorted(enc.special_tokens_set, key=lambda t: (-len(t), t)))) if enc.special_tokens_set else None


def encode(text: str, enc: tiktoken.Encoding) -> list[int]:
    """Token ids; the literal of an added token is that token, and what is between such literals is encoded by itself."""
    pattern = added_pattern(enc)
    if pattern is None or not pattern.search(text):
        return encode_plain(text, enc)
    ids, start = [], 0
    for found in pattern.finditer(text):
        ids += [*encode_plain(text[start : found.start()], enc), enc.encode_single_token(found.group())]
        start = found.end()
    return ids + encode_plain(text[start:], enc)


def encode_plain(text: str, enc: tiktoken.Encoding) -> list[int]:
    """Token ids; no token of this pattern spans the start of white space."""
    if not _RUN.search(text):
        return enc.encode_ordinary(text)
    return [i for part in _BEFORE_LAST.split(text) for i in enc.encode_ordinary(part)]


def lengths_of(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: full ones, after a shorter first one."""
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document: its tokens and then ``end_id``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    fields = [source.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                row, piece, start, length, crc, parts = [], [], [], [], [], []
                for k, text in enumerate(batch.column("__text")):
                    ids = np.concatenate([*(np.array(encode(part, enc), dtype="<u4") for part in slices(text.as_py(), LONG)), np.array([end_id], dtype="<u4")])
                    s = 0
                    for p, n in enumerate(lengths_of(len(ids), capacity)):
                        part = ids[s : s + n]
                        row.append(k), piece.append(p), start.append(s), length.append(n), crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            parts.append(part.astype("i4"))
                        s += n
                columns = [batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                columns += [pa.array(parts, pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return spread(source).mapInArrow(run, T.StructType(fields))


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Bins as ``(how many alike, lengths)`` for ``counts[length]`` pieces; every piece is in exactly one bin.

    A bin takes the longest piece left and is filled greedily with the longest that fits. Then its smallest piece is
    replaced by the two unpacked pieces that fill the gap this leaves most tightly, if they fill it better. Bins that
    come out alike are made at once, as often as their lengths last, so work depends on the number of distinct
    lengths (at most ``capacity``), not on that of pieces.
    """
    left = Counter({n: c for n, c in counts.items() if c})
    order = sorted(left)
    bins = []
    while order:
        gap, used = capacity, Counter()
        while (i := bisect_right(order, gap)) > 0:
            while i and left[order[i - 1]] <= used[order[i - 1]]:
                i -= 1
            if not i:
                break
            used[order[i - 1]] += 1
            gap -= order[i - 1]
        if gap and used.total() > 1:
            small = min(used)
            pair = two_within(order, left, used, gap + small)
            if pair and sum(pair) > small:
                used[small] -= 1
                used.update(pair)
        used = +used
        times = min(left[n] // c for n, c in used.items())
        bins.append((times, tuple(sorted(used.elements(), reverse=True))))
        for n, c in used.items():
            left[n] -= times * c
            if not left[n]:
                order.remove(n)
    return bins


def two_within(order: list[int], left: Counter, used: Counter, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum up to ``room``."""
    best, found = 0, None
    low, high = 0, bisect_right(order, room) - 1
    while low <= high:
        a, b = order[low], order[high]
        if a + b > room or left[b] - used[b] < 1:
            high -= 1
        elif left[a] - used[a] < (2 if low == high else 1):
            low += 1
        else:
            if a + b > best:
                best, found = a + b, (a, b)
            low += 1
    return found


def slots(bins: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """Where the k-th piece of a length goes: arrays of length and first k (as one key), first sequence, offset."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for times, lengths in bins:
        offset = 0
        for n in lengths:
            rows.append(((n << 44) + taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else ((), (), ())))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset`` in a sequence of at most ``capacity`` tokens.

    Tokenizing is one pass; the counts of pieces by length (at most ``capacity`` rows) are all that the driver sees,
    and best-two-fit over them is the packing of all pieces together, not one by partition. Pieces are then numbered
    within their length, in hash buckets, and look their place up by that number.

    Defined cases: a null or empty text is the end id alone; repeated rows and null ids are documents of their own;
    pieces of one length are interchangeable, ties go by id and row; an empty table gives an empty result; further
    columns of ``docs`` are ignored.
    """
    made = cut(pieces(docs, vocabulary, id_col, text_col, capacity, end_id, with_ids).withColumn("__row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    key, sequence, offset = slots(best_two_fit(counts, capacity))
    numbered = ranked(made, ["length"], [F.col("__row")], F.col("__row")).drop("__row")
    names = [c for c in numbered.columns if c != "__rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (np.asarray(batch.column("length")).astype(np.int64) << 44) + np.asarray(batch.column("__rank"))
            at = np.searchsorted(key, own, side="right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence[at] + own - key[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, T.StructType([*numbered.drop("__rank").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, input_ids, doc_ids``: the token sequences of ``pack(..., with_ids=True)``, each of bounded size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("input_ids"), F.col("p.doc_id").alias("doc_ids"))
