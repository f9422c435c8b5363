"""Terms of texts in one Arrow pass: identifiers whole and in parts, stemmed, with weighted counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.lineage import spread
from .text import ENDINGS, PARTS, STOP

_WORD = re.compile(r"\w+")
_PARTS = [(regex.compile(p), r.replace("$", "\\")) for p, r in PARTS]
_ENDINGS = [(re.compile(p, re.S), r.replace("$", "\\")) for p, r in ENDINGS]
#: What a word with one of the endings ends in.
_LAST = frozenset("sgdyne")
_BETWEEN = regex.compile(r"[^\p{L}\p{N}]+")
#: Words whose terms a task remembers, and the largest count of a term in an entry.
MEMORY, MOST = 262_144, 65535


def tokens(word: str) -> list[str]:
    """``text.tokens`` of one word: its parts and, where it has several, the whole; lower case."""
    if word.isascii() and word.isalpha() and (word.islower() or word[1:].islower() or len(word) == 1):
        return [word.lower()]
    spaced = word
    for pattern, with_ in _PARTS:
        spaced = pattern.sub(with_, spaced)
    parts = [p for p in _BETWEEN.split(spaced.lower()) if p]
    return [*parts, word.lower()] if len(parts) > 1 else parts


def stem(token: str) -> str:
    """``text.stem`` of one token."""
    if token[-1] in _LAST and token.isascii():
        for pattern, with_ in _ENDINGS:
            token = pattern.sub(with_, token)
    return token


def vectors(entries: DataFrame, groups: dict[str, dict[str, int]], wanted: frozenset[str] | None = None, key: str = "entry_id", keep: bool = False) -> DataFrame:
    """``key`` (or, to ``keep``, all columns) and, for each group of fields (column and weight), ``<group>_len`` and ``<group>_terms``, from one pass over ``entries``.

    A group's terms are structs ``term, tf``: the weights of a term's fields summed over its occurrences, up to 65535;
    its len sums all weights, at least 1. With ``wanted``, only these terms are listed. A null field is empty.
    """
    columns = sorted({c for fields in groups.values() for c in fields})
    pair = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))
    kept = entries.columns if keep else [key]
    schema = T.StructType([*(entries.schema[c] for c in kept), *(f for g in groups for f in (T.StructField(f"{g}_len", T.LongType()), T.StructField(f"{g}_terms", pair)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, list[str]]] = {}

        def terms_of(word: str) -> tuple[int, list[str]]:
            stems = [stem(t) for t in tokens(word)]
            if len(known) >= MEMORY:
                known.clear()
            own = known[word] = (len(stems), [s for s in stems if wanted is None or s in wanted])
            return own

        for whole in batches:
            for at in range(0, len(whole), 128):
                batch = whole.slice(at, 128)
                texts = {c: batch.column(c).to_pylist() for c in columns}
                out = [batch.column(c) for c in kept]
                for fields in groups.values():
                    lens, starts, found, tfs = [], [0], [], []
                    for i in range(len(batch)):
                        size, counts = 0, {}
                        for c, w in fields.items():
                            for word, n in Counter(_WORD.findall(texts[c][i] or "")).items():
                                k, own = known.get(word) or terms_of(word)
                                size += k * n * w
                                for t in own:
                                    counts[t] = counts.get(t, 0) + n * w
                        lens.append(max(size, 1))
                        found += counts
                        tfs += [min(n, MOST) for n in counts.values()]
                        starts.append(len(found))
                    structs = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(tfs, pa.int32())], names=["term", "tf"])
                    out += [pa.array(lens, pa.int64()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), structs)]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return spread(entries.select(*dict.fromkeys([*kept, *columns]))).mapInArrow(run, schema)


def asked(questions: DataFrame, text: str = "text") -> DataFrame:
    """``question_id, term``: distinct stems of each question's tokens that aren't stop words."""
    schema = T.StructType([questions.schema["question_id"], T.StructField("term", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, value in enumerate(batch.column("text").to_pylist()):
                own = {stem(t) for word in _WORD.findall(value or "") for t in tokens(word) if t not in STOP}
                row += [i] * len(own)
                found += sorted(own)
            yield pa.RecordBatch.from_arrays([batch.column("question_id").take(pa.array(row, pa.int32())), pa.array(found, pa.string())], names=schema.names)

    return questions.selectExpr("question_id", f"{text} AS text").mapInArrow(run, schema)
