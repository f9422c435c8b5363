"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, cut, spread

#: Length of all vectors, documents learned from for each language, and the most languages.
DIMENSIONS, PER_LANGUAGE, MAX_LANGUAGES = 1024, 2000, 1000
#: The chance that a text of nothing learned passes for a learned language.
NOISE = 1e-6
#: Characters that one matrix product covers, and trigrams whose vectors a task keeps.
_CHARS, KNOWN = 1 << 18, 1 << 16


class Profiles:
    """Turns texts into bundles of trigram vectors; keeps the vectors of letters and trigrams met so far.

    A letter's vector is drawn from +-1 by its code point. A trigram binds its letters' vectors, rotated by their
    place, with products. Trigrams run over each lower-cased word with a space on either side, never across words.
    """

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.letter = np.array([chr(i).isalpha() for i in range(0x110000)])
        self.index = np.full(0x110000, -1, dtype=np.int64)
        self.index[32] = 0
        self.vectors = [np.random.default_rng(32).choice(np.array([-1, 1], dtype=np.float32), dimensions)]
        self.known: dict[int, int] = {}
        self.bound = np.zeros((1024, dimensions), dtype=np.int8)

    def places(self, points: np.ndarray) -> np.ndarray:
        place = self.index[points]
        if (place < 0).any():
            for p in np.unique(points[place < 0]):
                self.index[p] = len(self.vectors)
                self.vectors.append(np.random.default_rng(int(p)).choice(np.array([-1, 1], dtype=np.float32), self.dimensions))
            place = self.index[points]
        return place

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of trigrams, given as three places of 21 bits."""
        at = np.empty(len(keys), dtype=np.int64)
        for i, key in enumerate(keys.tolist()):
            row = self.known.get(key)
            if row is None:
                row = self.known[key] = len(self.known)
                if row == len(self.bound):
                    self.bound = np.concatenate([self.bound, np.zeros_like(self.bound)])
                a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
                self.bound[row] = np.roll(self.vectors[a], 2) * np.roll(self.vectors[b], 1) * self.vectors[c]
            at[i] = row
        if len(self.known) > KNOWN:
            found = self.bound[at].astype(np.float32)
            self.known, self.bound = {}, np.zeros((1024, self.dimensions), dtype=np.int8)
            return found
        return self.bound[at].astype(np.float32)

    def add(self, out: np.ndarray, docs: list[int], texts: list[str]) -> None:
        points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
        is_letter = self.letter[points]
        # One space after each word and one before it remain; words need no more of what is between them.
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[:-1] |= is_letter[1:]
        place = self.places(np.where(is_letter, points, 32)[keep])
        doc = doc[keep]
        if len(place) < 3:
            return
        middle = (place[1:-1] != 0) & (doc[:-2] == doc[2:])
        size = len(self.vectors)
        a, b, c, doc = place[:-2][middle], place[1:-1][middle], place[2:][middle], doc[1:-1][middle]
        if not len(doc):
            return
        if size**3 <= 1 << 20:
            flat = (a * size + b) * size + c
            unique = np.flatnonzero(np.bincount(flat, minlength=size**3))
            column = np.zeros(size**3, dtype=np.int32)
            column[unique] = np.arange(len(unique))
            inverse = column[flat]
            unique = unique // (size * size) << 42 | unique // size % size << 21 | unique % size
        else:
            unique, inverse = np.unique(a << 42 | b << 21 | c, return_inverse=True)
        counts = np.bincount(doc * len(unique) + inverse, minlength=len(texts) * len(unique)).reshape(len(texts), -1)
        np.add.at(out, docs, counts.astype(np.float32) @ self.rows(unique))

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text; zero where it has no letter. Long texts are cut between words and summed."""
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        docs, parts, size = [], [], 0
        for i, text in enumerate(texts):
            for part in cut_text((text or "").lower()):
                if parts and (size + len(part) > _CHARS or len(parts) >= 256):
                    self.add(out, docs, parts)
                    docs, parts, size = [], [], 0
                docs.append(i), parts.append(part)
                size += len(part)
        if parts:
            self.add(out, docs, parts)
        return out


def cut_text(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > _CHARS:
        end = start + _CHARS
        while end > start and text[end - 1].isalpha():
            end -= 1
        end = end if end > start else start + _CHARS
        yield text[start:end]
        start = end
    yield text[start:]


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-9)


def prototypes(labelled: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes: the sums of the unit profiles of up to ``per_language`` documents of each.

    ``labelled`` has ``doc_id, text, lang``. The documents are those of least hash in each language, so the sample is
    bounded and the same in every run; only it is bundled, and only partial sums reach the driver.
    """
    with_text = labelled.filter("lang is not null and text is not null and doc_id is not null")
    ids = cut(bounded_sample(with_text.select("doc_id", "lang"), "lang", "doc_id", per_language).select(F.col("doc_id").alias("__id")))
    languages = with_text.select("lang").distinct().count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages; at most {MAX_LANGUAGES} are supported")
    # Rows that share an id count as one document, that of the least text.
    sample = with_text.join(F.broadcast(ids.distinct()), F.col("doc_id") == F.col("__id"), "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text").repartition(16)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, total = Profiles(dimensions), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, row in zip(langs, unit(profiles.bundles(batch.column("text").to_pylist())), strict=True):
                total[lang] = total.get(lang, 0) + row.astype(np.float64)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(total, pa.string()), "v": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})

    found: dict[str, np.ndarray] = {}
    for r in sorted(sample.mapInArrow(sums, "lang string, v array<double>").collect(), key=lambda r: (r["lang"], r["v"])):
        found[r["lang"]] = found.get(r["lang"], 0) + np.array(r["v"])
    names = sorted(found)
    return names, unit(np.array([found[n] for n in names])).astype(np.float32) if names else np.zeros((0, dimensions), dtype=np.float32)


def predict(docs: DataFrame, names: list[str], vectors: np.ndarray, text_col: str = "text", carry: list[str] | None = None, least: float | None = None) -> DataFrame:
    """``docs`` (its columns in ``carry``) with ``lang_pred`` and ``score``, the largest cosine with a prototype.

    With ``least``, the rows whose language is known with at least that cosine, without these two columns.

    Defined cases: a null text, one without a letter, or any text where no language was learned is ``und`` with score
    0; ties take the first language by name; repeated rows are predicted each; an empty table gives an empty result.
    """
    carry = docs.columns if carry is None else carry
    kept = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], *([] if text_col in carry else [F.col(text_col).alias("__text")]))
    text = f"__c{carry.index(text_col)}" if text_col in carry else "__text"
    source, kept = kept, kept.drop("__text")
    inputs = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(vectors.shape[1])
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                rows = profiles.bundles(part.column(text).to_pylist())
                some = rows.any(axis=1) & bool(names)
                cosine = unit(rows) @ vectors.T if names else np.zeros((len(rows), 1))
                best = cosine.argmax(axis=1)
                lang = [names[b] if s else "und" for b, s in zip(best, some, strict=True)]
                score = np.where(some, np.clip(cosine[np.arange(len(rows)), best], 0, 1), 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in inputs], pa.array(lang, pa.string()), pa.array(score)], names=[*inputs, "lang_pred", "score"])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = spread(source).mapInArrow(run, schema)
    if least is not None:
        found = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score")
    return found.withColumnsRenamed({f"__c{i}": c for i, c in enumerate(carry)})


def identify(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, lang_pred, score``, learned from the documents that are not held out.

    Held out are those whose crc32(id as text) mod 3 is 1; a null id is neither held out nor learned from.
    """
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    names, vectors = prototypes(docs.filter(~held).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), names, vectors, carry=["doc_id", "held_out"])


def noise_bound(languages: int, dimensions: int = DIMENSIONS) -> float:
    """The cosine that a text without a learned trigram reaches with any of ``languages`` by chance in one of a million.

    Its standard deviation with one is 1/sqrt(dimensions), however long the text is.
    """
    return NormalDist().inv_cdf(1 - NOISE / max(languages, 1)) / dimensions**0.5


def drop_unknown(docs: DataFrame, least: float | None = None) -> DataFrame:
    """``docs`` without those rejected: no letter, or no language whose cosine reaches ``least``
    (if not given, what chance does not reach over all languages); all columns stay."""
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    names, vectors = prototypes(docs.filter(~held).select("doc_id", "text", "lang"))
    return predict(docs, names, vectors, least=noise_bound(len(names)) if least is None else least)
