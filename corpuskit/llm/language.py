"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound from the vectors of its letters,
the first permuted twice and the second once, multiplied element by element. A text's profile is
the bundle (sum) of its trigrams, a language's prototype the bundle of its training texts, and a
text goes to the language whose prototype has the highest cosine with its profile.

All bundles are sums of whole numbers, so prototypes do not depend on how the rows are spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm.common import map_batches, quoted, slices

DIM = 1024
#: Characters worked on at a time, and distinct trigrams with vectors at a time.
CHARS, GRAMS = 1 << 20, 1 << 14


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Code point -> code point of its lower-case letter; 0 for all that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    return table


def letter_vectors(letters: np.ndarray, dim: int) -> np.ndarray:
    """A +1 / -1 vector per letter from a counter-based generator: no table, the same everywhere."""
    x = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(
        1, dim // 64 + 1, dtype=np.uint64
    ) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(letters), dim // 8), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def letter_runs(text: str) -> Iterator[np.ndarray]:
    """The text's letters in bounded pieces; other characters count as one space (0) between words.

    Each piece begins with the last two entries of the one before, so no trigram is lost or doubled.
    """
    table = letter_codes()
    tail = np.zeros(1, np.int64)
    for at in range(0, len(text), CHARS):
        codes = table[np.frombuffer(text[at:at + CHARS].encode("utf-32-le", "replace"), np.uint32)]
        codes = np.concatenate([tail, codes])
        codes = codes[np.append(True, (codes[1:] > 0) | (codes[:-1] > 0))]
        if at + CHARS >= len(text) and codes[-1]:
            codes = np.append(codes, 0)
        if len(codes) > 2:
            yield codes
        tail = codes[-2:]


def bundles(pieces: list[tuple[int, np.ndarray]], n: int, dim: int) -> np.ndarray:
    """Sums of the bound trigrams of ``n`` texts, given as (number of the text, letters)."""
    out = np.zeros((n, dim))
    if not pieces:
        return out
    letters = np.concatenate([codes for _, codes in pieces])
    sizes = np.array([len(codes) for _, codes in pieces])
    begins = np.ones(len(letters), bool)
    last = np.cumsum(sizes)
    begins[last - 1] = begins[last - 2] = False
    rows = np.repeat(np.array([i for i, _ in pieces]), sizes - 2)
    flags = np.zeros(int(letters.max()) + 1, bool)
    flags[letters] = True
    alphabet = np.flatnonzero(flags)
    place = (np.cumsum(flags) - 1)[letters]
    size = len(alphabet)
    codes = ((place[:-2] * size + place[1:-1]) * size + place[2:])[begins[:-2]]
    if size ** 3 <= 1 << 24:
        present = np.zeros(size ** 3, bool)
        present[codes] = True
        grams, where = np.flatnonzero(present), (np.cumsum(present) - 1)[codes]
    else:
        grams, where = np.unique(codes, return_inverse=True)
    base = letter_vectors(alphabet, dim)
    once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    for at in range(0, len(grams), GRAMS):
        some = grams[at:at + GRAMS]
        vectors = twice[some // size ** 2] * once[some // size % size] * base[some % size]
        mine = (where >= at) & (where < at + len(some))
        counts = np.bincount(rows[mine] * len(some) + where[mine] - at, minlength=n * len(some))
        out += counts.reshape(n, len(some)).astype(np.float32) @ vectors.astype(np.float32)
    return out


def profiles(texts: list[str | None], dim: int = DIM) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, profiles of some texts in a row): whole numbers, one row per text.

    Short texts are bundled together, long ones piece by piece.
    """
    first, pieces, size = 0, [], 0
    held = np.zeros((0, dim))

    def done(n: int) -> np.ndarray:
        part = bundles(pieces, n, dim)
        part[:len(held)] += held
        return part

    for i, text in enumerate(texts):
        for codes in letter_runs(text or ""):
            pieces.append((i - first, codes))
            size += len(codes)
            if size >= CHARS:
                held, pieces, size = done(i - first + 1), [], 0
        if len(held) or i - first >= 1023:
            yield first, done(i - first + 1)
            first, pieces, size, held = i + 1, [], 0, np.zeros((0, dim))
    if first < len(texts):
        yield first, done(len(texts) - first)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM,
          max_per_lang: int = 2_000, max_langs: int = 5_000) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from at most about ``max_per_lang`` texts each.

    The draw is over the different texts of a language, so copies neither crowd others out nor count
    twice: by a hash of the text, at a rate that makes the bound the expected number (to the few per cent of
    an estimated count), and always the text of the smallest hash, so every language is learned. Smaller
    languages are taken whole. Rows without a text or language teach nothing. More than ``max_langs``
    languages raise an error, as the prototypes go to every task.
    """
    some = labelled.select(quoted(text).alias("text"), quoted(lang).alias("lang")).filter(
        "text is not null and lang is not null"
    )
    hashed = some.withColumn("h", F.xxhash64("text"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02), F.min("h")).limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not sizes:
        return [], np.zeros((0, dim))
    grain = 1 << 20
    rates = labelled.sparkSession.createDataFrame(
        [(name, min(grain, max(1, max_per_lang * grain // max(1, n))), least) for name, n, least in sizes],
        "lang string, rate long, least long",
    )
    # one row per language, and no more than max_langs of them
    drawn = (F.pmod("h", F.lit(grain)) < F.col("rate")) | (F.col("h") == F.col("least"))
    chosen = hashed.join(F.broadcast(rates), "lang").filter(drawn).dropDuplicates(["lang", "h"]).select("text", "lang")
    schema = T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("sum", T.DoubleType()),
    ])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            langs = batch.column(1).to_pylist()
            for first, rows in profiles(batch.column(0).to_pylist(), dim):
                for name, row in zip(langs[first:first + len(rows)], rows, strict=True):
                    total[name] = total.get(name, 0) + row
        for name, row in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dim), pa.array(range(dim), pa.int32()), pa.array(row, pa.float64())],
                names=schema.names,
            )

    parts = chosen.mapInArrow(sums, schema).groupBy("lang", "at").agg(F.sum("sum").alias("sum"))
    rows = parts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "sum"))).alias("v")).orderBy("lang").collect()
    return [r["lang"] for r in rows], np.array([[x["sum"] for x in r["v"]] for r in rows])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the cosine, 0 where it is negative).

    A null text, one without a letter, and any text where nothing was learned get ``und`` and 0.
    Equal cosines go to the first language by name. Other columns stay unless named like the new.
    """
    langs, prototypes = model
    dim = prototypes.shape[1]
    norms = np.linalg.norm(prototypes, axis=1)
    shipped = docs.sparkSession.sparkContext.broadcast(prototypes / np.where(norms > 0, norms, 1)[:, None])

    def run(data):
        names: list[str] = []
        scores: list[float] = []
        for _, rows in profiles(data[text], dim):
            norm = np.linalg.norm(rows, axis=1)
            if not langs:
                names += ["und"] * len(rows)
                scores += [0.0] * len(rows)
                continue
            cosine = rows @ shipped.value.T / np.where(norm > 0, norm, 1)[:, None]
            best = cosine.argmax(axis=1)
            names += [langs[b] if n else "und" for b, n in zip(best, norm, strict=True)]
            scores += [float(min(1.0, max(0.0, c[b]))) if n else 0.0 for c, b, n in zip(cosine, best, norm, strict=True)]
        return {"lang_pred": names, "score": scores}

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_batches(docs, [text], run, fields, keep)


def held_out(doc_id: Column) -> Column:
    """Documents that teach nothing: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             max_per_lang: int = 2_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; one row per row, whatever repeats.

    Learns from the documents that are not held out. A null id is not held out.
    """
    slim = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), quoted(lang).alias("lang"))
    slim = slim.withColumn("held_out", held_out(F.col("doc_id")))
    model = train(slim.filter("not held_out"), max_per_lang=max_per_lang)
    return predict(slim, model, keep=["doc_id", "held_out"])
