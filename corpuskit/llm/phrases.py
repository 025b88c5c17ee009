"""Collocations: frequent phrases of two to five words, scored against their parts.

Texts are packed into chunks of a few kilobytes per language, each with up to four words of what follows
as context, so a long text is many rows. Over the bytes of many chunks numpy builds prefix sums of a
polynomial modulo 2^64; a word's fingerprint is a difference of two of them, and prefix sums over the
words' fingerprints give that of every n-gram (Rabin-Karp). Each task counts its own n-grams first; the
shuffle adds up (fingerprint, count, check value, place of one occurrence).

Only what is frequent gets a text: its place is looked up in the chunks. A second, independent polynomial
is the check value. Where a fingerprint has more than one, texts collided: all its occurrences are then
counted again by their text.

An n-gram can only be frequent if the shorter ones in it are. After each length the frequent fingerprints
set bits in a filter of fixed size that goes to all tasks; longer n-grams with a part that is not in it
are not counted. A false hit of the filter costs a row and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm.common import quoted, slices, stored
from corpuskit.operators.ordered import top_per_key

LONGEST = 5
LEAST = 100
TOP = 2000
SHARE = 100

#: bytes of a chunk, of the chunks worked on at a time, bits of the filter (4 MB, whatever the input)
CHUNK = 1 << 13
PART = 1 << 19
FILTER_BITS = 1 << 25
#: n-grams a task holds before it hands them on, of those it only counts and of those it finds places for
HELD, HELD_PLACES = 1 << 21, 1 << 19

#: an n-gram's place: 20 bits of the task, 23 of its chunks, 17 of the word, 3 of the length
TASK_BITS, CHUNK_BITS, WORD_BITS, LENGTH_BITS = 20, 23, 17, 3

_STOP = b".,;:!?\n\x0b\x0c\r"
_CUT = re.compile(rb"[ \t.,;:!?\n-\r]")
_AFTER = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n-\r]+){0,%d}" % (LONGEST - 1))
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(_STOP)] = 2

#: odd bases, so that powers have inverses modulo 2^64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64, ``n`` at least; kept between calls."""
    held = _TABLES.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            done, step = 1, b
            while done < size:
                out[done:2 * done] = out[:done] * np.uint64(step)
                step = step * step & _MASK
                done *= 2
            tables.append(out)
        held = _TABLES[base] = tuple(tables)
    return held


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of fingerprints; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial of values[start:end] for each start and end, from prefix sums modulo 2^64."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


class Words:
    """The words of a list of chunks: where they are, their pieces, chunks and fingerprints."""

    def __init__(self, texts: list[bytes], own: list[int]):
        data = b"\n".join(texts).lower()
        raw = np.frombuffer(data, np.uint8)
        kind = _KIND[raw]
        word = np.zeros(len(raw) + 2, np.int8)
        word[1:-1] = kind == 0
        turn = np.diff(word)
        self.data, self.raw = data, raw
        self.starts, self.ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        stops = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(stops, self.starts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        self.chunk = np.searchsorted(self.offsets, self.starts, "right") - 1
        #: context words are only counted in the chunk that owns them
        self.own = self.starts < self.offsets[self.chunk] + np.asarray(own, np.int64)[self.chunk]
        self.first = np.searchsorted(self.chunk, np.arange(len(texts)))

    def fingerprints(self, base: int) -> np.ndarray:
        return mixed(spans(self.raw.astype(np.uint64) + np.uint64(1), self.starts, self.ends, base))

    def grams(self, n: int) -> np.ndarray:
        """The words that an n-gram starts at: ``n`` words of one piece (and so of one chunk)."""
        at = np.arange(max(0, len(self.starts) - n + 1))
        return at[self.piece[at] == self.piece[at + n - 1]]


def gram_prints(words: np.ndarray, at: np.ndarray, n: int, base: int, salt: np.ndarray, bits: int = 64) -> np.ndarray:
    """Fingerprints of ``bits`` bits of the n-grams that start at ``at``; ``salt`` tells languages apart."""
    return mixed(spans(words, at, at + n, base) ^ (salt + np.uint64(n))) >> np.uint64(64 - bits)


class Filter:
    """Bits set by fingerprints; ``has`` is true for all of them and for few others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(prints: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(FILTER_BITS - 1)
        return [(prints >> np.uint64(s)) & mask for s in (0, 32)]

    def has(self, prints: np.ndarray) -> np.ndarray:
        out = np.ones(len(prints), bool)
        for p in self.places(prints):
            out &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _salts(langs: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x.encode()) for x in langs), np.uint64, len(langs)) & np.uint64(_MASK - 7)


def cut_text(text: bytes) -> Iterator[tuple[bytes, int]]:
    """(chunk with its context, bytes that are its own): no word is cut."""
    start = 0
    while len(text) - start > CHUNK:
        gap = _CUT.search(text, start + CHUNK)
        if gap is None:
            break
        end = gap.start()
        yield text[start:_AFTER.match(text, end).end()], end - start
        start = end
    yield text[start:], len(text) - start


def _chunks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(chunk, lang, text, own, n_words), short texts of a language packed together."""
    slim = docs.filter(quoted(text).isNotNull()).select(
        quoted(text).alias("text"), F.coalesce(quoted(lang).cast("string"), F.lit("und")).alias("lang")
    )
    out = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("text", pa.string()), ("own", pa.int32()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        if task >= 1 << TASK_BITS:
            raise ValueError(f"more than {1 << TASK_BITS} tasks")
        count = 0
        open_: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def rows(found: list[tuple[str, bytes, int]]) -> pa.RecordBatch:
            nonlocal count
            if count + len(found) > 1 << CHUNK_BITS:
                raise ValueError(f"more than {1 << CHUNK_BITS} chunks in one task")
            words = Words([f[1] for f in found], [f[2] for f in found])
            n = np.bincount(words.chunk[words.own], minlength=len(found))
            if len(words.chunk) and np.bincount(words.chunk).max() > 1 << WORD_BITS:
                raise ValueError("a chunk has too many words")
            ids = np.arange(count, count + len(found)) + (task << CHUNK_BITS)
            count += len(found)
            return pa.RecordBatch.from_arrays([
                pa.array(ids), pa.array([f[0] for f in found]), pa.array([f[1].decode() for f in found]),
                pa.array([f[2] for f in found], pa.int32()), pa.array(n, pa.int64()),
            ], schema=out)

        def packed(name: str) -> tuple[str, bytes, int]:
            body = b"\n".join(open_.pop(name))
            sizes.pop(name)
            return name, body, len(body)

        for batch in (part for whole in batches for part in slices(whole, 1 << 20)):
            found = []
            for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                *whole, (rest, own) = cut_text(body.encode())
                found += [(name, b, n) for b, n in whole]
                open_.setdefault(name, []).append(rest)
                sizes[name] = sizes.get(name, 0) + own + 1
                if sizes[name] >= CHUNK:
                    found.append(packed(name))
            if len(open_) > 256:
                found += [packed(name) for name in list(open_)]
            if found:
                yield rows(found)
        if open_:
            yield rows([packed(name) for name in list(open_)])

    return slim.mapInArrow(run, "chunk long, lang string, text string, own int, n_words long")


def _parts_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    """(rows, their words, a salt per word) for parts of a batch of chunks; parts without words are left out."""
    for part in slices(batch, size):
        words = Words([t.encode() for t in part.column(2).to_pylist()], part.column(3).to_pylist())
        if len(words.starts):
            yield part, words, _salts(part.column(1).to_pylist())[words.chunk]


def _counted(chunks: DataFrame, lengths: tuple[int, ...], known, parts: int, bits: int) -> DataFrame:
    """(fp, n): each task's own counts of its n-grams, of those whose ``parts``-grams are all in ``known``."""
    out = pa.schema([("fp", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = None if known is None else Filter(known.value)
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            fp, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(n)], schema=out)

        for _, words, salt in (x for batch in batches for x in _parts_of(batch, PART)):
            prints = words.fingerprints(BASES[0])
            if test is not None:
                ok = np.zeros(len(words.starts), bool)
                at = words.grams(parts)
                ok[at] = test.has(gram_prints(prints, at, parts, BASES[0], salt[at], bits))
            for n in lengths:
                at = words.grams(n)
                at = at[words.own[at]]
                if test is not None:
                    for i in range(n - parts + 1):
                        at = at[ok[at + i]]
                held.append(gram_prints(prints, at, n, BASES[0], salt[at], bits))
                size += len(at)
            if size >= HELD:
                yield summed()
                held, size = [], 0
        if size:
            yield summed()

    return chunks.select("chunk", "lang", "text", "own").mapInArrow(run, "fp long, n long")


def _placed(chunks: DataFrame, known, bits: int) -> DataFrame:
    """(fp, low, high, place): each task's first place of the n-grams in ``known``, and their check values."""
    out = pa.schema([("fp", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Filter(known.value)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def summed() -> tuple[np.ndarray, ...]:
            fp, low, high, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(fp, kind="stable")
            fp, low, high, place = fp[order], low[order], high[order], place[order]
            at = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            return fp[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(place, at)

        def rows(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in found], schema=out)

        for part, words, salt in (x for batch in batches for x in _parts_of(batch, PART)):
            prints = [words.fingerprints(b) for b in BASES]
            word = (part.column(0).to_numpy()[words.chunk] << WORD_BITS) + (np.arange(len(words.starts)) - words.first[words.chunk])
            for n in range(1, LONGEST + 1):
                at = words.grams(n)
                at = at[words.own[at]]
                fp = gram_prints(prints[0], at, n, BASES[0], salt[at], bits)
                hit = test.has(fp)
                at, fp = at[hit], fp[hit]
                if len(at):
                    chk = gram_prints(prints[1], at, n, BASES[1], salt[at]).view(np.int64)
                    held.append((fp, chk, chk, (word[at] << LENGTH_BITS) + n))
                    size += len(at)
            if size >= HELD_PLACES:
                held = [summed()]
                size = len(held[0][0])
                if size > HELD_PLACES // 2:
                    yield rows(held.pop())
                    size = 0
        if held:
            yield rows(summed())

    # each task hands on each frequent n-gram once, so there are as few tasks as keep all cores busy
    tasks = 2 * chunks.sparkSession.sparkContext.defaultParallelism
    few = chunks.select("chunk", "lang", "text", "own").coalesce(tasks)
    return few.mapInArrow(run, "fp long, low long, high long, place long")


def _filter(prints: DataFrame):
    """The filter of the fingerprints, at most ``FILTER_BITS`` bits, as a broadcast."""
    mask = F.lit(FILTER_BITS - 1).cast("long")
    places = prints.select(F.explode(F.array(*[
        F.shiftrightunsigned("fp", s).bitwiseAND(mask) for s in (0, 32)
    ])).alias("p"))
    bits = places.groupBy(F.shiftright("p", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits")
    ).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return prints.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def _texts(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """(place, lang, words): the words at each place, read from its chunk."""
    word = F.shiftright("place", LENGTH_BITS)
    wanted = places.select(F.shiftright(word, WORD_BITS).alias("chunk"), "place").groupBy("chunk").agg(
        F.collect_list("place").alias("places")
    )
    # a chunk has at most five places per word
    joined = chunks.join(wanted, "chunk").select("lang", "text", "own", "places")
    out = pa.schema([("place", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1 << 20)):
            for name, text, own, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = Words([text.encode()], [own])
                rows = []
                for p in at:
                    first = (p >> LENGTH_BITS) & ((1 << WORD_BITS) - 1)
                    ends = range(first, first + (p & ((1 << LENGTH_BITS) - 1)))
                    rows.append([words.data[words.starts[i]:words.ends[i]].decode() for i in ends])
                yield pa.RecordBatch.from_arrays([
                    pa.array(at, pa.int64()), pa.array([name] * len(at)), pa.array(rows, pa.list_(pa.string())),
                ], schema=out)

    return joined.mapInArrow(run, "place long, lang string, words array<string>")


def _by_text(chunks: DataFrame, clashes: DataFrame, bits: int) -> DataFrame:
    """(lang, words, a): all occurrences of the clashing fingerprints counted by their text."""
    test = _filter(clashes)
    out = pa.schema([("fp", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(test.value)
        for part, words, salt in (x for batch in batches for x in _parts_of(batch, 1 << 18)):
            names = part.column(1).to_pylist()
            prints = words.fingerprints(BASES[0])
            for n in range(1, LONGEST + 1):
                at = words.grams(n)
                at = at[words.own[at]]
                fp = gram_prints(prints, at, n, BASES[0], salt[at], bits)
                hit = known.has(fp)
                at, fp = at[hit], fp[hit]
                for cut in range(0, len(at), 1 << 14):
                    some = at[cut:cut + (1 << 14)]
                    texts = [[words.data[words.starts[j]:words.ends[j]].decode() for j in range(i, i + n)] for i in some]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(fp[cut:cut + (1 << 14)].view(np.int64)), pa.array([names[words.chunk[i]] for i in some]),
                        pa.array(texts, pa.list_(pa.string())),
                    ], schema=out)

    seen = chunks.select("chunk", "lang", "text", "own").mapInArrow(run, "fp long, lang string, words array<string>")
    counted = seen.groupBy("fp", "lang", "words").agg(F.count(F.lit(1)).alias("a"))
    return counted.join(clashes, "fp", "left_semi").select("lang", "words", "a")


def frequent_phrases(chunks: DataFrame, least: int = LEAST, bits: int = 64) -> DataFrame:
    """(lang, words, a): all n-grams of one to five words that occur ``least`` times or more in a language."""
    spark = chunks.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole: DataFrame | None = None
    known, parts = None, 0
    for lengths in ((1,), (2,), (3,), (4, 5)):
        found = _counted(chunks, lengths, known, parts, bits)
        # tasks have counted already, so a second partial count would only cost
        level = stored(found.repartition(tasks, "fp").groupBy("fp").agg(F.sum("n").alias("a")).filter(F.col("a") >= least), "ngrams")
        whole = level if whole is None else whole.union(level)
        if known is not None:
            known.unpersist()
        known, parts = _filter(level), lengths[-1]
    known.unpersist()
    # only what is frequent needs a place and a check; a false hit of the filter ends in the join
    first = _placed(chunks, _filter(whole), bits).groupBy("fp").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("place").alias("place")
    )
    whole = stored(whole.join(first, "fp"), "places")
    plain = whole.filter("low = high").select("place", "a")
    got = plain.join(_texts(plain.select("place"), chunks), "place").select("lang", "words", "a")
    clashes = whole.filter("low <> high").select("fp")
    if clashes.isEmpty():
        return got
    return got.union(_by_text(chunks, clashes, bits).filter(F.col("a") >= least))


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, share: int = SHARE,
    bits: int = 64,
) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    A to Z are lower-cased. Words stand between blanks and tabs and phrases end at ``.,;:!?`` and line
    ends. A phrase of two to five words that occurs ``a`` times, ``least`` or more, is cut where
    floor(1000 a n / (l r)) is smallest (first such cut), with ``l`` and ``r`` the occurrences of its
    parts and ``n`` those of all words of the language. A phrase goes if a longer candidate that has it
    occurs ``share`` hundredths as often or more. Products are decimals of 38 digits, enough for 10^17
    words.

    A null text is an empty one, a null language is ``und``. Repeated rows count as often as they are
    there. No rows, or none that are frequent, give none. Other columns are not read.
    """
    chunks = stored(_chunks(docs, text, lang), "chunks")
    totals = chunks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    known = stored(frequent_phrases(chunks, least, bits), "phrases").withColumn("phrase", _phrase(F.col("words")))
    size = F.size("words")
    longer = known.filter(size > 1).select("lang", "phrase", "words", "a")
    cuts = longer.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(
        k.alias("k"), _phrase(F.slice("words", F.lit(1), k)).alias("left"), _phrase(F.slice("words", k + 1, size - k)).alias("right"),
    ))).alias("cut")).select("lang", "phrase", "a", "cut.*")
    count = known.select("lang", F.col("phrase").alias("part"), F.col("a").alias("times"))
    for side, out in (("left", "l"), ("right", "r")):
        part = count.withColumnsRenamed({"part": side, "times": out})
        cuts = cuts.join(part, ["lang", side])
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    scored = cuts.join(totals, "lang").withColumns({f"_{c}": v for c, v in wide.items()}).withColumn(
        "score", F.expr("CAST(CAST(1000 AS DECIMAL(4,0)) * _a * _n AS DECIMAL(38,0)) DIV CAST(_l * _r AS DECIMAL(38,0))")
    )
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
    inner = F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda i: _phrase(F.slice("words", i, n))
    ))
    covered = longer.filter(size > 2).select("lang", "a", F.explode(F.array_distinct(F.flatten(inner))).alias("phrase")).groupBy(
        "lang", "phrase"
    ).agg(F.max("a").alias("more"))
    stay = best.join(covered, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("more") < share * F.col("a"), F.lit(True))
    ).drop("more")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = top_per_key(stay, ["lang"], order, top, "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
