"""Benchmark decontamination by suffix arrays over shards of the training text.

Every Arrow batch of documents is a shard. Its words become integers (a word of no benchmark item
is 0), and a suffix array sorts the shard's suffixes. Every test suffix, that is every place in an
item where a window of words begins, is then binary-searched in it; the equal range gives all
places of the window, and comparing on from there gives the longest verbatim match.

Suffixes that cannot begin a window are left out of the array: each pair of neighbouring words in
a window is a pair of neighbouring words in some item, so a suffix needs a run of such pairs as
long as the shortest window. This leaves out only suffixes no search can hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm.common import fresh, map_batches, quoted

WINDOW = 10
#: Bytes that are no letter, digit or part of a character beyond ASCII become spaces; A-Z fall.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


class TestSet:
    """A block of benchmark items, as integers, with its windows grouped by their length."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.ids: list = []
        self.vocabulary: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = []
        for item, text in items:
            words = words_of(text)
            if words:
                self.ids.append(item)
                self.codes.append(np.array([
                    self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words
                ], np.int64))
        self.base = len(self.vocabulary) + 1
        pairs = [c[:-1] * self.base + c[1:] for c in self.codes if len(c) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        #: window length -> [(number of the item, start in it)], all of the block's test suffixes
        self.suffixes: dict[int, list[tuple[int, int]]] = {}
        for i, c in enumerate(self.codes):
            size = min(window, len(c))
            self.suffixes.setdefault(size, []).extend((i, s) for s in range(len(c) - size + 1))
        #: all items in one array, a 0 before, between and after them
        self.joined = np.concatenate([np.zeros(1, np.int64), *[np.append(c, 0) for c in self.codes]])
        self.item_at = np.ones(len(self.codes) + 1, np.int64)
        self.item_at[1:] += np.cumsum([len(c) + 1 for c in self.codes], dtype=np.int64)


def _keys(shard: np.ndarray, tests: np.ndarray, size: int, starts: np.ndarray, at: np.ndarray):
    """Sort keys of the suffixes at ``starts`` in the shard and at ``at`` in the tests, by ``size`` words.

    Both sides are ranked together, word by word: equal keys are equal words, and keys sort like
    the words' numbers do.
    """
    n = len(starts)
    key = np.concatenate([shard[starts], tests[at]])
    for k in range(1, size):
        word = np.concatenate([shard[starts + k], tests[at + k]])
        key = np.unique(key * (int(word.max()) + 1) + word, return_inverse=True)[1]
    return key[:n], key[n:]


def search_shard(docs: list[list[bytes]], tests: TestSet) -> Iterator[tuple[int, int, int, int, int]]:
    """All matches that reach as far left and right as they can, in one shard.

    Yields (document, start, item number, start in the item, words); each is at least a window
    long, and every occurrence of a window lies inside one of them.
    """
    begin = np.ones(len(docs) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in docs], out=begin[1:])
    begin[1:] += 1
    shard = np.zeros(begin[-1] + 1, np.int64)
    get = tests.vocabulary.get
    for d, b in zip(docs, begin, strict=False):
        shard[b:b + len(d)] = np.fromiter(map(get, d, repeat(0)), np.int64, len(d))
    known = (shard[:-1] > 0) & (shard[1:] > 0)
    known[known] = np.isin(shard[:-1][known] * tests.base + shard[1:][known], tests.pairs)
    # how many known pairs in a row begin at each place
    here = np.arange(len(known))
    stops = np.flatnonzero(np.append(~known, True))
    run = stops[np.searchsorted(stops, here)] - here
    for size, places in tests.suffixes.items():
        starts = np.flatnonzero((run >= size - 1) & (shard[:-1] > 0))
        if not len(starts):
            continue
        at = np.array([tests.item_at[i] + s for i, s in places], np.int64)
        own, wanted = _keys(shard, tests.joined, size, starts, at)
        order = np.argsort(own, kind="stable")
        array, keys = starts[order], own[order]
        low = np.searchsorted(keys, wanted, "left")
        high = np.searchsorted(keys, wanted, "right")
        for t in np.flatnonzero(high > low):
            where, left = array[low[t]:high[t]], tests.joined[at[t] - 1]
            # a match that goes on to the left is found from there
            where = where[(shard[where - 1] != left) | (left == 0)]
            length = np.full(len(where), size, np.int64)
            going = np.arange(len(where))
            while len(going):
                following = tests.joined[at[t] + length[going]]
                going = going[(following > 0) & (following == shard[where[going] + length[going]])]
                length[going] += 1
            item, offset = places[t]
            number = np.searchsorted(begin, where, "right") - 1
            for d, p, n in zip(number, where - begin[number], length, strict=True):
                yield int(d), int(p), item, offset, int(n)


def shards(docs: list[list[bytes]], words: int = 500_000) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(number of the first document, documents): neighbours of about ``words`` words, none cut."""
    first, held, n = 0, [], 0
    for i, d in enumerate(docs):
        if held and n + len(d) > words:
            yield first, held
            first, held, n = i, [], 0
        held.append(d)
        n += len(d)
    if held:
        yield first, held


MATCHES = T.ArrayType(T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("words", T.LongType()), T.StructField("item_start", T.LongType()),
]))


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> list[DataFrame]:
    """The benchmark in blocks of about ``block_chars`` characters, each small enough to ship to all tasks."""
    items = benchmark.select(quoted(item_id).cast("string").alias("item_id"), quoted(text).alias("text"))
    n = items.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    parts = max(1, -(-n // block_chars))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == b) for b in range(parts)]


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, block_chars: int = 50_000_000) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids) and ``matches``.

    A match is a verbatim run of words, as long as it can be, that holds a window of an item (or a
    whole item shorter than the window). Larger benchmarks are searched block by block in a chain
    of map steps, so a task holds no more than one block of items and the documents are not
    shuffled. Null and empty texts have no words and no matches; null item ids read as the empty
    string; repeated items count once; an empty benchmark matches nothing. Other columns are
    carried along, those named like a new column give way.
    """
    held = fresh(docs, "_held")
    *before, last = _blocks(benchmark, item_id, item_text, block_chars)
    got = docs.withColumn(held, F.lit(None).cast(MATCHES)) if before else docs

    def searched(block: DataFrame, texts: str, state: str | None):
        rows = sorted({(r[0] or "", r[1] or "") for r in block.collect()})
        shipped = docs.sparkSession.sparkContext.broadcast(TestSet(rows, window))

        def found(data) -> tuple[list[list[bytes]], list[list[dict]]]:
            tests = shipped.value
            words = [words_of(t) for t in data[texts]]
            out = [list(x or []) for x in data[state]] if state else [[] for _ in words]
            for first, some in shards(words) if tests.ids else ():
                for d, start, item, at, n in search_shard(some, tests):
                    out[first + d].append({"item_id": tests.ids[item], "start": start, "words": n, "item_start": at})
            return words, out

        return found

    for block in before:
        step = searched(block, text, held)
        got = map_batches(
            got, [text, held], lambda data, step=step: {held: step(data)[1]}, [T.StructField(held, MATCHES)],
            [*docs.columns, held],
        )
    final = searched(last, text, held if before else None)

    def close(data):
        out = {"n_words": [], "n_hit": [], "n_items": [], "items": [], "matches": []}
        for words, found in zip(*final(data), strict=True):
            found.sort(key=lambda x: (x["start"], x["item_id"], x["item_start"], x["words"]))
            n = len(words)
            edges = np.zeros(n + 1, np.int64)
            for x in found:
                edges[x["start"]] += 1
                edges[x["start"] + x["words"]] -= 1
            items = sorted({x["item_id"] for x in found})
            out["n_words"].append(n)
            out["n_hit"].append(int((np.cumsum(edges[:-1]) > 0).sum()))
            out["n_items"].append(len(items))
            out["items"].append(items)
            out["matches"].append(found)
        return out

    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("matches", MATCHES),
    ]
    return map_batches(got, [text, held] if before else [text], close, fields, docs.columns)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the matches of each document."""
    slim = docs.select(quoted(doc_id).alias("doc_id"), quoted("text").alias("text"))
    return with_matches(slim, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "matches",
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no window of a benchmark item occurs, with their own columns only."""
    renamed = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    found = with_matches(renamed, benchmark, f"c{docs.columns.index(text)}")
    return found.filter("n_hit = 0").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
