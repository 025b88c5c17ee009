"""SimHash near-duplicates through an inverted index of byte positions.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most two bits
differ in at most two bytes, so they share at least six positional bytes: that is the guaranteed
minimum of the count filter. The index therefore has one posting per six (position, byte) entries;
two fingerprints meet in a posting exactly if their tally reaches six. Postings with one member
end there.

Verification lists no pairs: two fingerprints are within two bits exactly if some 64-bit value is
within one bit of both. Every member of a posting names itself and its one-bit neighbours in the
two free bytes (17 values); those that name the same value are linked to the smallest of them. A
posting of n members costs 17 n rows, so a group of a hundred thousand near copies costs what a
hundred thousand strangers cost.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm.common import map_batches, quoted, stored, word_blocks
from corpuskit.llm.near_copies import keep_one  # noqa: F401  (its rows need no two-bit links)

SHINGLE = 3
SEED = 42


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint as a signed 64-bit integer; 0 for a text without words."""
    counts = np.zeros(64, np.int64)
    total = 0
    carry: list[bytes] = []
    few: list[bytes] = []
    for words in word_blocks((text or "").encode().lower()):
        words = carry + words
        if len(words) >= shingle:
            grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
            n = len(words) - shingle + 1
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
            total += n
        few = words
        carry = words[-(shingle - 1):] if shingle > 1 else []
    if not total and few:
        return _signed(xxhash.xxh64_intdigest(b" ".join(few), SEED))
    bits = 2 * counts > total
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fingerprint`` (bigint). A null text counts as a text without words."""

    def run(data):
        return {"fingerprint": [fingerprint(t) for t in data[text]]}

    return map_batches(docs, [text], run, [T.StructField("fingerprint", T.LongType())], keep)


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def near_links(prints: DataFrame) -> DataFrame:
    """Links (fp, hub), fp > hub, that connect all distinct ``fp`` within two bits of each other."""
    free = list(combinations(range(8), 2))
    keep = F.array(*[F.lit(_signed(~_mask(p) & ((1 << 64) - 1))) for p in free])
    postings = prints.select("fp", F.posexplode(keep).alias("slot", "mask")).select(
        "fp", "slot", F.col("fp").bitwiseAND(F.col("mask")).alias("shared")
    )
    # a posting holds at most 2^16 distinct fingerprints, so the window is bounded
    met = postings.withColumn(
        "members", F.count(F.lit(1)).over(Window.partitionBy("slot", "shared"))
    ).filter("members > 1")
    flips = F.array(*[
        F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << (8 * p + b))) for p in pair for b in range(8)])
        for pair in free
    ])
    named = met.select("fp", F.explode(flips[F.col("slot")]).alias("flip")).distinct().select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")
    )
    # at most 65 fingerprints are within one bit of a value
    hubs = named.withColumn("hub", F.min("fp").over(Window.partitionBy("middle")))
    return hubs.filter("fp > hub").select("fp", "hub").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v): every linked node but the smallest of its component, with that smallest node.

    Alternates two star steps, so long chains need few rounds: first each node hands its larger
    neighbours to its smallest one, then its smaller neighbours. Each round is stored, and only a
    row count and a checksum come to the driver.
    """
    edges = stored(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    seen = _digest(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("at"), F.least("m", "u").alias("m")
        )
        large = edges.join(least, edges["v"] == least["at"]).select("u", "m").filter("u <> m").distinct()
        low = large.groupBy("u").agg(F.min("m").alias("low"))
        small = large.join(low, "u").select(
            F.explode(F.array("u", "m")).alias("u"), F.col("low").alias("v")
        ).filter("u <> v").distinct()
        edges = stored(small, "links")
        now = _digest(edges)
        if now == seen:
            return edges
        seen = now


def with_components(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Add ``component_id``: the smallest id reachable over links, null if all of those are null.

    ``prints`` has ``doc_id`` and ``fingerprint`` and should be stored, as it is read thrice.
    Copies meet as one fingerprint with its smallest id before anything is linked.
    """
    per_print = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(quoted(doc_id)).alias("first_id"))
    per_print = stored(per_print, "prints")
    roots = components(near_links(per_print.select("fp")), "fp", "hub")
    rooted = per_print.join(roots, per_print["fp"] == roots["u"], "left").select(
        "fp", "first_id", F.coalesce("v", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return prints.join(labels, "fingerprint", "left")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and are linked like any other. Null ids never name
    a component; repeated rows give repeated rows; other columns are ignored; no rows give none.
    """
    slim = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    prints = stored(with_fingerprint(slim, "text", ["doc_id"]), "fingerprints")
    return with_components(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
