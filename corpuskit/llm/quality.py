"""Quality rules per document, and verdicts on whole hosts.

Each document is measured once. Failures are then summed per host, the hosts' failure rates are
shrunk towards an empirical beta prior (fitted to all hosts by moments), and the verdict on a host
is joined back to its documents. Few documents cannot condemn a host; a host whose documents
mostly fail takes the rest along.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm.common import map_batches, quoted, stored, word_blocks

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _join_codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One code per distinct pair, exact at any size."""
    base = int(right.max()) + 1
    return np.unique(left * base + right, return_inverse=True)[1].astype(np.int64)


def repeated_words(codes: np.ndarray) -> int:
    """Words inside windows of five that occur at least twice, the first occurrence included."""
    n = len(codes) - WINDOW + 1
    if n < 2:
        return 0
    two = _join_codes(codes[:-1], codes[1:])
    four = _join_codes(two[:-2], two[2:])
    five = _join_codes(four[:-1], codes[4:])
    again = np.bincount(five)[five] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(codes) + 1, np.int64)
    edges[:n] += again
    edges[WINDOW:WINDOW + n] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five measures of a text; all zero for null."""
    text = text or ""
    seen: dict[bytes, int] = {}
    parts = [
        np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        for words in word_blocks(text.encode())
    ]
    codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(codes),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(codes),
    )


def with_measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the five measures as bigint columns."""

    def run(data):
        rows = [measure(t) for t in data[text]]
        return {name: [r[i] for r in rows] for i, name in enumerate(MEASURES)}

    return map_batches(docs, [text], run, [T.StructField(m, T.LongType()) for m in MEASURES], keep)


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def host_verdicts(judged: DataFrame, host: str, failed: Column, max_rate: float = 0.5) -> DataFrame:
    """(host, n_docs, n_failed, rate, rejected): the shrunk failure rate of each non-null host.

    With hosts' rates of mean m and of variance v beyond what sampling explains, the prior is
    beta(m s, (1 - m) s), s = m (1 - m) / v - 1. Hosts that do not differ (v = 0) are all given
    the mean. A host is rejected if its shrunk rate is above ``max_rate``.
    """
    hosts = judged.filter(quoted(host).isNotNull()).groupBy(quoted(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("bigint")).alias("n_failed")
    )
    hosts = stored(hosts, "hosts")
    n, k, q, h = hosts.agg(
        F.sum("n_docs"), F.sum("n_failed"),
        F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")), F.count(F.lit(1)),
    ).first()
    n, k, q = n or 0, k or 0, q or 0.0
    mean = k / n if n else 0.0
    between = (q / n - mean * mean if n else 0.0) - mean * (1 - mean) * h / max(n, 1)
    strength = mean * (1 - mean) / between - 1 if between > 0 else None
    if strength is None:
        rate = F.lit(float(mean))
    else:
        strength = max(strength, 1e-6)
        rate = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > max_rate)


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None,
          max_rate: float = 0.5) -> DataFrame:
    """Documents with the measures, ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules and its host is not rejected; one without a
    host is judged by its own rules. A null text has no words and so fails. Repeated rows count as
    often as they occur; other columns are carried along (``keep``), those named like a new column
    give way; no rows give none.
    """
    new = [*MEASURES, "base_failed", "kept"]
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    own = docs.select(
        *[quoted(c).alias(f"c{i}") for i, c in enumerate(carried)], quoted(text).alias("text"), quoted(host).alias("host")
    )
    bad = host_verdicts(with_measures(own, "text", ["host"]), "host", base_failed(), max_rate).filter("rejected")
    # few hosts are rejected; the stored table's size tells the optimizer whether to broadcast it
    bad = stored(bad.select(F.col("host").alias("bad_host")), "hosts")
    full = with_measures(own, "text", [*[f"c{i}" for i in range(len(carried))], "host"])
    judged = full.join(bad, full["host"] == bad["bad_host"], "left").withColumn("base_failed", base_failed())
    return judged.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], *MEASURES, "base_failed",
        (~F.col("base_failed") & F.col("bad_host").isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The documents that the rules and their host's verdict keep, with their own columns only."""
    renamed = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return judge(renamed, at[text], at[host], max_rate=max_rate).filter("kept").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    )
