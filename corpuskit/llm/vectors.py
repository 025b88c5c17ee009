"""Near-duplicate embeddings: exact cosine links within a label from int8 tile products with error bounds.

Equal vectors of a label are one node with a count. A label's nodes are numbered and cut into tiles; every
two tiles of a label meet in one task, which holds nothing else. There each vector v of length one is
rounded to s*q, with q in -127..127, and the length e of v - s*q is computed. For two vectors

    |v.w - s*t*(q.r)| <= |s*q| * |w - t*r| + |v - s*q| * |w| <= (1 + e) * f + e

so a pair whose quantised product is further than that below the threshold cannot reach it; only the rest
is computed again in double precision. The integer products run as float32 matrix products of at most
1 024 dimensions, in which all sums are whole numbers below 2^24 and therefore exact.

A task returns one row per linked node (how many vectors it is linked to, and the first node its links
reach within the two tiles), never the pairs. The tile products themselves grow with the square of a
label, as every pair of its vectors is compared; a label of any size is spread over (n / tile)^2 / 2 tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm.common import quoted, stored
from corpuskit.llm.merkle import numbered
from corpuskit.llm.simhash import components
from corpuskit.operators.ordered import keep_parallel

THRESHOLD = 0.98
#: vectors of a tile, and numbers of a tile where vectors are long
TILE = 2048
NUMBERS = 1 << 21
#: rows of a product at a time, and dimensions for which float32 sums of int8 products are exact
STRIP = 512
EXACT = (1 << 24) // (127 * 127)
CHECKED = 1 << 15
#: more than rounding in the products can amount to
SLACK = 1e-5


def _prepared(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, str]:
    """(vec_id, label, dim, key, raw): the numbers as bytes; dim is null for vectors that link with nothing."""
    kind = vectors.select(quoted(embedding)).schema[0].dataType.elementType
    code, short = ("<f4", "array<float>") if isinstance(kind, T.FloatType) else ("<f8", "array<double>")
    slim = vectors.select(
        quoted(vec_id).alias("vec_id"), quoted(label).alias("label"), quoted(embedding).cast(short).alias("embedding")
    )
    out = T.StructType([
        slim.schema["vec_id"], slim.schema["label"], T.StructField("dim", T.IntegerType()),
        T.StructField("key", T.BinaryType()), T.StructField("raw", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            # nulls among the numbers become NaN
            numbers = lists.values.to_numpy(zero_copy_only=False).astype(code, copy=False)
            ends = lists.offsets.to_numpy()
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            dims, keys, raws = [], [], []
            for i in range(batch.num_rows):
                row = numbers[ends[i]:ends[i + 1]] + 0.0 if there[i] else numbers[:0]  # + 0.0: no negative zero
                good = len(row) > 0 and bool(np.isfinite(row).all()) and bool(row.any())
                raw = row.astype(code).tobytes() if good else None
                dims.append(len(row) if good else None)
                raws.append(raw)
                keys.append(hashlib.md5(raw).digest() if good else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()),
                pa.array(raws, pa.binary()),
            ], names=out.names)

    return slim.mapInArrow(run, out), code


def scaled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows as doubles, their lengths); powers of two are taken out so that nothing overflows."""
    x = rows.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def quantised(x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale per row, bound of the length of what rounding took away)."""
    unit = x / length[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - q * scale[:, None]
    return q, scale, np.sqrt(np.einsum("ij,ij->i", rest, rest)) + 1e-12


def products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """All integer products of int8 rows, exact."""
    total = np.zeros((len(q), len(r)), np.float64 if q.shape[1] > EXACT else np.float32)
    for at in range(0, q.shape[1], EXACT):
        total += q[:, at:at + EXACT].astype(np.float32) @ r[:, at:at + EXACT].astype(np.float32).T
    return total


def near_pairs(rows: np.ndarray, split: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (i, j), i < j, whose cosine is ``least`` or more.

    ``split`` 0 compares all rows with each other, otherwise those before it with those from it on.
    """
    x, length = scaled(rows)
    q, scale, rest = quantised(x, length)
    first, start = (split, split) if split else (len(rows), 0)
    for at in range(0, first, STRIP):
        one = slice(at, min(at + STRIP, first))
        two = slice(start if split else at, len(rows))
        likely = products(q[one], q[two]) * scale[one, None] * scale[None, two]
        likely += (1 + rest[one, None]) * (1 + rest[None, two])
        u, v = np.nonzero(likely >= least + 1 - SLACK)
        u, v = u + one.start, v + two.start
        u, v = u[u < v], v[u < v]
        for cut in range(0, len(u), CHECKED):
            a, b = u[cut:cut + CHECKED], v[cut:cut + CHECKED]
            cosine = np.einsum("ij,ij->i", x[a], x[b]) / (length[a] * length[b])
            yield a[cosine >= least], b[cosine >= least]


def join_up(lab: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``lab`` (the least node each node reaches) after the links ``u``-``v`` are added."""
    while True:
        a, b = lab[u], lab[v]
        apart = a != b
        if not apart.any():
            return lab
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up


def _links(nodes: DataFrame, code: str, least: float) -> DataFrame:
    """(row, links, root) per node and pair of tiles in which it has links."""
    tiles = F.ceil(F.col("total") / F.col("size")).cast("int")
    placed = nodes.withColumn(
        "size", F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(NUMBERS) / F.col("grp.dim"))))
    ).withColumn("tile", F.floor(F.col("pos") / F.col("size")).cast("int"))
    dealt = placed.select("grp", "tile", "row", "n", "raw", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")).select(
        "grp", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "row", "n", "raw"
    )
    out = pa.schema([("row", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tile = table["tile"].to_numpy()
        ids = table["row"].to_numpy()
        order = np.lexsort((ids, tile))
        ids, n = ids[order], table["n"].to_numpy()[order]
        rows = np.frombuffer(b"".join(table["raw"].take(pa.array(order)).to_pylist()), code).reshape(len(ids), -1)
        split = int((tile == key[1].as_py()).sum()) if key[1] != key[2] else 0
        links, lab = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for u, v in near_pairs(rows, split, least):
            np.add.at(links, u, n[v])
            np.add.at(links, v, n[u])
            lab = join_up(lab, u, v)
        some = links > 0
        return pa.table([ids[some], links[some], ids[lab[some]]], schema=out)

    dealt = keep_parallel(dealt, "grp", "a", "b")
    return dealt.groupBy("grp", "a", "b").applyInArrow(meet, "row long, links long, root long")


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    least: float = THRESHOLD,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are linked if they have one label (not null), one length and a cosine of ``least`` or more.
    Vectors that are null, empty, zero or hold a null or a number that is not finite link with nothing.
    ``n_links`` counts other rows, repeated ids included; ``component_id`` is the smallest id reachable,
    null if none has one; ``kept`` is whether it is the row's own id (false for a null id). No rows give
    none; other columns are ignored.
    """
    prepared, code = _prepared(vectors, vec_id, embedding, label)
    fit = F.col("dim").isNotNull() & F.col("label").isNotNull()
    named = prepared.withColumn("grp", F.when(fit, F.struct("label", "dim")))
    nodes = named.filter(fit).groupBy("grp", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.first("raw").alias("raw")
    )
    nodes = numbered(nodes, "grp", ["key"])
    found = stored(_links(nodes, code, least), "vector_links")
    roots = components(found.select("row", "root"), "row", "root")
    links = found.groupBy(F.col("row").alias("at")).agg(F.sum("links").alias("links"))
    rooted = nodes.select("grp", "key", "n", "first_id", "row").join(
        links, F.col("row") == F.col("at"), "left"
    ).join(roots, F.col("row") == F.col("u"), "left").select(
        "grp", "key", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("v", "row").alias("root"),
    )
    least_id = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(least_id, "root").select("grp", "key", "n_links", "component_id")
    # rows of one vector may be many: the optimizer splits them where the other side is not small
    out = named.select("vec_id", "grp", "key").join(labels, ["grp", "key"], "left")
    # without a node a vector is a component of its own
    component = F.when(F.col("grp").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("vec_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
