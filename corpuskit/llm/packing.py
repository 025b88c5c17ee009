"""Token ids packed into rows of one length, without losing a token.

Documents become token ids; one longer than a row is split into full rows and a rest. The pieces
of a shard are placed best-fit-decreasing: the longest first, each into the fullest row that still
has room. A segment tree over capacities (1 .. row length), whose nodes count the open rows below
them, finds the smallest sufficient capacity in logarithmic time.

A shard is a bounded number of tokens inside one partition, so memory does not grow with the data
and a lost task packs its own shards again in the same way.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuskit.llm.common import quoted, slices

LENGTH = 2048
SHARD = 1 << 21


@lru_cache(maxsize=2)
def encoding(path: str | None, pattern: str | None = None) -> tiktoken.Encoding:
    """The tokenizer of a ranks file (by default the public byte-level vocabulary)."""
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Capacities:
    """Segment tree over capacities: how many open rows have room for exactly 0 .. ``most`` tokens."""

    def __init__(self, most: int):
        self.half = 1 << most.bit_length()
        self.count = [0] * (2 * self.half)

    def add(self, capacity: int, by: int) -> None:
        at = capacity + self.half
        while at:
            self.count[at] += by
            at >>= 1

    def at_least(self, need: int) -> int | None:
        """The smallest capacity >= ``need`` that some row has."""
        at = need + self.half
        if self.count[at]:
            return need
        # up to the first right neighbour with a row below it, then down its left-most path
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.half:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.half
            at >>= 1
        return None


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Numbers of the pieces in each row; sizes are 1 .. length."""
    tree = Capacities(length)
    rows: list[list[int]] = []
    having: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.at_least(sizes[i])
        if room is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row = having[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        left = room - sizes[i]
        if left:
            having.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


def pieces_of(n: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of ``n`` tokens."""
    return [(at, min(length, n - at)) for at in range(0, n, length)]


def pack_shard(docs: list[tuple[object, np.ndarray]], length: int, pad: int) -> Iterator[dict]:
    """Packed rows of some documents' ids."""
    pieces = [(d, start, size) for d, (_, ids) in enumerate(docs) for start, size in pieces_of(len(ids), length)]
    for row in best_fit([p[2] for p in pieces], length):
        ids = np.full(length, pad, np.uint32)
        positions = np.zeros(length, np.uint32)
        ends = [0]
        parts = []
        for i in row:
            d, start, size = pieces[i]
            at = ends[-1]
            ids[at:at + size] = docs[d][1][start:start + size]
            positions[at:at + size] = np.arange(size)
            ends.append(at + size)
            parts.append({"doc_id": docs[d][0], "start": start, "size": size, "n_tokens": len(docs[d][1])})
        yield {"ids": ids, "positions": positions, "cu_seqlens": ends, "parts": parts, "n_tokens": ends[-1]}


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = 50256,
         shard_tokens: int = SHARD, path: str | None = None, width: int = 2) -> DataFrame:
    """Rows of ``length`` token ids as little-endian unsigned integers of ``width`` bytes.

    ``ids`` and ``positions`` are rows of matrices: ids padded with ``end_id``; positions begin
    at 0 for each piece. ``cu_seqlens`` has 0 and the running ends of the pieces, ``parts`` says for
    each piece its document, the first token's place in the document, its size, and how many tokens
    the document has in all. Each document ends in ``end_id``, so a null or empty text is one
    token. Ids may be null or repeat; other columns are ignored; no rows give none.
    """
    if end_id >= 1 << 8 * width:
        raise ValueError("width is too small for the ids")
    slim = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    part = T.StructType([
        T.StructField("doc_id", slim.schema["doc_id"].dataType), T.StructField("start", T.LongType()),
        T.StructField("size", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
    ])
    schema = T.StructType([
        T.StructField("ids", T.BinaryType()), T.StructField("positions", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("parts", T.ArrayType(part)),
        T.StructField("n_tokens", T.IntegerType()),
    ])
    arrow = to_arrow_schema(schema)
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary

        def flush(shard):
            rows = [
                r | {"ids": r["ids"].astype(kind).tobytes(), "positions": r["positions"].astype(kind).tobytes()}
                for r in pack_shard(shard, length, end_id)
            ]
            for at in range(0, len(rows), 512):
                yield pa.RecordBatch.from_pylist(rows[at:at + 512], schema=arrow)

        shard, held = [], 0
        for batch in (part for whole in batches for part in slices(whole)):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(t or ""), end_id], np.uint32)
                shard.append((i, ids))
                held += len(ids)
                if held >= shard_tokens:
                    yield from flush(shard)
                    shard, held = [], 0
        yield from flush(shard)

    return slim.mapInArrow(run, schema)


def write_matrices(packed: DataFrame, folder: str) -> None:
    """The packed rows as Parquet in ``folder``: each file is a matrix, one row per record."""
    packed.write.mode("errorifexists").parquet(folder)


def unpack(packed: DataFrame, length_bytes: int = 2) -> DataFrame:
    """The pieces again: doc_id, start, n_tokens of the document, and the piece's ids as integers."""
    schema = T.StructType([
        packed.schema["parts"].dataType.elementType["doc_id"], T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = []
            for ids, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row, at = np.frombuffer(ids, f"<u{length_bytes}"), 0
                for p in parts:
                    out.append({
                        "doc_id": p["doc_id"], "start": p["start"], "n_tokens": p["n_tokens"],
                        "ids": row[at:at + p["size"]].tolist(),
                    })
                    at += p["size"]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return packed.select("ids", "parts").mapInArrow(run, schema)
