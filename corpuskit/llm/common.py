"""Helpers the training-data operators share: safe names, Arrow batches, stored tables, words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuskit.session import checkpoint_folder

SPACE = re.compile(rb"[\x20\x09-\x0D]")


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and back ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back.

    Readers then depend on no executor, and the files give the optimizer true sizes.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def slices(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes, so that little of it is Python objects at a time."""
    step = max(1, batch.num_rows * size // max(size, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_batches(
    df: DataFrame,
    inputs: list[str],
    fn: Callable[[dict[str, list]], dict[str, list]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the columns ``fields`` that ``fn`` makes from lists of ``inputs``, a few megabytes at a time.

    ``keep`` names the columns to carry along (all by default) and they never become Python
    objects. A kept column whose name equals a new one, in any case, gives way to the new one.
    """
    made = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in made]
    names = [*keep, *[c for c in inputs if c not in keep]]
    # plain names on the way through, as not all names can be looked up there
    slim = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    n_keep = len(keep)
    out = T.StructType([*slim.schema.fields[:n_keep], *[T.StructField(f"m{i}", f.dataType) for i, f in enumerate(fields)]])
    arrow = [f.type for f in to_arrow_schema(T.StructType(fields))]
    titles = [f.name for f in fields]
    places = [names.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            got = fn({c: batch.column(i).to_pylist() for c, i in zip(inputs, places, strict=True)})
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(n_keep)],
                    *[pa.array(got[name], type=kind) for name, kind in zip(titles, arrow, strict=True)],
                ],
                names=out.names,
            )

    return slim.mapInArrow(run, out).toDF(*keep, *titles)


def word_blocks(raw: bytes, step: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words between ASCII white space, in lists of bounded size; no word is cut."""
    start = 0
    while start < len(raw):
        end = start + step
        if end < len(raw):
            gap = SPACE.search(raw, end)
            end = gap.start() if gap else len(raw)
        yield raw[start:end].split()
        start = end


def text_key(text: str = "text") -> Column:
    """128 bits of a text's content, so that rows of one id but different texts stay apart."""
    c = quoted(text)
    return F.unhex(F.md5(F.coalesce(c, F.lit("\u0000null"))))
