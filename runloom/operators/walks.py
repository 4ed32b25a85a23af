"""One pass over groups of rows: rows are dealt and sorted by group, and a task holds one group at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from runloom.sources.shared import shared_folder

#: Rows of a group that is walked in one task; larger ones are worked on by joins.
LIMIT = 1 << 18
#: Rows of an output batch.
OUT = 50_000


def walked(rows: DataFrame, key: str, f: Callable[[list[tuple]], Iterator[tuple]], schema: str, limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """(:func:`walk` over groups of up to ``limit`` rows, the keys of larger groups or None). Rows of a null key are walked in any case.

    Groups are counted as they are walked, so that what ``rows`` come from is worked out once. What was found is written to
    the shared folder, which is then asked for larger groups.
    """
    spark = rows.sparkSession
    to = f"{shared_folder(spark)}/walked-{uuid.uuid4().hex}"
    walk(rows, key, f, schema, limit).write.parquet(to)
    found = spark.read.schema(f"`{key}` {dict(rows.dtypes)[key]}, {schema}, too_large boolean").parquet(to)
    large = found.where("too_large").select(key)
    return found.where("NOT too_large").drop("too_large"), None if large.isEmpty() else large


def walk(rows: DataFrame, key: str, f: Callable[[list[tuple]], Iterator[tuple]], schema: str, limit: int | None = None) -> DataFrame:
    """``f`` over the rows of each group, without their key; its tuples get the key in front. ``schema`` is theirs, without the key.

    Groups of a null key are one group. Rows come in no order. With a ``limit`` there is a last column ``too_large``: a group of
    more rows isn't held, and one row of nulls says so.
    """
    columns = [key, *[c for c in rows.columns if c != key]]
    whole = f"`{key}` {dict(rows.dtypes)[key]}, {schema}" + (", too_large boolean" if limit is not None else "")
    types = rows.sparkSession.createDataFrame([], whole).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(types)
        held: list[tuple] = []
        out: list[tuple] = []
        current = None
        more, over = () if limit is None else (False,), False

        def close() -> None:
            if over:
                out.append((current, *[None] * (len(made) - 2), True))
            else:
                out.extend((current, *found, *more) for found in f(held))
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), made)], schema=made)
                out.clear()

        for b in batches:
            groups, *columns_ = (c.to_pylist() for c in b.columns)
            for group, row in zip(groups, zip(*columns_)):
                if group != current and (held or over):
                    close()
                    over = False
                    if len(out) > OUT:
                        yield from flush()
                current = group
                if over:
                    continue
                held.append(row)
                if limit is not None and len(held) > limit and group is not None:
                    over = True
                    held.clear()
        if held or over:
            close()
        yield from flush()

    return rows.select(*columns).repartition(key).sortWithinPartitions(key).mapInArrow(run, whole)
