"""What the training-data operators share: reading documents and handing whole texts to Arrow workers."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(value.cast("string"), F.lit("")).cast("binary")


#: Columns that operators on whole documents know by name.
NAMED = ("doc_id", "text", "n_chars")


def keeps_columns(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a function that gives rows of its first argument, with all columns: those that it need not know have plain names
    inside, so that none can clash with its own, whatever they are called."""

    @functools.wraps(fn)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = docs.columns
        plain = [n if n in NAMED and names.index(n) == i else f"c{i}" for i, n in enumerate(names)]
        return fn(docs.toDF(*plain), *args, **kwargs).select(*plain).toDF(*names)

    return run


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow whose function gets at most BATCH_ROWS rows, or about BATCH_BYTES bytes, at a time.

    Spark's own batches are bounded by its settings ``spark.sql.execution.arrow.maxRecordsPerBatch`` and
    ``maxBytesPerBatch`` (``lakelens.session.DEFAULTS``), which are left as they are; what is cut here is what the
    function's arrays grow with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(small_batches(batches))

    return df.mapInArrow(run, schema)


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, min(BATCH_ROWS, int(batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))))
        if batch.num_rows <= rows:
            yield batch
        else:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)


def arrow_type(name: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}[name]


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(field.split()[0], arrow_type(field.split()[1])) for field in schema.split(", ")])


def per_row(fn: Callable, out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function from one that takes a row's column values and returns the tuple of its output values."""
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(*values) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run
