"""What the operators share: input columns, Arrow text buffers, written intermediate tables."""

from __future__ import annotations

import atexit
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votelens.session import scratch_path

#: Texts of about so many bytes are handled at once inside a task.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns an operator reads; whatever else the table holds cannot clash with its results."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def text_key(col: str = "text") -> Column:
    """Tells rows with the same doc_id but different texts apart; equal rows get equal results anyway."""
    return F.xxhash64(F.col(col))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``limit`` bytes; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        past = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, past + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and where each row starts (one entry more than rows)."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0]:at[-1]], at - at[0]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read back: later plans see the same rows whatever executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    """Tables behind returned frames live as long as the driver."""
    for spark, path in _WRITTEN:
        try:
            drop(spark, path)
        except Exception:  # the session may have ended
            return


def share(spark: SparkSession, value):
    """Broadcasts a value together with the code of its class; call the result inside a task to get it."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + length)`` over all pairs."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def map_rows(docs: DataFrame, run, fields: str) -> DataFrame:
    """``run`` over Arrow batches of (row, text): the whole row travels as one struct, so its columns clash with nothing.

    The result has the columns row and those of ``fields``, which ``run`` yields in this order; a null text comes as empty."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(fields).fields])

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([row, pc.fill_null(pc.struct_field(row, "text"), "")], names=["row", "text"])

    return rows.mapInArrow(lambda batches: run(with_text(batches)), schema)


def byte_words(texts: pa.Array, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that ``kept`` maps to something other than 0, as mapped: their bytes, offsets and rows."""
    data, at = utf8(texts)
    data = kept[data]
    inside = data > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    opens[first] = inside[first]  # words end where a text ends
    held = data[inside]
    offsets = np.r_[np.flatnonzero(opens[inside]), len(held)]
    return held, offsets, np.searchsorted(at, np.flatnonzero(opens), "right") - 1
