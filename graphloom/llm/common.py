"""Helpers shared by the operators: hashed splits, sampling, shared tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import shared_dir, ship

#: The white space of the contracts: space, tab, LF, VT, FF, CR (``bytes.split`` splits on the same six).
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def hash_fraction(doc_id: str, seed: int = 0, text: str | None = None) -> Column:
    """A number in [0, 1) that depends on the id and the seed only; of a row without id on its text, where that is named."""
    key = F.col(doc_id).cast("string")
    if text:
        key = F.coalesce(key, F.concat(F.lit("text "), F.xxhash64(text).cast("string")))
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def rate_by(column: str, counts: dict, most: int) -> Column:
    """Sampling rate by the column's value that yields about `most` rows of each value."""
    out = F.lit(0.0)
    for value, n in counts.items():
        out = F.when(F.col(column) == F.lit(value), F.lit(min(1.0, most / max(n, 1)))).otherwise(out)
    return out


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Write the rows to a table in the shared folder and read it: later steps don't recompute, and lost executors cost nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that save() wrote, once nothing reads it any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A column's texts, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a task's memory is bounded by few texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 1024) -> DataFrame:
    """mapInArrow over small batches; make(batch) gives the output's columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    kind = StructType.fromDDL(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(kind)
        for batch in pieces(batches, rows):
            if batch.num_rows:
                got = make(batch)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in shape], schema=shape)

    return df.mapInArrow(run, kind)
