"""Shared plumbing of the training-data operators: work folder, tables, Arrow text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one if the master is local; else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_waymark_llm_work", None)
        if path is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = spark._waymark_llm_work = "file://" + tempfile.mkdtemp(prefix="waymark-llm-")
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the work folder; nothing else writes there."""
    return f"{work_dir(spark)}/waymark-llm/{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Remove the files behind a table of materialize() that nothing will read again."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder by its URI, for Python workers."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


def read_part(folder: str, columns: list[str]) -> list[np.ndarray]:
    """Columns of all Parquet files directly in a shared folder, in a Python worker; empty where there is none."""
    system, root = open_folder(folder)
    found = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [pq.read_table(f, filesystem=system, columns=columns, partitioning=None) for f in sorted(found)]
    whole = pa.concat_tables(tables) if tables else None
    return [np.empty(0) if whole is None else whole.column(c).to_numpy() for c in columns]


def held(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches (slices of 8 MB at most) that hold about `limit` bytes of one column, for work that passes over the same rows repeatedly."""
    out, size = [], 0
    for batch in slices(batches, column):
        out.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_bytes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, body (the UTF-8 bytes of text; null where text is) and the columns named."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("body"), *more)


def slices(batches: Iterator[pa.RecordBatch], column: str = "body", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold about `limit` bytes of one column; a longer value comes alone."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if len(sizes) > start:
            yield batch.slice(start)


def drop_all(spark: SparkSession) -> None:
    """Remove every table that this subpackage has written in this application, once no result reads them any more."""
    drop_folder(spark, own_dir(spark))
