"""What the operators of this subpackage share: tables, shared folders and Arrow maps over whole texts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftlake.llm.textbytes import SLICE_BYTES, slices

ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package and keeps Arrow batches of long texts small."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; in local mode a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{Path(tempfile.gettempdir(), 'driftlake-shared').resolve()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: cuts lineage, survives lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow by slices of about `limit` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def with_carried(docs: DataFrame, columns: list, carry: tuple[str, ...]) -> tuple[DataFrame, list[str], str]:
    """docs with the columns that an operator reads first and the carried ones after them as _0, _1, ...; their names and
    types for a schema. Carried columns go through a map as they are, so that no join must bring them back."""
    kinds = dict(docs.dtypes)
    names = [f"_{k}" for k in range(len(carry))]
    picked = docs.select(*columns, *(docs[c].alias(n) for c, n in zip(carry, names)))
    return picked, names, "".join(f", {n} {kinds[c]}" for c, n in zip(carry, names))


def carried(df: DataFrame, carry: tuple[str, ...], drop: tuple[str, ...] = ()) -> DataFrame:
    """The result of a map with its carried columns under their own names, in place of the operator's columns of those names."""
    own = [c for c in df.columns if not c.startswith("_") and c not in drop and c not in carry]
    return df.select(*own, *(df[f"_{k}"].alias(c) for k, c in enumerate(carry)))
