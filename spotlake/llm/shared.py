"""Session helpers shared by the operators: cut lineage, batch sizes, summing of bounded blobs."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python; texts are long, so batches hold few rows.
ARROW_ROWS = 1024


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a master that runs in this very process (as in
    tests) gets a folder of its own, and a cluster its warehouse, which it shares as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spotlake-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/spotlake-work")
    return sc.getCheckpointDir()


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: lineage ends, a lost executor costs no recomputation.

    What was written is deleted when the driver ends; until then results may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/spotlake-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str, k: int):
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(k))


def pack(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype=dtype)


def sum_blobs(df: DataFrame, parts: int, cells: int) -> DataFrame:
    """df(slot int, blob binary): each blob packs `cells` int64; returns one row per slot with the blobs' sum.

    The rows of a slot stream through one task that holds one array per slot it owns, so memory is the number of
    slots times their size, however many blobs arrive; a first round adds up what lies in each incoming partition.
    """

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, blob in zip(b.column("slot").to_pylist(), b.column("blob").to_pylist()):
                got = unpack(blob, np.int64)
                if slot in held:
                    held[slot] += got
                else:
                    held[slot] = got.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pack(v) for v in held.values()], pa.binary())], names=["slot", "blob"])

    schema = "slot int, blob binary"
    return df.mapInArrow(add, schema).repartition(parts, "slot").mapInArrow(add, schema)
