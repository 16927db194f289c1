"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of texts or files that a Python function takes at a time.
PIECE = 1 << 20


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over as many tasks as a shuffle has. A file may be one row group and so one task; what costs
    far more than a shuffle of its rows should not depend on that."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pieces(batches, size: int = PIECE):
    """Arrow batches cut, between rows, where their last column has ``size`` bytes."""
    for batch in batches:
        start = held = 0
        for k, n in enumerate(pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()):
            if held and held + (n or 0) > size:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quire-shared-"))  # one machine
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, so a lost executor costs
    no recomputation of what stands above. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)
