"""Tables that are written once and read back, so that what follows neither repeats nor depends on what was before."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Where none is named, a session whose executors are threads of this machine gets a folder of its own, which goes
    when the driver ends; on a cluster a machine-local folder would lose results without an error, so that raises.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        found = sc.getCheckpointDir()
    return found


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_NAMES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialise(df: DataFrame) -> DataFrame:
    """Write df once under the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def materialise_by(df: DataFrame, *keys: str) -> DataFrame:
    """Like materialise(), in buckets by the keys: a join on all of them, in this order, shuffles the other side only."""
    spark = df.sparkSession
    name = f"written_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tables/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    _PATHS[out], _NAMES[out] = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing will read again."""
    for df in tables:
        path, name = _PATHS.pop(df, None), _NAMES.pop(df, None)
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            own = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(own, True)
