"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet and reading it back: the copy survives the loss of an executor,
is computed once, and its size is known to the planner, so small tables are broadcast and large
ones are not.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, TimestampType

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="hopscale-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[app] = "file://" + own
    return _OWN[app]


#: Most bytes of rows that `small` lets Spark broadcast.
SMALL_BYTES = 16 << 20


def n_bytes(df: DataFrame) -> int:
    """Bytes of a table's rows as Spark holds them, counted: 8 for each column, and all of strings, arrays and binaries."""
    long = [c.name for c in df.schema if not isinstance(c.dataType, (NumericType, BooleanType, DateType, TimestampType))]
    width = 16 + 8 * len(df.columns)
    sizes = [F.octet_length(c) if isinstance(df.schema[c].dataType, (StringType, BinaryType)) else F.octet_length(F.to_json(F.struct(c))) for c in long]
    own = reduce(lambda a, b: a + F.coalesce(b.cast("long"), F.lit(0)), sizes, F.lit(width).cast("long"))
    return df.agg(F.sum(own)).first()[0] or 0


def small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """A written table for the small side of a join: marked for broadcast only if its rows are counted to have at most `limit` bytes."""
    return F.broadcast(df) if n_bytes(df) <= limit else df


_MADE: dict[str, list[Scratch]] = {}


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application wrote to the shared folder; results that still read them become invalid."""
    for s in _MADE.pop(spark.sparkContext.applicationId, []):
        s.drop()


class Scratch:
    """Tables of one operator call, in a folder of their own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/hopscale-{uuid.uuid4().hex}"
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back."""
        at = f"{self.path}/{name}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str, free: bool = True) -> None:
        """Delete tables that nothing reads any more (all of them if none is named), and let Spark free old shuffle files."""
        jvm = self.spark._jvm
        for at in [f"{self.path}/{n}" for n in names] or [self.path]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if free:
            self.free()

    def free(self) -> None:
        """Collect garbage on the driver, upon which Spark deletes shuffle files of finished queries."""
        gc.collect()
        self.spark._jvm.System.gc()
