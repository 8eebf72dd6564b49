"""Tables that operators write between their steps, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Folders that stored() has written and delete() has not deleted.
MADE: list[str] = []
#: The temporary folder of this process, where no session names another.
OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on one machine a temporary folder, on a cluster one beside the warehouse's tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        if not OWN:
            OWN.append(tempfile.mkdtemp(prefix="inkwell-"))
        return OWN[0]
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_inkwell"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """df written as Parquet and read again, so that what follows it starts there, also after executors are lost.

    Its folder stays in MADE: what is returned is read from it, so whoever has written that may delete it.
    """
    MADE.append(f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(MADE[-1])
    return df.sparkSession.read.schema(df.schema).parquet(MADE[-1])


def delete(spark: SparkSession, folders: Iterable[str]) -> None:
    """Deletes folders of MADE that nothing reads any more."""
    for name in list(folders):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        MADE.remove(name)
