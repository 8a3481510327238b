"""Tables written once in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: HotSpot leaves methods of more bytes than this to its interpreter.
COMPILED_BYTES = 8000


def compiled_rows(spark: SparkSession) -> None:
    """Steps over wide rows run compiled.

    Spark puts all columns of a step into one method.  One that is too long for
    HotSpot's compiler is interpreted, some ten times slower; below this limit
    Spark splits it by columns instead.  A lower limit that is set already stays.
    """
    conf, key = spark.conf, "spark.sql.codegen.hugeMethodLimit"
    if int(conf.get(key, "65535")) > COMPILED_BYTES:
        conf.set(key, str(COMPILED_BYTES))


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Steps that are read several times are computed once, and what they took to
    compute stays out of later plans.  Where the setting is unset, a session on
    one machine makes a private folder, and one on a cluster uses its warehouse.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        alone, warehouse = re.match(r"local(\[|$)", spark.sparkContext.master), spark.conf.get("spark.sql.warehouse.dir")
        if not alone and warehouse.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-") if alone else f"{warehouse}/_intermediate"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def is_there(df: DataFrame) -> bool:
    """Is the table that ``durable`` wrote still there?"""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
