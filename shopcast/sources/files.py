"""File sources.

CSV inputs are always read with a declared schema (no inference pass, no type
drift between files); the action log is landed to Parquet partitioned by
category so later reads prune partitions instead of re-filtering.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast import schemas
from shopcast.session import checkpoint_dir


# Action times are text 'yyyy-MM-dd HH:mm:ss' with an optional fraction.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
TIME_WRITE_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _csv(spark: SparkSession, paths, schema, encoding: str | None = None) -> DataFrame:
    r = (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
         .option("timestampNTZFormat", TIME_FORMAT))
    if encoding:
        r = r.option("encoding", encoding)
    return r.csv(list(paths) if isinstance(paths, (list, tuple)) else paths)


def scan_actions(spark: SparkSession, paths) -> DataFrame:
    """The monthly action CSVs read as one DataFrame (a union of files)."""
    return _csv(spark, paths, schemas.ACTION)


def scan_users(spark: SparkSession, path, encoding: str = "GBK") -> DataFrame:
    """User table.  Non-UTF-8 charsets such as GBK need
    ``spark.sql.legacy.javaCharsets=true`` in Spark 4."""
    if encoding and encoding.upper() not in ("UTF-8", "UTF8"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return _csv(spark, path, schemas.USER, encoding)


def scan_products(spark: SparkSession, path) -> DataFrame:
    """S3."""
    return _csv(spark, path, schemas.PRODUCT)


def scan_comments(spark: SparkSession, path) -> DataFrame:
    """S4."""
    return _csv(spark, path, schemas.COMMENT)


def category_slice(actions: DataFrame, cate: int = schemas.TARGET_CATE) -> DataFrame:
    """Keep one category and drop the column."""
    return actions.filter(F.col("cate") == cate).drop("cate")


def land_actions(actions: DataFrame, path: str) -> None:
    """Store the log as Parquet partitioned by category (partition pruning for
    S5 / F2 filters)."""
    actions.write.mode("overwrite").partitionBy("cate").parquet(path)


def manifest(*inputs: DataFrame) -> list[list]:
    """Name, length and modification time of every file that the DataFrames
    read, in order of the names: it changes when a log gains, loses or rewrites
    a file."""
    found = {}
    for df in inputs:
        sc = df.sparkSession.sparkContext
        new_path, conf = sc._jvm.org.apache.hadoop.fs.Path, sc._jsc.hadoopConfiguration()
        folders: dict[str, set[str]] = {}
        for path in map(new_path, df.inputFiles()):
            folders.setdefault(path.getParent().toString(), set()).add(path.getName())
        for folder, names in folders.items():      # one listing a folder
            path = new_path(folder)
            for status in path.getFileSystem(conf).listStatus(path):
                if status.getPath().getName() in names:
                    found[status.getPath().toString()] = [status.getLen(), status.getModificationTime()]
    return [[name, *found[name]] for name in sorted(found)]


def feature_path(spark: SparkSession, family: str, inputs=(), **params) -> str:
    """Storage path of a materialised feature set, keyed by *all* parameters
    and by the files that ``inputs`` read."""
    text = json.dumps([params, manifest(*inputs)], sort_keys=True, default=str)
    key = hashlib.sha256(text.encode()).hexdigest()[:16]
    return f"{checkpoint_dir(spark).rstrip('/')}/features/{family}/{key}"


def materialize(df: DataFrame | Callable[[], DataFrame], family: str, inputs=(), spark: SparkSession | None = None,
                **params) -> DataFrame:
    """Write the feature set once to the shared checkpoint folder and read
    it back (cuts lineage; survives executor loss).  Re-uses an existing
    complete write of the same parameters and the same input files; ``df`` may
    be a function, which is then not called."""
    spark = spark or df.sparkSession
    path = feature_path(spark, family, inputs, **params)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not p.getFileSystem(conf).exists(p):
        (df() if callable(df) else df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back."""
    import uuid
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_candidates(spark: SparkSession, path: str, topi: int = 1000) -> DataFrame:
    """The ``topi`` best rows of a candidate CSV written by
    ``write_user_submission``, by its rank column (a bounded top-k, whatever
    the number and order of the files)."""
    return _csv(spark, path, schemas.CANDIDATES).orderBy("rank").limit(topi).drop("rank")
