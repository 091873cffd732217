"""The session that tests, benches and scripts share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "flowlens", cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session in UTC with AQE on; a cluster brings its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach: the session's spark.checkpoint.dir.

    Where the setting is absent, a local master gets a temporary folder (tests); a cluster gets an error, as a
    machine's own folder would lose rows there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="flowlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; drop_scratch removes what is there."""
    _SCRATCH.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: a cut of the lineage that outlives executors.

    What is read back has the size of its files as statistics, so Spark broadcasts it in later joins only when it
    has been measured to be under spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written, for plans that read it several times or grow with every round."""
    return written(df, "cut")


def laid_out(df: DataFrame, name: str, key: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df written once, dealt by key into buckets: what joins or groups by the key, or by it and more, isn't laid out again.

    For keys that the caller's work goes by anyhow: all rows of one key are in one bucket. then: what is made of the dealt
    rows by that key before they are written; the key stays. The settings that let joins by more columns keep the
    buckets, and union tables of one layout, stay with the session.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch_path(spark, name)
    named = _table(path)
    dealt = df.repartition(n, key)
    (dealt if then is None else then(dealt)).write.format("parquet").option("path", path).bucketBy(n, key).saveAsTable(named)
    return spark.table(named)


def _table(path: str) -> str:
    """The catalog's name of what is written at path."""
    return "scratch_" + path.rpartition("/")[2].replace("-", "_")


def scratch_count() -> int:
    """How many scratch tables there are: where a call's own ones begin."""
    return len(_SCRATCH)


def drop_scratch(spark: SparkSession, begun: int = 0, keep: str | None = None, until: int | None = None) -> int:
    """Deletes the tables that this process has written to the shared folder, once nothing reads them any more.

    begun, until: only those written since so many, and before so many. keep: tables of that name stay, as a result
    still reads them.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = _SCRATCH[begun:until]
    stay = [p for p in own if keep is not None and p.rpartition("/")[2].rpartition("-")[0] == keep]
    for name in set(own) - set(stay):
        spark.sql(f"drop table if exists {_table(name)}")
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    _SCRATCH[begun:until] = stay
    return len(own) - len(stay)
