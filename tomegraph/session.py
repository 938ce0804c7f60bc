"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Largest side, in bytes as measured, that an operator broadcasts.
BROADCAST_BYTES = 32 << 20


def session(app: str = "tomegraph", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage; a temporary one only on a local master without any."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tomegraph-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


_KNOWN_ROOTS: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes when the driver ends."""
    import atexit

    root = f"{checkpoint_root(spark)}/steps-{spark.sparkContext.applicationId}"
    if root not in _KNOWN_ROOTS:
        _KNOWN_ROOTS.add(root)
        atexit.register(remove, root)
    return root


def remove(path: str) -> None:
    """Delete a table or folder, if the driver's JVM is still there."""
    import contextlib

    from pyspark import SparkContext

    with contextlib.suppress(Exception):
        jvm = SparkContext._gateway.jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


class Levels:
    """A table that grows level by level in one folder, so that its plan stays one scan."""

    def __init__(self, spark: SparkSession, first):
        import uuid

        self.spark, self.schema, self.n = spark, first.schema, 0
        self.path = f"{scratch_root(spark)}/levels-{uuid.uuid4().hex}"
        self.add(first)

    def add(self, rows) -> bool:
        """Write the next level; whether it has rows."""
        rows.select(self.schema.names).write.parquet(f"{self.path}/level-{self.n}")
        self.n += 1
        return not self.last.isEmpty()

    @property
    def last(self):
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/level-{self.n - 1}")

    @property
    def all(self):
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/level-{i}" for i in range(self.n)))


def spread(df):
    """df's rows dealt evenly over tasks: a small file is read by one task, however much work its rows make."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def materialise(df, label: str = "step"):
    """Write df to the shared folder and read it back."""
    import uuid

    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
