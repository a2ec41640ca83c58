"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def builder(app: str = "sparkweave", cores: str = "*", partitions: int = 8) -> SparkSession.Builder:
    """A local session as the tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that setting is missing, a temporary folder is used in local mode only;
    on a cluster a machine-local folder would be lost with its executor, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.TemporaryDirectory(prefix="sparkweave-")
        atexit.register(folder.cleanup)
        _OWN[app] = folder.name
    return _OWN[app]


#: Rows up to which :func:`written` keeps a table on the driver while its inputs are known to be small; 0: never.
_DRIVER_ROWS: contextvars.ContextVar[int] = contextvars.ContextVar("driver_rows", default=0)
#: Rows of all inputs together below which the graph operators work that way, and rows of a table that is kept so.
SMALL_INPUT, SMALL_TABLE = 500_000, 100_000


@contextlib.contextmanager
def small_input(rows: int):
    """While inside, tables of few rows go through the driver instead of files, if the inputs have fewer than :data:`SMALL_INPUT` rows.

    A file costs a job to write and planning to read, which is most of the time on small graphs. Results are the same.
    """
    token = _DRIVER_ROWS.set(SMALL_TABLE if rows <= SMALL_INPUT else 0)
    try:
        yield
    finally:
        _DRIVER_ROWS.reset(token)


#: Bytes by Spark's estimate up to which a table is broadcast without being asked for, while inputs are not small.
BROADCAST_BYTES = 1 << 20


@contextlib.contextmanager
def few_broadcasts(spark: SparkSession, rows: int):
    """While inside, and unless the inputs have few rows, Spark broadcasts no table beyond :data:`BROADCAST_BYTES` by itself.

    It goes by compressed sizes, and tables of ids are many times larger in memory; every one of them goes through the driver. The session's settings are restored.
    """
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys} if rows > SMALL_INPUT else {}
    try:
        for k, v in before.items():
            if v is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(v) > BROADCAST_BYTES:
                spark.conf.set(k, str(BROADCAST_BYTES))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def inputs_are_small() -> bool:
    """Whether this is inside a :func:`small_input` of few rows."""
    return _DRIVER_ROWS.get() > 0


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts lineage and survives lost executors."""
    spark, most = df.sparkSession, _DRIVER_ROWS.get()
    if most:
        table = df.limit(most + 1).toArrow()
        if table.num_rows <= most:
            return spark.createDataFrame(table, df.schema)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing will read again; while inputs are small, leave it for the end of the session."""
    if _DRIVER_ROWS.get():
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Send at most so many rows at a time to Python: whole texts are large, and a worker holds a batch several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many underscores in front as it takes to be none of the columns (whose case doesn't matter)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
