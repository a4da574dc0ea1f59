"""Session settings the operators rely on, and reliable lineage cuts."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings only: everything here may be set on a session someone else created.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot event splits its join partition even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A side of a join is measured as it is stored, compressed: what is below Spark's limit of 10 MB may take a hundred in the driver, and one
    # query of a batch sends dozens of sides. At 256 KB only what does not grow with the mail (events, sums by event) is sent whole.
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "256k",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", app: str = "countersign", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster pass the session you already have."""
    cpus = "*" if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Building a plan is much of a short query; do not look up the call site of every column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage: `spark.checkpoint.dir`, or a new temporary one on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the shared folder, so the result outlives lost executors.

    A written table, unlike a checkpointed frame, lets later reads prune columns, carries true
    sizes for join planning, and drops the constraints of the plan that made it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def evaluated_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns that later filters and projections read instead of repeating.

    The optimizer copies a projected expression into every filter above it. For long text
    expressions that repeats the work per row and outgrows code generation; it does not copy
    through a generator, so the values pass through a one-row `inline`.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
