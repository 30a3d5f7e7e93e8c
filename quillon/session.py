"""Session helpers: checkpoint folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as it stands. Only a local
    master without that setting gets a temporary folder; on a cluster a machine-local
    folder would be lost with its executor, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if wanted is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="quillon-checkpoint-")
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir()


def cut(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget how it was made.

    A checkpoint hands the size estimate of its plan on to its readers. A join's estimate
    is the product of its sides, so over the rounds of an iteration the number itself grows
    until planning takes longer than running. The rows are therefore given a new, plain
    plan. ``keep_layout`` keeps how the rows are partitioned as well, so that later joins
    and aggregates on the same keys read them where they lie. An adaptive plan does not tell
    its partitioning, so such a frame is planned without; give it an explicit ``repartition``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        if keep_layout:
            spark.conf.set("spark.sql.adaptive.enabled", "false")
        done = df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    jvm, plan = spark._jsparkSession, done._jdf.logicalPlan()
    if keep_layout:
        none = spark._jvm.scala.Option.empty()
        plain = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, plan.stream(), jvm, none, none)
        out = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(jvm, plain), spark)
    else:
        out = DataFrame(jvm.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)
    written = plan.rdd().getCheckpointFile()
    out._checkpoint_path = written.get() if written.isDefined() else None
    return out


def release(*frames: DataFrame) -> None:
    """Delete the checkpoint files of frames made by ``cut`` that nothing will read again."""
    for df in frames:
        path = getattr(df, "_checkpoint_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is.

    The rows are counted first, so the hint never rests on a guess. Above the bound the
    join is left to the optimiser, which shuffles it and splits skewed partitions.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def parallelism(spark: SparkSession) -> int:
    """Partitions for an explicit exchange: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
