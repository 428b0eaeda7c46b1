"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Code points that Python's ``str.strip`` removes; Spark's ``trim`` alone keeps most of them.
BLANK = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


#: Bytes from which a table read in too few tasks is worth spreading.
SPREAD_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, as a lazy Parquet scan, spread over the cores if its files are too few."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """A file scan with at least half as many tasks as cores.

    One small file with one row group is one task, whatever the work on its rows. Data of any size has more
    splits than cores and stays as it is: no shuffle is added. Filters and column selections still reach
    the scan.
    """
    execution = scan._jdf.queryExecution()  # planning only: nothing runs
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if int(str(execution.optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES or execution.toRdd().getNumPartitions() * 2 > cores:
        return scan
    return scan.repartition(cores)


def session(app: str = "segmill", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for ``checkpoint()``: the one the session names, a temporary one only where it names none.

    A cluster sets ``spark.checkpoint.dir`` to storage that all executors share. Only when the setting is
    absent (tests, one machine) a temporary folder is made, and removed when the process ends.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="segmill-checkpoint-")
    atexit.register(shutil.rmtree, made, True)
    sc.setCheckpointDir(f"file://{made}")
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint (never a local one: executors can be lost)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(rows: DataFrame, most: int) -> list:
    """The rows of a configuration table; one that isn't small is refused, never cut."""
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"a configuration table has more than {most} rows")
    return held
