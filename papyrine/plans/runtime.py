"""What iterative and skewed plans share: lineage cuts on the shared folder and joins that survive hot keys."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than this share of the rows counts as hot; so at most 1 / share keys are hot.
HOT_SHARE = 0.0005
#: A key with fewer rows than this is never hot.
HOT_ROWS = 10_000


@functools.lru_cache(maxsize=1)
def _test_dir() -> str:
    return tempfile.mkdtemp(prefix="papyrine-checkpoints-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir; a folder of our own only in a local session without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = _test_dir()
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder, so that later stages neither recompute it nor depend on executors' disks."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_scan(scan: DataFrame, column: str) -> DataFrame:
    """A scan's rows dealt out evenly where the input has fewer partitions than the cluster has cores and the work on them is
    costly; a larger input stays as it is read."""
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(max(cores * 2, int(spark.conf.get("spark.sql.shuffle.partitions"))), column)


def spread_rows(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt to all cores: few of them mean much work."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def hot_keys(facts: DataFrame, key: str, total: int | None = None) -> list:
    """Keys that hold more than HOT_SHARE of the rows, by a pre-aggregated count: at most 1 / HOT_SHARE of them whatever the
    input. Null is no key."""
    total = facts.count() if total is None else total
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    if total <= least:
        return []
    counts = facts.where(F.col(key).isNotNull()).groupBy(key).count()
    return [r[0] for r in counts.where(F.col("count") > least).select(key).collect()]


def spread_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner", total: int | None = None, hot: list | None = None) -> DataFrame:
    """Join facts to a lookup that is unique on `key` without gathering a hot key's rows in one task.

    The part of the lookup for hot keys is broadcast, which their number bounds; all other keys take an ordinary shuffled join.
    `how` is inner or left; rows with a null key match nothing. `total` is the number of facts and `hot` their hot keys where
    the caller knows them; facts are read twice, so they should come from a checkpoint or scan.
    """
    hot = hot_keys(facts, key, total) if hot is None else hot
    if not hot:
        return facts.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = facts.where(~is_hot).join(lookup.where(~F.col(key).isin(hot)), key, how)
    warm = facts.where(is_hot).join(F.broadcast(lookup.where(F.col(key).isin(hot))), key, how)
    return cold.unionByName(warm)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that Python workers import it whatever their path is."""
    sc = spark.sparkContext
    if getattr(sc, "_papyrine_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="papyrine-package-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._papyrine_shipped = True
