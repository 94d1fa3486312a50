"""Joins of a side that may be hot with one that holds few rows a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it holds more than one in HOT of all rows, so there are fewer than HOT of them; their rows are dealt to SALTS tasks.
HOT = 200
SALTS = 64
#: Rows of a few numbers each that are broadcast.
BROADCAST_ROWS = 10_000
#: Tasks of a join at most.
MOST_TASKS = 20_000


def hot_keys(df: DataFrame, key: str) -> list:
    """The hot keys of df, fewer than HOT. Keys are counted before they are shuffled."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("of"))  # one row
    return [r[0] for r in counts.crossJoin(F.broadcast(total)).filter(F.col("n") * HOT > F.col("of")).select(key).collect()]


def tasks_for(df: DataFrame, work: float, each: float) -> int:
    """In how many tasks a join is to be done: `each` of its work a task, no fewer than Spark's own number of partitions. Partitions by
    their bytes alone would give a join of small sides and many pairs few tasks."""
    return int(min(max(-(-work // each), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS))


def dealt_join(many: DataFrame, few: DataFrame, key: str, spread: str, hot: list, tasks: int | None = None) -> DataFrame:
    """many joined with the rows of `few` of its key. Rows of hot keys are dealt to SALTS tasks by a hash of the column `spread`,
    and the few rows of a hot key go to each of them. tasks: in so many partitions, whatever their bytes."""
    if not hot:
        return (many.repartition(tasks, key) if tasks else many).join(few, key)
    is_hot = F.col(key).isin(hot)
    dealt = many.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int"))
    dealt = dealt.repartition(tasks, key, "_salt") if tasks else dealt
    copies = few.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")
