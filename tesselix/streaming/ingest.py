"""Extensions: points that arrive as a stream go into a stored tree, or are appended and laid out anew now and then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselix.plans.layout import write_clustered
from tesselix.plans.tree import Store, Tree, build


def ingest(stream: DataFrame, path: str, checkpoint: str, clustered: str | None = None, every: int = 10):
    """Starts a query that appends each batch of points to `path` (a batch that is run again replaces its own folder, so
    none is stored twice) and, after every so many batches, writes all points clustered to `clustered` anew, which must not be read meanwhile;
    a stored tree (ingest_tree) keeps its versions instead."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if clustered and number % every == every - 1:
            write_clustered(df.sparkSession.read.parquet(path).drop("batch"), clustered)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def insert_batch(spark: SparkSession, path: str, df: DataFrame, number: int, **how) -> Tree:
    """A batch of points into the tree at path (made by the first one, with `how`). The tree keeps the last batch's number with its
    version, so a batch that is run again changes nothing."""
    try:
        tree = Tree(spark, path)
    except ValueError:
        return build(df, path, batch=number, **how)
    return tree.insert(df, number)


def _waiting(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The number of the last batch in the tree at path (-1: none), and the folders of the batches after it that wait beside it."""
    store = Store(spark, path)
    newest, at = store.newest(), store._at("waiting")
    last = store.meta(newest)["batch"] if newest else -1
    found = {int(f.getPath().getName()): f"{store.path}/waiting/{f.getPath().getName()}" for f in store.fs.listStatus(at)} if store.fs.exists(at) else {}
    return last, {n: folder for n, folder in sorted(found.items()) if n > last}


def gather_batch(spark: SparkSession, path: str, df: DataFrame, number: int, share: float, **how) -> None:
    """A batch of points waits beside the tree at path until those that wait are more than `share` of the tree's; then they go in together,
    as the last one's number. So a tree that grows by small batches is written a number of times that grows with the logarithm of its
    points, and each batch costs its own points. A batch that is run again replaces its folder, or is in the tree already."""
    if number <= _waiting(spark, path)[0]:
        return
    df.write.mode("overwrite").parquet(f"{path}/waiting/{number}")
    waiting = list(_waiting(spark, path)[1].values())
    newest = Store(spark, path).newest()
    if spark.read.schema(df.schema).parquet(*waiting).count() > share * (Store(spark, path).meta(newest)["points"] if newest else 0):
        settle(spark, path, **how)


def settle(spark: SparkSession, path: str, **how) -> None:
    """Puts the batches that wait beside the tree at path into it, and removes what waits no longer."""
    store, waiting = Store(spark, path), _waiting(spark, path)[1]
    if waiting:
        insert_batch(spark, path, spark.read.parquet(*waiting.values()), max(waiting), **how)
    store.fs.delete(store._at("waiting"), True)


def ingest_tree(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False, share: float = 0.0, **how):
    """Starts a query that puts each batch of points (ids not yet there) into the stored tree at path; with a share, gathers
    batches (gather_batch), and once the stream has ended settle() puts in those that still wait."""

    def batch(df: DataFrame, number: int) -> None:
        if share:
            gather_batch(df.sparkSession, path, df, number, share, **how)
        else:
            insert_batch(df.sparkSession, path, df, number, **how)

    writer = stream.writeStream.foreachBatch(batch)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.option("checkpointLocation", checkpoint).start()
