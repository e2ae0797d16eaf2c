"""What follows a changing index: change notices, reindexing before a query, cached vectors, contexts that heal themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.tables import materialize
from symgraph.operators import context
from symgraph.sources import repository


def notices(batch: DataFrame) -> DataFrame:
    """(event, n) of a batch of rows (table, ...): mcp_activity if events came, index_update if files did."""
    event = F.when(F.col("table") == "events", "mcp_activity").when(F.col("table") == "files", "index_update")
    return batch.select(event.alias("event")).where("event is not null").groupBy("event").agg(F.count("*").alias("n"))


def change_feed(changes: DataFrame, send: Callable[[list[tuple[str, int]]], None], checkpoint: str, seconds: float | None = None):
    """Start a query that sends the notices of each batch of changes (table, ...): a few rows. Without seconds it stops when all is read. Of a batch that runs again after a failure the notices are sent again."""

    def batch(rows: DataFrame, _: int) -> None:
        found = [(r.event, r.n) for r in notices(rows).orderBy("event").collect()]  # two rows at most
        if found:
            send(found)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def fresh(indexed: DataFrame, current: DataFrame, reindex: Callable[[DataFrame], DataFrame], limit: int | None = None) -> DataFrame:
    """The index (path, content_hash, ...) after reindexing what is stale or new: reindex turns the changed paths into rows of the index. Gone files lose theirs."""
    state = materialize(repository.changes(indexed, current).where("state <> 'Unchanged'"), "changes")
    if limit:
        state = state.orderBy("path").limit(limit)
    stale = state.where("state in ('Changed', 'Added')").select("path")
    rows = indexed.join(state.select("path"), "path", "left_anti")
    return rows if stale.isEmpty() else rows.unionByName(reindex(stale).select(rows.columns))


class VectorCache:
    """Vectors of a model that stay cached as long as the table has the same number of rows and the same greatest id; one model at a time."""

    def __init__(self):
        self.key: tuple | None = None
        self.rows: DataFrame | None = None

    def get(self, embeddings: DataFrame, model: str) -> DataFrame:
        own = embeddings.where(F.col("model_id") == model)
        state = own.agg(F.count("*"), F.max("symbol_id")).first()  # one row
        key = (model, *state)
        if key != self.key:
            if self.rows is not None:
                self.rows.unpersist()
            self.key, self.rows = key, own.select("symbol_id", "embedding").persist()
        return self.rows


def healed_context(name: str, read: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], is_stale: Callable[[], bool], reindex: Callable[[], None]) -> DataFrame:
    """The context of the symbols of a name; read gives (symbols, edges, relationships). A stale index is rebuilt once, and the
    symbols are looked up by name again, since their ids may have changed."""
    if is_stale():
        reindex()
    symbols, edges, relationships = read()
    return context.symbol_context(symbols.where(F.col("name") == name), symbols, edges, relationships)
