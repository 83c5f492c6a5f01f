"""Early stop of page collection on a stream: the state of a level is the rows of its pages, a timer waits for late ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tierloom import config
from tierloom.operators import collect

RESULT = "film string, level double, page int, n_rows long, n_first long, n_valid long, kept boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long after a level's newest page others may still come.
DELAY = "20 minutes"


def decided(rows: pd.DataFrame, quota: int) -> pd.DataFrame:
    """Pages of one level in order: n_rows, n_first, n_valid, kept; ``rows``: page, pos, review_id, ok."""
    rows = rows.sort_values(["page", "pos"], kind="stable")
    first = rows["review_id"].isna() | (rows["review_id"] == "") | ~rows["review_id"].duplicated()
    marked = rows.assign(n_rows=1, n_first=first.astype(int), n_valid=(first & rows["ok"]).astype(int))
    pages = marked.groupby("page", as_index=False)[["n_rows", "n_first", "n_valid"]].sum()
    before = pages["n_valid"].cumsum() - pages["n_valid"]
    return pages.assign(kept=(before < quota) & (pages["page"] == range(1, len(pages) + 1)))


class EarlyStop(StatefulProcessor):
    """Holds a level's rows (of the pages that may be read at all, so a bounded number) and what was already told.

    A page is told when the watermark has passed the level's newest page; pages that come later still count with all before them.
    """

    def __init__(self, quota: int):
        self.quota = quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "page int, pos int, review_id string, ok boolean")
        self.told = handle.getListState("told", "page int")
        self.newest = handle.getValueState("newest", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else 0
        for batch in rows:
            self.rows.appendList([(int(r.page), int(r.pos), r.review_id, bool(r.ok)) for r in batch.itertuples()])
            newest = max(newest, int(batch["fetched_at"].max().timestamp() * 1000))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.newest.update((newest,))
        self.handle.registerTimer(newest)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = {r[0] for r in self.told.get()} if self.told.exists() else set()
        pages = decided(pd.DataFrame(list(self.rows.get()), columns=["page", "pos", "review_id", "ok"]), self.quota)
        new = pages[~pages["page"].isin(told)]
        self.told.appendList([(int(p),) for p in new["page"]])
        yield new.assign(film=key[0], level=key[1])[["film", "level", "page", "n_rows", "n_first", "n_valid", "kept"]]

    def close(self) -> None:
        pass


def read_pages_of_stream(reviews: DataFrame, quota: int = config.QUOTA_PER_LEVEL, max_pages: int = config.MAX_PAGES, delay: str = DELAY) -> DataFrame:
    """The stream's counterpart of :func:`tierloom.operators.collect.read_pages`: the same rows, in whatever order pages arrive within the delay.

    ``reviews`` is a stream of rows with fetched_at besides what the batch needs. Rows that are later than the delay are left out.
    """
    ok = F.coalesce(collect.passes(config.LENGTH_CASCADE[0]), F.lit(False))
    rows = reviews.filter(F.col("page") <= max_pages).withWatermark("fetched_at", delay)
    slim = rows.select("film", "level", F.col("page").cast("int").alias("page"), F.col("pos").cast("int").alias("pos"), F.col("review_id").cast("string").alias("review_id"), ok.alias("ok"), "fetched_at")
    return slim.groupBy("film", "level").transformWithStateInPandas(EarlyStop(quota), RESULT, "Append", "EventTime")


def use_state_store(spark: SparkSession) -> None:
    """The state store that state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
