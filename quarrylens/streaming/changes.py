"""Change events: filters, coalescing per file and debounced batches, for streams and for tables alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylens.functions.text import LANGUAGES, extension
from quarrylens.sources.tree import LARGEST, SKIPPED_FOLDERS


def watched(events: DataFrame) -> DataFrame:
    """Events ``(path, change, ts, size, target)`` of source files; a move is a deletion and a creation."""
    moved = F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("change")), F.struct(F.col("target").alias("path"), F.lit("created").alias("change")))
    plain = F.array(F.struct(F.col("path").alias("path"), F.col("change").alias("change")))
    rows = events.withColumn("e", F.explode(F.when(F.col("change") == "moved", moved).otherwise(plain))).select("e.path", "e.change", "ts", "size")
    kept = extension(F.col("path")).isin(sorted(LANGUAGES)) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))
    return rows.where(kept & (F.coalesce("size", F.lit(0)) <= LARGEST))


def debounced(events: DataFrame, gap_ms: int = 500, key: str | None = None) -> DataFrame:
    """``(batch, path, change, ts)`` of a finite table: batches end with a silence of ``gap_ms``; see ``coalesced``.

    ``key`` splits the table into streams of their own (a repository), which keeps the ordered pass bounded; without it
    all events form one stream, as the definition says.
    """
    by = [F.col(key)] if key else [F.lit(0)]
    order = Window.partitionBy(*by).orderBy("ts", "path")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    silence = at - F.lag(at).over(order) >= gap_ms
    rows = events.withColumn("batch", F.sum(F.coalesce(silence, F.lit(True)).cast("int")).over(order))
    return coalesced(rows, [key, "batch"] if key else ["batch"])


def coalesced(rows: DataFrame, batch: list[str]) -> DataFrame:
    """The last change of each path in a batch; a file created and then deleted within it vanishes."""
    out = rows.groupBy(*batch, "path").agg(F.min_by("change", F.struct("ts", "change")).alias("first"), F.max_by("change", F.struct("ts", "change")).alias("change"), F.max("ts").alias("ts"))
    return out.where("not (first = 'created' and change = 'deleted')").drop("first")


def session_batches(stream: DataFrame, gap: str = "500 milliseconds", lateness: str = "1 second") -> DataFrame:
    """``(path, window, changes, ts)`` as a stream: one session per path and silence, with a watermark for late events.

    ``changes`` are the session's changes in order; what they come to is ``last_change``.
    """
    rows = stream.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "path")
    return rows.agg(F.sort_array(F.collect_list(F.struct("ts", "change"))).alias("changes"), F.max("ts").alias("last"))


def last_change(sessions: DataFrame) -> DataFrame:
    first, last = F.col("changes")[0]["change"], F.element_at("changes", -1)["change"]
    return sessions.select("path", F.col("last").alias("ts"), first.alias("first"), last.alias("change")).where("not (first = 'created' and change = 'deleted')").drop("first")


def counted_batches(stream: DataFrame, most: int = 100, gap_ms: int = 500, key: str = "repo") -> DataFrame:
    """``(key, path, change)`` as a stream with state per key: pending changes leave after a silence or at ``most`` of them."""

    def step(group: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending: dict[str, str] = dict(zip(*state.get)) if state.exists else {}
        out: list[tuple[str, str]] = []
        for part in parts:
            for path, change in zip(part.sort_values("ts")["path"], part.sort_values("ts")["change"]):
                if change == "deleted" and pending.get(path) == "created":
                    del pending[path]
                else:
                    pending[path] = change
                if len(pending) >= most:
                    out += pending.items()
                    pending = {}
        if state.hasTimedOut:
            out += pending.items()
            pending = {}
        if pending:
            state.update((list(pending), list(pending.values())))
            state.setTimeoutDuration(gap_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [group[0]] * len(out), "path": [x[0] for x in out], "change": [x[1] for x in out]}, columns=[key, "path", "change"]).astype("object")

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, path string, change string", "paths array<string>, changes array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def apply_batches(changes: DataFrame, update: Callable[[DataFrame, int], None], rebuild: Callable[[int], None], few: int = 20):  # noqa: ANN201
    """A writer that hands micro-batches of fewer than ``few`` files to ``update`` and asks for a rebuild beyond."""

    def each(batch: DataFrame, epoch: int) -> None:
        files = batch.select("path").distinct().limit(few).count()
        if files >= few:
            rebuild(epoch)
        elif files:
            update(batch, epoch)

    return changes.writeStream.foreachBatch(each)
