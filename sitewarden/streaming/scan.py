"""The credential scan on a stream of captured resources ``(..., captured_at)``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitewarden.operators import secrets as sec
from sitewarden.sources import sinks

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["target_id", "ord", "rule", "value_masked"]
PLACE = ["place", "place_seq", "place_url"]
FIRST = ["kind_ord", "seq", "url", "pos", "context"]
FOUND = (
    "target_id bigint, type string, value_masked string, location string, context string, severity string, n_values bigint,"
    " captured_at timestamp, version bigint, late boolean"
)
#: Rows of :func:`value_stream`.
VALUE = "target_id bigint, type string, value_masked string, value_hash string, location string, context string, severity string, captured_at timestamp"


def matches_of(resources: DataFrame) -> DataFrame:
    """Match rows as the state needs them: masks and hidden contexts, no raw value."""
    matches = sec.judge(sec.secret_matches(resources), strict=True)
    kind = F.col("kind")
    place = F.when(kind == "css", F.lit(0)).when(kind == "js", F.lit(1)).otherwise(F.lit(2))
    return matches.select(
        "target_id", F.col("ord").cast("int").alias("ord"), "rule", sec.masked().alias("value_masked"), F.sha2("value", 256).alias("value_hash"),
        place.alias("place"), F.col("seq").alias("place_seq"), F.col("url").alias("place_url"), F.col("suppressed_by").isNull().alias("free"),
        sec.kind_order().alias("kind_ord"), "seq", "url", F.col("pos").cast("bigint").alias("pos"),
        sec.shown_context(F.col("context"), F.col("value")).alias("context"), sec.rule_severity(F.col("rule")).alias("severity"),
        F.unix_millis("captured_at").alias("at"),
    )


class Findings(StatefulProcessor):
    """The finding of one (target, type, mask): its first row in scan order, its place, and how many values it has.

    State per value of the mask is one entry of a map in the state store, so a mask with many values is not loaded whole.
    The finding leaves whenever it changes, with a rising version. Rows behind the watermark leave as they are, marked as
    late, and change nothing. A finding that got no row for `keep` milliseconds of event time is forgotten.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState(
            "values", "value_hash string",
            "place int, place_seq long, place_url string, kind_ord int, seq long, url string, pos long, context string, free boolean",
        )
        self.best = handle.getValueState(
            "best",
            "n_values long, value_hash string, kind_ord int, seq long, url string, pos long, context string, location string, first_at long, last_at long, version long, severity string",
        )

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        target, _, rule, mask = key
        passed = timerValues.getCurrentWatermarkInMs()
        state = list(self.best.get()) if self.best.exists() else None
        n, best_hash, best, location, first_at, last_at, version, severity = 0, None, None, None, None, 0, 0, None
        if state:
            n, best_hash, best, location = state[0], state[1], tuple(state[2:7]) if state[1] is not None else None, state[7]
            first_at, last_at, version, severity = state[8:12]
        before, late, any_row = (n, best, location), [], False
        for part in rows:
            for row in part.itertuples(index=False):
                if row.at < passed:
                    late.append(self.shown(target, rule, mask, row.place_url, row.context, row.severity, 0, row.at, 0, True))
                    continue
                any_row, severity = True, row.severity
                last_at = max(last_at, int(row.at))
                place = (int(row.place), int(row.place_seq), row.place_url)
                first = (int(row.kind_ord), int(row.seq), row.url, int(row.pos), row.context) if row.free else None
                known = self.values.getValue((row.value_hash,)) if self.values.containsKey((row.value_hash,)) else None
                if known is not None:
                    place = min(place, tuple(known[:3]))
                    if known[8]:
                        first = tuple(known[3:8]) if first is None else min(first, tuple(known[3:8]))
                n += first is not None and not (known is not None and known[8])
                now = (*place, *(first or (None,) * 5), first is not None)
                if known is None or now != tuple(known):
                    self.values.updateValue((row.value_hash,), now)
                if row.free:
                    first_at = int(row.at) if first_at is None else min(first_at, int(row.at))
                if first is not None and (best is None or first < best or best_hash == row.value_hash):
                    best_hash, best, location = row.value_hash, first, place[2]
        if late:
            yield pd.DataFrame(late)
        if not any_row:
            return
        changed = best is not None and (n, best, location) != before
        version += changed
        self.best.update((n, best_hash, *(best or (None,) * 5), location, first_at, last_at, version, severity))
        self.handle.registerTimer(last_at + self.keep)
        if changed:
            yield pd.DataFrame([self.shown(target, rule, mask, location, best[4], severity, n, first_at, version, False)])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.best.exists() and self.best.get()[9] + self.keep <= expiredTimerInfo.getExpiryTimeInMs():
            self.values.clear()
            self.best.clear()
        return iter([])

    def close(self) -> None:
        pass

    @staticmethod
    def shown(target, rule, mask, location, context, severity, n, at, version, late) -> dict:
        return {
            "target_id": target, "type": rule, "value_masked": mask, "location": location, "context": context, "severity": severity,
            "n_values": n, "captured_at": pd.Timestamp(int(at), unit="ms"), "version": version, "late": late,
        }


def scan_stream(resources: DataFrame, watermark: str, keep: str = "30 days") -> DataFrame:
    """Findings as resources arrive, equal to those of the batch scan once all have arrived in time.

    One row whenever a finding changes; the highest ``version`` of a (target, type, mask) is its present state. Matches of
    resources behind the watermark are rows with ``late``; they change no finding, and nothing is lost without a trace.
    """
    use_state_store(resources.sparkSession)
    # The state operator gets a plain copy of the time as a number, so that late rows reach it instead of vanishing.
    rows = matches_of(resources.withWatermark("captured_at", watermark))
    found = rows.groupBy(*KEY).transformWithStateInPandas(Findings(milliseconds(keep)), FOUND, "Update", "EventTime")
    return found


def milliseconds(interval: str) -> int:
    """Length of an interval of weeks, days, hours, minutes and seconds."""
    units = {"week": 604_800, "day": 86_400, "hour": 3_600, "minute": 60, "second": 1}
    parts = interval.lower().split()
    return sum(int(n) * units[unit.rstrip("s")] for n, unit in zip(parts[::2], parts[1::2], strict=True)) * 1000


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the store that keeps state on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def value_stream(resources: DataFrame, watermark: str) -> DataFrame:
    """One row per value, when it is first seen; append only, so that windows can follow.

    A value that was seen in a target is dropped while the watermark keeps it; the location is the resource that brought it
    first.
    """
    matches = sec.secret_matches(resources)
    rows = sec.to_findings(sec.judge(matches)).select(
        "target_id", "type", "value_masked", "value_hash", F.col("url").alias("location"), "context", "severity", "captured_at"
    )
    return rows.withWatermark("captured_at", watermark).dropDuplicatesWithinWatermark(
        ["target_id", "type", "value_hash"]
    )


def severity_windows(findings: DataFrame, width: str) -> DataFrame:
    """Findings per tumbling window and severity."""
    return (
        findings.groupBy(F.window("captured_at", width), "severity")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "severity", "n")
    )


def drain(findings: DataFrame, folder: str, progress: str) -> None:
    """Process everything that is available into the replayable sink, then stop. ``progress`` lies in shared storage, so
    another driver continues where this one ended."""
    query = (
        findings.writeStream.foreachBatch(sinks.batch_writer(folder))
        .option("checkpointLocation", progress)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def present(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of a drained scan as they stand now: the highest version of each, late rows left out."""
    rows = sinks.read_batches(spark, folder, f"{FOUND}, batch int").filter("NOT late")
    names = [c for c in rows.columns if c not in ("target_id", "type", "value_masked")]
    last = rows.groupBy("target_id", "type", "value_masked").agg(F.max_by(F.struct(*names), F.struct("batch", "version")).alias("r"))
    return last.select("target_id", "type", "value_masked", "r.*")


def late(spark: SparkSession, folder: str) -> DataFrame:
    """Matches that came behind the watermark."""
    return sinks.read_batches(spark, folder, f"{FOUND}, batch int").filter("late")
