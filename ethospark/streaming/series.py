"""Frames and events as streams: hopping windows, gap sessions, contact time, warm-up, row-count windows, upserts and retraining."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.labels import upsert


def hopping(df: DataFrame, keys: list[str], time: str, value: str, size: str, slide: str, late: str) -> DataFrame:
    """Mean, max and count of value in windows of event time; rows later than `late` behind the newest are dropped."""
    w = F.window(time, size, slide)
    return df.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.count(value).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "max", "n")


def gap_sessions(df: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Runs of events no more than gap apart: first, last and count. Keyed by start alone, so events have no length here."""
    w = F.session_window(time, gap)
    return df.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n")).drop("w")


def once(df: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def _stateful(df: DataFrame, keys: list[str], state: str, out: str, step: Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]], start: tuple) -> DataFrame:
    """step(state, rows of a key by frame) -> (state, rows out), batch after batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("frame", kind="stable", ignore_index=True)
        now, found = step(held.get if held.exists else start, rows)
        held.update(now)
        yield found

    return df.groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def contact_seconds(df: DataFrame, keys: list[str], on: str, fps: float) -> DataFrame:
    """Rows with contact_s: seconds since the last frame off, carried over batches. Frames of a key must come in order."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        seen, reset = state
        out = []
        for flag in rows[on].tolist():
            if not flag:
                reset = seen
            out.append((seen - reset) / fps if flag else 0.0)
            seen += 1
        return (seen, reset), rows.assign(contact_s=out)

    return _stateful(df, keys, "seen long, reset long", _schema(df) + ", contact_s double", step, (0, 0))


def warm_up(df: DataFrame, keys: list[str], col: str, frames: int) -> DataFrame:
    """Rows with col 0 in the first frames of each key."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        (seen,) = state
        k = max(0, min(len(rows), frames - seen))
        values = rows[col].astype(float).tolist()
        return (seen + len(rows),), rows.assign(**{col: [0.0] * k + values[k:]})

    return _stateful(df, keys, "seen long", _schema(df), step, (0,))


def row_windows(df: DataFrame, keys: list[str], value: str, size: int, stride: int) -> DataFrame:
    """Mean and max of every full window of `size` rows, each `stride` rows; up to size - 1 values a key are held."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        at, held = state[0], list(state[1])
        out, key = [], [rows[k].iat[0] for k in keys]
        held += rows[value].astype(float).tolist()
        while len(held) >= size:
            part = held[:size]
            out.append((*key, at, at + size - 1, sum(part) / size, max(part)))
            held, at = held[stride:], at + stride
        return (at, held), pd.DataFrame(out, columns=[*keys, "start_frame", "end_frame", "mean", "max"])

    kinds = dict(df.dtypes)
    return _stateful(df, keys, "at long, held array<double>", ", ".join(f"{k} {kinds[k]}" for k in keys) + ", start_frame long, end_frame long, mean double, max double", step, (0, []))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def upsert_sink(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last row of each key. Each batch writes a table of its own, so a batch that is run again writes the same."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = None
        if number > 0:
            old = spark.read.parquet(f"{path}/version={number - 1}")
        rows = batch if old is None else upsert(old, batch, key, order)
        if old is None:
            rows = upsert(batch.limit(0), batch, key, order)
        rows.write.mode("overwrite").parquet(f"{path}/version={number}")

    return run


def retrain_sink(fingerprint: Callable[[DataFrame], str], train: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that trains when the labels' fingerprint is another than the last one's."""
    last: list[str] = []

    def run(batch: DataFrame, number: int) -> None:
        mark = fingerprint(batch)
        if last != [mark]:
            last[:] = [mark]
            train(batch)

    return run


def label_fingerprint(df: DataFrame, cols: list[str]) -> str:
    """The same for the same rows in any order."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(*cols, F.lit(1)))).first()
    return ":".join(map(str, r))
