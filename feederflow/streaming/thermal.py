"""Transformer temperatures carried through a stream of readings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from feederflow.functions.keys import shared_keys
from feederflow.functions.units import BASE_VA
from feederflow.operators.thermal import with_params
from feederflow.sources.driver import table
from feederflow.sources.tables import shared_path

OUT = "tx_id string, t timestamp, delta_theta_TO double, delta_theta_HS double"


def follow(x: float, ends: np.ndarray, decay: float) -> tuple[float, list[float]]:
    """A rise that goes (1 - decay) of the way to each end in turn: the last one, and all."""
    out = list(accumulate(ends.tolist(), lambda x, end: x + (end - x) * (1 - decay), initial=x))[1:]
    return out[-1], out


class Steps(StatefulProcessor):
    """Applies closed intervals in time order; the two rises are the transformer's state."""

    def __init__(self, p: dict[str, float]):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rises", StructType([StructField("to", DoubleType()), StructField("hs", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = self.p
        to, hs = self.state.get() if self.state.exists() else (0.0, 0.0)
        steps = pd.concat(list(rows)).sort_values("t")
        k2 = (steps["current_a"].to_numpy(float) / p["I_rated"]) ** 2
        ends = (p["delta_theta_TO_R"] * ((k2 * p["R"] + 1) / (p["R"] + 1)) ** p["n"], p["delta_theta_HS_R"] * k2 ** p["m"])
        to, to_all = follow(to, ends[0], math.exp(-p["dt"] / p["tau_TO"]))
        hs, hs_all = follow(hs, ends[1], math.exp(-p["dt"] / p["tau_W"]))
        self.state.update((to, hs))
        yield pd.DataFrame({"tx_id": key[0], "t": steps["t"].to_numpy(), "delta_theta_TO": to_all, "delta_theta_HS": hs_all})

    def close(self) -> None:
        pass


def interval_currents(readings: DataFrame, minutes: int) -> DataFrame:
    """(tx_id, t, current_a): summed kW of each interval, at 1 kV."""
    w = F.window("t", f"{minutes} minutes")
    return readings.groupBy("tx_id", w.alias("w")).agg(F.sum("kw").alias("current_a")).select("tx_id", F.col("w.start").alias("t"), "current_a")


def thermal_stream(readings: DataFrame, params: dict[str, float], watermark: str = "1 hour", minutes: int = 60) -> DataFrame:
    """Streaming (tx_id, t timestamp, kw) readings to temperatures of closed intervals.

    An interval is applied once the watermark has passed its end, since steps cannot be undone; later
    readings of it are dropped. Needs the RocksDB state store provider.
    """
    closed = interval_currents(readings.withWatermark("t", watermark), minutes)
    return closed.groupBy("tx_id").transformWithStateInPandas(statefulProcessor=Steps(params), outputStructType=OUT, outputMode="append", timeMode="None")


INTERVAL_OUT = "n int, tx_id string, t timestamp, current_a double, delta_theta_TO double, delta_theta_HS double"
_TX = ("tau_TO", "tau_W", "delta_theta_TO_R", "delta_theta_HS_R", "R", "n_exp", "m_exp", "I_rated")


class Intervals(StatefulProcessor):
    """Applies a transformer's closed intervals in time order, and those without readings as intervals without load.

    The state holds the two rises, the end of the last interval, and the transformer's parameters. A timer waits for the end of
    the next interval: when the watermark passes it and no readings have come, the transformer cools.
    """

    def __init__(self, minutes: int):
        self.step = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [StructField("to", DoubleType()), StructField("hs", DoubleType()), StructField("end", LongType()), *(StructField(c, DoubleType()) for c in _TX)]
        self.state = handle.getValueState("rises", StructType(fields))

    def _advance(self, key, state: list, ends: list[int], amps: list[float]) -> pd.DataFrame:
        """Interval by interval to each of ``ends``; the state is changed in place."""
        p, rows = dict(zip(_TX, state[3:], strict=True)), []
        keep = [math.exp(-self.step / 60_000 / p[tau]) for tau in ("tau_TO", "tau_W")]
        for end, current in zip(ends, amps, strict=True):
            while state[2] < end:
                state[2] += self.step
                a = current if state[2] == end else 0.0
                k2 = (a / p["I_rated"]) ** 2
                goal = (p["delta_theta_TO_R"] * ((k2 * p["R"] + 1) / (p["R"] + 1)) ** p["n_exp"], p["delta_theta_HS_R"] * k2 ** p["m_exp"])
                state[:2] = [x + (g - x) * (1 - d) for x, g, d in zip(state[:2], goal, keep, strict=True)]
                rows.append((key[0], key[1], pd.Timestamp(state[2] - self.step, unit="ms"), a, state[0], state[1]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in INTERVAL_OUT.split(", ")])

    def _wait(self, state: list) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state[2] + self.step)
        self.state.update(tuple(state))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values("end_ms")
        ends = [int(x) for x in given["end_ms"]]
        state = list(self.state.get()) if self.state.exists() else [0.0, 0.0, ends[0] - self.step, *(float(given[c].iloc[0]) for c in _TX)]
        yield self._advance(key, state, ends, given["current_a"].tolist())
        self._wait(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = list(self.state.get())
        passed = (timerValues.getCurrentWatermarkInMs() - state[2]) // self.step
        ends = [state[2] + (k + 1) * self.step for k in range(max(0, passed))]
        yield self._advance(key, state, ends, [0.0] * len(ends))
        self._wait(state)

    def close(self) -> None:
        pass


def network_thermal_stream(readings: DataFrame, loads: DataFrame, params: DataFrame, watermark: str = "1 hour", minutes: int = 60) -> DataFrame:
    """Streaming readings (t timestamp, load_id, real_power_w, reactive_power_var; n if given) to temperatures of all their transformers.

    ``loads`` says which loads a transformer carries (``network.transformer_loads``), ``params`` has a set for each tx_id, or one.
    A closed interval's current is that of the summed apparent power at nominal voltage. An interval is closed when the watermark has
    passed its end; later readings of it are dropped, and from a transformer's first reading on an interval without readings counts as one
    without load. Readings of unknown loads count for the watermark alone. Needs the RocksDB state store provider.
    """
    on = shared_keys(readings, loads)
    met = readings.withWatermark("t", watermark).join(loads, on)
    w = F.window("t", f"{minutes} minutes")
    closed = met.groupBy("n", "tx_id", "i_base_a", w.alias("w")).agg(F.sum("real_power_w").alias("p"), F.sum("reactive_power_var").alias("q"))
    closed = closed.select("n", "tx_id", F.window_time("w").alias("at"), (F.unix_millis(F.col("w.end"))).alias("end_ms"), (F.sqrt(F.col("p") ** 2 + F.col("q") ** 2) / BASE_VA * F.col("i_base_a")).alias("current_a"))
    given = with_params(closed, params).select(*closed.columns, *[F.col(c).cast("double").alias(c) for c in _TX])
    return given.groupBy("n", "tx_id").transformWithStateInPandas(statefulProcessor=Intervals(minutes), outputStructType=INTERVAL_OUT, outputMode="append", timeMode="EventTime")


def rocks_session(spark):
    """A session of its own over the same context, with the state store provider that these streams need."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        if (v := spark.conf.get(k, None)) is not None:
            own.conf.set(k, v)
    return own


def drained(spark, stream: DataFrame) -> DataFrame:
    """All that a stream over files appends until no file is left, as a table."""
    out = shared_path(spark, "temperatures")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).withColumn("t", F.col("t").cast("timestamp_ntz"))


def run_over_events(spark, sf_dir: str, params: dict[str, float]) -> DataFrame:
    """All events through the stream until none is left, and what it has appended by then."""
    nations = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    events = table(spark, sf_dir, "events").join(nations, F.col("user_id") == F.col("c_custkey"))
    rows = events.select(F.concat(F.lit("T"), "c_nationkey").alias("tx_id"), F.col("ts").cast("timestamp").alias("t"), F.col("value").alias("kw"))
    given = shared_path(spark, "events")
    rows.write.parquet(given)
    own = rocks_session(spark)
    return drained(spark, thermal_stream(own.readStream.schema(rows.schema).parquet(given), params))


def run_over_readings(spark, readings: DataFrame, loads: DataFrame, params: DataFrame) -> DataFrame:
    """Stored readings through the network stream until none is left."""
    rows = readings.withColumn("t", F.col("t").cast("timestamp"))
    given = [shared_path(spark, k) for k in ("readings", "tx-loads", "tx-params")]
    for df, path in zip((rows, loads, params), given, strict=True):
        df.write.parquet(path)
    own = rocks_session(spark)
    static = [own.read.schema(df.schema).parquet(path) for df, path in zip((loads, params), given[1:], strict=True)]
    return drained(spark, network_thermal_stream(own.readStream.schema(rows.schema).parquet(given[0]), *static))
