"""Readers of all input kinds, and writers of networks and results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONS = "array<struct<node: string>>"
#: The union of all component bodies. z is nested for transformers and flat for lines, hence text.
BODY = (
    f"struct<v_setpoint: double, cons: {CONS}, v_base: double, user_data: struct<v_min: double, v_max: double>, length: double, "
    "z: string, z0: array<double>, i_max: double, s_max: double, nom_turns_ratio: array<double>, taps: array<double>, tap_factor: double, "
    "tap_side: string, vector_group: array<string>, v_winding_base: array<double>>"
)
UNITS = "struct<voltage: double, current: double, power: double, impedance: double>"
DOCUMENT = f"struct<units: {UNITS}, components: map<string, map<string, {BODY}>>>"
TX_PARAMS = "tau_TO double, tau_W double, delta_theta_TO_R double, delta_theta_HS_R double, R double, n double, m double, I_rated double, theta_HS_max double, dt double"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components_of(documents: DataFrame) -> DataFrame:
    """(n, doc) network documents as JSON to (n, cid, ctype, body, units) component rows; see ``unreadable`` for those that do not parse."""
    parsed = documents.select("n", F.from_json("doc", DOCUMENT).alias("d"))
    each = parsed.select("n", "d.units", F.explode("d.components").alias("cid", "kinds"))
    return each.select("n", "cid", F.explode("kinds").alias("ctype", "body"), "units")


def unreadable(documents: DataFrame) -> DataFrame:
    """(n, rule, cid, detail) of documents and components that give no or damaged rows, as ``network_quality`` reports failed rules.

    ``not_json``: the text is null or no JSON document; ``no_components``: it has none; ``bad_value``: a component has a value
    of another type than its kind should, which reads as null.
    """
    told = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    whole = documents.select("n", "doc", F.from_json("doc", "struct<components: map<string, string>, _corrupt: string>", told).alias("d"))
    rule = F.when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), "not_json").when(F.coalesce(F.size("d.components"), F.lit(0)) < 1, "no_components")
    lost = whole.select("n", rule.alias("rule"), F.lit("").alias("cid"), F.substr(F.coalesce("doc", F.lit("")), F.lit(1), F.lit(80)).alias("detail")).where("rule is not null")
    each = whole.where("d is not null and d._corrupt is null").select("n", F.explode("d.components").alias("cid", "text"))
    loose = F.from_json("text", "map<string, string>")
    kinds = each.select("n", "cid", F.explode(loose).alias("ctype", "body")).withColumn("d", F.from_json("body", BODY.removesuffix(">") + ", _corrupt: string>", told))
    bad = kinds.where("d is null or d._corrupt is not null").select("n", F.lit("bad_value").alias("rule"), "cid", F.col("ctype").alias("detail"))
    none = each.where(F.coalesce(F.size(loose), F.lit(0)) < 1).select("n", F.lit("bad_value").alias("rule"), "cid", F.lit("").alias("detail"))
    return lost.unionByName(bad).unionByName(none)


def net_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(n, doc): network document files, named by their path."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("n"), F.col("value").alias("doc"))


def net_components(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Network document files, one network each, named by their path."""
    return components_of(net_documents(spark, paths))


def network_documents(components: DataFrame) -> DataFrame:
    """(n, doc): component rows as one JSON document for each network."""
    entry = F.struct("cid", F.create_map("ctype", "body"))
    by_net = components.groupBy("n").agg(F.first("units").alias("units"), F.map_from_entries(F.collect_list(entry)).alias("components"))
    return by_net.select("n", F.to_json(F.struct("units", "components")).alias("doc"))


def write_network(components: DataFrame, roster: DataFrame, path: str) -> None:
    """Networks with their Load components replaced by the roster's (n, load_id, bus_id)."""
    loads = roster.select("n", F.col("load_id").alias("cid"), F.lit("Load").alias("ctype"), F.from_json(F.to_json(F.struct(F.array(F.struct(F.col("bus_id").alias("node"))).alias("cons"))), BODY).alias("body"))
    units = components.groupBy("n").agg(F.first("units").alias("units"))
    kept = components.where("ctype <> 'Load'").unionByName(loads.join(units, "n"))
    network_documents(kept).select("doc").write.text(path)


#: Columns of the text files, in order.
FORECAST = "load_id string, real_power_w double, reactive_power_var double"
OFFERS = "load_id string, injection string, consumption string, reservation_l double, reservation_u double"
FORECAST_TS = "timestamp string, load_id string, real_power_w double, reactive_power_var double"
AMBIENT = "t timestamp_ntz, theta_a double"
PRICES = "load_id string, export_price_kwh double"


def damaged_rows(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Rows of a text file with a value that its column's type cannot hold, or too few or many: the readers read such values as null.

    ``_corrupt`` has the row's text.
    """
    given = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", **options}
    return spark.read.options(**given).schema(f"{schema}, _corrupt string").csv(path).where("_corrupt is not null")


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=FORECAST)


def read_offers(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, escape='"', schema=OFFERS)
    return raw.withColumns({c: F.from_json(c, "array<array<double>>") for c in ("injection", "consumption")})


def timestamp_of(text, anchor_date: str | None):
    """A timestamp text, or a time of day on the anchor date."""
    whole = F.try_to_timestamp(text).cast("timestamp_ntz")
    if anchor_date is None:
        return whole
    clock = F.try_to_timestamp(F.concat(F.lit(anchor_date + " "), text)).cast("timestamp_ntz")
    return F.when(text.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), clock).otherwise(whole)


def read_forecast_ts(spark: SparkSession, path: str, anchor_date: str | None = None) -> DataFrame:
    raw = spark.read.csv(path, header=True, schema=FORECAST_TS)
    return raw.select(timestamp_of(F.col("timestamp"), anchor_date).alias("t"), "load_id", "real_power_w", "reactive_power_var")


def read_tx_params(spark: SparkSession, path: str) -> DataFrame:
    """Sets of parameters, a JSON document each; documents in folders ``tx_id=...`` have that column."""
    return spark.read.json(path, multiLine=True, schema=TX_PARAMS)


def read_wide_meter(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated meter file: ids and suffixes as text, the day as a date, the intervals as numbers."""
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.select(*[F.col(f"`{c}`").cast("date" if c == "IntervalDay" else "double" if c.startswith("Data_") else "string").alias(c) for c in raw.columns])


def read_tx_series(spark: SparkSession, path: str, measured: bool = True) -> DataFrame:
    """A transformer's series: padded headers, day-first dates with or without seconds."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*[c.strip().lstrip("﻿") for c in raw.columns])
    kinds = ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "yyyy-MM-dd HH:mm:ss")
    t = F.coalesce(*[F.try_to_timestamp(F.trim("date"), F.lit(k)) for k in kinds]).cast("timestamp_ntz")
    return raw.select(t.alias("t"), F.col("`METER_SUMMATION (kW)`" if measured else "`ESTIMATION (kW)`").cast("double").alias("total_kw"))


def read_ambient(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=AMBIENT)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=PRICES)


def write_results(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Each result table in its own folder, by network and day where it has them.

    A run replaces the networks and days that it holds rows of, and leaves all others: steps can be run again one by one.
    A table without both is replaced whole.
    """
    for name, df in tables.items():
        by = [c for c in ("n",) if c in df.columns]
        if "t" in df.columns:
            df, by = df.withColumn("day", F.to_date("t")), [*by, "day"]
        out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
        out.format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(f"{path}/{name}")
