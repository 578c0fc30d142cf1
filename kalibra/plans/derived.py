"""Files in the calibration formats that Spark writes from the given tables: what the format queries read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import update
from ..sources import cdfx
from .registry import load


def named(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def instance(label: Column, unit: str, values: Column, size: Column | None = None) -> Column:
    sized = named("<SW-ARRAYSIZE><V>", size, "</V></SW-ARRAYSIZE>") if size is not None else F.lit("")
    return named("<SW-INSTANCE><SHORT-NAME>", label, f"</SHORT-NAME><SW-VALUE-CONT><UNIT-DISPLAY-NAME>{unit}</UNIT-DISPLAY-NAME>", sized, "<SW-VALUES-PHYS>", values, "</SW-VALUES-PHYS></SW-VALUE-CONT></SW-INSTANCE>")


def value(number: Column) -> Column:
    return named("<V>", number, "</V>")


def balances(spark: SparkSession, sf_dir: str, times: Column | None = None) -> DataFrame:
    """(file, k, label, text): suppliers' balances with two places, one file a nation."""
    amount = F.col("s_acctbal") * (F.lit(1) if times is None else times)
    return load(spark, sf_dir, "supplier").select(named("n", F.col("s_nationkey")).alias("file"), F.col("s_suppkey").alias("k"), named("S", F.col("s_suppkey"), "_C").alias("label"), F.format_string("%.2f", amount).alias("text"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, k, label, keys): each nation's customers' keys, in order."""
    of = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("keys"))
    return of.select(named("n", F.col("c_nationkey")).alias("file"), F.col("c_nationkey").cast("long").alias("k"), named("N", F.col("c_nationkey"), "_CA").alias("label"), "keys")


def scalar_files(rows: DataFrame) -> DataFrame:
    pieces = rows.select("file", F.struct(F.lit(0), "k").alias("pos"), instance(F.col("label"), "EUR", value(F.col("text"))).alias("fragment"))
    return cdfx.documents(pieces)


def parameter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): parameter sets, one a nation: its suppliers' balances, then its customers' keys as an array."""
    scalars = balances(spark, sf_dir).select("file", F.struct(F.lit(0), "k").alias("pos"), instance(F.col("label"), "EUR", value(F.col("text"))).alias("fragment"))
    body = F.array_join(F.transform("keys", value), "")
    arrays = keys(spark, sf_dir).select("file", F.struct(F.lit(1), "k").alias("pos"), instance(F.col("label"), "key", body, F.size("keys")).alias("fragment"))
    return cdfx.documents(scalars.unionByName(arrays))


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): the same as JSON, an array's places as its axis."""
    scalars = balances(spark, sf_dir).select("file", named('"', F.col("label"), '": {"value": ', F.col("text"), ', "unit": "EUR"}').alias("entry"))
    listed = F.array_join(F.transform("keys", lambda v: v.cast("string")), ", ")
    places = F.array_join(F.transform("keys", lambda v, i: i.cast("string")), ", ")
    arrays = keys(spark, sf_dir).select("file", named('"', F.col("label"), '": {"value": [', listed, '], "unit": "key", "axes": [{"values": [', places, "]}]}").alias("entry"))
    return scalars.unionByName(arrays).groupBy("file").agg(named("{", F.array_join(F.collect_list("entry"), ", "), "}").alias("text"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balances' files updated from files of every third supplier, doubled, and of every next to it, as they are."""
    read = lambda rows: cdfx.instances(scalar_files(rows))
    one, two = balances(spark, sf_dir, F.lit(2)).where("k % 3 = 0"), balances(spark, sf_dir).where("k % 3 = 1")
    return update.updated([("one", read(one)), ("two", read(two))], read(balances(spark, sf_dir)))


def updated_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, source, status, new_value) of ``updates``."""
    return updates(spark, sf_dir).select("label", "source", "status", F.when(F.col("status") == "updated", F.get("texts", F.lit(0)).cast("double")).alias("new_value"))
