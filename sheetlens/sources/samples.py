"""Sample tables to try the library on, generated by seeded Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = ("sales", "marketing", "healthcare")


def _pick(values: str, seed: int) -> Column:
    options = F.array(*[F.lit(v) for v in values.split("|")])
    return F.get(options, F.floor(F.rand(seed) * len(values.split("|"))).cast("int"))


def sample_table(spark: SparkSession, kind: str = "sales", rows: int = 400) -> DataFrame:
    """"sales" (also for unknown names), "marketing" or "healthcare"."""
    base = spark.range(0, rows, 1, 1)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")
    if kind.lower() == "marketing":
        spend = F.round(500 + F.rand(1) * 4000, 2)
        table = base.select(
            F.concat(F.lit("Campaign "), F.col("id")).alias("Campaign"),
            _pick("Search|Social|Email|Display", 2).alias("Channel"),
            spend.alias("Ad Spend"),
        )
        clicks = F.floor(F.col("Ad Spend") * (1 + F.rand(3) * 0.2))
        table = table.withColumn("Clicks", clicks).withColumn("Conversions", F.floor(F.col("Clicks") * 0.1))
        return table.withColumn("Date", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.rand(4) * 365).cast("int")), "yyyy-MM-dd"))
    if kind.lower() == "healthcare":
        stay = F.floor(1 + F.rand(5) * 14)
        return base.select(
            F.format_string("P%05d", "id").alias("Patient ID"),
            F.floor(20 + F.rand(6) * 65).alias("Age"),
            _pick("Male|Female", 7).alias("Gender"),
            day.alias("Admission Date"),
            _pick("Cardiology|Oncology|Orthopedics|Neurology", 8).alias("Department"),
            stay.alias("Hospital Stay Days"),
        ).withColumn("Treatment Cost", F.round(900 * F.col("Hospital Stay Days") + 400 * F.rand(9), 2))
    spend = F.round(10 + F.rand(10) * 150, 2)
    noise = F.when(F.rand(12) > 0.98, 3.0).otherwise(1.0)
    return base.select(
        day.alias("Order Date"),
        _pick("North|South|East|West", 11).alias("Region"),
        _pick("Laptop|Phone|Tablet|Monitor", 13).alias("Product"),
        spend.alias("Advertising Spend"),
    ).withColumn("Sales", F.round((400 + 6 * F.col("Advertising Spend") + 200 * F.rand(14)) * noise, 2))
