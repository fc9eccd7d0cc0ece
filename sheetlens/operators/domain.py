"""Which business domain a table belongs to, by keywords in names and values."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetlens.functions.values import col, field_type
from sheetlens.session import ship_package
from sheetlens.sources.row_ids import data_columns

# Domains in order of preference, with title and keywords.
DOMAINS = (
    (
        "sales",
        "Sales Analytics",
        (
            "sales", "revenue", "order", "product", "price", "customer", "discount", "quantity", "unit", "retail",
            "store", "deal", "cart", "purchased",
        ),
    ),
    (
        "marketing",
        "Marketing Performance",
        (
            "campaign", "clicks", "impressions", "ctr", "conversion", "ad_spend", "spend", "lead", "channel", "cpc",
            "cpa", "roas", "reach", "traffic", "ad",
        ),
    ),
    (
        "healthcare",
        "Healthcare & Clinical Analytics",
        (
            "patient", "diagnosis", "treatment", "hospital", "doctor", "symptom", "admission", "stay", "medical",
            "disease", "readmitted", "dosage", "clinical", "department",
        ),
    ),
    (
        "finance",
        "Financial Analytics",
        (
            "transaction", "amount", "balance", "invoice", "expense", "budget", "account", "credit", "debit",
            "profit", "loss", "cash", "asset", "liability", "tax",
        ),
    ),
    (
        "customer",
        "Customer Analytics",
        (
            "churn", "ltv", "satisfaction", "retention", "nps", "feedback", "support", "ticket", "subscription",
            "tier", "loyalty", "segment", "user",
        ),
    ),
    (
        "education",
        "Education & Academics",
        (
            "student", "marks", "grade", "attendance", "score", "subject", "exam", "gpa", "semester", "course",
            "academic", "pass", "teacher", "class",
        ),
    ),
    (
        "hr",
        "Human Resources",
        (
            "employee", "salary", "department", "attrition", "hire", "manager", "designation", "tenure",
            "compensation", "rating", "leave", "workforce",
        ),
    ),
    (
        "operations",
        "Operations & Logistics",
        (
            "shipment", "warehouse", "supplier", "delivery", "freight", "carrier", "lead_time", "dispatch", "delay",
            "inventory", "stock", "sku", "supply",
        ),
    ),
)
GENERAL = ("general", "General Structured Dataset", 52)


def _find_words(words: list[str]):
    """Arrow batches of lower-cased text columns to the words that their values hold, each once per task.

    The distinct values of a batch go through one automaton of all words; words already seen leave it, so that a common
    word costs no more than a rare one.
    """

    def run(batches):
        left, machine = set(words), None
        for batch in batches:
            if not left:
                continue
            if machine is None:
                machine = ahocorasick.Automaton()
                for w in left:
                    machine.add_word(w, w)
                machine.make_automaton()
            found = set()
            for column in batch.columns:
                # no word holds a line break, so none is found across two values
                found.update(w for _, w in machine.iter("\n".join(v for v in pc.unique(column).to_pylist() if v)))
            if found:
                left, machine = left - found, None
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    return run


def _held_words(df: DataFrame) -> DataFrame:
    """One row: the keywords that any value of any text column holds, case ignored."""
    texts = [c for c in data_columns(df) if isinstance(field_type(df, c), T.StringType)]
    words = sorted({w for _, _, keywords in DOMAINS for w in keywords})
    if not texts:
        return df.sparkSession.range(1).select(F.array().cast("array<string>").alias("held"))
    ship_package(df.sparkSession)
    lowered = df.select(*[F.lower(col(c)).alias(f"t{i}") for i, c in enumerate(texts)])
    return lowered.mapInArrow(_find_words(words), "word string").agg(F.array_sort(F.collect_set("word")).alias("held"))


def domain_scores(df: DataFrame) -> DataFrame:
    """Score per domain: two per keyword in the column names, one per keyword in the values."""
    names = " ".join(data_columns(df)).lower()
    domains = [
        F.struct(
            F.lit(i).alias("domain_order"),
            F.lit(key).alias("domain"),
            F.lit(title).alias("domain_name"),
            F.lit(2 * sum(w in names for w in words)).alias("name_score"),
            F.array(*[F.lit(w) for w in words]).alias("words"),
        )
        for i, (key, title, words) in enumerate(DOMAINS)
    ]
    found = F.size(F.array_intersect("words", "held"))
    return (
        _held_words(df)
        .select("held", F.inline(F.array(*domains)))
        .select("domain_order", "domain", "domain_name", "name_score", found.alias("value_score"))
        .withColumn("score", F.col("name_score") + F.col("value_score"))
    )


def classify_domain(scores: DataFrame) -> DataFrame:
    """The winning domain with its confidence; the earlier one wins a tie."""
    best = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), F.asc("domain_order")))
    s = F.col("score")
    confidence = F.when(s >= 4, F.least(F.lit(96), 75 + 3 * s)).when(s >= 2, 78).when(s >= 1, 62)
    return (
        scores.withColumn("_best", best)
        .where(F.col("_best") == 1)
        .select(
            F.when(s >= 1, F.col("domain")).otherwise(GENERAL[0]).alias("domain"),
            F.when(s >= 1, F.col("domain_name")).otherwise(GENERAL[1]).alias("domain_name"),
            confidence.otherwise(GENERAL[2]).cast("int").alias("confidence"),
            s.cast("bigint").alias("score"),
        )
    )
