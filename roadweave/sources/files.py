"""JSON files in and out: label records, manifests, envelope corpora, budget policies, and fingerprinted reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Caps of the 64-seed budget where no policy file is given.
BUDGET = {"total_seconds": 960.0, "p90_seconds": 18.0, "max_seconds": 35.0}


def write_labels(records: DataFrame, path: str) -> None:
    """JSON lines with sorted keys, in order of fingerprint; a NaN fails."""
    doubles = [c for c, t in records.dtypes if t in ("double", "float")]
    checked = records.withColumns({c: F.when(F.isnan(c), F.raise_error(F.lit(f"{c} is NaN")).cast("double")).otherwise(F.col(c)) for c in doubles}) if doubles else records
    line = F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"})
    checked.withColumn("_line", line).orderBy("fingerprint").select(F.col("_line").alias("value")).write.text(path)


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def required(df: DataFrame, *columns: str) -> DataFrame:
    """df, which fails where a column is null."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is missing"))) for c in columns})


def read_seed_manifest(spark: SparkSession, path: str) -> DataFrame:
    return required(spark.read.schema("scenario string, seed long, style string").json(path), "scenario", "seed")


def read_envelopes(spark: SparkSession, path: str, needed: DataFrame) -> DataFrame:
    """Envelopes (style, size, metric, p10, p50, p90); one out of order, or a needed (style, size, metric) without one, fails."""
    x = spark.read.schema("style string, size string, metric string, p10 double, p50 double, p90 double").json(path)
    bad = x.where(~((F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90")))).limit(1).count()
    if bad:
        raise ValueError("an envelope's quantiles aren't in order")
    if needed.join(x, ["style", "size", "metric"], "left_anti").limit(1).count():
        raise ValueError("an envelope is missing")
    return x


def read_budget(spark: SparkSession, path: str | None) -> DataFrame:
    """The budget policy, defaults where a value or the whole file is absent."""
    cols = ", ".join(f"{k} double" for k in BUDGET)
    x = spark.read.schema(cols).json(path) if path else spark.range(1).select(*[F.lit(None).cast("double").alias(k) for k in BUDGET])
    return x.select(*[F.coalesce(k, F.lit(v)).alias(k) for k, v in BUDGET.items()])


def fingerprinted(df: DataFrame) -> DataFrame:
    """df with `fingerprint`, the SHA-256 of the rest of the row as JSON with sorted keys."""
    rest = sorted(c for c in df.columns if c != "fingerprint")
    return df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a fingerprinted report; one whose fingerprint isn't that of its values fails."""
    x = spark.read.schema(f"{schema}, fingerprint string").json(path)
    again = fingerprinted(x.drop("fingerprint")).columns
    rest = sorted(c for c in again if c != "fingerprint")
    real = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    return x.withColumn("fingerprint", F.when(F.col("fingerprint") == real, F.col("fingerprint")).otherwise(F.raise_error(F.lit("a report was changed"))))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often."""
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()
