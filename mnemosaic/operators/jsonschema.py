"""Schemas of JSON output: what fields and types the results of a tool have, and when they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A variant, null for what is no JSON."""
    return F.try_parse_json(text)


def schemas(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by..., schema, n, broken): one schema of all JSON texts of a group, merged while rows are added up; rows that are no JSON are counted.

    Fields that differ in type become VARIANT. A group without JSON has the schema VOID.
    """
    v = rows.select(*by, F.col(text).isNotNull().alias("_there"), parsed(F.col(text)).alias("_v"))
    return v.groupBy(*by).agg(F.schema_of_variant_agg("_v").alias("schema"), F.count("_v").alias("n"), F.count_if(F.col("_there") & F.col("_v").isNull()).alias("broken"))


def changes(rows: DataFrame, by: list[str], period: Column, text: str) -> DataFrame:
    """(by..., period, schema, before): periods whose schema is not that of the last period of the group with JSON; the first is one too."""
    found = schemas(rows.withColumn("period", period), [*by, "period"], text).filter("n > 0")
    w = Window.partitionBy(*by).orderBy("period")  # a row for each period
    return found.withColumn("before", F.lag("schema").over(w)).filter(~F.col("schema").eqNullSafe(F.col("before"))).select(*by, "period", "schema", "before")


def fields(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by..., field, kind, n): top-level fields of JSON objects, the kind of their values, and how often each comes."""
    v = rows.select(*by, parsed(F.col(text)).alias("_v")).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    keys = v.select(*by, "_v", F.explode(F.json_object_keys(F.to_json("_v"))).alias("field"))
    kind = F.schema_of_variant(F.try_variant_get("_v", F.concat(F.lit("$['"), F.replace(F.col("field"), F.lit("'"), F.lit("\\'")), F.lit("']")), "variant"))
    return keys.select(*by, "field", kind.alias("kind")).groupBy(*by, "field", "kind").agg(F.count("*").alias("n"))
