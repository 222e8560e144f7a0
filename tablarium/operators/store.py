"""Queries over banks (bank_id, name, slug), campaigns (campaign_id, bank_id) and fields (campaign_id, field_name, value, extractor, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_fields(fields: DataFrame, campaigns: DataFrame, banks: DataFrame, name: str) -> DataFrame:
    """All values of one field with campaign and bank."""
    return fields.filter(F.col("field_name") == name).join(campaigns, "campaign_id").join(banks, "bank_id")


def counts(banks: DataFrame, campaigns: DataFrame, fields: DataFrame) -> DataFrame:
    """One row of totals."""
    one = fields.agg(F.count("*").alias("fields"), F.countDistinct("field_name").alias("field_names"), F.countDistinct("campaign_id").alias("campaigns_with_fields"))
    return banks.agg(F.count("*").alias("banks")).join(campaigns.agg(F.count("*").alias("campaigns"))).join(one)  # one row each


def field_coverage(fields: DataFrame) -> DataFrame:
    """Campaigns by field."""
    return fields.groupBy("field_name").agg(F.countDistinct("campaign_id").alias("n"))


def coverage_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """field_name, n_before, n_after, change of two states of the stored fields; a field that one state lacks has none there."""
    a, b = (field_coverage(x).withColumnRenamed("n", name) for x, name in ((before, "n_before"), (after, "n_after")))
    return a.join(b, "field_name", "full").na.fill(0, ["n_before", "n_after"]).select("field_name", "n_before", "n_after", (F.col("n_after") - F.col("n_before")).alias("change"))


def fields_by_extractor(fields: DataFrame) -> DataFrame:
    """S08"""
    return fields.groupBy("extractor").agg(F.count("*").alias("n"))


def campaigns_per_bank(banks: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Zeros are kept."""
    n = campaigns.groupBy("bank_id").agg(F.count("*").alias("n"))
    return banks.join(n, "bank_id", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n"))


def with_minimum_term(rows: DataFrame, fields: DataFrame, months: int) -> DataFrame:
    """QA5: rows whose campaign's first numeric term is at least `months`."""
    first = fields.filter("field_name = 'vade_ay' and value is not null").groupBy("campaign_id").agg(F.min(F.struct("seq", "value"))["value"].alias("t"))
    return rows.join(first.filter(F.col("t") >= months).select("campaign_id"), "campaign_id", "left_semi")


def all_banks(banks: DataFrame) -> DataFrame:
    """S04"""
    return banks.orderBy("slug")


def all_campaigns(campaigns: DataFrame, banks: DataFrame) -> DataFrame:
    """Campaigns with their bank; those of unknown banks are left out."""
    return campaigns.join(banks, "bank_id").orderBy("campaign_id")


def field_value(fields: DataFrame, campaign_id: int, name: str) -> DataFrame:
    """campaign_id, value of the field's first row; the filter reaches the scan."""
    return fields.filter((F.col("campaign_id") == campaign_id) & (F.col("field_name") == name)).orderBy("seq").limit(1).select("campaign_id", "value")


def with_fields(campaigns: DataFrame, fields: DataFrame) -> DataFrame:
    """Campaigns with an array of their fields by seq, empty if there are none. A campaign has a dozen fields, as names are fixed."""
    grouped = fields.groupBy("campaign_id").agg(F.array_sort(F.collect_list(F.struct("seq", "field_name", "value", "extractor"))).alias("fields"))
    return campaigns.join(grouped, "campaign_id", "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<struct<seq:bigint,field_name:string,value:double,extractor:string>>")))
