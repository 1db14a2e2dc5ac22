"""Product identifiers embedded in HTML: JSON-LD scripts, site metadata scripts, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.session import computed

SITE_METADATA = "page struct<listItems array<struct<idProduct string>>>"


def _scripts(html: Column, kind: str) -> Column:
    pattern = rf'(?s)<script[^>]*type="{kind}"[^>]*>(.*?)</script>'
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def json_ld_skus(df: DataFrame, html: str = "html") -> DataFrame:
    """``sku`` of every JSON-LD script that has one; unreadable scripts are skipped."""
    others = [c for c in df.columns if c != html]
    scripts = computed(df, _all=_scripts(F.col(html), r"application/ld\+json")).select(*others, F.explode("_all").alias("_s"))
    return (scripts.select(*others, F.get_json_object("_s", "$.sku").alias("product_id"))
            .filter(F.col("product_id").isNotNull()))


def metadata_product_ids(df: DataFrame, html: str = "html") -> DataFrame:
    """Ids listed in ``siteMetadata = {...};`` scripts, in page order."""
    others = [c for c in df.columns if c != html]
    scripts = computed(df, _all=_scripts(F.col(html), "text/javascript")).select(*others, F.explode("_all").alias("_s"))
    flat = F.regexp_replace("_s", r"[\n\r]", "")
    body = F.regexp_extract(flat, r"^.*siteMetadata = (.+); *$", 1)
    items = F.from_json(body, SITE_METADATA)["page"]["listItems"]
    listed = computed(scripts.filter(F.contains("_s", F.lit("siteMetadata"))), _items=items)
    return listed.select(*others, F.inline("_items")).withColumnRenamed("idProduct", "product_id")


def attribute_values(df: DataFrame, css_class: str, attribute: str, html: str = "html") -> DataFrame:
    """Values of ``attribute`` on every element carrying ``css_class``."""
    others = [c for c in df.columns if c != html]
    tags = F.regexp_extract_all(html, F.lit(r"(<[a-zA-Z][^>]*>)"), F.lit(1))
    classes = rf'\bclass="(?:[^"]*\s)?{css_class}(?:\s[^"]*)?"'
    values = F.flatten(F.transform(F.filter(tags, lambda t: t.rlike(classes)), lambda t: F.regexp_extract_all(
        t, F.lit(rf'\s{attribute}="([^"]*)"'), F.lit(1))))
    return computed(df, _v=values).select(*others, F.explode("_v").alias("value"))


def first_group(df: DataFrame, pattern: str, alias: str, html: str = "html") -> DataFrame:
    """Every first-group match of ``pattern`` in the page, one row each."""
    others = [c for c in df.columns if c != html]
    return computed(df, _all=F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).select(*others, F.explode("_all").alias(alias))
