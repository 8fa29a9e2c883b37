"""Full HTML cleaning of pages; no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.markup import cleaned
from siltstone.plans.registry import Tables, query


@query()
def clean_html(t: Tables):
    rows = cleaned(t.pages, "page_id", "html")
    return rows.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.size("blocks").cast("bigint").alias("n_blocks"), "has_code", "error")


@query()
def html_blocks(t: Tables):
    rows = cleaned(t.pages, "page_id", "html").select("page_id", F.posexplode("blocks").alias("ordinal", "block"))
    return rows.select("page_id", F.col("ordinal").cast("bigint").alias("ordinal"), "block.kind", "block.language", F.length("block.text").cast("bigint").alias("n_chars"))
