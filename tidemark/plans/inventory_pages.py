"""Pages to text, metadata and links, over whole pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pages
from tidemark.plans.catalog import register
from tidemark.sources.tables import table

_DECODED = "replace(replace(replace(replace({x}, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '\"'), '&amp;', '&')"
_TIDY = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_SHOWN = "regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<script.*?</script>', '', 'g'), '(?s)<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_TEXT = _TIDY.format(x=_DECODED.format(x=f"regexp_replace({_SHOWN.format(x='html')}, '<[^>]*>', ' ', 'g')"))
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1)"
_MAIN = _TIDY.format(x=_DECODED.format(x=f"regexp_replace(regexp_replace({_ARTICLE}, '</?(a|b)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g')"))
_LINKS = """(SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_extract(l, 'href="([^"#]*)', 1) AS href, k FROM (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*"')) AS l, unnest(range(len(regexp_extract_all(html, '<a href="[^"]*"')))) AS k FROM pages))"""


def _fields(spark, d):
    return pages.page_fields(table(spark, d, "pages"))


@register("src_33_page_text", f"SELECT page_id, {_TEXT} AS text FROM pages")
def src_33(spark, d):
    return _fields(spark, d).select("page_id", "text")


@register("src_32_main_text", f"SELECT page_id, {_MAIN} AS main FROM pages")
def src_32(spark, d):
    return _fields(spark, d).select("page_id", "main")


@register("src_34_page_metadata", f"SELECT page_id, trim({_DECODED.format(x=chr(39).join(['regexp_extract(html, ', '(?s)<title>(.*?)</title>', ', 1)']))}) AS title, '' AS description, NULL::VARCHAR AS image, len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages")
def src_34(spark, d):
    return _fields(spark, d).select("page_id", "title", "description", "image", F.size("links").alias("n_links"))


@register("src_35_page_links", f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, href FROM (SELECT page_id, href, min(k) AS k FROM {_LINKS} GROUP BY page_id, href)")
def src_35(spark, d):
    return pages.page_links(_fields(spark, d))


@register("add_154_chosen_text", f"""
SELECT page_id, CASE WHEN length(main) >= length(text) THEN main ELSE text END AS text, CASE WHEN length(main) >= length(text) THEN 'main' ELSE 'whole' END AS level, length(main) AS main_chars, length(text) AS whole_chars
FROM (SELECT page_id, {_TEXT} AS text, {_MAIN} AS main FROM pages)""")
def add_154(spark, d):
    """Without the similarity of both texts, which tests compare with a plain computation."""
    return pages.chosen_text(_fields(spark, d)).select("page_id", "text", "level", "main_chars", "whole_chars")
