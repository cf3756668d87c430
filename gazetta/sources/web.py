"""Stored web pages: notices, links, document ids and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_file_name
from ..operators.versioning import latest_per_key

#: File types that are attachments (fixed values).
EXTENSIONS = ("pdf", "hwp", "hwpx", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "txt", "csv")
VALID_ID = r"^[A-Za-z0-9_.:-]{1,100}$"


def strip_tags(html: Column) -> Column:
    """Text of an HTML fragment: no scripts and styles, tags as blanks, common entities read, white space settled."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _first(html: Column, patterns: list[str]) -> Column:
    """Text of the first pattern that finds any."""
    texts = [strip_tags(F.regexp_extract(html, p, 1)) for p in patterns]
    return F.coalesce(*[F.when(t != "", t) for t in texts])


TITLES = [r"(?is)<h1\b[^>]*>(.*?)</h1>", r"(?is)<h2\b[^>]*>(.*?)</h2>"]
BODIES = [r"(?is)<article\b[^>]*>(.*?)</article>", r"(?is)<main\b[^>]*>(.*?)</main>", r"(?is)<body\b[^>]*>(.*?)</body>"]
DATES = r"((?:19|20)\d\d)[-./]\s?(\d{1,2})[-./]\s?(\d{1,2})"


def pages_to_notices(pages: DataFrame, titles: list[str] = TITLES, bodies: list[str] = BODIES, list_date: str | None = None) -> DataFrame:
    """(page_id, url, title, content_text, published_at): first title that is not empty, else <title>; date of a <time>, else the list's."""
    title = F.coalesce(_first(F.col("html"), titles), _first(F.col("html"), [r"(?is)<title\b[^>]*>(.*?)</title>"]))
    time = F.regexp_extract("html", r"(?is)<time\b[^>]*?(?:datetime=[\"']([^\"']*)[\"'][^>]*)?>", 1)
    shown = strip_tags(F.regexp_extract("html", r"(?is)<time\b[^>]*>(.*?)</time>", 1))
    text = F.when(time != "", time).when(shown != "", shown)
    iso = F.try_to_timestamp(F.regexp_extract(text, r"^\d{4}-\d\d-\d\d", 0), F.lit("yyyy-MM-dd"))
    dotted = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(text, DATES, 0), r"[./]\s?", "-"), F.lit("yyyy-M-d"))
    named = F.try_to_timestamp(text, F.lit("MMM d, yyyy"))
    back = F.col(list_date) if list_date else F.lit(None)
    when = F.coalesce(iso, dotted, named, back.cast("timestamp")).cast("timestamp_ntz")
    return pages.select("page_id", "url", title.alias("title"), _first(F.col("html"), bodies).alias("content_text"), when.alias("published_at"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, position, href, text): every link with an address, in order."""
    tag = r"(?is)<a\b[^>]*?\bhref=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    links = F.arrays_zip(F.regexp_extract_all("html", F.lit(tag), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(tag), F.lit(2)).alias("inner"))
    rows = pages.select("page_id", "url", F.posexplode(links).alias("position", "a"))
    return rows.select("page_id", "url", "position", F.col("a.href").alias("href"), strip_tags(F.col("a.inner")).alias("text"))


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0))


def absolute(href: Column, base: Column) -> Column:
    """The address that a link means on a page, without parameters and fragment."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-z]+://[^/]*/?(?:.*/)?)[^/]*$", "$1")
    out = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .when(href.startswith("#") | (href == ""), base)
        .otherwise(F.concat(folder, href))
    )
    return F.regexp_replace(out, r"#.*$", "")


def select_links(links: DataFrame, sources: DataFrame | None = None, pattern: str | None = None, limit: int = 20) -> DataFrame:
    """Document links of each page: same origin, http(s), holding the literal pattern, first of each address, the first ``limit``."""
    out = links.withColumn("link", absolute(F.col("href"), F.col("url")))
    out = out.where(F.col("link").rlike(r"(?i)^https?://") & (origin(F.col("link")) == origin(F.col("url"))))
    out = out.where(F.contains("link", F.lit(pattern)) if pattern else F.col("link") != F.regexp_replace("url", r"#.*$", ""))
    out = latest_per_key(out, ["page_id", "link"], [F.asc("position")])
    from pyspark.sql.window import Window

    turn = F.row_number().over(Window.partitionBy("page_id").orderBy("position"))
    return out.withColumn("n", turn).where(F.col("n") <= limit).select("page_id", "link", "n")


def external_id(url: Column, keys: list[str], path: str | None = None) -> Column:
    """Id of a document's address: the first of the query keys with a valid value, else from the path."""
    found = [F.regexp_extract(url, rf"(?i)[?&]{k}=([^&#]*)", 1) for k in keys]
    found += [F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), path, 1)] if path else []
    return F.coalesce(*[F.when(f.rlike(VALID_ID), f) for f in found])


def attachment_links(links: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(page_id, download_url, file_name): links to files by address or text, one row an address; the text names it, else the address."""
    kinds = "|".join(extensions)
    is_file = F.col("href").rlike(rf"(?i)\.({kinds})($|[?#])") | F.col("text").rlike(rf"(?i)\.({kinds})\b")
    out = links.where(is_file).withColumn("download_url", absolute(F.col("href"), F.col("url")))
    out = latest_per_key(out, ["page_id", "download_url"], [F.asc("position")])
    name = F.when(F.col("text") != "", F.col("text")).otherwise(F.regexp_extract("download_url", r"([^/]*)$", 1))
    return out.select("page_id", "download_url", F.substring(normalize_file_name(name), 1, 500).alias("file_name"))
