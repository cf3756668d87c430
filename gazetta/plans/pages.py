"""Queries on stored web pages."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import web as P
from .base import query, table

_STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<(?:script|style|noscript)\b[^>]*>.*?</(?:script|style|noscript)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""


def _strip(x):
    return _STRIP.replace("{0}", x)


_TITLE = "coalesce(nullif(" + _strip(r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)") + ", ''), nullif(" + _strip(r"regexp_extract(html, '(?is)<h2\b[^>]*>(.*?)</h2>', 1)") + ", ''), nullif(" + _strip(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)") + ", ''))"
_BODY = "nullif(" + _strip(r"regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1)") + ", '')"


@query("s3_pages_to_notices", f"SELECT page_id, {_TITLE} AS title, length({_BODY}) AS body_chars FROM pages")
def s3(spark, sf):
    n = P.pages_to_notices(table(spark, sf, "pages"))
    return n.select("page_id", "title", F.length("content_text").cast("long").alias("body_chars"))


_LINKS = r"""l AS (SELECT page_id, url, unnest(range(len(h))) AS position, unnest(h) AS href, unnest(t) AS inner_ FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref=["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS t FROM pages)),
k AS (SELECT page_id, url, position, href, """ + _strip("inner_") + " AS text FROM l)"


@query("s4_page_links", f"WITH {_LINKS} SELECT page_id, CAST(position AS INTEGER) AS position, href, text FROM k")
def s4(spark, sf):
    return P.page_links(table(spark, sf, "pages")).select("page_id", "position", "href", "text")


_ABS = r"""a AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) || href ELSE url END, '#.*$', '') AS link FROM k)"""


@query("s5_select_links", f"WITH {_LINKS}, {_ABS}, f AS (SELECT * FROM a WHERE contains(link, 'th') QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY position) = 1) SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY position) AS INTEGER) AS n FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY position) <= 3")
def s5(spark, sf):
    return P.select_links(P.page_links(table(spark, sf, "pages")), pattern="th", limit=3)


@query("s6_external_id", "SELECT page_id, coalesce(nullif(regexp_extract(url, '(?i)[?&]id=([^&#]*)', 1), ''), nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/([0-9]+)$', 1), '')) AS external_id FROM pages")
def s6(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.external_id(F.col("url"), ["id"], r"/([0-9]+)$").alias("external_id"))


@query("s7_attachment_links", f"WITH {_LINKS}, {_ABS} SELECT page_id, link AS download_url FROM a WHERE regexp_matches(href, '(?i)e$') QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY position) = 1")
def s7(spark, sf):
    links = P.page_links(table(spark, sf, "pages"))
    files = links.withColumn("href", F.when(F.col("href").rlike("e$"), F.concat("href", F.lit(".pdf"))).otherwise(F.col("href"))).withColumn("text", F.regexp_replace("text", r"\.", " "))
    return P.attachment_links(files).select("page_id", F.regexp_replace("download_url", r"\.pdf$", "").alias("download_url"))


@query("f2_file_names", r"SELECT p_partkey, p_name || '.pdf' AS name, '.pdf' AS ext FROM part")
def f2(spark, sf):
    raw = F.concat(F.lit(" "), "p_name", F.lit(".pdf [1.2 MB] "))
    return table(spark, sf, "part").select("p_partkey", X.normalize_file_name(raw).alias("name"), X.file_extension(raw).alias("ext"))


@query("s8_file_inventory")
def s8(spark, sf):
    """The stored part table's own files, as any other files."""
    from ..sources.tables import file_inventory

    return file_inventory(spark, f"{sf}/part.parquet", 1 << 26).select("file_size", "file_hash", "declared_type", "sniffed_type", "oversize")


@query("s1_flatten_collection", """
SELECT o_custkey % 50 AS run_id, count(DISTINCT o_custkey) AS sources, count(DISTINCT o_orderkey) AS documents, count(l_linenumber) AS attachments FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def s1(spark, sf):
    """Nested batches built from orders (documents) and lineitem (attachments), then flattened again."""
    from ..sources.tables import flatten_collection

    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    a = F.struct(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("file_name"), *none("download_url", "content_type", "file_hash", "extracted_text", "archive_entries_json", "parse_status", "error_message"), F.col("l_quantity").cast("long").alias("file_size"))
    files = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(a).alias("attachments"))
    o = table(spark, sf, "orders").join(files, "o_orderkey", "left")
    d = F.struct(F.col("o_orderkey").cast("string").alias("original_url"), *none("external_document_id", "title", "content_text", "published_at"), "attachments")
    s = o.groupBy((F.col("o_custkey") % 50).alias("run_id"), F.col("o_custkey").alias("source_id")).agg(F.collect_list(d).alias("documents"))
    s = s.groupBy("run_id").agg(F.collect_list(F.struct("source_id", *none("status", "error_message"), "documents")).alias("sources")).withColumn("job_id", F.lit("j"))
    sources, docs, atts = flatten_collection(s)
    out = sources.groupBy("run_id").agg(F.count("*").alias("sources"))
    out = out.join(docs.groupBy("run_id").agg(F.count("*").alias("documents")), "run_id")
    return out.join(atts.groupBy("run_id").agg(F.count("*").alias("attachments")), "run_id")
