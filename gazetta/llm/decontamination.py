"""Benchmark decontamination by winnowing; DataFrame functions only.

Of every ``WINDOW`` consecutive words a text keeps the k-gram with the least hash.  Equal windows keep the same k-gram, so
texts that share a window share a fingerprint; hits are then extended word by word, and only equal words count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, row_key, same, small_side, staged

#: Words of a window, and of the k-gram that stands for it: WINDOW - GRAM + 1 hashes are compared.
WINDOW, GRAM = 10, 5
#: Lower-cased characters that separate words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprints of the benchmark, and bytes of their words, that may be broadcast; beyond that, in how many places a key meets.
BROADCAST_FINGERPRINTS, BROADCAST_BYTES, SALT = 100_000, 64_000_000, 16
KEYS = ["doc_id", "row_key"]


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` worked out once a row, however often ``f`` and its lambdas read it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _places(n: Column) -> Column:
    """0 to n - 1; empty where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gram_hashes(w: Column, k: int) -> Column:
    """The hash of the k-gram at each place."""
    return F.transform(_places(F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i + 1, k)))


def fingerprints(w: Column, window: int) -> Column:
    """The distinct least hashes of a text's windows; windows shorter than WINDOW are told by single words."""
    k = _gram(window)
    least = lambda h: F.transform(_places(F.size(h) - (window - k)), lambda i: F.array_min(F.slice(h, i + 1, window - k + 1)))
    return F.array_distinct(once(gram_hashes(w, k), least))


def _gram(window: int) -> int:
    return GRAM if window == WINDOW else 1


def _hits(rows: DataFrame, keep: list[str | Column], window: int) -> DataFrame:
    """``keep``, place, hash and the words about each k-gram of ``rows(words, ...)``: ``before`` (nearest first), ``gram``, ``after``."""
    k, w = _gram(window), F.col("words")
    at = F.posexplode(gram_hashes(w, k)).alias("place", "hash")
    near = F.greatest(F.lit(0), F.col("place") - (window - k))
    before = F.reverse(F.slice(w, near + 1, F.col("place") - near))
    return rows.select(*keep, "words", at).select(
        *keep, "place", "hash", before.alias("before"), F.slice(w, F.col("place") + 1, k).alias("gram"), F.slice(w, F.col("place") + k + 1, window - k).alias("after")
    )


def _run(a: str, b: str) -> Column:
    """How many words two arrays share from their beginnings on."""
    differ = F.filter(_places(F.least(F.size(a), F.size(b))), lambda i: F.get(F.col(a), i) != F.get(F.col(b), i))
    return F.coalesce(F.get(differ, F.lit(0)), F.least(F.size(a), F.size(b)))


def contexts(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of ``items(item_id, words)`` as (hash, context, bytes, item_before, item_gram, item_after), and (context, item_id)."""
    own = items.withColumn("own", fingerprints(F.col("words"), window))
    found = _hits(own, ["item_id", "own"], window).where(F.array_contains("own", F.col("hash")))
    about = F.to_json(F.struct("before", "gram", "after"))
    sides = [F.col(c).alias(f"item_{c}") for c in ("before", "gram", "after")]
    found = staged(found.select("item_id", "hash", F.sha2(about, 256).alias("context"), F.octet_length(about).alias("bytes"), *sides))
    return staged(found.drop("item_id").dropDuplicates(["hash", "context"])), staged(found.select("context", "item_id").distinct())


def _meet(rows: DataFrame, table: DataFrame, key: str, small: bool, how: str = "inner") -> DataFrame:
    """Join on a key that any share of ``rows`` may have: ``table`` is broadcast where it is small, else met in SALT places a key."""
    if small:
        return rows.join(F.broadcast(table), key, how)
    salted = rows.withColumn("salt", F.pmod(F.col("row_key"), F.lit(SALT)))
    return salted.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))), [key, "salt"], how).drop("salt")


def _met(texts: DataFrame, first: DataFrame, items: DataFrame, window: int, broadcast: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, start, end) of the runs that documents share with windows of this length, and (doc_id, row_key, item_id)."""
    k = _gram(window)
    table, owners = contexts(items, window)
    n, size = table.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    small = n <= broadcast and size <= BROADCAST_BYTES
    marked = first.select(*KEYS, F.explode(F.col("marks")[window]).alias("hash"))
    shared = staged(_meet(marked, table.select("hash").distinct(), "hash", small, "left_semi").select(*KEYS).distinct())
    texts = texts.alias("r").join(small_side(shared).alias("s"), same("r", "s", *KEYS), "left_semi").withColumn("words", words(F.col("text")))
    met = _meet(_hits(texts, KEYS, window), table, "hash", small).where(F.col("gram") == F.col("item_gram"))
    met = met.withColumns({"left": _run("before", "item_before"), "right": _run("after", "item_after")}).where(F.col("left") + F.col("right") + k >= window)
    first_word, last_word = F.min(F.col("place") - F.col("left")), F.max(F.col("place") + k + F.col("right"))
    met = staged(met.groupBy(*KEYS, "place", "context").agg(first_word.alias("start"), last_word.alias("end")))
    named = _meet(met.select(*KEYS, "context").distinct(), owners.where("item_id IS NOT NULL"), "context", owners.count() <= BROADCAST_ROWS)
    return met.select(*KEYS, "start", "end"), named.select(*KEYS, "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, broadcast: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated, items: one row for each row of ``docs``.

    ``items``: item_id, text.  A window of an item is ``WINDOW`` consecutive words, or all words of an item with fewer; every
    word of a document inside an occurrence of a window is hit.  ``items``: the item_ids of these windows, sorted as strings.
    Null and empty texts have no words and no windows.  Rows of one doc_id, or without one, are documents each; repeated rows
    come out as often.  Item_ids count once however many rows have them; an item without an id hits words but is not named.
    Without documents there are no rows, without items no hits.  Other columns are not read, whatever their names, but tell
    rows of one doc_id apart (``row_key``, a hash of all columns).  Where the benchmark has more than ``broadcast``
    fingerprints, they meet those of the documents in shuffles.
    """
    items = staged(items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0))
    sizes = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect())  # at most WINDOW numbers
    texts = docs.select("doc_id", row_key(docs).alias("row_key"), "text")

    def marks(w: Column) -> Column:
        pairs = [c for n in sizes for c in (F.lit(n), fingerprints(w, n))]
        return F.struct(F.size(w).cast("long").alias("n_words"), (F.create_map(*pairs) if pairs else F.lit(None).cast("map<int,array<bigint>>")).alias("marks"))

    first = staged(texts.select(*KEYS, once(words(F.col("text")), marks).alias("w"))).select(*KEYS, "w.n_words", "w.marks")
    spans = first.where("false").select(*KEYS, F.lit(0).alias("start"), F.lit(0).alias("end"))
    named = items.where("false").select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row_key"), "item_id")
    for n in sizes:
        runs, ids = _met(texts, first, items.where(F.size("words") >= n if n == WINDOW else F.size("words") == n), n, broadcast)
        spans, named = spans.unionByName(runs), named.unionByName(ids)
    spans = spans.groupBy(*KEYS, "start").agg(F.max("end").alias("end"))
    spans = spans.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    further = lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.end - F.greatest(s.end, x.start))).alias("n"), F.greatest(s.end, x.end).alias("end"))
    hit = spans.select(*KEYS, F.aggregate("spans", zero, further).n.alias("n_hit"))
    ids = named.distinct().groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    found = staged(hit.alias("h").join(ids.alias("i"), same("h", "i", *KEYS), "left").select("h.*", "i.items"))
    out = first.alias("f").join(small_side(found).alias("h"), same("f", "h", *KEYS), "left")
    out = out.select("f.doc_id", "f.row_key", "f.n_words", F.coalesce("h.n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("h.items", F.array().cast("array<string>")).alias("items"))
    return out.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": F.col("n_hit") > 0})


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its words in windows of ``benchmark``; ``decontaminate`` states the odd cases."""
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), m AS (
  SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, t)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY 1
), its AS (
  SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM m GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
