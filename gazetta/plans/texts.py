"""Queries on texts: the synthetic documents with a vocabulary of their own in place of the Korean rules."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import statements as S
from ..operators import texts as T
from .base import query, table

_CLAUSES = r"""s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?。])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents),
c AS (SELECT * FROM (SELECT doc_id, unnest(range(len(p))) AS clause_no, regexp_replace(trim(regexp_replace(unnest(p), '^[\s○●■□▪·*-]+', '')), '\s+', ' ', 'g') AS clause FROM s) WHERE length(clause) BETWEEN 15 AND 300)"""


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


def clauses(spark, sf):
    return T.clauses(docs(spark, sf), "doc_id", "text")


@query("f1_normalize_text", r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS h FROM documents")
def f1(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(X.normalize_text(F.col("text")), 256).alias("h"))


_LINES_OF = r"SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS t FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|[\n\x0b\f\r\x{85}\x{2028}\x{2029}]') AS p FROM documents)"
_STATUS = r"'(?:http|status)\D{0,10}([45]\d\d)'"


@query("f8_classify_warning", rf"""WITH r AS ({_LINES_OF}), l AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS line FROM r),
k AS (SELECT doc_id, line_no, line || CASE line_no % 5 WHEN 0 THEN ' timed out' WHEN 1 THEN ' http status 503' WHEN 2 THEN ' badzip' ELSE '' END AS low FROM l WHERE line <> '')
SELECT doc_id, line_no, CASE WHEN regexp_matches(low, 'timeout|timed out|시간 초과|시간이 초과') THEN 'TIMEOUT' WHEN regexp_matches(low, {_STATUS}) THEN 'HTTP_' || regexp_extract(low, {_STATUS}, 1)
WHEN regexp_matches(low, '암호|encrypted|password protected') THEN 'ENCRYPTED' WHEN regexp_matches(low, '크기|too large|size limit') THEN 'TOO_LARGE' WHEN regexp_matches(low, '손상|badzip|corrupt') THEN 'CORRUPT'
WHEN regexp_matches(low, '텍스트를 찾지|no text') THEN 'NO_TEXT' WHEN regexp_matches(low, '지원하지|unsupported') THEN 'UNSUPPORTED' ELSE 'ATTACHMENT' END AS category FROM k""")
def f8(spark, sf):
    """Every line of the whole texts, three of five with an error at their end."""
    k = F.col("line_no") % 5
    raw = F.concat("line", F.when(k == 0, " Timed out").when(k == 1, " HTTP status 503").when(k == 2, " BadZip").otherwise(""))
    return T.lines(docs(spark, sf), "doc_id", "text").select("doc_id", "line_no", X.classify_warning(raw, F.lit(False)).alias("category"))


@query("f9_is_unknown", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?。])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents),
u AS (SELECT doc_id, CAST(n AS INTEGER) AS sentence_no, p[n + 1] AS t FROM (SELECT doc_id, p, unnest(range(len(p))) AS n FROM s))
SELECT doc_id, sentence_no, sentence_no % 3 > 0 OR regexp_full_match(lower(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '[.!?。]+$', '')), 'unknown|n/?a') AS unknown FROM u""")
def f9(spark, sf):
    """Every sentence of the whole texts, two of three in the words of a placeholder."""
    s = docs(spark, sf).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_no", "sentence"))
    k = F.col("sentence_no") % 3
    said = F.when(k == 1, F.lit("N/A.")).when(k == 2, F.lit("본문에서 확인되지 않음")).otherwise(F.col("sentence"))
    return s.select("doc_id", "sentence_no", X.is_unknown(said).alias("unknown"))


@query("f10_source_role", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'form' WHEN 1 THEN 'example' WHEN 2 THEN 'reference' ELSE 'notice' END AS role FROM part")
def f10(spark, sf):
    k = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(k == 0, " Form.hwp").when(k == 1, " 예시.pdf").when(k == 2, " Appendix.pdf").otherwise(".pdf"))
    return table(spark, sf, "part").select("p_partkey", X.source_role(name).alias("role"))


@query("e0_tokens", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) FROM documents) GROUP BY 1")
def e0(spark, sf):
    t = T.tokens(docs(spark, sf), "doc_id", "text", {"number": "[0-9]+"}).join(docs(spark, sf), "doc_id")
    right = F.expr("substring(text, cast(start + 1 as int), cast(end - start as int))") == F.col("token")
    return t.where(right).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("e1_source_parts", r"SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, 'License'), lambda x: trim(x)), lambda x: x <> '')) AS parts FROM documents")
def e1(spark, sf):
    p = T.source_parts(docs(spark, sf), "doc_id", "text", "Licens(e)")
    return p.groupBy("doc_id").agg(F.count("*").alias("parts"))


@query("e2_clauses", f"WITH {_CLAUSES} SELECT doc_id, count(*) AS n, CAST(sum(length(clause)) AS BIGINT) AS chars FROM c GROUP BY 1")
def e2(spark, sf):
    return clauses(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("clause")).alias("chars"))


@query("e3_table_rows", "SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS a, l_returnflag AS b FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def e3(spark, sf):
    """Order lines written as table blocks; the first line of an order has a cell too many, which rejects the block."""
    row = F.concat(F.col("l_linenumber").cast("string"), F.lit("\t"), "l_returnflag", F.when(F.col("l_linenumber") == 1, "\tx").otherwise(""))
    text = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("rows"), F.max("l_linenumber").alias("most"), F.min("l_linenumber").alias("least"))
    text = text.where("NOT (most = 1 AND least = 1)").withColumn("rows", F.concat(F.lit("intro [표]\n"), "rows", F.lit("\n[/표] end")))
    return T.table_rows(text, "l_orderkey", "rows").select("l_orderkey", F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))


_RULES = {"A": ("the", "thing"), "B": ("ing", "tion")}


@query("e4_tag_risks")
def e4(spark, sf):
    return T.tag_risks(clauses(spark, sf), "clause", _RULES, 120).select("doc_id", "clause_no", "risk")


@query("e5_risk_findings", f"""WITH {_CLAUSES}, g AS (SELECT doc_id, t.risk, count(*) AS n FROM c, (SELECT unnest(['thing', 'oner', 'lich']) AS risk) t WHERE contains(clause, t.risk) GROUP BY 1, 2)
SELECT d.doc_id, t.risk, coalesce(n, 0) AS n, CASE WHEN n > 6 THEN 'INCOMPLETE' WHEN n > 0 THEN 'CANDIDATE' WHEN n_chars < 500 THEN 'DATA_INSUFFICIENT' ELSE 'NOT_FOUND' END AS status FROM documents d CROSS JOIN (SELECT unnest(['thing', 'oner', 'lich']) AS risk) t LEFT JOIN g ON g.doc_id = d.doc_id AND g.risk = t.risk""")
def e5(spark, sf):
    kinds = {k: k for k in ("thing", "oner", "lich")}
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") < 500).alias("short"))
    return T.risk_findings(d, T.tag_clauses(clauses(spark, sf), "clause", kinds, "risk"), "doc_id", "short", list(kinds))


_REQ = {"WITH_NUMBER": (True, (("the", "der"), ("ing", "ung"))), "PLAIN": (False, (("tion", "lich"), ("en",)))}


@query("e6_requirements", f"WITH {_CLAUSES}, t AS (SELECT doc_id, clause_no, regexp_replace(clause, '\\s+', '', 'g') AS x FROM c) SELECT doc_id, clause_no, CASE WHEN regexp_matches(x, '\\d') AND regexp_matches(x, 'the|der') AND regexp_matches(x, 'ing|ung') THEN 'WITH_NUMBER' ELSE 'PLAIN' END AS kind FROM t WHERE NOT contains(x, 'erthe') AND ((regexp_matches(x, '\\d') AND regexp_matches(x, 'the|der') AND regexp_matches(x, 'ing|ung')) OR (regexp_matches(x, 'tion|lich') AND contains(x, 'en')))")
def e6(spark, sf):
    c = X.worked_out(clauses(spark, sf), {"kind": T.requirement_kind(F.col("clause"), _REQ, ("erthe",))})
    return c.where("kind IS NOT NULL").select("doc_id", F.col("clause_no").cast("long").alias("clause_no"), "kind")


@query("e7_single_deadline", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS deadline FROM orders")
def e7(spark, sf):
    day = F.date_format("o_orderdate", "yyyy.MM.dd")
    other = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 9), "yyyy-MM-dd")
    text = F.concat(F.lit("공고일 1990-01-01. 접수 마감: "), day, F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" 또는 마감 "), other)).otherwise(""))
    return T.single_deadline(table(spark, sf, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text", "마감")


@query("e13_notice_nature", "SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'licence' WHEN regexp_matches(text, '(?i)idiot|moron') THEN 'rude' WHEN contains(text, '@') THEN 'contact' ELSE 'general' END AS nature FROM documents")
def e13(spark, sf):
    rules = [("licence", "License"), ("rude", "(?i)idiot|moron"), ("contact", "@")]
    return docs(spark, sf).select("doc_id", T.ordered_rules(F.col("text"), rules, "general").alias("nature"))


_LINES = r"l AS (SELECT * FROM (SELECT doc_id, unnest(range(len(p))) AS line_no, trim(regexp_replace(unnest(p), '[ \t\x0B\f\r]+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE line <> '')"


@query("e14_business_types", f"""WITH {_LINES}, h AS (SELECT doc_id, t.type, count(*) AS n, min(line_no) AS first, max(CASE WHEN line_no = 0 THEN 20 ELSE 0 END) AS bonus FROM l, (SELECT unnest(['ing', 'lich', 'ción', 'ment']) AS type) t WHERE contains(line, t.type) GROUP BY 1, 2)
SELECT doc_id, type, CAST(n + bonus AS BIGINT) AS score FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n + bonus DESC, first, type) = 1""")
def e14(spark, sf):
    kinds = {k: k for k in ("ing", "lich", "ción", "ment")}
    return T.business_types(T.lines(docs(spark, sf), "doc_id", "text"), "doc_id", kinds, "title")


@query("t7_best_per_type", f"WITH {_LINES} SELECT doc_id, line_no FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, line_no) = 1")
def t7(spark, sf):
    rows = T.lines(docs(spark, sf), "doc_id", "text").withColumn("score", F.length("line"))
    return T.best_per_type(rows, "doc_id", "score", "line_no").select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("w4_carry_heading", f"""WITH {_LINES}, h AS (SELECT *, length(line) < 80 AS head FROM l), w AS (SELECT doc_id, line_no, max(CASE WHEN head THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS pos, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS block FROM h)
SELECT w.doc_id, w.line_no, block, CASE WHEN w.line_no - pos <= 3 THEN h.line END AS heading FROM w LEFT JOIN h ON h.doc_id = w.doc_id AND h.line_no = pos""")
def w4(spark, sf):
    out = T.carry_heading(T.lines(docs(spark, sf), "doc_id", "text"), "doc_id", F.length("line") < 80, 3)
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "block", "heading")


@query("e15_strip_reference", f"""WITH {_LINES}, h AS (SELECT *, length(line) < 80 AS head FROM l), w AS (SELECT doc_id, line_no, max(CASE WHEN head THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS pos FROM h)
SELECT w.doc_id, w.line_no FROM w LEFT JOIN h ON h.doc_id = w.doc_id AND h.line_no = pos WHERE NOT coalesce(w.line_no - pos <= 60 AND regexp_matches(h.line, 'License|the'), false)""")
def e15(spark, sf):
    out = T.strip_reference(T.lines(docs(spark, sf), "doc_id", "text"), "doc_id", F.length("line") < 80, "License|the")
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("w5_merge_lines", f"""WITH {_LINES}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM l), m AS (SELECT *, sum(CASE WHEN length(line) < 60 AND rn > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS clause_no FROM g)
SELECT doc_id, CAST(clause_no AS BIGINT) AS clause_no, string_agg(line, ' ' ORDER BY line_no) AS text FROM m GROUP BY 1, 2""")
def w5(spark, sf):
    return T.merge_lines(T.lines(docs(spark, sf), "doc_id", "text"), "doc_id", F.length("line") < 60)


@query("e17_contacts", f"""WITH {_LINES}, n AS (SELECT *, max(CASE WHEN regexp_matches(line, 'the|der|que') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM l)
SELECT doc_id, line_no, regexp_extract(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS email, regexp_extract(line, '\\+?[0-9][0-9 ().-]{{7,}}[0-9]') AS phone FROM n WHERE near = 1 AND (regexp_matches(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') OR regexp_matches(line, '\\+?[0-9][0-9 ().-]{{7,}}[0-9]'))""")
def e17(spark, sf):
    out = T.contacts(T.lines(docs(spark, sf), "doc_id", "text"), "doc_id", "the|der|que")
    return out.withColumn("line_no", F.col("line_no").cast("long"))


@query("e18_topics", f"WITH {_CLAUSES} SELECT doc_id, t.topic, count(*) AS n FROM c, (SELECT unnest(['ing', 'lich', 'ción']) AS topic) t WHERE contains(clause, t.topic) GROUP BY 1, 2")
def e18(spark, sf):
    kinds = {k: k for k in ("ing", "lich", "ción")}
    return T.tag_clauses(clauses(spark, sf), "clause", kinds, "topic").groupBy("doc_id", "topic").agg(F.count("*").alias("n"))


@query("e23_dedupe_requirements", "SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def e23(spark, sf):
    from ..operators.versioning import latest_per_key

    return latest_per_key(table(spark, sf, "part"), ["p_brand", "p_size"], [F.asc("p_partkey")]).select("p_brand", "p_size", "p_partkey")


@query("a9_group_documents", "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) = 1 AS merged FROM part GROUP BY 1")
def a9(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), (F.min("p_type") == F.max("p_type")).alias("merged"))


@query("e24_score_table", "SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS criterion, CAST(l_quantity AS DOUBLE) AS points FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def e24(spark, sf):
    li = table(spark, sf, "lineitem")
    cell = F.when(F.col("l_returnflag") == "R", "협의").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("점")))
    rows = li.select("l_orderkey", F.lit(0).alias("table_no"), F.col("l_linenumber").alias("row_no"), F.array(F.col("l_linenumber").cast("string"), cell).alias("cells"))
    return T.score_table(rows, "l_orderkey").select("l_orderkey", "criterion", "points")


@query("e26_template_language", f"WITH {_LINES}, p AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '\\bthe\\b')) AS en, count(*) FILTER (regexp_matches(line, '\\bder\\b')) AS de FROM l GROUP BY 1) SELECT doc_id, CASE WHEN en >= 0.5 * n THEN 'en' WHEN de >= 0.5 * n THEN 'de' ELSE 'mixed' END AS language FROM p")
def e26(spark, sf):
    return T.template_language(T.lines(docs(spark, sf), "doc_id", "text"), "doc_id", {"en": r"\bthe\b", "de": r"\bder\b"})


@query("j10_ground_quotes", rf"""WITH {_CLAUSES}, q AS (SELECT item_id AS claim_id, CAST(item_id % 50 AS BIGINT) AS document_id, text AS quote FROM benchmark
UNION ALL SELECT 5000000 + doc_id * 100000 + clause_no, doc_id + CAST(clause_no % 3 = 2 AS INTEGER), clause FROM c),
src AS (SELECT doc_id AS document_id, regexp_replace(lower(text), '\s+', '', 'g') AS text FROM documents),
k AS (SELECT claim_id, document_id, regexp_replace(lower(quote), '\s+', '', 'g') AS quote FROM q)
SELECT claim_id, CASE WHEN src.document_id IS NULL THEN 'SOURCE_NOT_FOUND' WHEN quote <> '' AND contains(text, quote) THEN 'OK' ELSE 'QUOTE_MISMATCH' END AS result FROM k LEFT JOIN src USING (document_id)""")
def j10(spark, sf):
    """Every passage, claimed of a document, and every clause, claimed of its own or, every third, of the next document."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), (F.col("item_id") % 50).alias("document_id"), F.col("text").alias("quote"))
    c = numbered(spark, sf).select((5000000 + F.col("id")).alias("claim_id"), (F.col("doc_id") + (F.col("clause_no") % 3 == 2).cast("int")).alias("document_id"), F.col("clause").alias("quote"))
    s = docs(spark, sf).select(F.col("doc_id").alias("document_id"), F.lit("body").alias("source"), "text")
    return T.ground_quotes(b.unionByName(c).withColumn("source", F.lit("body")), s)


def numbered(spark, sf):
    return clauses(spark, sf).withColumn("id", F.col("doc_id") * 100000 + F.col("clause_no"))


@query("j12_near_duplicates")
def j12(spark, sf):
    """All clauses, the kind being the document's language; j12_members has the copies behind each id."""
    return T.near_duplicates(numbered(spark, sf).join(docs(spark, sf).select("doc_id", "lang"), "doc_id"), "id", "lang", "clause")


_NUMBERED = _CLAUSES + ", g AS (SELECT doc_id, doc_id * 100000 + clause_no AS id, clause, regexp_replace(lower(clause), '\\s+', '', 'g') AS t, array_to_string(list_sort(regexp_extract_all(clause, '\\d+')), ',') AS numbers FROM c)"


_ALTERED = _CLAUSES + ", e AS (SELECT doc_id, doc_id * 100000 + clause_no AS id, clause FROM c UNION ALL SELECT doc_id, doc_id * 100000 + clause_no + 50000, clause || ' x' FROM c WHERE clause_no % 5 = 0), g AS (SELECT doc_id, id, clause, regexp_replace(lower(clause), '\\s+', '', 'g') AS t, array_to_string(list_sort(regexp_extract_all(clause, '\\d+')), ',') AS numbers FROM e)"


def altered(spark, sf):
    """Clauses, and every fifth one again with a letter more."""
    n = numbered(spark, sf).select("doc_id", "clause_no", "id", "clause")
    more = n.where("clause_no % 5 = 0").select("doc_id", (F.col("id") + 50000).alias("id"), F.concat("clause", F.lit(" x")).alias("clause"))
    return n.drop("clause_no").unionByName(more)


@query("j12_in_documents", f"""WITH {_ALTERED}, d AS (SELECT doc_id, numbers, t, min(id) AS id FROM g WHERE t <> '' GROUP BY ALL),
k AS (SELECT doc_id, numbers, id, CASE WHEN length(t) <= 3 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) END AS grams FROM d),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.grams, b.grams)) AS n, len(a.grams) + len(b.grams) AS m FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.numbers = b.numbers AND a.id < b.id)
SELECT a, b FROM p WHERE n / (m - n) >= 0.72""")
def j12_documents(spark, sf):
    """The clauses of one document against each other."""
    return T.near_duplicates(altered(spark, sf), "id", "doc_id", "clause")


@query("j12_context_blocks", f"""WITH {_ALTERED}, d AS (SELECT doc_id, numbers, t, min(id) AS id FROM g WHERE length(t) >= 12 GROUP BY ALL),
k AS (SELECT doc_id, numbers, id, length(t) AS chars, list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5))) AS grams FROM d),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.grams, b.grams)) AS n, len(a.grams) + len(b.grams) AS m FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.numbers = b.numbers AND a.id < b.id AND least(a.chars, b.chars) >= 0.8 * greatest(a.chars, b.chars))
SELECT a, b FROM p WHERE n / (m - n) >= 0.88""")
def j12_blocks(spark, sf):
    """As j12_in_documents, by the rule of context blocks."""
    return T.near_duplicates(altered(spark, sf), "id", "doc_id", "clause", 5, 0.88, 0.8, 12)


@query("j13_in_documents")
def j13_documents(spark, sf):
    """The clauses of one document against each other."""
    return S.statement_pairs(numbered(spark, sf), "id", "clause", within="doc_id").select("a", "b", F.round("ratio", 6).alias("ratio"))


@query("j12_members", f"WITH {_NUMBERED} SELECT g.id, min(g.id) OVER (PARTITION BY lang, t) AS representative FROM g JOIN documents USING (doc_id) WHERE t <> ''")
def j12_members(spark, sf):
    c = numbered(spark, sf).join(docs(spark, sf).select("doc_id", "lang"), "doc_id")
    return T.members(c, "id", T.compact(F.col("clause")), "lang")


@query("j13_statement_pairs")
def j13(spark, sf):
    """All clauses; j13_members has the copies behind each id."""
    return S.statement_pairs(numbered(spark, sf), "id", "clause").select("a", "b", F.round("ratio", 6).alias("ratio"))


@query("j13_members", f"WITH {_CLAUSES}, k AS (SELECT doc_id * 100000 + clause_no AS id, regexp_replace(clause, '[\\s,·ㆍ『』「」]', '', 'g') AS t FROM c) SELECT id, min(id) OVER (PARTITION BY t) AS representative FROM k WHERE t <> ''")
def j13_members(spark, sf):
    return T.members(numbered(spark, sf), "id", S.statement_key(F.col("clause")))


@query("j16_uncovered", r"""WITH a AS (SELECT doc_id, regexp_extract(text, '^[^\n]*') AS text FROM documents), j AS (SELECT x.doc_id, x.text, y.text AS item FROM a x JOIN a y ON y.doc_id = x.doc_id + 1),
w AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS l, list_distinct(list_filter(string_split_regex(lower(item), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS r FROM j)
SELECT doc_id FROM w WHERE NOT (contains(regexp_replace(lower(item), '\s+', '', 'g'), regexp_replace(lower(text), '\s+', '', 'g')) OR (len(list_intersect(l, r)) / greatest(1, len(l)) >= 0.3 AND len(list_filter(regexp_extract_all(text, '\d+'), lambda n: NOT list_contains(regexp_extract_all(item, '\d+'), n))) = 0))""")
def j16(spark, sf):
    a = docs(spark, sf).select("doc_id", F.regexp_extract("text", "^[^\n]*", 0).alias("text"))
    keys = a.select((F.col("doc_id") - 1).alias("doc_id"))
    req = a.join(keys, "doc_id").withColumn("id", F.lit(1))
    return T.uncovered(req, a.withColumn("doc_id", F.col("doc_id") - 1), "doc_id", 0.3).select("doc_id")


@query("a7_merge_identical", f"WITH {_CLAUSES} SELECT clause AS statement, count(*) AS n, min(doc_id) AS first_id, array_to_string(list_sort(list(doc_id))[1:4], ',') AS ids FROM c GROUP BY 1")
def a7(spark, sf):
    out = T.merge_identical(clauses(spark, sf), "clause", "doc_id")
    return out.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("a13_duplicate_of", "SELECT doc_id, CASE WHEN m <> doc_id THEN m END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS m FROM documents)")
def a13(spark, sf):
    return T.duplicate_of(docs(spark, sf), "doc_id", "text")


@query("a12_retention", r"""WITH d AS (SELECT doc_id, text AS before, replace(text, 'e ', ' ') AS after FROM documents), k AS (SELECT *, contains(regexp_replace(lower(before), '\s+', '', 'g'), 'license') AS had, contains(regexp_replace(lower(after), '\s+', '', 'g'), 'license') AS has FROM d)
SELECT doc_id, had, had AND has AS kept, CAST(length(before) AS INTEGER) AS size_before, CAST(length(after) AS INTEGER) AS size_after FROM k""")
def a12(spark, sf):
    """The whole texts before and after a step that takes away some letters."""
    d = docs(spark, sf).select("doc_id", F.lit("Licen se").alias("fact"), F.col("text").alias("before"), F.replace("text", F.lit("e "), F.lit(" ")).alias("after"))
    return T.retention(d, "fact", "before", "after").select("doc_id", "had", "kept", "size_before", "size_after")


@query("e27_unsupported_numbers", r"""WITH n AS (SELECT x.doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(x.text, '\d+'), lambda k: NOT list_contains(regexp_extract_all(y.text, '\d+'), k)))) AS numbers FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1)
SELECT doc_id, array_to_string(numbers, ',') AS numbers FROM n WHERE len(numbers) > 0""")
def e27(spark, sf):
    d = docs(spark, sf)
    s = d.select("doc_id", F.lit(1).alias("id"), "text")
    out = T.unsupported_numbers(s, d.select((F.col("doc_id") - 1).alias("doc_id"), "text"), "doc_id")
    return out.select("doc_id", F.array_join(F.array_sort("numbers"), ",").alias("numbers"))
