"""Forms and score tables of notices: the language that a template asks for, and the points of criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .deadlines import places

# Languages, words of writing and of what is written, other files and fields, and negations beside a language.
KOREAN, ENGLISH = r"(?i)국문|한글|한국어|\bkorean\b", r"(?i)영문(?!명|주소|학)|영어|\benglish\b"
WRITE = r"(?i)작성|기재|\b(?:write|written|complete[d]?|fill(?:ed)?|prepare[d]?)\b"
SCOPE = (
    r"(?i)(?:본|이|해당)\s*(?:양식|서식|신청서|요약서|제안서|사업계획서|문서)|(?:전체|모든)\s*(?:항목|내용|본문|양식)|"
    r"\b(?:this|the|entire)\s+(?:form|application|proposal|document|summary)\b|\ball\s+(?:fields|sections|answers|responses)\b"
)
FORM_TITLE = r"(?i)양식|서식|신청서|요약서|제안서|계획서|\b(?:form|application|proposal|summary)\b"
OTHER_FILE = r"(?i)별첨|별도|다른\s*(?:양식|파일)|첨부\s*(?:파일|양식)|\b(?:separate|attachment)\b"
LOCAL_FIELD = r"(?i)기업명|회사명|성명|주소|\b(?:company name|full name|address)\b"
NEGATED_BEFORE = r"(?i)\bnot\s+(?:in\s+|using\s+)?$|\b(?:do|must) not (?:use|write in)\s*$"
NEGATED_AFTER = (
    r"(?i)^\s*(?:(?:으로|로|은|는|을|를)\s*)?(?:(?:작성|기재|사용)(?:은|는|을|를|이|가)?\s*)?(?:하지\s*(?:않|마)|금지|불필요|필수(?:가|는)?\s*아(?:니|님|닙)|대신)|"
    r"^\s*(?:(?:is|are)\s+)?(?:not\s+(?:required|necessary|allowed|permitted)|optional)\b"
)
ALONE = r"^(?:국문|한글|한국어|영문|영어)\s*(?:으로|로)?\s*(?:작성|기재)"
INSTRUCTION = r"(?i)^(?:please\s+)?(?:do not\s+)?(?:write|complete|fill|prepare|to be (?:written|completed))\b"
ENGLISH_NAME = r"(?i)영문(?!명|주소|학)|\benglish\b|\(영어\)|영어\s*(?:양식|서식|버전|요약)"
# Headers of criteria and of points, points, and how a table's limit is written.
CRITERION_HEADER, POINTS_HEADER = r"^(?:(?:가점|감점|우대)(?:사항|항목|조건|기준)|평가내용)$", r"^(?:가점|감점|점수|배점)$"
POINTS, LIMIT = r"^([+−–-]?)(\d+(?:\.\d+)?)점?$", r"(?:총|최대)\h*[−–-]?(\d+(?:\.\d+)?)\h*점(?:\h*이내|\h*한도)"


def _asks_for(line: Column, language: str) -> Column:
    """A line names the language without taking it back."""
    before, after = (lambda m: F.substring(line, F.lit(1), m.start)), (lambda m: F.substring(line, m.end + 1, F.length(line)))
    return F.exists(places(line, language), lambda m: ~before(m).rlike(NEGATED_BEFORE) & ~after(m).rlike(NEGATED_AFTER))


def writing_language(df: DataFrame, key: str, file: str, text: str) -> DataFrame:
    """(key, language): ko or en, by what a template says about itself, then by its file name, then by its letters.

    A line asks for a language if it is about writing the whole form, or stands among the first three and tells to write; one on another
    file or a single field does not.  An English that is optional or not asked for leaves Korean, as do mixed and empty forms.
    """
    lines = df.select(key, F.posexplode(F.filter(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")).alias("n", "line"))
    line = F.regexp_replace("line", r"^[ \t※*#•\[\]()]+|[ \t※*#•\[\]()]+$", "")
    lines = lines.select(key, "n", line.alias("line"))
    x, head = F.col("line"), F.col("n") < 3
    about = x.rlike(SCOPE) | (head & (x.rlike(ALONE) | x.rlike(INSTRUCTION) | x.rlike(FORM_TITLE)) & ~x.rlike(OTHER_FILE) & ~x.rlike(LOCAL_FIELD))
    told = F.when(_asks_for(x, KOREAN), "ko").when(_asks_for(x, ENGLISH), "en").when(x.rlike(ENGLISH), "ko")
    said = lines.where((F.length("line") <= 240) & x.rlike(WRITE) & about).select(key, told.alias("told"))
    said = said.groupBy(key).agg(F.bool_or(F.col("told") == "ko").alias("ko"), F.bool_or(F.col("told") == "en").alias("en"))
    name = F.regexp_replace(F.regexp_extract(F.coalesce(file, F.lit("")), r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    whole = F.coalesce(text, F.lit(""))
    foreign = ~whole.rlike("[가-힣ㄱ-ㅎㅏ-ㅣ]") & (F.size(F.regexp_extract_all(whole, F.lit("[A-Za-z]{2,}"), F.lit(0))) >= 4)
    out = F.when(F.coalesce("ko", F.lit(False)) | name.rlike(KOREAN), "ko").when(F.coalesce("en", F.lit(False)) | name.rlike(ENGLISH_NAME) | foreign, "en").otherwise("ko")
    return df.join(said, key, "left").select(key, out.alias("language"))


def score_tables(rows: DataFrame, key: str, notes: DataFrame | None = None) -> DataFrame:
    """(key, table_no, row_no, criterion, points, effect, total, most) of tables with a column of criteria and one of points.

    ``rows``: key, table_no, row_no (0 for the header), cells; ``notes``: key, table_no, note.  ``effect`` is deduction where the header
    says so, else bonus.  A row of another width, without criterion or with anything but points, and a sign against the table's effect
    reject the whole table.  ``total`` is the sum of a table's points, no more than ``most``, the limit that its notes name, null where none does.
    """
    on = [key, "table_no"]
    tight = F.transform("cells", lambda c: F.regexp_replace(c, r"\s+", ""))
    last = lambda cells, pattern: F.array_max(F.transform(cells, lambda c, i: F.when(c.rlike(pattern), i)))
    head = rows.where("row_no = 0").select(*on, tight.alias("names"))
    head = head.select(*on, "names", last(F.col("names"), CRITERION_HEADER).alias("c"), last(F.col("names"), POINTS_HEADER).alias("p")).where("c IS NOT NULL AND p IS NOT NULL")
    minus = (F.get("names", F.col("p")) == "감점") | F.contains(F.get("names", F.col("c")), F.lit("감점"))
    body = rows.where("row_no > 0").join(head.select(*on, F.size("names").alias("width"), "c", "p", minus.alias("minus")), on)
    cell = F.regexp_replace(F.get("cells", F.col("p")), r"\s+", "")
    body = body.select(*on, "row_no", "minus", F.size("cells").alias("n"), "width", F.trim(F.get("cells", F.col("c"))).alias("criterion"), F.regexp_extract(cell, POINTS, 1).alias("sign"), F.regexp_extract(cell, POINTS, 2).alias("points"))
    signed = F.when(F.col("minus"), F.col("sign") != "+").otherwise(F.col("sign").isin("", "+"))
    good = F.coalesce((F.col("n") == F.col("width")) & (F.col("criterion") != "") & (F.col("points") != "") & signed, F.lit(False))
    table = Window.partitionBy(*on)
    body = body.withColumn("good", F.min(good.cast("int")).over(table)).where("good = 1")
    limits = None if notes is None else notes.groupBy(*on).agg(F.array_join(F.array_sort(F.collect_list("note")), " ").alias("note"))
    body = body.withColumn("note", F.lit("")) if limits is None else body.join(limits, on, "left")
    most = F.regexp_extract(F.coalesce("note", F.lit("")), LIMIT, 1).try_cast("double")
    points = F.col("points").cast("double")
    total = F.least(F.sum(points).over(table), most)
    return body.select(*on, "row_no", "criterion", points.alias("points"), F.when(F.col("minus"), "deduction").otherwise("bonus").alias("effect"), total.alias("total"), most.alias("most"))
