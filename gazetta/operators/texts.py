"""Texts to tables: clauses, tables, headings, rule tags, facts, grounding and near-duplicate clauses.

All run over whole corpora: texts are exploded to lines or clauses once, rules are small literal tables joined
on the map side, and facts are grouped back by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_text, once, sentences
from ..sources.stages import staged
from .similarity import SMALL, meet_by_step, whole_places

#: Marks of table blocks in extracted text (fixed values).
TABLE_OPEN, TABLE_CLOSE = "[표]", "[/표]"
#: Subject and action of each legal risk (fixed values), and how far apart they may be.
RISK_RULES = {
    "DUPLICATE_SUPPORT": ("지원|수혜|신청|과제|사업\\s*내용", "중복|기지원|동일\\s*(?:과제|사업)"),
    "COST_DOUBLE_COUNTING": ("사업비|연구비|연구수당|비용|인건비|인력|참여율", "(?:중복|이중)(?:으로)?\\s*(?:계상|산정|청구|집행|반영|지급)"),
    "RESULT_IP_REUSE": ("지식\\s*재산(?:권)?|특허|저작권|연구\\s*성과|성과물", "귀속|소유|사용|활용|양도|실시|재사용|제3자|침해|확인"),
    "CONFIDENTIALITY": ("비밀\\s*정보|영업\\s*비밀|기밀|비공개\\s*자료|보안\\s*정보", "누설|공개|제공|반환|폐기|보호|유지|취급|사용|제3자"),
    "PROPOSAL_TEXT_REUSE": ("제안서|사업\\s*계획서|신청서", "표절|재사용|도용|복제|무단\\s*전재"),
}
RISK_REACH = 120
#: Words after which a clause is about the time after the award, and words of each requirement (fixed values).
AFTER_AWARD = ("선정후", "협약체결후", "평가결과확정", "사업종료후")
REQUIREMENTS = {
    "CONSORTIUM": (True, (("컨소시엄", "기관"), ("구성", "참여"), ("최소", "이상", "형태", "개기관"))),
    "SIMULTANEOUS_APPLICATION": (False, (("동시",), ("신청", "제출", "접수"), ("양국", "국내", "해외", "상대국", "정부"))),
    "CERTIFICATION": (False, (("인정서", "인증서", "허가증"), ("보유", "필수", "하여야", "해야"))),
    "OPERATING_PERIOD": (True, (("창업", "설립", "사업개시"), ("년",), ("이상", "경과", "이내", "미만"))),
}
#: Texts of a block that meets as a whole, of a bucket of a larger one, cells of a band's counts, and pairs that leave a task at once.
FEW, BUCKET, BAND_CELLS, WAITING = 2048, 32_768, 1 << 21, 10_000
_MIX, _NO_LETTER = np.uint64(0x9E3779B97F4A7C15), 0x110000


def search_profile(df: DataFrame, key: str, text: str, purpose: str) -> DataFrame:
    """(key, title, purpose): first sentence, and the section that ``purpose`` finds, else the second sentence; both bounded."""
    title = F.substring(F.regexp_extract(text, r"^[^.\n]*", 0), 1, 200)
    found = F.trim(F.regexp_extract(text, purpose, 1))
    second = F.trim(F.substring(F.regexp_extract(text, r"^[^.\n]*[.\n]+([^.\n]*)", 1), 1, 300))
    return df.select(key, title.alias("title"), F.when(found != "", found).otherwise(second).alias("purpose"))


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key) of the keys that only one table has; empty if both have the same."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").select(F.lit("left").alias("side"), key).unionByName(
        right.join(left, key, "left_anti").select(F.lit("right").alias("side"), key)
    )


def single_value_facts(facts: DataFrame, keys: list[str], value: str, blocked: str) -> DataFrame:
    """Facts of which exactly one distinct value is known and none is blocked."""
    return (
        facts.groupBy(*keys)
        .agg(F.min(value).alias(value), F.max(value).alias("__max"), F.bool_or(blocked).alias("__blocked"))
        .where(F.col(value).isNotNull() & (F.col(value) == F.col("__max")) & ~F.col("__blocked"))
        .drop("__max", "__blocked")
    )


def source_parts(df: DataFrame, key: str, text: str, marker: str = r"\[파일: ([^\]]*)\]") -> DataFrame:
    """(key, part_no, name, text): a text cut at its archive members' marks; the first part has no name."""
    parts = F.split(F.coalesce(text, F.lit("")), marker)
    names = F.concat(F.array(F.lit("")), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(marker), F.lit(1)))
    rows = df.select(key, F.posexplode(F.arrays_zip(names.alias("name"), parts.alias("text"))).alias("part_no", "p"))
    return rows.select(key, "part_no", F.col("p.name").alias("name"), F.trim("p.text").alias("text")).where("text <> ''")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): lines with white space settled; blank ones keep their number and are left out."""
    rows = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\R")).alias("line_no", "line"))
    return rows.withColumn("line", normalize_text(F.col("line"))).where("line <> ''")


def clauses(df: DataFrame, key: str, text: str, least: int = 15, most: int = 300) -> DataFrame:
    """(key, clause_no, clause): sentences and lines without bullets, of a bounded length; each is cleaned once, in its text's row."""
    clean = lambda s: normalize_text(F.regexp_replace(s, r"^[\s○●■□▪·\-*]+", ""))
    rows = df.select(key, F.posexplode(F.transform(sentences(F.col(text)), clean)).alias("clause_no", "clause"))
    return rows.where(F.length("clause").between(least, most))


def table_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, row_no, cells) of table blocks whose rows all have the same number of cells, two or more."""
    block = r"(?s)\[표\]\s*(.*?)\s*\[/표\]"
    t = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(block), F.lit(1))).alias("table_no", "block"))
    rows = F.filter(F.transform(F.split("block", r"\R"), lambda r: F.split(r, "\t")), lambda r: F.array_join(r, "") != "")
    t = t.withColumn("rows", F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(c))))
    width = F.size(F.get("rows", F.lit(0)))
    whole = F.forall("rows", lambda r: F.size(r) == width) & (width >= 2)
    return t.where((F.size("rows") > 0) & whole).select(key, "table_no", F.posexplode("rows").alias("row_no", "cells"))


def tokens(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, kind, start, end, token): every match with its offsets in characters, end exclusive."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("hits"), F.split(text, p).alias("gaps")) for k, p in patterns.items()])
    rows = df.select(key, F.explode(kinds).alias("t")).select(key, "t.kind", F.posexplode("t.hits").alias("i", "token"), F.col("t.gaps").alias("gaps"), F.col("t.hits").alias("hits"))
    before = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    start = before(F.col("gaps"), F.col("i") + 1) + before(F.col("hits"), F.col("i"))
    rows = rows.withColumn("start", start.cast("long")).withColumn("end", F.col("start") + F.length("token"))
    return rows.select(key, "kind", "start", "end", "token")


def carry_heading(rows: DataFrame, key: str, heading: Column, most: int = 60) -> DataFrame:
    """Lines with the heading above them (within ``most`` lines) and the number of their block; a heading opens a block."""
    order = Window.partitionBy(key).orderBy("line_no")
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__head", F.when(heading, F.struct(F.col("line_no").alias("at"), F.col("line").alias("text"))))
    out = out.withColumns({"__last": F.last("__head", ignorenulls=True).over(up), "block": F.sum(F.when(heading, 1).otherwise(0)).over(up)})
    near = F.col("line_no") - F.col("__last.at") <= most
    return out.withColumn("heading", F.when(near, F.col("__last.text"))).drop("__head", "__last")


def strip_reference(rows: DataFrame, key: str, heading: Column, reference: str) -> DataFrame:
    """Lines that stand under no heading of a reference section (contents, examples, appended forms)."""
    return carry_heading(rows, key, heading).where(~F.coalesce(F.col("heading").rlike(reference), F.lit(False)))


def merge_lines(rows: DataFrame, key: str, continues: Column) -> DataFrame:
    """(key, clause_no, text): lines joined to the one before where ``continues`` holds."""
    order = Window.partitionBy(key).orderBy("line_no")
    first = F.row_number().over(order) == 1
    group = F.sum(F.when(continues & ~first, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    grouped = rows.withColumn("clause_no", group).groupBy(key, "clause_no").agg(parts.alias("parts"))
    return grouped.select(key, "clause_no", F.array_join(F.transform("parts", lambda p: p.line), " ").alias("text"))


def tag_clauses(rows: DataFrame, clause: str, patterns: dict[str, str], name: str = "tag") -> DataFrame:
    """One row for each clause and pattern that it shows."""
    hits = F.array_compact(F.array(*[F.when(F.col(clause).rlike(p), k) for k, p in patterns.items()]))
    return rows.withColumn(name, F.explode(hits))


def tag_risks(rows: DataFrame, clause: str, rules: dict[str, tuple[str, str]] = RISK_RULES, reach: int = RISK_REACH) -> DataFrame:
    """Clauses with each risk whose subject and action they show within ``reach`` characters of each other."""
    hits = []
    for kind, (subject, action) in rules.items():
        near = f"(?is)(?:{subject}).{{0,{reach}}}?(?:{action})|(?:{action}).{{0,{reach}}}?(?:{subject})"
        hits.append(F.when(F.col(clause).rlike(near), kind))
    return rows.withColumn("risk", F.explode(F.array_compact(F.array(*hits))))


def risk_findings(docs: DataFrame, tagged: DataFrame, key: str, missing_text: str, types: list[str], cap: int = 6) -> DataFrame:
    """(key, risk, n, status) for every document and type: found, over the cap, text missing, or not found."""
    per = tagged.groupBy(key, "risk").agg(F.count("*").alias("n"))
    every = docs.select(key, missing_text, F.explode(F.array(*map(F.lit, types))).alias("risk"))
    joined = every.join(per, [key, "risk"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") > cap, "INCOMPLETE").when(F.col("n") > 0, "CANDIDATE").when(F.col(missing_text), "DATA_INSUFFICIENT").otherwise("NOT_FOUND")
    return joined.select(key, "risk", "n", status.alias("status"))


def requirement_kind(clause: Column, rules: dict = REQUIREMENTS, after: tuple[str, ...] = AFTER_AWARD) -> Column:
    """The requirement that a clause states; each rule asks for one word of each of its groups, some for a number too."""
    return once(F.regexp_replace(clause, r"\s+", ""), lambda tight: _requirement_kind(tight, rules, after))


def _requirement_kind(tight: Column, rules: dict, after: tuple[str, ...]) -> Column:
    some = lambda words: tight.rlike("|".join(words))
    out = F.when(some(after), F.lit(None).cast("string")) if after else F.when(F.lit(False), "")
    for kind, (number, groups) in rules.items():
        ok = tight.rlike(r"\d") if number else F.lit(True)
        for g in groups:
            ok = ok & some(g)
        out = out.when(ok, kind)
    return out


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")


def ground_quotes(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims (claim_id, document_id, source, quote) with a result: OK, SOURCE_NOT_FOUND, AMBIGUOUS_SOURCE or QUOTE_MISMATCH.

    ``sources``: document_id, source, text.  A quote must occur in the one source of that name, white space aside.  Texts and quotes
    are made compact before they meet, each once.
    """
    claims = claims.select("claim_id", "document_id", "source", compact(F.col("quote")).alias("quote"))
    sources = sources.select("document_id", "source", F.when(F.col("text").isNotNull(), compact(F.col("text"))).alias("text"))
    named = claims.join(sources, ["document_id", "source"], "left")
    hit = F.contains("text", F.col("quote")) & (F.col("quote") != "")
    per = named.groupBy("claim_id").agg(F.count("text").alias("n"), F.count_if(hit).alias("hits"))
    code = F.when(F.col("n") == 0, "SOURCE_NOT_FOUND").when(F.col("n") > 1, "AMBIGUOUS_SOURCE").when(F.col("hits") == 1, "OK").otherwise("QUOTE_MISMATCH")
    return per.select("claim_id", code.alias("result"))


def near_duplicates(rows: DataFrame, key: str, kind: str, text: str, n: int = 3, threshold: float = 0.72, lengths: float = 0.0, least: int = 1, few: int = FEW, bucket: int = BUCKET) -> DataFrame:
    """(a, b): ids of near-duplicate texts of one kind with the same sorted numbers and an n-gram Jaccard of ``threshold`` or more.

    Texts of under ``least`` characters without white space take no part; with ``lengths`` the shorter has that share of the longer one's
    characters or more (context blocks of notices: n 5, threshold 0.88, lengths 0.8, least 12).  Equal texts are joined once: only
    distinct texts are compared, and each stands for its smallest id.  A block (kind and numbers) of up to ``few`` texts meets as
    a whole in one task.  One of more is cut by the number of its texts' grams, and only buckets that can be alike meet, each pair of
    them in a task of its own: work that grows with the block's square.  Tasks leave pairs out by bounds (``_Sketches``); those that
    are left take their texts along, which become grams again to decide.
    """
    tight = F.regexp_replace(F.lower(text), r"\s+", "")
    numbers = F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))), ",")
    rows = rows.select(F.col(key).alias("id"), F.xxhash64(F.col(kind), numbers).alias("place"), tight.alias("t")).where(F.length("t") >= max(1, least))
    rows = staged(rows)
    large = staged(rows.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > few).select("place"))
    large = F.broadcast(large) if large.count() <= SMALL else large
    small = rows.join(large, "place", "left_anti").select("place", F.lit("own").alias("side"), "id", "t")
    small = small.repartition("place").sortWithinPartitions("place")
    distinct = staged(rows.join(large, "place").groupBy("place", "t").agg(F.min("id").alias("id")))
    distinct = distinct.withColumn("step", F.floor(4 * F.log2(F.size(_grams("t", n)))))  # numbers of grams a quarter of an octave apart
    met = meet_by_step(distinct, ["place"], int(np.ceil(4 * np.log2(1 / threshold) + 1e-6)), bucket)
    met = met.select(F.concat_ws(":", F.col("place").cast("string"), "cell").alias("place"), "side", "id", "t")
    met = met.repartition("place").sortWithinPartitions("place")
    schema = f"a {dict(rows.dtypes)['id']}, b {dict(rows.dtypes)['id']}, t_a string, t_b string"
    compare = lambda batches: _near(batches, n, threshold)
    pairs = met.mapInPandas(compare, schema).unionByName(small.mapInPandas(compare, schema))
    pairs = pairs.where(F.least(F.length("t_a"), F.length("t_b")) >= lengths * F.greatest(F.length("t_a"), F.length("t_b")))
    met = pairs.select("a", "b", _grams("t_a", n).alias("grams_a"), _grams("t_b", n).alias("grams_b"))
    met = met.select("a", "b", F.size("grams_a").alias("na"), F.size("grams_b").alias("nb"), F.size(F.array_intersect("grams_a", "grams_b")).alias("both"))
    return met.where(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) >= threshold).select("a", "b")


class _Sketches:
    """Texts' different n-grams, counted in a few columns by hash: the product of two texts' counts is no less than the number of grams they share."""

    def __init__(self, texts: list[str], n: int):
        length = np.array([len(t) for t in texts], int)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
        count = np.maximum(length - n, 0) + 1  # a text that is no longer than a gram is its own
        owner = np.repeat(np.arange(len(texts)), count)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start, rest = np.repeat(np.cumsum(length) - length, count) + offset, np.repeat(length, count) - offset
        h = np.zeros(len(owner), np.uint64)
        for k in range(n):
            code = np.where(k < rest, codes[np.minimum(start + k, len(codes) - 1)], _NO_LETTER)
            h = h * _MIX + code.astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        order = np.argsort((owner.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        h, owner = h[order], owner[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
        self.h, self.size = h[new], np.bincount(owner[new], minlength=len(texts))
        self.end = np.cumsum(self.size)

    def counts(self, rows: np.ndarray, columns: int) -> np.ndarray:
        """One row of counts for each text of ``rows``."""
        size = self.size[rows]
        at = np.repeat(self.end[rows] - np.cumsum(size), size) + np.arange(size.sum())
        cell = np.repeat(np.arange(len(rows)), size) * columns + (self.h[at] & np.uint64(columns - 1)).astype(int)
        return np.bincount(cell, minlength=len(rows) * columns).reshape(len(rows), columns).astype(np.float32)


def _alike(sketches: _Sketches, left: np.ndarray, right: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of texts ``left`` and ``right`` (None: within ``left``) that may have a Jaccard of ``threshold``, a band of each side at a time.

    They need ``threshold / (1 + threshold)`` of both sizes in common, and sizes that far apart at most.
    """
    share, size = threshold / (1 + threshold), sketches.size
    most = int(size[left].max() if right is None else max(size[left].max(), size[right].max()))
    columns = 1 << int(np.clip(np.ceil(np.log2(2.5 * most)), 6, 14))
    band, slack = int(np.clip(BAND_CELLS // columns, 64, 2048)), 0.01 + 1e-5 * most

    def bands(rows: np.ndarray, first: bool) -> list:
        rows = rows[np.argsort(size[rows], kind="stable")]
        cut = [rows[k : k + band] for k in range(0, len(rows), band)]
        need = lambda r: (share * size[r]).astype(np.float32)
        sides = lambda r: [need(r), np.ones(len(r), np.float32)] if first else [-np.ones(len(r), np.float32), -need(r)]
        return [(r, int(size[r[0]]), int(size[r[-1]]), np.column_stack([sketches.counts(r, columns), *sides(r)])) for r in cut]

    a = bands(left, True)
    b = bands(left if right is None else right, False)
    for k, (x, lo, hi, p) in enumerate(a):
        for m, (y, low, high, q) in enumerate(b):
            if (right is None and m < k) or high < threshold * lo - 1e-9 or hi < threshold * low - 1e-9:
                continue
            i, j = np.divmod(np.flatnonzero(p @ q.T >= -slack), len(y))
            if right is None and m == k:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield x[i], y[j]


def _near(batches: Iterator[pd.DataFrame], n: int, threshold: float) -> Iterator[pd.DataFrame]:
    """Pairs (a, b, t_a, t_b) of each place (place, side, id, t) that may be near duplicates; equal texts stand for their smallest id."""
    for rows in whole_places(batches):
        rows = rows.groupby(["place", "side", "t"], sort=False, as_index=False)["id"].min()
        at, sides, texts, ids = (rows[c].to_numpy() for c in ("place", "side", "t", "id"))
        cuts = np.r_[0, np.nonzero(at[1:] != at[:-1])[0] + 1, len(at)]
        alone = np.diff(cuts) < 2
        if alone.all():
            continue
        sketches, waiting, size = _Sketches(texts.tolist(), n), [], 0
        for x, y in zip(cuts[:-1][~alone].tolist(), cuts[1:][~alone].tolist()):
            place = np.arange(x, y)
            left, right = (place, None) if sides[x] == "own" else (place[sides[x:y] == "left"], place[sides[x:y] == "right"])
            if not len(left) or (right is not None and not len(right)):
                continue
            for i, j in _alike(sketches, left, right, threshold):
                waiting.append((i, j))
                size += len(i)
                if size >= WAITING:
                    yield _pairs(ids, texts, waiting)
                    waiting, size = [], 0
        if waiting:
            yield _pairs(ids, texts, waiting)


def _pairs(ids: np.ndarray, texts: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    i, j = (np.concatenate(side) for side in zip(*pairs))
    i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
    return pd.DataFrame({"a": ids[i], "b": ids[j], "t_a": texts[i], "t_b": texts[j]})


def _grams(text: str, n: int) -> Column:
    """The different n-grams of a text; a shorter one is its own."""
    return F.expr(f"if(length({text}) <= {n}, array({text}), array_distinct(transform(sequence(1, length({text}) - {n - 1}), i -> substring({text}, i, {n}))))")


def members(rows: DataFrame, key: str, text: Column, *within: str) -> DataFrame:
    """(id, representative) of every row: equal texts, of equal ``within``, stand for their smallest id; empty ones are left out."""
    rows = rows.select(F.col(key).alias("id"), *within, text.alias("t")).where("t <> ''")
    first = rows.groupBy(*within, "t").agg(F.min("id").alias("representative"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*within, "t")]
    return rows.alias("r").join(first.alias("f"), same).select("id", "representative")


def uncovered(requirements: DataFrame, items: DataFrame, key: str, least: float = 0.65) -> DataFrame:
    """Requirements (key, id, text) that no item (key, text) of theirs covers: as a part, or by words of which ``least`` agree, numbers all."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)))
    joined = requirements.join(items.select(key, F.col("text").alias("__item")), key)
    share = F.size(F.array_intersect(words(F.col("text")), words(F.col("__item")))) / F.greatest(F.lit(1), F.size(words(F.col("text"))))
    all_numbers = F.size(F.array_except(numbers(F.col("text")), numbers(F.col("__item")))) == 0
    covers = F.contains(compact(F.col("__item")), compact(F.col("text"))) | ((share >= least) & all_numbers)
    return requirements.join(joined.where(covers).select(key, "id").distinct(), [key, "id"], "left_anti")


def merge_identical(df: DataFrame, text: str, key: str, most: int = 4) -> DataFrame:
    """(text, n, first_id, ids): identical statements as one, with the first ``most`` ids; the rest are only counted.

    The ids come from the ``most`` smallest of each statement, ranked before they are gathered.
    """
    same = normalize_text(F.col(text))
    rows = df.select(same.alias("statement"), F.col(key).alias("id"))
    turn = Window.partitionBy("statement").orderBy("id")
    few = rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= most)
    few = few.groupBy("statement").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return rows.groupBy("statement").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).join(few, "statement")


def duplicate_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, duplicate_of): the smallest id of equal texts, null for itself; copies meet as hashes, not as texts."""
    hashed = df.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min(key).alias("first"))
    return hashed.join(first, "h").select(key, F.when(F.col(key) != F.col("first"), F.col("first")).alias("duplicate_of"))


def ordered_rules(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern a text shows."""
    out = F.when(F.lit(False), "")
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def best_per_type(rows: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """The best candidate of each document: highest score, then earliest."""
    turn = Window.partitionBy(key).orderBy(F.desc(score), order)
    return rows.withColumn("__n", F.row_number().over(turn)).where("__n = 1").drop("__n")


def business_types(rows: DataFrame, key: str, patterns: dict[str, str], title: str) -> DataFrame:
    """(key, type, score): of the types that a document's lines and title show, the best: lines count once each, a title match 20."""
    hits = tag_clauses(rows, "line", patterns, "type").groupBy(key, "type").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    heads = rows.where("line_no = 0").select(key, F.col("line").alias(title))
    named = tag_clauses(heads, title, patterns, "type").select(key, "type", F.lit(20).alias("bonus"))
    scored = hits.join(named, [key, "type"], "left").withColumn("score", F.col("n") + F.coalesce("bonus", F.lit(0)))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "first", "type")
    return scored.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(key, "type", "score")


def contacts(rows: DataFrame, key: str, context: str) -> DataFrame:
    """(key, line_no, email, phone) of lines that stand within two lines of an inquiry word."""
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(-2, 0)
    near = F.max(F.when(F.col("line").rlike(context), 1).otherwise(0)).over(order) == 1
    email = F.regexp_extract("line", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0)
    phone = F.regexp_extract("line", r"\+?[0-9][0-9 ().-]{7,}[0-9]", 0)
    found = rows.withColumn("near", near).select(key, "line_no", "near", email.alias("email"), phone.alias("phone"))
    return found.where("near AND (email <> '' OR phone <> '')").drop("near")


def template_language(rows: DataFrame, key: str, marks: dict[str, str], least: float = 0.5) -> DataFrame:
    """(key, language): the language whose letters or words make up ``least`` of a text's marked lines, else mixed."""
    counts = {k: F.count_if(F.col("line").rlike(p)).alias(k) for k, p in marks.items()}
    per = rows.groupBy(key).agg(F.count("*").alias("__n"), *counts.values())
    out = F.when(F.lit(False), "")
    for k in marks:
        out = out.when(F.col(k) >= least * F.col("__n"), k)
    return per.select(key, out.otherwise("mixed").alias("language"))


def retention(cases: DataFrame, fact: str, before: str, after: str) -> DataFrame:
    """Cases with whether the fact was and still is contained, and the sizes."""
    has = lambda c: F.contains(compact(F.col(c)), compact(F.col(fact)))
    return cases.withColumns({"had": has(before), "kept": has(before) & has(after), "size_before": F.length(before), "size_after": F.length(after)})


def unsupported_numbers(statements: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, id, numbers): numbers of a statement that its document's text does not have."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)))
    joined = statements.join(sources.select(key, F.col("text").alias("__source")), key)
    out = joined.withColumn("numbers", F.array_except(numbers(F.col("text")), numbers(F.col("__source"))))
    return out.where(F.size("numbers") > 0).select(key, "id", "numbers")


def score_table(rows: DataFrame, key: str) -> DataFrame:
    """(key, table_no, criterion, points) of two-column tables whose second column is all numbers; any other cell rejects the table."""
    body = rows.where("row_no > 0 AND size(cells) = 2").select(key, "table_no", F.get("cells", F.lit(0)).alias("criterion"), F.get("cells", F.lit(1)).alias("cell"))
    body = body.withColumn("points", F.regexp_replace("cell", "[점+ ]", "").try_cast("double"))
    good = F.min(F.col("points").isNotNull().cast("int")).over(Window.partitionBy(key, "table_no")) == 1
    return body.withColumn("good", good).where("good").select(key, "table_no", "criterion", "points")


def single_deadline(df: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, deadline): the one date that follows a label in a text; null where none or several different ones do."""
    pattern = label + r"\D{0,40}?((?:19|20)\d\d)[-./년 ]{1,2}(\d{1,2})[-./월 ]{1,2}(\d{1,2})"
    hits = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2, 3)]
    dates = F.transform(F.arrays_zip(*[h.alias(f"g{i}") for i, h in enumerate(hits)]), lambda z: F.try_to_date(F.concat_ws("-", z.g0, F.lpad(z.g1, 2, "0"), F.lpad(z.g2, 2, "0")), "yyyy-MM-dd"))
    distinct = F.array_distinct(F.array_compact(dates))
    return df.select(key, F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).alias("deadline"))
