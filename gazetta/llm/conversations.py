"""Conversation structure repair: turns aligned to the alternating grammar ``(s?(ua)+)?`` by Wagner-Fischer.

The target strings of all feasible lengths end alike, so one matrix counted from their ends holds the alignments to every
length; Ukkonen's bands about its diagonal come from the cost of a plain repair.  Of the cheapest alignments the audit that is
least in ASCII is traced.  A long conversation is cut into parts, each aligned from every state of the grammar to every other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, join_once, ranked, same, small_side, staged
from .decontamination import once

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A conversation with more rows or bytes is aligned in parts of PART rows.
ROWS, BYTES, PART = 256, 16_000_000, 256
#: States of the grammar: nothing yet, after the system turn, after a user, after an assistant; and what ends a conversation there.
START, SYSTEM, USER, ASSISTANT = range(4)
_ENDS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
_BLANKS = " \t\n\x0b\f\r"
_ROLES = {"u": "user", "a": "assistant"}


def _matrix(code: str, last: str, most: int) -> list[list[float]]:
    """Least costs of the rows from each one on with k target symbols left, the last being ``last``; infinite beyond ``most``."""
    n, other = len(code), "ua"[last == "u"]
    inf = float("inf")
    width = n + most // INSERT + 2
    below = [0.0] + [inf] * (width - 1)
    out = [below]
    for i in range(n - 1, -1, -1):
        row, left = [inf] * width, n - i
        symbol = code[i]
        own, extra = symbol.lower(), TRUNCATED * symbol.isupper()
        for k in range(max(0, left - most // DELETE), min(width - 1, left + most // INSERT) + 1):
            best = below[k] + DELETE
            if k:
                best = min(best, row[k - 1] + INSERT)
                if symbol != "D":
                    best = min(best, below[k - 1] + extra + REROLE * (own != (last if k % 2 else other)))
            if best <= most:
                row[k] = best
        out.append(row)
        below = row
    return out[::-1]


def _trace(code: str, matrix: list[list[float]], i: int, k: int, last: str) -> str:
    """The least of the cheapest audits from row ``i`` on with ``k`` symbols left."""
    audit, other = [], "ua"[last == "u"]
    while i < len(code):
        if matrix[i + 1][k] + DELETE == matrix[i][k]:
            audit.append("D")
            i += 1
        elif k and matrix[i][k - 1] + INSERT == matrix[i][k]:
            audit.append("I")
            k -= 1
        else:
            audit.append("K" if code[i].lower() == (last if k % 2 else other) else "R")
            i, k = i + 1, k - 1
    return "".join(audit)


def _plain_cost(code: str) -> int:
    """The cost of a repair row by row, which bounds the best."""
    cost, expected = 0, "u"
    for symbol in code:
        edit = DELETE if symbol == "D" else TRUNCATED * symbol.isupper() + REROLE * (symbol.lower() != expected)
        if symbol == "D" or edit > DELETE:
            cost += DELETE
        else:
            cost, expected = cost + edit, "ua"[expected == "u"]
    return cost


@lru_cache(maxsize=1 << 14)
def transfers(code: str, entries: tuple[int, ...] = (START,)) -> dict[tuple[int, int], tuple[int, str]]:
    """For each state before and after the rows the least cost and its least audit; every audit ends with a row's own edit.

    ``code`` has a letter a row: s, u, a, or x for other roles, in capitals where truncated; D where it must be deleted.
    """
    n, found = len(code), {}
    if not n:
        return {(e, e): (0, "") for e in entries}
    # an insertion before the first row, and one with a new role at the last, lead from any state to any other
    most = _plain_cost(code) + 2 * INSERT + REROLE
    offers = {(e, e): [(DELETE * n, "D" * n)] for e in entries}
    for last, leave in (("u", USER), ("a", ASSISTANT)):
        matrix = _matrix(code, last, most)
        for enter in entries:
            first = "a" if enter == USER else "u"
            starts = [(k, 0, 0) for k in range(1 if first == last else 2, len(matrix[0]), 2)]
            if enter == START:  # a system turn is kept, all before it are deleted
                kept = [i for i in range(n) if code[i].lower() == "s"]
                starts += [(k, i + 1, DELETE * i + TRUNCATED * code[i].isupper()) for i in kept for k in range(1 if last == "u" else 2, len(matrix[0]), 2)]
            costs = [(before + matrix[i][k], k, i) for k, i, before in starts if before + matrix[i][k] <= most]
            least = min((c for c, _, _ in costs), default=None)
            for cost, k, i in costs:
                if cost == least:
                    offers.setdefault((enter, leave), []).append((int(cost), ("D" * (i - 1) + "K" if i else "") + _trace(code, matrix, i, k, last)))
    if START in entries:
        for i in range(n):
            if code[i].lower() == "s":
                offers.setdefault((START, SYSTEM), []).append((DELETE * (n - 1) + TRUNCATED * code[i].isupper(), "D" * i + "K" + "D" * (n - 1 - i)))
    for way, some in offers.items():
        found[way] = min(some)
    return found


def align(code: str) -> tuple[int, str]:
    """The least cost of a whole conversation and its least audit."""
    return min((cost + _ENDS[leave][0], audit + _ENDS[leave][1]) for (_, leave), (cost, audit) in transfers(code).items())


def outcome(code: str, audit: str, state: int = START) -> tuple[list[int], list[str]]:
    """For each repaired turn its row in ``code``, -1 where inserted, and its new role, empty where it keeps its own."""
    at, roles, i = [], [], 0
    for edit in audit:
        if edit != "D":
            system = edit == "K" and state == START and code[i].lower() == "s"
            state = SYSTEM if system else ASSISTANT if state == USER else USER
            at.append(-1 if edit == "I" else i)
            roles.append("" if edit == "K" else _ROLES["ua"[state == ASSISTANT]])
        i += edit != "I"
    return at, roles


def _aligned(codes: pd.Series) -> pd.DataFrame:
    out = []
    for code in codes:
        cost, audit = align(code)
        out.append((cost, audit, *outcome(code, audit)))
    return pd.DataFrame(out, columns=["cost", "audit", "at", "roles"])


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``times`` of ``rows`` with faults by crc32(``conv_id:turn``) % 20; a null is one space in texts.

    0 drops a row (times 0), 1 empties its text, 2 takes its ``[.!?]``, 3 repeats it (times 2), 4 makes its role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(fault.isin(0, 1), "").when(fault == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), times.alias("times"))


def _fault(text: Column, seen: Column) -> Column:
    """b, d, t or k: blank, duplicate, truncated, or none of these."""
    bare = F.rtrim(text, F.lit(_BLANKS))
    return F.when(bare == "", "b").when(seen, "d").when(F.substring(bare, -1, 1).isin(".", "!", "?"), "k").otherwise("t")


def _symbol(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(fault.isin("b", "d"), "D").when(fault == "t", F.upper(own)).otherwise(own)


def _legal(before: Column, after: Column) -> Column:
    return F.concat(F.substring(before, 1, 1), F.substring(after, 1, 1)).isin("su", "ua", "au")


def _described(rows: Column) -> Column:
    """Rows, letters and counts of an ordered array of (turn, role, text)."""

    def about(rows: Column, keys: Column) -> Column:
        faults = F.transform(rows, lambda r, i: _fault(r.text, F.array_position(keys, F.get(keys, i)) <= i))
        turns = F.array_compact(F.array_distinct(F.transform(rows, lambda r: r.turn)))
        pairs = F.filter(rows, lambda r, i: (i > 0) & ~_legal(F.get(rows, F.greatest(i - 1, F.lit(0))).role, r.role))
        gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(turns), F.lit(0))
        return F.struct(rows.alias("rows"), faults.alias("faults"), gaps.cast("long").alias("gaps"), F.size(pairs).cast("long").alias("illegal"))

    keys = lambda rows: F.transform(rows, lambda r: F.struct(r.role, r.text))
    return once(rows, lambda rows: once(keys(rows), lambda k: about(rows, k)))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of few rows, each in one row of its own."""
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "times"))).alias("rows"))
    each = each.select("conv_id", _described(F.flatten(F.transform("rows", lambda r: F.array_repeat(r, r.times)))).alias("d"))
    letters = F.array_join(F.transform("d.rows", lambda r, i: _symbol(r.role, F.get("d.faults", i))), "")
    repaired = F.pandas_udf(_aligned, "cost long, audit string, at array<int>, roles array<string>")
    each = each.select("conv_id", "d", letters.alias("code")).withColumn("repair", repaired("code"))

    def line(at: Column, k: Column) -> Column:
        row, role = F.get("d.rows", at), F.get("repair.roles", k)
        return F.concat(F.when(role == "", row.role).otherwise(role), F.lit(":"), F.when(at < 0, "").otherwise(row.text))

    lines = F.transform("repair.at", line)
    count = lambda f: F.size(F.filter("d.faults", lambda x: x == f)).cast("long")
    return each.select(
        "conv_id", "d.gaps", count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"), "d.illegal", "repair.cost", "repair.audit",
        F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )


def _ways(codes: pd.Series) -> pd.DataFrame:
    """Costs and audits from state to state, 16 of each, and the order of the audits."""
    out = []
    for code in codes:
        ways = transfers(code, (START, SYSTEM, USER, ASSISTANT))
        audits = [ways.get((a, b), (0, None))[1] for a in range(4) for b in range(4)]
        order = {audit: i for i, audit in enumerate(sorted(x for x in audits if x is not None))}
        out.append(([ways[a, b][0] if (a, b) in ways else -1 for a in range(4) for b in range(4)], audits, [order.get(x, -1) for x in audits]))
    return pd.DataFrame(out, columns=["costs", "audits", "order"])


def _path(parts: pd.DataFrame) -> pd.DataFrame:
    """The states that a conversation's cheapest alignment passes at its parts, the least audit among equals."""
    parts = parts.sort_values("part")
    costs, order = parts["costs"].tolist(), parts["order"].tolist()
    inf = float("inf")
    rest = [[_ENDS[s][0] for s in range(4)]]
    for c in reversed(costs):
        rest.append([min((c[4 * a + b] + rest[-1][b] for b in range(4) if c[4 * a + b] >= 0), default=inf) for a in range(4)])
    rest.reverse()
    state, enters, leaves = START, [], []
    for i, (c, o) in enumerate(zip(costs, order)):
        best = [b for b in range(4) if c[4 * state + b] >= 0 and c[4 * state + b] + rest[i + 1][b] == rest[i][state]]
        leave = min(best, key=lambda b: o[4 * state + b])
        enters.append(state)
        leaves.append(leave)
        state = leave
    return pd.DataFrame({"conv_id": parts["conv_id"], "part": parts["part"], "enter": enters, "leave": leaves, "cost": int(rest[0][START])})


def _spread(codes: pd.Series, audits: pd.Series, enters: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([outcome(*x) for x in zip(codes, audits, enters)], columns=["at", "roles"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation's lines, which come in order; no more than a batch is held."""
    own, digest = None, None
    for batch in batches:
        done = []
        for conv, name, line in zip(batch["conv_id"], batch["name"], batch["line"]):
            if name != own:
                if digest is not None:
                    done.append((last, digest.hexdigest()))
                own, digest, last = name, hashlib.sha256(line.encode()), None if pd.isna(conv) else conv
            else:
                digest.update(b"\n" + line.encode())
        if done:
            yield pd.DataFrame(done, columns=["conv_id", "repaired_sha256"])
    if digest is not None:
        yield pd.DataFrame([(last, digest.hexdigest())], columns=["conv_id", "repaired_sha256"])


def _long(ids: DataFrame, rows: DataFrame, part: int) -> DataFrame:
    """Conversations of many rows: faults, pairs and parts are found where the rows lie, only states meet in one task.

    The repaired text of a conversation is hashed in order, as SHA-256 asks: it streams through one task, never held whole.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    each = ranked(each, ["conv_id", "turn", "role", "text"], "place")
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    key = F.sha2(F.concat(name, F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    facts = staged(each.select("conv_id", "turn", "place", "role", "times", key.alias("k"), _fault(F.col("text"), F.lit(False)).alias("fault")))
    firsts = staged(facts.groupBy("k").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    facts = join_once(facts, firsts.drop("n"), "k", staged(firsts.where(F.col("n") > HOT)))
    fault = F.when((F.col("fault") != "b") & (F.col("place") > F.col("first")), "d").otherwise(F.col("fault"))
    facts = staged(facts.select("conv_id", "turn", "place", "role", "times", fault.alias("fault")))
    # faults and pairs: of a row that comes several times the later ones are duplicates, and a role never follows itself
    of = lambda n, *faults: F.sum(F.when(F.col("fault").isin(*faults), n).otherwise(0))
    more = F.col("times") - 1
    duplicate = of(F.col("times"), "d") + of(more, "t", "k")
    counts = facts.groupBy("conv_id").agg(of(F.col("times"), "b").alias("blank"), duplicate.alias("duplicate"), of(1, "t").alias("truncated"), F.sum(more).alias("again"))
    turns = facts.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    turns = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    before = facts.select((F.col("place") + 1).alias("place"), F.col("conv_id").alias("c"), F.col("role").alias("r"))
    pairs = facts.join(before, "place").where(F.col("conv_id").eqNullSafe(F.col("c")) & ~_legal(F.col("r"), F.col("role")))
    pairs = pairs.groupBy("conv_id").agg(F.count("*").alias("pairs"))
    # parts
    copies = F.repeat(F.lit("D"), (F.col("times") - 1).cast("int"))
    letters = facts.select("conv_id", "place", F.floor(F.col("place") / part).alias("part"), F.concat(_symbol(F.col("role"), F.col("fault")), copies).alias("letters"))
    parts = letters.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "letters"))).alias("p"))
    ways = F.pandas_udf(_ways, "costs array<long>, audits array<string>, order array<int>")
    code = F.array_join("p.letters", "")
    parts = staged(parts.select("conv_id", "part", "p", code.alias("code")).withColumn("w", ways("code")).select("conv_id", "part", "p", "code", "w.*"))
    path = parts.select("conv_id", "part", "costs", "order").groupBy("conv_id").applyInPandas(_path, f"conv_id {kind}, part long, enter int, leave int, cost long")
    chosen = parts.alias("p").join(staged(path).alias("h"), same("p", "h", "conv_id", "part"))
    chosen = staged(chosen.select("p.conv_id", "p.part", "p.p", "p.code", F.get("p.audits", 4 * F.col("h.enter") + F.col("h.leave")).alias("audit"), "h.enter", "h.leave", "h.cost"))
    ends = F.create_map(*[F.lit(x) for s, (_, a) in _ENDS.items() for x in (s, a)])
    whole = chosen.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("part", "audit"))).alias("a"), F.max(F.struct("part", "leave")).alias("z"))
    whole = whole.select("conv_id", "cost", F.concat(F.array_join("a.audit", ""), F.element_at(ends, F.col("z.leave"))).alias("audit"), F.col("z.part").alias("part"), F.element_at(ends, F.col("z.leave")).alias("end"))
    whole = staged(whole)
    # repaired turns in order
    spread = F.pandas_udf(_spread, "at array<int>, roles array<string>")
    turn = F.posexplode(F.arrays_zip(F.col("o.at").alias("at"), F.col("o.roles").alias("role")))
    kept = chosen.withColumn("o", spread("code", "audit", "enter"))
    # letters of one record stand together: its first one is its place, the others are deleted
    starts = F.flatten(F.transform("p", lambda r: F.concat(F.array(r.place), F.array_repeat(F.lit(None).cast("long"), F.length(r.letters) - 1))))
    kept = kept.withColumn("starts", starts).select("conv_id", "part", "starts", turn.alias("seq", "x"))
    kept = kept.select("conv_id", "part", "seq", F.when(F.col("x.at") >= 0, F.get("starts", F.col("x.at"))).alias("place"), F.col("x.role").alias("new"))
    last = F.when((F.length("end") == 2) & (F.col("seq") == 0), "user").otherwise("assistant")
    tail = whole.where("end <> ''").select("conv_id", (F.col("part") + 1).alias("part"), "end", F.posexplode(F.sequence(F.lit(1), F.length("end"))).alias("seq", "e"))
    tail = tail.select("conv_id", "part", "seq", F.lit(None).cast("long").alias("place"), last.alias("new"))
    texts = each.select("place", F.col("role").alias("own"), "text")
    lines = kept.unionByName(tail).join(texts, "place", "left")
    lines = lines.select("conv_id", name.alias("name"), "part", "seq", F.concat(F.when(F.col("new") == "", F.col("own")).otherwise(F.col("new")), F.lit(":"), F.coalesce("text", F.lit(""))).alias("line"))
    hashes = lines.repartition("name").sortWithinPartitions("name", "part", "seq").mapInPandas(_hashed, f"conv_id {kind}, repaired_sha256 string")
    out = ids.select("conv_id")
    for found in (counts, turns, pairs, whole.drop("part", "end"), hashes):
        found = staged(found)
        out = out.alias("o").join(found.alias("m"), same("o", "m", "conv_id"), "left").select("o.*", *[F.col(f"m.{c}") for c in found.columns if c != "conv_id"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        "conv_id", zero("gaps").alias("gaps"), zero("blank").alias("blank"), zero("duplicate").alias("duplicate"), zero("truncated").alias("truncated"),
        (zero("pairs") + zero("again")).alias("illegal"), zero("cost").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def repair(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES, part: int = PART) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conv_id of ``rows``.

    ``rows``: conv_id, turn, role, text, times (how often a row comes; 0 leaves its conversation without it).  A conversation's
    rows come by turn, nulls first, ties by role and text; rows without a conv_id are one conversation.  Roles whose initial is
    not s, u or a cannot be kept.  A conversation without rows has zeros, an empty audit and the hash of the empty string; an
    empty table gives no rows.  Other columns are not read.  A conversation of over ``most_rows`` rows or ``most_bytes`` bytes
    is aligned in parts of ``part`` different rows.
    """
    size = rows.groupBy("conv_id").agg(F.sum("times").alias("n"), F.sum(F.octet_length("text") * F.col("times")).alias("bytes"), F.count("*").alias("given"))
    long = staged(size.where((F.greatest("n", "given") > most_rows) | (F.col("bytes") > most_bytes)).select("conv_id"))
    if long.isEmpty():
        return _short(rows)
    apart = lambda how: rows.alias("r").join(small_side(long).alias("l"), same("r", "l", "conv_id"), how).select("r.*")
    return _short(apart("left_anti")).unionByName(_long(long, apart("left_semi").where("times > 0"), part))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations`` after damage; ``damage`` and ``repair`` state the odd cases."""
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
