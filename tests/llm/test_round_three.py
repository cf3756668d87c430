"""Decontamination, conversation repair and hard negatives against plain versions, with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from gazetta.llm import conversations as C
from gazetta.llm import decontamination as D
from gazetta.llm import hard_negatives as H

from ..conftest import SMALL

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_hits(text, items):
    words = lambda t: re.findall(D.WORD, (t or "").translate(UPPER))
    w, hit, named = words(text), set(), set()
    for item_id, t in items:
        v = words(t)
        n = min(D.WINDOW, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows]
        hit |= {p for i in at for p in range(i, i + n)}
        if at and item_id is not None:
            named.add(str(item_id))
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def leaks(spark, odd_docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]  # few words: windows repeat, within a text too
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(30) for _ in range(4)]
    items = [(i, p) for i, p in enumerate(passages)] + [(10, passages[0][:60]), (9, "same text here"), (9, "w1 w2"), (11, "Ünï çödé"), (12, ""), (13, None), (None, passages[1]), (14, "w0-w0"), (15, text(9)), (16, text(10))]
    docs = [(100 + i, text(rng.randint(0, 25)) + " " + rng.choice(passages)[: rng.randint(0, 90)].upper() + ", " + text(rng.randint(0, 15))) for i in range(60)]
    docs = spark.createDataFrame([(*d, "en", "x", 0, 1, 2, 3, 4, 5) for d in docs], odd_docs.schema).unionByName(odd_docs)
    return docs, spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("broadcast", [D.BROADCAST_FINGERPRINTS, 0])
def test_decontamination(leaks, broadcast):
    docs, table, items = leaks
    found = D.decontaminate(docs, table.withColumnsRenamed({}), broadcast).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = [(r.doc_id, *plain_hits(r.text, items)) for r in docs.collect()]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[2] > 0 for r in want) > 10


def test_decontamination_of_nothing(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    out = D.decontaminate(odd_docs, none)
    assert out.count() == odd_docs.count() and out.where("n_hit > 0 OR n_items > 0 OR contaminated").isEmpty()
    assert D.decontaminate(no_docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).isEmpty()


def plain_audit(code):
    """Row by row over the states of the grammar, with the least (cost, audit) of each."""
    following, state_of = {0: "us", 1: "u", 2: "a", 3: "u"}, {"s": 1, "u": 2, "a": 3}
    best = {0: (0, "")}
    for i in range(len(code) + 1):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                for x in following[s].replace("s", ""):
                    best[state_of[x]] = min(best.get(state_of[x], (9**9, "")), (c + 3, a + "I"))
        if i == len(code):
            return min(v for s, v in best.items() if s in (0, 3))
        after = {s: (c + 4, a + "D") for s, (c, a) in best.items()}
        for s, (c, a) in best.items() if code[i] != "D" else ():
            for x in following[s]:
                kept = x == code[i].lower()
                if kept or x != "s":
                    offer = (c + 3 * code[i].isupper() + 3 * (not kept), a + "RK"[kept])
                    after[state_of[x]] = min(after.get(state_of[x], (9**9, "")), offer)
        best = after


def plain_repair(rows):
    """The contract over one conversation's rows (conv_id, turn, role, text)."""
    said, out = lambda v: " " if v is None else str(v), []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", said(text)) if k == 2 else said(text)
        out += [(turn, "user" if k == 4 else said(role), text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
    seen, code, faults = set(), "", []
    for _, role, text in out:
        bare = text.rstrip(C._BLANKS)
        fault = "b" if not bare else "d" if (role, text) in seen else "k" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        own = role[:1] if role[:1] in ("s", "u", "a") else "x"
        code += "D" if fault in "bd" else own.upper() if fault == "t" else own
        faults.append(fault)
    cost, audit = plain_audit(code)
    lines, i, last = [], 0, ""
    for edit in audit:
        role, text = (out[i][1], out[i][2]) if edit in "KR" else ("", "")
        if edit != "D":
            role = role if edit == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{text}")
            last = role[:1]
        i += edit != "I"
    turns = {t for t, _, _ in out if t is not None}
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest)


def test_audits_are_the_cheapest_and_least():
    rng = random.Random(5)
    codes = ["", "s", "D", "x", "as", "Sx"] + ["".join(rng.choice("suaxSUAXD") for _ in range(rng.randint(1, 7))) for _ in range(2000)]
    codes += ["".join(rng.choice("ua" * 4 + "sUAXD") for _ in range(60)) for _ in range(50)]
    assert [C.align(c) for c in codes] == [plain_audit(c) for c in codes]


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No!", "why", "", " \t", "A. ", "long " * 30 + "?"]))
            for c in range(40) for t in sorted(rng.sample(range(30), rng.randint(1, 14)))]
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (900, None, "user", None), (900, None, "assistant", "Ok."), (900, 1, None, "x"), (901, 5, "user", "Ä é."), (901, 5, "user", "Ä é."), (901, 5, "user", "Ä é.")]
    rows += [(902, i, "user" if i % 2 == 0 else "assistant", "The same.") for i in range(300)] + [(903, i, "ua"[i % 2] + "x", f"{i} is.") for i in range(300)]
    rows += [(c, t, "user", "Gone.") for c in range(1000, 1060) for t in [1] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    schema = "conv_id long, turn long, role string, text string, times string, place string"
    return spark.createDataFrame([(*r, "x", "y") for r in rows], schema), rows


@pytest.mark.parametrize("limits", [{}, {"most_rows": 4, "part": 3}])
def test_conversations(talks, limits):
    table, rows = talks
    want = {c: plain_repair([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    found = {r.conv_id: tuple(r)[1:] for r in C.repair(C.damage(table), **limits).collect()}
    assert found.keys() == want.keys()
    assert [c for c in want if found[c] != want[c]] == []


def test_conversations_of_the_small_table(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in C.op12_conversation_repair(spark, SMALL).collect()}
    assert found == {c: plain_repair([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert C.repair(C.damage(table.limit(0))).isEmpty()


def plain_negatives(rows, every=50):
    ok = {}
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and np.isfinite(x) for x in v):
            one = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v])
            ok[i] = min(ok.get(i, one), one)
    out = []
    for a in (i for i in ok if i % every == 0):
        label, q = ok[a]
        scores = sorted(((-sum(x * y for x, y in zip(q, v)), i, g == label) for i, (g, v) in ok.items() if i != a and len(v) == len(q)))
        for p, positive in [(-s, i) for s, i, alike in scores if alike][:5]:
            few = [(-s, i) for s, i, alike in scores if not alike and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(a, positive, r, i, p, s) for r, (s, i) in enumerate(few, 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [H.BLOCK_CELLS, 256])
def test_hard_negatives(spark, cells):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 20))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=20) * (i % 3)], i * 5 % 4) for i in range(-40, 400)]
    rows += [(1000 + i, rows[i % 9][1], i % 4) for i in range(40)]  # ties
    rows += [(2000, None, 1), (2050, [1.0] * 19 + [None], 1), (2051, [float("nan")] * 20, 1), (2052, [float("inf")] * 20, 1), (2100, [0.0] * 20, 2), (None, [1.0] * 20, 2), (2101, [1.0] * 20, None)]
    rows += [(2150, [1.0, 2.0, 3.0], 1), (2151, [1.5, 2.0, 3.0], 1), (2152, [1.0, 1.5, 2.0], 2), (2200, [], 1), (2201, [], 2)]  # of other lengths
    rows += [(50, [9.0] * 20, 9), (51, rows[3][1], 3), (51, rows[3][1], 3)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, v int")
    found = sorted(tuple(r) for r in H.mine(table, cells=cells).collect())
    assert found == plain_negatives(rows) and len(found) > 50


def test_bounds_leave_pairs_out(spark):
    rng = np.random.default_rng(4)
    centres = np.repeat(rng.normal(size=(8, 4)), 16, axis=1)
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=64) / 20], i % 4) for i in range(200)]
    assert sorted(tuple(r) for r in H.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()) == plain_negatives(rows)
    x = np.array([r[1] for r in rows])
    table = H.summaries(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toArrow()
    v, mask, left = H.Vectors(table), np.ones((200, 200), bool), []
    H.open_scores(v, v, mask, lambda lower, upper, m: left.append(m.sum()) or upper >= np.quantile(x @ x.T, 0.95) * 256**2)
    assert left[1] < left[0] / 3 and left[2] <= left[1]


def test_no_hard_negatives(spark):
    assert H.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).isEmpty()
