"""Personal data: fixed base patterns, and wider candidates chosen by gradient-boosted trees."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents with a digit or @ whose candidates the trees are fitted on, at most, and their length.
FIT_DOCS, FIT_CHARS = 4000, 100_000
#: Share of the chosen candidates that must be right on the part held out from the fit.
PRECISION = 0.99
#: A kind with fewer right candidates there takes the threshold of all kinds together.
SCARCE = 20
#: Lessons of a document, drawn by its text.
LESSONS = 64

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a digit run is taken whole or not at all, so a match can only begin at its start
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _ascii_digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, by start, then kind as listed; offsets in code points."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = _ascii_digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_ascii_digits(m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# generators of wider candidates: each looks at a short stretch around a digit run or an at-sign
_NUMBERS = re.compile(r"(?:\+|\()?[0-9](?:[0-9]|[ .()/: -]{1,3}(?=[0-9])){6,63}")
_WIDE_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s?\.\s?[0-9]{1,3}){3}(?![\w])")
_WIDE_CARD = re.compile(r"(?<!\w)[0-9](?:[ ./ -]{0,2}[0-9]){11,18}(?!\w)")
_WIDE_PHONE = re.compile(r"(?<!\w)(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ .()/-]{1,3}[0-9]{2,5}){2,4}(?!\w)")
_AT = re.compile(r"@|[(\[{] ?at ?[)\]}]")
_WIDE_LOCAL = re.compile(r"[\w.%+-]{1,64}\s?$")
_WIDE_HOST = re.compile(r"\s?[\w-]{1,63}(?:\s?(?:\.|[(\[{] ?dot ?[)\]}])\s?[\w-]{1,63}){1,6}")
#: Words that announce personal data (fixed values).
_CUES = re.compile(r"mail|contact|write|tel|phone|call|mobile|fax|card|visa|pay|credit|ip|host|address|server", re.I)


def candidates(text: str) -> list[Span]:
    """Overlapping spans of a high-recall kind."""
    out = []
    for m in _AT.finditer(text):
        left = _WIDE_LOCAL.search(text, max(0, m.start() - 65), m.start())
        right = _WIDE_HOST.match(text, m.end(), min(len(text), m.end() + 160))
        if left and right:
            out.append((left.start(), right.end(), "email"))
    for m in _NUMBERS.finditer(text):
        a, b = m.start(), min(len(text), m.end() + 1)
        for kind, pattern in (("ip", _WIDE_IP), ("card", _WIDE_CARD), ("phone", _WIDE_PHONE)):
            out += [(x.start(), x.end(), kind) for x in pattern.finditer(text, a, b)]
    return out


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate as numbers."""
    a, b, kind = span
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    tail = re.search(r"[A-Za-z]+$", s)
    before, after = text[a - 1 : a], text[b : b + 1]
    kind_of = lambda c: 0 if not c or c.isspace() else 1 if c.isalnum() else 2
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), max(sizes), min(sizes), len(set(re.findall(r"[^\w]", s))),
        s.startswith("+"), s.startswith("0"), "(" in s, bool(digits) and luhn(digits), all(int(g[:9]) <= 255 for g in groups),
        "@" in s, s.count("."), len(tail[0]) if tail else 0, sum(c.isalpha() for c in s) / len(s), any(c.isspace() for c in s),
        kind_of(before), kind_of(after), bool(_CUES.search(text, max(0, a - 24), a)), len(set(digits)),
    ]


def example(kind: str, rng: random.Random) -> str:
    """A made-up span of a kind in the form of its base pattern."""
    word = lambda n: "".join(rng.choice("abdeghiklmnoprstuw") for _ in range(n))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        return f"{word(rng.randint(2, 8))}{rng.choice(['.', '_', ''])}{word(rng.randint(2, 8))}@{word(rng.randint(3, 9))}.{rng.choice(['example.org', 'com', 'net', 'de', 'co.uk'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(1, 254)) for _ in range(4))
    if kind == "card":
        digits = rng.choice("3456") + number(14)
        digits += next(d for d in "0123456789" if luhn(digits + d))
        return rng.choice(["", " ", "-"]).join(digits[i : i + 4] for i in range(0, 16, 4))
    return f"+{rng.randint(1, 98)} {number(3)} {number(3)} {number(4)}"


def disguised(kind: str, s: str, rng: random.Random) -> str:
    """A base span with its signs written otherwise; it is still personal data."""
    if kind == "email":
        user, host = s.split("@", 1)
        return user + rng.choice([" [at] ", " (at) ", "(at)", "[at]", " @ "]) + (host if rng.random() < 0.6 else host.replace(".", rng.choice([" [dot] ", " (dot) "])))
    if kind == "ip":
        return s.replace(".", rng.choice([" . ", ". "]))
    digits = _ascii_digits(s)
    if kind == "card":
        return rng.choice([".", "/", " - ", "  "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    cut = max(1, len(digits) - 10)
    area, first, last = digits[cut : cut + 3], digits[cut + 3 : cut + 6], digits[cut + 6 :]
    return rng.choice([f"+{digits[:cut]} / {area} / {first} / {last}", f"00{digits[:cut]} {area} {first} {last}", f"+{digits[:cut]}/{area}/{first}-{last}", f"({area}) {first}-{last}"])


def broken(kind: str, s: str, rng: random.Random) -> list[str]:
    """Spans that look like the kind but are not: a digit off, a part above 255, no host, dates, lists of numbers."""
    digits = _ascii_digits(s)
    if kind == "email":
        user, host = s.split("@", 1)
        return [user + "@" + re.sub(r"[A-Za-z]", "7", host), f"{user} at {host.split('.')[0]}"]
    if kind == "ip":
        return [re.sub(r"[0-9]+$", str(rng.randint(256, 999)), s), ".".join(str(rng.randint(300, 999)) for _ in range(4))]
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        return [wrong, rng.choice([".", "/", " - ", " "]).join(wrong[i : i + 4] for i in range(0, len(wrong), 4))]
    year, month, day = f"20{digits[-2:]}", f"{rng.randint(1, 12):02}", f"{rng.randint(1, 28):02}"
    return [rng.choice("-/. ").join((year, month, day)), f"19{digits[-4:-2]}-20{digits[-2:]}", " ".join((digits[:2], digits[2:4], digits[4:6])), f"{day}.{month}.{year} {rng.randint(10, 23)}:{digits[-2:]}"]


def lessons(text: str, most: int = LESSONS) -> list[tuple[list[float], int, int]]:
    """(features, label, part) to learn from, at most ``most``: candidates are right where a base pattern agrees.

    Each base span lends its place to others: itself disguised, which stays right, and broken, which is wrong, and one
    made-up span of each other kind, plain, disguised and broken, so that kinds which a corpus hardly has are learnt as well.
    The part of the fit goes by the text, so copies are never on both sides of it.
    """
    base = base_spans(text)
    own, seed = set(base), zlib.crc32(text.encode("utf-8", "surrogatepass"))
    out = [(describe(text, c), int(c in own)) for c in candidates(text)]
    rng = random.Random(seed)
    for a, b, kind in base[:most]:
        for other in KINDS:
            s = text[a:b] if other == kind else example(other, rng)
            made = [(disguised(other, s, rng), 1), *((x, 0) for x in broken(other, s, rng))] + ([(s, 1)] if other != kind else [])
            for new, label in made:
                near = text[max(0, a - 40) : a] + new + text[b : b + 40]
                start = min(a, 40)
                found = [c for c in candidates(near) if c[2] == other and c[0] <= start + 1 and c[1] >= start + len(new) - 1]
                out += [(describe(near, c), label) for c in found]
    rng.shuffle(out)
    return [(x, y, seed % 4) for x, y in out[:most]]


class Model(NamedTuple):
    start: float
    trees: list  # nested (feature, threshold, below, above) or a number
    threshold: list[float]  # of each kind


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float):
    value = -rate * float(grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return value
    best, parent = (1e-3, None, None), grad.sum() ** 2 / (hess.sum() + 1.0)
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))):
            low = x[:, f] <= cut
            if not 5 <= low.sum() <= len(x) - 5:
                continue
            gl, hl = grad[low].sum(), hess[low].sum()
            gain = gl**2 / (hl + 1.0) + (grad.sum() - gl) ** 2 / (hess.sum() - hl + 1.0) - parent
            best = max(best, (gain, f, float(cut)), key=lambda b: b[0])
    if best[1] is None:
        return value
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], *(_grow(x[s], grad[s], hess[s], depth - 1, rate) for s in (low, ~low)))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = _apply(tree[2], x[low]), _apply(tree[3], x[~low])
    return out


def logits(model: Model, x: np.ndarray) -> np.ndarray:
    return model.start + sum((_apply(t, x) for t in model.trees), np.zeros(len(x)))


def fit(rows: list[tuple[list[float], int, int]], **options) -> Model:
    """``fit_arrays`` on rows of (features, label, part)."""
    x, y, part = (np.array([r[i] for r in rows], float) for i in range(3))
    return fit_arrays(x, y, part, **options)


def fit_arrays(x: np.ndarray, y: np.ndarray, part: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3) -> Model:
    """Boosted trees on three quarters of the texts; each kind's threshold is set on the last."""
    never = [float("inf")] * len(KINDS)
    if len(set(y)) < 2:
        return Model(0.0, [], never)
    fold = part != 3
    if len(set(y[fold])) < 2:
        return Model(0.0, [], never)
    share = y[fold].mean()
    model = Model(float(np.log(share / (1 - share))), [], never)
    z = np.full(fold.sum(), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        model.trees.append(_grow(x[fold], p - y[fold], p * (1 - p), depth, rate))
        z += _apply(model.trees[-1], x[fold])
    z, right, kind = logits(model, x[~fold]), y[~fold], x[~fold][:, 0]
    together = _threshold(z, right)
    return model._replace(threshold=[_threshold(z[kind == k], right[kind == k]) if right[kind == k].sum() >= SCARCE else together for k in range(len(KINDS))])


def _threshold(z: np.ndarray, right: np.ndarray) -> float:
    """The lowest score from which on PRECISION of the candidates are right; infinite where there is none."""
    order = np.argsort(-z, kind="stable")
    ranked, good = z[order], right[order]
    ok = np.cumsum(good) >= PRECISION * np.arange(1, len(good) + 1)
    ok &= np.r_[ranked[:-1] > ranked[1:], True] if len(ranked) else ok
    return float(ranked[np.flatnonzero(ok)[-1]]) if ok.any() else float("inf")


class _Taken:
    """Disjoint stretches of a text in order, by which an overlap is found in a few steps."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for a, b, _ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        at = bisect_right(self.ends, a)
        return at == len(self.starts) or self.starts[at] >= b

    def add(self, a: int, b: int) -> None:
        at = bisect_right(self.ends, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


def all_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with the chosen candidates that overlap none, best first."""
    base = base_spans(text)
    spans, taken = list(base), _Taken(base)
    wide = [c for c in candidates(text) if taken.free(c[0], c[1])] if model.trees else []
    if wide:
        z = logits(model, np.array([describe(text, c) for c in wide], float))
        for _, c in sorted(((-v, c) for v, c in zip(z, wide) if v >= model.threshold[KINDS.index(c[2])])):
            if taken.free(c[0], c[1]):
                taken.add(c[0], c[1])
                spans.append(c)
    return base, sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def fit_on(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Fit on at most LESSONS lessons of each of at most ``fit_docs`` documents of at most FIT_CHARS characters, drawn by a hash of the text.

    Equal texts teach once, rows without an id as others.
    """
    some = docs.where((F.char_length("text") <= FIT_CHARS) & F.col("text").rlike("[@0-9]")).select(F.xxhash64("text").alias("h"), "text")
    ids = some.select("h").distinct().orderBy(F.hash("h"), "h").limit(fit_docs)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, i, *lesson) for h, t in zip(batch["h"].to_pylist(), batch["text"].to_pylist()) for i, lesson in enumerate(lessons(t))]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["h", "i", "x", "y", "part"])

    sample = some.join(F.broadcast(ids), "h").groupBy("h").agg(F.min("text").alias("text"))
    rows = sample.mapInArrow(of, "h long, i int, x array<double>, y int, part int").toArrow()
    y, part = (rows.column(c).to_numpy() for c in ("y", "part"))
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1) if len(y) else np.zeros((0, 1))
    order = np.lexsort((rows.column("i").to_numpy(), rows.column("h").to_numpy()))
    return fit_arrays(x[order], y[order].astype(float), part[order])


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts of the base spans, base_sha256, spans (all), n_added: one row for each row of ``docs``, repeated ones too.

    Null and empty texts have no spans.  A text is read once from end to end, however long.  Spans added never overlap others.
    An empty table gives no rows.  Other columns are not read, whatever their names; a null doc_id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                base, spans = all_spans(text or "", shared.value)
                n = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((doc, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)))
            kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, schema)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, end = [], 0
        for a, b, kind in all_spans(text, shared.value)[1]:
            if a >= end:
                out += [text[end:a], f"[{kind.upper()}]"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(map(clean, batch["text"].to_pylist()), batch.schema.field(at).type))

    return docs.mapInArrow(of, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` by ``find``; the counts are of base spans, ``spans`` has the added ones too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, fit_on(docs))
