"""Personal data: exact patterns, and a semi-Markov conditional random field that adds spans the patterns miss.

The field scores whole candidate segments of a window of text by features of the whole span (shape, digits, checksum,
marks, neighbours). A dynamic programme over segments of at most MOST_PIECES pieces chooses boundaries and kinds
together. Its weights maximise the conditional likelihood of generated examples, so no labels are needed.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that doesn't match from its start doesn't match from later on: the look-behind only saves those tries.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANY = re.compile(r"[0-9@]|\[at\]|\(at\)|\{at\}", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind's pattern that pass its test, by start and then kind."""
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGIT.findall(m[0]))
        if len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# The segment model.

MOST_PIECES = 24
_PIECE = re.compile(r"[0-9]+|[A-Za-z]+|\S")
_REST = re.compile(r"\S*+")
_AT = re.compile(r"\s?(?:@|\[at\]|\(at\)|\{at\})\s?", re.I)
_DOT = r"\s?(?:\.|\[\.\]|\[dot\]|\(dot\)|\{dot\})\s?"
_MAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+{_AT.pattern}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_IP_LOOSE = re.compile(r"[0-9]+(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]+){3}")
_CUE = re.compile(r"(?:phone|tel|telephone|call|mobile|cell|fax|ph|contact)[.:]?$", re.I)
_SHAPES = ("(999) 999-9999", "999-999-9999", "999.999.9999", "999 999 9999", "9-999-999-9999", "9 (999) 999-9999", "(999)999-9999", "999-9999")


_LENGTHS = frozenset(map(len, _SHAPES))


def _shape(text: str) -> str:
    return re.sub(r"[0-9]", "9", text)


def _cut_before(text: str, start: int) -> bool:
    """Whether what stands before a segment runs on into it."""
    before = text[max(0, start - 24) : start]
    return bool(re.search(r"[A-Za-z0-9_]$", before) or re.search(r"[-.=/:$#,][ ]?$", before) and not _CUE.search(before.rstrip()))


def _cut_after(text: str, end: int) -> bool:
    return bool(re.match(r"[A-Za-z0-9_%]|[-./:,][0-9A-Za-z]", text[end : end + 2]))


def features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Features of one whole segment of one kind."""
    span, before = text[start:end], text[max(0, start - 24) : start]
    digits = "".join(_DIGIT.findall(span))
    out = ["bias"]
    if _cut_before(text, start) or _cut_after(text, end):
        out.append("cut")
    if "\n" in span:
        out.append("line")
    if kind == "email":
        m = _MAIL.fullmatch(span)
        out.append("mail" if m else "no-mail")
        if m and re.search(r"[A-Za-z]{2,10}$", span):
            out.append("top-level")
        return [f"{kind}:{x}" for x in out]
    out.append(f"digits:{len(digits) if len(digits) < 20 else 20}")
    if kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        out.append("four" if _IP_LOOSE.fullmatch(span) and all(map(_byte, parts)) else "no-four")
    if kind == "card":
        out.append("luhn" if luhn(digits) else "no-luhn")
        groups = [len(x) for x in re.findall(r"[0-9]+", span)]
        out.append("fours" if groups in ([4, 4, 4, 4], [16], [4, 6, 5], [15]) else "odd-groups")
    if kind == "phone":
        shape = _shape(span)
        out.append(f"shape:{_SHAPES.index(shape)}" if shape in _SHAPES else "no-shape")
        if _CUE.search(before.rstrip()):
            out.append("cue")
            out.append("cue-long" if 7 <= len(digits) <= 15 else "cue-odd")
    return [f"{kind}:{x}" for x in out]


def segments(text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Piece ends of a window, and candidate segments (first piece, last piece, kind) that have some chance."""
    pieces = [(m.start(), m.end()) for m in _PIECE.finditer(text, lo, hi)]
    first = {a: i for i, (a, _) in enumerate(pieces)}
    last = {b: i for i, (_, b) in enumerate(pieces)}
    found = []
    for m in _MAIL.finditer(text, lo, hi):
        if m.start() in first and m.end() in last and last[m.end()] - first[m.start()] < MOST_PIECES:
            found.append((first[m.start()], last[m.end()], "email"))
    for i, (a, _) in enumerate(pieces):
        if text[a] not in "0123456789(+":
            continue
        digits = 0
        for j in range(i, min(i + MOST_PIECES, len(pieces))):
            c, d = pieces[j]
            if text[c].isalpha() or text[c] not in "0123456789().-/[]+ " or j > i and c - pieces[j - 1][1] > 1:
                break
            if "0" <= text[c] <= "9":
                digits += d - c
                if digits > 19:
                    break
                if digits >= 7:
                    found.append((i, j, "phone"))
                if digits >= 13:
                    found.append((i, j, "card"))
                if digits >= 4 and j - i >= 6 and _IP_LOOSE.fullmatch(text, a, d):
                    found.append((i, j, "ip"))
    return pieces, found


#: Features of which a segment has one at most, by the name of their group.
_EITHER = {"no-shape": "shape", "cue-odd": "cue-long", "no-luhn": "luhn", "odd-groups": "fours", "no-four": "four"}


def _most(weights: dict[str, float]) -> tuple[dict[str, float], float, float]:
    """For each kind the most that features other than its bias, digits, cut, shape and cue can add; and the most for a
    shape and for a cue."""
    best: dict[tuple[str, str], float] = {}
    for f, w in weights.items():
        kind, name = f.split(":")[:2]
        group = kind, _EITHER.get(name, name)
        best[group] = max(best.get(group, 0.0), w)
    apart = ("bias", "cut", "digits", "shape", "cue", "cue-long")
    rest = {k: sum(w for (kind, name), w in best.items() if kind == k and name not in apart) for k in KINDS}
    return rest, best.get(("phone", "shape"), 0.0), best.get(("phone", "cue"), 0.0) + best.get(("phone", "cue-long"), 0.0)


def decode(text: str, lo: int, hi: int, weights: dict[str, float]) -> list[Span]:
    """The best segmentation of a window: pieces outside have score 0, segments the sum of their weights.

    Segments that can't have a positive score by their digits and their edges are left out before their other features
    are computed; each edge is looked at once."""
    pieces, found = segments(text, lo, hi)
    ending: dict[int, list] = {}
    (most, shape, cue), bounds, begun, ended, digits = _most(weights), {}, {}, {}, [0]
    cut = min(0.0, weights.get("phone:cut", 0.0))
    for a, b in pieces if found else ():
        digits.append(digits[-1] + (b - a) * ("0" <= text[a] <= "9"))
    for i, j, kind in found:
        if kind != "email":
            held = kind, min(20, digits[j + 1] - digits[i])
            if held not in bounds:
                bounds[held] = most[kind] + weights.get(f"{kind}:bias", 0.0) + weights.get(f"{kind}:digits:{held[1]}", 0.0)
            if i not in begun:
                start = pieces[i][0]
                begun[i] = cut * _cut_before(text, start), cue if _CUE.search(text[max(0, start - 24) : start].rstrip()) else 0.0
            bound = bounds[held]
            if kind == "phone":
                bound += begun[i][1] + shape * (pieces[j][1] - pieces[i][0] in _LENGTHS)
                if bound + begun[i][0] <= 0:
                    continue
                if not begun[i][0]:
                    if j not in ended:
                        ended[j] = cut * _cut_after(text, pieces[j][1])
                    bound += ended[j]
                else:
                    bound += begun[i][0]
            if bound <= 0:
                continue
        score = sum(weights.get(f, 0.0) for f in features(text, pieces[i][0], pieces[j][1], kind))
        if score > 0:
            ending.setdefault(j, []).append((i, kind, score))
    best, back = [0.0] * (len(pieces) + 1), [None] * (len(pieces) + 1)
    for j in range(len(pieces)):
        best[j + 1] = best[j]
        for i, kind, score in ending.get(j, ()):
            if best[i] + score > best[j + 1]:
                best[j + 1], back[j + 1] = best[i] + score, (i, kind)
    out, at = [], len(pieces)
    while at > 0:
        if back[at] is None:
            at -= 1
        else:
            i, kind = back[at]
            out.append((kind, pieces[i][0], pieces[at - 1][1]))
            at = i
    return out[::-1]


def _examples(seed: int, n: int) -> list[tuple[str, list[Span]]]:
    """Generated windows with their spans: spans that the patterns miss, and numbers that are nobody's."""
    rng = random.Random(seed)
    fill = lambda shape: "".join(rng.choice("0123456789") if c == "9" else c for c in shape)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 8)))

    def card(sep: str, valid: bool) -> str:
        d = fill("4" + "9" * 14)
        d += next(str(x) for x in range(10) if luhn(d + str(x)) == valid)
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    good = (
        lambda: ("phone", fill(rng.choice(_SHAPES[:7]))),
        lambda: ("phone", fill(rng.choice(_SHAPES[:7]))),
        lambda: ("email", f"{word()}{rng.choice(['', '.'])}{word()}{rng.choice([' [at] ', '[at]', '(at)', ' (at) ', ' @ '])}{word()}{rng.choice(['.', ' [dot] ', '[dot]'])}{rng.choice(['com', 'org', 'de'])}"),
        lambda: ("ip", rng.choice(["[.]", "(.)", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))),
        lambda: ("card", card(rng.choice([".", "/"]), True)),
    )
    bad = (
        lambda: fill(rng.choice(["9.9.", "9.9.9", "99.9", "9999", "9999999", "999999999", "99999999999999", "No. 999999999"])),
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{rng.randint(1900, 2030)}",
        lambda: fill(rng.choice(["99:99", "9999-9999", "$9,999.99", "99.999.999", "9999/9999", "999-9999-9999-99", "978-9-999-99999-9", "9999-99-99 99:99"])),
        lambda: card(rng.choice([".", "", "-", "/"]), False),
        lambda: "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18)),
        lambda: ".".join(str(rng.randint(300, 999)) for _ in range(4)),
        lambda: f"@{word()}",
        lambda: fill("99 999 999 99 9999"),
    )
    out = []
    for _ in range(n):
        text, spans = word(), []
        for _ in range(rng.randint(1, 3)):
            text += " "
            if rng.random() < 0.55:
                kind, body = rng.choice(good)()
                spans.append((kind, len(text), len(text) + len(body)))
            elif rng.random() < 0.2:
                text += rng.choice(["tel: ", "call ", "phone "])
                body = fill(rng.choice(["999-9999", "9999999999", "99999 99999"]))
                spans.append(("phone", len(text), len(text) + len(body)))
            else:
                body = rng.choice(bad)()
            text += body + rng.choice(["", ",", "."]) + " " + word()
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def train(seed: int = 11, n: int = 400, rounds: int = 30, rate: float = 0.5, ridge: float = 1e-3) -> dict[str, float]:
    """Weights by gradient ascent on the conditional log-likelihood of generated examples, with forward and backward
    sums over all segmentations; deterministic."""
    data = []
    for text, gold in _examples(seed, n):
        pieces, found = segments(text, 0, len(text))
        at = {(k, a, b) for k, a, b in gold}
        rows = [(i, j, features(text, pieces[i][0], pieces[j][1], kind), (kind, pieces[i][0], pieces[j][1]) in at) for i, j, kind in found]
        data.append((len(pieces), rows))
    weights: dict[str, float] = {}
    for _ in range(rounds):
        grad: dict[str, float] = {}
        for size, rows in data:
            scores = [sum(weights.get(f, 0.0) for f in r[2]) for r in rows]
            ends, starts = {}, {}
            for r, s in zip(rows, scores, strict=True):
                ends.setdefault(r[1], []).append((r[0], s))
                starts.setdefault(r[0], []).append((r[1], s))
            alpha, beta = [0.0] * (size + 1), [0.0] * (size + 1)
            for j in range(size):
                alpha[j + 1] = _logsum([alpha[j], *(alpha[i] + s for i, s in ends.get(j, ()))])
            for i in reversed(range(size)):
                beta[i] = _logsum([beta[i + 1], *(beta[j + 1] + s for j, s in starts.get(i, ()))])
            for (i, j, names, gold), s in zip(rows, scores, strict=True):
                delta = gold - math.exp(alpha[i] + s + beta[j + 1] - alpha[size])
                for f in names:
                    grad[f] = grad.get(f, 0.0) + delta
        for f, g in grad.items():
            weights[f] = weights.get(f, 0.0) + rate * (g / math.sqrt(n) - ridge * weights.get(f, 0.0))
    return weights


def _logsum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


_TAIL = re.compile(rf"\s?[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*", re.I)
_MARK_LAST = re.compile(r"(?:[\[({](?:at|dot)[\])}]|@)$", re.I)


def _chunks(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Runs without white space that hold a digit or an at-mark."""
    end = lo
    for m in _ANY.finditer(text, lo, hi):
        if m.start() >= end:
            start = m.start()
            while start > end and not text[start - 1].isspace():
                start -= 1
            end = _REST.match(text, m.start(), hi).end()
            yield start, end


def windows(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Windows of neighbouring words with a digit or an at-mark, outside the spans that are taken already."""
    free, at = [], 0
    for _, a, b in sorted(taken, key=lambda s: s[1]):
        if a > at:
            free.append((at, a))
        at = max(at, b)
    free.append((at, len(text)))
    for lo, hi in free:
        start = end = -1
        for a, b in _chunks(text, lo, hi):
            alone = _AT.fullmatch(text, a, b)
            if start >= 0 and a - end > 1:
                yield start, end
                start = -1
            if start < 0:  # an at-mark that stands alone takes the words beside it
                start = max(lo, text.rfind(" ", lo, max(lo, a - 1)) + 1) if alone else a
            end = max(end, b)
            if alone or _MARK_LAST.search(text, max(a, b - 8), b):
                tail = _TAIL.match(text, end, hi)
                end = tail.end() if tail else end
        if start >= 0:
            yield start, end


def find_spans(text: str | None, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans with those the model adds outside them."""
    if not text or not _ANY.search(text):
        return [], []
    base = base_spans(text)
    added = [s for lo, hi in windows(text, base) for s in decode(text, lo, hi, weights)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds base_spans and spans (arrays of kind, start, end in code points, by start and then kind) to each document.

    A null or empty text has none; repeated rows are searched each on its own; texts are searched as a whole, in time
    that grows with their length. Columns of the two names are replaced, others stay.
    """
    kept = docs.drop("base_spans", "spans")
    at = kept.columns.index(text_col)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*kept.schema.fields, T.StructField("base_spans", span), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    weights = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t.as_py(), weights) for t in batch.column(at)]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[i]] for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "base_spans", "spans"])

    return kept.mapInArrow(run, schema)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of the spans."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(_kind_count, KINDS), F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _kind_count(kind: str):
    return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
