import hashlib
import itertools
import random
import re
import time

from glyphmill.llm import pii
from glyphmill.llm.pii import KINDS, base_spans, decode, features, find_pii, find_spans, luhn, op3_pii, segments, train

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}
            if ok[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_base_matches_the_patterns():
    rng = random.Random(1)
    alphabet = "ab.1230+@ -()é_%"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == plain(text), text
    digits = "4041894974608795"
    for text in (f"x {digits} y", f"{digits[:4]} {digits[4:]}-1.2.3.4.5", f"+1 (826) 555-4081 {digits}", "1.2.3.256 01.02.03.004", "a@b.c@d.e", "1" * 30000, "a" * 30000 + "@", "é" + "1.1.1.1 " * 500):
        assert base_spans(text) == plain(text)


def test_decoding_is_the_best_of_all_segmentations():
    weights = train()
    for text, _ in pii._examples(5, 60):
        pieces, found = segments(text, 0, len(text))
        scored = [(i, j, k, sum(weights.get(f, 0.0) for f in features(text, pieces[i][0], pieces[j][1], k))) for i, j, k in found]
        scored = sorted(scored, key=lambda s: -s[3])[:9]
        best = max(
            (sum(s[3] for s in some) for r in range(4) for some in itertools.combinations(scored, r) if all(a[1] < b[0] or b[1] < a[0] for a, b in itertools.combinations(some, 2))),
        )
        got = sum(sum(weights.get(f, 0.0) for f in features(text, a, b, k)) for k, a, b in decode(text, 0, len(text), weights))
        assert got >= best - 1e-9


def test_held_out_examples_and_clean_numbers():
    weights = train()
    right = [set(find_spans(t, weights)[1]) == set(g) for t, g in pii._examples(77, 200)]
    assert sum(right) / len(right) > 0.8
    for clean in ("v 2.0. and 3. then 4.0.", "on 2024-01-05 at 12:30", "password=b7db7aa4a5fcc78305", "4041894974608790", "in 1990-1995 for $1,234.56", "no numbers here"):
        assert find_spans(clean, weights)[1] == []
    assert [s[0] for s in find_spans("Call (988) 555-2485, mail bob [at] host [dot] org", weights)[1]] == ["phone", "email"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_edges(spark):
    rows = [(None, "a@b.cc"), (1, None), (1, None), (2, ""), (3, "7" * 200000), (4, "é 1.2.3.4 " * 5000)]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, spans string, kind int")
    got = {(r.doc_id, len(r.text or "")): len(r.spans) for r in find_pii(df).collect()}
    assert got == {(None, 6): 1, (1, 0): 0, (2, 0): 0, (3, 200000): 0, (4, 50000): 5000}
    assert find_pii(df).count() == 6 and find_pii(df.limit(0)).count() == 0


def test_gate_lets_all_at_marks_through():
    weights = train()
    for mark in ("[at]", "[AT]", "(At)", "{at}", "{AT}"):
        text = f"write bob {mark} host {mark.lower().replace('at', 'dot')} org now"
        assert find_spans(text, weights) == ([], [("email", 6, len(text) - 4)])


def test_long_runs_of_numbers_take_linear_time():
    weights = train()
    for piece in ("1-", "12 ", "+1("):
        began = time.perf_counter()
        base, spans = find_spans(piece * (200_000 // len(piece)), weights)
        assert time.perf_counter() - began < 90 and set(base) <= set(spans)
