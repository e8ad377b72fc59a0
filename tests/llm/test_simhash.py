import numpy as np
import xxhash

from glyphmill.llm.simhash import bucket_links, near_dedup, radius_at, simhash_components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain(texts, k=4, seed=42):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        if not words:
            out.append(0)
            continue
        s = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def closure(ids, fps, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def test_bucket_links_span_all_near_pairs():
    rng = np.random.default_rng(5)
    for n in (2, 63, 64, 65, 130, 700):
        centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
        fps = centre[rng.integers(0, 6, n)]
        for _ in range(4):
            fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) * (rng.random(n) < 0.6)
        fps = np.unique(fps)
        rng.shuffle(fps)
        groups = np.sort(rng.integers(0, 3, len(fps)))
        links = list(zip(*bucket_links(fps[:, None], groups, 4), strict=True))
        root = list(range(len(fps)))
        for _ in fps:
            for x, y in links:
                root[x] = root[y] = min(root[x], root[y])
        want = []
        for g in range(3):
            own = np.flatnonzero(groups == g)
            want += closure(own.tolist(), [int(x) for x in fps[own]], 4)
        assert root == want


def test_components_match_brute_force(spark):
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    base = rows[0][1]
    rows += [(None, base), (5, None), (5, None), (900, ""), (901, " \t\n"), (902, "One"), (903, "one"), (904, base + " x"), (905, "a b c"), (906, "w " * 30000)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp & (2**64 - 1), r.component_id) for r in simhash_components(df).collect())
    fps = plain([t for _, t in rows])
    want = sorted(zip([i if i is not None else -1 for i, _ in rows], fps, closure([i for i, _ in rows], fps, 4), strict=True))
    assert got == want


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wide_links_span_all_near_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (5, 4), dtype=np.uint64)
    fps = base[rng.integers(0, 5, 150)]
    for _ in range(40):
        fps[:, rng.integers(0, 4)] ^= np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)
    whole = [sum(int(x) << 64 * i for i, x in enumerate(r)) for r in fps]
    links = list(zip(*bucket_links(fps, np.zeros(150, np.int64), 45), strict=True))
    root = list(range(150))
    for _ in range(150):
        for x, y in links:
            root[x] = root[y] = min(root[x], root[y])
    assert root == closure(list(range(150)), whole, 45)


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(2)
    say = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    rows, group = [], []
    for g in range(40):
        text = say(int(rng.integers(60, 500)))
        for c in range(int(rng.integers(1, 5))):
            copy = list(text)
            for _ in range(int(c > 0) * max(1, len(text) // 150)):
                copy[int(rng.integers(0, len(copy)))] = "changed"
            rows.append((len(rows) + 10, " ".join(copy)))
            group.append(g)
    rows += [(None, rows[0][1]), (3, None), (4, ""), (7, "one two"), (8, "two one"), (10, rows[0][1])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, f0 string, node int")
    got = near_dedup(df)
    assert got.columns == df.columns
    kept = sorted(r.doc_id for r in got.collect())
    firsts = {}
    for (i, _), g in zip(rows, group, strict=False):
        firsts.setdefault(g, i)
    assert kept == sorted([*firsts.values(), 3, 7, 8])
    assert near_dedup(df.limit(0)).count() == 0 and 40 < radius_at(0.8) < 55


def test_near_dedup_is_exact_at_its_similarity(spark):
    rows, want = [], []
    for g in range(60):
        n = 304 if g % 2 else 100
        changed = (33 if g % 2 else 10) + (g % 4 > 1)  # shingles apart: 0.80 and more, or less for every other two
        words = [f"w{g}x{i}" for i in range(n)]
        copy = words[: n - changed] + [f"v{g}x{i}" for i in range(changed)]
        alike = (n - 4 - changed) / (n - 4 + changed)
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
        want += [2 * g] + [2 * g + 1] * (alike < 0.8)
        assert 0.77 < alike < 0.82
    kept = sorted(r.doc_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == want and 60 < len(want) < 120


def test_near_dedup_links_chains_in_one_bucket(spark):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # common shingles, and chains whose ends are far apart
        k = int(rng.integers(0, 70))
        rows.append((i, " ".join(base[: 120 - k] + [f"c{j}" for j in range(k)])))
    rows += [(200 + i, " ".join([f"q{i}x{j}" for j in range(60)] + base[:40])) for i in range(100)]
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(i, least.get(r, i))
    assert sorted(r.doc_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == sorted(least.values())
