import random
from hashlib import sha256
from zlib import crc32

from pyspark.sql import functions as F

from glyphmill.llm import merkle

SF = "/root/testdata/sf0.001"


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([merkle.hashed("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    return levels


def plain_manifest(rows):
    """(source, key) -> (leaf, subroot, root, proof, folded); rows: (source, key, leaf, forged) with distinct keys."""
    by = {}
    for source, key, leaf, forged in rows:
        by.setdefault(source, []).append((key is not None, key, leaf, forged))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:2])]) for s in order}
    top = plain_tree([trees[s][-1][0] for s in order])
    out = {}
    for t, s in enumerate(order):
        for i, (_, key, leaf, forged) in enumerate(sorted(by[s], key=lambda x: x[:2])):
            proof, folded = [], forged or leaf
            for levels, at in ((trees[s], i), (top, t)):
                for nodes in levels[:-1]:
                    run = at // 16 * 16
                    left, right = "".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])
                    proof.append(left + right)
                    folded, at = merkle.hashed(left + folded + right), at // 16
            out[s, key] = (leaf, trees[s][-1][0], top[-1][0], merkle.hashed("".join(proof)), folded)
    return out


def got(df):
    return {(r.source, r.key): (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in df.collect()}


def test_manifest_equals_a_plain_one(spark):
    rng = random.Random(5)
    sizes = {None: 1, "a": 16, "b": 17, "c": 1, "d": 256, "e": 257, "é": 4100, "Z": 300} | {f"s{i}": rng.randint(1, 20) for i in range(40)}
    rows = [(s, k * 3, merkle.hashed(f"{s}{k}"), merkle.hashed(f"x{s}{k}") if k % 5 == 0 else None) for s, n in sizes.items() for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "origin string, k long, leaf string, forged string").withColumn("source", F.lit(1))
    found = merkle.manifest(df, "origin", "k")
    assert got(found) == plain_manifest(rows)
    assert all(r.verified == (r.folded_root == r.root) for r in found.collect())


def test_small_and_odd_tables(spark):
    schema = "source string, k long, leaf string, forged string"
    assert merkle.manifest(spark.createDataFrame([], schema), "source", "k").count() == 0
    one = merkle.manifest(spark.createDataFrame([("a", None, "11", None)], schema), "source", "k").first()
    assert (one.subroot, one.root, one.verified, one.proof_sha256) == ("11", "11", True, sha256(b"").hexdigest())
    twins = merkle.manifest(spark.createDataFrame([("a", 1, "11", None), ("a", 1, "11", "22"), ("a", None, "33", None)], schema), "source", "k").collect()
    assert len(twins) == 3 and {r.root for r in twins} == {merkle.hashed("331111")} and sorted(r.verified for r in twins) == [False, True, True]


def test_forests_merge_in_any_order():
    rng = random.Random(9)
    sizes = {0: 300, 1: 1, 2: 17}
    nodes = [(t, i, merkle.hashed(f"{t}:{i}")) for t, n in sizes.items() for i in range(n)]
    want = None
    for _ in range(20):
        rng.shuffle(nodes)
        parts = [merkle.Forest(3) for _ in range(rng.randint(1, 9))]
        for t, i, d in nodes:
            p = rng.choice(parts)
            p.leaves[t] = sizes[t]
            p.add(t, 0, i, d)
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            parts.append(merkle.Forest.load(a.dump()).merge(b))
        assert not parts[0].waiting
        want = want or parts[0].root
        assert parts[0].root == want


def test_leaves_and_tampering(spark):
    rows = {r.doc_id: r for r in merkle.op11_merkle(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        parts = [str(d.doc_id), d.source, d.lang, str(d.n_chars), d.text]
        leaf = "".join("-" if v is None else f"{len(v.encode())}:{v}" for v in parts)
        assert rows[d.doc_id].leaf == merkle.hashed(leaf)
        forged = crc32(str(d.doc_id).encode()) % 5 == 0 and d.text != d.text.translate({c: c + 32 for c in range(65, 91)})
        assert rows[d.doc_id].verified == (not forged)
