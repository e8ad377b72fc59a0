"""Merkle manifest of a dataset: a tree for each source, a tree over the sources' roots, and a proof for each row.

A tree's nodes are keyed by level and index, and the number of nodes at each level follows from the number of leaves, so it
is known when all siblings of a run have come. A forest holds the nodes whose siblings have not all come yet; adding the
nodes of another forest to it is associative and commutative, as a run gives the same parent whoever completes it. Tasks
reduce a contiguous range of leaves to such a forest, and treeReduce merges these into one root.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.ordering import numbered
from glyphmill.session import materialise

#: Siblings of a run, as a power of two.
BITS = 4
#: Levels whose runs lie inside a block of leaves (256), which is hashed by one task when proofs are made.
BLOCK_LEVELS = 2
#: The tree over the sources' roots; sources' trees are numbered from 0.
TOP = -1


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes at a level of a tree of n leaves."""
    return -(-n >> BITS * level)


class Forest:
    """Nodes that wait for siblings: {(tree, level, run): {place in the run: digest}}, and the leaves of each tree."""

    def __init__(self, sources: int) -> None:
        self.waiting: dict[tuple[int, int, int], dict[int, str]] = {}
        self.leaves = {TOP: sources}
        self.runs: list[tuple[int, int, int, str]] = []
        self.root: str | None = None

    def add(self, tree: int, level: int, index: int, digest: str) -> None:
        """Adds a node; where that completes a run, its parent too, and so on up to the root."""
        while True:
            nodes = width(self.leaves[tree], level)
            if nodes == 1:
                if tree == TOP:
                    self.root = digest
                    return
                tree, level, index = TOP, 0, tree
                continue
            run = index >> BITS
            key = (tree, level, run)
            held = self.waiting.setdefault(key, {})
            held[index & (1 << BITS) - 1] = digest
            if len(held) < min(1 << BITS, nodes - (run << BITS)):
                return
            del self.waiting[key]
            if len(held) == 1:
                together = digest
            else:
                together = "".join([held[i] for i in range(len(held))])
            if tree == TOP or level >= BLOCK_LEVELS:
                self.runs.append((tree, level, run, together))
            digest, level, index = hashed(together), level + 1, run

    def merge(self, other: Forest) -> Forest:
        """The forest of both sides' nodes."""
        self.leaves |= other.leaves
        self.runs += other.runs
        self.root = self.root or other.root
        for (tree, level, run), held in other.waiting.items():
            for place, digest in held.items():
                self.add(tree, level, (run << BITS) + place, digest)
        return self

    def dump(self) -> str:
        """As text: what waits, and of how many leaves its trees are; runs are not part of it."""
        trees = {k[0] for k in self.waiting} | {TOP}
        return json.dumps([{str(t): self.leaves[t] for t in trees}, [[*k, list(v.items())] for k, v in self.waiting.items()], self.root])

    @classmethod
    def load(cls, text: str) -> Forest:
        leaves, waiting, root = json.loads(text)
        out = cls(leaves[str(TOP)])
        out.leaves = {int(t): n for t, n in leaves.items()}
        out.waiting = {(t, level, run): dict(map(tuple, held)) for t, level, run, held in waiting}
        out.root = root
        return out


def leaf(columns: list[Column]) -> Column:
    """H of the columns one after the other: `-` for null, else the number of UTF-8 bytes, `:` and the value."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*each), 256)


def _forests(rows: DataFrame, sources: int) -> DataFrame:
    """Rows (tree, level, run, nodes) of the runs above blocks that a range of leaves completes, and one row (forest) for
    each range with what waits there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kinds = Forest(sources), [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["tree", "level", "run", "nodes", "forest"])

        seen = False
        for batch in batches:
            for tree, n, index, digest in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                seen = True
                forest.leaves[tree] = n
                forest.add(tree, 0, index, digest)
            if forest.runs:
                yield out([(*r, None) for r in forest.runs])
                forest.runs = []
        if seen:
            yield out([(None, None, None, None, forest.dump())])

    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("tree", "n", "pos", "leaf").repartitionByRange(ranges, "tree", F.shiftright("pos", BITS * BLOCK_LEVELS)).sortWithinPartitions("tree", "pos")
    return ordered.mapInArrow(run, "tree long, level int, run long, nodes string, forest string")


def reduce_forests(forests: DataFrame, sources: int) -> Forest:
    """The forest of all ranges: neighbours are merged sixteen at a time by range number while there are many, so that what
    waits on their common edges is resolved early, then all by treeReduce. Each range adds a run or two for each level."""
    rows = forests.select("at", "forest").rdd.map(lambda r: (r[0], Forest.load(r[1])))
    count = forests.count()
    while count > 256:
        rows = rows.map(lambda kv: (kv[0] >> 4, kv[1])).reduceByKey(Forest.merge)
        count = -(-count >> 4)
    return rows.values().treeReduce(Forest.merge) if count else Forest(sources)


def _paths(blocks: DataFrame, runs: DataFrame, levels: int) -> DataFrame:
    """(tree, block, path): for each block the steps from its top node to the root, (own, left, right): whether the step is
    in the source's own tree, and the siblings to either side as joined digests."""
    step = "struct<own: boolean, left: string, right: string>"
    above = F.col("n") > (1 << BITS * BLOCK_LEVELS)
    at = blocks.select("tree", "block", "n", F.array().cast(f"array<{step}>").alias("path"))
    at = at.select("*", F.when(above, F.col("tree")).otherwise(TOP).alias("_t"), F.when(above, BLOCK_LEVELS).otherwise(0).alias("_l"), F.when(above, F.col("block")).otherwise(F.col("tree")).alias("_i"))
    found = runs.select(F.col("tree").alias("_t"), F.col("level").alias("_l"), F.col("run").alias("_r"), "nodes")
    cut = (F.col("_i") % (1 << BITS)) * 64
    mine = F.struct((F.col("_t") != TOP).alias("own"), F.substr("nodes", F.lit(1), cut).alias("left"), F.substr("nodes", cut + 65).alias("right"))
    for _ in range(levels):
        at = at.withColumn("_r", F.shiftright("_i", BITS)).join(found, ["_t", "_l", "_r"], "left")
        at = at.withColumn("path", F.when(F.col("nodes").isNull(), F.col("path")).otherwise(F.concat("path", F.array(mine))))
        # the node above; a source's root is a leaf of the top tree
        subroot = (F.col("_t") != TOP) & (F.ceil(F.col("n") / F.pow(F.lit(1 << BITS), F.col("_l") + 1)) == 1)
        at = at.select("tree", "block", "n", "path", F.when(subroot, TOP).otherwise(F.col("_t")).alias("_t"), F.when(subroot, 0).otherwise(F.col("_l") + 1).alias("_l"), F.when(subroot, F.col("tree")).otherwise(F.col("_r")).alias("_i"))
    return materialise(at.select("tree", "block", "path"), "merkle-paths")


def prove_block(leaves: list[str], forged: list[str | None], path: list[dict], first: int, last_block: bool) -> tuple[list[str], list[str], str]:
    """For each leaf of a block its proof's hash and the root that follows from the forged leaf (else the leaf) and the
    proof; and the source's own root. A block is the leaves from ``first`` on, all of a run's siblings at its levels."""
    levels, now = [], leaves
    for _ in range(BLOCK_LEVELS):
        if len(now) == 1 and first == 0 and last_block:
            break  # the root of a tree that ends inside its only block
        levels.append(now)
        now = [hashed("".join(now[i : i + (1 << BITS)])) for i in range(0, len(now), 1 << BITS)]
    own = now[0]
    for x in path:
        if x["own"]:
            own = hashed(x["left"] + own + x["right"])
    tail = "".join([x["left"] + x["right"] for x in path])
    proofs, folded = [], []
    for i in range(len(leaves)):
        at, digest, sides = i, forged[i] or leaves[i], []
        for nodes in levels:
            start = at >> BITS << BITS
            left, right = "".join(nodes[start:at]), "".join(nodes[at + 1 : start + (1 << BITS)])
            sides += (left, right)
            digest, at = hashed(left + digest + right), at >> BITS
        for x in path:
            digest = hashed(x["left"] + digest + x["right"])
        proofs.append(hashed("".join(sides) + tail))
        folded.append(digest)
    return proofs, folded, own


def manifest(rows: DataFrame, source: str, key: str, leaf_col: str = "leaf", forged_col: str = "forged") -> DataFrame:
    """(source, key, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of a table with leaf digests.

    A source's leaves ascend by key (null first), ties by leaf, then in any way, as equal leaves are interchangeable but for
    their proofs; a null source is a source, the first. forged is a leaf to try against the proof instead of the row's own
    (null: its own). An empty table gives an empty result; repeated rows are leaves of their own; other columns go.

    Leaves are numbered without a task that sorts a source. A source of any size is cut into blocks of 256 leaves; what
    crosses a block is a node for each, held in tables. To the driver come the root and, for each range of leaves, the few runs
    that end in another range.
    """
    spark = rows.sparkSession
    held = rows.select(F.col(source).alias("source"), F.col(key).alias("key"), F.col(leaf_col).alias("leaf"), F.col(forged_col).alias("forged"))
    placed = numbered(held, "pos", ["key", "leaf"], ["source"])
    sizes = materialise(numbered(placed.groupBy("source").agg(F.count("*").alias("n")), "tree", ["source"]), "merkle-trees")
    sources, most = sizes.agg(F.count("*"), F.max("n")).first()
    known = sizes.select(F.col("source").alias("_source"), "n", "tree")
    leaves = materialise(placed.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "merkle-leaves")
    made = materialise(_forests(leaves, sources).withColumn("at", F.spark_partition_id()), "merkle-forests")
    forest = reduce_forests(made.where("forest is not null"), sources)
    late = spark.createDataFrame(forest.runs, "tree long, level int, run long, nodes string")
    runs = made.where("forest is null").select("tree", "level", "run", "nodes").unionByName(late)

    def levels(n: int) -> int:
        return next(x for x in range(64) if width(n, x) <= 1)

    block = F.shiftright("pos", BITS * BLOCK_LEVELS)
    blocks = leaves.select("tree", "n", block.alias("block")).distinct()
    paths = _paths(blocks, runs, max(0, levels(most or 0) - BLOCK_LEVELS) + levels(sources))
    root = forest.root

    def prove(mine: pa.Table, path: pa.Table) -> pa.Table:
        mine = mine.sort_by("pos")
        first, n = mine.column("pos")[0].as_py(), mine.column("n")[0].as_py()
        ended = first + len(mine) == n
        proofs, folded, own = prove_block(mine.column("leaf").to_pylist(), mine.column("forged").to_pylist(), path.column("path")[0].as_py(), first, ended)
        some = mine.select(["source", "key", "leaf"])
        for name, values in (("subroot", [own] * len(mine)), ("root", [root] * len(mine)), ("proof_sha256", proofs), ("folded_root", folded)):
            some = some.append_column(name, pa.array(values, pa.string()))
        return some.append_column("verified", pa.array([f == root for f in folded], pa.bool_()))

    kinds = dict(held.dtypes)
    schema = f"source {kinds['source']}, key {kinds['key']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    ours = leaves.withColumn("block", block).groupBy("tree", "block")
    return ours.cogroup(paths.groupBy("tree", "block")).applyInArrow(prove, schema)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """All documents: leaves, roots, proofs, and for a fifth of them the root that a lower-cased text would give."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = docs.select("doc_id", "source", leaf([*columns, F.col("text")]).alias("leaf"), F.when(tampered, leaf([*columns, lowered])).alias("forged"))
    return manifest(rows, "source", "doc_id").withColumnRenamed("key", "doc_id").drop("source")


#: Nodes level by level and the forged leaves' way up, by recursion; CRC-32 by its bitwise definition.
OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS t,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 5 = 0 AS forge FROM documents),
h AS (SELECT doc_id, source, sha256(a || t) AS leaf, CASE WHEN forge THEN sha256(a || low) END AS forged FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM h GROUP BY source),
x AS (SELECT l.*, s.n, s.tree FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source),
n AS (SELECT tree, 0 AS level, pos AS i, leaf AS d, n FROM x
  UNION ALL SELECT tree, level + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), (n + 15) // 16 FROM n WHERE n > 1 GROUP BY tree, level, i // 16, n),
sub AS (SELECT tree, max(level) AS top, arg_max(d, level) AS d FROM n GROUP BY tree),
m AS (SELECT 0 AS level, tree AS i, d, (SELECT count(*) FROM s) AS n FROM sub
  UNION ALL SELECT level + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), (n + 15) // 16 FROM m WHERE n > 1 GROUP BY level, i // 16, n),
r AS (SELECT max(level) AS top, arg_max(d, level) AS root FROM m),
nodes AS (SELECT tree, level, i, d FROM n UNION ALL SELECT -1, level, i, d FROM m),
way AS (SELECT x.tree AS own, pos, x.tree AS tree, level, pos // CAST(pow(16, level) AS BIGINT) AS i, level AS step FROM x JOIN sub USING (tree), (SELECT unnest(range(20)) AS level) WHERE level < top
  UNION ALL SELECT x.tree, pos, -1, level, x.tree // CAST(pow(16, level) AS BIGINT), sub.top + level FROM x JOIN sub USING (tree), r, (SELECT unnest(range(20)) AS level) WHERE level < r.top),
side AS (SELECT own, pos, step, coalesce(string_agg(d, '' ORDER BY nodes.i) FILTER (nodes.i < way.i), '') AS lo, coalesce(string_agg(d, '' ORDER BY nodes.i) FILTER (nodes.i > way.i), '') AS hi
  FROM way JOIN nodes ON nodes.tree = way.tree AND nodes.level = way.level AND nodes.i // 16 = way.i // 16 GROUP BY own, pos, step),
proof AS (SELECT own, pos, sha256(string_agg(lo || hi, '' ORDER BY step)) AS p FROM side GROUP BY own, pos),
f AS (SELECT tree AS own, pos, 0 AS step, coalesce(forged, leaf) AS d FROM x UNION ALL SELECT f.own, f.pos, f.step + 1, sha256(lo || d || hi) FROM f JOIN side USING (own, pos, step)),
folded AS (SELECT own, pos, arg_max(d, step) AS folded_root FROM f GROUP BY own, pos)
SELECT doc_id, leaf, sub.d AS subroot, root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM x JOIN sub USING (tree) CROSS JOIN r LEFT JOIN proof ON proof.own = x.tree AND proof.pos = x.pos JOIN folded ON folded.own = x.tree AND folded.pos = x.pos
"""
