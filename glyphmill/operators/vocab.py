"""Vocabulary algebra: byte-level conversion, special-token placement, merges, overlap and equality."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions.text import byte_alphabet, byte_fallback, clean_marker, placeholder
from glyphmill.operators.counts import substring_prior
from glyphmill.operators.ordering import numbered


def missing_alphabet(vocab: DataFrame) -> DataFrame:
    """(piece): byte characters that the vocabulary lacks."""
    letters = vocab.sparkSession.createDataFrame([(c,) for c in byte_alphabet().values()], "piece string")
    return letters.join(vocab.select("piece").distinct(), "piece", "left_anti")


def place_specials(pieces: DataFrame, specials: DataFrame) -> DataFrame:
    """(id, piece, is_special, old_id): special pieces at their reference ids, the others in order in the free ids.

    pieces: (rank, piece) in order; specials: (ref_id, piece), few. A special that is among the pieces is moved; a
    reference id beyond the end is appended, so its final id differs from old_id.
    """
    others = pieces.join(F.broadcast(specials.select("piece")), "piece", "left_anti")
    n = others.count()
    reserved = sorted(r.ref_id for r in specials.select("ref_id").collect())
    total = n + len(reserved)
    inside, final = [], {}
    for i, ref in enumerate(reserved):
        # a special is inserted at its id if the list is that long by then
        at = min(ref, n + i)
        inside.append(at)
        final[ref] = at
    ranked = others.withColumn("r", F.row_number().over(Window.orderBy("rank")) - 1)
    free = [x for x in range(total) if x not in set(inside)] if total <= 1 << 16 else None
    if free is not None:
        ids = pieces.sparkSession.createDataFrame(list(enumerate(free)), "r int, id int") if free else pieces.sparkSession.createDataFrame([], "r int, id int")
        placed = ranked.join(ids, "r")
    else:  # the r-th free id is r plus the reserved ids at or before it
        shift = F.lit(0)
        for i, at in enumerate(inside):
            shift = shift + F.when(F.col("r") >= at - i, 1).otherwise(0)
        placed = ranked.withColumn("id", F.col("r") + shift)
    moved = F.create_map(*[F.lit(x) for kv in final.items() for x in kv]) if final else F.create_map().cast("map<int,int>")
    special = specials.select(moved[F.col("ref_id")].cast("int").alias("id"), "piece", F.lit(True).alias("is_special"), F.col("ref_id").cast("int").alias("old_id"))
    return placed.select(F.col("id").cast("int").alias("id"), "piece", F.lit(False).alias("is_special"), F.lit(None).cast("int").alias("old_id")).unionByName(special)


def to_byte_vocab(vocab: DataFrame, space_marker: str = "▁", continuation: str | None = None, keep_blanks: bool = True) -> DataFrame:
    """(id, piece, score, is_special) in byte-level form: markers cleaned, byte pieces decoded unless their character is
    a piece already, runs of blanks renamed unless they're kept, missing byte characters appended at -100000."""
    cleaned = vocab.withColumn("_clean", F.when(F.col("is_special"), F.col("piece")).otherwise(clean_marker(F.col("piece"), space_marker, continuation)))
    have = cleaned.select(F.col("_clean").alias("_byte")).distinct()
    cleaned = cleaned.withColumn("_byte", byte_fallback(F.col("piece")))
    cleaned = cleaned.join(have.withColumn("_have", F.lit(True)), "_byte", "left")
    piece = F.when(F.col("_byte").isNotNull() & F.col("_have").isNull(), F.col("_byte")).when(F.col("_byte").isNotNull(), F.col("piece")).otherwise(F.col("_clean"))
    out = cleaned.withColumn("piece", piece).select("id", "piece", "score", "is_special")
    if not keep_blanks:
        renamed = placeholder(F.col("piece"), F.col("id"))
        out = out.withColumn("score", F.when(renamed != F.col("piece"), F.lit(-100000.0)).otherwise(F.col("score"))).withColumn("piece", renamed)
    last = out.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last"))
    extra = missing_alphabet(out).crossJoin(F.broadcast(last)).withColumn("id", (F.col("last") + F.row_number().over(Window.orderBy("piece"))).cast("int"))
    return out.unionByName(extra.select("id", "piece", F.lit(-100000.0).alias("score"), F.lit(False).alias("is_special")))


def overlap(target: DataFrame, source: DataFrame) -> DataFrame:
    """(id, piece, source_id): the source id of each target piece, null if the source lacks it."""
    return target.join(source.select("piece", F.col("id").alias("source_id")), "piece", "left").select("id", "piece", "source_id")


def with_scores(vocab: DataFrame, scores: DataFrame, default: float = 0.0) -> DataFrame:
    return vocab.join(scores.select("piece", "score"), "piece", "left").withColumn("score", F.coalesce("score", F.lit(default)))


def distinct_merges(merges: DataFrame) -> DataFrame:
    """(rank, left, right): merges once each, in the order of first appearance."""
    first = merges.groupBy("left", "right").agg(F.min("rank").alias("first"))
    return first.select((F.row_number().over(Window.orderBy("first")) - 1).alias("rank"), "left", "right")


def later_wins(parts: Iterable[DataFrame], key: str) -> DataFrame:
    """The union of maps; a key of a later part replaces that of an earlier one."""
    parts = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    value = [c for c in whole.columns if c not in (key, "_part")]
    best = whole.groupBy(key).agg(F.max_by(F.struct(*value), "_part").alias("v"))
    return best.select(key, "v.*")


def same_vocab(a: DataFrame, b: DataFrame) -> bool:
    """Whether two vocabularies have the same pieces at the same ids."""
    x, y = a.select("id", "piece"), b.select("id", "piece")
    return not x.exceptAll(y).unionByName(y.exceptAll(x)).take(1)


def ordered_concat(parts: Iterable[DataFrame]) -> DataFrame:
    """(rank, piece): lists (rank, piece) one after the other."""
    whole = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("_part"), "rank", "piece")
        whole = p if whole is None else whole.unionByName(p)
    return whole.select((F.row_number().over(Window.orderBy("_part", "rank")) - 1).alias("rank"), "piece")


def gather_pieces(vocab: DataFrame, indices: DataFrame) -> DataFrame:
    """(pos, piece): a new vocabulary from stored positions (pos, id)."""
    return indices.join(vocab.select("id", "piece"), "id").select("pos", "piece")


def repair_merges(pieces: list[str], merges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Merges that can build every piece, for a vocabulary small enough for the driver.

    A piece that the merges already build keeps them. Any other piece is put together from left to right, so each of
    its beginnings becomes a merge after the existing ones; merges stay in order and unique.
    """
    built = {a + b for a, b in merges}
    out = list(dict.fromkeys(merges))
    known = set(out)
    for piece in sorted(p for p in pieces if len(p) > 1 and p not in built):
        for i in range(1, len(piece)):
            step = (piece[:i], piece[i])
            if piece[: i + 1] not in built and step not in known:
                out.append(step)
                known.add(step)
                built.add(piece[: i + 1])
    return out


def repaired_merges(pieces: DataFrame, merges: DataFrame) -> DataFrame:
    """(rank, left, right): ``repair_merges`` over tables (piece) and (rank, left, right) of any size.

    Each beginning, from two characters on, of a piece that no merge builds becomes a merge of what stands before its last
    character with that, unless a merge builds it already; those new ones follow the existing merges, by the first piece
    in order that needs them and by length. A pair that repeats keeps its first rank.
    """
    first = merges.groupBy("left", "right").agg(F.min("rank").alias("rank"))
    built = first.select(F.concat("left", "right").alias("piece")).distinct()
    missing = pieces.where(F.length("piece") > 1).select("piece").distinct().join(built, "piece", "left_anti")
    parts = missing.select(F.col("piece").alias("of"), F.explode(F.sequence(F.lit(2), F.length("piece"))).alias("n"))
    parts = parts.select("of", F.substring(F.col("of"), F.lit(1), F.col("n")).alias("piece")).join(built, "piece", "left_anti")
    new = parts.groupBy("piece").agg(F.min("of").alias("of")).withColumn("n", F.length("piece"))
    new = new.select("of", "n", F.substring(F.col("piece"), F.lit(1), F.col("n") - 1).alias("left"), F.substring(F.col("piece"), F.col("n"), F.lit(1)).alias("right"), F.lit(1).alias("late"), F.lit(0).cast("long").alias("rank"))
    both = first.select(F.lit("").alias("of"), F.lit(0).alias("n"), "left", "right", F.lit(0).alias("late"), F.col("rank").cast("long").alias("rank")).unionByName(new)
    return numbered(both, "at", ["late", "rank", "of", "n"]).select(F.col("at").alias("rank"), "left", "right")


def fix_template(node, ids: dict[str, int]):
    """A post-processor document with the ids of its special tokens taken from ``ids``, at any depth of sequences."""
    if isinstance(node, list):
        return [fix_template(x, ids) for x in node]
    if not isinstance(node, dict):
        return node
    kind = node.get("type")
    if kind == "TemplateProcessing":
        special = {k: v | {"ids": [ids[t] for t in v["tokens"]]} for k, v in node.get("special_tokens", {}).items()}
        return node | {"special_tokens": special}
    if kind == "RobertaProcessing":
        return node | {k: [node[k][0], ids[node[k][0]]] for k in ("sep", "cls")}
    return {k: fix_template(v, ids) for k, v in node.items()}


def same_specials(a: dict, b: dict) -> bool:
    """Whether the seven special-token settings of two vocabularies agree."""
    names = ("bos_token", "eos_token", "unk_token", "sep_token", "pad_token", "cls_token", "mask_token")
    return all(a.get(n) == b.get(n) for n in names)


def remap(ids: Column, mapping: dict[int, int]) -> Column:
    """Ids through a small map; others, and the ignored label -100, pass."""
    if not mapping:
        return ids
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.transform(ids, lambda x: F.coalesce(F.element_at(table, x), x))


def match_specials(target: DataFrame, source: DataFrame) -> DataFrame:
    """(name, piece, source_piece, id, source_id): special pieces (name, piece, id) of two vocabularies that stand for the
    same thing, whatever their texts; a name that the source lacks has nulls."""
    other = source.select("name", F.col("piece").alias("source_piece"), F.col("id").alias("source_id"))
    return target.select("name", "piece", "id").join(other, "name", "left")


def seed_unigram(vocab: DataFrame, counts: DataFrame, **markers) -> DataFrame:
    """(id, piece, is_special, score): a vocabulary (id, piece, is_special) in byte-level form, scored by the substring
    prior over counts of byte-level pre-tokens (pretoken, n). ``markers`` go to to_byte_vocab."""
    byte_level = to_byte_vocab(vocab.withColumn("score", F.lit(0.0)), **markers)
    return substring_prior(counts, byte_level).select("id", "piece", "is_special", F.col("logp").alias("score"))


def dense_remap(sequences: DataFrame, seq: str = "seq_id", ids: str = "ids") -> DataFrame:
    """(seq, ids): ids as their places among all ids in use, in order; negative ids (the ignored label) pass.

    A sequence's ids are put together again by position, so a group has a sequence's length.
    """
    each = sequences.select(seq, F.posexplode(ids).alias("_at", "_id"))
    used = numbered(each.where("_id >= 0").select(F.col("_id").alias("_used")).distinct(), "_new", ["_used"])
    found = each.join(used, F.col("_id") == F.col("_used"), "left")
    item = F.struct("_at", F.coalesce("_new", F.col("_id").cast("long")).alias("x"))
    out = found.groupBy(seq).agg(F.array_sort(F.collect_list(item)).alias("_x")).select(seq, F.transform("_x", lambda e: e["x"]).alias(ids))
    empty = sequences.where(F.coalesce(F.size(ids), F.lit(0)) < 1).select(seq, F.array().cast("array<bigint>").alias(ids))
    return out.unionByName(empty)
