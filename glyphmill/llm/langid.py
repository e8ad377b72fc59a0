"""Language identification by word-first backoff.

A known word counts with its log frequency in each language. An unseen word falls back to its character n-grams, the
longest length at which any of them is known; languages compare by the sum over all words of the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.arrowtext import Hasher, letters_lut, text_chunks, word_ranges
from glyphmill.session import materialise

FOLDS, HELD_FOLD = 5, 0
#: Documents to learn from in each language, as expected number: more are thinned by a hash of the id.
LEARN_DOCS = 2_000
LONGEST = 4
UNKNOWN = "und"
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked; for n = 1 the characters themselves."""
    marked = word if n == 1 else f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class LangModel:
    """langs in order; log priors; words by sorted hash, and n-grams, with a row of log frequencies for each language."""

    langs: list[str]
    prior: np.ndarray
    word_keys: np.ndarray
    word_rows: np.ndarray
    gram_at: dict[str, int]
    gram_rows: np.ndarray

    def backoff(self, word: str) -> list[int]:
        """Rows of the known n-grams of the longest length that has any."""
        for n in range(LONGEST, 0, -1):
            if found := [at for g in grams(word, n) if (at := self.gram_at.get(f"{n}{g}")) is not None]:
                return found
        return []


class Predictor:
    """Scores batches of texts; what it keeps between batches is a bounded cache of unseen words."""

    def __init__(self, model: LangModel) -> None:
        self.model, self.hasher, self.lut = model, Hasher(), letters_lut(digits=False)
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)), np.float32)

    def _unseen(self, keys: np.ndarray, words: list[bytes]) -> np.ndarray:
        lists = [self.model.backoff(w.decode("utf-8", "replace")) for w in words]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        out = np.zeros((len(keys), len(self.model.langs)), np.float32)
        some = np.flatnonzero(sizes)
        if len(some):
            flat = np.fromiter((x for xs in lists for x in xs), np.int64, int(sizes.sum()))
            edges = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            out[some] = np.add.reduceat(self.model.gram_rows[flat], edges, axis=0) / sizes[some][:, None]
        return out

    def vectors(self, keys: np.ndarray, word: callable) -> np.ndarray:
        """A row of evidence for each distinct word key; word(indices) gives their bytes."""
        out = np.zeros((len(keys), len(self.model.langs)), np.float32)
        left = np.ones(len(keys), bool)
        for known, rows in ((self.model.word_keys, self.model.word_rows), (self.keys, self.rows)):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = left & (known[at] == keys)
                out[hit] = rows[at[hit]]
                left &= ~hit
        todo = np.flatnonzero(left)
        if len(todo):
            out[todo] = self._unseen(keys[todo], word(todo))
            if len(self.keys) > 400_000:
                self.keys, self.rows = self.keys[:0], self.rows[:0]
            merged = np.concatenate((self.keys, keys[todo]))
            order = np.argsort(merged)
            self.keys, self.rows = merged[order], np.concatenate((self.rows, out[todo]))[order]
        return out

    def __call__(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Languages and scores of a column of texts."""
        names, scores = [], []
        for a, b, data, offs in text_chunks(pc.utf8_lower(column), 4 << 20):
            docs = b - a
            starts, ends, first = word_ranges(data, offs, self.lut)
            keys, at, back = np.unique(self.hasher(data, starts, ends), return_index=True, return_inverse=True)
            raw = data.tobytes()
            rows = self.vectors(keys, lambda some, at=at, raw=raw, starts=starts, ends=ends: [raw[starts[i] : ends[i]] for i in at[some]])
            doc = np.repeat(np.arange(docs), np.diff(first))
            total = np.tile(self.model.prior, (docs, 1))
            for j in range(len(self.model.langs)):
                total[:, j] += np.bincount(doc, rows[:, j][back].astype(np.float64), docs)
            best = total.argmax(1) if len(self.model.langs) else np.zeros(docs, np.int64)
            share = np.exp(total - total.max(1, keepdims=True)) if len(self.model.langs) else np.ones((docs, 1))
            share = share.max(1) / share.sum(1)
            plain = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))
            letters = plain[offs[1:]] > plain[offs[:-1]]
            for i in np.flatnonzero(~letters):
                letters[i] = any(c.isalpha() for c in raw[offs[i] : offs[i + 1]].decode("utf-8", "replace"))
            names += [self.model.langs[k] if ok and self.model.langs else UNKNOWN for k, ok in zip(best, letters, strict=True)]
            scores.append(np.where(letters & bool(self.model.langs), share, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def _spelt(marked, n: int):
    """The n-grams of a marked word, each after its length; a word that is too short gives one that is too short."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.concat(F.lit(str(n)), F.substring(marked, i, F.lit(n))))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Learns from rows with an id outside the held-out fold and a language.

    About LEARN_DOCS documents of each language count, chosen by a hash of the id. Words and n-grams are counted on
    the executors; the driver gets all those of the chosen documents. A language without words still has
    its prior; without any rows the model has no language and each text is ``und``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("id is not null and lang is not null").where(fold("id") != HELD_FOLD)
    sizes = dict(rows.groupBy("lang").count().collect())
    langs = sorted(sizes)
    prior = np.log(np.array([sizes[k] for k in langs], np.float64) / max(1, sum(sizes.values())))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, LEARN_DOCS / sizes[k])))])[F.col("lang")] if langs else F.lit(0.0)
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).where("text is not null").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: dict) -> pa.RecordBatch:
            table = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            cols = [pa.array([r[i] for r in table], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["lang", "g", "n"])

        held: dict[str, Counter] = {}
        for batch in batches:
            lowered = pc.utf8_lower(batch.column(1)).to_pylist()
            for lang, text in zip(batch.column(0).to_pylist(), lowered, strict=True):
                held.setdefault(lang, Counter()).update(_WORD.findall(text.encode()))
                if sum(map(len, held.values())) > 200_000:
                    yield out({k: Counter({w.decode("utf-8", "replace"): n for w, n in c.items()}) for k, c in held.items()})
                    held = {}
        yield out({k: Counter({w.decode("utf-8", "replace"): n for w, n in c.items()}) for k, c in held.items()})

    words = materialise(chosen.mapInArrow(run, "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")), "langid-words")
    spelt = F.flatten(F.array(*[_spelt(F.col("g") if n == 1 else F.concat(F.lit("<"), F.col("g"), F.lit(">")), n) for n in range(1, LONGEST + 1)]))
    parts = words.where("length(g) > 0").select("lang", "n", F.explode(spelt).alias("g")).where("length(g) = 1 + int(substring(g, 1, 1))")
    parts = materialise(parts.groupBy("lang", "g").agg(F.sum("n").alias("n")), "langid-grams")
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    word_names, word_rows = _table(words, langs, totals)
    hasher, keys = Hasher(), [np.zeros(0, np.uint64)]
    for _, _, data, offs in text_chunks(word_names, 4 << 20):
        keys.append(hasher(data, offs[:-1], offs[1:]))
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    sums = {}
    for r in parts.groupBy("lang", F.substring("g", 1, 1).alias("k")).agg(F.sum("n").alias("n")).collect():
        sums[r.lang, r.k] = r.n
    gram_names, gram_rows = _table(parts, langs, sums, by_length=True)
    return LangModel(langs, prior, keys[order], word_rows[order], {g: i for i, g in enumerate(gram_names.to_pylist())}, gram_rows)


def _table(counts: DataFrame, langs: list[str], totals: dict, by_length: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Names in order and a row of log frequencies for each; half a count stands for a language that lacks the name."""
    each = [F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))), F.lit(0)).alias(f"n{j}") for j, k in enumerate(langs)]
    got = counts.groupBy("g").agg(*each, F.count("*").alias("c")).drop("c").orderBy("g").toArrow()
    names = got.column("g").combine_chunks()
    table = np.zeros((len(names), len(langs)), np.float32)
    length = np.array(pc.utf8_slice_codeunits(names, 0, 1).to_pylist()) if by_length else None
    for j, k in enumerate(langs):
        n = np.maximum(got.column(f"n{j}").to_numpy().astype(np.float64), 0.5)
        whole = np.array([totals.get((k, x), 0) for x in "0123456789"])[length.astype(np.int64)] if by_length and len(names) else totals.get(k, 0)
        table[:, j] = np.log(n / (whole + 1.0))
    return names, table


def identify(docs: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (the share of the best language) for each document's whole text.

    A null text, a text without letters, and any text under a model without languages is ``und`` with score 0. Columns
    named lang_pred or score are replaced; other columns and repeated rows stay. The model has the words and
    n-grams of the documents it was learnt from (LEARN_DOCS a language) and is broadcast.
    """
    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(held.value)
        for batch in batches:
            names, scores = predict(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def op8_langid(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: learns from texts and languages outside fold 0, predicts for every text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs)).withColumn("held_out", F.coalesce(fold("doc_id") == HELD_FOLD, F.lit(False)))
    return found.select("doc_id", "held_out", "lang_pred", "score")
