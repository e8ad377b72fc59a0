"""License scans by diagonal voting.

All rolling word k-grams of all texts are joined, by hash, to the places where they stand in license templates. A template
that stands in a text, whole or with some words changed, gives many pairs (place in the text, place in the template) of
one difference, the diagonal; words put in or left out move the rest to a diagonal nearby. Pairs are counted for each
diagonal, neighbouring diagonals are merged, and what is found is verified against the text's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.llm.arrowtext import Hasher, letters_lut, pair, text_chunks, word_ranges
from glyphmill.session import materialise

#: Phrases that are looked for exactly, and their labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Public license texts and notices as (label, words that must stand in a place, text).
TEMPLATES = (
    ("mit", "mit", "Released under the MIT License"),
    ("mit", "mit", "Licensed under the MIT License"),
    ("mit", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache-2", "apache 2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2", "gnu 2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "gnu 3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "gnu 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3", "lesser 3", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "affero 3", "licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0"),
)


@dataclass(frozen=True)
class Scan:
    """Words of a rolling gram, the share of a template's grams that must vote, and the share of its words that must stand
    in the text in their order."""

    gram: int = 3
    votes: float = 0.2
    similarity: float = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    must: tuple[int, ...]
    words: np.ndarray

    def slack(self) -> int:
        """How far apart diagonals of one place may be."""
        return min(8, len(self.words) // 4)


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_ranges(data, np.array([0, len(data)]), letters_lut(digits=True))
    return Hasher()(data, starts, ends)


def templates(given=TEMPLATES, phrases=PHRASES) -> list[Template]:
    """The templates as word hashes; a phrase is a template all of whose words must stand."""
    out = [Template(label, tuple(_hashes(must).tolist()), _hashes(text)) for label, must, text in given]
    return out + [Template(label, tuple(_hashes(text).tolist()), _hashes(text)) for label, text in phrases]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Keys of the k words from each place on."""
    n = max(0, len(words) - k + 1)
    key = words[:n]
    for i in range(1, k):
        key = pair(key, words[i : n + i])
    return key


def template_places(spark: SparkSession, known: list[Template], scan: Scan) -> DataFrame:
    """(key, template, place) of all grams of all templates: a table as large as the stated templates."""
    rows = [(int(key), t, i) for t, x in enumerate(known) for i, key in enumerate(grams(x.words, scan.gram).view(np.int64).tolist())]
    return spark.createDataFrame(rows, "key long, template int, place int")


def _phrases(docs: DataFrame, phrases) -> DataFrame:
    """(doc_id, text_hash, n_words, n_base, first_word, last_word, base_labels) for each row: where phrases stand exactly."""
    wanted = [(label, [w.encode() for w in text.split()], _hashes(text)) for label, text in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lut = Hasher(), letters_lut(digits=True)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(2), 1 << 22):
                starts, ends, first = word_ranges(data, offsets, lut)
                h, n, found = hasher(data, starts, ends), hi - lo, {}
                for label, spelt, words in wanted:
                    k = len(words)
                    at = np.flatnonzero(h[: max(0, len(h) - k + 1)] == words[0])
                    for i in range(1, k):
                        at = at[h[at + i] == words[i]]
                    for i in at.tolist():
                        doc = int(np.searchsorted(first, i, side="right")) - 1
                        if i + k <= first[doc + 1] and all(data[starts[i + j] : ends[i + j]].tobytes().lower() == w for j, w in enumerate(spelt)):
                            found.setdefault(doc, []).append((i - int(first[doc]), label))
                sizes = np.diff(first)
                places = [sorted(found.get(i, ())) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        batch.column(1).slice(lo, n),
                        pa.array(sizes, pa.int64()),
                        pa.array([len(p) for p in places], pa.int64()),
                        pa.array([p[0][0] if p else None for p in places], pa.int64()),
                        pa.array([p[-1][0] if p else None for p in places], pa.int64()),
                        pa.array([sorted({label for _, label in p}) for p in places], pa.list_(pa.string())),
                    ],
                    ["doc_id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, n_words long, n_base long, first_word long, last_word long, base array<string>")


def _rolling(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, at, key): every rolling gram of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lut = Hasher(), letters_lut(digits=True)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(2), 1 << 20):
                starts, ends, first = word_ranges(data, offsets, lut)
                key = grams(hasher(data, starts, ends), k)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                at = np.arange(len(key))
                whole = doc[: len(key)] == doc[k - 1 : k - 1 + len(key)]
                doc, at, key = doc[: len(key)][whole], at[whole], key[whole]
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - first[doc]).astype(np.int32)), pa.array(key.view(np.int64))],
                    ["doc_id", "text_hash", "at", "key"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, at int, key long")


def votes(docs: DataFrame, known: list[Template], scan: Scan) -> DataFrame:
    """(doc_id, text_hash, template, low, high, n): merged diagonals of a text and a template with enough pairs. A
    neighbouring diagonal is one within the template's slack of the one below."""
    spark = docs.sparkSession
    places = template_places(spark, known, scan)
    hit = _rolling(docs, scan.gram).join(F.broadcast(places), "key")  # as many rows as the stated templates have words
    pairs = hit.select("doc_id", "text_hash", "template", "at", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    counted = pairs.groupBy("doc_id", "text_hash", "template", "diagonal").agg(F.count("*").alias("n"))
    limits = spark.createDataFrame([(t, x.slack(), float(max(1, scan.votes * (len(x.words) - scan.gram + 1)))) for t, x in enumerate(known)], "template int, slack int, least double")
    counted = counted.join(F.broadcast(limits), "template")
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.col("slack"), F.lit(True))
    grouped = counted.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("doc_id", "text_hash", "template", "run", "least").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("n").alias("n"))
    return merged.where("n >= least").select("doc_id", "text_hash", "template", "low", "high", "n")


def common_words(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The length of the longest common subsequence of a and b, and after how many of b it is reached."""
    best = np.zeros(len(b) + 1, np.int64)
    for x in a:
        best[1:] = np.maximum(best[1:], best[:-1] + (b == x))
        np.maximum.accumulate(best, out=best)
    return int(best[-1]), int(np.searchsorted(best, best[-1]))


def verify(words: np.ndarray, found: list[dict], known: list[Template], scan: Scan) -> list[tuple[int, int, str, float]]:
    """(first, end, label, score) of the places that hold the asked share of a template's words in order, and the words
    that must stand. Of overlapping places the one with more words of its template stays, then the one with the larger share."""
    held = []
    for x in found:
        t = known[x["template"]]
        first, end = max(0, x["low"]), min(len(words), x["high"] + len(t.words))
        own = words[first:end]
        common, reached = common_words(t.words, own)
        score = common / len(t.words)
        if score >= scan.similarity and set(t.must) <= set(own.tolist()):
            skipped = len(own) - common_words(t.words[::-1], own[::-1])[1]
            held.append((min(skipped, reached), reached, common, score, t.label, first))
    out: list[tuple[int, int, str, float]] = []
    for skipped, reached, _, score, label, first in sorted(held, key=lambda x: (-x[2], -x[3], x[5], x[4])):
        a, b = first + skipped, first + reached
        if all(b <= c or d <= a for c, d, _, _ in out):
            out.append((a, b, label, score))
    return sorted(out)


def _verified(docs: DataFrame, found: DataFrame, known: list[Template], scan: Scan) -> DataFrame:
    """(doc_id, text_hash, spans) of the texts with a verified place. Only texts with merged diagonals are read again and
    shuffled: a bit table of at most 2^18 rows of 64 bits leaves out nearly all others."""
    place = F.struct("template", "low", "high")
    asked = materialise(found.groupBy("doc_id", "text_hash").agg(F.collect_list(place).alias("found")), "license-places")
    slot, bit = F.col("text_hash").bitwiseAND((1 << 18) - 1), F.shiftrightunsigned("text_hash", 18).bitwiseAND(63).cast("int")
    table = asked.groupBy(slot.alias("_slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    some = docs.withColumn("_slot", slot).join(F.broadcast(table), "_slot").where(F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(1) == 1)
    mine = asked.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "found")
    some = some.join(mine, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))).select("doc_id", "text_hash", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lut = Hasher(), letters_lut(digits=True)
        for batch in batches:
            asked = batch.column(3).to_pylist()
            for lo, hi, data, offsets in text_chunks(batch.column(2), 1 << 22):
                starts, ends, first = word_ranges(data, offsets, lut)
                h = hasher(data, starts, ends)
                spans = [verify(h[first[i - lo] : first[i - lo + 1]], asked[i], known, scan) for i in range(lo, hi)]
                rows = [[{"first": a, "end": b, "label": x, "score": s} for a, b, x, s in each] for each in spans]
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(rows, kind)], ["doc_id", "text_hash", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = some.mapInArrow(run, f"doc_id {kind}, text_hash long, spans array<struct<first: long, end: long, label: string, score: double>>")
    return out.where(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.any_value("spans").alias("spans"))


def scan_licenses(docs: DataFrame, given=TEMPLATES, phrases=PHRASES, scan: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base, spans) for each row: where phrases stand exactly, and the
    verified places (first word, end, label, share of the template's words) of templates and phrases.

    Words are runs of letters and digits, A-Z as a-z. Null, empty and wordless texts have no words and no places. A null id
    is kept; rows that repeat id and text get the same places; other columns go. A long text is scanned as a whole. An
    empty table gives an empty result. No text is shuffled but those that may hold a template; only the templates' places
    and a bit table of fixed size are broadcast.
    """
    known = templates(given, phrases)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = _verified(rows, votes(rows, known, scan), known, scan)
    found = found.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "spans")
    base = _phrases(rows, phrases)
    both = base.join(found, base.doc_id.eqNullSafe(F.col("_doc")) & (base.text_hash == F.col("_hash")), "left")
    none = F.array().cast("array<struct<first: long, end: long, label: string, score: double>>")
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.coalesce("spans", none).alias("spans"))


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    """All documents: where the phrases stand, and all licenses found. The score is the best share of a template's words."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_sort(F.array_union("base", F.transform("spans", lambda x: x["label"])))
    best = F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)), (F.col("n_base") > 0).cast("double"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(names, ",").alias("labels"), best.alias("score"))
