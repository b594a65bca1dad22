"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory (operator 3).

A licence has several templates: its notice, title, SPDX tag and characteristic sentences of its
body. A template of n words is compared with every window of n consecutive words of every whole
text (a shorter text is one window), across line breaks and comment marks, as sparse TF-IDF
vectors. The weights' document counts cover all lines of all files (one aggregation over the
template vocabulary; a word outside it weighs as the rarest). Windows are not written out: a running
sum bounds a window's cosine from above, and only windows whose bound reaches :data:`COSINE` are
compared exactly; texts that hold too few of a template's words cannot have one.

A file's own licence is that of its best window (open licences before reserved rights, then cosine,
then the longer template); a file is a *licence file* if its name says so or at least half of its
words stand in matched windows. A file without an own licence inherits that of the nearest ancestor
directory that has a licence file; reserved rights are a licence of their own, so they stop an open
licence of a directory further up. Ancestors are exploded and joined to the directories' licences by
path, and the files to their directories with a salt, so a directory of a third of all files is
spread.

Defined results: null texts have no words; null paths have no directory; among equal windows the
smaller licence name wins, then the earlier window, among licence files of one directory the higher
cosine, then the smaller path; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staging, read_table, slices, small_batches, text_column, utf8, word_hashes, word_spans

COSINE, MAJORITY = 0.8, 0.5
#: Bytes of text compared at once.
SLICE_BYTES = 1_000_000

# Short notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Titles, SPDX tags and sentences by which the licences' own texts are known.
BODIES = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0 (the \"License\"); "
                   "you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only",
                "SPDX-License-Identifier: GPL-3.0-or-later"],
    "MIT": ["MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
            "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
}
#: Rights that are kept: no open licence, and none is inherited.
RESERVED = "reserved"
LIBRARY = {n: [t, *BODIES.get(n, [])] for n, t in TEMPLATES.items()} | {RESERVED: ["All rights reserved."]}
#: Parts of a directory's files in the join with its licence.
SALTS = 16
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = word_spans(raw, np.array([0, len(raw)], np.int64), WORD_BYTES)
    return word_hashes(raw, s, e)


class Templates:
    """Templates (several a licence, of different length) over one vocabulary."""

    def __init__(self, templates: dict):
        rows = sorted((n, t) for n, ts in templates.items() for t in ([ts] if isinstance(ts, str) else ts))
        self.names = [n for n, _ in rows]
        words = [_words(t) for _, t in rows]
        self.sizes = [len(w) for w in words]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.counts = np.zeros((len(self.vocabulary), len(self.names)))
        for j, w in enumerate(words):
            np.add.at(self.counts, (np.searchsorted(self.vocabulary, w), j), 1)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the vocabulary, or -1."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        ok = self.vocabulary[at] == h[maybe]
        out[maybe[ok]] = at[ok]
        return out


def _lines(buf: np.ndarray, offs: np.ndarray):
    """Words of a slice: hash, line of each, row of each line (lines without words are left out)."""
    s, e, row = word_spans(buf, offs, WORD_BYTES)
    ends = np.cumsum(buf == 10)
    raw = ends[s] + row if len(s) else np.zeros(0, np.int64)
    new = np.append(True, raw[1:] != raw[:-1])[:len(raw)]
    return word_hashes(buf, s, e), np.cumsum(new) - 1, row[new], s[new], e[np.append(new[1:], True)[:len(raw)]]


def line_counts(files: DataFrame, t: Templates) -> DataFrame:
    """(place, n): lines of all texts that hold each vocabulary word; place -1 counts all lines."""
    def run(batches):
        total, df = 0, np.zeros(len(t.vocabulary), np.int64)
        for b in slices(batches, "text"):
            h, line, row, _, _ = _lines(*utf8(b.column(0)))
            total += len(row)
            at = t.places(h)
            k = at >= 0
            df += np.bincount(np.unique(line[k] * len(df) + at[k]) % max(1, len(df)), minlength=len(df))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(df)), pa.int32()), pa.array(np.append(total, df), pa.int64())], ["place", "n"])

    return files.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))


def match_windows(at: np.ndarray, t: Templates, idf: np.ndarray, rare: float, only=None) -> list:
    """(template, cosine, first word, past) of the windows of one text that reach :data:`COSINE`: ``at`` is
    the place of each word in the vocabulary or -1; ``only`` names the templates to be compared."""
    own = np.append(idf, rare)[at]  # -1: the last
    square = np.concatenate([[0.0], np.cumsum(own ** 2)])
    found = []
    for j in range(len(t.names)) if only is None else only:
        n = min(t.sizes[j], len(at))
        if not n:
            continue
        weight = t.counts[:, j] * idf
        norm = math.sqrt((weight ** 2).sum())
        dot = np.concatenate([[0.0], np.cumsum(np.append(weight, 0.0)[at] * own)])
        dot = dot[n:] - dot[:-n]
        # Repeated words only lengthen the window's vector: this bounds the cosine from above.
        bound = dot / (norm * np.sqrt(square[n:] - square[:-n]))
        for i in np.flatnonzero(bound >= COSINE - 1e-9).tolist():
            place, tf = np.unique(at[i:i + n], return_counts=True)
            out = place < 0  # words outside the vocabulary: each occurrence counts as a word of its own
            size = math.sqrt(((tf[~out] * idf[place[~out]]) ** 2).sum() + tf[out].sum() * rare ** 2)
            cos = float((tf[~out] * idf[place[~out]] * weight[place[~out]]).sum() / (norm * size))
            if cos >= COSINE - 1e-12:
                found.append((j, cos, i, i + n))
    return found


def match_files(files: DataFrame, t: Templates, idf: np.ndarray, rare: float) -> DataFrame:
    """Per row of files (path, row, text): path, row, own, cosine, first, past (bytes of the best window), share."""
    weight = (t.counts * idf[:, None]) ** 2
    need = COSINE ** 2 * weight.sum(0) * (1 - 1e-9)  # squared weight of template words that a match must hold

    def run(batches):
        for b in slices(batches, "text", SLICE_BYTES):
            n = b.num_rows
            buf, offs = utf8(b.column(2))
            s, e, row = word_spans(buf, offs, WORD_BYTES)
            at = t.places(word_hashes(buf, s, e))
            begin = np.searchsorted(row, np.arange(n + 1))
            k = np.flatnonzero(at >= 0)
            pair = np.unique(row[k] * max(1, len(t.vocabulary)) + at[k])
            held = np.zeros((n, len(t.vocabulary)), bool)
            held[pair // max(1, len(t.vocabulary)), pair % max(1, len(t.vocabulary))] = True
            may = held @ weight >= need if len(t.names) else np.zeros((n, 0), bool)
            licence, cosine = [None] * n, [0.0] * n
            first, past, share = [None] * n, [None] * n, np.zeros(n)
            for r in np.flatnonzero(may.any(axis=1)).tolist():
                lo, hi = int(begin[r]), int(begin[r + 1])
                found = match_windows(at[lo:hi], t, idf, rare, np.flatnonzero(may[r]).tolist())
                if not found:
                    continue
                j, cos, i, stop = min(found, key=lambda x: (t.names[x[0]] == RESERVED, -round(x[1], 9), -t.sizes[x[0]], t.names[x[0]], x[2]))
                licence[r], cosine[r] = t.names[j], cos
                first[r], past[r] = int(s[lo + i] - offs[r]), int(e[lo + stop - 1] - offs[r])
                cover = np.zeros(hi - lo + 1, np.int64)
                for _, _, x, y in found:
                    cover[x] += 1
                    cover[y] -= 1
                share[r] = (np.cumsum(cover[:-1]) > 0).sum() / (hi - lo)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(licence, pa.string()), pa.array(cosine, pa.float64()),
                 pa.array(first, pa.int64()), pa.array(past, pa.int64()), pa.array(share)],
                ["path", "row", "own", "cosine", "first", "past", "share"])

    return files.select("path", "row", "text").mapInArrow(
        run, "path string, row long, own string, cosine double, first long, past long, share double")


def ancestors(path):
    """Directories above a path, nearest last: '' is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scan_licences(spark: SparkSession, files: DataFrame, templates: dict = LIBRARY) -> DataFrame:
    """Licences of files (path, row: any number that names the row, text): own, cosine, inherited, licence, source."""
    small_batches(spark)
    stage = Staging(spark, "licences")
    files = text_column(files.select("path", F.col("row").cast("long").alias("row"), "text"))
    t = Templates(templates)
    counts = {r["place"]: r["n"] for r in line_counts(files, t).collect()}  # as many rows as the vocabulary has words
    total = counts.get(-1, 0)
    idf = np.array([math.log((1 + total) / (1 + counts.get(i, 0))) + 1 for i in range(len(t.vocabulary))])
    found = stage.write(match_files(files, t, idf, math.log(1 + total) + 1), "found")

    name = F.element_at(F.split("path", "/"), -1)
    own = found.where(F.col("own").isNotNull() & F.col("path").isNotNull() & (name.rlike(FILE_NAMES) | (F.col("share") >= MAJORITY)))
    directories = own.select(F.element_at(ancestors(F.col("path")), -1).alias("dir"), "own", "cosine", "path").groupBy("dir").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "path", "own")).alias("best")).select(
        "dir", F.col("best.own").alias("dir_licence"), F.col("best.path").alias("dir_source"))
    # Only distinct directories climb, so a directory of a third of all files climbs once.
    asked = found.where(F.col("own").isNull() & F.col("path").isNotNull()).select(
        F.element_at(ancestors(F.col("path")), -1).alias("home")).distinct()
    climb = asked.select("home", F.posexplode(ancestors(F.concat("home", F.lit("/x")))).alias("depth", "dir"))
    climb = climb.where((F.col("depth") == 0) | (F.col("dir") != "")).join(directories, "dir").groupBy("home").agg(
        F.max(F.struct("depth", "dir_licence", "dir_source")).alias("near"))
    # Files with a licence of their own, or without a path, take no part in the join; the others meet
    # their directory's licence in one of SALTS parts.
    salted = climb.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("home", "h")
    asks = F.col("own").isNull() & F.col("path").isNotNull()
    homeless = found.where(~asks).withColumn("near", F.lit(None).cast(climb.schema["near"].dataType))
    home = F.element_at(ancestors(F.col("path")), -1)
    below = found.where(asks).withColumn("home", home).withColumn("s", F.pmod(F.xxhash64("path", "row"), F.lit(SALTS)).cast("int"))
    below = below.join(salted, (F.col("home") == F.col("h")) & (F.col("s") == F.col("salt")), "left").select(*homeless.columns)
    out = homeless.unionByName(below)
    return out.select(
        "path", "row", "own", "cosine", "first", "past", F.col("near.dir_licence").alias("inherited"),
        F.coalesce("own", "near.dir_licence").alias("licence"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("near.dir_source")).alias("source_path"))


def document_path():
    """A document as a file: its source is the repository, its id gives two levels of directories."""
    i = F.col("doc_id")
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("d"), F.floor(i / 4096)),
                       F.concat(F.lit("d"), F.floor(i / 128)), F.concat(i.cast("string"), F.lit(".txt")))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's own or inherited licence."""
    docs = read_table(spark, sf_dir, "documents")
    out = scan_licences(spark, docs.select(document_path().alias("path"), F.col("doc_id").alias("row"), "text"))
    return out.select(F.col("row").alias("doc_id"), "path", "own", F.round("cosine", 6).alias("cosine"), "inherited", "licence",
                      "source_path")
