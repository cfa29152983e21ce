"""License scans with DataFrame functions only: MinHash bands over text windows, then exact shingle containment.

A text is lower-cased and cut into words of letters and digits; its shingles
are hashes of five consecutive words.  Windows of ``WINDOW`` shingles, one at
every shingle and so overlapping, get one MinHash per band (the least shingle
hash after xor with the band's constant); templates are windowed alike.  A
window that lies inside a template agrees in every band.  A template of one
shingle meets two windows of two shingles; one of them agrees in a given band
with probability 2/3, so ``BANDS`` bands of one row miss it once in
3**BANDS cases (``miss_probability``).

Templates of at least ``LONG_WINDOW`` + ``STRIDE`` shingles (headers, full
texts) have windows of ``LONG_WINDOW`` shingles: one at every shingle of the
template, one every ``STRIDE`` shingles of a text.  Such a copy holds a whole
window of the text, and that agrees in every one of ``LONG_BANDS`` bands; a
changed word leaves a window three quarters of its shingles, so that it still
agrees in most bands.

Retrieved windows are then compared exactly (long ones with a stride more on
either side, so that the ends of a copy count): the template's shingles that
occur in them, as a share of the template's shingles, must reach
``min_containment``.  A match whose shingles, but for ``OWN`` of them, belong
to a fuller match of another license is that license's text (BSD-2-Clause in
BSD-3-Clause, a header of another version); with equally many shingles the
higher share counts.

Templates are a DataFrame (license, text).  Their index is broadcast, so
``MAX_INDEX`` bounds its rows; a larger table of templates is joined by
shuffle.  ``templates`` has the short notices of ``TEMPLATES``, the Creative
Commons notices and the first sentences of their legal codes in every version,
and the headers and full texts in ``license_texts``, without what is written
anew for each program (names, years, addresses).  A license that is not in it
is reported as one that it shares ``min_containment`` of the text with, if any.

Defined cases: null or empty texts and texts of fewer words than a shingle
match nothing; templates of fewer than five words are an error; repeated
rows of a document id are one document here.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
WINDOW = 2
BANDS = 12
LONG_WINDOW = 32
STRIDE = 16
LONG_BANDS = 6
OWN = 0.02  # share of a match's shingles that another license's match may lack
MAX_INDEX = 200_000  # broadcast bound, in rows of the band index
MAX_LISTED = 20_000  # band values that are also written into the scan's filter
TEXTS = Path(__file__).parent / "license_texts"  # LICENSE.KIND.txt

# The usual notices, as their licenses ask for them.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "EPL-1.0": ["made available under the terms of the Eclipse Public License v1.0", "made available under the terms of the Eclipse Public License, Version 1.0"],
    "EPL-2.0": ["made available under the terms of the Eclipse Public License 2.0", "made available under the terms of the Eclipse Public License v2.0", "made available under the terms of the Eclipse Public License v. 2.0"],
    "CC0-1.0": ["Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


CC_TYPES = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivs",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivs",
}
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def cc_notices() -> list[tuple[str, str]]:
    """(license, text): notices and the legal code's first sentence of every type and version."""
    rows = []
    for short, long in CC_TYPES.items():
        for version, area in CC_VERSIONS.items():
            name = long.replace("NoDerivs", "NoDerivatives") if version == "4.0" else long
            texts = [f"Licensed under CC {short} {version}."]
            for full in {f"{name} {version} {area}", f"{name} {version}"}:
                texts += [f"This work is licensed under a Creative Commons {full} License.", f"Licensed under the Creative Commons {full} License."]
            if version == "4.0":
                texts.append(f"You accept and agree to be bound by the terms and conditions of this Creative Commons {name} 4.0 International Public License")
            else:
                texts += [f"Creative Commons Legal Code {full} CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM" for full in {f"{name} {version}", f"{name} {version} {area}"}]
            rows += [(f"CC-{short}-{version}", t) for t in texts]
    return rows


def templates(spark: SparkSession) -> DataFrame:
    rows = [(name, text) for name, texts in TEMPLATES.items() for text in texts] + cc_notices()
    rows += [(f.name.rsplit(".", 2)[0], f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    return spark.createDataFrame(rows, "license string, text string")


def shingled(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys`` and ``_h``: hashes of the text's five-word shingles in order (empty below five words).

    Each step is a projection of its own: a lambda that indexes an array must
    find it as a column, or the array would be computed anew for each element.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = df.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))
    n = F.size("_w")
    at = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return hashed.select(*keys, F.transform(at, lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(SHINGLE)])).alias("_h"))


def _windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per window: the keys, its place, and its shingles ``h0`` to ``h{WINDOW-1}`` (null past the end)."""
    n = F.size("_h")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    structs = F.transform(at, lambda i: F.struct(i.alias("at"), *[F.get("_h", i + k).alias(f"h{k}") for k in range(WINDOW)]))
    return rows.select(*keys, F.inline(structs))


def _band_value(band: int) -> Column:
    constant = F.xxhash64(F.lit("band"), F.lit(band))
    return F.least(*[F.col(f"h{k}").bitwiseXOR(constant) for k in range(WINDOW)])


def _banded(windows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per window and band."""
    bands = F.array(*[F.struct(F.lit(b).alias("band"), _band_value(b).alias("value")) for b in range(BANDS)])
    return windows.select(*keys, *[f"h{k}" for k in range(WINDOW)], F.inline(bands))


def _long_windows(rows: DataFrame, keys: list[str], stride: int) -> DataFrame:
    """One row per long window and band: the keys, the place and the shingles of the window and a stride around it, its band and value."""
    last = F.size("_h") - LONG_WINDOW
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    first = lambda i: F.greatest(i - STRIDE, F.lit(0))
    structs = F.transform(at, lambda i: F.struct(first(i).alias("at"), F.slice("_h", first(i) + 1, LONG_WINDOW + 2 * STRIDE).alias("near"), F.slice("_h", i + 1, LONG_WINDOW).alias("_s")))
    windows = rows.select(*keys, F.inline(structs))
    least = lambda b: F.array_min(F.transform("_s", lambda h: h.bitwiseXOR(F.xxhash64(F.lit("long"), F.lit(b)))))
    return windows.select(*keys, "at", "near", F.posexplode(F.array(*[least(b) for b in range(LONG_BANDS)])).alias("band", "value"))


def _short_hits(shingles: DataFrame, known: DataFrame, parts: DataFrame) -> DataFrame:
    """``doc_id, template, license, n, shingle, at`` of the shingles of short templates in retrieved windows."""
    index = _banded(_windows(known, ["template"]), ["template"]).select("template", "band", "value").distinct()
    n_index = index.count()
    small = F.broadcast if n_index <= MAX_INDEX else lambda df: df
    windows = _windows(shingles, ["doc_id"])
    if n_index <= MAX_LISTED:  # the same test as the join, before the rows are multiplied by the bands
        values: dict[int, list[int]] = {b: [] for b in range(BANDS)}
        for r in index.select("band", "value").distinct().collect():
            values[r["band"]].append(r["value"])
        windows = windows.where(reduce(or_, (_band_value(b).isin(v) for b, v in values.items())))
    retrieved = _banded(windows, ["doc_id", "at"]).join(small(index), ["band", "value"])
    pairs = retrieved.select("doc_id", "template", "at", F.explode(F.array(*[f"h{k}" for k in range(WINDOW)])).alias("shingle"))
    return pairs.join(small(parts), ["template", "shingle"]).select("doc_id", "template", "license", "n", "shingle", "at")


def _long_hits(shingles: DataFrame, known: DataFrame, parts: DataFrame) -> DataFrame:
    """The same for long templates; ``at`` is the shingle's place."""
    index = _long_windows(known, ["template"], 1).select("template", "band", "value").distinct()
    small = F.broadcast if (known.agg(F.sum("n")).first()[0] or 0) <= MAX_INDEX else lambda df: df
    retrieved = _long_windows(shingles, ["doc_id"], STRIDE).join(small(index), ["band", "value"])
    pairs = retrieved.select("doc_id", "template", "at", F.posexplode("near").alias("step", "shingle"))
    return pairs.join(small(parts), ["template", "shingle"]).select("doc_id", "template", "license", "n", "shingle", (F.col("at") + F.col("step")).alias("at"))


def _is_part(a: Column, b: Column) -> Column:
    """Whether match ``a`` is text of the fuller match ``b``."""
    fuller = (b["hit"] > a["hit"]) | ((b["hit"] == a["hit"]) & (b["share"] > a["share"]))
    own = F.size(F.array_except(a["shingles"], b["shingles"]))
    return (a["license"] != b["license"]) & fuller & (own <= a["hit"] * OWN)


def find(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_containment: float = 0.75) -> DataFrame:
    """Matches: ``doc_id, license, containment, position`` (word where the first retrieved window, in long templates the first shingle, starts)."""
    rows = templates.select("license", "text", F.xxhash64("license", "text").alias("template"))
    known = shingled(rows, ["template", "license"], F.col("text")).withColumn("n", F.size(F.array_distinct("_h"))).dropDuplicates(["template"])
    if known.where("n = 0").limit(1).count():
        raise ValueError(f"a template has fewer than {SHINGLE} words")
    parts = known.select("template", "license", "n", F.explode(F.array_distinct("_h")).alias("shingle"))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shingles = shingled(texts, ["doc_id"], F.col("text"))
    long = F.size("_h") >= LONG_WINDOW + STRIDE
    hits = _short_hits(shingles, known.where(~long), parts)
    if known.where(long).limit(1).count():
        hits = hits.union(_long_hits(shingles, known.where(long), parts))
    exact = hits.groupBy("doc_id", "template", "license", "n", "shingle").agg(F.min("at").alias("at"))
    found = exact.groupBy("doc_id", "template", "license", "n").agg(F.count("*").alias("hit"), F.min("at").alias("at"), F.collect_list("shingle").alias("shingles"))  # at most the template's
    found = found.where(F.col("hit") >= F.col("n") * min_containment).withColumn("share", F.col("hit") / F.col("n"))
    matches = found.groupBy("doc_id").agg(F.collect_list(F.struct("license", "hit", "share", "at", "shingles")).alias("m"))  # at most one per template
    alone = F.filter("m", lambda a: ~F.exists("m", lambda b: _is_part(a, b)))
    kept = matches.select("doc_id", F.inline(F.transform(alone, lambda a: F.struct(a["license"].alias("license"), a["share"].alias("share"), a["at"].alias("at")))))
    return kept.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.min("at").alias("position"))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_containment: float = 0.75) -> DataFrame:
    """One row per document id: ``licenses`` (names, comma-joined), their number and the best containment."""
    matches = find(docs, templates, id_col, text_col, min_containment).groupBy("doc_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("licenses"),
        F.count("*").alias("n_licenses"),
        F.max("containment").alias("containment"),
        F.min("position").alias("first_position"),
    )
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    return ids.join(matches, ids["doc_id"].eqNullSafe(matches["doc_id"]), "left").select(
        ids["doc_id"],
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
        F.col("first_position").cast("long").alias("first_position"),
    )


def miss_probability(bands: int = BANDS) -> float:
    """Probability that neither window of a one-shingle template is retrieved."""
    return math.pow(1 / 3, bands)
