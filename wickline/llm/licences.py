"""Licence scans: TF-IDF cosine of lines, word windows and whole texts to templates, then
inheritance along paths."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline.llm import licence_texts
from wickline.llm.scratch import written

# Notices by which licences are named in headers.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
WORD = r"[a-z]+|[0-9]+"
# Left out of windows and their templates.
STOP = ("a", "an", "and", "any", "as", "be", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with")
NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
THRESHOLD = 0.8


def weights(templates: dict[str, str]) -> tuple[dict[str, float], float, dict[str, dict[str, float]]]:
    """Inverse document frequencies over the templates, that of a word in none, and the
    unit vectors of the templates."""
    words = {name: Counter(re.findall(WORD, text.lower())) for name, text in templates.items()}
    held = Counter(w for c in words.values() for w in c)
    idf = {w: math.log((1 + len(words)) / (1 + n)) + 1 for w, n in held.items()}
    unseen = math.log(1 + len(words)) + 1
    vectors = {}
    for name, c in words.items():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        vectors[name] = {w: n * idf[w] / norm for w, n in c.items()}
    return idf, unseen, vectors


def telling_words(idf: dict[str, float], vectors: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Words of which a line must have one to reach the threshold: the others, the most
    common of the templates, make up less of every template than that."""
    left = dict.fromkeys(vectors, 0.0)
    common = set()
    for w in sorted(idf, key=lambda w: (idf[w], w)):
        more = {name: left[name] + v.get(w, 0.0) ** 2 for name, v in vectors.items()}
        if max(more.values()) >= threshold**2 - 1e-9:
            break
        left = more
        common.add(w)
    return sorted(set(idf) - common)


def _may_reach(words: Column, idf: dict[str, float], threshold: float) -> Column:
    """False where a cosine can't reach the threshold. Words that no template has weigh
    most, and only lengthen the vector: of its squared length they may hold a share of
    1 - threshold^2. ``u`` different ones hold at least ``u`` times the highest weight
    squared, ``c`` words of the templates at most ``c^2`` times that."""
    known = F.array(*[F.lit(w) for w in sorted(idf)])
    u = F.size(F.array_except(words, known))
    c = F.size(F.filter(words, lambda w: w.isin(*sorted(idf))))
    share = (threshold - 1e-6) ** 2
    return c * c * (1 - share) >= u * share


def licence_lines(df: DataFrame, key: str, text_col: str, templates: dict[str, str], threshold: float) -> DataFrame:
    """(key, line, words, licence, cosine) of the lines that reach ``threshold`` to a
    template: its best one, the first by name among equals. Lines without a telling word
    can't and are left out before their words are looked at."""
    spark = df.sparkSession
    idf, unseen, vectors = weights(templates)
    pattern = r"(?i)(?<![a-z0-9])(" + "|".join(telling_words(idf, vectors, threshold)) + r")(?![a-z0-9])"
    lines = df.select(key, F.posexplode(F.split(F.col(f"`{text_col}`"), "\n", -1)).alias("line", "said")).filter(F.col("said").rlike(pattern))
    words = F.regexp_extract_all(F.lower("said"), F.lit(f"({WORD})"), F.lit(1))
    lines = lines.select(key, "line", words.alias("words")).filter(_may_reach(F.col("words"), idf, threshold))
    lines = lines.dropDuplicates([key, "line"])  # of repeated rows
    said = lines.select(key, "line", F.explode("words").alias("word"))
    counted = said.groupBy(key, "line", "word").agg(F.count("*").alias("n"))
    # The templates' words: a table of fixed size, so its broadcast is bounded.
    rows = ", ".join(f"('{w}', {x!r}D)" for w, x in sorted(idf.items()))
    known = spark.sql(f"SELECT * FROM VALUES {rows} AS t(known, idf)")
    entries = ", ".join(f"('{w}', '{name}', {x!r}D)" for name, v in sorted(vectors.items()) for w, x in sorted(v.items()))
    parts = spark.sql(f"SELECT * FROM VALUES {entries} AS t(part, licence, weight)")
    weighed = counted.join(F.broadcast(known), F.col("word") == F.col("known"), "left").withColumn(
        "value", F.col("n") * F.coalesce("idf", F.lit(unseen))
    )
    norms = weighed.groupBy(key, "line").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.sum("n").alias("words"))
    dots = weighed.join(F.broadcast(parts), F.col("word") == F.col("part")).groupBy(key, "line", "licence").agg(
        F.sum(F.col("value") * F.col("weight")).alias("dot")
    )
    close = dots.join(norms, [key, "line"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= threshold)
    best = F.min(F.struct((-F.col("cosine")).alias("less"), "licence", "words")).alias("best")
    return close.groupBy(key, "line").agg(best).select(key, "line", "best.words", "best.licence", (-F.col("best.less")).alias("cosine"))


@dataclass(frozen=True)
class Template:
    """``least``: distinct words of the template that a text at the limit has at least;
    ``heaviest``: the fewest words of which it has one. ``tier`` 0 are headers and texts, 1 names and notices, 2 a mere reservation of rights."""

    licence: str
    tier: int
    whole: bool
    limit: float
    order: tuple[str, ...]
    vector: dict[str, float]
    least: int
    heaviest: tuple[str, ...]


def tier_of(licence: str, long: bool) -> int:
    return 0 if long else 2 if licence == "Proprietary" else 1


def window_templates(threshold: float) -> tuple[dict[str, float], float, list[Template]]:
    """The inverse document frequencies of the texts of ``licence_texts``, and these as
    templates. Names have no words to spare: their limit is 1."""
    texts = {}
    for kind, found in (("name", licence_texts.NAMES), ("header", licence_texts.HEADERS), ("full", licence_texts.FULL)):
        texts |= {f"{name}|{kind}|{k}": t for name, given in found.items() for k, t in enumerate(given)}
    orders = {key: [w for w in re.findall(WORD, text.lower()) if w not in STOP] for key, text in texts.items()}
    idf, unseen, vectors = weights({key: " ".join(order) for key, order in orders.items()})
    out = []
    for key, order in orders.items():
        licence, kind, _ = key.split("|")
        limit = 1 - 1e-6 if kind == "name" else threshold
        squares = sorted((x * x for x in vectors[key].values()), reverse=True)
        held, least = 0.0, 0
        while held < limit**2 - 1e-9 and least < len(squares):
            held, least = held + squares[least], least + 1
        rest, heaviest = 1.0, []
        for w, x in sorted(vectors[key].items(), key=lambda item: (-item[1], item[0])):
            if rest < limit**2 - 1e-9:
                break
            heaviest.append(w)
            rest -= x * x
        named = (licence, tier_of(licence, kind != "name"), kind == "full")
        out.append(Template(*named, limit, tuple(order), vectors[key], least, tuple(heaviest)))
    return idf, unseen, out


def _values(df: DataFrame, rows: list[str], names: str) -> DataFrame:
    """A table of fixed size: its broadcast is bounded."""
    return F.broadcast(df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})"))


def licence_windows(df: DataFrame, key: str, text_col: str, threshold: float) -> DataFrame:
    """(key, tier, licence, cosine) of the windows that reach the limit of their template.

    A window has as many consecutive words as its template, ``STOP`` left out, across
    lines, and two neighbours of the template at their place; where several follow each
    other, the first two set it. Full texts are compared with whole texts. What lacks
    the ``heaviest`` or ``least`` of the template's words can't reach the limit and is
    left out before its words are counted.
    """
    idf, unseen, templates = window_templates(threshold)
    words = F.regexp_extract_all(F.lower(F.col(f"`{text_col}`")), F.lit(f"({WORD})"), F.lit(1))
    texts = df.select(key, F.filter(words, lambda w: ~w.isin(*STOP)).alias("said"))
    places, whole, entries = [], [], []
    for number, t in enumerate(templates):
        held = "array(" + ", ".join(f"'{w}'" for w in sorted(t.vector)) + ")"
        if t.whole:
            heavy = "array(" + ", ".join(f"'{w}'" for w in t.heaviest) + ")"
            whole.append(f"named_struct('template', {number}, 'least', {t.least}, 'held', {held}, 'heaviest', {heavy})")
        else:
            before = ("", *t.order)
            pairs = zip(before, t.order, t.order[1:])
            places += [f"('{a} {b}', '{was}', {number}, {at}, {len(t.order)}, {t.least}, {held})" for at, (was, a, b) in enumerate(pairs)]
        entries += [f"({number}, '{w}', {x!r}D)" for w, x in sorted(t.vector.items())]
    placed = _values(df, places, "seed, was, template, at, length, least, held")
    start, end = F.greatest(F.col("pos") - F.col("at"), F.lit(0)), F.least(F.col("pos") - F.col("at") + F.col("length"), F.size("said"))
    neighbours = F.zip_with(F.slice("said", F.lit(1), F.size("said") - 1), F.slice("said", F.lit(2), F.size("said") - 1), lambda a, b: F.concat_ws(" ", a, b))
    known = sorted({f"{a} {b}" for t in templates if not t.whole for a, b in zip(t.order, t.order[1:])})
    seeds = F.filter(
        F.transform(neighbours, lambda pair, i: F.struct(i.alias("pos"), pair.alias("pair"))), lambda s: s["pair"].isin(*known)
    )  # before they become rows: hardly any pair of a text is one of a template
    near = (
        texts.filter(F.size("said") > 1)
        .select(key, "said", F.inline(seeds))
        .join(placed, F.col("pair") == F.col("seed"))
        .filter((F.col("pos") == 0) | (F.get("said", F.col("pos") - 1) != F.col("was")))
        .select(key, "template", "least", "held", start.alias("start"), F.slice("said", start + 1, end - start).alias("said"))
    )
    heaviest = sorted({w for t in templates if t.whole for w in t.heaviest})
    long = texts.filter(F.size("said") >= min(t.least for t in templates if t.whole)).filter(F.arrays_overlap("said", F.array(*map(F.lit, heaviest))))
    fulls = long.select(key, "said", F.inline(F.expr(f"array({', '.join(whole)})"))).filter(F.size("said") >= F.col("least"))
    fulls = fulls.filter(F.arrays_overlap("said", "heaviest"))
    near = near.unionByName(fulls.select(key, "template", "least", "held", F.lit(0).alias("start"), "said"))
    near = near.filter(F.size(F.array_intersect("said", "held")) >= F.col("least")).select(key, "template", "start", "said")
    counted = (
        near.dropDuplicates([key, "template", "start"])
        .select(key, "template", "start", F.explode("said").alias("word"))
        .groupBy(key, "template", "start", "word")
        .agg(F.count("*").alias("n"))
    )
    known = _values(df, [f"('{w}', {x!r}D)" for w, x in sorted(idf.items())], "word, idf")
    parts = _values(df, entries, "template, word, weight")
    value = F.col("n") * F.coalesce("idf", F.lit(unseen))
    cosine = F.round(F.sum(value * F.coalesce("weight", F.lit(0.0))) / F.sqrt(F.sum(value * value)), 9)
    scored = counted.join(known, "word", "left").join(parts, ["template", "word"], "left").groupBy(key, "template", "start").agg(cosine.alias("cosine"))
    named = _values(df, [f"({i}, {t.tier}, '{t.licence}', {t.limit!r}D)" for i, t in enumerate(templates)], "template, tier, licence, limit")
    return scored.join(named, "template").filter("cosine >= limit").select(key, "tier", "licence", "cosine")


def scan_licences(
    df: DataFrame,
    path_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row of ``df``: id, ``own_licence`` and its ``cosine``, ``licence`` and
    ``inherited_from``.

    A row's own licence is that of its best header or text (``licence_windows``), without
    one that of its best line or name, and "All rights reserved" counts only where nothing
    else does; the first by name among equals. A licence file is one by its name
    (``NAME``); the most frequent licence of a directory's licence files, the first by
    name among equals, is the directory's. A row without a licence inherits from its nearest ancestor directory that
    has one, by an equi-join of its ancestors with the directories. Null and empty texts
    and null paths have no licence of their own; a null path inherits nothing. Repeated
    rows are scanned each. An empty table gives an empty result. SQL functions only.
    """
    rows = df.select(
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{path_col}`"), F.col(f"`{text_col}`")).alias("row_key"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{path_col}`").alias("path"),
        F.col(f"`{text_col}`").alias("text"),
    )
    once = rows.select("row_key", "text").filter("text IS NOT NULL")
    lines = licence_lines(once, "row_key", "text", templates, threshold).withColumn("tier", F.when(F.col("licence") == "Proprietary", 2).otherwise(1))
    said = F.struct("tier", (-F.col("cosine")).alias("less"), "licence")
    found = lines.select("row_key", "tier", "licence", "cosine").unionByName(licence_windows(once, "row_key", "text", threshold))
    own = written(found.groupBy("row_key").agg(F.min(said).alias("said")), "own")  # three readers below
    parts = F.split("path", "/")
    marked = rows.select("row_key", "id", "path").join(own, "row_key", "left").select(
        "id",
        parts.alias("parts"),
        F.col("said.licence").alias("own_licence"),
        (-F.col("said.less")).alias("cosine"),
        F.element_at(parts, -1).rlike(NAME).alias("is_file"),
    )
    folder = F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), "/")
    votes = marked.filter("is_file AND own_licence IS NOT NULL AND parts IS NOT NULL").groupBy(folder.alias("folder"), "own_licence").count()
    order = Window.partitionBy("folder").orderBy(F.desc("count"), "own_licence")
    folders = votes.withColumn("at", F.row_number().over(order)).filter("at = 1").select("folder", F.col("own_licence").alias("of_folder"))
    bare = marked.filter("own_licence IS NULL").withColumn("place", F.monotonically_increasing_id())
    depths = F.sequence(F.lit(0), F.greatest(F.size("parts") - 1, F.lit(0)))
    above = F.when(F.col("parts").isNotNull(), F.transform(depths, lambda k: F.array_join(F.slice("parts", 1, k), "/"))).otherwise(F.array())
    found = bare.select("id", "cosine", F.explode_outer(above).alias("up"), F.struct("id", "parts").alias("row")).join(
        folders, F.col("up") == F.col("folder"), "left"
    )
    nearest = F.max(F.when(F.col("folder").isNotNull(), F.struct(F.length("up").alias("depth"), "folder", "of_folder"))).alias("near")
    copies = bare.groupBy(F.struct("id", "parts").alias("row")).agg(F.count("*").alias("copies"))
    inherited = found.distinct().groupBy("row").agg(nearest).join(copies, "row")
    given = inherited.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select(
        F.col("row.id").alias("id"),
        F.lit(None).cast("string").alias("own_licence"),
        F.lit(None).cast("double").alias("cosine"),
        F.col("near.of_folder").alias("licence"),
        F.col("near.folder").alias("inherited_from"),
    )
    kept = marked.filter("own_licence IS NOT NULL").select(
        "id", "own_licence", "cosine", F.col("own_licence").alias("licence"), F.lit(None).cast("string").alias("inherited_from")
    )
    return kept.unionByName(given).withColumnRenamed("id", id_col)
