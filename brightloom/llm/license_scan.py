"""License scan: units of text against license templates by the Dice coefficient of their word bigrams.

DataFrame functions alone, row by row and without a shuffle. A unit is a line, a whole text of several lines, or a
window of consecutive words anywhere in the text, whatever its lines. For a coefficient of t a unit of n bigrams can
only reach a template of m if t / (2 - t) * m <= n <= (2 - t) / t * m; other templates are not compared. A window that
begins or ends outside the template gets no worse without that end, so windows run from one bigram of the template to
another; they are only tried in texts that hold t / (2 - t) * m bigrams of it. From a bigram of the template a window can
only end at one of the next (2 - t) / t * m, so the search is linear in the text, whatever it repeats.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import named, read_table
from brightloom.llm.decontaminate import normalised_words

THRESHOLD = 0.8
#: Windows that are joined at a time; it bounds what a step copies.
BLOCK = 256
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "eupl-1.2": "Licensed under the EUPL, Version 1.2 or later.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_bigrams(text: str) -> list[str]:
    found = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])})


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bigrams(text: Column) -> Column:
    return _let(
        normalised_words(text),
        lambda w: F.when(F.size(w) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))).otherwise(
            F.array().cast("array<string>")
        ),
    )


def _best(grams: Column, templates: Mapping[str, list[str]], threshold: float) -> Column:
    """struct(dice, license) of the template that comes nearest, at or over the threshold; null if none does."""
    n, found = F.size(grams), []
    for name, of in templates.items():
        m = len(of)
        fits = n.between(threshold / (2 - threshold) * m, (2 - threshold) / threshold * m)
        dice = F.size(F.array_intersect(grams, F.array(*map(F.lit, of)))) * F.lit(2.0) / (n + m)
        found.append(F.when(fits, F.struct(dice.alias("dice"), F.lit(name).alias("license"))))
    over = F.filter(F.array_compact(F.array(*found)), lambda x: x["dice"] >= threshold)
    # the greatest coefficient; of equals, the first name
    return F.aggregate(over, F.lit(None).cast("struct<dice:double,license:string>"), lambda a, x: F.when(a.isNull() | (x["dice"] > a["dice"]), x).otherwise(a))


_WINDOW = "array<struct<at:int,license:string,dice:double,stop:int,line:int,last:int>>"


def _windows(text: Column, shared: Column, templates: Mapping[str, list[str]], threshold: float) -> Column:
    """_WINDOW: of windows that overlap and fit a template the nearest, in order; at and stop are their outer words.

    shared: the bigrams of text that any template has.
    """
    nothing = F.array().cast(_WINDOW)

    def of_template(grams: Column, name: str, of: list[str]) -> Column:
        m = len(of)
        low, high = math.ceil(threshold / (2 - threshold) * m - 1e-9), math.floor((2 - threshold) / threshold * m + 1e-9)
        own = F.array(*map(F.lit, of))

        def nearest(seeds: Column, s: Column, i: Column) -> Column:
            def rate(e: Column) -> Column:
                unit = F.transform(F.slice(grams, s["at"] + 1, e["at"] - s["at"] + 1), lambda b: b["g"])
                dice = F.size(F.array_intersect(unit, own)) * F.lit(2.0) / (F.size(F.array_distinct(unit)) + m)
                return F.struct(dice.alias("dice"), (-e["at"]).alias("at"), e["last"].alias("last"))

            # low bigrams of the template at least, and high of any kind at most
            near = F.filter(F.slice(seeds, i + low, F.lit(high - low + 1)), lambda e: (e["at"] - s["at"] + 1).between(low, high))
            best = F.array_max(F.transform(near, rate))
            return F.struct(s["at"].alias("at"), F.lit(name).alias("license"), best["dice"].alias("dice"), (1 - best["at"]).alias("stop"), s["line"].alias("line"), best["last"].alias("last"))

        found = _let(F.filter(grams, lambda b: b["g"].isin(of)), lambda seeds: F.transform(seeds, lambda s, i: nearest(seeds, s, i)))
        able = F.size(F.array_intersect(shared, own)) >= low
        return F.when(able, F.filter(found, lambda x: x["dice"] >= threshold).cast(_WINDOW)).otherwise(nothing)

    def join(kept: Column, x: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        return (
            F.when((F.size(kept) == 0) | (x["at"] > last["stop"]), F.concat(kept, F.array(x)))
            .when(x["dice"] > last["dice"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x)))
            .otherwise(kept)
        )

    def joined(all_fits: Column) -> Column:
        """Fits by blocks: only the last kept window of a block meets the next, so that no step copies all that is kept."""

        def block(acc: Column, at: Column) -> Column:
            start = F.slice(acc["open"], F.greatest(F.size(acc["open"]), F.lit(1)), F.lit(1))
            done = F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0)))
            fits = F.slice(all_fits, at * BLOCK + 1, F.lit(BLOCK))
            return F.struct(F.concat(acc["out"], done).alias("out"), F.aggregate(fits, start, join).alias("open"))

        empty = F.struct(nothing.alias("out"), nothing.alias("open"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(all_fits) / BLOCK).cast("int")), empty, block, lambda acc: F.concat(acc["out"], acc["open"]))

    words = F.flatten(F.transform(F.split(text, "\n"), lambda x, i: F.transform(normalised_words(x), lambda w: F.struct(w.alias("w"), i.alias("line")))))
    words = F.filter(words, lambda x: x["w"] != "")
    bigram = lambda w, i: F.struct(F.concat_ws(" ", F.get(w, i)["w"], F.get(w, i + 1)["w"]).alias("g"), i.alias("at"), F.get(w, i)["line"].alias("line"), F.get(w, i + 1)["line"].alias("last"))
    grams = _let(words, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: bigram(w, i)))
    fits = _let(grams, lambda g: F.array_sort(F.flatten(F.array(*[of_template(g, name, of) for name, of in templates.items()]))))
    lows = [F.size(F.array_intersect(shared, F.array(*map(F.lit, of)))) >= threshold / (2 - threshold) * len(of) - 1e-9 for of in templates.values()]
    some = F.exists(F.array(*lows), lambda x: x)
    return F.when(some, _let(fits, joined)).otherwise(nothing)


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(id, line, license, dice): one row for every unit of docs that a template fits; line is -1 for a whole text, and
    that of its first word for a window. Of windows that overlap the nearest counts, and none that touches a line which
    is reported itself, or lies in a text that is.

    Words are runs of letters, marks and digits in lower case; bigrams count once. Of several templates the nearest is
    named, of equals the first by name. Null and empty texts and units of one word have no bigram and match nothing.
    Null ids are kept; rows that repeat are each reported; texts are read whole, whatever their length, by one task each;
    other columns are not read. No templates (or only templates of one word) and empty tables give no rows.
    """
    grams = {name: template_bigrams(templates[name]) for name in sorted(templates)}
    grams = {name: of for name, of in grams.items() if of}
    text = F.col("text")
    lines = F.split(text, "\n")
    several = text.contains("\n")
    if not grams:
        return docs.select(named(id_col).alias("id"), F.lit(0).alias("line"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).where("false")
    every = F.array(*map(F.lit, sorted({g for of in grams.values() for g in of})))
    whole = _let(_bigrams(text), lambda g: F.struct(F.when(several, _best(g, grams, threshold)).alias("best"), F.array_intersect(every, g).alias("shared")))
    lined = F.transform(lines, lambda x: _let(_bigrams(x), lambda g: _best(g, grams, threshold)))
    found = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).select("id", "text", whole.alias("whole"))
    found = found.select("id", F.col("whole.best").alias("best"), lined.alias("lined"), _windows(text, F.col("whole.shared"), grams, threshold).alias("windows"))
    unit = lambda line, best: F.struct(line.cast("int").alias("line"), best.alias("best"))
    units = F.concat(F.transform("lined", lambda b, i: unit(i, b)), F.array(unit(F.lit(-1), F.col("best"))))
    touched = lambda x: F.exists(F.slice("lined", x["line"] + 1, x["last"] - x["line"] + 1), lambda b: b.isNotNull())
    free = F.filter("windows", lambda x: F.col("best").isNull() & ~touched(x))
    more = F.transform(free, lambda x: unit(x["line"], F.struct(x["dice"].alias("dice"), x["license"].alias("license"))))
    # explode_outer: for explode, Spark would infer a filter on the array and compute it twice
    found = found.select("id", F.explode_outer(F.concat(F.filter(units, lambda u: u["best"].isNotNull()), more)).alias("u")).where("u IS NOT NULL")
    return found.select("id", "u.line", "u.best.license", "u.best.dice")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _oracle() -> str:
    rows = ", ".join(f"('{name}', '{g}')" for name, text in TEMPLATES.items() for g in template_bigrams(text))
    words = r"string_split(trim(regexp_replace(lower(unit), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ')"
    low, high = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    return f"""
WITH t(license, g) AS (VALUES {rows}), m AS (SELECT license, count(*) AS m FROM t GROUP BY 1),
lined AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, p - 1 AS line, lines[p] AS unit FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p FROM lined)
  UNION ALL SELECT doc_id, -1, text FROM lined WHERE len(lines) > 1),
grams AS (
  SELECT DISTINCT doc_id, line, w[p] || ' ' || w[p + 1] AS g
  FROM (SELECT doc_id, line, w, unnest(range(1, len(w))) AS p FROM (SELECT doc_id, line, {words} AS w FROM units))),
n AS (SELECT doc_id, line, count(*) AS n FROM grams GROUP BY ALL),
dice AS (
  SELECT doc_id, line, license, count(*) * 2.0::DOUBLE / (any_value(n) + any_value(m)) AS dice
  FROM grams JOIN t USING (g) JOIN n USING (doc_id, line) JOIN m USING (license)
  WHERE n BETWEEN {low!r} * m AND {high!r} * m GROUP BY ALL)
SELECT doc_id, line::INT AS line, license, dice FROM dice WHERE dice >= {THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) = 1"""


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES = {"op9_license_scan": _oracle()}
