"""Licence texts and notices in documents, by the Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Standard wording of licence notices and of short licences.
TEMPLATES = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details."
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
PERCENT = 80
BREAK = "[^A-Za-z0-9]+"
PARAGRAPH_WORDS = 15  # a shorter paragraph of a licence says too little to stand for it


def standard_texts() -> dict[str, str]:
    """The whole licence texts and headers in `licences`, and the paragraphs of headers and short texts.

    A paragraph that several licences share does not tell them apart and is left
    out, so what is met inside a longer document names its licence.
    """
    texts = {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
    paragraphs = {n: [" ".join(p.split()) for p in re.split(r"\n[ \t\r]*\n", t)] for n, t in texts.items() if not n.endswith(" text")}
    held = Counter(p for own in paragraphs.values() for p in set(own))
    for name, own in paragraphs.items():
        for k, p in enumerate(own, 1):
            if len(own) > 1 and held[p] == 1 and len(p.split()) >= PARAGRAPH_WORDS:
                texts[f"{name} part {k}"] = p
    return texts


TEMPLATES |= standard_texts()


def bigrams(text: str) -> list[str]:
    """Distinct bigrams of a text's lower-cased runs of letters and digits, in order of appearance."""
    words = [w for w in re.split(BREAK, text) if w]
    return list(dict.fromkeys(f"{a} {b}".lower() for a, b in zip(words, words[1:])))


def fits(a, b: int, percent: int):
    """Sets of these sizes can reach the coefficient: twice the smaller size is the most that they share."""
    return 200 * F.least(a, F.lit(b)) >= percent * (a + b)


def scan(
    docs: DataFrame, text_col: str, templates: dict[str, str] | None = None, percent: int = PERCENT, prefix: str = "lic_"
) -> DataFrame:
    """Add `<prefix>name` and `<prefix>dice`: the template most like a part of the text, if one reaches `percent`.

    Parts are the whole text, its paragraphs (between blank lines) and its lines.
    A part with fewer words than any template allows is left out before bigrams
    are made, and a template meets only parts whose number of distinct bigrams
    its size allows. All of it is one projection of column functions: nothing is
    shuffled, and no row is made for a part.

    Of equal coefficients the first name counts. Without a part that reaches the
    coefficient, with null or empty text, or without templates the name is null
    and the coefficient 0. All columns and rows stay.
    """
    texts = TEMPLATES if templates is None else templates
    made = {name: bigrams(text) for name, text in sorted(texts.items())}
    made = {name: own for name, own in made.items() if own}
    if not made:
        return docs.withColumns({f"{prefix}name": F.lit(None).cast("string"), f"{prefix}dice": F.lit(0.0)})
    least_words = min(-(-len(own) * percent // (200 - percent)) for own in made.values()) + 1
    whole = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.array_distinct(F.concat(F.array(whole), F.split(whole, "\n"), F.split(whole, r"\n[ \t\r]*\n")))

    def words(part: Column) -> Column:
        return F.filter(F.split(F.lower(part), BREAK), lambda w: w != "")

    def grams(own: Column) -> Column:
        n = F.size(own) - 1
        return F.array_distinct(F.zip_with(F.slice(own, 1, n), F.slice(own, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))

    # lower() of a character outside ASCII may give ASCII letters; such characters are breaks, so they go first
    ascii_only = F.transform(parts, lambda p: F.regexp_replace(p, r"[^\x00-\x7F]", " "))
    worded = F.filter(F.transform(ascii_only, words), lambda own: F.size(own) >= least_words)
    listed = F.transform(worded, grams)

    def scores(own: Column) -> Column:
        size = F.size(own)
        cells = []
        for rank, (_, template) in enumerate(made.items()):
            common = F.size(F.array_intersect(own, F.split(F.lit("\n".join(template)), "\n")))
            dice = F.when(fits(size, len(template), percent), 2.0 * common / (size + len(template))).otherwise(0.0)
            cells.append(F.struct(dice.alias("dice"), F.lit(-rank).alias("rank")))
        return F.array_max(F.array(*cells))

    best = F.array_max(F.transform(F.col(f"{prefix}grams"), scores))
    found = docs.withColumn(f"{prefix}grams", listed).withColumn(f"{prefix}best", best)
    reached = F.coalesce(F.col(f"{prefix}best.dice"), F.lit(0.0)) * 100 >= percent
    name = F.element_at(F.array(*map(F.lit, made)), 1 - F.col(f"{prefix}best.rank"))
    return found.withColumns(
        {
            f"{prefix}name": F.when(reached, name),
            f"{prefix}dice": F.when(reached, F.col(f"{prefix}best.dice")).otherwise(0.0),
        }
    ).drop(f"{prefix}grams", f"{prefix}best")


def check_sql(documents: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The same for DuckDB, with the standard templates: (id, name, dice)."""
    quoted = ", ".join(f"""('{name}', '{text.replace("'", "''")}')""" for name, text in sorted(TEMPLATES.items()))

    def words(text: str) -> str:
        return f"list_filter(string_split_regex(lower(regexp_replace({text}, '[^\\x00-\\x7F]', ' ', 'g')), '{BREAK}'), lambda w: w <> '')"

    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
        WITH template AS (
            SELECT name, {pairs} AS b FROM (SELECT name, {words("body")} AS w FROM (VALUES {quoted}) AS t(name, body))
        ), doc AS (
            SELECT row_number() OVER () AS row, {id_col} AS id, coalesce({text_col}, '') AS body FROM {documents}
        ), part AS (
            SELECT row, unnest(list_distinct(list_concat(
                [body], string_split(body, chr(10)), string_split_regex(body, '\\n[ \\t\\r]*\\n')))) AS body
            FROM doc
        ), grams AS (
            SELECT row, {pairs} AS a FROM (SELECT row, {words("body")} AS w FROM part)
        ), scored AS (
            SELECT row, name, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
            FROM grams JOIN template ON 200 * least(len(a), len(b)) >= {PERCENT} * (len(a) + len(b))
        ), best AS (
            SELECT row, name, dice, row_number() OVER (PARTITION BY row ORDER BY dice DESC, name) AS place
            FROM scored WHERE dice * 100 >= {PERCENT}
        )
        SELECT id AS {id_col}, name AS license, coalesce(dice, 0.0) AS dice
        FROM doc LEFT JOIN best ON doc.row = best.row AND place = 1"""
