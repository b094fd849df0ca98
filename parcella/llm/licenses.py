"""Licence notices by a positional index of rare words, in SQL functions only.

Templates are short notices. Their mandatory key phrases are indexed by word,
with the position inside the template. The corpus tells how rare each of those words
is; of every template only the rarest are looked up in a text. Each hit votes for the
place where the template would have to begin; a place where the votes of the
rare words meet is verified word by word against the key phrases. Every
occurrence of all key phrases holds all its rare words, so none is missed.

All of it happens inside a row; only the document frequencies of the template
words (as many rows as the templates have words) are shuffled and collected.

Defined cases: a null or empty text has no words, no labels, null positions and
score 0. Overlapping places all count. Repeated rows are judged each by itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Label, notice and mandatory key phrases. Words are lower-case
#: runs of letters and digits. The first three are the base phrases.
BASE_TEMPLATES = [
    ("cc-by", "cc by", ["cc by"]),
    ("gpl", "general public license", ["general public license"]),
    ("reserved", "all rights reserved", ["all rights reserved"]),
]
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0 universal"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "without fee is hereby granted"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge", "copy of this software"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The Kelvin sign is the one other character whose lower case is ASCII; it is kept apart from k.
KELVIN, OTHER = "K", "ĸ"


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    base: bool
    words: list[str]
    keys: list[tuple[int, list[str]]]

    def key_words(self) -> list[tuple[str, int]]:
        return [(w, at + i) for at, words in self.keys for i, w in enumerate(words)]


def templates(base=BASE_TEMPLATES, more=TEMPLATES) -> list[Template]:
    found = []
    for label, text, phrases in [*base, *more]:
        words, keys = text.split(), []
        for phrase in phrases:
            key = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            keys.append((at, key))
        found.append(Template(len(found), label, len(found) < len(base), words, keys))
    return found


def text_words(text: str = "text"):
    """All words of a text; A-Z lowered, everything beyond ASCII a letter."""
    lowered = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(KELVIN), F.lit(OTHER)))
    return F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0))


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "array(" + ", ".join(map(_literal, value)) + ")"
    if isinstance(value, dict):
        return "map(" + ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in value.items()) + ")"
    if isinstance(value, tuple):
        return "struct(" + ", ".join(map(_literal, value)) + ")"
    return str(value)


def rarity(documents: DataFrame, words: list[str]) -> dict[str, float]:
    """Inverse document frequency of each given word over all documents."""
    own = F.array_distinct(F.filter(text_words(), lambda w: w.isin(words)))
    counts = documents.select(F.explode(own).alias("word")).groupBy("word").count()
    total = documents.count()
    frequency = {r["word"]: r["count"] for r in counts.collect()}  # one row per template word at most
    return {w: math.log((1 + total) / (1 + frequency.get(w, 0))) for w in words}


def find_licenses(documents: DataFrame, rare_words: int = 2, known: list[Template] | None = None) -> DataFrame:
    """Per row: the columns before ``text`` plus n_words and the verified places.

    ``places`` is an array of (template, label, base, start, coverage), where
    coverage is the share of the whole notice that stands there word by word.
    """
    known = known or templates()
    idf = rarity(documents, sorted({w for t in known for w, _ in t.key_words()}))
    postings: dict[str, list[tuple[int, int]]] = {}
    votes: list[int] = []
    for t in known:
        rare = sorted({w for w, _ in t.key_words()}, key=lambda w: (-idf[w], w))[:rare_words]
        # One place of each rare word votes; it stands there in every occurrence.
        first = {w: at for w, at in reversed(t.key_words())}
        for w in rare:
            postings.setdefault(w, []).append((t.number, first[w]))
        votes.append(len(rare))
    index = ", ".join(
        f"WHEN {_literal(w)} THEN array({', '.join(f'struct({n} AS t, h.p - {at} AS s)' for n, at in found)})"
        for w, found in postings.items()
    )
    index = index.replace(", WHEN", " WHEN")
    rare_list = ", ".join(map(_literal, postings))
    keys = _literal([[(at, words) for at, words in t.keys] for t in known])
    verified = f"""filter(agreed, c -> forall({keys}[c.t], k ->
        CASE WHEN c.s + k.col1 >= 0 THEN slice(words, c.s + k.col1 + 1, size(k.col2)) = k.col2 ELSE false END))"""
    whole, labels, base = (_literal(x) for x in ([t.words for t in known], [t.label for t in known], [t.base for t in known]))
    base = base.replace("True", "true").replace("False", "false")
    placed = f"""transform(found, c -> struct(c.t AS template, {labels}[c.t] AS label, {base}[c.t] AS base, c.s AS start,
        aggregate(transform({whole}[c.t], (w, j) -> CASE WHEN c.s + j >= 0 AND get(words, c.s + j) = w THEN 1 ELSE 0 END), 0, (a, x) -> a + x)
            / size({whole}[c.t]) AS coverage))"""
    kept = [c for c in documents.columns if c != "text"]
    return (
        documents.select(*kept, text_words().alias("words"))
        .select(*kept, "words", F.expr(f"filter(transform(words, (w, p) -> struct(w, p)), h -> h.w IN ({rare_list}))").alias("hits"))
        .select(*kept, "words", F.expr(f"array_sort(flatten(transform(hits, h -> CASE h.w {index} END)))").alias("votes"))
        .select(
            *kept,
            "words",
            # As many equal votes in a row as the template has rare words.
            F.expr(
                f"array_distinct(filter(votes, (c, i) -> get(votes, i + {_literal(votes)}[c.t] - 1) = c))"
            ).alias("agreed"),
        )
        .select(*kept, "words", F.expr(verified).alias("found"))
        .select(*kept, F.size("words").cast("long").alias("n_words"), F.expr(placed).alias("places"))
    )
