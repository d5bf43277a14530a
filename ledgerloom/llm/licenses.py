"""License scan: Dice coefficient over word bigrams against template texts.

Templates are notices and full license texts. Text and templates are normalised to words; a
document's candidate regions are all windows of words, wherever its lines end. Size bounds prune candidates: with ``d`` the least coefficient, a template of
``m`` bigrams can only match a region of between ``m * d / (2 - d)`` and ``m * (2 - d) / d``
bigrams, which must share at least the former; texts without the template's anchor words
cannot.
"""

from __future__ import annotations

import json
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Least Dice coefficient.
DICE = 0.9
#: In templates of at most so many bigrams a version is one word among few: their numbers must be in the region.
NOTICE = 40

# Short forms of public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MIT-short": "Released under the MIT License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    "GPL-short": "Licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
    # Windows find these behind "This work is" too; with those words, other versions would be within the bound.
    "GPL-2.0-short": "Licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-short": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-short": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-short": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-short": "Licensed under the Mozilla Public License, version 2.0.",
    "MIT-licensed": "Licensed under the MIT License.",
    "BSD-released": "Released under the BSD License.",
    "BSD-short": "Licensed under the BSD License.",
    "CC0-1.0-short": "Licensed under CC0 1.0.",
}
for _kind, _long in {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}.items():
    TEMPLATES[f"CC-{_kind}-4.0-short"] = f"Licensed under CC {_kind} 4.0."
    TEMPLATES[f"CC-{_kind}-4.0"] = f"This work is licensed under a Creative Commons {_long} 4.0 International License."
# Whole license texts.
TEMPLATES |= json.loads(pkgutil.get_data(__package__, "license_texts.json"))
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_COPYRIGHT = re.compile(r"^\s*(?:copyright\b|\(c\)|©).*$", re.IGNORECASE | re.MULTILINE)


def normalise(text: str) -> list[str]:
    """Lower-case words without punctuation, version numbers kept whole, copyright lines dropped."""
    return _WORD.findall(_COPYRIGHT.sub("\n", text).lower())


def bigrams(words: list[str]) -> Counter:
    """Word bigrams with multiplicity; a single word is one bigram with a blank."""
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter((w, "") for w in words)


def dice(a: Counter, b: Counter) -> float:
    both = a.total() + b.total()
    return 2 * (a & b).total() / both if both else 0.0


def anchors(grams: Counter, least: float = DICE) -> set[str]:
    """Words of which any matching region has one: too few bigrams are left without them."""
    needed = grams.total() * least / (2 - least)
    chosen: set[str] = set()
    often = Counter()
    for gram, n in grams.items():
        for w in set(gram) - {""}:
            often[w] += n
    # Frequent words first, as few then cover a long text; short ones are common in any text.
    for word in sorted(often, key=lambda w: (len(w) < 7, -(often[w] // 3), -len(w), w)):
        if sum(n for g, n in grams.items() if not chosen.intersection(g)) < needed:
            break
        chosen.add(word)
    return chosen


@lru_cache(8)
def _prepared(templates: tuple[tuple[str, str], ...], least: float):
    out = []
    for name, text in templates:
        grams = bigrams(normalise(text))
        if grams:
            m = grams.total()
            numbers = {g: k for k, g in enumerate(grams)}
            out.append((name, numbers, np.array(list(grams.values())), m * least / (2 - least) - 1e-9, m * (2 - least) / least + 1e-9, anchors(grams, least)))
    return out


def _words(text: str, copyright_lines: bool) -> tuple[list[str], list[int]]:
    """The words and the line that each is on, with or without those of copyright lines."""
    words, at = [], []
    for k, line in enumerate(text.split("\n")):
        found = _WORD.findall(line.lower()) if copyright_lines else normalise(line)
        words += found
        at += [k] * len(found)
    return words, at


def _window(words: list[str], numbers: dict, counts: np.ndarray, low: float, high: float, least: float) -> tuple[int, int, float] | None:
    """First word, last word and coefficient of the best window; of equal ones the earliest, then shortest.

    The window of a notice without the notice's version is not of its license.

    A bigram counts in a window from ``i`` unless its ``counts``-th occurrence before it is in
    the window too. The best window starts with a bigram of the template, and no window of
    up to ``high`` bigrams reaches the bound that has fewer than ``low`` of them.
    """
    single = next((g[0] for g in numbers if not g[1]), None)
    if single is not None:
        return (words.index(single), words.index(single), 1.0) if single in words else None
    kinds = np.fromiter((numbers.get(g, -1) for g in zip(words, words[1:])), np.int64, max(0, len(words) - 1))
    useful = np.flatnonzero(kinds >= 0)
    if len(useful) < low:
        return None
    before = np.full(len(kinds), len(kinds))
    places: dict[int, list[int]] = {}
    for p in useful.tolist():
        seen = places.setdefault(kinds[p], [])
        n = int(counts[kinds[p]])
        before[p] = seen[-n] if len(seen) >= n else -1
        seen.append(p)
    m, size = int(counts.sum()), int(high)
    versions = {w for g in numbers for w in g if w[0].isdigit()} if m <= NOTICE else set()
    versions = [np.array([k for k, w in enumerate(words) if w == v] + [len(words) + size]) for v in versions]
    upper = np.searchsorted(useful, useful + size) - np.arange(len(useful))
    best = None
    for i, most in zip(useful.tolist(), np.minimum(upper, m).tolist()):
        if most < low or best is not None and 2 * most / (most + m) <= best[2]:
            continue
        both = np.cumsum(before[i : i + size] < i)
        sizes = np.arange(1, len(both) + 1)
        reach = max((v[np.searchsorted(v, i)] - i for v in versions), default=0)
        d = np.where(sizes >= max(low, reach), 2 * both / (sizes + m), 0.0)
        k = int(d.argmax())
        if d[k] >= least and (best is None or d[k] > best[2]):
            best = (i, i + k + 1, float(d[k]))
    return best


def find(text: str, templates: tuple[tuple[str, str], ...], least: float = DICE) -> list[tuple[str, int, int, float]]:
    """(template, first line, end line, coefficient) of the best region of each template.

    Regions are windows of words; of equal coefficients the earliest, then shortest
    counts. Copyright lines are left out of the text, and then, as one may hold a whole
    license, left in; the better result counts. With overlap o and sizes a and b,
    2 o >= least (a + b) and o <= a, b bound the size of a region from both sides.
    """
    low_text = text.lower()
    candidates = [t for t in _prepared(templates, least) if len(text) >= t[3] and any(w in low_text for w in t[5])]
    if not candidates:
        return []
    ways = [_words(text, False)]
    if _COPYRIGHT.search(text):
        ways.append(_words(text, True))
    found = []
    for name, numbers, counts, low, high, _ in candidates:
        best = None
        for words, at in ways:
            window = _window(words, numbers, counts, low, high, least)
            if window and (best is None or window[2] > best[3]):
                best = (name, at[window[0]], at[window[1]] + 1, window[2])
        if best:
            found.append(best)
    return sorted(found, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``found``, an array of (template, first_line, end_line, dice).

    Null and empty texts match nothing; repeated rows give repeated results; templates without
    words are left out; only the two named columns are read.
    """
    chosen = tuple(sorted((TEMPLATES if templates is None else templates).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("template", pa.string()), ("first_line", pa.int32()), ("end_line", pa.int32()), ("dice", pa.float64())]))
        for batch in batches:
            found = [
                [{"template": n, "first_line": a, "end_line": b, "dice": round(d, 6)} for n, a, b, d in find(t or "", chosen, least)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[id_col, "found"])

    named = docs.selectExpr(f"cast(`{id_col}` as long) as `{id_col}`", f"cast(`{text_col}` as string) as `{text_col}`")
    return map_arrow(named, run, f"{id_col} long, found array<struct<template:string,first_line:int,end_line:int,dice:double>>")


def op6(docs: DataFrame) -> DataFrame:
    """Per document: how many templates match, their names by place, and the best coefficient."""
    return scan(docs).select(
        "doc_id",
        F.size("found").cast("long").alias("n_licenses"),
        F.array_join(F.transform("found", lambda x: x["template"]), ",").alias("licenses"),
        F.array_max(F.transform("found", lambda x: x["dice"])).alias("best_dice"),
    )
