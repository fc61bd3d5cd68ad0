"""License scans: phrases, and short notices with a bounded number of edits.

A text is lower-cased (A-Z) and cut into words; phrases are found by the words' 64-bit hashes in numpy, and so are the
seeds of notices, which are confirmed on the words themselves. A notice may be found with up to ``k`` character errors. It is cut into
``2k + 1`` runs of words: one error touches at most two neighbouring words, so one run is left exact. Runs found
in a text are the seeds. Around a seed all but ``2k`` words of the notice must be there, for the same reason; then
the ``regex`` library looks for the notice with at most ``k`` errors and gives the errors and the span.

Defined results: a null text is empty: no words, no labels, score 0. Places that overlap all count in the
base search. Of overlapping notices of one label the one with fewest errors is reported, and none that lies inside a longer
notice of another label. Repeated rows give
repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuspipe.llm import grams
from corpuspipe.llm.common import LOWER, UPPER, keep_columns

# Fixed values of the contract: word characters after lower-casing, phrases and labels.
LETTERS = grams.alphabet(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Short notices as their licences word them, in words.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib"),
    ("use of this source code is governed by a bsd style license", "bsd"),
    ("redistributions of source code must retain the above copyright notice", "bsd"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("it under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("it under the terms of the gnu affero general public license", "agpl"),
    ("it under the terms of the gnu general public license as published by", "gpl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("subject to the terms and conditions of the common development and distribution license", "cddl"),
    ("distributed under the boost software license version 1 0", "bsl"),
    ("this font software is licensed under the sil open font license", "ofl"),
    ("licensed under the european union public licence", "eupl"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights", "cc0"),
    ("licensed under a creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial", "cc-by-nc"),
    ("you can redistribute it and or modify it under the same terms as perl itself", "artistic"),
    ("psf hereby grants licensee a nonexclusive royalty free world wide license", "psf"),
    ("permission to use copy modify and distribute this software and its documentation for any purpose without fee", "postgresql"),
)

FOLD = str.maketrans(UPPER, LOWER)

# One error for every so many characters of a notice.
CHARS_PER_ERROR = 16

SCHEMA = (
    "doc_id long, n_words long, base array<struct<label string, word long>>, "
    "notices array<struct<label string, notice int, errors int, first_word long, last_word long, start long, end long>>"
)


@dataclass(frozen=True)
class Notice:
    words: tuple[str, ...]
    label: str
    errors: int
    runs: tuple[tuple[int, int], ...]


def notice(text: str, label: str) -> Notice:
    """A notice with its number of errors and the runs (first word, words) of its pigeonhole split."""
    words = tuple(text.split())
    # Runs have two words or more, so that they are rare; a notice of five words has one single word.
    errors = min(len(text) // CHARS_PER_ERROR, max((len(words) // 2 - 1) // 2, int(len(words) >= 5)))
    cuts = np.ceil(np.linspace(0, len(words), 2 * errors + 2)).astype(int)
    return Notice(words, label, errors, tuple((int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:])))


def hash_of(*words: str) -> np.ndarray:
    return grams.words(pa.array([" ".join(words)]), LETTERS).hashes


class Scanner:
    """Seeds of all notices by their length, and the patterns that confirm them."""

    def __init__(self, notices):
        import regex

        self.notices = [notice(*each) for each in notices]
        self.seeds: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}
        by_length: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for number, each in enumerate(self.notices):
            for first, length in each.runs:
                value = int(grams.grams(hash_of(*each.words[first : first + length]), length)[0])
                by_length.setdefault(length, {}).setdefault(value, []).append((number, first))
        for length, seeds in by_length.items():
            order = sorted(seeds)
            self.seeds[length] = np.array(order, dtype=np.uint64), [seeds[value] for value in order]
        # One pattern for each number of errors: the first that matches tells the fewest.
        self.patterns = [
            [regex.compile(rf"\b(?:{regex.escape(' '.join(each.words))}){{e<={errors}}}\b") for errors in range(each.errors + 1)]
            for each in self.notices
        ]
        self.word_hashes = [np.unique(hash_of(*each.words)) for each in self.notices]
        self.phrases = [(hash_of(*phrase.split()), label) for phrase, label in PHRASES]

    def candidates(self, found: grams.Words) -> set[tuple[int, int, int]]:
        """(notice, text, word at which the notice would start) of every seed; the start may lie outside."""
        places = set()
        for length, (values, owners) in self.seeds.items():
            hashes = grams.grams(found.hashes, length)
            if not len(hashes):
                continue
            at = np.searchsorted(values, hashes)
            at[at == len(values)] = 0
            for word in np.flatnonzero((values[at] == hashes) & grams.gram_starts(found.bounds, length)):
                text = int(np.searchsorted(found.bounds, word, side="right")) - 1
                for number, first in owners[at[word]]:
                    places.add((number, text, int(word) - first))
        return places

    def base(self, found: grams.Words) -> list[tuple[int, str]]:
        """(word, label) of every place of a phrase."""
        places = []
        for wanted, label in self.phrases:
            n = len(wanted)
            if len(found.hashes) < n:
                continue
            same = grams.gram_starts(found.bounds, n)
            for j in range(n):
                same &= found.hashes[j : len(found.hashes) - n + 1 + j] == wanted[j]
            places += [(int(word), label) for word in np.flatnonzero(same)]
        return sorted(places)


def outermost(hits: list[dict]) -> list[dict]:
    """Hits in order of place, without those that lie inside a longer one: its notice says more."""
    kept, reach, widest = [], -1, None
    for hit in sorted(hits, key=lambda h: (h["first_word"], -h["last_word"], h["errors"], h["notice"])):
        span = hit["first_word"], hit["last_word"]
        if span[1] > reach or span == widest:
            kept.append(hit)
        if span[1] > reach:
            reach, widest = span[1], span
    return kept


def _scan(group: pa.RecordBatch, scanner: Scanner) -> pa.RecordBatch:
    found = grams.words(group.column(1), LETTERS, places=True)
    bounds, starts, ends = found.bounds, found.starts, found.ends
    base: list[list] = [[] for _ in range(group.num_rows)]
    notices: list[list] = [[] for _ in range(group.num_rows)]
    for word, label in scanner.base(found):
        text = int(np.searchsorted(bounds, word, side="right")) - 1
        base[text].append({"label": label, "word": word - int(bounds[text])})
    edges = grams.text_bytes(group.column(1))[1]
    best: dict[tuple[int, str], list] = {}
    for number, text, place in sorted(scanner.candidates(found)):
        each = scanner.notices[number]
        low = max(int(bounds[text]), place - each.errors - 1)
        high = min(int(bounds[text + 1]), place + len(each.words) + each.errors + 1)
        wanted = scanner.word_hashes[number]
        if np.isin(wanted, found.hashes[low:high]).sum() < len(wanted) - 2 * each.errors:
            continue
        shown = [found.data[starts[w] : ends[w]].tobytes().decode(errors="replace").translate(FOLD) for w in range(low, high)]
        around = " ".join(shown)
        match = next(filter(None, (pattern.search(around) for pattern in scanner.patterns[number])), None)
        if match is None:
            continue
        offsets = np.cumsum([0] + [len(word) + 1 for word in shown])
        first = low + int(np.searchsorted(offsets, match.start(), side="right")) - 1
        last = low + int(np.searchsorted(offsets, match.end() - 1, side="right")) - 1
        hit = {
            "label": each.label, "notice": number, "errors": sum(match.fuzzy_counts),
            "first_word": first - int(bounds[text]), "last_word": last - int(bounds[text]),
            "start": int(starts[first] - edges[text]), "end": int(ends[last] - edges[text]),
        }
        best.setdefault((text, each.label), []).append(hit)
    for (text, _), hits in best.items():
        # Words of the text that a better hit has: a hit asks for its own words only, however many hits there are.
        taken, used = [], bytearray(int(bounds[text + 1] - bounds[text]))
        for hit in sorted(hits, key=lambda h: (h["errors"], h["first_word"] - h["last_word"], h["first_word"], h["notice"])):
            first, after = hit["first_word"], hit["last_word"] + 1
            if used.find(1, first, after) < 0:
                used[first:after] = b"\x01" * (after - first)
                taken.append(hit)
        notices[text] += taken
    notices = [outermost(hits) for hits in notices]
    return pa.RecordBatch.from_arrays(
        [
            group.column(0),
            pa.array(found.counts.astype(np.int64)),
            pa.array(base, type=pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
            pa.array(notices, type=pa.list_(pa.struct([
                ("label", pa.string()), ("notice", pa.int32()), ("errors", pa.int32()), ("first_word", pa.int64()),
                ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
            ]))),
        ],
        names=["doc_id", "n_words", "base", "notices"],
    )


def scan_licenses(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """Of every row: ``doc_id``, ``n_words``, ``base`` (label and first word of each phrase) and ``notices``
    (label, notice, errors, words and byte span of each notice found)."""
    notices = tuple(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            for group in grams.groups(batch, 1):
                yield _scan(group, scanner)

    return keep_columns(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)

