"""Operator 2: license notices by conditional compression, confirmed by wording.

Sentences with a cue word begin candidate blocks. A block is compressed alone
and with each template as a raw dictionary; the templates that save most of its
size are ranked first. The winners are compared word by word with the block: the
one with the fewest differing words is the license, if these are few and none of
them is a word that tells licenses apart. Texts are not shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm.common import slices, table, texts

# Wordings of public license notices, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Templates that are compared word by word, and the share of a template's words that may differ.
WINNERS, DIFFERENT = 4, 0.25
_CUE = re.compile(r"licen[sc]|copyright|spdx|permission|redistribut|creative commons|public domain")
_BREAK = re.compile(r"\n+|(?<=[.!?])\s+")
_WORD = re.compile(r"\w+")


class Scanner:
    """Templates ready for compression and comparison."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.plain = zstandard.ZstdCompressor(level=3)
        self.templates = []
        words = [_WORD.findall(t.lower()) for _, t in templates]
        names = {w for name, _ in templates for w in _WORD.findall(name.lower())}
        for (name, text), said in zip(templates, words, strict=True):
            data = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, len(said), said, zstandard.ZstdCompressor(level=3, dict_data=data)))
        # words of the names and numbers tell licenses apart and must agree
        self.telling = names | {w for said in words for w in said if w.isdigit()} | {"lesser", "noncommercial", "sharealike"}

    def scan(self, text: str) -> Iterator[tuple[str, int, int, float, list[str]]]:
        """(license, start, end, share of the size saved, differing words) of the notices in a text, in order."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not _CUE.search(low):
            return
        cuts = [0, *(m.end() for m in _BREAK.finditer(low))]
        done = 0
        for cue in _CUE.finditer(low):
            first = bisect_right(cuts, cue.start()) - 1
            if cuts[first] < done:
                continue
            found = self.best(low, cuts, first)
            if found:
                name, end, saved, differences = found
                yield name, cuts[first], end, saved, differences
                done = end

    def best(self, low: str, cuts: list[int], first: int) -> tuple[str, int, float, list[str]] | None:
        ranked, blocks = [], {}
        for t, (_, size, _, compressor) in enumerate(self.templates):
            end = self._end(low, cuts, first, size, blocks)
            block, alone = blocks[end][0].encode(), blocks[end][2]
            ranked.append((1 - len(compressor.compress(block)) / alone, -t, end))
        ranked.sort(reverse=True)
        confirmed = []
        for saved, t, end in ranked[:WINNERS]:
            name, size, said, _ = self.templates[-t]
            words = blocks[end][1]
            changes = [c for c in SequenceMatcher(None, said, words, autojunk=False).get_opcodes() if c[0] != "equal"]
            gone = [w for _, a, b, _, _ in changes for w in said[a:b]]
            new = [w for _, _, _, a, b in changes for w in words[a:b]]
            if max(len(gone), len(new)) <= DIFFERENT * size and not self.telling & {*gone, *new}:
                confirmed.append((len(gone) + len(new), t, name, end, saved, [f"-{w}" for w in gone] + [f"+{w}" for w in new]))
        if not confirmed:
            return None
        _, _, name, end, saved, differences = min(confirmed, key=lambda c: (c[0], -c[1]))
        return name, end, saved, differences

    def _end(self, low: str, cuts: list[int], first: int, size: int, blocks: dict) -> int:
        """End of the sentences from ``first`` on that have about as many words as a template."""
        last, words = first, []
        while True:
            end = cuts[last + 1] if last + 1 < len(cuts) else len(low)
            words += _WORD.findall(low, cuts[last], end)
            last += 1
            if len(words) >= (1 - DIFFERENT) * size or last >= len(cuts):
                break
        end = cuts[first] + len(low[cuts[first] : end].rstrip())
        if end not in blocks:
            block = low[cuts[first] : end]
            blocks[end] = block, words, len(self.plain.compress(block.encode()))
        return end


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


SCHEMA = "doc_id long, license string, start long, end long, saved double, n_differences long, differences array<string>"


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Every confirmed license notice.

    One row per notice: doc_id, license, start and end (code points), saved
    (share of the block's compressed size that the template saves),
    n_differences and differences (words missing from the template's wording with -,
    added ones with +). Case and punctuation do not count. Null and empty texts have no notice; repeated rows are
    scanned alike; of equally close templates the first listed wins; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = scanner(templates)
        for part in slices(batches, "text"):
            rows = [(i, *found) for i, text in enumerate(part.column("text").to_pylist()) for found in mine.scan(text)]
            if rows:
                at, name, start, end, saved, differences = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(name, pa.string()), pa.array(start, pa.int64()),
                        pa.array(end, pa.int64()), pa.array(saved, pa.float64()),
                        pa.array([len(d) for d in differences], pa.int64()), pa.array(differences, pa.list_(pa.string())),
                    ],
                    names=["doc_id", "license", "start", "end", "saved", "n_differences", "differences"],
                )

    return texts(docs).mapInArrow(run, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
