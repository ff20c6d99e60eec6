"""License scans: an exact set-similarity join of text blocks against license templates.

Tokens carry one global order, by their frequency over the whole corpus (rarest first, then by spelling). A template
T is contained in a block B when |T and B| >= need = ceil(threshold * |T|). The join keeps an inverted index of each
template's prefix: its |T| - need + k rarest tokens, k = min(2, need); a block with fewer than k of them cannot
qualify (prefix filter). A block with fewer than need distinct tokens is skipped (length filter). The positions of the
shared prefix tokens bound the overlap: those found, plus the template's tokens behind the last of them (positional
filter). What is left is verified on the sets.

Templates of any length: they are joined by classes of length. The class of up to r words (r = 32, 64, 128, ...) has
blocks of 2 r words that reach r - 1 words into the next one, so each run of up to r words, and so each whole template,
lies in one block of its class, at whatever word it starts; a place is counted in the block in which it starts.

Defined results: a template without words is an error; null or empty texts have no words, no labels and score 0; repeated rows repeat; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import lean, sliced

#: Phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Whole templates, sentences and texts; a block that contains THRESHOLD of a template's distinct words gets its label.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-text"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-text"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
        "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without "
        "warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit-full",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in "
        "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied "
        "warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event "
        "shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages", "bsd-full",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of "
        "the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the "
        "license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license", "apache-notice",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be "
        "useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public "
        "license for more details", "gpl-notice",
    ),
]
THRESHOLD = 0.8
#: Words of the shortest class of templates. Bytes of a table of templates at most, as all tasks get it.
SHORT, MOST_BYTES = 32, 64 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Template:
    words: list[bytes]
    label: str
    threshold: float
    phrase: bool

    def __post_init__(self) -> None:
        if not self.words:
            raise ValueError("a template has one word at least")
        self.tokens = frozenset(self.words)
        self.need = max(1, math.ceil(self.threshold * len(self.tokens) - 1e-9))


def default_templates() -> list[Template]:
    return [Template(p.encode().split(), label, 1.0, True) for p, label in PHRASES] + [Template(t.encode().split(), label, THRESHOLD, False) for t, label in TEMPLATES]


def templates_of(table: DataFrame) -> list[Template]:
    """Templates of a table: text, label, and threshold (null: THRESHOLD). All tasks get them, so their size is checked."""
    rows = table.select(table["text"].cast("string").alias("text"), table["label"].cast("string").alias("label"), table["threshold"].cast("double").alias("threshold")).where("text is not null and label is not null")
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("label"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the templates have {size} bytes, more than {MOST_BYTES}")
    return [Template(words_of(r["text"]), r["label"], THRESHOLD if r["threshold"] is None else r["threshold"], False) for r in rows.collect()]


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def token_frequencies(docs: DataFrame, text_col: str, tokens: frozenset[bytes]) -> dict[bytes, int]:
    """Occurrences over all rows of the templates' tokens; the result is bounded by the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(tokens, 0)
        for whole in batches:
            for batch in sliced(whole, "text"):
                for text in batch.column("text").to_pylist():
                    for w in filter(total.__contains__, words_of(text)):
                        total[w] += 1
        yield pa.RecordBatch.from_pydict({"token": [t.decode() for t in total], "n": pa.array(list(total.values()), pa.int64())})

    rows = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(lean(run), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"].encode(): r["n"] for r in rows}


class Matcher:
    """The template side of the join for one class of lengths: prefixes under the global order, and the probes."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int], reach: int) -> None:
        self.templates, self.reach = templates, reach
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for i, t in enumerate(templates):
            ordered = sorted(t.tokens, key=lambda w: (frequency.get(w, 0), w))
            for position, token in enumerate(ordered[: len(ordered) - t.need + min(2, t.need)]):
                self.index.setdefault(token, []).append((i, position))
        self.probe = frozenset(self.index)

    def contained(self, block: frozenset[bytes]) -> Iterator[tuple[int, int]]:
        """(template, overlap) of all templates that meet their threshold in this block."""
        hits: dict[int, list[int]] = {}
        for token in self.probe & block:
            for i, position in self.index[token]:
                hits.setdefault(i, []).append(position)
        for i, positions in sorted(hits.items()):
            t = self.templates[i]
            if len(positions) < min(2, t.need) or len(block) < t.need or len(positions) + len(t.tokens) - max(positions) - 1 < t.need:
                continue
            overlap = len(t.tokens & block)
            if overlap >= t.need:
                yield i, overlap

    def scan(self, words: list[bytes], found: Found) -> None:
        """Adds what the blocks of one text contain."""
        if self.probe.isdisjoint(words):
            return
        block = 2 * self.reach
        for start in range(0, len(words), block):
            part = words[start : start + block + self.reach - 1]
            if self.probe.isdisjoint(part):
                continue
            for i, overlap in self.contained(frozenset(part)):
                t = self.templates[i]
                if not t.phrase:
                    found.labels.add(t.label)
                    found.score = max(found.score, overlap / len(t.tokens))
                    continue
                n, at = len(t.words), -1
                while True:  # the exact check: the phrase's words, consecutively
                    try:
                        at = part.index(t.words[0], at + 1, block)
                    except ValueError:
                        break
                    if part[at : at + n] == t.words:
                        found.place(start + at, t.label)


@dataclass
class Found:
    """What the templates of all classes give for one text."""

    places: int = 0
    first: int | None = None
    last: int | None = None
    base: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    score: float = 0.0

    def place(self, at: int, label: str) -> None:
        self.places += 1
        self.first = at if self.first is None else min(self.first, at)
        self.last = at if self.last is None else max(self.last, at)
        self.base.add(label)
        self.score = 1.0


def matchers(templates: list[Template], frequency: dict[bytes, int]) -> list[Matcher]:
    """One for each class of lengths; a class has templates of up to `reach` words."""
    classes: dict[int, list[Template]] = {}
    for t in templates:
        classes.setdefault(max(SHORT, 1 << (len(t.words) - 1).bit_length()), []).append(t)
    return [Matcher(own, frequency, reach) for reach, own in sorted(classes.items())]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | DataFrame | None = None) -> DataFrame:
    """One row for each of docs. templates: a list, or a table as templates_of() takes it, which then stands beside the
    phrases; default_templates() where none are given."""
    if isinstance(templates, DataFrame):
        templates = [t for t in default_templates() if t.phrase] + templates_of(templates)
    templates = templates or default_templates()
    found_by = matchers(templates, token_frequencies(docs, text_col, frozenset().union(*(t.tokens for t in templates))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                out = []
                for text in batch.column("text").to_pylist():
                    words = words_of(text)
                    found = Found()
                    for m in found_by:
                        m.scan(words, found)
                    out.append((len(words), found.places, found.first, found.last, ",".join(sorted(found.base)), ",".join(sorted(found.base | found.labels)), found.score))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)
