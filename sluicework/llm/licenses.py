"""License scans: an exact set-similarity join of the word windows of a text with license templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import takewhile
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Key sentences of well-known licenses, and their texts or file headers, by label; "-long" and "-full" mark
#: further templates of a label.
TEMPLATES = {
    "agpl-3": "licensed under the gnu affero general public license version 3",
    "apache-2": "licensed under the apache license version 2 0",
    "apache-2-full": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"
    " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    " see the license for the specific language governing permissions and limitations under the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-2": "licensed under the gnu general public license version 2",
    "gpl-2-long": "this work is licensed under the gnu general public license version 2",
    "gpl-3": "licensed under the gnu general public license version 3",
    "gpl-3-long": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-full": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    " the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "lgpl-2-1": "licensed under the gnu lesser general public license version 2 1",
    "lgpl-3": "licensed under the gnu lesser general public license version 3",
    "mit": "released under the mit license",
    "mit-long": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-full": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "proprietary": "proprietary and confidential unauthorized copying of this file via any medium is strictly prohibited",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
_BSD_CLAUSES = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = " this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
TEMPLATES |= {"bsd-2-full": _BSD_CLAUSES + _BSD_END, "bsd-3-full": _BSD_CLAUSES + _BSD_NAMES + _BSD_END}
#: The file header of the GNU licenses, which differ in a name and a version.
_GNU = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu {name}general public license as published by the free software foundation either version {version} of the license or at your option any later version"
    " this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name}general public license for more details"
)
_GNU_NAMES = {"agpl-3": ("affero ", "3"), "gpl-2": ("", "2"), "gpl-3": ("", "3"), "lgpl-2-1": ("lesser ", "2 1"), "lgpl-3": ("lesser ", "3")}
TEMPLATES |= {f"{k}-full": _GNU.format(name=name, version=version) for k, (name, version) in _GNU_NAMES.items()}
#: What Creative Commons licenses add to attribution, in short and in full.
_CC = {"": "", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike", "nc nd": "noncommercial noderivatives", "nc sa": "noncommercial sharealike"}


def _cc_label(short: str) -> str:
    return "-".join(["cc", "by", *short.split()])


TEMPLATES |= {_cc_label(k): " ".join(["licensed under cc by", *k.split(), "4 0"]) for k in _CC}
TEMPLATES |= {f"{_cc_label(k)}-long": " ".join(["licensed under a creative commons attribution", *full.split(), "4 0 international license"]) for k, full in _CC.items()}


def label_of(name: str) -> str:
    return name.removesuffix("-long").removesuffix("-full")


class Telling(NamedTuple):
    """What tells a template from its neighbours: ``must`` be in the passage; words within two of a ``rival``, or of a rival pair
    of consecutive words, don't belong to it, nor does it reach over a ``divider``."""

    must: frozenset[str] = frozenset()
    rivals: frozenset[str] = frozenset()
    dividers: frozenset[str] = frozenset()
    pairs: frozenset[tuple[str, str]] = frozenset()


def _telling() -> dict[str, Telling]:
    found = {"bsd-2-full": Telling(rivals=frozenset({"neither", "endorse"})), "bsd-3-full": Telling(frozenset({"neither", "endorse", "promote"}))}
    found |= {k: Telling(frozenset(w.split())) for k, w in {"apache-2": "apache 2", "apache-2-full": "apache 2", "mpl-2": "mozilla 2", "mit": "mit"}.items()}
    names, versions = {"affero", "lesser", "library"}, {"1", "2", "3"}
    for label, (name, version) in _GNU_NAMES.items():
        own, number = set(name.split()), set(version.split())
        for k in TEMPLATES:
            if label_of(k) == label:
                found[k] = Telling(frozenset({"gnu"} | own | number), frozenset(names - own), frozenset(versions - number), frozenset({("gnu", "general")} if own else ()))
    short, full = {"nc", "nd", "sa"}, {"noncommercial", "noderivatives", "sharealike"}
    for k, words in _CC.items():
        found[_cc_label(k)] = Telling(frozenset(k.split()), frozenset(short - set(k.split())))
        found[f"{_cc_label(k)}-long"] = Telling(frozenset({"creative", "commons", "attribution", *words.split()}), frozenset(full - set(words.split())))
    return found


#: A template of fewer distinct tokens must be held with all of them: one word less may be the name of the license.
SHORT = 10
TELLING = _telling()
#: Words on either side of a rival that no passage takes.
BESIDE = 2


def tokens_needed(n: int, threshold: float) -> int:
    """How many of a template's ``n`` distinct tokens a block must hold."""
    return n if n < SHORT else ceil(threshold * n - 1e-9)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str) -> list[str]:
    """Words of letters and digits, after A-Z are lower-cased; other non-ASCII characters belong to words."""
    return WORD.findall(text.translate(UPPER_TO_LOWER) if not text.isascii() else text.lower())


class TemplateIndex:
    """Prefix index of the templates under one global order of their tokens, rarest first.

    A block contains a template to the share ``threshold`` if it holds ceil(threshold * n) of its n distinct tokens; all of
    them if they are fewer than ``SHORT``. Two sets with that overlap share one of the template's first n - overlap + 1 tokens
    in the global order, so only these are indexed (prefix filter). A text with fewer distinct tokens of the template than
    the overlap can't qualify (length filter). Around prefix tokens, places bound the overlap of every window: unless so many
    tokens of the template stand within one window's length, none is walked (positional filter). Beside the share, a passage must
    hold the words that tell the template from its neighbours, and none of theirs (``Telling``).
    """

    def __init__(self, templates: Mapping[str, str], counts: Mapping[str, int], threshold: float, telling: Mapping[str, Telling] = TELLING) -> None:
        self.telling = {label: telling.get(label, Telling()) for label in templates}
        self.prefix: dict[str, list[tuple[str, int]]] = {}
        self.tokens: dict[str, frozenset[str]] = {}
        self.need: dict[str, int] = {}
        self.span: dict[str, int] = {}
        for label, text in templates.items():
            words = words_of(text)
            ordered = sorted(set(words), key=lambda t: (counts.get(t, 0), t))
            self.tokens[label] = frozenset(ordered)
            self.span[label] = ceil(len(words) / threshold - 1e-9)
            self.need[label] = need = tokens_needed(len(ordered), threshold)
            for at, token in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefix.setdefault(token, []).append((label, at))
        self.keys = frozenset(self.prefix)

    def matches(self, block: set[str]) -> list[tuple[str, float, bool]]:
        """Label and containment of every template that the block holds to the threshold; true for the best of them: the
        most contained, then the largest."""
        found = list(self._contained(block))
        best = max((c, n) for _, c, n in found) if found else None
        return [(label, c, (c, n) == best) for label, c, n in found]

    def _contained(self, block: set[str]) -> Iterator[tuple[str, float, int]]:
        tried: set[str] = set()
        for token in sorted(self.keys & block):
            for label, _ in self.prefix[token]:
                size, need = len(self.tokens[label]), self.need[label]
                if label in tried or len(block) < need:
                    continue
                must, rivals, dividers, _ = self.telling[label]
                if not must <= block or block & rivals or block & dividers:
                    tried.add(label)
                    continue
                if (overlap := len(self.tokens[label] & block)) >= need:
                    yield label, overlap / size, size
                tried.add(label)

    def passages(self, words: list[str]) -> list[tuple[int, int, str, float, bool]]:
        """Start, length, label and containment of every passage that holds a template to the threshold within a window of
        its length over the threshold, wherever lines end; true for those with no better passage (more contained, then of a
        larger template) on half of the shorter one's words.

        The passages of a template don't overlap: of those that do, the one that holds most of it goes first, then the
        shortest, then the first; what is left of the text before and behind it is searched as well.
        """
        distinct = set(words)
        labels = {label for token in self.keys & distinct for label, _ in self.prefix[token]}
        labels = {x for x in labels if len(self.tokens[x] & distinct) >= self.need[x] and self.telling[x].must <= distinct}
        if not labels:
            return []
        near: dict[str, list[tuple[int, int]]] = {x: [] for x in labels}
        for i, word in enumerate(words):
            for label, _ in self.prefix.get(word, ()):
                if label in labels:
                    spans, a, b = near[label], max(0, i - self.span[label] + 1), min(len(words), i + self.span[label])
                    if spans and a <= spans[-1][1]:
                        a = spans.pop()[0]
                    spans.append((a, b))
        found = []
        for label in sorted(labels):
            tokens = self.tokens[label]
            for a, b in self._stretches(label, words, near[label]):
                places = [i for i in range(a, b) if words[i] in tokens]
                if not any(z - y < self.span[label] for y, z in zip(places, places[self.need[label] - 1 :])):
                    continue
                found += [(at, n, label, c, len(tokens)) for at, n, c in self._windows(label, words, places)]
        found.sort()
        longest = max((n for _, n, *_ in found), default=0)
        out = []
        for k, (at, n, label, c, size) in enumerate(found):
            rivals = (x for side in (range(k - 1, -1, -1), range(k + 1, len(found))) for x in takewhile(lambda x: abs(x[0] - at) < longest, (found[j] for j in side)))
            beaten = any((x[3], x[4]) > (c, size) and 2 * (min(at + n, x[0] + x[1]) - max(at, x[0])) >= min(n, x[1]) for x in rivals)
            out.append((at, n, label, c, not beaten))
        return out

    def _stretches(self, label: str, words: list[str], spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """The spans without what rivals and dividers take from a template."""
        _, rivals, dividers, pairs = self.telling[label]
        for a, b in spans:
            at = a
            for i in range(max(0, a - BESIDE - 1), min(len(words), b + BESIDE)) if rivals or dividers else ():
                pair = bool(pairs) and tuple(words[i : i + 2]) in pairs
                reach = BESIDE if pair or words[i] in rivals else 0 if words[i] in dividers else -1
                if reach < 0:
                    continue
                if i - reach > at:
                    yield at, min(b, i - reach)
                at = max(at, i + pair + reach + 1)
            if at < b:
                yield at, b

    def _windows(self, label: str, words: list[str], places: list[int]) -> Iterator[tuple[int, int, float]]:
        """Passages of one template among the given places of its tokens, in one walk: a passage stands once no better one
        can overlap it. Better ones replace it a bounded number of times, so only a bounded stretch is walked again."""
        size, need, span, must = len(self.tokens[label]), self.need[label], self.span[label], self.telling[label].must
        start = 0
        while start < len(places):
            best = first = None
            held: Counter[str] = Counter()
            lo = start
            for k in range(start, len(places)):
                held[words[places[k]]] += 1
                while places[lo] <= places[k] - span or held[words[places[lo]]] > 1:
                    held[words[places[lo]]] -= 1
                    if not held[words[places[lo]]]:
                        del held[words[places[lo]]]
                    lo += 1
                if best and lo > best[3]:
                    break
                if len(held) >= need and (best is None or (len(held), places[lo] - places[k]) > best[:2]) and all(w in held for w in must):
                    best = (len(held), places[lo] - places[k], lo, k)
                    first = lo if first is None else first
            if best is None:
                return
            n, _, lo, k = best
            yield places[lo], places[k] - places[lo] + 1, n / size
            if first < lo:
                yield from self._windows(label, words, places[first:lo])
            start = k + 1


def token_frequencies(docs: DataFrame, text_col: str, templates: Mapping[str, str]) -> dict[str, int]:
    """In how many texts of the corpus each template token stands; one number per template token reaches the driver."""
    wanted = frozenset(t for x in templates.values() for t in words_of(x))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(wanted.intersection(words_of(text or "")))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    rows = docs.select(text_col).mapInArrow(count, "token string, n long").groupBy("token").agg({"n": "sum"}).collect()
    return {r["token"]: r["sum(n)"] for r in rows}


def phrase_places(words: list[str], phrases: Mapping[str, str]) -> list[tuple[int, int, str]]:
    """Start, length and label of every place where a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        wanted = phrase.split()
        at = -1
        while True:
            try:
                at = words.index(wanted[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(wanted)] == wanted:
                found.append((at, len(wanted), label))
    return sorted(found)


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = 0.8,
) -> DataFrame:
    """Licenses of every whole text: places of the base phrases, and blocks (passages) that contain a template.

    Columns: the id, n_words, places (array of start, length, label: the base phrases, words from 0), blocks (array of start,
    length, label, containment, best: every passage that holds at least ``threshold`` of a template's tokens within a window
    of the template's words over ``threshold``, whatever the line ends; best marks those that no better one overlaps).
    Several templates may stand for one label (``label_of``). Null or empty text: no word, no place, no block. Repeated rows each give a row;
    only the id and the text are read. An empty table gives an empty table. Two narrow passes (the first counts template
    tokens, which orders them globally) and no shuffle of texts; the templates are a fixed list, so every task holds it.
    """
    index = TemplateIndex(templates, token_frequencies(docs, text_col, templates), threshold)
    starts = tuple(p.split()[0] for p in phrases)
    kind = docs.schema[id_col].dataType.simpleString()
    places_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("label", pa.string())]))
    blocks_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("label", pa.string()), ("containment", pa.float64()), ("best", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places, blocks = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text or "")
                sizes.append(len(words))
                blocks.append([{"start": a, "length": n, "label": label_of(x), "containment": c, "best": b} for a, n, x, c, b in index.passages(words)])
                held = set(words).intersection(starts) if words else ()
                places.append([{"start": a, "length": n, "label": x} for a, n, x in phrase_places(words, phrases)] if held else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, places_type), pa.array(blocks, blocks_type)], names=[id_col, "n_words", "places", "blocks"]
            )

    return docs.select(id_col, text_col).mapInArrow(
        scan,
        f"`{id_col}` {kind}, n_words long, places array<struct<start: long, length: long, label: string>>, blocks array<struct<start: long, length: long, label: string, containment: double, best: boolean>>",
    )
