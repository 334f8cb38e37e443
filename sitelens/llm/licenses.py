"""License scans with a positional index of rare licence words.

Licence notices are templates with postings word -> (template, position). Document frequencies of the templates' words
come from the whole corpus. In each file all rare licence words are looked up; postings whose relative
positions agree make a candidate, whose mandatory key phrases are then verified in place, and which is scored by the
IDF-weighted share of its words that stand where they should.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE, annotate

#: Fixed values of the base scan: phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: A word in more than this share of the files is no rare word, unless it is among its template's two rarest.
COMMON = 0.1
#: Words a template may be shifted by insertions, least score.
SLACK, LEAST = 3, 0.5
BASE_SCORE = 0.5
#: Places of a text at which notices are looked for together.
SEGMENT = 20_000


@dataclass(frozen=True)
class Notice:
    """A licence's label, its notice, and phrases without which a text is not that licence."""

    label: str
    text: str
    keys: tuple[str, ...]


#: The customary notices of public licences.
NOTICES = (
    Notice("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license", "version 3")),
    Notice("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Notice("bsd", "Released under the BSD License", ("bsd license",)),
    Notice("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Notice("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Notice("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Notice("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Notice("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Notice("cc0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0",)),
    Notice("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    Notice("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Notice("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Notice("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license as published", "version 3 of the license")),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute this software", "notice appear in all copies")),
    Notice("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1", ("gnu lesser general public license", "version 2 1")),
    Notice("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license", "version 3")),
    Notice("mit", "Released under the MIT License", ("mit license",)),
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Notice(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ("permission is hereby granted free of charge", "shall be included in all copies or substantial portions"),
    ),
    Notice("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Notice("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
    ]
)


def _words(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(ALNUM_TABLE).split()


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """(word -> files with it, files) over all of ``docs``, for a vocabulary whose size the templates fix."""
    kind = T.StructType([T.StructField("found", T.ArrayType(T.StringType()))])

    def make():
        return lambda texts: [([w.decode() for w in vocabulary.intersection(_words(t))],) for t in texts]

    seen = annotate(docs, make, kind, "seen", text_col, [])
    counts = seen.select(F.explode("seen.found").alias("w")).groupBy("w").count().collect()
    return {r.w.encode(): r["count"] for r in counts}, docs.count()


class Scanner:
    def __init__(self, notices: Sequence[Notice], df: dict[bytes, int], files: int, phrases=PHRASES):
        self.phrases = [(b" " + b" ".join(_words(p)) + b" ", label) for p, label in phrases]
        self.notices = [(n.label, _words(n.text), [_words(k) for k in n.keys]) for n in notices]
        idf = lambda w: log((files + 1) / (df.get(w, 0) + 1)) + 0.1
        self.idf = {w: idf(w) for _, words, _ in self.notices for w in words}
        self.weight = [sum(self.idf[w] for w in words) for _, words, _ in self.notices]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _) in enumerate(self.notices):
            rarest = sorted(set(words), key=lambda w: (-self.idf[w], w))
            for w in rarest:
                if w in rarest[:2] or df.get(w, 0) <= COMMON * files:
                    self.postings[w] += [(t, i) for i, x in enumerate(words) if x == w]
        self.rare = set(self.postings)

    def base(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """(starts of all places of all phrases, labels)."""
        flat = b" " + b" ".join(words) + b" "
        starts, labels = [], set()
        for p, label in self.phrases:
            at, word, last = flat.find(p), 0, 0
            while at >= 0:
                word += flat.count(b" ", last, at)
                starts.append(word)
                labels.add(label)
                last, at = at, flat.find(p, at + 1)
        return starts, labels

    def notices_in(self, words: list[bytes]) -> dict[str, float]:
        """label -> best score. Places are taken SEGMENT by SEGMENT, each with the words that a notice there can reach, so memory does not follow the text."""
        found: dict[str, float] = {}
        if self.rare.isdisjoint(words):
            return found
        reach = max(len(model) for _, model, _ in self.notices)
        for first in range(-reach, len(words), SEGMENT):
            last = first + SEGMENT
            a, b = max(0, first - SLACK), min(len(words), last + reach + 2 * SLACK)
            if not self.rare.isdisjoint(words[a:b]):
                self._in_segment(words, a, b, first, last, found)
        return found

    def _in_segment(self, words: list[bytes], a: int, b: int, first: int, last: int, found: dict[str, float]) -> None:
        """Adds the scores of notices that begin at a place from ``first`` to ``last`` (exclusive), seen in the words ``a`` to ``b``."""
        flat = b" " + b" ".join(words[a:b]) + b" "
        open_ = {t for t, (_, _, keys) in enumerate(self.notices) if all(b" " + b" ".join(k) + b" " in flat for k in keys)}
        votes: dict[int, dict[int, set[bytes]]] = defaultdict(lambda: defaultdict(set))
        for i in range(a, b):
            if (w := words[i]) in self.rare:
                for t, pos in self.postings[w]:
                    if t in open_:
                        votes[t][i - pos].add(w)
        for t, shifts in votes.items():
            label, model, keys = self.notices[t]
            need = min(2, len({w for w in model if w in self.rare}))
            for shift, voters in shifts.items():
                if not first <= shift < last:
                    continue
                if len(voters) < need and len(set().union(*(shifts.get(shift + d, set()) for d in range(-SLACK, SLACK + 1)))) < need:
                    continue
                near = words[max(0, shift - SLACK) : min(len(words), shift + len(model) + SLACK)]
                if not all(_holds(near, k) for k in keys):
                    continue
                got = sum(self.idf[w] for j, w in enumerate(model) if w in words[max(0, shift + j - SLACK) : max(0, shift + j + SLACK + 1)])
                score = min(1.0, got / self.weight[t])
                if score >= LEAST:
                    found[label] = max(found.get(label, 0.0), score)

    def __call__(self, text: bytes | None) -> tuple:
        words = _words(text)
        starts, base = self.base(words)
        more = self.notices_in(words)
        score = max([BASE_SCORE if base else 0.0, *more.values()])
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(base | set(more)), score


def _holds(words: list[bytes], phrase: list[bytes]) -> bool:
    n = len(phrase)
    return any(words[i : i + n] == phrase for i in range(len(words) - n + 1))


def scan_licenses(
    docs: DataFrame,
    notices: Sequence[Notice] = NOTICES,
    text_col: str = "text",
    out: str = "license",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with the struct ``out``: n_words, n_base (places of base phrases), first_word and last_word (their least and
    greatest start; null without any), base_labels, labels (with those of notices; sorted), score.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; texts are read whole. Null and empty
    texts have no words, no labels and score 0. A notice is looked at where one of its rare words stands exactly in its
    place and two do within SLACK words; it is found there if its key phrases are, and LEAST of its weight stands within
    SLACK words of its place. Rare words: those in few files, and each template's two rarest. score is the best notice's, BASE_SCORE if there are only base phrases.
    Repeated rows get equal results; an empty table gives an empty one. A column called ``out`` is replaced.
    """
    vocabulary = {w for n in notices for w in _words(n.text)}
    df, files = document_frequencies(docs, text_col, vocabulary)

    def make():
        scan = Scanner(notices, df, files)
        return lambda texts: [scan(t) for t in texts]

    return annotate(docs, make, RESULT, out, text_col, carry)
