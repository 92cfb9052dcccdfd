"""License scans: a generalised suffix automaton over licence tokens, and chained long matches.

One automaton holds every token run of every template. Each text is streamed through it once, which
gives matching statistics: at each word the length of the longest run ending there that occurs in
some template. Long maximal matches are aligned to the templates that hold them and chained in order
into covered spans; a template covered well enough gives its label. Where covered spans of several templates
overlap, the one of most words counts, of equals the one that covers more of its template, so a notice is not also
taken for a relative that shares most of its words. The words that tell licences apart (``TELLING``, and the numbers after
version) must be the same in the span and in the template, neither missing nor more of them, whatever is covered. "licence" counts as "license" in templates. Fixed phrases are read off the
same statistics and then confirmed word by word; their labels always stay.

Defined results: a null text counts as empty (0 words, no labels, score 0); repeated rows give
repeated results; whole texts are scanned at any length; extra columns are dropped; an empty table
gives an empty result; ties between templates go to the earlier span, then to the smaller label. One narrow map: the templates are fixed and small, nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import portions, table

#: Base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_PERMISSION = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_REDISTRIBUTION = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_ENDORSE = "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_GNU = "is free software you can redistribute it and or modify it under the terms of the gnu {} license as published by the free software foundation either version {} of the license or at your option any later version this {} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {} license for more details"
_WORK = "this work is licensed under a creative commons attribution{} {} license"
_GENERAL, _LESSER, _AFFERO = "general public", "lesser general public", "affero general public"

#: Templates: a label and a text; fixed values taken from the public licence notices. A notice and its parts that
#: are found alone are templates of their own.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", _PERMISSION),
    ("mit", f"{_PERMISSION} subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_AS_IS}"),
    ("mit-0", f"{_PERMISSION} {_AS_IS}"),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("apache-2", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0"),
    ("apache-2", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", f"this program {_GNU.format(_GENERAL, 3, 'program', _GENERAL)}"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2", f"this program {_GNU.format(_GENERAL, 2, 'program', _GENERAL)}"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", f"this library {_GNU.format(_LESSER, 2.1, 'library', _LESSER)}"),
    ("lgpl", f"this program {_GNU.format(_LESSER, 3, 'program', _LESSER)}"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("agpl-3", f"this program {_GNU.format(_AFFERO, 3, 'program', _AFFERO)}"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4.0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4.0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    *(("cc-" + label, _WORK.format(words, version)) for label, words in (("by", ""), ("by-nc", " noncommercial"), ("by-sa", " sharealike"), ("by-nd", " noderivatives"), ("by-nc-sa", " noncommercial sharealike"), ("by-nc-nd", " noncommercial noderivatives")) for version in ("3.0 unported", "2.0 generic")),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "this work is dedicated to the public domain under cc0 1.0 universal"),
    *((f"{label}{tail}", f"{verb} under the gnu {name} license version {version}") for label, name, versions in (("gpl", _GENERAL, (2, 3)), ("lgpl", _LESSER, (2.1, 3)), ("agpl", _AFFERO, (3,))) for version in versions for tail in ("" if label == "lgpl" else f"-{version}",) for verb in ("licensed", "released", "distributed")),
    *((f"{label}{tail}", f"{head}gnu {name} license version {version}{rest}") for head, rest in (("under the terms of the ", ""), ("", " as published by the free software foundation"), ("under the terms of the ", " as published by the free software foundation")) for label, name, versions in (("gpl", _GENERAL, (2, 3)), ("lgpl", _LESSER, (2.1, 3)), ("agpl", _AFFERO, (3,))) for version in versions for tail in ("" if label == "lgpl" else f"-{version}",)),
    *((label, f"gnu {name} license version {version} copyright c {years} free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed") for label, name, version, years in (
        ("gpl-3", _GENERAL, "3 29 june 2007", "2007"), ("gpl-2", _GENERAL, "2 june 1991", "1989 1991"), ("lgpl", _LESSER, "3 29 june 2007", "2007"), ("lgpl", _LESSER, "2.1 february 1999", "1991 1999"), ("agpl-3", _AFFERO, "3 19 november 2007", "2007"))),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www eclipse org legal epl 2.0"),
    ("epl-2", "under the terms of the eclipse public license version 2.0"),
    ("epl-1", "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution"),
    ("bsd-2", _REDISTRIBUTION),
    ("bsd-3", f"{_REDISTRIBUTION} {_ENDORSE}"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Words that tell licences apart, and those that a version number follows: fixed values.
TELLING = ("affero", "lesser", "library", "noncommercial", "nc", "sharealike", "sa", "noderivatives", "nd", "mit", "apache", "mozilla", "eclipse", "cc0")
VERSION = ("version", "v", "license")
#: Words around a span that are read for them too.
_AROUND = 2
#: Shortest match that a chain takes, and the share of a template's words that gives its label.
LEAST_MATCH, LEAST_SHARE = 3, 0.75

#: Words are runs of ASCII letters and digits and of all bytes above ASCII; letters are lowered.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 bytes."""
    return text.encode("utf-8").translate(_FOLD).split() if text else []


class TemplateAutomaton:
    """Generalised suffix automaton of token runs; a state knows its longest run and where that ends in templates."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.vocab: dict[bytes, int] = {}
        self.templates = [(label, [self._id(w) for w in words_of(text)]) for label, text in templates]
        self.phrases = [([self._id(w) for w in words_of(text)], label) for text, label in phrases]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.ends = [-1], [0], [set()]
        for k, (_, tokens) in enumerate([*self.templates, *((label, t) for t, label in self.phrases)]):
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token)
                if k < len(self.templates):
                    self.ends[last].add((k, i))
        self.telling = {self.vocab[w.encode()] for w in TELLING if w.encode() in self.vocab}
        self.versions = {self.vocab[w.encode()] for w in VERSION if w.encode() in self.vocab}
        self.numbers = {i for w, i in self.vocab.items() if w.isdigit()}
        self.told = [self._told(tokens) for _, tokens in self.templates]
        # places of a state are its own and those of all states that link to it
        for s in sorted(range(len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _id(self, word: bytes) -> int:
        return self.vocab.setdefault(word, len(self.vocab))

    def _told(self, tokens: list[int | None]) -> tuple[set, set]:
        """The telling words among tokens, and the numbers after the word version and the like (None for one that no template has)."""
        numbers = {b for a, b in zip(tokens, tokens[1:], strict=False) if a in self.versions and (b in self.numbers or b is None)}
        return self.telling.intersection(tokens), numbers

    def tells(self, k: int, tokens: list[int | None], start: int, end: int) -> bool:
        """Whether the words that tell licences apart are those of template ``k`` in a span of a text and just around it."""
        words, numbers = self.told[k]
        found, versions = self._told(tokens[max(0, start - _AROUND) : end + _AROUND])
        return words == found and (not numbers or numbers <= versions and versions <= numbers | {None})

    def _state(self, size: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.size.append(size)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """The state of the longest run of p followed by token, split from q where q is longer."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:  # another template has this run already
            return self._split(last, token, self.next[last][token])
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token, self.next[p][token])
        return new

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(state, length) after each token: the longest run ending there that some template holds."""
        out, s, n = [], 0, 0
        for token in tokens:
            while s and token not in self.next[s]:
                s = self.link[s]
                n = self.size[s]
            if token in self.next[s]:
                s, n = self.next[s][token], n + 1
            else:
                n = 0
            out.append((s, n))
        return out


def _chained(found: list[tuple[int, int, int]], length: int) -> list[list[int]]:
    """The best chain [start, end, place in the template, words] that ends with each match, in one template of ``length`` words.

    ``found``: (end in the text, end in the template, words) of the matches, sorted. A match follows another that ends before it
    in text and template, over a gap in the text of no more than ``length`` words; words that both cover count once.
    No match is longer than the template, so only matches of the last two lengths of text can be followed, and all
    of these are tried: the time is linear in the text.
    """
    chains: list[list[int]] = []
    oldest = 0
    for end, at, n in found:
        while oldest < len(chains) and chains[oldest][1] < end - 2 * length:
            oldest += 1
        words, start = n, end - n
        for k in range(oldest, len(chains)):
            c = chains[k]
            if at > c[2] and end - n - c[1] <= length:
                over = max(0, c[1] - (end - n), c[2] - (at - n))
                if over < n and (c[3] - over + n, -c[0]) > (words, -start):
                    words, start = c[3] - over + n, c[0]
        chains.append([start, end, at, words])
    return chains


def _chains(auto: TemplateAutomaton, peaks: list[tuple[int, int, int]], share: float = LEAST_SHARE, text: list[int | None] | None = None) -> tuple[list[tuple[str, int, int, float]], float]:
    """(label, start, end, share) of the covered spans that count, and the highest share of any chain; word places, end exclusive.

    ``peaks``: (place of the last word, state, length) of maximal matches. Each is placed in every
    template that holds it, and chained there. With the tokens of the ``text`` only spans count whose telling words are the template's.
    """
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for i, s, n in peaks:
        for k, end in auto.ends[s]:
            by_template.setdefault(k, []).append((i + 1, end + 1, n))
    full, best = [], 0.0
    for k, found in by_template.items():
        label, tokens = auto.templates[k]
        for start, end, _, covered in _chained(sorted(found), len(tokens)):
            part = min(1.0, covered / len(tokens))
            best = max(best, part)
            if covered >= share * len(tokens) and (text is None or auto.tells(k, text, start, end)):
                full.append((-covered, -part, start, end, label))
    out, taken = [], []
    for _, part, start, end, label in sorted(full):
        k = bisect(taken, (start, end))
        if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= end):
            taken.insert(k, (start, end))
            out.append((label, start, end, -part))
    return out, best


def scan_words(auto: TemplateAutomaton, tokens: list[int | None], least: int = LEAST_MATCH, share: float = LEAST_SHARE) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]], float]:
    """(start, label) of every base phrase, the covered spans (label, start, end, share) of the templates, and the highest share of any."""
    shortest = min([least, *(len(phrase) for phrase, _ in auto.phrases)])
    base, peaks = [], []
    runs, start = [], None
    for i, t in enumerate(tokens):  # words of no template end every match
        if t is None:
            if start is not None and i - start >= shortest:
                runs.append((start, i))
            start = None
        elif start is None:
            start = i
    if start is not None and len(tokens) - start >= shortest:
        runs.append((start, len(tokens)))
    for a, b in runs:
        part = tokens[a:b]
        stats = auto.statistics(part)
        for i, (s, n) in enumerate(stats):
            if n < shortest:
                continue
            if n >= least and (i + 1 == len(stats) or stats[i + 1][1] != n + 1):
                peaks.append((a + i, s, n))
            for phrase, label in auto.phrases:
                if n >= len(phrase) and part[i + 1 - len(phrase) : i + 1] == phrase:
                    base.append((a + i + 1 - len(phrase), label))
    return base, *_chains(auto, peaks, share, tokens)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = LEAST_SHARE, least: int = LEAST_MATCH) -> DataFrame:
    """(id, n_words, base array<struct<start, label>>, matches array<struct<label, start, end, share>>).

    ``matches`` holds the spans that cover a template to ``share`` at least and do not overlap; ``best`` is the highest
    share of any template.
    """
    own = df.select(F.col(id_col), F.col(text_col))
    base_t = T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType())])
    match_t = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("share", T.DoubleType())])
    out = T.StructType([own.schema[0], T.StructField("n_words", T.LongType()), T.StructField("base", T.ArrayType(base_t)), T.StructField("matches", T.ArrayType(match_t)), T.StructField("best", T.DoubleType())])
    base_a = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    match_a = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = TemplateAutomaton()
        get = auto.vocab.get
        for batch in (x for whole in batches for x in portions(whole, 1)):
            n_words, base, matches, best = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                n_words.append(len(words))
                spelt = [k for k, w in enumerate(words) if w == b"licence"]
                for k in spelt:
                    words[k] = b"license"
                found, chains, highest = scan_words(auto, list(map(get, words)), least, share)
                if spelt:  # base phrases stand as they are
                    length = {label: len(p.split()) for p, label in PHRASES}
                    found = [(s, x) for s, x in found if bisect(spelt, s + length[x] - 1) == bisect(spelt, s - 1)]
                base.append([{"start": s, "label": x} for s, x in sorted(found)])
                matches.append([{"label": x, "start": s, "end": e, "share": r} for x, s, e, r in sorted(chains, key=lambda c: c[1:])])
                best.append(highest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(base, base_a), pa.array(matches, match_a), pa.array(best, pa.float64())], names=out.names)

    return own.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: counts and places of base phrases, and labels, of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"), labels(F.col("base.label"), F.col("matches.label")).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), "best").alias("score"),
    )
