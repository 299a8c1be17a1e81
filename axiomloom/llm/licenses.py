"""License texts and statements by template markup compiled into token automata.

A template is wording with optional and replaceable regions:

    <<beginOptional>> wording <<endOptional>>        may be left out
    <<var;name="holder";words="1-30">>               so many words of any kind
    <<var;name="version";match="2|2 0|3">>           one of these wordings

Everything else is mandatory and has to stand in the text word for word. Words
are runs of digits, letters and characters beyond ASCII, A-Z in lower case, so
punctuation, line breaks and comment marks do not matter.

All templates become one position automaton: a state is a word of a template
(or any word, in a region of free words), and moves lead to the words that may
follow. A text is read once, a stretch at a time; a state remembers the smallest
start that leads to it. Templates that begin with a region of free words look at every word and are slow. A match is (label, start, end) with the smallest start for its end
and the largest end for its start.

Null texts are empty and match nothing, as do texts without words; repeated rows
and ids are rows like others; an empty table gives no rows; only the named
columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches

#: The base phrases by label.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Public license texts, notices and statements.
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    'the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and '
    'to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above '
    'copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be '
    'included in all copies or substantial portions of the Software.')
_MIT_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    'THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL '
    '<<var;name="holder";words="1-30">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF '
    'CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS '
    'IN THE SOFTWARE.')
_BSD_HEAD = (
    'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the '
    'following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the '
    'above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> '
    'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the '
    'following disclaimer in the documentation and/or other materials provided with the distribution.')
_BSD_THIRD = (
    ' <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="holder";words="1-30">> nor the names of its '
    'contributors may be used to endorse or promote products derived from this software without specific prior written '
    'permission.')
_BSD_TAIL = (
    ' THIS SOFTWARE IS PROVIDED BY <<var;name="provider";words="1-30">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    'INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE '
    'DISCLAIMED.')

#: Label and template of each license form.
TEMPLATES = {
    "mit-statement": '<<var;name="verb";match="released|licensed|distributed|available">> under the <<beginOptional>>terms of the'
                     '<<endOptional>> MIT license',
    "mit-text": _MIT_GRANT + _MIT_WARRANTY,
    "isc-text": 'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose '
                'with or without fee is hereby granted, provided that the above copyright notice and this permission notice '
                'appear in all copies.',
    "bsd-2-clause-text": _BSD_HEAD + _BSD_TAIL,
    "bsd-3-clause-text": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "apache-2.0-statement": 'licensed under the Apache License<<beginOptional>>, Version<<endOptional>> '
                            '<<var;name="version";match="2|2 0">>',
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>; you may '
                         'not use <<var;name="what";words="1-6">> except in compliance with the License. You may obtain a copy of '
                         'the License at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> '
                         'www.apache.org/licenses/LICENSE-2.0',
    "gpl-statement": 'licensed under the <<beginOptional>>terms of the<<endOptional>> GNU <<beginOptional>>Lesser<<endOptional>> '
                     'General Public License<<beginOptional>>, version<<endOptional>> <<var;name="version";match="2|2 0|3|3 0">>',
    "gpl-notice": 'is free software; you can redistribute it '
                  'and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> General Public License as '
                  'published by the Free Software Foundation, either version <<var;name="version";match="2|3|2 1">> of the '
                  'License, or (at your option) any later version.',
    "cc-by-statement": 'licensed under <<beginOptional>>a<<endOptional>> <<var;name="name";match="CC|Creative Commons">> '
                       '<<var;name="by";match="BY|Attribution">> <<var;name="version";match="2 0|2 5|3 0|4 0">>',
    "cc-by-nc-statement": 'licensed under <<beginOptional>>a<<endOptional>> <<var;name="name";match="CC|Creative Commons">> '
                          '<<var;name="by";match="BY|Attribution">> <<var;name="nc";match="NC|NonCommercial">> '
                          '<<var;name="more";match="|SA|ND|ShareAlike|NoDerivatives">> <<var;name="version";match="2 0|2 5|3 0|4 0">>',
    "cc-by-sa-statement": 'licensed under <<beginOptional>>a<<endOptional>> <<var;name="name";match="CC|Creative Commons">> '
                          '<<var;name="by";match="BY|Attribution">> <<var;name="sa";match="SA|ShareAlike">> '
                          '<<var;name="version";match="2 0|2 5|3 0|4 0">>',
    "public-domain-text": 'This is free and unencumbered software released into the public domain.',
    "spdx-tag": 'SPDX-License-Identifier: <<var;name="id";words="1">>',
}

ANY = None  # a word of any kind
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
STRETCH = 1 << 20


class TemplateMarkupError(ValueError):
    """A template that cannot be read."""


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text in UTF-8: all else becomes a space, A-Z lower case."""
    return raw.translate(_LETTERS).split()


def stretches(raw: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """Lists of words of about ``size`` bytes of text, cut between words."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw) and _LETTERS[raw[end]] != 32:
            end += 1
        yield words_of(raw[at:end])
        at = end


# ---- markup to tree --------------------------------------------------------
# A tree is a tuple: ("word", w), ("any", least, most or None), ("seq", parts), ("either", parts); an empty
# seq is nothing.
_MARK = re.compile(r"<<(.*?)>>", re.DOTALL)
_FIELD = re.compile(r'(\w+)="([^"]*)"')


def _wording(text: str) -> list[tuple]:
    return [("word", w) for w in words_of(text.encode())]


def _variable(body: str) -> tuple:
    fields = dict(_FIELD.findall(body))
    if "match" in fields:
        return ("either", tuple(("seq", tuple(_wording(p))) for p in fields["match"].split("|")))
    least, dash, most = fields.get("words", "").partition("-")
    if not least.isdigit() or most and not most.isdigit():
        raise TemplateMarkupError(f"a replaceable region needs match or words: {body}")
    return ("any", int(least), (int(most) if most else None) if dash else int(least))


def parse(markup: str) -> tuple:
    """The tree of a template. Optional regions may be nested."""
    open_: list[list[tuple]] = [[]]
    at = 0
    for m in _MARK.finditer(markup):
        open_[-1] += _wording(markup[at:m.start()])
        at, body = m.end(), m.group(1)
        if body == "beginOptional":
            open_.append([])
        elif body == "endOptional":
            if len(open_) == 1:
                raise TemplateMarkupError("endOptional without beginOptional")
            inner = ("seq", tuple(open_.pop()))
            open_[-1].append(("either", (inner, ("seq", ()))))
        elif body.startswith("var;"):
            open_[-1].append(_variable(body))
        else:
            raise TemplateMarkupError(f"unknown mark {body!r}")
    open_[-1] += _wording(markup[at:])
    if len(open_) > 1:
        raise TemplateMarkupError("beginOptional without endOptional")
    return ("seq", tuple(open_[0]))


def mandatory(tree: tuple) -> int:
    """Words of a template's own wording that no accepted text lacks."""
    kind = tree[0]
    if kind == "word":
        return 1
    if kind == "any":
        return 0
    counts = [mandatory(t) for t in tree[1]]
    return sum(counts) if kind == "seq" else min(counts)


# ---- trees to one automaton ------------------------------------------------
@dataclass
class Automaton:
    """Positions of all templates. ``first`` and ``follow[p]`` lead by word (ANY: by any word) to positions;
    ``last[p]`` is the template that may end at p."""

    labels: list[str] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)
    first: dict = field(default_factory=dict)
    follow: list[dict] = field(default_factory=list)
    last: dict[int, int] = field(default_factory=dict)
    symbol: list = field(default_factory=list)

    def _position(self, symbol) -> int:
        self.symbol.append(symbol)
        self.follow.append({})
        return len(self.symbol) - 1

    def _lead(self, sources: Sequence[int], targets: Sequence[int]) -> None:
        for p in sources:
            for q in targets:
                into = self.follow[p].setdefault(self.symbol[q], [])
                if q not in into:
                    into.append(q)

    def _build(self, tree: tuple) -> tuple[list[int], list[int], bool]:
        """(positions it may begin with, may end with, whether it may be empty)."""
        kind = tree[0]
        if kind == "word":
            p = self._position(tree[1])
            return [p], [p], False
        if kind == "any":
            _, least, most = tree
            parts = [("free", ANY)] * least
            parts += [("maybe", ANY)] * (0 if most is None else most - least)
            if most is None:
                parts += [("loop", ANY)]
            return self._chain([self._free(k) for k, _ in parts])
        built = [self._build(t) for t in tree[1]]
        if kind == "seq":
            return self._chain(built)
        return [p for b in built for p in b[0]], [p for b in built for p in b[1]], any(b[2] for b in built)

    def _free(self, kind: str) -> tuple[list[int], list[int], bool]:
        p = self._position(ANY)
        if kind == "loop":
            self._lead([p], [p])
        return [p], [p], kind != "free"

    def _chain(self, built: list) -> tuple[list[int], list[int], bool]:
        begin, end, empty = [], [], True
        for b, e, may in built:
            self._lead(end, b)
            if empty:
                begin = begin + b
            end = end + e if may else e
            empty = empty and may
        return begin, end, empty

    def add(self, label: str, tree: tuple) -> None:
        if not mandatory(tree):
            raise TemplateMarkupError(f"template {label} has no mandatory word")
        begin, end, _ = self._build(tree)
        for p in begin:
            self.first.setdefault(self.symbol[p], []).append(p)
        self.last |= dict.fromkeys(end, len(self.labels))
        self.labels.append(label)
        self.weights.append(mandatory(tree))

    def matches(self, pieces: Iterator[list[bytes]]) -> tuple[int, list[tuple[int, int, int]]]:
        """(words read, matches as (template, start, end)), in order of template and start."""
        first, follow, last = self.first, self.follow, self.last
        free = first.get(ANY, ())
        live: dict[int, int] = {}
        found: dict[tuple[int, int], int] = {}
        n = 0
        for words in pieces:
            for at, w in enumerate(words, n):
                if not (live or free or w in first):
                    continue
                went: dict[int, int] = {}
                for p, start in live.items():
                    moves = follow[p]
                    for q in (*moves.get(w, ()), *moves.get(ANY, ())):
                        if went.get(q, at) >= start:
                            went[q] = start
                for q in (*first.get(w, ()), *free):
                    went.setdefault(q, at)
                ends: dict[int, int] = {}
                for q, start in went.items():
                    if (t := last.get(q)) is not None:
                        ends[t] = min(start, ends.get(t, start))
                for t, start in ends.items():
                    found[t, start] = at + 1
                live = went
            n += len(words)
        return n, sorted((t, s, e) for (t, s), e in found.items())


@lru_cache(maxsize=4)
def compiled(templates: tuple[tuple[str, str], ...]) -> Automaton:
    out = Automaton()
    for label, markup in templates:
        out.add(label, parse(markup))
    return out


# ---- Spark -----------------------------------------------------------------
MATCH = "array<struct<label: string, start: bigint, end: bigint, weight: int>>"


def scan(docs: DataFrame, templates: dict[str, str], keep: Sequence[str | Column] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and n_words, matches: all places where a template's wording stands. ``weight`` is the
    number of the template's mandatory words. Texts are read where they lie."""
    small_batches(docs.sparkSession)
    forms = tuple(templates.items())
    compiled(forms)  # refuses unreadable templates before a job starts
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("t"))
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("weight", pa.int32())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(forms)
        for b in batches:
            counts, lists = [], []
            for value in b.column(1):
                raw = value.as_buffer()
                n, places = automaton.matches(stretches(raw.to_pybytes())) if raw is not None else (0, [])
                counts.append(n)
                lists.append([{"label": automaton.labels[t], "start": s, "end": e, "weight": automaton.weights[t]} for t, s, e in places])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(lists, kind)], names=["kept", "n_words", "matches"])

    made = rows.mapInArrow(read, f"kept {rows.schema['kept'].dataType.simpleString()}, n_words bigint, matches {MATCH}")
    return made.select("kept.*", "n_words", "matches")


#: A statement of two words is as likely as not to be about something else: n mandatory words give n / (n + 2).
DOUBT = 2


def summary(scanned: DataFrame, base: Sequence[str] = tuple(PHRASES), keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts, first and last place of the base labels, both label lists and a score: the longest
    mandatory wording found, n words giving n / (n + DOUBT), 0 where there is none."""
    is_base = lambda m: m["label"].isin(*base)
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(F.filter("matches", is_base), lambda m: m["start"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["weight"])), F.lit(0)).cast("double")
    return scanned.select(
        *keep, "n_words", F.size(starts).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(F.filter("matches", is_base)).alias("base_labels"),
        labels("matches").alias("labels"), F.when(best > 0, best / (best + DOUBT)).otherwise(0.0).alias("score"))


def license_scan(docs: DataFrame, keep: Sequence[str | Column] = ("doc_id",), text: str = "text") -> DataFrame:
    """The places of the base phrases and of all templates, one pass."""
    return scan(docs, {**PHRASES, **TEMPLATES}, keep, text)


# ---- the same wording as a regular expression, for SQL and tests -----------
def as_pattern(tree: tuple) -> str:
    """A pattern over words that each end with a space."""
    kind = tree[0]
    if kind == "word":
        return re.escape(tree[1].decode()) + " "
    if kind == "any":
        return "(?:[^ ]+ ){%d,%s}" % (tree[1], "" if tree[2] is None else tree[2])
    parts = [as_pattern(t) for t in tree[1]]
    return "".join(parts) if kind == "seq" else "(?:" + "|".join(parts) + ")"
