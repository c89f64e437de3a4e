"""Licence scans: templates with optional and replaceable regions, compiled to token automata."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiresmith.llm.common import map_texts

#: Lower-cases A-Z and blanks all other ASCII than 0-9 and a-z, so that words are what blanks divide.
_FOLD = bytes(
    b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256)
)

# Phrases that always count, and their labels.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Templates: label, then wording. <<beginOptional>>..<<endOptional>> may be left out as a whole;
# <<var:N>> stands for any run of up to N words. Everything else is mandatory, word by word. Fixed
# values: the wording of licences and of the notices that name them; whole licences are in templates/.
NOTICES = (
    ("mit", "<<beginOptional>>The<<endOptional>> <<beginOptional>>MIT License<<endOptional>> <<beginOptional>>(MIT)<<endOptional>> <<beginOptional>>Copyright <<var:12>><<endOptional>> Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "<<beginOptional>>ISC License<<endOptional>> <<beginOptional>>Copyright <<var:12>><<endOptional>> Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var:6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mit-notice", "<<beginOptional>>This <<var:3>> is<<endOptional>> <<beginOptional>>Released<<endOptional>> <<beginOptional>>Licensed<<endOptional>> <<beginOptional>>Distributed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("apache-2.0-notice", "<<beginOptional>>This <<var:3>> is<<endOptional>> Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License, Version 2.0 <<beginOptional>>(the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var:8>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. <<beginOptional>>See the License for the specific language governing permissions and limitations under the License.<<endOptional>><<endOptional>>"),
    ("gpl-notice", "<<beginOptional>>This <<var:3>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License"),
    ("gpl-2.0-notice", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3.0-notice", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-2.1-notice", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-3.0-notice", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var:8>>"),
    ("cc0-1.0-notice", "dedicated <<var:8>> to the public domain <<var:12>> CC0 1.0 Universal"),
)


def read_templates(folder: str) -> tuple[tuple[str, str], ...]:
    """(label, wording) of every ``.txt`` file in a folder, by name: whole licences as templates."""
    return tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.txt")))


TEMPLATES = (*NOTICES, *read_templates(Path(__file__).parent / "templates"))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the runs of 0-9, a-z and anything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Automaton:
    """A template as an automaton over words. From a state, ``step`` leads on by a word, ``free`` without
    one and ``skip`` by any word. The last state accepts."""

    label: str
    step: list[tuple[bytes, int] | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    skip: list[int | None] = field(default_factory=list)
    anchor: bytes = b""
    lead: int = 0  # words that may stand before the anchor

    def _state(self) -> int:
        self.step.append(None)
        self.free.append([])
        self.skip.append(None)
        return len(self.step) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: Sequence[bytes], start: int) -> int:
        """One past the last word of the longest text from ``start`` that is accepted; -1 if none."""
        states, end, last = self.closure({0}), -1, len(self.step) - 1
        for i in range(start, len(words) + 1):
            if last in states:
                end = i
            if i == len(words):
                break
            after = set()
            for s in states:
                if (e := self.step[s]) and e[0] == words[i]:
                    after.add(e[1])
                if (e := self.skip[s]) is not None:
                    after.add(e)
            if not after:
                break
            states = self.closure(after)
        return end


def compile_template(label: str, markup: str) -> Automaton:
    """The anchor is the longest mandatory run of words; ``lead`` bounds what may stand before it."""
    a = Automaton(label)
    now, opened = a._state(), []
    run: list[bytes] = []
    before = best_before = 0  # the most words that can precede the present place, and the anchor
    best: list[bytes] = []
    for part in re.split(r"(<<[^>]*>>)", markup):
        if part == "<<beginOptional>>":
            opened.append(now)
        elif part == "<<endOptional>>":
            a.free[opened.pop()].append(now)
        elif m := re.fullmatch(r"<<var:(\d+)>>", part):
            for _ in range(int(m[1])):
                s = a._state()
                a.skip[now] = s
                a.free[now].append(s)
                now = s
            before += int(m[1])
        elif part.startswith("<<"):
            raise ValueError(f"unknown markup {part}")
        else:
            for w in words_of(part):
                s = a._state()
                a.step[now] = (w, s)
                now = s
                before += 1
                if not opened:
                    run.append(w)
            if len(run) > len(best):
                best, best_before = run, before - len(run)
            continue
        run = []
        # what follows an edge without a word needs a state of its own, or a word edge would overwrite it
        s = a._state()
        a.free[now].append(s)
        now = s
    if not best:
        raise ValueError(f"template {label} has no mandatory word")
    a.anchor, a.lead = b" ".join(best), best_before
    return a


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which a phrase stands in words joined by single blanks."""
    at = joined.find(phrase)
    out, seen, word = [], 0, 0
    while at >= 0:
        stop = at + len(phrase)
        if (at == 0 or joined[at - 1] == 32) and (stop == len(joined) or joined[stop] == 32):
            word += joined.count(b" ", seen, at)
            seen = at
            out.append(word)
        at = joined.find(phrase, at + 1)
    return out


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]]):
        self.automata = [compile_template(*t) for t in templates]
        self.phrases = [(b" ".join(words_of(p)), label) for p, label in phrases]

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        joined = b" ".join(words)
        base = [(place, place + p.count(b" ") + 1, label) for p, label in self.phrases for place in _places(joined, p)]
        found = []
        for a in self.automata:
            done = 0
            for place in _places(joined, a.anchor):
                # the earliest start is the longest lead: one match per anchor is enough
                for start in range(max(done, place - a.lead), place + 1):
                    if (end := a.match(words, start)) > place:
                        found.append((start, end, a.label))
                        done = end
                        break
        inside, upto = 0, 0
        for start, end, _ in sorted([*base, *found]):
            inside += max(0, end - max(start, upto))
            upto = max(upto, end)
        labels = {label for *_, label in base}
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min((b[0] for b in base), default=None),
            "last_word": max((b[0] for b in base), default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {label for *_, label in found})),
            "score": inside / len(words) if words else 0.0,
            "matches": [{"first_word": s, "last_word": e - 1, "label": label} for s, e, label in sorted(found)],
        }


_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField(
        "matches",
        T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("label", T.StringType())])),
    ),
]


def _scanner(templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]]) -> Callable:
    def make():
        scan = Scanner(templates, phrases).scan

        def run(texts):
            rows = [scan(t) for t in texts]
            return {f.name: [r[f.name] for r in rows] for f in _FIELDS}

        return run

    return make


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = BASE_PHRASES,
) -> DataFrame:
    """Per document the base phrases and the licence templates that its whole text holds.

    A template is found where all of its mandatory words stand as they are, with its optional regions
    whole or left out and up to as many words as each replaceable region allows. n_base counts all
    places of the phrases, first_word and last_word are the smallest and largest
    word numbers at which one starts (null without any), base_labels their labels; matches lists the
    template texts by first and last word, labels adds their labels. score is the share of the
    words inside phrases and matches.

    A null text counts as empty: no words, score 0, empty labels. Repeated rows and null ids are
    scanned like any others; other columns are ignored, whatever their names. An empty table gives
    an empty result.
    """
    return map_texts(docs, [F.col(id_col).alias("doc_id")], F.col(text_col), _scanner(templates, phrases), _FIELDS)
