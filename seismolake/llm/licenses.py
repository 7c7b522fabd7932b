"""License scans: template markup compiled to token automata, beside fixed phrases.

A template is the whole wording of a license (or a one-line notice, which has a label of its own) with two kinds of markup, `<<beginOptional>> ... <<endOptional>>` and `<<var;max=N>>` (any words, N
at most; they stand where texts have names and years). It is compiled into an automaton over words whose mandatory words must all stand in the text as they are, optional
regions may be missing as a whole, and replaceable regions take any words up to their bound. A text carries a template's
label wherever the automaton accepts.

Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are lower-cased. A null text is empty;
an empty text has no words, null word places, empty labels and score 0. Repeated rows are scanned one by one. Of runs that start at one word the longest counts, equal spans of
several labels are all told, in order of place and label. A very long text is scanned as a whole. Other columns are carried through, those that clash with a result's are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, text_bytes

#: Phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public licenses as their texts stand, label and template. Only names, years and copyright lines are replaceable, only titles and wording that the texts' own publishers call optional may be missing.
TEXTS = {
    "mit": """
        <<beginOptional>>The<<endOptional>> <<beginOptional>>MIT License<<endOptional>> <<beginOptional>>(MIT)<<endOptional>> <<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;max=20>><<endOptional>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<beginOptional>>THE<<endOptional>> <<var;max=10>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause": """
        <<beginOptional>>BSD 2-Clause License<<endOptional>> <<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;max=20>><<endOptional>>
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
        IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """
        <<beginOptional>>BSD 3-Clause License<<endOptional>> <<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;max=20>><<endOptional>>
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.
        <<beginOptional>>3.<<endOptional>> Neither the name of <<var;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.
        THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
        IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """
        <<beginOptional>>ISC License<<endOptional>> <<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;max=20>><<endOptional>>
        Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=8>> BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """
        <<beginOptional>>zlib License<<endOptional>> <<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;max=20>><<endOptional>>
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment
        in the product documentation would be appreciated but is not required.
        <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.""",
    "apache-2.0": """
        <<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;max=20>><<endOptional>>
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>>://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-or-later": """
        <<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;max=20>><<endOptional>>
        <<beginOptional>>This program is free software: you can redistribute it and/or modify it<<endOptional>> under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>>://www.gnu.org/licenses/.""",
}

#: One-line notices, which name a license without its wording; label and template.
NOTICES = {
    "mit-notice": "<<beginOptional>>this <<var;max=3>> is<<endOptional>> <<beginOptional>>released<<endOptional>> under the mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "gpl-3.0-notice": "<<beginOptional>>this <<var;max=4>> is<<endOptional>> licensed under the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the license or at your option any later version<<endOptional>>",
    "cc-by-4.0-notice": "<<beginOptional>>this work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons attribution<<endOptional>> cc by 4 0 <<beginOptional>>international license<<endOptional>>",
    "copyright-notice": "copyright <<beginOptional>>c<<endOptional>> <<var;max=8>> all rights reserved",
}

TEMPLATES = TEXTS | NOTICES

FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Automaton:
    """States 0 .. accept; edges by word, `free` edges by no word, `any` loops counted by their states."""

    label: str
    words: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    wild: list[int | None] = field(default_factory=lambda: [None])
    runs: list[bytes] = field(default_factory=list)
    accept: int = 0

    def state(self) -> int:
        self.words.append({})
        self.free.append([])
        self.wild.append(None)
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run from start, or -1."""
        states, end = self.closure({0}), -1
        for place in range(start, len(words) + 1):
            if self.accept in states:
                end = place
            if place == len(words) or not states:
                break
            word = words[place]
            states = self.closure({t for s in states for t in (self.words[s].get(word), self.wild[s]) if t is not None})
        return end


def compiled(label: str, template: str) -> Automaton:
    out, at, opened, run = Automaton(label), 0, [], []
    for mark, plain in re.findall(r"<<([^>]*)>>|((?:(?!<<).)+)", template, re.DOTALL):
        if plain:
            for word in plain.encode().translate(FOLD).split():
                out.words[at][word] = at = out.state()
                if not opened:
                    run.append(word)
            continue
        if run:
            out.runs.append(b" " + b" ".join(run) + b" ")
            run = []
        if mark == "beginOptional":
            opened.append(at)
            fresh = out.state()
            out.free[at].append(fresh)
            at = fresh
        elif mark == "endOptional":
            fresh = out.state()
            out.free[at].append(fresh)
            out.free[opened.pop()].append(fresh)
            at = fresh
        else:
            last = at
            for _ in range(int(re.search(r"max=(\d+)", mark)[1])):
                fresh = out.state()
                out.wild[last] = fresh
                out.free[last].append(fresh)
                last = fresh
            at = out.state()
            out.free[last].append(at)
    if run:
        out.runs.append(b" " + b" ".join(run) + b" ")
    out.accept = at
    return out


def matches(automaton: Automaton, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
    """Leftmost longest runs of words that the automaton accepts, not overlapping."""
    if not all(run in joined for run in automaton.runs):
        return []
    first = {w for s in automaton.closure({0}) for w in automaton.words[s]}
    out, place = [], 0
    while place < len(words):
        end = automaton.longest(words, place) if words[place] in first else -1
        if end > place:
            out.append((place, end))
            place = end
        else:
            place += 1
    return out


def phrase_places(phrase: bytes, joined: bytes) -> list[int]:
    """First words of the places where a phrase stands in words joined by single spaces, with one at either end."""
    sought, out, seen, counted = b" " + phrase + b" ", [], 0, 0
    at = joined.find(sought)
    while at >= 0:
        seen += joined.count(b" ", counted, at)
        counted = at
        out.append(seen)
        at = joined.find(sought, at + 1)
    return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_text(text: bytes, automata: list[Automaton], phrases: dict[bytes, str]) -> tuple:
    words = text.translate(FOLD).split()
    joined = b" " + b" ".join(words) + b" "
    starts, base, spans = [], set(), []
    for phrase, label in phrases.items():
        if b" " + phrase + b" " in joined:
            got, length = phrase_places(phrase, joined), len(phrase.split())
            starts += got
            base.add(label)
            spans += [(label, s, s + length) for s in got]
    for automaton in automata:
        spans += [(automaton.label, a, b) for a, b in matches(automaton, words, joined)]
    covered, reach = 0, 0
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        covered += max(0, b - max(a, reach))
        reach = max(reach, b)
    labels = base | {x[0] for x in spans}
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), covered / len(words) if words else 0.0, ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], x[2], x[0]))))


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """docs without the text, with SCHEMA; spans are label:first word:end word."""
    keep = [c for c in docs.columns if c != text and c not in {x.split()[0] for x in SCHEMA.split(", ")}]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), SCHEMA])
    phrases = {k.encode(): v for k, v in PHRASES.items()}

    def run(batches):
        automata = [compiled(k, v) for k, v in templates.items()]
        for batch in batches:
            data, ends = text_bytes(batch.column(len(keep)))
            raw = memoryview(data)
            rows = [scan_text(bytes(raw[ends[i] : ends[i + 1]]), automata, phrases) for i in range(len(ends) - 1)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, *(x.split()[0] for x in SCHEMA.split(", "))])

    return docs.select(*keep, text).mapInArrow(lean(run), schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
