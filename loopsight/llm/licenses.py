"""License scans by template-markup matching."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from loopsight.llm.common import plain_words, text_batches, texts_of

#: Fixed values of the contract: phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: [[1.]] [[a.]] {{redistributions|redistribution}} of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer. [[2.]] [[b.]] {{redistributions|redistribution}} in binary form
    must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution. """
_BSD_DISCLAIMER = """This software is provided by {{12}} "as is" and any express or implied warranties, including, but not
    limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event
    shall {{12}} be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but
    not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption)
    however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or
    otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""

#: License wording as templates: [[...]] may be left out, {{n}} stands for up to n words of any kind,
#: {{a|b}} for one of the given words. Punctuation and case don't matter. Each begins with fixed words.
TEMPLATES = {
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this {{software|work}} and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in
        all copies or substantial portions of the Software. The {{software|work}} is provided "as is", without warranty of
        any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a
        particular purpose and [[non]] {{noninfringement|infringement}}. In no event shall the {{8}} be liable for any claim,
        damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in
        connection with the {{software|work}} or the use or other dealings in the {{software|work}}.""",
        "released under the [[terms of the]] MIT License",
    ],
    "isc": [
        """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The
        software is provided "as is" and {{8}} {{disclaim|disclaims}} all warranties with regard to this software including all
        implied warranties of merchantability and fitness. In no event shall {{8}} be liable for any special, direct,
        indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether
        in an action of contract, negligence or other tortious action, arising out of or in connection with the use or
        performance of this software.""",
    ],
    "bsd-2": [_BSD + _BSD_DISCLAIMER],
    "bsd-3": [
        _BSD
        + """ [[3.]] [[c.]] Neither the {{name|names}} of {{12}} nor the names of {{3}} contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. """
        + _BSD_DISCLAIMER
    ],
    "0bsd": [
        """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby
        granted. The software is provided "as is" and {{8}} {{disclaim|disclaims}} all warranties with regard to this software
        including all implied warranties of merchantability and fitness. In no event shall {{8}} be liable for any special,
        direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits,
        whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use
        or performance of this software.""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will {{8}} be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: [[1.]] The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. [[2.]] Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. [[3.]] This notice may not be removed or altered from any source
        distribution.""",
    ],
    "bsl-1": [
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire
        statement, including the above license grant, this restriction and the following disclaimer, must be included in all
        copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or
        derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    ],
    "wtfpl": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"],
    "apache-2": [
        "licensed under the Apache License, Version 2 [[0]]",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ],
    "gpl-2": ["GNU General Public License [[as published by the Free Software Foundation either]] version 2"],
    "gpl-3": ["GNU General Public License [[as published by the Free Software Foundation either]] version 3"],
    "agpl-3": ["GNU Affero General Public License [[as published by the Free Software Foundation either]] version 3"],
    "lgpl": ["GNU {{lesser|library}} General Public License [[as published by the Free Software Foundation]]"],
    "epl-2": ["made available under the terms of the Eclipse Public License [[v]] 2 0"],
    "mpl-2": ["subject to the terms of the Mozilla Public License, {{v|version}} 2 0"],
    "cc-by-nc": [
        "licensed under [[a]] [[the]] CC BY NC [[4 0]]",
        "Creative Commons Attribution NonCommercial [[{{2}} international]]",
    ],
    "cc-by": ["licensed under [[a]] [[the]] CC BY 4 0", "Creative Commons Attribution 4 0 [[international]]"],
    "cc0": ["CC0 1 0 [[universal]]", "Creative Commons Zero"],
    "cc-by-sa": ["licensed under [[a]] [[the]] CC BY SA [[4 0]]", "Creative Commons Attribution ShareAlike [[{{2}} international]]"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
        as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ],
    "reserved": ["all rights reserved"],
}


class Template:
    """A token automaton: states with edges on one word, on any word, and without a word."""

    def __init__(self, markup: str):
        self.words: list[dict[bytes, set[int]]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[set[int]] = [set()]
        at, opened = 0, []
        first, mandatory = [], True
        for part in re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|(?:(?!\[\[|\]\]|\{\{).)+", markup, re.DOTALL):
            if part == "[[":
                opened.append(at)
                mandatory = False
            elif part == "]]":
                self.free[opened.pop()].add(at)
            elif part.startswith("{{"):
                mandatory = False
                inner = part[2:-2]
                if inner.strip().isdigit():
                    exits = [at]
                    for _ in range(int(inner)):
                        new = self._state()
                        self.any[at] = new
                        exits.append(new)
                        at = new
                    end = self._state()
                    for x in exits:
                        self.free[x].add(end)
                    at = end
                else:
                    new = self._state()
                    for word in plain_words(inner.replace("|", " ").encode()):
                        self.words[at].setdefault(word, set()).add(new)
                    at = new
            else:
                for word in plain_words(part.encode()):
                    new = self._state()
                    self.words[at].setdefault(word, set()).add(new)
                    at = new
                    if mandatory:
                        first.append(word)
        self.end = at
        if not first:
            raise ValueError("a template begins with fixed words")
        self.anchor = b" " + b" ".join(first) + b" "

    def _state(self) -> int:
        self.words.append({})
        self.any.append(None)
        self.free.append(set())
        return len(self.words) - 1

    def _closed(self, states: set[int]) -> set[int]:
        stack, out = list(states), set(states)
        while stack:
            for x in self.free[stack.pop()]:
                if x not in out:
                    out.add(x)
                    stack.append(x)
        return out

    def match(self, words: list[bytes], start: int) -> int | None:
        """End of the longest accepted run of words from start, or None."""
        states, at, best = self._closed({0}), start, None
        while states:
            if self.end in states:
                best = at
            if at == len(words):
                break
            word, new = words[at], set()
            for s in states:
                new |= self.words[s].get(word, set())
                if self.any[s] is not None:
                    new.add(self.any[s])
            states, at = self._closed(new), at + 1
        return best


_COMPILED: list[tuple[str, Template]] = []


def _compiled() -> list[tuple[str, Template]]:
    if not _COMPILED:
        _COMPILED.extend((label, Template(x)) for label, all_ in TEMPLATES.items() for x in all_)
    return _COMPILED


def _places(joined: bytes, needle: bytes) -> list[int]:
    """Word numbers at which needle (with a blank at both ends) stands."""
    out, at, seen, words = [], joined.find(needle), 0, 0
    while at >= 0:
        words += joined.count(b" ", seen, at)
        seen = at
        out.append(words)
        at = joined.find(needle, at + 1)
    return out


def scan_licenses(text: bytes | None) -> dict:
    """Words, base places and labels of one text; see license_scan."""
    words = plain_words(text)
    joined = b" " + b" ".join(words) + b" "
    base, base_labels, covered = [], set(), []
    for phrase, label in PHRASES.items():
        found = _places(joined, b" " + phrase.encode() + b" ")
        if found:
            base += found
            base_labels.add(label)
            covered += [(x, x + phrase.count(" ") + 1) for x in found]
    labels = set(base_labels)
    for label, template in _compiled():
        for start in _places(joined, template.anchor):
            end = template.match(words, start)
            if end is not None:
                labels.add(label)
                covered.append((start, end))
    n, upto = 0, 0
    for start, end in sorted(covered):
        n += max(0, end - max(start, upto))
        upto = max(upto, end)
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(base, default=None),
        "last_word": max(base, default=None), "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(labels)), "score": n / len(words) if n else 0.0,
        "spans": [{"start": s, "end": e} for s, e in sorted(set(covered))],
    }


_FOUND = pa.struct(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
_SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<start:long,end:long>>"
)


def license_scan(text):
    """A struct column for each text.

    n_words; n_base, first_word and last_word: places of the fixed phrases (all, smallest and
    largest start; null without any); base_labels: their labels; labels: those and the labels of
    templates whose mandatory wording stands in the text, optional and replaceable regions aside;
    score: the share of the text's words that phrases or accepted templates cover; spans: their
    word spans. Null and empty texts have no words, no labels and score 0; a license that stands
    twice has its label once and both its spans; equal texts have equal results.
    """

    text_batches()

    @F.arrow_udf(_SCHEMA)
    def of(column: pa.Array) -> pa.Array:
        return pa.array([scan_licenses(x) for x in texts_of(column)], type=_FOUND)

    return of(text)
