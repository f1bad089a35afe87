"""License scans: sentences, lines, paragraphs and whole texts compared with licence templates by Dice's coefficient over word bigrams."""

from __future__ import annotations

import math
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and licence texts as their publishers word them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "This project is licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    "unlicense": 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>',
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.\n\nYou should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.\n\nYou should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "cc0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.\n\nYou should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.",
    "cc-by-4.0-link": "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
    "cc-by-sa-4.0-link": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.",
}
#: Bigrams from which a paragraph of a template is a template as well.
PART_BIGRAMS = 12
#: Templates are literals of the plan, so their number is bounded.
MOST_TEMPLATES = 1000


#: Stands between the sentences of a line in normalised texts.
STOP = "\x01"


def normalised(text: Column) -> Column:
    """Lower case; a blank after ``.``, ``!`` or ``?`` becomes ``STOP``, and every other run of characters but letters, digits and line ends one space."""
    stopped = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[.!?]+[ \t]+", STOP)
    return F.regexp_replace(stopped, rf"[^\p{{L}}\p{{N}}\n{STOP}]+", " ")


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def template_bigrams(text: str) -> list[str]:
    words = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def template_sets(templates: dict[str, str]) -> dict[tuple[str, int], list[str]]:
    """Bigrams by (license, part): part 0 is the whole template, and paragraphs of ``PART_BIGRAMS`` or more count from 1."""
    sets = {}
    for name, text in sorted(templates.items()):
        sets[name, 0] = template_bigrams(text)
        paragraphs = [template_bigrams(p) for p in text.split("\n\n")]
        if len(paragraphs) > 1:
            sets |= {(name, k): p for k, p in enumerate(paragraphs, 1) if len(p) >= PART_BIGRAMS}
    return {k: v for k, v in sets.items() if v}


def marking_words(sets: dict, ratio: float) -> list[str]:
    """Words and word pairs of which every unit that reaches the threshold holds at least one.

    Such a unit shares at least size/ratio bigrams with its template, so it has
    one of any size - ceil(size/ratio) + 1 of them.  These are marked by words
    of five letters or more, first by those that are long and mark many bigrams
    of all templates, and as a whole if both their words are shorter.
    """
    left = {k: (list(b), math.ceil(len(b) / ratio - 1e-9)) for k, b in sets.items()}
    marks: list[str] = []
    # A template is done when fewer bigrams are left than a unit must share.
    while left := {k: (b, need) for k, (b, need) in left.items() if len(b) >= need}:
        gain: dict[str, int] = {}
        for b, _ in left.values():
            for pair in b:
                for mark in {w for w in pair.split() if len(w) >= 5} or {pair}:
                    gain[mark] = gain.get(mark, 0) + 1
        best = max(sorted(gain), key=lambda m: (0 if " " in m else gain[m] * (len(m) - 4) ** 2, len(m)))
        marks.append(best)
        left = {k: ([p for p in b if p != best and best not in p.split()], need) for k, (b, need) in left.items()}
    return marks


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit that matches: id, ``unit`` (sentence, line, paragraph or text), ``unit_no``, ``sentence_no``, ``license``, ``part``, ``dice``.

    Units are all lines, the sentences of lines that have several (``unit_no``
    is then the line's, ``sentence_no`` the sentence's, else 0), the paragraphs
    of two or more lines (blank lines part them) and texts of two or more
    paragraphs.  Templates are compared whole (``part`` 0) and paragraph by
    paragraph (``part`` 1, 2, ...), so a licence among other paragraphs is
    found.  One that shares its paragraph with much other text is not.  Dice's
    coefficient of sets of sizes a and b is at most 2*min(a, b)/(a+b), so a unit
    is compared only with templates whose size lies within
    threshold/(2-threshold) of its own either way, and the overlap this asks for
    means that a unit without any of ``marking_words`` cannot match: such texts
    and units are dropped before they are split or their bigrams are built.
    Each unit reports its best template, of equals the one first in the
    alphabet, and there the first part.

    Null and empty texts and units of fewer than two words match nothing.
    Repeated rows each give their own result.  Extra columns are ignored.
    """
    sets = template_sets(TEMPLATES if templates is None else templates)
    if len(sets) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates and parts")
    ratio = (2 - threshold) / threshold
    marks = marking_words(sets, ratio)

    def has_mark(low: Column) -> Column:
        """Whether a mark stands in the text: its words, and for a pair then nothing but other characters between them."""
        each = [reduce(Column.__and__, [low.contains(w) for w in m.split()] + ([low.rlike(m.replace(" ", r"[^\p{L}\p{N}]+"))] if " " in m else [])) for m in marks]
        return reduce(Column.__or__, each, F.lit(False))

    def unit(kind: str, said: Column, i: Column, j: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("unit_no"), (F.lit(0) if j is None else j).cast("long").alias("sentence_no"), said.alias("said"))

    def sentences(line: Column, i: Column) -> Column:
        parts = F.split(line, STOP)
        return F.when(line.contains(STOP), F.transform(parts, lambda s, j: unit("sentence", s, i, j))).otherwise(F.array())

    # The lambda's variable holds the text in lower case, made once for all marks.
    norm = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("said")).filter(F.exists(F.array(F.lower("said")), has_mark)).select("doc_id", normalised(F.col("said")).alias("norm"))
    lines, paragraphs = F.split("norm", "\n"), F.split("norm", r"\n(?: ?\n)+")
    whole = F.when(F.size(paragraphs) > 1, F.array(F.col("norm"))).otherwise(F.array().cast("array<string>"))
    several = F.filter(F.transform(paragraphs, lambda x, i: unit("paragraph", x, i)), lambda u: u["said"].contains("\n"))
    every = F.concat(F.flatten(F.transform(lines, sentences)), F.transform(lines, lambda x, i: unit("line", x, i)), several, F.transform(whole, lambda x, i: unit("text", x, i)))
    units = norm.select("doc_id", F.explode(F.filter(every, lambda u: has_mark(u["said"]))).alias("u")).select("doc_id", "u.*")
    units = units.withColumn("words", F.trim(F.regexp_replace("said", f"[ \n{STOP}]+", " ")))

    def best_of(grams: Column) -> Column:
        n = F.size(grams)
        scores = [
            F.when(n.between(math.ceil(len(v) / ratio - 1e-9), math.floor(len(v) * ratio + 1e-9)), F.struct((2 * F.size(F.array_intersect(grams, F.array(*map(F.lit, v)))) / (n + len(v))).alias("dice"), F.lit(-i).alias("i")))
            for i, v in enumerate(sets.values())
        ]
        return F.array_max(F.filter(F.array(*scores), lambda s: s["dice"] >= threshold))

    # Again a lambda's variable, for bigrams that are built once and compared with all templates.
    best = F.element_at(F.transform(F.array(_bigrams(F.split("words", " "))), best_of), 1) if sets else F.lit(None).cast("struct<dice:double,i:int>")
    names = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(p).alias("part")) for k, p in sets]) if sets else F.array().cast("array<struct<license:string,part:int>>")
    found = units.select("doc_id", "unit", "unit_no", "sentence_no", best.alias("best")).filter("best is not null")
    name = F.element_at(names, 1 - F.col("best.i"))
    return found.select(F.col("doc_id").alias(id_col), "unit", "unit_no", "sentence_no", name["license"].alias("license"), name["part"].alias("part"), F.col("best.dice").alias("dice"))
