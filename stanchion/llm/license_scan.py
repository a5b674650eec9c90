"""License scan: a positional rare-token index over licence notices.

Each notice is a sequence of words, weighted by inverse document frequency (counted over the
whole corpus), and is reported where ENOUGH of its weight stands in place and each of its key
phrases stands in full within its reach. A notice is looked up by its rarest places: the
fewest that hold more than 1 - ENOUGH of its weight, so that no alignment with enough of it
misses them all. Every alignment where one of them stands is compared with the whole notice,
whatever else the document holds.

Besides, the base phrases are found wherever their words stand consecutively.

Defined results: null or blank text has no words, no labels, null positions and score 0;
every row gives one row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import LOWER, U64, chunks, small_batches, strings, trimmed, words_of

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, notice, key phrases that must stand in full. Public notices and paragraphs of public licences.
NOTICES: list[tuple[str, str, list[str]]] = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("bsd", "licensed under the bsd license", ["bsd license"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc", "4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa", "4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0-1.0", "creative commons cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    # paragraphs of whole licence texts and the headers that they ask for
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["without restriction"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses"]),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "version 2"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["copy of the mpl"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["anyone is free to copy"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["the software is provided as is", "and noninfringement"]),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ["the use or other dealings in the software"]),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ["by the copyright holders and contributors as is"]),
    ("bsd", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption", ["procurement of substitute goods or services"]),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ["the author disclaims all warranties"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["distributed on an as is basis", "warranties or conditions of any kind"]),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", ["each contributor hereby grants to you", "in source or object form"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["in the hope that it will be useful", "see the gnu general public license"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ["copy of the gnu general public license along with"]),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", ["copy of the gnu lesser general public license along with"]),
    ("mpl-2.0", "covered software is provided under this license on an as is basis without warranty of any kind either expressed implied or statutory", ["covered software is provided under this license"]),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ["must not be misrepresented as being the original software"]),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ["and changing it is allowed as long as the name is changed"]),
    ("cc0-1.0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
]

#: Titles and short names of public licences; each must stand in full.
TITLES = {
    "apache license version 2 0 january 2004": "apache-2.0",
    "the mit license mit": "mit",
    "isc license": "isc",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 2 clause simplified license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "bsd 3 clause new or revised license": "bsd-3-clause",
    "gnu general public license version 2 june 1991": "gpl-2.0",
    "gnu general public license version 3 29 june 2007": "gpl-3.0",
    "gnu lesser general public license version 2 1 february 1999": "lgpl",
    "gnu lesser general public license version 3 29 june 2007": "lgpl",
    "gnu affero general public license version 3 19 november 2007": "agpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license v 2 0": "epl-2.0",
    "artistic license 2 0": "artistic-2.0",
    "boost software license version 1 0 august 17th 2003": "bsl-1.0",
    "do what the fuck you want to public license": "wtfpl",
    "sil open font license version 1 1": "ofl-1.1",
    "open data commons open database license": "odbl",
    "european union public licence v 1 2": "eupl-1.2",
}
#: Identifiers of the SPDX list that files name in a line of their own.
SPDX = [
    "Apache-2.0", "MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "WTFPL", "Artistic-2.0", "OFL-1.1", "CC0-1.0",
]
#: The licences of Creative Commons, by their conditions and versions.
CC_KINDS, CC_VERSIONS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"], ["2.0", "2.5", "3.0", "4.0"]


def _plain(name: str) -> str:
    return name.lower().replace("-", " ").replace(".", " ")


NOTICES += [(label, title, [title]) for title, label in TITLES.items()]
NOTICES += [(name.lower(), f"spdx license identifier {_plain(name)}", [f"spdx license identifier {_plain(name)}"]) for name in SPDX]
for _kind in CC_KINDS:
    for _version in CC_VERSIONS:
        _name = f"CC-{_kind}-{_version}"
        NOTICES += [(_name.lower(), text, [text]) for text in (_plain(_name), f"spdx license identifier {_plain(_name)}")]
ENOUGH, SLACK = 0.6, 3
#: Alignments that are compared at once.
BLOCK = 1 << 16


def hash_words(text: str) -> np.ndarray:
    body = np.frombuffer(text.encode(), np.uint8)
    return words_of(LOWER[body], np.array([0, len(body)]), IS_WORD).hashes()


def _lowered(column: pa.Array):
    data, offsets = strings(column)
    for lo, _, body, offs in chunks(data, offsets):
        w = words_of(LOWER[body], offs, IS_WORD)
        yield lo, w, w.hashes()


class Index:
    """Hashes of notices, key phrases, base phrases, and of all words of notices."""

    def __init__(self, notices=NOTICES, base=BASE):
        self.notices = [(label, hash_words(text), [hash_words(k) for k in keys]) for label, text, keys in notices]
        self.base = [(label, hash_words(phrase)) for phrase, label in base.items()]
        self.words = np.unique(np.concatenate([h for _, h, _ in self.notices]))
        self.tail = np.zeros(1 << 16, bool)
        self.tail[(self.words & U64(0xFFFF)).astype(np.int64)] = True

    def occurrences(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of licence words, and which word stands there."""
        near = np.flatnonzero(self.tail[(h & U64(0xFFFF)).astype(np.uint16)])
        w = np.minimum(np.searchsorted(self.words, h[near]), len(self.words) - 1)
        on = self.words[w] == h[near]
        return near[on], w[on]


def document_counts(base: DataFrame, index: Index) -> tuple[int, np.ndarray]:
    """Over all rows: how many there are, and how many hold each licence word."""
    n = len(index.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(n, np.int64)
        for batch in batches:
            total += batch.num_rows
            for _, words, h in _lowered(batch.column(0)):
                at, w = index.occurrences(h)
                doc = np.searchsorted(words.first, at, "right") - 1
                df += np.bincount(np.unique(doc * n + w) % n, minlength=n)
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1)), pa.array(np.append(df[on], total))], ["word", "df"])

    rows = base.select("text").mapInArrow(trimmed(run), "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(n, np.int64)
    total = 0
    for r in rows:
        if r.word < 0:
            total = r.df
        else:
            df[r.word] = r.df
    return total, df


def weights(total: int, df: np.ndarray) -> np.ndarray:
    """Inverse document frequency, between log 2 for a word of every document and that of a word of none. It depends on shares
    only, so a corpus and many copies of it give the same labels."""
    return np.log(1 + (total + 1) / (df + 1))


def rarest(weight: np.ndarray) -> np.ndarray:
    """The fewest places of a notice without which less than ENOUGH of its weight is left."""
    order = np.argsort(-weight, kind="stable")
    left = weight.sum() - np.cumsum(weight[order])
    return order[: 1 + int(np.argmax(left < ENOUGH * weight.sum() * (1 - 1e-9)))]


def match(index: Index, idf: np.ndarray, h: np.ndarray, first: np.ndarray) -> list[list[tuple[str, int, int, float]]]:
    """Notices in each document: h are the word hashes of all, first[i]:first[i+1] those of document i."""
    best: list[dict[str, tuple[str, int, int, float]]] = [{} for _ in first[1:]]
    at, w = index.occurrences(h)
    order = np.argsort(w, kind="stable")
    at, c = at[order], np.searchsorted(w[order], np.arange(len(index.words) + 1))
    for label, notice, keys in index.notices:
        number = np.searchsorted(index.words, notice)
        weight, n = idf[number], len(notice)
        places = [(at[c[number[q]] : c[number[q] + 1]], q) for q in rarest(weight)]
        doc = np.concatenate([np.searchsorted(first, p, "right") - 1 for p, _ in places])
        # an alignment may begin before its document; the document tells it from that of the one before
        found = np.unique(np.stack((doc, np.concatenate([p - q for p, q in places])), 1), axis=0)
        for s in range(0, len(found), BLOCK):
            doc, d = found[s : s + BLOCK].T
            place = d[:, None] + np.arange(n)
            within = (place >= first[doc][:, None]) & (place < first[doc + 1][:, None])
            same = within & (h[np.clip(place, 0, len(h) - 1)] == notice)
            scores = (same * weight).sum(axis=1) / weight.sum()
            for i in np.flatnonzero(scores >= ENOUGH):
                f, e = int(first[doc[i]]), int(first[doc[i] + 1])
                lo, hi = max(f, int(d[i])), min(e, int(d[i]) + n)
                reach = h[max(f, int(d[i]) - SLACK) : min(e, int(d[i]) + n + SLACK)]
                if all(any((reach[j : j + len(k)] == k).all() for j in range(len(reach) - len(k) + 1)) for k in keys):
                    one, held = (label, lo - f, hi - f, round(float(scores[i]), 6)), best[doc[i]]
                    if label not in held or (-one[3], one[1]) < (-held[label][3], held[label][1]):
                        held[label] = one
    return [sorted(x.values()) for x in best]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, base_phrases=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans: the notices' labels, words and scores."""
    small_batches(docs.sparkSession)
    index = Index(notices, base_phrases)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total, df = document_counts(base, index)
    idf = weights(total, df)

    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, words, h in _lowered(batch.column(1)):
                n = words.counts()
                room = np.repeat(words.first[1:], n) - np.arange(len(h))
                count = np.zeros(len(n), np.int64)
                first, last = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), -1)
                labels: list[set] = [set() for _ in n]
                for label, k in index.base:
                    on = np.flatnonzero(h[: len(h) - len(k) + 1] == k[0]) if len(h) >= len(k) else np.empty(0, np.int64)
                    on = on[room[on] >= len(k)]
                    for i in range(1, len(k)):
                        on = on[h[on + i] == k[i]]
                    doc = np.searchsorted(words.first, on, "right") - 1
                    place = on - words.first[doc]
                    np.add.at(count, doc, 1)
                    np.minimum.at(first, doc, place)
                    np.maximum.at(last, doc, place)
                    for d in np.unique(doc):
                        labels[d].add(label)
                spans = match(index, idf, h, words.first)
                scores = [max((x[3] for x in s), default=1.0 if b else 0.0) for s, b in zip(spans, labels)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(n)),
                        pa.array(n, pa.int64()),
                        pa.array(count),
                        pa.array(first, pa.int64(), mask=count == 0),
                        pa.array(last, pa.int64(), mask=count == 0),
                        pa.array([",".join(sorted(x)) for x in labels]),
                        pa.array([",".join(sorted(x | {y[0] for y in s})) for x, s in zip(labels, spans)]),
                        pa.array(scores, pa.float64()),
                        pa.array([[dict(zip(("label", "start", "end", "score"), y)) for y in s] for s in spans], pa.list_(span)),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,score:double>>"
    return base.mapInArrow(trimmed(run), kind)
