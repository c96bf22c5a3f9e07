"""License scans through a positional rare-token index.

Template texts are cut into words. Document frequencies of the templates' words are counted over all
documents; each template is indexed under its ``rare`` words of highest inverse document frequency, as
postings (word -> template, position). A document's occurrences of indexed words vote for (template,
position in document - position in template); votes with nearby offsets are joined, and a template matches
where its mandatory key phrases stand, word by word, within the aligned window, which is wider than the template
by a fifth and 8 words at either end, for names and notices of other lengths. All occurrences are looked up;
there is no cap. A match that lies within the window of a longer matching template of another label is not
reported: it is a part of the other licence. The score is the largest share of a reported template's words found.

The base labels (phrases that stand consecutively) are found exactly, apart from the templates.

Defined cases: a null text is the empty text; no words give zero counts, null positions, empty labels and
score 0; ties in frequency are broken by the word; repeated rows are scanned each; extra columns are
ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole_text

# Base phrases and their labels.
BASE = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Openings, conditions and standard notices of public licences (label, text, mandatory key phrases).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify and or distribute this software"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["the apache license version 2"]),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["redistribution and use in source and binary forms", "neither the name of"]),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "this program is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl-3", "this library is licensed under the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license as published by the free software foundation either version 3 of the license"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3", ["gnu general public license as published by the free software foundation version 3"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license as published by the free software foundation either version 2 of the license"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2", ["gnu general public license as published by the free software foundation version 2"]),
    ("lgpl-3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu lesser general public license as published by the free software foundation either version 3 of the license"]),
    ("lgpl-3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation version 3", ["gnu lesser general public license as published by the free software foundation version 3"]),
    ("lgpl-2.1", "this library is licensed under the gnu lesser general public license version 2 1", ["gnu lesser general public license version 2 1"]),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ["gnu lesser general public license as published by the free software foundation either version 2 1 of the license"]),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation version 2 1", ["gnu lesser general public license as published by the free software foundation version 2 1"]),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license as published by the free software foundation either version 3 of the license"]),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3", ["gnu affero general public license as published by the free software foundation version 3"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license v 2 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0 international"]),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0 international"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0 1 0 universal", ["cc0 1 0 universal"]),
    ("mit", "spdx license identifier mit", ["spdx license identifier mit"]),
    ("isc", "spdx license identifier isc", ["spdx license identifier isc"]),
    ("apache-2", "spdx license identifier apache 2 0", ["spdx license identifier apache 2 0"]),
    ("bsd-2", "spdx license identifier bsd 2 clause", ["spdx license identifier bsd 2 clause"]),
    ("bsd-3", "spdx license identifier bsd 3 clause", ["spdx license identifier bsd 3 clause"]),
    ("gpl-2", "spdx license identifier gpl 2 0", ["spdx license identifier gpl 2 0"]),
    ("gpl-3", "spdx license identifier gpl 3 0", ["spdx license identifier gpl 3 0"]),
    ("lgpl-2.1", "spdx license identifier lgpl 2 1", ["spdx license identifier lgpl 2 1"]),
    ("lgpl-3", "spdx license identifier lgpl 3 0", ["spdx license identifier lgpl 3 0"]),
    ("agpl-3", "spdx license identifier agpl 3 0", ["spdx license identifier agpl 3 0"]),
    ("mpl-2", "spdx license identifier mpl 2 0", ["spdx license identifier mpl 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
]

#: Bytes that separate words: all ASCII but digits and lower-case letters (text is lower-cased first).
_SPACE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACE).split()


def places(words: list[bytes], phrase: list[bytes], at: dict[bytes, list[int]], lead: bytes) -> list[int]:
    """Starts of the phrase, from the places of its ``lead`` word."""
    shift, n = phrase.index(lead), len(phrase)
    return [i - shift for i in at.get(lead, ()) if i >= shift and words[i - shift : i - shift + n] == phrase]


class Index:
    """Postings of the templates' rarest words under given document frequencies."""

    def __init__(self, frequency: dict[bytes, int], n_docs: int, rare: int = 4):
        self.idf = lambda w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1))
        self.templates = [(label, text.encode().split(), [k.encode().split() for k in keys]) for label, text, keys in TEMPLATES]
        self.base = [(p.encode().split(), label) for p, label in BASE.items()]
        rank = lambda w: (-self.idf(w), w)
        self.leads = {tuple(p): min(p, key=rank) for p in [b for b, _ in self.base] + [k for _, _, ks in self.templates for k in ks]}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, keys) in enumerate(self.templates):
            # The key phrases' rarest words too: a notice of which little more is left still meets its template.
            chosen = set(sorted(set(words), key=rank)[:rare]) | {self.leads[tuple(k)] for k in keys}
            for i, w in enumerate(words):
                if w in chosen:
                    self.postings[w].append((t, i))
        self.wanted = set(self.postings) | set(self.leads.values())

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        at: dict[bytes, list[int]] = defaultdict(list)
        if self.wanted.intersection(words):
            wanted = self.wanted
            for i, w in enumerate(words):
                if w in wanted:
                    at[w].append(i)
        starts, base = [], set()
        for phrase, label in self.base:
            if got := places(words, phrase, at, self.leads[tuple(phrase)]):
                starts += got
                base.add(label)
        found = self._matches(words, at) if at else []
        inner = inside_longer(found)
        reported = [x for i, x in enumerate(found) if i not in inner]
        labels = base | {label for label, *_ in reported}
        score = max([1.0 if base else 0.0, *(min(1.0, share) for *_, share in reported)])
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    def _matches(self, words: list[bytes], at: dict[bytes, list[int]]) -> list[tuple[str, int, int, int, float]]:
        """(label, first and last place, template's length, share of its words) of each place a template matches; windows that touch are one, by the best share."""
        votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for w in at:
            for t, i in self.postings.get(w, ()):
                votes[t] += [(p - i, w) for p in at[w]]
        out = []
        for t, cast in votes.items():
            label, body, keys = self.templates[t]
            spots = [places(words, k, at, self.leads[tuple(k)]) for k in keys]
            if not all(spots):
                continue
            slack, mine, last = 8 + len(body) // 5, Counter(body), None
            for offset in dict.fromkeys(self._aligned(sorted(cast), slack)):
                low, high = max(0, offset - slack), offset + len(body) + slack
                stand = [[s for s in f[bisect_left(f, low) : bisect_right(f, high)]] for f in spots]
                if not all(stand):
                    continue
                share = sum((mine & Counter(words[low:high])).values()) / len(body)
                first = min(min(s) for s in stand)
                end = max(max(s) + len(k) for s, k in zip(stand, keys, strict=True))
                if last is not None and first <= out[last][2] + slack:
                    out[last] = (label, min(out[last][1], first), max(out[last][2], end), len(body), max(out[last][4], share))
                else:
                    last = len(out)
                    out.append((label, first, end, len(body), share))
        # A longer template's window reaches over the whole of its text, not only its key phrases.
        return [(label, first - n // 5 - 8, max(end, first + n) + n // 5 + 8, n, share) if n > 60 else (label, first, end, n, share) for label, first, end, n, share in out]

    @staticmethod
    def _aligned(cast: list[tuple[int, bytes]], slack: int):
        """The first offset and the one with the most distinct words of each run of votes that lie within ``slack`` of each other."""
        at = 0
        while at < len(cast):
            end = at
            while end + 1 < len(cast) and cast[end + 1][0] - cast[end][0] <= slack:
                end += 1
            words = defaultdict(set)
            for offset, word in cast[at : end + 1]:
                words[offset].add(word)
            yield cast[at][0]
            yield from sorted(words, key=lambda o: (-len(words[o]), o))[: 1 + (cast[end][0] - cast[at][0]) // max(1, slack)]
            at = end + 1


def inside_longer(found: list[tuple[str, int, int, int, float]]) -> set[int]:
    """Numbers of the (label, low, high, length, share) windows that lie within a window of another label and longer template.

    A sweep by start: of the windows that have begun, the farthest end of each template's length and label says it all, and
    there are few templates.
    """
    ends: dict[tuple[int, str], int] = {}
    out = set()
    order = sorted(range(len(found)), key=lambda i: (found[i][1], -found[i][3]))
    at = 0
    for place, i in enumerate(order):
        while at < len(order) and found[order[at]][1] <= found[i][1]:
            label, _, high, n, _ = found[order[at]]
            ends[n, label] = max(high, ends.get((n, label), high))
            at += 1
        label, _, high, n, _ = found[i]
        if any(m > n and other != label and end >= high for (m, other), end in ends.items()):
            out.add(i)
    return out


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """Documents with each word of the vocabulary, over all documents, and their number; one row per task and word."""

    def make():
        seen, n = Counter(), [0]

        def step(cols):
            for text in cols[0]:
                n[0] += 1
                seen.update(vocabulary.intersection(words_of(text)))
            return iter(())

        def finish():
            yield None, n[0]
            for w, k in seen.items():
                yield w, k

        step.finish = finish
        return step

    got = map_rows(docs.select("text"), "word binary, n long", make).groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in got if r["word"] is not None}, sum(r["n"] for r in got if r["word"] is None)


def scan_licenses(docs: DataFrame, rare: int = 4) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    vocabulary = {w for _, text, _ in TEMPLATES for w in text.encode().split()} | {w for p in BASE for w in p.encode().split()}
    frequency, n_docs = word_frequencies(docs, vocabulary)

    def make():
        index = Index(frequency, n_docs, rare)

        def step(cols):
            for doc_id, text in zip(*cols, strict=True):
                yield (doc_id, *index.scan(text))

        return step

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_rows(docs.select(F.col("doc_id").cast("long"), whole_text()), schema, make)
