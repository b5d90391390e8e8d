r"""Licence scan with a positional index of rare licence words.

Base labels come from three fixed phrases. The method adds labels: a template's words with the highest inverse document frequency are its
postings, and each of their occurrences in a file votes for the template at a relative position, its own place less the template's.
Places count licence words alone, words that stand in any template: comment marks and markup inside a notice don't move the rest of it.
Votes within a band of positions count together, one for each of the template's words. A template whose best band gathers
enough of its rare words is reported if its mandatory key phrase stands among the file's licence words. Frequencies only rank a template's
words: every template has postings over every table. Files without the rarest word of any key phrase need no votes. All of it
runs inside the scan, as built-in expressions: nothing is shuffled but one count per licence word.

A label stands for a licence and its version where the wording tells it (lgpl-2.1), else for the family (lgpl, bsd); a notice that tells
the version has both. Its score is the share of the best template's rare words that agree.

Defined results: a null text is empty (no word, no label, score 0); A-Z become a-z before words are taken; repeated rows are answered each; an empty table gives
no row; of bands with as many votes either counts, as only their number does; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Licence wordings, label -> (wording, mandatory key phrase), from the public licence texts and the notices they ask for.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "obtaining a copy of this software and associated documentation files"),
    "apache-2": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    "gpl-3": ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "gpl-2": ("this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "lgpl": ("under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    "agpl-3": ("under the terms of the gnu affero general public license as published by the free software foundation version 3", "gnu affero general public license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    "cc-by-nc": ("licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    "cc-by": ("licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    "epl-2": ("this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "eclipse public license v 2 0"),
    "bsd-3": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    "mpl-1.1": ("the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license", "mozilla public license version 1 1"),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages arising from the use of this software"),
    "bsl-1": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying documentation covered by this license"),
    "postgresql": ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without fee and without a written agreement is hereby granted"),
    "wtfpl": ("do what the fuck you want to public license", "do what the fuck you want to public license"),
    "artistic-2": ("the artistic license 2 0 copyright c 2000 2006 the perl foundation", "artistic license 2 0"),
    "epl-1": ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", "eclipse public license v1 0"),
    "cddl": ("the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license"),
    "eupl-1.2": ("licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", "licensed under the eupl version 1 2"),
    "ofl-1.1": ("this font software is licensed under the sil open font license version 1 1", "sil open font license version 1 1"),
}
_GPL = "gnu general public license"
_PUBLISHED = f"{_GPL} as published by the free software foundation"
_LESSER = "gnu {} general public license as published by the free software foundation"
#: Further wordings of a label: the licences' conditions, other notices, those of programs under one version only, and heads of licence texts.
MORE_WORDINGS = [
    (f"gpl-{v}", text, key)
    for v, head in ((3, "29 june 2007 copyright c 2007"), (2, "june 1991 copyright c 1989 1991"))
    for text, key in (
        (f"you can redistribute it and or modify it under the terms of the {_PUBLISHED} either version {v} of the license", f"{_PUBLISHED} either version {v} of the license"),
        (f"you can redistribute it and or modify it under the terms of the {_PUBLISHED} either version {v} or at your option any later version", f"{_PUBLISHED} either version {v} or at your option"),
        (f"you can redistribute it and or modify it under the terms of the {_PUBLISHED} version {v}", f"{_PUBLISHED} version {v}"),
        (f"under the terms of the {_GPL} version {v} as published by the free software foundation", f"{_GPL} version {v} as published by the free software foundation"),
        (f"{_GPL} version {v} {head} free software foundation inc", f"{_GPL} version {v} {head.split(' copyright')[0]}"),
    )
]
MORE_WORDINGS += [
    (label, f"you can redistribute it and or modify it under the terms of the {name} {version}", f"{name} {version}")
    for label, name, numbers in (("lgpl-2", _LESSER.format("library"), "2"), ("lgpl-2.1", _LESSER.format("lesser"), "2 1"), ("lgpl-3", _LESSER.format("lesser"), "3"))
    for version in (f"either version {numbers} of the license", f"version {numbers} of the license", f"either version {numbers} or at your option")
]
MORE_WORDINGS += [
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies or substantial portions"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "without warranties or conditions of any kind"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "redistributions in binary form must reproduce the above copyright notice"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "the origin of this software must not be misrepresented"),
    ("bsl-1", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    ("epl-2", "the terms of the eclipse public license 2 0 which is available at", "eclipse public license 2 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0", "eclipse public license v2 0"),
]
#: Variants of one family of licences: what follows "attribution", and the versions with their names.
_CC_KINDS, _CC_VERSIONS = {"by": "", "by-sa": "sharealike ", "by-nd": "noderivatives ", "by-nc": "noncommercial ", "by-nc-sa": "noncommercial sharealike ", "by-nc-nd": "noncommercial noderivatives "}, {"4 0": "4 0 international", "3 0": "3 0 unported"}
MORE_WORDINGS += [(f"cc-{kind}", f"licensed under a creative commons attribution {words}{full} license", f"creative commons attribution {words}{version}") for kind, words in _CC_KINDS.items() for version, full in _CC_VERSIONS.items()]
#: Identifiers of the Software Package Data Exchange, as words.
SPDX = {
    "mit": "mit", "apache-2": "apache 2 0", "gpl-2": "gpl 2 0", "gpl-3": "gpl 3 0", "lgpl-2": "lgpl 2 0", "lgpl-2.1": "lgpl 2 1", "lgpl-3": "lgpl 3 0", "agpl-3": "agpl 3 0", "bsd-2": "bsd 2 clause", "bsd-3": "bsd 3 clause",
    "mpl-2": "mpl 2 0", "mpl-1.1": "mpl 1 1", "isc": "isc", "unlicense": "unlicense", "cc0": "cc0 1 0", "epl-1": "epl 1 0", "epl-2": "epl 2 0", "zlib": "zlib", "bsl-1": "bsl 1 0", "postgresql": "postgresql", "wtfpl": "wtfpl",
    "artistic-2": "artistic 2 0", "cddl": "cddl 1 0", "eupl-1.2": "eupl 1 2", "ofl-1.1": "ofl 1 1",
} | {f"cc-{kind}": f"cc {kind.replace('-', ' ')} 4 0" for kind in _CC_KINDS}
MORE_WORDINGS += [(label, f"spdx license identifier {words}", f"spdx license identifier {words}") for label, words in SPDX.items()]
#: (label, wording, key phrase) of every wording.
WORDINGS = [*((label, *pair) for label, pair in sorted(TEMPLATES.items())), *MORE_WORDINGS]
#: Distinct words of a template that have postings, its rarest; share of them that must agree.
RARE_WORDS, MIN_SHARE = 16, 0.6
#: Votes agree within a band of twice so many relative positions; bands begin at each multiple of it, so that a drift of so many is always allowed.
BAND = 4
#: A vote is packed as template, band and the word's first place in the template: no template has 2**9 words, no text 2**31.
_PLACES, _BANDS = 1 << 9, 1 << 31


def vocabulary() -> list[str]:
    return sorted({w for _, text, _ in WORDINGS for w in text.split()})


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lower(text: str) -> Column:
    """The text with A-Z as a-z; lower() does no more than that to ASCII and is much faster than translate()."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _UPPER.lower()))


def _words(text: str = "text") -> Column:
    """The words joined by single spaces, with a space at either end; two spaces for no words. Nothing in it is computed twice."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(_lower(text), NO_WORD, " ")), F.lit(" "))


def word_idf(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word over all documents: as many rows as the templates have words."""
    words = vocabulary()
    known = F.array(*map(F.lit, words))
    seen = docs.select(F.explode(F.array_intersect(F.split(_lower("text"), NO_WORD), known)).alias("word"))
    n = docs.select(F.count(F.lit(1))).first()[0]
    found = {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) for w in words}


def _index(idf: dict[str, float]) -> tuple[dict[str, list[int]], list[int]]:
    """Postings ((template * _PLACES + place) * _PLACES + first place of the word) of rare words, and how many rare words each template, one of WORDINGS, has."""
    postings: dict[str, list[int]] = {}
    sizes = []
    for k, (_, text, _) in enumerate(WORDINGS):
        words = text.split()
        rare = set(sorted(set(words), key=lambda w: (-idf[w], w))[:RARE_WORDS])
        sizes.append(len(rare))
        for i, w in enumerate(words):
            if w in rare:
                postings.setdefault(w, []).append((k * _PLACES + i) * _PLACES + words.index(w))
    return postings, sizes


def _anchors(idf: dict[str, float]) -> list[str]:
    """The rarest word of each key phrase."""
    return sorted({max(key.split(), key=lambda w: (idf[w], w)) for _, _, key in WORDINGS})


def _any(flat: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | flat.contains(f" {phrase} ")
    return found


def _starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def stands(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + k) == p)
        return found

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), stands)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, idf: dict[str, float] | None = None) -> DataFrame:
    """One row per document with its words, base phrase places, labels and score."""
    idf = word_idf(docs) if idf is None else idf
    postings, sizes = _index(idf)
    rows = docs.select("doc_id", _words().alias("_flat"))
    flat = F.col("_flat")
    n_words = F.when(flat == "  ", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) - 1).cast("long")

    # base phrases: a plain search settles most documents; word places only where one is found
    may = _any(flat, list(BASE))
    found = lambda words: F.struct(*[_starts(words, phrase).alias(label) for phrase, label in BASE.items()])
    nothing = F.struct(*[F.array().cast("array<int>").alias(label) for label in BASE.values()])
    base = F.when(may, _let(F.split(F.trim(flat), " "), found)).otherwise(nothing)

    rare, known = sorted(postings), vocabulary()
    zero = F.array(*[F.lit(0) for _ in WORDINGS])
    needed = F.array(*[F.lit(math.ceil(MIN_SHARE * n)) for n in sizes])

    def votes(words: Column) -> Column:
        """(template, band, word) for each occurrence of a rare licence word and each of the two bands it lies in."""
        lists = F.create_map(*[x for w in rare for x in (F.lit(w), F.array(*[F.lit(v).cast("long") for v in postings[w]]))])
        band = lambda p, i: F.floor((i - F.floor(p / _PLACES) % _PLACES + _PLACES) / BAND)
        packed = lambda p, b: (F.floor(p / (_PLACES * _PLACES)) * _BANDS + b) * _PLACES + p % _PLACES
        both = lambda p, i: F.array(packed(p, band(p, i)), packed(p, band(p, i) - 1))
        # a map is searched one key after the other, so a set tells first whether a word is in it
        by_place = F.transform(words, lambda w, i: F.when(w.isin(rare), F.flatten(F.transform(F.try_element_at(lists, w), lambda p: both(p, i.cast("long"))))))
        return F.flatten(F.filter(by_place, lambda x: x.isNotNull()))

    def best(votes_: Column) -> Column:
        """The most votes of one band for each template, where they are enough: votes of a band stand side by side once sorted."""
        group = lambda v: F.floor(v / _PLACES)
        run = lambda a, v: F.when(a["g"] == group(v), a["n"] + 1).otherwise(1)
        template = lambda v: F.floor(v / (_PLACES * _BANDS)).cast("int")
        raised = lambda a, v: F.when(run(a, v) >= F.get(needed, template(v)), _raise(a["best"], template(v), run(a, v))).otherwise(a["best"])
        step = lambda a, v: F.struct(group(v).alias("g"), run(a, v).alias("n"), raised(a, v).alias("best"))
        start = F.struct(F.lit(None).cast("bigint").alias("g"), F.lit(0).alias("n"), zero.alias("best"))
        return F.aggregate(F.array_sort(F.array_distinct(votes_)), start, step, lambda a: a["best"])

    # a file without the rarest word of any key phrase has none; of the others the licence words are taken, and few hold a phrase
    licence = F.when(_any(flat, _anchors(idf)), F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.trim(flat), " "), lambda w: w.isin(known)), " "), F.lit(" "))).otherwise("  ")
    rows = rows.select("doc_id", "_flat", n_words.alias("n_words"), base.alias("_base"), licence.alias("_licence"))
    keyed = _any(F.col("_licence"), [key for _, _, key in WORDINGS])
    counted = F.when(keyed, _let(F.split(F.trim("_licence"), " "), lambda words: best(votes(words)))).otherwise(zero)
    rows = rows.select("doc_id", "n_words", "_base", "_licence", counted.alias("_best"))
    places = F.flatten(F.array(*[F.col("_base")[label] for label in BASE.values()]))
    out = rows.select("doc_id", "n_words", places.alias("_places"), "_base", "_best", "_licence")
    labelled = lambda conditions: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(x)) for x, c in conditions]), lambda x: x.isNotNull()))), ",")
    base_hits = [(label, F.size(F.col("_base")[label]) > 0) for label in BASE.values()]
    share = [F.col("_best")[k] / F.lit(float(n)) for k, n in enumerate(sizes)]
    hits = [(label, F.when(s >= MIN_SHARE, F.col("_licence").contains(f" {key} ")).otherwise(False)) for s, (label, _, key) in zip(share, WORDINGS, strict=True)]
    score = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(c, F.lit(1.0)) for _, c in base_hits], *[F.when(c, F.least(F.lit(1.0), s)) for s, (_, c) in zip(share, hits, strict=True)])
    return out.select(
        "doc_id",
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        labelled(base_hits).alias("base_labels"),
        labelled(base_hits + hits).alias("labels"),
        score.alias("score"),
    )


def _raise(best: Column, template: Column, n: Column) -> Column:
    """`best` with the entry of a template raised to n."""
    return F.transform(best, lambda b, i: F.when((i == template) & (n > b), n).otherwise(b))


def place(text: str | None, phrase: str) -> list[int]:
    """Brute force for tests: where the phrase's words stand in the text."""
    words = [w for w in re.split(NO_WORD, (text or "").lower()) if w]
    parts = phrase.split()
    return [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
