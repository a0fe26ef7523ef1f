"""Licence recognition by sentences and ordered rules; built-in functions only.

A text is split into pieces at line and sentence ends, and runs of pieces are normalised
and looked up among known licence sentences, the longest first, as sentences may be
wrapped or hold marks that end others; what is found is a sequence of sentence identifiers.  Rules, in
order of precedence, are sequences of identifiers; a rule that matches takes its
identifiers out of the sequence, so that a weaker rule doesn't match them again.
Both tables are fixed, hence literals of the plan: a document is judged in its own
row, without a shuffle.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

#: Names by which a sentence refers to a licence, in normal form.
NAMES = {
    "mit": ("mit license", "mit licence", "mit"),
    "apache2": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache-2.0"),
    "gpl2": ("gnu general public license version 2", "gnu gpl version 2", "gplv2", "gpl-2.0"),
    "gpl3": ("gnu general public license version 3", "gnu gpl version 3", "gplv3", "gpl-3.0"),
    "gpl2+": ("gnu general public license version 2 or any later version", "gnu general public license version 2 or later", "gpl-2.0-or-later"),
    "gpl3+": ("gnu general public license version 3 or any later version", "gnu general public license version 3 or later", "gpl-3.0-or-later"),
    "lgpl21": ("gnu lesser general public license version 2.1", "lgpl-2.1"),
    "lgpl3": ("gnu lesser general public license version 3", "lgpl-3.0"),
    "agpl3": ("gnu affero general public license version 3", "agpl-3.0"),
    "bsd2": ("bsd 2-clause license", "simplified bsd license", "bsd-2-clause"),
    "bsd3": ("bsd 3-clause license", "new bsd license", "bsd-3-clause"),
    "isc": ("isc license", "isc"),
    "mpl2": ("mozilla public license version 2.0", "mozilla public license 2.0", "mpl-2.0"),
    "cc0": ("cc0 1.0", "cc0 1.0 universal", "cc0-1.0"),
    "ccby4": ("cc by 4.0", "creative commons attribution 4.0 international license", "cc-by-4.0"),
    "ccbysa4": ("cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license", "cc-by-sa-4.0"),
    "ccbync4": ("cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international license", "cc-by-nc-4.0"),
    "ccbynd4": ("cc by-nd 4.0", "creative commons attribution-noderivatives 4.0 international license", "cc-by-nd-4.0"),
}
#: Public identifiers of the licences.
LICENCES = {
    "mit": "MIT", "apache2": "Apache-2.0", "gpl2": "GPL-2.0-only", "gpl3": "GPL-3.0-only", "gpl2+": "GPL-2.0-or-later",
    "gpl3+": "GPL-3.0-or-later", "lgpl21": "LGPL-2.1-only", "lgpl3": "LGPL-3.0-only", "agpl3": "AGPL-3.0-only",
    "bsd2": "BSD-2-Clause", "bsd3": "BSD-3-Clause", "isc": "ISC", "mpl2": "MPL-2.0", "cc0": "CC0-1.0", "ccby4": "CC-BY-4.0",
    "ccbysa4": "CC-BY-SA-4.0", "ccbync4": "CC-BY-NC-4.0", "ccbynd4": "CC-BY-ND-4.0",
}
_SUBJECTS = ("", "this work is ", "this software is ", "this project is ", "this file is ", "this code is ", "this program is ", "the software is ")
_VERBS = ("licensed under ", "released under ", "distributed under ", "available under ", "provided under ", "made available under ")
#: Sentences of licence texts and notices, in normal form, by identifier.
SENTENCES = {
    "T_MIT_GRANT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "T_MIT_NOTICE": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "T_AS_IS": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "T_BSD_GRANT": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "T_BSD_SOURCE": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "T_BSD_BINARY": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "T_BSD_NAME": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "T_ISC_GRANT": "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "T_APACHE_USE": "you may not use this file except in compliance with the license",
    "T_APACHE_COPY": "you may obtain a copy of the license at",
    "T_GPL_FREE": "this program is free software",
    "T_GPL_TERMS2": "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "T_GPL_TERMS3": "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "T_LIBRARY_FREE": "this library is free software",
    "T_LGPL_TERMS21": "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "T_LGPL_TERMS3": "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "T_AGPL_TERMS3": "you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "T_MPL": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "T_UNLICENSE": "this is free and unencumbered software released into the public domain",
}
#: Ordered rules: licence and the identifiers that follow each other; before these come no weaker ones.
TEXT_RULES = (
    ("MIT", ("T_MIT_GRANT", "T_MIT_NOTICE", "T_AS_IS")),
    ("MIT", ("T_MIT_GRANT", "T_MIT_NOTICE")),
    ("MIT", ("T_MIT_GRANT",)),
    ("BSD-3-Clause", ("T_BSD_GRANT", "T_BSD_SOURCE", "T_BSD_BINARY", "T_BSD_NAME")),
    ("BSD-2-Clause", ("T_BSD_GRANT", "T_BSD_SOURCE", "T_BSD_BINARY")),
    ("ISC", ("T_ISC_GRANT",)),
    ("Apache-2.0", ("G_apache2", "T_APACHE_USE", "T_APACHE_COPY")),
    ("Apache-2.0", ("G_apache2", "T_APACHE_USE")),
    ("GPL-2.0-or-later", ("T_GPL_FREE", "T_GPL_TERMS2")),
    ("GPL-3.0-or-later", ("T_GPL_FREE", "T_GPL_TERMS3")),
    ("LGPL-2.1-or-later", ("T_LIBRARY_FREE", "T_LGPL_TERMS21")),
    ("LGPL-2.1-or-later", ("T_GPL_FREE", "T_LGPL_TERMS21")),
    ("LGPL-3.0-or-later", ("T_LIBRARY_FREE", "T_LGPL_TERMS3")),
    ("LGPL-3.0-or-later", ("T_GPL_FREE", "T_LGPL_TERMS3")),
    ("AGPL-3.0-or-later", ("T_GPL_FREE", "T_AGPL_TERMS3")),
    ("MPL-2.0", ("T_MPL",)),
    ("Unlicense", ("T_UNLICENSE",)),
)
RULES = (*TEXT_RULES, *((LICENCES[k], (f"G_{k}",)) for k in NAMES))
#: Every known sentence has one of these, so that other texts needn't be split.
MARKER = r"(?i)licen[sc]e|permission|redistribut|software|spdx|available under|released under|distributed under|provided under"
SPLIT = r"(?<=[.;:!?])\s+|\n+"
NOT_WORD = r"[^a-z0-9.+/-]+"
#: What may stand before a word or after it is dropped: bullets, points at the end.
#: An owner's name, which differs from text to text, and what stands for it in the table.
OWNER, ANY_OWNER = r"neither the name of (?:[^ ]+ ){1,16}?nor the names? of (?:[^ ]+ ){1,8}?contributors", "neither the name of the copyright holder nor the names of its contributors"
OWNED = "neither the name of "
EDGES = r"(^| )[.+/-]+(?= |$)|[./-]+(?= |$)"


def known() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    out = {}
    for k, names in NAMES.items():
        for name in names:
            for subject, verb, the in product(_SUBJECTS, _VERBS, ("", "the ")):
                out[subject + verb + the + name] = f"G_{k}"
            out[f"spdx-license-identifier {name}"] = f"G_{k}"
        out[f"spdx-license-identifier {LICENCES[k].lower()}"] = f"G_{k}"
    # The head of the official notice: 'Licensed under the Apache License, Version 2.0 (the "License")'.
    out["licensed under the apache license version 2.0 the license"] = "G_apache2"
    return out | {v: k for k, v in SENTENCES.items()}


def normal(sentence: Column) -> Column:
    """A-Z lowered; other than letters, digits and ``. + - /`` one space; edges trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(ascii_lower(sentence), NOT_WORD, " "), EDGES, " "), " +", " "))


def python_normal(sentence: str) -> str:
    """``normal`` for one string, for tests and for checking the tables."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in sentence)
    return re.sub(" +", " ", re.sub(EDGES, " ", re.sub(NOT_WORD, " ", low))).strip(" ")


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    by_length: dict[int, dict[str, str]] = {}
    for sentence, name in known().items():
        by_length.setdefault(len(sentence), {})[sentence] = name
    # Only sentences of the same length are compared.
    table = F.create_map(*(x for n, group in sorted(by_length.items()) for x in (F.lit(n), F.create_map(*(F.lit(y) for pair in group.items() for y in pair)))))
    none = F.array().cast("array<string>")
    starts, most = _starts(), _most()

    def look_up(x: Column) -> Column:
        named = F.when(x.startswith(OWNED), F.regexp_replace(x, OWNER, ANY_OWNER)).otherwise(x)
        return let(named, lambda y: F.try_element_at(F.try_element_at(table, F.length(y)), y))

    def of(pieces: Column) -> Column:
        def longest(i: Column) -> Column:
            """The identifier of the longest known sentence from piece i on, and how many pieces it takes."""
            runs = F.transform(F.sequence(F.lit(1), F.least(F.size(pieces) - i, F.lit(most))), lambda k: F.struct(k.alias("n"), look_up(F.array_join(F.slice(pieces, i + 1, k), " ")).alias("id")))
            return F.element_at(F.concat(F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("id"))), F.filter(runs, lambda r: r["id"].isNotNull())), -1)

        begins = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.array_join(F.slice(pieces, i + 1, 2), " ").rlike(starts))
        found = F.filter(F.transform(begins, lambda i: F.struct(i.alias("at"), longest(i).alias("hit"))), lambda x: x["hit"]["n"] > 0)
        # What lies inside a sentence that was found isn't found again.
        start = F.struct(F.lit(0).alias("next"), none.alias("ids"))
        ids = F.aggregate(
            found,
            start,
            lambda acc, x: F.when(x["at"] >= acc["next"], F.struct((x["at"] + x["hit"]["n"]).alias("next"), F.array_append(acc["ids"], x["hit"]["id"]).alias("ids"))).otherwise(acc),
            lambda acc: acc["ids"],
        )
        return F.when(F.size(pieces) > 0, ids).otherwise(none)

    pieces = F.filter(F.transform(F.split(text, SPLIT), normal), lambda x: x != "")
    return F.when(text.rlike(MARKER), let(pieces, of)).otherwise(none)


def _starts() -> str:
    """A pattern of the first word of known sentences, and of the first two where there are two."""
    first = {tuple(s.split(" ")[:2]) for s in known()}
    return "^(?:" + "|".join(re.escape(" ".join(x)) for x in sorted(first)) + ")(?: |$)"


def _most() -> int:
    """Words, and so pieces at most, of the longest known sentence."""
    return max(s.count(" ") for s in known()) + 1


def licences(sequence: Column) -> Column:
    """Sorted distinct licences of an identifier sequence."""
    def step(acc: Column, rule: Column) -> Column:
        has = F.contains(acc["rest"], rule["ids"])
        return F.struct(
            F.when(has, F.replace(acc["rest"], rule["ids"], F.lit(" # "))).otherwise(acc["rest"]).alias("rest"),
            F.when(has, F.array_append(acc["found"], rule["licence"])).otherwise(acc["found"]).alias("found"),
        )

    rules = F.array(*(F.struct(F.lit(name).alias("licence"), F.lit(" " + "  ".join(ids) + " ").alias("ids")) for name, ids in RULES))
    # A space on both sides of each keeps neighbours apart when one of them is taken out.
    start = F.struct(
        F.array_join(F.transform(sequence, lambda x: F.concat(F.lit(" "), x, F.lit(" "))), "").alias("rest"), F.array().cast("array<string>").alias("found")
    )
    matched = F.array_sort(F.array_distinct(F.aggregate(rules, start, step, lambda acc: acc["found"])))
    return F.when(F.size(sequence) == 0, F.array().cast("array<string>")).otherwise(matched)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences) for each row of ``docs(doc_id, text)``.

    sentence_ids and licences are joined by commas, empty if none.  A null or empty
    text has none; texts are read whole, however long; of rules that match alike the
    first in order counts; repeated rows are each scanned; other columns are ignored;
    an empty table gives no rows.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identifiers(F.coalesce("text", F.lit(""))).alias("ids"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(licences(F.col("ids")), ",").alias("licences")
    )


def python_scan(text: str | None) -> tuple[int, str, str]:
    """``scan`` of one text, plainly; the tests hold the query against it."""
    table = known()
    pieces = [n for n in (python_normal(x) for x in re.split(SPLIT, text or "", flags=re.ASCII)) if n]
    ids, at, most = [], 0, _most()

    def joined(k: int) -> str:
        return re.sub(OWNER, ANY_OWNER, " ".join(pieces[at : at + k]))

    while at < len(pieces):
        n = max((k for k in range(1, most + 1) if at + k <= len(pieces) and joined(k) in table), default=0)
        if n:
            ids.append(table[joined(n)])
        at += n or 1
    rest, found = list(ids), set()
    for name, rule in RULES:
        at = 0
        while at + len(rule) <= len(rest):
            if tuple(rest[at : at + len(rule)]) == rule:
                found.add(name)
                rest[at : at + len(rule)] = ["#"]
            at += 1
    return len(ids), ",".join(ids), ",".join(sorted(found))
