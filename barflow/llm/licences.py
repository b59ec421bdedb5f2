"""Licence texts by their sentences, in DataFrame functions only.

Texts are cut into sentences, sentences are normalised and mapped to the identifiers of known licence sentences, and the sequence of
identifiers is matched against ordered rules. A rule that matches takes its sentences away, so that a short rule never claims part of
what a longer one has explained. No row leaves its partition: the scan needs no shuffle.

Lines of a paragraph that were wrapped are read as one where together they are a known sentence; all other lines stay sentences of
their own, so a notice that stands in a line of its own is found in any surroundings.

Defined cases: null and empty texts have no sentences; rows are scanned one by one, so repeated rows and null keys give rows of their own;
an empty table gives an empty result; only the named columns are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, as they are normalised (lower case, one blank between runs of letters and digits).
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "you may not use this file except in compliance with the license",
    3: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    4: "released under the mit license",
    5: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
       "software to deal in the software without restriction",
    6: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    7: "this work is licensed under the gnu general public license version 3",
    8: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
       "the free software foundation",
    9: "this program is distributed in the hope that it will be useful but without any warranty",
    10: "licensed under cc by nc 4 0",
    11: "licensed under cc by 4 0",
    12: "licensed under cc by sa 4 0",
    13: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    14: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    15: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
    16: "all rights reserved",
}

SENTENCES |= {
    17: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
        "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following "
        "conditions",
    18: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement",
    19: "licensed under the apache license version 2 0 the license",
    20: "you may obtain a copy of the license at",
    21: "http www apache org licenses license 2 0",
    22: "https www apache org licenses license 2 0",
    23: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    24: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
    25: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited "
        "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    26: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies",
    27: "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies",
    28: "this source code form is subject to the terms of the mozilla public license v",
    29: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    30: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    31: "apache license version 2 0 january 2004",
    32: "mozilla public license version 2 0",
    33: "mit license",
    34: "the mit license",
    35: "the mit license mit",
    36: "bsd 2 clause license",
    37: "bsd 3 clause license",
    38: "isc license",
    39: "you may obtain a copy of the license at https www apache org licenses license 2 0",
}

# Licences of the free software foundation, (name, kind, words of the notice, headings).
GNU = (
    ("GPL-2.0", "copyleft", "general public license", "version 2", "version 2 june 1991"),
    ("GPL-3.0", "copyleft", "general public license", "version 3", "version 3 29 june 2007"),
    ("LGPL-2.1", "copyleft", "lesser general public license", "version 2 1", "version 2 1 february 1999"),
    ("LGPL-3.0", "copyleft", "lesser general public license", "version 3", "version 3 29 june 2007"),
    ("AGPL-3.0", "copyleft", "affero general public license", "version 3", "version 3 19 november 2007"),
)


def _gnu() -> tuple[dict[int, str], tuple]:
    """Sentences and rules of the notices in ``GNU``: with a colon or a semicolon after "free software", with a comma or a semicolon before
    the version, that version only or any later one, for a program or a library."""
    table, known, rules = {}, {v: k for k, v in SENTENCES.items()}, {}

    def number(sentence):
        return known.setdefault(sentence, len(known) + 1)
    for name, kind, words, version, heading in GNU:
        terms = f"you can redistribute it and or modify it under the terms of the gnu {words} as published by the free software foundation"
        for what in ("program", "library"):
            free = f"this {what} is free software"
            for end in (f"either {version} of the license or at your option any later version", f"{version} of the license"):
                for ids in ((f"{free} {terms} {end}",), (f"{free} {terms}", end), (free, f"{terms} {end}"), (free, terms, end)):
                    rules[tuple(map(number, ids))] = (name, kind)
        rules[(number(f"gnu {words} {heading}"),)] = (name, kind)
    table = {k: v for v, k in known.items() if k not in SENTENCES}
    return table, tuple((*v, k) for k, v in sorted(rules.items(), key=lambda x: (-len(x[0]), x[0])))


_GNU_SENTENCES, _GNU_RULES = _gnu()
SENTENCES |= _GNU_SENTENCES

# Whole notices, before the shorter ones; 0 stands for one unknown sentence, such as the number of a clause.
WHOLE = (
    ("MIT", "permissive", (17, 6, 18)),
    ("MIT", "permissive", (17, 6)),
    ("MIT", "permissive", (17,)),
    ("Apache-2.0", "permissive", (19, 2, 20, 21)),
    ("Apache-2.0", "permissive", (19, 2, 20, 22)),
    ("Apache-2.0", "permissive", (19, 2, 3)),
    ("Apache-2.0", "permissive", (19, 2, 39)),
    ("Apache-2.0", "permissive", (19, 2)),
    ("Apache-2.0", "permissive", (19,)),
    ("BSD-3-Clause", "permissive", (13, 0, 14, 0, 23, 0, 24)),
    ("BSD-3-Clause", "permissive", (13, 14, 23, 24)),
    ("BSD-2-Clause", "permissive", (13, 0, 14, 0, 23, 25)),
    ("BSD-2-Clause", "permissive", (13, 14, 23, 25)),
    ("ISC", "permissive", (26,)),
    ("ISC", "permissive", (27,)),
)

# Rules in the order they are tried, (licence, kind, sentence identifiers that follow each other). "All rights reserved" before
# the words of a public licence is part of its copyright line.
RULES = (
    ("Apache-2.0", "permissive", (1, 2, 3)),
    ("Apache-2.0", "permissive", (1, 2)),
    ("MIT", "permissive", (5, 6)),
    ("GPL", "copyleft", (8, 9)),
    ("BSD-2-Clause", "permissive", (13, 14, 15)),
    ("Apache-2.0", "permissive", (1,)),
    ("MIT", "permissive", (4,)),
    *((a, k, (16, *ids)) for a, k, ids in WHOLE),
    *WHOLE,
    *_GNU_RULES,
    ("MPL-2.0", "copyleft", (28, 0, 29)),
    ("MPL-2.0", "copyleft", (28, 0, 30)),
    ("MPL", "copyleft", (28,)),
    ("Apache-2.0", "permissive", (31,)),
    ("MPL-2.0", "copyleft", (32,)),
    ("MIT", "permissive", (33,)),
    ("MIT", "permissive", (34,)),
    ("MIT", "permissive", (35,)),
    ("BSD-2-Clause", "permissive", (36,)),
    ("BSD-3-Clause", "permissive", (37,)),
    ("ISC", "permissive", (38,)),
    ("MIT", "permissive", (5,)),
    ("GPL-3.0", "copyleft", (7,)),
    ("GPL", "copyleft", (8,)),
    ("CC-BY-NC-4.0", "noncommercial", (10,)),
    ("CC-BY-SA-4.0", "copyleft", (12,)),
    ("CC-BY-4.0", "permissive", (11,)),
    ("BSD", "permissive", (16, 13)),
    ("BSD", "permissive", (13,)),
    ("Proprietary", "proprietary", (16,)),
)


def lines(text: Column) -> Column:
    """Normalised pieces in order, cut at line ends and after ``.!?;`` with white space: their text, and whether a sentence or paragraph ends."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "([.!?;])[\\x20\\x09-\\x0D]+", "$1\u0001\n"), "\n")
    plain = F.transform(cut, lambda s: F.struct(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")).alias("s"), F.endswith(s, F.lit("\u0001")).alias("end")))
    return F.transform(plain, lambda p: F.struct(p["s"].alias("s"), (p["end"] | (p["s"] == "")).alias("end")))


def known_ids(found: Column, table: dict[int, str] = SENTENCES) -> Column:
    """Identifier of each sentence, 0 for an unknown one. Sentences longer than every known one are not looked up."""
    longest = max(map(len, table.values()))
    known = F.create_map(*[F.lit(x) for k, s in table.items() for x in (s, k)])
    return F.transform(found, lambda s: F.when(F.octet_length(s) <= longest, F.coalesce(F.try_element_at(known, s), F.lit(0))).otherwise(0))


def joined(pieces: Column, table: dict[int, str] = SENTENCES) -> Column:
    """Sentences: the pieces, where those lines of a paragraph that make up a known sentence are one; longer sentences claim their lines first."""
    whole = F.array_join(F.transform(pieces, lambda p: F.concat(p["s"], F.when(p["end"], "\n").otherwise("\r"))), "")
    wanted = F.array(*[F.struct(F.lit(s).alias("s"), F.lit("(?<![^\n\r])" + s.replace(" ", "[ \r]") + "(?![^\n\r])").alias("lines"))
                       for s in sorted(table.values(), key=len, reverse=True)])

    def join(t):
        # Only sentences that the text holds once its lines are joined are looked for by their pattern.
        held = F.filter(wanted, lambda w: F.contains(t["flat"], w["s"]))
        return F.when(F.contains(t["whole"], F.lit("\r")), F.aggregate(held, t["whole"], lambda x, w: F.regexp_replace(x, w["lines"], w["s"]))).otherwise(t["whole"])
    once = F.transform(F.array(whole), lambda x: F.struct(x.alias("whole"), F.translate(x, "\r", " ").alias("flat")))  # a lambda's argument is computed once
    return F.filter(F.split(F.transform(once, join)[0], "[\n\r]"), lambda s: s != "")


def _tags(ids) -> str:
    return "".join(f"<{i}>" for i in ids)


def matched(ids: Column, rules=RULES) -> Column:
    """Numbers (from 1) of the rules that match, in their order, each after the sentences of those before were taken away."""
    start = F.struct(F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "").alias("rest"),
                     F.array().cast("array<int>").alias("found"))
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(_tags(r[2])).alias("tags")) for n, r in enumerate(rules, 1)])

    def apply(state, rule):
        return F.when(F.contains(state["rest"], rule["tags"]), F.struct(
            F.replace(state["rest"], rule["tags"], F.lit("<0>")).alias("rest"),
            F.concat(state["found"], F.array(rule["n"])).alias("found"))).otherwise(state)
    return F.aggregate(table, start, apply)["found"]


def licence_scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """Per row: key, number of sentences as they are cut (a wrapped one counts once a line), identifiers of the known ones in order, numbers of the rules that match, licences, kinds."""
    read = df.select(F.col(key).alias("doc_id"), lines(F.col(text)).alias("found"))
    counted = F.size(F.filter("found", lambda p: p["s"] != "")).cast("long")
    read = read.select("doc_id", counted.alias("n_sentences"), known_ids(joined(F.col("found"))).alias("ids"))
    some = F.exists("ids", lambda i: i != 0)
    read = read.select("doc_id", "n_sentences", F.filter("ids", lambda i: i != 0).alias("known"),
                       F.when(some, matched(F.col("ids"), rules)).otherwise(F.array().cast("array<int>")).alias("hits"))
    names, kinds = F.array(*[F.lit(r[0]) for r in rules]), F.array(*[F.lit(r[1]) for r in rules])

    def listed(values):
        return F.array_join(F.array_distinct(F.transform("hits", lambda n: F.element_at(values, n))), ",")
    return read.select("doc_id", "n_sentences", F.array_join(F.transform("known", lambda i: i.cast("string")), ",").alias("sentence_ids"),
                       F.array_join(F.transform("hits", lambda n: n.cast("string")), ",").alias("rule_numbers"),
                       listed(names).alias("licences"), listed(kinds).alias("kinds"))
