"""License scan by sentence rules.

A text is cut into sentences at ``.``, ``!``, ``?``, ``;`` or ``:`` before white space and at line
ends;
sentences are lowered and reduced to letters and numbers.  Known licence sentences become
identifiers, everything between them a gap.  Then ordered rules, each a sequence of identifiers,
are matched from left to right: at each place the first rule that fits wins and consumes its
sentences.

``scan_texts`` finds licences as files carry them, wrapped and commented.  Single line ends, with
comment marks around them, are white space there; punctuation, blank lines and list items cut.  A
known sentence may begin and end at any line, because headings and notices often lack a full stop.
It knows more licences.  ``scan`` cuts at every line end, as its SQL text does.

All of it is one projection of built-in functions; nothing is shuffled.  Null and empty texts have
no sentences and no licences.  Every row gives one row, equal rows equal results.  Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "s01": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "s02": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "s03": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "s04": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "s05": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "s06": "you may not use this file except in compliance with the License.",
    "s07": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "s08": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "s09": "This is free and unencumbered software released into the public domain.",
    "s10": "Licensed under the Apache License, Version 2.0.",
    "s11": "This work is licensed under the GNU General Public License, version 3.",
    "s12": "Released under the MIT License.",
    "s13": "Licensed under CC BY-NC 4.0.",
    "s14": "Licensed under CC BY 4.0.",
    "s15": "All rights reserved.",
}
# Licence and identifier sequence; earlier rules win over later ones.
RULES = [
    ("MIT", ["s01", "s02"]),
    ("MIT", ["s01"]),
    ("MIT", ["s12"]),
    ("ISC", ["s03"]),
    ("BSD", ["s15", "s04"]),
    ("BSD", ["s04"]),
    ("Apache-2.0", ["s05", "s06"]),
    ("Apache-2.0", ["s05"]),
    ("Apache-2.0", ["s10"]),
    ("GPL-3.0-or-later", ["s07"]),
    ("GPL-3.0", ["s11"]),
    ("MPL-2.0", ["s08"]),
    ("Unlicense", ["s09"]),
    ("CC-BY-NC-4.0", ["s13"]),
    ("CC-BY-4.0", ["s14"]),
    ("all-rights-reserved", ["s15"]),
]
# Fixed values of ``scan_texts``, from the public licences' own texts and recommended notices.
TEXT_SENTENCES = SENTENCES | {
    "b01": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "b02": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "b03": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "g01": "This program is free software",
    "g02": "This library is free software",
    "g03": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "g04": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "g05": "either version 2 of the License, or (at your option) any later version.",
    "g06": "either version 3 of the License, or (at your option) any later version.",
    "g07": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "g08": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "g09": "either version 2.1 of the License, or (at your option) any later version.",
    "g10": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "g11": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "g12": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "g13": "This work is licensed under the GNU General Public License, version 2.",
    "g14": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "g15": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "m01": "Licensed under the MIT License.",
    "m02": "This project is licensed under the MIT License.",
    "m04": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "c01": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "c02": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "c03": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "c04": "Licensed under CC BY-SA 4.0.",
    "c05": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "c06": "Released under CC0 1.0.",
    "c07": "CC0 1.0 Universal",
    "e01": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "e03": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "x00": "SPDX-License-Identifier",
}
SPDX = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-1.0",
    "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "0BSD", "Zlib", "BSL-1.0",
    "MIT OR Apache-2.0", "Apache-2.0 OR MIT",
]
TEXT_SENTENCES |= {f"y{n:02}": tag for n, tag in enumerate(SPDX)}
TEXT_RULES = [
    *[(tag, ["x00", f"y{n:02}"]) for n, tag in enumerate(SPDX)],
    *[(name, [*head, "s04", *ids]) for name, ids in (("BSD-3-Clause", ["b01", "b02", "b03"]), ("BSD-2-Clause", ["b01", "b02"])) for head in (["s15"], [])],
    ("GPL-3.0-or-later", ["g01", "g03"]),
    ("GPL-3.0-or-later", ["g01", "g04", "g06"]),
    ("GPL-2.0-or-later", ["g01", "g04", "g05"]),
    ("GPL-2.0-or-later", ["g01", "g07"]),
    ("GPL-2.0", ["g01", "g12"]),
    *[(name, [head, *ids]) for name, ids in (("LGPL-2.1-or-later", ["g08", "g09"]), ("LGPL-2.1-or-later", ["g14"]), ("LGPL-3.0-or-later", ["g08", "g06"]), ("LGPL-3.0-or-later", ["g10"])) for head in ("g02", "g01")],
    ("AGPL-3.0-or-later", ["g01", "g11"]),
    ("AGPL-3.0-or-later", ["g01", "g15", "g06"]),
    ("GPL-2.0", ["g13"]),
    ("MIT", ["m01"]),
    ("MIT", ["m02"]),
    ("ISC", ["m04"]),
    ("CC-BY-4.0", ["c01"]),
    ("CC-BY-SA-4.0", ["c02"]),
    ("CC-BY-NC-4.0", ["c03"]),
    ("CC-BY-SA-4.0", ["c04"]),
    ("CC0-1.0", ["c05"]),
    ("CC0-1.0", ["c06"]),
    ("CC0-1.0", ["c07"]),
    ("EPL-2.0", ["e01"]),
    ("EPL-1.0", ["s15", "e03"]),
    ("EPL-1.0", ["e03"]),
    *RULES,
]
SENTENCE_END = r"[.!?;:]+([ \t\r\n]|\z)"
BETWEEN_WORDS = r"[^\p{L}\p{N}\n]+"
OR_LATER = r"(gpl-[0-9.]+)\+"
COMMENT_MARK = r"(?m)^[ \t]*(?:[;%!:]+|dnl\b|@?rem\b)"
LIST_ITEM = r"(?<!\bversion|\bv\.)\n([^\p{L}\p{N}\n(]*)(?:\(?[0-9]{1,2}[.)]|\(?[a-z]\)|(?<!-)-|\u2022)[ \t]+"
# What is cut by more than a line end is cut by this.
CUT = "\f"
GAP = "---"


def sentences(text: Column) -> Column:
    """Normalised sentences in order, without empty ones."""
    lines = F.regexp_replace(F.lower(text), SENTENCE_END, "\n")
    words = F.regexp_replace(lines, BETWEEN_WORDS, " ")
    return F.filter(F.transform(F.split(words, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def text_sentences(text: Column, known: Mapping[str, str]) -> Column:
    """Normalised sentences of a wrapped text in order, without empty ones.

    Where whole lines inside a sentence are a known one, they are a sentence of their own.
    """
    lines = F.regexp_replace(F.regexp_replace(F.lower(text), r"\r\n?|\f", "\n"), OR_LATER, "$1-or-later")
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.regexp_replace(lines, COMMENT_MARK, " ")), LIST_ITEM, CUT)
    cut = F.regexp_replace(marked, SENTENCE_END, CUT)
    words = F.regexp_replace(cut, r"[^\p{L}\p{N}\n\f]+", " ")
    # Lines with nothing but marks are blank.
    bare = F.regexp_replace(F.regexp_replace(words, r" ?([\n\f]) ?", "$1"), r"[\n\f]*\f[\n\f]*|\n{2,}", CUT)
    phrases = sorted({normalised(s) for s in known.values()}, key=lambda s: (-len(s), s))
    either = "|".join(s.replace(" ", r"[ \n]") for s in phrases)
    apart = F.regexp_replace(bare, rf"(?<![^\n\f])(?:{either})(?![^\n\f])", f"{CUT}$0{CUT}")
    return F.filter(
        F.transform(F.split(apart, CUT), lambda s: F.trim(F.translate(s, "\n", " "))), lambda s: s != ""
    )


def normalised(sentence: str) -> str:
    """The form in which ``sentences`` gives a sentence of a licence."""
    words = "".join(c if c.isalnum() else " " for c in sentence.lower())
    return " ".join(words.split())


def rule_pattern(rules: Sequence[tuple[str, Sequence[str]]]) -> str:
    return "(" + "|".join(" ".join(ids) for _, ids in rules) + ")"


def scan(
    docs: DataFrame,
    known: Mapping[str, str] = SENTENCES,
    rules: Sequence[tuple[str, Sequence[str]]] = RULES,
) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, places, licenses).

    ``sentence_ids``: identifiers of the known sentences in order; ``places``: their numbers among
    all sentences, from 0; ``licenses``: one name per matched rule, in order of appearance.
    Identifiers must have three characters.
    """
    return _ruled(docs, sentences(F.coalesce("text", F.lit(""))), known, rules)


def scan_texts(
    docs: DataFrame,
    known: Mapping[str, str] = TEXT_SENTENCES,
    rules: Sequence[tuple[str, Sequence[str]]] = TEXT_RULES,
) -> DataFrame:
    """The columns of ``scan``, for sentences that are wrapped, commented or listed."""
    return _ruled(docs, text_sentences(F.coalesce("text", F.lit("")), known), known, rules)


def _ruled(
    docs: DataFrame, cut: Column, known: Mapping[str, str], rules: Sequence[tuple[str, Sequence[str]]]
) -> DataFrame:
    if any(len(name) != len(GAP) for name in known):
        raise ValueError(f"sentence identifiers must have {len(GAP)} characters")
    identifier = F.create_map(*[F.lit(x) for i, s in known.items() for x in (normalised(s), i)])
    names = {" ".join(ids): name for name, ids in reversed(rules)}
    license_of = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = docs.select("doc_id", cut.alias("found")).select(
        "doc_id",
        F.size("found").cast("bigint").alias("n_sentences"),
        F.transform("found", lambda s: F.coalesce(identifier[s], F.lit(GAP))).alias("ids"),
    )
    matched = F.regexp_extract_all(F.array_join("ids", " "), F.lit(rule_pattern(rules)), F.lit(1))
    places = F.transform("ids", lambda x, i: F.when(x != GAP, i.cast("bigint")))
    return found.select(
        "doc_id",
        "n_sentences",
        F.filter("ids", lambda x: x != GAP).alias("sentence_ids"),
        F.filter(places, lambda i: i.isNotNull()).alias("places"),
        F.transform(matched, lambda m: license_of[m]).alias("licenses"),
    )
