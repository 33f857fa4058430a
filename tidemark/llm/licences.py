"""Licence notices by known sentences and ordered rules.

Texts are cut into sentences, sentences are normalised (lower case, one blank between runs of
letters and digits, one spelling of "license") and looked up among the known ones, which gives
each text a sequence of sentence identifiers. Known sentences with an end mark inside come out of
the cut as several pieces, so pieces that begin one are also looked up joined with those after
them. A rule names identifiers that have to occur in that order; a rule may cover others, which
are then not reported for the same passage. Sentences are read three times, with a line break as
an end, with it as a blank, as notices are often wrapped, and with only blank lines and lines of
copyright as ends, as titles and owners have no full stop; a web address always is a sentence of
its own. A sentence's place is the number of words before it, the same in every reading, so what
the readings find is put together in one sequence, each sentence at its place once. After an SPDX
tag, the operands of an expression (AND, OR, WITH) are looked up one by one.

All of it is one projection of built-in functions over the row's own text. Texts without any
of the ``HINTS``, one of which every known sentence contains, are not cut at all.

Defined cases: a null or empty text has no sentence and no licence; a sentence that occurs
again counts again; rows are judged one by one, so repeated rows agree; input columns stay,
clashing result names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short notices. Every template is joined with every name of a licence.
TEMPLATES = (
    "licensed under {}",
    "released under {}",
    "distributed under {}",
    "available under {}",
    "published under {}",
    "licensed under the terms of {}",
    "released under the terms of {}",
    "distributed under the terms of {}",
    "this work is licensed under {}",
    "this work is released under {}",
    "this file is licensed under {}",
    "this project is licensed under {}",
    "this software is licensed under {}",
    "this software is released under {}",
    "this code is licensed under {}",
    "this program is licensed under {}",
    "this document is licensed under {}",
    "this text is licensed under {}",
    "this content is licensed under {}",
    "this article is licensed under {}",
    "spdx license identifier {}",
)
# Licences and the names they go by in a notice.
NAMES = {
    "Apache-2.0": ("the apache license version 2 0", "apache license 2 0", "apache 2 0", "the apache 2 0 license"),
    "MIT": ("the mit license", "mit license", "the mit licence", "mit"),
    "BSD-2-Clause": ("the bsd 2 clause license", "bsd 2 clause", "the simplified bsd license"),
    "BSD-3-Clause": ("the bsd 3 clause license", "bsd 3 clause", "the new bsd license"),
    "ISC": ("the isc license", "isc"),
    "GPL-2.0": ("the gnu general public license version 2", "the gnu gpl version 2", "gpl 2 0", "the gnu gpl v2", "gpl 2 0 only"),
    "GPL-3.0": ("the gnu general public license version 3", "the gnu gpl version 3", "gpl 3 0", "the gnu gpl v3", "gpl 3 0 only"),
    "LGPL-2.1": ("the gnu lesser general public license version 2 1", "lgpl 2 1"),
    "LGPL-3.0": ("the gnu lesser general public license version 3", "lgpl 3 0"),
    "AGPL-3.0": ("the gnu affero general public license version 3", "agpl 3 0"),
    "MPL-2.0": ("the mozilla public license version 2 0", "mpl 2 0"),
    "EPL-2.0": ("the eclipse public license version 2 0", "epl 2 0"),
    "CC0-1.0": ("cc0 1 0", "the cc0 1 0 license"),
    "CC-BY-4.0": ("cc by 4 0", "a creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "a creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0",),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0",),
}
# Sentences of licence texts, normalised.
SENTENCES = {
    "reserved": "all rights reserved",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files the software to deal in the software without restriction including "
    "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
    "the software and to permit persons to whom the software is furnished to do so subject to the following "
    "conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions "
    "and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of "
    "conditions and the following disclaimer in the documentation and or other materials provided with the "
    "distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without "
    "fee is hereby granted provided that the above copyright notice and this permission notice appear in all "
    "copies",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation either version 3 of the license or "
    "at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation either version 2 of the license or "
    "at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty "
    "without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the "
    "gnu lesser general public license as published by the free software foundation either version 3 of the license "
    "or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the "
    "gnu lesser general public license as published by the free software foundation either version 2 1 of the "
    "license or at your option any later version",
    "lgpl-warranty": "this library is distributed in the hope that it will be useful but without any warranty "
    "without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu affero general public license as published by the free software foundation either version 3 of the license "
    "or at your option any later version",
    "epl-terms": "this program and the accompanying materials are made available under the terms of the eclipse "
    "public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
# Other wordings of them. Owners' names in the third clause of BSD are taken out.
WORDINGS = (
    ("mit-notice", "the above copyright notice and this permission notice including the next paragraph shall be "
     "included in all copies or substantial portions of the software"),
    ("bsd-endorse", "nor the names of its contributors may be used to endorse or promote products derived from this "
     "software without specific prior written permission"),
    ("bsd-endorse", "the name of the author may not be used to endorse or promote products derived from this "
     "software without specific prior written permission"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose with or without fee "
     "is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    *(("lgpl21-free" if " 2 1 " in text else "lgpl-free", text.replace("this library", "this program"))
      for name, text in SENTENCES.items() if name in ("lgpl-free", "lgpl21-free")),
    ("epl-terms", "this program and the accompanying materials are made available under the terms of the eclipse "
     "public license v2 0 which accompanies this distribution and is available at https www eclipse org legal epl "
     "v20 html"),
    ("epl-terms", "this program and the accompanying materials are made available under the terms of the eclipse "
     "public license v 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("epl-terms", "this program and the accompanying materials are made available under the terms of the eclipse "
     "public license 2 0 which is available at http www eclipse org legal epl 2 0"),
)
# Each known sentence has one of these.
HINTS = (
    "licen[cs]e", "released under", "distributed under", "available under", "published under",
    "all rights", "permission", "redistribut", "free and", "free software", "any warranty",
)
GAP = r"[^\p{L}\p{N}]+"
BLANK = r"[ \t-\r]+"
END = f"([.!?:;]){BLANK}"
ADDRESS = r"(https?://[^ \t-\r]+)"
SPDX = "spdx license identifier"
# Operators of an SPDX expression; "or later" belongs to a name.
OPERATORS = " (?:and|or|with) "
# What the cut leaves of a known sentence up to the first mark inside it, and the most pieces of one.
HEADS = (
    "spdx license identifier",
    "this program is free software",
    "this library is free software",
    "this program is distributed in the hope that it will be useful but without any warranty",
    "this library is distributed in the hope that it will be useful but without any warranty",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 "
    "which is available at",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 "
    "which accompanies this distribution and is available at",
    "this source code form is subject to the terms of the mozilla public license v",
)
PIECES = 3
OWNERS = "^neither the names? of .+ nor the names of "
# A line of copyright, and lines without a letter or digit, once line breaks are line feeds.
COPYRIGHT_LINE = r"(?im)^([^\p{L}\p{N}\n]*copyright[ \t]+(?:\(c\)|©|[0-9])[^\n]*)\n"
BLANK_LINES = r"\n[^\p{L}\p{N}]*\n"


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier."""
    out = {text.replace("licence", "license"): name for name, text in SENTENCES.items()}
    out |= {text: name for name, text in WORDINGS}
    for licence, names in NAMES.items():
        for ending in ("only", "orlater") if "GPL" in licence else ():
            out[f"{SPDX} {licence.lower().replace('-', ' ').replace('.', ' ')} {ending}"] = f"by-{licence}"
        for name in names:
            for template in TEMPLATES:
                out[template.format(name).replace("licence", "license")] = f"by-{licence}"
    return out


# Rules in order: licence, identifiers in theirs, and whether it only counts where no rule
# before it does.
RULES = (
    ("Apache-2.0", ("apache-compliance", "apache-copy"), False),
    ("MIT", ("mit-grant", "mit-notice"), False),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), False),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), False),
    ("ISC", ("isc-grant",), False),
    ("GPL-3.0", ("gpl-free", "gpl-warranty"), False),
    ("GPL-2.0", ("gpl2-free", "gpl-warranty"), False),
    ("LGPL-3.0", ("lgpl-free", "(lgpl|gpl)-warranty"), False),
    ("LGPL-2.1", ("lgpl21-free", "(lgpl|gpl)-warranty"), False),
    ("AGPL-3.0", ("agpl-free", "gpl-warranty"), False),
    ("EPL-2.0", ("epl-terms",), False),
    ("MPL-2.0", ("mpl-form",), False),
    ("Unlicense", ("unlicense",), False),
    *((licence, (f"by-{licence}",), False) for licence in NAMES),
    ("LicenseRef-all-rights-reserved", ("reserved",), True),
)
# Identifiers of a rule, and those of a rule that starts alike and covers it.
COVERED = {("bsd-grant", "bsd-source", "bsd-binary"): ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")}


def hints() -> str:
    return "(?i)" + "|".join(h.replace(" ", GAP) for h in HINTS)


def pattern(identifiers: tuple[str, ...]) -> str:
    """Regular expression for identifiers in this order in a sequence, each between blanks."""
    return " " + " (.* )?".join(i.replace(".", "[.]") for i in identifiers) + " "


def sentences(text: Column) -> Column:
    """Normalised sentences in order, without empty ones."""
    ended = F.regexp_replace(F.regexp_replace(text, ADDRESS, "\n$1\n"), END, "$1\n")
    plain = F.transform(F.split(ended, "\n"), lambda s: F.trim(F.regexp_replace(F.lower(s), GAP, " ")))
    plain = F.transform(plain, lambda s: F.regexp_replace(s, "licence", "license"))
    plain = F.transform(plain, lambda s: F.regexp_replace(s, OWNERS, "nor the names of "))
    return F.filter(plain, lambda s: s != "")


def identifiers(text: Column) -> Column:
    """``(place, name)`` of the known sentences of a text; a name may be several, with blanks."""
    names = known_sentences()
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))

    def look_up(s: Column) -> Column:
        return F.when(s.isin(*names), F.try_element_at(known, s))

    def operands(s: Column) -> Column:
        parts = F.split(F.regexp_replace(s, " or later", " orlater"), OPERATORS)
        found = F.array_compact(F.transform(parts, lambda p: look_up(F.concat(F.lit(f"{SPDX} "), p))))
        return F.when(F.size(found) > 0, F.array_join(found, " "))

    def joined(pieces: Column, s: Column, i: Column) -> Column:
        runs = [look_up(F.array_join(F.slice(pieces, i + 1, n), " ")) for n in range(2, PIECES + 1)]
        expression = F.when(s == SPDX, operands(F.get(pieces, i + 1)))
        return F.coalesce(look_up(s), F.when(s.isin(*HEADS), F.coalesce(*runs, expression)))

    def placed(pieces: Column) -> Column:
        named = F.transform(pieces, lambda s, i: F.struct(i.alias("i"), joined(pieces, s, i).alias("name")))
        return F.transform(
            F.filter(named, lambda x: x["name"].isNotNull()),
            lambda x: F.struct(
                F.aggregate(F.slice(pieces, F.lit(1), x["i"]), F.lit(0), lambda n, s: n + F.size(F.split(s, " "))).alias("place"),
                x["name"].alias("name"),
            ),
        )

    # The outer transform keeps the pieces, so that they are not cut again for each of them.
    return F.transform(F.array(sentences(text)), placed)[0]


def paragraphs(text: Column) -> Column:
    """The text with line breaks only after lines of copyright and for blank lines."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), COPYRIGHT_LINE, "$1\n\n")
    return F.translate(F.regexp_replace(lines, BLANK_LINES, "\r"), "\r\n", "\n ")


def scan(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Add ``sentences`` (identifiers joined by blanks) and ``licences`` (joined by commas)."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("sentences", "licences", "_ids")]
    whole = F.col(text)
    readings = F.array(whole, F.translate(whole, "\r\n", "  "), paragraphs(whole))
    placed = F.sort_array(F.array_distinct(F.flatten(F.transform(readings, identifiers))))
    named = F.array_join(F.transform(placed, lambda x: x["name"]), " ")
    ids = F.when(whole.rlike(hints()), F.concat(F.lit(" "), named, F.lit(" "))).otherwise(F.lit("  "))
    found = df.select(*rest, ids.alias("_ids"))

    def occurs(names: tuple[str, ...]) -> Column:
        found = F.col("_ids").rlike(pattern(names))
        if names not in COVERED:
            return found
        covering = pattern(COVERED[names])
        # Passages from one first identifier to the next: is one of them not covered?
        passages = F.split("_ids", f"(?= {names[0]} )")
        passages = F.transform(passages, lambda s: F.concat(s, F.lit(" ")))
        alone = F.exists(passages, lambda s: s.rlike(pattern(names)) & ~s.rlike(covering))
        return found & (~F.col("_ids").rlike(covering) | alone)

    def matched(fallback: bool) -> Column:
        tests = [F.when(occurs(names), licence) for licence, names, last in rules if last == fallback]
        return F.array_distinct(F.array_compact(F.array(*tests)))

    first = matched(False)
    found = found.select(*rest, "_ids", first.alias("_first"))
    licences = F.when(F.size("_first") > 0, F.col("_first")).otherwise(matched(True))
    return found.select(
        *rest,
        F.trim("_ids").alias("sentences"),
        F.array_join(licences, ",").alias("licences"),
    )
