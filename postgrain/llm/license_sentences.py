"""Licence recognition by sentence rules.

A text is cut into sentences, which are normalised and mapped to identifiers of known licence
sentences. A line break, ``;`` or ``:`` may end a sentence or stand within one, so wrapped and
commented notices count like those on one line. Sentences that only state a licence ("Released under
the MIT License") and the operands of SPDX tags are known by rule, for every licence and title below.
Runs of identifiers that follow one another are then matched against licence rules, the longest first.
Identifiers are words, so sentences and rules may be added without bound. DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.llm.shared import picked

# SPDX identifiers and the titles by which notices call the licences.
TITLES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0", "Apache 2"),
    "Apache-1.1": ("Apache License, Version 1.1", "Apache Software License, Version 1.1"),
    "MIT": ("MIT License", "Expat License"),
    "ISC": (), "Zlib": ("zlib/libpng License",), "Unlicense": (), "WTFPL": ("Do What The Fuck You Want To Public License",),
    "0BSD": ("BSD Zero Clause License",),
    "BSD-2-Clause": ("Simplified BSD License", "FreeBSD License", "2-Clause BSD License"),
    "BSD-3-Clause": ("New BSD License", "Modified BSD License", "Revised BSD License", "3-Clause BSD License"),
    "BSD-4-Clause": ("Original BSD License", "4-Clause BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License, Version 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "European Union Public Licence, Version 1.2", "EUPL 1.2"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "Common Development and Distribution License, Version 1.0"),
    "Artistic-1.0": ("Artistic License 1.0",), "Artistic-2.0": ("Artistic License 2.0", "Artistic License, Version 2.0"),
    "MS-PL": ("Microsoft Public License",), "MS-RL": ("Microsoft Reciprocal License",), "PostgreSQL": (), "NCSA": (),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "AFL-3.0": ("Academic Free License, Version 3.0", "Academic Free License 3.0"),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License"),
    "ODbL-1.0": ("Open Database License", "Open Database License 1.0", "Open Data Commons Open Database License"),
    "PSF-2.0": ("Python Software Foundation License, Version 2",), "X11": (), "W3C": (), "Ruby": (), "OpenSSL": (), "PHP-3.01": (),
}
_GNU_NAMES = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}
_GNU_VERSIONS = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
_CC_NAMES = {"BY": "Attribution", "SA": "ShareAlike", "ND": "NoDerivatives", "NC": "NonCommercial"}
_CC_KINDS = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")


def _words(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower().replace("licence", "license")).strip()


def titles() -> dict[str, str]:
    """Normalised title -> licence, as in "licensed under the" title; SPDX identifiers are titles as well."""
    found = {}
    for name, listed in TITLES.items():
        for title in (name, f"{name} License", *listed):
            found[_words(title)] = name
    for name in _GNU_VERSIONS:
        short, full = name.split("-")
        long = f"GNU {_GNU_NAMES[short]} Public License"
        for version in {full, full.removesuffix(".0")}:
            for title in (f"{long}, version {version}", f"{long} v{version}", f"{long} {version}", f"{short}v{version}",
                          f"{short} v{version}", f"{short} {version}", f"{short} version {version}"):
                for full_title in (title, f"GNU {title.removeprefix('GNU ')}"):
                    found[_words(full_title)] = name
                    found[_words(f"{full_title} only")] = f"{name}-only"
                    for later in ("or later", "or any later version", "or at your option any later version"):
                        found[_words(f"{full_title} {later}")] = f"{name}-or-later"
    for kind in _CC_KINDS:
        long = "-".join(_CC_NAMES[k] for k in kind.split("-"))
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            for end in ("", " International", " Unported", " Generic"):
                for title in (f"CC {kind} {version}", f"Creative Commons {long} {version}"):
                    found[_words(title + end)] = found[_words(f"{title}{end} License")] = f"CC-{kind}-{version}"
    return found


def tags() -> dict[str, str]:
    """Normalised operand of an SPDX tag -> licence; ``+`` is read as "or later"."""
    plain = [*TITLES, *(f"CC-{kind}-{v}" for kind in _CC_KINDS for v in ("1.0", "2.0", "2.5", "3.0", "4.0"))]
    found = {_words(name + later): name for name in plain for later in ("", " or later")}
    for name in _GNU_VERSIONS:
        found |= {_words(name + end): name + end for end in ("", "-only", "-or-later")}
    return found


_GNU = ("This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name}General Public "
        "License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any "
        "later version")
#: Sentences that public licence texts and notices contain, by identifier;
#: ``*`` stands for up to 14 words, such as a holder's name.
SENTENCES = {
    "apache-compliance": "You may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
         "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
         "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
         "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
         "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
         "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "gpl-3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
         "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
         "later version",
    "gnu-program-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
         "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gnu-see": "See the GNU General Public License for more details",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
         "following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
         "disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
         "disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of * nor the names of * may be used to endorse or promote products derived from this software "
         "without specific prior written permission",
    "bsd-name": "The name of * may not be used to endorse or promote products derived from this software without specific prior "
         "written permission",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
         "granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
         "granted, provided that the above copyright notice and this permission notice appear in all copies",
    # the mark in 'v. 2.0' ends the sentence; no other version of the licence has this wording
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "apache-asf": "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\")",
    "apache-copy-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "gpl-2-later": _GNU.format(what="program", name="", version="2"),
    "gpl-2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
         "License version 2 as published by the Free Software Foundation",
    "gpl-2-only-version": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
         "License as published by the Free Software Foundation; version 2 of the License",
    "lgpl-2.1-library": _GNU.format(what="library", name="Lesser ", version="2.1"),
    "lgpl-3-library": _GNU.format(what="library", name="Lesser ", version="3"),
    "lgpl-3-program": _GNU.format(what="program", name="Lesser ", version="3"),
    "agpl-3-program": _GNU.format(what="program", name="Affero ", version="3"),
    "gnu-library-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
         "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "lgpl-2-library": _GNU.format(what="library", name="Library ", version="2"),
    "library-gpl-see": "See the GNU Library General Public License for more details",
    "lgpl-2.1-program": _GNU.format(what="program", name="Lesser ", version="2.1"),
    "gnu-copy": "You should have received a copy of the GNU General Public License along with this program",
    "mit-basis": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited "
         "to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "mit-liability": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, "
         "whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use "
         "or other dealings in the software",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc0-deed": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his "
         "or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent "
         "allowed by law",
    "epl-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
         "which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
         "which is available at https://www.eclipse.org/legal/epl-2.0/",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
         "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
         "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to "
         "whom the Software is furnished to do so, all subject to the following",
    "zlib-basis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
         "to alter it and redistribute it freely, subject to the following restrictions",
    "wtfpl-copy": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing "
         "it is allowed as long as the name is changed",
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "cddl-1": "The contents of this file are subject to the terms of the Common Development and Distribution License (the "
         "\"License\")",
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")",
}
#: Licence rules: name, identifiers that follow one another; the longest that fits at a place wins.
RULES = (
    *(("Apache-2.0-notice", f"{first} apache-compliance {rest}") for first in ("apache-notice", "apache-asf") for rest in ("apache-copy apache-basis", "apache-copy", "apache-copy-https apache-basis",
      "apache-copy-https")),
    ("Apache-2.0", "apache-notice"), ("Apache-2.0", "apache-asf"),
    ("MIT-text", "mit-grant mit-basis mit-liability"), ("MIT-text", "mit-grant mit-basis"), ("MIT-text", "mit-grant"),
    *((name, f"bsd-grant bsd-source bsd-binary {rest}".strip()) for name, rest in (("BSD-4-Clause", "bsd-advertising"),
      ("BSD-3-Clause", "bsd-names"), ("BSD-3-Clause", "bsd-name"), ("BSD-2-Clause", ""))),
    ("ISC", "isc-grant"), ("ISC", "isc-grant-and"), ("MPL-2.0", "mpl-2"), ("MPL-1.1", "mpl-1.1"), ("Unlicense", "unlicense"),
    ("CC0-1.0", "cc0-deed"), ("EPL-1.0", "epl-1"), ("EPL-2.0", "epl-2"), ("BSL-1.0", "boost-grant"), ("WTFPL", "wtfpl-copy"),
    ("OFL-1.1", "ofl"), ("CDDL-1.0", "cddl-1"),
    ("Zlib", "zlib-basis zlib-liability zlib-grant"), ("Zlib", "zlib-grant"),
    *((name, f"{first} {rest}".strip()) for name, first, rests in (
        *((name, first, ("gnu-program-hope gnu-see gnu-copy", "gnu-program-hope gnu-see", "gnu-program-hope", "")) for name, first in (
            ("GPL-3.0-or-later", "gpl-3-later"), ("GPL-2.0-or-later", "gpl-2-later"), ("GPL-2.0-only", "gpl-2-only"),
            ("GPL-2.0-only", "gpl-2-only-version"))),
        ("LGPL-2.1-or-later", "lgpl-2.1-library", ("gnu-library-hope lgpl-see", "gnu-library-hope", "")),
        ("LGPL-2.1-or-later", "lgpl-2.1-program", ("gnu-program-hope lgpl-see", "gnu-program-hope", "")),
        ("LGPL-3.0-or-later", "lgpl-3-library", ("gnu-library-hope lgpl-see", "gnu-library-hope", "")),
        ("LGPL-3.0-or-later", "lgpl-3-program", ("gnu-program-hope lgpl-see", "gnu-program-hope", "")),
        ("LGPL-2.0-or-later", "lgpl-2-library", ("gnu-library-hope library-gpl-see", "gnu-library-hope", "")),
        ("AGPL-3.0-or-later", "agpl-3-program", ("gnu-program-hope agpl-see", "gnu-program-hope", "")),
    ) for rest in rests),
)
RULES = tuple(sorted(RULES, key=lambda rule: -len(rule[1].split())))
# every known sentence and statement has one of these, so other texts need no sentences
ANCHORS = ("(?i)licen[sc]e|permission|warranty|redistribution|advertising|unencumbered|dedicated|liable|"
           "(?:released|distributed|available|published)[^A-Za-z0-9]+under")
# letters are lowered, and the two marks below freed
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Each operand of an SPDX tag becomes a sentence of its own: the first one, and those after and, or, with.
OPERAND = r"([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?\+?)"
TAG = rf"(?:spdx-license-identifier:[ \t(]*|(?!\A)\G(?<=[ \t)](?:and|or|with)[ \t(]{{1,9}})){OPERAND}(?:[ \t)]+(?:and|or|with)[ \t(]{{1,9}})?"
#: Steps that leave words with one character between them: ``|`` where a sentence ends for certain (marks
#: before white space or the end), ``~`` where it may end (line breaks, ``;``, ``:``, after a URL), else a blank.
STEPS = (
    (r"(\|spdx [a-z0-9.-]+)\+", r"$1 or later"), ("licence", "license"),
    (r"\n[^a-z0-9|\n]+", "\n"),  # indents, comment prefixes and bullets
    (r"(://[^ \t\r\n]+)[ \t]+", "$1\n"), (r"[.!?]+(?:[ \t\r\n]+|\z)", "|"), (r"[;:](?:[ \t\r\n]|\z)|\n", "~"),
    (r"[^a-z0-9~|]+", " "), (r" ?~[ ~]*", "~"), (r"[ ~]?\|[ ~|]*", "|"), (r"^[ ~|]+|[ ~|]+\z", ""))
#: Numbers and letters of list items.
ITEM = "[0-9]{1,2}|[a-h]|i{1,3}"
#: What may stand before the title in a statement.
STATES = ("(?:(?:this|the|all) (?:work|software|program|project|library|file|code|source code|package|document|content) "
          "(?:is|are) )?(?:dual )?(?:licensed|released|distributed|available|published|made available) under "
          "(?:the terms of )?(?:the |an? )?")


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier; what statements and tags name begins with ``says`` and ``spdx``."""
    return {
        **{f"says {title}": f"says:{name}" for title, name in titles().items()},
        **{f"spdx {tag}": f"spdx:{name}" for tag, name in tags().items()},
        **{_words(text): name for name, text in SENTENCES.items()},
    }


def _pattern(text: str, gap: str, between: str) -> str:
    """Fits the words of ``text`` with ``gap`` between them; ``between`` stands for other words at a ``*``."""
    return (gap + between).join(gap.join(_words(part).split()) for part in text.split("*"))


def sentence_pattern() -> str:
    """Fits every known sentence in marked text, wrapped or not; the longest first, as others may begin alike."""
    longest = sorted(SENTENCES.values(), key=lambda s: -len(_words(s)))
    listed = [_pattern(s, "[ ~]", "(?:[a-z0-9]+[ ~|]){0,14}") for s in longest]
    stated = "|".join(t.replace(" ", "[ ~]") for t in sorted(titles(), key=lambda t: (-len(t), t)))
    return "|".join([*listed, f"{STATES.replace(' ', '[ ~]')}(?:{stated})"])


def rule_pattern() -> str:
    """Fits a run of identifiers, each written between ``#`` and a blank."""
    listed = (re.sub("[.]", r"\\.", written(run)) for _, run in RULES)
    return "|".join([*listed, "#(?:says|spdx):[^ ]+ "])


def written(run: str) -> str:
    return "".join(f"#{name} " for name in run.split())


def _table(pairs: dict[str, str]) -> Column:
    """A constant map; one literal, as there are more than a thousand titles."""
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in pairs.items())), F.lit("\n"), F.lit("\t"))


def sentence_ids(text: Column) -> Column:
    """``#identifier`` per known sentence and ``#-`` per unknown one, each with a blank after it, in order; blank
    ones and item numbers are left out."""
    known = _table(known_sentences())
    marked = F.regexp_replace(F.translate(text, UPPER + "~|", LOWER + "  "), TAG, r"|spdx $1|")
    for pattern, new in STEPS:
        marked = F.regexp_replace(marked, pattern, new)

    def named(part: Column) -> Column:
        plain = F.translate(part, "~|", "  ")
        for s in (s for s in SENTENCES.values() if "*" in s):
            plain = F.regexp_replace(plain, f"^{_pattern(s, ' ', '(?:.* )?')}$", _words(s))
        stated = F.regexp_replace(plain, f"^{STATES}(.+)$", "says $1")
        return F.concat(F.lit("#"), F.coalesce(F.element_at(known, plain), F.element_at(known, stated), F.lit("-")), F.lit(" "))

    parts = F.regexp_extract_all(marked, F.lit(f"(?:{sentence_pattern()})(?![^~|])|[^~|]+"), F.lit(0))
    names = F.transform(F.filter(parts, lambda s: ~s.rlike(f"^(?:{ITEM})$")), named)
    return F.when(text.rlike(ANCHORS), F.array_join(names, "")).otherwise("")


def licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, n_licenses, licenses`` of every row of ``docs`` (doc_id, text).

    ``licenses`` are the names of the rules that fit, in the order of the text, joined by commas; of an SPDX
    expression every licence in it, while exceptions (``WITH``) and unlisted names are none. ``n_sentences`` counts
    known sentences, wrapped or not, and licences of expressions. Null, empty and other texts have none. Of several
    rules that fit at one place the longest wins; no two of one length can. Repeated rows and null ids are returned
    like all others; other columns are ignored. Nothing is shuffled.
    """
    names = _table({written(run): name for name, run in RULES})
    runs = F.regexp_extract_all("_ids", F.lit(rule_pattern()), F.lit(0))
    rows = picked(docs, "doc_id", "text").select("doc_id", sentence_ids(F.coalesce("text", F.lit(""))).alias("_ids"))
    return rows.select(
        "doc_id", F.regexp_count("_ids", F.lit("#[^-]")).cast("long").alias("n_sentences"),
        F.size(runs).cast("long").alias("n_licenses"),
        F.array_join(F.transform(runs, lambda r: F.coalesce(
            F.element_at(names, r), F.regexp_extract(r, ":([^ ]+)", 1))), ",").alias("licenses"))
