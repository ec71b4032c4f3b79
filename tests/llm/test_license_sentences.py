import random
import re

from postgrain.llm.license_sentences import ANCHORS, RULES, SENTENCES, known_sentences, licenses, tags, titles


def plain(text):
    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)).strip()


def brute_force(text):
    """Sentences that stand alone, without wrapping: one after the other, then the longest rule at each place."""
    known = {plain(t): name for name, t in SENTENCES.items()}
    ids = []
    for part in re.split(r"[.!?]+[ \t\r\n]+|\n|[.!?]+\Z", text or ""):
        words = plain(part)
        tag = re.fullmatch(r" *SPDX-License-Identifier: *([A-Za-z0-9.-]+)(\+?) *", part, re.I)
        if tag:
            name = tags().get(plain(tag[1]) + (" or later" if tag[2] else ""))
            ids.append(name and f"spdx:{name}")
        elif words:
            found = known.get(words)
            for verb in ("licensed", "released", "distributed"):
                for start in ("", "this work is ", "the code is "):
                    for article in ("", "the ", "a ", "the terms of the "):
                        lead = f"{start}{verb} under {article}"
                        if not found and words.startswith(lead) and words[len(lead):] in titles():
                            found = f"says:{titles()[words[len(lead):]]}"
            ids.append(found)
    names, k = [], 0
    while k < len(ids):
        fits = [(run.split(), name) for name, run in RULES if ids[k:k + len(run.split())] == run.split()]
        if ids[k] and ":" in ids[k]:
            fits.append(([ids[k]], ids[k].split(":")[1]))
        if fits:
            run, name = max(fits, key=lambda f: len(f[0]))
            names.append(name)
        k += len(run) if fits else 1
    return sum(i is not None for i in ids), len(names), ",".join(names)


def test_same_as_one_sentence_at_a_time(spark):
    rng = random.Random(14)
    stated = [f"{lead} under {article}{title}" for lead in ("Licensed", "This work is released", "The code is distributed")
              for article in ("", "the ", "the terms of the ") for title in rng.sample(sorted(titles()), 40)]
    tagged = [f"SPDX-License-Identifier: {name}{end}" for name in ("MIT", "GPL-2.0", "Apache-2.0", "LGPL-2.1-only", "None-1") for end in ("", "+")]
    loose = [s for s in SENTENCES.values() if "://" not in s and "v1.0" not in s and "*" not in s and ";" not in s and ":" not in s]
    texts = []
    for _ in range(400):
        parts = [*rng.sample(loose, 8), *rng.sample(stated, 6), *rng.sample(tagged, 2), "Some words", "é", "", "license?", "A version 2.0 of it"]
        chosen = [rng.choice(parts) for _ in range(rng.randint(0, 8))]
        if rng.random() < 0.3:
            run = rng.choice(RULES)[1].split()
            if all(SENTENCES[k] in loose for k in run):
                chosen += [SENTENCES[k] for k in run]
        ends = [". ", ".\n", "\n", "!  "] + ["."] * (not any(p in tagged for p in chosen))
        texts.append("".join((p.upper() if rng.random() < 0.2 else p) + rng.choice(ends) for p in chosen))
    texts += [None, "", "Licensed under CC BY-NC 4.0.", "word " * 100_000 + "\nReleased under the MIT License.", "...", "no licence"]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "Released under MIT", "x"), (None, "Released under MIT", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = sorted((tuple(r) for r in licenses(docs.repartition(4)).collect()), key=repr)
    assert got == sorted(((d, *brute_force(t)) for d, t, _ in rows), key=repr)
    assert licenses(docs.limit(0)).collect() == []


def test_no_known_sentence_is_skipped():
    assert all(re.search(ANCHORS, s) for s in SENTENCES.values())
    assert all(re.search(ANCHORS, f"{verb}\nunder {t}") for verb in ("Released", "made available", "published") for t in titles())
    runs = [run for _, run in RULES]
    assert len(set(runs)) == len(runs) and {name for run in runs for name in run.split()} <= set(SENTENCES)
    # a rule never hides a longer one after it
    assert not any(late.startswith(early + " ") for k, early in enumerate(runs) for late in runs[k + 1:])
    assert len(known_sentences()) > 1000 and len({*titles().values(), *tags().values()}) > 80


EXPRESSIONS = (
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", "MIT,Apache-2.0"),
    ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR MIT */", "GPL-2.0-only,MIT"),
    ("# SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"), ("SPDX-License-Identifier:GPL-2.0\nx", "GPL-2.0"),
    ("<!-- SPDX-License-Identifier: (LGPL-2.1+ AND (MIT OR BSD-3-Clause)) -->", "LGPL-2.1-or-later,MIT,BSD-3-Clause"),
    ("SPDX-License-Identifier: mit and others or zlib", "MIT,Zlib"), ("SPDX-License-Identifier: MIT. Zlib or ISC.", "MIT"),
    ("SPDX-License-Identifier: Apache-2.0+\nSPDX-License-Identifier: CC0-1.0", "Apache-2.0,CC0-1.0"),
    ("SPDX-License-Identifier: LicenseRef-own", ""), ("SPDX-License-Identifier:", ""), ("SPDX-License-Identifier: MIT OR", "MIT"),
    ("This is free and unencumbered software released into the\npublic domain.\n\nAnyone is free", "Unlicense"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    (" * Distributed under the Boost\n * Software License, Version 1.0.", "BSL-1.0"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\n"
     "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial "
     "applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin", "Zlib"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\n"
     "https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-SA 3.0", "CC-BY-SA-3.0"), ("To this file CC0 applies", ""), ("Published under CC0 1.0 Universal.", "CC0-1.0"),
    ("The code is distributed under the GNU GPL v3 or later.", "GPL-3.0-or-later"), ("released under\nGPLv2", "GPL-2.0"),
    ("Licensed under the European Union Public Licence 1.2", "EUPL-1.2"), ("Licensed under the MIT License of our own", ""),
    ("Released under no License", ""), ("released under", ""),
)


def test_expressions_and_statements(spark):
    rows = [(k, t) for k, (t, _) in enumerate(EXPRESSIONS)]
    got = licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(EXPRESSIONS[r.doc_id][0], r.licenses) for r in got] == list(EXPRESSIONS)


def test_same_as_sql(spark):
    import duckdb

    from postgrain.llm.queries import ORACLE

    texts = [t for t, _ in EXPRESSIONS] + [x for _, _, t in NOTICES for x in (
        t, t.replace("\n", "\r\n"), " ".join(t.split()), "\n".join(f"# {line}" for line in t.split("\n")), f"{t}\n\n{t} {t}")] + [None, ""]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(ORACLE["op10_license_rules"]).fetchall())


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
GNU = """This {what} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {name}General Public License as published by
the Free Software Foundation{mark} either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name}General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
NAMES = """
3. Neither the name of Example Inc. nor the names of its contributors may be used
   to endorse or promote products derived from this software without specific prior
   written permission."""
NOTICES = (
    ("Apache-2.0-notice", 4, APACHE), ("MIT-text", 1, MIT),
    ("GPL-3.0-or-later", 3, GNU.format(what="program", mark=":", name="", version="3")),
    ("GPL-2.0-or-later", 3, GNU.format(what="program", mark=";", name="", version="2")),
    ("LGPL-2.1-or-later", 3, GNU.format(what="library", mark=";", name="Lesser ", version="2.1")),
    ("AGPL-3.0-or-later", 3, GNU.format(what="program", mark=":", name="Affero ", version="3")),
    ("BSD-2-Clause", 3, BSD), ("BSD-3-Clause", 4, BSD + NAMES),
    ("ISC", 1, """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    ("MPL-2.0", 1, """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Apache-2.0", 1, "SPDX-License-Identifier: Apache-2.0"), ("BSD-3-Clause", 1, "SPDX-License-Identifier: BSD-3-Clause"),
)


def test_usual_copies_of_notices(spark):
    rows, want = [], []
    for name, count, text in NOTICES:
        lines = text.split("\n")
        shapes = [text, " ".join(x.strip() for x in lines if x), "\r\n".join(lines)]
        shapes += ["\n".join(f"{prefix} {x}".rstrip() for x in lines) for prefix in ("#", "//", " *", "--", "!")]
        shapes += [f"/*\n * Copyright 2020 A Person.\n *\n{shapes[5]}\n */\nint x;\n", f"Some words before.\n\n{text}\n\nSome after"]
        for shape in shapes:
            want.append((len(rows), count, 1, name))
            rows.append((len(rows), shape))
    got = [tuple(r) for r in licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == want
