"""License scans by sentence rules.

A text is cut into sentences, each sentence normalised and looked up among known licence sentences; what remains of the
text is a sequence of sentence identifiers. Ordered rules are then matched against that sequence: a rule is a list of
identifiers that must follow one another, others may stand between. One scan and one projection; nothing is shuffled.

Defined results:

* a sentence ends at a blank line, or at ``.!?;:`` before white space; it may also begin and end at any line end, and go
  over several lines; of sentences that begin at one place the longest counts, and none overlap;
* it is compared in lower case, with runs of anything but ASCII letters and digits as one space; at a line's beginning
  such runs, as comment signs are, don't count at all;
* null, empty and blank texts, and texts without a known sentence, have no row in the result;
* known sentences that complete no rule give the licence ``unknown-terms``; rules that hold alike are all given, in the
  order of the table;
* repeated rows each give a row; very long texts are read whole; an empty table gives an empty result;
* extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


#: Identifier of a sentence and how it may be worded.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache2-by": ("Licensed under the Apache License, Version 2.0", "This project is licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    "apache2-use": ("you may not use this file except in compliance with the License",),
    "apache2-copy": ("You may obtain a copy of the License at",),
    "apache2-asis": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",),
    "mit-by": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "The MIT License", "MIT License", "The MIT License (MIT)"),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "mit-asis": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "bsd-by": ("Licensed under the BSD License", "Licensed under the BSD 3-Clause License", "BSD 3-Clause License"),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-name": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "gpl3-by": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU GPL v3", "Licensed under the GPL-3.0"),
    "gpl2-by": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"),
    "gpl-free": ("This program is free software", "This is free software"),
    "gpl-any": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl2-any": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",),
    "lgpl-by": ("Licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    "agpl-by": ("Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"),
    "mpl-by": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"),
    "cc-by": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0",),
    "cc0": ("Licensed under CC0 1.0", "This work is dedicated to the public domain", "CC0 1.0 Universal"),
    "all-rights": ("All rights reserved",),
    "no-reuse": ("No part of this work may be reproduced without permission", "Do not distribute", "Unauthorized copying of this file is strictly prohibited"),
}

SENTENCES |= {
    "unlicense-by": ("This is free and unencumbered software released into the public domain",),
    "unlicense-any": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",),
    "boost-grant": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",),
    "zlib-asis": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "gpl-verbatim": ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",),
    "gpl3-title": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "gpl2-title": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "lgpl3-title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "lgpl21-title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "agpl3-title": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "gpl-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",),
    "gpl-received": ("You should have received a copy of the GNU General Public License along with this program",),
    "lgpl-any": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "lgpl21-any": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",),
    "agpl-any": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "lib-free": ("This library is free software",),
    "mit-liable": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
    "bsd-asis": ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "mpl-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    "epl2-by": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "epl1-by": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",),
    "ofl-by": ("This Font Software is licensed under the SIL Open Font License, Version 1.1",),
    "postgresql-grant": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",),
}

#: Licences and the names that a statement can give them.
_NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "MIT": ("MIT License", "MIT licence"),
    "ISC": ("ISC License",),
    "BSD": ("BSD License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL v3", "GNU GPLv3", "GPLv3", "GPL-3.0", "GPL v3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License version 2", "GNU General Public License v2.0", "GNU GPL v2", "GNU GPLv2", "GPLv2", "GPL-2.0", "GPL v2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3", "LGPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL-2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License",),
    "Unlicense": ("Unlicense",),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, Version 2.0"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
}
_SAID = ("Licensed under the", "Licensed under", "Released under the", "Distributed under the", "Available under the", "This project is licensed under the", "This software is licensed under the", "This library is licensed under the", "This file is licensed under the", "This work is licensed under the", "This program is licensed under the", "This code is licensed under the")
#: Statements that had identifiers of their own before.
_OF = {"Apache-2.0": "apache2-by", "MIT": "mit-by", "BSD": "bsd-by", "GPL-3.0": "gpl3-by", "GPL-2.0": "gpl2-by", "LGPL-3.0": "lgpl-by", "AGPL-3.0": "agpl-by", "MPL-2.0": "mpl-by"}
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_TAGS = ("MIT", "ISC", "0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "Artistic-2.0", "OFL-1.1", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "PostgreSQL")


def _stated() -> tuple[dict[str, tuple[str, ...]], dict[str, str]]:
    """Statements that name a licence, by identifier, and the licence of each identifier."""
    said: dict[str, list[str]] = {}
    licence: dict[str, str] = {}
    taken = {normalised(w) for wordings in SENTENCES.values() for w in wordings}

    def add(name: str, of: str, wording: str) -> None:
        if normalised(wording) not in taken:
            taken.add(normalised(wording))
            said.setdefault(name, []).append(wording)
            licence[name] = of

    for of, names in _NAMES.items():
        name = _OF.get(of, f"{of.lower()}-by")
        for x in names:
            for how in _SAID:
                add(name, of, f"{how} {x}")
        for x in names[:1] if "Clause" in of else ():
            add(name, of, x)
    for code, x in _CC.items():
        for version, where in (("4.0", "International"), ("3.0", "Unported"), ("3.0", ""), ("2.5", "Generic"), ("2.0", "Generic")):
            of = f"CC-{code.upper()}-{version}"
            name = f"cc-{code}" if version == "4.0" else f"cc-{code}-{version}"
            for how in ("This work is licensed under a", "This work is licensed under the", "Licensed under a", "Licensed under the", "Except where otherwise noted, this work is licensed under a"):
                add(name, of, " ".join(f"{how} Creative Commons {x} {version} {where} License".split()))
            add(name, of, f"Licensed under CC {code.upper()} {version}")
            add(name, of, f"This work is licensed under CC {code.upper()} {version}")
    for tag in _TAGS:
        add(f"tag-{tag.lower()}", tag, f"SPDX-License-Identifier: {tag}")
    return {k: tuple(v) for k, v in said.items()}, licence


#: Licence and the sentence identifiers that must follow one another, in the order of the report.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2-by",)),
    ("Apache-2.0-header", ("apache2-by", "apache2-use", "apache2-copy", "apache2-asis")),
    ("MIT", ("mit-by",)),
    ("MIT-text", ("mit-grant", "mit-notice", "mit-asis")),
    ("ISC", ("isc-grant",)),
    ("BSD", ("bsd-by",)),
    ("BSD-2-Clause-text", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause-text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("GPL-3.0", ("gpl3-by",)),
    ("GPL-2.0", ("gpl2-by",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-any")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-any")),
    ("LGPL-3.0", ("lgpl-by",)),
    ("AGPL-3.0", ("agpl-by",)),
    ("MPL-2.0", ("mpl-by",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC0-1.0", ("cc0",)),
    ("all-rights-reserved", ("all-rights",)),
    ("no-reproduction", ("no-reuse",)),
    ("Unlicense-text", ("unlicense-by", "unlicense-any")),
    ("BSL-1.0-text", ("boost-grant",)),
    ("Zlib-text", ("zlib-asis", "zlib-grant")),
    ("GPL-3.0-text", ("gpl3-title", "gpl-verbatim")),
    ("GPL-2.0-text", ("gpl2-title", "gpl-verbatim")),
    ("LGPL-3.0-text", ("lgpl3-title", "gpl-verbatim")),
    ("LGPL-2.1-text", ("lgpl21-title", "gpl-verbatim")),
    ("AGPL-3.0-text", ("agpl3-title", "gpl-verbatim")),
    ("LGPL-3.0-or-later", ("lib-free", "lgpl-any")),
    ("LGPL-2.1-or-later", ("lib-free", "lgpl21-any")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-any")),
    ("0BSD", ("0bsd-grant",)),
    ("EPL-2.0-notice", ("epl2-by",)),
    ("EPL-1.0", ("epl1-by",)),
    ("OFL-1.1-notice", ("ofl-by",)),
    ("PostgreSQL-text", ("postgresql-grant",)),
)
_MORE, _LICENCE = _stated()
SENTENCES = {k: SENTENCES.get(k, ()) + _MORE.get(k, ()) for k in (*SENTENCES, *(k for k in _MORE if k not in SENTENCES))}
RULES += tuple((of, (name,)) for name, of in _LICENCE.items() if (of, (name,)) not in RULES)

_END = r"([.!?;:])[ \t\r]+"
_STOP = r"[.!?;:](?:[ \t\r]+|(?=\n))"
_PREFIX = r"(?<![^\n])[^a-z0-9\n]+"
_OTHER = r"[^a-z0-9\n]+"


def _rule_pattern(sentences: tuple[str, ...]) -> str:
    return r"([^|]*\|)*?".join(re.escape(s).replace(r"\-", "-").replace(r"\.", "[.]") + r"\|" for s in sentences)


def parts(wording: str) -> list[str]:
    """A wording's normalised pieces between its inner points."""
    return [p for p in map(normalised, re.sub(_END, r"\1" + "\n", wording).split("\n")) if p]


def known() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    return {" ".join(parts(w)): name for name, wordings in SENTENCES.items() for w in wordings}


def _pattern() -> str:
    """What finds all known sentences, wrapped or not: a trie of their words, so that a line is compared with all at once.

    Deeper branches come before an end, so that the longest sentence is found. A wording that is itself cut at its inner
    points is known only by all of its parts in succession.
    """
    trie: dict = {}
    for wordings in SENTENCES.values():
        for w in wordings:
            at, lead = trie, ""
            for p in parts(w):
                for word in p.split():
                    at = at.setdefault(lead + word, {})
                    lead = "(?: ?\\n ?| )"
                lead = " ?\\n[ \\n]*"
            at[""] = {}

    def text(node: dict) -> str:
        out = [k + text(v) for k, v in sorted(node.items(), reverse=True) if k]
        if not out:
            return ""
        return out[0] if len(node) == 1 else f"(?:{'|'.join(out)}{'|' if '' in node else ''})"

    return text(trie)


def scan(docs: DataFrame, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> DataFrame:
    """``doc_id``, the identifiers found in their order, and the licences they stand for, each comma-separated."""
    pattern = rf"(?<![^\n]) ?{_pattern()} ?(?![^\n])"
    by_text = F.create_map(*[F.lit(x) for kv in known().items() for x in kv])
    # one line end is a wrapped line, more are the end of a sentence
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("text"), _PREFIX, ""), _STOP, "\n\n"), _OTHER, " ")
    ids = F.transform(F.regexp_extract_all(flat, F.lit(pattern), F.lit(0)), lambda s: by_text[F.trim(F.regexp_replace(s, r"[ \n]+", " "))])
    found = docs.select("doc_id", ids.alias("ids")).where(F.size("ids") > 0)
    sequence = F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|"))
    names = F.concat_ws(",", *[F.when(sequence.rlike(r"\|" + _rule_pattern(s)), F.lit(name)) for name, s in rules])
    return found.select("doc_id", F.array_join("ids", ",").alias("sentences"), F.size("ids").cast("long").alias("n_sentences"), F.when(names == "", "unknown-terms").otherwise(names).alias("licenses"))


def scan_sql(docs: str = "documents", rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> str:
    """The same in DuckDB's SQL, whose patterns can't look around but know lines."""
    names = ", ".join(f"CASE WHEN regexp_matches(sequence, '\\|{_rule_pattern(s)}') THEN '{name}' END" for name, s in rules)
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in known().items())
    return f"""
WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '(^|\\n)[^a-z0-9\\n]+', '\\1', 'g'), '[.!?;:](?:[ \\t\\r]+|(\\n))', chr(10) || chr(10) || '\\1', 'g'), '[^a-z0-9\\n]+', ' ', 'g') AS flat FROM {docs}),
s AS (SELECT doc_id, list_transform(regexp_extract_all(flat, '(?m)^ ?{_pattern()} ?$'), lambda x: (MAP {{{pairs}}})[trim(regexp_replace(x, '[ \\n]+', ' ', 'g'))]) AS ids FROM f),
q AS (SELECT doc_id, ids, '|' || array_to_string(ids, '|') || '|' AS sequence FROM s WHERE len(ids) > 0),
n AS (SELECT *, concat_ws(',', {names}) AS names FROM q)
SELECT doc_id, array_to_string(ids, ',') AS sentences, len(ids)::BIGINT AS n_sentences,
  CASE WHEN names = '' THEN 'unknown-terms' ELSE names END AS licenses FROM n"""
