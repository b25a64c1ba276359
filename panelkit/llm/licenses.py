"""Licence scans by sentence rules.

A text is cut into sentences, each sentence is normalised and looked up among
known licence sentences, first line by line, then over the lines of a paragraph
that it is wrapped over; the sequence of identifiers found is then held against
ordered licence rules. A rule takes the sentences it matches, later rules see the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences in normal form, by identifier (fixed values).
SENTENCES: dict[str, str] = {
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache2-copy-https": "you may obtain a copy of the license at https www.apache.org licenses license 2.0",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache2-header": "licensed under the apache license version 2.0 the license",
    "apache2-header-use": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache2-asf": "licensed to the apache software foundation asf under one or more contributor license agreements",
    "apache2-asf-use": "the asf licenses this file to you under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache2-at": "you may obtain a copy of the license at",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-grant-whole": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis-warranty": "the software is provided as is without warranty of any kind express or implied",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "mpl2-copy-http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "mpl2-terms": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0",
    "epl2-v": "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0",
    "epl1-v": "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0",
    "cddl1-terms": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-event": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "wtfpl-copy": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "reserved": "all rights reserved",
}
#: Licence rules in order: the licence, and the sentences that must follow one another among the known ones (fixed values).
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2-notice", "apache2-use", "apache2-copy", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-header", "apache2-use", "apache2-at", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-header-use", "apache2-at", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-header-use", "apache2-copy", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-header-use", "apache2-copy-https", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-asf", "apache2-asf-use", "apache2-at", "apache2-asis", "apache2-see")),
    ("MIT", ("mit-grant-whole", "mit-keep", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-keep", "asis-warranty")),
    ("MIT", ("mit-notice", "mit-grant")),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl2.1-free", "lgpl-hope")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("0BSD", ("0bsd-grant", "isc-asis")),
    ("MPL-2.0", ("mpl2-terms", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-terms", "mpl2-copy-http")),
    ("CDDL-1.0", ("cddl1-terms", "apache2-use")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Zlib", ("zlib-asis", "zlib-event", "zlib-grant")),
    ("Apache-2.0", ("apache2-notice", "apache2-use")),
)
#: Sentences that stand for a licence by themselves, where no rule above has taken them (fixed values).
ALONE: dict[str, str] = {
    "apache2-header": "Apache-2.0",
    "apache2-header-use": "Apache-2.0",
    "apache2-asf-use": "Apache-2.0",
    "mit-grant": "MIT",
    "mit-grant-whole": "MIT",
    "bsd-grant": "BSD",
    "isc-grant": "ISC",
    "0bsd-grant": "0BSD",
    "mpl2-terms": "MPL-2.0",
    "epl2-terms": "EPL-2.0",
    "epl2-v": "EPL-2.0",
    "epl1-v": "EPL-1.0",
    "cddl1-terms": "CDDL-1.0",
    "unlicense-free": "Unlicense",
    "zlib-grant": "Zlib",
    "wtfpl-copy": "WTFPL",
    "reserved": "LicenseRef-all-rights-reserved",
}
#: Names that notices give licences, in normal form (fixed values): identifier of the notices, licence, names.
NAMES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("apache2-notice", "Apache-2.0", ("apache license version 2.0", "apache license 2.0", "apache 2.0 license")),
    ("mit-notice", "MIT", ("mit license",)),
    ("bsd-notice", "BSD", ("bsd license",)),
    ("bsd2-notice", "BSD-2-Clause", ("bsd 2 clause license", "simplified bsd license")),
    ("bsd3-notice", "BSD-3-Clause", ("bsd 3 clause license", "new bsd license")),
    ("isc-notice", "ISC", ("isc license",)),
    ("gpl2-notice", "GPL-2.0-only", ("gnu general public license version 2", "gnu general public license v2.0", "gpl v2")),
    ("gpl3-notice", "GPL-3.0-only", ("gnu general public license version 3", "gnu general public license v3.0", "gpl v3")),
    ("lgpl2.1-notice", "LGPL-2.1-only", ("gnu lesser general public license version 2.1", "lgpl v2.1")),
    ("lgpl3-notice", "LGPL-3.0-only", ("gnu lesser general public license version 3", "lgpl v3")),
    ("agpl3-notice", "AGPL-3.0-only", ("gnu affero general public license version 3", "agpl v3")),
    ("mpl2-notice", "MPL-2.0", ("mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0")),
    ("epl2-notice", "EPL-2.0", ("eclipse public license 2.0", "eclipse public license v2.0")),
    ("bsl1-notice", "BSL-1.0", ("boost software license version 1.0",)),
    ("artistic2-notice", "Artistic-2.0", ("artistic license 2.0",)),
    ("cc0-notice", "CC0-1.0", ("cc0 1.0 universal license", "cc0 1.0")),
    ("unlicense-notice", "Unlicense", ("unlicense",)),
    ("zlib-notice", "Zlib", ("zlib license",)),
)
#: How notices begin (fixed values).
NOTICES = ("licensed under the", "released under the", "distributed under the", "this work is licensed under the", "this project is licensed under the", "this software is licensed under the", "code is licensed under the")
#: Licence identifiers that a tag may name (fixed values).
TAGS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CECILL-2.1 "
    "ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 "
    "MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 QPL-1.0 Unlicense UPL-1.0 Vim WTFPL Zlib"
).split()
#: Parts of the names of share licences (fixed values).
SHARED = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}


def _put(sentence: str, identifier: str, licence: str) -> None:
    SENTENCES.setdefault(identifier, sentence)
    if SENTENCES[identifier] != sentence:
        # One identifier has several wordings.
        WORDINGS[sentence] = identifier
    ALONE.setdefault(identifier, licence)


#: Further wordings of known sentences, by sentence.
WORDINGS: dict[str, str] = {}
for _id, _licence, _names in NAMES:
    for _name in _names:
        for _opening in NOTICES:
            _put(f"{_opening} {_name}", _id, _licence)
_put("this work is dedicated to the public domain under cc0 1.0", "cc0-notice", "CC0-1.0")
_put("distributed under the boost software license version 1.0", "bsl1-notice", "BSL-1.0")
for _kind, _name, _version in (("gpl", "general", "2"), ("gpl", "general", "3"), ("lgpl", "lesser general", "2.1"), ("lgpl", "lesser general", "3"), ("agpl", "affero general", "3")):
    for _what in ("program", "library", "file", "software"):
        for _end, _suffix in ((f"either version {_version} of the license or at your option any later version", "free"), (f"version {_version} of the license", "free-only")):
            _licence = f"{_kind.upper()}-{_version if '.' in _version else _version + '.0'}-{'or-later' if _suffix == 'free' else 'only'}"
            _put(f"this {_what} is free software you can redistribute it and or modify it under the terms of the gnu {_name} public license as published by the free software foundation {_end}", f"{_kind}{_version}-{_suffix}", _licence)
for _parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
    for _version, _scope in (("4.0", "international"), ("3.0", "unported")):
        _tag = f"cc{_parts.replace(' ', '')}{_version[0]}"
        _long = " ".join(SHARED[x] for x in _parts.split())
        for _sentence in (f"licensed under cc {_parts} {_version}", f"this work is licensed under cc {_parts} {_version}", f"this work is licensed under a creative commons {_long} {_version} {_scope} license", f"licensed under a creative commons {_long} {_version} {_scope} license"):
            _put(_sentence, _tag, f"CC-{_parts.upper().replace(' ', '-')}-{_version}")
for _tag in TAGS:
    _put(f"spdx license identifier {_tag.lower().replace('-', ' ')}", f"spdx-{_tag.lower()}", _tag)
#: Every known sentence and its identifier.
KNOWN: dict[str, str] = {v: k for k, v in SENTENCES.items()} | WORDINGS

#: A known sentence has at least one of these words, so texts without them are not cut up; single words, as any white space may stand between two.
HINT = r"(?i)licen[sc]e|rights|permi[ts]|warrant|software|copyright|public|distribut|\b(?:[al]?gpl|mpl|cc0)\b"
#: A sentence ends at a full stop, exclamation or question mark before white space or the end, but not after the ``v`` of a version.
SENTENCE_END = r"(?<!\b[vV])[.!?]+(?:[ \t]+|\n|$)"
NOT_NORMAL = r"[^a-z0-9.]+"
#: Lines that a known sentence may be wrapped over; comment leaders are no part of the normal form.
MAX_LINES = 16
#: Stands for what a wrapped sentence does not run over: an empty line, the end of a sentence, a line known by itself.
_BREAK = "\n"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.map_from_arrays(F.array(*map(F.lit, KNOWN)), F.array(*map(F.lit, KNOWN.values())))
    sentences = F.array(*map(F.lit, KNOWN))
    # Most lines are ruled out by their first two words.
    openers = sorted({" ".join(k.split()[:2]) for k in KNOWN})
    lines = F.split(F.regexp_replace(F.regexp_replace(text, r"\r", ""), SENTENCE_END, "\n\n"), "\n")
    normal = F.transform(lines, lambda s: F.trim(F.regexp_replace(F.lower(s), NOT_NORMAL, " ")))

    def wrapped(parts: Column, i: Column) -> Column:
        """The known sentence of the fewest lines from line ``i`` on."""
        runs = F.transform(F.sequence(F.lit(2), F.lit(MAX_LINES)), lambda k: F.try_element_at(known, F.array_join(F.slice(parts, i + 1, k), " ")))
        return F.try_element_at(F.filter(runs, lambda x: x.isNotNull()), F.lit(1))

    def found(normal: Column) -> Column:
        may = lambda s: F.substring_index(s, " ", 2).isin(openers) | ~F.contains(s, F.lit(" "))
        opens = lambda s: (s != "") & may(s) & F.exists(sentences, lambda v: F.startswith(v, F.concat(s, F.lit(" "))))
        parts = F.transform(normal, lambda s: F.when((s == "") | F.map_contains_key(known, s), F.lit(_BREAK)).otherwise(s))
        ids = lambda p: F.transform(normal, lambda s, i: F.coalesce(F.try_element_at(known, s), F.when(opens(s), wrapped(p, i))))
        return F.flatten(F.transform(F.array(parts), ids))

    # Lines are bound once, as the only element of an array.
    ids = F.filter(F.flatten(F.transform(F.array(normal), found)), lambda x: x.isNotNull())
    return F.when(F.rlike(text, F.lit(HINT)), ids).otherwise(F.array().cast("array<string>"))


def _chain(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``sentence_ids`` (comma-joined, in order), ``licenses`` (comma-joined, by rule, then by sentence, each once) and ``n_known`` per row.

    A null or empty text has none; repeated rows are scanned one by one; other columns are ignored.
    """
    rows = docs.select("doc_id", sentence_ids(F.coalesce("text", F.lit(""))).alias("ids"))
    chain = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    # One fold over the rules: what is left of the chain, and the licences so far.
    rules = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(_chain(v)).alias("ids")) for k, v in RULES))
    start = F.struct(chain.alias("left"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["ids"])
        # A matched stretch leaves a bar, so that its neighbours don't become consecutive.
        left = F.when(hit, F.replace(state["left"], rule["ids"], F.lit("|"))).otherwise(state["left"])
        return F.struct(left.alias("left"), F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"))

    alone = F.map_from_arrays(F.array(*map(F.lit, ALONE)), F.array(*map(F.lit, ALONE.values())))

    def with_rest(state: Column) -> Column:
        """The licences of the rules, then those that sentences left over stand for, in order of the text."""
        rest = F.transform(F.regexp_extract_all(state["left"], F.lit("<([^>]+)>")), lambda i: F.try_element_at(alone, i))
        return F.concat(state["found"], F.filter(rest, lambda x: x.isNotNull()))

    found = F.when(F.size("ids") > 0, F.array_distinct(F.aggregate(rules, start, step, with_rest))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(found, ",").alias("licenses"), F.size("ids").cast("bigint").alias("n_known"))
