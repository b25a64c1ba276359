"""Published licence headers, wrapped and commented."""

import textwrap

from panelkit.llm import licenses

GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_ASIS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
TEXTS = {
    "Apache-2.0": """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

  http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": GPL.format(name="General", version="3"),
    "GPL-2.0-or-later": GPL.format(name="General", version="2"),
    "AGPL-3.0-or-later": GPL.format(name="Affero General", version="3"),
    "LGPL-2.1-or-later": GPL.format(name="Lesser General", version="2.1").replace("This program", "This library"),
    "BSD-2-Clause": BSD + BSD_ASIS,
    "BSD-3-Clause": BSD + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + BSD_ASIS,
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
    "CDDL-1.0": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.',
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "GPL-3.0-only": "This project is licensed under the GNU General Public License version 3.",
    "LicenseRef-all-rights-reserved": "(c) 2020 Someone. All rights  reserved.",
    "LGPL-3.0-or-later": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "OFL-1.1": "SPDX-License-Identifier: OFL-1.1",
}


def wrapped(text, width):
    return "\n".join("\n".join(textwrap.wrap(p, width, break_on_hyphens=False, break_long_words=False)) for p in text.split("\n"))


def test_published_headers(spark):
    rows = []
    for name, text in TEXTS.items():
        for width, lead in ((10_000, ""), (76, ""), (66, " * "), (72, "# "), (70, "// "), (76, "\t")):
            lines = [lead + x for x in ["Copyright 2021 Someone", "", *wrapped(text, width).split("\n"), "", "import nothing"]]
            rows.append((name, "\n".join(lines)))
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id int, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    wrong = [(rows[k][0], got[k], rows[k][1]) for k in range(len(rows)) if got[k] != rows[k][0]]
    assert not wrong, wrong[:3]


def test_double_spaces_and_breaks(spark):
    texts = ["All rights  reserved.", "All rights\treserved!", "ALL RIGHTS\r\nRESERVED.", "all rights\n# reserved", "all rights. reserved", "all\n\nrights reserved"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    assert [bool(got[k]) for k in range(6)] == [True, True, True, True, False, False]
