"""Licence sentences and rules on texts with known licences."""

from __future__ import annotations

import re

import pytest

from accessgraph.llm import licences as lc

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software. The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
CASES = [
    ("Released under the MIT License.", "mit", "MIT"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3", "GPL-3.0-only"),
    ("x y.\nLicensed under the Apache License, Version 2.0. More text", "apache-2", "Apache-2.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4", "CC-BY-NC-4.0"),
    (MIT.replace("\n", " "), "mit-grant,mit-notice,mit-as-is", "MIT"),
    ("SPDX-License-Identifier: BSD-3-Clause\nReleased under the MIT License.", "spdx-bsd-3,mit", "BSD-3-Clause,MIT"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of it.", "mit-grant", "unclear"),
    ("Released under the MIT License.\nReleased under the MIT License.", "mit,mit", "MIT"),
    ("We stood under the tree, and I read the license.", "", ""),
    (MIT, "mit-grant,mit-notice,mit-as-is", "MIT"),
    ("# SPDX-License-Identifier: MIT\nimport os\n", "spdx-mit", "MIT"),
    ("| the end |\nThis file is licensed under the\n * terms of the GNU General\n * Public License, version 2", "gpl-2", "GPL-2.0-only"),
    (None, "", ""),
    ("", "", ""),
    ("Released under the MIT License\n" + "word " * 100_000, "mit", "MIT"),
    (MIT.replace(".", ";") + " word\n" * 100_000, "mit-grant", "unclear"),
    ("under " * 50_000 + ".\nReleased under the MIT License.", "mit", "MIT"),
]


def test_cases(spark, documents):
    docs = documents([(i, t) for i, (t, _, _) in enumerate(CASES)] + [(0, CASES[0][0])])
    rows = lc.scan(docs.withColumnRenamed("lang", "licences").withColumnRenamed("source", "sentences")).collect()
    assert sorted((r.doc_id, r.sentences, r.licences) for r in rows) == sorted(
        [(i, s, x) for i, (_, s, x) in enumerate(CASES)] + [(0, "mit", "MIT")]
    )
    assert lc.scan(documents([])).count() == 0


@pytest.mark.parametrize("name, pattern", lc.SENTENCES)
def test_every_sentence_holds_a_cue_and_a_rule(name, pattern):
    assert re.search(lc.CUE, pattern.replace("[cs]", "c").replace("(s)", "s"))
    named = {i for _, ids in lc.RULES for i in ids}
    assert name in named


def test_longer_rules_stand_before_their_parts():
    for at, (_, ids) in enumerate(lc.RULES):
        for _, later in lc.RULES[at + 1 :]:
            assert not (len(later) > len(ids) and set(ids) <= set(later))


APACHE_HEADER = """   Copyright 2020 The Authors

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
ASF_HEADER = """# Licensed to the Apache Software Foundation (ASF) under one or more
# contributor license agreements.  See the NOTICE file distributed with
# this work for additional information regarding copyright ownership.
# The ASF licenses this file to You under the Apache License, Version 2.0
# (the "License"); you may not use this file except in compliance with
# the License.  You may obtain a copy of the License at
#
#    http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL_NOTICE = """    This program is free software{stop} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{comma} either version {version} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License along
    with this program; if not, see <https://www.gnu.org/licenses/>.
"""
GPL_2 = GPL_NOTICE.format(stop=";", comma=";", version=2)
GPL_3 = GPL_NOTICE.format(stop=":", comma=",", version=3)
LGPL_21 = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
 *
 * You should have received a copy of the GNU Lesser General Public
 * License along with this library; if not, write to the Free Software
 * Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA
"""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD_3 = BSD_2 + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
MIT_NOTICE = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
NOTICES = [
    (APACHE_HEADER, "Apache-2.0"),
    (APACHE_HEADER.replace('");\n   you may not', '"); you may\n   not'), "Apache-2.0"),
    (" ".join(APACHE_HEADER.split()[4:]), "Apache-2.0"),
    (ASF_HEADER, "Apache-2.0"),
    (GPL_2, "GPL-2.0-or-later"),
    (GPL_3, "GPL-3.0-or-later"),
    (" ".join(GPL_2.split()), "GPL-2.0-or-later"),
    (GPL_2.replace("License as published by\n    the", "License as\n    published by the"), "GPL-2.0-or-later"),
    (GPL_2.replace("; either version 2 of the License, or\n    (at your option) any later version", "; version 2"), "GPL-2.0-only"),
    ("\n".join(GPL_2.split("\n\n")[::2]), "GPL-2.0-or-later"),
    (LGPL_21, "LGPL-2.1-or-later"),
    (LGPL_21.replace("version 2.1", "version 3"), "LGPL-3.0-or-later"),
    (LGPL_21.replace("Lesser", "Library").replace("version 2.1", "version 2"), "LGPL-2.0-or-later"),
    (LGPL_21.replace("Lesser", "Affero").replace("version 2.1", "version 3"), "AGPL-3.0-or-later"),
    (BSD_2 + BSD_END, "BSD-2-Clause"),
    (BSD_3 + BSD_END, "BSD-3-Clause"),
    (MIT_NOTICE, "MIT"),
    (MIT_NOTICE.replace("in all\ncopies", "in\nall copies"), "MIT"),
    ('Released under the MIT License (the "License").', "MIT"),
    ("You should have received a copy of the GNU Lesser General Public License.", "unclear"),
]


def test_verbatim_notices(spark, documents):
    rows = lc.scan(documents([(i, t) for i, (t, _) in enumerate(NOTICES)])).collect()
    assert {r.doc_id: r.licences for r in rows} == {i: x for i, (_, x) in enumerate(NOTICES)}
    whole = {r.doc_id: r.sentences for r in rows}
    assert whole[0] == "apache-2,apache-comply,apache-basis" and whole[4] == "gpl-2-free,gpl-hope,gpl-copy"
