"""Licence scan: canonical digests of whole texts and of single lines, looked up by hash join.

DataFrame functions only.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Spellings held to be equal.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization",
    "organisations": "organizations", "favour": "favor", "honour": "honor", "centre": "center", "fulfil": "fulfill", "recognise": "recognize",
    "utilisation": "utilization", "initialise": "initialize", "merchantibility": "merchantability", "programme": "program", "per cent": "percent",
    "noncommercial": "non commercial", "owner": "holder", "https": "http",
}

#: Names of licences in notices, by SPDX name.
NAMES = {
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "0BSD": ["Zero-Clause BSD License", "0BSD License"],
    "BSD": ["BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0"],
    "BSL-1.0": ["Boost Software License, version 1.0", "Boost Software License 1.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0 Universal License"],
    **{f"CC-{part}-{v}": [f"CC {part} {v}", f"Creative Commons {name} {v} International License", f"Creative Commons {name} {v} License"]
       for v in ("3.0", "4.0")
       for part, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                          ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}
#: Phrases of a notice around a licence's name.
PHRASES = [f"{what}{verb} under {article}{{}}" for what in ("", "This work is ", "This software is ") for verb in ("licensed", "released") for article in ("", "the ", "the terms of the ")]
#: Notices, by SPDX name, made from the names and phrases.
NOTICES = {k: [p.format(n) for p in PHRASES for n in names] + [f"SPDX-License-Identifier: {k}"] for k, names in NAMES.items()} | {"proprietary": ["All rights reserved."]}

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Full texts of short public licences.
TEXTS = {
    "MIT": 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": f"ISC License\n\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}",
    "0BSD": f"{_GRANT}.\n\n{_ISC_END}",
    "MIT-0": 'MIT No Attribution\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": f"BSD 2-Clause License\n\n{_BSD_GRANT}\n\n1. {_BSD_SOURCE}\n\n2. {_BSD_BINARY}\n\n{_BSD_END}",
    "BSD-3-Clause": f"BSD 3-Clause License\n\n{_BSD_GRANT}\n\n1. {_BSD_SOURCE}\n\n2. {_BSD_BINARY}\n\n3. {_BSD_NAME}\n\n{_BSD_END}",
    "Zlib": "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense": 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>',
}
#: Standard headers of files under longer licences.
HEADERS = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    **{name: f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.\n\nYou should have received a copy of the GNU {kind}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
       for name, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))},
}
#: Digests of the canonical forms of long licences, whose texts stand in /usr/share/common-licenses of Debian systems.
DIGESTS = {
    "Apache-2.0": "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b",
    "Artistic-1.0": "66e644aafc5ff1de25be918be7e71d1d851bab015f750bc67c5b245e5f33ff39",
    "CC0-1.0": "6e4a79b7eaf2cdc3879a899ef330c98026c9d697ee87d41a28ac5159e8e53348",
    "GFDL-1.2": "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f",
    "GFDL-1.3": "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4",
    "GPL-1.0": "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a",
    "GPL-2.0": "c230c00f329737cb7ce3d97a266318b4c9d4c1fd321335e592b2ce1112179b88",
    "GPL-3.0": "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f",
    "LGPL-2.0": "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3",
    "LGPL-2.1": "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
}


GAPS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F©]+"
RIGHTS_LINE = r"(?md)^[^\S\n]*(?:copyright|\(c\)|©|portions copyright)[^\n]*$"
#: A text without any of these has no spelling to replace.
STEMS = [k for k in SPELLINGS if not any(o != k and o in k for o in SPELLINGS)]


def any_of(t: Column, parts: list[str]) -> Column:
    return functools.reduce(operator.or_, [t.contains(x) for x in parts])


def respelled(t: Column, spellings: dict) -> Column:
    for old, new in spellings.items():
        t = F.regexp_replace(t, rf"\b{old}\b", new)
    return t


def canonical(df: DataFrame, text: str, lines: str) -> DataFrame:
    """``text`` replaced by its canonical form, and an array column ``lines`` of the canonical forms of its lines.

    Lower case, without copyright lines, punctuation, empty lines and
    spelling variants; words joined by one space.  One pass for both: each
    step is a column of its own, so none is evaluated twice.
    """
    t = F.col(text)
    df = df.withColumn(text, F.lower(t))
    df = df.withColumn(text, F.when(any_of(t, ["copyright", "(c)", "©"]), F.regexp_replace(t, RIGHTS_LINE, " ")).otherwise(t))
    df = df.withColumn(text, F.trim(F.regexp_replace(t, GAPS, " ")))
    df = df.withColumn(text, F.when(any_of(t, STEMS), respelled(t, SPELLINGS)).otherwise(t))
    df = df.withColumn(lines, F.split(t, " ?\n[ \n]*"))
    df = df.withColumn(text, F.trim(F.array_join(lines, " ")))
    # variants of two words may stand on two lines
    two = {old: new for old, new in SPELLINGS.items() if " " in old}
    return df.withColumn(text, F.when(any_of(t, list(two)), respelled(t, two)).otherwise(t))


def digest(canonical: Column) -> Column:
    """SHA-256 of a canonical text; null where nothing is left of it."""
    return F.when(canonical != "", F.sha2(canonical, 256))


def known(texts: DataFrame) -> DataFrame:
    """(digest, length, license), a row for each canonical form, of a table (license, text); one of null if a text has no words, which equals nothing."""
    c = canonical(texts.select("license", "text"), "text", "lines")
    return c.select("license", F.length("text").alias("length"), digest(F.col("text")).alias("digest")).groupBy("digest", "length").agg(F.min("license").alias("license"))


def built_in(spark: SparkSession) -> DataFrame:
    """(digest, length, license) of the licences and notices that this module knows; length is null for those known by digest alone."""
    rows = [(k, v) for table in (TEXTS, HEADERS) for k, v in table.items()] + [(k, v) for k, vs in NOTICES.items() for v in vs]
    long = spark.createDataFrame([(d, None, k) for k, d in DIGESTS.items()], "digest string, length int, license string")
    return known(spark.createDataFrame(rows, "license string, text string")).unionByName(long)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", registry: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_digest, license, n_notice_lines, notices): a row for each row of ``docs``.

    ``license`` is the known licence whose canonical text the whole document
    equals, ``notices`` the sorted, comma-joined licences that a line of it
    equals, ``n_notice_lines`` the number of such lines.  A text is made
    canonical once, with its line ends kept; of its lines only those as long
    as a known text are hashed.

    Null and empty texts, and texts of punctuation only, have no digest; rows
    that repeat get equal results; other columns are not read; empty tables
    give an empty result, or no licences.  ``registry`` has (digest, length,
    license), a row for each digest, as ``known`` makes it from any table of
    texts; without a length a digest is compared with whole texts alone.
    """
    registry = materialize(built_in(docs.sparkSession) if registry is None else registry, "license-registry")
    # distinct lengths: at most one for each known text, and no more than the longest is long
    lengths = [r[0] for r in registry.select("length").filter("length is not null").distinct().collect()]
    lines = canonical(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "lines")
    alike = F.filter("lines", lambda line: F.length(line).isin(lengths) & (line != ""))
    marks = lines.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest(F.col("text")).alias("text_digest"), F.transform(alike, lambda line: F.sha2(line, 256)).alias("line_digests"))
    marks = materialize(marks, "license-marks")
    licenses = registry.select("digest", "license")
    found = marks.select("row", F.explode("line_digests").alias("digest")).join(licenses, "digest").groupBy("row").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    whole = marks.drop("line_digests").join(licenses.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    return whole.join(found, "row", "left").select("doc_id", "text_digest", "license", F.coalesce("n", F.lit(0)).alias("n_notice_lines"), F.coalesce("notices", F.lit("")).alias("notices"))
