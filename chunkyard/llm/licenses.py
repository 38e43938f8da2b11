"""License scans: canonical digest lookup.

A text's canonical form drops copyright lines, folds case, turns punctuation into spaces, writes
equivalent spellings one way, and joins the rest by single spaces.  Its SHA-256 is joined with the
digests of the known licences and notices: the whole text at once, and each line by itself, since a
notice such as "Licensed under ..." is an entire text of its own inside a document.

Known texts are a table of their own (any table with license_id and text; by default ``known_texts``, to which come
the digests of longer licences, whose texts need not be here).  Only digests are joined; the table is broadcast when
Spark's own size limit for that allows it, and hash-joined otherwise.  Documents are read and brought to their canonical
form once: a row's whole digest and its lines' go through one join, and only the whole and what matched are
gathered again by row.

Edge cases: null text is empty; a text without words has the digest of the empty text and matches
nothing; a text of copyright lines only is such a text; several known ids with one canonical form
give the smallest id; repeated rows, and rows with one or no doc_id, are each reported by their own text; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, as in the public SPDX matching guidelines.
EQUAL_WORDS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize", "modelled": "modeled",
    "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Texts and notices of public licences.
_BSD_OPEN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
KNOWN_TEXTS = {
    "MIT": 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": _BSD_OPEN + _BSD_END,
    "BSD-3-Clause": _BSD_OPEN + _BSD_NAME + _BSD_END,
}
KNOWN_TEXTS |= {
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>',
}
KNOWN_NOTICES = {
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:MIT": "Released under the MIT License.",
    "notice:MIT-2": "Licensed under the MIT License.",
    "notice:BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "notice:GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "notice:MPL-2.0": "This work is licensed under the Mozilla Public License, version 2.0.",
    "notice:CC0-1.0": "Licensed under CC0 1.0.",
    "notice:CC-BY-4.0": "Licensed under CC BY 4.0.",
    "notice:CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "notice:CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "notice:CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "notice:all-rights-reserved": "All rights reserved.",
}

# SHA-256 of the canonical forms of further public licence texts, in their usual line breaks.
KNOWN_DIGESTS = {
    "Apache-2.0": "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100",
    "Artistic-1.0-Perl": "ddb49d591ecc4f65a223b9f53f330918100c323532a653c090d21b38e35a3a42",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f",
    "GFDL-1.3": "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4",
    "GPL-1.0": "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c",
    "GPL-2.0": "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1",
    "GPL-3.0": "59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349",
    "LGPL-2.0": "b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c",
    "LGPL-2.1": "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
}

COPYRIGHT_LINE = r"^[^a-z0-9]*(copyright|\(c\)|©)"
NOT_WORDS = r"[^\p{L}\p{N}]+"


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted({**KNOWN_TEXTS, **KNOWN_NOTICES}.items()), "license_id string, text string")


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line that is not a copyright line; lines without words are left out."""
    equal = F.create_map(*[F.lit(x) for pair in EQUAL_WORDS.items() for x in pair])
    kept = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda line: ~line.rlike(COPYRIGHT_LINE))
    spaced = F.filter(F.transform(kept, lambda line: F.trim(F.regexp_replace(line, NOT_WORDS, " "))), lambda line: line != "")
    return F.transform(spaced, lambda line: F.array_join(F.transform(F.split(line, " ", -1), lambda w: F.coalesce(F.element_at(equal, w), w)), " "))


def with_digest(rows: DataFrame) -> DataFrame:
    lines = rows.withColumn("lines", canonical_lines(F.col("text")))
    return lines.withColumn("digest", F.sha2(F.array_join("lines", " "), 256))


def known_digests(known: DataFrame | None, spark: SparkSession) -> DataFrame:
    """digest and license_id of the known texts, or of those that this module knows."""
    digests = with_digest((known if known is not None else known_texts(spark)).select("license_id", "text")).where(F.size("lines") > 0).select("license_id", "digest")
    if known is None:
        digests = digests.unionByName(spark.createDataFrame(sorted(KNOWN_DIGESTS.items()), "license_id string, digest string"))
    return digests.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (of the whole text, or null), notices (sorted ids of lines that are known texts)."""
    asked = lambda whole, digest: F.struct(F.lit(whole).alias("whole"), digest.alias("digest"))
    each = F.transform(F.array_distinct("lines"), lambda line: asked(False, F.sha2(line, 256)))
    rows = with_digest(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))
    parts = rows.select("row", "doc_id", F.explode(F.concat(F.array(asked(True, F.col("digest"))), each)).alias("a")).select("row", "doc_id", "a.whole", "a.digest")
    found = parts.join(known_digests(known, docs.sparkSession), "digest", "left").where(F.col("whole") | F.col("license_id").isNotNull())
    own = lambda c, whole: F.when(F.col("whole") if whole else ~F.col("whole"), F.col(c))
    gathered = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max(own("digest", True)).alias("digest"), F.max(own("license_id", True)).alias("license_id"), F.array_sort(F.collect_set(own("license_id", False))).alias("notices"))
    return gathered.select("doc_id", "digest", "license_id", "notices")
