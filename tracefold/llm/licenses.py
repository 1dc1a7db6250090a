"""License scans by lookup of canonical digests.

Known licences are a table of digests: those of the texts here, and those in licenses.tsv (name, digest,
characters of the canonical form), which `digests` has made of public licence texts. Texts are brought to a canonical form: case, copyright lines, punctuation, white space and equivalent
spellings no longer tell them apart. Whole texts, and single lines, are then hash-joined by the SHA-256
of that form to the digests of known licences and notices. Lines are looked up only if some known form has
as many characters.

Defined cases: null and empty texts have the digest of the empty string and no licence; known texts
whose form is empty are ignored; several known licences of one digest are told in order, joined by
commas; a null id is kept; repeated rows each get their result; an empty table gives an empty result;
other columns are not read. Letters beyond ASCII keep their case.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal, each replaced by the second.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("merchantibility", "merchantability"),
    ("copyright holder", "copyright owner"),
    ("https://", "http://"),
)
#: Lines that name an owner; a line of a text that goes on with "copyright notice" is none.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[ :]*(\(c\)|©|[0-9<\[])|\(c\)|©|all rights reserved)[^\n]*"
_OWNERS = ("copyright", "(c)", "©", "all rights reserved")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Typographic marks that count as punctuation.
MARKS = "“”‘’–—•«» \r\t"

#: Known digests, of about 100 bytes each, that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 10_000
#: Lengths of known forms that lines are told by; with more of them every line is looked up.
LENGTHS = 2000
#: Equal rows are counted and written out again in runs of this length.
RUN = 10_000
TABLE = Path(__file__).with_name("licenses.tsv")
#: Public notices and short licences.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_AUTHOR = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_FREE = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "MIT License\nCopyright (c) <year> <owner>\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY),
    ("ISC", "ISC License\nCopyright <year> <owner>\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _AUTHOR),
    ("BSD-2-Clause", "Copyright (c) <year>, <owner>\n" + _BSD + _BSD_WARRANTY),
    ("BSD-3-Clause", "Copyright (c) <year>, <owner>\n" + _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_WARRANTY),
    ("MIT-0", "MIT No Attribution\nCopyright <year> <owner>\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n" + _WARRANTY),
    ("Zlib", "Copyright (c) <year> <owner>\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n" + _FREE + "\nFor more information, please refer to <https://unlicense.org>"),
    ("Apache-2.0", "Copyright <year> <owner>\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("0BSD", "Copyright (C) <year> by <owner>\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _AUTHOR),
)


def known_texts(spark: SparkSession) -> DataFrame:
    """(license, text) of the notices and licences listed here."""
    return spark.createDataFrame(list(KNOWN), "license string, text string")


def listed() -> list[tuple[str, str, int]]:
    """(license, digest, characters) of the licences in licenses.tsv."""
    return [(name, digest, int(size)) for name, digest, size in (line.split("\t") for line in TABLE.read_text().splitlines())]


def known_digests(spark: SparkSession) -> DataFrame:
    """(license, digest, characters) of all licences that come with the library."""
    return digests(known_texts(spark)).unionAll(spark.createDataFrame(listed(), "license string, digest string, characters int"))


def digests(known: DataFrame, *, name: str = "license", text: str = "text") -> DataFrame:
    """(license, digest, characters) of a table of licence texts: what `scan` looks texts up in."""
    forms = known.select(F.col(name).alias("license"), whole_form(canonical(F.col(text))).alias("form")).where("form <> ''")
    return forms.select("license", F.sha2("form", 256).alias("digest"), F.length("form").alias("characters"))


def canonical(text: Column) -> Column:
    """The canonical form, with its line breaks: words of ASCII letters and digits, and other characters as they are."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER + MARKS, LOWER + " " * len(MARKS))
    out = F.when(reduce(Column.__or__, (out.contains(mark) for mark in _OWNERS)), F.regexp_replace(out, COPYRIGHT_LINE, "\n")).otherwise(out)
    for spelling, plain in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(plain))
    return F.regexp_replace(out, r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def whole_form(form: Column) -> Column:
    """The canonical form without line breaks, which may have stood within spellings of several words."""
    out = F.trim(F.regexp_replace(form, r"[ \n]+", " "))
    for spelling, plain in SPELLINGS:
        if " " in spelling:
            out = F.replace(out, F.lit(spelling), F.lit(plain))
    return out


def scan(df: DataFrame, known: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, digest, license (of the whole text), notices (licences of its lines, in order, joined by commas; else null).

    `known` is (license, digest, characters), as `digests` gives it.
    """
    named = known.groupBy(F.col("digest").alias("known")).agg(F.array_sort(F.collect_set("license")).alias("names"))
    lengths = [r[0] for r in known.select("characters").distinct().limit(LENGTHS + 1).collect()]
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        named = F.broadcast(named)

    rows = df.select(F.col(key).alias("key"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("raw"), canonical(F.col(text)).alias("form"))
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.sha2(whole_form(F.col("form")), 256).alias("digest")))
    wanted = (lambda line: F.length(line).isin(lengths)) if len(lengths) <= LENGTHS else lambda line: line != ""
    written = F.filter(F.transform(F.split("form", "\n"), lambda line: F.trim(line)), wanted)
    lines = F.transform(written, lambda line: F.struct(F.lit(False).alias("whole"), F.sha2(line, 256).alias("digest")))
    parts = rows.select("key", "raw", F.explode(F.concat(whole, lines)).alias("part")).select("key", "raw", "part.*")
    told = parts.join(named, F.col("digest") == F.col("known"), "left").where("whole OR names IS NOT NULL")
    # one row for each text that is kept, and one for each line that is a notice
    texts = told.groupBy("key", "raw").agg(
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("whole"), F.array_join("names", ","))).alias("license"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("whole"), F.col("names")))))).alias("found"),
        F.count(F.when(F.col("whole"), 1)).alias("n"),
    )
    runs = texts.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    each = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)))
    return each.select("key", "digest", "license", F.when(F.size("found") > 0, F.array_join("found", ",")).alias("notices"))
