"""License scans: sparse TF-IDF cosine to templates, then inheritance along paths.

Each file is read whole, line by line; a line, or a block
of adjacent lines, that holds one of ``MARKERS`` may be a header. A block ends at a line
without letters and digits, and where a comment turns into code. A file with the name of
a licence file is compared as one text too. Years and holders of a copyright are no part of a notice. Term
vectors are sparse rows (text, term, weight) joined with the templates' rows on the
term. A file without a licence of its own takes that of the nearest directory above
it that declares one, by equi-joins on the paths of its ancestors.

Only DataFrame functions are used. The templates' terms are a bounded table; document
frequencies of all other terms are counted over all files and joined by term.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import written

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_END = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_GPL_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_END = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Notices, headers and texts of public licences, as their stewards word them; the long texts of
#: Apache, GPL and CC are known by their titles and the headers that they hold.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        _MIT,
        f"MIT License Copyright {_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_END}",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _GPL.format(2), f"{_GPL.format(2)} {_GPL_END}", "GNU General Public License Version 2, June 1991"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU General Public License, version 3 or any later version.", _GPL.format(3), f"{_GPL.format(3)} {_GPL_END}", "GNU General Public License Version 3, 29 June 2007"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License.", _BSD, f"BSD 3-Clause License Copyright All rights reserved. {_BSD} {_BSD_END}"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"),
    "CC0-1.0": ("CC0 1.0 Universal, public domain dedication.",),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved.", "Copyright, all rights reserved. Unauthorised copying is prohibited."),
}
#: What a line must hold to be read as a notice, and names of licence files.
MARKERS = "licen[cs]ed?|copyright|rights reserved|redistribution|permission is|public domain|creative commons"
#: A year with its holder after "copyright", up to what else the line says; a comment's last line before code; lines without letters and digits.
HOLDER = r"(?i)copyright\s+(?:\(c\)\s*|©\s*)?[0-9]{4}[^\n]{0,200}?(all rights reserved|licen[cs]e|released|permission|distributed|\n|$)"
COMMENT_END = r"(^|\n)([ \t]*(?:#|//|/?\*|;|--|%)[^\n]*)\n([ \t]*[A-Za-z0-9_])"
BLANK_LINES = r"\n(?:[^A-Za-z0-9\n]*\n)+"
LICENCE_FILE = r"(^|/)(licen[cs]e|copying|unlicense|notice)([.-][^/]*)?$"


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def template_rows(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """(template, licence, words): one row for each notice."""
    rows = [(f"{name}#{i}", name, text) for name, texts in sorted(templates.items()) for i, text in enumerate(texts)]
    one = reduce(DataFrame.unionAll, [spark.range(1).select(F.lit(a).alias("template"), F.lit(b).alias("licence"), F.lit(c).alias("text")) for a, b, c in rows])
    return one.select("template", "licence", terms(F.col("text")).alias("words"))


def frequencies(rows: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, word, tf) of ``rows``' column words."""
    return rows.select(*ids, F.explode("words").alias("word")).groupBy(*ids, "word").agg(F.count("*").alias("tf"))


def weights(tf: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, word, w): TF-IDF of the rows (ids, word, tf, idf), scaled to length 1."""
    w = tf.withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(*ids).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, ids).select(*ids, "word", (F.col("w") / F.col("norm")).alias("w"))


def scan(files: DataFrame, *, key: str = "page_id", path: Column | None = None, text: Column | None = None, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.7) -> DataFrame:
    """One row for each row of ``files``: the key, ``path``, ``licence``, ``score`` (cosine,
    rounded to 6 digits), ``origin`` ("header", "file", "inherited" or null) and
    ``declared_in`` (the directory of an inherited licence).

    A licence is the template with the highest cosine of at least ``threshold``; ties go to
    the first by name. A directory declares what its licence file says, or else what its
    index (a path that ends in "/") says; of several, the best score, then the first by
    name. A term's document frequency is its number of files, over all files and for every
    term, whether a template has it or not. Null and empty texts have no
    licence of their own; null paths neither declare nor inherit. Repeated rows are
    files each for itself; an empty table gives an empty result. Other columns are not read.
    """
    spark = files.sparkSession
    templates = TEMPLATES if templates is None else templates
    path = F.col("path") if path is None else path
    text = F.col("text") if text is None else text
    named = template_rows(spark, templates)
    rows = files.select(F.col(key).alias("k"), path.alias("path"), text.alias("t"), F.xxhash64(F.col(key), path, text).alias("u"))
    named_rows = written(rows.select("k", "path", "u"), "licence-files")
    n = named_rows.count()
    df = rows.select(F.explode(F.array_distinct(terms(F.col("t")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    is_file = F.coalesce(F.lower("path").rlike(LICENCE_FILE), F.lit(False))
    body = F.regexp_replace("t", HOLDER, "copyright $1")
    blocks = F.split(F.regexp_replace(body, COMMENT_END, "$1$2\n\n$3"), BLANK_LINES)
    parts = F.filter(F.array_distinct(F.concat(F.split(body, "\n"), blocks)), lambda x: F.lower(x).rlike(MARKERS))
    marked = F.when(F.lower("t").rlike(MARKERS), parts).otherwise(F.array().cast("array<string>"))
    lines = rows.select("u", is_file.alias("whole"), F.posexplode(F.when(is_file, F.concat(F.array(body), marked)).otherwise(marked)).alias("line", "t"))
    texts = lines.select("u", "line", "whole", terms(F.col("t")).alias("words"))
    ids, named_ids = ["u", "line", "whole"], ["template", "licence"]
    tf, named_tf = written(frequencies(texts, ids), "licence-terms"), frequencies(named, named_ids)
    wanted = tf.select("word").unionByName(named_tf.select("word")).distinct()
    idf = written(df.join(wanted, "word", "left_semi").select("word", "df", (F.log(F.lit(n + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")), "licence-idf")
    # Terms of a thousandth of the files or more are few (a thousand times a file's terms at most) and are handed out; no other is a hot key.
    often = F.broadcast(idf.where(F.col("df") * 1000 >= n).select("word", "idf"))
    seldom = idf.where(F.col("df") * 1000 < n).select("word", "idf")
    weighed = tf.join(often, "word").unionByName(tf.join(F.broadcast(often.select("word")), "word", "left_anti").join(seldom, "word"))
    unseen = F.log(F.lit(n + 1.0)) + 1.0
    named_weighed = named_tf.join(idf.select("word", "idf"), "word", "left").withColumn("idf", F.coalesce("idf", unseen))
    cosine = (
        weights(weighed, ids)
        .join(F.broadcast(weights(named_weighed, named_ids).withColumnRenamed("w", "tw")), "word")
        .groupBy("u", "line", "whole", "template", "licence")
        .agg(F.round(F.sum(F.col("w") * F.col("tw")), 6).alias("score"))
        .where(F.col("score") >= threshold)
    )
    order = F.struct((-F.col("score")).alias("s"), "licence")
    own = cosine.groupBy("u").agg(F.min(order).alias("o"), F.max("whole").alias("whole")).select("u", "o.licence", (-F.col("o.s")).alias("score"), "whole")
    found = written(named_rows.join(own, "u", "left"), "licence-found")
    directory = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    says = found.where(F.col("licence").isNotNull() & F.col("path").isNotNull() & (F.col("whole") | F.col("path").endswith("/")))
    declared = says.groupBy(directory.alias("dir")).agg(F.min(F.struct((~F.col("whole")).alias("index"), (-F.col("score")).alias("s"), "licence")).alias("d")).select("dir", "d.licence", (-F.col("d.s")).alias("score"))
    # Ancestors of a directory: all prefixes that end in "/"; the longest that declares is the nearest.
    parts = F.split(directory, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    bare = found.where(F.col("licence").isNull() & F.col("path").isNotNull()).select(directory.alias("own_dir"), above.alias("above")).distinct()
    inherited = bare.select("own_dir", F.explode(F.array_distinct("above")).alias("dir")).join(declared, "dir").groupBy("own_dir").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "licence", "score")).alias("i"))
    inherited = written(inherited, "licence-inherited")  # one row for each directory; read anew, the join can be dealt or handed out as its size allows
    origin = F.when(F.col("whole"), "file").otherwise("header")
    declares = found.where(F.col("licence").isNotNull()).select("k", "path", "licence", "score", origin.alias("origin"), F.lit(None).cast("string").alias("declared_in"))
    # Only files without a licence of their own are joined; a hot directory is split by the join's skew rule.
    other = found.where(F.col("licence").isNull() & F.col("path").isNotNull()).select("k", "path", directory.alias("own_dir")).join(inherited, "own_dir", "left")
    other = other.select("k", "path", "i.licence", "i.score", F.when(F.col("i").isNotNull(), "inherited").alias("origin"), F.col("i.dir").alias("declared_in"))
    nowhere = found.where(F.col("licence").isNull() & F.col("path").isNull()).select("k", "path", "licence", "score", F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("declared_in"))
    out = declares.unionByName(other).unionByName(nowhere)
    # A key named like a result gives way to it.
    results = ["path", "licence", "score", "origin", "declared_in"]
    return out.select(*[F.col("k").alias(key)] * (key not in results), *results)
