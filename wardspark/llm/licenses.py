"""Licence scans by Dice coefficients over word bigrams (operator 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clean_words, sized, stored

# Notices by which works in public are put under common licences (name, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: The start of both BSD texts: by itself it doesn't tell which.
BSD_HEADING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = next(text for _, text in TEMPLATES if text.startswith("Permission is hereby granted"))
_ISC = next(text for name, text in TEMPLATES if name == "ISC")
_MIT_END = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_END = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE_END = " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."


def _gnu(license: str, version: str, this: str = "This program", stop: str = ":") -> str:
    """The notice of all paragraphs that GNU licences ask for at the top of a source file."""
    purpose = {"Lesser General": "Lesser ", "Affero General": "Affero "}.get(license, "")
    name = f"GNU {license} Public License"
    short = f"GNU {purpose}General Public License"
    end = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA." if version == "2" else ". If not, see <https://www.gnu.org/licenses/>."
    return (
        f"{this} is free software{stop} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{';' if version[0] == '2' else ','} either version {version} of the License, or (at your option) any later version. "
        f"{this} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {short} for more details. "
        f"You should have received a copy of the {short} along with this program{end}"
    )


#: Whole notices and licence texts, as they stand in files; TEMPLATES has their first sentences.
WHOLE_TEMPLATES = (
    ("MIT", _MIT + _MIT_END),
    ("Apache-2.0", next(text for name, text in TEMPLATES if name == "Apache-2.0" and "you may not" in text) + _APACHE_END),
    ("GPL-2.0-or-later", _gnu("General", "2", stop=";")),
    ("GPL-3.0-or-later", _gnu("General", "3")),
    ("LGPL-2.1-or-later", _gnu("Lesser General", "2.1", "This library", ";")),
    ("LGPL-3.0-or-later", _gnu("Lesser General", "3")),
    ("AGPL-3.0-or-later", _gnu("Affero General", "3")),
    ("BSD-2-Clause", BSD_HEADING + _BSD_CLAUSES + _BSD_END),
    ("BSD-3-Clause", BSD_HEADING + _BSD_CLAUSES + _BSD_THIRD + _BSD_END),
    ("ISC", _ISC + _ISC_END),
)


def default_templates(spark: SparkSession) -> DataFrame:
    named = [("BSD-2-Clause OR BSD-3-Clause" if text == BSD_HEADING else name, text) for name, text in TEMPLATES]
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in [*named, *WHOLE_TEMPLATES]])
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.license", "t.text")


def word_hashes(column: str):
    return F.transform(clean_words(F.col(column)), lambda w: F.xxhash64(w))


def bigrams(words):
    """Different word bigrams, as hashes, of a column of arrays of word hashes; one word is a bigram by itself."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))
    return F.array_distinct(F.when(F.size(words) >= 2, pairs).otherwise(words))


def license_matches(
    docs: DataFrame, templates: DataFrame | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document and passage that matches: doc_id, unit, place, license, dice.

    Passages are each line (unit 'line', place from 0), each paragraph of several lines (blank
    lines separate them) and the whole text if it has several paragraphs. A passage matches the
    template of highest Dice coefficient 2 x shared / (own + template) over different word bigrams,
    if that is at least ``threshold``; ties go to the smaller license name. A passage of n bigrams
    is only compared with templates of n t / (2 - t) to n (2 - t) / t bigrams, beyond which the
    coefficient can't be reached.

    Runs of consecutive lines (unit 'run', place is the first line) are passages, too, of any
    length: a notice may stand among other lines. Of runs and lines of a text that match and overlap,
    the one with most shared less foreign bigrams counts, then the higher coefficient; it is a row
    if it has several lines, even if it is a whole paragraph.

    Null, empty and wordless texts match nothing; null ids are dropped; rows that repeat an id
    are taken together. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    t = default_templates(spark) if templates is None else templates
    t = t.select("license", word_hashes("text").alias("w")).select("license", bigrams(F.col("w")).alias("grams")).where(F.size("grams") > 0).distinct()
    t = stored(t.withColumn("tid", F.xxhash64("license", "grams")).select("tid", "license", F.size("grams").alias("tn"), "grams"), "license-templates")
    bounds = t.agg(F.min("tn").alias("a"), F.max("tn").alias("b")).first()
    if bounds["a"] is None:
        return rows.select("doc_id", F.lit("").alias("unit"), F.lit(0).alias("place"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).where("false")
    ratio = (2 - threshold) / threshold
    least, most = int(bounds["a"] / ratio), int(bounds["b"] * ratio + 1)

    paragraphs = F.split("text", r"\n[ \t\r]*\n\s*")
    several = F.filter(F.transform(paragraphs, lambda p, i: F.struct(F.lit("paragraph").alias("unit"), i.alias("place"), p.alias("passage"))), lambda p: F.contains(p["passage"], F.lit("\n")))
    lines = F.transform(F.split("text", "\n"), lambda p, i: F.struct(F.lit("line").alias("unit"), i.alias("place"), p.alias("passage")))
    whole = F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("place"), F.col("text").alias("passage"))))
    passages = rows.select("doc_id", F.explode(F.concat(lines, several, F.coalesce(whole, F.slice(lines, 1, 0)))).alias("x")).select("doc_id", "x.*")
    # Each step is a projection of its own, so that words and bigrams are made once a passage. What filters
    # and joins test comes out of an outer explode, as Spark would push a test of the arrays below their making.
    words = passages.select("doc_id", "unit", "place", word_hashes("passage").alias("w"))
    sets = words.select("doc_id", "unit", "place", bigrams(F.col("w")).alias("grams"))
    sets = sets.select("doc_id", "unit", "place", F.when(F.size("grams").between(max(1, least), most), F.col("grams")).alias("grams"))
    own = sets.select("doc_id", "unit", "place", F.explode_outer(F.transform("grams", lambda g: F.struct(F.size("grams").alias("n"), g.alias("gram")))).alias("x"))
    own = own.select("doc_id", "unit", "place", "x.n", "x.gram")
    theirs = F.broadcast(t.select("tid", "tn", F.explode("grams").alias("gram")))  # the templates, a fixed table
    fits = (F.col("n") >= F.col("tn") / ratio - 1e-9) & (F.col("n") <= F.col("tn") * ratio + 1e-9)
    shared = own.join(theirs, (own["gram"] == theirs["gram"]) & fits).groupBy("doc_id", "unit", "place", "n", "tid", "tn").agg(F.count(F.lit(1)).alias("shared"))
    dice = (2 * F.col("shared") / (F.col("n") + F.col("tn"))).alias("dice")
    scored = shared.select("doc_id", "unit", "place", "tid", dice).where(F.col("dice") >= threshold)
    scored = scored.join(F.broadcast(t.select("tid", "license")), "tid")
    best = Window.partitionBy("doc_id", "unit", "place").orderBy(F.desc("dice"), "license")
    fixed = scored.withColumn("k", F.row_number().over(best)).where("k = 1").select("doc_id", "unit", "place", "license", "dice")
    return fixed.unionByName(_runs(rows, t, threshold))


def _runs(rows: DataFrame, t: DataFrame, threshold: float) -> DataFrame:
    """Rows of the unit 'run' of license_matches; t has tid, license, tn and grams."""
    ratio = (2 - threshold) / threshold
    rows = rows.where(F.contains("text", F.lit("\n"))).select("doc_id", F.xxhash64("text").alias("copy"), "text")
    words = rows.select("doc_id", "copy", word_hashes("text").alias("w"))
    own = words.select("doc_id", "copy", F.explode(bigrams(F.col("w"))).alias("gram"))
    theirs = F.broadcast(t.select("tid", "tn", F.explode("grams").alias("gram")))
    # Whatever reaches the threshold shares so many bigrams with its template, so its text does.
    shared = own.join(theirs, "gram").groupBy("doc_id", "copy", "tid", "tn").agg(F.count(F.lit(1)).alias("s"))
    near = stored(shared.where(F.col("s") >= F.col("tn") / ratio - 1e-9).select("doc_id", "copy", "tid"), "license-candidates")

    # A text is picked by its hash alone, which makes a small table; what else has the hash falls out when candidates are joined.
    picked = sized(stored(near.select("copy").distinct(), "license-texts-picked"), 24)
    few = rows.join(picked, "copy", "left_semi").dropDuplicates(["doc_id", "copy"])
    lines = few.select("doc_id", "copy", F.posexplode(F.split("text", "\n")).alias("line", "text")).select("doc_id", "copy", "line", F.posexplode(word_hashes("text")).alias("at", "w"))
    order = Window.partitionBy("doc_id", "copy").orderBy("line", "at")
    place = lines.select("doc_id", "copy", "line", F.row_number().over(order).alias("j"), F.xxhash64("w", F.lead("w").over(order)).alias("gram"), F.lead("line").over(order).alias("stop"))
    # A bigram is new to a run from line a if it occurred last before a.
    again = Window.partitionBy("doc_id", "copy", "gram").orderBy("j")
    place = place.where("stop is not null").withColumn("last", F.coalesce(F.lag("line").over(again), F.lit(-1)))
    # Places count from 1 without gaps, so j is the place in the array, and j0 that of the first bigram of the line.
    place = place.withColumn("j0", F.min("j").over(Window.partitionBy("doc_id", "copy", "line")))
    texts = stored(place.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("j", "line", "stop", "last", "j0", "gram"))).alias("g")), "license-texts")

    tried = near.join(texts, ["doc_id", "copy"]).join(F.broadcast(t), "tid")
    hits = F.transform("g", lambda x: F.struct(x["line"].alias("line"), x["stop"].alias("stop"), x["last"].alias("last"), x["j0"].alias("j0"), F.array_contains("grams", x["gram"]).alias("hit")))
    marked = stored(tried.select("doc_id", "copy", "license", "tn", hits.alias("g")), "license-hits")
    # Of the distinct bigrams from line a on, in order, no more than ``most`` can lie in a run that matches; they stand in a stretch of some times
    # that, or else in the rest of the text. A start that can't reach the hits that the threshold needs goes at once.
    most = F.floor(F.col("tn") * ratio + 1e-9).cast("int") + 1

    def fresh_from(j0):
        first = F.get("g", j0 - 1)["line"]
        new = lambda part: F.slice(F.filter(part, lambda x: x["last"] < first), F.lit(1), most)
        near_by = new(F.slice("g", j0, most * 4))
        enough = (F.size(near_by) >= most) | (j0 + most * 4 > F.size("g"))
        return F.struct(first.alias("a"), F.when(enough, near_by).otherwise(new(F.slice("g", j0, F.size("g")))).alias("g"))

    starts = F.transform(F.array_distinct(F.filter("g", lambda x: x["hit"])["j0"]), fresh_from)
    fresh = marked.select("doc_id", "copy", "license", "tn", F.explode_outer(starts).alias("x")).select("doc_id", "copy", "license", "tn", "x.*")
    fresh = fresh.where(F.size(F.filter("g", lambda x: x["hit"])) >= F.col("tn") / ratio - 1e-9)
    # A run ends best where it shares one bigram more.
    ends = fresh.select("*", F.explode(F.array_distinct(F.filter("g", lambda x: x["hit"])["stop"])).alias("b"))
    ends = ends.select("doc_id", "copy", "license", "tn", "a", "b", F.filter("g", lambda x: x["stop"] <= F.col("b")).alias("g"))
    sizes = ends.select("doc_id", "copy", "license", "tn", "a", "b", F.size("g").alias("n"), F.size(F.filter("g", lambda x: x["hit"])).alias("s"))
    fit = sizes.select("doc_id", "copy", "license", "a", "b", "n", "s", (2 * F.col("s") / (F.col("n") + F.col("tn"))).alias("dice"))
    fit = fit.where(F.col("dice") >= threshold)
    ranked = F.struct((F.col("n") - 2 * F.col("s")).alias("rank"), (-F.col("dice")).alias("less"), "license", "a", "b", "dice")
    matches = fit.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(ranked)).alias("m"))
    chosen = F.aggregate(
        "m", F.slice("m", 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["a"] <= x["b"]) & (y["b"] >= x["a"])), acc).otherwise(F.array_append(acc, x)),
    )
    found = matches.select("doc_id", F.explode(F.filter(chosen, lambda x: x["a"] < x["b"])).alias("x"))
    return found.select("doc_id", F.lit("run").alias("unit"), F.col("x.a").alias("place"), "x.license", "x.dice").distinct()
