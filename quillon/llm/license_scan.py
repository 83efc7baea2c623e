"""License scans: sparse TF-IDF cosine of headers, licence files and lines to templates, then inheritance from the
nearest ancestor directory.

All of it is DataFrame expressions. Compared are a file's blocks (lines up to a blank one: a header, a comment, a
paragraph of a licence), the whole text of a licence file, and single lines. The templates are the only side that is
broadcast, and they are fixed. A unit can reach the threshold only if it has one of a template's rarer terms (the
commoner ones alone stay below it), and only if its cosine would with all terms that no template has weighed as little
as can be; other units are not taken apart.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, materialize

#: Statements, notices and licence texts by which files name their licence.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("proprietary", "All rights reserved."),
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
]
for _name in sorted({n for n, _ in TEMPLATES} - {"proprietary"}):
    for _ending in ("", "-only", "-or-later") if "GPL" in _name else ("",):
        TEMPLATES.append((_name, f"SPDX-License-Identifier: {_name}{_ending}"))

_TOKEN = "[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]"
#: What lies between two blocks.
BLANK_LINES = r"\n(?:[ \t\x0b\f\r]*\n)+"
#: Names of licence files.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$"


def _tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def _lower(text: Column) -> Column:
    """A-Z lower-cased. Two other letters have a lower case with one of a-z in it; without them lower() is as good, and
    much faster than a translation of each letter."""
    return F.when(text.contains("\u0130") | text.contains("\u212a"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _any_of(words: list[str]) -> str:
    """A regular expression for any of the words, letters that they begin with written once."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(c) + _any_of(rest) if c else "" for c, rest in sorted(by.items(), reverse=True)]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def document_frequencies(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): how many of all files have each of all their terms, as a table. The empty term stands for all files."""
    # a full stop or hyphen at a word's end is not part of it
    text = F.trim(_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(".+-"))
    own = F.array_union(F.split(text, "[.+-]*[^a-z0-9.+-]+[.+-]*"), F.array(F.lit("")))
    return materialize(files.select(F.explode(own).alias("term")).groupBy("term").agg(F.count("*").alias("n")), "license-frequencies")


def license_scan(files: DataFrame, least: float = 0.8, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """files (id_col, path_col, text_col) to (id_col, license string, score double, how string, directory string), a row
    per file.

    Units are lines, blocks of lines between blank ones, and the whole text where the path's name is that of a licence
    file (LICENSE, LICENCE, COPYING or NOTICE, any ending). A unit's weights are term count times
    ln((1 + files) / (1 + files with the term)) + 1, counted over all files and whole texts. A file's own licence is the
    template with the highest cosine of any of its units, rounded to six places, `least` at least (how 'own'); of equal
    ones the first in the list. A file without one takes that of the nearest directory above it in which a licence file
    has one: of several the highest cosine, then the least path (how 'inherited', with the directory). Others have nulls.
    Null and empty texts have no units that match; a null path has no directory, and its text is scored like any other's.
    Rows that share an id and a path (null ids among them) are scored as one file and come out once each. Other columns
    do not matter.
    """
    frequencies = document_frequencies(files, text_col)
    known = sorted({t for _, s in TEMPLATES for t in _tokens(s)})
    frequency = {r["term"]: int(r["n"]) for r in frequencies.where(F.col("term").isin(["", *known])).collect()}
    total = frequency.get("", 0)
    idf = {t: math.log((1 + total) / (1 + frequency.get(t, 0))) + 1 for t in known}
    parts, cues = [], set()
    for number, (name, statement) in enumerate(TEMPLATES):
        tokens = _tokens(statement)
        weights = {t: tokens.count(t) * idf[t] for t in tokens}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        common, limit = 0.0, ((least - 1e-6) * norm) ** 2
        for t, w in sorted(weights.items(), key=lambda x: (idf[x[0]], x[0])):
            common += w * w
            if common >= limit:
                cues.add(t)
        parts += [(number, name, t, w / norm) for t, w in weights.items()]
    spark = files.sparkSession
    templates = F.broadcast(spark.createDataFrame(parts, "number int, name string, term string, part double"))
    own = files.select(F.col(id_col).alias("_q_id"), F.col(path_col).alias("_q_path"), F.coalesce(text_col, F.lit("")).alias("_q_text"))
    steps = F.split("_q_path", "/")
    is_file = F.coalesce(F.element_at(steps, -1).rlike(LICENSE_FILE), F.lit(False))
    cue = "(?i)(?<![a-z0-9])" + _any_of(sorted(cues)) + "(?![a-z0-9])"
    blocks = F.filter(F.split("_q_text", BLANK_LINES), lambda x: x.contains("\n"))
    units = F.array_distinct(F.concat(F.split("_q_text", "\n"), blocks, F.when(is_file, F.array("_q_text")).otherwise(F.array().cast("array<string>"))))
    cued = own.where(F.col("_q_text").rlike(cue)).select("_q_id", "_q_path", F.explode(F.filter(units, lambda x: x.rlike(cue))).alias("content"))
    found_in = materialize(cued, "license-units")
    # a unit that many files have is scored once
    kinds = materialize(found_in.select("content").distinct().withColumn("unit", F.monotonically_increasing_id()), "license-kinds")
    # By the templates' terms alone, every other one counted at the least weight there is: what stays below the threshold
    # even so (a page of prose around a word like license) need not be taken apart.
    tokens = F.regexp_extract_all(_lower(F.col("content")), F.lit(_TOKEN), F.lit(0))
    listed = F.filter("tokens", lambda t: t.isin(known))
    some = kinds.select("unit", tokens.alias("tokens")).select("unit", listed.alias("listed"), (F.size(F.array_distinct("tokens")) - F.size(F.array_distinct(listed))).alias("others"))
    weights = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    some = some.select("unit", "others", F.explode("listed").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("c"), F.first("others").alias("others"))
    some = some.join(weights, "term").select("unit", "term", "others", (F.col("c") * F.col("idf")).alias("w"))
    at_least = some.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w")) + F.first("others")).alias("norm"))
    most = some.join(templates, "term").groupBy("unit", "number").agg(F.sum(F.col("w") * F.col("part")).alias("dot")).groupBy("unit").agg(F.max("dot").alias("dot"))
    likely = most.join(at_least, "unit").where(F.col("dot") >= (least - 1e-6) * F.col("norm")).select("unit")
    kinds, all_kinds = materialize(kinds.join(likely, "unit"), "license-likely"), kinds
    discard(all_kinds)
    terms = kinds.select("unit", F.explode(tokens).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("c"))
    # a table of its own: of the join that follows Spark can then split a frequent term's units
    terms = materialize(terms, "license-terms")
    weighed = terms.join(frequencies, "term").select("unit", "term", (F.col("c") * (F.log((1.0 + total) / (1 + F.col("n"))) + 1)).alias("w"))
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(templates, "term").groupBy("unit", "number", "name").agg(F.sum(F.col("w") * F.col("part")).alias("dot"))
    near = dots.join(norms, "unit").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= least)
    near = near.groupBy("unit").agg(F.max(F.struct("cosine", F.negative("number").alias("rank"), "name")).alias("best"))
    near = materialize(near.join(kinds, "unit").select("content", "best"), "license-matches")
    best = found_in.join(near, "content").groupBy("_q_id", "_q_path").agg(F.max("best").alias("best"))
    best = materialize(best.select(F.col("_q_id").alias("_i"), F.col("_q_path").alias("_p"), F.col("best.name").alias("license"), F.col("best.cosine").alias("score")), "license-found")
    same = F.col("_q_id").eqNullSafe(F.col("_i")) & F.col("_q_path").eqNullSafe(F.col("_p"))
    found = own.select("_q_id", "_q_path").join(best.hint("merge"), same, "left").drop("_i", "_p")
    depth = F.size(steps) - 1
    directory = F.when(depth > 0, F.array_join(F.slice(steps, 1, depth), "/")).otherwise("")
    # the licence files are among what was found: no text is read again
    of = F.split("_p", "/")
    above_it = F.when(F.size(of) > 1, F.array_join(F.slice(of, 1, F.greatest(F.size(of) - 1, F.lit(1))), "/")).otherwise("")
    given = best.where(F.element_at(of, -1).rlike(LICENSE_FILE)).select(above_it.alias("directory"), F.struct(F.negative("score").alias("s"), F.col("_p").alias("p"), F.col("license").alias("l")).alias("x"))
    given = given.groupBy("directory").agg(F.min("x").alias("x")).select("directory", F.col("x.l").alias("from_dir"), F.negative("x.s").alias("dir_score"))
    # directories of files that have none of their own, each with every one above it; files of one ask alike
    asking = found.where(F.col("license").isNull() & F.col("_q_path").isNotNull()).select(directory.alias("of_dir"), F.when(depth > 0, F.slice(steps, 1, depth)).otherwise(F.array().cast("array<string>")).alias("path")).distinct()
    asked = asking.select("of_dir", "path", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("level"))
    asked = asked.select("of_dir", "level", F.when(F.col("level") > 0, F.array_join(F.slice("path", 1, F.greatest("level", F.lit(1))), "/")).otherwise("").alias("directory"))
    # a table of its own: of the join that follows Spark can then split a large directory's files
    above = asked.join(given, "directory").groupBy("of_dir").agg(F.max(F.struct("level", "directory", "from_dir", "dir_score")).alias("up"))
    above = materialize(above.select("of_dir", "up.directory", "up.from_dir", "up.dir_score"), "license-directories")
    out = found.withColumn("of_dir", F.when(F.col("license").isNull() & F.col("_q_path").isNotNull(), directory)).join(above, "of_dir", "left")
    for done in (frequencies, found_in, kinds, terms, near):
        discard(done)
    return out.select(
        F.col("_q_id").alias(id_col),
        F.coalesce("license", "from_dir").alias("license"),
        F.coalesce("score", "dir_score").alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("from_dir").isNotNull(), "inherited").alias("how"),
        F.when(F.col("license").isNull(), F.col("directory")).alias("directory"),
    )
