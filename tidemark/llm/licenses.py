"""License scan: text units compared with license templates by the Dice coefficient over word bigrams.

Units are the lines of a document, its blocks (two or more lines between blank lines), and its runs of two or more
neighbouring blocks, up to the whole text. Normalised words are lower-case runs of letters and digits.
With a and b distinct bigrams, Dice = 2 * shared / (a + b) >= t needs b * t / (2 - t) <= a <= b * (2 - t) / t: a unit
outside these bounds of every template makes no row, and a (unit, template) pair outside them is dropped in the
join on bigrams. Runs are built only for a document and a template where the document has the t / (2 - t) of the
template's bigrams that every run needs.

Defined results: one row for each line or block that reaches the threshold, with its best template (ties: the smaller
name). Runs that reach it overlap, so of those with one best template a run makes a row, numbered by its first block,
if it is the best from its first block and the best of these to its last block, single blocks included (ties: shorter);
null, empty and one-word texts have no bigrams and no rows; texts of any length are compared whole; rows equal in id and
text are reported one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import saved, table
from tidemark.llm.license_texts import TEXTS

#: Between blocks: at least one blank line.
GAP = r"\n[\x20\x09-\x0D]*\n"
#: Percent.
THRESHOLD = 80
#: Templates with more bigrams than this in all are joined by shuffle and not broadcast.
BROADCAST_BIGRAMS = 100_000
#: Notices as projects print them, and licenses in full.
TEMPLATES = {
    **TEXTS,
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "MIT/line": "Released under the MIT License.",
    "MIT/project": "This project is licensed under the MIT License.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Reserved/line": "Copyright. All rights reserved worldwide.",
    "Reserved/short": "All rights reserved.",
    "Reserved/copyright": "Copyright. All rights reserved.",
    "Reserved/copyright-c": "Copyright (c). All rights reserved.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def bigrams_of(body: Column, bounds: list[tuple[float, float]] | None = None) -> Column:
    """Distinct word bigrams; none where their number is outside all bounds. The nested transforms bind the words
    and the bigrams once: Spark would otherwise copy their expressions into each place that reads them."""
    pairs = F.transform(F.array(normal_words(body)), lambda w: F.when(F.size(w) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(w[i], F.lit(" "), w[i + 1])))).otherwise(F.array().cast("array<string>")))
    if bounds is not None:
        near = lambda n: F.exists(F.array(*[F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for lo, hi in bounds]), lambda x: n.between(x["lo"], x["hi"]))
        pairs = F.transform(pairs, lambda b: F.when(near(F.size(b)), b).otherwise(F.array().cast("array<string>")))
    return pairs[0]


def merged(bounds: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(bounds):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_no, doc_id, unit, unit_no, body): lines and blocks of two lines or more. row_no tells equal rows apart."""
    keyed = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).alias("doc_id"), F.split(text, "\n").alias("line"), F.split(text, GAP).alias("block"))
    parts = [keyed.select("row_no", "doc_id", F.lit(kind).alias("unit"), F.posexplode_outer(kind).alias("unit_no", "body")) for kind in ("line", "block")]
    return parts[0].union(parts[1].where("instr(trim(BOTH '\\n' FROM body), '\\n') > 0"))


def needed_words(templates: dict[str, list[str]], threshold: int) -> list[str]:
    """Words of which a document has at least one, if it has the t / (2 - t) of a template's bigrams that a run needs: a
    template's longest words until so many of its bigrams hold one that too few would be left. Long words are rare ones."""
    out: set[str] = set()
    for bigrams in templates.values():
        spare, left = len(bigrams) - -(-len(bigrams) * threshold // (200 - threshold)), [b.split(" ") for b in bigrams]
        for w in sorted({w for b in left for w in b}, key=lambda w: (-len(w), w)):
            if len(bigrams) - len(left) > spare:
                break
            out, left = out | {w}, [b for b in left if w not in b]
    return sorted(out)


def runs(docs: DataFrame, listed: DataFrame, threshold: int, without: list[str]) -> DataFrame:
    """The rows of runs of blocks, from keyed documents (doc_id, text_hash, text) and listed bigrams. Documents that have
    none of the words ``without`` have no runs.

    A pair of neighbouring words stands in the blocks ``b`` and ``at`` (the same, or neighbours), and so in the runs from
    first to last with first <= b and at <= last. With ``lo`` the greatest b of the same bigram's pairs before it, it is
    the bigram's first pair in a run if lo < first <= b: counts of these by block add up to the run's distinct bigrams.
    """
    key, need = ["doc_id", "text_hash"], threshold / (200 - threshold)
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    words = F.flatten(F.transform(F.split("text", GAP), lambda body, i: F.transform(normal_words(body), lambda w: F.struct(w.alias("w"), i.alias("b")))))
    pairs = F.transform(F.array(words), lambda w: F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.struct(F.concat(w[i]["w"], F.lit(" "), w[i + 1]["w"]).alias("bigram"), w[i]["b"].alias("b"), w[i + 1]["b"].alias("at")))))[0]
    seen = lambda some: some.select(*key, F.explode_outer(pairs).alias("x")).select(*key, "x.*")
    split = docs.where(F.col("text").rlike(GAP))
    # arrays_overlap hashes the smaller array, the list of words, and stops at the first hit
    able = split.where(F.arrays_overlap(normal_words(F.col("text")), F.array(*map(F.lit, without)))) if without else split
    chosen = saved(
        seen(able).join(listed, "bigram").groupBy(*key, "license", "n_template").agg(F.size(F.collect_set("bigram")).alias("n"))
        .where(f"n * {200 - threshold} >= n_template * {threshold}").drop("n"), "chosen",
    )
    # before the explosion: Spark moves no semi-join below one
    some = saved(seen(split.alias("s").join(chosen.select(*key).distinct().alias("c"), same("s", "c"), "left_semi")).distinct(), "pairs")
    before = Window.partitionBy(*key, "bigram").orderBy("at", F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    placed = some.withColumn("lo", F.coalesce(F.max("b").over(before), F.lit(-1))).where("lo < b")
    # bigrams new to the document bound a run's count from below, so that starts meet only blocks within reach
    new = placed.groupBy(*key, "at").agg(F.sum((F.col("lo") == -1).cast("long")).alias("new"))
    upto = saved(new.withColumn("upto", F.sum("new").over(Window.partitionBy(*key).orderBy("at"))).drop("new"), "upto")
    placed = saved(placed.alias("p").join(upto.alias("u"), same("p", "u") & (F.col("p.at") == F.col("u.at"))).select("p.*", "u.upto"), "placed")
    # the best run begins in a block that shares a bigram
    in_both = some.join(listed, "bigram").alias("s").join(chosen.alias("c"), same("s", "c") & (F.col("s.license") == F.col("c.license"))).select("s.*")
    firsts = in_both.select(*key, "license", "n_template", F.col("b").alias("first")).distinct()
    firsts = firsts.alias("f").join(upto.alias("u"), same("f", "u") & (F.col("f.first") == F.col("u.at")), "left").select("f.*", F.coalesce("u.upto", F.lit(0)).alias("base"))
    met = placed.alias("p").join(firsts.alias("f"), same("p", "f") & F.expr(f"lo < first AND first <= b AND upto - base <= n_template / {need}")).select("p.*", "f.license", "f.n_template", "f.first")
    met = met.join(listed.select("license", "bigram", F.lit(1).alias("hit")), ["license", "bigram"], "left")
    counts = met.groupBy(*key, "license", "n_template", "first", "at").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    grown = Window.partitionBy(*key, "license", "first").orderBy("at")
    close = counts.select(*key, "license", "n_template", "first", "at", F.sum("n").over(grown).alias("n_unit"), F.sum("hits").over(grown).alias("n_shared")).where(f"200 * n_shared >= {threshold} * (n_unit + n_template)")
    dice = F.expr("n_shared / (n_unit + n_template)").desc()
    for by, order in ((["first", "at"], "license"), (["license", "first"], "at"), (["license", "at"], F.desc("first"))):
        close = close.withColumn("rank", F.row_number().over(Window.partitionBy(*key, *by).orderBy(dice, order))).where("rank = 1").drop("rank")
    # rows equal in id and text are one until here
    close = docs.select(*key).alias("d").join(close.where("first < at").alias("c"), same("d", "c")).select("c.*")
    return close.select("doc_id", F.lit("run").alias("unit"), F.col("first").alias("unit_no"), "license", F.col("n_unit").cast("int"), "n_template", F.col("n_shared").cast("int"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: int = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, unit, unit_no, license, n_unit, n_template, n_shared) of the units that reach the threshold."""
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "license string, body string").select("license", bigrams_of(F.col("body")).alias("bs")).withColumn("n_template", F.size("bs"))
    bigrams = {r.license: r.bs for r in known.collect()}
    sizes = merged([(len(b) * threshold / (200 - threshold), len(b) * (200 - threshold) / threshold) for b in bigrams.values()])
    listed = known.select("license", "n_template", F.explode("bs").alias("bigram"))
    listed = F.broadcast(listed) if sum(len(t.split()) for t in templates.values()) <= BROADCAST_BIGRAMS else listed
    # explode_outer: an inner explode adds a filter on the array's size, which would compute the array twice
    sized = units(docs, doc_id, text).select("row_no", "doc_id", "unit", "unit_no", F.explode_outer(F.transform(F.array(bigrams_of(F.col("body"), sizes)), lambda b: F.transform(b, lambda x: F.struct(F.size(b).alias("n_unit"), x.alias("bigram"))))[0]).alias("x"))
    shared = (
        sized.select("row_no", "doc_id", "unit", "unit_no", "x.n_unit", "x.bigram")
        .join(listed, "bigram")
        .where(f"n_unit * {threshold} <= n_template * {200 - threshold} AND n_template * {threshold} <= n_unit * {200 - threshold}")
        .groupBy("row_no", "doc_id", "unit", "unit_no", "n_unit", "license", "n_template")
        .agg(F.size(F.collect_set("bigram")).alias("n_shared"))
        .where(f"200 * n_shared >= {threshold} * (n_unit + n_template)")
    )
    best = Window.partitionBy("row_no", "doc_id", "unit", "unit_no").orderBy(F.expr("n_shared / (n_unit + n_template)").desc(), "license")
    single = shared.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("doc_id", "unit", "unit_no", "license", "n_unit", "n_template", "n_shared")
    return single.union(runs(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")), listed, threshold, needed_words(bigrams, threshold)))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql() -> str:
    words = lambda t: f"list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), lambda x: x <> '')"
    pairs = "list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])"
    known = ", ".join(f"('{name}', '{body.replace(chr(39), chr(39) * 2)}')" for name, body in sorted(TEMPLATES.items()))
    gap = GAP.replace("\n", "\\n")
    shared = lambda source, unit: f"SELECT r, doc_id, {unit}, n_unit, license, n_template, count(*) AS n_shared FROM {source} JOIN (SELECT license, len(bs) AS n_template, unnest(bs) AS bigram FROM listed) USING (bigram) GROUP BY ALL HAVING 200 * n_shared >= {THRESHOLD} * (n_unit + n_template)"
    dice = "n_shared / (n_unit + n_template) DESC"
    return f"""
        WITH known AS (SELECT license, {words("body")} AS ws FROM (VALUES {known}) t(license, body)),
        listed AS (SELECT license, {pairs} AS bs FROM known),
        numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        lines AS (SELECT r, doc_id, 'line' AS unit, unnest(ls) AS body, generate_subscripts(ls, 1) - 1 AS unit_no FROM (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM numbered)),
        blocks AS (SELECT r, doc_id, 'block' AS unit, unnest(ls) AS body, generate_subscripts(ls, 1) - 1 AS unit_no FROM (SELECT r, doc_id, regexp_split_to_array(text, '{gap}') AS ls FROM numbered)),
        units AS (SELECT * FROM lines UNION ALL SELECT * FROM blocks WHERE contains(trim(body, chr(10)), chr(10))),
        cut AS (SELECT r, doc_id, unit, unit_no, {pairs} AS bs FROM (SELECT *, {words("body")} AS ws FROM units) WHERE len(ws) >= 2),
        each_bigram AS (SELECT r, doc_id, unit, unit_no, len(bs) AS n_unit, unnest(bs) AS bigram FROM cut),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY r, unit, unit_no ORDER BY {dice}, license) AS k FROM ({shared("each_bigram", "unit, unit_no")})),
        split AS (SELECT r, doc_id, list_transform(regexp_split_to_array(text, '{gap}'), lambda b: {words("b")}) AS bl FROM numbered WHERE regexp_matches(text, '{gap}')),
        starts AS (SELECT *, unnest(range(1, len(bl) + 1)) AS f FROM split),
        runs AS (SELECT r, doc_id, f, a, {pairs} AS bs FROM (SELECT r, doc_id, f, a, flatten(bl[f:a]) AS ws FROM (SELECT *, unnest(range(f, len(bl) + 1)) AS a FROM starts)) WHERE len(ws) >= 2),
        run_bigram AS (SELECT r, doc_id, f, a, len(bs) AS n_unit, unnest(bs) AS bigram FROM runs),
        close AS (SELECT * FROM ({shared("run_bigram", "f, a")}) QUALIFY row_number() OVER (PARTITION BY r, f, a ORDER BY {dice}, license) = 1),
        first AS (SELECT * FROM close QUALIFY row_number() OVER (PARTITION BY r, license, f ORDER BY {dice}, a) = 1),
        last AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY r, license, a ORDER BY {dice}, f DESC) = 1)
        SELECT doc_id, unit, unit_no, license, n_unit, n_template, n_shared FROM ranked WHERE k = 1
        UNION ALL SELECT doc_id, 'run', f - 1, license, n_unit, n_template, n_shared FROM last WHERE f < a"""
