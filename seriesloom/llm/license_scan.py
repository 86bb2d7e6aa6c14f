"""op3: licence scans by sentence-rule recognition.

A text is cut into sentences, each sentence is normalised, and known licence
sentences are mapped to their identifiers (0 for others). A rule is a licence
and identifiers that stand next to each other in order. Rules are tried in the
order of the table; what one has matched is taken out of the sequence, so no
later and shorter rule matches the same sentences again. All of
this happens inside one row with SQL functions: no shuffle, no Python.

Normalising lower-cases, and turns all but a-z and 0-9 into single spaces;
sentences that are then empty are dropped. For `n_sentences`, sentences end at
line breaks and at `.`, `!` or `?` before white space.

Known sentences are looked for in finer parts: these also end at `;` and `:`,
and comment and list marks before a line are left out. A known sentence may
run on over single line breaks, `;` and `:`, so that wrapped notices are
found, but not over an empty line or the end of a sentence (the stop of `v. 2`
is none). Where two start at one place, the longer counts. The SQL does the same.

Defined results: a null, empty or wordless text has 0 sentences and an empty
licence list. Repeated rows and null ids keep their rows. Of rules that match
the same sentences, the first of the table takes them. A text of any length
is read whole, inside one row. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

# Sentences of public licences and notices, normalised, by identifier.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "you may obtain a copy of the license at",
    5: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    6: "see the license for the specific language governing permissions and limitations under the license",
    10: "released under the mit license",
    11: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    12: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    23: "see the gnu general public license for more details",
    30: "licensed under cc by nc 4 0",
    31: "licensed under cc by 4 0",
    32: "this work is licensed under a creative commons attribution 4 0 international license",
    40: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    41: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    42: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    50: "this source code form is subject to the terms of the mozilla public license v 2 0",
    13: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    24: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    25: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    26: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    60: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    61: "this software is provided as is without any express or implied warranty",
    62: "in no event will the authors be held liable for any damages arising from the use of this software",
    63: "distributed under the boost software license version 1 0",
    64: "this is free and unencumbered software released into the public domain",
    70: "spdx license identifier apache 2 0",
    71: "spdx license identifier mit",
    72: "spdx license identifier bsd 2 clause",
    73: "spdx license identifier bsd 3 clause",
    74: "spdx license identifier gpl 2 0 only",
    75: "spdx license identifier gpl 2 0 or later",
    76: "spdx license identifier gpl 3 0 only",
    77: "spdx license identifier gpl 3 0 or later",
    78: "spdx license identifier mpl 2 0",
    79: "spdx license identifier isc",
}
# Rules in the order in which they are tried, each a licence and the identifiers that must follow one another.
RULES = [
    ("MIT", (13, 11, 12)),
    ("GPL-3.0", (21, 22, 23)),
    ("GPL-2.0", (26, 22, 23)),
    ("BSD-3-Clause", (40, 41, 42)),
    ("Apache-2.0", (2, 3, 4)),
    ("BSD-2-Clause", (40, 41)),
    ("Apache-2.0", (5, 6)),
    ("MIT", (11, 12)),
    ("Zlib", (61, 62)),
    ("AGPL-3.0", (25,)),
    ("GPL-2.0", (26,)),
    ("LGPL-2.1", (24,)),
    ("ISC", (60,)),
    ("BSL-1.0", (63,)),
    ("Unlicense", (64,)),
    ("Apache-2.0", (1,)),
    ("CC-BY-4.0", (31,)),
    ("CC-BY-4.0", (32,)),
    ("CC-BY-NC-4.0", (30,)),
    ("GPL-3.0", (20,)),
    ("MIT", (10,)),
    ("MPL-2.0", (50,)),
    ("Apache-2.0", (70,)),
    ("MIT", (71,)),
    ("BSD-2-Clause", (72,)),
    ("BSD-3-Clause", (73,)),
    ("GPL-2.0", (74,)),
    ("GPL-2.0", (75,)),
    ("GPL-3.0", (76,)),
    ("GPL-3.0", (77,)),
    ("MPL-2.0", (78,)),
    ("ISC", (79,)),
]
#: Patterns that Spark and the SQL share: a line break with the marks, comment words and list numbers before a line; a stop that ends no sentence; one that does; what is no letter, digit or break; an empty line; a break inside a sentence.
LINE = r"(?:\x0D\x0A|[\x0A-\x0D])[^a-z0-9\x0A-\x0D]*(?:(?:rem|dnl|c)[\x20\x09]+[^a-z0-9\x0A-\x0D]*)?(?:(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)][\x20\x09]+)?"
VERSION, STOP, OTHER, HARD, SOFT = r"([^a-z0-9]v)\.([\x20\x09-\x0D]{1,9}[0-9])", r"[.!?][\x20\x09-\x0D]+", r"[^a-z0-9\n;:]+", r" ?\n ?\n[\n ]*", r" ?[\n;:][\n;: ]*"
#: A part between two separators: a known sentence, which may run on over single breaks, or anything up to the next separator.
PART = "[#|] ?((?:" + "|".join(s.replace(" ", r"(?: |\|\|)") for s in sorted(SENTENCES.values(), key=len, reverse=True)) + r")|[^#|]*) ?[#|]"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, in order."""
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[\x20\x09-\x0D]+", "$1\n")
    plain = F.transform(F.split(lines, r"[\x0A-\x0D]+"), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.filter(plain, lambda s: s != "")


def parts(text: Column) -> Column:
    """Known sentences of a text, whole, and the parts between them, normalised and in order."""
    lines = F.regexp_replace(F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit("")))), LINE, "\n")
    ended = F.regexp_replace(F.regexp_replace(lines, VERSION, "$1$2"), STOP, "\n\n")
    hard = F.regexp_replace(F.regexp_replace(ended, OTHER, " "), HARD, "##")
    soft = F.concat(F.lit("#"), F.regexp_replace(hard, SOFT, "||"), F.lit("#"))
    found = F.regexp_extract_all(soft, F.lit(PART), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(F.regexp_replace(s, "[|]+", " "))), lambda s: s != "")


def identifiers(found: Column) -> Column:
    """The identifier of each normalised sentence, 0 for one that is not known."""
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    return F.transform(found, lambda s: F.coalesce(F.try_element_at(known, s), F.lit(0)))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id_col, n_sentences, sentence_ids (those known, in order) and licenses (sorted names), both joined by commas."""
    chain = F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))))
    names = sorted({name for name, _ in RULES})
    left = reduce(lambda done, rule: F.replace(done, F.lit("".join(f"<{i}>" for i in rule[1])), F.lit(f"<{rule[0]}>")), RULES, F.col("chain"))
    read = df.select(F.col(id_col).alias("id"), F.size(sentences(F.col(text_col))).alias("n"), identifiers(parts(F.col(text_col))).alias("ids")).withColumn("chain", chain)
    read = read.withColumn("known", F.filter("ids", lambda i: i != 0)).withColumn("left", F.when(F.size("known") > 0, left).otherwise(""))
    return read.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_sentences"), F.array_join("known", ",").alias("sentence_ids"),
        F.concat_ws(",", *[F.when(F.col("left").contains(f"<{name}>"), F.lit(name)) for name in names]).alias("licenses"),
    )


def op3_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    known = " ".join(f"when '{s}' then {i}" for i, s in SENTENCES.items())
    left = reduce(lambda done, rule: f"replace({done}, '{''.join(f'<{i}>' for i in rule[1])}', '<{rule[0]}>')", RULES, "chain")
    hits = ", ".join(f"case when contains(found, '<{name}>') then '{name}' end" for name in sorted({name for name, _ in RULES}))
    return f"""
with lines as (
  select doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), '[\\x0A-\\x0D]+') as l,
    regexp_replace(regexp_replace(regexp_replace(chr(10) || lower(coalesce(text, '')), {text(LINE)}, chr(10), 'g'), {text(VERSION)}, '\\1\\2', 'g'), {text(STOP)}, chr(10) || chr(10), 'g') as ended from documents
), plain as (
  select doc_id, len(list_filter(list_transform(l, lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '')) as n,
    '#' || regexp_replace(regexp_replace(regexp_replace(ended, {text(OTHER)}, ' ', 'g'), {text(HARD)}, '##', 'g'), {text(SOFT)}, '||', 'g') || '#' as soft from lines
), parts as (
  select doc_id, n, list_filter(list_transform(regexp_extract_all(soft, {text(PART)}, 1), lambda s: trim(regexp_replace(s, '[|]+', ' ', 'g'))), lambda s: s <> '') as p from plain
), known as (
  select doc_id, n, list_transform(p, lambda x: case x {known} else 0 end) as ids from parts
), chained as (select doc_id, n, ids, list_aggregate(list_transform(ids, lambda i: '<' || i || '>'), 'string_agg', '') as chain from known),
done as (select *, {left} as found from chained)
select doc_id, cast(n as bigint) as n_sentences, coalesce(array_to_string(list_filter(ids, lambda i: i <> 0), ','), '') as sentence_ids,
       concat_ws(',', {hits}) as licenses
from done"""


SQL = _sql()
