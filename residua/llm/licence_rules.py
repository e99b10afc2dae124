"""Licence scan: sentences to known identifiers, identifier sequences to ordered rules. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence texts and notices (lower case, one space between [a-z0-9.] runs).
SENTENCES: dict[str, str] = {
    "apache-notice": "licensed under the apache license version 2.0",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc-by-nc-notice": "licensed under cc by nc 4.0",
    "cc-by-notice": "licensed under cc by 4.0",
    "cc-by-sa-notice": "licensed under cc by sa 4.0",
    "cc0-notice": "licensed under cc0 1.0",
    "bsd-notice": "licensed under the bsd license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-no-endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "all-rights": "all rights reserved",
}
# Other forms of known sentences, as standard headers have them or as they read when joined over a cut after "v.".
VARIANTS: tuple[tuple[str, str], ...] = (
    ("apache-notice", "licensed under the apache license version 2.0 the license"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2.0"),
)
# Rules in order of precedence: licence, category, identifiers that must occur in this order.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("Apache-2.0", "permissive", ("apache-notice", "apache-compliance", "apache-as-is")),
    ("MIT", "permissive", ("mit-grant", "mit-condition")),
    ("GPL-3.0-or-later", "copyleft", ("gpl-redistribute", "gpl-no-warranty")),
    ("BSD-3-Clause", "permissive", ("bsd-redistribution", "bsd-no-endorsement")),
    ("BSD-2-Clause", "permissive", ("bsd-redistribution",)),
    ("GPL-3.0", "copyleft", ("gpl3-notice",)),
    ("GPL-2.0", "copyleft", ("gpl2-notice",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-notice",)),
    ("CC-BY-4.0", "permissive", ("cc-by-notice",)),
    ("CC0-1.0", "public-domain", ("cc0-notice",)),
    ("MPL-2.0", "copyleft", ("mpl-notice",)),
    ("Apache-2.0", "permissive", ("apache-notice",)),
    ("MIT", "permissive", ("mit-notice",)),
    ("MIT", "permissive", ("mit-licensed",)),
    ("BSD", "permissive", ("bsd-notice",)),
    ("proprietary", "proprietary", ("all-rights",)),
)
SENTENCE_END = r"[.!?;]+(?:[\x20\x09-\x0D]+|$)|[\x0A\x0D]+"
NOISE = "[^a-z0-9.]+"
#: Where no sentence goes on: [.!?] before white space except after "v", and lines without a letter or digit.
STOP = r"(?<!\bv)[.!?]+[\x20\x09-\x0D]+|(?:(?:\x0D\x0A?+|\x0A)[^a-z0-9\x0A\x0D]*+){2,}"
MARK = "\x01"


def _pattern(ids: tuple[str, ...]) -> str:
    return "%" + "%".join(f"<{i}>" for i in ids) + "%"


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES, variants=VARIANTS) -> DataFrame:
    """One row per input row: id, n_matches, first_sentence (index of the first known sentence), sentence_ids
    (identifiers in order, as <a><b>), licences (of all rules that hold, in order of precedence), licence and category
    (of the first), conflict (rules of several categories hold).

    A text is lower-cased and cut at line ends and at [.!?;] before white space; a piece keeps [a-z0-9.] and single
    spaces. A known sentence is one piece, or several in a row (wrapped lines, clauses after ";", "v. 2.0") with no
    blank line or sentence end between; its index is that of its first piece. Everything is one projection: no shuffle,
    so copies and hot sources cost no more than other rows; pieces are joined only in texts that hold a known sentence.

    Defined cases: null, empty or licence-free texts have n_matches 0, an empty sentence_ids, no licence and conflict
    false; a null id stays null; repeated rows get a row each; other columns are ignored; an empty table gives an empty
    table.
    """
    forms = [(i, s) for i, s in sentences.items()] + [(i, s) for i, s in variants if i in sentences]
    known = F.create_map(*[F.lit(x) for i, s in forms for x in (s, i)])
    longest, most = max(len(s) for _, s in forms), max(s.count(" ") + 1 for _, s in forms)
    lowered = docs.select(F.col(id_col), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_text"))
    plain = lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, NOISE, " ")), r"^[ .]+|[ .]+$", "")
    cut = lowered.select(id_col, "_text", F.transform(F.split("_text", SENTENCE_END), plain).alias("_plain"))
    held_in = F.array_join(F.filter("_plain", lambda x: x != ""), " ")
    cut = cut.withColumn("_flat", held_in)
    some = F.lit(False)
    for _, s in forms:
        some = some | F.contains(F.col("_flat"), F.lit(s))
    # the mark follows the cut, so pieces and their indices stay as they are
    marked = F.split(F.regexp_replace("_text", f"({STOP})", f"$1{MARK}"), SENTENCE_END)
    pieces = F.filter(F.transform(marked, lambda s, i: F.struct(plain(s).alias("s"), F.contains(s, F.lit(MARK)).alias("stop"), i.alias("at"))), lambda x: (x["s"] != "") | x["stop"])

    def identify(piece: Column, index: Column, every: Column) -> Column:
        """The first known sentence among the piece, the piece and the next, and so on."""
        begin = F.struct(F.lit("").alias("s"), F.lit(None).cast("string").alias("id"), F.lit(False).alias("over"))

        def go_on(acc: Column, x: Column) -> Column:
            over = acc["over"] | acc["id"].isNotNull() | (x["stop"] & (x["at"] > piece["at"])) | (F.length(acc["s"]) > longest)
            s = F.when(over | (x["s"] == ""), acc["s"]).otherwise(F.concat_ws(" ", F.when(acc["s"] != "", acc["s"]), x["s"]))
            return F.struct(s.alias("s"), F.coalesce(acc["id"], F.when(~over, F.element_at(known, s))).alias("id"), over.alias("over"))

        run = F.aggregate(F.slice(every, index + 1, F.lit(2 * most)), begin, go_on)
        return F.struct(F.when(piece["s"] != "", run["id"]).alias("id"), piece["at"].alias("at"))

    cut = cut.withColumn("_pieces", F.when(some, pieces))
    found = F.filter(F.transform("_pieces", lambda x, i: identify(x, i, F.col("_pieces"))), lambda x: x["id"].isNotNull())
    nothing = F.array().cast("array<struct<id:string,at:int>>")
    seen = cut.select(F.col(id_col), F.coalesce(found, nothing).alias("_found"))
    seq = seen.select(
        F.col(id_col), F.size("_found").cast("long").alias("n_matches"), F.when(F.size("_found") > 0, F.get("_found", F.lit(0))["at"]).cast("long").alias("first_sentence"),
        F.array_join(F.transform("_found", lambda x: F.concat(F.lit("<"), x["id"], F.lit(">"))), "").alias("sentence_ids"),
    )
    held = F.filter(F.array(*[F.when(F.col("sentence_ids").like(_pattern(ids)), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"))) for name, kind, ids in rules]), lambda x: x.isNotNull())
    out = seq.withColumn("_held", held)
    names, kinds = F.array_distinct(F.transform("_held", lambda x: x["name"])), F.array_distinct(F.transform("_held", lambda x: x["kind"]))
    return out.select(
        id_col, "n_matches", "first_sentence", "sentence_ids", F.array_join(names, ",").alias("licences"), F.get(names, F.lit(0)).alias("licence"),
        F.get(F.transform("_held", lambda x: x["kind"]), F.lit(0)).alias("category"), (F.size(kinds) > 1).alias("conflict"),
    )


def licence_sql(sentences: dict[str, str] = SENTENCES, rules=RULES) -> str:
    """DuckDB SQL of the query, of any length of sentence; it knows sentences on one line only (see tests/llm for the others)."""
    names = ", ".join(f"'{s}': '{i}'" for i, s in sentences.items())
    held = ", ".join(f"CASE WHEN sentence_ids LIKE '{_pattern(ids)}' THEN {{'name': '{name}', 'kind': '{kind}'}} END" for name, kind, ids in rules)
    return f"""
WITH known AS (SELECT MAP {{{names}}} AS m),
parts AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '{SENTENCE_END}') AS ss FROM documents),
found AS (
  SELECT doc_id, list_filter(list_transform(ss, lambda s, i: {{'id': m[regexp_replace(trim(regexp_replace(s, '{NOISE}', ' ', 'g')), '^[ .]+|[ .]+$', '', 'g')], 'at': i - 1}}),
         lambda x: x.id IS NOT NULL) AS f FROM parts, known
), seq AS (
  SELECT doc_id, len(f)::BIGINT AS n_matches, CASE WHEN len(f) > 0 THEN f[1].at END::BIGINT AS first_sentence,
         coalesce(array_to_string(list_transform(f, lambda x: '<' || x.id || '>'), ''), '') AS sentence_ids FROM found
), held AS (SELECT *, list_filter([{held}], lambda x: x IS NOT NULL) AS h FROM seq)
SELECT doc_id, n_matches, first_sentence, sentence_ids,
       coalesce((SELECT string_agg(n, ',' ORDER BY p) FROM (SELECT n, min(p) AS p FROM (SELECT unnest(list_transform(h, lambda x: x.name)) AS n, unnest(range(len(h))) AS p) GROUP BY n)), '') AS licences,
       h[1].name AS licence, h[1].kind AS category, len(list_distinct(list_transform(h, lambda x: x.kind))) > 1 AS conflict
FROM held"""
