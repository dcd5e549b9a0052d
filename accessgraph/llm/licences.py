"""Licences in texts: known sentences first, then rules over their sequence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgraph.llm.common import fresh, query, table

# Sentences of public licences, as patterns over normalised text
# (small letters, digits and plus; everything else is one space).
UNDER = (
    "(this( [a-z]+){1,3} is |it is |(all )?(content|code|text|files?)( is| are) )?((dual )?licen[cs]ed|released|distributed|available"
    "|published|provided|made available)( (for use|freely))? under (the )?(terms of )?(the )?"
)
LATER = "( or later|( or)?( at your option)? any later version| or newer)"
# What may follow the name: (the "License"), and the next clause after a semicolon.
TAIL = "( the licen[cs]e( you may not use .*)?)?"
FREE = "this( [a-z]+){1,3} is free software you can redistribute it .*gnu "
GENERAL, LESSER, AFFERO = "general public licen[cs]e", "(lesser|library) general public licen[cs]e", "affero general public licen[cs]e"
BY_FOUNDATION = "published by the free software foundation (inc )?(either )?"
_UNDER_A_NAME: tuple[tuple[str, str], ...] = (
    ("apache-2", "(" + UNDER + "|the asf licen[cs]es this file to you under the )(apache (software )?licen[cs]e ?(version|v)? ?2( 0)?|apache 2( 0)?( licen[cs]e)?)"),
    ("mit", UNDER + "(mit|expat|mit x11)( licen[cs]e)?"),
    ("gpl-3-later", UNDER + "(gnu )?(general public licen[cs]e|gpl) ?(version|v)? ?3( 0)?" + LATER),
    ("gpl-3", UNDER + "(gnu )?(general public licen[cs]e|gpl) ?(version|v)? ?3( 0)?( only)?"),
    ("gpl-2-later", UNDER + "(gnu )?(general public licen[cs]e|gpl) ?(version|v)? ?2( 0)?" + LATER),
    ("gpl-2", UNDER + "(gnu )?(general public licen[cs]e|gpl) ?(version|v)? ?2( 0)?( only)?"),
    ("lgpl-3", UNDER + "(gnu )?(lesser general public licen[cs]e|lgpl) ?(version|v)? ?3( 0)?( only)?"),
    ("lgpl-2.1", UNDER + "(gnu )?(lesser general public licen[cs]e|lgpl) ?(version|v)? ?2 1( only)?"),
    ("agpl-3", UNDER + "(gnu )?(affero general public licen[cs]e|agpl) ?(version|v)? ?3( 0)?( only)?"),
    ("mpl-2", UNDER + "(mozilla public licen[cs]e|mpl) ?(version|v)? ?2( 0)?"),
    ("bsd-3", UNDER + "(3 clause bsd|bsd 3 clause|new bsd|modified bsd)( licen[cs]e)?"),
    ("bsd-2", UNDER + "(2 clause bsd|bsd 2 clause|simplified bsd)( licen[cs]e)?"),
    ("isc", UNDER + "isc licen[cs]e"),
    ("cc0", UNDER + "(creative commons zero|cc0|cc zero)( 1 0)?( universal)?( licen[cs]e)?"),
    ("cc-by-nc-sa-4", UNDER + "(cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0( international)?( licen[cs]e)?"),
    ("cc-by-nc-nd-4", UNDER + "(cc by nc nd|creative commons attribution non ?commercial no ?derivatives) 4 0( international)?( licen[cs]e)?"),
    ("cc-by-nc-4", UNDER + "(cc by nc|creative commons attribution non ?commercial) 4 0( international)?( licen[cs]e)?"),
    ("cc-by-sa-4", UNDER + "(cc by sa|creative commons attribution share ?alike) 4 0( international)?( licen[cs]e)?"),
    ("cc-by-nd-4", UNDER + "(cc by nd|creative commons attribution no ?derivatives) 4 0( international)?( licen[cs]e)?"),
    ("cc-by-4", UNDER + "(cc by|creative commons attribution) 4 0( international)?( licen[cs]e)?"),
)
SENTENCES: tuple[tuple[str, str], ...] = (
    *((name, pattern + TAIL) for name, pattern in _UNDER_A_NAME),
    ("spdx-apache-2", "spdx licen[cs]e identifier apache 2 0"),
    ("spdx-mit", "spdx licen[cs]e identifier mit"),
    ("spdx-gpl-3-later", "spdx licen[cs]e identifier gpl 3 0( or later|\\+)"),
    ("spdx-gpl-3", "spdx licen[cs]e identifier gpl 3 0( only)?"),
    ("spdx-bsd-3", "spdx licen[cs]e identifier bsd 3 clause"),
    ("spdx-bsd-2", "spdx licen[cs]e identifier bsd 2 clause"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy .*"),
    ("mit-notice", "the above copyright notice and this permission notice .*shall be included( in( all copies.*)?)?"),
    ("mit-as-is", "the software is provided as is without warranty of any kind.*"),
    ("bsd-permit", "redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("bsd-source", "(1 )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", "(2 )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-names", "(3 )?neither the name of .* may be used to endorse or promote products.*"),
    ("gpl-3-free", FREE + GENERAL + " .*version 3.*later version.*"),
    ("gpl-3-free-only", FREE + GENERAL + " .*version 3.*"),
    ("gpl-2-free", FREE + GENERAL + " .*version 2.*later version.*"),
    ("gpl-2-free-only", FREE + GENERAL + " .*version 2.*"),
    ("lgpl-3-free", FREE + LESSER + " .*version 3.*later version.*"),
    ("lgpl-3-free-only", FREE + LESSER + " .*version 3.*"),
    ("lgpl-2.1-free", FREE + LESSER + " .*version 2 1.*later version.*"),
    ("lgpl-2.1-free-only", FREE + LESSER + " .*version 2 1.*"),
    ("lgpl-2-free", FREE + LESSER + " .*version 2.*later version.*"),
    ("lgpl-2-free-only", FREE + LESSER + " .*version 2.*"),
    ("agpl-3-free", FREE + AFFERO + " .*version 3.*later version.*"),
    ("agpl-3-free-only", FREE + AFFERO + " .*version 3.*"),
    # A line that begins with "published" cuts the sentence in two.
    ("gpl-free", FREE + GENERAL + "( as)?"),
    ("lgpl-free", FREE + LESSER + "( as)?"),
    ("fsf-3-later", BY_FOUNDATION + "version 3.*later version.*"),
    ("fsf-2.1-later", BY_FOUNDATION + "version 2 1.*later version.*"),
    ("fsf-2-later", BY_FOUNDATION + "version 2.*later version.*"),
    ("gpl-hope", "this( [a-z]+){1,3} is distributed in the hope that it will be useful but without any warranty.*"),
    ("gpl-copy", "you should have received a copy of the gnu general public licen[cs]e.*"),
    ("lgpl-copy", "you should have received a copy of the gnu (lesser|library) general public licen[cs]e.*"),
    ("agpl-copy", "you should have received a copy of the gnu affero general public licen[cs]e.*"),
    ("apache-comply", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-basis", "unless required by applicable law or agreed to in writing software( distributed under the licen[cs]e( is( .*)?)?)?"),
    ("public-domain", "this( [a-z]+){1,3} is( (dedicated|released))?( to| into| in)? the public domain"),
)
# Notices of the Free Software Foundation: licence, what names it, and the sentence on the copy.
NOTICES: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("GPL-3.0-or-later", ("gpl-free", "fsf-3-later"), "gpl-copy"),
    ("GPL-2.0-or-later", ("gpl-free", "fsf-2-later"), "gpl-copy"),
    ("LGPL-3.0-or-later", ("lgpl-free", "fsf-3-later"), "lgpl-copy"),
    ("LGPL-2.1-or-later", ("lgpl-free", "fsf-2.1-later"), "lgpl-copy"),
    ("LGPL-2.0-or-later", ("lgpl-free", "fsf-2-later"), "lgpl-copy"),
    ("GPL-3.0-or-later", ("gpl-3-free",), "gpl-copy"),
    ("GPL-3.0-only", ("gpl-3-free-only",), "gpl-copy"),
    ("GPL-2.0-or-later", ("gpl-2-free",), "gpl-copy"),
    ("GPL-2.0-only", ("gpl-2-free-only",), "gpl-copy"),
    ("LGPL-3.0-or-later", ("lgpl-3-free",), "lgpl-copy"),
    ("LGPL-3.0-only", ("lgpl-3-free-only",), "lgpl-copy"),
    ("LGPL-2.1-or-later", ("lgpl-2.1-free",), "lgpl-copy"),
    ("LGPL-2.1-only", ("lgpl-2.1-free-only",), "lgpl-copy"),
    ("LGPL-2.0-or-later", ("lgpl-2-free",), "lgpl-copy"),
    ("LGPL-2.0-only", ("lgpl-2-free-only",), "lgpl-copy"),
    ("AGPL-3.0-or-later", ("agpl-3-free",), "agpl-copy"),
    ("AGPL-3.0-only", ("agpl-3-free-only",), "agpl-copy"),
)
# Ordered rules: the first takes its sentences, later ones see what is left.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("BSD-3-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-permit", "bsd-source", "bsd-binary")),
    *((licence, (*ids, "gpl-hope", copy)) for licence, ids, copy in NOTICES),
    *((licence, (*ids, copy)) for licence, ids, copy in NOTICES),
    *((licence, ids) for licence, ids, _ in NOTICES),
    ("Apache-2.0", ("apache-2", "apache-comply", "apache-basis")),
    ("Apache-2.0", ("apache-2",)),
    ("Apache-2.0", ("spdx-apache-2",)),
    ("MIT", ("mit",)),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-3.0-or-later", ("spdx-gpl-3-later",)),
    ("GPL-3.0-only", ("gpl-3",)),
    ("GPL-3.0-only", ("spdx-gpl-3",)),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("GPL-2.0-only", ("gpl-2",)),
    ("LGPL-3.0-only", ("lgpl-3",)),
    ("LGPL-2.1-only", ("lgpl-2.1",)),
    ("AGPL-3.0-only", ("agpl-3",)),
    ("MPL-2.0", ("mpl-2",)),
    ("BSD-3-Clause", ("bsd-3",)),
    ("BSD-3-Clause", ("spdx-bsd-3",)),
    ("BSD-2-Clause", ("bsd-2",)),
    ("BSD-2-Clause", ("spdx-bsd-2",)),
    ("ISC", ("isc",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("public-domain", ("public-domain",)),
    ("unclear", ("mit-grant",)),
    ("unclear", ("bsd-permit",)),
    ("unclear", ("gpl-free",)),
    ("unclear", ("lgpl-free",)),
    ("unclear", ("gpl-copy",)),
    ("unclear", ("lgpl-copy",)),
    ("unclear", ("agpl-copy",)),
    ("unclear", ("apache-comply",)),
)
# A line that opens like this begins a sentence even if the line before has no stop.
OPENERS = (
    "this|it is|all|content|code|text|dual|licen[cs]ed|released|distributed|available|published|provided|made|spdx|permission"
    "|the above|the software|redistributions?|neither|you|unless|copyright|[0-9]"
)
OPENING = rf"(?i)\n([^A-Za-z0-9\n]*({OPENERS})\b)"
BREAK = r"[.!?]+[ \t\r\n]+|\n[ \t\r]*\n"
# A word of every known sentence; a text without any has none of them.
CUE = r"(?i)under|spdx|permission|warrant|redistribut|neither|received|compliance|required|domain|foundation"


def _fits(pattern: str) -> str:
    """The pattern over a sentence that may be wrapped, up to the end of a line."""
    return "^(" + pattern.replace(".*", r"[\s\S]*").replace(" ", r"[ \n]") + r")(\n[\s\S]*)?$"


def _chain(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")


def scan(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with ``sentences`` and ``licences``.

    A text is cut into sentences at full stops, blank lines and lines that open
    like a licence sentence; each is normalised and named by the first pattern
    that fits it to its end or the end of a line. ``sentences`` joins the names in text
    order. Rules are tried in order; each takes its run of neighbouring names
    wherever it stands and leaves the rest to later rules. ``licences`` are the
    sorted distinct licences of the rules that matched. Everything happens
    inside the row. Null and empty texts have none; columns named like the two
    added ones are replaced.
    """
    columns = [c for c in (columns or docs.columns) if c not in ("sentences", "licences")]

    ids_name, left_name = fresh(docs, "_ids"), fresh(docs, "_left")

    def name(sentence: Column) -> Column:
        plain = F.regexp_replace(F.lower(sentence), r"[^a-z0-9+\n]+", " ")
        plain = F.regexp_replace(plain, r"^[ \n]+|[ \n]+$", "")
        plain = F.regexp_replace(plain, r" ?\n[ \n]*", "\n")
        first, *rest = SENTENCES
        return reduce(
            lambda chain, s: chain.when(plain.rlike(_fits(s[1])), s[0]), rest, F.when(plain.rlike(_fits(first[1])), first[0])
        )

    parts = F.filter(F.split(F.regexp_replace("text", OPENING, "\n\n$1"), BREAK, -1), lambda s: s.rlike(CUE))
    named = F.filter(F.transform(parts, name), lambda i: i.isNotNull())
    ids = F.when(F.col("text").rlike(CUE), named).otherwise(F.array().cast("array<string>"))
    found = docs.select(*columns, F.coalesce(ids, F.array().cast("array<string>")).alias(ids_name))
    found = found.select(*columns, F.array_join(ids_name, ",").alias("sentences"), _chain(F.col(ids_name)).alias(left_name))
    chains = ["".join(f"<{i}>" for i in ids) for _, ids in RULES]
    left, hits = F.col(left_name), []
    for (licence, _), chain in zip(RULES, chains, strict=True):
        hits.append(F.when(F.contains(left, F.lit(chain)), licence))
        left = F.replace(left, F.lit(chain), F.lit(""))
    licences = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))), ",")
    some = F.when(F.col(left_name) == "", "").otherwise(licences)
    return found.select(*columns, "sentences", some.alias("licences"))


def _sql() -> str:
    plain = r"regexp_replace(lower(s), '[^a-z0-9+\n]+', ' ', 'g')"
    plain = rf"regexp_replace({plain}, '^[ \n]+|[ \n]+$', '', 'g')"
    plain = rf"regexp_replace({plain}, ' ?\n[ \n]*', chr(10), 'g')"
    cases = " ".join(f"WHEN regexp_matches(plain, '{_fits(p)}') THEN '{i}'" for i, p in SENTENCES)
    steps, last = [], "r0"
    for k, (licence, ids) in enumerate(RULES, 1):
        chain = "".join(f"<{i}>" for i in ids)
        hit = f"CASE WHEN contains(rest, '{chain}') THEN list_append(hits, '{licence}') ELSE hits END"
        steps.append(f"r{k} AS (SELECT doc_id, names, replace(rest, '{chain}', '') AS rest, {hit} AS hits FROM {last})")
        last = f"r{k}"
    return f"""
WITH cut AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS spot, unnest(parts) AS s
  FROM (
    SELECT doc_id, string_split_regex(
      regexp_replace(coalesce(text, ''), '{OPENING}', chr(10) || chr(10) || '\\1', 'g'), '{BREAK}') AS parts
    FROM documents)
), plain AS (SELECT doc_id, spot, {plain} AS plain FROM cut WHERE regexp_matches(s, '{CUE}')
), named AS (SELECT doc_id, spot, CASE {cases} END AS name FROM plain
), found AS (
  SELECT doc_id, list(name ORDER BY spot) AS names FROM named WHERE name IS NOT NULL GROUP BY doc_id
), r0 AS (
  SELECT d.doc_id, coalesce(names, []) AS names,
         coalesce(array_to_string(list_transform(names, lambda n: '<' || n || '>'), ''), '') AS rest, []::VARCHAR[] AS hits
  FROM documents d LEFT JOIN found USING (doc_id)
), {", ".join(steps)}
SELECT doc_id, coalesce(array_to_string(names, ','), '') AS sentences,
       coalesce(array_to_string(list_sort(list_distinct(hits)), ','), '') AS licences FROM {last}
"""


@query("op4_license_scans", _sql())
def op4(spark, sf):
    """Known licence sentences and licences of every document."""
    return scan(table(spark, sf, "documents"), ["doc_id"])
