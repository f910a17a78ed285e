"""Licence scan by sentences and rules, in built-in functions only.

A text is cut into sentences (at ``.!?:`` before white space, and at blank or bare comment lines; the point of
``v. 2`` doesn't count; an unknown sentence of several lines counts line by line). Normalised (lower case, runs of other characters
than letters and digits as one blank, ``https`` as ``http``) sentences are looked up among the known ones,
which gives the text's sequence of identifiers, in order; where more than ``GAP`` unknown sentences lie between two,
a mark (``~``) does too. ``RULES``, from the longest to
the shortest, name a licence for an unbroken run of identifiers, of which some may be missing; what a rule has matched is used
up, so that the parts of a whole licence aren't reported again. Identifiers that no rule
uses are reported as ``partial``.

Only texts that hold a marker word are cut. Nothing is shuffled; the tables are part of the plan.

Defined cases: null or empty text has no licence; sentences may repeat, a licence is listed
once; of two rules that want the same identifiers the earlier one gets them; very long texts are taken whole, an empty
table gives an empty table; null and repeated ids are rows of their own; only the id and text columns are read, so
other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let

#: Unknown sentences that may lie between two of a run.
GAP = 2
#: Sentences of published licence texts and customary notices, normalised, by identifier.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-name": "the mit license",
    "mit-name-mit": "mit license",
    "mit-ref": "released under the mit license",
    "mit-ref-licensed": "licensed under the mit license",
    "mit-ref-code": "this code is licensed under the mit license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "isc-ref": "licensed under the isc license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-ref": "released under the bsd license",
    "bsd-3-ref": "licensed under the bsd 3 clause license",
    "bsd-2-ref": "licensed under the bsd 2 clause license",
    "apache-whole": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-ref": "licensed under the apache license version 2 0",
    "gpl-3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-3-ref-short": "licensed under the gnu general public license version 3",
    "gpl-2-ref": "this work is licensed under the gnu general public license version 2",
    "gpl-2-ref-short": "licensed under the gnu general public license version 2",
    "lgpl-ref": "licensed under the gnu lesser general public license version 3",
    "agpl-ref": "licensed under the gnu affero general public license version 3",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-ref": "licensed under the mozilla public license version 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "unlicense-law": "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    "unlicense-benefit": "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors",
    "unlicense-intend": "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    "unlicense-liability": "in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "unlicense-more": "for more information please refer to http unlicense org",
    "cc0-ref": "released under cc0 1 0 universal",
    "cc-by-ref": "licensed under cc by 4 0",
    "cc-by-sa-ref": "licensed under cc by sa 4 0",
    "cc-by-nc-ref": "licensed under cc by nc 4 0",
    "cc-by-nc-sa-ref": "licensed under cc by nc sa 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "reserved": "all rights reserved",
}
#: The three licences of one family whose notices differ in name and version alone.
GNU = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}
_LATER = [("gpl", "2"), ("gpl", "3"), ("lgpl", "2.1"), ("lgpl", "3"), ("agpl", "3")]


def _gnu() -> dict[str, str]:
    """Their sentences, for a program, a library and a file."""
    out = {"gnu-if-not": "if not see http www gnu org licenses"}
    for subject in ("program", "library", "file"):
        out[f"gnu-free-{subject}"] = f"this {subject} is free software"
        out[f"gnu-hope-{subject}"] = f"this {subject} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
        for kind, name in GNU.items():
            out[f"{kind}-copy-{subject}"] = f"you should have received a copy of the {name} along with this {subject}"
            out[f"{kind}-copy-post-{subject}"] = f"you should have received a copy of the {name} along with this {subject} if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa"
    for kind, name in GNU.items():
        out[f"{kind}-see"] = f"see the {name} for more details"
    for kind, version in _LATER:
        terms = f"you can redistribute it and or modify it under the terms of the {GNU[kind]} as published by the free software foundation either version {version.replace('.', ' ')} of the license or at your option any later version"
        out[f"{kind}-{version}-terms"] = terms
        for subject in ("program", "library", "file"):
            out[f"{kind}-{version}-whole-{subject}"] = f"this {subject} is free software {terms}"
    out["gpl-2-only-terms"] = "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"
    return out


def _gnu_rules() -> list[tuple[str, tuple[str, ...]]]:
    out = []
    for kind, version in [*_LATER, ("gpl", "2-only")]:
        name = f"{kind.upper()}-{version}.0" if "." not in version else f"{kind.upper()}-{version}"
        name = "GPL-2.0-only" if version == "2-only" else f"{name}-or-later"
        terms = "|".join([f"{kind}-{version}-terms", *(f"{kind}-{version}-whole-{x}" for x in ("program", "library", "file") if version != "2-only")])
        either = lambda *p: "|".join(f"{q}-{x}" for q in p for x in ("program", "library", "file"))
        out.append((name, (either("gnu-free") + "?", terms, either("gnu-hope") + "?", f"{kind}-see?", either(f"{kind}-copy", f"{kind}-copy-post") + "?", "gnu-if-not?")))
    return out


SENTENCES |= _gnu()
#: Ordered rules, licence and the run of identifiers it takes (``a|b``: either; ``?``: may be missing); the longer before the shorter.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability?")),
    ("Apache-2.0", ("apache-whole", "apache-obtain?", "apache-url?", "apache-as-is?", "apache-see?")),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-obtain?", "apache-url?", "apache-as-is?", "apache-see?")),
    *_gnu_rules(),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability?")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone", "unlicense-law?", "unlicense-benefit?", "unlicense-intend?", "mit-as-is?", "unlicense-liability?", "unlicense-more?")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("ISC", ("isc-grant", "isc-as-is", "isc-liability?")),
    ("MPL-2.0", ("mpl-terms", "mpl-obtain")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-name-mit",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-licensed",)),
    ("MIT", ("mit-ref-code",)),
    ("ISC", ("isc-ref",)),
    ("BSD", ("bsd-ref",)),
    ("BSD-3-Clause", ("bsd-3-ref",)),
    ("BSD-2-Clause", ("bsd-2-ref",)),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-ref",)),
    ("GPL-3.0", ("gpl-3-ref",)),
    ("GPL-3.0", ("gpl-3-ref-short",)),
    ("GPL-2.0", ("gpl-2-ref",)),
    ("GPL-2.0", ("gpl-2-ref-short",)),
    ("LGPL-3.0", ("lgpl-ref",)),
    ("AGPL-3.0", ("agpl-ref",)),
    ("MPL-2.0", ("mpl-terms",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("Unlicense", ("unlicense-free",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-ref",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("All-rights-reserved", ("reserved",)),
)
#: Every known sentence holds one of these.
MARKERS = "licen|copyright|permi|warrant|redistribut|free software|public domain|reserved|liable|anyone is free|distributed|released under cc|merchantab|dedication"
CUT = r"[.!?:]+(?:[ \t\r\n]+|$)|\n[ \t\r]*(?:#+|//+|\*+|--+|;+|%+)?[ \t\r]*\n"
#: The point of an abbreviated version doesn't end a sentence.
VERSION = r"([ \t\n(])[vV]\. ?([0-9])"


def _ids(text: Column, table: Column) -> Column:
    """``i, id`` of the known sentences, in order: of a sentence, or else of its lines."""
    normal = lambda s: F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")), r"\bhttps\b", "http")
    look = lambda s: F.try_element_at(table, normal(s))
    lines = lambda s: let(F.split(s, "\n"), lambda x: F.when(F.size(x) > 1, F.filter(F.transform(x, look), lambda y: y.isNotNull())).otherwise(F.array().cast("array<string>")))
    known = lambda s: F.when(F.lower(s).rlike(MARKERS), let(look(s), lambda y: F.when(y.isNotNull(), F.array(y)).otherwise(lines(s))))
    parts = F.split(F.regexp_replace(text, VERSION, "$1v $2"), CUT)
    numbered = F.transform(parts, lambda s, i: let(known(s), lambda k: F.transform(k, lambda x: F.struct(i.alias("i"), x.alias("id")))))
    return F.flatten(F.filter(numbered, lambda x: x.isNotNull()))


def sequence(text: Column) -> Column:
    """Identifiers of the known sentences of a text, blank-separated, in order, with ``~`` where too many others lie between."""
    table = F.create_map(*(F.lit(x) for i, s in SENTENCES.items() for x in (s, i)))
    marked = lambda k: F.transform(k, lambda x, n: F.concat(F.when(x["i"] - F.get(k, n - 1)["i"] > GAP + 1, "~ ").otherwise(""), x["id"]))
    found = let(table, lambda t: let(_ids(text, t), lambda k: F.array_join(marked(k), " ")))
    return F.coalesce(F.when(F.lower(text).rlike(MARKERS), found), F.lit(""))


def pattern(run: tuple[str, ...]) -> str:
    """A rule's expression over identifiers with a blank on either side."""
    return "".join(f"(?:{'|'.join(f' {x} ' for x in part.rstrip('?').split('|'))}){'?' if part.endswith('?') else ''}" for part in run)


def apply_rules(ids: Column) -> Column:
    """Sorted distinct licences of a sequence of identifiers; ``partial`` if some are left over."""
    left = F.concat(F.lit(" "), F.regexp_replace(ids, " ", "  "), F.lit(" "))
    for licence, run in RULES:
        left = F.regexp_replace(left, pattern(run), f" ={licence} ")
    found = F.filter(F.split(left, " +"), lambda x: (x != "") & (x != "~"))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.when(x.startswith("="), F.substring(x, 2, 64)).otherwise("partial"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sentence_ids, licences`` of every row; licences is an array."""
    rows = docs.select(F.col(id_col).alias("doc_id"), sequence(F.col(text_col)).alias("sentence_ids"))
    # Most texts hold no known sentence.
    return rows.withColumn("licences", F.when(F.col("sentence_ids") == "", F.array().cast("array<string>")).otherwise(apply_rules(F.col("sentence_ids"))))


def op7_licences(spark, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    n = F.size(F.filter(F.split("sentence_ids", " "), lambda x: (x != "") & (x != "~")))
    return found.select("doc_id", n.cast("long").alias("n_sentences"), "sentence_ids", F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    left = "' ' || replace(sentence_ids, ' ', '  ') || ' '"
    for licence, run in RULES:
        left = f"regexp_replace({left}, '{pattern(run)}', ' ={licence} ', 'g')"
    known = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())
    normal = "regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), '\\bhttps\\b', 'http', 'g')"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
segment AS (SELECT doc_id, text, unnest(range(len(s))) AS i, unnest(s) AS s
            FROM (SELECT doc_id, text, string_split_regex(regexp_replace(text, '{VERSION}', '\\1v \\2', 'g'), '{CUT}') AS s FROM documents)),
whole AS (SELECT doc_id, text, i, 0 AS j, id FROM segment JOIN known ON {normal} = sentence),
line AS (SELECT doc_id, text, i, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS s
         FROM (SELECT *, string_split(s, chr(10)) AS x FROM segment) WHERE len(x) > 1),
part AS (SELECT doc_id, text, i, j, id FROM line JOIN known ON {normal} = sentence
         WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.doc_id IS NOT DISTINCT FROM line.doc_id AND w.text = line.text AND w.i = line.i)),
hit AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id, text ORDER BY i, j) AS step FROM (SELECT * FROM whole UNION ALL SELECT * FROM part)),
ids AS (SELECT doc_id, text, string_agg(CASE WHEN step > {GAP + 1} THEN '~ ' ELSE '' END || id, ' ' ORDER BY i, j) AS sentence_ids, count(*) AS n FROM hit GROUP BY doc_id, text),
every AS (SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids
          FROM documents d LEFT JOIN ids ON d.doc_id IS NOT DISTINCT FROM ids.doc_id AND d.text = ids.text),
ruled AS (SELECT *, list_filter(string_split_regex({left}, ' +'), lambda x: x <> '' AND x <> '~') AS found FROM every)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(found, lambda x: CASE WHEN x[1] = '=' THEN x[2:] ELSE 'partial' END))), ','), '') AS licences
FROM ruled"""


ORACLE = _sql()
