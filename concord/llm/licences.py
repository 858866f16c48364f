"""Licence scans: sentences become identifiers, sequences of identifiers match ordered rules. DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences, already normalised (lower case, letters and digits, single spaces), by identifier.
SENTENCES = {
    "copyright": "copyright notice",
    "rights": "all rights reserved",
    "mit-ref": "released under the mit license",
    "mit-ref2": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title2": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "apache2-ref": "licensed under the apache license version 2 0",
    "apache2-the": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-url": "http www apache org licenses license 2 0",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl2-ref": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4 0",
    "cc-by-nc-nd": "licensed under cc by nc nd 4 0",
    "cc0": "licensed under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "proprietary": "unauthorized copying of this file via any medium is strictly prohibited",
}
#: Rules, each a licence and the identifiers that must follow one another. Longer rules are tried first.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref2",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title2",)),
    ("ISC", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache2-the", "apache2-comply", "apache2-copy", "apache2-url", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-the", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-the",)),
    ("Apache-2.0", ("apache2-ref",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl2",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("rights", "proprietary")),
    ("Proprietary", ("proprietary",)),
)
#: Every sentence above holds one of these stems, so a text without any has none of the sentences.
STEMS = ("licens", "copyright", "permission", "redistribut", "warrant", "rights reserved", "http", "prohibited", "public domain")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sentence ends at a mark before white space; and with its line, or with its paragraph.
END_OF_SENTENCE = r"([.!?;:])[\x20\t]+|[\r\n]+"
END_IN_FLOW = r"([.!?;:])[\x20\t\r\n]+|(?:\r?\n[\x20\t]*){2,}"
COPYRIGHT = r"^copyright ((c|[0-9]+) )*[^ ].*$"
CUT = "\x1e"


def normalised(sentence: Column) -> Column:
    """Letters and digits of a sentence in lower case, single spaces; a copyright line loses its years and holder."""
    plain = F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), r"[^a-z0-9]+", " "))
    return F.regexp_replace(plain, COPYRIGHT, "copyright notice")


def known(text: Column, ends: str, sentences: dict[str, str]) -> Column:
    """Identifiers of a text's known sentences in order, each as ``|id|``."""
    pieces = F.transform(F.split(F.regexp_replace(text, ends, "$1" + CUT), CUT), normalised)
    hits = F.filter(pieces, lambda s: s.isin(list(sentences.values())))
    names = F.create_map(*[F.lit(x) for key, s in sentences.items() for x in (s, f"|{key}|")])
    return F.transform(hits, lambda s: names[s])


def scan(
    docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES,
    stems: Sequence[str] = STEMS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_known, sentences, licences, n_unmatched) of every row of ``docs``.

    Each sentence of a text is normalised and looked up among the known ones. What is left is the sequence of known
    identifiers; rules, the longest first, take their identifiers out of it wherever they follow one another. A text is
    read twice, with line ends as ends of sentences and with the lines of a paragraph flowing into one another, so that wrapped sentences
    and lone lines are both met; the reading that knows more is kept (the first on a tie). All of it happens inside the
    row, in one pass without a shuffle; texts without any stem are not split.

    ``sentences`` and ``licences`` are comma-joined, the licences distinct and in order of their name. Null and empty
    texts have none. Repeated rows and ids get a row each, null ids stay, other columns are not read, an empty table
    gives an empty table.
    """
    if lost := [key for key, s in sentences.items() if not any(stem in s for stem in stems)]:
        raise ValueError(f"no stem occurs in {lost}")
    # Each rule stands for its identifiers in their order; a longer one goes first, ties in the given order.
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    hopeful = F.translate(F.col(text_col), UPPER, LOWER).rlike("|".join(re.sub(" ", "[^a-z0-9]+", s) for s in stems))
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(hopeful, F.col(text_col)).alias("text"))
    lines = F.when(F.col("text").isNull(), none).otherwise(known(F.col("text"), END_OF_SENTENCE, sentences))
    flow = F.when(F.col("text").isNull(), none).otherwise(known(F.col("text"), END_IN_FLOW, sentences))
    rows = rows.select("doc_id", lines.alias("lines"), flow.alias("flow"))
    rows = rows.select("doc_id", F.when(F.size("flow") > F.size("lines"), F.col("flow")).otherwise(F.col("lines")).alias("found"))
    left, licences = F.array_join("found", ""), []
    for i, (licence, ids) in enumerate(ordered):
        before, wanted = f"left{i}", "".join(f"|{x}|" for x in ids)
        rows = rows.withColumn(before, left)
        licences.append(F.when(F.col(before).contains(wanted), F.lit(licence)))
        left = F.replace(F.col(before), F.lit(wanted), F.lit("/"))
    left = F.regexp_replace(left, r"\|(copyright|rights)\|", "/")
    names = F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*licences), lambda x: x.isNotNull()))), ",")
    listed = F.array_join(F.transform("found", lambda s: F.regexp_replace(s, r"\|", "")), ",")
    return rows.select(
        "doc_id", F.size("found").cast("long").alias("n_known"), listed.alias("sentences"), names.alias("licences"),
        F.regexp_count(left, F.lit(r"\|[^|]+\|")).cast("long").alias("n_unmatched"),
    )


def scan_sql(sentences: dict[str, str] = SENTENCES, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES) -> str:
    """The scan as DuckDB SQL over ``documents``, without the stems."""
    names = ", ".join(f"('{s}', '{k}')" for k, s in sentences.items())

    def reading(ends: str) -> str:
        sep = "\\x1e"
        return f"""list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '{ends}', '\\1' || chr(30), 'g'), chr(30)),
          lambda s: element_at(m, regexp_replace(trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), '{COPYRIGHT}', 'copyright notice'))[1]), lambda x: x IS NOT NULL)""".replace(sep, "")

    steps, left = [], "array_to_string(list_transform(found, lambda x: '|' || x || '|'), '')"
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    source = "k"
    for i, (licence, ids) in enumerate(ordered):
        wanted = "".join(f"|{x}|" for x in ids)
        said = f"{left}" if i == 0 else "rest"
        had = "[]::VARCHAR[]" if i == 0 else "had"
        steps.append(f"r{i} AS (SELECT doc_id, found, replace({said}, '{wanted}', '/') AS rest, CASE WHEN contains({said}, '{wanted}') THEN list_append({had}, '{licence}') ELSE {had} END AS had FROM {source})")
        source = f"r{i}"
    return f"""WITH names AS (SELECT map_from_entries(list((s, k))) AS m FROM (VALUES {names}) v(s, k)),
b AS (SELECT doc_id, {reading(END_OF_SENTENCE)} AS lines, {reading(END_IN_FLOW)} AS flow FROM documents, names),
k AS (SELECT doc_id, CASE WHEN len(flow) > len(lines) THEN flow ELSE lines END AS found FROM b),
{", ".join(steps)}
SELECT doc_id, len(found)::BIGINT AS n_known, array_to_string(found, ',') AS sentences, array_to_string(list_sort(list_distinct(had)), ',') AS licences,
  len(regexp_extract_all(regexp_replace(rest, '\\|(copyright|rights)\\|', '/', 'g'), '\\|[^|]+\\|'))::BIGINT AS n_unmatched
FROM {source}"""
