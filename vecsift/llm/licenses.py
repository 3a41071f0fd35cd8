"""Licence scans by sentence rules, in DataFrame operations only.

A text is cut into sentences, at . ! ? ; : before a blank and at empty lines; they are normalised (ASCII letters and digits in lower case,
single blanks) and the known licence sentences are found among them. A sentence may be wrapped: it is one or more whole lines, or parts of
lines, that follow each other with no end of a sentence and no empty line between, whatever comment marks the lines start with. A line of
its own, such as a title, is a sentence too; a line within a known sentence is not counted again. The identifiers that come out, in order,
are matched against ordered licence rules: a rule holds where its identifiers stand next to each other, and identifiers that an earlier
rule takes are not matched again, so a text of three BSD clauses is not one of two. Everything happens within
the row, with no shuffle; the tables are literals of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Sentences of well-known licences and notices, by identifier, as the cut leaves them (at . ! ? ; : before a blank).
SENTENCES = {
    "mit-name": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-ref": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"],
    "isc-name": ["ISC License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "apache-name": ["Apache License"],
    "apache-ref": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0"],
    "gpl-name": ["GNU GENERAL PUBLIC LICENSE"],
    "gpl-free": ["This program is free software"],
    "gpl2-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "either version 2 of the License, or (at your option) any later version"],
    "gpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "cc-by-nc-4": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-4": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "mpl-2-title": ["Mozilla Public License Version 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "0bsd-name": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "bsd-as-is": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "gpl2-title": ["GNU General Public License Version 2, June 1991"],
    "gpl3-title": ["GNU General Public License Version 3, 29 June 2007"],
    "lgpl21-title": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "lgpl3-title": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "agpl3-title": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "gpl-free-library": ["This library is free software"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "lgpl21-later": ["either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "epl-2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"],
    "epl-1": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "cc0-1": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "This work is licensed under CC0 1.0", "Licensed under CC0 1.0"],
    "bsl-1": ["Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
}

# Ordered rules, the more specific first.
RULES = [
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-ref"]),
    ("ISC", ["isc-name", "isc-grant"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-ref", "apache-use"]),
    ("Apache-2.0", ["apache-ref"]),
    ("GPL-3.0", ["gpl-free", "gpl3-later"]),
    ("GPL-2.0", ["gpl-free", "gpl2-later"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("MPL-2.0", ["mpl-2"]),
    ("MPL-2.0", ["mpl-2-title"]),
    ("Unlicense", ["unlicense"]),
    ("0BSD", ["0bsd-name", "0bsd-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Apache-2.0", ["apache-title"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("LGPL-2.1", ["gpl-free-library", "lgpl-terms", "lgpl21-later"]),
    ("LGPL-2.1", ["gpl-free", "lgpl-terms", "lgpl21-later"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("LGPL-3.0", ["gpl-free", "lgpl3-later"]),
    ("LGPL-3.0", ["gpl-free-library", "lgpl3-later"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("AGPL-3.0", ["gpl-free", "agpl3-later"]),
    ("AGPL-3.0", ["agpl3-title"]),
    ("EPL-2.0", ["epl-2"]),
    ("EPL-1.0", ["epl-1"]),
    ("CC0-1.0", ["cc0-1"]),
    ("BSL-1.0", ["bsl-1"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
]


def normalise(sentence: str) -> str:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in sentence)
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in low).split())


KNOWN = {normalise(s): i for i, listed in SENTENCES.items() for s in listed}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Every known sentence holds one of these, so a sentence without any is not one; a test asserts it.
CUES = ["licen", "copyright", "permission", "redistribut", "warrant", "free software", "public domain", "endorse", "cc by", "zero clause", "this library"]
PREFIX = "(?:rem|dnl)"  # comment prefixes of letters; marks of other characters go with the normalising
CUE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else f"[^A-Za-z0-9]+(?:(?i:{PREFIX})[^A-Za-z0-9]+)?" for c in cue) for cue in CUES)
# In a normalised text / is the end of a line and | that of a sentence or paragraph. The longest first.
WRAPPED = f"(?<=[|/])(?:{'|'.join(s.replace(' ', '[ /]') for s in sorted(KNOWN, key=lambda s: (-len(s), s)))})(?=[|/])"


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences, in order."""
    held = F.when(text.rlike(CUE), text).otherwise(F.lit(""))
    marked = F.concat(F.lit("/"), F.translate(held, UPPER + "|/\n", LOWER + ",,/"), F.lit("/"))
    ended = F.regexp_replace(F.regexp_replace(marked, "[.!?;:](?=[ \\t\\r\\f/])", "|"), "[^a-z0-9|/]+", " ")
    lines = F.regexp_replace(ended, f"/ ?{PREFIX}(?=[ /])", "/")
    cut = F.regexp_replace(F.regexp_replace(lines, " ?[|/][ |/]*[|/] ?| ?[|] ?", "|"), " ?/ ?", "/")
    known = F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv])
    return F.transform(F.regexp_extract_all(cut, F.lit(WRAPPED), F.lit(0)), lambda s: F.try_element_at(known, F.translate(s, "/", " ")))


# A rule as its identifiers, each between blanks of its own; where several hold at one place, the earlier.
RULE_NAMES = {"".join(f" {i} " for i in rule): name for name, rule in RULES}
RULE = "|".join(RULE_NAMES)


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_sentences (known ones), sentence_ids, licences (comma-joined, in the order of the text), licence
    (the first, or null).

    Null and empty texts have none. A licence is named once, however often it holds. Texts of any length are read whole; repeated rows get
    equal results; extra columns are not read; an empty table stays empty.
    """
    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    line = F.array_join(F.transform("ids", lambda i: F.concat(F.lit(" "), i, F.lit(" "))), "")
    names = F.create_map(*[F.lit(x) for kv in RULE_NAMES.items() for x in kv])
    held = F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(RULE), F.lit(0)), lambda r: F.try_element_at(names, r)))
    found = found.select("doc_id", "ids", held.alias("held"))
    return found.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_sentences"), F.coalesce(F.array_join("ids", " "), F.lit("")).alias("sentence_ids"), F.coalesce(F.array_join("held", ","), F.lit("")).alias("licences"), F.try_element_at("held", F.lit(1)).alias("licence"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir))


def _oracle() -> str:
    """The same by plain joins: lines as rows of a paragraph, known sentences as runs of whole lines, found by their first words and taken
    from the left, the longest first; rules likewise as runs of identifiers."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in KNOWN.items())
    rules = ", ".join(f"({k}, {quote(name)}, [{', '.join(map(quote, rule))}])" for k, (name, rule) in enumerate(RULES))
    longest = max(s.count(" ") + 1 for s in KNOWN)
    return f"""
WITH RECURSIVE known(sentence, id) AS (VALUES {known}),
rules(place, licence, ids) AS (VALUES {rules}),
ended AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}|/' || chr(10), '{LOWER},,/') || '/', '[.!?;:]([ \\t\\r\\f/])', '|\\1', 'g') AS t FROM documents),
plain AS (SELECT doc_id, '/' || regexp_replace(t, '[^a-z0-9|/]+', ' ', 'g') AS t FROM ended),
bare AS (SELECT doc_id, replace(regexp_replace(replace(t, '/', '/~'), '~ ?{PREFIX}([ /])', '\\1', 'g'), '~', '') AS t FROM plain),
parted AS (SELECT doc_id, string_split(regexp_replace(t, '/ ?/[ /]*', '|', 'g'), '|') AS paragraphs FROM bare),
paragraphs AS (SELECT doc_id, unnest(range(1, len(paragraphs) + 1)) AS p, unnest(paragraphs) AS body FROM parted),
lines AS (SELECT doc_id, p, [trim(x) for x in string_split(body, '/') if trim(x) <> ''] AS lines FROM paragraphs),
starts AS (SELECT doc_id, p, lines, unnest(range(1, len(lines) + 1)) AS i FROM lines WHERE len(lines) > 0),
firsts AS (SELECT sentence, id, split_part(sentence, ' ', 1) AS word FROM known),
near AS (SELECT doc_id, p, lines, i, sentence, id FROM starts JOIN firsts ON word = split_part(lines[i], ' ', 1) WHERE starts_with(sentence || ' ', lines[i] || ' ')),
runs AS (SELECT doc_id, p, lines, i, sentence, id, unnest(range(i, least(len(lines), i + {longest}) + 1)) AS j FROM near),
found AS (SELECT doc_id, p, i, max(j) AS j, arg_max(id, j) AS id FROM runs WHERE array_to_string(lines[i:j], ' ') = sentence GROUP BY doc_id, p, i),
taken(doc_id, p, i, j, id) AS (
  SELECT doc_id, p, i, j, id FROM found f WHERE i = (SELECT min(i) FROM found g WHERE g.doc_id = f.doc_id AND g.p = f.p)
  UNION ALL SELECT f.doc_id, f.p, f.i, f.j, f.id FROM taken t JOIN found f ON f.doc_id = t.doc_id AND f.p = t.p AND f.i > t.j
  WHERE f.i = (SELECT min(g.i) FROM found g WHERE g.doc_id = t.doc_id AND g.p = t.p AND g.i > t.j)),
ids AS (SELECT doc_id, list(id ORDER BY p, i) AS ids FROM taken GROUP BY doc_id),
places AS (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM ids),
holds AS (SELECT doc_id, i, min(place) AS place, arg_min(i + len(rules.ids) - 1, place) AS j, arg_min(licence, place) AS licence FROM places JOIN rules ON places.ids[i:i + len(rules.ids) - 1] = rules.ids GROUP BY doc_id, i),
kept(doc_id, i, j, licence) AS (
  SELECT doc_id, i, j, licence FROM holds h WHERE i = (SELECT min(i) FROM holds g WHERE g.doc_id = h.doc_id)
  UNION ALL SELECT h.doc_id, h.i, h.j, h.licence FROM kept k JOIN holds h ON h.doc_id = k.doc_id AND h.i > k.j
  WHERE h.i = (SELECT min(g.i) FROM holds g WHERE g.doc_id = k.doc_id AND g.i > k.j)),
once AS (SELECT doc_id, licence, min(i) AS i FROM kept GROUP BY doc_id, licence),
named AS (SELECT doc_id, string_agg(licence, ',' ORDER BY i) AS licences, arg_min(licence, i) AS licence FROM once GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ids), 0) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, coalesce(licences, '') AS licences, licence
FROM documents d LEFT JOIN ids USING (doc_id) LEFT JOIN named USING (doc_id)
"""


ORACLE = _oracle()
