"""Licence scan by sentences and ordered rules.

A text is cut into sentences, each is normalised (lower case, letters and digits only, single
spaces) and looked up among known licence sentences. The numbers found, in order, are matched
against rules: a rule names sentences that must follow each other, other known ones may lie
between. Rules are tried in order, the more specific first.

Line breaks before a capital, bracket or list mark, and comment marks at the start of a line, may end
a sentence but need not: a header reads the same wrapped, unwrapped or commented out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, by number: fixed values.
SENTENCES = {
    1: "Released under the MIT License.",
    2: "Licensed under the Apache License, Version 2.0.",
    3: "This work is licensed under the GNU General Public License, version 3.",
    4: "Licensed under CC BY-NC 4.0.",
    5: "All rights reserved.",
    6: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    7: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    8: "The software is provided as is, without warranty of any kind.",
    9: "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    10: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    11: "Licensed under the Apache License, Version 2.0 (the License).",
    12: "You may not use this file except in compliance with the License.",
    13: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    14: "This program is free software.",
    15: "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    16: "Either version 3 of the License, or (at your option) any later version.",
    17: "Either version 2 of the License, or (at your option) any later version.",
    18: "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    19: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    20: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    21: "Licensed under CC BY 4.0.",
    22: "Licensed under CC BY-SA 4.0.",
    23: "This work is in the public domain.",
    24: "Licensed under the MIT License.",
}
#: Further wordings of known sentences, as the standard texts have them: fixed values.
WORDINGS = {
    6: (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    7: ("The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",),
    8: (
        'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of '
        "merchantability, fitness for a particular purpose and noninfringement.",
    ),
    9: ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    10: (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
        "The names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    16: ("Either version 3, or (at your option) any later version.",),
    17: ("Either version 2, or (at your option) any later version.",),
}
_GPL = "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
SENTENCES |= {
    25: _GPL + "either version 3 of the License, or (at your option) any later version.",
    26: _GPL + "either version 2 of the License, or (at your option) any later version.",
    27: _GPL + "version 3 of the License.",
    28: _GPL + "version 2 of the License.",
    29: "Version 3 of the License.",
    30: "Version 2 of the License.",
}
WORDINGS |= {25: (_GPL + "either version 3, or (at your option) any later version.",), 26: (_GPL + "either version 2, or (at your option) any later version.",), 27: (_GPL + "version 3.",), 28: (_GPL + "version 2.",)}
#: (licence, numbers that follow each other), most specific first: fixed values.
LICENCE_RULES = (
    ("bsd-3-clause", (9, 10)),
    ("gpl-3.0-or-later", (15, 16)),
    ("gpl-2.0-or-later", (15, 17)),
    ("gpl-3.0-or-later", (25,)),
    ("gpl-2.0-or-later", (26,)),
    ("gpl-3.0", (27,)),
    ("gpl-2.0", (28,)),
    ("gpl-3.0", (15, 29)),
    ("gpl-2.0", (15, 30)),
    ("mit", (6, 7)),
    ("apache-2.0", (11, 12)),
    ("apache-2.0", (12, 13)),
    ("mit", (1,)),
    ("mit", (24,)),
    ("apache-2.0", (2,)),
    ("gpl-3.0", (3,)),
    ("cc-by-nc-4.0", (4,)),
    ("mpl-2.0", (18,)),
    ("cc-by-sa-4.0", (20,)),
    ("cc-by-sa-4.0", (22,)),
    ("cc-by-4.0", (19,)),
    ("cc-by-4.0", (21,)),
    ("public-domain", (23,)),
    ("bsd-2-clause", (9,)),
    ("mit", (6,)),
    ("apache-2.0", (11,)),
    ("all-rights-reserved", (5,)),
)
MARK, SOFT = "\x01", "\x02"
#: Where a sentence ends, and where it may end: before a capital, bracket or list mark, or at comment marks that start a line.
HARD_STOP = r"([.!?:;])[\x20\x09-\x0D]+"
SOFT_STOP = r"\n[\x20\x09]*(?:[#*;!%/-]+[\x20\x09]*|(?=[A-Z(]))"


def normal(sentence: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9]+", " ", sentence.lower()).split())


#: Numbers by normalised sentence.
NUMBERS = {normal(s): n for n, s in SENTENCES.items()} | {normal(s): n for n, more in WORDINGS.items() for s in more}
#: The same sentence with any holder's name.
HOLDER, _ANY_HOLDER = normal(WORDINGS[10][0]), "neither the name of (?:[a-z0-9]+[ \x01\x02]+){1,12}?nor the names of (?:its|any|the) contributors"
_KNOWN = "|".join([HOLDER.replace("neither the name of the copyright holder nor the names of its contributors", _ANY_HOLDER), *sorted(NUMBERS, key=len, reverse=True)])
#: A known sentence between two ends; inside, soft ends count as spaces. The longest that fits comes first.
PATTERN = f"[{MARK}{SOFT}] ?({re.sub(r' (?![^\[]*\])', f'[ {SOFT}]+', _KNOWN)})(?= ?[{MARK}{SOFT}])"


def sentences(text: Column) -> Column:
    """The known sentences in order, normalised."""
    # Marks at the start of a line go before stops are sought: ";;" or "!" there ends nothing.
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), MARK + SOFT, "  "), SOFT_STOP, SOFT)
    marked = F.concat(F.lit(MARK), F.regexp_replace(marked, HARD_STOP, MARK), F.lit(MARK))
    lower = F.translate(marked, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(F.regexp_replace(lower, f"[^a-z0-9{MARK}{SOFT}]+", " "), F.lit(PATTERN), F.lit(1))
    return F.transform(found, _normal)


def _normal(s: Column) -> Column:
    plain = F.regexp_replace(s, f"[ {MARK}{SOFT}]+", " ")
    return F.when(plain.startswith("neither the name of ") & plain.endswith(HOLDER[HOLDER.index("may be used") :]), HOLDER).otherwise(plain)


def _rule_pattern(numbers: tuple[int, ...]) -> str:
    return "," + "(?:[0-9,]*,)?".join(f"{n}," for n in numbers)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc (all columns), sentence_ids (numbers in order, as text), n_known, licence (null if none), licences.

    ``licence`` is that of the first rule that fits, ``licences`` those of all rules that fit, in
    rule order without repeats. Null and empty texts have no sentences; repeats of a sentence stay
    in the sequence; every row is scanned whole; an empty table gives an empty one.
    """
    table = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    rows = docs.select(F.struct("*").alias("doc"), sentences(F.col(text)).alias("s"))
    known = F.filter(F.transform(F.filter("s", lambda s: s.isin(*NUMBERS)), lambda s: F.element_at(table, s)), lambda n: n.isNotNull())
    rows = rows.select("doc", known.alias("known"))
    ids = F.array_join(F.transform("known", lambda n: n.cast("string")), ",")
    rows = rows.select("doc", ids.alias("sentence_ids"), F.size("known").cast("bigint").alias("n_known"))
    line = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    fits = [F.when(F.regexp_like(line, F.lit(_rule_pattern(numbers))), F.lit(name)) for name, numbers in LICENCE_RULES]
    found = F.array_distinct(F.array_compact(F.array(*fits)))
    rows = rows.select("*", F.when(F.col("n_known") > 0, found).otherwise(F.array().cast("array<string>")).alias("licences"))
    return rows.select("doc", "sentence_ids", "n_known", F.get("licences", F.lit(0)).alias("licence"), "licences")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs)
    return out.select("doc.doc_id", "sentence_ids", "n_known", "licence", F.array_join("licences", ",").alias("licences"))


_VALUES = ", ".join(f"('{s}', {n})" for s, n in NUMBERS.items())
_RULES = ", ".join(f"({k}, '{name}', '{_rule_pattern(numbers)}')" for k, (name, numbers) in enumerate(LICENCE_RULES))
ORACLE = rf"""
WITH v(s, n) AS (VALUES {_VALUES}), rules(k, name, pattern) AS (VALUES {_RULES}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
e AS (
  SELECT r, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (
    SELECT r, string_split(regexp_replace(coalesce(text, ''), '([.!?:;])[ \t\n\x0B\f\r]+|\n([A-Z(*#])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS x FROM d)
), k AS (
  SELECT r, string_agg(n::VARCHAR, ',' ORDER BY i) AS ids, count(*) AS c FROM (
    SELECT r, i, trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS s FROM e) e JOIN v USING (s)
  GROUP BY r
), m AS (
  SELECT r, list(name ORDER BY first_k) AS names FROM (
    SELECT r, name, min(rules.k) AS first_k FROM k JOIN rules ON regexp_matches(',' || ids || ',', pattern) GROUP BY r, name)
  GROUP BY r
)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(c, 0)::BIGINT AS n_known, names[1] AS licence, coalesce(array_to_string(names, ','), '') AS licences
FROM d LEFT JOIN k USING (r) LEFT JOIN m USING (r)
"""
