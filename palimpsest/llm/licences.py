"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences (at line ends, and behind . ; : ! ? before a blank), each is normalised (A-Z lower-cased, other runs than ASCII letters and digits to
one blank) and looked up in a table of known licence sentences. The identifiers that are found, in order, are matched against ordered rules: a rule names a licence
and the identifiers that must follow each other. All rules that match count. Wrapped lines are joined in a second reading of the text. Every step is linear in the text.

Nulls and empty texts have no sentences and no licences. Repeated sentences count each time. Columns of the same names are replaced; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known sentences of public licences, normalised, by identifier.
SENTENCES = {
    "mit-line": "released under the mit license",
    "mit-line2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache-line": "licensed under the apache license version 2 0",
    "apache-head": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "gpl3-line": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "bsd-line": "licensed under the bsd 3 clause license",
    "bsd2-line": "licensed under the bsd 2 clause license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "lgpl-line": "this library is free software",
    "lgpl21-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-line": "this work is licensed under the gnu affero general public license version 3",
    "isc-line": "licensed under the isc license",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-line": "licensed under cc by 4 0",
    "cc-by-sa-line": "licensed under cc by sa 4 0",
    "cc-by-nc-line": "licensed under cc by nc 4 0",
    "cc-by-nd-line": "licensed under cc by nd 4 0",
    "cc0-line": "released into the public domain under cc0 1 0",
    "mpl-line": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
#: Ordered rules: (licence, the identifiers that follow each other). A rule whose identifiers only begin those of a longer rule that matches at the same place gives way to it.
RULES = [
    ("AGPL-3.0", ["agpl3-line"]), ("AGPL-3.0-or-later", ["gpl-free", "agpl3-terms"]), ("Apache-2.0", ["apache-head", "apache-use"]), ("Apache-2.0", ["apache-line"]),
    ("BSD-2-Clause", ["bsd2-line"]), ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]), ("BSD-3-Clause", ["bsd-line"]), ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSL-1.0", ["bsl-grant"]), ("CC-BY-4.0", ["cc-by-line"]), ("CC-BY-4.0", ["cc-by-work"]), ("CC-BY-NC-4.0", ["cc-by-nc-line"]), ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-line"]), ("CC-BY-ND-4.0", ["cc-by-nd-work"]), ("CC-BY-SA-4.0", ["cc-by-sa-line"]), ("CC-BY-SA-4.0", ["cc-by-sa-work"]), ("CC0-1.0", ["cc0-line"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms"]), ("GPL-3.0", ["gpl3-line"]), ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]), ("ISC", ["isc-grant"]), ("ISC", ["isc-line"]),
    ("LGPL-2.1-or-later", ["lgpl-line", "lgpl21-terms"]), ("MIT", ["mit-grant", "mit-notice"]), ("MIT", ["mit-line"]), ("MIT", ["mit-line2"]), ("MPL-2.0", ["mpl-line"]),
    ("Unlicense", ["unlicense-free"]), ("Zlib", ["zlib-grant", "zlib-origin"]),
]
#: Known sentences that the cut itself divides ("v. 2.0", "Foundation; either"): the parts that must follow each other; they count as one.
PARTED = {
    "mpl-header": ["this source code form is subject to the terms of the mozilla public license v", "2 0"],
    "gpl2-header": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "either version 2 of the license or at your option any later version"],
    "gpl3-header": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "either version 3 of the license or at your option any later version"],
}
PARTED_RULES = [("GPL-2.0-or-later", ["gpl-free", "gpl2-header"]), ("GPL-3.0-or-later", ["gpl-free", "gpl3-header"]), ("MPL-2.0", ["mpl-header"])]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def identifiers(text: Column, sentences: dict[str, str], parted: dict[str, list[str]]) -> Column:
    """The known sentences of a text, in order. Parts of a divided sentence count only where they follow each other."""
    part = {p: f"/{i}" for i, p in enumerate(sorted({p for parts in parted.values() for p in parts} - set(sentences.values())))}
    ids = {v: k for k, v in sorted(sentences.items())} | part
    found = _looked_up(text, ids)
    if not parted:
        return found
    joined = F.concat(F.lit(","), F.array_join(found, ",,"), F.lit(","))  # two commas, so that neighbours don't share one
    for k, parts in sorted(parted.items()):
        joined = F.replace(joined, F.lit("".join(f",{ids[p]}," for p in parts)), F.lit(f",{k},"))
    return F.filter(F.split(joined, ","), lambda s: (s != "") & ~s.startswith("/"))


def _looked_up(text: Column, ids: dict[str, str]) -> Column:
    cut = F.split(F.regexp_replace(text, r"([.;:!?])[ \t\r]+", "$1\n"), "\n")
    plain = F.transform(F.filter(cut, lambda s: F.length(s) > 0), lambda s: F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " ")))
    table = F.create_map(*[F.lit(x) for v, k in ids.items() for x in (v, k)])
    return F.filter(F.transform(F.filter(plain, lambda s: s.isin(sorted(ids))), lambda s: table[s]), lambda s: s.isNotNull())


def _holds(sequence: Column, ids: list[str], rules: list[tuple[str, list[str]]]) -> Column:
    """Whether the identifiers follow each other somewhere without beginning a longer rule's there."""
    mine = "," + ",".join(ids) + ","
    for longer in sorted({",".join(x) for _, x in rules if len(x) > len(ids) and x[: len(ids)] == ids}):
        sequence = F.replace(sequence, F.lit(f",{longer},"), F.lit(",,"))
    return sequence.contains(mine)


def scanned(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """``docs`` with sentence_ids (line by line, then those that only wrapped lines give) and licences, both arrays."""
    parted = {} if sentences else PARTED
    sentences, rules = sentences or SENTENCES, rules or (RULES if sentences else RULES + PARTED_RULES)
    text = F.coalesce("text", F.lit(""))
    out = docs.drop("sentence_ids", "licences").withColumn("_lines", identifiers(text, sentences, parted)).withColumn("_joined", identifiers(F.translate(text, "\n", " "), sentences, parted))
    out = out.withColumn("sentence_ids", F.concat("_lines", F.array_except("_joined", "_lines")))
    lines, joined = (F.concat(F.lit(","), F.array_join(c, ","), F.lit(",")) for c in ("_lines", "_joined"))
    found = F.array(*[F.when(_holds(lines, ids, rules) | _holds(joined, ids, rules), F.lit(name)) for name, ids in rules])
    return out.withColumn("licences", F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))).drop("_lines", "_joined")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    values = ", ".join(f"('{v}', '{k}')" for k, v in SENTENCES.items())
    longer = {i: next((",".join(y) for _, y in RULES if len(y) > len(x) and y[: len(x)] == x), "-") for i, (_, x) in enumerate(RULES)}
    rules = ", ".join(f"('{name}', ',{','.join(ids)},', ',{longer[i]},')" for i, (name, ids) in enumerate(RULES))
    cut = r"unnest(string_split(regexp_replace({}, '([.;:!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)))"
    norm = r"trim(regexp_replace(translate(p.s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    reading = lambda name, text: f"""{name} as (select doc_id, list(k.id order by i) ids from (select doc_id, {cut.format(text)} s, generate_subscripts(string_split(regexp_replace({text}, '([.;:!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)), 1) i from documents) p join k on {norm} = k.s group by doc_id)"""
    return f"""
with k as (select * from (values {values}) t(s, id)), r as (select * from (values {rules}) t(name, ids, longer)),
{reading("a", "coalesce(text, '')")}, {reading("b", r"translate(coalesce(text, ''), chr(10), ' ')")},
d as (select doc_id, coalesce(a.ids, []) x, coalesce(b.ids, []) y from documents left join a using (doc_id) left join b using (doc_id))
select doc_id, array_to_string(list_concat(x, list_filter(list_distinct_in_order, lambda z: not list_contains(x, z))), ',') sentence_ids,
       coalesce((select string_agg(distinct name, ',' order by name) from r where contains(replace(',' || array_to_string(x, ',') || ',', r.longer, ',,'), r.ids) or contains(replace(',' || array_to_string(y, ',') || ',', r.longer, ',,'), r.ids)), '') licences
from (select *, list_filter(y, lambda z, i: list_position(y, z) = i) list_distinct_in_order from d)
"""


SQL = _sql()
