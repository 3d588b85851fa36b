"""Licence recognition by sentences and rules over their order.

A text is cut into pieces, these are normalised (letters and digits in lower case, one space between
words), and known licence sentences are looked up among them.  A cut may fall inside a sentence, for licences
are wrapped and hold colons, so a sentence is a piece or several in a row.  The identifiers found, in text order, are matched
against licence rules, the longest and most specific first; what a rule matches is used up.  All of it is
expressions over one row, so no row leaves its task; the tables of sentences and rules are constants.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised, and their identifiers: fixed values from the licences' texts.
SENTENCES = {
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "licensed under the apache license version 2 0": "Apache2Ref",
    "licensed under the apache license version 2 0 the license": "Apache2Ref",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheWarranty",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Plus",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "licensed under cc by nc 4 0": "CcByNc4Ref",
    "licensed under cc by 4 0": "CcBy4Ref",
    "licensed under cc by sa 4 0": "CcBySa4Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "Gpl2Only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3Plus",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "Lgpl21Plus",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Plus",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "LgplWarranty",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "Mpl2Copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "Bsd0Grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscWarranty",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "Epl2Terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at": "Epl1Terms",
    "distributed under the boost software license version 1 0": "BoostRef",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BoostGrant",
    "this is free and unencumbered software released into the public domain": "UnlicenseRef",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseGrant",
    "this software is provided as is without any express or implied warranty": "ZlibWarranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "Cc0Dedication",
    "licensed under cc0 1 0": "Cc0Ref",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "WtfplText",
    "licensed under the mozilla public license version 2 0": "Mpl2Ref",
    "licensed under the eclipse public license version 2 0": "Epl2Ref",
    "licensed under the gnu affero general public license version 3": "Agpl3Ref",
    "licensed under the gnu lesser general public license version 3": "Lgpl3Ref",
    "licensed under the gnu lesser general public license version 2 1": "Lgpl21Ref",
    "licensed under the boost software license version 1 0": "BoostRef",
    "licensed under the isc license": "IscRef",
    "licensed under the zlib license": "ZlibRef",
    "licensed under the bsd 3 clause license": "Bsd3Ref",
    "licensed under the bsd 2 clause license": "Bsd2Ref",
}

#: Rules in the order of their trial: identifiers in a row, and the licence: fixed values.
RULES = [
    ("MitGrant MitNotice MitWarranty", "MIT"),
    ("MitGrant MitNotice", "MIT"),
    ("Apache2Ref ApacheComply ApacheCopy ApacheWarranty", "Apache-2.0"),
    ("Gpl3Plus GplWarranty", "GPL-3.0-or-later"),
    ("Gpl2Plus GplWarranty", "GPL-2.0-or-later"),
    ("BsdGrant BsdSource BsdBinary BsdEndorse", "BSD-3-Clause"),
    ("BsdGrant BsdSource BsdBinary", "BSD-2-Clause"),
    ("Gpl3Plus", "GPL-3.0-or-later"),
    ("Gpl2Plus", "GPL-2.0-or-later"),
    ("Gpl3Ref", "GPL-3.0-only"),
    ("Gpl2Ref", "GPL-2.0-only"),
    ("Apache2Ref", "Apache-2.0"),
    ("MitRef", "MIT"),
    ("CcByNc4Ref", "CC-BY-NC-4.0"),
    ("CcBySa4Ref", "CC-BY-SA-4.0"),
    ("CcBy4Ref", "CC-BY-4.0"),
    ("Agpl3Plus GplWarranty", "AGPL-3.0-or-later"),
    ("Lgpl21Plus LgplWarranty", "LGPL-2.1-or-later"),
    ("Lgpl3Plus LgplWarranty", "LGPL-3.0-or-later"),
    ("Lgpl3Plus GplWarranty", "LGPL-3.0-or-later"),
    ("Gpl2Only GplWarranty", "GPL-2.0-only"),
    ("Mpl2Terms Mpl2Copy", "MPL-2.0"),
    ("IscGrant IscWarranty", "ISC"),
    ("Bsd0Grant IscWarranty", "0BSD"),
    ("UnlicenseRef UnlicenseGrant", "Unlicense"),
    ("ZlibWarranty ZlibGrant", "Zlib"),
    ("Agpl3Plus", "AGPL-3.0-or-later"),
    ("Lgpl21Plus", "LGPL-2.1-or-later"),
    ("Lgpl3Plus", "LGPL-3.0-or-later"),
    ("Gpl2Only", "GPL-2.0-only"),
    ("Mpl2Terms", "MPL-2.0"),
    ("Epl2Terms", "EPL-2.0"),
    ("Epl1Terms", "EPL-1.0"),
    ("IscGrant", "ISC"),
    ("Bsd0Grant", "0BSD"),
    ("BoostGrant", "BSL-1.0"),
    ("UnlicenseRef", "Unlicense"),
    ("Cc0Dedication", "CC0-1.0"),
    ("WtfplText", "WTFPL"),
    ("Mpl2Ref", "MPL-2.0"),
    ("Epl2Ref", "EPL-2.0"),
    ("Agpl3Ref", "AGPL-3.0-only"),
    ("Lgpl3Ref", "LGPL-3.0-only"),
    ("Lgpl21Ref", "LGPL-2.1-only"),
    ("BoostRef", "BSL-1.0"),
    ("Cc0Ref", "CC0-1.0"),
    ("IscRef", "ISC"),
    ("ZlibRef", "Zlib"),
    ("Bsd3Ref", "BSD-3-Clause"),
    ("Bsd2Ref", "BSD-2-Clause"),
]
# Tags that name a licence are sentences too, one for each name of a rule.
for _name in dict.fromkeys(name for _, name in RULES):
    _id = "Tag" + "".join(c for c in _name if c.isalnum())
    SENTENCES["spdx license identifier " + " ".join(re.findall("[a-z0-9]+", _name.lower()))] = _id
    RULES.append((_id, _name))

#: Every known sentence holds one of these.
CUE = "(?i)licen|permi|copyright|warrant|distribut|unencumber"
#: Where sentences end: (pattern, replacement) in turn; chr(1) marks the cuts.
CUTS = [
    ("([.!?;:])[ \\t\\n\\r]+", "1\x01"),
    ("\\n([^\\p{Ll}\\n]*\\p{Lu})", "\x011"),
    ("\\n[ \\t\\r]*\\n", "\x01"),
    ("(SPDX-License-Identifier:[^\\n]*)\\n", "1\x01"),
]


#: Addresses end a sentence too; notices on one line go on behind them.
ADDRESS = "[Hh][Tt][Tt][Pp][Ss]?://[^ \\t\\n\\x0B\\f\\r]+"


def sentences(text: Column, known: dict[str, str]) -> Column:
    """Known sentences in a text, in its order: whole pieces, one or several in a row."""
    whole = F.coalesce(text, F.lit(""))
    text = F.regexp_replace(whole, F.lit(ADDRESS), F.lit("\x01"))
    for pattern, put in CUTS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(put.replace("1", "$1")))
    text = F.concat(F.lit("\x01"), F.lower(F.regexp_replace(text, "[^A-Za-z0-9\x01]+", " ")), F.lit("\x01"))
    text = F.regexp_replace(text, " ?\x01[ \x01]*", "\x01")
    any_of = "|".join(s.replace(" ", "[ \x01]") for s in sorted(known, key=len))  # of two that fit, that of fewer pieces
    found = F.regexp_extract_all(text, F.lit(f"(?<=\x01)(?:{any_of})(?=\x01)"), F.lit(0))
    found = F.transform(found, lambda s: F.translate(s, "\x01", " "))
    return F.when(whole.rlike(CUE), found).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_unmatched) for each row of docs(doc_id, text).

    sentence_ids: identifiers in text order, in one string; licenses: those whose rules match, in the rules'
    order, separated by commas; n_unmatched: identifiers that no rule used up.  Null and empty texts, and
    texts without known sentences, have empty strings and 0.  Repeated rows give repeated results, a null
    doc_id is returned as it is, whole texts are read, and other columns are not.
    """
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = F.filter(F.transform(sentences(F.col("text"), known), lambda s: F.element_at(table, s)), lambda i: i.isNotNull())
    order = F.array(*[F.struct(F.lit("".join(f"<{i}>" for i in ids.split())).alias("ids"), F.lit(name).alias("name")) for ids, name in rules])
    seen = F.array_join(F.transform("found", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    start = F.struct(seen.alias("left"), F.array().cast("array<string>").alias("names"))

    def step(acc, rule):
        hit = F.contains(acc["left"], rule["ids"])
        return F.struct(
            F.when(hit, F.replace(acc["left"], rule["ids"], F.lit("|"))).otherwise(acc["left"]).alias("left"),
            F.when(hit, F.array_append(acc["names"], rule["name"])).otherwise(acc["names"]).alias("names"))

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found"))
    d = d.withColumn("end", F.when(F.size("found") > 0, F.aggregate(order, start, step)).otherwise(start))
    return d.select(
        "doc_id", F.array_join("found", " ").alias("sentence_ids"),
        F.array_join(F.array_distinct("end.names"), ",").alias("licenses"), F.regexp_count("end.left", F.lit("<")).cast("long").alias("n_unmatched"))


def sql(known: dict[str, str] = SENTENCES, rules: list[tuple[str, str]] = RULES) -> str:
    """The same in DuckDB's SQL, from the same tables; cuts are doubled, as its patterns cannot look around."""
    text = f"regexp_replace(coalesce(text, ''), '{ADDRESS}', chr(1), 'g')"
    for pattern, put in CUTS:
        put = "||".join({"1": "'\\1'", "\x01": "chr(1)"}[c] for c in put)
        text = f"regexp_replace({text}, '{pattern}', {put}, 'g')"
    text = f"chr(1) || lower(regexp_replace({text}, '[^A-Za-z0-9\\x01]+', ' ', 'g')) || chr(1)"
    text = f"regexp_replace({text}, ' ?\\x01[ \\x01]*', chr(1) || chr(1), 'g')"
    any_of = "|".join(s.replace(" ", "(?: |\\x01\\x01)") for s in sorted(known, key=len))
    cases = " ".join(f"WHEN '{s}' THEN '{i}'" for s, i in known.items())
    steps, last = [], "s0"
    for k, (ids, name) in enumerate(rules, 1):
        ids = "".join(f"<{i}>" for i in ids.split())
        steps.append(f"s{k} AS (SELECT doc_id, found, replace(l, '{ids}', '|') AS l, CASE WHEN contains(l, '{ids}') "
                     f"AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})")
        last = f"s{k}"
    return f"""
WITH hits AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '{CUE}')
  THEN regexp_extract_all({text}, '\\x01(?:{any_of})\\x01') ELSE CAST([] AS VARCHAR[]) END AS p FROM documents),
ids AS (SELECT doc_id, list_transform(p, lambda s: CASE trim(replace(replace(s, chr(1) || chr(1), ' '), chr(1), '')) {cases} END) AS found FROM hits),
s0 AS (SELECT doc_id, found, array_to_string(list_transform(found, lambda i: '<' || i || '>'), '') AS l, CAST([] AS VARCHAR[]) AS names FROM ids),
{", ".join(steps)}
SELECT doc_id, array_to_string(found, ' ') AS sentence_ids, array_to_string(names, ',') AS licenses,
  CAST(len(l) - len(replace(l, '<', '')) AS BIGINT) AS n_unmatched FROM {last}
"""
