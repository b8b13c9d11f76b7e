"""License scans by sentence rules (DataFrame functions only).

A text is cut into sentences at marks and blank lines; sentences with a licence word
are normalised (lower case, letters and digits only) and looked up in ``SENTENCES``.
A sentence that is unknown as a whole gives the known ones among its lines, in their
place, so that a wrapped licence and one on a line of its own are both met.  The
sequence of the identifiers is matched against ``RULES`` in order.  A rule that
matches takes its identifiers out of the sequence, so general rules see only what
specific ones have left.  A sentence with a licence word that no entry knows breaks
a sequence.

Defined results: null and empty texts have no sentences; repeated rows are scanned
each; an empty table gives an empty result; a sentence with a licence word of which
no entry knows the whole nor a line is counted in ``n_unknown``; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences as they read after normalisation.  One with
# a break inside is there as the cut leaves it too (the part with a licence word); only
# version 2.0 of the Mozilla licence speaks of a "Source Code Form".
SENTENCES: dict[str, str] = {
    "released under the mit license": "mitref",
    "licensed under the mit license": "mitref",
    "this project is licensed under the mit license": "mitref",
    "licensed under the mit license mit": "mitref",
    "the mit license mit": "mitref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mitgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mitnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "asis",
    "licensed under the apache license version 2 0": "apache2ref",
    "licensed under the apache license version 2 0 the license": "apache2ref",
    "you may not use this file except in compliance with the license": "apache2use",
    "you may obtain a copy of the license at": "apache2copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache2see",
    "this work is licensed under the gnu general public license version 3": "gpl3ref",
    "this work is licensed under the gnu general public license version 2": "gpl2ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3plus",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2plus",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2plus",
    "see the gnu general public license for more details": "gplsee",
    "this work is licensed under the gnu lesser general public license version 3": "lgpl3ref",
    "this work is licensed under the gnu affero general public license version 3": "agpl3ref",
    "licensed under cc by nc 4 0": "ccbync4ref",
    "licensed under cc by sa 4 0": "ccbysa4ref",
    "licensed under cc by 4 0": "ccby4ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsdgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsdsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsdbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsdname",
    "licensed under the bsd 3 clause license": "bsd3ref",
    "licensed under the bsd 2 clause license": "bsd2ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "iscgrant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2ref",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2ref",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "released under the unlicense": "unlicense",
    "to the extent possible under law the author has waived all copyright and related rights to this work": "cc0ref",
    "all rights reserved": "reserved",
}

#: Sequence of sentence identifiers, licence: tried in this order.
RULES: tuple[tuple[str, str], ...] = (
    ("mitgrant,mitnotice,asis", "MIT"),
    ("mitgrant,mitnotice", "MIT"),
    ("mitref", "MIT"),
    ("apache2ref,apache2use,apache2copy,apache2see", "Apache-2.0"),
    ("apache2ref,apache2use", "Apache-2.0"),
    ("apache2ref", "Apache-2.0"),
    ("gpl3plus,gplsee", "GPL-3.0-or-later"),
    ("gpl3plus", "GPL-3.0-or-later"),
    ("gpl2plus,gplsee", "GPL-2.0-or-later"),
    ("gpl2plus", "GPL-2.0-or-later"),
    ("gpl3ref", "GPL-3.0"),
    ("gpl2ref", "GPL-2.0"),
    ("lgpl3ref", "LGPL-3.0"),
    ("agpl3ref", "AGPL-3.0"),
    ("ccbync4ref", "CC-BY-NC-4.0"),
    ("ccbysa4ref", "CC-BY-SA-4.0"),
    ("ccby4ref", "CC-BY-4.0"),
    ("cc0ref", "CC0-1.0"),
    ("bsdgrant,bsdsource,bsdbinary,bsdname", "BSD-3-Clause"),
    ("bsdgrant,bsdsource,bsdbinary", "BSD-2-Clause"),
    ("bsd3ref", "BSD-3-Clause"),
    ("bsd2ref", "BSD-2-Clause"),
    ("iscgrant", "ISC"),
    ("mpl2ref", "MPL-2.0"),
    ("unlicense", "Unlicense"),
)
#: Licence words of normalised sentences, and the same in texts as they are.
HINT_LOW = r"licen[sc]|permission|redistribut|copyright|public domain|warrant|rights reserved"
HINT = "(?i)" + HINT_LOW.replace(" ", "[^a-z0-9]+")
BLANK = r"\n[\x20\x09\x0D]*\n"
BREAK = r"([.!?;:])[\x20\x09-\x0D]+"


def _normal(segment: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(segment), "[^a-z0-9]+", " "))


def _identifiers(text: Column) -> Column:
    """Identifiers in order of place; '?' for a sentence with a licence word that the table knows neither whole nor by a line."""
    table = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    sentences = F.split(F.regexp_replace(F.regexp_replace(text, BLANK, "\x01"), BREAK, "$1\x01"), "\x01")
    both = F.transform(sentences, lambda s: F.struct(s.alias("raw"), _normal(s).alias("whole")))
    hinted = F.filter(both, lambda s: s["whole"].rlike(HINT_LOW))

    def found(s):
        by_line = F.filter(F.transform(F.split(s["raw"], "\n"), lambda line: F.element_at(table, _normal(line))), F.isnotnull)
        whole = F.element_at(table, s["whole"])
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(F.array(by_line), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("?"))))[0])

    return F.flatten(F.transform(hinted, found))


def _matched(sequence: Column) -> Column:
    """What the ordered rules find in an identifier sequence, each licence once."""
    rules = F.array(*[F.struct(F.lit(f",{p},").alias("p"), F.lit(x).alias("x")) for p, x in RULES])
    start = F.struct(F.concat(F.lit(","), F.array_join(sequence, ",,"), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("found"))

    def rule(acc, r):
        wide = F.replace(r["p"], F.lit(","), F.lit(",,"))
        pattern = F.substring(wide, F.lit(2), F.length(wide) - 2)
        hit = F.contains(acc["left"], pattern)
        return F.struct(
            F.when(hit, F.replace(acc["left"], pattern, F.lit(",;,"))).otherwise(acc["left"]).alias("left"),
            F.when(hit, F.array_union(acc["found"], F.array(r["x"]))).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(rules, start, rule, lambda acc: acc["found"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_license_sentences, n_unknown, sentence_ids, licenses for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sequence = docs.select("doc_id", F.when(text.rlike(HINT), text).alias("_t")).select("doc_id", _identifiers(F.col("_t")).alias("_sequence"))
    none = F.array().cast("array<string>")
    ids = sequence.select("doc_id", "_sequence", F.coalesce(F.filter("_sequence", lambda x: x != "?"), none).alias("_known"))
    return ids.select(
        "doc_id",
        F.size("_known").cast("long").alias("n_license_sentences"),
        F.coalesce(F.size("_sequence") - F.size("_known"), F.lit(0)).cast("long").alias("n_unknown"),
        F.array_join("_known", ",").alias("sentence_ids"),
        F.coalesce(F.when(F.size("_known") > 0, F.array_join(_matched(F.col("_sequence")), ",")), F.lit("")).alias("licenses"),
    )


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences named in every whole text of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
