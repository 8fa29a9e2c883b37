"""Licences in texts, from the sentences that name or grant them.

A text is normalised to lower-case letters and digits, with one spelling for what authors write
in several ways, and cut before each phrase that opens a known licence sentence.  The words after
a cut map to the identifier of the longest known sentence that they start with.  The identifiers,
in text order, are matched against ordered rules; a rule takes the identifiers that it matches,
so that a full licence text is not also reported as a mere mention, and a copyright line inside
it not as a reservation of all rights.  Where a notice names several licences, each is found, and so
is whether one may choose (OR) or both hold (AND); exceptions and patent clauses are findings of
their own, and a licence that a text denies is none.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: licence, kind, names
NAMES = (
    ("MIT", "permissive", ("mit", "mit license", "mit x11 license", "expat license")),
    ("ISC", "permissive", ("isc", "isc license")),
    ("Unlicense", "permissive", ("unlicense",)),
    ("Zlib", "permissive", ("zlib", "zlib license")),
    ("BSD-3-Clause", "permissive", ("bsd 3 clause", "3 clause bsd", "new bsd license", "modified bsd license", "revised bsd license")),
    ("BSD-2-Clause", "permissive", ("bsd 2 clause", "2 clause bsd", "simplified bsd license")),
    ("BSD", "permissive", ("bsd", "bsd license", "bsd style license")),
    ("CC0-1.0", "permissive", ("cc0", "cc0 1 0", "creative commons zero", "creative commons cc0")),
    ("0BSD", "permissive", ("0bsd", "bsd zero clause", "zero clause bsd")),
    ("WTFPL", "permissive", ("wtfpl", "do what the fuck you want to public license")),
    ("PostgreSQL", "permissive", ("postgresql license",)),
    ("Python-2.0", "permissive", ("python software foundation license", "psf license")),
)
# fixed values: licence family, kind, names, versions
FAMILIES = (
    ("Apache", "permissive", ("apache license", "apache software license", "apache"), ("1.1", "2.0")),
    ("GPL", "copyleft", ("gnu general public license", "gnu gpl", "gpl", "general public license"), ("2.0", "3.0")),
    ("AGPL", "copyleft", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("3.0",)),
    ("LGPL", "copyleft", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2.0", "2.1", "3.0")),
    ("MPL", "copyleft", ("mozilla public license", "mpl"), ("1.1", "2.0")),
    ("EPL", "copyleft", ("eclipse public license", "epl"), ("1.0", "2.0")),
    ("BSL", "permissive", ("boost software license",), ("1.0",)),
    ("Artistic", "permissive", ("artistic license", "perl artistic license", "artistic"), ("1.0", "2.0")),
)
#: Families whose notices may allow any later version.
LATER = ("GPL", "AGPL", "LGPL", "MPL", "EPL")
# fixed values: parts of a Creative Commons attribution licence, kind
COMMONS = (("", "permissive"), ("sa", "copyleft"), ("nd", "noderivatives"), ("nc", "noncommercial"), ("nc sa", "noncommercial"), ("nc nd", "noncommercial"))
COMMONS_WORDS = {"sa": "sharealike", "nd": "noderivatives", "nc": "noncommercial"}
COMMONS_VERSIONS = ("2.0", "2.5", "3.0", "4.0")

# fixed values: identifier, normalised sentence
SENTENCES = (
    ("apache_comply", "you may not use this file except in compliance with the license"),
    ("apache_copy", "you may obtain a copy of the license at"),
    ("apache_as_is", "unless required by applicable law or agreed to in writing software"),
    ("apache_see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit_as_is", "the software is provided as is without warranty of any kind"),
    ("isc_grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_as_is", "the software is provided as is and the author disclaims all warranties"),
    ("boost_grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("zlib_as_is", "this software is provided as is without any express or implied warranty"),
    ("zlib_grant", "permission is granted to anyone to use this software for any purpose"),
    ("unlicense_free", "this is free and unencumbered software released into the public domain"),
    ("mpl_1_1_form", "this source code form is subject to the terms of the mozilla public license version 1 1"),
    ("mpl_2_0_form", "this source code form is subject to the terms of the mozilla public license version 2"),
    ("gpl_free", "is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("agpl_free", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("lgpl_free", "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl_free", "is free software you can redistribute it and or modify it under the terms of the gnu library general public license"),
    *((f"version_{v.replace(' ', '_')}{'_0' if len(v) == 1 else ''}{later}", f"{either}version {v} of the license{words}") for v in ("2", "2 1", "3") for either in ("", "either ") for later, words in (("", ""), ("_later", " or later"))),
    ("gpl_hope", "is distributed in the hope that it will be useful but without any warranty"),
    ("gpl_copy", "you should have received a copy of the gnu general public license"),
    ("gpl_copy", "you should have received a copy of the gnu affero general public license"),
    ("gpl_copy", "you should have received a copy of the gnu lesser general public license"),
    ("gpl_copy", "you should have received a copy of the gnu library general public license"),
    ("bsd_use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_adverts", "all advertising materials mentioning features or use of this software must display"),
    ("bsd_name", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd_name", "the name of the author may not be used to endorse or promote products"),
    ("all_rights", "all rights reserved"),
    ("or_else", "licenseor"),
    ("and_also", "licenseand"),
    ("classpath", "licensewith classpath exception"),
    ("llvm", "licensewith llvm exception"),
    ("llvm", "licensewith llvm exceptions"),
    ("gcc_runtime", "licensewith gcc runtime library exception"),
    ("linking", "licensewith linking exception"),
    ("linking", "licensewith static linking exception"),
    ("patents", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("patents", "additional grant of patent rights"),
)
# fixed values: phrases that open the sentences above, and what names a licence
OPENERS = (
    "licensed under", "you may not use this file", "you may obtain a copy", "unless required by applicable law", "see the license for", "permission is hereby granted",
    "the above copyright notice and this permission", "the software is provided", "this software is provided as is", "permission to use copy", "permission is granted to anyone",
    "this is free and unencumbered", "this source code form is subject", "is free software", "either version", "version 2 of the license", "version 3 of the license", "version 2 1 of the license",
    "is distributed in the hope", "you should have received", "redistribution and use", "redistributions of source", "redistributions in binary", "all advertising materials",
    "neither the name of", "the name of the author may not", "all rights reserved", "licenseor", "licenseand", "licensewith classpath exception", "licensewith llvm exception", "licensewith gcc runtime library exception",
    "licensewith linking exception", "licensewith static linking exception", "each contributor hereby grants", "additional grant of patent rights",
)
# fixed values: patterns over the normalised text and their one spelling; @1 is the first group
_STARTS = "(mit|isc|apache|bsd|[023] clause bsd|0bsd|gpl|agpl|lgpl|gnu (?:a|l)?gpl|mpl|epl|zlib|unlicense|cc0|cc by|wtfpl|artistic|gnu general|gnu affero|gnu lesser|gnu library|mozilla public|eclipse public|boost software|creative commons|postgresql|python software)"
#: Another licence named behind a first one: at most eight words lie between.
_CHOICE = (" licensed under ((?:[a-z0-9]+ ){1,8}?)(?:or|and or) (?:the |a |an |under |under the |under a )?" + _STARTS + " ", " licensed under @1licenseor licensed under @2 ")
_BOTH = (" licensed under ((?:[a-z0-9]+ ){1,8}?)and (?:the |a |an |under |under the |under a )?" + _STARTS + " ", " licensed under @1licenseand licensed under @2 ")
SPELLINGS = (
    (" licence", " license"),
    ("(gpl)v ?([0-9])", "@1 version @2"),
    (" (?:version |ver |v |v)([0-9])", " version @1"),
    (" public license (?:gnu )?a?l?(?:gpl|mpl|epl) ", " public license "),
    (" non commercial", " noncommercial"),
    (" share alike", " sharealike"),
    (" (?:no derivatives|no derivs|noderivs)", " noderivatives"),
    (" or (?:at your (?:option|choice) )?(?:any )?(?:later|newer)(?: version)?(?: at your (?:option|choice))? ", " or later "),
    (" with (?:the |a |gnu )?(classpath|llvm|gcc runtime library|linking|static linking) exception", " licensewith @1 exception"),
    (" spdx license identifier ", " licensed under "),
    (" license (mit|isc|apache|bsd|0bsd|gpl|gplv2|gplv3|agpl|lgpl|mpl|epl|zlib|unlicense|cc0|cc by|wtfpl|artistic) ", " licensed under @1 "),
    (" (?:dual|dually|multi|tri) licensed ", " licensed "),
    (" (?:licensed|released|distributed|available|published|provided|shared) (?:only )?(?:under|with|as) (?:the )?(?:terms (?:and conditions )?of )?(?:either (?:of )?|both |one of )?(?:the |a |an )?" + _STARTS, " licensed under @1"),
    (" (?:licensed|released|distributed|available|published|provided|shared) (?:only )?under (?:the )?(?:terms (?:and conditions )?of )?(?:either (?:of )?|both |one of )?(?:the |a |an )?", " licensed under "),
    (" (?:not|never|no longer|isn t|aren t|wasn t|cannot be|can t be|not be|nor) licensed under ", " refused under "),
    *[_CHOICE] * 3,
    *[_BOTH] * 3,
    (" neither the name of .{1,200}? nor the names of (?:its|their|any|the) contributors ", " neither the name of the copyright holder nor the names of its contributors "),
)
#: Every known sentence has one of these, so a text without them needs no further look.
CUES = r"(?i)licen|hereby grant|patent rights|permission|redistribut|warrant|reserved|copyright|free software|unencumbered|advertising materials|endorse|applicable law|under\W+(?:\w+\W+){0,4}(?:mit|isc|apache|bsd|l?a?gplv?[0-9]?|mpl|epl|zlib|cc0|cc|0bsd|wtfpl|artistic)\b"


def _mentions() -> list[tuple[str, str, str, str]]:
    """(identifier, licence, kind, name) of every way to name a licence."""
    out = [(lic.lower().replace("-", "_").replace(".", "_"), lic, kind, n) for lic, kind, names in NAMES for n in names]
    for family, kind, names, versions in FAMILIES:
        out += [(family.lower(), family, kind, n) for n in names]
        for n, v in product(names, versions):
            major, minor = v.split(".")
            for number in {f"{major} {minor}", major if minor == "0" else f"{major} {minor}"}:
                out += [(f"{family}_{major}_{minor}".lower(), f"{family}-{v}", kind, f"{n}{word} {number}") for word in ("", " version")]
                if family in LATER:
                    out += [(f"{family}_{major}_{minor}_later".lower(), f"{family}-{v}-or-later", kind, f"{n}{word} {number} or later") for word in ("", " version")]
    for parts, kind in COMMONS:
        lic = "-".join(["CC-BY", *parts.upper().split()])
        for short, v in product((True, False), ("", *COMMONS_VERSIONS)):
            words = ["cc by", *parts.split()] if short else ["creative commons attribution", *(COMMONS_WORDS[p] for p in parts.split())]
            named = f"{lic}-{v}" if v else lic
            out.append((named.lower().replace("-", "_").replace(".", "_"), named, kind, " ".join([*words, *v.split(".")]).strip()))
    return out


_MENTIONS = _mentions()
_BY_TEXT = {text: name for name, text in SENTENCES} | {f"licensed under {n}": i for i, _, _, n in _MENTIONS}
_LENGTHS = sorted({len(text.split()) for text in _BY_TEXT}, reverse=True)
_OPENER = " (" + "|".join(OPENERS) + r")\b"


def _grants(licence: str, kind: str, free: str, version: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """The rules of a notice of the GNU licences for a version, or for none; any later version first."""
    if not version:
        return [(licence, kind, (free, "gpl_hope?", "gpl_copy?"))]
    number = f"version_{version.replace('.', '_')}"
    return [(f"{licence}-{version}{more}", kind, (free, f"{number}{later}", "gpl_hope?", "gpl_copy?")) for more, later in (("-or-later", "_later"), ("", ""))]


#: Licence, kind, identifiers in order ("?": may be missing); the first rules take precedence.
RULES = (
    ("Apache-2.0", "permissive", ("apache_2_0?", "apache_comply", "apache_copy?", "apache_as_is?", "apache_see?")),
    ("BSL-1.0", "permissive", ("bsl_1_0?", "boost_grant", "mit_as_is?")),
    ("MIT", "permissive", ("mit?", "mit_grant", "mit_notice?", "mit_as_is?")),
    ("ISC", "permissive", ("isc?", "isc_grant", "isc_as_is?", "mit_as_is?")),
    ("Zlib", "permissive", ("zlib?", "zlib_as_is?", "zlib_grant")),
    ("Unlicense", "permissive", ("unlicense?", "unlicense_free", "mit_as_is?")),
    ("BSD-4-Clause", "permissive", ("bsd?", "bsd_use", "bsd_source", "bsd_binary", "bsd_adverts", "bsd_name?")),
    ("BSD-3-Clause", "permissive", ("bsd_3_clause?", "bsd?", "bsd_use", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", "permissive", ("bsd_2_clause?", "bsd?", "bsd_use", "bsd_source", "bsd_binary")),
    ("MPL-1.1", "copyleft", ("mpl_1_1_form",)),
    ("MPL-2.0", "copyleft", ("mpl_2_0?", "mpl_2_0_form")),
    *(rule for v in ("3.0", "") for rule in _grants("AGPL", "copyleft", "agpl_free", v)),
    *(rule for v in ("2.0", "2.1", "3.0", "") for rule in _grants("LGPL", "copyleft", "lgpl_free", v)),
    *(rule for v in ("2.0", "3.0", "") for rule in _grants("GPL", "copyleft", "gpl_free", v)),
    *((lic, kind, (i,)) for i, (lic, kind) in {i: (lic, kind) for i, lic, kind, _ in _MENTIONS}.items()),
    ("Classpath-exception-2.0", "exception", ("classpath",)),
    ("LLVM-exception", "exception", ("llvm",)),
    ("GCC-exception", "exception", ("gcc_runtime",)),
    ("linking-exception", "exception", ("linking",)),
    ("patent-grant", "patents", ("patents",)),
    ("OR", "choice", ("or_else",)),
    ("AND", "choice", ("and_also",)),
    ("proprietary", "reserved", ("all_rights",)),
)


def _pattern(ids: tuple[str, ...]) -> str:
    """A rule over `` id  id ``; the copyright line of what it matches is part of it."""
    line = "" if ids == ("all_rights",) else "(?: all_rights )*"
    return "".join(f"(?:{line} {i[:-1]} )?" if i.endswith("?") else f"{line} {i} " for i in ids)


def sentence_ids(text: Column) -> Column:
    """The identifiers of known sentences in a text, in order: `` apache_2_0  mit ``."""
    known = F.create_map(*(F.lit(x) for pair in _BY_TEXT.items() for x in pair))
    later = F.regexp_replace(F.lower(text), r"([0-9])\+", "$1 or later ")
    plain = F.concat(F.lit(" "), F.regexp_replace(later, "[^a-z0-9]+", " "), F.lit(" "))
    for pattern, spelling in SPELLINGS:
        plain = F.regexp_replace(plain, pattern, spelling.replace("@", "$"))
    pieces = F.slice(F.split(F.regexp_replace(plain, _OPENER, "\n$1"), "\n"), 2, 1 << 30)
    named = lambda words: F.coalesce(*(F.when(F.size(words) >= n, F.try_element_at(known, F.array_join(F.slice(words, 1, n), " "))) for n in _LENGTHS))
    ids = F.transform(pieces, lambda p: F.transform(F.array(F.split(p, " ")), named)[0])
    return F.array_join(F.transform(F.array_compact(ids), lambda x: F.concat(F.lit(" "), x, F.lit(" "))), "")


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, license, kind, rule, n_matches of each rule that a text of docs matches.

    Null and empty texts match nothing; very long ones are read whole.  Each row is read alone:
    repeated rows give repeated answers, and a null doc_id is carried.  Where two rules match the
    same sentences, the first takes them.  Other columns are ignored; an empty table gives an
    empty result.
    """
    left = docs.where(F.col("text").rlike(CUES)).select("doc_id", sentence_ids(F.col("text")).alias("left")).where("left <> ''")
    rules = F.array(*(F.struct(F.lit(lic).alias("license"), F.lit(kind).alias("kind"), F.lit(i).alias("rule"), F.lit(_pattern(ids)).alias("pattern")) for i, (lic, kind, ids) in enumerate(RULES)))
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<struct<license:string,kind:string,rule:int,n_matches:bigint>>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        n = F.regexp_count(state["left"], rule["pattern"]).cast("bigint")
        match = F.struct(rule["license"].alias("license"), rule["kind"].alias("kind"), rule["rule"].alias("rule"), n.alias("n_matches"))
        return F.when(n == 0, state).otherwise(F.struct(F.regexp_replace(state["left"], rule["pattern"], F.lit(" # ")).alias("left"), F.array_append(state["found"], match).alias("found")))

    return left.select("doc_id", F.explode(F.aggregate(rules, start, apply, lambda state: state["found"])).alias("c")).select("doc_id", "c.*")


def _oracle() -> str:
    known = ", ".join(f"('{text}', '{name}', {len(text.split())})" for text, name in _BY_TEXT.items())
    plain = r"' ' || regexp_replace(regexp_replace(lower(text), '([0-9])\+', '\1 or later ', 'g'), '[^a-z0-9]+', ' ', 'g') || ' '"
    for pattern, spelling in SPELLINGS:
        plain = f"regexp_replace({plain}, '{pattern}', '{spelling.replace('@', chr(92))}', 'g')"
    steps, last = "", "ids"
    for i, (_, _, ids) in enumerate(RULES):
        p = _pattern(ids)
        steps += f", s{i} AS MATERIALIZED (SELECT * REPLACE (regexp_replace(lft, '{p}', ' # ', 'g') AS lft, list_append(found, len(regexp_extract_all(lft, '{p}'))) AS found) FROM {last})"
        last = f"s{i}"
    rules = ", ".join(f"({i}::INTEGER, '{lic}', '{kind}')" for i, (lic, kind, _) in enumerate(RULES))
    return f"""
WITH known(sentence, id, n) AS (VALUES {known}),
rules(rule, license, kind) AS (VALUES {rules}),
cut AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace({plain}, '{_OPENER}', chr(10) || '\\1', 'g'), chr(10)) AS pieces
  FROM documents WHERE text IS NOT NULL),
piece AS (SELECT r, doc_id, generate_subscripts(pieces, 1) AS i, unnest(pieces) AS p FROM cut),
hit AS (
  SELECT r, doc_id, i, max_by(k.id, k.n) AS id FROM piece JOIN known k ON i > 1 AND (p = k.sentence OR starts_with(p, k.sentence || ' '))
  GROUP BY ALL),
ids AS (SELECT r, doc_id, string_agg(' ' || id || ' ', '' ORDER BY i) AS lft, []::BIGINT[] AS found FROM hit GROUP BY r, doc_id){steps}
SELECT doc_id, license, kind, rule, found[rule + 1]::BIGINT AS n_matches FROM {last}, rules WHERE found[rule + 1] > 0
"""


#: DuckDB SQL of licenses() over documents.
LICENSE_SQL = _oracle()
