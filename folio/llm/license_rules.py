"""Licence scan: an ordered table of signature rules behind a keyword prefilter.

A text is lower-cased (A-Z), its words are the runs of letters, digits and
characters beyond ASCII, and rules are regular expressions over those words
joined by single spaces: sentences written down as they stand in licence texts,
and the names of licence families in the FORMS in which notices refer to them.
A text without any of the STEMS has no detection; the
others go through one pass of an Aho-Corasick automaton of all rules' keywords,
and only rules whose keyword occurs are tried: a phrase that every match holds.

Each rule has a priority (lower wins) and a label. Detections are taken in the
order of priority, then length, then place, and work grows with their number, not its square; one whose interval lies within an
interval already taken is dropped. The phrases in BASE are counted on their
own and always keep their labels.

Defined cases: a null or empty text, or one without words, has zero words, no
detection, empty labels and score 0; rows that share a doc_id are each scanned;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.rows import LOWER_BYTES, id_and_text
from folio.session import ship_package

#: Fixed values of the contract: phrase, label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
BASE_SCORE = 0.7

#: label; names by which the licence goes, each its own rules' keyword; versions, each with its own label suffix.
FAMILIES = (
    ("mit", ("mit", "mit x11", "expat"), ()),
    ("apache", ("apache", "apache software", "asl"), ("1 0", "1 1", "2 0")),
    ("gpl", ("general public", "gpl", "gnu copyleft"), ("1", "2", "3")),
    ("lgpl", ("lesser general public", "library general public", "lgpl"), ("2", "2 1", "3")),
    ("agpl", ("affero general public", "agpl"), ("1", "3")),
    ("gfdl", ("free documentation", "gfdl", "fdl"), ("1 1", "1 2", "1 3")),
    ("bsd", ("bsd", "berkeley software distribution"), ("2 clause", "3 clause", "4 clause", "0 clause")),
    ("mpl", ("mozilla public", "mpl"), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public", "epl"), ("1 0", "2 0")),
    ("cddl", ("common development and distribution", "cddl"), ("1 0", "1 1")),
    ("cpl", ("common public", "cpl"), ("1 0",)),
    ("eupl", ("european union public", "eupl"), ("1 0", "1 1", "1 2")),
    ("artistic", ("artistic", "perl artistic"), ("1 0", "2 0")),
    ("boost", ("boost", "boost software", "bsl"), ("1 0",)),
    ("zlib", ("zlib", "zlib libpng"), ()),
    ("isc", ("isc", "internet systems consortium"), ()),
    ("wtfpl", ("do what the fuck you want to public", "wtfpl"), ("2",)),
    ("psf", ("python software foundation", "psf"), ("2",)),
    ("php", ("php",), ("3 0", "3 01")),
    ("ruby", ("ruby",), ()),
    ("perl", ("perl", "perl 5"), ()),
    ("openssl", ("openssl", "ssleay"), ()),
    ("ms-pl", ("microsoft public", "ms pl"), ()),
    ("ms-rl", ("microsoft reciprocal", "ms rl"), ()),
    ("ofl", ("open font", "sil open font", "ofl"), ("1 0", "1 1")),
    ("odbl", ("open database", "open data commons open database", "odbl"), ("1 0",)),
    ("odc-by", ("open data commons attribution", "odc by"), ("1 0",)),
    ("pddl", ("public domain dedication", "pddl"), ("1 0",)),
    ("ogl-uk", ("open government", "ogl"), ("1 0", "2 0", "3 0")),
    ("openrail", ("openrail", "open rail", "creativeml open rail m", "bigscience rail"), ()),
    ("llama", ("llama 2 community", "llama 3 community", "llama community"), ()),
    ("gemma", ("gemma",), ()),
    ("cecill", ("cecill",), ("1 0", "2 0", "2 1")),
    ("osl", ("open software", "osl"), ("1 0", "2 0", "3 0")),
    ("afl", ("academic free", "afl"), ("2 0", "2 1", "3 0")),
    ("upl", ("universal permissive", "upl"), ("1 0",)),
    ("postgresql", ("postgresql", "postgres"), ()),
    ("vim", ("vim",), ()),
    ("json", ("json",), ()),
    ("sspl", ("server side public", "sspl"), ("1",)),
    ("busl", ("business source", "busl"), ("1 1",)),
    ("elastic", ("elastic",), ("2 0",)),
    ("mulan", ("mulan psl", "mulan permissive software"), ("1", "2")),
    ("ncsa", ("ncsa", "university of illinois ncsa open source"), ()),
    ("x11", ("x11", "x consortium"), ()),
    ("latex", ("latex project public", "lppl"), ("1 3",)),
    ("w3c", ("w3c", "w3c software"), ()),
    ("nasa", ("nasa open source",), ("1 3",)),
    ("zpl", ("zope public", "zpl"), ("2 0", "2 1")),
    ("ipl", ("ibm public",), ("1 0",)),
    ("aladdin", ("aladdin free public",), ()),
    ("sleepycat", ("sleepycat",), ()),
    ("qpl", ("q public", "qpl"), ("1 0",)),
    ("beerware", ("beerware", "beer ware"), ()),
    ("apsl", ("apple public source", "apsl"), ("1 2", "2 0")),
    ("rpl", ("reciprocal public",), ("1 1", "1 5")),
    ("polyform", ("polyform noncommercial", "polyform small business"), ("1 0",)),
    ("cdla", ("community data",), ("1 0", "2 0")),
    ("ftl", ("freetype project", "freetype"), ()),
    ("ijg", ("independent jpeg group", "ijg"), ()),
    ("curl", ("curl",), ()),
    ("hpnd", ("historical permission notice and disclaimer",), ()),
    ("bluoak", ("blue oak model",), ("1 0",)),
    ("oflb", ("open publication",), ("1 0",)),
    ("etalab", ("etalab open", "licence ouverte"), ("1 0", "2 0")),
    ("naist", ("naist",), ()),
    ("unicode", ("unicode",), ()),
    ("icu", ("icu",), ()),
    ("tcl", ("tcl tk", "tcl"), ()),
    ("zed", ("zend engine",), ("2 0",)),
    ("intel", ("intel simplified software", "intel open source"), ()),
    ("eucod", ("eu datagrid software",), ()),
    ("ecl", ("educational community",), ("1 0", "2 0")),
    ("motosoto", ("motosoto open source",), ()),
    ("nokia", ("nokia open source",), ()),
    ("ricoh", ("ricoh source code public",), ()),
    ("sun", ("sun public", "sun industry standards source"), ("1 0", "1 1")),
    ("vovida", ("vovida software",), ("1 0",)),
    ("watcom", ("sybase open watcom public",), ("1 0",)),
    ("wxwindows", ("wxwindows library",), ()),
    ("erlang", ("erlang public",), ("1 1",)),
    ("entessa", ("entessa public",), ()),
    ("frameworx", ("frameworx open",), ()),
)
CREATIVE = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CREATIVE_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: label, keyword that any match of it holds, pattern, confidence: sentences that stand in licence texts and notices of any name. Priority by confidence.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?", 1.0),
    ("mit", "to deal in the software without restriction", r"to deal in the software without restriction", 0.95),
    ("mit", "permission notice shall be included in all copies", r"(?:the above copyright notice and this )?permission notice shall be included in all copies(?: or substantial portions(?: of the software)?)?", 0.95),
    ("mit", "publish distribute sublicense", r"(?:use copy modify merge )?publish distribute sublicense and or sell(?: copies)?", 0.9),
    ("mit-0", "mit no attribution", r"mit no attribution(?: license)?", 1.0),
    ("bsd", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms(?: with or without modification)?", 0.95),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the (?:above )?copyright notice", 0.95),
    ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the (?:above )?copyright notice", 0.95),
    ("bsd-3-clause", "may be used to endorse or promote products", r"neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products", 1.0),
    ("bsd-4-clause", "all advertising materials mentioning features", r"all advertising materials mentioning features or use of this software must display", 1.0),
    ("bsd", "this software is provided by the copyright holders and contributors", r"this software is provided by the copyright holders and contributors as is", 0.9),
    ("bsd", "regents of the university of california", r"regents of the university of california all rights reserved", 0.9),
    ("isc", "permission to use copy modify and or distribute this software", r"permission to use copy modify and or distribute this software for any purpose", 0.95),
    ("isc", "permission to use copy modify and distribute this software for any purpose", r"permission to use copy modify and distribute this software for any purpose with or without fee", 0.9),
    ("0bsd", "with or without fee is hereby granted the software", r"with or without fee is hereby granted the software is provided as is", 0.9),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose", 0.95),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", r"(?:this program is free software )?you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("gpl", "gnu general public license as published by the free software foundation", r"gnu general public license as published by the free software foundation", 1.0),
    ("gpl", "you should have received a copy of the gnu general public license", r"you should have received a copy of the gnu general public license", 0.95),
    ("gpl-2-or-later", "either version 2 of the license or", r"either version 2 of the license or at your option any later version", 1.0),
    ("gpl-3-or-later", "either version 3 of the license or", r"either version 3 of the license or at your option any later version", 1.0),
    ("gpl-2-only", "under the terms of version 2 of the gnu general public license", r"under the terms of version 2 of the gnu general public license", 1.0),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document", 0.95),
    ("gpl-classpath", "classpath exception", r"(?:with (?:the )?)?classpath exception", 0.9),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license", 1.0),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu library general public license", r"you can redistribute it and or modify it under the terms of the gnu library general public license", 1.0),
    ("lgpl", "you should have received a copy of the gnu lesser general public license", r"you should have received a copy of the gnu lesser general public license", 0.95),
    ("agpl", "under the terms of the gnu affero general public license", r"(?:you can redistribute it and or modify it )?under the terms of the gnu affero general public license", 1.0),
    ("agpl", "you should have received a copy of the gnu affero general public license", r"you should have received a copy of the gnu affero general public license", 0.95),
    ("gfdl", "permission is granted to copy distribute and or modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("gfdl", "no invariant sections no front cover texts", r"with no invariant sections no front cover texts and no back cover texts", 1.0),
    ("zlib", "this software is provided as is without any express", r"this software is provided as is without any express or implied warranty", 0.85),
    ("zlib", "the origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented", 1.0),
    ("zlib", "altered source versions must be plainly marked as such", r"altered source versions must be plainly marked as such", 1.0),
    ("boost", "to any person or organization obtaining a copy of the software", r"(?:permission is hereby granted free of charge )?to any person or organization obtaining a copy of the software", 0.95),
    ("boost", "permission is hereby granted free of charge to any person or organization", r"permission is hereby granted free of charge to any person or organization", 0.95),
    ("unlicense", "free and unencumbered software released into the public domain", r"this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute", r"anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("unlicense", "unlicense", r"(?:the )?unlicense", 0.95),
    ("public-domain", "public domain", r"(?:released (?:in)?to|in|dedicated to|placed in) the public domain", 0.8),
    ("public-domain", "public domain software", r"public domain software", 0.8),
    ("public-domain", "no rights reserved", r"no rights reserved", 0.8),
    ("apache-2.0", "licensed under the apache license version 2 0 the license", r"licensed under the apache license version 2 0 the license", 1.0),
    ("apache-2.0", "you may not use this file except in compliance with the license", r"you may not use this file except in compliance with the license", 0.95),
    ("apache-2.0", "unless required by applicable law or agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the license", 0.95),
    ("apache-2.0", "terms and conditions for use reproduction and distribution", r"terms and conditions for use reproduction and distribution", 0.9),
    ("apache-2.0", "licensed to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements", 1.0),
    ("apache-1.1", "this product includes software developed by the apache", r"this product includes software developed by the apache (?:software foundation|group)", 0.95),
    ("mpl-1.1", "subject to the mozilla public license version 1 1", r"contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", r"this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2.0", "incompatible with secondary licenses", r"incompatible with secondary licenses", 0.9),
    ("npl", "netscape public license", r"(?:the )?netscape public license", 0.9),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 1.0),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license", r"the accompanying program is provided under the terms of this eclipse public license", 1.0),
    ("cpl", "the accompanying program is provided under the terms of this common public license", r"the accompanying program is provided under the terms of this common public license", 1.0),
    ("cddl", "subject to the terms of the common development and distribution license", r"subject to the terms of the common development and distribution license", 1.0),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", r"the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("artistic", "same terms as perl itself", r"(?:under )?the same terms as perl itself", 0.95),
    ("python", "python software foundation license agreement", r"python software foundation license agreement", 0.95),
    ("php", "this product includes php", r"this product includes php software", 0.95),
    ("openssl", "software developed by the openssl project", r"this product includes software developed by the openssl project", 1.0),
    ("openssl", "cryptographic software written by eric young", r"(?:this product includes )?cryptographic software written by eric young", 0.95),
    ("ms-pl", "this license governs use of the accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license", 0.95),
    ("ofl-1.1", "this font software is licensed under the sil open font license", r"this font software is licensed under the sil open font license version 1 1", 1.0),
    ("ofl", "reserved font name", r"with reserved font names?", 0.9),
    ("odbl", "made available under the open database license", r"(?:is )?made available under the open database license", 1.0),
    ("ogl-uk", "contains public sector information licensed under the open government", r"contains public sector information licensed under the open government licence", 1.0),
    ("wtfpl", "you just do what the fuck you want to", r"you just do what the fuck you want to", 1.0),
    ("beerware", "you can buy me a beer", r"you can buy me a beer in return", 1.0),
    ("json", "shall be used for good not evil", r"the software shall be used for good not evil", 1.0),
    ("ncsa", "to deal with the software without restriction", r"to deal with the software without restriction", 0.95),
    ("postgresql", "university of california be liable to any party", r"in no event shall the university of california be liable to any party", 0.9),
    ("x11", "name of the x consortium shall not be used", r"name of the x consortium shall not be used in advertising", 1.0),
    ("curl", "copyright holder shall not be used in advertising or otherwise", r"name of a copyright holder shall not be used in advertising or otherwise", 0.95),
    ("sleepycat", "redistributions in any form must be accompanied by information", r"redistributions in any form must be accompanied by information on how to obtain complete source code", 1.0),
    ("ijg", "based in part on the work of the independent jpeg group", r"this software is based in part on the work of the independent jpeg group", 1.0),
    ("ftl", "portions of this software are copyright", r"portions of this software are copyright (?:[^ ]+ ){0,4}the freetype project", 1.0),
    ("libpng", "the png reference library is supplied as is", r"the png reference library is supplied as is", 1.0),
    ("bzip2", "altered source versions must be plainly marked as such and must not be misrepresented", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.95),
    ("info-zip", "info zip", r"(?:the )?info zip (?:license|software)", 0.9),
    ("unicode", "unicode inc license agreement", r"unicode inc license agreement(?: data files and software)?", 1.0),
    ("w3c", "w3c software notice", r"w3c software notice and license", 1.0),
    ("sspl", "offering the program as a service", r"offering the program as a service", 0.8),
    ("busl", "change date", r"change date (?:[^ ]+ ){1,8}change license", 0.8),
    ("elastic", "provide the software to third parties as a hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?", 0.9),
    ("cc0", "to the extent possible under law", r"to the extent possible under law (?:[^ ]+ ){1,10}(?:has )?waived all copyright and related or neighboring rights", 1.0),
    ("cc", "this work is licensed under a creative commons", r"this work is licensed under a creative commons", 0.95),
    ("cc", "some rights reserved", r"some rights reserved", 0.6),
    ("noncommercial", "for non commercial use only", r"for non commercial use only", 0.7),
    ("noncommercial", "noncommercial use only", r"(?:for )?noncommercial use only", 0.7),
    ("academic", "for academic use only", r"for academic use only", 0.7),
    ("academic", "for research purposes only", r"for research purposes only", 0.6),
    ("evaluation", "for evaluation purposes only", r"for evaluation purposes only", 0.6),
    ("freeware", "this software is freeware", r"this software is freeware", 0.7),
    ("shareware", "this software is shareware", r"this software is shareware", 0.7),
    ("dual-license", "dual licensed under", r"dual licensed under", 0.7),
    ("dual-license", "at your option under either", r"at your option under either", 0.6),
    ("eula", "end user license agreement", r"end user license agreement", 0.7),
    ("eula", "by installing or using this software you agree", r"by installing or using this software you agree", 0.7),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 0.6),
    ("proprietary", "unauthorized copying of this file", r"unauthorized copying of this file(?: via any medium)?(?: is strictly prohibited)?", 0.7),
    ("proprietary", "confidential and proprietary information", r"confidential and proprietary information", 0.6),
    ("proprietary", "trade secret", r"trade secrets? of", 0.6),
    ("proprietary", "no part of this publication may be reproduced", r"no part of this publication may be reproduced", 0.7),
    ("proprietary", "may not be reproduced without", r"may not be reproduced without (?:the )?(?:express |prior |written )*permission", 0.6),
    ("government", "us government restricted rights", r"us government restricted rights", 0.6),
    ("government", "work of the united states government", r"(?:this is a )?work of the united states government", 0.7),
    ("permission", "reproduced with permission", r"reproduced with permission", 0.5),
    ("permission", "used with permission", r"used (?:here )?with permission|used with permission", 0.5),
    ("warranty", "without warranty of any kind", r"(?:provided )?(?:as is )?without warranty of any kind", 0.5),
    ("warranty", "implied warranties of merchantability", r"implied warranties of merchantability(?: and fitness for a particular purpose)?", 0.5),
    ("warranty", "without even the implied warranty of merchantability", r"without even the implied warranty of merchantability(?: or fitness for a particular purpose)?", 0.5),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 0.6),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*", 0.4),
)
#: A text without any of them (lower-case) matches no rule.
STEMS = tuple(x.replace(b"_", b" ") for x in b"licen permission redistribut public_domain rights_reserved copyright proprietary provided_as_is unencumbered spdx creative cc deal_in_the_software deal_with_the_software distribute_sublicense mit_no_attribution endorse_or advertising copyright_holder regents with_or_without_fee gnu version_2 version_3 classpath invariant origin_of_this_software altered_source person_or_organization anyone_is_free contents_of_this_file accompanying distribution_license state_the_conditions perl_itself includes_software includes_php cryptographic font do_what buy_me_a_beer good_not_evil terms_and_conditions university_of x_consortium accompanied_by independent_jpeg freetype png_reference info_zip w3c a_service change_date managed_service commons_clause possible_under_law commercial academic research_purposes evaluation_purposes freeware shareware dual at_your_option installing_or_using unauthorized confidential trade_secret reproduced restricted_rights united_states_government warrant no_rights required_by_applicable published_by secondary source_code python_software".split())

_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER_BYTES)


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    pattern: re.Pattern
    score: float


def _rule(priority, label, keyword, pattern, score) -> Rule:
    return Rule(priority, label, keyword, re.compile(rf"(?<![^ ]){pattern}(?![^ ])"), score)


#: Ways in which a named licence is referred to: priority and confidence with and without a version; the pattern around the name.
FORMS = (
    (0, 1.0, 2, 0.95, r"(?:licen[sc]ed|released|distributed|available|published|covered|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{name}(?: public)? licen[sc]e"),
    (1, 0.95, 3, 0.85, r"(?:the )?(?:gnu )?{name}(?: public)? licen[sc]e"),
)


@cache
def rules() -> tuple[Rule, ...]:
    """The whole table in the order in which detections are taken. A rule's keyword is in every match of it."""
    out = [_rule(5 if score >= 0.95 else 6 if score >= 0.8 else 7 if score >= 0.6 else 8, label, keyword, f"(?:{pattern})", score) for label, keyword, pattern, score in SENTENCES]
    for label, names, versions in FAMILIES:
        for name in names:
            for first, sure, then, likely, form in FORMS:
                pattern = form.format(name=name)
                for v in versions:
                    if "clause" in v:
                        out.append(_rule(first, f"{label}-{v.replace(' ', '-')}", name, form.format(name=rf"(?:{v} {name}|{name} {v})"), sure))
                    else:
                        out.append(_rule(first, f"{label}-{v.replace(' ', '.')}", name, rf"{pattern}(?: (?:version|v))? v?{v}", sure))
                out.append(_rule(then, label, name, pattern, likely))
        spdx = label.replace("-", " ")
        for v in versions:
            out.append(_rule(2, f"{label}-{v.replace(' ', '-' if 'clause' in v else '.')}", f"identifier {spdx}", rf"spdx licen[sc]e identifier {spdx} {v}(?: only| or later)?", 1.0))
        out.append(_rule(3, label, f"identifier {spdx}", rf"spdx licen[sc]e identifier {spdx}", 1.0))
    for kind in CREATIVE:
        tag = f"cc-{kind.replace(' ', '-')}"
        for v in CREATIVE_VERSIONS:
            out.append(_rule(0, f"{tag}-{v.replace(' ', '.')}", f"cc {kind}", rf"(?:(?:licen[sc]ed|released|distributed|available|published) under )?(?:the )?(?:a )?cc {kind} v?{v}", 1.0))
        out.append(_rule(1, tag, f"cc {kind}", rf"(?:(?:licen[sc]ed|released|distributed|available|published) under )?(?:the )?(?:a )?cc {kind}", 0.9))
    for at, (words, tag) in enumerate((("attribution noncommercial sharealike", "by-nc-sa"), ("attribution noncommercial noderivatives", "by-nc-nd"), ("attribution noncommercial", "by-nc"), ("attribution sharealike", "by-sa"), ("attribution noderivatives", "by-nd"), ("attribution", "by"))):
        out.append(_rule(1 + at // 5, f"cc-{tag}", f"creative commons {words}", rf"creative commons {words}(?: \d \d)?(?: international)?(?: licen[sc]e)?", 0.95))
    out.append(_rule(1, "cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.95))
    out.append(_rule(4, "cc", "creative commons", r"creative commons(?: licen[sc]e)?", 0.7))
    for verb in ("licensed", "licenced", "released", "distributed"):
        out.append(_rule(9, "unknown-license", f"{verb} under", rf"{verb} under (?:the )?(?:terms of )?(?:[^ ]+ ){{0,4}}licen[sc]e", 0.4))
    return tuple(sorted(out, key=lambda r: r.priority))


@cache
def _keywords():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in {r.keyword for r in rules()}:
        found.add_word(word, word)
    found.make_automaton()
    return found


@cache
def _phrases() -> tuple[tuple[bytes, re.Pattern, str], ...]:
    return tuple((p.encode(), re.compile(rf"(?<![^ ]){p}(?![^ ])"), label) for p, label in BASE)


def uncovered(found: list[tuple[int, int, int, int, Rule]]) -> list[tuple[int, int, int, int, Rule]]:
    """(priority, start, end, rule's place, rule) of those that lie in no interval taken before them.

    What lies in an interval that was itself dropped lies in the one that dropped it too, so every earlier one
    counts. Earlier are lower priorities, then longer ones, then lower places: one ordered pass for each priority.
    """
    out, starts, reach = [], [], []
    for _, level in groupby(sorted(found, key=lambda x: x[0]), key=lambda x: x[0]):
        own = sorted(level, key=lambda x: (x[1], -x[2], x[3]))
        furthest = -1
        for x in own:
            at = bisect_right(starts, x[1])
            if x[2] > furthest and (not at or reach[at - 1] < x[2]):
                out.append(x)
            furthest = max(furthest, x[2])
        # All intervals so far by their start, with how far any that starts there or before reaches.
        merged = sorted([*zip(starts, reach, strict=True), *((x[1], x[2]) for x in own)])
        starts, reach = [a for a, _ in merged], list(accumulate((b for _, b in merged), max))
    return out


def detections(words: str) -> list[tuple[int, int, Rule]]:
    """Kept (start, end, rule) over words joined by single spaces, in the order taken."""
    present = {word for _, word in _keywords().iter(words)}
    found = [(r.priority, m.start(), m.end(), at, r) for at, r in enumerate(rules()) if r.keyword in present for m in r.pattern.finditer(words)]
    return [(a, b, r) for _, a, b, _, r in sorted(uncovered(found), key=lambda x: (x[0], x[1] - x[2], x[1], x[3]))]


def scan(text: str) -> dict:
    """What the rules and the base phrases find in one whole text; word numbers count from 0."""
    parts = text.encode("utf-8", "replace").translate(_WORD_BYTES).split()
    out = {"n_words": len(parts), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
    joined = b" ".join(parts)
    if not any(stem in joined for stem in STEMS):
        return out
    words = joined.decode("utf-8", "replace")
    kept = detections(words)
    # Words are counted once, then looked up: texts may be long and hold many places.
    ends = [x.start() for x in re.finditer(" ", words)] if kept or any(p in joined for p, _, _ in _phrases()) else []
    number = lambda place: bisect_left(ends, place)
    places, base = [], set()
    for phrase, pattern, label in _phrases():
        if phrase in joined:
            # No phrase overlaps itself, so finditer() sees each place.
            at = [number(m.start()) for m in pattern.finditer(words)]
            places += at
            base |= {label} if at else set()
    score = max([BASE_SCORE if base else 0.0, *(r.score for _, _, r in kept)])
    out |= {"n_base": len(places), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {r.label for _, _, r in kept})), "score": score}
    out["spans"] = [(number(a), number(b) + 1, r.label) for a, b, r in kept]
    if places:
        out |= {"first_word": min(places), "last_word": max(places)}
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,end:long,label:string>>"


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document, with the word span and label of every kept detection."""
    ship_package(docs.sparkSession)
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan(x) for x in batch.column(1).to_pylist()]
            column = lambda k, kind: pa.array([x[k] for x in got], kind)
            spans = pa.array([[{"first": a, "end": b, "label": c} for a, b, c in x["spans"]] for x in got], span)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(column(k, pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")), column("base_labels", pa.string()), column("labels", pa.string()), column("score", pa.float64()), spans],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def op10_license_rules(docs: DataFrame) -> DataFrame:
    return license_scan(docs).drop("spans")
