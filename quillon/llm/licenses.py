"""License detection by ordered signature rules, in DataFrame expressions only.

A signature is a row of words, some of them optional or with alternatives. It compiles to a regex
over lower-cased words that one space joins, and to its gate: words without which it cannot match. One scan splits a
text into words, keeps those that gates ask for, and runs only the regexes whose gates are
satisfied; each regex is a literal of the plan. Detections carry word intervals and priorities: one that lies inside another of
the same or a higher priority is suppressed, by running maxima over a text's detections in order of place, so it takes n log n in
their number.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship, text_or_empty, tune

ship(__name__)

#: Base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Signatures: slots with a space between. "a|b" is either, "?" at the end makes a slot optional, "_"
# joins the words of one alternative, "#" is a number.

#: Names of licenses: label and name. They are tried in every form of FORMS.
NAMES: list[tuple[str, str]] = [
    ("mit", "mit x11|expat?"),
    ("mit-0", "mit no_attribution|0"),
    ("apache-1.0", "apache software? license? version|v? 1_0|v1_0"),
    ("apache-1.1", "apache software? license? version|v? 1_1|v1_1"),
    ("apache-2.0", "apache software? license? version|v? 2|v2 0?"),
    ("apache-2.0", "apache2|apachev2|asl_2|al2 0?"),
    ("gpl-1.0", "gnu? general public license version|v? 1|v1 0?"),
    ("gpl-2.0", "gnu? general public license version|v? 2|v2 0?"),
    ("gpl-3.0", "gnu? general public license version|v? 3|v3 0?"),
    ("gpl-1.0", "gnu? gpl1|gplv1|gpl_1|gpl_v1|gpl_version_1 0?"),
    ("gpl-2.0", "gnu? gpl2|gplv2|gpl_2|gpl_v2|gpl_version_2 0?"),
    ("gpl-3.0", "gnu? gpl3|gplv3|gpl_3|gpl_v3|gpl_version_3 0?"),
    ("lgpl-2.0", "gnu? library general public license version|v? 2|v2 0?"),
    ("lgpl-2.1", "gnu? lesser general public license version|v? 2|v2 1?"),
    ("lgpl-3.0", "gnu? lesser general public license version|v? 3|v3 0?"),
    ("lgpl-2.0", "gnu? lgpl_2_0|lgplv2_0|lgpl_v2_0|lgpl_version_2_0"),
    ("lgpl-2.1", "gnu? lgpl21|lgpl_2_1|lgplv2_1|lgpl_v2_1|lgpl_version_2_1"),
    ("lgpl-3.0", "gnu? lgpl3|lgplv3|lgpl_3|lgpl_v3|lgpl_version_3 0?"),
    ("agpl-3.0", "gnu? affero general public license version|v? 3|v3 0?"),
    ("agpl-3.0", "gnu? agpl3|agplv3|agpl_3|agpl_v3|agpl_version_3 0?"),
    ("gfdl", "gnu? free documentation license version? #? #?"),
    ("gfdl", "gfdl version|v? #? #?"),
    ("bsd-1-clause", "bsd_1_clause|1_clause_bsd|one_clause_bsd"),
    ("bsd-2-clause", "bsd_2_clause|2_clause_bsd|two_clause_bsd|simplified_bsd|freebsd"),
    ("bsd-3-clause", "bsd_3_clause|3_clause_bsd|three_clause_bsd|new_bsd|modified_bsd|revised_bsd"),
    ("bsd-4-clause", "bsd_4_clause|4_clause_bsd|four_clause_bsd|original_bsd|old_bsd"),
    ("0bsd", "0bsd|zero_clause_bsd|bsd_zero_clause|bsd_0_clause"),
    ("bsd-patent", "bsd_2_clause_patent|bsd_patent|bsd_plus_patent"),
    ("mpl-1.0", "mozilla public license version|v? 1_0|v1_0"),
    ("mpl-1.1", "mozilla public license version|v? 1_1|v1_1"),
    ("mpl-2.0", "mozilla public license version|v? 2|v2 0?"),
    ("mpl-1.1", "mpl_1_1|mplv1_1|mpl_v1_1"),
    ("mpl-2.0", "mpl2|mplv2|mpl_2|mpl_v2 0?"),
    ("epl-1.0", "eclipse public license version|v? 1|v1 0?"),
    ("epl-2.0", "eclipse public license version|v? 2|v2 0?"),
    ("epl-1.0", "epl_1_0|eplv1|epl_v1_0|epl_v10"),
    ("epl-2.0", "epl_2_0|eplv2|epl_v2_0|epl_v20"),
    ("edl-1.0", "eclipse distribution license version|v? 1? 0?"),
    ("cddl-1.0", "common development and distribution license version|v? 1? 0?"),
    ("cddl-1.0", "cddl version|v? 1|v1? 0?"),
    ("cddl-1.1", "cddl_1_1|cddl_v1_1|cddl_version_1_1"),
    ("cpl-1.0", "common public license version|v? 1? 0?"),
    ("ipl-1.0", "ibm public license version|v? 1? 0?"),
    ("eupl-1.1", "eupl|european_union_public_licence|european_union_public_license version|v? 1_1|v1_1"),
    ("eupl-1.2", "eupl|european_union_public_licence|european_union_public_license version|v? 1_2|v1_2"),
    ("cecill-2.1", "cecill version|v? 2? 1?"),
    ("isc", "isc"),
    ("zlib", "zlib libpng?"),
    ("libpng", "libpng version|v? 2?"),
    ("boost-1.0", "boost software license version|v? 1? 0?"),
    ("boost-1.0", "bsl_1_0|boost_1_0"),
    ("artistic-1.0", "artistic license? version|v? 1|v1 0?"),
    ("artistic-2.0", "artistic license? version|v? 2|v2 0?"),
    ("perl", "perl_artistic|same_terms_as_perl_itself|same_terms_as_perl"),
    ("unlicense", "unlicense"),
    ("wtfpl", "wtfpl version|v? 2?"),
    ("beerware", "beerware|beer_ware"),
    ("cc0-1.0", "cc0|creative_commons_zero|cc_zero version|v? 1? 0? universal?"),
    ("cc-by", "cc_by # #? international|unported|generic?"),
    ("cc-by", "creative commons attribution # #? international|unported|generic?"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-sa", "cc_by_sa|creative_commons_attribution_sharealike|creative_commons_attribution_share_alike #? #? international|unported|generic?"),
    ("cc-by-nd", "cc_by_nd|creative_commons_attribution_noderivatives|creative_commons_attribution_noderivs|creative_commons_attribution_no_derivatives #? #? international|unported|generic?"),
    ("cc-by-nc", "cc_by_nc|creative_commons_attribution_noncommercial|creative_commons_attribution_non_commercial #? #? international|unported|generic?"),
    ("cc-by-nc-sa", "cc_by_nc_sa|creative_commons_attribution_noncommercial_sharealike|creative_commons_attribution_non_commercial_share_alike #? #? international|unported|generic?"),
    ("cc-by-nc-nd", "cc_by_nc_nd|creative_commons_attribution_noncommercial_noderivatives|creative_commons_attribution_noncommercial_noderivs #? #? international|unported|generic?"),
    ("odbl-1.0", "odbl|open_database_license version|v? 1? 0?"),
    ("odc-by-1.0", "odc_by|open_data_commons_attribution license? version|v? 1? 0?"),
    ("pddl-1.0", "pddl|public_domain_dedication_and_license version|v? 1? 0?"),
    ("cdla-permissive", "cdla_permissive|community_data_license_agreement_permissive version|v? #? #?"),
    ("cdla-sharing", "cdla_sharing|community_data_license_agreement_sharing version|v? #? #?"),
    ("psf-2.0", "python_software_foundation_license|psf_license version|v? 2?"),
    ("php-3.01", "php license? version|v? 3_01|3_0"),
    ("ruby", "ruby_license|ruby_s_license"),
    ("ofl-1.1", "sil? open font license version|v? 1? 1?"),
    ("ofl-1.1", "ofl_1_1|sil_ofl"),
    ("postgresql", "postgresql"),
    ("ncsa", "university_of_illinois_ncsa|ncsa open? source?"),
    ("ms-pl", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal license"),
    ("afl-3.0", "academic free license version|v? 3? 0?"),
    ("osl-3.0", "open software license version|v? 3? 0?"),
    ("upl-1.0", "universal permissive license version|v? 1? 0?"),
    ("bsl-1.1", "business source license version|v? 1? 1?"),
    ("sspl-1.0", "sspl|server_side_public_license version|v? 1? 0?"),
    ("elastic-2.0", "elastic license version|v? 2|v2 0?"),
    ("polyform", "polyform noncommercial|shield|strict|perimeter|free_trial|small_business|internal_use"),
    ("commons-clause", "commons clause"),
    ("openrail", "openrail|open_rail|bigscience_rail|creativeml_openrail m?"),
    ("llama", "llama #? #? community"),
    ("openssl", "openssl"),
    ("vim", "vim"),
    ("json", "json license"),
    ("curl", "curl_license|curl_and_libcurl"),
    ("w3c", "w3c software and? document? notice_and_license|license"),
    ("ogl-uk-3.0", "open government licence|license version|v? 3? 0?"),
]

#: Names that are also other things: they count with a word of FORMS beside them only.
_NEEDS_FORM = {"mit", "isc", "zlib", "libpng", "vim", "openssl", "postgresql", "ncsa", "mit-0", "beerware"}

#: The forms a name takes: form, priority, slots around {name}.
FORMS: list[tuple[str, int, str]] = [
    ("tag", 4, "spdx license identifier {name}"),
    ("grant", 3, "licensed|released|distributed|published|available|provided|redistributed|licenced|offered|shared to_you? under the? terms_of|terms_and_conditions_of? the? {name} license|licence?"),
    ("conditions", 3, "subject to the? terms_of|terms_and_conditions_of|conditions_of? the? {name} license|licence?"),
    ("reference", 2, "copy_of|as_in|see|under|with the? {name} license|licence"),
    ("title", 2, "{name} license|licence agreement?"),
    ("field", 2, "license|licence|licenses|licensing {name}"),
    ("name", 1, "{name}"),
]

#: Sentences and addresses of license texts, and notices that are no license: label, priority, slots.
SENTENCES: list[tuple[str, int, str]] = [
    ("mit", 3, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 3, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 2, "the software is provided as is without warranty of any kind express or implied"),
    ("mit", 2, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", 2, "opensource org licenses|license mit"),
    ("json", 3, "the software shall be used for good not evil"),
    ("bsd", 3, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 2, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 2, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 2, "this software is provided by the copyright holders|copyright_holder|regents|author and? contributors? as is and any express or implied warranties"),
    ("bsd-3-clause", 3, "nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 3, "all advertising materials mentioning features or use of this software must display the following acknowledgement|acknowledgment"),
    ("bsd-2-clause", 2, "opensource org licenses|license bsd_2_clause"),
    ("bsd-3-clause", 2, "opensource org licenses|license bsd_3_clause"),
    ("isc", 3, "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted"),
    ("ntp", 3, "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("apache-2.0", 3, "you may not use this file except in compliance with the license"),
    ("apache-2.0", 3, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 3, "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", 3, "licensed to the apache software foundation asf? under one or more contributor license agreements"),
    ("apache-2.0", 3, "www? apache org licenses license_2_0"),
    ("apache-1.1", 3, "this product includes software developed by the apache software foundation"),
    ("gpl", 3, "is free software you can redistribute it and or modify it under the terms of the gnu? general public license"),
    ("lgpl", 3, "is free software you can redistribute it and or modify it under the terms of the gnu? lesser|library general public license"),
    ("agpl", 3, "is free software you can redistribute it and or modify it under the terms of the gnu? affero general public license"),
    ("gpl-2.0-or-later", 3, "either version_2|version_2_0 of the license or at your option any later version"),
    ("gpl-3.0-or-later", 3, "either version_3|version_3_0 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", 3, "either version_2_1 of the license or at your option any later version"),
    ("gpl", 2, "you should have received a copy of the gnu general public license"),
    ("lgpl", 2, "you should have received a copy of the gnu lesser|library general public license"),
    ("agpl", 2, "you should have received a copy of the gnu affero general public license"),
    ("gpl", 1, "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu"),
    ("gpl-2.0", 3, "gnu org licenses old_licenses? gpl_2_0"),
    ("gpl-3.0", 3, "gnu org licenses gpl_3_0"),
    ("lgpl-2.1", 3, "gnu org licenses old_licenses? lgpl_2_1"),
    ("lgpl-3.0", 3, "gnu org licenses lgpl_3_0"),
    ("agpl-3.0", 3, "gnu org licenses agpl_3_0"),
    ("gfdl", 3, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-exception", 3, "as a special exception the copyright holders give you permission to link this"),
    ("classpath-exception", 3, "linking this library statically or dynamically with other modules is making a combined work"),
    ("gcc-exception", 3, "gcc runtime library exception"),
    ("mpl-1.1", 3, "the contents of this file are subject to the mozilla public license version_1_1"),
    ("mpl-2.0", 3, "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", 3, "mozilla org mpl 2_0"),
    ("npl", 3, "the contents of this file are subject to the netscape public license"),
    ("epl-1.0", 3, "eclipse org legal epl_v10"),
    ("epl-2.0", 3, "eclipse org legal epl_2_0|epl_v20"),
    ("epl", 2, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", 3, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", 2, "this program and the accompanying materials are made available under the terms of the common public license"),
    ("zlib", 3, "this software is provided as is without any express or implied warranty"),
    ("zlib", 3, "the origin of this software must not be misrepresented"),
    ("zlib", 3, "altered source versions must be plainly marked as such"),
    ("boost-1.0", 3, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("boost-1.0", 3, "boost org license_1_0"),
    ("unlicense", 3, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 2, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 2, "unlicense org"),
    ("wtfpl", 3, "do what the fuck you want to"),
    ("beerware", 3, "you can buy me a beer in return"),
    ("cc0-1.0", 3, "to the extent possible under law"),
    ("cc0-1.0", 3, "waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 3, "creativecommons org publicdomain zero"),
    ("cc-by", 3, "creativecommons org licenses by #"),
    ("cc-by-sa", 3, "creativecommons org licenses by_sa"),
    ("cc-by-nd", 3, "creativecommons org licenses by_nd"),
    ("cc-by-nc", 3, "creativecommons org licenses by_nc #"),
    ("cc-by-nc-sa", 3, "creativecommons org licenses by_nc_sa"),
    ("cc-by-nc-nd", 3, "creativecommons org licenses by_nc_nd"),
    ("cc", 1, "some rights reserved"),
    ("odbl-1.0", 2, "opendatacommons org licenses odbl"),
    ("pddl-1.0", 2, "opendatacommons org licenses pddl"),
    ("odc-by-1.0", 2, "opendatacommons org licenses by"),
    ("artistic-1.0", 3, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", 2, "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("perl", 3, "you can redistribute it and or modify it under the same terms as perl"),
    ("ruby", 2, "you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("psf-2.0", 3, "psf is making python available to licensee on an as is basis"),
    ("php-3.01", 3, "this source file is subject to version 3 of? 0|01? of? the php license"),
    ("ofl-1.1", 3, "this font software is licensed under the sil open font license"),
    ("ofl-1.1", 2, "scripts sil org ofl"),
    ("postgresql", 3, "in no event shall the university of california be liable to any party for direct indirect special"),
    ("ncsa", 3, "to deal with the software without restriction"),
    ("openssl", 3, "this product includes software developed by the openssl project"),
    ("ssleay", 3, "this product includes cryptographic software written by eric young"),
    ("ms-pl", 2, "the microsoft public license governs use of the accompanying software"),
    ("afl-3.0", 2, "licensed under the academic free license"),
    ("elastic-2.0", 3, "you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1.0", 2, "offering the program as a service"),
    ("bsl-1.1", 3, "effective on the change date the licensor hereby grants you rights under the terms of the change license"),
    ("commons-clause", 3, "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("polyform", 2, "any noncommercial purpose is a permitted purpose"),
    ("llama", 3, "llama materials is licensed under the llama"),
    ("openrail", 3, "use based restrictions as referenced in paragraph 5"),
    ("ogl-uk-3.0", 3, "contains public sector information licensed under the open government licence"),
    ("us-government", 2, "this is a work of the u_s government|united_states_government"),
    ("us-government", 2, "not subject to copyright protection in the united states"),
    ("public-domain", 2, "released|placed|dedicated|put into|in|to the public domain"),
    ("public-domain", 1, "public domain dedication"),
    ("all-rights-reserved", 1, "all rights reserved"),
    ("proprietary", 2, "proprietary and confidential"),
    ("proprietary", 2, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 2, "no part of this publication|book|document|work may be reproduced"),
    ("proprietary", 2, "may not be copied or? distributed? without the? prior? express? written permission"),
    ("non-commercial", 1, "for personal_and_non_commercial|non_commercial|noncommercial use only"),
    ("non-commercial", 2, "not for commercial use"),
    ("academic-only", 2, "for academic|research|academic_research use|purposes only"),
]

#: Confidence of a label by the priority of its best detection.
CONFIDENCE = {4: 1.0, 3: 0.9, 2: 0.8, 1: 0.6}

#: Words of signatures that any text may hold: a gate prefers others.
_FREQUENT = frozenset("a all and any are as at be by can do for from general good html http in is it its law may no not of on one only or org other party person public s see shall source terms that the this to under use used want what with without you work".split())

_WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def compiled(slots: str) -> tuple[str, list[frozenset[str]]]:
    """(regex, gate) of a signature. A match starts at the space before its first word and ends before
    a space. The gate is one or two disjoint sets of words; a text that matches holds a word of each."""
    regex, must = "", []
    for i, slot in enumerate(slots.split()):
        optional = slot.endswith("?")
        ways = [w.replace("_", " ") for w in slot.removesuffix("?").split("|")]
        inner = "|".join("[0-9]{1,4}" if w == "#" else w for w in ways)
        body = f" (?:{inner})" if len(ways) > 1 else f" {inner}"
        regex += f"(?:{body})?" if optional else body
        if not optional and "#" not in ways:
            # of each alternative its rarest word
            must.append((i, frozenset(max(w.split(), key=lambda x: (x not in _FREQUENT, len(x))) for w in ways)))
    must.sort(key=lambda m: (bool(m[1] & _FREQUENT), len(m[1]), -min(len(w) for w in m[1]), m[0]))
    first = must[0][1]
    return regex + "(?= )", [first, *[words for _, words in must[1:] if not words & first][:1]]


@cache
def rule_list() -> list[tuple[str, int, bool, str, list[frozenset[str]]]]:
    """(label, priority, base, regex, gate) in order of rule number: base phrases, names in all
    their forms, sentences. Of several rules that find one place at one priority the first stays."""
    signatures = [(label, 2, True, phrase) for phrase, label in BASE]
    for label, name in NAMES:
        signatures += [(label, priority, False, around.replace("{name}", name)) for form, priority, around in FORMS if form != "name" or label not in _NEEDS_FORM]
    signatures += [(label, priority, False, slots) for label, priority, slots in SENTENCES]
    return [(label, priority, base, *compiled(slots)) for label, priority, base, slots in signatures]


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def scan_expression(words: str) -> str:
    """SQL for struct(n_words, found) of an array of words. ``found`` has a struct (rule, gaps, sizes)
    for each rule that matches: the words of its k-th match, and those between it and the match before.
    """
    rules = rule_list()
    gates: dict[tuple, dict[tuple, list[int]]] = {}
    for i, rule in enumerate(rules):
        first, *second = [tuple(sorted(words)) for words in rule[4]]
        gates.setdefault(first, {}).setdefault(tuple(second), []).append(i)
    holds = lambda s: f"array_contains(held, '{s[0]}')" if len(s) == 1 else f"arrays_overlap(held, array({_list(s)}))"
    tried = []
    for first, parts in gates.items():
        each = []
        for second, numbers in parts.items():
            hits = f"array({', '.join(f"named_struct('rule', {i}, 'hits', regexp_extract_all(line, '{rules[i][3]}', 0))" for i in numbers)})"
            each.append(f"CASE WHEN {holds(second[0])} THEN {hits} END" if second else hits)
        tried.append(f"CASE WHEN {holds(first)} THEN flatten(array_compact(array({', '.join(each)}))) END")
    regexes = f"element_at(split('{'~'.join(r[3] for r in rules)}', '~'), x.rule + 1)"
    spaces = "length({0}) - length(replace({0}, ' ', ''))"
    found = (
        f"transform(filter(flatten(array_compact(array({', '.join(tried)}))), x -> size(x.hits) > 0), x -> named_struct('rule', x.rule, "
        f"'gaps', transform(split(line, {regexes}, -1), y -> {spaces.format('y')}), 'sizes', transform(x.hits, y -> {spaces.format('y')})))"
    )
    in_line = f"transform(array(concat(' ', array_join(w, ' '), ' ')), line -> {found})[0]"
    alone = set().union(*(rule[4][0] for rule in rules if len(rule[4]) == 1))
    open_ = f"size(held) > 1 OR arrays_overlap(held, array({_list(alone)}))"
    gated = f"transform(array(array_intersect(w, array({_list(set().union(*(words for rule in rules for words in rule[4])))}))), held -> CASE WHEN {open_} THEN {in_line} END)[0]"
    return f"transform(array({words}), w -> named_struct('n_words', CAST(size(w) AS BIGINT), 'found', {gated}))[0]"


def detections(rows: DataFrame) -> DataFrame:
    """(uid, rule, label, priority, base, start, end) of every match, words from 0, end exclusive.
    ``rows``: uid and ``found`` of :func:`scan_expression`."""
    rules = [(i, label, priority, base) for i, (label, priority, base, _, _) in enumerate(rule_list())]
    table = rows.sparkSession.createDataFrame(rules, "rule int, label string, priority int, base boolean")
    each = rows.select("uid", F.explode("found").alias("f")).select("uid", "f.rule", F.posexplode(F.arrays_zip(F.slice("f.gaps", F.lit(1), F.size("f.sizes")).alias("gap"), F.col("f.sizes").alias("n"))).alias("k", "m"))
    order = Window.partitionBy("uid", "rule").orderBy("k")
    end = F.sum(F.col("m.gap") + F.col("m.n")).over(order)
    placed = each.select("uid", "rule", (end - F.col("m.n")).alias("start"), end.alias("end"))
    return placed.join(F.broadcast(table), "rule").select("uid", "rule", "label", "priority", "base", "start", "end")


def unsuppressed(found: DataFrame) -> DataFrame:
    """Without detections that lie inside another of the same or a higher priority; of equal
    intervals and priorities the first rule stays."""
    order = Window.partitionBy("uid").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order)) for p in CONFIDENCE], F.lit(-1))
    return found.withColumn("reach", reach).where("end > reach").drop("reach")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, detections.

    ``n_base`` counts all places of base phrases; first_word and last_word are their smallest and
    largest start. Labels are those of base phrases and of detections that nothing suppressed,
    distinct, sorted and comma-joined, "" if none; score is the confidence of the best detection, 0
    if none. Null text has no words. Null ids, repeated rows and texts of any length are rows like
    any others; an empty table gives an empty result; extra columns are ignored.
    """
    tune(docs.sparkSession)
    text = text_or_empty(f"`{text_col}`")
    words = F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _WORD_GAP), "")
    split = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("doc_id"), words.alias("words"))
    scanned = split.select("uid", "doc_id", F.expr(scan_expression("words")).alias("s"))
    rows = saved(scanned.select("uid", "doc_id", "s.n_words", "s.found"), "matches")
    found = saved(detections(rows.where("size(found) > 0")), "detections")
    base = found.where("base").groupBy("uid").agg(F.count("*").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"), F.collect_set("label").alias("base_set"))
    best = unsuppressed(found.where("not base")).groupBy("uid").agg(
        F.collect_set("label").alias("more"), F.max("priority").alias("priority"), F.array_sort(F.collect_list(F.struct("start", "end", "label", "rule"))).alias("detections")
    )
    out = rows.select("uid", "doc_id", "n_words").join(base, "uid", "left").join(best, "uid", "left")
    none = F.array().cast("array<string>")
    base_set, more = F.coalesce("base_set", none), F.coalesce("more", none)
    by_base = F.when(F.col("n_base") > 0, CONFIDENCE[2]).otherwise(0.0)
    by_rule = F.coalesce(*[F.when(F.col("priority") == p, c) for p, c in CONFIDENCE.items()], F.lit(0.0))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_set, more)), ",").alias("labels"),
        F.greatest(by_base, by_rule).alias("score"), "detections",
    )
