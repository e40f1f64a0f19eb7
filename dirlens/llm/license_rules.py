"""Rules of the licence scan, in order of priority.

A rule is a regular expression over the words of a text, lower-cased and joined by one space. It applies to whole words and
only to texts that have its keyword. Rules come in four tiers; within a tier earlier rules have priority.

1. tags: an SPDX line that names a licence
2. terms: passages of a licence itself
3. notices: a statement that something is under a licence
4. names: a licence that is mentioned
"""

from __future__ import annotations

import re
from typing import NamedTuple

TAG, TERMS, NOTICE, NAME = 1, 2, 3, 4
#: How sure a detection of a tier is.
CERTAINTY = {TAG: 0.99, TERMS: 0.9, NOTICE: 0.95, NAME: 0.7}


class Rule(NamedTuple):
    tier: int
    label: str
    keyword: str
    pattern: str
    base: bool = False


# Licences: label | keyword | SPDX identifier as words, or - | the name as a pattern over words.
_V = "(?:(?:v|version|ver) ?)?"
_OR = "(?: (?:or later|or any later version|only|plus))?"
_LICENCES = rf"""
agpl-3.0 | affero | agpl 3 0 | (?:gnu )?affero (?:general )?public licen[cs]e {_V}3(?: 0)?{_OR}
agpl-3.0 | agpl | agpl 3 0{_OR} | (?:gnu )?agpl {_V}3(?: 0)?{_OR}
agpl | affero | - | (?:gnu )?affero (?:general )?public licen[cs]e
lgpl-3.0 | lesser | lgpl 3 0{_OR} | (?:gnu )?lesser general public licen[cs]e {_V}3(?: 0)?{_OR}
lgpl-2.1 | lesser | lgpl 2 1{_OR} | (?:gnu )?lesser general public licen[cs]e {_V}2 1{_OR}
lgpl-2.0 | library | lgpl 2 0{_OR} | (?:gnu )?library general public licen[cs]e(?: {_V}2(?: 0)?)?{_OR}
lgpl-3.0 | lgpl | - | (?:gnu )?lgpl {_V}3(?: 0)?{_OR}
lgpl-2.1 | lgpl | - | (?:gnu )?lgpl {_V}2 1{_OR}
lgpl | lesser | - | (?:gnu )?lesser general public licen[cs]e
lgpl | lgpl | lgpl | (?:the )?(?:gnu )?lgpl licen[cs]e
gpl-3.0 | general | gpl 3 0{_OR} | (?:gnu )?general public licen[cs]e {_V}3(?: 0)?{_OR}
gpl-2.0 | general | gpl 2 0{_OR} | (?:gnu )?general public licen[cs]e {_V}2(?: 0)?{_OR}
gpl-1.0 | general | gpl 1 0{_OR} | (?:gnu )?general public licen[cs]e {_V}1(?: 0)?{_OR}
gpl-3.0 | gpl | - | (?:gnu )?gpl {_V}3(?: 0)?{_OR}
gpl-2.0 | gpl | - | (?:gnu )?gpl {_V}2(?: 0)?{_OR}
gpl-3.0 | gplv3 | - | (?:gnu )?gplv3{_OR}
gpl-2.0 | gplv2 | - | (?:gnu )?gplv2{_OR}
lgpl-3.0 | lgplv3 | - | (?:gnu )?lgplv3{_OR}
lgpl-2.1 | lgplv2 | - | (?:gnu )?lgplv2(?: 1)?{_OR}
agpl-3.0 | agplv3 | - | (?:gnu )?agplv3{_OR}
gfdl | documentation | gfdl 1 [123]{_OR} | (?:gnu )?free documentation licen[cs]e(?: {_V}1 [123])?{_OR}
gpl | gpl | gpl | (?:the )?(?:gnu )?gpl licen[cs]e
apache-2.0 | apache | apache 2 0 | apache (?:software )?licen[cs]e {_V}2(?: 0)?
apache-1.1 | apache | apache 1 1 | apache (?:software )?licen[cs]e {_V}1 1
apache-1.0 | apache | apache 1 0 | apache (?:software )?licen[cs]e {_V}1 0
apache-2.0 | apache | - | apache {_V}2(?: 0)? licen[cs]e
mit-0 | mit | mit 0 | mit (?:no attribution|0) licen[cs]e
mit | mit | mit | (?:expat )?mit(?: style| x11)? licen[cs]e
mit | expat | - | expat licen[cs]e
x11 | x11 | x11 | x11 licen[cs]e
bsd-4-clause | bsd | bsd 4 clause | (?:(?:original|4 clause|four clause|old) bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?)
bsd-3-clause | bsd | bsd 3 clause | (?:(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?)
bsd-2-clause | bsd | bsd 2 clause | (?:(?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?)
0bsd | 0bsd | 0bsd | 0bsd(?: licen[cs]e)?
0bsd | bsd | - | zero clause bsd(?: licen[cs]e)?
bsd | bsd | - | (?:berkeley )?bsd(?: style)? licen[cs]e
isc | isc | isc | isc licen[cs]e
mpl-2.0 | mozilla | mpl 2 0 | mozilla public licen[cs]e {_V}2(?: 0)?
mpl-1.1 | mozilla | mpl 1 1 | mozilla public licen[cs]e {_V}1 1
mpl-1.0 | mozilla | mpl 1 0 | mozilla public licen[cs]e {_V}1 0
mpl-2.0 | mpl | - | mpl {_V}2(?: 0)?
mpl | mozilla | - | mozilla public licen[cs]e
epl-2.0 | eclipse | epl 2 0 | eclipse public licen[cs]e {_V}2(?: 0)?
epl-1.0 | eclipse | epl 1 0 | eclipse public licen[cs]e {_V}1(?: 0)?
epl | eclipse | - | eclipse public licen[cs]e
edl-1.0 | eclipse | - | eclipse distribution licen[cs]e(?: {_V}1 0)?
cddl-1.1 | cddl | cddl 1 1 | cddl {_V}1 1
cddl-1.0 | cddl | cddl 1 0 | cddl {_V}1 0
cddl | development | - | common development and distribution licen[cs]e(?: {_V}1 [01])?
cpl-1.0 | common | cpl 1 0 | common public licen[cs]e(?: {_V}1 0)?
ipl-1.0 | ibm | ipl 1 0 | ibm public licen[cs]e(?: {_V}1 0)?
eupl-1.2 | eupl | eupl 1 2 | eupl {_V}1 2
eupl-1.1 | eupl | eupl 1 1 | eupl {_V}1 1
eupl | european | - | european union public licen[cs]e(?: {_V}1 [12])?
artistic-2.0 | artistic | artistic 2 0 | artistic licen[cs]e {_V}2(?: 0)?
artistic-1.0 | artistic | artistic 1 0 | (?:perl |clarified )?artistic licen[cs]e(?: {_V}1(?: 0)?)?
bsl-1.0 | boost | bsl 1 0 | boost software licen[cs]e(?: {_V}1(?: 0)?)?
busl-1.1 | business | busl 1 1 | business source licen[cs]e(?: {_V}1 1)?
sspl-1.0 | side | sspl 1 0 | server side public licen[cs]e(?: {_V}1)?
elastic-2.0 | elastic | elastic 2 0 | elastic licen[cs]e(?: {_V}2(?: 0)?)?
zlib | zlib | zlib | zlib(?: libpng)? licen[cs]e
libpng | libpng | libpng(?: 2 0)? | libpng licen[cs]e
openssl | openssl | openssl | openssl licen[cs]e
python-2.0 | psf | - | psf licen[cs]e(?: {_V}2)?
python-2.0 | python | python 2 0 | python(?: software foundation)? licen[cs]e(?: {_V}2)?
php-3.01 | php | php 3 01 | php licen[cs]e(?: {_V}3 0?1)?
ruby | ruby | ruby | ruby licen[cs]e
w3c | w3c | w3c | w3c(?: software)?(?: notice and)? licen[cs]e
unicode | unicode | unicode dfs 20[0-9]+ | unicode licen[cs]e(?: agreement)?
ncsa | ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e
postgresql | postgresql | postgresql | postgresql licen[cs]e
afl-3.0 | academic | afl 3 0 | academic free licen[cs]e(?: {_V}3(?: 0)?)?
osl-3.0 | open | osl 3 0 | open software licen[cs]e(?: {_V}3(?: 0)?)?
ms-pl | microsoft | ms pl | microsoft public licen[cs]e
ms-rl | microsoft | ms rl | microsoft reciprocal licen[cs]e
ofl-1.1 | font | ofl 1 1 | (?:sil )?open font licen[cs]e(?: {_V}1 1)?
odbl-1.0 | database | odbl 1 0 | open (?:data commons open )?database licen[cs]e(?: {_V}1 0)?
odc-by-1.0 | commons | odc by 1 0 | open data commons attribution licen[cs]e(?: {_V}1 0)?
pddl-1.0 | dedication | pddl 1 0 | (?:open data commons )?public domain dedication and licen[cs]e(?: {_V}1 0)?
wtfpl | wtfpl | wtfpl | wtfpl(?: licen[cs]e)?
unlicense | unlicense | unlicense | (?:the )?unlicense
beerware | beerware | beerware | beerware licen[cs]e
json | json | json | json licen[cs]e
vim | vim | vim | vim licen[cs]e
curl | curl | curl | curl licen[cs]e
tcl | tcl | tcl | tcl(?: tk)? licen[cs]e
qpl-1.0 | public | qpl 1 0 | q public licen[cs]e(?: {_V}1 0)?
sleepycat | sleepycat | sleepycat | sleepycat licen[cs]e
zpl-2.1 | zope | zpl 2 1 | zope public licen[cs]e(?: {_V}2 [01])?
lppl-1.3c | latex | lppl 1 3c | latex project public licen[cs]e(?: {_V}1 3c?)?
openrail | openrail | - | openrail(?: m)? licen[cs]e
cc0-1.0 | cc0 | cc0 1 0 | (?:creative commons )?(?:cc )?cc0(?: {_V}1(?: 0)?)?(?: universal)?(?: public domain dedication| licen[cs]e)?
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0 | cc by nc nd {_V}4(?: 0)?(?: international)?
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0 | cc by nc sa {_V}4(?: 0)?(?: international)?
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0 | cc by nc nd {_V}3(?: 0)?(?: unported)?
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0 | cc by nc sa {_V}3(?: 0)?(?: unported)?
cc-by-nc-4.0 | cc | cc by nc 4 0 | cc by nc {_V}4(?: 0)?(?: international)?
cc-by-nc-3.0 | cc | cc by nc 3 0 | cc by nc {_V}3(?: 0)?(?: unported)?
cc-by-nd-4.0 | cc | cc by nd 4 0 | cc by nd {_V}4(?: 0)?(?: international)?
cc-by-nd-3.0 | cc | cc by nd 3 0 | cc by nd {_V}3(?: 0)?(?: unported)?
cc-by-sa-4.0 | cc | cc by sa 4 0 | cc by sa {_V}4(?: 0)?(?: international)?
cc-by-sa-3.0 | cc | cc by sa 3 0 | cc by sa {_V}3(?: 0)?(?: unported)?
cc-by-4.0 | cc | cc by 4 0 | cc by {_V}4(?: 0)?(?: international)?
cc-by-3.0 | cc | cc by 3 0 | cc by {_V}3(?: 0)?(?: unported)?
cc-by-nc-nd | attribution | - | (?:creative commons )?attribution noncommercial noderivatives(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc-sa | attribution | - | (?:creative commons )?attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc | attribution | - | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-sa | attribution | - | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nd | attribution | - | creative commons attribution no ?derivatives(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by | attribution | - | creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc-nd | cc | - | cc by nc nd
cc-by-nc-sa | cc | - | cc by nc sa
cc-by-nc | cc | - | cc by nc
cc-by-nd | cc | - | cc by nd
cc-by-sa | cc | - | cc by sa
creative-commons | creative | - | creative commons licen[cs]e
"""

# Passages: label | keyword | pattern.
_PASSAGES = r"""
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | permit | to permit persons to whom the software is furnished to do so subject to the following conditions
mit | portions | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit | merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
x11 | advertising | except as contained in this notice the names? of [^ ]+(?: [^ ]+){0,6} shall not be used in advertising or otherwise
apache-2.0 | compliance | you may not use (?:this|these) files? except in compliance with the license
apache-2.0 | asis | distributed under the license is distributed on an asis basis
apache-2.0 | basis | distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
apache-2.0 | grants | subject to the terms and conditions of this license each contributor hereby grants to you
gpl | redistribute | (?:this program|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | hope | this program is distributed in the hope that it will be useful but without any warranty
gpl | received | you should have received a copy of the gnu general public license along with this program
gpl | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | copyleft | the gnu general public license is a free copyleft license for software
lgpl | redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | hope | this library is distributed in the hope that it will be useful but without any warranty
lgpl | received | you should have received a copy of the gnu lesser general public license along with this (?:library|program)
agpl | received | you should have received a copy of the gnu affero general public license along with this program
agpl | interacting | all users interacting with it remotely through a computer network
gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | reproduce | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse | neither the names? of [^ ]+(?: [^ ]+){0,8} nor the names of (?:its|their|the) contributors may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | consequential | in no event shall the (?:copyright (?:holders?|owner)|regents)(?: or contributors)? be liable for any direct indirect incidental special exemplary or consequential damages
isc | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | disclaims | the software is provided as is and the author disclaims all warranties
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license
mpl-2.0 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license
epl | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license
epl | recipient | any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
cddl | development | the contents of this file are subject to the terms of the common development and distribution license
bsl-1.0 | boost | distributed under the boost software license
bsl-1.0 | machine | unless such copies or derivative works are solely in the form of machine executable object code
zlib | misrepresented | the origin of this software must not be misrepresented
zlib | plainly | altered source versions must be plainly marked as such
zlib | freely | alter it and redistribute it freely subject to the following restrictions
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | detriment | for the benefit of the public at large and to the detriment of our heirs and successors
public-domain | domain | (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
public-domain | domain | (?:this|the) (?:work|software|code|file|text|document|program) is (?:hereby )?(?:in|part of) the public domain
cc0-1.0 | waived | to the extent possible under law [^ ]+(?: [^ ]+){0,8} has waived all copyright and related or neighboring rights
wtfpl | fuck | do what the fuck you want to public license
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
json | evil | the software shall be used for good not evil
ofl-1.1 | sil | this font software is licensed under the sil open font license
ofl-1.1 | fonts | the fonts and derivatives however cannot be released under any other type of license
artistic-2.0 | artistic | this package is free software you can redistribute it and or modify it under the terms of the artistic license
artistic-1.0 | artistic | you may distribute (?:it )?under the terms of either the gnu general public license or the artistic license
perl | perl | this library is free software you can redistribute it and or modify it under the same terms as perl itself
python-2.0 | psf | psf is making python available to licensee on an as is basis
php-3.01 | php | this product includes php software freely available from
openssl | openssl | this product includes software developed by the openssl project
ncsa | illinois | the university of illinois(?: [^ ]+){0,4} nor the names of its contributors may be used to endorse
ms-pl | reproduction | the terms reproduce reproduction derivative works and distribution have the same meaning here as under u s copyright law
sspl-1.0 | service | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | managed | you may not provide the software to third parties as a hosted or managed service
busl-1.1 | production | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
cc-by | remix | you are free to share copy and redistribute the material in any medium or format(?: and)? adapt remix transform
cc-by-sa | contributions | if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc | commercial | you may not use the material for commercial purposes
cc-by-nd | modified | if you remix transform or build upon the material you may not distribute the modified material
proprietary | reserved | all rights reserved(?: no part of this [^ ]+ may be reproduced)? without (?:the )?(?:prior )?(?:written )?permission
proprietary | proprietary | (?:this software|this file|this document|the software) (?:is|contains) (?:the )?(?:confidential and )?proprietary(?: information)?
proprietary | unauthorized | unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|document|program)(?: [^ ]+){0,4} is strictly prohibited
commercial | commercial | (?:licensed|available|distributed) under (?:a|the) commercial licen[cs]e
"""

# The phrases asked for: label | keyword | pattern.
_BASE = """
mit | mit | mit license
apache | apache | apache license
gpl | general | general public license
"""

_UNDER = (
    "(?:(?:dual |re)?licen[cs]ed|released|distributed|available|published|provided|covered|governed|issued|offered|shared|redistributed|open sourced)"
    "(?: [^ ]+){0,3}? (?:under|by)(?: the)?(?: terms(?: and conditions)?)?(?: of)?(?: the| a| an)?(?: gnu)?"
)
#: What comes before an identifier: the tag itself, or the end of another identifier and a conjunction.
_ID = "(?:spdx licen[cs]e identifier|(?:0|1|2|3|only|later|clause|mit|isc|zlib|x11|ncsa|ruby|openssl) (?:or|and))"


def _table(text: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(" | ")] for line in text.strip().split("\n")]


def _rules() -> list[Rule]:
    licences = _table(_LICENCES)
    tags = [Rule(TAG, label, "spdx", f"{_ID} {tag}") for label, _, tag, _ in licences if tag != "-"]
    terms = [Rule(TERMS, *row) for row in _table(_PASSAGES)]
    notices = [Rule(NOTICE, label, keyword, f"{_UNDER} {name}") for label, keyword, _, name in licences]
    names = [Rule(NAME, label, keyword, name) for label, keyword, _, name in licences]
    return tags + terms + notices + names + [Rule(NAME, *row, True) for row in _table(_BASE)]


RULES = _rules()

_GROUP = re.compile(r"\((?:\?:)?[^()]*\)(?:[?*+]|\{[0-9,]+\})*")


def needs_licence(pattern: str) -> bool:
    """No words match without "license" or "licence": one of them stands in the pattern outside of all groups."""
    while _GROUP.search(pattern):
        pattern = _GROUP.sub("", pattern)
    return re.search(r"(?<![a-z])licen(?:\[cs\]|[cs])e(?![a-z])", pattern) is not None


KEYWORDS = sorted({r.keyword for r in RULES} | {"licence", "license"})
