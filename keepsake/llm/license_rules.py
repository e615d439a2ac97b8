"""Ordered signature rules of licenses, over normalised words.

Texts are matched as lower-case words joined by single blanks ("Apache-2.0"
reads ``apache 2 0``). Each line of ``SIGNATURES`` is written by hand:

    label ; name ; tag ; address ; notice

``name`` are the ways to name the license; ``tag`` its short identifier;
``address`` the words of its web address; ``notice`` a sentence of its text.
Empty fields give no rule. Every alternative of a field is a rule, with its
longest fixed run of letters as keyword; the order of :func:`rules` and the
priority decide between detections that contain each other.
"""

from __future__ import annotations

import re
from typing import Iterable, NamedTuple

GRANT = ("(?:licen[cs]ed|released|distributed|available|published|provided|issued|covered|offered|made available)"
         "(?: to you)? (?:under|by|according to|subject to)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? ")

SIGNATURES = r"""
mit ; mit licen[cs]e|mit style licen[cs]e|mit x11 licen[cs]e ; mit ; opensource org licenses mit
mit-0 ; mit no attribution(?: licen[cs]e)?|mit 0 licen[cs]e ; mit 0 ; opensource org licenses mit 0
expat ; expat licen[cs]e ; expat
x11 ; x11 licen[cs]e|x consortium licen[cs]e ; x11 ;  ; except as contained in this notice the name of the x consortium|x11 license notice
mit-text ;  ;  ;  ; permission is hereby granted free of charge to any person obtaining a copy
apache-2.0 ; apache (?:software )?licen[cs]e(?: version)?(?: v)? ?2(?: 0)?|apache 2(?: 0)? licen[cs]e ; apache 2 0 ; apache org licenses license 2 0(?: txt| html)? ; apache license version 2 0 january 2004
apache-1.1 ; apache (?:software )?licen[cs]e(?: version)?(?: v)? ?1 1 ; apache 1 1 ; apache org licenses license 1 1 ; this product includes software developed by the apache (?:software foundation|group)
apache-1.0 ; apache (?:software )?licen[cs]e(?: version)?(?: v)? ?1 0 ; apache 1 0 ; apache org licenses license 1 0
apache ; apache (?:software )?licen[cs]e ;  ; apache org licenses
gpl-1.0 ; (?:gnu )?(?:general public licen[cs]e|gpl)(?: version)?(?: v)? ?1(?: 0)? ; gpl 1 0(?: only| or later)? ; gnu org licenses (?:old licenses )?gpl 1 0
gpl-2.0 ; (?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? 2(?: 0)?|gplv2 ; gpl 2 0(?: only)? ; gnu org licenses (?:old licenses )?gpl 2 0 ; general public license as published by the free software foundation version 2
gpl-2.0-or-later ; (?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? 2(?: 0)? or (?:any )?later(?: version)?|gplv2 or later ; gpl 2 0 or later ;  ; either version 2 of the license or at your option any later version
gpl-3.0 ; (?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? 3(?: 0)?|gplv3 ; gpl 3 0(?: only)? ; gnu org licenses gpl 3 0 ; general public license as published by the free software foundation version 3
gpl-3.0-or-later ; (?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? 3(?: 0)? or (?:any )?later(?: version)?|gplv3 or later ; gpl 3 0 or later ;  ; either version 3 of the license or at your option any later version
gpl ; gnu general public licen[cs]e|general public licen[cs]e|gnu gpl ;  ; gnu org licenses gpl ; you should have received a copy of the gnu general public license
lgpl-2.0 ; (?:gnu )?(?:library general public licen[cs]e|lgpl)(?: version| v)? 2(?: 0)? ; lgpl 2 0(?: only| or later)? ; gnu org licenses (?:old licenses )?lgpl 2 0
lgpl-2.1 ; (?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? 2 1|lgplv2 1 ; lgpl 2 1(?: only| or later)? ; gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 ; (?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? 3(?: 0)?|lgplv3 ; lgpl 3 0(?: only| or later)? ; gnu org licenses lgpl 3 0
lgpl ; (?:gnu )?(?:lesser|library) general public licen[cs]e|gnu lgpl ;  ; gnu org licenses lgpl
agpl-3.0 ; (?:gnu )?(?:affero general public licen[cs]e|agpl)(?: version| v)? 3(?: 0)?|agplv3 ; agpl 3 0(?: only| or later)? ; gnu org licenses agpl 3 0
agpl ; (?:gnu )?affero general public licen[cs]e|gnu agpl ;  ; gnu org licenses agpl
gfdl-1.1 ; (?:gnu )?free documentation licen[cs]e(?: version| v)? 1 1 ; gfdl 1 1(?: only| or later)?
gfdl-1.2 ; (?:gnu )?free documentation licen[cs]e(?: version| v)? 1 2 ; gfdl 1 2(?: only| or later)? ; gnu org licenses (?:old licenses )?fdl 1 2
gfdl-1.3 ; (?:gnu )?free documentation licen[cs]e(?: version| v)? 1 3 ; gfdl 1 3(?: only| or later)? ; gnu org licenses fdl 1 3
gfdl ; (?:gnu )?free documentation licen[cs]e ;  ;  ; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
bsd-2-clause ; (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)? ; bsd 2 clause ; opensource org licenses bsd 2 clause
bsd-3-clause ; (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)? ; bsd 3 clause ; opensource org licenses bsd 3 clause
bsd-4-clause ; (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[cs]e)? ; bsd 4 clause ;  ; all advertising materials mentioning features or use of this software must display
bsd-0-clause ; (?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)? ; 0bsd ; opensource org licenses 0bsd
bsd ; bsd(?: style)? licen[cs]e|berkeley software distribution licen[cs]e ;  ; opensource org licenses bsd license
bsd-text ;  ;  ;  ; redistribution and use in source and binary forms with or without modification are permitted
isc ; isc licen[cs]e|internet systems consortium licen[cs]e ; isc ; opensource org licenses isc ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-1.0 ; mozilla public licen[cs]e(?: version| v)? 1 0 ; mpl 1 0 ; mozilla org mpl 1 0
mpl-1.1 ; (?:mozilla public licen[cs]e|mpl)(?: version| v)? 1 1 ; mpl 1 1 ; mozilla org mpl 1 1
mpl-2.0 ; (?:mozilla public licen[cs]e|mpl)(?: version| v)? 2(?: 0)? ; mpl 2 0 ; mozilla org mpl 2 0 ; this source code form is subject to the terms of the mozilla public license
mpl ; mozilla public licen[cs]e ;  ; mozilla org mpl ; the contents of this file are subject to the mozilla public license
epl-1.0 ; (?:eclipse public licen[cs]e|epl)(?: version| v)? 1(?: 0)? ; epl 1 0 ; eclipse org legal epl v10
epl-2.0 ; (?:eclipse public licen[cs]e|epl)(?: version| v)? 2(?: 0)? ; epl 2 0 ; eclipse org legal epl 2 0|eclipse org legal epl v20
epl ; eclipse public licen[cs]e ;  ; eclipse org legal ; this program and the accompanying materials are made available under the terms of the eclipse public license
edl-1.0 ; eclipse distribution licen[cs]e(?: version| v)?(?: 1 0)? ;  ; eclipse org org documents edl v10
cddl-1.0 ; (?:common development and distribution licen[cs]e|cddl)(?: version| v)? 1(?: 0)? ; cddl 1 0 ; opensource org licenses cddl 1 0
cddl-1.1 ; (?:common development and distribution licen[cs]e|cddl)(?: version| v)? 1 1 ; cddl 1 1
cddl ; common development and distribution licen[cs]e
cpl-1.0 ; common public licen[cs]e(?: version| v)?(?: 1 0)? ; cpl 1 0
eupl-1.1 ; (?:european union public licen[cs]e|eupl)(?: version| v)? 1 1 ; eupl 1 1
eupl-1.2 ; (?:european union public licen[cs]e|eupl)(?: version| v)? 1 2 ; eupl 1 2
eupl ; european union public licen[cs]e ;  ; joinup ec europa eu software page eupl
osl-3.0 ; open software licen[cs]e(?: version| v)?(?: 3 0)? ; osl 3 0 ; opensource org licenses osl 3 0
afl-3.0 ; academic free licen[cs]e(?: version| v)?(?: 3 0)? ; afl 3 0 ; opensource org licenses afl 3 0
artistic-1.0 ; artistic licen[cs]e(?: version| v)? 1(?: 0)? ; artistic 1 0
artistic-2.0 ; artistic licen[cs]e(?: version| v)? 2(?: 0)? ; artistic 2 0 ; opensource org licenses artistic 2 0
artistic ; artistic licen[cs]e|perl artistic licen[cs]e ;  ;  ; same terms as perl itself
boost-1.0 ; boost software licen[cs]e(?: version| v)?(?: 1 0)? ; bsl 1 0 ; boost org license 1 0 txt
zlib ; zlib licen[cs]e|zlib libpng licen[cs]e ; zlib
libpng ; libpng licen[cs]e ; libpng(?: 2 0)?
unlicense ; the unlicense|unlicense ; unlicense ; unlicense org
unlicense-text ;  ;  ;  ; this is free and unencumbered software released into the public domain
wtfpl ; wtfpl(?: version| v)?(?: 2)? ; wtfpl ; wtfpl net
public-domain ; (?:dedicated to|released into|placed in|in) the public domain ;  ;  ; public domain dedication
cc0-1.0 ; cc0(?: version)?(?: 1 0)?(?: universal)? ; cc0 1 0 ; creativecommons org publicdomain zero 1 0
cc0-name ; creative commons zero(?: v1 0)?(?: universal)?
cc-by-1.0 ; cc by 1 0 ; cc by 1 0 ; creativecommons org licenses by 1 0
cc-by-2.0 ; cc by 2 0 ; cc by 2 0 ; creativecommons org licenses by 2 0
cc-by-2.5 ; cc by 2 5 ; cc by 2 5 ; creativecommons org licenses by 2 5
cc-by-3.0 ; cc by 3 0|creative commons attribution 3 0(?: unported)? ; cc by 3 0 ; creativecommons org licenses by 3 0
cc-by-4.0 ; cc by 4 0|creative commons attribution 4 0(?: international)? ; cc by 4 0 ; creativecommons org licenses by 4 0
cc-by-sa-2.0 ; cc by sa 2 0 ; cc by sa 2 0 ; creativecommons org licenses by sa 2 0
cc-by-sa-2.5 ; cc by sa 2 5 ; cc by sa 2 5 ; creativecommons org licenses by sa 2 5
cc-by-sa-3.0 ; cc by sa 3 0|creative commons attribution sharealike 3 0(?: unported)? ; cc by sa 3 0 ; creativecommons org licenses by sa 3 0
cc-by-sa-4.0 ; cc by sa 4 0|creative commons attribution share ?alike 4 0(?: international)? ; cc by sa 4 0 ; creativecommons org licenses by sa 4 0
cc-by-nd-3.0 ; cc by nd 3 0 ; cc by nd 3 0 ; creativecommons org licenses by nd 3 0
cc-by-nd-4.0 ; cc by nd 4 0|creative commons attribution noderivatives 4 0(?: international)? ; cc by nd 4 0 ; creativecommons org licenses by nd 4 0
cc-by-nc-2.0 ; cc by nc 2 0 ; cc by nc 2 0 ; creativecommons org licenses by nc 2 0
cc-by-nc-3.0 ; cc by nc 3 0|creative commons attribution non ?commercial 3 0(?: unported)? ; cc by nc 3 0 ; creativecommons org licenses by nc 3 0
cc-by-nc-4.0 ; cc by nc 4 0|creative commons attribution non ?commercial 4 0(?: international)? ; cc by nc 4 0 ; creativecommons org licenses by nc 4 0
cc-by-nc-sa-3.0 ; cc by nc sa 3 0|creative commons attribution non ?commercial share ?alike 3 0(?: unported)? ; cc by nc sa 3 0 ; creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 ; cc by nc sa 4 0|creative commons attribution non ?commercial share ?alike 4 0(?: international)? ; cc by nc sa 4 0 ; creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0 ; cc by nc nd 3 0 ; cc by nc nd 3 0 ; creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0 ; cc by nc nd 4 0 ; cc by nc nd 4 0 ; creativecommons org licenses by nc nd 4 0
cc-by ; cc by(?: licen[cs]e)? ;  ; creativecommons org licenses by
cc-by-sa ; cc by sa(?: licen[cs]e)? ;  ; creativecommons org licenses by sa
cc-by-nc ; cc by nc(?: licen[cs]e)? ;  ; creativecommons org licenses by nc
cc ; creative commons(?: attribution)?(?: public)? licen[cs]e ;  ; creativecommons org licenses
odbl-1.0 ; open (?:data commons open )?database licen[cs]e(?: version| v)?(?: 1 0)? ; odbl 1 0 ; opendatacommons org licenses odbl
odc-by-1.0 ; open data commons attribution licen[cs]e(?: version| v)?(?: 1 0)? ; odc by 1 0 ; opendatacommons org licenses by
pddl-1.0 ; open data commons public domain dedication(?: and)?(?: licen[cs]e)? ; pddl 1 0 ; opendatacommons org licenses pddl
ofl-1.1 ; (?:sil )?open font licen[cs]e(?: version| v)?(?: 1 1)? ; ofl 1 1 ; scripts sil org ofl
python-2.0 ; python software foundation licen[cs]e(?: version)?(?: 2)?|psf licen[cs]e ; psf 2 0|python 2 0
php-3.01 ; php licen[cs]e(?: version| v)?(?: 3 01)? ; php 3 01 ; php net license
postgresql ; postgresql licen[cs]e ; postgresql ; opensource org licenses postgresql
openssl ; openssl licen[cs]e ; openssl ;  ; this product includes software developed by the openssl project
ruby ; ruby licen[cs]e ; ruby ; ruby lang org en about license
w3c ; w3c (?:software )?(?:notice and )?licen[cs]e ; w3c ; w3 org consortium legal
ms-pl ; microsoft public licen[cs]e ; ms pl ; opensource org licenses ms pl
ms-rl ; microsoft reciprocal licen[cs]e ; ms rl ; opensource org licenses ms rl
sspl-1.0 ; server side public licen[cs]e(?: version| v)?(?: 1)? ; sspl 1 0
busl-1.1 ; business source licen[cs]e(?: version| v)?(?: 1 1)? ; busl 1 1
ncsa ; university of illinois(?: ncsa)? open source licen[cs]e ; ncsa
ipl-1.0 ; ibm public licen[cs]e(?: version| v)?(?: 1 0)? ; ipl 1 0
qpl-1.0 ; q public licen[cs]e(?: version| v)?(?: 1 0)? ; qpl 1 0
upl-1.0 ; universal permissive licen[cs]e(?: version| v)?(?: 1 0)? ; upl 1 0
cecill-2.1 ; cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version| v)?(?: 2 1)? ; cecill 2 1 ; cecill info licences
beerware ; beer ?ware licen[cs]e ; beerware
json ; json licen[cs]e ; json ; json org license ; the software shall be used for good not evil
llama ; llama(?: 2| 3)? community licen[cs]e(?: agreement)?
openrail ; (?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[cs]e)? ; openrail
proprietary ; (?:proprietary|commercial) licen[cs]e|end user licen[cs]e agreement
"""


class Rule(NamedTuple):
    label: str
    priority: int               # 1 is strongest
    keyword: str
    pattern: str


#: Score of the strongest detection of a text, by priority.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.5}


def alternatives(field: str) -> list[str]:
    """The alternatives of a pattern: those outside of groups and those of
    groups that must match, so that each has a long fixed run."""
    out, depth = [""], 0
    for c in field:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    plain: list[str] = []
    for alt in filter(None, out):
        group = re.search(r"\(\?:([^()]*\|[^()]*)\)(?!\?)", alt)
        plain += [x for part in group[1].split("|") for x in alternatives(alt[:group.start()] + part + alt[group.end():])] \
            if group else [alt]
    return plain


def keyword(pattern: str) -> str:
    """The longest run of letters, digits and blanks that any match holds."""
    while pattern != (less := re.sub(r"\(\?:[^()]*\)\??", "~", pattern)):
        pattern = less
    runs = re.sub(r"\[[^]]*\]|.\?", "~", pattern).split("~")
    return max((r.strip() for r in runs), key=len)


def rules() -> list[Rule]:
    """All rules in order: tags and addresses first, then notices and grants,
    then names with a version, then bare names."""
    out: list[Rule] = []
    for line in SIGNATURES.strip().splitlines():
        label, name, tag, address, notice = [*(part.strip() for part in line.split(" ;")), "", "", "", ""][:5]
        versioned = 3 if re.search(r"-\d", label) else 4
        for alt in alternatives(tag):
            out.append(Rule(label, 1, "spdx", f"spdx license identifier {alt}"))
        for field, priority in ((address, 1), (notice, 2), (name, versioned)):
            out += [Rule(label, priority, keyword(alt), alt) for alt in alternatives(field)]
        out += [Rule(label, 2, keyword(alt), GRANT + alt) for alt in alternatives(name)]
    return sorted(out, key=lambda r: r.priority)


def shortest(words: Iterable[str]) -> list[str]:
    """The words that hold no other: a text holds one of ``words`` just when it holds one of these."""
    out: list[str] = []
    for w in sorted(set(words), key=lambda w: (len(w), w)):
        if not any(o in w for o in out):
            out.append(w)
    return out


#: A text without one of these holds no keyword, so no rule can match it.
TRIGGERS = tuple(shortest(r.keyword for r in rules()))
