"""License scan by ordered signature rules.

Rules are hand-written regular expressions over the normalised words of a text.  Each is gated by
keywords, strings taken from the expression that every match of it holds: one automaton finds which
keywords a text holds, and only rules whose keywords are all there run.  Detections are word intervals.
One that lies within another of higher priority, or within a longer one of the same priority, is
suppressed; equal intervals leave the higher priority, then the earlier rule.

Rules see lower-case words joined by single spaces, so punctuation and line breaks do not matter:
``Apache License, Version 2.0`` reads ``apache license version 2 0``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as regex

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.words import slices

SHORTEST = 3  # keywords of fewer characters select nothing

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label | name | identifiers (- for none) | page
LICENSES = """
agpl-3.0 | (?:gnu )?affero general public licen[sc]e(?: agpl)?(?: version| v)? ?3(?: 0)? | agpl 3 0;agplv3 | gnu org licenses agpl(?: 3 0)?
agpl-1.0 | affero general public licen[sc]e(?: version| v)? ?1(?: 0)? | agpl 1 0 | affero org oagpl
agpl | (?:gnu )?affero general public licen[sc]e | agpl | gnu org licenses agpl
gpl-3.0 | gnu general public licen[sc]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)? | gpl 3 0;gplv3 | gnu org licenses gpl 3 0
gpl-2.0 | gnu general public licen[sc]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2(?: 0)? | gpl 2 0;gplv2 | gnu org licenses(?: old licenses)? gpl 2 0
gpl-1.0 | gnu general public licen[sc]e(?: gpl)?(?: version| v) ?1(?: 0)? | gpl 1 0;gplv1 | gnu org licenses(?: old licenses)? gpl 1 0
lgpl-3.0 | gnu lesser general public licen[sc]e(?: lgpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)? | lgpl 3 0;lgplv3 | gnu org licenses lgpl 3 0
lgpl-2.1 | gnu lesser general public licen[sc]e(?: lgpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2 1 | lgpl 2 1;lgplv2 1 | gnu org licenses(?: old licenses)? lgpl 2 1
lgpl-2.0 | gnu library general public licen[sc]e(?:(?: version| v) ?2(?: 0)?)? | lgpl 2 0;lgplv2 | gnu org licenses(?: old licenses)? lgpl 2 0
lgpl | (?:gnu )?lesser general public licen[sc]e | lgpl | gnu org licenses lgpl
gfdl-1.3 | gnu free documentation licen[sc]e(?: version| v)? ?1 3 | gfdl 1 3 | gnu org licenses fdl 1 3
gfdl-1.2 | gnu free documentation licen[sc]e(?: version| v)? ?1 2 | gfdl 1 2 | gnu org licenses(?: old licenses)? fdl 1 2
gfdl | gnu free documentation licen[sc]e | gfdl | gnu org copyleft fdl
apache-2.0 | apache(?: software)? licen[sc]e(?: version| v)? ?2(?: 0)? | apache 2 0;apache2 | apache org licenses license 2 0
apache-1.1 | apache(?: software)? licen[sc]e(?: version| v)? ?1 1 | apache 1 1 | apache org licenses license 1 1
apache-1.0 | apache(?: software)? licen[sc]e(?: version| v)? ?1 0 | apache 1 0 | apache org licenses license 1 0
mit | (?:the )?(?:mit|expat) licen[sc]e(?: mit)? | mit;expat | opensource org licenses mit
mit-0 | mit no attribution(?: licen[sc]e)? | mit 0 | github com aws mit 0
x11 | (?:mit )?x11 licen[sc]e | x11 | xfree86 org 3 3 6 copyright2
bsd-4-clause | (?:original|old|4 clause|four clause) bsd licen[sc]e | bsd 4 clause | opensource org licenses bsd 4 clause
bsd-3-clause | (?:new|revised|modified|3 clause|three clause) bsd licen[sc]e | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-2-clause | (?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-0-clause | (?:zero clause bsd(?: licen[sc]e)?|bsd zero clause licen[sc]e|0 clause bsd licen[sc]e) | 0bsd | opensource org licenses 0bsd
bsd | (?:berkeley software distribution|bsd) (?:style )?licen[sc]e | bsd | opensource org licenses bsd license
isc | (?:the )?isc licen[sc]e | isc | opensource org licenses isc
ncsa | university of illinois ncsa open source licen[sc]e | ncsa | opensource org licenses ncsa
mpl-2.0 | mozilla public licen[sc]e(?: mpl)?(?: version| v)? ?2(?: 0)? | mpl 2 0;mplv2 | mozilla org(?: en us)? mpl 2 0
mpl-1.1 | mozilla public licen[sc]e(?: mpl)?(?: version| v)? ?1 1 | mpl 1 1 | mozilla org(?: en us)? mpl 1 1
mpl-1.0 | mozilla public licen[sc]e(?: mpl)?(?: version| v)? ?1 0 | mpl 1 0 | mozilla org mpl mpl 1 0
mpl | mozilla public licen[sc]e | mpl | mozilla org mpl
epl-2.0 | eclipse public licen[sc]e(?: epl)?(?: version| v)? ?2(?: 0)? | epl 2 0 | eclipse org legal epl 2 0
epl-1.0 | eclipse public licen[sc]e(?: epl)?(?: version| v)? ?1(?: 0)? | epl 1 0 | eclipse org legal epl v10
edl-1.0 | eclipse distribution licen[sc]e(?: version| v)? ?1 0 | edl 1 0 | eclipse org org documents edl v10
cddl-1.1 | common development and distribution licen[sc]e(?: cddl)?(?: version| v)? ?1 1 | cddl 1 1 | glassfish java net public cddl gpl 1 1
cddl-1.0 | common development and distribution licen[sc]e(?: cddl)?(?:(?: version| v)? ?1 0)? | cddl 1 0;cddl | opensource org licenses cddl 1 0
cpl-1.0 | common public licen[sc]e(?: version| v)? ?1 0 | cpl 1 0 | opensource org licenses cpl 1 0
cpal-1.0 | common public attribution licen[sc]e(?: version| v)? ?1 0 | cpal 1 0 | opensource org licenses cpal 1 0
ipl-1.0 | ibm public licen[sc]e(?:(?: version| v)? ?1 0)? | ipl 1 0 | opensource org licenses ibmpl
apsl-2.0 | apple public source licen[sc]e(?:(?: version| v)? ?2 0)? | apsl 2 0 | opensource apple com license apsl
artistic-2.0 | (?:the )?artistic licen[sc]e(?: version| v)? ?2(?: 0)? | artistic 2 0 | opensource org licenses artistic license 2 0
artistic-1.0 | (?:the )?(?:perl )?artistic licen[sc]e(?:(?: version| v)? ?1 0)? | artistic 1 0 | opensource org licenses artistic license 1 0
bsl-1.0 | boost software licen[sc]e(?:(?: version| v)? ?1 0)? | bsl 1 0 | boost org license 1 0
busl-1.1 | business source licen[sc]e(?:(?: version| v)? ?1 1)? | busl 1 1 | mariadb com bsl11
elastic-2.0 | elastic licen[sc]e(?: version| v)? ?2(?: 0)? | elastic 2 0 | elastic co licensing elastic license
sspl-1.0 | server side public licen[sc]e(?:(?: version| v)? ?1)? | sspl 1 0 | mongodb com licensing server side public license
zlib | (?:the )?zlib(?: libpng)? licen[sc]e | zlib | zlib net zlib license
libpng | (?:the )?libpng licen[sc]e | libpng | libpng org pub png src libpng license
unlicense | (?:the )?unlicense | unlicense | unlicense org
wtfpl | do what the f\\w* you want to public licen[sc]e | wtfpl | wtfpl net
cc0-1.0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
pddl-1.0 | public domain dedication and licen[sc]e | pddl 1 0 | opendatacommons org licenses pddl
odbl-1.0 | open (?:data commons )?open database licen[sc]e | odbl 1 0;odbl | opendatacommons org licenses odbl
odc-by-1.0 | open data commons attribution licen[sc]e | odc by 1 0 | opendatacommons org licenses by
cdla-permissive-2.0 | community data licen[sc]e agreement permissive(?:(?: version)? 2 0)? | cdla permissive 2 0 | cdla dev permissive 2 0
cdla-sharing-1.0 | community data licen[sc]e agreement sharing(?:(?: version)? 1 0)? | cdla sharing 1 0 | cdla dev sharing 1 0
cc-by-4.0 | creative commons attribution(?: licen[sc]e)? 4 0(?: international)? | cc by 4 0 | creativecommons org licenses by 4 0
cc-by-3.0 | creative commons attribution(?: licen[sc]e)? 3 0(?: unported)? | cc by 3 0 | creativecommons org licenses by 3 0
cc-by-2.5 | creative commons attribution(?: licen[sc]e)? 2 5(?: generic)? | cc by 2 5 | creativecommons org licenses by 2 5
cc-by-2.0 | creative commons attribution(?: licen[sc]e)? 2 0(?: generic)? | cc by 2 0 | creativecommons org licenses by 2 0
cc-by-sa-4.0 | creative commons attribution sharealike(?: licen[sc]e)? 4 0(?: international)? | cc by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creative commons attribution sharealike(?: licen[sc]e)? 3 0(?: unported)? | cc by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-sa-2.0 | creative commons attribution sharealike(?: licen[sc]e)? 2 [05](?: generic)? | cc by sa 2 0;cc by sa 2 5 | creativecommons org licenses by sa 2 [05]
cc-by-nc-4.0 | creative commons attribution noncommercial(?: licen[sc]e)? 4 0(?: international)? | cc by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | creative commons attribution noncommercial(?: licen[sc]e)? 3 0(?: unported)? | cc by nc 3 0 | creativecommons org licenses by nc 3 0
cc-by-nd-4.0 | creative commons attribution noderivatives(?: licen[sc]e)? 4 0(?: international)? | cc by nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | creative commons attribution noncommercial sharealike(?: licen[sc]e)? 4 0(?: international)? | cc by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 | creative commons attribution noncommercial sharealike(?: licen[sc]e)? 3 0(?: unported)? | cc by nc sa 3 0 | creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4.0 | creative commons attribution noncommercial noderivatives(?: licen[sc]e)? 4 0(?: international)? | cc by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
cc-by-sa | creative commons attribution share ?alike(?: licen[sc]e)? | cc by sa | creativecommons org licenses by sa
cc-by-nc | creative commons attribution non ?commercial(?: licen[sc]e)? | cc by nc | creativecommons org licenses by nc
cc-by-nd | creative commons attribution no ?deriv(?:ative)?s(?: licen[sc]e)? | cc by nd | creativecommons org licenses by nd
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike(?: licen[sc]e)? | cc by nc sa | creativecommons org licenses by nc sa
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[sc]e)? | cc by nc nd | creativecommons org licenses by nc nd
cc-by | creative commons attribution(?: licen[sc]e)? | - | creativecommons org licenses by
eupl-1.2 | european union public licen[sc]e(?: eupl)?(?: version| v)? ?1 2 | eupl 1 2 | joinup ec europa eu (?:collection eupl|software page eupl)
eupl-1.1 | european union public licen[sc]e(?: eupl)?(?: version| v)? ?1 1 | eupl 1 1 | ec europa eu idabc eupl
cecill-2.1 | cecill (?:free software )?licen[sc]e(?: agreement)?(?:(?: version| v)? ?2 1)? | cecill 2 1 | cecill info licences licence cecill v2 1
cecill-b | cecill b licen[sc]e | cecill b | cecill info licences licence cecill b
cecill-c | cecill c licen[sc]e | cecill c | cecill info licences licence cecill c
ms-pl | microsoft public licen[sc]e(?: ms pl)? | ms pl | opensource org licenses ms pl
ms-rl | microsoft reciprocal licen[sc]e(?: ms rl)? | ms rl | opensource org licenses ms rl
ofl-1.1 | (?:sil )?open font licen[sc]e(?:(?: version| v)? ?1 1)? | ofl 1 1 | scripts sil org ofl
osl-3.0 | open software licen[sc]e(?:(?: version| v)? ?3 0)? | osl 3 0 | opensource org licenses osl 3 0
afl-3.0 | academic free licen[sc]e(?:(?: version| v)? ?3 0)? | afl 3 0 | opensource org licenses afl 3 0
psf-2.0 | (?:python software foundation|psf) licen[sc]e(?: agreement)?(?:(?: version)? ?2)? | psf 2 0;python 2 0 | docs python org 3 license
php-3.01 | (?:the )?php licen[sc]e(?:(?: version| v)? ?3 01)? | php 3 01 | php net license 3 01
ruby | (?:the )?ruby licen[sc]e | ruby | ruby lang org en about license
postgresql | (?:the )?postgresql licen[sc]e | postgresql | postgresql org about licence
openssl | (?:the )?openssl licen[sc]e | openssl | openssl org source license
w3c | w3c software (?:notice and )?licen[sc]e | w3c | w3 org consortium legal 2015 copyright software and document
vim | (?:the )?vim licen[sc]e | vim | vimhelp org uganda txt
zpl-2.1 | zope public licen[sc]e(?: zpl)?(?:(?: version| v)? ?2 1)? | zpl 2 1 | old zope org resources license zpl 2 1
lppl-1.3c | latex project public licen[sc]e(?:(?: version| v)? ?1 3c?)? | lppl 1 3c | latex project org lppl
ecl-2.0 | educational community licen[sc]e(?:(?: version| v)? ?2 0)? | ecl 2 0 | opensource org licenses ecl 2 0
upl-1.0 | universal permissive licen[sc]e(?:(?: version| v)? ?1 0)? | upl 1 0 | oss oracle com licenses upl
beerware | (?:the )?beer ?ware licen[sc]e | beerware | people freebsd org phk
blueoak-1.0.0 | blue oak model licen[sc]e(?:(?: version)? 1 0 0)? | blueoak 1 0 0 | blueoakcouncil org license 1 0 0
mulan-psl-2.0 | mulan permissive software licen[sc]e(?:(?: version| v)? ?2)? | mulanpsl 2 0 | license coscl org cn mulanpsl2
ogl-uk-3.0 | open government licen[sc]e(?:(?: version| v)? ?3 0)? | ogl uk 3 0 | nationalarchives gov uk doc open government licence
openrail-m | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[sc]e)? | openrail;openrail m | huggingface co spaces bigscience license
"""

#: label | characteristic phrase | priority; the higher the number, the more the phrase says.
PHRASES = """
mit | permission is hereby granted free of charge to any person obtaining a copy of this software | 8
mit | the above copyright notice and this permission notice shall be included in all copies | 7
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | 8
bsd | redistribution and use in source and binary forms with or without modification are permitted | 7
bsd-3-clause | may be used to endorse or promote products derived from this software without specific prior written permission | 8
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledg?ement | 8
bsd-2-clause | redistributions in binary form must reproduce the above copyright notice | 6
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable | 7
zlib | the origin of this software must not be misrepresented | 7
gpl-3.0-or-later | gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version | 9
gpl-2.0-or-later | gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version | 9
lgpl-3.0-or-later | gnu lesser general public licen[sc]e as published by the free software foundation either version 3(?: 0)? of the licen[sc]e or at your option any later version | 9
lgpl-2.1-or-later | gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version | 9
agpl-3.0-or-later | gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version | 9
gpl | you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e | 8
gpl | see the gnu general public licen[sc]e for more details | 7
gpl | you should have received a copy of the gnu general public licen[sc]e | 7
lgpl | you should have received a copy of the gnu lesser general public licen[sc]e | 8
agpl | you should have received a copy of the gnu affero general public licen[sc]e | 8
apache-2.0 | licensed under the apache licen[sc]e version 2 0 | 9
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e | 7
apache-2.0 | you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at http www apache org | 9
mpl-2.0 | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0 | 9
mpl-1.1 | the contents of this file are subject to the mozilla public licen[sc]e version 1 1 | 9
epl-2.0 | made available under the terms of the eclipse public licen[sc]e 2 0 | 9
epl-1.0 | made available under the terms of the eclipse public licen[sc]e v1 0 | 9
bsl-1.0 | distributed under the boost software licen[sc]e version 1 0 | 9
unlicense | this is free and unencumbered software released into the public domain | 9
public-domain | (?:released|placed|dedicated) (?:in|into|to) the public domain | 6
public-domain | this (?:work|file|software|text) is in the public domain | 6
public-domain | hereby dedicates? (?:this work|the work|all copyright) to the public domain | 6
cc0-1.0 | has waived all copyright and related or neighboring rights | 8
cc-by-sa | text is available under the creative commons attribution sharealike licen[sc]e | 8
creative-commons | licensed under a creative commons | 4
creative-commons | creative commons licen[sc]e | 3
ofl-1.1 | this font software is licensed under the sil open font licen[sc]e | 9
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document and changing it is allowed | 8
gpl | everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed | 6
artistic-1.0 | under the same terms as perl itself | 7
ruby | under the same terms as ruby itself | 7
proprietary | all rights reserved | 2
proprietary | proprietary and confidential | 5
proprietary | unauthorized (?:copying|use|reproduction|distribution) of this (?:file|material|software|document|work) | 5
proprietary | may not be reproduced (?:in any form )?without (?:the )?(?:prior )?(?:written )?permission | 5
proprietary | this (?:software|product) is licensed not sold | 5
proprietary | end user licen[sc]e agreement | 4
free-unknown | (?:may be|can be) (?:freely )?(?:redistributed|distributed|copied) freely | 3
free-unknown | this (?:program|library|software|package) is free software | 3
non-commercial | for non ?commercial (?:use|purposes) only | 4
non-commercial | not for commercial (?:use|purposes) | 4
research-only | for (?:academic |scientific )?research (?:use|purposes) only | 4
openrail-m | responsible ai licen[sc]e | 6
license-reference | see (?:the )?(?:accompanying )?(?:file )?licen[sc]e(?: txt| md| file)? for (?:more )?(?:details|information|terms) | 2
license-reference | (?:licensed|released|distributed) under the (?:terms of the )?licen[sc]e | 1
"""


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    priority: int
    weight: float

    @property
    def keywords(self) -> tuple[tuple[str, ...], ...]:
        """The strings that select best; each stands as a tuple of alternatives, one of which is needed."""
        least = {x: min(len(word.strip()) for word in x) for x in required(regex.parse(f" {self.pattern} "))}
        return tuple(sorted((x for x in least if least[x] >= SHORTEST), key=lambda x: (-least[x], x))[:2])


def required(tree) -> list[tuple[str, ...]]:
    """Tuples of strings of which every match of a parsed expression holds at least one each.

    Literals in a row make one string; what may be left out, a set of characters or anything unknown
    ends it.  Of a branch each alternative gives its longest string.
    """
    found, run = [], ""
    for op, value in tree:
        if op is regex.LITERAL:
            run += chr(value)
            continue
        found, run = found + [(run,)] * bool(run), ""
        if op is regex.SUBPATTERN and not (value[1] or value[2]):
            found += required(value[3])
        elif op in (regex.MAX_REPEAT, regex.MIN_REPEAT) and value[0] >= 1:
            found += required(value[2])
        elif op is regex.BRANCH:
            ways = [max(required(way), key=lambda x: min(map(len, x)), default=("",)) for way in value[1]]
            if all(all(x) for x in ways):
                found.append(tuple(sorted({word for x in ways for word in x})))
    return found + [(run,)] * bool(run)


def hand_written() -> list[Rule]:
    """The rules in their order: names, identifiers and pages of licenses, then phrases."""
    rules = []
    for line in LICENSES.strip().splitlines():
        label, name, identifiers, page = (x.strip() for x in line.split(" | "))
        rules.append(Rule(label, name.replace("\\\\", "\\"), 5, 0.9))
        for identifier in identifiers.split(";") if identifiers != "-" else ():
            rules.append(Rule(label, f"spdx license identifier {identifier}(?: only)?", 10, 1.0))
            rules.append(Rule(f"{label}-or-later", f"spdx license identifier {identifier} or later", 11, 1.0))
            rules.append(Rule(label, f"licen[sc]ed? (?:under |as |type )?(?:the )?{identifier}", 4, 0.8))
        rules.append(Rule(label, page, 6, 0.95))
    for line in PHRASES.strip().splitlines():
        label, phrase, priority = (x.strip() for x in line.split(" | "))
        rules.append(Rule(label, phrase, int(priority), min(0.95, 0.35 + 0.07 * int(priority))))
    return rules


def suppress(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Detections (start, end, priority, rule) without those within one of no lower priority."""
    kept: list[tuple[int, int, int, int]] = []
    open_: list[tuple[int, int, int, int]] = []
    for one in sorted(set(found), key=lambda d: (d[0], -d[1], -d[2], d[3])):
        open_ = [d for d in open_ if d[1] > one[0]]
        # whatever holds this interval came before it: it starts no later and, if at once, ends no earlier
        if not any(d[1] >= one[1] and d[2] >= one[2] for d in open_):
            kept.append(one)
            open_.append(one)
    return kept


class Scanner:
    def __init__(self, rules: list[Rule], base: dict[str, str] = BASE):
        self.rules, self.base = rules, base
        self.patterns = [re.compile(f"(?<= ){rule.pattern}(?= )") for rule in rules]
        keywords = [rule.keywords for rule in rules]
        self.keywords = sorted({word for needs in keywords for ways in needs for word in ways})
        numbers = {word: number for number, word in enumerate(self.keywords)}
        self.needs = [[frozenset(numbers[word] for word in ways) for ways in needs] for needs in keywords]
        self.always = [number for number, needs in enumerate(self.needs) if not needs]
        self.by_word: dict[int, list[int]] = {}
        for number, needs in enumerate(self.needs):
            for word in needs[0] if needs else ():
                self.by_word.setdefault(word, []).append(number)
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def gate(self, text: str) -> list[int]:
        """Rules whose keywords all stand in the text, and rules that have none."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for number, word in enumerate(self.keywords):
                self.automaton.add_word(word, number)
            self.automaton.make_automaton()
        seen = {number for _, number in self.automaton.iter(text)}
        near = {r for word in seen for r in self.by_word.get(word, ())}
        return self.always + [r for r in near if all(not ways.isdisjoint(seen) for ways in self.needs[r])]

    def scan(self, raw: bytes) -> dict:
        text = " " + re.sub(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", b" ", raw.lower()).decode("latin-1").strip(" ") + " "
        n_words = text.count(" ") - 1 if len(text) > 2 else 0
        places: list[tuple[int, str]] = []
        for phrase, label in self.base.items():
            at, word, before = text.find(f" {phrase} "), 0, 0
            while at >= 0:
                word, before = word + text.count(" ", before, at), at
                places.append((word, label))
                at = text.find(f" {phrase} ", at + 1)
        found = []
        for number in sorted(self.gate(text)):
            word, before = -1, 0
            for match in self.patterns[number].finditer(text):
                word, before = word + text.count(" ", before, match.start()), match.start()
                found.append((word, word + 1 + match.group().count(" "), self.rules[number].priority, number))
        left = suppress(found)
        base = sorted({label for _, label in places})
        labels = sorted({self.rules[d[3]].label for d in left} | set(base))
        score = max([self.rules[d[3]].weight for d in left] + [0.6] * bool(places), default=0.0)
        spots = [word for word, _ in places]
        return {"n_words": n_words, "n_base": len(places), "first_word": min(spots, default=None),
                "last_word": max(spots, default=None), "base_labels": ",".join(base), "labels": ",".join(labels),
                "score": score,
                "detections": [{"start": s, "end": e, "label": self.rules[r].label, "rule": r} for s, e, _, r in left]}


RESULT = ("struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string,"
          " labels: string, score: double, detections: array<struct<start: bigint, end: bigint, label: string, rule: int>>>")
ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("detections", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.int32())])))])


def scan_column(rules: list[Rule]):
    scanner = Scanner(rules)

    @F.arrow_udf(RESULT)
    def scan(column: pa.Array) -> pa.Array:
        return pa.array([scanner.scan(x or b"") for part in slices(column) for x in part.to_pylist()], ARROW)

    return scan


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's base phrases, labels and ``detections`` (word intervals; numbers of rules).

    A null or empty text has no words and no label.  Labels are distinct and sorted.  Repeated rows are
    scanned one by one; other columns are ignored.
    """
    found = scan_column(hand_written() if rules is None else rules)(F.col(text).cast("string").cast("binary"))
    return docs.select(F.col(doc_id).alias("doc_id"), found.alias("f")).select("doc_id", "f.*")


def op5(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs).drop("detections")
