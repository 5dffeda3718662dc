"""Signature rules of the license scan: fixed values, as text.

Patterns are written over lower-case words separated by one blank; they use
only groups, alternation and ``?``, so that Spark, Python and SQL engines
read them alike.  ``compiled`` turns each blank into the word border of the
scanned form.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    rule_id: int
    label: str
    tier: int
    score: float
    keyword: str
    pattern: str
    base: bool


# Tiers in order of priority, with the confidence of a detection.
BASE, TEXT, STATEMENT, MENTION = 0, 1, 2, 3
SCORES = {BASE: 1.0, TEXT: 0.95, STATEMENT: 0.85, MENTION: 0.5}

# Phrases that the scan always reports.  No phrase may overlap itself.
BASE_PHRASES = (
    ("mit", "license", "under the mit license"),
    ("apache-2", "license", "apache license version 2"),
    ("cc-by-nc", "nc", "cc by nc"),
)

# label | names (a pattern) | identifier as words
FAMILIES = """
mit | (mit|expat|x11)( open source)? licen[sc]e | mit
mit-0 | mit no attribution( licen[sc]e)? | mit 0
apache-1 | apache( software)? licen[sc]e( version)? 1( [01])? | apache 1 [01]
apache-2 | apache( software)? licen[sc]e( version| v)? (2|v2)( 0)? | apache 2 0
bsd-2 | (2 clause|two clause|simplified|freebsd) bsd( licen[sc]e)? | bsd 2 clause
bsd-3 | (3 clause|three clause|new|modified|revised) bsd( licen[sc]e)? | bsd 3 clause
bsd-4 | (4 clause|four clause|original) bsd( licen[sc]e)? | bsd 4 clause
bsd-0 | (0 clause|zero clause) bsd( licen[sc]e)? | 0bsd
bsd | bsd( style)? licen[sc]e | bsd
isc | (isc|internet systems consortium) licen[sc]e | isc
zlib | zlib( libpng)? licen[sc]e | zlib
gpl-1 | (gnu )?(general public licen[sc]e|gpl)( as published by the free software foundation)?( version)? (1|v1)( 0)? | gpl 1 0( only| or later)?
gpl-2 | (gnu )?(general public licen[sc]e|gpl)( as published by the free software foundation)?( version)? (2|v2)( 0)? | gpl 2 0( only| or later)?
gpl-3 | (gnu )?(general public licen[sc]e|gpl)( as published by the free software foundation)?( version)? (3|v3)( 0)? | gpl 3 0( only| or later)?
gpl | gnu (general public licen[sc]e|gpl) | gpl
lgpl-2 | (gnu )?(library|lesser) general public licen[sc]e( version)? (2|v2)( [01])? | lgpl 2 [01]( only| or later)?
lgpl-3 | (gnu )?lesser general public licen[sc]e( version)? (3|v3)( 0)? | lgpl 3 0( only| or later)?
lgpl | gnu (library|lesser) general public licen[sc]e | lgpl
agpl-3 | (gnu )?affero general public licen[sc]e( version)?( 3| v3)( 0)? | agpl 3 0( only| or later)?
agpl | (gnu )?affero general public licen[sc]e | agpl
fdl | gnu free documentation licen[sc]e | gfdl 1 [123]( only| or later)?
mpl-1 | mozilla public licen[sc]e( version| v)? 1( [01])? | mpl 1 [01]
mpl-2 | mozilla public licen[sc]e( version| v)? 2( 0)? | mpl 2 0
mpl | mozilla public licen[sc]e | mpl
epl-1 | eclipse public licen[sc]e( version| v)? 1( 0)? | epl 1 0
epl-2 | eclipse public licen[sc]e( version| v)? 2( 0)? | epl 2 0
cddl | common development and distribution licen[sc]e | cddl 1 [01]
cpl | common public licen[sc]e | cpl 1 0
artistic-1 | artistic licen[sc]e( version)? 1( 0)? | artistic 1 0
artistic-2 | artistic licen[sc]e( version)? 2( 0)? | artistic 2 0
bsl | boost software licen[sc]e | bsl 1 0
busl | business source licen[sc]e | busl 1 1
sspl | server side public licen[sc]e | sspl 1 0
elastic-2 | elastic licen[sc]e( version)?( 2| v2)?( 0)? | elastic 2 0
unlicense | (the )?unlicense( licen[sc]e)? | unlicense
wtfpl | do what the f[a-z]+ you want to public licen[sc]e | wtfpl
psf-2 | (psf|python software foundation) licen[sc]e | psf 2 0
php-3 | php licen[sc]e | php 3 0( 1)?
postgresql | postgresql licen[sc]e | postgresql
ofl | (sil )?open font licen[sc]e | ofl 1 [01]
odbl | open (data commons open )?database licen[sc]e | odbl 1 0
pddl | public domain dedication and licen[sc]e | pddl 1 0
eupl | european union public licen[sc]e | eupl 1 [012]
cecill | cecill( [abc])?( free software)? licen[sc]e | cecill 2 [01]
ms-pl | microsoft public licen[sc]e | ms pl
ms-rl | microsoft reciprocal licen[sc]e | ms rl
ncsa | (university of illinois )?ncsa( open source)? licen[sc]e | ncsa
osl-3 | open software licen[sc]e | osl 3 0
afl-3 | academic free licen[sc]e | afl 3 0
upl | universal permissive licen[sc]e | upl 1 0
w3c | w3c( software)?( notice and)? licen[sc]e | w3c
zpl | zope public licen[sc]e | zpl 2 [01]
openssl | openssl licen[sc]e | openssl
beerware | beer ware licen[sc]e | beerware
llama | llama [234]( [0-9])? community licen[sc]e( agreement)? | llama[234]
openrail | (creativeml )?open ?rail( m)? licen[sc]e | openrail
cc0 | (cc0|cc zero)( 1 0)?( universal)?( licen[sc]e)? | cc0 1 0
cc-by | creative commons attribution( [1234] 0)?( international| unported)? licen[sc]e | cc by [1234] [05]
cc-by-sa | creative commons attribution share ?alike( [1234] 0)?( international| unported)?( licen[sc]e)? | cc by sa [1234] [05]
cc-by-nd | creative commons attribution no ?deriv(s|atives)( [1234] 0)?( international| unported)?( licen[sc]e)? | cc by nd [1234] [05]
cc-by-nc | creative commons attribution non ?commercial( [1234] 0)?( international| unported)?( licen[sc]e)? | cc by nc [1234] [05]
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike( [1234] 0)?( international| unported)?( licen[sc]e)? | cc by nc sa [1234] [05]
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(s|atives)( [1234] 0)?( international| unported)?( licen[sc]e)? | cc by nc nd [1234] [05]
"""

# How a family is stated: tier | keyword | pattern around NAME or ID.
STATEMENTS = """
2 | under | (licensed|released|distributed|available|published|provided|issued) under (the )?(terms of )?(the )?NAME
2 | subject | subject to (the )?(terms of )?(the )?NAME
2 | governed | governed by (the )?(terms of )?(the )?NAME
2 | spdx | spdx license identifier ID
3 | NAMEWORD | NAME
"""

# Sentences that only occur in one license text: label | keyword | pattern.
FINGERPRINTS = """
mit | granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | warranty | the software is provided as is without warranty of any kind( express or implied)?
isc | granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistributions | redistributions of source code must retain the above copyright notice
bsd-3 | endorse | neither the name of( the)? [a-z0-9]+( [a-z0-9]+)? nor the names of its contributors may be used to endorse
zlib | misrepresented | the origin of this software must not be misrepresented
apache-2 | compliance | you may not use this file except in compliance with the license
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
unlicense | unencumbered | this is free and unencumbered software released into the public domain
bsl | processor | executable object code generated by a source language processor
mpl-2 | obtain | if a copy of the mpl was not distributed with this file you can obtain one at
ofl | font | this font software is licensed under the sil open font license
cc-by | credit | you must give appropriate credit provide a link to the license
public-domain | domain | (released|placed|dedicated) (in|into|to) the public domain
proprietary | reserved | all rights reserved
proprietary | confidential | proprietary and confidential
"""

# The scan looks closer at a text only where one of these stems starts a word.
GATE_STEMS = (
    "licen", "unlicen", "copyright", "redistribut", "spdx", "warrant", "granted", "unencumbered",
    "misrepresented", "noninfringement", "nc", "cc0", "mpl", "credit", "reserved", "proprietary",
    "domain", "endorse", "processor", "bsd", "gpl", "zero", "commons", "attribution",
)


def _rows(block: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(" | ")] for line in block.strip().splitlines()]


def _spellings(name: str) -> list[tuple[str, str]]:
    """The name as (keyword, pattern) pairs that together match what the name
    matches; every match of a pattern holds its keyword as a word."""
    always = re.sub(r"\([^()]*\)", "()", re.sub(r"\([^()]*\)\?", "", name))  # names have no nested groups
    words = re.sub(r"\S+ \?\S+", "", always).split()
    if "licen[sc]e" in words:
        return [(word, name.replace("licen[sc]e", word)) for word in ("license", "licence")]
    for word in ("bsd", "commons", "unlicense", "cc0", "attribution", "gpl", "zero"):
        if word in words:
            return [(word, name)]
    group = re.search(r"\(([^()]*\|[^()]*)\)(?!\?)", name)
    if not group:
        raise ValueError(f"no keyword in every match of {name!r}")
    return [s for way in group[1].split("|") for s in _spellings(name[: group.start()] + way + name[group.end() :])]


def rules() -> list[Rule]:
    """All rules in order; the place in the list is the rule id."""
    made: list[tuple] = [(label, BASE, word, pattern, True) for label, word, pattern in BASE_PHRASES]
    made += [(label, TEXT, word, pattern, False) for label, word, pattern in _rows(FINGERPRINTS)]
    for tier, word, frame in _rows(STATEMENTS):
        for label, name, ident in _rows(FAMILIES):
            if word != "NAMEWORD":
                made.append((label, int(tier), word, frame.replace("NAME", name).replace("ID", ident), False))
                continue
            made += [(label, int(tier), keyword, spelled, False) for keyword, spelled in _spellings(name)]
    return [
        Rule(i, label, tier, SCORES[tier], word, compiled(pattern), base)
        for i, (label, tier, word, pattern, base) in enumerate(made)
    ]


def compiled(pattern: str) -> str:
    """The pattern over the scanned form, where every word stands between
    two blanks of its own (`` w1  w2  w3 ``), so that a match takes whole
    words and neighbouring matches share no character."""
    return f" {pattern.replace(' ?', '( )?').replace(' ', '  ')} "
