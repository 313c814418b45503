"""Signatures of licenses: ordered rules, each a regular expression over words with the keywords that must be present for it to match.

A signature is written as words. ``a|b`` stands for either, ``[a]`` for an optional word, ``~n`` for up to n words of any kind. Every name below gives
three rules: its identifier tag, its mention in a grant ("licensed under ..."), and the bare name; GNU and Creative Commons names are spelled out for
all their versions. Texts of grants and addresses have rules of their own. A lower priority number wins.
"""

from __future__ import annotations

from typing import NamedTuple

TAG, GRANT, NAME, HINT = 0, 1, 2, 3
WEIGHT = {TAG: 1.0, GRANT: 0.95, NAME: 0.8, HINT: 0.5}
BASE_WEIGHT = 0.6
LICENSE = "license|licence"


class Rule(NamedTuple):
    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    pattern: str


#: Names as they are written, after the identifier they stand for; ``/`` parts spellings of one name.
NAMES = """
mit: mit license|licence / expat license|licence / mit x11 license|licence
mit-0: mit no attribution [license|licence]
apache-1.1: apache [software] license|licence [version|v] 1 1
apache-2.0: apache [software] license|licence [version|v] 2 0 / apache [software] license|licence version|v 2 / apache 2 0
bsd-2-clause: bsd 2 clause / 2|two clause bsd / simplified bsd license|licence / freebsd license|licence
bsd-3-clause: bsd 3 clause / 3|three clause bsd / new|modified|revised bsd license|licence
bsd-4-clause: bsd 4 clause / 4|four clause bsd / original bsd license|licence
0bsd: 0bsd / zero clause bsd / bsd zero clause
bsd: bsd license|licence / bsd style license|licence
isc: isc license|licence / internet systems consortium license|licence
zlib: zlib license|licence / zlib libpng license|licence
libpng: libpng license|licence / png reference library license|licence
mpl-1.1: mozilla public license|licence [version|v] 1 1 / mpl 1 1
mpl-2.0: mozilla public license|licence [version|v] 2 0 / mpl 2 0 / mozilla public license|licence version|v 2
epl-1.0: eclipse public license|licence [version|v] 1 0 / epl 1 0
epl-2.0: eclipse public license|licence [version|v] 2 0 / epl 2 0
edl-1.0: eclipse distribution license|licence [version|v] 1 0
cddl-1.0: common development and distribution license|licence [version|v] 1 0 / cddl 1 0
cddl-1.1: common development and distribution license|licence [version|v] 1 1 / cddl 1 1
cpl-1.0: common public license|licence [version|v] 1 0
ipl-1.0: ibm public license|licence [version|v] 1 0
artistic-1.0: artistic license|licence [version|v] 1 0
artistic-2.0: artistic license|licence [version|v] 2 0
bsl-1.0: boost software license|licence [version|v] 1 0 / boost software license|licence
busl-1.1: business source license|licence [version|v] 1 1 / busl 1 1
sspl-1.0: server side public license|licence / sspl [version|v] 1
elastic-2.0: elastic license|licence [version|v] 2 0 / elastic license|licence 2
commons-clause: commons clause license|licence condition / commons clause
unlicense: the unlicense / unlicense
wtfpl: wtfpl / do what the fuck you want to public license|licence
ms-pl: microsoft public license|licence / ms pl
ms-rl: microsoft reciprocal license|licence / ms rl
eupl-1.1: european union public license|licence [version|v] 1 1 / eupl [version|v] 1 1
eupl-1.2: european union public license|licence [version|v] 1 2 / eupl [version|v] 1 2
ofl-1.1: sil open font license|licence / open font license|licence [version|v] 1 1
odbl-1.0: open database license|licence / odbl [version|v] 1 0 / odbl
odc-by-1.0: open data commons attribution license|licence / odc by
pddl-1.0: public domain dedication and license|licence / pddl
psf-2.0: python software foundation license|licence / psf license|licence
cnri-python: cnri python license|licence / cnri open source license|licence agreement
ruby: ruby license|licence
php-3.01: php license|licence [version|v] [3] [01]
postgresql: postgresql license|licence
openssl: openssl license|licence
vim: vim license|licence
zpl-2.1: zope public license|licence [version|v] [2] [1]
ncsa: university of illinois ncsa open source license|licence / ncsa license|licence
afl-3.0: academic free license|licence [version|v] 3 0
osl-3.0: open software license|licence [version|v] 3 0
apsl-2.0: apple public source license|licence
lppl-1.3c: latex project public license|licence / lppl [version|v] 1 3c
qpl-1.0: q public license|licence
rpl-1.5: reciprocal public license|licence
ecl-2.0: educational community license|licence
upl-1.0: universal permissive license|licence
mulanpsl-2.0: mulan permissive software license|licence / mulan psl
cecill-2.1: cecill [version|v] 2 1 / cecill free software license|licence agreement
cecill-b: cecill b
cecill-c: cecill c
beerware: beerware license|licence / beer ware license|licence
json: json license|licence
curl: curl license|licence
hpnd: historical permission notice and disclaimer
w3c: w3c software notice and license|licence / w3c license|licence
blueoak-1.0.0: blue oak model license|licence
openrail: responsible ai license|licence / openrail m / openrail
llama: llama ~3 community license|licence
gpl: gnu gpl
lgpl: gnu lgpl
agpl: gnu agpl
"""

#: Phrases of grants and notices, and addresses that stand for one license.
TEXTS = """
mit: permission is hereby granted free of charge to any person obtaining a copy
mit: opensource org licenses mit
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd: redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause: opensource org licenses bsd 3 clause
bsd-2-clause: opensource org licenses bsd 2 clause
bsd-3-clause: neither the name of ~12 nor the names of its contributors may be used
apache-2.0: apache org licenses license 2 0
apache-2.0: you may not use this file except in compliance with the license
bsl-1.0: boost org license 1 0
mpl-2.0: this source code form is subject to the terms of the mozilla public license
mpl-2.0: mozilla org mpl 2 0
gpl: gnu org licenses gpl
lgpl: gnu org licenses lgpl
agpl: gnu org licenses agpl
gfdl: gnu org licenses fdl
unlicense: this is free and unencumbered software released into the public domain
zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable
ofl-1.1: scripts sil org ofl
epl-2.0: eclipse org legal epl 2 0
epl-1.0: eclipse org legal epl v10
odbl-1.0: opendatacommons org licenses odbl
pddl-1.0: opendatacommons org licenses pddl
cc0-1.0: creativecommons org publicdomain zero 1 0
"""

#: Notices that name no license.
HINTS = """
proprietary: all rights reserved
proprietary: proprietary and confidential
proprietary: may not be reproduced ~6 without ~4 written permission
public-domain: dedicated to the public domain
public-domain: is in the public domain
"""

#: Fixed by the contract of the query: the phrases every scan counts, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

GNU = {"gpl": ("general", "1 2 3"), "lgpl": ("lesser|library general", "2 2.1 3"), "agpl": ("affero general", "1 3"), "gfdl": ("free documentation", "1.1 1.2 1.3")}
CREATIVE_COMMONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_WORDS = {"by": "attribution", "sa": "[share] sharealike|alike", "nc": "[non] noncommercial|commercial", "nd": "[no] noderivs|noderivatives|derivs|derivatives"}
UNDER = "licensed|released|distributed|available|published|provided|covered|redistributed|licence|license ~6 under ~4"


def _named() -> list[tuple[str, str]]:
    """(label, signature of the name) of every license, longest spellings of the versioned families first."""
    found = []
    for short, (middle, versions) in GNU.items():
        for v in versions.split():
            full = v if "." in v else v + ".0"
            number = " ".join(v.split(".")) + ("" if "." in v else " [0]")
            name = f"{middle} public {LICENSE}" if short != "gfdl" else f"{middle} {LICENSE}"
            for spelling in (f"[gnu] {name} [gnu] [{short}] [as] [published] [by] [the] [free] [software] [foundation] version|v|either [version] {number}", f"{name} {number}", f"{short} [version|v] {number}", f"{short}v{v.split('.')[0]} {' '.join(v.split('.')[1:])}".strip()):
                found.append((f"{short}-{full}-or-later", f"{spelling} or|and|any ~8 later [version|versions]"))
                found.append((f"{short}-{full}-only", f"{spelling} only"))
                found.append((f"{short}-{full}", spelling))
    for kind in CREATIVE_COMMONS:
        parts, number = kind.split("-"), {v: " ".join(v.split(".")) for v in CC_VERSIONS}
        words = " ".join(CC_WORDS[p] for p in parts)
        for v in CC_VERSIONS:
            found.append((f"cc-{kind}-{v}", f"cc {' '.join(parts)} {number[v]}"))
            found.append((f"cc-{kind}-{v}", f"creative commons {words} {number[v]}"))
            found.append((f"cc-{kind}-{v}", f"creativecommons org licenses {' '.join(parts)} {number[v]}"))
        found.append((f"cc-{kind}", f"creative commons {words}"))
        found.append((f"cc-{kind}", f"cc {' '.join(parts)} {LICENSE}"))
    found += [("cc0-1.0", "cc0 [1] [0]"), ("cc0-1.0", "creative commons zero")]
    for line in NAMES.strip().splitlines():
        label, spellings = line.split(": ", 1)
        found += [(label, s) for s in spellings.split(" / ")]
    return found


def pattern(signature: str) -> str:
    """The regular expression of a signature over words that each have a space of their own on either side."""
    out = []
    for token in signature.split():
        if token[0] == "~":
            out.append(f"(?: [^ ]+ ){{0,{int(token[1:])}}}")
            continue
        word = token.strip("[]")
        one = f" (?:{word}) " if "|" in word else f" {word} "
        out.append(f"(?:{one})?" if token[0] == "[" else one)
    return "".join(out)


def keywords(signature: str) -> tuple[str, ...]:
    """At most two words that every match holds, the longest ones."""
    plain = {t for t in signature.split() if t[0] not in "[~" and "|" not in t and not t.isdigit()}
    return tuple(sorted(plain, key=lambda w: (-len(w), w))[:2])


def rules() -> list[Rule]:
    """All rules in order: tags, grants, names and hints; of rules with one pattern the first."""
    named = _named()
    labels = sorted({label for label, _ in named})
    wide = [("spdx license identifier " + label.replace("-", " ").replace(".", " "), label, TAG) for label in labels]
    wide += [(f"{UNDER} {s}", label, GRANT) for label, s in named]
    wide += [(s, label, NAME) for label, s in named]
    for text, priority in ((TEXTS, GRANT), (HINTS, HINT)):
        wide += [(line.split(": ", 1)[1], line.split(": ", 1)[0], priority) for line in text.strip().splitlines()]
    out = [Rule(label, priority, WEIGHT[priority], keywords(s), pattern(s)) for s, label, priority in wide]
    found: dict[str, Rule] = {}
    for rule in sorted(out, key=lambda r: r.priority):
        found.setdefault(rule.pattern, rule)
    return list(found.values())
