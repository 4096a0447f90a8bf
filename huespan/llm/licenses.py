"""7. License scan by ordered signature rules.

Names of licences are common words or names of firms as well, so a name counts only with the word "license" or behind "licensed under", and a notice only as the sentence that it is.

A text becomes a line of lower-case words with one space around each, so rules are regular expressions over
words that punctuation, line ends and comment signs don't disturb. Every rule names keywords, one of which each of its matches holds; one Aho-Corasick pass
finds the keywords of a text, and only rules with a keyword that it holds are tried. Detections are then ordered by priority
(whole notices over tags, tags over names, names with a version over bare ones), longer before shorter, earlier before later, and one whose interval
lies inside that of a detection before it is suppressed.

Null and empty texts have no words and no detections. Repeated rows, null keys and further columns are kept as they are; columns named as a
result of the scan are replaced. Of equal detections the rule written first stays. An empty table gives an empty one.
Each row is scanned on its own, in passes over the whole text: patterns reach a bounded number of words, so a text of any length takes time in
proportion to it, and places of detections are looked up among the word starts, not counted again.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huespan.llm.common import unused

# The two-way phrases of the base labels.
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

# Licences: label, keywords, name as a pattern over words, tags of the SPDX list as words, addresses as words.
FAMILIES = [
    ("mit", "mit|expat", r"(?:the )?(?:mit|expat)(?: x11)?", "mit", r"opensource org licenses mit(?: license)?"),
    ("mit-0", "mit", r"mit (?:no attribution|0)", "mit 0", r"github com aws mit 0"),
    ("apache-1.0", "apache", r"apache(?: software)? license(?: version)? 1 0", "apache 1 0", r"www apache org licenses license 1 0"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version)? 1 1", "apache 1 1", r"www apache org licenses license 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "apache 2 0", r"(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl(?: version)? ?v?1(?: 0)?", "gpl 1 0", r"gnu org licenses(?: old licenses)? gpl 1 0"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: version)? ?v?2(?: 0)?", "gpl 2 0", r"gnu org licenses(?: old licenses)? gpl 2 0"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: version)? ?v?3(?: 0)?", "gpl 3 0", r"gnu org licenses gpl(?: 3 0)?"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl(?: version)? ?v?2(?: 0)?", "lgpl 2 0", r"gnu org licenses(?: old licenses)? lgpl 2 0"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version)? ?v?2 1", "lgpl 2 1", r"gnu org licenses(?: old licenses)? lgpl 2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?", "lgpl 3 0", r"gnu org licenses lgpl(?: 3 0)?"),
    ("agpl-1.0", "agpl", r"agpl(?: version)? ?v?1(?: 0)?", "agpl 1 0", r"www affero org oagpl"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: version)? ?v?3(?: 0)?", "agpl 3 0", r"gnu org licenses agpl(?: 3 0)?"),
    ("gfdl-1.1", "documentation", r"gnu free documentation license(?: version)? 1 1", "gfdl 1 1", r"gnu org licenses(?: old licenses)? fdl 1 1"),
    ("gfdl-1.2", "documentation", r"gnu free documentation license(?: version)? 1 2", "gfdl 1 2", r"gnu org licenses(?: old licenses)? fdl 1 2"),
    ("gfdl-1.3", "documentation", r"gnu free documentation license(?: version)? 1 3", "gfdl 1 3", r"gnu org licenses fdl(?: 1 3)?"),
    ("bsd-0-clause", "zero clause|0 clause|0 bsd", r"(?:zero clause|0 clause)(?: bsd)?|0 bsd", "0bsd", r"opensource org licenses 0bsd"),
    ("bsd-1-clause", "bsd", r"bsd 1 clause", "bsd 1 clause", r"opensource org licenses bsd 1 clause"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|two clause|2 clause)(?: bsd)|bsd 2 clause", "bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|three clause|3 clause)(?: bsd)|bsd 3 clause", "bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original|four clause|4 clause)(?: bsd)|bsd 4 clause", "bsd 4 clause", r"directory fsf org wiki license bsd 4clause"),
    ("bsd", "bsd", r"bsd(?: style| type)?", "bsd", r"opensource org licenses bsd license"),
    ("isc", "isc", r"isc", "isc", r"opensource org licenses isc(?: license)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "zlib", r"(?:www )?zlib net zlib license"),
    ("libpng", "libpng", r"libpng", "libpng", r"www libpng org pub png src libpng license"),
    ("boost-1.0", "boost", r"boost software(?: license)?(?: version)?(?: 1 0)?", "bsl 1 0", r"www boost org license 1 0"),
    ("mpl-1.0", "mozilla", r"mozilla public license(?: version| v)? ?1(?: 0)?", "mpl 1 0", r"mozilla org mpl 1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version| v)? ?1 1", "mpl 1 1", r"mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version| v)? ?2(?: 0)?", "mpl 2 0", r"mozilla org (?:en us )?mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version| v)?(?: ?1(?: 0)?)?", "epl 1 0", r"eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version| v)? ?2(?: 0)?", "epl 2 0", r"eclipse org legal epl(?: v20| 2 0)"),
    ("edl-1.0", "eclipse", r"eclipse distribution license(?: version| v)? ?1(?: 0)?", "edl 1 0", r"eclipse org org documents edl v10"),
    ("cddl-1.0", "cddl|common development", r"(?:common development and distribution license|cddl)(?: version)?(?: ?1(?: 0)?)?", "cddl 1 0", r"opensource org licenses cddl(?: 1 0)?"),
    ("cddl-1.1", "cddl|common development", r"(?:common development and distribution license|cddl)(?: version)? ?1 1", "cddl 1 1", r"glassfish dev java net public cddl gpl 1 1"),
    ("cpl-1.0", "common", r"common public license(?: version)?(?: ?1(?: 0)?)?", "cpl 1 0", r"opensource org licenses cpl"),
    ("ipl-1.0", "ibm", r"ibm public license(?: version)?(?: ?1(?: 0)?)?", "ipl 1 0", r"opensource org licenses ibmpl"),
    ("eupl-1.1", "european", r"european union public licen[cs]e(?: version| v)? ?1 1", "eupl 1 1", r"joinup ec europa eu software page eupl"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: version| v)? ?1 2", "eupl 1 2", r"joinup ec europa eu collection eupl"),
    ("artistic-1.0", "artistic", r"artistic(?: license)?(?: version)? ?1(?: 0)?", "artistic 1 0", r"opensource org licenses artistic license 1 0"),
    ("artistic-2.0", "artistic", r"artistic(?: license)?(?: version)? ?2(?: 0)?", "artistic 2 0", r"opensource org licenses artistic license 2 0"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-2.0", "commons", r"creative commons attribution(?: version)? 2(?: 0)?", "cc by 2 0", r"creativecommons org licenses by 2 0"),
    ("cc-by-3.0", "commons", r"creative commons attribution(?: version)? 3(?: 0)?", "cc by 3 0", r"creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "commons", r"creative commons attribution(?: version)? 4(?: 0)?", "cc by 4 0", r"creativecommons org licenses by 4 0"),
    ("cc-by-sa-3.0", "commons", r"creative commons attribution share ?alike(?: version)? 3(?: 0)?", "cc by sa 3 0", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", "commons", r"creative commons attribution share ?alike(?: version)? 4(?: 0)?", "cc by sa 4 0", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "commons", r"creative commons attribution non ?commercial(?: version)? 4(?: 0)?", "cc by nc 4 0", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "commons", r"creative commons attribution no ?deriv(?:ative|s|ativ)s?(?: works)?(?: version)? 4(?: 0)?", "cc by nd 4 0", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "commons", r"creative commons attribution non ?commercial share ?alike(?: version)? 4(?: 0)?", "cc by nc sa 4 0", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: version)? 4(?: 0)?", "cc by nc nd 4 0", r"creativecommons org licenses by nc nd 4 0"),
    ("unlicense", "unlicense", r"unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl", r"(?:www|sam zoy) (?:wtfpl net|org wtfpl)"),
    ("openssl", "openssl", r"openssl", "openssl", r"www openssl org source license"),
    ("python-2.0", "python", r"python software foundation(?: license)?(?: version)?(?: 2)?", "python 2 0", r"docs python org 3 license"),
    ("php-3.01", "php", r"php license(?: version)? 3 01", "php 3 01", r"www php net license 3 01"),
    ("ruby", "ruby", r"ruby", "ruby", r"www ruby lang org en about license"),
    ("postgresql", "postgresql", r"postgresql", "postgresql", r"www postgresql org about licence"),
    ("ofl-1.1", "sil", r"sil open font(?: license)?(?: version)?(?: 1 1)?", "ofl 1 1", r"scripts sil org ofl"),
    ("ms-pl", "microsoft", r"microsoft public", "ms pl", r"opensource org licenses ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal", "ms rl", r"opensource org licenses ms rl"),
    ("afl-3.0", "academic", r"academic free(?: license)?(?: version)? 3(?: 0)?", "afl 3 0", r"opensource org licenses afl 3 0"),
    ("osl-3.0", "open", r"open software(?: license)?(?: version)? 3(?: 0)?", "osl 3 0", r"opensource org licenses osl 3 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", "ncsa", r"opensource org licenses ncsa"),
    ("upl-1.0", "universal", r"universal permissive(?: license)?(?: version)?(?: 1 0)?", "upl 1 0", r"oss oracle com licenses upl"),
    ("vim", "vim", r"vim", "vim", r"vimdoc sourceforge net htmldoc uganda"),
    ("w3c", "w3c", r"w3c software(?: notice)?(?: and)?", "w3c", r"www w3 org consortium legal copyright software"),
    ("x11", "x11", r"x11", "x11", r"www xfree86 org 3 3 6 copyright2"),
    ("blueoak-1.0.0", "blue", r"blue oak model(?: license)?(?: 1 0 0)?", "blueoak 1 0 0", r"blueoakcouncil org license 1 0 0"),
    ("odbl-1.0", "open", r"open (?:data commons open )?database(?: license)?(?: v?1 0)?", "odbl 1 0", r"opendatacommons org licenses odbl"),
    ("busl-1.1", "business", r"business source(?: license)?(?: 1 1)?", "busl 1 1", r"mariadb com bsl11"),
    ("sspl-1.0", "server", r"server side public(?: license)?(?: v?1)?", "sspl 1 0", r"www mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic", r"elastic(?: license)?(?: 2 0)?", "elastic 2 0", r"www elastic co licensing elastic license"),
]

# Notices: label, keywords, sentence as a pattern over words.
NOTICES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "noninfringement", r"the software is provided as is without warranty of any kind express or implied(?: \S+){0,20} noninfringement"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"neither the name of(?: \S+){1,15} may be used to endorse or promote products"),
    ("bsd-4-clause", "acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", "apache", r"licensed under the apache license version 2 0(?: the license you may not use this file except in compliance with the license)?"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", "later", r"gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "later", r"gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "general", r"(?:gnu )?general public license(?: as published by the free software foundation)? (?:version|v) ?2(?: 0)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public license(?: as published by the free software foundation)? (?:version|v) ?3(?: 0)?"),
    ("lgpl-2.1", "lesser|library", r"(?:gnu )?(?:lesser|library) general public license (?:version|v) ?2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license (?:version|v) ?3(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license (?:version|v) ?3(?: 0)?"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("boost-1.0", "boost", r"distributed under the boost software license version 1 0"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", r"(?:this|the) (?:software|program|code|source code|file|library|work|package|data|dataset|text|image|document|module|header) (?:is|are|was|has been)(?: hereby)?(?: put)? in the public domain"),
    ("public-domain", "domain", r"no copyright(?: is claimed)?(?: \S+){0,6} public domain"),
    ("wtfpl", "want", r"do what the fuck you want to public license"),
    ("cc0-1.0", "waived", r"has waived all copyright and related or neighboring rights"),
    ("proprietary", "reserved", r"copyright(?: c)?(?: by)?(?: \S+){0,5} (?:19|20)\d\d(?: \S+){0,12} all rights reserved"),
    ("proprietary", "reserved", r"c (?:19|20)\d\d(?: \S+){0,12} all rights reserved"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)(?: \S+){0,6}"),
    ("proprietary", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("dual", "dual", r"dual licensed under(?: \S+){1,10}"),
    ("mit", "notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("bsd", "binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd", "retain", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-0-clause", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("lgpl", "library", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1-or-later", "later", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-2.0-or-later", "later", r"gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "later", r"gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0-or-later", "later", r"gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gfdl-1.3", "permission", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3"),
    ("gfdl-1.2", "permission", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2"),
    ("epl-2.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version) ?2 0"),
    ("epl-1.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version) ?1 0"),
    ("cddl-1.0", "development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "common", r"this program and the accompanying materials are made available under the terms of the common public license"),
    ("eupl-1.2", "eupl", r"licensed under the eupl(?: version| v)? ?1 2"),
    ("artistic-2.0", "artistic", r"redistribute it and or modify it under the terms of (?:either )?the artistic license(?: version)? 2 0"),
    ("perl", "perl", r"under the same terms as perl itself"),
    ("cc-by-4.0", "commons", r"this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "commons", r"this work is licensed under a creative commons attribution share ?alike 4 0 international license"),
    ("cc-by-nc-4.0", "commons", r"this work is licensed under a creative commons attribution non ?commercial 4 0 international license"),
    ("cc0-1.0", "extent", r"to the extent possible under law(?: \S+){1,12} waived all copyright"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("python-2.0", "psf", r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("php-3.01", "php", r"this source file is subject to version 3 01 of the php license"),
    ("postgresql", "california", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("ncsa", "illinois", r"neither the names? of(?: \S+){0,8} university of illinois"),
    ("w3c", "licensee", r"by obtaining(?: using)? and or copying this work you the licensee agree"),
    ("busl-1.1", "change", r"change date(?: \S+){1,12} change license"),
    ("sspl-1.0", "server side", r"server side public license version 1(?: as published by mongodb inc)?"),
    ("elastic-2.0", "managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("afl-3.0", "academic", r"licensed under the academic free license version 3 0"),
    ("osl-3.0", "open", r"licensed under the open software license version 3 0"),
    ("blueoak-1.0.0", "contributor", r"each contributor licenses you to do everything with this software that would otherwise infringe that contributor s copyright"),
    ("upl-1.0", "lrgrwrks", r"to deal in both a the software and b any piece of software and or hardware listed in the lrgrwrks txt file"),
    ("beerware", "whatever you want", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("proprietary", "written", r"no part of this (?:publication|software|file|document) may be (?:reproduced|copied|redistributed)(?: \S+){0,20} without(?: the)?(?: prior)?(?: express)? written (?:permission|consent)"),
    ("proprietary", "trade", r"contains trade secrets(?: \S+){0,8} (?:proprietary|confidential) information"),
]

# Families without a version: label, keywords, pattern.
GENERIC = [
    ("gpl", "general", r"(?:gnu )?general public license"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl", "library", r"(?:gnu )?library general public license"),
    ("agpl", "affero", r"(?:gnu )?affero general public license"),
    ("free-documentation", "documentation", r"gnu free documentation license"),
    ("creative-commons", "commons", r"creative commons(?: \S+){0,5} licen[cs]e"),
    ("apache", "apache", r"apache(?: software)? license"),
    ("mozilla", "mozilla", r"mozilla public license"),
]

# How much a kind of rule is worth, and its priority (lower goes first).
KINDS = {"notice": (0, 0.9), "tag": (1, 0.95), "address": (2, 0.85), "grant": (3, 0.8), "name": (4, 0.6), "generic": (5, 0.5)}


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keywords: tuple[bytes, ...]  # every match holds one of them
    pattern: re.Pattern[bytes]
    priority: int
    worth: float


def build_rules() -> list[Rule]:
    """All rules, in order of priority and then as written."""
    found: list[tuple[str, str, str, str]] = [("notice", *x) for x in NOTICES] + [("generic", *x) for x in GENERIC]
    for label, key, name, tag, address in FAMILIES:
        # Names are words of prose, of firms and of languages too, so they count with the word "license" only, or behind "licensed under".
        named = rf"(?:{name}) licen[cs]e" + (rf"|{name}" if "licen" in name.replace("(?: license)?", "") else rf"|{name.replace('(?: license)?', ' license')}" if "(?: license)?" in name else "")
        found += [
            ("tag", label, "spdx", rf"spdx license identifier (?:\S+ or )?{tag}(?: only| or later)?"),
            ("address", label, address.replace("(?:www )?", "").replace("(?:", "").split(" ")[0].split("|")[0] if key not in address else key, address),
            ("grant", label, key, rf"(?:released|distributed|available|provided|published|covered) (?:under|by)(?: the)?(?: terms of)?(?: the)? (?:{named})(?: version \d+(?: \d+)*)?"),
            ("grant", label, key, rf"(?:licensed|licensing|license|relicensed) (?:is )?under(?: the)?(?: terms of)?(?: the)? (?:{named}|{name})(?: version \d+(?: \d+)*)?"),
            ("name", label, key, rf"(?:{named})"),
        ]
    rules = [Rule(f"{kind}-{k}", label, tuple(key.encode().split(b"|")), re.compile(b"(?<= )(?:" + p.encode() + b")(?= )"), KINDS[kind][0], KINDS[kind][1]) for k, (kind, label, key, p) in enumerate(found)]
    return sorted(rules, key=lambda r: r.priority)


# Lower-cased bytes: everything of ASCII that is no digit or letter parts words; other bytes are parts of words.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        import ahocorasick

        self.rules = build_rules() if rules is None else rules
        self.by_key: dict[bytes, list[int]] = {}
        for k, r in enumerate(self.rules):
            for key in r.keywords:
                self.by_key.setdefault(key, []).append(k)
        self.keys = ahocorasick.Automaton()
        for key in self.by_key:
            self.keys.add_word(key.decode("latin-1"), key)
        self.keys.make_automaton()

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").lower().translate(_WORDS).split()

    def detect(self, line: bytes, prefilter: bool = True) -> list[tuple[int, int, Rule]]:
        """Detections (start, end, rule) of a line of words that survive suppression, best first."""
        keys = {key for _, key in self.keys.iter(line.decode("latin-1"))} if prefilter else self.by_key.keys()
        found = []
        for k in sorted({k for key in keys for k in self.by_key[key]}):
            rule = self.rules[k]
            found += [(rule.priority, m.start() - m.end(), m.start(), k, m.end()) for m in rule.pattern.finditer(line)]
        found.sort()
        kept: list[tuple[int, int, Rule]] = []
        starts: list[int] = []  # kept intervals that no other contains, by start: their ends ascend too
        ends: list[int] = []
        for _, _, s, k, e in found:
            at = bisect.bisect_right(starts, s)
            if at and ends[at - 1] >= e:
                continue
            kept.append((s, e, self.rules[k]))
            until = at
            while until < len(starts) and ends[until] <= e:
                until += 1
            low = at - 1 if at and starts[at - 1] == s else at
            starts[low:until], ends[low:until] = [s], [e]
        return kept

    def scan(self, text: str | None) -> dict:
        """Words, base places and detections of one text."""
        words = self.words(text)
        base: list[tuple[int, str]] = []
        at = -1
        if b"license" in words:
            while True:
                try:
                    at = words.index(b"license", at + 1)
                except ValueError:
                    break
                for phrase, label in BASE.items():
                    p = phrase.split(b" ")
                    if at + 1 >= len(p) and words[at + 1 - len(p) : at + 1] == p:
                        base.append((at + 1 - len(p), label))
        line = b" " + b" ".join(words) + b" "
        kept = self.detect(line)
        worth: dict[str, float] = {}
        for _, _, r in kept:
            worth[r.label] = max(worth.get(r.label, 0.0), r.worth)
        miss = math.prod(1 - w for _, w in sorted(worth.items()))
        spaces = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32) if kept else np.zeros(0, dtype=np.int64)
        place = lambda at: int(np.searchsorted(spaces, at))  # noqa: E731 -- spaces before a place
        base_labels = sorted({label for _, label in base})
        if base and not kept:
            miss = 0.5
        return {"n_words": len(words), "n_base": len(base), "first_word": min((p for p, _ in base), default=None), "last_word": max((p for p, _ in base), default=None), "base_labels": base_labels, "labels": sorted({*base_labels, *(r.label for _, _, r in kept)}), "score": 1 - miss, "detections": [{"rule": r.name, "label": r.label, "first": place(s) - 1, "words": place(e) - place(s) + 1} for s, e, r in kept]}


_scanner: Scanner | None = None


def scanner() -> Scanner:
    global _scanner
    _scanner = _scanner or Scanner()
    return _scanner


DETECTION = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
ADDED = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("detections", DETECTION)]
ADDED_SQL = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, detections array<struct<rule:string,label:string,first:bigint,words:bigint>>"


def scan_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of docs (or those in keep), and the scan of each row. Columns of docs named as a result are left out."""
    names = [n for n, _ in ADDED]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    rows = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias(unused(docs, "scanned")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for batch in batches:
            found = [s.scan(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array([x[n] for x in found], kind) for n, kind in ADDED)], [*keep, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), ADDED_SQL])
    return rows.mapInArrow(work, schema)


def license_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The scan with labels as comma-joined strings and the number of detections."""
    found = scan_licenses(docs, text, [key])
    return found.select(key, "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.size("detections").cast("long").alias("n_detections"))
