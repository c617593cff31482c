"""Signature rules of the license scan.

Patterns run on normalised text: words in lower case, one space between them,
no punctuation ("GPL-3.0+" reads "gpl 3 0").  A rule is (label, keyword, pattern,
priority); the keyword, or one that ``keywords`` adds, must occur in the text before
the pattern is tried.
Priorities: 5 notice texts, 4 identifiers and full titles with version, 3 grants
("licensed under ..."), 2 names, 1 generic hints.
"""

# (label, keyword, name pattern, identifier pattern)
FAMILIES = [
    ("apache-1.0", "apache", "apache (?:software )?license (?:version |v )?1 0", "apache 1 0"),
    ("apache-1.1", "apache", "apache (?:software )?license (?:version |v )?1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?license (?:version |v )?2(?: 0)?", "apache 2 0"),
    ("mit-0", "mit", "mit no attribution(?: license)?", "mit 0"),
    ("mit-x11", "mit", "(?:x11 mit|mit x11) license", "x11"),
    ("mit-cmu", "cmu", "(?:cmu|mit cmu) license", "mit cmu"),
    ("isc", "isc", "isc license", "isc"),
    ("bsd-1-clause", "bsd", "(?:1 clause bsd|bsd 1 clause) license", "bsd 1 clause"),
    ("bsd-2-clause", "bsd", "(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd) license", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:3 clause bsd|bsd 3 clause|modified bsd|new bsd|revised bsd) license", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:4 clause bsd|bsd 4 clause|original bsd|old bsd) license", "bsd 4 clause"),
    ("0bsd", "bsd", "(?:zero clause bsd|0 clause bsd|bsd zero clause) license", "0bsd"),
    ("gpl-1.0", "general", "(?:gnu )?general public license (?:version |v )?1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "general", "(?:gnu )?general public license (?:version |v )?2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "general", "(?:gnu )?general public license (?:version |v )?3(?: 0)?", "gpl 3 0"),
    ("lgpl-2.0", "general", "(?:gnu )?(?:lesser|library) general public license (?:version |v )?2(?: 0)?", "lgpl 2 0"),
    ("lgpl-2.1", "general", "(?:gnu )?(?:lesser|library) general public license (?:version |v )?2 1", "lgpl 2 1"),
    ("lgpl-3.0", "general", "(?:gnu )?(?:lesser|library) general public license (?:version |v )?3(?: 0)?", "lgpl 3 0"),
    ("agpl-1.0", "affero", "affero general public license (?:version |v )?1(?: 0)?", "agpl 1 0"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public license (?:version |v )?3(?: 0)?", "agpl 3 0"),
    ("gfdl-1.1", "documentation", "(?:gnu )?free documentation license (?:version |v )?1 1", "gfdl 1 1"),
    ("gfdl-1.2", "documentation", "(?:gnu )?free documentation license (?:version |v )?1 2", "gfdl 1 2"),
    ("gfdl-1.3", "documentation", "(?:gnu )?free documentation license (?:version |v )?1 3", "gfdl 1 3"),
    ("mpl-1.0", "mozilla", "mozilla public license (?:version |v )?1 0", "mpl 1 0"),
    ("mpl-1.1", "mozilla", "mozilla public license (?:version |v )?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license (?:version |v )?2(?: 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public license (?:version |v )?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public license (?:version |v )?2(?: 0)?", "epl 2 0"),
    ("edl-1.0", "eclipse", "eclipse distribution license (?:version |v )?1(?: 0)?", "edl 1 0"),
    ("cddl-1.0", "distribution", "common development and distribution license (?:version |v )?1 0", "cddl 1 0"),
    ("cddl-1.1", "distribution", "common development and distribution license (?:version |v )?1 1", "cddl 1 1"),
    ("cpl-1.0", "common", "common public license (?:version |v )?1 0", "cpl 1 0"),
    ("ipl-1.0", "ibm", "ibm public license (?:version |v )?1 0", "ipl 1 0"),
    ("apsl-1.0", "apple", "apple public source license (?:version |v )?1 0", "apsl 1 0"),
    ("apsl-2.0", "apple", "apple public source license (?:version |v )?2 0", "apsl 2 0"),
    ("artistic-1.0", "artistic", "artistic license (?:version |v )?1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic license (?:version |v )?2 0", "artistic 2 0"),
    ("bsl-1.0", "boost", "boost software license(?: (?:version |v )?1 0)?", "bsl 1 0"),
    ("busl-1.1", "business", "business source license(?: (?:version |v )?1 1)?", "busl 1 1"),
    ("zlib", "zlib", "zlib(?: libpng)? license", "zlib"),
    ("libpng-2.0", "libpng", "(?:png reference library|libpng) license(?: version 2)?", "libpng 2 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "(?:do what the fuck you want to public license|wtfpl)", "wtfpl"),
    ("cc0-1.0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-1.0", "commons", "creative commons attribution 1 0", "cc by 1 0"),
    ("cc-by-2.0", "commons", "creative commons attribution 2 0", "cc by 2 0"),
    ("cc-by-2.5", "commons", "creative commons attribution 2 5", "cc by 2 5"),
    ("cc-by-3.0", "commons", "creative commons attribution 3 0", "cc by 3 0"),
    ("cc-by-4.0", "commons", "creative commons attribution 4 0", "cc by 4 0"),
    ("cc-by-sa-2.0", "commons", "creative commons attribution share ?alike 2 0", "cc by sa 2 0"),
    ("cc-by-sa-2.5", "commons", "creative commons attribution share ?alike 2 5", "cc by sa 2 5"),
    ("cc-by-sa-3.0", "commons", "creative commons attribution share ?alike 3 0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "commons", "creative commons attribution share ?alike 4 0", "cc by sa 4 0"),
    ("cc-by-nd-3.0", "commons", "creative commons attribution no ?deriv(?:atives|s) 3 0", "cc by nd 3 0"),
    ("cc-by-nd-4.0", "commons", "creative commons attribution no ?deriv(?:atives|s) 4 0", "cc by nd 4 0"),
    ("cc-by-nc-3.0", "commons", "creative commons attribution non ?commercial 3 0", "cc by nc 3 0"),
    ("cc-by-nc-4.0", "commons", "creative commons attribution non ?commercial 4 0", "cc by nc 4 0"),
    ("cc-by-nc-sa-3.0", "commons", "creative commons attribution non ?commercial share ?alike 3 0", "cc by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", "commons", "creative commons attribution non ?commercial share ?alike 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-3.0", "commons", "creative commons attribution non ?commercial no ?deriv(?:atives|s) 3 0",
     "cc by nc nd 3 0"),
    ("cc-by-nc-nd-4.0", "commons", "creative commons attribution non ?commercial no ?deriv(?:atives|s) 4 0",
     "cc by nc nd 4 0"),
    ("odbl-1.0", "database", "open (?:data commons open )?database license(?: (?:version |v )?1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "commons", "open data commons attribution license(?: (?:version |v )?1 0)?", "odc by 1 0"),
    ("pddl-1.0", "dedication", "public domain dedication and license(?: (?:version |v )?1 0)?", "pddl 1 0"),
    ("ofl-1.0", "font", "(?:sil )?open font license (?:version |v )?1 0", "ofl 1 0"),
    ("ofl-1.1", "font", "(?:sil )?open font license(?: (?:version |v )?1 1)?", "ofl 1 1"),
    ("psf-2.0", "python", "python software foundation license(?: (?:version |v )?2)?", "psf 2 0"),
    ("python-2.0", "python", "python license(?: 2 0)?", "python 2 0"),
    ("php-3.0", "php", "php license (?:version |v )?3 0", "php 3 0"),
    ("php-3.01", "php", "php license (?:version |v )?3 01", "php 3 01"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("perl", "perl", "same terms as perl(?: itself)?", "artistic 1 0 perl"),
    ("vim", "vim", "vim license", "vim"),
    ("w3c", "w3c", "w3c software (?:notice and )?license", "w3c"),
    ("x11-distribute", "x11", "x11 license", "x11 distribute modifications variant"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license", "ncsa"),
    ("postgresql", "postgresql", "postgresql license", "postgresql"),
    ("openssl", "openssl", "openssl license", "openssl"),
    ("openldap-2.8", "openldap", "openldap public license(?: (?:version |v )?2 8)?", "oldap 2 8"),
    ("curl", "curl", "curl license", "curl"),
    ("eupl-1.1", "european", "european union public licen[cs]e (?:version |v )?1 1", "eupl 1 1"),
    ("eupl-1.2", "european", "european union public licen[cs]e (?:version |v )?1 2", "eupl 1 2"),
    ("cecill-2.0", "cecill", "cecill (?:free software license agreement )?(?:version |v )?2 0", "cecill 2 0"),
    ("cecill-b", "cecill", "cecill b", "cecill b"),
    ("cecill-c", "cecill", "cecill c", "cecill c"),
    ("osl-3.0", "open", "open software license (?:version |v )?3 0", "osl 3 0"),
    ("afl-3.0", "academic", "academic free license (?:version |v )?3 0", "afl 3 0"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("sspl-1.0", "server", "server side public license(?: (?:version |v )?1)?", "sspl 1 0"),
    ("elastic-2.0", "elastic", "elastic license(?: 2 0)?", "elastic 2 0"),
    ("upl-1.0", "universal", "universal permissive license(?: (?:version |v )?1 0)?", "upl 1 0"),
    ("blueoak-1.0.0", "blue", "blue oak model license(?: 1 0 0)?", "blueoak 1 0 0"),
    ("mulan-psl-2.0", "mulan", "mulan permissive software license(?: (?:version |v )?2)?", "mulanpsl 2 0"),
    ("json", "json", "json license", "json"),
    ("beerware", "beer", "beer ?ware license", "beerware"),
    ("qpl-1.0", "public", "q public license(?: (?:version |v )?1 0)?", "qpl 1 0"),
    ("sleepycat", "sleepycat", "sleepycat license", "sleepycat"),
    ("tcl", "tcl", "tcl tk license", "tcl"),
    ("unicode-dfs", "unicode", "unicode (?:license agreement|data files and software license)", "unicode dfs 2016"),
    ("openrail-m", "openrail", "(?:bigscience )?open ?rail(?: m)? license", "openrail m"),
]

# Notice sentences and generic hints: (label, keyword, pattern, priority)
NOTICES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied", 5),
    ("mit-0", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this "
     "software without restriction", 5),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification "
     "are permitted", 5),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software", 5),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software", 5),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or "
     "without fee is hereby granted", 5),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public "
     "license", 5),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general "
     "public license", 5),
    ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general "
     "public license", 5),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular "
     "purpose see the gnu general public license", 5),
    ("apache", "apache", "you may not use this file except in compliance with the license", 5),
    ("apache", "apache", "licensed to the apache software foundation asf under one or more contributor license "
     "agreements", 5),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license", 5),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 5),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 5),
    ("bsl-1.0", "boost", "distributed under the boost software license", 5),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighboring rights", 5),
    ("postgresql", "postgresql", "postgresql is released under the postgresql license", 5),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 5),
    ("public-domain", "public", "(?:is|are|placed|released|dedicated) (?:in|into|to) the public domain", 3),
    ("public-domain", "public", "public domain", 2),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)", 3),
    ("proprietary", "rights", "all rights reserved", 2),
    ("proprietary", "permission", "without (?:the )?(?:prior|express) written permission", 2),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", 1),
    ("dual", "dual", "dual licen[sc]ed", 2),
    ("creative-commons", "commons", "creative commons", 1),
    ("open-source", "open", "open source licen[sc]e", 1),
    ("unknown-license", "license", "(?:see|read) (?:the )?(?:file )?license(?: file)?(?: for details)?", 1),
    ("unknown-license", "licence", "(?:see|read) (?:the )?(?:file )?licence(?: file)?(?: for details)?", 1),
    ("unknown-license", "spdx", "spdx license identifier", 1),
    ("mit", "mit", "mit licen[sc]e", 2),
    ("mit", "mit", "licensed under (?:the )?(?:terms of (?:the )?)?mit", 3),
    ("mit", "spdx", "spdx license identifier mit", 4),
    ("apache", "apache", "apache licen[sc]e", 2),
    ("gpl", "general", "general public licen[sc]e", 2),
    ("gpl", "gpl", "gpl", 1),
    ("lgpl", "general", "(?:lesser|library) general public licen[sc]e", 3),
    ("lgpl", "lgpl", "lgpl", 1),
    ("agpl", "affero", "affero general public licen[sc]e", 3),
    ("agpl", "agpl", "agpl", 1),
    ("bsd", "bsd", "bsd licen[sc]e", 2),
    ("mpl", "mozilla", "mozilla public licen[sc]e", 2),
    ("cc", "commons", "creative commons attribution", 2),
]

_GRANT = ("(?:licen[sc]ed|released|distributed|available|provided|published|offered) under (?:the )?"
          "(?:terms of (?:the )?|conditions of (?:the )?)?")


def rules() -> list[tuple[str, str, str, int]]:
    """All rules in order: of each family its title, grant, SPDX line and short identifier, then the notices."""
    out = []
    for label, keyword, name, ident in FAMILIES:
        out.append((label, keyword, name, 4))
        out.append((label, keyword, _GRANT + name, 5))
        out.append((label, "spdx", "spdx license identifier " + ident, 4))
        out.append((label, "licen", ident + " licen[sc]e", 3))
    return out + NOTICES


# (part of a pattern, keyword of the texts that match it without the rule's own keyword)
MORE_KEYWORDS = [
    ("freebsd", "freebsd"),
    ("png reference library", "png"),
    ("do what the fuck you want to public license", "fuck"),
    ("open ?rail", "rail"),
    ("without warranty of any kind express or implied", "warranty"),
    ("you may not use this file except in compliance", "compliance"),
]


def keywords(rule) -> list[str]:
    """Every text that the rule's pattern matches holds a word that starts with one of these."""
    return [rule[1], *(k for part, k in MORE_KEYWORDS if part in rule[2])]


def gate_keywords() -> list[str]:
    """A text without any of these words has no detection."""
    return sorted({k for r in rules() for k in keywords(r)})
