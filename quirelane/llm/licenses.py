"""License scans: ordered signature rules over normalised words.

A text's words are joined by single spaces; hundreds of patterns, in order of priority, look for signatures there. Keywords
gate them: a text without any keyword runs none, and a pattern runs only if its own keyword is there. Detections that lie
within one of a higher priority, or within a longer one of the same priority, are suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelane.llm.common import as_bytes, extended

#: The base phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Words of 0-9, a-z and anything beyond ASCII; A-Z count as a-z.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

#: label: names by which texts call the license, as patterns over words, the first with the keyword that gates it.
_NAMES = {
    "agpl-3.0": ("gnu affero general public license", "affero"),
    "lgpl": ("gnu (?:lesser|library) general public license", "gnu"),
    "gpl-3.0": ("gnu general public license v(?:ersion )?3", "gnu"),
    "gpl-2.0": ("gnu general public license v(?:ersion )?2", "gnu"),
    "gfdl": ("gnu free documentation license", "gnu"),
    "apache-2.0": ("apache license (?:version |v)?2 0", "apache"),
    "apache-1.1": ("apache (?:software )?license (?:version |v)?1 1", "apache"),
    "bsd-3-clause": ("(?:3 clause|new|revised|modified) bsd licen[cs]e|bsd 3 clause(?: new or revised)? licen[cs]e", "bsd"),
    "bsd-2-clause": ("(?:2 clause|simplified) bsd licen[cs]e|bsd 2 clause(?: simplified)? licen[cs]e", "bsd"),
    "bsd": ("bsd license", "bsd"),
    "isc": ("isc license", "isc"),
    "mpl-2.0": ("mozilla public license (?:version |v)?2 0", "mozilla"),
    "mpl-1.1": ("mozilla public license (?:version |v)?1 1", "mozilla"),
    "epl-2.0": ("eclipse public license (?:version |v)?2 0", "eclipse"),
    "epl-1.0": ("eclipse public license (?:version |v)?1 0", "eclipse"),
    "cddl": ("common development and distribution license", "cddl|distribution"),
    "cpl": ("common public license", "public"),
    "eupl": ("european union public licen[cs]e", "european"),
    "artistic-2.0": ("artistic license (?:version |v)?2 0", "artistic"),
    "artistic": ("artistic license", "artistic"),
    "zlib": ("zlib(?: libpng)? license", "zlib"),
    "boost": ("boost software license", "boost"),
    "unlicense": ("the unlicense", "unlicense"),
    "wtfpl": ("do what the f[a-z]* you want to public license", "public"),
    "python": ("python software foundation license", "python"),
    "openssl": ("openssl license", "openssl"),
    "postgresql": ("postgresql licen[cs]e", "postgresql"),
    "odbl": ("open database license", "database"),
    "ofl": ("sil open font license", "font"),
    "ms-pl": ("microsoft public license", "microsoft"),
    "ms-rl": ("microsoft reciprocal license", "microsoft"),
    "cc0": ("cc0(?: 1 0)?|creative commons zero", "cc0|creative"),
    "cc-by-nc-nd": ("cc by nc nd|creative commons attribution noncommercial no ?deriv[a-z]*", "cc|creative"),
    "cc-by-nc-sa": ("cc by nc sa|creative commons attribution noncommercial share ?alike", "cc|creative"),
    "cc-by-nc": ("cc by nc|creative commons attribution non ?commercial", "cc|creative"),
    "cc-by-nd": ("cc by nd|creative commons attribution no ?deriv[a-z]*", "cc|creative"),
    "cc-by-sa": ("cc by sa|creative commons attribution share ?alike", "cc|creative"),
    "cc-by": ("cc by|creative commons attribution", "cc|creative"),
    "gpl": ("gnu general public license|gnu gpl", "gnu"),
    "apache": ("apache license", "apache"),
    "mit": ("mit license", "mit"),
    "public-domain": ("public domain", "domain"),
}
#: How texts invoke a license, from the surest: share of certainty and pattern around its name.
_FORMS = [
    (1.0, "spdx license identifier {name}"),
    (1.0, "(?:is |are )?(?:released|licensed|distributed|published|available|provided)(?: to you)? under (?:the |a )?(?:terms of (?:the )?)?(?:{name})"),
    (0.9, "(?:permitted|permission|governed|covered|subject to)(?: by| under)? (?:the )?(?:terms of (?:the )?)?(?:{name})"),
    (0.9, "see (?:the )?(?:{name})(?: for (?:more )?details)?"),
    (0.8, "copy of (?:the )?(?:{name})"),
    (0.6, "{name}"),
]
_VERSION = "(?: only| or later)?"
#: label: identifiers that stand in SPDX tags, as patterns over words; longer ones first.
_TAGS = {
    "agpl-3.0": f"agpl 3 0{_VERSION}",
    "lgpl": f"lgpl (?:2 0|2 1|3 0){_VERSION}",
    "gpl-3.0": f"gpl 3 0{_VERSION}",
    "gpl-2.0": f"gpl 2 0{_VERSION}",
    "gpl": f"gpl 1 0{_VERSION}",
    "gfdl": f"gfdl 1 [1-3](?: no invariants| invariants)?{_VERSION}",
    "apache-2.0": "apache 2 0",
    "apache-1.1": "apache 1 1",
    "apache": "apache 1 0",
    "bsd-3-clause": "bsd 3 clause",
    "bsd-2-clause": "bsd 2 clause",
    "bsd": "0bsd|bsd [14] clause",
    "isc": "isc",
    "mpl-2.0": "mpl 2 0(?: no copyleft exception)?",
    "mpl-1.1": "mpl 1 1",
    "epl-2.0": "epl 2 0",
    "epl-1.0": "epl 1 0",
    "cddl": "cddl 1 [01]",
    "cpl": "cpl 1 0",
    "eupl": "eupl 1 [0-2]",
    "artistic-2.0": "artistic 2 0",
    "artistic": "artistic 1 0(?: perl| cl8)?",
    "zlib": "zlib",
    "boost": "bsl 1 0",
    "unlicense": "unlicense",
    "wtfpl": "wtfpl",
    "python": "psf 2 0|python 2 0(?: 1)?",
    "openssl": "openssl",
    "postgresql": "postgresql",
    "odbl": "odbl 1 0",
    "ofl": "ofl 1 [01](?: no rfn| rfn)?",
    "ms-pl": "ms pl",
    "ms-rl": "ms rl",
    "cc0": "cc0 1 0",
    "cc-by-nc-nd": "cc by nc nd [1-4] [05]",
    "cc-by-nc-sa": "cc by nc sa [1-4] [05]",
    "cc-by-nc": "cc by nc [1-4] [05]",
    "cc-by-nd": "cc by nd [1-4] [05]",
    "cc-by-sa": "cc by sa [1-4] [05]",
    "cc-by": "cc by [1-4] [05]",
    "mit-0": "mit 0",
    "mit": "mit",
}
#: Short names that mean a license wherever they stand, with the keywords that gate them.
_SHORT = {
    "agpl-3.0": ("agplv3|agpl3|agpl (?:v|version )?3(?: 0)?", "agplv3|agpl3|agpl"),
    "lgpl": ("lgplv[23]|lgpl[23]|lgpl(?: (?:v|version )?[23](?: [01])?)?", "lgplv2|lgplv3|lgpl2|lgpl3|lgpl"),
    "gpl-3.0": ("gplv3|gpl3|(?:gnu )?gpl (?:v|version )?3(?: 0)?", "gplv3|gpl3|gpl"),
    "gpl-2.0": ("gplv2|gpl2|(?:gnu )?gpl (?:v|version )?2(?: 0)?", "gplv2|gpl2|gpl"),
    "mpl-2.0": ("mplv2|mpl (?:v|version )?2 0", "mplv2|mpl"),
    "cc0": ("cc0", "cc0"),
    "wtfpl": ("wtfpl", "wtfpl"),
    "bsd": ("0bsd", "0bsd"),
}
#: Short names that mean other things too: only what is under them has their license.
_UNDER = {
    "apache-2.0": ("apache (?:v|version )?2(?: 0)?", "apache"),
    "bsd-3-clause": ("bsd 3 clause|3 clause bsd", "bsd"),
    "bsd-2-clause": ("bsd 2 clause|2 clause bsd", "bsd"),
    "bsd": ("bsd", "bsd"),
    "isc": ("isc", "isc"),
    "epl-2.0": ("epl ?(?:v|version )?2(?: 0)?", "epl|epl2|eplv2"),
    "epl-1.0": ("epl ?(?:v|version )?1(?: 0)?", "epl|epl1|eplv1"),
    "mpl-1.1": ("mpl ?(?:v|version )?1 1", "mpl|mpl1|mplv1"),
    "cddl": ("cddl(?: ?(?:v|version )?1(?: [01])?)?", "cddl|cddl1|cddlv1"),
    "eupl": ("eupl(?: ?(?:v|version )?1(?: [0-2])?)?", "eupl|eupl1|euplv1"),
    "ofl": ("(?:sil )?ofl(?: ?(?:v|version )?1(?: [01])?)?", "ofl|ofl1|oflv1"),
    "odbl": ("odbl(?: ?(?:v|version )?1(?: 0)?)?", "odbl|odbl1|odblv1"),
    "agpl-3.0": ("agpl", "agpl"),
    "unlicense": ("unlicense", "unlicense"),
    "gpl": ("gpl", "gpl"),
    "mit": ("mit", "mit"),
}
#: Clauses of license texts and notices: label, certainty, pattern, keyword. Of equal certainty, those further up come first.
_CLAUSES = [
    ("mit-0", 0.95, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is", "granted"),
    ("boost", 0.95, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "granted"),
    ("unicode", 0.95, "permission is hereby granted free of charge to any person obtaining a copy of (?:the )?(?:unicode )?data files", "granted"),
    ("x11", 0.95, "except as contained in this notice the name of the x consortium shall not be used in advertising", "consortium"),
    ("curl", 0.95, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind", "permission"),
    ("0bsd", 0.95, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "permission"),
    ("bsd-4-clause", 0.95, "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", "advertising"),
    ("bsd-3-clause", 0.95, "neither the names? of .{1,200}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products", "endorse"),
    ("bsd-3-clause", 0.9, "may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission", "endorse"),
    ("mit", 0.9, "permission is hereby granted free of charge to any person obtaining a copy", "granted"),
    ("mit", 0.8, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "portions"),
    ("isc", 0.9, "permission to use copy modify and or distribute this software for any purpose", "modify"),
    ("isc", 0.8, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "modify"),
    ("bsd", 0.9, "redistributions? (?:and use )?(?:in source and binary forms|of source code must retain)", "redistribution|redistributions"),
    ("bsd", 0.8, "redistributions in binary form must reproduce the above copyright notice", "redistributions"),
    ("apache-2.0", 0.9, "you may not use this file except in compliance with the license", "compliance"),
    ("apache-2.0", 0.9, "www apache org licenses license 2 0(?: txt| html)?", "apache"),
    ("apache-2.0", 0.8, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "basis"),
    ("apache-2.0", 0.8, "terms and conditions for use reproduction and distribution", "reproduction"),
    ("apache-1.1", 0.9, "this product includes software developed by the apache software foundation", "apache"),
    ("openssl", 0.9, "this product includes software developed by the openssl project", "openssl"),
    ("php", 0.9, "this product includes php software freely available from", "php"),
    ("agpl-3.0", 0.9, "www gnu org licenses agpl(?: 3 0)?(?: html| txt)?", "agpl"),
    ("agpl-3.0", 0.9, "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network", "remotely"),
    ("lgpl", 0.9, "www gnu org (?:licenses|copyleft) lgpl(?: [23] [01])?(?: html| txt)?", "lgpl"),
    ("lgpl", 0.8, "this library is free software you can redistribute it and or modify it", "library"),
    ("gpl-3.0", 0.9, "www gnu org licenses gpl 3 0(?: html| txt)?", "gpl"),
    ("gpl-2.0", 0.9, "www gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?", "gpl"),
    ("gpl", 0.8, "www gnu org (?:licenses|copyleft) gpl(?: html| txt)?", "gpl"),
    ("gpl", 0.8, "this program is free software you can redistribute it and or modify it", "redistribute"),
    ("gpl", 0.8, "either version [0-9]+ of the license or at your option any later version", "option"),
    ("gpl", 0.7, "you should have received a copy of the gnu general public license along with this program", "gnu"),
    ("gfdl", 0.9, "with no invariant sections no front cover texts and no back cover texts", "invariant"),
    ("mpl-2.0", 0.95, "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("mpl-2.0", 0.9, "(?:www )?mozilla org mpl 2 0", "mpl"),
    ("mpl-1.1", 0.9, "the contents of this file are subject to the mozilla public license version 1 1", "mozilla"),
    ("epl-2.0", 0.9, "www eclipse org (?:legal epl 2 0|org documents epl 2 0)", "eclipse"),
    ("epl-1.0", 0.9, "www eclipse org (?:legal epl v10|org documents epl v10)(?: html)?", "eclipse"),
    ("cddl", 0.9, "the contents of this file are subject to the terms of the common development and distribution license", "contents"),
    ("zlib", 0.9, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "misrepresented"),
    ("zlib", 0.8, "the origin of this software must not be misrepresented", "misrepresented"),
    ("unlicense", 0.9, "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", 0.9, "(?:www )?unlicense org", "unlicense"),
    ("wtfpl", 0.9, "you just do what the f[a-z]* you want to", "just"),
    ("beerware", 0.9, "if we meet some day and you think this stuff is worth it you can buy me a beer in return", "beer"),
    ("artistic", 0.9, "the intent of this document is to state the conditions under which a package may be copied", "intent"),
    ("postgresql", 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "documentation"),
    ("python", 0.9, "psf is making python available to licensee on an as is basis", "psf"),
    ("ofl", 0.9, "the font software may be sold as part of a larger software package|scripts sil org ofl", "font|sil"),
    ("json", 0.9, "the software shall be used for good not evil", "evil"),
    ("ms-pl", 0.9, "microsoft public license ms pl", "microsoft"),
    ("odbl", 0.9, "opendatacommons org licenses odbl", "opendatacommons"),
    ("pddl", 0.9, "opendatacommons org licenses pddl|public domain dedication and licen[cs]e", "opendatacommons|dedication"),
    ("odc-by", 0.9, "opendatacommons org licenses by|open data commons attribution licen[cs]e", "opendatacommons|commons"),
    ("cc0", 0.95, "creativecommons org publicdomain zero 1 0", "publicdomain"),
    ("public-domain", 0.95, "creativecommons org publicdomain mark 1 0", "publicdomain"),
    ("cc-by-nc-nd", 0.95, "creativecommons org licenses by nc nd(?: [1-4] [05])?", "creativecommons"),
    ("cc-by-nc-sa", 0.95, "creativecommons org licenses by nc sa(?: [1-4] [05])?", "creativecommons"),
    ("cc-by-nc", 0.95, "creativecommons org licenses by nc(?: [1-4] [05])?", "creativecommons"),
    ("cc-by-nd", 0.95, "creativecommons org licenses by nd(?: [1-4] [05])?", "creativecommons"),
    ("cc-by-sa", 0.95, "creativecommons org licenses by sa(?: [1-4] [05])?", "creativecommons"),
    ("cc-by", 0.95, "creativecommons org licenses by(?: [1-4] [05])?", "creativecommons"),
    ("public-domain", 0.8, "(?:dedicated|released|placed) (?:in|in ?to|to) the public domain", "domain"),
    ("public-domain", 0.8, "waive[sd]? all (?:copyright and )?(?:related (?:and|or) neighboring )?rights", "waive|waives|waived"),
    ("ogl-uk", 0.9, "open government licen[cs]e(?: v(?:ersion )?[1-3](?: 0)?)?", "government"),
    ("mulan", 0.9, "mulan (?:permissive software license|psl)(?: v(?:ersion )?[12])?", "mulan"),
    ("ncsa", 0.9, "university of illinois (?:ncsa )?open source license", "illinois"),
    ("bsl", 0.9, "business source license(?: 1 1)?", "business"),
    ("sspl", 0.9, "server side public license(?: v(?:ersion )?1)?", "server"),
    ("elastic", 0.9, "elastic license(?: (?:v|version )?2(?: 0)?)?", "elastic"),
    ("proprietary", 0.7, "all rights reserved", "reserved"),
    ("proprietary", 0.8, "(?:confidential and proprietary|proprietary and confidential)", "proprietary"),
    ("proprietary", 0.8, "(?:unauthori[sz]ed )?(?:copying|reproduction|redistribution) (?:of this (?:file|document|material) )?(?:in whole or in part )?(?:via any medium )?is strictly prohibited", "prohibited"),
    ("proprietary", 0.8, "may not be reproduced (?:or distributed |distributed or transmitted )?(?:in any form )?without (?:the )?(?:prior |express )?(?:written )?permission", "reproduced"),
    ("gpl-3.0", 0.95, "gnu general public license version 3 29 june 2007", "june"),
    ("gpl-2.0", 0.95, "gnu general public license version 2 june 1991", "june"),
    ("lgpl", 0.95, "gnu lesser general public license version (?:3 29 june 2007|2 1 february 1999)", "june|february"),
    ("lgpl", 0.95, "gnu library general public license version 2 june 1991", "june"),
    ("agpl-3.0", 0.95, "gnu affero general public license version 3 19 november 2007", "november"),
    ("gfdl", 0.95, "gnu free documentation license version 1 [1-3]", "documentation"),
    ("gpl-3.0", 0.9, "the gnu general public license is a free copyleft license for software and other kinds of works", "copyleft"),
    ("agpl-3.0", 0.9, "the gnu affero general public license is a free copyleft license for software and other kinds of works", "copyleft"),
    ("lgpl", 0.9, "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "incorporates"),
    ("lgpl", 0.85, "this library is distributed in the hope that it will be useful but without any warranty", "hope"),
    ("gpl", 0.8, "this program is distributed in the hope that it will be useful but without any warranty", "hope"),
    ("gpl", 0.8, "the licenses for most software are designed to take away your freedom to share and change it", "freedom"),
    ("gpl", 0.8, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim"),
    ("gpl", 0.8, "this program comes with absolutely no warranty", "absolutely"),
    ("gpl", 0.7, "if not write to the free software foundation inc", "foundation"),
    ("gfdl", 0.9, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "documentation"),
    ("apache-2.0", 0.95, "apache license version 2 0 january 2004", "january"),
    ("apache-2.0", 0.9, "licensed to the apache software foundation asf under one or more contributor license agreements", "asf"),
    ("apache-2.0", 0.9, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", "irrevocable"),
    ("apache-2.0", 0.8, "derivative works shall mean any work whether in source or object form that is based on or derived from the work", "derivative"),
    ("apache-1.1", 0.9, "the names apache and apache software foundation must not be used to endorse or promote products", "endorse"),
    ("mit", 0.8, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "merchantability"),
    ("mit", 0.7, "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "holders"),
    ("bsd", 0.8, "this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? as is and any express or implied warranties", "warranties"),
    ("bsd-4-clause", 0.9, "this product includes software developed by the university of california(?: berkeley)? and its contributors", "california"),
    ("bsd-2-clause", 0.8, "the views and conclusions contained in the software and documentation are those of the authors", "conclusions"),
    ("bsd-3-clause-clear", 0.95, "no express or implied licenses to any party s patent rights are granted by this license", "patent"),
    ("isc", 0.8, "the software is provided as is and the author disclaims all warranties with regard to this software", "disclaims"),
    ("zlib", 0.8, "in no event will the authors be held liable for any damages arising from the use of this software", "liable"),
    ("zlib", 0.8, "this notice may not be removed or altered from any source distribution", "altered"),
    ("boost", 0.9, "solely in the form of machine executable object code generated by a source language processor", "executable"),
    ("unlicense", 0.9, "anyone is free to copy modify publish use compile sell or distribute this software", "anyone"),
    ("mpl-2.0", 0.95, "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("mpl-2.0", 0.9, "this source code form is incompatible with secondary licenses", "incompatible"),
    ("mpl-1.1", 0.8, "see the license for the specific language governing rights and limitations under the license", "governing"),
    ("epl-2.0", 0.95, "made available under the terms of the eclipse public license (?:v |version )?2 0", "eclipse"),
    ("epl-1.0", 0.95, "made available under the terms of the eclipse public license (?:v |version )?1 0", "eclipse"),
    ("epl-1.0", 0.9, "the accompanying program is provided under the terms of this eclipse public license", "accompanying"),
    ("cpl", 0.9, "the accompanying program is provided under the terms of this common public license", "accompanying"),
    ("cddl", 0.9, "when distributing covered code include this cddl header notice in each file", "cddl"),
    ("cddl", 0.9, "you can obtain a copy of the license at usr src opensolaris license", "opensolaris"),
    ("cc-by-nc-nd", 0.95, "this work is licensed under (?:a |the )?creative commons attribution noncommercial noderiv(?:ative)?s", "noncommercial"),
    ("cc-by-nc-sa", 0.95, "this work is licensed under (?:a |the )?creative commons attribution noncommercial sharealike", "noncommercial"),
    ("cc-by-nc", 0.9, "this work is licensed under (?:a |the )?creative commons attribution noncommercial [1-4] [05]", "noncommercial"),
    ("cc-by-sa", 0.95, "this work is licensed under (?:a |the )?creative commons attribution sharealike", "sharealike"),
    ("cc-by-nd", 0.95, "this work is licensed under (?:a |the )?creative commons attribution noderiv(?:ative)?s", "noderivatives|noderivs"),
    ("cc-by", 0.9, "this work is licensed under (?:a |the )?creative commons attribution [1-4] [05]", "attribution"),
    ("cc0", 0.95, "the person who associated a work with this deed has dedicated the work to the public domain", "deed"),
    ("cc0", 0.9, "to the extent possible under law .{1,80}? has waived all copyright", "waived"),
    ("artistic-2.0", 0.9, "this license establishes the terms under which a given free software package may be copied", "establishes"),
    ("artistic", 0.9, "you may copy and distribute verbatim source copies of the standard version of this package|you may make and give away verbatim copies of the source form of the standard version", "verbatim"),
    ("ofl", 0.95, "this font software is licensed under the sil open font license", "font"),
    ("ofl", 0.9, "the goals of the open font license ofl are to stimulate worldwide development", "stimulate"),
    ("python", 0.9, "this license agreement is between the python software foundation", "agreement"),
    ("php", 0.9, "the name php must not be used to endorse or promote products", "php"),
    ("openssl", 0.9, "the names openssl toolkit and openssl project must not be used to endorse", "toolkit"),
    ("cecill", 0.9, "(?:www )?cecill info(?: licences)?|cecill(?: [abc])?(?: free software)? licen[cs]e(?: agreement)?", "cecill"),
    ("osl", 0.9, "open software license(?: (?:v |version )?[1-3] [01])?", "license"),
    ("afl", 0.9, "academic free license(?: (?:v |version )?[1-3] [0-2])?", "academic"),
    ("apsl", 0.9, "apple public source license", "apple"),
    ("ipl", 0.9, "ibm public license(?: (?:v |version )?1 0)?", "ibm"),
    ("qpl", 0.9, "the q public license", "public"),
    ("sleepycat", 0.9, "redistributions in any form must be accompanied by information on how to obtain complete source code", "accompanied"),
    ("w3c", 0.9, "w3c software (?:notice and |and document notice and )?license", "w3c"),
    ("hpnd", 0.9, "historical permission notice and disclaimer", "historical"),
    ("fair", 0.9, "usage of the works is permitted provided that this instrument is retained with the works", "instrument"),
    ("upl", 0.9, "universal permissive license", "permissive"),
    ("ecl-2.0", 0.9, "educational community license(?: (?:v |version )?[12] 0)?", "educational"),
    ("lppl", 0.9, "latex project public license", "latex"),
    ("ftl", 0.9, "(?:the )?freetype (?:project )?license", "freetype"),
    ("ijg", 0.9, "this software is based in part on the work of the independent jpeg group", "jpeg"),
    ("tcl", 0.9, "the following terms apply to all files associated with the software unless explicitly disclaimed in individual files", "explicitly"),
    ("vim", 0.9, "vim is charityware", "charityware"),
    ("blueoak", 0.9, "blue oak model license(?: 1 0 0)?", "oak"),
    ("nasa", 0.9, "nasa open source agreement", "nasa"),
    ("etalab", 0.9, "licence ouverte(?: open licence)?", "ouverte"),
    ("polyform", 0.9, "polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) license", "polyform"),
    ("commons-clause", 0.9, "the license does not grant to you the right to sell the software", "sell"),
    ("llama", 0.9, "llama [23](?: [123])? community license", "llama"),
    ("openrail", 0.9, "(?:creativeml |bigscience |bigcode )?open ?rail(?: m| plus plus m)? licen[cs]e", "openrail|rail"),
    ("proprietary", 0.7, "you may not (?:copy|reverse engineer) (?:modify )?(?:decompile )?(?:or )?(?:disassemble )?(?:distribute )?the software", "reverse|copy"),
    ("proprietary", 0.7, "this (?:material|document|file) (?:is|contains) (?:the )?(?:trade secrets?|confidential information) of", "confidential|trade"),
    ("unknown", 0.5, "(?:released|licensed|distributed) under (?:the )?(?:[0-9a-z]+ ){1,4}licen[cs]e", "released|licensed|distributed"),
]


_TAG = "spdx license identifier"


@dataclass(frozen=True)
class Rule:
    label: str
    certainty: float
    priority: int
    pattern: re.Pattern
    keywords: tuple[bytes, ...]


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first: tags, each form around each name, then clauses. More exact names come first."""
    out = [(label, 1.0, f"{_TAG} (?:{name})", "spdx") for label, name in _TAGS.items()]
    for certainty, form in _FORMS:
        for label, (name, keywords) in _NAMES.items():
            out.append((label, certainty, form.format(name=f"(?:{name})"), keywords))
    for certainty, form in _FORMS[1:]:
        out += [(label, certainty, form.format(name=f"(?:{name})"), keywords) for label, (name, keywords) in _SHORT.items()]
    for certainty, form in (_FORMS[1], (0.6, "under (?:the |an? )?{name}")):
        out += [(label, certainty, form.format(name=f"(?:{name})"), keywords) for label, (name, keywords) in _UNDER.items()]
    out += list(_CLAUSES)
    out.sort(key=lambda r: -r[1])  # stable
    return tuple(
        Rule(label, certainty, i, re.compile(rf"(?<![^ ]){pattern}(?![^ ])".encode()), tuple(k.encode() for k in keywords.split("|")))
        for i, (label, certainty, pattern, keywords) in enumerate(out)
    )


@cache
def _keywords() -> frozenset[bytes]:
    return frozenset(k for r in rules() for k in r.keywords)


@cache
def _tags() -> tuple[re.Pattern, re.Pattern]:
    """A tag's first identifier, and one that follows in its expression; groups are numbered as rules."""
    names = "|".join(f"({name})" for name in _TAGS.values())
    return re.compile(rf"(?<![^ ]){_TAG} (?:{names})(?![^ ])".encode()), re.compile(rf" (?:with (?:[0-9a-z]+ ){{1,6}}?exception(?: [0-9]+)*(?![^ ])|(?:or|and) (?:{names})(?![^ ]))".encode())


def _further(body: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, end, rule) of a tag's identifiers after the first, as of MIT OR Apache-2.0."""
    first, more = _tags()
    for m in first.finditer(body):
        while m := more.match(body, m.end()):
            if m.lastindex:
                yield m.start() + 1, m.end(), m.lastindex - 1


@dataclass
class Scan:
    n_words: int
    places: list[tuple[int, str]]  # start word and label of each base place
    detections: list[tuple[int, int, str, float]]  # start and end word, label, certainty


@cache
def _phrases() -> tuple[tuple[bytes, str], ...]:
    return tuple((b" " + p.encode() + b" ", label) for p, label in PHRASES)


@cache
def _gates() -> frozenset[bytes]:
    """Keywords, and the first words of the base phrases: a text without any of them is done."""
    return _keywords() | {p.split()[0].encode() for p, _ in PHRASES}


def suppress(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, priority), those that no kept one contains; taken by priority, then the longer, then the earlier."""
    places = {s: i for i, s in enumerate(sorted({s for s, _, _ in found}), 1)}
    furthest = [0] * (len(places) + 1)  # furthest ends of kept ones that start at a place or before, in a tree of prefixes
    kept = []
    for s, e, p in sorted(found, key=lambda d: (d[2], d[0] - d[1], d[0])):
        i, reach = places[s], 0
        while i:
            reach, i = max(reach, furthest[i]), i & (i - 1)
        if reach >= e:
            continue
        kept.append((s, e, p))
        i = places[s]
        while i < len(furthest):
            furthest[i] = max(furthest[i], e)
            i += i & -i
    return kept


def scan(text: bytes) -> Scan:
    words = text.translate(_TABLE).split()
    here = _gates().intersection(words)
    if not here:
        return Scan(len(words), [], [])
    joined = b" " + b" ".join(words) + b" "
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    places = []
    for phrase, label in _phrases():
        at = joined.find(phrase)
        while at >= 0:
            places.append((bisect_left(starts, at), label))
            at = joined.find(phrase, at + 1)
    found = []
    body = joined[1:-1]
    for r in rules():
        if here.isdisjoint(r.keywords):
            continue
        for m in r.pattern.finditer(body):
            found.append((bisect_left(starts, m.start()), bisect_left(starts, m.end()), r.priority))
    if b"spdx" in here:
        found += [(bisect_left(starts, s), bisect_left(starts, e), rule) for s, e, rule in _further(body)]
    all_rules = rules()
    detections = [(s, e, all_rules[p].label, all_rules[p].certainty) for s, e, p in suppress(found)] if found else []
    return Scan(len(words), places, sorted(detections))


def scan_documents(docs: DataFrame, *, id: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every text; with ``spans`` the detections.

    Null and empty texts have no words, places or labels, and score 0. The score is the certainty of the surest
    detection, at least 0.6 where a base phrase stands. Repeated rows are scanned alike; other columns are not used.
    """
    more = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema = extended(docs.select(id).schema, more + ", detections array<string>" * spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in as_bytes(b.column(1)):
                got = scan(t or b"")
                at = [p for p, _ in got.places]
                base = {label for _, label in got.places}
                score = max([0.6 if base else 0.0, *(d[3] for d in got.detections)])
                row = [got.n_words, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[2] for d in got.detections})), score]
                rows.append([*row, [f"{d[2]}:{d[0]}:{d[1]}" for d in got.detections]] if spans else row)
            columns = list(zip(*rows, strict=True))
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, types, strict=False))], names=schema.names)

    return docs.select(id, F.col(text).alias("__text")).mapInArrow(run, schema)
