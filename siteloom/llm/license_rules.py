"""Licence signatures, written by hand: one line a phrase by which a licence, a notice or a licence's own text is known.

How a line is read: all is lower-case; a blank stands for the white space and comment marks between two words;
"licence" stands for either spelling; the word in braces is the keyword, which every match holds, so that a
text without it needn't be tried; the rest is a regular expression. A signature's kind gives its priority
and the chance that it is right.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: kind: (priority, weight)
KINDS = {"spdx": (6, 1.0), "body": (5, 0.97), "url": (4, 0.95), "notice": (3, 0.9), "name": (2, 0.75), "hint": (1, 0.4)}

#: label, kind, signature
SIGNATURES = (
    # MIT and its relatives
    ("mit", "spdx", "spdx-license-identifier: {mit}"),
    ("mit", "body", "permission is {hereby} granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "body", "the above copyright notice and this permission notice shall be included in all copies or {substantial} portions of the software"),
    ("mit", "url", "{opensource.org}/licenses?/mit"),
    ("mit", "url", "{mit-license.org}"),
    ("mit", "notice", "(?:released|distributed|available|published|licenced) under (?:the )?(?:terms of (?:the )?)?{mit}(?: licence)?"),
    ("mit", "notice", "licence: ?{mit}"),
    ("mit", "notice", "{mit}[- ]licenced"),
    ("mit", "name", "(?:the )?{mit}(?:/expat|/x11)? licence"),
    ("mit", "name", "{mit}[- ]style licence"),
    ("mit", "name", "{expat} licence"),
    ("mit-0", "spdx", "spdx-license-identifier: {mit-0}"),
    ("mit-0", "name", "mit no {attribution}(?: licence)?"),
    ("mit-0", "name", "mit-0 {licence}"),
    ("x11", "spdx", "spdx-license-identifier: {x11}"),
    ("x11", "name", "(?:mit/)?{x11} licence"),
    ("x11", "body", "except as contained in this notice,? the name of the x {consortium} shall not be used in advertising"),
    ("isc", "spdx", "spdx-license-identifier: {isc}"),
    ("isc", "body", "permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is {hereby} granted"),
    ("isc", "url", "{opensource.org}/licenses?/isc"),
    ("isc", "notice", "(?:released|distributed|available|published|licenced) under (?:the )?(?:terms of (?:the )?)?{isc} licence"),
    ("isc", "name", "(?:the )?{isc} licence"),
    ("0bsd", "spdx", "spdx-license-identifier: {0bsd}"),
    ("0bsd", "name", "{0bsd} licence"),
    ("0bsd", "name", "(?:bsd )?zero[- ]{clause} (?:bsd )?licence"),
    ("hpnd", "spdx", "spdx-license-identifier: {hpnd}"),
    ("hpnd", "name", "{historical} permission notice and disclaimer"),
    ("hpnd", "body", "the name of .?.?.?the copyright holder.?.? not be used in advertising or {publicity} pertaining to distribution"),
    ("ncsa", "spdx", "spdx-license-identifier: {ncsa}"),
    ("ncsa", "name", "university of {illinois}(?:/ncsa)? open source licence"),
    ("ncsa", "url", "{opensource.org}/licenses?/ncsa"),
    ("python-cnri", "name", "{cnri} (?:open source )?(?:python )?licence"),
    ("curl", "spdx", "spdx-license-identifier: {curl}"),
    ("curl", "name", "{curl} licence"),
    # BSD
    ("bsd", "notice", "(?:released|distributed|available|published|licenced) under (?:the )?(?:terms of (?:the )?)?(?:a )?{bsd}(?:[- ]style)?(?: licence)?"),
    ("bsd", "notice", "licence: ?{bsd}"),
    ("bsd", "name", "(?:the )?{bsd} licence"),
    ("bsd", "name", "{bsd}[- ]style licence"),
    ("bsd", "body", "{redistribution} and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met"),
    ("bsd", "body", "{redistributions} of source code must retain the above copyright notice"),
    ("bsd", "body", "{redistributions} in binary form must reproduce the above copyright notice"),
    ("bsd-2-clause", "spdx", "spdx-license-identifier: {bsd-2-clause}"),
    ("bsd-2-clause", "url", "{opensource.org}/licenses?/bsd-2-clause"),
    ("bsd-2-clause", "name", "{bsd} 2[- ]clause(?: (?:simplified )?licence)?"),
    ("bsd-2-clause", "name", "(?:2|two)[- ]clause {bsd}(?: licence)?"),
    ("bsd-2-clause", "name", "simplified {bsd}(?: licence)?"),
    ("bsd-2-clause", "name", "{freebsd} licence"),
    ("bsd-3-clause", "spdx", "spdx-license-identifier: {bsd-3-clause}"),
    ("bsd-3-clause", "url", "{opensource.org}/licenses?/bsd-3-clause"),
    ("bsd-3-clause", "name", "{bsd} 3[- ]clause(?: licence)?"),
    ("bsd-3-clause", "name", "(?:3|three)[- ]clause {bsd}(?: licence)?"),
    ("bsd-3-clause", "name", "(?:new|modified|revised) {bsd} licence"),
    ("bsd-3-clause", "body", "may be used to {endorse} or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "spdx", "spdx-license-identifier: {bsd-4-clause}"),
    ("bsd-4-clause", "name", "(?:original|old|four[- ]clause|4[- ]clause) {bsd} licence"),
    ("bsd-4-clause", "body", "all {advertising} materials mentioning features or use of this software must display the following acknowledge?ment"),
    # Apache
    ("apache", "spdx", "spdx-license-identifier: {apache-}(?:1\\.0|1\\.1|2\\.0)"),
    ("apache", "url", "www\\.{apache.org}/licenses(?:/license-2\\.0)?"),
    ("apache", "url", "{opensource.org}/licenses?/apache-2\\.0"),
    ("apache", "body", "you may not use this file except in {compliance} with the licence"),
    ("apache", "body", "software distributed under the licence is distributed on an .?as is.? {basis}"),
    ("apache", "body", "without warranties or conditions of any kind,? either {express} or implied"),
    ("apache", "body", "each contributor {hereby} grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright licence"),
    ("apache", "notice", "licenced under the {apache} licence(?:,? version 2\\.0)?"),
    ("apache", "notice", "(?:released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{apache}(?: software)?(?: licence)?(?:,? (?:version |v)?2(?:\\.0)?)?"),
    ("apache", "notice", "licence: ?{apache}"),
    ("apache", "notice", "licenced to the {apache} software foundation"),
    ("apache", "name", "(?:the )?{apache}(?: software)? licence(?:,? (?:version |v\\.? ?)?(?:1\\.[01]|2(?:\\.0)?))?"),
    ("apache", "name", "{apache}[- ]2\\.0"),
    # GPL family
    ("gpl", "spdx", "spdx-license-identifier: {gpl-}[123]\\.0(?:-only|-or-later|\\+)?"),
    ("gpl", "url", "www\\.{gnu.org}/licenses/(?:old-licenses/)?gpl"),
    ("gpl", "url", "{opensource.org}/licenses?/gpl-[23]\\.0"),
    ("gpl", "body", "is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu {general} public licence"),
    ("gpl", "body", "you should have received a copy of the gnu {general} public licence"),
    ("gpl", "body", "everyone is permitted to copy and distribute {verbatim} copies of this licence document,? but changing it is not allowed"),
    ("gpl", "body", "the gnu {general} public licence is a free,? copyleft licence for software"),
    ("gpl", "body", "either version [123] of the licence,? or .?at your {option}.? any later version"),
    ("gpl", "notice", "licenced under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{gpl}(?:[- ]?v?[123](?:\\.0)?)?"),
    ("gpl", "notice", "licenced under the gnu {general} public licence(?:,? version [123](?:\\.0)?)?"),
    ("gpl", "notice", "(?:released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{gpl}(?:[- ]?v?[123](?:\\.0)?)?"),
    ("gpl", "notice", "(?:released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{general} public licence"),
    ("gpl", "notice", "licence: ?(?:gnu )?{gpl}(?:[- ]?v?[123](?:\\.0)?)?"),
    ("gpl", "name", "(?:gnu )?{general} public licence(?:,? (?:version |v\\.? ?)?[123](?:\\.0)?)?"),
    ("gpl", "name", "gnu {gpl}(?:[- ]?v?[123](?:\\.0)?)?"),
    ("gpl", "name", "{gpl}[- ]?v?[123](?:\\.0)? licence"),
    ("gpl-linking-exception", "notice", "gcc runtime library {exception}"),
    ("gpl-linking-exception", "notice", "{classpath} exception"),
    ("gpl-linking-exception", "body", "as a special {exception},? the copyright holders of this library give you permission to link this library"),
    ("lgpl", "spdx", "spdx-license-identifier: {lgpl-}(?:2\\.0|2\\.1|3\\.0)(?:-only|-or-later|\\+)?"),
    ("lgpl", "url", "www\\.{gnu.org}/licenses/(?:old-licenses/)?lgpl"),
    ("lgpl", "body", "under the terms of the gnu {lesser} general public licence as published by the free software foundation"),
    ("lgpl", "body", "you should have received a copy of the gnu {lesser} general public licence"),
    ("lgpl", "body", "under the terms of the gnu {library} general public licence"),
    ("lgpl", "notice", "licenced under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{lgpl}(?:[- ]?v?[23](?:\\.[01])?)?"),
    ("lgpl", "notice", "licence: ?(?:gnu )?{lgpl}"),
    ("lgpl", "name", "(?:gnu )?{lesser} general public licence(?:,? (?:version |v\\.? ?)?[23](?:\\.[01])?)?"),
    ("lgpl", "name", "(?:gnu )?{library} general public licence"),
    ("lgpl", "name", "{lgpl}[- ]?v?[23](?:\\.[01])? licence"),
    ("agpl", "spdx", "spdx-license-identifier: {agpl-}(?:1\\.0|3\\.0)(?:-only|-or-later|\\+)?"),
    ("agpl", "url", "www\\.{gnu.org}/licenses/agpl"),
    ("agpl", "body", "under the terms of the gnu {affero} general public licence as published by the free software foundation"),
    ("agpl", "body", "you should have received a copy of the gnu {affero} general public licence"),
    ("agpl", "notice", "licenced under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{agpl}(?:[- ]?v?3(?:\\.0)?)?"),
    ("agpl", "notice", "licence: ?(?:gnu )?{agpl}"),
    ("agpl", "name", "(?:gnu )?{affero} general public licence(?:,? (?:version |v\\.? ?)?[13](?:\\.0)?)?"),
    ("agpl", "name", "{agpl}[- ]?v?3(?:\\.0)? licence"),
    ("fdl", "spdx", "spdx-license-identifier: {gfdl-}1\\.[123]"),
    ("fdl", "url", "www\\.{gnu.org}/(?:licenses|copyleft)/fdl"),
    ("fdl", "body", "permission is granted to copy, distribute and/or modify this document under the terms of the gnu free {documentation} licence"),
    ("fdl", "body", "with no {invariant} sections,? (?:with )?no front-cover texts"),
    ("fdl", "name", "(?:gnu )?free {documentation} licence(?:,? version 1\\.[123])?"),
    # Mozilla, Eclipse, Sun, IBM and others with weak copyleft
    ("mpl", "spdx", "spdx-license-identifier: {mpl-}(?:1\\.0|1\\.1|2\\.0)"),
    ("mpl", "url", "{mozilla.org}/mpl"),
    ("mpl", "body", "this source code form is subject to the terms of the {mozilla} public licence"),
    ("mpl", "body", "the contents of this file are subject to the {mozilla} public licence"),
    ("mpl", "notice", "licenced under (?:the )?(?:terms of (?:the )?)?{mpl}(?:[- ]?v?[12]\\.[01])?"),
    ("mpl", "name", "{mozilla} public licence(?:,? (?:version |v\\.? ?)?[12]\\.[01])?"),
    ("mpl", "name", "{mpl}[- ]?v?[12]\\.[01] licence"),
    ("epl", "spdx", "spdx-license-identifier: {epl-}[12]\\.0"),
    ("epl", "url", "{eclipse.org}/legal/epl"),
    ("epl", "body", "the accompanying materials are made available under the terms of the {eclipse} public licence"),
    ("epl", "name", "{eclipse} public licence(?:,? (?:- )?(?:version |v\\.? ?)?[12]\\.0)?"),
    ("edl", "url", "{eclipse.org}/org/documents/edl"),
    ("edl", "name", "{eclipse} distribution licence(?:,? (?:- )?(?:version |v\\.? ?)?1\\.0)?"),
    ("cpl", "spdx", "spdx-license-identifier: {cpl-}1\\.0"),
    ("cpl", "name", "{common} public licence(?:,? (?:version |v\\.? ?)?1\\.0)?"),
    ("cpal", "name", "common public {attribution} licence"),
    ("ipl", "spdx", "spdx-license-identifier: {ipl-}1\\.0"),
    ("ipl", "name", "{ibm} public licence"),
    ("cddl", "spdx", "spdx-license-identifier: {cddl-}1\\.[01]"),
    ("cddl", "body", "the contents of this file are subject to the terms of the common {development} and distribution licence"),
    ("cddl", "name", "common {development} and distribution licence(?:,? (?:version |v\\.? ?)?1\\.[01])?"),
    ("cddl", "name", "{cddl} licence"),
    ("eupl", "spdx", "spdx-license-identifier: {eupl-}1\\.[012]"),
    ("eupl", "notice", "licenced under the {eupl}"),
    ("eupl", "name", "{european} union public licence(?:,? (?:version |v\\.? ?)?1\\.[012])?"),
    ("cecill", "spdx", "spdx-license-identifier: {cecill-}"),
    ("cecill", "body", "this software is governed by the {cecill}(?:-[bc])? licence under french law"),
    ("cecill", "name", "{cecill}(?:-[bc])?(?: free software)? licence"),
    ("osl", "spdx", "spdx-license-identifier: {osl-}[123]\\.[01]"),
    ("osl", "notice", "licenced under the open software licence {version} 3\\.0"),
    ("osl", "name", "open {software} licence(?:,? (?:version |v\\.? ?)?[123]\\.[01])?"),
    ("afl", "spdx", "spdx-license-identifier: {afl-}[123]\\.[01]"),
    ("afl", "name", "{academic} free licence(?:,? (?:version |v\\.? ?)?[123]\\.[01])?"),
    ("ms-pl", "spdx", "spdx-license-identifier: {ms-pl}"),
    ("ms-pl", "name", "{microsoft} public licence"),
    ("ms-pl", "url", "{opensource.org}/licenses?/ms-pl"),
    ("ms-rl", "spdx", "spdx-license-identifier: {ms-rl}"),
    ("ms-rl", "name", "{microsoft} reciprocal licence"),
    ("nasa", "name", "{nasa} open source agreement(?:,? (?:version |v\\.? ?)?1\\.3)?(?: licence)?"),
    ("sun-public", "name", "{sun} public licence"),
    ("netscape", "name", "{netscape} public licence"),
    ("nokia", "name", "{nokia} open source licence"),
    ("qpl", "spdx", "spdx-license-identifier: {qpl-}1\\.0"),
    ("qpl", "name", "{qpl}(?: v?1\\.0)? licence"),
    ("ricoh", "name", "{ricoh} source code public licence"),
    ("rpl", "name", "{reciprocal} public licence(?:,? (?:version |v\\.? ?)?1\\.[15])?"),
    ("simple-public", "name", "{simple} public licence"),
    ("sleepycat", "name", "{sleepycat} licence"),
    ("watcom", "name", "sybase open {watcom} public licence"),
    # Creative Commons
    ("cc-by", "spdx", "spdx-license-identifier: {cc-by-}[1-4]\\.[05]"),
    ("cc-by", "url", "{creativecommons.org}/licenses/by/[1-4]\\.[05]"),
    ("cc-by", "notice", "licenced under (?:a |the )?{cc}[- ]by(?:[- ][1-4]\\.[05])?"),
    ("cc-by", "notice", "licenced under (?:a |the )?creative {commons} attribution(?: [1-4]\\.[05])?(?: international| unported| generic)?(?: licence)?"),
    ("cc-by", "name", "creative {commons} attribution(?: [1-4]\\.[05])?(?: international| unported| generic)? licence"),
    ("cc-by", "name", "{cc}[- ]by(?:[- ][1-4]\\.[05])? licence"),
    ("cc-by-sa", "spdx", "spdx-license-identifier: {cc-by-sa-}[1-4]\\.[05]"),
    ("cc-by-sa", "url", "{creativecommons.org}/licenses/by-sa/[1-4]\\.[05]"),
    ("cc-by-sa", "notice", "licenced under (?:a |the )?{cc}[- ]by[- ]sa(?:[- ][1-4]\\.[05])?"),
    ("cc-by-sa", "notice", "licenced under (?:a |the )?creative {commons} attribution[- ]share[- ]?alike"),
    ("cc-by-sa", "name", "creative {commons} attribution[- ]share[- ]?alike(?: [1-4]\\.[05])?(?: international| unported| generic)? licence"),
    ("cc-by-nc", "spdx", "spdx-license-identifier: {cc-by-nc-}[1-4]\\.[05]"),
    ("cc-by-nc", "url", "{creativecommons.org}/licenses/by-nc/[1-4]\\.[05]"),
    ("cc-by-nc", "notice", "licenced under (?:a |the )?{cc}[- ]by[- ]nc(?:[- ][1-4]\\.[05])?"),
    ("cc-by-nc", "notice", "licenced under (?:a |the )?creative {commons} attribution[- ]non-?commercial"),
    ("cc-by-nc", "name", "creative {commons} attribution[- ]non-?commercial(?: [1-4]\\.[05])?(?: international| unported| generic)? licence"),
    ("cc-by-nc-sa", "spdx", "spdx-license-identifier: {cc-by-nc-sa-}[1-4]\\.[05]"),
    ("cc-by-nc-sa", "url", "{creativecommons.org}/licenses/by-nc-sa/[1-4]\\.[05]"),
    ("cc-by-nc-sa", "notice", "licenced under (?:a |the )?{cc}[- ]by[- ]nc[- ]sa(?:[- ][1-4]\\.[05])?"),
    ("cc-by-nc-sa", "name", "creative {commons} attribution[- ]non-?commercial[- ]share[- ]?alike(?: [1-4]\\.[05])?(?: international| unported| generic)? licence"),
    ("cc-by-nc-nd", "spdx", "spdx-license-identifier: {cc-by-nc-nd-}[1-4]\\.[05]"),
    ("cc-by-nc-nd", "url", "{creativecommons.org}/licenses/by-nc-nd/[1-4]\\.[05]"),
    ("cc-by-nc-nd", "notice", "licenced under (?:a |the )?{cc}[- ]by[- ]nc[- ]nd(?:[- ][1-4]\\.[05])?"),
    ("cc-by-nc-nd", "name", "creative {commons} attribution[- ]non-?commercial[- ]no[- ]?deriv(?:ative)?s(?: (?:works )?[1-4]\\.[05])?(?: international| unported| generic)? licence"),
    ("cc-by-nd", "spdx", "spdx-license-identifier: {cc-by-nd-}[1-4]\\.[05]"),
    ("cc-by-nd", "url", "{creativecommons.org}/licenses/by-nd/[1-4]\\.[05]"),
    ("cc-by-nd", "notice", "licenced under (?:a |the )?{cc}[- ]by[- ]nd(?:[- ][1-4]\\.[05])?"),
    ("cc-by-nd", "name", "creative {commons} attribution[- ]no[- ]?deriv(?:ative)?s(?: [1-4]\\.[05])?(?: international| unported| generic)? licence"),
    ("cc0", "spdx", "spdx-license-identifier: {cc0-}1\\.0"),
    ("cc0", "url", "{creativecommons.org}/publicdomain/zero"),
    ("cc0", "body", "to the extent possible under law,? .?.?.?[^\\n.]?.?.?.?has {waived} all copyright"),
    ("cc0", "notice", "(?:released|distributed|available|published|licenced|dedicated) under (?:the )?{cc0}(?: 1\\.0)?"),
    ("cc0", "name", "{cc0}(?: 1\\.0)?(?: universal)?(?: public domain dedication| licence)"),
    ("cc", "hint", "creative {commons} licence"),
    # public domain and as good as
    ("public-domain", "url", "{creativecommons.org}/(?:licenses/publicdomain|publicdomain/mark)"),
    ("public-domain", "notice", "(?:released|placed|dedicated|put|published) (?:in|into|to) the public {domain}"),
    ("public-domain", "notice", "this (?:work|file|code|software|document|text) is in the public {domain}"),
    ("public-domain", "notice", "(?:available|released|published|distributed) under (?:the )?public {domain}"),
    ("public-domain", "hint", "public {domain} licence"),
    ("unlicense", "spdx", "spdx-license-identifier: {unlicense}"),
    ("unlicense", "url", "{unlicense.org}"),
    ("unlicense", "body", "this is free and {unencumbered} software released into the public domain"),
    ("unlicense", "body", "anyone is free to copy, modify, publish, use, {compile}, sell,? or distribute this software"),
    ("unlicense", "name", "the {unlicense}"),
    ("wtfpl", "spdx", "spdx-license-identifier: {wtfpl}"),
    ("wtfpl", "body", "do what the fuck you want to public {licence}"),
    ("wtfpl", "notice", "licenced under (?:the )?{wtfpl}"),
    ("wtfpl", "name", "{wtfpl} licence"),
    ("beerware", "spdx", "spdx-license-identifier: {beerware}"),
    ("beerware", "body", "you can buy me a {beer} in return"),
    ("beerware", "name", "(?:the )?{beer}-?ware licence"),
    ("pddl", "name", "public {domain} dedication and licence"),
    ("pddl", "spdx", "spdx-license-identifier: {pddl-}1\\.0"),
    # data, documents, fonts
    ("odbl", "spdx", "spdx-license-identifier: {odbl-}1\\.0"),
    ("odbl", "url", "{opendatacommons.org}/licenses/odbl"),
    ("odbl", "notice", "made available under the open {database} licence"),
    ("odbl", "name", "open {database} licence(?:,? (?:version |v\\.? ?)?1\\.0)?"),
    ("odc-by", "spdx", "spdx-license-identifier: {odc-by-}1\\.0"),
    ("odc-by", "url", "{opendatacommons.org}/licenses/by"),
    ("odc-by", "name", "open data commons {attribution} licence"),
    ("cdla", "spdx", "spdx-license-identifier: {cdla-}(?:permissive|sharing)-[12]\\.0"),
    ("cdla", "name", "{community} data licence agreement"),
    ("ogl-uk", "spdx", "spdx-license-identifier: {ogl-uk-}[123]\\.0"),
    ("ogl-uk", "notice", "contains public {sector} information licenced under the open government licence"),
    ("ogl-uk", "name", "open {government} licence(?:,? (?:version |v\\.? ?)?[123]\\.0)?"),
    ("ofl", "spdx", "spdx-license-identifier: {ofl-}1\\.[01]"),
    ("ofl", "body", "this font software is licenced under the sil open {font} licence"),
    ("ofl", "url", "scripts\\.{sil.org}/ofl"),
    ("ofl", "name", "(?:sil )?open {font} licence(?:,? (?:version |v\\.? ?)?1\\.[01])?"),
    ("lppl", "spdx", "spdx-license-identifier: {lppl-}1\\."),
    ("lppl", "body", "may be distributed and/or modified under the conditions of the {latex} project public licence"),
    ("lppl", "name", "{latex} project public licence(?:,? (?:version |v\\.? ?)?1\\.[0-3][abc]?)?"),
    ("fal", "name", "free {art} licence"),
    ("opl", "name", "open {publication} licence"),
    ("ecl", "spdx", "spdx-license-identifier: {ecl-}[12]\\.0"),
    ("ecl", "name", "{educational} community licence(?:,? (?:version |v\\.? ?)?[12]\\.0)?"),
    ("bitstream-vera", "name", "{bitstream} vera (?:fonts? )?licence"),
    ("ubuntu-font", "name", "{ubuntu} font licence"),
    # languages, libraries, firms
    ("artistic", "spdx", "spdx-license-identifier: {artistic-}(?:1\\.0|2\\.0)"),
    ("artistic", "url", "{opensource.org}/licenses?/artistic"),
    ("artistic", "notice", "under the same terms as {perl} itself"),
    ("artistic", "name", "(?:perl )?{artistic} licence(?:,? (?:version |v\\.? ?)?[12]\\.0)?"),
    ("psf", "spdx", "spdx-license-identifier: {psf-}2\\.0"),
    ("psf", "name", "{python} software foundation licence(?:,? version 2)?"),
    ("psf", "name", "{psf} licence"),
    ("ruby", "spdx", "spdx-license-identifier: {ruby}"),
    ("ruby", "notice", "licenced under the same terms as {ruby}"),
    ("ruby", "name", "(?:the )?{ruby} licence"),
    ("php", "spdx", "spdx-license-identifier: {php-}3\\.0"),
    ("php", "body", "this source file is subject to version 3\\.0?1? of the {php} licence"),
    ("php", "name", "(?:the )?{php} licence(?:,? (?:version |v\\.? ?)?[23](?:\\.0[1]?)?)?"),
    ("tcl", "name", "{tcl}(?:/tk)? licence"),
    ("vim", "spdx", "spdx-license-identifier: {vim}"),
    ("vim", "name", "(?:the )?{vim} licence"),
    ("zlib", "spdx", "spdx-license-identifier: {zlib}"),
    ("zlib", "body", "in no event will the authors be held {liable} for any damages arising from the use of this software"),
    ("zlib", "body", "altered source versions must be {plainly} marked as such"),
    ("zlib", "url", "{opensource.org}/licenses?/zlib"),
    ("zlib", "name", "{zlib}(?:/libpng)? licence"),
    ("libpng", "spdx", "spdx-license-identifier: {libpng}"),
    ("libpng", "name", "{libpng} licence"),
    ("bsl", "spdx", "spdx-license-identifier: {bsl-}1\\.0"),
    ("bsl", "body", "distributed under the {boost} software licence"),
    ("bsl", "url", "{boost.org}/license_1_0"),
    ("bsl", "name", "{boost} software licence(?:,? (?:- )?(?:version |v\\.? ?)?1\\.0)?"),
    ("openssl", "spdx", "spdx-license-identifier: {openssl}"),
    ("openssl", "body", "this product includes software developed by the {openssl} project"),
    ("openssl", "name", "{openssl}(?:/ssleay)? licence"),
    ("icu", "spdx", "spdx-license-identifier: {icu}"),
    ("icu", "name", "{icu} licence"),
    ("unicode", "spdx", "spdx-license-identifier: {unicode-}(?:dfs|tou|3\\.0)"),
    ("unicode", "name", "{unicode}(?:,? inc\\.?)? licence(?: agreement)?"),
    ("postgresql", "spdx", "spdx-license-identifier: {postgresql}"),
    ("postgresql", "name", "(?:the )?{postgresql} licence"),
    ("ijg", "spdx", "spdx-license-identifier: {ijg}"),
    ("ijg", "notice", "based in part on the work of the {independent} jpeg group"),
    ("ijg", "name", "{independent} jpeg group licence"),
    ("ftl", "spdx", "spdx-license-identifier: {ftl}"),
    ("ftl", "name", "{freetype}(?: project)? licence"),
    ("imagemagick", "spdx", "spdx-license-identifier: {imagemagick}"),
    ("imagemagick", "name", "{imagemagick} licence"),
    ("bzip2", "spdx", "spdx-license-identifier: {bzip2-}1\\.0"),
    ("bzip2", "name", "{bzip2} licence"),
    ("w3c", "spdx", "spdx-license-identifier: {w3c}"),
    ("w3c", "name", "{w3c}®? software(?: notice and| and document notice and)? licence"),
    ("zpl", "spdx", "spdx-license-identifier: {zpl-}[12]\\.[01]"),
    ("zpl", "name", "{zope} public licence(?:,? (?:version |v\\.? ?)?[12]\\.[01])?"),
    ("upl", "spdx", "spdx-license-identifier: {upl-}1\\.0"),
    ("upl", "name", "{universal} permissive licence(?:,? (?:version |v\\.? ?)?1\\.0)?"),
    ("mulan", "spdx", "spdx-license-identifier: {mulanpsl-}[12]\\.0"),
    ("mulan", "name", "{mulan} (?:permissive software|psl) licence(?:,? version [12])?"),
    ("json", "body", "the software shall be used for good,? not {evil}"),
    ("json", "name", "the {json} licence"),
    ("sgi-b", "name", "{sgi} free software licence b"),
    ("info-zip", "name", "{info-zip} licence"),
    ("intel-osl", "name", "{intel} open source licence"),
    ("lucent", "name", "{lucent} public licence"),
    ("nist", "body", "this software was developed at the {national} institute of standards and technology by employees of the federal government"),
    ("eiffel", "name", "{eiffel} forum licence"),
    ("fair", "name", "{fair} licence"),
    ("frameworx", "name", "{frameworx} licence"),
    ("motosoto", "name", "{motosoto} licence"),
    ("ntp", "name", "{ntp} licence"),
    ("xnet", "name", "{x.net} licence"),
    ("aladdin", "name", "{aladdin} free public licence"),
    ("matplotlib", "name", "{matplotlib} licence"),
    ("scala", "name", "{scala} licence"),
    ("openldap", "spdx", "spdx-license-identifier: {oldap-}2\\.8"),
    ("openldap", "name", "{openldap} public licence"),
    ("blue-oak", "spdx", "spdx-license-identifier: {blueoak-}1\\.0\\.0"),
    ("blue-oak", "name", "{blue} oak model licence"),
    # source available and closed
    ("elastic", "spdx", "spdx-license-identifier: {elastic-}2\\.0"),
    ("elastic", "notice", "licenced under the {elastic} licence"),
    ("elastic", "name", "{elastic} licence(?:,? (?:version |v\\.? ?)?[12]\\.0)?"),
    ("sspl", "spdx", "spdx-license-identifier: {sspl-}1\\.0"),
    ("sspl", "name", "server side {public} licence"),
    ("busl", "spdx", "spdx-license-identifier: {busl-}1\\.1"),
    ("busl", "body", "use of this software is governed by the {business} source licence"),
    ("busl", "name", "{business} source licence(?:,? (?:version |v\\.? ?)?1\\.1)?"),
    ("commons-clause", "notice", "{commons} clause licence condition"),
    ("commons-clause", "body", "the grant of rights under the licence will not include,? and the licence does not grant to you,? the right to {sell} the software"),
    ("confluent", "name", "{confluent} community licence"),
    ("polyform", "name", "{polyform} (?:noncommercial|small business|shield|strict|perimeter) licence"),
    ("parity", "name", "the {parity} public licence"),
    ("prosperity", "name", "the {prosperity} public licence"),
    ("hippocratic", "name", "{hippocratic} licence"),
    ("rail", "name", "(?:open|creativeml|bigscience)[- ](?:open)?{rail}(?:-[ms+]+)? licence"),
    ("llama", "name", "{llama}(?: [0-9.]+)? community licence(?: agreement)?"),
    ("research-only", "notice", "for (?:non-?commercial )?{research} (?:use|purposes) only"),
    ("non-commercial", "notice", "for non-?{commercial} use only"),
    ("proprietary", "notice", "{proprietary} and confidential"),
    ("proprietary", "notice", "end[- ]user {licence} agreement"),
    ("proprietary", "notice", "unauthori[sz]ed {copying} of this file,? via any medium,? is strictly prohibited"),
    ("proprietary", "body", "no part of this (?:publication|book|document|work) may be {reproduced}"),
    ("proprietary", "hint", "all rights {reserved}"),
)

#: No word character (as the scanner counts words) before, or after.
LETTERS = "0-9a-z\u0080-\U0010ffff"
OPEN, SHUT = f"(?<![{LETTERS}])", f"(?![{LETTERS}])"
#: What may stand between two words: white space, and the marks of comments on wrapped lines.
GAP = r"[\s*#/]{1,12}"
#: Words that most signatures need; the others' keywords are added to them.
COMMON_ROOTS = ("licen", "opensource.org", "copyright", "permission", "permitted", "redistribut", "released", "distributed", "available", "published", "reserved")


def compiled(signature: str) -> tuple[str, str]:
    """(keyword, regular expression) of a signature."""
    keyword = re.search(r"\{([^}]*)\}", signature)[1]
    out = signature.replace("{" + keyword + "}", keyword.replace(".", r"\."))
    out = out.replace("license-identifier: ", r"license-identifier:[ \t]{0,8}").replace("licence", "licen[sc]e").replace(": ?", r":[ \t]{0,8}")
    blanks = re.sub(r"\[ \\t\]|\[- \]| ", lambda m: {"[- ]": f"(?:-|{GAP})", " ": GAP}.get(m[0], m[0]), out)
    return keyword.replace("licence", "licen"), OPEN + blanks + SHUT


@lru_cache(maxsize=1)
def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, regex, priority, weight) of every signature, in order."""
    return [(label, *compiled(signature), *KINDS[kind]) for label, kind, signature in SIGNATURES]


def _needed(signature: str) -> str:
    """What every match of a signature holds: without optional groups, and without choices unless each has a common root."""
    text = signature.replace("licence", "licen").replace("license", "licen").replace("{", "").replace("}", "")
    while (after := re.sub(r"\(\?:[^()]*\)\?|\[[^\]]*\][?*]?|.\?", " ", text)) != text:
        text = after
    rooted = lambda m: "licen" if all(any(r in c for r in COMMON_ROOTS) for c in m[1].split("|")) else " "
    return re.sub(r"\(\?:([^()]*)\)", rooted, text)


@lru_cache(maxsize=1)
def roots() -> tuple[str, ...]:
    """A text in which none of these occurs holds no base phrase and no detection: the scan looks about them only."""
    others = {re.search(r"\{([^}]*)\}", s)[1] for _, _, s in SIGNATURES if not any(r in _needed(s) for r in COMMON_ROOTS)}
    return COMMON_ROOTS + tuple(sorted(others))
