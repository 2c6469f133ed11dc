"""The ordered license rules: (rule, license, priority, keywords, pattern), most specific first within a family.

Patterns run case-insensitively over the text with every run of white space made one space (offsets are kept by
the scanner). keywords are lower-case strings of which every match of the pattern contains one: the prefilter. They are read off
the parsed pattern, with each optional part and alternative spelled out, so that none can be forgotten.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable
from re import _constants as C
from re import _parser

#: The most spellings that a stretch of a pattern is written out to.
SPELLINGS = 16

_V = r",? ?(?:version|v\.?|ver\.?)? ?"

#: license | full names and phrases that name it. A leading number is the priority of the phrase's kind (default 60).
_NAMES = r"""
Apache-2.0|(?:licensed|released|distributed|made available) under the (?:terms of the )?apache (?:software )?licen[sc]e@V2(?:\.0)?
Apache-2.0|apache (?:software )?licen[sc]e@V2(?:\.0)?
Apache-2.0|apache-2\.0(?: licen[sc]e)?
Apache-2.0|(?:https?://)?(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
Apache-1.1|apache software licen[sc]e@V1\.1
Apache-1.0|apache licen[sc]e@V1\.0
MIT|(?:licensed|released|distributed|available) under the (?:terms of the )?mit licen[sc]e
MIT|(?:the )?mit(?:/x11)? licen[sc]e
MIT|(?:https?://)?(?:www\.)?opensource\.org/licenses/mit(?:-license)?(?:\.php|\.html)?
MIT|permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT|the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
MIT-0|mit no attribution(?: licen[sc]e)?
X11|x11 licen[sc]e
GPL-3.0-or-later|gnu general public licen[sc]e@V3(?:\.0)?,? (?:or (?:\(at your option\) )?any later version|or later)
GPL-3.0-only|(?:licensed|released|distributed) under the (?:terms of the )?(?:gnu )?general public licen[sc]e@V3(?:\.0)?(?: only)?
GPL-3.0-only|(?:gnu )?general public licen[sc]e@V3(?:\.0)?
GPL-3.0-only|\b(?:gnu )?gpl ?-?v?3(?:\.0)?\b
GPL-2.0-or-later|(?:gnu )?general public licen[sc]e as published by the free software foundation; either version 2 of the licen[sc]e,? or \(at your option\) any later version
GPL-3.0-or-later|(?:gnu )?general public licen[sc]e as published by the free software foundation,? either version 3 of the licen[sc]e,? or \(at your option\) any later version
GPL-2.0-or-later|gnu general public licen[sc]e@V2(?:\.0)?,? (?:or (?:\(at your option\) )?any later version|or later)
GPL-2.0-only|(?:gnu )?general public licen[sc]e@V2(?:\.0)?
GPL-2.0-only|\b(?:gnu )?gpl ?-?v?2(?:\.0)?\b
GPL-1.0-only|(?:gnu )?general public licen[sc]e@V1(?:\.0)?
GPL-1.0-or-later|gnu general public licen[sc]e
GPL-1.0-or-later|(?:https?://)?(?:www\.)?gnu\.org/licenses/gpl(?:\.html|\.txt)?
GPL-3.0-only|(?:https?://)?(?:www\.)?gnu\.org/licenses/gpl-3\.0(?:\.[a-z]+)*
GPL-2.0-only|(?:https?://)?(?:www\.)?gnu\.org/licenses/old-licenses/gpl-2\.0(?:\.[a-z]+)*
LGPL-3.0-only|(?:gnu )?lesser general public licen[sc]e@V3(?:\.0)?
LGPL-2.1-or-later|(?:gnu )?lesser general public licen[sc]e@V2\.1,? (?:or (?:\(at your option\) )?any later version|or later)
LGPL-2.1-only|(?:gnu )?lesser general public licen[sc]e@V2\.1
LGPL-2.0-only|(?:gnu )?library general public licen[sc]e@V2(?:\.0)?
LGPL-2.0-or-later|(?:gnu )?library general public licen[sc]e
LGPL-2.1-or-later|(?:gnu )?lesser general public licen[sc]e
LGPL-2.1-only|\blgpl ?-?v?2\.1\b
LGPL-3.0-only|\blgpl ?-?v?3(?:\.0)?\b
LGPL-2.1-or-later|\blgpl\b
AGPL-3.0-or-later|(?:gnu )?affero general public licen[sc]e@V3(?:\.0)?,? (?:or (?:\(at your option\) )?any later version|or later)
AGPL-3.0-only|(?:gnu )?affero general public licen[sc]e@V3(?:\.0)?
AGPL-3.0-only|(?:gnu )?affero general public licen[sc]e
AGPL-3.0-only|\bagpl ?-?v?3(?:\.0)?\b
AGPL-1.0-only|affero general public licen[sc]e@V1(?:\.0)?
GFDL-1.3-or-later|gnu free documentation licen[sc]e@V1\.3,? or any later version
GFDL-1.3-only|gnu free documentation licen[sc]e@V1\.3
GFDL-1.2-only|gnu free documentation licen[sc]e@V1\.2
GFDL-1.1-or-later|(?:gnu )?free documentation licen[sc]e
BSD-4-Clause|4-clause bsd(?: licen[sc]e)?
BSD-4-Clause|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD-3-Clause|3-clause bsd(?: licen[sc]e)?
BSD-3-Clause|bsd 3-clause(?: "?(?:new|revised)"?)*(?: licen[sc]e)?
BSD-3-Clause|(?:the )?new bsd licen[sc]e
BSD-3-Clause|(?:the )?modified bsd licen[sc]e
BSD-3-Clause|(?:neither the name of .{1,120}? nor the names of its contributors|the names? of .{1,80}?) may (?:not )?be used to endorse or promote products derived from this software
BSD-3-Clause|(?:https?://)?(?:www\.)?opensource\.org/licenses/bsd-3-clause
BSD-2-Clause|2-clause bsd(?: licen[sc]e)?
BSD-2-Clause|bsd 2-clause(?: "?simplified"?)?(?: licen[sc]e)?
BSD-2-Clause|(?:the )?simplified bsd licen[sc]e
BSD-2-Clause|(?:the )?freebsd licen[sc]e
BSD-2-Clause|redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
BSD-2-Clause|(?:https?://)?(?:www\.)?opensource\.org/licenses/bsd-2-clause
BSD-1-Clause|1-clause bsd(?: licen[sc]e)?
0BSD|(?:bsd )?zero-clause bsd(?: licen[sc]e)?
BSD-3-Clause-Clear|(?:the )?clear bsd licen[sc]e
BSD-3-Clause|(?:the |a )?bsd(?:-style)? licen[sc]e
ISC|(?:the )?isc licen[sc]e
ISC|permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
MPL-2.0|mozilla public licen[sc]e@V2(?:\.0)?
MPL-1.1|mozilla public licen[sc]e@V1\.1
MPL-1.0|mozilla public licen[sc]e@V1\.0
MPL-2.0|(?:https?://)?(?:www\.)?mozilla\.org/mpl/2\.0/?
MPL-2.0|\bmpl 2\.0\b
EPL-2.0|eclipse public licen[sc]e@V2(?:\.0)?
EPL-1.0|eclipse public licen[sc]e@V1(?:\.0)?
EPL-2.0|(?:https?://)?(?:www\.)?eclipse\.org/legal/epl-2\.0/?
EPL-1.0|(?:https?://)?(?:www\.)?eclipse\.org/legal/epl-v10(?:\.html)?
CDDL-1.1|common development and distribution licen[sc]e(?: \(cddl\))?@V1\.1
CDDL-1.0|common development and distribution licen[sc]e(?: \(cddl\))?(?:@V1\.0)?
CPL-1.0|common public licen[sc]e(?:@V1\.0)?
IPL-1.0|ibm public licen[sc]e(?:@V1\.0)?
EUPL-1.2|european union public licen[sc]e@V1\.2
EUPL-1.1|european union public licen[sc]e@V1\.1
CECILL-2.1|cecill free software licen[sc]e agreement@V2\.1
CECILL-C|\bcecill-c(?: licen[sc]e)?
CECILL-B|\bcecill-b(?: licen[sc]e)?
Artistic-2.0|(?:the )?artistic licen[sc]e@V2(?:\.0)?
Artistic-1.0|(?:the )?artistic licen[sc]e(?:@V1\.0)?
Artistic-1.0-Perl|under the same terms as perl itself
BSL-1.0|boost software licen[sc]e(?:@V1\.0)?
Zlib|(?:the )?zlib(?:/libpng)? licen[sc]e
Zlib|this software is provided 'as-is', without any express or implied warranty
libpng-2.0|png reference library licen[sc]e@V2
Unlicense|(?:released |licensed )?(?:into the public domain )?(?:under )?the unlicen[sc]e
Unlicense|this is free and unencumbered software released into the public domain
Unlicense|(?:https?://)?(?:www\.)?unlicense\.org/?
WTFPL|do what the fuck you want to public licen[sc]e(?:@V2)?
WTFPL|\bwtfpl\b
CC0-1.0|\bcc0(?:[ -]1\.0)?(?: universal)?(?: public domain dedication)?
CC0-1.0|(?:https?://)?(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0/?
PDM-1.0|(?:https?://)?(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0/?
PostgreSQL|(?:the )?postgresql licen[sc]e
Python-2.0|(?:python software foundation|psf) licen[sc]e(?:@V2(?:\.0)?)?
PHP-3.01|(?:the )?php licen[sc]e@V3\.01
PHP-3.0|(?:the )?php licen[sc]e(?:@V3\.0)?
Ruby|(?:the )?ruby licen[sc]e
OpenSSL|(?:the )?openssl(?:/ssleay)? licen[sc]e
OFL-1.1|(?:sil )?open font licen[sc]e(?:@V1\.1)?
OFL-1.0|sil open font licen[sc]e@V1\.0
NCSA|university of illinois/ncsa open source licen[sc]e
MS-PL|microsoft public licen[sc]e(?: \(ms-pl\))?
MS-RL|microsoft reciprocal licen[sc]e(?: \(ms-rl\))?
AFL-3.0|academic free licen[sc]e(?:@V3\.0)?
AFL-2.1|academic free licen[sc]e@V2\.1
OSL-3.0|open software licen[sc]e@V3\.0
OSL-2.1|open software licen[sc]e@V2\.1
ECL-2.0|educational community licen[sc]e(?:@V2\.0)?
UPL-1.0|universal permissive licen[sc]e(?:@V1\.0)?
Vim|(?:the )?vim licen[sc]e
W3C|w3c software notice and licen[sc]e
JSON|the software shall be used for good, not evil
Beerware|(?:the )?"?beer-ware licen[sc]e"?
QPL-1.0|(?:the )?q public licen[sc]e(?:@V1\.0)?
SSPL-1.0|server side public licen[sc]e(?:@V1)?
BUSL-1.1|business source licen[sc]e(?:@V1\.1)?
Elastic-2.0|elastic licen[sc]e@V2(?:\.0)?
Commons-Clause|["']?commons clause["']? licen[sc]e condition(?:@V1\.0)?
ODbL-1.0|open (?:data commons )?(?:open )?database licen[sc]e(?:@V1\.0)?
ODC-By-1.0|open data commons attribution licen[sc]e(?:@V1\.0)?
PDDL-1.0|(?:open data commons )?public domain dedication and licen[sc]e(?:@V1\.0)?
CDLA-Permissive-2.0|community data licen[sc]e agreement\W{1,5}permissive@V2\.0
CDLA-Sharing-1.0|community data licen[sc]e agreement\W{1,5}sharing@V1\.0
OpenRAIL|\b(?:creativeml )?(?:bigscience )?open ?rail(?:\+\+)?(?:-[ms])?(?: licen[sc]e)?
OGL-UK-3.0|open government licen[sc]e@V3\.0
OGL-UK-2.0|open government licen[sc]e@V2\.0
LPPL-1.3c|latex project public licen[sc]e(?:@V1\.3c?)?
FTL|(?:the )?freetype (?:project )?licen[sc]e
IJG|this software is based in part on the work of the independent jpeg group
ICU|\bicu licen[sc]e
curl|\bcurl licen[sc]e
NTP|\bntp licen[sc]e
Sleepycat|(?:the )?sleepycat licen[sc]e
ZPL-2.1|zope public licen[sc]e(?:@V2\.1)?
EFL-2.0|eiffel forum licen[sc]e@V2(?:\.0)?
MulanPSL-2.0|mulan permissive software licen[sc]e@V2
BlueOak-1.0.0|blue oak model licen[sc]e(?: 1\.0\.0)?
Public-Domain|(?:is|placed|released|dedicated)(?: in| into| to)? the public domain
All-Rights-Reserved|all rights reserved
Proprietary|(?:this (?:file|software|document) is )?proprietary and confidential
Proprietary|unauthorized copying of this (?:file|software), via any medium,? is strictly prohibited
Apache-2.0|you may not use this file except in compliance with the licen[sc]e\. you may obtain a copy of the licen[sc]e at
Apache-2.0|unless required by applicable law or agreed to in writing, software distributed under the licen[sc]e is distributed on an "?as is"? basis
Apache-2.0|see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e
Apache-2.0|licensed to the apache software foundation \(asf\) under one or more contributor licen[sc]e agreements
Apache-2.0|subject to the terms and conditions of this licen[sc]e, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|\(except as stated in this section\) patent) licen[sc]e
Apache-2.0|\bal2\.0\b|\basl ?2\.0\b
Apache-1.1|this product includes software developed by the apache software foundation \(http://www\.apache\.org/\)
Apache-1.1|the names? "apache(?: server)?" and "apache (?:software foundation|group)" must not be used to endorse or promote products
Apache-2.0|"?apache"? and "?apache software foundation"? are trademarks of the apache software foundation under the apache-2 terms
MIT|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
MIT|in no event shall the authors or copyright holders be liable for any claim, damages or other liability
MIT|to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software
MIT|\bmit[- ]style licen[sc]e
MIT|\bexpat licen[sc]e
MIT|dual[- ]licensed under (?:the )?mit and (?:the )?(?:apache|gpl)
MIT-advertising|this permission notice shall be included in all copies of the software and its copyright notice in supporting documentation
MIT-CMU|permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted
MIT-feh|the above copyright notice and this permission notice shall be included in all copies of the software and its documentation and acknowledge?ment shall be given
MIT-0|permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files .{1,40}, to deal in the software without restriction, .{1,160}without attribution
MIT-Modern-Variant|provided that the above copyright notice and this permission notice appear in all copies, and that the software is provided as is
HPND|permission to use, copy, modify,? and distribute this software and its documentation for any purpose is hereby granted without fee, provided that the above copyright notice appears? in all copies
HPND-sell-variant|permission to use, copy, modify, distribute,? and sell this software and its documentation for any purpose is hereby granted without fee
X11|except as contained in this notice, the names? of .{1,80}? shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software
GPL-2.0-or-later|this program is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e
GPL-2.0-or-later|this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose
GPL-2.0-or-later|you should have received a copy of the gnu general public licen[sc]e along with this program
GPL-2.0-or-later|write to the free software foundation, inc\., (?:51 franklin st(?:reet)?|59 temple place|675 mass(?:achusetts)? ave(?:nue)?)
GPL-2.0-only|under the terms of (?:version 2 of the gnu general public licen[sc]e|the gnu general public licen[sc]e version 2) (?:only|as published by the free software foundation)
GPL-2.0-only|the licenses for most software are designed to take away your freedom to share and change it
GPL-3.0-only|under the terms of (?:version 3 of the gnu general public licen[sc]e|the gnu general public licen[sc]e version 3) (?:only|as published by the free software foundation)
GPL-3.0-only|the gnu general public licen[sc]e is a free, copyleft licen[sc]e for software and other kinds of works
GPL-3.0-only|\bgplv3\b
GPL-2.0-only|\bgplv2\b
GPL-3.0-or-later|\bgplv3(?:\+| or (?:later|any later version))
GPL-2.0-or-later|\bgplv2(?:\+| or (?:later|any later version))
GPL-1.0-or-later|(?:licensed|released|distributed) under the (?:terms of the )?gpl\b
GPL-2.0-with-classpath-exception|linking this library statically or dynamically with other modules is making a combined work based on this library
GPL-2.0-with-classpath-exception|\bgpl(?:v2)? with (?:the )?classpath exception
GPL-3.0-with-GCC-exception|gcc runtime library exception(?:, version 3\.1)?
GPL-2.0-with-font-exception|this font does not by itself cause the resulting document to be covered by the gnu general public licen[sc]e
GPL-2.0-with-bison-exception|you may create a larger work that contains part or all of the bison parser skeleton
GPL-2.0-with-autoconf-exception|respects in which the configure script contains no limitation on its distribution
GPL-2.0-with-openssl-exception|permission to link the code of portions of this program with the openssl library
LGPL-2.1-or-later|this library is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu lesser general public licen[sc]e
LGPL-2.1-or-later|you should have received a copy of the gnu lesser general public licen[sc]e along with this (?:library|program)
LGPL-2.0-or-later|you should have received a copy of the gnu library general public licen[sc]e along with this library
LGPL-3.0-only|this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3 of the gnu general public licen[sc]e
LGPL-2.1-only|(?:https?://)?(?:www\.)?gnu\.org/licenses/old-licenses/lgpl-2\.1(?:\.[a-z]+)*
LGPL-3.0-only|(?:https?://)?(?:www\.)?gnu\.org/licenses/lgpl-3\.0(?:\.[a-z]+)*
LGPL-3.0-or-later|(?:gnu )?lesser general public licen[sc]e@V3(?:\.0)?,? (?:or (?:\(at your option\) )?any later version|or later)
LGPL-2.1-only|\blgpl-?v?2\.1(?![.\d])
LGPL-3.0-only|\blgplv3\b
AGPL-3.0-only|(?:https?://)?(?:www\.)?gnu\.org/licenses/agpl-3\.0(?:\.[a-z]+)*
AGPL-3.0-or-later|you should have received a copy of the gnu affero general public licen[sc]e along with this program
AGPL-3.0-only|the gnu affero general public licen[sc]e is a free, copyleft licen[sc]e for software and other kinds of works, specifically designed to ensure cooperation with the community
AGPL-3.0-only|if your software can interact with users remotely through a computer network, you should also make sure that it provides a way for users to get its source
GFDL-1.2-or-later|permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[sc]e, version 1\.2
GFDL-1.3-or-later|permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[sc]e, version 1\.3
GFDL-1.3-no-invariants|with no invariant sections, no front-cover texts,? and no back-cover texts
GFDL-1.3-only|(?:https?://)?(?:www\.)?gnu\.org/licenses/fdl(?:-1\.3)?(?:\.html|\.txt)?
BSD-3-Clause|redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution
BSD-3-Clause|redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
BSD-3-Clause|this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?) "?as is"? and any express or implied warranties
BSD-4-Clause-UC|this product includes software developed by the university of california, (?:berkeley|lawrence berkeley laboratory) and its contributors
BSD-4-Clause|original bsd licen[sc]e
BSD-3-Clause|(?:three|3)[- ]clause bsd
BSD-2-Clause|(?:two|2)[- ]clause bsd
BSD-3-Clause-LBNL|you are under no obligation whatsoever to provide any bug fixes, patches, or upgrades to the features, functionality or performance of the source code
BSD-3-Clause-Clear|no express or implied licenses to any party's patent rights are granted by this licen[sc]e
BSD-2-Clause-Patent|bsd[- ]2[- ]clause (?:plus|\+) patent(?: licen[sc]e)?
BSD-2-Clause-Views|the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
BSD-3-Clause-No-Nuclear|licensed software is not designed,? (?:licensed or )?intended for use in the design, construction, operation or maintenance of any nuclear facility
BSD-Source-Code|redistributions of source code must retain the above copyright notice, this condition and the following disclaimer
0BSD|permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided "as is" and the author disclaims
0BSD|(?:bsd )?zero[- ]clause licen[sc]e
ISC|permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
ISC|the software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
MPL-2.0|this source code form is subject to the terms of the mozilla public licen[sc]e, v\. 2\.0
MPL-2.0|if a copy of the mpl was not distributed with this file, you can obtain one at
MPL-1.1|the contents of this file are subject to the mozilla public licen[sc]e version 1\.1
MPL-1.1|alternatively, the contents of this file may be used under the terms of either the gnu general public licen[sc]e version 2 or later
MPL-2.0-no-copyleft-exception|this source code form is "incompatible with secondary licenses", as defined by the mozilla public licen[sc]e
NPL-1.1|netscape public licen[sc]e(?:@V1\.[01])?
SPL-1.0|sun public licen[sc]e(?:@V1\.0)?
SISSL|sun industry standards source licen[sc]e(?:@V1\.[12])?
EPL-2.0|this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e 2\.0
EPL-1.0|this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1\.0
EPL-2.0|this source code may also be made available under the following secondary licenses when the conditions for such availability set forth in the eclipse public licen[sc]e
CDDL-1.0|the contents of this file are subject to the terms of the common development and distribution licen[sc]e
CDDL-1.0|you can obtain a copy of the licen[sc]e at .{1,60}opensolaris\.org/os/licensing
CDDL-1.1|\bcddl[ -]1\.1\b
CDDL-1.0|\bcddl[ -]1\.0\b
CPAL-1.0|common public attribution licen[sc]e(?:@V1\.0)?
RPL-1.5|reciprocal public licen[sc]e(?:@V1\.5)?
OCLC-2.0|oclc research public licen[sc]e(?:@V2\.0)?
RPSL-1.0|realnetworks public source licen[sc]e(?:@V1\.0)?
APSL-2.0|apple public source licen[sc]e(?:@V2(?:\.0)?)?
Watcom-1.0|sybase open watcom public licen[sc]e(?:@V1\.0)?
Nokia|nokia open source licen[sc]e
Motosoto|motosoto open source licen[sc]e
Intel|intel open source licen[sc]e
LPL-1.02|lucent public licen[sc]e(?:@V1\.02)?
CATOSL-1.1|computer associates trusted open source licen[sc]e(?:@V1\.1)?
CUA-OPL-1.0|cua office public licen[sc]e(?:@V1\.0)?
EUDatagrid|eu datagrid software licen[sc]e
Frameworx-1.0|frameworx open licen[sc]e(?:@V1\.0)?
Multics|multics licen[sc]e
NASA-1.3|nasa open source agreement(?:@V1\.3)?
NGPL|nethack general public licen[sc]e
OGTSL|open group test suite licen[sc]e
OSET-PL-2.1|oset public licen[sc]e(?:@V2\.1)?
SimPL-2.0|simple public licen[sc]e(?:@V2\.0)?
VSL-1.0|vovida software licen[sc]e(?:@V1\.0)?
Xnet|x\.net licen[sc]e
wxWindows|wxwindows library licen[sc]e(?:@V3\.1)?
gSOAP-1.3b|gsoap public licen[sc]e(?:@V1\.3b?)?
EUPL-1.2|licensed under the eupl,? (?:version )?1\.2
EUPL-1.1|licensed under the eupl,? (?:version )?1\.1
EUPL-1.2|\beupl[ -]v?1\.2\b
CECILL-2.1|ce logiciel est r[eé]gi par la licence cecill soumise au droit fran[cç]ais
CECILL-2.0|cecill free software licen[sc]e agreement@V2\.0
CECILL-1.0|\bcecill(?: licen[sc]e)?(?:@V1(?:\.0)?)?\b
LiLiQ-R-1.1|licence libre du qu[eé]bec
CERN-OHL-S-2.0|cern open hardware licen[sc]e(?:@V2)? ?(?:-|–) ?strongly reciprocal
CERN-OHL-W-2.0|cern open hardware licen[sc]e(?:@V2)? ?(?:-|–) ?weakly reciprocal
CERN-OHL-P-2.0|cern open hardware licen[sc]e(?:@V2)? ?(?:-|–) ?permissive
TAPR-OHL-1.0|tapr open hardware licen[sc]e(?:@V1\.0)?
SHL-2.1|solderpad hardware licen[sc]e(?:@V2\.1)?
Artistic-2.0|everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document, but changing it is not allowed\. preamble this licen[sc]e establishes the terms under which a given free software package
Artistic-1.0-Perl|this (?:library|program|module) is free software[;,] you (?:can|may) redistribute it and/or modify it under the same terms as perl
ClArtistic|clarified artistic licen[sc]e
BSL-1.0|permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e
BSL-1.0|(?:https?://)?(?:www\.)?boost\.org/license_1_0\.txt
Zlib|altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
Zlib|the origin of this software must not be misrepresented; you must not claim that you wrote the original software
libpng-2.0|this code is released under the libpng licen[sc]e
bzip2-1.0.6|bzip2 and libbzip2 licen[sc]e
Info-ZIP|info-zip licen[sc]e
Unlicense|anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
WTFPL|you just do what the fuck you want to
CC0-1.0|to the extent possible under law, .{1,80}? (?:has|have) waived all copyright and related or neighboring rights
CC0-1.0|dedicated (?:it )?to the public domain .{0,60}?cc0
PostgreSQL|permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
Python-2.0|psf hereby grants licensee a nonexclusive, royalty-free, world-wide licen[sc]e to reproduce
Python-2.0|(?:https?://)?docs\.python\.org/(?:3/)?license(?:\.html)?
CNRI-Python|cnri open source licen[sc]e agreement
PHP-3.01|this product includes php(?: software)?, freely available from <?(?:https?://)?(?:www\.)?php\.net
Ruby|you (?:can|may) redistribute (?:it|ruby) and/or modify it under either the terms of the (?:2-clause bsdl|gpl)
OpenSSL|this product includes software developed by the openssl project for use in the openssl toolkit
SSLeay|this product includes cryptographic software written by eric young
OFL-1.1|this font software is licensed under the sil open font licen[sc]e
OFL-1.1|(?:https?://)?scripts\.sil\.org/ofl
OFL-1.1|neither the font software nor any of its individual components, in original or modified versions, may be sold by itself
Ubuntu-font-1.0|ubuntu font licen[sc]e(?:@V1\.0)?
Bitstream-Vera|bitstream vera fonts? copyright
Arphic-1999|arphic public licen[sc]e
NCSA|neither the names? of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
NCSA|permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the "software"\), to deal with the software without restriction
MS-PL|if you bring a patent claim against any contributor over patents that you claim are infringed by the software
MS-RL|for any file you distribute that contains code from the software \(in source code or binary format\), you must provide recipients the source code to that file
MS-LPL|microsoft limited public licen[sc]e
ECL-2.0|licensed under the educational community licen[sc]e
UPL-1.0|subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data
W3C|permission to copy, modify, and distribute this (?:software and its documentation|work),? with or without modification, for any purpose and without fee or royalty is hereby granted
W3C-20150513|w3c software and document notice and licen[sc]e
Beerware|as long as you retain this notice you can do whatever you want with this stuff
QPL-1.0|\bqpl[ -]1\.0\b
SSPL-1.0|if you make the functionality of the program or a modified version available to third parties as a service, you must make the service source code available
BUSL-1.1|the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work
Elastic-2.0|you may not provide the software to third parties as a hosted or managed service
Commons-Clause|the grant of rights under the licen[sc]e will not include, and the licen[sc]e does not grant to you, the right to sell the software
PolyForm-Noncommercial-1.0.0|polyform noncommercial licen[sc]e(?: 1\.0\.0)?
PolyForm-Small-Business-1.0.0|polyform small business licen[sc]e(?: 1\.0\.0)?
PolyForm-Shield-1.0.0|polyform shield licen[sc]e(?: 1\.0\.0)?
Parity-7.0.0|the parity public licen[sc]e(?: 7\.0\.0)?
Prosperity-3.0.0|the prosperity public licen[sc]e(?: 3\.0\.0)?
Hippocratic-2.1|hippocratic licen[sc]e(?:@V2\.1)?
Anti-996|anti-996 licen[sc]e(?:@V1\.0)?
ODbL-1.0|(?:https?://)?(?:www\.)?opendatacommons\.org/licenses/odbl(?:/1[-.]0)?/?
ODC-By-1.0|(?:https?://)?(?:www\.)?opendatacommons\.org/licenses/by(?:/1[-.]0)?/?
PDDL-1.0|(?:https?://)?(?:www\.)?opendatacommons\.org/licenses/pddl(?:/1[-.]0)?/?
CDLA-Permissive-1.0|community data licen[sc]e agreement\W{1,5}permissive@V1\.0
DL-DE-BY-2.0|datenlizenz deutschland\W{1,5}namensnennung\W{1,5}version 2\.0
DL-DE-ZERO-2.0|datenlizenz deutschland\W{1,5}zero\W{1,5}version 2\.0
etalab-2.0|licence ouverte(?: ?/ ?open licence)?(?:@V2\.0)?
NLOD-2.0|norwegian licence for open government data(?: \(nlod\))?(?:@V2\.0)?
OGL-Canada-2.0|open government licence\W{1,5}canada
OGL-UK-3.0|contains public sector information licensed under the open government licence v3\.0
OpenRAIL|use-based restrictions (?:as referenced )?in paragraph 5
Llama-2|llama 2 community licen[sc]e agreement
Llama-3|llama 3(?:\.[0-9])? community licen[sc]e agreement
Gemma|gemma terms of use
LPPL-1.3c|this work may be distributed and/or modified under the conditions of the latex project public licen[sc]e
FTL|portions of this software are copyright .{1,40}? the freetype project
ICU|icu licen[sc]e\W{1,5}icu 1\.8\.1 and later
Unicode-DFS-2016|unicode,? inc\.? licen[sc]e agreement\W{1,5}data files and software
Unicode-TOU|unicode terms of use
curl|permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, .{0,80}?curl\b
Sleepycat|redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
Vim|there are no restrictions on distributing unmodified copies of vim
TCL|the authors hereby grant permission to use, copy, modify, distribute, and licen[sc]e this software and its documentation for any purpose
SMLNJ|standard ml of new jersey copyright notice
Naumen|naumen public licen[sc]e
Entessa|entessa public licen[sc]e(?:@V1\.0)?
Fair|usage of the works is permitted provided that this instrument is retained with the works
MirOS|the miros licen[sc]e
Public-Domain|no rights reserved
Public-Domain|this (?:file|code|work|document|text) is (?:hereby )?(?:in|placed in|released into) the public domain
All-Rights-Reserved|no part of this (?:publication|book|work|document) may be reproduced
Proprietary|may not be (?:reproduced|copied|distributed),? .{0,60}?without (?:the )?(?:express |prior |written )+(?:permission|consent)
Proprietary|this (?:software|document|information) contains (?:confidential|proprietary) (?:and (?:confidential|proprietary) )?information
"""

#: Creative Commons: the version is read off the match. Priority, name and pattern; @N ends an address or a name.
_CC = r"""
90|CC-BY-NC-ND-{v}|(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-nc-nd/@N/?
90|CC-BY-NC-SA-{v}|(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-nc-sa/@N/?
90|CC-BY-NC-{v}|(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-nc/@N/?
90|CC-BY-ND-{v}|(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-nd/@N/?
90|CC-BY-SA-{v}|(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-sa/@N/?
90|CC-BY-{v}|(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by/@N/?
70|CC-BY-NC-ND-{v}|\bcc[ -]by-nc-nd[ -]?v?@N
70|CC-BY-NC-SA-{v}|\bcc[ -]by-nc-sa[ -]?v?@N
70|CC-BY-NC-{v}|\bcc[ -]by-nc[ -]?v?@N
70|CC-BY-ND-{v}|\bcc[ -]by-nd[ -]?v?@N
70|CC-BY-SA-{v}|\bcc[ -]by-sa[ -]?v?@N
70|CC-BY-{v}|\bcc[ -]by[ -]?v?@N
70|CC-BY-NC-ND-{v}|(?:creative commons )?attribution[- ]non-?commercial[- ]no ?deriv(?:ative)?s?(?: licen[sc]e)?,? (?:version )?@N(?: international| unported| generic)?(?: licen[sc]e)?
70|CC-BY-NC-SA-{v}|(?:creative commons )?attribution[- ]non-?commercial[- ]share[- ]?alike(?: licen[sc]e)?,? (?:version )?@N(?: international| unported| generic)?(?: licen[sc]e)?
70|CC-BY-NC-{v}|(?:creative commons )?attribution[- ]non-?commercial(?: licen[sc]e)?,? (?:version )?@N(?: international| unported| generic)?(?: licen[sc]e)?
70|CC-BY-ND-{v}|(?:creative commons )?attribution[- ]no ?deriv(?:ative)?s?(?: licen[sc]e)?,? (?:version )?@N(?: international| unported| generic)?(?: licen[sc]e)?
70|CC-BY-SA-{v}|(?:creative commons )?attribution[- ]share[- ]?alike(?: licen[sc]e)?,? (?:version )?@N(?: international| unported| generic)?(?: licen[sc]e)?
70|CC-BY-{v}|(?:creative commons )?attribution(?: licen[sc]e)?,? (?:version )?@N(?: international| unported| generic)?(?: licen[sc]e)?
"""
_N = r"(?P<v>4\.0|3\.0|2\.5|2\.0|1\.0)(?!\.?\d)"

#: Ids that a tag may name, in their own spelling; another id is reported as the tag has it.
_SPDX = (
    "0BSD AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause "
    "BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 "
    "CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-2.1 CECILL-B CECILL-C CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 "
    "EUPL-1.1 EUPL-1.2 FTL GFDL-1.2-only GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only "
    "GPL-3.0-or-later ICU IJG IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 "
    "MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NTP ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OGL-UK-3.0 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL "
    "Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()


def _least(words: Iterable[str]) -> frozenset[str]:
    """The words that contain no other one: who contains any of ``words`` contains one of these."""
    words = set(words)
    return frozenset(w for w in words if not any(x != w and x in w for x in words))


def _spellings(node: tuple) -> set[str] | None:
    """All texts that a part of a pattern matches, in lower case, or None if they are too many."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.AT:
        return {""}
    if op is C.IN and all(k is C.LITERAL for k, _ in arg):
        return {chr(c).lower() for _, c in arg}
    if op is C.SUBPATTERN:
        return _product(arg[3])
    if op is C.BRANCH:
        found = [_product(x) for x in arg[1]]
        return None if None in found or len(set().union(*found)) > SPELLINGS else set().union(*found)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
        found = _product(arg[2])
        return found if found is None or arg[0] else found | {""}
    return None


def _product(parts: Iterable[tuple]) -> set[str] | None:
    out = {""}
    for node in parts:
        found = _spellings(node)
        if found is None or len(out) * len(found) > SPELLINGS:
            return None
        out = {a + b for a, b in itertools.product(out, found)}
    return out


def _required(parts: Iterable[tuple]) -> frozenset[str]:
    """Words of which every text that the parts match contains one; the set whose shortest word is longest. Empty if there is none."""
    stretches: list[Iterable[str]] = [{""}]
    for node in parts:
        op, arg = node
        found = _spellings(node)
        if found is not None:
            joined = {a + b for a, b in itertools.product(stretches[-1], found)}
            if len(joined) <= SPELLINGS:
                stretches[-1] = joined
            else:
                stretches.append(found)
            continue
        if op is C.SUBPATTERN:
            stretches.append(_required(arg[3]))
        elif op is C.BRANCH:
            each = [_required(x) for x in arg[1]]
            stretches.append(frozenset().union(*each) if all(each) else ())
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
            stretches.append(_required(arg[2]))
        stretches.append({""})
    sets = [_least(s) for s in stretches if s and "" not in s]
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())


def keywords(pattern: str) -> tuple[str, ...]:
    found = _required(_parser.parse(pattern))
    if not found:
        raise ValueError(f"no keyword in every match of {pattern}")
    return tuple(sorted(found))


_ID = r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?"
#: The rule of tags: one id, or several with operators between them.
TAG = rf"spdx-license-identifier: ?(?P<id>{_ID}(?: (?:or|and|with) {_ID})*)"
_SPELLED = {i.lower(): i for i in _SPDX}


def spelled(expression: str) -> str:
    """The ids of a tag in their own spelling, operators in capitals."""
    return " ".join(w.upper() if w.lower() in ("or", "and", "with") else _SPELLED.get(w.lower(), w) for w in expression.split(" "))


def rules() -> list[tuple[str, str, int, tuple[str, ...], str]]:
    """All rules. Priorities: SPDX tags 100, addresses 90, Creative Commons 70, names and phrases 60 (in their order), general ones 20. A
    license in braces is read off the match's group of that name."""
    out = [("tag", "{id}", 100, TAG)]
    seen: dict[str, int] = {}
    for line in _NAMES.strip().split("\n"):
        name, pattern = line.split("|", 1)
        seen[name] = seen.get(name, 0) + 1
        priority = 90 if "http" in pattern else 20 if name in ("Public-Domain", "All-Rights-Reserved", "Proprietary") else 60
        out.append((f"name:{name}:{seen[name]}", name, priority, pattern.replace("@V", _V)))
    for i, line in enumerate(_CC.strip().split("\n"), 1):
        priority, name, pattern = line.split("|", 2)
        out.append((f"cc:{name}:{i}", name, int(priority), pattern.replace("@N", _N)))
    return [(rule, name, priority, keywords(pattern), pattern) for rule, name, priority, pattern in out]
