"""License scans (5): ordered signature rules, gated by keywords, with suppression of overlapping detections.

A text is lower-cased (A-Z) and reduced to its words, joined by single spaces, so punctuation, line ends and the
dots of versions don't matter. All keywords are looked for at once; a rule's pattern runs only where its keyword
stands. Detections are ordered by priority, then length, then rule; one whose words lie within a detection that
already stands is suppressed, so "licensed under the apache license version 2 0" is one detection, not three.

The notices are written by hand, from the headers and clauses that licences have. A table of titles adds what every
licence may have: its declaration, the sentence that grants it, its title and its address.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import arrow_schema, documents, ship, slices

#: label | keyword that every match holds | title, as a pattern over words | identifier, as a pattern | address, as a pattern
LICENCES = r"""
apache-2.0|apache|apache (?:software )?licen[sc]e(?: version)? 2(?: 0)?|apache 2(?: 0)?|apache org licenses license 2 0
apache-1.1|apache|apache (?:software )?licen[sc]e(?: version)? 1 1|apache 1 1|apache org licenses license 1 1
apache|apache|apache (?:software )?licen[sc]e|apache|apache org licenses
mit|mit|mit (?:x11 )?licen[sc]e|mit|opensource org licenses mit
mit-0|mit|mit no attribution(?: licen[sc]e)?|mit 0|opensource org licenses mit 0
gpl-3.0|general|gnu general public licen[sc]e (?:as published by the free software foundation (?:either )?)?(?:version|v) ?3(?: 0)?|gpl ?v?3(?: 0)?(?: only| or later)?|gnu org licenses gpl 3 0
gpl-2.0|general|gnu general public licen[sc]e (?:as published by the free software foundation (?:either )?)?(?:version|v) ?2(?: 0)?|gpl ?v?2(?: 0)?(?: only| or later)?|gnu org licenses (?:old licenses )?gpl 2 0
gpl-1.0|general|gnu general public licen[sc]e (?:version|v) ?1(?: 0)?|gpl ?v?1(?: 0)?(?: only| or later)?|gnu org licenses old licenses gpl 1 0
gpl|general|gnu general public licen[sc]e|gpl|gnu org licenses gpl
lgpl-3.0|lesser|gnu lesser general public licen[sc]e (?:version|v) ?3(?: 0)?|lgpl ?v?3(?: 0)?(?: only| or later)?|gnu org licenses lgpl 3 0
lgpl-2.1|lesser|gnu lesser general public licen[sc]e (?:version|v) ?2 1|lgpl ?v?2 1(?: only| or later)?|gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-2.0|library|gnu library general public licen[sc]e|lgpl ?v?2(?: 0)(?: only| or later)?|gnu org licenses old licenses lgpl 2 0
lgpl|lesser|gnu lesser general public licen[sc]e|lgpl|gnu org licenses lgpl
agpl-3.0|affero|gnu affero general public licen[sc]e (?:version|v) ?3(?: 0)?|agpl ?v?3(?: 0)?(?: only| or later)?|gnu org licenses agpl 3 0
agpl|affero|(?:gnu )?affero general public licen[sc]e|agpl|gnu org licenses agpl
gfdl|documentation|gnu free documentation licen[sc]e|gfdl(?: 1 [123])?|gnu org licenses fdl
bsd-2-clause|bsd|(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?|bsd 2 clause|opensource org licenses bsd 2 clause
bsd-3-clause|bsd|(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?|bsd 3 clause|opensource org licenses bsd 3 clause
bsd-4-clause|bsd|(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?|bsd 4 clause|spdx org licenses bsd 4 clause
0bsd|bsd|(?:zero clause bsd|bsd zero clause|free public licen[sc]e 1 0 0)(?: licen[sc]e)?|0bsd|opensource org licenses 0bsd
bsd|bsd|bsd(?: style)? licen[sc]e|bsd|opensource org licenses bsd license
isc|isc|isc licen[sc]e|isc|opensource org licenses isc
mpl-2.0|mozilla|mozilla public licen[sc]e (?:version|v) ?2(?: 0)?|mpl ?2(?: 0)?|mozilla org (?:en us )?mpl 2 0
mpl-1.1|mozilla|mozilla public licen[sc]e (?:version|v) ?1 1|mpl ?1 1|mozilla org mpl 1 1
mpl|mozilla|mozilla public licen[sc]e|mpl|mozilla org mpl
epl-2.0|eclipse|eclipse public licen[sc]e (?:version|v) ?2(?: 0)?|epl ?v?2(?: 0)?|eclipse org legal epl 2 0
epl-1.0|eclipse|eclipse public licen[sc]e (?:version|v) ?1(?: 0)?|epl ?v?1(?: 0)?|eclipse org legal epl v10
edl-1.0|eclipse|eclipse distribution licen[sc]e|edl 1 0|eclipse org org documents edl
cddl-1.0|distribution|common development and distribution licen[sc]e|cddl(?: 1 [01])?|opensource org licenses cddl 1 0
cpl-1.0|common|common public licen[sc]e|cpl 1 0|opensource org licenses cpl 1 0
ipl-1.0|ibm|ibm public licen[sc]e|ipl 1 0|opensource org licenses ipl 1 0
artistic-2.0|artistic|artistic licen[sc]e (?:version |v )?2(?: 0)?|artistic 2 0|opensource org licenses artistic 2 0
artistic|artistic|artistic licen[sc]e|artistic(?: 1 0)?|opensource org licenses artistic
boost-1.0|boost|boost software licen[sc]e|bsl 1 0|boost org license 1 0
zlib|zlib|zlib (?:libpng )?licen[sc]e|zlib|zlib net zlib license
libpng|libpng|libpng licen[sc]e|libpng(?: 2 0)?|libpng org pub png src libpng license
unlicense|unlicense|the unlicense|unlicense|unlicense org
wtfpl|wtfpl|wtfpl|wtfpl|wtfpl net
cc0-1.0|cc0|cc0(?: 1 0)?(?: universal)?|cc0(?: 1 0)?|creativecommons org publicdomain zero 1 0
cc-by-4.0|attribution|creative commons attribution 4 0(?: international)?|cc by 4 0|creativecommons org licenses by 4 0
cc-by-3.0|attribution|creative commons attribution 3 0(?: unported)?|cc by 3 0|creativecommons org licenses by 3 0
cc-by-sa-4.0|alike|creative commons attribution share ?alike 4 0(?: international)?|cc by sa 4 0|creativecommons org licenses by sa 4 0
cc-by-sa-3.0|alike|creative commons attribution share ?alike 3 0(?: unported)?|cc by sa 3 0|creativecommons org licenses by sa 3 0
cc-by-sa|alike|creative commons attribution share ?alike|cc by sa|creativecommons org licenses by sa
cc-by-nc-sa|alike|creative commons attribution non ?commercial share ?alike|cc by nc sa(?: [34] 0)?|creativecommons org licenses by nc sa
cc-by-nc-nd|commercial|creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd(?: [34] 0)?|creativecommons org licenses by nc nd
cc-by-nc|commercial|creative commons attribution non ?commercial|cc by nc(?: [34] 0)?|creativecommons org licenses by nc
cc-by-nd|attribution|creative commons attribution no ?deriv(?:ative)?s|cc by nd(?: [34] 0)?|creativecommons org licenses by nd
cc-by|attribution|creative commons attribution|cc by|creativecommons org licenses by
odbl-1.0|database|open (?:data commons open )?database licen[sc]e|odbl(?: 1 0)?|opendatacommons org licenses odbl
odc-by-1.0|commons|open data commons attribution licen[sc]e|odc by(?: 1 0)?|opendatacommons org licenses by
pddl-1.0|dedication|(?:open data commons )?public domain dedication and licen[sc]e|pddl(?: 1 0)?|opendatacommons org licenses pddl
ofl-1.1|font|sil open font licen[sc]e|ofl(?: 1 1)?|scripts sil org ofl
eupl-1.2|european|european union public licen[sc]e|eupl(?: 1 [12])?|joinup ec europa eu software page eupl
afl-3.0|academic|academic free licen[sc]e|afl(?: 3 0)?|opensource org licenses afl 3 0
osl-3.0|open|open software licen[sc]e|osl(?: 3 0)?|opensource org licenses osl 3 0
ms-pl|microsoft|microsoft public licen[sc]e|ms pl|opensource org licenses ms pl
ms-rl|microsoft|microsoft reciprocal licen[sc]e|ms rl|opensource org licenses ms rl
python-2.0|python|python software foundation licen[sc]e|psf 2 0|python org psf license
ruby|ruby|ruby licen[sc]e|ruby|ruby lang org en about license
php-3.01|php|php licen[sc]e|php 3 01|php net license 3 01
perl|perl|same terms as perl(?: itself)?|perl|dev perl org licenses
openssl|openssl|openssl licen[sc]e|openssl|openssl org source license
postgresql|postgresql|postgresql licen[sc]e|postgresql|opensource org licenses postgresql
vim|vim|vim licen[sc]e|vim|vimhelp org uganda
upl-1.0|universal|universal permissive licen[sc]e|upl(?: 1 0)?|opensource org licenses upl
ncsa|ncsa|(?:university of illinois )?ncsa (?:open source )?licen[sc]e|ncsa|opensource org licenses ncsa
bsl-1.1|business|business source licen[sc]e|busl 1 1|mariadb com bsl11
sspl-1.0|side|server side public licen[sc]e|sspl(?: 1 0)?|mongodb com licensing server side public license
elastic-2.0|elastic|elastic licen[sc]e(?: 2 0)?|elastic 2 0|elastic co licensing elastic license
"""
#: Kinds of rules: name, priority (higher stands first), score, pattern with {t} for the title, {i} for the identifier, {u} for the address.
KINDS = (
    ("declaration", 90, 1.0, r"spdx licen[sc]e identifier {i}"),
    ("notice", 80, 0.95, r"(?:re)?(?:licen[sc]ed|released|distributed|available|published|covered) (?:under|by) (?:the )?(?:terms of (?:the )?)?{t}"),
    ("address", 70, 0.9, r"(?:https? )?(?:www )?{u}"),
    ("title", 50, 0.8, r"{t}"),
)
#: Notices and clauses: label, keyword, pattern.
CLAUSES = r"""
mit|hereby|permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files the software)?
mit|sublicense|to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit|substantial|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit|merchantability|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit|holders|in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit|mit|licensed under the mit license see (?:the )?(?:license|copying)(?: file)?
mit|root|(?:mit|x11) style licen[sc]e that can be found in the license file in the root
mit-0|hereby|permission is hereby granted free of charge .{1,120}? without restriction .{1,160}? to permit persons to whom the software is furnished to do so the software is provided
x11|advertising|the name of the x consortium shall not be used in advertising
x11|consortium|x consortium be liable for any claim damages or other liability
isc|purpose|permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc|disclaims|the software is provided as is and the author disclaims all warranties with regard to this software
isc|tortious|whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software
0bsd|fee|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd|redistribution|redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
bsd|retain|redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer
bsd|reproduce|redistributions in binary form must reproduce the (?:above )?copyright notice this list of conditions and the following disclaimer
bsd|contributors|this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd|consequential|be liable for any direct indirect incidental special exemplary or consequential damages
bsd|regents|this software is provided by the regents and contributors as is
bsd-3-clause|endorse|neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-3-clause|endorse|the names? of .{1,60}? may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause|governed|use of this source code is governed by a bsd style licen[sc]e(?: that can be found in the license file)?
bsd-4-clause|advertising|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause-patent|receiving|each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide
bsd-1-clause|retain|redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided
bsd-3-clause-clear|patent|no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e
gpl|redistribute|this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl|redistribute|(?:this|it) is free software you (?:can|may) redistribute it and or modify it
gpl-3.0-or-later|later|gnu general public licen[sc]e as published by the free software foundation either version 3 (?:of the licen[sc]e )?or at your option any later version
gpl-2.0-or-later|later|gnu general public licen[sc]e as published by the free software foundation either version 2 (?:of the licen[sc]e )?or at your option any later version
gpl-1.0-or-later|later|gnu general public licen[sc]e as published by the free software foundation either version 1 (?:of the licen[sc]e )?or at your option any later version
gpl-2.0-only|foundation|gnu general public licen[sc]e version 2 as published by the free software foundation
gpl-3.0-only|foundation|gnu general public licen[sc]e version 3 as published by the free software foundation
gpl-2.0-only|only|gpl (?:v|version )?2 only
gpl-3.0-only|only|gpl (?:v|version )?3 only
gpl-2.0-or-later|later|gpl (?:v|version )?2 or (?:any )?later
gpl-3.0-or-later|later|gpl (?:v|version )?3 or (?:any )?later
gpl|fitness|distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e
gpl|received|you should have received a copy of the gnu general public licen[sc]e along with (?:this|the) (?:program|software|library|package)
gpl|copyleft|the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works
gpl|preamble|gnu general public licen[sc]e version [123](?: 0)? .{0,60}?preamble
gpl|verbatim|everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document
gpl-2.0-classpath|linking|linking this library statically or dynamically with other modules is making a combined work
gpl-classpath-exception|classpath|(?:with (?:the )?)?classpath exception(?: 2 0)?
gpl-gcc-exception|runtime|gcc runtime library exception(?: 3 1)?
gpl-autoconf-exception|autoconf|(?:with (?:the )?)?autoconf exception
gpl-bison-exception|bison|special exception .{1,120}? bison parser skeleton
gpl-font-exception|embeds|as a special exception if you create a document which uses this font and embeds this font
gpl-linking-exception|exception|as a special exception .{1,80}? permission to link (?:the code of )?(?:this|the) (?:program|library|portions)
gpl-openssl-exception|openssl|permission to link .{1,60}? with the openssl (?:project s openssl )?library
lgpl|redistribute|this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e
lgpl-2.1-or-later|later|gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 (?:of the licen[sc]e )?or at your option any later version
lgpl-3.0-or-later|later|gnu lesser general public licen[sc]e as published by the free software foundation either version 3 (?:of the licen[sc]e )?or at your option any later version
lgpl-2.0-or-later|library|gnu library general public licen[sc]e as published by the free software foundation either version 2 (?:of the licen[sc]e )?or at your option any later version
lgpl-2.1-only|lesser|gnu lesser general public licen[sc]e version 2 1 as published by the free software foundation
lgpl|lesser|see the gnu lesser general public licen[sc]e for more details
lgpl|received|you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this (?:library|program)
lgpl-2.1|lgpl|licensed under (?:the )?lgpl ?(?:v|version )?2 1
agpl-3.0-or-later|affero|gnu affero general public licen[sc]e as published by the free software foundation either version 3 (?:of the licen[sc]e )?or at your option any later version
agpl-3.0-only|affero|gnu affero general public licen[sc]e version 3 as published by the free software foundation
agpl-3.0|affero|see the gnu affero general public licen[sc]e for more details
agpl-3.0|interacting|all users interacting with it remotely through a computer network
apache-2.0|compliance|you may not use this (?:file|work|software) except in compliance with the licen[sc]e
apache-2.0|obtain|you may obtain a copy of the licen[sc]e at (?:https? )?(?:www )?apache org licenses license 2 0
apache-2.0|agreed|unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis
apache-2.0|governing|see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e
apache-2.0|contributor|licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements
apache-2.0|reproduction|terms and conditions for use reproduction and distribution 1 definitions
apache-2.0|irrevocable|perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e to reproduce prepare derivative works
apache-1.1|apache|this product includes software developed by the apache (?:software foundation|group)
apache-2.0-llvm|llvm|apache licen[sc]e v(?:ersion )?2 0 with llvm exceptions
llvm|llvm|part of the llvm project under the apache licen[sc]e
mpl-2.0|mozilla|this source code form is subject to the terms of the mozilla public licen[sc]e(?: v 2 0)?
mpl-2.0|distributed|if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0|incompatible|this source code form is incompatible with secondary licenses as defined by the mozilla public licen[sc]e
mpl-1.1|mozilla|the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl-1.0|mozilla|the contents of this file are subject to the mozilla public licen[sc]e version 1 0
mpl-1.1|alternatively|alternatively the contents of this file may be used under the terms of either the gnu general public licen[sc]e version 2
npl-1.1|netscape|the contents of this file are subject to the netscape public licen[sc]e version 1 1
epl-1.0|eclipse|made available under the terms of the eclipse public licen[sc]e v1 0
epl-2.0|eclipse|made available under the terms of the eclipse public licen[sc]e 2 0
epl-2.0|secondary|this source code may also be made available under the following secondary licenses when the conditions for such availability set forth in the eclipse public licen[sc]e
edl-1.0|eclipse|available under the terms of the eclipse distribution licen[sc]e v 1 0
cddl-1.0|distribution|the contents of this file are subject to the terms of the common development and distribution licen[sc]e
cddl-1.0|header|when distributing covered code include this cddl header in each file
cpl-1.0|common|made available under the terms of the common public licen[sc]e v(?:ersion )?1 0
ecl-2.0|educational|licensed under the educational community licen[sc]e version 2 0
eupl-1.2|eupl|licensed under the eupl (?:version )?1 2(?: or as soon they will be approved)?
artistic|package|the package may be freely used modified and redistributed under the artistic licen[sc]e
perl|perl|free software you (?:can|may) redistribute it and or modify it under the same terms as perl
boost-1.0|boost|distributed under the boost software licen[sc]e version 1 0 see accompanying file license 1 0
boost-1.0|execute|to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software
zlib|implied|this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib|misrepresented|the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib|altered|altered source versions must be plainly marked as such
libpng|png|the png reference library is supplied as is
unlicense|unencumbered|this is free and unencumbered software released into the public domain
unlicense|anyone|anyone is free to copy modify publish use compile sell or distribute this software
wtfpl|want|do what the fuck you want to public licen[sc]e
beerware|beer|as long as you retain this notice you can do whatever you want with this stuff .{1,120}? beer
cc0-1.0|waived|has waived all copyright and related or neighboring rights
cc0-1.0|dedicated|to the extent possible under law the authors? ha(?:s|ve) (?:dedicated|waived) all copyright
cc-by|attribution|licensed under a creative commons attribution(?: \d \d)?(?: international| unported)? licen[sc]e
cc-by-sa|alike|text is available under the creative commons attribution share ?alike licen[sc]e
cc-by-nc|commercial|licensed under a creative commons attribution non ?commercial(?: \d \d)?(?: international| unported)? licen[sc]e
cc-by-sa|alike|licensed under a creative commons attribution share ?alike(?: \d \d)?(?: international| unported)? licen[sc]e
cc-by-nd|derivatives|licensed under a creative commons attribution no ?derivatives(?: \d \d)?(?: international| unported)? licen[sc]e
cc|readable|this is a human readable summary of and not a substitute for the licen[sc]e
cc-pdm-1.0|known|this work is free of known copyright restrictions(?: public domain mark)?
odbl-1.0|database|this (?:data|database) is made available under the open database licen[sc]e
odc-by-1.0|commons|made available under the open data commons attribution licen[sc]e
ofl-1.1|font|this font software is licensed under the sil open font licen[sc]e version 1 1
ofl-1.1|reserved|with reserved font name
gfdl|documentation|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
gfdl|invariant|with no invariant sections no front cover texts and no back cover texts
fsfap|medium|copying and distribution of this file with or without modification are permitted in any medium without royalty
fsful|unlimited|this configure script is free software the free software foundation gives unlimited permission to copy
fsfullr|unlimited|this file is free software the free software foundation gives unlimited permission to copy and or distribute it
python-2.0|psf|psf is making python available to licensee on an as is basis
python-2.0|cnri|cnri is making this software available to the individual or organization
php-3.01|php|this source file is subject to version 3 01 of the php licen[sc]e
php-3.0|php|this source file is subject to version 3 0 of the php licen[sc]e
ruby|bsdl|you can redistribute it and or modify it under either the terms of the 2 clause bsdl
postgresql|documentation|permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
openssl|openssl|this product includes software developed by the openssl project for use in the openssl toolkit
ssleay|eric|this product includes cryptographic software written by eric young
curl|curl|licensed as described in the file copying which you should have received as part of this distribution the terms are also available at .{0,20}?curl
icu|icu|permission to use copy modify merge .{1,80}? icu license
unicode|unicode|unicode data files and software .{1,60}? permission is hereby granted
json|evil|the software shall be used for good not evil
ms-pl|accompanying|this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e
vim|vim|there are no restrictions on distributing unmodified copies of vim
tcl|regents|this software is copyrighted by the regents of the university of california sun microsystems
hpnd|supporting|provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation
ntp|appears|permission to use copy modify and distribute this software and its documentation for any purpose .{1,60}? without fee is hereby granted provided that the above copyright notice appears
w3c|obtaining|by obtaining using and or copying this work you .{1,20}?the licensee agree
w3c|w3c|this work is (?:being )?provided .{1,40}? w3c (?:software )?(?:notice and )?licen[sc]e
ncsa|illinois|developed by .{1,60}? university of illinois
upl-1.0|universal|licensed under the universal permissive licen[sc]e v 1 0
bsl-1.1|change|on the change date .{1,60}? the licensor hereby grants
bsl-1.1|parameters|business source licen[sc]e 1 1 parameters licensor
sspl-1.0|service|if you make the functionality of the program .{1,40}? available to third parties as a service
elastic-2.0|managed|you may not provide the software to third parties as a hosted or managed service
commons-clause|licensor|the software is provided to you by the licensor under the licen[sc]e .{1,80}? subject to the following condition
public-domain|domain|(?:is |been |hereby )?(?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain|domain|(?:this (?:file|code|work|software) )?(?:is in|is hereby placed in|belongs to) the public domain
public-domain|domain|no copyright is claimed .{0,40}?public domain
us-government|government|this (?:work|software) (?:is|was) (?:a work of|developed by|produced by) .{0,30}?(?:united states|u s) government
proprietary|reserved|all rights reserved
proprietary|confidential|(?:proprietary and confidential|confidential and proprietary)(?: information)?
proprietary|unauthorized|unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|material) .{0,30}?(?:is )?strictly prohibited
proprietary|consent|may not be (?:reproduced|copied|distributed|disclosed) .{1,60}? without (?:the )?(?:express |prior )+written (?:consent|permission)
proprietary|agreement|end user licen[sc]e agreement
proprietary|trade|contains (?:trade secrets|proprietary information) of
commercial|commercial|for non ?commercial (?:use|purposes) only
commercial|commercial|(?:a )?commercial licen[sc]e (?:is )?(?:available|required)
research-only|research|for (?:academic |non ?commercial )?research (?:use|purposes) only
evaluation-only|evaluation|for evaluation (?:use|purposes) only
dual|dual|(?:is )?dual licen[sc]ed under
dual|either|licensed under either of (?:the )?apache licen[sc]e version 2 0 (?:.{1,60}? )?or (?:the )?mit licen[sc]e(?: .{1,60}?)? at your option
dual|choose|you may choose (?:either|one) of (?:.{1,40}? )?licen[sc]es
copyright|copyright|copyright (?:c )?(?:19|20)[0-9]{2}
copyright|copyright|copyright (?:c )?(?:holders?|owners?) .{1,30}? (?:19|20)[0-9]{2}
copyright|copr|copr (?:c )?(?:19|20)[0-9]{2}
license-file|license|see (?:the )?(?:accompanying |included )?(?:license|licence|copying|notice)(?: txt| md)? file
license-file|license|licen[sc]e (?:that )?can be found in the (?:license|licence|copying) file
license-file|license|for (?:the )?full (?:copyright and )?licen[sc]e (?:information|text) (?:please )?(?:view|see)
license-file|license|this file is distributed under the same licen[sc]e as
warranty|warranty|(?:provided|distributed) (?:on an )?as is (?:basis )?without (?:any )?warrant(?:y|ies)
warranty|warranties|without warranties or conditions of any kind either express or implied
warranty|liability|limitation of liability
patent|patent|grants? (?:to )?you .{0,60}?patent licen[sc]e
trademark|trademark|this licen[sc]e does not grant permission to use the trade ?names trademarks
reserved-image|photo|(?:photo|image) (?:credit|courtesy) .{1,40}? all rights reserved
"""
#: Phrases whose places are always counted, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


class Rule(NamedTuple):
    name: str
    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    out = []
    for line in LICENCES.strip().splitlines():
        # The only unescaped bars of a line are its separators and those inside groups; the groups hold no more than the fields need.
        label, keyword, title, name, address = _fields(line)
        for kind, priority, score, pattern in KINDS:
            # Versions come before families where both match the same words: they are longer.
            made = pattern.format(t=f"(?:{title})", i=f"(?:{name})", u=f"(?:{address})")
            gate = keyword if kind in ("notice", "title") else {"declaration": "spdx", "address": address.split(" ")[0]}[kind]
            out.append(Rule(f"{label}:{kind}", label, gate, made, priority, score))
    for k, line in enumerate(CLAUSES.strip().splitlines()):
        label, keyword, pattern = _fields(line)
        out.append(Rule(f"{label}:clause-{k}", label, keyword, pattern, 60, 0.9))
    return tuple(out)


def _fields(line: str) -> list[str]:
    """The parts between bars that stand outside of all brackets."""
    out, depth = [""], 0
    for c in line:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


#: Words are runs of digits, a-z and all bytes of non-ASCII characters, after lower-casing.
_TO_WORDS = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()


class Scanner:
    """Finds detections in one text; holds the compiled rules."""

    def __init__(self, table: tuple[Rule, ...] | None = None):
        import ahocorasick

        self.rules = rules() if table is None else table
        self.compiled = [re.compile(rb"(?<= )" + r.pattern.encode() + rb"(?= )") for r in self.rules]
        self.keywords = ahocorasick.Automaton()
        by = {}
        for k, r in enumerate(self.rules):
            by.setdefault(r.keyword, []).append(k)
        for phrase, _ in BASE:
            by.setdefault(phrase, [])
        for word, own in by.items():
            self.keywords.add_word(word, (word, own))
        self.keywords.make_automaton()
        self.base = [(re.compile(b"(?= " + phrase.encode() + b" )"), phrase, label) for phrase, label in BASE]

    def scan(self, data: bytes) -> dict:
        """n_words; base: (start word, label) of each place of a base phrase; detections: those that stand, by place."""
        parts = data.translate(_TO_WORDS).split()
        line = b" " + b" ".join(parts) + b" "
        seen = {word: own for _, (word, own) in self.keywords.iter(line.decode("latin-1"))}
        begins = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) if seen else np.zeros(0, np.int64)
        at = lambda i: int(np.searchsorted(begins, i))  # noqa: E731  the word that begins at byte i
        base = sorted((at(m.start()), label) for pattern, phrase, label in self.base if phrase in seen for m in pattern.finditer(line))
        found = []
        for k in sorted({k for own in seen.values() for k in own}):
            for m in self.compiled[k].finditer(line):
                first = at(m.start()) - 1
                found.append((first, first + m.group().count(b" ") + 1, k))
        return {"n_words": len(parts), "base": base, "detections": self.standing(found)}

    def standing(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(from word, to word, rule): what isn't contained in a detection that goes before it."""
        order = sorted(found, key=lambda d: (-self.rules[d[2]].priority, d[0] - d[1], d[0], d[2]))
        kept: list[tuple[int, int, int]] = []
        reach: list[tuple[int, int]] = []
        import bisect

        for a, b, k in order:
            # reach: maximal kept intervals by start, so that ends ascend too.
            i = bisect.bisect_right(reach, (a, float("inf"))) - 1
            if i >= 0 and reach[i][1] >= b:
                continue
            kept.append((a, b, k))
            i += 1
            j = i
            while j < len(reach) and reach[j][1] <= b:
                j += 1
            if i and reach[i - 1][0] == a:
                i -= 1
            reach[i:j] = [(a, b)]
        return sorted(kept)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<from_word:int,to_word:int,rule:string,label:string,score:double>>"


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", table: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, base places and labels, all labels, the best score, detections.

    ``first_word`` and ``last_word`` are null without a base place; ``labels`` and ``base_labels`` are then empty
    strings if nothing else was found. score: the highest score of a detection that stands; 0 without any. Null or
    empty text: no words, no labels. Rows are independent of each other: repeated ones get equal results. Other columns
    are ignored. A text is scanned whole, in time that grows with its length and its detections. An empty table gives none.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    kinds = arrow_schema(SCHEMA)

    def scanned(batches):
        scanner = Scanner(table)
        for whole in batches:
            for lo, hi, data, at in slices(whole, 1, 1 << 22):
                raw, out = data.tobytes(), {f.name: [] for f in kinds}
                for k in range(hi - lo):
                    r = scanner.scan(raw[at[k] : at[k + 1]])
                    base, own = {x[1] for x in r["base"]}, [(a, b, scanner.rules[i]) for a, b, i in r["detections"]]
                    starts = [x[0] for x in r["base"]]
                    row = {
                        "n_words": r["n_words"], "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(base | {x.label for _, _, x in own})), "score": max([x.score for _, _, x in own], default=0.5 if base else 0.0),
                        "detections": [{"from_word": a, "to_word": b, "rule": x.name, "label": x.label, "score": x.score} for a, b, x in own],
                    }
                    for c, v in row.items():
                        out[c].append(v)
                yield pa.record_batch([whole.column(0).slice(lo, hi - lo).cast(f.type) if f.name == "doc_id" else pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(scanned, SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("detections")
