"""License scans: ordered signature rules.

A text is brought into words (A-Z in lower case, runs of ASCII letters, digits and all non-ASCII characters) with one
space between. One pass of a keyword automaton says which rules can match at all; only their regular expressions run.
Detections carry their rule's priority. A detection whose interval lies within that of another one of at least its
priority is suppressed (of equal intervals the higher priority stays, then the earlier rule). Every surviving
detection gives its label; the score is the highest confidence among them.

Defined results: null and empty texts have no words and no labels and score 0; rows that repeat are scanned each; rows
that share an id are scanned each. Other columns are ignored. An empty table returns no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with

#: Phrases whose places are counted, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed values, written by hand: label; the license's name; its short forms after "spdx license identifier" or
#: "license"; keywords of which every match has one (a star: as the beginning of a word). Expressions stand for words of
#: a text as brought above, so "GPL-3.0-only" reads "gpl 3 0 only".
FAMILIES = """
gpl-1.0 | gnu general public license version 1 | gpl ?1(?: 0)?(?: only| or later)? | gnu general, gpl*
gpl-2.0 | gnu general public license (?:as published by the free software foundation )?(?:version|v) ?2 | gpl ?v?2(?: 0)?(?: only| or later)? | gnu general, gpl*
gpl-3.0 | gnu general public license (?:as published by the free software foundation )?(?:version|v) ?3 | gpl ?v?3(?: 0)?(?: only| or later)? | gnu general, gpl*
lgpl-2.0 | gnu library general public license(?: version 2)? | lgpl ?v?2(?: 0)?(?: only| or later)? | gnu library, lgpl*
lgpl-2.1 | gnu lesser general public license (?:version|v) ?2 1 | lgpl ?v?2 1(?: only| or later)? | gnu lesser, lgpl*
lgpl-3.0 | gnu lesser general public license (?:version|v) ?3 | lgpl ?v?3(?: 0)?(?: only| or later)? | gnu lesser, lgpl*
agpl-3.0 | (?:gnu )?affero general public license(?: (?:version|v) ?3)? | agpl ?v?3(?: 0)?(?: only| or later)? | affero, agpl*
gfdl | gnu free documentation license(?: version 1 [123])? | gfdl 1 [123](?: only| or later)? | gnu free, gfdl
apache-1.1 | apache (?:software )?license version 1 1 | apache 1 1 | apache
apache-2.0 | apache license (?:version |v)?2(?: 0)? | apache 2(?: 0)? | apache
mit-0 | mit no attribution(?: license)? | mit 0 | mit
mit | mit(?: x11)? license | mit | mit
bsd-2-clause | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) license | bsd 2 clause | bsd, freebsd
bsd-3-clause | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd) license | bsd 3 clause | bsd
bsd-4-clause | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd) license | bsd 4 clause | bsd
bsd-0-clause | (?:zero clause bsd|bsd zero clause) license | 0bsd | bsd, 0bsd
isc | isc license | isc | isc
zlib | zlib(?: libpng)? license | zlib | zlib
boost-1.0 | boost software license(?: version 1 0)? | bsl 1 0 | boost, bsl
mpl-1.0 | mozilla public license (?:version |v )?1 0 | mpl ?1 0 | mozilla, mpl*
mpl-1.1 | mozilla public license (?:version |v )?1 1 | mpl ?1 1 | mozilla, mpl*
mpl-2.0 | mozilla public license (?:version |v )?2 0 | mpl ?2 0 | mozilla, mpl*
epl-1.0 | eclipse public license (?:version |v )?1 0 | epl ?1 0 | eclipse, epl*
epl-2.0 | eclipse public license (?:version |v )?2 0 | epl ?2 0 | eclipse, epl*
edl-1.0 | eclipse distribution license(?: (?:version |v )?1 0)? | edl ?1 0 | eclipse, edl*
cddl-1.0 | common development and distribution license(?: (?:version |v )?1 0)? | cddl ?1 0 | common development, cddl*
cddl-1.1 | common development and distribution license (?:version |v )?1 1 | cddl ?1 1 | common development, cddl*
cpl-1.0 | common public license(?: (?:version |v )?1 0)? | cpl ?1 0 | common public, cpl*
ipl-1.0 | ibm public license(?: (?:version |v )?1 0)? | ipl ?1 0 | ibm public, ipl*
eupl-1.1 | european union public licen[cs]e (?:version |v )?1 1 | eupl ?1 1 | european union, eupl*
eupl-1.2 | european union public licen[cs]e (?:version |v )?1 2 | eupl ?1 2 | european union, eupl*
osl-3.0 | open software license (?:version |v )?3 0 | osl ?3 0 | open software, osl*
afl-3.0 | academic free license (?:version |v )?3 0 | afl ?3 0 | academic free, afl*
artistic-1.0 | artistic license(?: (?:version |v )?1(?: 0)?)? | artistic 1 0(?: perl)? | artistic
artistic-2.0 | artistic license (?:version |v )?2(?: 0)? | artistic 2 0 | artistic
python-2.0 | python software foundation license(?: version 2)? | (?:psf|python) 2 0 | python, psf
php-3.01 | php license(?: (?:version |v )?3 01)? | php 3 01 | php
ruby | ruby license | ruby | ruby
perl | same terms as perl(?: 5)?(?: itself)? | perl | perl
ncsa | (?:university of illinois )?ncsa open source license | ncsa | ncsa
w3c | w3c software(?: and document)? (?:notice and )?license | w3c | w3c
x11 | x11 license | x11 | x11
openssl | openssl license | openssl | openssl
curl | curl license | curl | curl
unlicense | (?:this is free and unencumbered software released into the public domain|the unlicense) | unlicense | unencumbered, unlicense
wtfpl | do what the fuck you want to public license(?: version 2)? | wtfpl | do what, wtfpl
cc0-1.0 | (?:cc0|creative commons zero)(?: 1 0)?(?: universal)? | cc0 1 0 | cc0, creative commons
cc-by-1.0 | (?:creative commons attribution|cc by) 1 0(?: generic)? | cc by 1 0 | cc by, creative commons
cc-by-2.0 | (?:creative commons attribution|cc by) 2 0(?: generic)? | cc by 2 0 | cc by, creative commons
cc-by-2.5 | (?:creative commons attribution|cc by) 2 5(?: generic)? | cc by 2 5 | cc by, creative commons
cc-by-3.0 | (?:creative commons attribution|cc by) 3 0(?: unported)? | cc by 3 0 | cc by, creative commons
cc-by-4.0 | (?:creative commons attribution|cc by) 4 0(?: international)? | cc by 4 0 | cc by, creative commons
cc-by-sa | (?:creative commons attribution share ?alike|cc by sa)(?: [1-4] [05])?(?: international| unported)? | cc by sa(?: [1-4] [05])? | cc by, creative commons
cc-by-nd | (?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: [1-4] [05])? | cc by nd(?: [1-4] [05])? | cc by, creative commons
cc-by-nc | (?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] [05])? | cc by nc(?: [1-4] [05])? | cc by, creative commons
cc-by-nc-sa | (?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] [05])? | cc by nc sa(?: [1-4] [05])? | cc by, creative commons
cc-by-nc-nd | (?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: [1-4] [05])? | cc by nc nd(?: [1-4] [05])? | cc by, creative commons
odbl-1.0 | open (?:data commons open )?database license(?: (?:version |v )?1 0)? | odbl 1 0 | odbl, open data, open database
odc-by-1.0 | open data commons attribution license(?: (?:version |v )?1 0)? | odc by 1 0 | odc, open data
pddl-1.0 | public domain dedication and license(?: (?:version |v )?1 0)? | pddl 1 0 | pddl, public domain
ofl-1.1 | (?:sil )?open font license(?: (?:version |v )?1 1)? | ofl 1 1 | ofl, open font
ms-pl | microsoft public license | ms pl | microsoft public, ms pl
ms-rl | microsoft reciprocal license | ms rl | microsoft reciprocal, ms rl
bsl-1.1 | business source license(?: 1 1)? | busl 1 1 | business source, busl
sspl-1.0 | server side public license(?: (?:version |v )?1)? | sspl 1 0 | server side, sspl
elastic-2.0 | elastic license (?:version |v )?2(?: 0)? | elastic 2 0 | elastic
openrail | (?:creativeml )?open ?rail(?: m)? license | openrail(?: m)? | openrail, open rail, creativeml
public-domain | (?:placed|released|dedicated) (?:in|into|to) the public domain | public domain | public domain
proprietary | all rights reserved | proprietary | rights reserved, proprietary
"""

#: Fixed values, written by hand: label; a passage of the license's own text; keywords as above.
GRANTS = """
mit | permission is hereby granted free of charge to any person obtaining a copy of this software | permission is
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | permission to
bsd-3-clause | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products | neither the
bsd-2-clause | redistribution and use in source and binary forms with or without modification are permitted | redistribution and
apache-2.0 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license | licensed under
gpl-2.0 | (?:version 2 of the license or at your option any later version|under the terms of the gnu general public license version 2) | version 2
gpl-3.0 | (?:version 3 of the license or at your option any later version|under the terms of the gnu general public license version 3) | version 3
mpl-2.0 | this source code form is subject to the terms of the mozilla public license v 2 0 | source code
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable | provided as
boost-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation | permission is
unlicense | anyone is free to copy modify publish use compile sell or distribute this software | anyone is
cc-by | you are free to (?:share|copy) .{1,120}? under the following (?:terms|conditions) attribution | you are
"""

#: Fixed values, written by hand: label; wording of a notice, header, exception, range of versions or choice of licences, as
#: it stands in files; keywords as above.
NOTICES = r"""
gpl-2.0-or-later | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version | free software
gpl-3.0-or-later | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version | free software
gpl-2.0-only | you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation | redistribute it
gpl-3.0-only | you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation | redistribute it
gpl-2.0-or-later | gnu general public license (?:version |v)2(?: 0)? or (?:at your option )?(?:any )?later(?: version)? | gnu general
gpl-3.0-or-later | gnu general public license (?:version |v)3(?: 0)? or (?:at your option )?(?:any )?later(?: version)? | gnu general
gpl-2.0-or-later | gpl ?v?2(?: 0)?(?: or later| plus)(?: version)? | gpl*
gpl-3.0-or-later | gpl ?v?3(?: 0)?(?: or later| plus)(?: version)? | gpl*
gpl-2.0-only | gpl 2 0 only | gpl
gpl-3.0-only | gpl 3 0 only | gpl
gpl | you should have received a copy of the gnu general public license along with (?:this program|this file|[a-z]{2,20}) | have received
gpl | this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license | in the hope
gpl-2.0 | gnu general public license version 2 june 1991 | june 1991
gpl-3.0 | gnu general public license version 3 29 june 2007 | june 2007
gpl-1.0 | gnu general public license version 1 february 1989 | february 1989
gpl | the licenses for most software are designed to take away your freedom to share and change it | your freedom
gpl | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed | verbatim copies
gpl-2.0-classpath-exception | as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable | special exception
gpl-2.0-classpath-exception | (?:subject to the )?classpath exception as provided by | classpath
gpl-2.0-classpath-exception | gpl 2 0 (?:only |or later )?with classpath exception 2 0 | classpath
gpl-3.0-gcc-exception | gcc runtime library exception(?: version)? 3 1 | gcc runtime
gpl-3.0-gcc-exception | gpl 3 0 (?:only |or later )?with gcc exception 3 1 | gcc exception
gpl-autoconf-exception | configure scripts? (?:that are|which is) (?:often )?the output of autoconf | autoconf
gpl-bison-exception | as a special exception you may create a larger work that contains part or all of the bison parser skeleton | bison
gpl-linking-exception | give you unlimited permission to link the compiled version of this file | unlimited permission
gpl-openssl-exception | permission to link the code of (?:portions of )?this program with the openssl (?:project s )?library | openssl
gpl-font-exception | as a special exception if you create a document which uses this font and embed this font | this font
linux-syscall-note | this copyright does not cover user programs that use kernel services by normal system calls | kernel services
linux-syscall-note | gpl 2 0 (?:only |or later )?with linux syscall note | linux syscall
lgpl-2.1-or-later | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version | gnu lesser
lgpl-3.0-or-later | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version | gnu lesser
lgpl-2.0-or-later | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version | gnu library
lgpl-2.1 | gnu lesser general public license version 2 1 february 1999 | february 1999
lgpl-2.0 | gnu library general public license version 2 june 1991 | gnu library
lgpl-2.1 | this license the lesser general public license applies to some specially designated software packages typically libraries | specially designated
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program) | have received
agpl-3.0-or-later | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version | gnu affero
agpl-3.0 | gnu affero general public license version 3 19 november 2007 | november 2007
agpl-3.0 | if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network | remotely through
gfdl-1.2-or-later | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2 or any later version | this document
gfdl-1.3-or-later | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version | this document
gfdl | with no invariant sections no front cover texts and no back cover texts | invariant sections
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind | required by
apache-2.0 | you may obtain a copy of the license at https? www apache org licenses license 2 0 | apache org
apache-2.0 | apache license version 2 0 january 2004 | january 2004
apache-2.0 | licensed to the apache software foundation asf under one or more contributor license agreements | apache software
apache-1.1 | this product includes software developed by the apache software foundation | includes software
apache-1.0 | this product includes software developed by the apache group for use in the apache http server project | apache group
apache-2.0-llvm-exception | apache (?:license v)?2 0 with llvm exceptions? | llvm
apache-2.0-or-mit | (?:dual )?licensed under (?:either of )?(?:the )?(?:apache license version 2 0|apache 2 0|mit)(?: license)? (?:or|and) (?:the )?(?:mit|apache license version 2 0|apache 2 0)(?: license)? | licensed under
apache-2.0-or-mit | (?:mit or apache 2 0|apache 2 0 or mit) | mit or, or mit
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | above copyright
mit | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability | provided as
mit | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies | without restriction
mit-or-gpl-2.0 | dual licensed under the mit (?:and|or) gpl(?: version)? ?(?:v?2)? licenses? | dual licensed
mit-or-gpl-2.0 | (?:mit or gpl 2 0(?: only| or later)?|gpl 2 0(?: only| or later)? or mit) | mit or, or mit
mit-modern-variant | permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software | written agreement
mit-feh | shall be included in all copies of the software and its documentation and acknowledgment shall be given | acknowledgment shall
mit-cmu | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies | and its documentation
hpnd | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee | and sell
x11 | except as contained in this notice the name of the x consortium shall not be used in advertising | x consortium
x11 | except as contained in this notice the names? of (?:the )?.{1,60}? shall not be used in advertising or otherwise to promote the sale use or other dealings in this software | except as
ntp | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided | and its documentation
isc | the software is provided as is and the author disclaims all warranties with regard to this software | author disclaims
0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is | with or without
bsd | this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? as is and any express or implied warranties | provided by
bsd | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer | redistributions of
bsd | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer | redistributions in
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledgement | advertising materials
bsd-4-clause-uc | this product includes software developed by the university of california berkeley and its contributors | includes software
bsd-3-clause-clear | no express or implied licenses to any party s patent rights are granted by this license | patent rights
bsd-3-clause-lbnl | you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance of the source code | no obligation
bsd-2-clause-patent | each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable (?:[a-z0-9]+ ){0,10}?patent license | copyright holder
bsd-style | (?:this (?:software|source code) is |use of this source code is )?governed by a bsd style license(?: that can be found in the license file)? | bsd style
bsd-or-gpl-2.0 | this software may be distributed under the terms of the gnu general public license (?:[a-z0-9]+ ){0,6}?or alternatively (?:[a-z0-9]+ ){0,10}?bsd | or alternatively
zlib | altered source versions must be plainly marked as such and must not be misrepresented as being the original software | plainly marked
zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software | must not
libpng | the contributing authors and group 42 inc disclaim all warranties expressed or implied | group 42
boost-1.0 | distributed under the boost software license version 1 0 see accompanying file license 1 0 txt | boost software
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1 | contents of
mpl-1.0 | the contents of this file are subject to the mozilla public license version 1 0 | contents of
mpl-2.0 | if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0 | mpl was
mpl-2.0-no-copyleft-exception | this source code form is incompatible with secondary licenses as defined by the mozilla public license | secondary licenses
mpl-gpl-lgpl | alternatively the contents of this file may be used under the terms of (?:either )?the gnu (?:lesser )?general public license | contents of
npl-1.1 | the contents of this file are subject to the netscape public license version 1 1 | netscape public
epl-1.0 | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 | accompanying materials
epl-2.0 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0 | accompanying materials
epl-or-edl | made available under the terms of the eclipse public license (?:[a-z0-9]+ ){0,6}?and the eclipse distribution license | eclipse distribution
cddl-1.0 | the contents of this file are subject to the terms of the common development and distribution license | common development
cddl-or-gpl-2.0 | the contents of this file are subject to the terms of either the gnu general public license version 2 only gpl or the common development and distribution license | common development
cpl-1.0 | this program and the accompanying materials are made available under the terms of the common public license v1 0 | common public
eupl | licensed under the eupl(?: version)? 1 [12](?: or as soon they will be approved by the european commission subsequent versions of the eupl)? | eupl
artistic-1.0 | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control | artistic control
artistic-2.0 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package may be copied | free software
perl | this (?:library|program|module) is free software you can redistribute it and or modify it under the same terms as perl itself | same terms
perl | artistic license or (?:the )?(?:gnu )?(?:gpl|general public license) | artistic license
python-2.0 | psf is making python available to licensee on an as is basis | licensee
python-2.0 | python software foundation license version 2 1 this license agreement is between the python software foundation | license agreement
php-3.01 | this product includes php software freely available from | php software
ruby | you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)(?: version 2)? (?:see the file (?:[a-z0-9]+ ){1,3}?)?or the conditions below | conditions below
ncsa | neither the names of (?:[a-z0-9]+ ){1,13}?nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission | neither the
w3c | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions | obtaining using
openssl | this product includes software developed by the openssl project for use in the openssl toolkit | openssl toolkit
ssleay | this product includes cryptographic software written by eric young | cryptographic software
curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies | permission to
icu | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction (?:[a-z0-9]+ ){0,33}?provided that the above copyright notice s and this permission notice appear in all copies | permission is
unicode | distributed under the terms of use in https? www unicode org copyright html | unicode org
unicode | to any person obtaining a copy of the unicode data files and any associated documentation | unicode data
vim | there are no restrictions on distributing unmodified copies of vim except that they must include this license text | copies of
tcl | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose | hereby grant
json | the software shall be used for good not evil | for good
beerware | as long as you retain this notice you can do whatever you want with this stuff | whatever you
wtfpl | you just do what the fuck you want to | just do
unlicense | in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain | public domain
cc0-1.0 | to the extent possible under law (?:[a-z0-9]+ ){1,13}?has waived all copyright and related or neighboring rights | has waived
cc0-1.0 | creative commons org publicdomain zero 1 0 | publicdomain zero
cc0-1.0 | creativecommons org publicdomain zero 1 0 | publicdomain zero
cc-by-4.0 | creativecommons org licenses by 4 0 | licenses by
cc-by-3.0 | creativecommons org licenses by 3 0 | licenses by
cc-by-sa-4.0 | creativecommons org licenses by sa 4 0 | licenses by
cc-by-sa-3.0 | creativecommons org licenses by sa 3 0 | licenses by
cc-by-nc-4.0 | creativecommons org licenses by nc 4 0 | licenses by
cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa 4 0 | licenses by
cc-by-nd-4.0 | creativecommons org licenses by nd 4 0 | licenses by
cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd 4 0 | licenses by
cc-by-sa | you may share and adapt this work (?:[a-z0-9]+ ){0,13}?under the same license as the original | same license
cc-by-sa | if you remix transform or build upon the material you must distribute your contributions under the same license as the original | same license
cc-by-nc | you may not use the material for commercial purposes | commercial purposes
cc-by-nd | if you remix transform or build upon the material you may not distribute the modified material | modified material
public-domain | this (?:file|work|software|code|program) (?:is|has been (?:placed|put)|was placed) in(?:to)? the public domain | public domain
public-domain | this work of the united states government is not subject to copyright | united states
public-domain | the author disclaims copyright to this source code | disclaims copyright
ofl-1.1 | this font software is licensed under the sil open font license version 1 1 | font software
ofl-1.1 | the fonts and derivatives however cannot be released under any other type of license | the fonts
odbl-1.0 | this (?:[a-z0-9]+ ){1,10}?is made available under the open database license | open database
pddl-1.0 | this (?:[a-z0-9]+ ){1,10}?is made available under the public domain dedication and license | domain dedication
ms-pl | this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software | license governs
ms-rl | for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code | for any
bsl-1.1 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work | non production
sspl-1.0 | making the functionality of the program or modified version available to third parties as a service | as a service
elastic-2.0 | you may not provide the software to third parties as a hosted or managed service | managed service
commons-clause | the software is provided to you by the licensor under the license as defined below subject to the following condition without limiting other conditions in the license the grant of rights under the license will not include (?:[a-z0-9]+ ){0,10}?the right to sell the software | right to
polyform-noncommercial | the licensor grants you a copyright license for the software to do everything you might do with the software that would otherwise infringe (?:[a-z0-9]+ ){0,13}?for any permitted purpose | permitted purpose
openrail | use based restrictions as referenced in paragraph 5 must be included as an enforceable provision | use based
llama-community | llama [0-9](?: [0-9])? community license agreement | community license
gemma | gemma is provided under and subject to the gemma terms of use | gemma
proprietary | this (?:software|document|source code|file) (?:is|contains) (?:the )?(?:confidential and )?proprietary (?:and confidential )?(?:information|property)? ?(?:of|to) | proprietary
proprietary | unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:of this file )?.{0,60}?is (?:strictly )?prohibited | unauthorized, unauthorised
proprietary | no part of this (?:publication|document|work) may be reproduced (?:[a-z0-9]+ ){0,20}?without (?:the )?(?:prior )?(?:written )?permission | no part
proprietary | for (?:internal|evaluation) (?:use|purposes) only(?: not for distribution)? | internal use, evaluation use, internal purposes, evaluation purposes
free-unknown | this (?:is|package is) free software(?: see the (?:copying|license) file)? | free software
see-license | see (?:the )?(?:file )?(?:license|copying)(?: txt| md)? (?:file )?(?:in the project root )?for (?:full |the full )?(?:license |copyright )?(?:information|details|text|terms) | see license, see the, see file, see copying
"""

#: How a name or short form is cited: priority, confidence, and the words around {it}, N for a name, S for a short form.
CITED = (
    (90, 0.99, "S", r"spdx license identifier {it}"),
    (70, 0.95, "N", r"(?:is |are |be )?(?:licensed|released|distributed|available|made available|published) under (?:the |an? )?(?:terms of the )?{it}"),
    (65, 0.9, "N", r"(?:subject to|governed by|covered by|in accordance with) (?:the )?(?:terms of the )?{it}"),
    (60, 0.9, "S", r"(?:licensed|released|distributed|available|published) under (?:the |an? )?{it}(?: licen[cs]e)?"),
    (50, 0.8, "N", r"{it}"),
    (40, 0.6, "S", r"(?:licen[cs]e|licen[cs]ed as) {it}"),
    (30, 0.5, "S", r"{it} licen[cs]e"),
)


@dataclass(frozen=True)
class Rule:
    priority: int
    confidence: float
    label: str
    keywords: tuple[str, ...]
    pattern: str


def rules() -> list[Rule]:
    """All rules, the most specific first."""

    def rows(table: str) -> Iterator[list[str]]:
        return ([x.strip() for x in line.split(" | ")] for line in table.splitlines() if line)

    found = [Rule(80, 0.97, label, tuple(keys.split(", ")), passage) for label, passage, keys in rows(GRANTS)]
    found += [Rule(75, 0.95, label, tuple(keys.split(", ")), wording) for label, wording, keys in rows(NOTICES)]
    for label, name, short, keys in rows(FAMILIES):
        for priority, confidence, kind, around in CITED:
            found.append(Rule(priority, confidence, label, tuple(keys.split(", ")), around.replace("{it}", f"(?:{name if kind == 'N' else short})")))
    found += [Rule(20, 0.7, label, (phrase,), phrase) for phrase, label in PHRASES.items()]
    return sorted(found, key=lambda r: -r.priority)


_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Scanner:
    def __init__(self, ordered: list[Rule] | None = None):
        import ahocorasick

        self.rules = rules() if ordered is None else ordered
        self.compiled = [re.compile(f"(?<= )(?:{r.pattern})(?= )") for r in self.rules]
        self.phrases = re.compile("(?<= )(?:" + "|".join(sorted(PHRASES, key=len, reverse=True)) + ")(?= )")
        self.gates = ahocorasick.Automaton()
        gated: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for word in r.keywords:
                gated.setdefault(f" {word[:-1]}" if word.endswith("*") else f" {word} ", []).append(i)
        for word, which in gated.items():
            self.gates.add_word(word, which)
        self.gates.make_automaton()

    def detections(self, line: str) -> list[tuple[int, int, Rule]]:
        """Surviving detections in a text of spaced words."""
        on = {i for which in {id(w): w for _, w in self.gates.iter(line)}.values() for i in which}
        raw = [(m.start(), m.end(), i) for i in on for m in self.compiled[i].finditer(line)]
        raw.sort(key=lambda d: (d[0], -d[1], -self.rules[d[2]].priority, d[2]))
        reach: dict[int, int] = {}
        kept = []
        for start, end, i in raw:
            rule = self.rules[i]
            if any(e >= end for p, e in reach.items() if p >= rule.priority):
                continue
            kept.append((start, end, rule))
            reach[rule.priority] = max(reach.get(rule.priority, 0), end)
        return kept

    def scan(self, text: str | bytes | None) -> dict:
        data = text.encode() if isinstance(text, str) else text or b""
        words = data.translate(_TABLE).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1") if words else " "
        spaces = None
        places = []
        for m in self.phrases.finditer(line):
            if spaces is None:
                spaces = [i for i, c in enumerate(line) if c == " "]
            places.append((bisect_left(spaces, m.start()) - 1, PHRASES[m.group()]))
        base = {label for _, label in places}
        kept = self.detections(line) if words else []
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": places[0][0] if places else None,
            "last_word": places[-1][0] if places else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {r.label for _, _, r in kept})),
            "score": max((r.confidence for _, _, r in kept), default=0.0),
            "detections": [{"start": s, "end": e, "label": r.label, "priority": r.priority} for s, e, r in kept],
        }


_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,label:string,priority:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, counts, labels, score and the surviving detections (characters of the spaced words) of every whole text."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = schema_with(picked.select("doc_id"), _OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kinds = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("priority", pa.int32())])))])
        for batch in batches:
            found = pa.RecordBatch.from_pylist([scanner.scan(t.as_py()) for t in batch.column(1).cast(pa.binary())], kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=["doc_id", *kinds.names])

    return picked.mapInArrow(run, schema)
