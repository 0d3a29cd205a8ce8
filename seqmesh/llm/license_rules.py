"""License signatures written by hand, one a line: label, priority, weight, and the pattern.

A pattern is a regular expression over the words of a text, lower-cased and joined by single spaces (marks are gone, so
"GPL-2.0+" reads ``gpl 2 0``). Words in angle brackets are the keywords: a match holds one of them at the start of a
word. Higher priority suppresses what lies within: 95 identifiers, 80-90 sentences that only one license has, 60-79
names, 30-59 sentences that many licenses share.
"""

from __future__ import annotations

SIGNATURES = r"""
mit 95 1.0 <spdx> licen[sc]e identifier mit(?! 0| no)
mit-0 96 1.0 <spdx> licen[sc]e identifier mit (?:0|no attribution)
apache-2 95 1.0 <spdx> licen[sc]e identifier apache 2 0
apache-1.1 95 1.0 <spdx> licen[sc]e identifier apache 1 1
bsd-2-clause 95 1.0 <spdx> licen[sc]e identifier bsd 2 clause
bsd-3-clause 95 1.0 <spdx> licen[sc]e identifier bsd 3 clause
bsd-4-clause 95 1.0 <spdx> licen[sc]e identifier bsd 4 clause
0bsd 95 1.0 <spdx> licen[sc]e identifier 0bsd
isc 95 1.0 <spdx> licen[sc]e identifier isc
zlib 95 1.0 <spdx> licen[sc]e identifier zlib
gpl-2 95 1.0 <spdx> licen[sc]e identifier gpl 2 0(?: only| or later)?
gpl-3 95 1.0 <spdx> licen[sc]e identifier gpl 3 0(?: only| or later)?
lgpl-2.1 95 1.0 <spdx> licen[sc]e identifier lgpl 2 1(?: only| or later)?
lgpl-3 95 1.0 <spdx> licen[sc]e identifier lgpl 3 0(?: only| or later)?
agpl-3 95 1.0 <spdx> licen[sc]e identifier agpl 3 0(?: only| or later)?
mpl-2 95 1.0 <spdx> licen[sc]e identifier mpl 2 0
epl-2 95 1.0 <spdx> licen[sc]e identifier epl 2 0
bsl-1 95 1.0 <spdx> licen[sc]e identifier bsl 1 0
cc0-1 95 1.0 <spdx> licen[sc]e identifier cc0 1 0
unlicense 95 1.0 <spdx> licen[sc]e identifier unlicense
wtfpl 95 1.0 <spdx> licen[sc]e identifier wtfpl
cc-by-4 95 1.0 <spdx> licen[sc]e identifier cc by 4 0
cc-by-sa-4 96 1.0 <spdx> licen[sc]e identifier cc by sa 4 0
mit 85 0.95 permission is <hereby> granted free of charge to any person obtaining a copy
mit 82 0.9 to deal in the software without restriction including without limitation the rights to use copy modify merge publish <distribute> sublicense
mit 82 0.9 the above copyright notice and this permission notice shall be included in all copies or <substantial> portions of the software
mit 70 0.9 (?:the )?<expat> licen[sc]e
mit 66 0.85 (?:is|are) <mit> licen[sc]ed
mit 66 0.85 <mit> style licen[sc]e
mit 60 0.8 (?:under|terms of) the terms of the <mit> licen[sc]e
bsd-4-clause 84 0.9 all <advertising> materials mentioning features or use of this software must display the following
x11 84 0.9 except as contained in this notice the name of .{1,60}? shall not be used in <advertising> or otherwise to promote
ntp 82 0.85 permission to use copy modify and distribute this software and its documentation for any purpose .{0,40}?without fee is <hereby> granted
hpnd 80 0.7 <suitability> of this software for any purpose it is provided as is without express or implied warranty
isc 83 0.9 permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is <hereby> granted
isc 78 0.8 the <author> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
bsd 80 0.9 <redistribution> and use in source and binary forms with or without modification are permitted
bsd 78 0.85 <redistributions> of source code must retain the above copyright notice
bsd 78 0.85 <redistributions> in binary form must reproduce the above copyright notice
bsd-3-clause 85 0.95 neither the name of .{1,80}? nor the names of (?:its|any|the) <contributors>
bsd-3-clause 84 0.9 may be used to <endorse> or promote products derived from this software without specific prior written permission
bsd-4-clause 86 0.95 this product includes software <developed> by (?:the university of california|.{1,40}? and its contributors)
bsd-3-clause 85 0.95 (?:3|three) clause <bsd>|<bsd> (?:3|three) clause|(?:new|modified|revised) <bsd>
bsd-2-clause 85 0.95 (?:2|two) clause <bsd>|<bsd> (?:2|two) clause|simplified <bsd>|<freebsd> licen[sc]e
bsd-4-clause 85 0.95 (?:4|four) clause <bsd>|<bsd> (?:4|four) clause|original <bsd>
0bsd 85 0.95 (?:0|zero) clause <bsd>|<bsd> (?:0|zero) clause|<0bsd>
bsd-protection 84 0.9 <bsd> protection licen[sc]e
bsd-patent 84 0.9 <bsd> (?:2 clause )?plus patent
bsd 60 0.8 (?:under|terms of) the <bsd> (?:style )?licen[sc]e
apache-2 88 0.95 licen[sc]ed under the <apache> licen[sc]e version 2 0
apache-2 86 0.95 you may not use this file except in <compliance> with the licen[sc]e you may obtain a copy of the licen[sc]e at
apache-2 87 0.95 <apache> org licenses licen[sc]e 2 0
apache-2 60 0.6 unless required by applicable law or agreed to in writing software <distributed> under the licen[sc]e is distributed on an as is basis
apache-1.1 84 0.9 this product includes software developed by the <apache> software foundation
apache 70 0.8 (?:the )?<apache> 2 licen[sc]e|<asl> 2 0
gpl 84 0.9 this program is free software you can <redistribute> it and or modify it under the terms of the gnu general public licen[sc]e
gpl-2 88 0.95 gnu <general> public licen[sc]e as published by the free software foundation (?:either )?version 2
gpl-3 88 0.95 gnu <general> public licen[sc]e as published by the free software foundation (?:either )?version 3
lgpl 85 0.9 this library is free software you can <redistribute> it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e
lgpl-2.1 89 0.95 gnu <lesser> general public licen[sc]e as published by the free software foundation (?:either )?version 2 1
lgpl-3 89 0.95 gnu <lesser> general public licen[sc]e as published by the free software foundation (?:either )?version 3
agpl-3 89 0.95 gnu <affero> general public licen[sc]e as published by the free software foundation (?:either )?version 3
gpl 62 0.7 you should have received a copy of the gnu <general> public licen[sc]e along with
lgpl 63 0.7 you should have received a copy of the gnu <lesser> general public licen[sc]e along with
agpl 63 0.7 you should have received a copy of the gnu <affero> general public licen[sc]e along with
gpl 61 0.6 see the gnu <general> public licen[sc]e for more details
gpl-2 80 0.9 <gpl>v2(?: only| or later)?
gpl-3 80 0.9 <gpl>v3(?: only| or later)?
lgpl-2.1 80 0.9 <lgpl>v2 ?1?
lgpl-3 80 0.9 <lgpl>v3
agpl-3 80 0.9 <agpl>v3
mpl-2 80 0.9 <mpl>v2
mpl-1.1 80 0.9 <mpl>v1 ?1?
gpl-classpath 88 0.95 gnu <classpath> exception|<linking> this library statically or dynamically with other modules is making a combined work
gpl-openssl 86 0.9 <openssl> linking exception|link the code of portions of this program with the <openssl> library
gcc-exception 87 0.95 <gcc> runtime library exception
bison-exception 87 0.95 <bison> parser exception|as a special exception you may create a larger work that contains part or all of the <bison> parser skeleton
autoconf-exception 87 0.9 <autoconf> (?:configure script )?exception
linux-syscall-note 87 0.9 <linux> syscall note
or-later 40 0.5 either version \d+(?: \d+)? of the licen[sc]e or(?: at your option)? any <later> version
gpl 58 0.7 <copyleft> licen[sc]e
gfdl 85 0.95 permission is granted to copy distribute and or modify this document under the terms of the gnu <free> documentation licen[sc]e
gfdl-no-invariants 86 0.9 with no <invariant> sections no front cover texts and no back cover texts
mpl 85 0.95 this source code form is subject to the terms of the <mozilla> public licen[sc]e
mpl-1.1 85 0.95 the contents of this file are subject to the <mozilla> public licen[sc]e version 1 1
mpl-2-incompatible 86 0.9 incompatible with <secondary> licen[sc]es as defined by the mozilla public licen[sc]e
mpl-tri 84 0.85 alternatively the contents of this file may be used under the terms of either the gnu <general> public licen[sc]e
npl 84 0.9 <netscape> public licen[sc]e
spl 84 0.9 <sun> public licen[sc]e
sissl 84 0.9 <sun> industry standards source licen[sc]e
epl 85 0.95 this program and the accompanying materials are made available under the terms of the <eclipse> public licen[sc]e
edl 84 0.9 <eclipse> distribution licen[sc]e
cddl 85 0.95 the contents of this file are subject to the terms of the <common> development and distribution licen[sc]e
ipl 84 0.9 <ibm> public licen[sc]e
lpl 84 0.9 <lucent> public licen[sc]e
apsl 84 0.9 <apple> public source licen[sc]e
ncsa 84 0.9 university of illinois <ncsa> open source licen[sc]e|<ncsa> open source licen[sc]e
w3c 84 0.9 <w3c> software (?:and document )?notice and licen[sc]e|<w3c> licen[sc]e
vim 84 0.9 <vim> licen[sc]e
curl 84 0.9 <curl> licen[sc]e
openssl 84 0.9 <openssl> licen[sc]e|original <ssleay> licen[sc]e|this product includes software developed by the <openssl> project
ssleay 84 0.9 this package is an <ssl> implementation written by eric young
libpng 84 0.9 <libpng> licen[sc]e
zlib 85 0.9 this software is provided as is without any express or implied warranty in no event will the <authors> be held liable
zlib 84 0.9 the <origin> of this software must not be misrepresented you must not claim that you wrote the original software
zlib 84 0.9 altered source versions must be <plainly> marked as such
libtiff 84 0.9 <libtiff> licen[sc]e
ijg 84 0.9 this software is based in part on the work of the <independent> jpeg group
freetype 84 0.9 <freetype> (?:project )?licen[sc]e
icu 84 0.9 <icu> licen[sc]e
unicode 84 0.9 <unicode> (?:inc )?licen[sc]e(?: agreement)?(?: data files)?
tcl 84 0.9 <tcl> tk licen[sc]e|<tcl> licen[sc]e
postgresql 84 0.9 <postgresql> licen[sc]e
python 84 0.9 <python> licen[sc]e(?: 2 0)?|this licen[sc]e agreement is between the <python> software foundation
ruby 84 0.9 you may <redistribute> it and or modify it under either the terms of the 2 clause bsdl
perl 84 0.85 under the same terms as <perl> itself|you may redistribute .{0,30}?under the same terms as <perl>
artistic 84 0.85 <clarified> artistic licen[sc]e
lua 84 0.9 <lua> licen[sc]e
beerware 84 0.9 the <beer> ware licen[sc]e|<beerware>
wtfpl 88 0.95 everyone is permitted to copy and distribute verbatim or <modified> copies of this licen[sc]e document and changing it is allowed
wtfpl 86 0.95 you just <do> what the fuck you want to
json 84 0.9 the software shall be used for <good> not evil
unlicense 85 0.95 this is free and <unencumbered> software released into the public domain
unlicense 82 0.9 anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a <compiled> binary
cc0 84 0.9 to the extent possible under law .{1,80}? has <waived> all copyright and related or neighbou?ring rights
cc0 80 0.85 <cc0> 1 0 universal
pddl 84 0.9 <open> data commons public domain dedication
public-domain 60 0.7 (?:released|dedicated|placed|put) (?:in ?to|to|in) the public <domain>
public-domain 59 0.6 this (?:work|file|code|software|text|document) is (?:in|part of) the public <domain>
public-domain 58 0.6 (?:no copyright|not copyrighted|copyright free) public <domain>
us-government 60 0.7 work of the (?:us|u s|united states) <government>
sax-pd 80 0.85 <sax> public domain notice
cc-by 76 0.9 <creative> commons attribution (?:\d \d )?(?:international|unported|generic) licen[sc]e
cc-by-sa 78 0.9 <creative> commons attribution share ?alike (?:\d \d )?(?:international|unported|generic) licen[sc]e
cc-by-nd 78 0.9 <creative> commons attribution no ?derivatives? (?:\d \d )?(?:international|unported|generic) licen[sc]e
cc-by-nc 78 0.9 <creative> commons attribution non ?commercial (?:\d \d )?(?:international|unported|generic) licen[sc]e
cc-by-nc-sa 79 0.9 <creative> commons attribution non ?commercial share ?alike (?:\d \d )?(?:international|unported|generic) licen[sc]e
cc-by-nc-nd 79 0.9 <creative> commons attribution non ?commercial no ?derivatives? (?:\d \d )?(?:international|unported|generic) licen[sc]e
cc-by 76 0.95 <creativecommons> org licenses by \d \d
cc-by-sa 77 0.95 <creativecommons> org licenses by sa \d \d
cc-by-nd 77 0.95 <creativecommons> org licenses by nd \d \d
cc-by-nc 77 0.95 <creativecommons> org licenses by nc \d \d
cc-by-nc-sa 78 0.95 <creativecommons> org licenses by nc sa \d \d
cc-by-nc-nd 78 0.95 <creativecommons> org licenses by nc nd \d \d
cc0-1 78 0.95 <creativecommons> org publicdomain zero 1 0
cc-pdm 78 0.95 <creativecommons> org publicdomain mark 1 0|public <domain> mark 1 0
cc-sampling 78 0.9 <creative> commons sampling plus
cc-devnations 78 0.9 <creative> commons developing nations
cc 50 0.6 some rights <reserved>
cc 52 0.6 (?:under|with) an? <creative> commons licen[sc]e
ofl-1.1 85 0.95 this font software is licen[sc]ed under the <sil> open font licen[sc]e
ofl 80 0.85 with <reserved> font name
bitstream-vera 84 0.9 <bitstream> vera(?: fonts)? copyright
ubuntu-font 84 0.9 <ubuntu> font licen[sc]e
lppl 84 0.9 <latex> project public licen[sc]e|<lppl>
odbl 82 0.9 <open> data commons open database licen[sc]e
ogl-uk 82 0.9 <open> government licen[sc]e(?: v\d(?: \d)?| version \d(?: \d)?)?
etalab 82 0.9 open licence <etalab>|<licence> ouverte
dl-de 82 0.9 <datenlizenz> deutschland
cdla-permissive 82 0.9 <community> data licen[sc]e agreement permissive
cdla-sharing 82 0.9 <community> data licen[sc]e agreement sharing
geogratis 82 0.85 <geogratis> unrestricted use
cern-ohl 82 0.9 <cern> open hardware licen[sc]e
tapr-ohl 82 0.9 <tapr> open hardware licen[sc]e
solderpad 82 0.9 <solderpad> hardware licen[sc]e
cecill 82 0.9 this software is governed by the <cecill> (?:b |c )?licen[sc]e
cecill-b 84 0.9 <cecill> b
cecill-c 84 0.9 <cecill> c
eupl 84 0.9 licen[sc]ed under the <eupl>|<european> union public licence
mulan-psl 84 0.9 <mulan> (?:permissive software|psl)
openrail 84 0.9 <openrail>(?: m)?|<responsible> ai licen[sc]e
llama 84 0.9 <llama> \d? ?community licen[sc]e
elastic-2 84 0.9 <elastic> licen[sc]e(?: 2 0)?
sspl-1 84 0.9 <server> side public licen[sc]e version 1
confluent 84 0.9 <confluent> community licen[sc]e
commons-clause 86 0.9 <commons> clause(?: licen[sc]e condition)?
polyform-nc 86 0.9 <polyform> non ?commercial
polyform-shield 86 0.9 <polyform> shield
polyform-small 86 0.9 <polyform> small business
prosperity 84 0.9 <prosperity> public licen[sc]e
parity 84 0.9 <parity> public licen[sc]e
hippocratic 84 0.9 <hippocratic> licen[sc]e
anti-996 84 0.9 <anti> 996 licen[sc]e
blue-oak 84 0.9 <blue> oak model licen[sc]e
copyfree 80 0.8 <copyfree> open innovation licen[sc]e
aladdin 84 0.9 <aladdin> free public licen[sc]e
sleepycat 84 0.9 <sleepycat> (?:public )?licen[sc]e|<sleepycat> software
sugarcrm 84 0.9 <sugarcrm> public licen[sc]e
zope 84 0.9 <zope> public licen[sc]e|<zpl> \d \d
ms-limited 84 0.9 <microsoft> limited (?:public|reciprocal) licen[sc]e
ms-research 84 0.9 <microsoft> research (?:shared source )?licen[sc]e
intel 84 0.85 <intel> open source licen[sc]e|<intel> simplified software licen[sc]e
nvidia-eula 84 0.85 <nvidia> (?:software )?licen[sc]e agreement|<nvidia> end user licen[sc]e
oracle-bcl 84 0.85 <oracle> binary code licen[sc]e
adobe 84 0.85 <adobe> (?:systems )?(?:glyph list|postscript|source code) licen[sc]e
qt-commercial 84 0.85 <qt> commercial licen[sc]e
amazon-sl 84 0.9 <amazon> software licen[sc]e
eula 55 0.7 end <user> licen[sc]e agreement
shareware 55 0.6 this (?:program|software) is <shareware>
freeware 55 0.6 this (?:program|software) is <freeware>
trial 54 0.5 <evaluation> licen[sc]e|trial period licen[sc]e <evaluation>
non-commercial 56 0.7 for (?:personal and )?non ?commercial use <only>|free for non ?commercial use <only>
academic-only 56 0.7 for (?:academic|research|educational)(?: and (?:academic|research|educational))? (?:use|purposes) <only>
no-derivatives 50 0.5 no <derivative> works(?: are)? (?:allowed|permitted)
proprietary 60 0.8 <proprietary> and confidential|confidential and <proprietary>
proprietary 58 0.7 <unauthori>[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|software|document|material).{0,40}?(?:is )?strictly prohibited
proprietary 57 0.7 may not be (?:copied|reproduced|distributed|disclosed).{0,60}?without (?:the )?(?:express |prior )*written (?:permission|consent) of the <copyright>
proprietary 56 0.6 this (?:software|program|document) contains <trade> secrets
all-rights-reserved 35 0.4 all rights <reserved>
warranty-disclaimer 30 0.3 (?:is )?provided as is without <warranty> of any kind
warranty-disclaimer 31 0.3 <merchantability> (?:or|and) fitness for a particular purpose
liability-disclaimer 30 0.3 in no event shall .{1,80}? be <liable> for any
other-license 10 0.4 licen[sc]ed under the <terms> of the [a-z0-9 ]{1,40}? licen[sc]e
dual-license 60 0.6 <dual> licen[sc]ed under
see-license 20 0.3 see (?:the )?<licen>[sc]e(?: file| txt| md)? for (?:more )?(?:details|information|full terms)|see the <accompanying> licen[sc]e
gpl-2 70 0.8 licen[sc]e <gpl> 2
mit 70 0.8 licen[sc]e <mit>
bsd 70 0.7 licen[sc]e <bsd>
apache-2 71 0.8 licen[sc]e <apache> 2 0
"""
