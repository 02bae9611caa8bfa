"""License scan by ordered signature rules.

A rule is a regular expression over the words of a text, lower-cased and joined
by single spaces, with a keyword that must be among the words and a priority.
Hundreds of rules are written below: passages of license texts, identifiers,
notices, names and short forms. Where detections overlap, those with higher
priority go first and suppress what lies within them.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import free_name, lean


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int  # 0 to 100; also the confidence in per cent
    keyword: str
    pattern: str
    base: bool = False


#: phrase, label, keyword: phrases whose every place counts and whose labels are never suppressed.
PHRASES = (("under the mit license", "mit", "mit"), ("apache license version 2", "apache-2", "apache"), ("cc by nc", "cc-by-nc", "nc"))

#: Signatures by priority, written as label | keyword | pattern over words: license texts.
TEXTS = r"""
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | sublicense | rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | copies | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | disclaims | the software is provided as is and the author disclaims all warranties with regard to this software
bsd-0 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
bsd | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3 | endorse | neither the names? of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-3 | endorse | the names? of (?:\S+ ){1,12}may not be used to endorse or promote products derived from this software
bsd-4 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2 | documentation | the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
apache-2 | compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2 | apache | licensed under the apache license version 2 0 the license
apache-2 | perpetual | hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of
apache-2 | asf | licensed to the apache software foundation asf under one or more contributor license agreements
apache-1 | apache | products derived from this software may not be called apache nor may apache appear in their name
gpl-1 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 1
gpl-2 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license(?: version 2)? as published by the free software foundation(?: either version 2| version 2)?
gpl-3 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license(?: version 3)? as published by the free software foundation (?:either )?version 3
gpl | received | you should have received a copy of the gnu general public license along with this (?:program|software|library|file)
gpl | freedom | the gnu general public license is intended to guarantee your freedom to share and change
gpl-3 | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-2 | distribute | you may copy and distribute verbatim copies of the program s source code as you receive it
lgpl-2.1 | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3 | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3
lgpl-2 | redistribute | you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2
lgpl | received | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|software|library|file)
lgpl-3 | supplemented | incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions
agpl-3 | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3
agpl-3 | affero | you should have received a copy of the gnu affero general public license along with this (?:program|software|file)
agpl-3 | remotely | your modified version must prominently offer all users interacting with it remotely through a computer network
gpl-2 | independent | the copyright holders of this library give you permission to link this library with independent modules to produce an executable
gfdl | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
mpl-2 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance
epl-1 | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2 | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
edl | accompanying | this program and the accompanying materials are made available under the terms of the eclipse distribution license v 1 0
cddl | distribution | the contents of this file are subject to the terms of the common development and distribution license
cpl | accompanying | the accompanying program is provided under the terms of this common public license
ibm-pl | accompanying | the accompanying program is provided under the terms of this ibm public license
eupl | eupl | licensed under the eupl(?: version)? 1 [12]
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | arising | in no event will the authors be held liable for any damages arising from the use of this software
libpng | png | the png reference library is supplied as is
boost | obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
boost | boost | distributed under the boost software license version 1 0
artistic | conditions | the intent of this document is to state the conditions under which a package may be copied
artistic | redistribute | you can redistribute it and or modify it under the same terms as perl itself
psf | psf | psf hereby grants licensee a nonexclusive royalty free world wide license
php | php | this product includes php software freely available from http www php net software
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | eric | this product includes cryptographic software written by eric young
postgresql | documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | benefit | we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
wtfpl | fuck | do what the fuck you want to public license
wtfpl | fuck | you just do what the fuck you want to
ofl | software | this font software is licensed under the sil open font license version 1 1
ofl | individual | neither the font software nor any of its individual components in original or modified versions may be sold by itself
odbl | database | this database is made available under the open database license
pddl | database | this database is made available under the public domain dedication and license
cc0 | associated | the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights
cc0 | affirmer | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc-by | creative | this work is licensed under a creative commons attribution [1234] [05] (?:international|unported|generic) license
cc-by-sa | sharealike | this work is licensed under a creative commons attribution sharealike [1234] [05] (?:international|unported|generic) license
cc-by-nd | noderivatives | this work is licensed under a creative commons attribution noderivatives [1234] [05] (?:international|unported|generic) license
cc-by-nc | noncommercial | this work is licensed under a creative commons attribution noncommercial [1234] [05] (?:international|unported|generic) license
cc-by-nc-sa | noncommercial | this work is licensed under a creative commons attribution noncommercial sharealike [1234] [05] (?:international|unported|generic) license
cc-by-nc-nd | noncommercial | this work is licensed under a creative commons attribution noncommercial noderivatives [1234] [05] (?:international|unported|generic) license
cc-by | adapt | you are free to share copy and redistribute the material in any medium or format and adapt remix transform and build upon the material for any purpose even commercially
cc-by-nc | commercial | you may not use the material for commercial purposes
cc-by | creativecommons | creativecommons org licenses by [1234] [05]
cc-by-sa | creativecommons | creativecommons org licenses by sa [1234] [05]
cc-by-nd | creativecommons | creativecommons org licenses by nd [1234] [05]
cc-by-nc | creativecommons | creativecommons org licenses by nc [1234] [05]
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1234] [05]
cc0 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | creativecommons org publicdomain mark 1 0
bsl | licensor | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
sspl | service | if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
elastic | hosted | you may not provide the software to third parties as a hosted or managed service
commons-clause | sell | the license does not grant to you the right to sell the software
ms-pl | accompanying | this license governs use of the accompanying software if you use the software you accept this license
json | evil | the software shall be used for good not evil
vim | vim | there are no restrictions on distributing unmodified copies of vim
w3c | understood | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with
ncsa | illinois | neither the names of (?:\S+ ){1,8}university of illinois nor the names of its contributors may be used to endorse
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer in return
beerware | ware | the beer ware license(?: revision 42)?
beerware | beerware | the beerware license(?: revision 42)?
mit-0 | obtaining | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
x11 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
hpnd | permission | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appears? in all copies
blueoak | contributor | each contributor licenses you to do everything with this software that would otherwise infringe that contributor s copyright in it
upl | documentation | permission is hereby granted free of charge subject to the following condition to any person obtaining a copy of this software associated documentation and or data
proprietary | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
proprietary | disclosed | may not be disclosed copied or distributed without the (?:prior )?(?:express )?written (?:consent|permission)
proprietary | trade | contains (?:confidential|proprietary) information and trade secrets
all-rights-reserved | reproduced | no part of this (?:publication|book|work|document) may be reproduced(?: stored)?
"""
#: SPDX identifiers.
IDENTIFIERS = """
mit | spdx | spdx license identifier mit
mit-0 | spdx | spdx license identifier mit 0
x11 | spdx | spdx license identifier x11
expat | spdx | spdx license identifier expat
apache-1 | spdx | spdx license identifier apache 1 [01]
apache-2 | spdx | spdx license identifier apache 2 0
apache | spdx | spdx license identifier apache
bsd-2 | spdx | spdx license identifier bsd 2 clause
bsd-3 | spdx | spdx license identifier bsd 3 clause
bsd-4 | spdx | spdx license identifier bsd 4 clause
bsd-0 | spdx | spdx license identifier 0bsd
bsd | spdx | spdx license identifier bsd
gpl-1 | spdx | spdx license identifier gpl 1 0(?: only| or later)?
gpl-2 | spdx | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3 | spdx | spdx license identifier gpl 3 0(?: only| or later)?
gpl | spdx | spdx license identifier gpl
gpl-2 | spdx | spdx license identifier gpl 2 0 with classpath exception 2 0
gpl-3 | spdx | spdx license identifier gpl 3 0 with gcc exception 3 1
gpl-2 | spdx | spdx license identifier gplv2
gpl-3 | spdx | spdx license identifier gplv3
lgpl-2 | spdx | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl | spdx | spdx license identifier lgpl
lgpl-2.1 | spdx | spdx license identifier lgplv2
lgpl-3 | spdx | spdx license identifier lgplv3
agpl-3 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 | spdx | spdx license identifier agplv3
gfdl | spdx | spdx license identifier gfdl 1 [123]
mpl-1.1 | spdx | spdx license identifier mpl 1 [01]
mpl-2 | spdx | spdx license identifier mpl 2 0
mpl | spdx | spdx license identifier mpl
epl-1 | spdx | spdx license identifier epl 1 0
epl-2 | spdx | spdx license identifier epl 2 0
edl | spdx | spdx license identifier edl 1 0
cddl | spdx | spdx license identifier cddl 1 [01]
cpl | spdx | spdx license identifier cpl 1 0
ibm-pl | spdx | spdx license identifier ipl 1 0
eupl | spdx | spdx license identifier eupl 1 [12]
isc | spdx | spdx license identifier isc
zlib | spdx | spdx license identifier zlib
libpng | spdx | spdx license identifier libpng
boost | spdx | spdx license identifier bsl 1 0
artistic | spdx | spdx license identifier artistic [12] 0
psf | spdx | spdx license identifier psf 2 0
php | spdx | spdx license identifier php 3 0[01]?
ruby | spdx | spdx license identifier ruby
openssl | spdx | spdx license identifier openssl
ssleay | spdx | spdx license identifier ssleay
postgresql | spdx | spdx license identifier postgresql
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
ofl | spdx | spdx license identifier ofl 1 [01]
odbl | spdx | spdx license identifier odbl 1 0
odc-by | spdx | spdx license identifier odc by 1 0
pddl | spdx | spdx license identifier pddl 1 0
bsl | spdx | spdx license identifier busl 1 1
sspl | spdx | spdx license identifier sspl 1 0
elastic | spdx | spdx license identifier elastic 2 0
commons-clause | spdx | spdx license identifier commons clause 1 0
ms-pl | spdx | spdx license identifier ms pl
ms-rl | spdx | spdx license identifier ms rl
json | spdx | spdx license identifier json
vim | spdx | spdx license identifier vim
w3c | spdx | spdx license identifier w3c
ncsa | spdx | spdx license identifier ncsa
afl | spdx | spdx license identifier afl 3 0
osl | spdx | spdx license identifier osl 3 0
upl | spdx | spdx license identifier upl 1 0
blueoak | spdx | spdx license identifier blueoak 1 0 0
cc0 | spdx | spdx license identifier cc0 1 0
cc0 | spdx | spdx license identifier cc zero 1 0
cc-by | spdx | spdx license identifier cc by [1234] [05]
cc-by-sa | spdx | spdx license identifier cc by sa [1234] [05]
cc-by-nd | spdx | spdx license identifier cc by nd [1234] [05]
cc-by-nc | spdx | spdx license identifier cc by nc [1234] [05]
cc-by-nc-sa | spdx | spdx license identifier cc by nc sa [1234] [05]
cc-by-nc-nd | spdx | spdx license identifier cc by nc nd [1234] [05]
cc-by | spdx | spdx license identifier creative commons by
cc-by-sa | spdx | spdx license identifier creative commons by sa
cc-by-nd | spdx | spdx license identifier creative commons by nd
cc-by-nc | spdx | spdx license identifier creative commons by nc
cc-by-nc-sa | spdx | spdx license identifier creative commons by nc sa
cc-by-nc-nd | spdx | spdx license identifier creative commons by nc nd
public-domain | spdx | spdx license identifier public domain
proprietary | spdx | spdx license identifier proprietary
all-rights-reserved | spdx | spdx license identifier all rights reserved
"""
#: Headers, notices, classifiers and addresses.
NOTICES = r"""
mit | mit | (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?mit licen[sc]e
mit | mit | see (?:the )?licen[sc]e(?: md| txt)? (?:file )?for (?:the )?mit licen[sc]e
apache-2 | apache | (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[sc]e(?: version)? 2(?: 0)?
apache | asl | licensed under (?:the )?asl
bsd | bsd | (?:released|licensed|distributed|available|published|provided) under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style)? licen[sc]e
bsd | bsd | use of this source code is governed by a bsd style license that can be found in the license file
mit | mit | use of this source code is governed by an mit style license that can be found in the license file
bsd-3 | bsd | (?:released|licensed|distributed) under (?:the )?(?:3 clause|new|modified|revised) bsd
bsd-2 | bsd | (?:released|licensed|distributed) under (?:the )?(?:2 clause|simplified) bsd
gpl | gpl | (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl
gpl-2 | gpl | (?:released|licensed|distributed) under (?:the )?(?:gnu )?gpl(?: version| v)? 2(?: 0)?
gpl-3 | gpl | (?:released|licensed|distributed) under (?:the )?(?:gnu )?gpl(?: version| v)? 3(?: 0)?
gpl | general | (?:released|licensed|distributed) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e
lgpl | lgpl | (?:released|licensed|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl
agpl-3 | agpl | (?:released|licensed|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agpl
mpl | mpl | (?:released|licensed|distributed|available) under (?:the )?(?:terms of (?:the )?)?mpl
mpl-2 | mpl | (?:released|licensed|distributed|available) under (?:the )?mpl(?: version| v)? 2(?: 0)?
epl-2 | epl | (?:released|licensed|distributed|available) under (?:the )?epl(?: version| v)? 2(?: 0)?
isc | isc | (?:released|licensed|distributed|available) under (?:the )?isc licen[sc]e
cc-by | cc | (?:released|licensed|distributed|available|published) under (?:a |the )?cc by(?: licen[sc]e)?
cc-by-sa | cc | (?:released|licensed|distributed|available|published) under (?:a |the )?cc by sa
cc-by-nc | cc | (?:released|licensed|distributed|available|published) under (?:a |the )?cc by nc
cc0 | cc0 | (?:released|licensed|distributed|available|published) under cc0
unlicense | unlicense | (?:released|licensed|distributed|available) under (?:the )?unlicense
wtfpl | wtfpl | (?:released|licensed|distributed|available) under (?:the )?wtfpl
zlib | zlib | (?:released|licensed|distributed|available) under (?:the )?zlib licen[sc]e
boost | boost | see accompanying file license 1 0 txt or copy at https? www boost org license 1 0 txt
ofl | ofl | (?:released|licensed|distributed|available) under (?:the )?(?:sil )?ofl
dual | dual | dual licensed under (?:the )?\S+(?: \S+){0,4} and (?:the )?\S+
mit | mit | license mit(?! licen[sc]e)
apache-2 | apache | license apache(?: license)? 2 0
bsd-3 | bsd | license bsd 3 clause
gpl-3 | gpl | license gpl(?: v)? ?3
isc | isc | license isc(?! licen[sc]e)
cc-by-sa | attribution | text is available under the creative commons attribution share ?alike licen[sc]e
mit | osi | license osi approved mit license
apache-2 | osi | license osi approved apache software license
bsd | osi | license osi approved bsd license
gpl-3 | osi | license osi approved gnu general public license v3(?: or later)?(?: gplv3\+?)?
gpl-2 | osi | license osi approved gnu general public license v2(?: or later)?(?: gplv2\+?)?
lgpl | osi | license osi approved gnu lesser general public license
mpl-2 | osi | license osi approved mozilla public license 2 0
isc | osi | license osi approved isc license
mit | opensource | opensource org licen[sc]es mit(?: licen[sc]e(?: php)?)?
apache-2 | opensource | opensource org licen[sc]es apache 2 0
bsd-3 | opensource | opensource org licen[sc]es bsd 3 clause
bsd-2 | opensource | opensource org licen[sc]es bsd 2 clause
gpl | gnu | gnu org (?:licenses|copyleft) gpl(?: html| txt)?
lgpl | gnu | gnu org (?:licenses|copyleft) lgpl(?: html| txt)?
agpl-3 | gnu | gnu org licenses agpl(?: 3 0)?(?: html| txt)?
gfdl | gnu | gnu org (?:licenses|copyleft) fdl(?: html| txt)?
apache-2 | apache | apache org licenses license 2 0
mpl-2 | mozilla | mozilla org mpl 2 0
unlicense | unlicense | unlicense org
wtfpl | wtfpl | wtfpl net
"""
#: Names of licenses.
NAMES = """
mit | mit | (?:mit|mit x11|mit expat) licen[sc]e
mit-0 | attribution | mit no attribution(?: licen[sc]e)?
x11 | x11 | x11 licen[sc]e
expat | expat | expat licen[sc]e
apache-1 | apache | apache (?:software )?licen[sc]e version 1(?: [01])?
apache-2 | apache | apache (?:software )?licen[sc]e(?: version)? 2(?: 0)?
apache | apache | apache (?:software )?licen[sc]e
bsd-2 | bsd | (?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e
bsd-3 | bsd | (?:modified|new|revised|3 clause|three clause) bsd licen[sc]e
bsd-4 | bsd | (?:original|4 clause|four clause) bsd licen[sc]e
bsd-0 | bsd | (?:zero clause|free public) bsd licen[sc]e
bsd | bsd | bsd(?: style)? licen[sc]e
gpl-1 | general | gnu general public licen[sc]e version 1(?: 0)?
gpl-2 | general | gnu general public licen[sc]e version 2(?: 0)?
gpl-3 | general | gnu general public licen[sc]e version 3(?: 0)?
gpl | general | gnu general public licen[sc]e
gpl-2 | gpl | gpl version 2(?: 0)?
gpl-3 | gpl | gpl version 3(?: 0)?
gpl-2 | gplv2 | gplv2(?: licen[sc]e)?
gpl-3 | gplv3 | gplv3(?: licen[sc]e)?
lgpl-2 | library | gnu library general public licen[sc]e(?: version 2(?: 0)?)?
lgpl-2.1 | lesser | gnu lesser general public licen[sc]e version 2 1
lgpl-3 | lesser | gnu lesser general public licen[sc]e version 3(?: 0)?
lgpl | lesser | gnu lesser general public licen[sc]e
lgpl-2.1 | lgplv2 | lgplv2(?: 1)?(?: licen[sc]e)?
lgpl-3 | lgplv3 | lgplv3(?: licen[sc]e)?
agpl-3 | affero | gnu affero general public licen[sc]e(?: version 3(?: 0)?)?
agpl-3 | agplv3 | agplv3(?: licen[sc]e)?
gfdl | documentation | gnu free documentation licen[sc]e(?: version 1 [123])?
mpl-1.1 | mozilla | mozilla public licen[sc]e(?: version)? 1 [01]
mpl-2 | mozilla | mozilla public licen[sc]e(?: version)?(?: v)? ?2(?: 0)?
mpl | mozilla | mozilla public licen[sc]e
epl-1 | eclipse | eclipse public licen[sc]e(?: version)?(?: v)? ?1(?: 0)?
epl-2 | eclipse | eclipse public licen[sc]e(?: version)?(?: v)? ?2(?: 0)?
edl | eclipse | eclipse distribution licen[sc]e(?: version)?(?: 1 0)?
cddl | distribution | common development and distribution licen[sc]e(?: version)?(?: 1 [01])?
cpl | common | common public licen[sc]e(?: version)?(?: 1 0)?
ibm-pl | ibm | ibm public licen[sc]e(?: version)?(?: 1 0)?
eupl | european | european union public licen[sc]e(?: version)?(?: 1 [12])?
isc | isc | (?:isc|internet systems consortium) licen[sc]e
zlib | zlib | zlib(?: libpng)? licen[sc]e
libpng | libpng | libpng licen[sc]e
boost | boost | boost software licen[sc]e(?: version)?(?: 1 0)?
artistic | artistic | (?:perl )?artistic licen[sc]e(?: version)?(?: [12] 0)?
psf | python | python software foundation licen[sc]e(?: version)?(?: 2)?
php | php | php licen[sc]e(?: version)?(?: 3 0[01]?)?
ruby | ruby | ruby(?: s)? licen[sc]e
openssl | openssl | openssl licen[sc]e
ssleay | ssleay | (?:original )?ssleay licen[sc]e
postgresql | postgresql | postgresql licen[sc]e
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl(?: licen[sc]e)?(?: version 2)?
ofl | font | sil open font licen[sc]e(?: version)?(?: 1 [01])?
odbl | database | open(?: data commons open)? database licen[sc]e(?: version)?(?: 1 0)?
odc-by | commons | open data commons attribution licen[sc]e(?: version)?(?: 1 0)?
pddl | dedication | (?:public domain dedication and licen[sc]e|open data commons public domain dedication)(?: version)?(?: 1 0)?
bsl | business | business source licen[sc]e(?: version)?(?: 1 [01])?
sspl | server | server side public licen[sc]e(?: version)?(?: 1(?: 0)?)?
elastic | elastic | elastic licen[sc]e(?: version)?(?: 2(?: 0)?)?
commons-clause | clause | commons clause licen[sc]e condition(?: v)?(?: 1 0)?
ms-pl | microsoft | microsoft public licen[sc]e
ms-rl | microsoft | microsoft reciprocal licen[sc]e
json | json | json licen[sc]e
vim | vim | vim licen[sc]e
w3c | w3c | w3c software(?: notice and)? licen[sc]e
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[sc]e
afl | academic | academic free licen[sc]e(?: version)?(?: [123] [01])?
osl | open | open software licen[sc]e(?: version)?(?: [123] [01])?
upl | universal | universal permissive licen[sc]e(?: version)?(?: 1 0)?
blueoak | oak | blue oak model licen[sc]e(?: version)?(?: 1 0 0)?
cc0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0 | creative | creative commons zero(?: v)?(?: 1 0)?(?: universal)?
cc-by | cc | cc by [1234] [05]
cc-by-sa | cc | cc by sa(?: [1234] [05])?
cc-by-nd | cc | cc by nd(?: [1234] [05])?
cc-by-nc | cc | cc by nc(?: [1234] [05])?
cc-by-nc-sa | cc | cc by nc sa(?: [1234] [05])?
cc-by-nc-nd | cc | cc by nc nd(?: [1234] [05])?
cc-by | creative | creative commons attribution(?: [1234] [05])?(?: international| unported)?
cc-by-sa | creative | creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)?
cc-by-nd | creative | creative commons attribution no ?deriv(?:s|atives)(?: [1234] [05])?
cc-by-nc | creative | creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported)?
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1234] [05])?
public-domain | domain | (?:released|placed|dedicated|is)(?: in| into| to) the public domain
proprietary | proprietary | proprietary and confidential
all-rights-reserved | reserved | all rights reserved
"""
#: Short forms, which a text may have for other reasons too.
SHORT_FORMS = """
mit | mit | mit licensed
mit-0 | mit | mit 0 licen[sc]e
x11 | x11 | x11 licensed
expat | expat | expat licensed
apache-1 | apache | apache 1(?: [01])?
apache-2 | apache | apache 2(?: 0)?
apache | apache | apache licensed
bsd-2 | bsd | bsd 2 clause(?: licen[sc]e)?
bsd-3 | bsd | bsd 3 clause(?: licen[sc]e)?
bsd-4 | bsd | bsd 4 clause(?: licen[sc]e)?
bsd-0 | 0bsd | 0bsd
bsd | bsd | bsd licensed
gpl-1 | gnu | gnu general public licen[sc]e v1
gpl-2 | gnu | gnu general public licen[sc]e v2
gpl-3 | gnu | gnu general public licen[sc]e v3
gpl | general | general public licen[sc]e of gnu
gpl-2 | gpl | gpl v2
gpl-3 | gpl | gpl v3
gpl-2 | gplv2 | gplv2 or later
gpl-3 | gplv3 | gplv3 or later
lgpl-2 | library | library gpl(?: 2)?
lgpl-2.1 | lesser | lesser gpl 2 1
lgpl-3 | lesser | lesser gpl 3
lgpl | lesser | lesser gpl
lgpl-2.1 | lgplv2 | lgplv2 or later
lgpl-3 | lgplv3 | lgplv3 or later
agpl-3 | affero | affero gpl(?: 3)?
agpl-3 | agplv3 | agplv3 or later
gfdl | free | free documentation licen[sc]e
mpl-1.1 | mozilla | mozilla licen[sc]e 1 [01]
mpl-2 | mozilla | mozilla licen[sc]e 2(?: 0)?
mpl | mozilla | mozilla licensed
epl-1 | eclipse | eclipse licen[sc]e 1 0
epl-2 | eclipse | eclipse licen[sc]e 2 0
edl | eclipse | eclipse distribution terms
cddl | cddl | cddl licen[sc]e(?: 1 [01])?
cpl | common | common public licen[sc]e v1
ibm-pl | ibm | ibm public terms
eupl | european | european public licen[sc]e
isc | isc | isc licensed
zlib | zlib | zlib licensed
libpng | libpng | libpng licensed
boost | boost | boost licen[sc]e(?: 1 0)?
artistic | artistic | artistic licensed
psf | python | python licen[sc]e(?: 2 0)?
php | php | php licensed
ruby | ruby | ruby licensed
openssl | openssl | openssl licensed
ssleay | ssleay | ssleay licensed
postgresql | postgresql | postgresql licensed
unlicense | unlicense | unlicense licensed
wtfpl | wtfpl | wtfpl licensed
ofl | open | open font licen[sc]e(?: 1 1)?
odbl | open | open database terms
odc-by | data | data commons attribution
pddl | public | public domain dedication terms
bsl | business | business source terms
sspl | server | server side public terms
elastic | elastic | elastic licensed
commons-clause | commons | commons clause restriction
ms-pl | microsoft | microsoft public terms
ms-rl | microsoft | microsoft reciprocal terms
json | json | json licensed
vim | vim | vim licensed
w3c | w3c | w3c licensed
ncsa | ncsa | ncsa licensed
afl | academic | academic free terms
osl | open | open software terms
upl | universal | universal permissive terms
blueoak | blue | blue oak terms
cc0 | cc0 | cc0 licensed
cc0 | creative | creative commons public domain
cc-by | cc | cc attribution
cc-by-sa | cc | cc share alike
cc-by-nd | cc | cc no derivatives
cc-by-nc | cc | cc non commercial
cc-by-nc-sa | cc | cc non commercial share alike
cc-by-nc-nd | cc | cc non commercial no derivatives
cc-by | creative | creative commons by
cc-by-sa | creative | creative commons by sa
cc-by-nd | creative | creative commons by nd
cc-by-nc | creative | creative commons by nc
cc-by-nc-sa | creative | creative commons by nc sa
cc-by-nc-nd | creative | creative commons by nc nd
public-domain | in | in the public domain
proprietary | proprietary | proprietary licen[sc]e
all-rights-reserved | rights | rights reserved by
"""
SIGNATURES = ((95, TEXTS), (90, IDENTIFIERS), (85, NOTICES), (70, NAMES), (50, SHORT_FORMS))


@functools.lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in their order: the base phrases, then by priority as listed."""
    made = [Rule(label, 100, keyword, phrase, True) for phrase, label, keyword in PHRASES]
    for priority, lines in SIGNATURES:
        made += [Rule(label, priority, keyword, pattern) for label, keyword, pattern in (line.split(" | ") for line in lines.strip().splitlines())]
    return tuple(made)


@functools.lru_cache(maxsize=1)
def _compiled() -> dict[str, list[tuple[int, Rule, re.Pattern]]]:
    """By keyword: rules with their rank, compiled between word borders."""
    out: dict[str, list[tuple[int, Rule, re.Pattern]]] = {}
    for k, rule in enumerate(rules()):
        out.setdefault(rule.keyword, []).append((k, rule, re.compile(rf"(?<!\S)(?:{rule.pattern})(?!\S)")))
    return out


class Containment:
    """Spans of words, and whether one of them contains another, in steps that grow with the logarithm of their number.

    For each start a tree holds the largest end among the spans that start there or before.
    """

    def __init__(self, starts: list[int]) -> None:
        self._starts = sorted(set(starts))
        self._ends = [-1] * (len(self._starts) + 1)

    def add(self, first: int, last: int) -> None:
        k = bisect_left(self._starts, first) + 1
        while k < len(self._ends):
            self._ends[k] = max(self._ends[k], last)
            k += k & -k

    def holds(self, first: int, last: int) -> bool:
        k = bisect_right(self._starts, first)
        while k:
            if self._ends[k] >= last:
                return True
            k -= k & -k
        return False


_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def scan_words(words: list[bytes]) -> list[tuple[str, int, int, int, bool]]:
    """(label, first word, last word, priority, base) of all base places and all detections that aren't suppressed, in order of place."""
    compiled = _compiled()
    keys = {w.decode() for w in _keywords().intersection(words)}
    if not keys:
        return []
    joined = b" ".join(words).decode()
    starts = [0, *accumulate(len(w.decode()) + 1 for w in words)]
    found = []
    for key in keys:
        for rank, rule, pattern in compiled[key]:
            for m in pattern.finditer(joined):
                found.append((-rule.priority, rank, bisect_left(starts, m.start()), bisect_left(starts, m.end() + 1) - 1, rule))
    kept: list[tuple[str, int, int, int, bool]] = []
    spans = Containment([first for _, _, first, _, _ in found])
    for _, _, first, last, rule in sorted(found, key=lambda x: (x[0], x[2] - x[3], x[1], x[2])):
        if rule.base or not spans.holds(first, last):
            kept.append((rule.label, first, last, rule.priority, rule.base))
            if not rule.base:
                spans.add(first, last)
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


@functools.lru_cache(maxsize=1)
def _keywords() -> frozenset[bytes]:
    return frozenset(k.encode() for k in _compiled())


DETECTION = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("priority", pa.int32()), ("base", pa.bool_())])


def scan(docs: DataFrame, *, text: str = "text", n_into: str = "n_words", into: str = "detections") -> DataFrame:
    """``docs`` with the number of words and an array of detections in two new columns.

    A detection has label, first and last word (from 0), priority and base. The
    base phrases are found at every place; whatever else is found stays unless
    a detection of higher priority, or an equal one listed before it, contains
    it. Whole texts are read, null counts as empty. Rows are neither merged
    nor dropped; columns of the two names, in upper or lower case, are replaced.
    """

    @F.arrow_udf("n long, found array<struct<label:string,first:long,last:long,priority:int,base:boolean>>")
    @lean
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, found = [], []
            for body in batch.cast(pa.binary()).to_pylist():
                words = _WORDS.findall((body or b"").lower())
                counts.append(len(words))
                found.append([dict(zip(("label", "first", "last", "priority", "base"), x, strict=True)) for x in scan_words(words)])
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(found, pa.list_(DETECTION))], ["n", "found"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (n_into.lower(), into.lower())]
    seen = free_name(docs, "seen")
    out = docs.select(*kept, look(F.col(text).cast("string")).alias(seen))
    return out.select(*kept, F.col(f"{seen}.n").alias(n_into), F.col(f"{seen}.found").alias(into))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    from chronofold.llm.common import table

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("detections", lambda d: d["base"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])) / 100, F.lit(0.0)).alias("score"),
    )
