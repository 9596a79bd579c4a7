"""Hand-written licence signatures.

One rule a line: ``label | priority | keyword | regex``. The regex runs over the text's lower-case
words joined by single spaces and matches whole words; the keyword is a word that any match holds.
A higher priority wins where detections overlap; full texts and exact versions rank above names,
names above hints.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

BASE = """
mit | 50 | license | mit license
apache | 50 | license | apache license
gpl | 50 | license | general public license
"""

MORE = r"""
mit | 90 | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | 85 | software | the software is provided as is without warranty of any kind express or implied
mit | 70 | mit | (?:licensed|released|distributed|available) under (?:the )?mit
mit | 70 | mit | spdx license identifier mit
mit | 60 | expat | expat license
mit-0 | 75 | mit | mit no attribution(?: license)?
mit-0 | 80 | mit | spdx license identifier mit 0
mit-modern | 75 | mit | modern mit variant
x11 | 70 | x11 | x11 license
x11 | 75 | x11 | spdx license identifier x11
apache | 80 | apache | apache license version (?:1 0|1 1|2 0)
apache | 70 | apache | (?:licensed|released) under (?:the )?apache(?: 2 0)?
apache-2.0 | 85 | apache | apache license version 2 0
apache-2.0 | 85 | apache | spdx license identifier apache 2 0
apache-2.0 | 80 | apache | apache 2 0 licen[sc]e
apache-2.0 | 80 | apache | apache org licenses license 2 0
apache-1.1 | 85 | apache | apache software license version 1 1
apache-1.1 | 85 | apache | spdx license identifier apache 1 1
apache-1.0 | 85 | apache | apache software license version 1 0
gpl-3.0 | 85 | gnu | gnu general public license (?:as published by the free software foundation )?(?:either )?version 3
gpl-3.0 | 85 | gpl | spdx license identifier gpl 3 0(?: only| or later)?
gpl-3.0 | 75 | gplv3 | (?:gnu )?gplv3
gpl-2.0 | 85 | gnu | gnu general public license (?:as published by the free software foundation )?(?:either )?version 2
gpl-2.0 | 85 | gpl | spdx license identifier gpl 2 0(?: only| or later)?
gpl-2.0 | 75 | gplv2 | (?:gnu )?gplv2
gpl-1.0 | 85 | gnu | gnu general public license version 1
gpl | 70 | gnu | gnu general public license
gpl | 60 | gpl | (?:licensed|released|distributed) under (?:the )?(?:gnu )?gpl
gpl | 60 | foundation | terms of the gnu general public license as published by the free software foundation
gpl | 80 | useful | distributed in the hope that it will be useful but without any warranty
lgpl | 90 | lesser | (?:gnu )?lesser general public license
lgpl | 90 | library | (?:gnu )?library general public license
lgpl-3.0 | 95 | lesser | (?:gnu )?lesser general public license version 3
lgpl-2.1 | 95 | lesser | (?:gnu )?lesser general public license version 2 1
lgpl-2.0 | 95 | library | (?:gnu )?library general public license version 2
lgpl-2.1 | 90 | lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | 90 | lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl | 60 | lgpl | (?:licensed|released) under (?:the )?(?:gnu )?lgpl
agpl | 90 | affero | (?:gnu )?affero general public license
agpl-3.0 | 95 | affero | (?:gnu )?affero general public license version 3
agpl-3.0 | 90 | agpl | spdx license identifier agpl 3 0(?: only| or later)?
agpl | 60 | agpl | (?:licensed|released) under (?:the )?(?:gnu )?agpl
agpl-3.0 | 75 | agplv3 | (?:gnu )?agplv3
gfdl | 80 | documentation | (?:gnu )?free documentation license
gfdl-1.3 | 85 | documentation | (?:gnu )?free documentation license version 1 3
gfdl-1.2 | 85 | documentation | (?:gnu )?free documentation license version 1 2
gfdl-1.1 | 85 | documentation | (?:gnu )?free documentation license version 1 1
gfdl | 75 | gfdl | spdx license identifier gfdl 1 [123](?: only| or later)?
bsd | 60 | bsd | bsd (?:style )?licen[sc]e
bsd | 60 | bsd | (?:licensed|released) under (?:the )?bsd
bsd-2-clause | 80 | bsd | (?:2|two) clause bsd(?: license)?
bsd-2-clause | 80 | bsd | bsd 2 clause(?: license)?
bsd-2-clause | 80 | simplified | simplified bsd license
bsd-2-clause | 75 | freebsd | freebsd license
bsd-3-clause | 80 | bsd | (?:3|three) clause bsd(?: license)?
bsd-3-clause | 80 | bsd | bsd 3 clause(?: license)?
bsd-3-clause | 80 | bsd | (?:new|revised|modified) bsd license
bsd-4-clause | 80 | bsd | (?:4|four) clause bsd(?: license)?
bsd-4-clause | 80 | bsd | bsd 4 clause(?: license)?
bsd-4-clause | 80 | bsd | original bsd license
bsd-4-clause | 85 | advertising | all advertising materials mentioning features or use of this software
bsd-0-clause | 80 | bsd | (?:0|zero) clause bsd(?: license)?
bsd-0-clause | 80 | 0bsd | spdx license identifier 0bsd
bsd-1-clause | 80 | bsd | bsd 1 clause(?: license)?
bsd-source-code | 75 | bsd | bsd source code attribution
bsd | 85 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 88 | endorse | neither the name of .{0,80}? may be used to endorse or promote products
isc | 75 | isc | isc license
isc | 80 | isc | spdx license identifier isc
isc | 85 | fee | permission to use copy modify and or distribute this software for any purpose with or without fee
hpnd | 80 | documentation | permission to use copy modify and distribute this software and its documentation for any purpose
zlib | 75 | zlib | zlib(?: libpng)? license
zlib | 80 | zlib | spdx license identifier zlib
zlib | 85 | misrepresented | the origin of this software must not be misrepresented
libpng | 75 | libpng | (?:libpng|png reference library) license
libtiff | 75 | libtiff | libtiff license
ijg | 75 | jpeg | independent jpeg group license
curl | 75 | curl | curl license
openssl | 75 | openssl | openssl license
ssleay | 75 | ssleay | (?:original )?ssleay license
mozilla | 75 | mozilla | mozilla public license
mpl-1.0 | 85 | mozilla | mozilla public license (?:version |v )?1 0
mpl-1.1 | 85 | mozilla | mozilla public license (?:version |v )?1 1
mpl-2.0 | 85 | mozilla | mozilla public license (?:version |v )?2 0
mpl-2.0 | 85 | mpl | spdx license identifier mpl 2 0
mpl-2.0 | 80 | mpl | mozilla org mpl 2 0
mpl-1.1 | 85 | mpl | spdx license identifier mpl 1 1
epl | 75 | eclipse | eclipse public license
epl-1.0 | 85 | eclipse | eclipse public license (?:version |v )?1 0
epl-2.0 | 85 | eclipse | eclipse public license (?:version |v )?2 0
epl-2.0 | 85 | epl | spdx license identifier epl 2 0
epl-1.0 | 85 | epl | spdx license identifier epl 1 0
edl-1.0 | 80 | eclipse | eclipse distribution license
cddl | 75 | cddl | common development and distribution license|cddl(?: license)?
cddl-1.0 | 80 | cddl | (?:common development and distribution license )?cddl (?:version )?1 0
cddl-1.1 | 80 | cddl | (?:common development and distribution license )?cddl (?:version )?1 1
cddl | 75 | development | common development and distribution license
cpl-1.0 | 75 | common | common public license(?: version 1 0)?
cpal-1.0 | 75 | attribution | common public attribution license
ipl-1.0 | 75 | ibm | ibm public license
apsl-2.0 | 75 | apple | apple public source license
aal | 75 | attribution | attribution assurance license
afl-3.0 | 75 | academic | academic free license
artistic | 70 | artistic | artistic license
artistic-1.0 | 80 | artistic | artistic license (?:version )?1 0
artistic-2.0 | 80 | artistic | artistic license (?:version )?2 0
artistic-2.0 | 80 | artistic | spdx license identifier artistic 2 0
clarified-artistic | 80 | artistic | clarified artistic license
perl | 65 | perl | (?:same terms as perl itself|perl license)
python-2.0 | 75 | python | python (?:software foundation )?license
psf-2.0 | 80 | psf | psf license(?: agreement)?
cnri-python | 75 | cnri | cnri (?:open source )?(?:python )?license agreement
beopen | 75 | beopen | beopen python open source license
ruby | 75 | ruby | ruby license
php-3.01 | 75 | php | php license(?: version 3 01)?
php-3.0 | 80 | php | php license version 3 0
zend-2.0 | 75 | zend | zend (?:engine )?license
boost | 75 | boost | boost software license
bsl-1.0 | 85 | boost | boost software license (?:version )?1 0
bsl-1.0 | 85 | bsl | spdx license identifier bsl 1 0
busl-1.1 | 80 | business | business source license(?: 1 1)?
busl-1.1 | 85 | busl | spdx license identifier busl 1 1
sspl-1.0 | 80 | server | server side public license(?: version 1)?
elastic-2.0 | 75 | elastic | elastic license(?: 2 0| v2)?
commons-clause | 75 | commons | commons clause(?: license condition)?
confluent | 75 | confluent | confluent community license
redis-sal | 75 | redis | redis source available license
polyform-nc | 80 | polyform | polyform noncommercial license
polyform-sb | 80 | polyform | polyform small business license
polyform-shield | 80 | polyform | polyform shield license
prosperity | 75 | prosperity | prosperity public license
parity | 75 | parity | parity public license
blueoak-1.0 | 75 | oak | blue oak model license
cc0-1.0 | 80 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 85 | cc0 | spdx license identifier cc0 1 0
cc0-1.0 | 85 | creative | creative commons zero
cc | 60 | creative | creative commons license
cc-by | 70 | creative | creative commons attribution(?: license)?
cc-by-4.0 | 85 | creative | creative commons attribution 4 0(?: international)?
cc-by-3.0 | 85 | creative | creative commons attribution 3 0(?: unported)?
cc-by-2.0 | 85 | creative | creative commons attribution 2 0(?: generic)?
cc-by-4.0 | 80 | cc | cc by 4 0
cc-by-3.0 | 80 | cc | cc by 3 0
cc-by-2.5 | 80 | cc | cc by 2 5
cc-by-2.0 | 80 | cc | cc by 2 0
cc-by-sa | 80 | creative | creative commons attribution share ?alike
cc-by-sa-4.0 | 85 | cc | cc by sa 4 0
cc-by-sa-3.0 | 85 | cc | cc by sa 3 0
cc-by-sa-2.0 | 85 | cc | cc by sa 2 0
cc-by-nc | 80 | creative | creative commons attribution non ?commercial
cc-by-nc-4.0 | 85 | cc | cc by nc 4 0
cc-by-nc-3.0 | 85 | cc | cc by nc 3 0
cc-by-nd | 80 | creative | creative commons attribution no ?deriv(?:s|atives)
cc-by-nd-4.0 | 85 | cc | cc by nd 4 0
cc-by-nc-sa | 88 | creative | creative commons attribution non ?commercial share ?alike
cc-by-nc-sa-4.0 | 90 | cc | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 90 | cc | cc by nc sa 3 0
cc-by-nc-nd | 88 | creative | creative commons attribution non ?commercial no ?deriv(?:s|atives)
cc-by-nc-nd-4.0 | 90 | cc | cc by nc nd 4 0
cc-by-nc-nd-3.0 | 90 | cc | cc by nc nd 3 0
cc-by | 75 | creativecommons | creativecommons org licenses by [1-4] [05]
cc-by-sa | 80 | creativecommons | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | 80 | creativecommons | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | 80 | creativecommons | creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | 85 | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | 85 | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
cc0-1.0 | 85 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | 60 | domain | (?:released|placed|dedicated) (?:in)?to the public domain
public-domain | 50 | domain | (?:is|are) in the public domain
unlicense | 85 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 75 | unlicense | the unlicense
unlicense | 80 | unlicense | spdx license identifier unlicense
wtfpl | 75 | wtfpl | wtfpl(?: license)?
wtfpl | 80 | fuck | do what the fuck you want to public license
beerware | 75 | beer | beer ?ware license
beerware | 75 | beerware | beerware license
json | 80 | evil | the software shall be used for good not evil
vim | 75 | vim | vim license
tcl | 75 | tcl | tcl tk license
odbl-1.0 | 80 | database | open (?:data commons )?(?:open )?database license
odbl-1.0 | 80 | odbl | odbl(?: 1 0)?
odc-by-1.0 | 80 | commons | open data commons attribution license
pddl-1.0 | 80 | pddl | (?:open data commons )?public domain dedication and license pddl|pddl(?: 1 0)?
cdla-permissive | 80 | community | community data license agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | 80 | community | community data license agreement sharing(?: version)?(?: 1 0)?
ogl-uk | 75 | open | open government licen[sc]e
etalab-2.0 | 75 | etalab | (?:etalab )?licence ouverte(?: open licence)?(?: etalab)?
nlod | 75 | norwegian | norwegian licence for open government data
dl-de-by | 75 | datenlizenz | datenlizenz deutschland namensnennung(?: version)? 2 0
dl-de-zero | 75 | datenlizenz | datenlizenz deutschland zero(?: version)? 2 0
ofl-1.1 | 75 | sil | sil open font license(?: version)?(?: 1 1)?
ofl-1.1 | 80 | ofl | spdx license identifier ofl 1 1
gust-font | 75 | gust | gust font license
lppl | 75 | latex | latex project public license
lppl-1.3 | 80 | latex | latex project public license (?:version )?1 3c?
eupl | 75 | european | european union public licen[sc]e
eupl-1.2 | 85 | eupl | eupl (?:version |v )?1 2
eupl-1.1 | 85 | eupl | eupl (?:version |v )?1 1
cecill | 75 | cecill | (?:licence )?cecill
cecill-b | 80 | cecill | (?:licence )?cecill b
cecill-c | 80 | cecill | (?:licence )?cecill c
osl-3.0 | 75 | osl | (?:open software license )?osl 3 0
osl | 70 | open | open software license(?: version)?(?: [123] [01])?
qpl-1.0 | 75 | public | q public license(?: version 1 0)?
sleepycat | 75 | sleepycat | sleepycat (?:software )?license
postgresql | 75 | postgresql | postgresql licen[sc]e
ncsa | 75 | ncsa | (?:university of illinois )?ncsa open source license
ms-pl | 75 | microsoft | microsoft public license
ms-rl | 75 | microsoft | microsoft reciprocal license
ms-rsl | 75 | microsoft | microsoft reference source license
upl-1.0 | 75 | universal | universal permissive license
w3c | 75 | w3c | w3c software (?:notice and )?license
watcom | 75 | watcom | sybase open watcom public license
intel | 70 | intel | intel (?:open source|simplified software) license
nvidia | 70 | nvidia | nvidia (?:software )?license agreement
oracle-otn | 70 | oracle | oracle technology network license agreement
naist | 75 | nara | nara institute of science and technology license
unicode | 75 | unicode | unicode (?:license|terms of use)
icu | 75 | icu | icu license
wxwindows | 75 | wxwindows | wxwindows library licen[sc]e
openldap | 75 | openldap | openldap public license
ecl-2.0 | 75 | educational | educational community license
fair | 75 | fair | fair license
nasa-1.3 | 75 | nasa | nasa open source agreement
ntp | 75 | ntp | ntp license
rpl-1.5 | 75 | reciprocal | reciprocal public license
rpsl | 75 | realnetworks | realnetworks public source license
spl-1.0 | 75 | sun | sun public license
sissl | 75 | sun | sun industry standards source license
vsl | 75 | vovida | vovida software license
xfree86 | 75 | xfree86 | xfree86 license
zpl-2.1 | 75 | zope | zope public license
eiffel | 75 | eiffel | eiffel forum license
condor | 75 | condor | condor public license
nokia | 75 | nokia | nokia open source license
motosoto | 75 | motosoto | motosoto open source license
ofl-1.0 | 70 | font | open font license
rail-m | 75 | rail | (?:creativeml )?open rail m(?: license)?
rail | 70 | responsible | responsible ai license
llama | 75 | llama | llama [234](?: [0-9])? community license(?: agreement)?
gemma | 70 | gemma | gemma terms of use
proprietary | 40 | reserved | all rights reserved
proprietary | 60 | proprietary | proprietary and confidential
proprietary | 55 | unauthorized | unauthorized copying of this file
license-hint | 20 | spdx | spdx license identifier
license-hint | 20 | license | see (?:the )?license(?: file)?(?: for (?:more )?(?:details|information))?
license-hint | 20 | licensed | licensed under the
"""


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern[bytes]
    base: bool


def _read(block: str, base: bool) -> list[Rule]:
    rules = []
    for line in filter(None, map(str.strip, block.splitlines())):
        label, priority, keyword, regex = (part.strip() for part in line.split("|", 3))
        whole = rf"(?:^|(?<= ))(?:{regex})(?= |$)".encode()
        rules.append(Rule(label, int(priority), keyword.encode(), re.compile(whole), base))
    return rules


def rules() -> list[Rule]:
    return _read(BASE, True) + _read(MORE, False)
