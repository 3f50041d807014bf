"""Hand-written license signatures.

A rule is label | priority | keyword | regex over the normalised text: the words of the text in lower case, each
after one space. A rule's regex runs only where its keyword stands in the normalised text. Of overlapping
detections one inside another's interval goes if the other's priority number is lower, or if it is equal and the
other's interval is longer (or of equal length and the rule stands earlier).

Priorities: 0 identifier tags, 1 clauses of license texts, 2 notices with a version, 3 names, 4 mentions.
"""

from __future__ import annotations

#: Rules by hand: clauses, notices, names and mentions.
SIGNATURES = r"""
mit | 1 | permission is hereby granted free | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 1 | without limitation the rights to use | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit | 1 | substantial portions of the software | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 2 | mit license | (?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?mit license
mit | 2 | expat license | (?:the )?expat license
mit | 3 | mit license | (?:the )?mit license
mit | 3 | mit licensed | mit licensed
mit | 3 | mit licence | (?:the )?mit licence
mit | 4 | under mit | (?:licensed|licenced|released|distributed|available|provided|published) under mit
mit-0 | 3 | mit no attribution | mit no attribution(?: license)?
mit-0 | 3 | mit 0 | mit 0 license
x11 | 3 | x11 license | (?:mit )?x11 license
apache-2.0 | 1 | you may not use this file except in compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0 | 1 | apache org licenses license 2 0 | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 1 | contributor hereby grants to you a perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
apache-2.0 | 2 | apache license version 2 | (?:licensed under )?(?:the )?apache license version 2(?: 0)?
apache-2.0 | 2 | apache license 2 | (?:licensed under )?(?:the )?apache license 2(?: 0)?
apache-2.0 | 2 | apache software license version 2 | (?:the )?apache software license version 2(?: 0)?
apache-2.0 | 3 | apache 2 0 | apache 2 0(?: license| licence| licensed)?
apache-2.0 | 3 | asl 2 0 | asl 2 0
apache-1.1 | 2 | apache software license version 1 1 | (?:the )?apache software license version 1 1
apache-1.1 | 3 | apache license 1 1 | apache license 1 1
apache-1.0 | 3 | apache license 1 0 | apache license 1 0
apache | 3 | apache license | (?:the )?apache license
apache | 3 | apache licence | (?:the )?apache licence
apache | 4 | apache licensed | apache licensed
gpl-1.0 | 2 | general public license version 1 | (?:gnu )?general public license version 1(?: 0)?
gpl-2.0 | 1 | either version 2 of the license | (?:terms of the gnu general public license as published by the free software foundation )?either version 2 of the license or at your option any later version
gpl-2.0 | 2 | general public license version 2 | (?:gnu )?general public license version 2(?: 0)?
gpl-2.0 | 2 | general public license v2 | (?:gnu )?general public license v2(?: 0)?
gpl-2.0 | 2 | of the gnu general public license | version 2 (?:only )?of the gnu general public license
gpl-2.0 | 3 | gplv2 | (?:gnu )?gplv2
gpl-2.0 | 3 | gpl v2 | (?:gnu )?gpl v2
gpl-2.0 | 3 | gpl 2 | gnu gpl 2(?: 0)?(?: only| or later)?|gpl 2 0(?: only| or later)?|gpl 2 (?:only|or later|license|licence|licensed)|(?:licensed|released|distributed|available|under|the|license|licence) gpl 2(?: only| or later)?
gpl-2.0 | 3 | gpl version 2 | (?:gnu )?gpl version 2
gpl-3.0 | 1 | either version 3 of the license | (?:terms of the gnu general public license as published by the free software foundation )?either version 3 of the license or at your option any later version
gpl-3.0 | 1 | tivoized | tivoized
gpl-3.0 | 2 | general public license version 3 | (?:gnu )?general public license version 3(?: 0)?
gpl-3.0 | 2 | general public license v3 | (?:gnu )?general public license v3(?: 0)?
gpl-3.0 | 2 | of the gnu general public license | version 3 (?:only )?of the gnu general public license
gpl-3.0 | 3 | gplv3 | (?:gnu )?gplv3
gpl-3.0 | 3 | gpl v3 | (?:gnu )?gpl v3
gpl-3.0 | 3 | gpl 3 | gnu gpl 3(?: 0)?(?: only| or later)?|gpl 3 0(?: only| or later)?|gpl 3 (?:only|or later|license|licence|licensed)|(?:licensed|released|distributed|available|under|the|license|licence) gpl 3(?: only| or later)?
gpl-3.0 | 3 | gpl version 3 | (?:gnu )?gpl version 3
gpl | 1 | your freedom to share and change | the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change
gpl | 2 | you should have received a copy of the gnu general public license | you should have received a copy of the gnu general public license
gpl | 3 | gnu general public license | (?:the )?gnu general public license
gpl | 3 | general public license | general public license
gpl | 3 | general public licence | (?:gnu )?general public licence
gpl | 4 | gnu gpl | (?:the )?gnu gpl
gpl | 4 | gpl licensed | gpl licensed
gpl | 4 | gpl license | gpl license
lgpl-2.0 | 2 | library general public license | (?:gnu )?library general public license(?: version 2(?: 0)?| v2)?
lgpl-2.1 | 2 | lesser general public license version 2 1 | (?:gnu )?lesser general public license version 2 1
lgpl-2.1 | 2 | lesser general public license v2 1 | (?:gnu )?lesser general public license v2 1
lgpl-2.1 | 3 | lgpl 2 1 | lgpl 2 1(?: only| or later)?
lgpl-2.1 | 3 | lgplv2 1 | lgplv2 1
lgpl-3.0 | 2 | lesser general public license version 3 | (?:gnu )?lesser general public license version 3(?: 0)?
lgpl-3.0 | 2 | lesser general public license v3 | (?:gnu )?lesser general public license v3
lgpl-3.0 | 3 | lgpl 3 | lgpl 3(?: 0)?(?: only| or later)?
lgpl-3.0 | 3 | lgplv3 | lgplv3
lgpl | 2 | lesser general public license | (?:gnu )?lesser general public license
lgpl | 4 | gnu lgpl | gnu lgpl
agpl-3.0 | 1 | remote network interaction | remote network interaction use with the gnu general public license
agpl-3.0 | 2 | affero general public license version 3 | (?:gnu )?affero general public license version 3(?: 0)?
agpl-3.0 | 2 | affero general public license v3 | (?:gnu )?affero general public license v3
agpl-3.0 | 3 | agplv3 | agplv3
agpl-3.0 | 3 | agpl 3 | agpl 3(?: 0)?(?: only| or later)?
agpl | 2 | affero general public license | (?:gnu )?affero general public license
agpl | 4 | gnu agpl | gnu agpl
gfdl | 2 | gnu free documentation license | (?:the )?gnu free documentation license(?: version 1 [123])?
gfdl | 3 | gfdl | gfdl(?: 1 [123])?
bsd-2-clause | 1 | redistributions in binary form must reproduce | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce
bsd-2-clause | 2 | 2 clause bsd | 2 clause bsd(?: license)?
bsd-2-clause | 2 | bsd 2 clause | bsd 2 clause(?: license)?
bsd-2-clause | 2 | simplified bsd | simplified bsd(?: license)?
bsd-2-clause | 3 | freebsd license | freebsd license
bsd-3-clause | 1 | used to endorse or promote products | neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | 2 | 3 clause bsd | 3 clause bsd(?: license)?
bsd-3-clause | 2 | bsd 3 clause | bsd 3 clause(?: license)?
bsd-3-clause | 2 | new bsd | new bsd license
bsd-3-clause | 2 | modified bsd | modified bsd license
bsd-3-clause | 2 | revised bsd | revised bsd license
bsd-4-clause | 1 | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-4-clause | 2 | bsd 4 clause | bsd 4 clause(?: license)?
bsd-4-clause | 3 | original bsd license | original bsd license
bsd-0-clause | 3 | zero clause bsd | zero clause bsd(?: license)?
bsd-0-clause | 3 | 0bsd | 0bsd
bsd | 1 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd | 3 | bsd license | (?:the )?bsd license
bsd | 3 | bsd licence | (?:the )?bsd licence
bsd | 4 | bsd style license | bsd style license
bsd | 4 | bsd licensed | bsd licensed
isc | 1 | permission to use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 3 | isc license | (?:the )?isc license
mpl-1.0 | 2 | mozilla public license version 1 0 | mozilla public license version 1 0
mpl-1.1 | 2 | mozilla public license version 1 1 | mozilla public license version 1 1
mpl-1.1 | 3 | mpl 1 1 | mpl 1 1
mpl-2.0 | 1 | subject to the terms of the mozilla public license v 2 0 | (?:this source code form is )?subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 2 | mozilla public license version 2 | mozilla public license version 2(?: 0)?
mpl-2.0 | 2 | mozilla public license 2 0 | mozilla public license 2 0
mpl-2.0 | 3 | mpl 2 0 | mpl 2 0
mpl | 3 | mozilla public license | (?:the )?mozilla public license
epl-1.0 | 2 | eclipse public license v1 0 | eclipse public license v1 0
epl-1.0 | 2 | eclipse public license version 1 0 | eclipse public license version 1 0
epl-1.0 | 2 | eclipse public license 1 0 | eclipse public license 1 0
epl-2.0 | 2 | eclipse public license v2 0 | eclipse public license v2 0
epl-2.0 | 2 | eclipse public license version 2 0 | eclipse public license version 2 0
epl-2.0 | 2 | eclipse public license 2 0 | eclipse public license 2 0
epl | 3 | eclipse public license | eclipse public license
edl-1.0 | 3 | eclipse distribution license | eclipse distribution license(?: v1 0| version 1 0)?
cddl-1.0 | 2 | common development and distribution license | common development and distribution license(?: cddl)?(?: version 1 0| 1 0)?
cddl-1.0 | 3 | cddl 1 0 | cddl 1 0
cddl-1.1 | 3 | cddl 1 1 | cddl 1 1
cpl-1.0 | 2 | common public license | common public license(?: version 1 0| 1 0)?
ipl-1.0 | 3 | ibm public license | ibm public license(?: version 1 0)?
cpal-1.0 | 3 | common public attribution license | common public attribution license(?: version 1 0)?
eupl-1.1 | 2 | european union public licence v 1 1 | european union public licence v 1 1
eupl-1.2 | 2 | european union public licence v 1 2 | european union public licence v 1 2
eupl | 3 | european union public licence | european union public licence
eupl | 3 | eupl | eupl(?: v)?(?: 1 [012])?
cecill-2.1 | 3 | cecill 2 1 | cecill 2 1
cecill-b | 3 | cecill b | cecill b(?: free software license agreement)?
cecill-c | 3 | cecill c | cecill c(?: free software license agreement)?
cecill | 3 | cecill | cecill(?: free software license agreement)?
artistic-1.0 | 2 | artistic license 1 0 | artistic license 1 0
artistic-2.0 | 2 | artistic license 2 0 | (?:the )?artistic license 2 0
artistic-2.0 | 2 | artistic license version 2 0 | (?:the )?artistic license version 2 0
artistic | 3 | artistic license | (?:the )?(?:clarified )?artistic license
zlib | 1 | this software is provided as is without any express or implied warranty in no event | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 3 | zlib license | zlib license
zlib | 3 | zlib libpng license | zlib libpng license
libpng | 3 | libpng license | libpng license
bsl-1.0 | 2 | boost software license | boost software license(?: version 1 0| 1 0)?
busl-1.1 | 2 | business source license | business source license(?: 1 1)?
sspl-1.0 | 2 | server side public license | server side public license(?: version 1| v1)?
elastic-2.0 | 2 | elastic license | elastic license(?: 2 0| v2)?
unlicense | 1 | this is free and unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
unlicense | 3 | the unlicense | the unlicense
unlicense | 4 | unlicense org | unlicense org
wtfpl | 2 | do what the fuck you want to public license | do what the fuck you want to public license(?: version 2)?
wtfpl | 3 | wtfpl | wtfpl
beerware | 3 | beer ware license | (?:the )?beer ware license
beerware | 3 | beerware | beerware(?: license)?
cc0-1.0 | 2 | cc0 1 0 | cc0 1 0(?: universal)?
cc0-1.0 | 3 | creative commons zero | creative commons zero(?: v1 0)?(?: universal)?
cc0-1.0 | 4 | cc0 | cc0
cc-pdm-1.0 | 3 | public domain mark | (?:creative commons )?public domain mark(?: 1 0)?
cc-by-1.0 | 2 | cc by 1 0 | cc by 1 0
cc-by-2.0 | 2 | cc by 2 0 | cc by 2 0
cc-by-2.5 | 2 | cc by 2 5 | cc by 2 5
cc-by-3.0 | 2 | cc by 3 0 | cc by 3 0
cc-by-4.0 | 2 | cc by 4 0 | cc by 4 0
cc-by-4.0 | 2 | creative commons attribution 4 0 | creative commons attribution 4 0(?: international)?(?: public)?(?: license)?
cc-by-3.0 | 2 | creative commons attribution 3 0 | creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-sa-2.0 | 2 | cc by sa 2 0 | cc by sa 2 0
cc-by-sa-3.0 | 2 | cc by sa 3 0 | cc by sa 3 0
cc-by-sa-4.0 | 2 | cc by sa 4 0 | cc by sa 4 0
cc-by-sa-4.0 | 2 | attribution sharealike 4 0 | (?:creative commons )?attribution sharealike 4 0(?: international)?(?: license)?
cc-by-sa-3.0 | 2 | attribution sharealike 3 0 | (?:creative commons )?attribution sharealike 3 0(?: unported)?(?: license)?
cc-by-sa | 3 | attribution sharealike | (?:creative commons )?attribution sharealike(?: license)?
cc-by-sa | 3 | attribution share alike | (?:creative commons )?attribution share alike(?: license)?
cc-by-sa | 4 | cc by sa | cc by sa
cc-by-nd-3.0 | 2 | cc by nd 3 0 | cc by nd 3 0
cc-by-nd-4.0 | 2 | cc by nd 4 0 | cc by nd 4 0
cc-by-nd | 3 | attribution noderivatives | (?:creative commons )?attribution noderivatives(?: 4 0)?(?: international)?
cc-by-nd | 4 | cc by nd | cc by nd
cc-by-nc-2.0 | 2 | cc by nc 2 0 | cc by nc 2 0
cc-by-nc-3.0 | 2 | cc by nc 3 0 | cc by nc 3 0
cc-by-nc-4.0 | 2 | cc by nc 4 0 | cc by nc 4 0
cc-by-nc-4.0 | 2 | attribution noncommercial 4 0 | (?:creative commons )?attribution noncommercial 4 0(?: international)?(?: license)?
cc-by-nc | 3 | attribution noncommercial | (?:creative commons )?attribution noncommercial(?: license)?
cc-by-nc | 4 | cc by nc | cc by nc
cc-by-nc-sa-3.0 | 2 | cc by nc sa 3 0 | cc by nc sa 3 0
cc-by-nc-sa-4.0 | 2 | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-sa | 3 | attribution noncommercial sharealike | (?:creative commons )?attribution noncommercial sharealike(?: 4 0)?(?: international)?(?: license)?
cc-by-nc-sa | 4 | cc by nc sa | cc by nc sa
cc-by-nc-nd-3.0 | 2 | cc by nc nd 3 0 | cc by nc nd 3 0
cc-by-nc-nd-4.0 | 2 | cc by nc nd 4 0 | cc by nc nd 4 0
cc-by-nc-nd | 3 | attribution noncommercial noderivatives | (?:creative commons )?attribution noncommercial noderivatives(?: 4 0)?(?: international)?(?: license)?
cc-by-nc-nd | 4 | cc by nc nd | cc by nc nd
cc-by | 3 | creative commons attribution | creative commons attribution(?: license| licence)?
cc-by | 4 | cc by | (?:licensed|licenced|released|distributed|available|shared|published) under (?:a |the )?cc by|cc by (?:license|licence|licensed)
creative-commons | 3 | creative commons license | creative commons license
creative-commons | 3 | creative commons licence | creative commons licence
creative-commons | 4 | creativecommons org licenses | creativecommons org licenses(?: by(?: nc)?(?: nd| sa)?)?(?: [1234] [05])?
creative-commons | 4 | creative commons | creative commons
python-2.0 | 2 | python software foundation license | python software foundation license(?: version 2| v2)?
python-2.0 | 3 | psf license | psf license(?: agreement)?
php-3.01 | 2 | php license version 3 01 | php license version 3 01
php | 3 | php license | (?:the )?php license
ruby | 3 | ruby license | (?:the )?ruby license
openssl | 2 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 3 | openssl license | openssl license
postgresql | 3 | postgresql license | postgresql license
postgresql | 3 | postgresql licence | postgresql licence
ncsa | 3 | university of illinois ncsa open source license | university of illinois ncsa open source license
ncsa | 3 | ncsa license | ncsa license
w3c | 3 | w3c software notice and license | w3c software notice and license
w3c | 3 | w3c license | w3c license
ofl-1.1 | 2 | sil open font license | sil open font license(?: version 1 1| 1 1)?
ofl-1.1 | 3 | open font license | open font license
odbl-1.0 | 2 | open database license | open (?:data commons open )?database license(?: odbl)?(?: v1 0)?
odc-by-1.0 | 2 | open data commons attribution license | open data commons attribution license(?: v1 0)?
pddl-1.0 | 2 | public domain dedication and license | (?:open data commons )?public domain dedication and license
ms-pl | 3 | microsoft public license | microsoft public license(?: ms pl)?
ms-rl | 3 | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
afl-3.0 | 2 | academic free license | academic free license(?: v)?(?: version)?(?: [123] [012])?
osl-3.0 | 2 | open software license | open software license(?: v)?(?: version)?(?: [123] [01])?
ecl-2.0 | 3 | educational community license | educational community license(?: version 2 0)?
qpl-1.0 | 3 | q public license | q public license(?: version 1 0)?
sleepycat | 3 | sleepycat license | sleepycat license
upl-1.0 | 3 | universal permissive license | universal permissive license(?: v 1 0)?
vim | 3 | vim license | vim license
ijg | 3 | independent jpeg group | this software is based in part on the work of the independent jpeg group
curl | 3 | curl license | curl license
blueoak-1.0.0 | 3 | blue oak model license | blue oak model license(?: 1 0 0)?
mulanpsl-2.0 | 3 | mulan permissive software license | mulan permissive software license(?: v2| version 2)?
hippocratic | 3 | hippocratic license | hippocratic license(?: version)?(?: [123] [01])?
openrail | 3 | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: license)?
openrail | 3 | open rail | (?:creativeml |bigscience )?open rail(?: m)?(?: license)?
llama-community | 3 | community license | llama (?:[23] )?community license
public-domain | 3 | released into the public domain | (?:has been |is )?released into the public domain
public-domain | 3 | dedicated to the public domain | (?:is )?dedicated to the public domain
public-domain | 3 | placed in the public domain | (?:is |has been )?placed in the public domain
public-domain | 4 | in the public domain | in the public domain
proprietary | 2 | proprietary and confidential | proprietary and confidential
proprietary | 3 | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 3 | all rights reserved | all rights reserved
proprietary | 4 | tous droits réservés | tous droits réservés
proprietary | 4 | alle rechte vorbehalten | alle rechte vorbehalten
proprietary | 4 | todos los derechos reservados | todos los derechos reservados
"""

#: Identifiers that a tag "SPDX-License-Identifier" may name.
IDENTIFIERS = """
0BSD AFL-2.1 AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0
Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0
CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1
CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 ECL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.3 GPL-1.0
GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG IPL-1.0 ISC LGPL-2.0 LGPL-2.1
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later Libpng LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL
MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unicode-DFS-2016
Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
"""


def rules() -> list[tuple[int, str, int, str, str]]:
    """(number, label, priority, keyword, regex) in order; the tags are made from the identifiers."""
    out = []
    for name in IDENTIFIERS.split():
        words = name.lower().replace("-", " ").replace(".", " ")
        out.append((name.lower(), 0, f"spdx license identifier {words}", f"spdx license identifier {words}"))
    for line in SIGNATURES.strip().splitlines():
        label, priority, keyword, regex = (part.strip() for part in line.split(" | "))
        out.append((label, int(priority), keyword, regex))
    return [(n, *rule) for n, rule in enumerate(out)]
