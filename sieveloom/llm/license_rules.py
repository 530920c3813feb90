"""Licence signatures: one rule a line, ``licence | priority | keyword | regex``.

Patterns are read without case. A blank stands for white space, with comment
marks after it if there are any. The keyword is a lower-case literal without
white space that every match of the rule holds: texts without it aren't searched.
Of two detections that overlap, the one of higher priority stays.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_GAP = r"[\s\xa0]+(?:(?:[#*;/]|--)+[\s\xa0]*)?"
_BLANK = r"[\s\xa0]?"

#: 90: identifier tags. The identifier ends the match.
TAGS = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0
Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear
BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0
CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0
CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0
EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0
GPL-3.0-only GPL-3.0-or-later HPND ICU IJG IPL-1.0 ISC LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0
LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0
OFL-1.1 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unicode-3.0
Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
"""

#: 80: addresses. 70: sentences of grants and of licence texts. 60: names with a version. 40: names. 20: anything that speaks of a licence.
SIGNATURES = r"""
Apache-2.0 | 80 | apache.org | apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
Apache-1.1 | 80 | apache.org | apache\.org/licenses/license-1\.1
Apache-1.0 | 80 | apache.org | apache\.org/licenses/license-1\.0
Apache-2.0 | 80 | opensource.org | opensource\.org/licen[cs]es?/apache-2\.0
MIT | 80 | opensource.org | opensource\.org/licen[cs]es?/mit(?![\w-])
MIT | 80 | mit-license.org | mit-license\.org
BSD-3-Clause | 80 | opensource.org | opensource\.org/licen[cs]es?/bsd-3-clause
BSD-2-Clause | 80 | opensource.org | opensource\.org/licen[cs]es?/bsd-2-clause
BSD-3-Clause | 80 | opensource.org | opensource\.org/licen[cs]es?/bsd-license(?:\.php)?
ISC | 80 | opensource.org | opensource\.org/licen[cs]es?/isc(?![\w-])
Zlib | 80 | opensource.org | opensource\.org/licen[cs]es?/zlib
Artistic-2.0 | 80 | opensource.org | opensource\.org/licen[cs]es?/artistic-license-2\.0
EPL-1.0 | 80 | opensource.org | opensource\.org/licen[cs]es?/eclipse-1\.0
OFL-1.1 | 80 | opensource.org | opensource\.org/licen[cs]es?/ofl-1\.1
GPL-2.0 | 80 | opensource.org | opensource\.org/licen[cs]es?/gpl-2\.0
GPL-3.0 | 80 | opensource.org | opensource\.org/licen[cs]es?/gpl-3\.0
LGPL-2.1 | 80 | opensource.org | opensource\.org/licen[cs]es?/lgpl-2\.1
LGPL-3.0 | 80 | opensource.org | opensource\.org/licen[cs]es?/lgpl-3\.0
MPL-2.0 | 80 | opensource.org | opensource\.org/licen[cs]es?/mpl-2\.0
GPL-3.0 | 80 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-3\.0
GPL-2.0 | 80 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
LGPL-3.0 | 80 | gnu.org | gnu\.org/licenses/lgpl-3\.0
LGPL-2.1 | 80 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
AGPL-3.0 | 80 | gnu.org | gnu\.org/licenses/agpl-3\.0
GFDL-1.3 | 80 | gnu.org | gnu\.org/licenses/fdl-1\.3
GPL | 60 | gnu.org | gnu\.org/(?:copyleft|licenses)/gpl\.(?:html|txt)
LGPL | 60 | gnu.org | gnu\.org/(?:copyleft|licenses)/lgpl\.(?:html|txt)
AGPL | 60 | gnu.org | gnu\.org/licenses/agpl\.(?:html|txt)
GPL | 40 | gnu.org | gnu\.org/licenses/?(?![\w/])
MPL-2.0 | 80 | mozilla.org | mozilla\.org/(?:[a-z-]+/)?mpl/2\.0
MPL-1.1 | 80 | mozilla.org | mozilla\.org/mpl/(?:mpl-)?1\.1
MPL | 60 | mozilla.org | mozilla\.org/mpl/?(?![\w/])
EPL-2.0 | 80 | eclipse.org | eclipse\.org/(?:legal|org/documents)/epl-(?:v20|2\.0)
EPL-1.0 | 80 | eclipse.org | eclipse\.org/(?:legal|org/documents)/epl-v10
BSL-1.0 | 80 | boost.org | boost\.org/license_1_0\.txt
OFL-1.1 | 80 | scripts.sil.org | scripts\.sil\.org/ofl
Unlicense | 80 | unlicense.org | unlicense\.org
WTFPL | 80 | wtfpl.net | wtfpl\.net
PHP-3.01 | 80 | php.net | php\.net/license/3_01\.txt
ODbL-1.0 | 80 | opendatacommons.org | opendatacommons\.org/licenses/odbl
PDDL-1.0 | 80 | opendatacommons.org | opendatacommons\.org/licenses/pddl
ODC-By-1.0 | 80 | opendatacommons.org | opendatacommons\.org/licenses/by
SSPL-1.0 | 80 | mongodb.com | mongodb\.com/licensing/server-side-public-license
CC0-1.0 | 80 | creativecommons.org | creativecommons\.org/publicdomain/zero/1\.0
PDM-1.0 | 80 | creativecommons.org | creativecommons\.org/publicdomain/mark/1\.0
CC-BY-4.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by/4\.0
CC-BY-3.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by/3\.0
CC-BY-2.5 | 80 | creativecommons.org | creativecommons\.org/licenses/by/2\.5
CC-BY-2.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by/2\.0
CC-BY-1.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by/1\.0
CC-BY-SA-4.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by-sa/4\.0
CC-BY-SA-3.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by-sa/3\.0
CC-BY-SA-2.5 | 80 | creativecommons.org | creativecommons\.org/licenses/by-sa/2\.5
CC-BY-SA-2.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by-sa/2\.0
CC-BY-NC-4.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by-nc/4\.0
CC-BY-NC-3.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by-nc/3\.0
CC-BY-NC-2.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by-nc/2\.0
CC-BY-ND-4.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by-nd/4\.0
CC-BY-ND-3.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by-nd/3\.0
CC-BY-NC-SA-4.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/4\.0
CC-BY-NC-SA-3.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/3\.0
CC-BY-NC-ND-4.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/4\.0
CC-BY-NC-ND-3.0 | 80 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/3\.0
Apache-2.0 | 70 | apache | licensed under the apache license,? version 2(?:\.0)?(?: \(the "license"\))?
Apache-2.0 | 70 | apache | may not use this file except in compliance with the (?:apache )?license\b[^\n]{0,40}apache
Apache-1.1 | 70 | apache | redistributions[^\n]{0,60} this product includes software developed by the apache software foundation
MIT | 70 | permission | permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files
MIT | 70 | merchantability | the software is provided "as is",? without warranty of any kind,? express or implied,? including but not limited to the warranties of merchantability
MIT | 70 | released | released under the (?:terms of the )?mit licen[cs]e
MIT | 70 | licensed | licensed under the (?:terms of the )?(?:expat|mit(?:/x11)?) licen[cs]e
MIT | 70 | distributed | distributed under the (?:terms of the )?mit licen[cs]e
BSD-2-Clause | 70 | redistribution | redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met
BSD-3-Clause | 75 | endorse | may (?:not )?be used to endorse or promote products derived from this software without specific prior written permission
BSD-4-Clause | 75 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD-3-Clause | 70 | licensed | licensed under the (?:new|modified|revised|3-clause|three-clause) bsd licen[cs]e
BSD-2-Clause | 70 | licensed | licensed under the (?:simplified|freebsd|2-clause|two-clause) bsd licen[cs]e
ISC | 70 | permission | permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
0BSD | 72 | permission | permission to use,? copy,? modify,? and/or distribute this software for any purpose with or without fee is hereby granted\.
Zlib | 70 | misrepresented | the origin of this software must not be misrepresented
Zlib | 70 | authors | in no event will the authors be held liable for any damages arising from the use of this software
Unlicense | 70 | unencumbered | this is free and unencumbered software released into the public domain
WTFPL | 70 | fuck | do what the fuck you want to(?: public license)?
BSL-1.0 | 70 | permission | permission is hereby granted,? free of charge,? to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
GPL-2.0-or-later | 75 | redistribute | you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation[;,] (?:either )?version 2 of the license,? or \(at your option\) any later version
GPL-3.0-or-later | 75 | redistribute | you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation[;,] (?:either )?version 3 of the license,? or \(at your option\) any later version
LGPL-2.1-or-later | 75 | redistribute | you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation[;,] (?:either )?version 2\.1 of the license,? or \(at your option\) any later version
LGPL-3.0-or-later | 75 | redistribute | you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation[;,] (?:either )?version 3 of the license,? or \(at your option\) any later version
AGPL-3.0-or-later | 75 | affero | you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation[;,] (?:either )?version 3 of the license,? or \(at your option\) any later version
GPL-2.0 | 70 | gnu | (?:licensed|released|distributed|covered) under the (?:terms of the )?gnu general public license,? version 2(?:\.0)?
GPL-3.0 | 70 | gnu | (?:licensed|released|distributed|covered) under the (?:terms of the )?gnu general public license,? version 3(?:\.0)?
LGPL-2.1 | 70 | gnu | (?:licensed|released|distributed|covered) under the (?:terms of the )?gnu lesser general public license,? version 2\.1
LGPL-3.0 | 70 | gnu | (?:licensed|released|distributed|covered) under the (?:terms of the )?gnu lesser general public license,? version 3(?:\.0)?
AGPL-3.0 | 70 | affero | (?:licensed|released|distributed|covered) under the (?:terms of the )?gnu affero general public license,? version 3(?:\.0)?
GFDL-1.2 | 70 | documentation | under the terms of the gnu free documentation license,? version 1\.2
GFDL-1.3 | 70 | documentation | under the terms of the gnu free documentation license,? version 1\.3
MPL-2.0 | 70 | mozilla | this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0
MPL-1.1 | 70 | mozilla | the contents of this file are subject to the mozilla public license version 1\.1
EPL-1.0 | 70 | eclipse | made available under the terms of the eclipse public license v(?:ersion)? ?1\.0
EPL-2.0 | 70 | eclipse | made available under the terms of the eclipse public license v(?:ersion)? ?2\.0
CDDL-1.0 | 70 | development | subject to the terms of the common development and distribution license
OFL-1.1 | 70 | font | this font software is licensed under the sil open font license,? version 1\.1
Artistic-2.0 | 70 | artistic | under the terms of the artistic license(?:,? version)? 2\.0
PSF-2.0 | 70 | python | this license agreement is between the python software foundation
Ruby | 70 | ruby | you may redistribute it and/or modify it under the same terms as ruby
Perl | 70 | perl | (?:under|on) the same terms as perl(?: itself)?
CC0-1.0 | 70 | waived | has waived all copyright and related or neighboring rights
CC-BY-4.0 | 70 | attribution | licensed under (?:a |the )?creative commons attribution 4\.0(?: international)?(?: license)?
CC-BY-3.0 | 70 | attribution | licensed under (?:a |the )?creative commons attribution 3\.0(?: unported)?(?: license)?
CC-BY-SA-4.0 | 70 | attribution | licensed under (?:a |the )?creative commons attribution[- ]share ?alike 4\.0(?: international)?(?: license)?
CC-BY-SA-3.0 | 70 | attribution | licensed under (?:a |the )?creative commons attribution[- ]share ?alike 3\.0(?: unported)?(?: license)?
CC-BY-NC-4.0 | 70 | attribution | licensed under (?:a |the )?creative commons attribution[- ]non ?commercial 4\.0(?: international)?(?: license)?
CC-BY-NC-4.0 | 70 | licensed | licensed under (?:a |the )?cc[- ]by-nc[- ]4\.0
CC-BY-4.0 | 70 | licensed | licensed under (?:a |the )?cc[- ]by[- ]4\.0
CC-BY-SA-4.0 | 70 | licensed | licensed under (?:a |the )?cc[- ]by-sa[- ]4\.0
Proprietary | 70 | reserved | all rights reserved
Proprietary | 70 | confidential | confidential and proprietary(?: information)?
Proprietary | 70 | prohibited | unauthori[sz]ed (?:copying|reproduction|distribution)[^\n]{0,80} is (?:strictly )?prohibited
Public-Domain | 70 | domain | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
Apache-2.0 | 60 | apache | apache (?:software )?licen[cs]e,? (?:v(?:ersion)?\.? ?)?2(?:\.0)?
Apache-1.1 | 60 | apache | apache (?:software )?licen[cs]e,? (?:v(?:ersion)?\.? ?)?1\.1
Apache-1.0 | 60 | apache | apache (?:software )?licen[cs]e,? (?:v(?:ersion)?\.? ?)?1\.0
Apache-2.0 | 60 | apache-2.0 | \bapache-2\.0\b
Apache-2.0 | 60 | asl | \basl[- ]2\.0\b
GPL-1.0 | 60 | general | gnu general public licen[cs]e,? v(?:ersion)?\.? ?1
GPL-2.0 | 60 | general | gnu general public licen[cs]e,? v(?:ersion)?\.? ?2
GPL-3.0 | 60 | general | gnu general public licen[cs]e,? v(?:ersion)?\.? ?3
LGPL-2.0 | 60 | general | gnu library general public licen[cs]e,? v(?:ersion)?\.? ?2
LGPL-2.1 | 60 | lesser | gnu lesser general public licen[cs]e,? v(?:ersion)?\.? ?2\.1
LGPL-3.0 | 60 | lesser | gnu lesser general public licen[cs]e,? v(?:ersion)?\.? ?3
AGPL-3.0 | 60 | affero | gnu affero general public licen[cs]e,? v(?:ersion)?\.? ?3
GPL-2.0 | 60 | gpl | \bgpl ?-?v?2(?:\.0)?\b(?!\+)
GPL-3.0 | 60 | gpl | \bgpl ?-?v?3(?:\.0)?\b(?!\+)
GPL-2.0-or-later | 62 | gpl | \bgpl ?-?v?2(?:\.0)?(?:\+| or later)
GPL-3.0-or-later | 62 | gpl | \bgpl ?-?v?3(?:\.0)?(?:\+| or later)
LGPL-2.1 | 60 | lgpl | \blgpl ?-?v?2(?:\.1)?\b
LGPL-3.0 | 60 | lgpl | \blgpl ?-?v?3(?:\.0)?\b
AGPL-3.0 | 60 | agpl | \bagpl ?-?v?3(?:\.0)?\b
GFDL-1.1 | 60 | documentation | gnu free documentation licen[cs]e,? v(?:ersion)?\.? ?1\.1
GFDL-1.2 | 60 | documentation | gnu free documentation licen[cs]e,? v(?:ersion)?\.? ?1\.2
GFDL-1.3 | 60 | documentation | gnu free documentation licen[cs]e,? v(?:ersion)?\.? ?1\.3
MPL-1.0 | 60 | mozilla | mozilla public licen[cs]e,? (?:v(?:ersion)?\.? ?)?1\.0
MPL-1.1 | 60 | mozilla | mozilla public licen[cs]e,? (?:v(?:ersion)?\.? ?)?1\.1
MPL-2.0 | 60 | mozilla | mozilla public licen[cs]e,? (?:v(?:ersion)?\.? ?)?2\.0
MPL-2.0 | 60 | mpl | \bmpl[- ]?v?2(?:\.0)?\b
EPL-1.0 | 60 | eclipse | eclipse public licen[cs]e,? (?:- )?(?:v(?:ersion)?\.? ?)?1\.0
EPL-2.0 | 60 | eclipse | eclipse public licen[cs]e,? (?:- )?(?:v(?:ersion)?\.? ?)?2\.0
CDDL-1.0 | 60 | cddl | \bcddl[- ]?v?1\.0\b
CDDL-1.1 | 60 | cddl | \bcddl[- ]?v?1\.1\b
CPL-1.0 | 60 | common | common public licen[cs]e,? (?:v(?:ersion)?\.? ?)?1\.0
EUPL-1.1 | 60 | european | european union public licen[cs]e,? (?:v(?:ersion)?\.? ?)?1\.1
EUPL-1.2 | 60 | european | european union public licen[cs]e,? (?:v(?:ersion)?\.? ?)?1\.2
EUPL-1.2 | 60 | eupl | \beupl[- ]?v?1\.2\b
OSL-3.0 | 60 | open | open software licen[cs]e,? (?:v(?:ersion)?\.? ?)?3\.0
AFL-3.0 | 60 | academic | academic free licen[cs]e,? (?:v(?:ersion)?\.? ?)?3\.0
AFL-2.1 | 60 | academic | academic free licen[cs]e,? (?:v(?:ersion)?\.? ?)?2\.1
ECL-2.0 | 60 | educational | educational community licen[cs]e,? (?:v(?:ersion)?\.? ?)?2\.0
OFL-1.1 | 60 | font | sil open font licen[cs]e,? (?:v(?:ersion)?\.? ?)?1\.1
Artistic-1.0 | 60 | artistic | artistic licen[cs]e,? (?:v(?:ersion)?\.? ?)?1\.0
Artistic-2.0 | 60 | artistic | artistic licen[cs]e,? (?:v(?:ersion)?\.? ?)?2\.0
BSL-1.0 | 60 | boost | boost software licen[cs]e(?:,? (?:- )?(?:v(?:ersion)?\.? ?)?1\.0)?
BUSL-1.1 | 60 | business | business source licen[cs]e(?:,? (?:v(?:ersion)?\.? ?)?1\.1)?
SSPL-1.0 | 60 | server | server side public licen[cs]e(?:,? v(?:ersion)?\.? ?1)?
Elastic-2.0 | 60 | elastic | elastic licen[cs]e,? (?:v(?:ersion)?\.? ?)?2(?:\.0)?
LPPL-1.3c | 60 | latex | latex project public licen[cs]e(?:,? v(?:ersion)?\.? ?1\.3c?)?
PHP-3.01 | 60 | php | php licen[cs]e,? (?:v(?:ersion)?\.? ?)?3\.0?1
ZPL-2.1 | 60 | zope | zope public licen[cs]e(?:,? (?:v(?:ersion)?\.? ?)?2\.1)?
QPL-1.0 | 60 | public | \bq public licen[cs]e(?: v(?:ersion)?\.? ?1\.0)?
APSL-2.0 | 60 | apple | apple public source licen[cs]e(?:,? (?:v(?:ersion)?\.? ?)?2\.0)?
IPL-1.0 | 60 | ibm | ibm public licen[cs]e(?:,? (?:v(?:ersion)?\.? ?)?1\.0)?
MS-PL | 60 | microsoft | microsoft public licen[cs]e(?: \(ms-pl\))?
MS-RL | 60 | microsoft | microsoft reciprocal licen[cs]e(?: \(ms-rl\))?
UPL-1.0 | 60 | universal | universal permissive licen[cs]e(?:,? v(?:ersion)?\.? ?1\.0)?
MulanPSL-2.0 | 60 | mulan | mulan psl v2|mulan permissive software licen[cs]e,? v(?:ersion)? ?2
CECILL-2.1 | 60 | cecill | \bcecill(?: free software licen[cs]e agreement)?,? v(?:ersion)?\.? ?2\.1
CECILL-B | 62 | cecill | \bcecill-b\b
CECILL-C | 62 | cecill | \bcecill-c\b
CC-BY-NC-SA-4.0 | 60 | by-nc-sa | \bcc[- ]by-nc-sa[- ]4\.0\b
CC-BY-NC-SA-3.0 | 60 | by-nc-sa | \bcc[- ]by-nc-sa[- ]3\.0\b
CC-BY-NC-ND-4.0 | 60 | by-nc-nd | \bcc[- ]by-nc-nd[- ]4\.0\b
CC-BY-NC-ND-3.0 | 60 | by-nc-nd | \bcc[- ]by-nc-nd[- ]3\.0\b
CC-BY-NC-4.0 | 60 | by-nc | \bcc[- ]by-nc[- ]4\.0\b
CC-BY-NC-3.0 | 60 | by-nc | \bcc[- ]by-nc[- ]3\.0\b
CC-BY-NC-2.0 | 60 | by-nc | \bcc[- ]by-nc[- ]2\.0\b
CC-BY-ND-4.0 | 60 | by-nd | \bcc[- ]by-nd[- ]4\.0\b
CC-BY-ND-3.0 | 60 | by-nd | \bcc[- ]by-nd[- ]3\.0\b
CC-BY-SA-4.0 | 60 | by-sa | \bcc[- ]by-sa[- ]4\.0\b
CC-BY-SA-3.0 | 60 | by-sa | \bcc[- ]by-sa[- ]3\.0\b
CC-BY-4.0 | 60 | cc | \bcc[- ]by[- ]4\.0\b
CC-BY-3.0 | 60 | cc | \bcc[- ]by[- ]3\.0\b
CC-BY-2.0 | 60 | cc | \bcc[- ]by[- ]2\.0\b
CC0-1.0 | 60 | cc0 | \bcc0(?:[- ]1\.0)?\b
CC0-1.0 | 60 | zero | creative commons zero(?: v?1\.0)?
CC-BY-SA | 45 | attribution | creative commons attribution[- ]share ?alike(?: licen[cs]e)?
CC-BY-NC | 45 | attribution | creative commons attribution[- ]non ?commercial(?: licen[cs]e)?
CC-BY-ND | 45 | attribution | creative commons attribution[- ]no ?deriv(?:ative)?s?(?: licen[cs]e)?
CC-BY-NC-SA | 46 | attribution | creative commons attribution[- ]non ?commercial[- ]share ?alike(?: licen[cs]e)?
CC-BY-NC-ND | 46 | attribution | creative commons attribution[- ]non ?commercial[- ]no ?deriv(?:ative)?s?(?: licen[cs]e)?
CC-BY | 40 | attribution | creative commons attribution(?: licen[cs]e)?
CC | 30 | commons | creative commons(?: licen[cs]e)?
Apache | 40 | apache | apache (?:software )?licen[cs]e
MIT | 40 | mit | \bmit(?:/x11|/expat)? licen[cs]e\b
MIT | 40 | expat | \bexpat licen[cs]e\b
MIT-0 | 45 | mit | \bmit no attribution(?: licen[cs]e)?
BSD-2-Clause | 45 | bsd | \b(?:2-clause|two-clause|simplified|freebsd) bsd licen[cs]e\b
BSD-3-Clause | 45 | bsd | \b(?:3-clause|three-clause|new|modified|revised) bsd licen[cs]e\b
BSD-4-Clause | 45 | bsd | \b(?:4-clause|four-clause|original|old) bsd licen[cs]e\b
0BSD | 45 | bsd | \b(?:zero-clause bsd|bsd zero clause|0bsd)\b
BSD-2-Clause | 45 | bsd-2-clause | \bbsd-2-clause\b
BSD-3-Clause | 45 | bsd-3-clause | \bbsd-3-clause\b
BSD | 40 | bsd | \bbsd(?:-style)? licen[cs]e\b
ISC | 40 | isc | \bisc licen[cs]e\b
GPL | 40 | general | gnu general public licen[cs]e
LGPL | 40 | general | gnu (?:lesser|library) general public licen[cs]e
AGPL | 40 | affero | gnu affero general public licen[cs]e
GPL | 35 | gpl | \b(?:gnu )?gpl\b
LGPL | 35 | lgpl | \b(?:gnu )?lgpl\b
AGPL | 35 | agpl | \b(?:gnu )?agpl\b
GFDL | 40 | documentation | gnu free documentation licen[cs]e
MPL | 40 | mozilla | mozilla public licen[cs]e
EPL | 40 | eclipse | eclipse public licen[cs]e
CDDL | 40 | development | common development and distribution licen[cs]e
EUPL | 40 | european | european union public licen[cs]e
Artistic | 40 | artistic | \bartistic licen[cs]e\b
OFL | 40 | font | \b(?:sil )?open font licen[cs]e\b
Zlib | 40 | zlib | \bzlib(?:/libpng)? licen[cs]e\b
Unlicense | 40 | unlicense | \bthe unlicense\b
WTFPL | 40 | wtfpl | \bwtfpl\b
NCSA | 40 | illinois | university of illinois/ncsa(?: open source licen[cs]e)?
PostgreSQL | 40 | postgresql | \bpostgresql licen[cs]e\b
OpenSSL | 40 | openssl | \bopenssl licen[cs]e\b
PSF-2.0 | 40 | python | \bpython software foundation licen[cs]e\b
PHP | 40 | php | \bphp licen[cs]e\b
Ruby | 40 | ruby | \bruby licen[cs]e\b
Vim | 40 | vim | \bvim licen[cs]e\b
FTL | 40 | freetype | \bfreetype (?:project )?licen[cs]e\b
IJG | 40 | jpeg | \bindependent jpeg group(?: licen[cs]e)?
ICU | 40 | icu | \bicu licen[cs]e\b
W3C | 40 | w3c | \bw3c software(?: notice and)? licen[cs]e\b
X11 | 40 | x11 | \bx11 licen[cs]e\b
ODbL | 40 | database | open (?:data commons open )?database licen[cs]e
ODC-By | 40 | attribution | open data commons attribution licen[cs]e
Elastic | 40 | elastic | \belastic licen[cs]e\b
Commons-Clause | 40 | commons | \bcommons clause\b
BlueOak-1.0.0 | 40 | oak | \bblue oak model licen[cs]e\b
OpenRAIL | 40 | openrail | \b(?:bigscience |creativeml )?openrail(?:-m|\+\+)?\b
Unicode | 40 | unicode | \bunicode(?:, inc\.?)? licen[cs]e\b
Public-Domain | 30 | domain | \bpublic domain\b
Unknown | 20 | licensed | \b(?:dual[- ])?licensed (?:under|to) [^\n.]{1,60}
Unknown | 20 | licen | \b(?:see|read) (?:the )?(?:accompanying |enclosed )?licen[cs]e(?:\.txt|\.md)?(?: file)?\b
Unknown | 20 | subject | \bsubject to (?:the )?(?:terms|license) (?:and conditions )?of [^\n.]{1,60}
Copyright | 15 | copyright | \bcopyright (?:\(c\) |© ?)?(?:19|20)\d\d(?: ?[-,–] ?(?:19|20)\d\d)*
"""


@dataclass(frozen=True)
class Rule:
    name: str
    licence: str
    priority: int
    keyword: str
    regex: re.Pattern
    group: int = 0  #: what is detected: the whole match, or a part of it


def _compiled(pattern: str) -> re.Pattern:
    """A pattern with its blanks made white space; those within square brackets stay."""
    parts = re.split(r"(\[[^\]]*\])", pattern)
    return re.compile("".join(p if i % 2 else p.replace(" ?", _BLANK).replace(" ", _GAP) for i, p in enumerate(parts)), re.IGNORECASE | re.ASCII)


def rules() -> list[Rule]:
    """All rules, in order."""
    found = [Rule(f"tag:{x}", x, 90, "spdx-license-identifier", _compiled(r"spdx-license-identifier: ?[(]* ?" + re.escape(x) + r"(?![\w.+-])")) for x in TAGS.split()]
    # the further operands of a tag's expression, each detected where it stands
    found += [Rule(f"operand:{x}", x, 90, "spdx-license-identifier", _compiled(r"spdx-license-identifier: ?(?:[(]* ?[\w.+-]+ ?[)]* ?\b(?:and|or|with)\b )+[(]* ?(" + re.escape(x) + r")(?![\w.+-])"), 1) for x in TAGS.split()]
    for k, line in enumerate(SIGNATURES.strip().splitlines()):
        licence, priority, keyword, pattern = (x.strip() for x in line.split("|", 3))
        found.append(Rule(f"{k:03d}:{licence}", licence, int(priority), keyword, _compiled(pattern)))
    return found
