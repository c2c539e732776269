"""Hand-written licence signatures over normalised text: lower-case words parted by single spaces.

One rule a line: label | priority | keyword | expression. The keyword is a plain substring that every match holds; the
expression is tried only where the text has it. Priority: 1 hint, 2 name, 3 name with version, 4 notice or body of a licence.
"""

RULES = r"""
mit|4|permission is hereby granted|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|4|provided as is|the software is provided as is without warranty of any kind express or implied
mit|4|shall be included in all copies|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit|3|mit license|(?:released|licensed|distributed|available|published|covered|provided) under (?:the )?(?:terms of )?(?:the )?mit license
mit|2|mit license|mit license
mit|2|mit licence|mit licence
mit|2|mit licensed|mit licensed
mit|2|expat licen|expat licen[cs]e
mit|3|license mit|licen[cs]e mit
mit|4|identifier mit|spdx license identifier mit
mit-0|3|mit no attribution|mit no attribution(?: licen[cs]e)?
mit-0|4|identifier mit 0|spdx license identifier mit 0
x11|2|x11 licen|x11 licen[cs]e
apache|2|apache license|apache license
apache|2|apache licence|apache licence
apache|1|apache software foundation|apache software foundation licen[cs]e
apache-1.0|3|apache license|apache license (?:version |v)?1 0
apache-1.1|3|apache|apache (?:software )?licen[cs]e (?:version |v ?)?1 1
apache-1.1|4|apache software foundation|this product includes software developed by the apache software foundation
apache-2.0|3|apache license|apache license (?:version |v ?)?2(?: 0)?
apache-2.0|3|apache 2|apache 2(?: 0)? licen[cs]ed?
apache-2.0|4|apache license version 2 0|licensed under the apache license version 2 0(?: the license)?
apache-2.0|4|may not use this file except in compliance|you may not use this file except in compliance with the license
apache-2.0|4|apache org licenses|(?:https? )?(?:www )?apache org licenses license 2 0
apache-2.0|4|terms and conditions for use reproduction|terms and conditions for use reproduction and distribution
apache-2.0|4|identifier apache|spdx license identifier apache 2 0
apache-2.0|3|license apache 2|licen[cs]e apache 2 0
apache-2.0|2|asl 2|asl ?2(?: 0)? licen[cs]e
gpl|2|general public license|(?:gnu )?general public license
gpl|2|general public licence|(?:gnu )?general public licence
gpl|2|gnu gpl|gnu gpl
gpl|2|gpl licen|gpl licen[cs]ed?
gpl|2|under the gpl|(?:licensed|released|distributed) under the gpl
gpl-1.0|3|general public license|general public license (?:as published by the free software foundation )?(?:version |v ?)1(?: 0)?
gpl-1.0|4|identifier gpl 1|spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0|3|general public license|general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)2(?: 0)?
gpl-2.0|3|gplv2|gplv2
gpl-2.0|3|gpl v2|gpl v2
gpl-2.0|3|gpl version 2|gpl version 2
gpl-2.0|3|gpl 2|gpl 2 0
gpl-2.0|4|version 2 june 1991|gnu general public license version 2 june 1991
gpl-2.0|4|identifier gpl 2|spdx license identifier gpl 2 0(?: only| or later)?
gpl-2.0|4|either version 2 of the license|either version 2 of the license or at your option any later version
gpl-3.0|3|general public license|general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)?
gpl-3.0|3|gplv3|gplv3
gpl-3.0|3|gpl v3|gpl v3
gpl-3.0|3|gpl version 3|gpl version 3
gpl-3.0|3|gpl 3|gpl 3 0
gpl-3.0|4|version 3 29 june 2007|gnu general public license version 3 29 june 2007
gpl-3.0|4|identifier gpl 3|spdx license identifier gpl 3 0(?: only| or later)?
gpl-3.0|4|either version 3 of the license|either version 3 of the license or at your option any later version
gpl-3.0|4|general public license version 3|this (?:work|program|software|file|library) is licensed under the gnu general public license version 3
gpl|4|redistribute it and or modify|you can redistribute it and or modify it under the terms of the gnu general public license
gpl|4|received a copy of the gnu general|you should have received a copy of the gnu general public license along with this (?:program|work|software|library|file)
gpl|4|in the hope that it will be useful|distributed in the hope that it will be useful but without any warranty
gpl|3|gnu org licenses gpl|gnu org licenses gpl
gpl-classpath|3|classpath exception|(?:gpl |general public license )?(?:with |plus )?(?:the )?classpath exception
gpl-font|3|font exception|gpl (?:with |plus )?(?:the )?font exception
lgpl|2|lesser general public license|(?:gnu )?lesser general public license
lgpl|2|library general public license|(?:gnu )?library general public license
lgpl|2|gnu lgpl|gnu lgpl
lgpl|2|lgpl licen|lgpl licen[cs]ed?
lgpl-2.0|3|library general public license|library general public license (?:version |v ?)2(?: 0)?
lgpl-2.1|3|lesser general public license|lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)2 1
lgpl-2.1|3|lgplv2|lgplv2(?: 1)?
lgpl-2.1|3|lgpl 2 1|lgpl 2 1
lgpl-2.1|4|identifier lgpl 2|spdx license identifier lgpl 2 [01](?: only| or later)?
lgpl-3.0|3|lesser general public license|lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)?
lgpl-3.0|3|lgplv3|lgplv3
lgpl-3.0|3|lgpl 3|lgpl 3 0
lgpl-3.0|4|identifier lgpl 3|spdx license identifier lgpl 3 0(?: only| or later)?
agpl|2|affero general public license|(?:gnu )?affero general public license
agpl|2|gnu agpl|gnu agpl
agpl|2|agpl licen|agpl licen[cs]ed?
agpl-3.0|3|affero general public license|affero general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)?
agpl-3.0|3|agplv3|agplv3
agpl-3.0|3|agpl 3|agpl 3 0
agpl-3.0|4|identifier agpl 3|spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0|4|version 3 19 november 2007|gnu affero general public license version 3 19 november 2007
gfdl|2|free documentation license|(?:gnu )?free documentation license
gfdl-1.1|3|free documentation license|free documentation license version 1 1
gfdl-1.2|3|free documentation license|free documentation license version 1 2
gfdl-1.3|3|free documentation license|free documentation license version 1 3
gfdl|4|copy distribute and or modify this document|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl|4|identifier gfdl|spdx license identifier gfdl 1 [123](?: only| or later)?
bsd|2|bsd license|bsd license
bsd|2|bsd licence|bsd licence
bsd|2|bsd licensed|bsd licensed
bsd|2|bsd style licen|bsd style licen[cs]e
bsd|4|redistribution and use in source|redistribution and use in source and binary forms with or without modification are permitted
bsd|4|redistributions of source code must|redistributions of source code must retain the above copyright notice
bsd|4|redistributions in binary form must|redistributions in binary form must reproduce the above copyright notice
bsd-2-clause|3|2 clause|(?:bsd )?2 clause (?:bsd )?licen[cs]e
bsd-2-clause|3|simplified bsd licen|simplified bsd licen[cs]e
bsd-2-clause|3|freebsd licen|freebsd licen[cs]e
bsd-2-clause|4|identifier bsd 2|spdx license identifier bsd 2 clause
bsd-3-clause|3|3 clause|(?:bsd )?3 clause (?:bsd )?licen[cs]e
bsd-3-clause|3|new bsd licen|new bsd licen[cs]e
bsd-3-clause|3|modified bsd licen|modified bsd licen[cs]e
bsd-3-clause|3|revised bsd licen|revised bsd licen[cs]e
bsd-3-clause|4|endorse or promote products|neither the name of .{1,120}? may be used to endorse or promote products derived from this software
bsd-3-clause|4|identifier bsd 3|spdx license identifier bsd 3 clause
bsd-4-clause|3|4 clause|(?:bsd )?4 clause (?:bsd )?licen[cs]e
bsd-4-clause|3|original bsd licen|original bsd licen[cs]e
bsd-4-clause|4|all advertising materials mentioning|all advertising materials mentioning features or use of this software must display
bsd-4-clause|4|identifier bsd 4|spdx license identifier bsd 4 clause
0bsd|3|zero clause|(?:bsd )?zero clause (?:bsd )?licen[cs]e
0bsd|4|identifier 0bsd|spdx license identifier 0bsd
isc|2|isc license|isc license
isc|2|isc licence|isc licence
isc|4|permission to use copy modify|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|4|identifier isc|spdx license identifier isc
mpl|2|mozilla public license|mozilla public license
mpl|2|mozilla public licence|mozilla public licence
mpl-1.0|3|mozilla public license|mozilla public license (?:version |v ?)?1 0
mpl-1.1|3|mozilla public license|mozilla public license (?:version |v ?)?1 1
mpl-2.0|3|mozilla public license|mozilla public license (?:version |v ?)?2 0
mpl-2.0|3|mpl 2|mpl 2 0
mpl-2.0|4|subject to the terms of the mozilla|this source code form is subject to the terms of the mozilla public license(?: v 2 0)?
mpl-2.0|4|identifier mpl 2|spdx license identifier mpl 2 0
epl|2|eclipse public license|eclipse public license
epl-1.0|3|eclipse public license|eclipse public license (?:version |v ?)?1 0
epl-2.0|3|eclipse public license|eclipse public license (?:version |v ?)?2 0
epl-2.0|4|identifier epl 2|spdx license identifier epl 2 0
epl-1.0|4|identifier epl 1|spdx license identifier epl 1 0
edl|2|eclipse distribution license|eclipse distribution license(?: (?:version |v ?)?1 0)?
cpl-1.0|3|common public license|common public license(?: (?:version |v ?)?1 0)?
cddl|2|common development and distribution license|common development and distribution license
cddl-1.0|3|common development and distribution license|common development and distribution license (?:version |v ?)?1 0
cddl-1.1|3|common development and distribution license|common development and distribution license (?:version |v ?)?1 1
cddl-1.0|4|identifier cddl|spdx license identifier cddl 1 [01]
apsl|2|apple public source license|apple public source license(?: (?:version |v ?)?[12] [012])?
artistic|2|artistic license|artistic license
artistic-1.0|3|artistic license|artistic license (?:version |v ?)?1 0
artistic-2.0|3|artistic license|artistic license (?:version |v ?)?2 0
artistic-2.0|4|identifier artistic|spdx license identifier artistic 2 0
perl|2|same terms as perl|(?:under the )?same terms as perl(?: itself)?(?: licen[cs]e)?
zlib|2|zlib license|zlib license
zlib|2|zlib libpng license|zlib libpng license
zlib|4|altered source versions must|altered source versions must be plainly marked as such and must not be misrepresented
zlib|4|identifier zlib|spdx license identifier zlib
libpng|2|libpng license|libpng license
bsl-1.0|3|boost software license|boost software license(?: (?:version |v ?)?1 0)?
bsl-1.0|4|identifier bsl|spdx license identifier bsl 1 0
busl-1.1|3|business source license|business source license(?: (?:version |v ?)?1 1)?
busl-1.1|4|identifier busl|spdx license identifier busl 1 1
sspl-1.0|3|server side public license|server side public license(?: (?:version |v ?)?1)?
elastic-2.0|3|elastic license|elastic license(?: (?:version |v ?)?2(?: 0)?)?
commons-clause|3|commons clause|commons clause (?:license )?(?:condition )?
confluent|3|confluent community license|confluent community license(?: agreement)?
polyform|3|polyform|polyform (?:noncommercial|small business|shield|strict|internal use|perimeter) licen[cs]e
prosperity|3|prosperity public license|prosperity public license
parity|3|parity public license|parity public license
unlicense|3|the unlicense|the unlicense
unlicense|4|released into the public domain|this is free and unencumbered software released into the public domain
unlicense|4|identifier unlicense|spdx license identifier unlicense
wtfpl|3|do what the|do what the (?:fuck|f) you want to public license
wtfpl|3|wtfpl licen|wtfpl licen[cs]e
wtfpl|4|identifier wtfpl|spdx license identifier wtfpl
beerware|3|beerware license|beerware license
jquery|1|jquery license|jquery license
cc0-1.0|3|cc0|cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?(?: licen[cs]e)?
cc0-1.0|3|creative commons zero|creative commons zero(?: v?1 0)?(?: universal)?(?: licen[cs]e)?
cc0-1.0|4|identifier cc0|spdx license identifier cc0 1 0
cc|1|creative commons|creative commons
cc|2|creative commons license|(?:under a |a )?creative commons license
cc-by-4.0|3|cc by 4|cc by 4 0
cc-by-3.0|3|cc by 3|cc by 3 0
cc-by-2.5|3|cc by 2|cc by 2 5
cc-by-2.0|3|cc by 2 0|cc by 2 0
cc-by-1.0|3|cc by 1|cc by 1 0
cc-by-sa-4.0|3|cc by sa 4|cc by sa 4 0
cc-by-sa-3.0|3|cc by sa 3|cc by sa 3 0
cc-by-sa-2.5|3|cc by sa 2 5|cc by sa 2 5
cc-by-sa-2.0|3|cc by sa 2 0|cc by sa 2 0
cc-by-nc-4.0|3|cc by nc 4|cc by nc 4 0
cc-by-nc-4.0|4|licensed under cc by nc 4|licensed under cc by nc 4 0
cc-by-nc-3.0|3|cc by nc 3|cc by nc 3 0
cc-by-nc-2.0|3|cc by nc 2|cc by nc 2 [05]
cc-by-nd-4.0|3|cc by nd 4|cc by nd 4 0
cc-by-nd-3.0|3|cc by nd 3|cc by nd 3 0
cc-by-nc-sa-4.0|3|cc by nc sa 4|cc by nc sa 4 0
cc-by-nc-sa-3.0|3|cc by nc sa 3|cc by nc sa 3 0
cc-by-nc-sa-2.0|3|cc by nc sa 2|cc by nc sa 2 [05]
cc-by-nc-nd-4.0|3|cc by nc nd 4|cc by nc nd 4 0
cc-by-nc-nd-3.0|3|cc by nc nd 3|cc by nc nd 3 0
cc-by-nc-nd-2.0|3|cc by nc nd 2|cc by nc nd 2 [05]
cc-by|2|creative commons attribution|creative commons attribution(?: licen[cs]e)?
cc-by-4.0|3|creative commons attribution|creative commons attribution (?:4 0 international|international)(?: public)?(?: licen[cs]e)?
cc-by-3.0|3|creative commons attribution|creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?
cc-by-sa|2|attribution sharealike|(?:creative commons )?attribution sharealike(?: licen[cs]e)?
cc-by-sa|2|attribution share alike|(?:creative commons )?attribution share alike(?: licen[cs]e)?
cc-by-sa-4.0|3|attribution sharealike 4|(?:creative commons )?attribution sharealike 4 0(?: international)?(?: licen[cs]e)?
cc-by-sa-3.0|3|attribution sharealike 3|(?:creative commons )?attribution sharealike 3 0(?: unported)?(?: licen[cs]e)?
cc-by-nc|2|attribution noncommercial|(?:creative commons )?attribution noncommercial(?: licen[cs]e)?
cc-by-nc|2|attribution non commercial|(?:creative commons )?attribution non commercial(?: licen[cs]e)?
cc-by-nc-4.0|3|attribution noncommercial 4|(?:creative commons )?attribution noncommercial 4 0(?: international)?(?: licen[cs]e)?
cc-by-nd|2|attribution noderivatives|(?:creative commons )?attribution noderiv(?:ative)?s(?: licen[cs]e)?
cc-by-nc-sa|2|attribution noncommercial sharealike|(?:creative commons )?attribution noncommercial sharealike(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc-nd|2|attribution noncommercial noderivatives|(?:creative commons )?attribution noncommercial noderiv(?:ative)?s(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by|3|creativecommons org licenses by|creativecommons org licenses by [1234] [05]
cc-by-sa|3|creativecommons org licenses by sa|creativecommons org licenses by sa [1234] [05]
cc-by-nc|3|creativecommons org licenses by nc|creativecommons org licenses by nc [1234] [05]
cc-by-nd|3|creativecommons org licenses by nd|creativecommons org licenses by nd [1234] [05]
cc-by-nc-sa|3|creativecommons org licenses by nc sa|creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd|3|creativecommons org licenses by nc nd|creativecommons org licenses by nc nd [1234] [05]
cc0-1.0|3|creativecommons org publicdomain zero|creativecommons org publicdomain zero 1 0
cc-by|4|identifier cc by|spdx license identifier cc by(?: nc)?(?: sa| nd)? [1234] [05]
odbl-1.0|3|open database license|open database license(?: (?:version |v ?)?1 0)?
odc-by-1.0|3|open data commons attribution|open data commons attribution licen[cs]e(?: (?:version |v ?)?1 0)?
pddl-1.0|3|public domain dedication and license|public domain dedication and license(?: (?:version |v ?)?1 0)?
ogl-uk|3|open government licen|open government licen[cs]e(?: (?:version |v ?)?[123](?: 0)?)?
etalab|3|licence ouverte|licence ouverte(?: (?:version |v ?)?[12] ?0?)?
cdla|3|community data license agreement|community data license agreement (?:permissive|sharing)(?: (?:version |v ?)?[12] 0)?
ofl-1.1|3|open font license|(?:sil )?open font license(?: (?:version |v ?)?1 [01])?
ofl-1.1|4|identifier ofl|spdx license identifier ofl 1 1
ufl-1.0|3|ubuntu font licen|ubuntu font licen[cs]e(?: (?:version |v ?)?1 0)?
eupl|2|european union public licen|european union public licen[cs]e
eupl-1.1|3|european union public licen|european union public licen[cs]e (?:version |v ?)?1 1
eupl-1.2|3|european union public licen|european union public licen[cs]e (?:version |v ?)?1 2
cecill|2|cecill|cecill(?: [abc])?(?: (?:version |v ?)?[12](?: [01])?)? licen[cs]e
mulanpsl|3|mulan psl|mulan psl(?: ?v2)?
mulanpsl|3|mulan permissive software license|mulan permissive software license(?: (?:version |v ?)?2)?
python|2|python software foundation license|python software foundation license(?: (?:version |v ?)?2)?
python|2|psf license|psf license
php-3.01|3|php license|php license(?: (?:version |v ?)?3 ?0?1)?
ruby|2|ruby license|ruby license
openssl|2|openssl license|openssl license
openssl|4|developed by the openssl project|this product includes software developed by the openssl project
curl|2|curl license|curl license
tcl|2|tcl license|tcl(?: tk)? license
vim|2|vim license|vim license
postgresql|2|postgresql license|postgresql license
ncsa|2|university of illinois|university of illinois (?:ncsa )?open source license
ncsa|3|ncsa open source license|ncsa open source license
w3c|2|w3c software|w3c software (?:and document )?(?:notice and )?license
icu|2|icu license|icu license
unicode|2|unicode license|unicode license(?: agreement)?
afl|2|academic free license|academic free license(?: (?:version |v ?)?[123] [01])?
osl|2|open software license|open software license(?: (?:version |v ?)?[123] [01])?
qpl|2|q public license|q public license(?: (?:version |v ?)?1 0)?
nasa|2|nasa open source agreement|nasa open source (?:software )?agreement(?: licen[cs]e)?
ibm|2|ibm public license|ibm public license(?: (?:version |v ?)?1 0)?
intel|2|intel open source license|intel open source license
ms-pl|3|microsoft public license|microsoft public license
ms-rl|3|microsoft reciprocal license|microsoft reciprocal license
sun|2|sun public license|sun public license
upl-1.0|3|universal permissive license|universal permissive license(?: (?:version |v ?)?1 0)?
blueoak-1.0|3|blue oak model license|blue oak model license(?: (?:version |v ?)?1 0 0)?
hippocratic|3|hippocratic license|hippocratic license(?: (?:version |v ?)?[123] [01])?
json|3|json license|json license
json|4|shall be used for good|the software shall be used for good not evil
zpl|2|zope public license|zope public license(?: (?:version |v ?)?[12] [01])?
sleepycat|2|sleepycat license|sleepycat license
watcom|2|open watcom public license|(?:sybase )?open watcom public license(?: 1 0)?
llama|3|llama|llama(?: [23](?: [0-9])?)? community license(?: agreement)?
openrail|3|openrail|(?:creativeml |bigscience )?(?:open ?rail(?: m)?)(?: license)?
rail|3|responsible ai license|responsible ai license(?:s)?
gemma|3|gemma|gemma terms of use(?: license)?
public-domain|2|public domain|(?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain|1|public domain|(?:is|are) (?:in )?the public domain
proprietary|2|proprietary license|proprietary license
proprietary|2|proprietary and confidential|proprietary and confidential
proprietary|1|all rights reserved|all rights reserved
proprietary|2|end user license agreement|end user license agreement
proprietary|2|commercial license|commercial license
copyright|1|copyright|copyright (?:c )?(?:19|20)[0-9]{2}
copyright|1|copyright by|copyright by
permissive|1|permission is granted|permission is granted
reference|1|see the license|see the license(?: file)?
reference|1|license file|license file
reference|1|licensed under the terms|licensed under the terms
"""

#: Every keyword holds one of these, so a text without any has no detection.
STEMS = ("identifier", "asl 2", "general", "modify this", "mozilla", "polyform", "do what the", "cecill", "illinois", "llama", "licen", "gpl", "copyright", "public domain", "creative", "permi", "redistribut", "provided as is", "advertising materials", "software", "cc by", "cc0", "mpl 2", "proprietary", "all rights", "clause", "apache", "exception", "version 2", "version 3", "gemma", "openrail", "mulan", "same terms as", "endorse", "in the hope that", "attribution", "source versions", "nasa open", "developed by", "shall be", "compliance", "terms and conditions", "confidential")


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, expression), in order."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keyword, expression = line.split("|", 3)
        out.append((label, int(priority), keyword, expression))
    return out
