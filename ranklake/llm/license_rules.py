"""Signatures of licences, in order: priority | licence | keyword | pattern.

Of two detections where one lies within the other, that of the lower priority number stays. Keywords say
what a rule is about; which texts skip it follows from its pattern. Patterns ignore case, and white space in them stands for any white space.
Priorities: 1 tags, 2 legal texts, 3 names with a version, 4 links, 5 names, 6 mentions of a family, 7 generic statements.
"""

RULES = r"""
1 | MIT | spdx-license | spdx-license-identifier: mit(?![\w.-])
1 | MIT-0 | spdx-license | spdx-license-identifier: mit-0(?![\w.])
1 | Apache-2.0 | spdx-license | spdx-license-identifier: apache-2\.0
1 | Apache-1.1 | spdx-license | spdx-license-identifier: apache-1\.1
1 | BSD-2-Clause | spdx-license | spdx-license-identifier: bsd-2-clause(?!-)
1 | BSD-3-Clause | spdx-license | spdx-license-identifier: bsd-3-clause(?!-)
1 | BSD-4-Clause | spdx-license | spdx-license-identifier: bsd-4-clause(?!-)
1 | BSD-2-Clause-Patent | spdx-license | spdx-license-identifier: bsd-2-clause-patent
1 | 0BSD | spdx-license | spdx-license-identifier: 0bsd
1 | ISC | spdx-license | spdx-license-identifier: isc(?![\w-])
1 | GPL-1.0-only | spdx-license | spdx-license-identifier: gpl-1\.0(-only)?(?![\w+-])
1 | GPL-2.0-only | spdx-license | spdx-license-identifier: gpl-2\.0(-only)?(?![\w+-])
1 | GPL-2.0-or-later | spdx-license | spdx-license-identifier: gpl-2\.0(\+|-or-later)
1 | GPL-3.0-only | spdx-license | spdx-license-identifier: gpl-3\.0(-only)?(?![\w+-])
1 | GPL-3.0-or-later | spdx-license | spdx-license-identifier: gpl-3\.0(\+|-or-later)
1 | LGPL-2.0-only | spdx-license | spdx-license-identifier: lgpl-2\.0(-only)?(?![\w+-])
1 | LGPL-2.1-only | spdx-license | spdx-license-identifier: lgpl-2\.1(-only)?(?![\w+-])
1 | LGPL-2.1-or-later | spdx-license | spdx-license-identifier: lgpl-2\.1(\+|-or-later)
1 | LGPL-3.0-only | spdx-license | spdx-license-identifier: lgpl-3\.0(-only)?(?![\w+-])
1 | LGPL-3.0-or-later | spdx-license | spdx-license-identifier: lgpl-3\.0(\+|-or-later)
1 | AGPL-3.0-only | spdx-license | spdx-license-identifier: agpl-3\.0(-only)?(?![\w+-])
1 | AGPL-3.0-or-later | spdx-license | spdx-license-identifier: agpl-3\.0(\+|-or-later)
1 | MPL-1.1 | spdx-license | spdx-license-identifier: mpl-1\.1
1 | MPL-2.0 | spdx-license | spdx-license-identifier: mpl-2\.0
1 | EPL-1.0 | spdx-license | spdx-license-identifier: epl-1\.0
1 | EPL-2.0 | spdx-license | spdx-license-identifier: epl-2\.0
1 | CDDL-1.0 | spdx-license | spdx-license-identifier: cddl-1\.0
1 | CDDL-1.1 | spdx-license | spdx-license-identifier: cddl-1\.1
1 | EUPL-1.1 | spdx-license | spdx-license-identifier: eupl-1\.1
1 | EUPL-1.2 | spdx-license | spdx-license-identifier: eupl-1\.2
1 | BSL-1.0 | spdx-license | spdx-license-identifier: bsl-1\.0
1 | BUSL-1.1 | spdx-license | spdx-license-identifier: busl-1\.1
1 | Unlicense | spdx-license | spdx-license-identifier: unlicense
1 | WTFPL | spdx-license | spdx-license-identifier: wtfpl
1 | Zlib | spdx-license | spdx-license-identifier: zlib
1 | Artistic-2.0 | spdx-license | spdx-license-identifier: artistic-2\.0
1 | CC0-1.0 | spdx-license | spdx-license-identifier: cc0-1\.0
1 | CC-BY-4.0 | spdx-license | spdx-license-identifier: cc-by-4\.0
1 | CC-BY-3.0 | spdx-license | spdx-license-identifier: cc-by-3\.0
1 | CC-BY-SA-4.0 | spdx-license | spdx-license-identifier: cc-by-sa-4\.0
1 | CC-BY-SA-3.0 | spdx-license | spdx-license-identifier: cc-by-sa-3\.0
1 | CC-BY-NC-4.0 | spdx-license | spdx-license-identifier: cc-by-nc-4\.0
1 | CC-BY-NC-SA-4.0 | spdx-license | spdx-license-identifier: cc-by-nc-sa-4\.0
1 | CC-BY-NC-ND-4.0 | spdx-license | spdx-license-identifier: cc-by-nc-nd-4\.0
1 | CC-BY-ND-4.0 | spdx-license | spdx-license-identifier: cc-by-nd-4\.0
1 | OFL-1.1 | spdx-license | spdx-license-identifier: ofl-1\.1
1 | PostgreSQL | spdx-license | spdx-license-identifier: postgresql
1 | PSF-2.0 | spdx-license | spdx-license-identifier: (psf|python)-2\.0
1 | Ruby | spdx-license | spdx-license-identifier: ruby
1 | MulanPSL-2.0 | spdx-license | spdx-license-identifier: mulanpsl-2\.0
1 | UPL-1.0 | spdx-license | spdx-license-identifier: upl-1\.0
1 | NCSA | spdx-license | spdx-license-identifier: ncsa
1 | SSPL-1.0 | spdx-license | spdx-license-identifier: sspl-1\.0
1 | Elastic-2.0 | spdx-license | spdx-license-identifier: elastic-2\.0
1 | LLVM-exception | llvm-exception | \bapache-2\.0 with llvm-exception\b
1 | Classpath-exception | classpath-exception | \bgpl-2\.0(-only|-or-later|\+)? with classpath-exception-2\.0\b
2 | MIT | permission is hereby granted, free | permission is hereby granted, free of charge, to any person obtaining a copy of this software
2 | MIT | the above copyright notice and this | the above copyright notice and this permission notice shall be included in all copies or substantial portions
2 | MIT | provided "as is" | the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
2 | X11 | x consortium | except as contained in this notice, the name of the x consortium shall not be used
2 | ISC | permission to use, copy, modify | permission to use, copy, modify,? and(/or)? distribute this software for any purpose with or without fee is hereby granted
2 | BSD | redistribution and use in source | redistribution and use in source and binary forms, with or without modification, are permitted
2 | BSD | redistributions of source code | redistributions of source code must retain the above copyright notice
2 | BSD | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
2 | BSD-3-Clause | neither the name | neither the name of .{0,80}? nor the names of its contributors may be used to endorse or promote products
2 | BSD-4-Clause | all advertising materials | all advertising materials mentioning features or use of this software must display
2 | Apache-2.0 | you may not use this file except | you may not use this file except in compliance with the license
2 | Apache-2.0 | terms and conditions for use, rep | terms and conditions for use, reproduction, and distribution
2 | Apache-2.0 | grant of patent license | grant of patent license\. subject to the terms and conditions
2 | Apache-2.0 | distributed on an "as is" basis | distributed under the license is distributed on an "as is" basis
2 | GPL | this program is free software | this program is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public license
2 | LGPL | this library is free software | this library is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu (lesser|library) general public license
2 | GPL | everyone is permitted to copy | everyone is permitted to copy and distribute verbatim copies of this license document
2 | GPL | implied warranty of | without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu
2 | GPL | you should have received a copy | you should have received a copy of the gnu general public license
2 | LGPL | you should have received a copy | you should have received a copy of the gnu lesser general public license
2 | AGPL | you should have received a copy | you should have received a copy of the gnu affero general public license
2 | GPL-linking | linking this library statically | linking this library statically or dynamically with other modules is making a combined work
2 | MPL-2.0 | source code form is subject | this source code form is subject to the terms of the mozilla public license, v\. 2\.0
2 | MPL-1.1 | the contents of this file are subject to the mozilla | the contents of this file are subject to the mozilla public license version 1\.1
2 | NPL | the contents of this file are subject to the netscape | the contents of this file are subject to the netscape public license
2 | CDDL | the contents of this file are subject to the terms of the common | the contents of this file are subject to the terms of the common development and distribution license
2 | EPL | this program and the accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license
2 | BSL-1.0 | boost software license | permission is hereby granted.{0,160}boost software license
2 | Zlib | altered source versions | altered source versions must be plainly marked as such
2 | Zlib | misrepresented | the origin of this software must not be misrepresented
2 | Unlicense | unencumbered software | this is free and unencumbered software released into the public domain
2 | WTFPL | do what the fuck | you just do what the fuck you want to
2 | CC0-1.0 | waived all copyright | has waived all copyright and related or neighboring rights
2 | OFL-1.1 | reserved font name | copyright .{0,120}with reserved font name
2 | PSF-2.0 | psf is making python | psf is making python available to licensee on an "as is" basis
2 | JSON | shall be used for good | the software shall be used for good, not evil
2 | Beerware | beer-ware | "the beer-ware license"
2 | CC | by exercising the licensed rights | by exercising the licensed rights .{0,60}you accept and agree to be bound
2 | Proprietary | unauthorized copying | unauthorized copying of this file, via any medium,? is strictly prohibited
2 | Proprietary | proprietary and confidential | \bproprietary and confidential\b
2 | Proprietary | no part of this | no part of this (publication|book|work|document) may be reproduced
2 | Proprietary | trade secret | contains (confidential information and )?trade secrets? of
3 | Apache-2.0 | apache license | \bapache license,? (version|v\.?) ?2(\.0)?(?![\d.]\d)
3 | Apache-2.0 | apache 2 | \bapache 2(\.0)?( license)?\b
3 | Apache-2.0 | apache-2 | \bapache-2(\.0)?\b
3 | Apache-2.0 | apache software license | \bapache software license,? version 2\.0
3 | Apache-1.1 | apache software license | \bapache software license,? version 1\.1
3 | Apache-1.0 | apache license | \bapache license,? version 1\.0
3 | GPL-3.0 | gnu general public license | \bgnu general public license,? (as published by the free software foundation, )?(either )?(version|v\.?) ?3(\.0)?
3 | GPL-2.0 | gnu general public license | \bgnu general public license,? (as published by the free software foundation, )?(either )?(version|v\.?) ?2(\.0)?
3 | GPL-1.0 | gnu general public license | \bgnu general public license,? (version|v\.?) ?1(\.0)?
3 | GPL-3.0 | gplv3 | \b(gnu )?gplv3\+?
3 | GPL-2.0 | gplv2 | \b(gnu )?gplv2\+?
3 | GPL-3.0 | gpl-3 | \bgpl-3(\.0)?(-only|-or-later|\+)?
3 | GPL-2.0 | gpl-2 | \bgpl-2(\.0)?(-only|-or-later|\+)?
3 | GPL-3.0 | gpl 3 | \bgpl 3(\.0)?\b
3 | GPL-2.0 | gpl 2 | \bgpl 2(\.0)?\b
3 | GPL-3.0 | gpl version 3 | \bgpl version 3
3 | GPL-2.0 | gpl version 2 | \bgpl version 2
3 | LGPL-3.0 | lesser general public license | \bgnu lesser general public license,? (either )?(version|v\.?) ?3(\.0)?
3 | LGPL-2.1 | lesser general public license | \bgnu lesser general public license,? (either )?(version|v\.?) ?2\.1
3 | LGPL-2.0 | library general public license | \bgnu library general public license,? (either )?(version|v\.?) ?2(\.0)?
3 | LGPL-3.0 | lgplv3 | \blgplv3\+?
3 | LGPL-2.1 | lgplv2.1 | \blgplv2\.1\+?
3 | LGPL-2.1 | lgpl-2.1 | \blgpl-2\.1
3 | LGPL-3.0 | lgpl-3 | \blgpl-3(\.0)?
3 | AGPL-3.0 | affero general public license | \bgnu affero general public license,? (either )?(version|v\.?) ?3(\.0)?
3 | AGPL-3.0 | agplv3 | \bagplv3\+?
3 | AGPL-3.0 | agpl-3 | \bagpl-3(\.0)?
3 | GFDL-1.3 | free documentation license | \bgnu free documentation license,? version 1\.3
3 | GFDL-1.2 | free documentation license | \bgnu free documentation license,? version 1\.2
3 | MPL-2.0 | mozilla public license | \bmozilla public license,? (version|v\.?) ?2(\.0)?
3 | MPL-1.1 | mozilla public license | \bmozilla public license,? (version|v\.?) ?1\.1
3 | MPL-1.0 | mozilla public license | \bmozilla public license,? (version|v\.?) ?1\.0
3 | MPL-2.0 | mpl-2 | \bmpl-2(\.0)?
3 | MPL-2.0 | mpl 2 | \bmpl 2(\.0)?
3 | EPL-2.0 | eclipse public license | \beclipse public license (- )?,?(version|v\.?)? ?2(\.0)?
3 | EPL-1.0 | eclipse public license | \beclipse public license (- )?,?(version|v\.?)? ?1(\.0)?
3 | CPL-1.0 | common public license | \bcommon public license,? (version|v\.?) ?1\.0
3 | CDDL-1.0 | common development and distribution | \bcommon development and distribution license,? (\(cddl\) )?(version|v\.?) ?1\.0
3 | EUPL-1.2 | european union public | \beuropean union public licen[cs]e,? (version|v\.?) ?1\.2
3 | EUPL-1.1 | european union public | \beuropean union public licen[cs]e,? (version|v\.?) ?1\.1
3 | Artistic-2.0 | artistic license | \bartistic license,? (version |v\.?)?2(\.0)?
3 | Artistic-1.0 | artistic license | \bartistic license,? (version |v\.?)?1(\.0)?
3 | AFL-3.0 | academic free license | \bacademic free license,? (version|v\.?) ?3\.0
3 | OSL-3.0 | open software license | \bopen software license,? (version|v\.?) ?3\.0
3 | QPL-1.0 | q public license | \bq public license,? version 1\.0
3 | BSL-1.0 | boost software license | \bboost software license,? (-,? )?version 1\.0
3 | BUSL-1.1 | business source license | \bbusiness source license,? (version )?1\.1
3 | SSPL-1.0 | server side public license | \bserver side public license,? (version|v\.?) ?1
3 | Elastic-2.0 | elastic license | \belastic license,? (version )?2\.0
3 | PolyForm | polyform | \bpolyform (noncommercial|small business|shield|strict) license 1\.0\.0
3 | OFL-1.1 | open font license | \bsil open font license,? (version|v\.?) ?1\.1
3 | BSD-2-Clause | bsd | \b(bsd[- ]2[- ]clause|2[- ]clause bsd|two[- ]clause bsd|simplified bsd)( licen[cs]e)?
3 | BSD-3-Clause | bsd | \b(bsd[- ]3[- ]clause|3[- ]clause bsd|three[- ]clause bsd|new bsd|modified bsd|revised bsd)( licen[cs]e)?
3 | BSD-4-Clause | bsd | \b(bsd[- ]4[- ]clause|4[- ]clause bsd|original bsd)( licen[cs]e)?
3 | 0BSD | zero-clause | \bzero-clause bsd( licen[cs]e)?
3 | CC-BY-NC-ND-4.0 | nc-nd | \bcc[- ]by-nc-nd[- ]4\.0
3 | CC-BY-NC-ND-3.0 | nc-nd | \bcc[- ]by-nc-nd[- ]3\.0
3 | CC-BY-NC-SA-4.0 | nc-sa | \bcc[- ]by-nc-sa[- ]4\.0
3 | CC-BY-NC-SA-3.0 | nc-sa | \bcc[- ]by-nc-sa[- ]3\.0
3 | CC-BY-NC-4.0 | by-nc | \bcc[- ]by-nc[- ]4\.0
3 | CC-BY-NC-3.0 | by-nc | \bcc[- ]by-nc[- ]3\.0
3 | CC-BY-ND-4.0 | by-nd | \bcc[- ]by-nd[- ]4\.0
3 | CC-BY-SA-4.0 | by-sa | \bcc[- ]by-sa[- ]4\.0
3 | CC-BY-SA-3.0 | by-sa | \bcc[- ]by-sa[- ]3\.0
3 | CC-BY-SA-2.5 | by-sa | \bcc[- ]by-sa[- ]2\.5
3 | CC-BY-4.0 | cc by | \bcc by 4\.0
3 | CC-BY-3.0 | cc by | \bcc by 3\.0
3 | CC-BY-4.0 | cc-by | \bcc-by[- ]4\.0
3 | CC-BY-3.0 | cc-by | \bcc-by[- ]3\.0
3 | CC0-1.0 | cc0 | \bcc0([- ]1\.0)?( universal)?
3 | CC-BY-NC-ND-4.0 | creative commons | \bcreative commons attribution[- ]non-?commercial[- ]no-?deriv(ative|s|atives)( works)? 4\.0
3 | CC-BY-NC-SA-4.0 | creative commons | \bcreative commons attribution[- ]non-?commercial[- ]share-?alike 4\.0
3 | CC-BY-NC-4.0 | creative commons | \bcreative commons attribution[- ]non-?commercial 4\.0
3 | CC-BY-SA-4.0 | creative commons | \bcreative commons attribution[- ]share-?alike 4\.0
3 | CC-BY-SA-3.0 | creative commons | \bcreative commons attribution[- ]share-?alike 3\.0
3 | CC-BY-4.0 | creative commons | \bcreative commons attribution 4\.0
3 | CC-BY-3.0 | creative commons | \bcreative commons attribution 3\.0
3 | ODbL-1.0 | open database license | \bopen database license( v?1\.0)?
3 | ODC-By-1.0 | open data commons attribution | \bopen data commons attribution licen[cs]e( v?1\.0)?
3 | PDDL-1.0 | public domain dedication and license | \bpublic domain dedication and licen[cs]e( v?1\.0)?
3 | CDLA-Permissive-2.0 | community data license | \bcommunity data license agreement.{0,6}permissive.{0,12}2\.0
3 | CDLA-Sharing-1.0 | community data license | \bcommunity data license agreement.{0,6}sharing.{0,12}1\.0
3 | OGL-UK-3.0 | open government licen | \bopen government licen[cs]e v?3\.0
3 | OGL-UK-2.0 | open government licen | \bopen government licen[cs]e v?2\.0
3 | MulanPSL-2.0 | mulan | \bmulan p(ermissive software licen[cs]e|sl),? v(ersion )?2
3 | MS-PL | microsoft public license | \bmicrosoft public license( \(ms-pl\))?
3 | MS-RL | microsoft reciprocal license | \bmicrosoft reciprocal license( \(ms-rl\))?
3 | CeCILL-2.1 | cecill | \bcecill[- ](v?2\.1)
3 | CeCILL-B | cecill-b | \bcecill-b\b
3 | CeCILL-C | cecill-c | \bcecill-c\b
3 | OpenRAIL | openrail | \b(bigscience |creativeml )?open ?rail(\+\+)?(-m)?( licen[cs]e)?
3 | Llama-2 | llama 2 community | \bllama 2 community license( agreement)?
3 | Llama-3 | llama 3 community | \b(meta )?llama 3 community license( agreement)?
3 | Gemma | gemma terms | \bgemma terms of use
4 | MIT | opensource.org/licenses/mit | (https?://)?(www\.)?opensource\.org/licenses/mit(-license)?(\.php|\.html)?
4 | BSD-3-Clause | opensource.org/licenses/bsd-3 | (https?://)?(www\.)?opensource\.org/licenses/bsd-3-clause
4 | BSD-2-Clause | opensource.org/licenses/bsd-2 | (https?://)?(www\.)?opensource\.org/licenses/bsd-2-clause
4 | ISC | opensource.org/licenses/isc | (https?://)?(www\.)?opensource\.org/licenses/isc
4 | Apache-2.0 | apache.org/licenses/license-2.0 | (https?://)?(www\.)?apache\.org/licenses/license-2\.0(\.txt|\.html)?
4 | GPL-3.0 | gnu.org/licenses/gpl-3 | (https?://)?(www\.)?gnu\.org/licenses/gpl-3\.0(\.txt|\.html)?
4 | GPL-2.0 | gnu.org/licenses/old-licenses/gpl-2 | (https?://)?(www\.)?gnu\.org/licenses/old-licenses/gpl-2\.0(\.txt|\.html)?
4 | LGPL-3.0 | gnu.org/licenses/lgpl-3 | (https?://)?(www\.)?gnu\.org/licenses/lgpl-3\.0
4 | LGPL-2.1 | old-licenses/lgpl-2.1 | (https?://)?(www\.)?gnu\.org/licenses/old-licenses/lgpl-2\.1
4 | AGPL-3.0 | gnu.org/licenses/agpl-3 | (https?://)?(www\.)?gnu\.org/licenses/agpl-3\.0
4 | GPL | gnu.org/licenses | (https?://)?(www\.)?gnu\.org/licenses/?(?![\w/])
4 | MPL-2.0 | mozilla.org/mpl/2.0 | (https?://)?(www\.)?mozilla\.org/mpl/2\.0
4 | EPL-2.0 | eclipse.org/legal/epl-2 | (https?://)?(www\.)?eclipse\.org/legal/epl-2\.0
4 | EPL-1.0 | eclipse.org/legal/epl-v10 | (https?://)?(www\.)?eclipse\.org/legal/epl-v10
4 | BSL-1.0 | boost.org/license_1_0 | (https?://)?(www\.)?boost\.org/license_1_0\.txt
4 | Unlicense | unlicense.org | (https?://)?(www\.)?unlicense\.org
4 | OFL-1.1 | scripts.sil.org/ofl | (https?://)?scripts\.sil\.org/ofl
4 | CC0-1.0 | publicdomain/zero/1.0 | (https?://)?creativecommons\.org/publicdomain/zero/1\.0
4 | CC-PDM-1.0 | publicdomain/mark/1.0 | (https?://)?creativecommons\.org/publicdomain/mark/1\.0
4 | CC-BY-4.0 | licenses/by/4.0 | (https?://)?creativecommons\.org/licenses/by/4\.0
4 | CC-BY-3.0 | licenses/by/3.0 | (https?://)?creativecommons\.org/licenses/by/3\.0
4 | CC-BY-SA-4.0 | licenses/by-sa/4.0 | (https?://)?creativecommons\.org/licenses/by-sa/4\.0
4 | CC-BY-SA-3.0 | licenses/by-sa/3.0 | (https?://)?creativecommons\.org/licenses/by-sa/3\.0
4 | CC-BY-NC-4.0 | licenses/by-nc/4.0 | (https?://)?creativecommons\.org/licenses/by-nc/4\.0
4 | CC-BY-ND-4.0 | licenses/by-nd/4.0 | (https?://)?creativecommons\.org/licenses/by-nd/4\.0
4 | CC-BY-NC-SA-4.0 | licenses/by-nc-sa/4.0 | (https?://)?creativecommons\.org/licenses/by-nc-sa/4\.0
4 | CC-BY-NC-ND-4.0 | licenses/by-nc-nd/4.0 | (https?://)?creativecommons\.org/licenses/by-nc-nd/4\.0
4 | ODbL-1.0 | opendatacommons.org/licenses/odbl | (https?://)?opendatacommons\.org/licenses/odbl
5 | MIT | mit license | \bmit licen[cs]e\b
5 | MIT | mit-license | \bmit-licen[cs]ed?\b
5 | MIT | mit/x11 | \bmit/x11( licen[cs]e)?
5 | MIT | expat license | \bexpat licen[cs]e
5 | X11 | x11 license | \bx11 licen[cs]e
5 | ISC | isc license | \bisc licen[cs]e
5 | Zlib | zlib license | \bzlib(/libpng)? licen[cs]e
5 | Zlib | zlib/libpng | \bzlib/libpng licen[cs]e
5 | NCSA | ncsa open source | \b(university of illinois/)?ncsa open source license
5 | PostgreSQL | postgresql license | \bpostgresql licen[cs]e
5 | PSF-2.0 | python software foundation license | \bpython software foundation license
5 | PHP-3.01 | php license | \bphp license(,? version 3\.01)?
5 | Ruby | ruby license | \bruby('s)? licen[cs]e
5 | Vim | vim license | \bvim licen[cs]e
5 | curl | curl license | \bcurl licen[cs]e
5 | OpenSSL | openssl license | \bopenssl licen[cs]e
5 | W3C | w3c software | \bw3c software (notice and )?licen[cs]e
5 | Unicode | unicode license | \bunicode(, inc\.)? licen[cs]e( agreement)?
5 | ICU | icu license | \bicu licen[cs]e
5 | WTFPL | wtfpl | \bwtfpl\b
5 | Unlicense | the unlicense | \bthe unlicense\b
5 | JSON | json license | \bjson licen[cs]e
5 | UPL-1.0 | universal permissive license | \buniversal permissive license
5 | Sleepycat | sleepycat license | \bsleepycat licen[cs]e
5 | TeX | latex project public license | \blatex project public license(,? version 1\.3c?)?
5 | Perl | same terms as perl | \b(under )?the same terms as perl( itself)?
5 | IPL-1.0 | ibm public license | \bibm public license
5 | APSL-2.0 | apple public source license | \bapple public source license
5 | SISSL | sun industry standards | \bsun industry standards source license
5 | Commons-Clause | commons clause | \bcommons clause( license condition)?
5 | Hippocratic | hippocratic license | \bhippocratic license
6 | GPL | gnu general public license | \bgnu general public licen[cs]e
6 | GPL | gnu gpl | \bgnu gpl\b
6 | LGPL | lesser general public license | \b(gnu )?lesser general public licen[cs]e
6 | LGPL | gnu lgpl | \bgnu lgpl\b
6 | AGPL | affero general public license | \b(gnu )?affero general public licen[cs]e
6 | AGPL | gnu agpl | \bgnu agpl\b
6 | GFDL | free documentation license | \b(gnu )?free documentation license
6 | Apache | apache license | \bapache licen[cs]e
6 | BSD | bsd license | \bbsd(-style)? licen[cs]e
6 | BSD | bsd-style license | \bbsd-style licen[cs]e
6 | MPL | mozilla public license | \bmozilla public licen[cs]e
6 | EPL | eclipse public license | \beclipse public licen[cs]e
6 | Artistic | artistic license | \b(perl )?artistic licen[cs]e
6 | CC | creative commons | \bcreative commons( attribution)?( licen[cs]e)?
6 | Public-Domain | public domain | \b(released into|dedicated to|placed in|in) the public domain\b
6 | EULA | end user license agreement | \bend[- ]user licen[cs]e agreement
6 | EULA | end-user license agreement | \bend-user licen[cs]e agreement
7 | Copyright | copyright | \bcopyright (\(c\)|©)? ?(\d{4}([-–,] ?\d{4})*)
7 | Copyright | all rights reserved | \ball rights reserved\b
7 | Copyright | © | © ?\d{4}
7 | Unknown | licensed under | \b(dual[- ])?licensed under (the )?(terms of )?[^\s.,;]{1,40}
7 | Unknown | released under | \breleased under (the )?(terms of )?[^\s.,;]{1,40}( licen[cs]e)?
7 | Unknown | distributed under | \bdistributed under (the )?(terms of )?[^\s.,;]{1,40} licen[cs]e
7 | Unknown | license agreement | \blicen[cs]e agreement\b
7 | Unknown | subject to the license | \bsubject to the licen[cs]e
7 | Unknown | see license | \bsee (the )?licen[cs]e(\.txt|\.md| file)?
"""
