"""Notices of licenses written by hand, beside the names and versions that ``licenses`` makes by rule.

A row is (label, priority, keyword, pattern); ``licenses.Signature`` says how they are matched.
"""

from __future__ import annotations

TEXT, VERSIONED, NAME, HINT = 1, 2, 3, 4

# Sentences and names that published licenses and the notices of their users carry.
PERMISSIVE = (
    ("mit", TEXT, "this permission notice shall be included", "(?:the above copyright notice and )?this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", HINT, "dealings in the software", "(?:use or other )?dealings in the software"),
    ("mit", HINT, "to deal in the software without restriction", "to deal in the software without restriction"),
    ("mit", NAME, "mit style licen", "mit style licen[cs]e"),
    ("mit", NAME, "released under the mit", "released under the mit(?: licen[cs]e)?"),
    ("mit", NAME, "distributed under the mit", "distributed under the mit(?: licen[cs]e)?"),
    ("mit", NAME, "opensource org licenses mit", "opensource org licenses mit"),
    ("mit-0", VERSIONED, "mit no attribution", "mit no attribution(?: licen[cs]e)?"),
    ("mit-0", VERSIONED, "mit 0 licen", "mit 0 licen[cs]e"),
    ("x11", TEXT, "shall not be used in advertising or otherwise", "the name of (?:\\S+ ){1,12}shall not be used in advertising or otherwise to promote the sale"),
    ("x11", NAME, "x11 licen", "(?:mit )?x11 licen[cs]e"),
    ("x11", NAME, "x consortium licen", "x consortium licen[cs]e"),
    ("hpnd", TEXT, "for any purpose and without fee is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd", HINT, "supporting documentation", "that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("hpnd", NAME, "historical permission notice and disclaimer", "historical permission notice and disclaimer"),
    ("ntp", TEXT, "for any purpose with or without fee is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("ntp", NAME, "ntp licen", "ntp licen[cs]e"),
    ("isc", TEXT, "provided that the above copyright notice and this permission notice appear in all copies", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", NAME, "opensource org licenses isc", "opensource org licenses isc(?: licen[cs]e)?"),
    ("0bsd", TEXT, "for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", TEXT, "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", TEXT, "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", HINT, "provided by the copyright holders and contributors as is", "this software is provided by the copyright holders and contributors as is"),
    ("bsd", HINT, "provided by the regents and contributors as is", "this software is provided by the regents and contributors as is"),
    ("bsd", NAME, "bsd style licen", "bsd style licen[cs]e that can be found in the licen[cs]e file"),
    ("bsd", NAME, "released under the bsd", "released under the bsd(?: licen[cs]e)?"),
    ("bsd-2-patent", VERSIONED, "bsd 2 clause plus patent", "bsd 2 clause plus patent(?: licen[cs]e)?"),
    ("bsd-3-clear", VERSIONED, "clear bsd licen", "(?:the )?clear bsd licen[cs]e"),
    ("bsd-3-lbnl", VERSIONED, "lawrence berkeley national lab", "lawrence berkeley national labs? bsd(?: variant)? licen[cs]e"),
    ("bsd-4", HINT, "this product includes software developed by", "this product includes software developed by (?:\\S+ ){0,6}(?:university|contributors)"),
    ("apache-2", TEXT, "except in compliance with the licen", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2", TEXT, "agreed to in writing software distributed under", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache-2", VERSIONED, "apache org licenses licen", "apache org licenses licen[cs]e 2 0(?: txt| html)?"),
    ("apache-2", TEXT, "apache software foundation asf under one or more", "licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache-1.1", TEXT, "developed by the apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-2", VERSIONED, "asl 2 0", "asl 2 0"),
    ("apache-2-llvm", VERSIONED, "with llvm exceptions", "apache licen[cs]e (?:v|version )?2 0 with llvm exceptions"),
    ("zlib", TEXT, "origin of this software must not be misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", HINT, "in no event will the authors be held liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("libpng", NAME, "libpng licen", "libpng licen[cs]e(?: version 2)?"),
    ("boost", TEXT, "obtaining a copy of the software and accompanying documentation covered", "obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("boost", VERSIONED, "boost org licen", "boost org licen[cs]e 1 0 txt"),
    ("curl", NAME, "curl licen", "curl licen[cs]e"),
    ("openssl", TEXT, "openssl project for use in the openssl toolkit", "developed by the openssl project for use in the openssl toolkit"),
    ("openssl", NAME, "openssl", "(?:dual )?openssl(?: and ssleay)? licen[cs]e"),
    ("ssleay", TEXT, "cryptographic software written by eric young", "this product includes cryptographic software written by eric young"),
    ("php", TEXT, "this product includes php", "this product includes php(?: software)? freely available from"),
    ("php", VERSIONED, "php licen", "php licen[cs]e (?:version |v )?3 0(?:1)?"),
    ("ruby", NAME, "ruby licen", "ruby licen[cs]e"),
    ("ruby", NAME, "same terms as ruby", "(?:under the )?same terms as ruby(?: itself)?"),
    ("perl", NAME, "same terms as perl itself", "(?:under the )?same terms as perl itself"),
    ("python", TEXT, "psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e"),
    ("python", NAME, "psf licen", "psf licen[cs]e(?: agreement)?(?: for python)?"),
    ("postgresql", NAME, "postgresql licen", "postgresql licen[cs]e"),
    ("icu", NAME, "icu licen", "icu licen[cs]e"),
    ("unicode", TEXT, "copy of the unicode data files", "obtaining a copy of the unicode data files"),
    ("unicode", NAME, "unicode licen", "unicode licen[cs]e(?: v3| agreement)?"),
    ("w3c", NAME, "w3c software", "w3c software(?: notice)?(?: and document)?(?: notice and)? licen[cs]e"),
    ("tcl", NAME, "tcl tk licen", "tcl tk licen[cs]e"),
    ("ncsa", NAME, "ncsa open source licen", "(?:university of illinois )?ncsa open source licen[cs]e"),
    ("ncsa", TEXT, "to deal with the software without restriction", "to deal with the software without restriction"),
    ("afl", TEXT, "licensed under the academic free", "licensed under the academic free licen[cs]e version \\d"),
    ("upl", VERSIONED, "universal permissive licen", "universal permissive licen[cs]e(?: v 1 0| v1 0)?"),
    ("bluoak", VERSIONED, "blue oak model licen", "blue oak model licen[cs]e(?: 1 0 0)?"),
    ("mulan", VERSIONED, "mulan p", "mulan p(?:sl|ermissive software licen[cs]e)(?: v2| v1)?"),
    ("ms-pl", NAME, "microsoft public licen", "microsoft public licen[cs]e(?: ms pl)?"),
    ("vim", NAME, "vim licen", "vim licen[cs]e"),
    ("ftl", NAME, "freetype", "(?:the )?freetype (?:project )?licen[cs]e"),
    ("ijg", TEXT, "independent jpeg group", "based in part on the work of the independent jpeg group"),
    ("bzip2", NAME, "bzip2 licen", "bzip2 licen[cs]e"),
    ("json", TEXT, "shall be used for good not evil", "the software shall be used for good not evil"),
    ("beerware", TEXT, "beer ware licen", "the beer ware licen[cs]e(?: revision 42)?"),
    ("beerware", TEXT, "you can buy me a beer", "you can buy me a beer in return"),
    ("wtfpl", TEXT, "do what the fuck you want to", "do what the fuck you want to(?: public licen[cs]e)?"),
    ("fsfap", TEXT, "are permitted in any medium without royalty", "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsful", TEXT, "gives unlimited permission to copy and or distribute it", "the free software foundation gives unlimited permission to copy and or distribute it"),
    ("unlicense", TEXT, "for any purpose commercial or non commercial and by any means", "for any purpose commercial or non commercial and by any means"),
    ("unlicense", NAME, "unlicense org", "unlicense org"),
)
RECIPROCAL = (
    ("gpl", TEXT, "this program is free software", "this program is free software you can redistribute it and or modify it"),
    ("gpl", TEXT, "received a copy of the gnu general public licen", "you should have received a copy of the gnu general public licen[cs]e"),
    ("gpl", HINT, "gnu org licen", "gnu org licen[cs]es? gpl"),
    ("gpl", HINT, "comes with absolutely no warranty", "comes with absolutely no warranty"),
    ("gpl", HINT, "without even the implied warranty of merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", HINT, "but changing it is not allowed", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed"),
    ("gpl-2-or-later", TEXT, "either version 2 of the licen", "either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3-or-later", TEXT, "either version 3 of the licen", "either version 3 of the licen[cs]e or at your option any later version"),
    ("gpl-exception", TEXT, "as a special exception the copyright holder", "as a special exception the copyright holders?(?: of this library)? gives? you permission to link"),
    ("gpl-exception", NAME, "classpath exception", "(?:gnu )?classpath exception(?: 2 0)?"),
    ("gpl-exception", NAME, "gcc runtime library exception", "gcc runtime library exception(?: version 3 1)?"),
    ("gpl-exception", NAME, "font exception", "gpl (?:\\S+ ){0,3}font exception"),
    ("gpl-exception", NAME, "linking exception", "(?:gpl|lgpl) (?:\\S+ ){0,3}linking exception"),
    ("lgpl", TEXT, "this library is free software", "this library is free software you can redistribute it and or modify it"),
    ("lgpl", TEXT, "received a copy of the gnu lesser general public licen", "you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("lgpl", TEXT, "received a copy of the gnu library general public licen", "you should have received a copy of the gnu library general public licen[cs]e"),
    ("lgpl", HINT, "gnu org licen", "gnu org licen[cs]es? lgpl"),
    ("lgpl-2.1-or-later", TEXT, "either version 2 1 of the licen", "either version 2 1 of the licen[cs]e or at your option any later version"),
    ("agpl", TEXT, "received a copy of the gnu affero general public licen", "you should have received a copy of the gnu affero general public licen[cs]e"),
    ("agpl", HINT, "gnu org licen", "gnu org licen[cs]es? agpl"),
    ("agpl", HINT, "interacting with it remotely through a computer network", "users interacting with it remotely through a computer network"),
    ("gfdl", TEXT, "under the terms of the gnu free documentation licen", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl", HINT, "invariant sections", "with no invariant sections(?: no front cover texts and no back cover texts)?"),
    ("mpl", TEXT, "incompatible with secondary licen", "this source code form is incompatible with secondary licen[cs]es"),
    ("mpl", HINT, "mozilla org mpl", "mozilla org mpl(?: 2 0)?"),
    ("mpl-1.1", TEXT, "contents of this file are subject to the mozilla public licen", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("npl", NAME, "netscape public licen", "netscape public licen[cs]e(?: version 1 [01])?"),
    ("epl", TEXT, "accompanying materials are made available under the terms of", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("epl", HINT, "eclipse org legal epl", "eclipse org legal epl(?: v10| 2 0| v20)?(?: html)?"),
    ("edl", VERSIONED, "eclipse distribution licen", "eclipse distribution licen[cs]e(?: v 1 0| v1 0)?"),
    ("cddl", TEXT, "subject to the terms of the common development and distribution", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cecill", NAME, "cecill", "cecill(?: b| c)?(?: licen[cs]e)?"),
    ("cecill", TEXT, "under french law and abiding by the rules", "governed by the cecill(?: b| c)? licen[cs]e under french law and abiding by the rules of distribution of free software"),
    ("eupl", TEXT, "licensed under the eupl", "licensed under the eupl(?: version 1 [012])?"),
    ("osl", TEXT, "licensed under the open software licen", "licensed under the open software licen[cs]e version \\d"),
    ("ms-rl", NAME, "microsoft reciprocal licen", "microsoft reciprocal licen[cs]e(?: ms rl)?"),
    ("rpl", NAME, "reciprocal public licen", "reciprocal public licen[cs]e(?: 1 [15])?"),
    ("qpl", NAME, "q public licen", "(?:the )?q public licen[cs]e(?: version 1 0)?"),
    ("ipl", NAME, "ibm public licen", "ibm public licen[cs]e(?: version 1 0)?"),
    ("apsl", NAME, "apple public source licen", "apple public source licen[cs]e(?: version 2 0)?"),
    ("spl", NAME, "sun public licen", "sun public licen[cs]e(?: version 1 0)?"),
    ("lpl", NAME, "lucent public licen", "lucent public licen[cs]e(?: version 1 0[2]?)?"),
    ("nosa", NAME, "nasa open source agreement", "nasa open source agreement(?: version 1 3)?"),
    ("sleepycat", NAME, "sleepycat licen", "sleepycat licen[cs]e"),
    ("lppl", NAME, "latex project public licen", "latex project public licen[cs]e(?: version 1 (?:0|1|2|3|3a|3c))?"),
    ("cpal", NAME, "common public attribution licen", "common public attribution licen[cs]e(?: version 1 0)?"),
    ("sspl", NAME, "server side public licen", "server side public licen[cs]e(?: version 1| v 1)?"),
    ("artistic", TEXT, "the intent of this document is to state the conditions under which a package may be copied", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", NAME, "clarified artistic licen", "clarified artistic licen[cs]e"),
    ("watcom", NAME, "sybase open watcom public licen", "sybase open watcom public licen[cs]e(?: version 1 0)?"),
    ("osl", HINT, "opensource org licenses osl", "opensource org licenses osl"),
    ("ofl", TEXT, "licensed under the sil open font licen", "this font software is licensed under the sil open font licen[cs]e"),
    ("ofl", HINT, "reserved font name", "with reserved font name"),
    ("ofl", HINT, "scripts sil org ofl", "scripts sil org ofl"),
)
CONTENT = (
    ("cc", TEXT, "licensed under a creative commons", "licensed under a creative commons(?: \\S+){1,6} licen[cs]e"),
    ("cc-by", HINT, "creativecommons org licen", "creativecommons org licen[cs]es by"),
    ("cc-by-sa", NAME, "creativecommons org licen", "creativecommons org licen[cs]es by sa(?: \\d \\d)?"),
    ("cc-by-nc", NAME, "creativecommons org licen", "creativecommons org licen[cs]es by nc(?: \\d \\d)?"),
    ("cc-by-nd", NAME, "creativecommons org licen", "creativecommons org licen[cs]es by nd(?: \\d \\d)?"),
    ("cc-by-nc-sa", NAME, "creativecommons org licen", "creativecommons org licen[cs]es by nc sa(?: \\d \\d)?"),
    ("cc-by-nc-nd", NAME, "creativecommons org licen", "creativecommons org licen[cs]es by nc nd(?: \\d \\d)?"),
    ("cc0", NAME, "creativecommons org publicdomain zero", "creativecommons org publicdomain zero(?: 1 0)?"),
    ("cc0", TEXT, "waived all copyright and related", "waived all copyright and related or neighboring rights"),
    ("public-domain", NAME, "creativecommons org publicdomain mark", "creativecommons org publicdomain mark(?: 1 0)?"),
    ("public-domain", TEXT, "dedicate any and all copyright interest", "dedicate any and all copyright interest in the software to the public domain"),
    ("public-domain", NAME, "no copyright is claimed", "no copyright is claimed"),
    ("public-domain", NAME, "no known copyright restrictions", "no known copyright restrictions"),
    ("public-domain", NAME, "not subject to copyright protection", "not subject to copyright protection(?: and is in the public domain)?"),
    ("public-domain", NAME, "work of the united states government", "(?:is )?a work of the united states government"),
    ("gutenberg", TEXT, "under the terms of the project gutenberg licen", "you may copy it give it away or re use it under the terms of the project gutenberg licen[cs]e"),
    ("gutenberg", NAME, "project gutenberg licen", "(?:full )?project gutenberg licen[cs]e"),
    ("pddl", NAME, "public domain dedication and licen", "(?:open data commons )?public domain dedication and licen[cs]e"),
    ("odc-by", NAME, "open data commons attribution licen", "open data commons attribution licen[cs]e(?: v1 0)?"),
    ("cdla", NAME, "community data licen", "community data licen[cs]e agreement (?:permissive|sharing)(?: \\d \\d)?"),
    ("ogl", NAME, "open government licen", "open government licen[cs]e(?: v?[123] 0)?"),
    ("ogl", TEXT, "contains public sector information licen", "contains public sector information licen[cs]ed under the open government licen[cs]e"),
    ("crown", NAME, "crown copyright", "crown copyright"),
    ("fal", NAME, "free art licen", "free art licen[cs]e(?: 1 [23])?"),
    ("opl", NAME, "open publication licen", "open publication licen[cs]e(?: v 1 0)?"),
    ("ogl-game", NAME, "open game licen", "open game licen[cs]e(?: version 1 0a)?"),
    ("openrail", NAME, "openrail", "(?:creativeml |bigscience )?openrail m?(?: licen[cs]e)?"),
    ("rail", NAME, "responsible ai licen", "(?:bigscience )?responsible ai licen[cs]e"),
    ("fair-use", HINT, "fair use", "fair use (?:notice|doctrine)"),
    ("reserved", NAME, "tutti i diritti riservati", "tutti i diritti riservati"),
    ("reserved", NAME, "todos os direitos reservados", "todos os direitos reservados"),
    ("reserved", NAME, "alle rechten voorbehouden", "alle rechten voorbehouden"),
    ("reserved", NAME, "no rights reserved", "no rights reserved"),
)
RESTRICTED = (
    ("proprietary", NAME, "trade secret", "(?:confidential|proprietary) (?:\\S+ ){0,4}trade secrets?"),
    ("proprietary", NAME, "company confidential", "company confidential"),
    ("proprietary", NAME, "strictly confidential", "strictly confidential"),
    ("proprietary", TEXT, "end user licen", "end user licen[cs]e agreement"),
    ("proprietary", NAME, "this software is licensed not sold", "this software is licensed not sold"),
    ("proprietary", HINT, "prior written", "without (?:the )?prior written (?:permission|consent)"),
    ("proprietary", HINT, "express written", "without (?:the )?express written (?:permission|consent)"),
    ("proprietary", HINT, "reverse engineer", "(?:may|shall|must) not (?:\\S+ ){0,8}reverse engineer"),
    ("proprietary", HINT, "terms of use", "(?:subject to|governed by) (?:our|the|these) terms of use"),
    ("non-commercial", NAME, "commercial use only", "(?:for )?non ?commercial use only"),
    ("non-commercial", NAME, "commercial use is prohibited", "commercial use is prohibited"),
    ("non-commercial", NAME, "commercial purposes only", "(?:for )?non ?commercial purposes only"),
    ("non-commercial", NAME, "personal use only", "(?:for )?(?:your )?personal use only"),
    ("non-commercial", NAME, "prosperity public licen", "prosperity public licen[cs]e(?: 3 0 0)?"),
    ("non-commercial", NAME, "polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter) licen[cs]e(?: 1 0 [01])?"),
    ("research-only", NAME, "research purposes only", "(?:for )?(?:academic |educational |internal )?research purposes only"),
    ("research-only", NAME, "for research use only", "for research use only"),
    ("evaluation", NAME, "evaluation purposes only", "(?:for )?evaluation purposes only"),
    ("commons-clause", TEXT, "commons clause", "commons clause(?: licen[cs]e)? condition"),
    ("elastic", NAME, "elastic licen", "elastic licen[cs]e(?: 2 0| v2)?"),
    ("confluent", NAME, "confluent community licen", "confluent community licen[cs]e(?: version 1 0)?"),
    ("redis", NAME, "redis source available licen", "redis source available licen[cs]e"),
    ("fsl", NAME, "functional source licen", "functional source licen[cs]e(?: version 1 [01])?"),
    ("hippocratic", NAME, "hippocratic licen", "hippocratic licen[cs]e(?: version 2 1| 3 0)?"),
    ("shareware", NAME, "shareware", "(?:this is|distributed as) shareware"),
    ("freeware", NAME, "freeware", "(?:this is|distributed as) freeware"),
    ("dual", HINT, "dual licen", "dual licen[cs]ed(?: under)?"),
    ("license", HINT, "see the licen", "see the licen[cs]e(?: file)? for (?:details|more information|the specific language)"),
    ("license", HINT, "released under the", "released under the terms of the \\S+"),
    ("license", HINT, "in the licen", "(?:found|available) in the licen[cs]e(?: txt| md)? file"),
)
NOTICES = PERMISSIVE + RECIPROCAL + CONTENT + RESTRICTED
