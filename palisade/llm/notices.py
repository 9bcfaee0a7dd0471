"""Licence rules written by hand: notices at the head of files, words of licences' own texts, terms, exceptions and lesser-known licences.

Each is (label, keyword, pattern) on normalised words, in which a + after a number reads "plus".
"""

from __future__ import annotations

#: Notices of the usual form, with their versions.
HEADERS = (
    ("gpl-1.0-or-later", "published by", "gnu general public licen[sc]e as published by the free software foundation (?:either )?version 1(?: 0)? (?:of the licen[sc]e )?or (?:at your option )?any later version"),
    ("gpl-2.0-or-later", "published by", "gnu general public licen[sc]e as published by the free software foundation (?:either )?version 2(?: 0)? (?:of the licen[sc]e )?or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", "published by", "gnu general public licen[sc]e as published by the free software foundation (?:either )?version 3(?: 0)? (?:of the licen[sc]e )?or (?:at your option )?any later version"),
    ("gpl-2.0", "published by", "gnu general public licen[sc]e as published by the free software foundation (?:under )?version 2(?: 0)?(?: of the licen[sc]e)?"),
    ("gpl-3.0", "published by", "gnu general public licen[sc]e as published by the free software foundation (?:under )?version 3(?: 0)?(?: of the licen[sc]e)?"),
    ("gpl-2.0-only", "published by", "gnu general public licen[sc]e version 2 only as published by the free software foundation"),
    ("lgpl-2.0-or-later", "published by", "gnu (?:library|lesser) general public licen[sc]e as published by the free software foundation (?:either )?version 2(?: 0)? (?:of the licen[sc]e )?or (?:at your option )?any later version"),
    ("lgpl-2.1-or-later", "published by", "gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 2 1 (?:of the licen[sc]e )?or (?:at your option )?any later version"),
    ("lgpl-3.0-or-later", "published by", "gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 3(?: 0)? (?:of the licen[sc]e )?or (?:at your option )?any later version"),
    ("lgpl-2.1", "published by", "gnu lesser general public licen[sc]e as published by the free software foundation (?:under )?version 2 1(?: of the licen[sc]e)?"),
    ("lgpl-3.0", "published by", "gnu lesser general public licen[sc]e as published by the free software foundation (?:under )?version 3(?: 0)?(?: of the licen[sc]e)?"),
    ("agpl-3.0-or-later", "published by", "gnu affero general public licen[sc]e as published by the free software foundation (?:either )?version 3(?: 0)? (?:of the licen[sc]e )?or (?:at your option )?any later version"),
    ("agpl-3.0", "published by", "gnu affero general public licen[sc]e as published by the free software foundation (?:under )?version 3(?: 0)?(?: of the licen[sc]e)?"),
    ("gfdl-1.1-or-later", "documentation", "gnu free documentation licen[sc]e version 1 1 or any later version published by the free software foundation"),
    ("gfdl-1.2-or-later", "documentation", "gnu free documentation licen[sc]e version 1 2 or any later version published by the free software foundation"),
    ("gfdl-1.3-or-later", "documentation", "gnu free documentation licen[sc]e version 1 3 or any later version published by the free software foundation"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("npl-1.1", "netscape", "the contents of this file are subject to the netscape public licen[sc]e version 1 1"),
    ("cddl-1.0", "distribution", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("epl-1.0", "eclipse", "accompanying materials are made available under the terms of the eclipse public licen[sc]e v ?1 0"),
    ("epl-2.0", "eclipse", "accompanying materials are made available under the terms of the eclipse public licen[sc]e v?(?:ersion)? ?2 0"),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font licen[sc]e version 1 1"),
    ("perl", "perl", "under the same terms as perl itself"),
)
#: Bare grants by a short name.
GRANTS = (
    ("mit", "under mit", "(?:licensed|released|distributed) under mit"),
    ("mit", "under the mit", "(?:licensed|released|distributed) under the mit"),
    ("mit", "under an mit", "(?:licensed|released|distributed) under an mit"),
    ("bsd", "bsd", "(?:licensed|released|distributed) under (?:the |an? )?bsd"),
    ("gpl", "gpl", "(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gpl"),
    ("lgpl", "lgpl", "(?:licensed|released|distributed) under (?:the )?(?:terms of the )?lgpl"),
    ("agpl", "agpl", "(?:licensed|released|distributed) under (?:the )?(?:terms of the )?agpl"),
)
#: Words of the licences' own texts.
BODIES = (
    ("mit", "furnished", "permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-0", "furnished", "permit persons to whom the software is furnished to do so the software is provided as is"),
    ("ncsa", "deal with", "to deal with the software without restriction including without limitation the rights"),
    ("json", "not evil", "the software shall be used for good not evil"),
    ("x11", "consortium", "the name of the x consortium shall not be used in advertising"),
    ("hpnd", "supporting", "both that copyright notice and this permission notice appear in supporting documentation"),
    ("isc", "fee", "for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "fee", "for any purpose with or without fee is hereby granted the software is provided as is"),
    ("postgresql", "written agreement", "for any purpose without fee and without a written agreement is hereby granted"),
    ("bsl-1.0", "accompanying", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "compile", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "verbatim", "copies of this license document and changing it is allowed as long as the name is changed"),
    ("beerware", "a beer in return", "you can buy me a beer in return"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("apache-2.0", "contributor", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php-3.01", "php", "this product includes php software freely available from"),
    ("python-2.0", "psf", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("artistic-1.0", "intent", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "establishes", "this license establishes the terms under which a given free software package may be copied"),
    ("ofl-1.1", "open font", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("gpl", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "practical", "the licenses for most software and other practical works are designed to take away your freedom"),
    ("gpl-3.0", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-2.1", "lesser", "this is the first released version of the lesser gpl"),
    ("agpl-3.0", "affero", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", "remotely", "your modified version must prominently offer all users interacting with it remotely"),
    ("sspl-1.0", "service", "available to third parties as a service you must make the service source code available"),
    ("busl-1.1", "production", "redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "managed", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "right to sell", "the license does not grant to you the right to sell the software"),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighbou?ring rights"),
    ("cc0-1.0", "deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("public-domain", "domain", "this (?:work|software|file|code|program|document) is in the public domain"),
    ("proprietary", "proprietary", "unpublished proprietary (?:source code|information)"),
    ("proprietary", "secret", "confidential information and trade secrets?"),
    ("proprietary", "prohibited", "unauthori(?:s|z)ed (?:copying|reproduction|distribution|use) of this .{1,80}? strictly prohibited"),
    ("proprietary", "sold", "the software is licensed not sold"),
    ("non-commercial", "commercial", "for non ?commercial (?:use|purposes) only"),
    ("research-only", "research", "for (?:academic and )?research (?:use|purposes) only"),
    ("evaluation-only", "evaluation", "for evaluation (?:use|purposes) only"),
)
#: Exceptions to licences.
EXCEPTIONS = (
    ("classpath-exception", "classpath", "classpath exception"),
    ("classpath-exception", "independent", "permission to link this library with independent modules"),
    ("gcc-exception", "runtime", "gcc runtime library exception"),
    ("llvm-exception", "llvm", "llvm exceptions?"),
    ("linux-syscall-note", "syscall", "linux syscall note"),
    ("font-exception", "font exception", "font exception 2 0"),
    ("bison-exception", "bison", "bison exception"),
    ("autoconf-exception", "autoconf", "autoconf exception"),
)
#: Licences by name.
NAMES = (
    ("cecill-2.1", "cecill", "cecill(?: free software)?(?: licen[sc]e)?(?: agreement)? (?:version |v ?)?2 1"),
    ("cecill-b", "cecill", "cecill b"),
    ("cecill-c", "cecill", "cecill c"),
    ("ipl-1.0", "ibm", "ibm public licen[sc]e(?: (?:version |v ?)?1 0)?"),
    ("qpl-1.0", "q public", "q public licen[sc]e"),
    ("sleepycat", "sleepycat", "sleepycat licen[sc]e"),
    ("vim", " vim ", "vim licen[sc]e"),
    ("w3c", "w3c", "w3c software (?:notice and )?licen[sc]e"),
    ("apsl-2.0", "apple", "apple public source licen[sc]e(?: (?:version |v ?)?2 0)?"),
    ("lppl-1.3c", "latex", "latex project public licen[sc]e(?: (?:version |v ?)?1 3c?)?"),
    ("zpl-2.1", "zope", "zope public licen[sc]e(?: (?:version |v ?)?2 1)?"),
    ("spl-1.0", "sun", "sun public licen[sc]e"),
    ("ecl-2.0", "educational", "educational community licen[sc]e(?: (?:version |v ?)?2 0)?"),
    ("bsd-3-clause-clear", "clear bsd", "clear bsd licen[sc]e"),
    ("hippocratic", "hippocratic", "hippocratic licen[sc]e"),
    ("parity", "parity", "parity public licen[sc]e"),
    ("prosperity", "prosperity", "prosperity public licen[sc]e"),
    ("polyform-noncommercial", "polyform", "polyform non ?commercial licen[sc]e"),
    ("polyform-shield", "polyform", "polyform shield licen[sc]e"),
    ("polyform-small-business", "polyform", "polyform small business licen[sc]e"),
    ("fsl", "functional", "functional source licen[sc]e"),
    ("cal-1.0", "cryptographic", "cryptographic autonomy licen[sc]e"),
    ("cdla-permissive-2.0", "community data", "community data licen[sc]e agreement permissive(?: (?:version )?2 0)?"),
    ("cdla-sharing-1.0", "community data", "community data licen[sc]e agreement sharing(?: (?:version )?1 0)?"),
    ("pddl-1.0", "dedication", "public domain dedication and licen[sc]e"),
    ("ogl-uk-3.0", "government", "open government licen[sc]e (?:version |v ?)?3(?: 0)?"),
    ("etalab-2.0", "etalab", "etalab (?:open )?licen[sc]e(?: (?:version |v ?)?2 0)?"),
    ("openrail-m", "openrail", "(?:creativeml )?(?:open ?rail|openrail) m"),
    ("llama-community", "llama", "llama (?:2|3|3 1|3 2|3 3) community licen[sc]e"),
    ("gemma", "gemma", "gemma terms of use"),
)
