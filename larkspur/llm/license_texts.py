"""Wording of public licences: one-line notices, headers of source files, and licence texts or their openings."""

from __future__ import annotations

# What the licences and their stewards' instructions say. Placeholders and names of holders are left out.
_WARRANTY_BSD = """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties,
including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no
event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential
damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business
interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or
otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_ADS = """3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This
product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_WARRANTY = """The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be
liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection
with the software or the use or other dealings in the software."""
_ISC_WARRANTY = """The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied
warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages
or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action,
arising out of or in connection with the use or performance of this software."""
_CC = "licensed under a Creative Commons Attribution{kind} {n} License"
_FSF = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."
_HEADER_ONLY = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, version {n} of the License."
_LIBRARY = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {n} of the License, or (at your option) any later version."

#: Identifiers without a digit that a line of SPDX may name.
PLAIN_IDS = frozenset("Beerware CDDL CNRI-Python curl FTL HPND ICU IJG ImageMagick Info-ZIP ISC JSON libpng libtiff MIT MIT-CMU MIT-feh MS-PL MS-RL NCSA Net-SNMP NTP OML OpenSSL PostgreSQL psfrag Python Qhull RSA-MD Ruby SGI-B SISSL Sleepycat SMLNJ TCL Unlicense UPL Vim W3C WTFPL X11 Xerox Zend Zlib zlib-acknowledgement".split())

#: Short notices, as they stand in files of any kind.
NOTICES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("licensed under the GNU Affero General Public License, version 3",),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0",),
    "BSD-2-Clause": (_BSD, "Licensed under the 2-Clause BSD License",),
    "BSD-3-Clause": (f"{_BSD} {_BSD_THIRD}", "Licensed under the 3-Clause BSD License",),
    "BSD-4-Clause": (f"{_BSD} {_BSD_ADS}",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0",),
    "Artistic-2.0": ("Licensed under the Artistic License 2.0", "under the terms of the Artistic License version 2.0"),
    "CC-BY-2.0": ("Licensed under CC BY 2.0", _CC.format(kind="", n="2.0 Generic")),
    "CC-BY-3.0": ("Licensed under CC BY 3.0", _CC.format(kind="", n="3.0 Unported")),
    "CC-BY-NC-3.0": ("Licensed under CC BY-NC 3.0", _CC.format(kind="-NonCommercial", n="3.0 Unported")),
    "CC-BY-SA-3.0": ("Licensed under CC BY-SA 3.0", _CC.format(kind="-ShareAlike", n="3.0 Unported")),
    "EUPL-1.2": ("Licensed under the EUPL, Version 1.2", "under the terms of the European Union Public Licence, version 1.2"),
    "GPL-1.0": ("This work is licensed under the GNU General Public License, version 1",),
    "GPL-1.0-or-later": (_HEADER.format(name="", n=1),),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("dedicated to the public domain under CC0 1.0",),
    "EPL-2.0": ("made available under the terms of the Eclipse Public License 2.0",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2",),
    "GPL-2.0-only": (_HEADER_ONLY.format(name="", n=2),),
    "GPL-2.0-or-later": (_HEADER.format(name="", n=2),),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3",),
    "GPL-3.0-only": (_HEADER_ONLY.format(name="", n=3),),
    "GPL-3.0-or-later": (_HEADER.format(name="", n=3),),
    "AGPL-3.0-or-later": (_HEADER.format(name="Affero", n=3),),
    "ISC": ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License",),
    "LGPL-2.1": ("licensed under the GNU Lesser General Public License, version 2.1",),
    "LGPL-2.1-or-later": (_LIBRARY.format(n="2.1"),),
    "LGPL-3.0": ("licensed under the GNU Lesser General Public License, version 3",),
    "LGPL-3.0-or-later": (_LIBRARY.format(n="3"),),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",),
    "MPL-2.0": ("subject to the terms of the Mozilla Public License, v. 2.0",),
    "Unlicense": ("For more information, please refer to <https://unlicense.org>",),
    "Zlib": ("Released under the zlib License",),
}

#: Licence texts: short ones whole, of long ones the opening, which tells them apart. A file that begins so is a licence file.
TEXTS: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (f"GNU Affero General Public License Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_FSF} Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",),
    "Apache-2.0": ("""Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and
distribution 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1
through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.""",),
    "BSD-2-Clause": (f"{_BSD} {_WARRANTY_BSD}",),
    "BSD-3-Clause": (f"{_BSD} {_BSD_THIRD} {_WARRANTY_BSD}",),
    "BSD-4-Clause": (f"{_BSD} {_BSD_ADS} {_WARRANTY_BSD}",),
    "MIT-0": (f"{_MIT_GRANT}. {_MIT_WARRANTY}",),
    "0BSD": (f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_WARRANTY}",),
    "Artistic-2.0": (f"""The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation. {_FSF} Preamble This license establishes the terms under
which a given free software Package may be copied, modified, distributed, and/or redistributed.""",),
    "EUPL-1.2": ("""European Union Public Licence v. 1.2 EUPL (c) the European Union 2007, 2016 This European Union Public Licence (the "EUPL") applies to the
Work (as defined below) which is provided under the terms of this Licence. Any use of the Work, other than as authorised under this Licence is
prohibited (to the extent such use is covered by a right of the copyright holder of the Work).""",),
    "WTFPL": ("""Do What The Fuck You Want To Public License Version 2, December 2004 Everyone is permitted to copy and distribute verbatim or modified
copies of this license document, and changing it is allowed as long as the name is changed. Terms and conditions for copying, distribution and
modification 0. You just do what the fuck you want to.""",),
    "BSL-1.0": ("""Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or
organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce,
display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom
the Software is furnished to do so, all subject to the following:""",),
    "CC-BY-4.0": ("""Creative Commons Attribution 4.0 International Public License By exercising the Licensed Rights (defined below), You accept
and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License ("Public License").""",),
    "CC-BY-NC-4.0": ("""Creative Commons Attribution-NonCommercial 4.0 International Public License By exercising the Licensed Rights (defined
below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International
Public License ("Public License").""",),
    "CC-BY-SA-4.0": ("""Creative Commons Attribution-ShareAlike 4.0 International Public License By exercising the Licensed Rights (defined below),
You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License
("Public License").""",),
    "CC0-1.0": ("""Creative Commons Legal Code CC0 1.0 Universal Creative Commons Corporation is not a law firm and does not provide legal services.
Distribution of this document does not create an attorney-client relationship. Creative Commons provides this information on an "as-is" basis.""",),
    "EPL-2.0": ("""Eclipse Public License - v 2.0 The accompanying program is provided under the terms of this Eclipse Public License ("Agreement").
Any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement.""",),
    "GPL-2.0": (f"""GNU General Public License Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth
Floor, Boston, MA 02110-1301 USA {_FSF} Preamble The licenses for most software are designed to take away your freedom to share and change it.""",),
    "GPL-3.0": (f"GNU General Public License Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_FSF} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.",),
    "ISC": (f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}""",),
    "LGPL-2.1": (f"""GNU Lesser General Public License Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin
Street, Fifth Floor, Boston, MA 02110-1301 USA {_FSF} This is the first released version of the Lesser GPL. It also counts as the successor of
the GNU Library Public License, version 2, hence the version number 2.1.""",),
    "LGPL-3.0": (f"""GNU Lesser General Public License Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_FSF} This version of
the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the
additional permissions listed below.""",),
    "MIT": (f"""{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. {_MIT_WARRANTY}""",),
    "MPL-2.0": ("""Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes
to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a
Contributor and that particular Contributor's Contribution.""",),
    "Unlicense": ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to
the public domain.""",),
    "Zlib": ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and
to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must
not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software. 3. This notice may not be removed or altered from any source distribution.""",),
}
# End of fixed values.
