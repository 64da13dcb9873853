"""Licenses by their SPDX identifiers, with the names and notices that texts use for them.

Identifiers and names are those of the SPDX License List; notices are the ones that the licenses themselves, or the
bodies that publish them, ask to be put into works, and for short licenses the paragraphs that grant and restrict.
"""

from __future__ import annotations

#: family -> identifier -> names; "{name}" in ``PHRASES`` stands for each.
NAMES = {
    "GNU": {
        "GPL-1.0": ["GNU General Public License version 1", "GNU GPL version 1", "GPLv1"],
        "GPL-2.0": ["GNU General Public License version 2", "GNU GPL version 2", "GPLv2", "GPL 2.0", "GNU General Public License v2.0"],
        "GPL-3.0": ["GNU General Public License version 3", "GNU GPL version 3", "GPLv3", "GPL 3.0", "GNU General Public License v3.0"],
        "LGPL-2.0": ["GNU Library General Public License version 2", "LGPLv2", "LGPL 2.0"],
        "LGPL-2.1": ["GNU Lesser General Public License version 2.1", "GNU LGPL version 2.1", "LGPLv2.1", "LGPL 2.1"],
        "LGPL-3.0": ["GNU Lesser General Public License version 3", "GNU LGPL version 3", "LGPLv3", "LGPL 3.0"],
        "AGPL-3.0": ["GNU Affero General Public License version 3", "GNU AGPL version 3", "AGPLv3", "AGPL 3.0"],
        "GFDL-1.3": ["GNU Free Documentation License version 1.3", "GFDL 1.3"],
    },
    "BSD": {
        "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
        "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
        "BSD-4-Clause": ["BSD 4-Clause License", "Original BSD License"],
        "BSD-3-Clause-Clear": ["BSD 3-Clause Clear License", "Clear BSD License"],
        "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License"],
    },
    "MIT": {"MIT": ["MIT License", "Expat License"], "MIT-0": ["MIT No Attribution License", "MIT-0 License"]},
    "Apache": {
        "Apache-1.1": ["Apache Software License 1.1", "Apache License, Version 1.1"],
        "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License 2.0"],
    },
    "Creative Commons": {
        "CC0-1.0": ["Creative Commons Zero v1.0 Universal License", "CC0 1.0 Universal Public Domain Dedication", "CC0 1.0"],
        **{f"CC-{short}-{v}": [f"Creative Commons {long} {v} International License" if v == "4.0" else f"Creative Commons {long} {v} Unported License",
                               f"CC {short} {v}"]
           for v in ("3.0", "4.0") for short, long in (
               ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
               ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
               ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
    },
    "file copyleft": {
        "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License Version 1.1", "MPL 1.1"],
        "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
        "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0"],
        "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v. 2.0"],
        "CDDL-1.0": ["Common Development and Distribution License 1.0", "CDDL 1.0"],
        "CDDL-1.1": ["Common Development and Distribution License 1.1", "CDDL 1.1"],
        "EUPL-1.2": ["European Union Public License 1.2", "EUPL 1.2"],
        "OSL-3.0": ["Open Software License 3.0", "Open Software License version 3.0"],
        "MS-PL": ["Microsoft Public License"], "MS-RL": ["Microsoft Reciprocal License"],
    },
    "permissive": {
        "ISC": ["ISC License"], "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
        "Unlicense": ["The Unlicense", "Unlicense License"], "WTFPL": ["Do What The Fuck You Want To Public License"],
        "PostgreSQL": ["PostgreSQL License"], "NCSA": ["University of Illinois/NCSA Open Source License"],
        "Artistic-2.0": ["Artistic License 2.0"], "AFL-3.0": ["Academic Free License 3.0", "Academic Free License version 3.0"],
        "UPL-1.0": ["Universal Permissive License v1.0"], "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
        "PSF-2.0": ["Python Software Foundation License Version 2", "PSF License 2.0"],
    },
    "proprietary": {"Proprietary": []},
}

PHRASES = [
    "Licensed under the {name}.", "Released under the {name}.", "This work is licensed under the {name}.",
    "This project is licensed under the terms of the {name}.", "Distributed under the terms of the {name}.",
    "License: {name}",
]

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
           "in the documentation and/or other materials provided with the distribution.")
_ADVERTISING = ("All advertising materials mentioning features or use of this software must display the following acknowledgement: "
                "This product includes software developed by the organization.")
_NEITHER = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
            "from this software without specific prior written permission.")
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so")


def _gnu(what: str, name: str, version: str) -> str:
    return (f"{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
            f"Software Foundation, either version {version} of the License, or (at your option) any later version.")


def _old_gnu(what: str, name: str, version: str) -> str:
    return (f"{what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
            f"Software Foundation; either version {version} of the License, or (at your option) any later version.")


def _only(name: str, version: str) -> str:
    return f"you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by the Free Software Foundation."


NOTICES = {
    "GPL-1.0": [_old_gnu("This program", "General Public License", "1"), "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"],
    "GPL-2.0": [_old_gnu("This program", "General Public License", "2"), _only("General Public License", "2"),
                "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _gnu("This program", "General Public License", "3"),
                _only("General Public License", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.0": [_old_gnu("This library", "Library General Public License", "2"), "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-2.1": [_old_gnu("This library", "Lesser General Public License", "2.1"), _gnu("This library", "Lesser General Public License", "2.1"),
                 "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the terms of the GNU LGPL version 3.",
                 _gnu("This library", "Lesser General Public License", "3"), _old_gnu("This library", "Lesser General Public License", "3"),
                 "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": [_gnu("This program", "Affero General Public License", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, "
                 "Version 1.3 or any later version published by the Free Software Foundation"],
    "BSD-2-Clause": [" ".join([_BSD, _SOURCE, _BINARY, _AS_IS]), " ".join([_BSD, "1.", _SOURCE, "2.", _BINARY, _AS_IS])],
    "BSD-3-Clause": [" ".join([_BSD, _SOURCE, _BINARY, _NEITHER, _AS_IS]), " ".join([_BSD, "1.", _SOURCE, "2.", _BINARY, "3.", _NEITHER, _AS_IS]),
                     "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSD-4-Clause": [" ".join([_BSD, "1.", _SOURCE, "2.", _BINARY, "3.", _ADVERTISING, "4.", _NEITHER])],
    "BSD-3-Clause-Clear": [_BSD.replace("modification, are permitted", "modification, are permitted (subject to the limitations in the disclaimer below)"),
                           "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE."],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
             "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction.", f"{_MIT}, subject to the following conditions:"],
    "MIT-0": [f"{_MIT}."],
    "Apache-1.1": ["The end-user documentation included with the redistribution, if any, must include the following acknowledgment: \"This product "
                   "includes software developed by the Apache Software Foundation (http://www.apache.org/).\""],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
                   "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
                   "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
                "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in "
                "compliance with the License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "EPL-1.0": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
                "which accompanies this distribution"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use "
                 "this file except in compliance with the License."],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL"],
    "OSL-3.0": ["Licensed under the Open Software License version 3.0"],
    "MS-PL": ["This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, "
              "do not use the software."],
    "MS-RL": ["Reciprocal Grants- For any file you distribute that contains code from the software (in source code or binary format), you must provide "
              "recipients the source code to that file along with a copy of this license"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies.",
            "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
             "arising from the use of this software.",
             "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
             "it freely, subject to the following restrictions:"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                "http://www.boost.org/LICENSE_1_0.txt)",
                "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
                "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as "
              "the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a "
                   "written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs "
                   "appear in all copies."],
    "NCSA": ["to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
             "sublicense, and/or sell copies of the Software"],
    "Artistic-2.0": ["This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or "
                     "redistributed."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a "
                "FAQ at"],
    "UPL-1.0": ["Subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated "
                "documentation and/or data (collectively the \"Software\"), free of charge and under any and all copyright rights in the Software"],
    "PSF-2.0": ["PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"],
    "Proprietary": ["All rights reserved.", "Copyright holder. All rights reserved.",
                    "Unauthorized copying of this file, via any medium, is strictly prohibited."],
}

#: Words and phrases that must be in a match as often as not in both the text and the template, or in neither.
TELLING = [
    "lesser", "gnu library", "affero", "gnu", "gpl", "lgpl", "agpl", "gfdl", "neither the name", "advertising materials", "limitations in the disclaimer",
    "noncommercial", "non commercial", "sharealike", "share alike", "noderivatives", "no derivatives", "noderivs", "by nc", "by sa", "by nd", "nc sa", "nc nd",
    "provided that the above", "subject to the following conditions", "and this paragraph and", "apache", "mozilla", "mpl", "eclipse", "mit", "bsd", "isc",
    "boost", "zlib", "artistic", "academic", "european union", "eupl", "microsoft", "reciprocal", "no attribution", "clear", "zero", "simplified", "new bsd",
    "modified", "original", "font", "illinois", "python", "postgresql", "universal permissive", "cddl", "public domain",
]
#: Numbers behind these words are a version.
VERSION_WORDS = [
    "version", "v", "license", "licence", "gpl", "lgpl", "agpl", "gfdl", "apache", "mpl", "epl", "cddl", "eupl", "osl", "afl", "by", "sa", "nc", "nd", "cc",
    "attribution", "sharealike", "noncommercial", "noderivatives", "bsd", "artistic", "cc0", "zero", "upl", "ofl", "psf", "mit", "bsl", "ms",
]


def templates() -> dict[str, tuple[str, list[str]]]:
    """Identifier -> family and all wordings: notices, each name in each phrase, and the SPDX tag."""
    out = {}
    for family, licenses in NAMES.items():
        for spdx, names in licenses.items():
            said = [p.format(name=n) for n in names for p in PHRASES]
            tags = [] if spdx == "Proprietary" else [f"SPDX-License-Identifier: {spdx}"]
            if family == "GNU":
                tags += [f"SPDX-License-Identifier: {spdx}-only", f"SPDX-License-Identifier: {spdx}-or-later"]
            if family == "Creative Commons" and spdx != "CC0-1.0":
                said += [f"This work is licensed under a {names[0]}.", f"Licensed under {names[1]}."]
            out[spdx] = (family, [*NOTICES.get(spdx, ()), *said, *tags])
    return out
