"""Public licence texts and notices that `licenses` looks for.

Fixed values, in the licences' own words. `needs` are phrases of which one must stand inside
a span that is to get the label: they tell a licence from its siblings, whose wording is
otherwise the same; `gpl` and `bsd` are for passages that leave the sibling open. Long
licences (the files of the folder `licences`) are whole, too, as templates of some paragraphs
each, so that any part of them is found by itself.
"""

from __future__ import annotations

import pkgutil
import re
from typing import NamedTuple


class Template(NamedTuple):
    label: str
    text: str
    needs: tuple[str, ...] = ()


_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_ADVERTISING = (
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by the organization. "
)
_ENDORSEMENT = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_BODY = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _gnu(label: str, name: str, version: str, subject: str = "program") -> list[Template]:
    """The notice of a GNU licence of one version, at length and in short."""
    needs = (f"{name} license as published by the free software foundation either version {version} of the license", f"{name} license version {version}", f"{name} license as published by the free software foundation version {version}")
    long = (
        f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} License as published by the Free "
        f"Software Foundation, either version {version} of the License, or (at your option) any later version. This {subject} is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the GNU {name} License for more details."
    )
    return [
        Template(label, long, needs),
        Template(label, f"you can redistribute it and/or modify it under the terms of the GNU {name} License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version", needs),
        Template(label, f"under the terms of the GNU {name} License version {version} as published by the Free Software Foundation", needs),
        Template(label, f"This work is licensed under the GNU {name} License, version {version}", needs),
    ]


def _creative_commons() -> list[Template]:
    """The notices of the six licences, which differ in what stands between Attribution and the version."""
    out = []
    for code, words in [
        ("cc-by", "Attribution"), ("cc-by-sa", "Attribution-ShareAlike"), ("cc-by-nc", "Attribution-NonCommercial"), ("cc-by-nd", "Attribution-NoDerivatives"),
        ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
    ]:
        name = words.lower().replace("-", " ")
        short = code.replace("-", " ")
        told = tuple(f"{name} {x}" for x in ("4", "3", "2", "international", "license"))
        out += [
            Template(code, f"This work is licensed under a Creative Commons {words} 4.0 International License", told),
            Template(code, f"licensed under the Creative Commons {words} 4.0 International License", told),
            Template(code, f"Licensed under {code.upper().replace('CC-', 'CC ')} 4.0", (f"{short} 4", f"{short} 3", f"{short} 2")),
        ]
    return out


#: The long licences' files, and the label of licences whose passages may be each other's.
BODIES = {"apache-2": "Apache-2.0", "gpl-2": "GPL-2", "gpl-3": "GPL-3", "lgpl-2.1": "LGPL-2.1", "lgpl-3": "LGPL-3", "mpl-2": "MPL-2.0", "cc0": "CC0-1.0"}
FAMILIES = {"gpl-2": "gpl", "gpl-3": "gpl", "lgpl-2.1": "gpl", "lgpl-3": "gpl", "agpl-3": "gpl"}
#: Words that a template of a long licence has at least, but for its last.
CHUNK = 80


def body(label: str) -> str:
    """A long licence as it is published."""
    return pkgutil.get_data(__package__, f"licences/{BODIES[label]}.txt").decode()


def _whole(label: str) -> list[Template]:
    """The paragraphs of a long licence, gathered to CHUNK words or more."""
    out, held, n = [], [], 0
    for paragraph in re.split(r"\n\s*\n", body(label)):
        held.append(paragraph)
        n += len(paragraph.split())
        if n >= CHUNK:
            out.append(" ".join(held))
            held, n = [], 0
    if held:
        out[-1] += " " + " ".join(held)  # a short rest belongs to what stands before it
    return [Template(label, text) for text in out]


TEMPLATES = [
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template("mit", "Released under the MIT license"),
    Template("isc", f"{_ISC_BODY}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}", ("appear in all copies",)),
    Template("0bsd", f"{_ISC_BODY}. {_ISC_DISCLAIMER}", ("hereby granted the software is provided",)),
    Template("bsd-2", _REDISTRIBUTION + _BSD_DISCLAIMER, ("with the distribution this software is provided",)),
    Template("bsd-3", _REDISTRIBUTION + "3. " + _ENDORSEMENT + _BSD_DISCLAIMER, ("with the distribution neither the name", "with the distribution 3 neither the name")),
    Template("bsd-4", _REDISTRIBUTION + _ADVERTISING + "4. " + _ENDORSEMENT + _BSD_DISCLAIMER, ("all advertising materials mentioning features",)),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain "
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
    ),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template(
        "apache-2",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    ),
    Template("bsd", _REDISTRIBUTION.split("1.")[0]),
    Template("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    *_gnu("gpl-2", "General Public", "2"),
    *_gnu("gpl-3", "General Public", "3"),
    *_gnu("lgpl-2.1", "Lesser General Public", "2.1", "library"),
    *_gnu("lgpl-3", "Lesser General Public", "3", "library"),
    *_gnu("agpl-3", "Affero General Public", "3"),
    Template(
        "gpl-3",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute "
        "verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for "
        "software and other kinds of works.",
        ("general public license version 3 29 june 2007",),
    ),
    Template(
        "gpl-2",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute "
        "verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your "
        "freedom to share and change it.",
        ("general public license version 2 june 1991",),
    ),
    Template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    Template(
        "epl-2",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0",
        ("eclipse public license 2", "eclipse public license v 2", "eclipse public license v2"),
    ),
    Template(
        "epl-1",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, "
        "and is available at http://www.eclipse.org/legal/epl-v10.html",
        ("eclipse public license v1", "eclipse public license 1", "eclipse public license v 1"),
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution.",
    ),
    Template(
        "bsl-1",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
        "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
        ("any person or organization obtaining",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template(
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain "
        "Dedication",
    ),
    *_creative_commons(),
    *[t for label in BODIES for t in _whole(label)],
    Template("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"),
]
