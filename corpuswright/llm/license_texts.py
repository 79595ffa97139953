"""Templates of licence notices, headers and short whole texts.

Wordings are those of the licences themselves (fixed values). Notices of one line and SPDX tags are
made by rule from the licences' names. Texts of many pages are known by their title
and first paragraph; their whole wording can be read from a folder (`licenses.read_templates`).
"""

from __future__ import annotations

#: Licence ids and the names they go by.
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "Unlicense": ("Unlicense",),
}
PHRASES = ("Licensed under the {}.", "Released under the {}.", "This project is licensed under the {}.", "This work is licensed under the {}.", "This program is licensed under the {}.", "Copyright (c), released under the {}.", "Distributed under the terms of the {}.")

#: The paragraphs of the standard headers, of short licences and the heads of long ones.
WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details."
FREE = "This {} is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
APACHE_USE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
APACHE_END = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
UNLICENSE = "This is free and unencumbered software released into the public domain."
UNLICENSE_USE = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
COPYLEFT = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def templates() -> list[tuple[str, str]]:
    """(licence, text) of all templates."""
    out = [(k, p.format(n)) for k, names in NAMES.items() for n in names for p in PHRASES]
    out += [(k, f"SPDX-License-Identifier: {k}{s}") for k in NAMES for s in (("", "-only", "-or-later") if "GPL" in k else ("",))]
    out += [("Apache-2.0", APACHE_USE), ("Apache-2.0", f"{APACHE_USE} {APACHE_END}"), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"), ("Apache-2.0", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION")]
    for key, name, versions, date in (
        ("GPL", "GNU General Public License", ("2", "3"), {"2": "June 1991", "3": "29 June 2007"}), ("LGPL", "GNU Lesser General Public License", ("2.1", "3"), {"2.1": "February 1999", "3": "29 June 2007"}),
        ("AGPL", "GNU Affero General Public License", ("3",), {"3": "19 November 2007"}),
    ):
        for v in versions:
            own = f"{key}-{v}" + ".0" * ("." not in v)
            for kind in ("program", "library"):
                whole = FREE.format(kind, name, v)
                out += [(own, whole), (own, whole.replace("software:", "software;")), (own, f"{whole} {WARRANTY.format(name)}")]
            out.append((own, f"{name} Version {v}, {date[v]}"))
    out += [("MIT", "The MIT License (MIT)"), ("MIT", GRANT), ("MIT", " ".join((GRANT, NOTICE))), ("MIT", " ".join(("MIT License", GRANT, NOTICE, AS_IS))), ("MIT", " ".join((GRANT, NOTICE, AS_IS)))]
    two, three = (BSD_GRANT, BSD_SOURCE, BSD_BINARY, BSD_END), (BSD_GRANT, BSD_SOURCE, BSD_BINARY, BSD_NAMES, BSD_END)
    out += [("BSD-2-Clause", " ".join(two)), ("BSD-3-Clause", " ".join(three)), ("BSD-3-Clause", BSD_NAMES), ("BSD-3-Clause", " ".join(three[:-1])), ("BSD-2-Clause", " ".join(two[:-1]))]
    out += [("ISC", ISC_GRANT), ("ISC", f"{ISC_GRANT} {ISC_END}"), ("MPL-2.0", MPL), ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0.")]
    out += [("Unlicense", UNLICENSE), ("Unlicense", f"{UNLICENSE} {UNLICENSE_USE}"), ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."), ("CC0-1.0", "CC0 1.0 Universal Statement of Purpose")]
    out += [(k, f"Licensed under {NAMES[k][0]}.") for k in NAMES if k.startswith("CC")]
    return out
