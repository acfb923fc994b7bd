"""Licence notices and texts that the license scan looks for.

Fixed values: the wording is that of the published licences. Each entry is (label, phrases that a
block must hold to get the label, text). The phrases tell relatives apart: versions, and the variants
of one family. Blanks for years and names are left out.
"""

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted"
_BSD_CLAUSES = "provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_ZLIB = "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."


def _gnu(program: str, name: str, version: str) -> str:
    return f"{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


_SHORT = (
    ("apache-2.0", ("apache license", "version 2"), "Licensed under the Apache License, Version 2.0."),
    ("mit", ("mit license",), "Released under the MIT License."),
    ("mit", ("mit license",), "Licensed under the MIT License."),
    ("mit", ("obtaining a copy of this software",), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", ("source and binary forms",), _BSD_HEAD),
    ("mpl-2.0", ("mozilla public license", "2 0"), _MPL),
    ("public-domain", ("public domain",), "This is free and unencumbered software released into the public domain."),
    ("cc0-1.0", ("public domain", "cc0 1"), "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal, public domain dedication."),
)
_LONG = (
    ("mit", ("hereby granted",), f"{_MIT_GRANT} {_MIT_REST}"),
    ("bsd", ("source and binary forms",), f"{_BSD_HEAD} {_BSD_CLAUSES} {_BSD_REST}"),
    ("bsd", ("source and binary forms", "to endorse or promote"), f"{_BSD_HEAD} {_BSD_CLAUSES} {_BSD_THIRD} {_BSD_REST}"),
    ("apache-2.0", ("apache license", "version 2"), _APACHE),
    ("isc", ("with or without fee",), _ISC),
    ("public-domain", ("public domain",), _UNLICENSE),
    ("zlib", ("redistribute it freely",), _ZLIB),
    ("bsl-1.0", ("person or organization",), _BOOST),
)
_GNU = tuple(
    (f"{label}-{version}{tail}", (f"{must} public license", f"version {version}"), text)
    for label, must, name in (("gpl", "gnu general", "General Public License"), ("lgpl", "lesser general", "Lesser General Public License"), ("agpl", "affero general", "Affero General Public License"))
    for version, tail in (("2", ".0"), ("2.1", ""), ("3", ".0"))
    for text in (f"This work is licensed under the GNU {name}, version {version}.", f"This program is licensed under the GNU {name}, version {version}.", _gnu("This program", name, version))
    if (label, version) not in {("gpl", "2.1"), ("agpl", "2"), ("agpl", "2.1")}
)
_CREATIVE = tuple(
    (f"cc-{code.lower()}-4.0", must, text)
    for code, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    for must, text in (((f"cc {code.lower().replace('-', ' ')} 4",), f"Licensed under CC {code} 4.0."), ((f"creative commons {name.lower().replace('-', ' ')} 4",), f"This work is licensed under a Creative Commons {name} 4.0 International License."))
    if (code, text[:8]) != ("BY", "Licensed")  # the phrase cc by has a label of its own
)
TEMPLATES = _SHORT + _LONG + _GNU + _CREATIVE
