"""Wordings of public licenses: short notices, file headers and whole texts, each with the words that tell it from others."""

from __future__ import annotations

# Usual notices of public licenses.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', ("apache", "2.0")),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", ("bsd", "2-clause")),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", ("bsd", "3-clause")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "commons", "attribution", "4.0")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "by-nc", "4.0")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "by-sa", "4.0")),
    ("CC0-1.0", "Released into the public domain under CC0 1.0.", ("cc0", "1.0")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "3")),
    ("ISC", "Released under the ISC License.", ("isc",)),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "3")),
    ("MIT", "Released under the MIT License.", ("mit",)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission", "granted", "charge")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2.0")),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered", "public", "domain")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu", "affero", "3")),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative", "commons", "attribution-noncommercial", "4.0")),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative", "commons", "attribution-sharealike", "4.0")),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ("creative", "commons", "attribution-noncommercial-sharealike", "4.0")),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ("creative", "commons", "attribution-noderivatives", "4.0")),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", ("eclipse", "v1.0")),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ("eclipse", "2.0")),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution", ("eclipse", "v2.0")),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", ("boost", "1.0")),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", ("governed", "bsd-style")),
)

# Licenses that are named in "licensed under the ... license".
NAMED = (
    ("MIT", "MIT", ("mit",)),
    ("ISC", "ISC", ("isc",)),
    ("zlib", "zlib", ("zlib",)),
    ("AGPL-3.0", "GNU AGPL v3", ("agpl", "v3")),
    ("GPL-2.0", "GPL v2", ("gpl", "v2")),
    ("GPL-3.0", "GPL v3", ("gpl", "v3")),
    ("EPL-2.0", "Eclipse Public License 2.0", ("eclipse", "2.0")),
    ("MPL-2.0", "Mozilla Public License 2.0", ("mozilla", "2.0")),
)

# The identifiers that source files carry in SPDX tags.
SPDX = (
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0",
    "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)

# File headers and whole texts.
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
TEXTS = (
    ("Apache-2.0",
     'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
     "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
     "implied. See the License for the specific language governing permissions and limitations under the License.",
     ("apache", "2.0", "unless")),
    ("BSD-2-Clause", _CONDITIONS + _DISCLAIMER, ("redistribution", "redistributions", "disclaimer")),
    ("BSD-3-Clause", _CONDITIONS + _NAMES + _DISCLAIMER, ("redistribution", "endorse", "promote")),
    ("BSD-3-Clause", _CONDITIONS + _NAMES, ("redistribution", "endorse", "promote")),
    ("BSD-2-Clause", _CONDITIONS, ("redistribution", "redistributions", "disclaimer")),
    ("BSL-1.0",
     "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
     'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare '
     "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
     ("permission", "organization", "transmit")),
    ("ISC",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
     "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
     "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
     "SOFTWARE.",
     ("permission", "fee", "disclaims")),
    ("MIT",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
     '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
     "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
     "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
     "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
     ("permission", "granted", "charge", "sublicense")),
    ("MPL-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at http://mozilla.org/MPL/2.0/.",
     ("mozilla", "2.0", "mpl")),
    ("Unlicense",
     "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
     "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
     ("unencumbered", "public", "domain", "anyone")),
    ("Zlib",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
     "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
     "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
     "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
     "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
     "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
     ("misrepresented", "altered", "permission")),
)

# The header of programs under one of the GNU licenses, by name and version.
_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
    "Foundation, either version {version} of the License, or (at your option) any later version."
)
_GNU_NAMES = (
    ("GPL-2.0-or-later", "program", "General Public License", "2", ("gnu", "general", "2", "later")),
    ("GPL-3.0-or-later", "program", "General Public License", "3", ("gnu", "general", "3", "later")),
    ("LGPL-2.1-or-later", "library", "Lesser General Public License", "2.1", ("gnu", "lesser", "2.1", "later")),
    ("LGPL-3.0-or-later", "program", "Lesser General Public License", "3", ("gnu", "lesser", "3", "later")),
    ("AGPL-3.0-or-later", "program", "Affero General Public License", "3", ("gnu", "affero", "3", "later")),
)

TEMPLATES = (
    *NOTICES,
    *((license, f"Licensed under the {name} license", marks) for license, name, marks in NAMED),
    *((name, f"SPDX-License-Identifier: {name}", ("spdx-license-identifier", name.lower())) for name in SPDX),
    *((license, _GNU.format(what=what, name=name, version=version), marks) for license, what, name, version, marks in _GNU_NAMES),
    *TEXTS,
)
