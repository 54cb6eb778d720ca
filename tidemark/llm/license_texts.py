"""Headers, identifier lines and bodies of common licenses, as templates (name, text) of the license scan."""

from __future__ import annotations

import functools
import pathlib

_GNU = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License"
    " as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
    " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
    " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more details"
)
_GNU_KINDS = [
    ("gpl-2.0", "program", "", "2"), ("gpl-3.0", "program", "", "3"), ("agpl-3.0", "program", "Affero", "3"),
    ("lgpl-2.1", "library", "Lesser", "2.1"), ("lgpl-3.0", "library", "Lesser", "3"),
]
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed"
    ' to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF'
    " ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
    " with this file, You can obtain one at https://mozilla.org/MPL/2.0/"
)
_BSD_FILE = "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"
_CC = [
    ("cc-by", "Attribution"), ("cc-by-sa", "Attribution-ShareAlike"), ("cc-by-nc", "Attribution-NonCommercial"),
    ("cc-by-nd", "Attribution-NoDerivatives"), ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
    ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
]
_SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0"
    " CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0"
    " EUPL-1.1 EUPL-1.2 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA"
    " ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Unlicense UPL-1.0 WTFPL X11 Zlib ZPL-2.1"
).split()

HEADERS = [
    *((name, _GNU.format(what=what, kind=kind, version=version)) for name, what, kind, version in _GNU_KINDS),
    ("apache-2.0", _APACHE), ("mpl-2.0", _MPL), ("bsd", _BSD_FILE),
    *((f"{name}-4.0", f"This work is licensed under a Creative Commons {title} 4.0 International License") for name, title in _CC),
    *((name.lower(), f"SPDX-License-Identifier: {name}") for name in _SPDX),
]


@functools.cache
def bodies() -> list[tuple[str, str]]:
    """Whole license texts, one file each; read on the driver."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((pathlib.Path(__file__).parent / "licenses").glob("*.txt"))]
