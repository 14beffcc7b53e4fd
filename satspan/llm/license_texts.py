"""Standard licence texts and notices, and phrases that must stand in
each.  They are public wordings, cut where names and years are filled in, and
compared as words of lower-case letters and digits."""

from __future__ import annotations

import re
from typing import NamedTuple


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


def words_in(text: str) -> str:
    """The words of a text as the scan sees them, one blank between them."""
    return " ".join(re.findall(r"[a-z0-9]+", text.lower()))


def _t(label: str, text: str, *keys: str) -> Template:
    return Template(label, words_in(text), tuple(words_in(k) for k in keys))


_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_GNU = """it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, either version {n}
of the License, or (at your option) any later version."""

_GNU_WARRANTY = """is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details."""


def _gnu(label: str, what: str, name: str, n: str, *keys: str) -> Template:
    text = f"{what} is free software: you can redistribute it and/or modify {_GNU} {what} {_GNU_WARRANTY}".format(name=name, n=n)
    return _t(label, text, f"GNU {name} General Public License as published", "Free Software Foundation", f"version {n}", *keys)


TEMPLATES = (
    _t("mit-notice", "released under the MIT License", "mit license"),
    _t(
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. """ + _AS_IS,
        "permission is hereby granted free of charge", "without restriction",
    ),
    _t(
        "mit-grant",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
        "permission is hereby granted free of charge", "without restriction",
    ),
    _t(
        "mit-0-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so. """ + _AS_IS,
        "permission is hereby granted free of charge", "furnished to do so the software is provided",
    ),
    _t("apache-2.0-notice", "licensed under the Apache License, Version 2.0", "apache license", "version 2 0"),
    _t(
        "apache-2.0-text",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
        OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
        "apache license version 2 0", "except in compliance",
    ),
    _t(
        "apache-2.0-header",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
        "apache license version 2 0", "except in compliance",
    ),
    _t("gpl-3.0-notice", "this work is licensed under the GNU General Public License version 3", "general public license", "version 3"),
    _t(
        "gpl-text",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation""",
        "gnu general public license", "free software foundation",
    ),
    _gnu("gpl-3.0-header", "This program", "", "3"),
    _gnu("gpl-2.0-header", "This program", "", "2"),
    _gnu("lgpl-3.0-header", "This library", "Lesser", "3"),
    _gnu("lgpl-2.1-header", "This library", "Lesser", "2.1"),
    _gnu("agpl-3.0-header", "This program", "Affero", "3"),
    _t("bsd-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice""",
        "redistribution and use in source and binary forms"),
    _t("bsd-2-clause-text", _BSD + _BSD_AS_IS, "redistribution and use in source and binary forms", "in binary form must reproduce", "distribution this software is provided"),
    _t(
        "bsd-3-clause-text",
        _BSD + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission. """ + _BSD_AS_IS,
        "redistribution and use in source and binary forms", "endorse or promote products",
    ),
    _t("mpl-2.0-notice", "this Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license", "v 2 0"),
    _t(
        "mpl-2.0-header",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "mozilla public license v 2 0",
    ),
    _t(
        "isc-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
        "with or without fee is hereby granted", "appear in all copies",
    ),
    _t(
        "0bsd-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
        "hereby granted the software is provided",
    ),
    _t(
        "zlib-text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
        "must not be misrepresented", "plainly marked as such",
    ),
    _t(
        "unlicense-text",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
        or non-commercial, and by any means.""",
        "unencumbered software released into the public domain",
    ),
    _t(
        "boost-1.0-text",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
        furnished to do so, all subject to the following""",
        "any person or organization obtaining a copy", "prepare derivative works",
    ),
    _t("boost-1.0-notice", "Distributed under the Boost Software License, Version 1.0", "boost software license"),
    _t(
        "wtfpl-text",
        """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is
        allowed as long as the name is changed.""",
        "verbatim or modified copies of this license document",
    ),
    _t(
        "epl-2.0-header",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
        available at https://www.eclipse.org/legal/epl-2.0""",
        "eclipse public license 2 0",
    ),
    _t(
        "cddl-1.0-header",
        """The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").
        You may not use this file except in compliance with the License.""",
        "common development and distribution license",
    ),
    _t(
        "eupl-1.2-header",
        """Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of
        the EUPL (the "Licence"); You may not use this work except in compliance with the Licence.""",
        "licensed under the eupl", "except in compliance with the licence",
    ),
    _t("ofl-1.1-notice", "This Font Software is licensed under the SIL Open Font License, Version 1.1", "sil open font license"),
    _t(
        "cc0-1.0-notice",
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work""",
        "waived all copyright and related or neighboring rights",
    ),
    _t("cc-by-4.0-notice", "licensed under the Creative Commons Attribution 4.0 International License", "creative commons attribution", "attribution 4 0"),
    _t("cc-by-sa-4.0-notice", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "attribution sharealike 4 0"),
    _t("cc-by-nc-4.0-notice", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "attribution noncommercial 4 0"),
    _t("cc-by-nd-4.0-notice", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "attribution noderivatives 4 0"),
)
