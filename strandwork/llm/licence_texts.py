"""Public licence texts and notices, each with its label and the key phrases that a copy must hold."""

#: (label, key phrases apart by "|", text). Punctuation and case don't count. A short notice is a key phrase as a whole.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge|deal in the software without restriction|the software is provided as is", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", "permission to use copy modify and or distribute this software|with or without fee is hereby granted", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("bsd-2", "redistribution and use in source and binary forms|redistributions of source code must retain|redistributions in binary form must reproduce", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary
form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution."""),
    ("bsd-3", "redistribution and use in source and binary forms|redistributions in binary form must reproduce|neither the name of|endorse or promote products", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary
form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""),
    ("zlib", "this software is provided as is without any express or implied warranty|the origin of this software must not be misrepresented", """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented."""),
    ("unlicense", "this is free and unencumbered software|released into the public domain", """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("apache-2", "licensed under the apache license version 2|you may not use this file except in compliance", """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("mpl-2", "mozilla public license|2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("gpl-2", "gnu general public license version 2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "gnu general public license version 3", "licensed under the GNU General Public License, version 3"),
    ("lgpl-3", "gnu lesser general public license version 3", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "gnu affero general public license version 3", "licensed under the GNU Affero General Public License, version 3"),
    ("gpl", "under the terms of the gnu general public license as published by", """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version"""),
    ("cc0", "creative commons zero", "released under Creative Commons Zero"),
    ("cc0", "cc0 1 0", "licensed under CC0 1.0"),
    ("cc-by", "under a creative commons attribution 4 0 international license", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "under cc by 4 0", "licensed under CC BY 4.0"),
    ("cc-by-sa", "under a creative commons attribution sharealike 4 0 international license", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "under cc by sa 4 0", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "under a creative commons attribution noncommercial 4 0 international license", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("mit", "spdx license identifier mit", "SPDX-License-Identifier: MIT"),
    ("apache-2", "spdx license identifier apache 2 0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-3", "spdx license identifier bsd 3 clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl-3", "spdx license identifier gpl 3 0", "SPDX-License-Identifier: GPL-3.0"),
    ("mpl-2", "spdx license identifier mpl 2 0", "SPDX-License-Identifier: MPL-2.0"),
)
#: Labels whose text holds that of another one, which then isn't given for the same place.
WITHIN = {"bsd-3": "bsd-2"}
