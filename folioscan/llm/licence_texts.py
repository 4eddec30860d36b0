"""Notices and texts by which licence families are known, in lower case and without line breaks."""

from __future__ import annotations

_GNU_END = "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu {name} for more details. you should have received a copy of the gnu {name} along with this program."
_AS_IS = "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
_BSD = "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."

#: Texts by family. What families share word for word stands in each of them.
TEMPLATES = {
    "agpl-3.0": [
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.",
        _GNU_END.format(name="affero general public license"),
        "licensed under the gnu agpl v3.",
    ],
    "apache-2.0": [
        "licensed under the apache license, version 2.0.",
        "licensed under the apache license, version 2.0 (the \"license\"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",
        "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license.",
        "this project is distributed under the apache license 2.0.",
    ],
    "bsd-2-clause": ["released under the bsd 2-clause license.", "licensed under the simplified bsd license."],
    "bsd-3-clause": [
        _BSD,
        "3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        _BSD_END,
        "released under the bsd 3-clause license.",
        "use of this source code is governed by a bsd-style license.",
    ],
    "bsl-1.0": ["distributed under the boost software license, version 1.0.", "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the software"],
    "cc-by-4.0": ["this work is licensed under a creative commons attribution 4.0 international license.", "licensed under cc by 4.0."],
    "cc-by-nc-4.0": ["this work is licensed under a creative commons attribution-noncommercial 4.0 international license.", "licensed under cc by-nc 4.0."],
    "cc-by-sa-4.0": ["this work is licensed under a creative commons attribution-sharealike 4.0 international license.", "licensed under cc by-sa 4.0."],
    "cc0-1.0": [
        "the author has dedicated this work to the public domain under cc0 1.0 universal.",
        "released into the public domain under cc0 1.0.",
        "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "gpl-2.0": [
        "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version.",
        "this program is free software; you can redistribute it under the terms of the gnu general public license, version 2.",
        "licensed under the gnu gpl v2.",
    ],
    "gpl-3.0": [
        "this work is licensed under the gnu general public license, version 3.",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.",
        _GNU_END.format(name="general public license"),
        "licensed under the gnu gpl v3.",
    ],
    "isc": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "released under the isc license."],
    "lgpl-3.0": [
        "this library is licensed under the gnu lesser general public license, version 3.",
        "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 3 of the license, or (at your option) any later version.",
        "licensed under the gnu lgpl v3.",
    ],
    "mit": [
        "released under the mit license.",
        "licensed under the mit license.",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
        _AS_IS,
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/.",
        "this source code form is subject to the terms of the mozilla public license, version 2.0.",
        "licensed under the mozilla public license 2.0.",
    ],
    "proprietary": ["all rights reserved.", "copyright the authors. all rights reserved. no part may be reproduced without permission."],
    "unlicense": ["this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": ["this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
}
