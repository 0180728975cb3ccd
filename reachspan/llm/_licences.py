"""Fixed values of the licence scan: phrases, and public notices that name a licence."""

#: phrase: label.  The base phrases, matched word for word.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

_FREE = "this program is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or at your option any later version"
_LIBRARY = "this library is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or at your option any later version"
_CREATIVE = "this work is licensed under a creative commons {name} {version} international license"
_SHORT = "licensed under the {name}"
_RELEASED = "released under the {name}"

#: (label, notice, words that must stand together in the span, as they tell the licence from its neighbours).
#: Matched by diagonal voting, with some words lost, added or changed.
NOTICES = [
    ("agpl-3", _FREE.format(name="affero general public license", version="3"), ["affero general public license", "version 3"]),
    ("gpl-2", _FREE.format(name="general public license", version="2"), ["gnu general public license", "version 2"]),
    ("gpl-3", _FREE.format(name="general public license", version="3"), ["gnu general public license", "version 3"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl-2", _LIBRARY.format(name="library general public license", version="2"), ["library general public license", "version 2 of"]),
    ("lgpl-2.1", _LIBRARY.format(name="lesser general public license", version="2 1"), ["lesser general public license", "version 2 1"]),
    ("lgpl-3", _LIBRARY.format(name="lesser general public license", version="3"), ["lesser general public license", "version 3"]),
    ("lgpl-3", _FREE.format(name="lesser general public license", version="3"), ["lesser general public license", "version 3"]),
    ("fdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation", ["gnu free documentation license version 1 3"]),
    ("fdl-1.2", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2 or any later version published by the free software foundation", ["gnu free documentation license version 1 2"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license"]),
    ("apache-2", "licensed under the apache license version 2", ["apache license version 2"]),
    ("apache-2", _RELEASED.format(name="apache license 2 0"), ["apache license 2 0"]),
    ("apache-1.1", "the apache software license version 1 1", ["apache software license version 1 1"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["neither the name of"]),
    ("bsd", _RELEASED.format(name="bsd license"), ["bsd license"]),
    ("bsd", _SHORT.format(name="bsd license"), ["bsd license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["free of charge to any person", "associated documentation files"]),
    ("mit", _RELEASED.format(name="mit license"), ["mit license"]),
    ("mit", _SHORT.format(name="mit license"), ["mit license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee", "provided that"]),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", ["hereby granted the software is provided"]),
    ("isc", _RELEASED.format(name="isc license"), ["isc license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license v 2 0"]),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license", ["mozilla public license version 1 1"]),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution", ["eclipse public license v1 0"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ["eclipse public license 2 0"]),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license", ["common development and distribution license"]),
    ("bsl-1", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose", ["permission is granted to anyone"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0-1", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("wtfpl", "do what the fuck you want to public license", ["what the fuck you want"]),
    ("artistic-2", "this is free software you can redistribute it and or modify it under the terms of the artistic license 2 0", ["artistic license 2 0"]),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ["sil open font license version 1 1"]),
    ("eupl-1.2", "licensed under the eupl version 1 2", ["eupl version 1 2"]),
    ("cc-by-4", _CREATIVE.format(name="attribution", version="4 0"), ["commons attribution 4 0"]),
    ("cc-by-sa-4", _CREATIVE.format(name="attribution sharealike", version="4 0"), ["attribution sharealike 4 0"]),
    ("cc-by-nc-4", _CREATIVE.format(name="attribution noncommercial", version="4 0"), ["attribution noncommercial 4 0"]),
    ("cc-by-nd-4", _CREATIVE.format(name="attribution noderivatives", version="4 0"), ["attribution noderivatives 4 0"]),
    ("cc-by-nc-sa-4", _CREATIVE.format(name="attribution noncommercial sharealike", version="4 0"), ["noncommercial sharealike 4 0"]),
    ("cc-by-nc-nd-4", _CREATIVE.format(name="attribution noncommercial noderivatives", version="4 0"), ["noncommercial noderivatives 4 0"]),
    ("cc-by-4", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-nc-sa-4", "licensed under cc by nc sa 4 0", ["cc by nc sa 4 0"]),
    ("cc-by-nc-nd-4", "licensed under cc by nc nd 4 0", ["cc by nc nd 4 0"]),
    ("cc-by-sa-3", "this work is licensed under a creative commons attribution sharealike 3 0 unported license", ["attribution sharealike 3 0"]),
]
