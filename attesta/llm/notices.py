"""Texts of public licences, by family: the notices that projects write, and paragraphs of the licences themselves.

A paragraph is one string; a list of strings is one paragraph cut into lines.
"""

from __future__ import annotations

MIT = [
    "Released under the MIT License.",
    "This software is licensed under the MIT license.",
    "Licensed under the terms of the MIT license, see the file LICENSE.",
    "The MIT License (MIT)",
    ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal",
     "in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
     "copies of the Software, and to permit persons to whom the Software is", "furnished to do so, subject to the following conditions:"],
    ["The above copyright notice and this permission notice shall be included in", "all copies or substantial portions of the Software."],
    ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR", "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,",
     "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE", "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER",
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,", "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE", "SOFTWARE."],
]

BSD = [
    "Released under the BSD 3-Clause License.",
    "Licensed under the BSD 2-Clause \"Simplified\" License.",
    "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]

ISC = [
    "Released under the ISC License.",
    "Licensed under the ISC license, see LICENSE.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
]

APACHE = [
    "Licensed under the Apache License, Version 2.0.",
    "This project is distributed under the terms of the Apache License 2.0.",
    "Released under the Apache 2.0 license.",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "See the License for the specific language governing permissions and limitations under the License.",
    "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    "The ASF licenses this file to You under the Apache License, Version 2.0",
    "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work",
    "You must give any other recipients of the Work or Derivative Works a copy of this License; and You must cause any modified files to carry prominent notices stating that You changed the files",
    "Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its Contributions) on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including, without limitation, any warranties or conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE.",
]

GPL = [
    "This work is licensed under the GNU General Public License, version 3.",
    "Released under the GNU General Public License version 2.",
    "Distributed under the GPL v2 or later.",
    "Licensed under the GPLv3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software (and charge for them if you wish), that you receive source code or can get it if you want it, that you can change the software or use pieces of it in new free programs, and that you know you can do these things.",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License.",
    "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating that this License and any non-permissive terms added in accord with section 7 apply to the code",
]

LGPL = [
    "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "Licensed under the LGPL v3 or later.",
    "Released under the GNU LGPL.",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
    "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.",
    "A program that contains no derivative of any portion of the Library, but is designed to work with the Library by being compiled or linked with it, is called a \"work that uses the Library\".",
]

AGPL = [
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "Licensed under the AGPLv3.",
    "Released under the GNU AGPL v3 or later.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "See the GNU Affero General Public License for more details.",
    "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version",
]

MPL = [
    "Licensed under the Mozilla Public License Version 2.0.",
    "Released under the MPL 2.0.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License.",
    "Covered Software is provided under this License on an \"as is\" basis, without warranty of any kind, either expressed, implied, or statutory, including, without limitation, warranties that the Covered Software is free of defects, merchantable, fit for a particular purpose or non-infringing.",
]

CC_BY = [
    "Licensed under CC BY 4.0.",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "To view a copy of this license, visit https://creativecommons.org/licenses/by/4.0/",
    "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided you give appropriate credit to the original author and the source.",
]

CC_BY_SA = [
    "Licensed under CC BY-SA 4.0.",
    "Available under the CC BY-SA 3.0 license.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    "To view a copy of this license, visit https://creativecommons.org/licenses/by-sa/4.0/",
    "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
]

CC_BY_NC = [
    "Licensed under CC BY-NC 4.0.",
    "Available under the CC BY-NC-SA 4.0 license.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "To view a copy of this license, visit https://creativecommons.org/licenses/by-nc/4.0/",
    "You may not use the material for commercial purposes.",
]

PUBLIC_DOMAIN = [
    "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "Released under CC0.",
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
]

PROPRIETARY = [
    "All rights reserved.",
    "Copyright (c) 2024 Example Corporation. All rights reserved.",
    "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    "No part of this book may be reproduced or stored in a retrieval system, in any form or by any means, electronic, mechanical, photocopying, recording or otherwise, without written permission.",
    "This document is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    "This software is the confidential and proprietary information of the company. You shall not disclose such confidential information.",
]

FAMILIES = {
    "apache": APACHE, "mit": MIT, "gpl": GPL, "lgpl": LGPL, "agpl": AGPL, "bsd": BSD, "isc": ISC, "mpl": MPL,
    "cc_by": CC_BY, "cc_by_sa": CC_BY_SA, "cc_by_nc": CC_BY_NC, "public_domain": PUBLIC_DOMAIN, "proprietary": PROPRIETARY,
}
#: Each paragraph as one line.
NOTICES = {family: [" ".join(p) if isinstance(p, list) else p for p in paragraphs] for family, paragraphs in FAMILIES.items()}

#: Licences outside the families, the class 'unknown': the model learns from these,
OTHERS = [
    "Licensed under the European Union Public Licence 1.2.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.",
    "This database is made available under the Open Database License.",
    "Use of this software is governed by the Business Source License included in the LICENSE file.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "Licensed under the Eclipse Public License 2.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "Redistribution is governed by the Common Development and Distribution License.",
    "Licensed under the terms of the Example Community Licence, version 7.",
    "Licensed under the Elastic License 2.0; you may not provide the software to third parties as a hosted or managed service.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3",
    "This package is made available under the Vendor Source Available Licence.",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: EPL-2.0 OR BSL-1.0",
]
#: and its temperature and threshold are set on these.
OTHERS_HELD_OUT = [
    "Released under the Academic Free License version 3.0.",
    "This work is licensed under the Open Government Licence v3.0.",
    "Licensed under the Artistic License 2.0.",
    "This material is licensed under the Example Media Licence, third edition.",
    "Use, reproduction and distribution are subject to the Server Side Public License.",
    "The package may be used under the terms of the PHP License, version 3.01.",
]
#: Ordinary text with words that notices use.
PLAIN = [
    "The driver lost his license after the accident and had to apply for a new one.",
    "Researchers at MIT released a new study on batteries this week.",
    "The Apache helicopter landed near the village in the general area.",
    "The public library reserved a room for the meeting under the old terms.",
    "You may obtain a copy of the report at the front desk free of charge.",
    "General elections were held and the government received a mandate from the public.",
    "The foundation published its annual report without modification.",
    "All seats for the concert are reserved and no tickets are available.",
    "All rights of way across the common were closed and reserved for riders.",
    "The right of passage was reserved for ships of the allied powers.",
    "He used the source of the river to find his way through the common land.",
    "Fishing without a licence is prohibited in this lake by the state.",
    "Version 2.0 of the game was released in May and players liked it.",
    "Commercial use of the harbour has grown and many ships are distributed along the coast.",
    "The copyright debate in parliament lasted all night and ended without a vote.",
    "This work is important and was written in the last year of the war.",
    "The software was free for schools and the authors shared the source with anyone who asked.",
    "The court held that the author was not liable for damages in tort or contract.",
    "The minister granted permission to build the bridge, provided that the following winter was mild.",
    "Conditions were met with concern by the contributors to the fund.",
    "Any person who holds a copy of the first edition may sell it for a good price.",
    "The names of its members may be used in the newspaper with their written permission.",
    "The warranty on the washing machine is limited to two years from the date of purchase.",
    "Her attribution of the painting to the master was shared alike by critics.",
]
PLAIN_HELD_OUT = [
    "All rights of passage were reserved by the harbour master.",
    "The band released a new version of the song under another name.",
    "They were granted a license to sell beer in the public garden, free of charge.",
    "No person may copy the keys of the building without permission of the owner.",
    "The general published his memoirs, and the foundation distributed copies to all schools.",
    "The disclaimer at the end of the programme was read out very fast.",
]

#: The beginnings of SPDX identifiers, longest first.
SPDX = {
    "apache": "apache", "mit": "mit", "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "mpl": "mpl",
    "cc-by-sa": "cc_by_sa", "cc-by-nc": "cc_by_nc", "cc-by-nd": "unknown", "cc-by": "cc_by", "cc0": "public_domain", "unlicense": "public_domain",
}
