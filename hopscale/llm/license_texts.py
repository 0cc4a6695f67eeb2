"""Wording of public licence notices, for the licence scan.

Fixed values: passages of the notices as their licences have them. {{ }} marks key phrases, which a file
must hold word for word; a passage of which a file has other wording at those places is another licence.
"""

from __future__ import annotations

PASSAGES = (
    (
        "mit",
        'Permission is {{hereby granted, free of charge}}, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software {{without restriction}}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ),
    ("mit", "{{The above copyright notice and this permission notice shall be included in all copies or substantial portions}} of the Software"),
    (
        "apache-2",
        'you may not use this file {{except in compliance with the License}}. You may obtain a copy of the License at http://www.{{apache.org/licenses/LICENSE-2.0}} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND',
    ),
    (
        "apache-2",
        "Grant of Copyright License. Subject to the terms and conditions of this License, {{each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license}} to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    ),
    (
        "apache-2",
        "Grant of Patent License. Subject to the terms and conditions of this License, {{each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license}} to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work",
    ),
    ("gpl-3", "licensed under the {{GNU General Public License, version 3}}"),
    ("gpl-2", "licensed under the {{GNU General Public License, version 2}}"),
    (
        "gpl-3",
        "is free software: you can redistribute it and/or modify it under the terms of the {{GNU General Public License}} as published by the Free Software Foundation, either {{version 3}} of the License, or (at your option) any later version",
    ),
    (
        "gpl-2",
        "is free software; you can redistribute it and/or modify it under the terms of the {{GNU General Public License}} as published by the Free Software Foundation; either {{version 2}} of the License, or (at your option) any later version",
    ),
    (
        "lgpl-3",
        "you can redistribute it and/or modify it under the terms of the {{GNU Lesser General Public License}} as published by the Free Software Foundation, either {{version 3}} of the License",
    ),
    (
        "lgpl-2.1",
        "you can redistribute it and/or modify it under the terms of the {{GNU Lesser General Public License}} as published by the Free Software Foundation; either {{version 2.1}} of the License, or (at your option) any later version",
    ),
    (
        "agpl-3",
        "is free software: you can redistribute it and/or modify it under the terms of the {{GNU Affero General Public License}} as published by the Free Software Foundation, either {{version 3}} of the License, or (at your option) any later version",
    ),
    (
        "gpl-3",
        "{{The GNU General Public License is a free, copyleft license for software and other kinds of works}}. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    ),
    (
        "bsd",
        "{{Redistribution and use in source and binary forms}}, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code {{must retain the above copyright notice}}, this list of conditions and the following disclaimer",
    ),
    (
        "bsd",
        "{{Redistributions in binary form must reproduce the above copyright notice}}, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    (
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors {{may be used to endorse or promote products derived from this software without specific prior written permission}}",
    ),
    (
        "bsd",
        'THIS SOFTWARE IS PROVIDED BY {{THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES}}, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software {{for any purpose with or without fee is hereby granted, provided that}} the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "0bsd",
        'Permission to use, copy, modify, and/or distribute this software {{for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED}} "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE',
    ),
    (
        "zlib",
        "{{Permission is granted to anyone to use this software for any purpose}}, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software {{must not be misrepresented}}; you must not claim that you wrote the original software",
    ),
    (
        "bsl-1",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of {{the software and accompanying documentation covered by this license}} (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software',
    ),
    ("mpl-2", "This Source Code Form is subject to the terms of the {{Mozilla Public License, v. 2.0}}. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("mpl-2", "This Source Code Form is subject to the terms of the {{Mozilla Public License, v. 2.0}}"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the {{Eclipse Public License 2.0}} which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("unlicense", "This is {{free and unencumbered software}} released into the public domain"),
    (
        "unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in {{source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means}}",
    ),
    ("cc0", "To the extent possible under law, the author(s) {{have dedicated all copyright and related and neighboring rights}} to this software to the public domain worldwide. This software is distributed without any warranty"),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. {{You just DO WHAT THE FUCK YOU WANT TO}}"),
    ("ofl-1.1", "This Font Software is licensed under the {{SIL Open Font License, Version 1.1}}. This license is copied below, and is also available with a FAQ at"),
    ("artistic-2", "This program is free software; you can redistribute it and/or modify it under the terms of the {{Artistic License 2.0}}"),
    (
        "postgresql",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, {{without fee, and without a written agreement is hereby granted}}, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    ),
    ("cc-by", "licensed under a {{Creative Commons Attribution 4.0}} International License"),
    ("cc-by-sa", "licensed under a {{Creative Commons Attribution-ShareAlike}} 4.0 International License"),
    ("cc-by-nc", "licensed under a {{Creative Commons Attribution-NonCommercial}} 4.0 International License"),
    ("cc-by-nd", "licensed under a {{Creative Commons Attribution-NoDerivatives}} 4.0 International License"),
)
