import pytest

from tests.llm.data import corpus, frame
from tessera.llm import licences

LINES = {
    "MIT": "Released under the MIT License.", "GPL": "This work is licensed under the GNU General Public License, version 3.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "proprietary": "All rights reserved.", "CC-BY": "Licensed under CC BY 4.0.", "BSD": "released under the BSD 3-clause license",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus()
    rows += [(1000 + i, f"{corpus()[i][1]}\n{line}\nend of it") for i, line in enumerate(LINES.values())]
    rows += [(2000, "He lost his license.\nThe general spoke."), (2001, "\n".join(LINES.values())), (2002, "word " * 30_000 + LINES["MIT"] + " word" * 30_000), (2003, "copyright of a license of software, public"), (2004, None), (2005, "")]
    df = frame(spark, rows)
    out = licences.scan(df).collect()
    assert len(out) == df.count()
    return {r.doc_id: r for r in out}


def test_families(found):
    for i, family in enumerate(LINES):
        r = found[1000 + i]
        assert (r.families, r.n_licence) == (family, 1) and 0.5 < r.probability <= 1
    assert found[2001].families == ",".join(sorted(LINES)) and found[2002].families == "MIT"


def test_unknown(found):
    for i in (2000, 2003, 2004, 2005):
        assert found[i].families == "" and found[i].n_licence == 0 and found[i].probability == 0
    assert found[2003].n_unknown == 1
    assert all(found[i].families == "" for i, _ in corpus())


NOTICES = {
    "GPL": "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published",
    "BSD": "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted, provided that",
}


def test_wrapped_and_several(spark):
    """Notices over several lines, and several in one line or one paragraph, are all found."""
    rows = [(i, f"plain words here\n\n{text}\n \nend of it") for i, text in enumerate(NOTICES.values())]
    rows += [(10, "This file may be used in two ways. Released under the MIT License. Or, at your choice: Licensed under the Apache License, Version 2.0."), (11, "\n".join(NOTICES.values())), (12, " ".join(NOTICES.values()).replace("\n", " "))]
    found = {r.doc_id: r for r in licences.scan(frame(spark, corpus() + [(i + 5000, t) for i, t in rows], False)).collect()}
    for i, family in enumerate(NOTICES):
        assert (found[5000 + i].families, found[5000 + i].n_licence) == (family, 1)
    assert found[5010].families == "Apache-2.0,MIT"
    assert found[5011].families == found[5012].families == "BSD,GPL,ISC"


#: Wordings as they stand in published sources, none of them a template, by family.
PUBLISHED = [
    ("GPL", "# This program is free software; you can redistribute it and/or modify it under\n# the terms of the GNU General Public License as published by the Free Software\n# Foundation; either version 2 of the License, or (at your option) any later\n# version."),
    ("BSD", " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n * 1. Redistributions of source code must retain the above copyright\n *    notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies."),
    ("MIT", "// SPDX-License-Identifier: MIT"), ("GPL", "/* SPDX-License-Identifier: GPL-2.0-only */"), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("BSD", "(* SPDX-License-Identifier: BSD-3-Clause OR Zlib *)"),
    ("MIT", "The source is available under the MIT licence."), ("Apache-2.0", "You may use it under the terms of the Apache license."), ("GPL", "This program is GPLv3."),
    ("MIT", "This project is made available under the MIT License; see the file LICENSE for details."), ("MIT", "MIT licensed? Yes: code in this folder is published under the MIT license."),
    ("Apache-2.0", "This software is released under version 2.0 of the Apache License.\nThis project is distributed under the Apache License 2.0."),
    ("Apache-2.0", " * Licensed to the foundation under one or more agreements. You may not use\n * this file except in compliance with the License.  You may obtain a copy of\n * the License at\n *     http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL", "It is free software, released under the GNU GPL version 3 or later."), ("GPL", "Distributed under the GNU General Public Licence v2."),
    ("LGPL", "The library may be used under the GNU Lesser General Public License 2.1."), ("LGPL", "Parts of it are covered under the LGPL v3."), ("AGPL", "The server is offered under the GNU Affero General Public License."), ("AGPL", "Licence: AGPLv3 or later"),
    ("BSD", "Code is provided under the 3-clause BSD license.\nIt is licensed under the BSD license."), ("BSD", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products\nderived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file"), ("MPL-2.0", "Contents are made available under the Mozilla Public License version 2."),
    ("CC-BY", "This article is distributed under the terms of the Creative Commons Attribution 4.0 International License"), ("CC-BY-SA", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    ("CC-BY-NC", "Images are shared under the Creative Commons Attribution-NonCommercial license."), ("CC-BY-SA", "Photographs by the author are licensed under CC BY-SA 4.0"), ("CC0", "Data is released under the CC0 1.0 Universal dedication."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction"),
    ("proprietary", "Copyright 2019 A. Firm. All Rights Reserved."), ("proprietary", "No part of this book may be reproduced or transmitted in any form without the prior written permission of the publisher."),
]
#: Plain sentences that grant nothing.
PLAIN = [
    "She got her driving licence under the old rules.", "The council is licensed under the act to sell wine.", "He works at MIT and studies the Apache people.", "The general public was admitted under the terms of the lease.",
    "Software is sold under the name of the firm.", "The terms of the agreement were published.", "All members reserved their seats.", "A free copy of the notice was sent to any person who asked.", "Creative people share common attributes.",
    "The rights of the public are not reserved to lawyers.", "Redistribution of wealth takes many forms.", "The source of the river is subject to debate.", "Permission was granted without fee.", "Mit der Lizenz kam das Auto, und mit dem Auto die Freiheit.",
    "Version 2.0 of the plan was released.", "The foundation published a general report.", "Parts of the software were modified by two persons.", "He lost the license of the pub, and the public with it.", "BSD is an operating system.", "The new license plate was made of tin.",
]


def test_published_wordings(spark):
    """Precision and recall on wordings that the templates do not contain."""
    templates = {t for _, t, _ in licences.TEMPLATES}
    texts = [t for _, t in PUBLISHED] + PLAIN
    assert not templates & set(texts)
    rows = [(5000 + i, f"some words\n\n{t}\n\nend of it") for i, t in enumerate(texts)]
    found = {r.doc_id: r.families for r in licences.scan(frame(spark, corpus() + rows, False)).collect()}
    missed = [(f, t, found[5000 + i]) for i, (f, t) in enumerate(PUBLISHED) if f not in found[5000 + i].split(",")]
    wrong = [(t, found[5000 + i]) for i, t in enumerate(texts) if set(found[5000 + i].split(",")) - {"", dict((t, f) for f, t in PUBLISHED).get(t)}]
    assert len(missed) <= 0.07 * len(PUBLISHED), missed
    assert len(wrong) <= 0.04 * len(texts), wrong


def test_rows_of_one_id(spark):
    """Rows that share an id, or have none, keep their own findings."""
    rows = [(None, LINES["MIT"]), (None, LINES["GPL"]), (None, "plain words"), (3, LINES["MIT"]), (3, "nothing here"), (3, LINES["MIT"])]
    found = sorted((str(r.doc_id), r.families, r.n_licence) for r in licences.scan(frame(spark, rows, False)).collect())
    assert found == [("3", "", 0), ("3", "MIT", 1), ("3", "MIT", 1), ("None", "", 0), ("None", "GPL", 1), ("None", "MIT", 1)]


def test_empty(spark):
    assert licences.scan(frame(spark, corpus()).limit(0)).collect() == []
