"""Licences in headers, whole files and single lines, and rows without an id."""

import textwrap

from quillon.llm.license_scan import TEMPLATES, license_scan

LONG = {}
for _n, _t in TEMPLATES:
    LONG.setdefault(_n, _t)
    LONG[_n] = max(LONG[_n], _t, key=len)


def commented(text, mark, width=70):
    return "\n".join(f"{mark} {x}" for x in textwrap.wrap(text, width))


GPL3 = LONG["GPL-3.0"].split(" This program is distributed")
FILES = {
    # whole licence files, in paragraphs
    "bsd/LICENSE": ("BSD-3-Clause", "own", "Copyright (c) 2020, Foo Bar\n\n" + "\n\n".join(textwrap.fill(x, 78) for x in LONG["BSD-3-Clause"].replace("THIS SOFTWARE", "@THIS SOFTWARE").split("@"))),
    "mit/LICENSE.txt": ("MIT", "own", "MIT License\n\nCopyright (c) 2021 Somebody Else\n\n" + textwrap.fill(LONG["MIT"].removeprefix("MIT License "), 78)),
    "gpl/COPYING": ("GPL-3.0", "own", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n\n                            Preamble\n\n  The licence text goes on for very many lines about freedom and copying\nof works that nobody compares with a template.\n"),
    "apache/LICENSE": ("Apache-2.0", "own", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n"),
    # headers
    "a/x.py": ("Apache-2.0", "own", "# Copyright 2020 The Foo Authors\n#\n" + commented(LONG["Apache-2.0"], "#") + "\n\nimport os\n\nprint(os.name)\n"),
    "a/y.c": ("GPL-3.0", "own", "/*\n * foo.c - a program\n *\n" + commented(" ".join(GPL3), " *") + "\n */\n\nint main() { return 0; }\n"),
    "a/w.c": ("GPL-3.0", "own", "// wrapped, without the later paragraphs\n" + commented(GPL3[0], "//", 40) + "\n\nint x;\n"),
    "a/z.h": ("MIT", "own", commented(LONG["MIT"], "//", 50) + "\n#pragma once\n"),
    "a/b.go": ("BSD-3-Clause", "own", "// Copyright 2009 The Authors. \n" + commented("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "//", 40) + "\n\npackage b\n"),
    # lines
    "s/x.rs": ("MIT", "own", "// SPDX-License-Identifier: MIT\nfn main() {}\n"),
    "s/y.rs": ("GPL-2.0", "own", "#!/bin/sh\n# SPDX-License-Identifier: GPL-2.0-only\necho\n"),
    "s/z.rs": ("BSD-3-Clause", "own", "/* SPDX-License-Identifier: BSD-3-Clause */\nint z;\n"),
    # none of their own
    "mit/src/lib/x.py": ("MIT", "inherited", "print('the code')\n"),
    "bsd/x.py": ("BSD-3-Clause", "inherited", "import source, binary, forms, conditions\n"),
    "none/x.py": (None, None, "the software is here, without any statement of its licence\n"),
    "none/empty": (None, None, ""),
}


def test_units(spark):
    rows = [(k, p, t) for k, (p, (_, _, t)) in enumerate(FILES.items())]
    # rows without an id, one of them twice, and without a path
    rows += [(None, "n/x.txt", "Released under the MIT License."), (None, "n/y.txt", "nothing"), (None, "n/y.txt", "nothing"), (None, None, "Released under the MIT License."), (900, None, None), (901, "mit/src/z.py", None)]
    # words of ordinary files, so that a licence's are rare
    rows += [(1000 + k, f"other/{k}.txt", f"the and of to in is for with this or any by are a document about thing{k} and matter{k % 7}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3)
    got = license_scan(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for k, (path, (name, how, _)) in enumerate(FILES.items()):
        assert (by[k].license, by[k].how) == (name, how), (path, by[k])
    assert by[900].license is None and (by[901].license, by[901].directory) == ("MIT", "mit")
    assert sorted((r.license or "", r.how or "") for r in got if r.doc_id is None) == [("", ""), ("", ""), ("MIT", "own"), ("MIT", "own")]
    assert license_scan(df.limit(0)).count() == 0
