from __future__ import annotations

import pyarrow as pa
import pytest

from surveyframe.llm import licenses, words as W

WIDE = "\n            *     "
LINES = [
    (WIDE.join("Permission is hereby granted, free of charge, to any person obtaining a copy of"
               " this software".split()), {"mit"}),
    (WIDE.join("Redistribution and use in source and binary forms, with or without"
               " modification".split()), {"bsd"}),
    (WIDE.join("GNU General Public License version 2 or (at your option) any later"
               " version".split()), {"gpl-2.0-or-later"}),
    (f"CC{WIDE}BY{WIDE}version{WIDE}4.0", {"cc-by-4.0"}),
    ("under GPLv3.", {"gpl-3.0"}), ("LGPL-2.1", {"lgpl-2.1"}), ("(Apache-2.0)", {"apache-2.0"}),
    ("MPL 2.0", {"mpl-2.0"}), ("GPLv2+", {"gpl-2.0-or-later"}),
    ("GPL-2.0-only", {"gpl-2.0-only"}), ("AGPL v3 or later", {"agpl-3.0-or-later"}),
    ("GPL3", {"gpl-3.0"}), ("Apache 2.0 web server", set()), ("GPLv32", set()),
    ("GPL 3.1", set()), ("xgpl-3.0", set()), ("SPDX-License-Identifier: Apache-2.0", {"apache-2.0"}),
]


@pytest.mark.parametrize("text, labels", LINES)
def test_wide_gaps_and_bare_names(text, labels):
    scanner = licenses.Scanner()
    present = scanner.keywords(*W.word_hashes(pa.array([text]), W.LETTER_OR_DIGIT))
    found = scanner.detections(text.lower(), present.get(0, set()))
    assert {rule.label for _, _, rule in found} == labels
