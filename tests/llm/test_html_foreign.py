from __future__ import annotations

import pytest

from surveyframe.llm.html_text import visible_text

PAGES = [
    ("a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> b", "a x=1 b"),
    ("a<svg><title>no</title><desc>no</desc> no <text x=1>one <tspan>two</tspan></text>"
     "<text>three</text></svg>b", "a one two three b"),
    ("<svg><defs><text>no</text></defs><rect width='1'/><text/><text>yes</text></svg>", "yes"),
    ("<svg><title/><text>yes</text></svg> more", "yes more"),
    ("<svg><path d='M0'/>no</svg>yes", "yes"), ("<svg hidden><text>no</text></svg>yes", "yes"),
    ("<svg><foreignObject><p>in</p></foreignObject></svg>", "in"),
    ("a<dialog>no</dialog>b", "ab"), ("a<dialog open><p>yes</p></dialog>b", "a\n\nyes\n\nb"),
    ("<dialog data-x=open>no</dialog>b", "b"), ("<desc>yes</desc><text>yes</text>", "yesyes"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_formulas_drawings_and_dialogs(html, text):
    assert visible_text(html) == text
