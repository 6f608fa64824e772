import html
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leadweave.functions import text
from leadweave.operators.cleaning import clean_strings


def model(value):
    value = re.sub("[​‌‍﻿­]", "", html.unescape(value)).replace(" ", " ")
    return re.sub(r"\s+", " ", value).strip()


CASES = [
    ("Smith &amp; Johnson&#39;s &lt;Corp&gt;", "Smith & Johnson's <Corp>"),
    ("123​ Main‌ St‍﻿", "123 Main St"),
    ("Acme­Plumbing", "AcmePlumbing"),
    ("123 Main St", "123 Main St"),
    ("  Acme   Plumbing  \n Services  ", "Acme Plumbing Services"),
    ("  Hello  ", "Hello"),
    ("&amp;nbsp;", "&nbsp;"),
    ("&nbsp;x&nbsp;", "x"),
    ("&amp;lt;b&amp;gt;", "&lt;b&gt;"),
    ("caf&eacute; &#x41;&#66; &copyright &notit; AT&T & Co", "café AB ©right ¬it; AT&T & Co"),
    ("\x1ca\x1d b\u0085c", "a b c"),
    ("", ""),
    (None, None),
]


def test_clean_cases(column):
    assert column(text.clean_text, [c[0] for c in CASES]) == [c[1] for c in CASES]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab &;#xlgtampnbsp39 \n\t​ ­ \x1c", max_size=24), min_size=20, max_size=60))
def test_clean_equals_model(column, values):
    assert column(text.clean_text, values) == [model(v) for v in values]


def test_other_types_untouched(spark):
    row = clean_strings(spark.createDataFrame([(" a ", 42, None)], "s string, n int, r double")).first()
    assert tuple(row) == ("a", 42, None)


@pytest.mark.parametrize("value,want", [
    ("Plumbing & Heating", "plumbing-heating"), ("New York, NY", "new-york-ny"), ("a" * 100, "a" * 100),
    ("--x--", "x"), ("", ""),
])
def test_slug(column, value, want):
    assert column(text.slug, [value]) == [want]
