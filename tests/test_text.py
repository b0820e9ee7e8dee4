import html

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ticketloom.functions import text as X
from ticketloom.operators import language, lexical


def apply(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_email_is_redacted(spark):
    (out,) = apply(spark, X.sanitize_pii, "My order is lost, email me at customer.test@example.com please")
    assert "[EMAIL]" in out and "customer.test@example.com" not in out


def test_phone_is_redacted(spark):
    (out,) = apply(spark, X.sanitize_pii, "Call me at (555) 123-4567 or 555-987-6543 regarding my shipment")
    assert out.count("[PHONE]") == 2 and "123-4567" not in out


def test_order_id_is_redacted(spark):
    (out,) = apply(spark, X.sanitize_pii, "My Amazon order 123-4567890-1234567 has not arrived yet!")
    assert "[ORDER_ID]" in out and "123-4567890-1234567" not in out


def test_redaction_order_and_boundaries(spark):
    out = apply(
        spark,
        X.sanitize_pii,
        "call 5551234567",
        "CIÓNUEADOMENTE",
        "word ABCDEFGHIJ word",
        "4111 1111 1111 1111",
        "a &amp; b",
        None,
        "   ",
    )
    assert out == ["call [ORDER_ID]", "CIÓNUEADOMENTE", "word [ORDER_ID] word", "[CREDIT_CARD]", "a & b", "", ""]


def test_full_width_digits_count_as_digits(spark):
    (out,) = apply(spark, X.sanitize_pii, "tel ５５５-９８７-６５４３")
    assert out == "tel [PHONE]"


def test_script_filter(spark):
    out = apply(
        spark, X.is_western_script, "こんにちは、荷物が届きません", "Where is my package today?", "ああ", None, "안녕하세요 여러분"
    )
    assert out == [False, True, True, True, True]


def test_entities_decode_like_the_standard_library(spark):
    samples = ["&amp;lt;", "&#39;x&#39;", "a&nbsp;b", "&eacute;&hellip;", "&lt;b&gt; &copy 2024", "AT&T", "&&& &#x1F600;"]
    assert apply(spark, X.html_unescape, *samples) == [html.unescape(s) for s in samples]
    nested = ["&amp;lt;", "&amp;eacute; x", "a &amp;amp; b", "AT&amp;T &lt;  b", "&&amp;#39;", "&nbsp; a &hearts;\n b"]
    want = [html.unescape(" ".join(html.unescape(s).split())).strip() for s in nested]
    assert apply(spark, X.clean_message, *nested) == want


def test_whitespace_is_unicode_aware(spark):
    out = apply(spark, X.normalize_text, " a　\n b\t", "@bob hi", None)
    assert out == ["a b", "@bob hi", ""]
    assert apply(spark, lambda c: X.normalize_text(c, True), "@bob_é hi") == ["hi"]


def test_keywords_match_substrings_in_list_order(spark):
    words = ("lawyer", "sue")
    text = "This issue goes to my LAWYER"
    assert apply(spark, lambda c: X.keyword_first(c, words), text, "an issue", "fine") == ["lawyer", "sue", None]
    assert apply(spark, lambda c: X.keyword_any(c, ("sue",)), "an issue") == [True]
    assert apply(spark, lambda c: X.keyword_any(c, ("sue",), True), "an issue", "sue me") == [False, True]


def test_length_counts_code_points(spark):
    assert apply(spark, lambda c: F.length(c), "😀a") == [2]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=20, max_size=20))
def test_redaction_is_idempotent(spark, texts):
    once = apply(spark, X.sanitize_pii, *[t.replace("&", "") for t in texts])
    assert apply(spark, X.sanitize_pii, *once) == once


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=20, max_size=20))
def test_normalising_equals_python(spark, texts):
    want = [" ".join(html.unescape(t).split()) for t in texts]
    assert apply(spark, X.normalize_text, *texts) == want


def test_language_is_the_same_with_a_profile_of_any_size(spark, monkeypatch):
    rows = [(1, "der hund und der kater"), (1, "the dog"), (2, "the dog and the cat"), (3, "der the the"), (4, "unknown"), (None, "the dog"), (5, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    profile = spark.createDataFrame([("de", "der", 0.4), ("de", "hund", 0.1), ("en", "the", 0.3), ("en", "dog", 0.2)], "lang string, token string, weight double")
    found = []
    for terms, size in ((10, 1 << 20), (1, 20)):
        monkeypatch.setattr(language, "SENT_TERMS", terms)
        monkeypatch.setattr(lexical, "_PART_BYTES", size)
        found.append({(r.id, r.detected, r.score) for r in language.detect_language(df, "id", "text", profile).collect()})
    assert found[0] == found[1] == {(1, "de", 0.9), (2, "en", 0.8), (3, "en", 0.6), (None, "en", 0.5)}
