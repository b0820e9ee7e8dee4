"""Column expressions for text: cleaning, redaction, keyword and script tests.

All of them run inside the JVM, except the full HTML entity table, which is an
Arrow UDF that only sees values holding an entity outside the common few.

Java's ``\\s``, ``\\d`` and ``\\b`` are ASCII unless ``(?U)`` is set, so every
pattern carries it to agree with Unicode-aware matching.
"""

from __future__ import annotations

import functools
import html
import operator
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Redaction patterns and their placeholders, in the order applied.
# The order is observable: a bare 10-digit phone number becomes an order id.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
CREDIT_CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b"
ORDER_ID = r"\b\d{3}-\d{7}-\d{7}\b|\b\d{17}\b|\b[A-Z0-9]{10,12}\b"
PHONE = r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
REDACTIONS = (
    ("email", EMAIL, "[EMAIL]"),
    ("credit_card", CREDIT_CARD, "[CREDIT_CARD]"),
    ("order_id", ORDER_ID, "[ORDER_ID]"),
    ("phone", PHONE, "[PHONE]"),
)
HANDLE = r"@[\p{L}\p{N}_]+"

# Whitespace as Python's str methods see it.
_SPACE = r"[\s\x1c-\x1f]"
# Hiragana, Katakana and the CJK unified ideographs.
_CJK = "[぀-ヿ一-鿿]"

# Entities decoded without leaving the JVM; "&amp;" goes last so
# that one pass never decodes twice.
_COMMON_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
    ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
)
_OTHER_ENTITY = r"&(?!(?:lt|gt|quot|#39|#x27|apos|nbsp|amp);)[#A-Za-z]"
_NESTED_ENTITY = r"&amp;[#A-Za-z]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _unescape_batch(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _clean_entities_batch(values: pd.Series) -> pd.Series:
    return values.map(
        lambda t: html.unescape(" ".join(html.unescape(t).split())), na_action="ignore"
    )


# Declared non-deterministic so that the optimizer evaluates a cleaned text once
# instead of repeating it in every filter it pushes down.
_unescape_batch = _unescape_batch.asNondeterministic()
_clean_entities_batch = _clean_entities_batch.asNondeterministic()


def _native_unescape(c: Column) -> Column:
    decoded = c
    for entity, char in _COMMON_ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def html_unescape(c: Column | str, full_table: bool = True) -> Column:
    """Decode HTML entities once.

    ``full_table=False`` keeps the whole expression in the JVM and is exact for
    text whose entities are all among the common ones.
    """
    c = _col(c)
    native = _native_unescape(c)
    if not full_table:
        return native
    other = F.contains(c, F.lit("&")) & c.rlike(_OTHER_ENTITY)
    return F.coalesce(_unescape_batch(F.when(other, c)), native)


def strip(c: Column | str) -> Column:
    """Trim any Unicode whitespace, not only blanks."""
    return F.regexp_replace(_col(c), f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), f"(?U){_SPACE}+", " "))


def strip_handles(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), HANDLE, "")


def normalize_text(
    c: Column | str, remove_handles: bool = False, full_entities: bool = True
) -> Column:
    """Unescape, collapse whitespace, trim; null becomes the empty string."""
    out = html_unescape(F.coalesce(_col(c), F.lit("")), full_entities)
    if remove_handles:
        out = strip_handles(out)
    return collapse_spaces(out)


def redact(c: Column | str, kind: str) -> Column:
    """Replace every match of one redaction pattern by its placeholder."""
    c = _col(c)
    pattern, token = {k: (p, t) for k, p, t in REDACTIONS}[kind]
    replaced = F.regexp_replace(c, f"(?U){pattern}", token)
    if kind == "email":
        return F.when(F.contains(c, F.lit("@")), replaced).otherwise(c)
    return replaced


def redact_all(c: Column | str) -> Column:
    out = _col(c)
    for kind, _, _ in REDACTIONS:
        out = redact(out, kind)
    return out


def sanitize_pii(c: Column | str, full_entities: bool = True) -> Column:
    """Unescape, redact in order, trim; null becomes the empty string."""
    return strip(redact_all(html_unescape(F.coalesce(_col(c), F.lit("")), full_entities)))


def clean_message(c: Column | str, full_entities: bool = True) -> Column:
    """The cleaning applied at ingest: normalise, then sanitise.

    Both steps decode entities.  Text without uncommon or nested entities has
    nothing left to decode after the first time; the rest goes through one UDF.
    """
    c = F.coalesce(_col(c), F.lit(""))
    decoded = collapse_spaces(_native_unescape(c))
    if full_entities:
        hard = F.contains(c, F.lit("&")) & c.rlike(f"{_OTHER_ENTITY}|{_NESTED_ENTITY}")
        decoded = F.coalesce(_clean_entities_batch(F.when(hard, c)), decoded)
    else:
        decoded = _native_unescape(decoded)
    return strip(redact_all(decoded))


def pii_count(c: Column | str, kind: str) -> Column:
    pattern = {k: p for k, p, _ in REDACTIONS}[kind]
    return F.regexp_count(_col(c), F.lit(f"(?U){pattern}")).cast("bigint")


def is_western_script(c: Column | str) -> Column:
    """False where Japanese or Chinese characters occur in a text of 5+ characters."""
    c = _col(c)
    short = c.isNull() | (F.length(strip(c)) < 5)
    return F.when(short, F.lit(True)).otherwise(~c.rlike(_CJK))


def keyword_any(
    c: Column | str, keywords: Sequence[str], whole_word: bool = False
) -> Column:
    """Whether any keyword occurs in the lower-cased text (as a substring by default)."""
    lowered = F.lower(_col(c))
    if whole_word:
        tests = [lowered.rlike(rf"(?U)\b\Q{k}\E\b") for k in keywords]
    else:
        tests = [F.contains(lowered, F.lit(k)) for k in keywords]
    return functools.reduce(operator.or_, tests, F.lit(False))


def keyword_first(c: Column | str, keywords: Sequence[str]) -> Column:
    """The first keyword, in list order, that occurs in the lower-cased text."""
    lowered = F.lower(_col(c))
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(k)), F.lit(k)) for k in keywords])


def words(c: Column | str) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.filter(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) > 1)


def space_tokens(c: Column | str) -> Column:
    """Lower-cased whitespace tokens of an already normalised text."""
    return F.filter(F.split(F.lower(_col(c)), " "), lambda t: t != F.lit(""))


def each(df: DataFrame, array: Column, name: str, *keep: Column | str) -> DataFrame:
    """One row per array element, as column ``name`` next to ``keep``.

    ``explode_outer`` plus a null filter: a plain ``explode`` makes the optimizer
    add a size test that evaluates the whole array expression a second time,
    below any repartitioning.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def stable_order(c: Column | str, seed: int = 42) -> Column:
    """A pseudo-random sort key that does not depend on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(c).cast("string")))
