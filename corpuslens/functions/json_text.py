"""JSON held in text: strict validity and blocks inside free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strict_json(text: Column) -> Column:
    """True when the whole text is one JSON value.

    The variant parser stops behind the first value; wrapping the text both as an array and as
    a member makes trailing text, missing values and second values fail.
    """
    as_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return (
        F.try_variant_get(as_array, "$[0]", "variant").isNotNull()
        & F.try_variant_get(as_array, "$[1]", "variant").isNull()
        & as_member.isNotNull()
    )


def fenced_block(text: Column) -> Column:
    """Body of the first fenced block, or '' when there is none."""
    return F.regexp_extract(text, r"(?s)```(?:json)?\s*\n(.*?)```", 1)


def holds_json(text: Column) -> Column:
    """The whole text or its first fenced block is valid JSON."""
    return F.coalesce(strict_json(text), F.lit(False)) | F.coalesce(
        F.contains(text, F.lit("```")) & strict_json(fenced_block(text)), F.lit(False)
    )


def json_block(text: Column, kind: str = "object") -> Column:
    """Variant of the whole text, else of the span from the first opening to the last closing
    bracket; null when neither parses."""
    span = r"(?s)\{.*\}" if kind == "object" else r"(?s)\[.*\]"
    block = F.regexp_extract(text, span, 0)
    whole = F.when(strict_json(text), F.try_parse_json(text))
    return F.coalesce(whole, F.when(strict_json(block), F.try_parse_json(block)))
