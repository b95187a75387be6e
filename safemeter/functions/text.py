"""Prompt text as column expressions: hashes and the decodings a judge looks through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_TURNED = _LOWER[13:] + _LOWER[:13]
# The digit spellings that are undone, and the letters they stand for.
LEET_DIGITS, LEET_LETTERS = "4310$7", "aeiost"
#: Shortest token that may be base64.
BASE64_LENGTH = 12


def prompt_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def rot13(text: Column) -> Column:
    return F.translate(text, _LOWER + _LOWER.upper(), _TURNED + _TURNED.upper())


def leet(text: Column) -> Column:
    return F.translate(text, LEET_LETTERS, LEET_DIGITS)


def unleet(text: Column) -> Column:
    return F.translate(text, LEET_DIGITS, LEET_LETTERS)


def base64_decodings(text: Column) -> Column:
    """Decodings, in order, of the tokens of ``text`` that can be base64; bytes that are not UTF-8 are dropped.

    A token counts when it has 12 characters or more, is alphanumeric before its trailing
    ``=`` signs, and these are enough for its length.
    """
    tokens = F.regexp_extract_all(text, F.lit(rf"(?U)[^\s]{{{BASE64_LENGTH},}}+"), F.lit(0))
    parts = F.transform(tokens, lambda t: F.struct(t.alias("t"), F.regexp_replace(t, "=+$", "").alias("body")))

    def decodable(x: Column) -> Column:
        c, p = F.length(x["body"]), F.length(x["t"]) - F.length(x["body"])
        padded = (c % 4 == 0) | ((c % 4 == 2) & (p >= 2)) | ((c % 4 == 3) & (p >= 1))
        return x["body"].rlike("^[A-Za-z0-9]+$") & padded

    def decoded(x: Column) -> Column:
        whole = F.rpad(x["body"], (F.ceil(F.length(x["body"]) / 4) * 4).cast("int"), "=")
        return F.replace(F.make_valid_utf8(F.unbase64(whole).cast("string")), F.lit("�"), F.lit(""))

    return F.transform(F.filter(parts, decodable), decoded)


def effective_text(text: Column) -> Column:
    """The lowered text and each of its decodings, lowered, joined by single spaces."""
    decodings = F.concat(base64_decodings(text), F.array(rot13(text), unleet(text)))
    return F.concat_ws(" ", F.lower(text), F.transform(decodings, F.lower))


def contains_any(text: Column, phrases: list[str] | tuple[str, ...]) -> Column:
    """Whether ``text`` holds one of ``phrases``; the text is bound to a name, so it is computed once."""
    listed = F.array(*map(F.lit, phrases))
    return F.element_at(F.transform(F.array(text), lambda t: F.exists(listed, lambda p: t.contains(p))), 1)
