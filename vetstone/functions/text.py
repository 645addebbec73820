"""String measures of secret detection, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per byte-character, 0 for an empty string."""
    chars = F.split(value, "")
    n = F.length(value)
    parts = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(F.lit(0.0))


def is_digest(value: Column) -> Column:
    """Hexadecimal of a length that digests have."""
    return value.rlike("^[0-9A-Fa-f]+$") & F.length(value).isin(32, 40, 56, 64, 96, 128)


def is_uuid(value: Column) -> Column:
    return value.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")


def in_url(before: Column) -> Column:
    """Whether the text before a token ends within a URL."""
    return before.rlike("://[^\\s\"'`<>()\\[\\]{}]*$")


def masked(value: Column) -> Column:
    """What may be shown of a secret: its ends if it has more than 8 characters, else nothing."""
    n = F.length(value)
    ends = F.concat(F.substring(value, F.lit(1), F.lit(2)), F.lit("****"), F.substring(value, n - 1, F.lit(2)))
    return F.when(n > 8, ends).otherwise(F.repeat(F.lit("*"), n))


def redacted(text: Column) -> Column:
    """Bearer tokens, cloud access keys and what is assigned to a name that ends like a secret's made unreadable; the
    words before stay. The names' beginnings needn't be matched to stay."""
    gone = "***REDACTED***"
    # Which words make a secret, and what ends its value.
    text = F.regexp_replace(text, "(?iU)(bearer\\s+)[A-Za-z0-9._\\-]+", f"$1{gone}")
    text = F.regexp_replace(text, "(?U)\\b(AKIA)[0-9A-Z]{16}\\b", f"$1{gone}")
    return F.regexp_replace(text, "(?iU)((?:key|secret|token|password|passwd|authorization)\\s*[:=]\\s*)\"?[^\"\\s]+\"?", f"$1{gone}")


def capped(text: Column, most: int) -> Column:
    """At most `most` bytes, cut between characters, with a note of what is missing."""
    size = F.octet_length(text)
    # the longest prefix of whole characters: the cut falls back to the last character that fits
    head = F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), 1, most).cast("string"))
    head = F.regexp_replace(head, "\ufffd+$", "")
    return F.when(size > most, F.concat(head, F.lit("… ["), size - F.octet_length(head), F.lit(" bytes truncated]"))).otherwise(text)
