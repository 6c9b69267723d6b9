"""Text as Spark columns: ASCII folding, tokens, addresses, HTML to text. No Python runs in these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tokens of this many bytes or more are not indexed.
LONGEST_TOKEN = 40
HIDDEN_LINK = "[lien externe]"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ascii_lower(value: Column | str) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(_col(value), UPPER, LOWER)


def alnum_tokens(value: Column | str) -> Column:
    """Runs of letters and digits, ASCII-folded; empty for null."""
    parts = F.split(ascii_lower(F.coalesce(_col(value), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda x: x != "")


def tokens(value: Column | str) -> Column:
    """Index tokens: runs of letters and digits in (Unicode) lower case, shorter than ``LONGEST_TOKEN`` bytes."""
    parts = F.split(F.lower(F.coalesce(_col(value), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda x: (x != "") & (F.octet_length(x) < LONGEST_TOKEN))


def bracketed_addresses(value: Column | str) -> Column:
    """Each address written in angle brackets, ASCII-folded."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(_col(value), F.lit(""))), F.lit("<([^<>]*)>"), 1)


def bare_addresses(value: Column | str) -> Column:
    """Each address written without brackets, ASCII-folded."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(_col(value), F.lit(""))), F.lit(r"([^\s<>,;:\"()]+@[^\s<>,;:\"()]+)"), 1)


def address_values(value: Column | str) -> Column:
    """What an address filter matches: tokens and whole addresses, sorted and distinct."""
    found = F.concat(alnum_tokens(value), bracketed_addresses(value), bare_addresses(value))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def hide_urls(value: Column | str) -> Column:
    """Words that begin like a URL become a fixed mark; white space becomes single spaces."""
    words = F.filter(F.split(F.coalesce(_col(value), F.lit("")), r"\s+"), lambda w: w != "")
    hidden = F.transform(words, lambda w: F.when(w.startswith("http://") | w.startswith("https://") | w.startswith("www."), HIDDEN_LINK).otherwise(w))
    return F.array_join(hidden, " ")


def html_text(value: Column | str) -> Column:
    """Visible text of HTML: script and style contents and tags go; ``br``, ``/p`` and ``/div`` part words.

    Entities are decoded once each in the order nbsp, amp, lt, gt, so ``&amp;lt;`` becomes ``<``. URLs are hidden.
    """
    text = F.coalesce(_col(value), F.lit(""))
    text = F.regexp_replace(text, r"(?is)<\s*(?:script|style)[^>]*>.*?(?:<\s*/(?:script|style)[^>]*>|$)", "")
    text = F.regexp_replace(text, r"(?i)<\s*(?:br|/p|/div)[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*(?:>|$)", "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return hide_urls(text)


def snippet(value: Column | str, chars: int = 180) -> Column:
    """The first characters of a body; empty for null."""
    return F.substring(F.coalesce(_col(value), F.lit("")), 1, chars)


def labels(value: Column | str) -> Column:
    """The strings of a JSON array; empty if it isn't one."""
    return F.coalesce(F.from_json(_col(value), "array<string>"), F.array().cast("array<string>"))


def decode_base64url(value: Column | str) -> Column:
    """Bytes of base64url text, padded or not; null if it isn't valid."""
    text = F.translate(F.regexp_replace(_col(value), "=+$", ""), "-_", "+/")
    padded = F.concat(text, F.substring(F.lit("==="), 1, F.pmod(-F.length(text), F.lit(4)).cast("int")))
    return F.when(_col(value).rlike(r"^[A-Za-z0-9_-]*={0,2}$"), F.try_to_binary(padded, F.lit("base64")))
