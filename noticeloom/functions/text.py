"""Column functions for text: blanks, HTML, escaping, descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blanks of the web's scripts, which Spark's own classes do not match; fixed values.
BLANK = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
BLANKS = f"[{BLANK}]+"
#: Verbs on which a description must not end; fixed values.
DANGLING = ("check", "contact", "email", "request", "return", "seek", "visit", "call", "follow", "dispose", "get", "receive", "obtain")


def squash(text: Column) -> Column:
    """Every run of blanks becomes one, none at the ends; null stays null."""
    return F.btrim(F.regexp_replace(text, BLANKS, " "))


def blank_to_null(text: Column) -> Column:
    return F.when(squash(text) != "", text)


def strip_html(html: Column) -> Column:
    """The text of a page: scripts, styles and tags go, two entities are read, blanks squashed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    return squash(F.replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")))


def strip_tags(html: Column) -> Column:
    return squash(F.regexp_replace(html, "<[^>]+>", " "))


def clean_fragment(html: Column) -> Column:
    """A fragment without fenced blocks, scripts and styles, trimmed."""
    text = F.regexp_replace(html, r"(?s)```.*?```", "")
    text = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", "")
    return F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def cut_ellipsis(text: Column, most: int = 160) -> Column:
    """A longer text cut three characters short, back to a word's end, with dots."""
    text = squash(text)
    return F.when(F.char_length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most - 3), r"\s+\S*$", ""), F.lit("..."))).otherwise(text)


def cut_sentence(text: Column, fallback: Column | None = None, most: int = 170) -> Column:
    """A description that ends like a sentence; one that would end on a dangling verb gives way to the fallback."""

    def short(t: Column) -> Column:
        whole = F.regexp_replace(F.substring(t, 1, most - 3), r"\s+\S*$", "")
        return F.when(F.char_length(t) > most, F.btrim(F.regexp_replace(whole, r"[,:;–-]+$", ""))).otherwise(t)

    out = short(F.regexp_replace(squash(text), r"\s*(\.\.\.|…)$", ""))
    if fallback is not None:
        out = F.when(F.lower(out).rlike(rf"\b({'|'.join(DANGLING)})\.?$"), short(squash(fallback))).otherwise(out)
    return F.when((out != "") & ~out.rlike(r"[.!?]$"), F.concat(out, F.lit("."))).otherwise(out)


def cut_word(text: Column, most: int = 160, least: int = 40, mark: str = "...") -> Column:
    """Cut at the last blank beyond ``least`` characters, else at ``most``."""
    return cut_squashed(squash(text), most, least, mark)


def cut_squashed(text: Column, most: int = 160, least: int = 40, mark: str = "...") -> Column:
    """``cut_word`` of a text whose blanks are squashed already."""
    at_blank = F.nullif(F.regexp_extract(text, f"(?s)^(.{{{least + 1},{most - 1}}}) ", 1), F.lit(""))
    return F.when(F.char_length(text) > most, F.concat(F.btrim(F.coalesce(at_blank, F.substring(text, 1, most))), F.lit(mark))).otherwise(text)


def cut_hard(text: Column, most: int) -> Column:
    text = squash(text)
    return F.when(F.char_length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def clip(text: Column, most: int, mark: str = "…") -> Column:
    """The first ``most`` characters and a mark, or the whole."""
    return F.when(F.char_length(text) > most, F.concat(F.btrim(F.substring(text, 1, most)), F.lit(mark))).otherwise(text)
