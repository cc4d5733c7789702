"""Links in HTML pages."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMENT = r"(?s)<!--.*?-->"
RAW_TEXT = r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>"
# One attribute: a name, then perhaps a quoted or a bare value. Quoted values may hold ">".
ATTRIBUTE = r"[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)?+"
ANCHOR = rf"(?i)<a[\s/]((?:[\s/]*+{ATTRIBUTE})*+)[\s/]*+>"
# A reference: a number, or up to 32 characters of a name; the semicolon may be missing.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|&|[^&]+"
# The named references of HTML, as the standard library lists them: those that end in a
# semicolon, and the older ones that also count without it, at the begin of any name.
NAMED = dict(html.entities.html5)
OLDER = sorted((n for n in NAMED if not n.endswith(";")), key=len, reverse=True)
# Numbers 80 to 9F mean what they mean in Windows-1252.
WINDOWS = [bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in range(0x80, 0xA0)]
_REPLACEMENT = "\ufffd"


def visible_markup(markup: Column) -> Column:
    """Markup without comments and script or style bodies, whose text holds no elements."""
    return F.regexp_replace(F.regexp_replace(markup, COMMENT, ""), RAW_TEXT, "")


def _character(code: Column) -> Column:
    """What a number stands for; nothing where it is no character, the replacement character where it can't be one."""
    unfit = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
    nothing = control | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    windows = F.element_at(F.array(*map(F.lit, WINDOWS)), (code - 0x7F).cast("int"))
    text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(unfit, _REPLACEMENT).when(code.between(0x80, 0x9F), windows).when(nothing, "").otherwise(text)
    )


def _number(piece: Column, prefix: str, digits: int, base: int) -> Column:
    """The number of a reference; null where it has too many digits to be a character."""
    body = F.regexp_replace(F.regexp_replace(piece, f"^{prefix}0*|;$", ""), "^$", "0")
    return F.when(F.length(body) <= digits, F.conv(body, base, 10).cast("long"))


def decoded(text: Column) -> Column:
    """Text with all character references decoded; what is none stays as it is."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def one(piece: Column) -> Column:
        name = F.substr(piece, F.lit(2))
        older = F.regexp_extract(name, "^(?:" + "|".join(OLDER) + ")", 0)
        return (
            F.when(piece.rlike("^&#[xX][0-9a-fA-F]"), _character(_number(piece, "&#[xX]", 8, 16)))
            .when(piece.rlike("^&#[0-9]"), _character(_number(piece, "&#", 9, 10)))
            .when(
                piece.rlike("^&."),
                F.coalesce(
                    F.try_element_at(names, name),
                    F.when(older != "", F.concat(F.try_element_at(names, older), F.substr(name, F.length(older) + 1))),
                    piece,
                ),
            )
            .otherwise(piece)
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), one), "")


def page_links(pages: DataFrame, suffix: str, markup: str = "html") -> DataFrame:
    """One row per anchor with a non-empty target, in page order, flagged where it ends in ``suffix``.

    The target is the first attribute named exactly ``href``. ``link_pos`` counts all anchors that name one.
    """
    anchors = F.regexp_extract_all(visible_markup(F.col(markup)), F.lit(ANCHOR), F.lit(1))
    attributes = F.transform(anchors, lambda a: F.regexp_extract_all(a, F.lit(ATTRIBUTE), F.lit(0)))
    targets = F.transform(attributes, lambda a: F.get(F.filter(a, lambda x: x.rlike(r"(?i)^href(?:\s*=|$)")), F.lit(0)))
    named = F.filter(targets, lambda t: t.rlike("="))
    links = pages.select("page_id", "url", F.posexplode(named).alias("link_pos", "attribute"))
    bare = F.regexp_replace("attribute", r"(?is)^href\s*=\s*", "")
    value = F.when(bare.rlike("^[\"']"), F.substr(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    return (
        links.select("page_id", "url", "link_pos", decoded(value).alias("href"))
        .where(F.col("href") != "")
        .withColumn("is_match", F.endswith("href", F.lit(suffix)))
    )


def matching_links(pages: DataFrame, suffix: str = ".parquet") -> DataFrame:
    return page_links(pages, suffix).where("is_match").drop("is_match")
