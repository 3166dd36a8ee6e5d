"""HTML to text."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.strings import let, lookup, strip

# What an entity stands for, with its semicolon where it needs one: the standard's own table.
_NAMED = "\x01".join(f"{name}\x02{text}" for name, text in sorted(html5.items()))
# Names that are known without a semicolon too, longest first.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
# Numbers 128 to 159 stand for the letters of the code page that pages of that time were written in.
_OLD_CODES = {str(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

_PIECES = r"&#[0-9]{1,7};?|&#[xX][0-9a-fA-F]{1,6};?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"


def _numeric(ref: Column) -> Column:
    digits = F.regexp_extract(ref, r"^&#[xX]?([0-9a-fA-F]+);?$", 1)
    code = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")

    def character(number: Column) -> Column:
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        as_hex = F.lpad(F.hex(F.when(valid, number).otherwise(F.lit(0xFFFD))), 8, "0")
        return F.coalesce(lookup(_OLD_CODES, number.cast("string")), F.decode(F.unhex(as_hex), "UTF-32"))

    return let(code, character)


def _named(ref: Column) -> Column:
    """A name from the table, else the longest known beginning that needs no semicolon, else as it is."""
    # One constant that the optimizer folds; thousands of literals would make every plan slow to build.
    table = F.str_to_map(F.lit(_NAMED), F.lit("\x01"), F.lit("\x02"))
    name = F.substr(ref, F.lit(2))
    bare = F.regexp_extract(name, f"^({_BARE})", 1)
    begun = let(bare, lambda b: F.when(b != "", F.concat(F.try_element_at(table, b), F.substr(name, F.length(b) + 1))))
    return F.coalesce(F.try_element_at(table, name), begun, ref)


def unescape(c: Column) -> Column:
    """Decode entities once, in one pass over the text: numbers, and all names of the standard."""

    def decode(text: Column) -> Column:
        def piece(p: Column) -> Column:
            is_reference = F.startswith(p, F.lit("&")) & (F.length(p) > 1)
            decoded = F.when(F.startswith(p, F.lit("&#")), _numeric(p)).otherwise(_named(p))
            return F.when(is_reference, decoded).otherwise(p)

        parts = F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), piece)
        return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)

    return let(c, decode)


def collapse_phrases(c: Column) -> Column:
    """One line per phrase: lines are trimmed, cut at double blanks, and empty pieces dropped."""
    lines = F.transform(F.split(c, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"), strip)
    phrases = F.flatten(F.transform(lines, lambda line: F.split(line, "  ")))
    return F.array_join(F.filter(F.transform(phrases, strip), lambda p: p != ""), "\n")


# Elements that the standard lays out as blocks of their own, and those that start a line.
_BLOCKS = "address|article|aside|blockquote|body|dd|details|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|main|nav|ol|p|pre|section|table|tbody|td|th|tr|ul"
_LINES = "br|li"
_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_PARAGRAPH = "\x02"


def strip_html(c: Column, keep_paragraphs: bool = False) -> Column:
    """Text of an HTML fragment (also of an escaped one), in built-in functions only.

    Script and style go with their content, comments and declarations go, entities are
    decoded before, while and after the tags are removed, as doubly encoded bodies need.
    With ``keep_paragraphs`` block elements are paragraphs, with a blank line between them, and line breaks and
    list items start a line; without, tags leave nothing behind.
    """
    opened = unescape(c)
    without_code = F.regexp_replace(opened, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    without_notes = F.regexp_replace(without_code, r"(?s)<!--.*?-->|<![^>]*>|<\?[^>]*>", "")
    if keep_paragraphs:
        # Blocks are marked before the tags go, by a character that the text itself doesn't keep.
        marked = F.regexp_replace(F.replace(without_notes, F.lit(_PARAGRAPH), F.lit("")), rf"(?i)</?(?:{_BLOCKS})(?=[\s/>]){_ATTRIBUTES}>", _PARAGRAPH)
        without_notes = F.regexp_replace(marked, rf"(?i)</?(?:{_LINES})(?=[\s/>]){_ATTRIBUTES}>", "\n")
    text = F.regexp_replace(without_notes, rf"</?[a-zA-Z]{_ATTRIBUTES}>", "")
    clean = lambda t: unescape(collapse_phrases(unescape(t)))
    if keep_paragraphs:
        parts = F.filter(F.transform(F.split(text, _PARAGRAPH), clean), lambda p: p != "")
        return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(F.array_join(parts, "\n\n"))
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(clean(text))
