"""Column functions on text, colours and file names; all run inside Spark's expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import LEADING_VERSE_NUMBER, QUOTE_MARKS, SPACE

# fixed values: ligatures and what they stand for
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


# fixed values: the characters that are white space
SPACES = "\t\n\v\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def is_blank(c: Column) -> Column:
    """Nothing but white space of any kind."""
    return F.translate(c, SPACES, "") == ""


def trim_spaces(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def collapse_ws(c: Column) -> Column:
    """Words joined by single spaces."""
    return trim_spaces(F.regexp_replace(c, f"{SPACE}+", " "))


def expand_ligatures(c: Column) -> Column:
    for one, many in LIGATURES.items():
        c = F.replace(c, F.lit(one), F.lit(many))
    return c


def unquote(c: Column) -> Column:
    c = trim_spaces(c)
    c = F.regexp_replace(F.regexp_replace(c, f"^[{QUOTE_MARKS}]+", ""), f"[{QUOTE_MARKS}]+\\z", "")
    return trim_spaces(c)


def capitalize_label(c: Column) -> Column:
    """Lower case, but for the first letter."""
    low = F.lower(c)
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30))


def clean_verse(c: Column) -> Column:
    c = trim_spaces(F.regexp_replace(c, r"\s+", " "))
    c = F.regexp_replace(c, LEADING_VERSE_NUMBER, "")
    return trim_spaces(F.regexp_replace(c, "^[-–]+", ""))


def truncate_text(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def safe_file_name(c: Column, suffix: str = ".pro") -> Column:
    c = trim_spaces(F.coalesce(c, F.lit("")))
    c = F.when(c == "", "Presentation").otherwise(c)
    return F.concat(F.translate(c, '/\\:|*?"<>', "----"), F.lit(suffix))


def valid_style_name(c: Column) -> Column:
    return F.coalesce(~trim_spaces(c).isin("", ".", "..") & ~c.rlike(r'[/\\:*?"<>|]'), F.lit(False))


def rgb(comps: Column) -> Column:
    """Struct r, g, b of one (grey), three or four (cyan, magenta, yellow, black) components; null for any other number."""
    n = F.size(comps)
    at = lambda i: F.get(comps, F.lit(i))
    three = lambda r, g, b: F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
    black = 1 - at(3)
    return F.when(n == 1, three(at(0), at(0), at(0))).when(n == 3, three(at(0), at(1), at(2))).when(n == 4, three((1 - at(0)) * black, (1 - at(1)) * black, (1 - at(2)) * black))


def brightness(c: Column) -> Column:
    return F.greatest(c["r"], c["g"], c["b"])


def hex_color(c: Column) -> Column:
    byte = lambda x: F.lpad(F.hex(F.floor(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)) * 255 + 0.5)), 2, "0")
    return F.concat(F.lit("#"), byte(c["r"]), byte(c["g"]), byte(c["b"]))


def hex_to_rgb(c: Column) -> Column:
    """Struct r, g, b of ``#RRGGBB``; null if it is not that."""
    h = F.regexp_replace(F.trim(c), "^#", "")
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    return F.when(h.rlike(r"(?d)^[0-9A-Fa-f]{6}\z"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def rtf_escape(c: Column) -> Column:
    """Backslash and braces escaped, each UTF-16 unit outside ASCII as a signed number with a fallback."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(....)"), F.lit(1))

    def unit(h: Column) -> Column:
        n = F.conv(h, 16, 10).cast("int")
        signed = F.when(n >= 32768, n - 65536).otherwise(n)
        return (
            F.when(n == 92, F.lit("\\\\"))
            .when(n == 123, F.lit("\\{"))
            .when(n == 125, F.lit("\\}"))
            .when(n < 128, F.char(n))
            .otherwise(F.concat(F.lit("\\u"), signed.cast("string"), F.lit(" ?")))
        )

    plain = ~c.rlike(r"[\\{}]|[^\x00-\x7f]")
    return F.when(plain, c).otherwise(F.array_join(F.transform(units, unit), ""))


def utf16_length(c: Column) -> Column:
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("int")
