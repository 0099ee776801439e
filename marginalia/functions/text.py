"""Column functions for texts: all of them native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space: Unicode's, and the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: The same characters one by one, those in ASCII first.
ASCII_SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
SPACES = ASCII_SPACES + "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Letters that the full-text tokenizer folds to a base letter, with one diacritic each.
ACCENTED = (
    "µÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽžſ"
    "ƠơƯưǍǎǏǐǑǒǓǔǦǧǨǩǪǫǰǴǵǸǹȀȁȂȃȄȅȆȇȈȉȊȋȌȍȎȏȐȑȒȓȔȕȖȗȘșȚțȞȟȦȧȨȩȮȯȲȳ\u212b")
PLAIN = (
    "μaaaaaaceeeeiiiinooooouuuuyaaaaaaceeeeiiiinooooouuuuyyaaaaaaccccccccddeeeeeeeeeegggggggghhiiiiiiiiijjkkllllllnnnnnnoooooorrrrrrssssssssttttuuuuuuuuuuuuwwyyyzzzzzzs"
    "oouuaaiioouuggkkoojggnnaaaaeeeeiiiioooorrrruuuusstthhaaeeooyya")
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often it's used."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def normalize_query(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def ws_tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    parts = F.when(F.octet_length(text) == F.length(text), F.split(text, f"[{ASCII_SPACES}]+")).otherwise(F.split(text, SPACE))
    return F.array_remove(parts, "")


def lines(text: Column) -> Column:
    """Lines without their ends; no last empty line."""
    other = F.rlike(text, F.lit(r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"))
    whole = F.when(other, F.split(text, LINE_END, -1)).otherwise(F.split(text, "\n", -1))
    return let(whole, lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


#: What a lower-case text has left of ``ACCENTED`` ("İ" alone isn't one letter in lower case; it's replaced before).
_LOWER_ACCENTED, _LOWER_PLAIN = map("".join, zip(*[(a, p) for a, p in zip(ACCENTED, PLAIN, strict=True) if a == a.lower()], strict=True))
#: Combining marks of U+0300 to U+0331 that the full-text tokenizer drops inside a token (at its start they part tokens).
MARKS = "".join(chr(0x300 + i) for i in range(50) if (0x08029FDF if i < 32 else 0x000361F8) >> (i % 32) & 1)
_ASCII = "abcdefghijklmnopqrstuvwxyz0123456789"  # written out: a class of single characters is one look-up
_IN_TOKEN = r"\p{L}\p{N}\p{Co}"


def fts_fold(text: Column) -> Column:
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def fts_tokens(text: Column) -> Column:
    """Tokens of the full-text index: folded runs of letters, numbers and private-use characters, less combining marks.

    Each kind of text pays only for what it needs: one in ASCII isn't folded,
    others are token by token, and marks are looked for by their range alone.
    """
    one_byte = lambda x: F.octet_length(x) == F.length(x)
    low = F.lower(F.replace(text, F.lit("İ"), F.lit("i")))
    runs = F.regexp_extract_all(low, F.lit(rf"[{_ASCII}]+[{_IN_TOKEN}]*|[{_IN_TOKEN}]+"), 0)
    folded = F.transform(runs, lambda t: F.when(one_byte(t), t).otherwise(F.translate(t, _LOWER_ACCENTED, _LOWER_PLAIN)))
    bare = F.regexp_replace(fts_fold(text), rf"(?<=[{_IN_TOKEN}])[{MARKS}]+", "")
    return F.when(one_byte(text), F.regexp_extract_all(low, F.lit(f"[{_ASCII}]+"), 0)).when(
        F.rlike(text, F.lit("[\u0300-\u0331]")), F.regexp_extract_all(bare, F.lit(f"[{_IN_TOKEN}]+"), 0)).otherwise(folded)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def uuid5_url(name: Column) -> Column:
    """Name-based UUID (SHA-1) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
                    variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def redact(text: Column, patterns: list[str], mask: str = "[redacted]") -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, mask)
    return text
