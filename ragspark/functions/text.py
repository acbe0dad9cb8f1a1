"""Text columns: cleaning, normal forms, tokens, names. All JVM-side; nulls stay null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a Java character class without its brackets.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
#: The same, character by character.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Line boundaries of Unicode text; a carriage return and line feed are one.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
LETTERS, OBFUSCATED = "oieast", "013457"


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.trim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Each run of white space is one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def strip_chars(c: Column, chars: str) -> Column:
    return F.trim(c, F.lit(chars))


def clean_text(c: Column) -> Column:
    """Three or more line feeds become two; no white space at the ends."""
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def casefold(c: Column) -> Column:
    """Full Unicode case folding; lower case for ASCII texts, ICU's folding, which Spark ships, for others."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    return F.when(_ascii(c), F.lower(c)).when(c.isNotNull(), folded)


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, by ICU; ASCII texts are composed already."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(_ascii(c), c).when(c.isNotNull(), composed)


def normalize(c: Column) -> Column:
    """For matching: NFKC, folded case, collapsed white space."""
    return collapse(casefold(nfkc(c)))


def security_normalize(c: Column) -> Column:
    """For screening: as normalize(), without zero-width characters, digits that stand for letters read as those, and
    only word characters and + # < > [ ] kept."""
    plain = F.regexp_replace(casefold(nfkc(c)), r"[\x{200b}-\x{200f}\x{2060}\x{feff}]", "")
    return collapse(F.regexp_replace(F.translate(plain, OBFUSCATED, LETTERS), r"[^\p{L}\p{N}_+#<>\[\]]+", " "))


def words(c: Column) -> Column:
    """Case-folded runs of letters, digits and underscores."""
    return F.regexp_extract_all(casefold(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def spaced(c: Column) -> Column:
    """The pieces between runs of white space."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.greatest(F.lit(1), F.size(spaced(c)))


def file_name(c: Column, default: str = "document") -> Column:
    """The last part of a path with either kind of separator; `default` if there is none."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", "/"), "/+$", "")
    name = F.regexp_extract(path, "[^/]*$", 0)
    return F.when(name == "", F.lit(default)).otherwise(name)


def _untag(c: Column, marks: str) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), marks, "")


def clean_heading(c: Column) -> Column:
    """Without tags and inline marks, white space collapsed, no blanks or number signs at the ends."""
    return strip_chars(F.regexp_replace(_untag(c, "[*_`]+"), f"[{SPACE}]+", " "), " #")


def clean_legal(c: Column) -> Column:
    return collapse(_untag(c, "[#*_`]+"))


def lines(c: Column) -> Column:
    """The lines of a text; a break at the end starts no further line, an empty text has none."""
    body = F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", "")
    plain = F.when(c.endswith("\n"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    return F.when(c == "", F.array().cast("array<string>")).when(has_odd_breaks(c), F.split(body, LINE_BREAK, -1)).otherwise(F.split(plain, "\n", -1))


def has_odd_breaks(c: Column) -> Column:
    """Whether a text has line boundaries other than line feeds."""
    return c.rlike(r"[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
