"""Cleaning rules, language detection and tokens as native column expressions.

Every function maps a string column to a column and keeps nulls. The character classes
are spelled out because the regex engines disagree on what `\\s`, `\\w` and `\\d` cover.
A rule first asks for a literal that each of its matches contains, so rows without it
skip the regex; such a rule reads its input more than once, hence apply rules one
`withColumn` at a time (see `operators.cleaning`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiltext.functions.once import let

# Character classes and cleaning patterns that decide the results.
WORD = r"[\p{L}\p{N}_]"
WORD_CHARS = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE_CHARS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{SPACE_CHARS}]"
NOT_SPACE = f"[^{SPACE_CHARS}]"
OTHER_SPACE = f"[{SPACE_CHARS.replace('{20}', '{1f}')}]"
NOT_VISIBLE, NOT_PRINTABLE = "(?![!-~])", "(?![ -~])"  # quick rejection of most characters
START = rf"(?<!{WORD})"
STOP = rf"(?!{WORD})"
EDGE = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"  # a word boundary, also in front of a dot
TAG = r"<[^>]+>"
URL = rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
CONTROL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]"
QUOTES = r'"{2,}'
TALK = "(talk)"
SIGNATURE = (
    rf"{DIGIT}{{1,2}}:{DIGIT}{{2}},{SPACE}+{WORD}+{SPACE}+{DIGIT}{{1,2}},{SPACE}+{DIGIT}{{4}}{SPACE}+\(UTC\)"
)
ADDRESS = rf"{DIGIT}{{1,3}}\.{DIGIT}{{1,3}}\.{DIGIT}{{1,3}}\.{DIGIT}{{1,3}}"
IP = START + ADDRESS + STOP
EMAIL = rf"{EDGE}[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[a-zA-Z]{{2,}}{STOP}"
REPLACEMENT_CHAR = "�"
CYRILLIC = r"\x{400}-\x{4ff}"
LATIN = r"A-Za-z\x{130}\x{212a}"

# Character pairs for deobfuscation and the stress set.
LEET_CHARS, LEET_LETTERS = "01345@$7", "oieasast"
LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN = "асеорхуАСЕОРХ", "aceopxyACEOPX"
VOWELS = "aeiouаеиоуыэюя"
STRESS_VARIANTS = 4
MARKS = r"\x{300}-\x{36f}\x{1ab0}-\x{1aff}\x{1dc0}-\x{1dff}\x{20d0}-\x{20ff}\x{fe20}-\x{fe2f}"  # combining ones
INVISIBLE = r"\x{ad}\x{200b}-\x{200d}\x{2060}\x{feff}"
MARKED, PILED, PARTED = f"([A-Za-z])[{MARKS}]+", f"[{MARKS}]{{2,}}", rf"(\p{{L}})[{INVISIBLE}]+"


def _compatibility_forms() -> tuple[str, str]:
    """Characters that stand for an ASCII one, by the blocks they are arranged in, and what they stand for."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    blocks = [(0xFF01, "".join(map(chr, range(0x21, 0x7F))), 1)]  # full width
    blocks += [(0x1D400, upper + lower, 13), (0x1D7CE, digits, 5)]  # thirteen mathematical alphabets, five sets of digits
    blocks += [(0x24B6, upper + lower, 1)]  # in circles
    blocks += [(begin, upper, 1) for begin in (0x1F130, 0x1F150, 0x1F170, 0x1F1E6)]  # in squares, on black, and letters of flags
    forms = "".join(chr(begin + i) for begin, letters, times in blocks for i in range(len(letters) * times))
    return forms, "".join(letters * times for _, letters, times in blocks)


FORMS, FORM_LETTERS = _compatibility_forms()


def _guarded(text: Column, literal: str, result: Column) -> Column:
    return F.when(text.contains(literal), result).otherwise(text)


def text_length(text: Column) -> Column:
    """Length in code points."""
    return F.length(text)


def strip_html_tags(text: Column) -> Column:
    return _guarded(text, "<", F.regexp_replace(text, TAG, " "))


def strip_urls(text: Column) -> Column:
    hit = text.contains("http") | text.contains("www.")
    return F.when(hit, F.regexp_replace(text, URL, "")).otherwise(text)


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, NOT_PRINTABLE + CONTROL, "")


def normalize_ws(text: Column) -> Column:
    """White-space runs become one blank. A lone blank is no match, so plain text is not rebuilt."""
    return F.trim(F.regexp_replace(text, f"{NOT_VISIBLE}(?: {SPACE}+|{OTHER_SPACE}{SPACE}*)", " "))


def collapse_quotes(text: Column) -> Column:
    return _guarded(text, '""', F.regexp_replace(text, QUOTES, '"'))


def strip_wiki_meta(text: Column) -> Column:
    """Remove `(talk)` and talk-page time stamps."""
    stripped = F.replace(text, F.lit(TALK), F.lit(""))
    return F.when(text.contains("(UTC)"), F.regexp_replace(stripped, SIGNATURE, "")).otherwise(stripped)


def strip_ips(text: Column) -> Column:
    return F.regexp_replace(text, f"(?={DIGIT}){IP}", "")


def strip_emails(text: Column) -> Column:
    return _guarded(text, "@", F.regexp_replace(text, EMAIL, ""))


def strip_replacement_char(text: Column) -> Column:
    return F.replace(text, F.lit(REPLACEMENT_CHAR), F.lit(""))


def basic_normalize(text: Column) -> Column:
    """Lower case and single spaces: the configuration without a defence."""
    return normalize_ws(F.lower(text))


def letters_in(text: Column, chars: str) -> Column:
    """How many characters of `text` lie in the class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))  # a run at a time


def detect_language(text: Column) -> Column:
    """Russian when Cyrillic letters outnumber Latin ones, English when any Latin letter is left.

    Letters are counted only in texts that have Cyrillic ones.
    """
    cyrillic, latin = letters_in(text, CYRILLIC), letters_in(text, LATIN)
    return (
        F.when(text.isNull(), "unknown")
        .when(text.rlike(f"[{CYRILLIC}]") & (cyrillic > latin), "Russian")
        .when(text.rlike(f"[{LATIN}]"), "English")
        .otherwise("Other")
    )


def tokens(text: Column) -> Column:
    """Lower-cased, white-space separated tokens in text order."""
    return F.filter(F.split(F.lower(text), f"{NOT_VISIBLE}{SPACE}+"), lambda t: t != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{WORD}{{2,}}"), F.lit(0))


def with_bigrams(words: Column) -> Column:
    """The words followed by each adjacent pair."""
    shifted = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), shifted, lambda a, b: F.concat_ws(" ", a, b)
    )
    return F.concat(words, pairs)


def join_spaced_letters(text: Column) -> Column:
    """`i d i o t` -> `idiot`: drop single separators inside runs of three or more lone letters."""
    sep, letter = r"[ .*-]", r"\p{L}"
    lone = rf"(?={sep}{letter}{STOP})"  # what both need, asked first
    first = rf"(?<={START}{letter}){sep}(?={letter}{sep}{letter}{STOP})"
    later = rf"(?<={START}{letter}{sep}{letter}){sep}(?={letter}{STOP})"
    return F.regexp_replace(text, f"{lone}(?:{first}|{later})", "")


def squeeze_letters(text: Column) -> Column:
    """Three or more equal letters in a row become one."""
    return F.regexp_replace(text, r"(\p{L})\1{2,}", "$1")


def fold_forms(text: Column) -> Column:
    """Undo Unicode disguises: styled letters and digits, marks on Latin letters or piled up, invisible characters in words."""
    plain = F.regexp_replace(F.translate(text, FORMS, FORM_LETTERS), PARTED, "$1")
    return F.regexp_replace(F.regexp_replace(plain, MARKED, "$1"), PILED, "")


def deobfuscate(text: Column) -> Column:
    """Undo Unicode disguises, spacing, digit-for-letter writing, repeated letters and look-alike letters.

    Look-alikes are folded to Latin only where Latin letters are at least as many as
    Cyrillic ones, so Russian text stays Russian.
    """
    def spelled_out(folded: Column) -> Column:
        joined = join_spaced_letters(folded)
        plain = squeeze_letters(F.translate(joined, LEET_CHARS, LEET_LETTERS))
        latin = detect_language(folded) == "English"
        return let(plain, lambda p: F.when(latin, F.translate(p, LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN)).otherwise(p))

    return let(fold_forms(text), spelled_out)


def obfuscate(text: Column, variant: Column) -> Column:
    """One of four evasions: spaced letters, tripled vowels, digits for letters, look-alikes."""
    return (
        F.when(variant == 0, F.regexp_replace(text, r"(\p{L})", "$1 "))
        .when(variant == 1, F.regexp_replace(text, f"([{VOWELS}])", "$1$1$1"))
        .when(variant == 2, F.translate(text, "oieast", "013457"))
        .otherwise(F.translate(text, LOOKALIKE_LATIN, LOOKALIKE_CYRILLIC))
    )
