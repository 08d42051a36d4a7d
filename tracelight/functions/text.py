"""Text expressions: words, sentences, canonical form. All JVM-side."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and character sets that results depend on.
WORD = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
PLAIN_WORD = r"[\p{L}\p{N}]+"
UNICODE_SPACE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = rf"[\s\x0b{UNICODE_SPACE}]"
NON_SPACE = rf"[^\s\x0b{UNICODE_SPACE}]"
# The same sets for the JVM, which tests one range after the other: single characters below U+0100
# are one look-up, and the ranges above stand behind one that holds them all.
JVM_SPACE = (
    r"[[ \t\n\x0b\f\r\x{85}\x{a0}][\x{1680}-\x{3000}&&"
    r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)
_ALNUM = rf"[[{ascii_letters}{digits}][\p{{L}}\p{{N}}]]"
JVM_PLAIN_WORD = f"{_ALNUM}+"
JVM_WORD = rf"{_ALNUM}+(?:['’\-]{_ALNUM}+)*"
SENTENCE_END = r"([.!?…])[\"'”’)\]]* "
URL = rf"(?i)(?:https?://|www\.){NON_SPACE}+"
EMAIL = r"[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+\.[\p{L}\p{N}_.\-]+"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"
PUNCTUATION = ".,;:!?\"'“”‘’()[]-–—…/"
ZERO_WIDTH = {
    chr(0x200B): "ZERO WIDTH SPACE",
    chr(0x200C): "ZERO WIDTH NON-JOINER",
    chr(0x200D): "ZERO WIDTH JOINER",
    chr(0x2060): "WORD JOINER",
    chr(0xFEFF): "ZERO WIDTH NO-BREAK SPACE (BOM)",
    chr(0x00AD): "SOFT HYPHEN",
    chr(0x180E): "MONGOLIAN VOWEL SEPARATOR",
}
BIDI = "".join(chr(c) for c in [*range(0x202A, 0x202F), *range(0x2066, 0x206A)])
SPECIAL_SPACES = "".join(
    chr(c) for c in [0xA0, *range(0x2002, 0x200B), 0x202F, 0x3000]
)
CONTROLS = "".join(chr(c) for c in range(32) if c not in (9, 10, 13)) + "\x7f"
HIDDEN = (
    "[[" + "".join(f"\\x{ord(c):02x}" for c in CONTROLS) + r"\xa0\xad][\x{180e}-\x{feff}&&"
    r"[\x{180e}\x{2002}-\x{200d}\x{202a}-\x{202f}\x{2060}\x{2066}-\x{2069}\x{3000}\x{feff}]]]"
)

_BREAK = "\x01"
_PARA = "\x02"


def java_call(cls: str, method: str, value: Column, flag: bool) -> Column:
    return F.reflect(F.lit(cls), F.lit(method), value, F.lit(flag))


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no such function, but ships the ICU library that has one.

    Everything below U+0300 is NFC already, so plain Latin text never reaches the call.
    """
    return F.when(
        text.rlike("[^\\x00-\\x{2ff}]"),
        java_call("com.ibm.icu.text.Normalizer", "compose", text, False),
    ).otherwise(text)


def nfkc_folded(text: Column) -> Column:
    """NFKC plus full case folding; a plain ``lower`` for ASCII text."""
    composed = java_call("com.ibm.icu.text.Normalizer", "compose", text, True)
    return F.when(
        text.rlike("[^\\x00-\\x7f]"),
        java_call("com.ibm.icu.lang.UCharacter", "foldCase", composed, True),
    ).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JVM_WORD), F.lit(0))


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JVM_PLAIN_WORD), F.lit(0))


def canonical(text: Column) -> Column:
    return F.array_join(plain_words(nfkc_folded(text)), " ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{JVM_SPACE}+", " "))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\\n\\s*\\n"), lambda p: p.rlike(NON_SPACE))


def sentences(text: Column) -> Column:
    """Sentences of normalised text, paragraph by paragraph.

    Control characters are free for use as marks: normalisation removed them.
    """
    marked = F.regexp_replace(text, "\\n\\s*\\n", _PARA)
    marked = F.regexp_replace(marked, f"{JVM_SPACE}+", " ")
    marked = F.regexp_replace(marked, f" ?{_PARA} ?", _PARA)
    marked = F.regexp_replace(F.trim(marked), SENTENCE_END, f"$1{_BREAK}")
    return F.filter(F.split(marked, f"[{_BREAK}{_PARA}]"), lambda s: s != "")


def char_count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def base_hash(text: Column) -> Column:
    """First 32 bits of md5 as a long: available in every SQL engine, so checkable."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
