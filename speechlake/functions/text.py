"""Text normalisation as column functions."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from speechlake.functions.let import let

# Readings of digits, place units and letters.
ZERO = "영"
DIGITS = ["", "일", "이", "삼", "사", "오", "육", "칠", "팔", "구"]
UNITS = ["", "십", "백", "천"]
LETTERS = {
    "a": "에이", "b": "비", "c": "씨", "d": "디", "e": "이", "f": "에프", "g": "지",
    "h": "에이치", "i": "아이", "j": "제이", "k": "케이", "l": "엘", "m": "엠", "n": "엔",
    "o": "오", "p": "피", "q": "큐", "r": "알", "s": "에스", "t": "티", "u": "유",
    "v": "브이", "w": "더블유", "x": "엑스", "y": "와이", "z": "제트",
}
PERCENT = "퍼센트"
HANGUL_RANGES = r"가-힣ᄀ-ᇿ㄰-㆏ꥠ-꥿ힰ-퟿"
OPENING = r"\(\[\{\"'“‘,.:;!?/\\"
CLOSING = r"\)\]\}\"'”’,.:;!?/\\"
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "

# Python's notion of whitespace: Unicode White_Space plus four separators.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
U = "(?U)"


def strip(text: Column) -> Column:
    """Cut all kinds of whitespace at both ends (``trim`` cuts blanks only)."""
    return F.btrim(text, F.lit(SPACES))


def _canonical(form: str):
    @F.pandas_udf(StringType())
    def convert(text: pd.Series) -> pd.Series:
        return text.map(lambda s: unicodedata.normalize(form, s), na_action="ignore")

    return convert


_NFC = _canonical("NFC")
_NFD = _canonical("NFD")


def _beyond_ascii(text: Column) -> Column:
    """The text if a canonical form can change it, else null (nothing is sent to Python)."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), text)


def nfc(text: Column) -> Column:
    return F.coalesce(_NFC(_beyond_ascii(text)), text)


def nfd(text: Column) -> Column:
    return F.coalesce(_NFD(_beyond_ascii(text)), text)


def fold_accents(text: Column) -> Column:
    """Base letters without their marks; the marks are what NFD splits off."""
    return F.regexp_replace(nfd(text), r"\p{M}+", "")


# The letters a transliteration spells out although they have no marks.
_SPELLED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D"}


def clean_text(text: Column) -> Column:
    """ASCII letters, no punctuation, lower case."""
    plain = fold_accents(text)
    for letter, spelled in _SPELLED.items():
        plain = F.replace(plain, F.lit(letter), F.lit(spelled))
    return F.lower(F.regexp_replace(plain, r"[\p{Punct}\p{IsPunctuation}]+", ""))


_ID_OF = np.full(256, -1, np.int32)
_ID_OF[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_BYTE_OF = np.frombuffer(ALPHABET.encode(), np.uint8)


@F.arrow_udf(ArrayType(IntegerType()))
def text_to_ids(text: pa.Array) -> pa.Array:
    """Position of every character of a clean text in the alphabet; any other is an error."""
    ends, held = _flat(text.cast(pa.large_string()))
    ids = _ID_OF[held]
    if (ids < 0).any():
        at = int(np.argmax(ids < 0))
        char = held[at : at + 4].tobytes().decode(errors="ignore")[:1]
        raise ValueError(f"character outside the alphabet: {char}")
    return pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()), mask=text.is_null())


def _flat(text: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray]:
    """Ends of the texts from 0 on, and their bytes one after the other."""
    _, ends, held = text.buffers()
    ends = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
    held = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held else np.zeros(0, np.uint8)
    return pa.array(ends - ends[0], pa.int32()), held


@F.arrow_udf(StringType())
def ids_to_text(ids: pa.Array) -> pa.Array:
    """The text of a list of positions; places beyond the alphabet are left out."""
    values, lengths = ids.flatten(), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    if values.null_count:
        values = pc.fill_null(values, -1)
    values = values.to_numpy(zero_copy_only=False)
    known = (values >= 0) & (values < len(ALPHABET))
    if not known.all():
        ends = np.concatenate([[0], np.cumsum(known)])[ends]
        values = values[known]
    held, ends = _BYTE_OF[values], ends.astype(np.int32)
    made = pa.StringArray.from_buffers(len(ids), pa.py_buffer(ends), pa.py_buffer(held))
    return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), made)


def normalize_basic(text: Column) -> Column:
    """Lower-case a-z and blanks only; runs of blanks stay."""
    spaced = F.replace(F.lower(text), F.lit("-"), F.lit(" "))
    return F.trim(F.regexp_replace(spaced, "[^a-z ]+", ""))


def normalize_unicode(text: Column) -> Column:
    """Letters and numbers of any script, single blanks between words.

    ``text`` must already be decomposed (see :func:`nfd`).
    """
    spaced = F.replace(F.lower(text), F.lit("-"), F.lit(" "))
    kept = F.regexp_replace(spaced, rf"{U}[^\p{{L}}\p{{N}}\s\x1c-\x1f]+", "")
    return F.trim(F.regexp_replace(kept, f"{U}{SPACE}+", " "))


def keeps_basic(target_basic: Column, target_unicode: Column) -> Column:
    """Whether the a-z form keeps enough of the target to be scored."""
    half = F.floor(F.length(target_unicode) / F.lit(2))
    return F.length(target_basic) >= F.greatest(F.lit(2), half)


def alignment_text(text: Column) -> Column:
    """Word characters and whitespace only, stripped."""
    return strip(F.regexp_replace(text, rf"{U}[^\p{{L}}\p{{N}}_\s\x1c-\x1f]+", ""))


def _read_number(digits: Column) -> Column:
    """Reading of a run of 1 to 4 ASCII digits without a leading zero."""
    n = digits.cast("int")
    names = F.array(*[F.lit(d) for d in DIGITS])
    parts = []
    for place in (3, 2, 1, 0):
        digit = F.floor(n / F.lit(10**place)).cast("int") % 10
        spoken = F.get(names, digit)
        if place:
            head = F.when(digit == 1, F.lit("")).otherwise(spoken)
            parts.append(F.when(digit == 0, F.lit("")).otherwise(F.concat(head, F.lit(UNITS[place]))))
        else:
            parts.append(spoken)
    return F.when(n == 0, F.lit(ZERO)).otherwise(F.concat(*parts))


def spell_numbers(text: Column) -> Column:
    """Read standalone runs of 1 to 4 digits aloud; longer or zero-padded runs stay."""
    runs = F.regexp_extract_all(text, F.lit(rf"({U}\d+|\D+)"), F.lit(1))

    def speak(run: Column) -> Column:
        ascii_run = F.translate(run, "０１２３４５６７８９", "0123456789")
        speakable = ascii_run.rlike("^([1-9][0-9]{0,3}|0)$")
        return F.when(speakable, _read_number(F.when(speakable, ascii_run))).otherwise(run)

    spoken = F.array_join(F.transform(runs, speak), "")
    return F.when(text.rlike(rf"{U}\d"), spoken).otherwise(text)


# The letter comes first, then what may not stand beside it, so most places fail at once.
_SINGLE_LETTER = rf"[A-Za-z](?![^\s{CLOSING}{HANGUL_RANGES}])(?<![^\s{OPENING}{HANGUL_RANGES}][A-Za-z])"


def spell_letters(text: Column) -> Column:
    """Replace Latin letters that stand alone by their names."""
    pattern = U + _SINGLE_LETTER
    names = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spoken = F.concat(F.transform(found, lambda c: F.element_at(names, F.lower(c))), F.array(F.lit("")))
    rest = F.split(text, pattern, -1)
    joined = F.array_join(F.zip_with(rest, spoken, lambda a, b: F.concat(a, b)), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def spell_percent(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("％"), F.lit(PERCENT)), F.lit("%"), F.lit(PERCENT))


def limit_repeats(text: Column, max_repeat: int = 3) -> Column:
    """Keep at most ``max_repeat`` equal words in a row and equal characters in a word."""
    if max_repeat < 1:
        return F.when(text.isNotNull(), F.lit(""))
    composed = nfc(text)
    parts = F.regexp_extract_all(composed, F.lit(f"{U}({SPACE}+|{NOT_SPACE}+)"), F.lit(1))

    def limited(all_parts: Column) -> Column:
        def kept(part: Column, i: Column) -> Column:
            repeated = ~part.rlike(f"{U}^{SPACE}")
            for back in range(1, max_repeat + 1):
                at = i - 2 * back
                earlier = F.get(all_parts, F.when(at >= 0, at))
                repeated = repeated & F.coalesce(earlier == part, F.lit(False))
            return ~repeated

        return F.filter(all_parts, kept)

    words = F.array_join(let(parts, limited), "")
    chars = F.regexp_replace(
        words, f"{U}({NOT_SPACE})\\1{{{max_repeat},}}", "$1" * max_repeat
    )
    # Most texts repeat nothing that often; two scans tell and spare them the rest.
    again = f"{{{max_repeat}}}"
    word_run = rf"{U}{SPACE}({NOT_SPACE}++)(?:{SPACE}++\1(?!{NOT_SPACE})){again}"
    char_run = rf"{U}({NOT_SPACE})\1{again}"
    repeats = F.concat(F.lit(" "), composed).rlike(word_run) | composed.rlike(char_run)
    return strip(F.when(repeats, chars).otherwise(composed))


def foreign_in_composed(text: Column) -> Column:
    """Whether composed text holds anything but Hangul and whitespace."""
    return F.coalesce(text.rlike(rf"{U}[^{HANGUL_RANGES}\s\x1c-\x1f]"), F.lit(False))


def has_foreign_chars(text: Column) -> Column:
    """The same for any text. No canonical form is made: a character is Hangul or
    whitespace if and only if all that it decomposes to is, so all forms of a
    text agree (the tests look at every code point)."""
    return foreign_in_composed(text)


def drop_punctuation(text: Column) -> Column:
    """No punctuation, single blanks, stripped."""
    plain = F.regexp_replace(text, r"\p{IsPunctuation}+", "")
    return strip(F.regexp_replace(plain, r"  +", " "))


def phone_label(label: Column, noise_known: bool) -> Column:
    """Inventory form of an annotation label."""
    low = F.lower(label)
    named = F.when(low.isin("", "sp"), F.lit("sil")).otherwise(low)
    if not noise_known:
        named = F.when(named == "spn", F.lit("sil")).otherwise(named)
    return F.regexp_replace(named, "[0-9]$", "")


def percent(rate: Column) -> Column:
    return F.format_string("%.2f", rate * 100)
