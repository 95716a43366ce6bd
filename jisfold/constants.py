"""Public enumerations and errors."""

from __future__ import annotations

import enum


class ConversionMode(enum.IntEnum):
    """What an encoder may write."""

    SISO = 0  # both planes of JIS X 0213, switched by 0x0E and 0x0F
    MEN1 = 1  # plane 1 of JIS X 0213
    JISX0208 = 2  # JIS X 0208 only
    JISX0208_TRANSLIT = 3  # JIS X 0208, other characters by their shrunken forms


class MJShrinkScheme(enum.IntEnum):
    """Numbers of the MJ shrink map's schemes."""

    JIS_INCORPORATION_UCS_UNIFICATION_RULE = 0
    INFERENCE_BY_READING_AND_GLYPH = 1
    MOJ_NOTICE_582 = 2
    MOJ_FAMILY_REGISTER_ACT_RELATED_NOTICE = 3


class MJShrinkSchemeCombo(enum.IntFlag):
    """Sets of schemes, as flags."""

    JIS_INCORPORATION_UCS_UNIFICATION_RULE = 1
    INFERENCE_BY_READING_AND_GLYPH = 2
    MOJ_NOTICE_582 = 4
    MOJ_FAMILY_REGISTER_ACT_RELATED_NOTICE = 8


class JisClass(enum.IntEnum):
    """Character classes of the JIS table."""

    RESERVED = 0
    KANJI_LEVEL_1 = 1
    KANJI_LEVEL_2 = 2
    KANJI_LEVEL_3 = 3
    KANJI_LEVEL_4 = 4
    JISX0208_NON_KANJI = 9
    JISX0213_NON_KANJI = 11


#: Classes of JIS X 0208, and classes that shrinking replaces.
CLASSES_0208 = (JisClass.KANJI_LEVEL_1, JisClass.KANJI_LEVEL_2, JisClass.JISX0208_NON_KANJI)
CLASSES_SHRUNK = (JisClass.KANJI_LEVEL_3, JisClass.KANJI_LEVEL_4, JisClass.JISX0213_NON_KANJI)

NOT_CONVERTIBLE = "not convertible to JISX0208"


class TransliterationError(Exception):
    """A character has no transliteration and no replacement was given."""
