"""Character classes of the pre-token pattern.

The JVM's ``\\p{L}`` and ``\\p{N}`` follow the Unicode version of the Java runtime (13.0 on
Java 17).  The pattern has to treat later letters and numbers alike, so the code points added to
the two categories since then are listed and joined to the class.  On a newer runtime the extra
ranges are simply redundant.
"""

from __future__ import annotations

# Code points of general category L added to Unicode after version 13.0 (hex).
LETTERS_ADDED = """
    558 58B-58C 870-887 889-88F 8B5 8C8-8C9 C5C-C5D CDC-CDD 170D 171F 1B4C 1C89-1C8A 208F
    209D-209F 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7DD A7E2 A7F1-A7F4 AB6C-AB6D 10570-1057A
    1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC
    105C0-105F3 10780-10785 10787-107B0 107B2-107BF 10940-10959 10D4A-10D65 10D6F-10D85
    10EC2-10EC7 10ED9-10EEE 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E
    11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11B0A 11BC0-11BE0 11DB0-11DDB 11DF1
    11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D
    16A70-16ABE 16D40-16D6C 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18CFF
    18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE
    1B11F-1B128 1B132 1B155 1B168 1D6A6 1DF00-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E030-1E06D
    1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
    1E6F0-1E6F4 1E6FE-1E6FF 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF
    2B735-2B73F 2B81E 2CEA2-2CEAD 2EBF0-2EE5D 31350-33479 3D000-3FC3F
"""

# Code points of general category N added to Unicode after version 13.0 (hex).
NUMBERS_ADDED = """
    10D40-10D49 116D0-116E3 11BF0-11BF9 11DE0-11DE9 11F50-11F59 1246F 12475-1247F 12550-12686
    16130-16139 16AC0-16AC9 16D70-16D79 16FF4-16FF6 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9
    1E5F1-1E5FA
"""


def _ranges(spec: str) -> str:
    spans = (span.partition("-") for span in spec.split())
    return "".join(
        rf"\x{{{first}}}-\x{{{last}}}" if last else rf"\x{{{first}}}" for first, _, last in spans
    )


# The intersection keeps the long range list away from the frequent low code points.
_LATE = r"[[^\x{{0}}-\x{{557}}]&&[{}]]"
LETTER = r"\p{L}" + _LATE.format(_ranges(LETTERS_ADDED))
NUMBER = r"\p{N}" + _LATE.format(_ranges(NUMBERS_ADDED))
