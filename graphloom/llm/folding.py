"""Character folding shared by the text operators: every map is one character to one character."""

from __future__ import annotations

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w",
    "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K",
    "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o",
    "․": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ", " ": " ",
}
# Digits and signs written for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

#: Full-width forms and other scripts' decimal digits follow from a rule.
_FULL_WIDTH = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
_DIGIT_BLOCKS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50)
_DIGITS = {chr(start + k): str(k) for start in _DIGIT_BLOCKS for k in range(10)}

SHAPES = str.maketrans(HOMOGLYPHS | _FULL_WIDTH | _DIGITS)
#: To be applied after SHAPES.
LETTERS = str.maketrans(LEET)
