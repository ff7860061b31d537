"""Folding of texts before comparison: compatibility forms, case, invisible characters, look-alike letters."""

from __future__ import annotations

import re
import unicodedata

#: Letters of other scripts that look like Latin ones (fixed values, after lower case).
LOOKALIKE = str.maketrans({
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ё": "e", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g",
})

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]|(?![\t\n\r])[\x00-\x1f\x7f-\x9f]")


_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def visible(text: str) -> str:
    """Without invisible and control characters."""
    if text.isascii():
        return _CONTROL.sub("", text) if _CONTROL.search(text) else text
    return _INVISIBLE.sub("", text)


def fold(text: str) -> str:
    """Lower case compatibility form without invisible characters; look-alike letters become Latin ones."""
    if text.isascii():
        return visible(text).lower()
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold().replace("ß", "ss").translate(LOOKALIKE)
