"""Porter's suffix stripping (M. F. Porter, 1980) for English title words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 256                   # lists that a task works on at once
HELD = 1 << 17               # words whose stems a task keeps

# The suffix rules of steps 2 to 4, tried longest first.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
         "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
         "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
         "ous", "ive", "ize")


def _kinds(word: str) -> str:
    """v for each vowel (y after a consonant too), c for each consonant."""
    out = ""
    for a in word:
        out += "v" if a in "aeiou" or (a == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by a run of consonants."""
    return len(re.findall("v+c+", _kinds(stem)))


def _cvc(stem: str) -> bool:
    return _kinds(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replace(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[:-len(suffix)]
            return stem + rules[suffix] if _measure(stem) > 0 else word
    return word


def _past(word: str) -> str:
    """Step 1b: -eed, -ed and -ing."""
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[:-len(suffix)]
        if word.endswith(suffix) and "v" in _kinds(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _kinds(stem).endswith("cc") and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _cvc(stem) else stem
        if word.endswith(suffix):
            return word
    return word


def porter(word: str) -> str:
    """The stem of a lower-case [a-z] word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[:-len(suffix)] + new
            break
    word = _past(word)
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[:-len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The stem of each word of a list; a piece of ROWS lists stems its distinct
    words, and a task keeps HELD of them at most."""
    held: dict[str, str] = {}
    for lists in batches:
        for at in range(0, len(lists), ROWS):
            piece = lists.slice(at, ROWS)
            coded = pc.dictionary_encode(piece.flatten())
            words = coded.dictionary.to_pylist()
            if len(held) + len(words) > HELD:
                held.clear()
            for w in words:
                if w not in held:
                    held[w] = porter(w)
            stem = pc.take(pa.array([held[w] for w in words], pa.string()), coded.indices)
            size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(piece), 0).to_numpy(zero_copy_only=False))])
            yield pa.ListArray.from_arrays(pa.array(size, pa.int32()), stem, mask=piece.is_null())
