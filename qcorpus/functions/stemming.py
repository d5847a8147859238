"""English word stems by the Snowball project's published English ("Porter 2") rules, and English stop words."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The English stop words that a full-text search leaves out.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now
    """.split()
)

# Fixed values of the English rules: exceptions, regions and endings.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_PREFIXES = ("gener", "commun", "arsen")
_VOWELS = frozenset("aeiouy")
_DOUBLES = {"bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"}
_LI = frozenset("cdeghkmnrt")
_SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able",
    "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """Where the region after the first vowel with a non-vowel behind it begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _ends_short(word: str) -> bool:
    """The word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS and word[-1] not in "wxY"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(1 << 18)
def stem_word(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    # a consonant y is written Y
    marked = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in _VOWELS and not (word[i - 1] == "y" and _is_consonant_y(word, i - 1))) else c for i, c in enumerate(word))
    prefix = next((p for p in _PREFIXES if word.startswith(p)), None)
    one = len(prefix) if prefix else _region(marked, 0)
    two = _region(marked, one)
    w = marked
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_PLURAL:
        return w
    # past and gerund
    ending = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= one:
            w = w[: len(w) - len(ending)] + "ee"
    elif ending and any(c in _VOWELS for c in w[: len(w) - len(ending)]):
        w = w[: len(w) - len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in _DOUBLES:
            w = w[:-1]
        elif _ends_short(w) and one >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # derived forms, step by step
    ending = _longest(w, (*_SECOND, "ogi", "li"))
    if ending and len(w) - len(ending) >= one:
        rest = w[: len(w) - len(ending)]
        if ending in _SECOND:
            w = rest + _SECOND[ending]
        elif ending == "ogi" and rest.endswith("l"):
            w = rest + "og"
        elif ending == "li" and rest[-1:] in _LI:
            w = rest
    ending = _longest(w, (*_THIRD, "ative"))
    if ending and len(w) - len(ending) >= one:
        if ending != "ative":
            w = w[: len(w) - len(ending)] + _THIRD[ending]
        elif len(w) - 5 >= two:
            w = w[:-5]
    ending = _longest(w, (*_FOURTH, "ion"))
    if ending and len(w) - len(ending) >= two and (ending != "ion" or w[: len(w) - 3].endswith(("s", "t"))):
        w = w[: len(w) - len(ending)]
    if w.endswith("e"):
        if len(w) - 1 >= two or len(w) - 1 >= one and not _ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= two:
        w = w[:-1]
    return w.replace("Y", "y")


def _is_consonant_y(word: str, i: int) -> bool:
    """The y at ``i`` is a consonant: at the beginning, or after a vowel."""
    return i == 0 or word[i - 1] in _VOWELS and not (word[i - 1] == "y" and _is_consonant_y(word, i - 1))


def lexeme(word: str) -> str:
    """The stem of a word of ASCII letters; other words stay as they are."""
    return stem_word(word) if word.isascii() and word.isalpha() else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lexemes(words: pd.Series) -> pd.Series:
    return words.map(lambda some: None if some is None else [lexeme(w) for w in some])


def stem_all(words: Column) -> Column:
    """The lexemes of an array of lower-case words; a task stems a word once."""
    return _lexemes(words)


@F.pandas_udf(T.StringType())
def _lexeme(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else lexeme(w))


def stem(word: Column) -> Column:
    """The lexeme of a lower-case word."""
    return _lexeme(word)
