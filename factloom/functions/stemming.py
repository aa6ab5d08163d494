"""English (Porter2) stemming, after the published algorithm, applied per distinct token.

The analyser tokenises in the JVM; Python only sees the distinct tokens of an Arrow batch.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import scope

# --- fixed values: the published algorithm's word and suffix tables ---
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive",
    "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence",
    "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "",
}
STEP4 = (
    "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()
)
STOP_WORDS = frozenset(scope.STOP_WORDS)
_V = "aeiouy"
_REGION = re.compile(f"[{_V}][^{_V}]")
_SHORT_END = re.compile(f"(?:[^{_V}][{_V}][^{_V}wxY]|^[{_V}][^{_V}])$")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(word: str) -> tuple[int, int]:
    def after(start: int) -> int:
        found = _REGION.search(word, start)
        return found.end() if found else len(word)

    prefix = re.match("gener|commun|arsen", word)
    r1 = prefix.end() if prefix else after(0)
    return r1, after(r1)


def _swap(word: str, table: dict[str, str], r1: int) -> tuple[str, str | None]:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            keep = len(word) - len(suffix)
            return (word[:keep] + table[suffix], suffix) if keep >= r1 else (word, suffix)
    return word, None


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    word = re.sub(f"(^|(?<=[{_V}]))y", "Y", word)
    r1, r2 = _regions(word)
    # plural endings
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_V}]", word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # past and gerund endings
    found = re.search("(eedly|eed|ingly|edly|ing|ed)$", word)
    if found:
        base = word[: found.start()]
        if found[0] in ("eed", "eedly"):
            word = base + "ee" if found.start() >= r1 else word
        elif re.search(f"[{_V}]", base):
            if base.endswith(("at", "bl", "iz")):
                base += "e"
            elif base.endswith(_DOUBLES):
                base = base[:-1]
            elif r1 >= len(base) and _SHORT_END.search(base):
                base += "e"
            word = base
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _V:
        word = word[:-1] + "i"
    # derivational endings
    word, hit = _swap(word, STEP2, r1)
    if hit is None:
        if word.endswith("ogi") and word[-4:-3] == "l" and len(word) - 3 >= r1:
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in tuple("cdeghkmnrt"):
            word = word[:-2]
    word, hit = _swap(word, STEP3, r1)
    if hit is None and word.endswith("ative") and len(word) - 5 >= r2:
        word = word[:-5]
    for suffix in STEP4:
        if word.endswith(suffix):
            word = word[: -len(suffix)] if len(word) - len(suffix) >= r2 else word
            break
    else:
        if word.endswith(("sion", "tion")) and len(word) - 3 >= r2:
            word = word[:-3]
    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _SHORT_END.search(base)):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_all(tokens: pa.Array) -> pa.Array:
    """Stems of token lists without stop words; every distinct token of the batch is looked at once."""
    encoded = tokens.flatten().dictionary_encode()
    words = encoded.dictionary.to_pylist()
    stems = pa.array([stem(word) for word in words], pa.string())
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    keep = np.array([word not in STOP_WORDS for word in words], bool)[codes]
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    kept = np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(sizes))]
    return pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), stems.take(pa.array(codes[keep])))


def lexemes(text: Column) -> Column:
    """Letter and digit runs, stop words removed, stemmed: the English analyser."""
    return stem_all(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
