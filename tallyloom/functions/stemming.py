"""English stems (the published Snowball algorithm for English, "Porter2") and stop words."""

from __future__ import annotations

import re

#: fixed values: the stop words of the English search configuration, in its order
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against between into through during before after above
below to from up down in out on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very s t can will just don should now""".split()
)

#: fixed values: words with stems of their own, and words that are left alone after their plural is dropped
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
UNCHANGED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: fixed values: endings that are replaced in the first region (step 2 and 3) or dropped in the second one (step 4)
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "ization": "ize", "izer": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousness": "ous", "ousli": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_VOWELS = "aeiouy"
_REGION = re.compile(f"[{_VOWELS}][^{_VOWELS}]")
_SHORT_END = re.compile(f"(?:^[{_VOWELS}][^{_VOWELS}]|[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY])$")
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) < 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.replace("’", "'").removeprefix("'")
    w = re.sub(f"(^|[{_VOWELS}])y", r"\1Y", w)  # a y that is a consonant
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    one = len(head) if head else _after(w, 0)
    two = _after(w, one)
    has_vowel = lambda s: re.search(f"[{_VOWELS}]", s) is not None

    w = w.removesuffix("'").removesuffix("'s")
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and has_vowel(w[:-2]):
        w = w[:-1]
    if w in UNCHANGED:
        return w

    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= one:
            w = w[: -len(end)] + "ee"
    elif end and has_vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif one >= len(w) and _SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"

    end = _longest(w, STEP_2)
    if end and len(w) - len(end) >= one and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in "cdeghkmnrt"):
        w = w[: -len(end)] + STEP_2[end]
    end = _longest(w, STEP_3)
    if end and len(w) - len(end) >= (two if end == "ative" else one):
        w = w[: -len(end)] + STEP_3[end]
    end = _longest(w, STEP_4)
    if end and len(w) - len(end) >= two and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= two or len(w) - 1 >= one and not _SHORT_END.search(w[:-1])) or w.endswith("ll") and len(w) - 1 >= two:
        w = w[:-1]
    return w.replace("Y", "y")
