"""English stems by the public Porter2 (Snowball English) algorithm, for distinct words."""

from __future__ import annotations

import re

# The stop words of the English text search configuration.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by
    for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why
    how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
# Words with a stem of their own, words that end after the first step, and beginnings that the first region follows.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
SETTLED = frozenset("inning outing canning herring earring proceed exceed succeed".split())
BEGINNINGS = re.compile("gener|commun|arsen")
# Endings of the second, third and fourth step, longest first.
SECOND = (("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
THIRD = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
FOURTH = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")

VOWEL = "[aeiouy]"
REGION = re.compile(rf"{VOWEL}[^aeiouy]")
SHORT_END = re.compile(rf"(?:[^aeiouy]{VOWEL}[^aeiouywxY]|^{VOWEL}[^aeiouy])$")
DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    m = REGION.search(word, start)
    return m.end() if m else len(word)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) < 3:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(r"^'", "", word)
    w = re.sub(rf"^y|(?<={VOWEL})y", "Y", w)
    begins = BEGINNINGS.match(w)
    r1 = begins.end() if begins else region(w, 0)
    r2 = region(w, r1)
    w = re.sub(r"(?:'s'|'s|')$", "", w)

    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(VOWEL, w[:-2]):
        w = w[:-1]
    if w in SETTLED:
        return w

    # past and participles
    m = re.search(r"(?:eedly|eed|edly|ed|ingly|ing)$", w)
    if m and m[0].startswith("eed"):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif m and re.search(VOWEL, w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif DOUBLE.search(w):
            w = w[:-1]
        elif r1 >= len(w) and SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    for end, new in SECOND:
        if w.endswith(end):
            at = len(w) - len(end)
            fits = at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt"))
            w = w[:at] + new if fits else w
            break
    for end, new in THIRD:
        if w.endswith(end):
            at = len(w) - len(end)
            w = w[:at] + new if at >= (r2 if end == "ative" else r1) else w
            break
    for end in FOURTH:
        if w.endswith(end):
            at = len(w) - len(end)
            w = w[:at] if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")) else w
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not SHORT_END.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
