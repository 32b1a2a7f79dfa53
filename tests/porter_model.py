"""A plain, letter-by-letter model of the stemmer, written from the published description, for tests."""

VOWELS = "aeiou"


def consonant(w, i):
    return w[i] not in VOWELS and not (w[i] == "y" and i > 0 and consonant(w, i - 1))


def measure(w):
    kinds = "".join("c" if consonant(w, i) else "v" for i in range(len(w)))
    return sum(kinds[i : i + 2] == "vc" for i in range(len(kinds)))


def vowel(w):
    return any(not consonant(w, i) for i in range(len(w)))


def cvc(w):
    return len(w) >= 3 and consonant(w, len(w) - 1) and not consonant(w, len(w) - 2) and consonant(w, len(w) - 3) and w[-1] not in "wxy"


def stem(w, step2, step3, step4):
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1):
                    w = w if w[-1] in "lsz" else w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    if len(w) <= 1:
        return w
    for rules in (step2, step3):
        for s in sorted(rules, key=len, reverse=True):
            if w.endswith(s):
                if measure(w[: -len(s)]) > 0:
                    w = w[: -len(s)] + rules[s]
                break
    for s in sorted(step4, key=len, reverse=True):
        if w.endswith(s):
            head = w[: -len(s)]
            if measure(head) > 1 and (s != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and measure(w[:-1]) > 1:
        w = w[:-1]
    return w
