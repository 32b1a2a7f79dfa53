"""Documents whose kind is known because they are made here: prose, lists, tables and junk from the words of a text.

Lines of the text that read as sentences are the material.  Lists and tables come alone or among sentences, on either
side of the half that decides; junk is what damaged or generated files hold instead of language.  Labels come from how a
document was made, never from its statistics.
"""

from __future__ import annotations

import base64
import random
import re
import textwrap
from collections.abc import Iterator

_WORD = re.compile(r"[^\W\d_]{2,15}")
#: Signs that damaged decoding leaves, consonants, and signs of symbol and character-recognition noise (fixed values).
BROKEN = ("�", "Ã©", "Ã¶", "Ã¼", "â€™", "â€œ", "Â ", "ï¿½")
CONSONANTS, SYMBOLS, NOISE = "bcdfghjklmnpqrstvwxz", "!@#%^&*-_=+|\\/<>~.;:?", "|_.,;:'`^~1lI"
BULLETS = ("", "", "- ", "* ", "+ ", "• ", "{}. ", "{}) ", "({}) ")
SEPARATORS = ("\t", "|", " | ", ";", "    ", " / ", ", ", ",")


def sentences(text: str) -> list[str]:
    """Lines that end as a sentence does, hold eight words or more and consist of them mostly."""
    lines = [x.strip() for x in text.split("\n")]
    return [x for x in lines if x.endswith((".", "!", "?")) and len(found := _WORD.findall(x)) >= 8 and sum(map(len, found)) > 0.6 * len(x)]


def _entries(rng: random.Random, words: list[str], n: int) -> list[str]:
    sign, out = rng.choice(BULLETS), []
    for i in range(n):
        some = [rng.choice(words) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.25:
            some.append(f"{some.pop()}, {rng.randint(1000, 2100)}")
        body = " ".join(some)
        out.append(sign.replace("{}", str(i + 1)) + (body.capitalize() if rng.random() < 0.6 else body))
    return out


def _rows(rng: random.Random, words: list[str], n: int) -> list[str]:
    sep, columns = rng.choice(SEPARATORS), rng.randint(3, 7)
    cell = {
        "word": lambda: rng.choice(words), "int": lambda: str(rng.randint(0, 99999)), "real": lambda: f"{rng.uniform(0, 999):.2f}",
        "date": lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", "flag": lambda: rng.choice(("yes", "no", "n/a", "")),
    }
    kinds = ["word"] + [rng.choice(list(cell)) for _ in range(columns - 1)]
    out = [sep.join(cell[k]() or "-" if sep.isspace() and len(sep) > 1 else cell[k]() for k in kinds) for _ in range(n)]
    return [sep.join(rng.choice(words) for _ in kinds), *out[1:]] if rng.random() < 0.4 else out


def _junk(rng: random.Random, words: list[str], kind: int) -> str:
    n = rng.randint(20, 160) if rng.random() < 0.8 else rng.randint(4, 20)
    if kind == 0:
        return " ".join(str(rng.randrange(10 ** rng.randint(1, 11))) if rng.random() < 0.9 else rng.choice("xyzq#:;") for _ in range(n))
    if kind == 1:
        return "\n".join(" ".join(rng.choice(SYMBOLS) * rng.randint(3, 9) for _ in range(rng.randint(1, 5))) for _ in range(n // 5 + 1))
    if kind == 2:
        return " ".join("".join(rng.choice(CONSONANTS) for _ in range(rng.randint(2, 11))) for _ in range(n))
    if kind == 3:
        width = rng.choice((8, 16))
        return "\n".join(f"{width * i:08x}  " + " ".join(f"{rng.randrange(256):02x}" for _ in range(width)) for i in range(n // 8 + 2))
    if kind == 4:
        raw = base64.b64encode(bytes(rng.randrange(256) for _ in range(48 * (n // 20 + 1)))).decode()
        return "\n".join(raw[i : i + 64] for i in range(0, len(raw), 64))
    if kind == 5:
        whole, damage = rng.random() * 0.9, 0.45 + rng.random() * 0.55
        return " ".join((rng.choice(BROKEN) if rng.random() < damage else "") + (rng.choice(words)[:3] if rng.random() < whole else "") + (rng.choice(BROKEN) if rng.random() < damage else "") for _ in range(n))
    if kind == 6:
        phrase = " ".join(rng.choice(words) for _ in range(rng.randint(2, 6))) + rng.choice((". ", ", ", " ", "! ", " » "))
        return phrase * rng.randint(10, 60)
    text, left = " ".join(rng.choice(words) for _ in range(n)), rng.uniform(0.1, 0.4)
    return "".join(c if rng.random() < left else rng.choice(NOISE) if rng.random() < 0.8 else " " for c in text)


JUNKS = 8


def _filler(rng: random.Random, words: list[str], n: int) -> list[str]:
    """n lines that end as sentences do, of eight to eighteen words each."""
    return [" ".join(rng.choice(words) for _ in range(rng.randint(8, 18))).capitalize() + rng.choice(".....!?") for _ in range(n)]


def documents(text: str | None, seed: int) -> Iterator[tuple[str, str]]:
    """(kind, text) of the documents made from one text; none if it has fewer than two sentences or forty words."""
    lines = sentences(text or "")
    words = sorted({w for x in lines for w in _WORD.findall(x)})
    if len(lines) < 2 or len(words) < 40:
        return
    rng = random.Random(seed)
    yield "prose", "\n".join(lines)
    yield "prose", textwrap.fill("  ".join(lines), rng.randint(40, 90))
    yield "prose", " ".join(rng.choice(lines).split()[: rng.randint(1, 6)]) + "."
    # language with pieces that are none: abbreviations, damaged words, and as many numbers as reports hold
    pieces, share = " ".join(lines).split(), rng.uniform(0.01, 0.15)
    odd = _junk(rng, words, rng.choice((0, 1, 2, 4, 5))).split()
    yield "prose", " ".join(rng.choice(odd) if rng.random() < share else x for x in pieces)
    share = rng.uniform(0.1, 0.45)
    yield "prose", " ".join(f"{rng.randrange(10 ** rng.randint(1, 5))}{rng.choice(('', '', ',', '.5'))}" if rng.random() < share else x for x in pieces)
    for make, kind in ((_entries, "list"), (_rows, "table"), (_rows, "table")):
        n = rng.randint(3, 30) if rng.random() < 0.9 else rng.randint(100, 300)
        few = _filler(rng, words, rng.choice((0, 0, 1, 2, rng.randint(0, n - 1))))
        yield kind, "\n".join(few + make(rng, words, n))
        # as many sentences or more make it prose; numbers close to the half teach where it lies
        yield "prose", "\n".join(_filler(rng, words, n + rng.choice((0, 0, 1, 2, n))) + make(rng, words, n))
        yield kind, "\n".join(_filler(rng, words, n - rng.choice((1, 1, 2))) + make(rng, words, n))
    for _ in range(4):
        yield "junk", _junk(rng, words, rng.randrange(JUNKS))
