"""Line statistics of a text, and whether it is language at all."""

from __future__ import annotations

import re
from itertools import islice

_HEX = re.compile(r"^[0-9a-fA-F]{6,8}:?\s+(?:[0-9a-fA-F]{2}\s+){4,}", re.M)
_HARD = re.compile(r"(?<![^\W\d_])(?<!&)[b-df-hj-np-tv-xz]{4,}(?![^\W\d_])", re.I)
_BROKEN = re.compile("�|Ã[\u0080-¿]|â€|Â[ -¿ ]|ï¿½")
_WORD = re.compile(r"[^\W_]+")
_BULLET = re.compile(r"\s*(?:[-*+•·‣◦▪–—]|\(?\d{1,4}[.)]|\(?[A-Za-z][.)])\s+")
_END = tuple(".!?…。")
#: Separators of cells, tried in this order; the last needs short cells, as sentences hold commas too.
_CELLS = [re.compile(x) for x in (r"\t", r"\|", r";", r" {3,}", r" / ", r",")]
FEATURES = ["words", "mean_word_length", "symbol_share", "punct_share", "stop_share", "table_share", "list_share", "letter_share", "broken_share", "hex_share", "hard_share", "distinct_share", "long_share"]


def _row(line: str, j: int) -> bool:
    line = line.strip(" \r\n")
    if j == 1 and line[:1] == "|":  # bars around the row, else a last cell may be empty
        line = line[1:-1] if line[-1] == "|" else line[1:]
    cells = _CELLS[j].split(line)
    if len(cells) < 3 or sum(1 for c in cells if _WORD.search(c)) < 2:
        return False
    # running text holds these signs too: there, cells are long, or the last one ends as a sentence does
    if any(len(c.split()) > (3 if j == 5 else 6) for c in cells) or (line.rstrip().endswith(_END) and len(cells[-1].split()) > 1):
        return False
    return True


def line_shares(lines: list[str]) -> tuple[float, float]:
    """Of the non-blank lines, the share that are rows of three or more cells split by one separator (of the separator
    with most rows), and the share that are entries: at most six words after a bullet or number, and no full stop,
    question or exclamation mark at the end."""
    n = len(lines)
    if not n:
        return 0.0, 0.0
    table = 0
    for j, sign in enumerate(("\t", "|", ";", "   ", " / ", ",")):
        some = [x for x in lines if sign in x]
        if len(some) > table:
            table = max(table, sum(_row(x, j) for x in some))
    entries = 0
    for x in lines:
        if not x.rstrip().endswith(_END):
            m = _BULLET.match(x)
            entries += 0 < sum(1 for _ in islice(_WORD.finditer(x, m.end() if m else 0), 7)) <= 6
    return table / n, entries / n


def features(text: str, stop: frozenset[str] = frozenset()) -> list[float]:
    """The statistics named in FEATURES, in that order."""
    pieces = text.split()
    n = len(pieces) or 1
    visible = sum(map(len, pieces)) or 1
    words = _WORD.findall(text.lower())
    count = len(words) or 1
    alnum = sum(map(len, words))
    letters = sum(map(str.isalpha, text))
    lines = [x for x in text.split("\n") if x.strip()]
    rows = len(lines) or 1
    table, entries = line_shares(lines)
    broken = len(_BROKEN.findall(text)) if not text.isascii() else 0
    return [
        float(len(words)), alnum / count, 1 - min(1.0, alnum / visible), sum(x.rstrip().endswith((".", "!", "?", ":", ";", "…", '"', "”")) for x in lines) / rows,
        sum(w in stop for w in words) / count, table, entries, letters / visible, min(1.0, broken / n), len(_HEX.findall(text)) / rows,
        len(_HARD.findall(text)) / n, len(set(pieces)) / n, sum(len(p) > 40 for p in pieces) / n,
    ]


def is_junk(text: str) -> bool:
    """Symbol or digit soup, broken decoding, hex or base64 dumps, letters without vowels, one phrase over and over."""
    return junk_by(dict(zip(FEATURES, features(text))), len(text.split()))


def junk_by(f: dict[str, float], pieces: int) -> bool:
    if f["table_share"] > 0.5 and f["broken_share"] < 0.3 and f["symbol_share"] < 0.5:
        return False
    return f["letter_share"] < (0.47 if pieces >= 5 else 0.05) or f["broken_share"] > 0.3 or f["hex_share"] > 0.5 or f["hard_share"] > 0.3 or f["long_share"] > 0.3 or (pieces >= 20 and f["distinct_share"] < 0.15)
