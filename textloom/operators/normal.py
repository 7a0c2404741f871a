"""Normal forms of texts, with the places that their characters come from."""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: fixed value: quotes that stand for an apostrophe
APOSTROPHES = "’‘"
#: fixed values: ligatures and what they are written out as
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def plain(text: str) -> str:
    """Lower-case ASCII letters and digits, apostrophes inside words, single spaces; soft hyphens join."""
    text = unicodedata.normalize("NFKC", text.replace("\u00ad", "")).translate(dict.fromkeys(map(ord, APOSTROPHES), "'")).lower()
    return " ".join(re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)*", text))


def plain_with_places(text: str) -> tuple[str, list[int]]:
    """plain, character by character, with the place in text of each character; a character that decomposes gives its first."""
    folded = []
    for i, ch in enumerate(text):
        if ch == "\u00ad":
            continue
        c = (unicodedata.normalize("NFKC", ch) or " ")[0]
        folded.append((("'" if c in APOSTROPHES else c.lower()), i))
    line = "".join(c if len(c) == 1 else " " for c, _ in folded)
    out, places = [], []
    at = None
    for m in re.finditer(r"[a-z0-9]+(?:'[a-z0-9]+)*", line):
        if at is not None:  # the space is the first character after the word before
            out.append(" ")
            places.append(folded[at][1])
        out.append(m[0])
        places += [folded[k][1] for k in range(m.start(), m.end())]
        at = m.end()
    return "".join(out), places


def bare_words(text: str) -> list[str]:
    """Lower-case ASCII words without the marks of letters."""
    text = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", text.lower()))
    return re.findall("[a-z0-9]+", text)


def emitted(text: str) -> str:
    """Composed characters, ligatures written out, single spaces."""
    text = unicodedata.normalize("NFC", text)
    return " ".join("".join(LIGATURES.get(c, c) for c in text).split())


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words of a text, lower-cased, an apostrophe inside kept; places in the text as it stands."""
    word = r"[^\W_]+(?:'[^\W_]+)*"
    if text.isascii():  # every character folds to one, in its own place
        return [(m[0], m.start(), m.end()) for m in re.finditer(word, text.lower())]
    folded = [unicodedata.normalize("NFKC", ch).translate(dict.fromkeys(map(ord, APOSTROPHES), "'")).lower() for ch in text]
    places = array("q", (i for i, c in enumerate(folded) for _ in c))
    return [(m[0], places[m.start()], places[m.end() - 1] + 1) for m in re.finditer(word, "".join(folded))]
