"""The words of a text as they count for comparing texts, whatever the text was wrapped in."""

from __future__ import annotations

import html
import re
import unicodedata

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
        "ο": "o", "α": "a", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "χ": "x", "ε": "e", "τ": "t", "η": "n",
    }
)
#: Characters that show nothing: zero-width ones, soft hyphen, byte order mark, variation selectors.
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0xFE00, 0xFE10)])

_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_PAIR = re.compile("[\ud800-\udbff][\udc00-\udfff]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.S)
_TIME = re.compile(r"\[\d{1,2}(?::\d{2}){1,2}\]")
_CONTROL = re.compile(r"\\[nrt\"/]")
#: Scripts written without spaces (Thai to Khmer, kana, Han), of which each character is a word.
UNSPACED = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")
_LATIN = re.compile(r"[a-z]")
_FOREIGN = re.compile(r"[\u0370-\u03ff\u0400-\u04ff]")


def plain(text: str) -> str:
    """Escapes and entities resolved, tags and time marks taken out, accents and invisible characters dropped, lower case."""
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
        text = _PAIR.sub(lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), text)
        text = _CONTROL.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[" in text:
        text = _TIME.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(INVISIBLE))
        text = "".join([c for c in text if not unicodedata.combining(c)])
    return text.casefold()


def words(text: str) -> list[str]:
    """The words: runs of letters and digits of the plain text, in scripts without spaces each character. In a word of Latin and other letters the lookalikes are Latin."""
    out = _WORD.findall(plain(text))
    if not text.isascii():
        out = [w.translate(LOOKALIKES) if _FOREIGN.search(w) and (_LATIN.search(w) or len(w) <= 2) else w for w in out]
    return out
