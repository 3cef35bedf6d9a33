"""Problem 9: texts that are left-over template, filler, an error page or a demand for scripts.

Templates are induced from the records: every sentence or line is cut into its
constant words and the stretches that can be values (names, numbers, default values,
variable names, blanks; lists of them as one), and all sentences with the same
constants over all documents are aligned stretch by stretch. A stretch whose values
differ from record to record is a slot; a record that leaves a slot of its template blank
or has a default value or a variable's name there is a shell. A default value that
all records have in the same place is part of the sentence, so it is talk.

Marks of template languages are told by a list of patterns, a document at a time; an
ambiguous mark counts if its name stands in several kinds of marks; a mark that is
quoted, or named as an example, is talk about templates.

Whole pages are told by their sentences: a page is flagged if it has a sentence of
an error, a notice or filler and nothing but such sentences and page furniture, if it
is nothing but made-up words over and over, or
if it repeats, numbers aside, a page of other documents that has an error's signs: one
whose first line is an error's or a status code, or that has a fifth of its words in such sentences,
or a short one of which the numbers differ.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .words import INVISIBLE, LOOKALIKES

#: Records of a frame or a page that make a template, constant words of a frame; kinds of marks that make a name a variable.
RECORDS = 3
CONSTANTS = 2
MARK_KINDS = 3
#: Of a repeated page: share of its words in known sentences, words of a first line that is a heading; without these, greatest length.
SHARE = 0.2
HEADING = 12
SHORT = 600
#: Of word salad: least words, and their greatest share of different ones; no language goes on so long without a word of three letters or fewer.
SALAD_WORDS, SALAD_TYPES = 16, 0.75

# ---- Fixed values: marks of template languages, default values, sentences of shells (folded: lower case, no accents).

_NAME = r"[A-Za-z][\w.\- ]{0,40}?"
MARKS = {
    "triple": rf"\{{\{{\{{ ?({_NAME}) ?\}}\}}\}}",
    "double": rf"\{{\{{ ?({_NAME}) ?\}}\}}",
    "dollar": rf"\$\{{ ?({_NAME}) ?\}}",
    "hash": rf"#\{{ ?({_NAME}) ?\}}",
    "erb": rf"<%=? ?({_NAME}) ?%>",
    "block": rf"\{{% ?(?:if|for|include|block|unless) ({_NAME}) ?%\}}",
    "printf": rf"%\(({_NAME})\)s",
    "dunder": r"(?<![\w])__([A-Za-z][A-Za-z0-9_.\-]{0,40}?)__(?![\w])",
    "at": rf"@@({_NAME})@@",
    "xx": r"(?<![\w])XX_([A-Z][A-Z0-9_.\-]{0,40}?)_XX(?![\w])",
    "insert": rf"\[(?:INSERT|insert|Insert) ({_NAME})\]",
    "your": rf"\[(?:your|YOUR|Your) ({_NAME})\]",
    "goes": rf"\[({_NAME}) (?:goes here|GOES HERE|here)\]",
    "here": rf"<({_NAME}) HERE>",
    "guillemet": rf"«({_NAME})»",
    "single": rf"(?<![{{$#\w])\{{({_NAME})\}}(?!\}})",
    "percent": rf"(?<![\w%])%({_NAME})%(?![\w%])",
    "brackets": rf"\[\[ ?({_NAME}) ?\]\]",
}
#: Marks that other texts use too: their name must be a variable.
AMBIGUOUS = {"single", "percent", "brackets", "guillemet", "dunder"}
DEFAULTS = r"\[object Object\]|\bundefined\b|\bnull\b|\bNone\b|\bNaN\b|\bnil\b|#REF!|#N/A"
TALK_BEFORE = r"(?:such as|like|e\.g\.|for example|(?:field|variable|placeholder|mark|token|slot|parameter|key|column|macro)s? (?:is |are )?(?:called|named)|means?|pattern|syntax|mark|write|writes|type|typed)\s*[\"'`“‘]?$"
TALK_AFTER = r"^[\"'`”’]?\s*(?:stands? for|means|is replaced|is a placeholder|marks)"
QUOTES = {"`": "`", '"': '"', "'": "'", "“": "”", "‘": "’", "„": "“"}

REASONS = (
    "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|too many requests|"
    "internal server error|not implemented|bad gateway|service unavailable|gateway timeout|gateway time-out|unavailable"
)
PRODUCT = r"(?:the )?[\w' ]{1,40}"
SCRIPTS = r"(?:java ?scripts?|scripts?|scripting|js|cookies|scripts and cookies|cookies and scripts|javascript and cookies)"
CUES = [
    # errors and error pages
    rf"(?:http/\d\S* )?[45]\d\d ?[-:–]? ?(?:{REASONS})",
    rf"(?:{REASONS})(?: status=\d+.*)?[.!]?$",
    rf"error:? ?[45]\d\d\b",
    r"status=[45]\d\d",
    r"\[(?:error|fatal|fail(?:ed|ure)?)(?::\s?\d+)?\]",
    r"err_[a-z_]+",
    r"traceback \(most recent call last\)",
    r"[a-z]+(?:error|exception): ",
    r"[a-z]+ error: ",
    r"\{\"error\"",
    rf"caption unavailable \((?:{REASONS})\)",
    r"(?:request|connection|query) (?:timed out|failed|refused|reset)",
    r"something went wrong",
    r"(?:an|a|some) (?:unexpected |internal |unknown )?error (?:has )?occurr?ed",
    r"your session (?:has )?expired",
    r"you (?:do not|don't|dont) have permission",
    r"you are not (?:allowed|authori[sz]ed)",
    r"access (?:denied|forbidden)",
    r"the server (?:took too long|is (?:busy|down|unavailable)|did not respond|could not)",
    r"we (?:couldn't|could not|can't|cannot|were unable to) (?:find|open|load|show|play|reach|display)",
    rf"(?:this|the|that) [\w ]{{1,40}} (?:could not be|couldn't be|cannot be|can't be) (?:found|opened|loaded|shown|played|reached|displayed)",
    r"(?:this|the|that) [\w ]{1,40} (?:failed to load|is no longer available|is not available|is unavailable|has been removed|has been deleted|does not exist|doesn't exist)",
    r"the [\w ]{1,40} you asked for (?:doesn't|does not) exist",
    r"page not found",
    r"diese [\w ]{1,30} ist nicht mehr verfugbar",
    r"zugriff verweigert",
    r"(?:die )?seite (?:wurde )?nicht gefunden",
    r"(?:fehler|erreur|fout|errore|erro|ошибка|σφ[αά]λμα|خطأ|त्रुटि|错误|服务器错误|エラー|오류) ?:? ?\d{3}",
    r"\d{3} ?(?:오류|エラー|错误|ошибка|σφ[αά]λμα|خطأ|त्रुटि)",
    r"(?:cette )?page (?:est )?introuvable",
    r"le service est momentanement indisponible",
    r"(?:lo sentimos, )?algo salio mal",
    r"(?:la )?pagina (?:solicitada )?no (?:existe|encontrada)",
    r"страница не найдена",
    r"sidan (?:hittades inte|kunde inte hittas|finns inte)",
    r"siden (?:blev ikke fundet|ble ikke funnet|findes ikke|finnes ikke)",
    r"(?:nie znaleziono strony|strona nie (?:istnieje|zosta[lł]a znaleziona))",
    r"sayfa bulunamad[iı]",
    r"pagina (?:non trovata|nao encontrada|niet gevonden)",
    r"sivua ei (?:loydy|loytynyt)",
    r"stranka (?:nenalezena|nebyla nalezena)",
    r"η? ?σελ[ιί]δα δεν (?:βρ[εέ]θηκε|υπ[αά]ρχει)",
    r"(?:页面(?:不存在|未找到)|找不到(?:该|此)?页面)",
    r"الصفحة غير موجودة",
    r"पृष्ठ नहीं मिला",
    r"페이지를 찾을 수 없습니다",
    r"ページが見つかりません",
    # notices that scripts or cookies are needed
    rf"please (?:enable|turn on|switch on|allow|activate|accept) {SCRIPTS}\b",
    rf"(?:enable|turn on|switch on|allow|activate) {SCRIPTS} (?:to|in|and|for)\b",
    rf"you (?:need to|must|have to|should) (?:enable|allow|turn on|switch on|activate) {SCRIPTS}\b",
    rf"{PRODUCT} (?:requires?|needs) (?:{SCRIPTS}|a browser with (?:scripting|{SCRIPTS}))\b",
    rf"{SCRIPTS} (?:is|are|has been|have been) (?:disabled|turned off|switched off|blocked|off|required|needed)\b",
    r"your browser (?:is blocking|blocks|does not support|has disabled) (?:java ?script|scripts?|scripting|js|cookies)",
    rf"{PRODUCT} (?:does not|doesn't|will not|won't) work without {SCRIPTS}\b",
    r"verify (?:that )?you are (?:a )?human",
    r"checking your browser before",
    r"(?:fur die anzeige werden )?skripte (?:werden )?benotigt",
    r"fur die anzeige werden skripte",
    r"bitte aktivieren sie (?:javascript|cookies)",
    r"veuillez activer (?:javascript|les cookies)",
    r"activa (?:javascript|las cookies)",
    r"включите (?:javascript|cookies)",
    r".{0,30}javascriptを有効",
    r"请启用 ?javascript",
    r".{0,20}javascript.{0,12}(?:활성화|켜)",
    # filler
    r"lorem\b",
    r"(?:your|insert|add|enter) (?:text|title|description|caption|content)s? (?:goes )?here",
    r"(?:text|title|description|caption|content)s? goes here",
    r"\(?(?:content|text|description|details) (?:is )?coming soon\)?",
    r"(?:description|placeholder|body|caption) text will be (?:added|here)",
    r"this is (?:a |an )?(?:dummy|placeholder|sample|example|filler) (?:paragraph|text|sentence|caption)",
    r"(?:title|subtitle|body|heading|caption) text\.?$",
    r"todo: (?:write|add|fill|describe)",
    r"placeholder (?:caption|text|title|description)\b",
    r"texte provisoire",
    r"(?:este es un |esto es |es )?texto de (?:relleno|prueba|ejemplo)\b",
    r"blindtext\b",
    r"hier steht spater",
    r"ここに説明文が入ります",
    r"此处为",
    r"(?:asdf|qwer|jkl)\b",
    r"(?:test test|testing testing)\b",
    r"x{3,}(?: x{2,})+",
    r"(?:sample sample|text text|bla bla)\b",
]
FURNITURE = [
    r"\(?(?:error )?code:? \w+\)?[.!]?$",
    r"(?:please )?try again",
    r"(?:please )?go back to",
    r"(?:please )?sign in",
    r"(?:please )?(?:reload|refresh) (?:the|this) page",
    r"if this keeps happening",
    r"(?:reference|request|trace|kennung|ref)\b:? ?#?[\w-]{1,40}\.?$",
    r"\(c\) ",
    r"back to top",
    r"(?:[\w ]{1,20} \| )+[\w ]{1,20}$",
    r"menu search log in",
    r"loading",
    r"(?:\w+ )?v\d+(?:\.\d+)*$",
    r"how to (?:do this|enable|turn on|allow)",
    r"(?:connection|date|server|content-type|content-length|retry-after): ",
    r"status=",
    rf"(?:please )?(?:also )?(?:allow|turn on|accept|enable) {SCRIPTS}",
    rf"{SCRIPTS} must be (?:allowed|enabled|on)",
    r"this takes up to",
    r"bitte (?:skriptblocker|melden sie)",
    r"(?:retour|retournez) a",
    r"vuelve a intentarlo",
    r"reessayez",
    r"file \"",
    r"line \d+",
    r"请稍后再试",
    r"(?:oops|uh-oh|hmm|sorry|whoops|ups)[.!,]?$",
    r"[a-z][\w.-]*/\d+(?:\.\d+)*|nginx|apache",
    r"(?:para |por favor )?(?:sustituir|reemplazar|cambiar) (?:mas tarde|despues)",
    r"\W*$",
]
LEAD = r"(?:(?:oops|uh-oh|hmm|sorry|whoops|ups|lo sentimos|note|notice|warning)[.!,:]+ *)*"

#: What a template's value can look like, what joins several of one slot, status codes of errors.
VARIABLE = r"\b[A-Za-z]+_\w+|\b[a-z]+[A-Z]\w*"
BLANK = r"_{3,}|(?<=\w) +(?= \w)|(?<=\w) +(?=[,.)](?:\s|$))|(?<=\()\s*(?=\))"
VALUE = rf"{DEFAULTS}|\bN/A\b|{VARIABLE}|\d+(?:[.,:]\d+)*|(?<=[\w,:;)] )[A-Z][\w'’-]*|{BLANK}"
JOINED = r"(?:\s*[,/&](?:\s+and)?|\s+(?:and|or|und|oder|et|ou|y|e|o|en|og|och)(?=\s)|(?=\s))\s*?"
STATUS = r"(?:400|401|402|403|404|405|406|408|409|410|429|451|500|501|502|503|504|505)"
LABEL = r"[^\W\d_][\w ]{0,30}:"

_RUN = re.compile(rf"(?:{VALUE})(?:{JOINED}(?:{VALUE}))*")
_DEFAULT_VALUE = re.compile(DEFAULTS + r"|\bN/A\b")
_VARIABLE = re.compile(VARIABLE)
_SHORT_WORD = re.compile(r"\b[^\W\d_]{1,3}\b|[^\x00-\x7f]|\d|,")
_ANY_VALUE = re.compile(r"[\dA-Z#_]|  | [,.)]|undefined|null|nil|\( *\)")
_LABEL = re.compile(LABEL)
_STATUS = re.compile(rf"(?:[^\W\d_]+\W+){{0,2}}{STATUS}\b(?:\W+\w+){{1,7}}\W*")
_MARKS = {k: re.compile(p) for k, p in MARKS.items()}
_ANY_MARK = re.compile(r"[{\[<«%@]|__|XX_")
_DEFAULTS = re.compile(DEFAULTS)
_CUE = re.compile(LEAD + "(?:" + "|".join(f"(?:{p})" for p in CUES) + ")")
_FURNITURE = re.compile(LEAD + "(?:" + "|".join(f"(?:{p})" for p in FURNITURE) + ")")
_HINT = re.compile(
    r"script|\bjs\b|cookie|human|browser|error|err_|\[fail|traceback|exception|wrong|expired|permission|allowed|denied|server|could|can't|cannot|unable|fail|available|removed|deleted|exist|"
    + REASONS
    + r"|timed out|time-out|verfugbar|verweigert|gefunden|fehler|erreur|fout|ошибка|страница|σφ[αά]λμα|σελ[ιί]δα|sidan|siden|strony|strona|sayfa|trovata|encontrada|gevonden|sivua|stranka|页面|الصفحة|पृष्ठ|خطأ|त्रुटि|错误|エラー|오류|introuvable|indisponible|salio mal|no existe|ページ|페이지|"
    r"skripte|lorem|here|soon|will be|dummy|placeholder|sample|example|filler|todo|provisoire|relleno|blindtext|hier steht|説明文|此处|asdf|qwer|test test|testing|xxx|bla bla|text\b"
)
_TAG = re.compile(r"<!--.*?-->|</?[a-z][^<>]{0,200}>", re.S)
_SEGMENT = re.compile(r"\n+|(?<=[.!?])\s+|(?<=[。！？।])\s*")
_TOKEN = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"\b[0-9a-f]{6,}\b|\d+")


class _Bases(dict):
    """Letters to their ASCII base, filled as they are met; other characters stay."""

    def __missing__(self, code: int) -> int:
        base = ord(unicodedata.normalize("NFD", chr(code))[0])
        self[code] = base if base < 128 else code
        return self[code]


_BASES = _Bases()
_MIXED = re.compile(r"[^\W_]*(?:[A-Za-z][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-z])[^\W_]*")


def fold(text: str) -> str:
    """No accents on Latin letters, no invisible characters, one kind of space; case is kept. In words that mix Latin and other letters the lookalikes are Latin."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text.translate(INVISIBLE)).translate(_BASES)
    return _MIXED.sub(lambda m: m[0].translate(LOOKALIKES), text)


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a stretch stands between a pair of quotes on its line."""
    line = text[text.rfind("\n", 0, start) + 1 : start]
    rest = text[end:].split("\n", 1)[0]
    for a, b in QUOTES.items():
        if a == b:
            opened = [m for m in re.finditer(re.escape(a), line) if a != "'" or m.start() == 0 or not line[m.start() - 1].isalnum()]
            closed = [m for m in re.finditer(re.escape(a), line) if a == "'" and m not in opened]
            if a == "'":
                n = sum(1 for m in opened) - sum(1 for m in re.finditer(r"(?<=[^\s])'(?![A-Za-z])", line))
                if n > 0 and re.search(r"'(?![A-Za-z])", rest):
                    return True
            elif len(opened) % 2 and a in rest:
                return True
        elif line.rfind(a) > line.rfind(b) and b in rest:
            return True
    return False


def variables(name: str) -> list[str]:
    """A name as it is compared, without separators and case: as a whole and without its first parts, which may name the record it belongs to."""
    parts = [x for x in re.split(r"[\W_]+", name.lower()) if x]
    whole = name if re.search(r"[_.\-]", name) else None
    return ["".join(parts[i:]) for i in range(len(parts) if whole else 1)]


def marks_of(text: str) -> list[tuple[str, list[str], int, int]]:
    """(kind, names, start, end) of the placeholder marks that are used, not talked about; text is folded."""
    if not _ANY_MARK.search(text):
        return []
    out, taken = [], []
    for kind, pattern in _MARKS.items():
        for m in pattern.finditer(text):
            s, e = m.span()
            if any(s < b and e > a for a, b in taken):
                continue
            taken.append((s, e))
            if re.search(TALK_BEFORE, text[max(0, s - 30) : s]) or re.match(TALK_AFTER, text[e : e + 30]) or quoted(text, s, e):
                continue
            out.append((kind, variables(m[1]), s, e))
    return out


def frames_of(text: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(frame, [(state, value)]): the sentences with their values taken out, if CONSTANTS words or more are left.

    state: "filled", "default" (a default value is among them), "variable" or "blank". A quoted default is
    part of the frame. A label that ends its line is blank if it is the last one or another label follows.
    """
    out = []
    segments = [x.strip() for x in _SEGMENT.split(text)]
    for i, segment in enumerate(segments):
        label = bool(segment) and segment[-1] == ":" and bool(_LABEL.fullmatch(segment)) and all(_LABEL.match(x) for x in segments[i + 1 : i + 2])
        if not label and not _ANY_VALUE.search(segment, 1 if segment[:1].isupper() else 0):
            continue
        values, frame, at = [], [], 0
        for m in _RUN.finditer(segment):
            value = m[0]
            if _DEFAULT_VALUE.search(value):
                if quoted(segment, *m.span()):
                    continue
                state = "default"
            elif _VARIABLE.search(value):
                state = "variable"
            else:
                state = "filled" if "___" not in value and any(c.isalnum() for c in value) else "blank"
            frame += [segment[at : m.start()].strip(), "\x00"]
            at = m.end()
            values.append((state, " ".join(value.split())))
        frame.append(segment[at:].strip())
        if label:
            frame.append("\x00")
            values.append(("blank", ""))
        if values:
            whole = " ".join(x for x in frame if x).rstrip(" .!?,;")
            if len(_TOKEN.findall(whole)) >= (1 if label or _LABEL.match(segment) else CONSTANTS):
                out.append((whole, values))
    return out


def salad(low: str) -> bool:
    """Whether a text is filler of made-up words: Latin letters only, no short word, number or comma, and the same words over and over."""
    if _SHORT_WORD.search(low):
        return False
    found = _TOKEN.findall(low)
    return len(found) >= SALAD_WORDS and len(set(found)) <= SALAD_TYPES * len(found)


def page(text: str) -> tuple[bool, bool, bool]:
    """(a shell by its own sentences, has signs of one, one if it is repeated) for a folded text."""
    low = text.lower()
    top = low.lstrip(" \t\r\n-*>#|=").split("\n", 1)[0].strip(" \t\r-*>#|=")
    status = len(top) < 100 and bool(_STATUS.fullmatch(top))
    if salad(low):
        return True, True, True
    if not _HINT.search(low):
        return False, status, status
    known = other = cues = 0
    filler: set[str] = set()
    plain = _TAG.sub("\n", low)
    for segment in _SEGMENT.split(plain):
        segment = segment.strip(" \t\r-*>#|=")
        n = len(_TOKEN.findall(segment))
        if not n:
            continue
        if _CUE.match(segment):
            cues += 1
            known += n
            if segment.startswith("lorem"):
                filler.update(_TOKEN.findall(segment))
        elif _FURNITURE.match(segment) or n <= 3:
            known += n
        elif filler and sum(w in filler for w in _TOKEN.findall(segment)) >= 0.6 * n:
            known += n
        elif low.startswith("traceback") or re.match(r"[^.]{1,60} [-–|] \w+$", segment):
            known += n
        else:
            other += n
    first = next((line for line in (x.strip(" \t\r-*>#|=") for x in plain.split("\n")) if _TOKEN.search(line)), "")
    heading = len(_TOKEN.findall(first)) <= HEADING and bool(_CUE.match(first))
    signs = cues > 0 or status
    return cues > 0 and other <= 0.25 * known, signs, signs and (heading or status or known >= SHARE * (known + other))


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode(errors="replace"), digest_size=16).hexdigest()


def _slot(frame: str, place: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{place}\x00{frame}".encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


def evidence(text: str) -> tuple[list[tuple[str, str, str, bool]], list[tuple[int, str, int]]]:
    """(what, key, value, sure) of marks by variable and kind and of the page by itself or by its skeleton; (slot, state, value) of the sentences' values."""
    folded = fold(text)
    out: set[tuple[str, str, str, bool]] = set()
    slots: set[tuple[int, str, int]] = set()
    marks = marks_of(folded)
    several = len({kind for kind, *_ in marks}) > 1  # two kinds of marks in one text are no other use of either
    for kind, names, _, _ in marks:
        out.update(("mark", name, kind, several or kind not in AMBIGUOUS) for name in names)
    for frame, values in frames_of(folded):
        for place, (state, value) in enumerate(values):
            slots.add((_slot(frame, place), state, zlib.crc32(value.encode(errors="replace"))))
        if sum(len(_DEFAULTS.findall(value)) for state, value in values if state == "default") > 1:
            out.add(("default", "", "", True))  # several values of one record can't all be words
    shell, signs, chiefly = page(folded)
    if shell:
        out.add(("page", "", "", True))
    elif signs and (chiefly or len(folded) <= SHORT):
        skeleton = _digest(re.sub(r"\s+", " ", _NUMBER.sub("0", folded.lower())).strip())
        if chiefly:
            out.add(("repeat", skeleton, "", False))
        if len(folded) <= SHORT:
            out.add(("skeleton", skeleton, _digest(folded.strip()), False))
    return sorted(out), sorted(slots)


def find_shells(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reasons): the rows whose text is a shell, with the sorted reasons: placeholder, default value, page.

    Null, empty and blank texts are no shells; repeated texts are judged alike; an
    empty table gives no rows; other columns are not read. A text of any length is
    read whole. Names, frames and pages are counted over all rows; the counts stay
    distributed. Of the values of a frame's slots only their number, the least and the greatest hash are
    kept, summed in every batch before the shuffle, so a template that a third of all rows use is one row a batch.
    """
    kind = df.schema[key].dataType.simpleString()
    names = ["k", "what", "name", "value", "sure", "slot", "lo", "hi", "n"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found, filled = [], [], {}
            for i, t in enumerate(b.column("t").to_pylist()):
                signs, slots = evidence(t.decode(errors="replace"))
                for what, name, value, sure in signs:
                    rows.append(i)
                    found.append((what, name, value, sure, None, None, None, 0))
                for slot, state, value in slots:
                    if state == "filled":
                        lo, hi, n = filled.get(slot, (value, value, 0))
                        filled[slot] = (min(lo, value), max(hi, value), n + 1)
                    else:
                        rows.append(i)
                        found.append(("slot", "", state, False, slot, value, value, 0))
            found += [("filled", "", "", False, slot, lo, hi, n) for slot, (lo, hi, n) in filled.items()]
            if found:
                keys = b.column("k").take(pa.array(rows + [None] * len(filled), pa.int64()))
                kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(zip(*found), kinds)]], names=names)

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).where(F.col("t").isNotNull() & (F.length("t") > 0))
    seen = stored(rows.mapInArrow(look, f"k {kind}, what string, name string, value string, sure boolean, slot long, lo long, hi long, n long"), "shell-signs")
    what, value = F.col("what"), F.col("value")
    # One row per name or page: how many different values its records have.
    kinds = seen.where(what.isin("mark", "repeat", "skeleton")).groupBy("what", "name").agg(F.count_distinct("k").alias("records"), F.count_distinct("value").alias("values"))
    template = kinds.where(
        ((what == "mark") & (F.col("values") >= MARK_KINDS)) | ((what == "repeat") & (F.col("records") >= RECORDS)) | ((what == "skeleton") & (F.col("records") >= RECORDS) & (F.col("values") > 1))
    ).select("what", "name")
    # One row per place of a frame that some record leaves open: how many fill it, how many don't, and whether the values differ.
    opened = seen.where(what == "slot").select("k", "slot", "value")
    places = seen.where(what.isin("slot", "filled")).groupBy("slot").agg(F.sum("n").alias("filled"), F.count_if(what == "slot").alias("open"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    places = places.where((F.col("open") > 0) & (F.col("lo") < F.col("hi")) & (F.col("filled") + F.col("open") >= RECORDS)).select("slot", ((F.col("filled") >= RECORDS) & (F.col("filled") > F.col("open"))).alias("used"))
    # A blank or a name is only left over where most records have a value; default values that differ are a slot's anyhow.
    unfilled = opened.join(places, "slot").where((value == "default") | F.col("used")).select("k", F.lit("slot").alias("what"))
    own = seen.where(F.col("sure")).select("k", "what")
    shared = seen.where(~F.col("sure") & what.isin("mark", "repeat", "skeleton")).join(template, ["what", "name"], "left_semi").select("k", "what")
    reason = F.when(what == "mark", "placeholder").when(what.isin("slot", "default"), "default value").otherwise("page")
    return own.unionByName(shared).unionByName(unfilled).groupBy("k").agg(F.array_sort(F.collect_set(reason)).alias("reasons")).select(F.col("k").alias(key), "reasons")
