"""Personal data: offset-preserving deobfuscation, then detection.

Two transducers run over a text. The first maps homoglyphs (look-alike Cyrillic, Greek and full-width characters,
exotic digits, hyphens and spaces) to ASCII one character for one. The second rewrites spelled digits ("four", "vier")
and at/dot disguises ("(at)", " dot ", "[punkt]") to single characters and keeps, for every output character, the
source span that it came from. The detectors run on the normalised text; spans are mapped back to source code points.

Defined cases: a null or empty text has no spans. Base spans (detectors on the untouched text) always stay; the method
adds a span only if no span of its kind already covers it. Ties of start order by kind: email, ip, card, phone.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of the plain pattern always starts at the head of a digit run, so the look-behind changes no match but keeps
# long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, cursor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            cursor = m.end()
        at = text.find("@", max(at + 1, cursor))


def detect_spans(text: str) -> list[Span]:
    """Base spans of a text, in order of start, then kind."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return order(out)


def order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Look-alikes of ASCII letters, in the order of their ASCII partners.
_LOOK_ALIKES = {
    "Cyrillic": ("аАВсСеЕНіІјЈкКМоОрРѕЅТхХуУԁһԛԝ", "aABcCeEHiIjJkKMoOpPsSTxXyYdhqw"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαινρυ", "ABEZHIKMNOPTYXoaivpu"),
    "other": ("ıɡɑ‐‑‒–−。․＠﹫", "iga-----..@@"),
}


def _homoglyphs() -> dict[int, str]:
    table = {ord(a): b for glyphs, plain in _LOOK_ALIKES.values() for a, b in zip(glyphs, plain, strict=True)}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
    table |= dict.fromkeys((0xA0, 0x2007, 0x2009, 0x202F, 0x3000), " ")
    for first in (0x660, 0x6F0, 0x966, *range(0x1D7CE, 0x1D800, 10)):  # decimal digits of other scripts
        table |= {first + d: str(d) for d in range(10) if unicodedata.digit(chr(first + d), -1) == d}
    return table


HOMOGLYPHS = _homoglyphs()
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, HOMOGLYPHS))) + "]")

# Digit names from 0 to 9 by language, and names of the signs.
DIGIT_NAMES = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
SIGN_NAMES = {"@": "at arroba arobase", ".": "dot punkt point punto", "+": "plus", "-": "dash hyphen"}
_DIGITS = {w: str(d) for names in DIGIT_NAMES.values() for d, w in enumerate(names.split())} | {"oh": "0"}
_SIGNS = {w: sign for sign, names in SIGN_NAMES.items() for w in names.split()}
_BRACKETED = re.compile(r"[ \t]?[\[({<][ \t]?(@|\.|" + "|".join(_SIGNS) + r")[ \t]?[\])}>][ \t]?", re.I)
_ENTITY = re.compile(r"&#0*(?:64|46);|&#x0*(?:40|2e);|&(?:commat|period);", re.I)
# Bracketed signs stand as runs of \x01 (at) and \x02 (dot) here, so that offsets stay and forms can mix in one address.
_AT, _HIDDEN_DOT = r"[ \t]++(?:at|arroba|arobase)[ \t]++", r"(?:[ \t]++(?:dot|punkt|point|punto)[ \t]++|\x02++)"
_MORE = rf"(?:(?:\.|{_HIDDEN_DOT})[A-Za-z0-9-]++)"
# An address is found from its sign: the domain behind it, the local part before it in the reversed text, so each stretch is read once.
_SIGN_AND_DOMAIN = re.compile(  # a bare "at" counts only with a hidden dot behind it, else every "look at x.y" would be an address
    rf"(?<![ \t]){_AT}[A-Za-z0-9-]++{_MORE}*?{_HIDDEN_DOT}[A-Za-z0-9-]++{_MORE}*|(?<!\x01)\x01++[A-Za-z0-9-]++{_MORE}+", re.I,
)
_LOCAL_REVERSED = re.compile(
    r"[A-Za-z0-9_%+-]++(?:(?:\.|[ \t]++(?:tod|tknup|tniop|otnup)[ \t]++|\x02++)[A-Za-z0-9_%+-]++)*(?![A-Za-z0-9._%+-])", re.I,
)
_LAST = re.compile("[a-z0-9-]+$")
# Endings that make "x at y dot z" an address rather than prose: general ones, and those of countries that are
# no common words (not "to", "so", "la"). A bracketed sign, or a literal @ before a domain without a dot, lets any ending count.
TOP_DOMAINS = frozenset(
    ("com org net edu gov mil int info biz name pro mobi app dev xyz online site shop store tech cloud blog club live news email agency top icu vip test example "
    "io ai co me eu us uk de fr es it nl at ch be ca au jp cn ru br mx in pl se ac ad ae af ag ao aq ar aw ax az ba bb bd bf bg bh bi bj bm bn bo bs bt bw bz "
    "cc cd cf cg ci ck cl cm cr cu cv cw cx cy cz dj dk dm dz ec ee eg er fi fj fk fm fo ga gb gd ge gf gg gh gi gl gm gn gp gq gr gt gu gw gy hk hm hn hr ht hu "
    "id ie il iq ir je jm jo ke kg kh ki km kn kp kr kw ky kz lb lc li lk lr ls lt lu lv ly mc md mg mh mk ml mm mn mo mp mq mr ms mt mv mw mz nc nf ng ni np nr nz "
    "om pa pe pf pg ph pk pm pn pr ps pt pw py qa ro rs rw sb sc sd sg sh sk sl sm sn sr ss st sv sx sy sz tc td tf tg th tj tk tl tm tn tr tt tv tw tz "
    "ua ug uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw").split()
)
#: Endings that are common words too: without a bracketed sign they count only if no further word follows on the line.
_WORD_ENDINGS = frozenset("in me us it at be de es no is as so to am my".split())
_NEXT_WORD = re.compile(r"[ \t]+\w")
# Words before a bare "at" that make it prose, and words behind it that name no domain.
_PROSE_BEFORE = frozenset(
    "aim aimed am are arrive arrived arrives be been being call called come comes eat end ended ends glance good is laugh laughed live lived lives look looked looking looks meet meeting meets met not point "
    "pointed remain remained sat shout sit sits smile smiled stand stands stare stared start started starts stay stayed stays stood stop stopped stops study talk talked wait waited waiting was were work worked working works".split()
)
_PROSE_BEHIND = frozenset("a all an any das dem den der die each el ein eine every her his it its la las le les los my no our some that the their these this those un una une your".split())
_BARE_AT = re.compile(_AT, re.I)
_BARE_DOT = re.compile(rf"@[A-Za-z0-9.-]++(?:{_HIDDEN_DOT}[A-Za-z0-9-]++)+", re.I)
_BARE_SIGN = re.compile(r"(?<![ \t])[ \t]++(" + "|".join(_SIGNS) + r")[ \t]++", re.I)
_NUMBER_WORD = "(?:" + "|".join(sorted({*_DIGITS}, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ \t]++)?(?:{_NUMBER_WORD}|[0-9]++)(?:(?:[ \t,.()-]{{1,3}}|[ \t]++(?:dot|punkt|point|punto|dash|hyphen)[ \t]++)(?:{_NUMBER_WORD}|[0-9]++)(?!\w))+", re.I)
_PIECE = re.compile(rf"{_NUMBER_WORD}(?!\w)|plus|dot|punkt|point|punto|dash|hyphen|[ \t]+|[^ \t]", re.I)
_SPELLED_BYTES = frozenset(w.encode() for w in (*_DIGITS, *"plus dot punkt point punto dash hyphen".split()))
_APART = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_HAS_BARE = re.compile(r"[ \t](?:dot|punkt|point|punto)[ \t]", re.I)


def _addresses(view: str) -> Iterator[tuple[int, int]]:
    """Spans of disguised addresses, leftmost first, without overlap."""
    back, n, end = None, len(view), 0
    for m in _SIGN_AND_DOMAIN.finditer(view):
        back = view[::-1] if back is None else back
        if m.start() >= end and (local := _LOCAL_REVERSED.match(back, n - m.start(), n - end)):
            yield n - local.end(), m.end()
            end = m.end()


def _rewrites(text: str, low: str) -> list[tuple[int, int, str]]:
    """Source spans with what stands for them in the normalised text; they may overlap."""
    out = [(m.start(), m.end(), _SIGNS.get(m[1].lower(), m[1])) for m in _BRACKETED.finditer(text)] if any(b in text for b in "[({<") else []
    if "&" in text:
        out += [(m.start(), m.end(), "@" if m[0].lower() in ("&commat;",) or "64" in m[0] or "40" in m[0] else ".") for m in _ENTITY.finditer(text)]
    bare, view = _HAS_BARE.search(text), text
    if out and (bare or any(sign == "." for _, _, sign in out)):
        parts, end = [], 0
        for s, e, sign in sorted(out):
            if s >= end and sign in "@.":
                parts += [text[end:s], ("\x01" if sign == "@" else "\x02") * (e - s)]
                end = e
        view = "".join([*parts, text[end:]])
    if bare or view is not text:
        for start, end in (*_addresses(view), *(m.span() for m in _BARE_DOT.finditer(view))):
            found = view[start:end]
            if "@" not in found and "\x01" not in found and "\x02" not in found:
                local, domain = _BARE_AT.split(found, maxsplit=1)
                if local.lower() in _PROSE_BEFORE or re.match(r"[A-Za-z0-9-]*", domain)[0].lower() in _PROSE_BEHIND:
                    continue
            last = _LAST.search(found.lower())[0]
            known = "\x01" in found or "\x02" in found or "@" in found and "." not in found
            listed = last in TOP_DOMAINS and ("@" in found or last not in _WORD_ENDINGS or not _NEXT_WORD.match(view, end))
            if listed or known and last.isalpha() and len(last) > 1:
                out += [(m.start(), m.end(), _SIGNS[m[1].lower()]) for m in _BARE_SIGN.finditer(view, start, end)]
    if not _SPELLED_BYTES.isdisjoint(low.encode().translate(_APART).split()):
        for area in _SPELLED.finditer(text):
            names = signs = 0
            parts = []
            for m in _PIECE.finditer(text, *area.span()):
                w = m[0].lower()
                if w in _DIGITS:
                    names += 1
                    parts.append((m.start(), m.end(), _DIGITS[w]))
                elif w in _SIGNS:
                    signs += 1
                    parts.append((m.start(), m.end(), _SIGNS[w]))
                elif w == "," or w.isspace():
                    parts.append((m.start(), m.end(), ""))
            if names >= 4 or names + signs and _holds(text, area.span(), parts):
                out += parts
    return sorted(out)


def _holds(text: str, span: tuple[int, int], parts: list[tuple[int, int, str]]) -> bool:
    """Whether a stretch with few digit names is an address, a number of a card or of a phone only once it is rewritten.

    A number that is whole without its names counts as it stands: the next word may be French "un" or English "one".
    """
    start = span[0] - (text[span[0] - 1 : span[0]] == "+")
    made, end = [], start
    for s, e, new in parts:
        made += [text[end:s], new]
        end = e
    plain = {kind for kind, _, _ in detect_spans(text[start : span[1]])}
    return any(kind not in plain for kind, _, _ in detect_spans("".join([*made, text[end : span[1]]])))


def normalise(text: str) -> tuple[str, list[int], list[int], list[int]] | None:
    """Normalised text with the heads of its segments: positions in it, in the source, and the source length of a rewritten one (0: copied).

    None if nothing in the text is disguised.
    """
    plain = text.translate(HOMOGLYPHS) if not text.isascii() and _ODD.search(text) else text
    found = _rewrites(plain, plain.lower())
    if plain is text and not found:
        return None
    parts, heads, sources, lengths, at, end = [], [], [], [], 0, 0
    for s, e, new in found:
        if s < end:
            continue
        for a, b, put, n in ((end, s, plain[end:s], 0), (s, e, new, e - s)):
            if put:
                heads.append(at)
                sources.append(a)
                lengths.append(n)
                parts.append(put)
                at += len(put)
        end = e
    heads.append(at)
    sources.append(end)
    lengths.append(0)
    parts.append(plain[end:])
    return "".join(parts), heads, sources, lengths


def _source(normal: tuple[str, list[int], list[int], list[int]], s: int, e: int) -> tuple[int, int]:
    _, heads, sources, lengths = normal
    i, j = bisect_right(heads, s) - 1, bisect_right(heads, e - 1) - 1
    start = sources[i] + (0 if lengths[i] else s - heads[i])
    end = sources[j] + (lengths[j] or e - heads[j])
    return start, end


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the normalised text shows, at source offsets; none that a span of the same kind covers already."""
    if (normal := normalise(text)) is None:
        return []
    out: list[Span] = []
    starts = {kind: [s for k, s, _ in base if k == kind] for kind in KINDS}
    ends = {kind: list(accumulate((e for k, _, e in base if k == kind), max)) for kind in KINDS}
    furthest = dict.fromkeys(KINDS, -1)  # spans come in order of start
    for kind, s, e in detect_spans(normal[0]):
        a, b = _source(normal, s, e)
        before = bisect_right(starts[kind], a)
        if furthest[kind] < b and not (before and ends[kind][before - 1] >= b):
            out.append((kind, a, b))
            furthest[kind] = b
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, n_added long, base_spans string, spans string"


def _spans(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base = detect_spans(text or "")
        more = added_spans(text or "", base)
        count = [sum(k == kind for k, _, _ in base) for kind in KINDS]
        rows.append((*count, len(more), _joined(base), _joined(order(base + more)) if more else _joined(base)))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "n_added", "base_spans", "spans"])


def find_pii(text: Column) -> Column:
    """Struct of counts by kind (base spans), n_added, base_spans and spans (``kind:start:end``, code points, comma-joined)."""
    return F.pandas_udf(_spans, _SCHEMA)(text)


def _masked(text: str, spans: list[Span]) -> str:
    """The text with its spans, in order of start, as ``<kind>``."""
    parts, end = [], 0
    for kind, s, e in spans:
        if e > end:
            if s >= end:
                parts += [text[end:s], f"<{kind}>"]
            end = e
    return "".join([*parts, text[end:]])


def _redacted(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        if text and (found := (base := detect_spans(text)) + added_spans(text, base)):
            text = _masked(text, order(found))
        out.append(text)
    return pd.Series(out, dtype=object)


def redact(text: Column) -> Column:
    """The text with every span that ``find_pii`` finds replaced by ``<kind>``; overlapping spans become one. A null text stays null.

    Finding and replacing are one function: as two, each task would hold two Python workers with the same texts.
    """
    return F.pandas_udf(_redacted, "string")(text)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, counts by kind and spans. Repeated rows give repeated results; other columns are left out."""
    return docs.select(F.col(id_col), find_pii(F.col(text_col)).alias("_pii")).select(id_col, "_pii.*")
