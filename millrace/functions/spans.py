"""Structured spans: placeholders, tags, addresses, numbers with units and identifiers that must survive a translation.

Nested brackets and quotes need a scanner, so texts are scanned by functions
over Arrow batches, each text once for each result that is asked for.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the kinds that need no scanner.
ENTITY = r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]+);"
EMAIL = r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_.-])"
URL = r"https?://[^\s<>\"']+"
NAMED_PERCENT = r"%[A-Za-z_][A-Za-z0-9_]{1,}"
PRINTF = r"%(?:\d+\$)?[-+#0 ']*(?:\d+|\*)?(?:\.(?:\d+|\*))?(?:hh|h|ll|l|j|z|t|L)?[diuoxXfFeEgGaAcspnCS]"
IDENTIFIER = (
    r"(?<![A-Za-z0-9_.-])(?:[A-Z]{2,}[A-Z0-9_-]*|[A-Za-z][A-Za-z0-9]*(?:[_.-][A-Za-z0-9]+)+|"
    r"[A-Za-z][A-Za-z0-9_.-]*\d[A-Za-z0-9_.-]*|\d[A-Za-z][A-Za-z0-9_.-]*)(?![A-Za-z0-9_.-])"
)
NUMBER = (
    r"(?<![A-Za-z0-9_])(?:[$€£¥₩₹]\s*)?[+-]?(?:\d{1,4}(?:[.,:/]\d+)+|\d+(?:[.,]\d+)?)"
    r"(?:\s?(?:%|‰|°[CF]?|KiB|MiB|GiB|TiB|KB|MB|GB|TB|B|kg|mg|µg|μg|g|km|cm|mm|m|ms|µs|μs|ns|sec|min|hrs?|days?|"
    r"kW|MW|GW|W|kWh|mAh|Ah|Hz|kHz|MHz|GHz|Pa|kPa|MPa|ml|mL|cl|cL|dl|dL|L|개|명|원|엔|달러|유로|퍼센트))?"
    r"(?:\s?(?:-|–|—|~|〜)\s?(?:[$€£¥₩₹]\s*)?[+-]?\d+(?:[.,]\d+)?"
    r"(?:\s?(?:%|‰|°[CF]?|KiB|MiB|GiB|TiB|KB|MB|GB|TB|B|kg|mg|µg|μg|g|km|cm|mm|m|ms|sec|min|hrs?|days?))?)?(?![A-Za-z0-9_])"
)
TRANSLATED_SUFFIX = r"(?:퍼센트|달러|유로|개|명|원|엔)$"
URL_END = ".,!?;:。！？、，；："
URL_PARTICLES = (
    "으로부터", "에게서", "에서부터", "까지도", "으로는", "으로도", "에서는", "에게는", "부터", "까지", "처럼", "보다", "으로", "에게", "한테", "께서", "에서",
    "와", "과", "을", "를", "은", "는", "이", "가", "의", "에", "도", "만", "로",
)
# The higher kind wins where spans overlap; kinds whose inside counts for nothing; kinds that may never change.
PRIORITY = {
    "html": 140, "placeable": 130, "template": 130, "url": 115, "email": 115, "entity": 110, "placeholder": 105, "percent_placeholder": 100, "printf": 100,
    "number": 90, "identifier": 80,
}
OPAQUE = ("placeable", "template", "url", "email", "entity")
CRITICAL = ("placeable", "template", "placeholder", "percent_placeholder", "printf", "entity")

_PATTERNS = (
    ("entity", re.compile(ENTITY)), ("email", re.compile(EMAIL)), ("url", re.compile(URL)), ("percent_placeholder", re.compile(NAMED_PERCENT)),
    ("printf", re.compile(PRINTF)), ("number", re.compile(NUMBER, re.IGNORECASE)), ("identifier", re.compile(IDENTIFIER)),
)
_SUFFIX = re.compile(TRANSLATED_SUFFIX, re.IGNORECASE)
_PARTICLE = re.compile("(?<=[A-Za-z0-9/=_-])(?:" + "|".join(sorted(URL_PARTICLES, key=len, reverse=True)) + ")$")
_MARK = re.compile(r"[\\{}\"']")
_TAG_MARK = re.compile(r"[\\>\"']")
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*|\d+")
_SPACES = re.compile(r"\s+")
SLOTS = tuple(f"<slot_{i}>" for i in range(64))


class Span(NamedTuple):
    start: int
    end: int
    surface: str
    kind: str
    key: str


def _span(text: str, start: int, end: int, kind: str) -> Span:
    surface = text[start:end]
    plain = _SPACES.sub(" ", surface.strip()) if kind in ("placeable", "template", "placeholder", "html") else surface
    return Span(start, end, surface, kind, f"{kind}\0{plain}")


def _unquoted(marks: re.Pattern, text: str, start: int) -> Iterable[tuple[int, str]]:
    """(place, mark) of what is neither quoted nor behind a backslash, from ``start``."""
    quote, skip = "", -1
    for m in marks.finditer(text, start):
        c = m[0]
        if m.start() == skip:
            continue
        if c == "\\":
            skip = m.end()
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        else:
            yield m.start(), c


def _braces(text: str) -> Iterable[Span]:
    """Balanced {...} and ${...}, also those inside others; an escaped ${ is none."""
    at = text.find("{")
    while at >= 0:
        dollar = at > 0 and text[at - 1] == "$"
        depth = 0
        for place, c in _unquoted(_MARK, text, at) if not (dollar and at > 1 and text[at - 2] == "\\") else ():
            depth += 1 if c == "{" else -1
            if not depth:
                kind = "template" if dollar else "placeholder" if _PLAIN.fullmatch(text[at + 1 : place].strip()) else "placeable"
                yield _span(text, at - dollar, place + 1, kind)
                break
        at = text.find("{", at + 1)


def _tags(text: str) -> Iterable[Span]:
    """Tags; a > inside a quoted attribute does not end one, and slots are none."""
    at = text.find("<")
    while at >= 0:
        after = text[at + 1 : at + 2]
        end = None
        if (after.isalpha() or (after and after in "/!?")) and not text.startswith("<slot_", at):
            end = next((place + 1 for place, _ in _unquoted(_TAG_MARK, text, at + 1)), None)
        if end:
            yield _span(text, at, end, "html")
        at = text.find("<", end or at + 1)


def _url_end(text: str, start: int, end: int) -> int:
    """Where an address ends: before closing marks, brackets it does not open, and one Korean particle."""
    end = start + len(text[start:end].rstrip(URL_END))
    while end > start and text[end - 1] in ")]}>":
        inside, close = text[start:end], text[end - 1]
        if inside.count(close) <= inside.count("([{<"[")]}>".index(close)]):
            break
        end -= 1
    particle = _PARTICLE.search(text[start:end])
    return start + particle.start() if particle else end


def candidates(text: str) -> list[Span]:
    """All spans, overlapping ones too, by place, the longer first."""
    found = [*_braces(text), *_tags(text)]
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "url":
                b = _url_end(text, a, b)
                if b - a <= len("https://"):
                    continue
            elif kind == "number":
                suffix = _SUFFIX.search(m[0])
                b -= len(suffix[0]) if suffix else 0
            if b > a:
                found.append(_span(text, a, b, kind))
    return sorted({(s.start, s.end, s.kind): s for s in found}.values(), key=lambda s: (s.start, -s.end, s.kind))


def disjoint(found: Iterable[Span]) -> list[Span]:
    """Without overlaps: the higher kind first, then the longer, the earlier, the smaller key."""
    taken: list[Span] = []
    for s in sorted(found, key=lambda s: (-PRIORITY[s.kind], s.start - s.end, s.start, s.key)):
        if all(s.end <= t.start or t.end <= s.start for t in taken):
            taken.append(s)
    return sorted(taken)


def signature_spans(text: str) -> list[Span]:
    """What counts for a text: all but the uncritical spans inside an opaque one."""
    found = candidates(text)
    opaque = [s for s in found if s.kind in OPAQUE]
    inside = lambda s: any(o is not s and o.start <= s.start and s.end <= o.end for o in opaque)
    return [s for s in found if s.kind in CRITICAL or not inside(s)]


def keys_of(text: str, numbers: bool = True) -> list[str]:
    """The bag of span keys of a text."""
    return [s.key for s in signature_spans(text) if numbers or s.kind != "number"]


def compared(a: str, b: str) -> tuple[float, bool]:
    """Multiset Jaccard similarity of the keys (1 without any), and whether a critical key's count differs."""
    bags = []
    crucial: set[str] = set()
    for t in (a, b):
        found = signature_spans(t)
        bags.append(Counter(s.key for s in found))
        crucial.update(s.key for s in found if s.kind in CRITICAL)
    x, y = bags
    either = sum((x | y).values())
    return (sum((x & y).values()) / either if either else 1.0), any(x[k] != y[k] for k in crucial)


def _put(text: str, found: list[Span], slot: dict[str, str]) -> str:
    out, at = [], 0
    for s in found:
        if s.key in slot:
            out += [text[at : s.start], slot[s.key]]
            at = s.end
    return "".join(out) + text[at:]


def mask_text(text: str, slots: tuple[str, ...] = SLOTS) -> tuple[str, dict[str, str]]:
    """The text with one slot for each key, and each slot's surface."""
    found = disjoint(candidates(text))
    first = {s.key: s.surface for s in reversed(found)}
    slot = dict(zip(dict.fromkeys(s.key for s in found), slots, strict=False))
    return _put(text, found, slot), {slot[k]: first[k] for k in slot}


def share_slots(a: str, b: str, slots: tuple[str, ...] = SLOTS) -> tuple[str, str]:
    """Both texts with the same slot for each key that both keep once overlaps are gone."""
    x, y = candidates(a), candidates(b)
    both = {s.key for s in x} & {s.key for s in y}
    if not both or not slots:
        return a, b
    x, y = (disjoint(s for s in found if s.key in both) for found in (x, y))
    kept = {s.key for s in y}
    slot = dict(zip(dict.fromkeys(s.key for s in x if s.key in kept), slots, strict=False))
    return _put(a, x, slot), _put(b, y, slot)


def restore_text(text: str, slots: dict[str, str]) -> tuple[str, list[str]]:
    """The text with surfaces for slots, and the slots that it lost."""
    missing = [k for k in slots if k not in text]
    for k in sorted(slots, key=len, reverse=True):
        text = text.replace(k, slots[k])
    return text, missing


# columns ---------------------------------------------------------------------------------

_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), *_text("surface", "kind", "key")]))


def _rows(values: Iterable[tuple | None], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([v if v is not None else (None,) * len(names) for v in values], columns=names, dtype=object)


@F.pandas_udf(SPAN)
def spans(text: pd.Series) -> pd.Series:
    """The disjoint spans of a text in order; none of a null text."""
    return text.map(lambda t: [s._asdict() for s in disjoint(candidates(t or ""))])


@F.pandas_udf(T.ArrayType(T.StringType()))
def signature(text: pd.Series) -> pd.Series:
    return text.map(lambda t: keys_of(t or ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens(text: pd.Series) -> pd.Series:
    """The signature without numbers, which are scored by themselves."""
    return text.map(lambda t: keys_of(t or "", False))


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("critical", T.BooleanType())]))
def similarity(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """(score, critical) of two texts; a null one is empty."""
    return pd.DataFrame([compared(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["score", "critical"])


@F.pandas_udf(T.StructType([*_text("text"), T.StructField("slots", T.MapType(T.StringType(), T.StringType()))]))
def mask(text: pd.Series) -> pd.DataFrame:
    return _rows((mask_text(t) if t is not None else None for t in text), ["text", "slots"])


@F.pandas_udf(T.StructType(_text("a", "b")))
def shared_slots(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Spans with the same key on both sides as the same slots, at most 64."""
    return _rows((share_slots(x, y) if x is not None and y is not None else (x, y) for x, y in zip(a, b, strict=True)), ["a", "b"])


def restored(text: Column, slots: Column) -> Column:
    """Surfaces for slots; native, for slots as ``mask`` names them."""
    pairs = F.array_sort(F.map_entries(slots), lambda x, y: F.length(y["key"]) - F.length(x["key"]))
    return F.when(slots.isNull(), text).otherwise(F.aggregate(pairs, text, lambda t, p: F.replace(t, p["key"], p["value"])))


# The surfaces of each class of units.
UNITS = {
    "percent": ("%", "퍼센트", "パーセント"), "permille": ("‰", "퍼밀"), "celsius": ("℃", "°c", "섭씨", "摂氏"), "fahrenheit": ("℉", "°f", "화씨", "華氏"), "microgram": ("mcg", "µg", "마이크로그램"),
    "milligram": ("mg", "밀리그램", "ミリグラム"), "gram": ("g", "그램", "グラム"), "kilogram": ("kg", "킬로그램", "キログラム"), "ton": ("톤", "トン"), "millilitre": ("ml", "밀리리터", "ミリリットル"), "litre": ("리터", "リットル"),
    "cubic_centimetre": ("cc", "세제곱센티미터"), "milligram_per_litre": ("mg/l",), "microgram_per_litre": ("mcg/l", "µg/l"), "gram_per_litre": ("g/l",), "milligram_per_kilogram": ("mg/kg",), "millimetre": ("mm", "밀리미터", "ミリメートル"),
    "centimetre": ("cm", "센티미터", "センチメートル"), "metre": ("미터", "メートル"), "kilometre": ("km", "킬로미터", "キロメートル"), "kilobyte": ("kb", "킬로바이트", "キロバイト"), "megabyte": ("mb", "메가바이트", "メガバイト"),
    "gigabyte": ("gb", "기가바이트", "ギガバイト"), "terabyte": ("tb", "테라바이트", "テラバイト"), "won": ("원", "ウォン", "krw", "₩"), "yen": ("엔", "円", "jpy", "¥"), "dollar": ("달러", "ドル", "usd"), "euro": ("유로", "ユーロ", "eur", "€"),
    "kilometre_per_hour": ("km/h", "kph"), "metre_per_second": ("m/s",), "hertz": ("hz", "헤르츠", "ヘルツ"),
}
_CLASS = {s: c for c, many in UNITS.items() for s in many}
_UNIT = re.compile("|".join(map(re.escape, sorted(_CLASS, key=len, reverse=True))))


def units_of(text: str | None) -> list[str]:
    """Classes of the units that follow a digit; a Latin unit is no part of a longer word."""
    t = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "")).casefold()
    out = []
    for m in _UNIT.finditer(t):
        before = t[: m.start()].rstrip(" ")[-1:]
        latin = re.search("[a-z]", m[0]) and re.match("[a-z]", t[m.end() : m.end() + 1])
        if before.isdigit() and not latin:
            out.append(_CLASS[m[0]])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def unit_tokens(s: pd.Series) -> pd.Series:
    return s.map(units_of)
