"""How values are shown: number patterns, percentages, currencies and dates of some locales, and their d3 formats.

This is display; nothing of it runs in a query but where formatted frames are asked for.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_EVEN, Decimal

from .types import Type

# The patterns of the en_US locale, by kind; dates by grain; signs of currencies; names of days and months.
NUMBER_PATTERNS = {"number": "#,##0.###", "decimal": "#,##0.###", "percent": "#,##0%", "currency": "¤#,##0.00"}
GRAIN_PATTERNS = {
    "year": "y", "quarter": "QQQ y", "month": "MMMM y", "week": "'week' w 'of' Y", "day": "M/d/y", "hour": "M/d/yy, h:mm a",
    "minute": "M/d/yy, h:mm a", "second": "MMM d, y, h:mm:ss a",
}
SKELETONS = {
    "y": "y", "yQQQ": "QQQ y", "MMMMy": "MMMM y", "yMMMM": "MMMM y", "yMMM": "MMM y", "yw": "'week' w 'of' Y", "yMd": "M/d/y", "yMMMd": "MMM d, y", "MMMd": "MMM d",
    "Md": "M/d", "yM": "M/y", "yMMMEd": "EEE, MMM d, y", "hm": "h:mm a", "Hm": "HH:mm", "hms": "h:mm:ss a", "Hms": "HH:mm:ss", "d": "d", "M": "L",
}
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "CN¥", "INR": "₹", "KRW": "₩", "BRL": "R$", "CAD": "CA$", "AUD": "A$", "MXN": "MX$", "ILS": "₪", "VND": "₫", "NZD": "NZ$", "TWD": "NT$", "PHP": "₱"}
WHOLE_CURRENCIES = {"JPY", "KRW", "VND", "CLP", "ISK"}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@dataclass(frozen=True)
class Locale:
    """What a locale has of its own; the rest is as in en_US."""

    decimal: str = "."
    group: str = ","
    numbers: tuple[tuple[str, str], ...] = ()
    grains: tuple[tuple[str, str], ...] = ()
    months: tuple[str, ...] = MONTHS
    short_months: tuple[str, ...] = tuple(m[:3] for m in MONTHS)
    days: tuple[str, ...] = DAYS
    quarter: str = "Q"
    monday_first: bool = False

    def pattern(self, kind: str) -> str:
        return dict(self.numbers).get(kind, NUMBER_PATTERNS[kind])

    def grain(self, grain: str) -> str:
        return dict(self.grains).get(grain, GRAIN_PATTERNS[grain])


# Separators, patterns and names of locales. Their weeks are those of ISO 8601.
_BEHIND = (("percent", "#,##0\xa0%"), ("currency", "#,##0.00\xa0¤"))
LOCALES = {
    "en_US": Locale(),
    "en_GB": Locale(
        grains=(("day", "dd/MM/y"), ("hour", "dd/MM/y, HH:mm"), ("minute", "dd/MM/y, HH:mm"), ("second", "d MMM y, HH:mm:ss")), monday_first=True,
        short_months=("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sept", "Oct", "Nov", "Dec"),
    ),
    "de_DE": Locale(
        ",", ".", _BEHIND, (("week", "'Woche' w 'des' 'Jahres' Y"), ("day", "dd.MM.y"), ("hour", "dd.MM.yy, HH:mm"), ("minute", "dd.MM.yy, HH:mm"), ("second", "dd.MM.y, HH:mm:ss")),
        ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
        ("Jan.", "Feb.", "März", "Apr.", "Mai", "Juni", "Juli", "Aug.", "Sept.", "Okt.", "Nov.", "Dez."),
        ("Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag"), monday_first=True,
    ),
    "fr_FR": Locale(
        ",", "\u202f", (("percent", "#,##0\u202f%"), ("currency", "#,##0.00\xa0¤")),
        (("week", "'semaine' w 'de' Y"), ("day", "dd/MM/y"), ("hour", "dd/MM/y HH:mm"), ("minute", "dd/MM/y HH:mm"), ("second", "d MMM y, HH:mm:ss")),
        ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
        ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc."),
        ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche"), "T", True,
    ),
    "es_ES": Locale(
        ",", ".", _BEHIND, (("month", "MMMM 'de' y"), ("week", "'semana' w 'de' Y"), ("day", "d/M/y"), ("hour", "d/M/yy, H:mm"), ("minute", "d/M/yy, H:mm"), ("second", "d MMM y, H:mm:ss")),
        ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
        ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sept", "oct", "nov", "dic"),
        ("lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"), "T", True,
    ),
}


def locale_of(name: str) -> Locale:
    """A locale by its name, by its language alone, or en_US."""
    known = name.replace("-", "_")
    return LOCALES.get(known) or next((v for k, v in LOCALES.items() if k[:2] == known[:2].lower()), LOCALES["en_US"])


@dataclass(frozen=True)
class NumberPattern:
    """A number pattern of LDML, taken apart."""

    prefix: str
    suffix: str
    negative: tuple[str, str] | None
    least_int: int
    least_frac: int
    most_frac: int
    group: int | None
    group_far: int | None
    exponent: int | None
    significant: tuple[int, int] | None
    point: bool

    @property
    def percent(self) -> bool:
        return "%" in self.prefix + self.suffix

    @property
    def currency(self) -> bool:
        return "¤" in self.prefix + self.suffix


def number_pattern(text: str) -> NumberPattern:
    positive, _, negative = text.partition(";")
    m = re.fullmatch(r"([^#0,.@E]*)([#0,.@]+)(?:E(\+?)(0+|#+)|E)?(.*)", positive)
    if not m:
        raise ValueError(f"{text!r} isn't a number pattern")
    prefix, body, _, exponent, suffix = m.groups()
    whole, dot, fraction = body.partition(".")
    groups = whole.split(",")
    digits = "".join(groups)
    significant = (digits.count("@"), digits.count("@") + len(digits[digits.rfind("@") + 1 :])) if "@" in digits else None
    own = None
    if negative:
        n = re.fullmatch(r"([^#0,.@E]*)[#0,.@]+(?:E[+0#]*)?(.*)", negative)
        own = (n[1], n[2]) if n else None
    return NumberPattern(
        prefix, suffix, own, digits.count("0"), fraction.count("0"), len(fraction), len(groups[-1]) if len(groups) > 1 else None,
        len(groups[-2]) if len(groups) > 2 else None, exponent.count("0") or 1 if exponent else None, significant, bool(dot),
    )


def _grouped(digits: str, p: NumberPattern, mark: str) -> str:
    if not p.group or len(digits) <= p.group:
        return digits
    head, parts, size = digits[: -p.group], [digits[-p.group :]], p.group_far or p.group
    while len(head) > size:
        parts.insert(0, head[-size:])
        head = head[:-size]
    return mark.join([head, *parts])


def format_number(value: float, pattern: str, currency: str | None = None, locale: Locale = LOCALES["en_US"]) -> str:
    """A number by a pattern; halves are rounded to even digits, as locales do."""
    p = number_pattern(pattern)
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "∞" if value > 0 else "-∞"
    x = Decimal(str(value)) * (100 if p.percent else 1)
    minus, x = x < 0, abs(x)
    tail = ""
    if p.exponent:
        power = x.adjusted() - max(p.least_int - 1, 0) if x else 0
        x, tail = x.scaleb(-power), f"E{power:0{p.exponent}d}" if power >= 0 else f"E-{-power:0{p.exponent}d}"
    least, most = p.least_frac, p.most_frac
    if p.significant:
        places = p.significant[1] - 1 - (x.adjusted() if x else 0)
        x = x.quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN)
        least, most = max(0, p.significant[0] - 1 - (x.adjusted() if x else 0)), max(0, places)
    elif p.currency and currency in WHOLE_CURRENCIES:
        least = most = 0
    x = x.quantize(Decimal(1).scaleb(-most), ROUND_HALF_EVEN)
    whole, _, fraction = f"{x:f}".partition(".")
    while len(fraction) > least and fraction.endswith("0"):
        fraction = fraction[:-1]
    whole = whole.lstrip("0").rjust(max(p.least_int, 0 if fraction else 1), "0")
    prefix, suffix = p.prefix, p.suffix
    if minus:
        prefix, suffix = p.negative or ("-" + prefix, suffix)
    text = prefix + _grouped(whole, p, locale.group) + (locale.decimal + fraction if fraction else "") + tail + suffix
    return text.replace("¤¤", currency or "").replace("¤", SIGNS.get(currency, f"{currency}\xa0") if currency else "")


def week_of(v: datetime) -> tuple[int, int]:
    """(year, week) as en_US counts: weeks start on Sunday, and the first is that of January 1."""
    start = v - timedelta(days=v.isoweekday() % 7)
    year = (start + timedelta(days=6)).year
    first = datetime(year, 1, 1)
    first -= timedelta(days=first.isoweekday() % 7)
    return year, (start.date() - first.date()).days // 7 + 1


def format_time(value: datetime | date, pattern: str, locale: Locale = LOCALES["en_US"]) -> str:
    """A date or time by a pattern."""
    v = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
    week_year, week = v.isocalendar()[:2] if locale.monday_first else week_of(v)
    twelve, quarter = v.hour % 12 or 12, (v.month + 2) // 3

    def field(m: re.Match) -> str:
        token = m[0]
        if token[0] == "'":
            return token[1:-1].replace("''", "'") or "'"
        c, n = token[0], len(token)
        year = week_year if c == "Y" else v.year
        if c in "yY":
            return f"{year % 100:02d}" if n == 2 else f"{year:0{n}d}"
        if c in "ML":
            return f"{v.month:0{n}d}" if n < 3 else locale.short_months[v.month - 1] if n == 3 else locale.months[v.month - 1][: 1 if n == 5 else None]
        if c == "Q":
            return f"{quarter:0{n}d}" if n < 3 else f"{locale.quarter}{quarter}" if n == 3 else f"{quarter}{('st', 'nd', 'rd', 'th')[quarter - 1]} quarter"
        if c == "E":
            return locale.days[v.weekday()][: 3 if n < 4 else None]
        if c == "a":
            return "AM" if v.hour < 12 else "PM"
        if c == "S":
            return f"{v.microsecond:06d}"[:n]
        number = {"d": v.day, "h": twelve, "H": v.hour, "K": v.hour % 12, "k": v.hour or 24, "m": v.minute, "s": v.second, "w": week, "D": v.timetuple().tm_yday, "e": v.isoweekday() % 7 + 1}.get(c)
        return token if number is None else f"{number:0{n}d}"

    return re.sub(r"'(?:[^']|'')*'|([A-Za-z])\1*", field, pattern)


class Formatter:
    """Shows values of one column. config: a kind, or {kind, pattern, skeleton, currency}."""

    def __init__(self, type: Type, config: object = None, locale: str = "en_US", currency: str = "USD"):
        config = {"kind": config} if isinstance(config, str) else dict(config or {})
        self.type, self.locale = type, locale_of(locale)
        self.kind = config.get("kind") or {"int": "number", "float": "number", "datetime": "datetime", "bool": "bool"}.get(type.name, "string")
        self.currency = config.get("currency") or currency
        pattern, skeleton = config.get("pattern"), config.get("skeleton")
        if pattern and skeleton:
            raise ValueError("a format has a pattern or a skeleton, not both")
        if skeleton and self.kind not in ("date", "datetime"):
            raise ValueError("only dates and times have skeletons")
        if skeleton and skeleton not in SKELETONS:
            raise ValueError(f"no skeleton {skeleton!r} is known")
        default = self.locale.pattern(self.kind) if self.kind in NUMBER_PATTERNS else None
        if self.kind in ("date", "datetime"):
            default = self.locale.grain(type.grain or ("day" if self.kind == "date" else "second"))
        self.pattern = pattern or (SKELETONS[skeleton] if skeleton else default)

    def text(self, value: object) -> str:
        if value is None or value != value:
            return ""
        if self.kind in NUMBER_PATTERNS:
            return format_number(value, self.pattern, self.currency, self.locale)
        if self.kind in ("date", "datetime"):
            return format_time(value, self.pattern, self.locale)
        return str(value)

    @property
    def d3(self) -> str | None:
        """The d3-format of a number, d3-time-format of a time."""
        if self.kind in NUMBER_PATTERNS:
            return d3_number(self.pattern)
        if self.kind in ("date", "datetime"):
            return d3_time(self.pattern)
        return None


#: What a number pattern gives for each slot of a specifier, in the order of the published grammar:
#: [sign][symbol][0][width][,][.precision][~][type].
_D3_SLOTS = {
    "sign": lambda p: next((mark for mark, there in (("+", "+" in p.prefix), (" ", p.prefix[:1] == " "), ("(", bool(p.negative) and "(" in p.negative[0])) if there), ""),
    "symbol": lambda p: "$" * p.currency,
    "width": lambda p: f"0{p.least_int}" * bool(p.least_int),
    "comma": lambda p: "," * bool(p.group),
    "precision": lambda p: {"d": ""}.get(_d3_type(p), f".{p.significant[1] if p.significant else p.most_frac}"),
    "trim": lambda p: "~" * (p.significant[0] < p.significant[1] if p.significant else p.least_frac < p.most_frac),
    "type": lambda p: _d3_type(p),
}


def _d3_type(p: NumberPattern) -> str:
    asked = {"r": p.significant, "%": p.percent, "e": p.exponent, "f": p.most_frac, "d": True}
    return next(kind for kind, there in asked.items() if there)


def d3_number(pattern: str) -> str:
    """The d3 specifier that is nearest to a number pattern."""
    p = number_pattern(pattern)
    return "".join(slot(p) for slot in _D3_SLOTS.values())


# Fields of date patterns and their d3 directives.
_D3_TIME = {
    "y": "%Y", "yy": "%y", "yyyy": "%Y", "Y": "%G", "YYYY": "%G", "M": "%-m", "MM": "%m", "MMM": "%b", "MMMM": "%B", "L": "%-m", "LL": "%m", "LLL": "%b", "LLLL": "%B", "d": "%-d",
    "dd": "%d", "D": "%-j", "DDD": "%j", "E": "%a", "EEE": "%a", "EEEE": "%A", "h": "%-I", "hh": "%I", "H": "%-H", "HH": "%H", "m": "%-M", "mm": "%M", "s": "%-S", "ss": "%S",
    "a": "%p", "w": "%-V", "ww": "%V", "Q": "%q", "QQQ": "Q%q", "SSS": "%L", "SSSSSS": "%f",
}


def d3_time(pattern: str) -> str:
    def field(m: re.Match) -> str:
        if m[0][0] == "'":
            return m[0][1:-1].replace("''", "'").replace("%", "%%") or "'"
        return _D3_TIME.get(m[0], m[0])

    return re.sub(r"'(?:[^']|'')*'|([A-Za-z])\1*", field, pattern)


def shown(frame, formatters: dict[str, Formatter]):
    """A pandas frame with its values as text."""
    return frame.assign(**{c: [formatters[c].text(v if v == v else None) for v in frame[c].astype(object)] for c in frame.columns if c in formatters})
