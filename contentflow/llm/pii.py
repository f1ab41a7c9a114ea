"""Personal data by anchor expansion."""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from contentflow.llm import grams

#: In the order in which spans with the same start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
SCHEMES = ("https", "http", "ftp", "HTTPS", "HTTP", "FTP")
CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT", "iban", "Iban", "IBAN", "ssn", "SSN", "passport", "Passport", "PASSPORT")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._~:/?#@!$&*+,;=%-]*+")
_URL_END = ".,;:!?"
_LEAD = re.compile(r"(?: ?(?:no\.?|No\.?|number|Number))?[ :#=]{0,3}")
_ACCOUNT = re.compile(r"(?: ?(?:no\.?|No\.?|number|Number))?[ :#=]{0,3}([0-9](?:[ -]?[0-9])+)")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}")
_PASSPORT = re.compile(r"(?:[A-Z]{1,3}[ -]?[0-9]{5,9}|[a-z]{1,3}[0-9]{5,9}|(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{6,9})(?![A-Za-z0-9])")
#: Characters of an IBAN by country; other countries' may have 15 to 34.
_IBAN_SIZES = {
    c: int(size) for size, countries in {
        "15": "NO", "16": "BE", "18": "DK FI FK FO GL NL SD", "19": "MK SI", "20": "AT BA EE KZ LT LU MN XK", "21": "CH HR LI LV",
        "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL", "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST",
        "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HU LB NI PL SV", "29": "BR EG PS QA UA", "30": "JO KW MU YE",
        "31": "MT SC", "32": "LC", "33": "RU",
    }.items() for c in countries.split()
}
ACCOUNT_DIGITS = (6, 24)


@cache
def _anchors() -> ahocorasick.Automaton:
    """Finds the at-signs, schemes, plus signs, digits and identifier cues of a text in one pass."""
    automaton = ahocorasick.Automaton()
    for digit in "0123456789":
        automaton.add_word(digit, ("digit", 1))
    automaton.add_word("@", ("at", 1))
    automaton.add_word("+", ("plus", 1))
    automaton.add_word("://", ("scheme", 3))
    for cue in CUES:
        automaton.add_word(cue, ("cue", len(cue)))
    automaton.make_automaton()
    return automaton


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(letters: str) -> bool:
    """The check digits are right: the number with the first four characters last, letters from 10 on, is 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in letters[4:] + letters[:4])) % 97 == 1


def _iban_end(text: str, at: int) -> int:
    """Where the IBAN that begins there ends, 0 without one. Words that follow are not taken for groups of it."""
    found = _IBAN.match(text, at)
    if not found:
        return 0
    places = [n for n in range(at, found.end()) if text[n] not in " -"]
    size = _IBAN_SIZES.get(text[at : at + 2].upper())
    for n in [size] if size else range(len(places), 14, -1):
        if n <= len(places):
            end = places[n - 1] + 1
            whole = end == len(text) or not (text[end].isascii() and text[end].isalnum())
            if whole and iban("".join(text[p] for p in places[:n])):
                return end
    return 0


def _identifier(text: str, cue: str, after: int) -> tuple[int, int, bool] | None:
    """Begin and end of what follows a cue word, and whether it is valid. IBANs and passport numbers may hold letters."""
    at = _LEAD.match(text, after).end()
    if cue.lower() == "iban" and (end := _iban_end(text, at)):
        return at, end, True
    if cue.lower() == "passport" and (found := _PASSPORT.match(text, at)):
        return at, found.end(), True
    if found := _ACCOUNT.match(text, after):
        return found.start(1), found.end(), ACCOUNT_DIGITS[0] <= len(_digits(found.group(1))) <= ACCOUNT_DIGITS[1]
    return None


def _small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans in code points, by start and then kind.

    Each anchor is expanded by the parser of its kind. What a parser has taken, also if it then fails validation,
    is not looked at again for that kind, so every parser passes a text once, whatever it holds.
    """
    spans = []
    email_end = ip_end = card_end = url_end = account_end = 0
    for last, (anchor, length) in _anchors().iter(text):
        at = last - length + 1
        if anchor == "digit":
            if at >= ip_end:
                found = _IP.match(text, at)
                ip_end = found.end()
                parts = found.group().split(".")
                if len(parts) == 4 and all(map(_small_part, parts)):
                    spans.append((at, "ip", ip_end))
            if at >= card_end:
                found = _CARD.match(text, at)
                card_end = found.end()
                if 12 <= found.end() - at:
                    digits = _digits(found.group())
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append((at, "card", card_end))
        elif anchor == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            found = _DOMAIN.match(text, at + 1) if start < at else None
            if found:
                email_end = found.end()
                spans.append((start, "email", email_end))
        elif anchor == "plus":
            found = _PHONE.match(text, at)
            if found and 9 <= len(_digits(found.group())) <= 15:
                spans.append((at, "phone", found.end()))
        elif anchor == "scheme":
            scheme = next((s for s in SCHEMES if at - len(s) >= url_end and text.startswith(s, at - len(s))), None)
            found = _URL.match(text, at + 3) if scheme else None
            if found:
                url_end = found.end()
                spans.append((at - len(scheme), "url", at + 3 + len(found.group().rstrip(_URL_END))))
        elif at >= account_end:
            found = _identifier(text, text[at : last + 1], last + 1)
            if found:
                start, account_end, valid = found
                if valid:
                    spans.append((start, "account", account_end))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return [(kind, start, end) for start, kind, end in spans]


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with [KIND] in place of each span; of overlapping spans the first is named and the union replaced."""
    out, at, open_end = [], 0, 0
    for kind, start, end in spans:
        if start >= open_end:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = open_end = max(open_end, end)
    return "".join([*out, text[at:]])


def find_personal_data(frame: DataFrame, text: str = "text", keep: list[str] | None = None, mask: bool = False) -> DataFrame:
    """Adds spans (array of kind, start, end) and, on request, masked (the text without what was found).

    Emails, IP addresses, card numbers and phone numbers are those of the patterns in the module's tests, leftmost and
    non-overlapping per kind; URLs and account numbers after a cue word, with the letters of IBANs and passport numbers, come on top. Positions count code points,
    ends are exclusive. Null and empty texts have no spans. A text of any length is searched whole, in time that grows with it; spans at one place come
    in the order of their kinds. Rows that repeat are searched each. An empty table gives an empty result. Columns spans and masked are
    replaced, others stay.
    """
    new = {"spans": "array<struct<kind:string,start:long,end:long>>"} | ({"masked": "string"} if mask else {})
    keep = [c for c in (frame.columns if keep is None else keep) if c not in ("spans", "masked")]

    def work(_: grams.Texts, rows: pa.RecordBatch) -> tuple:
        texts = [t or "" for t in rows.column(rows.num_columns - 1).to_pylist()]
        found = [find(t) for t in texts]
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in one] for one in found]
        return (spans, [masked(t, f) for t, f in zip(texts, found)]) if mask else (spans,)

    return grams.mapped(frame, text, keep, new, work)
