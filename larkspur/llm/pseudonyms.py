"""Format-preserving pseudonyms for personal data: each validated value is permuted within its own format by a keyed Feistel network."""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.shared import read_table, rows_in_chunks, through_arrow

ROUNDS = 10
#: Key for tests and queries; a production run passes its own secret.
DEMO_KEY = b"larkspur demonstration key"


class Feistel:
    """Keyed permutations of [0, size): a two-sided modular Feistel network over a grid, cycle-walked into the domain."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tag: str, i: int, value: int) -> int:
        data = f"{tag}|{i}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def permute(self, tag: str, value: int, size: int, inverse: bool = False) -> int:
        """The image of `value`; the pair (tag, size) names the permutation. One value alone maps to itself."""
        if not 0 <= value < size:
            raise ValueError(f"{value} is outside [0, {size})")
        rows = max(1, _root(size))
        cols, tag = -(-size // rows), f"{tag}|{size}"
        while True:
            left, right = divmod(value, cols)
            for i in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
                sign = -1 if inverse else 1
                if i % 2:
                    right = (right + sign * self._round(tag, i, left)) % cols
                else:
                    left = (left + sign * self._round(tag, i, right)) % rows
            value = left * cols + right
            if value < size:
                return value


def _root(n: int) -> int:
    from math import isqrt

    return isqrt(n)


def _mixed(digits: list[int], sizes: list[int]) -> tuple[int, int]:
    value, size = 0, 1
    for d, s in zip(digits, sizes, strict=True):
        value, size = value * s + d, size * s
    return value, size


def _unmixed(value: int, sizes: list[int]) -> list[int]:
    out = []
    for s in reversed(sizes):
        value, d = divmod(value, s)
        out.append(d)
    return out[::-1]


_LOWER, _UPPER, _DIGIT, _HEX, _BASE32 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _by_class(text: str, alphabets: tuple[str, ...], tag: str, f: Feistel, inverse: bool) -> str:
    """Permutes the characters that an alphabet holds, each within it; others, such as dots, stay."""
    held = [(i, a) for i, c in enumerate(text) for a in alphabets if c in a]
    if not held:
        return text
    sizes = [len(a) for _, a in held]
    value, size = _mixed([a.index(text[i]) for i, a in held], sizes)
    out = list(text)
    shape = "".join(str(alphabets.index(a)) for _, a in held)
    for (i, a), d in zip(held, _unmixed(f.permute(f"{tag}:{shape}", value, size, inverse), sizes), strict=True):
        out[i] = a[d]
    return "".join(out)


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _with_digits(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in _DIGIT else c for c in shape)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGIT)


def _card(text: str, f: Feistel, inverse: bool) -> str | None:
    """Payment cards: 13 to 19 digits that pass Luhn; the leading digit stays, the check digit is made anew."""
    digits = _only_digits(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]):
        return None
    body = digits[1:-1]
    moved = digits[0] + str(f.permute(f"card{digits[0]}", int(body), 10 ** len(body), inverse)).zfill(len(body))
    return _with_digits(text, moved + str(luhn_digit(moved)))


def _number(text: str, f: Feistel, inverse: bool) -> str | None:
    """Account-like runs of 13 to 19 digits that fail Luhn: permuted among the digit strings that fail it too."""
    digits = _only_digits(text)
    if luhn_digit(digits[:-1]) == int(digits[-1]):
        return None
    n = len(digits)
    off = (int(digits[-1]) - luhn_digit(digits[:-1]) - 1) % 10  # 0..8
    value, size = int(digits[:-1]) * 9 + off, 10 ** (n - 1) * 9
    body, off = divmod(f.permute("number", value, size, inverse), 9)
    head = str(body).zfill(n - 1)
    return _with_digits(text, head + str((luhn_digit(head) + 1 + off) % 10))


def _phone_abroad(text: str, f: Feistel, inverse: bool) -> str | None:
    """Numbers of other countries, of 8 to 15 digits: the country code stays, as it is set apart or else its first two digits."""
    digits = _only_digits(text)
    if not 8 <= len(digits) <= 15:
        return None
    apart = len(re.match(r"\+([0-9]+)", text)[1])
    code = apart if apart <= 3 else 2
    own = digits[code:]
    return _with_digits(text, digits[:code] + str(f.permute(f"phone+{digits[:code]}", int(own), 10 ** len(own), inverse)).zfill(len(own)))


def _phone(text: str, f: Feistel, inverse: bool) -> str | None:
    """North American numbers; a country code stays, and so does whether area and exchange begin with 0 or 1, which no number in service does.

    Without a country code, ten digits whose area code begins with 0 or 1 are not taken for a phone number.
    """
    digits = _only_digits(text)
    country, own = digits[:-10], digits[-10:]
    if len(digits) not in (10, 11) or country not in ("", "1") or not country and own[0] in "01":
        return None
    low = [2 if i in (0, 3) and own[i] not in "01" else 0 for i in range(10)]
    sizes = [(8 if low[i] else 2) if i in (0, 3) else 10 for i in range(10)]
    value, size = _mixed([int(c) - x for c, x in zip(own, low, strict=True)], sizes)
    tag = "phone" if low[0] and low[3] else f"phone{low[0]}{low[3]}"
    moved = _unmixed(f.permute(tag, value, size, inverse), sizes)
    return _with_digits(text, country + "".join(str(d + x) for d, x in zip(moved, low, strict=True)))


def _ssn_ok(a: int, b: int, c: int) -> bool:
    return a not in (0, 666) and a < 900 and b > 0 and c > 0


def _ssn(text: str, f: Feistel, inverse: bool) -> str | None:
    """Social security numbers, cycle-walked among the ones that may be issued."""
    digits = _only_digits(text)
    if not _ssn_ok(int(digits[:3]), int(digits[3:5]), int(digits[5:])):
        return None
    value = int(digits)
    while True:
        value = f.permute("ssn", value, 10**9, inverse)
        s = str(value).zfill(9)
        if _ssn_ok(int(s[:3]), int(s[3:5]), int(s[5:])):
            return _with_digits(text, s)


def _ipv4(text: str, f: Feistel, inverse: bool) -> str | None:
    """Addresses; each part keeps its number of digits, so lengths stay."""
    try:
        ipaddress.IPv4Address(text)
    except ValueError:
        return None
    low, span = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
    parts = text.split(".")
    sizes = [span[len(p)] for p in parts]
    value, size = _mixed([int(p) - low[len(p)] for p in parts], sizes)
    moved = _unmixed(f.permute("ip" + "".join(str(len(p)) for p in parts), value, size, inverse), sizes)
    return ".".join(str(d + low[len(p)]) for d, p in zip(moved, parts, strict=True))


def _hex_digits(text: str, tag: str, f: Feistel, inverse: bool) -> str:
    """Hexadecimal digits, moved among those of their case; in capitals one letter at least stays one, in mixed case each kind is moved by itself."""
    if not any(c in "ABCDEF" for c in text):
        return _by_class(text, (_HEX,), tag, f, inverse)
    if any(c in "abcdef" for c in text):
        return _by_class(text, (_DIGIT, "abcdef", "ABCDEF"), tag, f, inverse)
    while True:
        text = _by_class(text, (_HEX.upper(),), tag, f, inverse)
        if any(c in "ABCDEF" for c in text):
            return text


def _ipv6(text: str, f: Feistel, inverse: bool) -> str | None:
    """Addresses in groups; groups keep their lengths."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return _hex_digits(text, "ip6", f, inverse) if text.strip(":") else None


_DAY0, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


def _date(kind: str) -> Callable[[str, Feistel, bool], str | None]:
    """Real dates from 1900 to 2099; a day has one pseudonym in every notation with padded fields, but for d/m/y, which stays among days after the 12th. Dates with fields of one digit stay among those of the same form."""

    def move(text: str, f: Feistel, inverse: bool) -> str | None:
        fields = re.split(r"\D", text)
        x = [int(p) for p in fields]
        short = [len(p) for p in fields] if any(len(p) == 1 for p in fields) else None
        if short and any(p[0] == "0" for p in fields):
            return None
        try:
            day = dt.date(x[0], x[1], x[2]) if kind == "ymd" else dt.date(x[2], x[1], x[0]) if kind.startswith("dmy") else dt.date(x[2], x[0], x[1])
        except ValueError:
            return None
        if not 0 <= day.toordinal() - _DAY0 < _DAYS:
            return None
        at = day.toordinal() - _DAY0
        while True:
            at = f.permute("date", at, _DAYS, inverse)
            new = dt.date.fromordinal(at + _DAY0)
            if short:
                order = (new.year, new.month, new.day) if kind == "ymd" else (new.day, new.month, new.year)
                if [len(str(p)) for p in order] == short:
                    return "".join(str(p) + text[i : i + 1] for p, i in zip(order, (short[0], short[0] + 1 + short[1], len(text)), strict=True))
            elif kind != "dmy/" or new.day > 12:  # else it would be read month first
                break
        y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        return _with_digits(text, y + m + d if kind == "ymd" else d + m + y if kind.startswith("dmy") else m + d + y)

    return move


def _iban(text: str, f: Feistel, inverse: bool) -> str | None:
    """Account numbers with two valid check digits; the country stays, the account is permuted by class, checks are made anew."""
    body = text.replace(" ", "")
    check = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97
    if not 15 <= len(body) <= 34 or check(body) != 1:
        return None
    moved = _by_class(body[4:], (_UPPER, _DIGIT), "iban" + body[:2], f, inverse)
    full = f"{body[:2]}{98 - check(body[:2] + '00' + moved):02d}{moved}"
    if not inverse and f"{98 - check(body[:2] + '00' + body[4:]):02d}" != body[2:4]:
        return None  # 00, 01 and 99 name the same remainders as 97, 98 and 02
    it = iter(full)
    return "".join(c if c == " " else next(it) for c in text)


def _email(text: str, f: Feistel, inverse: bool) -> str | None:
    """Addresses: letters and digits before the @ move within their class; the host stays."""
    local, host = text.rsplit("@", 1)
    return f"{_by_class(local, (_LOWER, _UPPER, _DIGIT), 'mail@' + host.lower(), f, inverse)}@{host}"


def _key(text: str, f: Feistel, inverse: bool) -> str | None:
    return text[:4] + _by_class(text[4:], (_BASE32,), "key" + text[:4], f, inverse) if all(c in _BASE32 for c in text[4:]) else text[:4] + _by_class(text[4:], (_UPPER, _DIGIT), "keyx" + text[:4], f, inverse)


def _hexadecimal(text: str) -> bool:
    return all(c in _HEX for c in text) or all(c in _HEX.upper() for c in text)


def _secret(text: str, f: Feistel, inverse: bool) -> str | None:
    """Passwords and tokens that hold a digit: hexadecimal ones stay so, characters of others move within their class."""
    if not any(c in _DIGIT for c in text):
        return None
    whole = _hexadecimal(text)
    while True:
        text = _hex_digits(text, "hex", f, inverse) if whole else _by_class(text, (_LOWER, _UPPER, _DIGIT), "secret", f, inverse)
        if any(c in _DIGIT for c in text) and _hexadecimal(text) == whole:
            return text


def _token(text: str, f: Feistel, inverse: bool) -> str | None:
    return _by_class(text, (_LOWER, _UPPER, _DIGIT), "token", f, inverse) if any(c in _DIGIT for c in text) else None


#: What a text must hold, in lower case, before it is searched for secrets and for tokens.
_SECRET_NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey")
_TOKEN_HEADS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk_live_", "sk_test_", "rk_live_", "xoxb-", "xoxp-", "glpat-", "aiza")
#: (kind, pattern, permutation), in order of precedence; a match (its group `value` if it has one) that is not valid is left to the kinds that follow.
KINDS: list[tuple[str, re.Pattern, Callable[[str, Feistel, bool], str | None]]] = [
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-])"), _email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), _iban),
    ("access_key", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), _key),
    ("token", re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(x.replace("aiza", "AIza") for x in _TOKEN_HEADS) + r")(?P<value>[A-Za-z0-9_-]{16,255})(?![A-Za-z0-9])"), _token),
    ("secret", re.compile(r"""(?<![A-Za-z0-9])(?i:""" + "|".join(_SECRET_NAMES) + r""")["']?[ ]?[=:][ ]?["']?(?P<value>[A-Za-z0-9_+/-]{8,128})(?![A-Za-z0-9])"""), _secret),
    ("ip", re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?![0-9A-Za-z:])"), _ipv6),
    ("ip", re.compile(r"(?<![0-9.])(?<![vV])(?<![vV]ersion )(?<![rR]elease )[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"), _ipv4),
    ("card", re.compile(r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|[.-][0-9])"), _card),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])|(?<![0-9A-Za-z+.-])\+1[0-9]{10}(?![0-9A-Za-z])"), _phone),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])\+[2-9][0-9]{0,14}(?:[ .-]?\(?[0-9]{1,6}\)?){0,6}(?![0-9A-Za-z]|[.-][0-9])"), _phone_abroad),
    ("ssn", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"), _ssn),
    ("date", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9]|[-/.][0-9])"), _date("ymd")),
    ("date", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{1,2}([-.])[0-9]{1,2}\1[0-9]{4}(?![0-9]|[-/.][0-9])"), _date("dmy")),
    ("date", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9]|[-/.][0-9])"), _date("mdy")),
    ("date", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9]|[-/.][0-9])"), _date("dmy/")),
    ("number", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{13,19}(?![0-9A-Za-z]|[.-][0-9])"), _number),
]
_ANY = re.compile("[0-9@]")
#: Characters of an IBAN by country, of the IBAN registry.
IBAN_LENGTHS = {
    c: int(n)
    for n, names in (x.split(":") for x in (
        "15:NO,16:BE,18:DK FI FK FO GL NL SD,19:MK SI,20:AT BA EE KZ LT LU MN XK,21:CH HR LI LV,22:BG BH CR DE GB GE IE ME RS VA,"
        "23:AE GI IL IQ OM SO TL,24:AD CZ ES MD PK RO SA SE SK TN VG,25:LY PT ST,26:IS TR,27:BI DJ FR GR IT MC MR SM,28:AL AZ BY CY DO GT HU LB NI PL SV,"
        "29:BR EG PS QA UA,30:JO KW MU YE,31:MT SC,32:LC,33:RU"
    ).split(","))
    for c in names.split()
}
_GROUP_END = re.compile(r"[0-9A-Za-z](?=[ -]|$)")


def _card_ends(text: str) -> list[int]:
    """Ends to try for cards that may have other groups behind them: 16 digits, then the most."""
    ends = [(len(_only_digits(text[: m.end()])), m.end()) for m in _GROUP_END.finditer(text)]
    return [e for n, e in sorted(ends, key=lambda x: (x[0] != 16, -x[0])) if 13 <= n <= 19]


def _iban_ends(text: str) -> list[int]:
    """Ends to try for IBANs that may have words behind them: the country's length, then the longest."""
    ends = [(m.end() - text.count(" ", 0, m.end()), m.end()) for m in _GROUP_END.finditer(text)]
    return [e for n, e in sorted(ends, key=lambda x: (x[0] != IBAN_LENGTHS.get(text[:2]), -x[0])) if 15 <= n <= 34]


#: Kinds written in groups, whose patterns may take in groups that don't belong to the value.
_ENDS: dict[str, Callable[[str], list[int]]] = {"card": _card_ends, "iban": _iban_ends}


#: Validity does not depend on the key.
_CHECK = Feistel(b"")


def _parsed(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Values and what was tried in vain, as (start, end, number of kind), values in order of precedence.

    Of values written in groups the first end that is valid counts; without one, the search goes on from the next group.
    """
    f, taken, low = _CHECK, bytearray(len(text)), text.lower()
    held_back = {"secret": not any(x in low for x in _SECRET_NAMES), "token": not any(x in low for x in _TOKEN_HEADS)}
    held: list[tuple[int, int, int]] = []
    failed: list[tuple[int, int, int]] = []
    for k, (kind, pattern, move) in enumerate(KINDS):
        if held_back.get(kind):
            continue
        at, ends, group = 0, _ENDS.get(kind), "value" if "value" in pattern.groupindex else 0
        while m := pattern.search(text, at):
            start, at = m.start(group), m.end()
            if ends:
                at = start + next((g.end() for g in _GROUP_END.finditer(m.group())), m.end() - start)
            for end in (start + e for e in ends(m.group())) if ends else (m.end(group),):
                if any(taken[start:end]):
                    continue
                if move(text[start:end], f, False) is not None:
                    held.append((start, end, k))
                    taken[start:end] = b"\x01" * (end - start)
                    at = end
                    break
                failed.append((start, end, k))
    return held, sorted(failed)


def pseudonymise(text: str, f: Feistel, inverse: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """(text with each value replaced by its pseudonym, [(start, end, kind)]); lengths and positions stay.

    A value moves on while it would make valid what was tried in vain, so that its pseudonym is found at the same place;
    the inverse goes back through the same steps.
    """
    if not _ANY.search(text):
        return text, []
    held, failed = _parsed(text)
    if not held:
        return text, []
    now = bytearray(text.encode("ascii", "replace"))  # a byte a code point; values are ASCII
    for start, end, k in reversed(held) if inverse else held:
        near = [x for x in failed[bisect_left(failed, (start - 64,)) : bisect_left(failed, (end,))] if x[1] > start]
        while True:
            now[start:end] = KINDS[k][2](now[start:end].decode(), f, inverse).encode()
            if all(KINDS[j][2](now[x:y].decode(), f, False) is None for x, y, j in near):
                break
    out, at = [], 0
    for start, end, _ in sorted(held):
        out += [text[at:start], now[start:end].decode()]
        at = end
    return "".join([*out, text[at:]]), [(start, end, KINDS[k][0]) for start, end, k in sorted(held)]


_SPANS = "array<struct<start:int,stop:int,kind:string>>"


def pseudonymise_documents(docs: DataFrame, key: bytes = DEMO_KEY, inverse: bool = False, spans: str | None = "pii_spans") -> DataFrame:
    """All columns of `docs`, with `text` pseudonymised, and `spans` (start, stop, kind in code points; None: no such column).

    A null text stays null with no spans, an empty one empty; very long texts are searched whole; where values overlap the
    kind that comes first in KINDS counts, then the earlier value; equal values get equal pseudonyms in every row (but
    for one whose pseudonym would make a valid card or IBAN with the groups beside it, which moves on); repeated rows
    stay equal; an empty table gives no rows; other columns pass through (one with the name `spans` is replaced).
    `inverse` with the same key restores the texts.
    """
    docs = docs.drop(spans) if spans else docs
    names = docs.columns
    at = [c.lower() for c in names].index("text")
    marked = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in rows_in_chunks(batches, at):
            texts, marks = [], []
            for text in batch.column(at).to_pylist():
                new, held = (None, []) if text is None else pseudonymise(text, f, inverse)
                texts.append(new)
                marks.append([{"start": s, "stop": e, "kind": k} for s, e, k in held])
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(marks, marked)], [*names, spans]) if spans else pa.RecordBatch.from_arrays(cols, names)

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema) + (f", `{spans}` {_SPANS}" if spans else "")
    return through_arrow(docs, run, schema)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, number of values replaced, their spans."""
    out = pseudonymise_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("pii_spans").alias("n_values"), "pii_spans")


QUERIES = {"op7_pseudonyms": op7_pseudonyms}
ORACLES: dict[str, str] = {}
