"""Operator 9, PII: format-preserving Feistel pseudonyms.

Card numbers (issuer and Luhn), account numbers (IBAN, mod 97), social security numbers, telephone numbers (country code and length), IPv4 addresses and dates are
found and validated, then permuted within their format by a keyed Feistel network: a value stays valid (a telephone number of country code 1 whose area or exchange
begins with 0 or 1 stays such a one, and is found behind +1 only), and its separators stay. The
permutation acts on the bare value, so one value has one pseudonym in every document and every spelling: a telephone number with or without its separators, its
country code 1 or a trunk prefix (0), an account number with or without spaces, a date in any order. Values are as long as they were, but for days and months written without
leading zeros, and month names. Cards stay an issuer's, addresses public or not, dates in their century. Mail
addresses, access key ids and long hexadecimal secrets get keyed pseudonyms as well, mail by a keyed hash, the others by the same network. Numbers that fail validation are left as they are.
invert() gives the values back to who has the key, but for mail, and for the full or short form of a month where a pseudonym falls in May.

The key is an argument, or else the session's setting spark.lociweave.pii.key; without either there is a key for tests in local mode, and an error elsewhere.

Texts are rewritten where they stand, without a shuffle. Defined results: a null text stays null with no finds, an empty one stays
empty; repeated rows get equal results; an empty table gives an empty table; extra columns are kept, but for those named as an output; digits of any script count as
digits and come out as 0-9; a run of digits longer than any format is left as it is.
"""

from __future__ import annotations

import base64
import hashlib
import ipaddress
import logging
import math
import re
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lociweave.llm.common import add_columns, bounded_batches

#: Used in local mode where neither an argument nor the setting KEY_SETTING gives a key; anyone can invert it.
KEY = b"a key for tests; pass your own"
KEY_SETTING = "spark.lociweave.pii.key"
ROUNDS = 10
KINDS = ("email", "secret", "iban", "ip", "phone", "card", "ssn", "date")
_MONTHS = "January February March April May June July August September October November December".split()
#: Names of months as they are written, with the month: in full, and in three letters, or four for September.
_MONTH = {m: k for k, m in enumerate(_MONTHS, 1)} | {m[:3]: k for k, m in enumerate(_MONTHS, 1)} | {"Sept": 9}
_WRITTEN = "|".join(sorted(_MONTH, key=len, reverse=True))
_FOUND = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]++@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w]))"
    r"|(?<![\w])(?:"
    r"(?P<secret>[0-9a-fA-F]{32,})(?!\w)"
    r"|(?P<key>(?:AKIA|ASIA)[A-Z0-9]{16})(?!\w)"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?P<ip>(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<iso>\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2})(?!\w)"
    r"|(?P<dmy>\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4})(?!\w)"
    rf"|(?P<word>(?:\d{{1,2}} (?:{_WRITTEN})\.? \d{{4}}|(?:{_WRITTEN})\.? \d{{1,2}}, \d{{4}}))(?!\w)"
    r"|(?P<card>\d{13,19}|\d{4}(?P<s3>[ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{1,7}|\d{4}(?P<s4>[ -])\d{6}(?P=s4)\d{5})(?![\w]|-\d)"
    r"|(?P<local>\d{3}[-. ]\d{3}[-. ]\d{4})(?!\w)"
    r"|(?P<trunk>0[1-9]\d{1,3}[ -]\d{3,4}[ -]\d{3,4})(?!\w|[ -]\d)"
    r")"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w))"
    r"|(?P<abroad>(?<![\w+])\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?!\w|[ .-]?\d))"
    r"|(?P<area>(?<!\w)\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w))"
)


def _round(key: bytes, i: int, n: int, value: int, tweak: bytes) -> int:
    """A keyed number, of at least 64 bits more than the one that it is taken modulo, which has as many as n or value."""
    if n.bit_length() <= 64 and value.bit_length() <= 64:
        return int.from_bytes(hashlib.blake2b(b"%d|%d|%d|" % (i, n, value) + tweak, key=key[:64], digest_size=16).digest(), "big")
    size = (max(n.bit_length(), value.bit_length()) >> 3) + 9
    own = hashlib.blake2b(b"%d|" % i + tweak, key=key[:64]).digest()
    return int.from_bytes(hashlib.shake_256(own + n.to_bytes(size, "big") + value.to_bytes(size, "big")).digest(size), "big")


def feistel(value: int, size: int, key: bytes, tweak: bytes = b"", back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: a Feistel network on two halves, walked along its cycle."""
    if size < 2:
        return value
    a = max(2, math.isqrt(size - 1) + 1)
    b = -(-size // a)  # a * b >= size
    while True:
        left, right = divmod(value, b)  # left < a, right < b
        m, n = a, b
        if not back:
            for i in range(ROUNDS):
                left, right, m, n = right, (left + _round(key, i, size, right, tweak)) % m, n, m
        else:
            for i in reversed(range(ROUNDS)):
                left, right, m, n = (right - _round(key, i, size, left, tweak)) % n, left, n, m
        value = left * b + right
        if value < size:
            return value


def _digits(text: str) -> str:
    return "".join(str(int(c)) for c in text if c.isdecimal())


def _into(shape: str, digits: str) -> str:
    """The digits in the places of the shape's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdecimal() else c for c in shape)


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += (2 * d - 9 if d > 4 else 2 * d) if i % 2 else d
    return total


#: Fixed values of the numbering of cards: the first digits of issuers, as ranges, and the lengths of their numbers.
_ISSUERS = (
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 17, 18, 19)),
    ("644", "659", (16, 17, 18, 19)), ("3528", "3589", (16, 17, 18, 19)), ("300", "305", (14, 16, 17, 18, 19)), ("309", "309", (14, 16, 17, 18, 19)), ("36", "36", (14, 15, 16, 17, 18, 19)),
    ("38", "39", (14, 16, 17, 18, 19)), ("62", "62", (16, 17, 18, 19)), ("5018", "5018", (13, 14, 15, 16, 17, 18, 19)), ("5020", "5020", (13, 14, 15, 16, 17, 18, 19)), ("5038", "5038", (13, 14, 15, 16, 17, 18, 19)),
    ("5893", "5893", (13, 14, 15, 16, 17, 18, 19)), ("6304", "6304", (13, 14, 15, 16, 17, 18, 19)), ("6759", "6763", (13, 14, 15, 16, 17, 18, 19)),
)


def _issued(digits: str) -> bool:
    return any(low <= digits[: len(low)] <= high and len(digits) in lengths for low, high, lengths in _ISSUERS)


def _card(text: str, key: bytes, back: bool = False) -> str | None:
    digits = _digits(text)
    if not luhn(digits) or not _issued(digits):
        return None
    n, body = len(digits) - 1, digits[:-1]
    while True:  # along the cycle until the number is an issuer's again
        body = f"{feistel(int(body), 10**n, key, b'card', back):0{n}d}"
        if _issued(body + "0"):
            return _into(text, body + str(-_luhn_sum(body + "0") % 10))


#: Fixed values of the IBAN registry: the length by country.
_IBAN_LENGTH = {
    country: int(n)
    for n, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,TL"
        " 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:PT,ST 26:IS,TR 27:FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC"
    ).split())
    for country in countries.split(",")
}


def _iban_candidates(text: str) -> list[str]:
    """The match and its parts up to a space, as words behind a number may have been taken with it: the country's length first, then the longest."""
    parts = [text[:i] for i in (len(text), *(k for k in range(len(text) - 1, 0, -1) if text[k] == " "))]
    return sorted(parts, key=lambda x: len(x.replace(" ", "")) != _IBAN_LENGTH.get(text[:2]))


def _iban_number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s))


def _iban(text: str, key: bytes, back: bool = False) -> str | None:
    bare = text.replace(" ", "")
    if not 15 <= len(bare) <= 34 or _iban_number(bare[4:] + bare[:4]) % 97 != 1:
        return None
    digits, letters = _digits(bare[4:]), re.sub(r"[^A-Z]", "", bare[4:])
    digits = f"{feistel(int(digits), 10**len(digits), key, b'iban', back):0{len(digits)}d}" if digits else ""
    value = 0
    for c in letters:
        value = value * 26 + ord(c) - 65
    value = feistel(value, 26 ** len(letters), key, b"iban", back) if letters else 0
    new = []
    for _ in letters:
        value, d = divmod(value, 26)
        new.append(chr(65 + d))
    d, w = iter(digits), iter(reversed(new))
    body = "".join(next(d) if c.isdigit() else next(w) for c in bare[4:])
    bare = f"{bare[:2]}{98 - _iban_number(body + bare[:2] + '00') % 97:02d}{body}"
    it = iter(bare)
    return "".join(" " if c == " " else next(it) for c in text)


def _ip(text: str, key: bytes, back: bool = False) -> str | None:
    """Octets of as many digits each, in the public range if the address is, and out of it if not."""
    parts = text.split(".")
    if any(int(x) > 255 or x != str(int(x)) for x in parts):
        return None
    ranges = [((0, 10), (10, 90), (100, 156))[len(x) - 1] for x in parts]
    size = 1
    for _, n in ranges:
        size *= n
    public = ipaddress.ip_address(text).is_global
    value = 0
    for x, (low, n) in zip(parts, ranges):
        value = value * n + int(x) - low
    while True:
        value = rest = feistel(value, size, key, b"ip%d" % size, back)
        new = []
        for low, n in reversed(ranges):
            rest, x = divmod(rest, n)
            new.append(str(low + x))
        out = ".".join(reversed(new))
        if ipaddress.ip_address(out).is_global == public:
            return out


#: Fixed values of the numbering of telephones: the country codes of one and of two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _dialled(digits: str) -> bool:
    """Whether a national number of code 1 can be dialled: neither area nor exchange begins with 0 or 1."""
    return digits[0] > "1" and digits[3] > "1"


def _phone(text: str, key: bytes, back: bool = False) -> str | None:
    """The national number permuted among those that can be dialled, or those that can't. A trunk prefix (0) stays.

    A number without a country code counts as one of code 1, and must be one that can be dialled.
    """
    head, trunk, tail = text.partition("(0)") if text[0] == "+" else (text, "", "")
    digits = _digits(head + tail)
    code = "1"
    if text[0] == "+":
        code = next((digits[:k] for k in (1, 2) if digits[:k] in _CODES), digits[:3])
        digits = digits[len(code) :]
    if not (len(digits) == 10 if code == "1" else 5 <= len(digits) <= 15 - len(code)):
        return None
    valid = code != "1" or _dialled(digits)
    if not valid and text[0] != "+":
        return None
    new = digits
    while True:
        new = f"{feistel(int(new), 10 ** len(digits), key, b'phone' + code.encode(), back):0{len(digits)}d}"
        if code != "1" or _dialled(new) == valid:
            break
    new = _into(head + tail, (code if text[0] == "+" else "") + new)
    return new[: len(head)] + trunk + new[len(head) :]


def _trunk(text: str, key: bytes, back: bool = False) -> str | None:
    """A national number behind its trunk prefix 0, of ten or eleven digits with it, permuted among those that begin with 1 to 9."""
    digits = _digits(text)[1:]
    if not 9 <= len(digits) <= 10:
        return None
    low, new = 10 ** (len(digits) - 1), int(digits)
    new = low + feistel(new - low, 9 * low, key, b"trunk", back)
    return _into(text, f"0{new}")


def _ssn_valid(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _ssn(text: str, key: bytes, back: bool = False) -> str | None:
    digits = _digits(text)
    if not _ssn_valid(digits):
        return None
    while True:  # along the cycle until the number is valid again
        digits = f"{feistel(int(digits), 10**9, key, b'ssn', back):09d}"
        if _ssn_valid(digits):
            return _into(text, digits)


def _day(year: int, month: int, day: int, key: bytes, back: bool) -> date | None:
    """Another day of the same century, after the 12th of its month if the day is, so that it is read in the same order."""
    try:
        at = date(year, month, day).toordinal()
    except ValueError:
        return None
    first = date(max(1, year // 100 * 100), 1, 1).toordinal()
    days = date(year // 100 * 100 + 99, 12, 31).toordinal() - first + 1
    at -= first
    while True:
        at = feistel(at, days, key, b"date%d" % (year // 100), back)
        if ((new := date.fromordinal(first + at)).day > 12) == (day > 12):
            return new


def _date(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    numbers = re.findall(r"\d+", text)
    plain = any(len(x) == 1 for x in numbers)  # written without leading zeros
    two = lambda x: str(x) if plain else f"{x:02d}"
    numbers = [int(x) for x in numbers]
    if kind == "iso":
        new = _day(*numbers, key, back)
        mark = re.search(r"\D", text)[0]
        return new and f"{new.year:04d}{mark}{two(new.month)}{mark}{two(new.day)}"
    if kind == "dmy":
        a, b, y = numbers
        first = b > 12  # the month comes first only where it must
        new = _day(y, a if first else b, b if first else a, key, back)
        mark = re.search(r"\D", text)[0]
        return new and mark.join([two(new.month), two(new.day)][:: 1 if first else -1] + [f"{new.year:04d}"])
    name = re.search(r"[A-Z][a-z]+\.?", text)[0]
    new = _day(numbers[1], _MONTH[name.rstrip(".")], numbers[0], key, back)
    if not new:
        return None
    # May is written in full and in short alike: it is taken for short only before a full stop
    short = name[-1] == "." or name.rstrip(".") not in _MONTHS
    month = _MONTHS[new.month - 1][: 3 if short else None] + ("." if name[-1] == "." else "")
    return f"{month} {new.day}, {new.year}" if text[0].isalpha() else f"{new.day} {month} {new.year}"


def _secret(text: str, key: bytes, back: bool = False) -> str | None:
    if text.isdigit() or text.isalpha():
        return None
    new = f"{feistel(int(text, 16), 16 ** len(text), key, b'secret', back):0{len(text)}x}"
    return new.upper() if text.upper() == text else new


def _key_id(text: str, key: bytes, back: bool = False) -> str:
    """An access key id with its first four letters as they are."""
    value, out = feistel(int(text[4:], 36), 36**16, key, b"key", back), ""
    for _ in range(16):
        value, d = divmod(value, 36)
        out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d] + out
    return text[:4] + out


def _tag(data: str, key: bytes, n: int) -> str:
    h = hashlib.blake2b(data.lower().encode(), key=key[:64], digest_size=15).digest()
    return base64.b32encode(h).decode().lower()[:n]


def _email(text: str, key: bytes, back: bool = False) -> str:
    if back:
        return text
    return f"u{_tag(text, key, 14)}@d{_tag(text.rpartition('@')[2], key, 9)}.invalid"


_DO = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "phone": _phone, "abroad": _phone, "local": _phone, "area": _phone, "trunk": _trunk, "key": _key_id, "card": _card, "ssn": _ssn}
_KIND = {"abroad": "phone", "local": "phone", "area": "phone", "trunk": "phone", "key": "secret", "iso": "date", "dmy": "date", "word": "date"}
_ANY = re.compile(r"[\d@]|A[KS]IA")


def invert(text: str, key: bytes) -> str:
    """A text with pseudonyms as it was, but for mail addresses, the case of secrets, and leading zeros of days and months."""
    return pseudonymise(text, key, True)[0]


def pseudonymise(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    counts: dict[str, int] = {}
    if not _ANY.search(text):
        return text, counts

    out, done, at = [], 0, 0
    while m := _FOUND.search(text, at):
        kind, found, at = m.lastgroup, m[0], m.end()
        if kind == "iban":
            new, found = next(((x, c) for c in _iban_candidates(found) if (x := _iban(c, key, back))), (None, found))
            at = m.start() + (len(found) if new else 1)  # what was taken with it, or stands in it, is searched again
        else:
            new = _DO[kind](found, key, back) if kind in _DO else _date(kind, found, key, back)
        if new is None:
            continue
        out += [text[done : m.start()], new]
        done = m.start() + len(found)
        kind = _KIND.get(kind, kind)
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[done:]]), counts


def session_key(spark: SparkSession) -> bytes:
    """The key of the setting KEY_SETTING; without it the key for tests, with a warning, in local mode, and an error elsewhere."""
    if found := spark.conf.get(KEY_SETTING, None):
        return found.encode()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {KEY_SETTING} or pass a key")
    logging.getLogger(__name__).warning("%s isn't set: pseudonyms are made with the key for tests and can be inverted", KEY_SETTING)
    return KEY


def mask_documents(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with pseudonyms in text, n_pii, and n_<kind> of each kind; the key is the session's unless one is given."""
    bounded_batches(docs.sparkSession)
    key = key or session_key(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        cols: dict[str, list] = {"text": [], "n_pii": []} | {f"n_{k}": [] for k in KINDS}
        for text in batch.column("text").to_pylist():
            new, counts = (None, {}) if text is None else pseudonymise(text, key)
            cols["text"].append(new)
            cols["n_pii"].append(sum(counts.values()))
            for k in KINDS:
                cols[f"n_{k}"].append(counts.get(k, 0))
        return cols

    return add_columns(docs, ["text"], run, "text string, n_pii long, " + ", ".join(f"n_{k} long" for k in KINDS))
