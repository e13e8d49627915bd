"""PII: format-preserving Feistel pseudonyms.

Values are found by format, validated, and permuted within their format under a key, so a pseudonym is a value of the same kind
and equal values get equal pseudonyms in every document.  A value is a row of signs, each from an alphabet of its own size; the
rounds add to one half, sign by sign and modulo those sizes, a keyed hash of the other half.  Where only some values are valid the
permutation is applied again until it lands on a valid one (cycle walking), which is a permutation of the valid ones.

    email      letters and digits of all but the last label
    card       13 to 19 digits that pass the Luhn test (others stay as they are); all but the last are permuted and the last is set to pass it
    phone      the digits after the country code, the first not changed to or from 0 or 1; the code is that of a number that begins with +,
               so +1 (415) 555-0132 and +14155550132 are one value; without + a leading 0 stays
    ip         four octets, each 0 to 255; IPv6 addresses as 128 bits, so 2001:db8::1 and 2001:0db8:0:0:0:0:0:1 are one value; pseudonyms
               are written in the short form, and ::1 and the like, of less than four digits, stay
    iban       all capitals or all small letters; signs after the check digits, which are set to pass the test modulo 97; where more signs follow that fit the pattern, the
               longest run of groups that passes the test
    ssn        three, two and four digits with - or spaces between, cycle-walked to valid areas, groups and serials
    date       days from 1900-01-01 to 2099-12-31, written as found: yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy, or mm/dd/yyyy if only that is
               valid, with or without leading zeros, with - . or /.  A day stays within its shape (whether day and month are under 10,
               and whether the day is over 12), so it is read the same way again, and has one pseudonym in whatever way it is written
    secret     32 hexadecimal digits or more; access keys of the forms AKIA..., sk_live_... (sk, pk, rk; live, test), ghp_..., xoxb-...:
               what follows their fixed beginning

A find starts where the one before it ends, e-mail addresses first; of other finds that overlap the one that begins first wins, and of
those that begin together the kind that comes first in the order of the patterns.

Not found: numbers of nine or ten digits without any separator (too many are something else), dates with names of months or two digits of a
year, names, addresses of streets, and card numbers in other groups than 4-4-4-4 and 4-6-5.

The key is the caller's: with it pseudonyms can be turned back, so it belongs to whoever may see the values, not into a program.

Cases: null text stays null with no finds; empty texts stay empty; a text of any length is read in one pass, in time that grows with its
length; repeated rows, ties and shared or null doc_ids change nothing, as each row is treated by itself; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _some
from .frames import small_batches

ROUNDS = 10
KINDS = ("email", "card", "phone", "ip", "iban", "ssn", "date", "secret")
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal() - datetime.date(1900, 1, 1).toordinal() + 1


def feistel(signs: list[int], sizes: list[int], key: bytes, tweak: bytes, back: bool = False) -> list[int]:
    """A permutation of the rows with sign k below sizes[k]."""
    out, half = list(signs), len(signs) // 2
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        a, b = (range(half), range(half, len(out))) if r % 2 else (range(half, len(out)), range(half))
        seed = hashlib.blake2b(b"%b|%d|%b" % (tweak, r, b",".join(b"%d" % out[k] for k in b)), key=key, digest_size=32).digest()
        stream = seed
        while len(stream) < 8 * len(a):
            seed = hashlib.blake2b(seed, key=key, digest_size=32).digest()
            stream += seed
        for j, k in enumerate(a):
            step = int.from_bytes(stream[8 * j : 8 * j + 8], "little")
            out[k] = (out[k] - step if back else out[k] + step) % sizes[k]
    return out


#: Country codes of one and two digits; all others have three. Fixed values of the international numbering plan.
_ONE, _TWO = ("1", "7"), ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")

_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7))
_HOME = {c: (a, k) for a in _ALPHABETS for k, c in enumerate(a)}


def by_class(text: str, key: bytes, tweak: bytes, back: bool = False) -> str:
    """Each letter and digit replaced by one of its own class; other signs stay."""
    at = [k for k, c in enumerate(text) if c in _HOME]
    homes = [_HOME[text[k]] for k in at]
    new = feistel([k for _, k in homes], [len(a) for a, _ in homes], key, tweak, back)
    out = list(text)
    for k, (a, _), x in zip(at, homes, new, strict=True):
        out[k] = a[x]
    return "".join(out)


def luhn(digits: list[int]) -> bool:
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c.isdigit()]


def _put(text: str, digits: list[int]) -> str:
    it = iter(digits)
    return "".join(str(next(it)) if c.isdigit() else c for c in text)


def _walk(value, step, valid):
    value = step(value)
    while not valid(value):
        value = step(value)
    return value


def _card(text, key, back):
    d = _digits(text)
    head = feistel(d[:-1], [10] * (len(d) - 1), key, b"card%d" % len(d), back)
    return _put(text, [*head, next(x for x in range(10) if luhn([*head, x]))])


def _phone(text, key, back):
    d = _digits(text)
    code = int(d[0] == 0)
    if text[0] == "+":
        first = "".join(map(str, d[:2]))
        code = 1 if first[0] in _ONE else 2 if first in _TWO else 3
    own = d[code:]
    tweak = b"phone%b:%d" % (bytes(d[:code]), len(own))
    return _put(text, [*d[:code], *_walk(own, lambda v: feistel(v, [10] * len(own), key, tweak, back), lambda v: (v[0] < 2) == (own[0] < 2))])


def _ip(text, key, back):
    if ":" in text:
        signs = [int(c, 16) for c in ipaddress.IPv6Address(text).exploded.replace(":", "")]
        new = _walk(signs, lambda v: feistel(v, [16] * 32, key, b"ip6", back), lambda v: _ip6_ok(_ip6(v)))
        out = _ip6(new)
        return out.upper() if any(c in "ABCDEF" for c in text) else out
    return ".".join(map(str, feistel([int(x) for x in text.split(".")], [256] * 4, key, b"ip", back)))


def _ip6(signs: list[int]) -> str:
    return ipaddress.IPv6Address(int("".join(f"{x:x}" for x in signs), 16)).compressed


def _ip6_ok(text: str) -> bool:
    """Whether an address says more than ::1 and the like, which are left alone however they are written."""
    return len(text) - text.count(":") >= 4 and "." not in text


def _ip_ok(text):
    if ":" not in text:
        return all(int(x) < 256 for x in text.split("."))
    try:
        short = ipaddress.IPv6Address(text).compressed
    except ValueError:
        return False
    return _ip6_ok(short) and len(text) - text.count(":") >= 4 and (text == text.lower() or text == text.upper())


def _iban_ok(text):
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban(text, key, back):
    body = by_class(text[4:], key, b"iban" + text[:2].upper().encode(), back)
    check = 98 - int("".join(str(int(c, 36)) for c in body.replace(" ", "") + text[:2] + "00")) % 97
    return f"{text[:2]}{check:02d}{body}"


def _ssn_ok(d):
    area, group, serial = d[0] * 100 + d[1] * 10 + d[2], d[3] * 10 + d[4], d[5:]
    return area not in (0, 666) and area < 900 and group > 0 and any(serial)


def _ssn(text, key, back):
    return _put(text, _walk(_digits(text), lambda v: feistel(v, [10] * 9, key, b"ssn", back), _ssn_ok))


def _read_date(text: str):
    """(day, how it is written), or None."""
    a, b, c = (int(x) for x in re.split(r"[-./]", text))
    for order, (y, m, d) in (("ymd", (a, b, c)),) if text[:4].isdigit() else (("dmy", (c, b, a)), ("mdy", (c, a, b))):
        try:
            day = datetime.date(y, m, d)
        except ValueError:
            continue
        if 0 <= day.toordinal() - FIRST_DAY < DAYS:
            return day, order
    return None


def _shape(day: datetime.date) -> tuple[bool, bool, bool]:
    return day.month < 10, day.day < 10, day.day > 12


def _date(text, key, back):
    day, order = _read_date(text)
    sep = next(c for c in text if not c.isdigit())
    padded = all(len(x) != 1 for x in text.split(sep))

    def step(n):
        a, b = feistel([n // 271, n % 271], [270, 271], key, b"date", back)
        return a * 271 + b

    at = _walk(day.toordinal() - FIRST_DAY, step, lambda n: n < DAYS and _shape(datetime.date.fromordinal(FIRST_DAY + n)) == _shape(day))
    new = datetime.date.fromordinal(FIRST_DAY + at)
    parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if padded else str(new.month), "d": f"{new.day:02d}" if padded else str(new.day)}
    return sep.join(parts[x] for x in order)


def _hex(text: str) -> bool:
    return len(text) >= 32 and all(c in "0123456789abcdefABCDEF" for c in text)


def _secret(text, key, back):
    if _hex(text):
        alphabet = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
        new = feistel([alphabet.index(c) for c in text], [16] * len(text), key, b"secret%d" % len(text), back)
        return "".join(alphabet[x] for x in new)
    head = _HEAD.match(text)[0]
    return head + by_class(text[len(head) :], key, b"secret" + head.encode(), back)


_HEAD = re.compile(r"AKIA|[spr]k_(?:live|test)_|gh[pousr]_|xox[abprs]-")
_EMAIL = re.compile(r"(?<![\w.%+\-])(?<!\w')[\w.%+\-]+(?:'[\w.%+\-]+)*@(?:[\w\-]+\.)+[^\W\d_]{2,}(?![\w\-]|\.\w)")
_COARSE = re.compile(
    r"(?P<secret>(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|[spr]k_(?:live|test)_[0-9A-Za-z]{16,}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z\-]{10,})(?!\w))"
    r"|(?P<iban>(?<!\w)(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)(?!\w))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)|(?<![\w:.])(?=[0-9A-Fa-f:]{6,39}(?![\w:]))[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]))"
    r"|(?P<date>(?<![\w./\-])(?:\d{4}(?P<s>[-./])\d{1,2}(?P=s)\d{1,2}|\d{1,2}(?P<t>[-./])\d{1,2}(?P=t)\d{4})(?![\w/\-]|\.\d))"
    r"|(?P<ssn>(?<![\w\-])\d{3}(?P<h>[- ])\d\d(?P=h)\d{4}(?![\w\-]))"
    r"|(?P<card>(?<![\w.+])(?:\d{4}(?P<u>[ \-])\d{4}(?P=u)\d{4}(?P=u)\d{4}|\d{4}(?P<v>[ \-])\d{6}(?P=v)\d{5}|\d{13,19})(?!\w|\.\d))"
    r"|(?P<phone>(?<![\w.+])(?:(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}|\+\d{8,15}|\+\d{1,3}(?:[ .\-]\d{1,8}){2,6}|0\d(?P<w>[ .\-])\d\d(?:(?P=w)\d\d){3})(?![\w\-]|\.\d))",
    re.ASCII,
)
_WAYS = {"card": _card, "phone": _phone, "ip": _ip, "iban": _iban, "ssn": _ssn, "date": _date, "secret": _secret}


def _iban_end(text: str) -> int:
    """Where the longest run of groups ends that passes the test, 0 if none does."""
    ends = [len(text), *(k for k in range(len(text) - 1, 14, -1) if text[k] == " ")]
    return next((k for k in ends if _iban_ok(text[:k])), 0)


def kind_of(match: re.Match) -> tuple[str, int] | None:
    """What a find is and where it ends, None if it doesn't pass its test."""
    kind, text = match.lastgroup, match[0]
    if kind in ("s", "t", "h", "u", "v", "w"):
        kind = next(k for k in ("date", "ssn", "card", "phone") if match[k])
    if kind == "iban":
        end = _iban_end(text)
        return (kind, match.start() + end) if end else None
    valid = {"card": lambda: luhn(_digits(text)), "ip": lambda: _ip_ok(text), "ssn": lambda: _ssn_ok(_digits(text)), "phone": lambda: text[0] != "+" or 8 <= len(_digits(text)) <= 15, "date": lambda: _read_date(text) is not None}
    return (kind, match.end()) if valid.get(kind, lambda: True)() else None


def _email(text: str, key: bytes, back: bool) -> str:
    head, dot, last = text.rpartition(".")
    return by_class(head, key, b"email", back) + dot + last


def finds(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is found, in order; in one pass, as e-mail addresses and the others come in order."""
    mails = [(m.start(), m.end()) for m in _EMAIL.finditer(text)] if "@" in text else []
    out, at, k = [], 0, 0
    while m := _COARSE.search(text, at):
        while k < len(mails) and mails[k][1] <= m.start():
            out.append((*mails[k], "email"))
            k += 1
        if k < len(mails) and mails[k][0] < m.end():
            # looked at again from where the address ends
            at = mails[k][1]
            continue
        found = kind_of(m)
        if found:
            out.append((m.start(), found[1], found[0]))
        # signs that look like an IBAN and are none may hold something else
        at = found[1] if found else m.start() + 2 if m["iban"] else m.end()
    return [*out, *((s, e, "email") for s, e in mails[k:])]


def pseudonymize(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and where they stand in it with their kinds. back: from pseudonyms to values."""
    out, spans, at, length = [], [], 0, 0
    for s, e, kind in finds(text):
        new = (_email if kind == "email" else _WAYS[kind])(text[s:e], key, back)
        out += [text[at:s], new]
        length += s - at
        spans.append((length, length + len(new), kind))
        length, at = length + len(new), e
    return "".join([*out, text[at:]]), spans


_DIGIT = re.compile(r"[0-9]").search
OUT = "doc_id long, text string, n_found long, spans array<struct<start:int,end:int,kind:string>>"


def protect(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_found, spans of the pseudonyms (in code points)."""
    small_batches(docs.sparkSession)

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch, texts in _some(batches, "text"):
            there = batch.column(1).is_valid().to_pylist()
            done = [pseudonymize(t, key) if "@" in t or _DIGIT(t) else (t, []) for t in texts]
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in x] for _, x in done]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t if ok else None for (t, _), ok in zip(done, there, strict=True)], pa.string()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, kind)], ["doc_id", "text", "n_found", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


#: Where a session names the key.
KEY_SETTING = "spark.threadloom.pii.key"
_DRAWN: dict[str, bytes] = {}


def session_key(spark) -> bytes:
    """The key that the session names, or one drawn for it, which nobody else has: pseudonyms are then linked within the application, and can't be
    turned back."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def query(spark, sf_dir: str) -> DataFrame:
    key = session_key(spark)
    return protect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key)
