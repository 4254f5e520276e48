"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

A value is found by its form and, where its kind has a check, validated. Its
digits or letters are then permuted by a balanced Feistel network keyed by a
secret: in each round every character of one half is shifted within its own
class by a stream hashed from the whole other half, so values of any length
are mixed throughout, in time that grows with the length. Days and addresses
are permuted as numbers. The permutation maps the values of a format one to
one onto themselves, so equal values get equal pseudonyms in every document
and different ones stay different. A result that would fail the kind's check
is permuted again until one passes, which keeps the map one to one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.names import set_aside
from tessera.llm.store import table

ROUNDS = 8
KEY = b"tessera test key"  # for the queries; pass a secret of your own
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1
KINDS = ["email", "secret", "iban", "card", "ssn", "phone", "ip", "date"]

# Forms of the kinds, in the order in which they are tried.
FORMS = {
    "email": r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",  # after a name of NAME
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?<![0-9][ .-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?|\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[.-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])(?![ .-][0-9]{3,4}(?![0-9]))",
}
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PATTERNS = {kind: re.compile(form) for kind, form in FORMS.items()}
#: Without one of these a text holds none of the kinds.
SOME = re.compile(r"[@0-9]")
LONG_HEX = re.compile(r"[0-9a-fA-F]{32}|AKIA|gh[pousr]_|sk-")


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 to size - 1.

    The network works on pairs (left, right) of a square that holds size
    numbers, and walks on from results outside.
    """
    if size < 2:
        return value
    side = 1
    while side * side < size:
        side *= 2
    salt = b"%d:%b:%b:%d:" % (len(key), key, tweak.encode(), size)
    width = (side.bit_length() + 7) // 8 + 8  # eight bytes more than a half, so that the remainder is even
    while True:
        left, right = divmod(value, side)
        for i in range(ROUNDS):
            mixed = hashlib.shake_256(salt + b"%d:%d" % (i, right)).digest(width)
            left, right = right, (left + int.from_bytes(mixed, "big")) % side
        value = left * side + right
        if value < size:
            return value


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def luhn_digit(digits: str) -> str:
    return next(c for c in "0123456789" if luhn(digits + c))


def iban_check(body: str, country: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def refill(form: str, letters: str, wanted: Callable[[str], bool]) -> str:
    """form with its wanted characters replaced by letters, in order."""
    it = iter(letters)
    return "".join(next(it) if wanted(c) else c for c in form)


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def classes(text: str) -> list[str]:
    """For each character the letters or digits that may stand for it; none for signs."""
    return [DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else "" for c in text]


def permute(text: str, key: bytes, tweak: str, alphabet: str = "") -> str:
    """text with each digit, small and capital letter replaced by one of its own class, or each character by one of alphabet."""
    bases = [alphabet] * len(text) if alphabet else classes(text)
    at = [i for i, base in enumerate(bases) if base]
    sizes = [len(bases[i]) for i in at]
    values = [bases[i].index(text[i]) for i in at]
    half = len(at) // 2
    salt = b"%d:%b:%b:" % (len(key), key, f"{tweak}:{sizes}".encode())
    for i in range(ROUNDS):
        # even rounds change the second half by the first
        mine, other = (slice(half, None), slice(0, half)) if i % 2 == 0 else (slice(0, half), slice(half, None))
        n = len(values[mine])
        stream = hashlib.shake_256(salt + b"%d:" % i + bytes(values[other])).digest(8 * n)
        values[mine] = [(v + int.from_bytes(stream[8 * k : 8 * k + 8], "big")) % size for k, (v, size) in enumerate(zip(values[mine], sizes[mine]))]
    out = list(text)
    for i, v in zip(at, values):
        out[i] = bases[i][v]
    return "".join(out)


def hexes(text: str, key: bytes, tweak: str) -> str:
    low = permute(text.lower(), key, tweak, DIGITS + "abcdef")
    return low if text == text.lower() else low.upper()


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def email(v: str, key: bytes) -> str:
    name, _, host = v.partition("@")
    labels = host.split(".")
    labels[:-1] = [permute(x, key, "host") for x in labels[:-1]]
    return f"{permute(name, key, 'name')}@{'.'.join(labels)}"


def secret(v: str, key: bytes) -> str | None:
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", v):
        return hexes(v, key, "secret")
    head = re.match("AKIA|gh[pousr]_|sk-", v)[0]
    return head + permute(v[len(head) :], key, "secret")


def iban(v: str, key: bytes) -> str | None:
    plain = v.replace(" ", "")
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    body = permute(plain[4:], key, "iban" + plain[:2])
    return refill(v, plain[:2] + iban_check(body, plain[:2]) + body, lambda c: c != " ")


def card(v: str, key: bytes) -> str | None:
    d = digits_of(v)
    if not luhn(d) or len(set(d)) == 1:
        return None
    while True:
        d = permute(d[:-1], key, "card")
        d += luhn_digit(d)
        if len(set(d)) > 1:
            return refill(v, d, DIGITS.__contains__)


def ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def ssn(v: str, key: bytes) -> str | None:
    d = digits_of(v)
    if not ssn_valid(d):
        return None
    while not ssn_valid(d := permute(d, key, "ssn")):
        pass
    return refill(v, d, DIGITS.__contains__)


def day_of(v: str) -> tuple[date, str] | None:
    """The day and its format; day first where both could be, unless the second number is over 12."""
    sep = re.search(r"[-/.]", v)[0]
    parts = v.split(sep)
    for order in ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy"):
        y, m, d = (int(parts[order.index(x)]) for x in "ymd")
        try:
            day = date(y, m, d)
        except ValueError:
            continue
        return (day, sep.join({"y": "%Y", "m": "%m", "d": "%d"}[x] for x in order)) if FIRST_DAY <= day <= LAST_DAY else None
    return None


def day(v: str, key: bytes) -> str | None:
    """A day of 1900 to 2099; a day-first pseudonym that reads otherwise as month first can't occur, as days win."""
    found = day_of(v)
    if not found:
        return None
    at, form = found
    n = (at - FIRST_DAY).days
    while True:
        n = feistel(n, DAYS, key, "date" + form)
        out = (FIRST_DAY + timedelta(n)).strftime(form)
        again = day_of(out)
        if again and again[1] == form:  # in the same format again, so that the map stays one to one
            return out


def ip(v: str, key: bytes) -> str | None:
    parts = v.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = feistel(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def phone(v: str, key: bytes) -> str | None:
    """The country code stays, as part of the format."""
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", v)
    head = code[0] if code else ""
    rest = v[len(head) :]
    d = digits_of(rest)
    if not 7 <= len(d) <= 13:
        return None
    return head + refill(rest, permute(d, key, f"phone{head}"), DIGITS.__contains__)


CHANGE = {"email": email, "secret": secret, "iban": iban, "card": card, "ssn": ssn, "phone": phone, "ip": ip, "date": day}


def places(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Where a kind's form occurs; a name before an @ is sought backwards, as a long text may have none."""
    for m in PATTERNS[kind].finditer(text):
        a, b = m.span()
        if kind == "email":
            while a and text[a - 1] in NAME:
                a -= 1
            if a == m.start():
                continue
        yield a, b


def spans(text: str) -> list[tuple[int, int, str]]:
    """Places (start, end, kind) of valid values, none overlapping; earlier kinds of FORMS win."""
    found: list[tuple[int, int, str]] = []  # sorted
    if not SOME.search(text) and not LONG_HEX.search(text):
        return found
    for kind in PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        before = iter(found)
        last = next(before, None)  # the first of those before that ends after what has been seen
        new, end = [], 0
        for a, b in places(kind, text):
            a = max(a, end)  # a name may reach back into the value before
            while last and last[1] <= a:
                last = next(before, None)
            if last and last[0] < b:
                continue
            if CHANGE[kind](text[a:b], b"x") is not None:
                new.append((a, b, kind))
                end = b
        found = sorted(found + new)
    return found


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and where they were put."""
    found = spans(text)
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], CHANGE[kind](text[a:b], key)]
        at = b
    out.append(text[at:])
    return "".join(out), found


def replace(df: DataFrame, key: bytes, text: str = "text", out: str = "pii") -> DataFrame:
    """df with pseudonyms in text, and the array column out of (start, length, kind).

    Places count code points of the text, whose length stays but for IP
    addresses and their octets; they refer to the text before. Numbers that
    fail their kind's check and days outside 1900 to 2099 stay as they are.
    A null text stays null and has no places. Other columns stay; one named
    out is replaced.
    """

    @F.arrow_udf("struct<text:string,found:array<struct<start:int,length:int,kind:string>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string())])
        for texts in slices(batches):
            new, found = [], []
            for t in texts:
                t = t.as_py()
                changed, at = pseudonymise(t, key) if t else (t, [])
                new.append(changed)
                found.append([{"start": a, "length": b - a, "kind": k} for a, b, k in at])
            yield pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(found, pa.list_(place))], names=["text", "found"])

    safe, back = set_aside(df, "_pii")
    done = safe.withColumn("_pii", run(F.col(text)))
    return back(done.withColumn(text, F.col("_pii.text")).withColumn(out, F.col("_pii.found")).drop("_pii"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and the number of values by kind."""
    docs = replace(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    count = lambda kind: F.size(F.filter("pii", lambda p: p.kind == kind)).alias(f"n_{kind}")
    return docs.select("doc_id", "text", *map(count, KINDS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, with pseudonyms; a column n_chars follows the text."""
    safe, back = set_aside(docs, "_found")
    done = replace(safe, KEY, out="_found")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size("_found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(done.drop("_found")).select(*docs.columns)
