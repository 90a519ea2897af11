"""PII: detection and keyed surrogates.

Every detected entity is replaced by one of its own type and format: digits by digits, letters by letters of the same
script, case and sound class (vowel or consonant), hexadecimal by hexadecimal, symbols of a secret by symbols, addresses by
valid addresses of the same kind, numbers with check digits (cards, IBANs) by such with right ones, social security numbers by
possible ones. Listed given names become listed ones of the same gender; other given names get, after the permutation of their
letters, an ending of their gender (from the title, else from the name's last letter) in Latin, Cyrillic and Greek script;
other scripts have no such ending.

Replacements are keyed permutations (a Feistel network over the values of one format) without fixed points, so equal
entities are replaced alike in every document (coreference), different ones never by the same surrogate (distinctness) and none by
itself, without any table of entities: nothing is shuffled, gathered or broadcast but the key, which has no default.
A surrogate that equals another entity of the same document is permuted on until it does not (``n_repaired``); only
where a format has no value left, as with names of a list that all occur, a clash stays (``n_clashes``).
"""

from __future__ import annotations

import hashlib
import math
import re
import secrets
import string
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import chunks, column_function, small_batches

ROUNDS = 8
#: Times that a clashing surrogate is permuted on.
REPAIRS = 64
#: The session setting that holds the key.
KEY_SETTING = "spark.millrace.pii.key"
#: Characters of a secret that are permuted at once.
PIECE = 256

#: Titles by gender, and given names by gender from which surrogates are drawn.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sir"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Señorita"), "n": ("Dr", "Prof")}
GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Peter", "Paul", "Hans", "Karl", "Pierre", "Jean", "Carlos", "José"),
    "f": ("Mary", "Anna", "Linda", "Susan", "Sarah", "Karen", "Laura", "Emma", "Julia", "Alice", "Greta", "Petra", "Marie", "Claire", "Carmen", "Lucía"),
}
#: Letter classes by script; a surrogate letter comes from the same class. Other letters and digits have
#: classes by Unicode block, script, category and case.
ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåæéèêëíìîïóòôöõøúùûü", "çñß", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
#: Endings that no listed name has, for given names outside the lists, by script and gender.
ENDINGS = {"LATIN": {"m": "us", "f": "ina"}, "CYRILLIC": {"m": "ий", "f": "ина"}, "GREEK": {"m": "ος", "f": "ίνα"}}
#: Last letters of given names that are taken for feminine where no title says it.
FEMININE = "aeiyаяη"
_GENDER = {n: g for g, ns in GIVEN.items() for n in ns}
_CLASS = {c: a for a in ALPHABETS for c in a} | {c: "0123456789" for c in "0123456789"}
_HEX = "0123456789abcdef"


def _fold(c: str) -> str:
    """The lower-case form of a character if that gives it back in upper case, else the character."""
    low = c.lower()
    return low if len(low) == 1 and low.upper() == c else c


def _kind(c: str) -> tuple | None:
    """Block of 256 code points, script, category and case of a folded letter or digit outside ``ALPHABETS``, else None."""
    if not c.isalnum() or c in _CLASS or _fold(c) != c:
        return None
    return ord(c) >> 8, unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), _fold(c.upper()) == c != c.upper() if len(c.upper()) == 1 else False


@cache
def _block(page: int) -> dict[str, str]:
    """Classes of a block's characters outside ``ALPHABETS``: those of one kind; a kind's only one has none here."""
    kinds: dict[tuple, str] = {}
    for n in range(page << 8, (page + 1) << 8):
        if (kind := _kind(chr(n))) is not None:
            kinds[kind] = kinds.get(kind, "") + chr(n)
    return {c: own for own in kinds.values() if len(own) > 1 for c in own}


@cache
def _alone() -> dict[str, str]:
    """Classes of the characters that are the only ones of their kind in their block, by category and case."""
    pools: dict[tuple, str] = {}
    for n in range(sys.maxunicode + 1):
        if (kind := _kind(chr(n))) is not None and chr(n) not in _block(n >> 8):
            pool = (kind[2] if kind[2][0] == "L" else "N", kind[3])
            pools[pool] = pools.get(pool, "") + chr(n)
    return {c: own for own in pools.values() for c in own}


def _any_class(c: str) -> str | None:
    """The class of any letter or digit."""
    if c in _CLASS or not c.isalnum():
        return _CLASS.get(c)
    return _block(ord(c) >> 8).get(c) or _alone().get(c)


_SYMBOLS = "".join(c for c in string.punctuation if c not in "\"'")


@cache
def _symbols() -> dict[str, str]:
    """Classes of all characters that are neither letters, digits, blanks nor quotes: ASCII ones are one class, others go by
    block and category; the only ones of their kind are one class together."""
    kinds: dict[tuple, str] = {}
    for n in range(sys.maxunicode + 1):
        c = chr(n)
        if not c.isalnum() and not c.isspace() and c not in _SYMBOLS and c not in "\"'" and not 0xD800 <= n < 0xE000:
            kind = n >> 8, unicodedata.category(c)
            kinds[kind] = kinds.get(kind, "") + c
    alone = "".join(own for own in kinds.values() if len(own) == 1)
    return {c: _SYMBOLS for c in _SYMBOLS} | {c: own if len(own) > 1 else alone for own in kinds.values() for c in own}


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CAPITAL = r"[^\W\d_a-zà-öø-ÿа-яα-ω]\w*(?:-\w+)?"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_LISTED = "|".join(_GENDER)
#: Words after which a capital word is a name.
_CUE = r"(?:my name is|full name:|signed:|ich heiße|je m'appelle|me llamo|yours sincerely,|best regards,)"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}\b)"
    rf"|(?P<ip>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d))"
    r"|(?P<key>(?<!\w)AKIA[0-9A-Z]{16}(?!\w))"
    r"|(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>[^\s\"']{6,})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w+.-])\d(?:[ -]?\d){12,18}(?!\w|-\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\w))"
    rf"|(?<!\w)(?P<title>{_TITLE})\.? (?P<name>{_CAPITAL}(?: {_CAPITAL})?)"
    rf"|(?<!\w)(?P<full>(?:{_LISTED}) {_CAPITAL})"
    rf"|(?i:(?<!\w){_CUE}) (?P<named>{_CAPITAL}(?: {_CAPITAL})?)"
)
_HINT = re.compile(rf"[0-9@=:]|(?<!\w)(?:(?:{_TITLE})\.? |(?:{_LISTED}) |(?i:{_CUE}) )")


#: First address and size of the blocks of special addresses.
BLOCKS = tuple((a << 24 | b << 16, 1 << n) for a, b, n in ((0, 0, 24), (10, 0, 24), (127, 0, 24), (169, 254, 16), (172, 16, 20), (192, 168, 16), (224, 0, 29)))


def _luhn_check(body: str) -> int:
    """The check digit that belongs behind the digits."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _luhn(digits: str) -> bool:
    return _luhn_check(digits[:-1]) == int(digits[-1])


def _iban_check(value: str) -> int:
    """The check digits that belong to an IBAN's country and account."""
    compact = value.replace(" ", "")
    number = "".join(str(int(c, 36)) for c in compact[4:] + compact[:2])
    return 98 - int(number + "00") % 97


def _possible_ssn(value: str) -> bool:
    area, group, serial = (int(x) for x in value.split("-"))
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _listed(word: str) -> str | None:
    """The listed given name that a word is, as it stands or in capitals."""
    name = word.capitalize() if len(word) > 1 and word.isupper() else word
    return name if name in _GENDER else None


class Surrogates:
    """Keyed, format-preserving replacements."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _mix(self, tweak: bytes, i: int, x: int, size: int) -> int:
        n = (size.bit_length() + 7) // 8 + 8
        h = hashlib.shake_256(self.key + tweak + bytes([i]) + x.to_bytes((x.bit_length() + 8) // 8, "big"))
        return int.from_bytes(h.digest(n), "big") % size

    def _network(self, x: int, size: int, tweak: bytes, back: bool) -> int:
        """A Feistel permutation of range(size), or its inverse; values beyond the range are permuted on."""
        a = 1 << (size.bit_length() // 2)
        b = -(-size // a)
        sign = -1 if back else 1
        while True:
            left, right = x % a, x // a
            for i in range(ROUNDS)[::sign]:
                if i % 2:
                    right = (right + sign * self._mix(tweak, i, left, b)) % b
                else:
                    left = (left + sign * self._mix(tweak, i, right, a)) % a
            x = right * a + left
            if x < size:
                return x

    def permute(self, x: int, size: int, tweak: bytes) -> int:
        """A permutation of range(size) that is one cycle: a rotation seen through the network. So no value stays (if size > 1),
        and neither does any if the permutation is applied until a value of a smaller set is met."""
        if size < 2:
            return x
        step = 1 + self._mix(tweak, ROUNDS, size, size - 1)
        while math.gcd(step, size) > 1:
            step = step % (size - 1) + 1
        return self._network((self._network(x, size, tweak, False) + step) % size, size, tweak, True)

    def letters(self, text: str, kind: str, classes: dict[str, str] | None = None, symbols: bool = False) -> str:
        """Replace every character that has a class (without ``classes`` every letter and digit, with ``symbols`` others too) by one of that class;
        the others stay. Case is laid over."""
        low = [_fold(c) for c in text]
        radix = [classes.get(c) if classes is not None else _any_class(c) or (_symbols().get(c) if symbols else None) for c in low]
        size, x = 1, 0
        for c, r in zip(low, radix):
            if r:
                x = x * len(r) + r.index(c)
                size *= len(r)
        shape = "".join(c if r is None else r[0] for c, r in zip(low, radix))
        y = self.permute(x, size, f"{kind}\0{shape}".encode())
        out = []
        for c, r in zip(reversed(text), reversed(radix)):
            if r:
                y, i = divmod(y, len(r))
                c = r[i].upper() if _fold(c) != c and len(r[i].upper()) == 1 else r[i]
            out.append(c)
        return "".join(reversed(out))

    def replace(self, kind: str, value: str, gender: str = "n") -> str:
        return getattr(self, f"_{kind}", self.letters)(value, *((gender,) if kind == "name" else (kind,)))

    def _email(self, value: str, kind: str) -> str:
        address, _, tld = value.rpartition(".")
        return f"{self.letters(address, kind)}.{tld}"

    def _ip(self, value: str, kind: str) -> str:
        """Private, loopback and other special addresses stay in their block; all others stay out of these."""
        x = 0
        for octet in value.split("."):
            x = x << 8 | int(octet)
        block = next((b for b in BLOCKS if b[0] <= x < b[0] + b[1]), None)
        if block:
            y = block[0] + self.permute(x - block[0], block[1], b"ip %d" % block[0])
        else:
            y = x
            while y == x or any(b <= y < b + n for b, n in BLOCKS):
                y = self.permute(y, 1 << 32, b"ip")
        return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))

    def _key(self, value: str, kind: str) -> str:
        return value[:4] + self._of(value[4:], kind, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def _secret(self, value: str, kind: str) -> str:
        cuts = [(at, f"{kind} {at}" if at else kind) for at in range(0, len(value), PIECE)]
        if all(c in _HEX for c in value):
            return "".join(self._of(value[at : at + PIECE], k, _HEX) for at, k in cuts)
        no_letters = not any(c.isalnum() for c in value)
        new = value
        while new == value or all(c in _HEX for c in new):  # hexadecimal ones belong to such
            new = "".join(self.letters(new[at : at + PIECE], k, symbols=no_letters) for at, k in cuts)
        return new

    def _iban(self, value: str, kind: str) -> str:
        """Country and layout stay; the check digits are as right, or as wrong by as much, as they were."""
        tail = self.letters(value[4:], kind)
        check = (int(value[2:4]) - _iban_check(value) + _iban_check(value[:4] + tail)) % 100
        return f"{value[:2]}{check:02d}{tail}"

    def _ssn(self, value: str, kind: str) -> str:
        """Possible numbers become possible ones, others others."""
        new = self.letters(value, kind)
        while _possible_ssn(new) != _possible_ssn(value):
            new = self.letters(new, kind)
        return new

    def _card(self, value: str, kind: str) -> str:
        at = [i for i, c in enumerate(value) if c.isdigit()]
        number = "".join(str(int(value[i])) for i in at)
        body = self._of(number[:-1], "luhn", "0123456789")
        last = int(number[-1]) - _luhn_check(number[:-1]) + _luhn_check(body)  # as right or wrong as it was
        out = f"{body}{last % 10}"
        chars = list(value)
        for i, c in zip(at, out):
            chars[i] = chr(ord(chars[i]) - int(chars[i]) + int(c))  # in the script of the digit
        return "".join(chars)

    def _phone(self, value: str, kind: str) -> str:
        head = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        n = head.end() if head else 0
        return value[:n] + self.letters(value[n:], kind)

    def _of(self, text: str, kind: str, alphabet: str) -> str:
        low = alphabet.lower()
        new = self.letters(text.lower(), kind, {c: low for c in low})
        return new if low == alphabet else new.upper()

    def _name(self, value: str, gender: str) -> str:
        """The first of several words is a given name, all others are surnames."""
        first, *rest = value.split(" ")
        return " ".join([self._given(first, gender) if rest else self._surname(first), *map(self._surname, rest)])

    def _unlisted(self, word: str, kind: str) -> str:
        """A permutation of the words outside the lists."""
        new = self.letters(word, kind)
        while _listed(new):
            new = self.letters(new, kind)
        return new

    def _surname(self, word: str) -> str:
        """Listed names become listed ones of their gender in any place, so no other word may become one of them."""
        if name := _listed(word):
            own = GIVEN[_GENDER[name]]
            new = own[self.permute(own.index(name), len(own), f"given {_GENDER[name]}".encode())]
            return new if word == name else new.upper()
        return self._unlisted(word, "name")

    def _given(self, word: str, gender: str) -> str:
        if _listed(word):
            return self._surname(word)
        script = unicodedata.name(word[0], "").split(" ")[0]
        if gender not in GIVEN:
            gender = "f" if word[-1].lower() in FEMININE else "m"
        ending = ENDINGS.get(script, {}).get(gender, "")
        new = self._unlisted(word, f"given {gender if ending else ''}")
        return new + (ending.upper() if len(word) > 1 and word.isupper() else ending)


def session_key(spark: SparkSession) -> str:
    """The key that the session setting KEY_SETTING holds; where there is none, a random one, kept for the session."""
    if not (key := spark.conf.get(KEY_SETTING, None)):
        spark.conf.set(KEY_SETTING, key := secrets.token_hex(32))
    return key


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(type, start, end, gender) of the entities of a text, in order; none overlap. Numbers like cards' without a right
    check digit are none."""
    if not _HINT.search(text):
        return []
    out = []
    for m in PATTERN.finditer(text):
        kind = group = m.lastgroup
        gender = "n"
        if group in ("name", "full", "named"):
            kind = "name"
            gender = next((g for g, ts in TITLES.items() if m["title"] in ts), "n")
        start, end = m.span(group)
        if kind == "secret":
            end = start + (len(m[kind].rstrip(".,;:!?)]}")) or end - start)
        if kind != "card" or _luhn("".join(str(int(c)) for c in m[kind] if c.isdigit())):
            out.append((kind, start, end, gender))
    return out


def rewrite(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, int, int]], int, int]:
    """(new text, (type, start, length) of its entities, clashes left, clashes repaired)."""
    found = find(text)
    originals = {text[a:b] for _, a, b, _ in found}
    new_of: dict[tuple, str] = {}
    used: set[str] = set()
    clashes = repaired = 0
    parts, own, at, size = [], [], 0, 0
    for kind, a, b, gender in found:
        key = kind, text[a:b], gender
        if key not in new_of:
            first = new = surrogates.replace(*key)
            tries = 0
            while (new in originals or new in used) and tries < REPAIRS:
                new = surrogates.replace(kind, new, gender)
                tries += 1
            if new in originals or new in used:
                new = first
                clashes += 1
            else:
                repaired += tries > 0
            new_of[key] = new
            used.add(new)
        new = new_of[key]
        parts += [text[at:a], new]
        size += a - at
        own.append((kind, size, len(new)))
        size += len(new)
        at = b
    return "".join(parts) + text[at:], own, clashes, repaired


ENTITY = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])
FOUND = T.StructType([T.StructField("text", T.StringType()), T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("n_clashes", T.IntegerType()), T.StructField("n_repaired", T.IntegerType())])


def replace_pii(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows with their text rewritten: column ``row`` holds all input columns as they were, ``text`` the new text,
    ``entities`` what was found (type, place and length in the new text), ``n_repaired`` how many surrogates equalled
    another entity of the same text and were permuted on, ``n_clashes`` how many could not be.

    Null texts stay null and empty ones empty, with no entities; texts without entities are unchanged; equal texts, as of
    repeated rows, are rewritten alike; an empty table gives an empty table; columns of any name are carried inside
    ``row``. Who knows ``key`` can undo the replacement: an empty one is an error, see ``session_key``.
    """
    if not key:
        raise ValueError("surrogates need a key")
    small_batches(df.sparkSession)
    secret = key.encode()
    entity = pa.struct([("type", pa.string()), ("start", pa.int32()), ("length", pa.int32())])
    kind = pa.struct([("text", pa.string()), ("entities", pa.list_(entity)), ("n_clashes", pa.int32()), ("n_repaired", pa.int32())])

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        surrogates = Surrogates(secret)
        for col in columns:
            out = []
            for i, j in chunks(col):
                rows = []
                for text in col.slice(i, j - i).to_pylist():
                    new, own, clashes, repaired = rewrite(text, surrogates) if text else (text, [], 0, 0)
                    rows.append((new, [dict(zip(("type", "start", "length"), e)) for e in own], clashes, repaired))
                out.append(pa.array([dict(zip(FOUND.names, r)) for r in rows], kind))
            yield pa.concat_arrays(out) if out else pa.array([], kind)

    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), column_function(run, FOUND)(df[text_col]).alias("__found")).select("row", "__found.*")
