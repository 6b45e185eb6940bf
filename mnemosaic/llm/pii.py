"""Personal data replaced by surrogates that keep type, format, script and gender.

A surrogate is the image of the entity under a keyed permutation of the strings of its format, so equal
entities get equal surrogates everywhere and distinct ones distinct surrogates, without a table of all
entities. The permutation is a Feistel network around a step of one: a single cycle, so that no entity
is its own surrogate, and walked on until the result is of the same class. Given names in the lists are
permuted within their gender and script; others get letters of their script and the ending of their gender.

Names are found by a title, a listed given name or the words around them. What a document teaches is used
throughout it: a given name or surname found once is replaced wherever it stands. collisions() counts what
would break distinctness over the whole corpus.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Given names by script and gender, titles by gender, and the endings of surrogates of names that are in no list (no listed name ends so).
GIVEN = {
    ("latin", "f"): "Alice Amanda Amy Andrea Angela Anna Barbara Carmen Catherine Chloe Clara Deborah Diana Elena Elizabeth Emily Emma Eva Hannah Helen Ines Jane Jennifer Jessica Julia Karen Kate Laura Linda Lisa Lucia Margaret Maria Marie Martha Mary Michelle Nancy Nina Olivia Patricia Paula Rachel Rosa Ruth Sandra Sarah Sofia Sophie Susan Victoria".split(),
    ("latin", "m"): "Adam Albert Alexander Andrew Anthony Benjamin Brian Carlos Charles Christopher Daniel David Diego Edward Emil Eric Felix Frank George Hans Henry Hugo Jack James Jason Jean John Joseph Karl Kevin Leon Louis Lucas Mark Martin Matthew Michael Oscar Paul Peter Philip Richard Robert Ryan Samuel Simon Stephen Steven Thomas Timothy William".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Mme Madame Señora Sra Госпожа".split(), "m": "Mr Herr Monsieur Señor Sr Господин".split(), "": "Dr Prof".split()}
ENDINGS = {("latin", "f"): "elia", ("latin", "m"): "ius", ("latin", "surname"): "sen", ("cyrillic", "f"): "ида", ("cyrillic", "m"): "ус", ("cyrillic", "surname"): "енко"}
BEFORE, AFTER = "[Mm]y name is|[Ss]igned by|[Ww]ritten by|[Cc]ontact|[Dd]ear|[Ss]incerely,|[Rr]egards,", "said|says|wrote|writes|told|asked|replied"
_ALL_GIVEN = {n: (script, gender) for (script, gender), names in GIVEN.items() for n in names}
_NAMES = "|".join(sorted(_ALL_GIVEN, key=len, reverse=True))
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_TITLED = "|".join(re.escape(t) for t in sorted(_GENDER, key=len, reverse=True))
_CAP = r"[^\W\d_a-z][^\W\d_]+"
_GAP = r"[ \u00a0]+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)|(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{2,39}(?![\w:]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d]|[.-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w+.-])(?:\+\d{8,15}|1[2-9]\d{9})(?!\w|[.-]\d)|(?<=[Tt]el )\d{7,12}(?!\w)|(?<=[Pp]hone )\d{7,12}(?!\w)|(?<=[Cc]all )\d{7,12}(?!\w)",
    "name": rf"(?<!\w)(?:(?P<title>{_TITLED})\.?{_GAP}(?:(?P<g1>{_CAP}){_GAP})?(?P<s1>{_CAP})|(?P<g2>{_NAMES}){_GAP}(?P<s2>{_CAP})|(?:{BEFORE}){_GAP}(?P<g3>{_CAP}){_GAP}(?P<s3>{_CAP})|(?P<g4>{_CAP}){_GAP}(?P<s4>{_CAP})(?={_GAP}(?:{AFTER})\b))(?!\w)",
}
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
_WORD = re.compile(rf"(?<!\w){_CAP}(?!\w)")
#: Wider than the patterns, for a first pass by batch.
_LIKELY = {"email": "@", "ip": r"\d\.\d|:[0-9A-Fa-f]*:", "iban": r"[A-Z]{2}\d{2}[A-Z0-9]{11}", "card": r"\d(?:[ -]?\d){12}", "ssn": r"\d-\d{2}-\d", "phone": r"\d[ .)-]{1,2}\d{3,4}[ .-]\d{3}|\d{7}", "name": rf"(?:{_TITLED})\.?[ \x{{a0}}]|(?:{_NAMES})[ \x{{a0}}]|(?:{BEFORE})[ \x{{a0}}]|[ \x{{a0}}](?:{AFTER})"}
KINDS = tuple(PATTERNS)


class Permutation:
    """Keyed permutations of strings, one for each purpose and for the alphabets of their places."""

    def __init__(self, key: bytes):
        self.key = key

    def number(self, purpose: str, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b("\x00".join(map(str, (purpose, *parts))).encode(), key=self.key[:64], digest_size=32).digest(), "big")

    def string(self, text: str, alphabets: str | list[str], purpose: str, fits: Callable[[str], bool] = lambda s: True) -> str:
        """The image of text; walked on while it doesn't fit, so those that fit are permuted among themselves, in one cycle."""
        each = [alphabets] * len(text) if isinstance(alphabets, str) else alphabets
        n, half = len(text), len(text) // 2
        low, high = math.prod(map(len, each[:half])), math.prod(map(len, each[half:]))
        name = f"{purpose}\x01{n}\x01{hash_of(tuple(each))}"
        rounds = [(r, side) for r in range(5) for side in (0, 1)]

        def feistel(a: int, b: int, back: bool) -> tuple[int, int]:
            for r, side in reversed(rounds) if back else rounds:
                step = self.number(name, r, side, a if side else b) * (-1 if back else 1)
                a, b = (a, (b + step) % high) if side else ((a + step) % low, b)
            return a, b

        def read(chars: str, alphabets: list[str]) -> int:
            out = 0
            for c, al in zip(chars, alphabets):
                out = out * len(al) + al.index(c)
            return out

        def write(value: int, alphabets: list[str]) -> str:
            out = []
            for al in reversed(alphabets):
                value, at = divmod(value, len(al))
                out.append(al[at])
            return "".join(reversed(out))

        a, b = feistel(read(text[:half], each[:half]), read(text[half:], each[half:]), False)
        while True:
            at = (a * high + b + 1) % (low * high)
            a, b = divmod(at, high)
            x, y = feistel(a, b, True)
            if fits(new := write(x, each[:half]) + write(y, each[half:])):
                return new

    def choice(self, item: str, among: list[str], purpose: str) -> str:
        """The next of the items in a keyed order, after the last the first: a cycle through all."""
        order = sorted(among, key=lambda x: self.number(purpose, x))
        return order[(order.index(item) + 1) % len(order)]


@cache
def hash_of(alphabets: tuple[str, ...]) -> str:
    return hashlib.blake2b("\x00".join(alphabets).encode(), digest_size=16).hexdigest()


@cache
def letters_like(c: str) -> str:
    """Small letters of the same kind as a small letter or one without case: its alphabet, or those of its stretch of 64 code points."""
    if c in LOWER:
        return LOWER
    start = 0xC0 if 0xC0 <= ord(c) < 0x180 else ord(c) & ~63
    stop = 0x180 if start == 0xC0 else start + 64
    kind = unicodedata.category(c)
    found = "".join(x for x in map(chr, range(start, stop)) if unicodedata.category(x) == kind and x.lower() == x and x.upper().lower() == x and len(x.upper()) == 1 and (x.upper() == x) == (c.upper() == c))
    return found if c in found else c


def script_of(word: str) -> str:
    return "latin" if all(ord(c) < 0x250 for c in word) else "cyrillic" if all(0x400 <= ord(c) < 0x530 for c in word) else ""


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def _refill(pattern: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in pattern)


def _class_of_ip(parts: list[int]) -> str:
    a, b = parts[:2]
    return "private" if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168) else "local" if a in (0, 127) or a >= 224 or (a == 169 and b == 254) else "public"


class Surrogates:
    def __init__(self, key: str):
        self.p = Permutation(key.encode())

    def _mixed(self, text: str, purpose: str) -> str:
        """Letters and digits each permuted among themselves; marks stay, and so does the case of each place."""
        low = text.lower()
        letters, digits = "".join(c for c in low if c in LOWER), "".join(c for c in low if c in DIGITS)
        shape = re.sub("[a-z]", "a", re.sub("[0-9]", "0", low))
        new = {"a": iter(self.p.string(letters, LOWER, purpose + "a" + shape) if letters else ""), "0": iter(self.p.string(digits, DIGITS, purpose + "0" + shape + letters) if digits else "")}
        out = [next(new[s]) if s in new else c for s, c in zip(shape, low)]
        return "".join(o.upper() if c.isupper() else o for o, c in zip(out, text))

    def word(self, text: str, role: str) -> str:
        """Letters of the same kinds at each place, then the ending of the role (f, m or surname), so that roles share no surrogate.

        Scripts without such endings have one permutation for all roles.
        """
        low = text.lower()
        low = low if len(low) == len(text) else text
        ending = ENDINGS.get((script_of(low), role), "")
        new = self.p.string(low, [letters_like(c) for c in low], "word" + ending) + ending
        return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for n, c in zip(new, text + "x" * len(ending)))

    def name(self, word: str, what: str, gender: str = "") -> str:
        """A listed name becomes one of the same script and gender. Other given names have the gender of their title, else that of their ending."""
        if word in _ALL_GIVEN:
            script, own = _ALL_GIVEN[word]
            return self.p.choice(word, GIVEN[script, own], script + own)
        if what == "given":
            what = gender or ("f" if word.lower().endswith(("a", "e", "i", "y", "а", "я")) else "m")
        return self.word(word, what)

    def email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        return self._mixed(local, "local") + "@" + ".".join([*(self._mixed(x, "label") for x in labels[:-1]), labels[-1]])

    def ip(self, text: str) -> str:
        if ":" in text:  # the last 64 bits of a given address, and all but its kind's prefix
            bits = f"{int(ipaddress.IPv6Address(text)):0128b}"
            head = 10 if bits.startswith("1111111010") else 7 if bits.startswith("1111110") else 3 if bits.startswith("001") else 8
            fits = lambda s: not (head == 8 and (bits[:8] + s).startswith(("1111111010", "1111110", "001")))
            return str(ipaddress.IPv6Address(int(bits[:head] + self.p.string(bits[head:], "01", "ip6" + bits[:head], fits), 2)))
        bits = "".join(f"{int(x):08b}" for x in text.split("."))
        parts = lambda s: [int(s[i : i + 8], 2) for i in range(0, 32, 8)]
        kind = _class_of_ip(parts(bits))
        return ".".join(map(str, parts(self.p.string(bits, "01", "ip", lambda s: _class_of_ip(parts(s)) == kind))))

    def card(self, text: str) -> str:
        digits = re.sub(r"\D", "", text)
        body = digits[0] + self.p.string(digits[1:-1], DIGITS, "card" + digits[0])
        return _refill(text, next(body + d for d in DIGITS if luhn(body + d)))

    def iban(self, text: str) -> str:
        body = self._mixed(text[4:], "iban" + text[:2]).upper()
        return f"{text[:2]}{98 - _iban_number(text[:2] + '00' + body) % 97:02d}{body}"

    def ssn(self, text: str) -> str:
        fine = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        digits = text.replace("-", "")
        return _refill(text, self.p.string(digits, DIGITS, "ssn", fine if fine(digits) else lambda s: not fine(s)))

    def phone(self, text: str) -> str:
        """The number behind the country's code is permuted, so that it is the same with the code and without."""
        head, national = phone_parts(text)
        start = national[0] in "01"
        new = self.p.string(national, DIGITS, "phone", lambda s: (s[0] in "01") == start)
        left = iter(re.sub(r"\D", "", head) + new)
        return "".join(next(left) if c.isdigit() else c for c in text)


def phone_parts(text: str) -> tuple[str, str]:
    """(country's code with +, or empty; national digits). Eleven digits that begin with 1 have the code 1."""
    digits = re.sub(r"\D", "", text)
    if m := re.match(r"\+(\d{1,3})(?=\D)", text):
        return "+" + m.group(1), digits[len(m.group(1)) :]
    if text.startswith("+"):
        n = 1 if digits[0] in "17" else 2
        return "+" + digits[:n], digits[n:]
    return ("+1", digits[1:]) if len(digits) == 11 and digits[0] == "1" else ("", digits)


def entities(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, str, list[tuple[str, int, int, str]]]]:
    """(start, end, kind, parts), leftmost first, none overlapping; earlier kinds win.

    parts are (given or surname, start, end, gender) for names, empty for other kinds. Names don't hold their titles. A given
    name or surname that is found once is found wherever it stands as a word, spelt alike.
    """
    taken: list[tuple[int, int, str, list]] = []
    known: dict[str, str] = {}  # given names with the gender a title gives them
    surnames: set[str] = set()
    for kind in kinds:
        for m in _COMPILED[kind].finditer(text):
            found = m.group()
            if kind == "card" and not luhn(re.sub(r"\D", "", found)):
                continue
            if kind == "iban" and _iban_number(found) % 97 != 1:
                continue
            if kind == "ip" and ":" in found and not _is_ipv6(found):
                continue
            parts = []
            if kind == "name":
                gender = _GENDER.get(m.group("title") or "", "")
                for k in "1234":
                    if m.group("s" + k):
                        if k != "1" and (g := f"g{k}") and m.group(g):
                            parts.append(["given", *m.span(g), ""])
                        elif k == "1" and m.group("g1"):
                            parts.append(["given", *m.span("g1"), gender])
                        lone = k == "1" and not m.group("g1") and m.group("s1") in _ALL_GIVEN
                        parts.append(["given" if lone else "surname", *m.span("s" + k), gender])
                for what, a, b, g in parts:
                    if what == "given":
                        known[text[a:b]] = known.get(text[a:b]) or g
                    else:
                        surnames.add(text[a:b])
            taken.append((parts[0][1] if parts else m.start(), parts[-1][2] if parts else m.end(), kind, parts))
    if known or surnames:
        for m in _WORD.finditer(text):
            word = m.group()
            if word in known or word in surnames:
                taken.append((m.start(), m.end(), "name", [["given" if word in known else "surname", m.start(), m.end(), ""]]))
    taken.sort(key=lambda e: (e[0], KINDS.index(e[2]), -e[1]))
    out, end = [], 0
    for start, stop, kind, parts in taken:
        if start < end:
            continue
        for p in parts:
            if p[0] == "given":
                p[3] = known.get(text[p[1] : p[2]], "")
        if kind == "name" and out and out[-1][2] == "name" and len(parts) == 1 and text[out[-1][1] : start] in (" ", "\u00a0") and len(out[-1][3]) == 1 and out[-1][3][0][0] == "given" and parts[0][0] == "surname":
            out[-1] = (out[-1][0], stop, "name", out[-1][3] + parts)  # a given name and a surname that are known stand side by side
        else:
            out.append((start, stop, kind, parts))
        end = stop
    return out


def _is_ipv6(text: str) -> bool:
    """An address with two groups or more and a digit; :: alone, or letters around it as in code, is none."""
    if sum(map(bool, text.split(":"))) < 2 or not any(c.isdigit() for c in text):
        return False
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def canonical(kind: str, found: str) -> str:
    """What must be equal for two mentions to mean one entity."""
    if kind == "email":
        return found.lower()
    if kind == "phone":
        head, national = phone_parts(found)
        return national if head == "+1" or not head else head + national
    if kind == "ip" and ":" in found:
        return str(ipaddress.IPv6Address(found))
    return re.sub(r"\D", "", found) if kind in ("card", "ssn") else " ".join(found.split()) if kind == "name" else found


def rewrite(text: str | None, made: Surrogates, kinds: tuple[str, ...] = KINDS) -> tuple[str, list[tuple[str, int, int, str, str]]]:
    """(text with surrogates, spans): spans hold kind, start and end in the given text, canonical entity and canonical surrogate."""
    text = text or ""
    out, spans, at = [], [], 0
    for start, end, kind, parts in entities(text, kinds):
        if kind == "name":
            new, here = "", start
            for what, a, b, gender in parts:
                new += text[here:a] + made.name(text[a:b], what, gender)
                here = b
        else:
            new = getattr(made, kind)(text[start:end])
        out += [text[at:start], new]
        spans.append((kind, start, end, canonical(kind, text[start:end]), canonical(kind, new)))
        at = end
    return "".join([*out, text[at:]]), spans


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, spans array<struct<kind, start, end, entity, surrogate>>.

    Null and empty texts give an empty text without spans. Repeated rows stay and get equal texts.
    Other columns are not read; an empty table gives an empty one. There is no shuffle.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entity", pa.string()), ("surrogate", pa.string())]))
    names = ("kind", "start", "end", "entity", "surrogate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for b in batches:
            text = pc.fill_null(b.column("text"), "")
            likely = {k: pc.match_substring_regex(text, p).to_pylist() for k, p in _LIKELY.items()}
            done = [rewrite(t.as_py(), made, tuple(k for k in KINDS if likely[k][i])) for i, t in enumerate(text)]
            spans = pa.array([[dict(zip(names, s)) for s in spans] for _, spans in done], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t for t, _ in done], pa.string()), spans], ["doc_id", "text", "spans"])

    out = "doc_id long, text string, spans array<struct<kind:string,start:long,end:long,entity:string,surrogate:string>>"
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def collisions(rewritten: DataFrame) -> DataFrame:
    """(kind, surrogate, entities): surrogates of more than one entity over all of surrogates()' rows; none is right."""
    spans = rewritten.select(F.explode("spans").alias("s")).select("s.kind", "s.entity", "s.surrogate").distinct()
    return spans.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).filter("entities > 1")


def split_entities(rewritten: DataFrame) -> DataFrame:
    """(kind, entity, surrogates): entities with more than one surrogate: names in no list to which titles give different genders."""
    spans = rewritten.select(F.explode("spans").alias("s")).select("s.kind", "s.entity", "s.surrogate").distinct()
    return spans.groupBy("kind", "entity").agg(F.count("*").alias("surrogates")).filter("surrogates > 1")
