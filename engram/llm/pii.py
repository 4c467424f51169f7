"""Personal data and secrets replaced by keyed surrogates.

A detected entity is brought to a canonical form (an email without case, a phone or card number without
separators), and a keyed permutation of all strings of its shape gives the surrogate: letters become letters of the
same script and case, digits digits, a Luhn-valid number stays valid, an IP address an address, a listed first name one
of the same gender and script. The permutation maps different values of one shape to different surrogates, wherever in
the corpus they stand, without any shared table: equal values agree (coreference) and different ones stay
different (distinctness). It is a keyed shuffle of the shape's strings in which each gives way to the next, so no value stays itself.
``collisions`` verifies distinctness over the whole corpus, by a grouped count of all entities; where it failed, the next key would be tried.

Persons are found after titles and phrases of introduction, and as a listed first name before a capitalised word. In scripts
without case a person has at most two words, in Han at most three characters.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common

ROUNDS = 8
#: Keys tried in turn where two values share a surrogate.
TRIES = 4
DIGIT, HEX = "0123456789", "0123456789abcdef"
#: The letters of scripts, those with case in both.
LETTERS = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह"]
ACCENTED = "άέήίόύώ"
CLASSES = [DIGIT, *LETTERS, ACCENTED, *(x.upper() for x in [*LETTERS[:3], ACCENTED])]
#: Vowels and consonants of names.
NAME_CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
#: Titles before a name, phrases before a name, and first names by gender and script.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra", "Monsieur", "Madame", "Mme", "г-н", "г-жа", "господин", "госпожа", "κ", "κα", "κύριος", "κυρία", "Δρ", "السيد", "السيدة", "الدكتور", "מר", "גברת", "श्री", "श्रीमती", "डॉ"]
PHRASES = ["my name is", "I am called", "full name:", "signed by", "mein Name ist", "ich heiße", "je m'appelle", "je m’appelle", "mon nom est", "me llamo", "mi nombre es", "меня зовут", "με λένε", "το όνομά μου είναι", "اسمي", "שמי", "मेरा नाम", "我叫", "我的名字是", "私の名前は"]
FIRST = {
    ("m", "latin"): ["Adam", "Alexander", "Andrew", "Anthony", "Benjamin", "Bob", "Brian", "Bruno", "Carl", "Charles", "Christopher", "Daniel", "David", "Edward", "Emil", "Felix", "Francesco", "Frank", "Georg", "George", "Hans", "Henry", "Hugo", "Ivan", "Jack", "James", "John", "Jonas", "José", "Joseph", "Juan", "Karl", "Kevin", "Klaus", "Leo", "Louis", "Lucas", "Luis", "Mark", "Martin", "Matthew", "Michael", "Miguel", "Mohammed", "Noah", "Oliver", "Oscar", "Patrick", "Paul", "Pedro", "Peter", "Pierre", "Richard", "Robert", "Simon", "Stefan", "Stephen", "Thomas", "Victor", "William", "Wolfgang"],
    ("f", "latin"): ["Alice", "Amelia", "Anna", "Barbara", "Beatrice", "Carmen", "Charlotte", "Clara", "Claudia", "Diana", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Fatima", "Flora", "Greta", "Hannah", "Helen", "Helga", "Ingrid", "Irene", "Isabel", "Jane", "Jennifer", "Jessica", "Julia", "Karen", "Katharina", "Klara", "Laura", "Linda", "Lisa", "Lucia", "Margaret", "Maria", "Marie", "Mary", "Monika", "Nancy", "Nina", "Olga", "Olivia", "Patricia", "Paula", "Rosa", "Sandra", "Sara", "Sarah", "Sofia", "Sophie", "Susan", "Teresa", "Ursula", "Vera"],
    ("u", "latin"): ["Alex", "Andrea", "Chris", "Jordan", "Kim", "Morgan", "Pat", "Robin", "Sam", "Sascha", "Taylor"],
    ("m", "cyrillic"): ["Алексей", "Андрей", "Борис", "Виктор", "Григорий", "Дмитрий", "Егор", "Иван", "Кирилл", "Михаил", "Николай", "Олег", "Пётр", "Сергей"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("m", "greek"): ["Αλέξανδρος", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Παύλος"],
    ("f", "greek"): ["Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
    ("m", "arabic"): ["أحمد", "حسن", "خالد", "علي", "عمر", "محمد", "يوسف"],
    ("f", "arabic"): ["آمنة", "خديجة", "زينب", "عائشة", "فاطمة", "مريم"],
    ("m", "hebrew"): ["אברהם", "דוד", "יוסף", "יעקב", "משה"],
    ("f", "hebrew"): ["אסתר", "לאה", "מרים", "רחל", "שרה"],
    ("m", "devanagari"): ["अमित", "राज", "राम", "विजय", "संजय"],
    ("f", "devanagari"): ["अनीता", "गीता", "प्रिया", "मीना", "सीता"],
}
LISTS = {name: names for names in FIRST.values() for name in names}
#: The country codes of two digits; those from 1 and 7 have one, all others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

#: Last letters that mark a first name's gender.
GENDERED = "aoаяαηςة"
CASED = r"\p{Lu}[\p{L}\p{M}]*(?:[-'’]\p{L}[\p{L}\p{M}]+)*"
UNCASED = r"(?!\p{Han})\p{Lo}[\p{L}\p{M}]*"
PERSON = rf"(?P<v>\p{{Han}}{{2,3}}|{CASED}(?: {CASED}){{0,2}}|{UNCASED}(?: {UNCASED})?)"
DETECTORS: list[tuple[str, str, re.Pattern]] = [
    # type, what a text must contain (empty: anything), pattern; group "v", if any, is the entity
    ("SECRET", "=:", re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?(?P<v>[A-Za-z0-9_+/.-]{8,})")),
    ("KEY", "AKIA", re.compile(r"\bAKIA(?P<v>[A-Z0-9]{16})\b")),
    ("EMAIL", "@", regex.compile(r"[\w.%+-]+@[\p{L}\p{M}\p{N}-]+(?:\.[\p{L}\p{M}\p{N}-]+)*\.\p{L}[\p{L}\p{M}]+")),
    ("IBAN", "0123456789", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")),
    ("SSN", "-", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("IP", ".", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")),
    ("IP6", ":", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:])")),
    ("PHONE", "+(-. /", re.compile(r"(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)|(?<![\w.,-])(?<!\d )(?:\d{3} \d{3} \d{4}|0\d{2,4}[ /-]\d{5,8})(?![\w,-]| \d|\.\d)")),
    ("CARD", "0123456789", re.compile(r"(?<![\w+.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)")),
    ("PERSON", "", regex.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(TITLES, key=len, reverse=True)))})\b\.? {PERSON}")),
    ("PERSON", "", regex.compile(rf"(?<!(?!\p{{Han}})\p{{L}})(?i:{'|'.join(map(re.escape, sorted(PHRASES, key=len, reverse=True)))}) ?{PERSON}")),
    ("NAMED", "", regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?:{'|'.join(map(re.escape, sorted(LISTS, key=len, reverse=True)))})(?: \p{{Lu}}\.)? {CASED}")),
]
HAS_DIGIT = re.compile(r"[0-9]")
NEED_DIGIT = {"IBAN", "SSN", "IP", "PHONE", "CARD"}


@lru_cache(maxsize=None)
def _triggers() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Titles and first names with what must follow them, and phrases in lower case: a text with none of these has no person to find."""
    out = []
    for words in ([w + end for w in TITLES for end in (" ", ". ")] + [n + " " for n in LISTS], [p.lower() for p in PHRASES]):
        found = ahocorasick.Automaton()
        for w in words:
            found.add_word(w, w)
        found.make_automaton()
        out.append(found)
    return out[0], out[1]


def persons_possible(text: str) -> bool:
    names, phrases = _triggers()
    return next(names.iter(text), None) is not None or next(phrases.iter(text.lower()), None) is not None


def _address(value: str) -> bool:
    try:
        return ipaddress.IPv6Address(value).packed[2:] != bytes(14) and HAS_DIGIT.search(value) is not None and len(value.replace(":", "")) > 3
    except ValueError:
        return False


def detect(text: str) -> list[tuple[int, int, str]]:
    """Entities that don't overlap, by place: start, end, type. The earlier detector wins a place."""
    found = []
    digits, persons = bool(HAS_DIGIT.search(text)), persons_possible(text)
    for rank, (kind, needs, pattern) in enumerate(DETECTORS):
        if kind in NEED_DIGIT and not digits or kind in ("PERSON", "NAMED") and not persons or needs and not (needs in text if kind == "KEY" else any(c in text for c in needs)):
            continue
        for m in pattern.finditer(text):
            v = "v" if "v" in pattern.groupindex else 0
            if kind != "IP6" or _address(m[0]):
                found.append((rank, m.start(v), m.end(v), "PERSON" if kind == "NAMED" else kind))
    taken: list[tuple[int, int, str]] = []
    covered: list[tuple[int, int]] = []  # of detectors that came before, by place
    for _, s, e, kind in sorted(found):
        at = bisect(covered, (s, e))
        if (at == 0 or covered[at - 1][1] <= s) and (at == len(covered) or covered[at][0] >= e):
            covered.insert(at, (s, e))
            taken.append((s, e, kind))
    return sorted(taken)


@lru_cache(maxsize=None)
def alphabet(c: str) -> str:
    """The characters that may stand for a letter or digit: those of a fixed class, else the letters of its script, category and block of
    256 code points that are in no fixed class. Each of them has the same alphabet. Anything else stands alone."""
    for letters in CLASSES:
        if c in letters:
            return letters
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return c
    script = unicodedata.name(c, "").split(" ")[0]
    block = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(block, block + 256)) if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script and not any(x in y for y in CLASSES))


def _feistel(numbers: list[int], sizes: list[int], shape: str, key: bytes, back: bool) -> list[int]:
    """A keyed permutation of the pairs of numbers below ``sizes``: each is shifted in turn by a keyed hash of the other."""
    numbers = [*numbers]
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        side = r % 2
        mac = hmac.new(key, f"{shape}|{r}|{numbers[1 - side]}".encode(), hashlib.sha512).digest()
        by = int.from_bytes(hashlib.shake_256(mac).digest(-(-sizes[side].bit_length() // 8) + 16), "big")
        numbers[side] = (numbers[side] + (-by if back else by)) % sizes[side]
    return numbers


def permute(value: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """A keyed permutation without fixed points of the strings with these alphabets: the place of a string in a keyed shuffle is
    found, and the string at the next place is taken. Where only one string is possible it stays."""
    free = [i for i, a in enumerate(alphabets) if len(a) > 1]
    if not free:
        return value
    halves = free[: len(free) // 2], free[len(free) // 2 :]
    shape = f"{tweak}|{'|'.join(alphabets[i] if len(alphabets[i]) > 1 else '-' + alphabets[i] for i in range(len(value)))}"
    numbers, sizes = [], []
    for half in halves:
        n, size = 0, 1
        for i in half:
            n, size = n * len(alphabets[i]) + alphabets[i].index(value[i]), size * len(alphabets[i])
        numbers.append(n), sizes.append(size)
    numbers = _feistel(numbers, sizes, shape, key, False)
    place = (numbers[0] * sizes[1] + numbers[1] + 1) % (sizes[0] * sizes[1])
    numbers = _feistel([*divmod(place, sizes[1])], sizes, shape, key, True)
    out = list(value)
    for half, n in zip(halves, numbers):
        for i in reversed(half):
            n, x = divmod(n, len(alphabets[i]))
            out[i] = alphabets[i][x]
    return "".join(out)


def luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def number(digits: str, kept: int, key: bytes, tweak: str, check: bool) -> str:
    """Digits with the first ``kept`` unchanged; with ``check`` the last digit keeps the Luhn sum."""
    body = digits[:-1] if check else digits
    body = permute(body, [c if i < kept else DIGIT for i, c in enumerate(body)], key, tweak)
    if not check:
        return body
    return next(x for d in DIGIT if luhn(x := body + d) == luhn(digits))


def spread(value: str, digits: str) -> str:
    """New digits in the places of the old ones."""
    it = iter(digits)
    return "".join(next(it) if c in DIGIT else c for c in value)


def recased(value: str, like: str) -> str:
    return "".join(v.upper() if c.isupper() else v for v, c in zip(value, like))


def name_word(word: str, key: bytes, ending: str = "") -> str:
    """A name that is not listed: a word of the same shape that is not listed either, vowels for vowels and consonants for consonants of
    the same script; a last letter of ``ending`` stays. A listed name moves within the list of its gender and script, in a keyed order."""
    if names := LISTS.get(word):
        order = sorted(names, key=lambda n: hmac.new(key, f"first|{n}".encode(), hashlib.sha256).digest())
        return order[(order.index(word) + 1) % len(order)]
    low = word.lower() if len(word.lower()) == len(word) and word.lower().upper() == word.upper() else word
    alphabets = [next((s for s in NAME_CLASSES if c in s), None) or alphabet(c) for c in low]
    if low[-1:] in ending and len(low) > 1:
        alphabets[-1] = low[-1]
    out = low
    while True:
        out = permute(out, alphabets, key, "name")
        new = recased(out, word) if low is not word else out
        if new not in LISTS:
            return new


def canonical(value: str, kind: str) -> str:
    if kind in ("PHONE", "CARD", "SSN", "IBAN"):
        return re.sub(r"[^0-9A-Za-z+]", "", value)
    if kind == "IP6":
        return ipaddress.IPv6Address(value).exploded
    return value.lower() if kind == "EMAIL" and len(value.lower()) == len(value) else value


@lru_cache(maxsize=50_000)
def surrogate(value: str, kind: str, key: bytes) -> str:
    """The replacement of an entity; it depends on the canonical form alone, the writing on the value."""
    core = canonical(value, kind)
    if kind == "EMAIL":
        local, _, domain = core.rpartition("@")
        host, _, top = domain.rpartition(".")
        whole = f"{local}@{host}"
        new = permute(whole, [alphabet(c) for c in whole], key, kind) + "." + top
        return recased(new, value) if core != value else new
    if kind == "IP":
        parts = [int(p) for p in core.split(".")]
        sets = ["".join(map(chr, range(1, 224))) if 0 < parts[0] < 224 else chr(parts[0]), *["".join(map(chr, range(256)))] * 3]
        return ".".join(str(ord(c)) for c in permute("".join(map(chr, parts)), sets, key, kind))
    if kind == "IP6":
        groups = ipaddress.IPv6Address(value).exploded.split(":")
        low = permute("".join(groups[1:]), [HEX] * 28, key, kind + groups[0])
        return ":".join([groups[0], *(low[i : i + 4] for i in range(0, 28, 4))])
    if kind == "PHONE":
        digits = core.lstrip("+")
        kept = (1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3) if core[0] == "+" else int(digits[0] == "0")
        return spread(value, number(digits, kept, key, kind + core[0] * (core[0] == "+"), False))
    if kind == "CARD":
        return spread(value, number(core, 1, key, kind, True))
    if kind == "SSN":
        return spread(value, number(core, 0, key, kind, False))
    if kind == "IBAN":
        body = permute(core[4:], [alphabet(c) for c in core[4:]], key, kind)
        sum97 = lambda b, check: int("".join(str(int(c, 36)) for c in b + core[:2] + check)) % 97
        check = next(f"{n:02d}" for n in range(100) if sum97(body, f"{n:02d}") == sum97(core[4:], core[2:4]))
        it = iter(core[:2] + check + body)
        return "".join(next(it) if c.isalnum() else c for c in value)
    if kind == "PERSON":
        words = core.split(" ")
        return " ".join(name_word(w, key, GENDERED if not i and len(words) > 1 else "") for i, w in enumerate(words))
    if kind == "SECRET" and re.fullmatch("[0-9a-f]+", core):
        return permute(core, [HEX] * len(core), key, kind)
    out = core
    while True:  # what is no hexadecimal string stays none
        out = permute(out, [alphabet(c) for c in core], key, kind)
        if kind != "SECRET" or not re.fullmatch("[0-9a-f]+", out):
            return out


def replaced(text: str, key: bytes, put: Callable = surrogate) -> tuple[str, list[tuple[str, int, str, str]]]:
    """The text with surrogates, and its entities: type, start in the old text, canonical form, surrogate."""
    out, last, entities = [], 0, []
    for s, e, kind in detect(text):
        value = text[s:e]
        new = put(value, kind, key)
        out += [text[last:s], new]
        last = e
        entities.append((kind, s, canonical(value, kind), canonical(new, kind)))
    return ("".join([*out, text[last:]]) if entities else text), entities


def entity_table(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """All entities of the corpus as keyed digests, one row for each document and value: kind, original, surrogate."""
    common.small_batches(docs.sparkSession)

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = lambda x: int.from_bytes(hmac.new(key, x.encode(), hashlib.sha256).digest()[:8], "big", signed=True)
        for b in rows:
            all_of = {(k, mark(k + "|" + old), mark(k + "|" + new)) for t in b.column(0).to_pylist() for k, _, old, new in replaced(t, key)[1]}
            cols = list(zip(*all_of)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["kind", "original", "surrogate"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(scan, "kind string, original long, surrogate long")


def collisions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Surrogates that stand for more than one original, and originals with more than one surrogate: none are expected.

    Counts combine on the map side, so an entity in every document is one row per task.
    """
    pairs = entity_table(docs, key, text_col).distinct()
    one = pairs.groupBy("kind", F.col("surrogate").alias("mark")).agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit("surrogate"))
    two = pairs.groupBy("kind", F.col("original").alias("mark")).agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit("original"))
    return one.unionByName(two).filter("n > 1")


def surrogates(docs: DataFrame, key: bytes, text_col: str = "text", check: bool = True) -> DataFrame:
    """Every row and column of ``docs``, ``text_col`` with surrogates, plus n_entities, n_values and entities (type, start, surrogate).

    Null and empty texts stay as they are, without entities; texts without entities are unchanged; repeated rows get
    equal surrogates; an empty table gives no rows. Columns of ``docs`` named like one of the three are replaced. With ``check``, a first
    pass counts all entities; if two values share a surrogate, the keys derived from this one are tried in turn.
    """
    common.small_batches(docs.sparkSession)
    tries = 0
    while check and (bad := collisions(docs, key, text_col).head(1)):
        key, tries = hmac.new(key, b"next", hashlib.sha256).digest(), tries + 1
        if tries == TRIES:
            raise ValueError(f"two values of kind {bad[0].kind} share a surrogate under each of {TRIES} keys")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"n_entities", "n_values", "entities"}])
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == text_col.lower())
    names = [*docs.columns, "n_entities", "n_values", "entities"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_entities long, n_values long, entities array<struct<type:string,start:int,surrogate:string>>"
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("surrogate", pa.string())]))

    def replace(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            texts, all_of = [], []
            for t in b.column(at).to_pylist():
                new, found = replaced(t, key) if t else (t, [])
                texts.append(new), all_of.append(found)
            cols = [*b.columns, pa.array([len(x) for x in all_of], pa.int64()), pa.array([len({(k, c) for k, _, c, _ in x}) for x in all_of], pa.int64()), pa.array([[{"type": k, "start": s, "surrogate": n} for k, s, _, n in x] for x in all_of], kind)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(replace, types)
