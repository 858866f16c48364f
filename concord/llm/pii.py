"""Personal data: what is found gets a keyed surrogate of its own kind, script, gender and format."""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import batch_of, durable, sliced

#: Forms of address and the gender they state.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m",
    "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f",
    "Dr": "", "Prof": "", "господин": "m", "госпожа": "f",
}
#: Given names by script and gender, for surrogates and for telling the gender of a name.
GIVEN = {
    ("latin", "m"): ("James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Kevin Hans Karl Peter Jürgen Pierre Jean Louis Carlos José Luis Miguel Antonio").split(),
    ("latin", "f"): ("Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Lisa Betty Dorothy Sandra Ashley Emily Donna Michelle Anna Greta Ursula Heidi Marie Claire Sophie María Carmen Lucía Elena Isabel").split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел Олег Юрий".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Вера Нина".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης Χρήστος Βασίλης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
}
GENDER = {name: gender for (_, gender), names in GIVEN.items() for name in names}

#: Letters that stand for one another, by script and case. Letters and digits in none of them have their neighbours (``class_of``).
ALPHABETS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
CLASS_OF = {c: alphabet for alphabet in ALPHABETS for c in alphabet}
CJK, HANGUL = "".join(map(chr, range(0x4E00, 0xA000))), "".join(map(chr, range(0xAC00, 0xD7A4)))


@lru_cache(1)
def neighbours() -> dict[str, str]:
    """All other letters and digits by runs of 128 code points and category; those alone in theirs are one class together."""
    groups: dict[tuple[int, str], list[str]] = {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if c.isalnum() and c not in CLASS_OF and not "一" <= c <= "\u9fff" and not "가" <= c <= "힣":
            groups.setdefault((ord(c) >> 7, unicodedata.category(c)), []).append(c)
    alone = "".join(g[0] for g in groups.values() if len(g) == 1)
    return {c: alphabet for g in groups.values() for alphabet in ["".join(g) if len(g) > 1 else alone] for c in g}


def class_of(c: str) -> str | None:
    """The characters that ``c`` is permuted among; None for marks and spaces."""
    if (found := CLASS_OF.get(c)) or c < "\x80":
        return found
    return CJK if "一" <= c <= "\u9fff" else HANGUL if "가" <= c <= "힣" else neighbours().get(c)


HEX = {c: a for a in ("0123456789abcdef", "0123456789ABCDEF") for c in a}

NAME_PART = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)*"
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[^\W_][\w.+%-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![A-Za-z0-9_-])"),
    "secret": re.compile(r"(?i:\b(?:token|api[_-]?key|secret(?:[_-]key)?|access[_-]?key|passw(?:or)?d|auth[_-]?token)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?)([A-Za-z0-9_+/=.-]{12,})"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\d.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?![\d-])"),
    "phone": re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?![\w-])|(?<![\w+])\(\d{3}\) ?\d{3}-\d{4}(?![\w-])|(?<![\w.+-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"),
    "name": re.compile(r"(?<!\w)(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + rf")\.? ({NAME_PART}(?: {NAME_PART}){{0,2}})"),
}
#: Words that may be part of a name, and where a possessive ends one.
NAME_WORD, POSSESSIVE = re.compile(rf"(?<!\w){NAME_PART}"), re.compile(r"['’]s(?= |$)")
#: A text without any of these characters, or without the words, holds nothing of the kind.
HINTS = {"email": "@", "phone": "-+.", "ip": ".", "ssn": "-"}
DIGITS, TITLE_HINT, SECRET_HINT = re.compile(r"\d{2}|\d\.\d"), re.compile("|".join(TITLES)), re.compile(r"(?i)token|key|secret|passw")


def luhn(digits: list[int]) -> int:
    """What the check digit of ``digits`` must be."""
    return -sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10


def iban_check(bban: str, country: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97


def is_real(kind: str, value: str) -> bool:
    """Whether a card or account number has the check digits that all real ones have."""
    if kind == "card":
        digits = [int(c) for c in value if c.isdigit()]
        return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits[:-1]) == digits[-1]
    if kind == "iban":
        plain = value.replace(" ", "")
        return 15 <= len(plain) <= 34 and int(plain[2:4]) == iban_check(plain[4:], plain[:2])
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in value) <= 15
    if kind == "secret":
        return any(c.isdigit() for c in value)
    return True


def hopeful(text: str) -> list[str]:
    """The kinds that a text may hold, by what is quick to tell."""
    digits = DIGITS.search(text) is not None
    return [
        kind for kind in PATTERNS
        if (TITLE_HINT.search(text) if kind == "name" else SECRET_HINT.search(text) if kind == "secret" else (digits or kind == "email") and (kind not in HINTS or any(c in text for c in HINTS[kind])))
    ]


def forms(names: list[tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """How the names of a text may be mentioned in it: whole, by the family, by given names. To kind and detail (see ``find``).

    What is one person's family and another's given name is the family; a given name of several is the first's.
    """
    out = {value: ("name", gender) for value, gender in names}
    for value, gender in names:
        out.setdefault(value.rpartition(" ")[2], ("name", gender))
    for value, gender in names:
        given = value.split(" ")[:-1]
        for i in range(len(given)):
            for j in range(i + 1, len(given) + 1):
                out.setdefault(" ".join(given[i:j]), ("given", f"{gender} {value}"))
    return out


def mentions(text: str, known: dict[str, tuple[str, str]]) -> Iterator[tuple[int, int, str, str]]:
    """Every place where one of ``known`` stands as whole words, the longest of those that begin at a word."""
    words = [m.span() for m in NAME_WORD.finditer(text)]
    for at, (begin, end) in enumerate(words):
        stops: list[int] = []
        for a, b in words[at : at + 3]:
            if stops and text[end:a] != " ":
                break
            # Marks inside a word may end the name too: "Roe's", "Roe-led".
            stops += [*(i for i in range(a, b) if text[i] in "-'’"), b]
            end = b
        for stop in reversed(stops):
            if found := known.get(text[begin:stop]):
                yield begin, stop, *found
                break


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, detail) of what is found in a text, in order and apart.

    A name is introduced by a form of address and then found wherever the text has it, whole or by the family; detail is
    its gender, as the title states it. Given names that stand alone are of kind ``given``, with gender and whole name
    as their detail.
    """
    taken: list[tuple[int, int, str, str]] = []
    for kind in hopeful(text):
        for m in PATTERNS[kind].finditer(text):
            begin, end = m.span(1) if kind in ("secret", "name") else m.span()
            value = text[begin:end]
            if kind == "email":
                end -= len(value) - len(value.rstrip(".-"))
            if kind == "name":
                if owner := POSSESSIVE.search(value):
                    end = begin + owner.start()
                    value = text[begin:end]
                detail = TITLES.get(m[0].split(" ")[0].rstrip("."), "") or GENDER.get(value.split(" ")[0], "")
            else:
                detail = ""
            if is_real(kind, value):
                taken.append((begin, end, kind, detail))
    if named := [(text[a:b], gender) for a, b, kind, gender in taken if kind == "name"]:
        taken.extend(mentions(text, forms(named)))
    out: list[tuple[int, int, str, str]] = []
    for item in sorted(taken, key=lambda x: (x[0], -x[1])):  # what begins first, the longest of those
        if not out or item[0] >= out[-1][1]:
            out.append(item)
    return out


class Surrogates:
    """Keyed replacements. The same value has the same one everywhere; within a format they are a permutation, so no two values share one.

    A value's changeable characters are read as one number, each a digit in the base of its alphabet, and that number is
    permuted among all numbers of the format: a balanced Feistel network over the next even number of bits, walked until
    it lands inside. ``moved`` is one cycle through all of them, so no value is its own surrogate. ``attempt`` picks another
    permutation; for given names it adds a name of the pool every four attempts, so there are always enough.
    """

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.value = lru_cache(200_000)(self._value)

    def draw(self, *parts: object) -> int:
        return int.from_bytes(hmac.new(self.key, repr(parts).encode(), hashlib.sha256).digest(), "big")

    def permuted(self, number: int, size: int, tweak: object, back: bool = False) -> int:
        if size <= 1:
            return number
        half = max(2, (size - 1).bit_length() + 1 >> 1)
        mask = (1 << half) - 1
        while True:
            left, right = number >> half, number & mask
            if back:
                left, right = right, left
            for i in reversed(range(6)) if back else range(6):
                # blocks of 256 bits, for halves longer than one
                pad = 0
                for block in range(-(-half // 256)):
                    pad = pad << 256 | self.draw(tweak, size, i, block, right)
                left, right = right, left ^ (pad & mask)
            if back:
                left, right = right, left
            number = left << half | right
            if number < size:
                return number

    def moved(self, number: int, size: int, tweak: object) -> int:
        """The next of ``number`` in a keyed order of all numbers below ``size``."""
        return self.permuted((self.permuted(number, size, tweak, back=True) + 1) % size, size, tweak)

    def reshaped(self, text: str, tweak: object, classes: dict[str, str] | None = None) -> str:
        """``text`` with every character of an alphabet permuted inside it; all others stay where they are."""
        number, size, among = 0, 1, class_of if classes is None else classes.get
        for c in text:
            if alphabet := among(c):
                number, size = number * len(alphabet) + alphabet.index(c), size * len(alphabet)
        shape = "".join("." if among(c) else c for c in text)
        number, out = self.moved(number, size, (tweak, shape)), []
        for c in reversed(text):
            if alphabet := among(c):
                number, i = divmod(number, len(alphabet))
                c = alphabet[i]
            out.append(c)
        return "".join(reversed(out))

    def _value(self, kind: str, value: str, detail: str = "", attempt: int = 0) -> str:
        tweak = (kind, attempt)
        if kind == "email":
            user, _, host = value.rpartition("@")
            name, _, top = host.rpartition(".")
            return f"{self.reshaped(user, (tweak, 'user'))}@{self.reshaped(name, (tweak, 'host'))}.{top}"
        if kind == "ip":
            number, spans = 0, []
            for part in value.split("."):
                low, size = {1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(part)]
                spans.append((low, size))
                number = number * size + int(part) - low
            total = 1
            for _, size in spans:
                total *= size
            number, out = self.moved(number, total, (tweak, tuple(spans))), []
            for low, size in reversed(spans):
                number, i = divmod(number, size)
                out.append(str(low + i))
            return ".".join(reversed(out))
        if kind == "card":
            *body, check = (i for i, c in enumerate(value) if c.isdigit())
            changed = value[: body[0] + 1] + self.reshaped(value[body[0] + 1 : check], (tweak, value[body[0]]))
            return changed + str(luhn([int(c) for c in changed if c.isdigit()])) + value[check + 1 :]
        if kind == "iban":
            at = [i for i, c in enumerate(value) if c != " "]
            bban = self.reshaped(value[at[3] + 1 :], tweak)
            return f"{value[:2]}{iban_check(bban.replace(' ', ''), value[:2]):02d}{bban}"
        if kind == "secret":
            plain = [c for c in value if c.isalnum()]
            hexed = all(c in "0123456789abcdef" for c in plain) or all(c in "0123456789ABCDEF" for c in plain)
            classes = {c: "0123456789abcdef" if all(x in "0123456789abcdef" for x in plain) else "0123456789ABCDEF" for c in set(plain)} if hexed else None
            return self.reshaped(value, (tweak, hexed), classes)
        if kind == "phone":
            # The country code stays; what follows is permuted.
            code = re.match(r"\+\d{1,3}(?=\D)", value)
            keep = code.end() if code else 0
            return value[:keep] + self.reshaped(value[keep:], (tweak, value[:keep]))
        if kind == "name":
            *given, family = value.split(" ")
            known = (("cyrillic", "Ѐ", "ӿ"), ("greek", "Ͱ", "Ͽ"))
            script = next((x for x, low, high in known if low <= value[0] <= high), "latin" if unicodedata.name(value[0], "").startswith("LATIN") else "")
            out = []
            for part in given:
                if not script:  # no pool: permuted in its own script
                    out.append(self.reshaped(part, (tweak, "given")))
                    continue
                gender = GENDER.get(part) or detail or "mf"[self.draw("gender", part) % 2]
                pool = GIVEN[script, gender]
                i = self.draw(tweak, part) % len(pool)
                more = [pool[self.draw(tweak, part, n) % len(pool)] for n in range(attempt // 4)]
                out.append("-".join([pool[i] if pool[i] != part else pool[(i + 1) % len(pool)], *more]))
            # The family name's permutation does not depend on the attempt: "Mr Roe" stays the same person as "John Roe".
            return " ".join([*out, self.reshaped(family, ("family", attempt if not given else 0))])
        return self.reshaped(value, tweak)

    def apply(self, text: str, attempts: dict[tuple[str, str], tuple[int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with surrogates, and (begin, end, kind) of what they replaced, in the old text."""

        def made(kind: str, value: str, detail: str) -> str:
            attempt, detail = attempts.get((kind, value), (0, detail))  # the corpus's detail, where texts differ
            return self.value(kind, value, detail, attempt)

        found, parts, at = find(text), [], 0
        given = self.given_alone({(text[a:b], detail) for a, b, kind, detail in found if kind == "given"}, made)
        for begin, end, kind, detail in found:
            value = text[begin:end]
            parts += [text[at:begin], given[value] if kind == "given" else made(kind, value, detail)]
            at = end
        return ("".join([*parts, text[at:]]) if found else text), [(a, b, "name" if kind == "given" else kind) for a, b, kind, _ in found]

    def given_alone(self, alone: set[tuple[str, str]], made: Callable[[str, str, str], str]) -> dict[str, str]:
        """Given names of a text to what stands for them: the same words of the whole name's surrogate.

        Where two given names of the text would come out alike, each is written as the whole surrogate, which no two names share.
        """
        short, whole = {}, {}
        for value, detail in alone:
            gender, _, name = detail.partition(" ")
            words, parts = made("name", name, gender).split(" "), name.split(" ")
            n = value.count(" ") + 1
            i = next(i for i in range(len(parts)) if parts[i : i + n] == value.split(" "))
            whole[value], short[value] = " ".join(words), " ".join(words[i : i + n])
        times = Counter(short.values())
        return {value: new if times[new] == 1 and new != value else whole[value] for value, new in short.items()}


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, value, detail, several) of the distinct values of all texts: one of several details keeps the greatest, in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            seen = {(kind, text[a:b], detail) for text in batch.column(0).to_pylist() if text for a, b, kind, detail in find(text) if kind != "given"}
            if seen:
                kinds, values, details = zip(*sorted(seen))
                yield batch_of(kind=list(kinds), value=list(values), detail=list(details))

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, value string, detail string")
    return found.groupBy("kind", "value").agg(F.max("detail").alias("detail"), (F.max("detail") != F.min("detail")).alias("several"))


def collisions(found: DataFrame, key: bytes, most_rounds: int = 64) -> DataFrame:
    """(kind, value, attempt, detail) of the values whose first surrogate was another's too, or their own value, or that have several details.

    Each round counts the values of every surrogate; of those that share one the least value keeps it and the others draw
    again. Rounds go on until no two share one; only the number of the rest reaches the driver.
    """

    def surrogate(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = Surrogates(key)
            for batch in sliced(batches):
                kinds, values, details, attempts = (batch.column(x).to_pylist() for x in ("kind", "value", "detail", "attempt"))
                out = [made.value(*x) for x in zip(kinds, values, details, attempts)]
                yield batch_of(kind=batch.column(0), value=batch.column(1), detail=batch.column(2), several=batch.column(3), attempt=batch.column(4), surrogate=pa.array(out, pa.string()))

        return rows.mapInArrow(run, "kind string, value string, detail string, several boolean, attempt int, surrogate string")

    rows = durable(surrogate(found.select("kind", "value", "detail", "several", F.lit(0).alias("attempt"))))
    for _ in range(most_rounds):
        first = F.min(F.struct(F.col("attempt"), F.col("value")))
        shared = rows.groupBy("kind", "surrogate").agg(first.alias("keeper"), F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("keeper.value") == F.col("surrogate")))
        marked = rows.join(shared, ["kind", "surrogate"], "left")
        own = (F.col("value") == F.col("surrogate")) & F.exists(F.split(F.col("value"), ""), lambda c: c.rlike(r"[\p{L}\p{N}]"))
        again = F.coalesce((F.col("n") > 1) & (F.col("keeper.value") != F.col("value")), F.lit(False)) | own
        marked = durable(marked.select("kind", "value", "detail", "several", "attempt", "surrogate", again.alias("again")))
        if marked.where("again").isEmpty():
            return rows.where("attempt > 0 OR several").select("kind", "value", "attempt", "detail")
        kept = marked.where(~F.col("again")).drop("again")
        rows = durable(kept.unionByName(surrogate(marked.where("again").select("kind", "value", "detail", "several", (F.col("attempt") + 1).alias("attempt")))))
    raise RuntimeError("values outnumber the surrogates of their format")


def surrogates(
    docs: DataFrame, key: bytes, broadcast_most: int = 100_000, id_col: str = "doc_id", text_col: str = "text", keep: bool = False,
) -> DataFrame:
    """(doc_id, text, n_entities, kinds, spans) of every row of ``docs``; with ``keep``, all columns of ``docs``, texts rewritten.

    Found: email and IP addresses, phone numbers, card and account numbers with valid check digits, social security
    numbers, secrets after ``token =`` and the like, names after a form of address and their other mentions in the same text, whole, by
    the family or by given names. Everything else stays as it is, byte
    for byte. A surrogate depends on the key, the kind and the value alone, so a value keeps its surrogate in all
    documents, and a family name its own with and without a given name. ``spans`` tells where in the old text.

    Texts are read twice: once for the distinct values, whose surrogates are checked for collisions over the whole
    corpus, and once to rewrite them. Neither pass moves a text. The few values that drew again or have several details reach the workers by
    broadcast up to ``broadcast_most`` rows, and by a join on the document beyond.

    Null texts stay null without entities, empty ones empty. Repeated rows and ids get a row each. With ``keep``, columns
    of other names pass through whatever they are called. An empty table gives an empty table.
    """
    rows = docs.select(*(docs.columns if keep else [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]))
    text_at = text_col if keep else "text"
    again = durable(collisions(entities(docs, text_col), key))
    n = again.count()
    if n <= broadcast_most:
        shared = docs.sparkSession.sparkContext.broadcast({(r.kind, r.value): (r.attempt, r.detail) for r in again.collect()})
        extra: list[str] = []
    else:
        shared = None

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                got = [(i, k, t[a:b]) for i, t in enumerate(batch.column(1).to_pylist()) if t for a, b, k, _ in find(t) if k != "given"]
                at, kinds, values = zip(*got) if got else ((), (), ())
                yield batch_of(id=batch.column(0).take(pa.array(at, pa.int64())), kind=pa.array(kinds, pa.string()), value=pa.array(values, pa.string()))

        kind_of = docs.schema[id_col].dataType.simpleString()
        pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(held, f"id {kind_of}, kind string, value string")
        lists = pairs.join(again, ["kind", "value"]).groupBy(F.col("id").alias("__id")).agg(F.to_json(F.collect_set(F.array("kind", "value", F.col("attempt").cast("string"), "detail"))).alias("__again"))
        rows = rows.join(lists, F.col(id_col if keep else "doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
        extra = ["__again"]
    fields = [f for f in rows.schema if f.name not in extra]
    added = [] if keep else ["n_entities long", "kinds string", "spans array<struct<begin:int,end:int,kind:string>>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        made, none = Surrogates(key), shared.value if shared else {}
        for batch in sliced(batches):
            texts = batch.column(text_at).to_pylist()
            lists = batch.column("__again").to_pylist() if extra else [None] * len(texts)
            new, spans = [], []
            for text, mine in zip(texts, lists):
                known = {(k, v): (int(a), d) for k, v, a, d in json.loads(mine)} if mine else none
                out, found = made.apply(text, known) if text else (text, [])
                new.append(out)
                spans.append(found)
            columns = {f.name: batch.column(f.name) for f in fields} | {text_at: pa.array(new, pa.string())}
            if not keep:
                columns["n_entities"] = pa.array([len(x) for x in spans], pa.int64())
                columns["kinds"] = pa.array([",".join(sorted({k for _, _, k in x})) for x in spans], pa.string())
                kind = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
                columns["spans"] = pa.array([[{"begin": a, "end": b, "kind": k} for a, b, k in x] for x in spans], pa.list_(kind))
            yield batch_of(**columns)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *added])
    return rows.mapInArrow(run, schema)
