"""Surrogates for personal data: every detected entity is replaced by a keyed one of its own type, format, script and gender.

Entities are taken from the whole corpus first, made canonical (so that two spellings of one phone number are one entity) and
given surrogates by a keyed hash. Then it is checked that no surrogate was given twice and that none is itself an entity of the
corpus; those that fail are hashed again until none fails. One entity therefore has one surrogate wherever it occurs, and two
have two. The documents are rewritten with that table; those without entities are never shuffled.
"""

from __future__ import annotations

import bisect
import hmac
import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import texts, written

KEY = b"weft surrogate key 1"
#: Symbols that junk text puts between the parts of one value.
JUNK = r"[^\w\s]{0,4}"
GAP = rf"{JUNK}[ .-]?"
EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
IPV4 = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
#: Candidates; ipaddress says which are addresses.
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
PLAIN_PHONE = re.compile(r"(?<![\w.+-])(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}(?![\w-]|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d]|\.\d)")
PHONE = re.compile(rf"(?<![\w.])(?:(?:\+\d{{1,3}}{GAP})?\(\d{{3}}\){GAP}\d{{3}}[ .-]?\d{{4}}(?!\d)|(?:\+\d{{1,3}}{GAP}\(\d{{1,4}}\){GAP}|\+\d{{1,3}}{GAP}|\(\d{{3}}\){GAP})\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}(?![\w]|\.\d))")
#: Forms of address, by the gender that they tell.
TITLES = {"m": ["Mr", "Sir", "Herr", "Señor", "Sr", "Don", "Monsieur", "г-н", "господин", "κύριος"], "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Srta", "Doña", "Madame", "Mme", "Mlle", "Mademoiselle", "г-жа", "госпожа", "κυρία"], "n": ["Dr", "Prof", "Professor", "Mx"]}
GENDER = {t: g for g, ts in TITLES.items() for t in ts}
NAME = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
WORD = re.compile(rf"(?<!\w){NAME}(?!\w)")
PERSON = re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, GENDER), key=len, reverse=True))})\.? ({NAME})(?: ({NAME}))?(?: ({NAME}))?(?!\w)")
FIRST = {
    ("latin", "m"): "Adam Bruno Carlos David Emil Felix Gaspar Hugo Ivan Jonas Karl Leo Marco Nils Oscar Paul Robin Simon Thomas Viktor".split(),
    ("latin", "f"): "Anna Berta Clara Diana Elena Flora Greta Helena Irene Julia Karla Lena Marta Nora Olga Paula Rosa Sara Tina Vera".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Кира Лариса Марина Нина Ольга Полина Раиса Софья".split(),
    ("greek", "m"): "Ανδρέας Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λευτέρης Μάριος Νίκος Παύλος Σταύρος".split(),
    ("greek", "f"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Ηρώ Κατερίνα Μαρία Νίκη Πηνελόπη Σοφία".split(),
}
SYLLABLES = {"latin": "ba bel cor da den fal gar hol in jan kel lo mar nes or pa quin ros sel tan ul ver win xan yor zel".split(), "cyrillic": "ба вел гор да ден жар зал кор ла мар нес ол па рос сел тан ул фед хор чер".split(), "greek": "βα γελ δα θορ κα λεν μαρ νες ολ πα ρος σελ ταν φορ χαρ".split()}


def script(word: str) -> str:
    name = unicodedata.name(next((c for c in word if c.isalpha()), "a"), "")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


def digits(s: str) -> str:
    return "".join(c for c in s if c.isdecimal())


def luhn(number: str) -> int:
    """The check sum; 0 where the last digit is right."""
    return sum(n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(map(int, reversed(number)))) % 10


def fold(s: str) -> str:
    return unicodedata.normalize("NFC", s).casefold()


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of the entities of a text, in order, none within another; where two overlap, the
    kind named first in this function wins."""
    if not text:
        return []
    got: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    named: dict[str, str] = {}
    bare: list[tuple[int, int, str, str]] = []

    def add(a, b, kind, value):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            got.append((a, b, kind, value))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(*m.span(), "email", fold(m[0].strip(".+-")) if m[0][0] not in ".+-" else fold(m[0]))
    if any(map(text.__contains__, "0123456789")):
        for m in IPV4.finditer(text):
            add(*m.span(), "ip", ".".join(str(int(x)) for x in m[0].split(".")))
        for m in IPV6.finditer(text):
            try:
                address = ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            # a lone "::" or "a::b" of letters is code more often than an address
            if any(map(str.isdecimal, m[0])):
                add(*m.span(), "ipv6", address.exploded)
        for m in SSN.finditer(text):
            add(*m.span(), "ssn", digits(m[0]))
        for m in IBAN.finditer(text):
            add(*m.span(), "iban", m[0].replace(" ", ""))
        for m in PHONE.finditer(text):
            add(*m.span(), "phone", digits(m[0]))
        for m in CARD.finditer(text):
            add(*m.span(), "card", digits(m[0]))
        for m in PLAIN_PHONE.finditer(text):
            add(*m.span(), "phone", digits(m[0]))
    for m in PERSON.finditer(text):
        names = [k for k in (2, 3, 4) if m[k] and (m[k][0].isupper() or m[k].isupper())]
        if not names or names[0] != 2:
            continue
        names = names[: next((i for i, k in enumerate(names) if k != i + 2), len(names))]
        for k in names:
            kind = "last" if k == names[-1] else f"first_{GENDER[m[1]]}"
            name = m[k][:-2] if m[k][-2:] in ("'s", "’s") and len(m[k]) > 3 else m[k]
            kind = f"{kind}_{script(name)}"
            add(m.start(k), m.start(k) + len(name), kind, fold(name))
            named.setdefault(fold(name), kind)
    if named:  # the same names without a form of address
        for m in WORD.finditer(text):
            if m[0][0].isupper() and (kind := named.get(value := fold(m[0]))):
                bare.append((*m.span(), kind, value))
            elif m[0][0].isupper() and m[0][-2:-1] in ("'", "’") and m[0][-1] in "sS" and (kind := named.get(value := fold(m[0][:-2]))):
                bare.append((m.start(), m.end() - 2, kind, value))
        taken.sort()
        starts = [a for a, _ in taken]
        for a, b, kind, value in bare:
            i = bisect.bisect_left(starts, b)
            if not i or taken[i - 1][1] <= a:
                got.append((a, b, kind, value))
    return sorted(got)


class Stream:
    """A stream of numbers from a keyed hash of an entity."""

    def __init__(self, key: bytes, *what):
        self.key, self.what, self.n, self.rest = key, repr(what).encode("utf-8", "surrogatepass"), 0, 0

    def below(self, n: int) -> int:
        if self.rest < 1 << 64:
            self.n += 1
            self.rest = self.rest << 256 | int.from_bytes(hmac.digest(self.key, self.what + self.n.to_bytes(4, "big"), "sha256"), "big")
        self.rest, got = divmod(self.rest, n)
        return got


def like(s: str, r: Stream) -> str:
    """Random characters of the same classes: digits for digits, lower-case letters of the script for letters."""
    alphabet = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
    return "".join(str(r.below(10)) if c.isdecimal() else (x := alphabet[script(c)])[r.below(len(x))] if c.isalpha() else c for c in s)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """A canonical surrogate; attempts differ, and beyond the eighth grow longer, so that no format can run out of them."""
    r, more = Stream(key, kind, value, attempt), max(0, attempt - 8)
    tail = "".join(str(r.below(10)) for _ in range(more))
    if kind == "email":
        local, _, domain = value.partition("@")
        domain, _, top = domain.rpartition(".")
        return f"{like(local, r)}{tail}@{like(domain, r)}.{top}"
    if kind == "ip":
        return f"{1 + r.below(223)}.{r.below(256)}.{r.below(256)}.{1 + r.below(254)}" + (f".{tail}" if tail else "")
    if kind == "ipv6":
        return ":".join(f"{r.below(1 << 16):04x}" for _ in range(8)) + (f":{tail}" if tail else "")
    if kind in ("phone", "ssn"):
        keep = value[: max(0, len(value) - 10)] if kind == "phone" else ""  # the country code
        return keep + str(2 + r.below(8)) + like(value[len(keep) + 1 :], r) + tail
    if kind == "card":
        body = value[:1] + like(value[1:], r) + tail
        return next(body[:-1] + str(c) for c in range(10) if luhn(body[:-1] + str(c)) == 0) if luhn(value) == 0 else body
    if kind == "iban":
        body = value[:2] + "00" + "".join(str(r.below(10)) if c.isdigit() else chr(65 + r.below(26)) for c in value[4:]) + tail
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        return f"{body[:2]}{check:02d}{body[4:]}"
    what, *gender, alphabet = kind.split("_")
    parts = SYLLABLES[alphabet]
    if what == "first" and attempt < 4:
        names = FIRST[alphabet, gender[0]] if gender[0] != "n" else FIRST[alphabet, "m"] + FIRST[alphabet, "f"]
        return fold(names[r.below(len(names))])
    return "".join(parts[r.below(len(parts))] for _ in range(3 + attempt // 2)) + ({"f": {"latin": "a", "cyrillic": "а", "greek": "α"}[alphabet]}.get(gender[0], "") if what == "first" else "")


def in_format(original: str, kind: str, value: str, new: str) -> str:
    """A canonical surrogate in the format of one occurrence: its separators, its upper and lower case."""
    if kind in ("phone", "ssn", "card", "iban"):
        left = iter(new)
        out = "".join(next(left, "") if c.isalnum() else c for c in original)
        return out + "".join(left)
    if original.isupper():
        return new.upper()
    if kind == "email":
        return new
    return new[:1].upper() + new[1:] if original[:1].isupper() else new


def replace(text: str, given: dict[tuple[str, str], str]) -> tuple[str, int]:
    out, at, n = [], 0, 0
    for a, b, kind, value in entities(text):
        out += [text[at:a], in_format(text[a:b], kind, value, given[kind, value])]
        at, n = b, n + 1
    return "".join([*out, text[at:]]), n


def assign(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, value, surrogate) for distinct entities (kind, value): keyed, distinct within a kind, none of them a value of it.

    A surrogate given to several goes to the least value; the others, and those whose surrogate is a value of the corpus, are
    hashed again with the next attempt. Each round is a shuffle of what failed the one before."""

    def make(attempt):
        def run(batches):
            for batch in batches:
                new = [surrogate(key, k, v, attempt) for k, v in zip(batch["kind"].to_pylist(), batch["value"].to_pylist())]
                yield pa.record_batch([batch["kind"], batch["value"], pa.array(new, pa.string())], ["kind", "value", "surrogate"])

        return run

    schema = "kind string, value string, surrogate string"
    values = found.select("kind", F.col("value").alias("surrogate"), F.lit(0).alias("old"))
    done, todo, attempt = None, found.select("kind", "value"), 0
    while True:
        new = todo.mapInArrow(make(attempt), schema)
        claims = new.select("*", F.lit(1).alias("rank")).unionByName(values.select("kind", F.lit(None).cast("string").alias("value"), "surrogate", F.lit(0).alias("rank")))
        if done is not None:
            claims = claims.unionByName(done.select("kind", F.lit(None).cast("string").alias("value"), "surrogate", F.lit(0).alias("rank")))
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("rank", "value"))
        judged = written(claims.withColumn("first", first).where("rank = 1").select("kind", "value", "surrogate", (F.col("first") == 1).alias("good")), "surrogates")
        good = judged.where("good").select("kind", "value", "surrogate")
        done = good if done is None else done.unionByName(good)
        todo = judged.where("not good").select("kind", "value")
        if todo.isEmpty():
            return done
        attempt += 1


def surrogates(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(doc_id, text, n_replaced) for every row of docs: text with all entities replaced.

    Null texts stay null, with 0 replaced, and empty ones empty. Repeated rows are replaced alike, null doc_ids stay, an empty
    table gives an empty one; columns other than doc_id and text aren't read. Equal texts share their rewriting table.
    """

    def extract(batches):
        for batch in batches:
            keep, out = [], []
            for i, text in enumerate(batch["text"]):
                if own := {(k, v) for _, _, k, v in entities(text.as_py())}:
                    keep.append(i)
                    out.append([{"kind": k, "value": v} for k, v in sorted(own)])
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([some["doc_id"], some["text"], pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))], ["doc_id", "text", "found"])

    def without(batches):
        for batch in batches:
            none = [not entities(text.as_py()) for text in batch["text"]]
            yield batch.filter(pa.array(none, pa.bool_()))

    def rewrite(batches):
        for batch in batches:
            new, n = [], []
            for text, given in zip(batch["text"], batch["given"].to_pylist()):
                t, k = replace(text.as_py(), {(g["kind"], g["value"]): g["surrogate"] for g in given})
                new.append(t)
                n.append(k)
            yield pa.record_batch([batch["doc_id"], pa.array(new, pa.string()), pa.array(n, pa.int32())], ["doc_id", "text", "n_replaced"])

    docs = texts(docs)
    some = written(docs.mapInArrow(extract, "doc_id bigint, text string, found array<struct<kind:string,value:string>>"), "entities").withColumn("mark", F.md5(F.col("text").cast("binary")))
    found = some.select("mark", F.explode("found").alias("e")).select("mark", "e.*").distinct()
    table = assign(found.select("kind", "value").distinct(), key)
    given = found.join(table, ["kind", "value"]).groupBy("mark").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("given"))
    changed = some.join(given, "mark").select("doc_id", "text", "given").mapInArrow(rewrite, "doc_id bigint, text string, n_replaced int")
    same = docs.mapInArrow(without, docs.schema).select("doc_id", "text", F.lit(0).alias("n_replaced"))
    return changed.unionByName(same)
