"""Personal data replaced by keyed surrogates of the same kind.

Entities: e-mail addresses, phone numbers, payment cards (Luhn), IBANs (mod 97), IPv4 and IPv6 addresses, social security numbers, secrets
(assigned tokens, common key formats) and persons. A person is a known given name and a capitalised surname of any script, one or two
capitalised words after a title, or two after words that introduce a name; once a person is found in a text, the given name and the
surname alone count there too and get the same part of the surrogate. Names without such a context are not found.

A surrogate is a keyed permutation of the entity's own shape: letters become letters of the same alphabet, class and case, digits digits;
check digits are computed anew, country codes, top-level domains and name particles stay, a known given name becomes one of the same
gender and script. A permutation maps different entities of one shape to different surrogates, and equal ones to the same in every document
(coreference). Still each distinct surrogate is checked against all surrogates and all entities of the corpus; those that collide are
permuted again until none does. Every ``TURNS`` attempts the shape grows by a letter or digit (but for addresses and numbers of fixed
length, whose space exceeds any corpus), so this ends also where all values of a shape occur.

Each text is searched once; the texts with what was found are a durable table. Only documents with entities are shuffled; their entities
are joined to the table of distinct entities (hot ones split by AQE).

Defined cases: null text stays null; texts without entities come back as they are; very long texts are rewritten whole; repeated rows are each
rewritten alike; rows that share an id are told apart; an empty table gives no rows; a null doc_id is kept; overlapping finds: the first
wins; columns to carry come back unchanged.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import durable

TURNS = 8
KEY = "spark.tidewatch.pii.key"

# Given names by gender and script.
GIVEN = {
    ("f", "latin"): "Aisha Alice Amina Anna Carla Carmen Chiara Clara Diana Elena Elizabeth Emily Emma Eva Fatima Giulia Greta Hannah Ines Ingrid Jennifer Jessica Julia Karen Laura Leila Linda Lucía Lucy Maria María Marie Mary Nora Olivia Patricia Paula Sara Sarah Sofia Sofía Susan Zoe".split(),
    ("m", "latin"): "Adam Ahmed Alexander Ali Andrew Bruno Carlos Charles Daniel David Diego Erik Felix François George Giovanni Hans Henry Hugo Ibrahim Ivan James Jean John Jonas José Juan Jürgen Karl Lars Lucas Luis Marco Martin Matthew Michael Mohammed Omar Oscar Paul Pedro Peter Robert Stefan Thomas William".split(),
    ("f", "cyrillic"): "Анастасия Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Нина Ольга Светлана Софья Татьяна Юлия".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Владимир Дмитрий Иван Михаил Николай Олег Павел Пётр Сергей Фёдор Юрий".split(),
}
# Titles, words that introduce a name, particles of surnames.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame Mme Signor Signora господин госпожа г-н г-жа".split()
INTRODUCED = ["my name is", "My name is", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "mi nombre es", "Mi nombre es", "меня зовут", "Меня зовут"]
PARTICLES = "von der|van der|van den|de la|de los|von|van|del|de|di|da|dos|bin|ibn|al|el".split("|")
# Letters that stand for each other.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "аеиоуыэюяё", "бвгджзклмнпрстфхцчшщйъь"]
_CLASS = {c: (k, i) for k, letters in enumerate(CLASSES) for i, c in enumerate(letters)}
_NAMES = {name: (kind, i) for kind, names in GIVEN.items() for i, name in enumerate(names)}

EMAIL = r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@]))"
IBAN = r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
PHONE = r"(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w.-]*\d))"
SSN = r"(?P<ssn>(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-]))"
IP = r"(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
IPV6 = r"(?P<ipv6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]))"
CARD = r"(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d))"
SECRET = r"(?P<secret>(?:(?<=AKIA)|(?<=ghp_)|(?<=sk-))[A-Za-z0-9]{16,}|(?i:(?<![a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key))[\"']?\s*[:=]\s*[\"']?(?P<value>[A-Za-z0-9_\-+/]{12,}))"
FOUND = re.compile("|".join([SECRET, EMAIL, IBAN, PHONE, SSN, IP, IPV6, CARD]))
_NAME = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]+(?:['’-]\p{Lu}?[\p{L}\p{M}]+)*"
_SURNAME = rf"(?:(?:{'|'.join(PARTICLES)})\s)?{_NAME}"
_GIVEN = "|".join(sorted(_NAMES, key=len, reverse=True))
PERSON = regex.compile(
    rf"(?<!\w)(?:(?:{_GIVEN})\s{_SURNAME}|(?:{'|'.join(map(re.escape, TITLES))})\.?\s(?P<titled>(?:{_NAME}\s)?{_SURNAME})"
    rf"|(?:{'|'.join(map(re.escape, INTRODUCED))})\s(?P<introduced>{_NAME}\s{_SURNAME}))(?!\w)"
)
# what a text must have to hold an entity, from quick to slow
DIGIT = re.compile(r"[0-9@]").search
WORDS = ("token", "secret", "passw", "key")


@cache
def _hints() -> ahocorasick.Automaton:
    hints = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for word in [*_NAMES, *TITLES, *INTRODUCED]:
        hints.add_word(word)
    hints.make_automaton()
    return hints


def hinted(text: str) -> bool:
    if DIGIT(text):
        return True
    low = text.lower()
    return any(w in low for w in WORDS)


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def valid(kind: str, text: str) -> bool:
    if kind == "card":
        return luhn(re.sub(r"\D", "", text))
    if kind == "iban":
        return mod97(text.replace(" ", "")) == 1
    if kind == "ip":
        return all(int(x) < 256 for x in text.split("."))
    if kind == "ipv6":
        try:
            return text.count(":") >= 3 and ipaddress.IPv6Address(text) is not None
        except ValueError:
            return False
    if kind == "phone":
        return 7 <= len(re.sub(r"\D", "", text)) <= 16
    return True


def plain_form(kind: str, found: str) -> str:
    """The entity behind a find: the same however it is cased or spaced, but for secrets and persons."""
    if kind == "phone" and found[0] == "+":  # the country code stays
        code = re.match(r"\+(\d{1,3})(?=\D)|\+(1|7|\d\d)", found)[0]
        return f"{code} {re.sub(r'[^0-9]', '', found[len(code) :])}"
    if kind == "email":
        return found.lower()
    if kind == "ipv6":
        return ipaddress.IPv6Address(found).exploded
    if kind == "person":
        return " ".join(found.split())
    return found if kind in ("secret", "ip") else re.sub(r"[ ().+-]", "", found)


def persons(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, part, entity) of persons and, past the first find, of their given names and surnames alone."""
    if next(_hints().iter(text), None) is None:
        return []
    full, own = [], {}
    for m in PERSON.finditer(text):
        start, end = m.span("titled") if m.group("titled") else m.span("introduced") if m.group("introduced") else m.span()
        full.append((start, end, "", plain_form("person", text[start:end])))
    several = [f for f in full if " " in f[3]]
    for f in several:
        words = f[3].split()
        own.setdefault(words[0], []).append((f, "given"))
        own.setdefault(words[-1], []).append((f, "surname"))
    if not own:
        return full
    # a title and a surname: of a person named in full, if there is one
    full = [f for f in full if " " in f[3] or f[3] not in own]
    taken = [(a, b) for a, b, *_ in full]
    for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(own, key=len, reverse=True)))})(?!\w)", text):
        if not any(a < m.end() and m.start() < b for a, b in taken):
            # the last one named before, else the first
            before = [x for x in own[m[0]] if x[0][0] < m.start()]
            person, part = before[-1] if before else own[m[0]][0]
            full.append((m.start(), m.end(), part, person[3]))
    return full


def entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, part, entity) from left to right, without overlaps; part: which part of a person, else empty."""
    out = []
    for m in FOUND.finditer(text) if hinted(text) else ():
        kind = "secret" if m.lastgroup == "value" else m.lastgroup
        start, end = m.span("value") if m.group("value") else m.span()
        if valid(kind, text[start:end]):
            out.append((start, end, kind, "", plain_form(kind, text[start:end])))
    named = persons(text)
    if not named:
        return out
    out = sorted(out + [(a, b, "person", part, entity) for a, b, part, entity in named])
    kept, at = [], 0
    for e in out:
        if e[0] >= at:
            kept.append(e)
            at = e[1]
    return kept


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network, walked until it lands inside."""
    half = max(1, -(-(size - 1).bit_length() // 2)) if size > 1 else 1
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for r in range(8):
            raw = hmac.digest(key, f"{tweak}|{size}|{r}|{b}".encode(), hashlib.sha256)
            stream = b"".join(hashlib.sha256(raw + bytes([i])).digest() for i in range(half // 256)) + raw
            a, b = b, a ^ (int.from_bytes(stream, "big") & mask)
        value = a << half | b
        if value < size:
            return value


@cache
def letters_of(c: str) -> tuple[str, str] | None:
    """(class, its letters) of a lower-case letter or digit: one of CLASSES, or else the letters of its 64 code points."""
    if c in _CLASS:
        k = _CLASS[c][0]
        return str(k), CLASSES[k]
    if not c.isalpha():
        return None
    base = ord(c) & ~63
    same = "".join(x for x in map(chr, range(base, base + 64)) if x.isalpha() and x not in _CLASS and x.lower() == x and len(x.upper()) == 1 and x.upper().lower() == x)
    return (f"u{base:x}", same) if c in same else None


def reshape(text: str, key: bytes, tweak: str, alphabet: str | None = None) -> str:
    """Letters and digits permuted within their classes (or within one alphabet), as one mixed-radix number; the rest stays."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    if alphabet:
        spots = [(k, "x", alphabet) for k, c in enumerate(low) if c in alphabet]
    else:
        spots = [(k, *found) for k, c in enumerate(low) if (found := letters_of(c))]
    value, size, shape = 0, 1, list(low)
    for k, name, letters in spots:
        value, size = value * len(letters) + letters.index(low[k]), size * len(letters)
        shape[k] = name
    value = permute(value, size, key, f"{tweak}|{''.join(shape)}")
    out = list(text)
    for k, _, letters in reversed(spots):
        value, digit = divmod(value, len(letters))
        out[k] = letters[digit].upper() if text[k] != low[k] else letters[digit]
    return "".join(out)


def surrogate(kind: str, entity: str, key: bytes, turn: int = 0) -> str:
    """Of the entity's plain form; turn > 0: permuted again, and every TURNS turns of a longer shape."""
    longer = turn // TURNS
    if kind == "person":
        entity += "a" * longer
    elif kind == "email":
        entity = "a" * longer + entity
    elif kind in ("phone", "secret"):
        entity += "0" * longer
    for _ in range(turn + 1):
        if kind == "email":
            head, _, top = entity.rpartition(".")
            entity = f"{reshape(head, key, kind)}.{top}"
        elif kind == "phone" and entity[0] == "+":
            code, _, rest = entity.partition(" ")
            entity = f"{code} {reshape(rest, key, f'{kind}|{code}')}"
        elif kind == "card":
            body = entity[0] + reshape(entity[1:-1], key, f"{kind}|{entity[0]}")
            entity = next(body + d for d in "0123456789" if luhn(body + d))
        elif kind == "iban":
            body = entity[:2] + "00" + reshape(entity[4:], key, f"{kind}|{entity[:2]}")
            entity = f"{body[:2]}{98 - mod97(body):02d}{body[4:]}"
        elif kind == "ip":
            a, b, c, d = map(int, entity.split("."))
            v = permute((a * 256 + b) * 65536 + c * 256 + d, 1 << 32, key, kind)
            entity = ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
        elif kind == "ipv6":
            entity = ipaddress.IPv6Address(permute(int(ipaddress.IPv6Address(entity)), 1 << 128, key, kind)).exploded
        elif kind == "secret":
            same = entity.lower()
            entity = reshape(entity, key, kind, "0123456789abcdef" if re.fullmatch("[0-9a-f]+", same) and entity in (same, entity.upper()) else None)
        elif kind == "person":
            *given, surname = entity.split(" ")
            if given and given[0] in _NAMES:
                group, i = _NAMES[given[0]]
                given[0] = GIVEN[group][permute(i, len(GIVEN[group]), key, f"given|{group}")]
            elif given:
                given[0] = reshape(given[0], key, "given")
            entity = " ".join([*given, reshape(surname, key, "surname")])
        else:
            entity = reshape(entity, key, kind)
    return entity


def dress(found: str, kind: str, part: str, new: str) -> str:
    """The surrogate in the format of the text found: its separators and its case."""
    if kind in ("secret", "ip"):
        return new
    if kind == "ipv6":
        new = ipaddress.IPv6Address(new)
        new = new.compressed if "::" in found or len(found) < 39 else new.exploded
        return new.upper() if found.isupper() else new
    if kind == "person":
        if part:
            return new.split(" ")[0 if part == "given" else -1]
        gaps = iter(re.findall(r"\s+", found))
        return re.sub(" ", lambda _: next(gaps), new)
    if kind == "email":
        if found.isupper() or found.islower():
            return new.upper() if found.isupper() else new
        more = len(new) - len(found)
        return new[:more] + "".join(c.upper() if o.isupper() else c for c, o in zip(new[more:], found, strict=True))
    chars = iter(re.sub(r"[+ ]", "", new))
    return "".join(next(chars) if c not in " ().+-" else c for c in found) + "".join(chars)


def _key(key: str) -> bytes:
    return hashlib.sha256(key.encode()).digest()


def session_key(spark: SparkSession) -> str:
    """The key that the session's settings name; where there is none, a random one is set for the session, which nothing stores."""
    found = spark.conf.get(KEY, None)
    if not found:
        import secrets

        found = secrets.token_hex(32)
        spark.conf.set(KEY, found)
    return found


def surrogates(occurring: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, entity) with surrogate: attempts go on until no surrogate equals another one or an entity."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            new = [surrogate(k, e, _key(key), t) for k, e, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new, pa.string())], names=["kind", "entity", "turn", "surrogate"])

    schema = "kind string, entity string, turn int, surrogate string"
    known = occurring.select("kind", "entity").distinct()
    done = durable(known.withColumn("turn", F.lit(0)).select("kind", "entity", "turn").mapInArrow(run, schema), "surrogates")
    while True:
        taken = done.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        use = done.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("first"))
        bad = use.join(taken, ["kind", "surrogate"], "left").where("n > 1 OR real")
        if bad.isEmpty():
            return done
        marked = done.join(bad.select("kind", "surrogate", "first", "real"), ["kind", "surrogate"], "left")
        again = F.col("real").isNotNull() | (F.col("first").isNotNull() & (F.col("first") != F.col("entity")))
        done = durable(marked.select("kind", "entity", (F.col("turn") + again.cast("int")).alias("turn")).mapInArrow(run, schema), "surrogates")


def pseudonymise(docs: DataFrame, key: str, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text, n_entities, kinds (the kinds found, sorted, comma-separated) and the columns to carry."""
    import pyarrow as pa

    carry = carry or []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"carry{k}") for k, c in enumerate(carry)))
    fields = ("start", "stop", "kind", "part", "entity")
    spans = "array<struct<start:int,stop:int,kind:string,part:string,entity:string>>"
    kind = pa.list_(pa.struct([(f, pa.int32() if f in ("start", "stop") else pa.string()) for f in fields]))
    listing = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)

    def detect(batches: Iterator) -> Iterator:
        for batch in batches:
            found = [[dict(zip(fields, e, strict=True)) for e in entities(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "found"])

    searched = durable(base.mapInArrow(detect, f"{listing}, found {spans}"), "searched")
    held = durable(searched.where(F.size("found") > 0).withColumn("row", F.expr("uuid()")), "entities")
    occurring = held.select("row", F.explode("found").alias("f")).select("row", "f.*")
    named = occurring.join(surrogates(occurring, key), ["kind", "entity"])
    by_row = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind", "part", "surrogate"))).alias("new"))
    full = held.join(by_row, "row").select(*base.columns, "new")

    def rewrite(batches: Iterator) -> Iterator:
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text, new in zip(batch.column(1).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                parts, at = [], 0
                for s in new:
                    parts += [text[at : s["start"]], dress(text[s["start"] : s["stop"]], s["kind"], s["part"], s["surrogate"])]
                    at = s["stop"]
                texts.append("".join([*parts, text[at:]]))
                counts.append(len(new))
                kinds.append(",".join(sorted({s["kind"] for s in new})))
            columns = [batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:-1], pa.array(counts, pa.int64()), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_entities", "kinds"])

    changed = full.mapInArrow(rewrite, f"{listing}, n_entities long, kinds string")
    plain = searched.where(F.size("found") == 0).drop("found").withColumns({"n_entities": F.lit(0).cast("long"), "kinds": F.lit("")})
    return changed.unionByName(plain).withColumnsRenamed({f"carry{k}": c for k, c in enumerate(carry)})
