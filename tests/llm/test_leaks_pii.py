"""Decontamination against brute force; personal data by planted entities."""

import random
import re
from collections import Counter

from tidewatch.llm import decontamination, pii


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = tokens(text)
        for i, item in items:
            q = tokens(item)
            k = min(5, len(q))
            if not q or len(w) < k:
                continue
            want = grams(q, k)
            for s in range(max(1, len(w) - len(q) + 1)):
                have = grams(w[s : s + len(q)], k)
                if sum((have & want).values()) >= 0.8 * sum((have | want).values()):
                    out.add((d, i))
    return out


def test_leaks(spark, documents):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 8, 15, 30, 60])))) for i in range(40)] + [(90, None), (91, ""), (92, "One two, three four five six seven eight nine ten!")]
    rows = []
    for d in range(160):
        parts = [word() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.7:
            inside = tokens(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if inside:
                    at = rng.randrange(len(inside))
                    inside[at : at + rng.choice([0, 1])] = [word()] if rng.random() < 0.7 else []
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = inside[rng.choice([0, 0, 1]) :]
        rows.append((d, rng.choice([" ", "\n", ", "]).join(parts).title()))
    rows += [(500, None), (501, ""), (502, "ONE!! TWO!! THREE!! FOUR!! FIVE!! SIX!! SEVEN!! EIGHT!! NINE!! TEN!!"), (503, "one two three four five six seven eight nine"), (None, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(documents(rows), bench).collect()
    want = brute(rows, items)
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(got) > 40 and all(r.similarity >= 0.8 for r in got)
    kept = decontamination.without_leaks(documents(rows), bench)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in rows if d not in {x for x, _ in want})
    assert kept.columns == documents(rows).columns
    assert decontamination.leaks(documents([]), bench).count() == 0 and decontamination.leaks(documents(rows), bench.limit(0)).count() == 0


def test_entities_are_replaced_alike_everywhere(spark, documents):
    rows = [
        (1, "Write to Jane.Doe42@mail.example.com or JANE.DOE42@MAIL.EXAMPLE.COM, call +1 (212) 555-0187."),
        (2, "jane.doe42@mail.example.com paid with 4111 1111 1111 1111 and 4111111111111111; 4111111111111112 is none"),
        (3, 'token = "04dbebab91af04dbebab91af04dbebab91af0123" from 10.20.30.40 not 300.1.2.3 nor 1.2.3'),
        (4, "Anna Smith met Anna Jones, Peter Smith and Ольга Петрова; IBAN DE89 3704 0044 0532 0130 00; ssn 123-45-6789"),
        (5, "plain text without anything, year 2020 and 12 eggs"), (6, None), (7, ""), (None, "call +1 (212) 555-0187"), (1, "x@y.example.org"),
    ]
    got = {(r.doc_id, r.kinds): r for r in pii.pseudonymise(documents(rows), "key", carry=["source", "length"]).collect()}
    assert len(got) == len(rows) and {r.length for r in got.values()} == {"x"}
    text = {k[0]: r.text for k, r in got.items() if k != (1, "email")}
    for secret in ("jane", "555-0187", "4111 1111", "1111111111111111", "04dbeb", "10.20.30.40", "Smith", "Anna", "Ольга", "DE89 3704", "123-45-6789"):
        assert not any(secret in (t or "").lower() or secret in (t or "") for t in text.values()), secret
    a, b = re.findall(r"\S+@\S+[a-zA-Z]", text[1])
    assert a.lower() == b.lower() and b.isupper() and re.search(r"\S+@\S+[a-z]", text[2])[0] == a.lower() and a[:4].istitle() and a[4] == "."
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", text[1])[0]
    assert text[None] == f"call {phone}"
    spaced, plain, invalid = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", text[2])
    assert spaced.replace(" ", "") == plain and pii.luhn(plain) and plain[0] == "4" and invalid == "4111111111111112"
    assert re.search(r'^token = "[0-9a-f]{40}" from \d+\.\d+\.\d+\.\d+ not 300.1.2.3 nor 1.2.3$', text[3])
    people = re.match(r"(\w+) (\w+) met (\w+) (\w+), (\w+) (\w+) and (\w+) (\w+);", text[4]).groups()
    assert people[0] == people[2] in pii.GIVEN["f", "latin"] and people[1] == people[5] != people[3] and people[4] in pii.GIVEN["m", "latin"] and people[6] in pii.GIVEN["f", "cyrillic"]
    assert pii.mod97(re.search(r"IBAN (.+?);", text[4])[1].replace(" ", "")) == 1
    assert (text[5], text[6], text[7]) == (rows[4][1], None, "")
    assert pii.pseudonymise(documents([]), "key").count() == 0


def test_permutation_and_collisions(spark):
    for size in (1, 2, 7, 100, 1000):
        assert sorted(pii.permute(i, size, b"k", "t") for i in range(size)) == list(range(size))
    # all four-letter strings of one shape are taken: every surrogate is an entity, until turns run out of them
    rows = [("ssn", f"{i:03d}-45-6789") for i in range(100, 400)]
    out = pii.surrogates(spark.createDataFrame(rows, "kind string, entity string"), "key").collect()
    new = [r.surrogate for r in out]
    assert len(set(new)) == 300 and not set(new) & {r[1] for r in rows}


def test_persons_of_any_script_and_their_parts():
    found = lambda t: [(t[a:b], part, e) for a, b, kind, part, e in pii.entities(t) if kind == "person"]
    assert found("Anna Müller called.") == [("Anna Müller", "", "Anna Müller")]
    assert found("John O'Brien, José de la Cruz, Mohammed Ali and Иван Соловьёв-Чёрный") == [(x, "", x) for x in ("John O'Brien", "José de la Cruz", "Mohammed Ali", "Иван Соловьёв-Чёрный")]
    assert found("Anna Smith met Peter\nSmith. Later Smith and Anna left") == [("Anna Smith", "", "Anna Smith"), ("Peter\nSmith", "", "Peter Smith"), ("Smith", "surname", "Peter Smith"), ("Anna", "given", "Anna Smith")]
    assert found("Dr. Kowalczyk saw Frau Inés Ōtani; my name is Zainab Okafor") == [("Kowalczyk", "", "Kowalczyk"), ("Inés Ōtani", "", "Inés Ōtani"), ("Zainab Okafor", "", "Zainab Okafor")]
    assert found("Dr. Smith and Anna Smith") == [("Smith", "surname", "Anna Smith"), ("Anna Smith", "", "Anna Smith")]
    assert found("Ines, to. The paul smith of Annapolis Smith") == [] and found("Maria is here") == []
    key = pii._key("key")
    for name in ("Anna Müller", "José de la Cruz", "Иван Соловьёв", "Wei Żółć"):
        new = pii.surrogate("person", name, key)
        assert [w.istitle() or w in ("de", "la") for w in new.split()] == [True] * len(name.split()) and len(new.split()[-1]) == len(name.split()[-1])
        assert all(a != b for a, b in zip(new.split()[-1:], name.split()[-1:], strict=True))
        if " de la " in name:
            assert " de la " in new
    assert [e[2] for e in pii.entities("from 2001:db8::ff00:42:8329, std::vector, 12:30:45 and 2001:0DB8:0000:0000:0000:FF00:0042:8329")] == ["ipv6", "ipv6"]


def test_rewriting_against_known_spans(spark, documents):
    """Texts put together from plain parts and entities: plain parts stay to the letter, entities get one surrogate each, no two the same."""
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    letters = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    known = {f"{letters(6)}.{letters(4)}@{letters(5)}.example": "email" for _ in range(60)}
    known |= {f"+49 {digits(3)} {digits(7)}": "phone" for _ in range(40)} | {f"10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}": "ip" for _ in range(40)}
    known |= {f"{g} {letters(5).title()}": "person" for g in ("Anna", "Hugo", "Ольга") for _ in range(20)}
    plain = ["nothing here, ", "only words\n", "ß and 漢字 too; ", "the year 1999 and ", "x" * 50_000 + " "]
    rows, parts = [], []
    for d in range(60):
        own = [rng.choice(plain if k % 2 == 0 else list(known)) for k in range(rng.randrange(1, 12))]
        rows.append((d // 2, "".join(p if k % 2 == 0 else f"<{p}>" for k, p in enumerate(own))))
        parts.append(own)
    new: dict[str, set] = {}
    got = {}
    for r in pii.pseudonymise(documents(rows), "key").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_entities))
    for k, ((doc, text), own) in enumerate(zip(rows, parts, strict=True)):
        pattern = "".join(re.escape(p) if i % 2 == 0 else "<(.+?)>" for i, p in enumerate(own))
        fits = [m for t, n in got[doc] if n == len(own) // 2 and (m := re.fullmatch(pattern, t, re.S))]
        assert fits, text[:200]
        if len(got[doc]) == 2 and rows[k ^ 1][1] != text and len(fits) == 1:
            for e, s in zip(own[1::2], fits[0].groups(), strict=True):
                new.setdefault(e, set()).add(s)
    assert len(new) > 80 and all(len(s) == 1 for s in new.values())
    flat = [next(iter(s)) for s in new.values()]
    assert len(set(flat)) == len(flat) and not set(flat) & set(known)


def test_attempts_end_where_every_value_of_a_shape_occurs(spark):
    rows = [("person", f"{g} {a}{b}") for g in pii.GIVEN["m", "cyrillic"] for a in "ЛР" for b in "аеи"] + [("person", x + y) for x in "BCDFGHJKLMNPQRSTVWXYZ" for y in "aeiou"]
    out = pii.surrogates(spark.createDataFrame(rows, "kind string, entity string"), "key").collect()
    assert len({r.surrogate for r in out}) == len(rows) and not {r.surrogate for r in out} & {e for _, e in rows}


def test_key_of_the_session(spark):
    spark.conf.unset(pii.KEY)
    assert pii.session_key(spark) == pii.session_key(spark) == spark.conf.get(pii.KEY)
    spark.conf.unset(pii.KEY)
