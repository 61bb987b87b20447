"""op1: format, gender, script, coreference, distinctness and collisions."""

import random
import re

import pytest
from sparkfeat.llm import surrogates
from sparkfeat.llm.surrogates import GIVEN, _luhn, canonical, detect, draw_surrogates, permute, pseudonymise, surrogate

KEY = b"k"


def test_detection():
    text = ("Write to Anna.B+c@Mail.example.org or call +1 (663) 555-6869, card 4316522678525456 or 4539 1488 0343 6467, "
            "ssn 123-45-6789, ip 10.0.0.7 and 233.233.171.252. Mrs. Jane Doe met Herr Karl-Heinz Ölmann; Госпожа Анна Петрова. 2.5 and 1234.")
    got = [(k, text[a:b]) for a, b, k, _ in detect(text)]
    assert got == [("email", "Anna.B+c@Mail.example.org"), ("phone", "+1 (663) 555-6869"), ("card", "4316522678525456"),
                   ("card", "4539 1488 0343 6467"), ("ssn", "123-45-6789"), ("ipv4", "10.0.0.7"), ("ipv4", "233.233.171.252"),
                   ("name", "Mrs. Jane Doe"), ("name", "Herr Karl-Heinz Ölmann"), ("name", "Госпожа Анна Петрова")]


@pytest.mark.parametrize("size", [2, 10, 1000, 4096, 5001])
def test_permutation(size):
    assert sorted(permute(KEY, v, size, "x") for v in range(size)) == list(range(size))


def test_formats():
    rnd = random.Random(1)
    for _ in range(200):
        body = "".join(rnd.choice("0123456789") for _ in range(15))
        valid = body + str(_luhn(body))
        new = surrogate(KEY, "card", valid)
        assert len(new) == 16 and new[-1] == str(_luhn(new[:-1]))
        wrong = body + str((_luhn(body) + 3) % 10)
        assert surrogate(KEY, "card", wrong)[-1] != str(_luhn(surrogate(KEY, "card", wrong)[:-1]))
        assert surrogate(KEY, "ipv4", f"10.{rnd.randrange(256)}.3.4").startswith("10.")
        assert not surrogate(KEY, "ipv4", f"8.{rnd.randrange(256)}.3.4").startswith("10.")
    assert re.fullmatch(r"[a-z]{3}\.[0-9]{2}@[a-z]{4}[0-9]\.[a-z]{7}\.com", surrogate(KEY, "email", "abc.12@mail5.example.com"))
    assert surrogate(KEY, "phone", "+16635556869")[:2] == "+1" and len(surrogate(KEY, "phone", "+16635556869")) == 12
    assert surrogate(KEY, "name", "f jane doe").split()[1].capitalize() in GIVEN["latin", "f"]
    assert surrogate(KEY, "name", "m иван петров").split()[1].capitalize() in GIVEN["cyrillic", "m"]
    assert surrogate(KEY, "name", "f анна петрова").endswith("ова")
    assert canonical("card", "4539 1488 0343 6467") == canonical("card", "4539148803436467")


def test_coreference_over_documents(spark):
    rows = [(1, "Mail a.b@x.org and A.B@X.ORG now. 4539 1488 0343 6467"), (2, "again a.b@x.org, card 4539148803436467"), (3, "other c.d@x.org"),
            (4, None), (5, ""), (None, "ip 8.8.8.8"), (1, "Mail a.b@x.org and A.B@X.ORG now. 4539 1488 0343 6467"), (6, "clean text 12 34"), (7, "x " * 300_000 + "8.8.8.8")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kinds int")
    got = pseudonymise(df, "secret").collect()
    text = {r.doc_id: r.text for r in got}
    one = re.findall(r"\S+@\S+", text[1])
    assert one[0].upper() == one[1] and one[0] in text[2] and "a.b@x.org" not in text[1] + text[2]
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", text[1])[0]
    assert card.replace(" ", "") in text[2] and card != "4539 1488 0343 6467"
    assert one[0].split("@")[1] == re.search(r"\S+@(\S+)", text[3])[1] and one[0].split("@")[0] != re.search(r"(\S+)@", text[3])[1]
    assert text[4] is None and text[5] == "" and text[6] == "clean text 12 34" and len(got) == 9
    assert text[7].split()[-1] == text[None].split()[-1] != "8.8.8.8"
    assert pseudonymise(df.limit(0), "secret").count() == 0
    with pytest.raises(ValueError):
        pseudonymise(df, "")


@pytest.mark.parametrize("limit", [100_000, 0])
def test_collisions_are_redrawn(spark, monkeypatch, limit):
    """Two-letter addresses collide often, and with real ones: all surrogates end up distinct."""
    monkeypatch.setattr(surrogates, "MAX_BROADCAST_REDRAWN", limit)
    names = [f"{a}{b}@q.org" for a in "abcdefghijklm" for b in "abcdefghijkl"]
    df = spark.createDataFrame([("email", n) for n in names], "kind string, entity string")
    drawn = draw_surrogates(df, KEY).collect()
    new = [r.surrogate for r in drawn]
    assert len(set(new)) == len(names) and not set(new) & set(names) and max(r.attempt for r in drawn) > 0
    docs = spark.createDataFrame([(i, f"to {n} and {names[i - 1]}") for i, n in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: re.findall(r"\S+@\S+", r.text) for r in pseudonymise(docs, "k").collect()}
    assert {got[i][0] for i in got} == set(new) and all(got[i][1] == got[(i - 1) % len(names)][0] for i in got)


def test_crowded_names_and_ranges(spark):
    """More names than short surrogates, a one-letter domain that is full, and a range filled by more than half."""
    names = [("name", f"m n{i}") for i in range(6000)]
    mails = [("email", f"{a}@x.org") for a in "abcdefghijklmnopqrstuvwxyz"]
    hosts = [("ipv4", f"192.168.{i % 256}.{i // 256}") for i in range(36_000)]
    few = [("ipv4", f"10.1.{i}.7") for i in range(50)]
    rows = names + mails + hosts + few
    drawn = draw_surrogates(spark.createDataFrame(rows, "kind string, entity string"), KEY).collect()
    new = {(r.kind, r.entity): r.surrogate for r in drawn}
    assert set(new) == set(rows) and len({(r.kind, r.surrogate) for r in drawn}) == len(rows)
    assert not {("name", new[x]) for x in names} & set(rows) and not {("email", new[x]) for x in mails} & set(rows)
    assert all(new[x].startswith("192.168.") for x in hosts) and max(r.attempt for r in drawn if r.entity.startswith("192.")) == 0
    assert all(new[x].startswith("10.") and ("ipv4", new[x]) not in set(rows) for x in few)


@pytest.mark.parametrize("kind,mention", [("phone", p) for p in (
    "+14155552671", "(555)123-4567", "+1(415)555-2671", "+49 30 12345678", "+33 6 12 34 56 78", "06 12 34 56 78", "+44 20 7946 0958",
    "+49 (30) 12345678", "+49 30 123 45 67", "+352 621 123 456")] + [("card", c) for c in ("3782 822463 10005", "3782-822463-10005", "378282246310005")]
    + [("ipv6", a) for a in ("2001:db8::1", "2001:0DB8:0000:0000:0000:FF00:0042:8329", "fe80::1ff:fe23:4567:890a", "::1", "fd00:1:2:3:4:5:6:7")])
def test_common_formats(kind, mention):
    for text in (f"see {mention} now", f"({mention}), next", mention, f"- {mention}-", f"{mention} 10.0.0.7"):
        got = [(k, text[a:b], e) for a, b, k, e in detect(text) if k != "ipv4"]
        assert [g[:2] for g in got] == [(kind, mention)]
        new = surrogates.mention_of(kind, surrogate(KEY, kind, got[0][2]), mention)
        assert new != mention and (kind == "phone" or [(k, new[a:b]) for a, b, k, _ in detect(new)] == [(kind, new)])
        if kind != "ipv6":
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", mention)
    if mention.startswith("+"):
        code = re.match(r"\+(1|33|44|49|352)", mention)[0]
        assert new.startswith(code)
    if mention[:2] in ("fe", "fd", "20"):
        assert new[:1].lower() in ("f" if mention[0] == "f" else "23")


def test_hyphens_times_and_scopes():
    assert [k for _, _, k, _ in detect("4539148803436467-x, 4539148803436467- and -4539148803436467")] == ["card"] * 3
    assert not detect("at 12:34:56 std::vector Dad:: aa:bb:cc:dd:ee:ff 2024-01-02 1.2.3 add::bee 4539148803436467-1")


def test_names_are_one_person_everywhere(spark):
    rows = [(1, "Smith came. Mr John Smith met Mrs Smith; John Smith left, SMITH too, then John. Smithson stayed."), (2, "Mr Smith and Dr. John Smith"),
            (3, "Prof. Dr. Anna Ölmann-Weiß, Mme Curie, Sra. López. Anna went, Ölmann-Weiß too"), (4, "Smith without a title"),
            (5, "Господин Иван Петров и Госпожа Анна Петрова. Петров, Петрова"), (6, "Mr Παπαδόπουλος είπε, Παπαδόπουλος"), (7, "Mr Jack Smith, Mr Jim Smith")]
    got = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    text = {d: r.text for d, r in got.items()}
    for d, words in {1: "John Smith SMITH", 2: "Smith John", 3: "Anna Ölmann Weiß Curie López", 5: "Иван Петров Анна Петрова", 6: "Παπαδόπουλος", 7: "Jack Jim Smith"}.items():
        assert not set(words.split()) & set(re.findall(r"\w+", text[d])), text[d]
    m = re.fullmatch(r"(\w+) came\. Mr (\w+) \1 met Mrs \1; \2 \1 left, (\w+) too, then \2\. Smithson stayed\.", text[1])
    assert m and m[3] == m[1].upper() and got[1].n_entities == 6 and text[2].startswith(f"Mr {m[1]} and Dr. ") and text[2].endswith(" " + m[1])
    assert text[4] == "Smith without a title"
    m = re.fullmatch(r"Prof\. Dr\. (\w+) (\w+-\w+), Mme \w+, Sra\. \w+\. \1 went, \2 too", text[3])
    assert m
    m = re.fullmatch("Господин [А-я]+ ([А-я]+ов) и Госпожа [А-я]+ ([А-я]+ова)\\. ([А-я]+), ([А-я]+)", text[5])
    assert m and m[2] == m[1] + "а" and (m[3], m[4]) == (m[1], m[2])
    m = re.fullmatch("Mr ([Α-ώ]+) είπε, ([Α-ώ]+)", text[6])
    assert m and m[1] == m[2]
    jack, jim = re.findall(r"Mr (\w+)", text[7])
    assert jack != jim


def test_letters_keep_their_script():
    new = surrogate(KEY, "email", "γιώργος.é@παράδειγμα.gr")
    assert re.fullmatch("[Ͱ-Ͽ]{7}\\.[à-ÿ]@[Ͱ-Ͽ]{10}\\.gr", new) and new == new.lower()
    assert surrogate(KEY, "name", "m 田中") != "m 田中" and re.fullmatch("m [一-鿿]+", surrogate(KEY, "name", "m 田中"))


@pytest.mark.parametrize("limit", [100_000, 0])
def test_domains_stay_distinct(spark, monkeypatch, limit):
    """All one-letter domains are taken: each gets a domain of its own that is none of theirs, the same everywhere."""
    monkeypatch.setattr(surrogates, "MAX_BROADCAST_REDRAWN", limit)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"jane@{c}.com then bob@{c}.com, JANE@{c.upper()}.COM") for i, c in enumerate(letters)]
    got = pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    found = {r.doc_id: re.findall(r"([\w.]+)@([\w.]+\.(?:com|COM))", r.text) for r in got}
    assert all(len({d.lower() for _, d in f}) == 1 and len(f) == 3 and f[0][0].upper() == f[2][0] for f in found.values())
    domains = {f[0][1] for f in found.values()}
    assert len(domains) == 26 and not domains & {f"{c}.com" for c in letters}
    assert len({(a, d.lower()) for f in found.values() for a, d in f[:2]}) == 52


def test_public_addresses_stay_public():
    rnd = random.Random(3)
    for _ in range(500):
        old = f"{rnd.choice([1, 8, 93, 151, 203, 223])}.{rnd.randrange(1, 100)}.{rnd.randrange(256)}.{rnd.randrange(256)}"
        assert surrogates._address(surrogate(KEY, "ipv4", old))[1] is None
    for old, net in (("224.0.0.251", "224.0.0.0/4"), ("255.255.255.255", "240.0.0.0/4"), ("192.0.2.7", "192.0.2.0/24"), ("169.254.1.1", "169.254.0.0/16")):
        assert str(surrogates._address(surrogate(KEY, "ipv4", old))[1]) == net
