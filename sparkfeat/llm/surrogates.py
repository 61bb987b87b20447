"""Surrogate generation for personal data.

Detected entities (e-mail, IPv4 and IPv6 addresses, payment cards, phone and social
security numbers, titled person names) are replaced by keyed surrogates of the same
type, format, script and, for names, gender. The same entity gets the same surrogate
in every document (coreference) and different entities get different ones. A person's
family name and each given name (by gender) are drawn on their own, so all Smiths share
a surrogate; further mentions of a name without its title are replaced in its document,
case and spelling alike. Letters keep their script; Latin names get plain Latin letters.

Numbers and addresses go through a keyed permutation of all numbers of their format,
so they cannot collide with each other. E-mails, their domains (each on its own, the last
label stays) and names are drawn by a keyed hash.
All surrogates of the corpus are then checked: the distinct entities (never the texts)
are grouped by surrogate, and those that share one, or whose surrogate is itself an
entity of the corpus, are drawn again until none is left. Redrawn names and addresses
grow longer, so there is always room. A range of numbers that the corpus fills by more
than half (all of 192.168.0.0/16, say) keeps its permutation: it stays collision-free,
but there a surrogate may be another entity's number.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import drop_materialized, materialize, slices, table

EMAIL = r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
_H = r"[0-9A-Fa-f]{1,4}"
IPV6 = (rf"(?<![\w:.])(?=[A-Fa-f:]*\d)(?:(?:{_H}:){{7}}{_H}|" + "|".join(rf"(?:{_H}:){{{k}}}(?::{_H}){{1,{7 - k}}}" for k in range(6, 0, -1))
        + rf"|:(?::{_H}){{1,7}}|(?:{_H}:){{1,7}}:)(?![\w:]|\.\d)")
CARD = r"(?<!\d)(?<!\d-)(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{4,5})(?!\d|-\d)"
SSN = r"(?<!\d)(?<!\d-)\d{3}-\d{2}-\d{4}(?!\d|-\d)"
_CODE = r"\+\d{1,3}[ .\-]?"
PHONE = (r"(?<![\w+])(?:" + rf"(?:{_CODE})?(?:\(\d{{2,4}}\)[ .\-]?|\d{{2,4}}[ .\-])\d{{3,4}}[ .\-]\d{{3,4}}"         # (555) 123-4567
         + rf"|{_CODE}(?:\(\d{{1,5}}\)[ .\-]?)?\d{{1,5}}(?:[ .\-]\d{{2}}){{3,5}}(?!\.\d)|0[1-9](?:[ .\-]\d{{2}}){{4}}"        # +33 6 12 34 56 78
         + rf"|{_CODE}(?:\(\d{{1,5}}\)[ .\-]?)?\d{{1,5}}(?:[ \-]\d{{2,4}}){{2,4}}(?!\.\d)"                                    # +49 30 123 45 67
         + rf"|{_CODE}(?:\(\d{{1,5}}\)|\d{{1,5}})[ .\-]?\d{{5,10}}|\+\d{{7,15}})(?!\w|-\d)")                          # +49 30 12345678, +14155552671
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Signor": "m", "Lord": "m", "Господин": "m", "Κύριος": "m",
          "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Mademoiselle": "f", "Señora": "f", "Sra": "f",
          "Señorita": "f", "Srta": "f", "Signora": "f", "Lady": "f", "Dra": "f", "Госпожа": "f", "Κυρία": "f",
          "Dr": "n", "Doctor": "n", "Doktor": "n", "Prof": "n", "Professor": "n", "Mx": "n", "Доктор": "n", "Профессор": "n"}     # n: any gender
LOWER = re.escape("".join(chr(c) for c in range(0x2E80) if chr(c).islower()))
WORD = rf"[^\W\d_{LOWER}]\w+"                     # not a lower-case letter first
TITLE = r"(?:(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.? )"
NAME = rf"(?<!\w){TITLE}{{1,3}}(?!{TITLE}){WORD}(?:[ \-]{WORD}){{0,2}}"
TITLED = re.compile(TITLE + "{1,3}")
TYPES = ["email", "ipv4", "ipv6", "card", "ssn", "phone", "name"]
DETECT = re.compile("|".join(f"(?P<{t}>{p})" for t, p in zip(TYPES, (EMAIL, IPV4, IPV6, CARD, SSN, PHONE, NAME))))
MAYBE = re.compile(r"@|\d[\d.) (\-]{6}|[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:|::|" + "|".join(sorted(TITLES)))

# Given names by script and gender.
GIVEN = {("latin", "m"): ["Adam", "Boris", "Carl", "Daniel", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo"],
         ("latin", "f"): ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura"],
         ("cyrillic", "m"): ["Алексей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
         ("cyrillic", "f"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Клара"]}
GIVEN |= {("greek", "m"): ["Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"], ("greek", "f"): ["Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"]}
SYLLABLES = {"greek": ["βαρ", "δεν", "φολ", "γαν", "χολ", "κερ", "λιν", "μορ", "νεσ", "περ", "ροσ", "στεν", "τορ", "βιν", "βελ", "ζαν"], "latin": ["bar", "den", "fol", "gan", "hol", "ker", "lin", "mor", "nes", "per", "ros", "sten", "tor", "vin", "wel", "zan"],
             "cyrillic": ["бар", "ден", "фол", "ган", "хол", "кер", "лин", "мор", "нес", "пер", "рос", "стен", "тор", "вин", "вел", "зан"]}
SCRIPTS = [("cyrillic", re.compile("[Ѐ-ӿ]")), ("greek", re.compile("[Ͱ-Ͽἀ-῿]")), ("latin", re.compile("[A-Za-zÀ-ɏḀ-ỿ]"))]
MAX_BROADCAST_REDRAWN = 100_000


# ------------------------------------------------------------------ keyed helpers

def _draw(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


def permute(key: bytes, value: int, size: int, *what) -> int:
    """Keyed permutation of 0..size-1: a four-round Feistel network with cycle walking."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(4):
            left, right = right, left ^ (_draw(key, "feistel", *what, size, r, right) & mask)
        value = left << half | right
        if value < size:
            return value


def _luhn(digits: str) -> int:
    """Check digit that makes ``digits`` followed by it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


@lru_cache(None)
def _letters(block: int, upper: bool, lower: bool) -> str:
    """The letters of a case in a block of 128 characters that have one partner of the other case, or no case."""
    if block == 0:
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if upper else "abcdefghijklmnopqrstuvwxyz"
    if block == 8 and (upper or lower):                          # the Russian letters
        return "".join(chr((0x410 if upper else 0x430) + k) for k in range(32))
    every = [chr(c) for c in range(block << 7, (block + 1) << 7)]
    return "".join(c for c in every if c.isalpha() and c.isupper() == upper and c.islower() == lower
                   and (not upper or c.lower().upper() == c) and (not lower or c.upper().lower() == c and c.upper() != c))


def _like(template: str, letters) -> str:
    """``letters`` (an iterator of numbers) in the case, script and digits of ``template``."""
    out = []
    for c in template:
        if c.isdigit():
            out.append(str(next(letters) % 10))
        elif c.isalpha():
            choice = _letters(ord(c) >> 7, c.isupper(), c.islower())
            out.append(choice[next(letters) % len(choice)] if choice else c)
        else:
            out.append(c)
    return "".join(out)


def _numbers(key: bytes, *parts):
    block = 0
    while True:
        yield from hmac.new(key, "\x1f".join([*map(str, parts), str(block)]).encode(), hashlib.sha512).digest()
        block += 1


# ------------------------------------------------------------------ entities

def detect(text: str | None):
    """(start, end, type, canonical form) of the entities of a text, left to right."""
    if not text or not MAYBE.search(text):
        return []
    found = [(m.start(), m.end(), m.lastgroup, canonical(m.lastgroup, m[0])) for m in DETECT.finditer(text)]
    if not any(kind == "name" for _, _, kind, _ in found):
        return found
    known = {}                                                   # word of a detected name -> (is given, gender)
    for gendered in (True, False):
        for a, b, kind, entity in found:
            if kind == "name" and (entity[0] != "n") == gendered:
                words = TITLED.sub("", text[a:b], count=1).split(" ")
                for k, word in enumerate(words):
                    for part in word.split("-"):
                        known.setdefault(part, (k < len(words) - 1, entity[0]))
    # a neutral title takes the gender that the given name has in the text
    lowered = {w.lower(): g for w, (given, g) in known.items() if given}
    found = [(a, b, kind, lowered.get(re.split("[ -]", e[2:])[0], "n") + e[1:] if kind == "name" and e[0] == "n" and " " in e[2:] else e)
             for a, b, kind, e in found]
    for word, role in list(known.items()):
        if len(word.upper()) == len(word):
            known.setdefault(word.upper(), role)
    out, at = [], 0
    for a, b, kind, entity in [*found, (len(text), len(text), None, None)]:
        out += _again(text, at, a, known)
        if kind:
            out.append((a, b, kind, entity))
        at = b
    return out


def _again(text: str, lo: int, hi: int, known: dict):
    """Further mentions of known name words between lo and hi: given names, family name, or both in this order."""
    out, last = [], None                                         # last: may the mention go on
    for m in re.compile(r"\w+").finditer(text, lo, hi):
        role = known.get(m[0])
        if role is None or (m.start() == lo and lo and re.match(r"\w", text[lo - 1])):
            last = None
            continue
        given, gender = role
        if last and m.start() == out[-1][1] + 1 and text[m.start() - 1] in " -" and (last[0] or text[m.start() - 1] == "-" and not given):
            a, _, _, entity = out.pop()
            mark = text[m.start() - 1]
            entity = entity.rstrip(" ") + mark + m[0].lower() + (" " if given else "")
            out.append((a, m.end(), "name", entity))
        else:
            out.append((m.start(), m.end(), "name", f"{gender} {m[0].lower()}" + (" " if given else "")))
        last = role
    return out


def canonical(kind: str, mention: str) -> str:
    """One form for all mentions of an entity."""
    if kind == "email":
        return mention.lower()
    if kind in ("card", "ssn", "phone"):
        return ("+" if mention.startswith("+") else "") + re.sub(r"\D", "", mention)
    if kind == "name":
        titles = TITLED.match(mention)[0]
        gender = next((g for g in (TITLES[t.rstrip(".")] for t in titles.split()) if g != "n"), "n")
        return f"{gender} {mention[len(titles):].lower()}"
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(mention))
    return mention


# Private and reserved networks: their addresses stay in them, and no public address becomes one of theirs.
PRIVATE = [ipaddress.IPv4Network(n) for n in (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "0.0.0.0/8", "100.64.0.0/10", "169.254.0.0/16", "192.0.0.0/24",
    "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")]


NETS6 = [ipaddress.IPv6Network(n) for n in ("2000::/3", "fc00::/7", "fe80::/10")]        # global, private, link


def _address6(entity: str):
    """(number, its network or None) of an IPv6 address."""
    address = ipaddress.IPv6Address(entity)
    return int(address), next((n for n in NETS6 if address in n), None)


def _address(entity: str):
    """(number, its private network or None); None for octets written with leading zeros."""
    try:
        address = ipaddress.IPv4Address(entity)
    except ValueError:
        return None
    return int(address), next((n for n in PRIVATE if address in n), None)


TWO_DIGIT_CODES = {20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98}


def _fixed_digits(entity: str) -> tuple[str, str]:
    """What stays of a number (the plus sign and country code) and the digits that are permuted."""
    digits = entity.lstrip("+")
    fixed = 0
    if entity.startswith("+") and len(digits) > 6:
        fixed = 1 if digits[0] in "17" else 2 if int(digits[:2]) in TWO_DIGIT_CODES else 3
    return ("+" if entity.startswith("+") else "") + digits[:fixed], digits[fixed:]


def space(kind: str, entity: str) -> tuple[str | None, float | None]:
    """Name and size of the range of numbers that holds an entity and its surrogates; None where redraws grow."""
    if kind == "ipv4" and (found := _address(entity)):
        net = found[1]
        return (str(net), float(net.num_addresses)) if net else ("public", float((1 << 32) - sum(n.num_addresses for n in PRIVATE)))
    if kind == "ipv6":
        net = _address6(entity)[1]
        return str(net or "other"), float(net.num_addresses if net else (1 << 128) - sum(n.num_addresses for n in NETS6))
    if kind == "card":
        return str(len(entity)), 10.0 ** len(entity)
    if kind in ("ssn", "phone"):
        stays, rest = _fixed_digits(entity)
        return f"{stays}:{len(rest)}", 10.0 ** len(rest)
    return None, None


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0, domain_attempt: int = 0) -> str:
    """Canonical surrogate of a canonical entity; ``attempt`` > 0 draws again (``domain_attempt``: an e-mail's domain)."""
    what = (kind, attempt) if attempt else (kind,)
    if kind == "ipv4":
        found = _address(entity)
        if found is None:
            return ".".join(str(_draw(key, *what, entity, k) % 223 + 1) for k in range(4))
        address, net = found
        if net:                                                  # private stays private
            base = int(net.network_address)
            return str(ipaddress.IPv4Address(base + permute(key, address - base, net.num_addresses, *what, str(net))))
        while True:
            address = permute(key, address, 1 << 32, *what)
            if not any(ipaddress.IPv4Address(address) in n for n in PRIVATE):
                return str(ipaddress.IPv4Address(address))
    if kind == "ipv6":
        address, net = _address6(entity)
        if net:                                                  # a network's addresses stay in it
            base = int(net.network_address)
            return str(ipaddress.IPv6Address(base + permute(key, address - base, net.num_addresses, *what, str(net))))
        while True:
            address = permute(key, address, 1 << 128, *what)
            if not any(ipaddress.IPv6Address(address) in n for n in NETS6):
                return str(ipaddress.IPv6Address(address))
    if kind == "card":
        body = entity[:-1]
        shift = (int(entity[-1]) - _luhn(body)) % 10             # a valid number stays valid, an invalid one invalid
        new = str(permute(key, int(body), 10 ** len(body), *what, len(body))).zfill(len(body))
        return new + str((_luhn(new) + shift) % 10)
    if kind in ("ssn", "phone"):
        stays, rest = _fixed_digits(entity)                      # the country code stays
        new = str(permute(key, int(rest), 10 ** len(rest), *what, stays.startswith("+"), stays.lstrip("+"), len(rest))).zfill(len(rest))
        return stays + new
    if kind == "email":
        local, _, domain = entity.partition("@")
        # one surrogate for a domain wherever it stands, whatever the attempt; a crowded one gets longer names
        return (_like(local + "a" * max(0, attempt - 2), _numbers(key, *what, entity)) + "@"
                + surrogate(key, "domain", domain, domain_attempt))
    if kind == "domain":
        host, _, tld = entity.rpartition(".")
        return _like(host + "a" * max(0, attempt - 2), _numbers(key, *what, entity)) + "." + tld
    if kind in ("family", "given"):
        return _name_word(key, kind, entity, attempt)
    return name_surrogate(key, entity, lambda kind, word: attempt)


def name_parts(entity: str) -> list[tuple[str, str, str]]:
    """(mark before, family or given, its canonical form) of a canonical name; one that ends with a space has no family name."""
    gender, _, name = entity.partition(" ")
    words, out = name.split(" "), []
    for k, word in enumerate(words):
        for j, part in enumerate(word.split("-")):
            if part:
                mark = "-" if j else " "
                out.append((mark, "family", _family(part, gender)) if k == len(words) - 1 else (mark, "given", f"{gender} {part}"))
    return out


def _family(word: str, gender: str) -> str:
    """A family name without the ending that a Russian one has for women."""
    return word[:-1] if gender == "f" and re.fullmatch("[Ѐ-ӿ]+(?:ов|ев|ёв|ин|ын)а", word) else word


def _name_word(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """Surrogate of a family name (without ending), or of a given name after its gender."""
    gender, _, word = entity.rpartition(" ")
    script = next((s for s, letters in SCRIPTS if letters.search(word)), None)
    what = (kind, attempt) if attempt else (kind,)
    if script is None:                                           # a script without a list: letters of its own
        new = _like(word + word[-1] * (attempt + (len(word) < 2)), _numbers(key, *what, entity))
        return f"{gender} {new}" if gender else new
    new = ""
    if kind == "given":
        names = GIVEN[script, gender] if gender != "n" else GIVEN[script, "m"] + GIVEN[script, "f"]
        new = names[_draw(key, *what, entity) % len(names)].lower()
    grown = len(new) + 3 * attempt if kind == "given" else 4 + 3 * attempt
    while len(new) < grown:                                      # every redraw has 16 times the room
        new += SYLLABLES[script][_draw(key, *what, entity, "family", len(new)) % 16]
    if kind == "family":
        new += SYLLABLES[script][_draw(key, *what, entity, "end") % 16] + ("ов" if script == "cyrillic" else "")
    return f"{gender} {new}" if gender else new


def name_surrogate(key: bytes, entity: str, attempt_of) -> str:
    """Canonical surrogate of a name from those of its words; ``attempt_of(kind, word)`` tells their attempts."""
    gender, new = entity[0], ""
    for mark, kind, word in name_parts(entity):
        drawn = _name_word(key, kind, word, attempt_of(kind, word)).rpartition(" ")[2]
        new += mark + drawn + ("а" if kind == "family" and gender == "f" and drawn.endswith("ов") else "")
    return gender + " " + new[1:]


def drawn_entities(kind: str, entity: str) -> list[tuple[str, str]]:
    """What is drawn for an entity: the words of a name, an e-mail and its domain, else itself."""
    if kind == "name":
        return [(k, word) for _, k, word in name_parts(entity)]
    return [(kind, entity), ("domain", entity.partition("@")[2])] if kind == "email" else [(kind, entity)]


def mention_of(kind: str, new: str, mention: str) -> str:
    """The canonical surrogate in the format of a mention."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(new.lstrip("+"))
        return re.sub(r"\d", lambda _: next(digits), mention)
    if kind in ("email", "ipv6"):
        if kind == "ipv6" and all(len(g) == 4 for g in mention.split(":")):
            new = ipaddress.IPv6Address(new).exploded
        return new.upper() if mention.isupper() else new
    if kind == "name":
        title = m[0] if (m := TITLED.match(mention)) else ""
        name = new.partition(" ")[2]
        return title + (name.upper() if mention[len(title):].isupper() else re.sub(r"\w+", lambda m: m[0].capitalize(), name))
    return new


# ------------------------------------------------------------------ operator

def _entities_of(batches):
    """Distinct entities of each batch of texts."""
    for batch in slices(batches):
        seen = {}
        for text in batch.column("text"):
            for _, _, kind, entity in detect(text.as_py()):
                for one in drawn_entities(kind, entity):
                    seen[one] = seen.get(one, 0) + 1
        cols = list(zip(*((k, e, n) for (k, e), n in seen.items()))) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())],
                                         names=["kind", "entity", "mentions"])


def _surrogates_of(key):
    def run(batches):
        for batch in slices(batches):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "attempt"))))
            names, rooms = [list(x) for x in zip(*(space(k, e) for k, e, _ in rows))] or ([], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("kind", "entity", "attempt")]
                + [pa.array([surrogate(key, *row) for row in rows], pa.string()), pa.array(names, pa.string()), pa.array(rooms, pa.float64())],
                names=["kind", "entity", "attempt", "surrogate", "space", "room"])
    return run


def draw_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt, surrogate) without collisions, for distinct (kind, entity).

    Of the entities that share a surrogate the smallest keeps it; one whose surrogate
    is an entity of the corpus, or is itself, draws again. Entities of a range that the
    corpus fills by more than half never draw again (their permutation has no collisions).
    Every round writes its state.
    """
    schema = "kind string, entity string, attempt int, surrogate string, space string, room double"
    cols = ["kind", "entity", "attempt", "surrogate", "space", "room"]
    state = materialize(entities.select("kind", "entity", F.lit(0).alias("attempt")).mapInArrow(_surrogates_of(key), schema), "surrogates")
    dense = materialize(state.where("room is not null").groupBy("kind", "space").agg(F.count("*").alias("n"), F.max("room").alias("room"))
                        .where("n > room / 2").select("kind", "space", F.lit(True).alias("dense")), "dense")
    none_dense = dense.isEmpty()
    while True:
        marked = state.withColumn("dense", F.lit(False)) if none_dense else (
            state.join(dense, ["kind", "space"], "left").withColumn("dense", F.coalesce("dense", F.lit(False))))
        shared = (marked.groupBy("kind", "surrogate").agg(F.min(F.struct(~F.col("dense"), "entity"))["entity"].alias("keeper"), F.count("*").alias("n"))
                  .where("n > 1"))
        real = state.select("kind", F.col("entity").alias("surrogate")).withColumn("real", F.lit(True))
        judged = (marked.join(shared.select("kind", "surrogate", "keeper"), ["kind", "surrogate"], "left")
                  .join(real, ["kind", "surrogate"], "left")
                  .withColumn("again", ~F.col("dense") & (F.coalesce("real", F.lit(False)) | F.coalesce(F.col("entity") != F.col("keeper"), F.lit(False)))))
        losers = materialize(judged.where("again").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), "redraw")
        if losers.isEmpty():
            drop_materialized(losers)
            drop_materialized(dense)
            return state.select("kind", "entity", "attempt", "surrogate")
        redrawn = losers.mapInArrow(_surrogates_of(key), schema)
        kept = state.join(losers.select("kind", "entity"), ["kind", "entity"], "left_anti").select(*cols)
        new = materialize(kept.unionAll(redrawn), "surrogates")
        drop_materialized(state)
        drop_materialized(losers)
        state = new


def _rewrite_of(key, redrawn):
    """Rewrite texts; ``redrawn``: attempts of the entities that drew again, shared or per row."""
    def run(batches):
        common = redrawn.value if redrawn is not None else {}
        for batch in slices(batches):
            texts, counts, kinds = [], [], []
            own = batch.column("__attempts").to_pylist() if "__attempts" in batch.schema.names else None
            for r, text in enumerate(batch.column("__text").to_pylist()):
                attempts = common if own is None else {(x["kind"], x["entity"]): x["attempt"] for x in own[r] or ()}
                out, at, seen = [], 0, []
                for a, b, kind, entity in detect(text):
                    if kind == "name":
                        new = name_surrogate(key, entity, lambda *word: attempts.get(word, 0))  # noqa: B023
                    else:
                        new = surrogate(key, kind, entity, *(attempts.get(one, 0) for one in drawn_entities(kind, entity)))
                    out += [text[at:a], mention_of(kind, new, text[a:b])]
                    at = b
                    seen.append(kind)
                texts.append(text if not seen else "".join([*out, text[at:]]))
                counts.append(len(seen))
                kinds.append(sorted(set(seen)))
            names = [c for c in batch.schema.names if not c.startswith("__")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(kinds, pa.list_(pa.string()))],
                names=[*names, "text", "n_entities", "kinds"])
    return run


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities (mentions replaced), kinds; one row per input row.

    Null texts stay null, empty ones empty; rows with a null doc_id are rewritten like
    any other; repeated rows give repeated results. The same key gives the same
    surrogates as long as no new collision forces a redraw. An empty table gives no
    rows; other columns are ignored.
    """
    if not key:
        raise ValueError("a secret key is needed")
    raw = key.encode()
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    entities = (docs.select(F.col("__text").alias("text")).mapInArrow(_entities_of, "kind string, entity string, mentions long")
                .groupBy("kind", "entity").agg(F.sum("mentions").alias("mentions")))
    drawn = draw_surrogates(entities, raw)
    redrawn = drawn.where("attempt > 0").select("kind", "entity", "attempt")
    out = "doc_id long, text string, n_entities int, kinds array<string>"
    few = redrawn.limit(MAX_BROADCAST_REDRAWN + 1).collect()
    if len(few) <= MAX_BROADCAST_REDRAWN:                       # bounded: at most so many short rows
        shared = spark.sparkContext.broadcast({(r.kind, r.entity): r.attempt for r in few})
        return docs.mapInArrow(_rewrite_of(raw, shared), out)
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "__text"))
    mentions = keyed.select("__key", "__text").mapInArrow(_mentions_of, "__key long, kind string, entity string").distinct()
    own = (mentions.join(redrawn, ["kind", "entity"]).groupBy("__key")
           .agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("__attempts")))
    return keyed.join(own, "__key", "left").mapInArrow(_rewrite_of(raw, None), out)


def _mentions_of(batches):
    for batch in slices(batches):
        rows = [(k, *one) for k, text in zip(batch.column("__key").to_pylist(), batch.column("__text").to_pylist())
                for _, _, kind, entity in detect(text) for one in drawn_entities(kind, entity)]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                                         names=["__key", "kind", "entity"])


def op1_pii_surrogates(spark, sf_dir):
    return pseudonymise(table(spark, sf_dir, "documents"), key="corpus-2024")
