"""PII replaced by keyed surrogates.

An entity is found by pattern, put into a canonical form (digits only, lower
case), and given a surrogate of the same type from a keyed digest: the same
entity gets the same surrogate in every document and format, letters stay
letters of their script, digits stay digits, separators, case and title stay.
A person's given and family names have a surrogate each, so that all forms of a
name (full, with a title, family name alone) stay forms of one name; names that
a document gives with a title or an introduction are replaced wherever it
repeats them. Spark checks the surrogates of all distinct entities, as they are
written, for collisions with each other and with entities that occur, and draws
again until none is left; surrogates lengthen with the attempt, so there are
always free ones. The few that had to draw again reach their documents by a join.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tillgrain.llm.common import settled, slices, unused

#: Spark setting that holds the secret key of the surrogates.
KEY_SETTING = "spark.tillgrain.surrogateKey"
ROUNDS = 200

# fixed values: titles by gender, and given names the surrogates are drawn from
MALE_TITLES = ("Mr", "Mister", "Monsieur", "Herr", "Señor", "Sr", "г-н", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madame", "Mademoiselle", "Frau", "Señora", "Sra", "г-жа", "госпожа")
NEUTRAL_TITLES = ("Dr", "Prof", "Professor", "Doctor")
SHORT_TITLES = ("Mr", "Mrs", "Ms", "Sr", "Sra", "Dr", "Prof")
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Louis", "Marco", "Nils", "Oscar", "Pablo"),
    ("latin", "f"): ("Alice", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helga", "Irene", "Julia", "Katia", "Laura", "Maria", "Nadia", "Olga", "Paula"),
    ("latin", "n"): ("Alex", "Charlie", "Robin", "Sasha", "Kim", "Noor", "Andrea", "Jules", "Sam", "Toni", "Max", "Dominique"),
    ("cyrillic", "m"): ("Иван", "Пётр", "Олег", "Антон", "Павел", "Борис", "Юрий", "Роман"),
    ("cyrillic", "f"): ("Анна", "Ольга", "Мария", "Елена", "Вера", "Ирина", "Дарья", "Нина"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава"),
}
SYLLABLES = {"latin": ("ba", "del", "fo", "gar", "hin", "ka", "lo", "mer", "nov", "pas", "ro", "sel", "tin", "ul", "ver", "wen"),
             "cyrillic": ("ба", "вел", "го", "дар", "зин", "ка", "ло", "мир", "нов", "пас", "ро", "сел", "тин", "ул", "фер", "шен")}
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "àâäçèéêëîïñôöùûü", "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω")

#: Words before a name that its bearer says.
_TELLS = "my name is|je m'appelle|mein name ist|mi nombre es|me llamo|меня зовут"
_NAME = r"[^\W\d_]\w*(?:[-'][^\W\d_]\w*)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = "|".join(sorted((t + (r"\.?" if t in SHORT_TITLES else "") for t in MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES), key=len, reverse=True))
#: Patterns in the order in which they are tried at a place.
PATTERNS = {
    "secret": r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>(?=[\w/+.=~-]{8})[A-Za-z0-9_/+.=~-]*[A-Za-z0-9])",
    "email": r"(?P<email>(?<![\w.+%-])[\w.+%-]{1,64}@(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24})",
    "ip": rf"(?P<ip>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w)(?!\.\d))",
    "world": r"(?P<world>(?<![\w.])\+\d(?:[ .()-]{0,2}\d){6,14}(?!\w))",
    "card": r"(?P<card>(?<![\w.])\d{4}(?P<gap>[ -]?)\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}(?!\w))",
    "ssn": r"(?P<ssn>(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    "phone": r"(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?|\d{1,3}[ .-])?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\w))",
    "iban": r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))",
    "name": rf"(?P<name>(?<!\w)(?P<title>{_TITLE}) (?P<who>{_NAME}(?: {_NAME})?))",
    "told": rf"(?P<told>(?<!\w)(?i:{_TELLS}) (?P<self>{_NAME}(?: {_NAME})?))",
}
WITH_DIGITS = ("ip", "world", "card", "ssn", "phone", "iban")
_DIGIT = re.compile(r"\d")


def possible(text: str) -> tuple[str, ...]:
    """The types whose patterns can match at all: each needs a character or a word
    of its own, which is looked for first."""
    some = {"secret"} if ("=" in text or ":" in text) else set()
    if "@" in text:
        some.add("email")
    if _DIGIT.search(text):
        some.update(WITH_DIGITS)
    if any(t in text for t in MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES):
        some.add("name")
    low = text.lower()
    if any(t in low for t in _TELLS.split("|")):
        some.add("told")
    return tuple(k for k in PATTERNS if k in some)


@lru_cache(maxsize=256)
def pattern_of(kinds: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(PATTERNS[k] for k in kinds))


DIGIT_TYPES = ("card", "ssn", "phone")


def _gender(title: str) -> str:
    title = title.rstrip(".")
    return "m" if title in MALE_TITLES else "f" if title in FEMALE_TITLES else "n"


def _names(m: re.Match) -> tuple[str, list[str], int]:
    """Gender, words and start of a titled or told name; no words if it is none."""
    titled = "who" in m.re.groupindex and m["name"] is not None
    text, start = (m["who"], m.start("who")) if titled else (m["self"], m.start("self"))
    words = text.split(" ")
    words = words[:next((i for i, w in enumerate(words) if w[0].islower()), len(words))]
    return (_gender(m["title"]) if titled else "n"), words, start


def _mentions(found: list[tuple], people: dict[str, tuple[str, str]], text: str) -> Iterator[tuple[str, str, int, int]]:
    """The name words of a document's people where they stand alone."""
    taken = sorted((a, b) for _, _, a, b in found)
    at = 0
    for m in re.finditer(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, people), key=len, reverse=True)) + r")(?!\w)", text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or taken[at][0] >= m.end():
            kind, canon = people[m[0]]
            yield "name", f"{kind}:{canon}", m.start(), m.end()


def entities(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(type, canonical form, start, end) of what is to be replaced, in order.

    A name's canonical form lists its parts, given and family name: the first
    gender that a document gives a person holds for all its mentions. A lone word
    after a title is a family name, after an introduction a given one.
    """
    found, named, genders = [], [], {}
    kinds = possible(text)
    for m in pattern_of(kinds).finditer(text) if kinds else ():
        kind = next(k for k in kinds if m[k] is not None)
        if kind in ("name", "told"):
            gender, words, start = _names(m)
            if words:
                end = start + len(" ".join(words))
                given = words[0] if len(words) > 1 or kind == "told" else None
                family = words[-1] if len(words) > 1 or kind == "name" else None
                if given and gender != "n":
                    genders.setdefault(given.lower(), gender)
                named.append((given, family, start, end))
            continue
        value = m[kind]
        name = kind
        if kind == "world":
            kind, canon = "phone", re.sub(r"\D", "", value)
            canon = canon[-10:] if len(canon) > 10 else canon
        elif kind in DIGIT_TYPES:
            canon = re.sub(r"\D", "", value)
            canon = canon[-10:] if kind == "phone" else canon  # with or without the country's code
        elif kind == "iban":
            canon = value.replace(" ", "")
        else:
            canon = value if kind == "secret" and not re.fullmatch("[0-9a-fA-F]+", value) else value.lower()
        found.append((kind, canon, m.start(name), m.end(name)))
    if named:
        people: dict[str, tuple[str, str]] = {}
        for given, family, start, end in named:
            parts = [("given", f"{genders.get(given.lower(), 'n')} {given.lower()}")] if given else []
            parts += [("family", family.lower())] if family else []
            found.append(("name", "|".join(f"{k}:{c}" for k, c in parts), start, end))
            for word, part in zip([w for w in (given, family) if w], parts):
                people.setdefault(word, part)
        found += _mentions(found, people, text)
        found.sort(key=lambda e: e[2])
    yield from found


def parts_of(kind: str, canon: str) -> list[tuple[str, str]]:
    """What has a surrogate of its own: an entity, or the parts of a name."""
    if kind != "name":
        return [(kind, canon)]
    return [tuple(part.split(":", 1)) for part in canon.split("|")]


class Draw:
    """Numbers from a keyed digest of an entity."""

    def __init__(self, key: bytes, *what: object) -> None:
        self.key, self.what, self.block, self.left = key, "\x1f".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.left += hmac.digest(self.key, self.what + self.block.to_bytes(4, "big"), "sha256")
            self.block += 1
        value, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return value % n

    def of(self, options):
        return options[self.below(len(options))]


def _like(c: str, draw: Draw, digits: str = "0123456789") -> str:
    """A character of the same class, script and case."""
    if c.isdigit():
        return draw.of(digits)
    low = c.lower()
    for alphabet in ALPHABETS:
        if low in alphabet:
            got = draw.of(alphabet)
            return got.upper() if c != low else got
    if c.isalpha():  # another script: one of the letters around it
        near = [x for x in map(chr, range(ord(c) & ~15, (ord(c) | 15) + 1)) if x.isalpha() and x.isupper() == c.isupper()]
        return draw.of(near)
    return c


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def surrogate(kind: str, canon: str, attempt: int = 0, key: bytes = b"") -> str:
    """Canonical surrogate of a canonical entity; never the entity itself. Names,
    hosts and secrets grow with the attempt, so a free one is always found."""
    for again in range(ROUNDS):
        out = _drawn(kind, canon, attempt, Draw(key, kind, canon, attempt, again))
        if out != (canon.split(" ", 1)[1] if kind == "given" else canon):
            return out
    raise ValueError(f"no surrogate for an entity of type {kind}")


def _script(word: str) -> str:
    return "cyrillic" if re.search("[а-яё]", word) else "latin" if re.search("[a-zà-ž]", word) else "other"


def _drawn(kind: str, canon: str, attempt: int, draw: Draw) -> str:
    if kind == "email":
        local, domain = canon.split("@", 1)
        site = Draw(draw.key, "domain", domain, *([attempt] if attempt else []))
        host = "".join(site.of(SYLLABLES["latin"]) for _ in range(4 + attempt))
        return f"{''.join(_like(c, draw) for c in local)}@{host}.example.{domain.rsplit('.', 1)[1]}"
    if kind == "ip":
        first = canon.split(".")[0]
        inside = first in ("10", "127", "192", "172") and attempt < ROUNDS // 2
        return ".".join([first if inside else str(1 + draw.below(223)), *(str(draw.below(256)) for _ in range(2)), str(1 + draw.below(254))])
    if kind == "card":
        body = canon[0] + "".join(draw.of("0123456789") for _ in canon[1:-1])
        check = next(d for d in "0123456789" if _luhn(body + d) == 0)
        return body + (check if _luhn(canon) == 0 else draw.of("0123456789".replace(check, "")))
    if kind in DIGIT_TYPES:
        return "".join(draw.of("0123456789") for _ in canon)
    if kind == "iban":
        return canon[:2] + "".join(_like(c, draw) for c in canon[2:])
    if kind in ("given", "family"):
        word = canon.split(" ", 1)[1] if kind == "given" else canon
        script = _script(word)
        if script == "other":
            return "".join(_like(c, draw) for c in word) + "".join(_like(word[0], draw) for _ in range(attempt))
        made = lambda n: "".join(draw.of(SYLLABLES[script]) for _ in range(n))
        return draw.of(GIVEN[script, canon[0]]).lower() + made(attempt) if kind == "given" else made(3 + draw.below(2) + attempt)
    if kind == "secret" and re.fullmatch("[0-9a-f]+", canon):
        return "".join(draw.of("0123456789abcdef") for _ in canon)
    return "".join(_like(c, draw) for c in canon)


def written(kind: str, original: str, made: str) -> str:
    """The surrogate in the format of the original: its separators and its case."""
    if kind in DIGIT_TYPES:
        code = max(0, sum(c.isdigit() for c in original) - len(made))  # a country's code stays
        digits = iter(re.sub(r"\D", "", original)[:code] + made)
        return "".join(next(digits) if c.isdigit() else c for c in original)
    if kind == "name":
        return made.upper() if original.isupper() and len(original) > 1 else made.title()
    if kind == "iban":
        chars = iter(made)
        return "".join(c if c == " " else next(chars) for c in original)
    if kind in ("email", "secret") and original != original.lower():
        return made.upper() if original == original.upper() else made if kind == "email" or not re.fullmatch("[0-9a-fA-F]+", original) else "".join(
            m.upper() if o.isupper() else m for o, m in zip(original, made))
    return made


def found_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, canon), distinct within a document."""
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("canon", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(i, *e) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t
                    for e in sorted({part for k, c, _, _ in entities(t) for part in parts_of(k, c)})]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, kind string, canon string")


def drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """Adds ``made``, the surrogate of (kind, canon) at ``attempt``."""
    schema = pa.schema([("kind", pa.string()), ("canon", pa.string()), ("attempt", pa.int32()), ("made", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, canon, attempt = (batch.column(c).to_pylist() for c in ("kind", "canon", "attempt"))
            made = [surrogate(k, c, a, key) for k, c, a in zip(kind, canon, attempt)]
            yield pa.record_batch([pa.array(kind, pa.string()), pa.array(canon, pa.string()), pa.array(attempt, pa.int32()), pa.array(made, pa.string())], schema=schema)

    return rows.select("kind", "canon", "attempt").mapInArrow(run, "kind string, canon string, attempt int, made string")


def key_of(spark, key: bytes | None = None) -> bytes:
    """The key of the surrogates: given, or the session's setting KEY_SETTING. Only
    a local session (tests) may do without."""
    setting = spark.conf.get(KEY_SETTING, None)
    if key or setting:
        return key or setting.encode()
    if spark.sparkContext.master.startswith("local"):
        return b"local"
    raise ValueError(f"surrogates need a secret key: pass one or set {KEY_SETTING}")


def redrawn(distinct: DataFrame, key: bytes = b"") -> DataFrame:
    """(kind, canon, made) of the distinct entities (kind, canon) whose first
    surrogate was taken: by an entity that occurs, or by another entity's
    surrogate. Repeats until the surrogates of all entities are distinct.
    """
    group = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind")).alias("group")
    plain = F.when(F.col("kind") == "given", F.substring_index("canon", " ", -1)).otherwise(F.col("canon"))  # without the gender
    current = settled(drawn(distinct.withColumn("attempt", F.lit(0)), key), "surrogates")
    real = distinct.select(group, plain.alias("made"), F.lit(True).alias("real")).distinct()
    for _ in range(ROUNDS):
        first = Window.partitionBy("group", "made").orderBy("attempt", "kind", "canon")
        marked = current.withColumn("group", group).join(real, ["group", "made"], "left").withColumn(
            "again", F.coalesce("real", F.lit(False)) | (F.row_number().over(first) > 1))
        marked = settled(marked.select("kind", "canon", "attempt", "made", "again"), "surrogates-checked")
        again = marked.where("again")
        if again.isEmpty():
            return marked.where("attempt > 0").select("kind", "canon", "made")
        fresh = drawn(again.withColumn("attempt", F.col("attempt") + 1), key)
        current = settled(marked.where("NOT again").select("kind", "canon", "attempt", "made").unionByName(fresh), "surrogates")
    raise ValueError("entities of a type outnumber its surrogates")


def replace(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``docs`` with the text's entities replaced, and the columns
    ``n_entities`` and ``entity_types`` (distinct types, sorted, comma between).

    All other columns pass through (columns named like the added ones are
    replaced). Null and empty texts stay as they are. Rows are independent, so
    repeated rows and null ids are treated alike. A value without letters or digits
    is no entity.
    """
    key = key_of(docs.sparkSession, key)
    docs = docs.drop("n_entities", "entity_types")
    ids = F.col("doc_id").cast("bigint").alias("doc_id")
    found = settled(found_entities(docs.select(ids, "text")), "entities")
    others = settled(redrawn(settled(found.select("kind", "canon").distinct(), "distinct-entities"), key), "redrawn")
    of, special = unused("redrawn_of", docs.columns), unused("redrawn", docs.columns)
    by_doc = settled(found.join(others, ["kind", "canon"]).groupBy(F.col("doc_id").alias(of)).agg(
        F.collect_set(F.struct("kind", "canon", "made")).alias(special)), "redrawn-by-document")
    joined = docs.join(by_doc, docs["doc_id"].cast("bigint").eqNullSafe(by_doc[of]), "left").drop(of)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_entities", T.LongType()), T.StructField("entity_types", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts, kinds = [], [], []
            at = batch.schema.get_field_index("text")
            for text, redrawn_here in zip(batch.column(at).to_pylist(), batch.column(special).to_pylist()):
                taken = {(r["kind"], r["canon"]): r["made"] for r in redrawn_here or ()}
                parts, last, seen, n = [], 0, set(), 0
                for kind, canon, a, b in entities(text or ""):
                    made = " ".join(taken.get(part) or surrogate(*part, 0, key) for part in parts_of(kind, canon))
                    parts += [text[last:a], written(kind, text[a:b], made)]
                    last, n = b, n + 1
                    seen.add(kind)
                texts.append("".join(parts) + text[last:] if n else text)
                counts.append(n), kinds.append(",".join(sorted(seen)))
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            keep = [i for i, name in enumerate(out.schema.names) if name != special]
            cols = [*(out.column(i) for i in keep), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())]
            names = [*(out.schema.names[i] for i in keep), "n_entities", "entity_types"]
            yield pa.record_batch(cols, names=names)

    return joined.mapInArrow(run, schema)
