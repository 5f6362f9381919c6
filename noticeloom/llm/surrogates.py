"""Operator 2: personal data replaced by keyed, type-consistent surrogates."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
import string
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import cut, fresh, join_small, sliced, table
from noticeloom.session import written

#: Key of the production query; deployments pass their own.
KEY = "surrogate-key"
#: Attempts after which a surrogate may grow longer, for kinds with few values.
GROW = 12
#: Attempts after which the search for a free surrogate is given up with an error.
MOST_ATTEMPTS = 60

#: Titles before a name and the gender they tell (f, m or u); fixed values.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Don": "m", "Sr": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Lady": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f", "Doña": "f", "Sra": "f",
    "Dr": "u", "Prof": "u", "Professor": "u",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
_NAME = r"[^\W\d_a-zß-ÿа-яё][^\W\d_]*(?:[-'’][^\W\d_]+)*"
PERSON = re.compile(rf"\b({'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.?[ \t]+({_NAME}(?:[ \t]+{_NAME}){{0,2}})")
#: What may stand before an ``@``, dots besides, and the domain behind it.
LOCAL = frozenset(string.ascii_letters + string.digits + "_%+'-.")
DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([^\s\"',;]{5,}[^\s\"',;.])")
#: In order of precedence where they overlap.
NUMERIC = (
    ("key", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("card", re.compile(r"(?<![\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\d-])")),
)
#: A word, with what hyphens and apostrophes tie to it.
WORDS = re.compile(r"(?<!\w)[^\W\d_]+(?:[-'’][^\W\d_]+)*(?!\w)")
PIECE = re.compile(r"[^\W\d_]+")
OWNER = re.compile(r"['’][sS]$")
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnprstvz"


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Where e-mail addresses stand: from each ``@`` back over its local part, whose parts between dots are not empty, and on over its domain."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        local = text[start:at]
        start += local.rfind("..") + 2 if ".." in local else local.startswith(".")
        if start < at and not local.endswith(".") and (domain := DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        at = text.find("@", at + 1)


def _luhn(digits: str) -> int:
    """The check digit that makes ``digits`` valid."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _mod97(iban: str) -> int:
    """The remainder that is 1 for a valid account number."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


#: Checks that numbers of a kind must pass: others of the same form are no personal data.
VALID = {"card": lambda c: _luhn(c[:-1]) == int(c[-1]), "iban": lambda c: _mod97(c) == 1}


class Span(NamedTuple):
    start: int
    stop: int
    kind: str
    canon: str


def detect(text: str | None) -> list[Span]:
    """Personal data in a text: spans that do not overlap, in order, each with its canonical form.

    The canonical form is what decides whether two spellings are one entity: digits alone for
    numbers, lower case for addresses and names. The last name of a person is one entity, each
    name before it another, of the gender that the titles before it in the text tell. Names told
    by a title once are found everywhere else in the text where they begin with a capital.
    """
    if not text:
        return []
    found: list[Span] = []
    found += [Span(a, b, "email", text[a:b].lower()) for a, b in addresses(text)]
    found += [Span(m.start(1), m.end(1), "secret", m.group(1)) for m in SECRET.finditer(text)] if "=" in text or ":" in text else []
    if re.search(r"\d", text):
        for kind, pattern in NUMERIC:
            for m in pattern.finditer(text):
                raw = m.group()
                canon = raw if kind in ("key", "ip") else re.sub(r"[^0-9A-Z]", "", raw)
                if VALID.get(kind, bool)(canon):
                    found.append(Span(m.start(), m.end(), kind, canon))
    surnames: set[str] = set()
    given: dict[str, set[str]] = {}
    if any(t in text for t in TITLES):
        for m in PERSON.finditer(text):
            gender, parts = TITLES[m.group(1)], list(re.finditer(r"\S+", m.group(2)))
            for i, part in enumerate(parts):
                name = OWNER.sub("", part.group())
                at = m.start(2) + part.start()
                if i == len(parts) - 1:
                    surnames.add(name.lower())
                else:
                    given.setdefault(name.lower(), set()).add(gender)
                found.append(Span(at, at + len(name), "surname" if i == len(parts) - 1 else "given", name.lower()))
    order = {k: i for i, k in enumerate(("email", "secret", *(k for k, _ in NUMERIC)))}
    taken: list[Span] = []  # in order and apart, so that only neighbours can overlap a new one
    for s in sorted(found, key=lambda s: (order.get(s.kind, 99), s.start)):
        i = bisect_right(taken, s.start, key=lambda t: t.start)
        if (i == 0 or taken[i - 1].stop <= s.start) and (i == len(taken) or s.stop <= taken[i].start):
            taken.insert(i, s)
    if surnames or given:
        taken = sorted(taken + _bare(text, taken, surnames, given))
    return [s._replace(kind=f"given_{one_gender(given[s.canon])}") if s.kind == "given" else s for s in taken]


def one_gender(told: set[str]) -> str:
    """The gender of a given name: what its titles tell, ``u`` if they tell nothing or both."""
    return next(iter(told - {"u"})) if len(told - {"u"}) == 1 else "u"


def _bare(text: str, taken: list[Span], surnames: set[str], given: dict[str, set[str]]) -> list[Span]:
    """Further mentions of the names, outside what is ``taken``; one that is both given and a surname is given before a surname."""
    starts, out = [s.start for s in taken], []
    for word in WORDS.finditer(text):
        whole = OWNER.sub("", word.group())
        known = [(0, whole)] if whole.lower() in surnames or whole.lower() in given else [(p.start(), p.group()) for p in PIECE.finditer(whole)]
        for at, raw in known:
            name, start, stop = raw.lower(), word.start() + at, word.start() + at + len(raw)
            if raw[0].islower() or (name not in surnames and name not in given):
                continue
            before = bisect_right(starts, stop - 1) - 1
            if before >= 0 and taken[before].stop > start:
                continue
            first = name in given
            if first and name in surnames:
                after = re.compile(r"[ \t]+([^\W\d_]+(?:[-'’][^\W\d_]+)*)").match(text, stop)
                first = after is not None and OWNER.sub("", after.group(1)).lower() in surnames
            out.append(Span(start, stop, "given" if first else "surname", name))
    return out


class _Stream:
    """Keyed pseudo-random choices for one entity and attempt."""

    def __init__(self, key: str, *parts: object):
        self.seed = hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key.encode()[:64], digest_size=32).digest()
        self.block, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.blake2b(self.seed + self.block.to_bytes(8, "big"), digest_size=64).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n

    def pick(self, letters: str) -> str:
        return letters[self.below(len(letters))]

    def like(self, text: str) -> str:
        """Each letter and digit replaced by one of its class, anything else kept."""
        classes = (string.digits, string.ascii_lowercase, string.ascii_uppercase)
        return "".join(next((self.pick(c) for c in classes if x in c), x) for x in text)


def _person(s: _Stream, name: str, kind: str) -> str:
    """A pronounceable lower-case name of the script, about the length, and ending by gender."""
    if re.search("[а-яё]", name):
        vowels, consonants, ends = "аеиоу", "бвгдзклмнпрст", {"f": "а", "m": ""}
    elif re.search("[α-ωάέήίόύώ]", name):
        vowels, consonants, ends = "αεηιου", "βγδκλμνπρστ", {"f": "α", "m": "ς"}
    else:
        vowels, consonants, ends = VOWELS, CONSONANTS, {"f": "a", "m": ""}
    body = "".join(s.pick(consonants) + s.pick(vowels) for _ in range(max(2, min(6, len(name) // 2))))
    end = ends.get(kind.removeprefix("given_"), "")
    return body + s.pick(consonants) + (end if end != "ς" else "ο" + end)


def surrogate(kind: str, canon: str, attempt: int, key: str) -> str:
    """The canonical form of the replacement of an entity, always the same for one key and attempt."""
    s = _Stream(key, kind, canon, attempt)
    more = "".join(s.pick(string.digits) for _ in range(attempt - GROW + 1)) if attempt >= GROW else ""
    if kind == "email":
        local, _, domain = canon.partition("@")
        *labels, top = domain.split(".")
        d = _Stream(key, "domain", domain)
        return f"{s.like(local)}{more}@{'.'.join(d.like(x) for x in labels)}.{top}"
    if kind == "ip":
        if attempt >= GROW:  # those of the same lengths may all be taken
            return ".".join(str(1 + s.below(254)) for _ in range(4))
        ranges = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
        return ".".join(str((r := ranges[len(x)])[0] + s.below(r[1] - r[0] + 1)) for x in canon.split("."))
    if kind == "card":
        body = canon[0] + more + "".join(s.pick(string.digits) for _ in canon[1:-1])
        return body + str(_luhn(body))
    if kind == "phone":
        keep = len(canon) - 10 if len(canon) > 10 else 0
        rest = canon[keep:]
        return canon[:keep] + "".join(s.pick("23456789" if i in (0, 3) else string.digits) for i in range(len(rest))) + more
    if kind == "key":
        return canon[:4] + s.like(canon[4:])
    if kind == "secret" and re.fullmatch("[0-9a-f]+", canon):
        return "".join(s.pick("0123456789abcdef") for _ in canon) + more
    if kind == "iban":
        body = s.like(canon[4:]) + more
        return f"{canon[:2]}{98 - _mod97(f'{canon[:2]}00{body}'):02d}{body}"
    if kind == "surname" or kind.startswith("given_"):
        return _person(s, canon, kind) + "".join(VOWELS[int(x) % 5] for x in more)
    return s.like(canon) + more


def poured(raw: str, kind: str, canon: str) -> str:
    """A canonical surrogate in the spelling of the original: separators, brackets, case."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(canon)
        return "".join(next(rest, "") if c.isdigit() or c.isupper() else c for c in raw) + "".join(rest)
    if kind == "email":
        return canon.upper() if raw.isupper() else "".join(c.upper() if i < len(raw) and raw[i].isupper() else c for i, c in enumerate(canon))
    if kind == "surname" or kind.startswith("given_"):
        return canon.upper() if len(raw) > 1 and raw.isupper() else canon[:1].upper() + canon[1:]
    return canon


def replaced(text: str, attempts: dict[tuple[str, str], int], key: str, given: dict[str, str] | None = None) -> tuple[str, list[Span]]:
    """The text with surrogates in place of its personal data, and the spans they replace.

    ``given`` has the kind of given names to which the corpus gives another gender than this text.
    """
    spans, out, at = detect(text), [], 0
    if given:
        spans = [s._replace(kind=given.get(s.canon, s.kind)) if s.kind.startswith("given_") else s for s in spans]
    for s in spans:
        new = surrogate(s.kind, s.canon, attempts.get((s.kind, s.canon), 0), key)
        out += [text[at : s.start], poured(text[s.start : s.stop], s.kind, new)]
        at = s.stop
    return ("".join([*out, text[at:]]) if spans else text), spans


def entity_spans(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """``columns``, ``kind`` and ``canon`` of every entity of every row, once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at, kind, canon = [], [], []
            texts = batch.column(text_col)
            for i in range(batch.num_rows):
                for k, c in dict.fromkeys((s.kind, s.canon) for s in detect(texts[i].as_py())):
                    at.append(i)
                    kind.append(k)
                    canon.append(c)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in columns), pa.array(kind, pa.string()), pa.array(canon, pa.string())], [*columns, "kind", "canon"])

    wanted = docs.select(*columns, text_col)
    schema = wanted.select(*columns, F.lit("").alias("kind"), F.lit("").alias("canon")).schema
    return wanted.mapInArrow(run, schema)


def with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "canon", "attempt")), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(k, c, a, key) for k, c, a in rows], pa.string())], [*batch.schema.names, "chosen"])

    return entities.select("kind", "canon", "attempt").mapInArrow(run, "kind string, canon string, attempt int, chosen string")


def collision_free(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canon, attempt, chosen``: an attempt per entity such that no two share a surrogate.

    Nor is any surrogate an entity of the corpus. Given names of all genders and surnames are one
    family, as one word may be either. Of those that collide the one of the lowest attempt, then the
    smallest, keeps its surrogate; the others try again, all at once, until none collides. Surrogates
    grow from attempt ``GROW`` on, so that no form runs out.
    """
    family = F.when(F.col("kind").startswith("given") | (F.col("kind") == "surname"), "person").otherwise(F.col("kind"))
    entities = written(entities.select("kind", "canon").distinct())
    state = written(with_surrogates(entities.withColumn("attempt", F.lit(0)), key))
    for _ in range(MOST_ATTEMPTS):
        real = entities.select(family.alias("family"), F.col("canon").alias("chosen"))
        held = state.withColumn("family", family)
        taken = held.join(real, ["family", "chosen"], "left_semi").select("kind", "canon")
        shared = held.groupBy("family", "chosen").agg(F.min(F.struct("attempt", "kind", "canon")).alias("owner"), F.count("*").alias("n")).where("n > 1")
        losers = held.join(shared, ["family", "chosen"]).where("owner.canon <> canon or owner.kind <> kind").select("kind", "canon")
        again = written(taken.unionByName(losers).distinct())
        if again.isEmpty():
            return state
        retry = state.join(again, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        state = written(state.join(again, ["kind", "canon"], "left_anti").unionByName(with_surrogates(retry, key)))
    raise ValueError("no free surrogates are left for some kind of entity")


def resolved_genders(entities: DataFrame) -> DataFrame:
    """``kind, canon, becomes`` of distinct entities: a given name becomes one kind, whatever titles different texts have."""
    told = F.collect_set(F.substring_index("kind", "_", -1))
    sexes = F.array_except("told", F.array(F.lit("u")))
    names = entities.where("kind like 'given%'").groupBy("canon").agg(told.alias("told"))
    names = names.select("canon", F.concat(F.lit("given_"), F.when(F.size(sexes) == 1, F.get(sexes, F.lit(0))).otherwise("u")).alias("becomes"))
    rest = entities.where("kind not like 'given%'").select("kind", "canon", F.col("kind").alias("becomes"))
    return rest.unionByName(entities.where("kind like 'given%'").join(names, "canon").select("kind", "canon", "becomes"))


def pseudonymize(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col``; ``found_col``, if given, gets the kinds replaced.

    One entity has one surrogate throughout the corpus and in every run with the same key, two
    entities never share one, and none is an entity that occurs. Rows without personal data, and null
    or empty texts, stay as they are. Replacing is done where a text is read; only entities whose
    first surrogate collided, and given names whose gender other texts tell otherwise, are sent to
    the rows that hold them. Repeated rows and rows of one id are replaced alike; a very long text
    is one row of a small batch; an empty table gives no rows; other columns stay, whatever their names.
    """
    rows = docs
    mark, extra = fresh(docs, "row_mark"), fresh(docs, "row_attempts")
    entities = cut(entity_spans(docs.select(F.col(text_col)), [], text_col).distinct())
    named = not entities.where("kind like 'given%'").isEmpty()
    entities = cut(resolved_genders(entities)) if named else entities.withColumn("becomes", F.col("kind"))
    settled = collision_free(entities.select(F.col("becomes").alias("kind"), "canon"), key)
    moved = settled.where("attempt > 0").select(F.col("kind").alias("becomes"), "canon", "attempt")
    if named:
        moved = entities.join(moved, ["becomes", "canon"], "left").where("attempt is not null or kind <> becomes").select("kind", "canon", F.coalesce("attempt", F.lit(0)).alias("attempt"), "becomes")
    else:
        moved = moved.select(F.col("becomes").alias("kind"), "canon", "attempt", "becomes")
    moved = cut(moved)
    retried = not moved.isEmpty()
    if retried:
        rows = docs.withColumn(mark, F.xxhash64(F.col(id_col), F.col(text_col)))
        spans = entity_spans(rows, [mark], text_col)
        due = join_small(spans, moved, ["kind", "canon"]).groupBy(mark).agg(F.collect_set(F.struct("kind", "canon", "attempt", "becomes")).alias(extra))
        rows = join_small(rows, due, mark, "left").drop(mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names = batch.schema.names
            texts = batch.column(text_col)
            due = batch.column(extra).to_pylist() if retried else [None] * batch.num_rows
            new, kinds = [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                attempts = {(x["becomes"], x["canon"]): x["attempt"] for x in due[i] or ()}
                given = {x["canon"]: x["becomes"] for x in due[i] or () if x["kind"] != x["becomes"]}
                made, spans = replaced(text, attempts, key, given) if text else (text, [])
                new.append(made)
                kinds.append([s.kind for s in spans])
            columns = {n: batch.column(n) for n in names if n != extra} | {text_col: pa.array(new, pa.string())}
            if found_col:
                columns[found_col] = pa.array(kinds, pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(columns)

    shape = docs.withColumn(found_col, F.array(F.lit(""))) if found_col else docs
    return rows.select(*docs.columns, *[extra] * retried).mapInArrow(run, shape.schema)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, found_col="kinds").select("doc_id", "text", F.size("kinds").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))
