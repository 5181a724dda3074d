"""Personal data: detected entities become keyed surrogates of the same kind and format.

An entity counts by its canonical form: a mail address in lower case, numbers by their digits, a bank account without
spaces, a name word by word. So one person, address or number has one surrogate however it is written, and each
mention gets that surrogate in the mention's own format. Distinct entities of the whole table are a table of their own. A
surrogate is drawn from a keyed hash of (kind, entity, attempt). Where several entities draw one surrogate, or a surrogate is a
real entity of the table, all but one of those draw again, and only those.

Texts without any sign of an entity are never shuffled.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from classtilt.llm.common import whole
from classtilt.llm.token_counts import utf8
from classtilt.session import cut

#: Forms of address by the gender that they tell ("" if none). The name after one is an entity.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m",
    "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sra": "f", "Sr": "m", "Don": "m", "Doña": "f", "г-н": "m", "г-жа": "f",
}

_NAME = r"[^\W\d_a-z][^\W\d_]+(?:[-'’][^\W\d_]+)*"
#: Kinds in the order in which they are looked for; an earlier kind keeps its place in the text. Group 1 is the entity.
KINDS = {
    "email": r"((?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)",
    "aws_key": r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b",
    "password": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?)([^\s\"',;]+)",
    "hex_secret": r"\b((?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,})\b",
    "iban": r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b",
    "ip": r"(?<![\w.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\w)",
    "card": r"(?<![\w-])(\d{4}([ -]?)\d{4}\2\d{4}\2\d{4}|3[47]\d{2}([ -]?)\d{6}\3\d{5})(?![\w-])",
    "ssn": r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])",
    "phone": r"(?<![\w+])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "name": rf"\b(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.? ({_NAME}(?: {_NAME}){{0,2}})",
}
PATTERNS = {kind: re.compile(p) for kind, p in KINDS.items()}
#: A text without any of these holds no entity.
SIGN = r"[0-9@=:]|\b(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\b"
_TITLE = re.compile(rf"\b({'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.? $")

CONSONANTS = {"LATIN": "bcdfghjklmnprstvz", "CYRILLIC": "бвгджзклмнпрстфх", "GREEK": "βγδζθκλμνπρστφχ"}
VOWELS = {"LATIN": "aeiou", "CYRILLIC": "аеиоу", "GREEK": "αεηιο"}
ENDINGS = {"f": {"LATIN": "a", "CYRILLIC": "а", "GREEK": "α"}, "m": {"LATIN": "o", "CYRILLIC": "ов", "GREEK": "ος"}}
#: Country calling codes of one and of two digits (E.164); all others have three. Fixed values.
ONE_DIGIT_CODES = ("1", "7")
TWO_DIGIT_CODES = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53",
    "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
#: What a secret's letters, digits and other characters are drawn from.
SECRET_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!#%&*+-?@^_~")
#: Kinds whose mentions differ in separators only: the surrogate's letters and digits are put into the mention.
POURED = ("phone", "card", "ssn", "iban")


@cache
def _letters() -> dict[tuple[str, str], str]:
    """Letters of the basic plane by script, as their Unicode names tell it, and category."""

    found: dict[tuple[str, str], list[str]] = {}
    for code in range(0x80, 0x10000):
        c = chr(code)
        if (category := unicodedata.category(c)) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(c):
            found.setdefault((_script(c), category), []).append(c)
    return {k: "".join(v) for k, v in found.items()}


def _script(c: str) -> str:
    return unicodedata.name(c, "OTHER").split(" ")[0].split("-")[0]


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) in order, none overlapping. A name's kind carries gender: name, name:m or name:f."""

    taken: list[tuple[int, int, str, str]] = []
    digits, at_sign = any(c in text for c in "0123456789"), "@" in text
    for kind, pattern in PATTERNS.items():
        if kind == "email" and not at_sign or kind in ("ip", "card", "ssn", "phone", "iban", "aws_key", "hex_secret") and not digits:
            continue
        for m in pattern.finditer(text):
            start, end = m.span(1)
            label = kind
            if kind == "email":
                end -= len(m[1]) - len(m[1].rstrip(".-"))
            elif kind == "password":
                end -= len(m[1]) - len(m[1].rstrip(".)]}"))
            elif kind == "phone" and sum(c.isdigit() for c in m[1]) < 7:
                continue
            elif kind == "name":
                title = _TITLE.search(text[max(0, m.start() - 1) : start])
                label = f"name:{g}" if (g := TITLES[title[1]] if title else "") else "name"
            if start < end and not any(a < end and start < b for a, b, _, _ in taken):
                taken.append((start, end, label, text[start:end]))
    # A name of several words that a title has shown is the same person where it stands without one.
    for kind, name in {(k, e) for _, _, k, e in taken if k.startswith("name") and " " in e}:
        for m in re.finditer(rf"\b{re.escape(name)}\b", text):
            if not any(a < m.end() and m.start() < b for a, b, _, _ in taken):
                taken.append((*m.span(), kind, name))
    return sorted(taken)


def canonical(kind: str, entity: str) -> list[tuple[str, str, str]]:
    """What the table holds for a mention: (kind, canonical form, gender), for a name one row a word.

    Of a name with several words all but the last are given names, and carry the gender that the title tells.
    """

    kind, _, gender = kind.partition(":")
    if kind == "name":
        words = entity.split(" ")
        return [(kind, w.casefold(), gender if i < len(words) - 1 else "") for i, w in enumerate(words)]
    if kind == "email":
        entity = entity.lower()
    elif kind == "iban":
        entity = entity.replace(" ", "")
    elif kind in POURED:
        entity = "+" * entity.startswith("+") + "".join(c for c in entity if c.isdigit())
    return [(kind, entity, "")]


def rendered(kind: str, entity: str, known: dict[str, str]) -> str:
    """The mention's replacement: the surrogate of its canonical form, written as the mention is."""

    new = [known[f"{k}\t{e}"] for k, e, _ in canonical(kind, entity)]
    if kind.startswith("name"):
        words = zip(entity.split(" "), new, strict=True)
        return " ".join(n.upper() if w.isupper() and len(w) > 1 else re.sub(r"(^|[-'’])(.)", lambda m: m[1] + m[2].upper(), n) for w, n in words)
    if kind in POURED:
        fresh = iter(c for c in new[0] if c.isalnum())
        return "".join(next(fresh) if c.isalnum() else c for c in entity)
    if kind == "email" and entity.isupper():
        return new[0].upper()
    return new[0]


class _Draws:
    """An endless keyed stream of small numbers."""

    def __init__(self, key: bytes, *parts: object):
        self.seed, self.n, self.held = hmac.new(key, repr(parts).encode(), hashlib.sha256).digest(), 0, b""

    def below(self, limit: int) -> int:
        if len(self.held) < 4:
            self.held += hashlib.sha256(self.seed + self.n.to_bytes(8, "big")).digest()
            self.n += 1
        value, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return value % limit


def _alike(text: str, draws: _Draws, hexadecimal: bool = False) -> str:
    """Every letter and digit anew, of the same script and case; separators as they were."""

    out = []
    for c in text:
        if c.isdecimal():  # of any script
            out.append(chr(ord(c) - int(c) + draws.below(10)))
        elif hexadecimal and c in "abcdef":
            out.append("abcdef"[draws.below(6)])
        elif c.isalpha():
            script = _script(c)
            if script in CONSONANTS:
                letters = CONSONANTS[script] + VOWELS[script]
            else:
                letters = _letters().get((script, unicodedata.category(c))) or SECRET_CLASSES[0]
            new = letters[draws.below(len(letters))]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _secret(text: str, draws: _Draws) -> str:
    """As long, nothing of the old text: characters are drawn from the whole class, those of other scripts as small letters."""

    lower, upper, digits, marks = SECRET_CLASSES
    classes = (upper if c.isupper() else digits if c.isdigit() else lower if c.isalpha() else marks for c in text)
    return "".join(own[draws.below(len(own))] for own in classes)


def _mod97(account: str) -> int:
    """Of a bank account with its first four characters put last, letters as 10 to 35."""

    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _luhn(digits: list[int]) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(reversed(digits))) % 10


def _name_word(word: str, gender: str, attempt: int, draws: _Draws) -> str:
    """A folded name word anew, in its own script, hyphens and apostrophes where they were."""

    parts = re.split(r"([-'’])", word)
    for i in range(0, len(parts), 2):
        script = _script(parts[i][:1] or "a")
        if script in CONSONANTS:
            size = max(2, (len(parts[i]) + 1) // 2) + attempt
            letters = (CONSONANTS[script], VOWELS[script])
            new = "".join(side[draws.below(len(side))] for _ in range(size) for side in letters)
            parts[i] = new[:-1] + ENDINGS[gender][script] if gender and i == len(parts) - 1 else new
        else:
            parts[i] = _alike(parts[i] + parts[i][-1:] * attempt, draws)
    return "".join(parts)


def surrogate(key: bytes, kind: str, entity: str, gender: str = "", attempt: int = 0) -> str:
    """The replacement of a canonical entity at this attempt: same kind, same format, decided by the key."""

    draws = _Draws(key, kind, entity, attempt)
    longer = "a" * (attempt // 8)  # where short formats are full
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        labels = domain.split(".")
        # One domain has one surrogate, so addresses of one host stay together; the last label is kept.
        own = _alike(".".join(labels[:-1]), _Draws(key, "domain", domain))
        return f"{_alike(local + longer, draws)}@{own}.{labels[-1]}"
    if kind == "ip":
        if attempt >= 16:  # too many addresses of these lengths are real
            return ".".join(str(draws.below(255) + 1) for _ in range(4))
        return ".".join(str([draws.below(9) + 1, draws.below(90) + 10, draws.below(156) + 100][len(p) - 1]) for p in entity.split("."))
    if kind == "card":
        digits = [int(c) for c in entity]
        new = digits[:1] + [draws.below(10) for _ in digits[1:]]
        if _luhn(digits) == 0:  # a valid number stays valid
            new[-1] = 0
            new[-1] = -_luhn(new) % 10
        return "".join(map(str, new))
    if kind == "phone" and entity.startswith("+"):
        digits = entity[1:]
        code = 1 if digits[:1] in ONE_DIGIT_CODES else 2 if digits[:2] in TWO_DIGIT_CODES else 3
        return entity[: 1 + code] + _alike(entity[1 + code :], draws)
    if kind == "aws_key":
        body = (chr(65 + draws.below(26)) if c.isalpha() else str(draws.below(10)) for c in entity[4:])
        return entity[:4] + "".join(body)
    if kind == "iban":
        new = entity[:2] + _alike(entity[2:], draws)
        if _mod97(entity) == 1:  # a valid account stays valid
            new = new[:2] + f"{98 - _mod97(new[:2] + '00' + new[4:]):02d}" + new[4:]
        return new
    if kind == "hex_secret":
        return _alike(entity, draws, hexadecimal=True)
    if kind == "password":
        return _secret(entity + longer, draws)
    if kind == "name":
        return _name_word(entity, gender, attempt, draws)
    return _alike(entity, draws)


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[int] = []
        found: list[tuple[str, str, str]] = []
        for row, text in enumerate(utf8(batch.column(2))):
            own = {x for _, _, k, e in entities(text.decode()) for x in canonical(k, e)}
            rows += [row] * len(own)
            found += own
        at = pa.array(rows, pa.int64())
        columns = [batch.column(0).take(at), batch.column(1).take(at)]
        columns += [pa.array(c, pa.string()) for c in (list(zip(*found, strict=True)) or [[], [], []])]
        yield pa.record_batch(columns, ["_id", "_hash", "kind", "entity", "gender"])


def surrogate_table(found: DataFrame, key: str, most: int = 64) -> DataFrame:
    """Distinct (kind, entity) of ``found`` (kind, entity, gender) with surrogate.

    The gender of a given name is the one that its titles agree on. Each round draws for the open entities only; ``most``
    rounds without an end raise an error: then a format has no room for so many entities.
    """

    secret = key.encode()

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, entity: pd.Series, gender: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(secret, *row) for row in zip(kind, entity, gender, attempt.tolist(), strict=True)], dtype=object)

    told = F.when(F.col("gender") != "", F.col("gender"))
    agreed = F.coalesce(F.when(F.min(told) == F.max(told), F.min(told)), F.lit(""))
    table = cut(found.groupBy("kind", "entity").agg(agreed.alias("gender")))
    real = table.select("kind", F.col("entity").alias("surrogate"))
    settled, waiting = None, table
    for attempt in range(most):
        tries = cut(waiting.withColumn("surrogate", drawn("kind", "entity", "gender", F.lit(attempt))))
        owner = tries.groupBy("kind", "surrogate").agg(F.min("entity").alias("owner"))
        free = tries.join(owner, ["kind", "surrogate"]).filter("entity = owner").drop("owner")
        free = free.join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["kind", "surrogate"], "left_anti")
        free = cut(free.select("kind", "entity", "surrogate"))
        settled = free if settled is None else settled.unionByName(free)
        waiting = cut(waiting.join(free, ["kind", "entity"], "left_anti"))
        if waiting.isEmpty():
            return settled
    raise RuntimeError("surrogates still clash; the formats have no room for this many entities")


def surrogate_key(spark: SparkSession) -> str:
    """The secret in the setting ``spark.classtilt.surrogateKey``; without it, one drawn for this call and never shown."""

    return spark.conf.get("spark.classtilt.surrogateKey", None) or secrets.token_hex(32)


def replace_entities(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_entities"
) -> DataFrame:
    """``docs`` with every detected entity replaced, all columns kept, and a column ``count_col`` (occurrences) after them.

    A column n_chars is set to the new text's length; a column that is named like ``count_col`` is replaced, and None adds
    none. Texts without entities, null and empty ones included, stay as they are. Rows that share id and text get the
    same text; an empty table gives an empty result. ``key`` decides all draws: keep it secret, and use one key for
    tables whose entities must agree.
    """

    if not key:
        raise ValueError("a key is needed: anyone who knows it can replay the surrogates")
    text = F.col(text_col)
    signed = F.coalesce(text.rlike(SIGN), F.lit(False))
    with_signs = docs.filter(signed)
    keyed = with_signs.select(F.col(id_col).cast("string").alias("_id"), F.xxhash64(text).alias("_hash"), whole(text).alias("_text"))
    found = cut(keyed.mapInArrow(_detect, "_id string, _hash long, kind string, entity string, gender string").distinct())
    table = surrogate_table(found.select("kind", "entity", "gender"), key)
    # A document's own map: as large as what the document holds.
    maps = (
        found.select("_id", "_hash", "kind", "entity").distinct().join(table, ["kind", "entity"])
        .groupBy("_id", "_hash")
        .agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\t", "kind", "entity"), "surrogate"))).alias("_map"))
    )

    @F.pandas_udf("text string, n long")
    def rewritten(texts: pd.Series, known: pd.Series) -> pd.DataFrame:
        out, counts = [], []
        for old, own in zip(texts, known, strict=True):
            own, at, parts, spans = dict(own if own is not None else ()), 0, [], entities(old)
            for start, end, kind, entity in spans:
                parts += [old[at:start], rendered(kind, entity, own)]
                at = end
            out.append("".join(parts) + old[at:])
            counts.append(len(spans))
        return pd.DataFrame({"text": out, "n": counts})

    # Rows travel as one struct, so their columns cannot clash with the map's.
    joined = with_signs.select(
        F.struct(*docs.columns).alias("row"), text.alias("old"), F.col(id_col).cast("string").alias("id"), F.xxhash64(text).alias("hash")
    )
    joined = joined.join(maps, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    changed = joined.select("row", rewritten("old", "_map").alias("new"))

    def column(name: str) -> Column:
        old = F.col("row").getField(name)
        if name == text_col:
            return F.col("new.text").alias(name)
        if name == "n_chars":
            kind = docs.schema[name].dataType
            return F.when(F.col("new.n") > 0, F.char_length("new.text")).otherwise(old).cast(kind).alias(name)
        return old.alias(name)

    kept = [c for c in docs.columns if count_col is None or c.lower() != count_col.lower()]
    counts = [] if count_col is None else [F.col("new.n").alias(count_col)]
    changed = changed.select(*[column(c) for c in kept], *counts)
    rest = docs.filter(~signed).select(*[F.col(f"`{c}`") for c in kept], *([] if count_col is None else [F.lit(0).cast("long").alias(count_col)]))
    return rest.unionByName(changed)
