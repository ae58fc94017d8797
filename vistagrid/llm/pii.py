"""PII surrogates: keyed replacements of the same type and format, distinct for distinct entities, in DataFrame operations only.

Entities are found by one alternation, so they never overlap. An entity is a kind and a normal form (digits of a number,
lower case of an address or name); its surrogate comes from a SHA-256 of key, kind, normal form and attempt, so the same
entity gets the same surrogate in every document. Surrogates of all entities are compared: one that equals a real entity
or the surrogate of another entity goes on to its next attempt until none is left. Numbers keep their separators and
length, cards a valid check digit, phones their country code, addresses of hosts stay addresses (in a reserved range),
mail domains end in a reserved name. Names after a title keep title, gender and script; given name and surname are
entities of their own, so a later mention by surname alone stays the same person.

Defined cases: null texts stay null; texts without entities stay as they are; copies of a text are searched once;
repeated rows are treated alike; all input columns pass through, except those the operator writes itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistagrid.llm.common import reliable, table
from vistagrid.llm.registry import query
from vistagrid.llm.spans import located, matches, rebuilt, text_key

MALE = {"latin": ["Mr", "Herr", "Señor", "Monsieur", "Sig", "Signor"], "cyrillic": ["Господин", "Г-н"]}
FEMALE = {"latin": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Signora"], "cyrillic": ["Госпожа", "Г-жа"]}
TITLES = [t for by in (MALE, FEMALE) for words in by.values() for t in words]
NAME = r"\p{Lu}[\p{L}'’-]+"
# kind: regex; the order is the order of the alternation. Groups repeat a bounded number of times (a host name has at most 127
# labels), because the JVM matches an unbounded repeated group by recursion and long texts would exhaust its stack.
KINDS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]*[\p{L}0-9_%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])",
    "card": r"(?<![0-9A-Za-z+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}0-9])(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? {NAME}(?: {NAME})?",
}
# Least form of every kind, any of which lets a text pass to the search.
LEAST = {"email": r"@[A-Za-z0-9-]", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "ip": r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]", "number": r"[0-9](?:[ ().-]{0,2}[0-9]){6}",
         "phone": r"\+[0-9](?:[ ().-]{0,2}[0-9]){4}", "name": rf"(?:{'|'.join(TITLES)})\.? \p{{Lu}}"}
GATE = "|".join(LEAST.values())
ALL = "|".join(f"(?:{rx})" for rx in KINDS.values())
# Syllables of made-up names: start, middle, and endings by gender ('' for surnames).
SYLLABLES = {
    "latin": (["Al", "Ber", "Cor", "Dan", "El", "Fer", "Gal", "Hol", "Ir", "Jo", "Kel", "Lor", "Mar", "Nor", "Or", "Per", "Quin", "Ros", "Sal", "Tor", "Ul", "Ver", "Wil", "Zan"],
              ["ba", "ce", "di", "fo", "ge", "hi", "ke", "la", "mi", "no", "pe", "ra", "se", "ti", "vo", "ze"], {"m": ["n", "rt", "s", "x"], "f": ["a", "lla", "ne", "tte"], "": ["sen", "ton", "berg", "man"]}),
    "cyrillic": (["Ал", "Бор", "Вер", "Гал", "Дан", "Ев", "Зор", "Ил", "Кал", "Лад", "Мир", "Нор", "Ол", "Пол", "Рад", "Сав"],
                 ["ба", "ве", "ди", "ко", "ла", "ми", "но", "ра", "се", "та"], {"m": ["н", "р", "слав", "й"], "f": ["на", "ра", "я", "ша"], "": ["нко", "вич", "ских", "люк"]}),
}
DIGITS = r"[^0-9]"


def digest(key: str, entity: Column, kind: Column, attempt: Column, salt: str = "") -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string"), F.lit(salt)), 256)


def _number(hashed: Column, first: int, bound: int) -> Column:
    """A number below `bound` from eight hex digits of a digest."""
    return F.pmod(F.conv(F.substring(hashed, first, 8), 16, 10).cast("bigint"), F.lit(bound))


def _digits(key: str, norm: Column, kind: Column, attempt: Column) -> Column:
    """Some 60 decimal digits of two digests, with leading digits in case of few."""
    parts = [F.regexp_replace(digest(key, norm, kind, attempt, s), "[a-f]", "") for s in ("a", "b")]
    return F.rpad(F.concat(*parts), 64, "7")


def check_digit(body: Column) -> Column:
    """Luhn check digit of a string of digits."""
    places = F.reverse(F.split(body, ""))
    total = F.aggregate(F.transform(places, lambda c, i: F.when(i % 2 == 0, F.floor(c.cast("int") * 2 / 10) + (c.cast("int") * 2) % 10).otherwise(c.cast("int"))),
                        F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return ((10 - total % 10) % 10).cast("string")


def _name(hashed: Column, script: str, gender: str, attempt: Column) -> Column:
    start, middle, ends = SYLLABLES[script]
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (_number(hashed, at, len(words)) + 1).cast("int"))
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.floor(attempt / 2).cast("int") + 2), lambda k: F.when(
        k <= 1 + F.floor(attempt / 2), F.element_at(F.array(*[F.lit(w) for w in middle]), (F.pmod(F.conv(F.substring(F.sha2(F.concat(hashed, k.cast("string")), 256), 1, 8), 16, 10).cast(
            "bigint"), F.lit(len(middle))) + 1).cast("int"))).otherwise("")), "")
    return F.concat(pick(start, 1), more, pick(ends[gender], 17))


def proposal(key: str) -> Column:
    """Surrogate normal form of columns kind, norm, attempt."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")
    numbers = _digits(key, norm, kind, attempt)
    hashed = digest(key, norm, kind, attempt)
    length = F.length(norm)
    body = F.concat(F.substring(norm, 1, 1), F.substring(numbers, F.lit(1), length - 2))
    country = F.regexp_extract(norm, r"^\+([0-9]{1,3}) ", 1)
    local = F.length(F.regexp_extract(norm, r"([0-9]+)$", 1))
    phone = F.concat(F.when(country != "", F.concat(F.lit("+"), country, F.lit(" "))).otherwise(""), F.substring(numbers, F.lit(1), local))
    host = F.concat_ws(".", F.lit(240) + _number(hashed, 1, 15), *[_number(hashed, 1 + 8 * k, 256) for k in (1, 2, 3)])
    letters = F.translate(F.substring(hashed, 1, 10), "0123456789", "ghijklmnop")
    mail = F.concat(letters, F.lit("@mail-"), F.substring(hashed, 41, 6), F.lit(".example"))
    iban = F.concat(F.substring(norm, 1, 2), F.substring(numbers, F.lit(1), length - 2))
    out = F.when(kind == "email", mail).when(kind == "ip", host).when(kind == "card", F.concat(body, check_digit(body))).when(kind == "phone", phone).when(kind == "iban", iban)
    for script in SYLLABLES:
        for gender in ("m", "f", ""):
            out = out.when(kind == f"{'given' if gender else 'surname'}:{script}:{gender}", _name(hashed, script, gender, attempt))
    return out.otherwise(F.substring(numbers, F.lit(1), length))


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, new) of distinct (kind, norm): rounds of proposals until no surrogate is shared or equals a real entity.

    Of entities with one proposal the smallest keeps it. Every round works on what is left, so few entities repeat.
    """
    known = reliable(entities.select("kind", "norm").distinct())
    real = known.select("kind", F.lower("norm").alias("low"))
    open_, done, attempt = known, None, 0
    while True:
        tried = open_.withColumn("attempt", F.lit(attempt)).withColumn("new", proposal(key)).withColumn("low", F.lower("new"))
        # Names of both genders share what they must differ in: the kind.
        free = tried.join(real, ["kind", "low"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", F.lower("new").alias("low")), ["kind", "low"], "left_anti")
        won = free.groupBy("kind", "low").agg(F.min("norm").alias("norm"), F.min_by("new", "norm").alias("new")).select("kind", "norm", "new")
        done = reliable(won if done is None else done.unionByName(won))
        open_ = reliable(open_.join(done, ["kind", "norm"], "left_anti"))
        if open_.isEmpty():
            return done
        attempt += 1


def _kind(value: Column) -> Column:
    return F.coalesce(*[F.when(F.rlike(value, F.lit(f"^(?:{rx})$")), kind) for kind, rx in KINDS.items()])


def _among(value: Column, words: list[str]) -> Column:
    return F.rlike(value, F.lit(rf"^(?:{'|'.join(words)})\b"))


def _norm(kind: Column, value: Column) -> Column:
    country = F.regexp_extract(value, r"^\+([0-9]{1,3})", 1)
    phone = F.when(country != "", F.concat(F.lit("+"), country, F.lit(" "), F.substring(F.regexp_replace(value, DIGITS, ""), F.length(country) + 1, F.lit(40)))).otherwise(
        F.regexp_replace(value, DIGITS, ""))
    return F.when(kind.isin("card", "ssn"), F.regexp_replace(value, DIGITS, "")).when(kind == "phone", phone).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).otherwise(
        F.lower(value))


def mentions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, value, kind, parts) of all entities of distinct texts; parts are the (kind, norm) to replace."""
    found = texts.select(key, matches(F.col(text), F.lit(ALL)).alias("hits")).where(F.size("hits") > 0)
    rows = located(found, [key], "hits").withColumn("kind", _kind(F.col("value"))).where("kind is not null")
    words = F.split("value", " ")
    script = F.when(F.rlike("value", F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")
    gender = F.when(_among(F.col("value"), [t for w in FEMALE.values() for t in w]), "f").otherwise("m")
    surname = F.struct(F.concat_ws(":", F.lit("surname"), script, F.lit("")).alias("kind"), F.lower(F.element_at(words, -1)).alias("norm"))
    given = F.struct(F.concat_ws(":", F.lit("given"), script, gender).alias("kind"), F.lower(F.get(words, F.lit(1))).alias("norm"))
    single = F.struct(F.col("kind").alias("kind"), _norm(F.col("kind"), F.col("value")).alias("norm"))
    parts = F.when(F.col("kind") != "name", F.array(single)).when(F.size(words) > 2, F.array(given, surname)).otherwise(F.array(surname))
    return rows.withColumn("parts", parts)


def formatted(value: Column, new: Column) -> Column:
    """Characters of `new` put in the places of the letters and digits of `value`; separators stay."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    filled = F.aggregate(F.split(value, ""), state, lambda acc, c: F.when(
        F.rlike(c, F.lit("[0-9A-Za-z]")), F.struct(F.concat(acc["out"], F.substring(new, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(
        F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))))
    return filled["out"]


def surrogates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Input rows with the entities of the text replaced, and `n_entities`, `entities`: (start, end, kind, new) in the input text.

    Texts without a candidate pass on where they are read; the others travel once, by the digest of the text.
    """
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_entities", "entities")])
    gate = F.coalesce(F.rlike(F.col(text), F.lit(GATE)), F.lit(False))
    marked = own.where(gate).withColumn("__key", text_key(F.col(text)))
    texts = marked.groupBy("__key").agg(F.first(text).alias("__text"))
    found = reliable(mentions(texts, "__key", "__text"))
    parts = found.select("__key", "start", "end", "value", F.col("kind").alias("type"), F.posexplode("parts").alias("place", "p")).select(
        "__key", "start", "end", "value", "type", "place", "p.kind", "p.norm")
    table_ = assigned(parts, key)
    named = parts.join(table_, ["kind", "norm"]).groupBy("__key", "start", "end", "value", "type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda s: s["new"]), " ").alias("new"))
    plain = F.regexp_replace("new", r"[^0-9A-Za-z]", "")
    new = F.when(F.col("type").isin("email", "ip"), F.col("new")).when(
        F.col("type") == "name", F.concat(F.regexp_extract("value", r"^(\S+) ", 1), F.lit(" "), F.col("new"))).otherwise(formatted(F.col("value"), plain))
    spans = named.select("__key", "start", "end", "type", new.alias("new")).groupBy("__key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.col("type").alias("kind"), "new"))).alias("entities"))
    joined = marked.join(spans, "__key", "left").drop("__key")
    empty = F.array().cast(spans.schema["entities"].dataType)
    changed = joined.withColumn("entities", F.coalesce("entities", empty)).withColumn(text, F.when(F.size("entities") > 0, rebuilt(F.col(text), F.col("entities"))).otherwise(F.col(text)))
    clean = own.where(~gate).withColumn("entities", empty)
    return clean.unionByName(changed).withColumn("n_entities", F.size("entities").cast("bigint"))


@query("op1_pii_surrogates")
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), key="vistagrid")
    kinds = F.transform("entities", lambda e: e["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    return out.select("doc_id", "text", "n_entities", *counts, spans.alias("spans"))
