"""Surrogates for personal data: detected entities get keyed replacements of their own kind.

Every mention is brought to a canonical form, and a keyed hash of that form makes the
surrogate: digits for digits, letters for letters of the same script and case, valid
octets, card numbers whose check digit holds if it held before, given names of the same
gender and script. The mention's own punctuation, spacing and capitals are kept. As the
surrogate depends on nothing else, mentions of one entity agree across all documents.

Collisions are looked for over all entities of the corpus: a surrogate that two entities
share, or that is itself an entity, is given up by all but the first, and they try again
with another hash. Only those few attempts are joined back to the documents; all other
surrogates are computed in place. Only DataFrame functions are used.

Names are found behind a listed given name, or behind a title or phrase of ``TITLES``; a
family name alone gets one. Card numbers are four groups of four digits, or 13 to 19 digits
whose check digit holds. The key is the caller's secret: whoever knows it can repeat the
surrogates of guessed entities, so there is no default.

Defined results: null texts stay null and clean texts stay as they are; repeated rows get
equal results, and so do mentions in rows without an id; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.joins import BROADCAST_ROWS, lookup_join
from footfall.session import stage

# Given names by gender and script, and family names by script and gender.
GIVEN = {
    "female_latin": "Alice Barbara Carol Diana Emily Fiona Grace Hannah Irene Julia Karen Laura Martha Nancy Olivia Paula Rachel Sarah Teresa Victoria",
    "male_latin": "Albert Brian Charles Daniel Edward Frank George Henry Isaac James Kevin Lewis Michael Norman Oliver Peter Robert Samuel Thomas William",
    "female_cyrillic": "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна",
    "male_cyrillic": "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей",
    "any_latin": "Alex Casey Jamie Jordan Morgan Quincy Robin Terry",
}
FAMILY = {
    "female_latin": "Adams Baker Carter Davis Evans Foster Green Harris Jackson Kelly Lawson Miller Nelson Parker Quinn Roberts Stewart Taylor Walker Young",
    "male_latin": "Adams Baker Carter Davis Evans Foster Green Harris Jackson Kelly Lawson Miller Nelson Parker Quinn Roberts Stewart Taylor Walker Young",
    "female_cyrillic": "Белова Волкова Голубева Зайцева Козлова Морозова Новикова Орлова Павлова Смирнова",
    "male_cyrillic": "Белов Волков Голубев Зайцев Козлов Морозов Новиков Орлов Павлов Смирнов",
    "any_latin": "Adams Baker Carter Davis Evans Foster Green Harris Jackson Kelly Lawson Miller Nelson Parker Quinn Roberts Stewart Taylor Walker Young",
}
# Titles and phrases in front of a name, with the gender that they carry. A name behind one needs no list.
TITLES = {
    "female_latin": "Mrs|Ms|Miss|Madam|Mme|Lady",
    "male_latin": "Mr|Mister|Sir|Lord",
    "female_cyrillic": "[Гг]оспожа|[Гг]-жа",
    "male_cyrillic": "[Гг]осподин|[Гг]-н",
    "any_latin": "Dr|Doctor|Prof|Professor|[Nn]ame is|[Ss]igned by",
}
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NAMES = {group: "|".join(names.split()) for group, names in GIVEN.items()}
_TITLES = {group: f"(?:{titles})\\.?\\x20+" for group, titles in TITLES.items()}
_TITLE = "|".join(_TITLES.values())
_WORD = "\\p{Lu}\\p{Ll}+(?:-\\p{Lu}\\p{Ll}+)*"
PATTERNS = {
    "email": "(?<![\\p{L}0-9._%+-])[\\p{L}0-9._%+-]++@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}(?![A-Za-z])",
    "ip": f"(?<![0-9A-Za-z.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9A-Za-z]|\\.[0-9])",
    "card": "(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9A-Za-z])",
    "ssn": "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": "(?<![0-9A-Za-z+])(?:\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{2,4}\\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}|\\([0-9]{3}\\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "iban": "(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    **{f"name_{group}": f"(?<!\\p{{L}})(?:(?:{_TITLES[group]})(?:{_WORD}\\x20+)?|(?:{names})\\x20+){_WORD}(?!\\p{{L}})" for group, names in _NAMES.items()},
}
KINDS = tuple(PATTERNS)
# Other lengths of card numbers count only if their check digit holds.
LONG_CARD = "(?<![0-9A-Za-z])(?:[0-9]{13,19}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
ANY = "|".join([*PATTERNS.values(), LONG_CARD])
# A text with no digit, no @ and no given name or title in front of a capital holds no mention.
NAMED = f"(?=[A-Zns\\u0410-\\u042F\\u0433])(?<!\\p{{L}})(?:(?:{'|'.join(_NAMES.values())})\\x20+|{_TITLE})\\p{{Lu}}"
# Letters that stand in for letters, by script and case.
ALPHABETS = {
    "[0-9]": "0123456789",
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[\\p{IsLatin}&&\\p{Ll}]": "àâäçèéêëíîïñóôöùúûü",
    "[\\p{IsLatin}&&\\p{Lu}]": "ÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ",
    "[\\p{IsCyrillic}&&\\p{Ll}]": "абвгдежзиклмнопрстуфхцчшэюя",
    "[\\p{IsGreek}&&\\p{Ll}]": "αβγδεζηθικλμνξοπρστυφχψω",
}


def mentions(text: Column) -> Column:
    """Detected mentions in order, as they stand in the text; cheap for texts that cannot hold any."""
    possible = text.contains("@") | text.rlike("[0-9]") | text.rlike(NAMED)
    none = F.array().cast("array<string>")
    return F.when(possible, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def kind_of(value: Column) -> Column:
    """The first kind whose pattern covers the whole mention; null for a number that is no card."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    checked = luhn(F.regexp_replace(value, "[^0-9]", "")) == 0
    return F.coalesce(out, F.when(value.rlike(f"^(?:{LONG_CARD})$") & checked, F.lit("card")))


def canonical(kind: Column, value: Column) -> Column:
    """One form for all spellings: no separators, emails in lower case, names without title and with single spaces."""
    phone = F.regexp_replace(F.regexp_replace(value, "^\\+([0-9]{1,3})(?=[^0-9])", "$1|"), "[^0-9|]", "")
    plain = F.regexp_replace(value, "[ -]", "")
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "phone", phone)
        .when(kind == "ip", value)
        .when(kind.startswith("name"), F.regexp_replace(F.regexp_replace(value, f"^(?:{_TITLE})", ""), " +", " "))
        .otherwise(plain)
    )


def _hash(seed: Column, *more: Column) -> Column:
    """A keyed number from 0 to 2^32 - 1."""
    digest = F.sha2(F.concat_ws("|", seed, *[m.cast("string") for m in more]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _pick(options: str, number: Column) -> Column:
    return F.substring(F.lit(options), (F.pmod(number, F.lit(len(options))) + 1).cast("int"), F.lit(1))


def _other_letters(text: Column, seed: Column) -> Column:
    """Each letter or digit replaced by one of its own script and case."""

    def swap(c: Column, i: Column) -> Column:
        out = c
        for letters, options in reversed(ALPHABETS.items()):
            out = F.when(c.rlike(letters), _pick(options, _hash(seed, i))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), swap), "")


def _octets(text: Column, seed: Column) -> Column:
    def octet(c: Column, i: Column) -> Column:
        n = _hash(seed, i)
        return (
            F.when(F.length(c) == 3, 100 + n % 156).when(F.length(c) == 2, 10 + n % 90).otherwise(n % 10)
        ).cast("string")

    return F.array_join(F.transform(F.split(text, "\\."), octet), ".")


def luhn(digits: Column) -> Column:
    """Check sum of a card number, 0 if its check digit holds."""
    letters, size = F.split(digits, ""), F.length(digits)

    def worth(c: Column, i: Column) -> Column:
        n = c.try_cast("int")
        return F.when((size - i) % 2 == 0, F.when(n > 4, 2 * n - 9).otherwise(2 * n)).otherwise(n)

    return F.aggregate(F.transform(letters, worth), F.lit(0), lambda a, x: a + x) % 10


def _card(text: Column, seed: Column) -> Column:
    """New digits whose check sum is that of the original."""
    head = F.substring(_other_letters(text, seed), F.lit(1), F.length(text) - 1)
    last = F.pmod(luhn(text) - luhn(F.concat(head, F.lit("0"))), F.lit(10))
    return F.concat(head, last.cast("string"))


def _name(kind: Column, form: Column, seed: Column, attempt: Column) -> Column:
    """Given and family name of the same group, or a family name alone for one word; every
    third attempt adds a family name."""
    out = F.lit(None).cast("string")
    for group in GIVEN:
        given = F.array(*map(F.lit, GIVEN[group].split()))
        family = F.array(*map(F.lit, FAMILY[group].split()))
        families = F.transform(F.sequence(F.lit(0), F.floor(attempt / 3).cast("int")), _member(family, seed))
        first = F.when(form.contains(" "), F.get(given, F.pmod(_hash(seed, F.lit("g")), F.size(given)).cast("int")))
        whole = F.concat_ws(" ", first, F.array_join(families, "-"))
        out = F.when(kind == f"name_{group}", whole).otherwise(out)
    return out


def _member(options: Column, seed: Column):
    return lambda i: F.get(options, F.pmod(_hash(seed, F.lit("f"), i), F.size(options)).cast("int"))


def surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a canonical form."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, form, attempt.cast("string")), 256)
    country = F.regexp_extract(form, "^[0-9]*\\|", 0)
    domain_end = F.regexp_extract(form, "\\.[a-z]+$", 0)
    without = F.substring(form, F.lit(1), F.length(form) - F.length(domain_end))
    return (
        F.when(kind == "email", F.concat(_other_letters(without, seed), domain_end))
        .when(kind == "phone", F.concat(country, _other_letters(F.substring(form, F.length(country) + 1, F.length(form)), seed)))
        .when(kind == "ip", _octets(form, seed))
        .when(kind == "card", _card(form, seed))
        .when(kind == "iban", F.concat(F.substring(form, 1, 2), _other_letters(F.substring(form, F.lit(3), F.length(form)), seed)))
        .when(kind.startswith("name"), _name(kind, form, seed, attempt))
        .otherwise(_other_letters(form, seed))
    )


def dress(kind: Column, value: Column, plain: Column) -> Column:
    """A canonical surrogate in the spelling of the mention: its title, its separators and its capitals.

    Letters are taken in order; a mention of no kind stays.
    """
    fresh = F.split(F.regexp_replace(plain, "[^\\p{L}\\p{N}]", ""), "")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def letter(done: Column, c: Column) -> Column:
        new = F.get(fresh, done["at"])
        swapped = F.when(c.rlike("\\p{Lu}"), F.upper(new)).otherwise(new)
        is_letter = c.rlike("[\\p{L}\\p{N}]")
        out = F.concat(done["out"], F.when(is_letter, swapped).otherwise(c))
        return F.struct((done["at"] + is_letter.cast("int")).alias("at"), out.alias("out"))

    spelled = F.aggregate(F.split(value, ""), start, letter, lambda done: done["out"])
    titled = F.concat(F.regexp_extract(value, f"^(?:{_TITLE})", 0), plain)
    return F.when(kind.isNull(), value).when(kind.startswith("name"), titled).otherwise(spelled)


def entities(docs: DataFrame) -> DataFrame:
    """Distinct entities of all documents: ``kind, form``."""
    found = docs.select(F.explode(mentions(F.col("text"))).alias("value")).select(kind_of(F.col("value")).alias("kind"), "value")
    found = found.filter(F.col("kind").isNotNull())
    return found.select("kind", canonical(F.col("kind"), F.col("value")).alias("form")).distinct()


def settle_collisions(found: DataFrame, key: str) -> DataFrame:
    """Entities that need another attempt than the first: ``kind, form, attempt``.

    Each round checks the open entities' surrogates against each other, against those
    already given, and against the entities themselves. The first entity keeps a
    contested surrogate; the rest, fewer by orders of magnitude each time, go on.
    """
    spark, attempt = found.sparkSession, 0
    given = spark.createDataFrame([], "kind string, form string, attempt int, plain string")
    real = found.select("kind", F.col("form").alias("plain"))
    open_ = found
    while True:
        tries = open_.select("kind", "form", F.lit(attempt).alias("attempt"))
        tries = stage(tries.withColumn("plain", surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key)), "tries")
        first = tries.groupBy("kind", "plain").agg(F.min("form").alias("form"))
        free = first.join(real, ["kind", "plain"], "left_anti")
        if attempt:
            free = free.join(given.select("kind", "plain"), ["kind", "plain"], "left_anti")
        won = stage(tries.join(free.select("kind", "form"), ["kind", "form"], "left_semi"), "won")
        lost = stage(tries.join(won.select("kind", "form"), ["kind", "form"], "left_anti").select("kind", "form"), "lost")
        given = given.unionByName(won)
        if lost.isEmpty():
            return given.filter("attempt > 0").select("kind", "form", "attempt")
        open_, attempt = lost, attempt + 1


def replace(docs: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``__kinds``, the kinds of the mentions replaced."""
    text, found = F.col("text"), stage(entities(docs), "entities")
    again = stage(settle_collisions(found, key), "attempts")
    n_again = again.count()
    values = F.transform(mentions(text), lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    values = F.transform(values, lambda v: F.struct(v["value"].alias("value"), v["kind"].alias("kind"), canonical(v["kind"], v["value"]).alias("form")))
    df = docs.withColumn("__found", values)
    attempt = lambda v: F.lit(0)
    if n_again:
        # The attempts that a document's mentions need, gathered by doc_id.
        uses = docs.select(F.col("doc_id").alias("__doc"), F.explode(mentions(text)).alias("value"))
        uses = uses.select("__doc", kind_of(F.col("value")).alias("kind"), "value")
        uses = uses.filter(F.col("kind").isNotNull()).select("__doc", "kind", canonical(F.col("kind"), F.col("value")).alias("form")).distinct()
        met = lookup_join(uses, again, ["kind", "form"], ["__doc"], small_rows=n_again)
        entry = F.struct(F.concat_ws("|", "kind", "form"), "attempt")
        per_doc = stage(met.groupBy("__doc").agg(F.map_from_entries(F.collect_set(entry)).alias("__tries")), "tries")
        side = F.broadcast(per_doc) if met.count() <= broadcast_rows else per_doc
        df = df.join(side, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").drop("__doc")
        attempt = lambda v: F.coalesce(F.element_at("__tries", F.concat_ws("|", v["kind"], v["form"])), F.lit(0))
    plain = F.transform(
        "__found",
        lambda v: F.struct(v["value"].alias("value"), v["kind"].alias("kind"), surrogate(v["kind"], v["form"], attempt(v), key).alias("plain")),
    )
    df = df.withColumn("__plain", plain)
    df = df.withColumn("__fresh", F.transform("__plain", lambda v: dress(v["kind"], v["value"], v["plain"])))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.col("__fresh"), lambda g, f: F.array(g, F.coalesce(f, F.lit(""))))), "")
    out = df.withColumn("text", F.when(F.size("__found") > 0, joined).otherwise(text))
    kinds = F.coalesce(F.filter(F.transform("__found", lambda v: v["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return out.withColumn("__kinds", kinds).select(*docs.columns, "__kinds")


def digest(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, n_entities`` and the number of mentions of each kind."""
    done = replace(docs.select("doc_id", "text"), key)
    groups = ("email", "ip", "card", "ssn", "phone", "iban", "name")
    counts = [F.size(F.filter("__kinds", _starts(group))).cast("bigint").alias(f"n_{group}") for group in groups]
    return done.select("doc_id", "text", F.size("__kinds").cast("bigint").alias("n_entities"), *counts)


def _starts(prefix: str):
    return lambda kind: kind.startswith(prefix)
