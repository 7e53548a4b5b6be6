"""Surrogates for personal data: detected entities get keyed, type-consistent
replacements, by DataFrame functions only.

Entities: e-mail addresses, IPv4 addresses, phone numbers, payment cards, US social
security numbers, IBANs, and names after a title. A replacement keeps the type, the written
format (punctuation, spacing, capitals), a phone's country code, a card's first digit with a
valid check digit, an IBAN's country with valid check digits, a name's gender (from the
titles it has anywhere in the corpus; neutral if they differ) and script (Latin, Cyrillic, Greek).

One corpus-wide table maps every distinct entity to its surrogate, so the same entity is the
same surrogate in every document and format (coreference; a surname is mapped on its own, so
"Mr. Smith" and "Mr. John Smith" stay related). Given names and surnames found with a title
are also replaced where the same document writes them without one, as whole capitalised words
(a word that is both counts as a given name). Surrogates are drawn from SHA-256 of the
secret key and the entity. Collision checks preserve distinctness: a draw that another
entity already has, or that equals any real entity of the corpus, is drawn again; from draw
WIDEN on, names, addresses and phones grow by a syllable, letter or digit a draw, so forms
never run out.

Scale: documents without entities pass through without a shuffle. Documents with entities
are written once with a row number; their occurrences (narrow rows) are joined with the map
and gathered per row number, which joins the texts back. An entity that a third of the
documents hold is one row of the map; it is hot on the occurrences' side only, which
adaptive execution splits. The map and its collision checks are combinable aggregates and
joins by entity. Mentions without title cost their number times the document's distinct names.

Defined results: NULL and empty texts stay as they are; all other columns are kept
(``n_chars``, if there, is set to the new length); repeated rows get equal texts; an empty
table gives an empty result; a ``_row`` or other column of the input never clashes (added
names are made free).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import free_names
from tabforge.session import materialize, release

#: Draws after which addresses and phones are widened (names grow from the second draw on).
WIDEN = 2

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MALE = "Mr|MR|Herr|Herrn|Monsieur|Señor|Sr|Don|Господин|Κύριος"
FEMALE = "Mrs|MRS|Ms|MS|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Doña|Госпожа|Κυρία"
NEUTRAL = "Dr|DR|Prof"
TITLE = f"(?:{MALE}|{FEMALE}|{NEUTRAL})"
NAME = r"\p{Lu}\p{L}+(?:[-'’]\p{Lu}\p{L}+)?"
#: Type -> pattern; earlier types win at the same place. Possessive runs and look-behinds
#: keep the search linear in texts without spaces.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": (r"(?<![0-9A-Za-z.-])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|"
             r"3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9A-Za-z])"),
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": (r"(?<![0-9A-Za-z.+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|"
              r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])"),
    "person": rf"(?<![\p{{L}}0-9]){TITLE}\.? {NAME}(?: {NAME})?(?![\p{{L}}0-9])",
}
MENTION = rf"(?<![\p{{L}}0-9]){NAME}(?![\p{{L}}0-9])"
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No text without a digit, an at sign or a title can hold an entity.
HINT = rf"[0-9@]|(?<![\p{{L}}]){TITLE}[. ]"

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Given names by script and gender (m, f, n), and surname syllables by script.
GIVEN = {
    "latin": {"m": ["Adrian", "Bruno", "Conrad", "Damian", "Edgar", "Felix", "Gavin", "Hugo", "Ivo", "Jonas"],
              "f": ["Alma", "Bianca", "Clara", "Daria", "Elena", "Flora", "Greta", "Helena", "Ines", "Julia"],
              "n": ["Alex", "Chris", "Kim", "Robin", "Sascha", "Noel", "Jordan", "Morgan", "Taylor", "Quinn"]},
    "cyrillic": {"m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим"],
                 "f": ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Кира", "Лидия"],
                 "n": ["Саша", "Женя", "Валя", "Слава", "Шура", "Паша", "Тоня", "Мика", "Рута", "Юля"]},
    "greek": {"m": ["Αλέξης", "Βασίλης", "Γιάννης", "Δήμος", "Ηλίας", "Κώστας", "Λουκάς", "Μάρκος", "Νίκος", "Πέτρος"],
              "f": ["Άννα", "Βάσω", "Γεωργία", "Δάφνη", "Ελένη", "Ζωή", "Ηρώ", "Κατερίνα", "Λίνα", "Μαρία"],
              "n": ["Άρι", "Βίκυ", "Γιώτα", "Δήμητρα", "Εύη", "Θάλεια", "Ίρις", "Κλειώ", "Λήδα", "Μάγδα"]},
}
SYLLABLES = {
    "latin": ["bar", "cor", "den", "fal", "gor", "han", "jel", "kar", "lin", "mor", "nel", "per", "ros", "sel", "tav", "wen"],
    "cyrillic": ["бар", "вол", "гор", "дан", "жар", "зим", "кол", "лен", "мир", "нов", "пол", "рак", "сол", "тур", "фед", "шам"],
    "greek": ["βαρ", "γον", "δαν", "ζαν", "θεο", "καλ", "λεο", "μαν", "νικ", "ξεν", "παν", "ραφ", "σαρ", "τελ", "φαν", "χαρ"],
}


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _draw(i: Column, below: int) -> Column:
    """Number ``i`` of the entity's keyed stream, in 0 .. below-1."""
    return F.pmod(F.xxhash64(F.col("_seed"), i), F.lit(below)).cast("int")


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(_array(values), _draw(i, len(values)) + 1)


def _wider(one) -> Column:
    """One more drawn character for each draw from WIDEN on."""
    more = F.array_join(F.transform(F.sequence(F.lit(WIDEN), F.col("_draws")), lambda i: one(i + 1000)), "")
    return F.when(F.col("_draws") >= WIDEN, more).otherwise(F.lit(""))


def _like(value: Column) -> Column:
    """Random characters of the same kind, place by place (ASCII letters and digits)."""
    def one(c: Column, i: Column) -> Column:
        return (F.when(c.rlike("[a-z]"), F.substring(F.lit(LOWER), _draw(i, 26) + 1, F.lit(1)))
                .when(c.rlike("[A-Z]"), F.substring(F.lit(UPPER), _draw(i, 26) + 1, F.lit(1)))
                .when(c.rlike("[0-9]"), _draw(i, 10).cast("string")).otherwise(c))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _digit(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1)).cast("int")


def _card(norm: Column) -> Column:
    """The first digit kept, the rest drawn, the last a valid check digit."""
    n = F.length(norm)
    body = F.concat(F.substring(norm, 1, 1), F.array_join(
        F.transform(F.sequence(F.lit(2), n - 1), lambda i: _draw(i, 10).cast("string")), ""))

    def weigh(total: Column, j: Column) -> Column:
        d = _digit(body, j)
        double = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - j + 1) % 2 == 0, double).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), weigh)
    return F.concat(body, F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


def _phone(norm: Column) -> Column:
    """The country code kept; area and exchange do not start with 0 or 1."""
    keep = F.when(norm.rlike(r"^\+[17]"), 2).when(norm.startswith("+"), 3).otherwise(0)
    tail = F.transform(F.sequence(keep + 1, F.length(norm)), lambda i: F.when(
        (i == keep + 1) | (i == keep + 4), (_draw(i, 8) + 2).cast("string")).otherwise(_draw(i, 10).cast("string")))
    return F.concat(F.substring(norm, F.lit(1), keep), F.array_join(tail, ""), _wider(lambda i: _draw(i, 10).cast("string")))


def _iban(norm: Column) -> Column:
    """The country kept, the account drawn like the original, check digits by mod 97."""
    rest = _like(F.substring(norm, F.lit(5), F.length(norm)))
    country = F.substring(norm, 1, 2)

    def step(acc: Column, c: Column) -> Column:
        return (F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97)
                .otherwise((acc * 100 + F.ascii(c) - 55) % 97))

    left = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), step)
    return F.concat(country, F.lpad((F.lit(98) - left).cast("string"), 2, "0"), rest)


def _name(kind: Column) -> Column:
    """``kind`` is given_<script> (with a ``gender``) or surname_<script>; draws beyond the
    first add syllables, so there is always another name."""
    def more(values: list[str]) -> Column:
        picks = F.transform(F.sequence(F.lit(1), F.col("_draws")), lambda i: _pick(values, i + 20))
        return F.when(F.col("_draws") > 0, F.array_join(picks, "")).otherwise(F.lit(""))

    out = F.lit(None).cast("string")
    for s in SYLLABLES:
        extra = more(SYLLABLES[s])
        for g in "mfn":
            out = F.when((kind == f"given_{s}") & (F.col("gender") == g), F.concat(_pick(GIVEN[s][g], F.lit(1)), extra)).otherwise(out)
        surname = F.initcap(F.concat(_pick(SYLLABLES[s], F.lit(2)), _pick(SYLLABLES[s], F.lit(3)), _pick(SYLLABLES[s], F.lit(4)), extra))
        out = F.when(kind == f"surname_{s}", surname).otherwise(out)
    return out


def _surrogate() -> Column:
    kind, norm = F.col("kind"), F.col("norm")
    octet = [(_draw(F.lit(i), 254) + 1).cast("string") for i in range(4)]
    ssn = F.concat((_draw(F.lit(1), 5) + 1).cast("string"), F.array_join(
        F.transform(F.sequence(F.lit(2), F.lit(9)), lambda i: _draw(i, 10).cast("string")), ""))
    at = F.length(norm) - F.length(F.regexp_extract(norm, r"\.[a-z]+$", 0))  # the top-level domain is kept
    letter = lambda i: F.substring(F.lit(LOWER), _draw(i, 26) + 1, F.lit(1))
    return (F.when(kind == "email", F.concat(_wider(letter), _like(F.substring(norm, F.lit(1), at)), F.substring(norm, at + 1, F.length(norm))))
            .when(kind == "ip", F.concat_ws(".", *octet)).when(kind == "card", _card(norm)).when(kind == "phone", _phone(norm))
            .when(kind == "ssn", ssn).when(kind == "iban", _iban(norm)).otherwise(_name(kind)))


def _parts(match: Column) -> Column:
    """An occurrence as array of (kind, raw, norm, gender); a title and spaces are kind ``text``."""
    def part(kind: Column, raw: Column, norm: Column, gender: Column = F.lit(None).cast("string")) -> Column:
        return F.struct(kind.alias("kind"), raw.alias("raw"), norm.alias("norm"), gender.alias("gender"))

    digits = F.regexp_replace(match, "[^0-9]", "")
    kind = F.lit("phone")
    for k in ("ssn", "card", "iban", "ip", "email"):
        kind = F.when(match.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(kind)
    norm = (F.when(kind == "email", F.lower(match)).when(kind == "ip", match)
            .when(kind == "iban", F.replace(match, F.lit(" "), F.lit("")))
            .when((kind == "phone") & match.startswith("+"), F.concat(F.lit("+"), digits))
            .when((kind == "phone") & (F.length(digits) == 10), F.concat(F.lit("+1"), digits)).otherwise(digits))
    plain = F.array(part(kind, match, norm))

    title = F.regexp_extract(match, rf"^{TITLE}", 0)
    gender = F.when(title.rlike(f"^(?:{MALE})$"), "m").when(title.rlike(f"^(?:{FEMALE})$"), "f").otherwise("n")
    script = F.when(match.rlike(rf" \p{{IsCyrillic}}"), "cyrillic").when(match.rlike(r" \p{IsGreek}"), "greek").otherwise("latin")
    lead = F.regexp_extract(match, rf"^{TITLE}\.? ", 0)
    names = F.split(F.substring(match, F.length(lead) + 1, F.length(match)), " ")
    text = lambda c: part(F.lit("text"), c, F.lit(None).cast("string"))
    surname = part(F.concat(F.lit("surname_"), script), F.element_at(names, -1), F.lower(F.element_at(names, -1)))
    given = part(F.concat_ws("_", F.lit("given"), script), names[0], F.lower(names[0]), gender)
    person = F.when(F.size(names) > 1, F.array(text(lead), given, text(F.lit(" ")), surname)).otherwise(F.array(text(lead), surname))
    return F.when(match.rlike(rf"^{TITLE}\.? \p{{Lu}}"), person).otherwise(plain)


def _rendered() -> Column:
    """The surrogate in the occurrence's own format."""
    raw, sur = F.col("raw"), F.col("surrogate")
    bare = F.regexp_replace(sur, "[^0-9A-Z]", "")
    # a phone may be written without its country code, and its surrogate may be longer
    more = F.greatest(F.length(sur) - F.length("norm"), F.lit(0))
    extra, bare = F.right(bare, more), F.substring(bare, F.lit(1), F.length(bare) - more)
    bare = F.right(bare, F.length(F.regexp_replace(raw, "[^0-9A-Z]", "")))
    seated = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(
        c.rlike("[0-9A-Z]"), F.substring(bare, F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), "[^0-9A-Z]", "")), F.lit(1))
    ).otherwise(c)), "")
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    return (F.when(F.col("kind") == "text", raw)
            .when(F.col("kind").isin("card", "phone", "ssn", "iban"), F.concat(seated, extra))
            .when(upper, F.upper(sur)).otherwise(sur))


def surrogate_map(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm) of all distinct entities -> surrogate, distinct per kind and different
    from every real entity of the kind."""
    men, women = F.max(F.col("gender") == "m"), F.max(F.col("gender") == "f")
    gender = F.when(men & ~women, "m").when(women & ~men, "f").otherwise("n")
    real = materialize(entities.groupBy("kind", "norm").agg(gender.alias("gender")), "pii-entities")
    taken, settled, pending = None, [], real
    for draws in itertools.count():
        # a given name's gender is part of what is drawn
        drawn_kind = F.when(F.col("kind").startswith("given_"), F.concat_ws("_", F.lit("given"), "gender", F.substring("kind", 7, 99)))
        seed = F.sha2(F.concat_ws("|", F.lit(key), F.coalesce(drawn_kind, "kind"), F.col("norm"), F.lit(str(draws))), 256)
        drawn = (pending.withColumns({"_seed": seed, "_draws": F.lit(draws)}).withColumn("surrogate", _surrogate())
                 .select("kind", "norm", "gender", "surrogate"))
        # names are compared without regard to capitals, as entities are
        exact = F.col("kind").isin("card", "phone", "ssn", "iban", "ip")
        drawn = materialize(drawn.withColumn("plain", F.when(exact, F.col("surrogate")).otherwise(F.lower("surrogate"))), "pii-draws")
        used = real.select("kind", F.col("norm").alias("plain"))
        if taken is not None:
            used = used.unionByName(taken)
        # of the entities that drew one form, the least takes it, if it is free
        winners = (drawn.groupBy("kind", "plain").agg(F.min("norm").alias("norm"))
                   .join(used, ["kind", "plain"], "left_anti").select("kind", "norm", F.lit(True).alias("ok")))
        checked = materialize(drawn.join(winners, ["kind", "norm"], "left"), "pii-checked")
        release(drawn)
        fine = checked.where("ok")
        settled.append(fine.select("kind", "norm", "surrogate"))
        new = fine.select("kind", "plain")
        taken = new if taken is None else taken.unionByName(new)
        pending = checked.where("ok IS NULL").select("kind", "norm", "gender")
        if pending.isEmpty():
            break
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def replace(docs: DataFrame, key: str = "surrogate-key", text: str = "text") -> DataFrame:
    """The documents with every entity replaced; all columns kept, in order."""
    row, found = free_names(docs.columns, "_row", "_found")
    body = F.col(text)
    has = F.coalesce(body.rlike(HINT) & body.rlike(ENTITY), F.lit(False))
    hits = docs.where(has).withColumn(found, F.regexp_extract_all(body, F.lit(ENTITY), F.lit(0)))
    hits = materialize(hits.withColumn(row, F.monotonically_increasing_id()), "pii-hits")

    spots = (hits.select(F.col(row).alias("row"), F.posexplode(found).alias("at", "match"))
             .select("row", "at", F.posexplode(_parts(F.col("match"))).alias("part", "p")).select("row", "at", "part", "p.*"))
    spots = materialize(spots, "pii-spots")
    mapping = surrogate_map(spots.where("kind != 'text'"), key).select(
        F.col("kind").alias("m_kind"), F.col("norm").alias("m_norm"), "surrogate")
    out = (spots.join(mapping, (F.col("kind") == F.col("m_kind")) & (F.col("norm") == F.col("m_norm")), "left")
           .select("row", "at", "part", "kind", "norm", "surrogate", _rendered().alias("out")))
    whole = out.groupBy("row", "at").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "out"))), lambda x: x["out"]), "").alias("out"))
    per_row = whole.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]).alias("new"))

    # names of a document without their titles
    person = out.where(F.col("kind").startswith("given_") | F.col("kind").startswith("surname_"))
    names = (person.groupBy("row", "norm").agg(F.min(F.struct("kind", "surrogate")).alias("s"))
             .groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("norm", "s.surrogate"))).alias("names")))
    per_row = per_row.join(names, "row", "left")

    (new, known) = free_names([*docs.columns, row, found], "_new", "_names")

    def mention(word: Column) -> Column:
        sur = F.col(known)[F.lower(word)]
        return F.coalesce(F.when(word == F.upper(word), F.upper(sur)).otherwise(sur), word)

    def untitled(piece: Column) -> Column:
        words = F.transform(F.regexp_extract_all(piece, F.lit(MENTION), F.lit(0)), mention)
        return F.array_join(F.zip_with(F.split(piece, MENTION, -1), words, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    between = F.split(body, ENTITY, -1)
    between = F.when(F.col(known).isNull(), between).otherwise(F.transform(between, untitled))
    joined = F.array_join(F.zip_with(between, F.col(new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    per_row = per_row.select(F.col("row").alias(f"{row}r"), F.col("new").alias(new), F.col("names").alias(known))
    changed = hits.join(per_row, F.col(row) == F.col(f"{row}r")).withColumn(text, joined)
    lower = {c.lower(): c for c in docs.columns}
    if "n_chars" in lower:
        name = lower["n_chars"]
        changed = changed.withColumn(name, F.length(text).cast(docs.schema[name].dataType))
    return docs.where(~has).unionByName(changed.select(*docs.columns))
