"""PII surrogates in DataFrame functions: keyed, type-consistent, collision-checked replacements.

Entities are e-mail addresses, IPv4 addresses, payment cards, phone numbers, social-security
numbers, IBANs, and given names and surnames: any number of name words, initials and particles behind
one or more titles, and in the same document every other capitalised whole-word mention of a name so
found. The last name word behind a title is the surname, those before it are given names; a word that
is both in a document counts as what it is first. Initials and particles stay. A mention's canonical form (case,
separators and country prefixes aside) is the entity; its surrogate is derived from a secret key
and the canonical form alone, so all mentions anywhere get the same one, laid over the mention's
own format. Digits stay digits and letters letters; octets keep their length and range, cards their
issuer digit and Luhn remainder, e-mail addresses their top-level domain; names follow the gender
of the title, where it has one, and the script of the name.

Distinctness is checked over all entities: a surrogate that equals another entity's, or any entity
that occurs in the corpus, is drawn again for all but the first holder, until none is left. A shape (a kind's
pattern of digits, letters and marks) is crowded if its entities number over one in CROWD of the surrogates it
has, at any size of corpus. Surrogates of a crowded shape get so many places more that one in CROWD of their
space would hold all entities of the kind: letters before an e-mail address, digits behind a number;
octets of crowded addresses may have any length first. So a draw succeeds with a fair chance, and the draws end.
Names gain a part with every draw.

Defined cases: null texts stay null; empty texts and texts without entities are unchanged. Repeated
rows and ids are rewritten alike. An empty table gives no rows. Other columns are kept as they are, whatever
their names: a row travels as one value. ``n_chars``, where there is one, follows the new text; with
``counted``, the output ``n_entities`` replaces a column of that name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A shape with more entities than one in so many of its surrogates is crowded.
CROWD = 8
#: Entities that one task draws for, about.
DRAWN_TOGETHER = 2_000

MALE_TITLES = r"Mr|MR|Mister|Sir|Lord|Herr|Herrn|HERR|Monsieur|M\.|Señor|Sr\.|Signor|г-н|Господин|Κύριος"
FEMALE_TITLES = r"Mrs|MRS|Ms|MS|Miss|Madam|Lady|Dame|Frau|FRAU|Madame|Mme|Mlle|Señora|Sra\.|Srta\.|Dra\.|Signora|г-жа|Госпожа|Κυρία"
NEUTRAL_TITLES = r"Dr|DR|Doctor|Doktor|Prof|PROF|Professor|Rev|Reverend|Capt|Captain|Sgt|Lt|Dott\.|Д-р|Доктор|Профессор|Δρ|Καθηγητής|Καθηγήτρια"
_TITLE = rf"(?:{MALE_TITLES}|{FEMALE_TITLES}|{NEUTRAL_TITLES})"
_GAP = r"[ \x{A0}]{1,2}"
#: A possessive ending is not part of a name.
_NAME = r"(?=\p{Lu}[\p{L}'’-])\p{Lu}\p{L}*+(?:(?!['’]s(?!\p{L}))['’-]\p{L}++)*+"
_INITIALS = r"(?:(?:\p{Lu}\.-?)++|\p{Lu}(?![\p{L}.'’-]))"
_PARTICLES = rf"(?:(?:von|vom|van|zu|zur|de|del|della|der|den|di|da|das|dos|du|des|la|le|ter|ten|bin|ibn|al|el|y){_GAP})*+"
_WORD = rf"{_PARTICLES}(?!{_TITLE}(?!\p{{L}}))(?:{_NAME}|{_INITIALS})"
_HEAD = rf"(?=[MSLHFDPRCгГДПΚΔ])(?<!\p{{L}})(?:{_TITLE}\.?{_GAP})++"
TITLED = rf"{_HEAD}{_WORD}(?:{_GAP}{_WORD})*+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Each kind's pattern where it stands in a text, in order of precedence.
PATTERNS = {
    "EMAIL": r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[.%+-]*+[A-Za-z0-9_][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "IP": rf"(?=[0-9])(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "IBAN": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "CARD": r"(?=[0-9])(?<![0-9A-Za-z+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "SSN": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "PHONE": r"\+(?<![0-9A-Za-z].)[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?=[0-9(])(?<![0-9A-Za-z.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|0(?<![0-9A-Za-z.-].)(?:[1-9](?:[ .-][0-9]{2}){4}|[0-9]{4} [0-9]{6})(?![0-9A-Za-z-])",
}
_TAIL = r"((?:example)?\.[a-z]+)$"
#: Texts without any of these have no entity; each is cheap where its first character is rare.
GATES = (r"@", r"[0-9][0-9(). -]{5,}[0-9]", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", TITLED)
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())

# Given names by gender, and syllables and endings of surnames, for each script.
GIVEN = {
    "Latin": {
        "M": "Adrian Bruno Carlos David Erik Felix Gregor Henry Ivan Jonas Karl Leon Martin Nils Oscar Paul".split(),
        "F": "Alice Bianca Clara Diana Elena Flora Greta Helen Irene Julia Karin Laura Maria Nina Olivia Paula".split(),
    },
    "Cyrillic": {
        "M": "Андрей Борис Виктор Григорий Дмитрий Егор Иван Кирилл Леонид Михаил Николай Олег Павел Роман Сергей Тимур".split(),
        "F": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Раиса Софья".split(),
    },
    "Greek": {
        "M": "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λεωνίδας Μιχάλης Νίκος Πέτρος Στέλιος Τάσος Φώτης Χρήστος Άγγελος".split(),
        "F": "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Λίνα Μαρία Νίκη Όλγα Πηνελόπη Ρένα Σοφία Χριστίνα".split(),
    },
}
SYLLABLES = {
    "Latin": "bal cor den far gal hol kel lan mar nor pel ros sel tor val wen".split(),
    "Cyrillic": "бал вор гал дер зал кол лан мар нов пет рос сел тар фил хор шал".split(),
    "Greek": "βαλ γορ δεν θαλ καρ λαν μαρ νικ παλ ροσ σερ ταλ φορ χαρ ψαλ ξεν".split(),
}
ENDINGS = {"Latin": ("er", "er"), "Cyrillic": ("ов", "ова"), "Greek": ("ίδης", "ίδου")}


def _kind(mention: F.Column, patterns: dict[str, str]) -> F.Column:
    kind = None
    for name, pattern in patterns.items():
        test = mention.rlike(f"^(?:{pattern})$")
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind


def _digits(x: F.Column) -> F.Column:
    return F.regexp_replace(x, "[^0-9]", "")


def names(text: F.Column) -> F.Column:
    """(name, kind) of each name word behind the titles of a text, in lower case, as it is first."""

    def words(run: F.Column) -> F.Column:
        head = F.regexp_extract(run, f"^{_HEAD}", 0)
        found = F.regexp_extract_all(F.substring(run, F.length(head) + 1, F.length(run)), F.lit(rf"(?<![\p{{L}}'’-]){_NAME}"), F.lit(0))
        gender = lambda titles: head.rlike(rf"(?<!\p{{L}})(?:{titles})\.?{_GAP}")
        given = F.when(gender(FEMALE_TITLES), "GIVEN_F").when(gender(MALE_TITLES), "GIVEN_M").otherwise("GIVEN_N")
        return F.transform(found, lambda w, i: F.struct(F.lower(w).alias("name"), F.when(i == F.size(found) - 1, "SURNAME").otherwise(given).alias("kind")))

    every = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TITLED), F.lit(0)), words))
    first = lambda known, x: F.when(F.exists(known, lambda k: k["name"] == x["name"]), known).otherwise(F.concat(known, F.array(x)))
    return F.aggregate(every, F.array().cast("array<struct<name:string,kind:string>>"), first)


def _pattern(found: F.Column) -> F.Column:
    """The pattern of all entities of a text with these names; the longer of two names with one start is first."""
    listed = F.array_join(F.sort_array(F.transform(found, lambda n: n["name"]), asc=False), "|")
    return F.when(F.size(found) > 0, F.concat(F.lit(rf"{ENTITY}|(?<!\p{{L}})(?=\p{{Lu}})(?iu:"), listed, F.lit(r")(?!\p{L})"))).otherwise(ENTITY)


def _named_hits(texts: DataFrame) -> DataFrame:
    """(_row, at, mention, kind) of every entity of (_row, _text), numbered in text order."""
    named = texts.withColumn("_names", names(F.col("_text")))
    hits = named.select("_row", "_names", F.posexplode(F.regexp_extract_all("_text", _pattern(F.col("_names")), F.lit(0))).alias("at", "mention"))
    name = F.get(F.filter("_names", lambda n: n["name"] == F.lower("mention")), F.lit(0))
    return hits.select("_row", "at", "mention", F.coalesce(_kind(F.col("mention"), PATTERNS), name["kind"], F.lit("SURNAME")).alias("kind"))


def canonical(mention: F.Column, kind: F.Column) -> F.Column:
    """The entity that a mention stands for."""
    return (
        F.when(kind == "PHONE", F.substring(_digits(mention), -10, 10))
        .when(kind.isin("CARD", "SSN"), _digits(mention))
        .when(kind == "IBAN", F.regexp_replace(mention, " ", ""))
        .when(kind == "EMAIL", F.regexp_replace(F.lower(mention), "^[.%+-]+", ""))  # signs before an address are no part of it
        .otherwise(F.lower(mention))
    )


def shaped(entities: DataFrame) -> DataFrame:
    """(kind, entity, extra): places that an entity's surrogates have beyond its own; -1 frees the length of octets."""
    kind, entity = F.col("kind"), F.col("entity")
    drawn = F.when(kind == "EMAIL", F.regexp_replace(entity, _TAIL, "")).when(kind == "CARD", F.expr("substring(entity, 2, length(entity) - 2)")).when(kind == "IBAN", F.expr("substring(entity, 3)")).otherwise(entity)
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace(drawn, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    places = lambda x: F.length(F.regexp_replace(pattern, f"[^{x}]", ""))
    octets = F.aggregate(F.split(pattern, "[.]"), F.lit(0.0), lambda r, o: r + F.when(F.length(o) == 3, math.log10(156)).when(F.length(o) == 2, math.log10(90)).otherwise(1.0))
    room = F.when(kind == "IP", octets).otherwise(places("0") + math.log10(26) * places("aA")).alias("room")
    own = entities.select("kind", "entity", pattern.alias("shape"), room)
    fixed = ~kind.startswith("GIVEN") & (kind != "SURNAME")
    need = {r.kind: math.log10(CROWD * r["count"]) for r in own.where(fixed).groupBy("kind").count().collect()}  # one row for each kind
    crowded = own.where(fixed).groupBy("kind", "shape").agg(F.count("*").alias("n"), F.first("room").alias("room")).where(F.log10(CROWD * F.col("n")) > F.col("room"))
    needed = F.lit(0.0)
    for name, value in need.items():
        needed = F.when(kind == name, value).otherwise(needed)
    lacking = F.when(kind == "IP", needed - 32 * math.log10(2)).otherwise((needed - F.col("room")) / F.when(kind == "EMAIL", math.log10(26)).otherwise(1.0))
    extra = F.when((kind == "IP") & (lacking <= 0), -1).otherwise(F.greatest(F.ceil(lacking), F.lit(1))).cast("int")
    return own.select("kind", "entity", "shape").join(crowded.select("kind", "shape", extra.alias("extra")), ["kind", "shape"], "left").select("kind", "entity", F.coalesce("extra", F.lit(0)).alias("extra"))


def digests(key: str, kind: F.Column, entity: F.Column, attempt: F.Column, extra: F.Column) -> F.Column:
    """The random digits (hexadecimal, four a place) that an entity's draw uses."""
    places = F.greatest(F.length(entity) + F.greatest(extra, F.lit(0)), attempt + 2)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(places / 16).cast("int")), lambda j: F.sha2(F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string"), j.cast("string")), 256)), "")


def surrogate(random: F.Column, kind: F.Column, entity: F.Column, attempt: F.Column, extra: F.Column) -> F.Column:
    """The canonical surrogate: the same for the same key, kind, entity and attempt."""

    def draw(i: F.Column) -> F.Column:  # 16 bits for each place
        return F.conv(F.substring(random, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("int")

    def letter(i: F.Column, first: str) -> F.Column:
        return F.char(F.lit(ord(first)) + F.pmod(draw(i), F.lit(26)))

    def digit(i: F.Column) -> F.Column:
        return F.pmod(draw(i), F.lit(10)).cast("string")

    chars = F.split(entity, "")
    places = F.sequence(F.lit(1), F.length(entity))
    like = lambda c, i: F.when(c.rlike("[0-9]"), digit(i)).when(c.rlike("[a-z]"), letter(i, "a")).when(c.rlike("[A-Z]"), letter(i, "A")).otherwise(c)
    every = F.array_join(F.transform(places, lambda i: like(F.get(chars, i - 1), i)), "")
    added = lambda make: F.when(extra > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda i: make(F.length(entity) + i)), "")).otherwise("")

    tail = F.regexp_extract(entity, _TAIL, 1)
    email = F.concat(added(lambda i: letter(i, "a")), F.substring(every, F.lit(1), F.length(entity) - F.length(tail)), tail)

    octets = F.split(entity, "[.]")
    octet = lambda o, i: F.when(extra != 0, F.pmod(draw(i + 1), F.lit(256))).when(F.length(o) == 3, F.pmod(draw(i + 1), F.lit(156)) + 100).when(F.length(o) == 2, F.pmod(draw(i + 1), F.lit(90)) + 10).otherwise(F.pmod(draw(i + 1), F.lit(10))).cast("string")
    ip = F.array_join(F.transform(octets, octet), ".")

    def luhn(digits: F.Column) -> F.Column:
        n = F.length(entity)
        value = lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (F.pmod(n - i, F.lit(2)) + 1)
        return F.aggregate(places, F.lit(0), lambda s, i: s + F.when(value(i) > 9, value(i) - 9).otherwise(value(i)))

    body = F.concat(F.substring(entity, 1, 1), F.substring(every, F.lit(2), F.length(entity) - 2), F.lit("0"))
    card = F.concat(F.substring(body, F.lit(1), F.length(entity) - 1), F.pmod(luhn(entity) - luhn(body), F.lit(10)).cast("string"))
    iban = F.concat(F.substring(entity, 1, 2), F.substring(every, F.lit(3), F.length(entity) - 2))

    script = F.when(entity.rlike(r"^\p{IsCyrillic}"), "Cyrillic").when(entity.rlike(r"^\p{IsGreek}"), "Greek").otherwise("Latin")
    pick = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), F.pmod(draw(i), F.lit(len(names))))

    def given(gender: str) -> F.Column:
        parts = F.sequence(F.lit(1), attempt + 1)  # every draw has a part more, so there are always enough
        of = lambda which: [x for g in gender for x in GIVEN[which][g]]
        return F.lower(F.array_join(F.transform(parts, lambda i: F.when(script == "Cyrillic", pick(of("Cyrillic"), i)).when(script == "Greek", pick(of("Greek"), i)).otherwise(pick(of("Latin"), i))), "-"))

    def surname(which: str) -> F.Column:
        male, female = ENDINGS[which]
        ending = F.when(entity.rlike("(?:а|я|ου)$"), female).otherwise(male)
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), attempt + 2), lambda i: pick(SYLLABLES[which], i)), ""), ending)

    names = F.when(script == "Cyrillic", surname("Cyrillic")).when(script == "Greek", surname("Greek")).otherwise(surname("Latin"))
    more = F.concat(F.when((kind == "IP") & (extra > 0), ":").otherwise(""), added(digit))
    return (
        F.when(kind == "EMAIL", email).when(kind == "IP", F.concat(ip, more)).when(kind == "CARD", F.concat(card, more)).when(kind == "IBAN", F.concat(iban, more))
        .when(kind.isin("PHONE", "SSN"), F.concat(every, more)).when(kind == "GIVEN_M", given("M")).when(kind == "GIVEN_F", given("F")).when(kind == "GIVEN_N", given("MF")).otherwise(names)
    )


def laid_over(mention: F.Column, kind: F.Column, entity: F.Column, drawn: F.Column) -> F.Column:
    """The canonical surrogate in the mention's own format: separators, prefixes and capitals."""
    chars = F.split(mention, "")
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))
    own = F.length(F.regexp_replace(mention, F.when(kind == "IBAN", F.lit("[^A-Z0-9]")).otherwise(F.lit("[^0-9]")), ""))
    first = own - F.length(entity)  # a country prefix before the entity's digits stays
    counted = lambda c: F.when(kind == "IBAN", c.rlike("[A-Z0-9]")).otherwise(c.rlike("[0-9]"))
    put = lambda s, c: F.struct((s["n"] + counted(c).cast("int")).alias("n"), F.concat(s["out"], F.when(counted(c) & (s["n"] >= first), F.substring(drawn, s["n"] - first + 1, F.lit(1))).otherwise(c)).alias("out"))
    grouped = F.concat(F.aggregate(chars, start, put)["out"], F.substring(drawn, F.length(entity) + 1, F.length(drawn)))
    before = F.when(kind == "EMAIL", F.regexp_extract(mention, "^[.%+-]*", 0)).otherwise("")
    own_chars = F.split(F.substring(mention, F.length(before) + 1, F.length(mention)), "")
    cased = F.concat(before, F.array_join(F.transform(F.split(drawn, ""), lambda c, i: F.when(F.get(own_chars, i).rlike("[A-Z]"), F.upper(c)).otherwise(c)), ""))
    name = F.when((F.upper(mention) == mention) & (F.length(mention) > 2), F.upper(drawn)).otherwise(F.array_join(F.transform(F.split(drawn, "-"), lambda p: F.initcap(p)), "-"))
    return F.when(kind.isin("EMAIL", "IP"), cased).when(kind.isin("CARD", "SSN", "PHONE", "IBAN"), grouped).otherwise(name)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, drawn): distinct surrogates for distinct (kind, entity) rows."""
    kind, entity, attempt, extra = (F.col(c) for c in ("kind", "entity", "attempt", "extra"))
    group = F.when(kind.startswith("GIVEN"), "GIVEN").otherwise(kind).alias("group")  # given names share their lists
    current = materialize(shaped(entities).withColumn("attempt", F.lit(0)))
    tasks = 1 + current.count() // DRAWN_TOGETHER  # rows are narrow but costly, so their number deals them out
    real = entities.select(group, F.col("entity").alias("drawn"), F.lit(True).alias("real")).distinct()
    while True:
        random = current.repartition(tasks, "kind", "entity").withColumn("random", digests(key, kind, entity, attempt, extra))
        drawn = materialize(random.select("kind", "entity", "attempt", "extra", group, surrogate(F.col("random"), kind, entity, attempt, extra).alias("drawn")))
        first = drawn.groupBy("group", "drawn").agg(F.min(F.struct("attempt", "entity", "kind")).alias("first"))  # earlier draws keep theirs
        judged = drawn.join(first, ["group", "drawn"]).join(real, ["group", "drawn"], "left")
        again = (entity != F.col("first.entity")) | (kind != F.col("first.kind")) | F.coalesce("real", F.lit(False))
        judged = materialize(judged.select("kind", "entity", "attempt", "extra", "drawn", again.alias("again")))
        if judged.where("again").isEmpty():
            return judged.select("kind", "entity", "drawn")
        current = judged.select("kind", "entity", "extra", F.when(F.col("again"), attempt + 1).otherwise(attempt).alias("attempt"))


def replace(docs: DataFrame, text: str = "text", key: str = "surrogates-1", counted: bool = False) -> DataFrame:
    """All rows with entities replaced; with ``counted``, also ``n_entities``.

    Only texts with entities are moved, to meet their replacements; the others stay where they are.
    """
    content = F.col("content")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("content"))
    has = F.coalesce((content.contains("@") | content.rlike("|".join(f"(?:{g})" for g in GATES[1:]))) & content.rlike(f"{ENTITY}|{TITLED}"), F.lit(False))
    dirty = rows.where(has).withColumn("_row", F.sha2(content, 256))  # equal texts are rewritten alike
    hits = _named_hits(dirty.select("_row", content.alias("_text")).dropDuplicates(["_row"]))
    mentions = materialize(hits.withColumn("entity", canonical(F.col("mention"), F.col("kind"))))
    drawn = assign(mentions.select("kind", "entity").distinct(), key)
    placed = mentions.join(drawn, ["kind", "entity"]).select("_row", "at", laid_over(F.col("mention"), F.col("kind"), F.col("entity"), F.col("drawn")).alias("put"))
    puts = placed.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "put"))).alias("puts"))
    gaps = F.split(content, _pattern(F.col("names")), -1)
    rewritten = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("puts", i)["put"], F.lit("")))), "")
    changed = dirty.join(puts.hint("shuffle_hash"), "_row", "left").withColumn("names", names(content)).withColumn("content", rewritten)
    kept = [c for c in docs.columns if not (counted and c == "n_entities")]
    number = [F.col("n_entities")] if counted else []

    def rebuilt(new: dict[str, F.Column]) -> list[F.Column]:
        return [new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in kept]

    new = {"n_chars": F.length("content").cast(docs.schema["n_chars"].dataType)} if "n_chars" in kept else {}
    clean = rows.where(~has).withColumn("n_entities", F.lit(0)).select(*rebuilt({}), *number)
    changed = changed.withColumn("n_entities", F.when(F.col("puts").isNull(), 0).otherwise(F.size("puts"))).select(*rebuilt(new | {text: content}), *number)
    return clean.unionByName(changed)
