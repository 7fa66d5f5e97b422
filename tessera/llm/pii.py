"""Personal data to surrogates, in DataFrame operations only.

Entities are found by one pattern. Each has a canonical form (an address in lower case, a number's digits,
a person's gender, script and surname), so every mention of it, however written, gets the same surrogate.
A full name is an entity besides (kind "full", with the given name): its given name is another for each one of a surname.
A surrogate is keyed: it comes from a hash of key, kind, canonical form and attempt, and has the entity's
type: digits for digits in the mention's own layout with valid check digits, octets of as many digits, a name of the
same gender and script. Attempts go on until no two entities share a surrogate and no surrogate is an entity of the
corpus; from the third on surrogates grow, so there is always room.

A person is found by a title, by a given name of the lists below with a capitalised name behind it, or, in Han
script, by an honorific behind the name. Other names are words like all others to a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GROUP = "[0-9A-Fa-f]{1,4}"
_NAME = r"[\p{Lu}][\p{Ll}]+"
#: Titles by gender; the last go with any.
MALE = "Mr|Sir|Herr|Señor|Sr|Don|Monsieur|Signor|Господин|господин|Κύριος|κύριος"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Señora|Sra|Doña|Madame|Mme|Signora|Госпожа|госпожа|Κυρία|κυρία"
ANY = "Dr|Prof|Professor|Доктор|доктор"
_TITLE = rf"(?:{MALE}|{FEMALE}|{ANY})\.? "
HONORIFIC = "さん|様|氏|先生|女士|小姐"
#: Given names that stand for a person without a title.
GIVEN_MALE = (
    "John|James|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Paul|Steven|Andrew|Kenneth|George|Peter|Hans|Karl|Heinrich|Wolfgang|Jürgen|Stefan|Andreas|Pierre|Jean|Jacques|"
    "François|Michel|Philippe|José|Juan|Carlos|Luis|Miguel|Pedro|Javier|Giovanni|Marco|Luca|Иван|Пётр|Сергей|Дмитрий|Алексей|Николай|Михаил|Андрей|Γιώργος|Νίκος|Δημήτρης|Κώστας"
)
GIVEN_FEMALE = (
    "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Lisa|Margaret|Sandra|Emily|Laura|Helen|Anna|Maria|Ursula|Monika|Petra|Sabine|Heike|Ingrid|Marie|Nathalie|Isabelle|Sophie|"
    "Camille|Carmen|Ana|Isabel|Pilar|Lucía|Sofía|Giulia|Chiara|Francesca|Анна|Мария|Ольга|Елена|Наталья|Татьяна|Ирина|Светлана|Ελένη|Μαρία|Κατερίνα|Σοφία"
)
#: In order; a mention is of the first kind that matches it whole.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.])(?<![vV])(?<![vV]ersion )(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_GROUP}:){{7}}{_GROUP}|{_GROUP}(?::{_GROUP}){{0,5}}::{_GROUP}(?::{_GROUP}){{0,5}})(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": rf"(?<![\p{{L}}])(?=[\p{{L}}])(?:{_TITLE}{_NAME}(?: {_NAME})?|(?:{GIVEN_MALE}|{GIVEN_FEMALE}) {_NAME}|\p{{IsHan}}{{2,4}}?(?:{HONORIFIC}))",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Parts of surrogate names: given names by script and gender, roots of surnames, their endings by gender.
_ENDINGS = ["ders", "feld", "gard", "ham", "mann", "more", "ner", "son"]
NAMES = {
    "latin": (["Adam", "Bruno", "Emil", "Hugo", "Karl", "Luis", "Marco", "Paul"], ["Anna", "Clara", "Elena", "Ida", "Julia", "Laura", "Maria", "Nora"], ["Al", "Bern", "Cor", "Dal", "Fen", "Gar", "Hol", "Kel", "Lor", "Mar", "Nor", "Ost", "Per", "Ros", "Tal", "Wen"], _ENDINGS, _ENDINGS),
    "cyrillic": (["Антон", "Борис", "Глеб", "Егор", "Иван", "Олег", "Пётр", "Юрий"], ["Алла", "Вера", "Дарья", "Ирина", "Лидия", "Нина", "Ольга", "Раиса"], ["Бел", "Вол", "Гор", "Дон", "Кал", "Лав", "Мор", "Нов", "Орл", "Пал", "Рог", "Сад", "Тал", "Фок", "Цар", "Чер"], ["ов", "ин", "евин", "анов", "енов", "ихин", "окин", "улин"], ["ова", "ина", "евина", "анова", "енова", "ихина", "окина", "улина"]),
    "greek": (["Αλέξης", "Βασίλης", "Θανάσης", "Ηλίας", "Μάριος", "Πέτρος", "Σταύρος", "Χρήστος"], ["Αγγελική", "Βάσω", "Δέσποινα", "Ζωή", "Ιωάννα", "Λίνα", "Ράνια", "Χαρά"], ["Βασιλ", "Γιανν", "Δαμ", "Θεοδ", "Καρ", "Λαμπρ", "Μαν", "Παπ"], ["όπουλος", "ίδης", "άκης", "άτος", "έας", "ούσης", "ώτης", "ινός"], ["οπούλου", "ίδου", "άκη", "άτου", "έα", "ούση", "ώτη", "ινού"]),
}
HAN = ["安", "白", "陈", "丁", "方", "高", "何", "江", "林", "马", "宁", "平", "石", "唐", "王", "杨"]
KEY = "surrogates-1"
#: Rows of entities that are broadcast at most (some 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000


def kind_of(mention: Column) -> Column:
    # look-arounds have done their work by now; a mention stands alone here
    out = F.when(F.lit(False), F.lit(""))
    for kind, p in KINDS.items():
        out = out.when(mention.rlike(f"^(?:{p})$"), F.lit(kind))
    return out


def person(mention: Column) -> tuple[Column, Column, Column]:
    """(title with the space behind it, given name or "", surname) of a person's mention; an honorific is no part of a name."""
    title = F.regexp_extract(mention, f"^{_TITLE}", 0)
    body = F.split(F.regexp_replace(F.substring(mention, F.length(title) + 1, F.length(mention)), f"(?:{HONORIFIC})$", ""), " ")
    return title, F.when(F.size(body) > 1, F.get(body, F.lit(0))).otherwise(""), F.element_at(body, -1)


def canonical(kind: Column, mention: Column) -> Column:
    title, given, surname = person(mention)
    gender = (
        F.when(title.rlike(rf"^(?:{MALE})\.? $"), "m").when(title.rlike(rf"^(?:{FEMALE})\.? $"), "f").when(given.rlike(f"^(?:{GIVEN_MALE})$"), "m").when(given.rlike(f"^(?:{GIVEN_FEMALE})$"), "f").otherwise("n")
    )
    script = F.when(surname.rlike(r"\p{IsCyrillic}$"), "cyrillic").when(surname.rlike(r"\p{IsGreek}$"), "greek").when(surname.rlike(r"\p{IsHan}$"), "han").otherwise("latin")
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(mention))
        .when(kind == "ip", mention)
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "person", F.concat_ws("|", gender, script, F.lower(surname)))
        .otherwise(F.regexp_replace(mention, "[^0-9]", ""))
    )


def _digits(h: Column) -> Column:
    return F.translate(h, "abcdef", "012345")


def _letters(h: Column) -> Column:
    return F.translate(h, "0123456789", "ghijkmnpqr")


def _pick(names: list[str], h: Column, at: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.conv(F.substring(h, at, 4), 16, 10).cast("int") % len(names)) + 1)


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _filled(layout: Column, digits: Column, letters: Column) -> Column:
    """``layout`` with its digits and lower-case letters taken, place by place, from the others."""
    take = lambda x, i: F.substring(x, i % 60 + 1, F.lit(1))
    return F.array_join(F.transform(_chars(layout), lambda c, i: F.when(c.rlike("[0-9]"), take(digits, i)).when(c.rlike("[a-z]"), take(letters, i)).otherwise(c)), "")


def luhn(digits: Column) -> Column:
    """The check digit that goes behind an odd number of digits."""
    one = lambda c, i: F.when(i % 2 == 0, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(_chars(digits), one), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of an account number in capitals."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return F.lpad((98 - F.aggregate(_chars(F.concat(rest, country, F.lit("00"))), F.lit(0), step)).cast("string"), 2, "0")


def surrogate(kind: Column, canon: Column, attempt: int, key: str = KEY) -> Column:
    """The canonical form of the surrogate. From the third attempt on it grows: digits, letters and name parts are added, and addresses take all octets and groups there are."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(str(attempt))), 256)
    digits, letters = _digits(h), _letters(h)
    grown = max(0, attempt - 2)
    local = F.concat(_filled(F.substring_index(canon, "@", 1), digits, letters), F.substring(letters, 50, grown))
    email = F.concat(local, F.lit("@"), _pick(["example.com", "example.net", "example.org"], h, 60))

    def octet(x: Column, i: Column) -> Column:
        v = F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return (v % 254 + 1 if grown else F.when(F.length(x) == 3, v % 155 + 100).when(F.length(x) == 2, v % 90 + 10).otherwise(v % 9 + 1)).cast("string")

    groups = F.concat_ws(":", *[F.substring(h, 4 * k + 1, 4) for k in range(8)])
    ip = groups if attempt > 12 else F.array_join(F.transform(F.split(canon, r"\."), octet), ".")
    ipv6 = groups if grown else F.array_join(F.transform(_chars(canon), lambda c, i: F.when(c == ":", c).otherwise(F.substring(h, i % 60 + 1, F.lit(1)))), "")
    more = F.substring(digits, 40, grown)
    number = F.concat(F.substring(digits, F.lit(1), F.length(canon)), more)
    body = F.substring(digits, 1, 15)
    card = F.concat(body, luhn(body), more)
    # a telephone number keeps its first digit, a social number goes where none is given out
    phone = F.concat(F.substring(canon, 1, 1), F.substring(digits, F.lit(1), F.length(canon) - 1), more)
    ssn = F.concat(F.lit("9"), F.substring(digits, 1, 8), more)
    country = F.substring(canon, 1, 2)
    account = F.concat(F.upper(_filled(F.lower(F.substring(canon, 5, 99)), digits, letters)), more)
    iban = F.concat(country, iban_check(country, account), account)
    surname = F.concat(F.substring_index(canon, "|", 2), F.lit("|"), *[_pick(HAN, h, 1 + 4 * k) for k in range(2 + grown)])
    given = F.lit("")
    for script, (male, female, roots, his, hers) in NAMES.items():
        of = lambda g: canon.startswith(f"{g}|{script}|")  # noqa: B023, E731
        added = F.lower(F.concat(F.lit(""), *[_pick(roots, h, 9 + 3 * k % 50) for k in range(grown)]))
        for gender, names, ends in (("m", male, his), ("f", female, hers), ("n", male + female, his)):
            name = F.lower(F.concat(_pick(roots, h, 1), added, _pick(ends, h, 5)))
            surname = F.when(of(gender), F.concat(F.lit(f"{gender}|{script}|"), name)).otherwise(surname)
            given = F.when(of(gender), F.lower(F.concat(_pick(names, h, 1), added))).otherwise(given)
    full = F.concat(F.substring_index(canon, "|", 3), F.lit("|"), given)
    by_kind = {"email": email, "ip": ip, "ipv6": ipv6, "card": card, "phone": phone, "ssn": ssn, "iban": iban, "person": surname, "full": full}
    out = number
    for k, v in by_kind.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def rendered(kind: Column, mention: Column, canon: Column, full: Column) -> Column:
    """A surrogate's canonical form in the layout of the mention it replaces; ``full`` is that of a full name."""
    before = lambda i, skip: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), skip, ""))
    one = lambda i: F.substring(mention, i, F.lit(1))

    def laid(skip: str) -> Column:
        """The canonical form's characters in the places of those not skipped, the rest of it behind."""
        each = F.transform(F.sequence(F.lit(1), F.length(mention)), lambda i: F.when(one(i).rlike(skip), one(i)).otherwise(F.substring(canon, before(i, skip), F.lit(1))))
        return F.concat(F.array_join(each, ""), F.substring(canon, before(F.length(mention), skip) + 1, F.length(canon)))

    title, given, _ = person(mention)
    first = F.when(given != "", F.concat(F.initcap(F.substring_index(full, "|", -1)), F.lit(" "))).otherwise("")
    name = F.concat(title, first, F.initcap(F.substring_index(canon, "|", -1)), F.regexp_extract(mention, f"(?:{HONORIFIC})$", 0))
    shout = F.when(mention == F.upper(mention), F.upper(canon)).otherwise(canon)
    return F.when(kind.isin("email", "ipv6"), shout).when(kind == "ip", canon).when(kind == "iban", laid(" ")).when(kind == "person", name).otherwise(laid("[^0-9]"))


def assignments(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon): no two alike, none an entity itself.

    Of entities that try for one surrogate the least gets it, the others try again.
    """
    todo = entities = stored(entities.distinct())
    done, attempt = None, 0
    while done is None or not todo.isEmpty():
        tried = todo.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), attempt, key))
        tried = tried.join(entities.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            tried = tried.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = tried.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate")
        done = stored(won if done is None else done.unionByName(won))
        todo = stored(entities.join(done, ["kind", "canon"], "left_anti"))
        attempt += 1
    return done


def small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if they are few; a hot entity then meets them in place, beyond, skewed partitions are split."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``entities``: array of (kind, replacement) in order.

    Needs doc_id and text, keeps all rows and further columns but one named ``entities``, which is replaced. Null
    and empty texts stay and have none; rows that repeat a text are treated alike; a null doc_id is one like others.
    Another ``key`` gives other surrogates, the same key the same ones for the same corpus.
    """
    text = F.col("text").cast("string")
    found = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("m")).where("size(m) > 0").distinct()
    each = found.select("doc_id", "mark", F.posexplode("m").alias("at", "mention"))
    each = stored(each.withColumn("kind", kind_of(F.col("mention"))).withColumn("canon", canonical(F.col("kind"), F.col("mention"))))
    given = person(F.col("mention"))[1]
    has = (F.col("kind") == "person") & (given != "")
    # rows without a full name keep their own form, so that the join deals them out
    each = each.withColumn("full", F.when(has, F.concat("canon", F.lit("|"), F.lower(given))).otherwise(F.col("canon")))
    full = each.where(has).select(F.lit("full").alias("kind"), F.col("full").alias("canon"))
    chosen = assignments(each.select("kind", "canon").unionByName(full), key)
    fulls = chosen.where("kind = 'full'").select(F.col("canon").alias("full"), F.col("surrogate").alias("full_surrogate"))
    named = each.join(small(chosen), ["kind", "canon"]).join(small(fulls), "full", "left").withColumn("with", rendered(F.col("kind"), F.col("mention"), F.col("surrogate"), F.col("full_surrogate")))
    rows = stored(named.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "with"))).alias("e")))
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS and each.count() <= BROADCAST_ROWS else rows
    names = [c for c in docs.columns if c != "entities"]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    text = F.col("row.text").cast("string")
    joined = d.join(rows, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("mark")), "left")
    parts = F.split(text, PATTERN, -1)
    whole = F.array_join(F.flatten(F.zip_with(parts, F.transform("e", lambda x: x["with"]), lambda p, w: F.array(p, F.coalesce(w, F.lit(""))))), "")
    out = F.when(F.col("e").isNull(), F.col("row.text")).otherwise(whole)
    entities = F.coalesce(F.transform("e", lambda x: F.struct(x["kind"].alias("kind"), x["with"].alias("replacement"))), F.array().cast("array<struct<kind: string, replacement: string>>"))
    return joined.select(*[out.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in names], entities.alias("entities"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("entities", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], "text")


QUERIES = {"op10_pii_surrogates": op10_pii_surrogates}
