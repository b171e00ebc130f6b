"""Personal data: detected entities get keyed surrogates of the same type, format, gender and script.

An entity is what a mention means, not how it is written: a number's national digits, an address in lower case, and of a
person the given name and the surname, each by itself.  So ``Mr. John Smith``, ``Mr. Smith`` and, in the same text, ``Smith``
keep one surname, and a number keeps its surrogate in every spelling.  Every entity has one surrogate in the whole corpus.

A surrogate is drawn with the key; where two entities draw the same, or one draws what is an entity of the corpus, all
but the first draw again, ``DRAWS`` times at most.  What is left then takes its reserve: a keyed permutation of its own
signs, which is injective and which no draw may take.  So surrogates are distinct however many entities there are, and
the work is bounded; an entity's reserve can be another entity only where draws found no free value.

All is DataFrame functions; what is drawn again is a table of distinct entities, not the texts.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import free, release, settled

#: The session's setting that holds the key.
KEY = "spark.windrow.surrogates.key"
#: The column that replaced() adds.
FOUND = "__found"
KINDS = ("email", "ip", "card", "phone", "name")
DRAWS = 8
_MALE, _FEMALE = r"Mr|Herr|Señor|Sr|Monsieur|Господин", r"Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Госпожа"
_LETTER = r"\p{L}\p{N}._%+-"
_TITLE = rf"(?:{_MALE}|{_FEMALE})\.? "
#: Detection, by kind; a match of an earlier kind goes first where two begin at one place.  A phone number has a plus sign, an
#: area code in brackets, the groups 3-3-4 or a leading zero: dates, versions and rows of numbers have none of these.
PATTERNS = {
    "email": rf"(?<![{_LETTER}])[{_LETTER}]++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "card": r"(?<![\p{L}\d.-])(?:\d{13,19}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4}(?: \d{4}){3})(?![\p{L}\d]|[.-]\d)",
    "phone": r"(?<![\p{L}\d.+-])(?:\+\d(?:[ .()-]{0,2}\d){7,14}|\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}|\d{3}([ .-])\d{3}\1\d{4}|0\d{2,4}[ -]\d{3,4}[ -]?\d{3,4})(?![\p{L}\d]|[.-]\d)",
    "name": rf"(?<![\p{{L}}]){_TITLE}\p{{Lu}}[\p{{Ll}}'-]*\p{{Ll}}(?: \p{{Lu}}[\p{{Ll}}'-]*\p{{Ll}})?",
}
# Given names and surnames by gender and script.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Klaus Louis Martin Nils Oscar Pablo".split(),
    ("f", "latin"): "Alice Berta Clara Diana Elena Flora Greta Helena Irene Julia Karin Laura Maria Nora Olga Paula".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур".split(),
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Зоя Инна Ксения Лариса Марина Нина Ольга Полина Раиса Софья".split(),
}
SURNAME = {
    "latin": "Abel Brandt Costa Duval Engel Fabre Garcia Hansen Iversen Jansen Keller Lopez Moreau Novak Olsen Peters".split(),
    "cyrillic": "Авдеенко Бойко Вальчук Гончар Дорош Живаго Зозуля Иваненко Кравец Литвин Мороз Небога Остапчук Павлюк Руденко Савчук".split(),
}
SYLLABLES = {"latin": "ba de fi go lu ma ne ri so ta ve zu ka li mo ra".split(), "cyrillic": "ба де фи го лу ма не ри со та ве зу ка ли мо ра".split()}
#: Signs that a permutation exchanges among themselves; a string with another letter is replaced by a keyed hash.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ")
# Country calling codes of one and two digits; all others have three.
_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
# First octets of which a part is no public network; such addresses keep two octets.
_SPECIAL = (0, 10, 100, 127, 169, 172, 192, 198, 203, *range(224, 256))
_PLAIN = [i for i in range(256) if i not in _SPECIAL]

# numbered groups are counted over all patterns, so the one of phone numbers gets its place here
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_made: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The key of the session's configuration; without one, a random key that lasts as long as this process."""
    own = spark.conf.get(KEY, None)
    return own if own else _made.setdefault("key", secrets.token_hex(32))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x written into the plan once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _hash(*parts: Column | str) -> Column:
    """256 bits as 64 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", *(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary"), 256)


def _number(h: Column, at: int, n: int = 4) -> Column:
    return F.conv(F.substring(h, at, n), 16, 10).cast("long")


def _shifted(s: Column, h: Column) -> Column:
    """Each sign moved on within its alphabet by a byte of the hash; other signs as they are."""

    def move(c: Column, i: Column) -> Column:
        step = F.conv(h.substr(((i * 2) % 62) + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 31).cast("int")
        out = c
        for signs in ALPHABETS:
            at = F.instr(F.lit(signs), c)
            out = F.when(at > 0, F.lit(signs).substr(((at - 1 + step) % len(signs)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(s) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.split(s, ""), move), ""))


def permuted(s: Column, key: str, what: str, attempt: str) -> Column:
    """A keyed permutation of the strings of one length and of one alphabet at each place: four rounds, each of which moves one half
    by a hash of the other, so that no two strings become one."""
    salt = f"{key}\x1e{what}\x1e{attempt}"
    n = F.ceil(F.length(s) / 2).cast("int")
    size = F.length(s).cast("string")
    halves = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    turn = lambda a, r: halves(_let(_hash(salt, r, a["x"], size), lambda h: _shifted(a["y"], h)), a["x"])
    return F.aggregate(F.array(*map(F.lit, "0123")), halves(s.substr(F.lit(1), n), s.substr(n + 1, F.length(s))), turn, lambda a: F.concat(a["x"], a["y"]))


def _known_signs(s: Column) -> Column:
    return ~F.translate(s, "".join(ALPHABETS), "").rlike(r"\p{L}")


def _word(s: Column, key: str, what: str, attempt: str) -> Column:
    return F.when(_known_signs(s), permuted(s, key, what, attempt)).otherwise(F.concat(F.lit("u"), F.substring(_hash(key, what, attempt, s), 1, 24)))


def _luhn(digits: Column, skip: int) -> Column:
    """The check sum of a string of digits, of which the last stands ``skip`` places before the end of the number."""
    d = F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int")))
    twice = F.transform(d, lambda x, i: F.when((i + skip) % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10


def _rest_permuted(digits: Column, key: str, what: str, attempt: str) -> Column:
    """The first digit stays, as it tells the kind of number."""
    return F.concat(digits.substr(F.lit(1), F.lit(1)), permuted(digits.substr(F.lit(2), F.length(digits)), key, what, attempt))


def _address(e: Column, key: str, attempt: str) -> Column:
    """Octet by octet moved by a hash of the others; what is special in its first octet keeps two, the rest stays plain."""
    plain = F.array(*map(F.lit, _PLAIN))

    def move(o: Column, i: Column) -> Column:
        others = F.concat_ws(".", F.transform(o, lambda x, k: F.when(k == i, F.lit("")).otherwise(x.cast("string"))))
        step = _number(_hash(key, "ip", attempt, i.cast("string"), others), 1).cast("int")
        special = o[0].isin(*_SPECIAL)
        first = F.element_at(plain, ((F.array_position(plain, o[0]) - 1 + step) % len(_PLAIN) + 1).cast("int"))
        return F.transform(o, lambda x, k: F.when((k != i) | (special & (k < 2)), x).when(k == 0, first).otherwise((x + step) % 256))

    octets = F.transform(F.split(e, r"\."), lambda x: x.cast("int"))
    return F.concat_ws(".", F.transform(F.aggregate(F.array(*map(F.lit, range(4))), octets, move), lambda x: x.cast("string")))


def _exact(kind: Column, e: Column, key: str, attempt: str) -> Column:
    """An injective surrogate of an entity that is not a name."""
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    host = F.substring_index(domain, ".", 1)
    # one host has one surrogate in all addresses
    email = F.concat(_word(local, key, "local", attempt), F.lit("@"), _word(host, key, "host", attempt if attempt == "reserve" else ""), domain.substr(F.length(host) + 1, F.length(domain)))
    # a right check digit stays right, and a wrong one as wrong as it was
    body = _rest_permuted(e.substr(F.lit(1), F.length(e) - 1), key, "card", attempt)
    card = _let(body, lambda b: F.concat(b, ((F.lit(10) - _luhn(b, 1) + _luhn(e, 0)) % 10).cast("string")))
    return F.when(kind == "email", email).when(kind == "ip", _address(e, key, attempt)).when(kind == "card", card).otherwise(_rest_permuted(e, key, "phone", attempt))


def drawn(kind: Column, e: Column, key: str, attempt: int) -> Column:
    """What an entity draws: numbers and addresses a permutation of their own, names one of the lists, later two, later syllables."""
    h = _hash(key, kind, e, str(attempt))
    name = F.lit(None).cast("string")
    for script in ("latin", "cyrillic"):
        for gender in ("m", "f", ""):
            pool = GIVEN[gender, script] if gender else SURNAME[script]
            pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (_number(h, at) % len(names) + 1).cast("int"))
            one = pick(pool, 1) if not attempt else F.concat(pick(pool, 1), F.lit("-"), pick(pool, 5)) if attempt == 1 else F.initcap(F.concat(*(pick(SYLLABLES[script], 4 * k + 1) for k in range(attempt + 2))))
            mine = (e.rlike(r"\p{IsCyrillic}") == F.lit(script == "cyrillic")) & (kind == (f"given_{gender}" if gender else "surname"))
            name = F.when(mine, one).otherwise(name)
    return F.when(kind.isin("given_m", "given_f", "surname"), name).otherwise(_exact(kind, e, key, str(attempt)))


def reserve(kind: Column, e: Column, key: str) -> Column:
    """What no other entity of the kind draws or reserves."""
    return F.when(kind.isin("given_m", "given_f", "surname"), F.initcap(_word(F.lower(e), key, "name", "reserve"))).otherwise(_exact(kind, e, key, "reserve"))


def dictionary(entities: DataFrame, key: str, draws: int = DRAWS) -> DataFrame:
    """(kind, norm, surrogate) of the distinct entities of a table (kind, norm): within a kind no two surrogates are equal, and none
    is an entity but for a reserve that met no free value."""
    kind, norm = F.col("kind"), F.col("norm")
    open_ = settled(entities.select("kind", "norm").distinct().withColumn("reserve", reserve(kind, norm, key)))
    first = open_
    taken = settled(open_.select("kind", norm.alias("surrogate")).unionByName(open_.select("kind", F.col("reserve").alias("surrogate"))).distinct())
    done = []
    for attempt in range(draws):
        tried = open_.withColumn("surrogate", drawn(kind, norm, key, attempt))
        turn = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("norm"))
        able = tried.join(taken, ["kind", "surrogate"], "left_anti").withColumn("turn", turn).where("turn = 1")
        done.append(settled(able.select("kind", "norm", "surrogate")))
        left = settled(open_.join(done[-1].select("kind", "norm"), ["kind", "norm"], "left_anti"))
        if open_ is not first:
            release(open_)
        open_ = left
        if not open_.limit(1).count():
            break
        taken = taken.unionByName(done[-1].select("kind", "surrogate"))
    return reduce(DataFrame.unionByName, [*done, open_.select("kind", "norm", F.col("reserve").alias("surrogate"))])


def _is(e: Column, kind: str) -> Column:
    return e.rlike(f"^(?:{PATTERNS[kind]})$")


def _people(es: Column) -> Column:
    """(given or null, surname, gender) of each titled name among the matches."""
    body = lambda e: F.split(F.regexp_replace(e, f"^{_TITLE}", ""), " ")
    person = lambda e: F.struct(
        F.when(F.size(body(e)) == 2, F.element_at(body(e), 1)).alias("given"), F.element_at(body(e), -1).alias("surname"), F.when(e.rlike(rf"^(?:{_MALE})\b"), F.lit("m")).otherwise(F.lit("f")).alias("gender")
    )
    return F.transform(F.filter(es, lambda e: e.rlike(f"^{_TITLE}")), person)


def _parts(e: Column, people: Column) -> Column:
    """An array of (lead, kind, norm, form) of a match: what stands before, the entity, and how it is written."""
    part = lambda lead, kind, norm, form: F.struct(lead.alias("lead"), kind.alias("kind"), norm.alias("norm"), form.alias("form"))
    plain = lambda kind, norm: F.array(part(F.lit(""), F.lit(kind), norm, e))
    digits = F.regexp_replace(e, r"\D", "")
    code = F.regexp_extract(e, _CODE, 0)
    phone = F.array(part(code, F.lit("phone"), F.regexp_replace(e.substr(F.length(code) + 1, F.length(e)), r"\D", ""), e.substr(F.length(code) + 1, F.length(e))))
    title = F.regexp_extract(e, f"^{_TITLE}", 0)
    surname = lambda p, lead: part(lead, F.lit("surname"), p["surname"], p["surname"])
    titled = _let(F.get(_people(F.array(e)), 0), lambda p: F.when(p["given"].isNull(), F.array(surname(p, title))).otherwise(F.array(part(title, F.concat(F.lit("given_"), p["gender"]), p["given"], p["given"]), surname(p, F.lit(" ")))))
    # a word alone is a name that a titled one of the same text has
    gender = F.get(F.filter(people, lambda x: x["given"] == e), 0)["gender"]
    lone = F.array(part(F.lit(""), F.when(F.exists(people, lambda x: x["surname"] == e), F.lit("surname")).otherwise(F.concat(F.lit("given_"), gender)), e, e))
    return (
        F.when(e.contains("@"), plain("email", F.lower(e))).when(title != "", titled).when(_is(e, "ip"), plain("ip", e)).when(_is(e, "card"), plain("card", digits))
        .when(e.rlike(r"^[+(\d]"), phone).otherwise(lone)
    )


def _written(part: Column, surrogate: Column) -> Column:
    """The surrogate in the form of the mention: digits fill the digits' places, capitals stay where they were."""
    form, kind = part["form"], part["kind"]
    signs = F.split(form, "")
    rank = lambda i: F.length(F.regexp_replace(form.substr(F.lit(1), i + 1), r"\D", ""))
    filled = F.array_join(F.transform(signs, lambda c, i: F.when(c.rlike(r"^\d$"), surrogate.substr(rank(i), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(form.substr(i + 1, F.lit(1)).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)), "")
    return F.concat(part["lead"], F.when(kind.isin("card", "phone"), filled).when(kind == "email", cased).otherwise(surrogate))


def replaced(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The rows with ``text`` replaced and ``__found``, a map from kind to how many mentions it had.

    A null text stays null and has none; a very long one is read whole; rows that repeat are replaced alike; of two entities that
    draw one surrogate the lesser keeps it; an empty table gives an empty one; columns of the input stay as they are, n_chars
    too.  The key is the session's (``KEY``) where none is given."""
    key = key or key_of(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.md5(text.cast("binary"))
    # words of people's names are looked for a second time, without titles, in the texts that have them
    mentions = docs.select(row.alias("key"), text.alias("text"), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)).alias("es")).where(F.size("es") > 0).withColumn("people", _people(F.col("es")))
    words = F.array_distinct(F.flatten(F.transform("people", lambda p: F.filter(F.array(p["given"], p["surname"]), lambda w: w.isNotNull()))))
    longest = F.array_sort(words, lambda a, b: F.length(b) - F.length(a))
    own = F.when(F.size("people") == 0, F.lit(_ANY)).otherwise(F.concat(F.lit(_ANY + r"|(?<![\p{L}'-])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}'-])")))
    again = mentions.withColumn("pattern", own).withColumn("es", F.when(F.size("people") == 0, F.col("es")).otherwise(F.regexp_extract_all("text", F.col("pattern"), F.lit(0))))
    parted = again.select("key", F.when(F.size("people") > 0, F.col("pattern")).alias("pattern"), F.transform("es", lambda e: _parts(e, F.col("people"))).alias("parts"))
    found = settled(parted.dropDuplicates(["key"]))
    seen = found.select("key", F.posexplode("parts").alias("i", "ps")).select("key", "i", F.posexplode("ps").alias("p", "part"))
    names = dictionary(seen.select("part.kind", "part.norm"), key)
    key_, new_, pattern_ = free(docs, "key", "new", "pattern")
    said = seen.select("*", "part.kind", "part.norm").join(names, ["kind", "norm"]).select("key", F.struct("i", "p", "kind", _written(F.col("part"), F.col("surrogate")).alias("said")).alias("x"))
    new = said.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("xs")).join(found.select("key", "pattern"), "key")
    joined = docs.withColumn(key_, row).join(new.select(F.col("key").alias(key_), F.col("xs").alias(new_), F.col("pattern").alias(pattern_)), key_, "left")
    plain = F.split(F.col("text"), F.coalesce(F.col(pattern_), F.lit(_ANY)), -1)
    # a mention's parts are its first one and what follows it
    last = F.element_at(F.col(new_), -1)["i"]
    whole = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.transform(F.filter(new_, lambda x: x["i"] == k), lambda x: x["said"]), ""))
    each = F.when(F.size(F.filter(new_, lambda x: x["p"] > 0)) == 0, F.transform(new_, lambda x: x["said"])).otherwise(whole)
    filled = F.array_join(F.transform(F.arrays_zip(plain.alias("a"), each.alias("b")), lambda z: F.concat(z["a"], F.coalesce(z["b"], F.lit("")))), "")
    kind = lambda x: F.when(x["kind"].isin(*KINDS[:4]), x["kind"]).otherwise(F.lit("name"))
    of = lambda k: F.filter(F.col(new_), lambda e: (kind(e) == k) & (e["p"] == 0))
    counts = F.create_map(*(x for k in KINDS for x in (F.lit(k), F.when(F.col(new_).isNull(), F.lit(0)).otherwise(F.size(of(k))).cast("long"))))
    own_ = [F.when(F.col(new_).isNull(), F.col("text")).otherwise(filled).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*own_, counts.alias(FOUND))
