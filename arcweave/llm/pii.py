"""Personal data replaced by surrogates, in DataFrame operations alone.

What is found is taken apart into units: an address of mail, a number, a given name,
a family name. A unit's surrogate is made by a keyed permutation of all values of its
format: letters stay letters of their script and case, digits stay digits, marks
stay where they are. Given names get one of the same gender from lists, or several
joined. No unit stays as it is, one unit has one surrogate wherever it stands, and
different units have different ones, for which all surrogates are checked against
each other and against all units found; those that collide are made anew.

So mentions corefer by their units: "Mrs Anna Schmidt", "Dr Schmidt" and a later
"Schmidt" share a family name. The gender of a given name is that of its titles in
all texts, not of the one beside it. In a text that names a person with a title, the
same names are replaced without one too. Addresses of mail corefer in any case.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import BROADCAST_BYTES, scratch, written

#: What is found, in this order of preference at one place.
_NAME = r"[\p{Lu}\p{Lt}][\p{L}'’-]+"
FEMALE, MALE, OTHER = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Señorita|Srta", "Mr|Herr|Monsieur|Señor|Sr", "Dr|Prof"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w+(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\d-])"
SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\d-])"
ACCOUNT = r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
CARD = r"(?<![\w-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])"
TITLE = rf"(?:{FEMALE}|{MALE}|{OTHER})\.? "
PERSON = rf"(?<!\p{{L}}){TITLE}{_NAME}(?: {_NAME})?"
ANY = "|".join((EMAIL, ADDRESS, PHONE, SOCIAL, ACCOUNT, CARD, PERSON))
#: A text without any of these holds none of the above; each alternative of ANY has one of them at least.
CUE = rf"@|\d{{3}}|\d\.\d|\+\d|[A-Z]{{2}}\d{{2}}|(?:{FEMALE}|{MALE}|{OTHER})\.? \p{{L}}"
#: First names by gender.
NAMES = {
    "f": "Anna Maria Julia Laura Sofia Clara Emma Lena Nora Alice Eva Ida Marta Lucia Elena Irene Helen Ruth Sara Vera".split(),
    "m": "Adam Paul Peter Simon Lucas Martin Oscar Hugo Felix David Anton Emil Jonas Victor Marco Bruno Henry Ralph Carl Leon".split(),
    "n": "Alex Robin Sascha Andrea Kim Dominique Claude Charlie Jamie Jordan Morgan Rene Taylor Noa Jule Toni Sam Chris Luca Mika".split(),
}
#: Letters that may stand for each other: of one script and case.
ALPHABETS = [
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýþß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝÞ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
_UPPER = ALPHABETS[1]
#: Ranges of code points that may stand for each other: ideographs and syllables.
RANGES = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x17000, 0x187F7), (0x20000, 0x2A6DF), (0x2A700, 0x2B739), (0x2B740, 0x2B81D), (0x2B820, 0x2CEA1), (0x2CEB0, 0x2EBE0), (0x30000, 0x3134A), (0x31350, 0x323AF)]
#: Collisions after which a name or an address of mail gets a longer surrogate, as short ones may be used up.
LONGER = 8


def _other_alphabets() -> list[str]:
    """All other letters and numbers, those of one script and category together."""
    known = {*"".join(ALPHABETS), *(chr(i) for low, high in RANGES for i in range(low, high + 1))}
    found: dict[tuple, list[str]] = defaultdict(list)
    for c in map(chr, range(128, sys.maxunicode + 1)):
        category = unicodedata.category(c)
        if category[0] in "LN" and c not in known:
            found[unicodedata.name(c, "?").split()[0].split("-")[0], category].append(c)
    out, alone = [], defaultdict(list)
    for (_, category), letters in found.items():
        if len(letters) > 1:
            out.append("".join(letters))
        else:
            alone[category] += letters
    return out + ["".join(letters) for letters in alone.values()]


OTHER_ALPHABETS = _other_alphabets()


def _moved(c: Column, by: Column, wide: bool) -> Column:
    """c moved within its alphabet; wide: in any script, else in ASCII alone."""
    code, out = F.ascii(c), c
    if wide:
        ranges = F.filter(F.array(*(F.struct(F.lit(low).alias("low"), F.lit(high - low + 1).alias("n")) for low, high in RANGES)), lambda r: (code >= r.low) & (code < r.low + r.n))
        letters = F.filter(F.split(F.lit(" ".join(ALPHABETS[3:] + OTHER_ALPHABETS)), " "), lambda a: F.instr(a, c) > 0)
        inside = F.transform(ranges, lambda r: F.decode(F.unhex(F.lpad(F.hex(r.low + (code - r.low + by) % r.n), 8, "0")), "UTF-32"))
        other = F.transform(letters, lambda a: F.substring(a, (F.instr(a, c) - 1 + by) % F.length(a) + 1, F.lit(1)))
        out = F.when(code < 128, c).otherwise(F.coalesce(F.get(inside, F.lit(0)), F.get(other, F.lit(0)), c))
    for letters in ALPHABETS[:3]:
        at = F.instr(F.lit(letters), c)
        out = F.when((c != "") & (at > 0), F.substring(F.lit(letters), (at - 1 + by) % len(letters) + 1, F.lit(1))).otherwise(out)
    return out


def permuted(value: Column, tweak: Column, key: str, wide: bool = True) -> Column:
    """A keyed permutation of strings with the same kinds of characters: four rounds of a Feistel network."""
    half = F.length(value) / 2
    start = F.struct(F.substring(value, F.lit(1), F.ceil(half).cast("int")).alias("l"), F.substring(value, F.ceil(half).cast("int") + 1, F.length(value)).alias("r"), tweak.alias("t"))

    def moved(part: Column, by: Column, tweak: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), by), 256)
        pad = lambda j: F.conv(F.substring(stream, (j * 2) % 62 + 1, F.lit(3)), 16, 10).cast("int")
        return F.array_join(F.transform(F.split(part, ""), lambda c, j: _moved(c, pad(j), wide)), "")

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        new = moved(F.when(odd, s.l).otherwise(s.r), F.when(odd, s.r).otherwise(s.l), s.t, i)
        return F.struct(F.when(odd, new).otherwise(s.l).alias("l"), F.when(odd, s.r).otherwise(new).alias("r"), s.t.alias("t"))

    return F.aggregate(F.array(*map(F.lit, range(4))), start, step, lambda s: F.concat(s.l, s.r))


def kind(value: Column) -> Column:
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(value.contains("@"), "email").when(whole(ADDRESS), "address").when(whole(CARD), "card").when(whole(SOCIAL), "social")
        .when(whole(PHONE), "phone").when(whole(ACCOUNT), "account").otherwise("person")
    )


def _checksum(digits: Column) -> Column:
    """The last digit that makes digits and it pass the test of card numbers."""
    n = F.length(digits)
    total = F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)).otherwise(c.cast("int")).cast("int")), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))
    )
    return (10 - total % 10) % 10


def _names(value: Column) -> tuple[Column, Column]:
    """Title and names of a person as it stands; the title may be empty."""
    title = F.regexp_extract(value, f"^{TITLE}", 0)
    return title, F.split(F.substring(value, F.length(title) + 1, F.length(value)), " ")


def _gender(title: Column) -> Column:
    return F.when(title.rlike(f"^(?:{FEMALE})\\b"), "f").when(title.rlike(f"^(?:{MALE})\\b"), "m").otherwise("n")


def units(value: Column, given: Column) -> Column:
    """Array of (unit, gender) of a value found: a letter for the kind of unit, a colon, and the unit; gender by its own title, of given names alone.

    given: the given names of the text, as a name alone may be one.
    """
    title, names = _names(value)
    first, last = F.get(names, F.lit(0)), F.get(names, F.lit(1))
    unit = lambda letter, v, gender=None: F.struct(F.concat(F.lit(letter + ":"), v).alias("unit"), (F.lit(None).cast("string") if gender is None else gender).alias("gender"))
    person = F.when(last.isNotNull(), F.array(unit("g", first, _gender(title)), unit("f", last))).when((title == "") & F.array_contains(given, first), F.array(unit("g", first, F.lit("n")))).otherwise(F.array(unit("f", first)))
    k = kind(value)
    return F.when(k == "person", person).when(k == "email", F.array(unit("e", F.translate(value, _UPPER, _UPPER.lower())))).otherwise(F.array(unit("v", value)))


def surrogate(unit: Column, attempt: Column, gender: Column, key: str) -> Column:
    """Of a unit; attempt counts how often one was made before that collided.

    What is permuted is chosen first and permuted once: letters of any script for
    names and mail, ASCII for numbers.
    """
    letter, value, again = F.substring(unit, 1, 1), F.substring(unit, F.lit(3), F.length(unit)), attempt.cast("string")
    p = lambda v, t, wide: permuted(v, F.concat(t, F.lit("/"), again), key, wide)
    number = lambda *parts: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), again, *parts), 256), 1, 8), 16, 10).cast("long")
    more = F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(key), again, value), 256), 1, 8), "0123456789abcdef", "abcdefghijklmnop")
    suffix = F.when(attempt >= LONGER, more).otherwise("")
    # names and mail
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    last = F.substring_index(domain, ".", -1)
    before = F.substring(domain, F.lit(1), F.length(domain) - F.length(last))
    fixed = ~F.concat(local, before).rlike(r"[\p{L}\p{N}]")
    longer = F.when((attempt >= LONGER) | (fixed & (attempt > 0)), more).otherwise("")
    mail = letter == "e"
    of_letters = F.when(letter != "v", p(F.when(mail, local).otherwise(value), F.when(mail, domain).when(letter == "g", "given").otherwise("family"), True))
    of_domain = F.when(mail, p(before, F.lit("domain"), True))
    pick = lambda i: F.element_at(F.when(gender == "f", F.array(*map(F.lit, NAMES["f"]))).when(gender == "m", F.array(*map(F.lit, NAMES["m"]))).otherwise(F.array(*map(F.lit, NAMES["n"]))), (number(i.cast("string"), value) % 20 + 1).cast("int"))
    listed = F.array_join(F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(3))), pick), "-")
    latin = (letter == "g") & value.rlike(r"^[\x00-ɏ’]+$")
    # numbers
    k = kind(value)
    digits = F.regexp_replace(value, "[^0-9]", "")
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    code = F.regexp_extract(value, r"^(\+\d{1,3}(?=[^\d]))", 1)
    of_digits = F.when(letter == "v", p(F.when(k == "card", body).when(k == "phone", F.substring(value, F.length(code) + 1, F.length(value))).when(k == "account", F.substring(value, F.lit(3), F.length(value))).otherwise(value), k, False))
    octets = F.split(value, r"\.")
    shift = lambda mine, other, i: F.array_join(
        F.transform(F.split(mine, r"\."), lambda o, j: ((o.cast("int") + F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), again, F.lit(i), other), 256), j * 4 + 1, F.lit(4)), 16, 10).cast("int")) % 256).cast("string")), "."
    )
    valid = (k == "address") & F.forall(octets, lambda o: (o.cast("int") < 256) & (o == o.cast("int").cast("string")))
    front, back = F.substring_index(value, ".", 2), F.substring_index(value, ".", -2)
    moved = shift(back, front, "a")
    mark = F.substring(value, 5, 1)

    def card(new: Column) -> Column:
        check = (F.right(digits, F.lit(1)).cast("int") + 10 - _checksum(body) + _checksum(new)) % 10  # as valid, or as far from it, as before
        whole = F.concat(new, check.cast("string"))
        return F.when(mark.rlike("[ -]"), F.concat(F.substring(whole, 1, 4), mark, F.substring(whole, 5, 4), mark, F.substring(whole, 9, 4), mark, F.substring(whole, F.lit(13), F.length(whole)))).otherwise(whole)

    def put(s: Column) -> Column:
        return (
            F.when(mail, F.concat(s["letters"], longer, F.lit("@"), s["domain"], last)).when(latin, F.concat(listed, suffix)).when(letter != "v", F.concat(s["letters"], suffix))
            .when(valid, F.concat(shift(front, moved, "b"), F.lit("."), moved)).when(s["kind"] == "card", card(s["digits"]))
            .when(s["kind"] == "phone", F.concat(code, s["digits"])).when(s["kind"] == "account", F.concat(F.substring(value, 1, 2), s["digits"])).otherwise(s["digits"])
        )

    once = F.array(F.struct(of_letters.alias("letters"), of_domain.alias("domain"), of_digits.alias("digits"), k.alias("kind")))
    return F.get(F.transform(once, put), F.lit(0))


def _cased(new: Column, like: Column) -> Column:
    """new in the case of like, letter by letter, where both are as long."""
    letters = F.transform(F.split(new, ""), lambda c, i: F.when(F.substring(like, i + 1, F.lit(1)).rlike("^[A-Z]"), F.translate(c, _UPPER.lower(), _UPPER)).otherwise(c))
    return F.when(F.length(new) == F.length(like), F.array_join(letters, "")).otherwise(new)


def _mention(value: Column, given: Column, known: Column, key: str) -> Column:
    """What stands for a value found; known: map of units to (attempt, gender) where these aren't 0 and that of the own title."""

    def made(u: Column) -> Column:
        at = F.try_element_at(known, u["unit"])
        return surrogate(u["unit"], F.coalesce(at["attempt"], F.lit(0)), F.coalesce(at["gender"], u["gender"]), key)

    title, _ = _names(value)
    k, parts = kind(value), F.transform(units(value, given), made)
    return F.when(k == "person", F.concat(title, F.array_join(parts, " "))).when(k == "email", _cased(F.get(parts, F.lit(0)), value)).otherwise(F.get(parts, F.lit(0)))


def _found(docs: DataFrame) -> DataFrame:
    """docs with values, in the order in which they stand, given, the given names among them, and names, a pattern of the persons' names or null."""
    titled = F.when(F.col("text").rlike(CUE), F.regexp_extract_all("text", F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    persons = F.transform(F.filter("values", lambda v: kind(v) == "person"), lambda v: _names(v)[1])
    docs = docs.withColumn("values", titled).withColumn("persons", persons)
    two = F.filter("persons", lambda n: F.size(n) == 2)
    names = F.concat(F.transform(two, lambda n: F.array_join(n, " ")), F.transform("persons", lambda n: F.element_at(n, -1)), F.transform(two, lambda n: F.get(n, F.lit(0))))
    pattern = F.concat(F.lit(ANY + r"|(?<![\p{L}'’-])(?:"), F.array_join(F.array_distinct(names), "|"), F.lit(r")(?![\p{L}'’-])"))
    docs = docs.withColumn("given", F.array_distinct(F.transform(two, lambda n: F.get(n, F.lit(0))))).withColumn("names", F.when(F.size("persons") > 0, pattern))
    return docs.withColumn("values", F.when(F.col("names").isNotNull(), F.regexp_extract_all("text", F.col("names"), F.lit(0))).otherwise(F.col("values"))).drop("persons")


def _attempts(found: DataFrame, key: str) -> DataFrame:
    """(unit, gender, attempt) of all units (unit, gender): attempt is the first whose surrogate doesn't collide.

    Two surrogates collide if they are equal, and one collides with the units of the
    texts if it equals any, its own too. Of surrogates that are equal the smallest
    unit keeps its own.
    """
    parts = 2 * found.sparkSession.sparkContext.defaultParallelism
    new = lambda units: units.repartition(parts, "unit").withColumn("made", surrogate(F.col("unit"), F.col("attempt"), F.col("gender"), key))
    made = written(new(found.select("unit", "gender", F.lit(0).alias("attempt"))), "surrogates")
    real = made.select(F.substring("unit", F.lit(3), F.length("unit")).alias("made")).distinct()
    while True:
        twice = made.groupBy("made").agg(F.min(F.struct("attempt", "unit")).alias("first"), F.count("*").alias("n")).where("n > 1")
        equal = made.join(twice, "made").where(F.col("unit") != F.col("first.unit")).select("unit")
        again = written(equal.unionByName(made.join(real, "made", "left_semi").select("unit")).distinct(), "again")
        if again.isEmpty():
            return made.select("unit", "gender", "attempt")
        late = new(made.join(again, "unit", "left_semi").select("unit", "gender", (F.col("attempt") + 1).alias("attempt")))
        made = written(made.join(again, "unit", "left_anti").unionByName(late), "surrogates")


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with text, n_found and surrogates: the text with all values replaced, and what they became.

    All rows and their doc_id are kept; repeated rows give repeated rows. A null
    text stays null with nothing found, an empty one empty. Columns besides doc_id
    and text aren't read. key: the secret that the surrogates depend on; another key
    gives others. A very long text is held whole in its task.

    Texts aren't shuffled: surrogates are computed where a value stands. Only the
    distinct units are, for the check, and those whose surrogate isn't the first one
    or whose gender isn't that of each title: these are joined to the documents they
    stand in, which are broadcast within BROADCAST_BYTES, else shuffled.
    """
    rows = _found(docs.select("doc_id", "text"))
    with scratch(docs.sparkSession):
        each = F.explode(F.array_distinct(F.flatten(F.transform("values", lambda v: units(v, F.col("given"))))))
        mentions = written(rows.where(F.size("values") > 0).select("doc_id", F.xxhash64("text").alias("copy"), each.alias("u")).select("doc_id", "copy", "u.*"), "mentions")
        has = lambda g: F.coalesce(F.max(F.col("gender") == g), F.lit(False))
        gender = F.when(F.substring("unit", 1, 1) != "g", None).when(has("f") & ~has("m"), "f").when(has("m") & ~has("f"), "m").otherwise("n")
        found = written(mentions.groupBy("unit").agg(gender.alias("gender"), (F.count_distinct("gender") > 1).alias("mixed")), "units")
        late = _attempts(found, key).join(found.select("unit", "mixed"), "unit").where("attempt > 0 or mixed").select("unit", "attempt", "gender")
        late = written(late, "collided")
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<attempt:int,gender:string>>"))
        if late.isEmpty():
            rows = rows.withColumn("known", none)
        else:
            by = late.join(mentions.select("doc_id", "copy", "unit").distinct(), "unit").groupBy("doc_id", "copy").agg(F.map_from_entries(F.collect_list(F.struct("unit", F.struct("attempt", "gender")))).alias("known"))
            by = written(by, "collided-in", lasting=True).withColumnRenamed("doc_id", "_id")
            by = F.broadcast(by) if by.count() * 400 <= BROADCAST_BYTES else by
            rows = rows.join(by, rows["doc_id"].eqNullSafe(by["_id"]) & (F.xxhash64("text") == by["copy"]), "left").withColumn("known", F.coalesce("known", none))
    made = F.transform("values", lambda v: _mention(v, F.col("given"), F.col("known"), key))
    rows = rows.select("doc_id", "text", "values", "names", F.when(F.size("values") > 0, made).otherwise(F.array().cast("array<string>")).alias("surrogates"))
    between = F.when(F.col("names").isNull(), F.split("text", ANY, -1)).otherwise(F.split("text", F.col("names"), -1))
    text = F.array_join(F.zip_with(between, F.col("surrogates"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return rows.select("doc_id", F.when(F.size("surrogates") > 0, text).otherwise(F.col("text")).alias("text"), F.coalesce(F.size("surrogates"), F.lit(0)).cast("long").alias("n_found"), F.transform("values", kind).alias("kinds"), "surrogates")
