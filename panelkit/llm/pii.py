"""Surrogates for personal data, in DataFrame functions only.

Detected entities get replacements drawn from a keyed digest of their canonical
form: the same entity gets the same replacement everywhere and in every spelling,
letters stay letters of their case and script, digits stay digits, separators stay.
Names are given names of the lists below with a surname; a part of such a name that
stands alone elsewhere in the text gets the same part of the replacement.
A table of the distinct entities finds replacements that coincide with each other
or with an entity of the corpus; those entities are drawn again until none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.shared import boxed, pinned, unboxed

#: Given names by gender and script (fixed values); a surname must follow.
GIVEN_NAMES = {
    "female_latin": "Alice Amelia Ana Andrea Angela Anita Anna Anne Astrid Barbara Beatriz Birgit Brigitte Camille Carla Carmen Caroline Catherine Charlotte Chiara Christine Claire Clara Claudia Diana Elena Elisabeth Elizabeth Emily Emma Eva Fatima Fiona Francesca Gabriele Giulia Grace Greta Hannah Heike Helen Ingrid Irene Isabel Jane Jennifer Jessica Joan Johanna Julia Karen Katharina Kate Laura Lena Linda Lisa Lucia Luisa Margaret Maria Marie Marta Mary Mei Michelle Monica Monika Nancy Natalie Nicole Nina Nora Olivia Patricia Paula Petra Pilar Priya Rachel Rebecca Rosa Ruth Sabine Samantha Sandra Sara Sarah Silvia Sofia Sophie Stefanie Susan Susanne Teresa Ursula Valentina Victoria Yolanda Yuki Zoe",
    "male_latin": "Adam Alan Albert Alberto Alejandro Alexander Ali Andre Andreas Andrew Anthony Antonio Arthur Ben Benjamin Bernd Bob Brian Carl Carlos Charles Christian Christopher Daniel David Diego Dieter Dirk Edward Eduardo Eric Ernst Felix Fernando Francisco Frank Franz Fritz George Gerhard Giovanni Gregory Hans Harold Heinrich Henry Hiroshi Hugo Ivan Jack Jacob James Jan Javier Jean Jeffrey Jens Joachim Joe John Jonathan Jorge Jose Joseph Juan Jürgen Karl Kenji Kevin Klaus Lars Leonardo Louis Luca Luis Lukas Manuel Marco Mario Mark Martin Matthew Max Michael Miguel Mohammed Nicholas Nicolas Oliver Oscar Otto Pablo Patrick Paul Pedro Peter Philip Philippe Pierre Rafael Ralf Raj Richard Robert Roberto Roger Ronald Samuel Sebastian Sergio Simon Stefan Stephen Steven Sven Thomas Timothy Tom Uwe Victor Walter Wei Werner William Wolfgang",
    "female_cyrillic": "Александра Анастасия Анна Валентина Вера Виктория Галина Дарья Екатерина Елена Ирина Ксения Людмила Марина Мария Надежда Наталья Нина Ольга Светлана Софья Татьяна Юлия",
    "male_cyrillic": "Александр Алексей Андрей Антон Борис Василий Виктор Владимир Григорий Дмитрий Евгений Иван Игорь Кирилл Константин Максим Михаил Николай Олег Павел Пётр Роман Сергей Фёдор Юрий",
}
#: Syllables that surnames are made of (fixed values).
SYLLABLES = {"latin": "ba be do fa ga ha ke la lo ma mi na no pa ra ri sa so ta va", "cyrillic": "ба бе до фа га ха ке ла ло ма ми на но па ра ри са со та ва"}
#: What may stand between given name and surname, and before the rest of a surname (fixed values).
PARTICLES = "van von de del della der den di da dos la le zu bin al ter"


def _trie(words: list[str]) -> str:
    """A pattern of some words in which no beginning is tried twice."""
    if words == [""]:
        return ""
    by: dict[str, list[str]] = {}
    for w in words:
        if w:
            by.setdefault(w[0], []).append(w[1:])
    inner = "|".join(c + _trie(rest) for c, rest in by.items())
    return f"(?:{inner})?+" if "" in words else f"(?:{inner})" if len(by) > 1 else inner


_SURNAME = r"(?:Mc|Mac|[OD]['’])?\p{Lu}\p{Ll}{1,30}(?:-\p{Lu}\p{Ll}{1,30}){0,2}(?![\p{L}])"
_INITIALS = r"(?:[ ]\p{Lu}\.){0,2}"


def _person(names: str) -> str:
    """A given name, initials, particles and a surname or two; or given name and surname in capitals."""
    listed = names.split()
    mixed = rf"{_trie(listed)}(?!\p{{L}}){_INITIALS}[ ](?:(?:{'|'.join(PARTICLES.split())})[ ]){{0,2}}{_SURNAME}(?:[ ]{_SURNAME}(?![ ]?[:\d@(+]))?"
    # One look at the first letter spares most words all of the names.
    initials = "".join(sorted({n[0] for n in listed}))
    return rf"(?=[{initials}])(?:{mixed}|{_trie([n.upper() for n in listed])}[ ]\p{{Lu}}{{2,30}}(?:-\p{{Lu}}{{2,30}})?(?!\p{{L}}))"


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Patterns in order of precedence, of what no letter or digit stands before (``START``). All repetitions are bounded or cannot restart inside a run, so that matching is linear.
START = r"(?<![\p{L}\p{N}])"
PATTERNS: dict[str, str] = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}",
    "ip": rf"(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ipv6": rf"(?=[0-9A-Fa-f:])(?<![_:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{1,7}}:|::{_HEX}(?::{_HEX}){{1,6}})(?![\w:])",
    "phone": r"(?=[+(\d])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3}[ ]\d{3}[ ]\d{4}(?![ ]\d)|0\d{2,4}[ /]\d{6,8}|\+(?=(?:[ .()-]{0,3}\d){8,15}(?![\p{L}\d]))\d{1,3}(?:[ .-]{1,2}\d{1,4}){3,6})(?![\p{L}\d])",
    "national_id": r"\d{3}(?<!-\d{3})-\d{2}-\d{4}(?![\p{L}\d-])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "card": r"\d(?:[ -]?\d){12,18}(?![\p{L}\d])",
    "secret": r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,64})(?![\p{L}\d])",
    **{k: _person(v) for k, v in GIVEN_NAMES.items()},
}
KINDS = list(PATTERNS)
ANY = START + "(?:" + "|".join(PATTERNS.values()) + ")"
#: Kinds of numbers that are none after all stay as they are.
KEPT = "number"

#: The country code of a number in international form, by its digits alone (fixed values of E.164): one digit, two, or else three.
COUNTRY = r"^\+([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Exceptions that may travel as a literal map; more of them are joined.
LITERAL_EXCEPTIONS = 1_000
#: Draws after which an entity without a replacement of its own gets a code in place of one.
ATTEMPTS = 24
CODED = -1
#: Stand around an entity, its kinds and its end while a text is cut up; texts that hold them are cut up another way.
_OPEN, _SLOT, _CLOSE = "\x01", "\x02", "\x03"


def entities(text: Column) -> Column:
    """Structs ``kind``, ``e`` and ``gap``, the text up to the next entity, of a text in order, after one of no kind for what stands before the first.

    One pass marks each entity and the group of the pattern that found it; a null text is empty.
    """
    text = F.coalesce(text, F.lit(""))
    grouped = START + "(?:" + "|".join(f"({p})" for p in PATTERNS.values()) + ")"
    marked = F.regexp_replace(text, F.lit(grouped), F.lit(_OPEN + _SLOT.join(f"${k + 1}" for k in range(len(KINDS))) + _CLOSE))
    kinds = F.array(*map(F.lit, KINDS))

    def opened(part: Column) -> Column:
        found = F.substring_index(part, _CLOSE, 1)
        at = F.length(F.regexp_extract(found, f"^{_SLOT}*", 0))
        e = F.replace(found, F.lit(_SLOT), F.lit(""))
        return F.struct(settled(e, F.element_at(kinds, at + 1)).alias("kind"), e.alias("e"), F.substring_index(part, _CLOSE, -1).alias("gap"))

    first = lambda gap: F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("e"), gap.alias("gap")))
    quick = _bound(F.split(marked, _OPEN, -1), lambda parts: F.concat(first(F.element_at(parts, 1)), F.transform(F.slice(parts, F.lit(2), F.size(parts)), opened)))
    gaps = F.split(text, ANY, -1)
    listed = F.zip_with(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.slice(gaps, F.lit(2), F.size(gaps)), lambda e, gap: F.struct(settled(e, kind_of(e)).alias("kind"), e.alias("e"), gap.alias("gap")))
    return F.when(F.rlike(text, F.lit(f"[{_OPEN}-{_CLOSE}]")), F.concat(first(F.element_at(gaps, 1)), listed)).otherwise(quick)


def kind_of(entity: Column) -> Column:
    """The kind of a detected entity."""
    out = F.when(F.rlike(entity, F.lit(f"^(?:{PATTERNS['email']})$")), "email")
    for kind, pattern in list(PATTERNS.items())[1:]:
        out = out.when(F.rlike(entity, F.lit(f"^(?:{pattern})$")), kind)
    return out.otherwise("other")


def _luhn(digits: Column) -> Column:
    """The sum of the digits by the rule of card numbers, over ten; 0 for a valid number."""
    value = lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    listed = F.transform(F.split(F.reverse(digits), ""), lambda c, i: value(c.cast("int"), i))
    return F.aggregate(F.filter(listed, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10


def _mod97(plain: Column) -> Column:
    """The remainder of an account number by the rule of its check digits; 1 for a valid number."""
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    number = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(number(c) > 9, a * 100 + number(c)).otherwise(a * 10 + number(c)) % 97)


def settled(entity: Column, kind: Column) -> Column:
    """``kind``, but a bare row of digits is a card only by its check digit."""
    return F.when((kind == "card") & F.rlike(entity, F.lit(r"^\d+$")) & (_luhn(entity) != 0), KEPT).otherwise(kind)


def canonical(entity: Column, kind: Column) -> Column:
    """One form for all spellings: numbers without separators, but for the plus sign of a phone number; the rest in lower case.

    A replacement of this form has the digits that one of any spelling has, and keeps the same ones.
    """
    plain = F.regexp_replace(entity, "[^\\p{L}\\p{N}]", "")
    phone = F.concat(F.regexp_extract(entity, r"^\+?", 0), plain)
    return F.when(kind == "phone", phone).when(kind.isin("card", "iban", "national_id"), F.upper(plain)).otherwise(F.lower(entity))


def _draw(digest: Column, at: Column) -> Column:
    """A number below 65,536 from four hex digits of a digest; positions run round it."""
    return F.conv(F.substring(digest, (F.pmod(at * 3, F.lit(61)) + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _char(c: Column, draw: Column, hex_only: Column) -> Column:
    """A letter or digit of the class of ``c``; any other character stays."""
    lower = "abcdefghijklmnopqrstuvwxyz"
    cyrillic = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    greek = "αβγδεζηθικλμνξοπρστυφχψω"
    pick = lambda s, n=None: F.substring(F.lit(s), (F.pmod(draw, F.lit(n or len(s))) + 1).cast("int"), F.lit(1))
    return (
        F.when(c.between("0", "9"), pick("0123456789"))
        .when(c.between("a", "z"), F.when(hex_only, pick(lower, 6)).otherwise(pick(lower)))
        .when(c.between("A", "Z"), F.when(hex_only, F.upper(pick(lower, 6))).otherwise(F.upper(pick(lower))))
        .when(F.rlike(c, F.lit(r"\p{IsCyrillic}")), F.when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(pick(cyrillic))).otherwise(pick(cyrillic)))
        .when(F.rlike(c, F.lit(r"\p{IsGreek}")), F.when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(pick(greek))).otherwise(pick(greek)))
        .when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(pick(lower)))
        .when(F.rlike(c, F.lit(r"\p{L}")), pick(lower))
        .otherwise(c)
    )


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is made once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def surrogate(entity: Column, kind: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity: of its kind and format, drawn by ``key``, its canonical form and ``attempt``.

    Cards and account numbers with a valid check digit get one with a valid check digit. ``CODED`` as the attempt gives a
    code of the kind and the digest, which needs no free number or name.
    """
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), canonical(entity, kind)), 256)
    # A syllable or letter more at each third attempt, so that names and addresses never run out.
    more = F.floor(attempt / 3).cast("int")
    coded = lambda d: F.concat(F.lit("["), kind, F.lit("-"), F.substring(d, 1, 32), F.lit("]"))
    octet = lambda d: lambda i: (F.pmod(_draw(d, i), F.lit(254)) + 1).cast("string")
    octets = lambda d: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), octet(d)), ".")
    made = lambda d: (
        F.when(attempt == CODED, coded(d)).when(kind == "ip", octets(d)).when(kind.isin(*GIVEN_NAMES), _named(entity, kind, more, d)).otherwise(_redrawn(entity, kind, more, d))
    )
    return _bound(digest, made)


def _letter(digest: Column, i: Column) -> Column:
    return F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.pmod(_draw(digest, i), F.lit(26)) + 1).cast("int"), F.lit(1))


def _named(entity: Column, kind: Column, more: Column, digest: Column) -> Column:
    """A given name for the first part, letters for initials, surnames for the rest but particles; all in capitals where the entity is."""
    strings = lambda words: F.array(*map(F.lit, words.split()))
    pick = lambda items, at: F.element_at(items, (F.pmod(at, F.size(items)) + 1).cast("int"))
    given = F.when(kind == "female_latin", strings(GIVEN_NAMES["female_latin"]))
    for name_kind, listed in list(GIVEN_NAMES.items())[1:]:
        given = given.when(kind == name_kind, strings(listed))
    syllables = F.when(kind.endswith("cyrillic"), strings(SYLLABLES["cyrillic"])).otherwise(strings(SYLLABLES["latin"]))
    surname = lambda i, h: F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), more + 2), lambda k: pick(syllables, _draw(digest, 1 + k + 11 * i + 5 * h))), ""))
    part = lambda t, i: (
        F.when(i == 0, pick(given, _draw(digest, F.lit(0))))
        .when(F.rlike(t, F.lit(r"^\p{L}\.$")), F.concat(F.upper(_letter(digest, 40 + i)), F.lit(".")))
        .when(t.isin(*PARTICLES.split()), t)
        .otherwise(F.array_join(F.transform(F.split(t, "-"), lambda _, h: surname(i, h)), "-"))
    )
    name = F.array_join(F.transform(F.split(entity, " "), part), " ")
    return _bound(name, lambda n: F.when(F.rlike(entity, F.lit(r"\p{Ll}")), n).otherwise(F.upper(n)))


def _redrawn(entity: Column, kind: Column, more: Column, digest: Column) -> Column:
    """Letters and digits drawn anew by their place among letters and digits, with what the kind asks for."""
    plain = lambda text: F.regexp_replace(text, "[^\\p{L}\\p{N}]", "")
    tld = F.regexp_extract(entity, r"\.[A-Za-z]{2,24}$", 0)
    base = F.when(kind == "email", F.regexp_replace(entity, r"\.[A-Za-z]{2,24}$", "")).when(kind == "iban", F.upper(entity)).otherwise(entity)
    country = F.length(F.regexp_extract(canonical(entity, F.lit("phone")), COUNTRY, 1))
    skip = F.when(kind == "phone", country).when(kind == "iban", 2).when(kind == "card", 1).otherwise(0)
    hexed = (kind == "ipv6") | ((kind == "secret") & F.rlike(entity, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")))

    def by_char(x: Column) -> Column:
        """The first ``skip`` letters and digits stay."""
        place = lambda i: F.length(plain(F.substring(x["text"], F.lit(1), i.cast("int"))))
        char = lambda c, i: _bound(place(i), lambda at: F.when(at < x["skip"], c).otherwise(_char(c, _draw(digest, at), x["hexed"])))
        return F.array_join(F.transform(F.split(x["text"], ""), char), "")

    longer = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: _letter(digest, 20 + i)), "")).otherwise(F.lit(""))

    def checked(c: Column) -> Column:
        mail = F.concat(F.substring_index(c, "@", 1), longer, F.lit("@"), F.substring_index(c, "@", -1), tld)
        head, tail = F.substring(c, F.lit(1), F.length(c) - 1), F.substring(c, F.lit(5), F.length(c))
        card = F.concat(head, F.pmod(10 - _luhn(F.concat(plain(head), F.lit("0"))), F.lit(10)).cast("string"))
        land = F.substring(c, F.lit(1), F.lit(2))
        iban = F.concat(land, F.lpad((98 - _mod97(F.concat(land, F.lit("00"), plain(tail)))).cast("string"), 2, "0"), tail)
        return (
            F.when(kind == "email", mail)
            .when(kind == "card", F.when(_luhn(plain(entity)) == 0, card).otherwise(c))
            .when(kind == "iban", F.when(_mod97(F.upper(plain(entity))) == 1, iban).otherwise(c))
            .otherwise(c)
        )

    return _bound(_bound(F.struct(base.alias("text"), skip.alias("skip"), hexed.alias("hexed")), by_char), checked)


def exceptions(docs: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canon`` and ``attempt`` of the entities whose first replacement coincides with another one or with an entity.

    Distinct entities are found map-side first; only those, never texts, are shuffled. What has no replacement of its own
    after ``ATTEMPTS`` draws gets ``CODED``.
    """
    # The outer form: the plain one would find all entities again to see whether there are any.
    found = docs.select(F.explode_outer(entities(F.col("text"))).alias("x")).where(~F.col("x.kind").isin("", KEPT))
    known = pinned(found.select(F.col("x.kind").alias("kind"), canonical(F.col("x.e"), F.col("x.kind")).alias("canon")).distinct())

    def drawn(rows: DataFrame, attempt: int) -> DataFrame:
        made = surrogate(F.col("canon"), F.col("kind"), F.lit(attempt), key)
        return rows.select("kind", "canon", F.lit(attempt).alias("attempt"), canonical(made, F.col("kind")).alias("made"))

    settled_rows, open_rows, out = None, known, known.limit(0).withColumn("attempt", F.lit(1))
    for attempt in range(ATTEMPTS):
        made = drawn(open_rows, attempt)
        first = made.groupBy("kind", "made").agg(F.min("canon").alias("canon"))
        good = first.join(known.select("kind", F.col("canon").alias("made")), ["kind", "made"], "left_anti")
        if settled_rows is not None:
            good = good.join(settled_rows, ["kind", "made"], "left_anti")
        good = good.withColumn("attempt", F.lit(attempt))
        left = pinned(open_rows.join(good.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        if attempt:
            out = out.unionByName(good.select("kind", "canon", "attempt"))
        if left.isEmpty():
            break
        settled_rows = good.select("kind", "made") if settled_rows is None else settled_rows.unionByName(good.select("kind", "made"))
        settled_rows = pinned(settled_rows)
        open_rows = left
    else:
        out = out.unionByName(open_rows.withColumn("attempt", F.lit(CODED)))
    return pinned(out)


#: Where letters and other characters meet.
_BORDER = r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})"


def _lone(new: Column) -> Column:
    """The parts of the persons of a text and of their replacements, as written and in capitals: what a lone mention stands for."""
    persons = F.filter(new, lambda x: x["kind"].isin(*GIVEN_NAMES))
    listed = lambda column: F.flatten(F.transform(persons, lambda x: F.split(x[column], "[ -]")))
    pairs = F.zip_with(listed("e"), listed("made"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(pairs, lambda p: F.rlike(p["a"], F.lit(r"^\p{Lu}\p{L}{2,}$")))
    pairs = F.concat(pairs, F.transform(pairs, lambda p: F.struct(F.upper(p["a"]).alias("a"), F.upper(p["b"]).alias("b"))))
    olds = F.transform(pairs, lambda p: p["a"])
    # Of two persons who share a name the first in the text is meant.
    distinct = F.array_distinct(olds)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda a: F.element_at(pairs, F.array_position(olds, a).cast("int"))["b"]))


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with every entity of ``text`` replaced, and ``n_replaced``, the entities; other columns unchanged, a clashing ``n_replaced`` is replaced.

    Where a text names a person in full, later or earlier mentions of a part of that name alone get the part of the same
    replacement; they don't count. A null text stays null. Texts without an entity stay as they are; repeated rows and
    equal texts get equal results.
    """
    names = [c for c in docs.columns if c != "n_replaced"]
    given = boxed(docs.drop("n_replaced"), text)
    redraw = exceptions(docs.select(F.col(text).alias("text")), key)
    few = redraw.limit(LITERAL_EXCEPTIONS + 1).collect()
    rows = given.withColumn("_e", entities(F.col(text)))
    id_of = lambda x: F.concat_ws("\x1f", x["kind"], canonical(x["e"], x["kind"]))
    if len(few) <= LITERAL_EXCEPTIONS:
        pairs = [F.lit(x) for r in few for x in (f"{r.kind}\x1f{r.canon}", r.attempt)]
        attempts = F.create_map(*pairs) if pairs else None
    else:
        hit = rows.withColumn("_d", F.when(F.size("_e") > 1, F.sha2(F.col(text), 256)))
        mine = hit.where("_d IS NOT NULL").select("_d", F.explode("_e").alias("x")).select("_d", id_of(F.col("x")).alias("id")).distinct()
        mine = mine.join(redraw.select(F.concat_ws("\x1f", "kind", "canon").alias("id"), "attempt"), "id")
        mine = mine.groupBy("_d").agg(F.map_from_entries(F.collect_set(F.struct(F.col("id").alias("key"), F.col("attempt").alias("value")))).alias("_a"))
        rows = hit.where("_d IS NOT NULL").join(mine, "_d", "left").unionByName(hit.where("_d IS NULL"), allowMissingColumns=True)
        attempts = F.col("_a")

    def made(x: Column) -> Column:
        attempt = F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, id_of(x)), F.lit(0))
        return F.when(x["kind"].isin("", KEPT), x["e"]).otherwise(surrogate(x["e"], x["kind"], attempt, key))

    new = F.transform("_e", lambda x: F.struct(x["kind"].alias("kind"), x["e"].alias("e"), x["gap"].alias("gap"), made(x).alias("made")))
    rows = rows.withColumn("_new", F.when(F.size("_e") > 1, new))
    rows = rows.withColumn("_m", F.when(F.exists("_new", lambda x: x["kind"].isin(*GIVEN_NAMES)), _lone(F.col("_new"))))
    alone = lambda gap: F.array_join(F.transform(F.split(gap, _BORDER, -1), lambda t: F.coalesce(F.try_element_at(F.col("_m"), t), t)), "")
    joined = F.array_join(F.transform("_new", lambda x: F.concat(x["made"], F.when(F.size("_m") > 0, alone(x["gap"])).otherwise(x["gap"]))), "")
    value = F.when(F.col("_new").isNotNull(), joined).otherwise(F.col(text))
    found = F.size(F.filter("_e", lambda x: ~x["kind"].isin("", KEPT))).cast("bigint")
    return unboxed(rows, names, text, **{text: value, "n_replaced": found})
