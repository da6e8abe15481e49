"""PII surrogates: keyed, type-consistent replacements, by DataFrame expressions only.

Detected are e-mail, IPv4 and IPv6 addresses, telephone, social-security, card and bank
numbers, access keys and long hexadecimal secrets, and names after a title. Each
entity is a type and a canonical form (case and, in numbers, punctuation dropped),
so all mentions of it, however written, get one surrogate: SHA-512 of the key,
type, canonical form and an attempt number gives a stream of characters that
replaces digits by digits and letters by letters of the same case, keeping all
else. Kept too: an e-mail's top-level domain, a telephone's country code or leading
zero, a card's first digit and whether its Luhn check passes; an IPv4 address stays a
valid one, and an IPv6 address becomes a unique local one. Given
names come from a list for the title's gender in the name's script (Latin or
Cyrillic), surnames from syllables of the script, with its gendered ending.

Collision checks: over the table of distinct entities, a surrogate that two
entities share, or that is a real entity of the type, is drawn again with the next
attempt, until none is. Later attempts draw from ever larger spaces (names get
more syllables, e-mails letters in front, and other types, whose spaces are large
from the start, digits at the end after ``EARLY`` attempts, or an IPv6 address for
an IPv4 one), so the rounds end however many entities a corpus has. Documents compute first attempts in place; only the few
entities with later attempts are joined back to the texts that mention them.

Defined results: a null or empty text stays as it is and has no entities;
repeated rows are treated alike, texts of any length whole; other columns, of any name, pass through untouched, except
``n_chars``, which follows a changed text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import kept

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TITLES = {"m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"]}
_TITLE = "|".join(sorted((t for x in TITLES.values() for t in x), key=len, reverse=True))
_PERSON = rf"(?<![\p{{L}}])(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}{{1,30}}+(?: \p{{Lu}}\p{{Ll}}{{1,30}}+)?"
_KEY_STARTS = "AKIA|ASIA|gh[pousr]_|sk-"
#: Groups of hexadecimal digits: all eight, or with one gap, which needs a first group of 3 or 4 as words of code have "::" too.
_IPV6 = r"(?<![A-Za-z0-9:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,36}[0-9])[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![A-Za-z0-9:])"
_ALONE, _ENDS = r"(?<![A-Za-z0-9+])(?<![0-9][ .,/-])", r"(?![A-Za-z0-9])(?![.,/-][0-9])"
#: Telephone numbers by form: +1 and the like in three groups, +33 in any groups, (415) 555-2671, 415-555-2671, and with a leading zero 030 1234567, 020 7946 0958, 06 12 34 56 78.
PHONES = [
    r"(?<![0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    r"(?<![0-9])\+[0-9]{1,3}(?: ?\(0\))?(?:[ .-]?[0-9]){7,12}(?![0-9])",
    r"(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    rf"{_ALONE}(?:1[ .-])?[2-9][0-9]{{2}}(?:-[0-9]{{3}}-|\.[0-9]{{3}}\.| [0-9]{{3}}[ -])[0-9]{{4}}{_ENDS}",
    rf"{_ALONE}0[1-9][0-9]{{1,3}}[ /-][0-9]{{5,8}}{_ENDS}",
    rf"{_ALONE}0[1-9][0-9]{{1,3}}(?: [0-9]{{3,4}} |-[0-9]{{3,4}}-)[0-9]{{3,4}}{_ENDS}",
    rf"{_ALONE}0[1-9](?:(?: [0-9]{{2}}){{4}}|(?:\.[0-9]{{2}}){{4}}|(?:-[0-9]{{2}}){{4}}){_ENDS}",
]
COUNTRY = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Java regular expressions by type, tried in this order where a mention starts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}+",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ip6": _IPV6,
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "phone": "|".join(PHONES),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}(?![0-9])",
    "person": _PERSON,
}
MENTION = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no mention; most texts need no more than this look.
HINT = f"[0-9@]|{_TITLE}|{_KEY_STARTS}|[a-f]{{32}}|[A-F]{{32}}|(?:[A-Fa-f]{{1,4}}:){{7}}"
GIVEN = {
    ("m", "latin"): "Adam Boris Carl David Edgar Felix Georg Hugo Ivan Jonas Karim Louis Martin Nils Oskar Pablo".split(),
    ("f", "latin"): "Anna Berta Clara Diana Elena Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Матвей Никита Олег Павел Роман Степан".split(),
    ("f", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Жанна Злата Ирина Кира Лидия Мария Нина Ольга Полина Раиса".split(),
}
SYLLABLES = {"latin": "ba ca da fe ga he ji ka lo mi no pe ra so tu ve".split(), "cyrillic": "ба ва га де жа зе ки ла мо ни по ре са ту фе хо".split()}
ENDINGS = {("m", "latin"): "r", ("f", "latin"): "r", ("m", "cyrillic"): "ров", ("f", "cyrillic"): "рова"}
ENTITY = "struct<type:string,canon:string>"
BROADCAST_ROWS = 20_000
#: Attempts after which numbers, keys and IPv4 addresses, of 10**7 surrogates at least, get longer.
EARLY = 15
#: Syllables of a name that the seed has room for, letters before an e-mail, and characters before its @.
MOST_SYLLABLES, MOST_LETTERS, LOCAL = 29, 32, 64


def _type(mention: Column) -> Column:
    out = F.lit("card")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _gender(mention: Column) -> Column:
    return F.when(mention.rlike(rf"^(?:{'|'.join(sorted(TITLES['f'], key=len, reverse=True))})\.? "), "f").otherwise("m")


def _entities(mention: Column, kind: Column) -> Column:
    """Array of (type, canon): one, or for a person one for each name."""
    names = F.split(F.regexp_extract(mention, rf"^(?:{_TITLE})\.? (.*)$", 1), " ")
    persons = F.transform(
        names,
        lambda name, i: F.struct(F.concat(F.when(i < F.size(names) - 1, "given_").otherwise("surname_"), _gender(mention), F.lit("_"), _script(name)).alias("type"), F.lower(name).alias("canon")),
    )
    plain = F.lower(F.when(kind.isin("email", "ip", "ip6"), mention).otherwise(F.regexp_replace(mention, "[^A-Za-z0-9]", "")))
    return F.when(kind == "person", persons).otherwise(F.array(F.struct(kind.alias("type"), plain.alias("canon"))))


def _seeded(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """(type, canon, attempt, seed)."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 512)
    return F.struct(kind.alias("type"), canon.alias("canon"), attempt.alias("attempt"), seed.alias("seed"))


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn check over a string of digits."""
    size = F.length(digits)

    def add(total, i):
        d = F.substring(digits, size - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and written once in the plan."""
    return F.transform(F.array(value), body)[0]


def _drawn(entity: Column) -> Column:
    """The surrogate's canonical form, of a seeded entity."""
    kind, canon, seed = entity["type"], entity["canon"], entity["seed"]
    digits, letters = F.translate(seed, "abcdef", "135790"), F.translate(seed, "0123456789abcdef", "abcdefghkmnprstv")
    keep = F.when(kind == "phone", F.when(canon.startswith("0"), 1).when(F.length(canon) > 10, F.length(F.regexp_extract(canon, COUNTRY, 0))).otherwise(0)).when(kind == "card", 1).when(kind == "iban", 2).when(kind == "key", 4).otherwise(0)
    ends = F.when(kind == "email", F.length(canon) - F.length(F.substring_index(canon, ".", -1))).otherwise(F.length(canon))

    def letter(i):
        old = F.substring(canon, i, F.lit(1))
        at = (i - 1) % 128 + 1
        hexes = F.substring(F.reverse(seed), at, F.lit(1))
        new = F.when(old.rlike("[0-9]"), F.when(kind == "hex", hexes).otherwise(F.substring(digits, at, F.lit(1)))).when(old.rlike("[a-z]"), F.when(kind == "hex", hexes).otherwise(F.substring(letters, at, F.lit(1)))).otherwise(old)
        lead = (kind == "phone") & ((i == keep + 1) | (i == keep + 4))
        new = F.when(lead & new.isin("0", "1"), F.lit("7")).otherwise(new)
        return F.when((i <= keep) | (i > ends), old).otherwise(new)

    attempt = entity["attempt"]

    def longer(spelled: Column) -> Column:
        extra = F.least(attempt, F.lit(MOST_LETTERS))
        over = F.greatest(F.instr(canon, "@") - 1 + extra - LOCAL, F.lit(0))
        mail = F.concat(F.substring(letters, F.lit(1), extra), F.substring(spelled, over + 1, F.length(spelled)))
        number = F.concat(spelled, F.substring(digits, F.lit(1), attempt - EARLY))
        return F.when(attempt == 0, spelled).when(kind == "email", mail).when(attempt > EARLY, number).otherwise(spelled)

    def checked(spelled: Column) -> Column:
        """A card number whose check passes stays one."""
        front = F.substring(spelled, F.lit(1), F.length(spelled) - 1)
        return F.when((kind == "card") & (_luhn(canon) == 0), F.concat(front, ((10 - _luhn(F.concat(front, F.lit("0")))) % 10).cast("string"))).otherwise(spelled)

    plain = F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon)), letter), "")
    plain = _let(_let(plain, longer), checked)

    def number(at, most):
        return F.conv(F.substring(seed, at, 4), 16, 10).cast("int") % most

    address = F.concat_ws(".", (number(1, 222) + 1).cast("string"), *((number(a, 256)).cast("string") for a in (5, 9, 13)))
    wide = F.concat_ws(":", F.concat(F.lit("fd"), F.substring(seed, 17, 2)), *(F.substring(seed, a, 4) for a in range(19, 47, 4)))

    # names: one list of syllables and of given names, chosen by type
    syllables = F.when(kind.endswith("latin"), F.array(*map(F.lit, SYLLABLES["latin"]))).otherwise(F.array(*map(F.lit, SYLLABLES["cyrillic"])))
    places = F.sequence(F.lit(9), F.least(attempt + 3, F.lit(MOST_SYLLABLES - 1)) * 4 + 9, F.lit(4))
    drawn = _let(syllables, lambda from_: F.array_join(F.transform(places, lambda at: from_[F.conv(F.substring(seed, at, F.lit(4)), 16, 10).cast("int") % 16]), ""))
    given, ending = F.array().cast("array<string>"), F.lit("")
    for (sex, script), names in GIVEN.items():
        given = F.when(kind == f"given_{sex}_{script}", F.array(*map(F.lit, names))).otherwise(given)
        ending = F.when(kind == f"surname_{sex}_{script}", F.lit(ENDINGS[sex, script])).otherwise(ending)

    def name(more: Column) -> Column:
        # a first name is drawn from the list, with syllables where attempts show the list to be too short
        first = F.lower(F.concat(given[number(5, 16)], F.when(attempt > 2, more).otherwise("")))
        return F.when(kind.startswith("given_"), first).otherwise(F.concat(more, ending))

    out = F.when(kind.startswith("given_") | kind.startswith("surname_"), _let(drawn, name)).when(kind == "ip6", wide)
    return out.when(kind == "ip", F.when(attempt > EARLY, wide).otherwise(address)).otherwise(plain)


def _written(mention: Column, kind: Column, drawn: Column) -> Column:
    """The surrogate in the mention's own writing: its punctuation and case; what it is longer by comes first in e-mails, else last."""
    new = drawn[0]
    ahead = F.when(kind == "email", F.greatest(F.length(new) - F.length(mention), F.lit(0))).otherwise(0)

    def place(state, i):
        old = F.substring(mention, i, F.lit(1))
        is_open = old.rlike("[A-Za-z0-9]") | (kind == "email")
        got = F.substring(new, state["k"], F.lit(1))
        got = F.when(old.rlike("[A-Z]"), F.upper(got)).otherwise(got)
        return F.struct(F.concat(state["text"], F.when(is_open, got).otherwise(old)).alias("text"), (state["k"] + is_open.cast("int")).alias("k"))

    spelled = F.aggregate(F.sequence(F.lit(1), F.length(mention)), F.struct(F.substring(new, F.lit(1), ahead).alias("text"), (ahead + 1).alias("k")), place)
    spelled = F.concat(spelled["text"], F.substring(new, spelled["k"], F.length(new)))
    names = F.concat_ws(" ", F.regexp_extract(mention, rf"^((?:{_TITLE})\.?) ", 1), F.array_join(F.transform(drawn, F.initcap), " "))
    return F.when(kind.isin("ip", "ip6"), new).when(kind == "person", names).otherwise(spelled)


def _mentions(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))).otherwise(none)


def later_attempts(docs: DataFrame, key: str) -> DataFrame | None:
    """(type, canon, attempt) of the entities whose first surrogates collide; None if none does."""
    found = docs.select(F.explode(_mentions(F.col("text"))).alias("mention")).distinct().withColumn("kind", _type(F.col("mention")))
    entity = found.select(F.explode(_entities(F.col("mention"), F.col("kind"))).alias("e")).select("e.type", "e.canon").distinct()
    # a small table, but its surrogates are dear: files enough for all tasks
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = kept(entity.withColumn("attempt", F.lit(0)).repartition(parts, "type", "canon"))
    real = state.select("type", F.col("canon").alias("drawn"), F.lit(True).alias("real"))
    while True:
        # drawn in a plan of its own, which is planned once
        each = kept(state.withColumn("e", _seeded(key, F.col("type"), F.col("canon"), F.col("attempt"))).withColumn("drawn", _drawn(F.col("e"))).drop("e"))
        turn = F.row_number().over(W.partitionBy("type", "drawn").orderBy("attempt", "canon"))
        each = each.withColumn("turn", turn).join(real, ["type", "drawn"], "left")
        again = F.coalesce(F.col("real"), F.lit(False)) | (F.col("turn") > 1)
        state = kept(each.select("type", "canon", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")).repartition(parts, "type", "canon"))
        if state.filter("again").isEmpty():
            late = state.filter("attempt > 0").select("type", "canon", "attempt")
            return None if late.isEmpty() else late
        state = state.drop("again")


def replace(docs: DataFrame, key: str = "surrogate-key", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_entities`` and ``changed`` added."""
    lead = "_"
    while any(c.lower().startswith(lead) for c in docs.columns):  # no caller's column has a name in use here
        lead += "_"
    mentions, late_, of_text, attempts_, steps, written = (lead + c for c in ("mentions", "late", "of_text", "attempts", "steps", "written"))
    late = later_attempts(docs, key)
    named = docs.withColumn(mentions, _mentions(F.col("text")))
    attempts = F.create_map().cast("map<string,int>")
    if late is not None:
        texts = docs.filter(F.col("text").rlike(HINT)).select(F.sha2("text", 256).alias(of_text), F.explode(_mentions(F.col("text"))).alias("m")).distinct()
        texts = texts.withColumn("kind", _type(F.col("m"))).select(of_text, F.explode(_entities(F.col("m"), F.col("kind"))).alias("e")).select(of_text, "e.type", "e.canon").distinct()
        own = kept(texts.join(late, ["type", "canon"]).groupBy(of_text).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "type", "canon"), "attempt"))).alias(late_)))
        # a choice of joins only
        if own.limit(broadcast_rows + 1).count() <= broadcast_rows:
            own = F.broadcast(own)
        named = named.withColumn(of_text, F.sha2("text", 256)).join(own, of_text, "left").drop(of_text)
        attempts = F.coalesce(F.col(late_), attempts)

    # one column a step, so that nothing is evaluated twice
    named = named.withColumn(attempts_, attempts)
    named = named.withColumn(steps, F.transform(mentions, lambda m: F.struct(m.alias("m"), _type(m).alias("kind"))))
    named = named.withColumn(steps, F.transform(steps, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), _entities(x["m"], x["kind"]).alias("e"))))

    def seeded(e):
        return _seeded(key, e["type"], e["canon"], F.coalesce(F.element_at(attempts_, F.concat_ws("|", e["type"], e["canon"])), F.lit(0)))

    named = named.withColumn(steps, F.transform(steps, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), F.transform(x["e"], seeded).alias("e"))))
    named = named.withColumn(steps, F.transform(steps, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), F.transform(x["e"], _drawn).alias("d"))))
    named = named.withColumn(written, F.transform(steps, lambda x: _written(x["m"], x["kind"], x["d"])))
    between = F.split("text", MENTION, -1)
    filled = F.zip_with(between, F.col(written), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = F.size(mentions) > 0
    text = F.when(changed, F.array_join(filled, "")).otherwise(F.col("text"))
    out = named.withColumn("n_entities", F.coalesce(F.size(mentions), F.lit(0)).cast("long")).withColumn("changed", F.coalesce(changed, F.lit(False)))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_entities", "changed")], "n_entities", "changed")
