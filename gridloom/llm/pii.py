"""Surrogates for personal data, in DataFrame functions only.

Detected entities: e-mail addresses, telephone numbers, payment card numbers (Luhn-valid only), IPv4 and IPv6 addresses,
account numbers (IBAN of a valid check sum), US social security numbers, secrets (long hexadecimal strings and keys of
known marks), and names: behind a title, or a listed given name with a family name behind it.

Each distinct entity of the corpus gets one surrogate, a keyed hash of its type, value and a try number rendered in its
type and format: letters keep case and script (Latin, Greek, Cyrillic), digits stay digits, marks stay; cards and accounts
stay valid; addresses go to domains and networks reserved for examples, as far as these reach. A name's parts are entities
of their own: the title stays, a given name is replaced by one of its gender and script, a family name by one of its
script. So "Mr. John Smith" and "Mr. Smith" keep a family name in common.

Distinctness is checked over the corpus: surrogates that meet, or that equal an entity of the corpus, are made again with
the next try number until none is left, the least value first, so distinct entities stay distinct; equal entities have
equal surrogates in every document. Later tries draw from wider spaces of the same format (longer names, all networks).
After MOST_TRIES the run fails rather than break a format. Texts are rewritten by splitting at the entities and joining
with the surrogates.

Each text is searched once; patterns begin where runs begin and take runs whole, so the time grows with the length. Only
texts with an entity are shuffled, keyed by digest, so copies share the work.

Defined cases: null texts stay null, empty texts empty, with no entity. Repeated rows are rewritten alike. Very long
texts are rewritten whole. An empty table gives an empty result. Other columns pass through `rewrite` unchanged, whatever
their names, but for `_entities`, which it writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fresh, partitions, save, spread_join

KEY = "gridloom"
#: Tries after which an entity without a free surrogate is an error.
MOST_TRIES = 64

#: Titles by the gender they tell.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"), "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"), "n": ("Dr", "Prof")}
#: Given names by script and gender, to find names without a title and to make surrogates from.
GIVEN = {
    ("latin", "f"): ("Ada", "Alma", "Ana", "Anna", "Clara", "Edith", "Elena", "Emma", "Flora", "Greta", "Ida", "Irene", "Jane", "Julia", "Laura", "Lena", "Lucy", "Maria", "Marie", "Mary", "Nora", "Sarah", "Sofia", "Vera"),
    ("latin", "m"): ("Adam", "Anton", "Bruno", "Carlos", "David", "Emil", "Felix", "Hans", "Hugo", "Ivan", "James", "Jean", "John", "Jonas", "Juan", "Karl", "Leo", "Martin", "Michael", "Oscar", "Paul", "Peter", "Pierre", "Robert", "Simon", "Thomas", "Victor", "William"),
    ("latin", "n"): ("Alex", "Ariel", "Charlie", "Dana", "Eden", "Jamie", "Kai", "Kim", "Luca", "Mika", "Noa", "Quinn", "Robin", "Sasha", "Toni", "Yuri"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Иван", "Лев", "Михаил", "Олег", "Павел"),
    ("cyrillic", "n"): ("Женя", "Паша", "Саша", "Слава", "Тоша", "Шура", "Валя", "Вася"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ειρήνη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"),
    ("greek", "m"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Παύλος", "Πέτρος", "Σπύρος"),
    ("greek", "n"): ("Άρι", "Βίκη", "Κρις", "Λάκη", "Μάκη", "Νίκη", "Ρένι", "Τάκη"),
}
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "hal", "ker", "lin", "mor", "nes", "pat", "rin", "sol", "tam", "ver", "wen", "zel"),
    "cyrillic": ("ба", "де", "фи", "го", "хал", "кер", "лин", "мор", "нес", "пат", "рин", "сол", "там", "вер", "вен", "зел"),
    "greek": ("βα", "δε", "φι", "γο", "χαλ", "κερ", "λιν", "μορ", "νεσ", "πατ", "ριν", "σολ", "ταμ", "βερ", "θεν", "ζελ"),
}
GENDERS = ("f", "m", "n")

_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + ")"
_GIVEN = "(?:" + "|".join(n for ns in GIVEN.values() for n in ns) + ")"
_LOCAL, _WORD, _HEX = r"[\p{L}\p{N}._%+-]", r"\p{Lu}[\p{Ll}'-]++", "[0-9A-Fa-f]{1,4}"
EMAIL = rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{{2,}}"
PHONE = r"(?<![\w+])\+\d{1,3}[ -]?(?:\(\d{2,4}\)|\d{2,4})[ -]\d{3,4}[ -]\d{3,4}(?!\d)|(?<!\w)\(\d{3}\) \d{3}-\d{4}(?!\d)|(?<![\w.+-])\d{3}-\d{3}-\d{4}(?![\d-])"
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"
#: Digits in groups, 13 or more, of which some groups may be a card; see pieces.
RUN = r"(?<![\w.+-])(?=\d(?:[ -]?\d){12})\d[\d -]*\d(?![\w-]|\.\d{1,3}\.\d)"
IPV4 = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
IPV6 = rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::(?:{_HEX}:){{0,6}}{_HEX})(?![\w:]|\.\w)"
SSN = r"(?<![\w.+-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])"
#: Marks that keys of known services begin with.
KEY_MARK = r"(?:A[KS]IA(?=[A-Z0-9]{16}(?![A-Za-z0-9]))|sk-(?=[A-Za-z0-9_-]{20})|gh[opsur]_(?=[A-Za-z0-9]{36})|xox[abprs]-(?=[A-Za-z0-9-]{10}))"
SERVICE_KEY = rf"(?<![A-Za-z0-9]){KEY_MARK}[A-Za-z0-9_-]++"
TITLED = rf"(?<!\p{{L}})(?=\p{{Lu}}){_TITLE}\.? {_WORD}(?: {_WORD})?"
UNTITLED = rf"(?<!\p{{L}})(?=\p{{Lu}}){_GIVEN} (?:\p{{Lu}}\. )?{_WORD}"
NAME = f"{TITLED}|{UNTITLED}"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, NAME, IBAN, SERVICE_KEY, PHONE, SSN, SECRET, IPV6, RUN, IPV4))
#: A text without one of these has no entity; it is cheap to look for.
HINT = rf"[0-9@]|::|{KEY_MARK}|(?<!\p{{L}})(?=\p{{Lu}})(?:{_TITLE}|{_GIVEN})[. ]"

_ENTITY = "struct<value:string,kind:string,parts:array<struct<value:string,kind:string>>>"


def _full(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def _digits(value: Column) -> Column:
    return F.split(F.regexp_replace(value, "[^0-9]", ""), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of an array of digits, doubling every second from the last but one."""

    def total(ds: Column) -> Column:
        double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        step = lambda n: F.transform(ds, lambda d, i: F.when((n - i) % 2 == 1, d.cast("int")).otherwise(double(d.cast("int"))))
        return F.aggregate(_let(F.size(ds), step), F.lit(0), lambda s, x: s + x)

    return _let(digits, total)


def _is_card(value: Column) -> Column:
    return _full(value, CARD) & _let(_digits(value), lambda ds: (luhn_sum(ds) % 10 == 0) & (F.size(F.array_distinct(ds)) > 1))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _run_pieces(match: Column) -> Column:
    """A run of digit groups around its cards and telephone numbers: at each group the longest that is one."""

    def split(tokens: Column) -> Column:
        # places count from 1: odd ones are groups, even ones marks; a card stands between blanks or ends of the run
        n = F.size(tokens)
        joined = lambda i, j: F.array_join(F.slice(tokens, i, j - i + 1), "")
        open_ = lambda i: (i < 1) | (i > n) | F.coalesce(F.try_element_at(tokens, F.when(i >= 1, i).otherwise(1)).contains(" "), F.lit(False))
        good = lambda i: F.filter(F.sequence(i, F.least(i + 36, n), F.lit(2)), lambda j: open_(j + 1) & _let(joined(i, j), lambda v: _is_card(v) | _full(v, PHONE)))
        last = lambda i: F.when(open_(i - 1), F.array_max(good(i)))
        cut = "array<struct<a:int,b:int>>"
        start = F.struct(F.lit(1).alias("next"), F.array().cast(cut).alias("cuts"))

        def step(state: Column, i: Column) -> Column:
            # the state grows only where a card or telephone number is found
            taken = lambda e: F.when(e.isNull(), state).otherwise(F.struct((e + 1).alias("next"), F.concat(state["cuts"], F.array(F.struct(i.alias("a"), e.alias("b")))).alias("cuts")))
            return F.when(i < state["next"], state).otherwise(_let(last(i), taken))

        cuts = F.aggregate(F.sequence(F.lit(1), n, F.lit(2)), start, step, lambda s: s["cuts"])

        def put(cuts: Column) -> Column:
            m = F.size(cuts)
            begin = lambda k: F.when(k == 1, 1).otherwise(F.element_at(cuts, F.when(k > 1, k - 1).otherwise(1))["b"] + 1)
            between = lambda k: joined(begin(k), F.when(k > m, n).otherwise(F.element_at(cuts, F.least(k, m))["a"] - 1))
            whole = lambda k: F.when(k <= m, joined(F.element_at(cuts, F.least(k, m))["a"], F.element_at(cuts, F.least(k, m))["b"])).otherwise("")
            return F.when(m == 0, F.array(match)).otherwise(F.filter(F.flatten(F.transform(F.sequence(F.lit(1), m + 1), lambda k: F.array(between(k), whole(k)))), lambda v: v != ""))

        return _let(cuts, put)

    return _let(F.regexp_extract_all(match, F.lit(r"(\d+|[ -]+)"), 1), split)


def _iban_pieces(match: Column) -> Column:
    """An account number, and capitals behind it that the pattern took along."""
    shorter = lambda v: F.regexp_replace(v, " [A-Z0-9]{1,4}$", "")
    tries = _let(match, lambda a: _let(shorter(a), lambda b: F.array(a, b, shorter(b))))
    best = _let(tries, lambda ts: F.coalesce(F.try_element_at(F.filter(ts, _is_iban), F.lit(1)), match))
    return _let(best, lambda b: F.filter(F.array(b, F.substr(match, F.length(b) + 1)), lambda v: v != ""))


def pieces(match: Column) -> Column:
    """A match in pieces, of which one or more may be entities: dots before an address, groups of a run, others whole."""
    dots = F.regexp_extract(match, r"^\.+", 0)
    return (
        F.when(match.startswith(".") & match.contains("@"), F.array(dots, F.substr(match, F.length(dots) + 1)))
        .when(_full(match, IBAN), _iban_pieces(match))
        .when(_full(match, RUN) & ~_full(match, PHONE) & ~_full(match, SECRET) & ~_is_card(match), _run_pieces(match))
        .otherwise(F.array(match))
    )


def _rearranged(value: Column) -> Column:
    """An account number as digits, the country and check digits behind the rest, letters as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    return F.array_join(F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")


def _mod97(digits: Column) -> Column:
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda s, c: (s * 10 + F.coalesce(c.cast("int"), F.lit(0))) % 97)


def _is_iban(value: Column) -> Column:
    return _full(value, IBAN) & (_mod97(_rearranged(value)) == 1)


def kind_of(value: Column) -> Column:
    """The entity type of a piece of a match; null for what only looks like one."""
    octets = F.split(value, r"\.")
    return (
        F.when(_full(value, EMAIL) & ~value.startswith("."), "email")
        .when(_full(value, NAME), "name")
        .when(_is_iban(value), "iban")
        .when(_full(value, SERVICE_KEY), "secret")
        .when(_full(value, PHONE), "phone")
        .when(_full(value, SSN), "ssn")
        .when(_full(value, IPV4), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
        .when(_full(value, IPV6) & value.rlike("[0-9]"), "ip6")
        .when(_is_card(value), "card")
        .when(_full(value, SECRET) & value.rlike("[0-9]") & value.rlike("[a-fA-F]"), "secret")
    )


def _parts(value: Column, kind: Column) -> Column:
    """What is replaced of an entity, each part with its own type: names as title, given names and family name."""
    part = lambda v, k: F.struct(v.alias("value"), (F.lit(k) if k is None or isinstance(k, str) else k).cast("string").alias("kind"))

    def name(title: Column) -> Column:
        words = F.split(F.substr(value, F.length(title) + 1), " ")
        plain = F.regexp_replace(title, r"\.? $", "")
        by_title = F.when(plain.isin(*TITLES["f"]), "f").when(plain.isin(*TITLES["m"]), "m").otherwise("n")

        def gender(word: Column) -> Column:
            out = by_title
            for g in GENDERS:
                out = F.when(word.isin(*(n for (_, h), ns in GIVEN.items() if h == g for n in ns)), g).otherwise(out)
            return out

        given = lambda w: F.array(part(w, F.when(~w.endswith("."), F.concat(F.lit("given_"), gender(w)))), part(F.lit(" "), None))
        before = F.flatten(F.transform(F.slice(words, F.lit(1), F.size(words) - 1), given))
        return F.concat(F.array(part(title, None)), before, F.array(part(F.element_at(words, -1), "family")))

    return F.when(kind == "name", _let(F.regexp_extract(value, rf"^({_TITLE}\.? )", 1), name)).otherwise(F.array(part(value, kind)))


def entities_of(text: Column) -> Column:
    """For each match of ANY its pieces, as (value, kind, parts); the kind of what is no entity is null."""
    entity = lambda v: _let(kind_of(v), lambda k: F.struct(v.alias("value"), k.alias("kind"), _parts(v, k).alias("parts")))
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({ANY})"), 1), lambda m: F.transform(pieces(m), entity))
    return F.coalesce(F.when(text.rlike(HINT), found), F.array()).cast(f"array<array<{_ENTITY}>>")


def _stream(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 512)


def _number(stream: Column, place: Column | int, width: int = 4) -> Column:
    """A number from `width` hexadecimal digits of the stream, at a place that wraps."""
    at = place if isinstance(place, Column) else F.lit(place)
    return F.conv(F.substr(stream, (at * width % (128 - width) + 1).cast("int"), F.lit(width)), 16, 10).cast("long")


def _like(char: Column, number: Column) -> Column:
    """A letter or digit of the same kind and script; other characters stay."""
    pick = lambda first, n: F.char(F.lit(first) + F.pmod(number, F.lit(n)))
    of = lambda alphabet: F.substr(F.lit(alphabet), (F.pmod(number, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    return (
        F.when(char.rlike("[0-9]"), pick(48, 10))
        .when(char.rlike(r"[\p{IsLatin}&&\p{Lu}]"), pick(65, 26))
        .when(char.rlike(r"\p{IsLatin}"), pick(97, 26))
        .when(char.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), of("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
        .when(char.rlike(r"\p{IsCyrillic}"), of("абвгдежзиклмнопрстуфхцчшэюя"))
        .when(char.rlike(r"[\p{IsGreek}&&\p{Lu}]"), of("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"))
        .when(char.rlike(r"\p{IsGreek}"), of("αβγδεζηθικλμνξοπρστυφχψω"))
        .otherwise(char)
    )


def _formatted(value: Column, stream: Column) -> Column:
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: _like(c, _number(stream, i))), "")


def _email(value: Column, stream: Column) -> Column:
    local = F.element_at(F.split(value, "@"), 1)
    return F.concat(_formatted(local, stream), F.lit("@m"), F.substr(stream, F.lit(101), F.lit(10)), F.lit(".example.org"))


def _phone(value: Column, stream: Column) -> Column:
    # a country code stays
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=[ -(])", 0)
    return F.concat(code, _formatted(F.substr(value, F.length(code) + 1, F.length(value)), stream))


def _card(value: Column, stream: Column) -> Column:
    """The first digit and the marks stay; the last digit makes the number valid."""
    raw = F.transform(F.split(value, ""), lambda c, i: F.when((i == 0) | ~c.rlike("[0-9]"), c).otherwise((_number(stream, i) % 10).cast("string")))
    n = F.length(value)
    body = F.array_join(F.slice(raw, F.lit(1), n - 1), "")
    lack = (10 - luhn_sum(_digits(F.concat(body, F.lit("0")))) % 10) % 10
    return F.concat(body, lack.cast("string"))


def _pick(stream: Column, values: tuple[str, ...], place: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_number(stream, place) % len(values) + 1).cast("int"))


def _ip(value: Column, stream: Column, attempt: Column) -> Column:
    """An address of the network kept for future use, which no host has; of the other reserved ones; at last of any."""
    part = lambda i: (_number(stream, i) % 256).cast("string")
    first = F.when(attempt < 4, (240 + _number(stream, 0) % 15).cast("string")).when(attempt < 16, _pick(stream, ("0", "10", "127", "255"), 0)).otherwise(part(0))
    return F.concat_ws(".", first, part(1), part(2), part(3))


def _ip6(value: Column, stream: Column) -> Column:
    """An address of the network for documentation, short or in full like the value."""
    four = lambda i: F.lower(F.hex(4096 + _number(stream, i) % 61440))
    return F.when(value.contains("::"), F.concat(F.lit("2001:db8::"), F.concat_ws(":", *map(four, range(4))))).otherwise(F.concat(F.lit("2001:db8:"), F.concat_ws(":", *map(four, range(6)))))


def _ssn(value: Column, stream: Column, attempt: Column) -> Column:
    """A number of an area that is not given out; of any at last."""
    made = _formatted(value, stream)
    return F.when(attempt < 8, F.concat(F.lit("9"), F.substr(made, F.lit(2)))).when(attempt < 16, F.concat(_pick(stream, ("000", "666"), 30), F.substr(made, F.lit(4)))).otherwise(made)


def _iban(value: Column, stream: Column) -> Column:
    """The country and the grouping stay; the check digits make the number valid."""
    made = F.concat(F.substr(value, F.lit(1), F.lit(2)), F.lit("00"), _formatted(F.substr(value, F.lit(5)), stream))
    check = F.lpad((98 - _mod97(_rearranged(made))).cast("string"), 2, "0")
    return F.concat(F.substr(made, F.lit(1), F.lit(2)), check, F.substr(made, F.lit(5)))


def _secret(value: Column, stream: Column, again: Column) -> Column:
    """Hexadecimal digits of the value's case; a service's mark stays, with signs like the value's behind it."""
    n = F.length(value)
    rest = F.when(n > 256, F.array_join(F.transform(F.sequence(F.lit(3), F.greatest(F.ceil(n / 128).cast("int"), F.lit(3))), lambda i: F.sha2(F.concat_ws("|", stream, i.cast("string")), 512)), "")).otherwise("")
    made = F.substr(F.concat(stream, again, rest), F.lit(1), n)
    mark = F.regexp_extract(value, f"^({KEY_MARK})", 1)
    return F.when(mark != "", F.concat(mark, _formatted(F.substr(value, F.length(mark) + 1), stream))).when(value.rlike("[a-f]"), made).otherwise(F.upper(made))


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _syllables(script: Column, stream: Column, many: Column) -> Column:
    lists = F.array(*map(F.lit, SYLLABLES["latin"]))
    for s in ("cyrillic", "greek"):
        lists = F.when(script == s, F.array(*map(F.lit, SYLLABLES[s]))).otherwise(lists)
    return F.when(many > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.element_at(lists, (_number(stream, i) % 16 + 1).cast("int"))), "")).otherwise("")


def _given(kind: Column, value: Column, stream: Column, attempt: Column) -> Column:
    """A listed name of the gender and script; from the second try on with syllables behind it."""
    script, out = _script(value), F.lit("")
    for (s, g), names in GIVEN.items():
        out = F.when((script == s) & (kind == f"given_{g}"), _pick(stream, names, 0)).otherwise(out)
    return F.concat(out, _syllables(script, stream, attempt))


def _family(value: Column, stream: Column, attempt: Column) -> Column:
    return F.initcap(_syllables(_script(value), stream, 5 + attempt))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement for a value at a try."""
    again = _stream(kind, value, F.concat(attempt.cast("string"), F.lit("+")), key)
    made = lambda stream: (
        F.when(kind == "email", _email(value, stream)).when(kind == "phone", _phone(value, stream)).when(kind == "card", _card(value, stream))
        .when(kind == "ip", _ip(value, stream, attempt)).when(kind == "ip6", _ip6(value, stream)).when(kind == "ssn", _ssn(value, stream, attempt)).when(kind == "iban", _iban(value, stream))
        .when(kind == "secret", _secret(value, stream, again)).when(kind == "family", _family(value, stream, attempt)).when(kind.startswith("given_"), _given(kind, value, stream, attempt))
    )
    return F.when(attempt < MOST_TRIES, _let(_stream(kind, value, attempt, key), made)).otherwise(F.raise_error(F.concat(F.lit("no free surrogate of type "), kind)))


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """From distinct (value, kind): (value, kind, surrogate), distinct and none of them a value."""
    spark = entities.sparkSession
    real = entities.select(F.col("value").alias("surrogate")).distinct().withColumn("_real", F.lit(True))
    todo = entities.select("value", "kind", F.lit(0).alias("attempt"))
    made: DataFrame | None = None
    while True:
        now = todo.repartition(partitions(spark), "value").withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
        now = now.join(real, "surrogate", "left")
        if made is not None:
            now = now.join(made.select("surrogate", F.lit(True).alias("_taken")), "surrogate", "left")
        else:
            now = now.withColumn("_taken", F.lit(None).cast("boolean"))
        # the least value of those that meet keeps the surrogate
        me = F.struct("value", "kind")
        least = now.where("_real IS NULL AND _taken IS NULL").groupBy("surrogate").agg(F.min(me).alias("_first"))
        now = now.join(least, "surrogate", "left").withColumn("_good", F.coalesce(F.col("_first") == me, F.lit(False)))
        now = save(now.select("value", "kind", "surrogate", "attempt", "_good"), "surrogates")
        good = now.where("_good").select("value", "kind", "surrogate")
        made = good if made is None else save(made.unionByName(good), "surrogates")
        rest = now.where("NOT _good")
        if rest.isEmpty():
            return made
        todo = rest.select("value", "kind", (F.col("attempt") + 1).alias("attempt"))


def rewrite(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """docs with the text rewritten and `_entities`, an array of (value, kind, surrogate), one for each match in order."""
    text = F.col(text_col)
    found, key_, map_ = (fresh(docs, n) for n in ("_found", "_key", "_map"))
    # texts are searched once; what was found is written beside them
    marked = save(docs.withColumn(found, entities_of(text)), "marked")
    whole = F.flatten(F.col(found))
    parts = F.array_distinct(F.filter(F.flatten(F.transform(whole, lambda e: e["parts"])), lambda p: p["kind"].isNotNull()))
    hits = marked.where(F.exists(whole, lambda e: e["kind"].isNotNull())).withColumn(key_, F.sha2(text, 256))
    pairs = save(hits.select(F.col(key_).alias("key"), F.explode(parts).alias("p")).select("key", "p.value", "p.kind").distinct(), "entities")
    table = surrogates(save(pairs.select("value", "kind").distinct(), "distinct_entities"), key)
    named = spread_join(pairs, table, ["value", "kind"])
    maps = named.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("value", "kind"), "surrogate"))).alias(map_)).withColumnRenamed("key", key_)
    counts = hits.groupBy(key_).agg(F.count("*").alias("n"))
    with_map = spread_join(hits, maps, key_, counts=counts)
    put = lambda p: F.coalesce(F.try_element_at(F.col(map_), F.struct(p["value"], p["kind"])), p["value"])
    made = lambda e: F.array_join(F.transform(e["parts"], put), "")
    body = F.zip_with(F.split(text, ANY, -1), F.col(found), lambda s, es: F.concat(s, F.coalesce(F.array_join(F.transform(es, made), ""), F.lit(""))))
    entities = F.transform(F.filter(whole, lambda e: e["kind"].isNotNull()), lambda e: F.struct(e["value"].alias("value"), e["kind"].alias("kind"), made(e).alias("surrogate")))
    changed = with_map.withColumn("_entities", entities).withColumn(text_col, F.array_join(body, "")).drop(map_, found, key_)
    none = F.array().cast("array<struct<value:string,kind:string,surrogate:string>>")
    plain = marked.where(~F.exists(whole, lambda e: e["kind"].isNotNull())).drop(found).withColumn("_entities", none)
    return changed.select(plain.columns).unionByName(plain)


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """One row a document: doc_id, n_entities, the count of each type, and the rewritten text."""
    done = rewrite(docs.select("doc_id", "text"), key)
    count = lambda name, *kinds: F.size(F.filter("_entities", lambda e: e["kind"].isin(*kinds))).cast("long").alias(f"n_{name}")
    return done.select("doc_id", F.size("_entities").cast("long").alias("n_entities"), count("ip", "ip", "ip6"), *(count(k, k) for k in ("email", "phone", "card", "secret", "name", "iban", "ssn")), "text")
