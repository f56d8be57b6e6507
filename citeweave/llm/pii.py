"""Surrogates for personal data and secrets.

Entities are found by patterns: e-mail addresses, IPv4 addresses, card numbers (with a right Luhn sum), social security
numbers, IBANs, phone numbers, names after a title (and the same first and last name without one, anywhere in that text),
and secrets (access keys, values after password, token and the like). Each is replaced by a surrogate of its own type and
format, which a keyed permutation of that format's strings gives:

* digits become digits, letters letters of the same case, punctuation stays; a lower or upper case hexadecimal string stays one;
* a phone number keeps its country code, and whether the next digit is below 2; an IPv4 address its octets' widths; a card
  number its first digit and a right Luhn sum; an IBAN its country, its check digits are right where they were;
* an e-mail address keeps its shape and last domain label, and addresses of one domain stay of one domain;
* a name keeps its title, script (Latin or Cyrillic) and shape: vowels become vowels, consonants consonants, accented
  letters stay. A first name that FIRST lists becomes another of the same gender and script; last names don't depend on
  first names or titles, nor first names on last names or titles.

The permutation works on an entity's canonical form (letters' case in addresses and names, titles, grouping of digits and
so on don't matter), so equal entities get equal surrogates in all documents: coreference. It is a Feistel network over
the characters, each a number below the size of its class; with E the network, T one step up at the first free character,
the surrogate of x is E^-1(T(E(x))). That is a permutation of the strings of x's form without fixed points, so different
entities get different surrogates, whatever their number, and none stays as it was; no draw is ever repeated. A surrogate
may be the text of some other entity, which is replaced itself. Only first names that FIRST doesn't list and whose
permutation gives a listed one step further, at most WALK times; ``replaced`` checks over the whole table that no two
entities share a surrogate, in counts of distinct entities combined before the shuffle.

DataFrame functions only, one pass over the texts, no join.

Edge cases: a null text stays null, an empty one empty; texts are read whole; equal rows get equal texts; ids may be
null or repeat; a text without entities is unchanged; other columns pass through unless ``only`` asks for id and text
alone; helper columns have names of their own (_pii_...).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import written

KEY, KEY_SETTING = "citeweave-demo-key", "citeweave.pii.key"
ROUNDS, WALK = 4, 4
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Titles by gender, and names that surrogates are made of.
TITLES = {"m": "Mr Sir Herr Monsieur Señor Don господин г-н".split(), "f": "Mrs Ms Miss Madam Frau Madame Señora Doña госпожа г-жа".split(), "n": "Dr Prof".split()}
FIRST = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix George Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul Ralph Simon Tom Victor".split(),
    ("f", "latin"): "Anna Bella Clara Dora Emma Flora Greta Helen Irene Julia Karen Laura Maria Nora Olga Paula Rosa Sara Tina Vera".split(),
    ("n", "latin"): "Alex Casey Dana Eden Jamie Kim Lee Morgan Noa Robin Sam Sasha Toni Val".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Сергей Тимур".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Софья Тамара".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава".split(),
}
#: Vowels and consonants by script, and the country calling codes of one and two digits.
NAME_CLASSES = ("aeiouy", "bcdfghjklmnpqrstvwxz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ")
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
SECRET_CLASSES = (DIGITS, LOWER[:6], LOWER[6:], UPPER[:6], UPPER[6:])

_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?"
_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
#: What names a secret; it is found with the secret and stays.
_NAMED = r"(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?"
#: Patterns in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": _NAMED + r"[A-Za-z0-9+/_.\-]{6,}(?<![.])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "person": rf"(?<![\p{{L}}]){_TITLE} {_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_TITLES = tuple(t for ts in TITLES.values() for t in ts)


def let(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """``body`` of ``value``, which is in the plan once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _compact(entity) -> F.Column:
    return F.regexp_replace(entity, "[^0-9A-Za-z]", "")


def _luhn(digits) -> F.Column:
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.pmod(F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10))


def _numbers(text) -> F.Column:
    return F.transform(F.split(text, ""), lambda c: c.cast("int"))


def kind_of(entity) -> F.Column:
    """The type of a found entity; ``number`` is no entity: it looks like a card's, but its sum is wrong."""
    out = F.when(entity.rlike(f"^(?:{PATTERNS['email']})$"), "email").when(entity.rlike(f"^(?:{PATTERNS['key']})$"), "key")
    for name in ("iban", "ip", "ssn"):
        out = out.when(entity.rlike(f"^(?:{PATTERNS[name]})$"), name)
    card = F.when(_luhn(_numbers(_compact(entity))) == 0, "card").otherwise("number")
    out = out.when(entity.rlike(f"^(?:{PATTERNS['card']})$"), card)
    return out.when(entity.rlike(f"^(?:{PATTERNS['phone']})$"), "phone").when(entity.rlike("^" + _NAMED), "secret").otherwise("person")


def _value(entity) -> F.Column:
    """A secret without its name."""
    return F.regexp_replace(entity, "^" + _NAMED, "")


def _untitled(entity) -> F.Column:
    return F.regexp_replace(entity, rf"^{_TITLE} ", "")


def canonical(kind, entity) -> F.Column:
    """What equal entities have in common."""
    plain = F.when(kind == "email", F.lower(entity)).when(kind == "person", F.lower(_untitled(entity))).when(kind.isin("card", "ssn", "iban"), _compact(entity))
    return plain.when(kind == "phone", F.concat(F.substring(entity, 1, 1).isin("+").cast("int").cast("string"), _compact(entity))).when(kind == "secret", _value(entity)).otherwise(entity)


def _permuted(cells, key: str, tweak) -> F.Column:
    """The numbers of ``cells``, an array of (d, radix) with 0 <= d < radix, permuted among all such arrays; none stays as it is unless every radix is 1."""

    def with_sizes(cells):
        n = F.size(cells)
        half, first = F.floor(n / 2).cast("int"), F.array_position(F.transform(cells, lambda c: c["radix"] > 1), F.lit(True)).cast("int") - 1

        def round_(state, step):
            left = step["side"] == 0
            other = F.when(left, F.slice(state, half + 1, F.greatest(n - half, F.lit(1)))).otherwise(F.slice(state, F.lit(1), half))
            seed = F.concat_ws("|", F.lit(key), tweak, step["number"].cast("string"), F.array_join(F.transform(other, lambda d: d.cast("string")), ","))
            stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 16).cast("int")), lambda k: F.sha2(F.concat(seed, F.lit("|"), k.cast("string")), 256)), "")

            def moved(stream):
                def one(d, i):
                    by = F.conv(F.substr(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int") * step["sign"]
                    return F.when((i < half) == left, F.pmod(d + by, F.get(cells, i)["radix"])).otherwise(d)

                return F.transform(state, one)

            up = F.transform(state, lambda d, i: F.when(i == first, F.pmod(d + 1, F.get(cells, i)["radix"])).otherwise(d))
            return F.when(step["side"] == 2, up).otherwise(let(stream, moved))

        steps = [(r % 2, 1, r) for r in range(ROUNDS)] + [(2, 1, 0)] + [(r % 2, -1, r) for r in reversed(range(ROUNDS))]
        order = F.array(*(F.struct(F.lit(a).alias("side"), F.lit(b).alias("sign"), F.lit(c).alias("number")) for a, b, c in steps))
        return F.aggregate(order, F.transform(cells, lambda c: c["d"]), round_)

    return let(cells, with_sizes)


def _cell(d, radix, base=None) -> F.Column:
    return F.struct(d.cast("int").alias("d"), radix.cast("int").alias("radix"), (F.lit(0) if base is None else base).cast("int").alias("base"))


def _redrawn(text, classes: tuple[str, ...], key: str, tweak, keep: int = 0) -> F.Column:
    """``text`` with each character replaced by one of its class; the first ``keep``, and those of no class, stay."""
    whole = F.lit("".join(classes))
    sizes = [len(c) for c in classes]

    def cell(c, i):
        at = F.when(i < keep, 0).otherwise(F.instr(whole, c)) - 1  # a character in no class: -1
        out, end = None, 0
        for n in sizes:
            case = at < end + n
            value = _cell(at - end, F.lit(n), F.lit(end))
            out = F.when(at < 0, _cell(F.lit(0), F.lit(1), F.lit(-1))).when(case, value) if out is None else out.when(case, value)
            end += n
        return out

    def drawn(cells):
        numbers = _permuted(cells, key, tweak)
        return let(numbers, lambda ns: F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(F.get(cells, i)["base"] < 0, c).otherwise(F.substr(whole, F.get(cells, i)["base"] + F.get(ns, i) + 1, F.lit(1)))), ""))

    return F.when(F.length(text) > 0, let(F.transform(F.split(text, ""), cell), drawn)).otherwise(text)


def _in_places(entity, compact, pattern: str) -> F.Column:
    """``entity`` with its characters of ``pattern`` replaced, in order, by those of ``compact``."""
    before = lambda i: F.length(F.regexp_replace(F.substr(entity, F.lit(1), i), f"[^{pattern}]", ""))
    return F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike(f"[{pattern}]"), F.substr(compact, before(i) + 1, F.lit(1))).otherwise(c)), "")


def _cased(entity, lower) -> F.Column:
    """``lower`` with capitals where ``entity`` has them."""
    return F.array_join(F.zip_with(F.split(entity, ""), F.split(lower, ""), lambda c, d: F.when(F.lower(c) != c, F.upper(d)).otherwise(d)), "")


def _digits(entity, key: str, kind: str, cells: Callable) -> F.Column:
    """The entity with its digits permuted; ``cells`` makes an array of (d, radix, base) of its digits."""

    def drawn(own):
        return let(cells(own), lambda cs: F.array_join(F.zip_with(cs, _permuted(cs, key, F.lit(kind)), lambda c, d: (c["base"] + d).cast("string")), ""))

    return _in_places(entity, let(_numbers(_compact(entity)), drawn), "0-9")


def _phone(entity, key: str) -> F.Column:
    two, digits = F.substring(_compact(entity), 1, 2), _compact(entity)
    code = F.when(~F.startswith(entity, F.lit("+")), 0).when(F.substring(digits, 1, 1).isin("1", "7"), 1).when(two.isin(CALLING_CODES), 2).otherwise(3)
    free = lambda d, i: F.when(i < code, _cell(F.lit(0), F.lit(1), d)).when((i == code) & (d < 2), _cell(d, F.lit(2))).when(i == code, _cell(d - 2, F.lit(8), F.lit(2))).otherwise(_cell(d, F.lit(10)))
    return _digits(entity, key, "phone", lambda own: F.transform(own, free))


def _card(entity, key: str) -> F.Column:
    def drawn(own):
        n = F.size(own)
        fixed = lambda d, i: F.when((i == 0) | (i == n - 1), _cell(F.lit(0), F.lit(1), F.when(i == 0, d).otherwise(0))).otherwise(_cell(d, F.lit(10)))
        numbers = let(F.transform(own, fixed), lambda cs: F.zip_with(cs, _permuted(cs, key, F.lit("card")), lambda c, d: c["base"] + d))
        return let(numbers, lambda ns: F.array_join(F.transform(ns, lambda d, i: F.when(i == n - 1, F.pmod(-_luhn(ns), F.lit(10))).otherwise(d).cast("string")), ""))

    return _in_places(entity, let(_numbers(_compact(entity)), drawn), "0-9")


def _ip(entity, key: str) -> F.Column:
    def cell(octet):
        n = F.length(octet)
        return F.when(n == 1, _cell(octet.cast("int"), F.lit(10))).when(n == 2, _cell(octet.cast("int") - 10, F.lit(90), F.lit(10))).otherwise(_cell(octet.cast("int") - 100, F.lit(156), F.lit(100)))

    return let(F.transform(F.split(entity, r"\."), cell), lambda cs: F.array_join(F.zip_with(cs, _permuted(cs, key, F.lit("ip")), lambda c, d: (c["base"] + d).cast("string")), "."))


def _remainder(text) -> F.Column:
    """Of an account number with its country and check digits at the end: the remainder by 97, letters being 10 to 35."""
    value = lambda c: F.instr(F.lit(DIGITS + UPPER), c) - 1
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)), F.lit(97)).cast("int"))


def _iban(entity, key: str) -> F.Column:
    """Country and spacing stay; the check digits differ from the right ones by as much as they did."""
    compact = _compact(entity)
    country, own = F.substring(compact, 1, 2), F.substring(compact, 3, 2).cast("int")
    account = F.substr(compact, F.lit(5), F.length(compact))
    right = lambda a: F.lit(98) - _remainder(F.concat(a, country, F.lit("00")))
    new = let(_redrawn(account, (DIGITS, UPPER), key, F.concat(F.lit("iban"), country)), lambda a: F.concat(country, F.lpad(F.pmod(right(a) + own - right(account), F.lit(100)).cast("string"), 2, "0"), a))
    return _in_places(entity, new, "0-9A-Z")


def _email(entity, key: str) -> F.Column:
    low = F.lower(entity)
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    labels, last = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    drawn = F.concat(_redrawn(local, (DIGITS, LOWER), key, F.concat(F.lit("email"), domain)), F.lit("@"), _redrawn(labels, (DIGITS, LOWER), key, F.concat(F.lit("domain"), last)), last)
    return _cased(entity, drawn)


def _first_name(name, key: str) -> F.Column:
    """Of a lower-case first name: another listed one of the same gender and script, or its permutation."""
    listed = [v.lower() for vs in FIRST.values() for v in vs]

    def by_shape(name):
        for _ in range(WALK):  # out of the list again
            name = let(name, lambda x: _redrawn(x, NAME_CLASSES, key, F.lit("first"))) if _ == 0 else let(name, lambda x: F.when(x.isin(listed), _redrawn(x, NAME_CLASSES, key, F.lit("first"))).otherwise(x))
        return name

    out = None
    for (gender, script), own in FIRST.items():
        values = F.array(*(F.lit(v.lower()) for v in own))
        shift = F.pmod(F.conv(F.substring(F.sha2(F.lit(f"{key}|{gender}|{script}"), 256), 1, 6), 16, 10).cast("int"), F.lit(len(own) - 1)) + 1
        other = F.get(values, F.pmod(F.array_position(values, name).cast("int") - 1 + shift, F.lit(len(own))))
        case = name.isin([v.lower() for v in own])
        out = F.when(case, other) if out is None else out.when(case, other)
    return out.otherwise(by_shape(name))


def _person(entity, key: str) -> F.Column:
    title = F.regexp_extract(entity, rf"^({_TITLE} )", 1)

    def drawn(words):
        last = _redrawn(F.lower(F.element_at(words, -1)), NAME_CLASSES, key, F.lit("last"))
        surname = _cased(F.element_at(words, -1), last)
        first = F.element_at(words, 1)
        given = let(_first_name(F.lower(first), key), lambda n: F.when(F.length(n) == F.length(first), _cased(first, n)).when((F.upper(first) == first) & (F.length(first) > 1), F.upper(n)).otherwise(F.initcap(n)))
        return F.concat(title, F.when(F.size(words) > 1, F.concat(given, F.lit(" "))).otherwise(""), surname)

    return let(F.split(_untitled(entity), " "), drawn)


def _surrogate(kind, entity, key: str) -> F.Column:
    value = _value(entity)
    secret = F.concat(F.regexp_extract(entity, "^" + _NAMED, 0), _redrawn(value, SECRET_CLASSES, key, F.lit("secret")))
    plain = lambda own: F.transform(own, lambda d: _cell(d, F.lit(10)))
    return (
        F.when(kind == "number", entity).when(kind == "email", _email(entity, key)).when(kind == "ip", _ip(entity, key)).when(kind == "card", _card(entity, key)).when(kind == "ssn", _digits(entity, key, "ssn", plain))
        .when(kind == "phone", _phone(entity, key)).when(kind == "iban", _iban(entity, key)).when(kind == "person", _person(entity, key)).when(kind == "key", _redrawn(entity, (DIGITS, UPPER), key, F.lit("key"), 4)).otherwise(secret)
    )


def described(found) -> F.Column:
    """Array of (entity, kind, canon) of an array of entities."""
    kinds = F.transform(found, lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))
    return F.transform(kinds, lambda s: F.struct(s["entity"].alias("entity"), s["kind"].alias("kind"), canonical(s["kind"], s["entity"]).alias("canon")))


def surrogates(found, key: str = KEY) -> F.Column:
    """The surrogates of an array of (entity, kind, ...)."""
    return F.transform(found, lambda s: _surrogate(s["kind"], s["entity"], key))


def _may_hold(text) -> F.Column:
    """What every entity's text has: cheap searches, so that most texts need no pattern."""
    any_of = lambda words: reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))
    titled = any_of([f"{t} " for t in _TITLES] + [f"{t}. " for t in _TITLES])
    return F.contains(text, F.lit("@")) | text.rlike("[0-9]") | (any_of("=:") & text.rlike(_NAMED)) | titled


def entities(text) -> F.Column:
    """All entities of a text, in order, as an array of strings."""
    return F.when(_may_hold(text), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def pattern_of(found) -> F.Column:
    """The pattern for a text whose entities are ``found``: with its full names, where they stand without a title; null without any."""
    full = F.filter(found, lambda e: e.rlike(rf"^{_TITLE} {_NAME} {_NAME}$"))
    names = F.array_distinct(F.transform(full, _untitled))
    return F.when(F.size(names) > 0, F.concat(F.lit(f"({ANY}|(?<![\\p{{L}}])(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}]))")))


def shared(listed: DataFrame) -> DataFrame:
    """(kind, drawn) that several of the entities ``listed`` (kind, canon, drawn) have: none."""
    return listed.groupBy("kind", "drawn").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("kind", "drawn")


def replaced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None, only: bool = True) -> DataFrame:
    """Documents with their entities replaced, and ``n_entities``; one row per row. ``key``: the session's KEY_SETTING, or else KEY."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    text, found = F.col(text_col), F.col("_pii_found")
    base = docs.select(id_col, text_col) if only else docs
    out = base.withColumn("_pii_first", entities(text))
    out = out.withColumn("_pii_pattern", pattern_of(F.col("_pii_first")))
    named = F.col("_pii_pattern").isNotNull()
    out = out.withColumn("_pii_found", described(F.when(named, F.regexp_extract_all(text, F.col("_pii_pattern"), F.lit(0))).otherwise(F.col("_pii_first"))))
    out = out.withColumn("_pii_drawn", surrogates(found, key))
    # the text between the entities, and the surrogates in their places
    held = F.when(F.size(found) > 0, text)
    pieces = F.when(named, F.split(held, F.col("_pii_pattern"), -1)).otherwise(F.split(held, ANY, -1))
    woven = F.array_join(F.flatten(F.zip_with(pieces, F.col("_pii_drawn"), lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    count = F.coalesce(F.size(F.filter(found, lambda s: s["kind"] != "number")), F.lit(0)).cast("long")
    drawn = F.zip_with(found, F.col("_pii_drawn"), lambda s, d: F.struct(s["kind"].alias("kind"), s["canon"].alias("canon"), canonical(s["kind"], d).alias("drawn")))
    rest = [F.col(c) for c in base.columns if c != text_col]
    result = out.select(*rest, F.when(F.size(found) > 0, woven).otherwise(text).alias(text_col), count.alias("n_entities"), drawn.alias("_pii_listed"))
    result = written(result, "surrogates")
    if shared(result.select(F.explode("_pii_listed").alias("e")).select("e.*")).limit(1).count():
        raise RuntimeError("two entities share a surrogate")
    return result.select(*base.columns, "n_entities")
