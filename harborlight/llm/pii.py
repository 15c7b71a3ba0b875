"""Surrogates for personal data and secrets: keyed, type-consistent, distinct and coreferent.

Entities are found by one pattern. What an entity stands for (its canonical form) is hashed with a key; the hash makes the
surrogate: a name of the same gender and script, digits in the same layout with a check digit as good as before, an address in
the same form and range. The same canonical form gives the same surrogate everywhere, in whatever layout it is written.

Distinctness is checked by one aggregation over the distinct entities. Where a layout has room (eight times as many values
as the corpus has entities of it), entities whose surrogate is taken, or is some real entity, draw again; at most half of
them fail each time, so the rounds end, however large the corpus. Where a layout has no room (four-digit secrets, mailboxes
of one letter), no choice avoids real values: there a keyed permutation of the layout's values, without fixed points, gives
every entity another's place, distinct by construction. DataFrame operations only.

Found are: mail addresses, secrets after their keyword, common key formats, hardware addresses, account numbers, IPv4
addresses, card and social security numbers, phone numbers, and names after a form of address. Not found are: names without
one, IPv6 addresses, dates of birth and postal addresses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_key, in_row, maybe_in, pack_row, stored, unpack_row

KEY = "surrogate-key-1"
#: A layout has room if it has so many values for each of its entities.
ROOM = 8

# Forms of address by gender and script; they mark the names that follow.
MALE = r"Mr|Herr|Monsieur|Señor|Sr|Sir|господин|г-н"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|госпожа|г-жа"
OPEN = r"Dr|Prof|доктор"
_FORMS = rf"(?:{MALE}|{FEMALE}|{OPEN})(?:\.? {{1,2}}(?:{OPEN}))*+"
_FREE = r"(?<![\p{L}\p{N}_])"
_NAME = r"\p{Lu}[\p{Ll}'’-]{1,40}"
_SECRET = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?"
# Fixed patterns, the most telling first. Repetitions are bounded, but for the values of secrets and keys: these run to their
# end, and as they give nothing back (possessive), in linear time.
PATTERN = "|".join(
    [
        rf"{_FREE}[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}@[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{1,6}}",
        rf"{_FREE}{_SECRET}[^\s\",;]{{4,}}+",
        rf"{_FREE}(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![0-9A-Za-z])",
        rf"{_FREE}(?:gh[pousr]_|sk-|xox[abprs]-)[A-Za-z0-9-]{{16,}}+",
        rf"{_FREE}(?:[0-9A-Fa-f]{{2}}:){{5}}[0-9A-Fa-f]{{2}}(?![0-9A-Za-z:])",
        rf"{_FREE}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,4}})?(?![0-9A-Za-z])",
        rf"{_FREE}(?<![.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![0-9]|\.[0-9])",
        rf"{_FREE}(?:[0-9]{{13,19}}|[0-9]{{4}}(?:(?: [0-9]{{4}}){{3}}|(?:-[0-9]{{4}}){{3}}|[ -][0-9]{{6}}[ -][0-9]{{5}}))(?![0-9])",
        rf"{_FREE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9-])",
        r"(?<![\p{L}\p{N}_+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
        r"(?<![\p{L}\p{N}_+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?!\.?[0-9])",
        r"(?<![\p{L}\p{N}_(])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
        rf"{_FREE}{_FORMS}\.? {{1,2}}{_NAME}(?: {_NAME})?",
    ]
)
#: What every entity has something of: texts without are not searched further. All are cheap: a class, and the beginning of a
#: key or a title that a class of first letters precedes. A new entity without the class's characters needs a hint of its own.
HINT = r"[0-9@=:]"
KEY_HINT = r"(?=[Agsx])(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-)"
TITLE_HINT = rf"(?=[MHFSDPгд])(?<![\p{{L}}])(?:{MALE}|{FEMALE}|{OPEN})\.? {{1,2}}\p{{Lu}}"
_TITLE = rf"^({_FORMS}\.? {{1,2}})"
#: Letters that name the kind of a key or account number; they stay.
CODE_PREFIX = r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|[A-Z]{2}(?=[0-9]{2}))"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
# Syllables of invented names, by script, and endings by gender.
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga ge go ka ke ko la le lo ma me mi mo na ne no pa pe po ra re ri ro sa se so ta te to va ve vi vo".split(),
    "cyrillic": "ба бе бо да де до га ка ко ла ле ло ма ме ми мо на не но па пе по ра ре ри ро са се со та те то ва ве ви во".split(),
}
_ENDINGS = {
    "latin": {"f": ["na", "lia", "ra", "sa"], "m": ["ndo", "rt", "l", "nus"], "u": ["n", "ri", "le", "x"], "s": ["mann", "son", "ler", "ton", "berg", "ville", "nez", "rin"]},
    "cyrillic": {"f": ["на", "лия", "ра", "са"], "m": ["н", "р", "слав", "мир"], "u": ["н", "ри", "ле", "ша"], "s": ["ченко", "енко", "вич", "дзе"]},
}
# First numbers of public IPv4 addresses.
_PUBLIC = [n for n in range(1, 224) if n not in (10, 100, 127, 169, 172, 192, 198)]
# Fixed patterns: the ranges of IPv4 addresses that are not public; an address stays in its own.
_RANGES = [r"10\.", r"192\.168\.", r"172\.(?:1[6-9]|2[0-9]|3[01])\.", r"127\.", r"169\.254\.", r"100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.", r"0\.", r"2(?:2[4-9]|[34][0-9]|5[0-5])\."]
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_IBAN = "^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}$"
_HEXADECIMAL = "^(?:[0-9a-f:]{8,}|[0-9A-F:]{8,})$"
_OPEN_GIVEN = "given_u"


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` evaluated once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _kind(e: Column) -> Column:
    return (
        F.when(e.rlike(f"^{_SECRET}"), "secret")
        .when(e.rlike("^[^ ]+@"), "email")
        .when(e.rlike("^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$"), "ip")
        .when(e.rlike(_TITLE), "name")
        .when(e.rlike(r"^\+") | e.rlike(r"^\(?[0-9]{3}[) .-]{1,2}[0-9]{3}[.-][0-9]{4}$"), "phone")
        .when(e.rlike("^[0-9 -]+$"), "digits")
        .otherwise("code")
    )


def _bare_digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _secret_value(e: Column) -> Column:
    return F.regexp_replace(e, f"^{_SECRET}", "")


def _canonical(e: Column, kind: Column) -> Column:
    """What all mentions of the same thing share. Names and mail addresses are taken apart elsewhere."""
    return (
        F.when(kind == "secret", _secret_value(e))
        .when(kind == "phone", F.right(_bare_digits(e), F.lit(10)))
        .when(kind == "digits", _bare_digits(e))
        .when(kind == "code", F.replace(e, F.lit(" "), F.lit("")))
        .otherwise(e)
    )


def _stream(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """192 hexadecimal digits."""
    seed = [F.lit(key), kind, attempt.cast("string"), canonical]
    return F.concat(*[F.sha2(F.concat_ws("|", F.lit(str(i)), *seed).cast("binary"), 256) for i in range(3)])


def _byte(stream: Column, i: Column) -> Column:
    """Number ``i`` (from 0) of the stream, 0 to 255."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(96)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.pmod(n, F.lit(len(words))).cast("int") + 1)


def _characters(v: Column, each: Callable[[Column, Column], Column]) -> Column:
    """``each(character, its place from 1)`` for all characters of ``v``."""
    return F.array_join(F.transform(F.filter(F.split(v, ""), lambda c: c != ""), lambda c, i: each(c, i + 1)), "")


def _scrambled(v: Column, stream: Column) -> Column:
    """Letters for letters of the same case, digits for digits; hexadecimal text stays hexadecimal.

    Cyrillic letters stay Cyrillic, letters and digits of other scripts become small Latin letters.
    """

    def one(c: Column, x: Column, letters: Column) -> Column:
        return (
            F.when(c.between("0", "9"), (x % 10).cast("string"))
            .when(c.between("a", "z"), F.substring(F.lit(_LOWER), x % letters + 1, F.lit(1)))
            .when(c.between("A", "Z"), F.substring(F.lit(_UPPER), x % letters + 1, F.lit(1)))
            .when(c.between("а", "я"), F.substring(F.lit(_CYRILLIC), x % 32 + 1, F.lit(1)))
            .when(c.between("А", "Я"), F.upper(F.substring(F.lit(_CYRILLIC), x % 32 + 1, F.lit(1))))
            .when(c.rlike(r"[\p{L}\p{N}]"), F.substring(F.lit(_LOWER), x % 26 + 1, F.lit(1)))
            .otherwise(c)
        )

    def all_of(b: Column) -> Column:
        letters = F.when(b["v"].rlike(_HEXADECIMAL), 6).otherwise(26)
        return _let(letters, lambda n: _characters(b["v"], lambda c, i: one(c, _byte(b["s"], i), n)))

    return _let(F.struct(v.alias("v"), stream.alias("s")), all_of)


def _luhn_digit(body: Column) -> Column:
    """The check digit that makes ``body`` and it valid."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.pmod(F.lit(10) - F.aggregate(digits, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10, F.lit(10))


def _with_check(body: Column, was: Column) -> Column:
    """``body`` and a check digit, valid if that of ``was`` is, else off by as much."""
    off = F.pmod(F.right(was, F.lit(1)).cast("int") - _luhn_digit(F.left(was, F.length(was) - 1)), F.lit(10))
    return F.concat(body, ((_luhn_digit(body) + off) % 10).cast("string"))


def _mod97(account: Column) -> Column:
    """Remainder of an account number whose first four characters are already at its end; letters count 10 to 35."""
    return F.aggregate(F.filter(F.split(account, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _is_iban(c: Column) -> Column:
    return c.rlike(_IBAN) & (_mod97(F.concat(F.substring(c, 5, 40), F.left(c, F.lit(4)))) == 1)


def _iban(country: Column, account: Column) -> Column:
    return F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _name_surrogate(kind: Column, canonical: Column, stream: Column, attempt: Column) -> Column:
    """An invented name: syllables of the script, an ending of the gender (given names) or of surnames.

    Every second attempt adds a syllable, so there are always more names than a corpus needs.
    """

    def of(script: str) -> Column:
        syllables, ends = _SYLLABLES[script], _ENDINGS[script]
        stem = F.concat(*[_pick(syllables, F.conv(F.substring(stream, 1 + 4 * i, 4), 16, 10).cast("int")) for i in range(2)])
        # a longer stem where the hash says so
        stem = F.concat(stem, F.when(_byte(stream, F.lit(20)) % 2 == 0, _pick(syllables, _byte(stream, F.lit(21)))).otherwise(F.lit("")))
        stem = F.concat(stem, F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 2).cast("int")), lambda i: F.when(i == 0, "").otherwise(_pick(syllables, _byte(stream, 30 + i)))), ""))
        x = _byte(stream, F.lit(30))
        end = F.when(kind == "given_f", _pick(ends["f"], x)).when(kind == "given_m", _pick(ends["m"], x)).when(kind == "given_u", _pick(ends["u"], x)).otherwise(_pick(ends["s"], x))
        return F.initcap(F.concat(stem, end))

    return F.when(_script(canonical) == "cyrillic", of("cyrillic")).otherwise(of("latin"))


def _surrogate(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the surrogate."""
    bound = F.struct(kind.alias("kind"), canonical.alias("canonical"), attempt.alias("attempt"), _stream(kind, canonical, attempt, key).alias("s"))
    return _let(bound, lambda b: _let(_parts(b["kind"], b["canonical"]), lambda p: _surrogate_of(b, p)))


def _surrogate_of(b: Column, p: Column) -> Column:
    """``b``: kind, canonical form, attempt and stream; ``p``: the parts of the canonical form."""
    kind, canonical, attempt, s = b["kind"], b["canonical"], b["attempt"], b["s"]
    # whatever the values left, every eighth attempt makes texts of letters longer
    more = F.when(p["grows"], F.floor(attempt / 8).cast("int")).otherwise(0)
    longer = F.when(more == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: _pick(list(_LOWER), _byte(s, 60 + i))), ""))
    octets = F.concat_ws(".", _pick([str(n) for n in _PUBLIC], _byte(s, F.lit(0))), *[(_byte(s, F.lit(i)) % 254 + 1).cast("string") for i in range(1, 4)])
    within = F.concat(p["fixed"], F.array_join(F.transform(F.split(p["free"], r"\."), lambda _, i: (_byte(s, i) % 254 + 1).cast("string")), "."))
    ip = F.when(p["sort"] != "ip", _scrambled(canonical, s)).when(p["fixed"] == "", octets).otherwise(within)
    # a phone's first digit is 2 to 9; other digits are free
    phone = F.concat((_byte(s, F.lit(0)) % 8 + 2).cast("string"), _scrambled(F.substring(canonical, 2, 100), s))
    return (
        F.when(kind == "ip", ip)
        .when(kind == "phone", phone)
        .when(kind.isin("surname", "given_f", "given_m", "given_u"), _name_surrogate(kind, canonical, s, attempt))
        .otherwise(_let(F.concat(_scrambled(p["free"], s), longer), lambda free: _put_together(p, free, canonical)))
    )


def _parts(kind: Column, canonical: Column) -> Column:
    """A canonical form as ``fixed``, what stays before; ``free``, what a surrogate is free to choose; ``last``, what stays
    behind; ``sort`` tells what has to be worked out anew (``iban``, ``check``) and a real ``ip``; ``grows``: may get longer.
    """
    code, checked = kind == "code", (kind == "digits") & (F.length(canonical) >= 12)
    sort = F.when(code & _is_iban(canonical), "iban").when(checked, "check").when((kind == "ip") & canonical.rlike(_IPV4), "ip").otherwise("")
    reserved = F.regexp_extract(canonical, "^(?:" + "|".join(_RANGES) + ")", 0)
    top = F.concat(F.lit("."), F.substring_index(canonical, ".", -1))
    host = F.concat(F.lit("@"), F.substring_index(canonical, "@", -1))

    def ends(b: Column) -> Column:
        sort = b["sort"]
        fixed = F.when(sort == "iban", F.left(canonical, F.lit(2))).when(code, F.regexp_extract(canonical, CODE_PREFIX, 0)).when(sort == "check", F.left(canonical, F.lit(1))).when(sort == "ip", reserved).otherwise("")
        last = F.when(sort == "check", F.right(canonical, F.lit(1))).when(kind == "mailbox", host).when(kind == "domain", top).otherwise("")
        return F.struct(sort.alias("sort"), fixed.alias("fixed"), last.alias("last"))

    def whole(b: Column) -> Column:
        first = F.length(b["fixed"]) + F.when(b["sort"] == "iban", 3).otherwise(1)
        free = F.substring(canonical, first, F.length(canonical) - first - F.length(b["last"]) + 1)
        grows = kind.isin("secret", "mailbox", "domain") | (code & (b["sort"] == ""))
        return F.struct(b["sort"].alias("sort"), b["fixed"].alias("fixed"), free.alias("free"), b["last"].alias("last"), grows.alias("grows"))

    return _let(_let(F.struct(sort.alias("sort")), ends), whole)


def _put_together(p: Column, free: Column, canonical: Column) -> Column:
    sort, fixed = p["sort"], p["fixed"]
    checked = _let(F.concat(fixed, free), lambda body: _with_check(body, canonical))
    return F.when(sort == "iban", _iban(fixed, free)).when(sort == "check", checked).otherwise(F.concat(fixed, free, p["last"]))


# --- layouts without room ----------------------------------------------------------------------------------------------


def _radices(p: Column) -> Column:
    """(value, number of values, sort) of each place that a surrogate is free to choose: an array of structs."""

    def place(c: Column) -> Column:
        digit, low, high = c.between("0", "9"), c.between("a", "z"), c.between("A", "Z")
        v = F.when(digit, c.try_cast("int")).when(low, F.ascii(c) - 97).when(high, F.ascii(c) - 65).otherwise(0)
        return F.struct(v.cast("long").alias("v"), F.when(digit, 10).when(low | high, 26).otherwise(1).cast("long").alias("r"), F.when(digit, "9").when(low, "a").when(high, "A").otherwise(c).alias("k"))

    octet = lambda o: F.struct(o.try_cast("long").alias("v"), F.lit(256).cast("long").alias("r"), F.lit("o").alias("k"))
    return F.when(p["sort"] == "ip", F.transform(F.split(p["free"], r"\."), octet)).otherwise(F.transform(F.filter(F.split(p["free"], ""), lambda c: c != ""), place))


def _permuted(layout: Column, places: Column, key: str) -> Column:
    """The text of the free places after a keyed permutation of all their values, none of which stays where it is.

    A number ``x`` below the layout's size is cut in two parts, whose sizes multiply to it; four steps add a hash of one part
    to the other, one is added to the result, and the steps are undone: P'(P(x) + 1). Each step can be undone, so the whole is
    one-to-one, and as P(x) + 1 is not P(x), the result is not ``x``.
    """
    n = F.size(places)
    half = F.floor(n / 2).cast("int")
    product = lambda a: F.aggregate(a, F.lit(1).cast("long"), lambda x, p: x * p["r"])
    number = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, p: x * p["r"] + p["v"])
    head, tail = F.slice(places, 1, half), F.slice(places, half + 1, n)
    start = F.struct(layout.alias("layout"), number(head).alias("x"), number(tail).alias("y"), product(head).alias("a"), product(tail).alias("b"))

    def hashed(layout_: Column, step: int, other: Column, size: Column) -> Column:
        digits = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("permutation"), F.lit(str(step)), layout_, other.cast("string")).cast("binary"), 256), 1, 14)
        return F.conv(digits, 16, 10).cast("long") % size

    def moved(b: Column, step: int, sign: int) -> Column:
        if step % 2:
            return F.struct(b["layout"].alias("layout"), F.pmod(b["x"] + sign * hashed(b["layout"], step, b["y"], b["a"]), b["a"]).alias("x"), b["y"].alias("y"), b["a"].alias("a"), b["b"].alias("b"))
        return F.struct(b["layout"].alias("layout"), b["x"].alias("x"), F.pmod(b["y"] + sign * hashed(b["layout"], step, b["x"], b["b"]), b["b"]).alias("y"), b["a"].alias("a"), b["b"].alias("b"))

    def following(b: Column) -> Column:
        over = b["y"] + 1 == b["b"]
        x = F.when(over, (b["x"] + 1) % b["a"]).otherwise(b["x"])
        return F.struct(b["layout"].alias("layout"), x.alias("x"), ((b["y"] + 1) % b["b"]).alias("y"), b["a"].alias("a"), b["b"].alias("b"))

    def walk(step: int, sign: int) -> Callable[[Column], Column]:
        return lambda b: moved(b, step, sign)

    state = start
    for body in [*(walk(i, 1) for i in range(4)), following, *(walk(i, -1) for i in reversed(range(4)))]:
        state = _let(state, body)

    def written(b: Column) -> Column:
        def part(a: Column, value: Column) -> Column:
            back = F.aggregate(
                F.reverse(a),
                F.struct(value.alias("rest"), F.array().cast("array<long>").alias("vs")),
                lambda s, p: F.struct(F.floor(s["rest"] / p["r"]).cast("long").alias("rest"), F.concat(F.array(s["rest"] % p["r"]), s["vs"]).alias("vs")),
            )
            return F.zip_with(a, back["vs"], one)

        def one(p: Column, v: Column) -> Column:
            letter = F.when(p["k"] == "a", F.char(v + 97)).when(p["k"] == "A", F.char(v + 65))
            return F.when(p["r"] == 1, p["k"]).when(p["k"].isin("a", "A"), letter).otherwise(v.cast("string"))

        return _let(F.concat(part(head, b["x"]), part(tail, b["y"])), lambda parts: F.when(F.element_at(places, 1)["k"] == "o", F.array_join(parts, ".")).otherwise(F.array_join(parts, "")))

    return _let(state, written)


def crowded_units(units: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, made) of the entities whose layout has less room than ``ROOM`` values for each.

    Names have room always, as have texts with letters outside ASCII (both get longer). Layouts with more values than all
    entities together need are left out before anything is counted.
    """
    n_units = units.count()
    rows = units.filter(~F.col("kind").isin("surname", "given_f", "given_m", "given_u")).withColumn("p", _parts(F.col("kind"), F.col("canonical")))
    rows = rows.filter(~F.col("p.free").rlike(r"[^\x00-\x7F]")).withColumn("places", _radices(F.col("p")))
    rows = rows.withColumn("size", F.aggregate("places", F.lit(1.0), lambda a, p: a * p["r"])).filter((F.col("size") > 1) & (F.col("size") < ROOM * n_units))
    # what all entities share whose surrogates come from the same values; a check digit follows from the rest
    ends = F.when(F.col("p.sort") == "check", "").otherwise(F.col("p.last"))
    rows = rows.withColumn("layout", F.concat_ws("|", "kind", "p.sort", "p.fixed", F.array_join(F.transform("places", lambda p: p["k"]), ""), ends))
    full = rows.groupBy("layout").agg(F.count("*").alias("n"), F.first("size").alias("values")).filter(F.col("values") < ROOM * F.col("n")).select("layout")
    rows = rows.join(full, "layout", "left_semi").withColumn("free", _permuted(F.col("layout"), F.col("places"), key))
    return rows.select("kind", "canonical", _put_together(F.col("p"), F.col("free"), F.col("canonical")).alias("made"))


def _laid_out(mention: Column, kind: Column, canonical: Column, made: Column) -> Column:
    """The surrogate in the layout of the mention."""
    n = F.length(_bare_digits(mention)) - F.length(made)  # digits of a country code stay
    in_layout = _let(
        F.concat(F.left(_bare_digits(mention), n), made),
        lambda digits: _characters(mention, lambda c, i: F.when(c.between("0", "9"), F.substring(digits, F.length(_bare_digits(F.left(mention, i))), F.lit(1))).otherwise(c)),
    )
    in_groups = _characters(mention, lambda c, i: F.when(c == " ", c).otherwise(F.substring(made, F.length(F.replace(F.left(mention, i), F.lit(" "), F.lit(""))), F.lit(1))))
    return (
        F.when(kind.isin("phone", "digits"), in_layout)
        .when(kind == "secret", F.concat(F.regexp_extract(mention, f"^{_SECRET}", 0), made))
        .when(kind == "code", F.when(mention.contains(" "), in_groups).otherwise(made))  # a key may be long, an account number is not
        .otherwise(made)
    )


def _gender(title: Column) -> Column:
    word = r"(?![\p{L}])"
    return F.when(title.rlike(rf"^(?:{FEMALE}){word}"), "given_f").when(title.rlike(rf"^(?:{MALE}){word}"), "given_m").otherwise(_OPEN_GIVEN)


def _units(e: Column) -> Column:
    """What a mention is made of: (kind, canonical) of the parts of a name or a mail address, or of the whole."""
    kind = _kind(e)
    title = F.regexp_extract(e, _TITLE, 1)
    names = F.split(F.regexp_replace(e, _TITLE, ""), " ")
    unit = lambda k, c: F.struct(k.alias("kind"), c.alias("canonical"))
    surname = unit(F.lit("surname"), F.lower(F.element_at(names, -1)))
    given = unit(_gender(title), F.lower(F.element_at(names, 1)))
    address = F.lower(e)
    mail = F.array(unit(F.lit("mailbox"), address), unit(F.lit("domain"), F.substring_index(address, "@", -1)))
    return F.when(kind == "name", F.when(F.size(names) > 1, F.array(given, surname)).otherwise(F.array(surname))).when(kind == "email", mail).otherwise(F.array(unit(kind, _canonical(e, kind))))


def _rendered(e: Column, made: Callable[[Column, Column], Column]) -> Column:
    """A mention with its parts replaced; ``made(kind, canonical)`` is a part's surrogate."""

    def of(b: Column) -> Column:
        parts = F.transform(b["units"], lambda u: made(u["kind"], u["canonical"]))
        return _let(F.struct(b["e"].alias("e"), b["kind"].alias("kind"), b["units"].alias("units"), parts.alias("parts")), laid)

    def laid(b: Column) -> Column:
        names = F.concat(F.regexp_extract(b["e"], _TITLE, 1), F.array_join(b["parts"], " "))
        mail = F.concat(F.substring_index(F.element_at(b["parts"], 1), "@", 1), F.lit("@"), F.element_at(b["parts"], -1))
        mail = F.when(b["e"] == F.upper(b["e"]), F.upper(mail)).otherwise(mail)
        whole = _laid_out(b["e"], b["kind"], F.element_at(b["units"], 1)["canonical"], F.element_at(b["parts"], 1))
        return F.when(b["kind"] == "name", names).when(b["kind"] == "email", mail).otherwise(whole)

    return _let(F.struct(e.alias("e"), _kind(e).alias("kind"), _units(e).alias("units")), of)


def _unit_key(kind: Column, canonical: Column) -> Column:
    return F.concat_ws("|", kind, canonical)


def further_attempts(units: DataFrame, key: str) -> DataFrame | None:
    """(kind, canonical, attempt, made) of the units whose surrogate is not that of their first attempt; None if there are none.

    ``units``: distinct (kind, canonical). A surrogate is taken if a unit that sorts earlier has it, or if it is itself a
    canonical form of the corpus. Units of layouts without room are permuted (attempt -1) and keep what they get; a given name
    whose form of address tells no gender takes the surrogate it has elsewhere with one that does.
    """
    told = units.filter(F.col("kind").isin("given_f", "given_m")).groupBy("canonical").agg(F.min("kind").alias("told"))
    units = stored(units.join(told.withColumn("kind", F.lit(_OPEN_GIVEN)), ["kind", "canonical"], "left"))
    learnt, own = units.filter("told is not null").select("canonical", "told"), units.filter("told is null").select("kind", "canonical")
    # what has no letter and no digit tells nothing and stays
    blank = own.filter(~F.col("canonical").rlike(r"[\p{L}\p{N}]")).select("kind", "canonical", F.col("canonical").alias("made"))
    crowded = stored(crowded_units(own, key).unionByName(blank))
    first = own.join(crowded, ["kind", "canonical"], "left")
    attempt = F.when(F.col("made").isNull(), 0).otherwise(-1)
    current = stored(first.select("kind", "canonical", attempt.alias("attempt"), F.coalesce("made", _surrogate(F.col("kind"), F.col("canonical"), F.lit(0), key)).alias("made")))
    while True:
        # those that have tried less often keep theirs
        owners = current.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canonical")).alias("owner"))
        shared = owners.filter("n > 1").select("kind", "made", F.col("owner.canonical").alias("owner"))
        losers = current.join(shared, ["kind", "made"]).filter("canonical <> owner").select("kind", "canonical", "attempt")
        real = own.select("kind", F.col("canonical").alias("real"))
        folded = F.when(F.col("kind").isin("surname", "given_f", "given_m", "given_u"), F.lower("made")).otherwise(F.col("made"))
        losers = losers.union(current.withColumn("real", folded).join(real, ["kind", "real"]).select("kind", "canonical", "attempt"))
        losers = stored(losers.filter("attempt >= 0").select("kind", "canonical").distinct())
        if not losers.limit(1).count():
            break
        again = current.join(losers.withColumn("lost", F.lit(True)), ["kind", "canonical"], "left")
        again = again.withColumn("attempt", F.col("attempt") + F.when(F.col("lost"), 1).otherwise(0))
        before = current
        current = stored(again.select("kind", "canonical", "attempt", F.when(F.col("lost"), _surrogate(F.col("kind"), F.col("canonical"), F.col("attempt"), key)).otherwise(F.col("made")).alias("made")))
        discard(before)
        discard(losers)
    same = learnt.join(current.select(F.col("kind").alias("told"), "canonical", "attempt", "made"), ["told", "canonical"])
    changed = stored(current.filter("attempt <> 0").unionByName(same.select(F.lit(_OPEN_GIVEN).alias("kind"), "canonical", "attempt", "made")))
    return changed if changed.limit(1).count() else None


def pii_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """Input rows as ``__row`` with ``__found`` (the mentions in order) and ``__clean`` (the text with surrogates).

    * Null and empty texts stay as they are; an empty table stays empty; null ids and repeated rows stay; further columns of
      any name stay. Texts are searched whole.
    * A row's text is rewritten where it lies; only distinct entities are shuffled (map-side combined, so one entity in a
      third of all documents is one row per task).
    * Entities whose surrogate is not that of a first attempt are joined to the documents that mention them; a bitmap of fixed
      size tells these from most others, which do not move.
    """
    rows = pack_row(docs).select("__row", in_row(text_col).alias("__text"), doc_key(in_row(id_col)).alias("__id"))
    found = F.when(F.col("__text").rlike(HINT) | F.col("__text").rlike(KEY_HINT) | F.col("__text").rlike(TITLE_HINT), F.regexp_extract_all("__text", F.lit(PATTERN), F.lit(0)))
    mentions = rows.select("__id", F.xxhash64("__text").alias("__version"), F.explode(found).alias("e"))
    mentioned = stored(mentions.select("__id", "__version", F.explode(_units(F.col("e"))).alias("u")).select("__id", "__version", "u.kind", "u.canonical"))
    more = further_attempts(stored(mentioned.select("kind", "canonical").distinct()), key)
    first = lambda k, c: _surrogate(k, c, F.lit(0), key)
    if more is None:
        return _rewritten(rows, found, first)
    per = stored(mentioned.join(more, ["kind", "canonical"]).groupBy("__id", "__version").agg(F.map_from_entries(F.collect_set(F.struct(_unit_key(F.col("kind"), F.col("canonical")), "made"))).alias("__more")))
    version = F.xxhash64("__id", "__version")
    told = maybe_in(rows.withColumn("__version", F.xxhash64("__text")), version, per, version)
    moved = told.filter("__maybe").join(per, ["__id", "__version"], "left")
    known = lambda k, c: F.coalesce(F.try_element_at(F.col("__more"), _unit_key(k, c)), first(k, c))
    return _rewritten(told.filter(~F.col("__maybe")), found, first).unionByName(_rewritten(moved, found, known))


def _rewritten(rows: DataFrame, found: Column, made: Callable[[Column, Column], Column]) -> DataFrame:
    pieces = F.split("__text", PATTERN, -1)
    joined = F.array_join(F.zip_with(pieces, F.col("__found"), lambda p, e: F.concat(p, F.coalesce(_rendered(e, made), F.lit("")))), "")
    rows = rows.withColumn("__found", F.coalesce(found, F.array().cast("array<string>")))
    return rows.select("__row", "__found", F.when(F.size("__found") > 0, joined).otherwise(F.col("__text")).alias("__clean"))


def with_surrogates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with every detected entity in ``text_col`` replaced; rows and other columns stay."""
    return unpack_row(pii_report(docs, id_col=id_col, text_col=text_col, key=key), docs.columns, **{text_col: F.col("__clean")})


def surrogate_digest(docs: DataFrame, *, key: str = KEY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_entities, n_distinct, text. A null text has none and is given back empty."""
    report = pii_report(docs, key=key)
    return report.select(
        in_row("doc_id").cast("long").alias("doc_id"),
        F.size("__found").cast("long").alias("n_entities"),
        F.size(F.array_distinct("__found")).cast("long").alias("n_distinct"),
        F.coalesce("__clean", F.lit("")).alias("text"),
    )
