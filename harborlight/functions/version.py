"""CPE names, version order and version ranges, pairwise (the order is not transitive, so it is no sort key)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields that name no version, and words that mark what comes before a release.
WILDCARDS = ["*", "-", ""]
PRERELEASE = ["alpha", "a", "beta", "b", "rc", "pre", "dev", "snapshot"]

LESS, EQUAL, GREATER, UNKNOWN = "less", "equal", "greater", "unknown"
IN_RANGE, OUT_OF_RANGE, INCONCLUSIVE = "in_range", "out_of_range", "inconclusive"


def parse_cpe(value: Column) -> Column:
    """(part, vendor, product, version) of a CPE 2.3 name, lower-cased; null if it is none. ``\\:`` is no separator."""
    text = F.lower(F.btrim(value))
    # escaped colons step aside, so that the split needs no pattern
    fields = F.split(F.replace(text, F.lit("\\:"), F.lit("\x01")), ":")

    def named(f: Column) -> Column:
        at = lambda i: F.replace(F.element_at(f, i), F.lit("\x01"), F.lit(":"))
        return F.when(F.size(f) >= 6, F.struct(at(3).alias("part"), at(4).alias("vendor"), at(5).alias("product"), at(6).alias("version")))

    return F.when(text.startswith("cpe:2.3:"), _let(fields, named))


def is_concrete(version: Column) -> Column:
    return F.coalesce(~version.isin(WILDCARDS), F.lit(False))


def tokens(version: Column) -> Column:
    """Runs of digits and letters; null if there is no number among them."""
    found = F.regexp_extract_all(F.lower(F.btrim(version)), F.lit("([0-9]+|[a-z]+)"), F.lit(1))
    return F.when(F.exists(found, lambda t: t.rlike("^[0-9]")), found)


def _number_less(a: Column, b: Column) -> Column:
    """Of digit strings of any length."""
    x, y = F.ltrim(a, F.lit("0")), F.ltrim(b, F.lit("0"))
    return (F.length(x) < F.length(y)) | ((F.length(x) == F.length(y)) & (x < y))


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` evaluated once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def compare_tokens(left: Column, right: Column) -> Column:
    """``less``, ``equal``, ``greater`` or (either side null) ``unknown``: the first position that differs decides.

    Numbers compare as numbers; equal numbers written differently count as greater. A word is later than a number or than
    nothing, but for prerelease words, which are earlier; words compare as text.
    """
    at = F.array_position(F.zip_with(left, right, lambda a, b: ~a.eqNullSafe(b)), F.lit(True)).cast("int")
    pick = lambda c, x, y: F.when(c, x).otherwise(y)
    early = lambda w: w.isin(PRERELEASE)

    def decided(c: Column) -> Column:
        a, b = c["a"], c["b"]
        a_num, b_num = a.rlike("^[0-9]"), b.rlike("^[0-9]")
        return (
            F.when(a.isNull(), pick(early(b), GREATER, LESS))
            .when(b.isNull(), pick(early(a), LESS, GREATER))
            .when(a_num & b_num, pick(_number_less(a, b), LESS, GREATER))
            .when(a_num, pick(early(b), GREATER, LESS))
            .when(b_num, pick(early(a), LESS, GREATER))
            .otherwise(pick(a < b, LESS, GREATER))
        )

    def placed(i: Column) -> Column:
        pair = F.struct(F.try_element_at(left, i).alias("a"), F.try_element_at(right, i).alias("b"))
        return F.when(i.isNull(), UNKNOWN).when(i == 0, EQUAL).otherwise(_let(pair, decided))

    return _let(at, placed)


def compare_versions(left: Column, right: Column) -> Column:
    return _let(F.struct(tokens(left).alias("l"), tokens(right).alias("r")), lambda t: compare_tokens(t["l"], t["r"]))


def version_in_range(version: Column, start_including: Column, start_excluding: Column, end_including: Column, end_excluding: Column) -> Column:
    """``in_range``, ``out_of_range`` or ``inconclusive``; bounds are looked at in this order and the first that fails decides.

    A null or empty bound is none. A version without a number is in an unbounded range and inconclusive otherwise.
    """
    texts = [start_including, start_excluding, end_including, end_excluding]
    bound = F.struct(tokens(version).alias("v"), *[x for i, b in enumerate(texts) for x in (F.coalesce(b != "", F.lit(False)).alias(f"h{i}"), tokens(b).alias(f"t{i}"))])
    return _let(bound, lambda s: tokens_in_range(s["v"], [(s[f"h{i}"], s[f"t{i}"]) for i in range(4)]))


def tokens_in_range(mine: Column, bounds: list[tuple[Column, Column]]) -> Column:
    """As :func:`version_in_range`, from the tokens of the version and (given, tokens) of each bound."""
    none = ~(bounds[0][0] | bounds[1][0] | bounds[2][0] | bounds[3][0])
    accepted = ([GREATER, EQUAL], [GREATER], [LESS, EQUAL], [LESS])

    def judged(has: Column, theirs: Column, good: list[str]) -> Column:
        return F.when(has, _let(compare_tokens(mine, theirs), lambda o: F.when(o == UNKNOWN, INCONCLUSIVE).when(~o.isin(good), OUT_OF_RANGE)))

    failed = F.coalesce(*[judged(has, theirs, good) for (has, theirs), good in zip(bounds, accepted, strict=True)])
    return F.when(mine.isNull(), F.when(none, IN_RANGE).otherwise(INCONCLUSIVE)).otherwise(F.coalesce(failed, F.lit(IN_RANGE)))
