"""Version keys as column expressions.

A key is an array of text that orders like the version: arrays compare item by
item, numbers are zero-padded, and tags put items of one kind before another.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ITEM = r"(?:\d+|\d*[A-Za-z-][0-9A-Za-z-]*)"
#: Semantic versions, loosely: leading v, = and space, and the hyphen of a prerelease is optional.
SEMVER = rf"^[v=\s]*(\d+)\.(\d+)\.(\d+)(?:-?({_ITEM}(?:\.{_ITEM})*))?(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?\s*$"
LARGEST = 2**53 - 1
PEP440 = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def captures(text: Column, pattern: str, n: int) -> Column:
    """The captures of a pattern that spans the whole text as an array; null if it doesn't match, '' for absent ones."""
    joined = F.regexp_replace(text, pattern, "\u0001".join(f"${i}" for i in range(1, n + 1)))
    return F.when(text.rlike(pattern), F.split(joined, "\u0001"))


def padded(number: Column) -> Column:
    """Text that orders like the number, of any length: its digits after how many they are."""
    digits = F.ltrim(number, F.lit("0"))
    return F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)


def prerelease_items(pre: Column) -> Column:
    """Numbers of up to 15 digits order as numbers and before text."""
    return F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike(r"^\d{1,15}$"), F.concat(F.lit("1"), padded(x))).otherwise(F.concat(F.lit("2"), x)))


def semver_key(major: Column, minor: Column, patch: Column, pre: Column) -> Column:
    """A release orders above all its prereleases, a shorter prerelease below those that continue it."""
    main = F.array(*(padded(x.cast("string")) for x in (major, minor, patch)))
    return F.when(pre.isNull(), F.concat(main, F.array(F.lit("1")))).otherwise(F.concat(main, F.array(F.lit("0")), prerelease_items(pre)))


def semver(text: Column) -> Column:
    """struct(valid, major, minor, patch, pre, build, canonical, key); all but valid null in invalid versions."""

    def whole(p: Column) -> Column:
        numbers = [F.when(F.length(p[i]) <= 16, p[i]).try_cast("bigint") for i in range(3)]
        absent = lambda c: F.nullif(c, F.lit(""))
        raw = F.struct(*(n.alias(x) for n, x in zip(numbers, ("major", "minor", "patch"))), absent(p[3]).alias("pre"), absent(p[4]).alias("build"))
        return let(raw, finish)

    def finish(r: Column) -> Column:
        numbers = [r["major"], r["minor"], r["patch"]]
        valid = F.coalesce((F.greatest(*numbers) <= LARGEST) & numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull(), F.lit(False))
        canonical = F.concat(F.concat_ws(".", *(n.cast("string") for n in numbers)), F.coalesce(F.concat(F.lit("-"), r["pre"]), F.lit("")))
        of = lambda c: F.when(valid, c)
        return F.struct(
            valid.alias("valid"), of(numbers[0]).alias("major"), of(numbers[1]).alias("minor"), of(numbers[2]).alias("patch"),
            of(r["pre"]).alias("pre"), of(r["build"]).alias("build"), of(canonical).alias("canonical"), of(semver_key(*numbers, r["pre"])).alias("key"),
        )

    return let(F.coalesce(captures(text, SEMVER, 5), F.array_repeat(F.lit(""), 5)), whole)


def go_key(text: Column) -> Column:
    """Semantic versions; '' (the main module) above all, null or 'none' below all."""
    return F.when(text.isNull() | (text == "none"), F.array(F.lit("0"))).when(text == "", F.array(F.lit("2"))).otherwise(F.concat(F.array(F.lit("1")), F.coalesce(semver(text)["key"], F.array(text))))


def _pep440_parts(p: Column) -> tuple[Column, ...]:
    """From captures: epoch, all release numbers, those without trailing zeros, the pre / post / dev part and the local part, as items that order."""
    number = lambda x: padded(F.when(x == "", "0").otherwise(x))
    split = lambda x: F.transform(F.split(x, r"\."), lambda n: F.concat(F.lit("1"), padded(n)))
    kind = F.lower(p[2])
    has_post = (p[4] != "") | (p[5] != "")
    pre = (
        F.when(kind.isin("a", "alpha"), "1").when(kind.isin("b", "beta"), "2").when(kind != "", "3")
        .when(~has_post & (p[7] != ""), "0").otherwise("9")
    )
    post = F.when(has_post, F.concat(F.lit("1"), number(F.concat(p[4], p[6])))).otherwise("0")
    dev = F.when(p[7] != "", F.concat(F.lit("0"), number(p[8]))).otherwise("1")
    local = F.transform(F.split(F.lower(p[9]), r"[-_.]"), lambda x: F.when(x == "", "0").when(x.rlike(r"^\d+$"), F.concat(F.lit("2"), padded(x))).otherwise(F.concat(F.lit("1"), x)))
    tail = F.array(F.lit("0"), F.concat(pre, number(p[3])), post, dev)
    return F.array(F.lit("1"), number(p[0])), split(p[1]), split(F.regexp_replace(p[1], r"(\.0+)+$", "")), tail, local


def pep440_key(text: Column) -> Column:
    """Order of Python versions; invalid ones below all valid, by text."""

    def valid(p: Column) -> Column:
        epoch, _, numbers, tail, local = _pep440_parts(p)
        return F.concat(epoch, numbers, tail, local)

    return let(captures(text, PEP440, 10), lambda p: F.when(p.isNull(), F.array(F.lit("0"), F.coalesce(text, F.lit("")))).otherwise(valid(p)))


def pep440(text: Column) -> Column:
    """Of a Python version, null if it is invalid: struct(key, public, before_dev, before_post, base, epoch, release, pre, post, local).

    `public` is the key without the local part, `before_dev` and `before_post` are
    its beginnings, `base` is epoch and release; `release` keeps trailing zeros.
    """

    def parsed(p: Column) -> Column:
        epoch, release, numbers, tail, local = _pep440_parts(p)
        names = ("epoch", "release", "numbers", "tail", "local", "pre", "post", "own")
        values = (epoch, release, numbers, tail, local, (p[2] != "") | (p[7] != ""), (p[4] != "") | (p[5] != ""), p[9] != "")
        return let(F.struct(*(v.alias(n) for v, n in zip(values, names))), keyed)

    def keyed(q: Column) -> Column:
        base = F.concat(q["epoch"], q["numbers"])
        return let(base, lambda base: F.struct(
            F.concat(base, q["tail"], q["local"]).alias("key"), F.concat(base, q["tail"], F.array(F.lit("0"))).alias("public"), F.concat(base, F.slice(q["tail"], 2, 2)).alias("before_dev"),
            F.concat(base, F.slice(q["tail"], 2, 1)).alias("before_post"), base.alias("base"), q["epoch"].alias("epoch"), q["release"].alias("release"), q["pre"].alias("pre"), q["post"].alias("post"), q["own"].alias("local"),
        ))

    return let(captures(text, PEP440, 10), lambda p: F.when(p.isNotNull(), parsed(p)))


def pep440_is_prerelease(text: Column) -> Column:
    return F.coalesce(let(captures(text, PEP440, 10), lambda p: (p[2] != "") | (p[7] != "")), F.lit(False))


def canonical_name(name: Column) -> Column:
    """Python package names as the index keys them."""
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))
