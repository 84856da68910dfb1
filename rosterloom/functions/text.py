"""Text functions: Column in, Column out, all of them built from JVM-side expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(x: Column) -> Column:
    """Trimmed; null becomes empty."""
    return F.coalesce(F.trim(x), F.lit(""))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def tidy(x: Column) -> Column:
    """White space runs collapsed to one space, ends trimmed, case kept."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def folded(x: Column) -> Column:
    """``tidy`` with case folded; sharp s folds to ss."""
    return F.replace(F.lower(tidy(x)), F.lit("ß"), F.lit("ss"))


def id_normal(x: Column) -> Column:
    """A trimmed identifier; whole numbers lose their plus sign and leading zeros, others stay."""
    t = F.trim(x)
    digits = F.regexp_replace(F.regexp_extract(t, r"^[+-]?0*(\d+)$", 1), r"^$", "0")
    sign = F.when(t.startswith("-") & (digits != "0"), "-").otherwise("")
    return F.when(t.rlike(r"^[+-]?\d+$"), F.concat(sign, digits)).otherwise(t)


def split_list(x: Column) -> Column:
    """The parts between semicolons, trimmed, without the empty ones; commas never split."""
    return F.filter(F.transform(F.split(x, ";"), lambda p: F.trim(p)), lambda p: p != "")


def origin_places(x: Column) -> Column:
    """Semicolons always split; commas only where every part looks like ``Place (AB)``."""

    def parts(p: Column) -> Column:
        cut = F.transform(F.split(p, ","), lambda c: F.trim(c))
        return F.when((F.size(cut) > 1) & F.forall(cut, lambda c: c.rlike(r"^.+\([A-Z]{2}\)$")), cut).otherwise(F.array(p))

    return F.flatten(F.transform(split_list(x), parts))


def birthplace(city: Column, region: Column) -> Column:
    """``city (region)``, or the city; a region alone is no place."""
    c, r = blank_to_null(city), blank_to_null(region)
    return F.when(c.isNotNull() & r.isNotNull(), F.concat(c, F.lit(" ("), r, F.lit(")"))).otherwise(c)


def as_bool(x: Column) -> Column:
    """true, 1 and yes in any case; everything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def as_int(x: Column) -> Column:
    return F.trim(x.cast("string")).try_cast("bigint")


def as_int_loose(x: Column) -> Column:
    """Also the whole part of a decimal number."""
    return F.trim(x.cast("string")).try_cast("double").try_cast("bigint")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(x, r"(?U)[^\w\s-]", ""))), r"(?U)[\s_-]+", "-")


def item_id(x: Column) -> Column:
    """``Q`` and digits, alone or at the end of an entity address; else null."""
    return F.nullif(F.regexp_extract(F.trim(x), r"^(?:.*/entity/)?(Q\d+)$", 1), F.lit(""))


def property_id(x: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(x), r"^(?:.*/)?(P\d+)$", 1), F.lit(""))


def searchable_name(x: Column) -> Column:
    """Exactly two words with one run of white space between them."""
    return F.coalesce(F.trim(x).rlike(r"(?U)^\S+\s+\S+$"), F.lit(False))


def given_and_last(first: Column, last: Column, whole: Column) -> Column:
    """A struct of given and last name: as given, else the whole name cut at its last space."""
    f, l, w = blank_to_null(first), blank_to_null(last), tidy(whole)
    cut = F.regexp_extract(w, r"^(.*) (\S+)$", 1), F.regexp_extract(w, r"^(.*) (\S+)$", 2)
    own = f.isNotNull() | l.isNotNull()
    return F.struct(
        F.when(own, F.coalesce(f, F.lit(""))).otherwise(F.coalesce(cut[0], F.lit(""))).alias("given"),
        F.when(own, F.coalesce(l, F.lit(""))).otherwise(F.coalesce(F.nullif(cut[1], F.lit("")), w, F.lit(""))).alias("last"),
    )


@cache
def _marks() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Letters with marks in the Latin blocks and their base letters; those that become several letters apart."""
    source, target, several = [], [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c:
            (source.append(c), target.append(plain)) if len(plain) == 1 else several.append((c, plain))
    return "".join(source), "".join(target), tuple(several)


def plain_letters(x: Column) -> Column:
    """Latin letters without their marks."""
    source, target, several = _marks()
    for c, plain in several:
        x = F.replace(x, F.lit(c), F.lit(plain))
    return F.regexp_replace(F.translate(x, source, target), r"\p{Mn}", "")


def surname_fold(x: Column) -> Column:
    """A surname for comparison: bracketed parts dropped, case and marks folded, letters only, the
    spelled-out umlauts written short and doubled letters single."""
    out = F.lower(F.regexp_replace(x, r"\([^)]*\)", " "))
    for a, b in (("ä", "a"), ("ö", "o"), ("ü", "u"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(plain_letters(out), r"[^a-z]", "")
    for a, b in (("ae", "a"), ("oe", "o"), ("ue", "u")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"(.)\1+", "$1")


def name_tokens(x: Column) -> Column:
    return F.filter(F.split(plain_letters(folded(x)), r"(?U)\W+"), lambda t: t != "")


def name_key(x: Column) -> Column:
    """The folded words of a name in alphabetical order, so their order doesn't matter."""
    return F.array_join(F.array_sort(name_tokens(x)), " ")


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def near(needle: Column, hay: Column) -> Column:
    """Whether some stretch of ``hay``, as long as ``needle`` or one character off, is within one edit."""
    n, size = F.char_length(needle), F.char_length(hay)

    def stretches(width: Column) -> Column:
        last = size - width + 1
        return F.when((width > 0) & (last >= 1), F.transform(F.sequence(F.lit(1), last), lambda k: F.substr(hay, k, width))).otherwise(F.array().cast("array<string>"))

    every = F.flatten(F.array(*[stretches(n + d) for d in (-1, 0, 1)]))
    return F.exists(every, lambda s: F.levenshtein(s, needle, 1) >= 0)


def surname_parts(x: Column) -> Column:
    """The folded parts of a compound surname."""
    return F.filter(F.transform(F.split(x, r"(?U)[-\s]+"), surname_fold), lambda p: p != "")


def name_relation(a: Column, b: Column) -> Column:
    """How surname ``a`` stands in name ``b``: exact, variant (also if they share a part of a compound name), near
    or different; null if either is missing or ``b`` is the id of an item without a label."""
    x, y = surname_fold(a), surname_fold(b)
    unknown = blank_to_null(a).isNull() | blank_to_null(b).isNull() | F.coalesce(F.trim(b).rlike(r"^Q\d+$"), F.lit(False))
    plain_a, plain_b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (
        F.when(unknown, None)
        .when(F.contains(plain_b, plain_a), "exact")
        .when((x != "") & F.contains(y, x), "variant")
        .when(F.arrays_overlap(surname_parts(a), surname_parts(b)), "variant")
        .when((x != "") & (y != "") & near(x, y), "near")
        .otherwise("different")
    )


def one_edit_keys(x: Column) -> Column:
    """Keys that two words share if they are within one edit: the word, and it with each letter left out."""
    n = F.char_length(x)
    less = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.substr(x, F.lit(1), k - 1), F.substr(x, k + 1)))
    return F.array_distinct(F.concat(F.array(x), F.when(n > 0, less).otherwise(F.array().cast("array<string>"))))


#: Words that say what kind of thing a district is, not which.
DISTRICT_KINDS = ("wahlkreis", "stadt", "kreis", "kanton", "zh")


def district_key(x: Column) -> Column:
    """The sorted words that name a district: marks, the source's own ordinal and the kinds left out; null if none is left."""
    words = F.filter(F.split(F.lower(plain_letters(x)), "[^0-9a-z]+"), lambda w: w != "")
    ordinal = F.coalesce(F.try_element_at(words, F.lit(1)).rlike(r"^\d+$") & F.array_contains(F.slice(words, 1, 2), "wahlkreis"), F.lit(False))
    words = F.when(ordinal, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    kept = F.array_sort(F.filter(words, lambda w: ~w.isin(*DISTRICT_KINDS)))
    return F.when(F.size(kept) > 0, kept)


def numeral_split(x: Column) -> Column:
    """A struct of the roman numeral before a label and the label; without one the numeral is null."""
    t = tidy(x)
    numeral = F.regexp_extract(t, r"^([IVXLC]+)\s+(.+)$", 1)
    return F.struct(F.nullif(numeral, F.lit("")).alias("numeral"), F.when(numeral != "", F.regexp_extract(t, r"^([IVXLC]+)\s+(.+)$", 2)).otherwise(t).alias("label"))


def district_number(x: Column, most: int = 18) -> Column:
    """The whole part of a number from 1 to ``most``, else null."""
    n = as_int_loose(x)
    return F.when(n.between(1, most), n)


def district_order(x: Column) -> Column:
    """The ordinal before the first point, 99 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(x), r"^(\d+)\s*(?:\.|$)", 1), F.lit("")).cast("int"), F.lit(99))


def search_terms(x: Column) -> Column:
    """What to search for a district: the name in brackets after the kind, alone, then the whole spelling."""
    t = tidy(x)
    inner = F.trim(F.regexp_extract(t, r"\((.*)\)", 1))
    terms = F.array(F.when(inner != "", F.concat(F.lit("Wahlkreis "), inner)), F.when(inner != "", inner), F.when(t != "", t))
    return F.array_distinct(F.filter(terms, lambda w: w.isNotNull()))


def first_number(*candidates: Column) -> Column:
    """The first candidate that is a whole number; null if none is."""
    return F.coalesce(*[as_int(c) for c in candidates])


def first_filled(*candidates: Column) -> Column:
    """The first candidate that isn't blank, trimmed; else empty."""
    return F.coalesce(*[blank_to_null(c.cast("string")) for c in candidates], F.lit(""))


def filled_values(x: Column) -> Column:
    """The values of a list, trimmed, without nulls and blanks."""
    return F.filter(F.transform(x, lambda v: F.trim(v.cast("string"))), lambda v: v.isNotNull() & (v != ""))


def count_cell(x: Column) -> Column:
    """A count given as text; 0 if it is none."""
    return F.coalesce(as_int(x), F.lit(0))


def vote_ids(tokens: list[str] | None) -> list[int]:
    """Vote numbers as given; ``auto`` and nothing mean to discover them; anything else is an error, never dropped."""
    out = []
    for token in tokens or []:
        plain = str(token).strip()
        if plain.lower() == "auto":
            continue
        if not plain.removeprefix("-").isdigit():
            raise ValueError(f"a vote is a number or auto, not {token!r}")
        out.append(int(plain))
    return out
