"""Text, number, unit and date functions as Column expressions; normalisation keeps every script's letters."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from scorewright.functions.columns import let, once

# Fixed values.
QUOTES_FROM = "“”„‟«»‘’‚‛"
QUOTES_TO = "\"\"\"\"\"\"''''"
UNIT_NAMES = {
    "g": ("g", "gr", "gram", "grams"),
    "mg": ("mg", "milligram"),
    "kg": ("kg",),
    "kcal": ("kcal", "calo", "calorie", "calories"),
    "ml": ("ml", "milliliter"),
    "l": ("l", "lit", "liter", "lít"),
    "%": ("%", "pct", "percent"),
    "mcg": ("mcg", "microgram", "µg"),
}
NUTRIENT_NAMES = {
    "energy": ("năng lượng", "energy", "calo"),
    "protein": ("chất đạm", "đạm", "protein", "protein tổng số"),
    "fat": ("chất béo", "béo", "fat", "lipid", "total fat"),
    "saturated fat": ("chất béo bão hòa", "chất béo bão hoà", "saturated fat"),
    "carbohydrate": ("carbohydrat", "carbohydrate", "chất bột đường", "tinh bột", "carbohydrat tổng số"),
    "total sugar": ("đường tổng số", "total sugar"),
    "sugar": ("đường", "sugar"),
    "sodium": ("natri", "sodium"),
    "fiber": ("chất xơ", "fiber", "fibre", "chất xơ tổng số"),
    "cholesterol": ("cholesterol",),
    "calcium": ("canxi", "calcium"),
}
#: Texts inside these ranges hold no combining mark and are in composed form as they stand.
COMPOSED = r"[^\x{0}-\x{2ff}\x{1e00}-\x{1eff}\x{2010}-\x{2027}\x{20ac}]"
#: Patterns of white space and numbers (fixed values).
SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"
NUMBER = r"[-+]?\d[\d.,]*"
#: Where a text may differ from its normalised form: at capitals, sentence ends, characters outside ASCII, control
#: characters, and spaces in a row or at an end.
UNEVEN = r'[^ "-\-/->@\[-~]|  |\A | \z'


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_quotes(c: Column | str) -> Column:
    return F.translate(_c(c), QUOTES_FROM, QUOTES_TO)


def normalize_text(c: Column | str) -> Column:
    """Straight quotes, single spaces, no sentence end, lower case; null is empty. The input is in composed form (see composed())."""
    text = F.coalesce(_c(c), F.lit(""))
    s = F.trim(F.regexp_replace(fold_quotes(text), SPACE, " "))
    return F.when(text.rlike(UNEVEN), F.lower(F.trim(F.regexp_replace(s, "[.!?]+$", "")))).otherwise(text)


@once
@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def compose(c: Column | str) -> Column:
    """A text in Unicode composed form; only texts with characters outside COMPOSED reach Python."""
    odd = F.coalesce(_c(c).rlike(COMPOSED), F.lit(False))
    return F.when(odd, _nfc(F.when(odd, _c(c)))).otherwise(_c(c))


def _decomposed(c: Column, kind: DataType) -> Column:
    """Whether a string, or one in an array or struct, has a character outside COMPOSED; null stands for no, too."""
    if isinstance(kind, ArrayType):
        return F.exists(c, lambda x: _decomposed(x, kind.elementType))
    if isinstance(kind, StructType):
        return reduce(lambda a, b: a | b, (_decomposed(c[f.name], f.dataType) for f in kind.fields))
    return (c if isinstance(kind, StringType) else F.to_json(F.array(c))).rlike(COMPOSED)


def composed(df: DataFrame, *cols: str, to: tuple[str, ...] | None = None) -> DataFrame:
    """df with the columns, strings or arrays and structs of them, in Unicode composed form (under the names of to, if
    given). One pass: only values with characters outside COMPOSED reach Python."""

    def form(c: str) -> Column:
        kind = df.schema[c].dataType
        plain = kind.simpleString() == "string"
        odd = F.coalesce(_decomposed(F.col(c), kind), F.lit(False))
        made = _nfc(F.when(odd, F.col(c) if plain else F.to_json(c)))
        return F.when(odd, made if plain else F.from_json(made, kind)).otherwise(F.col(c))

    return df.withColumns({n: form(c) for n, c in zip(to or cols, cols, strict=True)})


@cache
def _marks() -> tuple[str, str, str]:
    """From all code points of Unicode: characters and what they become without their marks, one for one, then the marks
    themselves, which have no counterpart and are dropped; and a class of those that take more than a look-up: characters
    that become several, and those that compose with a neighbour once marks between them are gone."""
    pairs, gone, odd = {"đ": "d", "Đ": "D"}, [], []
    for code in [*range(0xD800), *range(0xE000, 0x110000)]:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Mn":
            gone.append(c)
        elif kind not in ("Cn", "Co") and not unicodedata.is_normalized("NFD", c):
            base = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))
            pairs |= {c: base} if len(base) == 1 and base != c and c not in pairs else {}
            odd += [c] if len(base) > 1 else []
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.category(last := chr(int(parts[1], 16))) != "Mn":
            odd.append(last)  # the second part of a composition that isn't a mark, as some vowel signs
    odd += map(chr, range(0x1161, 0x11C3))  # vowels and finals of Hangul
    return "".join([*pairs, *gone]), "".join(pairs.values()), "[" + "".join(f"\\x{{{ord(c):x}}}" for c in odd) + "]"


def __getattr__(name: str) -> str:
    """MARKED, BARE and RESIDUE, made when first asked for: Python workers import this module and don't need them."""
    tables = ("MARKED", "BARE", "RESIDUE")
    if name in tables:
        return _marks()[tables.index(name)]
    raise AttributeError(name)


def strip_diacritics(c: Column | str) -> Column:
    """The text without marks, by one look-up a character in tables made from Unicode's decompositions; đ is d.

    Text in composed form is right as a whole but for RESIDUE: a few characters that become several, and letters that
    join once a mark between them is gone, as vowels of Hangul do. stripped() takes these as well.
    """
    marked, bare, _ = _marks()
    return F.translate(_c(c), marked, bare)


@once
@F.pandas_udf(StringType())
def _stripped(s: pd.Series) -> pd.Series:
    bare = lambda x: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn"))
    return s.map(lambda x: None if x is None else bare(x))


def stripped(c: Column | str) -> Column:
    """strip_diacritics() of any text in any form; only texts with a character of RESIDUE reach Python."""
    odd = F.coalesce(_c(c).rlike(_marks()[2]), F.lit(False))
    return F.when(odd, _stripped(F.when(odd, _c(c)))).otherwise(strip_diacritics(c))


def _number_of(token: Column) -> Column:
    dot, comma = F.contains(token, F.lit(".")), F.contains(token, F.lit(","))
    plain = F.when(dot & comma, F.translate(F.replace(token, F.lit(".")), ",", ".")).when(comma, F.translate(token, ",", ".")).otherwise(token)
    return plain.try_cast("double")


def normalize_number(c: Column | str) -> Column:
    """The first number of a text: with both marks, dots group thousands; commas alone are decimal points. Null if none."""
    return _number_of(F.regexp_extract(_c(c), NUMBER, 0))


def normalize_unit(c: Column | str) -> Column:
    token = F.replace(normalize_text(c), F.lit(" "))
    return F.when(token != "", F.coalesce(F.element_at(_table(UNIT_NAMES), token), token))


def _table(names: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*(F.lit(x) for to, alias in names.items() for a in alias for x in (a, to)))


def number_unit(c: Column | str) -> Column:
    """Struct of the first number and the unit right after it."""
    s = F.coalesce(_c(c), F.lit(""))
    rest = F.regexp_extract(s, NUMBER + r"(?s:(?U)\s*([^\d\s(),;]*))", 1)
    return F.struct(normalize_number(s).alias("number"), normalize_unit(rest).alias("unit"))


def normalize_date(c: Column | str) -> Column:
    """Day-first or year-first dates as yyyy-mm-dd, without a calendar check; else the normalised text."""
    text = normalize_text(c)
    s = F.replace(text, F.lit(" "))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    day_first, year_first = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$", r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
    part = lambda p, k: F.regexp_extract(s, p, k)
    return (
        F.when(s.rlike(day_first), F.concat_ws("-", part(day_first, 3), two(part(day_first, 2)), two(part(day_first, 1))))
        .when(s.rlike(year_first), F.concat_ws("-", part(year_first, 1), two(part(year_first, 2)), two(part(year_first, 3))))
        .otherwise(text)
    )


def canonical_nutrient(c: Column | str) -> Column:
    name = normalize_text(c)
    return F.coalesce(F.element_at(_table(NUTRIENT_NAMES), name), name)


def nutrition_text(c: Column | str) -> Column:
    return F.array_join(F.transform(_c(c), lambda e: F.concat(e["name"], F.lit("="), e["value"])), "; ")


def list_text(c: Column | str) -> Column:
    return F.array_join(_c(c), " | ")


def slug_path(c: Column | str) -> Column:
    return F.replace(_c(c), F.lit("/"), F.lit("__"))


def cost_usd(tokens_in: Column | str, tokens_out: Column | str, price_in: Column | str, price_out: Column | str) -> Column:
    return _c(tokens_in) / 1e6 * _c(price_in) + _c(tokens_out) / 1e6 * _c(price_out)


def condition_parts(c: Column | str) -> Column:
    p = r"^(\w+)_s(\d)"
    return F.struct(F.regexp_extract(_c(c), p, 1).alias("kind"), F.regexp_extract(_c(c), p, 2).try_cast("int").alias("severity"))


def has_loop(c: Column | str, tail: int = 800, least: int = 8, most: int = 200, copies: int = 5) -> Column:
    """Whether the text's tail ends in `copies` repeats of one unit of least to most characters."""

    def of(t: Column) -> Column:
        n = F.length(t)
        # The end repeats with period p if it equals what stands p characters before it.
        repeats = lambda p: F.right(t, p * (copies - 1)) == F.left(F.right(t, p * copies), p * (copies - 1))
        # Most texts end at once: the last characters must stand there again within the longest period.
        near = F.position(F.right(t, F.lit(least)), F.substr(t, F.greatest(n - most - least + 1, F.lit(1)), F.least(n - 1, F.lit(most + least - 1)))) > 0
        return F.when((n >= least * copies) & near, F.exists(F.sequence(F.lit(least), F.least(F.lit(most), F.floor(n / copies).cast("int"))), repeats)).otherwise(False)

    return F.coalesce(let(F.right(_c(c), F.lit(tail)), of), F.lit(False))
