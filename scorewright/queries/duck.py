"""DuckDB expressions for the scalar functions, as text."""

from __future__ import annotations

from scorewright.functions.text import NUTRIENT_NAMES, QUOTES_FROM, QUOTES_TO, UNIT_NAMES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"translate({x}, {q(QUOTES_FROM)}, {q(QUOTES_TO)})"


def norm(x: str) -> str:
    return rf"lower(trim(regexp_replace(trim(regexp_replace({fold(f"coalesce({x}, '')")}, '\s+', ' ', 'g')), '[.!?]+$', '')))"


def strip(x: str) -> str:
    return f"strip_accents(translate({x}, 'đĐ', 'dD'))"


def number(x: str) -> str:
    t = rf"regexp_extract({x}, '[-+]?\d[\d.,]*')"
    return f"try_cast(CASE WHEN {t} LIKE '%.%' AND {t} LIKE '%,%' THEN replace(replace({t}, '.', ''), ',', '.') WHEN {t} LIKE '%,%' THEN replace({t}, ',', '.') ELSE {t} END AS DOUBLE)"


def _map(names: dict[str, tuple[str, ...]]) -> str:
    return "MAP {" + ", ".join(f"{q(a)}: {q(to)}" for to, alias in names.items() for a in alias) + "}"


def unit(x: str) -> str:
    t = f"replace({norm(x)}, ' ', '')"
    return f"CASE WHEN {t} <> '' THEN coalesce({_map(UNIT_NAMES)}[{t}], {t}) END"


def unit_after(x: str) -> str:
    return unit(rf"regexp_extract({x}, '[-+]?\d[\d.,]*\s*([^\d\s(),;]*)', 1)")


def date(x: str) -> str:
    s = f"replace({norm(x)}, ' ', '')"
    a, b = r"'^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$'", r"'^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$'"
    two = lambda p, k: f"lpad((regexp_extract({s}, {p}, {k})::INT)::VARCHAR, 2, '0')"
    return f"CASE WHEN regexp_matches({s}, {a}) THEN regexp_extract({s}, {a}, 3) || '-' || {two(a, 2)} || '-' || {two(a, 1)} WHEN regexp_matches({s}, {b}) THEN regexp_extract({s}, {b}, 1) || '-' || {two(b, 2)} || '-' || {two(b, 3)} ELSE {norm(x)} END"


def nutrient(x: str) -> str:
    return f"coalesce({_map(NUTRIENT_NAMES)}[{norm(x)}], {norm(x)})"


def tokens(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


def ratio(a: str, b: str) -> str:
    """Similarity of two columns that hold sorted tokens, of at most 100 characters: the subsequence bit by bit."""
    one = "1::HUGEINT"
    marks = f"list_transform(string_split({b}, ''), lambda c: coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i::INT, 1) = c THEN {one} << (i - 1)::INT ELSE 0::HUGEINT END)), 0)::HUGEINT)"
    last = f"list_reduce(list_prepend(({one} << length({a})::INT) - 1, {marks}), lambda s, m: (s + (s & m)) | (s - (s & m)))"
    common = f"(length({a}) - bit_count({last} & (({one} << length({a})::INT) - 1)))"
    return f"CASE WHEN {a} = {b} THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 200.0 * {common} / (length({a}) + length({b})) END"
