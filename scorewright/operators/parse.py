"""JSON extraction from raw answers and coercion to the label schema, as table jobs."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scorewright.functions.columns import let, once

SCALARS_IN_ORDER = ("product_name", "origin", "net_weight", "mfg_date", "expiry_date")
LIST_FIELDS = ("ingredient", "additive", "warning")
#: Order in which type issues and missing-field issues are listed (fixed values).
BUILD_ORDER = ("product_name", "ingredient", "additive", "warning", "nutrition", "origin", "net_weight", "mfg_date", "expiry_date")
ALL_FIELDS = (*SCALARS_IN_ORDER, *LIST_FIELDS, "nutrition")


def strip_fence(c: Column | str) -> Column:
    """What stands in the first fenced block, or the text."""
    c = F.col(c) if isinstance(c, str) else c
    p = r"(?is)```(?:json)?\s*(.*?)\s*```"
    return F.when(c.rlike(p), F.regexp_extract(c, p, 1)).otherwise(c)


def brace_span(c: Column | str) -> Column:
    """First { to last }; null without such a pair."""
    c = F.col(c) if isinstance(c, str) else c
    a, b = F.locate("{", c), F.length(c) - F.locate("}", F.reverse(c)) + 1
    return F.when((a > 0) & F.contains(c, F.lit("}")) & (b > a), F.substr(c, a, b - a + 1))


def open_span(c: Column | str) -> Column:
    """brace_span, or from the first { to the end."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(brace_span(c), F.when(F.locate("{", c) > 0, F.substr(c, F.locate("{", c))))


def strict_object(c: Column) -> Column:
    """The text's JSON object as a variant; null if it is anything but one object.

    The parser stops at the end of a value, so the text stands in an array before a list in a list: if that comes second,
    the whole text was read as the first item. Texts with two opening brackets in a row, which could pass for the mark,
    are parsed twice, in an array and in an object.
    """
    at = lambda h, path: F.try_variant_get(h, path, "variant")
    marked = let(F.try_parse_json(F.concat(F.lit("["), c, F.lit(",[[0]]]"))), lambda h: F.when(at(h, "$[1][0][0]").isNotNull(), at(h, "$[0]")))
    named = F.try_parse_json(F.concat(F.lit('{"r":'), c, F.lit("}")))
    twice = let(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), lambda h: F.when(h.isNotNull() & at(h, "$[1]").isNull() & named.isNotNull(), at(h, "$[0]")))
    return F.when(c.rlike(r"^[ \t\n\r]*\{"), F.when(c.rlike(r"\[[ \t\n\r]*\["), twice).otherwise(marked))


def trimmed(c: Column) -> Column:
    """The text without white space of any script at its ends; only texts that have some there are searched for it."""
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(F.regexp_replace(c, r"^(?U)\s+", ""), r"(?U)\s+$", "")).otherwise(c)


_QUOTES = str.maketrans({"“": '"', "”": '"', "„": '"'})


def mend(text: str) -> str | None:
    """A JSON object from text that was cut off or has commas too many; None if there is none to be had."""
    s = text if '"' in text else text.translate(_QUOTES)
    out, open_, inside, escaped = [], [], False, False
    for c in s:
        if inside:
            inside, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_ or open_[-1] != c:
                continue
            open_.pop()
        out.append(c)
    body = "".join(out) + ('"' if inside else "")
    for _ in range(3):
        whole = re.sub(r",\s*([}\]])", r"\1", re.sub(r"[,\s]+$", "", body) + "".join(reversed(open_)))
        for attempt in (whole, re.sub(r':\s*([}\]])', r": null\1", whole), re.sub(r',?\s*"[^"]*"\s*(}+)$', r"\1", whole)):
            try:
                found = json.loads(attempt)
            except ValueError:
                continue
            return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None
        body = body.rpartition(",")[0]
    return None


@once
@F.pandas_udf(StringType())
def _mended(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else mend(x))


def parse(responses: DataFrame, content: str = "content") -> DataFrame:
    """responses with data (variant), stage, parse_failed and used_repair.

    The ladder: the trimmed text, the fenced block, the span of braces, mending. Only objects count. One pass:
    spans that every strict step refuses reach an Arrow-batched function, other rows send it null.
    """
    found = lambda data, stage, rest=None: F.struct(data.alias("data"), stage.alias("stage"), (F.lit(None).cast("string") if rest is None else rest).alias("rest"))
    by_span = lambda s: let(strict_object(s), lambda x: found(x, F.when(x.isNotNull(), "span"), s))
    by_fence = lambda f: let(strict_object(f), lambda x: F.when(x.isNotNull(), found(x, F.lit("fenced"))).otherwise(let(open_span(f), by_span)))
    d = responses.withColumn("_t", trimmed(F.col(content)))
    d = d.withColumn("_d", strict_object(F.col("_t")))
    d = d.withColumn("_x", F.when(F.col("_d").isNotNull(), found(F.col("_d"), F.lit("text"))).when(F.col("_t").isNotNull(), let(strip_fence("_t"), by_fence)))
    d = d.select(*responses.columns, F.col("_x.data").alias("data"), F.col("_x.stage").alias("stage"), F.col("_x.rest").alias("_s"))
    d = d.withColumn("_m", _mended(F.when(F.col("data").isNull(), F.col("_s"))))
    mended = F.try_parse_json("_m")
    d = d.withColumns({"stage": F.coalesce(F.col("stage"), F.when(mended.isNotNull(), "mended"), F.lit("failed")), "data": F.when(F.col("data").isNull(), mended).otherwise(F.col("data"))}).drop("_s", "_m")
    return d.withColumns({"parse_failed": F.col("data").isNull(), "used_repair": F.col("stage") == "mended"})


def _kind(v: Column) -> Column:
    """Name of a variant's type as the issues spell it."""

    def of(s: Column) -> Column:
        at = lambda p: F.startswith(s, F.lit(p))
        return F.when(s == "STRING", "str").when(s == "BIGINT", "int").when(at("DECIMAL") | at("DOUBLE") | at("FLOAT"), "float").when(s == "BOOLEAN", "bool").when(at("OBJECT"), "dict").when(at("ARRAY"), "list").otherwise("NoneType")

    return let(F.schema_of_variant(v), of)


def _one(v: Column, path: Column) -> Column:
    """Struct of the coerced string and its issue. Whole floats keep their point; booleans are spelled with a capital."""

    def of(x: Column) -> Column:
        kind, raw = x["kind"], x["raw"]
        text = F.when(kind == "bool", F.initcap(raw)).when((kind == "float") & ~raw.rlike("[.eE]"), F.concat(raw, F.lit(".0"))).when(kind == "NoneType", "").otherwise(raw)
        issue = F.when(~kind.isin("str", "NoneType"), F.concat(path, F.lit(": expected str, got "), kind, F.lit("; stringified")))
        return F.struct(F.coalesce(text, F.lit("")).alias("value"), issue.alias("issue"))

    return let(F.struct(_kind(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("raw")), of)


#: The label fields as one struct, and how schema_of_variant() spells an object that has nothing but such fields, of these
#: types or null (names of other fields stand in backquotes where they could be mistaken).
ENTRIES = "array<struct<name:string,value:string>>"
RECORD = "struct<" + ",".join([*(f"{f}:string" for f in SCALARS_IN_ORDER), *(f"{f}:array<string>" for f in LIST_FIELDS), f"nutrition:{ENTRIES}"]) + ">"
_PLAIN = "|".join((rf"(?:{'|'.join(SCALARS_IN_ORDER)}): (?:STRING|VOID)", rf"(?:{'|'.join(LIST_FIELDS)}): (?:VOID|ARRAY<(?:STRING|VOID)>)", "nutrition: (?:VOID|ARRAY<(?:VOID|OBJECT<name: STRING, value: STRING>)>)"))
PLAIN = f"^OBJECT<(?:(?:{_PLAIN})(?:, (?:{_PLAIN}))*)?>$"
#: The same with nutrition items that all lack a name or value, or both.
_TEXT = "(?:STRING|VOID)"
LACKING = PLAIN.replace("OBJECT<name: STRING, value: STRING>", f"OBJECT<(?:name: {_TEXT}(?:, value: {_TEXT})?|value: {_TEXT})?>")


#: Null fields are not written, whatever the session says.
_WRITTEN = {"ignoreNullFields": "true"}


def _lacks(record: Column) -> Column:
    """Whether a RECORD has a nutrition item without name or value."""
    return F.exists(F.coalesce(record["nutrition"], F.array().cast(ENTRIES)), lambda e: e["name"].isNull() | e["value"].isNull())


def read_records(responses: DataFrame, content: str = "content") -> DataFrame:
    """coerce(parse(responses)) without data and stage, at less cost for answers of plain records.

    A text that is the same when it is read as label fields and written again is such a record: other types, fields, order,
    spelling or text about it would not come back. It is read in this one step, all others and those that say null by the ladder.
    """
    text = F.col(content)
    d = responses.withColumn("_read", F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")) & ~F.contains(text, F.lit("null")), F.from_json(text, RECORD)))
    d = d.withColumn("_told", F.when((F.to_json("_read", _WRITTEN) == text) & ~_lacks(F.col("_read")), F.col("_read"))).drop("_read")
    d = coerce(parse(d.withColumn("_rest", F.when(F.col("_told").isNull(), text)), "_rest"), told="_told")
    return d.withColumn("parse_failed", F.col("parse_failed") & F.col("_told").isNull()).drop("_told", "_rest", "data", "stage")


def coerce(parsed: DataFrame, data: str = "data", told: str | None = None) -> DataFrame:
    """parsed with the nine label columns and type_issues, missing_issues (arrays of string, in listing order).

    An object of label fields that all have their types is taken over in one step, and no object at all is an empty
    record; others are coerced value by value. Rows in which told (a RECORD without null items) isn't null have been read already.
    """
    get = lambda f, kind="variant": F.try_variant_get(data, f"$.{f}", kind)
    none = F.array().cast("array<string>")
    schema = F.schema_of_variant(data)
    d = parsed.withColumn("_kinds", F.when(schema.rlike(PLAIN) | schema.rlike(LACKING), schema))
    d = d.withColumn("_whole", F.when(F.col("_kinds").isNotNull(), F.try_variant_get(data, "$", RECORD)))
    known = F.lit(False) if told is None else F.col(told).isNotNull()
    d = d if told is None else d.withColumn("_whole", F.coalesce(told, "_whole"))
    # An item without name or value is not told from others by the schema.
    d = d.withColumn("_lacks", _lacks(F.col("_whole")))
    plain, own = F.col(data).isNull() | F.col("_whole").isNotNull(), lambda f: F.col(f"_whole.{f}")

    def either(value: Column, issue: str, no_issue: Column, slow: Column) -> Column:
        return F.when(plain, F.struct(value.alias("value"), no_issue.alias(issue))).otherwise(slow)

    texts = lambda f: F.transform(F.coalesce(own(f), none), lambda x: F.coalesce(x, F.lit("")))
    d = d.withColumns(
        {f"_{f}": either(F.coalesce(own(f), F.lit("")), "issue", F.lit(None).cast("string"), _one(get(f), F.lit(f))) for f in SCALARS_IN_ORDER}
        | {f"_{f}": either(F.when(known, F.coalesce(own(f), none)).otherwise(texts(f)), "issues", none, _listed(get, f)) for f in LIST_FIELDS}
        | {"_nutrition": F.when(F.col("_lacks"), _lacking(own("nutrition"))).otherwise(either(F.coalesce(own("nutrition"), F.array().cast(ENTRIES)), "issues", none, _entries(get)))}
    )
    issues = {f: F.array_compact(F.array(F.col(f"_{f}.issue"))) for f in SCALARS_IN_ORDER} | {f: F.col(f"_{f}.issues") for f in (*LIST_FIELDS, "nutrition")}
    root = F.when(F.col(data).isNull() & ~known, F.array(F.lit("root: expected object, got NoneType; using empty record"))).otherwise(none)
    keys = F.coalesce(F.json_object_keys(F.to_json(data)), none)
    said = ": missing from output; defaulted"
    missing = F.transform(F.array_except(F.array(*map(F.lit, ALL_FIELDS)), keys), lambda f: F.concat(f, F.lit(said)))
    lacking = lambda f: F.when(known, own(f).isNull()).otherwise(~F.contains(F.coalesce("_kinds", F.lit("")), F.lit(f"{f}: ")))
    unnamed = F.array_compact(F.array(*(F.when(lacking(f), f + said) for f in ALL_FIELDS)))
    full = reduce(lambda a, b: a & b, (own(f).isNotNull() for f in ALL_FIELDS))  # nothing to list, as in most
    d = d.withColumns({"type_issues": F.when(plain, F.when(F.col("_lacks"), issues["nutrition"]).otherwise(root)).otherwise(F.concat(root, *(issues[f] for f in BUILD_ORDER))), "missing_issues": F.when(full, none).when(plain, unnamed).otherwise(missing)})
    d = d.withColumns({f: F.col(f"_{f}.value") for f in SCALARS_IN_ORDER} | {f: F.col(f"_{f}.value") for f in (*LIST_FIELDS, "nutrition")})
    return d.drop("_kinds", "_whole", "_lacks", *(f"_{f}" for f in ALL_FIELDS))


def _discarded(path: str, kind: Column) -> Column:
    """Issues of a value that should have been a list."""
    return F.when(kind != "NoneType", F.array(F.concat(F.lit(f"{path}: expected list, got "), kind, F.lit("; discarded")))).otherwise(F.array().cast("array<string>"))


def _listed(get, f: str) -> Column:
    """Struct of a list field's strings and issues."""
    none = F.array().cast("array<string>")
    both = lambda value, issues: F.struct(value.alias("value"), issues.alias("issues"))
    whole = lambda items: both(F.transform(items, lambda x: x["value"]), F.filter(F.transform(items, lambda x: x["issue"]), lambda x: x.isNotNull()))

    def of(kind: Column) -> Column:
        text = get(f, "string")
        return (
            F.when(kind == "list", let(F.transform(get(f, "array<variant>"), _item(f)), whole))
            .when(kind == "str", both(F.when(text != "", F.array(text)).otherwise(none), F.array(F.lit(f"{f}: expected list, got str; wrapped in single-item list"))))
            .otherwise(both(none, _discarded(f, kind)))
        )

    return let(F.coalesce(F.when(get(f).isNotNull(), _kind(get(f))), F.lit("NoneType")), of)


def _entries(get) -> Column:
    """Struct of the nutrition entries and issues."""
    both = lambda value, issues: F.struct(value.alias("value"), issues.alias("issues"))
    kept = lambda items: F.transform(F.filter(items, lambda x: x["keep"]), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    whole = lambda items: both(kept(items), F.flatten(F.transform(items, lambda x: x["issues"])))
    empty = F.array().cast("array<struct<name:string,value:string>>")
    of = lambda kind: F.when(kind == "list", let(F.transform(get("nutrition", "array<variant>"), _entry), whole)).otherwise(both(empty, _discarded("nutrition", kind)))
    return let(F.coalesce(F.when(get("nutrition").isNotNull(), _kind(get("nutrition"))), F.lit("NoneType")), of)


def _lacking(entries: Column) -> Column:
    """What _entries() gives for items whose names and values are text or null."""

    def issue(e: Column, i: Column) -> Column:
        says = F.when(e.isNull(), ": expected object, got NoneType; skipped").when(e["name"].isNull(), ": missing 'name'; skipped").when(e["value"].isNull(), ": missing 'value'; defaulted to ''")
        return F.concat(F.lit("nutrition["), i.cast("string"), F.lit("]"), says)

    kept = F.transform(F.filter(entries, lambda e: e["name"].isNotNull()), lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["value"], F.lit("")).alias("value")))
    return F.struct(kept.alias("value"), F.filter(F.transform(entries, issue), lambda x: x.isNotNull()).alias("issues"))


def _item(f: str):
    def of(v: Column, i: Column) -> Column:
        return _one(v, F.concat(F.lit(f"{f}["), i.cast("string"), F.lit("]")))

    return of


def _entry(v: Column, i: Column) -> Column:
    """Struct of name, value, keep and issues of one nutrition item."""
    path = F.concat(F.lit("nutrition["), i.cast("string"), F.lit("]"))
    part = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    has = lambda k: part(k).isNotNull() & (_kind(part(k)) != "NoneType")

    def of(x: Column) -> Column:
        issues = (
            F.when(x["kind"] != "dict", F.array(F.concat(path, F.lit(": expected object, got "), x["kind"], F.lit("; skipped"))))
            .when(~x["named"], F.array(F.concat(path, F.lit(": missing 'name'; skipped"))))
            .otherwise(F.array_compact(F.array(F.when(~x["valued"], F.concat(path, F.lit(": missing 'value'; defaulted to ''"))), x["name"]["issue"], x["value"]["issue"])))
        )
        return F.struct(x["name"]["value"].alias("name"), x["value"]["value"].alias("value"), ((x["kind"] == "dict") & x["named"]).alias("keep"), issues.alias("issues"))

    name, value = _one(part("name"), F.concat(path, F.lit(".name"))), _one(part("value"), F.concat(path, F.lit(".value")))
    return let(F.struct(_kind(v).alias("kind"), has("name").alias("named"), has("value").alias("valued"), name.alias("name"), value.alias("value")), of)


def completion_flags(responses: DataFrame) -> DataFrame:
    """responses with ok, truncated, loop_cutoff and the error of an answer without content."""
    error = F.when(F.col("content").isNull() & F.col("error").isNull(), "empty_response: no content in first choice").otherwise(F.col("error"))
    d = responses.withColumn("error", error)
    return d.withColumns({"ok": F.col("error").isNull() & F.col("content").isNotNull(), "truncated": F.coalesce(F.col("finish_reason") == "length", F.lit(False)), "loop_cutoff": F.coalesce(F.col("finish_reason") == "loop_cutoff", F.lit(False))})


def structural_issues(coerced: DataFrame) -> DataFrame:
    """coerced with json_valid and structural_issues in their fixed order."""
    cut = F.when(F.col("finish_reason") == "length", "output_truncated").when(F.col("finish_reason") == "loop_cutoff", "generation_loop_detected")
    read = F.when(F.col("content").isNull(), "api_error").when(F.col("parse_failed"), "json_parse_failed").when(F.col("used_repair"), "json_repair_used")
    some = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    issues = F.concat(some(cut), some(read), "type_issues", "missing_issues")
    return coerced.withColumns({"json_valid": F.col("content").isNotNull() & ~F.col("parse_failed"), "structural_issues": issues})


def audit(parsed: DataFrame) -> DataFrame:
    """Rate of each stage of the ladder by model and condition."""
    n = parsed.groupBy("model_key", "condition", "stage").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("model_key", "condition"))  # a few stages each
    return n.withColumns({"total": total, "rate": F.col("n") / total})


def issue_rates(issues: DataFrame) -> DataFrame:
    """How many answers have each structural issue: model_key, condition, issue, n, total, rate, level.

    issues is structural_issues() of answers. Levels are the model under a condition, the model, and all answers, as
    grouping sets over one explosion, so one shuffle of partial counts; model_key and condition are null where a level
    sums over them. An answer counts once for an issue. Issues that no answer has are not listed; valid is whether the
    JSON could be read.
    """
    each = F.array_distinct(F.concat("structural_issues", F.array(F.when(F.col("json_valid"), "valid").otherwise("invalid"), F.lit(None).cast("string"))))
    d = issues.select("model_key", "condition", F.explode(each).alias("issue"))  # the null row counts the answer itself
    sets = [["model_key", "condition", "issue"], ["model_key", "issue"], ["issue"]]
    cells = d.groupingSets([[F.col(c) for c in s] for s in sets], F.col("model_key"), F.col("condition"), F.col("issue")).agg(F.count("*").alias("n"), F.grouping_id().alias("_level"))
    by = Window.partitionBy("model_key", "condition", "_level")  # a few issues each
    cells = cells.withColumn("total", F.max(F.when(F.col("issue").isNull(), F.col("n"))).over(by)).where("issue is not null")
    level = F.when(F.col("_level") == 0, "condition").when(F.col("_level") == 2, "model").otherwise("all")
    return cells.select("model_key", "condition", "issue", "n", "total", (F.col("n") / F.col("total")).alias("rate"), level.alias("level"))
