"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once. ledger() keeps the measurements and one integer whose bit k says that rule k failed;
policies are versioned masks over those bits, so applying one, or asking what each rule alone rejects, reads no text.

A null or empty text has no words and fails the rules that ask for words. Rows that repeat are judged alike; an empty
table gives an empty ledger. Only id_col and text_col are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bit of each rule in a ledger, lowest first. Bits keep their place for ever; new rules are added at the end.
RULES = ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "many_words", "few_letters", "bullet_lines", "ellipsis_lines", "shouting", "long_lines", "repeated_line_chars", "no_sentence_end")
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies: the bits for which a document is rejected. A policy never changes; a new version gets a new name.
V1 = sum(BIT[r] for r in RULES[:6])
POLICIES = {"base": BASE, "v1": V1, "v2": V1 | BIT["many_words"] | BIT["few_letters"] | BIT["bullet_lines"] | BIT["ellipsis_lines"], "v3": sum(BIT.values())}

#: What ledger() measures of each text.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_not_letters", "n_capitals", "n_ends", "n_bullet_lines", "n_ellipsis_lines", "n_long_lines", "line_chars", "dup_line_chars")
SPACE = "[ \\t-\\r]+"
BULLET, ELLIPSIS, LONG_LINE = r"^[ \t]*(?:[-*]|[0-9]+[.)]) ", r"(?:\.\.\.|\x{2026})[ \t\r]*$", 10_000


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value evaluated once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeated(items: Column, key: str) -> Column:
    """Positions i of an array of structs (key, i) whose key occurs at least twice."""

    def of(by_key: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(by_key, a)[key] == F.get(by_key, b)[key], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(by_key) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.transform(at, lambda k: F.get(by_key, k)["i"])

    return F.when(F.size(items) > 0, _let(F.array_sort(items), of)).otherwise(F.array().cast("array<int>"))


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows whose hashes meet are compared as words."""
    window = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    likely = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _repeated(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))), "h")).otherwise(F.array().cast("array<int>"))
    sure = lambda at: _repeated(F.transform(at, window), "t")
    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
    return F.when(F.size(w) >= 4, _let(_let(_let(hashes, likely), sure), covered)).otherwise(0)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of keep (id_col alone if None) and, of each whole text, the MEASURES (long: words,
    lines and characters of each sort) and `failures`, the bits of the rules that failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))

    def measured(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))

    def lined(x: Column) -> Column:
        of = lambda pattern: F.size(F.filter(x, lambda y: y.rlike(pattern)))
        chars = lambda y: F.aggregate(y, F.lit(0), lambda n, z: n + F.length(z))
        return _let(
            F.array_distinct(x),
            lambda d: F.struct(
                F.size(x).alias("n_lines"),
                (F.size(x) - F.size(d)).alias("n_dup_lines"),
                of(BULLET).alias("n_bullet_lines"),
                of(ELLIPSIS).alias("n_ellipsis_lines"),
                F.size(F.filter(x, lambda y: F.length(y) > LONG_LINE)).alias("n_long_lines"),
                chars(x).alias("line_chars"),
                (chars(x) - chars(d)).alias("dup_line_chars"),
            ),
        )

    def judged(a: Column) -> Column:
        of = {n: a["w"][n] for n in ("n_words", "word_chars", "n_repeat_words")} | {n: a["l"][n] for n in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_long_lines", "line_chars", "dup_line_chars")}
        of |= {n: a[n] for n in ("n_symbols", "n_not_letters", "n_capitals", "n_ends")}
        return _let(F.struct(*(of[n].cast("long").alias(n) for n in MEASURES)), lambda m: F.struct(m.alias("m"), _failures(m).alias("failures")))

    counted = {"n_symbols": left("[^#*$%&|<>]+"), "n_not_letters": left("[A-Za-z\\x{80}-\\x{10FFFF} \\t-\\r]+"), "n_capitals": left("[^A-Z]+"), "n_ends": left("[^.!?]+")}
    all_of = _let(F.struct(_let(words, measured).alias("w"), _let(lines, lined).alias("l"), *(c.alias(n) for n, c in counted.items())), judged)
    d = df.select(*(F.col(c) for c in keep or (id_col,)), all_of.alias("_all"))
    return d.select(*(F.col(c) for c in keep or (id_col,)), *(F.col(f"_all.m.{n}").alias(n) for n in MEASURES), F.col("_all.failures").alias("failures"))


def _failures(m: Column) -> Column:
    n, chars, lines = m["n_words"], m["word_chars"], m["n_lines"]
    failed = {
        "few_words": n < 50,
        "repeated_words": 100 * m["n_repeat_words"] > 50 * n,
        "symbols": 10 * m["n_symbols"] > n,
        "duplicate_lines": 10 * m["n_dup_lines"] > 5 * lines,
        "short_words": chars < 2 * n,
        "long_words": chars > 20 * n,
        "many_words": n > 100_000,
        "few_letters": 10 * m["n_not_letters"] > 4 * chars,
        "bullet_lines": 10 * m["n_bullet_lines"] > 9 * lines,
        "ellipsis_lines": 10 * m["n_ellipsis_lines"] > 3 * lines,
        "shouting": 10 * m["n_capitals"] > 4 * chars,
        "long_lines": (m["n_long_lines"] > 0) & (10 * m["n_ends"] < m["n_long_lines"]),
        "repeated_line_chars": 10 * m["dup_line_chars"] > 3 * m["line_chars"],
        "no_sentence_end": (n > 0) & (m["n_ends"] == 0),
    }
    return reduce(lambda x, y: x.bitwiseOR(y), (F.when(failed[r], F.lit(BIT[r])).otherwise(F.lit(0)) for r in RULES))


def apply_policy(of: DataFrame, policy: str | int = "v1") -> DataFrame:
    """The ledger with base_failed and kept under a policy: a name of POLICIES or a mask."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    hit = lambda m: F.col("failures").bitwiseAND(F.lit(m)) != 0
    return of.withColumn("base_failed", hit(BASE)).withColumn("kept", ~hit(mask | BASE))


def ablation(of: DataFrame, policy: str | int = "v1") -> DataFrame:
    """One row per rule of the policy: documents it fails, and those that only it rejects (kept if it were dropped)."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return _ablations(of, {"": mask}).drop("policy")


def _ablations(of: DataFrame, policies: dict[str, int]) -> DataFrame:
    """policy, rule, n_docs, n_rejected, n_failed, n_only of each rule of each policy, in one aggregation of the ledger."""
    used = [(p, mask, r) for p, mask in policies.items() for r in RULES if BIT[r] & mask]
    hit = lambda mask: F.col("failures").bitwiseAND(F.lit(mask))
    sums = [F.count_if(hit(BIT[r]) != 0).alias(f"f_{r}") for r in RULES]
    sums += [F.count_if(hit(mask) != 0).alias(f"r_{k}") for k, mask in enumerate(policies.values())]
    sums += [F.count_if(hit(mask) == BIT[r]).alias(f"o_{k}") for k, (_, mask, r) in enumerate(used)]
    one = of.agg(F.count("*").alias("n"), *sums)
    number = {p: k for k, p in enumerate(policies)}
    rows = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.col("n").alias("n_docs"), F.col(f"r_{number[p]}").alias("n_rejected"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{k}").alias("n_only")) for k, (p, _, r) in enumerate(used)]
    return one.select(F.inline(F.array(*rows)))


def ablations(of: DataFrame) -> DataFrame:
    """Every policy, rule by rule: documents, those that the policy rejects, that the rule fails, that only it rejects."""
    return _ablations(of, POLICIES)


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (
  SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT l.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 5 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""

#: The further rules, and failed rules as a list, over the measurements of ORACLE_SQL.
_MORE = r"""
, x AS (
  SELECT m.*, l.t, length(regexp_replace(t, '[A-Za-z\x{80}-\x{10FFFF}\x20\x09-\x0D]', '', 'g')) AS n_not_letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
         length(regexp_replace(t, '[^.!?]', '', 'g')) AS n_ends, len(list_filter(l, lambda y: regexp_matches(y, '^[\x20\t]*([-*]|[0-9]+[.)]) '))) AS n_bullets,
         len(list_filter(l, lambda y: regexp_matches(y, '(\.\.\.|\x{2026})[\x20\t\r]*$'))) AS n_ellipses, len(list_filter(l, lambda y: length(y) > 10000)) AS n_long,
         coalesce(list_sum(list_transform(l, lambda y: length(y))), 0) AS line_chars, coalesce(list_sum(list_transform(list_distinct(l), lambda y: length(y))), 0) AS distinct_chars
  FROM m JOIN l USING (doc_id)),
f AS (
  SELECT doc_id, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_dup_lines > 5 * n_lines)::INT
         + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT + 64 * (n_words > 100000)::INT + 128 * (10 * n_not_letters > 4 * word_chars)::INT
         + 256 * (10 * n_bullets > 9 * n_lines)::INT + 512 * (10 * n_ellipses > 3 * n_lines)::INT + 1024 * (10 * n_capitals > 4 * word_chars)::INT
         + 2048 * (n_long > 0 AND 10 * n_ends < n_long)::INT + 4096 * (10 * (line_chars - distinct_chars) > 3 * line_chars)::INT + 8192 * (n_words > 0 AND n_ends = 0)::INT AS failures
  FROM x)
"""
#: doc_id and the bits of its failed rules.
LEDGER_SQL = ORACLE_SQL[: ORACLE_SQL.index(",\nb AS")] + _MORE + "SELECT doc_id, failures FROM f"
#: The ablation table of all policies.
ABLATION_SQL = ORACLE_SQL[: ORACLE_SQL.index(",\nb AS")] + _MORE + f"""
SELECT policy, rule, count(*) AS n_docs, count(*) FILTER (WHERE failures & mask <> 0) AS n_rejected, count(*) FILTER (WHERE failures & bit <> 0) AS n_failed, count(*) FILTER (WHERE failures & mask = bit) AS n_only
FROM f, (VALUES {", ".join(f"('{r}', {BIT[r]})" for r in RULES)}) r(rule, bit), (VALUES {", ".join(f"('{p}', {m})" for p, m in POLICIES.items())}) p(policy, mask) WHERE bit & mask <> 0 GROUP BY policy, rule
"""
