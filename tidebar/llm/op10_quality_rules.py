"""Quality rules: a threshold table compiled into one projection of ratios, without user functions.

Every measure is a column expression over the whole text. Defined results: a null text has no words; an empty text has
zero counts and fails the base rules; texts of any length are measured whole; repeated rows are judged row by row; columns
other than doc_id and text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import keep_rows

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages that the rules accept.
STOP_WORDS = ("the", "and", "of", "to", "in", "that", "with", "for", "is", "it", "as", "was", "on", "at",
              "der", "die", "das", "und", "von", "zu", "mit", "den", "ist", "nicht", "ein", "eine", "auf", "für", "sich", "dem",
              "le", "la", "les", "de", "des", "et", "que", "dans", "pour", "un", "une", "est", "pas", "qui", "sur", "du",
              "el", "los", "las", "y", "en", "del", "por", "con", "para", "se", "su", "al", "lo")


class Rule(NamedTuple):
    """numerator / denominator must lie in [low, high]; a rule whose denominator is 0 holds."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float


#: The threshold table. Measures are the keys of `measures`.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.3),
    Rule("shouts_per_word", "n_shouts", "n_words", 0.0, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.005, 1.0),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.6),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", 0.0, 0.5),
)
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50


MEASURES = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_stop_words", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_repeat_words")
#: Positions take the low bits of a sort key, the hash of the window the rest.
POSITION_BITS = 21


def _removed(body: Column, pattern: str) -> Column:
    """Code points that match the pattern."""
    return (F.char_length(body) - F.char_length(F.regexp_replace(body, pattern + "+", ""))).cast("long")


def _spots(w: Column, keys: Column, exact: Column) -> Column:
    """Start positions of the windows that occur more than once, ascending.

    `keys` holds, sorted, the leading hash bits of each window over its position, so equal windows are neighbours.
    Where neighbours agree in those bits but not in their words, or the text is too long for the position bits, the
    order of `exact` (hash, words, position) decides.
    """
    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")

    def near(x: Column, y: Column) -> Column:
        return F.shiftright(x, POSITION_BITS) == F.shiftright(y, POSITION_BITS)

    def equal(i: Column, j: Column) -> Column:
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    def same(x: Column, y: Column) -> Column:
        return (x.h == y.h) & (x.a == y.a) & (x.b == y.b) & (x.c == y.c)

    def picked(found: Column) -> Column:
        return F.array_sort(F.filter(found, lambda i: i.isNotNull()))

    clash = F.exists(F.transform(keys, lambda x, k: F.coalesce(near(x, F.get(keys, k + 1)) & ~equal(place(x), place(F.get(keys, k + 1))),
                                                               F.lit(False))), lambda x: x)
    quick = F.transform(keys, lambda x, k: F.when(F.coalesce(near(x, F.get(keys, k - 1)), F.lit(False))
                                                  | F.coalesce(near(x, F.get(keys, k + 1)), F.lit(False)), place(x)))
    slow = F.transform(exact, lambda x, k: F.when(F.coalesce(same(x, F.get(exact, k - 1)), F.lit(False))
                                                  | F.coalesce(same(x, F.get(exact, k + 1)), F.lit(False)), x.i))
    return F.when(exact.isNotNull(), picked(slow)).when(keys.isNotNull(), F.when(clash, F.lit(None)).otherwise(picked(quick)))


def measures(df: DataFrame, text: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Add the counts that the rules refer to. They pass a generator of one row each, below which the optimizer moves no
    filter: a filter on a verdict would otherwise be rewritten in terms of the text, once per mention."""
    own = df.columns
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    w, lines, h = F.col("_words"), F.col("_lines"), F.col("_hashes")
    df = df.withColumns({"_words": F.filter(F.split(body, SPACE + "+"), lambda x: x != ""), "_lines": F.split(body, "\n")})
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.regexp_replace(body, SPACE + "+", "")).cast("long"),
        "n_symbols": _removed(body, f"[{SYMBOLS}]"),
        "n_shouts": _removed(body, "!"),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*stop_words, *(x.title() for x in stop_words)))).cast("long"),
        "_lines": F.filter(lines, lambda x: x.rlike(WORD)),
        "_hashes": F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1,
                           F.greatest(F.size(w) - 2, F.lit(0)))})
    keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-1 << POSITION_BITS)).bitwiseOR(i.cast("long"))))
    exact = F.array_sort(F.transform(h, lambda x, i: F.struct(
        x.alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))
    long_text = F.size(h) >= (1 << POSITION_BITS)
    df = df.withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)" + SPACE + "*$"))).cast("long"),
        "_twice": F.size(F.array_distinct(h)) < F.size(h)})
    df = df.withColumns({"_keys": F.when(F.col("_twice") & ~long_text, keys), "_exact": F.when(F.col("_twice") & long_text, exact)})
    df = df.withColumn("_spots", _spots(w, F.col("_keys"), F.col("_exact")))
    df = df.withColumn("_exact", F.when(F.col("_twice") & F.col("_spots").isNull(), exact))
    df = df.withColumn("_spots", F.coalesce("_spots", _spots(w, F.lit(None).cast("array<bigint>"), F.col("_exact"))))
    p = F.col("_spots")
    reach = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0), lambda t, x: t + x), F.lit(0)).cast("long"))
    return df.select(*own, F.inline_outer(F.array(F.struct(*MEASURES))))


def holds(rule: Rule) -> Column:
    """Cross-multiplied, so that no ratio is rounded."""
    value, whole = F.col(rule.numerator), F.col(rule.denominator)
    return (whole == 0) | ((value >= F.lit(rule.low) * whole) & (value <= F.lit(rule.high) * whole))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the measures, `base_failed`, `failed_rules` (names in table order) and `kept`."""
    df = measures(df, text)
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~holds(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return df.withColumns({"base_failed": base, "failed_rules": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_report(docs: DataFrame) -> DataFrame:
    """Every document's measures and verdict."""
    judged = judge(docs.select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         F.array_join("failed_rules", ",").alias("failed_rules"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """Documents that pass every rule, with the columns they came with."""
    return keep_rows(docs, judge, "kept")


def _rule_sql(r: Rule) -> str:
    ok = f"({r.denominator} = 0 OR ({r.numerator} >= {r.low}::DOUBLE * {r.denominator} AND {r.numerator} <= {r.high}::DOUBLE * {r.denominator}))"
    return f"CASE WHEN NOT {ok} THEN '{r.name}' END"


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, '{WORD}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM f, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_shouts,
  len(list_filter(w, lambda x: x IN ({', '.join(f"'{x}', '{x.title()}'" for x in STOP_WORDS)}))) AS n_stop_words, len(l) AS n_lines,
  len(l) - len(list_distinct(l)) AS n_dup_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '([.][.][.]|…){SPACE}*$'))) AS n_ellipsis_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM s LEFT JOIN r USING (rid)),
v AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed,
  concat_ws(',', {', '.join(_rule_sql(r) for r in RULES)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v
"""
