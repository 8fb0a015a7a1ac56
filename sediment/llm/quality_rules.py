"""Quality rules: a threshold table compiled into one Spark projection.

Each rule bounds one ratio of counts. ``rule_columns`` turns the table into plain Catalyst expressions over the
text; no user function runs and nothing is shuffled, so the plan is a scan, a projection and a filter.

Defined results:

* a null, empty or blank text has no words; it fails ``min_words`` and is rejected;
* a rule with a minimum of words doesn't apply to shorter texts, so short clean texts stay;
* a rule for some languages applies to rows whose ``lang`` names one of those, and to no row where it is null or missing;
* a ratio that equals its bound passes;
* very long texts are measured whole;
* equal rows get equal results and each stays a row; an empty table gives an empty result;
* extra columns of the input are kept by ``keep_good`` and ignored by ``score``, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    name: str
    over: str  #: numerator, a counted quantity
    under: str  #: denominator, a counted quantity or "one"
    sign: str  #: ">=" or "<=": how the ratio must compare with the bound
    bound: float
    least_words: int  #: the rule applies from so many words on
    langs: tuple[str, ...] = ()  #: and in these languages, or in all


#: Words so common that running prose in ``STOP_LANGS`` can hardly do without them.
STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in is that it for as was with be by on are this an at from or not a have has he she they we you"
            " de la le les des et en un une du que qui est pour dans par sur au aux pas ne ce il elle ou"
            " der die das und den dem ein eine ist im von zu mit auf für nicht sich als auch"
            " el los las y del por con para se su al lo no una es".split()
        )
    )
)

STOP_LANGS = ("en", "fr", "de", "es")
SYMBOLS = r"[#$%&*|<>{}~^=\\!]"

#: The production table.
RULES = (
    Rule("min_words", "words", "one", ">=", 1, 0),
    Rule("max_word_chars", "word_chars", "words", "<=", 24, 1),
    Rule("symbols", "symbols", "chars", "<=", 0.04, 1),
    Rule("stop_words", "stops", "words", ">=", 0.02, 60, STOP_LANGS),
    Rule("repeated_words", "repeats", "words", "<=", 0.25, 4),
    Rule("repeated_lines", "repeated_lines", "lines", "<=", 0.5, 1),
    Rule("bullet_lines", "bullets", "lines", "<=", 0.9, 1),
    Rule("ellipsis_lines", "ellipses", "lines", "<=", 0.3, 1),
)

COUNTS = ("chars", "words", "word_chars", "symbols", "stops", "repeats", "lines", "repeated_lines", "bullets", "ellipses")


def _counts(text: Column) -> Column:
    """All counts of a text as one struct."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[ \t\r\n]+"), lambda w: w != "")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != "")
    bare = F.split(F.lower(F.regexp_replace(text, r"[.,;:!?\"()]", "")), "[ \t\r\n]+")

    def of(c: Column) -> dict[str, Column]:
        w, x = c["w"], c["x"]
        return {
            "chars": F.length(text),
            "words": F.size(w),
            "word_chars": F.length(F.regexp_replace(text, "[ \t\r\n]+", "")),
            "symbols": F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")),
            "stops": F.size(F.filter(bare, lambda v: v.isin(*STOP_WORDS))),
            # pairs of equal neighbours; a lambda over the zipped array reads each word once, an index lookup doesn't
            "repeats": F.size(F.filter(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: a == b), lambda same: same)),
            "lines": F.size(x),
            "repeated_lines": F.size(x) - F.size(F.array_distinct(x)),
            "bullets": F.size(F.filter(x, lambda v: v.rlike("^[-*•] "))),
            "ellipses": F.size(F.filter(x, lambda v: v.endswith("...") | v.endswith("…"))),
        }

    # transform over a one-element array binds the words and lines once instead of once per count
    bound = F.transform(F.array(F.struct(words.alias("w"), lines.alias("x"))), lambda c: F.struct(*[v.cast("long").alias(k) for k, v in of(c).items()]))
    return bound[0]


def _lang(docs: DataFrame) -> Column:
    at = {c.lower(): c for c in docs.columns}
    return docs[at["lang"]] if "lang" in at else F.lit(None).cast("string")


def _failed(counts: Column, rules: tuple[Rule, ...], lang: Column) -> Column:
    def fails(r: Rule) -> Column:
        over = counts[r.over].cast("double")
        bound = F.lit(float(r.bound)) * (F.lit(1.0) if r.under == "one" else counts[r.under].cast("double"))
        wrong = over < bound if r.sign == ">=" else over > bound
        applies = counts["words"] >= r.least_words
        return F.when(wrong & (applies & lang.isin(*r.langs) if r.langs else applies), F.lit(r.name))

    return F.concat_ws(",", *[fails(r) for r in rules])


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, every count, the failed rules in the table's order, and ``keep``: one row for each input row."""
    counted = docs.select("doc_id", _lang(docs).alias("lang"), _counts(F.col("text")).alias("c"))
    named = counted.select("doc_id", *[F.col(f"c.{k}").alias(f"n_{k}") for k in COUNTS], _failed(F.col("c"), rules, F.col("lang")).alias("failed"))
    return named.withColumn("keep", F.col("failed") == "")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    return docs.where(_failed(_counts(F.col("text")), rules, _lang(docs)) == "")


def score_sql(docs: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL."""
    stops = ", ".join("'" + w + "'" for w in STOP_WORDS)

    def fails(r: Rule) -> str:
        bound = f"{float(r.bound)!r}::DOUBLE" + ("" if r.under == "one" else f" * n_{r.under}::DOUBLE")
        langs = f" AND lang IN ({', '.join(repr(x) for x in r.langs)})" if r.langs else ""
        return f"CASE WHEN n_{r.over}::DOUBLE {'<' if r.sign == '>=' else '>'} {bound} AND n_words >= {r.least_words}{langs} THEN '{r.name}' END"

    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM {docs}),
s AS (SELECT doc_id, lang, text,
    list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '') AS w,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS x,
    regexp_split_to_array(lower(regexp_replace(text, '[.,;:!?"()]', '', 'g')), '[ \\t\\r\\n]+') AS b FROM t),
c AS (SELECT doc_id, lang, length(text)::BIGINT AS n_chars, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[ \\t\\r\\n]+', '', 'g'))::BIGINT AS n_word_chars,
    (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
    len(list_filter(b, lambda v: v IN ({stops})))::BIGINT AS n_stops,
    len(list_filter(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: p[1] = p[2]))::BIGINT AS n_repeats,
    len(x)::BIGINT AS n_lines, (len(x) - len(list_distinct(x)))::BIGINT AS n_repeated_lines,
    len(list_filter(x, lambda v: regexp_matches(v, '^[-*•] ')))::BIGINT AS n_bullets,
    len(list_filter(x, lambda v: ends_with(v, '...') OR ends_with(v, '…')))::BIGINT AS n_ellipses FROM s),
f AS (SELECT *, concat_ws(',', {', '.join(map(fails, rules))}) AS failed FROM c)
SELECT * EXCLUDE (lang), failed = '' AS keep FROM f"""
