"""Quality rules: one threshold table, compiled into one Spark projection. No Python runs on the executors.

Words are ``[^\\x20\\x09-\\x0D]+``. Every rule is a row of ``RULES``: a measure and the least and
most that it may be. ``compile_rules`` turns the table into one boolean column, and a list of the
names of the rules that failed. Null and empty texts have no words, fail the base rule and are not kept.
Repeated rows are judged one by one; columns beside the id and the text are passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from have he in is it not of on or that the this to was were which with you "
    "als am auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nicht noch "
    "nur oder sich sie sind so und von war wie wird zu zum zur "
    "au aux avec ce ces dans de du elle en est et il la le les leur mais ne nous ou par pas pour que qui sa se ses "
    "son sur un une vous "
    "al como con cuando del el entre era esta este ha hasta las lo los más me mi muy no para pero por porque si sin "
    "sobre su también todo una uno ya y"
).split()


@dataclass(frozen=True)
class Rule:
    """``name`` fails where ``measure`` is below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The production table. Ratios are per word or per line with a word.
RULES = (
    Rule("length", "n_words", 50, None),
    Rule("word_length", "mean_word_chars", 2, 12),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("line_repeats", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


#: Bits of a packed window key that hold its place; longer texts sort (window, place) pairs instead.
PLACE_BITS = 20


def _starts(words: Column) -> Column:
    return F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def window_keys(words: Column) -> Column:
    """A long for each three-word window, sorted: a hash above, the place below. Null for texts of over 2**20 words.

    It has to be a column of its own: sorting longs is then compiled code.
    """
    keys = F.transform(
        F.when(F.size(words) <= 1 << PLACE_BITS, _starts(words)),
        lambda w, i: F.shiftleft(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")),
    )
    return F.sort_array(keys)


def repeated_words(words: Column, keys: Column) -> Column:
    """How many words lie in a three-word window that is found twice or more in the array.

    Equal neighbours among the sorted ``window_keys`` are confirmed word by word. If one pair of them differs,
    which two windows of one hash would show, or if there are no keys, the windows themselves are sorted.
    """
    at = lambda k: k.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")

    def neighbours(k: Column) -> Column:
        return F.filter(
            F.transform(k, lambda x, i: F.when(F.shiftright(x.bitwiseXOR(F.get(k, i + 1)), PLACE_BITS) == 0, F.struct(at(x).alias("a"), at(F.get(k, i + 1)).alias("b")))),
            lambda x: x.isNotNull(),
        )

    def confirmed(twins: Column) -> Column:
        sure = F.forall(twins, lambda x: F.forall(F.array(*map(F.lit, range(3))), lambda j: F.get(words, x["a"] + j) == F.get(words, x["b"] + j)))
        return F.when(sure, _let(F.flatten(F.transform(twins, lambda x: F.array(x["a"], x["b"]))), total)).otherwise(by_sorting())

    def by_sorting() -> Column:
        return _let(_let(F.sort_array(pairs), places_of_pairs), total)

    def places_of_pairs(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (x["g"] == F.get(s, i + 1)["g"]) | (x["g"] == F.get(s, i - 1)["g"]))
        return F.transform(again, lambda x: x["i"])

    def total(p: Column) -> Column:
        return F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2))))

    pairs = F.transform(
        _starts(words), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i"))
    )
    return (
        F.when(F.size(words) < 4, F.lit(0))
        .when(keys.isNotNull(), _let(neighbours(keys), confirmed))
        .otherwise(by_sorting())
        .cast("long")
    )


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts and ratios that rules may name. Existing columns of these names are replaced, and no others."""
    part = {}
    for name in ("words", "lines", "keys"):  # columns on the way, by names that the table doesn't have
        part[name] = f"_{name}"
        while part[name] in docs.columns:
            part[name] += "_"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.withColumns(
        {
            part["words"]: F.array_remove(F.split(text, SPACE), ""),
            part["lines"]: F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        }
    )
    split = split.withColumn(part["keys"], window_keys(F.col(part["words"])))
    stops = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    words, lines = F.col(part["words"]), F.col(part["lines"])
    counted = split.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeated_words(words, F.col(part["keys"])),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stops))).cast("long"),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike("^[\\x20\\x09-\\x0D]*[-*•]"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).cast("long"),
        }
    ).drop(*part.values())
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.withColumns(
        {
            "mean_word_chars": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "n_words"),
            "stop_ratio": per("n_stop_words", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
            "bullet_line_ratio": per("n_bullet_lines", "n_lines"),
            "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
        }
    )


def compile_rules(rules=RULES) -> tuple[Column, Column]:
    """(whether all rules hold, the names of those that don't), as columns over ``measures``."""
    broken = []
    for r in rules:
        x, bad = F.col(r.measure), F.lit(False)
        if r.least is not None:
            bad = bad | (x < F.lit(r.least))
        if r.most is not None:
            bad = bad | (x > F.lit(r.most))
        broken.append(F.when(bad, F.lit(r.name)))
    failed = F.array_compact(F.array(*broken))
    return F.size(failed) == 0, failed


def score(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with all measures, ``base_failed``, ``failed_rules`` and ``kept``."""
    holds, failed = compile_rules(rules)
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return (
        measures(docs, text_col)
        .withColumns({"base_failed": base, "failed_rules": failed})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def keep_good(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The rows that pass, with the columns that came in."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text_col).alias("_text"))
    # a filter would be pushed below the measures, and each of them put in where it is used;
    # it stays above a projection that isn't deterministic
    judged = score(inner, rules, "_text").select("_row", "kept", F.rand(0).alias("_stay"))
    return judged.filter(F.col("kept") & (F.col("_stay") >= 0)).select("_row.*")
