"""Quality rules: a threshold table compiled into one projection.

Everything here is a column expression. Measures come from the text by regular expressions and array functions; each row of
the threshold table then becomes one comparison, and the verdict is their conjunction, so Spark evaluates the whole table in
the projection that reads the text. Nothing is shuffled and no row depends on another.

Null texts count as empty. Empty texts have no words: every measure is 0 and the base rule (at least 50 words) rejects them.
Rows that repeat are judged one by one. Measures of a text are linear in its length but for one sort of its windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from slidegrid.llm.words import BLANKS, let, whole_text, words_of

#: Common function words; fixed values.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was as be with by this are or from at an not have",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus pas ne se ce il",
    "es": "de la que el en y los se del las un por con no una su para es al lo como más o pero",
}


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [low, high]; None leaves a side open. A measure that is null passes."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The default table. Ratios are per word or per line with a word.
RULES = (
    Rule("mean_word_chars", 2.0, 25.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
)


def measured(docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] | None = None, prefix: str = "") -> DataFrame:
    """Adds the counts of every text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words.

    The counts are computed once: their projection holds a term that the optimizer must not move (always true), or else a
    filter on a verdict would be pushed to the scan with all measures written out again for every rule.

    ``prefix`` keeps the new names apart from columns that the input has. Columns whose names begin with ``__q_`` are used on
    the way and dropped.
    """
    stop = stop_words or tuple(sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
    text_of = F.col("__q_text")
    split = docs.withColumn("__q_text", whole_text(text)).withColumn("__q_words", words_of(text_of)).withColumn(
        "__q_lines", F.filter(F.split(text_of, "\n"), lambda line: F.length(F.regexp_replace(line, BLANKS, "")) > 0)
    )
    words, lines, marks = F.col("__q_words"), F.col("__q_lines"), F.col("__q_windows")
    n = F.size(words)
    windows = F.when(
        n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    long_of = {
        "n_words": F.when(F.spark_partition_id() >= 0, n),
        "word_chars": F.length(F.regexp_replace(text_of, BLANKS, "")),
        "n_symbols": F.length(F.regexp_replace(text_of, r"[^#*$%&|<>]+", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated(marks),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*stop))),
    }
    return (
        split.withColumn("__q_windows", windows)
        .withColumns({prefix + k: v.cast("long") for k, v in long_of.items()})
        .drop("__q_text", "__q_words", "__q_lines", "__q_windows")
    )


def _repeated(windows: Column) -> Column:
    """Words covered by windows that occur twice or more: such windows stand side by side once sorted."""
    at = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x.h == F.get(s, k).h, F.lit(False))
        twice = F.filter(s, lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))

    none = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(none, F.lit(0)).otherwise(let(F.sort_array(at), covered))


def ratios(prefix: str = "") -> dict[str, Column]:
    """The measures a rule may name, from the counts; null where there is nothing to divide by."""
    c = lambda k: F.col(prefix + k)
    per = lambda a, b: F.try_divide(c(a).cast("double"), c(b).cast("double"))
    return {
        **{k: c(k).cast("double") for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")},
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
    }


def base_failed(prefix: str = "") -> Column:
    n, again = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * again > 50 * n)


def passes(rules: tuple[Rule, ...] = RULES, prefix: str = "") -> Column:
    """The threshold table as one boolean expression."""
    have = ratios(prefix)
    verdict = F.lit(True)
    for rule in rules:
        value = have[rule.measure]
        if rule.low is not None:
            verdict = verdict & F.coalesce(value >= rule.low, F.lit(True))
        if rule.high is not None:
            verdict = verdict & F.coalesce(value <= rule.high, F.lit(True))
    return verdict


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """``docs`` with all counts, ``base_failed`` and ``kept``."""
    return measured(docs, text, prefix=prefix).withColumn(prefix + "base_failed", base_failed(prefix)).withColumn(
        prefix + "kept", ~F.col(prefix + "base_failed") & passes(rules, prefix)
    )


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its own columns."""
    return judge(docs, text, rules, "__kept_").where(F.col("__kept_kept")).select(*docs.columns)
