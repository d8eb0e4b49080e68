"""Quality rules: one table of thresholds, compiled into one projection.

``measures`` computes a text's counts, ``RULES`` bounds ratios of them, and
``apply_rules`` turns the table into column expressions: no user function runs
and nothing is shuffled, so the scan, the counts and the verdict are one stage.

Defined results: a null or empty text has no words, all counts are 0 and it
fails for its length; rows are judged one by one, so repeated rows and ties get
the same verdict each; an empty table gives an empty result; a column of the
input named like a result column gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginspark.llm.columns import boxed, let, unboxed, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window whose second occurrence makes it a repeat.
WINDOW = 5
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "als auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux avec ce dans de des du elle en est et la le les par pas pour que qui sur un une "
    "al con del el es la las los no para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * count / base <= high``, a bound that is None is open.
    With ``base`` None the count itself is bounded."""

    name: str
    count: str
    base: str | None
    low: float | None = None
    high: float | None = None
    #: The rule is asked only of texts with at least so many words.
    from_words: int = 0

    def holds(self, measure) -> Column:
        value = F.lit(100) * measure(self.count) if self.base else measure(self.count)
        unit = measure(self.base) if self.base else F.lit(1)
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & (value >= F.lit(self.low) * unit)
        if self.high is not None:
            inside = inside & (value <= F.lit(self.high) * unit)
        return inside | (measure("n_words") < self.from_words)


#: Length, word form, symbols, lines, case and function words.
RULES = (
    Rule("few_words", "n_words", None, low=10),
    Rule("repeats", "n_repeat_words", "n_words", high=20),
    Rule("short_words", "word_chars", "n_words", low=250),
    Rule("long_words", "word_chars", "n_words", high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("shouting", "n_upper", "word_chars", high=50),
    Rule("exclaiming", "n_exclaims", "n_words", high=30),
    Rule("same_lines", "n_dup_lines", "n_lines", high=40),
    Rule("function_words", "n_stop", "n_words", low=2, from_words=50),
)
#: Rules whose failure is also told apart as ``base_failed``.
BASE_RULES = ("few_words", "repeats")
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_upper", "n_exclaims",
    "n_lines", "n_dup_lines", "n_stop", "n_repeat_words",
)


def _windows(w: Column, size: Column) -> Column:
    """The windows of a word list as strings; words hold no blank, so the
    joined string tells windows apart exactly."""
    return F.transform(
        F.sequence(F.lit(0), size - WINDOW),
        lambda i: F.concat_ws(" ", F.slice(w, i + 1, WINDOW)),
    )


def _covered(grams: Column) -> Column:
    """Words inside windows found twice or more: equal windows are neighbours
    in sorted order; their starts, sorted again, are added up without overlap."""

    def starts(found: Column) -> Column:
        near = lambda k: F.coalesce(F.get(found, k)["g"], F.lit(""))
        twice = F.filter(
            found, lambda x, k: (near(k - 1) == x["g"]) | (near(k + 1) == x["g"])
        )
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    found = F.array_sort(
        F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    )
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        let(found, starts),
        empty,
        lambda a, i: F.struct(
            (a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n"),
            (i + WINDOW).alias("end"),
        ),
        lambda a: a["n"],
    )


def _repeat_words(w: Column) -> Column:
    """Most texts repeat no window: equal hashes are looked for first, and only
    texts that have some compare the windows themselves."""
    size = F.size(w)
    hashes = F.transform(
        F.sequence(F.lit(0), size - WINDOW),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
    )
    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return (
        F.when(size <= WINDOW, F.lit(0))
        .when(~repeats, F.lit(0))
        .otherwise(let(_windows(w, size), _covered))
    )


def measures(text: Column) -> Column:
    """All counts of a text as one struct of longs named by :data:`MEASURES`."""
    known = F.coalesce(text, F.lit(""))
    upper = F.length(F.regexp_replace(known, r"\P{Lu}+", ""))
    lines = F.filter(F.split(known, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))

    def over_words(w: Column) -> Column:
        lowered = F.transform(w, F.lower)
        counts = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.length(known) - F.length(F.translate(known, SYMBOLS, "")),
            "n_upper": upper,
            "n_exclaims": F.length(known) - F.length(F.translate(known, "!", "")),
            "n_stop": F.size(F.filter(lowered, lambda x: x.isin(STOP_WORDS))),
            "n_repeat_words": _repeat_words(w),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in counts.items()])

    def over_lines(s: Column) -> Column:
        size = F.size(s)
        return F.struct(
            size.cast("long").alias("n_lines"),
            (size - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        )

    return F.struct(
        let(words(text), over_words).alias("w"), let(lines, over_lines).alias("l")
    )


def judge(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Measures and verdict of a text as one struct: the measures,
    ``failed`` (names of the rules broken, in table order), ``base_failed`` and
    ``kept``.  The text is measured once, also where only the verdict is used."""

    def verdict(m: Column) -> Column:
        of_lines = ("n_lines", "n_dup_lines")
        measure = lambda name: m["l" if name in of_lines else "w"][name]
        broken = {r.name: ~r.holds(measure) for r in rules}
        base, good = F.lit(False), F.lit(True)
        for name, b in broken.items():
            good = good & ~b
            base = base | b if name in BASE_RULES else base
        failed = F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in broken.items()]))
        return F.struct(
            *[measure(name).alias(name) for name in MEASURES],
            failed.alias("failed"),
            base.alias("base_failed"),
            good.alias("kept"),
        )

    return let(measures(text), verdict)


def apply_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text"
) -> DataFrame:
    """``docs`` with the fields of :func:`judge`."""
    made = (*MEASURES, "failed", "base_failed", "kept")
    judged = docs.select(
        boxed(docs, *made).alias("doc"), judge(docs[f"`{text}`"], rules).alias("q")
    )
    return judged.select(*unboxed(judged, "doc"), "q.*")


def keep_good(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text"
) -> DataFrame:
    """The rows that break no rule, with the columns of ``docs``."""
    return docs.where(judge(docs[f"`{text}`"], rules)["kept"])
