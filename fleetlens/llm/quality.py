"""Quality rules: a table of thresholds, compiled into one projection without user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import GAP_CHARS, kept_text, word_array

#: Frequent words of the languages, in lower case.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "with", "was", "it", "this", "are", "from", "have"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "von", "zu", "mit", "ein", "eine", "auf", "im", "den", "des"],
    "fr": ["le", "la", "les", "et", "de", "des", "un", "une", "est", "que", "qui", "dans", "pour", "du", "en", "sur"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "es", "por", "con", "para", "del", "se"],
}
ALL_STOP_WORDS = sorted({word for words in STOP_WORDS.values() for word in words})
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
#: Low bits of a sorted window that hold its position; the others hold its hash.
POSITION_BITS = 20
#: Of a word, what may follow a stop word.
STOPS = ".,;:!?"
_GAP1 = r"[\x20\x09-\x0D]"
#: The gap is part of the match: a pattern that begins with one character of few is refused sooner than a look behind.
_WORD_BEGINS = r"(?:\A|[\x20\x09-\x0D])"
_WORD_ENDS = r"(?![^\x20\x09-\x0D])"


@dataclass(frozen=True)
class Rule:
    """Holds while ``low <= 100 * part / whole <= high``; None leaves that side open."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def failed(self) -> Column:
        part, whole = 100 * F.col(self.part), F.col(self.whole)
        sides = [part < self.low * whole] if self.low is not None else []
        sides += [part > self.high * whole] if self.high is not None else []
        return reduce(lambda a, b: a | b, sides)


#: What must hold before any other rule counts.
BASE_RULES = [
    Rule("few_words", "n_words", "one", low=5000),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=50),
]
RULES = [
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=1),
    Rule("words_without_letter", "n_plain_words", "n_words", high=30),
    Rule("capitals", "n_upper", "word_chars", high=30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30),
]
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_plain_words", "n_upper",
    "n_lines", "n_bullet_lines", "n_ellipsis_lines",
]


def _with_sorted_windows(rows: DataFrame) -> DataFrame:
    """Adds ``__sorted``: for every window of ``__words`` its hash and, in the low bits, its position, sorted."""
    word = F.col("__hashes")
    starts = F.sequence(F.lit(0), F.size("__words") - WINDOW)
    packed = F.transform(
        starts,
        lambda i: F.shiftleft(F.xxhash64(*(F.get(word, i + k) for k in range(WINDOW))), POSITION_BITS).bitwiseOR(i.cast("long")),
    )
    rows = rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    some = (F.size("__words") >= WINDOW) & (F.size("__words") < 1 << POSITION_BITS)
    return rows.withColumn("__sorted", F.sort_array(F.when(some, packed).otherwise(F.array().cast("array<bigint>"))))


def _repeated_words(words: Column, s: Column) -> Column:
    """How many words lie in a window of three words that the text has twice or more.

    Neighbours in ``s`` with equal hashes are compared as words. Should two different windows share a hash,
    or a text be too long for the packed positions, its windows are sorted as text instead.
    """
    n, mask = F.size(s), (1 << POSITION_BITS) - 1
    none = F.array().cast("array<int>")

    def at(packed: Column) -> Column:
        return (packed.bitwiseAND(F.lit(mask)) + 1).cast("int")

    def window(i: Column) -> Column:
        return F.slice(words, i, WINDOW)

    def width(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*(i + k for k in range(WINDOW)))))))

    def once(value: Column, f: Callable[[Column], Column]) -> Column:
        """f(value), with the value bound to a name, so that it is computed once however often f names it."""
        return F.transform(F.array(value), f)[0]

    def in_text_order() -> Column:
        def paired(w: Column) -> Column:
            m = F.size(w) - 1
            same = F.zip_with(
                F.slice(w, 1, m),
                F.slice(w, 2, m),
                lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(none),
            )
            return width(F.flatten(same))

        starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
        return once(F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("g"), i.alias("i")))), paired)

    def counted(twins: Column) -> Column:
        clash = F.exists(twins, lambda x: window(x[0]) != window(x[1]))
        return F.when(clash, in_text_order()).otherwise(width(F.flatten(twins)))

    twins = F.filter(
        F.zip_with(
            F.slice(s, 1, n - 1),
            F.slice(s, 2, n - 1),
            lambda a, b: F.when(a.bitwiseXOR(b).between(0, mask), F.array(at(a), at(b))),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        F.when(F.size(words) <= WINDOW, 0)
        .when(F.size(words) >= 1 << POSITION_BITS, in_text_order())
        .otherwise(once(twins, counted))
    )


def measured(docs: DataFrame, carried: list[str], text: str = "text") -> DataFrame:
    """The ``carried`` columns and the counts that rules compare; a null text counts as an empty one."""
    t, lines = F.col("__t"), F.col("__lines")
    rows = docs.select(*carried, kept_text(text).alias("__t"))
    rows = rows.withColumn("__words", word_array(t)).withColumn(
        "__lines", F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(GAP_CHARS)) != "")
    )
    rows = _with_sorted_windows(rows).withColumn("n_words", F.size("__words").cast("long"))

    def found(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern))

    def lines_like(pattern: str) -> Column:
        return F.size(F.filter(lines, lambda x: x.rlike(pattern)))

    by_initial = {w[0]: [x[1:] for x in ALL_STOP_WORDS if x[0] == w[0]] for w in ALL_STOP_WORDS}
    any_stop_word = "|".join(f"[{c}{c.upper()}](?i:{'|'.join(rest)})" for c, rest in by_initial.items())
    stop_word = f"{_WORD_BEGINS}(?:{any_stop_word})[{STOPS}]*{_WORD_ENDS}"
    counts = {
        "word_chars": F.char_length(t) - found(_GAP1),
        "n_symbols": found(SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated_words(F.col("__words"), F.col("__sorted")),
        "n_stop_words": found(stop_word),
        "n_plain_words": found(_WORD_BEGINS + r"[^\x20\x09-\x0D\p{L}]++" + _WORD_ENDS),
        "n_upper": found(r"\p{Lu}"),
        "n_lines": F.size(lines),
        "n_bullet_lines": lines_like(r"^[ \t]*[-*•]"),
        "n_ellipsis_lines": lines_like(r"(?:\.\.\.|…)[ \t\r]*\z"),
    }
    return rows.select(*carried, "n_words", *(c.cast("long").alias(n) for n, c in counts.items()))


def judged(counts: DataFrame, base: list[Rule] = BASE_RULES, rules: list[Rule] = RULES) -> DataFrame:
    """Adds ``base_failed``, ``failed`` (names of all failed rules, as listed) and ``kept``."""
    rows = counts.withColumn("one", F.lit(1).cast("long"))
    names = F.array(*(F.when(r.failed(), F.lit(r.name)) for r in [*base, *rules]))
    rows = rows.withColumns(
        {
            "base_failed": reduce(lambda a, b: a | b, (r.failed() for r in base)),
            "failed": F.filter(names, lambda n: n.isNotNull()),
        }
    )
    return rows.withColumn("kept", F.size("failed") == 0).drop("one")


def quality_rules(
    docs: DataFrame,
    carried: list[str] | None = None,
    text: str = "text",
    base: list[Rule] = BASE_RULES,
    rules: list[Rule] = RULES,
) -> DataFrame:
    """One row per row of ``docs``: the ``carried`` columns (``doc_id`` unless given), counts and verdict.

    Null and empty texts have no words and fail. Ids may be null or repeated: every row is judged by itself.
    Columns that are not carried are not read; a carried column must not bear the name of a count.
    """
    carried = ["doc_id"] if carried is None else carried
    clash = set(carried) & {*COUNTS, "one", "base_failed", "failed", "kept"}
    if clash:
        raise ValueError(f"carried columns with the name of a result: {sorted(clash)}")
    return judged(measured(docs, carried, text), base, rules)


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their columns unchanged."""
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"),
        F.col(f"`{text}`").alias("__text"),
    )
    # a filter that moves below a projection takes copies of its expressions along, here copies of copies; it
    # does not move below a row number
    counts = measured(whole, ["__row"], "__text").withColumn("__number", F.monotonically_increasing_id())
    return judged(counts).where("kept and __number >= 0").select("__row.*")


