"""Quality rules with thresholds that follow the data.

Fixed rules reject what is short or repeats itself. The other limits come from quantile sketches
for each language and source. The sketch is a log-linear histogram: a value in thousandths falls
into a bin whose width is at most 1/32 of the value, and a bin's count is a plain sum, so sketches
of parts, of sources and of languages merge by addition, in any order, with the same result.
Small groups take the sketch of their language, and small languages that of all rows. Where most rows
of a group are above 0 in a measure, the limits lie outside its quartiles; where most are 0, the upper
limit is a multiple of the lower quartile of those above 0, which the worst rows of the group do not
move. Repeated words have the fixed rule alone: it rejects all that a fence so far outside would.

Everything is DataFrame expressions. Nulls: a null text has no words and fails the fixed rules;
a null language or source is a group like any other. Repeated rows count and are judged each.
An empty table gives an empty result. Texts are measured whole, whatever their length. Columns besides
lang, source and text are carried along, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CHARS, materialise, packed, text_or_empty, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Measure:
    """A ratio of two counts, in thousandths, with what the limits need.

    spread is the least distance between the quartiles that counts, and the least lower quartile of
    rows above 0, so that a measure that is nearly constant in a group does not reject every row that differs.
    """

    top: str
    bottom: str
    spread: int
    both: bool = False


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: Fences lie this many quartile distances outside the quartiles.
    reach: int = 6
    #: The limit in a group of mostly zeros, as a multiple of the lower quartile of what is above 0.
    factor: int = 2
    #: Groups of fewer judged rows use the sketch of their language, then of all rows.
    min_rows: int = 50
    measures: dict[str, Measure] = field(default_factory=lambda: {
        "word_len": Measure("word_chars", "n_words", 300, both=True),
        "symbols": Measure("n_symbols", "n_words", 60),
        "dup_lines": Measure("n_dup_lines", "n_lines", 150),
    })


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """row (the document), lang, source, the counts, base_failed.

    n_lines counts lines that hold a word. n_repeat_words counts the words inside 8-word windows
    that occur twice or more in the text; windows are compared by 64-bit hash.
    """
    text = text_or_empty("row.text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    df = packed(docs).select(
        "row",
        words(text).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.size("w")
    df = df.select(
        "row", F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols",
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    n = F.size("h")
    df = df.withColumn("h", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)])
    )).otherwise(F.array().cast("array<long>")))
    # only texts with a repeated window pay for the sort
    df = df.withColumn("h", F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    ))
    twice = F.filter("h", lambda x, i: (x.h == F.get("h", i - 1).h) | (x.h == F.get("h", i + 1).h))
    df = df.withColumn("at", F.sort_array(F.transform(twice, lambda x: x.i)))
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a.n + F.least(F.lit(WINDOW), i - a.last)).alias("n"), i.alias("last")),
        lambda a: a.n,
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return df.select("row", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), *COUNTS,
                     failed.alias("base_failed"))


def _value(m: Measure) -> Column:
    return F.floor(1000 * F.col(m.top) / F.col(m.bottom)).cast("long")


def _bin(v: Column) -> Column:
    """The lower edge of v's bin: v with all but its six leading binary digits cleared."""
    drop = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketch(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """lang, source, measure, edge, n: the sketches, one row for each bin that is in use.

    Give it a stored table: a filter on base_failed that moves below measure() repeats its work.
    """
    values = F.array(*[
        F.struct(F.lit(name).alias("measure"), _bin(_value(m)).alias("edge")) for name, m in rules.measures.items()])
    return (measured.filter(~F.col("base_failed"))
            .select("lang", "source", F.explode(values).alias("v"))
            .groupBy("lang", "source", "v.measure", "v.edge").agg(F.count("*").alias("n")))


def thresholds(sketches: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """lang, source and a lower and upper limit (lo_x, hi_x) for each measure x."""

    def limits(level: list[str], name: str) -> DataFrame:
        merged = sketches.groupBy(*level, "measure", "edge").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*level, "measure")
        ranked = merged.select("*", F.sum("n").over(w).alias("all"),
                               F.sum("n").over(w.orderBy("edge")).alias("upto"),
                               F.sum(F.when(F.col("edge") == 0, F.col("n")).otherwise(0)).over(w).alias("zeros"))
        some = F.min(F.when((F.col("edge") > 0) & ((F.col("upto") - F.col("zeros")) * 4 >= F.col("all") - F.col("zeros")), F.col("edge"))).alias("p1")
        quartile = [F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("edge"))).alias(f"q{q}") for q in (1, 3)]
        each = ranked.groupBy(*level, "measure").agg(F.max("all").alias("all"), F.max("zeros").alias("zeros"), some, *quartile)
        out = []
        for x, m in rules.measures.items():
            mine, far = F.col("measure") == x, rules.reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(m.spread))
            rare = rules.factor * F.greatest(F.col("p1"), F.lit(m.spread))
            high = F.when(F.col("zeros") * 2 > F.col("all"), rare).otherwise(F.col("q3") + far)
            out += [F.max(F.when(mine, F.col("q1") - far if m.both else F.lit(None).cast("long"))).alias(f"lo_{x}"),
                    F.max(F.when(mine, high)).alias(f"hi_{x}")]
        wide = each.groupBy(*level).agg(F.max("all").alias("rows"), *out)
        names = [f"{side}_{x}" for x in rules.measures for side in ("lo", "hi")]
        return wide.select(*[F.col(c).alias(f"{name}_{c}") for c in level],
                           F.struct("rows", *names).alias(name))

    groups = sketches.select("lang", "source", F.lit(1).alias("one")).distinct()
    own, lang = limits(["lang", "source"], "own"), limits(["lang"], "by")
    sketches = sketches.withColumn("one", F.lit(1))
    total = limits(["one"], "total")
    joined = (groups
              .join(own, F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source")), "left")
              .join(lang, F.col("lang").eqNullSafe(F.col("by_lang")), "left")
              .join(total, F.col("one") == F.col("total_one"), "left"))
    enough = lambda c: F.col(f"{c}.rows") >= rules.min_rows
    best = F.when(enough("own"), F.col("own")).when(enough("by"), F.col("by")).otherwise(F.col("total"))
    return joined.select("lang", "source", best.alias("limits")).select("lang", "source", "limits.*")


def judge(measured: DataFrame, limits: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """measured with kept: false where base_failed, else whether all measures lie within the limits."""
    lim = limits.select(F.col("lang").alias("lim_lang"), F.col("source").alias("lim_source"),
                        *[c for c in limits.columns if c[:3] in ("lo_", "hi_")])
    within = F.lit(True)
    for x, m in rules.measures.items():
        v = _value(m)
        within &= F.coalesce(v <= F.col(f"hi_{x}"), F.lit(True))
        if m.both:
            within &= F.coalesce(v >= F.col(f"lo_{x}"), F.lit(True))
    joined = measured.join(lim, F.col("lang").eqNullSafe(F.col("lim_lang"))
                           & F.col("source").eqNullSafe(F.col("lim_source")), "left")
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(within)
    return joined.select(*measured.columns, kept.alias("kept"))


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their columns as they were.

    Texts are measured once and stored with their measures, so no text is shuffled; the limits, one row
    for each language and source, are stored too, so that the planner knows their size and broadcasts
    them if they are small.
    """
    measured = materialise(measure(docs, rules), "quality")
    limits = materialise(thresholds(sketch(measured, rules), rules), "quality-limits")
    return judge(measured, limits, rules).filter("kept").select("row.*")
