"""Quality rules whose cutoffs are learned: fences from mergeable quantile sketches for each language and source.

Every text is measured by its own words and lines. A sketch counts the values of a measure in buckets of a fixed relative width,
so sketches of parts are merged by adding counts: tasks' into groups', groups' into languages', languages' into the
whole corpus's. Quartiles read from a sketch are within RELATIVE of the exact ones at any size. A group's fences lie three
interquartile ranges outside its quartiles. Where the quartiles are equal (most texts have no repeat), the upper fence lies as far outside
the quartiles of the values above them. Texts that another measure's quartiles refuse are of another kind, and do not count for that
spread: sketches are made twice, the second time without them. A measure's gap is the fence's distance from the median only where the data
has no spread at any level.
A group takes its language's fence of a measure if it has too few texts, or equal quartiles and too few values above; a language
likewise takes the corpus's. Texts are then joined with their group's fences and filtered.

All of it is DataFrame operations. Sketches and fences have a few rows for each group; the texts' side of the join has only counts.

Words are `[^\\x20\\x09-\\x0D]+`. Defined results: a null text has no word, as an empty one. Language and source that are null count as
empty. Repeated rows are measured and counted each. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.tables import stored

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50
RELATIVE = 0.01
LEAST_ROWS = 200
REACH = 3.0
#: Values above equal quartiles that are enough for a spread of their own, and the least share of all values.
LEAST_TAIL = 50
TAIL_SHARE = 0.02
#: Measure: (distance of the upper fence from the median where the data sets none, the same of the lower fence or None).
GAPS = {"symbol_share": (0.05, None), "dup_share": (0.5, None), "repeat_share": (0.3, None), "word_length": (3.0, 3.0)}
ZERO = -(1 << 30)
_FENCE = {"rows": "long"} | {f"{side}_{m}": "double" for m in GAPS for side in ("low", "high")}
#: spread_: the quartiles differ; set_: the upper fence is the data's and not a gap.
_FENCE |= {f"{flag}_{m}": "boolean" for m in GAPS for flag in ("spread", "set")}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text. Arrays stand in columns of their own, so that each is made once."""
    text = F.coalesce("text", F.lit(""))
    keys = [F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")]
    held = ["doc_id", "lang", "source"]
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    parts = docs.select(
        *keys,
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        lines.alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).alias("n_symbols"),
    )
    counted = parts.select(
        *held,
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
    )
    numbers = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    hashes = F.col("hashes")
    window = F.transform("hashes", lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    # Cutting off the last two, which have no three words, also covers texts of fewer words.
    windows = counted.select(*held, *numbers, F.slice(window, 1, F.greatest(F.col("n_words") - 2, F.lit(0))).alias("windows"))
    distinct = F.size(F.array_distinct("windows"))
    placed = F.when(distinct < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = windows.select(*held, *numbers, placed.alias("placed"))
    placed = F.col("placed")
    twice = F.filter(placed, lambda p, i: (p.h == F.get(placed, i - 1).h) | (p.h == F.get(placed, i + 1).h))
    found = ordered.select(*held, *numbers, twice.alias("twice"))
    covered = F.flatten(F.transform("twice", lambda p: F.array(p.i, p.i + 1, p.i + 2)))
    repeats = F.when(F.col("twice").isNull(), 0).otherwise(F.size(F.array_distinct(covered)))
    return found.select(*held, *(F.col(n).cast("long") for n in numbers), repeats.cast("long").alias("n_repeat_words"))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def with_shares(counts: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumns(
        {
            "base_failed": failed,
            "symbol_share": _share("n_symbols", "word_chars"),
            "dup_share": _share("n_dup_lines", "n_lines"),
            "repeat_share": _share("n_repeat_words", "n_words"),
            "word_length": _share("word_chars", "n_words"),
        }
    )


def bucket_of(value: Column, relative: float = RELATIVE) -> Column:
    """Number of the bucket: values in one differ by a factor of (1 + r) / (1 - r) at most; zero has its own."""
    gamma = math.log((1 + relative) / (1 - relative))
    return F.when(value <= 0, ZERO).otherwise(F.ceil(F.log(value) / gamma)).cast("int")


def bucket_value(bucket: Column, relative: float = RELATIVE) -> Column:
    """The value within `relative` of all in the bucket."""
    gamma = (1 + relative) / (1 - relative)
    return F.when(bucket == ZERO, 0.0).otherwise(2 * F.pow(F.lit(gamma), bucket) / (gamma + 1))


def sketch(values: DataFrame, keys: list[str]) -> DataFrame:
    """Counts n by keys, measure and bucket; null values are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket_of(F.col(m)).alias("bucket")) for m in GAPS)))
    rows = values.select(*keys, pairs.alias("p")).select(*keys, "p.measure", "p.bucket")
    return rows.where(F.col("bucket").isNotNull()).groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of all rows that share the keys as one."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: rows, and low_/high_ of every measure."""
    whole = Window.partitionBy(*keys, "measure")
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketches.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(upto)})
    reached = F.col("upto") > F.floor((F.col("total") - 1) * 0.5)
    # The texts up to the median's bucket; those above it are the tail.
    ranked = ranked.withColumn("base", F.min(F.when(reached, F.col("upto"))).over(whole))
    tail = F.col("total") - F.col("base")

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * q), bucket_value(F.col("bucket"))))

    def tail_quantile(q: float) -> Column:
        above = F.col("upto") - F.col("base")
        return F.min(F.when((above > 0) & (above > F.floor((tail - 1) * q)), bucket_value(F.col("bucket"))))

    def of(measure: str, name: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(name))).alias(f"{measure}_{name}")

    by_measure = ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        F.max(tail).alias("tail"),
        *(quantile(q / 100).alias(f"q{q}") for q in (25, 50, 75)),
        *(tail_quantile(q / 100).alias(f"t{q}") for q in (25, 75)),
    )
    names = ("total", "tail", "q25", "q50", "q75", "t25", "t75")
    wide = by_measure.groupBy(*keys).agg(F.max("total").alias("rows"), *(of(m, n) for m in GAPS for n in names))
    bounds = {}
    for measure, (up, down) in GAPS.items():
        total, n_tail, low, mid, high, t25, t75 = (F.col(f"{measure}_{n}") for n in names)
        spread = F.coalesce(high > low, F.lit(False))
        tailed = F.coalesce((n_tail >= LEAST_TAIL) & (n_tail >= TAIL_SHARE * total), F.lit(False))
        beyond = F.when(spread, high + REACH * (high - low)).when(tailed, t75 + REACH * (t75 - t25))
        bounds[f"high_{measure}"] = F.coalesce(beyond, mid + up)
        below = F.when(spread, low - REACH * (high - low)).otherwise(mid - down) if down else F.lit(None)
        bounds[f"low_{measure}"] = below.cast("double")
        bounds[f"spread_{measure}"] = spread
        bounds[f"set_{measure}"] = spread | tailed
    return wide.select(*keys, "rows", *(c.alias(name) for name, c in bounds.items()))


def group_fences(sketches: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """low_, high_, spread_ and set_ of every measure that hold for each language and source: its own, its language's or the corpus's."""

    def named(level: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
        return level.select(*keys, F.struct(*_FENCE).alias(prefix))

    by_source = named(fences(sketches, ["lang", "source"]), "own", ["lang", "source"])
    by_lang = named(fences(merge(sketches, ["lang"]), ["lang"]), "language", ["lang"])
    # The corpus has one row, whose numbers become constants; no row if nothing was sound.
    corpus = fences(merge(sketches.withColumn("corpus", F.lit(1)), ["corpus"]), ["corpus"]).first()
    overall = F.struct(*(F.lit(corpus[n] if corpus else None).cast(t).alias(n) for n, t in _FENCE.items()))
    found = by_source.join(by_lang, "lang").withColumn("overall", overall)

    def chosen(measure: str, name: str) -> Column:
        levels = F
        for level in ("own", "language"):
            enough = (F.col(f"{level}.rows") >= least_rows) & F.col(f"{level}.set_{measure}")
            levels = levels.when(enough, F.col(f"{level}.{name}_{measure}"))
        return levels.otherwise(F.col(f"overall.{name}_{measure}")).alias(f"{name}_{measure}")

    return found.select("lang", "source", *(chosen(m, name) for m in GAPS for name in ("low", "high", "spread", "set")))


def _inside(measure: str) -> Column:
    low = F.col(f"low_{measure}")
    return (F.col(measure) <= F.col(f"high_{measure}")) & (low.isNull() | (F.col(measure) >= low))


def learned_fences(sound: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The fences for each language and source; a measure learns from the texts that no other measure's quartiles refuse."""
    first = group_fences(sketch(sound, ["lang", "source"]), least_rows)
    beside = sound.join(first, ["lang", "source"])
    refused = {m: F.col(f"spread_{m}") & ~_inside(m) for m in GAPS}

    def own(measure: str) -> Column:
        others = F.greatest(*(F.coalesce(r, F.lit(False)) for m, r in refused.items() if m != measure))
        return F.when(~others, F.col(measure)).alias(measure)

    # Stored, so that the join is not bound to the sketch's keys and Spark can split a large group.
    counted = stored(beside.select("lang", "source", *map(own, GAPS)), "quality-sound")
    once = group_fences(sketch(counted, ["lang", "source"]), least_rows)
    return stored(once, "quality-fences")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and shares, base_failed, and kept: within all fences of its language and source."""
    # Measured once: the sketches and the verdicts read the same small table.
    values = stored(with_shares(measures(docs)), "quality-rules")
    sound = values.where(~F.col("base_failed"))
    limits = learned_fences(sound)
    judged = values.join(limits, ["lang", "source"], "left")
    inside = F.lit(True)
    for measure in GAPS:
        inside &= _inside(measure)
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return judged.withColumn("kept", kept).drop(*limits.columns[2:])


def keep_sound(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns; rows are told apart by id."""
    kept = judge(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")
