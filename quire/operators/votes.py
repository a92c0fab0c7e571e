"""Aggregations that decide: weighted modes, arg-max votes, medians, classifications of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mode(df: DataFrame, keys: list[str], value: Column, weight: Column, name: str) -> DataFrame:
    """The value of the largest total weight; of equals the smallest."""
    sums = df.groupBy(*keys, value.alias("__v")).agg(F.sum(weight).alias("__w"))
    top = sums.groupBy(*keys).agg(F.max(F.struct("__w", (-F.col("__v")).alias("n"), "__v")).alias("__m"))
    return top.select(*keys, F.col("__m.__v").alias(name), F.col("__m.__w").alias("weight"))


def arg_max(df: DataFrame, keys: list[str], choice: str, score: Column, name: str = "score") -> DataFrame:
    """For each key (one at least) the choice of the largest total score; of equals the first by name."""
    sums = df.groupBy(*keys, choice).agg(score.alias(name))
    best = sums.groupBy(*keys).agg(F.max(name).alias("__top"))
    tied = sums.join(best, keys)
    return tied.where(F.col(name) == F.col("__top")).groupBy(*keys).agg(F.min(choice).alias(choice), F.max(name).alias(name))


#: Distinct values of a range of exact_median.
RANGE_VALUES = 1 << 16


def exact_median(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The exact median of each key, the mean of the middle two for even counts; nulls don't count.

    Values are counted first and dealt by ranges of (key, value), kept in a table; sums over
    the ranges say which of them hold the middle ranks, and only these are ordered. No task
    sees a whole key."""
    from pyspark.sql import Window

    from quire.session import written

    counted = df.select(*keys, value.alias("__v")).where("__v IS NOT NULL").groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    counted = written(counted, "median-values")
    n = max(1, -(-counted.count() // RANGE_VALUES))
    dealt = written(counted.repartitionByRange(n, *keys, "__v").withColumn("__r", F.spark_partition_id()), "median-ranges")
    sums = dealt.groupBy(*keys, "__r").agg(F.sum("__n").alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0))).withColumn("__total", F.sum("__s").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)
    middle = sums.where((F.col("__before") <= high) & (F.col("__before") + F.col("__s") > low)).drop("__s")
    inside = Window.partitionBy(*keys, "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(middle, [*keys, "__r"]).withColumn("__at", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    holds = lambda rank: (F.col("__at") <= rank) & (F.col("__at") + F.col("__n") > rank)
    two = rows.groupBy(*keys).agg(F.max(F.when(holds(low), F.col("__v"))).alias("__a"), F.max(F.when(holds(high), F.col("__v"))).alias("__b"))
    return two.select(*keys, ((F.col("__a") + F.col("__b")) / 2).alias(name))


def size_groups(df: DataFrame, dims: list[str], order: str, member: str) -> DataFrame:
    """Rows of equal size, in order of first appearance, with their ordered members."""
    return df.groupBy(*dims).agg(F.min(order).alias("first_seen"), F.array_sort(F.collect_list(member)).alias("members"))


def zero_filled(counts: DataFrame, key: str, n: str, every: DataFrame) -> DataFrame:
    """Counts for every known key, 0 where there are none."""
    return every.select(key).join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0)))


#: What upper-case font names start with or hold, by family, tried in this order; None counts for no family.
FONT_FAMILIES = (
    ("computerModern", (
        ("starts", "DCR"), ("starts", "DCBX"), ("starts", "DCTI"), ("starts", "DCSL"), ("starts", "DCTT"), ("starts", "DCSS"), ("starts", "DCCSC"), ("starts", "DCBXTI"),
        ("starts", "ECR"), ("starts", "ECBX"), ("starts", "ECTI"), ("starts", "ECSL"),
        ("starts", "SFRM"), ("starts", "SFBX"), ("starts", "SFTI"), ("starts", "SFSL"), ("starts", "SFTT"), ("starts", "SFSS"), ("starts", "SFCC"), ("starts", "SFDC"),
        ("starts", "CMR"), ("starts", "CMBX"), ("starts", "CMTI"), ("starts", "CMSL"), ("starts", "CMSS"), ("starts", "CMTT"),
    )),
    (None, (("starts", "CMMI"), ("starts", "CMSY"), ("starts", "CMEX"), ("starts", "CMMIB"), ("starts", "CMBSY"), ("starts", "MSBM"), ("starts", "MSAM"))),
    ("latinModern", (("starts", "LMROMAN"), ("starts", "LMMONO"), ("starts", "LMSANS"), ("starts", "LMMATH"))),
    ("times", (("holds", "TIMES"), ("starts", "NIMBUS"), ("starts", "NTXR"), ("starts", "NEWTXTEXT"))),
    ("palatino", (("holds", "PALLADIO"), ("holds", "PALATINO"), ("starts", "NEWPX"))),
    ("helvetica", (("holds", "HELVETICA"), ("holds", "ARIAL"))),
)
#: Prefixes of text fonts in the T1 encoding.
T1_PREFIXES = (
    "DCR", "DCBX", "DCTI", "DCSL", "DCTT", "DCSS", "DCCSC", "DCBXTI", "ECR", "ECBX", "ECTI", "ECSL",
    "SFRM", "SFBX", "SFTI", "SFSL", "SFTT", "SFSS", "SFCC", "LMROMAN", "LMMONO", "LMSANS",
)
#: Prefixes of text fonts in the OT1 encoding.
OT1_PREFIXES = ("CMR", "CMBX", "CMTI", "CMSL", "CMSS", "CMTT", "CMCSC")
#: Prefixes of the fonts that speak for LaTeX.
LATEX_PREFIXES = (
    "CMR", "CMBX", "CMTI", "CMSL", "CMSS", "CMTT", "CMCSC", "CMMI", "CMSY", "CMEX", "CMMIB", "CMBSY", "MSAM", "MSBM",
    "DCR", "DCBX", "DCTI", "DCSL", "DCTT", "DCSS", "DCCSC", "ECR", "ECBX", "ECTI", "ECSL",
    "SFRM", "SFBX", "SFTI", "SFSL", "SFTT", "SFSS", "LMROMAN", "LMMONO", "LMSANS", "LMMATH",
)
#: Words in the names of office fonts.
OFFICE_WORDS = ("CALIBRI", "CAMBRIA", "ARIAL", "TIMESNEWROMAN", "TIMES NEW ROMAN", "SEGOEUI", "VERDANA", "TAHOMA")


def _starts(words: tuple[str, ...]) -> str:
    return f"^({'|'.join(words)})"


def _pattern(rules: tuple[tuple[str, str], ...]) -> str:
    return "|".join(f"^{text}" if kind == "starts" else text for kind, text in rules)


def font_family(name: Column) -> Column:
    up = F.upper(F.regexp_replace(name, r"^[^+]*\+", ""))
    out = F.when(F.lit(False), "")
    for family, rules in FONT_FAMILIES:
        out = out.when(up.rlike(_pattern(rules)), F.lit(family))
    return out


def font_encoding(counts: DataFrame, keys: list[str], name: str = "font", n: str = "n") -> DataFrame:
    """T1 or OT1 by the counted fonts: T1 unless classic text fonts outweigh the others."""
    up = F.upper(F.regexp_replace(F.col(name), r"^[^+]*\+", ""))
    t1, ot1 = up.rlike(_starts(T1_PREFIXES)), up.rlike(_starts(OT1_PREFIXES))
    sums = counts.groupBy(*keys).agg(
        F.sum(F.when(t1, F.col(n)).otherwise(0)).alias("t1"), F.sum(F.when(ot1 & ~t1, F.col(n)).otherwise(0)).alias("ot1")
    )
    return sums.withColumn("encoding", F.when((F.col("ot1") > 0) & ((F.col("t1") == 0) | (F.col("t1") < F.col("ot1"))), "OT1").otherwise("T1"))


def source_from_fonts(counts: DataFrame, keys: list[str], name: str = "font", n: str = "n") -> DataFrame:
    """latex where its fonts are over 0.3 of all (score at most 0.8), else word at 0.6 for office fonts,
    scanned at 0.4 without fonts, else unknown."""
    up = F.upper(F.col(name))
    office = F.lit(False)
    for w in OFFICE_WORDS:
        office = office | F.contains(F.replace(up, F.lit("-"), F.lit("")), F.lit(w))
    sums = counts.groupBy(*keys).agg(
        F.sum(F.when(up.rlike(_starts(LATEX_PREFIXES)), F.col(n)).otherwise(0)).alias("latex"),
        F.sum(F.when(office, F.col(n)).otherwise(0)).alias("office"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total"),
    )
    ratio = F.try_divide("latex", "total")
    format_ = F.when(ratio > 0.3, "latex").when(F.col("office") > 0, "word").when(F.col("total") == 0, "scanned").otherwise("unknown")
    score = F.when(ratio > 0.3, F.least(F.lit(0.8), ratio)).when(F.col("office") > 0, 0.6).when(F.col("total") == 0, 0.4).otherwise(0.0)
    return sums.select(*keys, format_.alias("format"), score.alias("score"))


#: What a creator or producer says, the format and engine it means and its weight, in order.
METADATA_RULES = (
    ("pdftex|pdflatex", "latex", "pdfTeX", 0.9), ("xetex|xelatex", "latex", "xeTeX", 0.9), ("luatex|lualatex", "latex", "luaTeX", 0.9),
    ("dvipdfm", "latex", "dvipdfm", 0.9), ("tex", "latex", "unknown", 0.7),
    ("microsoft word|microsoft office", "word", "unknown", 0.9), ("pages", "word", "unknown", 0.8), ("google", "word", "unknown", 0.8),
    ("libreoffice|openoffice", "word", "unknown", 0.85), ("typst", "typst", "unknown", 0.9),
    ("indesign", "designer", "unknown", 0.9), ("quark", "designer", "unknown", 0.85),
)
#: Rules of one kind are tried on the creator first, then on the producer, before the next kind.
METADATA_KINDS = ((0, 5), (5, 9), (9, 10), (10, 12))


def source_from_metadata(creator: Column, producer: Column) -> Column:
    """``struct<format, engine, score>`` by ordered rules over the two strings."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("format"), F.lit("").alias("engine"), F.lit(0.0).alias("score")))
    for a, b in METADATA_KINDS:
        for said in (F.lower(creator), F.lower(producer)):
            for pattern, format_, engine, score in METADATA_RULES[a:b]:
                hit = said.rlike(pattern) & (~said.contains("text") if pattern == "tex" else F.lit(True))
                out = out.when(hit, F.struct(F.lit(format_).alias("format"), F.lit(engine).alias("engine"), F.lit(score).alias("score")))
    return out.otherwise(F.struct(F.lit("unknown").alias("format"), F.lit("unknown").alias("engine"), F.lit(0.0).alias("score")))
