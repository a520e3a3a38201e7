"""Effective population size by generation from historical periods, and mixing proportions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import ne_from_sexes
from .intervals import at_point, overlaps

# Period, population at its start and end, person-years lived, birth rate, births, imports.
PERIODS = """
1610-1620      0      20       16  -      -     32
1620-1630     20      59      361  22.4   8    150
1630-1640     59     585     2293  22.4   51   110
1640-1650    585    1568     9970  22.4   223  301
1650-1660   1568    2862    21505  22.4   481  1335
1660-1670   2862    4444    35952  22.4   804  3038
1670-1680   4444    6832    55527  26.5   1472 3582
1680-1690   6832   16394   109243  27.3   2986 4947
1690-1700  16394   27806   215999  29.1   6295 8197
1700-1710  27806   41844   343482  31.0   10635 16442
1710-1720  41844   67294   535651  34.6   18524 17622
1720-1730  67294   95669   806513  41.3   33316 41334
1730-1740  95669  156040  1234030  41.4   51150 66672
1740-1750 156040  247027  1980625  41.2   81536 26455
1750-1760 247027  319290  2816150  46.4   130654 44718
1760-1770 319290  459446  3851269  39.5   151957 59557
1770-1780 459446  558921  5075599  39.1   198660 41129
1780-1790 558921  706514  6298380  44.7   281549 25105
1790-1800 706514  908036  8030652  50.3   403648 16183
1800-1810 908036 1195182 10450423  55.8   583395 77368
1810-1820 1195182 1550757 13652609 55.7   759768 5207
1820-1830 1550757 2021968 17759559 56.5   1003859 410
1830-1840 2021968 2530405 22666906 56.5   1280680 91
1840-1850 2530405 3204420 28541607 54.0   1539820 0
1850-1860 3204420 3953760 35659777 52.3   1865898 303
1860-1861 3953760 3991133 3972417  49.6   197032 110
1861-1862 3991133 3903859 3947335  49.6   195788 0
1862-1863 3903859 3815760 3859642  49.6   191438 0
1863-1864 3815760 3726828 3771119  49.6   187048 0
1864-1865 3726828 3630336 3144251  49.6   155955 0
"""
START_YEAR, END_OF_RECORD, PRESENT, GENERATION = 1625, 1865, 2000, 25
GROWTH = 0.023175
LONGEST_FIRST = 7
# What the epochs are called in output tables.
EPOCH_LABELS = {1: "Epoch 1: Import-influenced sex proportions", 2: "Epoch 2: WF 'Inbreeding Nb'", 3: "Epoch 3: Modern exponential growth"}
# The published histories of both sources, oldest first: years before the present in which a stretch began, the
# size then (None: what the one before came to), and growth by generation.
HISTORIES = {
    "afr": ((148_000, 7310.0, 0.0), (51_000, 14_474.0, 0.0), (5_115, None, 0.0166)),
    "eur": ((51_000, 1861.0, 0.0), (23_000, 1032.0, 0.00307), (5_115, None, 0.0195)),
}
#: Share of the first epoch's non-European part that is new, by generation.
FIRST_SHARES = (1, 0.9835, 0.8602, 0.8551, 0.7826, 0.5380, 0.1418)


@dataclass(frozen=True)
class Epochs:
    """Generations in each epoch; they fill the years from 1625 to the present."""

    first: int = 1
    second: int = 6
    third: int = 8

    def __post_init__(self) -> None:
        parts = (self.first, self.second, self.third)
        if any(not isinstance(x, int) or x < 0 for x in parts):
            raise ValueError("epoch lengths must be whole generations")
        if self.first > LONGEST_FIRST:
            raise ValueError(f"the first epoch has at most {LONGEST_FIRST} generations")
        if (PRESENT - START_YEAR) % GENERATION or sum(parts) != (PRESENT - START_YEAR) // GENERATION:
            raise ValueError("epochs must fill the generations up to the present")
        if self.third and not self.first + self.second:
            raise ValueError("the last epoch needs an earlier one to grow from")

    @property
    def anchor(self) -> int:
        return self.first + self.second


def periods(spark: SparkSession) -> DataFrame:
    rows = [line.split() for line in PERIODS.split("\n") if line]
    number = lambda x: None if x == "-" else float(x)
    raw = spark.createDataFrame([(r[0], *map(number, r[1:])) for r in rows], "period string, value_start double, value_end double, person_years double, birth_rate double, births double, imported double")
    year = lambda i: F.split("period", "-")[i].cast("double")
    return raw.withColumn("p_start", year(0)).withColumn("p_end", year(1))


def generations(spark: SparkSession) -> DataFrame:
    n = (PRESENT - START_YEAR) // GENERATION
    g = spark.range(0, n + 1).select(F.col("id").cast("int").alias("generation"))
    return g.select("generation", (F.lit(START_YEAR) + (F.col("generation") - 1) * GENERATION).cast("double").alias("w_start"), (F.lit(START_YEAR) + F.col("generation") * GENERATION).cast("double").alias("w_end"))


def history(windows: DataFrame, record: DataFrame, end: float = END_OF_RECORD, width: float = GENERATION) -> DataFrame:
    """What the record holds of each generation: weighted imports and births, the birth rate, the population at its end."""
    shared = overlaps(windows, record, width)
    mass = F.col("person_years") * F.col("weight")
    rated = F.when(F.col("birth_rate").isNotNull(), mass)
    sums = shared.groupBy("generation").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_start", "period"))), lambda p: p["period"]), ", ").alias("periods"),
        F.sum(F.col("imported") * F.col("weight")).alias("imported"),
        F.sum(F.col("births") * F.col("weight")).alias("births"),
        (F.sum(F.col("birth_rate") * rated) / F.sum(rated)).alias("birth_rate"),
        F.sum("overlap").alias("observed"),
    )
    boundary = F.when(F.col("w_start") < end, F.least("w_end", F.lit(float(end))))
    full = windows.withColumn("boundary", boundary).join(sums, "generation", "left")
    return at_point(full, record, "boundary", width).withColumnRenamed("value", "pop_end").withColumn("truncated", F.col("observed") < F.col("w_end") - F.col("w_start"))


def trajectory(spark: SparkSession, epochs: Epochs = Epochs()) -> DataFrame:
    """(generation, year, epoch, admix_ne, import_ne, ne) of all modelled generations."""
    g, e1, last2 = F.col("generation"), epochs.first, epochs.anchor
    order = W.orderBy("generation")  # one row for each generation
    rows = history(generations(spark), periods(spark))
    prior = F.lag(F.col("pop_end") - F.col("births")).over(order)
    known = rows.withColumn("prev_births", F.lag("births").over(order)).withColumn("adults", prior + F.col("imported"))
    women, men = F.ceil(F.col("imported") / 3), F.floor(2 * F.col("imported") / 3)
    female = F.when(g == 1, F.col("adults") / 3).otherwise(women + 0.5 * F.col("prev_births"))
    male = F.when(g == 1, F.col("adults") * 2 / 3 + F.col("adults") * 0.15).otherwise(men + 0.5 * F.col("prev_births"))
    k = F.lit(GENERATION) * F.col("birth_rate") / 1000
    second = (g > e1) & (g <= last2)
    admix = F.when(second & (g > 1), (k * F.col("prev_births") - 1) / k)
    imported = F.when(second & (g > 1), F.coalesce(F.when(F.col("imported") > 0, ne_from_sexes(women, men)), F.lit(0.0)))
    early = F.when((g == 1) | (g <= e1), ne_from_sexes(female, male)).when(second, admix + imported)
    stepped = known.withColumn("admix_ne", admix).withColumn("import_ne", imported).withColumn("early", early)
    anchor = F.max(F.when(g == last2, F.col("early"))).over(W.partitionBy())
    ne = F.when(g > last2, anchor * F.exp(F.lit(GROWTH) * (g - last2))).otherwise(F.col("early"))
    epoch = F.when(g <= e1, 1).when(g <= last2, 2).otherwise(3)
    return stepped.withColumn("ne", ne).where(g >= 1).select("generation", F.col("w_end").cast("int").alias("year"), epoch.alias("epoch"), "imported", "births", "birth_rate", "truncated", "admix_ne", "import_ne", "ne")


def mixing_proportions(spark: SparkSession, epochs: Epochs, eur: tuple = (0.08, 0.03, 0.0), afr: tuple = (0.06, 0.0)) -> DataFrame:
    """(g, s_afr, s_eur, h): new African and European shares of each generation and what is inherited."""
    g = F.col("g")
    first = F.get(F.array(*[F.lit(float(x)) for x in FIRST_SHARES]), g - 1) * (1 - eur[0])
    s_afr = F.when(g <= epochs.first, first).when(g <= epochs.anchor, F.lit(afr[0])).otherwise(F.lit(afr[1]))
    s_eur = F.when(g <= epochs.first, F.lit(eur[0])).when(g <= epochs.anchor, F.lit(eur[1])).otherwise(F.lit(eur[2]))
    n = epochs.first + epochs.second + epochs.third
    rows = spark.range(1, n + 1).select(F.col("id").cast("int").alias("g")).select("g", s_afr.alias("s_afr"), s_eur.alias("s_eur"))
    return rows.withColumn("h", F.greatest(1 - F.col("s_afr") - F.col("s_eur"), F.lit(0.0)))


def labelled_epochs(rows: DataFrame) -> DataFrame:
    """``epoch`` as its label."""
    label = F.create_map(*[F.lit(x) for pair in EPOCH_LABELS.items() for x in pair])
    return rows.withColumn("epoch", label[F.col("epoch")])


def overlap_table(spark: SparkSession) -> DataFrame:
    """Each modelled generation's periods with the years they share and their weight."""
    return overlaps(generations(spark).where("generation >= 1"), periods(spark), GENERATION).select("generation", "w_start", "w_end", "period", "overlap", "weight")


def validate(ne: DataFrame, shared: DataFrame, shares: DataFrame, epochs: Epochs) -> DataFrame:
    """``ne`` as ``trajectory`` makes it (epochs as numbers or labels), or a ValueError that names what does not hold.

    Each condition is counted in one aggregation of each table, which have a row for each generation.
    """
    n = epochs.first + epochs.second + epochs.third
    e = F.when(F.col("epoch").cast("string").rlike("^(Epoch )?1"), 1).when(F.col("epoch").cast("string").rlike("^(Epoch )?2"), 2).when(F.col("epoch").cast("string").rlike("^(Epoch )?3"), 3)
    expected = F.when(F.col("generation") <= epochs.first, 1).when(F.col("generation") <= epochs.anchor, 2).otherwise(3)
    sound = lambda x: F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    second = (expected == 2) & (F.col("generation") > 1)
    bad = lambda holds: F.count(F.when(~F.coalesce(holds, F.lit(False)), 1))
    found = ne.agg(
        F.sort_array(F.collect_list("generation")).alias("numbers"), F.max("year").alias("last"),
        bad(e == expected).alias("epochs"), bad(sound("ne") & (F.col("ne") > 0)).alias("sizes"),
        bad(~second | sound("admix_ne") & (F.col("admix_ne") > 0)).alias("admixed sizes"), bad(~second | sound("import_ne") & (F.col("import_ne") >= 0)).alias("import sizes"),
        bad(~second | (F.abs(F.col("ne") - F.col("admix_ne") - F.col("import_ne")) < 1e-6)).alias("sums of the second epoch"), bad(~second | (F.coalesce("imported", F.lit(0.0)) > 0) | (F.col("import_ne") == 0)).alias("generations without imports"),
    ).first().asDict()
    wrong = [k for k, v in found.items() if k not in ("numbers", "last") and v]
    wrong += ["generation numbers"] if found["numbers"] != list(range(1, n + 1)) else []
    wrong += ["the last year"] if found["last"] != PRESENT else []
    wrong += ["overlap weights"] if shared.where("weight IS NULL OR weight <= 0 OR weight > 1").limit(1).count() else []
    wrong += ["mixing generations"] if [r.g for r in shares.select("g").orderBy("g").collect()] != list(range(1, n + 1)) else []
    if wrong:
        raise ValueError("the size model does not hold in: " + ", ".join(wrong))
    return ne


def stretches(history: tuple[tuple[float, float | None, float], ...], generation: int = GENERATION) -> list[tuple[float, float, float]]:
    """What ``piecewise`` takes, nearest first, of a history told from its beginning: each stretch grows to where the next one begins."""
    found, size = [], 0.0
    for (began, given, growth), until in zip(history, [*(h[0] for h in history[1:]), 0]):
        size = (size if given is None else given) * math.exp(growth * (began - until) / generation)
        found.insert(0, (began / generation, size, growth))
    return found


def source_sizes(years: DataFrame) -> DataFrame:
    """``years`` (year) with the size of each source; null before its history begins."""
    for name, history in HISTORIES.items():
        years = piecewise(years, stretches(history)).withColumnRenamed("ne", name)
    return years


def combined(spark: SparkSession, epochs: Epochs = Epochs()) -> DataFrame:
    """(year, population, ne, admix_ne, import_ne, epoch): the admixed population by generation and its sources by year."""
    own = labelled_epochs(trajectory(spark, epochs)).select("year", F.lit("aa").alias("population"), "ne", "admix_ne", "import_ne", "epoch")
    years = spark.range(START_YEAR, PRESENT + 1).select(F.col("id").cast("int").alias("year"))
    sources = source_sizes(years).unpivot(["year"], ["afr", "eur"], "population", "ne")
    return own.unionByName(sources, allowMissingColumns=True)


def on_generations(rows: DataFrame) -> DataFrame:
    """The rows at whole generations after the first year, with the generation's number (cut to a whole one)."""
    number = ((F.col("year") - START_YEAR) / GENERATION).cast("int")
    return rows.withColumn("generation", number).where((F.col("generation") > 0) & (F.col("year") % GENERATION == 0))


def mixing_long(shares: DataFrame) -> DataFrame:
    """(g, ancestry, proportion, perc): one row for each source of each generation, also in percent."""
    return shares.unpivot(["g"], ["s_afr", "s_eur", "h"], "ancestry", "proportion").withColumn("perc", F.col("proportion") * 100)


def sources(shares: DataFrame) -> DataFrame:
    """(g, sources, proportions): what each generation is mixed from, without sources of proportion 0."""
    before = F.when(F.col("g") > 1, F.concat(F.lit("ADX_G"), (F.col("g") - 1).cast("string")))
    every = F.array(*[F.struct(name.alias("name"), F.col(c).alias("part")) for name, c in ((F.lit("AFR"), "s_afr"), (F.lit("EUR"), "s_eur"), (before, "h"))])
    kept = F.filter(every, lambda x: x["part"] > 0)
    return shares.select("g", F.transform(kept, lambda x: x["name"]).alias("sources"), F.transform(kept, lambda x: x["part"]).alias("proportions"))


def piecewise(years: DataFrame, pieces: list[tuple[float, float, float]], present: int = PRESENT, generation: int = GENERATION) -> DataFrame:
    """Size by year from (up to so many generations ago, size then, growth per generation) pieces, nearest first.

    Inside a piece the size falls back in time from its value at the piece's recent end.
    """
    ago = (F.lit(present) - F.col("year")) / generation
    size, recent = None, 0.0
    for upto, start, rate in pieces:
        value = F.lit(start) * F.exp(F.lit(-rate) * (ago - recent))
        size = F.when(ago <= upto, value) if size is None else size.when(ago <= upto, value)
        recent = upto
    return years.withColumn("ne", size)
