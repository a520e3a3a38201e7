"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a target share of the mixture's characters; its mean repetition rate is the target
mass over the mass it has. A document's count is the inverse of the Poisson distribution at a
uniform number hashed from the seed and the document, so a rerun or a retried task gives the same
copies. Documents are exploded by their count and dealt out in a hashed order.

Defined cases: a null source is a source of its own; null or empty texts have mass 0 and follow
their source's rate (a source of mass 0 keeps rate 1). A null id hashes as the empty string;
repeated rows share id and count. An empty table gives no rows. Weights below 0, or that give no
source of the table any weight, raise a ValueError. Further columns are kept, whatever their names:
a row travels as one value. The output columns ``rate``, ``copy`` and ``shuffle_key`` replace any of
the same name, unless ``tagged`` is false and they are left out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, unit_hash

#: A mean above this is the sum of equal means below it, each drawn from a hash of its own.
PART_RATE = 50.0
#: The inverse needs no more steps: beyond 160 less than 1e-30 is left of a Poisson law of mean 50.
STEPS = 160
#: So many sources are sent to all tasks at most (about 1.5 kB each); beyond, the join is salted.
SMALL_SOURCES = 10_000
SALTS = 64
#: A row of a source with a larger mean is copied in blocks of so many, which are dealt out first.
COPIES = 10_000


def source_rates(docs: DataFrame, source: str, text: str, weights: Mapping[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """(source, mass, rate, parts, steps): the mean repetition rate of each source and its inverse's steps.

    Without ``weights`` a source's target weight is its mass to the power ``temperature``.
    """
    mass = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("mass"))
    if weights is None:
        weight = F.pow("mass", F.lit(temperature))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be below 0")
        named = [F.lit(x) for name, w in weights.items() if name is not None for x in (name, float(w))]
        given = F.create_map(*named)[F.col("source")] if named else F.lit(None).cast("double")
        weight = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(F.coalesce(given, F.lit(0.0)))
    mass = materialize(mass.withColumn("weight", weight))
    total = mass.agg(F.sum("mass").alias("mass"), F.sum("weight").alias("weight")).first()
    if weights is not None and total["weight"] == 0:
        raise ValueError("the weights give no source of the table any weight")
    rate = F.when(F.col("mass") > 0, F.col("weight") / F.lit(total["weight"]) * F.lit(total["mass"]) / F.col("mass")).otherwise(F.lit(1.0))
    rated = mass.select("source", "mass", rate.alias("rate"))
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    steps = F.expr(
        f"""filter(aggregate(sequence(1, {STEPS}),
            named_struct('p', exp(-rate / parts), 'c', exp(-rate / parts), 'all', array(exp(-rate / parts))),
            (a, k) -> named_struct('p', a.p * (rate / parts) / k, 'c', a.c + a.p * (rate / parts) / k, 'all', concat(a.all, array(a.c + a.p * (rate / parts) / k)))
        ).all, c -> c < 1D)"""
    )
    return rated.withColumn("parts", parts).withColumn("steps", steps)


def replicate(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Mapping[str, float] | None = None, temperature: float = 0.5, seed: str = "mix-1", tagged: bool = True) -> DataFrame:
    """Every document as often as its Poisson count says, in a global hashed order, with rate, copy and shuffle_key if ``tagged``."""
    rates = materialize(source_rates(docs, source, text, weights, temperature))
    rates = rates.select(F.col("source").alias("of"), "rate", "parts", "steps")
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"), key.alias("key"))
    if rates.limit(SMALL_SOURCES + 1).count() <= SMALL_SOURCES:
        joined = rows.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("of")), "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
        spread = rates.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("side")), "left")
    draw = lambda j: F.size(F.filter("steps", lambda c: c <= unit_hash(F.lit(seed), F.col("key"), j.cast("string"))))
    single = F.size(F.filter("steps", lambda c: c <= F.col("u")))
    count = F.when(F.col("parts") == 1, single).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda a, j: a + draw(j)))
    counted = joined.withColumn("u", unit_hash(F.lit(seed), F.col("key"), F.lit("1"))).withColumn("n", count).where("n > 0").select("row", "key", "rate", "n")
    if (rates.agg(F.max("rate")).first()[0] or 0) <= COPIES:
        copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    else:  # some rows have very many copies
        blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("int"))))
        apart = blocks.repartition("key", "block")
        copies = apart.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES + 1, F.least("n", (F.col("block") + 1) * COPIES))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.col("key"), F.col("copy").cast("string"), F.lit("order"))))
    mixed = keyed.select("row", "rate", "copy", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    tags = ["rate", "copy", "shuffle_key"] if tagged else []
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in tags]
    return mixed.select(*kept, *tags)
