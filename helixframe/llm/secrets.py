"""Secret scanning over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds one row
for each (blob, rule version) pair that was ever scanned. A run scans only the pairs that are new,
appends them, and joins the findings of all blobs back to every path that holds them.

Defined cases: null content is empty text, and empty text has no findings. Repeated rows and
copies share one blob, which is scanned where its first holder's rows are; each path still gets its findings. An empty table
gives an empty ledger and no findings. A null path keeps its row. Columns other than the named
ones are ignored, so their names cannot clash. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Findings of a blob are joined back to its paths in so many shares.
SALTS = 16
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The fixed base kinds, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # a run is matched whole, so a lower bound in the pattern drops the same matches
    Rule("hex", r"[0-9a-f]{24,}"),
)
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("repo", r"gh[opsu]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + EXTRA_RULES


def spans(content: F.Column, rule: Rule, rank: int) -> F.Column:
    """The rule's spans in the content: what lies between matches gives each match its place."""
    pattern, none = F.lit(rule.pattern), F.array().cast(SPAN)
    hits, parts = F.regexp_extract_all(content, pattern, F.lit(0)), F.regexp_extract_all(content, pattern, F.lit(rule.group))
    pieces = F.transform(F.split(content, rule.pattern, -1), lambda gap, i: F.struct(F.length(gap).alias("gap"), F.length(F.get(hits, i)).alias("hit"), F.length(F.get(parts, i)).alias("part")))

    def add(state: F.Column, x: F.Column) -> F.Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        found = F.when(x["hit"].isNull() | (x["part"] < rule.least), state["found"]).otherwise(F.concat(state["found"], F.array(span)))
        return F.struct(end.alias("at"), found.alias("found"))

    walked = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("found")), add)
    return F.when(content.rlike(rule.pattern), walked["found"]).otherwise(none)


def pending_pairs(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each blob with rules it was not scanned with: (blob, path, version, pending).

    ``path`` and ``version`` name the blob's first holder, from which its content is read.
    """
    first = versions.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        pending = first.withColumn("pending", keys)
    else:
        pairs = first.select("blob", "at", F.explode(keys).alias("rule"))
        unseen = pairs.join(ledger.select("blob", "rule"), ["blob", "rule"], "left_anti")
        pending = unseen.groupBy("blob", "at").agg(F.collect_set("rule").alias("pending"))
    return pending.select("blob", F.col("at.path").alias("path"), F.col("at.version").alias("version"), "pending")


def address(history: DataFrame, path: str, version: str, content: str) -> DataFrame:
    """(path, version, blob) of every historical version, with its content."""
    text = F.coalesce(F.col(content), F.lit(""))
    return history.select(F.col(path).alias("path"), F.col(version).alias("version"), F.sha2(text, 256).alias("blob"), text.alias("content"))


def scan(history: DataFrame, path: str, version: str, content: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, spans by rule): findings of the unseen (blob, rule version) pairs.

    The narrow side is the pending blobs; it is hashed in each partition, so contents are moved
    once and never sorted.
    """
    addressed = address(history, path, version, content)
    pending = pending_pairs(addressed.drop("content"), ledger, rules)
    matched = [c.eqNullSafe(d) for c, d in ((F.col("v.path"), F.col("p.path")), (F.col("v.version"), F.col("p.version")))]
    work = addressed.alias("v").join(pending.hint("shuffle_hash").alias("p"), [*matched, F.col("v.blob") == F.col("p.blob")]).select("p.blob", "p.pending", "v.content")
    found = [F.when(F.array_contains("pending", r.key), spans(F.col("content"), r, i)) for i, r in enumerate(rules)]
    return work.select("blob", "pending", *[f.alias(r.kind) for f, r in zip(found, rules)]).dropDuplicates(["blob"])


def ledger_rows(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's long form: (blob, rule, spans), one row for each pair that was scanned."""
    pairs = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.col(r.kind).alias("spans")) for r in rules])
    return scanned.select("blob", F.explode(pairs).alias("p")).select("blob", "p.rule", "p.spans").where("spans IS NOT NULL")


def findings(history: DataFrame, path: str, version: str, content: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, version, blob, one span array for each kind) for every version of every path.

    Blobs with any finding are few: each is joined back to its paths in SALTS shares, so that a blob that very
    many paths hold is no task of its own; adaptive execution splits what is still large.
    """
    scanned = scan(history, path, version, content, ledger, rules)
    kinds = [r.kind for r in rules]
    if ledger is not None:
        known = ledger.unionByName(ledger_rows(scanned, rules))
        scanned = known.groupBy("blob").agg(*[F.max(F.when(F.col("rule") == r.key, F.col("spans"))).alias(r.kind) for r in rules])
    some = scanned.where(F.greatest(*[F.coalesce(F.size(k), F.lit(0)) for k in kinds], F.lit(0)) > 0).select("blob", *kinds)
    paths = address(history, path, version, content).drop("content").withColumn("salt", F.pmod(F.xxhash64("path", "version"), F.lit(SALTS)))
    back = paths.join(some.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["blob", "salt"], "left")
    return back.select("path", "version", "blob", *[F.coalesce(k, F.expr(f"CAST(array() AS {SPAN})")).alias(k) for k in kinds])


def read_ledger(spark: SparkSession, at: str) -> DataFrame | None:
    """The ledger stored at a path, or None before the first run."""
    try:
        return spark.read.parquet(at)
    except AnalysisException:
        return None


def run(history: DataFrame, path: str, version: str, content: str, at: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One run against the ledger stored at ``at``: what it lacks is scanned and appended, and all versions' findings are joined back from it.

    A run that ends before its rows are appended leaves the ledger as it was; pairs that two runs appended at once count once.
    """
    spark = history.sparkSession
    fresh = ledger_rows(scan(history, path, version, content, read_ledger(spark, at), rules), rules)
    fresh.write.mode("append").parquet(at)
    return findings(history, path, version, content, spark.read.parquet(at), rules)


def listed(kinds: list[str]) -> F.Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.concat(*[F.col(k) for k in kinds]))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
