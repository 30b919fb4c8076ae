"""Findings gate: report levels against a policy, decisions, the decision log and its totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RULE = "struct<id:string,defaultConfiguration:struct<level:string>>"
_REPORT = f"struct<runs:array<struct<tool:struct<driver:struct<rules:array<{_RULE}>>>,results:array<struct<ruleId:string,level:string>>>>>"
_POLICY = "struct<block_on:array<string>,warn_on:array<string>,max_findings:int>"
LOG = "id long, ts timestamp, project_id string, sha string, state string, blocking int, warnings int, total int, reasons array<string>, batch string"


@dataclass(frozen=True)
class Policy:
    block_on: tuple[str, ...] = ("error",)
    warn_on: tuple[str, ...] = ("warning",)
    max_findings: int | None = None

    def __post_init__(self) -> None:
        for name in ("block_on", "warn_on"):
            value = getattr(self, name)
            if isinstance(value, str) or not all(isinstance(x, str) for x in value):
                raise ValueError(f"{name} must be a list of levels")
        if self.max_findings is not None and (isinstance(self.max_findings, bool) or not isinstance(self.max_findings, int)):
            raise ValueError("max_findings must be a whole number")

    @classmethod
    def from_dict(cls, data: dict | None) -> Policy:
        """A policy of given fields; unknown fields and bare strings for lists are refused."""
        data = data or {}
        if unknown := set(data) - {"block_on", "warn_on", "max_findings"}:
            raise ValueError(f"unknown policy fields: {', '.join(sorted(unknown))}")
        lists = {k: data[k] if isinstance(data[k], str) else tuple(data[k]) for k in ("block_on", "warn_on") if data.get(k) is not None}
        return cls(**lists, max_findings=data.get("max_findings"))

    @classmethod
    def from_yaml(cls, text: str) -> Policy:
        import yaml

        return cls.from_dict(yaml.safe_load(text))


def document(body: Column) -> Column:
    """The JSON text of a body: unwrapped where it is a JSON string, NULL where it is not valid JSON."""
    inner = F.when(F.ltrim(body).startswith('"'), F.get_json_object(body, "$")).otherwise(body)
    return F.when(F.try_parse_json(inner).isNotNull() & ~F.ltrim(inner).startswith('"'), inner)


def finding_levels(body: Column) -> Column:
    """Level of every result of a report, in order: its own, else its rule's default, else ``warning``.

    Empty levels count as missing; rules are looked up per run, the last of equal ids. NULL for a body that is not JSON.
    """
    report = F.from_json(document(body), _REPORT)

    def default(run: Column, result: Column) -> Column:
        named = F.filter(F.coalesce(run.tool.driver.rules, F.array().cast(f"array<{_RULE}>")), lambda r: r.id.eqNullSafe(result.ruleId))
        return F.nullif(F.try_element_at(named, F.lit(-1)).defaultConfiguration.level, F.lit(""))

    none = F.array().cast("array<struct<ruleId:string,level:string>>")
    levels = F.transform(
        F.coalesce(report.runs, F.array().cast("array<struct<tool:struct<driver:struct<rules:array<" + _RULE + ">>>,results:array<struct<ruleId:string,level:string>>>>")),
        lambda run: F.transform(F.coalesce(run.results, none), lambda r: F.coalesce(F.nullif(r.level, F.lit("")), default(run, r), F.lit("warning"))),
    )
    return F.when(document(body).isNotNull(), F.flatten(levels))


def _listed(levels: Column, wanted: Column) -> Column:
    return F.size(F.filter(levels, lambda x: F.array_contains(wanted, x)))


def decide(reports: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Decisions of reports: adds state, blocking, warnings, total, reasons. Map-only.

    reports: any columns, ``sarif`` and, if present, ``policy`` (JSON): fields a report's own policy gives replace those of
    the default. Bodies that are not JSON give no row. A level in both lists counts in both; warnings never fail.
    """
    base = policy or Policy()
    block, warn, most = F.array(*map(F.lit, base.block_on)).cast("array<string>"), F.array(*map(F.lit, base.warn_on)).cast("array<string>"), F.lit(base.max_findings).cast("int")
    if "policy" in reports.columns:
        own = F.from_json("policy", _POLICY)
        block, warn, most = F.coalesce(own.block_on, block), F.coalesce(own.warn_on, warn), F.coalesce(own.max_findings, most)
    leveled = reports.withColumn("_levels", finding_levels(F.col("sarif"))).where(F.col("_levels").isNotNull())
    counted = (
        leveled.withColumn("_block", block)
        .withColumn("_most", most)
        .withColumn("blocking", _listed(F.col("_levels"), F.col("_block")))
        .withColumn("warnings", _listed(F.col("_levels"), warn))
        .withColumn("total", F.size("_levels"))
    )
    shown = F.concat(F.lit("['"), F.array_join("_block", "', '"), F.lit("']"))
    # fixed values: the wording of reasons
    reasons = F.array_compact(
        F.array(
            F.when(F.col("blocking") > 0, F.concat(F.col("blocking").cast("string"), F.lit(" finding(s) at blocking level "), shown)),
            F.when(F.col("total") > F.col("_most"), F.concat(F.col("total").cast("string"), F.lit(" findings exceeds max_findings="), F.col("_most").cast("string"))),
        )
    )
    return counted.withColumn("reasons", reasons).withColumn("state", F.when(F.size("reasons") > 0, "failed").otherwise("success")).drop("_levels", "_block", "_most")


def append_decisions(decisions: DataFrame, path: str, batch: str | None = None) -> None:
    """Append decisions (project_id, sha, state, …) to the log; ids go on from the greatest one.

    One writer at a time; the ids are numbered per partition from a count of each, so nothing is gathered. A ``batch`` that
    the log holds already is not written again: its rows came with one commit, all or none.
    """
    spark = decisions.sparkSession
    if batch is not None and not read_log(spark, path).where(F.col("batch") == batch).isEmpty():
        return
    last = read_log(spark, path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = decisions.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id())
    numbered = numbered.withColumn("ts", F.date_trunc("second", F.current_timestamp())).persist()
    sizes = {r._part: r.n for r in numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = {}, last
    for part in sorted(sizes):
        offsets[part], total = total, total + sizes[part]
    if offsets:
        base = F.create_map(*(F.lit(x) for part, at in offsets.items() for x in (part, at)))
        ids = (F.pmod("_n", F.lit(1 << 33)) + 1 + base[F.col("_part")]).alias("id")
        row = numbered.select(ids, "ts", "project_id", "sha", "state", "blocking", "warnings", "total", "reasons", F.lit(batch).cast("string").alias("batch"))
        row.write.mode("append").parquet(path)
    numbered.unpersist()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The decision log; empty, with its columns, where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LOG).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LOG)


def recent(log: DataFrame, limit: int = 100) -> DataFrame:
    """The newest decisions by id, time as ISO text in UTC seconds; a partial sort."""
    newest = log.orderBy(F.desc("id")).limit(max(1, min(limit, 500)))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return newest.select("id", iso.alias("ts"), "project_id", "sha", "state", "blocking", "warnings", "total", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def totals(decisions: DataFrame) -> DataFrame:
    """Runs, failed runs, blocking and warning findings over the given decisions."""
    return decisions.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("state") == "failed").alias("failed"), F.coalesce(F.sum("blocking"), F.lit(0)).alias("blocking"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings")
    )


def latest_per_request(requests: DataFrame) -> DataFrame:
    """The last received request of each id, pre-aggregated on the map side."""
    rest = [c for c in requests.columns if c not in ("request_id", "received_at")]
    last = requests.groupBy("request_id").agg(F.max(F.struct("received_at", *rest)).alias("r"))
    return last.select("request_id", *(f"r.{c}" for c in rest), "r.received_at")


def rank_in_project(log: DataFrame) -> Column:
    """Newest-first position of a decision within its project."""
    return F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("id")))
