"""Policy deployment and mechanism use per snapshot and top-level domain (JN1, AGG1-14, MSR1-4)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailpolicy.functions.names import tld
from mailpolicy.functions.policy import MECHANISMS
from mailpolicy.modes import STRICT, is_reference
from mailpolicy.operators.terms import flags

# The zones that are reported and the order of the metrics in the wide summary row.
ZONES = ["com", "net", "org", "se"]
METRICS = ["total", "deployed", *MECHANISMS, "external_include"]
# Mechanisms whose change between snapshots is reported.
CHANGED = ["a", "mx", "include", "ip4", "ip6", "ptr", "all", "exists"]

_MULTIPLE = "multiple_policies"
_KEY = ["snapshot_date", "name"]


def summary(spf: DataFrame, mx: DataFrame, mode: str = STRICT, zones: list[str] | None = None) -> DataFrame:
    """Long table ``snapshot_date, tld, metric, n`` over the names that have both a TXT and an MX record.

    Both sides are brought to one row per name before they meet (``policy_facts``, ``mx_facts``), so no pair is ever formed.
    Both sides are partitioned by the join key already, so a merge join moves nothing, and nothing is broadcast on a guess
    about the size of parsed text. ``zones`` limits the top-level domains before anything is shuffled.
    """
    if zones is not None:
        spf, mx = (df.where(tld(F.col("name")).isin(*zones)) for df in (spf, mx))
    return summary_of_facts(policy_facts(spf, mode), mx_facts(mx, mode), mode)


def metrics_of(mode: str) -> list[str]:
    """Names of the metrics that the facts of a mode hold; strict mode adds ``multiple_policies``."""
    return METRICS if is_reference(mode) else [*METRICS, _MULTIPLE]


def policy_facts(spf: DataFrame, mode: str = STRICT) -> DataFrame:
    """One row per snapshot and name of a TXT scan.

    In reference mode each policy counts (Q4, Q5), so a row holds a sum for each metric. In strict mode a name either has a
    metric or not: ``bits`` has a bit for each, which keeps the shuffled row short.
    """
    per_policy = flags(spf, mode).withColumn("total", F.col("first"))
    if is_reference(mode):
        return per_policy.groupBy(*_KEY).agg(*[F.count_if(m).alias(m) for m in METRICS])
    per_policy = per_policy.withColumn(_MULTIPLE, F.col("n_policies") > 1)
    bits = " | ".join(f"if({m}, {1 << i}, 0)" for i, m in enumerate(metrics_of(mode)))
    return per_policy.groupBy(*_KEY).agg(F.expr(f"bit_or({bits})").alias("bits"))


def mx_facts(mx: DataFrame, mode: str = STRICT) -> DataFrame:
    """One row per snapshot and name of an MX scan; in reference mode with ``copies``, the number of its lines (Q4)."""
    return mx.groupBy(*_KEY).agg(F.count("*").alias("copies")) if is_reference(mode) else mx.select(*_KEY).distinct()


def summary_of_facts(policies: DataFrame, names: DataFrame, mode: str = STRICT) -> DataFrame:
    """The long table of ``summary`` from facts, worked out now or stored (``sources.snapshots``), where the join moves nothing.

    In reference mode the number of a name's MX lines multiplies its sums.
    """
    metrics = metrics_of(mode)
    if is_reference(mode):
        counts = {m: F.expr(f"sum({m} * copies)") for m in metrics}
    else:
        counts = {m: F.expr(f"count_if(bits & {1 << i} <> 0)") for i, m in enumerate(metrics)}
    wide = (
        policies.join(names.hint("merge"), _KEY)
        .groupBy("snapshot_date", tld(F.col("name")).alias("tld"))
        .agg(*[n.alias(m) for m, n in counts.items()])
    )
    return wide.unpivot(["snapshot_date", "tld"], metrics, "metric", "n")


def joined_names(spf: DataFrame, mx: DataFrame, mode: str = STRICT) -> DataFrame:
    """``name, n``: how often each name comes out of the join of the two scans (Q4)."""
    left = spf.groupBy(*_KEY).agg(F.count("*").alias("spf_lines"))
    right = mx.groupBy(*_KEY).agg(F.count("*").alias("mx_lines"))
    n = F.col("spf_lines") * F.col("mx_lines") if is_reference(mode) else F.lit(1).cast("bigint")
    return left.join(right.hint("merge"), _KEY).select(*_KEY, n.alias("n"))


def joined_total(summary_table: DataFrame) -> DataFrame:
    """``snapshot_date, n``: joined rows of a snapshot over all top-level domains (AGG2)."""
    return (
        summary_table.where(F.col("metric") == "total").groupBy("snapshot_date").agg(F.sum("n").alias("n"))
    )


def _metric(metric: str, zone: str | None = None) -> Column:
    """Count of one metric in a grouping of the long table, 0 where no row has it."""
    wanted = f"metric = '{metric}'" if zone is None else f"metric = '{metric}' AND tld = '{zone}'"
    return F.expr(f"coalesce(sum(n) FILTER (WHERE {wanted}), 0L)")


def wide(summary_table: DataFrame, zones: list[str] = ZONES) -> DataFrame:
    """One row per snapshot: date, joined rows, then each metric for each zone (D10)."""
    cells = [_metric(m, z).alias(f"{m}_{z}") for m in METRICS for z in zones]
    return summary_table.groupBy("snapshot_date").agg(_metric("total").alias("joined"), *cells)


def table1(summary_table: DataFrame, zones: list[str] = ZONES) -> DataFrame:
    """``measure`` and one column per zone, for the latest snapshot (MSR4)."""
    measures = {
        "with_mx": "total",
        "deployed": "deployed",
        "with_include": "include",
        "with_external_include": "external_include",
    }
    latest = wide(summary_table, zones).orderBy(F.desc("snapshot_date")).limit(1)
    rows = [
        F.struct(F.lit(label).alias("measure"), *[F.col(f"{m}_{z}").alias(z) for z in zones])
        for label, m in measures.items()
    ]
    return latest.select(F.inline(F.array(*rows)))


def shares(summary_table: DataFrame) -> DataFrame:
    """``snapshot_date, tld, mechanism, n, deployed, share`` (MSR1); the share is null where nothing is deployed."""
    per_tld = summary_table.groupBy("snapshot_date", "tld").agg(
        _metric("deployed").alias("deployed"), *[_metric(m).alias(m) for m in MECHANISMS]
    )
    return per_tld.unpivot(["snapshot_date", "tld", "deployed"], MECHANISMS, "mechanism", "n").select(
        "snapshot_date", "tld", "mechanism", "n", "deployed", F.try_divide("n", "deployed").alias("share")
    )


def share_change(summary_table: DataFrame, first: str, last: str, zones: list[str] = ZONES) -> DataFrame:
    """Change of each mechanism's share from one snapshot to another (MSR2-3).

    ``change`` is the plain difference, ``change_pct`` is in percentage points with one digit, ties to even on the
    binary value.
    """
    def share(date: str) -> Column:
        return F.max(F.when(F.col("snapshot_date") == F.lit(date).cast("date"), F.col("share")))

    change = (
        shares(summary_table.where(F.col("tld").isin(*zones)))
        .where(F.col("mechanism").isin(*CHANGED))
        .groupBy("tld", "mechanism")
        .agg(share(first).alias("share_first"), share(last).alias("share_last"))
        .withColumn("change", F.col("share_last") - F.col("share_first"))
    )
    return change.withColumn("change_pct", F.expr("cast(format_number(change * 100, '0.0') as double)"))
