"""What the writers store and the readers of paths make of it: each query writes to a folder of its own and reads back."""

import tempfile
import uuid

from pyspark.sql import functions as F

from mailpolicy import sinks
from mailpolicy.catalog import fixtures, log_queries, report_queries, scan_queries
from mailpolicy.modes import REFERENCE
from mailpolicy.operators import curves, deployment
from mailpolicy.plans import deployment_report
from mailpolicy.sources import querylog, scans, snapshots, summary


def _folder(spark):
    """A new folder where all executors can write; a local one only if the session names none and has no others."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="stored-")
    return f"{shared.rstrip('/')}/stored-{uuid.uuid4().hex}"


def _summary(spark, sf_dir):
    """The first snapshot alone, then both: the second run replaces its snapshots only (Q8)."""
    path = _folder(spark)
    for snapshots in ((1,), (2,), (1,)):
        sinks.write_summary(scan_queries.summary(REFERENCE, snapshots, deployment.ZONES)(spark, sf_dir), path)
    stored = summary.read_summary(spark, path)
    return stored.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


def _histogram(spark, sf_dir):
    path = _folder(spark)
    found = report_queries.QUERIES["lookup_histogram"](spark, sf_dir)
    sinks.write_histogram(found, path)
    return spark.read.schema(found.schema).parquet(path)


def _cdf(spark, sf_dir):
    path = _folder(spark)
    histogram = report_queries.QUERIES["lookup_histogram"](spark, sf_dir).where(F.col("series") == "all")
    sinks.write_cdf(curves.cdf(histogram, "lookups", by=["series"], weight="n"), path)
    value, share = (F.split_part("value", F.lit(" "), F.lit(i)) for i in (1, 2))
    return spark.read.text(path).select(value.cast("bigint").alias("lookups"), F.round(share.cast("double"), 6).alias("cdf"))


def _log_directories(spark, sf_dir):
    """Two directories of log files, read as one log (SET5)."""
    paths = [_folder(spark) for _ in range(2)]
    for i, path in enumerate(paths):
        fixtures.log_lines(spark, sf_dir).where(F.col("e") % 2 == i).select("value").write.text(path)
    return querylog.read_query_log(spark, paths).groupBy("qname", "rr_type").agg(F.count("*").alias("n"))


def _scan_files(spark, sf_dir):
    """Both scans of a snapshot from their paths (SRC10)."""
    spf, mx = (_folder(spark) for _ in range(2))
    fixtures.spf_lines(spark, sf_dir, 1).select("value").write.option("compression", "gzip").text(spf)
    fixtures.mx_lines(spark, sf_dir, 1).select("value").write.text(mx)
    read = [read(spark, path, fixtures.FIRST, REFERENCE) for read, path in ((scans.read_spf, spf), (scans.read_mx, mx))]
    found = deployment.summary(*read, REFERENCE, deployment.ZONES)
    return found.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


def _snapshots(spark, sf_dir):
    """Facts of both snapshots, stored by name; the first is stored twice and replaces itself."""
    store = snapshots.open_store(spark, _folder(spark), REFERENCE, 8)
    for v, date in ((1, fixtures.FIRST), (2, fixtures.LAST), (1, fixtures.FIRST)):
        spf, mx = (lines(spark, sf_dir, v).select("value", "snapshot_date") for lines in (fixtures.spf_lines, fixtures.mx_lines))
        store.write(scans.parse_spf(spf, REFERENCE), scans.parse_mx(mx, REFERENCE), [date])
    stored = store.summary().where(F.col("tld").isin(*deployment.ZONES))
    return stored.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


def _incremental(spark, sf_dir):
    """The report of the first snapshot alone, then of both, which reads the second one's files only."""
    scanned = []
    for v, date in ((1, fixtures.FIRST), (2, fixtures.LAST)):
        paths = [_folder(spark) for _ in range(2)]
        for lines, path in zip((fixtures.spf_lines, fixtures.mx_lines), paths):
            lines(spark, sf_dir, v).select("value").write.text(path)
        scanned.append((date, *paths))
    out = _folder(spark)
    for n in (1, 2):
        deployment_report.run(spark, scanned[:n], out, REFERENCE, deployment.ZONES, incremental=True)
    stored = summary.read_summary(spark, f"{out}/summary")
    return stored.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


QUERIES = {
    "stored_snapshots": _snapshots,
    "stored_incremental_report": _incremental,
    "stored_summary": _summary,
    "stored_histogram": _histogram,
    "stored_cdf": _cdf,
    "stored_log_directories": _log_directories,
    "stored_scan_files": _scan_files,
}

SQL = {
    "stored_snapshots": scan_queries.SQL["snapshot_summary_long"],
    "stored_incremental_report": scan_queries.SQL["snapshot_summary_long"],
    "stored_summary": scan_queries.SQL["snapshot_summary_long"],
    "stored_histogram": report_queries.SQL["lookup_histogram"],
    "stored_cdf": f"""WITH h AS (SELECT lookups, n FROM ({report_queries.SQL['lookup_histogram']}) WHERE series = 'all')
        SELECT lookups, ROUND(SUM(n) OVER (ORDER BY lookups) / SUM(n) OVER (), 6) AS cdf FROM h""",
    "stored_log_directories": f"""{log_queries.EVENTS}
        SELECT sent || '.{fixtures.DOMAIN}' AS qname, rr_type, COUNT(*) AS n FROM log WHERE NOT bad GROUP BY ALL""",
    "stored_scan_files": f"SELECT * FROM ({scan_queries.SQL['snapshot_summary_long']}) WHERE snapshot_date = '{fixtures.FIRST}'",
}
