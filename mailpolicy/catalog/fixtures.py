"""Input text derived from the given tables by arithmetic on their columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST, LAST = "2021-10-13", "2023-03-19"
DOMAIN = "dmarc.example.net"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table to make text from, spread over all cores: text is much longer than the columns it is made from."""
    return table(spark, sf_dir, name).select(*columns).repartition(spark.sparkContext.defaultParallelism)


def spf_lines(spark: SparkSession, sf_dir: str, snapshot: int) -> DataFrame:
    """TXT scan lines, one per customer: ``k, segment, value, snapshot_date``. Some lines are broken, some names have no policy."""
    v = snapshot
    base = _spread(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").selectExpr(
        "c_custkey AS k", "c_mktsegment AS segment"
    ).selectExpr(
        "k", "segment", "concat('d', k, '.', element_at(array('com', 'net', 'org', 'se', 'io'), int(k % 5) + 1)) AS name"
    )
    terms = f"""concat_ws(' ', 'v=spf1',
        if(k % 2 = 0, 'a', null),
        if(k % 7 < 3, 'mx', null),
        if(k % 11 < 4 + 2 * {v}, concat('include:', if(k % 22 < 11, '_spf.p', 'spf-'), k % 6, '.net'), null),
        if(k % 9 = 0, concat('include:sub.', name), null),
        if(k % 13 < 5, concat('+ip4:192.0.2.', k % 250), null),
        if(k % 17 < 3, concat('ip6:2001:db8::', k % 9), null),
        if(k % 19 = 0, 'ptr', null),
        if(k % 23 = 0, 'exists:%{{i}}.x.net', null),
        if(k % 29 = 0, 'redirect=_r.x.org', null),
        if(k % 31 = 0, 'exp=e.x.org', null),
        if(k % 37 <> 0, '-all', null))"""
    return base.selectExpr(
        "k",
        "segment",
        f"""if(k % 50 = 49, '{{broken', concat('{{"name":"', name, '.","data":{{"answers":[{{"type":"TXT","answer":"',
            if(k % (2 + {v}) <> 0, {terms}, 'google-site'), '"}}]}}}}')) AS value""",
        f"date '{FIRST if v == 1 else LAST}' AS snapshot_date",
    )


def mx_lines(spark: SparkSession, sf_dir: str, snapshot: int) -> DataFrame:
    """MX scan lines, one per customer: ``value, snapshot_date``. Some names have an address only."""
    return _spread(spark, sf_dir, "customer", "c_custkey").selectExpr("c_custkey AS k").selectExpr(
        """concat('["d', k, '.', element_at(array('com', 'net', 'org', 'se', 'io'), int(k % 5) + 1),
            '.",[{"data":{"exchanges":[{"type":"', if(k % 6 <> 1, 'MX', 'A'),
            '","name":"m.d', k, '.com","ipv4_addresses":["192.0.2.1"]}]}}]]') AS value""",
        f"date '{FIRST if snapshot == 1 else LAST}' AS snapshot_date",
    )


def spf_lines_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First snapshot where names of households have a second policy and a second line."""
    lines = spf_lines(spark, sf_dir, 1)
    second = ',{"type":"TXT","answer":"v=spf1 ip4:192.0.2.1 mx ~all"}]}}'
    more = F.when(
        F.col("segment") == "HOUSEHOLD", F.replace("value", F.lit("]}}"), F.lit(second))
    ).otherwise(F.col("value"))
    times = F.when(F.col("segment") == "HOUSEHOLD", 2).otherwise(1)
    return lines.select("snapshot_date", F.explode(F.array_repeat(more, times)).alias("value"))


def mx_lines_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First snapshot where names of machinery customers and of households are listed twice."""
    segments = table(spark, sf_dir, "customer").selectExpr(
        "concat('[\"d', c_custkey, '.', element_at(array('com', 'net', 'org', 'se', 'io'), int(c_custkey % 5) + 1)) AS start",
        "c_mktsegment AS segment",
    )
    rest = '.",[{"data":{"exchanges":[{"type":"MX","name":"m.net"}]}}]]'
    times = F.when(F.col("segment").isin("MACHINERY", "HOUSEHOLD"), 2).otherwise(1)
    line = F.concat("start", F.lit(rest))
    return segments.select(
        F.lit(FIRST).cast("date").alias("snapshot_date"), F.explode(F.array_repeat(line, times)).alias("value")
    )


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluator report lines, one per order; some are repeated, some broken lines are added."""
    o = _spread(spark, sf_dir, "orders", "o_orderkey").selectExpr("o_orderkey AS o", "concat('q', o_orderkey, '.com') AS q")
    error = """CASE o % 8
        WHEN 0 THEN concat('"No TXT record found for ', q, '"')
        WHEN 1 THEN concat('"No SPF record found for ', q, '"')
        WHEN 2 THEN concat('"Unable to look up TXT record for ', q, ': NXDOMAIN"')
        WHEN 3 THEN concat('"Unable to look up TXT record for ', q, ': SERVFAIL"')
        WHEN 4 THEN concat('"Multiple SPF policies found for ', q, '"')
        ELSE '{}' END"""
    errors = """CASE o % 7
        WHEN 0 THEN '["Invalid directive \\'a:\\' found"]'
        WHEN 1 THEN '["Invalid directive \\'a\\' found"]'
        WHEN 2 THEN '["Unknown directive \\'foo\\'", "Unknown directive \\'bar\\'"]'
        WHEN 3 THEN '["Recursive inclusion of \\'x.com\\'."]'
        WHEN 4 THEN '["Too many DNS lookups (12/10)"]'
        WHEN 5 THEN if(o % 2 = 0, '["Invalid definition \\'ip4\\' for domain \\'q.com\\'."]', '[]')
        ELSE if(o % 2 = 0, '["Invalid IP \\'300.1.1.1\\' in \\'ip4\\'", "Recursive inclusion of \\'y.com\\'."]', '[]')
        END"""
    warnings = """CASE o % 6
        WHEN 0 THEN '["No MX record for domain \\'m.com\\'"]'
        WHEN 1 THEN '["Unable to look up TXT record for \\'t.com\\'"]'
        WHEN 2 THEN '["The \\'all\\' directive is not last in \\'x.com\\' policy - ignoring  subsequent directives."]'
        ELSE '[]' END"""
    own = f"""concat('"', q, '":{{', if(o % 23 = 0, '', concat('"spf":"v=spf1 ', if(o % 3 = 0, 'include:x.net ', ''), '-all",')),
        '"errors":', {errors}, ',"warnings":', {warnings},
        ',"pass":{{"a":{{"ips":[', if(o % 9 = 0, '', '"192.0.2.1"'), ']}}}}}}')"""
    other = """if(o % 5 = 0, '', concat(',"inc.net":{"spf":"v=spf1 -all"', if(o % 5 = 1, '', ',"errors":[]'),
        if(o % 5 = 2, '', ',"warnings":[]'),
        ',"softfail":{"a":{"ips":', if(o % 5 = 3, 'null', '["192.0.2.9"]'), '}}}'))"""
    line = f"""concat('{{"query":"', q, '","error":', {error},
        if(o % 8 < 5, '', concat(',"lookups":', o % 15, ',"expanded":{{', {own}, {other}, '}}')), '}}')"""
    lines = o.selectExpr("o", f"{line} AS line")
    return lines.selectExpr(
        "explode(array_compact(array(line, if(o % 10 = 0, line, null), if(o % 97 = 96, '{broken', null)))) AS value"
    )


def name_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name list over the orders that are not pending; urgent ones twice, those of low priority without the last dot."""
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").selectExpr(
        """explode(array_repeat(concat('q', o_orderkey, '.com', if(o_orderpriority = '5-LOW', '', '.')),
            if(o_orderpriority = '1-URGENT', 2, 1))) AS value"""
    )


def include_lines(spark: SparkSession, sf_dir: str, over: int | None = None) -> DataFrame:
    """Include-count lines, one target per customer with orders; ``over`` keeps counts above it. Some indices fit no int."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    if over is not None:
        counts = counts.where(F.col("n") > over)
    index = "case o_custkey % 3 when 0 then string(o_custkey + 2147483648) when 1 then concat('x', o_custkey) else string(o_custkey) end"
    return counts.selectExpr(f"concat({index}, ' _spf.p', o_custkey, '.net ', n) AS value")


def include_lines_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per customer and order status, so that a target occurs up to three times; status gives the order."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return counts.selectExpr(
        "o_orderstatus AS line_no", "concat(o_custkey, '  _spf.p', o_custkey, '.net  ', n) AS value"
    )


_SERVER = "substr(md5(string(bigint(floor(sqrt(user_id))))), 1, 16)"


def id_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated pieces of the server id list with their position: ``pos, value``."""
    servers = table(spark, sf_dir, "events").selectExpr("bigint(floor(sqrt(user_id))) AS pos").distinct()
    return servers.selectExpr("pos", "concat(' \"', substr(md5(string(pos)), 1, 16), '\"') AS value")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query-log lines, one per event: ``e, value``."""
    events = _spread(spark, sf_dir, "events", "event_id", "ts", "user_id").selectExpr(
        "event_id AS e",
        "ts",
        f"substr(md5(concat(event_id % 51, '.test', 1 + (event_id div 51) % 2, '.', {_SERVER})), 1, 8) AS label",
    ).selectExpr(
        "e",
        "ts",
        "concat(CASE WHEN e % 29 = 0 THEN 'zzzzzzzz' WHEN e % 19 = 0 THEN upper(label) ELSE label END,"
        f" '.{DOMAIN}') AS qname",
    )
    return events.selectExpr(
        "e",
        """if(e % 500 = 499, 'short line', concat(date_format(ts, 'dd-MMM-yyyy HH:mm:ss.SSS'), ' client @0x7f 192.0.2.', e % 250,
            '#5353 (', qname, '): query: ', qname, ' IN ', if(e % 13 = 0, 'A', 'TXT'), ' -E(0) (203.0.113.1)')) AS value""",
    )


def odd_spf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT scan lines, one per part, of eight shapes that look like a policy or a mechanism and are none, or the other way round."""
    base = _spread(spark, sf_dir, "part", "p_partkey").selectExpr("p_partkey AS k", f"{ODD_NAME} AS name")
    answers = """CASE k % 8
        WHEN 0 THEN '{"type":"TXT","answer":"v=spf10 a"}'
        WHEN 1 THEN '{"type":"TXT","answer":"V=SPF1 MX -ALL"}'
        WHEN 2 THEN '{"type":"TXT","answer":"v=spf1 a/24 ~all"}'
        WHEN 3 THEN '{"type":"TXT","answer":"v=spf1 mxfoo allx"}'
        WHEN 4 THEN concat('{"type":"TXT","answer":"v=spf1 include:not', name, ' -all"}')
        WHEN 5 THEN '{"type":"TXT","answer":"v=spf1 include: -all"}'
        WHEN 6 THEN '{"answer":"without type"},{"type":"TXT","answer":"v=spf1 a -all"}'
        ELSE '{"type":"TXT","answer":"v=spf1 ip4:192.0.2.1 -all"},{"answer":"without type"}' END"""
    return base.selectExpr(
        f"""concat('{{"name":"', name, '.","data":{{"answers":[', {answers}, ']}}}}') AS value""",
        f"date '{FIRST}' AS snapshot_date",
    )


ODD_NAME = "concat(if(k % 3 = 0, 'w.', ''), 'n', k, if(k % 3 = 1, '.co.se', '.com'))"


def odd_mx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MX scan lines, one per part; of every tenth the records are cut off."""
    base = _spread(spark, sf_dir, "part", "p_partkey").selectExpr("p_partkey AS k", f"{ODD_NAME} AS name")
    return base.selectExpr(
        "k",
        """concat('["', name, '.",[{"data":{"exchanges":[{"type":"MX","name":"m.net"}', if(k % 10 = 9, '', ']}}]]')) AS value""",
        f"date '{FIRST}' AS snapshot_date",
    )


def customer_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report lines, one per order, by customer: many lines of a name, some of them equal; one label has two classes."""
    warnings = """CASE o % 3
        WHEN 0 THEN '["Unable to look up TXT record for \\'t.com\\'"]'
        WHEN 1 THEN '["Unable to look up TXT record of \\'t.com\\'"]'
        ELSE '["Unable to look up TXT record of \\'t.com\\'", "Unable to look up TXT record for \\'t.com\\'"]' END"""
    orders = _spread(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return orders.selectExpr("o_orderkey AS o", "concat('c', o_custkey, '.com') AS q").selectExpr(
        f"""concat('{{"query":"', q, '","error":{{}},"lookups":', o % 15, ',"expanded":{{"', q,
            '":{{"spf":"v=spf1 -all","errors":[],"warnings":', {warnings}, '}}}}}}') AS value"""
    )


def customer_name_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name list of the customers, every fourth one twice."""
    return table(spark, sf_dir, "customer").selectExpr(
        "explode(array_repeat(concat('c', c_custkey, '.com.'), if(c_custkey % 4 = 0, 2, 1))) AS value"
    )


def log_lines_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query-log lines of which some have a date that no calendar has: ``e, value``."""
    return log_lines(spark, sf_dir).selectExpr(
        "e", "if(e % 97 = 5, regexp_replace(value, '^[0-9]+-[A-Za-z]+', '31-Feb'), value) AS value"
    )


def numbered_id_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the server id list as they come from a split file: ``value, split, row``; every fifth is null."""
    return id_pieces(spark, sf_dir).selectExpr(
        "if(pos % 5 = 4, ' null', value) AS value", "pos div 4 AS split", "pos AS row"
    )


def odd_id_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands between the commas of one array of strings, one string per part, some with commas, quotes and brackets: ``value, split, row``."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS k").selectExpr(
        "k",
        """concat(' ', CASE k % 6 WHEN 0 THEN 'null'
            WHEN 1 THEN concat('"a', k, '"') WHEN 2 THEN concat('"b,', k, ',"') WHEN 3 THEN concat('"c\\\\\",', k, '\\\\\\\\"')
            WHEN 4 THEN concat('"[', k, '],"') ELSE concat('"null', k, '"') END) AS text""",
    )
    # As files are cut: three pieces in a split, wherever that falls.
    pieces = parts.select("k", F.posexplode(F.split("text", ",")).alias("i", "value")).withColumn("row", F.col("k") * 10 + F.col("i"))
    return pieces.selectExpr("value", "row div 25 AS split", "row")


def server_count_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``server total void`` lines, one per user; of every ninth the total is no number."""
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("void")
    )
    return counts.selectExpr(
        "user_id", "concat('u', user_id, if(user_id % 9 = 8, ' many ', concat('  ', total, ' ')), void) AS value"
    )


def include_lines_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Include-count lines, one per customer: some without an index, some without a number."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS k",
        "concat(if(c_custkey % 7 = 0, '', concat(c_custkey, ' ')), '_spf.p', c_custkey, '.net ', if(c_custkey % 11 = 0, 'x', string(c_custkey))) AS value",
    )
