"""Queries over exact splits and nested payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.operators import payloads as pl
from tellurion.operators import splits as sp
from tellurion.sources.views import table

QUERIES, ORACLES = {}, {}
SEED = 42


def add(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ---- splits ---------------------------------------------------------------------------------

_GROUPS = f"""g AS (SELECT o_orderpriority AS source, o_custkey AS grp, count(*) AS n FROM orders GROUP BY ALL),
  t AS (SELECT source, sum(n)::BIGINT * 7 // 10 AS train, sum(n)::BIGINT // 5 AS val, sum(n)::BIGINT - sum(n)::BIGINT * 7 // 10 - sum(n)::BIGINT // 5 AS test FROM g GROUP BY source),
  o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('{SEED}|' || source || '|' || grp), grp) AS k FROM g),
  f AS (SELECT source, 0::BIGINT AS k, NULL::BIGINT AS grp, 0::BIGINT AS n, NULL::VARCHAR AS split, train::BIGINT AS a, val::BIGINT AS b, test::BIGINT AS c FROM t
        UNION ALL SELECT o.source, o.k, o.grp, o.n, CASE WHEN o.n <= a THEN 'train' WHEN o.n <= b THEN 'val' WHEN o.n <= c THEN 'test' END,
          CASE WHEN o.n <= a THEN a - o.n ELSE a END, CASE WHEN o.n > a AND o.n <= b THEN b - o.n ELSE b END, CASE WHEN o.n > a AND o.n > b AND o.n <= c THEN c - o.n ELSE c END
        FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1),
  s AS (SELECT source, grp, n, split FROM f WHERE k > 0)"""


def _groups(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    all_ = F.sum("n")
    t = g.groupBy("source").agg(F.floor(all_ * 7 / 10).alias("train"), F.floor(all_ / 5).alias("val"), all_.alias("_n"))
    return g, t.withColumn("test", F.col("_n") - F.col("train") - F.col("val")).drop("_n")


@add("exact_splits", f"WITH RECURSIVE {_GROUPS} SELECT source, grp, n, split FROM s")
def exact_splits(spark, sf):
    """Customers of each priority to splits of exactly 70, 20 and 10 percent of its orders."""
    return sp.exact_splits(*_groups(spark, sf), SEED)


@add("exact_split_report", f"""WITH RECURSIVE {_GROUPS}, w AS (SELECT source, unnest(['train', 'val', 'test', NULL]) AS split, unnest([train, val, test, 0]) AS target FROM t),
  c AS (SELECT source, split, sum(n)::BIGINT AS n, count(*) AS groups FROM s GROUP BY ALL)
  SELECT w.source, w.split, target::BIGINT AS target, coalesce(c.n, 0)::BIGINT AS rows, coalesce(groups, 0)::BIGINT AS groups, (target - coalesce(c.n, 0))::BIGINT AS short, target = coalesce(c.n, 0) AS exact
  FROM w LEFT JOIN c ON c.source = w.source AND c.split IS NOT DISTINCT FROM w.split""")
def exact_split_report(spark, sf):
    """Targets, rows and what is short in every split."""
    g, t = _groups(spark, sf)
    return sp.split_report(sp.exact_splits(g, t, SEED), t)


@add("split_leakage", f"""WITH RECURSIVE {_GROUPS}, r AS (SELECT o_custkey AS grp, o_orderkey AS sample, o_orderdate AS chip, split FROM orders LEFT JOIN s ON source = o_orderpriority AND grp = o_custkey)
  SELECT *, leaking_groups > 0 AS leaks FROM (SELECT (SELECT count(*) FROM r) AS rows_checked, (SELECT count(*) FROM r WHERE split IS NULL) AS unassigned, (SELECT count(*) FROM (SELECT grp FROM r GROUP BY grp HAVING count(DISTINCT split) > 1)) AS leaking_groups,
    (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM r GROUP BY sample)) AS repeated_sample, (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY sample HAVING count(DISTINCT split) > 1)) AS leaking_sample,
    (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM r WHERE chip IS NOT NULL GROUP BY chip)) AS repeated_chip, (SELECT count(*) FROM (SELECT 1 FROM r WHERE chip IS NOT NULL GROUP BY chip HAVING count(DISTINCT split) > 1)) AS leaking_chip)""")
def split_leakage(spark, sf):
    """Customers in more than one split over all priorities, repeated orders and days."""
    s = sp.exact_splits(*_groups(spark, sf), SEED)
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("sample"), F.col("o_orderdate").alias("chip"))
    return sp.leakage_report(o.join(s.select("source", "grp", "split"), ["source", "grp"], "left"), "split", "grp", ["sample", "chip"])


# ---- payloads -------------------------------------------------------------------------------


def _payloads(spark, sf):
    """A nested payload for every order: its lines as features, a place, paths, digests and what changes from run to run."""
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").alias("q")))).alias("lines"))  # noqa: E741
    feature = lambda x: F.struct(
        F.struct(F.concat(F.lit("part "), x["l_partkey"].cast("string"), F.lit(" line "), x["l_linenumber"].cast("string")).alias("name"), (x["q"] / 7).alias("part_of")).alias("properties"),
        F.struct(F.lit("Point").alias("type")).alias("geometry"))
    k = F.col("o_orderkey")
    body = F.struct(
        F.concat(F.lit("run "), k.cast("string"), F.lit(' "quoted" /home/u'), (k % 9).cast("string"), F.lit("/a.tif")).alias("note"), F.struct((k % 90).alias("lat"), F.array(k % 80, k % 170).alias("center"), F.lit("12, 99").alias("text"), F.array(k % 80, k % 500).alias("size")).alias("location"),
        F.sha2(F.encode(k.cast("string"), "UTF-8"), 256).alias("sha256"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.transform("lines", feature).alias("features"), F.col("o_totalprice").alias("amount"))
    return table(spark, sf, "orders").hint("merge").join(l, "o_orderkey").select("o_orderkey", F.to_json(body).alias("payload"))


_LINES = """l AS (SELECT l_orderkey AS o_orderkey, list({'n': l_linenumber, 'p': l_partkey, 'q': l_quantity} ORDER BY l_linenumber, l_partkey, l_quantity) AS lines FROM lineitem GROUP BY 1),
  o AS (SELECT o_orderkey, o_totalprice, lines, list_sort(list_transform(lines, lambda x: {'k': 'part ' || x.p || ' line ' || x.n, 'n': x.n, 's': replace(round(x.q / 7, 8)::VARCHAR, 'e', 'E')})) AS named FROM orders JOIN l USING (o_orderkey))"""


@add("payload_redacted", f"""WITH {_LINES} SELECT o_orderkey, '{{"amount":' || o_totalprice || ',"created_at":' || (SELECT '"' || strftime(o_orderdate, '%Y-%m-%d') || '"' FROM orders x WHERE x.o_orderkey = o.o_orderkey) || ',"features":[' ||
    array_to_string(list_transform(lines, lambda x: '{{"properties":{{"name":"part ' || x.p || ' line ' || x.n || '","part_of":' || round(x.q / 7, 8) || '}}}}'), ',') || '],"location":{{"center":"[REDACTED_COORDS]","size":' ||
    CASE WHEN o_orderkey % 500 <= 180 THEN '"[REDACTED_COORDS]"' ELSE '[' || o_orderkey % 80 || ',' || o_orderkey % 500 || ']' END || ',"text":"[REDACTED_COORDS]"}},"note":"run ' || o_orderkey || ' \\"quoted\\" [REDACTED_PATH]"}}' AS redacted FROM o""")
def payload_redacted(spark, sf):
    """Payloads without places, paths and digests."""
    return pl.redacted(_payloads(spark, sf), "payload").drop("payload")


@add("payload_canonical", f"""WITH {_LINES} SELECT o_orderkey, '{{"amount":' || o_totalprice || ',"features":[' ||
    array_to_string(list_transform(named, lambda x: '{{"geometry":{{"type":"Point"}},"properties":{{"name":"' || x.k || '","part_of":' || x.s || '}}}}'), ',') || '],"location":{{"center":[' || o_orderkey % 80 || ',' || o_orderkey % 170 || '],"lat":' || o_orderkey % 90 ||
    ',"size":[' || o_orderkey % 80 || ',' || o_orderkey % 500 || '],"text":"12, 99"}},"note":"run ' || o_orderkey || ' \\"quoted\\" /home/u' || o_orderkey % 9 || '/a.tif"}}' AS canonical FROM o""")
def payload_canonical(spark, sf):
    """Payloads in their canonical text."""
    return pl.canonical(_payloads(spark, sf), "payload").drop("payload")


@add("payload_violations", f"""WITH {_LINES}, v AS (
    SELECT o_orderkey, unnest([{{'path': '.sha256', 'rule': 'key'}}, {{'path': '.location.lat', 'rule': 'key'}}, {{'path': '.location.center', 'rule': 'coordinates'}}, {{'path': '.location.text', 'rule': 'text'}}, {{'path': '.note', 'rule': 'text'}}]) AS f FROM o
    UNION ALL SELECT o_orderkey, {{'path': '.location.size', 'rule': 'coordinates'}} FROM o WHERE o_orderkey % 500 <= 180
    UNION ALL SELECT o_orderkey, {{'path': '.features#' || unnest(range(len(lines))) || '.geometry', 'rule': 'key'}} FROM o)
  SELECT f.path AS path, f.rule AS rule, o_orderkey FROM v""")
def payload_violations(spark, sf):
    """What redaction takes out or changes, with its path."""
    return pl.violations(_payloads(spark, sf), "payload").drop("payload")
