"""Keyed state with deadlines over all events: leases of tasks, and baselines that expire."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.timed import Baselines, Leases, replayed
from .catalog import Tables, query

_KINDS = {"click": "claim", "view": "renew", "purchase": "done", "error": "fail"}
_HOURS, _END = 12, datetime(2100, 1, 1)


@query("i05_leases", f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'renew' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'fail' ELSE 'add' END AS event, event_id % 2 AS who, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL UNION ALL SELECT key, 'end', -1, 4102444800000000, n + 1 FROM (SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY user_id)),
s AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, 'open' AS status, CAST(-1 AS BIGINT) AS who, CAST(NULL AS BIGINT) AS until, 0 AS reclaims, CAST(NULL AS VARCHAR) AS lapse, CAST(NULL AS VARCHAR) AS change FROM e
  UNION ALL SELECT key, k, CASE change WHEN 'claimed' THEN 'claimed' WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' ELSE status END, CASE WHEN change = 'claimed' THEN new ELSE who END,
    CASE WHEN change IN ('claimed', 'renewed') THEN us + {_HOURS} * 3600000000 WHEN change IN ('done', 'failed') THEN NULL ELSE until END, reclaims, lapse, change
  FROM (SELECT *, CASE WHEN event = 'claim' AND status = 'open' THEN 'claimed' WHEN event = 'claim' THEN 'rejected' WHEN status = 'claimed' AND who = new THEN CASE event WHEN 'renew' THEN 'renewed' WHEN 'done' THEN 'done' WHEN 'fail' THEN 'failed' END END AS change
    FROM (SELECT s.key, e.k, e.event, e.who AS new, e.us, x, s.reclaims + x AS reclaims, CASE WHEN x = 1 THEN CASE WHEN s.reclaims + 1 >= 3 THEN 'failed' ELSE 'open' END ELSE s.status END AS status, CASE WHEN x = 1 THEN -1 ELSE s.who END AS who, CASE WHEN x = 0 THEN s.until END AS until,
        CASE WHEN x = 1 THEN CASE WHEN s.reclaims + 1 >= 3 THEN 'failed' ELSE 'reclaimed' END END AS lapse
      FROM (SELECT s.*, e.k AS nk, CASE WHEN s.until <= e.us THEN 1 ELSE 0 END AS x FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1) s JOIN e ON e.key = s.key AND e.k = s.nk)))
SELECT key, change, count(*) AS n FROM (SELECT key, change FROM s UNION ALL SELECT key, lapse FROM s) WHERE change IS NOT NULL GROUP BY 1, 2""")
def i05(t: Tables) -> DataFrame:
    """Events of users as events of leases that hold twelve hours; how often each change came."""
    event = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in _KINDS.items()), F.lit("add"))
    e = t.events.select("user_id", "ts", F.col("event_id").alias("seq"), event.alias("event"), (F.col("event_id") % 2).cast("string").alias("worker"))
    return replayed(e, Leases(_HOURS * 3600, 3), "user_id", _END).groupBy("key", "change").agg(F.count("*").alias("n"))


@query("i02_baselines", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id, event_type = 'signup' AS store, event_id // 40 % 2 AS head, event_id % 9 = 0 AS stash, event_id % 13 AS changed FROM events WHERE ts IS NOT NULL),
g AS (SELECT *, count(*) FILTER (WHERE store) OVER w AS seg FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT key, seg, ts AS t0, head AS h0, stash AS s0, changed AS c0, lead(ts) OVER (PARTITION BY key ORDER BY seg) AS t1 FROM g WHERE store),
p AS (SELECT g.key, g.seg, g.ts, g.event_id, b.t0, CASE WHEN b.t0 IS NULL THEN 'missing' WHEN g.ts >= b.t0 + INTERVAL 6 HOUR THEN 'late' WHEN g.head <> b.h0 THEN 'head' WHEN g.stash <> b.s0 THEN 'stash' WHEN b.c0 <= 10 AND g.changed > 10 THEN 'files' ELSE 'valid' END AS why
  FROM g LEFT JOIN b ON b.key = g.key AND b.seg = g.seg WHERE NOT g.store),
q AS (SELECT *, count(*) FILTER (WHERE why IN ('head', 'stash', 'files')) OVER (PARTITION BY key, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM p),
r AS (SELECT key, CASE WHEN why IN ('late', 'missing') OR gone > 0 THEN 'missing' ELSE why END AS change FROM q UNION ALL SELECT key, 'stored' FROM b
  UNION ALL SELECT b.key, 'expired' FROM b LEFT JOIN (SELECT DISTINCT key, seg FROM p WHERE why IN ('head', 'stash', 'files')) d ON d.key = b.key AND d.seg = b.seg WHERE d.key IS NULL AND (b.t1 IS NULL OR b.t1 >= b.t0 + INTERVAL 6 HOUR))
SELECT key, change, count(*) AS n FROM r GROUP BY 1, 2""")
def i02(t: Tables) -> DataFrame:
    """Events of users as a repository's: a signup stores a baseline that holds six hours, others ask for it; how often each answer came."""
    kind = F.when(F.col("event_type") == "signup", "store").otherwise("probe")
    e = t.events.select("user_id", "ts", F.col("event_id").alias("seq"), kind.alias("event"), F.floor(F.col("event_id") / 40 % 2).cast("string").alias("head"), (F.col("event_id") % 9 == 0).cast("string").alias("stash"), (F.col("event_id") % 13).alias("changed"))
    return replayed(e, Baselines(6 * 3600, 10), "user_id", _END).groupBy("key", "change").agg(F.count("*").alias("n"))


_LOG = """c AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS hash, o_custkey, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey % 11 = 0 AS merge,
  CASE o_orderkey % 7 WHEN 0 THEN 'Implement new login page' WHEN 1 THEN 'fix crash' WHEN 2 THEN 'Add two tests' WHEN 3 THEN 'feat: faster' WHEN 4 THEN 'Work' || chr(10) || chr(10) || 'Co-authored-by: Claude <x@y.z>' ELSE 'Work' END AS message FROM orders),
l AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem), w AS (SELECT max(ts) - INTERVAL 400 DAY AS since FROM c)"""


@query("s07_commit_log", f"""WITH {_LOG}, f AS (SELECT k, count(*) FILTER (WHERE s % 3 <> 0) AS n, CAST(sum(CASE WHEN s % 3 <> 0 THEN s % 50 ELSE 0 END) AS BIGINT) AS ins FROM l GROUP BY k)
SELECT hash, CAST(coalesce(n, 0) AS BIGINT) AS n_files, coalesce(ins, 0) AS insertions, merge AS is_merge, message ILIKE '%fix%' AS is_defect, CAST(CASE k % 7 WHEN 0 THEN 0.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.5 WHEN 4 THEN 0.95 ELSE 0.0 END AS DOUBLE) AS confidence
FROM c JOIN w ON ts >= since LEFT JOIN f USING (k)""")
def s07(t: Tables) -> DataFrame:
    """Orders written as the records of a commit log, read back: the last 400 days, files below ``app`` only, with the classes of each commit."""
    from ..sources import commit_log as L

    o = t.orders
    k = F.col("o_orderkey")
    name = lambda c: F.lpad(c.cast("string"), 12, "0")
    message = F.when(k % 7 == 0, "Implement new login page").when(k % 7 == 1, "fix crash").when(k % 7 == 2, "Add two tests").when(k % 7 == 3, "feat: faster").when(k % 7 == 4, "Work\n\nCo-authored-by: Claude <x@y.z>").otherwise("Work")
    s = F.col("l_suppkey")
    line = F.concat(F.when(s % 50 == 0, "-").otherwise((s % 50).cast("string")), F.lit("\t0\t"), F.when(s % 3 == 0, "lib/f").otherwise("app/f"), s.cast("string"))
    stat = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_set(line), "\n").alias("stat"))  # an order has few lines
    parents = F.when(k % 11 == 0, "p1 p2").otherwise("p1")
    raw = o.join(stat, "o_orderkey", "left").select(F.concat_ws("\x1f", name(k), parents, F.col("o_custkey").cast("string"), F.lit("a@b.c"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), message, F.concat(F.lit("\n"), F.coalesce("stat", F.lit("")))).alias("value"))
    last = F.lit(o.agg(F.max(F.col("o_orderdate").cast("timestamp"))).first()[0])
    c = L.classified(L.parse_log(raw, since=F.timestamp_add("DAY", F.lit(-400), last), prefix="app"), 0.1)
    return c.select("hash", F.size("files").cast("long").alias("n_files"), F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["insertions"]).alias("insertions"), "is_merge", "is_defect", "confidence")
