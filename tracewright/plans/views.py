"""The driver's tables as traces, intervals, values and calls. Each view has a twin in ``SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import exponent
from tracewright.operators import counts, intervals, trace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir) -> DataFrame:
    """Users as threads, event types as blocks."""
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("block"))


def wide(spark, sf_dir) -> DataFrame:
    """Event types split by the exponent of their value: a sparser graph."""
    block = F.concat_ws("/", "event_type", exponent(F.col("value")).cast("string"))
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), "ts", F.col("event_id").alias("seq"), block.alias("block"), "event_type", exponent(F.col("value")).alias("exp"))


def orders(spark, sf_dir) -> DataFrame:
    """Customers as threads, status and priority as blocks."""
    block = F.concat_ws("|", "o_orderstatus", "o_orderpriority")
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("thread"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), block.alias("block"))


def turns(spark, sf_dir) -> DataFrame:
    """Conversations as threads, role and turn as blocks: long chains."""
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("ts"), F.lit(0).alias("seq"), F.concat(F.col("role"), F.col("turn").cast("string")).alias("block"))


def moves(spark, sf_dir) -> DataFrame:
    return trace.transitions(events(spark, sf_dir))


def edges(spark, sf_dir) -> DataFrame:
    return counts.weights(counts.edge_counts(moves(spark, sf_dir)))


def wide_edges(spark, sf_dir) -> DataFrame:
    return counts.weights(counts.edge_counts(trace.transitions(wide(spark, sf_dir))))


def turn_edges(spark, sf_dir) -> DataFrame:
    return counts.weights(counts.edge_counts(trace.transitions(turns(spark, sf_dir))))


def accesses(spark, sf_dir) -> DataFrame:
    """Line items as accesses: suppliers as epochs, part keys as addresses, returned lines as reads."""
    rw = F.when(F.col("l_returnflag") == "R", "READ").otherwise("WRITE")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("epoch"), rw.alias("rw"), F.col("l_partkey").alias("base"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))


def spans(spark, sf_dir) -> DataFrame:
    return intervals.coalesce(accesses(spark, sf_dir), "epoch", "rw")


def values(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("epoch"), "value")


def calls(spark, sf_dir) -> DataFrame:
    """Wide blocks as functions: a transition to a value of no greater exponent is a call."""
    w = wide(spark, sf_dir)
    size = w.select("block", "exp").distinct()
    e = counts.edge_counts(trace.transitions(w))
    e = e.join(size.select(F.col("block").alias("src"), F.col("exp").alias("a")), "src").join(size.select(F.col("block").alias("snk"), F.col("exp").alias("b")), "snk")
    return e.where("b <= a").select(F.col("src").alias("caller"), F.col("snk").alias("callee"), "freq")


def votes(spark, sf_dir) -> DataFrame:
    label = F.regexp_extract("props", '"k": *([0-9]+)', 1)
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("block"), label.alias("active"))


def items(spark, sf_dir) -> DataFrame:
    """Def-use graph of keys: regions feed nations, nations customers, customers orders."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = _table(spark, sf_dir, "nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("snk"))
    c = _table(spark, sf_dir, "customer").select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("snk"))
    o = _table(spark, sf_dir, "orders").select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("snk"))
    return n.unionByName(c).unionByName(o)


_EXP = "CAST(CASE WHEN value = 0 THEN 0 WHEN pow(2.0, floor(log2(abs(value))) + 1) <= abs(value) THEN floor(log2(abs(value))) + 1 WHEN pow(2.0, floor(log2(abs(value)))) > abs(value) THEN floor(log2(abs(value))) - 1 ELSE floor(log2(abs(value))) END AS BIGINT)"
_MOVES = "(SELECT * FROM (SELECT *, lag(block) OVER (PARTITION BY thread ORDER BY ts, seq) AS src, block AS snk FROM {t}) WHERE src IS NOT NULL)"
_EDGES = "(SELECT *, freq / sum(freq) OVER (PARTITION BY src) AS weight FROM (SELECT src, snk, count(*) AS freq FROM {m} GROUP BY src, snk))"

#: View name -> (SQL, views it needs).
SQL = {
    "t": ("SELECT user_id AS thread, ts, event_id AS seq, event_type AS block FROM events", ()),
    "m": (f"SELECT * FROM {_MOVES.format(t='t')}", ("t",)),
    "e": (f"SELECT * FROM {_EDGES.format(m='m')}", ("m",)),
    "wt": (f"SELECT user_id AS thread, ts, event_id AS seq, event_type || '/' || CAST({_EXP} AS VARCHAR) AS block, event_type, {_EXP} AS exp FROM events", ()),
    "wm": (f"SELECT * FROM {_MOVES.format(t='wt')}", ("wt",)),
    "we": (f"SELECT * FROM {_EDGES.format(m='wm')}", ("wm",)),
    "ot": ("SELECT o_custkey AS thread, o_orderdate AS ts, o_orderkey AS seq, o_orderstatus || '|' || o_orderpriority AS block FROM orders", ()),
    "ct": ("SELECT conv_id AS thread, turn AS ts, 0 AS seq, role || CAST(turn AS VARCHAR) AS block FROM conversations", ()),
    "cm": (f"SELECT * FROM {_MOVES.format(t='ct')}", ("ct",)),
    "ce": (f"SELECT * FROM {_EDGES.format(m='cm')}", ("cm",)),
    "acc": ("SELECT l_suppkey AS epoch, CASE WHEN l_returnflag = 'R' THEN 'READ' ELSE 'WRITE' END AS rw, l_partkey AS base, l_partkey + CAST(floor(l_quantity) AS BIGINT) AS \"end\" FROM lineitem", ()),
    "iv0": ('SELECT *, max("end") OVER (PARTITION BY epoch, rw ORDER BY base, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM acc', ("acc",)),
    "iv1": ('SELECT *, sum(CASE WHEN pm IS NULL OR base > pm THEN 1 ELSE 0 END) OVER (PARTITION BY epoch, rw ORDER BY base, "end" ROWS UNBOUNDED PRECEDING) AS g FROM iv0', ("iv0",)),
    "iv": ('SELECT epoch, rw, min(base) AS base, max("end") AS "end", count(*) AS ref_count FROM iv1 GROUP BY epoch, rw, g', ("iv1",)),
    "calls": ("SELECT src AS caller, snk AS callee, freq FROM we JOIN (SELECT DISTINCT block, exp AS a FROM wt) x ON we.src = x.block JOIN (SELECT DISTINCT block, exp AS b FROM wt) y ON we.snk = y.block WHERE b <= a", ("we", "wt")),
    "cl": ("SELECT caller AS src, callee AS snk FROM calls UNION SELECT cl.src, c.callee FROM cl JOIN calls c ON cl.snk = c.caller", ("calls",)),
    "nc": ("SELECT caller AS src, callee AS snk FROM calls WHERE caller <> callee UNION SELECT nc.src, c.callee FROM nc JOIN calls c ON nc.snk = c.caller AND c.caller <> c.callee", ("calls",)),
    "tcl": ("SELECT src, snk FROM ce UNION SELECT tcl.src, ce.snk FROM tcl JOIN ce ON tcl.snk = ce.src", ("ce",)),
    "items": ("SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS snk FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders", ()),
    "votes": ("SELECT event_type AS block, regexp_extract(props, '\"k\": *([0-9]+)', 1) AS label, count(*) AS votes FROM events GROUP BY 1, 2", ()),
    "f": ("SELECT snk AS block, sum(freq) AS freq FROM we GROUP BY snk", ("we",)),
    "hot": ("SELECT block, freq FROM (SELECT *, coalesce(sum(freq) OVER (ORDER BY freq DESC, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(freq) OVER () AS total FROM f) WHERE (before < total * 0.95 AND freq > 16) OR freq > 256", ("f",)),
    "bd": ("SELECT DISTINCT src, snk FROM m WHERE src <> snk AND (src IN ('purchase', 'signup')) <> (snk IN ('purchase', 'signup'))", ("m",)),
    "ep": ("SELECT thread, ts, seq, block, CAST(sum(CASE WHEN b.src IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY thread ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM (SELECT *, lag(block) OVER (PARTITION BY thread ORDER BY ts, seq) AS was FROM t) x LEFT JOIN bd b ON x.was = b.src AND x.block = b.snk", ("t", "bd")),
    "epf": ("SELECT thread, epoch, block, count(*) AS freq FROM ep GROUP BY thread, epoch, block", ("ep",)),
    "chain": ("SELECT src, snk FROM ce WHERE src IN (SELECT src FROM ce GROUP BY src HAVING count(*) = 1) AND snk IN (SELECT snk FROM ce GROUP BY snk HAVING count(*) = 1) AND snk IN (SELECT src FROM ce GROUP BY src HAVING count(*) = 1) AND src IN (SELECT snk FROM ce) AND (snk, src) NOT IN (SELECT (src, snk) FROM ce)", ("ce",)),
    "chw": ("SELECT src AS id, src AS o FROM chain UNION SELECT snk, snk FROM chain UNION SELECT w.id, CASE WHEN c.src = w.o THEN c.snk ELSE c.src END FROM chw w JOIN chain c ON w.o IN (c.src, c.snk)", ("chain",)),
    "chm": ("SELECT id, min(o) AS super FROM chw GROUP BY id", ("chw",)),
    "fns": ("SELECT block, event_type AS fn, exp, exp = min(exp) OVER (PARTITION BY event_type) AS is_entry, exp = max(exp) OVER (PARTITION BY event_type) AS returns FROM (SELECT DISTINCT block, event_type, exp FROM wt)", ("wt",)),
    "mem": ("SELECT block, event_type AS section FROM wt UNION SELECT block, 'e' || CAST(exp AS VARCHAR) FROM wt", ("wt",)),
    "pt": ('SELECT base AS p FROM iv UNION SELECT "end" + 1 FROM iv', ("iv",)),
    "sg": ("SELECT p AS sb, lead(p) OVER (ORDER BY p) - 1 AS se FROM pt", ("pt",)),
    "xs": ('SELECT iv.*, sb, se FROM iv JOIN sg ON iv.base <= sg.sb AND iv."end" >= sg.se', ("iv", "sg")),
}
_RECURSIVE = {"cl", "chw", "nc", "tcl"}


def with_views(query: str, *names: str) -> str:
    """``query`` behind the views it names, each after those it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for below in SQL[name][1]:
            add(below)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    word = "WITH RECURSIVE " if _RECURSIVE & set(order) or query.startswith("WITH RECURSIVE ") else "WITH "
    if order and query.startswith("WITH "):  # the query's own views follow the shared ones
        return word + ",\n".join(f"{n} AS ({SQL[n][0]})" for n in order) + ",\n" + query.removeprefix("WITH ").removeprefix("RECURSIVE ")
    return word + ",\n".join(f"{n} AS ({SQL[n][0]})" for n in order) + "\n" + query if order else query
