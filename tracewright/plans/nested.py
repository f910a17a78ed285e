"""Queries of nested section instances, late events and deep expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import expressions, iterate, running, sections

from . import views as V
from .queries import _shared, query

#: Sections of the wide trace: name, parent, condition on event type and exponent (least first).
SECTIONS = (
    ("big", None, "exp >= 3"),
    ("bigger", "big", "exp >= 5"),
    ("biggest", "bigger", "exp >= 6"),
    ("sale", None, "event_type = 'purchase'"),
    ("small sale", "sale", "event_type = 'purchase' AND exp < 2"),
)
_MEMBERS = " UNION ".join(f"SELECT block, '{s}' AS section FROM wt WHERE {c}" for s, _, c in SECTIONS)
_ROOT = "CASE WHEN section LIKE 'big%' THEN 'big' ELSE 'sale' END"
_PARENT = "CASE section " + " ".join(f"WHEN '{s}' THEN '{p}'" for s, p, _ in SECTIONS if p) + " END"
_TREE = f"""ms AS ({_MEMBERS}),
sx AS (SELECT thread, ts, seq, block, coalesce(now, []) AS now, coalesce(lag(now) OVER (PARTITION BY thread ORDER BY ts, seq), []) AS was FROM wt LEFT JOIN (SELECT block, list(section) AS now FROM ms GROUP BY block) USING (block)),
sr AS (SELECT thread, ts, seq, block, section, {_ROOT} AS root, NOT list_contains(was, section) AS fresh FROM (SELECT *, unnest(now) AS section FROM sx)),
sk AS (SELECT thread, seq, root, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY thread, root ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS stay FROM sr WHERE section = root),
sh AS (SELECT DISTINCT section, block FROM sr WHERE fresh),
sg0 AS (SELECT thread, root, stay, section, count(*) FILTER (fresh) AS entries, count(*) FILTER (NOT fresh AND (section, block) IN (SELECT (section, block) FROM sh)) AS iterations, count(*) AS steps, min_by(seq, (ts, seq)) AS seq, min(ts) AS ts FROM sr JOIN sk USING (thread, seq, root) GROUP BY ALL),
sn AS (SELECT *, row_number() OVER (PARTITION BY thread, section ORDER BY ts, seq) AS instance, {_PARENT} AS parent FROM sg0),
tree AS (SELECT a.thread, a.section, a.instance, a.parent, b.instance AS parent_instance, a.entries, a.iterations, a.steps, a.seq, a.ts FROM sn a LEFT JOIN sn b ON b.thread = a.thread AND b.stay = a.stay AND b.section = a.parent)"""

#: A week: the event tables span some months.
WEEK = 7 * 86400


def _nested(spark, sf_dir):
    w = V.wide(spark, sf_dir)
    named = F.array(*(F.when(F.expr(c), F.lit(s)) for s, _, c in SECTIONS))
    members = w.select("block", F.explode(F.array_compact(named)).alias("section")).distinct()
    hierarchy = spark.createDataFrame([(p, s) for s, p, _ in SECTIONS if p], "parent string, child string")
    return w, members, hierarchy


@query(f"WITH {_TREE} SELECT thread, section, instance, parent, parent_instance, entries, iterations, steps, seq FROM tree", "wt")
def instance_tree(spark, sf_dir):
    """Values of high exponents and purchases as nested kernels of the wide trace, threads cut by weeks."""
    return sections.instance_tree(*_nested(spark, sf_dir), WEEK).drop("ts")


_NODE = "substr(to_json({{'section': {0}.section, 'instance': {0}.instance, 'entries': {0}.entries, 'iterations': {0}.iterations, 'steps': {0}.steps}}), 1, length(to_json({{'section': {0}.section, 'instance': {0}.instance, 'entries': {0}.entries, 'iterations': {0}.iterations, 'steps': {0}.steps}})) - 1) || ',\"children\":['"


@query(f"""WITH {_TREE},
d2 AS (SELECT thread, parent_instance AS i, string_agg({_NODE.format("c")} || ']}}', ',' ORDER BY ts, seq) AS kids FROM tree c WHERE section = 'biggest' GROUP BY ALL),
d1 AS (SELECT c.thread, c.parent, c.parent_instance AS i, string_agg({_NODE.format("c")} || coalesce(kids, '') || ']}}', ',' ORDER BY ts, seq) AS kids
    FROM tree c LEFT JOIN d2 ON c.section = 'bigger' AND d2.thread = c.thread AND d2.i = c.instance WHERE section IN ('bigger', 'small sale') GROUP BY ALL)
SELECT c.thread, c.section, c.instance, {_NODE.format("c")} || coalesce(kids, '') || ']}}' AS document
FROM tree c LEFT JOIN d1 ON d1.thread = c.thread AND d1.parent = c.section AND d1.i = c.instance WHERE c.parent IS NULL""", "wt")
def instance_documents(spark, sf_dir):
    return sections.hierarchy_documents(sections.instance_tree(*_nested(spark, sf_dir), WEEK))


@query(f"""WITH ms AS ({_MEMBERS}),
o AS (SELECT thread, ts, seq, block, block IN (SELECT block FROM ms) AS inside FROM wt),
g AS (SELECT *, sum(CASE WHEN inside THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM o),
r AS (SELECT thread, run, array_to_string(list(DISTINCT block ORDER BY block), ',') AS blocks, min_by(block, (ts, seq)) AS first_block FROM g WHERE NOT inside GROUP BY ALL)
SELECT blocks, first_block, count(*) AS runs FROM r GROUP BY ALL""", "wt")
def outside_runs(spark, sf_dir):
    """Stretches outside all sections, told apart by blocks and beginning."""
    w, members, _ = _nested(spark, sf_dir)
    return sections.outside_runs(w, members, WEEK).withColumn("blocks", F.array_join("blocks", ","))


# Expressions


@query("""WITH o AS (SELECT *, list(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS l FROM orders),
t AS (SELECT len(l) - 1 AS level, array_to_string(list_transform(list_reverse(l[2:]), lambda x: x || '('), '') || 'v' || l[1] || repeat(')', len(l) - 1) AS text FROM o)
SELECT level, text, count(*) AS insts FROM t GROUP BY ALL""")
def order_expressions(spark, sf_dir):
    """Each order applies its status to the customer's order before: histories with a common beginning share its expressions."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("thread"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("op"))
    chain = running.previous(o, "seq", "src").where("src IS NOT NULL").select("src", F.col("seq").alias("snk"))
    of, exprs = expressions.table(chain, o.select(F.col("seq").alias("inst"), "op", F.col("op").alias("name")))
    used = of.groupBy("expr").agg(F.count("*").alias("insts"))
    return exprs.select("expr", F.col("level").cast("long").alias("level")).join(expressions.printed(exprs), "expr").join(used, "expr").select("level", "text", "insts")


# Late events


@query("SELECT src, snk, count(*) AS freq, count(DISTINCT thread) AS threads FROM m GROUP BY 1, 2", "m")
def late_stream_edges(spark, sf_dir):
    """Edges from a stream whose files hold the events by a digest of their id, so in no order of time.

    All events are late to the latest of them, hence the wide watermark; a last file, of a thread that isn't counted, moves it past them all.
    """
    from tracewright import streaming

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    home = _shared(spark, "late")
    t = V.events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    ends = t.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    span = int((ends.b - ends.a).total_seconds()) + 1
    t.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(3))).repartition("part").drop("part").write.parquet(f"{home}/in")
    raw = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")

    def run():
        moves = streaming.ordered_transitions(raw, f"{span} seconds")
        moves.writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint").option("path", f"{home}/moves").trigger(availableNow=True).start().awaitTermination()

    run()
    t.limit(1).select(F.lit(-1).cast("long").alias("thread"), (F.lit(ends.b) + F.make_interval(secs=F.lit(2 * span))).alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit("end").alias("block")).write.mode("append").parquet(f"{home}/in")
    run()
    for done in ("in", "checkpoint"):
        iterate.remove(spark, f"{home}/{done}")
    moves = spark.read.parquet(f"{home}/moves")
    return moves.groupBy("src", "snk").agg(F.count("*").alias("freq"), F.count_distinct("thread").alias("threads"))
