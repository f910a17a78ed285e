"""More registered queries: graph rules, hierarchies, task colours, dependencies through copies, text outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import dataflow, deps, graph, intervals, paths, segment
from tracewright.sources import text

from . import views as V
from .queries import _SCC, ORACLE_SQL, functions, query
from .views import with_views


def recursive(needs: str, sql: str) -> str:
    """``sql`` (further views and the query) behind ``needs``, in a WITH that may recur."""
    head = with_views("", *needs.split())
    return (head if head.startswith("WITH RECURSIVE") else head.replace("WITH ", "WITH RECURSIVE ", 1)) + ", " + sql


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Graph rules


def _targets(spark, sf_dir):
    """Calls to blocks with names of even length have a static target, the others go through pointers."""
    c, fn = V.calls(spark, sf_dir), functions(spark, sf_dir).select("block", "fn")
    target = F.when(F.length("callee") % 2 == 0, F.col("fn"))
    static = c.join(fn.withColumnRenamed("block", "callee"), "callee").select(F.col("caller").alias("block"), target.alias("callee")).distinct()
    return static, c.select(F.col("caller").alias("src"), F.col("callee").alias("snk"))


@query("""
SELECT DISTINCT s.block, coalesce(s.callee, f.fn) AS callee
FROM (SELECT DISTINCT caller AS block, CASE WHEN length(callee) % 2 = 0 THEN fn END AS callee FROM calls JOIN fns ON fns.block = callee) s
JOIN calls c ON c.caller = s.block JOIN fns f ON f.block = c.callee""", "calls", "fns")
def indirect_targets(spark, sf_dir):
    static, seen = _targets(spark, sf_dir)
    return graph.resolve_indirect(static, seen, functions(spark, sf_dir))


_RETURNS = """
SELECT w.src, w.snk, freq, CASE WHEN a.fn <> b.fn AND NOT b.is_entry THEN 'return' WHEN n > 1 THEN 'conditional' ELSE 'unconditional' END AS kind
FROM (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM we) w JOIN fns a ON a.block = w.src JOIN fns b ON b.block = w.snk"""


@query(f"SELECT src, snk, kind, round(freq / sum(freq) OVER (PARTITION BY src), 6) AS weight FROM ({_RETURNS})", "we", "fns")
def return_edges(spark, sf_dir):
    """Event types as functions; what enters one elsewhere than at its entry is a return."""
    f = functions(spark, sf_dir)
    e = graph.typed(V.wide_edges(spark, sf_dir).select("src", "snk", "freq"))
    out = graph.return_edges(e, f, f.where("is_entry").select("block"))
    return out.select("src", "snk", "kind", F.round("weight", 6).alias("weight"))


def _ends(spark, sf_dir):
    from tracewright.operators import trace

    t = V.wide(spark, sf_dir)
    return graph.add_sentinels(V.wide_edges(spark, sf_dir), trace.thread_entries(t), trace.thread_exits(t))


_FIRST = "SELECT DISTINCT min_by(block, (ts, seq)) AS id FROM wt GROUP BY thread"
_LAST = "SELECT DISTINCT max_by(block, (ts, seq)) AS id FROM wt GROUP BY thread"


@query(f"SELECT id, 'entry' AS role FROM ({_FIRST}) UNION ALL SELECT id, 'exit' FROM ({_LAST})", "wt")
def program_ends(spark, sf_dir):
    """Blocks that threads start and end with, found through the sentinels."""
    e = _ends(spark, sf_dir)
    return graph.entry_node(e).withColumn("role", F.lit("entry")).unionByName(graph.terminators(e).withColumn("role", F.lit("exit")))


@query(f"SELECT fn, block FROM fns WHERE block IN ({_LAST}) AND fn NOT IN (SELECT fn FROM fns WHERE block IN ({_FIRST} HAVING thread % 50 = 0))", "wt", "fns")
def unconventional_exits(spark, sf_dir):
    """Exits from functions other than those that every fiftieth thread starts in."""
    from tracewright.operators import trace

    t = V.wide(spark, sf_dir)
    e = graph.add_sentinels(V.wide_edges(spark, sf_dir), trace.thread_entries(t.where("thread % 50 = 0")), trace.thread_exits(t))
    return graph.unconventional_exits(e, functions(spark, sf_dir)).distinct()


@query("""
SELECT 'c' || c_custkey AS block, 'r' || n_regionkey AS node FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)""")
def block_members(spark, sf_dir):
    """Regions as supernodes of nations, nations of customers."""
    inner = V.items(spark, sf_dir).where("src NOT LIKE 'c%'")
    return graph.block_members(inner.select(F.col("src").alias("parent"), F.col("snk").alias("child")))


@query()
def call_components(spark, sf_dir):
    c = V.calls(spark, sf_dir)
    return paths.strongly_connected(c.select(F.col("caller").alias("src"), F.col("callee").alias("snk")))


ORACLE_SQL["call_components"] = recursive("cl", f"{_SCC} SELECT id, scc FROM scc")


@query()
def fully_connected(spark, sf_dir):
    """Whether all event types, and all turns, reach each other."""
    rows = []
    for name, e in (("events", V.edges(spark, sf_dir)), ("turns", V.turn_edges(spark, sf_dir))):
        rows.append((name, paths.fully_connected(e, graph.Graph(e).nodes)))
    return spark.createDataFrame(rows, "graph string, connected boolean")


ORACLE_SQL["fully_connected"] = recursive("e tcl", """
ecl AS (SELECT src, snk FROM e UNION SELECT ecl.src, e.snk FROM ecl JOIN e ON ecl.snk = e.src),
en AS (SELECT src AS id FROM e UNION SELECT snk FROM e), tn AS (SELECT src AS id FROM ce UNION SELECT snk FROM ce)
SELECT 'events' AS graph, NOT EXISTS (SELECT 1 FROM en a, en b WHERE a.id <> b.id AND (a.id, b.id) NOT IN (SELECT (src, snk) FROM ecl)) AS connected
UNION ALL SELECT 'turns', NOT EXISTS (SELECT 1 FROM tn a, tn b WHERE a.id <> b.id AND (a.id, b.id) NOT IN (SELECT (src, snk) FROM tcl))""")


@query()
def blocks_between(spark, sf_dir):
    """From region 1 no further than nations with even keys."""
    i = V.items(spark, sf_dir)
    exits = i.where("snk LIKE 'n%' AND CAST(substring(snk, 2) AS INT) % 2 = 0").select(F.col("snk").alias("id"))
    return paths.between(i, spark.createDataFrame([("r1",)], "id string"), exits)


ORACLE_SQL["blocks_between"] = recursive("items", """
rc AS (SELECT 'r1' AS id UNION SELECT items.snk FROM rc JOIN items ON items.src = rc.id AND NOT (rc.id[1] = 'n' AND TRY_CAST(rc.id[2:] AS INT) % 2 = 0))
SELECT id FROM rc""")


@query()
def pruned_edges(spark, sf_dir):
    """What region 2 leads to."""
    return paths.prune(V.items(spark, sf_dir), spark.createDataFrame([("r2",)], "id string")).select("src", "snk")


ORACLE_SQL["pruned_edges"] = recursive("items", """
rc AS (SELECT 'r2' AS id UNION SELECT items.snk FROM rc JOIN items ON items.src = rc.id)
SELECT src, snk FROM items WHERE src IN (SELECT id FROM rc)""")


# Kernels and their hierarchy


def _hierarchy(spark, sf_dir):
    """Nation n above nations 2n + 1 and n + 5."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("parent"))
    return n.select("parent", F.explode(F.array(F.col("parent") * 2 + 1, F.col("parent") + 5)).alias("child")).where("child < 25").distinct()


def _segments(spark, sf_dir):
    """Nations as kernels of market segments and account classes."""
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("kernel"), F.concat("c_mktsegment", F.floor(F.col("c_acctbal") / 1000).cast("string")).alias("block")).distinct()


_HIER = "h AS (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS parent, unnest([n_nationkey * 2 + 1, n_nationkey + 5]) AS child FROM nation), hh AS (SELECT * FROM h WHERE child < 25)"
_SEGMENTS = "km AS (SELECT DISTINCT c_nationkey AS kernel, c_mktsegment || CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR) AS block FROM customer)"


@query(f"WITH {_HIER}, {_SEGMENTS} SELECT kernel, block FROM km EXCEPT SELECT parent, block FROM hh JOIN km ON kernel = child")
def exclusive_blocks(spark, sf_dir):
    return segment.exclusive(_segments(spark, sf_dir), _hierarchy(spark, sf_dir))


@query(f"""WITH RECURSIVE {_HIER}, w AS (SELECT CAST(n_nationkey AS BIGINT) AS kernel, 0 AS level FROM nation UNION SELECT child, level + 1 FROM w JOIN hh ON parent = kernel)
SELECT kernel, max(level) AS level FROM w GROUP BY kernel""")
def kernel_levels(spark, sf_dir):
    return segment.levels(_hierarchy(spark, sf_dir), read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("kernel")))


@query("""WITH s AS (SELECT c_nationkey % 12 AS kernel, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS blocks FROM customer WHERE c_custkey % 9 = c_nationkey % 3 GROUP BY 1)
SELECT min(kernel) AS kernel FROM s GROUP BY blocks""")
def distinct_kernels(spark, sf_dir):
    """Nations modulo 12 as kernels of some customers' segments."""
    c = read(spark, sf_dir, "customer").where("c_custkey % 9 = c_nationkey % 3")
    return segment.distinct_sets(c.select((F.col("c_nationkey") % 12).alias("kernel"), F.col("c_mktsegment").alias("block")))


@query(f"""WITH RECURSIVE {_HIER}, {_SEGMENTS}, w AS (SELECT parent, child FROM hh UNION SELECT w.parent, hh.child FROM w JOIN hh ON hh.parent = w.child)
SELECT kernel, block FROM km UNION SELECT parent, block FROM w JOIN km ON kernel = child""")
def kernel_block_closure(spark, sf_dir):
    return segment.block_closure(_segments(spark, sf_dir), _hierarchy(spark, sf_dir))


@query("""SELECT a.n_nationkey AS kernel, b.n_nationkey AS before FROM nation a JOIN nation b ON b.n_regionkey < a.n_regionkey""")
def preceding_kernels(spark, sf_dir):
    """Nations, their region as the level they were met at."""
    return segment.preceding(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("kernel"), F.col("n_regionkey").alias("level")))


# Memory


def _short_lived(spark, sf_dir):
    """Lines of a supplier as memory events over few addresses, so that blocks are allocated and freed in one epoch."""
    op = F.element_at(F.array(*map(F.lit, ("load", "store", "malloc", "free"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("epoch"), F.col("l_orderkey").alias("seq"), op.alias("op"), (F.col("l_partkey") % 40 * 16).alias("addr"), F.lit(None).cast("long").alias("src"), F.col("l_quantity").cast("long").alias("size")
    )


@query("""
WITH ev AS (SELECT l_suppkey AS epoch, l_linenumber % 4 AS op, l_partkey % 40 * 16 AS addr, CAST(l_quantity AS BIGINT) AS size FROM lineitem),
points AS (SELECT DISTINCT epoch, CASE op WHEN 0 THEN 'READ' ELSE 'WRITE' END AS rw, unnest(range(addr, addr + size + 1)) AS p FROM ev WHERE op IN (0, 1)),
gone AS (SELECT DISTINCT epoch, unnest(range(addr, addr + size)) AS p FROM ev WHERE op = 2 AND (epoch, addr) IN (SELECT (epoch, addr) FROM ev WHERE op = 3)),
kept AS (SELECT * FROM points WHERE (epoch, p) NOT IN (SELECT (epoch, p) FROM gone))
SELECT epoch, rw, min(p) AS base, max(p) AS "end" FROM (SELECT *, p - row_number() OVER (PARTITION BY epoch, rw ORDER BY p) AS island FROM kept) GROUP BY epoch, rw, island""")
def lasting_accesses(spark, sf_dir):
    return intervals.without_temporaries(intervals.accesses(_short_lived(spark, sf_dir)))


_COPIES = "cp AS (SELECT l_suppkey AS epoch, l_partkey AS src, l_partkey + 60 AS dst, 40 + l_linenumber AS size FROM lineitem WHERE l_linenumber = 7)"


@query(f"""
SELECT epoch, rw, base, "end" FROM iv UNION ALL
SELECT DISTINCT r.epoch, 'READ', greatest(base, dst) + src - dst, least("end", dst + size - 1) + src - dst
FROM iv r JOIN (WITH {_COPIES} SELECT * FROM cp) c ON c.epoch < r.epoch AND r.rw = 'READ' AND least("end", dst + size - 1) - greatest(base, dst) > 32""", "iv")
def copied_reads(spark, sf_dir):
    """Reads of copies as reads of what was copied: each seventh line copies its part's range 60 addresses further."""
    c = read(spark, sf_dir, "lineitem").where("l_linenumber = 7")
    copies = c.select(F.col("l_suppkey").alias("epoch"), F.col("l_partkey").alias("src"), (F.col("l_partkey") + 60).alias("dst"), (F.col("l_linenumber") + 40).alias("size"))
    return deps.with_copies(V.spans(spark, sf_dir), copies)


# Tasks


def _insts(spark, sf_dir):
    """Blocks of the wide graph as instructions, operators by event type; calls as def-use edges."""
    op = F.when(F.col("inst").startswith("view/"), "load").when(F.col("inst").startswith("purchase/"), "store").when(F.col("inst").startswith("click/"), "add").otherwise("phi")
    c = V.calls(spark, sf_dir).select(F.col("caller").alias("src"), F.col("callee").alias("snk"))
    return c.select(F.explode(F.array("src", "snk")).alias("inst")).distinct().withColumn("op", op), c


_INSTS = """ins AS (SELECT inst, CASE WHEN inst LIKE 'view/%' THEN 'load' WHEN inst LIKE 'purchase/%' THEN 'store' WHEN inst LIKE 'click/%' THEN 'add' ELSE 'phi' END AS op
FROM (SELECT caller AS inst FROM calls UNION SELECT callee FROM calls)), way AS (SELECT src, snk FROM cl UNION SELECT inst, inst FROM ins)"""


@query()
def task_colours(spark, sf_dir):
    """Function, state and memory slices and the colour they give: branches are /-1 blocks, pointers error blocks of positive exponent."""
    i, du = _insts(spark, sf_dir)
    state = dataflow.state_nodes(i, du, i.where("inst LIKE '%/-2'").select("inst"))
    memory = dataflow.memory_nodes(du, i.where("inst LIKE 'error/7%'").select("inst"))
    return dataflow.colours(i, dataflow.function_nodes(i, du), state, memory)


ORACLE_SQL["task_colours"] = recursive("cl", f"""{_INSTS}
SELECT inst, CASE WHEN inst IN (SELECT src FROM way WHERE snk LIKE '%/-2') THEN 'State' WHEN inst IN (SELECT src FROM way WHERE snk LIKE 'error/7%') THEN 'Memory'
  WHEN inst IN (SELECT src FROM way WHERE snk LIKE 'purchase/%') AND inst IN (SELECT snk FROM way WHERE src LIKE 'view/%') THEN 'Function' ELSE 'None' END AS colour FROM ins""")


@query("SELECT cycle, src, snk FROM we JOIN (SELECT DISTINCT block, event_type AS cycle FROM wt WHERE exp > 2) a ON a.block = src WHERE (cycle, snk) NOT IN (SELECT (event_type, block) FROM wt WHERE exp > 2)", "we", "wt")
def cycle_exits(spark, sf_dir):
    """Event types of exponent above 2 as cycles."""
    m = V.wide(spark, sf_dir).where("exp > 2").select(F.col("event_type").alias("cycle"), "block").distinct()
    return dataflow.cycle_exits(V.wide_edges(spark, sf_dir), m)


@query("""
SELECT 'r' || r_regionkey AS cycle, 'r' || r_regionkey AS task, TRUE AS is_top, r_regionkey NOT IN (SELECT n_regionkey FROM nation) AS is_leaf FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, FALSE, TRUE FROM nation""")
def cycle_tasks(spark, sf_dir):
    """Nations as cycles inside their region."""
    h = V.items(spark, sf_dir).where("src LIKE 'r%'").select(F.col("src").alias("parent"), F.col("snk").alias("child"))
    regions = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("cycle"))
    return dataflow.tasks(regions.unionByName(h.select(F.col("child").alias("cycle"))), h)


@query("SELECT inst, op FROM (WITH hi AS (SELECT DISTINCT block, event_type FROM wt WHERE exp > 5) SELECT block AS inst, CASE event_type WHEN 'view' THEN 'load' ELSE 'store' END AS op FROM hi WHERE event_type IN ('view', 'purchase') AND block IN (SELECT caller FROM calls UNION SELECT callee FROM calls))", "wt", "calls")
def significant_memory(spark, sf_dir):
    """Loads and stores of exponent above 5."""
    i, _ = _insts(spark, sf_dir)
    return dataflow.significant(i, V.wide(spark, sf_dir).where("exp > 5").select(F.col("block").alias("inst")).distinct())


@query()
def base_pointers(spark, sf_dir):
    """Blocks as allocations of as many bytes as they were seen."""
    from tracewright.operators import counts

    i, du = _insts(spark, sf_dir)
    f = counts.block_frequency(V.wide_edges(spark, sf_dir)).select(F.col("block").alias("inst"), F.col("freq").alias("bytes"))
    return dataflow.base_pointers(i, du, f)


ORACLE_SQL["base_pointers"] = recursive("cl f", f"""{_INSTS}
SELECT block AS inst, CAST(freq AS BIGINT) AS bytes FROM f WHERE freq >= 128 AND block IN (SELECT src FROM way WHERE snk LIKE 'view/%' OR snk LIKE 'purchase/%')""")


_SPACES = "sp AS (SELECT n_regionkey AS base, n_nationkey AS var, min(c_custkey) AS lo, max(c_custkey) AS hi, count(*) AS stride FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)"


@query(f"""WITH {_SPACES} SELECT base, a.var, b.var AS r_var, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi, least(a.stride, b.stride) AS stride
FROM sp a JOIN sp b USING (base) WHERE a.var < b.var AND greatest(a.lo, b.lo) <= least(a.hi, b.hi)""")
def shared_index_space(spark, sf_dir):
    """Customers of a nation as an index space of its region."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    s = c.groupBy(F.col("n_regionkey").alias("base"), F.col("n_nationkey").alias("var")).agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"), F.count("*").alias("stride"))
    return dataflow.shared_space(s, s)


@query("""SELECT o_custkey AS base, string_agg(v, ',' ORDER BY pos, v) AS vars, count(*) AS dims
FROM (SELECT DISTINCT o_custkey, year(o_orderdate) AS pos, o_orderstatus || o_orderpriority AS v FROM orders) GROUP BY 1""")
def index_collections(spark, sf_dir):
    """Orders as accesses by customer, their year as the position of the index."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("base"), F.year("o_orderdate").alias("position"), F.concat("o_orderstatus", "o_orderpriority").alias("var"))
    return dataflow.collections(o).select("base", F.array_join("vars", ",").alias("vars"), "dims")


def _reductions(spark, sf_dir):
    e = V.wide_edges(spark, sf_dir).select("src", "snk")
    op = F.when(F.col("inst").startswith("view/"), "phi").when(F.col("inst").startswith("click/"), "add").otherwise("load")
    i = e.select(F.explode(F.array("src", "snk")).alias("inst")).distinct().withColumn("op", op)
    return dataflow.reductions(i, e), e


_REDUCTIONS = "rd AS (SELECT DISTINCT a.src AS phi, a.snk AS op_inst, 'add' AS op FROM we a JOIN we b ON a.src = b.snk AND a.snk = b.src WHERE a.src LIKE 'view/%' AND a.snk LIKE 'click/%')"


@query(f"SELECT * FROM (WITH {_REDUCTIONS} SELECT phi, op_inst, op, EXISTS (SELECT 1 FROM we WHERE src = phi AND snk <> op_inst) AS serial FROM rd)", "we")
def reduction_kinds(spark, sf_dir):
    """Views as phis, clicks as additions."""
    found, e = _reductions(spark, sf_dir)
    serial = dataflow.serial_reductions(found, e).withColumn("serial", F.lit(True))
    return found.join(serial, ["phi", "op_inst", "op"], "left").withColumn("serial", F.coalesce("serial", F.lit(False)))


@query("SELECT c_nationkey AS cycle FROM customer EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9950 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < -990")
def parallel_cycles(spark, sf_dir):
    """Nations as cycles: very rich customers overlap, deep debts are serial."""
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "cycle")
    return dataflow.parallel_cycles(c, c.where("c_acctbal > 9950"), c.where("c_acctbal < -990"))


@query("""SELECT 'c' || c_custkey AS inst, 'mul(add(vr' || n_regionkey || '))' AS text FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def printed_expressions(spark, sf_dir):
    """A customer multiplies its nation, which adds its region."""
    du = V.items(spark, sf_dir).where("src NOT LIKE 'c%'")
    op = F.when(F.col("inst").startswith("n"), "add").when(F.col("inst").startswith("c"), "mul").otherwise("load")
    i = du.select(F.explode(F.array("src", "snk")).alias("inst")).distinct().withColumn("op", op)
    return dataflow.expressions(du, i, i.where("op = 'mul'").select("inst"))


# Source and program statistics


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, i AS number, string_split(text, chr(10))[i] AS line
FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""")
def source_lines(spark, sf_dir):
    """Documents as source files."""
    d = read(spark, sf_dir, "documents")
    return text.source_lines(d.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, '// ' || source || chr(10) || text AS content FROM documents")
def annotated_source(spark, sf_dir):
    """Each document with its source as a note before its first line."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "source")
    lines = text.source_lines(d.withColumn("content", F.concat(F.lit(""), F.col("content"))))
    return text.annotate(lines, d.select("path", F.lit(1).alias("number"), F.concat(F.lit("// "), F.col("source")).alias("note")))


@query("""SELECT count(*) AS static, count(*) FILTER (block IN (SELECT block FROM f)) AS dynamic, count(*) FILTER (block IN (SELECT block FROM wt WHERE exp >= 4)) AS in_kernels FROM wt""", "wt", "f")
def program_statistics(spark, sf_dir):
    """Events as instructions, high exponents as kernels."""
    from tracewright.operators import counts

    w = V.wide(spark, sf_dir)
    return text.statistics(w.select("block"), counts.block_frequency(V.wide_edges(spark, sf_dir)), w.where("exp >= 4").select("block"))


@query("SELECT event_type AS op, count(*) AS n FROM events GROUP BY 1")
def opcode_histogram(spark, sf_dir):
    return text.opcode_histogram(read(spark, sf_dir, "events").select(F.col("event_type").alias("op")))


@query("""SELECT 'c' || c_custkey AS callers, array_to_string(list(DISTINCT o_orderkey ORDER BY o_orderkey), ',') AS callees FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def block_info_roundtrip(spark, sf_dir):
    """Orders as callees of customers, written as a block information document and read again."""
    from tracewright.sources import jsonfiles

    from .queries import _shared

    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("block"), F.col("o_orderkey").cast("long").alias("callee"))
    labels = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("block"), F.col("c_mktsegment").alias("label"), F.lit(1).cast("long").alias("votes"))
    path = _shared(spark, "blocks")
    jsonfiles.write_block_info(o, labels).write.text(path)
    callers, _, _ = jsonfiles.read_block_info(spark, path)
    return callers.groupBy(F.concat(F.lit("c"), F.col("block").cast("string")).alias("callers")).agg(F.array_join(F.array_sort(F.collect_list("callee")), ",").alias("callees"))
