"""Registered queries: lineage and graph quality, components and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import components as comp
from ..operators import lineage as lg
from . import fixtures as fx
from . import sqlkit as K
from .catalog_raster import OUT
from .registry import query

# ---- fixtures ------------------------------------------------------------------------------


def dag_edges(s, sf):
    """k -> k div 2 and k -> k div 3 over part keys, with ports."""
    p = fx.table(s, sf, "part").select("p_partkey")
    e = p.select("p_partkey", F.explode(F.array(F.lit(2), F.lit(3))).alias("m")).filter("p_partkey >= m")
    return e.select(
        (F.col("p_partkey") * 10 + F.col("m")).alias("ord"), F.concat(F.lit("e"), F.col("p_partkey"), F.lit("_"), F.col("m")).alias("id"),
        F.col("p_partkey").alias("source"), F.lit("out").alias("source_port"),
        F.floor(F.col("p_partkey") / F.col("m")).cast("long").alias("target"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("b")).otherwise(F.lit("a")).alias("target_port"),
    )


_DAG = ("dg AS (SELECT p_partkey*10+m AS ord, 'e' || p_partkey || '_' || m AS id, p_partkey AS source, 'out' AS source_port, "
        "p_partkey//m AS target, CASE WHEN p_partkey%3=0 THEN 'b' ELSE 'a' END AS target_port FROM part, (VALUES (2),(3)) t(m) WHERE p_partkey >= m)")
# fixed values: a small catalogue of node types and their ports
PORTS = [
    ("gen", "out", "out", "image", False, 0), ("filter", "out", "out", "mask", False, 0), ("mix", "out", "out", "sequence", False, 0),
    ("report", "out", "out", "text", False, 0), ("gen", "in", "a", "text", False, 0), ("filter", "in", "a", "image", False, 0),
    ("filter", "in", "b", "mask", False, 1), ("mix", "in", "a", "image", False, 0), ("mix", "in", "b", "mask", True, 1),
    ("report", "in", "a", "image", True, 0), ("report", "in", "b", "text", False, 1),
]
TYPES = ["gen", "filter", "mix", "report"]
_TYPE = "CASE ({0})%4 WHEN 0 THEN 'gen' WHEN 1 THEN 'filter' WHEN 2 THEN 'mix' ELSE 'report' END"
_PORTS = "po AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{a}','{b}','{c}','{d}',{str(m).lower()},{p})" for a, b, c, d, m, p in PORTS) + ") t(type, side, port, port_type, multiple, pos))"


def ports_table(s):
    return s.createDataFrame(PORTS, "type string, side string, port string, port_type string, multiple boolean, pos int")


def node_type(k):
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), (k % 4 + 1).cast("int"))


def dag_nodes(s, sf, version: int = 1):
    p = fx.table(s, sf, "part")
    k = F.col("p_partkey")
    cfg = F.concat(F.lit('{"size":'), F.col("p_size") + (F.when(k % 41 == 7, F.lit(version)).otherwise(F.lit(0))), F.lit("}"))
    t = p.select(k.alias("id"), node_type(k).alias("type"), cfg.alias("config"),
                 (F.when(F.lit(version == 2) & (k % 97 == 5), F.lit(True)).otherwise(k % 29 == 3)).alias("bypassed"), (k % 5 != 0).alias("auto"))
    return t


def _nodes_sql(name: str, version: int) -> str:
    return (f"{name} AS (SELECT p_partkey AS id, {_TYPE.format('p_partkey')} AS type, '{{\"size\":' || (p_size + CASE WHEN p_partkey%41=7 THEN {version} ELSE 0 END) || '}}' AS config, "
            f"({'p_partkey%97=5 OR ' if version == 2 else ''}p_partkey%29=3) AS bypassed, p_partkey%5<>0 AS auto FROM part)")


def run_table(s, sf):
    k = F.col("p_partkey")
    st = F.when(k % 7 == 0, "outOfDate").when(k % 53 == 11, "error").when(k % 59 == 2, "running").otherwise("upToDate")
    return fx.table(s, sf, "part").filter("p_partkey % 31 <> 4").select(k.alias("node_id"), st.alias("status"))


_RUNS = ("ru AS (SELECT p_partkey AS node_id, CASE WHEN p_partkey%7=0 THEN 'outOfDate' WHEN p_partkey%53=11 THEN 'error' WHEN p_partkey%59=2 THEN 'running' "
         "ELSE 'upToDate' END AS status FROM part WHERE p_partkey%31<>4)")
_ST = "st AS (SELECT p_partkey AS id, coalesce(status, 'outOfDate') AS status FROM part LEFT JOIN ru ON node_id = p_partkey)"
_CLOSE = "cl AS (SELECT source AS root, target AS node FROM {0} UNION SELECT c.root, e.target FROM cl c JOIN {0} e ON e.source = c.node)"


def ids(s, sf, cond: str):
    return fx.table(s, sf, "part").filter(cond).select(F.col("p_partkey").alias("id"))


def all_ids(s, sf):
    return fx.table(s, sf, "part").select(F.col("p_partkey").alias("id"))


# ---- G -------------------------------------------------------------------------------------
query("G1_downstream", K.sql("SELECT DISTINCT source AS id, target AS neighbour FROM dg", _DAG))(
    lambda s, sf: lg.downstream(dag_edges(s, sf), all_ids(s, sf)))
query("G1_upstream", K.sql("SELECT DISTINCT target AS id, source AS neighbour FROM dg", _DAG))(
    lambda s, sf: lg.upstream(dag_edges(s, sf), all_ids(s, sf)))
query("G2_descendants", K.sql("SELECT root, node FROM cl", _DAG, _CLOSE.format("dg")))(
    lambda s, sf: lg.descendants(dag_edges(s, sf), all_ids(s, sf)))
query("G2_ancestors", K.sql("SELECT node AS root, root AS node FROM cl", _DAG, _CLOSE.format("dg")))(
    lambda s, sf: lg.ancestors(dag_edges(s, sf), all_ids(s, sf)))


def pairs(s, sf):
    k = F.col("p_partkey")
    return fx.table(s, sf, "part").select(
        k.alias("src"), F.explode(F.array(F.floor(k / 6), F.floor(k / 5), F.floor(k / 12) + 1, k)).alias("dst")).distinct()


_PAIRS = "pr AS (SELECT DISTINCT p_partkey AS src, d AS dst FROM part, LATERAL (SELECT unnest([p_partkey//6, p_partkey//5, p_partkey//12+1, p_partkey]) AS d))"
query("G3_has_path", K.sql("SELECT src, dst, src = dst OR EXISTS (SELECT 1 FROM cl WHERE root = src AND node = dst) AS connected FROM pr",
                           _DAG, _CLOSE.format("dg"), _PAIRS))(lambda s, sf: lg.has_path(dag_edges(s, sf), pairs(s, sf)))
query("G4_would_cycle", K.sql("SELECT dst AS source, src AS target, src = dst OR EXISTS (SELECT 1 FROM cl WHERE root = src AND node = dst) AS cycle FROM pr",
                              _DAG, _CLOSE.format("dg"), _PAIRS))(
    lambda s, sf: lg.would_cycle(dag_edges(s, sf), pairs(s, sf).select(F.col("dst").alias("source"), F.col("src").alias("target"))))


def cyclic_edges(s, sf):
    """F7 plus a back edge from k to 6k + 1 for every seventh node."""
    p = fx.table(s, sf, "part").select("p_partkey")
    e = dag_edges(s, sf)
    top = p.agg(F.max("p_partkey")).first()[0]
    back = p.filter((F.col("p_partkey") % 7 == 6) & (F.col("p_partkey") * 6 + 1 <= top)).select(
        (F.col("p_partkey") * 10 + 5).alias("ord"), F.concat(F.lit("b"), F.col("p_partkey")).alias("id"), F.col("p_partkey").alias("source"),
        F.lit("out").alias("source_port"), (F.col("p_partkey") * 6 + 1).alias("target"), F.lit("a").alias("target_port"))
    return e.union(back)


_CYC = ("cy AS (SELECT ord, id, source, source_port, target, target_port FROM dg UNION ALL SELECT p_partkey*10+5, 'b' || p_partkey, p_partkey, 'out', "
        "6*p_partkey+1, 'a' FROM part WHERE p_partkey%7=6 AND 6*p_partkey+1 <= (SELECT max(p_partkey) FROM part))")
query("G5_find_cycles", K.sql(
    "SELECT DISTINCT p_partkey AS id FROM part WHERE p_partkey IN (SELECT root FROM cl WHERE root = node) OR p_partkey IN "
    "(SELECT c.node FROM cl c WHERE c.root IN (SELECT root FROM cl WHERE root = node))", _DAG, _CYC, "cz AS (SELECT * FROM cy WHERE source<>target)", _CLOSE.format("cz")))(
    lambda s, sf: lg.find_cycles(all_ids(s, sf), cyclic_edges(s, sf)))
_LEVEL = ("{n}p AS (SELECT p_partkey AS id, 0 AS lv FROM part UNION SELECT e.{t}, p.lv+1 FROM {n}p p JOIN (SELECT * FROM dg WHERE source<>target) e ON e.{s} = p.id), "
          "{n} AS (SELECT id, max(lv) AS lv FROM {n}p GROUP BY id)")
query("G6_topo_levels", K.sql("SELECT a.id, a.lv::INTEGER AS asap, ((SELECT max(lv) FROM la) - b.lv)::INTEGER AS alap FROM la a JOIN lb b USING (id)",
                              _DAG, _LEVEL.format(n="la", s="source", t="target"), _LEVEL.format(n="lb", s="target", t="source")))(
    lambda s, sf: lg.topo_levels(all_ids(s, sf), dag_edges(s, sf)))


def edges_v2(s, sf):
    """Version 2 of the graph: one edge in 83 rewired to another port."""
    e = dag_edges(s, sf)
    return e.withColumn("target_port", F.when(F.col("source") % 83 == 9, F.lit("z")).otherwise(F.col("target_port")))


_E2 = "e2 AS (SELECT * REPLACE (CASE WHEN source%83=9 THEN 'z' ELSE target_port END AS target_port) FROM dg)"
query("G7_stale_nodes", K.sql(
    "SELECT id, coalesce(own, CASE WHEN wired THEN 'inputs' END, 'upstream') AS reason FROM (SELECT c.*, EXISTS (SELECT 1 FROM cl WHERE cl.node = c.id AND cl.root IN "
    "(SELECT id FROM ch WHERE own IS NOT NULL OR wired)) AS below FROM ch c) WHERE own IS NOT NULL OR wired OR below", _DAG, _E2, _nodes_sql("n1", 1), _nodes_sql("n2", 2), _CLOSE.format("e2"),
    "n1k AS (SELECT * FROM n1 WHERE id%101<>50)",
    "sg1 AS (SELECT target, list_sort(list(source || '|' || source_port || '|' || target_port)) AS sig FROM dg GROUP BY target)",
    "sg2 AS (SELECT target, list_sort(list(source || '|' || source_port || '|' || target_port)) AS sig FROM e2 GROUP BY target)",
    "ch AS (SELECT n2.id, CASE WHEN n1k.id IS NULL THEN 'added' WHEN n1k.bypassed<>n2.bypassed THEN 'bypass' WHEN n1k.config<>n2.config THEN 'config' END AS own, "
    "sg1.sig IS DISTINCT FROM sg2.sig AS wired FROM n2 LEFT JOIN n1k ON n1k.id=n2.id LEFT JOIN sg1 ON sg1.target=n2.id LEFT JOIN sg2 ON sg2.target=n2.id)"))(
    lambda s, sf: lg.stale_nodes(dag_nodes(s, sf, 1).filter("id % 101 <> 50"), dag_edges(s, sf), dag_nodes(s, sf, 2), edges_v2(s, sf)))
query("G8_ready_nodes", K.sql(
    "SELECT n.id FROM n1 n JOIN st USING (id) WHERE auto AND status='outOfDate' AND NOT EXISTS (SELECT 1 FROM dg e LEFT JOIN st u ON u.id = e.source "
    "WHERE e.target = n.id AND coalesce(u.status, 'outOfDate') <> 'upToDate')", _DAG, _nodes_sql("n1", 1), _RUNS, _ST))(
    lambda s, sf: lg.ready_nodes(dag_nodes(s, sf), dag_edges(s, sf), run_table(s, sf)))
query("G9_recompute_set", K.sql(
    "SELECT id FROM st WHERE status <> 'upToDate' AND (id IN (SELECT id FROM tg) OR id IN (SELECT root FROM cl WHERE node IN (SELECT id FROM tg)))", _DAG, _RUNS, _ST,
    _CLOSE.format("dg"), "tg AS (SELECT p_partkey AS id FROM part WHERE p_size = 7 UNION SELECT node FROM cl WHERE root IN (SELECT p_partkey FROM part WHERE p_size = 7))"))(
    lambda s, sf: lg.recompute_set(dag_nodes(s, sf), dag_edges(s, sf), run_table(s, sf), ids(s, sf, "p_size = 7")))
query("G10_blocked_by_failure", K.sql(
    "SELECT DISTINCT node AS id FROM cl WHERE root IN (SELECT node_id FROM ru WHERE status='error') AND node NOT IN (SELECT node_id FROM ru WHERE status='error')",
    _DAG, _RUNS, _CLOSE.format("dg")))(
    lambda s, sf: lg.blocked_by_failure(dag_edges(s, sf), run_table(s, sf).filter("status = 'error'").select(F.col("node_id").alias("id"))))


def dirty_nodes(s, sf):
    """Every part as a raw node, each fourth twice, some without id, type, position or settings."""
    p = fx.table(s, sf, "part").select("p_partkey", "p_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("c")).filter("c = 0 or p_partkey % 4 = 1")
    k = F.col("p_partkey")
    return p.select(
        (k * 2 + F.col("c")).alias("ord"), F.when(k % 23 != 0, F.concat(F.lit("n"), k)).alias("id"),
        F.when((k + F.col("c")) % 11 != 0, node_type(k + F.col("c"))).alias("type"),
        F.when(k % 6 == 0, F.lit(float("nan"))).when(k % 6 == 1, F.lit(None).cast("double")).otherwise(k * 1.5).alias("x"),
        F.when(k % 10 == 0, F.lit(float("inf"))).otherwise(k * 2.0).alias("y"),
        F.when(k % 5 != 0, F.concat(F.lit('{"s":'), F.col("p_size"), F.lit("}"))).alias("config"),
        F.when(k % 3 == 0, F.lit(None).cast("boolean")).otherwise(k % 3 == 1).alias("bypassed"),
    )


query("G11_sanitize_nodes", K.sql(
    "SELECT ord, id, type, CASE WHEN ok THEN x ELSE 0e0 END AS x, CASE WHEN ok THEN y ELSE 0e0 END AS y, coalesce(config, '{}') AS config, coalesce(bypassed, false) AS bypassed "
    "FROM (SELECT *, coalesce(isfinite(x) AND isfinite(y), false) AS ok, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM rn WHERE id IS NOT NULL AND type IS NOT NULL) WHERE rn=1",
    f"rn AS (SELECT p_partkey*2+c AS ord, CASE WHEN p_partkey%23<>0 THEN 'n' || p_partkey END AS id, CASE WHEN (p_partkey+c)%11<>0 THEN {_TYPE.format('p_partkey+c')} END AS type, "
    "CASE p_partkey%6 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN NULL ELSE p_partkey*1.5e0 END AS x, CASE WHEN p_partkey%10=0 THEN 'inf'::DOUBLE ELSE p_partkey*2e0 END AS y, "
    "CASE WHEN p_partkey%5<>0 THEN '{\"s\":' || p_size || '}' END AS config, CASE p_partkey%3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS bypassed "
    "FROM part, range(2) t(c) WHERE c=0 OR p_partkey%4=1)"))(lambda s, sf: lg.sanitize_nodes(dirty_nodes(s, sf)))


def dirty_edges(s, sf, edges=dag_edges):
    """F8: the graph plus self-loops, dangling ends, repeats of ids and of whole edges, and nulls."""
    e = edges(s, sf)
    k = F.col("source")
    m = e.withColumn("v", F.explode(F.array(*[F.lit(i) for i in range(6)]))).filter(
        (F.col("v") == 0) | ((F.col("v") == 1) & (k % 13 == 0)) | ((F.col("v") == 2) & (k % 17 == 0)) | ((F.col("v") == 3) & (k % 19 == 0))
        | ((F.col("v") == 4) & (k % 23 == 0)) | ((F.col("v") == 5) & (k % 9 == 2)))
    v = F.col("v")
    return m.select(
        (F.col("ord") * 6 + v).alias("ord"),
        F.when(v == 4, F.lit(None).cast("string")).when(v.isin(1, 2), F.concat("id", v)).when(v == 5, F.concat(F.lit("e"), k - 1, F.lit("_2"))).otherwise(F.col("id")).alias("id"),
        "source", F.when((v == 0) & (k % 37 == 1), F.lit("nope")).otherwise(F.col("source_port")).alias("source_port"),
        F.when(v == 1, k).when(v == 2, k + 1000000).otherwise(F.col("target")).alias("target"), "target_port",
    )


_DIRTY = ("de AS (SELECT ord*6+v AS ord, CASE WHEN v=4 THEN NULL WHEN v IN (1,2) THEN id || v WHEN v=5 THEN 'e' || (source-1) || '_2' ELSE id END AS id, source, "
          "CASE WHEN v=0 AND source%37=1 THEN 'nope' ELSE source_port END AS source_port, CASE v WHEN 1 THEN source WHEN 2 THEN source+1000000 ELSE target END AS target, target_port "
          "FROM dg, range(6) t(v) WHERE v=0 OR (v=1 AND source%13=0) OR (v=2 AND source%17=0) OR (v=3 AND source%19=0) OR (v=4 AND source%23=0) OR (v=5 AND source%9=2))")


_FIT = "(" + " OR ".join(f"(i.port_type='{w}' AND o.port_type IN ({', '.join(repr(h) for h in have)}))" for w, have in lg.ACCEPTS.items()) + ")"
_VALID = (
    f"vd AS (SELECT e.ord, e.id, e.source, e.source_port, e.target, e.target_port, row_number() OVER (ORDER BY e.ord) AS k, "
    "concat_ws('|', e.source, e.source_port, e.target, e.target_port) AS ke, CASE WHEN NOT i.multiple THEN concat_ws('|', e.target, e.target_port) END AS ko "
    f"FROM de e JOIN n1 s ON s.id=e.source JOIN n1 t ON t.id=e.target JOIN po o ON o.type=s.type AND o.side='out' AND o.port=e.source_port "
    f"JOIN po i ON i.type=t.type AND i.side='in' AND i.port=e.target_port WHERE e.id IS NOT NULL AND e.source<>e.target AND {_FIT})"
)
# the greedy pass row by row: three sets travel through the recursion
_GREEDY = (
    _VALID + ", gz AS (SELECT 0::BIGINT AS k, false AS ok, []::VARCHAR[] AS a, []::VARCHAR[] AS b, []::VARCHAR[] AS c UNION ALL "
    "SELECT k, ok, CASE WHEN ok THEN list_append(a, id) ELSE a END, CASE WHEN ok THEN list_append(b, ke) ELSE b END, CASE WHEN ok AND ko IS NOT NULL THEN list_append(c, ko) ELSE c END FROM "
    "(SELECT v.k, v.id, v.ke, v.ko, g.a, g.b, g.c, NOT (list_contains(g.a, v.id) OR list_contains(g.b, v.ke) OR (v.ko IS NOT NULL AND list_contains(g.c, v.ko))) AS ok "
    "FROM gz g JOIN vd v ON v.k = g.k+1))"
)


def _accepted(s, sf):
    t = lg.sanitize_edges(dirty_edges(s, sf), dag_nodes(s, sf), ports_table(s))
    return t.filter("reason is null").select("ord", "id", "source", "source_port", "target", "target_port")


query("G12_sanitize_edges", K.sql("SELECT v.ord, v.id, v.source, v.source_port, v.target, v.target_port FROM vd v JOIN gz USING (k) WHERE ok",
                                  _DAG, _nodes_sql("n1", 1), _PORTS, _DIRTY, _GREEDY))(_accepted)
query("G12_edge_reasons", K.sql(
    "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN e.id IS NULL THEN 'missing field' WHEN s.id IS NULL OR t.id IS NULL THEN 'dangling' WHEN e.source=e.target THEN 'self-loop' "
    f"WHEN o.port IS NULL THEN 'no output port' WHEN i.port IS NULL THEN 'no input port' WHEN NOT {_FIT} THEN 'type mismatch' END AS reason FROM de e LEFT JOIN n1 s ON s.id=e.source LEFT JOIN n1 t ON t.id=e.target "
    "LEFT JOIN po o ON o.type=s.type AND o.side='out' AND o.port=e.source_port LEFT JOIN po i ON i.type=t.type AND i.side='in' AND i.port=e.target_port) WHERE reason IS NOT NULL GROUP BY reason",
    _DAG, _nodes_sql("n1", 1), _PORTS, _DIRTY))(
    lambda s, sf: lg.check_edges(dirty_edges(s, sf), dag_nodes(s, sf), ports_table(s)).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
_CZ = "cz AS (SELECT * FROM cy WHERE source<>target)"
_DOUBT = "db AS (SELECT ord, source, target, row_number() OVER (ORDER BY ord) AS k FROM cz e WHERE EXISTS (SELECT 1 FROM cl WHERE root = e.target AND node = e.source))"
# edge by edge: the pairs that accepted edges connect are kept by the recursion, each with the edge that first connected them
_PAIRED = ("rc(a, b, k) USING KEY (a, b) AS (SELECT -1::BIGINT, -1::BIGINT, 0::BIGINT UNION (WITH nx AS (SELECT e.* FROM rc c JOIN db e ON e.k = c.k + 1 WHERE c.a = -1), "
           "go AS (SELECT * FROM nx WHERE NOT EXISTS (SELECT 1 FROM recurring.rc r WHERE r.a = nx.target AND r.b = nx.source)), "
           "xs AS (SELECT r.a AS x FROM recurring.rc r JOIN go ON r.b = go.source UNION ALL SELECT source FROM go), ys AS (SELECT r.b AS y FROM recurring.rc r JOIN go ON r.a = go.target UNION ALL SELECT target FROM go) "
           "SELECT -1::BIGINT, -1::BIGINT, k FROM nx UNION ALL SELECT x, y, (SELECT k FROM nx) FROM xs, ys WHERE NOT EXISTS (SELECT 1 FROM recurring.rc r WHERE r.a = x AND r.b = y)))")
query("G13_drop_back_edges", K.sql(
    "SELECT ord, id, source, source_port, target, target_port FROM cz LEFT JOIN db USING (ord, source, target) "
    "WHERE k IS NULL OR NOT EXISTS (SELECT 1 FROM rc WHERE rc.a = target AND rc.b = source AND rc.k < db.k)", _DAG, _CYC, _CZ, _CLOSE.format("cz"), _DOUBT, _PAIRED))(
    lambda s, sf: lg.drop_back_edges(cyclic_edges(s, sf)))
_WIRED = ("rc(a, b, k) USING KEY (a, b) AS (SELECT '', '', 0::BIGINT UNION (WITH nx AS (SELECT v.* FROM rc c JOIN vd v ON v.k = c.k + 1 WHERE c.a = ''), "
          "go AS (SELECT * FROM nx WHERE NOT EXISTS (SELECT 1 FROM recurring.rc r WHERE (r.a = 'n' || nx.target AND r.b = 'n' || nx.source) OR (r.a = 'id' AND r.b = nx.id) OR (r.a = 'end' AND r.b = nx.ke) OR (r.a = 'one' AND r.b = nx.ko))), "
          "xs AS (SELECT r.a AS x FROM recurring.rc r JOIN go ON r.b = 'n' || go.source WHERE r.a LIKE 'n%' UNION ALL SELECT 'n' || source FROM go), "
          "ys AS (SELECT r.b AS y FROM recurring.rc r JOIN go ON r.a = 'n' || go.target UNION ALL SELECT 'n' || target FROM go) "
          "SELECT '', '', k FROM nx UNION ALL SELECT 'id', id, k FROM go UNION ALL SELECT 'end', ke, k FROM go UNION ALL SELECT 'one', ko, k FROM go WHERE ko IS NOT NULL "
          "UNION ALL SELECT x, y, (SELECT k FROM nx) FROM xs, ys WHERE NOT EXISTS (SELECT 1 FROM recurring.rc r WHERE r.a = x AND r.b = y)))")


def _wired(s, sf):
    t = lg.sanitize_wiring(dirty_edges(s, sf, cyclic_edges), dag_nodes(s, sf), ports_table(s))
    return t.filter("reason is null").select("ord", "id", "source", "source_port", "target", "target_port")


query("G13_sanitize_wiring", K.sql(
    "SELECT v.ord, v.id, v.source, v.source_port, v.target, v.target_port FROM vd v JOIN rc ON rc.a = 'id' AND rc.b = v.id AND rc.k = v.k",
    _DAG, _CYC, _nodes_sql("n1", 1), _PORTS, _DIRTY.replace("FROM dg", "FROM cy"), _VALID, _WIRED))(_wired)


def results(s, sf):
    k = F.col("p_partkey")
    return fx.table(s, sf, "part").select(k.alias("node_id"), F.lit("out").alias("port"), F.when(k % 8 != 3, F.concat(F.lit("r"), k)).alias("value"))


_RES = "rs AS (SELECT p_partkey AS node_id, 'out' AS port, CASE WHEN p_partkey%8<>3 THEN 'r' || p_partkey END AS value FROM part)"
_INP = ("ip AS (SELECT node_id, port, ord, value FROM (SELECT e.target AS node_id, e.target_port AS port, e.ord, r.value, p.multiple, row_number() OVER (PARTITION BY e.target, e.target_port ORDER BY e.ord) AS k "
        "FROM dg e JOIN n1 n ON n.id=e.target JOIN po p ON p.type=n.type AND p.side='in' AND p.port=e.target_port JOIN rs r ON r.node_id=e.source AND r.port=e.source_port "
        "WHERE r.value IS NOT NULL) WHERE multiple OR k=1)")
query("G14_resolve_inputs", K.sql("SELECT node_id, port, ord, value FROM ip", _DAG, _nodes_sql("n1", 1), _PORTS, _RES, _INP))(
    lambda s, sf: lg.resolve_inputs(dag_nodes(s, sf), ports_table(s), dag_edges(s, sf), results(s, sf)))
_KIND = "CASE WHEN {0} IN ('text','stl','sequence','splat','transform') THEN {0} ELSE 'image' END"


@query("G15_bypass_outputs", K.sql(
    "SELECT node_id, port, value FROM (SELECT n.id AS node_id, o.port, x.value, row_number() OVER (PARTITION BY n.id, o.port ORDER BY i.pos) AS k FROM n1 n JOIN po o ON o.type=n.type AND o.side='out' "
    "JOIN po i ON i.type=n.type AND i.side='in' JOIN ik x ON x.node_id=n.id AND x.port=i.port WHERE x.kind = " + _KIND.format("o.port_type") +
    " OR (x.kind IN ('image','sequence') AND " + _KIND.format("o.port_type") + " IN ('image','sequence'))) WHERE k=1",
    _DAG, _nodes_sql("n1", 1), _PORTS, _RES, _INP,
    "ik AS (SELECT node_id, port, kind, value FROM (SELECT *, CASE substr(value, 2)::BIGINT % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'sequence' END AS kind, "
    "row_number() OVER (PARTITION BY node_id, port ORDER BY ord) AS q FROM ip) WHERE q=1)"))
def _bypass(s, sf):
    i = lg.resolve_inputs(dag_nodes(s, sf), ports_table(s), dag_edges(s, sf), results(s, sf))
    n = F.substring("value", 2, 20).cast("long") % 3
    i = i.withColumn("kind", F.when(n == 0, "text").when(n == 1, "image").otherwise("sequence"))
    return lg.bypass_outputs(dag_nodes(s, sf), ports_table(s), i)


query("G16_induced_subgraph", K.sql(
    "SELECT 'copy-' || id AS id, 'copy-' || source AS source, source_port, 'copy-' || target AS target, target_port FROM dg "
    "WHERE source IN (SELECT p_partkey FROM part WHERE p_size < 30) AND target IN (SELECT p_partkey FROM part WHERE p_size < 30)", _DAG))(
    lambda s, sf: lg.induced_subgraph(dag_nodes(s, sf).withColumns({"x": F.lit(0.0), "y": F.lit(0.0)}), dag_edges(s, sf), ids(s, sf, "p_size < 30"))[1].drop("ord"))

# ---- C: components and selection -----------------------------------------------------------
_RUN = ("rr AS (SELECT image_id, frame, y, onn AS \"on\", min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, frame, y, onn ORDER BY x) AS gg "
        "FROM (SELECT *, {cond} AS onn FROM {src})) GROUP BY image_id, frame, y, onn, gg)")
query("C1_runs", K.sql("SELECT image_id, frame, y, x0, x1, \"on\" FROM rr", K.MASK, _RUN.format(cond=f"{K.lum()} >= 128", src="mk")))(
    lambda s, sf: comp.runs(fx.mask_part(s, sf).withColumn("on", C.luminance() >= 128)).select("image_id", "frame", "y", "x0", "x1", "on"))


def cc_join_sql(src: str, dst: str) -> str:
    nb = " UNION ALL ".join(f"SELECT image_id, frame, x+({dx}) AS x, y+({dy}) AS y, onn, lb FROM {dst}l" for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    return (f"{dst}l(image_id, frame, x, y, onn, lb) USING KEY (image_id, frame, x, y) AS (SELECT image_id, frame, x, y, onn, y*4096+x FROM {src} UNION "
            f"SELECT p.image_id, p.frame, p.x, p.y, p.onn, min(q.lb) FROM ({nb}) q JOIN recurring.{dst}l p ON q.image_id=p.image_id AND q.frame=p.frame AND q.x=p.x AND q.y=p.y AND q.onn=p.onn "
            f"WHERE q.lb < p.lb GROUP BY p.image_id, p.frame, p.x, p.y, p.onn)")


query("C2_components", K.sql(
    "SELECT image_id, frame, x, y, onn AS \"on\", (lb%4096)::INTEGER AS label_x, (lb//4096)::INTEGER AS label_y FROM c2l", K.MASK,
    f"c0 AS (SELECT image_id, frame, x, y, {K.lum()} >= 128 AS onn FROM mk)", "c1 AS (SELECT * FROM c0 WHERE onn)", cc_join_sql("c1", "c2")))(
    lambda s, sf: comp.components(fx.mask_part(s, sf)))
query("C3_despeckle", K.sql(
    f"SELECT image_id, frame, x, y, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT p.image_id, p.frame, p.x, p.y, CASE WHEN p.onn OR s.lb IS NOT NULL THEN 255 ELSE 0 END AS v FROM d2 p "
    "LEFT JOIN ddl q ON q.image_id=p.image_id AND q.frame=p.frame AND q.x=p.x AND q.y=p.y AND NOT p.onn LEFT JOIN d5 s ON s.image_id=q.image_id AND s.frame=q.frame AND s.lb=q.lb)", K.MASK,
    f"d0 AS (SELECT image_id, frame, x, y, {K.lum()} >= 128 AS onn FROM mk)", cc_join_sql("d0", "da"),
    "d1 AS (SELECT image_id, frame, lb, count(*) AS n FROM dal WHERE onn GROUP BY ALL)",
    "d2 AS (SELECT p.image_id, p.frame, p.x, p.y, p.onn AND d1.n >= 17 AS onn FROM dal p LEFT JOIN d1 USING (image_id, frame, lb))",
    "d3 AS (SELECT * FROM d2 WHERE NOT onn)", cc_join_sql("d3", "dd"),
    "d5 AS (SELECT image_id, frame, lb FROM ddl GROUP BY ALL HAVING count(*) < 13 AND NOT bool_or(x=0 OR y=0 OR x=15 OR y=15))"))(
    lambda s, sf: comp.despeckle(fx.mask_part(s, sf), 17, 13).select(*OUT))


def wand_seeds(s, sf):
    """Three seeds per embedding image: two inside, one sometimes outside."""
    v = F.col("vec_id")
    pts = F.array(F.struct((v % 8).cast("double").alias("x"), ((v * 3) % 8 - 0.4).alias("y")), F.struct(F.lit(5.5).alias("x"), (v % 5).cast("double").alias("y")),
                  F.struct((v % 11).cast("double").alias("x"), F.lit(2.0).alias("y")))
    return fx.table(s, sf, "embeddings").select(v.alias("image_id"), F.lit(0).alias("frame"), F.posexplode(pts).alias("seed_id", "p")).select("image_id", "frame", "seed_id", "p.x", "p.y")


_SEEDS = ("sd AS (SELECT vec_id AS image_id, 0 AS frame, k AS seed_id, CASE k WHEN 0 THEN vec_id%8 WHEN 1 THEN 6 ELSE vec_id%11 END AS x, "
          "CASE k WHEN 0 THEN floor((vec_id*3)%8-0.4e0+0.5e0)::BIGINT WHEN 1 THEN vec_id%5 ELSE 2 END AS y FROM embeddings, range(3) t(k))")
_WAND = ("wn(image_id, frame, seed_id, sr, sg, sb, x, y) AS (SELECT s.image_id, s.frame, seed_id, p.r, p.g, p.b, p.x, p.y FROM sd s JOIN px p USING (image_id, frame, x, y) UNION "
         "SELECT w.image_id, w.frame, w.seed_id, w.sr, w.sg, w.sb, p.x, p.y FROM wn w JOIN px p ON p.image_id=w.image_id AND p.frame=w.frame AND abs(p.x-w.x)+abs(p.y-w.y)=1 "
         "AND greatest(abs(p.r-w.sr), abs(p.g-w.sg), abs(p.b-w.sb)) <= 45)")
query("C4_magic_wand", K.sql("SELECT DISTINCT image_id, frame, x, y FROM wn", K.PX, _SEEDS, _WAND))(
    lambda s, sf: comp.magic_wand(fx.px_embed(s, sf), wand_seeds(s, sf), 45))


def shapes(s, sf):
    v = F.col("vec_id")
    mk = lambda k, x, y, w, h: F.struct(F.lit(k).alias("kind"), x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))
    arr = F.array(mk("rect", v % 6 - 1.3, v % 4 + 0.2, F.lit(2.5), F.lit(2)), mk("ellipse", F.lit(7.5), v % 7, F.lit(-4.2), F.lit(3.6)), mk("ellipse", F.lit(1), F.lit(1), F.lit(0), F.lit(3)))
    return fx.table(s, sf, "embeddings").select(v.alias("image_id"), F.lit(0).alias("frame"), F.explode(arr).alias("p")).select("image_id", "frame", "p.*")


_SHAPES = ("sh AS (SELECT vec_id AS image_id, 0 AS frame, 'rect' AS kind, vec_id%6-1.3e0 AS sx, vec_id%4+0.2e0 AS sy, 2.5e0 AS sw, 2e0 AS sh FROM embeddings UNION ALL "
           "SELECT vec_id, 0, 'ellipse', 7.5e0 + -4.2e0, (vec_id%7)::DOUBLE, 4.2e0, 3.6e0 FROM embeddings)")
_INSIDE = ("se AS (SELECT DISTINCT p.image_id, p.frame, p.x, p.y FROM px p JOIN sh s USING (image_id, frame) WHERE p.x >= floor(sx) AND p.x < ceil(sx+sw) AND p.y >= floor(sy) AND p.y < ceil(sy+s.sh) "
           "AND (kind='rect' OR pow((p.x+0.5e0-(sx+sw/2))/(sw/2), 2)+pow((p.y+0.5e0-(sy+s.sh/2))/(s.sh/2), 2) <= 1))")
query("C5_select_shapes", K.sql("SELECT image_id, frame, x, y FROM se", K.PX, _SHAPES, _INSIDE))(
    lambda s, sf: comp.select_shapes(fx.px_embed(s, sf).filter("x = 0 and y = 0").select("image_id", "frame", "w", "h"), shapes(s, sf)))
query("C6_area_mask", K.sql(
    "SELECT image_id, frame, x, y, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT p.image_id, p.frame, p.x, p.y, CASE WHEN u.x IS NULL THEN 0 ELSE 255 END AS v FROM px p "
    "LEFT JOIN (SELECT DISTINCT image_id, frame, x, y FROM wn UNION SELECT * FROM se) u USING (image_id, frame, x, y))", K.PX, _SEEDS, _WAND, _SHAPES, _INSIDE))(
    lambda s, sf: comp.area_mask(fx.px_embed(s, sf), wand_seeds(s, sf), 45, shapes(s, sf)).select(*OUT))
