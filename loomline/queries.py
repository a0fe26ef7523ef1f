"""Registered queries over the test tables, and their oracle SQL.

The tables hold no dependency graph; graph queries take one computed from ``part``:
nodes are keys from 1, each depends on half of itself and on a third.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .functions import spectra
from .operators import graph, runs, states, tables
from .plans import grid
from .sources.files import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EDGES = "(SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2)"
NODES = "(SELECT p_partkey AS key, p_type AS rule, p_brand AS kind, p_size AS mtime, p_size % 7 = 0 AS changed FROM part WHERE p_partkey >= 1)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_partkey >= 1")
    return part.select(F.col("p_partkey").alias("key"), F.col("p_type").alias("rule"), F.col("p_brand").alias("kind"), F.col("p_size").alias("mtime"), (F.col("p_size") % 7 == 0).alias("changed"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"))
    halves = key.where("child > 1").select("child", F.expr("child div 2").alias("parent"))
    return halves.unionByName(key.where("child > 2").select("child", F.expr("child div 3").alias("parent"))).distinct()


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("mtime = 7").select("key")


@query("SELECT count(*) AS n, sum(length(text)) AS chars FROM documents")
def src_scan_external(spark, sf_dir):
    return scan(spark, f"{sf_dir}/documents.parquet").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT DISTINCT source, first_value(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC) AS mtime FROM documents")
def store_mtime_max(spark, sf_dir):
    return tables.newest(table(spark, sf_dir, "documents"), "source", "n_chars")


@query("SELECT source, coalesce(sum(n_chars) FILTER (WHERE lang <> 'de'), 0)::BIGINT AS size FROM documents GROUP BY source HAVING count(*) FILTER (WHERE lang <> 'de') > 0")
def output_size_sum(spark, sf_dir):
    files = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.when(F.col("lang") == "de", ".meta/").otherwise("data/"), F.col("doc_id").cast("string")))
    return tables.output_sizes(files, "source", "path", "n_chars")


@query("SELECT o_orderkey, concat_ws('/', o_orderstatus, substr(sha256(o_orderpriority), 1, 16), coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'f' END, CASE WHEN o_orderkey % 3 = 1 THEN 'o' END, 'output')) AS node_key FROM orders")
def node_key(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    made = S.node_key(F.col("o_orderstatus"), F.substring(F.sha2("o_orderpriority", 256), 1, 16), F.when(k == 0, "f"), F.when(k == 1, "o"))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("node_key"))


@query("SELECT doc_id, octet_length(encode(replace(text, ' ', '/')))<= 4096 AND NOT list_bool_or(list_transform(string_split(replace(text, ' ', '/'), '/'), lambda x: octet_length(encode(x)) > 20)) AS fits FROM documents")
def path_limits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.path_fits(F.replace(F.col("text"), F.lit(" "), F.lit("/")), 20).alias("fits"))


_SUFFIX = "CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'K' WHEN 2 THEN 'Mi' WHEN 3 THEN 'G' WHEN 4 THEN 'Ti' ELSE 'x' END"


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size::BIGINT WHEN 1 THEN p_size * 1000::BIGINT WHEN 2 THEN p_size * 1048576::BIGINT WHEN 3 THEN p_size * 1000000000::BIGINT WHEN 4 THEN p_size * 1099511627776::BIGINT END AS amount FROM part")
def parse_resource(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.parse_resource(F.concat(F.col("p_size").cast("string"), F.expr(_SUFFIX))).alias("amount"))


@query("SELECT doc_id, CASE WHEN n_chars >= 1024 THEN printf('%.1f KiB', n_chars / 1024.0) ELSE printf('%d B', n_chars) END AS size FROM documents")
def human_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.human_size(F.col("n_chars")).alias("size"))


@query("SELECT DISTINCT p_type, lower(regexp_replace(regexp_replace(p_type, '([A-Z])', '_\\1', 'g'), '^_', '')) AS snake FROM part")
def pascal_to_snake(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type", S.pascal_to_snake(F.col("p_type")).alias("snake")).distinct()


@query(r"""SELECT event_id, replace(replace(replace(regexp_replace(regexp_replace('[1, 2.5] a/b\c:*?<x>|=;' || props, '[][ ?"<>]', '', 'g'), '[/\\:|]', '_', 'g'), ',', '-'), '.', 'p'), '*', 'star') AS label FROM events""")
def sanitize_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.sanitize(F.concat(F.lit(r"[1, 2.5] a/b\c:*?<x>|=;"), "props")).alias("label"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_get_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.json_get(F.col("props"), "k").cast("long").alias("k"))


def _text(name: str, column, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", column().alias("text"))
    ORACLES[name] = f"SELECT doc_id, {oracle} AS text FROM documents"


_text("text_upper_ascii", lambda: S.ascii_upper(F.col("text")), f"translate(text, '{S.LOWER}', '{S.UPPER}')")
_text("text_lower_ascii", lambda: S.ascii_lower(F.col("text")), f"translate(text, '{S.UPPER}', '{S.LOWER}')")
_text("text_rot13", lambda: S.rot13(F.col("text")), f"translate(text, '{S.UPPER}{S.LOWER}', '{S.UPPER[13:]}{S.UPPER[:13]}{S.LOWER[13:]}{S.LOWER[:13]}')")
_text("text_reverse_lines", lambda: S.reverse_lines(F.col("text")), "array_to_string(list_transform(string_split(text, chr(10)), lambda x: reverse(x)), chr(10))")



@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS lines FROM documents")
def text_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.byte_count(F.col("text")).alias("bytes"), S.line_count(F.col("text")).alias("lines"))


@query("SELECT vec_id, i FROM (SELECT vec_id, unnest(range(1, 1 + label % 4)) AS i FROM embeddings)")
def repeat_rows(spark, sf_dir):
    return tables.repeated(table(spark, sf_dir, "embeddings"), F.col("label") % 4, "i").select("vec_id", "i")


@query("SELECT vec_id, round(total, 4) AS total FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS total FROM embeddings) x QUALIFY row_number() OVER (ORDER BY total DESC, vec_id) <= 20")
def topk_by_array_sum(spark, sf_dir):
    return tables.top_by_sum(table(spark, sf_dir, "embeddings"), "embedding", 20, "vec_id").select("vec_id", F.round("total", 4).alias("total"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / (1 + 5 * 1e-6))), 6) AS total FROM embeddings")
def recal_apply(spark, sf_dir):
    moved = S.recalibrate(F.transform("embedding", lambda x: x.cast("double")), F.lit(5))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(moved, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x >= 0 AND x >= 0.01 * list_max(embedding)))::BIGINT AS n FROM embeddings")
def array_rel_threshold(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(spectra.above_share(F.col("embedding"))).cast("long").alias("n"))


@query(f"SELECT key FROM {NODES} n WHERE key NOT IN (SELECT parent FROM {EDGES} e)")
def dag_sinks(spark, sf_dir):
    return graph.sinks(nodes(spark, sf_dir), edges(spark, sf_dir)).select("key")


@query(f"WITH s AS (SELECT key FROM {NODES} n WHERE mtime <= 25) SELECT child, parent FROM {EDGES} e WHERE child IN (FROM s) AND parent IN (FROM s)")
def graph_edges(spark, sf_dir):
    return runs.inner_edges(edges(spark, sf_dir), nodes(spark, sf_dir).where("mtime <= 25").select("key"))


_CLOSURE = f"WITH RECURSIVE e AS MATERIALIZED {EDGES}, c AS (SELECT p_partkey AS key FROM part WHERE p_partkey >= 1 AND p_size = 7 UNION SELECT e.parent FROM c JOIN e ON e.child = c.key)"


@query(_CLOSURE + " SELECT key FROM c")
def dag_required_closure(spark, sf_dir):
    return graph.closure(requested(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH RECURSIVE e AS MATERIALIZED {EDGES}, c AS (SELECT max(p_partkey) AS key FROM part UNION SELECT e.parent FROM c JOIN e ON e.child = c.key) SELECT key FROM c")
def dag_ancestors(spark, sf_dir):
    return graph.closure(nodes(spark, sf_dir).agg(F.max("key").alias("key")), edges(spark, sf_dir))


@query("SELECT p_partkey AS key, floor(log2(p_partkey))::INT AS level FROM part WHERE p_partkey >= 1")
def dag_topo_levels(spark, sf_dir):
    return graph.levels(nodes(spark, sf_dir), edges(spark, sf_dir))


_CUT = "SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1 AND p_partkey NOT BETWEEN 8 AND 15"


@query(f"WITH RECURSIVE e AS MATERIALIZED ({_CUT}), up AS (SELECT p_partkey AS key, p_partkey AS r FROM part WHERE p_partkey >= 1 UNION ALL SELECT up.key, e.b FROM up JOIN e ON e.a = up.r) SELECT key, min(r) AS component FROM up GROUP BY key")
def dag_components(spark, sf_dir):
    kept = table(spark, sf_dir, "part").where("p_partkey > 1 AND p_partkey NOT BETWEEN 8 AND 15")
    return graph.components(nodes(spark, sf_dir), kept.select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent")))


@query(f"WITH RECURSIVE e AS MATERIALIZED {EDGES}, s AS (SELECT p_partkey AS key FROM part WHERE p_partkey >= 1 AND p_size = 11 UNION SELECT e.child FROM s JOIN e ON e.parent = s.key) SELECT key FROM s")
def stale_propagation(spark, sf_dir):
    return graph.descendants(nodes(spark, sf_dir).where("mtime = 11"), edges(spark, sf_dir))


@query(
    _CLOSURE + f""", n AS (SELECT key, mtime, changed, key % 5 <> 0 AS present, key % 50 = 1 AS token FROM {NODES} x),
ci AS (SELECT e.child, e.parent FROM e JOIN c a ON a.key = e.child JOIN c b ON b.key = e.parent),
seed AS (SELECT n.key FROM n JOIN c USING (key) WHERE NOT present OR token UNION
  SELECT ci.child FROM ci JOIN n x ON x.key = ci.child JOIN n y ON y.key = ci.parent WHERE y.mtime > x.mtime AND y.changed),
st AS (SELECT key FROM seed UNION SELECT ci.child FROM st JOIN ci ON ci.parent = st.key)
SELECT n.key, CASE WHEN c.key IS NULL THEN CASE WHEN present THEN 'ORPHAN' END WHEN NOT present THEN 'MISSING' WHEN st.key IS NOT NULL THEN 'STALE' ELSE 'UP_TO_DATE' END AS state
FROM n LEFT JOIN c USING (key) LEFT JOIN st USING (key)"""
)
def classify_states(spark, sf_dir):
    rows = nodes(spark, sf_dir).select("key", "mtime", "changed", (F.col("key") % 5 != 0).alias("exists"), (F.col("key") % 50 == 1).alias("token_changed"))
    return graph.classify(rows, edges(spark, sf_dir), requested(spark, sf_dir))


@query("SELECT p_type, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS k FROM part) x WHERE k = 1")
def dag_dedup_first_wins(spark, sf_dir):
    return graph.first_wins(table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_size"), "p_type", ["p_size", "p_partkey"])


@query("SELECT p_partkey, least(p_brand, p_type) || '|' || greatest(p_brand, p_type) AS contract FROM part")
def type_contract(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.contract(F.col("p_brand"), F.col("p_type")).alias("contract"))


@query(f"SELECT e.child, e.parent, x.l::INT AS layer FROM {EDGES} e, unnest(range(floor(log2(parent))::BIGINT + 1, floor(log2(child))::BIGINT)) AS x(l) WHERE parent >= 1")
def edge_span_expand(spark, sf_dir):
    level = nodes(spark, sf_dir).select("key", F.floor(F.log2("key")).cast("int").alias("level"))
    return runs.skipped_layers(edges(spark, sf_dir), level)


#: Nodes with a call and a state of their own, for both engines.
STATES = "(SELECT p_partkey AS key, p_brand AS call, p_size AS mtime, p_size % 7 = 0 AS changed, p_size % 5 <> 0 AS present, p_size % 9 = 1 AS token, CASE WHEN p_size <= 30 THEN 'UP_TO_DATE' WHEN p_size <= 44 THEN 'STALE' WHEN p_size <= 48 THEN 'ORPHAN' ELSE 'FAILED' END AS state FROM part WHERE p_partkey >= 1)"


def with_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STATES[1:-1].replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


@query(
    f"""WITH n AS {STATES}, o AS (SELECT child AS key, bool_or(state IN ('FAILED', 'INTERRUPTED')) AS b, bool_and(state = 'UP_TO_DATE') AS r FROM {EDGES} e JOIN n ON n.key = e.parent GROUP BY child)
SELECT n.key, CASE WHEN state IN ('STALE', 'MISSING') AND coalesce(b, false) THEN 'FAILED' WHEN state IN ('STALE', 'MISSING') AND coalesce(r, true) THEN 'READY' ELSE state END AS state FROM n LEFT JOIN o USING (key)"""
)
def promote_states(spark, sf_dir):
    return states.promote(with_states(spark, sf_dir), edges(spark, sf_dir))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED {EDGES}, n AS {STATES}, d AS (SELECT key FROM n WHERE state = 'UP_TO_DATE' AND mtime = 3 UNION SELECT e.child FROM d JOIN e ON e.parent = d.key)
SELECT key, CASE WHEN state = 'UP_TO_DATE' AND key IN (FROM d) THEN 'STALE' ELSE state END AS state FROM n"""
)
def forced_stale(spark, sf_dir):
    rows = with_states(spark, sf_dir)
    return states.force_stale(rows, edges(spark, sf_dir), rows.where("mtime = 3").select("key"))


@query(
    f"""WITH n AS {STATES}, o AS (SELECT c.key, bool_or(p.state IN ('FAILED', 'INTERRUPTED')) AS b, bool_or(p.state IN ('STALE', 'MISSING')) AS w, bool_or(p.mtime > c.mtime AND p.changed) AS m
  FROM {EDGES} e JOIN n p ON p.key = e.parent JOIN n c ON c.key = e.child GROUP BY c.key), r AS (
SELECT key, 'output_missing' AS reason FROM n WHERE NOT present UNION ALL SELECT key, 'blocked_by_failed_parent' FROM o WHERE b
UNION ALL SELECT key, 'compromised_prior_state' FROM n WHERE state IN ('FAILED', 'INTERRUPTED', 'RUNNING') UNION ALL SELECT key, 'invalidator_changed' FROM n WHERE token
UNION ALL SELECT key, 'parent_not_up_to_date' FROM o WHERE w UNION ALL SELECT key, 'parent_content_changed' FROM o WHERE m)
SELECT * FROM r UNION ALL SELECT key, CASE WHEN state = 'UP_TO_DATE' THEN 'up_to_date' ELSE 'stale' END FROM n WHERE key NOT IN (SELECT key FROM r)"""
)
def explain_reasons(spark, sf_dir):
    rows = with_states(spark, sf_dir).withColumnsRenamed({"present": "exists", "token": "token_changed"})
    return states.reasons(rows, edges(spark, sf_dir))


@query(f"WITH n AS {STATES} SELECT key, CASE WHEN call IN (SELECT call FROM n WHERE state <> 'ORPHAN') THEN 'remove_output' ELSE 'remove_call' END AS action FROM n WHERE state = 'ORPHAN'")
def orphan_actions(spark, sf_dir):
    return states.orphan_actions(with_states(spark, sf_dir))


_CALLS = "(SELECT * REPLACE (key // 2 AS call) FROM " + STATES + " x)"


@query(
    f"""WITH n AS {_CALLS}, o AS (SELECT e.parent AS key, bool_and(state = 'UP_TO_DATE') AS done FROM {EDGES} e JOIN n ON n.key = e.child GROUP BY 1)
SELECT call FROM n LEFT JOIN o USING (key) GROUP BY call HAVING bool_and(coalesce(done, false))"""
)
def removable_intermediates(spark, sf_dir):
    return states.removable(with_states(spark, sf_dir).withColumn("call", F.expr("key div 2")), edges(spark, sf_dir))


@query("SELECT o_orderkey AS key, o_custkey AS label FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def manifest_requested(spark, sf_dir):
    required = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("label"))
    return states.manifest(required, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")))


@query("SELECT p_type AS actual, p_brand AS expected, p_partkey FROM part WHERE (p_type, p_brand) NOT IN (SELECT (p_type, p_brand) FROM part WHERE p_size < 20)")
def type_violations(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.col("p_type").alias("actual"), F.col("p_brand").alias("expected"), "p_partkey", "p_size")
    return states.type_violations(pairs.drop("p_size"), pairs.where("p_size < 20").select("actual", "expected").distinct())


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT source, sha256(string_agg('d/' || doc_id || chr(0) || sha256(text), chr(0) ORDER BY 'd/' || doc_id)) AS digest FROM documents WHERE lang <> 'de' GROUP BY source")
def directory_digest(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(
        "source", F.concat(F.when(F.col("lang") == "de", "_meta/").otherwise("d/"), F.col("doc_id").cast("string")).alias("path"), S.content_hash(F.col("text")).alias("sha")
    )
    return tables.directory_digests(files, "source", "path", "sha")


@query("SELECT conv_id, array_to_string(list(role ORDER BY turn), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY 1, 2) x GROUP BY conv_id")
def ordered_distinct(spark, sf_dir):
    return tables.distinct_in_order(table(spark, sf_dir, "conversations"), "role", "turn", "conv_id", "roles")



_TREE = "(SELECT p_partkey AS key, p_partkey // 2 AS parent, p_brand AS name, p_size AS value FROM part WHERE p_partkey >= 1)"


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with one setting each, and the edges to half of their keys."""
    part = table(spark, sf_dir, "part").where("p_partkey >= 1")
    settings = part.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("name"), F.col("p_size").alias("value"))
    return settings, settings.where("key > 1").select(F.col("key").alias("child"), F.expr("key div 2").alias("parent"), F.lit(0).alias("position"))


@query(
    f"""WITH RECURSIVE t AS MATERIALIZED {_TREE}, up AS (SELECT key, key AS at, 0 AS steps FROM t UNION ALL SELECT up.key, t.parent, steps + 1 FROM up JOIN t ON t.key = up.at WHERE t.parent >= 1)
SELECT up.key, t.name, arg_min(t.value, up.steps) AS value FROM up JOIN t ON t.key = up.at GROUP BY up.key, t.name"""
)
def accumulated_config(spark, sf_dir):
    settings, up = tree(spark, sf_dir)
    return graph.accumulate(settings, up, settings)


@query(
    f"""WITH RECURSIVE t AS MATERIALIZED {_TREE}, f AS (SELECT key, substr(sha256(name), 1, 16) AS fingerprint FROM t WHERE key = 1
UNION ALL SELECT t.key, substr(sha256(t.name || '|' || f.fingerprint), 1, 16) FROM f JOIN t ON t.parent = f.key) SELECT key, fingerprint FROM f"""
)
def fingerprint_lineage(spark, sf_dir):
    settings, up = tree(spark, sf_dir)
    return graph.fingerprints(settings, up, "name")


_TAIL = "'name+' || replace(repeat(p_name, 1 + p_size % 20), ' ', '') || '__price+' || replace(p_size::DOUBLE::VARCHAR, '.', 'p')"


@query(
    f"""SELECT p_partkey, CASE WHEN octet_length(encode('job__' || tail)) <= 250 THEN 'job__' || tail ELSE substr('job__' || tail, 1, 241) || '_' || substr(md5(tail), 1, 8) END AS label
FROM (SELECT p_partkey, {_TAIL} AS tail FROM part) x"""
)
def grid_label(spark, sf_dir):
    parts = {"name": S.grid_token(F.expr("repeat(p_name, 1 + p_size % 20)")), "price": S.number_token(F.col("p_size").cast("double"))}
    return table(spark, sf_dir, "part").select("p_partkey", S.grid_label(F.lit("job"), parts).alias("label"))


@query("SELECT doc_id, left(text, list_max(list_filter(range(0, 242), lambda k: octet_length(encode(left(text, k::BIGINT))) <= 241))::BIGINT) AS text FROM documents")
def truncate_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.truncate_bytes(F.col("text"), 241).alias("text"))


_CELLS = """(SELECT n_regionkey AS axis, n_nationkey AS element, 'name' AS key, n_name AS value FROM {nation} UNION ALL SELECT n_regionkey, n_nationkey, 'group', CAST(n_nationkey % 7 AS STRING) FROM {nation}
UNION ALL SELECT n_regionkey, n_nationkey, 'region', CAST(n_regionkey AS STRING) FROM {nation})"""


@query(
    f"""WITH c AS {_CELLS.format(nation='nation')}, n AS (SELECT axis, count(DISTINCT element) AS n FROM c GROUP BY axis), k AS (SELECT axis, key, count(DISTINCT value) AS d, count(value) AS p FROM c GROUP BY axis, key)
SELECT axis, min(CASE WHEN d = n AND p = n THEN key END) AS label_key FROM k JOIN n USING (axis) GROUP BY axis"""
)
def grid_auto_label(spark, sf_dir):
    return grid.auto_label(spark.sql(_CELLS[1:-1], nation=table(spark, sf_dir, "nation")))


@query("SELECT p_partkey, size, step FROM part, unnest(range(1, 2 + p_size % 3)) a(size), unnest(range(1, 2 + p_size % 2)) b(step)")
def grid_nested_expand(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", "sequence(1L, 1L + p_size % 3) AS size", "sequence(1L, 1L + p_size % 2) AS step")
    return grid.expand_rows(part, ["size", "step"])


@query("SELECT event_id, CAST(json_merge_patch(props, json_object('at', json_object('user', user_id))) AS VARCHAR) AS props FROM events")
def json_set_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.json_set(F.col("props"), "at.user", F.col("user_id").cast("string")).alias("props"))


@query("SELECT conv_id, turn, array_to_string(list_sort(list_filter(string_split(text, ''), lambda c: c <> chr(10))), '') AS chars FROM conversations")
def char_explode_sort(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.sorted_characters(F.col("text")).alias("chars"))


@query("SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(len(embedding)), lambda i: {'v': embedding[i + 1], 'i': i})), lambda x: x.i), ',') AS places FROM embeddings")
def array_cosort(spark, sf_dir):
    places = F.sequence(F.lit(0), F.size("embedding") - 1)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(S.cosort(F.col("embedding"), places), lambda x: x["b"].cast("string")), ",").alias("places"))


@query("SELECT vec_id, round(5 * sin(2 * pi() * vec_id / 500.0::DOUBLE), 6) AS bias FROM embeddings")
def sin_bias(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.sine_bias(F.col("vec_id"), 500, 5.0), 6).alias("bias"))


@query()
def token_diff(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.token_diff("p_type", "p_name").alias("words"))


@query("SELECT r_name, o_orderpriority, c_mktsegment FROM region JOIN (SELECT o_orderpriority FROM orders GROUP BY 1) a ON true JOIN (SELECT c_mktsegment FROM customer GROUP BY 1) b ON true")
def grid_cross_product(spark, sf_dir):
    axes = (("region", "r_name"), ("orders", "o_orderpriority"), ("customer", "c_mktsegment"))
    return grid.cross([table(spark, sf_dir, t).select(c).distinct() for t, c in axes])


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.confident(table(spark, sf_dir, "lineitem"), 0.05, "l_linenumber", "l_discount")


_MATCHES = "(SELECT * FROM lineitem WHERE NOT (l_linenumber <> 1 OR l_discount > 0.05))"


@query(f"SELECT l_orderkey, l_partkey, l_suppkey FROM {_MATCHES} m")
def recal_filter(spark, sf_dir):
    return matches(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey")


@query(
    f"""WITH m AS {_MATCHES}, o AS (SELECT median(l_extendedprice) AS o FROM m)
SELECT o AS ppm_offset, list_min(list(l_extendedprice - o)) AS precursor_lo, list_max(list(l_extendedprice - o)) AS precursor_hi, list_min(list(l_quantity - o)) AS fragment_lo, list_max(list(l_quantity - o)) AS fragment_hi FROM m, o GROUP BY o"""
)
def recal_fit(spark, sf_dir):
    return spectra.fit_recalibration(matches(spark, sf_dir), "l_extendedprice", "l_quantity")


@query("SELECT * FROM (SELECT unnest(['F', 'O', 'P']) AS state, unnest([count_if(o_orderstatus = 'F'), count_if(o_orderstatus = 'O'), count_if(o_orderstatus = 'P')])::BIGINT AS n FROM orders) x WHERE n > 0")
def state_counts(spark, sf_dir):
    return runs.state_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("state")))


@query("SELECT r AS resource, coalesce((SELECT sum(l_quantity) FROM lineitem WHERE l_returnflag = r), 0)::BIGINT AS used, (c - coalesce((SELECT sum(l_quantity) FROM lineitem WHERE l_returnflag = r), 0))::BIGINT AS available FROM (VALUES ('A', 9000000), ('N', 80000000), ('gpu', 4)) v(r, c)")
def resource_usage(spark, sf_dir):
    caps = spark.createDataFrame([("A", 9000000), ("N", 80000000), ("gpu", 4)], "resource string, cap long")
    return runs.resource_usage(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("resource"), F.col("l_quantity").cast("long").alias("amount")), caps)


@query("SELECT r_name AS label, n_name AS node FROM nation, region WHERE n_regionkey = r_regionkey AND r_name IN ('ASIA', 'EUROPE')")
def resolve_labels(spark, sf_dir):
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    nodes = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(F.col("r_name").alias("label"), F.col("n_name").alias("node"))
    return runs.resolve(spark.createDataFrame([("ASIA",), ("EUROPE",), ("ASIA",)], "label string"), nodes)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'")
def compromised_filter(spark, sf_dir):
    state = F.create_map(F.lit("F"), F.lit("failed"), F.lit("P"), F.lit("running"), F.lit("O"), F.lit("up_to_date"))
    return table(spark, sf_dir, "orders").where(runs.compromised(F.try_element_at(state, F.col("o_orderstatus")))).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size % 5 = 0 OR (p_size % 3 = 0 AND p_type <> p_brand)")
def invalidation_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    recorded = F.when(F.col("p_size") % 5 != 0, F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")))
    return part.where(runs.invalidated(F.col("p_brand"), recorded)).select("p_partkey")


@query(
    """WITH RECURSIVE r AS MATERIALIZED (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
g AS (SELECT p_brand, p_partkey, k, p_size::BIGINT AS used, true AS taken FROM r WHERE k = 1
UNION ALL SELECT r.p_brand, r.p_partkey, r.k, g.used + CASE WHEN g.used + r.p_size <= 500 THEN r.p_size ELSE 0 END, g.used + r.p_size <= 500 FROM g JOIN r ON r.p_brand = g.p_brand AND r.k = g.k + 1)
SELECT p_partkey FROM g WHERE taken"""
)
def admission_prefix(spark, sf_dir):
    return runs.admitted(table(spark, sf_dir, "part"), 500, "p_brand", "p_partkey", "p_size").select("p_partkey")


@query("SELECT a.p_type, a.p_partkey, count(*)::INT AS place FROM part a JOIN part b ON a.p_type = b.p_type AND b.p_partkey <= a.p_partkey GROUP BY ALL")
def schedule_order_fifo(spark, sf_dir):
    return runs.schedule(table(spark, sf_dir, "part"), "p_type", "p_partkey").select("p_type", "p_partkey", "place")


@query(
    """WITH s AS MATERIALIZED (SELECT p_type, p_brand, count(*) AS size FROM part GROUP BY ALL), p AS MATERIALIZED (SELECT p_type, p_partkey, size FROM part JOIN s USING (p_type, p_brand))
SELECT a.p_partkey, a.size, count(*)::INT AS place FROM p a JOIN p b ON a.p_type = b.p_type AND (b.size < a.size OR (b.size = a.size AND b.p_partkey <= a.p_partkey)) GROUP BY ALL"""
)
def schedule_order(spark, sf_dir):
    return runs.schedule(table(spark, sf_dir, "part"), "p_type", "p_partkey", "p_brand").select("p_partkey", "size", "place")


@query("SELECT p_name AS node, CASE WHEN count(DISTINCT p_type) = 1 AND bool_and(p_type IS NOT NULL) THEN any_value(p_type) END AS section FROM (SELECT p_name, CASE WHEN p_size > 2 THEN p_type END AS p_type FROM part WHERE p_size < 9) x GROUP BY p_name")
def section_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_size < 9").select(F.col("p_name").alias("node"), F.when(F.col("p_size") > 2, F.col("p_type")).alias("section"))
    return runs.agreed_sections(rows)


@query("SELECT conv_id, turn, role FROM conversations c WHERE role IS DISTINCT FROM (SELECT role FROM conversations b WHERE b.conv_id = c.conv_id AND b.turn < c.turn ORDER BY b.turn DESC LIMIT 1)")
def adjacent_dedup(spark, sf_dir):
    return tables.adjacent_distinct(table(spark, sf_dir, "conversations"), "role", ["turn"], ["conv_id"]).select("conv_id", "turn", "role")


@query("SELECT a.conv_id, a.turn, count(*)::INT AS place FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND (b.text < a.text OR (b.text = a.text AND b.turn <= a.turn)) GROUP BY ALL")
def line_sort(spark, sf_dir):
    return tables.placed(table(spark, sf_dir, "conversations"), ["text", "turn"], ["conv_id"]).select("conv_id", "turn", "place")


@query("SELECT x.part, CASE x.part WHEN 1 THEN r_name ELSE n_name END AS name FROM region FULL JOIN nation ON false, LATERAL (SELECT CASE WHEN r_name IS NOT NULL THEN 1 ELSE 2 END::INT AS part) x")
def union_all_ordered(spark, sf_dir):
    return tables.concatenated([table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in (("region", "r_name"), ("nation", "n_name"))])


@query("SELECT n_nationkey AS k, coalesce((SELECT r_name FROM region WHERE r_regionkey = n_nationkey), '') AS r_name, n_name FROM nation")
def zip_lines(spark, sf_dir):
    left = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name")
    return tables.pasted(left, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "k")


@query("SELECT p_type AS rule, p_brand AS fingerprint, count_if(p_size > 40) > 0 AS forced, list_max(list(p_size)) AS threads, len(list(p_size))::BIGINT AS n FROM part GROUP BY ALL")
def rule_call_groups(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return runs.call_groups(part.select(F.col("p_type").alias("rule"), F.col("p_brand").alias("fingerprint"), (F.col("p_size") > 40).alias("forced"), F.col("p_size").alias("threads")))


@query("SELECT DISTINCT c.p_brand AS child_call, p.p_brand AS parent_call FROM part c, part p WHERE (p.p_partkey = c.p_partkey // 2 OR p.p_partkey = c.p_partkey // 3) AND c.p_brand <> p.p_brand")
def rule_call_edges(spark, sf_dir):
    return runs.call_edges(nodes(spark, sf_dir).select("key", F.col("kind").alias("call")), edges(spark, sf_dir))


@query(_CLOSURE + " SELECT p_partkey AS key, p_brand AS state, p_size AS size FROM part WHERE p_partkey % 3 <> 0 AND p_partkey IN (FROM c)")
def exec_summary(spark, sf_dir):
    events = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("state"), F.col("p_size").alias("size"))
    return runs.execution_summary(events, requested(spark, sf_dir), edges(spark, sf_dir))


@query("SELECT s_suppkey AS k, s_name AS v FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def config_patch(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return tables.overlaid(base, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), "k", "v")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (ORDER BY user_id, event_id) <= 100")
def head_n(spark, sf_dir):
    return tables.head(table(spark, sf_dir, "events").select("event_id", "user_id"), 100, ["user_id", "event_id"])


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_type ELSE 'output' END AS label FROM part")
def display_label(spark, sf_dir):
    k = F.col("p_size") % 3
    return table(spark, sf_dir, "part").select("p_partkey", S.display_label(F.when(k == 0, F.col("p_brand")), F.when(k == 1, F.col("p_type")), F.lit(None).cast("string")).alias("label"))


@query("SELECT o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY o_orderpriority")
def flagship_pipeline(spark, sf_dir):
    from .plans.flagship import flagship

    return flagship(spark, sf_dir)


@query(
    """WITH s AS MATERIALIZED (SELECT vec_id AS spectrum, (500 + vec_id % 997) * (1 + (25 + 3 * sin(vec_id / 50.0::DOUBLE)) * 1e-6::DOUBLE) AS mz, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS total FROM embeddings),
l AS MATERIALIZED (SELECT DISTINCT vec_id % 997 AS peptide, 500.0::DOUBLE + vec_id % 997 AS mass FROM embeddings),
top AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (ORDER BY total DESC, spectrum) <= 200),
one AS MATERIALIZED (SELECT spectrum, peptide, (mz - mass) / mass * 1e6 AS e FROM top, l WHERE abs((mz - mass) / mass * 1e6) <= 50 QUALIFY row_number() OVER (PARTITION BY spectrum ORDER BY abs((mz - mass) / mass), peptide) = 1),
f AS MATERIALIZED (SELECT median(e) AS o, min(e) - median(e) - 1 AS lo, max(e) - median(e) + 1 AS hi FROM one),
two AS (SELECT spectrum, peptide, (mz / (1 + o * 1e-6) - mass) / mass * 1e6 AS e FROM s, l, f WHERE (mz / (1 + o * 1e-6) - mass) / mass * 1e6 BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY spectrum ORDER BY abs((mz / (1 + o * 1e-6) - mass) / mass), peptide) = 1)
SELECT 1 AS pass, spectrum, peptide, round(e, 4) AS error_ppm FROM one UNION ALL SELECT 2, spectrum, peptide, round(e, 4) FROM two"""
)
def two_pass_recalibration(spark, sf_dir):
    from .plans.two_pass import two_pass

    return two_pass(spark, sf_dir)
