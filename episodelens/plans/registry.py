"""Queries by name, with their SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rotation, text
from ..operators import align, checks, flatten, image_audit, images, metrics, reconcile, vectors
from ..sources.tables import image_integrity, profile, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NS = re.compile(r"NS\((\w[\w.]*)\)")


def query(oracle: str | None = None):
    """Registers a function (tables -> DataFrame) under its name; tables is called with a table's name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(lambda name: table(spark, folder, name))
        if oracle:
            ORACLES[f.__name__] = NS.sub(r"(epoch_us(\1) * 1000)", oracle)
        return f

    return add


def sql(name: str, tables: str, statement: str, oracle: str | None = None) -> None:
    """Registers one statement for both engines; tables are written {name}, nanoseconds NS(column)."""
    spark_text = NS.sub(r"(unix_micros(cast(\1 AS timestamp)) * 1000)", statement)
    QUERIES[name] = lambda spark, folder: spark.sql(spark_text, **{t: table(spark, folder, t) for t in tables.split()})
    ORACLES[name] = NS.sub(r"(epoch_us(\1) * 1000)", (oracle or statement).replace("{", "").replace("}", ""))


def _events(t) -> DataFrame:
    return t("events").select("event_id", "user_id", "event_type", "value", align.ns("ts").alias("at"))


_EV = "WITH e AS (SELECT event_id, user_id, event_type, value, NS(ts) AS t FROM events)"


@query(f"""{_EV}, p AS (SELECT x.event_id AS target_id, x.t AS target_ns, y.event_id AS matched_id, abs(y.t - x.t) AS diff_ns,
  row_number() OVER (PARTITION BY x.event_id ORDER BY abs(y.t - x.t), y.event_id) AS r
  FROM e x LEFT JOIN e y ON x.user_id = y.user_id AND y.event_type = 'purchase' WHERE x.event_type = 'error')
SELECT target_id, target_ns, matched_id, diff_ns FROM p WHERE r = 1""")
def nearest_event_per_target(t):
    e = _events(t)
    out = align.nearest(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), ["user_id"], "at", "at", "event_id", [])
    return out.select(F.col("event_id").alias("target_id"), F.col("at").alias("target_ns"), F.col("nearest.tie").alias("matched_id"), "diff_ns")


def _grid(t) -> DataFrame:
    """A target at noon of each day for each event type."""
    day = align.DAY_NS
    return _events(t).select("event_type", F.expr(f"at div {day} * {day} + {day // 2}").alias("target_ns")).distinct()


_GRID = f"{_EV}, g AS (SELECT DISTINCT event_type, t // {align.DAY_NS} * {align.DAY_NS} + {align.DAY_NS // 2} AS target_ns FROM e)"


@query(f"""{_GRID}, p AS (SELECT g.event_type, g.target_ns, e.event_id AS matched_id, abs(e.t - g.target_ns) AS diff_ns,
  row_number() OVER (PARTITION BY g.event_type, g.target_ns ORDER BY abs(e.t - g.target_ns), e.event_id) AS r FROM g JOIN e USING (event_type))
SELECT event_type, target_ns, matched_id, diff_ns FROM p WHERE r = 1""")
def nearest_per_topic(t):
    out = align.nearest(_grid(t), _events(t), ["event_type"], "target_ns", "at", "event_id", [])
    return out.select("event_type", "target_ns", F.col("nearest.tie").alias("matched_id"), "diff_ns")


_BR = f"""{_GRID}, b AS (SELECT g.*, (SELECT max(t) FROM e WHERE e.event_type = g.event_type AND t <= target_ns) AS before_ns, (SELECT min(t) FROM e WHERE e.event_type = g.event_type AND t >= target_ns) AS after_ns FROM g)
, v AS (SELECT b.*, x.value AS bv, y.value AS av FROM b LEFT JOIN e x ON x.event_type = b.event_type AND x.t = before_ns LEFT JOIN e y ON y.event_type = b.event_type AND y.t = after_ns)"""


def _bracket(t) -> DataFrame:
    return align.bracket(_grid(t), _events(t), ["event_type"], "target_ns", "at", "event_id", ["value"])


@query(f"{_BR} SELECT event_type, target_ns, before_ns, after_ns FROM b")
def bracket_neighbors(t):
    return _bracket(t).select("event_type", "target_ns", F.col("before.ts").alias("before_ns"), F.col("after.ts").alias("after_ns"))


TOLERANCE = 120_000_000_000
_STRATEGY = f"""CASE WHEN least(target_ns - before_ns, after_ns - target_ns) <= {TOLERANCE} THEN 'nearest' WHEN before_ns IS NULL AND after_ns IS NULL THEN 'single_value'
  WHEN before_ns IS NULL THEN 'clamp_first' WHEN after_ns IS NULL THEN 'clamp_last' WHEN before_ns = after_ns THEN 'single_value' ELSE 'interpolated' END"""


@query(f"{_BR}, s AS (SELECT *, {_STRATEGY} AS strategy FROM b) SELECT event_type, target_ns, strategy, round(CASE WHEN strategy = 'interpolated' THEN (target_ns - before_ns)::DOUBLE / (after_ns - before_ns) END, 6) AS ratio FROM s")
def resolve_strategy(t):
    out = _bracket(t).withColumn("s", align.resolve(F.col("before.ts"), F.col("after.ts"), F.col("target_ns"), TOLERANCE))
    return out.select("event_type", "target_ns", "s.strategy", F.round("s.ratio", 6).alias("ratio"))


@query(f"{_BR}, s AS (SELECT *, {_STRATEGY} AS strategy FROM v) SELECT event_type, target_ns, round(CASE WHEN strategy = 'interpolated' THEN bv + (av - bv) * ((target_ns - before_ns)::DOUBLE / (after_ns - before_ns)) WHEN av IS NULL OR target_ns - before_ns <= after_ns - target_ns THEN bv ELSE av END, 4) AS value FROM s")
def interpolate_value(t):
    out = _bracket(t).withColumn("s", align.resolve(F.col("before.ts"), F.col("after.ts"), F.col("target_ns"), TOLERANCE))
    b, a = F.col("before"), F.col("after")
    single = F.when(a.isNull() | (F.col("target_ns") - b["ts"] <= a["ts"] - F.col("target_ns")), b["value"]).otherwise(a["value"])
    value = F.when(F.col("s.strategy") == "interpolated", align.lerp(b["value"], a["value"], F.col("s.ratio"))).otherwise(single)
    return out.select("event_type", "target_ns", F.round(value, 4).alias("value"))


_Q = """WITH r AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS a, list_transform(embedding[5:8], lambda x: x::DOUBLE) AS b FROM embeddings),
 n AS (SELECT vec_id, list_transform(a, lambda x: x / sqrt(list_inner_product(a, a))) AS p, list_transform(b, lambda x: x / sqrt(list_inner_product(b, b))) AS q FROM r)"""


def _quaternions(t) -> DataFrame:
    part = lambda at: rotation.normalize(F.slice(F.col("embedding").cast("array<double>"), at, 4))
    return t("embeddings").select("vec_id", part(1).alias("p"), part(5).alias("q"))


@query(f"""{_Q}, d AS (SELECT *, list_inner_product(p, q) AS raw FROM n), c AS (SELECT *, CASE WHEN raw < 0 THEN -1.0 ELSE 1.0 END AS s, least(abs(raw), 1.0) AS c, acos(least(abs(raw), 1.0)) AS th FROM d),
 f AS (SELECT *, list_transform([1, 2, 3, 4], lambda i: p[i] + (q[i] * s - p[i]) * 0.25) AS flat, list_transform([1, 2, 3, 4], lambda i: (p[i] * sin(0.75 * th) + q[i] * s * sin(0.25 * th)) / sin(th)) AS curved FROM c),
 g AS (SELECT vec_id, CASE WHEN c > 0.9995 THEN list_transform(flat, lambda x: x / sqrt(list_inner_product(flat, flat))) ELSE curved END AS v FROM f)
SELECT vec_id, round(v[1], 6) + 0.0 AS x, round(v[2], 6) + 0.0 AS y, round(v[3], 6) + 0.0 AS z, round(v[4], 6) + 0.0 AS w FROM g""")
def slerp_embedding_pose(t):
    out = _quaternions(t).withColumn("v", rotation.slerp(F.col("p"), F.col("q"), F.lit(0.25)))
    return out.select("vec_id", *((F.round(F.get("v", F.lit(i)), 6) + 0.0).alias(n) for i, n in enumerate("xyzw")))


@query(f"""{_Q}, s AS (SELECT vec_id, p, 2 * (p[4] * p[2] - p[3] * p[1]) AS s FROM n) SELECT vec_id, round(atan2(2 * (p[4] * p[1] + p[2] * p[3]), 1 - 2 * (p[1] * p[1] + p[2] * p[2])), 5) + 0.0 AS roll,
 round(CASE WHEN abs(s) >= 1 THEN sign(s) * pi() / 2 ELSE asin(s) END, 5) + 0.0 AS pitch, round(atan2(2 * (p[4] * p[3] + p[1] * p[2]), 1 - 2 * (p[2] * p[2] + p[3] * p[3])), 5) + 0.0 AS yaw FROM s""")
def quaternion_to_euler(t):
    out = _quaternions(t).withColumn("e", rotation.euler_zyx(F.col("p")))
    return out.select("vec_id", *((F.round(f"e.{n}", 5) + 0.0).alias(n) for n in ("roll", "pitch", "yaw")))


LABELS = ["x", "y", "z", "roll", "pitch", "yaw", "angle"]


def _long(t, change=lambda v: v) -> DataFrame:
    """A vector's first 28 values as section, group, label, value."""
    rows = t("embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 28)).alias("i", "v"))
    label = F.get(F.array(*map(F.lit, LABELS)), F.col("i") % 7)
    return rows.select("vec_id", F.when(F.col("i") < 14, "action").otherwise("observation_state").alias("section"), F.when(F.expr("i div 7") % 2 == 0, "left").otherwise("right").alias("grp"), label.alias("label"), change(F.col("v").cast("double")).alias("value"))


_LONG = f"""WITH l AS (SELECT vec_id, CASE WHEN i < 14 THEN 'action' ELSE 'observation_state' END AS section, CASE WHEN i // 7 % 2 = 0 THEN 'left' ELSE 'right' END AS grp, {LABELS}[i % 7 + 1] AS label, embedding[i + 1]::DOUBLE AS value
 FROM embeddings, range(28) r(i))"""


@query(f"{_LONG} SELECT vec_id, section, grp, label, round(value, 6) AS value FROM l")
def pose_vector_long(t):
    return _long(t).withColumn("value", F.round("value", 6))


@query(f"{_LONG} SELECT section, grp, label, count(*) AS n, count(*) FILTER (abs(value - (value + value * 0.01)) <= 0.0005) AS within FROM l GROUP BY ALL")
def compare_vectors_tolerance(t):
    out = reconcile.vectors(_long(t), _long(t, lambda v: v + v * 0.01), ["vec_id", "section", "grp"])
    return out.groupBy("section", "grp", "label").agg(F.count("*").alias("n"), F.count_if("within").alias("within"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, NS(o_orderdate) AS d, lag(NS(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders)
SELECT o_custkey::VARCHAR AS entity, o_orderkey AS row_index, d::VARCHAR AS actual FROM p WHERE d <= b""")
def monotonic_violations(t):
    rows = t("orders").select("o_custkey", "o_orderkey", align.ns("o_orderdate").alias("d"))
    return checks.increasing(rows, "o_custkey", "o_orderkey", "d").select("entity", "row_index", "actual")


@query("""WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events WHERE event_id % 13 <> 5),
 g AS (SELECT *, k + CASE WHEN event_id % 11 = 3 THEN 2 ELSE 0 END AS i FROM f)
SELECT user_id::VARCHAR AS entity, event_id AS row_index, k::VARCHAR AS expected, i::VARCHAR AS actual FROM g WHERE i <> k""")
def index_continuity(t):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = t("events").where("event_id % 13 <> 5").select("user_id", "event_id", (place + F.when(F.col("event_id") % 11 == 3, 2).otherwise(0)).alias("i"))
    return checks.continuous(rows, "user_id", "event_id", "i").select("entity", "row_index", "expected", "actual")


_PART = "SELECT user_id, event_id, value, value / max(value) OVER (PARTITION BY user_id) AS p FROM events"


@query(f"WITH a AS ({_PART}), b AS (SELECT *, lag(p) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM a) SELECT user_id::VARCHAR AS entity, event_id AS row_index FROM b WHERE p < q OR p < 0 OR p > 1 OR p IS NULL")
def progress_regression(t):
    rows = t("events").select("user_id", "event_id", (F.col("value") / F.max("value").over(Window.partitionBy("user_id"))).alias("p"))
    return checks.progress(rows, "user_id", "event_id", "p").select("entity", "row_index")


@query("SELECT conv_id::VARCHAR AS entity, turn AS row_index FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE (turn = m) <> (role = 'assistant')")
def last_row_flag(t):
    rows = t("conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("done"))
    return checks.done_flags(rows, "conv_id", "turn", "done").select("entity", "row_index")


@query("""WITH d AS (SELECT user_id, NS(ts) // 86400000000000 AS day, list(length(event_type) ORDER BY event_id) AS levels FROM events GROUP BY 1, 2)
SELECT user_id, day, len(levels)::INTEGER AS n, len(list_filter(range(1, len(levels)), lambda i: levels[i + 1] <= levels[i])) = 0 AS increasing FROM d""")
def level_order(t):
    rows = t("events").withColumn("day", F.expr(f"unix_micros(cast(ts AS timestamp)) * 1000 div {align.DAY_NS}"))
    lists = rows.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("event_id", F.length("event_type").alias("l")))).alias("x")).select("user_id", "day", F.transform("x", lambda v: v["l"]).alias("levels"))
    return lists.select("user_id", "day", F.size("levels").alias("n"), checks.levels_increase(F.col("levels")).alias("increasing"))


_START = 1_700_000_000_000_000_000


@query(f"""WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
 g AS (SELECT *, {_START} + round_even(n * 1e9 / 30, 0)::BIGINT + CASE WHEN event_id % 17 = 0 THEN 5000 ELSE event_id % 700 END AS o, n / 30.0::DOUBLE + CASE WHEN event_id % 23 = 0 THEN 0.001 ELSE 0 END AS s FROM f)
SELECT 'grid_seconds' AS "check", user_id::VARCHAR AS entity, event_id AS row_index FROM g WHERE event_id % 23 = 0
UNION ALL SELECT 'grid_origin', user_id::VARCHAR, event_id FROM g WHERE event_id % 17 = 0""")
def fixed_grid_check(t):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = t("events").select("user_id", "event_id", n.alias("n"))
    origin = F.lit(_START) + F.bround(F.col("n") * 1e9 / 30).cast("long") + F.when(F.col("event_id") % 17 == 0, 5000).otherwise(F.col("event_id") % 700)
    rows = rows.select("user_id", "event_id", origin.alias("o"), (F.col("n") / F.lit(30.0) + F.when(F.col("event_id") % 23 == 0, 0.001).otherwise(0.0)).alias("s"), F.lit(_START).alias("t0"))
    return checks.fixed_grid(rows, "user_id", "event_id", "s", "o", "t0").select("check", "entity", "row_index")




@query("""SELECT doc_id, strpos(text, 'th') > 0 AND strpos(substr(text, strpos(text, 'th') + 2), 'er') > 0 AND strpos(substr(text, strpos(text, 'th') + 2 + strpos(substr(text, strpos(text, 'th') + 2), 'er') + 1), 'on') > 0 AS ordered FROM documents""")
def path_contains_in_order(t):
    return t("documents").select("doc_id", text.ordered_in(F.col("text"), F.array(F.lit("th"), F.lit("er"), F.lit("on"))).alias("ordered"))




@query("""WITH i AS (SELECT user_id, NS(ts) // 86400000000000 AS day, min(NS(ts)) AS start_ns, max(NS(ts)) AS end_ns FROM events GROUP BY 1, 2),
 e AS (SELECT concat(user_id, '-', day) AS episode_id, user_id, start_ns, end_ns FROM i), w AS (SELECT user_id, start_ns, end_ns + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS end_ns FROM i)
SELECT w.user_id, w.start_ns, w.end_ns, count(e.episode_id) AS n_matches, CASE WHEN count(e.episode_id) = 1 THEN min(e.episode_id) END AS episode_id FROM w LEFT JOIN e USING (user_id, start_ns, end_ns) GROUP BY ALL""")
def episode_index_unique(t):
    index = t("events").select("user_id", align.ns("ts").alias("at")).withColumn("day", F.expr(f"at div {align.DAY_NS}")).groupBy("user_id", "day").agg(F.min("at").alias("start_ns"), F.max("at").alias("end_ns"))
    wanted = index.select("user_id", "start_ns", (F.col("end_ns") + F.when(F.col("user_id") % 10 == 0, 1).otherwise(0)).alias("end_ns"))
    episodes = index.select("user_id", "start_ns", "end_ns", F.concat_ws("-", "user_id", "day").alias("episode_id"))
    return align.resolve_episode(episodes, wanted, ["user_id", "start_ns", "end_ns"])




@query("""WITH e AS (SELECT doc_id, CASE WHEN n_chars > 200 THEN 1 ELSE 0 END AS q FROM documents WHERE doc_id % 3 <> 0), a AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id)
SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'unexpected' WHEN e.q IS NOT DISTINCT FROM a.q THEN 'equal' ELSE 'different' END AS state FROM e FULL JOIN a ON e.doc_id = a.doc_id""")
def reconcile_full_outer(t):
    expected = t("documents").where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("n_chars") > 200, 1).otherwise(0).alias("q"))
    actual = t("labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return reconcile.full_outer(expected, actual, ["doc_id"], ["q"]).select("doc_id", "state")




@query("""WITH r AS (SELECT conv_id, turn, 'i' || turn AS id, role || turn AS name, turn * 10 AS s, turn * 10 + 9 AS e FROM conversations), a AS (SELECT conv_id, id, name, s + CASE WHEN turn % 3 = 1 THEN 1 ELSE 0 END AS s, e FROM r WHERE turn % 5 <> 4)
SELECT r.conv_id, r.turn::INTEGER AS level, r.id AS expected_id, a.id AS actual_id, CASE WHEN a.id IS NULL THEN 'missing' ELSE 'id' END AS matched, CASE WHEN a.s <> r.s THEN 'start_ns' ELSE '' END AS differences FROM r LEFT JOIN a ON r.conv_id = a.conv_id AND r.id = a.id""")
def expected_actual_match(t):
    rows = t("conversations").select("conv_id", F.col("turn").cast("int").alias("level"), F.col("turn").alias("ord"), F.concat(F.lit("i"), "turn").alias("id"), F.concat("role", "turn").alias("name"), (F.col("turn") * 10).alias("start_ns"), (F.col("turn") * 10 + 9).alias("end_ns"))
    actual = rows.where("ord % 5 <> 4").withColumn("start_ns", F.col("start_ns") + F.when(F.col("ord") % 3 == 1, 1).otherwise(0))
    return reconcile.match_annotations(rows, actual, "conv_id").select("conv_id", "level", "expected_id", "actual_id", "matched", "differences")


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part")
def distinct_unnest(t):
    return t("part").select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("token")).distinct()




@query("SELECT event_id, printf('%d.%09d', (NS(ts)) // 1000000000, (NS(ts)) % 1000000000) AS seconds, concat((value::BIGINT) // 60, 'm', (value::BIGINT) % 60, 's') AS elapsed FROM (SELECT event_id, ts, floor(value) AS value FROM events)")
def ns_text_format(t):
    return t("events").select("event_id", text.ns_seconds(align.ns("ts")).alias("seconds"), text.minutes_seconds(F.col("value")).alias("elapsed"))


@query("""WITH c AS (SELECT page_id, url, regexp_replace(regexp_replace(coalesce(url, ''), '[^0-9A-Za-z_\\x{4e00}-\\x{9fff}-]+', '_', 'g'), '^_+|_+$', '', 'g') AS n FROM pages)
SELECT page_id, CASE WHEN n = '' THEN 'unknown' ELSE n END AS name, CASE WHEN contains(url, '_l') THEN 'left' WHEN contains(url, '_r') THEN 'right' WHEN n = '' THEN 'unknown' ELSE n END AS side FROM c""")
def sanitize_filename(t):
    return t("pages").select("page_id", text.file_name(F.col("url")).alias("name"), text.column_side(F.col("url")).alias("side"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, NULL::VARCHAR AS missing FROM events")
def json_path_get(t):
    v = F.parse_json("props")
    return t("events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.none[0]", "string").alias("missing"))


_POLICIES = ["", "exact_frame", "5", " 2.5 ", "-1", "soon", "0", "0.0000005"]


@query(f"""WITH p AS (SELECT event_id, ({_POLICIES})[event_id % 8 + 1] AS policy FROM events), v AS (SELECT *, trim(policy) AS t, try_cast(trim(policy) AS DOUBLE) AS ms FROM p)
SELECT event_id, CASE WHEN t = '' THEN 3000000 WHEN t = 'exact_frame' THEN 3000000 WHEN ms >= 0 THEN round_even(ms * 1e6, 0)::BIGINT END AS tolerance FROM v""")
def sync_policy_parse(t):
    policy = F.get(F.array(*map(F.lit, _POLICIES)), (F.col("event_id") % 8).cast("int"))
    return t("events").select("event_id", text.tolerance_ns(policy).alias("tolerance"))


@query("SELECT conv_id, turn AS level, 'seg-' || conv_id || '-' || turn AS id, role AS name, turn * 1000000000 AS start_ns, (turn + 1) * 1000000000 AS end_ns FROM conversations")
def nested_layers_flatten(t):
    item = F.struct(F.col("turn").cast("string").alias("level"), F.lit("").alias("id"), F.concat_ws("-", F.lit("seg"), "conv_id", "turn").alias("segmentId"), F.col("role").alias("description"), (F.col("turn") * 10**9).cast("string").alias("startTimeNs"), ((F.col("turn") + 1) * 10**9).cast("string").alias("endTimeNs"))
    docs = t("conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(item)).alias("json")).withColumn("row", F.lit(0))
    flat = checks.hierarchy(docs, "conv_id", "row", "json").select("conv_id", F.explode("levels").alias("l"))
    return flat.select("conv_id", F.col("l.level").cast("bigint").alias("level"), "l.id", "l.name", "l.start_ns", "l.end_ns")


@query("SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN event_type ELSE (event_id)::VARCHAR END AS BIGINT) AS as_long, try_cast(CASE WHEN event_id % 4 = 0 THEN 'x' ELSE event_id || '.5' END AS DOUBLE) AS as_double, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'fallback' END AS filled FROM events")
def lenient_cast(t):
    i = F.col("event_id")
    return t("events").select("event_id", text.lenient_long(F.when(i % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit(" "), i, F.lit(" ")))).alias("as_long"), text.lenient_double(F.when(i % 4 == 0, "x").otherwise(F.concat(i, F.lit(".5")))).alias("as_double"), text.first_filled(F.when(i % 2 == 0, F.col("event_type")).otherwise(""), F.lit("fallback")).alias("filled"))


def _profile_sql(name: str, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls FROM {name}" for c in columns.split())


@query(_profile_sql("lineitem", "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"))
def schema_profile(t):
    return profile(t("lineitem"))


@query("SELECT 'html' AS \"column\", count(*) AS rows, count(*) - count(html) AS nulls, count(*) = count(html) AND count(*) > 0 AS complete FROM pages")
def null_integrity(t):
    return image_integrity(t("pages").select(F.struct(F.col("html").cast("binary").alias("bytes"), F.col("url").alias("path")).alias("html")))


sql("topn_preview", "orders", "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor((x::DOUBLE + 0.6) * 200), 0), 255)::INTEGER) AS a FROM embeddings), p AS (SELECT vec_id, a[i + 1] AS x, least(a[i + 1] + CASE WHEN i % 9 = 0 THEN 40 ELSE vec_id % 6 END, 255) AS y FROM b, range(64) r(i))
SELECT vec_id, round(count(*) FILTER (abs(x - y) <= 10) / 64.0, 6)::DOUBLE AS matched_ratio, round(sum(abs(x - y)) / 64.0, 6)::DOUBLE AS mae, max(abs(x - y))::INTEGER AS max_error FROM p GROUP BY vec_id""")
def image_compare_metrics(t):
    byte = lambda v: F.least(F.greatest(F.floor((v.cast("double") + 0.6) * 200), F.lit(0)), F.lit(255)).cast("int")
    rows = t("embeddings").withColumn("a", F.transform("embedding", byte))
    rows = rows.withColumn("b", F.transform("a", lambda x, i: F.least(x + F.when(i % 9 == 0, 40).otherwise((F.col("vec_id") % 6).cast("int")), F.lit(255))))
    image = lambda c: F.struct(F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("data"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit("mono8").alias("encoding"))
    out = rows.select("vec_id", images.compare_udf()(image(F.col("a")), image(F.col("b"))).alias("r"))
    return out.select("vec_id", F.round("r.matched_ratio", 6).alias("matched_ratio"), F.round("r.mae", 6).alias("mae"), "r.max_error")


@query(f"{_EV} SELECT event_id, event_type, t AS log_ns FROM e WHERE event_type IN ('error', 'view') AND t >= 1704499200000000000 AND t < 1704931200000000000")
def topic_time_scan(t):
    rows = t("events").select("event_id", "event_type", align.ns("ts").alias("log_ns"))
    return align.scan_window(rows, "event_type", ["error", "view"], "log_ns", 1704499200000000000, 1704931200000000000)


@query("SELECT user_id, ((max(NS(ts)) - min(NS(ts))) * 30 // 1000000000 + 1)::BIGINT AS frames FROM events GROUP BY user_id")
def expected_frame_count(t):
    spans = t("events").groupBy("user_id").agg((F.max(align.ns("ts")) - F.min(align.ns("ts"))).alias("span"))
    return spans.select("user_id", checks.frame_count(F.col("span")).alias("frames"))


@query("SELECT user_id, event_type, count(*) AS row_count, min(event_id) AS first_row, max(event_id) AS last_row, arg_min(NS(ts), event_id) AS first_timestamp, arg_max(NS(ts), event_id) AS last_timestamp, min(value) AS first_playback, max(value) AS last_playback FROM events GROUP BY user_id, event_type")
def annotation_summary(t):
    return checks.summarize(_events(t), ["user_id", "event_type"], "event_id", "at", "value")


@query("SELECT l.event_type, count(e.event_id) AS n FROM (VALUES ('click'), ('error'), ('none')) AS l(event_type) LEFT JOIN events e USING (event_type) GROUP BY ALL")
def level_counts_with_zero(t):
    return metrics.level_counts(t("events"), "event_type", ["click", "error", "none"])


@query("SELECT p_brand, count(DISTINCT p_type) AS definitions FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def conflicting_definitions(t):
    return metrics.conflicts(t("part"), ["p_brand"], ["p_type"])


@query("""WITH s AS (SELECT event_id, user_id, NS(ts) AS a, lead(NS(ts), 3) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT s.event_id AS span_id, count(e.event_id) AS inside FROM s LEFT JOIN events e ON e.user_id = s.user_id AND NS(e.ts) BETWEEN s.a AND s.b WHERE s.event_id % 10 = 0 GROUP BY s.event_id""")
def interval_containment(t):
    e = _events(t)
    spans = e.select("event_id", "user_id", F.col("at").alias("a"), F.lead("at", 3).over(Window.partitionBy("user_id").orderBy("event_id")).alias("b")).where("event_id % 10 = 0")
    return align.contained(spans, e.select("user_id", "at"), ["user_id"], "a", "b", "at").select(F.col("event_id").alias("span_id"), "inside")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS created, count(*) FILTER (o_orderstatus = 'P') AS annotated, count(*) FILTER (o_orderstatus = 'F') AS converted FROM orders")
def status_dashboard(t):
    return metrics.status_counts(t("orders"), "o_orderstatus", {"created": "O", "annotated": "P", "converted": "F"})


@query("SELECT l_orderkey, sum(m)::BIGINT AS total, count(*) AS files FROM (SELECT l_orderkey, l_suppkey, max(l_quantity::BIGINT) AS m FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def max_then_sum_duration(t):
    rows = t("lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return metrics.furthest_then_sum(rows, "l_orderkey", "l_suppkey", "q").withColumnRenamed("parts", "files")


@query("""SELECT user_id, CASE WHEN sum(d) IS NOT NULL THEN (CASE WHEN sum(d) < 0 THEN -1 ELSE 1 END) * ((abs(sum(d))::HUGEINT + 5000000) // 10000000)::DOUBLE / 100 END AS seconds
FROM (SELECT user_id, NS(ts) - lag(NS(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) GROUP BY user_id""")
def duration_sum_decimal(t):
    spans = _events(t).select("user_id", F.lag("at").over(Window.partitionBy("user_id").orderBy("event_id")).alias("a"), F.col("at").alias("b"))
    return metrics.durations(spans, ["user_id"], "a", "b").withColumn("seconds", F.col("seconds").cast("double"))


@query("SELECT l_returnflag, count(*) AS episodes FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_returnflag")
def count_semi_join(t):
    done = metrics.of_status(t("orders"), "o_orderstatus", ("F",)).select(F.col("o_orderkey").alias("l_orderkey"))
    return metrics.counted(t("lineitem"), done, ["l_orderkey"], "l_returnflag")


@query("""WITH j AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey), m AS (SELECT o_custkey, l_partkey, max(l_quantity::BIGINT) AS m FROM j JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey, count(*) AS episodes, sum(m)::BIGINT AS total FROM m GROUP BY o_custkey""")
def latest_per_key_sum(t):
    outputs = t("lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return metrics.latest_job_sums(t("orders"), outputs, "o_custkey", "o_orderkey", "o_orderdate", "l_orderkey", "l_partkey", "q")


@query("""WITH d AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY ALL), j AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'P')
SELECT c_custkey, count(o_orderkey) AS jobs, coalesce(sum(n), 0)::BIGINT AS episodes, coalesce(sum(q), 0)::BIGINT AS duration FROM customer LEFT JOIN j ON o_custkey = c_custkey LEFT JOIN d ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def workforce_conversion(t):
    outputs = t("lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return metrics.per_creator(t("customer"), t("orders").where("o_orderstatus <> 'P'"), outputs, "c_custkey", "o_custkey", "o_orderkey", "l_orderkey", "q")


@query("""WITH u AS (SELECT o_custkey AS user_id, o_orderkey AS task, o_orderstatus = 'F' AS done FROM orders UNION ALL SELECT o_custkey % 97, o_orderkey, o_orderstatus <> 'O' FROM orders
 UNION ALL SELECT o_orderkey % 31, o_orderkey, o_orderstatus = 'P' FROM orders UNION ALL SELECT 7, o_orderkey, o_orderstatus = 'O' FROM orders), x AS (SELECT user_id, task, max(done::INT) AS done FROM u GROUP BY ALL)
SELECT user_id, count(*) AS tasks, sum(done)::BIGINT AS completed, ((sum(done) * 200 + count(*)) // (count(*) * 2))::BIGINT AS percent FROM x GROUP BY user_id""")
def completion_rate(t):
    one = lambda user, done: t("orders").select(user.cast("long").alias("user_id"), F.col("o_orderkey").alias("task"), F.expr(done).alias("done"))
    roles = [one(F.col("o_custkey"), "o_orderstatus = 'F'"), one(F.col("o_custkey") % 97, "o_orderstatus <> 'O'"), one(F.col("o_orderkey") % 31, "o_orderstatus = 'P'"), one(F.lit(7), "o_orderstatus = 'O'")]
    return metrics.completion(roles).withColumn("percent", metrics.percent(F.col("completed"), F.col("tasks")))


@query("""WITH r AS (SELECT user_id, bool_or(event_type = 'view') AS a, bool_or(event_type = 'purchase' AND value > 50) AS b, bool_or(event_type = 'error' AND value > 60) AS c, bool_or(event_type = 'signup' AND value > 90) AS d FROM events GROUP BY user_id)
SELECT count(*) AS people, count(*) FILTER (a OR d) AS collect, count(*) FILTER (b OR d) AS annotate, count(*) FILTER (c OR d) AS qc FROM r""")
def role_headcount(t):
    role = F.expr("CASE WHEN event_type = 'view' THEN 'collect' WHEN event_type = 'purchase' AND value > 50 THEN 'annotate' WHEN event_type = 'error' AND value > 60 THEN 'qc' WHEN event_type = 'signup' AND value > 90 THEN 'admin' END")
    people = t("events").groupBy("user_id").agg(F.collect_list(role).alias("roles"))
    return metrics.headcount(people, "roles", ["collect", "annotate", "qc"])


@query("SELECT o_orderpriority, count(*) AS total, count(DISTINCT o_custkey) AS people, ((count(*) * 200 + count(DISTINCT o_custkey)) // (count(DISTINCT o_custkey) * 2))::BIGINT AS hundredths FROM orders GROUP BY o_orderpriority")
def per_person_average(t):
    return metrics.per_person(t("orders"), "o_orderpriority", "o_custkey")


@query("SELECT (SELECT sum(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))::BIGINT AS people_total, (SELECT count(*) FROM orders) AS baseline, 0::BIGINT AS gap")
def column_total_vs_baseline(t):
    rows, base = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), t("orders").agg(F.count("*").alias("b"))
    return metrics.total_gap(rows, "n", base, "b").withColumnRenamed("total", "people_total")


@query("SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'with' ELSE 'without' END AS state FROM documents d")
def anti_semi(t):
    return reconcile.presence(t("documents"), t("labels"), ["doc_id"])


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 80), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value > 80)
SELECT 'only_click' AS side, user_id FROM a ANTI JOIN b USING (user_id) UNION ALL SELECT 'only_view', user_id FROM b ANTI JOIN a USING (user_id)""")
def set_difference(t):
    some = lambda kind: t("events").where((F.col("event_type") == kind) & (F.col("value") > 80))
    return reconcile.set_differences(some("click"), some("view"), "user_id", ("only_click", "only_view"))


_FRAME_ROWS = """WITH e AS (SELECT user_id AS file, event_id, event_type, NS(ts) AS at, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def _frames(t) -> DataFrame:
    """Annotated frames: a file for each user, a row for each event, with some faults."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = t("events").select("user_id", "event_id", "event_type", (F.row_number().over(order) - 1).cast("long").alias("k"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    item = lambda level, ident, name: F.struct(F.lit(level).alias("level"), F.lit(f"l{level}").alias("layer_id"), ident.alias("id"), name.alias("name"), F.lit("0").alias("start_timestamp_ns"), F.lit(10**15).alias("end_timestamp_ns"))
    task, leaf = F.concat(F.lit("u"), "user_id"), F.col("event_type")
    json = F.when(F.col("event_id") % 29 == 0, "oops").otherwise(F.to_json(F.array(item(1, task, F.lit("task")), item(2, leaf, leaf))))
    bad = lambda m: F.col("event_id") % m == 0
    return rows.select(
        F.col("user_id").alias("file"),
        F.col("k").alias("row"),
        F.col("event_id"),
        F.when(bad(17), F.col("k") * 10 - 25).otherwise(F.col("k") * 10).alias("original_timestamp_ns"),
        F.when(bad(19), F.col("k") + 1).otherwise(F.col("k")).alias("frame_index"),
        F.col("k").alias("index"),
        task.alias("episode_id"),
        F.lit(0).alias("episode_index"),
        F.when(bad(23), F.lit(None)).otherwise(F.col("k") == F.col("n") - 1).alias("done"),
        F.when(bad(31), -0.5).otherwise(F.col("k") / F.col("n")).alias("subtask_progress"),
        F.lit("task").alias("task"),
        leaf.alias("subtask"),
        leaf.alias("subtask_id"),
        task.alias("annotation.level_1_id"),
        F.lit("task").alias("annotation.level_1_name"),
        F.when(bad(37), "drop").otherwise(leaf).alias("annotation.leaf_id"),
        leaf.alias("annotation.leaf_name"),
        F.when(bad(41), F.concat(leaf, F.lit(">x"))).otherwise(F.concat(F.lit("task>"), leaf)).alias("annotation.path"),
        json.alias("annotation.hierarchy_json"),
        (F.col("k") / 30).alias("timestamp"),
    )


@query(f"""{_FRAME_ROWS}, g AS (SELECT *, k * 10 - CASE WHEN event_id % 17 = 0 THEN 25 ELSE 0 END AS o, CASE WHEN event_id % 31 = 0 THEN -0.5 ELSE k / n END AS p FROM e),
 w AS (SELECT *, lag(o) OVER (PARTITION BY file ORDER BY k) AS prior, lag(p) OVER (PARTITION BY file, event_type ORDER BY k) AS before, event_id % 29 <> 0 AS ok FROM g), v AS (
SELECT 'increasing' AS "check", file, k FROM w WHERE o <= prior UNION ALL SELECT 'frame_index', file, k FROM w WHERE event_id % 19 = 0 UNION ALL SELECT 'done', file, k FROM w WHERE event_id % 23 = 0
UNION ALL SELECT 'progress', file, k FROM w WHERE p < 0 OR p < before UNION ALL SELECT 'hierarchy', file, k FROM w WHERE NOT ok UNION ALL SELECT 'containment', file, k FROM w WHERE ok AND o < 0
UNION ALL SELECT 'annotation.leaf_id', file, k FROM w WHERE ok AND event_id % 37 = 0 UNION ALL SELECT 'path', file, k FROM w WHERE ok AND event_id % 41 = 0)
SELECT "check", file::VARCHAR AS entity, k AS row_index FROM v""")
def annotation_audit(t):
    return checks.annotation_audit(_frames(t), "file", "row", (1,)).select("check", "entity", "row_index")


@query(f"{_FRAME_ROWS} SELECT file, 'u' || file AS episode_id, 0::BIGINT AS episode_index, max(CASE WHEN event_id % 29 <> 0 THEN 'u' || file END) AS l1_id, max(CASE WHEN event_id % 29 <> 0 THEN 0 END)::BIGINT AS l1_start_ns, CASE WHEN bool_and(event_id % 29 = 0) THEN 'no level 1' END AS problem FROM e GROUP BY file")
def episode_index(t):
    return checks.episode_index(_frames(t), "file").select("file", "episode_id", "episode_index", "l1_id", "l1_start_ns", "problem")


@query(f"""{_FRAME_ROWS}, s AS (SELECT file, event_type AS id, min(k) AS a, max(k) AS b FROM e WHERE event_id % 29 <> 0 GROUP BY ALL UNION ALL SELECT file, 'u' || file, min(k), max(k) FROM e WHERE event_id % 29 <> 0 GROUP BY ALL)
SELECT file::VARCHAR AS task, CASE WHEN id = 'u' || file THEN 1 ELSE 2 END::INTEGER AS level, id AS expected_id, 'id' AS matched, CASE WHEN file % 5 = 0 AND id = 'u' || file THEN 'end_ns' ELSE '' END AS differences,
 CASE WHEN id = 'u' || file THEN file % 5 <> 0 AND abs(a / 30 - b / 30) + 0.0 >= 0 AND abs((b - a) / 30 - 1000000.0) <= 0.07 END AS consistent FROM s""")
def annotation_reconcile(t):
    found = checks.annotation_summary(_frames(t).where("event_id % 29 <> 0"), "file", "row")
    order = Window.partitionBy("file").orderBy("level", "id")
    actual = found.select(F.col("file").cast("string").alias("task"), "level", (F.row_number().over(order) - 1).alias("ord"), "layer_id", "id", "name", "start_ns", "end_ns", "first_playback", "last_playback")
    late = (F.col("task").cast("long") % 5 == 0) & (F.col("level") == 1)
    wanted = actual.withColumn("end_ns", F.when(late, F.col("end_ns") + 1).otherwise(F.col("end_ns")))
    matches = reconcile.match_annotations(wanted, actual, "task")
    played = reconcile.playback_durations(matches, wanted, actual, "task").select("task", "expected_ord", "consistent")
    return matches.join(played, ["task", "expected_ord"], "left").select("task", "level", "expected_id", "matched", "differences", "consistent")


_EPISODES = f"""WITH e AS (SELECT user_id, NS(ts) AS t FROM events WHERE event_type <> 'error'), i AS (SELECT user_id, min(NS(ts)) AS start_ns, max(NS(ts)) AS end_ns FROM events GROUP BY user_id),
 b AS (SELECT i.*, min(t) AS t0_ns, max(t) AS last_main_ns FROM i LEFT JOIN e ON e.user_id = i.user_id AND t BETWEEN start_ns AND end_ns GROUP BY ALL)"""


def _bounds(t) -> tuple[DataFrame, DataFrame]:
    e = _events(t)
    main = e.where("event_type <> 'error'").select("user_id", F.col("at").alias("log_ns"), F.col("event_id").alias("seq"))
    return main, e.groupBy("user_id").agg(F.min("at").alias("start_ns"), F.max("at").alias("end_ns"))


@query(f"{_EPISODES} SELECT user_id, start_ns, end_ns, t0_ns, last_main_ns FROM b")
def main_frame_bounds(t):
    main, episodes = _bounds(t)
    return align.main_frame_bounds(episodes, main, ["user_id"], "start_ns", "end_ns", "log_ns", "seq")


@query(f"""{_EPISODES}, k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
 r AS (SELECT k.user_id, k.event_id, n, t0_ns, n / 30.0::DOUBLE + CASE WHEN event_id % 23 = 0 THEN 0.001 ELSE 0 END AS s, t0_ns + round_even(n * 1e9 / 30, 0)::BIGINT + CASE WHEN event_id % 17 = 0 THEN 5000 ELSE 0 END AS o, n + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS f FROM k JOIN b USING (user_id)), c AS (SELECT user_id, count(*) AS n FROM k GROUP BY ALL), v AS (
SELECT 'first_origin' AS "check", user_id, event_id FROM r WHERE n = 0 AND event_id % 17 = 0 UNION ALL SELECT 'first_seconds', user_id, event_id FROM r WHERE n = 0 AND event_id % 23 = 0 UNION ALL SELECT 'frame_index', user_id, event_id FROM r WHERE event_id % 19 = 0
UNION ALL SELECT 'grid_seconds', user_id, event_id FROM r WHERE event_id % 23 = 0 UNION ALL SELECT 'grid_origin', user_id, event_id FROM r WHERE event_id % 17 = 0
UNION ALL SELECT 'main_camera', user_id, NULL FROM b WHERE t0_ns IS NULL UNION ALL SELECT 'frame_count', user_id, NULL FROM b JOIN c USING (user_id) WHERE t0_ns IS NOT NULL AND (least(end_ns, last_main_ns) - t0_ns) * 30 // 1000000000 + 1 <> n)
SELECT "check", user_id::VARCHAR AS entity, event_id AS row_index FROM v""")
def fixed_fps_audit(t):
    main, episodes = _bounds(t)
    t0 = main.join(episodes, "user_id").where("log_ns between start_ns and end_ns").groupBy("user_id").agg(F.min("log_ns").alias("t0"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    fault = lambda m, v: F.when(F.col("event_id") % m == 0, v).otherwise(0)
    frames = t("events").select("user_id", "event_id", n.alias("n")).join(t0, "user_id", "left")
    frames = frames.select("user_id", "event_id", (F.col("n") / F.lit(30.0) + fault(23, 0.001)).alias("timestamp"), (F.col("t0") + F.bround(F.col("n") * 1e9 / 30).cast("long") + fault(17, 5000)).alias("original_timestamp_ns"), (F.col("n") + fault(19, 1)).alias("frame_index"))
    found = checks.fixed_fps_audit(frames, main, episodes, ["user_id"], "event_id")
    return found.where("check <> 'required'").select("check", "entity", "row_index")


ROBOT = [
    {"section": s, "position": 2 * i + k, "name": f"{s}-{g}-{kind}", "grp": g, "topic": f"/{kind}/{2 * i + j}", "fields": vectors.POSITION + vectors.ORIENTATION if kind == "pose" else ["data[0]"], "parser": "pose7d" if kind == "pose" else "gripper", "sync_policy": "5", "tolerance_ns": 5_000_000, "main_time_topic": "/main"}
    for i, s in enumerate(("action", "observation_state"))
    for j, g in enumerate(("left", "right"))
    for k, kind in enumerate(("pose", "hand"))
]


def _messages(t) -> DataFrame:
    """Messages of nine topics: each vector is one, 10 ms after the other."""
    rows = t("embeddings").select(F.col("vec_id").alias("seq"), (F.col("vec_id") * 10_000_000).alias("log_ns"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    kind, x = F.col("seq") % 9, lambda i: F.get("x", F.lit(i))
    point = lambda at, names: F.struct(*(x(at + i).alias(n) for i, n in enumerate(names)))
    body = F.when(kind < 4, F.to_json(F.struct(F.struct(point(0, "xyz").alias("position"), point(3, "xyzw").alias("orientation")).alias("pose")))).otherwise(F.to_json(F.struct(F.array(x(7)).alias("data"))))
    topic = F.when(kind == 8, "/main").when(kind < 4, F.concat(F.lit("/pose/"), kind.cast("string"))).otherwise(F.concat(F.lit("/hand/"), (kind - 4).cast("string")))
    return rows.select(F.lit("r").alias("recording"), "seq", "log_ns", topic.alias("topic"), F.parse_json(body).alias("body"))


def _times(t) -> DataFrame:
    return t("embeddings").where("vec_id % 50 = 25").select(F.lit("r").alias("recording"), F.col("vec_id").alias("target"), (F.col("vec_id") * 10_000_000 + 3_000_000).alias("at"))


_VECTORS = """WITH m AS (SELECT vec_id, vec_id * 10000000 AS t, vec_id % 9 AS k, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS x FROM embeddings), g AS (SELECT vec_id AS target, t + 3000000 AS due FROM m WHERE vec_id % 50 = 25),
 a AS (SELECT target, arg_min(t, (abs(t - due), t)) AS due FROM g, m WHERE k = 8 GROUP BY target), s AS (SELECT a.*, k FROM a, range(8) r(k)),
 b AS (SELECT s.*, max(CASE WHEN t <= due THEN t END) AS tb, min(CASE WHEN t >= due THEN t END) AS ta FROM s JOIN m USING (k) GROUP BY ALL),
 c AS (SELECT b.*, CASE WHEN least(due - tb, ta - due) <= 5000000 THEN 'nearest' WHEN tb IS NULL THEN 'clamp_first' WHEN ta IS NULL THEN 'clamp_last' WHEN tb = ta THEN 'single_value' ELSE 'interpolated' END AS strategy, (due - tb)::DOUBLE / (ta - tb) AS r FROM b),
 d AS (SELECT c.*, CASE WHEN strategy = 'interpolated' THEN p.x WHEN c.ta IS NULL OR due - tb <= ta - due THEN p.x ELSE q.x END AS x, CASE WHEN strategy = 'interpolated' THEN q.x END AS y FROM c LEFT JOIN m p ON p.t = tb LEFT JOIN m q ON q.t = ta),
 n AS (SELECT *, list_transform(x[4:7], lambda v: v / sqrt(list_inner_product(x[4:7], x[4:7]))) AS p, list_transform(y[4:7], lambda v: v / sqrt(list_inner_product(y[4:7], y[4:7]))) AS q FROM d),
 o AS (SELECT *, CASE WHEN list_inner_product(p, q) < 0 THEN -1.0 ELSE 1.0 END AS sg, least(abs(list_inner_product(p, q)), 1.0) AS co, acos(least(abs(list_inner_product(p, q)), 1.0)) AS th FROM n),
 w AS (SELECT *, CASE WHEN y IS NULL THEN p WHEN co > 0.9995 THEN list_transform([1, 2, 3, 4], lambda i: p[i] + (q[i] * sg - p[i]) * r) ELSE list_transform([1, 2, 3, 4], lambda i: (p[i] * sin((1 - r) * th) + q[i] * sg * sin(r * th)) / sin(th)) END AS u FROM o),
 z AS (SELECT *, list_transform(u, lambda v: v / sqrt(list_inner_product(u, u))) AS e, CASE WHEN y IS NULL THEN x ELSE list_transform(x, lambda v, i: v + (y[i] - v) * r) END AS f FROM w),
 l AS (SELECT target, due, k, strategy, unnest([{'label': 'x', 'v': f[1]}, {'label': 'y', 'v': f[2]}, {'label': 'z', 'v': f[3]}, {'label': 'roll', 'v': atan2(2 * (e[4] * e[1] + e[2] * e[3]), 1 - 2 * (e[1] * e[1] + e[2] * e[2]))},
  {'label': 'pitch', 'v': asin(greatest(least(2 * (e[4] * e[2] - e[3] * e[1]), 1.0), -1.0))}, {'label': 'yaw', 'v': atan2(2 * (e[4] * e[3] + e[1] * e[2]), 1 - 2 * (e[2] * e[2] + e[3] * e[3]))}]) AS s FROM z WHERE k < 4
  UNION ALL SELECT target, due, k, strategy, {'label': 'angle', 'v': f[8]} FROM z WHERE k >= 4)"""


@query(f"{_VECTORS} SELECT target, due AS sampled_ns, CASE WHEN k % 4 < 2 THEN 'action' ELSE 'observation_state' END AS section, CASE WHEN k % 2 = 0 THEN 'left' ELSE 'right' END AS grp, s.label AS label, round(s.v, 5) + 0.0 AS value, strategy FROM l")
def robot_vectors_at_time(t):
    out = vectors.message_vectors_at(_messages(t), _times(t), ROBOT, ["recording"], "target", "at")
    return out.withColumn("value", F.round("value", 5) + 0.0)


@query("""WITH m AS (SELECT vec_id, vec_id * 10000000 AS t, vec_id % 9 AS k, embedding FROM embeddings), g AS (SELECT vec_id AS target, t + 3000000 AS due FROM m WHERE vec_id % 50 = 25),
 n AS (SELECT target, k, arg_min(vec_id, (abs(t - due), t)) AS vec_id FROM g, m WHERE k < 4 GROUP BY ALL), f AS (SELECT unnest(['position.x', 'position.y', 'position.z', 'orientation.x', 'orientation.y', 'orientation.z', 'orientation.w']) AS field, unnest(range(1, 8)) AS i)
SELECT target, CASE WHEN n.k < 2 THEN 'action' ELSE 'observation_state' END AS section, '/pose/' || n.k AS topic, t AS matched_ns, 'pose.' || field AS field, round(embedding[i]::DOUBLE, 6) AS value FROM n JOIN m USING (vec_id), f""")
def configured_fields_at_time(t):
    out = vectors.message_fields_at(_messages(t), _times(t), ROBOT, ["recording"], "target", "at")
    return out.withColumn("value", F.round("value", 6))


def _vector_frames(t) -> DataFrame:
    """Frames whose vectors are the first 28 values, with fields in an order of their own."""
    names = [f"{g}_arm.{x}" if x != "angle" else f"{g}_gripper.data[0]" for g in ("right", "left") for x in reversed(vectors.LABELS)]
    part = lambda at: F.slice("embedding", at, 14)
    shown = lambda at: F.struct(*(F.get(part(at), F.lit(i)).alias(n) for i, n in enumerate(names)))
    return t("embeddings").select(F.lit("r").alias("recording"), F.col("vec_id").alias("row"), (F.col("vec_id") * 33_333_333).alias("ts"), part(1).alias("actions"), shown(1).alias("ac_display"), part(15).alias("state"), shown(15).alias("st_display"))


@query("""WITH m AS (SELECT vec_id, vec_id * 33333333 AS t, embedding FROM embeddings), g AS (SELECT vec_id AS target, vec_id * 10000000 + 3000000 AS due FROM embeddings WHERE vec_id % 50 = 25), n AS (SELECT target, arg_min(vec_id, (abs(t - due), t)) AS vec_id FROM g, m GROUP BY target)
SELECT target, t AS matched_ns, CASE WHEN i < 14 THEN 'action' ELSE 'observation_state' END AS section, CASE WHEN i // 7 % 2 = 0 THEN 'right' ELSE 'left' END AS grp, ['angle', 'yaw', 'pitch', 'roll', 'z', 'y', 'x'][i % 7 + 1] AS label, round(embedding[i + 1]::DOUBLE, 6) AS value FROM n JOIN m USING (vec_id), range(28) r(i)""")
def frame_vectors_at_time(t):
    out = vectors.frame_vectors_at(_vector_frames(t), _times(t), ["recording"], "target", "at", "ts", "row")
    return out.withColumn("value", F.round("value", 6))


@query("SELECT target, count(*) AS labels, count(*) FILTER (w IS NULL) AS unmatched FROM (SELECT vec_id AS target, unnest(range(28)) AS i, 1 AS w FROM embeddings WHERE vec_id % 50 = 25) GROUP BY target")
def vector_audit(t):
    out = vectors.vector_audit(_vector_frames(t), _messages(t), _times(t), ROBOT, ["recording"], "target", "at", "ts", "row")
    return out.groupBy("target").agg(F.count("*").alias("labels"), F.count_if(F.col("within").isNull()).alias("unmatched"))


@query("""WITH e AS (SELECT conv_id, turn, role FROM conversations), x AS (SELECT conv_id, 'episode' AS category, 'auto:j' || conv_id || ':episode:0' AS id, 'l1' AS layer_id, 'all' AS description, 5000000000::BIGINT AS start_ns, 5000000000 + (max(turn) + 1) * 500000000 AS end_ns FROM e GROUP BY conv_id
 UNION ALL SELECT conv_id, 'sub_task', 's' || conv_id || '-' || turn, 'l2', role, 5000000000 + turn * 500000000, 5000000000 + turn * 500000000 + 500000000 FROM e)
SELECT conv_id, category, id, layer_id, description, start_ns::BIGINT AS start_ns, end_ns::BIGINT AS end_ns, (start_ns - 5000000000)::BIGINT AS relative_start_ns, NULL::VARCHAR AS problem FROM x""")
def auto_label_segments(t):
    sub = F.struct(F.concat_ws("-", F.concat(F.lit("s"), "conv_id"), "turn").alias("segmentId"), F.col("role").alias("prompt"), (F.col("turn") * 0.5).alias("startSec"), (F.col("turn") * 0.5 + 0.5).alias("endSec"))
    rows = t("conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.collect_list(sub).alias("sub_tasks"))
    episode = F.struct(F.struct(F.lit("all").alias("label"), F.lit(0).alias("startSec"), ((F.col("last") + 1) * 0.5).alias("endSec")).alias("segment"), F.when(F.col("conv_id") % 2 == 0, F.col("sub_tasks")).alias("sub_tasks"))
    whole = F.struct(F.array(episode).alias("episodes_annotation"), F.when(F.col("conv_id") % 2 == 1, F.col("sub_tasks")).alias("sub_tasks_annotation"))
    results = rows.select("conv_id", F.concat(F.lit("j"), "conv_id").alias("job"), F.parse_json(F.to_json(whole)).alias("result"), F.lit(5_000_000_000).alias("base"))
    return flatten.auto_segments(results, "conv_id", "result", "job", "base").select("conv_id", "category", "id", "layer_id", "description", "start_ns", "end_ns", "relative_start_ns", "problem")


@query("""WITH m AS (SELECT vec_id, vec_id * 10000000 AS t, embedding FROM embeddings WHERE vec_id % 3 = 0), g AS (SELECT vec_id AS target, vec_id * 10000000 + 3000000 AS due FROM embeddings WHERE vec_id % 50 = 25), n AS (SELECT target, arg_min(vec_id, (abs(t - due), t)) AS vec_id FROM g, m GROUP BY target)
SELECT target, pair, true AS same_row, 1.0::DOUBLE AS matched_ratio, true AS consistent FROM n, (VALUES ('raw_video'), ('raw_cell'), ('cell_video')) p(pair)""")
def image_audit_three_way(t):
    byte = lambda v: F.least(F.greatest(F.floor((v.cast("double") + 0.6) * 200), F.lit(0)), F.lit(255)).cast("int")
    data = F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(byte(v)), 2, "0")), ""))
    rows = t("embeddings").where("vec_id % 3 = 0").select(F.lit("r").alias("recording"), F.col("vec_id").alias("seq"), (F.col("vec_id") * 10_000_000).alias("log_ns"), F.lit("cam").alias("topic"), F.lit("raw").alias("schema_name"), data.alias("data"))
    cells = rows.select("recording", F.col("seq").alias("row"), F.col("log_ns").alias("ts"), F.struct(F.col("data").alias("bytes"), F.lit("p").alias("path")).alias("cam"))
    image = F.struct(F.col("data"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit("mono8").alias("encoding"))
    raw = image_audit.message_images_at(rows, _times(t), ["cam"], ["recording"], "target", "at").select("target", F.col("topic").alias("camera"), F.col("seq").alias("row"), image.alias("image"))
    own = image_audit.frame_images_at(cells, _times(t), ["cam"], ["recording"], "target", "at", "ts", "row").select("target", "camera", "row", image.alias("image"))
    return image_audit.three_way(raw, own, own, "target", "camera").select("target", "pair", "same_row", "matched_ratio", "consistent")
