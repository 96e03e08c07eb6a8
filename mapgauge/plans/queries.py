"""The reference's operators as queries over the driver's tables. Each key has its SQL beside it, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapgauge.functions import geo, text
from mapgauge.operators import coords, coverage, metrics, pairs, relational, sampling, stats
from mapgauge.operators.durable import scratch
from mapgauge.plans import reports
from mapgauge.sources import connectors, readers, sinks

#: White space at the ends of answers, as a literal of SQL.
_WS = "'" + text.SPACE + "'"
QUERIES: dict = {}
SQL: dict[str, str] = {}
EVENTS = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def lat(k):
    return ((F.col(k) * 37) % 180 - 90 + F.lit(0.5)).cast("double")


def lon(k):
    return ((F.col(k) * 91) % 360 - 180 + F.lit(0.5)).cast("double")


def predictions(spark, sf) -> DataFrame:
    """Events as answers: truth, a prediction that is wrong for every seventh, and a temperature."""
    nxt = F.col("event_type")
    for a, b in zip(EVENTS, (*EVENTS[1:], EVENTS[0]), strict=True):
        nxt = F.when(F.col("event_type") == a, b).otherwise(nxt)
    t = F.when(F.col("event_id") % 3 == 0, 0.25).when(F.col("event_id") % 3 == 1, 0.5).otherwise(1.0)
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", "value", F.col("event_type").alias("truth"), F.when(F.col("event_id") % 7 == 0, nxt).otherwise(F.col("event_type")).alias("predicted"), t.alias("temperature"))


PRED = """pred AS (
  SELECT event_id, user_id, value, event_type AS truth,
         CASE WHEN event_id % 7 = 0 THEN CASE event_type WHEN 'click' THEN 'error' WHEN 'error' THEN 'purchase'
              WHEN 'purchase' THEN 'signup' WHEN 'signup' THEN 'view' ELSE 'click' END ELSE event_type END AS predicted,
         (CASE event_id % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 ELSE 1.0 END)::DOUBLE AS temperature
  FROM events)"""


def hav_sql(r: str, lat1: str, lon1: str, lat2: str, lon2: str, form: str = "atan2") -> str:
    a = f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"{r} * 2 * atan2(sqrt({a}), sqrt(greatest(0.0, 1 - {a})))" if form == "atan2" else f"{r} * 2 * asin(sqrt(least(1.0, {a})))"


LAT, LON = "(({k} * 37) % 180 - 90 + 0.5)::DOUBLE", "(({k} * 91) % 360 - 180 + 0.5)::DOUBLE"

# --- coordinates ----------------------------------------------------------------------------------------------


def _parsed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2).cast("string").alias("p_type"), text.latlon("text").alias("p"))
    return d.select("doc_id", "p_type", "p.lat", "p.lon", lat("doc_id").alias("tlat"), lon("doc_id").alias("tlon"))


NUM = r"-?[0-9]+\.[0-9]+"
PARSED = rf"""parsed AS (
  SELECT doc_id, (doc_id % 2)::VARCHAR AS p_type, CASE WHEN ok THEN a ELSE TRY_CAST(x AS DOUBLE) END AS lat,
         CASE WHEN ok THEN b ELSE TRY_CAST(y AS DOUBLE) END AS lon,
         {LAT.format(k="doc_id")} AS tlat, {LON.format(k="doc_id")} AS tlon
  FROM (SELECT *, coalesce(a BETWEEN -90 AND 90 AND b BETWEEN -180 AND 180, false) AS ok FROM (
    SELECT doc_id, TRY_CAST(nums[1] AS DOUBLE) AS a, TRY_CAST(nums[2] AS DOUBLE) AS b,
           regexp_extract(low, 'lat(?:itude)?[:=\s]+({NUM}).{{0,40}}lon(?:gitude)?[:=\s]+({NUM})', 1) AS x,
           regexp_extract(low, 'lat(?:itude)?[:=\s]+({NUM}).{{0,40}}lon(?:gitude)?[:=\s]+({NUM})', 2) AS y
    FROM (SELECT doc_id, regexp_extract_all(text, '({NUM})', 1) AS nums, lower(replace(text, chr(10), ' ')) AS low FROM documents))))"""


@query(f"""WITH {PARSED}, e AS (SELECT p_type, {hav_sql("6371.0088", "lat", "lon", "tlat", "tlon")} AS e FROM parsed)
SELECT CASE WHEN grouping(p_type) = 1 THEN 'all' ELSE p_type END AS p_type, count(*) AS total, count(e) AS parsed,
       round(avg(e), 6) AS mean_error, round(median(e), 6) AS median_error, round(sqrt(avg(e * e)), 6) AS rmse,
       {", ".join(f"count(*) FILTER (WHERE e <= {k}) AS within_{k}" for k in (1, 5, 10, 50, 100))},
       round(coalesce(count(e)::DOUBLE / nullif(count(*), 0), 0), 6) AS parse_rate,
       {", ".join(f"round(coalesce((count(*) FILTER (WHERE e <= {k}))::DOUBLE / nullif(count(e), 0), 0), 6) AS rate_{k}" for k in (1, 5, 10, 50, 100))}
FROM e GROUP BY ROLLUP (p_type)""")
def coord_error_summary(spark, sf):
    e = _parsed(spark, sf).withColumn("e", geo.haversine_km("lat", "lon", "tlat", "tlon"))
    out = metrics.error_summary(e, "p_type", "e")
    return rounded(out, "mean_error", "median_error", "rmse", "parse_rate", *[f"rate_{k}" for k in metrics.KM])


@query(f"WITH {PARSED} SELECT doc_id, lat, lon FROM parsed WHERE lat IS NULL OR NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)")
def parse_failures(spark, sf):
    """F7, F14."""
    return _parsed(spark, sf).where("lat is null or not (lat between -90 and 90 and lon between -180 and 180)").select("doc_id", "lat", "lon")


@query(f"""WITH e AS (SELECT n_name, {hav_sql("6371000.0", LAT.format(k="s_suppkey"), LON.format(k="s_suppkey"), LAT.format(k="s_nationkey"), LON.format(k="s_nationkey"), "asin")} AS e
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT n_name, count(*) AS n, round(avg(abs(e)), 4) AS mae_m, round(sqrt(avg(e * e)), 4) AS rmse_m,
       {", ".join(f"round(count(*) FILTER (WHERE e <= {k}) * 100.0::DOUBLE / count(*), 6) AS pct_{k}m" for k in (5, 10, 50, 100))}
FROM e GROUP BY n_name""")
def coord_error_meters(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    e = s.withColumn("e", geo.haversine_m(lat("s_suppkey"), lon("s_suppkey"), lat("s_nationkey"), lon("s_nationkey")))
    out = metrics.meters_summary(e, "e", "n_name")
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("mae_m", "rmse_m")}), *[f"pct_{k}m" for k in metrics.METERS])


# --- directions and classes -----------------------------------------------------------------------------------

VARIANT = ("NorthEast", "north east.", " South-West,", "southwest", "North", "west.", "up", "SOUTH EAST", "north\n", "\tsouth west.\r\n", "\u00a0East,\u2003")


@query(f"""WITH t AS (SELECT event_id, [{", ".join(f"'{v}'" for v in VARIANT)}][event_id % {len(VARIANT)} + 1] AS answer FROM events),
v1 AS (SELECT *, replace(replace(replace(replace(trim(lower(replace(replace(trim(answer, {_WS}), '.', ''), ',', '')), {_WS}), 'northeast', 'north-east'), 'northwest', 'north-west'), 'southeast', 'south-east'), 'southwest', 'south-west') AS d1,
  trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(trim(lower(coalesce(answer, '')), {_WS}), 'northeast', 'north-east'), 'north east', 'north-east'), 'northwest', 'north-west'), 'north west', 'north-west'), 'southeast', 'south-east'), 'south east', 'south-east'), 'southwest', 'south-west'), 'south west', 'south-west'), '.', ''), ',', ''), {_WS}) AS d2 FROM t)
SELECT d1, d2, d2 IN ('north','south','east','west','north-east','north-west','south-east','south-west') AS valid, count(*) AS n FROM v1 GROUP BY d1, d2""")
def direction_normalize(spark, sf):
    a = F.get(F.array(*[F.lit(v) for v in VARIANT]), (F.col("event_id") % len(VARIANT)).cast("int"))
    e = table(spark, sf, "events").select(a.alias("answer"))
    e = e.select(text.direction_v1("answer", True).alias("d1"), text.direction("answer").alias("d2"))
    return e.withColumn("valid", text.is_direction("d2")).groupBy("d1", "d2", "valid").agg(F.count(F.lit(1)).alias("n"))


CLASSES = """cls AS (
  SELECT {g} label, sum(t)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS tp FROM (
    SELECT {g} truth AS label, 1 AS t, 0 AS p, (truth = predicted)::INT AS h FROM pred
    UNION ALL SELECT {g} predicted, 0, 1, 0 FROM pred) GROUP BY {g} label),
prf AS (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall FROM cls),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM prf)"""


@query(f"""WITH {PRED}, {CLASSES.format(g="temperature,")}
SELECT temperature, sum(support)::BIGINT AS n, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
       {", ".join(f"round(sum({c} * support) / sum(support), 6) AS weighted_{c}" for c in ("precision", "recall", "f1"))},
       {", ".join(f"round(avg({c}), 6) AS macro_{c}" for c in ("precision", "recall", "f1"))}
FROM f GROUP BY temperature""")
def direction_metrics_by_temp(spark, sf):
    p = predictions(spark, sf).where(F.col("truth").isin(*EVENTS) & F.col("predicted").isin(*EVENTS))
    out = metrics.weighted(metrics.per_class(metrics.counts(p, "truth", "predicted", "temperature"), "temperature"), "temperature")
    return rounded(out, *[c for c in out.columns if c not in ("temperature", "n")])


@query(f"""WITH {PRED}, a AS (SELECT temperature, avg((truth = predicted)::INT) AS acc FROM pred GROUP BY temperature)
SELECT temperature AS best_temperature, round(acc, 6) AS best_acc FROM a ORDER BY acc DESC, temperature LIMIT 1""")
def best_temperature(spark, sf):
    a = predictions(spark, sf).groupBy("temperature").agg(metrics.accuracy("truth", "predicted").alias("acc"))
    return rounded(metrics.best(a, "acc", "temperature"), "best_acc")


@query(f"""WITH {PRED}, {CLASSES.format(g="")}
SELECT label, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f""")
def per_class_report(spark, sf):
    out = metrics.per_class(metrics.counts(predictions(spark, sf), "truth", "predicted"), null_label="__NONE__")
    return rounded(out, "precision", "recall", "f1")


@query(f"""WITH {PRED}, l AS (SELECT unnest(['click','error','purchase','signup','view','other']) AS label)
SELECT l.label, count(truth) AS support, coalesce(sum((truth = predicted)::INT), 0)::BIGINT AS correct,
       round(coalesce(sum((truth = predicted)::INT)::DOUBLE / nullif(count(truth), 0), 0), 6) AS accuracy
FROM l LEFT JOIN pred ON truth = l.label GROUP BY l.label""")
def class_support_accuracy(spark, sf):
    out = metrics.support_accuracy(metrics.counts(predictions(spark, sf), "truth", "predicted"), (*EVENTS, "other"))
    return rounded(out, "accuracy")


@query(f"""WITH {PRED}, l AS (SELECT unnest(['click','error','purchase','signup','view']) AS label)
SELECT a.label AS truth, b.label AS predicted, count(p.event_id) AS n
FROM l a CROSS JOIN l b LEFT JOIN pred p ON p.truth = a.label AND p.predicted = b.label GROUP BY 1, 2""")
def confusion_matrix(spark, sf):
    return metrics.confusion(metrics.counts(predictions(spark, sf), "truth", "predicted"), EVENTS)


@query("""SELECT quality::VARCHAR AS truth, count(*) FILTER (WHERE toxic = 0) AS "0", count(*) FILTER (WHERE toxic = 1) AS "1" FROM labels GROUP BY 1""")
def confusion_wide(spark, sf):
    d = table(spark, sf, "labels").select(F.col("quality").cast("string").alias("q"), F.col("toxic").cast("string").alias("t"))
    return metrics.confusion_wide(metrics.counts(d, "q", "t"), ("0", "1"))


ANSWER = r"""trim(regexp_replace(rtrim(lower(trim({c}, {w})), '.,;:!?'), '^(the|a|an) ', ''), {w})"""
#: Ends that answers come with, by turn.
ENDS = ("", ".\n", "\t", " !\r\n", "\u3000")


@query(f"""WITH t AS (SELECT conv_id, turn, role, text || [{", ".join(f"'{v}'" for v in ENDS)}][turn % {len(ENDS)} + 1] AS text FROM conversations),
c AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM t),
a AS (SELECT role, {ANSWER.format(c="text", w=_WS)} AS x, {ANSWER.format(c="nxt", w=_WS)} AS y FROM c)
SELECT role, count(*) AS total, count(*) FILTER (WHERE x = y) AS correct, count(*) FILTER (WHERE y IS NULL) AS errors,
       round(sum(length(x))::DOUBLE / count(*), 6) AS mean_length, round((count(*) FILTER (WHERE x = y))::DOUBLE / count(*), 6) AS accuracy
FROM a GROUP BY role""")
def answer_normalize_accuracy(spark, sf):
    end = F.get(F.array(*[F.lit(v) for v in ENDS]), (F.col("turn") % len(ENDS)).cast("int"))
    c = table(spark, sf, "conversations").withColumn("text", F.concat("text", end))
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    a = c.withColumn("nxt", nxt).select("role", text.short_answer("text").alias("x"), text.short_answer("nxt").alias("y"))
    return a.groupBy("role").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("x") == F.col("y")).alias("correct"), F.count_if(F.col("y").isNull()).alias("errors"),
        r6(F.sum(F.char_length("x")) / F.count(F.lit(1)), "mean_length"), r6(F.count_if(F.col("x") == F.col("y")) / F.count(F.lit(1)), "accuracy"),
    )


@query(f"""WITH {PRED}, g AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'global' ELSE 'local' END AS map_type, sum((truth = predicted)::INT)::BIGINT AS correct, count(*) AS total FROM pred GROUP BY 1)
SELECT map_type, correct, total, round(correct::DOUBLE / total, 6) AS accuracy,
       round(correct::DOUBLE / total - (SELECT sum(correct)::DOUBLE / sum(total) FROM g), 6) AS versus_pooled FROM g""")
def pooled_accuracy(spark, sf):
    """A24."""
    p = predictions(spark, sf).withColumn("map_type", F.when(F.col("user_id") % 2 == 0, "global").otherwise("local"))
    g = p.groupBy("map_type").agg(F.sum((F.col("truth") == F.col("predicted")).cast("int")).alias("correct"), F.count(F.lit(1)).alias("total"))
    all_ = g.agg((F.sum("correct") / F.sum("total")).alias("_pooled"))
    g = g.crossJoin(F.broadcast(all_)).withColumn("accuracy", F.col("correct") / F.col("total"))
    return g.select("map_type", "correct", "total", r6("accuracy", "accuracy"), r6(F.col("accuracy") - F.col("_pooled"), "versus_pooled"))


# --- predicates -----------------------------------------------------------------------------------------------

REPLIES = (
    "I think so. Answer: A [overlaps/is within] B", "answer: x [foo] y", "Answer: A [is within/contains] B. Answer: C [touches] D", "the town borders the lake",
    "disjoint", "equals", "[has/straddles]", "It lies inside the park", "nothing to say", "[partly / EQUALS]", "they are separated", "Answer: none",
    "[ within\n]", "Answer: A [\ttouches\n] B", "\nequals\n", "[x/ overlaps\u00a0]",
)


def _replies(spark, sf):
    a = F.get(F.array(*[F.lit(v) for v in REPLIES]), ((F.col("conv_id") + F.col("turn")) % len(REPLIES)).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", a.alias("reply"))


_Q = lambda v: "'" + v + "'"
REPLY = f"r AS (SELECT conv_id, turn, [{', '.join(map(_Q, REPLIES))}][(conv_id + turn) % {len(REPLIES)} + 1] AS reply FROM conversations)"


def _valid_sql(section: str) -> str:
    names = ", ".join(f"'{p}'" for p in text.PREDICATES)
    bracket = f"string_split(string_split({section}, '[')[2], ']')[1]"
    parts = f"list_transform(string_split({bracket}, '/'), lambda p: CASE WHEN contains(p, 'is within') THEN 'within' ELSE trim(p, {_WS}) END)"
    found = f"CASE WHEN contains(c, 'answer:') AND contains({section}, '[') AND contains({section}, ']') THEN list_filter({parts}, lambda p: p IN ({names}))[1] END"
    return f"coalesce({found}, {', '.join(f"CASE WHEN contains(c, '{p}') THEN '{p}' END" for p in text.PREDICATES)}, 'invalid')"


@query(f"""WITH {REPLY}, l AS (SELECT lower(trim(reply, {_WS})) AS c FROM r)
SELECT {_valid_sql("string_split(c, 'answer:')[2]")} AS first_answer, {_valid_sql("string_split(c, 'answer:')[-1]")} AS last_answer, count(*) AS n FROM l GROUP BY 1, 2""")
def predicate_parse(spark, sf):
    r = _replies(spark, sf).select(text.predicate("reply").alias("first_answer"), text.predicate("reply", True).alias("last_answer"))
    return r.groupBy("first_answer", "last_answer").agg(F.count(F.lit(1)).alias("n"))


def _canon_sql(p: str) -> str:
    return "CASE " + " ".join(f"WHEN {p} IN ({', '.join(repr(w) for w in ws)}) THEN '{k}'" for k, ws in text.SYNONYMS.items()) + " END"


def _any_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, '{w}') THEN '{k}'" for k, ws in text.SYNONYMS.items() for w in ws) + " END"


_NAMES = ", ".join(f"'{p}'" for p in text.PREDICATES)


@query(rf"""WITH {REPLY}, l AS (SELECT lower(reply) AS c, regexp_extract(lower(reply), '^[^\[]*\[([^\]]+)\]', 1) AS inside FROM r),
p AS (SELECT c, nullif(inside, '') AS inside, string_split(inside, '/') AS parts FROM l),
b AS (SELECT *, coalesce(list_filter(list_transform(parts, lambda p: {_canon_sql(f"trim(p, {_WS})")}), lambda p: p IS NOT NULL)[1], trim(parts[1], {_WS})) AS bracket FROM p)
SELECT CASE WHEN inside IS NOT NULL THEN bracket WHEN trim(c, {_WS}) IN ({_NAMES}) THEN trim(c, {_WS}) ELSE {_any_sql("c")} END AS strict,
       CASE WHEN inside IS NOT NULL THEN bracket ELSE {_any_sql("c")} END AS compat, count(*) AS n FROM b GROUP BY 1, 2""")
def predicate_canonicalize(spark, sf):
    r = _replies(spark, sf).select(text.canonical("reply").alias("strict"), text.canonical("reply", strict=False).alias("compat"))
    return r.groupBy("strict", "compat").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH {REPLY}, l AS (SELECT reply, nullif(regexp_extract(reply, '\[([^\]]+)\]', 1), '') AS inside FROM r),
m AS (SELECT CASE WHEN inside IS NOT NULL THEN nullif(array_to_string(list_transform(list_filter(list_transform(string_split(inside, '/'), lambda p: lower(trim(p, {_WS}))), lambda p: p <> ''), lambda p: coalesce({_canon_sql("p")}, p)), '/'), '')
  ELSE {_any_sql("lower(reply)")} END AS labels FROM l)
SELECT labels, count(*) AS n, count(*) FILTER (WHERE list_contains(string_split(labels, '/'), 'within')) AS names_within FROM m GROUP BY labels""")
def predicate_multi(spark, sf):
    r = _replies(spark, sf).select(text.canonical_all("reply").alias("labels"), text.names_gold("reply", F.lit("within")).alias("w"))
    return r.groupBy("labels").agg(F.count(F.lit(1)).alias("n"), F.count_if("w").alias("names_within"))


# --- entropy and context --------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT o_orderpriority AS description, o_orderstatus AS predicted, count(*) AS n FROM orders GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY description) AS t FROM g)
SELECT description, max(t)::BIGINT AS total, round(-sum(n / t * log2(n / t)) + 0.0, 9) AS entropy,
       array_to_string(list(predicted || ':' || n ORDER BY predicted), ',') AS distribution
FROM s GROUP BY description HAVING max(t) >= 5""")
def relation_entropy(spark, sf):
    o = table(spark, sf, "orders").where(metrics.scored("o_orderstatus"))
    e = metrics.entropy(metrics.counts(o, "o_orderpriority", "o_orderstatus"), "truth").where("total >= 5")
    shown = F.array_join(F.transform(F.map_entries("distribution"), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ",")
    return e.select(F.col("truth").alias("description"), "total", F.round("entropy", 9).alias("entropy"), shown.alias("distribution"))


WIDE = """w AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'signup') AS signup,
  count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id),
t AS (SELECT *, (click + error + purchase + signup + view)::DOUBLE AS s FROM w)"""


def _wide(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", list(EVENTS)).count().fillna(0, list(EVENTS))


@query(f"""WITH {WIDE} SELECT user_id, round(({" + ".join(f"CASE WHEN {c} > 0 THEN -({c} / s) * log2({c} / s) ELSE 0 END" for c in EVENTS)}) / log2(5) + 0.0, 9) AS entropy_norm FROM t""")
def relation_entropy_norm(spark, sf):
    return metrics.normalized_entropy(_wide(spark, sf), EVENTS, 5).select("user_id", F.round("entropy_norm", 9).alias("entropy_norm"))


@query(f"""WITH {WIDE}, p AS (SELECT *, ['click','error','purchase','signup','view'][user_id % 5 + 1] AS predicate FROM t)
SELECT user_id, predicate, round(CASE predicate WHEN 'click' THEN click WHEN 'error' THEN error WHEN 'purchase' THEN purchase WHEN 'signup' THEN signup ELSE view END / s, 6) AS accuracy FROM p""")
def predicate_accuracy_dynamic(spark, sf):
    w = _wide(spark, sf).withColumn("predicate", F.get(F.array(*[F.lit(e) for e in EVENTS]), (F.col("user_id") % 5).cast("int")))
    return rounded(metrics.dynamic_accuracy(w, EVENTS, "predicate"), "accuracy").select("user_id", "predicate", "accuracy")


LINE = """l AS (SELECT l_returnflag AS description, l_linestatus AS predicate, n_name AS context
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def _lines(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("context"))
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("description"), F.col("l_linestatus").alias("predicate"))
    return rows.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("description", "predicate", "context")


@query(f"""WITH {LINE}, g AS (SELECT description, predicate, context, count(*) AS n FROM l GROUP BY 1, 2, 3),
s AS (SELECT *, sum(n) OVER (PARTITION BY description, context) AS total FROM g)
SELECT description || '->' || predicate || chr(10) || '(' || context || ')' AS key, n AS frequency, total::BIGINT AS total, round(n::DOUBLE / total, 6) AS share
FROM s WHERE total >= 5""")
def context_conditioned_pairs(spark, sf):
    g = _lines(spark, sf).groupBy("description", "predicate", "context").agg(F.count(F.lit(1)).alias("frequency"))
    g = g.withColumn("total", F.sum("frequency").over(Window.partitionBy("description", "context"))).where("total >= 5")
    key = F.concat("description", F.lit("->"), "predicate", F.lit("\n("), "context", F.lit(")"))
    return g.select(key.alias("key"), "frequency", "total", r6(F.col("frequency") / F.col("total"), "share"))


@query(f"""WITH {LINE}, g AS (SELECT description, context, count(DISTINCT predicate) AS k, count(*) AS n FROM l GROUP BY 1, 2),
i AS (SELECT description, count(*) AS contexts, (count(*) FILTER (WHERE k = 1)) AS one_to_one, sum(n)::BIGINT AS n FROM g GROUP BY description)
SELECT description, contexts, one_to_one, n, one_to_one = contexts AS invariant FROM i WHERE contexts >= 3""")
def invariant_pairs(spark, sf):
    g = _lines(spark, sf).groupBy("description", "context", "predicate").agg(F.count(F.lit(1)).alias("n"))
    g = g.groupBy("description", "context").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    i = g.groupBy("description").agg(F.count(F.lit(1)).alias("contexts"), F.count_if(F.col("k") == 1).alias("one_to_one"), F.sum("n").alias("n"))
    return i.where("contexts >= 3").withColumn("invariant", F.col("one_to_one") == F.col("contexts"))


@query(f"""WITH {LINE}, g AS (SELECT description, predicate, context, count(*) AS n FROM l GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY CASE WHEN context < 'M' THEN 0 ELSE 1 END, n DESC, context, predicate) AS k FROM g)
SELECT description, predicate, context, n FROM r WHERE k = 1""")
def one_to_one_contexts(spark, sf):
    """W5, W8."""
    g = _lines(spark, sf).groupBy("description", "predicate", "context").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("description").orderBy(F.when(F.col("context") < "M", 0).otherwise(1), F.desc("n"), "context", "predicate")
    return g.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


@query(f"""WITH {PRED}, c AS (SELECT truth, temperature, avg((truth = predicted)::INT) AS acc FROM pred GROUP BY 1, 2),
b AS (SELECT truth, acc AS base FROM c WHERE temperature = 0.25), o AS (SELECT avg(acc) AS overall FROM c)
SELECT c.truth, c.temperature, round(c.acc, 6) AS acc, round(c.acc - b.base, 6) AS delta,
       CASE WHEN c.acc - o.overall > 0.01 THEN 'Improves' WHEN c.acc - o.overall < -0.01 THEN 'Declines' ELSE 'Unchanged' END AS effect
FROM c LEFT JOIN b ON c.truth = b.truth CROSS JOIN o""")
def baseline_delta(spark, sf):
    c = predictions(spark, sf).groupBy("truth", "temperature").agg(metrics.accuracy("truth", "predicted").alias("acc"))
    base = c.where("temperature = 0.25").select("truth", F.col("acc").alias("base"))
    out = metrics.versus_mean(c, "acc", 0.01).join(base, "truth", "left")
    return out.select("truth", "temperature", r6("acc", "acc"), r6(F.col("acc") - F.col("base"), "delta"), "effect")


@query(f"""WITH {PRED} SELECT truth, count(*) AS frequency, round(avg((truth = predicted)::INT), 6) AS accuracy FROM pred
WHERE truth IN ('click', 'view', 'purchase') GROUP BY truth""")
def predicate_frequency(spark, sf):
    """A27, F6."""
    p = predictions(spark, sf).where(F.col("truth").isin("click", "view", "purchase"))
    return rounded(p.groupBy("truth").agg(F.count(F.lit(1)).alias("frequency"), metrics.accuracy("truth", "predicted").alias("accuracy")), "accuracy")


# --- distances and values -------------------------------------------------------------------------------------

TOLD = ("Answer: ~2,900 km", "2 560 km", "42.65 and 1356.6", "about 12", "no digits", "", "7 km or 80 kilometers", "1,234.5KM away")
TOLD_WIDE = (*TOLD, "\n", "\t\u00a0\n", "2 560 km")


def _told(spark, sf):
    a = F.get(F.array(*[F.lit(v) for v in TOLD_WIDE]), (F.col("doc_id") % len(TOLD_WIDE)).cast("int"))
    return table(spark, sf, "documents").select("doc_id", a.alias("output"), (F.col("doc_id") * 3.0).alias("truth"), F.when(F.col("doc_id") % 2 == 0, F.lit(1267.0)).alias("predicted_dis"))


_W = text.WIDE
_NUM = text.NUMBER
TOLD_SQL = f"""told AS (SELECT doc_id, [{", ".join("'" + v.replace("'", "''") + "'" for v in TOLD_WIDE)}][doc_id % {len(TOLD_WIDE)} + 1] AS output,
  doc_id * 3.0::DOUBLE AS truth, CASE WHEN doc_id % 2 = 0 THEN 1267.0::DOUBLE END AS predicted_dis FROM documents),
x AS (SELECT *, nullif(regexp_extract(output, '(?i)({_NUM})[\\s{_W}]*(?:km|kilometers)', 1), '') AS unit, regexp_extract_all(output, '({_NUM})', 1) AS every FROM told),
y AS (SELECT *, list_filter(every, lambda v: coalesce(TRY_CAST(regexp_replace(v, '[,\\s{_W}]', '', 'g') AS DOUBLE), -1) >= 50)[1] AS far, every[-1] AS last FROM x),
dist AS (SELECT *, regexp_replace(coalesce(unit, far, last), '[,\\s{_W}]', '', 'g') AS cleaned,
  CASE WHEN unit IS NOT NULL THEN 'unit' WHEN far IS NOT NULL THEN 'first>=50' WHEN last IS NOT NULL THEN 'fallback_last' END AS strategy FROM y)"""


@query(f"WITH {TOLD_SQL} SELECT cleaned, TRY_CAST(cleaned AS DOUBLE) AS value, strategy, count(*) AS n FROM dist GROUP BY 1, 2, 3")
def distance_extract(spark, sf):
    d = _told(spark, sf).select(text.distance("output").alias("d")).select("d.cleaned", "d.value", "d.strategy")
    return d.groupBy("cleaned", "value", "strategy").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TOLD_SQL}, v AS (SELECT *, trim(output, {_WS}) = '' AND predicted_dis IS NOT NULL AS fb FROM dist),
e AS (SELECT CASE WHEN fb THEN 'fallback_predicted_dis' ELSE strategy END AS strategy, abs(CASE WHEN fb THEN predicted_dis ELSE TRY_CAST(cleaned AS DOUBLE) END - truth) AS e FROM v)
SELECT strategy, count(*) AS n, count(e) AS parsed, round(avg(e), 6) AS mean_error, round(median(e), 6) AS median_error FROM e GROUP BY strategy""")
def distance_error(spark, sf):
    d = _told(spark, sf).withColumn("d", text.distance_or("output", "predicted_dis"))
    e = F.abs(F.col("d.value") - F.col("truth"))
    d = d.select(F.coalesce("d.strategy", F.lit("")).alias("strategy"), e.alias("e"))
    out = d.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.count("e").alias("parsed"), r6(F.avg("e"), "mean_error"))
    out = out.join(relational.quantiles(d, "e", [0.5], "strategy"), "strategy", "left")
    return out.select(F.nullif("strategy", F.lit("")).alias("strategy"), "n", "parsed", "mean_error", r6(F.col("q")[0], "median_error"))


@query("""SELECT event_id, TRY_CAST(rtrim(trim(replace(replace(props, '{"k": ', ''), '}', '.')), '.') AS DOUBLE) AS value FROM events""")
def predicted_value_cast(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.replace("props", F.lit("}"), F.lit(".")).alias("o"))
    return e.select("event_id", text.predicted_value("o", F.lit('{"k": ')).alias("value"))


@query("""SELECT doc_id, CASE WHEN length(t) > 180 THEN left(t, 180) || '...' ELSE t END AS snippet FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)""")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.snippet("text").alias("snippet"))


GAZ = ("the, Texas", "and, Ohio", "le, France", "que, France", "of the, Maine")


@query(f"""WITH g AS (SELECT unnest([{", ".join(repr(x) for x in GAZ)}]) AS name, unnest([{", ".join(str(i) for i in range(len(GAZ)))}]) AS ord),
c AS (SELECT lower(trim(string_split(name, ',')[1], {_WS})) AS city, ord FROM g),
m AS (SELECT d.doc_id, c.city, c.ord, strpos(lower(d.text), ' ' || c.city || ' ') AS p FROM documents d JOIN c ON contains(lower(d.text), ' ' || c.city || ' ')
  WHERE c.city <> CASE WHEN d.doc_id % 2 = 0 THEN 'the' ELSE 'none' END),
f AS (SELECT doc_id, arg_min(city, p * 1000 + ord) AS place FROM m GROUP BY doc_id)
SELECT d.doc_id, f.place, CASE WHEN f.place IS NULL THEN 'FAILED_PARSE' ELSE 'SUCCESS' END AS status FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id""")
def first_city_match(spark, sf):
    g = spark.createDataFrame(list(zip(GAZ, range(len(GAZ)), strict=True)), "place string, ord int")
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "The, Texas").otherwise("none").alias("own"))
    out = pairs.first_place(d, g, "text", "own", "doc_id")
    return out.withColumn("status", F.when(F.col("place").isNull(), "FAILED_PARSE").otherwise("SUCCESS"))


# --- pairs ----------------------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT s_name AS name, {LAT.format(k="s_suppkey")} AS lat, {LON.format(k="s_suppkey")} AS lon FROM supplier),
d AS (SELECT a.name, b.name AS other, round({hav_sql("6371.0088", "a.lat", "a.lon", "b.lat", "b.lon")}, 6) AS d FROM s a JOIN s b ON a.name <> b.name)
SELECT name, arg_min(other, (d, other)) AS near, min(d) AS near_km, arg_min(other, (-d, other)) AS far, max(d) AS far_km FROM d GROUP BY name""")
def nearest_farthest(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), lat("s_suppkey").alias("lat"), lon("s_suppkey").alias("lon"))
    return pairs.nearest_farthest(s, distance=lambda *a: F.round(geo.haversine_km(*a), 6))


@query()
def nearest_farthest_geodesic(spark, sf):
    """M3 has no form in SQL; tests hold it against published lengths."""
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), lat("s_suppkey").alias("lat"), lon("s_suppkey").alias("lon"))
    return pairs.nearest_farthest(s, distance=lambda *a: F.round(geo.geodesic_km(*a), 6))


@query("""SELECT user_id, event_id % 10 AS b, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view,
  count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1, 2""")
def preposition_pair_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("b", F.col("event_id") % 10)
    return pairs.pair_counts(e, "user_id", "b", "event_type", ("click", "view", "error", "purchase"))


@query("""WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE left(n_name, 3) END AS key FROM customer JOIN nation ON c_nationkey = n_nationkey),
short AS (SELECT left(n_name, 3) AS s, arg_min(n_regionkey, n_name) AS r FROM nation GROUP BY 1)
SELECT k.c_custkey, k.key, coalesce(n.n_regionkey, short.r) AS n_regionkey FROM k LEFT JOIN nation n ON k.key = n.n_name LEFT JOIN short ON k.key = short.s""")
def fallback_key_join(spark, sf):
    """The full name, else the first by its short name."""
    n = table(spark, sf, "nation").withColumn("short", F.substring("n_name", 1, 3))
    c = table(spark, sf, "customer").join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).otherwise(F.substring("n_name", 1, 3)).alias("key"))
    return pairs.with_fallback_key(c, n, "key", "n_name", "short", "n_regionkey")


# --- statistics -----------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(stddev_samp(l_quantity), 6) AS std
FROM lineitem GROUP BY 1, 2""")
def group_distance_stats(spark, sf):
    return rounded(metrics.group_stats(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus"), "mean", "median", "std")


@query("""SELECT event_id, event_type, value, round(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id)::DOUBLE / count(*) OVER (PARTITION BY event_type), 9) AS ecdf FROM events""")
def ecdf(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return stats.ecdf(e, "value", "event_id", "event_type").select("event_id", "event_type", "value", F.round("ecdf", 9).alias("ecdf"))


@query("""WITH v AS (SELECT CASE WHEN value = 0 THEN 0.001 ELSE value END AS x FROM events), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT least(49, floor((x - lo) / (hi - lo) * 50))::INT AS bin, count(*) AS n FROM v, e GROUP BY 1""")
def histogram50(spark, sf):
    return stats.histogram(table(spark, sf, "events"), "value", 50, 0.001)


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT q.event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(value) AS whisker_low, max(value) AS whisker_high
FROM q JOIN events e ON q.event_type = e.event_type AND value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) GROUP BY 1, 2, 3, 4""")
def boxplot(spark, sf):
    return rounded(stats.boxplot(table(spark, sf, "events"), "value", "event_type"), "q1", "median", "q3")


_PROFILE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max FROM lineitem" for c in _PROFILE))
def numeric_profile(spark, sf):
    df = table(spark, sf, "lineitem").select(*_PROFILE)
    return rounded(stats.profile(df, stats.numeric_columns(df)), "mean", "median", "std")


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value NULLS FIRST LIMIT 3")
def top_value_counts(spark, sf):
    return stats.top_values(table(spark, sf, "customer"), "c_mktsegment", 3)


_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _PROFILE)


@query(f"""WITH r AS (SELECT {_RANKS} FROM lineitem) """ + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM r" for i, a in enumerate(_PROFILE) for b in _PROFILE[i + 1 :]))
def spearman_matrix(spark, sf):
    return rounded(stats.spearman(table(spark, sf, "lineitem"), list(_PROFILE)), "rho")


@query("""WITH v AS (SELECT value, event_type FROM events WHERE event_type IN ('click', 'view')),
r AS (SELECT event_type, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY value) AS t FROM v),
s AS (SELECT count(*) FILTER (WHERE event_type = 'click')::DOUBLE AS n1, count(*) FILTER (WHERE event_type = 'view')::DOUBLE AS n2,
  sum(r) FILTER (WHERE event_type = 'click') AS w, sum((t * t - 1)::DOUBLE) AS ties FROM r),
u AS (SELECT *, w - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s)
SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 6) AS u, round(greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u""")
def mann_whitney(spark, sf):
    return rounded(stats.mann_whitney(table(spark, sf, "events"), "value", "event_type", "click", "view"), "u", "z").drop("p")


@query("""WITH v AS (SELECT event_type AS s, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id, value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n
  FROM events WHERE event_type IN ('click', 'view')),
d AS (SELECT s, rep, ('0x' || substr(md5('0-' || rep || '-' || s || '-' || r), 1, 12))::BIGINT % n AS pick FROM v, (SELECT unnest(range(2000)) AS rep)),
m AS (SELECT d.rep, median(v.v) FILTER (WHERE d.s = 'click') - median(v.v) FILTER (WHERE d.s = 'view') AS x FROM d JOIN v ON d.s = v.s AND d.pick = v.r GROUP BY d.rep)
SELECT round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.975), 6) AS high FROM m""")
def bootstrap_median_diff(spark, sf):
    """2000 resamples."""
    out = stats.bootstrap_median_difference(table(spark, sf, "events"), "value", "event_type", "click", "view", "event_id", reps=2000)
    return rounded(out, "low", "median", "high")


@query("SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 9) AS scaled FROM part")
def minmax_scale(spark, sf):
    return stats.minmax(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", F.round("scaled", 9).alias("scaled"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 200")
def top_outliers(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(200)


# --- coverage -------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, 'missing' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT doc_id, 'extra' FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents)""")
def coverage_missing_extra(spark, sf):
    return coverage.missing_extra(table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1"), "doc_id")


@query(f"""WITH {PRED}, h AS (SELECT user_id, list(DISTINCT temperature) AS have FROM pred GROUP BY user_id)
SELECT user_id, array_to_string(list_transform(list_sort(list_filter([0.25, 0.5, 1.0]::DOUBLE[], lambda t: NOT list_contains(have, t))), lambda t: (t * 100)::INT), ',') AS missing, len(have) = 3 AS complete FROM h""")
def coverage_by_temp(spark, sf):
    """A19, over all answers."""
    out = coverage.by_setting(predictions(spark, sf), "user_id", "temperature", [0.25, 0.5, 1.0])
    return out.withColumn("missing", F.array_join(F.transform("missing", lambda t: (t * 100).cast("int").cast("string")), ","))


@query(f"WITH {PRED} SELECT count(DISTINCT user_id) AS ids, count(DISTINCT (user_id, temperature)) AS pairs, count(DISTINCT temperature) AS settings FROM pred")
def coverage_counts(spark, sf):
    return coverage.distinct_counts(predictions(spark, sf), "user_id", "temperature")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, sf):
    return coverage.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query(f"WITH {PRED} SELECT user_id, temperature, arg_max(predicted, event_id) AS predicted FROM pred GROUP BY 1, 2")
def last_answer(spark, sf):
    """W6."""
    return coverage.last_write(predictions(spark, sf), "predicted", "event_id", "user_id", "temperature")


@query(f"WITH {PRED} SELECT event_id, row_number() OVER (ORDER BY event_id) AS seen, round(avg((truth = predicted)::INT) OVER (ORDER BY event_id), 6) AS running_accuracy FROM pred")
def running_accuracy(spark, sf):
    p = predictions(spark, sf).select("event_id", (F.col("truth") == F.col("predicted")).alias("ok"))
    return rounded(metrics.running_accuracy(p, "event_id", "ok"), "running_accuracy").drop("ok")


# --- samples --------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= n - ceil(0.7 * n) THEN 'train' ELSE 'test' END AS split FROM o""")
def split_random(spark, sf):
    return sampling.split_random(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.7)


_STRATA = """s AS (SELECT *, quality * 2 + toxic AS label FROM labels), z AS (SELECT label, count(*) AS n FROM s GROUP BY label),
t AS (SELECT *, sum(n) OVER () - ceil(0.7 * sum(n) OVER ()) AS total, sum(n) OVER () AS all_n FROM z),
f AS (SELECT label, n, total, floor(n * total / all_n) AS fl, round(n * total / all_n - floor(n * total / all_n), 9) AS part FROM t),
q AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY part DESC, label) <= total - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM f)"""


@query(f"""WITH {_STRATA}, k AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || doc_id), doc_id) AS k FROM s)
SELECT k.doc_id, k.label, CASE WHEN k.k <= q.quota THEN 'eval' ELSE 'finetune' END AS split FROM k JOIN q ON k.label = q.label""")
def split_stratified(spark, sf):
    d = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label"))
    return sampling.split_stratified(d, "label", "doc_id", 0.3)


@query("""WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN k <= floor(n * 0.3) THEN 'eval' ELSE 'finetune' END AS split FROM k""")
def split_per_file(spark, sf):
    return sampling.split_by_group(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 0.3)


@query("""WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT CASE WHEN k <= floor(n * 0.3) THEN 'eval' ELSE 'finetune' END AS split, count(*) AS n, count(DISTINCT source) AS files FROM k GROUP BY 1""")
def split_metadata(spark, sf):
    """P6."""
    s = sampling.split_by_group(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 0.3)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("files"))


@query("""WITH s AS (SELECT doc_id, quality * 2 + toxic AS label FROM labels), z AS (SELECT label, count(*) AS n FROM s GROUP BY label HAVING count(*) < 50),
k AS (SELECT s.doc_id, s.label, row_number() OVER (PARTITION BY s.label ORDER BY doc_id) - 1 AS k FROM s JOIN z ON s.label = z.label),
d AS (SELECT label, copy, ('0x' || substr(md5('42-' || label || '-' || copy), 1, 12))::BIGINT % n AS pick FROM (SELECT label, n, unnest(range(1, 51 - n)) AS copy FROM z))
SELECT doc_id, label, 0 AS copy FROM s UNION ALL SELECT k.doc_id, k.label, d.copy::INT FROM d JOIN k ON d.label = k.label AND d.pick = k.k""")
def oversample_minority(spark, sf):
    d = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label"))
    return sampling.oversample(d, "label", "doc_id", 50)


@query("""WITH r AS (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY md5('42-' || d.doc_id), d.doc_id) - 1 AS k, count(*) OVER (PARTITION BY d.source) AS n
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT a.source, a.doc_id, p.place::INT AS place, b.doc_id AS exemplar FROM r a, (SELECT unnest([1, 2, 3]) AS place) p, r b
WHERE p.place < a.n AND b.source = a.source AND b.k = (a.k + p.place) % a.n""")
def few_shot_exemplars(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    return sampling.exemplars(d, "doc_id", 3, "source")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) AS k FROM documents) WHERE k <= 5")
def k_per_group(spark, sf):
    return sampling.k_per_group(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 5, "source")


# --- prompts, joins, files ------------------------------------------------------------------------------------


_AT = "printf(' (%.4f, %.4f)', {a}, {b})"
_PLACES = f"""p AS (SELECT c_custkey, c_name, n_name, c_mktsegment, {_AT.format(a=LAT.format(k="c_custkey"), b=LON.format(k="c_custkey"))} AS c_at, {_AT.format(a=LAT.format(k="c_nationkey"), b=LON.format(k="c_nationkey"))} AS n_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_ASKED = "'Question: What is the distance in kilometers between ' || c_name || {c} || ' and ' || n_name || {n} || '? {ask}' || chr(10) || 'Answer:'"
_SHOWN = "'Question: Distance between ' || n_name || {n} || ' and ' || c_name || {c} || '? Answer: {before}' || c_custkey || '{after}' || chr(10)"
_NUMBER, _WHY = "Answer exactly with the number only.", "Explain your reasoning and how the distance is found"


def _shot_sql(p: str, before: str, after: str, ask: str) -> str:
    at = {"c": "c_at", "n": "n_at"} if p in ("p2", "p4") else {"c": "''", "n": "''"}
    core = _ASKED.format(ask=ask, **at)
    return f"{core} AS {p}, 'Here are some examples:' || chr(10) || chr(10) || {_SHOWN.format(before=before, after=after, **at)} || chr(10) || 'Now fulfill the following:' || chr(10) || {core} AS {p}_shots"


@query(f"""WITH {_PLACES} SELECT c_custkey, n_name || ' is near ' AS near, split_part(n_name || ', ' || c_mktsegment, ',', 1) || ' is far from ' AS far, c_name || ' is close to ' AS close, c_name || ' and ' AS and_,
  n_name || ' and ' || c_name || '.' || chr(10) || chr(10) || n_name || ' and ' || c_name || '.' || chr(10) || chr(10) || n_name || ' and ' || c_name || '.' || chr(10) || chr(10) || c_mktsegment || ' and' AS and_shots,
  {_shot_sql("p1", "", "", _NUMBER)}, {_shot_sql("p2", "", "", _NUMBER)},
  {_shot_sql("p3", "The distance is approximately ", " km. This is calculated using spatial geometry.", _WHY + ".")},
  {_shot_sql("p4", "Using the Haversine formula on these coordinates, the distance is ", " km.", _WHY + " using these coordinates.")},
  '<|start|>system' || chr(10) || 'You are an expert in topological spatial reasoning.<|end|>' || chr(10) || '<|start|>user' || chr(10) || 'Sentence: ' || c_name || chr(10) || 'Subject: ' || c_mktsegment || chr(10) || 'Object: ' || n_name || '<|end|>' || chr(10) || '<|start|>assistant' || chr(10) AS topo,
  '<|start|>system' || chr(10) || 'You are an expert in topological spatial reasoning.<|end|>' || chr(10) || '<|start|>user' || chr(10) || chr(10) || chr(10) || '--- EXAMPLES ---' || chr(10) || chr(10) || 'User query: given the sentence: A ' || c_name || ' B and A is ' || c_mktsegment || ', B is ' || n_name || '.' || chr(10)
    || 'Analysis: Based on the spatial context of ' || chr(39) || c_name || chr(39) || ' between a ' || c_mktsegment || ' and a ' || n_name || ', the standard topological relation matches.' || chr(10) || 'Answer: A [within] B' || chr(10) || '--- END EXAMPLES ---' || chr(10) || chr(10)
    || 'Sentence: ' || c_name || chr(10) || 'Subject: ' || c_mktsegment || chr(10) || 'Object: ' || n_name || '<|end|>' || chr(10) || '<|start|>assistant' || chr(10) || 'touches<|end|>' AS topo_row
FROM p""")
def prompt_templates(spark, sf):
    """Every type, without and with exemplars."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    here, there = (lat("c_custkey"), lon("c_custkey")), (lat("c_nationkey"), lon("c_nationkey"))
    both, six = ("c_name", "n_name"), ["n_name", "c_name"] * 3
    out = [text.sentence_prompt("n_name", "near").alias("near"), text.sentence_prompt(F.concat("n_name", F.lit(", "), "c_mktsegment"), "far", state=False).alias("far"), text.sentence_prompt("c_name", "close").alias("close"), text.sentence_prompt("c_name", "and").alias("and_"), text.sentence_prompt("c_mktsegment", "and", exemplars=six).alias("and_shots")]
    for p in ("p1", "p2", "p3", "p4"):
        shown = F.array(text.distance_exemplar(p, "n_name", "c_name", "c_custkey", *there, *here))
        out += [text.distance_prompt(p, *both, *here, *there).alias(p), text.distance_prompt(p, *both, *here, *there, exemplars=shown).alias(f"{p}_shots")]
    topo = ("c_name", "c_mktsegment", "n_name")
    shown = F.array(text.topology_exemplar(*topo, F.lit("within")))
    return c.select("c_custkey", *out, text.topology_prompt(*topo).alias("topo"), text.topology_prompt(*topo, relation=F.lit("touches"), exemplars=shown).alias("topo_row"))


@query("""SELECT c_custkey, 'system|Answer with a direction.|user|' || c_name || '?' AS flat, 2::BIGINT AS n FROM customer""")
def chat_messages(spark, sf):
    m = text.messages(F.lit("Answer with a direction."), F.concat("c_name", F.lit("?")))
    c = table(spark, sf, "customer").select("c_custkey", m.alias("m"))
    flat = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("|"), x["content"])), "|")
    return c.select("c_custkey", flat.alias("flat"), F.size("m").cast("long").alias("n"))


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, '') AS answer FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def qa_left_join(spark, sf):
    d = table(spark, sf, "documents")
    allowed = d.where("lang = 'en'").select("doc_id")
    out = d.select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").join(allowed, "doc_id", "left_semi")
    return out.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("answer"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.output'), json_extract_string(props, '$.k')) AS output FROM events""")
def json_envelope_scan(spark, sf):
    """Nested fields with a fallback chain; bad JSON gives nulls."""
    p = F.from_json("props", "k long, output string")
    e = table(spark, sf, "events").withColumn("p", p)
    return e.select("event_id", F.col("p.k").alias("k"), F.coalesce(F.nullif(F.col("p.output"), F.lit("")), F.col("p.k").cast("string")).alias("output"))


REPORTS = [(f"report_gen_dis_{p}_{s}.txt", f"gen_dis_{p}_{s}.json", mean, med) for p, s, mean, med in (("p1", "zero-shot", 27.86, 5.28), ("p1", "3-shot", 23.57, 5.41), ("p2", "zero-shot", 278.55, 200.97), ("p3", "3-shot", 18.69, 5.5), ("p4", "tag-3-shot", 1.5, 1.0))]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', {'NULL' if 'tag' in f else repr(f.split('_')[2])}, {'NULL' if 'tag' in f else repr(f.split('_')[3][:-5])}, 1000, 100.0::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for _, f, a, b in REPORTS) + ") t(file_name, phase, shot, total_samples, prediction_rate, mean_error_km, median_error_km)")
def report_text_parse(spark, sf):
    """R12, S23, O2."""
    rows = [(r, f"DISTANCE EVALUATION\nFile: {f}\nTotal Samples: 1000\nValid Predictions: 1000\nPrediction Rate (%): 100.0\nMean Error (km): {a}\nMedian Error (km): {b}\n") for r, f, a, b in REPORTS]
    d = spark.createDataFrame(rows, "report_file string, value string")
    d = d.select(*[c.alias(k) for k, c in readers.report_fields("value").items()])
    phase, shot = text.file_phase("file_name")
    d = d.select("file_name", phase.alias("phase"), shot.alias("shot"), "total_samples", "prediction_rate", "mean_error_km", "median_error_km")
    return d.orderBy(F.regexp_extract("phase", "([0-9]+)", 1).try_cast("int"), F.when(F.col("shot") == "zero-shot", 0).otherwise(1))


@query("SELECT c_custkey, r_name AS division FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_name <> 'CHINA' LEFT JOIN region ON n_regionkey = r_regionkey")
def division_lookup(spark, sf):
    """Names without a division stay, with null."""
    dim = table(spark, sf, "nation").where("n_name <> 'CHINA'").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("division"))
    return table(spark, sf, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "division")


@query("SELECT p AS p_type, s AS shot, t AS state FROM (SELECT unnest(['near','far','close','and']) AS p), (SELECT unnest(['zero-shot','3-shot']) AS s), (SELECT unnest(['state','no-state']) AS t)")
def experiment_grid(spark, sf):
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    return one("p_type", ("near", "far", "close", "and")).crossJoin(one("shot", ("zero-shot", "3-shot"))).crossJoin(one("state", ("state", "no-state")))


@query("""SELECT conv_id, turn, list_aggregate(list_filter(['the', 'and', 'que'], lambda n: contains(' ' || regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g') || ' ', ' ' || n || ' ')), 'string_agg', ',') AS places
FROM conversations WHERE len(list_filter(['the', 'and', 'que'], lambda n: contains(' ' || regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g') || ' ', ' ' || n || ' '))) > 0""")
def named_places(spark, sf):
    """R19 with a gazetteer; rows without a name go."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", connectors.places_in(F.col("text"), ["the", "and", "que"]).alias("p"))
    return c.where(F.size("p") > 0).select("conv_id", "turn", F.array_join("p", ",").alias("places"))


@query("""SELECT o_custkey AS key, array_to_string(list(o_orderkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey), ',') AS top
FROM orders GROUP BY 1""")
def listed_by_metric(spark, sf):
    """A list sorted by a metric, as text: all orders of each customer."""
    o = table(spark, sf, "orders").select("o_custkey", F.struct(F.col("o_totalprice").isNull().alias("none"), (-F.col("o_totalprice")).alias("k"), "o_orderkey").alias("x"))
    return o.groupBy(F.col("o_custkey").alias("key")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["o_orderkey"].cast("string")), ",").alias("top"))


@query("SELECT event_type, 'value' AS measure, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1 UNION ALL SELECT event_type, 'user_id', count(*), round(sum(user_id)::DOUBLE, 4) FROM events GROUP BY 1")
def wide_to_long(spark, sf):
    """U1, U7."""
    e = table(spark, sf, "events").select("event_type", "value", F.col("user_id").cast("double").alias("user_id"))
    long = e.unpivot("event_type", ["value", "user_id"], "measure", "x")
    return long.groupBy("event_type", "measure").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total"))


# --- small relational steps -----------------------------------------------------------------------------------


@query(f"WITH {PRED} SELECT event_id, predicted FROM pred WHERE event_id <= 1400 AND event_id IN (SELECT doc_id FROM labels) AND temperature IN (0.25, 1.0)")
def id_filters(spark, sf):
    """F1, F2, F9."""
    allowed = table(spark, sf, "labels").select(F.col("doc_id").alias("event_id"))
    p = relational.id_filter(predictions(spark, sf), "event_id", 1400, allowed)
    return p.where(F.col("temperature").isin(0.25, 1.0)).select("event_id", "predicted")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents), b AS (SELECT value, row_number() OVER (ORDER BY event_id) AS k FROM events)
SELECT a.doc_id, a.k - 1 AS row, b.value FROM a LEFT JOIN b ON a.k = b.k""")
def positional_assign(spark, sf):
    """J14, W7."""
    d = relational.row_number(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return relational.positional(d, table(spark, sf, "events").select("event_id", "value"), "doc_id", "event_id", "value")


@query("""WITH l AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), r AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'left' WHEN l.doc_id IS NULL THEN 'right' ELSE 'both' END AS place FROM l FULL JOIN r ON l.doc_id = r.doc_id""")
def set_operations(spark, sf):
    """U2, U3, U4."""
    d = table(spark, sf, "labels")
    return relational.set_operations(d.where("quality = 1"), d.where("toxic = 1"), "doc_id")


@query("SELECT c_custkey::VARCHAR AS id, c_name FROM customer ORDER BY c_custkey LIMIT 20")
def numeric_id_order(spark, sf):
    """O4, O5."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name")
    return relational.numeric_order(c, "id").limit(20)


@query(f"""WITH {PRED}, l AS (SELECT truth, truth = predicted AS ok, CASE WHEN event_id % 11 = 0 THEN 'timeout' END AS err FROM pred)
SELECT truth, count(*) AS total, count(*) FILTER (WHERE ok AND err IS NULL) AS correct, count(*) FILTER (WHERE NOT ok AND err IS NULL) AS incorrect,
  count(*) FILTER (WHERE err IS NOT NULL) AS errors, round((count(*) FILTER (WHERE ok AND err IS NULL))::DOUBLE / count(*), 6) AS accuracy FROM l GROUP BY truth""")
def log_statistics(spark, sf):
    """A25."""
    p = predictions(spark, sf).select("truth", (F.col("truth") == F.col("predicted")).alias("ok"), F.when(F.col("event_id") % 11 == 0, "timeout").alias("err"))
    return rounded(relational.log_stats(p, "truth", "ok", "err"), "accuracy")


@query(f"""WITH {PRED}, c AS (SELECT truth, temperature, avg((truth = predicted)::INT) AS acc, count(*) AS n FROM pred GROUP BY 1, 2),
f AS (SELECT truth FROM c GROUP BY truth HAVING sum(n) >= 100)
SELECT temperature, round(avg(acc), 6) AS mean_accuracy, count(*) AS labels FROM c WHERE truth IN (SELECT truth FROM f) GROUP BY temperature""")
def metric_by_context(spark, sf):
    """The mean of a metric by context, over frequent labels."""
    c = predictions(spark, sf).groupBy("truth", "temperature").agg(metrics.accuracy("truth", "predicted").alias("acc"), F.count(F.lit(1)).alias("n"))
    frequent = c.groupBy("truth").agg(F.sum("n").alias("n")).where("n >= 100").select("truth")
    return c.join(frequent, "truth", "left_semi").groupBy("temperature").agg(r6(F.avg("acc"), "mean_accuracy"), F.count(F.lit(1)).alias("labels"))


@query("SELECT doc_id FROM documents ORDER BY md5('7-' || doc_id), doc_id LIMIT 30")
def shuffled_head(spark, sf):
    """The head of a shuffle that is the same at each run."""
    return sampling.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id", 7).limit(30)


@query("""WITH e AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS u, embedding[4]::DOUBLE AS w FROM embeddings),
c AS (SELECT label, count(*) AS n, sum(x * u) - sum(x) * sum(u) / count(*) AS a, sum(x * w) - sum(x) * sum(w) / count(*) AS b, sum(y * u) - sum(y) * sum(u) / count(*) AS c, sum(y * w) - sum(y) * sum(w) / count(*) AS d,
  sum(x * x) - sum(x) * sum(x) / count(*) + sum(y * y) - sum(y) * sum(y) / count(*) AS v, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(w) AS mw FROM e GROUP BY label),
t AS (SELECT *, CASE WHEN a * d - b * c >= 0 THEN atan2(b - c, a + d) ELSE atan2(b + c, a - d) END AS turn, a * d - b * c >= 0 AS proper, (a + d) / v AS s FROM c),
r AS (SELECT *, cos(turn) AS r00, CASE WHEN proper THEN -sin(turn) ELSE sin(turn) END AS r01, sin(turn) AS r10, CASE WHEN proper THEN cos(turn) ELSE -cos(turn) END AS r11 FROM t)
SELECT label, n, round(r00, 6) AS r00, round(r01, 6) AS r01, round(r10, 6) AS r10, round(r11, 6) AS r11, round(mu - s * (r00 * mx + r01 * my), 6) AS tx, round(mw - s * (r10 * mx + r11 * my), 6) AS ty, round(s, 6) AS s FROM r""")
def umeyama_align(spark, sf):
    """M5. The SQL turns by an angle."""
    v = table(spark, sf, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)])
    return rounded(coords.align_by_group(v, "label", ("e0", "e1"), ("e2", "e3")), "r00", "r01", "r10", "r11", "tx", "ty", "s")


@query()
def mds_recover(spark, sf):
    """M6, M7 over nations by region; property tests hold it."""
    p = table(spark, sf, "nation").select(F.col("n_regionkey").alias("group"), F.col("n_name").alias("name"), (lat("n_nationkey") / 3).alias("lat"), (lon("n_nationkey") / 3).alias("lon"))
    q = p.select("group", F.col("name").alias("b"), F.col("lat").alias("y"), F.col("lon").alias("x"))
    d = p.join(q, "group").where("name <> b").select("group", F.col("name").alias("a"), "b", F.sqrt((F.col("lat") - F.col("y")) ** 2 + (F.col("lon") - F.col("x")) ** 2).alias("d"))  # places of one division
    return coords.recover_by_group(d, p, "group")


# --- files: what sinks write, readers read back ---------------------------------------------------------------

_NATION = "n_nationkey long, n_name string, n_regionkey long"
_PLAIN = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"


def _nation(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


def _json_lines(df: DataFrame) -> list[str]:
    return [r["value"] for r in sinks.json_report(df.orderBy("n_nationkey")).collect()]  # 25 rows of a dimension


@query(_PLAIN)
def jsonl_append_scan(spark, sf):
    """A log written in two appends, read strictly."""
    n, to = _nation(spark, sf), scratch(spark)
    sinks.append_jsonl(n.where("n_regionkey < 2"), to)
    sinks.append_jsonl(n.where("n_regionkey >= 2"), to)
    return readers.jsonl(spark, to, _NATION, strict=True)


@query(_PLAIN + " WHERE n_nationkey % 2 = 0")
def jsonl_lenient_scan(spark, sf):
    """R2: every other line is cut short, and blank lines stand between."""
    n, to = _nation(spark, sf), scratch(spark)
    line = F.to_json(F.struct("*"))
    n.select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, line).otherwise(F.substring(line, 1, 9)), F.lit("\n")).alias("value")).write.text(to)
    return readers.jsonl(spark, to, _NATION)


@query(_PLAIN)
def json_array_scan(spark, sf):
    """One file with an object that holds the rows."""
    to = scratch(spark, "results.json")
    sinks.put_text(spark, to, '{"results": [' + ",".join(_json_lines(_nation(spark, sf))) + "]}")
    return readers.json_array(spark, to, _NATION, "results")


@query(_PLAIN)
def csv_append_scan(spark, sf):
    """Headers in every part, names quoted where they need it."""
    n, to = _nation(spark, sf), scratch(spark)
    sinks.append_csv(n.where("n_regionkey < 2"), to)
    sinks.append_csv(n.where("n_regionkey >= 2"), to)
    return readers.csv(spark, to, _NATION)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name || '  of region ' || n_regionkey AS told FROM nation")
def csv_plain_scan(spark, sf):
    """K3: no quotes; commas and line ends in texts become spaces."""
    to = scratch(spark)
    told = F.concat("n_name", F.lit(",\nof region "), "n_regionkey")
    sinks.append_plain_csv(_nation(spark, sf).select("n_nationkey", told.alias("told")), to, "told")
    return readers.csv(spark, to, "n_nationkey long, told string")


@query(_PLAIN + " WHERE n_regionkey = 3")
def atomic_replace_scan(spark, sf):
    """K4: a table that is replaced whole."""
    n, to = _nation(spark, sf), scratch(spark)
    sinks.replace_json(n, to)
    sinks.replace_json(n.where("n_regionkey = 3"), to)
    return readers.jsonl(spark, to, _NATION, strict=True)


@query(_PLAIN)
def csv_export_scan(spark, sf):
    """K5: one file."""
    to = scratch(spark)
    sinks.export_csv(_nation(spark, sf), to)
    return readers.csv(spark, to, _NATION)


@query("SELECT n_name AS name, (n_nationkey % 90)::INT AS lat_deg, 30 AS lat_min, (n_nationkey * 3)::INT AS lng_deg, 15 AS lng_min, '10:00 pm' AS local_time FROM nation")
def gazetteer_scan(spark, sf):
    """Tab-separated places without a header."""
    to = scratch(spark, "places.tsv")
    rows = _nation(spark, sf).orderBy("n_nationkey").collect()  # a dimension
    sinks.put_text(spark, to, "".join(f"{r['n_name']}\t{r['n_nationkey'] % 90}\t30\t{r['n_nationkey'] * 3}\t15\t10:00 pm\n" for r in rows))
    return readers.gazetteer(spark, to)


@query(f"SELECT kind, n_nationkey, n_name, n_regionkey FROM ({_PLAIN}), (SELECT unnest(['csv', 'tsv', 'jsonl', 'ndjson', 'json', 'parquet']) AS kind)")
def suffix_scan(spark, sf):
    """The reader is chosen by the suffix; a json file may hold lines or an array."""
    n, to, out = _nation(spark, sf), scratch(spark), None
    lines = _json_lines(n)
    sinks.put_text(spark, f"{to}/a.jsonl", "\n".join(lines))
    sinks.put_text(spark, f"{to}/a.ndjson", "\n\n".join(lines))
    sinks.put_text(spark, f"{to}/a.json", "[\n" + ",\n".join(lines) + "\n]")
    n.coalesce(1).write.csv(f"{to}/a.csv", header=True)
    n.coalesce(1).write.csv(f"{to}/a.tsv", header=True, sep="\t")
    n.write.parquet(f"{to}/a.parquet")
    for kind in ("csv", "tsv", "jsonl", "ndjson", "json", "parquet"):
        part = readers.by_suffix(spark, f"{to}/a.{kind}", _NATION).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query(_PLAIN)
def xz_scan(spark, sf):
    """Lines of compressed files."""
    import lzma

    to = scratch(spark)
    lines = _json_lines(_nation(spark, sf))
    for k in range(2):
        sinks.put_bytes(spark, f"{to}/{k}.jsonl.xz", lzma.compress("\n".join(lines[k::2]).encode()))
    return readers.xz_lines(spark, f"{to}/*.xz").select(F.from_json("value", _NATION).alias("r")).select("r.*")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, 'gen_' || (n_nationkey % 3) || '.jsonl' AS origin_file FROM nation WHERE n_nationkey % 3 < 2")
def matching_files_scan(spark, sf):
    """The files of a folder whose names match, with the file each row is of."""
    to, lines = scratch(spark), _json_lines(_nation(spark, sf))
    for k in range(3):
        sinks.put_text(spark, f"{to}/{'gen' if k < 2 else 'other'}_{k}.jsonl", "\n".join(lines[k::3]))
    return readers.matching(spark, to, "gen_*.jsonl", _NATION)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CASE n_regionkey % 2 WHEN 0 THEN 'eval' ELSE 'finetune' END AS split, kind FROM nation, (SELECT unnest(['csv', 'json', 'parquet']) AS kind)")
def split_files_scan(spark, sf):
    """A folder for each split, in each format."""
    n, to, out = _nation(spark, sf), scratch(spark), None
    n = n.select("n_nationkey", "n_name", F.when(F.col("n_regionkey") % 2 == 0, "eval").otherwise("finetune").alias("split"))
    for kind in ("csv", "json", "parquet"):
        sinks.write_splits(n, f"{to}/{kind}", kind=kind)
        back = spark.read.schema("n_nationkey long, n_name string, split string").options(header=True).format(kind).load(f"{to}/{kind}")
        part = back.select("n_nationkey", "n_name", "split", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT n_nationkey::BIGINT AS id, '{\"n_nationkey\":' || n_nationkey || ',\"place\":{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}}' AS value FROM nation")
def json_report_rows(spark, sf):
    """K6: rows as JSON texts, nested."""
    n = _nation(spark, sf).select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("place"))
    return sinks.json_report(n).select(F.get_json_object("value", "$.n_nationkey").cast("long").alias("id"), "value")


@query("SELECT string_agg(line, chr(10) ORDER BY k) AS report FROM (SELECT -2 AS k, '| r_regionkey | r_name |' AS line UNION ALL SELECT -1, '|---|---|' UNION ALL SELECT r_regionkey, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region)")
def markdown_report(spark, sf):
    """K8: a small result as a Markdown table."""
    r = table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.createDataFrame([(reports.markdown_table(r).rstrip("\n"),)], "report string")


# --- columns and keys -----------------------------------------------------------------------------------------


@query("SELECT 'Latitude_deg' AS lat, 'LNG' AS lon, 'lat' AS second_lat, NULL::VARCHAR AS second_lon")
def coordinate_column_names(spark, sf):
    """by the start of a name, any case; null where there is none."""
    n = _nation(spark, sf)
    a = stats.coordinate_columns(n.selectExpr("n_nationkey as id", "n_regionkey as Latitude_deg", "n_regionkey as LNG"))
    b = stats.coordinate_columns(n.selectExpr("n_nationkey as lat", "n_regionkey as east"))
    return spark.createDataFrame([(*a, *b)], "lat string, lon string, second_lat string, second_lon string")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND user_id % 2 = 0 AND value > 10")
def equality_filters(spark, sf):
    """Several equalities at once, and records without the columns that are keys elsewhere."""
    e = table(spark, sf, "events").where((F.col("event_type") == "click") & (F.col("user_id") % 2 == 0) & (F.col("value") > 10))
    return e.drop(*[c for c in e.columns if c not in ("event_id", "user_id", "event_type")])


@query("SELECT c_custkey, split_part(k, '/', 1) AS a, split_part(k, '/', 2) AS b, nullif(split_part(k, '/', 3), '') AS c, k FROM (SELECT c_custkey, c_mktsegment || '/' || c_nationkey AS k FROM customer)")
def composite_keys(spark, sf):
    """Keys joined, and taken apart again."""
    k = table(spark, sf, "customer").select("c_custkey", text.composite_key("c_mktsegment", F.col("c_nationkey").cast("string")).alias("k"))
    return k.select("c_custkey", *[text.key_part("k", i).alias(c) for i, c in enumerate("abc")], "k")


@query("""SELECT n_nationkey, place, replace(trim(regexp_replace(lower(place || '?! of ' || n_name), '[^0-9a-z_]+', ' ', 'g')), ' ', ', ') AS city_b FROM
(SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name || ', near' END AS place FROM nation)""")
def generated_places(spark, sf):
    """The fourth paragraph without its prefix; a text that has none gives null."""
    n = _nation(spark, sf).select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("a\n\nb\n\nc\n\nNear: "), "n_name", F.lit(", near"))).otherwise("a\n\nb").alias("t"))
    n = n.withColumn("place", text.generated_place("t", F.lit("Near: ")))
    return n.select("n_nationkey", "place", text.city_b(F.concat("place", F.lit("?! of "), "n_name")).alias("city_b"))


@query(f"""WITH {PRED}, t AS (SELECT event_id, truth FROM pred), p AS (SELECT event_id, temperature, predicted FROM pred WHERE event_id % 4 > 0)
SELECT temperature, count(*) AS matched, sum((t.truth = p.predicted)::INT)::BIGINT AS correct FROM t JOIN p ON t.event_id = p.event_id GROUP BY temperature""")
def truth_join_predictions(spark, sf):
    """A table of truths and a log of answers that lacks some, joined by id, scored at each temperature."""
    p = predictions(spark, sf)
    truth, log = p.select("event_id", "truth"), p.where("event_id % 4 > 0").select("event_id", "temperature", "predicted")
    both = truth.join(log, "event_id")
    return both.groupBy("temperature").agg(F.count(F.lit(1)).alias("matched"), F.sum((F.col("truth") == F.col("predicted")).cast("int")).alias("correct"))


@query("""SELECT event_type, c AS column, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max
FROM (SELECT event_type, 'value' AS c, value::DOUBLE AS v FROM events UNION ALL SELECT event_type, 'user_id', user_id::DOUBLE FROM events) GROUP BY 1, 2""")
def profile_by_file(spark, sf):
    """A17 for each file; event_type stands for the file."""
    return rounded(stats.profile(table(spark, sf, "events"), ["value", "user_id"], "event_type"), "mean", "median", "std", "min", "max")
