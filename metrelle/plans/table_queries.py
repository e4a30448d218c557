"""Queries over plans, sessions, texts, addresses and arrays."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrelle.functions import nested, numbers, text
from metrelle.operators import compare, contract, planning, sessions
from metrelle.plans import derived
from metrelle.plans.derived import SQL
from metrelle.sources import results as sources
from metrelle.sources import tables
from metrelle.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


N = 100
_WALK = f"""{SQL}, k AS (SELECT *, sha256(dataset || ':' || row) AS key FROM clips),
walk AS (SELECT *, coalesce(sum(CASE WHEN duration_s <= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept FROM k),
taken AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY key) AS place FROM walk WHERE duration_s <= 30 AND kept < {N})"""


@query(f"WITH {_WALK} SELECT id, key, CAST(place AS INT) AS place FROM taken")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N is the sample's size, the feature."""
    return planning.take_within(derived.clips(spark, sf_dir), N).select("id", "key", "place")


@query(f"WITH {_WALK} SELECT dataset, CAST(count(*) FILTER (duration_s <= 30 AND kept < {N}) AS BIGINT) AS taken, count(*) FILTER (duration_s > 30 AND kept < {N}) AS excluded FROM walk GROUP BY dataset")
def sample_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7."""
    return planning.excluded_before(derived.clips(spark, sf_dir), N)


@query(f"WITH {_WALK} SELECT id, CAST(row_number() OVER (ORDER BY place, d.ordinal NULLS LAST, t.dataset) - 1 AS INT) AS ordinal FROM taken t LEFT JOIN datasets d ON d.dataset = t.dataset")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, W2, T2."""
    taken = planning.take_within(derived.clips(spark, sf_dir), N).drop("ordinal")
    return planning.interleaved(taken, derived.datasets(spark)).select("id", "ordinal")


@query(f"WITH {SQL} SELECT id FROM clips ORDER BY ordinal LIMIT 50 OFFSET 20")
def plan_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4."""
    return planning.plan_slice(derived.clips(spark, sf_dir), 20, 50).select("id")


@query(f"WITH {SQL} SELECT dataset, count(*) AS n, CAST(sum(CAST(duration_s AS DECIMAL(18,3))) AS DOUBLE) AS audio_s FROM clips GROUP BY dataset")
def planned_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return planning.planned_totals(derived.clips(spark, sf_dir))


@query(f"WITH {SQL} SELECT sha256(string_agg(id, chr(10) ORDER BY ordinal)) AS digest FROM clips")
def plan_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return planning.ids_digest(derived.clips(spark, sf_dir))


@query(f"""WITH {SQL}, p AS (SELECT string_agg(id, chr(10) ORDER BY ordinal) AS one, string_agg(id, chr(10) ORDER BY -ordinal) AS back, string_agg(id, chr(10) ORDER BY ordinal) FILTER (ordinal % 7 <> 0) AS part FROM clips)
SELECT 'itself' AS other, one = one AS same FROM p UNION ALL SELECT 'reversed', one = back FROM p UNION ALL SELECT 'a part', one = part FROM p""")
def same_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan against itself, its reverse and a part of it."""
    items = derived.clips(spark, sf_dir)
    others = {"itself": items, "reversed": items.withColumn("ordinal", -F.col("ordinal")), "a part": items.filter("ordinal % 7 <> 0")}
    each = [planning.same_plan(items, other).select(F.lit(name).alias("other"), "same") for name, other in others.items()]
    return each[0].union(each[1]).union(each[2])


@query(f"WITH {SQL} SELECT id, dataset FROM clips WHERE id NOT IN (SELECT id FROM results WHERE model = 'm0' AND error IS NULL)")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, X2."""
    done = derived.results(spark, sf_dir).filter("model = 'm0' AND error IS NULL")
    return planning.pending(derived.clips(spark, sf_dir), done).select("id", "dataset")


@query(f"WITH {SQL} SELECT id AS path FROM clips WHERE id NOT IN (SELECT id FROM results WHERE error IS NOT NULL)")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10."""
    keep = derived.results(spark, sf_dir).filter("error IS NOT NULL").select(F.col("id").alias("path"))
    return planning.stale(derived.clips(spark, sf_dir).select(F.col("id").alias("path")), keep)


@query(f"""WITH {SQL}, p AS (SELECT DISTINCT dataset FROM clips), s(dataset, repo, revision) AS (VALUES ('user', '', '9'), ('system', 'r/s', NULL))
SELECT p.dataset, coalesce(nullif(s.repo, ''), d.repo) AS repo, coalesce(nullif(s.revision, ''), d.revision) AS revision, coalesce(d.label, p.dataset) AS label FROM p LEFT JOIN s ON s.dataset = p.dataset LEFT JOIN datasets d ON d.dataset = p.dataset""")
def source_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4."""
    made = spark.createDataFrame([("user", "", "9"), ("system", "r/s", None)], "dataset string, repo string, revision string")
    return planning.source_fields(derived.clips(spark, sf_dir).select("dataset").distinct(), made, derived.datasets(spark))


@query(f"WITH {SQL} SELECT DISTINCT dataset FROM clips WHERE dataset NOT IN (SELECT dataset FROM datasets)")
def unknown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11."""
    return planning.unknown_values(derived.clips(spark, sf_dir), derived.datasets(spark), "dataset")


@query(f"WITH {SQL} SELECT id, CASE WHEN dataset IN (SELECT dataset FROM datasets) THEN dataset ELSE 'user' END AS dataset FROM clips")
def default_on_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12."""
    return planning.or_default(derived.clips(spark, sf_dir), derived.datasets(spark), "dataset", "user").select("id", "dataset")


@query(f"WITH {SQL} SELECT dataset FROM clips INTERSECT SELECT dataset FROM datasets")
def known_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3."""
    return derived.clips(spark, sf_dir).select("dataset").intersect(derived.datasets(spark).select("dataset"))


@query("SELECT o_custkey AS custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return compare.duplicate_keys(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey"), "custkey")


@query("""WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
(SELECT k, 'customer' AS side FROM a EXCEPT SELECT k, 'customer' FROM b) UNION ALL (SELECT k, 'orders' FROM b EXCEPT SELECT k, 'orders' FROM a)""")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only one of two relations has."""
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return a.subtract(b).withColumn("side", F.lit("customer")).union(b.subtract(a).withColumn("side", F.lit("orders")))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session outcomes made of all events: a row per event, a model per user group."""
    e = table(spark, sf_dir, "events")
    crashed = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("m"), F.col("user_id") % 5).alias("model"), F.col("event_id").alias("attempt"), F.when(crashed, "crashed").otherwise("ok").alias("status"), F.concat(F.lit("c"), F.col("user_id")).alias("id"),
        F.when(crashed, 0).otherwise(F.floor("value").cast("int") % 3).alias("new_results"), (F.col("event_id") % 4).cast("int").alias("cached_before"), (F.col("event_id") % 6).cast("int").alias("cached_after"),
        F.when(F.col("value") > 5, F.col("value")).alias("load_ms"), (F.col("event_id") % 2 == 0).alias("downloaded"),
    )


_SESSIONS = """s AS (SELECT 'm' || (user_id % 5) AS model, event_id AS attempt, CASE WHEN event_type = 'error' THEN 'crashed' ELSE 'ok' END AS status, 'c' || user_id AS id,
CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS INT) % 3 END AS new_results, CAST(event_id % 4 AS INT) AS cached_before, CAST(event_id % 6 AS INT) AS cached_after, CASE WHEN value > 5 THEN value END AS load_ms, event_id % 2 = 0 AS downloaded FROM events)"""


@query(f"WITH {_SESSIONS} SELECT model, id, count(*) AS crashes FROM s WHERE status = 'crashed' GROUP BY model, id HAVING count(*) >= 2")
def crash_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6."""
    return sessions.crash_failures(_sessions(spark, sf_dir))


@query(f"""WITH {_SESSIONS}, i AS (SELECT *, sum(CASE WHEN new_results > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY attempt) AS isle FROM s),
c AS (SELECT *, sum(CASE WHEN new_results > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY model, isle ORDER BY attempt) AS streak FROM i) SELECT model, min(attempt) AS attempt FROM c WHERE streak > 2 GROUP BY model""")
def gave_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7."""
    return sessions.gave_up(_sessions(spark, sf_dir))


@query(f"WITH {_SESSIONS}, e AS (SELECT model, arg_min(cached_before, attempt) AS b, arg_max(cached_after, attempt) AS a FROM s GROUP BY model) SELECT model, CASE WHEN a = 0 THEN NULL ELSE a > b END AS downloaded FROM e")
def prefetch_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, C6."""
    return sessions.prefetch_download(_sessions(spark, sf_dir))


@query(f"WITH {_SESSIONS} SELECT attempt, CASE WHEN cached_after = 0 THEN 'unknown' WHEN cached_after > cached_before THEN 'yes' ELSE 'no' END AS downloaded FROM s")
def download_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6, C7."""
    flag = nested.download_flag(F.col("cached_before"), F.col("cached_after"))
    return _sessions(spark, sf_dir).select("attempt", nested.tri_state(flag, "yes", "no", "unknown").alias("downloaded"))


@query(f"WITH {_SESSIONS}, f AS (SELECT model, min(attempt) AS attempt FROM s WHERE load_ms IS NOT NULL GROUP BY model) SELECT s.model, load_ms AS first_load_ms, downloaded AS first_load_downloaded FROM s JOIN f ON f.model = s.model AND f.attempt = s.attempt")
def first_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9."""
    return sessions.first_load(_sessions(spark, sf_dir))


@query(f"""WITH {SQL} SELECT 'm0' AS model, c.id, dataset, duration_s, '' AS hypothesis, CAST(row * 10 AS DOUBLE) AS infer_ms, 'timeout: ' || CAST(round(row / CAST(100 AS DOUBLE)) AS BIGINT) || ' s' AS error
FROM clips c WHERE c.id NOT IN (SELECT id FROM results WHERE model = 'm0' AND error IS NULL)""")
def stuck_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, X5."""
    items = derived.clips(spark, sf_dir)
    stalls = items.select(F.lit("m0").alias("model"), "id", (F.col("row") * 10).cast("double").alias("stalled_ms"))
    done = derived.results(spark, sf_dir).filter("error IS NULL")
    return sessions.stuck_rows(stalls, items, done).select("model", "id", "dataset", "duration_s", "hypothesis", "infer_ms", "error")


_STEPS = {"view": "model-ready", "signup": "warmed", "click": "result", "purchase": "finished", "error": "error"}
_EVENTS = f"""m AS (SELECT 'm' || user_id AS model, event_id AS seq, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STEPS.items())} END AS type, CAST(event_id AS VARCHAR) AS text, 'c' || (event_id % 3) AS id FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runner events made of all events, a model per user."""
    e = table(spark, sf_dir, "events")
    step = F.create_map(*[F.lit(x) for pair in _STEPS.items() for x in pair])[F.col("event_type")]
    return e.select(F.concat(F.lit("m"), "user_id").alias("model"), F.col("event_id").alias("seq"), step.alias("type"), F.col("event_id").cast("string").alias("text"), F.concat(F.lit("c"), F.col("event_id") % 3).alias("id"))


@query(f"""WITH {_EVENTS}, g AS (SELECT model, min(seq) FILTER (type = 'error') AS bad, arg_max(type, seq) AS last FROM m GROUP BY model)
SELECT model, CASE WHEN bad IS NOT NULL THEN 'error' WHEN last = 'model-ready' THEN 'warming' WHEN last IN ('warmed', 'result') THEN 'running' WHEN last = 'finished' THEN 'done' ELSE 'loading' END AS phase, CAST(bad AS VARCHAR) AS reason FROM g""")
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10."""
    return sessions.phases(_events(spark, sf_dir))


@query(f"""WITH {_EVENTS}, lost AS (SELECT model, min(seq) AS lost FROM m WHERE type = 'error' GROUP BY model), items AS (SELECT DISTINCT model, id FROM m)
SELECT i.model, i.id, CAST(lost AS VARCHAR) AS reason FROM items i JOIN lost l ON l.model = i.model WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.model = i.model AND m.id = i.id AND m.type = 'result' AND m.seq < l.lost)""")
def fail_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that are open when a worker is lost."""
    events = _events(spark, sf_dir)
    return sessions.fail_all(events, events.select("model", "id").distinct())


@query("""WITH s AS (SELECT 'm' || (user_id % 50) AS run_id, event_id AS attempt, CASE WHEN event_type <> 'error' THEN event_type END AS browser FROM events)
SELECT run_id, list(browser ORDER BY attempt)[1] AS browser, array_to_string(list(browser ORDER BY attempt)[2:], ',') AS resumed FROM s WHERE browser IS NOT NULL GROUP BY run_id""")
def browsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9."""
    e = table(spark, sf_dir, "events")
    attempts = e.select(F.concat(F.lit("m"), F.col("user_id") % 50).alias("run_id"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("browser"))
    return sessions.browsers(attempts).select("run_id", "browser", F.array_join("resumed", ",").alias("resumed"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_orderkey ELSE '' || o_custkey END AS run, CASE WHEN o_orderkey % 3 = 0 THEN '' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'a=b' ELSE '' END AS model FROM orders""")
def named_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the order's customer by place, or its key by name in the other's place."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    second = F.when(k % 3 == 0, F.concat(F.lit("run=x"), k.cast("string"))).when(k % 3 == 1, "a=b").otherwise("")
    first = F.when(k % 3 == 0, F.concat(F.lit("model="), c)).otherwise(c)
    found = nested.reassigned(F.array(first, second), ["run", "model"])
    return table(spark, sf_dir, "orders").select("o_orderkey", found["run"].alias("run"), found["model"].alias("model"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def token_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, X8."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "text")
    return sessions.token_text(turns, "conv_id")


@query("""WITH d AS (SELECT doc_id, n_chars, unnest(range(0, n_chars, 3000)) AS s FROM documents WHERE n_chars > 0)
SELECT doc_id, s / CAST(100 AS DOUBLE) AS start_sec, least(s + 3000, n_chars) / CAST(100 AS DOUBLE) AS end_sec FROM d WHERE least(s + 3000, n_chars) - s >= 10""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as signals of n_chars samples at 100 a second."""
    cut = table(spark, sf_dir, "documents").select("doc_id", F.explode(nested.segments(F.col("n_chars"), 100.0)).alias("s"))
    return cut.select("doc_id", "s.start_sec", "s.end_sec")


@query("SELECT vec_id, CAST(i AS INT) AS i, (CAST(embedding[i + 1] AS DOUBLE) + CAST(embedding[i + 1 + len(embedding) // 2] AS DOUBLE)) / 2 AS mono FROM (SELECT *, unnest(range(len(embedding) // 2)) AS i FROM embeddings)")
def downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The halves of a vector as two channels."""
    v = F.col("embedding").cast("array<double>")
    half = F.floor(F.size(v) / 2).cast("int")
    mixed = nested.downmix(F.array(F.slice(v, F.lit(1), half), F.slice(v, half + 1, half)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(mixed).alias("i", "mono"))


@query("SELECT vec_id, CAST(i AS INT) AS i, CAST(greatest(CAST(-1 AS FLOAT), least(CAST(1 AS FLOAT), CAST(embedding[i + 1] * CAST(4 AS FLOAT) AS FLOAT))) AS DOUBLE) AS v FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)")
def clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9."""
    louder = F.transform("embedding", lambda x: (x * F.lit(4.0).cast("float")).cast("float"))
    held = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(numbers.clamp(louder)).alias("i", "v"))
    return held.withColumn("v", F.col("v").cast("double"))


@query(r"""WITH p AS (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || CASE page_id % 4 WHEN 0 THEN 'lang=de' WHEN 1 THEN 'x=1&lang=fr&page=7' WHEN 2 THEN 'xlang=es' ELSE 'n=1' END AS u FROM pages)
SELECT page_id, regexp_extract(split_part(u, '#', 1), '[?&]page=([^&]*)', 1) AS page, coalesce(nullif(regexp_extract(split_part(u, '#', 1), '[?&]lang=([^&]*)', 1), ''), 'en') AS lang FROM p""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every page's address, with more parameters."""
    more = F.when(F.col("page_id") % 4 == 0, "lang=de").when(F.col("page_id") % 4 == 1, "x=1&lang=fr&page=7").when(F.col("page_id") % 4 == 2, "xlang=es").otherwise("n=1")
    url = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), more)
    return table(spark, sf_dir, "pages").select("page_id", text.url_parameter(url, "page", "").alias("page"), text.url_parameter(url, "lang", "en").alias("lang"))


@query("SELECT page_id, 'https://x.example/eval?model=m+%26+n&offset=' || page_id || CASE WHEN page_id % 2 = 0 THEN '&limit=' || (page_id % 3) ELSE '' END AS url FROM pages")
def url_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16."""
    limit = F.when(F.col("page_id") % 2 == 0, F.col("page_id") % 3)
    return table(spark, sf_dir, "pages").select("page_id", text.eval_url("https://x.example/eval", model=F.lit("m & n"), offset=F.col("page_id"), limit=limit).alias("url"))


@query("SELECT page_id, CAST(len(list_filter([url, url || '/resolve', html], lambda u: contains(u, '/en/'))) AS INT) AS n, '/' || page_id || '/resolve/refs%2Fpr%2F1/' AS part FROM pages")
def cached_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, F18."""
    urls = F.array(F.array("url", F.concat("url", F.lit("/resolve"))), F.array("html"))
    part = text.model_key_part(F.col("page_id").cast("string"), F.lit("refs/pr/1"))
    return table(spark, sf_dir, "pages").select("page_id", nested.cached_files(urls, F.lit("/en/")).alias("n"), part.alias("part"))


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{derived._WS}', '', 'g')) AS digest FROM documents")
def ws_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.strip_whitespace(F.col("text")), 256).alias("digest"))


@query(f"""SELECT doc_id, CASE WHEN length(one) <= 80 THEN one ELSE left(one, 79) || '…' END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '{derived._WS}+', ' ', 'g')) AS one FROM documents)""")
def short_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9."""
    return table(spark, sf_dir, "documents").select("doc_id", text.short_text(F.col("text")).alias("short"))


@query("SELECT doc_id, sha256(replace(text, '|', '\\|')) AS cell FROM documents")
def escape_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.escape_cell(F.col("text")), 256).alias("cell"))


@query("SELECT p_partkey, lower(left(x, 1) || regexp_replace(substr(x, 2), '([A-Z])', '_\\1', 'g')) AS name FROM (SELECT p_partkey, replace(p_type, 'O', 'o') || p_brand AS x FROM part)")
def snake_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1."""
    name = F.concat(F.replace("p_type", F.lit("O"), F.lit("o")), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", text.snake_case(name).alias("name"))


@query("SELECT doc_id, printf('%s-%06d', lang, doc_id) AS id, sha256(lang || ':' || doc_id) AS key FROM documents")
def item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, P8."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.item_id(F.col("lang"), F.col("doc_id")).alias("id"), planning.sampling_key(F.col("lang"), F.col("doc_id")).alias("key"))


@query("SELECT n_nationkey, nullif(array_to_string(list_filter([n_name, CASE WHEN n_regionkey = 1 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END, NULL], lambda x: x IS NOT NULL AND x <> ''), ' / '), '') AS parts FROM nation")
def join_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, C5, V6."""
    parts = F.array("n_name", F.when(F.col("n_regionkey") == 1, "").otherwise(F.col("n_regionkey").cast("string")), F.lit(None).cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.join_parts(parts).alias("parts"))


@query("SELECT doc_id, left(sha256(text), 7) AS short FROM documents")
def short_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hashes of 40 digits."""
    return table(spark, sf_dir, "documents").select("doc_id", text.short_commit(F.substring(F.sha2("text", 256), 1, 40)).alias("short"))


@query("SELECT o_orderkey, round(o_totalprice / 7, 6) AS rounded, round(o_totalprice / 1000, 3) AS sec, format('{:,}', CAST(floor(o_totalprice + 0.5) AS BIGINT)) AS count, printf('%02d:%02d', CAST(floor(o_totalprice + 0.5) AS BIGINT) // 60, CAST(floor(o_totalprice + 0.5) AS BIGINT) % 60) AS clock FROM orders")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, M6, M8."""
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.rounded(p / 7).alias("rounded"), numbers.seconds(p).alias("sec"), numbers.count_text(p).alias("count"), numbers.clock(p).alias("clock"))


@query("SELECT l_orderkey, l_linenumber, printf('%.1f', l_discount * 100 / 7) || '%' AS shown, CAST(printf('%.3f', l_tax / 7) AS DOUBLE) AS key FROM lineitem")
def percent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, M5."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.page_percent(F.col("l_discount") / 7).alias("shown"), numbers.as_shown(F.col("l_tax") / 7, 3).alias("key"))


@query("""WITH c AS (SELECT c_custkey, c_acctbal AS v, pow(10.0, floor(log10(c_acctbal / 4))) AS p FROM customer WHERE c_acctbal > 0),
s AS (SELECT *, p * CASE WHEN v / 4 / p <= 1 THEN 1 WHEN v / 4 / p <= 2 THEN 2 WHEN v / 4 / p <= 5 THEN 5 ELSE 10 END AS step FROM c)
SELECT c_custkey, round(ceil(v / step - 1e-9) * step, 6) AS top, CAST(ceil(v / step - 1e-9) + 1 AS INT) AS ticks FROM s UNION ALL SELECT c_custkey, 1.0, 2 FROM customer WHERE NOT c_acctbal > 0""")
def nice_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7, W6."""
    axis = numbers.nice_axis(F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(axis["max"], 6).alias("top"), F.size(axis["ticks"]).alias("ticks"))


_RUNS = "strftime(ts, '%Y%m%dT%H%M%S') || CASE WHEN event_type = 'error' THEN '' ELSE 'Z' END"


@query(f"SELECT max(r) AS run_id, '20240101T000000Z' >= max(r) AS newest FROM (SELECT {_RUNS} AS r FROM events) WHERE regexp_full_match(r, '[0-9]{{8}}T[0-9]{{6}}Z')")
def run_id_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, S11, S12."""
    stamp = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyyMMdd'T'HHmmss")
    runs = table(spark, sf_dir, "events").select(F.concat(stamp, F.when(F.col("event_type") == "error", "").otherwise("Z")).alias("run_id"))
    return sources.latest_run(runs).select("run_id", (F.lit("20240101T000000Z") >= F.col("run_id")).alias("newest"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS n FROM part")
def parse_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13."""
    raw = F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_count(raw).alias("n"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'second' ELSE 'first' END AS version FROM orders")
def first_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14."""
    brand = lambda name, version: F.struct(name.alias("brand"), F.lit(version).alias("version"))
    brands = F.array(brand(F.when(F.col("o_orderpriority") == "1-URGENT", "Other").otherwise("Chrome"), "first"), brand(F.lit("Chromium"), "second"))
    return table(spark, sf_dir, "orders").select("o_orderkey", nested.first_version(brands, ("Chrome", "Chromium")).alias("version"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'de' END, 'ja') ELSE coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'fr' END, 'ja') END AS value,
o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 AS mismatch FROM orders""")
def resolve_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8."""
    k = F.col("o_orderkey")
    made = nested.resolved(F.when(k % 3 == 0, "de"), F.when(k % 5 == 0, "fr"), F.lit("ja"), k % 2 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", made["value"].alias("value"), made["mismatch"].alias("mismatch"))


@query("""WITH l(place, line) AS (VALUES (0, 'Transcribe the following speech segment in {s} into {s} text.'), (1, ''), (2, 'Follow these specific instructions for formatting the answer:'), (3, '* Only output the transcription, with no newlines.'),
(4, '* When transcribing numbers, write the digits, i.e. write 1.7 and not one point seven, and write 3 instead of three.')) SELECT DISTINCT c_mktsegment AS segment, place, replace(line, '{s}', c_mktsegment) AS line FROM customer CROSS JOIN l""")
def prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all lines."""
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    return segments.select("segment", F.posexplode(F.split(text.prompt(F.col("segment")), "\n")).alias("place", "line"))


_KANA = {"a": "ぁ", "e": "え", "i": "い", "n": "ん", "o": "お", "r": "る", "s": "す", "t": "ゖ"}


@query(r"""WITH f AS (SELECT c_custkey, ordinal, label, CASE WHEN fam = '' THEN label ELSE fam END AS fam, CASE WHEN sh = '' THEN fam ELSE sh END AS sh
  FROM (SELECT *, trim(regexp_replace(fam, '\s*[（(][^）)]*[）)]\s*$', '')) AS sh FROM (SELECT *, trim(regexp_replace(label, '(?i)^Customer\s+', '')) AS fam FROM (
    SELECT c_custkey, CAST(c_custkey % 6 AS INT) AS ordinal, CASE WHEN c_custkey % 3 = 0 THEN 'Customer ' ELSE '' END || c_mktsegment || ' ' || (c_custkey // 2) || CASE WHEN c_custkey % 2 = 0 THEN '（' || c_nationkey || '）' ELSE '' END AS label FROM customer)))),
c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY sh) = 1 THEN sh WHEN count(*) OVER (PARTITION BY fam) = 1 THEN fam ELSE label END AS chosen FROM f),
d AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY chosen) > 1 THEN label ELSE chosen END AS short FROM c)
SELECT c_custkey, short, CASE WHEN ordinal < 4 THEN ordinal + 1 END AS slot, short || CASE WHEN regexp_matches(short, '[A-Za-z0-9)\]]$') THEN ' ' ELSE '' END || 'が' AS subject,
  translate(left(label, 12), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ０１２３４５６７８９') AS wide,
  translate(lower(label), 'aeinorst', 'ァエインオルスヶ') AS kana FROM d""")
def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all customers, of which some meet once they are shortened."""
    k = F.col("c_custkey")
    note = F.when(k % 2 == 0, F.concat(F.lit("（"), F.col("c_nationkey").cast("string"), F.lit("）"))).otherwise("")
    label = F.concat(F.when(k % 3 == 0, "Customer ").otherwise(""), "c_mktsegment", F.lit(" "), F.floor(k / 2).cast("long").cast("string"), note)
    models = table(spark, sf_dir, "customer").select("c_custkey", k.cast("string").alias("model"), (k % 6).cast("int").alias("ordinal"), label.alias("label"))
    named = compare.series_slot(compare.short_labels(models, "Customer"), models.select("model", "ordinal"))
    kana = text.hiragana_to_katakana(F.translate(F.lower("label"), "".join(_KANA), "".join(_KANA.values())))
    return named.select("c_custkey", "short", "slot", text.said_of(F.col("short"), "が").alias("subject"), text.fullwidth_upper(F.left("label", F.lit(12))).alias("wide"), kana.alias("kana"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN NULL ELSE role END AS role, CASE WHEN conv_id % 4 = 0 AND turn % 3 = 2 THEN '' ELSE text END AS text,
  CASE WHEN conv_id % 5 = 0 AND turn % 2 = 0 THEN -1 - turn ELSE turn END AS number, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
e AS (SELECT conv_id, i, 0 AS k, 'turns[' || i || '].turn: whole number required' AS x FROM t WHERE number < 0
  UNION ALL SELECT conv_id, i, 1, 'turns[' || i || '].role: string required' FROM t WHERE role IS NULL OR role = ''
  UNION ALL SELECT conv_id, i, 2, 'turns[' || i || '].text: string required' FROM t WHERE text IS NULL OR text = ''
  UNION ALL SELECT DISTINCT conv_id, -1, 0, 'title: string required' FROM t WHERE conv_id % 6 = 0
  UNION ALL SELECT DISTINCT conv_id, 1000000, 0, 'counts.user: number or null' FROM t WHERE conv_id % 7 = 0)
SELECT t.conv_id, coalesce(string_agg(x, ', ' ORDER BY e.i, k), '') AS faults FROM (SELECT DISTINCT conv_id FROM t) t LEFT JOIN e USING (conv_id) GROUP BY t.conv_id""")
def document_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a document with planted faults, checked against a declared schema."""
    c, n = F.col("conv_id"), F.col("turn")
    role = F.when(~((c % 3 == 0) & (n == 1)), F.col("role"))
    said = F.when((c % 4 == 0) & (n % 3 == 2), "").otherwise(F.col("text"))
    turn = F.struct(n.alias("place"), F.when((c % 5 == 0) & (n % 2 == 0), -1 - n).otherwise(n).alias("turn"), role.alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # a document is a row by nature
    counts = F.create_map(F.lit("user"), F.when(c % 7 == 0, "many").otherwise("2"))
    text_ = F.to_json(F.struct(F.when(c % 6 != 0, "t").alias("title"), "turns", counts.alias("counts")))
    document = F.regexp_replace(text_, '"user":"2"', '"user":2')
    declared = T.StructType.fromDDL("title string NOT NULL, turns array<struct<turn:bigint NOT NULL,role:string NOT NULL,text:string NOT NULL,note:string>> NOT NULL, counts map<string,double>")
    return turns.select("conv_id", F.array_join(contract.schema_faults(document, declared), ", ").alias("faults"))


@query("""SELECT row_number() OVER (ORDER BY o_orderkey % 2, o_orderkey) - 1 AS row, o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders""")
def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders written as two shards, the even keys first, and read under one row number."""
    folder, rows = sources.shared_folder(spark), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double"), "o_orderdate")
    for k in (0, 1):
        shard = rows.filter(F.col("o_orderkey") % 2 == k).repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
        shard.write.parquet(f"{folder}/data/train-0000{k}.parquet")
    return tables.sharded(spark, folder, "train", "o_orderkey", "o_totalprice")


@query("""WITH r AS (SELECT strftime(make_timestamp(2026, 1 + CAST(event_id % 12 AS INT), 1 + CAST(event_id % 28 AS INT), CAST(event_id % 24 AS INT), 0, 0.0), '%Y%m%dT%H%M%SZ') AS run_id FROM events)
SELECT max(run_id) AS run_id, CAST(count(*) AS BIGINT) AS n FROM r WHERE run_id = (SELECT max(run_id) FROM r)""")
def published_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs are published, the newer first, and the latest document is read."""
    at = F.make_timestamp_ntz(F.lit(2026), (1 + F.col("event_id") % 12).cast("int"), (1 + F.col("event_id") % 28).cast("int"), (F.col("event_id") % 24).cast("int"), F.lit(0), F.lit(0))
    runs = table(spark, sf_dir, "events").groupBy(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'").alias("run_id")).agg(F.count("*").alias("n"))
    folder = sources.shared_folder(spark)
    ends = runs.agg(F.max_by(F.struct("run_id", "n"), "run_id").alias("new"), F.min_by(F.struct("run_id", "n"), "run_id").alias("old")).first()
    for run in (ends["new"], ends["old"]):
        sources.publish_run(spark, folder, run["run_id"], json.dumps(run.asDict()))
    return sources.read_published(spark, folder).select("run_id", F.get_json_object("document", "$.n").cast("long").alias("n"))
