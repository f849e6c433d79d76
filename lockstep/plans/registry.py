"""All queries of the engine by name, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, verdicts
from ..operators import dedup, margins, nulls, pairs, residual, responses, statistics, studies, windows
from ..sources import ingest, results
from ..sources.storage import new_path, stored
from ..sources.views import SQL as VIEW
from ..sources.views import VIEWS, read, resp
from ..streaming import incremental, maintained
from . import report

QUERIES: dict = {}
SQL: dict[str, str] = {}

MARGINS = "im AS (SELECT item, CAST(sum(f) AS BIGINT) AS c FROM o GROUP BY item), em AS (SELECT entity, CAST(sum(f) AS BIGINT) AS r FROM o GROUP BY entity)"
TOTALS = (
    MARGINS + ", t AS (SELECT * FROM (SELECT CAST(count(*) AS DOUBLE) AS m, CAST(sum(c) AS DOUBLE) AS sc, CAST(sum(c * c) AS DOUBLE) AS scc FROM im), "
    "(SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(r * r) AS DOUBLE) AS srr FROM em))"
    ", x AS (SELECT *, (scc - sc) / (m * n * (n - 1)) AS mean, (scc - sc) / (m * n * (n - 1)) - (sc * sc - srr) / (m * m * n * (n - 1)) AS excess, "
    "(n * (scc / (m * n * n) - (sc / (m * n)) * (sc / (m * n))) + srr / (n * m * m) - (sc / (m * n)) * (sc / (m * n)) - (sc / (m * n)) * (1 - sc / (m * n))) / (n - 1) AS closed FROM t)"
)
PAIRS = (
    MARGINS + ", g AS (SELECT a.entity AS i, b.entity AS j, count(*) AS g FROM o a JOIN o b ON a.item = b.item AND a.entity < b.entity WHERE a.f = 1 AND b.f = 1 GROUP BY 1, 2)"
    ", p AS (SELECT a.entity AS i, b.entity AS j, coalesce(g.g, 0) AS g, a.r AS ri, b.r AS rj, (SELECT count(*) FROM im) AS m FROM em a JOIN em b ON a.entity < b.entity LEFT JOIN g ON g.i = a.entity AND g.j = b.entity)"
    ", ag AS (SELECT i, j, (m - ri - rj + 2 * g) / m AS agreement FROM p)"
)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def over(view: str, f):
    return lambda spark, sf_dir: f(VIEWS[view](spark, sf_dir))


def on(view: str, name: str, f, sql: str | None = None, parts: str = MARGINS) -> None:
    query(name, None if sql is None else f"WITH o AS ({VIEW[view]}), {parts} {sql}")(over(view, f))


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# Margins -------------------------------------------------------------------------------------------------------------
RECORD = (
    "SELECT CAST(n AS BIGINT) AS n_entities, CAST(m AS BIGINT) AS n_items, round(mean, 10) AS mean_joint, round(excess * 1e6, 4) AS naive_excess_e6, "
    "round(closed * 1e6, 4) AS margin_artifact_e6, abs(excess - closed) < 1e-9 AS closed_form_holds FROM x"
)
on("emb", "joint_failure_record", margins.joint_failure_record, RECORD, TOTALS)
on("evt", "joint_failure_record_evt", margins.joint_failure_record, RECORD, TOTALS)
on("ret", "joint_failure_record_ret", margins.joint_failure_record, RECORD, TOTALS)
on("emb", "margin_decomposition", margins.decomposition, "SELECT round(excess * 1e6, 4) AS naive_e6, round(closed * 1e6, 4) AS explained_e6, abs(excess - closed) < 1e-9 AS all_explained FROM x", TOTALS)
on("ret", "item_margins", margins.item_margins, "SELECT item, c FROM im")
on("evt", "entity_rates", margins.entity_rates, "SELECT entity, r, r / (SELECT count(*) FROM im) AS p FROM em")
TRIM = (
    "e1 AS (SELECT entity FROM o GROUP BY entity HAVING sum(f) > 0 AND sum(f) < (SELECT count(DISTINCT item) FROM o)), o1 AS (SELECT * FROM o WHERE entity IN (SELECT entity FROM e1)), "
    "i1 AS (SELECT item FROM o1 GROUP BY item HAVING sum(f) > 0 AND sum(f) < (SELECT count(DISTINCT entity) FROM o1))"
)
for _view in ("brand", "evt", "ret"):
    on(_view, f"trim_degenerate_{_view}", margins.trim_degenerate, "SELECT entity, item, f FROM o1 WHERE item IN (SELECT item FROM i1)", TRIM)
on("emb", "domain_check", margins.domain_check, "SELECT CAST(sum(k) AS BIGINT) AS n_cells, CAST(sum(bad) AS BIGINT) AS n_not_binary, CAST(sum(CAST(k > 1 AS INTEGER)) AS BIGINT) AS n_repeated FROM cells", "cells AS (SELECT entity, item, count(*) AS k, sum(CAST(f NOT IN (0, 1) OR f IS NULL AS INTEGER)) AS bad FROM o GROUP BY 1, 2)")
on(
    "evt",
    "rowcount_guard",
    margins.rowcount_guard,
    "SELECT entity, n_rows, CASE WHEN n_rows <> mode THEN concat('rowcount:', n_rows, '!=', mode) WHEN binary_ = 0 THEN 'non-binary' ELSE 'kept' END AS status FROM k, (SELECT n_rows AS mode FROM k GROUP BY n_rows ORDER BY count(*) DESC, n_rows LIMIT 1)",
    "k AS (SELECT entity, count(*) AS n_rows, min(CAST(f IN (0, 1) AS INTEGER)) AS binary_ FROM o GROUP BY entity)",
)

# Pairs ---------------------------------------------------------------------------------------------------------------
on("emb", "pair_joint", pairs.joint_counts, "SELECT i, j, g FROM g", PAIRS)
on("ret", "pair_joint_sparse", pairs.sparse_counts, "SELECT i, j, g FROM g", PAIRS)
on("emb", "pair_joint_packed", pairs.packed_counts, "SELECT i, j, g FROM g", PAIRS)
on("emb", "pair_agreement", lambda o: pairs.agreement(o, digits=8), "SELECT i, j, round(agreement, 8) AS agreement FROM ag", PAIRS)
on(
    "emb",
    "agreement_census",
    lambda o: pairs.agreement_census(o, 0.70, 0.60),
    "SELECT count(*) AS n_pairs, round(avg(agreement), 8) AS mean, round(quantile_cont(agreement, 0.99), 8) AS p99, round(max(agreement), 8) AS largest, count(*) FILTER (agreement >= 0.70) AS n_high, count(*) FILTER (agreement >= 0.60) AS n_low FROM ag",
    PAIRS,
)
DISPERSION = "SELECT count(*) AS n_pairs, round(avg(g / m), 10) AS mean, round(var_pop(g / m) * 1e6, 4) AS variance_e6 FROM p"
on("emb", "dispersion", pairs.dispersion, DISPERSION, PAIRS)
on("ret", "dispersion_ret", pairs.dispersion, DISPERSION, PAIRS)
on(
    "emb",
    "variance_inflation",
    pairs.variance_inflation,
    "SELECT n, round(rbar, 8) AS mean_correlation, round(n / (1 + (n - 1) * rbar), 4) AS n_effective FROM (SELECT count(*) AS n FROM em), "
    "(SELECT avg((g * m - ri * rj) / sqrt(CAST(ri * (m - ri) AS DOUBLE) * CAST(rj * (m - rj) AS DOUBLE))) AS rbar FROM p WHERE ri > 0 AND ri < m AND rj > 0 AND rj < m)",
    PAIRS,
)


PAIRS_DRAWN, PAIR_SEED = 20_000, 18
#: The Feistel network on pair numbers, walked back inside, and the ranks of the pair with that number.
_ROUND = "xor({l}, CAST(('0x' || substr(md5(concat_ws('|', '18', '{k}', CAST({r} AS VARCHAR))), 1, 8)) AS BIGINT) & (size - 1))"


def _feistel(x: str) -> str:
    left, right = "s.l", "s.r"
    state = f"{{'l': {x} >> half, 'r': {x} & (size - 1)}}"
    for k in range(pairs.ROUNDS):
        state = f"list_transform([{state}], lambda s: {{'l': s.r, 'r': {_ROUND.format(l=left, r=right, k=k)}}})[1]"
    return f"list_transform([{state}], lambda s: (s.l << half) | s.r)[1]"


DRAWN = (
    ", nn AS (SELECT count(*) AS n, count(*) * (count(*) - 1) // 2 AS pairs FROM em), hh AS (SELECT *, CAST(greatest(1, (length(bin(pairs - 1)) + 1) // 2) AS INTEGER) AS half FROM nn), sz AS (SELECT *, CAST(1 AS BIGINT) << half AS size FROM hh)"
    f", w0 AS (SELECT t, {_feistel('t')} AS p, pairs, half, size FROM range({PAIRS_DRAWN}) q(t), sz WHERE t < pairs), walk AS (SELECT * FROM w0 UNION ALL SELECT t, {_feistel('p')}, pairs, half, size FROM walk WHERE p >= pairs)"
    ", nr AS (SELECT p, CAST(floor((1 + sqrt(1 + 8 * CAST(p AS DOUBLE))) / 2) AS BIGINT) AS j FROM walk WHERE p < pairs), fx AS (SELECT p, CASE WHEN j * (j - 1) // 2 > p THEN j - 1 WHEN (j + 1) * j // 2 <= p THEN j + 1 ELSE j END AS j FROM nr)"
    ", er AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS rank FROM em), drawn AS (SELECT a.entity AS i, b.entity AS j FROM fx JOIN er a ON a.rank = p - fx.j * (fx.j - 1) // 2 JOIN er b ON b.rank = fx.j)"
)
for _name, _f, _sql in (
    ("random_pairs", pairs.random_pairs, "SELECT i, j FROM drawn"),
    ("sampled_dispersion", lambda o, k, seed: pairs.sampled_dispersion(o, pairs.random_pairs(o, k, seed)), "SELECT count(*) AS n_pairs, round(var_pop(g / m) * 1e6, 4) AS variance_e6 FROM p JOIN drawn ON drawn.i = p.i AND drawn.j = p.j"),
):
    query(_name, f"WITH RECURSIVE o AS ({VIEW['emb']}), {PAIRS}{DRAWN} {_sql}")(over("emb", lambda o, f=_f: f(o, PAIRS_DRAWN, PAIR_SEED)))


def _panels(o: DataFrame) -> DataFrame:
    return o.select("entity").distinct().select((F.col("entity") % 25).alias("panel"), "entity")


on(
    "emb",
    "panel_double_fault",
    lambda o: pairs.double_fault(o, _panels(o)),
    "SELECT i % 25 AS panel, count(*) AS n_pairs, round(avg(g / m), 8) AS double_fault, round(avg((ri + rj - 2 * g) / m), 8) AS disagreement FROM p WHERE i % 25 = j % 25 GROUP BY 1",
    PAIRS,
)
on(
    "emb",
    "pair_submatrix",
    lambda o: pairs.submatrix(pairs.joint_counts(o), responses.top_panel(o, 100)),
    "SELECT i, j, g.g FROM g JOIN top a ON a.entity = i JOIN top b ON b.entity = j",
    PAIRS + ", top AS (SELECT entity FROM em ORDER BY r, entity LIMIT 100)",
)

# Ranks, windows, runs ------------------------------------------------------------------------------------------------
RANKED = ", rk AS (SELECT entity, r, row_number() OVER (ORDER BY r, entity) AS rank FROM em)"
on("emb", "accuracy_rank", windows.by_accuracy, "SELECT entity, r, rank FROM rk", MARGINS + RANKED)
query(
    "rank_spearman",
    f"WITH o AS ({VIEW['evt']}), {MARGINS}, v AS (SELECT user_id AS entity, count(*) AS k FROM events GROUP BY 1), b AS (SELECT row_number() OVER (ORDER BY r, entity) AS rx, row_number() OVER (ORDER BY k, entity) AS ry FROM em JOIN v USING (entity)) "
    "SELECT count(*) AS n, round(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 8) AS spearman FROM b",
)(lambda s, d: windows.spearman(margins.entity_margins(VIEWS["evt"](s, d)).join(read(s, d, "events").groupBy(F.col("user_id").alias("entity")).agg(F.count(F.lit(1)).alias("k")), "entity"), "r", "k", "entity"))
PROFILE = (
    PAIRS + RANKED + ", sz AS (SELECT count(*) AS n, greatest(CAST(floor(count(*) * 0.10) AS BIGINT), 10) AS w FROM em), sp AS (SELECT k AS \"window\", k * (n - w) // 24 + 1 AS start, w AS width FROM sz, range(25) q(k))"
    ", prof AS (SELECT c.\"window\", c.start, round(c.accuracy, 8) AS centre_accuracy, round(a.agreement, 8) AS mean_agreement FROM "
    "(SELECT sp.\"window\", sp.start, avg(1 - rk.r / (SELECT count(*) FROM im)) AS accuracy FROM sp JOIN rk ON rk.rank >= sp.start AND rk.rank < sp.start + sp.width GROUP BY 1, 2) c JOIN "
    "(SELECT sp.\"window\", avg(ag.agreement) AS agreement FROM ag JOIN rk a ON a.entity = ag.i JOIN rk b ON b.entity = ag.j JOIN sp ON least(a.rank, b.rank) >= sp.start AND greatest(a.rank, b.rank) < sp.start + sp.width GROUP BY 1) a ON a.\"window\" = c.\"window\")"
)
on("emb", "rank_window_profile", windows.window_profile, 'SELECT CAST("window" AS INTEGER) AS "window", CAST(start AS INTEGER) AS start, centre_accuracy, mean_agreement FROM prof', PROFILE)
on(
    "emb",
    "rank_window_summary",
    lambda o: windows.profile_summary(windows.window_profile(o)),
    'SELECT a."top", b.median, round(a."top" / b.median, 6) AS top_over_median FROM (SELECT mean_agreement AS "top" FROM prof WHERE "window" = 0) a, (SELECT round(median(mean_agreement), 8) AS median FROM prof) b',
    PROFILE,
)
RUNS = "runs AS (SELECT CAST(ts AS DATE) AS day, event_type AS bench, count(DISTINCT user_id) AS n_models FROM events GROUP BY 1, 2)"
query("runs_delta", f"WITH {RUNS} SELECT strftime(day, '%Y-%m-%d') AS day, bench, n_models, n_models - lag(n_models, 1, 0) OVER (PARTITION BY bench ORDER BY day) AS delta FROM runs")(lambda s, d: _day(windows.delta_vs_previous(windows.runs_by_day(read(s, d, "events")))))
query("runs_last", f"WITH {RUNS} SELECT bench, arg_max(n_models, day) AS n_models FROM runs GROUP BY bench")(lambda s, d: windows.last_value(windows.runs_by_day(read(s, d, "events"))))
query(
    "runs_autocorrelation",
    "WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1), c AS (SELECT day, x - (SELECT avg(x) FROM d) AS d FROM d) SELECT round(sum(d * e) / sum(d * d), 8) AS lag1 FROM (SELECT d, lead(d) OVER (ORDER BY day) AS e FROM c)",
)(lambda s, d: windows.autocorrelation(read(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("x")), "day", "x"))

# Responses -----------------------------------------------------------------------------------------------------------
RESP = f"r AS ({VIEW['resp']})"
GOLD = RESP + (
    ", rg AS (SELECT item, choice, count(*) AS k FROM r WHERE acc = 1 AND choice >= 0 GROUP BY 1, 2), gold AS (SELECT i.item, coalesce(b.gold, -1) AS gold, round(b.top / b.n, 8) AS agreement FROM (SELECT DISTINCT item FROM r) i LEFT JOIN "
    "(SELECT item, max(k) AS top, sum(k) AS n, arg_max(choice, (k, -choice)) AS gold FROM rg GROUP BY item) b ON b.item = i.item)"
)
WRONG = RESP + ", w AS (SELECT item, choice, count(*) AS k FROM r WHERE acc = 0 AND choice >= 0 GROUP BY 1, 2), q AS (SELECT item, CAST(sum(k) AS BIGINT) AS n_wrong, CASE WHEN sum(k) >= 2 THEN round(sum(k * k) / (sum(k) * sum(k)), 8) END AS q2 FROM w GROUP BY item)"
query("recover_gold", f"WITH {GOLD} SELECT item, gold, agreement FROM gold")(lambda s, d: responses.recover_gold(resp(s, d)))
query("validate_gold", f"WITH {GOLD} SELECT count(*) AS n, round(avg(CAST((choice = gold) = (acc = 1) AS INTEGER)), 8) AS reproduced FROM r JOIN gold USING (item) WHERE choice >= 0 AND gold >= 0")(
    lambda s, d: responses.validate_gold(resp(s, d), responses.recover_gold(resp(s, d)))
)
query("wrong_concentration", f"WITH {WRONG} SELECT item, n_wrong, q2 FROM q")(lambda s, d: responses.concentration(resp(s, d)))
query("global_agreement", f"WITH {WRONG}, s AS (SELECT item, sum(k) AS n, sum(k * (k - 1)) AS same FROM w GROUP BY item) SELECT CAST(sum(same) AS BIGINT) AS same, CAST(sum(n * (n - 1)) AS BIGINT) AS pairs, round(sum(same) / sum(n * (n - 1)), 8) AS agreement FROM s")(
    lambda s, d: responses.global_agreement(resp(s, d))
)
query(
    "pair_wrong_agreement",
    f"WITH {WRONG} SELECT a.entity AS i, b.entity AS j, count(*) AS n, round(avg(CAST(a.choice = b.choice AS INTEGER)), 6) AS observed, floor(CAST(sum(CAST(round(q2 * 1e8) AS BIGINT)) AS DOUBLE) / count(*)) / 1e8 AS expected FROM r a JOIN r b ON b.item = a.item AND b.entity > a.entity JOIN q ON q.item = a.item "
    "WHERE a.acc = 0 AND b.acc = 0 AND a.choice >= 0 AND b.choice >= 0 AND q2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10",
)(lambda s, d: responses.pair_agreement(resp(s, d), None, 10))
PANELS = ", pn AS (SELECT panel, entity FROM (SELECT panel, entity, row_number() OVER (PARTITION BY panel ORDER BY md5(concat_ws('|', '5', panel, entity))) AS k FROM (SELECT DISTINCT entity FROM r), (SELECT range AS panel FROM range(20))) WHERE k <= 7)"
query("hashed_panels", f"WITH {RESP}{PANELS} SELECT panel, entity FROM pn")(lambda s, d: responses.hashed_panels(resp(s, d), 20, 7, 5))
query(
    "majority_vote",
    f"WITH {GOLD}{PANELS}, v AS (SELECT panel, item, choice, count(*) AS k FROM pn JOIN r USING (entity) WHERE choice >= 0 GROUP BY 1, 2, 3), won AS (SELECT panel, item, choice FROM (SELECT *, row_number() OVER (PARTITION BY panel, item ORDER BY k DESC, md5(concat_ws('|', '9', panel, item, choice))) AS z FROM v) WHERE z = 1) "
    "SELECT p.panel, count(*) AS n_items, round(avg(coalesce(CAST(won.choice = g.gold AS INTEGER), 0)), 8) AS accuracy FROM (SELECT DISTINCT panel FROM pn) p CROSS JOIN (SELECT item, gold FROM gold WHERE gold >= 0) g LEFT JOIN won ON won.panel = p.panel AND won.item = g.item GROUP BY 1",
)(lambda s, d: responses.majority_vote(resp(s, d), responses.hashed_panels(resp(s, d), 20, 7, 5), responses.recover_gold(resp(s, d)), 9))
for _mask, _group in ((True, "item, acc"), (False, "item")):
    query(
        f"permute_responses_{'masked' if _mask else 'unmasked'}",
        f"WITH {RESP}, h AS (SELECT *, row_number() OVER (PARTITION BY {_group} ORDER BY entity) AS place FROM r), t AS (SELECT {_group}, choice, row_number() OVER (PARTITION BY {_group} ORDER BY md5(concat_ws('|', '3', entity, item))) AS place FROM r) SELECT entity, item, t.choice, acc FROM h JOIN t USING ({_group}, place)",
    )(lambda s, d, mask=_mask: responses.permute_wrong(resp(s, d), 3, mask))
on("emb", "top_panel", lambda o: responses.top_panel(o, 100), "SELECT entity, r FROM em ORDER BY r, entity LIMIT 100")
on("emb", "item_halves", lambda o: responses.item_halves(o, 4), "SELECT item, ntile(2) OVER (ORDER BY md5(concat_ws('|', '4', item)), item) AS half FROM im")
DIVERSE = PAIRS + ", sim AS (SELECT i AS a, j AS b, agreement FROM ag UNION ALL SELECT j, i, agreement FROM ag), c0 AS (SELECT 0 AS place, CAST(0 AS BIGINT) AS entity)" + "".join(
    f", c{k} AS (SELECT * FROM c{k - 1} UNION ALL SELECT * FROM (SELECT {k} AS place, b AS entity FROM sim WHERE a IN (SELECT entity FROM c{k - 1}) AND b NOT IN (SELECT entity FROM c{k - 1}) GROUP BY b ORDER BY round(avg(agreement), 10), b LIMIT 1))" for k in range(1, 8)
)
on("emb", "greedy_diverse_panel", lambda o: responses.diverse_panel(o, 0, 8), "SELECT place, entity FROM c7", DIVERSE)
on("emb", "greedy_alike_panel", lambda o: responses.diverse_panel(o, 0, 8, -1), "SELECT place, entity FROM c7", DIVERSE.replace("ORDER BY round(avg(agreement), 10), b", "ORDER BY round(avg(agreement), 10) DESC, b"))
on("evt", "min_support", lambda o: margins.min_support(o, 10, 50), "SELECT entity, item, f FROM lo WHERE item IN (SELECT item FROM lo GROUP BY item HAVING count(*) >= 50)", "lo AS (SELECT * FROM o WHERE entity IN (SELECT entity FROM o GROUP BY entity HAVING count(*) >= 10))")
query(
    "response_lengths",
    f"WITH {RESP}, z AS (SELECT entity, count(*) AS n, count(*) FILTER (choice >= CASE WHEN item % 7 = 3 THEN 4 ELSE 5 END) AS bad FROM r GROUP BY 1), x AS (SELECT arg_min(n, entity) AS expected FROM z) "
    "SELECT entity, n, CASE WHEN n <> expected THEN concat('length:', n, '!=', expected) WHEN bad > 0 THEN 'choice-range' END AS reason FROM z, x",
)(lambda s, d: ingest.length_check(resp(s, d).withColumn("nchoice", F.when(F.col("item") % 7 == 3, 4).otherwise(5))))
query("read_correctness", "SELECT user_id AS entity, event_id AS item, value AS correct FROM events")(lambda s, d: ingest.read_correctness(s, f"{d}/events.parquet", "value", "user_id", "event_id"))


def _samples(s: SparkSession, d: str) -> DataFrame:
    """The events of each user as a JSON list of samples, in order; those of every third as the list `samples` of an object."""
    e = read(s, d, "events").select(F.col("user_id").alias("model"), "event_id", F.to_json(F.struct(F.when(F.col("event_type") == "error", "0").otherwise("1").alias("acc"))).alias("j"))
    lists = e.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "j"))), lambda x: x["j"]), ",").alias("j"))
    text = F.concat(F.lit("["), "j", F.lit("]"))
    return lists.select("model", F.when(F.col("model") % 3 == 0, F.concat(F.lit('{"samples":'), text, F.lit("}"))).otherwise(text).alias("json"))


query("sample_correctness", "SELECT user_id AS model, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS item, CAST(event_type <> 'error' AS INTEGER) AS correct FROM events")(lambda s, d: ingest.sample_correctness(_samples(s, d)))

# Text and ingest -----------------------------------------------------------------------------------------------------
KEY = r"substr(md5(lower(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')))), 1, 16)"
query("text_keys", f"SELECT doc_id, {KEY} AS key FROM documents")(lambda s, d: read(s, d, "documents").select("doc_id", scalar.text_key(F.col("text")).alias("key")))
query("item_text_keys", f"SELECT doc_id AS position, {KEY} AS key FROM documents")(lambda s, d: ingest.item_keys(read(s, d, "documents").select(F.col("doc_id").alias("position"), F.col("source").alias("example"), F.col("text").alias("query"))))
query("first_per_key", f"SELECT key, min(doc_id) AS doc_id FROM (SELECT doc_id, {KEY} AS key FROM documents) GROUP BY key")(
    lambda s, d: ingest.first_per_key(read(s, d, "documents").select("doc_id", scalar.text_key(F.col("text")).alias("key")), "key", "doc_id")
)
query(
    "key_overlap",
    f"WITH k AS (SELECT source, {KEY} AS key FROM documents), a AS (SELECT DISTINCT key FROM k WHERE source = 'src0'), b AS (SELECT DISTINCT key FROM k WHERE source <> 'src0'), s AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (key)) AS shared) SELECT n_a, n_b, shared, round(shared / least(n_a, n_b), 8) AS overlap FROM s",
)(lambda s, d: (lambda k: ingest.key_overlap(k.where("source = 'src0'"), k.where("source <> 'src0'")))(read(s, d, "documents").select("source", scalar.text_key(F.col("text")).alias("key"))))
query(
    "row_order_audit",
    f"WITH a AS (SELECT doc_id AS position, {KEY} AS key FROM documents), b AS (SELECT CASE WHEN doc_id % 50 = 7 THEN doc_id + 1 WHEN doc_id % 50 = 8 THEN doc_id - 1 ELSE doc_id END AS position, {KEY} AS key FROM documents), "
    "x AS (SELECT position, a.key IS DISTINCT FROM b.key AS bad FROM a FULL JOIN b USING (position)) SELECT count(*) AS n, count(*) FILTER (bad) AS n_mismatch, array_to_string((SELECT list(position ORDER BY position) FROM (SELECT position FROM x WHERE bad ORDER BY position LIMIT 10)), ',') AS first_mismatches, count(*) FILTER (bad) = 0 AS aligned FROM x",
)(
    lambda s, d: (
        lambda k: ingest.row_order_audit(
            k.withColumnRenamed("doc_id", "position"),
            k.select(F.when(F.col("doc_id") % 50 == 7, F.col("doc_id") + 1).when(F.col("doc_id") % 50 == 8, F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("position"), "key"),
        )
    )(read(s, d, "documents").select("doc_id", scalar.text_key(F.col("text")).alias("key")))
)


def _paths(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    return e.select(F.col("user_id").alias("model"), F.col("event_type").alias("bench"), F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("path"))


PATHS = "paths AS (SELECT user_id AS model, event_type AS bench, concat(strftime(ts, '%Y-%m-%d'), '/', lpad(CAST(event_id AS VARCHAR), 12, '0')) AS path FROM events)"
query("latest_snapshot", f"WITH {PATHS} SELECT model, bench, max(path) AS path FROM paths GROUP BY 1, 2")(lambda s, d: ingest.latest_snapshot(_paths(s, d)))
query("newest_directory", f"WITH {PATHS} SELECT model, bench, path FROM (SELECT *, split_part(path, '/', 1) = max(split_part(path, '/', 1)) OVER (PARTITION BY model, bench) AS newest FROM paths) WHERE newest")(lambda s, d: ingest.newest_directory(_paths(s, d)))
query("manifest_coverage", f"WITH {PATHS} SELECT bench, count(DISTINCT model) AS n_models FROM paths GROUP BY bench")(lambda s, d: ingest.latest_snapshot(_paths(s, d)).groupBy("bench").agg(F.count(F.lit(1)).alias("n_models")))


def _todo(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select(F.col("user_id").alias("model"), "event_type", "value")
    done = e.where("event_type = 'purchase' AND value > 90").select("model").distinct()
    errors = e.where("event_type = 'error' AND value > 90").select("model", F.when(F.col("model") % 2 == 0, "http:429").otherwise("http:404").alias("error")).distinct()
    return ingest.not_yet_read(e.select("model").distinct(), done, errors)


query(
    "not_yet_read",
    "SELECT DISTINCT user_id AS model FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90) AND NOT (user_id % 2 <> 0 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90))",
)(_todo)


def _cards(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as models: even ones name a base in the card, odd ones in a tag, every tenth nothing usable."""
    n = F.col("s_suppkey")
    base = F.concat(F.lit("org"), (n % 5).cast("string"), F.when(n % 10 == 0, F.lit("-")).otherwise(F.lit("/")), F.lit("base"), (n % 7).cast("string"))
    none = F.array().cast("array<string>")
    return read(s, d, "supplier").select(F.col("s_name").alias("model"), F.when(n % 2 == 0, F.array(base)).otherwise(none).alias("card"), F.array(F.lit("tag"), F.concat(F.lit("base_model:finetune:"), base)).alias("tags"))


CARDS = "cards AS (SELECT s_name AS model, concat('org', s_suppkey % 5, CASE WHEN s_suppkey % 10 = 0 THEN '-' ELSE '/' END, 'base', s_suppkey % 7) AS base, CASE WHEN s_suppkey % 2 = 0 THEN 'card' ELSE 'tags' END AS source FROM supplier), lin AS (SELECT model, CASE WHEN contains(base, '/') THEN base END AS parent, source FROM cards)"
query("lineage_parse", f"WITH {CARDS} SELECT model, coalesce(parent, '') AS parents, source FROM lin")(lambda s, d: ingest.parsed_lineage(_cards(s, d)).withColumn("parents", F.array_join("parents", ",")))
query("lineage_gate", f"WITH {CARDS} SELECT count(*) AS n_models, count(parent) AS n_with_parent, round(count(parent) / count(*), 8) AS coverage, count(DISTINCT parent) AS n_parents FROM lin")(
    lambda s, d: ingest.lineage_gate(_cards(s, d).select("model"), ingest.parsed_lineage(_cards(s, d)))
)
query("lineage_sources", f"WITH {CARDS} SELECT coalesce(lin.source, 'none') AS source, count(*) AS n FROM (SELECT replace(c_name, 'Customer', 'Supplier') AS c_name FROM customer) LEFT JOIN lin ON lin.model = c_name GROUP BY 1")(
    lambda s, d: ingest.source_breakdown(read(s, d, "customer").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("model")), ingest.parsed_lineage(_cards(s, d)))
)
query("verdict_coverage", f"WITH {CARDS} SELECT round(count(parent) / count(*), 8) AS coverage, count(parent) / count(*) >= 0.4 AS covered FROM lin")(
    lambda s, d: ingest.lineage_gate(_cards(s, d).select("model"), ingest.parsed_lineage(_cards(s, d))).select("coverage", verdicts.covered(F.col("coverage")).alias("covered"))
)
query("top_parents", f"WITH {CARDS} SELECT parent, count(*) AS n FROM lin WHERE parent IS NOT NULL GROUP BY parent ORDER BY n DESC, parent LIMIT 25")(lambda s, d: ingest.top_parents(ingest.parsed_lineage(_cards(s, d))))
query("lineage_lookup", f"WITH {CARDS} SELECT c_name AS model, coalesce(lin.source, 'none') AS source, coalesce(parent, '') AS parents FROM (SELECT replace(c_name, 'Customer', 'Supplier') AS c_name FROM customer) LEFT JOIN lin ON lin.model = c_name")(
    lambda s, d: ingest.with_lineage(read(s, d, "customer").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("model")), ingest.parsed_lineage(_cards(s, d))).withColumn("parents", F.array_join("parents", ","))
)
NAMES = ["org/details_org__Mixtral-8x7B-moe", "x/details_a__Llama-2-7b__v2", "x/details_b__llama3-slerp", "x/details_c__Yi-34B", "x/details_d__phi-2", "x/details_e__opt-1.3b", "x/details_f__dolphin", "x/none"]


def _names(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "part").select("p_partkey", F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("p_partkey") % len(NAMES) + 1).cast("int")).alias("name"))


NAME_SQL = f"names AS (SELECT p_partkey, ({NAMES!r})[p_partkey % {len(NAMES)} + 1] AS name FROM part)"
query("model_ids", rf"WITH {NAME_SQL} SELECT p_partkey, CASE WHEN regexp_matches(name, '^[^/]*/details_(.*?)__(.*)$') THEN regexp_extract(name, '^[^/]*/details_(.*?)__(.*)$', 1) || '/' || regexp_extract(name, '^[^/]*/details_(.*?)__(.*)$', 2) END AS model FROM names")(
    lambda s, d: _names(s, d).select("p_partkey", scalar.model_of_dataset(F.col("name")).alias("model"))
)
FAMILY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{n}'" for n, p in scalar.FAMILIES) + " ELSE 'unattributed' END"
query("family_census", f"WITH {NAME_SQL} SELECT {FAMILY_SQL} AS family, count(*) AS n, count(*) FILTER (regexp_matches(lower(name), '{scalar.MERGE}')) AS n_merge FROM names GROUP BY 1")(
    lambda s, d: _names(s, d).groupBy(scalar.family(F.col("name")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.count_if(scalar.is_merge(F.col("name"))).alias("n_merge"))
)
query(
    "family_share",
    f"WITH {NAME_SQL}, c AS (SELECT {FAMILY_SQL} AS family, count(*) AS n FROM names GROUP BY 1) SELECT round(sum(n) / (SELECT sum(n) FROM c), 8) AS top5_share FROM (SELECT n FROM c WHERE family <> 'unattributed' ORDER BY n DESC, family LIMIT 5)",
)(
    lambda s, d: (lambda c: c.where("family <> 'unattributed'").orderBy(F.desc("n"), "family").limit(5).agg(F.sum("n").alias("k")).crossJoin(c.agg(F.sum("n").alias("all"))).select(F.round(F.col("k") / F.col("all"), 8).alias("top5_share")))(
        _names(s, d).groupBy(scalar.family(F.col("name")).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    )
)
query("first_days", "SELECT model, strftime(day, '%Y-%m-%d') AS day, rank FROM (SELECT user_id AS model, min(CAST(ts AS DATE)) AS day, row_number() OVER (ORDER BY min(CAST(ts AS DATE)), user_id) AS rank, count(*) OVER () AS n FROM events GROUP BY 1) WHERE rank IN (SELECT CAST(floor(i * n / 10) AS BIGINT) + 1 FROM range(10) t(i))")(
    lambda s, d: _day(ingest.stratified_by_date(read(s, d, "events").groupBy(F.col("user_id").alias("model")).agg(F.min(F.to_date("ts")).alias("day")), 10))
)
query("month_cohorts", "SELECT strftime(o_orderdate, '%Y-%m') AS cohort, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: read(s, d, "orders").groupBy(scalar.month(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("cohort")).agg(F.count(F.lit(1)).alias("n")))
query("json_props", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")(lambda s, d: read(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k")))
query("analytic_floor", "SELECT n_name, round(1 / sqrt(n_nationkey + 5 - 3), 10) AS floor FROM nation")(lambda s, d: read(s, d, "nation").select("n_name", F.round(scalar.analytic_floor(F.col("n_nationkey") + 5), 10).alias("floor")))
query("argmax_choice", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS choice FROM embeddings")(
    lambda s, d: read(s, d, "embeddings").select("vec_id", scalar.first_argmax(F.col("embedding").cast("array<double>"), 4096).alias("choice"))
)

# Statistics ----------------------------------------------------------------------------------------------------------
query("price_slope", "SELECT round(regr_slope(p_retailprice, p_size), 8) AS slope, round(corr(p_retailprice, p_size), 8) AS correlation FROM part")(lambda s, d: statistics.slope(read(s, d, "part"), "p_retailprice", "p_size"))
query(
    "gelman_rubin",
    "WITH c AS (SELECT o_custkey % 4 AS chain, avg(o_totalprice) AS mean, var_samp(o_totalprice) AS w, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT var_samp(mean) AS b, avg(w) AS w, max(n) AS n FROM c) SELECT round(sqrt(((n - 1) / n * w + b) / w), 8) AS r_hat FROM t",
)(lambda s, d: statistics.gelman_rubin(read(s, d, "orders").select((F.col("o_custkey") % 4).alias("chain"), F.col("o_totalprice").alias("x"))))
query("chi_square_hours", "SELECT round(CAST(sum(k * k) AS DOUBLE) * 24 / sum(k) - sum(k), 8) AS chi_square, 23 AS df FROM (SELECT hour(ts), count(*) AS k FROM events GROUP BY 1)")(
    lambda s, d: statistics.chi_square_uniform(read(s, d, "events").groupBy(F.hour("ts")).agg(F.count(F.lit(1)).alias("k")), 24).select("chi_square", "df")
)
query("chi_square_tail")(lambda s, d: statistics.chi_square_uniform(read(s, d, "events").groupBy(F.hour("ts")).agg(F.count(F.lit(1)).alias("k")), 24))
query(
    "bootstrap_mean",
    "WITH u AS (SELECT draw, s_acctbal AS x, CAST(('0x' || substr(md5(concat_ws('|', '2', draw, s_suppkey)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM supplier, (SELECT range AS draw FROM range(20000))), "
    "w AS (SELECT draw, x, " + " + ".join(f"CAST(u >= {statistics_cut} AS INTEGER)" for statistics_cut in statistics.poisson_cuts()) + " AS w FROM u), m AS (SELECT draw, sum(x * w) / sum(w) AS mean FROM w GROUP BY draw) "
    "SELECT round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m",
)(lambda s, d: statistics.bootstrap_mean(read(s, d, "supplier"), "s_suppkey", "s_acctbal", 20000, 2).select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")]))

query(
    "bootstrap_slope",
    "WITH u AS (SELECT draw, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y, CAST(('0x' || substr(md5(concat_ws('|', '6', draw, p_partkey)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM part, (SELECT range AS draw FROM range(400))), "
    "w AS (SELECT draw, x, y, " + " + ".join(f"CAST(u >= {statistics_cut} AS INTEGER)" for statistics_cut in statistics.poisson_cuts()) + " AS w FROM u), "
    "m AS (SELECT (sum(w * x * y) * sum(w) - sum(w * x) * sum(w * y)) / (sum(w * x * x) * sum(w) - sum(w * x) * sum(w * x)) AS slope FROM w GROUP BY draw) "
    "SELECT round(avg(slope), 6) AS slope, round(quantile_cont(slope, 0.025), 6) AS low, round(quantile_cont(slope, 0.975), 6) AS high FROM m",
)(lambda s, d: statistics.bootstrap_slope(read(s, d, "part"), "p_partkey", "p_retailprice", "p_size", 400, 6).select(*[F.round(c, 6).alias(c) for c in ("slope", "low", "high")]))


@query("nested_models")
def _nested(s: SparkSession, d: str) -> DataFrame:
    """R^2 and partial F of panel accuracy on member accuracy, then with double fault, by rank."""
    o = stored(margins.trim_degenerate(VIEWS["emb"](s, d)), "trimmed")  # read several times
    members = _panels(o)
    means = members.join(margins.entity_rates(o), "entity").groupBy("panel").agg((1 - F.avg("p")).alias("accuracy"), F.max("p").alias("worst"))
    panels = stored(pairs.double_fault(o, members).join(means, "panel").select("accuracy", "worst", "double_fault", "disagreement"), "panels")
    df = stored(statistics.zscored(panels, ["worst", "double_fault", "disagreement"]), "zscored")
    m0, m1, m2 = (statistics.ols(df, "accuracy", x) for x in (["worst"], ["worst", "double_fault"], ["worst", "double_fault", "disagreement"]))
    rows = [("M0", m0["r2"], m0["rank"], None, None, None)] + [(n, b["r2"], b["rank"], *statistics.partial_f(a, b)) for n, a, b in (("M1", m0, m1), ("M2", m1, m2))]
    return s.createDataFrame(rows, "model string, r2 double, rank int, partial_f double, q int, p double")


# Null models ---------------------------------------------------------------------------------------------------------
for _name, _key, _other, _f in (("permute_rows", "entity", "item", nulls.permute_rows), ("permute_columns", "item", "entity", nulls.permute_columns)):
    on(
        "emb",
        _name,
        lambda o, f=_f: f(o, 11),
        f"SELECT entity, item, CAST(row_number() OVER (PARTITION BY {_key} ORDER BY md5(concat_ws('|', '11', entity, item)), {_other}) <= s AS INTEGER) AS f FROM (SELECT {_key}, sum(f) AS s FROM o GROUP BY 1), (SELECT DISTINCT {_other} FROM o)",
    )
on("emb", "bernoulli_null", lambda o: nulls.bernoulli(o, 12, 0.4), "SELECT entity, item, CAST(CAST(('0x' || substr(md5(concat_ws('|', '12', entity, item)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.4 AS INTEGER) AS f FROM o")
on(
    "emb",
    "fraction_changed",
    lambda o: margins.fraction_changed(o, nulls.permute_rows(o, 11)),
    "SELECT round(avg(CAST(o.f <> z.f AS INTEGER)), 10) AS fraction_changed FROM o JOIN z USING (entity, item)",
    "z AS (SELECT entity, item, CAST(row_number() OVER (PARTITION BY entity ORDER BY md5(concat_ws('|', '11', entity, item)), item) <= s AS INTEGER) AS f FROM (SELECT entity, sum(f) AS s FROM o GROUP BY 1), (SELECT DISTINCT item FROM o))",
)
on("emb", "fixed_margin_null", lambda o: margins.margins_equal(o, nulls.null_matrices(o, 1, 1).drop("rep")), "SELECT CAST(0 AS BIGINT) AS largest_gap, true AS equal")
on("emb", "fixed_margin_mean", lambda o: nulls.null_statistics(o, 4, 1, residuals=False).agg(F.round(F.max("mean") - F.min("mean"), 14).alias("spread"), F.count(F.lit(1)).alias("n")), "SELECT CAST(0.0 AS DOUBLE) AS spread, CAST(5 AS BIGINT) AS n")
MARGINS_OF = "SELECT 'entity' AS kind, entity AS key, r AS margin FROM em WHERE r > 0 UNION ALL SELECT 'item', item, c FROM im WHERE c > 0"


def _margins_of(cells: DataFrame) -> DataFrame:
    """kind, key, margin of failing cells (entity, item)."""
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("key")) for k in ("entity", "item")]))
    return cells.select(ends.alias("e")).groupBy("e.kind", "e.key").agg(F.count(F.lit(1)).alias("margin"))


on("emb", "fixed_margin_margins", lambda o: _margins_of(nulls.null_matrices(o, 1, 21).where("f = 1")), MARGINS_OF)
on("ret", "trade_table_margins", lambda o: _margins_of(nulls.null_table(o, 22, 5)), MARGINS_OF)
on("emb", "dispersion_test", lambda o: nulls.calibrated(nulls.null_statistics(o, 400, 2, residuals=False), "dispersion"))
on("emb", "dispersion_test_chains", lambda o: nulls.calibrated(nulls.null_statistics(o, 400, 3, chains=8, residuals=False), "dispersion"))
on("emb", "chain_mixing", lambda o: statistics.gelman_rubin(nulls.chain_draws(o, 4)))
on("emb", "n_effective", lambda o: nulls.n_effective(o, 40, 5))
on("emb", "null_convergence", lambda o: nulls.convergence(o, 6))
on("emb", "noise_floor", lambda o: nulls.noise_floor(o, 12, 7))
on("evt", "null_ladder", lambda o: nulls.noise_floor(margins.trim_degenerate(o), 8, 8, extra=True))
on("evt", "held_out_dimension", lambda o: nulls.held_out_dimension(margins.trim_degenerate(o), 3, 9))
query("detection_power")(lambda s, d: nulls.detection_power(s, [("groups", 0.0), ("groups", 1.2), ("shared", 1.2), ("copy", 0.35)], 20, 400, 700, 15, 10))
query("controls")(lambda s, d: nulls.detection_power(s, [("groups", 0.0), ("groups", 1.6), ("clone", 1.0), ("shuffled", 0.0)], 4, 500, 900, 15, 11).select("kind", "strength", "mean_ses"))


@query("fiber_uniformity")
def _fibers(s: SparkSession, d: str) -> DataFrame:
    """Chi-square of the sampler's visits against equal frequencies, on margins whose matrices can all be listed."""
    out = None
    for name, rows, columns in (("90", [2, 2, 2, 2], [2, 2, 2, 2]), ("48", [3, 2, 2, 1], [2, 2, 2, 2]), ("204", [3, 3, 2, 2, 2], [3, 3, 3, 3]), ("1170", [2, 3, 1, 2, 2], [2, 2, 2, 2, 2])):
        visits, size = nulls.fiber_visits(s, rows, columns, 60_000, 12)
        one = statistics.chi_square_uniform(visits, size).select(F.lit(name).alias("fiber"), F.lit(size).alias("size"), "chi_square", "p")
        out = one if out is None else out.union(one)
    return out


# Conditioning --------------------------------------------------------------------------------------------------------
#: The margin model by 400 rounds of Newton steps for each parameter by itself, over the distinct margins; then what it
#: expects two margins to share, and the deviation that it leaves each.
_P = "1 / (1 + exp(-(x[2] + y[2])))"
_SUM = "list_sum(list_transform({other}, lambda y: y[1] * {term}))"


def _newton(own: str, other: str) -> str:
    left, curve = _SUM.format(other=other, term=f"({_P})"), _SUM.format(other=other, term=f"({_P}) * (1 - {_P})")
    return f"list_transform({own}, lambda x: x[2] + (x[1] - {left}) / {curve})"


FIT = (
    ", rc AS (SELECT r, count(*) AS n FROM em GROUP BY r), cc AS (SELECT c, count(*) AS n FROM im GROUP BY c)"
    ", v AS (SELECT (SELECT list(r ORDER BY r) FROM rc) AS r, (SELECT list(n ORDER BY r) FROM rc) AS nr, (SELECT list(c ORDER BY c) FROM cc) AS c, (SELECT list(n ORDER BY c) FROM cc) AS nc, (SELECT count(*) FROM em) AS n, (SELECT count(*) FROM im) AS m)"
    ", fit AS (SELECT 0 AS k, list_transform(r, lambda x: ln(x / (m - x))) AS a, list_transform(c, lambda x: CAST(0 AS DOUBLE)) AS b FROM v UNION ALL "
    f"SELECT k + 1, a, {_newton('list_zip(c, b)', 'list_zip(nr, a)')} FROM (SELECT k, {_newton('list_zip(r, a)', 'list_zip(nc, b)')} AS a, b, r, nr, c, nc FROM fit, v WHERE k < 400))"
    ", fa AS (SELECT unnest(r) AS r, unnest(a) AS a FROM fit, v WHERE k = 400), fb AS (SELECT unnest(c) AS c, unnest(nc) AS n, unnest(b) AS b FROM fit, v WHERE k = 400)"
    ", pr AS (SELECT r, c, n, 1 / (1 + exp(-(a + b))) AS p FROM fa, fb), ex AS (SELECT x.r AS ra, y.r AS rb, sum(x.n * x.p * y.p) / (SELECT m FROM v) AS e FROM pr x JOIN pr y USING (c) GROUP BY 1, 2)"
    ", dv AS (SELECT ra AS r, sqrt(ra / (SELECT m FROM v) - e) AS s FROM ex WHERE ra = rb)"
    ", rp AS (SELECT i, j, g / m AS observed, e AS expected, g / m - e AS excess, (g / m - e) / (a.s * b.s) AS residual FROM p JOIN ex ON ra = ri AND rb = rj JOIN dv a ON a.r = ri JOIN dv b ON b.r = rj)"
)


def fitted(name: str, f, sql: str, parts: str = PAIRS) -> None:
    query(name, f"WITH RECURSIVE o AS ({VIEW['emb']}), {parts}{FIT} {sql}")(over("emb", f))


fitted("residual_summary", residual.residual_summary, "SELECT (SELECT n FROM v) AS n, true AS margins_fit, round(sqrt(avg(residual * residual)), 6) AS rms_residual, round((SELECT n * n FROM v) / ((SELECT n FROM v) + 2 * sum(residual * residual)), 4) AS participation_raw FROM rp")
fitted("residual_pairs", lambda o: residual.residual_pairs(o, digits=4), "SELECT i, j, round(observed, 4) AS observed, round(excess, 4) AS excess, round(residual, 4) AS residual FROM rp")
fitted(
    "variance_terms",
    lambda o: residual.variance_terms(o).select(F.round("correlation", 6).alias("correlation"), *[F.round(F.col(c) * 1e6, 4).alias(f"{c}_e6") for c in ("var_observed", "var_expected", "covariance", "var_excess", "mean_excess")]),
    "SELECT round(corr(expected, excess), 6) AS correlation, round(var_samp(observed) * 1e6, 4) AS var_observed_e6, round(var_samp(expected) * 1e6, 4) AS var_expected_e6, round(covar_samp(expected, excess) * 1e6, 4) AS covariance_e6, round(var_samp(excess) * 1e6, 4) AS var_excess_e6, round(avg(excess) * 1e6, 4) AS mean_excess_e6 FROM rp",
)
fitted(
    "rank_window_residual",
    lambda o: windows.residual_profile(margins.trim_degenerate(o)),
    'SELECT CAST(prof."window" AS INTEGER) AS "window", CAST(prof.start AS INTEGER) AS start, prof.centre_accuracy, round(x.residual, 8) AS mean_residual FROM prof JOIN (SELECT sp."window", avg(rp.residual) AS residual FROM rp JOIN rk a ON a.entity = rp.i JOIN rk b ON b.entity = rp.j '
    'JOIN sp ON least(a.rank, b.rank) >= sp.start AND greatest(a.rank, b.rank) < sp.start + sp.width GROUP BY 1) x ON x."window" = prof."window"',
    PROFILE,
)
on("emb", "spectrum_summary", lambda o: residual.spectrum_summary(residual.spectrum(o)))
on("emb", "spectrum_raw", lambda o: residual.spectrum(o, raw=True))
on("emb", "eigenvalues_above", lambda o: residual.eigenvalues_above(residual.spectrum(o), studies.null_edge(o, 6, 20)))
query("cohort_participation")(lambda s, d: residual.by_cohort(VIEWS["emb"](s, d), read(s, d, "embeddings").select(F.col("vec_id").alias("entity"), F.col("label").cast("string").alias("cohort")), 20, 20))
on("emb", "margin_fit_gap", lambda o: o.sparkSession.range(1).select(F.lit(residual.fit_margins(o).gap < 1e-8).alias("margins_fit")), "SELECT true AS margins_fit")


def _log_likelihood(o: DataFrame) -> DataFrame:
    a, b = residual.parameters(o, residual.fit_margins(o))
    cells = o.join(a, "entity").join(F.broadcast(b), "item")  # a row an item
    return statistics.log_likelihood(cells.withColumn("p", scalar.sigmoid(F.col("alpha") + F.col("beta"), 30.0)), "p", "f").select(F.round("mean_log_likelihood", 8).alias("mean_log_likelihood"))


fitted(
    "log_likelihood",
    _log_likelihood,
    "SELECT round(avg(ln(CASE f WHEN 1 THEN q ELSE 1 - q END)), 8) AS mean_log_likelihood FROM (SELECT f, 1 / (1 + exp(-(a + b))) AS q FROM o JOIN em USING (entity) JOIN fa USING (r) JOIN im USING (item) JOIN fb USING (c))",
    MARGINS,
)


# Redundancy ----------------------------------------------------------------------------------------------------------
#: Entities in the order `od` (entity, rank); each is kept unless a kept one before it agrees at the threshold.
FIRST_KEPT = (
    ", el AS MATERIALIZED (SELECT greatest(a.rank, b.rank) AS rank, list(least(a.rank, b.rank)) AS early FROM ag JOIN od a ON a.entity = ag.i JOIN od b ON b.entity = ag.j WHERE agreement >= 0.65 GROUP BY 1), nb AS MATERIALIZED (SELECT rank, early FROM od LEFT JOIN el USING (rank))"
    ", kp AS (SELECT CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT nb.rank, CASE WHEN list_has_any(kp.kept, coalesce(nb.early, [])) THEN kp.kept ELSE list_append(kp.kept, nb.rank) END FROM kp JOIN nb ON nb.rank = kp.rank + 1)"
)
KEPT = "SELECT entity FROM od WHERE rank IN (SELECT unnest(kept) FROM (SELECT kept FROM kp ORDER BY rank DESC LIMIT 1))"
ORDERS = {
    "keep_accurate": ", od AS (SELECT entity, row_number() OVER (ORDER BY r, entity) AS rank FROM em)",
    "representatives": ", sm AS (SELECT entity, round(sum(agreement), 9) AS s FROM (SELECT i AS entity, agreement FROM ag UNION ALL SELECT j, agreement FROM ag) GROUP BY 1), od AS (SELECT entity, row_number() OVER (ORDER BY s DESC, entity) AS rank FROM sm)",
}
for _name, _rule in (("keep_accurate", dedup.keep_accurate), ("representatives", dedup.representatives)):
    query(_name, f"WITH RECURSIVE o AS ({VIEW['emb']}), {PAIRS}{ORDERS[_name]}{FIRST_KEPT} {KEPT}")(over("emb", lambda o, f=_rule: f(o, 0.65)))
on("emb", "redundancy_sweep", lambda o: studies.redundancy_sweep(o, (1.01, 0.70, 0.65, 0.60), 6))
on("emb", "duplication_verdict", lambda o: studies.duplication_verdict(studies.redundancy_sweep(o, (1.01, 0.65), 6), 1.01, 0.65))

# Studies beside their nulls ------------------------------------------------------------------------------------------
on("emb", "variance_reconciliation", lambda o: studies.reconciliation(margins.trim_degenerate(o), 30, 13, 2000))
on("emb", "rank_redundancy", lambda o: studies.rank_redundancy_profile(studies.rank_redundancy(margins.trim_degenerate(o), 12, seed=14)))
on("emb", "rank_redundancy_summary", lambda o: studies.rank_redundancy_summary(stored(studies.rank_redundancy(margins.trim_degenerate(o), 12, seed=14), "profiles")))
on("emb", "chain_comparison", lambda o: studies.chain_comparison(o, 200, 15))
query("panel_measures")(lambda s, d: studies.panel_study(resp(s, d), seed=16))
query("incremental_validity")(lambda s, d: studies.incremental_models(studies.panel_study(resp(s, d), seed=16)))
query("panel_strategies")(lambda s, d: studies.panel_strategies(resp(s, d), seed=17))
query("strategy_contrast")(lambda s, d: studies.strategy_contrast(studies.panel_strategies(resp(s, d), seed=17)))


@query("null_verdicts")
def _null_verdicts(s: SparkSession, d: str) -> DataFrame:
    """verdict, holds: whether the exact null is apart from simpler ones, one-margin nulls from it, and chains have mixed."""
    o = VIEWS["emb"](s, d)
    at = lambda r: F.max(F.when(F.col("rung") == r, F.col("rms_mean")))
    floor = stored(nulls.noise_floor(o, 12, 19, nulls.RUNGS[:4]), "floor").agg(*[at(r).alias(r) for r in nulls.RUNGS[:4]], F.max("analytic").alias("analytic"))
    exact = F.col("fixed_margins")
    apart = lambda a, b: verdicts.differs(exact, F.col(a)) | verdicts.differs(exact, F.col(b))
    names = {"exact_null_matters": apart("bernoulli_constant", "analytic"), "both_margins_matter": apart("rows_permuted", "columns_permuted")}
    out = floor.select(F.explode(F.array(*[F.struct(F.lit(k).alias("verdict"), v.alias("holds")) for k, v in names.items()])).alias("v")).select("v.*")
    return out.union(statistics.gelman_rubin(nulls.chain_draws(o, 4)).select(F.lit("chains_mixed").alias("verdict"), verdicts.mixed(F.col("r_hat")).alias("holds")))



@query(
    "verdict_statistics",
    f"WITH o AS ({VIEW['emb']}), {PROFILE}, {TOTALS.removeprefix(MARGINS + ', ')}, u AS (SELECT event_type, count(DISTINCT user_id) AS k FROM events GROUP BY 1), q AS (SELECT k > avg(k) OVER () AS passed FROM u) "
    f"SELECT 'closed_form_holds' AS verdict, abs(excess - closed) < {verdicts.CLOSED_FORM_GAP} AS holds FROM x UNION ALL "
    f"SELECT 'survives_dedup', coalesce(a.v / b.v >= {verdicts.TOP_OVER_MEDIAN}, false) FROM (SELECT mean_agreement AS v FROM prof WHERE \"window\" = 0) a, (SELECT median(mean_agreement) AS v FROM prof) b UNION ALL "
    f"SELECT 'fires_below', count(*) FILTER (passed) < {verdicts.MOST_BENCHES} FROM q UNION ALL SELECT 'fires_by_majority', count(*) FILTER (passed) <= count(*) // 2 FROM q",
)
def _verdict_statistics(s: SparkSession, d: str) -> DataFrame:
    """verdict, holds: predicates over margins, rank windows and the event types with more users than the mean one."""
    o = VIEWS["emb"](s, d)
    form = margins.closed_form_terms(o).select(F.lit("closed_form_holds").alias("verdict"), verdicts.closed_form_holds(F.col("naive"), F.col("forced")).alias("holds"))
    top = windows.profile_summary(windows.window_profile(o)).select(F.lit("survives_dedup"), verdicts.survives_dedup(F.col("top_over_median")))
    users = read(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("k"))
    passed = users.crossJoin(F.broadcast(users.agg(F.avg("k").alias("mean")))).select((F.col("k") > F.col("mean")).alias("passed"))
    below, most = (passed.agg(f(F.col("passed")).alias("holds")).select(F.lit(n), "holds") for n, f in (("fires_below", verdicts.fires_below), ("fires_by_majority", verdicts.fires_by_majority)))
    return form.union(top).union(below).union(most)


# Streaming, monitor, report ------------------------------------------------------------------------------------------
query("stream_joint_failure", f"WITH o AS ({VIEW['evt']}), {TOTALS} {RECORD}")(lambda s, d: incremental.monitor_record(s, f"{d}/events.parquet"))
query("stream_windows", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda s, d: _day(incremental.windowed_errors(s, f"{d}/events.parquet")))
query("stream_latest", "SELECT user_id, max(ts) AS ts FROM events GROUP BY 1")(lambda s, d: incremental.newest_snapshots(s, f"{d}/events.parquet"))
HARVEST_MODELS, HARVEST_FILES = 30, 12


def _harvested(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Result files of three snapshots of ten days, users by 30 as models: complete ones, short ones and ones with counts for
    outcomes; taken up in runs of at most twelve files, some before the next snapshot is there."""
    state, hours = new_path(s, "harvest"), s.range(24).select(F.col("id").alias("item"))
    e = read(s, d, "events").select((F.col("user_id") % HARVEST_MODELS).alias("n"), F.hour("ts").cast("long").alias("item"), (F.col("event_type") == "error").cast("int").alias("bad"), F.floor((F.dayofmonth("ts") - 1) / 10).alias("part"))
    found = e.groupBy("n", "part", "item").agg(F.sum("bad").alias("k"))
    grid = found.select("n", "part").distinct().crossJoin(F.broadcast(hours)).join(found, ["n", "part", "item"], "left").where("n % 10 != 3 OR item < 20")
    value = F.when(F.col("n") % 10 == 7, F.coalesce("k", F.lit(0))).otherwise((F.coalesce("k", F.lit(0)) == 0).cast("long"))
    rows = stored(grid.select("part", F.format_string("m%02d", "n").alias("model"), "item", value.cast("double").alias("acc")), "results")
    for part in range(3):
        out = rows.where(F.col("part") == part).select("model", "item", "acc")
        out.repartition("model").write.partitionBy("model").parquet(f"{state}/results/snapshot=2024-01-{10 * part + 1:02d}")
        results.harvest(s, f"{state}/results", state, 24, files=HARVEST_FILES)
    known = -1
    while (now := s.read.parquet(f"{state}/files").count()) != known:  # a number a file; until a run finds nothing more
        known = now
        results.harvest(s, f"{state}/results", state, 24, files=HARVEST_FILES)
    return results.harvested(s, state)


HARVEST = (
    "e AS (SELECT user_id % 30 AS n, hour(ts) AS item, CAST(event_type = 'error' AS INTEGER) AS bad, (day(ts) - 1) // 10 AS part FROM events), g AS (SELECT n, part, item FROM (SELECT DISTINCT n, part FROM e), range(24) q(item) WHERE n % 10 <> 3 OR item < 20)"
    ", c AS (SELECT n, part, item, coalesce(sum(bad), 0) AS k FROM g LEFT JOIN e USING (n, part, item) GROUP BY 1, 2, 3), v AS (SELECT printf('m%02d', n) AS model, part, printf('2024-01-%02d', 10 * part + 1) AS snapshot, item, CASE WHEN n % 10 = 7 THEN k ELSE CAST(k = 0 AS INTEGER) END AS acc FROM c WHERE part < 3)"
    ", j AS (SELECT model, snapshot, CASE WHEN count(*) <> 24 THEN concat('rowcount:', count(*), '!=24') WHEN max(acc) > 1 THEN 'non-binary-primary' END AS reason FROM v GROUP BY 1, 2)"
)
query("harvest_rejects", f"WITH {HARVEST} SELECT snapshot, model, reason FROM j WHERE reason IS NOT NULL")(lambda s, d: _harvested(s, d)[1])
query("harvest_matrix", f"WITH {HARVEST}, last AS (SELECT model, max(snapshot) AS snapshot FROM j WHERE reason IS NULL GROUP BY 1) SELECT model AS entity, item, CAST(1 - acc AS INTEGER) AS f FROM v JOIN last USING (model, snapshot)")(
    lambda s, d: results.newest(_harvested(s, d)[0])
)
RUNS_A_MONTH, DAYS_A_RUN = 5, 6
FILES_A_RUN = 4  # two batches: their number does not follow the size of the table


def _monitored(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The events of the month come in in five parts, with a run of the maintained margins after each: (state, the record
    after each run).  Each run is published, and once more, as if its batch were repeated."""
    state, out = new_path(s, "maintained"), None
    cells = read(s, d, "events").select(F.col("user_id").alias("entity"), F.hour("ts").cast("long").alias("item"), (F.col("event_type") == "error").cast("int").alias("f"), F.floor((F.dayofmonth("ts") - 1) / DAYS_A_RUN).alias("part"))
    for k in range(RUNS_A_MONTH):
        cells.where(F.col("part") == k).drop("part").repartition(FILES_A_RUN).write.parquet(f"{state}/source/part={k}")
        stream = s.readStream.schema("entity long, item long, f int").option("maxFilesPerTrigger", 2).parquet(f"{state}/source/*")
        maintained.take_up(stream, state)
        now = stored(maintained.record(s, state), "record")
        measured = now.select(F.lit("hours").alias("bench"), F.col("n_entities").alias("n_models"), "n_items", "mean_joint", "naive_excess_e6")
        for _ in range(2):
            maintained.publish(measured, state, f"2024-01-{DAYS_A_RUN * (k + 1):02d}", k)
        now = now.withColumn("run", F.lit(k))
        out = now if out is None else out.union(now)
    return state, out


HISTORY = (
    "e AS (SELECT user_id AS entity, hour(ts) AS item, CAST(event_type = 'error' AS INTEGER) AS f, (day(ts) - 1) // 6 AS part FROM events), o AS (SELECT k AS run, entity, item, max(f) AS f FROM e JOIN range(5) q(k) ON part <= k GROUP BY 1, 2, 3)"
    ", im AS (SELECT run, item, CAST(sum(f) AS BIGINT) AS c FROM o GROUP BY 1, 2), em AS (SELECT run, entity, CAST(sum(f) AS BIGINT) AS r FROM o GROUP BY 1, 2)"
    ", t AS (SELECT * FROM (SELECT run, CAST(count(*) AS DOUBLE) AS m, CAST(sum(c) AS DOUBLE) AS sc, CAST(sum(c * c) AS DOUBLE) AS scc FROM im GROUP BY 1) JOIN (SELECT run, CAST(count(*) AS DOUBLE) AS n, CAST(sum(r * r) AS DOUBLE) AS srr FROM em GROUP BY 1) USING (run))"
    + TOTALS[TOTALS.index(", x AS") :]
)
query("stream_record_history", f"WITH {HISTORY} SELECT CAST(run AS INTEGER) AS run, {RECORD.removeprefix('SELECT ')}")(lambda s, d: _monitored(s, d)[1])
query(
    "monitor_chain",
    f"WITH {HISTORY}, rec AS (SELECT run AS batch, {RECORD.removeprefix('SELECT ')}) SELECT concat('2024-01-', lpad(CAST(6 * (batch + 1) AS VARCHAR), 2, '0')) AS run, CAST(batch AS BIGINT) AS batch, 'hours' AS bench, n_entities AS n_models, n_items, mean_joint, naive_excess_e6, "
    "n_entities - lag(n_entities, 1, 0) OVER (ORDER BY batch) AS n_models_delta, format('- 2024-01-{:02d} hours: {:d} models ({:+d}), {:d} items, mean joint failure {:.6f}', 6 * (batch + 1), n_entities, n_entities - lag(n_entities, 1, 0) OVER (ORDER BY batch), n_items, mean_joint) AS line FROM rec",
)(lambda s, d: maintained.series(s, _monitored(s, d)[0]))
on("emb", "audit_report", lambda o: report.audit(o, 20, (0.70, 0.65, 0.60)))
on("emb", "monitor_row", lambda o: report.measure(o, 40))
