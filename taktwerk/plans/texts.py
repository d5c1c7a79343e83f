"""Queries that explain: texts to codes, and the evidence for and against a leading candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.operators import localise as L
from taktwerk.operators import text as T
from taktwerk.plans import flow, inference
from taktwerk.plans.base import Query, i, r, sql, tidy
from taktwerk.sources import fixtures as X

#: Deviations from which a station speaks, stations a side, and the probability from which a second candidate is named.
SPEAKS, A_SIDE, SECOND = 0.02, 3, 0.02


def failure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's best code by the sentences that describe the codes: the items of the benchmark."""
    items = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("code"), F.explode(F.split(F.coalesce("text", F.lit("")), r"[.\n]")).alias("phrase"))
    return tidy(T.propose_codes(X.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", items, items.select("code")))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window, top_station, side, rank, station, deviation): before the leading candidate the stations that are most blocked, after it those most starved."""
    post = inference.posterior_table(spark, sf_dir)
    tops = L.top_and_runner_up(post).select("window", "top_station")
    d = flow.scored_table(spark, sf_dir).select("window", "station", "d_blocked", "d_starved").join(tops, "window")
    before = F.col("station") < F.col("top_station")
    d = d.where("station <> top_station").select("window", "top_station", F.when(before, "before").otherwise("after").alias("side"), "station", F.when(before, F.col("d_blocked")).otherwise(F.col("d_starved")).alias("deviation"))
    rank = F.row_number().over(Window.partitionBy("window", "side").orderBy(F.desc("deviation"), "station"))
    return tidy(d.where(F.col("deviation") > SPEAKS).withColumn("rank", rank).where(F.col("rank") <= A_SIDE))


def second_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second candidate of each window, named where it has more than 2 % of the probability."""
    t = L.top_and_runner_up(inference.posterior_table(spark, sf_dir))
    named = F.round("runner_up_prob", 9) > SECOND
    return tidy(t.select("window", "top_station", F.when(named, F.col("runner_up_station")).alias("second_station"), F.when(named, F.col("runner_up_prob")).alias("second_prob"), F.when(named, F.col("top_prob") - F.col("runner_up_prob")).alias("lead")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (failure_codes, evidence, second_best)}

_STEM = "CASE WHEN length(w) > 4 AND suffix(w, 'ing') THEN w[1:length(w) - 3] WHEN length(w) > 3 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN w[1:length(w) - 1] ELSE w END"
_TOKENS = f"list_distinct(list_transform(regexp_extract_all(lower(coalesce(%s, '')), '[a-z]+'), lambda w: {_STEM}))"
SQL: dict[str, str] = {
    "failure_codes": f"""WITH phrases AS (SELECT item_id AS code, unnest(regexp_split_to_array(coalesce(text, ''), '[.\\n]')) AS phrase FROM benchmark),
    every AS (SELECT code, phrase, unnest({_TOKENS % 'phrase'}) AS token FROM (SELECT DISTINCT code, phrase FROM (SELECT * FROM phrases UNION ALL SELECT code, CAST(code AS VARCHAR) FROM phrases) WHERE code IS NOT NULL)),
    idf AS (SELECT token, ln(1 + (SELECT greatest(count(DISTINCT code), 1) FROM phrases) / count(DISTINCT code)) AS idf FROM every GROUP BY token),
    wholes AS (SELECT code, phrase, sum(idf) AS whole FROM every JOIN idf USING (token) GROUP BY code, phrase),
    met AS (SELECT DISTINCT doc_id, unnest({_TOKENS % 'text'}) AS token FROM documents),
    pairs AS (SELECT doc_id, code, phrase, sum(idf) AS got, count(*) AS m FROM met JOIN every USING (token) JOIN idf USING (token) GROUP BY doc_id, code, phrase),
    scores AS (SELECT doc_id, code, max(round(got / whole * ({T.MASS_BASE} + {T.MASS_SHARE} * least(1.0, m / {T.MASS_WORDS})), 9)) AS score FROM pairs JOIN wholes USING (code, phrase) GROUP BY doc_id, code),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS rk FROM scores WHERE score >= {T.LEAST})
    SELECT d.doc_id, coalesce(CAST(b.code AS VARCHAR), '{T.UNMAPPED}') AS code, {r('coalesce(score, 0)')} AS score FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN best b ON b.doc_id = d.doc_id AND rk = 1""",
    "evidence": sql(f"""SELECT "window", {i('top_station')} AS top_station, side, {i('rk')} AS rank, {i('station')} AS station, {r('deviation')} AS deviation FROM (SELECT *, row_number() OVER (PARTITION BY "window", side ORDER BY deviation DESC, station) AS rk FROM (
      SELECT s."window", top_station, station, CASE WHEN station < top_station THEN 'before' ELSE 'after' END AS side, CASE WHEN station < top_station THEN d_blocked ELSE d_starved END AS deviation FROM scored s JOIN tops t ON t."window" = s."window" WHERE station <> top_station) WHERE deviation > {SPEAKS}) WHERE rk <= {A_SIDE}""", *inference._CHAIN, inference._POST),
    "second_best": sql(f"""SELECT "window", {i('top_station')} AS top_station, CASE WHEN n THEN {i('r_station')} END AS second_station, CASE WHEN n THEN {r('r_prob')} END AS second_prob, CASE WHEN n THEN {r('top_prob - r_prob')} END AS lead FROM (SELECT *, round(r_prob, 9) > {SECOND} AS n FROM tops)""", *inference._CHAIN, inference._POST),
}
