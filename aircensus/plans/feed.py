"""Radio observations derived from the ``events`` table, and the same as SQL.

Whole-number arithmetic only, so both engines agree; dB values are multiples of
1/16.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.durable import compiled_rows

# name -> expression over event_id, user_id, ts, event_type, i (carrier), j (code)
_COLUMNS = {
    "session_id": "user_id % 5",
    "seq": "event_id",
    "wall_time": "ts",
    "rat": "CASE WHEN event_id % 10 <= 6 THEN 'LTE' WHEN event_id % 10 = 7 THEN 'WCDMA' WHEN event_id % 10 = 8 THEN 'GSM' ELSE 'NR' END",
    "kind": "CASE event_type WHEN 'signup' THEN 'passport' WHEN 'click' THEN 'signal' WHEN 'error' THEN 'radio' WHEN 'purchase' THEN 'serving' ELSE 'neighbour' END",
    "freq": "CAST(CASE WHEN event_id % 10 <= 6 THEN CASE i WHEN 0 THEN 375 WHEN 1 THEN 1596 WHEN 2 THEN 3200 WHEN 3 THEN 6275 WHEN 4 THEN 37900 WHEN 5 THEN 38950 ELSE 32768 END"
    " WHEN event_id % 10 = 7 THEN 10562 + i * 20 WHEN event_id % 10 = 8 THEN 10 + i * 70 ELSE 620000 + i * 100 END AS INT)",
    "phy": "CAST(CASE WHEN event_id % 10 = 7 THEN j * 8 WHEN event_id % 10 = 8 THEN j ELSE j * 18 END AS INT)",
    "mcc": "CAST(250 AS INT)",
    # A cell's network and area now and then differ from what it said before, and parts of an identity may lack.
    "mnc": "CAST(CASE (i + CAST(event_id % 13 = 0 AS INT)) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 20 ELSE 99 END AS INT)",
    "cid": "CAST(CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 10 <= 6 THEN (200000 + j % 10) * 256 + i ELSE 1000 + i * 31 + j END AS BIGINT)",
    "tac": "CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE 17000 + j % 10 + 100 * CAST(event_id % 17 = 0 AS INT) END AS INT)",
    "mnc_digits": "CAST(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS INT)",
    "rac": "CAST(event_id % 6 AS INT)",
    "barred": "event_id % 5 = 0",
    "rsrp": "CAST(((event_id * 13 + user_id) % 1700) * 0.0625 - 140 AS DOUBLE)",
    "rsrq": "CAST(((event_id * 7 + user_id) % 640) * 0.0625 - 35 AS DOUBLE)",
    "rssi": "CAST(CASE WHEN event_id % 2 = 1 THEN ((event_id * 5) % 800) * 0.125 - 110 END AS DOUBLE)",
    "snr": "CAST(CASE WHEN event_id % 3 > 0 THEN (event_id % 50) * 0.5 - 5 END AS DOUBLE)",
    "rscp": "CAST(CASE WHEN event_id % 5 > 0 THEN -((event_id * 3) % 120) ELSE 0 END AS DOUBLE)",
    "rxlev": "CAST(-((event_id * 11) % 64) AS DOUBLE)",
    "ul_freq": "CAST(CASE WHEN event_id % 3 > 0 THEN 18000 + event_id % 100 ELSE 0 END AS INT)",
    "bandwidth": "CAST((event_id % 5) * 5 AS INT)",
    "ta": "CAST(event_id % 7 AS INT)",
    "rrc_state": "CAST(event_id % 5 - 1 AS INT)",
    "emm_state": "CAST(event_id % 4 - 1 AS INT)",
    "emm_substate": "CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 9 END AS INT)",
    "barring_emergency": "event_id % 2 = 0",
    "nb_thresh_high": "CAST(event_id % 8 AS INT)",
    "nb_offset": "CAST(event_id % 5 AS INT)",
    # LTE cells tell of their own carrier, of foreign ones (some without a code), and of WCDMA channels; WCDMA cells of their own channel.
    "nb_source": "CASE WHEN event_id % 10 > 7 THEN NULL WHEN event_id % 10 = 7 THEN 'wcdma' WHEN event_id % 8 = 0 THEN 'intra' WHEN event_id % 2 = 0 THEN 'meas' WHEN event_id % 7 = 0 THEN 'utra' ELSE 'inter' END",
    "nb_freq": "CAST(CASE WHEN event_id % 10 > 7 THEN NULL WHEN event_id % 10 = 7 THEN 10562 + i * 20 WHEN event_id % 2 = 1 AND event_id % 7 = 0 THEN 10572 + i * 20 WHEN event_id % 2 = 1 AND event_id % 11 = 0 THEN 2850 + i"
    " WHEN event_id % 2 = 0 THEN CASE i WHEN 0 THEN 375 WHEN 1 THEN 1596 WHEN 2 THEN 3200 WHEN 3 THEN 6275 WHEN 4 THEN 37900 WHEN 5 THEN 38950 ELSE 32768 END"
    " ELSE CASE i WHEN 6 THEN 375 WHEN 0 THEN 1596 WHEN 1 THEN 3200 WHEN 2 THEN 6275 WHEN 3 THEN 37900 WHEN 4 THEN 38950 ELSE 32768 END END AS INT)",
    "nb_phy": "CAST(CASE WHEN event_id % 10 > 7 OR event_id % 10 <> 7 AND event_id % 2 = 1 AND (event_id % 7 = 0 OR event_id % 11 = 0) THEN NULL WHEN event_id % 10 = 7 THEN ((j + 1) % 31) * 8 ELSE ((j + 1) % 31) * 18 END AS INT)",
    "i": "CAST(i AS INT)",
    "j": "CAST(j AS INT)",
}

OBS_SQL = (
    "ev AS (SELECT event_id, user_id, ts, event_type, (event_id * 31 + user_id * 5) % 7 AS i, (event_id * 17 + user_id * 3) % 31 AS j FROM events),\n"
    "obs AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items()) + " FROM ev)"
)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of one session per row of ``events``; ``seq`` orders a session."""
    compiled_rows(spark)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts = raw.selectExpr("event_id", "user_id", "ts", "event_type", "(event_id * 31 + user_id * 5) % 7 AS i", "(event_id * 17 + user_id * 3) % 31 AS j")
    return parts.selectExpr(*(f"{e} AS {n}" for n, e in _COLUMNS.items()))
