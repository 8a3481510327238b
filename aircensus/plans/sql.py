"""SQL building blocks of the oracle: observations, promoted events, registry (table ``reg``) and what hangs on it."""

from __future__ import annotations

from ..functions.scalars import LTE_BANDS
from .feed import OBS_SQL as OBS

BAND = "CASE " + " ".join(f"WHEN freq BETWEEN {lo} AND {hi} THEN {b}" for b, _, lo, hi, *_ in LTE_BANDS) + " END"
FULL_LTE = "(rat = 'LTE' AND cid BETWEEN 1 AND 268435455 AND tac BETWEEN 1 AND 65534 AND mcc <> 0 AND phy <> 0 AND freq BETWEEN 1 AND 262143)"
FULL_WCDMA = "(rat = 'WCDMA' AND cid <> 0 AND tac <> 0 AND mcc <> 0 AND phy BETWEEN 0 AND 511 AND freq BETWEEN 1 AND 16383)"
COMPLETE = "(mcc <> 0 AND cid <> 0 AND tac <> 0 AND freq <> 0 AND (rat IN ('GSM', 'WCDMA') OR phy <> 0))"
GHOST = "(rat = 'LTE' AND (NOT phy BETWEEN 1 AND 503 OR (NOT is_serving AND coalesce(cid, 0) = 0 AND coalesce(rsrp > -45, FALSE))))"

_LEVELS = "rsrp, rsrq, rssi, snr, rscp, rxlev"
_PARAMETERS = "ul_freq, bandwidth, ta, rrc_state, emm_state, emm_substate, barring_emergency"
_EXTRAS = "mnc_digits, rac, barred"
_NEIGHBOUR = "nb_freq, nb_phy, nb_source, nb_thresh_high, nb_offset"
_REST = f"{_LEVELS}, {_PARAMETERS}, {_EXTRAS}, {_NEIGHBOUR}"
_NULLS = lambda names: ", ".join(f"NULL AS {n}" for n in names.split(", "))

# Reports name cells (told, heard), then LTE rows without a code find theirs.
PROMOTED = (
    OBS
    + f""",
named AS (SELECT * FROM obs WHERE kind = 'neighbour' AND nb_freq IS NOT NULL AND CASE rat WHEN 'LTE' THEN nb_phy BETWEEN 1 AND 503 ELSE nb_freq <> 0 AND nb_phy IS NOT NULL END),
placed AS (
  SELECT session_id, seq, seq * 8 AS tick, wall_time, rat, kind, freq, phy, mcc, mnc, cid, tac, {_REST} FROM obs
  UNION ALL
  SELECT session_id, seq, seq * 8 + 1, wall_time, rat, 'told', nb_freq, nb_phy, CASE WHEN nb_freq = freq AND rat = 'LTE' THEN mcc END, CASE WHEN nb_freq = freq AND rat = 'LTE' THEN mnc END, NULL, NULL,
    {_NULLS(_LEVELS)}, {_NULLS(_PARAMETERS)}, {_NULLS(_EXTRAS)}, {_NEIGHBOUR} FROM named
  UNION ALL
  SELECT session_id, seq, seq * 8 + 2, wall_time, rat, 'heard', nb_freq, nb_phy, NULL, NULL, NULL, NULL,
    {_LEVELS}, {_NULLS(_PARAMETERS)}, {_NULLS(_EXTRAS)}, {_NEIGHBOUR} FROM named WHERE CASE rat WHEN 'LTE' THEN nb_source = 'meas' AND rsrp <> 0 ELSE rscp <> 0 END),
lte AS (SELECT * FROM placed WHERE rat = 'LTE' AND kind <> 'neighbour'),
lte1 AS (SELECT *, (phy <> 0 AND row_number() OVER (PARTITION BY session_id, freq, phy ORDER BY tick) = 1)::INT AS fresh FROM lte),
lte2 AS (SELECT *, coalesce(sum(fresh) OVER w, 0) AS pcis, max(CASE WHEN phy <> 0 THEN phy END) OVER w AS only_phy FROM lte1
  WINDOW w AS (PARTITION BY session_id, freq ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lte3 AS (SELECT *, phy = 0 AND kind = 'passport' AND pcis > 1 AND cid IS NULL AS spread FROM lte2),
lte4 AS (SELECT *, first_value(CASE WHEN phy <> 0 THEN {{'phy': phy, 'tick': tick}} WHEN spread THEN {{'phy': -1, 'tick': tick}} END IGNORE NULLS) OVER w AS turn FROM lte3
  WINDOW w AS (PARTITION BY session_id, freq ORDER BY tick ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
rooms AS (SELECT session_id, freq, phy AS to_phy, min(tick) AS first_at, min(tick) FILTER (WHERE kind IN ('signal', 'heard')) AS own_at,
    arg_min(cid, tick) FILTER (WHERE kind = 'passport' AND cid IS NOT NULL) AS id, min(tick) FILTER (WHERE kind = 'passport' AND cid IS NOT NULL) AS id_at
  FROM lte WHERE phy <> 0 GROUP BY ALL),
homes AS (SELECT w.session_id, w.freq, w.tick, count(*) AS homes, min(p.to_phy) AS home FROM lte4 w JOIN rooms p ON p.session_id = w.session_id AND p.freq = w.freq
  WHERE w.phy = 0 AND w.kind = 'passport' AND w.cid IS NOT NULL AND p.first_at < w.tick AND NOT coalesce(p.id_at < w.tick AND p.id <> w.cid, FALSE) GROUP BY ALL),
weak1 AS (SELECT l.*, home, l.kind = 'passport' AND CASE WHEN l.cid IS NULL THEN pcis = 1 ELSE coalesce(homes = 1, FALSE) END AS alone
  FROM lte4 l LEFT JOIN homes h ON h.session_id = l.session_id AND h.freq = l.freq AND h.tick = l.tick WHERE l.phy = 0),
weak2 AS (SELECT *, NOT alone AND coalesce(turn.phy = -1, FALSE) AS ended, CASE WHEN NOT alone THEN turn.tick END AS waits,
    CASE WHEN NOT alone THEN coalesce(turn.phy, 0) WHEN cid IS NULL THEN only_phy ELSE home END AS to_phy FROM weak1),
weak3 AS (SELECT w.*, own_at, min(CASE WHEN kind = 'signal' THEN waits END) OVER (PARTITION BY w.session_id, w.freq, w.to_phy) AS batch
  FROM weak2 w LEFT JOIN rooms r ON r.session_id = w.session_id AND r.freq = w.freq AND r.to_phy = w.to_phy WHERE NOT spread AND (NOT ended OR kind = 'serving')),
promoted AS (
  SELECT session_id, seq, tick, wall_time, rat, kind, freq, phy, mcc, mnc, cid, tac, FALSE AS waited, {_REST} FROM placed WHERE NOT (rat = 'LTE' AND phy = 0 AND kind <> 'neighbour')
  UNION ALL
  SELECT session_id, seq, tick, wall_time, rat, CASE WHEN ended THEN 'gone' WHEN kind = 'signal' AND (coalesce(own_at < waits, FALSE) OR coalesce(batch < waits, FALSE)) THEN 'silent' ELSE kind END,
    freq, to_phy, mcc, mnc, CASE WHEN kind <> 'passport' OR alone THEN cid END, CASE WHEN kind <> 'passport' OR alone THEN tac END, waits IS NOT NULL, {_REST} FROM weak3
  UNION ALL
  SELECT w.session_id, seq, tick, wall_time, rat, kind, w.freq, p.to_phy, mcc, mnc, cid, tac, FALSE, {_REST}
  FROM lte4 w JOIN rooms p ON w.spread AND p.session_id = w.session_id AND p.freq = w.freq AND p.first_at < w.tick)"""
)

_KEY = "session_id, rat, freq, phy"
_ID, _AREA, _NET = "coalesce(cid BETWEEN 1 AND 268435455, FALSE)", "coalesce(tac BETWEEN 1 AND 65534, FALSE)", "coalesce(mcc <> 0, FALSE)"
_FULL = f"({_ID} AND {_AREA} AND {_NET})"
LAST_LEVELS = f"""arg_max_null(rsrp, tick) FILTER (WHERE %(among)s AND (rat = 'NR' OR rsrp BETWEEN -150 AND -40)) AS rsrp,
    arg_max_null(rsrq, tick) FILTER (WHERE %(among)s AND (rat = 'NR' OR rat = 'LTE' AND rsrq BETWEEN -30 AND -1)) AS rsrq,
    arg_max(rssi, tick) FILTER (WHERE %(among)s AND rat = 'LTE' AND rssi IS NOT NULL) AS rssi,
    arg_max_null(snr, tick) FILTER (WHERE %(among)s AND (rat = 'NR' OR rat IN ('LTE', 'GSM') AND snr IS NOT NULL)) AS snr,
    arg_max(rscp, tick) FILTER (WHERE %(among)s AND rat = 'WCDMA' AND rscp <> 0) AS rscp, arg_max(rxlev, tick) FILTER (WHERE %(among)s AND rat = 'GSM' AND rxlev <> 0) AS rxlev"""
LAST_PARAMETERS = """arg_max(ul_freq, tick) FILTER (WHERE %(among)s AND ul_freq <> 0) AS ul_freq, arg_max(bandwidth, tick) FILTER (WHERE %(among)s AND bandwidth <> 0) AS bandwidth,
    arg_max(ta, tick) FILTER (WHERE %(among)s AND ta <> 0) AS ta, arg_max(rrc_state, tick) FILTER (WHERE %(among)s AND rrc_state >= 0) AS rrc_state,
    arg_max(emm_state, tick) FILTER (WHERE %(among)s AND emm_state >= 0) AS emm_state, arg_max_null(emm_substate, tick) FILTER (WHERE %(among)s AND emm_state >= 0) AS emm_substate,
    arg_max(barring_emergency, tick) FILTER (WHERE %(among)s AND rat = 'LTE') AS barring_emergency"""

# What bears on a cell's identity, in order: passports, told and soft PLMNs, lost ids, begins and ends of serving.
REGISTRY = (
    PROMOTED
    + f""",
heard AS (SELECT * FROM promoted WHERE kind NOT IN ('neighbour', 'gone')),
cells0 AS (SELECT {_KEY}, min(seq) AS first_seq, count(*) FILTER (WHERE kind NOT IN ('told', 'heard')) AS seen, max(seq) FILTER (WHERE kind NOT IN ('told', 'heard')) AS last_seq,
    {LAST_LEVELS % {"among": "kind IN ('signal', 'heard')"}},
    {LAST_PARAMETERS % {"among": "kind = 'radio'"}}
  FROM heard GROUP BY {_KEY}),
births AS (SELECT session_id, freq, phy, min(tick) AS tick FROM heard WHERE rat = 'LTE' GROUP BY ALL),
soft AS (SELECT b.session_id, b.freq, b.phy, min(a.tick) AS tick, arg_min(a.mcc, a.tick) AS mcc, arg_min(a.mnc, a.tick) AS mnc FROM births b
  JOIN promoted a ON a.kind = 'passport' AND a.rat = 'LTE' AND a.phy <> 0 AND a.mcc <> 0 AND a.session_id = b.session_id AND a.freq = b.freq AND a.tick > b.tick WHERE b.phy <> 0 GROUP BY ALL),
claims AS (SELECT session_id, cid, freq, phy, tick, lag({{'freq': freq, 'phy': phy}}) OVER (PARTITION BY session_id, cid ORDER BY tick) AS prior
  FROM promoted WHERE kind = 'passport' AND rat = 'LTE' AND phy <> 0 AND cid <> 0),
serving_times AS (SELECT * FROM (SELECT {_KEY}, tick, kind, waited, lead(tick) OVER (PARTITION BY session_id, rat ORDER BY tick) AS until FROM promoted WHERE kind IN ('serving', 'gone')) WHERE kind = 'serving'),
marks AS (
  SELECT {_KEY}, tick, 'p' AS what, mcc, mnc, tac, cid, waited, {_EXTRAS} FROM promoted WHERE kind = 'passport'
  UNION ALL SELECT {_KEY}, tick, 't', mcc, mnc, NULL, NULL, NULL, NULL, NULL, NULL FROM promoted WHERE kind = 'told' AND mcc <> 0
  UNION ALL SELECT session_id, 'LTE', freq, phy, tick, 's', mcc, mnc, NULL, NULL, NULL, NULL, NULL, NULL FROM soft
  UNION ALL SELECT session_id, 'LTE', prior.freq, prior.phy, tick, 'x', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM claims WHERE prior.freq <> freq OR prior.phy <> phy
  UNION ALL SELECT {_KEY}, tick, 'b', NULL, NULL, NULL, NULL, waited, NULL, NULL, NULL FROM serving_times
  UNION ALL SELECT {_KEY}, until, 'e', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM serving_times WHERE until IS NOT NULL),
marks1 AS (SELECT *, (what = 'p' AND {_ID}) AS id_ok, (what = 'p' AND {_AREA}) AS area_ok, (what = 'p' AND {_NET}) AS net_ok, (what = 'p' AND {_FULL}) AS all_ok,
    sum((what = 'x')::INT) OVER (PARTITION BY {_KEY} ORDER BY tick, what <> 'e' ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS life FROM marks),
marks2 AS (SELECT *,
    coalesce(bool_or(id_ok) OVER l AND bool_or(area_ok) OVER l AND bool_or(what IN ('t', 's') OR net_ok) OVER r, FALSE) AS was,
    last_value(CASE WHEN id_ok THEN TRUE WHEN what = 'x' THEN FALSE END IGNORE NULLS) OVER n AS holds, last_value(CASE what WHEN 'b' THEN TRUE WHEN 'e' THEN FALSE END IGNORE NULLS) OVER n AS serves
  FROM marks1
  WINDOW l AS (PARTITION BY {_KEY}, life ORDER BY tick, what <> 'e' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    r AS (PARTITION BY {_KEY} ORDER BY tick, what <> 'e' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    n AS (PARTITION BY {_KEY} ORDER BY tick, what <> 'e' ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
marks3 AS (SELECT *, all_ok AND NOT was AS won, max(life) OVER (PARTITION BY {_KEY}) AS last_life FROM marks2),
named_cells AS (SELECT {_KEY},
    coalesce(arg_max(cid, tick) FILTER (WHERE won AND life = last_life), arg_min(cid, tick) FILTER (WHERE id_ok AND life = last_life)) AS cid0,
    coalesce(arg_max(tac, tick) FILTER (WHERE won AND life = last_life), arg_min(tac, tick) FILTER (WHERE area_ok AND life = last_life)) AS tac0,
    arg_max({{'mcc': mcc, 'mnc': mnc}}, tick) FILTER (WHERE won) AS won_net, arg_min({{'mcc': mcc, 'mnc': mnc}}, tick) FILTER (WHERE net_ok) AS own_net,
    arg_min({{'mcc': mcc, 'mnc': mnc, 'what': what}}, tick) FILTER (WHERE net_ok OR what IN ('t', 's')) AS first_net,
    arg_max(mnc_digits, tick) FILTER (WHERE what = 'p' AND mnc_digits IN (2, 3)) AS mnc_digits, arg_max(rac, tick) FILTER (WHERE what = 'p' AND rac <> 0) AS rac,
    arg_max(barred, tick) FILTER (WHERE all_ok OR NOT was AND (id_ok OR net_ok)) AS barred,
    coalesce(bool_or(holds AND serves AND what IN ('p', 'b') AND NOT waited), FALSE) AS ever_serving, coalesce(arg_max(serves, (tick, what <> 'e')), FALSE) AS is_serving, bool_or(what = 'b') AS served
  FROM marks3 GROUP BY {_KEY}),
nets AS (SELECT *, CASE WHEN won_net IS NOT NULL THEN 'won' WHEN first_net.what = 't' THEN 'told' WHEN own_net IS NOT NULL THEN 'own' WHEN first_net IS NOT NULL THEN 'soft' END AS source FROM named_cells),
flags AS (SELECT {_KEY}, is_serving, ever_serving FROM named_cells WHERE served),
reg AS (SELECT c.session_id, c.rat, c.freq, c.phy, first_seq, last_seq, seen, {_LEVELS}, {_PARAMETERS}, mnc_digits, rac, barred, tac0 AS tac, cid0 AS cid,
    CASE source WHEN 'won' THEN won_net.mcc WHEN 'own' THEN own_net.mcc ELSE first_net.mcc END AS mcc, CASE source WHEN 'won' THEN won_net.mnc WHEN 'own' THEN own_net.mnc ELSE first_net.mnc END AS mnc,
    CASE WHEN source IN ('won', 'own') THEN 'hard' WHEN source = 'told' THEN 'neighbour' WHEN source = 'soft' THEN 'fanout' END AS plmn_source,
    coalesce(is_serving, FALSE) AS is_serving, coalesce(ever_serving, FALSE) AS ever_serving
  FROM cells0 c LEFT JOIN nets n ON n.session_id = c.session_id AND n.rat = c.rat AND n.freq = c.freq AND n.phy = c.phy),
lists AS (SELECT session_id, rat, freq, phy, nb_freq, nb_phy, arg_min(nb_source, CASE nb_source WHEN 'meas' THEN 0 WHEN 'intra' THEN 1 WHEN 'inter' THEN 2 WHEN 'utra' THEN 3 ELSE 4 END) AS source, count(*) AS reports,
    arg_max(rsrp, tick) FILTER (WHERE nb_source = 'meas') AS m_rsrp, arg_max(rsrq, tick) FILTER (WHERE nb_source = 'meas') AS m_rsrq, arg_max(rscp, tick) FILTER (WHERE nb_source = 'wcdma' AND rscp <> 0) AS m_rscp
  FROM promoted WHERE kind = 'neighbour' AND nb_freq IS NOT NULL GROUP BY ALL),
told AS (SELECT * FROM lists WHERE rat = 'LTE' AND phy <> 0 AND nb_phy BETWEEN 1 AND 503),
camps AS (SELECT session_id, mcc, mnc, count(*) AS plmn_camps FROM reg WHERE rat = 'LTE' AND ever_serving AND mcc <> 0 GROUP BY ALL),
frontier AS (SELECT r.session_id, r.freq, count(*) FILTER (WHERE """
    + FULL_LTE
    + """) AS full_on_earfcn, coalesce(max(plmn_camps) FILTER (WHERE ever_serving), 0) AS max_plmn_camps FROM reg r LEFT JOIN camps USING (session_id, mcc, mnc) WHERE rat = 'LTE' GROUP BY ALL)"""
)

# GSM passports of which some lack a channel: to the cell that has the id by then, to a serving cell that has none or the same, or to {0, cid} until a cell claims it.
GSM_BOUND = """
g AS (SELECT session_id, seq, kind, CASE WHEN kind = 'passport' AND seq % 20 < 10 THEN 0 ELSE freq END AS freq, phy, cid FROM obs WHERE rat = 'GSM'),
g2 AS (SELECT *, last_value(CASE WHEN kind = 'serving' THEN {'freq': freq, 'phy': phy} END IGNORE NULLS) OVER w AS s FROM g
  WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
put AS (SELECT * FROM g WHERE kind = 'passport' AND freq <> 0 AND cid IS NOT NULL),
asked AS (SELECT a.session_id, a.seq, a.phy, a.cid, a.s,
    (SELECT min({'freq': p.freq, 'phy': p.phy}) FROM put p WHERE p.session_id = a.session_id AND p.cid = a.cid AND p.seq < a.seq) AS home,
    (SELECT arg_min({'freq': p.freq, 'phy': p.phy}, p.seq) FROM put p WHERE p.session_id = a.session_id AND p.cid = a.cid AND p.seq > a.seq) AS later,
    (SELECT arg_min(p.cid, p.seq) FROM put p WHERE p.session_id = a.session_id AND p.freq = a.s.freq AND p.phy = a.s.phy AND p.seq < a.seq) AS served_cid
  FROM g2 a WHERE kind = 'passport' AND freq = 0),
found AS (SELECT *, CASE WHEN home IS NOT NULL THEN home WHEN s IS NOT NULL AND (cid IS NULL OR served_cid IS NULL OR served_cid = cid) THEN s
    WHEN cid IS NOT NULL AND later IS NOT NULL THEN later WHEN cid IS NOT NULL THEN {'freq': 0, 'phy': cid::INT} END AS f FROM asked),
bound AS (SELECT session_id, seq, f.freq AS freq, f.phy AS phy, cid FROM found WHERE f IS NOT NULL
  UNION ALL SELECT session_id, seq, freq, phy, cid FROM g WHERE kind = 'passport' AND freq <> 0)"""
