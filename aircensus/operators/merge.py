"""Merge rules of a cell's events as tables: which fields travel together, which events count, which one wins.

Every rule says "the last event that counts gives the fields"; a table becomes
the aggregates of one ``groupBy``, which combine before the shuffle.  Rules whose
columns a source does not have are left out.  ``at`` is the order of events.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S


class Rule(NamedTuple):
    """``fields`` come from the last event for which ``counts`` holds; no ``rats`` means all technologies."""

    fields: tuple[str, ...]
    counts: str
    rats: tuple[str, ...] = ()


def _each(names: str, counts: str, *rats: str) -> tuple[Rule, ...]:
    return tuple(Rule((n,), counts.format(n), rats) for n in names.split())


#: R4.  NR replaces its levels as a whole; the others keep the last valid value of each.
SIGNAL = (
    *_each("rsrp rsrp_filtered", "{} between -150 and -40", "LTE"),
    *_each("rsrp", "{} between -150 and -40", "WCDMA", "GSM"),  # a level told without its own name
    *_each("rsrq rsrq_filtered", "{} between -30 and -1", "LTE"),
    *_each("rssi snr", "{} is not null", "LTE"),
    Rule(("snr_rx0", "snr_rx1"), "snr_rx0 is not null", ("LTE",)),
    Rule(("rsrp", "rsrq", "snr"), "true", ("NR",)),
    *_each("rscp", "{} <> 0", "WCDMA"),
    *_each("ecio", "{} is not null", "WCDMA"),
    *_each("rxlev rxqual", "{} <> 0", "GSM"),
    *_each("snr", "{} is not null", "GSM"),
    Rule(("c1", "c2"), "c1 is not null", ("GSM",)),
)
#: R5.  Zero is unset, but for fields that have a sign or a flag of their own.
RADIO = (
    *_each("ul_freq band bandwidth scs ta p_class ura_id access flags", "{} <> 0"),
    *_each("q_hyst t_reselection s_intra s_non_intra thresh_low priority thresh_x_high thresh_x_low q_rxlev_min q_qual_min", "{} <> 0", "LTE", "NR", "WCDMA"),
    *_each("rxlev_min max_tx ncc_permitted reselect_offset temporary_offset penalty_time", "{} <> 0", "GSM"),
    *_each("band_class", "{} <> 255", "GSM"),
    *_each("sfn", "{} <> 0"),
    *_each("nas_idle allowed_access rrc_state", "{} >= 0"),
    Rule(("emm_state", "emm_substate"), "emm_state >= 0"),
    Rule(("emm_mcc", "emm_mnc"), "emm_mcc <> 0"),
    Rule(("mme_group", "mme_code"), "mme_group is not null"),
    Rule(("p_max",), "p_max is not null"),
    *_each("barring_emergency barring_signalling barring_data", "true", "LTE"),  # always overwritten
)
#: R3, beside the identity: last value that is set.
PASSPORT = (*_each("band_ind q_rx_lev_min q_rx_lev_min_offset rac", "{} <> 0"), *_each("mnc_digits", "{} in (2, 3)"))
#: Flags that only a full identity, or one that fills a gap, may set.
FLAGS = ("barred", "reselection_allowed", "reserved", "csg")
#: Of a neighbour that a cell measures, and of a carrier that it advertises.
SOURCES = ("meas", "intra", "inter", "geran", "gsm", "utra", "wcdma")  # of a neighbour, the first that names it wins
MEASURED = (*_each("rsrp rsrq rssi snr", "{} is not null"), *_each("nb_offset", "{} <> 0"))
CARRIER = _each("nb_thresh_high nb_thresh_low nb_rx_lev_min nb_priority nb_bandwidth", "{} <> 0")


def present(rules: Iterable[Rule], columns: Iterable[str]) -> list[Rule]:
    have = set(columns)
    return [r for r in rules if have.issuperset(r.fields)]


def fields(rules: Iterable[Rule]) -> list[str]:
    return list(dict.fromkeys(f for r in rules for f in r.fields))


def last_fields(rules: Iterable[Rule], among: Column, columns: Iterable[str], prefix: str = "") -> list[Column]:
    """One aggregate a field: its value in the last event that is ``among`` and counts.

    A field that several rules have counts by the one of its technology.  Fields
    of a rule share its condition, so they come from one event.
    """
    rules = present(rules, columns)

    def counts(field: str) -> Column:
        held = F.lit(False)
        for r in rules:
            if field in r.fields:
                held = held | (F.expr(r.counts) & (F.col("rat").isin(*r.rats) if r.rats else F.lit(True)))
        return held

    return [F.max_by(f, F.when(among & counts(f), F.col("at"))).alias(prefix + f) for f in fields(rules)]


# ---- R3: identity ------------------------------------------------------------------------------


def has_cid() -> Column:
    return F.coalesce(S.valid_eci("cid"), F.lit(False))


def has_tac() -> Column:
    return F.coalesce(S.valid_tac("tac"), F.lit(False))


def has_plmn() -> Column:
    return F.coalesce(F.col("mcc") != 0, F.lit(False))


def is_full() -> Column:
    return has_cid() & has_tac() & has_plmn()


IDENTITY = ("mcc", "mnc", "tac", "cid")


def identity_fields(among: Column) -> list[Column]:
    """Aggregates from which ``identity`` decides: value and place of each field's first valid one and of the first full identity."""
    at = F.col("at")
    own = {"cid": has_cid(), "tac": has_tac(), "mcc": has_plmn(), "mnc": has_plmn()}
    firsts = [F.min_by(c, F.when(among & ok, at)).alias(f"_{c}") for c, ok in own.items()]
    places = [F.min(F.when(among & own[c], at)).alias(f"_{c}_at") for c in ("cid", "tac", "mcc")]
    full = [F.min_by(c, F.when(among & is_full(), at)).alias(f"_full_{c}") for c in IDENTITY]
    return [*firsts, *places, *full, F.min(F.when(among & is_full(), at)).alias("_full_at")]


def identity() -> dict[str, Column]:
    """Mcc, mnc, tac, cid from ``identity_fields``.

    Empty fields are filled in order.  If that makes a full identity before the
    first event that has all of it, it stays; else that event's identity replaces
    whatever differs.  Without such an event each field is its first valid value.
    """
    made = F.greatest("_cid_at", "_tac_at", "_mcc_at")
    complete = F.col("_cid_at").isNotNull() & F.col("_tac_at").isNotNull() & F.col("_mcc_at").isNotNull()
    replaced = F.col("_full_at").isNotNull() & ~(complete & (made < F.col("_full_at")))
    return {c: F.when(replaced, F.col(f"_full_{c}")).otherwise(F.col(f"_{c}")) for c in IDENTITY}
