"""Row predicates on registry columns (session_id, rat, freq, phy, mcc, mnc, tac, cid, rsrp, is_serving ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalars as S


def _set(c: str) -> Column:
    return F.coalesce(F.col(c) != 0, F.lit(False))


def is_lte_rf() -> Column:
    """Plausible LTE radio row: legal EARFCN, a PCI, no sentinel PLMN."""
    sentinel = F.coalesce((F.col("mcc") > 999) | (F.col("mnc") == 0xFFFF), F.lit(False))
    return (F.col("rat") == "LTE") & S.valid_earfcn("freq") & F.col("phy").between(1, 503) & ~sentinel


def is_full_lte() -> Column:
    return (F.col("rat") == "LTE") & S.has_identity("cid", "tac") & _set("mcc") & _set("phy") & S.valid_earfcn("freq")


def is_full_wcdma() -> Column:
    return (F.col("rat") == "WCDMA") & _set("cid") & _set("tac") & _set("mcc") & F.col("phy").between(0, 511) & F.col("freq").between(1, 16383)


def is_complete() -> Column:
    """Tower with PLMN, cell id, area and channel; all but GSM need a code (WCDMA code 0 is one)."""
    code = F.when(F.col("rat") == "GSM", True).when(F.col("rat") == "WCDMA", F.col("phy").isNotNull()).otherwise(_set("phy"))
    return _set("mcc") & _set("cid") & _set("tac") & _set("freq") & code


def drop_ghosts(df: DataFrame) -> DataFrame:
    """Without LTE rows that no cell can have, and unidentified ones of impossible strength."""
    lte = F.col("rat") == "LTE"
    sentinel = F.coalesce((F.col("mcc") > 999) | (F.col("mnc") == 0xFFFF), F.lit(False))
    bad = ~S.valid_earfcn("freq") | ~F.col("phy").between(1, 503) | sentinel
    loud = ~F.coalesce("is_serving", F.lit(False)) & ~_set("cid") & F.coalesce(F.col("rsrp") > -45, F.lit(False))
    return df.filter(~(lte & (bad | loud)))


def scope_rats(df: DataFrame, mode: str) -> DataFrame:
    """'wcdma' leaves LTE and NR out, 'lte' leaves WCDMA out, 'all' keeps every technology."""
    out = {"wcdma": ("LTE", "NR"), "lte": ("WCDMA",), "all": ()}[mode]
    return df.filter(~F.col("rat").isin(*out)) if out else df
