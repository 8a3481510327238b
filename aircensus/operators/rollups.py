"""Counts and summaries over the registry and over packet codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S


def _n(cond: Column, name: str) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)


def survey_stats(registry: DataFrame) -> DataFrame:
    """H1: plausible LTE rows, full cells, distinct sites of full cells, serving cells."""
    full = P.is_full_lte()
    return registry.agg(
        _n(P.is_lte_rf(), "rf_unique"), _n(full, "full_cells"), F.count_distinct(F.when(full, S.enb_id("cid"))).alias("sites"),
        _n((F.col("rat") == "LTE") & F.col("is_serving"), "serving"),
    )


def operators(registry: DataFrame) -> DataFrame:
    """H2: full LTE cells and distinct sites per PLMN.

    Cells are first counted per (PLMN, site), which combines before the shuffle,
    then sites per PLMN; no distinct expansion.
    """
    sites = registry.filter(P.is_full_lte()).groupBy("mcc", "mnc", S.enb_id("cid").alias("enb")).agg(F.count("*").alias("c"))
    return sites.groupBy("mcc", "mnc").agg(F.sum("c").alias("towers"), F.count("*").alias("sites"))


def coverage(registry: DataFrame) -> DataFrame:
    """H3: cells, serving, with cell id and with signal per technology, and TOTAL."""
    out = registry.rollup("rat").agg(
        F.count("*").alias("cells"), _n(F.col("is_serving"), "serving"), _n(F.col("cid") != 0, "with_cid"), _n(F.col("rsrp").isNotNull(), "with_signal")
    )
    return out.withColumn("rat", F.coalesce("rat", F.lit("TOTAL")))


def code_stats(packets: DataFrame) -> DataFrame:
    """H4: per log code the packets fed, with events, empty and failed, ok% (truncated) and a verdict.

    Packets: log_code, events (number decoded, null if no decoder took it), error (boolean).
    """
    out = packets.groupBy("log_code").agg(
        F.count("*").alias("fed"), _n(F.col("events") > 0, "accepted"), _n(F.col("error"), "rejected"),
        _n((F.col("events") == 0) & ~F.col("error"), "empty"), _n(F.col("events").isNull(), "unparsed"),
    )
    verdict = (
        F.when(F.col("unparsed") == F.col("fed"), "no parser").when(F.col("accepted") == F.col("fed"), "OK events")
        .when(F.col("accepted") > 0, "partial").when(F.col("rejected") > 0, "errors").when(F.col("empty") > 0, "empty").otherwise("seen")
    )
    return out.withColumns({"ok_percent": F.floor(F.col("accepted") * 100 / F.col("fed")).cast("long"), "verdict": verdict, "rat": S.rat_of_code("log_code")})


def frontier_counts(registry: DataFrame) -> DataFrame:
    """H9: per session and LTE carrier: full cells, and the highest camp count of a PLMN that served there."""
    lte = registry.filter("rat = 'LTE'")
    full = lte.groupBy("session_id", "freq").agg(_n(P.is_full_lte(), "full_on_earfcn"))
    camped = lte.filter("ever_serving and mcc <> 0")
    per_plmn = camp_counts(registry)
    top = camped.join(per_plmn, ["session_id", "mcc", "mnc"]).groupBy("session_id", "freq").agg(F.max("plmn_camps").alias("max_plmn_camps"))
    return full.join(top, ["session_id", "freq"], "left").withColumn("max_plmn_camps", F.coalesce("max_plmn_camps", F.lit(0)))


def camp_counts(registry: DataFrame) -> DataFrame:
    """Ever-serving LTE cells per session and PLMN."""
    camped = registry.filter("rat = 'LTE' and ever_serving and mcc <> 0")
    return camped.groupBy("session_id", "mcc", "mnc").agg(F.count("*").alias("plmn_camps"))


def wcdma_stats(registry: DataFrame) -> DataFrame:
    """WCDMA radio rows and full cells."""
    wcdma = F.col("rat") == "WCDMA"
    return registry.agg(_n(wcdma & F.col("freq").between(1, 16383) & F.col("phy").between(0, 511), "rf"), _n(P.is_full_wcdma(), "full_cells"))


def dump_stats(registry: DataFrame) -> DataFrame:
    """H6: cells, serving cells and last sighting by technology, by band, by PLMN and in all (one scan, grouping sets)."""
    base = registry.select("rat", S.lte_band_number("freq").alias("band"), S.format_plmn("mcc", "mnc").alias("plmn"), "is_serving", "last_seq")
    base = base.withColumn("band", F.when(F.col("rat") == "LTE", F.col("band")))
    sets = base.groupingSets([["rat"], ["band"], ["plmn"], []], "rat", "band", "plmn")
    out = sets.agg(F.grouping_id().alias("level"), F.count("*").alias("cells"), _n(F.col("is_serving"), "serving"), F.max("last_seq").alias("latest"))
    kind = F.when(F.col("level") == 3, "rat").when(F.col("level") == 5, "band").when(F.col("level") == 6, "plmn").otherwise("total")
    value = F.when(F.col("level") == 3, F.col("rat")).when(F.col("level") == 5, F.col("band").cast("string")).when(F.col("level") == 6, F.col("plmn")).otherwise("")
    return out.select(kind.alias("kind"), F.coalesce(value, F.lit("")).alias("value"), "cells", "serving", "latest")


def site_tree(registry: DataFrame) -> DataFrame:
    """H7: per operator and site: cells, best RSRP, first area code, the cells ordered by serving, camped, RSRP."""
    towers = registry.filter("rat = 'LTE' and cid <> 0")
    cell = F.struct(
        (~F.col("is_serving")).alias("a"), (~F.col("ever_serving")).alias("b"), (-F.coalesce("rsrp", F.lit(-999.0))).alias("c"), "freq", "phy", "session_id"
    )
    grouped = towers.groupBy(S.format_plmn("mcc", "mnc").alias("plmn"), S.enb_id("cid").alias("enb")).agg(
        F.count("*").alias("cells"), F.max("rsrp").alias("best_rsrp"), F.min_by("tac", F.when(F.col("tac").isNotNull(), F.struct("freq", "phy", "session_id"))).alias("tac"), F.array_sort(F.collect_list(cell)).alias("_cells")
    )
    listed = F.array_join(F.transform("_cells", lambda c: F.concat_ws("/", c["freq"], c["phy"])), ";")
    return grouped.withColumn("cell_list", listed).drop("_cells")


def document_meta(registry: DataFrame) -> DataFrame:
    """H8: one row about a tower document: its latest sighting and its counts."""
    rats = [_n(F.col("rat") == r, r.lower()) for r in ("GSM", "LTE", "WCDMA", "NR")]
    return registry.agg(F.max("last_seq").alias("situation_as_of"), F.count("*").alias("raw_tower_count"), _n(P.is_complete(), "tower_count"), _n(F.col("is_serving"), "serving_count"), *rats)


def rrc_histogram(headers: DataFrame) -> DataFrame:
    """Packets per (version, pdu) of decoded RRC headers; -1 where the header did not decode."""
    return headers.groupBy(F.coalesce("version", F.lit(-1)).alias("version"), F.coalesce("pdu", F.lit(-1)).alias("pdu")).agg(F.count("*").alias("packets"))


def band_list(targets: DataFrame, always: tuple[int, ...] = (1, 8)) -> DataFrame:
    """Bands of each session's targets and those that are always on, ascending, joined by ':'."""
    bands = targets.select("session_id", S.lte_band_number("freq").alias("band")).filter("band is not null")
    merged = F.array_union(F.collect_set("band"), F.array(*map(F.lit, always)))
    return bands.groupBy("session_id").agg(F.array_join(F.array_sort(merged), ":").alias("bands"))


def diag_top(stats: DataFrame, n: int = 8) -> DataFrame:
    """H13: 'B194:seen/events,...' of the n most frequent codes (columns log_code, fed, accepted)."""
    top = stats.orderBy(F.desc("fed"), "log_code").limit(n)
    item = F.struct((-F.col("fed")).alias("k"), "log_code", F.format_string("%s:%d/%d", F.hex("log_code"), "fed", "accepted").alias("t"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ",").alias("diag_top"))


def parse_diag_top(df: DataFrame, column: str = "diag_top") -> DataFrame:
    """The inverse of diag_top: log_code, seen, events."""
    parts = df.select(F.explode(F.split(column, ",")).alias("t"))
    return parts.select(
        F.conv(F.regexp_extract("t", "^([0-9A-Fa-f]+):", 1), 16, 10).cast("int").alias("log_code"),
        F.regexp_extract("t", ":([0-9]+)/", 1).cast("long").alias("seen"), F.regexp_extract("t", "/([0-9]+)$", 1).cast("long").alias("events"),
    )
