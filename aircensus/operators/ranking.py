"""Frontier of a survey: advertised, pending and bare targets, and ranked gap lists per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from .rollups import camp_counts, frontier_counts

#: Signal given to targets that were only told of, and to rows without one; above MEASURED a signal is real.
TOLD, UNKNOWN, MEASURED = -155.0, -160.0, -154.0
CELL = ["session_id", "freq", "phy"]


def _known_band() -> Column:
    return S.lte_band_number("freq").isNotNull()


def serving_neigh_keys(registry: DataFrame, told: DataFrame) -> DataFrame:
    """Keys advertised by served LTE cells.

    Cells count in (freq, phy) order and each takes its own key back, so a
    served target stays only if a later served cell advertises it.
    """
    served = registry.filter("rat = 'LTE' and ever_serving").select(*CELL)
    pairs = told.join(served, CELL, "left_semi").select("session_id", F.col("freq").alias("f"), F.col("phy").alias("p"), F.col("nb_freq").alias("freq"), F.col("nb_phy").alias("phy"))
    target = served.withColumn("_served", F.lit(True))
    earlier = (F.col("f") < F.col("freq")) | ((F.col("f") == F.col("freq")) & (F.col("p") <= F.col("phy")))
    kept = pairs.join(target, CELL, "left").filter(~(F.coalesce("_served", F.lit(False)) & earlier))
    return kept.filter("phy between 1 and 503").select(*CELL).distinct()


def pending_keys(registry: DataFrame, told: DataFrame) -> DataFrame:
    """Advertised keys, and measured unidentified rows on carriers with a full cell, without camped keys."""
    lte = registry.filter("rat = 'LTE'")
    full_on = lte.filter(P.is_full_lte()).select("session_id", "freq").distinct()
    bare = lte.filter(~P.is_full_lte() & ~F.col("ever_serving") & F.coalesce(F.col("rsrp") > MEASURED, F.lit(False)) & F.col("phy").between(1, 503))
    measured = bare.join(full_on, ["session_id", "freq"], "left_semi").select(*CELL)
    camped = lte.filter("ever_serving").select(*CELL)
    return serving_neigh_keys(registry, told).unionByName(measured).subtract(camped)


def bare_carriers(registry: DataFrame, told: DataFrame) -> DataFrame:
    """Foreign carriers advertised by served cells, without a code and without any row there; FDD first."""
    served = registry.filter("rat = 'LTE' and ever_serving").select(*CELL)
    told_of = told.filter("nb_freq <> freq").join(served, CELL, "left_semi").groupBy("session_id", F.col("nb_freq").alias("freq")).agg(F.count_if(F.col("nb_phy") > 0).alias("codes"))
    there = registry.filter("rat = 'LTE' and phy <> 0").select("session_id", "freq").distinct()
    return told_of.filter("codes = 0").join(there, ["session_id", "freq"], "left_anti").select("session_id", "freq", S.lte_is_fdd("freq").alias("fdd")).orderBy(F.desc("fdd"), "session_id", "freq")


def _counts(targets: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds full_on_earfcn and max_plmn_camps (0 where unknown); one row per carrier, so the join cannot fan out."""
    out = targets.join(frontier_counts(registry), ["session_id", "freq"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("full_on_earfcn", "max_plmn_camps")})


def _rank(targets: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n of each session; Spark limits the groups before the shuffle."""
    ranked = targets.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy(*order)))
    return ranked.filter(F.col("place") <= n)


def _general_order(full_walk: bool) -> list[Column]:
    fdd, measured = S.lte_is_fdd("freq"), F.col("rsrp") > MEASURED
    walk = [(F.col("full_on_earfcn") > 0).asc(), F.col("plmn_camps").asc()] if full_walk else []
    rest = [F.col("has_full").asc()] if full_walk else []
    return [fdd.desc(), *walk, measured.desc(), F.col("full_on_earfcn").asc(), *rest, F.col("rsrp").desc(), F.col("freq").asc(), F.col("phy").asc()]


def _told_targets(told: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    return told.filter(F.col("source").isin(*sources)).select("session_id", F.col("nb_freq").alias("freq"), F.col("nb_phy").alias("phy"), F.lit(TOLD).alias("rsrp"))


def rank_gaps(registry: DataFrame, told: DataFrame, n: int = 16) -> DataFrame:
    """The classic list: unidentified rows and advertised codes, strongest per key, full cells left out."""
    full = registry.filter(P.is_full_lte()).select(*CELL)
    own = registry.filter((F.col("rat") == "LTE") & ~P.is_full_lte()).select(*CELL, F.coalesce("rsrp", F.lit(UNKNOWN)).alias("rsrp"))
    every = own.unionByName(_told_targets(told, ("inter",))).filter(F.col("phy").between(1, 503) & _known_band())
    best = every.groupBy(*CELL).agg(F.max("rsrp").alias("rsrp")).join(full, CELL, "left_anti")
    return _rank(_counts(best, registry), _general_order(False), n).select(*CELL, "rsrp", "place")


def _walk_targets(registry: DataFrame, told: DataFrame) -> DataFrame:
    own = registry.filter("rat = 'LTE'").select(*CELL, F.coalesce("rsrp", F.lit(UNKNOWN)).alias("rsrp"), P.is_full_lte().alias("is_full"), "mcc", "mnc", F.col("ever_serving").alias("camped"))
    every = own.unionByName(_told_targets(told, ("meas", "inter")), allowMissingColumns=True).filter(F.col("phy").between(1, 503) & _known_band())
    by = F.struct(F.coalesce("is_full", F.lit(False)), "rsrp")
    return every.groupBy(*CELL).agg(
        F.max("rsrp").alias("rsrp"), F.bool_or(F.coalesce("is_full", F.lit(False))).alias("has_full"), F.bool_or(F.coalesce("camped", F.lit(False))).alias("camped"),
        F.max_by(F.struct("mcc", "mnc"), F.when(F.col("mcc") != 0, by)).alias("plmn"),
    )


def _with_camps(targets: DataFrame, registry: DataFrame) -> DataFrame:
    out = _counts(targets.withColumns({"mcc": F.col("plmn.mcc"), "mnc": F.col("plmn.mnc")}).drop("plmn"), registry)
    out = out.join(camp_counts(registry), ["session_id", "mcc", "mnc"], "left")
    return out.withColumn("plmn_camps", F.greatest(F.coalesce("plmn_camps", F.lit(0)), "max_plmn_camps"))


def rank_full_walk(registry: DataFrame, told: DataFrame, n: int = 16) -> DataFrame:
    """The full walk: every uncamped key; new carriers and rarely camped operators first."""
    targets = _walk_targets(registry, told).filter("not camped")
    return _rank(_with_camps(targets, registry), _general_order(True), n).select(*CELL, "rsrp", "has_full", "place")


def rank_seeds(registry: DataFrame, n: int = 16, full_walk: bool = False) -> DataFrame:
    """Registry rows only; full cells first; unmeasured rows on a carrier with a full cell are skipped."""
    rows = registry.filter((F.col("rat") == "LTE") & F.col("phy").between(1, 503) & _known_band())
    rows = rows.select(*CELL, F.coalesce("rsrp", F.lit(UNKNOWN)).alias("rsrp"), P.is_full_lte().alias("has_full"), F.col("ever_serving").alias("camped"), F.struct("mcc", "mnc").alias("plmn"))
    rows = _with_camps(rows, registry).filter("not camped" if full_walk else "not has_full")
    rows = rows.filter(F.col("has_full") | (F.col("rsrp") > MEASURED) | (F.col("full_on_earfcn") == 0))
    return _rank(rows, [F.col("has_full").desc(), *_general_order(full_walk)], n).select(*CELL, "rsrp", "has_full", "place")


def rank_allowed(registry: DataFrame, keys: DataFrame, n: int = 16, full_walk: bool = False) -> DataFrame:
    """I8: only keys of an allow list; those without a row get the unknown signal."""
    rows = registry.filter("rat = 'LTE'").select(*CELL, "rsrp", P.is_full_lte().alias("has_full"), F.struct("mcc", "mnc").alias("plmn"))
    out = keys.select(*CELL).distinct().join(rows, CELL, "left").filter(_known_band())
    out = out.withColumns({"rsrp": F.coalesce("rsrp", F.lit(UNKNOWN)), "has_full": F.coalesce("has_full", F.lit(False))})
    return _rank(_with_camps(out, registry), _general_order(full_walk), n).select(*CELL, "rsrp", "place")


SEED = -158.0


def rank_wcdma(registry: DataFrame, told: DataFrame | None = None, n: int = 16) -> DataFrame:
    """WCDMA targets: concrete codes before channels, then rare operators, what is incomplete, and strength.

    Candidates are the rows that never served, the neighbours that WCDMA cells name
    (-155 without a level) and the channels that LTE cells name (code 0, -158);
    both take the teller's PLMN.  A key keeps its strongest level, and the PLMN of
    its complete candidate, else of the strongest that has one.
    """
    legal = F.col("freq").between(1, 16383) & F.col("phy").between(0, 511)
    level = F.coalesce("rscp", "rsrp") if "rscp" in registry.columns else F.col("rsrp")
    wcdma = registry.filter("rat = 'WCDMA'")
    heard = F.when((level > -120) & (level < 0), level).otherwise(UNKNOWN)
    every = wcdma.filter(~F.col("ever_serving") | (F.col("phy") == 0)).select(*CELL, heard.alias("rsrp"), "mcc", "mnc", F.coalesce(P.is_full_wcdma(), F.lit(False)).alias("has_full"))
    if told is not None:
        named = told.filter(F.col("source").isin("wcdma", "utra")).join(registry.select("session_id", "rat", "freq", "phy", "mcc", "mnc"), ["session_id", "rat", "freq", "phy"], "left")
        seed = F.col("source") == "utra"
        weight = F.when(seed, SEED).otherwise(F.coalesce("m_rscp", F.lit(TOLD)) if "m_rscp" in told.columns else F.lit(TOLD))
        every = every.unionByName(named.select("session_id", F.col("nb_freq").alias("freq"), F.when(seed, 0).otherwise(F.col("nb_phy")).alias("phy"), weight.alias("rsrp"), "mcc", "mnc", F.lit(False).alias("has_full")))
    by = F.when(F.coalesce(F.col("mcc") != 0, F.lit(False)), F.struct("has_full", "rsrp", "mcc", "mnc"))
    best = every.filter(legal).groupBy(*CELL).agg(F.max("rsrp").alias("rsrp"), F.bool_or("has_full").alias("has_full"), F.max(by).alias("_p"))
    best = best.withColumns({"mcc": F.col("_p.mcc"), "mnc": F.col("_p.mnc")}).drop("_p")
    camps = wcdma.filter("ever_serving and mcc <> 0").groupBy("session_id", "mcc", "mnc").agg(F.count("*").alias("plmn_camps"))
    out = best.join(camps, ["session_id", "mcc", "mnc"], "left").withColumn("plmn_camps", F.coalesce("plmn_camps", F.lit(0)))
    order = [(F.col("phy") > 0).desc(), F.col("plmn_camps").asc(), F.col("has_full").asc(), F.col("rsrp").desc(), F.col("freq").asc(), F.col("phy").asc()]
    return _rank(out, order, n).select(*CELL, "rsrp", "place")


def sample_packets(packets: DataFrame, codes: list[int] | None, n: int = 12) -> DataFrame:
    """The first n payloads of each wanted log code with the code's total, the length and the first byte."""
    wanted = packets.filter(F.col("log_code").isin(*codes)) if codes else packets
    totals = wanted.groupBy("log_code").agg(F.count("*").alias("total"))
    first = wanted.withColumn("place", F.row_number().over(W.partitionBy("log_code").orderBy("seq"))).filter(F.col("place") <= n)
    return first.join(totals, "log_code").select("log_code", "seq", "place", "total", F.octet_length("payload").alias("bytes"), F.hex(F.substring("payload", 1, 1)).alias("version"))


def changed_cells(previous: DataFrame, current: DataFrame) -> DataFrame:
    """K3: cells of the current snapshot that are new or whose fingerprint changed."""
    key = ["session_id", "rat", "freq", "phy"]
    mark = F.xxhash64(*key, "is_serving", "mcc", "mnc", "cid")
    before = previous.select(*key, mark.alias("_before"))
    out = current.withColumn("_now", mark).join(before, key, "left")
    return out.filter(F.col("_before").isNull() | (F.col("_before") != F.col("_now"))).withColumn("change", F.when(F.col("_before").isNull(), "new").otherwise("changed")).drop("_before", "_now")


def vote_packing(words: DataFrame) -> DataFrame:
    """K6: the packing of each word: its own if decisive, else the session's lock so far, else by legality.

    Three decisive words of one kind with a strict majority lock a session;
    running sums find the first such word, and the lock holds from it on.
    """
    past = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    own = S.pci_packing("word")
    df = words.withColumn("_own", own)
    df = df.withColumns({k: F.count_if(F.coalesce(F.col("_own") == v, F.lit(False))).over(past) for k, v in (("_lsb", "LSB"), ("_msb", "MSB"))})
    wins = F.when((F.col("_own") == "LSB") & (F.col("_lsb") >= 3) & (F.col("_lsb") > F.col("_msb")), "LSB").when((F.col("_own") == "MSB") & (F.col("_msb") >= 3) & (F.col("_msb") > F.col("_lsb")), "MSB")
    df = df.withColumn("_win", wins).withColumn("locked", F.first("_win", ignorenulls=True).over(past))
    cell = S.unpack_pci("word", F.col("locked"))
    return df.withColumn("_cell", cell).select("session_id", "seq", "word", "locked", F.col("_cell.pci").alias("pci"), F.col("_cell.prio").alias("prio"), F.col("_cell.pack").alias("pack"))
