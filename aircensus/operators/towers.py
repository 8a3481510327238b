"""Towers: neighbour resolution, deduplication, comparison, enrichment, graph edges and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from .registry import KEY


OVERLAID = ("rsrp", "rsrq", "snr", "rssi")


def resolve_neighbours(registry: DataFrame, told: DataFrame) -> DataFrame:
    """Each cell's neighbours, once, with what the registry knows of them.

    ``told``: what ``registry.told_neighbours`` gives.  Only keys are joined; a miss
    is a stub with resolved = false, which a carrier without a code always is.  The
    teller itself is dropped.  A level that the teller measured goes before the
    registry's, an identity that it reported fills what the registry lacks.
    """
    edges = told.filter(~F.coalesce((F.col("nb_freq") == F.col("freq")) & (F.col("nb_phy") == F.col("phy")), F.lit(False)))
    levels = [c for c in OVERLAID if f"m_{c}" in told.columns]
    fields = ["mcc", "mnc", "tac", "cid"]
    known = registry.select("session_id", "rat", F.col("freq").alias("nb_freq"), F.col("phy").alias("nb_phy"), *(F.col(c).alias(f"nb_{c}") for c in (*fields, *dict.fromkeys(("rsrp", *levels)))), F.lit(True).alias("resolved"))
    out = edges.join(known, ["session_id", "rat", "nb_freq", "nb_phy"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    over = {f"nb_{c}": F.coalesce(f"m_{c}", f"nb_{c}") for c in levels}
    blanks = {f"nb_{c}": F.coalesce(f"nb_{c}", f"c_{c}") for c in fields if f"c_{c}" in told.columns}
    return out.withColumns(over | blanks) if over or blanks else out


def with_carriers(told: DataFrame) -> DataFrame:
    """Adds a row without a code for each foreign carrier of which a cell names codes."""
    inter = told.filter("source = 'inter' and nb_phy is not null").select(*KEY, "nb_freq").distinct()
    stubs = told.filter("source = 'inter' and nb_phy is null").select(*KEY, "nb_freq")
    return told.unionByName(inter.join(stubs, [*KEY, "nb_freq"], "left_anti").withColumns({"nb_phy": F.lit(None).cast("int"), "source": F.lit("inter"), "reports": F.lit(0).cast("long")}), allowMissingColumns=True)


def _winner(scope: list[str], key: list[str]):
    newest = [F.desc_nulls_last("last_seq"), F.desc(F.coalesce(F.col("freq") != 0, F.lit(False))), F.desc(F.coalesce(F.col("phy") != 0, F.lit(False))), F.desc_nulls_last("seen"), F.col("session_id"), F.col("freq"), F.col("phy")]
    return W.partitionBy(*scope, *key).orderBy(*newest)


def _dedup(rows: DataFrame, scope: list[str], key: list[str], fill: tuple[str, ...]) -> DataFrame:
    order = _winner(scope, key)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = rows.withColumns({f"_{c}": F.first(c, ignorenulls=True).over(whole) for c in fill} | {"_r": F.row_number().over(order)})
    best = filled.filter("_r = 1")
    return best.withColumns({c: F.col(f"_{c}") for c in fill}).drop("_r", *(f"_{c}" for c in fill))


FILLED = ("mcc", "mnc", "tac", "rsrp")


def fill_from_siblings(towers: DataFrame, rows: DataFrame, key: tuple[str, ...] = ("rat", "freq", "phy")) -> DataFrame:
    """Blanks of a tower from the earliest row with its (technology, channel, code) in any session; flags OR-ed, seen the maximum.

    Siblings are aggregated before the join, so a popular key is one row.
    """
    at = F.struct("first_seq", "session_id")
    siblings = rows.groupBy(*key).agg(
        *(F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_{c}") for c in FILLED),
        F.bool_or("is_serving").alias("_serving"), F.bool_or("ever_serving").alias("_ever"), F.max("seen").alias("_seen"),
    )
    joined = towers.join(siblings, list(key), "left")
    fixed = {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in FILLED}
    flags = {"is_serving": F.col("is_serving") | F.coalesce("_serving", F.lit(False)), "ever_serving": F.col("ever_serving") | F.coalesce("_ever", F.lit(False)), "seen": F.greatest("seen", "_seen")}
    return joined.withColumns(fixed | flags).select(*towers.columns)


def unique_complete(registry: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Complete towers, one per technology and cell id in each scope; losers fill the winner's blanks, then siblings do."""
    best = _dedup(registry.filter(P.is_complete()), ["session_id"] if scope is None else scope, ["rat", "cid"], FILLED)
    return fill_from_siblings(best, registry, (*(["session_id"] if scope is None else scope), "rat", "freq", "phy"))


def unique_rf(registry: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Every channel and code once in each scope, complete or not; only GSM may lack a code."""
    usable = registry.filter((F.col("freq") != 0) & ((F.col("rat") == "GSM") | F.col("phy").isNotNull()))
    return _dedup(usable, ["session_id"] if scope is None else scope, ["rat", "freq", "phy"], FILLED)


def latest_rows(rows: DataFrame, all_rows: bool, order: str = "row_no") -> DataFrame:
    """The latest row of each technology and cell id (or, all_rows, channel and code); the later row wins ties."""
    key = ["rat", "freq", "phy"] if all_rows else ["rat", "cid"]
    best = W.partitionBy(*key).orderBy(F.desc("last_seq"), F.desc(order))
    return rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def top_per_rat(towers: DataFrame, n: int) -> DataFrame:
    """I4: the n latest towers of each technology with their place; 0 gives all."""
    order = W.partitionBy("rat").orderBy(F.desc_nulls_last("last_seq"), "session_id", "freq", "phy")
    ranked = towers.withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= n) if n else ranked


def order_by_signal(df: DataFrame) -> DataFrame:
    """Serving cells first, then the strongest."""
    return df.orderBy(F.desc("is_serving"), F.desc(F.coalesce("rsrp", F.lit(-999.0))), "session_id", "rat", "freq", "phy")


def diff_cells(ours: DataFrame, expected: DataFrame) -> DataFrame:
    """Full outer comparison on (rat, freq, phy) with the first row of each side: side, cid_match, both_signal."""
    def first(df: DataFrame, p: str) -> DataFrame:
        one = df.groupBy("rat", "freq", "phy").agg(F.min_by(F.struct("cid", "rsrp"), "row_no").alias("s"))
        return one.select("rat", "freq", "phy", F.col("s.cid").alias(f"{p}_cid"), F.col("s.rsrp").alias(f"{p}_rsrp"), F.lit(True).alias(f"{p}_has"))

    both = first(ours, "our").join(first(expected, "exp"), ["rat", "freq", "phy"], "full")
    side = F.when(F.col("our_has") & F.col("exp_has"), "shared").when(F.col("our_has"), "ours").otherwise("expected")
    ids = (F.col("our_cid") != 0) & (F.col("exp_cid") != 0)
    match = F.when(F.coalesce(ids, F.lit(False)), F.when(F.col("our_cid") == F.col("exp_cid"), "match").otherwise("mismatch"))
    signal = F.col("our_rsrp").isNotNull() & F.col("exp_rsrp").isNotNull()
    return both.select("rat", "freq", "phy", "our_cid", "exp_cid", side.alias("side"), match.alias("cid_match"), signal.alias("both_signal"))


def diff_samples(diff: DataFrame, keys: int = 12, mismatches: int = 20) -> DataFrame:
    """The first keys on one side only and the first cell-id mismatches."""
    key = F.concat_ws("|", "rat", "freq", "phy")
    def some(cond: str, kind: str, n: int) -> DataFrame:
        return diff.filter(cond).select(F.lit(kind).alias("kind"), key.alias("cell"), "rat", "freq", "phy").orderBy("rat", "freq", "phy").limit(n).select("kind", "cell")

    return some("side = 'ours'", "only_ours", keys).unionByName(some("side = 'expected'", "only_expected", keys)).unionByName(some("cid_match = 'mismatch'", "cid_mismatch", mismatches))


def diff_summary(diff: DataFrame) -> DataFrame:
    """H5: counts of a comparison per technology and TOTAL, with truncated coverage."""
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    side = F.col("side")
    out = diff.rollup("rat").agg(
        n(side == "shared").alias("shared"), n(side == "ours").alias("only_ours"), n(side == "expected").alias("only_expected"),
        n(F.col("cid_match") == "match").alias("cid_match"), n(F.col("cid_match") == "mismatch").alias("cid_mismatch"), n(F.col("both_signal")).alias("both_signal"),
    )
    there = F.col("shared") + F.col("only_expected")
    return out.withColumns({"rat": F.coalesce("rat", F.lit("TOTAL")), "coverage": F.when(there == 0, 0).otherwise(F.floor(100 * F.col("shared") / there)).cast("long")})


IDENTITY = ["rat", "mcc", "mnc", "tac", "cid", "freq", "phy"]


def match_dumps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells of two dumps with one full identity, side by side; of repeated right rows the last wins."""
    last = right.groupBy(*IDENTITY).agg(F.max_by(F.struct("rsrp", "last_seq", "is_serving"), "row_no").alias("_r"))
    joined = left.join(last, IDENTITY)
    return joined.select(*IDENTITY, F.col("rsrp").alias("left_rsrp"), F.col("_r.rsrp").alias("right_rsrp"), F.col("last_seq").alias("left_last"), F.col("_r.last_seq").alias("right_last"))


#: What an external table may say of a cell beside its identity.
EXTERNAL = ("lat", "lon", "range", "samples", "average_signal")


def enrich(towers: DataFrame, external: DataFrame) -> DataFrame:
    """External LTE cells by (mcc, mnc, tac, cid): status skipped, found or missing, with the external fields (ext_*).

    Typed keys; whether the table is broadcast is left to its measured size.
    """
    here = [c for c in ("radio", *EXTERNAL) if c in external.columns]
    ext = external.select("mcc", "mnc", F.col("lac").alias("tac"), F.col("cellid").alias("cid"), *(F.col(c).alias(f"ext_{c}") for c in here))
    usable = (F.col("rat") == "LTE") & (F.col("mcc") != 0) & (F.col("tac") != 0) & (F.col("cid") != 0)
    out = towers.join(ext.withColumn("_found", F.lit(True)), ["mcc", "mnc", "tac", "cid"], "left")
    usable = F.coalesce(usable, F.lit(False))
    status = F.when(~usable, "skipped").when(F.col("_found"), "found").otherwise("missing")
    return out.withColumn("status", status).drop("_found")


def unmatched_sites(enriched: DataFrame) -> DataFrame:
    """Per session and LTE site (eNB): its cells, how many are missing outside, and whether one is."""
    cells = enriched.filter("rat = 'LTE' and cid <> 0")
    return cells.groupBy("session_id", S.enb_id("cid").alias("enb")).agg(F.count("*").alias("cells"), F.count_if(F.col("status") == "missing").alias("missing")).withColumn("unmatched", F.col("missing") > 0)


def labelled_diffs(enriched: DataFrame) -> DataFrame:
    """The field union of a survey's LTE cell and the external row, all labels; external fields of other cells are blank."""
    band, found = S.lte_band("freq"), F.col("status") == "found"
    both = {"Radio": ("rat", "ext_radio"), "MCC": ("mcc", "mcc"), "MNC": ("mnc", "mnc"), "TAC / LAC": ("tac", "tac"), "CID": ("cid", "cid")}
    ours = {
        "eNB": S.enb_id("cid"), "Sector (ncell)": S.sector("cid"), "EARFCN": F.col("freq"), "PCI": F.col("phy"), "Band": band["name"], "Duplex": band["duplex"], "DL MHz": F.round(band["dl_mhz"], 4),
        "UL MHz": F.round(band["ul_mhz"], 4), "Bandwidth MHz": F.col("bandwidth"), "RSRP": F.col("rsrp"), "RSRQ": F.col("rsrq"), "RSSI": F.col("rssi"),
    }
    theirs = {"Latitude": "ext_lat", "Longitude": "ext_lon", "Range m": "ext_range", "Samples": "ext_samples", "Avg signal": "ext_average_signal"}
    there = lambda c: F.when(found, F.col(c)) if c in enriched.columns else F.lit(None)
    columns = {f"our {k}": F.col(a) for k, (a, _) in both.items()} | {f"ext {k}": there(b) for k, (_, b) in both.items()} | {f"our {k}": c for k, c in ours.items()} | {f"ext {k}": there(c) for k, c in theirs.items()}
    blank = F.lit(None).cast("string")
    wide = enriched.filter("rat = 'LTE'").withColumns(columns | {f"ext {k}": blank for k in ours} | {f"our {k}": blank for k in theirs})
    return field_diffs(wide, {k: (f"our {k}", f"ext {k}") for k in (*both, *ours, *theirs)})


def field_diffs(enriched: DataFrame, labels: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per label and cell: ours, ext, verdict; ``labels`` names the two columns of each.

    Numbers are compared without leading zeros, text in lower case; two blanks give no row.
    """
    text = lambda c: F.coalesce(F.lower(F.trim(F.col(f"`{c}`").cast("string"))), F.lit(""))
    plain = lambda v: F.when(v.rlike("^0+[0-9]"), F.regexp_replace(v, "^0+(?=[0-9])", "")).otherwise(v)
    items = [F.struct(F.lit(k).alias("label"), plain(text(a)).alias("ours"), plain(text(b)).alias("ext")) for k, (a, b) in labels.items()]
    rows = enriched.select(*KEY, F.explode(F.array(*items)).alias("d")).select(*KEY, "d.*").filter("ours <> '' or ext <> ''")
    verdict = F.when(F.col("ours") == F.col("ext"), "Match").when(F.col("ext") == "", "OursOnly").when(F.col("ours") == "", "ExtOnly").otherwise("Mismatch")
    return rows.withColumns({"verdict": verdict, "merged": F.when(F.col("ours") != "", F.col("ours")).otherwise(F.col("ext"))})


def neighbour_edges(registry: DataFrame, told: DataFrame) -> DataFrame:
    """Undirected pairs of identified cells, one of which tells of the other.

    Pairs are put in order before the distinct; the session is in every key.
    """
    ids = registry.filter("cid <> 0").select("session_id", "rat", "freq", "phy", "cid")
    near = ids.select("session_id", "rat", F.col("freq").alias("nb_freq"), F.col("phy").alias("nb_phy"), F.col("cid").alias("nb_cid"))
    pairs = told.join(ids, KEY).join(near, ["session_id", "rat", "nb_freq", "nb_phy"]).filter("cid <> nb_cid")
    return pairs.select("session_id", F.least("cid", "nb_cid").alias("a"), F.greatest("cid", "nb_cid").alias("b")).distinct()


def hierarchy_edges(registry: DataFrame) -> DataFrame:
    """Operator to site and site to cell."""
    cells = registry.filter("rat = 'LTE' and cid <> 0").select(S.format_plmn("mcc", "mnc").alias("plmn"), S.enb_id("cid").cast("string").alias("enb"), F.col("cid").cast("string").alias("cid"))
    up = cells.select(F.lit("operator").alias("kind"), F.col("plmn").alias("parent"), F.col("enb").alias("child"))
    down = cells.select(F.lit("site").alias("kind"), F.col("enb").alias("parent"), F.col("cid").alias("child"))
    return up.unionByName(down).distinct()


def place_incomplete(registry: DataFrame) -> DataFrame:
    """A site for each unidentified LTE row: the lowest with a full cell on its carrier, else in its area, else none."""
    full = registry.filter(P.is_full_lte()).withColumn("enb", S.enb_id("cid"))
    by_carrier = full.groupBy("session_id", "freq").agg(F.min("enb").alias("carrier_enb"))
    areas = full.groupBy("session_id", "enb").agg(F.min_by("tac", F.struct("freq", "phy")).alias("tac"))
    by_area = areas.groupBy("session_id", "tac").agg(F.min("enb").alias("area_enb"))
    bare = P.drop_ghosts(registry.filter(F.col("rat") == "LTE")).filter(~P.is_full_lte())
    out = bare.join(by_carrier, ["session_id", "freq"], "left").join(by_area, ["session_id", "tac"], "left")
    how = F.when(F.col("carrier_enb").isNotNull(), "carrier").when(F.col("area_enb").isNotNull(), "area").otherwise("free")
    return out.select(*KEY, F.coalesce("carrier_enb", "area_enb").alias("enb"), how.alias("placed_by"))


def earfcn_peers(registry: DataFrame) -> DataFrame:
    """Sites of each operator with full cells on a carrier."""
    full = registry.filter(P.is_full_lte())
    return full.groupBy("mcc", "mnc", "freq").agg(F.array_join(F.transform(F.array_sort(F.collect_set(S.enb_id("cid"))), lambda x: x.cast("string")), ",").alias("sites"))


def lte_towers(registry: DataFrame) -> DataFrame:
    """F8: full LTE cells as flat towers, ordered by carrier and code."""
    rows = registry.filter(P.is_full_lte())
    return rows.select("session_id", "mcc", "mnc", "tac", F.col("cid").alias("eci"), F.col("freq").alias("earfcn"), F.col("phy").alias("pci"), S.lte_band_number("freq").alias("band"), "rsrp", "is_serving", "ever_serving").orderBy("earfcn", "pci", "session_id")


def haystack() -> Column:
    lte = F.col("rat") == "LTE"
    plmn = S.format_plmn("mcc", "mnc")
    tag = lambda t, c: F.when(c.isNotNull(), F.concat(F.lit(t), c.cast("string")))
    return F.lower(
        F.concat_ws(
            " ", F.concat_ws("|", "rat", "freq", "phy"), "rat", plmn, S.operator_brand(plmn), tag("cid", F.col("cid")), tag("enb", F.when(lte, S.enb_id("cid"))),
            tag("tac", F.col("tac")), F.when(lte, tag("earfcn", F.col("freq"))), F.when(lte, tag("pci", F.col("phy"))),
        )
    )


def search_towers(registry: DataFrame, query: str) -> DataFrame:
    """rows whose text holds every token of the query, whatever the case."""
    hay, cond = haystack(), F.lit(True)
    for token in query.lower().split():
        cond = cond & hay.contains(token)
    return registry.filter(cond)


SORTS = {"last_seen": "last_seq", "key": "freq", "cid": "cid", "channel": "freq", "rxl": "rsrp", "band": "band"}


def query_towers(registry: DataFrame, rats: list[str] | None = None, serving: bool = False, with_cid: bool = False, band: int | None = None, plmn: str = "", text: str = "", sort: str = "last_seen", descending: bool = True) -> DataFrame:
    """the tower table filtered and ordered as asked."""
    df = registry.withColumn("band", F.when(F.col("rat") == "LTE", S.lte_band_number("freq")))
    if rats:
        df = df.filter(F.col("rat").isin(*rats))
    if serving:
        df = df.filter("is_serving")
    if with_cid:
        df = df.filter("cid <> 0")
    if band:
        df = df.filter(F.col("band") == band)
    if plmn:
        df = df.filter(S.format_plmn("mcc", "mnc") == plmn)
    if text:
        df = df.filter(haystack().contains(text.lower()))
    column = F.col(SORTS[sort])
    return df.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), "session_id", "rat", "freq", "phy")
