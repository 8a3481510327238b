"""Binary packets to events: one job, a decoder per log code.

Packets: session_id, seq, log_code, payload.  The decoders are in the modules
``packets_*``; they take all payloads of one code of an Arrow batch at once, so
the work is vectorised over packets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import packets_gsm, packets_lte, packets_umts_nr  # noqa: F401  (they register their decoders)
from . import registry as R
from .packets import ABSENT, DECODERS, LEVELS, NUMBERS, Decoder, byte_matrix, length_classes, register_decoder  # noqa: F401  (register_decoder is for users)

_SCHEMA = pa.schema([("session_id", pa.int64()), ("seq", pa.int64()), ("sub_seq", pa.int32()), ("log_code", pa.int32()), ("wall_time", pa.timestamp("us", tz="UTC")), ("rat", pa.string()), ("kind", pa.string()), *((f, pa.int64()) for f in NUMBERS), *((f, pa.float64()) for f in LEVELS)])
DDL = "session_id long, seq long, sub_seq int, log_code int, wall_time timestamp, rat string, kind string, " + ", ".join([f"{f} long" for f in NUMBERS] + [f"{f} double" for f in LEVELS])


def _decode_batch(batch: pa.RecordBatch, decoders: dict[int, tuple[str, Decoder]]) -> Iterator[pa.RecordBatch]:
    codes = batch["log_code"].to_numpy(zero_copy_only=False)
    sessions, seqs = (batch[c].to_numpy(zero_copy_only=False) for c in ("session_id", "seq"))
    lengths = pc.fill_null(pc.binary_length(batch["payload"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    groups = ((code, rows[part]) for code in np.unique(codes).tolist() for rows in (np.flatnonzero(codes == code),) for part in length_classes(lengths[rows]))
    for code, rows in groups:
        rat, fn = decoders[code]
        payloads = batch["payload"].take(pa.array(rows))
        b, n = byte_matrix(payloads), lengths[rows]
        for sub, (kind, has, values, *own) in enumerate(fn(b, n)):
            at = np.flatnonzero(has)
            if len(at):
                size = len(at)
                columns = [sessions[rows[at]], seqs[rows[at]], np.full(size, sub), np.full(size, code)]
                times = batch["wall_time"].take(pa.array(rows[at])).cast(_SCHEMA.field("wall_time").type)
                arrays = [*(pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)), times] + [pa.array([own[0] if own else rat] * size), pa.array([kind] * size)]
                arrays += [pa.array(values[f][at], pa.int64(), mask=values[f][at] == ABSENT) if f in values else pa.nulls(size, pa.int64()) for f in NUMBERS]
                arrays += [pa.array(values[f][at], pa.float64(), from_pandas=True) if f in values else pa.nulls(size, pa.float64()) for f in LEVELS]
                yield pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def decode_packets(packets: DataFrame) -> DataFrame:
    """Events of all packets whose code has a decoder, those a program registered included; narrow, no shuffle.

    Packets of other codes, short ones, unknown versions and null payloads give no event.  Times are the packets', if they have them.
    """
    decoders = dict(DECODERS)  # travels with the job: workers see what was registered here

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from _decode_batch(batch, decoders)

    time = F.col("wall_time") if "wall_time" in packets.columns else F.lit(None)
    return packets.select(F.col("session_id").cast("long").alias("session_id"), F.col("seq").cast("long").alias("seq"), "log_code", time.cast("timestamp").alias("wall_time"), "payload").filter(F.col("log_code").isin(*decoders)).mapInArrow(run, DDL)


# fixed values: channel by pdu, for families of versions, and for all versions that are in none
RRC_CHANNELS = (
    ((2, 3, 4, 6, 7, 8, 13, 22), {1: "MIB", 2: "BCCH_DL_SCH", 5: "DL_CCCH", 6: "DL_DCCH", 7: "UL_CCCH", 8: "UL_DCCH"}),
    ((9, 12), {8: "MIB", 9: "BCCH_DL_SCH", 12: "DL_CCCH", 13: "DL_DCCH", 14: "UL_CCCH", 15: "UL_DCCH"}),
    ((14, 15, 16, 20, 24, 25), {1: "MIB", 2: "BCCH_DL_SCH", 6: "DL_CCCH", 7: "DL_DCCH", 8: "UL_CCCH", 9: "UL_DCCH", 55: "BCCH_DL_SCH"}),
    ((19, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36), {1: "MIB", 3: "BCCH_DL_SCH", 8: "DL_CCCH", 9: "DL_DCCH", 10: "UL_CCCH", 11: "UL_DCCH", 46: "BCCH_DL_SCH"}),
)
RRC_OTHER = {
    1: "MIB", 2: "BCCH_DL_SCH", 3: "BCCH_DL_SCH", 9: "BCCH_DL_SCH", 5: "DL_CCCH", 6: "DL_CCCH", 8: "DL_CCCH", 12: "DL_CCCH", 7: "DL_DCCH", 13: "DL_DCCH",
    10: "UL_CCCH", 14: "UL_CCCH", 11: "UL_DCCH", 15: "UL_DCCH",
}


_RRC_FIELDS = ("version", "pci", "earfcn", "pdu", "pdu_len", "segment_id", "head")


def _rrc_struct(front: pa.Array, size: pa.Array) -> pa.Array:
    ok, fields = packets_lte.rrc_header(byte_matrix(front), size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    columns = [pa.array(fields[f], pa.int32(), mask=~ok | (fields[f] == ABSENT)) for f in _RRC_FIELDS]
    return pa.StructArray.from_arrays(columns, list(_RRC_FIELDS), mask=pa.array(~ok))


def _rrc_channel(version: Column, pdu: Column) -> Column:
    table = lambda names: F.element_at(F.create_map(*(F.lit(x) for item in names.items() for x in item)), pdu.cast("int"))
    out = F
    for versions, names in RRC_CHANNELS:
        out = out.when(version.isin(*versions), table(names))
    return out.otherwise(table(RRC_OTHER))


def decode_rrc_header(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds version, pci, earfcn, pdu, pdu_len, segment_id, body and channel of RRC wrappers; narrow, only the first bytes go through the Arrow pass.

    The body is everything after the header, whatever length it declares.  A
    payload that does not decode is tried once more without its first byte if
    that is at most 4; if that fails too, all eight columns are null.  The
    channel is null for paging and other channels without a decoder.
    """
    p = F.col(payload)
    # not deterministic for the planner: a filter on a field must not repeat the pass
    header = F.arrow_udf(_rrc_struct, ", ".join(f"{f} int" for f in _RRC_FIELDS)).asNondeterministic()
    out = packets.withColumn("_h", header(F.substring(p, 1, packets_lte.RRC_LONGEST + 1), F.octet_length(p)))
    named = out.withColumns({c: F.col(f"_h.{c}") for c in _RRC_FIELDS[:-1]} | {"body": p.substr(F.col("_h.head") + 1, F.lit(1 << 30))})
    return named.withColumn("channel", _rrc_channel(F.col("version"), F.col("pdu"))).drop("_h")


def surround_hints(packets: DataFrame) -> DataFrame:
    """GSM channel hints of modem events (code 0), from the event itself and, if it has one, from the ``hdr_earfcn`` of its journal line, which comes later and wins."""
    events = packets.filter("log_code = 0")
    told = decode_packets(events).filter("kind = 'hint'").select("session_id", "seq", "freq")
    if "hdr_earfcn" not in packets.columns:
        return told
    lines = events.filter(F.col("hdr_earfcn").between(1, 1023)).select("session_id", "seq", F.col("hdr_earfcn").cast("long").alias("line"))
    return told.join(lines, ["session_id", "seq"], "full").select("session_id", "seq", F.coalesce("line", "freq").alias("freq"))


def frames_to_packets(df: DataFrame, column: str = "frame") -> DataFrame:
    """Log frames to (log_code, ts_ticks, payload): the classic header repeats the length, the short one does not.

    The length counts what follows the first four bytes, unless the frame is
    exactly that long; padding beyond it is clipped.  Other frames are dropped.
    """
    f = F.col(column)
    word = lambda at, size: F.conv(_reversed_hex(f, at, size), 16, 10)
    kept = [c for c in df.columns if c != column]
    logs = df.filter((F.substring(f, 1, 1) == F.unhex(F.lit("10"))) & (F.octet_length(f) >= 14))
    sized = logs.withColumns({"_len": word(3, 2).cast("int"), "_again": word(5, 2).cast("int"), "_size": F.octet_length(f)})
    sized = sized.withColumn("_head", F.when((F.col("_again") == F.col("_len")) & (F.col("_size") >= 16), 16).otherwise(14))
    fits = lambda n: (n >= F.col("_head")) & (n <= F.col("_size"))
    exact = fits(F.col("_len")) & (F.col("_size") == F.col("_len"))
    total = F.when(exact, F.col("_len")).when(fits(F.col("_len") + 4), F.col("_len") + 4).when(fits(F.col("_len")), F.col("_len")).otherwise(F.col("_size"))
    sized = sized.withColumn("_total", total)
    classic = F.col("_head") == 16
    out = sized.select(
        *kept, F.when(classic, word(7, 2)).otherwise(word(5, 2)).cast("int").alias("log_code"), F.when(classic, word(9, 8)).otherwise(word(7, 8)).cast("decimal(20,0)").alias("ts_ticks"),
        f.substr(F.col("_head") + 1, F.col("_total") - F.col("_head")).alias("payload"),
    )
    return out.filter(F.octet_length("payload") > 0)


def _reversed_hex(f, at: int, size: int):
    return F.concat(*(F.hex(F.substring(f, at + i, 1)) for i in reversed(range(size))))


def bind_keys(events: DataFrame) -> DataFrame:
    """C11: events without a cell key take the last radio key of their packet."""
    packet = W.partitionBy("session_id", "seq").orderBy("sub_seq").rowsBetween(W.unboundedPreceding, 0)
    key = F.when((F.col("kind") == "radio") & (F.col("freq") != 0), F.struct("freq", "phy"))
    sticky = F.last(key, ignorenulls=True).over(packet)
    return events.withColumn("_k", sticky).withColumns({"freq": F.coalesce("freq", "_k.freq"), "phy": F.coalesce("phy", "_k.phy")}).drop("_k")


def registry_events(decoded: DataFrame) -> DataFrame:
    """Decoded packets as events of the registry.

    A cell that a packet measures or lists becomes a neighbour report without a
    teller, which ``registry.bind_serving`` finds; a channel without a code is one
    without nb_phy.  The PLMN of a registration is a radio parameter.  Hints
    are no events; see ``surround_hints``.
    """
    told, foreign, registered = F.col("kind").isin("meas_nb", "gsm_nb", "wcdma_nb"), F.col("kind") == "inter_carriers", F.col("kind") == "registration"
    lists = told | foreign
    own = lambda c: F.when(~registered, F.col(c))
    whole = {c: F.col(c).cast("int") for c in NUMBERS if c != "cid"}
    out = decoded.filter("kind <> 'hint'").withColumns(whole)
    keys = {f"nb_{c}": F.when(lists, F.col(c)) for c in ("freq", "phy")} | {c: F.when(~lists, F.col(c)) for c in ("freq", "phy")}
    plmn = {f"emm_{c}": F.when(registered, F.col(c)) for c in ("mcc", "mnc")} | {c: own(c) for c in ("mcc", "mnc")}
    source = F.when(told, "meas").when(foreign, "inter")
    return out.withColumns(keys | plmn | {"nb_source": source, "kind": F.when(lists, "neighbour").otherwise(F.col("kind"))})


def packets_to_registry(packets: DataFrame) -> DataFrame:
    """The registry of the cells that packets tell of."""
    return R.build_registry(registry_events(decode_packets(packets)), surround_hints(packets))


def reassemble_rrc(segments: DataFrame) -> DataFrame:
    """Bodies sent in segments 1..7 per (session, earfcn, pci): 7 closes a message, which needs segment 1; of repeated ids the last counts."""
    order = W.partitionBy("session_id", "earfcn", "pci").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    numbered = segments.withColumn("_m", F.coalesce(F.sum((F.col("segment_id") == 7).cast("int")).over(order), F.lit(0)))
    latest = numbered.groupBy("session_id", "earfcn", "pci", "_m", "segment_id").agg(F.max_by("body", "seq").alias("body"), F.max("seq").alias("seq"))
    parts = latest.groupBy("session_id", "earfcn", "pci", "_m").agg(F.array_sort(F.collect_list(F.struct("segment_id", F.hex("body").alias("h")))).alias("p"), F.max("seq").alias("seq"))
    whole = parts.filter(F.exists("p", lambda x: x["segment_id"] == 1) & F.exists("p", lambda x: x["segment_id"] == 7))
    return whole.select("session_id", "earfcn", "pci", "seq", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("body"))
