"""Work that grows with the events is done once, and by compiled code."""

from __future__ import annotations

from aircensus.operators import decode
from aircensus.operators import registry as R
from aircensus.plans.catalog_io import _identity_packets
from aircensus.plans.feed import observations

KEY = "spark.sql.codegen.hugeMethodLimit"


def test_wide_rows_run_compiled(spark, sf_dir):
    had = spark.conf.get(KEY)
    try:
        for step in (lambda: observations(spark, sf_dir), lambda: R.bind_events(events.limit(5)), lambda: R.registry_of_bound(bound)):
            events = observations(spark, sf_dir)
            bound = R.bind_events(events.limit(5))
            spark.conf.set(KEY, "65535")
            step()
            assert int(spark.conf.get(KEY)) <= 8000
        spark.conf.set(KEY, "4000")
        observations(spark, sf_dir)
        assert spark.conf.get(KEY) == "4000"
    finally:
        spark.conf.set(KEY, had)


def test_packets_are_decoded_once(spark, sf_dir):
    packets = _identity_packets(spark, sf_dir).limit(200)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    assert decode.packets_to_registry(packets.mapInArrow(count, packets.schema)).count() > 0
    assert read.value == 200
