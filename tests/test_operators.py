"""Rules that the catalogue's data doesn't reach, sources, sinks and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from octavo.functions import constants, scalar
from octavo.operators import access, stats, store
from octavo.sources import pages, sinks
from octavo.streaming import live, twins

from .conftest import SF


def test_percentiles_take_the_lower_nearest_rank(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("latency_ns"))
    r = stats.latency_summary(df, width=3.0).first()
    assert (r.p50, r.p95, r.p99, r.n) == (4, 8, 8, 10)


def test_tier_edges(spark):
    df = spark.createDataFrame([(i,) for i in (0, 4, 5, 16, 17, 20, 64, 65, 100)], "idle int")
    assert [r[0] for r in df.select(scalar.tier(F.col("idle"))).collect()] == ["HOT", "HOT", "WARM", "WARM", "COLD", "COLD", "COLD", "FROZEN", "FROZEN"]


def test_unknown_names_and_limits(spark):
    assert spark.range(1).select(scalar.named(F.lit(99), constants.FORMATS)).first()[0] == "UNKNOWN"
    assert constants.clamp(50, constants.INTERVAL_RANGE_MS) == 100
    for n in (0, 21):
        with pytest.raises(ValueError):
            constants.checked_top_n(n)


def test_adaptive_interval(spark):
    df = spark.createDataFrame([(1, k, r) for k, r in enumerate((0, 0, 0, 4))], "scanner int, cycle int, result int")
    assert [r.interval_ms for r in access.adaptive_interval(df).orderBy("cycle").collect()] == [3000, 5000, 7000, 1000]


def test_savings_threshold(spark):
    df = spark.createDataFrame([(3563,), (3564,)], "s int")
    assert [r[0] for r in df.select(scalar.savings_pct("s")).collect()] == [13, 12]


def test_store_upsert_and_range(spark):
    schema = "owner_id bigint, page_index bigint, algo_id int, compressed_len bigint"
    old = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 1, 68), (2, 1, 1, 68)], schema)
    new = spark.createDataFrame([(1, 1, 7, 99)], schema)
    now = store.upsert(old, new)
    assert sorted(map(tuple, now.collect())) == [(1, 1, 7, 99), (1, 2, 1, 68), (2, 1, 1, 68)]
    assert store.zap_range(now, 1, 0, 1).count() == 2
    assert store.is_stored(new, old).count() == 1


def test_dump_source_refuses_partial_pages(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(8192))
    (tmp_path / "b.bin").write_bytes(bytes(100))
    (tmp_path / "c.bin").write_bytes(b"")
    assert pages.page_dumps(spark, str(tmp_path)).count() == 2
    assert pages.padded_files(spark, str(tmp_path)).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5)], "algo_id int, ratio double")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().ratio == "2.5"
    assert sinks.results_document(df).first().value == '{"results":[{"algo_id":1,"ratio":2.5}]}'
    sinks.write_json_lines(df, str(tmp_path / "json"))
    sinks.process_table(df, str(tmp_path / "tsv"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def streamed(spark, df, tmp_path, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_of_counters_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streamed(spark, live.pid_stats(source), tmp_path, "complete", "pids")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, twins.pid_stats(events).collect()))


def test_stream_of_sessions_is_part_of_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.mode("overwrite").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = streamed(spark, live.sessions(source), tmp_path, "append", "sessions")
    closed = {(r.user_id, r.start_ts, r.n) for r in got.collect()}
    assert 0 < len(closed) and closed <= {(r.user_id, r.start_ts, r.n) for r in twins.sessions(events).collect()}


def test_stream_of_cold_pages(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime(2024, 1, 1)
    rows = [(1, start, 7), (65, start + timedelta(days=1), 7), (2, start + timedelta(days=20), 8), (3, start + timedelta(days=40), 9)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint")
    (tmp_path / "in").mkdir()
    for k in range(len(rows)):
        df.where(F.col("event_id") == rows[k][0]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    try:
        got = streamed(spark, live.cold_pages(source), tmp_path, "append", "cold")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = {(r.owner_id, r.page_index): r.accesses for r in got.collect()}
    assert found[(7, 1)] == 2


def test_all_codecs_equal_the_coders(spark):
    """Sizes and the best of ten, held against the bytes that each coder makes."""
    from octavo.functions import codecs
    from octavo.functions.constants import CODECS, COMPARED
    from octavo.plans import catalog

    load = catalog.Loader(spark, SF)
    text = {(r.doc_id, r.page_no): bytes(r.page) for r in catalog.text_pages(load).collect()}
    want = {k: {c: len(code) if (code := codecs.encode(c, page)) is not None else None for c in COMPARED} for k, page in text.items()}
    got = {(r.doc_id, r.page_no, r.codec): r.encoded_size for r in catalog.QUERIES["codec_matrix_all"].plan(spark, SF).collect()}
    assert got == {(*k, c): size for k, sizes in want.items() for c, size in sizes.items()}
    best = {k: min(((size, at) for at, size in enumerate(sizes.values()) if size is not None), default=(None, None)) for k, sizes in want.items()}
    found = {(r.doc_id, r.page_no): (r.best_size, r.best_algo) for r in catalog.QUERIES["best_codec_all"].plan(spark, SF).collect()}
    assert found == {k: (size, None if at is None else CODECS[COMPARED[at]]) for k, (size, at) in best.items()}
    total = catalog.QUERIES["file_summary_all"].plan(spark, SF).toPandas()
    assert total["net_bytes"].sum() == sum(size or 4096 for size, _ in best.values()) and total["pages"].sum() == len(text)
    kept = {(r.owner_id, r.page_index) for r in catalog.QUERIES["store_snapshot_all"].plan(spark, SF).collect()}
    assert kept == {k for k, (size, _) in best.items() if size is not None and 100 * (4096 - size) // 4096 >= 13}
    assert {"lz4", "zstd"} & {COMPARED[at] for _, at in best.values() if at is not None}


def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_stream_of_buffers_equals_batch(spark, tmp_path):
    from octavo.operators import vram

    events = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    for k, edge in enumerate(("2024-01-10", "2024-01-20", "2024-03-01")):
        before = ("2000-01-01", "2024-01-10", "2024-01-20")[k]
        events.where(f"ts >= timestamp_ntz '{before}' AND ts < timestamp_ntz '{edge}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rocks(spark)
    try:
        rows = streamed(spark, live.buffers(source), tmp_path, "update", "buffers").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {}
    for r in rows:  # counters only grow, so a buffer's last row has the most
        count = r.registers + r.unregisters + r.compresses + r.decompresses
        last[r.buf_id] = max(last.get(r.buf_id, ((-1, -1), None)), ((count, r.last_us), (r.state, r.registers, r.unregisters, r.compresses, r.decompresses)))
    want = {r.buf_id: (r.state, r.registers, r.unregisters, r.compresses, r.decompresses) for r in vram.life_cycle(vram.buffer_events(events)).collect()}
    assert {k: v for k, (_, v) in last.items()} == want and len(rows) > len(want)


def test_life_cycle_by_parts_equals_a_loop(spark):
    import random

    from octavo.operators import vram

    rng = random.Random(5)
    rows = [(rng.randrange(6), datetime(2024, 1, 1) + timedelta(minutes=37 * k), k, rng.randint(1, 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "buf_id bigint, ts timestamp_ntz, event_id bigint, op int").selectExpr("*", "bigint(100) AS size", "IF(buf_id = 3, bigint(100), bigint(40)) AS compressed_size")
    want = {}
    for buf, ts, _, op in rows:
        s = want.setdefault(buf, ["ABSENT", 0, 0, 0, 0, None])
        if op == 1 and s[0] == "ABSENT":
            s[0], s[1], s[5] = "HOT", s[1] + 1, ts
        elif op == 2 and s[0] != "ABSENT":
            s[0], s[2], s[5] = "ABSENT", s[2] + 1, None
        elif op == 3 and s[0] == "HOT" and buf != 3:
            s[0], s[3] = "WARM", s[3] + 1
        elif op == 4 and s[0] == "WARM":
            s[0], s[4], s[5] = "HOT", s[4] + 1, ts
        elif op == 5 and s[0] != "ABSENT":
            s[5] = ts
    for cut in ("date(ts)", "0", "event_id"):
        got = {r.buf_id: [r.state, r.registers, r.unregisters, r.compresses, r.decompresses, r.last_access] for r in vram.life_cycle(df, cut).collect()}
        assert got == want


def test_stream_store_gives_the_pages_back(spark, tmp_path):
    from octavo.functions import codecs
    from octavo.functions.constants import CODECS, PAGE
    from octavo.operators import codes

    def put(seq, page, byte):
        return (7, seq, "put", page, CODECS["wkdm64"], codecs.encode("wkdm64", bytes([byte]) * PAGE))

    batches = [[put(1, 5, 1), put(2, 6, 2), (7, 3, "fault", 5, None, None)], [put(4, 5, 9), (7, 5, "fault", 5, None, None), (7, 6, "remove", 6, None, None), (7, 7, "fault", 6, None, None)],
               [put(8, 1, 3), put(9, 2, 4), (7, 10, "fault", 1, None, None), (8, 11, "fault", 1, None, None)]]
    schema = "owner_id bigint, seq bigint, op string, page_index bigint, algo_id int, code binary"
    (tmp_path / "in").mkdir()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rocks(spark)
    try:
        got = streamed(spark, live.page_store(source, most=2), tmp_path, "append", "store")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = {(r.owner_id, r.seq): (r.what, r.page_index, None if r.page is None else bytes(r.page)[0], r.status) for r in codes.restored(got).collect()}
    assert rows == {(7, 3): ("hit", 5, 1, 0), (7, 5): ("hit", 5, 9, 0), (7, 6): ("removed", 6, 2, 0), (7, 7): ("miss", 6, None, -2),
                    (7, 9): ("drain", 1, 3, 0), (7, 10): ("miss", 1, None, -2), (8, 11): ("miss", 1, None, -2)}


def test_broken_codes_and_first_errors(spark):
    from octavo.functions import codecs
    from octavo.functions.constants import CODECS, PAGE

    good = codecs.encode("wkdm64", b"\1" * PAGE)
    schema = "owner_id bigint, page_index bigint, algo_id int, compressed_len bigint, code binary"
    entries = spark.createDataFrame([(1, 0, CODECS["wkdm64"], 9, good), (1, 1, CODECS["zstd"], 9, b"no frame"), (1, 40, CODECS["lz4"], 9, good), (2, 0, 4, 9, good)], schema)
    wanted = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 40), (2, 0)], "owner_id bigint, page_index bigint")
    got = {(r.owner_id, r.cluster): (r.items, r.failed, r.first_error) for r in store.cluster_restore(wanted, entries).collect()}
    assert got == {(1, 0): (3, 2, -2), (1, 1): (1, 1, -22), (2, 0): (1, 1, -22)}


def test_replacing_and_capacity(spark):
    from octavo.functions.constants import PAGE

    rows = [(1, 0, 0, b"\0" * PAGE), (1, 0, 1, b"\7" * PAGE), (1, 1, 0, b"\1" * PAGE), (1, 1, 1, bytes(range(256)) * 16)]
    now = store.compress_and_replace(spark.createDataFrame(rows, "owner_id bigint, page_index bigint, version int, page binary"))
    from octavo.operators import codes

    got = {r.page_index: bytes(r.page) for r in codes.restored(now).collect()}
    assert got[0] == b"\7" * PAGE and got[1] in (b"\1" * PAGE, bytes(range(256)) * 16)
    pages_ = spark.createDataFrame([(k, 0, bytes([k]) * PAGE) for k in range(5)], "o bigint, i bigint, page binary")
    assert [r.owner_id for r in store.compress_and_store(pages_, "o", "i", most=3).orderBy("owner_id").collect()] == [0, 1, 2]


def test_percentiles_of_hard_series(spark):
    import random

    rng = random.Random(2)
    series = {"ties": [5.0] * 900 + [6.0] * 5, "unit": [rng.random() for _ in range(500)], "wide": [10.0 ** rng.randint(-9, 18) for _ in range(300)], "signs": [rng.uniform(-5, 5) for _ in range(301)], "one": [3.0]}
    df = spark.createDataFrame([(k, x) for k, xs in series.items() for x in xs], "k string, latency_ns double")
    for r in stats.latency_summary(df, "k").collect():
        xs = sorted(series[r.k])
        assert (r.p50, r.p95, r.p99) == tuple(xs[int(p / 100 * (len(xs) - 1))] for p in (50, 95, 99)), r.k


def test_running_sums_by_slices(spark):
    df = spark.createDataFrame([(k % 3, k, k * 7 % 11) for k in range(60)], "pid bigint, at bigint, v bigint")
    got = {(r.pid, r["at"]): r.total for r in stats.running(df, "pid", ["at"], "at div 13", total="v").collect()}
    for pid in range(3):
        total = 0
        for k in range(pid, 60, 3):
            total += k * 7 % 11
            assert got[pid, k] == total


def test_scan_loop_and_report(spark):
    from octavo import report

    results = iter([0, 0, 3, 0] + [0] * 9)
    waits = []

    def wait(seconds):
        waits.append(seconds)
        return len(waits) == 12

    out = live.scan_loop(lambda: next(results), wait)
    assert [x[1] for x in out[:4]] == [3000, 5000, 1000, 3000] and [k for k, x in enumerate(out) if x[2]] == [10]
    config = report.Config()
    assert config.set("scanner_interval_ms", 5) == 100 and config.set("scanner_mark_budget_pages", 1) == 4096 and config.set("scanner_cpu_budget_ms", 5000) == 1000
    with pytest.raises(ValueError):
        config.set("per_process_top_n", 21)
    assert [report.parallel_active(m, c) for m, c in ((0, 8), (1, 1), (2, 1), (2, 2))] == [False, True, False, True]
    views = spark.createDataFrame([(3, 2048)], "pages int, bytes_saved bigint")
    shown = []
    assert report.watch(lambda: views, shown.append, 0.0, type("Stop", (), {"wait": lambda self, s: len(shown) == 2})()) == 2
    assert "2.0K" in shown[0] and report.table(views)[0] == "pages\tbytes_saved" and report.version().startswith("octavo")
    assert any("scanner" in line for line in config.lines()) and report.human_bytes(1536) == "1.5K"


def test_marks_of_weight_files(spark, tmp_path):
    (tmp_path / "w.safetensors").write_bytes(b"\x08\0\0\0\0\0\0\0{}      " + bytes(range(256)) * 20)
    rows = pages.weight_files(spark, str(tmp_path / "w.safetensors")).orderBy("page_no").collect()
    assert len(rows) == 2 and bytes(rows[0].page)[16:20] == b"\0\1\2\3" and bytes(rows[1].page).endswith(b"\0" * 100)


def test_stream_forgets_processes_that_have_ended(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(1, start, 7, "purchase", 10.0), (2, start + timedelta(hours=5), 7, "click", 3.0), (3, start + timedelta(days=20), 8, "purchase", 4.0), (4, start + timedelta(days=40), 9, "view", 4.0)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    (tmp_path / "in").mkdir()
    for k in range(len(rows)):
        df.where(F.col("event_id") == rows[k][0]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rocks(spark)
    try:
        got = streamed(spark, live.ended_pids(source), tmp_path, "append", "ended")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = {r.pid: (r.pages_compressed, r.pages_decompressed, r.bytes_saved) for r in got.collect()}
    assert found[7] == (1, 1, 10) and 9 not in found


def test_scans_go_on_from_their_cursors(spark):
    start = datetime(2024, 1, 1)
    log = spark.createDataFrame([(k % 2, start + timedelta(minutes=k // 4), k) for k in range(40)], "pid bigint, ts timestamp_ntz, event_id bigint")
    cursors, seen = access.no_cursors(log), []
    for _ in range(4):
        batch = access.next_batch(log, cursors, 7)
        seen.append(sorted(r.event_id for r in batch.collect()))
        cursors = access.advanced(batch, cursors)
    assert sorted(sum(seen, [])) == list(range(40)) and [len(x) for x in seen] == [14, 14, 12, 0]
