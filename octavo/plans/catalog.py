"""Query catalogue: each entry has a Spark plan, its DuckDB twin and a tag.

Tag ``R`` restates an operation of the reference; tag ``X`` is an extension that
the host engine brings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, scalar
from ..functions.constants import CODEC_NAMES, COMPARED, FORMATS, SIZED
from ..operators import access, codes, pages, stats, store, vram
from ..sources import pages as sources
from ..sources import sinks, synthetic
from ..streaming import twins
from . import fragments as S


@dataclass(frozen=True)
class Query:
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    tag: str


QUERIES: dict[str, Query] = {}
FLAGSHIP = "file_summary"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@dataclass(frozen=True)
class Loader:
    """Gives a table's DataFrame, and the codecs that a query compares."""

    spark: SparkSession
    sf_dir: str
    codecs: tuple[str, ...] = SIZED

    def __call__(self, table: str) -> DataFrame:
        return load(self.spark, self.sf_dir, table)


def query(sql: str | None, tag: str = "R"):
    """Registers a function of a loader."""

    def register(f):
        QUERIES[f.__name__] = Query(lambda spark, sf_dir: f(Loader(spark, sf_dir)), sql, tag)
        return f

    return register


def text_pages(t) -> DataFrame:
    return sources.text_pages(t("documents")).drop("lang")


# --- counters and latencies ---


def ops(t) -> DataFrame:
    return stats.process_events(t("events"))


@query(f"""WITH {S.OPS} SELECT uid, bytes_saved, pages_compressed, pages_decompressed,
  coalesce(compress_ns // nullif(pages_compressed, 0), 0) AS avg_compress_ns,
  coalesce(decompress_ns // nullif(pages_decompressed, 0), 0) AS avg_decompress_ns
FROM (SELECT uid, {S.SUMS} FROM ops GROUP BY uid) ORDER BY bytes_saved DESC, uid LIMIT 5""")
def uid_top_n(t):
    return stats.uid_summary(ops(t))


@query(f"WITH {S.OPS}, {S.PER_PID} SELECT * FROM per_pid")
def per_pid_stats(t):
    return stats.per_pid(ops(t))


@query(f"""WITH {S.OPS}, {S.PER_PID}, firsts AS (SELECT pid, min((ts, event_id)) AS f FROM ops GROUP BY pid ORDER BY f LIMIT 1024)
SELECT * FROM per_pid SEMI JOIN firsts USING (pid)""")
def pid_cap_1024(t):
    return stats.capped(ops(t))


@query(f"""WITH {S.OPS}, {S.PER_PID} SELECT * FROM per_pid
WHERE pid IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-25')""")
def pid_gc_semi(t):
    live = t("events").where("ts >= timestamp_ntz '2024-01-25'").select(F.col("user_id").alias("pid"))
    return stats.live_only(stats.per_pid(ops(t)), live)


def _latency_sql(by: str) -> str:
    part, group = (f"PARTITION BY {by}", f"GROUP BY {by}") if by else ("", "")
    picks = ", ".join(f"max(x) FILTER (k = CAST(floor({p} / 100.0::DOUBLE * (n - 1)) AS BIGINT)) AS p{p}" for p in (50, 95, 99))
    keys = f"{by}, " if by else ""
    return f"""WITH s AS (SELECT event_type, value AS x FROM events WHERE value IS NOT NULL),
r AS (SELECT {keys}x, row_number() OVER ({part} ORDER BY x) - 1 AS k, count(*) OVER ({part}) AS n FROM s)
SELECT {keys}{picks}, round(avg(x), 6) AS mean_ns, min(x) AS min_ns, max(x) AS max_ns, round(sum(x), 4) AS total_ns, count(*) AS n FROM r {group}"""


def _latencies(t, *by):
    found = stats.latency_summary(t("events").select(*by, F.col("value").alias("latency_ns")), *by)
    return found.withColumns({"mean_ns": F.round("mean_ns", 6), "total_ns": F.round("total_ns", 4)})


@query(_latency_sql(""))
def latency_summary(t):
    return _latencies(t)


@query(_latency_sql("event_type"))
def latency_by_type(t):
    return _latencies(t, "event_type")


@query(f"""WITH {S.OPS}, g AS (SELECT {S.SUMS}, count(DISTINCT pid) AS processes FROM ops)
SELECT * FROM (UNPIVOT g ON COLUMNS(*) INTO NAME key VALUE value)""")
def global_stats_kv(t):
    return sinks.key_values(stats.global_gauges(ops(t)))


@query(f"""WITH {S.OPS} SELECT op, count(*) AS n, CAST(sum(ns) AS BIGINT) AS total_ns,
  round(count(*) * 1000000000.0::DOUBLE / sum(ns), 4) AS pages_per_s FROM ops GROUP BY op""")
def scan_rate(t):
    return ops(t).groupBy("op").agg(F.count("*").alias("n"), F.sum("ns").alias("total_ns")).withColumn(
        "pages_per_s", F.round(F.col("n") * F.lit(1e9) / F.col("total_ns"), 4))


RESULTS = "CASE WHEN event_id % 11 = 0 THEN -2 WHEN event_id % 7 = 0 THEN -12 WHEN comm = 'error' THEN -22 ELSE 0 END"


@query(f"""WITH {S.OPS}, r AS (SELECT pid, ts, event_id, {RESULTS} AS status FROM ops)
SELECT pid, count(*) AS items, count(*) FILTER (status <> 0) AS failed,
  coalesce(arg_min(status, (CASE WHEN status = -2 THEN 0 ELSE 1 END, ts, event_id)) FILTER (status <> 0), 0) AS first_error FROM r GROUP BY pid""")
def first_error(t):
    """The first code that isn't zero; one of a lookup goes before the others."""
    return stats.first_errors(ops(t).select("pid", F.struct("ts", "event_id").alias("place"), F.expr(RESULTS).alias("status")), "pid")


@query(f"""WITH {S.OPS} SELECT event_id, CAST(sum(CASE WHEN op = 'compress' THEN 1 ELSE -1 END) OVER w AS BIGINT) AS stored_pages,
  CAST(sum(CASE WHEN op = 'compress' THEN 4096 - bytes_saved ELSE bytes_saved - 4096 END) OVER w AS BIGINT) AS stored_bytes,
  CAST(sum(CASE WHEN op = 'compress' THEN bytes_saved ELSE 0 END) OVER w AS BIGINT) AS saved_bytes
FROM ops WINDOW w AS (PARTITION BY pid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_gauges(t):
    """Pages and bytes in the store after each operation; what was saved is never taken back."""
    return stats.running(
        ops(t), "pid", ["ts", "event_id"], "date(ts)", stored_pages="IF(op = 'compress', 1, -1)",
        stored_bytes="IF(op = 'compress', 4096 - bytes_saved, bytes_saved - 4096)", saved_bytes="IF(op = 'compress', bytes_saved, 0)").select(
        "event_id", "stored_pages", "stored_bytes", "saved_bytes")


# --- pages ---


@query(f"WITH {S.TEXT_PAGES} SELECT doc_id, page_no, md5(ph) AS page_md5 FROM text_pages")
def page_chunks(t):
    return text_pages(t).select("doc_id", "page_no", F.md5(F.hex("page")).alias("page_md5"))


@query(f"WITH {S.TEXT_PAGES} SELECT lang, count(*) AS n_pages, count(DISTINCT doc_id) AS n_docs FROM text_pages GROUP BY lang")
def page_count_by_lang(t):
    return sources.text_pages(t("documents")).groupBy("lang").agg(F.count("*").alias("n_pages"), F.countDistinct("doc_id").alias("n_docs"))


def _other_pages(source: str, key: str) -> str:
    return f"""SELECT {key}, CAST(i AS INTEGER) AS page_no, md5(rpad(substr(hx, CAST(i * 8192 + 1 AS INTEGER), 8192), 8192, '0')) AS page_md5
FROM (SELECT {key}, hx, unnest(range((length(hx) + 8191) // 8192)) AS i FROM ({source}))"""


@query(_other_pages("SELECT page_id, hex(encode(html)) AS hx FROM pages WHERE html IS NOT NULL", "page_id"))
def html_pages(t):
    return sources.html_pages(t("pages")).select("page_id", "page_no", F.md5(F.hex("page")).alias("page_md5"))


@query(_other_pages("SELECT conv_id, hex(encode(string_agg(text, '' ORDER BY turn, role, text))) AS hx FROM conversations GROUP BY conv_id", "conv_id"))
def chat_pages(t):
    return sources.chat_pages(t("conversations")).select("conv_id", "page_no", F.md5(F.hex("page")).alias("page_md5"))


@query("""SELECT vec_id, md5(string_agg(printf('%02X', (CAST(floor(CAST(x AS DOUBLE) * 127) AS INTEGER) + 256) % 256), '' ORDER BY k)) AS row_md5
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY vec_id""")
def weight_rows(t):
    return sources.quantized(t("embeddings")).select("vec_id", F.md5("row").alias("row_md5"))


@query(S.size_columns("ai_int8", "ai_fp16", "block_class", pages=S.WEIGHT_PAGES))
def weight_page_sizes(t):
    found = kernels.with_sizes(sources.weight_pages(t("embeddings")), ["ai_int8", "ai_fp16", "block_class"])
    return found.select("group_id", "page_no", "size_ai_int8", "size_ai_fp16", "size_block_class")


@query(S.size_columns("bdi", "wkdm32", "wkdm64", pages=S.INT_PAGES))
def int_page_sizes(t):
    found = kernels.with_sizes(sources.int_pages(t("lineitem")), ["bdi", "wkdm32", "wkdm64"])
    return found.select("group_id", "page_no", "size_bdi", "size_wkdm32", "size_wkdm64")


FORMAT_CODEC = "CASE group_id % 6 WHEN 2 THEN 'ai_bf16' WHEN 3 THEN 'ai_int8' ELSE 'ai_fp16' END"


@query(f"""WITH s AS ({S.size_columns("ai_int8", "ai_fp16", pages=S.WEIGHT_PAGES)}), f AS (
  SELECT group_id, {FORMAT_CODEC} AS codec, CASE group_id % 6 WHEN 3 THEN size_ai_int8 ELSE size_ai_fp16 END AS encoded_size FROM s)
SELECT *, CASE WHEN encoded_size IS NOT NULL THEN true END AS exact FROM f""")
def weight_codes(t):
    """Pages of weights coded and decoded by the coder of their format."""
    pages_ = sources.weight_pages(t("embeddings")).drop("page_no")
    found = codes.with_codes(pages_, ["ai_fp16", "ai_bf16", "ai_int8"])
    return found.where(F.col("codec") == F.expr(FORMAT_CODEC)).select("group_id", "codec", "encoded_size", "exact")


@query(None)
def file_pages(t):
    """Pages of files as they are, the last one zero-padded."""
    found = sources.padded_files(t.spark, f"{t.sf_dir}/nation.parquet")
    return found.select("page_no", F.md5(F.hex("page")).alias("page_md5"))


@query(None)
def synthetic_sizes(t):
    """Pages of every made-up type, and their sizes."""
    found = synthetic.synthetic_pages(t.spark, 4).drop("delta_base")
    return kernels.with_sizes(found, COMPARED)


# --- profiles and classes ---

PROFILE = "total_bytes, zero_bytes, zero_byte_frac_x256, most_common_byte, most_common_count, upper32_zero_count, small_value_count, small_delta_count, max_byte, min_byte"
PROFILE_SQL = S.with_parts(S.TEXT_PAGES, S.BYTES, S.PROFILE)


@query(f"{PROFILE_SQL} SELECT doc_id, page_no, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in PROFILE.split(', '))} FROM profile")
def page_profile(t):
    return kernels.with_features(text_pages(t), ["profile"])


@query(f"{S.with_parts(S.TEXT_PAGES, S.BYTES)} SELECT v AS byte, count(*) AS n FROM bytes GROUP BY v")
def byte_histogram(t):
    return kernels.byte_counts(text_pages(t).select("page"))


@query(f"{PROFILE_SQL} SELECT most_common_byte, count(*) AS pages, CAST(sum(most_common_count) AS BIGINT) AS n FROM (SELECT CAST(most_common_byte AS BIGINT) AS most_common_byte, most_common_count FROM profile) GROUP BY 1")
def byte_mode(t):
    return kernels.with_features(text_pages(t), ["profile"]).groupBy("most_common_byte").agg(
        F.count("*").alias("pages"), F.sum("most_common_count").alias("n"))


@query(f"{PROFILE_SQL} SELECT doc_id, CAST(sum(small_delta_count) AS BIGINT) AS small_deltas FROM profile GROUP BY doc_id")
def small_delta(t):
    return kernels.with_features(text_pages(t), ["profile"]).groupBy("doc_id").agg(F.sum("small_delta_count").alias("small_deltas"))


@query(f"{PROFILE_SQL} SELECT doc_id, CAST(sum(upper32_zero_count) AS BIGINT) AS upper32_zero FROM profile GROUP BY doc_id")
def upper32_zero(t):
    return kernels.with_features(text_pages(t), ["profile"]).groupBy("doc_id").agg(F.sum("upper32_zero_count").alias("upper32_zero"))


@query(f"""{S.with_parts(S.TEXT_PAGES, S.BYTES, S.BLOCKS)} SELECT doc_id, page_no, count(*) FILTER (k = 0) AS n_zero, count(*) FILTER (k = 1) AS n_sparse,
  count(*) FILTER (k = 2) AS n_uniform, count(*) FILTER (k = 3) AS n_small_range, count(*) FILTER (k = 4) AS n_dense, CAST(sum(bytes) AS BIGINT) AS payload_bytes
FROM (SELECT doc_id, page_no, {S.BLOCK_TYPE} AS k, {S.payload(64)} AS bytes FROM blocks) GROUP BY doc_id, page_no""")
def block_profile(t):
    return kernels.with_features(text_pages(t), ["blocks"])


@query(f"""{S.with_parts(S.TEXT_PAGES, S.BYTES, S.BLOCKS)} SELECT k AS block_type, count(*) AS n FROM (
  SELECT CASE {S.BLOCK_TYPE} WHEN 0 THEN 'zero' WHEN 1 THEN 'sparse' WHEN 2 THEN 'uniform' WHEN 3 THEN 'small_range' ELSE 'dense' END AS k FROM blocks) GROUP BY k""")
def block_type_dist(t):
    found = kernels.with_features(text_pages(t), ["blocks"])
    names = ("zero", "sparse", "uniform", "small_range", "dense")
    return found.agg(*(F.sum(f"n_{n}").alias(n) for n in names)).unpivot([], list(names), "block_type", "n").where("n > 0")


def _advice(t):
    found = kernels.with_features(text_pages(t), ["profile"])
    return found.select("doc_id", "page_no", scalar.advise_library().alias("library"), scalar.advise_kernel().alias("kernel"))


ADVICE_SQL = f"{PROFILE_SQL}, advice AS (SELECT doc_id, page_no, {S.ADVISE_LIBRARY} AS library, {S.ADVISE_KERNEL} AS kernel FROM profile)"


@query(f"{ADVICE_SQL} SELECT doc_id, page_no, library FROM advice")
def advise_library(t):
    return _advice(t).drop("kernel")


@query(f"{ADVICE_SQL} SELECT doc_id, page_no, kernel FROM advice")
def advise_kernel(t):
    return _advice(t).drop("library")


@query(f"{ADVICE_SQL} SELECT library, kernel, count(*) AS pages FROM advice GROUP BY ALL")
def advise_disagree(t):
    return _advice(t).groupBy("library", "kernel").agg(F.count("*").alias("pages"))


# --- sizes ---


def _size_query(codec: str) -> None:
    sql = f"{S.with_parts(*S.sizes(codec))} SELECT doc_id, page_no, CASE WHEN sz < 4096 THEN CAST(sz AS BIGINT) END AS encoded_size FROM {codec}"

    def plan(t):
        return kernels.with_sizes(text_pages(t), [codec]).withColumnRenamed(f"size_{codec}", "encoded_size")

    plan.__name__ = {"ai_fp16": "size_ai_split16"}.get(codec, f"size_{codec}")
    query(sql)(plan)


for _codec in S.SIZE_PARTS:
    _size_query(_codec)


@query(f"{S.with_parts(*S.MATRIX)} SELECT doc_id, page_no, codec, encoded_size FROM matrix")
def codec_matrix(t):
    return pages.codec_matrix(kernels.with_sizes(text_pages(t), t.codecs), "doc_id", "page_no", codecs=t.codecs)


@query(f"{S.with_parts(*S.MATRIX)} SELECT codec, count(encoded_size) AS can_compress, count(*) AS n FROM matrix GROUP BY codec")
def can_compress(t):
    return pages.codec_matrix(kernels.with_sizes(text_pages(t), t.codecs), "doc_id", "page_no", codecs=t.codecs).groupBy("codec").agg(
        F.count("encoded_size").alias("can_compress"), F.count("*").alias("n"))


def best(t, *, lang: bool = False) -> DataFrame:
    source = sources.text_pages(t("documents")) if lang else text_pages(t)
    return pages.best_codec(kernels.with_sizes(source, t.codecs), t.codecs)


@query(f"{S.with_parts(*S.BEST)} SELECT doc_id, page_no, best_algo, best_size FROM best")
def best_codec(t):
    return best(t).select("doc_id", "page_no", "best_algo", "best_size")


@query(f"""{S.with_parts(*S.BEST, S.PROFILE)} SELECT doc_id, page_no, coalesce(best_algo, {S.ADVISE_LIBRARY}) AS chosen
FROM best JOIN profile USING (doc_id, page_no)""")
def advise_best(t):
    return pages.profiled_best(text_pages(t), t.codecs).select("doc_id", "page_no", "chosen")


@query(f"""{S.with_parts(*S.BEST)} SELECT doc_id, page_no, best_size FROM best
WHERE best_size IS NOT NULL AND (100 * (4096 - best_size)) // 4096 >= 13""")
def savings_filter(t):
    return pages.worthwhile(best(t)).select("doc_id", "page_no", "best_size")


@query(f"""{S.with_parts(*S.BEST)}, s AS (
  SELECT lang, count(*) AS pages, count(*) FILTER (best_size IS NULL) AS incompressible, count(*) * 4096 AS original_bytes,
         CAST(coalesce(sum(best_size), 0) AS BIGINT) AS packed_bytes, CAST(sum(coalesce(best_size, 4096)) AS BIGINT) AS net_bytes FROM best GROUP BY lang)
SELECT *, CASE WHEN packed_bytes > 0 THEN round(original_bytes / CAST(packed_bytes AS DOUBLE), 4) END AS ratio_ref,
  round(original_bytes / CAST(net_bytes AS DOUBLE), 4) AS ratio_net, round(100 * (1 - net_bytes / CAST(original_bytes AS DOUBLE)), 4) AS savings_pct FROM s""")
def file_summary(t):
    return pages.file_summary(best(t, lang=True), "lang")


@query(f"""{S.with_parts(*S.BEST)} SELECT coalesce(CASE best_algo WHEN 0 THEN 'same_page' WHEN 1 THEN 'bdi' WHEN 2 THEN 'wkdm32' WHEN 7 THEN 'wkdm64'
  WHEN 8 THEN 'block_class' WHEN 9 THEN 'ai_fp16' WHEN 11 THEN 'ai_int8' END, 'none') AS algo, count(*) AS pages FROM best GROUP BY 1""")
def algo_distribution(t):
    return best(t).groupBy(scalar.named(F.coalesce("best_algo", F.lit(-1)), CODEC_NAMES, "none").alias("algo")).agg(F.count("*").alias("pages"))


@query(f"""{S.with_parts(*S.MATRIX)} SELECT codec, round(count(*) * 4096 / CAST(sum(encoded_size) AS DOUBLE), 4) AS ratio_ref,
  round(count(*) * 4096 / CAST(sum(coalesce(encoded_size, 4096)) AS DOUBLE), 4) AS ratio_net FROM matrix GROUP BY codec""")
def ratio_ref_vs_net(t):
    total = F.count("*") * 4096
    return pages.codec_matrix(kernels.with_sizes(text_pages(t), t.codecs), "doc_id", "page_no", codecs=t.codecs).groupBy("codec").agg(
        F.round(total / F.sum("encoded_size"), 4).alias("ratio_ref"), F.round(total / F.sum(F.coalesce("encoded_size", F.lit(4096))), 4).alias("ratio_net"))


@query("""SELECT codec, n, CAST(CASE codec WHEN 'same_page' THEN 5 WHEN 'bdi' THEN CASE WHEN n % 64 = 0 THEN 4 + n // 64 * 65 ELSE n + 256 END
  WHEN 'lz4' THEN n + n // 255 + 16 WHEN 'lzsse8' THEN n + n // 16 + 64 WHEN 'zstd' THEN n + n // 256 + CASE WHEN n < 131072 THEN (131072 - n) // 2048 ELSE 0 END
  WHEN 'delta' THEN 2 * n ELSE n + 256 END AS BIGINT) AS bound
FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) * 1000 AS n FROM lineitem UNION SELECT 4096)
CROSS JOIN (SELECT unnest(['same_page', 'bdi', 'wkdm32', 'lz4', 'lzsse8', 'zstd', 'delta', 'wkdm64', 'block_class', 'ai_fp16', 'ai_bf16', 'ai_int8']) AS codec)""")
def compress_bounds(t):
    lengths = t("lineitem").select((F.col("l_linenumber").cast("bigint") * 1000).alias("n")).distinct()
    lengths = lengths.union(lengths.sparkSession.range(1).select(F.lit(4096).cast("bigint"))).distinct()
    rows = F.array(*(F.struct(F.lit(c).alias("codec"), scalar.compress_bound(c, F.col("n")).alias("bound")) for c in CODEC_NAMES.values()))
    return lengths.select("n", F.inline(rows))


# --- codec bytes ---


def _round_trips(t, codecs):
    found = codes.with_codes(text_pages(t), list(codecs))
    return found.groupBy("codec").agg(F.count("encoded_size").alias("encoded"), F.count_if("exact").alias("exact"), F.sum("encoded_size").alias("bytes"))


@query(f"""{S.with_parts(*S.MATRIX)} SELECT codec, count(encoded_size) AS encoded, count(encoded_size) AS exact, CAST(sum(encoded_size) AS BIGINT) AS bytes FROM matrix GROUP BY codec""")
def roundtrip_sized(t):
    """Every code has the size that its formula gives, and decodes to its page."""
    return _round_trips(t, SIZED)


@query(None)
def roundtrip_all(t):
    return _round_trips(t, [*SIZED, "ai_bf16", "lz4", "zstd"])


@query(None)
def encode_lz4(t):
    return codes.with_codes(text_pages(t), ["lz4"]).select("doc_id", "page_no", "encoded_size", "exact")


@query(None)
def encode_zstd(t):
    return codes.with_codes(text_pages(t), ["zstd"]).select("doc_id", "page_no", "encoded_size", "exact")


@query(f"""{S.with_parts(S.TEXT_PAGES, S.BYTES)} SELECT doc_id, page_no, count(*) FILTER (xor(v, b) <> 0) AS changed, CAST(sum(xor(v, b)) AS BIGINT) AS xor_sum
FROM (SELECT doc_id, page_no, v, lag(v) OVER (PARTITION BY doc_id, i ORDER BY page_no) AS b FROM bytes) WHERE b IS NOT NULL GROUP BY doc_id, page_no""")
def delta_xor_pages(t):
    """A page against the document's page before."""
    pairs = text_pages(t).selectExpr("doc_id", "page_no", "page", "lag(page) OVER (PARTITION BY doc_id ORDER BY page_no) AS base").where("base IS NOT NULL")
    return kernels.xor_counts(pairs)


# --- page store ---


def snapshot(t) -> DataFrame:
    return store.snapshot(pages.worthwhile(best(t)), "doc_id", "page_no")


def faults(t) -> DataFrame:
    return t("events").select("event_id", F.col("user_id").alias("owner_id"), (F.col("event_id") % 3).alias("page_index"))


STORE_SQL = S.with_parts(*S.STORE)


@query(f"{STORE_SQL} SELECT * FROM store")
def store_snapshot(t):
    return snapshot(t)


def byte_store(t) -> DataFrame:
    """The entries with their codes."""
    return store.compress_and_store(text_pages(t), "doc_id", "page_no", t.codecs)


#: The page that an entry was made from.
PAGE_OF = "JOIN text_pages t ON t.doc_id = owner_id AND t.page_no = page_index"


@query(f"{STORE_SQL} SELECT *, compressed_len AS code_bytes FROM store")
def store_bytes(t):
    return byte_store(t).withColumn("code_bytes", F.length("code").cast("bigint")).drop("code")


@query(f"""{STORE_SQL}, {S.FAULTS} SELECT event_id, owner_id, page_index, CASE WHEN algo_id IS NULL THEN -2 ELSE 0 END AS status,
  CASE WHEN algo_id IS NOT NULL THEN md5(ph) END AS page_md5
FROM faults LEFT JOIN store USING (owner_id, page_index) LEFT {PAGE_OF}""")
def fault_restore(t):
    """What each fault gets: the page, decoded, or a miss."""
    got = store.fault_restore(faults(t), byte_store(t))
    return got.select("event_id", "owner_id", "page_index", "status", F.md5(F.hex("page")).alias("page_md5"))


@query(f"""{STORE_SQL} SELECT owner_id, page_index, algo_id, 0 AS status, md5(ph) AS page_md5
FROM (SELECT * FROM store ORDER BY owner_id, page_index LIMIT 100) {PAGE_OF}""")
def drain_restore(t):
    """The pages that a drain of 100 entries gives back."""
    got = store.drain_restore(byte_store(t), 100)
    return got.select("owner_id", "page_index", "algo_id", "status", F.md5(F.hex("page")).alias("page_md5"))


@query(f"{STORE_SQL}, {S.FAULTS} SELECT event_id, owner_id, page_index, algo_id, compressed_len FROM faults JOIN store USING (owner_id, page_index)")
def fault_lookup(t):
    return store.lookup(faults(t), snapshot(t))


@query(f"{STORE_SQL}, {S.FAULTS} SELECT event_id, owner_id, page_index FROM faults ANTI JOIN store USING (owner_id, page_index)")
def fault_miss(t):
    return store.misses(faults(t), snapshot(t))


@query(f"""{STORE_SQL}, {S.FAULTS} SELECT count(*) AS markers, count(algo_id) AS restored, count(*) FILTER (algo_id IS NULL) AS failed
FROM faults LEFT JOIN store USING (owner_id, page_index)""")
def restore_counts(t):
    return store.restored(faults(t), snapshot(t))


@query(f"{STORE_SQL}, {S.FAULTS} SELECT * FROM store ANTI JOIN faults USING (owner_id, page_index)")
def store_remove(t):
    return store.remove(snapshot(t), faults(t))


@query(f"{STORE_SQL} SELECT * FROM store ORDER BY owner_id, page_index LIMIT 100")
def drain_n(t):
    return store.drain(snapshot(t), 100)


@query(f"{STORE_SQL} SELECT count(*) AS admitted, CAST(sum(compressed_len) AS BIGINT) AS bytes FROM (SELECT * FROM store ORDER BY owner_id, page_index LIMIT 500)")
def capacity_admit(t):
    return store.admit(snapshot(t), 500).agg(F.count("*").alias("admitted"), F.sum("compressed_len").alias("bytes"))


@query(f"{STORE_SQL} SELECT * FROM store WHERE owner_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)")
def zap_owner(t):
    return store.zap_owners(snapshot(t), t("events").where("event_type = 'error'").select(F.col("user_id").alias("owner_id")))


@query(f"""{STORE_SQL}, wanted AS (SELECT doc_id AS owner_id, CAST(page_no AS BIGINT) AS page_index, ph FROM text_pages),
got AS (SELECT w.owner_id, w.page_index, w.ph, s.algo_id, s.compressed_len FROM wanted w LEFT JOIN store s USING (owner_id, page_index))
SELECT owner_id, page_index // 32 AS cluster, count(*) AS items, count(*) FILTER (algo_id IS NULL) AS failed,
  CASE WHEN count(algo_id) < count(*) THEN -2 ELSE 0 END AS first_error, CAST(coalesce(sum(compressed_len), 0) AS BIGINT) AS bytes,
  md5(coalesce(string_agg(md5(ph), '' ORDER BY page_index) FILTER (algo_id IS NOT NULL), '')) AS pages_md5 FROM got GROUP BY ALL""")
def cluster_decompress(t):
    """All pages asked for in clusters of 32: what is stored is decoded, what isn't fails."""
    wanted = text_pages(t).select(F.col("doc_id").cast("bigint").alias("owner_id"), F.col("page_no").cast("bigint").alias("page_index"))
    return store.cluster_restore(wanted, byte_store(t))


# --- idle pages and tiers ---


def log(t) -> DataFrame:
    return access.access_log(t("events"))


@query(f"""WITH {S.LOG} SELECT owner_id, page_index, max(ts) AS last_ts, count(*) AS accesses FROM log GROUP BY ALL
HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""")
def cold_pages(t):
    return access.cold_pages(log(t), "2024-01-31", 7)


@query(f"""WITH {S.LOG}, touched AS (SELECT DISTINCT owner_id, page_index, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5 AS epoch FROM log),
n AS (SELECT *, lead(epoch) OVER (PARTITION BY owner_id, page_index ORDER BY epoch) AS nx FROM touched)
SELECT epoch + 1 AS epoch, count(*) AS swept FROM n WHERE nx IS NULL OR nx > epoch + 1 GROUP BY 1""")
def mark_sweep_epochs(t):
    return access.sweeps(log(t), "2024-01-01", 5)


@query(f"WITH {S.FLAGS} SELECT * FROM flags WHERE is_anon AND NOT is_locked AND NOT is_shared AND NOT is_io AND refcount <= 2")
def eligible_pages(t):
    return access.eligible(access.page_flags(t("events")))


@query(f"""WITH {S.FLAGS} SELECT CASE WHEN NOT is_anon THEN 'not_anon' WHEN is_io THEN 'io' WHEN is_locked THEN 'locked' WHEN is_shared THEN 'shared'
  WHEN refcount > 2 THEN 'refcount' ELSE 'eligible' END AS reason, count(*) AS n FROM flags GROUP BY 1""")
def scan_counters(t):
    return access.skip_reasons(access.page_flags(t("events")))


@query(f"""WITH {S.FLAGS} SELECT * FROM flags WHERE (page_index * 31 + owner_id) % 16384 NOT IN (
  SELECT (page_index * 31 + owner_id) % 16384 FROM flags WHERE refcount > 2)""")
def skip_list_filter(t):
    flags = access.page_flags(t("events"))
    return access.not_skipped(flags, flags.where("refcount > 2"))


CYCLES = """cycles AS (SELECT user_id AS scanner, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS result FROM events)"""


@query(f"""WITH {CYCLES}, r AS (SELECT *, sum(result) OVER (PARTITION BY scanner ORDER BY cycle) AS island FROM cycles),
k AS (SELECT *, sum(1 - result) OVER (PARTITION BY scanner, island ORDER BY cycle) AS e FROM r)
SELECT scanner, cycle, result, CAST(e AS BIGINT) AS empty_cycles, CAST(CASE WHEN e = 0 THEN 1000 ELSE least(1000 + 2000 * e, 30000) END AS BIGINT) AS interval_ms,
  e > 0 AND e % 8 = 0 AS decays FROM k""")
def adaptive_interval(t):
    cycles = stats.running(t("events"), "user_id", ["ts", "event_id"], "date(ts)", cycle="1").selectExpr(
        "user_id AS scanner", "cycle", "IF(event_type = 'purchase', 1, 0) AS result")
    return access.adaptive_interval(cycles)


@query(f"""WITH {S.LOG}, last AS (SELECT owner_id, page_index, max(ts) AS last_ts, count(*) AS a FROM log GROUP BY ALL)
SELECT {S.TIER.format("date_diff('day', CAST(last_ts AS DATE), DATE '2024-04-01')")} AS tier, count(*) AS pages, CAST(sum(a) AS BIGINT) AS accesses FROM last GROUP BY 1""")
def tier_by_idle(t):
    return access.tiers(log(t), "2024-04-01")


@query(f"""WITH {S.LOG}, g AS (SELECT ts, lag(ts) OVER (PARTITION BY owner_id ORDER BY ts) AS b FROM log)
SELECT {S.TIER.format("date_diff('day', CAST(b AS DATE), CAST(ts AS DATE))")} AS tier, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY 1""")
def tier_transitions(t):
    return access.tier_transitions(log(t))


@query(f"""WITH {S.BUFFERS} SELECT count(*) AS buffers, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (compressed) AS compressed_buffers,
  CAST(sum(compressed_size) FILTER (compressed) AS BIGINT) AS compressed_bytes, CAST(sum(size - compressed_size) FILTER (compressed) AS BIGINT) AS saved_bytes FROM bufs""")
def vram_stats(t):
    return access.buffer_stats(access.buffers(t("embeddings")))


@query(f"""WITH {S.BUFFERS} SELECT {S.TIER.format('idle')} AS tier,
  CASE weight_format WHEN 0 THEN 'FP32' WHEN 1 THEN 'FP16' WHEN 2 THEN 'BF16' WHEN 3 THEN 'INT8' WHEN 4 THEN 'INT4' ELSE 'UNKNOWN' END AS format,
  CASE weight_format WHEN 1 THEN 9 WHEN 2 THEN 10 WHEN 3 THEN 11 ELSE 3 END AS algo, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM bufs GROUP BY ALL""")
def vram_tiers(t):
    algo = F.expr("CASE weight_format WHEN 1 THEN 9 WHEN 2 THEN 10 WHEN 3 THEN 11 ELSE 3 END")
    return access.buffers(t("embeddings")).groupBy(
        scalar.tier(F.col("idle")).alias("tier"), scalar.named(F.col("weight_format"), FORMATS).alias("format"), algo.alias("algo")).agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"))


# --- bits and text ---


@query("""SELECT o_orderkey AS idx,
  CAST((CAST(31 AS HUGEINT) * 576460752303423488) + (CAST(1125899906842623 AS HUGEINT) - 8 - o_orderkey * 16) * 512 - CAST(18446744073709551616 AS HUGEINT) AS BIGINT) AS marker,
  CAST(31 AS BIGINT) AS marker_type, 8 + o_orderkey * 16 AS marker_offset, o_orderkey AS back, true AS is_marker FROM orders""")
def marker_roundtrip(t):
    m = scalar.marker(F.col("o_orderkey"))
    rows = t("orders").select(F.col("o_orderkey").alias("idx"), m.alias("marker"))
    m = F.col("marker")
    return rows.select("idx", "marker", scalar.marker_type(m).alias("marker_type"), scalar.marker_offset(m).alias("marker_offset"),
                       scalar.marker_index(m).alias("back"), scalar.is_marker(m).alias("is_marker"))


@query("SELECT o_orderkey, (o_orderkey * 7919) >> 12 AS page_index, ((o_orderkey * 7919) >> 12) << 12 AS address FROM orders")
def vaddr_index(t):
    at = scalar.page_index(F.col("o_orderkey") * 7919)
    return t("orders").select("o_orderkey", at.alias("page_index"), scalar.address(at).alias("address"))


@query("""SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN printf('%d.%dG', n * 10 // 1073741824 // 10, n * 10 // 1073741824 % 10)
  WHEN n >= 1048576 THEN printf('%d.%dM', n * 10 // 1048576 // 10, n * 10 // 1048576 % 10)
  WHEN n >= 1024 THEN printf('%d.%dK', n * 10 // 1024 // 10, n * 10 // 1024 % 10) ELSE printf('%dB', n) END AS bytes
FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 3 AS n FROM orders)""")
def human_bytes(t):
    return t("orders").select("o_orderkey", scalar.human_bytes(F.col("o_orderkey") * F.col("o_orderkey") * 3).alias("bytes"))


# --- streams and extensions ---


@query(f"WITH {S.OPS}, {S.PER_PID} SELECT * FROM per_pid")
def stream_pid_stats(t):
    return twins.pid_stats(t("events"))


@query(f"""WITH {S.LOG} SELECT owner_id, page_index, max(ts) AS last_ts, count(*) AS accesses FROM log GROUP BY ALL
HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""")
def stream_cold_pages(t):
    return twins.cold_pages(t("events"), "2024-01-31", 7)


SESSIONS = """
s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM n GROUP BY user_id, k"""


@query(f"WITH {SESSIONS}", "X")
def stream_sessions(t):
    return twins.sessions(t("events"))


@query(f"""WITH {S.BUFFERS} SELECT {S.TIER.format('idle')} AS tier, weight_format, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes
FROM bufs GROUP BY ROLLUP ({S.TIER.format('idle')}, weight_format)""", "X")
def tier_rollup(t):
    return access.buffers(t("embeddings")).withColumn("tier", scalar.tier(F.col("idle"))).rollup("tier", "weight_format").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(None, "X")
def approx_codec_users(t):
    return ops(t).groupBy("comm").agg(F.approx_count_distinct("pid").alias("approx_pids"))


@query("""SELECT event_id, user_id, max(ts) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events""", "X")
def asof_last_access(t):
    found = access.last_before(t("events"), "user_id", "IF(event_type = 'purchase', ts, NULL)", "last_purchase")
    return found.select("event_id", "user_id", "last_purchase")


# --- lookups and lifecycle ---


@query("""SELECT i AS algo_id, CASE i WHEN 0 THEN 'same_page' WHEN 1 THEN 'bdi' WHEN 2 THEN 'wkdm32' WHEN 3 THEN 'lz4' WHEN 4 THEN 'lzsse8' WHEN 5 THEN 'zstd'
  WHEN 6 THEN 'delta' WHEN 7 THEN 'wkdm64' WHEN 8 THEN 'block_class' WHEN 9 THEN 'ai_fp16' WHEN 10 THEN 'ai_bf16' WHEN 11 THEN 'ai_int8' END AS name
FROM (SELECT DISTINCT l_linenumber * 3 - 4 AS i FROM lineitem)""")
def registry_lookup(t):
    """Ids outside the registry have no codec."""
    ids = t("lineitem").select((F.col("l_linenumber") * 3 - 4).alias("algo_id")).distinct()
    pairs = F.create_map(*(F.lit(x) for kv in CODEC_NAMES.items() for x in kv))
    return ids.select("algo_id", F.try_element_at(pairs, F.col("algo_id")).alias("name"))


@query(f"{STORE_SQL}, {S.FAULTS} SELECT DISTINCT owner_id, page_index FROM faults SEMI JOIN store USING (owner_id, page_index)")
def is_compressed(t):
    return store.is_stored(faults(t).select("owner_id", "page_index").distinct(), snapshot(t))


@query(f"""{STORE_SQL}, fresh AS (SELECT owner_id, page_index - 1 AS page_index, algo_id, compressed_len FROM store WHERE page_index > 0)
SELECT * FROM store ANTI JOIN fresh USING (owner_id, page_index) UNION ALL SELECT * FROM fresh""")
def store_upsert(t):
    """Every page is written over by its document's next one, if that is worth storing."""
    twice = "inline(array(struct(page_index, 0 AS version), struct(page_index - 1 AS page_index, 1 AS version)))"
    versions = byte_store(t).drop("code").selectExpr("owner_id", "algo_id", "compressed_len", twice)
    return store.latest(versions.where("page_index >= 0"))


@query(f"""{STORE_SQL}, ranges AS (SELECT user_id AS owner_id, min(event_id % 3) AS a, max(event_id % 3) AS b FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT store.* FROM store LEFT JOIN ranges USING (owner_id) WHERE a IS NULL OR page_index NOT BETWEEN a AND b""")
def zap_range(t):
    """Without the pages of a range for each owner."""
    ranges = t("events").where("event_type = 'error'").groupBy(F.col("user_id").alias("owner_id")).agg(
        F.min(F.expr("event_id % 3")).alias("first"), F.max(F.expr("event_id % 3")).alias("last"))
    return store.zap_ranges(snapshot(t), ranges)


@query(f"""{STORE_SQL} SELECT * FROM store SEMI JOIN (SELECT DISTINCT user_id AS owner_id FROM events) USING (owner_id)""")
def compress_pid(t):
    """The pages of the owners that are asked for; others' pages aren't coded."""
    asked = t("events").select(F.col("user_id").alias("doc_id")).distinct()
    found = pages.best_codec(kernels.with_sizes(text_pages(t).join(asked, "doc_id", "left_semi"), t.codecs), t.codecs)
    return store.snapshot(pages.worthwhile(found), "doc_id", "page_no")


@query(f"""WITH {S.OPS} SELECT event_id, pid, (row_number() OVER (PARTITION BY pid ORDER BY ts, event_id) - 1) // 256 AS batch FROM ops""")
def scan_batches(t):
    """A scanner's cursor: batches of 256 of each process, in order."""
    return stats.running(ops(t), "pid", ["ts", "event_id"], "date(ts)", at="1").selectExpr("event_id", "pid", "(at - 1) div 256 AS batch")


@query(f"""WITH {S.OPS}, r AS (SELECT event_id, pid, row_number() OVER (PARTITION BY pid ORDER BY ts, event_id) AS k FROM ops)
SELECT event_id, pid FROM r WHERE k BETWEEN 33 AND 64""")
def scan_resume(t):
    """The second batch of 32 of each process: a scan that goes on from its cursors."""
    log_ = ops(t).select("pid", "ts", "event_id")
    begun = access.no_cursors(log_)
    cursors = access.advanced(access.next_batch(log_, begun, 32), begun)
    return access.next_batch(log_, cursors, 32).select("event_id", "pid")


@query("""WITH r AS (SELECT DISTINCT user_id AS owner_id, event_id % 64 // 16 AS region FROM events)
SELECT owner_id, region FROM r WHERE (owner_id + region) % 5 <> 0 AND (owner_id * 7 + region) % 13 <> 0 AND (owner_id + region * 3) % 11 <> 0
  AND (owner_id * 3 + region) % 7 <> 0 AND (owner_id + region) % 9 <> 0""")
def eligible_regions(t):
    return access.eligible_regions(access.region_flags(t("events"))).select("owner_id", "region")


STATES = """s AS (SELECT owner_id, page_index, CASE WHEN (owner_id + page_index * 3) % 19 = 0 THEN 'absent' WHEN (owner_id * 5 + page_index) % 23 = 0 THEN 'compound'
  WHEN (owner_id + page_index) % 7 = 0 THEN 'not_anon' WHEN (owner_id * 2 + page_index) % 9 = 0 THEN 'not_lru' WHEN (owner_id * 3 + page_index) % 11 = 0 THEN 'mlocked'
  WHEN (owner_id + page_index) % 4 > 2 THEN 'shared' ELSE 'eligible' END AS reason
  FROM (SELECT DISTINCT user_id AS owner_id, event_id % 64 AS page_index FROM events))"""


@query(f"WITH {STATES} SELECT owner_id, page_index FROM s WHERE reason = 'eligible'")
def eligible_states(t):
    return access.eligible_states(access.page_states(t("events")))


@query(f"WITH {STATES} SELECT reason, count(*) AS n FROM s GROUP BY reason")
def state_reasons(t):
    return access.state_reasons(access.page_states(t("events")))


@query(f"""{STORE_SQL} SELECT count(DISTINCT (doc_id, page_no // 32)) AS clusters, count(compressed_len) AS pages, count(*) - count(compressed_len) AS failed,
  CAST(coalesce(sum(compressed_len), 0) AS BIGINT) AS bytes FROM text_pages LEFT JOIN store ON owner_id = doc_id AND page_index = page_no""")
def parallel_stats(t):
    return stats.parallel_stats(cluster_decompress(t))


# --- device buffers ---


def life(t) -> DataFrame:
    return vram.life_cycle(vram.buffer_events(t("events")))


@query(f"WITH {S.LIFE_CYCLE} SELECT * FROM life")
def vram_life_cycle(t):
    return life(t)


@query(f"""WITH {S.LIFE_CYCLE} SELECT count(*) FILTER (state <> 'ABSENT') AS n_bufs, CAST(coalesce(sum(size) FILTER (state <> 'ABSENT'), 0) AS BIGINT) AS total_vram_bytes,
  CAST(sum(compresses * compressed_size) AS BIGINT) AS total_compressed_bytes, CAST(sum(compresses * (size - compressed_size)) AS BIGINT) AS total_saved_bytes,
  CAST(sum(compresses) AS BIGINT) AS compress_count, CAST(sum(decompresses) AS BIGINT) AS decompress_count FROM life""")
def vram_ledger(t):
    return vram.ledger(life(t))


@query(f"""WITH {S.LIFE_CYCLE} SELECT e.event_id, e.user_id AS buf_id, l.state, l.size FROM events e
LEFT JOIN life l ON l.buf_id = e.user_id AND l.state <> 'ABSENT' WHERE e.event_type = 'view'""")
def buffer_lookup(t):
    pointers = t("events").where("event_type = 'view'").select("event_id", F.col("user_id").alias("buf_id"))
    return vram.lookup(pointers, life(t))


@query(f"""WITH {S.LIFE_CYCLE} SELECT buf_id, last_access, size, compressed_size FROM life
WHERE state = 'HOT' AND last_access < TIMESTAMP '2024-01-30' AND compressed_size < size""")
def buffer_sweep(t):
    return vram.idle_sweep(life(t), "2024-01-30").select("buf_id", "last_access", "size", "compressed_size")


@query(f"""{STORE_SQL}, {S.OPS}, {S.FLAGS}, c AS (SELECT {S.SUMS} FROM ops),
a AS (SELECT pages_compressed, pages_decompressed, bytes_saved, compress_ns AS compress_ns_total, decompress_ns AS decompress_ns_total,
  CAST(coalesce(compress_ns // nullif(pages_compressed, 0), 0) AS BIGINT) AS compress_avg_ns, CAST(coalesce(decompress_ns // nullif(pages_decompressed, 0), 0) AS BIGINT) AS decompress_avg_ns FROM c),
p AS (SELECT count(*) AS zswap_pages, CAST(coalesce(sum(compressed_len), 0) AS BIGINT) AS zswap_bytes, CAST(coalesce(sum(4096 - compressed_len), 0) AS BIGINT) AS zswap_saved FROM store),
s AS (SELECT count(*) AS scanner_pages_scanned, count(*) FILTER (is_anon AND NOT is_locked AND NOT is_shared AND NOT is_io AND refcount <= 2) AS scanner_mark_pages,
  count(*) FILTER (NOT (is_anon AND NOT is_locked AND NOT is_shared AND NOT is_io AND refcount <= 2)) AS scanner_pages_skipped,
  count(*) FILTER (is_anon AND NOT is_io AND is_locked) AS scanner_skip_page_mlocked, count(*) FILTER (is_anon AND NOT is_io AND NOT is_locked AND is_shared) AS scanner_skip_page_shared FROM flags),
v AS (SELECT * FROM a CROSS JOIN p CROSS JOIN s)
SELECT * FROM (UNPIVOT v ON COLUMNS(*) INTO NAME key VALUE value)""")
def stat_views(t):
    """The scalar statistics, a row for each."""
    return sinks.key_values(stats.stat_views(ops(t), access.page_flags(t("events")), snapshot(t)))


@query(f"WITH {S.BUFFERS} SELECT buf_id, size, idle FROM bufs WHERE NOT compressed AND idle > 4")
def idle_buffers(t):
    """Buffers that an idle sweep would code now."""
    return access.buffers(t("embeddings")).where("NOT compressed AND idle > 4").select("buf_id", "size", "idle")


@query(f"""WITH {S.BUFFERS} SELECT weight_format, max(CASE weight_format WHEN 1 THEN 9 WHEN 2 THEN 10 WHEN 3 THEN 11 ELSE 3 END) AS labelled,
  max(CASE weight_format WHEN 2 THEN 10 WHEN 3 THEN 11 ELSE 9 END) AS coded, count(*) AS n FROM bufs GROUP BY weight_format""")
def format_mappings(t):
    """The codec that a format is labelled with, and the one that its coder falls back to; they differ for other formats."""
    return access.buffers(t("embeddings")).groupBy("weight_format").agg(
        F.max(F.expr("CASE weight_format WHEN 1 THEN 9 WHEN 2 THEN 10 WHEN 3 THEN 11 ELSE 3 END")).alias("labelled"),
        F.max(F.expr("CASE weight_format WHEN 2 THEN 10 WHEN 3 THEN 11 ELSE 9 END")).alias("coded"), F.count("*").alias("n"))


@query(f"""{S.with_parts(*S.BEST)} SELECT doc_id, page_no FROM best
WHERE best_size IS NULL OR (100 * (4096 - best_size)) // 4096 < 13""")
def incompressible_pages(t):
    """What a scanner remembers so as not to try again."""
    found = best(t)
    return found.select("doc_id", "page_no", "best_size").where(
        F.col("best_size").isNull() | (scalar.savings_pct("best_size") < 13)).drop("best_size")


@query(f"""WITH {S.OPS} SELECT date_trunc('day', ts) AS day, op, count(*) AS n, CAST(sum(ns) AS BIGINT) AS total_ns FROM ops GROUP BY ALL""", "X")
def daily_ops(t):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return ops(t).groupBy(day.alias("day"), "op").agg(F.count("*").alias("n"), F.sum("ns").alias("total_ns"))


# --- all codecs ---

#: The queries above whose codecs are those of SIZED, as their SQL has them; incompressible_pages aside, which has no rows left over the smallest tables.
BY_CODEC = (
    "codec_matrix", "can_compress", "best_codec", "advise_best", "savings_filter", "file_summary", "algo_distribution", "ratio_ref_vs_net",
    "store_snapshot", "store_bytes", "fault_restore", "drain_restore", "fault_lookup", "fault_miss", "restore_counts", "store_remove", "drain_n", "capacity_admit", "zap_owner", "cluster_decompress",
    "is_compressed", "store_upsert", "zap_range", "compress_pid",
)


def _over_all_codecs(name: str) -> None:
    """NAME_all: the query over all codecs of the reference. SQL can't give the sizes of lz4 and zstd."""
    f = globals()[name]

    def plan(spark, sf_dir):
        return f(Loader(spark, sf_dir, COMPARED))

    QUERIES[f"{name}_all"] = Query(plan, None, QUERIES[name].tag)


for _name in BY_CODEC:
    _over_all_codecs(_name)
