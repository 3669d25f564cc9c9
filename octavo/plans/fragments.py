"""Shared pieces of the oracle SQL: pages, bytes, words and encoded sizes."""

_CUT = """,
text_pages AS (
  SELECT doc_id, lang, CAST(i AS INTEGER) AS page_no, rpad(substr(hx, CAST(i * 8192 + 1 AS INTEGER), 8192), 8192, '0') AS ph
  FROM (SELECT doc_id, lang, hx, unnest(range((length(hx) + 8191) // 8192)) AS i FROM src))"""
TEXT_PAGES = f"""
src AS (SELECT doc_id, lang, hex(encode(text)) AS hx FROM documents WHERE text IS NOT NULL AND text <> ''){_CUT}"""

#: The same columns over vectors, 64 of them a page, and over integer columns; doc_id is the group.
WEIGHT_PAGES = f"""
quantized AS (
  SELECT vec_id, string_agg(printf('%02X', (CAST(floor(CAST(x AS DOUBLE) * 127) AS INTEGER) + 256) % 256), '' ORDER BY k) AS r
  FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY vec_id),
weights AS (SELECT vec_id // 64 AS g, vec_id % 64 AS line, max(r) AS r FROM quantized GROUP BY ALL),
src AS (
  SELECT g AS doc_id, NULL AS lang, string_agg(coalesce(r, repeat('00', 64)), '' ORDER BY line) AS hx
  FROM (SELECT g, unnest(range(64)) AS line FROM (SELECT DISTINCT g FROM weights)) LEFT JOIN weights USING (g, line) GROUP BY g){_CUT}"""


def _little_endian(column: str) -> str:
    return " || ".join(f"substr(printf('%016X', {column}), {k}, 2)" for k in range(15, 0, -2))


INT_PAGES = f"""
words AS (
  SELECT l_orderkey // 128 AS g, l_orderkey AS o, l_linenumber AS n,
         {' || '.join(_little_endian(c) for c in ('l_orderkey', 'l_partkey', 'l_suppkey', 'CAST(l_linenumber AS BIGINT)'))} AS r FROM lineitem),
src AS (SELECT g AS doc_id, NULL AS lang, string_agg(r, '' ORDER BY o, n, r) AS hx FROM words GROUP BY g){_CUT}"""

#: One byte a row: its place i and value v.
BYTES = """
cut AS (SELECT doc_id, page_no, unnest(regexp_extract_all(ph, '..')) AS b, unnest(range(4096)) AS i FROM text_pages),
bytes AS (
  SELECT doc_id, page_no, i, CAST((strpos('0123456789ABCDEF', substr(b, 1, 1)) - 1) * 16
         + strpos('0123456789ABCDEF', substr(b, 2, 1)) - 1 AS INTEGER) AS v FROM cut)"""

PROFILE = """
hist AS (SELECT doc_id, page_no, v, count(*) AS n FROM bytes GROUP BY ALL),
modes AS (
  SELECT doc_id, page_no, v AS most_common_byte, n AS most_common_count FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n DESC, v) AS k FROM hist) WHERE k = 1),
deltas AS (SELECT doc_id, page_no, v, v - lag(v) OVER (PARTITION BY doc_id, page_no ORDER BY i) AS d FROM bytes),
per_byte AS (
  SELECT doc_id, page_no, count(*) AS total_bytes, count(*) FILTER (v = 0) AS zero_bytes,
         count(*) FILTER (v = 0) * 256 // 4096 AS zero_byte_frac_x256,
         count(*) FILTER (v <= 15 OR v >= 240) AS small_value_count,
         count(*) FILTER (d BETWEEN -16 AND 15) AS small_delta_count, max(v) AS max_byte, min(v) AS min_byte
  FROM deltas GROUP BY doc_id, page_no),
upper AS (
  SELECT doc_id, page_no, count(*) FILTER (substr(w, 9, 8) = '00000000') AS upper32_zero_count
  FROM (SELECT doc_id, page_no, unnest(regexp_extract_all(ph, '.{16}')) AS w FROM text_pages) GROUP BY ALL),
profile AS (SELECT * FROM per_byte JOIN modes USING (doc_id, page_no) JOIN upper USING (doc_id, page_no))"""

ADVISE_LIBRARY = """CASE WHEN zero_byte_frac_x256 >= 250 THEN 0 WHEN most_common_count >= total_bytes - 4 THEN 0
    WHEN upper32_zero_count > 256 THEN 7 WHEN zero_byte_frac_x256 >= 128 THEN 2
    WHEN max_byte - min_byte <= 32 THEN 1 ELSE 3 END"""
ADVISE_KERNEL = """CASE WHEN most_common_count = total_bytes THEN 0
    WHEN zero_byte_frac_x256 >= 128 AND max_byte - min_byte <= 32 THEN 1 WHEN zero_byte_frac_x256 >= 128 THEN 2
    WHEN upper32_zero_count > 256 THEN 7 ELSE 3 END"""


def payload(length: int) -> str:
    """Bytes of a block of that length with nz nonzero bytes and range r."""
    bits = "CASE WHEN r <= 1 THEN 1 WHEN r <= 3 THEN 2 WHEN r <= 7 THEN 3 WHEN r <= 15 THEN 4 WHEN r <= 31 THEN 5 ELSE 6 END"
    return f"""CASE WHEN nz = 0 THEN 0 WHEN r = 0 THEN 1 WHEN nz <= 16 THEN {length // 8} + nz
        WHEN r <= 63 THEN 2 + {length // 8} * ({bits}) ELSE {length} END"""


BLOCKS = """
blocks AS (
  SELECT doc_id, page_no, i // 64 AS block, count(*) FILTER (v <> 0) AS nz, max(v) - min(v) AS r
  FROM bytes GROUP BY ALL)"""
BLOCK_TYPE = "CASE WHEN nz = 0 THEN 0 WHEN r = 0 THEN 2 WHEN nz <= 16 THEN 1 WHEN r <= 63 THEN 3 ELSE 4 END"


def _dictionary(name: str, chars: int, slot: str, zero: str, header: int) -> str:
    """Sizes of a dictionary codec: a word is exact when its slot's last nonzero word equals it."""
    half = chars // 2
    return f"""
{name}_words AS (
  SELECT doc_id, page_no, w, lag(w) OVER (PARTITION BY doc_id, page_no, {slot} ORDER BY i) AS p FROM (
    SELECT doc_id, page_no, unnest(regexp_extract_all(ph, '.{{{chars}}}')) AS w, unnest(range({8192 // chars})) AS i FROM text_pages)
  WHERE w <> '{zero}'),
{name} AS (
  SELECT t.doc_id, t.page_no, {header} + coalesce(sum(CASE WHEN p = w THEN 1 WHEN substr(w, {half + 1}, {half}) = '{zero[:half]}' THEN {half // 2}
         WHEN w IS NOT NULL THEN {half} END), 0) AS sz
  FROM text_pages t LEFT JOIN {name}_words USING (doc_id, page_no) GROUP BY ALL)"""


def _bdi(name: str, low: int, high: int) -> str:
    return f"""
{name} AS (
  SELECT doc_id, page_no, 4 + sum(CASE WHEN hi = 0 AND lo = 0 AND base = 0 THEN 1 WHEN hi = 0 AND lo = 0 THEN 9
         WHEN lo >= {low} AND hi <= {high} THEN 17 ELSE 65 END) AS sz
  FROM (SELECT doc_id, page_no, i // 8 AS line, min(n) - arg_min(n, i) AS lo, max(n) - arg_min(n, i) AS hi, arg_min(n, i) AS base
        FROM numbers GROUP BY ALL) GROUP BY ALL)"""


#: 64-bit little-endian words as exact numbers, from the bytes.
NUMBERS = """
numbers AS (
  SELECT doc_id, page_no, i // 8 AS i, sum(CAST(v AS HUGEINT) * CAST(pow(2, 8 * (i % 8)) AS HUGEINT)) AS n
  FROM bytes GROUP BY doc_id, page_no, i // 8)"""

SIZE_PARTS = {
    "same_page": ["""
same_page AS (SELECT doc_id, page_no, CASE WHEN max(v) = min(v) THEN 5 ELSE 4096 END AS sz FROM bytes GROUP BY ALL)"""],
    "same_page_kernel": ["""
same_page_kernel AS (SELECT doc_id, page_no, CASE WHEN max(v) = min(v) THEN 1 ELSE 4096 END AS sz FROM bytes GROUP BY ALL)"""],
    "bdi": [NUMBERS, _bdi("bdi", -128, 127)],
    "bdi_ref": [NUMBERS, _bdi("bdi_ref", -255, 255)],
    "wkdm32": [_dictionary("wkdm32", 8, "substr(w, 1, 1)", "00000000", 268)],
    "wkdm64": [_dictionary("wkdm64", 16, "(strpos('0123456789ABCDEF', substr(w, 1, 1)) - 1) * 2 + (strpos('0123456789ABCDEF', substr(w, 2, 1)) - 1) // 8", "0" * 16, 140)],
    "block_class": [BLOCKS, f"""
block_class AS (SELECT doc_id, page_no, 28 + sum({payload(64)}) AS sz FROM blocks GROUP BY ALL)"""],
    "ai_fp16": [f"""
ai_fp16 AS (
  SELECT doc_id, page_no, 100 + sum({payload(32)}) AS sz FROM (
    SELECT doc_id, page_no, i // 64 AS block, i % 2 AS half, count(*) FILTER (v <> 0) AS nz, max(v) - min(v) AS r
    FROM bytes GROUP BY ALL) GROUP BY ALL)"""],
    "ai_int8": [f"""
ai_int8 AS (
  SELECT doc_id, page_no, 28 + sum({payload(64)}) AS sz FROM (
    SELECT doc_id, page_no, i // 64 AS block, count(*) FILTER (x <> 0) AS nz, max(x) - min(x) AS r FROM (
      SELECT doc_id, page_no, i, xor(v, coalesce(lag(v, 64) OVER (PARTITION BY doc_id, page_no ORDER BY i), 0)) AS x FROM bytes)
    GROUP BY ALL) GROUP BY ALL)"""],
}
SIZED = ("same_page", "bdi", "wkdm32", "wkdm64", "block_class", "ai_fp16", "ai_int8")
IDS = {"same_page": 0, "bdi": 1, "wkdm32": 2, "wkdm64": 7, "block_class": 8, "ai_fp16": 9, "ai_int8": 11}


def with_parts(*parts: str) -> str:
    return "WITH " + ",".join(dict.fromkeys(parts))


def sizes(*codecs: str, pages: str = TEXT_PAGES) -> list[str]:
    return [pages, BYTES] + [p for c in codecs for p in SIZE_PARTS[c]]


def size_columns(*codecs: str, pages: str) -> str:
    """(group_id, page_no, size_...) of pages of that kind."""
    columns = ", ".join(f"CASE WHEN {c}.sz < 4096 THEN CAST({c}.sz AS BIGINT) END AS size_{c}" for c in codecs)
    joins = " ".join(f"JOIN {c} ON t.doc_id = {c}.doc_id AND t.page_no = {c}.page_no" for c in codecs)
    return f"{with_parts(*sizes(*codecs, pages=pages))} SELECT t.doc_id AS group_id, t.page_no, {columns} FROM text_pages t {joins}"


#: Every page and codec: encoded_size is null where the codec doesn't shrink the page.
MATRIX = [*sizes(*SIZED), """
matrix AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT doc_id, page_no, '{c}' AS codec, {k} AS pos, {IDS[c]} AS algo, CASE WHEN sz < 4096 THEN CAST(sz AS BIGINT) END AS encoded_size FROM {c}"
    for k, c in enumerate(SIZED)) + ")"]
BEST = [*MATRIX, """
best AS (
  SELECT t.doc_id, t.lang, t.page_no, b.algo AS best_algo, b.encoded_size AS best_size FROM text_pages t LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY encoded_size, pos) AS k
    FROM matrix WHERE encoded_size IS NOT NULL) b ON t.doc_id = b.doc_id AND t.page_no = b.page_no AND k = 1)"""]
STORE = [*BEST, """
store AS (
  SELECT doc_id AS owner_id, CAST(page_no AS BIGINT) AS page_index, best_algo AS algo_id, best_size AS compressed_len
  FROM best WHERE best_size IS NOT NULL AND (100 * (4096 - best_size)) // 4096 >= 13)"""]

OPS = """
ops AS (
  SELECT ts, event_id, user_id AS pid, user_id % 5 AS uid, substr(event_type, 1, 15) AS comm,
         CASE WHEN event_type IN ('click', 'view') THEN 'decompress' ELSE 'compress' END AS op,
         CAST(floor(value) AS BIGINT) AS bytes_saved, 100 + event_id % 900 AS ns FROM events)"""
SUMS = """count(*) FILTER (op = 'compress') AS pages_compressed, count(*) FILTER (op = 'decompress') AS pages_decompressed,
         CAST(coalesce(sum(bytes_saved) FILTER (op = 'compress'), 0) AS BIGINT) AS bytes_saved,
         CAST(coalesce(sum(ns) FILTER (op = 'compress'), 0) AS BIGINT) AS compress_ns,
         CAST(coalesce(sum(ns) FILTER (op = 'decompress'), 0) AS BIGINT) AS decompress_ns"""
PER_PID = f"""
first_event AS (SELECT pid, arg_min(uid, (ts, event_id)) AS uid, arg_min(comm, (ts, event_id)) AS comm FROM ops GROUP BY pid),
per_pid AS (SELECT pid, f.uid, f.comm, s.* EXCLUDE (pid) FROM (SELECT pid, {SUMS} FROM ops GROUP BY pid) s JOIN first_event f USING (pid))"""
LOG = "log AS (SELECT ts, user_id AS owner_id, event_id % 64 AS page_index FROM events)"
FLAGS = """
flags AS (
  SELECT owner_id, page_index, (owner_id + page_index) % 7 <> 0 AS is_anon, (owner_id * 3 + page_index) % 11 = 0 AS is_locked,
         (owner_id + page_index * 5) % 13 = 0 AS is_shared, (owner_id + page_index) % 17 = 0 AS is_io,
         CAST((owner_id + page_index) % 4 AS INTEGER) AS refcount
  FROM (SELECT DISTINCT user_id AS owner_id, event_id % 64 AS page_index FROM events))"""
#: Device buffers by their events: epochs between unregistrations, the first registration of each, and the codings that count.
LIFE_CYCLE = """
ve AS (
  SELECT user_id AS buf_id, ts, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS op,
         4096 * (1 + user_id % 8) AS size, 4096 * (1 + user_id % 8) // (1 + user_id % 4) AS compressed_size,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
ep AS (
  SELECT *, coalesce(sum(CASE WHEN op = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY buf_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM ve),
rf AS (
  SELECT *, min(rn) FILTER (op = 1) OVER (PARTITION BY buf_id, epoch) AS reg, sum(CASE WHEN op = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY buf_id) AS last_epoch FROM ep),
cd AS (
  SELECT buf_id, rn, op, CASE WHEN op = 3 THEN coalesce(prev, 4) = 4 ELSE coalesce(prev, 4) = 3 END AS counts FROM (
    SELECT buf_id, rn, op, lag(op) OVER (PARTITION BY buf_id, epoch ORDER BY rn) AS prev FROM rf WHERE rn > reg AND (op = 4 OR (op = 3 AND compressed_size < size)))),
own AS (SELECT rf.*, cd.op AS coding, coalesce(cd.counts, false) AS counts, epoch = last_epoch AND reg IS NOT NULL AND rn >= reg AS live FROM rf LEFT JOIN cd USING (buf_id, rn)),
life AS (
  SELECT buf_id, CASE WHEN NOT bool_or(live) THEN 'ABSENT' WHEN arg_max(coding, rn) FILTER (live AND coding IS NOT NULL) = 3 THEN 'WARM' ELSE 'HOT' END AS state,
         count(*) FILTER (rn = reg) AS registers, count(*) FILTER (op = 2 AND rn > reg) AS unregisters,
         count(*) FILTER (counts AND op = 3) AS compresses, count(*) FILTER (counts AND op = 4) AS decompresses,
         max(ts) FILTER (live AND (rn = reg OR op = 5 OR (counts AND op = 4))) AS last_access, max(size) AS size, max(compressed_size) AS compressed_size
  FROM own GROUP BY buf_id)"""
FAULTS = "faults AS (SELECT event_id, user_id AS owner_id, event_id % 3 AS page_index FROM events)"
TIER = "CASE WHEN {0} > 64 THEN 'FROZEN' WHEN {0} > 16 THEN 'COLD' WHEN {0} > 4 THEN 'WARM' ELSE 'HOT' END"
BUFFERS = """
bufs AS (
  SELECT vec_id AS buf_id, 4096 * (1 + vec_id % 8) AS size, CAST(vec_id % 6 AS INTEGER) AS weight_format, vec_id % 5 <> 0 AS compressed,
         4096 * (1 + vec_id % 8) // (1 + vec_id % 4) AS compressed_size, vec_id * 7 % 101 AS idle FROM embeddings)"""
