"""Column expressions: classifiers, tiers, bit packing, bounds, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CODECS, PAGE, TIERS


def advise_library() -> Column:
    """Codec id by the library's order of tests, from profile columns."""
    return F.expr(f"""CASE
        WHEN zero_byte_frac_x256 >= 250 THEN {CODECS['same_page']}
        WHEN most_common_count >= total_bytes - 4 THEN {CODECS['same_page']}
        WHEN upper32_zero_count > (total_bytes div 8) div 2 THEN {CODECS['wkdm64']}
        WHEN zero_byte_frac_x256 >= 128 THEN {CODECS['wkdm32']}
        WHEN max_byte - min_byte <= 32 THEN {CODECS['bdi']}
        ELSE {CODECS['lz4']} END""")


def advise_kernel() -> Column:
    """Codec id by the kernel's order of tests; other lengths than a page's get LZ4."""
    return F.expr(f"""CASE
        WHEN total_bytes <> {PAGE} THEN {CODECS['lz4']}
        WHEN most_common_count = total_bytes THEN {CODECS['same_page']}
        WHEN zero_bytes * 256 div total_bytes >= 128 AND max_byte - min_byte <= 32 THEN {CODECS['bdi']}
        WHEN zero_bytes * 256 div total_bytes >= 128 THEN {CODECS['wkdm32']}
        WHEN upper32_zero_count > (total_bytes div 8) div 2 THEN {CODECS['wkdm64']}
        ELSE {CODECS['lz4']} END""")


def savings_pct(size: str) -> Column:
    """Whole hundredths saved of a page, truncated."""
    return F.expr(f"(100 * ({PAGE} - {size})) div {PAGE}")


def tier(idle: Column) -> Column:
    out = F.lit(TIERS[0][0])
    for name, above in TIERS[1:]:
        out = F.when(idle > above, name).otherwise(out)
    return out


def page_index(address: Column) -> Column:
    return F.shiftrightunsigned(address, 12)


def address(index: Column) -> Column:
    return F.shiftleft(index, 12)


#: Fixed values of the marker's layout: type 31 in the top five bits, the complement of the offset below.
def marker(index: Column) -> Column:
    """The 64-bit page-table marker of a map index."""
    offset = F.lit(8).cast("bigint").bitwiseOR(F.shiftleft(index, 4))
    return F.shiftrightunsigned(F.shiftleft(F.bitwise_not(offset), 14), 5).bitwiseOR(F.shiftleft(F.lit(31).cast("bigint"), 59))


def marker_type(value: Column) -> Column:
    return F.shiftrightunsigned(value, 59)


def marker_offset(value: Column) -> Column:
    return F.shiftrightunsigned(F.shiftleft(F.bitwise_not(value), 5), 14)


def marker_index(value: Column) -> Column:
    return F.shiftright(marker_offset(value), 4)


def is_marker(value: Column) -> Column:
    return (marker_type(value) == 31) & (marker_offset(value).bitwiseAND(F.lit(8)) != 0)


def human_bytes(n: Column) -> Column:
    """K, M or G with one truncated decimal."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for power, unit in ((1, "K"), (2, "M"), (3, "G")):
        tenths = F.floor(n * 10 / 1024**power)
        out = F.when(n >= 1024**power, F.concat((tenths / 10).cast("decimal(20,1)").cast("string"), F.lit(unit))).otherwise(out)
    return out


def compress_bound(codec: str, n: Column) -> Column:
    """Bytes that the codec's output buffer needs for n bytes of input."""
    spare = n + 256
    bounds = {
        "same_page": F.lit(5),
        "bdi": F.when(n % 64 == 0, 4 + F.floor(n / 64) * 65).otherwise(spare),
        "wkdm32": spare, "wkdm64": spare, "block_class": spare, "ai_fp16": spare, "ai_bf16": spare, "ai_int8": spare,
        "lz4": n + F.floor(n / 255) + 16,
        "lzsse8": n + F.floor(n / 16) + 64,
        "zstd": n + F.floor(n / 256) + F.when(n < 131072, F.floor((131072 - n) / 2048)).otherwise(0),
        "delta": 2 * n,
    }
    return bounds[codec].cast("bigint")


def named(code: Column, names: dict, default: str = "UNKNOWN") -> Column:
    """The name of a code; the default for any other."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))
