"""Page sources: tables of text, bytes or vectors, and files, as rows of 4 KiB pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import PAGE
from ..operators import stats


def chunked(df: DataFrame, data: Column, *keys: str) -> DataFrame:
    """(keys, page_no, page): binary data cut into pages, the last one zero-padded; empty data has none.

    The pages are cut before the explode, so that no row carries its whole source.
    """
    cut = F.expr(f"""transform(sequence(0, (length(__d) - 1) div {PAGE}),
        i -> rpad(substring(__d, i * {PAGE} + 1, {PAGE}), {PAGE}, X'00'))""")
    # an outer explode: for the inner one the optimizer adds a filter that cuts the pages once more
    return df.select(*keys, data.alias("__d")).where("length(__d) > 0").select(*keys, cut.alias("__p")).select(
        *keys, F.posexplode_outer("__p").alias("page_no", "page"))


def text_pages(documents: DataFrame) -> DataFrame:
    return chunked(documents, F.encode("text", "UTF-8"), "doc_id", "lang")


def html_pages(pages: DataFrame) -> DataFrame:
    return chunked(pages, F.encode("html", "UTF-8"), "page_id")


def chat_pages(conversations: DataFrame) -> DataFrame:
    """A conversation's turns in order, as one text.

    The text itself is never put together: a turn's place comes from the lengths
    before it, its bytes are cut at the pages' edges, and a page gathers its pieces.
    """
    turns = conversations.where("text IS NOT NULL AND text <> ''").select("conv_id", "turn", "role", "text", F.encode("text", "UTF-8").alias("d"))
    placed = stats.running(turns, "conv_id", ["turn", "role", "text"], "turn div 256", end="length(d)").selectExpr("conv_id", "d", "end - length(d) AS o")
    cut = F.expr(f"""transform(sequence(o div {PAGE}, (o + length(d) - 1) div {PAGE}), p -> struct(int(p) AS page_no,
        greatest(o, p * {PAGE}) AS at, substring(d, int(greatest(0, p * {PAGE} - o) + 1), int((p + 1) * {PAGE} - greatest(o, p * {PAGE}))) AS piece))""")
    pieces = placed.select("conv_id", F.inline_outer(cut))
    return pieces.groupBy("conv_id", "page_no").agg(F.expr(
        f"rpad(concat_ws('', transform(array_sort(collect_list(struct(at, hex(piece) AS h))), x -> x.h)), {2 * PAGE}, '0')").alias("h")).select(
        "conv_id", "page_no", F.unhex("h").alias("page"))


def quantized(embeddings: DataFrame) -> DataFrame:
    """(vec_id, row): a vector as signed bytes, one line of a page, in two hex digits each."""
    digit = "lpad(hex((int(floor(double(x) * 127)) + 256) % 256), 2, '0')"
    return embeddings.select("vec_id", F.expr(f"array_join(transform(embedding, x -> {digit}), '')").alias("row"))


def weight_pages(embeddings: DataFrame) -> DataFrame:
    """Pages of 64 vectors whose ids follow each other; a missing vector is a zero line, and of repeated ids the greatest row counts."""
    rows = quantized(embeddings).select(F.expr("vec_id div 64").alias("group_id"), F.expr("vec_id % 64").alias("line"), "row")
    rows = rows.groupBy("group_id", "line").agg(F.max("row").alias("row"))
    whole = rows.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("line", "row"))).alias("m"))
    hex_page = F.expr("array_join(transform(sequence(0, 63), k -> coalesce(try_element_at(m, bigint(k)), repeat('00', 64))), '')")
    return whole.select("group_id", F.lit(0).alias("page_no"), F.unhex(hex_page).alias("page"))


def int_pages(lineitem: DataFrame) -> DataFrame:
    """An order's integer columns as 8-byte little-endian words."""
    swapped = ", ".join(f"substr(lpad(hex({{c}}), 16, '0'), {k}, 2)" for k in range(15, 0, -2))
    columns = ("l_orderkey", "l_partkey", "l_suppkey", "bigint(l_linenumber)")
    row = F.expr("concat(" + ", ".join(swapped.format(c=c) for c in columns) + ")")
    rows = lineitem.select(F.expr("l_orderkey div 128").alias("group_id"), "l_orderkey", "l_linenumber", row.alias("row"))
    whole = rows.groupBy("group_id").agg(F.expr(
        "array_join(transform(array_sort(collect_list(struct(l_orderkey, l_linenumber, row))), x -> x.row), '')").alias("h"))
    return chunked(whole, F.unhex("h"), "group_id")


def page_dumps(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, page) of dump files; files that are empty or not whole pages are left out."""
    files = spark.read.format("binaryFile").load(path).where(f"length > 0 AND length % {PAGE} = 0")
    return chunked(files, F.col("content"), "path")


def padded_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, page) of any files, the last page zero-padded."""
    return chunked(spark.read.format("binaryFile").load(path), F.col("content"), "path")


def weight_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, page) of safetensors files, taken whole; their headers aren't read."""
    return padded_files(spark, path)
