"""A content-addressed store as a table: bytes under their SHA-256, handles that name them.

blobs: sha256, content. A handle: r2Key ("cas/" and the digest), sha256, type, size, producedAt (ms, or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HYDRATE = 50_000_000
HANDLE = "struct<r2Key:string,sha256:string,type:string,size:bigint,producedAt:bigint>"


def handle(content: Column, kind: Column | str, produced_at: Column | None = None) -> Column:
    """The handle of bytes, or of a text as UTF-8."""
    sha = F.sha2(content.cast("binary"), 256)
    made = F.lit(None).cast("long") if produced_at is None else produced_at.cast("long")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(F.concat(F.lit("cas/"), sha).alias("r2Key"), sha.alias("sha256"), kind.alias("type"), F.octet_length(content).cast("long").alias("size"), made.alias("producedAt"))


def put(rows: DataFrame, content: str) -> DataFrame:
    """sha256, content of the distinct contents of rows: what is stored twice is stored once."""
    return rows.where(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.col(content).cast("binary").alias("content")).dropDuplicates(["sha256"])


def put_new(rows: DataFrame, content: str, blobs: DataFrame) -> DataFrame:
    """Of put(rows), what blobs has not yet: for appending, first write wins."""
    return put(rows, content).join(blobs.select("sha256"), "sha256", "left_anti")


def get(rows: DataFrame, blobs: DataFrame, sha: str = "sha256", size: str = "size") -> DataFrame:
    """rows with content. A digest that is not stored, bytes of another size or of another digest are errors; a null
    digest has null content."""
    b = blobs.select(F.col("sha256").alias("_sha"), F.col("content").alias("_content"))
    joined = rows.join(b, F.col(sha) == F.col("_sha"), "left")
    checked = (
        F.when(F.col(sha).isNull(), F.lit(None).cast("binary"))
        .when(F.col("_content").isNull(), F.raise_error(F.concat(F.lit("handle not found: "), F.col(sha))).cast("binary"))
        .when(F.octet_length("_content") != F.col(size), F.raise_error(F.lit("size mismatch")).cast("binary"))
        .when(F.sha2("_content", 256) != F.col(sha), F.raise_error(F.lit("sha256 mismatch")).cast("binary"))
        .otherwise(F.col("_content"))
    )
    return joined.withColumn("content", checked).drop("_sha", "_content")


def text_of(content: Column) -> Column:
    """Bytes as text: bad UTF-8 becomes U+FFFD, a byte order mark at the start goes."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")


def looks_like_text(content: Column) -> Column:
    """Valid UTF-8 without control characters but tab, line feed, return."""
    s = content.cast("string")
    return F.is_valid_utf8(s) & ~F.regexp_like(F.make_valid_utf8(s), F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F�]"))


def hydrate(rows: DataFrame, data: str = "base64", kind: str = "type") -> DataFrame:
    """rows of base64 texts with content and handle. What is no base64, or above the limit, is an error."""
    raw = F.try_to_binary(F.col(data), F.lit("base64"))
    checked = F.when(F.col(data).isNotNull() & raw.isNull(), F.raise_error(F.lit("not base64")).cast("binary")).when(F.octet_length(raw) > MAX_HYDRATE, F.raise_error(F.lit("input is too large")).cast("binary")).otherwise(raw)
    rows = rows.withColumn("content", checked)
    return rows.withColumn("handle", handle(F.col("content"), F.coalesce(F.col(kind), F.lit("application/octet-stream"))))


def dehydrate(rows: DataFrame, blobs: DataFrame, of: str = "handle") -> DataFrame:
    """rows with the handle replaced by its base64 text, type and size."""
    flat = rows.withColumns({"_s": F.col(of)["sha256"], "_n": F.col(of)["size"]})
    out = get(flat, blobs, "_s", "_n")
    return out.withColumn(of, F.struct(F.base64("content").alias("base64"), F.col(of)["type"].alias("type"), F.col(of)["size"].alias("size"))).drop("_s", "_n", "content")


def stamp(of: Column, now_ms: Column) -> Column:
    return of.withField("producedAt", now_ms.cast("long"))


def wrap(of: Column) -> Column:
    return F.struct(of.alias("handle"))


def unwrap(of: Column) -> Column:
    """The handle field of a struct; null where the struct or the field is is an error."""
    return F.when(of["handle"].isNull(), F.raise_error(F.lit("unwrapHandle: no handle")).cast(HANDLE)).otherwise(of["handle"])
