"""Messages delivered more than once (problem 6).

Only identifiers, delivery order and file-row position are shuffled.  The winner of each class
of copies stays, and the positions of the others become deletion vectors: bitmaps of 32,768
rows (Spark's own bitmap functions), only for the stretches of files that lose rows.  The wide
payload is then read in place against those bitmaps and never shuffled: where all bitmaps
together are too large to broadcast, the files are taken in blocks whose bitmaps are not.

Contents are parsed only where they can matter: in rows whose message id and request id also
occur without a uuid.

Defined results: rows with neither a uuid nor a full (message id, request id) pair are
unique; contents compare as JSON values (key order, blanks, escapes and 1 = 1.0 do not
matter; text that is no JSON compares as text; null equals JSON null); the first delivery by
(``order`` columns, position) wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.ids import uuid_key
from ledgerloom.operators.components import connected_components
from ledgerloom.runtime import stage

_BITS = 32768
#: bytes of deletion vectors that are broadcast at once
BROADCAST_BYTES = 64 << 20
#: pairs of ids without a uuid that are broadcast (16 bytes each); beyond, all contents are parsed
LOOSE_PAIRS = 1_000_000


def json_value(c: Column) -> Column:
    """A text that is equal for equal JSON values (objects are kept sorted by key)."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c, F.lit("null"))


def delivery_keys(df: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """(ukey, tkey, *keep): the uuid and, where a row without uuid has the same message id and
    request id, the identity by (message id, request id, content)."""
    whole = F.col("message.id").isNotNull() & F.col("requestId").isNotNull()
    pair = F.when(whole, F.unhex(F.md5(F.concat_ws("\x00", "message.id", "requestId"))))
    loose = stage(df.where(uuid_key(F.col("uuid")).isNull()).select(pair.alias("__pair")).where("__pair is not null").distinct(), "p6-loose")
    ident = F.concat_ws("\x00", "message.id", "requestId", json_value(F.col("message.content")))
    tkey = F.concat(F.lit(b"\x02copy-by-content:").cast("binary"), F.unhex(F.md5(ident)))
    ids = df.select(uuid_key(F.col("uuid")).alias("__ukey"), pair.alias("__pair"), F.col("message"), F.col("requestId"), *[c.alias(f"__{n}") for n, c in keep.items()])
    if loose.count() <= LOOSE_PAIRS:
        ids, matters = ids.join(F.broadcast(loose.withColumn("__loose", F.lit(True))), "__pair", "left"), F.col("__loose")
    else:
        matters = F.col("__pair").isNotNull()
    return ids.select(F.col("__ukey").alias("ukey"), F.when(matters, tkey).alias("tkey"), *[F.col(f"__{n}").alias(n) for n in keep])


def copy_classes(keys: DataFrame) -> DataFrame:
    """Adds ``cls``: equal for copies of one record, transitively; null for a row without any
    identity.  A content identity links its rows only if one of them lacks a uuid."""
    keys = stage(keys, "p6-keys")
    loose = keys.where("ukey is null and tkey is not null").select("tkey").distinct()
    edges = keys.where("ukey is not null and tkey is not null").join(loose, "tkey", "left_semi").select("tkey", "ukey")
    comps = connected_components(edges)
    return (
        keys.withColumn("node", F.coalesce("ukey", "tkey"))
        .join(comps, "node", "left")
        .withColumn("cls", F.coalesce("component", "node"))
        .drop("component", "node")
    )


def losers(df: DataFrame, order: dict[str, Column]) -> DataFrame:
    """(cls, won, *order) of every row that is a later copy, by the ``order`` columns; ``won`` is
    the order of the copy that stays.  Classes of one row never reach the join."""
    names = list(order)
    classed = stage(copy_classes(delivery_keys(df, order)).where("cls is not null").select("cls", F.struct(*names).alias("o")), "p6-classes")
    won = classed.groupBy("cls").agg(F.min("o").alias("won"), F.count("*").alias("n")).where("n > 1").select("cls", "won")
    return classed.join(won, "cls").where("o <> won").select("cls", "won", *[F.col(f"o.{n}").alias(n) for n in names])


def copy_pairs(df: DataFrame, row_id: str = "rec_id", order: list[str] = []) -> DataFrame:
    """(rec_id_1, rec_id_2), every pair of copies: each later copy with the one that stays, and
    the later copies of a class with each other; no class is ever collected."""
    lost = losers(df, {f"o{i}": F.col(f"`{c}`") for i, c in enumerate(order)} | {"r": F.col(f"`{row_id}`")})
    lost = stage(lost.select("cls", F.col("won.r").alias("w"), "r"), "p6-lost")
    several = lost.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
    rows = lost.join(several, "cls", "left_semi")
    a, b = rows.select("cls", F.col("r").alias("rec_id_1")), rows.select("cls", F.col("r").alias("rec_id_2"))
    each = a.join(b, "cls").where("rec_id_1 < rec_id_2").select("rec_id_1", "rec_id_2")
    return lost.select(F.least("w", "r").alias("rec_id_1"), F.greatest("w", "r").alias("rec_id_2")).union(each)


def deletion_vectors(df: DataFrame, order: list[str]) -> DataFrame:
    """(file, bucket, bits): the positions of the later copies in each file, from a Parquet scan."""
    place = {f"o{i}": F.col(f"`{c}`") for i, c in enumerate(order)} | {"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")}
    at = F.col("row") + 1
    return (
        losers(df, place)
        .groupBy("file", F.bitmap_bucket_number(at).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    )


def _file_blocks(vectors: DataFrame) -> list[list[str]]:
    """The files that lose rows, in blocks whose vectors fit a broadcast each.  What comes to the
    driver is a row per file, as Spark's own listing of them does."""
    size = F.sum(F.octet_length("bits") + F.octet_length("file") + 16).alias("n")
    blocks, room = [], 0
    for r in vectors.groupBy("file").agg(size).orderBy("file").toLocalIterator():
        if not blocks or r.n > room:
            blocks.append([])
            room = BROADCAST_BYTES
        blocks[-1].append(r.file)
        room -= r.n
    return blocks


def deduplicate(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """The table at ``path`` (Parquet) with one copy of each record; all columns as stored."""
    wide = spark.read.parquet(path)
    vectors = stage(deletion_vectors(wide, order), "p6-vectors")
    mark = "__lost"
    while any(c.startswith(mark) for c in wide.columns):  # names that no column of the table has
        mark += "_"
    file, bucket, bits, bit = (f"{mark}{x}" for x in ("f", "b", "m", "p"))
    own = [F.col(f"`{c}`") for c in wide.columns]
    at = F.col("_metadata.row_index") + 1
    byte = F.ascii(F.decode(F.substring(F.col(bits), F.floor(F.col(bit) / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    lost = F.getbit(byte, F.pmod(F.col(bit), F.lit(8)).cast("int")) == 1

    def without_lost(rows: DataFrame, side: DataFrame) -> DataFrame:
        placed = rows.select(*own, F.col("_metadata.file_path").alias(file), F.bitmap_bucket_number(at).alias(bucket), F.bitmap_bit_position(at).alias(bit))
        return placed.join(F.broadcast(side.toDF(file, bucket, bits)), [file, bucket], "left").where(~F.coalesce(lost, F.lit(False))).select(*own)

    blocks = _file_blocks(vectors)
    if len(blocks) <= 1:
        return without_lost(wide, vectors)
    here = F.col("_metadata.file_path")
    out = wide.where(~here.isin([f for b in blocks for f in b])).select(*own)
    for b in blocks:
        out = out.union(without_lost(wide.where(here.isin(b)), vectors.where(F.col("file").isin(b))))
    return out
