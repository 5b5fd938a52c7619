"""Exact dedup by two passes over Bloom filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, Scratch, folded, materialize

#: Bits of a bitmap that bitmap_construct_agg() makes.
_BLOCK = 32768
#: Filters, bits a row in each, and the largest filter: 2**27 bits are 16 MB. More rows are taken in parts, with filters of their own.
FILTERS, BITS_A_ROW, MIN_BITS, MAX_BITS = 2, 8, 1 << 16, 1 << 27


def filter_bits(rows: int) -> int:
    """A power of two, enough for the rows of a part."""
    bits = MIN_BITS
    while bits < min(rows * BITS_A_ROW, MAX_BITS):
        bits *= 2
    return bits


def repeated_cells(hashed: DataFrame, bits: int) -> DataFrame:
    """First pass over column h: the cells of each filter that two rows or more set, as (block, bitmap).

    Rows are counted by cell with partial sums, so a hash with a third of all rows is one row a task.
    There are FILTERS * bits / 32768 blocks of 4 KB at most.
    """
    cells = [F.shiftrightunsigned("h", 32 * k).bitwiseAND(F.lit(bits - 1)) + F.lit(k * bits) for k in range(FILTERS)]
    twice = hashed.select(F.explode(F.array(*cells)).alias("cell")).groupBy("cell").count().filter("count > 1")
    return twice.groupBy(F.expr(f"cell div {_BLOCK}").alias("block")).agg(F.bitmap_construct_agg(F.col("cell") % _BLOCK).alias("bitmap"))


def possibly_repeated(df: DataFrame, blocks: DataFrame, bits: int) -> DataFrame:
    """Adds the column maybe: false proves that no other row has this h. The filters are of bounded size, so they are broadcast."""
    maybe = F.lit(True)
    for k in range(FILTERS):
        cell = F.shiftrightunsigned("h", 32 * k).bitwiseAND(F.lit(bits - 1)) + F.lit(k * bits)
        at = F.broadcast(blocks.select(F.col("block").alias(f"_block{k}"), F.col("bitmap").alias(f"_bitmap{k}")))
        df = df.withColumn(f"_block{k}", F.floor(cell / _BLOCK)).join(at, f"_block{k}", "left").withColumn(f"_pos{k}", cell % _BLOCK)
        byte = F.conv(F.hex(F.expr(f"substring(_bitmap{k}, cast(_pos{k} div 8 as int) + 1, 1)")), 16, 10).cast("int")
        bit = F.getbit(byte, (F.col(f"_pos{k}") % 8).cast("int")) == 1
        maybe = maybe & F.coalesce(bit, F.lit(False))
    return df.withColumn("maybe", maybe).drop(*[f"_{x}{k}" for x in ("block", "bitmap", "pos") for k in range(FILTERS)])


def mark_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every row of docs.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. The row with the largest id
    of equal texts is kept. Rows that repeat both id and text are one document and are all kept or all not;
    a null id never wins against another. Equality is that of SHA-256. An empty table gives an empty one. Other columns
    are carried along under whatever name; those that have the names of those added are replaced.

    The first pass writes the hash of each text, a narrow table, and counts cells of two Bloom filters; in the second
    pass rows whose cells no other row set go straight to the result, and only the others shuffle, to meet the row of
    their group. Groups with over a thousandth of all rows, under a thousand of them, are broadcast to their rows instead.

    A filter has MAX_BITS at most. With more rows than it can tell apart, they are first written in parts by the first
    bits of their hash, and each part has filters of its own, so that these never fill up.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    columns = [c for c in docs.columns if c not in added]
    # The caller's columns travel in one, so that no name of theirs clashes.
    rows = docs.select(F.struct(*columns).alias("row"), F.col(doc_id).alias("id"), F.sha2(folded(F.col(text)), 256).alias("sha"))
    rows = rows.withColumn("h", F.conv(F.substring("sha", 1, 16), 16, -10).cast("long"))
    total = docs.count()
    parts = -(-total * BITS_A_ROW // MAX_BITS)
    if parts <= 1:
        found = _marked(rows, rows.select("id", "sha", "h"), total, total)
    else:
        written = materialize(rows.withColumn("part", F.pmod(F.shiftright("h", 40), F.lit(parts)).cast("int")), "parts", keep=True, by="part")
        each = lambda p: written.filter(F.col("part") == p).drop("part")
        found = reduce(DataFrame.unionByName, [_marked(each(p), each(p).select("id", "sha", "h"), each(p).count(), total) for p in range(parts)])
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], *added)


def _marked(rows: DataFrame, narrow: DataFrame, n: int, total: int) -> DataFrame:
    """row and the added columns, of rows (row, id, sha, h) that hold all of each group."""
    bits = filter_bits(n)
    with Scratch():
        narrow = materialize(narrow, "hashes")
        blocks = materialize(repeated_cells(narrow, bits), "blocks", keep=True)
        groups = possibly_repeated(narrow, blocks, bits).filter("maybe").groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = materialize(groups, "groups", keep=True)
    marked = possibly_repeated(rows, blocks, bits).drop("h")
    is_hot = F.col("group_size") > max(HOT_ROWS, total // HOT_SHARE)
    hot = groups.filter(is_hot).select("sha", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    found = marked.filter("maybe").join(F.broadcast(hot), "sha", "left")
    # A row that has met its hot group joins nothing more; its key is spread.
    found = found.withColumn("key", F.when(F.col("hot_size").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.xxhash64("id"))))
    found = found.join(groups.filter(~is_hot).withColumnRenamed("sha", "key"), "key", "left")
    keep_id = F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_id"))
    found = found.select("row", "id", "sha", keep_id.alias("keep_id"), F.coalesce("hot_size", "group_size").alias("group_size"))
    single = marked.filter("not maybe").select("row", "id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    both = single.unionByName(found)
    return both.select("row", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, see mark_exact_copies()."""
    return mark_exact_copies(docs, doc_id, text).filter("kept").select(*docs.columns)


ORACLE_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
