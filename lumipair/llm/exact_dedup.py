"""Exact deduplication over an extendible-hash index, with DataFrame functions only.

1. *Index.* One pass over the texts writes (doc_id, 64-bit hash) to the shared folder and sums the bytes under every
   hash prefix.
2. *Directory.* A page is addressed by the leading bits of the hash. Starting from one page, the directory doubles, and
   every overfull page splits on its next bit, until a page holds at most ``page_bytes`` or the directory has its full
   depth. All depths are computed in one plan over the prefix sums. The page size grows with the total, so that hashes
   of different texts never overfill a page by their number alone. A hash that would overfill a page by itself is that of
   copies, which no bits can split: it gets a chain of pages of its own, over which its rows are dealt.
3. *Owner tasks.* Every task owns a range of pages, that is, a range of hashes. Inside a page, rows of equal hash form a
   chain; grouping by (hash, text) compares the bytes of the texts. Groups of chained pages meet in a second grouping,
   with one row per page and text.
4. Documents find their group by hash. Where two different texts share a hash, documents are joined by text instead.

Each text is shuffled once, and the hash index, which is small, twice. The directory has at most ``2 ** MAX_DEPTH``
rows of two numbers and the chained hashes, at most one for each page, so that both can be broadcast whatever the input is.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays, a null doc_id being
the smallest; of rows that repeat a doc_id and a text exactly one stays; an empty table gives an empty result; other
columns are never read by ``duplicate_groups`` and are kept by ``drop_copies``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumipair.llm.common import documents, whole_text
from lumipair.shared import written

PAGE_BYTES = 32 * 1024 * 1024
# Bounds the directory: 2 ** 18 rows of 16 bytes. Up to 4 TB a page has PAGE_BYTES; at 100 TB it has 800 MB, and the
# aggregation of its groups spills.
MAX_DEPTH = 18
# A page has at least so many times the mean load of a cell.
CELLS_A_PAGE = 2
ROW_BYTES = 64


def _prefix(hashed: Column, depth: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - depth) if depth else F.lit(0).cast("long")


def _hash(text: Column, hash_bits: int) -> Column:
    """``hash_bits`` below 64 forces collisions, for tests."""
    hashed = F.xxhash64(text)
    return hashed if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(hashed, 64 - hash_bits), 64 - hash_bits)


def page_directory(cells: DataFrame, page_bytes: int, depth: int) -> DataFrame:
    """(cell, page) for every cell of the full depth that holds data.

    ``cells`` has (cell, bytes). A cell that is overfull at full depth is a page. Pages are numbered in hash order.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth")
    every = cells.select("cell", "bytes", level).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - local_depth)"))
    loads = every.groupBy("local_depth", "prefix").agg(F.sum("bytes").alias("load"))
    fits = loads.filter((F.col("load") <= page_bytes) | (F.col("local_depth") == depth))
    placed = (
        every.join(fits, ["local_depth", "prefix"])
        .groupBy("cell").agg(F.min(F.struct("local_depth", "prefix")).alias("page")).select("cell", "page.*")
    )
    pages = placed.groupBy("local_depth", "prefix").agg(F.min("cell").alias("first_cell"))
    # At most 2 ** MAX_DEPTH small rows.
    numbered = pages.selectExpr("local_depth", "prefix", "row_number() over (order by first_cell) - 1L as page")
    return placed.join(numbered, ["local_depth", "prefix"]).select("cell", "page")


def chained_hashes(entries: DataFrame, cells: DataFrame, page_bytes: int, depth: int) -> DataFrame:
    """(hash, cell, load, first, n_pages) of every hash whose own load is above a page; ``first`` counts chained pages.

    Only entries of overfull cells are grouped by hash. There is at most one such hash, and one such cell, for each page.
    """
    overfull = cells.filter(F.col("bytes") > page_bytes).select("cell")
    loads = (
        entries.select("__hash", _prefix(F.col("__hash"), depth).alias("cell"), "bytes")
        .join(F.broadcast(overfull), "cell", "left_semi")
        .groupBy(F.col("__hash").alias("hash"), "cell").agg(F.sum("bytes").alias("load")).filter(F.col("load") > page_bytes)
        .withColumn("n_pages", F.ceil(F.col("load") / page_bytes).cast("long"))
    )
    return loads.selectExpr(
        "hash", "cell", "load", "n_pages",
        "sum(n_pages) over (order by hash rows between unbounded preceding and current row) - n_pages as first",
    )


class Index:
    """The written hash index of a table of texts, its directory, and the grouping of equal texts."""

    def __init__(self, rows: DataFrame, page_bytes: int, hash_bits: int = 64, max_depth: int = MAX_DEPTH):
        """``rows`` has __id, __text (not null), and whatever else is to be carried."""
        self.rows = rows.withColumn("__hash", _hash(F.col("__text"), hash_bits))
        size = F.octet_length("__text").cast("long") + ROW_BYTES
        self.entries = written(self.rows.select("__id", "__hash", size.alias("bytes")), "hash-index")
        total = self.entries.agg(F.sum("bytes")).first()[0] or 0
        page_bytes = max(page_bytes, math.ceil(CELLS_A_PAGE * total / 2 ** max_depth))
        self.depth = min(max_depth, max(1, math.ceil(math.log2(max(1, total / page_bytes))) + 4))
        cells = self.entries.groupBy(_prefix(F.col("__hash"), self.depth).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        cells = written(cells, "hash-cells")
        self.chains = written(chained_hashes(self.entries, cells, page_bytes, self.depth), "hash-chains")
        chained = self.chains.groupBy("cell").agg(F.sum("load").alias("load"))
        others = cells.join(F.broadcast(chained), "cell", "left").select(
            "cell", (F.col("bytes") - F.coalesce("load", F.lit(0))).alias("bytes")
        )
        self.directory = written(page_directory(others, page_bytes, self.depth), "hash-directory")
        self.plain_pages = self.directory.agg(F.coalesce(F.max("page") + 1, F.lit(1))).first()[0]
        chain_pages = self.chains.agg(F.coalesce(F.sum("n_pages"), F.lit(0))).first()[0]
        self.pages = self.plain_pages + chain_pages
        self.has_chains = chain_pages > 0

    def grouped(self, *found: Column) -> DataFrame:
        """(__hash, __text, __n_pages) and the aggregates ``found``, one row per page and text."""
        # Rows of a chain are dealt by id and by the task that reads them, so that rows without ids spread as well, and a
        # task that is run again deals them as before.
        turn = F.pmod(F.xxhash64("__id", F.spark_partition_id()), F.col("n_pages"))
        dealt = (
            self.rows.withColumn("__cell", _prefix(F.col("__hash"), self.depth))
            .join(F.broadcast(self.directory), F.col("__cell") == F.col("cell"))
            .join(F.broadcast(self.chains.select("hash", "first", "n_pages")), F.col("__hash") == F.col("hash"), "left")
            .withColumn("__page", F.coalesce(F.lit(self.plain_pages) + F.col("first") + turn, F.col("page")).cast("int"))
            .withColumn("__n_pages", F.coalesce("n_pages", F.lit(1)))
            .drop("cell", "page", "hash", "first", "n_pages", "__cell")
        )
        # The grouping below needs no exchange of its own: pages are whole in their task.
        owned = dealt.repartitionById(int(self.pages), "__page")
        return owned.groupBy("__page", "__hash", "__text", "__n_pages").agg(*found)


def _id_order(name: str) -> Column:
    """Orders ids with null first; unlike a null, the struct takes part in max and max_by."""
    return F.struct(F.col(name).isNotNull().alias("known"), F.col(name).alias("id"))


def duplicate_groups(docs: DataFrame, page_bytes: int = PAGE_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col("doc_id").alias("__id"), whole_text().alias("__text"))
    index = Index(rows, page_bytes, hash_bits)
    found = (F.max(_id_order("__id")).alias("keep"), F.count(F.lit(1)).alias("n"))
    # Only groups of overflow chains still need their text, to meet their like from other pages.
    per_page = index.grouped(*found).select(
        "__hash", "keep", "n", F.sha2(F.col("__text").cast("binary"), 256).alias("text_sha256"),
        F.when(F.col("__n_pages") > 1, F.col("__text")).alias("chained"), F.monotonically_increasing_id().alias("row"),
    )
    groups = written(per_page, "dedup-groups")
    alone = F.when(F.col("chained").isNull(), F.col("row"))
    groups = groups.groupBy("__hash", "text_sha256", "chained", alone.alias("row")).agg(
        F.max("keep").alias("keep"), F.sum("n").alias("group_size")
    )
    groups = written(groups.select("__hash", "text_sha256", F.col("keep.id").alias("keep_id"), "group_size"), "dedup-merged")
    collided = groups.groupBy("__hash").count().filter("count > 1").select("__hash")
    members = index.entries.select("__id", "__hash")
    if collided.isEmpty():
        return _members(members, groups, ["__hash"])
    collided = written(collided, "dedup-collided")
    plain = _members(members.join(collided, "__hash", "left_anti"), groups, ["__hash"])
    texts = index.rows.join(collided, "__hash", "left_semi")
    by_text = texts.groupBy("__hash", "__text").agg(*found).select(
        "__hash", "__text", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        F.sha2(F.col("__text").cast("binary"), 256).alias("text_sha256"),
    )
    return plain.unionByName(_members(texts, by_text, ["__hash", "__text"]))


def _members(members: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    # Repeated rows are counted, not gathered, and numbered again afterwards, so that exactly one of them can stay.
    repeated = members.groupBy("__id", *keys).agg(F.count(F.lit(1)).alias("times"))
    numbered = repeated.select("__id", *keys, F.explode(F.expr("sequence(1L, times)")).alias("copy"))
    return numbered.join(groups, keys).select(
        F.col("__id").alias("doc_id"), "keep_id", "group_size",
        (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """The documents that stay, with all their columns."""
    rows = docs.select(F.col("doc_id").alias("__id"), whole_text().alias("__text"), F.struct(*[docs[c] for c in docs.columns if c != "text"], F.col("text").isNull().alias("__no_text")).alias("__row"))
    index = Index(rows, page_bytes)
    per_page = index.grouped(F.max_by("__row", _id_order("__id")).alias("__row"), F.max(_id_order("__id")).alias("__keep"))
    kept = per_page
    if index.has_chains:
        chained = per_page.filter("__n_pages > 1").groupBy("__hash", "__text").agg(F.max_by("__row", "__keep").alias("__row"))
        kept = per_page.filter("__n_pages = 1").select("__text", "__row").unionByName(chained.select("__text", "__row"))
    text = F.when(~F.col("__row.__no_text"), F.col("__text")).alias("text")
    return kept.select(*[text if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents(spark, sf_dir))


OP10_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""
