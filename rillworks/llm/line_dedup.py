"""Line dedup [native]: levelled sorted runs of line hashes.

A run is a bucketed, sorted table with one row per line key: two independent
64-bit hashes of the key, the number of documents that hold it and the largest
doc_id among them.  Each batch of documents is summed up per key and merge-anti-
joined with every run: the keys that stay are new to the corpus and become a run
of their own, so that a key lies in exactly one run.  The batch's other rows are
increments to keys known before; they are kept in levels of their own and added to
the runs' rows when totals are asked for.  Runs, increments and batches are hashed
and sorted alike, so no join moves a run.  When a level holds `fanout` tables they
are merged into one of the next, so that a batch meets O(log n) runs.

Only lines whose hash passes a bitmap of the repeated keys are shuffled, and only
rows whose hash passes a bitmap of the rows with drops; the bitmaps have a fixed
size, and what passes by chance is sorted out by the joins.

Defined cases
* null or empty text: one empty line, which no threshold of one code point or more touches;
* a line repeated within a row counts once for it; all its occurrences are dropped or kept together;
* rows that share a doc_id count as separate documents, and all of them keep a line whose largest holder they are;
* a null doc_id is below every other; a line that only such rows hold stays;
* an empty table gives an empty result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.llm.common import ASCII_SPACE, ascii_lower, materialize, plain_unions, remove_path, scratch_path

MIN_CHARS = 40
MIN_DOCS = 5
#: Batches of a table: as many as it holds BATCH_BYTES, and BATCHES at least.
BATCHES, BATCH_BYTES = 4, 1 << 40
FANOUT = 3
#: 64-bit words of a bitmap: 1 MB.
WORDS = 1 << 17


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n")
    return F.transform(lines, lambda line: F.btrim(line, F.lit(ASCII_SPACE)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def summarize(docs: DataFrame, min_chars: int = MIN_CHARS, batch: Column | None = None) -> DataFrame:
    """(h1, h2, n_docs, last_doc) of a batch, or (batch, ...) of several; map-side sums come before the shuffle."""
    long_keys = F.filter(line_keys(F.col("text")), lambda key: F.length(key) >= min_chars)
    by = [] if batch is None else [batch.alias("batch")]
    return (
        docs.select(*by, "doc_id", F.explode(F.array_distinct(long_keys)).alias("key"))
        .select(*["batch"] * len(by), *_hashes(F.col("key")), "doc_id")
        .groupBy(*["batch"] * len(by), "h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
    )


def batch_count(docs: DataFrame) -> int:
    """How many batches a table's size asks for; a size that Spark doesn't know counts as small."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(BATCHES, -(-size // BATCH_BYTES)) if size < 1 << 60 else BATCHES


KEYS = ["h1", "h2"]


class _Levels:
    """Bucketed, sorted tables in levels; `fanout` tables of a level are merged into one of the next."""

    def __init__(self, spark: SparkSession, name: str, buckets: int, fanout: int, disjoint: bool):
        self.spark, self.name, self.buckets, self.fanout, self.disjoint = spark, name, buckets, fanout, disjoint
        self.levels: list[list[tuple[str, str]]] = []
        self._made = 0

    def frames(self) -> list[DataFrame]:
        return [self.spark.table(table) for level in self.levels for table, _ in level]

    def put(self, rows: DataFrame, level: int = 0, parts: tuple[str, ...] = ()) -> DataFrame:
        """Write `rows` (dealt to the buckets already) as a table of a level, in folders by `parts`; returns it."""
        while len(self.levels) <= level:
            self.levels.append([])
        self._made += 1
        table, path = f"{self.name}_{self._made}", scratch_path(self.spark, "line-run")
        writer = rows.write.format("parquet").option("path", path).option("compression", "zstd")
        writer = writer.partitionBy(*parts) if parts else writer
        writer.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).saveAsTable(table)
        self.levels[level].append((table, path))
        return self.spark.table(table)

    def compact(self) -> None:
        """Merge the tables of every level that holds `fanout`."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                merged, self.levels[level] = self.levels[level], []
                self.put(self.merged([self.spark.table(table) for table, _ in merged]).repartition(self.buckets, *KEYS), level + 1)
                self._remove(merged)
            level += 1

    def merged(self, frames: list[DataFrame]) -> DataFrame:
        """All rows of the frames; keys of several are added up, where keys may be in several."""
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.union(frame)
        if self.disjoint:
            return rows
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def _remove(self, tables: list[tuple[str, str]]) -> None:
        for table, path in tables:
            self.spark.sql(f"DROP TABLE {table}")
            remove_path(self.spark, path)

    def drop(self) -> None:
        for level in self.levels:
            self._remove(level)
        self.levels = []


class LineRuns:
    """The levelled runs of one corpus, and the increments to them."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        name, buckets = f"line_runs_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark, self.buckets = spark, buckets
        self.runs = _Levels(spark, name, buckets, fanout, disjoint=True)
        self.increments = _Levels(spark, f"{name}_more", buckets, fanout, disjoint=False)
        plain_unions(spark)

    def add(self, summary: DataFrame) -> DataFrame:
        """Merge-anti-join a batch's summary with every run; what is left is a run of its own, which is returned.

        The rest of the summary, which the new run doesn't hold, is kept as increments.
        `summary` is read twice, so it should be a table.
        """
        fresh, known = summary, self.runs.frames()
        for run in known:
            fresh = fresh.join(run.select(*KEYS).hint("merge"), KEYS, "left_anti")
        new = self.runs.put(fresh)
        if known:
            self.increments.put(summary.join(new.select(*KEYS).hint("merge"), KEYS, "left_anti"))
        return new

    def compact(self) -> None:
        self.runs.compact()
        self.increments.compact()

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, last_doc) of every key: its run's row and the increments to it."""
        rows, more = self.runs.merged(self.runs.frames()), self.increments.frames()
        if not more:
            return rows
        added = self.increments.merged(more).select(*KEYS, F.col("n_docs").alias("more"), F.col("last_doc").alias("later"))
        return rows.join(added, KEYS, "left").select(
            *KEYS, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc")
        )

    def drop(self) -> None:
        self.runs.drop()
        self.increments.drop()


def repeated_keys(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(h1, h2, last_doc) of the keys that at least `min_docs` documents hold, as a table."""
    spark = docs.sparkSession
    runs = LineRuns(spark, fanout)
    # one pass over the texts sums up all batches, into folders that are bucketed as the runs are
    batch = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(batches)).cast("int")
    summed = _Levels(spark, f"{runs.runs.name}_batches", runs.buckets, fanout, disjoint=False)
    found = summed.put(summarize(docs, min_chars, batch).repartition(runs.buckets, *KEYS), parts=("batch",))
    for at in range(batches):
        runs.add(found.where(F.col("batch") == at).drop("batch"))
        if at < batches - 1:  # no batch meets the runs after the last, and totals merges what is left
            runs.compact()
    # written, so that the joins below read plain exchanges on both sides, of which AQE can split a hot line's
    heavy = materialize(runs.totals().where(F.col("n_docs") >= min_docs).select(*KEYS, "last_doc"), "heavy-lines")
    runs.drop()
    summed.drop()
    return heavy


def bitmap(hashes: DataFrame, name: str) -> Callable[[Column], Column]:
    """A test of a column of hashes against those of `hashes` (one column h): true for all of them, and for some others."""
    spark, spot = hashes.sparkSession, lambda h: F.pmod(h, F.lit(WORDS * 64))
    of = lambda h: F.shiftright(spot(h), 6)
    some = hashes.groupBy(of(F.col("h")).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))).alias("bits"))
    every = spark.range(WORDS).select(F.col("id").alias("w")).join(some, "w", "left")
    # WORDS rows, whatever the input
    words = every.agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("rows"))
    table = materialize(words.select(F.col("rows.bits").alias("words")), name)
    return lambda h: F.getbit(F.get(table.scalar(), of(h).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1


def _kept(lines: Column, drops: Column) -> Column:
    """Lines without the positions in `drops` (sorted, from 0), in time linear in both."""
    gap = lambda i: F.when(i == 0, 0).otherwise(F.element_at(drops, F.greatest(i, F.lit(1))) + 1)
    end = lambda i: F.when(i == F.size(drops), F.size(lines)).otherwise(
        F.element_at(drops, F.least(i + 1, F.size(drops)))
    )
    runs = F.transform(F.sequence(F.lit(0), F.size(drops)), lambda i: F.slice(lines, gap(i) + 1, end(i) - gap(i)))
    return F.array_join(F.flatten(runs), "\n")


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """`docs` with its text deduplicated, as (row, kept_text, n_lines, n_dropped); `row` holds all input columns.

    Keys of at least `min_chars` code points that at least `min_docs` documents
    hold lose all their lines except in the largest doc_id holding them.
    """
    heavy = repeated_keys(docs, min_chars, min_docs, batches or batch_count(docs), fanout)
    is_heavy = bitmap(heavy.select(F.col("h1").alias("h")), "heavy-bitmap")
    lines = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), F.posexplode(line_keys(F.col("text"))).alias("pos", "key")
    ).where(F.length("key") >= min_chars)
    drops = (
        lines.select("id", "text_hash", "pos", *_hashes(F.col("key")))
        .where(is_heavy(F.col("h1")))
        .join(heavy.hint("merge"), KEYS)
        .where(~F.col("id").eqNullSafe(F.col("last_doc")))
        .groupBy("id", "text_hash")
        .agg(F.sort_array(F.collect_set("pos")).alias("drops"))
        .select(F.col("id").alias("drop_id"), F.col("text_hash").alias("drop_hash"), "drops")
    )
    drops = materialize(drops, "drops")
    may_drop = bitmap(drops.select(F.col("drop_hash").alias("h")), "drops-bitmap")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("text_hash"))
    whole = F.coalesce(F.col("row.text"), F.lit(""))
    n_lines = F.size(F.split(whole, "\n")).cast("long").alias("n_lines")
    as_is = rows.where(~may_drop(F.col("text_hash"))).select("row", whole.alias("kept_text"), n_lines, F.lit(0).cast("long").alias("n_dropped"))
    same = F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("text_hash") == F.col("drop_hash"))
    cut = rows.where(may_drop(F.col("text_hash"))).join(drops.hint("merge"), same, "left").select(
        "row",
        F.when(F.col("drops").isNull(), whole).otherwise(_kept(F.split(whole, "\n"), F.col("drops"))).alias("kept_text"),
        n_lines,
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return as_is.union(cut)


def dedup_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of `docs`, with the text of each row deduplicated (a null text stays null)."""
    out = dedup_lines(docs, **options)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text")).alias("text")
    return out.select(*[text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
