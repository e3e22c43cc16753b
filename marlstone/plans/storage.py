"""The index on disk: segments, what is gone from them, and statistics that are kept up by differences.

A *segment* holds chunks, vectors and postings (in folders by term hash, sorted by term) that were written together and never change.  A
*version* names its segments and has the nodes that are gone from them, document frequencies, totals and a manifest of the source files.
``refresh`` compares the manifest with the chunks at hand and tokenises changed files only: their chunks become a new segment, the
old nodes of changed and deleted files are marked as gone, and what their postings held is subtracted from the
statistics, so that scores are those of an index that is built anew.  Where segments or gone nodes become many, the postings that are left are
written as one segment, without tokenising.  Writers exclude each other by a lock; readers see all of one version.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records as D
from ..operators import retrieve as R
from ..sources import sinks

#: Folders that the postings are split into by term, so that a question reads those of its terms only.
TERM_FOLDERS = 64
#: Bytes of text, and postings, that a task of the shuffle by term has to sort: there are more tasks for more texts, so none needs more memory.
PART_BYTES, PART_ROWS = 4 << 20, 400_000
#: Bytes of text that a task tokenises: what it sends by term waits in its memory, which must not follow the files' sizes.
TEXT_BYTES = 16 << 20
#: Segments of a version at most, and the share of nodes that may be gone, before all is written as one segment.
MOST_SEGMENTS, MOST_GONE = 8, 0.25


@dataclass(frozen=True)
class Index:
    chunks: DataFrame
    keyword: R.KeywordIndex
    #: node_id, embedding.
    vectors: DataFrame
    #: True if the postings have the column ``folder`` that a question's terms select.
    split: bool = False
    #: The folder of the version that it was loaded from.
    version: str | None = None


def folder_of(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_FOLDERS)).cast("int")


def _parts(spark: SparkSession, size: int, most: int) -> int:
    """Tasks that hold ``most`` of a size each, and at least one a core where there is enough to do."""
    return max(size // most, min(spark.sparkContext.defaultParallelism, 16 * size // most)) + 1


def _write_by_folder(blocks: DataFrame, at: str, parts: int) -> None:
    """Postings in folders, of ``R.blocks``: one shuffle, in which blocks' hashes split every folder and so every frequent term; ``parts`` tasks have evenly many of these."""
    salts = -(-4 * parts // TERM_FOLDERS)
    dealt = blocks.withColumn("folder", folder_of("term"))
    key = F.col("folder") * salts + F.pmod(F.xxhash64(F.col("nodes")[0]), F.lit(salts)).cast("int")
    dealt = dealt.repartitionById(parts, F.pmod(key, F.lit(parts))).sortWithinPartitions("folder", "term")
    R.out_of_blocks(dealt, "folder").write.partitionBy("folder").parquet(at)


def _read_postings(spark: SparkSession, at: str, node_type: str) -> DataFrame:
    return spark.read.schema(f"term string, node_id {node_type}, dl int, tf long, folder int").parquet(at)  # without rows there is nothing to infer from


def _totals(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: n chunks, those with a text, and the length of all."""
    counts = chunks.agg(F.count("*").alias("n"), F.count("text").alias("texts"))
    return counts.crossJoin(postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("length")))  # a row beside a row


def _write_statistics(spark: SparkSession, df: DataFrame, totals, at: str) -> None:
    """terms (with idf) and stats of a version from term frequencies (term, df) and the row of totals."""
    R.weighted(df, totals.n).write.parquet(f"{at}/terms")
    average = float(totals.length) / max(totals.texts, 1)
    row = {"n": int(totals.n), "texts": int(totals.texts), "length": int(totals.length)}
    spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in row.items()], F.lit(average or 1.0).alias("avgdl")).coalesce(1).write.parquet(f"{at}/stats")


def _frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def build_keywords(chunks: DataFrame, folder: str, tokenize: R.Tokenize = T.tokens) -> None:
    """Write postings, term statistics and totals of chunks (node_id, text): texts are tokenised once, the rest comes from the postings as written."""
    spark = chunks.sparkSession
    _write_postings(chunks, f"{folder}/postings", tokenize)
    stored = _read_postings(spark, f"{folder}/postings", chunks.schema["node_id"].dataType.simpleString())
    _write_statistics(spark, _frequencies(stored), _totals(chunks, stored).first(), folder)
    chunks.select("node_id").limit(0).write.parquet(f"{folder}/nodes")  # the type of its ids


def _write_postings(chunks: DataFrame, at: str, tokenize: R.Tokenize) -> None:
    spark, size = chunks.sparkSession, chunks.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    words = R.tokenised(chunks.select("node_id", "text").repartition(_parts(spark, size, TEXT_BYTES), "node_id"), tokenize)
    if chunks.groupBy("node_id").count().where("count > 1").isEmpty():
        blocks = R.blocks(words)
    else:  # rows of one node and length are one
        blocks = R.in_blocks(R.counted(words).groupBy("term", "node_id", "dl").agg(F.sum("tf").alias("tf")))
    _write_by_folder(blocks, at, _parts(spark, size, PART_BYTES))


def read_keywords(spark: SparkSession, folder: str) -> R.KeywordIndex:
    """What ``build_keywords`` wrote."""
    kind = spark.read.parquet(f"{folder}/nodes").schema["node_id"].dataType.simpleString()
    return R.KeywordIndex(_read_postings(spark, f"{folder}/postings", kind), spark.read.parquet(f"{folder}/terms"), spark.read.parquet(f"{folder}/stats").first().avgdl)


def manifest(chunks: DataFrame) -> DataFrame:
    """path and digest of each source file: of all columns of its chunks, in any order of rows."""
    named = chunks.select(_path(chunks).alias("path"), F.xxhash64(*chunks.columns).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), *chunks.columns).cast("decimal(38,0)").alias("b"))
    return named.groupBy("path").agg(F.concat_ws(":", F.count("*"), F.sum("a"), F.sum("b")).alias("digest"))


def _path(chunks: DataFrame) -> Column:
    """Chunks without a file are one file; so are all chunks of a table without the column."""
    return F.coalesce("source_file", F.lit("")) if "source_file" in chunks.columns else F.lit("")


class _Version:
    """The tables of a version, over all its segments."""

    def __init__(self, spark: SparkSession, folder: str, at: str):
        read = lambda name: spark.read.parquet(f"{at}/{name}")
        self.spark, self.at = spark, at
        self.names = sorted(r.segment for r in read("segments").collect())  # MOST_SEGMENTS at most
        self.gone, self.terms, self.stats, self.manifest = read("gone"), read("terms"), read("stats"), read("manifest")
        self._folder = folder
        self._kind = self.gone.schema["node_id"].dataType.simpleString()
        self._none_gone = self.gone.isEmpty()

    def _all(self, table: str, alive: bool = True) -> DataFrame:
        def one(name: str) -> DataFrame:
            at = f"{self._folder}/segments/{name}/{table}"
            rows = _read_postings(self.spark, at, self._kind) if table == "postings" else self.spark.read.parquet(at)
            return rows.withColumn("__segment", F.lit(name))

        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, self.names))
        if not alive or self._none_gone:
            return rows
        gone = sinks.few(self.gone)
        return rows.join(gone, (rows["__segment"] == gone["segment"]) & rows["node_id"].eqNullSafe(gone["node_id"]), "left_anti")

    chunks = property(lambda self: self._all("chunks"))
    vectors = property(lambda self: self._all("vectors"))
    postings = property(lambda self: self._all("postings"))

    def index(self) -> Index:
        keyword = R.KeywordIndex(self.postings.drop("__segment"), self.terms, self.stats.first().avgdl)
        return Index(self.chunks.drop("__segment"), keyword, self.vectors.drop("__segment"), split=True, version=self.at)


def _publish(spark: SparkSession, folder: str, segments: list[str], gone: DataFrame, df: DataFrame, totals, files: DataFrame) -> None:
    def write(at: str) -> None:
        spark.range(1).select(F.explode(F.array(*map(F.lit, segments))).alias("segment")).coalesce(1).write.parquet(f"{at}/segments")
        gone.write.parquet(f"{at}/gone")
        files.write.parquet(f"{at}/manifest")
        _write_statistics(spark, df, totals, at)

    sinks.publish_set(spark, folder, write)


def _segment(chunks: DataFrame, vectors: DataFrame, folder: str, tokenize: R.Tokenize) -> tuple[str, DataFrame, DataFrame]:
    """Write a segment; its name, chunks and postings as they are stored."""
    spark, name = chunks.sparkSession, uuid.uuid4().hex
    at = f"{folder}/segments/{name}"
    chunks.write.parquet(f"{at}/chunks")
    vectors.write.parquet(f"{at}/vectors")
    stored = spark.read.schema(chunks.schema).parquet(f"{at}/chunks")
    _write_postings(stored, f"{at}/postings", tokenize)
    return name, stored, _read_postings(spark, f"{at}/postings", chunks.schema["node_id"].dataType.simpleString())


def build(chunks: DataFrame, vectors: DataFrame, folder: str, tokenize: R.Tokenize = T.tokens) -> None:
    """Publish an index of all chunks (node_id, text, source_file, ...) and vectors (node_id, embedding) as one segment."""
    with sinks.only_writer(chunks.sparkSession, folder):
        _build(chunks, vectors, folder, tokenize)


def _build(chunks: DataFrame, vectors: DataFrame, folder: str, tokenize: R.Tokenize) -> None:
    name, stored, postings = _segment(chunks, vectors, folder, tokenize)
    gone = stored.select(F.lit(name).alias("segment"), "node_id").limit(0)
    _publish(chunks.sparkSession, folder, [name], gone, _frequencies(postings), _totals(stored, postings).first(), manifest(stored))


def refresh(chunks: DataFrame, vectors: DataFrame, folder: str, tokenize: R.Tokenize = T.tokens) -> dict[str, int]:
    """Bring the index of a folder to the state of chunks and vectors; how many files were new, modified, deleted and unchanged.

    A file is modified if any column of any of its chunks is, and then all its chunks and their vectors are taken anew.  Without an index one is built; without
    changes nothing is published.  A node belongs to one file.  The tokenizer must be that of the build.
    """
    spark = chunks.sparkSession
    with sinks.only_writer(spark, folder):
        at = sinks.current_set(spark, folder)  # inside the lock: another writer may have been here
        if at is None:
            _build(chunks, vectors, folder, tokenize)
            return {"new": manifest(chunks).count()}
        old = _Version(spark, folder, at)
        files = sinks.kept(manifest(chunks), "manifest")
        diff = sinks.kept(D.manifest_diff(old.manifest, files), "diff")
        counts = {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
        if not counts.keys() - {"unchanged"}:
            return counts
        changed = sinks.few(diff.where("status IN ('new', 'modified')").select("path"))
        left = sinks.few(diff.where("status IN ('deleted', 'modified')").select("path"))
        fresh = chunks.join(changed, _path(chunks) == changed["path"], "left_semi")
        name, added, postings = _segment(fresh, vectors.join(fresh.select("node_id"), "node_id", "left_semi"), folder, tokenize)
        held = old.chunks
        gone_now = sinks.kept(held.join(left, _path(held) == left["path"], "left_semi").select(F.col("__segment").alias("segment"), "node_id", F.col("text").isNotNull().alias("has_text")), "gone")
        mark = sinks.few(gone_now.select("segment", "node_id"))
        was = old.postings
        lost = sinks.kept(was.join(mark, (was["__segment"] == mark["segment"]) & was["node_id"].eqNullSafe(mark["node_id"]), "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), "lost")
        change = _frequencies(postings).unionByName(lost.select("term", (-F.col("df")).alias("df"))).unionByName(old.terms.select("term", "df"))
        df = sinks.kept(change.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"), "frequencies")
        less = gone_now.agg(F.count("*").alias("n"), F.count_if("has_text").alias("texts")).crossJoin(lost.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("length")))
        parts = old.stats.select("n", "texts", "length").unionByName(_totals(added, postings)).unionByName(less.select(*[(-F.col(c)).alias(c) for c in ("n", "texts", "length")]))
        totals = parts.agg(*[F.sum(c).alias(c) for c in ("n", "texts", "length")]).first()
        gone = sinks.kept(old.gone.unionByName(gone_now.select("segment", "node_id")), "gone")
        _publish(spark, folder, [*old.names, name], gone, df, totals, files)
        if len(old.names) + 1 > MOST_SEGMENTS or gone.count() > MOST_GONE * max(totals.n, 1):
            _compact(spark, folder)
        return counts


def _compact(spark: SparkSession, folder: str) -> None:
    """Publish the same index as one segment; nothing is tokenised."""
    old = _Version(spark, folder, sinks.current_set(spark, folder))
    name = uuid.uuid4().hex
    at = f"{folder}/segments/{name}"
    old.chunks.drop("__segment").write.parquet(f"{at}/chunks")
    old.vectors.drop("__segment").write.parquet(f"{at}/vectors")
    kept = old.postings.drop("folder", "__segment")
    _write_by_folder(R.in_blocks(kept), f"{at}/postings", _parts(spark, kept.count(), PART_ROWS))
    _publish(spark, folder, [name], old.gone.limit(0), old.terms.select("term", "df"), old.stats.first(), old.manifest)


def compact(spark: SparkSession, folder: str) -> None:
    with sinks.only_writer(spark, folder):
        _compact(spark, folder)


def load(spark: SparkSession, folder: str) -> Index | None:
    """The published index; None if there is none."""
    at = sinks.current_set(spark, folder)
    return None if at is None else _Version(spark, folder, at).index()


def reloaded(spark: SparkSession, folder: str, index: Index | None) -> Index | None:
    """The index as it is, or the one that was published since it was loaded."""
    at = sinks.current_set(spark, folder)
    return index if index and at in (None, index.version) else load(spark, folder)


_built: dict[tuple[str, str, str], str] = {}


def document_index(spark: SparkSession, sf_dir: str) -> R.KeywordIndex:
    """The keyword index of a folder's documents, built in the working folder by the first query of an application and read by the others.

    It is built anew once the files of the table differ in name, size or time.
    """
    path = f"{sf_dir}/documents.parquet"
    key = (spark.sparkContext.applicationId, sf_dir, sinks.state_of_files(spark, path))
    if key not in _built:
        at = f"{sinks.working_folder(spark)}/keywords-{uuid.uuid4().hex}"
        build_keywords(spark.read.parquet(path).select(F.col("doc_id").alias("node_id"), "text"), at)
        _built[key] = at
    return read_keywords(spark, _built[key])
