"""Tables of the engine as Parquet in one folder: schemas, scans, and the changes the engine makes.

A change writes a new version of a table in full and then switches the name of
the current one, so readers never see half a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators.keyword import postings
from gleanery.session import cut

SCHEMAS = {
    "collections": "id long, name string, description string, created_at timestamp",
    "domain_whitelist": "id long, domain string, enabled boolean, added_at timestamp",
    "documents": "id long, filename string, source_path string, source_url string, ingested_at timestamp, doc_type string, clean_md string, hash string, collection_id long",
    "chunks": "id long, doc_id long, chunk_index int, content string, embedding array<float>, token_count int, start_char int, end_char int",
    "entities": "id long, name string, normalized_name string, entity_type string, doc_id long, chunk_id long, confidence double, embedding array<float>, created_at timestamp",
    "postings": "id long, term string, tf long, n_terms int",
    "relationships": "id long, source_entity_id long, target_entity_id long, relationship_type string, confidence double, evidence_chunk_id long, created_at timestamp",
}


# Rows that a new store starts with.
SEED_DOMAINS = ["arxiv.org", "export.arxiv.org", "paperswithcode.com", "huggingface.co", "openreview.net", "semanticscholar.org"]
SEED_COLLECTIONS = [("default", "Default collection for manually uploaded documents"), ("ai-papers", "AI/ML research papers from arXiv and other sources")]


class Store:
    """root: a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> str | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        done = [x.getPath().getName() for x in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return max(done, default=None)

    def table(self, name: str) -> DataFrame:
        version = self._versions(name)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/{version}")

    def replace(self, name: str, rows: DataFrame) -> None:
        version = self._versions(name)
        fresh = f"{int(version) + 1 if version else 0:08d}"
        columns = [x.split()[0] for x in SCHEMAS[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.root}/{name}/{fresh}")

    def seed(self) -> None:
        """Rows of a new store; those already there stay."""
        now = F.current_timestamp()
        domains = self.spark.createDataFrame([(d, True) for d in SEED_DOMAINS], "domain string, enabled boolean").withColumn("added_at", now)
        self.add("domain_whitelist", domains, ["domain"])
        self.add("collections", self.spark.createDataFrame(SEED_COLLECTIONS, "name string, description string").withColumn("created_at", now), ["name"])

    def add(self, name: str, rows: DataFrame, unique: list[str]) -> None:
        """Insert rows whose unique columns aren't there yet, each combination once; missing columns become null, ids follow the largest."""
        old = self.table(name)
        for part in SCHEMAS[name].split(", "):
            column, kind = part.split()
            rows = rows.withColumn(column, F.col(column).cast(kind) if column in rows.columns else F.lit(None).cast(kind))
        if name == "entities":
            rows = rows.withColumn("normalized_name", normalized("name"))
        fresh = absent(rows, old, unique) if unique else rows
        start = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        # Numbered without gaps, task by task, so that no task sees all rows. One writer at a time, as a change replaces the table.
        fresh = cut(fresh.withColumn("_row", F.monotonically_increasing_id()))
        sizes = fresh.where("id is null").groupBy(F.shiftright("_row", 33).alias("_task")).agg(F.count("*").alias("_n"))
        before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        own = Window.partitionBy("_task").orderBy("_row")
        counted = fresh.where("id is null").withColumn("_task", F.shiftright("_row", 33)).withColumn("_at", F.row_number().over(own)).join(F.broadcast(before), "_task")
        numbered = counted.withColumn("id", F.lit(start) + F.col("_before") + F.col("_at"))
        fresh = fresh.where("id is not null").select(*old.columns).unionByName(numbered.select(*old.columns))
        if name == "chunks":
            self.replace("postings", self.table("postings").unionByName(postings(fresh.select("id", "content"))))
        self.replace(name, old.unionByName(fresh))

    def remove(self, name: str, gone: DataFrame) -> int:
        """Delete the rows with these ids, and what belongs to them; how many rows of the table went."""
        old, ids = self.table(name), gone.select("id").distinct()
        n = old.join(ids, "id", "left_semi").count()
        if name == "documents":
            chunks = self.table("chunks")
            lost = cut(chunks.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select("id"))
            self.replace("postings", self.table("postings").join(lost, "id", "left_anti"))
            self.replace("chunks", chunks.join(lost, "id", "left_anti"))
            self.clear_entities(ids)
        if name == "collections":
            docs, marked = self.table("documents"), ids.select(F.col("id").alias("collection_id"), F.lit(True).alias("gone"))
            self.replace("documents", docs.join(marked, "collection_id", "left").withColumn("collection_id", F.when(F.col("gone").isNull(), F.col("collection_id"))))
        self.replace(name, old.join(ids, "id", "left_anti"))
        return n

    def clear_entities(self, documents: DataFrame) -> int:
        """Delete the entities of the documents with these ids, and their relationships; how many entities went."""
        entities, ids = self.table("entities"), documents.select(F.col("id").alias("doc_id"))
        gone = cut(entities.join(ids, "doc_id", "left_semi").select("id"))
        links = self.table("relationships")
        for end in ("source_entity_id", "target_entity_id"):
            links = links.join(gone.withColumnRenamed("id", end), end, "left_anti")
        self.replace("relationships", links)
        self.replace("entities", entities.join(gone, "id", "left_anti"))
        return gone.count()

    def set_domain(self, domain: str, enabled: bool) -> None:
        t = self.table("domain_whitelist")
        self.replace("domain_whitelist", t.withColumn("enabled", F.when(F.col("domain") == domain, F.lit(enabled)).otherwise(F.col("enabled"))))

    def set_embeddings(self, fresh: DataFrame) -> None:
        """fresh: id, embedding."""
        t = self.table("chunks").join(fresh.select("id", F.col("embedding").alias("new")), "id", "left")
        self.replace("chunks", t.withColumn("embedding", F.coalesce("new", "embedding")))

    def reembed(self, embed, dim: int, rows: int = 100_000, most_failures: int = 10) -> int:
        """Give chunks whose vector isn't of `dim` entries a new one, `rows` at a time; how many were changed.

        Each part is a version of the table, so a job that was broken off goes on
        where it stopped. Ends when nothing is left or `most_failures` parts in a
        row changed nothing.
        """
        done = failures = 0
        while failures < most_failures:
            left = with_dim(self.table("chunks")).where(F.coalesce("dim", F.lit(0)) != dim).orderBy("id").limit(rows)
            fresh = cut(left.select("id", embed(F.col("content")).alias("embedding")).where(F.size("embedding") == dim))
            if not (n := fresh.count()):
                if left.isEmpty():
                    break
                failures += 1
                continue
            self.set_embeddings(fresh)
            done, failures = done + n, 0
        return done

    def stats(self) -> DataFrame:
        return totals(self.table("documents"), self.table("chunks"))

    def document(self, id_: int) -> DataFrame:
        return by_id(self.table("documents"), id_)

    def collection_id(self, name: str) -> int | None:
        row = self.table("collections").where(F.col("name") == name).select("id").first()
        return row.id if row else None

    def whitelist(self) -> DataFrame:
        return self.table("domain_whitelist").orderBy("domain")

    def documents(self, collection_id: int | None = None) -> DataFrame:
        """Documents with their chunk counts, newest first; of one collection if given."""
        docs = self.table("documents")
        return with_counts(docs.where(F.col("collection_id") == collection_id) if collection_id else docs, self.table("chunks"), "id", "doc_id", "chunk_count").orderBy(F.desc("ingested_at"), "id")

    def collections(self) -> DataFrame:
        return with_counts(self.table("collections"), self.table("documents"), "id", "collection_id", "doc_count").orderBy("name")

    def searchable(self, collection_id: int | None = None) -> DataFrame:
        docs = self.table("documents")
        docs = docs.where(F.col("collection_id") == collection_id) if collection_id else docs
        return self.table("chunks").join(docs.select(F.col("id").alias("doc_id"), "filename", "ingested_at", "collection_id"), "doc_id")


def with_counts(rows: DataFrame, counted: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    """rows with the number of `counted` rows that point to each, 0 for none."""
    n = counted.groupBy(F.col(foreign).alias("_key")).agg(F.count("*").alias(name))
    return rows.join(n, rows[key] == n["_key"], "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(0)))


def absent(rows: DataFrame, old: DataFrame, unique: list[str]) -> DataFrame:
    """rows whose unique columns old doesn't have, each combination once."""
    return rows.dropDuplicates(unique).join(old.select(*unique), unique, "left_anti")


def by_id(rows: DataFrame, id_: int) -> DataFrame:
    return rows.where(F.col("id") == id_)


def totals(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks."""
    one = documents.agg(F.count("*").alias("documents"))
    # Both are one row.
    return one.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks"))))


def with_dim(chunks: DataFrame, name: str = "embedding") -> DataFrame:
    """chunks with dim, the entries of their vector; null without one."""
    return chunks.withColumn("dim", F.when(F.col(name).isNotNull(), F.size(name)))


def dimensions(chunks: DataFrame, name: str = "embedding") -> DataFrame:
    """(dim, n): how many chunks have vectors of each size."""
    return with_dim(chunks, name).groupBy("dim").agg(F.count("*").alias("n"))


def of_type(entities: DataFrame, kind: str) -> DataFrame:
    return entities.where(F.col("entity_type") == kind).orderBy("name", "id")


def of_document(entities: DataFrame, doc_id: int) -> DataFrame:
    return entities.where(F.col("doc_id") == doc_id).orderBy("entity_type", "name", "id")


def write_results(rows: DataFrame, path: str) -> None:
    """Results of a run as JSON lines."""
    rows.write.mode("overwrite").json(path)


def normalized(name: str) -> Column:
    return F.lower(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""))


def first_by_name(entities: DataFrame, wanted: str) -> DataFrame:
    """The entity of that normalised name with the smallest id."""
    order = Window.partitionBy("normalized_name").orderBy("id")
    return entities.where(F.col("normalized_name") == wanted.strip().lower()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
