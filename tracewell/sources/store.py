"""The store: idempotent upserts, views, ledger, receipts and writers."""

from __future__ import annotations

import json
import os
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S

KEYS = {"records": ["record_id"], "entities": ["entity_id"], "relationships": ["relationship_id"], "chunks": ["chunk_id"], "communications": ["record_id"], "accounts": ["record_id"], "transactions": ["record_id"]}


def upserted(existing: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """S-10: new rows take the place of those with their key; of repeated new keys the last by _seq (or any equal) stays."""
    order = [F.desc("_seq")] if "_seq" in new.columns else [F.lit(0)]
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n", "_seq")
    return new if existing is None else existing.join(new.select(*key), key, "left_anti").unionByName(new)


def write_file(spark: SparkSession, path: str, content: bytes, replace: bool = True) -> None:
    """A small file of the driver's on any file system that Spark reads, put in its place in one step, so a reader never sees a part."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = place.getFileSystem(conf)
    out = files.create(part)
    out.write(bytearray(content))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf)
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if replace else jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context.rename(files.makeQualified(part), files.makeQualified(place), how)


def read_file(spark: SparkSession, path: str) -> bytes | None:
    """A small file's content, or None where there is no file."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return None
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def put_if_absent(spark: SparkSession, path: str, content: bytes) -> bool:
    """Put a small file in its place whole, unless one is there: of several writers exactly one gets True.

    On local folders by a hard link, elsewhere by a rename that must not replace, which name nodes carry out as one step.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    where = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    if where.getScheme() != "file":
        try:
            write_file(spark, path, content, replace=False)
        except Exception as e:  # noqa: BLE001 - the file system's own class of error
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True
    local = where.getPath()
    os.makedirs(os.path.dirname(local), exist_ok=True)
    part = f"{local}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(content)
    try:
        os.link(part, local)
    except FileExistsError:
        return False
    finally:
        os.unlink(part)
    return True


class Store:
    """S-10 to S-13: tables of an evidence store as Parquet batches and a log of numbered commits; an upsert writes its new rows and nothing else.

    A commit names the table's batches, oldest first, and is put only where its number is free: a writer that loses the
    number reads the log again and tries the next one, so no upsert is lost. A reader takes the newest commit (or a given
    one) and of each key the row of the newest batch: one aggregate on the key, which is skipped while there is one batch.
    `compact` commits the merged rows in place of what it read, after which `vacuum` may delete what no kept commit names.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, path: str) -> list[tuple[str, float]]:
        """Names in a folder and when they were last changed, in seconds."""
        place, files = self._files(path)
        return [(x.getPath().getName(), x.getModificationTime() / 1000) for x in files.listStatus(place)] if files.exists(place) else []

    def versions(self, name: str) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self._listed(f"{self.root}/{name}/_log") if n.endswith(".json") and n[:-5].isdigit())

    def _at(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/_log/{version:020d}.json"

    def batches(self, name: str, version: int | None = None) -> tuple[int, list[str]]:
        """(number of the commit, its batches); 0 and none before the first."""
        if version is None:
            version = (self.versions(name) or [0])[-1]
        return version, json.loads(read_file(self.spark, self._at(name, version)) or b"[]") if version else []

    def _commit(self, name: str, change) -> int | None:
        """Put the next commit: `change` makes its batches from those of the newest, or None to give up."""
        while True:
            version, now = self.batches(name)
            then = change(now)
            if then is None:
                return None
            if put_if_absent(self.spark, self._at(name, version + 1), json.dumps(then).encode()):
                return version + 1

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """The table as of a commit, the newest by default; its rows stay readable until a vacuum drops that commit."""
        _, batches = self.batches(name, version)
        if not batches:
            return None
        parts = [self.spark.read.parquet(f"{self.root}/{name}/{b}").withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)]
        if len(parts) == 1:
            return parts[0].drop("_batch")
        every = reduce(DataFrame.unionByName, parts)
        columns = [c for c in every.columns if c != "_batch"]
        newest = every.groupBy(*[F.col(k).alias(f"_key_{k}") for k in KEYS[name]]).agg(F.max_by(F.struct(*columns), "_batch").alias("_row"))
        return newest.select("_row.*")

    def upsert(self, name: str, new: DataFrame) -> int:
        """Of rows of the batch itself that share a key the last by _seq (or any equal) stays. Returns the commit's number."""
        batch = uuid.uuid4().hex
        upserted(None, new, KEYS[name]).write.parquet(f"{self.root}/{name}/{batch}")
        return self._commit(name, lambda now: [*now, batch])

    def compact(self, name: str) -> int | None:
        """One batch in place of those read. Batches committed meanwhile stay behind it; where another compaction came first, None."""
        version, old = self.batches(name)
        merged = self.read(name, version) if len(old) > 1 else None
        if merged is None:
            return None
        batch = uuid.uuid4().hex
        merged.write.parquet(f"{self.root}/{name}/{batch}")
        return self._commit(name, lambda now: [batch, *now[len(old) :]] if now[: len(old)] == old else None)

    def vacuum(self, name: str, keep: int = 1, older_than_s: float = 3600.0) -> int:
        """Delete batches that none of the newest `keep` commits names, and all earlier commits; returns the number of batches gone.

        Batches that are younger stay, named or not: their writer may be about to commit them. Readers of commits that
        are dropped lose their files, so `older_than_s` must exceed the longest read and write.
        """
        versions = self.versions(name)
        named = {b for v in versions[-keep:] for b in self.batches(name, v)[1]}
        limit, gone = time.time() - older_than_s, 0
        for v in versions[:-keep]:
            place, files = self._files(self._at(name, v))
            files.delete(place, False)
        for batch, changed in self._listed(f"{self.root}/{name}"):
            if batch != "_log" and batch not in named and changed <= limit:
                place, files = self._files(f"{self.root}/{name}/{batch}")
                files.delete(place, True)
                gone += 1
        return gone

    def counts(self) -> DataFrame:
        """A-06."""
        return S.table_counts({n: t for n in KEYS if (t := self.read(n)) is not None})

    def views(self) -> None:
        """S-18, J-02 to J-04: the three read views, each typed row with its record's provenance."""
        records = self.read("records")
        for name in ("transactions", "accounts", "communications"):
            if (t := self.read(name)) is not None:
                read_view(t, records).createOrReplaceTempView(f"{name}_v1")


def canonical_records(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """S-17, J-06: the records that a table of record_id names, each once; ids without a record are left out."""
    return records.join(wanted.select("record_id"), "record_id", "left_semi")


def read_view(typed: DataFrame, records: DataFrame) -> DataFrame:
    """S-18."""
    r = records.select("record_id", "source_system", "source_record_id", "source_path", "content_hash")
    refs = F.array(S.source_ref(F.col("record_id"), S.field_locator("payload")))
    rest = [c for c in typed.columns if c != "record_id"]
    return typed.join(r, "record_id").select("record_id", "source_system", "source_record_id", "source_path", "content_hash", refs.alias("source_refs"), *rest)


class Ledger:
    """S-14: runs as an append-only log; a run's outcome is its last entry."""

    SCHEMA = "run_id string, fingerprint string, outcome string, counts string, at timestamp"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _append(self, run: str, mark: str, outcome: str, counts: dict | None = None) -> None:
        row = self.spark.createDataFrame([(run, mark, outcome, json.dumps(counts or {}, sort_keys=True))], "run_id string, fingerprint string, outcome string, counts string")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def start(self, mark: str) -> str:
        run = uuid.uuid4().hex
        self._append(run, mark, "running")
        return run

    def complete(self, run: str, mark: str, counts: dict) -> None:
        self._append(run, mark, "completed", counts)

    def fail(self, run: str, mark: str) -> None:
        self._append(run, mark, "failed")

    def latest(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).groupBy("run_id", "fingerprint").agg(F.max_by("outcome", "at").alias("outcome"), F.max("at").alias("at"))

    def has_completed(self, mark: str) -> bool:
        try:
            return not self.latest().filter((F.col("fingerprint") == mark) & (F.col("outcome") == "completed")).isEmpty()
        except Exception as e:  # noqa: BLE001 - no run yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return False


def read_receipt(path: str, spark: SparkSession | None = None) -> dict | None:
    """S-15: a driver-side file, or with a session one on any file system; absent or malformed counts as none."""
    try:
        if spark is not None:
            got = json.loads(read_file(spark, path) or b"")
        else:
            with open(path, encoding="utf-8") as f:
                got = json.load(f)
    except (OSError, ValueError):
        return None
    return got if isinstance(got, dict) else None


def write_receipt(path: str, receipt: dict, spark: SparkSession | None = None) -> None:
    """S-15: replaced in one step, so a reader never sees a part."""
    if spark is not None:
        return write_file(spark, path, json.dumps(receipt, sort_keys=True).encode())
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(receipt, f, sort_keys=True)
    os.replace(part, path)
    return None


def term_statistics(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """S-16: in place of a text index: postings (term, key, tf, dl) and per term its document frequency."""
    from ..operators.retrieval import tokens

    t = chunks.select(key, tokens(F.col(text)).alias("_t")).select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    postings = t.groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))
    return postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def source_counts(records: DataFrame, chunks: DataFrame, source: str = "source_system") -> DataFrame:
    """A-05: records and chunks of each source (null among them). Each side is summed before they meet, so a source's rows never do.

    A record without chunks counts as a record, and chunks whose record is gone count under no source.
    """
    held = records.select("record_id", source).join(chunks.groupBy("record_id").agg(F.count(F.lit(1)).alias("_n")), "record_id", "left")
    counted = held.groupBy(source).agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("_n"), F.lit(0)).alias("chunks"))
    gone = chunks.join(records.select("record_id"), "record_id", "left_anti").agg(F.count(F.lit(1)).alias("chunks")).filter("chunks > 0")
    lost = gone.select(F.lit(None).cast(records.schema[source].dataType).alias(source), F.lit(0).cast("bigint").alias("records"), "chunks")
    return counted.unionByName(lost).groupBy(source).agg(F.sum("records").alias("records"), F.sum("chunks").alias("chunks"))


def unit_vectors(chunks: DataFrame, vector: str = "embedding", width: int | None = None) -> DataFrame:
    """S-16: vectors of length one; those of another width are nulled, as a changed width asks for new embeddings."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))
    return chunks.withColumn(vector, F.when(F.size(vector) == width, unit) if width else unit)


def sql_literal(c) -> F.Column:
    """S-21: a value as SQL text: quotes doubled, null as NULL."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """S-21: one INSERT a row."""
    values = F.concat_ws(", ", *[sql_literal(F.col(c)) for c in df.columns])
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");")).alias("value"))


def manifest_rows(records: DataFrame) -> DataFrame:
    """S-21: a digest for each record."""
    from ..functions.scalar import line_hash

    return records.select("record_id", line_hash(*[F.col(c) for c in records.columns]).alias("sha256"))


def rebuild_differences(release: DataFrame, rebuild: DataFrame) -> DataFrame:
    """S-22: files (name, sha256) that one side lacks or that differ."""
    j = release.select("name", F.col("sha256").alias("a")).join(rebuild.select("name", F.col("sha256").alias("b")), "name", "full_outer")
    what = F.when(F.col("a").isNull(), "unexpected").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "different")
    return j.select("name", what.alias("problem")).filter("problem is not null")
