"""Changes of stored tables, each as the rows that result, and the tables themselves."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STORED


def stable_id(*parts: Column) -> Column:
    """An id that depends on what it identifies alone, in the form of a UUID."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new rows merged by (tenant_id, url): content_type and state are overwritten, of other columns new values replace
    old ones where they are not null, and an existing row keeps its id and created_at. new has one row for each key."""
    key = ["tenant_id", "url"]
    a, b = old.alias("a"), new.alias("b")
    same = (F.col("a.tenant_id") == F.col("b.tenant_id")) & (F.col("a.url") == F.col("b.url"))

    def column(c: str) -> Column:
        x, y = F.col(f"a.`{c}`"), F.col(f"b.`{c}`") if c in new.columns else F.lit(None)
        if c in (*key, "id", "created_at"):
            return F.coalesce(x, y).alias(c)
        if c in ("content_type", "state"):
            return F.when(F.col("b.url").isNotNull(), y).otherwise(x).alias(c)
        return F.coalesce(y, x).alias(c)

    return a.join(b, same, "full").select(*map(column, old.columns))


def insert_bookmarks(old: DataFrame, new: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """(bookmarks to add, rows that conflict): one row for each (tenant_id, url, source), the first by `order`, unless there is one
    already. Empty tags become null. Rows are told apart by columns tenant_id, url, source and the order."""
    key = ["tenant_id", "url", "source"]
    numbered = new.withColumn("_order", order)
    # the first of each key by partial minima; a key with very many rows is no window in one task
    first = numbered.groupBy(*key).agg(F.min("_order").alias("_order")).join(old.select(*key), key, "left_anti")
    tags = {"tags": F.when(F.size("tags") > 0, F.col("tags"))} if "tags" in new.columns else {}
    return numbered.join(first, [*key, "_order"], "left_semi").drop("_order").withColumns(tags), numbered.join(first, [*key, "_order"], "left_anti").drop("_order")


def replace_chunks(old: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """old with all chunks of the given documents (document_id) replaced by new; a document without new ones is cleared."""
    return old.join(documents.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def checked_vectors(vectors: DataFrame, dim: int, vector_col: str = "embedding") -> DataFrame:
    """vectors, with an error for one of another length."""
    wrong = F.raise_error(F.concat(F.lit(f"a vector of a length other than {dim}: "), F.size(vector_col).cast("string")))
    return vectors.withColumn(vector_col, F.when(F.size(vector_col) == dim, F.col(vector_col)).otherwise(wrong.cast(vectors.schema[vector_col].dataType)))


def set_values(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns taken from changes where their key is found; a null there is a value too."""
    new = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = rows.join(new, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    return joined.select(*((F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)) for c in rows.columns))


def dangling(rows: DataFrame, column: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows that point at no parent; null points nowhere and is fine."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(parent_key).alias(column)), column, "left_anti")


def tag_union(bookmarks: DataFrame, key: str = "document_id", tags_json: str = "tags", order: str = "id") -> DataFrame:
    """(key, tags): the distinct tags of a key's bookmarks, trimmed, in the order they are first met. Tags that are no JSON list of
    strings add nothing."""
    parsed = bookmarks.select(key, F.col(order).alias("_o"), F.posexplode(F.from_json(F.col(tags_json), "array<string>")).alias("_at", "_tag"))
    parsed = parsed.withColumn("_tag", F.trim("_tag")).where("_tag <> ''")
    first = parsed.groupBy(key, "_tag").agg(F.min(F.struct("_o", "_at")).alias("_first"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", "_tag"))), lambda x: x["_tag"]).alias("tags"))


def latest_run(runs: DataFrame, done_only: bool = False, tenant: str = "local") -> DataFrame:
    own = runs.where(F.col("tenant_id") == tenant)
    return (own.where("status = 'done'") if done_only else own).orderBy(F.desc("created_at"), "id").limit(1)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which the driver and all executors see: spark.checkpoint.dir, or what was set before. Where neither is set, a local
    session uses a temporary folder, and a cluster one beside its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = "file://" + tempfile.mkdtemp(prefix="quern-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quern"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class ConcurrentWrite(RuntimeError):
    """Another writer has changed the table since it was read."""


class Tables:
    """Tables below one path, each a list of Parquet parts that a manifest names.

    A change writes a part beside the others, and then a manifest with the next number: readers see all of the change or none of
    it, and a writer that is lost leaves the last manifest. A row is replaced by its key: the manifest also names lists of replaced keys, each of which holds
    for the parts before it. So a change costs what it changes, not what the table holds; after `most_parts` parts the table is written anew as
    one. Tables of quern.schemas exist from the start, without rows. Of two writers that start from one manifest, the later one raises ConcurrentWrite.
    """

    def __init__(self, spark: SparkSession, root: str, most_parts: int = 24) -> None:
        self.spark, self.root, self.most_parts = spark, root.rstrip("/"), most_parts

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, name: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{name}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _manifests(self, name: str) -> list[dict]:
        """The last two manifests that are whole, the newest first."""
        out: list[dict] = []
        for file in reversed([n for n in self._names(name) if n.startswith("_manifest-")]):
            fs, p = self._fs(f"{self.root}/{name}/{file}")
            stream = fs.open(p)
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                out.append(json.loads(text))
            except ValueError:  # its writer was lost
                continue
            if len(out) == 2:
                break
        return out

    def _commit(self, name: str, manifest: dict, before: dict | None) -> None:
        number = manifest["number"] = (before["number"] if before else 0) + 1
        fs, p = self._fs(f"{self.root}/{name}/_manifest-{number:012d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise ConcurrentWrite(name) from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        keep = {x["dir"] for m in (manifest, before) if m for x in (*m["parts"], *m["gone"])} | {f"_manifest-{n:012d}.json" for n in (number, number - 1)}
        for n in self._names(name):
            # what is written but not named yet may be another writer's
            if n not in keep and (n.startswith("_manifest-") or int(n[1:].split("-")[0]) < number):
                fs.delete(self._fs(f"{self.root}/{name}/{n}")[1], True)

    def _write(self, name: str, rows: DataFrame, number: int, order: list[str]) -> str:
        at = f"v{number:012d}-{uuid.uuid4().hex}"
        (rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows).write.parquet(f"{self.root}/{name}/{at}")
        return at

    def _part(self, name: str, at: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{at}")

    def exists(self, name: str) -> bool:
        return bool(self._manifests(name))

    def read(self, name: str) -> DataFrame:
        found = self._manifests(name)
        if not found:
            if name in STORED:
                return self.spark.createDataFrame([], STORED[name])
            raise FileNotFoundError(f"{self.root}/{name}")
        m = found[0]
        path = f"{self.root}/{name}/"
        if not m["gone"]:
            return self.spark.read.parquet(*(path + x["dir"] for x in m["parts"]))
        key = m["key"]
        gone = [self._part(name, x["dir"]).select(F.col(key).alias("_gone_key"), F.lit(x["number"]).alias("_gone_at")) for x in m["gone"]]
        last = reduce(DataFrame.unionAll, gone).groupBy("_gone_key").agg(F.max("_gone_at").alias("_gone_at"))
        end = m["gone"][-1]["number"]
        old = [self._part(name, x["dir"]).withColumn("_at", F.lit(x["number"])) for x in m["parts"] if x["number"] < end]
        new = [path + x["dir"] for x in m["parts"] if x["number"] >= end]
        out = []
        if old:
            rows = reduce(DataFrame.unionByName, old)
            out.append(rows.join(last, F.col(key) == F.col("_gone_key"), "left").where("_gone_at is null or _at >= _gone_at").drop("_at", "_gone_key", "_gone_at"))
        if new:
            out.append(self.spark.read.parquet(*new))
        return reduce(DataFrame.unionByName, out)

    def replace(self, name: str, rows: DataFrame, order: tuple[str, ...] = ()) -> None:
        """Writes rows as the whole table. order: columns by which its parts are sorted from now on."""
        before = next(iter(self._manifests(name)), None)
        order = list(order) or (before["order"] if before else [])
        number = before["number"] + 1 if before else 1
        at = self._write(name, rows, number, order)
        self._commit(name, {"parts": [{"dir": at, "number": number}], "gone": [], "key": None, "order": order}, before)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        return self.merge(name, rows)

    def merge(self, name: str, rows: DataFrame, key: str | None = None, keys: DataFrame | None = None, order: tuple[str, ...] = ()) -> DataFrame:
        """Adds rows, after all rows with their keys (or those in keys, a table with that column) are gone; without a key, none go.
        Returns the rows as they were written, once. A null key replaces nothing."""
        before = next(iter(self._manifests(name)), None)
        m = dict(before) if before else {"parts": [], "gone": [], "key": None, "order": list(order)}
        m |= {"parts": list(m["parts"]), "gone": list(m["gone"])}
        if key is not None and m["key"] not in (None, key):
            raise ValueError(f"{name} replaces rows by {m['key']}")
        number = before["number"] + 1 if before else 1
        at = self._write(name, rows, number, m["order"])
        written = self._part(name, at)
        if (empty := written.isEmpty()) and before:
            written = self.spark.createDataFrame([], written.schema)
            fs, part = self._fs(f"{self.root}/{name}/{at}")
            fs.delete(part, True)
        if not empty or not before:
            m["parts"].append({"dir": at, "number": number})
        if key is not None and before and not (empty and keys is None):
            old = (written if keys is None else keys).select(key).where(F.col(key).isNotNull()).distinct()
            m["gone"].append({"dir": self._write(name, old, number, []), "number": number})
            m["key"] = key
        if before and m["parts"] == before["parts"] and m["gone"] == before["gone"]:
            return written
        if len(m["parts"]) + len(m["gone"]) > self.most_parts:
            self._commit(name, m, before)
            self.replace(name, self.read(name))
        else:
            self._commit(name, m, before)
        return written

    def scratch(self, rows: DataFrame) -> DataFrame:
        """rows, written once, for what has effects or is read more than once; `drop` deletes them."""
        at = f"{self.root}/_scratch/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def drop(self, *scratched: DataFrame) -> None:
        for df in scratched:
            for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if "/_scratch/" in at:
                    fs, p = self._fs(at)
                    fs.delete(p, True)
