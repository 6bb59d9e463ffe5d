"""Namespaces of documents over versioned parquet tables.

A namespace's documents, chunks and index postings lie in buckets by document
id. A version is a small numbered file that says in which folder each bucket
lies and what it holds. A write reads and rewrites the buckets that its documents
fall in and nothing else; unchanged documents are skipped by content hash. The
version file is written last, aside, and moved into place, after its number has
been claimed by creating a file that must not exist: of two writers one gets the
number, the other an error and its documents are to be written again. Readers
keep what they opened; a failed write leaves nothing visible. Folders that
neither the last nor the last but one version names are deleted.
"""

from __future__ import annotations

import datetime
import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.embed import Embedder, HashEmbedder, embed_column
from lodestar.functions.filters import Filter, parse_where
from lodestar.functions.scalars import canonical_json
from lodestar.functions.text import chunk, porter_tokens
from lodestar.operators import index, listing, search, upsert
from lodestar.session import Kept

NAME = re.compile(r"[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}")
DOCS = "ns string, id string, text string, attrs string, hash string"
CHUNKS = "ns string, doc_id string, ord int, chunk_id bigint, text string, vec array<float>"
#: Buckets of a namespace. A claim without a version file is given up after so
#: many seconds.
BUCKETS, PATIENCE = 16, 600
TABLES = ("docs", "chunks", "postings")


class NamespaceNotFound(LookupError):
    pass


class WriteConflict(RuntimeError):
    """Another writer has made, or is making, the next version."""


@dataclass(frozen=True)
class WriteResult:
    written: int
    skipped: int
    chunks: int


class Engine:
    """Namespaces below a root folder (any file system Spark knows)."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder = embedder or HashEmbedder(64)

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def put(self, path: str, text: str) -> None:
        """Writes a small file aside, then moves it to a path that nothing holds."""
        fs, tmp = self._fs(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, p = self._fs(path)
        if fs.exists(p) or not fs.rename(tmp, p):
            fs.delete(tmp, False)
            raise WriteConflict(path)

    def claim(self, path: str) -> bool:
        """Creates a file, false if it exists already."""
        fs, p = self._fs(path)
        fs.mkdirs(p.getParent())
        return bool(fs.createNewFile(p))

    def names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def get_text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create_namespace(self, name: str, chunk_size: int = 0, chunk_over: int = -1) -> Namespace:
        if not NAME.fullmatch(name):
            raise ValueError(f"invalid namespace {name!r}")
        if self.exists(f"{self.root}/{name}/_CONFIG"):
            raise ValueError(f"namespace {name!r} exists")
        size = chunk_size if chunk_size > 0 else 1000
        over = chunk_over if 0 <= chunk_over < size else 100
        created = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        try:
            self.put(f"{self.root}/{name}/_CONFIG", "\n".join([self.embedder.ident, str(self.embedder.dims), str(size), str(over), created]))
        except WriteConflict:
            raise ValueError(f"namespace {name!r} exists") from None
        return Namespace(self, name)

    def namespace(self, name: str) -> Namespace:
        if not NAME.fullmatch(name) or not self.exists(f"{self.root}/{name}/_CONFIG"):
            raise NamespaceNotFound(name)
        return Namespace(self, name)

    def drop_namespace(self, name: str) -> None:
        self.namespace(name)
        self.remove(f"{self.root}/{name}")

    def list_namespaces(self) -> DataFrame:
        spaces = [self.namespace(n) for n in self.names(self.root) if self.exists(f"{self.root}/{n}/_CONFIG")]
        rows = [(n.name, n.embedder_id, n.dims, n.created_at) for n in spaces]
        config = self.spark.createDataFrame(rows, "name string, embedder_id string, dims int, created_at string")
        docs, chunks = self.spark.createDataFrame([], DOCS), self.spark.createDataFrame([], CHUNKS)
        for n in spaces:
            docs, chunks = docs.unionByName(n.docs()), chunks.unionByName(n.chunks())
        return listing.namespace_stats(config, docs, chunks)


class Namespace:
    """A document collection bound to one embedder and chunk size."""

    def __init__(self, engine: Engine, name: str) -> None:
        self.engine, self.name, self.home = engine, name, f"{engine.root}/{name}"
        ident, dims, size, over, self.created_at = engine.get_text(f"{self.home}/_CONFIG").split("\n")
        self.embedder_id, self.dims, self.size, self.over = ident, int(dims), int(size), int(over)
        if (ident, self.dims) != (engine.embedder.ident, engine.embedder.dims):
            raise ValueError(f"namespace {name!r} is bound to {ident}, not {engine.embedder.ident}")

    def version(self) -> tuple[int, dict]:
        """(number, buckets) of the current version; a bucket's entry has its
        ``path`` and the numbers of ``docs``, ``chunks`` and ``tokens`` in it."""
        done = [n for n in self.engine.names(f"{self.home}/_versions") if n.endswith(".json")]
        if not done:
            return 0, {}
        return int(done[-1].removesuffix(".json")), json.loads(self.engine.get_text(f"{self.home}/_versions/{done[-1]}"))

    def _table(self, table: str, schema: str, buckets: dict) -> DataFrame:
        base = f"{self.home}/{table}"
        full = {"docs": "docs", "chunks": "chunks", "postings": "tokens"}[table]
        paths = [f"{base}/v={e['path']}/b={b}" for b, e in sorted(buckets.items()) if e[full]]
        if not paths:
            return self.engine.spark.createDataFrame([], schema)
        rows = self.engine.spark.read.schema(f"{schema}, v string, b int").option("basePath", base).parquet(*paths)
        return rows.drop("v", "b")

    def docs(self, buckets: dict | None = None) -> DataFrame:
        return self._table("docs", DOCS, self.version()[1] if buckets is None else buckets)

    def chunks(self, buckets: dict | None = None) -> DataFrame:
        return self._table("chunks", CHUNKS, self.version()[1] if buckets is None else buckets)

    def index(self, buckets: dict | None = None) -> index.TextIndex:
        buckets = self.version()[1] if buckets is None else buckets
        rows = self._table("postings", f"{index.POSTINGS}, t int", buckets)
        return index.TextIndex(rows, sum(e["chunks"] for e in buckets.values()), sum(e["tokens"] for e in buckets.values()))

    def _commit(self, number: int, buckets: dict) -> None:
        """Makes ``number`` the current version."""
        home = f"{self.home}/_versions"
        name = f"{home}/{number:010d}"
        if not self.engine.claim(f"{name}.claim"):
            fs, p = self.engine._fs(f"{name}.claim")
            old = time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > PATIENCE
            if self.engine.exists(f"{name}.json") or not old:
                raise WriteConflict(f"version {number} of {self.name!r} is taken")
        self.engine.put(f"{name}.json", json.dumps(buckets))
        versions = [n for n in self.engine.names(home) if n.endswith(".json")]
        used = {e["path"] for n in versions[-2:] for e in json.loads(self.engine.get_text(f"{home}/{n}")).values()}
        for n in versions[:-2]:
            stale = {e["path"] for e in json.loads(self.engine.get_text(f"{home}/{n}")).values()}
            for path in stale - used:
                for table in TABLES:
                    self.engine.remove(f"{self.home}/{table}/v={path}")
            self.engine.remove(f"{home}/{n}")
            self.engine.remove(f"{home}/{n.removesuffix('.json')}.claim")

    def _replace(self, number: int, buckets: dict, touched: list[int], docs: DataFrame, chunks: DataFrame, postings: DataFrame) -> None:
        """Commits the rows of the touched buckets, all other buckets as they are.
        The frames have a bucket column ``b``, chunks their number of ``tokens``."""
        path = uuid.uuid4().hex
        home = {table: f"{self.home}/{table}/v={path}" for table in TABLES}
        docs.repartition("b").write.partitionBy("b").parquet(home["docs"])
        sizes = {b: {"path": path, "docs": 0, "chunks": 0, "tokens": 0} for b in touched}
        written = self.engine.spark.read.schema(f"{DOCS}, b int").parquet(home["docs"])
        for r in written.groupBy("b").agg(F.count("*").alias("n")).collect():  # a row per bucket
            sizes[r["b"]]["docs"] = r["n"]
        chunks.repartition("b").write.partitionBy("b").parquet(home["chunks"])
        written = self.engine.spark.read.schema(f"{CHUNKS}, tokens int, b int").parquet(home["chunks"])
        for r in written.groupBy("b").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).collect():
            sizes[r["b"]] |= {"chunks": r["n"], "tokens": r["tokens"]}
        index.write_postings(postings, home["postings"], by=("b",))
        kept = {b: e for b, e in buckets.items() if int(b) not in sizes}
        self._commit(number + 1, kept | {str(b): e for b, e in sizes.items() if e["docs"]})

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")

    def _in(self, buckets: dict, touched: list[int]) -> dict:
        return {b: e for b, e in buckets.items() if int(b) in touched}

    def write(self, documents: DataFrame, order: str | None = None) -> WriteResult:
        """Upserts ``id, text, attrs``; of equal ids the last by ``order`` (else
        the last row) wins. Attributes are brought to one form first, so that the
        order of their keys or spaces is no change; equal content is skipped."""
        rows = documents.withColumns({"ns": F.lit(self.name), "attrs": canonical_json(F.col("attrs"))})
        if not rows.where(F.coalesce("id", F.lit("")) == "").isEmpty():
            raise ValueError("document with an empty id")
        if order is None:
            rows, order = rows.withColumn("__row", F.monotonically_increasing_id()), "__row"
        rows = upsert.last_of_each(rows, order)
        number, buckets = self.version()
        work = Kept(self.engine.spark)
        try:
            rows = work.keep(rows.withColumn("b", self._bucket("id")), "incoming")
            met = sorted(r["b"] for r in rows.select("b").distinct().collect())  # at most BUCKETS rows
            stored = self.docs(self._in(buckets, met))
            actions = work.keep(upsert.classify(stored, rows), "actions")
            counts = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}  # two rows
            new = actions.where(F.col("action") == "written").select("ns", "id", "text", "attrs", "hash").withColumn("b", self._bucket("id"))
            pieces = new.select("ns", F.col("id").alias("doc_id"), "b", F.posexplode(chunk(F.col("text"), F.lit(self.size), F.lit(self.over))).alias("ord", "text"))
            pieces = pieces.withColumns({"chunk_id": F.xxhash64("ns", "doc_id", "ord"), "w": porter_tokens("text")})
            pieces = work.keep(embed_column(pieces, "text", self.engine.embedder), "pieces")
            n_chunks = pieces.count()
            if counts.get("written"):
                touched = sorted(r["b"] for r in new.select("b").distinct().collect())
                self._merge(number, buckets, touched, new, pieces, new.select("id"))
        finally:
            work.drop()
        return WriteResult(counts.get("written", 0), counts.get("skipped", 0), n_chunks)

    def _merge(self, number: int, buckets: dict, touched: list[int], new: DataFrame | None, pieces: DataFrame | None, gone: DataFrame) -> None:
        """A version in which the documents ``gone`` are replaced by the new ones."""
        at = self._in(buckets, touched)
        ids = gone.select(F.col("id").alias("doc_id"))
        docs = self.docs(at).join(gone, "id", "left_anti").select("ns", "id", "text", "attrs", "hash").withColumn("b", self._bucket("id"))
        chunks = self._table("chunks", f"{CHUNKS}, tokens int", at).join(ids, "doc_id", "left_anti").withColumn("b", self._bucket("doc_id"))
        postings = self._table("postings", f"{index.POSTINGS}, t int", at).drop("t").join(ids, "doc_id", "left_anti").withColumn("b", self._bucket("doc_id"))
        if new is not None:
            docs = docs.unionByName(new)
            chunks = chunks.unionByName(pieces.select("ns", "doc_id", "ord", "chunk_id", "text", "vec", F.size("w").alias("tokens"), "b"))
            postings = postings.unionByName(index.postings(pieces, "w").withColumn("b", self._bucket("doc_id")))
        self._replace(number, buckets, touched, docs, chunks, postings)

    def delete(self, ids: list[str]) -> int:
        """Number of documents that existed."""
        gone = self.engine.spark.createDataFrame([(i,) for i in set(ids)], "id string")
        number, buckets = self.version()
        met = [r["b"] for r in gone.select(self._bucket("id").alias("b")).distinct().collect()]
        found = self.docs(self._in(buckets, met)).join(gone, "id", "left_semi").select("id")
        n = found.count()
        if n:
            touched = [r["b"] for r in found.select(self._bucket("id").alias("b")).distinct().collect()]
            self._merge(number, buckets, touched, None, None, gone)
        return n

    def get(self, ident: str) -> dict:
        row = self.docs().where(F.col("id") == ident).select("text", "attrs").first()
        if row is None:
            raise LookupError(f"document {ident!r} not found")
        return {"id": ident, "text": row["text"], "attributes": row["attrs"]}

    def query(self, text: str, where: str | Filter | None = None, mode: str = "hybrid", top: int = 10, k: int = 60, depth: int = 100) -> DataFrame:
        """``id, score, text, keyword_rank, semantic_rank, attributes``."""
        f = parse_where(where) if isinstance(where, str) else where
        buckets = self.version()[1]
        docs = self.docs(buckets)
        eligible = docs.where(f.column(F.col("attrs"))).select(F.col("id").alias("doc_id")) if f else None
        vector = [float(x) for x in self.engine.embedder.embed([text])[0]]
        attributes = docs.select(F.col("id").alias("doc_id"), F.when(~F.col("attrs").isin("", "{}"), F.col("attrs")).alias("attributes"))
        found = search.search(self.chunks(buckets), text, vector, mode, top, k, depth, eligible, attributes, index=self.index(buckets))
        return found.orderBy(F.desc("score"), "id")

    def list(self, where: str | None = None, **page) -> DataFrame:
        return listing.list_documents(self.docs(), self.chunks(), parse_where(where or ""), **page)

    def groups(self, key: str, where: str | None = None, **page) -> DataFrame:
        return listing.group_documents(self.docs(), self.chunks(), key, parse_where(where or ""), **page)

    def count(self, where: str | None = None) -> int:
        return listing.count_documents(self.docs(), parse_where(where or "")).first()["n"]

    def count_groups(self, key: str, where: str | None = None) -> int:
        return listing.count_groups(self.docs(), key, parse_where(where or "")).first()["n"]
