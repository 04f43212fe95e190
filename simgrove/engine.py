"""The facade: the service's routes as functions that return DataFrames. Requests are checked before any job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgrove.errors import ProblemError, unknown_document
from simgrove.functions.text import stemmed, tokens
from simgrove.functions.vectors import unit
from simgrove.operators import benchmarks, clustering, corpus, similarity, traces

_AI = {"embedding-local", "embedding-api"}
_SCORES = {"levenshtein": similarity.levenshtein, "needleman-wunsch": similarity.needleman_wunsch, "jaccard": similarity.jaccard, "embedding-local": similarity.embedding_local, "embedding-api": similarity.embedding_api}


class Engine:
    """docs: (id, abstract, ...); embeddings: (id, values) or None. Prepared documents are cached, and so are the results
    of compare() by algorithm and pair and of clusterings by representation and linkage, at most KEPT of each; close()
    frees them all."""

    KEPT = 256

    def __init__(self, docs: DataFrame, embeddings: DataFrame | None = None, stemming: bool = False, provider: str = "unknown", model: str = "unknown", embeddings_sha256: str | None = None):
        self.docs, self.spark = docs, docs.sparkSession
        self.provider, self.model, self.embeddings_sha256 = provider, model, embeddings_sha256
        self._results: dict = {}
        prepared = docs.select("id", tokens(F.col("abstract")).alias("tokens"))
        self.prepared = (stemmed(prepared) if stemming else prepared).persist()
        self.vectors = embeddings.select("id", unit(F.col("values").cast("array<double>")).alias("vec")) if embeddings is not None else None

    def close(self) -> None:
        self.prepared.unpersist()
        for df in self._results.values():
            df.unpersist()
        self._results.clear()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def _kept(self, key: tuple, make) -> DataFrame:
        """The result of this key, computed at most once while it is kept; the oldest goes first."""
        if key not in self._results:
            own = [k for k in self._results if k[0] == key[0]]
            if len(own) >= self.KEPT:
                self._results.pop(own[0]).unpersist()
            self._results[key] = make().persist()
        return self._results[key]

    def list_documents(self) -> DataFrame:
        return self.docs.select(*[c for c in ("id", "title", "authors") if c in self.docs.columns])

    def get_document(self, doc_id) -> DataFrame:
        row = self.docs.where(F.col("id") == doc_id).limit(1)
        if not row.count():
            raise unknown_document(doc_id)
        return row.drop("source", "extracted_by", "manually_validated", "abstract_sha256", "corpus_order")  # provenance stays inside

    def catalogue(self) -> DataFrame:
        return self.spark.createDataFrame(similarity.ALGORITHMS, "id string, display_name string, kind string")

    def _need(self, ids) -> None:
        known = {r[0] for r in self.docs.where(F.col("id").isin(list(ids))).select("id").collect()}
        for x in ids:
            if x not in known:
                raise unknown_document(x)

    def _pairs(self, a_ids, b_ids, algorithm: str) -> DataFrame:
        source, column, names = (self.vectors, "vec", ("u", "v")) if algorithm in _AI else (self.prepared, "tokens", ("a_tokens", "b_tokens"))
        if source is None:
            raise ProblemError("embeddings-unavailable", "no embeddings were given")
        if algorithm in _AI:
            ids = {*a_ids, *b_ids}
            if gone := ids - {r[0] for r in source.where(F.col("id").isin(list(ids))).select("id").collect()}:
                raise ProblemError("embeddings-unavailable", f"no vector for {', '.join(map(str, sorted(gone, key=str)))}")
        side = lambda ids, k, name: source.where(F.col("id").isin(list(ids))).select(F.col("id").alias(k), F.col(column).alias(name))
        return side(a_ids, "a", names[0]).crossJoin(side(b_ids, "b", names[1]))

    def _score(self, a_ids, b_ids, algorithm: str) -> DataFrame:
        if algorithm == "tfidf-cosine":
            left = self.prepared.where(F.col("id").isin(list(a_ids))).select("id")
            out = similarity.tfidf_cosine(self.prepared, left).where(F.col("b").isin(list(b_ids)))
        else:
            out = _SCORES[algorithm](self._pairs(a_ids, b_ids, algorithm))
        return out.select(F.lit(algorithm).alias("algorithm"), "a", "b", "normalized_score", "raw_value", "degenerate")

    def compare(self, a, b, algorithm_ids: list[str] | None = None) -> DataFrame:
        names = similarity.resolve(algorithm_ids)
        self._need([a, b])
        out = None
        for i, x in enumerate(names):
            one = self._kept(("compare", x, a, b), lambda x=x: self._score([a], [b], x)).withColumn("ord", F.lit(i))
            out = one if out is None else out.unionByName(one)
        return out

    def matrix(self, ids: list, algorithm: str) -> DataFrame:
        """All ordered pairs; half of them are computed and mirrored."""
        if len(ids) < 3 or len(set(ids)) < len(ids):
            raise ProblemError("invalid-selection", "a selection has three documents or more and no repeats")
        similarity.resolve([algorithm])
        self._need(ids)
        half = self._score(ids, ids, algorithm).where("a <= b")
        return half.unionByName(half.where("a < b").select("algorithm", F.col("b").alias("a"), F.col("a").alias("b"), "normalized_score", "raw_value", "degenerate"))

    def trace(self, algorithm: str, a, b) -> DataFrame:
        similarity.resolve([algorithm])
        self._need([a, b])
        if algorithm == "tfidf-cosine":
            return traces.tfidf_trace(self.prepared, a, b)
        pairs = self._pairs([a], [b], algorithm)
        if algorithm in _AI:
            return traces.embedding_trace(pairs)
        return traces.jaccard_trace(pairs) if algorithm == "jaccard" else traces.alignment_trace(pairs, algorithm)

    def _observations(self, representation: str | None) -> DataFrame:
        kind = representation or "tfidf-cosine"
        if kind not in {"tfidf-cosine", *_AI}:
            raise ProblemError("unknown-representation", f"no representation has the id {kind!r}")
        if kind in _AI:
            if self.vectors is None:
                raise ProblemError("embeddings-unavailable", "no embeddings were given")
            vectors = self.vectors
        else:
            empty = self.prepared.where(F.size("tokens") == 0).select("id").limit(10).collect()
            if empty:
                raise ProblemError("empty-document", f"no terms in {', '.join(str(r[0]) for r in empty)}")
            vectors = self._dense()
        return vectors.select(F.lit(kind).alias("representation"), F.col("id").alias("obs"), "vec")

    def _dense(self) -> DataFrame:
        """(id, vec) over all terms in their order. Terms are numbered by the counts of their stretches, not on the driver;
        a dense vector is what the merging task holds of a document anyway."""
        from pyspark.sql import Window

        w = similarity.weights(self.prepared)
        terms = w.select("term").distinct().withColumn("stretch", F.substring("term", 1, 1)).persist()
        before = terms.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))  # a row for each first letter
        before = before.select("stretch", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"), F.sum("n").over(Window.partitionBy()).alias("size"))
        place = terms.withColumn("k", F.row_number().over(Window.partitionBy("stretch").orderBy("term")) - 1).join(before, "stretch").select("term", (F.col("begin") + F.col("k")).cast("int").alias("pos"), F.col("size").cast("int").alias("size"))
        cells = w.join(place, "term").groupBy("id").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "unit"))).alias("cells"))

        def run(batches):
            import numpy as np
            import pandas as pd

            for batch in batches:
                rows = []
                for size, own in zip(batch["size"], batch["cells"], strict=True):
                    v = np.zeros(size)
                    v[[c["pos"] for c in own]] = [c["unit"] for c in own]
                    rows.append(v)
                yield pd.DataFrame({"id": batch["id"], "vec": rows})

        return cells.mapInPandas(run, f"id {dict(self.prepared.dtypes)['id']}, vec array<double>")

    def cluster(self, representation=None, linkages=None) -> DataFrame:
        """The merges of each linkage; a linkage's tree is kept."""
        kind, out = representation or "tfidf-cosine", None
        for i, x in enumerate(clustering.resolve_linkages(linkages)):
            one = self._kept(("cluster", kind, x), lambda x=x: clustering.cluster(self._observations(representation), "representation", [x])).withColumn("ord", F.lit(i))
            out = one if out is None else out.unionByName(one)
        return out.drop("ord")

    def evaluate(self, representation=None, linkages=None) -> DataFrame:
        return clustering.evaluate(self._observations(representation), "representation", linkages).drop("leaf_order", "labels")

    def cut(self, representation, linkage: str, k: int) -> DataFrame:
        clustering.resolve_linkages([linkage])
        obs = self._observations(representation)
        n = obs.count()
        if not 2 <= k <= n - 1:
            raise ProblemError("invalid-cut", f"k is {k}; it must lie in 2..{n - 1}")
        steps = self.cluster(representation, [linkage]).orderBy("step").collect()  # a row for each merge, of the tree that is kept
        ids = [r[0] for r in obs.select("obs").orderBy("obs").collect()]
        labels = clustering.cut([(r["idx1"], r["idx2"], r["merge_distance"], r["size"]) for r in steps], n, k)
        return self.spark.createDataFrame(list(zip(ids, labels, strict=True)), f"id {dict(obs.dtypes)['obs']}, label int")

    def embeddings_status(self, device: str = "cpu", mode: str = "cached") -> DataFrame:
        """provider, model, dimension, vectors, device, mode, corpus_sha256 (of the vectors' corpus) and matches_corpus."""
        kind = "provider string, model string, dimension int, vectors long, device string, mode string, corpus_sha256 string, matches_corpus boolean"
        n, dimension = self.vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first() if self.vectors is not None else (0, None)
        own = corpus.corpus_sha256(self.docs.select(F.col("id").cast("string").alias("id"), corpus.text_sha256(F.col("abstract")).alias("abstract_sha256"))).first()[0]
        return self.spark.createDataFrame([(self.provider if n else "unknown", self.model, dimension, n, device, mode, self.embeddings_sha256, self.embeddings_sha256 == own)], kind)

    def require_coverage(self) -> None:
        """Every document has one vector, and every vector a document; all that is amiss is named in one error."""
        if self.vectors is None:
            raise ProblemError("embeddings-unavailable", "no embeddings were given")
        found = corpus.coverage(self.docs.select("id"), self.vectors.select("id")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set(F.col("id").cast("string"))), 1, 20), ", ").alias("ids")).orderBy("problem").collect()
        if found:
            raise ProblemError("embeddings-mismatch", "; ".join(f"{r['problem']} ({r['n']}): {r['ids']}" for r in found))

    def benchmark_report(self, results_path: str, slopes_path: str):
        return benchmarks.read_report(self.spark, results_path, slopes_path)


def json_body(df: DataFrame) -> DataFrame:
    """One `body` column with each row as JSON, nulls written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))
