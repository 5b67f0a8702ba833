"""The façade: configuration, indexing, search, persistence."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.analysis import Analyzer
from tessera.functions.ranking import Bm25
from tessera.functions.snippet import Highlighter
from tessera.operators.index import Index, build
from tessera.plans.planner import Searcher
from tessera.sources import crawl, store


@dataclass
class Engine:
    spark: SparkSession
    analyzer: Analyzer = field(default_factory=Analyzer)
    bm25: Bm25 = Bm25()
    highlighter: Highlighter = Highlighter()
    extensions: tuple[str, ...] = crawl.EXTENSIONS
    _index: Index | None = None

    def fork_config(self) -> Engine:
        """An empty engine of the same configuration."""
        return replace(self, _index=None)

    def with_bm25(self, bm25: Bm25) -> Engine:
        return replace(self, bm25=bm25)

    def with_highlighter(self, highlighter: Highlighter) -> Engine:
        return replace(self, highlighter=highlighter)

    def with_extensions(self, extensions: Iterable[str]) -> Engine:
        return replace(self, extensions=tuple(crawl.clean_extensions(extensions)))

    @property
    def index(self) -> Index:
        if self._index is None:
            empty = self.spark.createDataFrame([], "doc_id long, uri string, title string, text string")
            self._index = build(empty, self.analyzer)
        return self._index

    def use(self, index: Index) -> None:
        self._index, self.analyzer = index, index.analyzer

    def add_documents(self, docs: DataFrame) -> None:
        """(uri, title, text), and doc_id if there is one. Ids of what is there already stay."""
        if self._index is None and "doc_id" in docs.columns:
            self._index = build(docs, self.analyzer)
            return
        with self.index.edit() as session:
            session.add(docs)
        self._index = session.index

    def add_document(self, uri: str, title: str, text: str) -> None:
        """One document; for many, ``add_documents``."""
        self.add_documents(self.spark.createDataFrame([(uri, title, text)], "uri string, title string, text string"))

    def index_dir(self, root: str) -> int:
        """Appends the files below ``root``; their number."""
        docs = crawl.read_tree(self.spark, root, self.extensions)  # numbered and written already
        n = docs.count()
        self.add_documents(docs)
        return n

    def searcher(self) -> Searcher:
        return Searcher(self.index, self.bm25)

    def search(self, query: str, k: int = 10) -> DataFrame:
        return self.searcher().results(query, k, self.highlighter)

    def search_with_stats(self, query: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
        return self.search(query, k), self.searcher().counters(query, k)

    def stats(self) -> DataFrame:
        return self.index.stats()

    def save(self, path: str) -> None:
        self._index = store.save(self.index, path)

    def load(self, path: str) -> Engine:
        self.use(store.load(self.spark, path))
        return self
