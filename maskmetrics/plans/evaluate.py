"""Evaluation of anonymizations of a corpus by any of the measures."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parser as parsing
from ..functions import text as T
from ..operators import clustering, measures as M, reidentification as R
from ..operators.backoff import BackoffModel
from ..operators.embeddings import TextVectors
from ..operators.masked_lm import MaskedLM
from ..operators import entities as E
from ..sources import json_files as J

#: (word, ic), a masked language model, or a function of documents and terms.
Information = DataFrame | MaskedLM | Callable[[DataFrame, DataFrame], DataFrame]
NEEDS_GOLD = ["Precision", "PrecisionWeighted", "Recall", "RecallPerEntityType"]


class Evaluation:
    """A corpus with its gold mentions, ready to judge anonymizations.

    documents: doc_id, text. mentions: doc_id, annotator, mention_ord, entity_id, entity_type, identifier_type, start, end.

    Models come from providers by name; a name that none has is refused. information: a name's (word, ic), a MaskedLM (which
    sees the whole text, or the sentence if terms alternate by sentence), or, for TPI and TPS alone, a function of documents
    and terms (doc_id, term_ord, start, end, round; sent_id too if terms alternate by sentence) that gives (doc_id, term_ord,
    ic). embeddings: a name's function from a text column to a vector column. "corpus" is the corpus' own word frequencies,
    "backoff" a masked model learned from its words and their neighbours on both sides, "svd" vectors
    by a decomposition of its TF-IDF matrix, "bag" the bag of words. parser: patterns and lists, or a tagger.LearnedParser.
    """

    def __init__(self, documents: DataFrame, mentions: DataFrame | None = None, information: dict[str, Information] | None = None, embeddings: dict[str, Callable[[Column], Column]] | None = None, parser: parsing.Parser = parsing.PATTERNS):
        self.spark: SparkSession = documents.sparkSession
        self._information, self._embeddings, self.parser = information or {}, embeddings or {}, parser
        self.documents = documents.select("doc_id", "text", F.length("text").alias("n_chars"))
        empty = "doc_id string, annotator string, mention_ord int, entity_id string, entity_type string, identifier_type string, start int, end int"
        self.mentions = mentions if mentions is not None else self.spark.createDataFrame([], empty)
        broken = [(r["rule"], r["n"]) for r in E.violations(self.documents, self.mentions).where("n > 0").collect()]
        if broken:
            raise ValueError(f"the corpus breaks rules: {broken}")

    @classmethod
    def of_file(cls, spark: SparkSession, path: str, **options) -> Evaluation:
        corpus = J.read_corpus(spark, path)
        return cls(corpus, J.gold_mentions(corpus), **options)

    @cached_property
    def words(self) -> DataFrame:
        return M.words(self.documents)

    @cached_property
    def information(self) -> DataFrame:
        """One table of weights for all measures that want one."""
        return M.token_information(self.words).cache()

    @cached_property
    def backoff(self) -> BackoffModel:
        """A masked model of the corpus' own; its counts are kept on disk while the session lasts."""
        return BackoffModel.learn(self.documents)

    @cached_property
    def text_vectors(self) -> TextVectors:
        """Vectors of texts, learned from the corpus."""
        return TextVectors.learn(self.documents)

    def _weights(self, name: str | None, max_segment_length: int) -> Information | None:
        if name is None:
            return None
        known = {"corpus": lambda: self.information, "backoff": lambda: self.backoff.weigh, **{n: lambda p=p: p for n, p in self._information.items()}}
        if name not in known:
            raise ValueError(f"no information model {name!r}; there are {sorted(known)}")
        found = known[name]()
        return found.limited(max_segment_length) if isinstance(found, MaskedLM) else found

    def _embedding(self, name: str | None) -> Callable[[Column], Column]:
        known = {None: lambda: T.bag_of_words, "bag": lambda: T.bag_of_words, "svd": lambda: self.text_vectors.embedding(self.spark), **{n: lambda f=f: f for n, f in self._embeddings.items()}}
        if name not in known:
            raise ValueError(f"no embedding model {name!r}; there are {sorted(filter(None, known))}")
        return known[name]()

    def precision(self, anon_docs, maskings, weighting_model_name: str | None = None, weighting_max_segment_length: int = 100, token_level: bool = True, verbose: bool = True) -> DataFrame:
        weights = self._weights(weighting_model_name, weighting_max_segment_length)
        if callable(weights):
            raise ValueError(f"{weighting_model_name!r} weighs terms and not words")
        return M.precision(maskings, anon_docs, self.mentions, self.documents, token_level, weights)

    def weighted_precision(self, anon_docs, maskings, weighting_model_name: str | None = "corpus", **options) -> DataFrame:
        return self.precision(anon_docs, maskings, weighting_model_name, **options)

    def _counts(self, anon_docs, maskings, **options) -> DataFrame:
        return M.mask_counts(self.mentions, maskings, anon_docs, self.documents, self.parser.ignorable(self.documents, self.words), **options)

    def recall(self, anon_docs, maskings, include_direct: bool = True, include_quasi: bool = True, token_level: bool = True, verbose: bool = True) -> DataFrame:
        return M.recall(self._counts(anon_docs, maskings, include_direct=include_direct, include_quasi=include_quasi, token_level=token_level), anon_docs)

    def recall_per_entity_type(self, anon_docs, maskings, include_direct: bool = True, include_quasi: bool = True, token_level: bool = True) -> DataFrame:
        found = M.recall_by_type(self._counts(anon_docs, maskings, include_direct=include_direct, include_quasi=include_quasi, token_level=token_level))
        return found.groupBy("anon_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "recall")))).alias("by_type"))

    def terms(self, weighting_model_name: str | None, term_alterning: int | str, use_chunking: bool, max_segment_length: int = 100) -> DataFrame:
        found = M.terms_of(self.parser.tokens(self.documents), use_chunking) if use_chunking else M.terms(self.documents)
        weights, in_rounds = self._weights(weighting_model_name, max_segment_length), M.rounds(found, term_alterning)
        masked = isinstance(weights, MaskedLM)
        if not masked and not callable(weights):  # word frequencies don't depend on the round
            return M.term_information(found, self.documents, weights)
        sentences = M.sentence_spans(self.documents) if term_alterning == "sentence" else None
        if sentences is not None:
            in_rounds = in_rounds.join(M.terms_in_sentences(found, sentences), ["doc_id", "term_ord"], "left")
        if masked:
            weighed = weights.weigh(self.documents, in_rounds, sentences).select("doc_id", "term_ord", "ic")
            return found.join(weighed, ["doc_id", "term_ord"], "left").fillna(0.0, ["ic"])
        return found.join(weights(self.documents, in_rounds), ["doc_id", "term_ord"], "left").fillna(0.0, ["ic"])

    def tpi(self, anon_docs, maskings, weighting_model_name: str | None = "corpus", weighting_max_segment_length: int = 100, term_alterning: int | str = 6, use_chunking: bool = True, overlap_mode: str = "endpoint", flush_tail: bool = False, skip_empty: bool = False) -> DataFrame:
        each = M.preserved_information(self.terms(weighting_model_name, term_alterning, use_chunking, weighting_max_segment_length), maskings, anon_docs, self.documents, overlap_mode=overlap_mode, flush_tail=flush_tail)
        return M.mean_by_anonymization(each, "tpi", skip_empty)

    def tps(self, anon_docs, maskings, weighting_model_name: str | None = "corpus", weighting_max_segment_length: int = 100, term_alterning: int | str = 6, use_chunking: bool = True, similarity_model_name: str | None = None, overlap_mode: str = "endpoint", flush_tail: bool = False, skip_empty: bool = False, verbose: bool = True) -> DataFrame:
        each = M.preserved_similarity(self.terms(weighting_model_name, term_alterning, use_chunking, weighting_max_segment_length), maskings, anon_docs, self.documents, self._embedding(similarity_model_name), overlap_mode=overlap_mode, flush_tail=flush_tail)
        return M.mean_by_anonymization(each, "tps", skip_empty)

    def nmi(self, anon_docs, maskings, min_k: int = 2, max_k: int = 32, k_multiplier: float = 2, embedding_model_name: str | None = None, remove_mask_marks: bool = True, mask_marks: list[str] = T.MASK_MARKS, n_clusterings: int = 5, n_tries_per_clustering: int = 50, seed: int = 1) -> DataFrame:
        texts = M.masked_texts(self.documents, anon_docs, maskings).unionByName(self.documents.select(F.lit("\0original").alias("anon_name"), "doc_id", "text"))
        found, _, _ = clustering.agreement(clustering.embed(texts, self._embedding(embedding_model_name), mask_marks if remove_mask_marks else None), "\0original", min_k, max_k, k_multiplier, n_clusterings, n_tries_per_clustering, seed)
        return self.spark.createDataFrame([*found.items()], "anon_name string, nmi double")

    def trir(self, anon_docs, maskings, background_knowledge_file_path: str, output_folder_path: str | None = None, verbose: bool = True, **options) -> DataFrame:
        config = R.AttackConfig.of({"output_folder_path": output_folder_path, **options})
        background = J.read_background(self.spark, background_knowledge_file_path)
        texts = M.masked_texts(self.documents, anon_docs, maskings).withColumnRenamed("anon_name", "source")
        found = R.risk(texts, background, config, self.parser.with_entity_types, self.parser.curate)
        return found.select(F.col("source").alias("anon_name"), F.col("accuracy").alias("trir"))

    def measures(self):
        return {
            "Precision": self.precision, "PrecisionWeighted": self.weighted_precision, "TPI": self.tpi, "TPS": self.tps, "NMI": self.nmi,
            "Recall": self.recall, "RecallPerEntityType": self.recall_per_entity_type, "TRIR": self.trir,
        }

    def check(self, anon_docs: DataFrame, metrics: dict) -> None:
        lacking = M.missing_documents(self.documents, anon_docs).groupBy("anon_name").count().collect()
        if lacking:
            raise ValueError(f"anonymizations lack documents: {[(r[0], r[1]) for r in lacking]}")
        for r in M.extra_documents(self.documents, anon_docs).groupBy("anon_name").count().collect():
            logging.warning("%s has %d documents that the corpus lacks", r[0], r[1])
        if any(T.metric_key(m) in NEEDS_GOLD for m in metrics) and E.gold_ratio(self.documents, self.mentions).first()[0] != 1:
            raise ValueError("not all documents have gold annotations, which some of the metrics need")

    def evaluate(self, anon_docs: DataFrame, maskings: DataFrame, metrics: dict[str, dict], results_file_path: str | None = None) -> dict[str, dict]:
        """{metric: {anonymization: value}}. A metric's name up to the first _ says which; one that fails is logged and left out."""
        self.check(anon_docs, metrics)
        names = [r[0] for r in anon_docs.groupBy("anon_name").agg(F.min("anon_ord").alias("o")).orderBy("o").collect()]
        known = anon_docs.join(self.documents.select("doc_id"), "doc_id", "left_semi")
        masks = maskings.join(self.documents.select("doc_id"), "doc_id", "left_semi")
        if results_file_path:
            J.append_result(results_file_path, ["Metric/Anonymization", *names])
        results = {}
        for name, options in metrics.items():
            function = self.measures().get(T.metric_key(name))
            if function is None:
                logging.warning("unknown metric %s", name)
                continue
            try:
                found = {r[0]: r[1] for r in function(known, masks, **options).collect()}
            except Exception:
                logging.exception("metric %s failed", name)
                continue
            results[name] = {n: found[n] for n in names if n in found}
            if results_file_path:
                J.append_result(results_file_path, [name, *(str(found.get(n)) if isinstance(found.get(n), dict) else found.get(n) for n in names)])
            logging.info("%s: %s", name, results[name])
        return results


def results_long(results: dict[str, dict]) -> list[tuple]:
    """(metric_name, metric_key, anon_name, value, by_type) rows of evaluate()'s results."""
    return [(m, T.metric_key(m), a, None if isinstance(v, dict) else float(v), v if isinstance(v, dict) else None) for m, by in results.items() for a, v in by.items()]
