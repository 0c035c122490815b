"""The read-only tools: search, topics, outline, sources by id, and charts, over tables given as DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .functions.lexicon import Lexicon
from .operators import chart, index, search, structure, taxonomy, trees, vectors
from .operators.classify import Catalogue
from .operators.graph import checkpointed

STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


MODES = ("bm25", "hybrid", "hybrid_rerank")
CATEGORIES = ["same_topic", "parent_topic", "common", "unclassified_fallback"]


def category_label(tier: Column, subtopic: str | None) -> Column:
    names = ["same_subtopic" if subtopic else CATEGORIES[0], *CATEGORIES[1:]]
    return F.get(F.array(*map(F.lit, names)), tier)


@dataclass
class Found:
    """Items in order (a row each, with its ranking), and what there is to say of the search."""

    items: DataFrame
    envelope: dict


@dataclass
class Engine:
    """evidence: evidence_id, kind, source_id, method, author, scope, searchable, chart_valid, group_id, focus, body, start_line;
    evidence_topics: evidence_id, topic; topics: topic, parent, title; outline: node, parent, source_id, start, title;
    evidence_outline: node, evidence_id; sources: source_id, title, body; vectors: evidence_id, vec_id, embedding."""

    evidence: DataFrame
    evidence_topics: DataFrame | None = None
    topics: DataFrame | None = None
    outline: DataFrame | None = None
    evidence_outline: DataFrame | None = None
    sources: DataFrame | None = None
    vectors: DataFrame | None = None
    kinds: tuple[str, ...] = field(default=("rule", "case"))
    #: cells: evidence_id, feature, kind, items; rule_spans and case_spans as search.blocked_rules takes them, the latter with group_id.
    cells: DataFrame | None = None
    rule_spans: DataFrame | None = None
    case_spans: DataFrame | None = None
    lexicon: Lexicon | None = None
    catalogue: Catalogue | None = None
    #: Stored indexes of initial and of full case texts.
    stored: index.Stored | None = None
    stored_full: index.Stored | None = None

    def search(self, query: str, kind: str = "case", limit: int = 3, max_chars: int = 12_000, method: str = "all", author: str = "", topic: str | None = None, include_common: bool = True, exclude_ids: list[str] | None = None, nodes: list[str] | None = None, query_vectors: DataFrame | None = None, require_valid_chart: bool = False) -> DataFrame:
        """The best evidences with rank, rrf, tier and whether they fit the budget; at most `limit` are taken."""
        if kind not in self.kinds or not 1 <= limit <= 20 or not 1000 <= max_chars <= 200_000 or len(nodes or []) > 100:
            raise ValueError("kind, limit, max_chars or nodes is out of range")
        terms = [t for t in dict.fromkeys(re.findall("[a-z]+", query.lower())) if t not in STOP][:50]
        if not terms and not nodes and not topic and query_vectors is None:
            raise ValueError("an empty query needs a topic, an outline node or vectors")
        own = self.evidence.where((F.col("kind") == kind) & F.col("searchable"))
        if method != "all":
            own = own.where(F.col("method").isin(method, "mixed"))
        if author:
            own = own.where(F.contains("author", F.lit(author)))
        if require_valid_chart:
            own = own.where("chart_valid")
        if not include_common:
            own = own.where("scope != 'common'")
        if exclude_ids:
            gone = self.evidence.where(F.col("evidence_id").isin(exclude_ids)).select("group_id")
            own = search.exclude_groups(own, "group_id", gone).where(~F.col("evidence_id").isin(exclude_ids))
        if nodes:
            own = own.join(self.evidence_outline.where(F.col("node").isin(nodes)).select("evidence_id").distinct(), "evidence_id", "left_semi")
        same = F.lit(True)
        if topic:
            mine = self.evidence_topics.where(F.col("topic") == topic).select("evidence_id").distinct().withColumn("_same", F.lit(True))
            own = own.join(mine, "evidence_id", "left").where(F.col("_same") | (F.col("scope") == "common"))
            same = F.coalesce("_same", F.lit(False))
        own = own.withColumn("tier", search.tier(same, F.lit(False), F.col("scope") == "common"))
        k = max(60, limit * 5)
        channels = []
        if terms:
            # Statistics of the whole index, both kinds; the scope restricts candidates by a semi-join.
            scored = index.bm25(self.evidence, "evidence_id", X.tokens(F.col("focus")), X.tokens(F.col("body")), terms, 8.0 if kind == "case" else 2.0)
            channels.append(search.ranked(scored.join(own.select("evidence_id"), "evidence_id", "left_semi"), [F.desc("score"), F.col("evidence_id")], k))
        if query_vectors is not None:
            near = vectors.knn(self.vectors.join(own.select("evidence_id"), "evidence_id", "left_semi"), query_vectors, F.col("evidence_id"), k)
            channels.append(search.ranked(near.withColumnRenamed("evidence", "evidence_id"), [F.desc("score"), F.col("evidence_id")], k))
        if not channels:
            channels.append(search.ranked(own.select("evidence_id", "tier", "source_id", "start_line"), [F.col("tier"), F.col("source_id"), F.col("start_line"), F.col("evidence_id")], k))
        pool = search.fuse(channels, "evidence_id").join(own, "evidence_id")
        order: list[Column] = ([F.col("tier")] if kind == "case" else []) + [F.desc("rrf"), F.col("evidence_id")]
        first = search.first_of_group(pool, F.coalesce("group_id", "evidence_id"), order)
        top = search.ranked(first, order, k).withColumn("all", F.lit(1))
        taken = search.packed(top, "all", ["rank"], F.char_length(F.to_json(F.struct("evidence_id", "source_id", "focus", "body"))), limit, max_chars)
        return top.drop("all").join(taken.drop("all"), "rank")

    def _terms(self, query: str) -> list[str]:
        if self.lexicon:
            return self.lexicon.query_terms(query)
        return [t for t in dict.fromkeys(re.findall("[a-z]+", query.lower())) if t not in STOP][:50]

    def find(self, query: str = "", kind: str = "rule", method: str = "all", topic: str | None = None, subtopic: str | None = None, author: str = "", features: dict | None = None, limit: int | None = None, exclude_ids: list[str] = (), exclude_case_ids: list[str] = (), max_chars: int = 40_000, mode: str = "bm25", nodes: list[str] | None = None, include_common: bool = True, include_unknown: bool = False, require_valid_chart: bool = False, case_text_scope: str = "initial", query_vectors: DataFrame | None = None, windows: DataFrame | None = None) -> Found:
        """The whole search: scope, channels, fusion, groups, tiers, reranking, budget, and the envelope.

        windows: scores (evidence_id, score) of texts' windows for the query, for hybrid_rerank. What is collected is a
        page of at most `limit` rows, flags of channels, and terms of the query.
        """
        limit = limit if limit is not None else 12 if kind == "rule" else 8
        if kind not in self.kinds or method not in ("all", "lifa", "xiangfa") or mode not in MODES or case_text_scope not in ("initial", "full"):
            raise ValueError("kind, method, mode or case_text_scope is unknown")
        if not 1 <= limit <= 100 or not 1000 <= max_chars <= 500_000 or len(nodes or []) > 100 or (case_text_scope == "full" and kind != "case"):
            raise ValueError("limit, max_chars, nodes or case_text_scope is out of range")
        features = {k: v for k, v in (features or {}).items() if v is not None}
        hints: list[str] = []
        if method == "xiangfa":
            topic = subtopic = None
        elif (topic or subtopic) and self.catalogue:
            topic, subtopic = self.catalogue.resolve(topic, subtopic)
        elif self.catalogue:
            hints = self.catalogue.classify(query)["roots"]  # said in the envelope, never used in ranking
        terms = self._terms(query)
        if not terms and not features and not nodes and not topic:
            raise ValueError("an empty query needs features, an outline node or a topic")
        if nodes:
            held = {r.node for r in self.outline.where(F.col("node").isin(nodes)).select("node").distinct().collect()}
            if set(nodes) - held:
                raise ValueError(f"unknown outline nodes: {sorted(set(nodes) - held)}")
        spark, own = self.evidence.sparkSession, self.evidence.where((F.col("kind") == kind) & F.col("searchable"))
        gone = [*exclude_ids, *exclude_case_ids]
        groups = self.evidence.where(F.col("evidence_id").isin(gone)) if gone else None
        if gone:
            own = own.where(~F.col("evidence_id").isin(gone))
            if kind == "case" or exclude_case_ids:
                own = search.exclude_groups(own, "group_id", groups.where("kind = 'case'").select("group_id"))
            if kind == "rule":
                own = search.exclude_groups(own, "group_id", groups.where("kind = 'rule'").select("group_id"))
                if exclude_case_ids and self.rule_spans is not None:
                    cases = self.case_spans.join(groups.where("kind = 'case'").select("group_id").distinct(), "group_id", "left_semi")
                    own = own.join(search.blocked_rules(self.rule_spans, cases), "evidence_id", "left_anti")
        if method != "all":
            own = own.where(F.col("method").isin(method, "mixed"))
        if author:
            own = own.where(F.contains("author", F.lit(author)))
        if nodes:
            own = own.join(self.evidence_outline.where(F.col("node").isin(nodes)).select("evidence_id").distinct(), "evidence_id", "left_semi")
        if kind == "case" and (require_valid_chart or features):
            own = own.where("chart_valid")
        if not include_common:
            own = own.where("scope != 'common'")
        rank = F.lit(0)
        if topic:
            t = self.evidence_topics.where(F.col("topic").isNotNull()).groupBy("evidence_id").agg(F.max(F.col("topic") == topic).alias("_t"), F.max(F.col("topic") == F.lit(subtopic)).alias("_s"), F.lit(True).alias("_any"))
            own = own.join(t, "evidence_id", "left")
            common = F.lit(include_common) & (F.col("scope") == "common")
            own = own.where(F.coalesce("_t", F.lit(False)) | common | (F.lit(include_unknown) & F.col("_any").isNull()))
            narrow = F.lit(True) if subtopic is None else F.coalesce("_s", F.lit(False))
            rank = search.tier(F.coalesce("_t", F.lit(False)) & narrow, F.coalesce("_t", F.lit(False)), F.col("scope") == "common")
        own = own.withColumn("tier", rank)
        scope, k, channels, more = own.select("evidence_id"), max(60, limit * 5), [], []

        def channel(scored: DataFrame, order: list[Column]) -> None:
            ranked = checkpointed(search.ranked(scored, order, k + 1))  # a page of rows: the search itself runs once
            more.append(ranked.where(F.col("rank") > k))
            channels.append(ranked.where(F.col("rank") <= k))

        by_score = [F.desc("score"), F.col("evidence_id")]
        if not terms and not features:
            channel(own.select("evidence_id", "tier", "source_id", "start_line"), [F.col(c) for c in ("tier", "source_id", "start_line", "evidence_id")])
        unmatched: list[str] = []
        if terms:
            held, weight = self.stored_full if case_text_scope == "full" else self.stored, 8.0 if kind == "case" else 2.0
            if held:
                channel(held.bm25(terms, weight, scope), by_score)
                unmatched = held.unmatched(terms, scope)
            else:
                focus, body = X.tokens(F.col("focus")), X.tokens(F.col("body"))
                channel(index.bm25(self.evidence, "evidence_id", focus, body, terms, weight).join(scope, "evidence_id", "left_semi"), by_score)
                unmatched = [r.term for r in index.unmatched(terms, own, F.concat(focus, body), F.lit(True)).collect()]
        if mode != "bm25" and query_vectors is not None:
            near = vectors.knn(self.vectors.join(scope, "evidence_id", "left_semi"), query_vectors, F.col("evidence_id"), k + 1)
            channel(near.withColumnRenamed("evidence", "evidence_id"), by_score)
        if kind == "case" and features and self.cells is not None:
            cells = self.cells.join(scope, "evidence_id", "left_semi")
            channel(structure.scored_items(cells, structure.request_of(spark, features), "evidence_id"), [F.desc("score"), F.desc("n_matched"), F.col("evidence_id")])
        pool = search.fuse(channels, "evidence_id").join(own, "evidence_id")
        first = search.first_of_group(pool, F.coalesce("group_id", "evidence_id"), [F.desc("rrf"), F.col("evidence_id")])
        order: list[Column] = [F.desc("rrf"), F.col("evidence_id")]
        if mode == "hybrid_rerank" and windows is not None:
            if kind == "case" and topic:
                first = first.withColumn("_rrf", F.col("rrf")).withColumn("rrf", F.col("rrf") - F.col("tier"))  # the head is taken in order of tiers
            head = search.reranked(first, "evidence_id", windows, limit)
            first = head.withColumn("rrf", F.col("_rrf")).drop("_rrf") if "_rrf" in head.columns else head
            order = [F.desc_nulls_last("rerank"), *order]
        if kind == "case" and topic:
            order = [F.col("tier"), *order]
        top = checkpointed(search.ranked(first, order, 4 * k).withColumn("all", F.lit(1)))
        taken = search.packed(top, "all", ["rank", "evidence_id"], F.char_length(F.to_json(F.struct("evidence_id", "source_id", "focus", "body"))), limit, max_chars)
        rows = taken.select("rank", "evidence_id", "size", "taken", "used").orderBy("rank").collect()  # candidates of one page
        ids = [r.evidence_id for r in rows if r.taken]
        last = max((r["rank"] for r in rows if r.taken), default=0) if len(ids) == limit else 10**9
        label = category_label(F.col("tier"), subtopic)
        items = top.drop("all").where(F.col("evidence_id").isin(ids)).withColumn("category_match", label if topic else F.lit(None).cast("string"))
        flags = any(not m.isEmpty() for m in more)
        return Found(items, {
            "query_terms": terms, "query_negations": self.lexicon.negations(query) if self.lexicon else [], "unmatched_query_terms": unmatched, "topic_hints": hints, "topic": topic, "subtopic": subtopic,
            "query_context": self.catalogue.titles(topic, subtopic) if self.catalogue else [], "requested": limit, "returned": len(ids), "has_more": flags or len(rows) > len(ids), "candidates": len(rows),
            "budget_skipped": [{"evidence_id": r.evidence_id, "required_chars": r.size} for r in rows if not r.taken and r["rank"] < last], "used_chars": max((r.used for r in rows), default=0), "max_chars": max_chars, "retrieval": mode, "structural_matching": bool(features and kind == "case"), "case_text_scope": case_text_scope,
        })

    def get_topics(self, parent: str | None = None) -> DataFrame:
        t = self.topics if parent is None else self.topics.where(F.col("parent") == parent)
        return taxonomy.counts(t, self.evidence_topics)

    def browse_outline(self, parent: str | None, offset: int = 0, limit: int = 50) -> DataFrame:
        n = trees.children(self.outline, "node", "parent")
        return search.page(n.where(F.col("parent").eqNullSafe(F.lit(parent))), ["start", "node"], offset, limit)

    def get_source(self, id_: str, offset: int = 0, size: int = 4000) -> DataFrame:
        """The first of an evidence, an outline node or a source of that id, with a page of its text."""
        parts = [self.evidence.where(F.col("evidence_id") == id_).select(F.col("evidence_id").alias("id"), F.lit(0).alias("priority"), F.col("body").alias("text"))]
        if self.outline is not None:
            parts.append(self.outline.where(F.col("node") == id_).select(F.col("node").alias("id"), F.lit(1).alias("priority"), F.col("title").alias("text")))
        if self.sources is not None:
            parts.append(self.sources.where(F.col("source_id") == id_).select(F.col("source_id").alias("id"), F.lit(2).alias("priority"), F.col("body").alias("text")))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.orderBy("priority").limit(1).select("id", X.char_page(F.col("text"), offset, size).alias("page"), (F.char_length("text") > offset + size).alias("has_more"))

    def source_lines(self, id_: str, context_lines: int = 0, offset: int = 0, max_chars: int = 40_000) -> DataFrame:
        """Text of an evidence's lines with lines around it, as a page: text, start_line, end_line, total, next_offset, has_more.

        evidence needs start_line and end_line, sources the body that they count in.
        """
        if not 0 <= context_lines <= 200 or offset < 0 or not 1000 <= max_chars <= 500_000:
            raise ValueError("context_lines, offset or max_chars is out of range")
        own = self.evidence.where(F.col("evidence_id") == id_).select("evidence_id", "source_id", "start_line", "end_line")
        both = own.join(self.sources.select("source_id", F.split("body", "\n").alias("l")), "source_id")
        first = F.greatest(F.col("start_line") - context_lines, F.lit(1))
        last = F.least(F.col("end_line") + context_lines, F.size("l"))
        text = both.select("evidence_id", "source_id", first.alias("start_line"), last.alias("end_line"), F.array_join(F.slice("l", first, last - first + 1), "\n").alias("t"))
        end, n = offset + max_chars, F.char_length("t")
        return text.select("evidence_id", "source_id", "start_line", "end_line", F.substring("t", offset + 1, max_chars).alias("text"), n.alias("total"), F.when(n > end, F.lit(end)).alias("next_offset"), (n > end).alias("has_more"))

    @staticmethod
    def inspect_chart(casts: DataFrame, most: int = 10) -> DataFrame:
        """The first `most` review checks of each chart, in order, and whether there are more."""
        if not 1 <= most <= 100:
            raise ValueError("the number of checks is out of range")
        checks = chart.review(casts.where(chart.valid(F.col("v")))).groupBy("chart_id").agg(F.array_sort(F.collect_list("check_id")).alias("c"))  # a chart has a few dozen
        return checks.select("chart_id", F.slice("c", 1, most).alias("checks"), (F.size("c") > most).alias("has_more"))

    @staticmethod
    def build_chart(casts: DataFrame) -> dict[str, DataFrame]:
        ok = casts.where(chart.valid(F.col("v")))
        return {"lines": chart.lines(ok), "features": chart.features(ok), "patterns": chart.patterns(ok), "chains": chart.chains(ok), "review": chart.review(ok)}
