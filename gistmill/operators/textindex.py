"""Full-text search with BM25 over weighted columns.

Two forms of one ranking. `search` scores by a single scan: query words are few, so their frequencies come from the
token arrays without exploding them, and each text is cut into tokens once: its length and hits are a few numbers, cut
with a checkpoint, from which statistics (one row) and the best rows (by a bounded heap per task) are read.
`postings` and `search_postings` keep an index: one row for each (document, term) with weighted frequency and places,
partitioned by a hash of the term, so that a query reads only its terms' partitions.

N, document counts and the average length cover the whole index; labels and sources filter afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import text as X
from gistmill.session import durable

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
TERM_PARTITIONS = 64


def _and_is(word: str) -> Callable[[Column, Column], Column]:
    return lambda hit, token: F.coalesce(hit & (token == word), F.lit(False))


def phrase_hits(tokens: Column, phrase: list[str]) -> Column:
    """How often the tokens of a phrase stand side by side."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    # shifted copies side by side: no lambda reads the token array again, so the cost stays linear
    hits = F.transform(tokens, lambda t: t == phrase[0])
    for k, word in enumerate(phrase[1:], start=1):
        shifted = F.slice(tokens, k + 1, F.greatest(F.size(tokens), F.lit(1)))
        hits = F.zip_with(hits, shifted, _and_is(word))
    return F.size(F.filter(hits, lambda h: h))


def bm25(tf: Column, length: Column, average: Column, n: Column, docs: Column) -> Column:
    idf = F.greatest(F.log((docs - n + 0.5) / (n + 0.5)), F.lit(IDF_FLOOR))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def search(docs: DataFrame, query: str, id_col: str = "doc_id", columns: dict[str, float] | None = None, limit: int | None = 20, where: Column | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Rows that hold all words of the query, best first, with a score; columns maps text columns to weights. keep names
    the columns of docs in the result (all, if not given); the id names a row."""
    columns = columns or {"text": 1.0}
    words = X.query_words(query)
    rest = [c for c in (docs.columns if keep is None else keep) if c != id_col]
    if not words:
        return docs.limit(0).select(id_col, *rest).withColumn("score", F.lit(0.0))
    held = F.struct(*[X.tokens(docs[c]).alias(c) for c in columns])

    def numbers(t: Column) -> Column:
        """The tokens' number, and each word's weighted hits."""
        length = reduce(lambda a, b: a + b, [F.size(t[c]) for c in columns]).cast("double")
        return F.array(length, *[reduce(lambda a, b: a + b, [w * phrase_hits(t[c], p) for c, w in columns.items()]).cast("double") for p in words])

    # a lambda over one value: the tokens are made once, however often its body reads them
    measured = durable(docs.select(F.col(id_col), (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("_in"), F.element_at(F.transform(F.array(held), numbers), 1).alias("_m")))
    hits = [F.element_at("_m", k + 2) for k in range(len(words))]
    stats = measured.agg(F.count("*").alias("_docs"), F.avg(F.element_at("_m", 1)).alias("_avg"), *[F.count_if(h > 0).alias(f"_n{k}") for k, h in enumerate(hits)])
    found = measured.where(F.col("_in") & reduce(lambda a, b: a & b, [h > 0 for h in hits]))
    score = reduce(lambda a, b: a + b, [bm25(h, F.element_at("_m", 1), F.col("_avg"), F.col(f"_n{k}"), F.col("_docs")) for k, h in enumerate(hits)])
    ranked = found.join(F.broadcast(stats)).select(id_col, score.alias("score"))  # stats is one row
    ranked = ranked.orderBy(F.col("score").desc(), id_col).limit(limit) if limit else ranked
    if not rest:
        return ranked
    back = ranked.join(docs.select(id_col, *rest), id_col).select(*[c for c in docs.columns if c == id_col or c in rest], "score")
    return back.orderBy(F.col("score").desc(), id_col) if limit else back


def postings(docs: DataFrame, id_col: str = "doc_id", columns: dict[str, float] | None = None) -> DataFrame:
    """(part, term, id, column, tf, places): the index; write it partitioned by part."""
    columns = columns or {"text": 1.0}
    each = [docs.select(docs[id_col].alias("id"), F.lit(c).alias("column"), F.lit(float(w)).alias("weight"), F.posexplode(X.tokens(docs[c])).alias("place", "term")) for c, w in columns.items()]
    return reduce(DataFrame.unionByName, each).groupBy("term", "id", "column", "weight").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("place")).alias("places")).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(TERM_PARTITIONS)).cast("int"))


def doc_stats(docs: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ("text",)) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), reduce(lambda a, b: a + b, [F.size(X.tokens(docs[c])) for c in columns]).alias("length"))


def search_postings(index: DataFrame, stats: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """(id, score) from the index. A word of several tokens is a phrase: its places are those of its first token that the
    others follow one after the other."""
    words = X.query_words(query)
    terms = sorted({t for p in words for t in p})
    parts = [F.pmod(F.xxhash64(F.lit(t)), F.lit(TERM_PARTITIONS)).cast("int") for t in terms]
    rows = index.where(F.col("term").isin(terms) & reduce(lambda a, b: a | b, [F.col("part") == p for p in parts]))
    # one row for each document and column, with the places of each term
    places = rows.groupBy("id", "column", "weight").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("places"))
    none = F.array().cast("array<int>")

    def starts(term: str, k: int) -> Column:
        """Where a phrase starts whose token k is the term."""
        return F.transform(F.coalesce(F.col("places")[term], none), lambda x: x - k)

    def of(phrase: list[str]) -> Column:
        at = [starts(t, k) for k, t in enumerate(phrase)]
        return F.size(reduce(F.array_intersect, at)) if len(at) > 1 else F.size(at[0])

    hits = [F.sum(F.col("weight") * of(p)).alias(f"h{k}") for k, p in enumerate(words)]
    # read twice below, and few numbers beside the index
    weighted, stats = durable(places.groupBy("id").agg(*hits)), durable(stats.select("id", "length"))
    n = weighted.agg(*[F.count_if(F.col(f"h{k}") > 0).alias(f"n{k}") for k in range(len(words))])
    total = stats.agg(F.count("*").alias("docs"), F.avg("length").alias("average"))
    found = weighted.where(reduce(lambda a, b: a & b, [F.col(f"h{k}") > 0 for k in range(len(words))]))
    score = reduce(lambda a, b: a + b, [bm25(F.col(f"h{k}"), F.col("length"), F.col("average"), F.col(f"n{k}"), F.col("docs")) for k in range(len(words))])
    ranked = found.join(stats, "id").join(F.broadcast(n)).join(F.broadcast(total)).select("id", score.alias("score"))  # one row each
    return ranked.orderBy(F.col("score").desc(), "id").limit(limit) if limit else ranked
