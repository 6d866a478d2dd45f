"""Text index, BM25, exact cosine, and rank fusion over many queries at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from facetloom.functions import text as X
from facetloom.operators.ordering import top_k
from facetloom.session import spread_join

K1, B = 1.2, 0.75  # published Okapi constants
MIN_IDF = 1e-6


def _stemmer():
    # Nested, so that it travels to executors by value.
    def stem_batch(words: pd.Series) -> pd.Series:
        from facetloom.functions.stem import fold_and_stem

        return words.map(lambda w: None if w is None else fold_and_stem(w))

    return pandas_udf(stem_batch, StringType())


def stems(words: Column) -> Column:
    """Stems of words, diacritics removed; ask for distinct ones."""
    return _stemmer()(words)


def text_index(
    documents: DataFrame, id_col: str, text_col: str, stem: bool = True, unicode: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (term, id, tf, dl), term statistics (term, df) and totals (n, avgdl).

    Terms are counted inside each document row, so the exploded rows are one per
    distinct term.  Stems (with diacritics removed) are computed once per
    distinct word of the whole collection and joined back.
    """
    words = documents.select(
        F.col(id_col).alias("id"), X.document_terms(F.col(text_col), unicode).alias("words")
    ).withColumn("dl", F.size("words"))
    if not stem:
        postings = (
            words.select("id", "dl", F.explode("words").alias("term"))
            .groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
        )
    else:
        counted = (
            words.select("id", "dl", F.explode("words").alias("word"))
            .groupBy("id", "dl", "word").agg(F.count("*").alias("tf"))
        )
        lexicon = counted.select("word").distinct().withColumn("term", _stemmer()(F.col("word")))
        postings = (
            counted.join(lexicon, "word").groupBy("id", "dl", "term").agg(F.sum("tf").alias("tf"))
        )
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    totals = words.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return postings.select("term", "id", "tf", "dl"), terms, totals


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(MIN_IDF))


def bm25_search(
    queries: DataFrame,
    postings: DataFrame,
    terms: DataFrame,
    totals: DataFrame,
    candidates: DataFrame | None = None,
    limit: int = 500,
) -> DataFrame:
    """(query_id, id, score, rank): OR search, best ``limit`` per query.

    ``queries``: (query_id, tokens).  ``candidates``: (query_id, id) restricts a
    query's hits before anything is summed; scores keep collection statistics.
    Query terms are joined to their statistics first, then to the postings; a
    candidate meets its query's terms and its document's counts as two short lists,
    so it stays one row.  Hot terms, documents and queries are salted.
    """
    if limit < 0:
        raise ValueError("limit must be non-negative")
    asked = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    # One totals row rides along with the small query side.
    weighted = (
        asked.join(terms, "term").crossJoin(F.broadcast(totals))
        .select("query_id", "term", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    )
    part = lambda tf, idf, dl, avgdl: idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))
    if candidates is None:
        hits = spread_join(postings, weighted, ["term"], ["id"])
        gain = part(F.col("tf"), F.col("idf"), F.col("dl"), F.col("avgdl"))
        scored = hits.groupBy("query_id", "id").agg(F.sum(gain).alias("score"))
    else:
        # Only what a query may find is looked at, and of its document only terms that anybody asked for.
        lists = weighted.groupBy("query_id").agg(
            F.collect_list(F.struct("term", "idf")).alias("asked"), F.any_value("avgdl").alias("avgdl")
        )
        wanted = postings.join(asked.select("term").distinct(), "term", "left_semi")
        counts = wanted.groupBy("id").agg(
            F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("said"), F.any_value("dl").alias("dl")
        )
        mine = spread_join(candidates.select("query_id", "id").distinct(), lists, ["query_id"], ["id"])
        met = spread_join(mine, counts, ["id"], ["query_id"])
        gains = F.filter(
            F.transform("asked", lambda a: part(F.try_element_at("said", a["term"]), a["idf"], F.col("dl"), F.col("avgdl"))),
            lambda g: g.isNotNull(),
        )
        scored = met.withColumn("_gains", gains).where(F.size("_gains") > 0).select(
            "query_id", "id", F.aggregate("_gains", F.lit(0.0), lambda s, g: s + g).alias("score")
        )
    # Sums taken in another order may differ in the last bits: ties are exact
    # to nine decimals.
    return top_k(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc("id")], limit)


def l2_normalize(vector: Column) -> Column:
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return F.transform(wide, lambda x: x / norm)


def cosine_pairs(queries: DataFrame, vectors: DataFrame, candidates: DataFrame, limit: int) -> DataFrame:
    """Exact cosine over supplied (query_id, id[, position]) candidates.

    Candidates without a vector are dropped; a query whose vector is zero or not
    finite keeps its candidates in the given order, as does one none of whose
    candidates has a vector.
    """
    q = queries.select("query_id", F.col("vector").alias("qv")).withColumn(
        "qnorm", F.sqrt(F.aggregate("qv", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    )
    usable = F.col("qnorm").isNotNull() & ~F.isnan("qnorm") & (F.col("qnorm") > 0) & (F.col("qnorm") < float("inf"))
    if "position" not in candidates.columns:
        candidates = candidates.withColumn("position", F.lit(0))
    rows = candidates.join(vectors.select("id", "vector"), "id", "left")
    joined = spread_join(rows, q.withColumn("usable", usable), ["query_id"], ["id"])
    product = F.aggregate(
        F.zip_with("qv", "vector", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    scored = joined.withColumn(
        "score", F.when(F.col("usable") & F.col("vector").isNotNull(), product / F.col("qnorm"))
    )
    ranked = scored.groupBy("query_id").agg(F.max("score").isNotNull().alias("any_score"))
    kept = spread_join(scored, ranked, ["query_id"], ["id"]).filter(
        ~F.col("any_score") | F.col("score").isNotNull()
    )
    order = [F.desc("score"), F.when(F.col("any_score"), 0).otherwise(F.col("position")), F.asc("id")]
    return top_k(kept, ["query_id"], order, limit).select("query_id", "id", "score", "rank")


def cosine_shared(queries: DataFrame, candidates: DataFrame, group: str, limit: int) -> DataFrame:
    """``cosine_pairs`` where all queries of a ``group`` have its candidates.

    ``queries``: (query_id, vector, group), ``candidates``: (group, id, vector), a few queries a group.  They
    travel as a list, so candidates and their vectors are shuffled once per group, and pairs as scores only.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    usable = F.col("qnorm").isNotNull() & ~F.isnan("qnorm") & (F.col("qnorm") > 0) & (F.col("qnorm") < float("inf"))
    q = queries.withColumn("qnorm", norm).groupBy(group).agg(
        F.collect_list(F.struct("query_id", F.when(usable, F.col("vector")).alias("qv"), "qnorm")).alias("queries")
    )
    rows = spread_join(candidates, q, [group], ["id"]).select("id", "vector", F.inline("queries"))
    product = F.aggregate(
        F.zip_with("qv", "vector", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    scored = rows.select("query_id", "id", (product / F.col("qnorm")).alias("score"))
    # Candidates without a score count for queries that have no other.
    best = top_k(scored, ["query_id"], [F.desc_nulls_last("score"), F.asc("id")], limit)
    best = best.withColumn("_best", F.max("score").over(Window.partitionBy("query_id")))
    return best.where(F.col("_best").isNull() | F.col("score").isNotNull()).select("query_id", "id", "score", "rank")


def cosine_within(queries: DataFrame, vectors: DataFrame, group: str, limit: int, tile: int = 4096) -> DataFrame:
    """``cosine_pairs`` where a query's candidates are all other vectors of its ``group``.

    ``queries``: (query_id, vector, group), ``vectors``: (id, vector, group).  A group is
    cut into tiles of about ``tile`` rows, a task multiplies one tile of queries with one
    of vectors and emits at most ``limit`` rows per query: no pair is ever written.  The
    product only picks; who may be among the best is summed again in the order of the
    vector, so equal vectors score equally.
    """
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    schema = StructType([
        StructField("query_id", queries.schema["query_id"].dataType), StructField("id", vectors.schema["id"].dataType),
        StructField("score", DoubleType()), StructField("scored", BooleanType()),
    ])
    wide = F.transform("vector", lambda x: x.cast("double"))
    whole = F.when(~F.exists("vector", lambda x: x.isNull()), wide)
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))

    def tiles(df: DataFrame, key: str) -> DataFrame:
        sizes = df.groupBy(group).agg(F.ceil(F.count("*") / tile).alias(f"n_{key}"))
        return sizes.where(F.col(group).isNotNull())

    counts = tiles(queries, "q").join(tiles(vectors, "v"), group)

    def dealt(df: DataFrame, key: str, own: str, other: str, *columns: Column) -> DataFrame:
        rows = spread_join(df, counts, [group], [key])
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)).alias(other)
        return rows.select(F.col(group).alias("g"), F.pmod(F.xxhash64(key), F.col(f"n_{own}")).alias(own), every, key, *columns)

    left = dealt(queries, "query_id", "q", "v", whole.alias("vector"), norm.alias("norm"))
    right = dealt(vectors, "id", "v", "q", whole.alias("vector"))

    def multiply(asked: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = {"query_id": [], "id": [], "score": [], "scored": []}

        def tell(name, found, scores=None):
            out["query_id"].extend([name] * len(found))
            out["id"].extend(found)
            out["score"].extend([None] * len(found) if scores is None else scores)
            out["scored"].extend([scores is not None] * len(found))

        items = items.sort_values("id", kind="stable")
        ids, sizes = items["id"].to_numpy(), np.array([-1 if v is None else len(v) for v in items["vector"]])
        names, norms = asked["query_id"].to_numpy(), asked["norm"].to_numpy(dtype="float64", na_value=np.nan)
        usable = np.isfinite(norms) & (norms > 0)
        widths = np.array([len(v) if v is not None and ok else -1 for v, ok in zip(asked["vector"], usable)], dtype=int)
        for width in np.unique(widths):
            rows, at = np.flatnonzero(widths == width), np.flatnonzero(sizes == width)
            if width <= 0:
                at = at[:0]
            own = ids[at]
            if len(at):
                v = np.stack(items["vector"].iloc[at].to_list()).astype("float64")
                reach = np.sqrt((v * v).sum(axis=1)).max()
            for low in range(0, len(rows), 256):
                block = rows[low : low + 256]
                done = np.zeros(len(block), bool)
                if len(at):
                    q = np.stack(asked["vector"].iloc[block].to_list()).astype("float64")
                    near = q @ v.T
                    k = min(limit + 1, len(at))
                    floor = np.partition(near, len(at) - k, axis=1)[:, len(at) - k]
                    floor = floor - 8 * width * np.finfo("float64").eps * norms[block] * reach
                    r, c = np.nonzero(~(near < floor[:, None]) & (own[None, :] != names[block][:, None]))
                    total = np.zeros(len(r))
                    for d in range(width):
                        total += q[r, d] * v[c, d]
                    total /= norms[block][r]
                    order = np.lexsort((c, -total, ~np.isnan(total), r))
                    r, c, total = r[order], c[order], total[order]
                    starts = np.searchsorted(r, np.arange(len(block)))
                    stops = np.searchsorted(r, np.arange(len(block)), side="right")
                    for i, (a, b) in enumerate(zip(starts, stops)):
                        done[i] = b > a
                        tell(names[block[i]], own[c[a:b][:limit]].tolist(), total[a:b][:limit].tolist())
                for i in np.flatnonzero(~done):
                    name = names[block[i]]
                    firsts = ids[: limit + 1][ids[: limit + 1] != name][:limit].tolist()
                    tell(name, firsts)
        return pd.DataFrame(out)

    found = left.groupBy("g", "q", "v").cogroup(right.groupBy("g", "q", "v")).applyInPandas(multiply, schema)
    # Arrow takes a NaN of pandas for a null.
    score = F.when(F.col("scored"), F.coalesce("score", F.lit(float("nan"))))
    found = found.select("query_id", "id", score.alias("score"))
    # A tile without a usable vector offers its first ids; they count if no tile has a score.
    best = top_k(found, ["query_id"], [F.desc_nulls_last("score"), F.asc("id")], limit)
    best = best.withColumn("_best", F.max("score").over(Window.partitionBy("query_id")))
    return best.where(F.col("_best").isNull() | F.col("score").isNotNull()).select("query_id", "id", "score", "rank")


def cosine_topk(
    queries: DataFrame, vectors: DataFrame, limit: int, block: int = 256, pack: int = 50_000, tile: int = 16_384
) -> DataFrame:
    """Exact cosine of every query against all vectors, best ``limit`` each.

    Queries are dealt into tiles of about ``tile`` vectors and items into packs of about ``pack``; a task
    multiplies one tile, ``block`` queries at a time, with one pack and emits at most ``limit`` rows per
    query, so scores are never materialised for all pairs, a task's memory does not grow with the tables
    and an item is copied once per tile.  A zero or NaN query gets the first items by id with score 0.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    query_type = queries.schema["query_id"].dataType
    item_type = vectors.schema["id"].dataType
    schema = StructType(
        [StructField("query_id", query_type), StructField("id", item_type), StructField("score", DoubleType())]
    )
    q = queries.filter(F.col("vector").isNotNull())
    n_tiles = max(1, -(-q.count() // tile))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    spread = max(cores, -(-vectors.count() // pack))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    # Each tile meets each pack once.
    left = vectors.select(F.pmod(F.xxhash64("id"), F.lit(spread)).alias("p"), "id", F.col("vector").alias("item")).withColumn("b", every(n_tiles))
    right = q.select(
        F.pmod(F.xxhash64("query_id"), F.lit(n_tiles)).alias("b"), "query_id", F.col("vector").alias("asked")
    ).withColumn("p", every(spread))

    def multiply(left_batches: pd.DataFrame, right_batches: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = {"query_id": [], "id": [], "score": []}
        if len(left_batches) and len(right_batches):
            ids = left_batches["id"].to_numpy()
            items = np.stack(left_batches["item"].to_numpy()).astype("float64")
            by_id = np.argsort(ids, kind="stable")
            ids, items = ids[by_id], items[by_id]
            k = min(limit, len(ids))
            for low in range(0, len(right_batches), block):
                part = right_batches.iloc[low : low + block]
                m = np.stack([np.asarray(v, dtype="float64") for v in part["asked"]])
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                # A query without direction scores everything zero: order by id.
                m = np.where(np.isfinite(norm) & (norm > 0), m / np.where(norm > 0, norm, 1), 0.0)
                scores = m @ items.T
                for name, row in zip(part["query_id"].tolist(), scores):
                    near = np.round(row, 12)
                    near[np.isnan(near)] = -np.inf
                    # Only what reaches the last place is put in order.
                    at = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k]) if k else np.arange(0)
                    best = at[np.argsort(-near[at], kind="stable")[:k]]
                    out["query_id"].extend([name] * len(best))
                    out["id"].extend(ids[best].tolist())
                    out["score"].extend(row[best].tolist())
        return pd.DataFrame(out)

    partial = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(multiply, schema)
    return top_k(partial, ["query_id"], [F.desc(F.round("score", 12)), F.asc("id")], limit)


def rrf_fuse(rankings: DataFrame, k: int = 60, limit: int = 10) -> DataFrame:
    """Weighted reciprocal rank fusion.

    ``rankings``: (query_id, source, rank, id, weight); sources are numbered in
    list order.  Repeats within a list count once at their best place, which
    also moves later entries up; weights that are not positive are skipped.
    Ties go to the id seen first (earlier list, then rank), then to the id.
    """
    if k < 0:
        raise ValueError("k must be non-negative")
    firsts = (
        rankings.filter(F.col("weight") > 0)
        .groupBy("query_id", "source", "id")
        .agg(F.min("rank").alias("rank"), F.max("weight").alias("weight"))
    )
    # Lists are bounded by the retrieval depth of their source.
    w = Window.partitionBy("query_id", "source").orderBy("rank", "id")
    placed = firsts.withColumn("place", F.row_number().over(w))
    fused = placed.groupBy("query_id", "id").agg(
        F.sum(F.col("weight") / (k + F.col("place"))).alias("score"),
        F.min(F.struct("source", "place")).alias("seen"),
    )
    order = [F.desc(F.round("score", 12)), F.asc("seen"), F.asc("id")]
    return top_k(fused, ["query_id"], order, max(0, int(limit))).select("query_id", "id", "score", "rank")


def hybrid_rank(
    base: DataFrame, lexical: DataFrame | None, dense: DataFrame | None, mode: str, limit: int = 10
) -> DataFrame:
    """Fuse ranker, lexical and dense lists of (query_id, id, rank).

    Weights: ranker 0.75; lexical 1.0, or 0.75 next to dense; dense 1.5.  In
    dense mode a query without a dense list uses its lexical list at 1.0.  A
    query with one list keeps it as it is.
    """
    if mode not in ("off", "lexical", "dense", "hybrid"):
        raise ValueError("mode must be off, lexical, dense, or hybrid")

    def source(df: DataFrame, number: int, weight: float) -> DataFrame:
        return df.select(
            "query_id", F.lit(number).alias("source"), "rank", "id", F.lit(weight).alias("weight")
        )

    lists = source(base, 0, 0.75)
    if lexical is not None and mode in ("lexical", "hybrid"):
        lists = lists.unionByName(source(lexical, 1, 1.0 if mode == "lexical" else 0.75))
    if mode in ("dense", "hybrid") and dense is not None:
        lists = lists.unionByName(source(dense, 2, 1.5))
    if mode == "dense" and lexical is not None:
        rest = lexical if dense is None else lexical.join(dense.select("query_id").distinct(), "query_id", "left_anti")
        lists = lists.unionByName(source(rest, 3, 1.0))
    return rrf_fuse(lists, 60, max(0, min(10, int(limit))))
