"""Features, models, validation and prediction on ``pyspark.ml`` and plain aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import feature as X
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.windows import prefix_sums
from plumbline.session import cut_lineage

#: Rows that a driver-side fit may take at most: a bounded, seeded sample of labelled rows.
FIT_ROWS = 100_000

# Words that carry no meaning of their own.
STOP = "a an and are as at be by for from has in is it its of on or that the this to was we were will with you your our".split()


# text features

def tokens(text: str, out: str = "tokens", pattern: str = r"[a-z][a-z0-9]*(?:[./][a-z0-9]+)*", stop: Sequence[str] = STOP) -> list:
    """Stages: words of two letters and more, with inner dots and slashes kept, without stop words."""
    return [
        X.RegexTokenizer(inputCol=text, outputCol=f"{out}_raw", pattern=pattern, gaps=False, minTokenLength=2),
        X.StopWordsRemover(inputCol=f"{out}_raw", outputCol=out, stopWords=list(stop)),
    ]


def counts(text: str, out: str, min_df: float = 5, max_df: float = 0.6, size: int = 5000, n: int = 1, binary: bool = False) -> Pipeline:
    """Text to a count vector over words or ``n``-grams."""
    stages = tokens(text, "tokens")
    col = "tokens"
    if n > 1:
        stages.append(X.NGram(n=n, inputCol="tokens", outputCol="grams"))
        col = "grams"
    return Pipeline(stages=[*stages, X.CountVectorizer(inputCol=col, outputCol=out, minDF=min_df, maxDF=max_df, vocabSize=size, binary=binary)])


def ngram_totals(df: DataFrame, doc: str, text: str, out: str, n: int = 2, min_df: int = 1, pattern: str = r"[a-z][a-z0-9]*(?:[./][a-z0-9]+)*", stop: Sequence[str] = STOP) -> DataFrame:
    """``out, n``: how often each ``n``-gram of :func:`tokens` stands in all lower-case texts, of those in ``min_df`` documents at least.

    Counts are added up map-side from the texts themselves; no vocabulary reaches the driver and none is cut.
    """
    words = df.select(doc, F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.isin(*stop)).alias("w"))
    size = F.greatest(F.size("w") - (n - 1), F.lit(0))
    grams = F.slice("w", 1, size)
    for i in range(1, n):
        grams = F.zip_with(grams, F.slice("w", i + 1, size), lambda a, b: F.concat_ws(" ", a, b))
    if df.filter(F.col(doc).isNotNull()).groupBy(doc).count().filter("count > 1").isEmpty():
        # a row is a document, so the first of equal neighbours in a sorted row counts it
        rows = words.select(doc, F.sort_array(grams).alias("s"))
        before = F.concat(F.array(F.lit(None).cast("string")), "s")
        marked = F.arrays_zip(F.col("s").alias("gram"), F.slice(before, 1, F.size("s")).alias("before"))
        each = rows.select(doc, F.inline(marked)).toDF(doc, out, "before")
        new = F.col(doc).isNotNull() & ~F.col(out).eqNullSafe(F.col("before"))
        totals = each.groupBy(out).agg(F.count(F.lit(1)).alias("n"), F.sum(new.cast("bigint")).alias("docs"))
    else:
        each = words.select(doc, F.explode(grams).alias(out)).groupBy(out, doc).agg(F.count(F.lit(1)).alias("n"))
        totals = each.groupBy(out).agg(F.sum("n").alias("n"), F.count(doc).alias("docs"))
    return totals.filter(F.col("docs") >= min_df).select(out, "n")


def hashed_tfidf(text: str, out: str, bits: int = 12) -> Pipeline:
    """Text to unit-length tf-idf over hashed words: no vocabulary travels to the driver."""
    return Pipeline(stages=[
        *tokens(text), X.HashingTF(inputCol="tokens", outputCol="tf", numFeatures=1 << bits),
        X.IDF(inputCol="tf", outputCol="idf", minDocFreq=2), X.Normalizer(inputCol="idf", outputCol=out),
    ])


def top_tags(df: DataFrame, tags: str, least: int, k: int) -> DataFrame:
    """``tag, n``: the ``k`` most frequent tags with support ``least``, ties by name; a row counts a tag once."""
    n = df.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "tag").limit(k)


# decompositions, clusters, graphs

def gram(df: DataFrame, vector: str, width: int) -> np.ndarray:
    """The ``width`` x ``width`` matrix of inner products of columns, summed on the executors."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            if len(b):
                m = np.stack(b["v"].to_numpy()).astype(float)
                total += m.T @ m
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    rows = df.select(F.col(vector).alias("v")).filter("v is not null").mapInPandas(work, "i int, row array<double>")
    sums = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    out = np.zeros((width, width))
    for r in sums.collect():  # width squared numbers
        out[r["i"], r["j"]] = r["x"]
    return out


def truncated_svd(df: DataFrame, vector: str, width: int, k: int, out: str) -> tuple[DataFrame, np.ndarray]:
    """``df`` with the uncentred ``k``-dimensional projection of an array column, and the singular values."""
    values, basis = np.linalg.eigh(gram(df, vector, width))
    order = np.argsort(values)[::-1][:k]
    v = basis[:, order]
    v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
    project = [
        F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in v[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        for j in range(k)
    ]
    return df.withColumn(out, F.array(*project)), np.sqrt(np.maximum(values[order], 0))


def topics(df: DataFrame, vector: str, k: int, seed: int = 7, rounds: int = 10):
    """An online LDA model."""
    return K.LDA(k=k, featuresCol=vector, seed=seed, maxIter=rounds, optimizer="online").fit(df)


def nmf(df: DataFrame, doc: str, term: str, weight: str, k: int, seed: int = 7):
    """A non-negative factorisation of a long document-term table (integer ids): alternating least squares with non-negative factors."""
    from pyspark.ml.recommendation import ALS

    return ALS(rank=k, userCol=doc, itemCol=term, ratingCol=weight, nonnegative=True, seed=seed, maxIter=8, regParam=0.01).fit(df)


def unit_clusters(df: DataFrame, array: str, k: int, seed: int = 7, out: str = "cluster") -> DataFrame:
    """``df`` with the k-means cluster of a unit-length array column."""
    v = X.Normalizer(inputCol="_v", outputCol="_u").transform(df.withColumn("_v", array_to_vector(F.transform(array, lambda x: x.cast("double")))))
    return K.KMeans(k=k, featuresCol="_u", predictionCol=out, seed=seed).fit(v).transform(v).drop("_v", "_u")


def communities(edges: DataFrame, a: str, b: str, weight: str, rounds: int = 20, limit: int = 50_000) -> dict[str, int]:
    """Communities of a term graph by greedy modularity moves; the graph of a vocabulary is small, and its size is checked."""
    rows = edges.select(a, b, weight).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("more edges than a vocabulary's graph has; raise the support")
    near: dict[str, dict[str, float]] = {}
    for x, y, w in rows:
        near.setdefault(x, {})[y] = near.setdefault(y, {})[x] = float(w)
    total = sum(w for n in near.values() for w in n.values()) or 1.0
    degree = {n: sum(e.values()) for n, e in near.items()}
    part = {n: i for i, n in enumerate(sorted(near))}
    size = {part[n]: degree[n] for n in near}
    for _ in range(rounds):
        moved = False
        for n in sorted(near):
            size[part[n]] -= degree[n]
            links: dict[int, float] = {part[n]: 0.0}
            for m, w in near[n].items():
                links[part[m]] = links.get(part[m], 0.0) + w
            best = max(sorted(links), key=lambda c: links[c] - size.get(c, 0.0) * degree[n] / total)
            moved |= best != part[n]
            part[n] = best
            size[best] = size.get(best, 0.0) + degree[n]
        if not moved:
            break
    names = {c: i for i, c in enumerate(sorted(set(part.values())))}
    return {n: names[c] for n, c in part.items()}


def spring_layout(edges: DataFrame, a: str, b: str, weight: str, rounds: int = 60, seed: int = 7, limit: int = 50_000) -> DataFrame:
    """``name, x, y`` in the unit square: linked names attract, all repel, ever shorter steps. For a vocabulary's graph, whose size is checked."""
    rows = edges.select(a, b, F.col(weight).cast("double")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("more edges than a vocabulary's graph has; raise the support")
    names = sorted({x for r in rows for x in r[:2]})
    at = {n: i for i, n in enumerate(names)}
    i, j, w = (np.array([f(r) for r in rows]) for f in (lambda r: at[r[0]], lambda r: at[r[1]], lambda r: r[2])) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    p = np.random.default_rng(seed).uniform(0, 1, (len(names), 2))
    ideal = 1 / math.sqrt(max(1, len(names)))
    for k in range(rounds):
        force = np.zeros_like(p)
        for lo in range(0, len(names), 500):  # a block of the pair matrix at a time
            d = p[lo : lo + 500, None] - p[None]
            force[lo : lo + 500] += (d * (ideal**2 / np.maximum((d**2).sum(-1), 1e-9))[..., None]).sum(1)
        d = p[i] - p[j]
        pull = d * (np.linalg.norm(d, axis=1) * w / ideal)[:, None]
        np.add.at(force, i, -pull)
        np.add.at(force, j, pull)
        size = np.maximum(np.linalg.norm(force, axis=1, keepdims=True), 1e-12)
        p += force / size * np.minimum(size, 0.1 * (1 - k / rounds))
    p = (p - p.min(0)) / np.maximum(np.ptp(p, axis=0), 1e-12) if len(p) else p
    return edges.sparkSession.createDataFrame([(n, float(x), float(y)) for n, (x, y) in zip(names, p)], "name string, x double, y double")


def centroids(df: DataFrame, label: str, array: str) -> DataFrame:
    """``label, centroid``: the unit-length mean of each class's array column."""
    m = df.select(label, F.posexplode(array).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    c = m.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return c.select(label, F.expr("transform(c, x -> x / sqrt(aggregate(c, 0d, (a, y) -> a + y * y)))").alias("centroid"))


def cosine(a: str, b: str):
    """The cosine of two array columns, null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p.cast("double") * r.cast("double")), F.lit(0.0), lambda p, r: p + r)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


# validation

def preprocessor(numbers: Sequence[str], categories: Sequence[str], arrays: Sequence[str] = (), out: str = "features") -> Pipeline:
    """Medians for gaps, unit variance, indicators with unseen values kept apart; fitted per fold."""
    filled = [f"{c}_filled" for c in numbers]
    stages: list = [X.Imputer(strategy="median", inputCols=list(numbers), outputCols=filled)] if numbers else []
    if numbers:
        stages += [X.VectorAssembler(inputCols=filled, outputCol="_n"), X.StandardScaler(inputCol="_n", outputCol="_scaled", withMean=True)]
    if categories:
        stages += [
            X.StringIndexer(inputCols=list(categories), outputCols=[f"{c}_i" for c in categories], handleInvalid="keep"),
            X.OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_h" for c in categories], handleInvalid="keep"),
        ]
    inputs = (["_scaled"] if numbers else []) + [f"{c}_h" for c in categories] + list(arrays)
    return Pipeline(stages=[*stages, X.VectorAssembler(inputCols=inputs, outputCol=out)])


def out_of_fold(df: DataFrame, fold: str, k: int, make: Callable[[], Estimator], keep: Sequence[str]) -> DataFrame:
    """``keep.., fold, prediction``: each row predicted by a model that never saw its fold. ``df`` is computed once, not once a pass of each fit."""
    df, out = cut_lineage(df), None
    for i in range(k):
        model = make().fit(df.filter(F.col(fold) != i))
        part = model.transform(df.filter(F.col(fold) == i))
        part = part.select(*keep, fold, "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def regression_scores(df: DataFrame, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """``by.., n, mae, rmse, r2`` of a ``prediction``."""
    e = F.col(truth) - F.col("prediction")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.avg(e * e) / F.var_pop(truth)).alias("r2")
    )


def group_baseline(df: DataFrame, fold: str, group: str, truth: str, keep: Sequence[str]) -> DataFrame:
    """``keep.., fold, prediction``: the other folds' median of the row's group, or of all rows where the group is new.

    Medians leave one fold out at a time by aggregating the rows once for each fold they don't belong to.
    """
    folds = [r[0] for r in df.select(fold).distinct().collect()]  # a few folds
    out_fold = F.explode(F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col(fold)))
    train = df.select(out_fold.alias("_f"), group, truth)
    med = train.groupBy("_f", group).agg(F.percentile(truth, 0.5).alias("_m"))
    allm = train.groupBy("_f").agg(F.percentile(truth, 0.5).alias("_a")).withColumnRenamed("_f", "_g")
    j = df.join(med.withColumnRenamed(group, "_k"), (F.col(fold) == F.col("_f")) & (F.col(group) == F.col("_k")), "left").join(allm, F.col(fold) == F.col("_g"))
    return j.select(*keep, fold, F.coalesce("_m", "_a").alias("prediction"))


def stacked(df: DataFrame, fold: str, k: int, makers: Mapping[str, Callable[[], Estimator]], ident: str, truth: str, l2: float = 1e-3) -> DataFrame:
    """``ident, truth, prediction``: a ridge over the base models' out-of-fold predictions, itself out of fold."""
    base = df.select(ident, fold, truth)
    for name, make in makers.items():
        p = out_of_fold(df, fold, k, make, [ident]).select(ident, F.col("prediction").alias(name))
        base = base.join(p, ident)
    v = X.VectorAssembler(inputCols=list(makers), outputCol="features").transform(base)
    return out_of_fold(v, fold, k, lambda: R.LinearRegression(labelCol=truth, regParam=l2), [ident, truth])


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``df`` with ``n / (classes * rows of the class)``."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    w = n.withColumn(out, F.sum("_n").over(Window.partitionBy()) / (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("_n"))).drop("_n")
    return df.join(w, label)


def text_learners(label: str, features: str) -> dict[str, Callable[[], Estimator]]:
    """Classifiers by name."""
    at = {"labelCol": label, "featuresCol": features}
    return {
        "complement_nb": lambda: C.NaiveBayes(modelType="complement", **at),
        "logistic": lambda: C.LogisticRegression(maxIter=30, regParam=0.01, **at),
        "linear_svm": lambda: C.OneVsRest(classifier=C.LinearSVC(maxIter=15), **at),
        "forest": lambda: C.RandomForestClassifier(numTrees=20, maxDepth=6, seed=7, **at),
        "boosted": lambda: C.OneVsRest(classifier=C.GBTClassifier(maxIter=5, maxDepth=3, seed=7), **at),
    }


def nearest_neighbours(df: DataFrame, ident: str, array: str, label: str, k: int, queries: DataFrame, block: int = 64) -> DataFrame:
    """``q, ident, label, sim``: the ``k`` most similar rows of each query by cosine, exact.

    The queries (``q``, ``v``) are a stated set: they are sent in blocks, each task
    keeps its ``k`` best for every query, and the tasks' lists are merged.
    """
    kinds = dict(df.dtypes)
    blocks = max(1, -(-queries.count() // (block * 64)))
    out = None
    for at in range(blocks):
        # one block of queries is on the driver at a time
        part = queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == at).select("q", "v").collect()
        if not part:
            continue
        names = np.array([r["q"] for r in part])
        m = np.array([r["v"] for r in part], float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

        def best(batches: Iterator[pd.DataFrame], m=m, names=names) -> Iterator[pd.DataFrame]:
            kept = None
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["v"].to_numpy()).astype(float)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                for i in range(0, len(m), block):
                    s = x @ m[i : i + block].T
                    top = np.argsort(-s, axis=0, kind="stable")[:k]
                    col = np.broadcast_to(np.arange(s.shape[1]), top.shape)
                    f = pd.DataFrame({"q": names[i + col.ravel()], "ident": b["ident"].to_numpy()[top.ravel()], "label": b["label"].to_numpy()[top.ravel()], "sim": s[top.ravel(), col.ravel()]})
                    kept = f if kept is None else pd.concat([kept, f])
                kept = kept.sort_values(["q", "sim", "ident"], ascending=[True, False, True]).groupby("q").head(k)
            if kept is not None:
                yield kept

        src = df.select(F.col(ident).alias("ident"), F.col(array).alias("v"), F.col(label).alias("label"))
        got = src.mapInPandas(best, f"q {queries.schema['q'].dataType.simpleString()}, ident {kinds[ident]}, label {kinds[label]}, sim double")
        out = got if out is None else out.union(got)
    if out is None:
        return df.sparkSession.createDataFrame([], f"q {queries.schema['q'].dataType.simpleString()}, ident {kinds[ident]}, label {kinds[label]}, sim double")
    w = Window.partitionBy("q").orderBy(F.col("sim").desc(), "ident")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def best_threshold(df: DataFrame, positive: str, score: str) -> DataFrame:
    """``threshold, f1``: the score from which on calling a row positive gives the largest F1, over the distinct scores."""
    s = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(positive).cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))
    r = prefix_sums(s, [], "threshold", ["p", "n"], descending=True).select("threshold", (2 * F.col("run_p") / (F.col("run_n") + F.col("all_p"))).alias("f1"))
    return r.agg(F.max(F.struct("f1", "threshold")).alias("b")).select("b.threshold", "b.f1")


# intervals, quantiles, scoring

def boosted_quantile(x: np.ndarray, y: np.ndarray, q: float, rounds: int = 60, depth: int = 2, rate: float = 0.1) -> list:
    """Gradient boosting of the pinball loss with shallow trees: ``[base, tree...]`` for :func:`quantile_predict`."""

    def tree(rows: np.ndarray, g: np.ndarray, r: np.ndarray, left: int):
        if left == 0 or len(rows) < 20:
            return float(np.quantile(r[rows], q)) if len(rows) else 0.0
        best = None
        for j in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[rows, j], (0.2, 0.4, 0.6, 0.8))):
                lo = x[rows, j] <= cut
                n = lo.sum()
                if 10 <= n <= len(rows) - 10:
                    gain = g[rows[lo]].sum() ** 2 / n + g[rows[~lo]].sum() ** 2 / (len(rows) - n)
                    if best is None or gain > best[0]:
                        best = (gain, j, float(cut), lo)
        if best is None:
            return float(np.quantile(r[rows], q))
        _, j, cut, lo = best
        return (j, cut, tree(rows[lo], g, r, left - 1), tree(rows[~lo], g, r, left - 1))

    base = float(np.quantile(y, q))
    at, trees = np.full(len(y), base), [base]
    for _ in range(rounds):
        r = y - at
        t = tree(np.arange(len(y)), np.where(r > 0, q, q - 1), r, depth)
        at = at + rate * _walk(t, x)
        trees.append(t)
    return [*trees, rate]


def _walk(t, x: np.ndarray) -> np.ndarray:
    if not isinstance(t, tuple):
        return np.full(len(x), t)
    lo = x[:, t[0]] <= t[1]
    return np.where(lo, _walk(t[2], x), _walk(t[3], x))


def quantile_predict(model: list, x: np.ndarray) -> np.ndarray:
    """The predictions of :func:`boosted_quantile`."""
    base, *trees, rate = model
    return base + rate * sum((_walk(t, x) for t in trees), np.zeros(len(x)))


def quantile_regression(train: DataFrame, df: DataFrame, inputs: Sequence[str], truth: str, targets: Mapping[str, float], fit_rows: int = FIT_ROWS, seed: int = 7) -> DataFrame:
    """``df`` with a column for each target quantile, in order (a lower one never above a higher one).

    Fitted on at most ``fit_rows`` rows of ``train``, chosen by hash; applied to all rows.
    """
    n = train.count()
    part = train if n <= fit_rows else train.filter(F.pmod(F.xxhash64(F.lit(seed), *inputs, truth), F.lit(1 << 20)) < int(fit_rows / n * (1 << 20)))
    pdf = part.select(*inputs, truth).dropna().toPandas()  # at most about fit_rows rows
    x, y = pdf[list(inputs)].to_numpy(float), pdf[truth].to_numpy(float)
    models = {k: boosted_quantile(x, y, p) for k, p in sorted(targets.items(), key=lambda t: t[1])}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = b[list(inputs)].fillna(0).to_numpy(float)
            low = np.sort(np.column_stack([quantile_predict(t, m) for t in models.values()]), axis=1)
            yield b.assign(**{k: low[:, i] for i, k in enumerate(models)})

    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + "".join(f", {k} double" for k in models)
    return df.mapInPandas(work, schema)


def conformal_quantiles(train: DataFrame, calibrate: DataFrame, df: DataFrame, inputs: Sequence[str], truth: str, alpha: float, seed: int = 7) -> DataFrame:
    """``df`` with ``lo, mid, hi``: quantile predictions, widened by what the calibration rows need.

    A calibration row's score is how far its value lies outside its own band, negative
    inside; the ``ceil((n + 1)(1 - alpha))``-th smallest score moves both ends.
    """
    targets = {"lo": alpha / 2, "mid": 0.5, "hi": 1 - alpha / 2}
    kinds = dict(df.dtypes)
    held = [c for c in df.columns if c not in inputs]
    tagged = df.select(*inputs, F.struct(*[F.col(c) for c in held] or [F.lit(0)]).alias("_k"), F.lit(None).cast("double").alias("_t"))
    own = calibrate.select(*inputs, F.lit(None).cast(tagged.schema["_k"].dataType).alias("_k"), F.col(truth).cast("double").alias("_t")).filter("_t is not null")
    both = cut_lineage(quantile_regression(train, tagged.union(own), inputs, truth, targets, seed=seed))
    score = both.filter("_t is not null").select(F.greatest(F.col("lo") - F.col("_t"), F.col("_t") - F.col("hi")).alias("s"))
    n = score.count()
    rank = min(n, math.ceil((n + 1) * (1 - alpha)))
    counts = score.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    shift = prefix_sums(counts, [], "s", ["c"]).filter(F.col("run_c") >= rank).agg(F.min("s")).first()[0] or 0.0  # one number
    out = both.filter("_k is not null").select(*inputs, *[F.col(f"_k.`{c}`").cast(kinds[c]).alias(c) for c in held], (F.col("lo") - shift).alias("lo"), "mid", (F.col("hi") + shift).alias("hi"))
    return out.select(*df.columns, "lo", "mid", "hi")


def random_search(df: DataFrame, fold: str, k: int, truth: str, space: Mapping[str, Sequence[object]], draws: int, make: Callable[..., Estimator], seed: int = 7) -> DataFrame:
    """``draw, params, mae, rmse, r2``: the out-of-fold scores of ``draws`` distinct settings drawn from ``space``; all settings where there are fewer."""
    import itertools
    import random

    names = sorted(space)
    every = list(itertools.product(*[space[n] for n in names]))
    chosen = random.Random(seed).sample(every, min(draws, len(every)))
    rows = cut_lineage(df)
    out = None
    for i, values in enumerate(chosen):
        p = dict(zip(names, values))
        sc = regression_scores(out_of_fold(rows, fold, k, lambda p=p: make(**p), [truth]), truth)
        sc = sc.select(F.lit(i).alias("draw"), F.lit(str(p)).alias("params"), "mae", "rmse", "r2")
        out = sc if out is None else out.unionByName(sc)
    return out


def topic_choice(train: DataFrame, held: DataFrame, vector: str, ks: Sequence[int], seed: int = 7, rounds: int = 10) -> tuple[DataFrame, dict]:
    """``k, perplexity`` on held-out documents, and the fitted model of each number of topics."""
    models = {k: topics(train, vector, k, seed, rounds) for k in ks}
    rows = [(k, float(math.exp(m.logPerplexity(held)))) for k, m in models.items()]
    return train.sparkSession.createDataFrame(rows, "k int, perplexity double"), models


def topic_shares(model, df: DataFrame, vector: str, label: str) -> DataFrame:
    """``label, topic, dominant, mean_share``: how many of a label's documents a topic leads, and its mean share in them. Documents without a known word have no topics and don't count."""
    from pyspark.ml.functions import vector_to_array

    t = model.transform(df).select(label, vector_to_array("topicDistribution").alias("v"))
    t = t.filter("exists(v, x -> x > 0)").withColumn("top", (F.array_position("v", F.array_max("v")) - 1).cast("int"))
    x = t.select(label, "top", F.posexplode("v").alias("topic", "share"))
    return x.groupBy(label, "topic").agg(F.count_if(F.col("top") == F.col("topic")).alias("dominant"), F.avg("share").alias("mean_share"))


def linear_attributions(model, df: DataFrame, vector: str, ident: str, background: DataFrame) -> DataFrame:
    """``ident, feature, phi``: exact Shapley values of a linear model for independent features, ``coef * (x - mean)``; they add up to the prediction less the mean one."""
    from pyspark.ml.functions import vector_to_array

    means = background.select(F.posexplode(vector_to_array(vector)).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    coef = df.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(model.coefficients.toArray())], "i int, c double")
    x = df.select(ident, F.posexplode(vector_to_array(vector)).alias("i", "x")).join(coef, "i").join(means, "i")
    return x.select(ident, F.col("i").alias("feature"), (F.col("c") * (F.col("x") - F.col("m"))).alias("phi"))


def linear_scores(tok: DataFrame, doc: str, term: str, weights: DataFrame, intercept: float) -> DataFrame:
    """``doc, score, probability``: a bag of words through tf-idf and logistic weights ``(term, idf, coef)``, as portable arithmetic."""
    tf = tok.groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf"))
    x = tf.join(weights, term).withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    unit = F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(doc)))
    z = x.withColumn("c", unit * F.col("coef")).groupBy(doc).agg(F.sum("c").alias("z"))
    s = F.col("z") + F.lit(float(intercept))
    return z.select(doc, s.alias("score"), (1 / (1 + F.exp(-s))).alias("probability"))


def contributions(tok: DataFrame, doc: str, term: str, weights: DataFrame, k: int) -> DataFrame:
    """``doc, term, part``: the ``k`` largest contributions of each document, by size."""
    tf = tok.groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf")).join(weights, term)
    x = tf.withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    part = x.select(doc, term, (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(doc))) * F.col("coef")).alias("part"))
    w = Window.partitionBy(doc).orderBy(F.abs("part").desc(), term)
    return part.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def recourse(
    df: DataFrame, ident: str, held: str, source: str, target: str, weights: Mapping[str, Mapping[str, float]], bias: Mapping[str, float], steps: int = 10,
    feasible: Mapping[str, Sequence[str]] | None = None, order: Mapping[tuple[str, str], Sequence[str]] | None = None,
) -> DataFrame:
    """``ident, step, added, probability, reached``: terms added until the target leads, at most ``steps``; step 0 is the start.

    Each step takes the term with the largest gain of the target over its strongest
    rival. ``feasible`` names the terms that may be added for a target (all, where it is
    None). With ``order`` terms are added in the given order of ``(source, target)``
    instead: the plain way to compare with. Rows of an unknown target come out of
    neither. Row-local: the weights are a model, not data.
    """
    labels, terms = sorted(weights), sorted({t for w in weights.values() for t in w})
    m = np.array([[weights[c].get(t, 0.0) for t in terms] for c in labels])
    b = np.array([bias[c] for c in labels])
    at = {t: i for i, t in enumerate(terms)}
    allowed = {c: np.array([feasible is None or t in set(feasible.get(c, ())) for t in terms]) for c in labels}

    def path(have, came, to) -> Iterator[tuple]:
        x = np.zeros(len(terms))
        x[[at[t] for t in have if t in at]] = 1
        j, added = labels.index(to), None
        queue = None if order is None else iter([at[t] for t in order.get((came, to), ()) if t in at and not x[at[t]] and allowed[to][at[t]]])
        for step in range(steps + 1):
            z = m @ x + b
            p = np.exp(z - z.max())
            rival = max((i for i in range(len(labels)) if i != j), key=lambda i: z[i])
            reached = bool(z[j] > z[rival])
            yield step, added, float(p[j] / p.sum()), reached
            if reached:
                return
            if queue is None:
                gain = np.where((x == 0) & allowed[to], m[j] - m[rival], -math.inf)
                best = int(gain.argmax()) if len(gain) and gain.max() > 0 else None
            else:
                best = next(queue, None)
            if best is None:
                return
            x[best], added = 1, terms[best]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, *step) for key, have, came, to in zip(batch["k"], batch["h"], batch["s"], batch["t"]) if to in weights
                for step in path(have if have is not None else (), came, to)
            ]
            yield pd.DataFrame(rows, columns=["k", "step", "added", "probability", "reached"])

    src = df.select(F.col(ident).alias("k"), F.col(held).alias("h"), F.col(source).alias("s"), F.col(target).alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInPandas(work, f"k {kind}, step int, added string, probability double, reached boolean").withColumnRenamed("k", ident)


def recourse_summary(paths: DataFrame, ident: str) -> DataFrame:
    """``n, flip_5, flip_10, median_added``: shares of rows whose target leads within 5 and 10 added terms, and the median number among those that get there."""
    last = paths.groupBy(ident).agg(F.max("step").alias("steps"), F.bool_or("reached").alias("ok"))
    within = lambda k: F.avg((F.col("ok") & (F.col("steps") <= k)).cast("double"))
    return last.agg(F.count(F.lit(1)).alias("n"), within(5).alias("flip_5"), within(10).alias("flip_10"), F.percentile(F.when(F.col("ok"), F.col("steps")), 0.5).alias("median_added"))


def permutation_importance(model, df: DataFrame, columns: Sequence[str], ident: str, truth: str, seed: int = 7, repeats: int = 10) -> DataFrame:
    """``column, gain, spread``: how much the squared error of a fitted pipeline grows when a column is shuffled, over ``repeats`` shuffles.

    Rows are ranked once by a hash; a shuffle gives each row the value that lies a drawn
    number of places further on, all columns of a repeat in one join.
    """
    from plumbline.operators.windows import ranks

    placed = cut_lineage(ranks(df, [], [F.xxhash64(F.lit(seed), F.col(ident)), F.col(ident)], "_p"))
    given = placed.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_x_{c}") for c in columns])
    shifted = placed.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    step = 1 + F.pmod(F.xxhash64(F.lit(seed), F.col("_rep")), F.greatest(F.lit(1), F.col("all__p") - 1))
    mixed = cut_lineage(shifted.withColumn("_q", F.pmod(F.col("_p") - 1 + step, F.col("all__p")) + 1).join(given, "_q"))
    error = F.avg(F.pow(F.col(truth) - F.col("prediction"), 2)).alias("e")
    parts = model.transform(placed).agg(error).select(F.lit("").alias("column"), F.lit(0).alias("_rep"), "e")
    for c in columns:
        one = model.transform(mixed.withColumn(c, F.col(f"_x_{c}"))).groupBy("_rep").agg(error)
        parts = parts.union(one.select(F.lit(c), "_rep", "e"))
    base = parts.filter("_rep = 0").select(F.col("e").alias("_b"))
    return parts.filter("_rep > 0").crossJoin(F.broadcast(base)).groupBy("column").agg(  # one row
        F.avg(F.col("e") - F.col("_b")).alias("gain"), F.stddev_samp(F.col("e") - F.col("_b")).alias("spread")
    )


def dense(df: DataFrame, array: str, out: str) -> DataFrame:
    """``df`` with an array column as an ``ml`` vector."""
    return df.withColumn(out, array_to_vector(F.transform(array, lambda x: x.cast("double"))))


