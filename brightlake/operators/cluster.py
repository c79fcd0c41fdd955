"""Clustering on scaled features, cluster quality and profiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from brightlake.functions.columns import categorical_columns, col, num, numeric_columns, percent, stack_rows
from brightlake.operators.reduce import FEATURES, feature_matrix, scaled_columns
from brightlake.plans.fits import fit_centres, fit_mixtures, pack, quality
from brightlake.plans.running import quantiles
from brightlake.plans.spanning import Tree, spanning_tree, tree_parts
from brightlake.session import BROADCAST_ROWS, small_side, stored

LABEL = "cluster"
MAX_CENTRES = 2000


def _in_order(points: DataFrame, centres: Sequence[Sequence[float]]) -> tuple[DataFrame, list[list[float]]]:
    """Renumber clusters by their centres, so equal fits give equal labels."""
    order = sorted(range(len(centres)), key=lambda i: [round(float(v), 9) for v in centres[i]])
    rank = {old: new for new, old in enumerate(order)}
    lookup = F.array(*[F.lit(rank[i]) for i in range(len(centres))])
    renamed = points.withColumn(LABEL, F.element_at(lookup, F.col("prediction") + 1)).drop("prediction")
    return renamed, [[float(v) for v in centres[i]] for i in order]


def working_set(data: DataFrame) -> DataFrame:
    """Feature vectors kept for the passes of an iterative fit, spread over the cores if the scan
    gave fewer partitions than there are."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    if data.rdd.getNumPartitions() < cores:
        data = data.repartition(cores)
    return data.persist()


def silhouette(points: DataFrame, label: str = LABEL, features: str = FEATURES) -> float:
    """Silhouette on squared distances (what Spark computes in one pass over cluster sums)."""
    if points.select(label).distinct().limit(2).count() < 2:
        return 0.0
    return ClusteringEvaluator(featuresCol=features, predictionCol=label, metricName="silhouette").evaluate(points)


def _nearest(axes: Sequence[str], centres: np.ndarray) -> Column:
    """Number of the nearest centre, the first of equally near ones."""
    far = F.array(*[sum(((col(a) - F.lit(float(v))) * (col(a) - F.lit(float(v))) for a, v in zip(axes, c)), F.lit(0.0)) for c in centres])
    return (F.array_position(far, F.array_min(far)) - 1).cast("int")


def kmeans(df: DataFrame, k: int = 3, columns: Sequence[str] | None = None, scaler: str = "standard", seed: int = 42) -> DataFrame:
    """``df`` with a ``cluster`` column; clusters are numbered by their centres."""
    names = list(columns or numeric_columns(df))
    wide, axes = scaled_columns(df, names, scaler), [f"_f_{c}" for c in names]
    blocks = pack(wide, axes)
    try:
        centres = fit_centres(blocks, len(axes), [k], seed)[k]
    finally:
        blocks.unpersist()
    return _in_order(wide.withColumn("prediction", _nearest(axes, centres)), centres)[0].drop(*axes)


def kmeans_centres(df: DataFrame, k: int = 3, columns: Sequence[str] | None = None, scaler: str = "standard", seed: int = 42) -> DataFrame:
    """(cluster, size, one column per feature) in scaled units, with the overall silhouette."""
    names = list(columns or numeric_columns(df))
    axes = [f"_f_{c}" for c in names]
    blocks = pack(scaled_columns(df, names, scaler), axes)
    try:
        centres = fit_centres(blocks, len(axes), [k], seed)[k]
        found = quality(blocks, len(axes), [centres])[0]
    finally:
        blocks.unpersist()
    ranked = sorted(zip(centres.tolist(), found["sizes"]), key=lambda c: [round(v, 9) for v in c[0]])
    rows = [(i, int(n), *c, found["silhouette"]) for i, (c, n) in enumerate(ranked)]
    fields = ", ".join(f"`{c}` double" for c in names)
    return df.sparkSession.createDataFrame(rows, f"cluster int, size long, {fields}, silhouette_squared double")


def hierarchical(df: DataFrame, n: int = 3, columns: Sequence[str] | None = None, scaler: str = "standard", seed: int = 42) -> DataFrame:
    """Top-down splits (bisecting k-means) in place of a bottom-up linkage."""
    data = feature_matrix(df, columns, scaler)
    model = BisectingKMeans(k=n, seed=seed, featuresCol=FEATURES).fit(data)
    return _in_order(model.transform(data), model.clusterCenters())[0].drop(FEATURES)


def _linkage_tree(df: DataFrame, names: Sequence[str], scaler: str | None) -> tuple[DataFrame, list[str], Tree]:
    """Rows with the axes of their points (gaps filled and scaled, or as they are) and the tree of these."""
    axes = [f"_f_{c}" for c in names]
    wide = scaled_columns(df, names, scaler) if scaler else df.withColumns({a: num(c) for a, c in zip(axes, names)})
    return wide, axes, spanning_tree(wide, axes)


def single_linkage(df: DataFrame, n: int = 3, columns: Sequence[str] | None = None, scaler: str | None = "standard") -> DataFrame:
    """Bottom-up merging of the closest clusters until ``n`` are left, exact: ``df`` with a ``cluster`` column,
    numbered by the centres.

    The spanning tree of the scaled points, without its n - 1 longest edges. Fewer distinct points than ``n``
    give a cluster each; a row without coordinates has none.
    """
    if n < 1:
        raise ValueError("at least one cluster")
    names = list(columns or numeric_columns(df))
    wide, axes, tree = _linkage_tree(df, names, scaler)
    longest = tree.edges.orderBy(F.desc("distance"), F.desc("a"), F.desc("b")).limit(n - 1).select("a", "b")
    parts = tree_parts(tree.points.select("id"), tree.edges.join(longest, ["a", "b"], "left_anti"), tree.chain)
    placed = tree.points.join(parts, "id")
    centre = F.array(*[F.round(F.try_divide(F.sum(col(a) * F.col("n")), F.sum("n")), 9) for a in axes])
    order = Window.orderBy("_c", "root")  # one row per cluster
    numbers = placed.groupBy("root").agg(centre.alias("_c")).select("root", (F.row_number().over(order) - 1).alias(LABEL))
    labels = placed.join(F.broadcast(numbers) if n <= BROADCAST_ROWS else numbers, "root").select(*[col(a) for a in axes], LABEL)
    kept = [c for c in df.columns if c != LABEL]
    return wide.drop(LABEL).join(labels, axes, "left").select(*[col(c) for c in kept], LABEL)


def linkage_heights(df: DataFrame, columns: Sequence[str] | None = None, scaler: str | None = "standard", last: int = 30) -> DataFrame:
    """(clusters, distance): at which distance single linkage comes down to that many clusters, for its ``last``
    merges: the upper part of a dendrogram."""
    tree = _linkage_tree(df, list(columns or numeric_columns(df)), scaler)[2]
    top = tree.edges.select("distance").orderBy(F.desc("distance")).limit(last)
    return top.select(F.row_number().over(Window.orderBy(F.desc("distance"))).alias("clusters"), "distance")


def _gmm_fit(data: DataFrame, n: int, seed: int):
    return GaussianMixture(k=n, seed=seed, featuresCol=FEATURES, maxIter=100).fit(data)


def gmm(df: DataFrame, n: int = 3, columns: Sequence[str] | None = None, scaler: str = "standard", seed: int = 42) -> DataFrame:
    """``df`` with ``cluster`` and ``probabilities`` (in cluster order), full covariances."""
    data = feature_matrix(df, columns, scaler)
    model = _gmm_fit(data, n, seed)
    means = [g.mean.toArray() for g in model.gaussians]
    order = sorted(range(n), key=lambda i: [round(float(v), 9) for v in means[i]])
    points = model.transform(data).withColumn("_p", vector_to_array("probability"))
    named, _ = _in_order(points, means)
    return named.withColumn("probabilities", F.array(*[F.element_at("_p", i + 1) for i in order])).drop("_p", "probability", FEATURES)


def _information(log_likelihood: float, k: int, d: int, rows: int) -> tuple[float, float]:
    """(BIC, AIC) of a full-covariance mixture."""
    free = k * d + k * d * (d + 1) / 2 + k - 1
    return float(free * math.log(rows) - 2 * log_likelihood), float(2 * free - 2 * log_likelihood)


def optimal_gmm(df: DataFrame, max_components: int = 10, columns: Sequence[str] | None = None, scaler: str = "standard", seed: int = 42) -> DataFrame:
    """(n_components, bic, aic, silhouette_squared, is_optimal): the smallest BIC wins. All mixtures are fitted in the same passes."""
    names = list(columns or numeric_columns(df))
    wide, axes = scaled_columns(df, names, scaler), [f"_f_{c}" for c in names]
    blocks = pack(wide, axes)
    try:
        total = df.count()
        rows = [(1, *_single_gaussian(wide, axes, total), 0.0)]
        if max_components > 1:
            fits = fit_mixtures(blocks, len(axes), range(2, max_components + 1), seed)
            scores = quality(blocks, len(axes), [model for model, _ in fits.values()])
            rows += [(k, *_information(logs, k, len(axes), total), q["silhouette"]) for (k, (_, logs)), q in zip(fits.items(), scores)]
    finally:
        blocks.unpersist()
    best = min(rows, key=lambda r: r[1])[0]
    return df.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in rows],
        "n_components int, bic double, aic double, silhouette_squared double, is_optimal boolean",
    )


def _single_gaussian(wide: DataFrame, axes: Sequence[str], rows: int) -> tuple[float, float]:
    """One component in closed form: its covariance decides the likelihood."""
    d = len(axes)
    sums = wide.agg(F.array(*[F.covar_pop(col(a), col(b)) for a in axes for b in axes]).alias("c")).first()
    cov = np.array(sums["c"]).reshape(d, d) + 1e-9 * np.eye(d)
    log_likelihood = -0.5 * rows * (d * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + d)
    return _information(log_likelihood, 1, d, rows)


# ---- quality -----------------------------------------------------------------------------------

def _separation(n: np.ndarray, c: np.ndarray, within: float, s: np.ndarray) -> tuple[float | None, float | None]:
    """(Calinski-Harabasz, Davies-Bouldin) from sizes, centres, squares within and mean distances; null for one cluster, or one a row."""
    k, total = len(n), n.sum()
    if not 1 < k < total:
        return None, None
    overall = (n[:, None] * c).sum(axis=0) / total
    between = (n * ((c - overall) ** 2).sum(axis=1)).sum()
    gap = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(gap, np.inf)
    ch = float(between / (k - 1) / (within / (total - k))) if within else None
    return ch, float(np.mean(((s[:, None] + s[None, :]) / gap).max(axis=1)))


def centroid_metrics(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from cluster sums, number of clusters, noise (label -1).

    Two aggregates by cluster: the centres, then distances to the own centre. What reaches the driver
    is one row per cluster.
    """
    rows = df.select(col(label).alias(LABEL), *[num(c).alias(f"_x{i}") for i, c in enumerate(columns)])
    d = range(len(columns))
    centres = small_side(
        rows.groupBy(LABEL).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(f"_x{i}").alias(f"_c{i}") for i in d])
    )
    square = sum(((F.col(f"_x{i}") - F.col(f"_c{i}")) * (F.col(f"_x{i}") - F.col(f"_c{i}")) for i in d), F.lit(0.0))
    spread = rows.join(centres.drop("_n"), LABEL).groupBy(LABEL).agg(
        F.sum(square).alias("_w"), F.avg(F.sqrt(square)).alias("_s")
    )
    table = centres.join(spread, LABEL).limit(MAX_CENTRES + 1).collect()
    if len(table) > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} clusters")
    n = np.array([r["_n"] for r in table], dtype=float)
    c = np.array([[r[f"_c{i}"] for i in d] for r in table])
    within, s = sum(r["_w"] for r in table), np.array([r["_s"] for r in table])
    k, total = len(table), n.sum()
    ch, db = _separation(n, c, within, s)
    noise = int(sum(r["_n"] for r in table if r[LABEL] == -1))
    return df.sparkSession.createDataFrame(
        [(ch, db, k, noise, float(100.0 * noise / total) if total else 0.0)],
        "calinski_harabasz double, davies_bouldin double, n_clusters int, n_noise long, noise_percentage double",
    )


def cluster_sizes(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy(col(label)).agg(F.count(F.lit(1)).alias("size"))


def cluster_metrics(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """``centroid_metrics`` with the silhouette on squared distances."""
    points = df.select(
        col(label).cast("int").alias(LABEL), array_to_vector(F.array(*[num(c) for c in columns])).alias(FEATURES)
    )
    return centroid_metrics(df, label, columns).withColumn("silhouette_squared", F.lit(silhouette(points)))


def _elbow(ks: Sequence[int], inertia: Sequence[float]) -> int:
    """k farthest below the chord between the ends of the inertia curve."""
    x = np.array(ks, dtype=float)
    y = np.array(inertia, dtype=float)
    if len(x) < 3 or y[0] == y[-1]:
        return int(ks[0])
    drop = (y[0] - y) / (y[0] - y[-1]) - (x - x[0]) / (x[-1] - x[0])
    return int(ks[int(drop.argmax())])


def optimal_k(
    df: DataFrame, max_k: int = 10, method: str = "silhouette", columns: Sequence[str] | None = None,
    scaler: str = "standard", seed: int = 42, min_k: int = 2,
) -> DataFrame:
    """(n_clusters, silhouette_squared, inertia, calinski_harabasz, davies_bouldin, is_optimal) for
    every k, chosen by silhouette, elbow, calinski_harabasz or davies_bouldin. All k are fitted in the same passes."""
    names = list(columns or numeric_columns(df))
    axes = [f"_f_{c}" for c in names]
    blocks = pack(scaled_columns(df, names, scaler), axes)
    try:
        fits = fit_centres(blocks, len(axes), range(min_k, max_k + 1), seed)
        scores = quality(blocks, len(axes), list(fits.values()))
    finally:
        blocks.unpersist()
    rows = [
        (k, q["silhouette"], q["inertia"], *_separation(q["n"], q["centre"], q["within"].sum(), q["spread"])) for k, q in zip(fits, scores)
    ]
    pick = {
        "silhouette": lambda: max(rows, key=lambda r: r[1])[0],
        "elbow": lambda: _elbow([r[0] for r in rows], [r[2] for r in rows]),
        "calinski_harabasz": lambda: max(rows, key=lambda r: r[3] or 0.0)[0],
        "davies_bouldin": lambda: min(rows, key=lambda r: math.inf if r[4] is None else r[4])[0],
    }
    if method not in pick:
        raise ValueError(f"unknown method: {method}")
    best = pick[method]()
    return df.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in rows],
        "n_clusters int, silhouette_squared double, inertia double, calinski_harabasz double, davies_bouldin double, is_optimal boolean",
    )


def compare_clusterers(
    df: DataFrame, n: int = 3, columns: Sequence[str] | None = None, scaler: str = "standard",
    algorithms: Sequence[str] = ("kmeans", "hierarchical", "gmm"), seed: int = 42,
    eps: float = 0.5, min_samples: int = 5,
) -> DataFrame:
    """One row of quality figures per algorithm, measured on the scaled features."""
    names = list(columns or numeric_columns(df))
    axes, d = [f"_f_{c}" for c in names], len(names)
    scaled = scaled_columns(df, names, scaler).select(*axes)
    blocks, data = pack(scaled, axes), None
    out = None
    try:
        for name in algorithms:
            if name in ("kmeans", "gmm"):
                model = fit_centres(blocks, d, [n], seed)[n] if name == "kmeans" else fit_mixtures(blocks, d, [n], seed)[n][0]
                q = quality(blocks, d, [model])[0]
                row = (name, *_separation(q["n"], q["centre"], q["within"].sum(), q["spread"]), len(q["n"]), 0, 0.0, q["silhouette"])
                part = df.sparkSession.createDataFrame(
                    [row],
                    "algorithm string, calinski_harabasz double, davies_bouldin double, n_clusters int, n_noise long, noise_percentage double, silhouette_squared double",
                )
                out = part if out is None else out.unionByName(part)
                continue
            if name == "hierarchical":
                if data is None:
                    data = working_set(scaled.select(array_to_vector(F.array(*[F.col(a) for a in axes])).alias(FEATURES)))
                model = BisectingKMeans(k=n, seed=seed, featuresCol=FEATURES).fit(data)
                points = working_set(model.transform(data).withColumnRenamed("prediction", LABEL))
            elif name == "dbscan":
                from brightlake.operators.density import dbscan_points

                labelled = dbscan_points(scaled, axes, eps, min_samples)
                points = labelled.select(LABEL, array_to_vector(F.array(*[F.col(a) for a in axes])).alias(FEATURES))
            else:
                raise ValueError(f"unknown algorithm: {name}")
            spread = points.withColumn("_x", vector_to_array(FEATURES))
            wide = spread.select(LABEL, *[F.element_at("_x", i + 1).alias(f"_f{i}") for i in range(d)])
            part = centroid_metrics(wide, LABEL, [f"_f{i}" for i in range(d)]).select(
                F.lit(name).alias("algorithm"), "*", F.lit(silhouette(points)).alias("silhouette_squared")
            )
            out = part if out is None else out.unionByName(part)
            points.unpersist()
    finally:
        blocks.unpersist()
        if data is not None:
            data.unpersist()
    return out


# ---- profiles ----------------------------------------------------------------------------------

def cluster_profile(df: DataFrame, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(cluster, column, size, mean, median, std, min, max, z_score) of every numeric column; the z
    score sets the cluster mean against the overall mean and deviation."""
    names = [c for c in (columns or numeric_columns(df)) if c != label]
    overall = df.agg(F.lit(1), *[F.struct(F.avg(num(c)).alias("m"), F.stddev(num(c)).alias("s")).alias(f"_o{i}") for i, c in enumerate(names)]).first()
    wide = df.groupBy(col(label).alias(LABEL)).agg(
        F.count(F.lit(1)).alias("size"),
        *[
            F.struct(F.avg(num(c)).alias("mean"), F.stddev(num(c)).alias("std"), F.min(num(c)).alias("min"), F.max(num(c)).alias("max")).alias(f"_s{i}")
            for i, c in enumerate(names)
        ],
    )
    tall = stack_rows(
        wide,
        [
            {"column": F.lit(c)}
            | {k: F.col(f"_s{i}.{k}") for k in ("mean", "std", "min", "max")}
            | {"z_score": F.try_divide(F.col(f"_s{i}.mean") - F.lit(overall[f"_o{i}"]["m"]), F.lit(overall[f"_o{i}"]["s"]).cast("double"))}
            for i, c in enumerate(names)
        ],
        keep=[LABEL, "size"],
    )
    marks = quantiles(df.withColumnRenamed(label, LABEL), names, [0.5], by=[LABEL]).withColumnRenamed("q0", "median")
    return tall.join(marks, [LABEL, "column"])


def cluster_categories(df: DataFrame, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(cluster, column, value, n, percentage): share of each category within its cluster."""
    names = [c for c in (columns or categorical_columns(df)) if c != label]
    tall = df.select(col(label).alias(LABEL), *[col(c).cast("string").alias(c) for c in names]).unpivot(
        [LABEL], [col(c) for c in names], "column", "value"
    )
    cells = tall.where("value IS NOT NULL").groupBy(LABEL, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy(LABEL, "column").agg(F.sum("n").alias("_t"))
    return cells.join(totals, [LABEL, "column"]).select(LABEL, "column", "value", "n", percent(F.col("n"), F.col("_t")).alias("percentage"))


# ---- customers ---------------------------------------------------------------------------------

CUSTOMER_FEATURES = ["total_spent", "avg_order", "purchase_count"]


def customer_profile(users: DataFrame, label: str = LABEL) -> DataFrame:
    """Means per cluster next to the overall ones (``all_`` names), with size and share."""
    overall = users.agg(F.lit(1), F.count(F.lit(1)).alias("_n"), *[F.avg(num(c)).alias(f"all_{c}") for c in CUSTOMER_FEATURES]).first()
    means = users.groupBy(col(label).alias(LABEL)).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(num(c)).alias(c) for c in CUSTOMER_FEATURES]
    )
    return means.withColumns(
        {f"all_{c}": F.lit(overall[f"all_{c}"]).cast("double") for c in CUSTOMER_FEATURES}
        | {"percentage": percent(F.col("size"), F.lit(overall["_n"]))}
    )


def customer_clusters(df: DataFrame, user: str = "user_id", price: str = "total_price", seed: int = 42) -> DataFrame:
    """Cluster users by spend, order value and count, k from 2 to 5 by silhouette, named by rule.

    No row with fewer than ten users.
    """
    from brightlake.operators.insights import cluster_names

    users = df.where(col(user).isNotNull()).groupBy(col(user)).agg(
        F.sum(num(price)).alias("total_spent"), F.avg(num(price)).alias("avg_order"), F.count(num(price)).alias("purchase_count")
    ).dropna()
    users = stored(users, "users")  # scaling, two fits and the profiles read it again
    n = users.count()
    if n < 10:
        return cluster_names(customer_profile(users.withColumn(LABEL, F.lit(0)))).where(F.lit(False))
    table = optimal_k(users, max(2, min(5, n // 5 - 1)), "silhouette", CUSTOMER_FEATURES, seed=seed)
    k = table.where("is_optimal").first()["n_clusters"]
    return cluster_names(customer_profile(kmeans(users, k, CUSTOMER_FEATURES, seed=seed)))
