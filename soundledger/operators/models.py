"""Trained scores: balanced logistic regression, restarted k-means, hold-one-session-out evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundledger.operators.chunks import number_names, running, with_chunks
from soundledger.session import shared_dir

# Feature names of the two models and the sub-type names by rising pitch.
CLASSIFIER_FEATURES = [
    "hnr_db", "flatness_mean", "f0_voiced_frac", "b_250_500", "b_1k_2k", "centroid_mean_hz", "rolloff85_mean_hz", "active_frac", "onsets", "zcr",
]
CLUSTER_FEATURES = [
    "f0_voiced_frac", "f0_mean_hz", "f0_std_hz", "f0_p50_hz", "f0_p95_hz", "hnr_db", "b_500_1k", "b_1k_2k", "b_2k_4k", "centroid_mean_hz", "active_frac",
]
SUBTYPES = ["fuss", "full_cry", "distress", "screech"]


def feature_array(columns: Sequence[str]) -> Column:
    """Features as one array; null when any of them is missing."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(complete, F.array(*[F.col(c).cast("double") for c in columns]))


@dataclass(frozen=True)
class Scaling:
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def apply(self, features: Column) -> Column:
        mean, std = (F.array(*[F.lit(float(v)) for v in vs]) for vs in (self.mean, self.std))
        return F.transform(features, lambda x, i: (x - F.get(mean, i)) / F.get(std, i))


def fit_scaling(df: DataFrame, features: str) -> tuple[Scaling, int]:
    """Mean and population deviation of each feature, and the row count; a constant feature keeps scale one."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    row = df.select(array_to_vector(F.col(features)).alias("v")).select(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")
    ).first()["s"]
    n = int(row["count"])
    var = np.asarray(row["variance"].toArray()) * (n - 1) / max(n, 1)
    std = np.sqrt(var)
    std[std < 1e-12] = 1.0
    return Scaling(tuple(row["mean"].toArray()), tuple(std)), n


@dataclass(frozen=True)
class LogisticScore:
    """A trained score that is applied as a plain column expression."""

    scaling: Scaling
    weights: tuple[float, ...]
    intercept: float
    rows: int

    def probability(self, features: Column) -> Column:
        """Probability of the positive class; null features give a null score."""
        slope = [w / s for w, s in zip(self.weights, self.scaling.std)]
        offset = self.intercept - sum(k * m for k, m in zip(slope, self.scaling.mean))
        if len(slope) <= 64:
            terms = [F.get(features, F.lit(i)) * F.lit(float(k)) for i, k in enumerate(slope)]
            logit = reduce(lambda a, b: a + b, terms, F.lit(float(offset)))
        else:
            k = F.array(*[F.lit(float(v)) for v in slope])
            logit = F.aggregate(F.zip_with(features, k, lambda a, b: a * b), F.lit(float(offset)), lambda acc, x: acc + x)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def fit_logistic(df: DataFrame, features: str, label: str, max_iter: int = 1000) -> LogisticScore:
    """Class-balanced logistic regression with unit penalty on standardised features.

    Balanced weights n/(2*n_class) sum to n, so a penalty of 1/n on the weighted
    mean loss is the unit penalty on the weighted total loss.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.filter(F.col(features).isNotNull() & F.col(label).isNotNull()).select(features, F.col(label).cast("double").alias("_y"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scaling, n = fit_scaling(rows, features)
        positives = int(rows.agg(F.coalesce(F.sum("_y"), F.lit(0))).first()[0])
        if not 0 < positives < n:
            raise ValueError("both classes are needed to fit a score")
        weight = F.when(F.col("_y") == 1, n / (2.0 * positives)).otherwise(n / (2.0 * (n - positives)))
        train = rows.select(array_to_vector(scaling.apply(F.col(features))).alias("x"), "_y", weight.alias("_w"))
        model = LogisticRegression(
            featuresCol="x", labelCol="_y", weightCol="_w", standardization=False, regParam=1.0 / n, elasticNetParam=0.0, maxIter=max_iter, tol=1e-7
        ).fit(train)
    finally:
        rows.unpersist()
    return LogisticScore(scaling, tuple(model.coefficients.toArray()), float(model.intercept), n)


@dataclass(frozen=True)
class Subtypes:
    """Cluster centres in feature units, in order of rising pitch, with their names."""

    scaling: Scaling
    centres: tuple[tuple[float, ...], ...]
    names: tuple[str, ...]
    cost: float

    def label(self, features: Column) -> Column:
        """Name of the nearest centre."""
        z = self.scaling.apply(features)
        std = self.scaling
        pairs = []
        for name, centre in zip(self.names, self.centres):
            zc = [(c - m) / s for c, m, s in zip(centre, std.mean, std.std)]
            dist = reduce(lambda a, b: a + b, [F.pow(F.get(z, F.lit(i)) - F.lit(float(v)), F.lit(2.0)) for i, v in enumerate(zc)])
            pairs.append(F.struct(dist.alias("d"), F.lit(name).alias("name")))
        return F.when(features.isNotNull(), F.array_min(F.array(*pairs))["name"])


def _spread_seeds(z: DataFrame, k: int, restarts: int, seed: int) -> np.ndarray:
    """Seeds of every restart, each next one drawn from all rows by its squared distance from the restart's others.

    Of all rows the one with the largest ``log(u) / weight`` is drawn, with ``u`` hashed from the row, so that a task
    returns one row a restart. Equal rows share their hash and count as one place.
    """
    schema = "r INT, best DOUBLE, z ARRAY<DOUBLE>"
    centres = np.zeros((restarts, 0, 0))
    for turn in range(k):

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top, rows = np.full(restarts, -np.inf), [None] * restarts
            for pdf in batches:
                x, h = np.stack(pdf["z"].to_numpy()), pdf["h"].to_numpy("i8").view("u8")
                for r in range(restarts):
                    mixed = (h ^ np.uint64((r * k + turn + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
                    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    u = ((mixed >> np.uint64(11)).astype("f8") + 0.5) / 2.0**53
                    weight = np.ones(len(x)) if turn == 0 else np.min([((x - c) ** 2).sum(axis=1) for c in centres[r]], axis=0)
                    score = np.log(u) / np.maximum(weight, 1e-300)
                    i = int(np.argmax(score))
                    if score[i] > top[r]:
                        top[r], rows[r] = score[i], x[i].tolist()
            have = [r for r in range(restarts) if rows[r] is not None]
            # A task without rows returns none: an empty column of lists has no type.
            if have:
                yield pd.DataFrame({"r": have, "best": top[have], "z": [rows[r] for r in have]})

        hashed = z.select("z", F.xxhash64(F.lit(seed), "z").alias("h"))
        found = hashed.mapInPandas(draw, schema).groupBy("r").agg(F.max_by("z", "best").alias("z")).collect()
        next_one = np.array([r["z"] for r in sorted(found, key=lambda r: r["r"])])[:, None, :]
        centres = next_one if turn == 0 else np.concatenate([centres, next_one], axis=1)
    return centres


def fit_subtypes(
    df: DataFrame, features: str, pitch_index: int, k: int = 4, restarts: int = 50, seed: int = 0, max_iter: int = 300, tol: float = 1e-4
) -> Subtypes | None:
    """k-means with many restarts; None when there are fewer than 2k rows.

    Every restart is seeded over all rows, far rows likelier, one pass a centre
    for all restarts. Then all move together: a pass over the data assigns each
    row under every restart and returns one partial sum per (restart, cluster),
    so fifty restarts cost the passes of the slowest one.
    """
    rows = df.filter(F.col(features).isNotNull()).select(features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = rows.count()
        if n < 2 * k:
            return None
        scaling, _ = fit_scaling(rows, features)
        z = rows.select(scaling.apply(F.col(features)).alias("z"))
        centres = _spread_seeds(z, k, restarts, seed)
        dims = centres.shape[2]
        schema = T.StructType(
            [T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("cost", T.DoubleType()), T.StructField("s", T.ArrayType(T.DoubleType()))]
        )

        def partial(current: np.ndarray):
            flat = current.reshape(-1, dims)
            norms = (flat**2).sum(axis=1)

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                count, cost, total = np.zeros(len(flat)), np.zeros(len(flat)), np.zeros((len(flat), dims))
                for pdf in batches:
                    x = np.stack(pdf["z"].to_numpy())
                    for s in range(0, len(x), 2048):
                        part = x[s : s + 2048]
                        dist = ((part**2).sum(axis=1)[:, None] - 2 * part @ flat.T + norms).reshape(len(part), restarts, k)
                        cell = dist.argmin(axis=2) + k * np.arange(restarts)
                        np.add.at(cost, cell.ravel(), dist.min(axis=2).ravel())
                        np.add.at(count, cell.ravel(), 1)
                        np.add.at(total, cell.ravel(), np.repeat(part, restarts, axis=0))
                yield pd.DataFrame({"cell": np.arange(len(flat)), "n": count.astype(int), "cost": cost, "s": list(total)})

            return run

        cost = np.full(restarts, np.inf)
        for _ in range(max_iter):
            sums = z.mapInPandas(partial(centres), schema).groupBy("cell").agg(
                F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.get("s", F.lit(d))) for d in range(dims)]).alias("s")
            )
            got = sums.collect()  # restarts * k rows, whatever the data
            moved = centres.reshape(-1, dims).copy()
            cost = np.zeros(restarts)
            for r in got:
                cost[r["cell"] // k] += r["cost"]
                if r["n"]:
                    moved[r["cell"]] = np.array(r["s"]) / r["n"]
            moved = moved.reshape(centres.shape)
            # Features have unit variance, so this is a relative tolerance.
            shift = ((moved - centres) ** 2).sum(axis=(1, 2)).max()
            centres = moved
            if shift < tol:
                break
        best = centres[int(np.argmin(cost))]
    finally:
        rows.unpersist()
    units = best * np.array(scaling.std) + np.array(scaling.mean)
    units = units[np.argsort(units[:, pitch_index], kind="stable")]
    names = SUBTYPES if k == len(SUBTYPES) else [f"cluster_{i}" for i in range(k)]
    return Subtypes(scaling, tuple(map(tuple, units)), tuple(names), float(cost.min()))


#: Rows and models of one block of the matrix of all rows under all models.
ROW_BLOCK, MODEL_BLOCK = 4096, 256


def _row_blocks(rows: DataFrame, features: str, label: str, session: str, shift: np.ndarray, scale: np.ndarray) -> DataFrame:
    """``(x, y, names, codes)``: matrices of scaled features with their labels, and sessions as numbers into names."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), ROW_BLOCK):
                part = pdf.iloc[i : i + ROW_BLOCK]
                x = (np.stack(part["x"].to_numpy()).astype("f8") - shift) / scale
                codes, names = pd.factorize(part["s"])
                yield pd.DataFrame({"x": [x.tobytes()], "y": [part["y"].to_numpy("f8").tobytes()], "names": [list(names)], "codes": [codes.astype("i8").tobytes()]})

    picked = rows.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"), F.col(session).cast("string").alias("s"))
    return picked.mapInPandas(work, "x binary, y binary, names array<string>, codes binary")


def _newton_sums(pairs: DataFrame, dim: int) -> DataFrame:
    """``(block, model, sums)``: gradient and Gram sums of each model over all rows but its own session's, a row a task and block."""
    width = 1 + dim + 1 + dim + dim * dim

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[bytes, list[str], np.ndarray]] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(b, m, names, s.tobytes()) for b, (m, names, s) in held.items()], columns=["block", "model", "sessions", "sums"])
            held.clear()
            return out

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                model = np.frombuffer(r.model, "f8").reshape(len(r.sessions), -1)
                x = np.frombuffer(r.x, "f8").reshape(-1, dim)
                y = np.frombuffer(r.y, "f8")[:, None]
                place = {name: i for i, name in enumerate(r.names)}
                mine = np.array([place.get(name, -1) for name in r.sessions])
                offset, slope, plus, minus = model[:, 0], model[:, 1 : 1 + dim], model[:, 1 + dim], model[:, 2 + dim]
                p = 1 / (1 + np.exp(-(x @ slope.T + offset)))
                weight = np.where(y == 1, plus, minus) * (np.frombuffer(r.codes, "i8")[:, None] != mine)
                off, gram = weight * (p - y), weight * p * (1 - p)
                outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                sums = np.concatenate([off.sum(axis=0)[:, None], off.T @ x, gram.sum(axis=0)[:, None], gram.T @ x, gram.T @ outer], axis=1)
                if r.block in held:
                    sums = sums + held[r.block][2]
                held[r.block] = (r.model, list(r.sessions), sums)
                if len(held) * MODEL_BLOCK * width > 1 << 24:
                    yield flush()
        if held:
            yield flush()

    return pairs.mapInPandas(work, "block bigint, model binary, sessions array<string>, sums binary")


def _newton_step(sums: DataFrame, dim: int) -> DataFrame:
    """``(block, sessions, model, step)``: each model moved by one Newton step; ``step`` is the largest move of the block."""

    def moved(model: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, float]:
        out, far = model.copy(), 0.0
        for k in range(len(model)):
            mean, std = model[k, 3 + dim : 3 + 2 * dim], model[k, 3 + 2 * dim :]
            g0, g1 = total[k, 0], total[k, 1 : 1 + dim]
            h0, h1, h2 = total[k, 1 + dim], total[k, 2 + dim : 2 + 2 * dim], total[k, 2 + 2 * dim :].reshape(dim, dim)
            # Sums over the rows' features, turned to the model's own scaling; the penalty is there.
            weights = model[k, 1 : 1 + dim] * std
            grad = np.r_[g0, (g1 - g0 * mean) / std + weights]
            cross = (h1 - h0 * mean) / std
            inner = (h2 - np.outer(mean, h1) - np.outer(h1, mean) + h0 * np.outer(mean, mean)) / np.outer(std, std) + np.eye(dim)
            step = np.linalg.solve(np.block([[np.array([[h0]]), cross[None, :]], [cross[:, None], inner]]), grad)
            level = model[k, 0] + (weights / std) @ mean
            weights = weights - step[1:]
            out[k, 1 : 1 + dim] = weights / std
            out[k, 0] = level - step[0] - (weights / std) @ mean
            far = max(far, float(np.abs(step).max()))
        return out, far

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, model, names, total = None, None, None, None

        def done() -> pd.DataFrame:
            new, step = moved(np.frombuffer(model, "f8").reshape(len(names), -1), total)
            return pd.DataFrame({"block": [block], "sessions": [names], "model": [new.tobytes()], "step": [step]})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                sums = np.frombuffer(r.sums, "f8").reshape(len(r.sessions), -1)
                if r.block == block:
                    total = total + sums
                    continue
                if block is not None:
                    yield done()
                block, model, names, total = r.block, r.model, list(r.sessions), sums
        if block is not None:
            yield done()

    placed = sums.repartition("block").sortWithinPartitions("block")
    return placed.mapInPandas(work, "block bigint, sessions array<string>, model binary, step double")


def fit_held_out(df: DataFrame, session: str, features: str, label: str, max_iter: int = 50, tol: float = 1e-9) -> DataFrame:
    """``(session, slope, offset)``: for each session the score fitted to all other sessions, with their own scaling and balance.

    All models move together by Newton steps. A step multiplies blocks of rows with blocks of models; a model's gradient and
    Gram sums leave its own session out, and tasks sum before the shuffle. The number of passes does not depend on the
    number of sessions, models stay in tables, and only the size of the last step comes back.
    """
    spark = df.sparkSession
    shared_dir(spark)
    rows = df.filter(F.col(features).isNotNull() & F.col(label).isNotNull() & F.col(session).isNotNull())
    overall, _ = fit_scaling(rows, features)
    shift, scale = np.array(overall.mean), np.array(overall.std)
    dim = len(shift)
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    z = F.transform(features, lambda x, i: (x - F.get(lit(shift), i)) / F.get(lit(scale), i))
    y = F.col(label).cast("double")
    at = rows.select(F.col(session).cast("string").alias("s"), y.alias("y"), z.alias("z"))
    sums = lambda over: [F.count("*").alias(f"n{over}"), F.sum("y").alias(f"y{over}"), *[F.sum(F.col("z")[i]).alias(f"a{i}{over}") for i in range(dim)], *[F.sum(F.col("z")[i] * F.col("z")[i]).alias(f"b{i}{over}") for i in range(dim)]]
    own = at.groupBy("s").agg(*sums("")).checkpoint()
    total = own.agg(*[F.sum(c).alias(f"{c}t") for c in own.columns if c != "s"])
    left = own.crossJoin(total)
    rest = lambda c: F.col(f"{c}t") - F.col(c)
    n, pos = rest("n"), rest("y")
    if not left.filter((pos <= 0) | (pos >= n)).isEmpty():
        raise ValueError("both classes are needed to fit a score")
    means = [rest(f"a{i}") / n for i in range(dim)]
    stds = [F.sqrt(F.greatest(rest(f"b{i}") / n - means[i] * means[i], F.lit(0.0))) for i in range(dim)]
    zero = F.lit(0.0)
    # A model: offset, slopes, weights of both classes, means and deviations.
    start = F.array(*[zero] * (1 + dim), n / (2.0 * pos), n / (2.0 * (n - pos)), *means, *[F.when(d < 1e-12, 1.0).otherwise(d) for d in stds])
    numbered = number_names(left.select("s", start.alias("m")), "s", "place")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "sessions": [pdf["s"].tolist()], "model": [np.stack(pdf["m"].to_numpy()).tobytes()]})

    grouped = numbered.select(F.expr(f"place div {MODEL_BLOCK}").alias("block"), "s", "m").groupBy("block").applyInPandas(pack, "block bigint, sessions array<string>, model binary")
    models = grouped.checkpoint()
    blocks = _row_blocks(rows, features, label, session, shift, scale).checkpoint()
    for _ in range(max_iter):
        pairs = blocks.crossJoin(models)
        moved = _newton_step(_newton_sums(pairs, dim), dim).checkpoint()
        far = moved.agg(F.max("step")).first()[0]
        models = moved.drop("step")
        if far is None or far < tol:
            break

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                model = np.frombuffer(r.model, "f8").reshape(len(r.sessions), -1)
                slope = model[:, 1 : 1 + dim] / scale
                yield pd.DataFrame({"s": list(r.sessions), "slope": slope.tolist(), "offset": model[:, 0] - slope @ shift})

    kind = df.schema[session].dataType
    return models.mapInPandas(unpack, "s string, slope array<double>, offset double").select(F.col("s").cast(kind).alias(session), "slope", "offset")


def hold_one_out(df: DataFrame, session: str, features: str, label: str) -> DataFrame:
    """Every row scored by a model that never saw its session."""
    rows = df.filter(F.col(features).isNotNull() & F.col(label).isNotNull())
    table = fit_held_out(rows, session, features, label).withColumnsRenamed({"slope": "_slope", "offset": "_offset"})
    logit = F.aggregate(F.zip_with(features, "_slope", lambda a, b: a * b), F.col("_offset"), lambda acc, x: acc + x)
    scored = rows.join(table, session)
    return scored.withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).drop("_slope", "_offset")


def evaluation(scored: DataFrame, session: str, label: str, prob: str = "prob") -> DataFrame:
    """Accuracy and area under the ROC curve per session and pooled (session null).

    The area counts, for each positive, the negatives scored lower, ties half.
    Rows are first counted per distinct score; the running count of negatives
    goes by score chunks, so that the pooled curve does not pass through one task.
    """
    y = F.col(label).cast("bigint")
    counts = [F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg")]
    session_type = scored.schema[session].dataType

    # Both curves read the rows several times; they are scored and counted once.
    shared_dir(scored.sparkSession)
    counted = scored.groupBy(session, F.col(prob).alias("_p")).agg(*counts).checkpoint()

    def curve(keys: list[str]) -> DataFrame:
        rows = counted.groupBy(*keys, "_p").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")).withColumn("_at", (F.col("_p") * float(1 << 50)).cast("bigint"))
        rows = with_chunks(rows, keys, "_at", base_us=1 << 44)
        rows = running(rows, keys, ["_p"], {"_below": ("sum", F.col("_neg"))}, exclusive=True)
        hit = F.when(F.col("_p") >= 0.5, F.col("_pos")).otherwise(F.col("_neg"))
        out = rows.groupBy(*keys).agg(
            F.sum(F.col("_pos") + F.col("_neg")).alias("n"), F.sum("_pos").alias("positives"),
            (F.sum(hit) / F.sum(F.col("_pos") + F.col("_neg"))).alias("accuracy"),
            F.try_divide(F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)), F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc"),
        )
        return out if keys else out.select(F.lit(None).cast(session_type).alias(session), "*")

    return curve([session]).unionByName(curve([]))
