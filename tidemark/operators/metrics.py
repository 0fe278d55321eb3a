"""Evaluation: confusion tables and what follows from them, rates, regression errors, ROC, top-k.

Everything starts from one aggregation of predictions by key; only class-by-class tables are worked on after that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import half_up
from tidemark.operators.ranking import prefix_sums

EPS = 1e-9


def confusion(df: DataFrame, target: str = "target", pred: str = "pred") -> DataFrame:
    """n of each (target, pred)."""
    return df.groupBy(F.col(target).alias("target"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_scores(cm: DataFrame, beta: float = 1.0) -> DataFrame:
    """precision, recall, F-beta and support of each class."""
    ends = F.array(
        F.struct(F.col("target").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")),
    )
    sums = cm.select(F.explode(ends).alias("x")).select("x.*").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("t", "p", "tp")])
    precision, recall = F.col("tp") / (F.col("p") + EPS), F.col("tp") / (F.col("t") + EPS)
    b2 = beta * beta
    rates = sums.select("class", F.col("t").alias("support"), "p", "tp", precision.alias("precision"), recall.alias("recall"))
    bottom = F.col("precision") * b2 + F.col("recall")
    f = F.when(bottom > 0, (1 + b2) * F.col("precision") * F.col("recall") / F.nullif(bottom, F.lit(0.0))).otherwise(0.0)
    return rates.withColumn("fbeta", f)


def averaged(cm: DataFrame, beta: float = 1.0) -> DataFrame:
    """Macro, micro and weighted averages of the class scores, one row each."""
    s = class_scores(cm, beta)
    total = F.sum("support")
    micro = F.sum("tp") / total
    row = s.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "fbeta")],
        *[micro.alias(f"micro_{c}") for c in ("precision", "recall", "fbeta")],
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(f"weighted_{c}") for c in ("precision", "recall", "fbeta")],
    )
    kinds = [
        F.struct(F.lit(k).alias("average"), *[half_up(F.col(f"{k}_{c}")).alias(c) for c in ("precision", "recall", "fbeta")])
        for k in ("macro", "micro", "weighted")
    ]
    return row.select(F.explode(F.array(*kinds)).alias("x")).select("x.*")


def kappa(cm: DataFrame, weights: str | None = None) -> DataFrame:
    """Cohen's kappa, plain or with linear or quadratic weights; classes are numbers.

    What chance would give follows from sums, moments or running sums of the two marginals, so classes are never paired.
    """
    apart = F.abs(F.col("target") - F.col("pred"))
    w = {None: (apart > 0).cast("double"), "linear": apart.cast("double"), "quadratic": (apart * apart).cast("double")}[weights]
    ends = F.array(
        F.struct(F.col("target").alias("k"), F.col("n").alias("r"), F.lit(0).cast("long").alias("c"), (w * F.col("n")).alias("o")),
        F.struct(F.col("pred").alias("k"), F.lit(0).cast("long").alias("r"), F.col("n").alias("c"), F.lit(0.0).alias("o")),
    )
    s = cm.select(F.explode(ends).alias("x")).select("x.*").groupBy("k").agg(*[F.sum(x).alias(x) for x in ("r", "c", "o")])
    run = Window.orderBy("k")  # one row a class
    s = s.withColumns({"rl": F.sum("r").over(run), "cl": F.sum("c").over(run), "gap": F.lead("k").over(run) - F.col("k")})
    total, k = F.sum("r"), F.col("k").cast("double")
    n = F.col("all")
    chance = {
        None: (F.sum(F.col("r") * F.col("c")).alias("e1"), n * n - F.col("e1")),
        "linear": (
            F.struct(
                F.sum(F.col("gap") * F.col("rl")).alias("r"), F.sum(F.col("gap") * F.col("cl")).alias("c"),
                F.sum(F.col("gap") * F.col("rl") * F.col("cl")).alias("b"),
            ).alias("e1"),
            n * F.col("e1.r") + n * F.col("e1.c") - F.col("e1.b") * 2,
        ),
        "quadratic": (
            F.struct(
                F.sum(k * k * F.col("r")).alias("r2"), F.sum(k * k * F.col("c")).alias("c2"),
                F.sum(k * F.col("r")).alias("r1"), F.sum(k * F.col("c")).alias("c1"),
            ).alias("e1"),
            n * F.col("e1.r2") + n * F.col("e1.c2") - F.col("e1.r1") * F.col("e1.c1") * 2,
        ),
    }[weights]
    one = s.agg(total.alias("all"), F.sum("o").alias("o"), chance[0])
    return one.select(half_up(1 - F.col("o") * n / chance[1]).alias("kappa"))


def matthews(cm: DataFrame) -> DataFrame:
    """Matthews correlation of any number of classes."""
    s = class_scores(cm).agg(
        F.sum("tp").alias("c"), F.sum("support").alias("s"), F.sum(F.col("p") * F.col("support")).alias("pt"),
        F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("support") * F.col("support")).alias("tt"),
    )
    top = F.col("c") * F.col("s") - F.col("pt")
    bottom = F.sqrt((F.col("s") * F.col("s") - F.col("pp")).cast("double")) * F.sqrt((F.col("s") * F.col("s") - F.col("tt")).cast("double"))
    return s.select(half_up(F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.nullif(bottom, F.lit(0.0)))).alias("mcc"))


def accuracies(df: DataFrame, score: str, threshold: float = 0.5, void: int | None = None) -> DataFrame:
    """accuracy, error_rate, accuracy of thresholded scores, and accuracy without a void class."""
    same = (F.col("pred") == F.col("target")).cast("double")
    over = ((F.col(score) > threshold).cast("long") == F.col("target")).cast("double")
    front = F.avg(F.when(F.col("target") != (void if void is not None else -1), same))
    return df.agg(
        half_up(F.avg(same)).alias("accuracy"), half_up(1 - F.avg(same)).alias("error_rate"),
        half_up(F.avg(over)).alias("accuracy_thresh"), half_up(front).alias("foreground_acc"),
    )


def overlap(df: DataFrame, key: str) -> DataFrame:
    """Dice and intersection over union of 0/1 predictions and targets of each key."""
    sums = df.groupBy(key).agg(
        F.sum(F.col("pred") * F.col("target")).alias("i"), F.sum(F.col("pred") + F.col("target")).alias("u")
    )
    dice = half_up(F.col("i") * 2.0 / (F.col("u") + EPS)).alias("dice")
    return sums.select(key, dice, half_up(F.col("i") / (F.col("u") - F.col("i") + EPS)).alias("iou"))


def regression(df: DataFrame, pred: Column, target: Column) -> DataFrame:
    """MSE, RMSE, MAE, MSLE, root mean square relative error, R2 and explained variance in one pass."""
    p, t = pred.cast("double"), target.cast("double")
    e = t - p
    log = F.log1p(p) - F.log1p(t)
    s = df.agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(log * log).alias("msle"),
        F.avg(F.pow(e / F.nullif(t, F.lit(0.0)), F.lit(2.0))).alias("pe"), F.var_pop(t).alias("vt"),
        F.var_samp(t).alias("st"), F.var_samp(e).alias("se"),
    )
    return s.select(
        half_up(F.col("mse")).alias("mse"), half_up(F.sqrt("mse")).alias("rmse"), half_up(F.col("mae")).alias("mae"),
        half_up(F.col("msle")).alias("msle"), half_up(F.sqrt("pe")).alias("rmspe"),
        half_up(1 - F.col("mse") / F.col("vt")).alias("r2"), half_up(1 - F.col("se") / F.col("st")).alias("explained"),
    )


def _by_score(df: DataFrame, score: str, target: str) -> DataFrame:
    """Positives and negatives of each score with their running sums from the highest score on."""
    by = df.groupBy(score).agg(F.sum(target).alias("p"), F.sum(1 - F.col(target)).alias("q"))
    totals = by.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q")).first()
    return prefix_sums(by, score, ["p", "q"], descending=True).withColumns(
        {"all_p": F.lit(totals.all_p).cast("double"), "all_q": F.lit(totals.all_q).cast("double")}  # their product passes 32 bits, and 64 bits later
    )


def roc_points(df: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """fp and tp rates at each distinct score, descending."""
    s = _by_score(df, score, target)
    return s.select(score, (F.col("run_q") / F.col("all_q")).alias("fpr"), (F.col("run_p") / F.col("all_p")).alias("tpr"))


def auc(df: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """Area under the curve by trapezoids: a score's negatives times the positives above it and half of its own."""
    s = _by_score(df, score, target)
    area = F.sum(F.col("q") * (F.col("run_p") - F.col("p") / 2)) / F.max(F.col("all_p") * F.col("all_q"))
    return s.agg(half_up(area).alias("auc"))


def top_losses(df: DataFrame, loss: str, key: str, k: int) -> DataFrame:
    """The k largest losses."""
    return df.orderBy(F.desc(loss), key).limit(k)


def most_confused(cm: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of different classes with at least so many rows."""
    return cm.where((F.col("target") != F.col("pred")) & (F.col("n") >= least))


def top_k_hit(scores: Column, target: Column, k: int) -> Column:
    """Whether the target is among the k best classes; ties go to the smaller class."""
    ranked = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    best = F.transform(F.slice(F.array_sort(ranked), 1, k), lambda x: x.i.cast("long"))
    return F.array_contains(best, target.cast("long"))


def perplexity(df: DataFrame, loss: str, length: str) -> DataFrame:
    """exp of the loss averaged by length."""
    mean = F.sum(F.col(loss) * F.col(length)) / F.sum(length)
    return df.agg(half_up(F.exp(mean)).alias("perplexity"), half_up(mean).alias("loss"))


def multilabel_fbeta(df: DataFrame, scores: Column, hot: Column, threshold: float = 0.2, beta: float = 2.0) -> DataFrame:
    """Mean over rows of F-beta of the labels whose sigmoid exceeds a threshold."""
    b2 = beta * beta
    guess = F.transform(scores, lambda s: (F.lit(1.0) / (F.exp(-s.cast("double")) + 1) > threshold).cast("double"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    tp = add(F.zip_with(guess, hot, lambda p, t: p * t))
    precision, recall = tp / (add(guess) + EPS), tp / (add(F.transform(hot, lambda t: t.cast("double"))) + EPS)
    f = precision * recall * (1 + b2) / (precision * b2 + recall + EPS)
    return df.agg(half_up(F.avg(f)).alias("fbeta"))


def paired(preds: DataFrame, targets: DataFrame, key: str, loss: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Predictions and targets of the same items, with their ``loss`` if one is given."""
    both = preds.join(targets, key)
    return both.withColumn("loss", loss(F.col("pred"), F.col("target"))) if loss else both


def weighted_mean(df: DataFrame, by: list[str], value: str, size: str) -> DataFrame:
    """Mean of values of batches by the batches' sizes; null for no rows."""
    total = F.sum(F.when(F.col(value).isNotNull(), F.col(size)))
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(size)) / F.nullif(total, F.lit(0))).alias("mean"), total.alias("rows"))


def class_overlap(df: DataFrame, image: str, target: str, pred: str, n: Column | None = None) -> DataFrame:
    """target, pred, share and images: the share of an image's pixels of a class that are predicted as each class, averaged
    over the images that have the class."""
    size = F.count("*") if n is None else F.sum(n)
    cells = df.groupBy(image, target, pred).agg(size.alias("_n"))
    whole = df.groupBy(image, target).agg(size.alias("_t"))
    images = whole.groupBy(target).agg(F.count("*").alias("images"))
    shares = cells.join(whole, [image, target]).groupBy(target, pred).agg(F.sum(F.col("_n") / F.col("_t")).alias("_s"))
    return shares.join(images, target).select(target, pred, (F.col("_s") / F.col("images")).alias("share"), "images")


def mean_iou(df: DataFrame, image: str, target: str, pred: str) -> DataFrame:
    """Class and iou: intersection over union of each class in an image, averaged over the images where it occurs."""
    sides = F.array(F.struct(F.col(target).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    one = df.select(image, (F.col(target) == F.col(pred)).alias("_same"), F.explode(sides).alias("x")).select(image, "_same", "x.*")
    per = one.groupBy(image, "c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum(F.when(F.col("_same"), F.col("t")).otherwise(0)).alias("both"))
    return per.groupBy(F.col("c").alias("class")).agg(F.avg(F.col("both") / (F.col("t") + F.col("p") - F.col("both"))).alias("iou"), F.count("*").alias("images"))


def total_variation(plane: DataFrame, x: str = "x", y: str = "y", v: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of absolute differences to the right and lower neighbours of each plane, and how many there are."""
    base = plane.select(*by, F.col(x).alias("x"), F.col(y).alias("y"), F.col(v).alias("v"))
    near = [base.select(*by, (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("v").alias("w")) for dx, dy in ((1, 0), (0, 1))]
    return base.join(near[0].unionByName(near[1]), [*by, "x", "y"]).groupBy(*by).agg(F.sum(F.abs(F.col("v") - F.col("w"))).alias("variation"), F.count("*").alias("n"))


def weighted_errors(df: DataFrame, by: list[str], a: str, b: str, w: str) -> DataFrame:
    """Weighted mean absolute and squared error, and the cosine distance of the two columns as vectors."""
    d = (F.col(a) - F.col(b)).cast("double")
    total = F.sum(w)
    dot = lambda x, y: F.sum((F.col(x) * F.col(y)).cast("double"))
    return df.groupBy(*by).agg(
        (F.sum(F.abs(d) * F.col(w)) / total).alias("l1"), (F.sum(d * d * F.col(w)) / total).alias("l2"),
        (1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))).alias("cosine_distance"),
    )
