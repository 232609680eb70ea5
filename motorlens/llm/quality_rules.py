"""Operator 9, quality rules: robust multivariate outliers. DataFrame functions only.

Each text gives counts (words, characters in words, symbols, repeated lines, words in repeated 3-word windows). A text fails
the base rules if it has under 50 words or over half of its words lie in repeated windows. The others' transformed counts
form a vector; for every language and source a minimum covariance determinant (MCD) estimate of centre and covariance is
found by concentration steps from two deterministic starts (the classical estimate; medians and quartile ranges). A start
takes steps until its determinant falls no further, and the smaller determinant of the two wins. Texts with a large squared
Mahalanobis distance are rejected.

The same is estimated for each language and for all texts. A group of n texts is judged by the moments of a mixture: its own
estimate with weight n / (n + shrink), its language's, which is mixed with that of all texts likewise, with the rest. Small
groups thus lean on what is known of their language, large ones on themselves, without a size at which the rule changes.

Every step is one pass over a small table of vectors (five numbers a text) with map-side combining, so a group with a third
of all rows is spread over all tasks. The h smallest distances of a group are found on a histogram of distances, whose size
does not depend on the rows; the estimate uses every row up to the bin in which the h-th falls.

NULL texts have no words and fail the base rules. NULL languages and sources are groups of their own. Every text that passes
the base rules is judged, if need be by an estimate of its own group alone (a single row lies at its own centre). Variances
have a floor, so constant statistics and repeated rows do not make the covariance singular. Ids play no part: rows with NULL
or repeated ids are judged like others. Only doc_id, text, lang, source are read, whatever other columns are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorlens.llm.shared import Scratch

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
DIM = 5
#: Share of a group's vectors that the estimate rests on, and the texts that an estimate one level up counts for.
SUPPORT, SHRINK = 0.75, 100
#: A start is done once the logarithm of the determinant's root falls by less than this; steps it takes at most.
TOLERANCE, STEPS = 1e-3, 30
#: Standard deviations below which no direction is taken to be narrower, in the order of VECTOR.
FLOORS = (0.25, 0.05, 0.04, 0.05, 0.10)
#: A text is rejected beyond this quantile of the chi-square distribution.
QUANTILE = 1 - 1e-12
#: Groups up to which the table of estimates is broadcast (under 300 bytes each).
BROADCAST_GROUPS = 20_000
_SPACES = " \t\n\x0b\f\r"


# ---------------------------------------------------------------- counts


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; clashing columns are replaced."""
    t, at = F.coalesce(F.col(text), F.lit("")), lambda a, i: F.get(a, i)
    words = F.filter(F.split(t, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    df = docs.withColumns({"_words": words, "_lines": lines})
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(t, _SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.concat_ws(" ", at(F.col("_words"), i), at(F.col("_words"), i + 1), at(F.col("_words"), i + 2)))),
    }).drop("_words", "_lines")
    placed = F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed)).drop("_windows")
    twice = F.filter("_placed", lambda x, k: (x["w"] == at(F.col("_placed"), k + 1)["w"]) | ((k > 0) & (x["w"] == at(F.col("_placed"), F.greatest(k - 1, F.lit(0)))["w"])))
    df = df.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_placed")
    # Windows overlap: each start adds the words that the one before has not covered.
    covered = F.aggregate("_starts", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).cast("long").alias("n")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics x0..x4 of a text that has words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


# ---------------------------------------------------------------- chi-square, on the driver


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        b += 2
        an = -i * (i - a)
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - math.exp(a * math.log(x) - x - math.lgamma(a)) * h


def chi2_quantile(p: float, dim: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(dim / 2, mid / 2) < p else (lo, mid)
    return lo


def consistency(share: float, dim: int) -> float:
    """Factor that makes the covariance of the inner share of a normal sample unbiased."""
    return share / gamma_p((dim + 2) / 2, chi2_quantile(share, dim) / 2)


# ---------------------------------------------------------------- estimates


def _x(j: int) -> Column:
    return F.col(f"x{j}")


def _moments(df: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Centre c0.. and covariance factor l00.. of each group of df. Sums are taken around the shift s0.. to stay exact."""
    d = [_x(j) - F.col(f"s{j}") for j in range(DIM)]
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("m"), *[F.first(f"s{j}").alias(f"s{j}") for j in range(DIM)],
        *[F.sum(d[j]).alias(f"a{j}") for j in range(DIM)],
        *[F.sum(d[i] * d[j]).alias(f"q{i}{j}") for i in range(DIM) for j in range(i + 1)],
    )
    cov = {(i, j): (F.col(f"q{i}{j}") / F.col("m") - F.col(f"a{i}") * F.col(f"a{j}") / F.col("m") / F.col("m")) * F.lit(factor) + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0)) for i in range(DIM) for j in range(i + 1)}
    out = sums.select(*keys, *[(F.col(f"s{j}") + F.col(f"a{j}") / F.col("m")).alias(f"c{j}") for j in range(DIM)], *[v.alias(f"v{i}{j}") for (i, j), v in cov.items()])
    return _cholesky(out, keys)


def _cholesky(df: DataFrame, keys: list[str]) -> DataFrame:
    """Replaces v by its lower triangular factor l, column by column."""
    for j in range(DIM):
        inner = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"v{j}{j}") - inner, F.lit(FLOORS[j] ** 2 / 2))))
        df = df.withColumns({f"l{i}{j}": (F.col(f"v{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, DIM)})
    return df.select(*keys, *[f"c{j}" for j in range(DIM)], *[f"l{i}{j}" for i in range(DIM) for j in range(i + 1)], sum((F.log(F.col(f"l{j}{j}")) for j in range(DIM)), F.lit(0.0)).alias("logdet"))


def _distance(df: DataFrame) -> DataFrame:
    """df with d2, the squared Mahalanobis distance from its estimate, by forward substitution."""
    for i in range(DIM):
        df = df.withColumn(f"y{i}", (_x(i) - F.col(f"c{i}") - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIM)), F.lit(0.0))).drop(*[f"y{i}" for i in range(DIM)])


def _quartiles(vectors: DataFrame, shifts: DataFrame) -> DataFrame:
    """Start from medians and quartile ranges, read off histograms with bins of a quarter of the variance floor."""
    long = vectors.select("group", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.floor(_x(j) * (4 / FLOORS[j])).alias("bin")) for j in range(DIM)])).alias("e"))
    bins = long.groupBy("group", F.col("e.j").alias("j"), F.col("e.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("group", "j")
    run = bins.withColumns({"through": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
    width = F.element_at(F.array(*[F.lit(f / 4) for f in FLOORS]), F.col("j") + 1)
    at = lambda p: F.min(F.when(F.col("through") >= p * F.col("all"), (F.col("bin") + 0.5) * width))
    q = run.groupBy("group", "j").agg(at(0.25).alias("a"), at(0.5).alias("b"), at(0.75).alias("c"))
    wide = q.groupBy("group").agg(*[F.max(F.when(F.col("j") == j, F.col("b"))).alias(f"c{j}") for j in range(DIM)], *[F.max(F.when(F.col("j") == j, F.pow((F.col("c") - F.col("a")) / 1.349, 2) + FLOORS[j] ** 2)).alias(f"v{j}{j}") for j in range(DIM)])
    return _cholesky(wide.withColumns({f"v{i}{j}": F.lit(0.0) for i in range(DIM) for j in range(i)}), ["group"])


def estimates(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """group, centre and covariance factor of every group of vectors (group, x0..x4), which has at least two rows."""
    factor = consistency(SUPPORT, DIM)
    shift = vectors.groupBy("group").agg(*[F.avg(_x(j)).alias(f"s{j}") for j in range(DIM)], F.count(F.lit(1)).alias("rows"))
    shift = scratch.save(shift, "shift")
    small = shift.count() <= BROADCAST_GROUPS
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    based = vectors.join(near(shift), "group")
    params = _moments(based, ["group"], 1.0).withColumn("start", F.lit(0)).unionByName(_quartiles(vectors, shift).withColumn("start", F.lit(1)))
    best = open_ = scratch.save(params, "start")
    for step in range(STEPS):
        far = _distance(based.join(near(open_.drop("logdet")), "group")).withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-6) * 16))
        counts = far.groupBy("group", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("group", "start")
        cut = counts.withColumns({"through": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)}).where(F.col("through") >= SUPPORT * F.col("all")).groupBy("group", "start").agg(F.min("bin").alias("last"))
        cut = scratch.save(cut, f"cut{step}")
        taken = scratch.save(_moments(far.join(near(cut), ["group", "start"]).where("bin <= last"), ["group", "start"], factor), f"step{step}")
        if not step:  # a start's own determinant is of all rows and compares with none
            best = open_ = taken
            continue
        held = open_.select("group", "start", F.col("logdet").alias("held"))
        open_ = scratch.save(taken.join(near(held), ["group", "start"]).where(F.col("logdet") < F.col("held") - TOLERANCE).drop("held"), f"open{step}")
        if open_.isEmpty():
            break
        best = scratch.save(best.join(near(open_.select("group", "start")), ["group", "start"], "left_anti").unionByName(open_), f"best{step}")
    first = best.withColumn("order", F.row_number().over(Window.partitionBy("group").orderBy("logdet", "start")))
    out = first.where("order = 1").drop("order", "start", "logdet").join(near(shift.select("group", "rows")), "group")
    return scratch.save(out, "estimates")


def mixed(own: DataFrame, above: DataFrame, shrink: float) -> DataFrame:
    """own (group, parent, rows, centre, factor) with the moments of its mixture with its parent's estimate in above."""
    names = [f"c{j}" for j in range(DIM)] + [f"l{i}{j}" for i in range(DIM) for j in range(i + 1)]
    both = own.join(above.select(F.col("group").alias("parent"), *[F.col(n).alias(f"p_{n}") for n in names]), "parent")
    w, v = F.col("rows") / (F.col("rows") + F.lit(float(shrink))), {}
    gap = [F.col(f"c{j}") - F.col(f"p_c{j}") for j in range(DIM)]
    for i in range(DIM):
        for j in range(i + 1):
            mine, theirs = (sum((F.col(f"{p}l{i}{k}") * F.col(f"{p}l{j}{k}") for k in range(j + 1)), F.lit(0.0)) for p in ("", "p_"))
            v[f"v{i}{j}"] = w * mine + (1 - w) * theirs + w * (1 - w) * gap[i] * gap[j]
    centre = [(F.col(f"p_c{j}") + w * gap[j]).alias(f"c{j}") for j in range(DIM)]
    return _cholesky(both.select("group", *centre, *[c.alias(n) for n, c in v.items()]), ["group"]).drop("logdet")


def judge(docs: DataFrame, shrink: float = SHRINK, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, the counts, base_failed, d2 (NULL for texts that fail the base rules) and kept, for every row of docs."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    stats = statistics(docs.select("doc_id", "text", "lang", "source")).drop("text")
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    levels = {"group": name("lang", "source"), "parent": name("lang"), "top": F.lit("all")}
    stats = scratch.save(stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *[c.alias(n) for n, c in levels.items()], *[v.alias(f"x{j}") for j, v in enumerate(vector())]), "statistics")
    good = stats.where("not base_failed")
    vectors = scratch.save(good.select(F.explode(F.array(*levels)).alias("group"), *[f"x{j}" for j in range(DIM)]), "vectors")
    found = estimates(vectors, scratch)
    tree = scratch.save(good.select(*levels).distinct(), "tree")
    few = tree.count() <= BROADCAST_GROUPS
    near = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    languages = tree.select(F.col("parent").alias("group"), F.col("top").alias("parent")).distinct()
    above = scratch.save(mixed(found.join(near(languages), "group"), found.where("group = 'all'"), shrink), "languages")
    own = scratch.save(mixed(found.join(near(tree.select("group", "parent")), "group"), above, shrink), "groups")
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    judged = _distance(stats.join(near(own), "group", "left"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("d2") <= chi2_quantile(quantile, DIM))).alias("kept"), d2.alias("d2"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return judge(docs)
