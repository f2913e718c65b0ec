"""Problem 3: one label per item from judges that disagree.

Mean-field variational confusion model: the true class of an item has a
Dirichlet prior over classes, and each judge has, for each true class, a
Dirichlet prior over the labels it gives.  One round computes every item's
class posterior from expected log-probabilities (digamma of the Dirichlet
parameters) and adds the posteriors up per (judge, class, label) with a
group-by; the sums are the new parameters.  Items with equal votes are one
pattern, so a round is one scan of the patterns with map-side sums and moves
judges × classes² numbers.  Up to ``MOST_JUDGES`` judges these numbers lie in
arrays that go with the scan (7 MB); above it they lie in a table by judge and
label, which meets the patterns by joins.  Both ways compute the same.

Reliability is the posterior of the probability that a judge gives the right
label, with a credible interval; agreement is Krippendorff's alpha.

Defined results: failed calls, null scores, scores that are no number or are
outside every scale, and unknown judges are no judgement; scores above 10 count
as on a scale of 0 to 100; repeated rows of an item and judge count once, and
of differing ones the latest; items without a valid judgement have no row;
among classes of equal posterior the lower one wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialise

BANDS = ("wrong", "partial", "right")
#: Most judges whose parameters travel as arrays; more are joined as a table.
MOST_JUDGES = 100_000


def canonical_key(name: Column) -> Column:
    """A judge name without case, space, separators and a tag after a colon, for matching spellings."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r":.*$", ""), r"[^a-z0-9]+", "")


def on_ten(score: Column) -> Column:
    """The score from 0 to 10, from either scale; null where it is none."""
    s = F.when(score > 10, score / 10).otherwise(score)
    return F.when(F.isnan(s) | (s < 0) | (s > 10), None).otherwise(s)


def band(score: Column) -> Column:
    """0 below 4, 1 below 7, else 2."""
    return F.when(score < 4, 0).when(score < 7, 1).when(score.isNotNull(), 2)


def valid_votes(results: DataFrame, models: DataFrame, score: str = "correctness") -> DataFrame:
    """(eval_id, model, label, s): one vote per item and canonical judge."""
    return votes_of(results, models, [score]).select("eval_id", "model", "label", "s")


def votes_of(results: DataFrame, models: DataFrame, scores: list[str]) -> DataFrame:
    """(eval_id, model, score, label, s): the votes for each of several scores, from one scan and one shuffle of the judgements."""
    names = models.select(F.col("model").alias("canonical"), canonical_key(F.col("model")).alias("name_key")).filter("canonical is not null").dropDuplicates(["name_key"])
    scale = F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in ("accuracy", "relevance", "correctness", "hallucination", "completeness", "overall_score") if c in results.columns])
    wide = scale > 10
    on_scale = lambda c: F.when(wide, F.col(c) / 10).otherwise(F.col(c))
    rows = results.filter(F.col("parsing_success") & F.col("eval_id").isNotNull()).select("eval_id", canonical_key(F.col("model")).alias("name_key"), *[on_scale(c).alias(f"s{i}") for i, c in enumerate(scores)], F.struct("judged_at", "result_id").alias("at"))
    valid = lambda i: (F.col(f"s{i}") >= 0) & (F.col(f"s{i}") <= 10) & ~F.isnan(f"s{i}")
    latest = rows.groupBy("eval_id", "name_key").agg(*[F.max_by(f"s{i}", F.when(valid(i), F.col("at"))).alias(f"s{i}") for i in range(len(scores))])
    each = F.array(*[F.struct(F.lit(c).alias("score"), F.col(f"s{i}").alias("s")) for i, c in enumerate(scores)])
    votes = latest.join(names, "name_key").select("eval_id", F.col("canonical").alias("model"), F.inline(each)).filter("s is not null")
    return votes.select("eval_id", "model", "score", band(F.col("s")).alias("label"), "s")


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out = np.where(low, out - 1 / np.where(low, x, 1), out)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def psi(x: Column) -> Column:
    """Digamma as a column: six steps of the recurrence, then the asymptotic series."""
    up = x + 6
    f = 1 / (up * up)
    return F.log(up) - 0.5 / up - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240))) - sum((1 / (x + i) for i in range(1, 6)), 1 / x)


class Consensus:
    """The fitted model: ``posterior()`` per item, ``reliability()`` per judge.

    Each is the same for any number of judges; above ``most_judges`` the work
    is handed to ``_Joined``.
    """

    def __new__(cls, votes: DataFrame, *args, most_judges: int = MOST_JUDGES, **how):
        found = votes.select("model").distinct().limit(most_judges + 1).collect()
        self = object.__new__(_Joined if len(found) > most_judges else cls)
        self.judges = sorted(r.model for r in found)
        return self

    def __init__(self, votes: DataFrame, n_classes: int = 3, rounds: int = 30, tolerance: float = 1e-4, right: float = 2.0, wrong: float = 0.7, most_judges: int = MOST_JUDGES):  # noqa: ARG002
        self.spark, self.k = votes.sparkSession, n_classes
        self.prior_class = np.ones(n_classes)
        self.prior_rows = np.full((n_classes, n_classes), wrong) + np.eye(n_classes) * (right - wrong)
        self.classes = self.prior_class * 5
        self.prepare(votes)
        for self.rounds in range(1, rounds + 1):
            if self.round() < tolerance:
                break

    def prepare(self, votes: DataFrame) -> None:
        table = self.spark.createDataFrame([(m, i * self.k) for i, m in enumerate(self.judges)], "model string, code int")
        coded = votes.join(F.broadcast(table), "model").select("eval_id", (F.col("code") + F.col("label")).alias("code"))
        self.items = materialise(coded.groupBy("eval_id").agg(F.array_sort(F.collect_list("code")).alias("codes")), "votes")
        # items with the same votes have the same posterior: a round runs over distinct vote patterns
        self.patterns = materialise(self.items.groupBy("codes").agg(F.count("*").alias("n")), "vote-patterns")
        self.rows = np.tile(self.prior_rows, (len(self.judges), 1, 1)) * 5  # judge × class × label

    def round(self) -> float:
        """One update; the largest change, relative to the largest count."""
        rows, classes = self._sums()
        step = max([np.abs(rows + self.prior_rows - self.rows).max(initial=0) / max(1.0, rows.max(initial=1)), np.abs(classes + self.prior_class - self.classes).max() / max(1.0, classes.max())])
        self.rows, self.classes = rows + self.prior_rows, classes + self.prior_class
        return step

    def _logs(self) -> tuple[np.ndarray, np.ndarray]:
        """Expected log of the class probabilities, and (code × class) of the label probabilities."""
        prior = digamma(self.classes) - digamma(self.classes.sum())
        rows = digamma(self.rows) - digamma(self.rows.sum(axis=2, keepdims=True))
        return prior, rows.transpose(0, 2, 1).reshape(-1, self.k)

    @staticmethod
    def _posterior(column: pa.ListArray, prior: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        offsets = column.offsets.to_numpy()
        codes = column.values.to_numpy()[offsets[0] : offsets[-1]]
        owner = np.repeat(np.arange(len(column)), np.diff(offsets))
        score = np.tile(prior, (len(column), 1))
        for k in range(len(prior)):
            score[:, k] += np.bincount(owner, logs[codes, k], minlength=len(column))
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), codes, owner

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        prior, logs = self._logs()
        k, size = self.k, len(logs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, classes = np.zeros((size, k)), np.zeros(k)
            for b in batches:
                if b.num_rows:
                    p, codes, owner = Consensus._posterior(b.column(0), prior, logs)
                    p *= b.column(1).to_numpy()[:, None]
                    classes += p.sum(axis=0)
                    for c in range(k):
                        total[:, c] += np.bincount(codes, p[owner, c], minlength=size)
            code, cls = np.nonzero(total)
            keys = np.concatenate([code * k + cls, -1 - np.arange(k)])
            yield pa.RecordBatch.from_pydict({"slot": pa.array(keys, pa.int64()), "x": pa.array(np.concatenate([total[code, cls], classes]))})

        rows, classes = np.zeros((size, k)), np.zeros(k)
        for r in self.patterns.mapInArrow(run, "slot long, x double").groupBy("slot").agg(F.sum("x").alias("x")).collect():
            if r.slot < 0:
                classes[-1 - r.slot] = r.x
            else:
                rows[r.slot // k, r.slot % k] = r.x
        return rows.reshape(-1, k, k).transpose(0, 2, 1), classes

    def posterior(self) -> DataFrame:
        """(eval_id, label, confidence, n_votes)."""
        prior, logs = self._logs()
        kind = dict(self.items.dtypes)["eval_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    p, _, owner = Consensus._posterior(b.column(1), prior, logs)
                    label = (p >= p.max(axis=1, keepdims=True) - 1e-12).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label.astype(np.int32)), pa.array(p.max(axis=1)), pa.array(np.bincount(owner, minlength=b.num_rows).astype(np.int32))], ["eval_id", "label", "confidence", "n_votes"])

        return self.items.select("eval_id", "codes").mapInArrow(run, f"eval_id {kind}, label int, confidence double, n_votes int")

    def reliability(self, z: float = 1.96) -> DataFrame:
        """(model, n_votes, reliability, low, high): the chance of the right label, over the classes as they occur, with its interval."""
        share = self.classes / self.classes.sum()
        a, total = np.diagonal(self.rows, axis1=1, axis2=2), self.rows.sum(axis=2)
        mean, var = a / total, a * (total - a) / (total**2 * (total + 1))
        centre, spread = (mean * share).sum(axis=1), np.sqrt((var * share**2).sum(axis=1))
        votes = (self.rows - self.prior_rows).sum(axis=(1, 2))
        data = [(m, float(round(v)), float(c), float(max(0.0, c - z * s)), float(min(1.0, c + z * s))) for m, v, c, s in zip(self.judges, votes, centre, spread, strict=True)]
        return self.spark.createDataFrame(data, "model string, n_votes double, reliability double, low double, high double")


class _Joined(Consensus):
    """The same model with the parameters in a table (model, label, x0, x1, ...) of expected counts by class."""

    def prepare(self, votes: DataFrame) -> None:
        code = F.struct("model", "label")
        self.items = materialise(votes.groupBy("eval_id").agg(F.array_sort(F.collect_list(code)).alias("codes")), "votes")
        patterns = self.items.groupBy("codes").agg(F.count("*").alias("n")).withColumn("p", F.monotonically_increasing_id())
        self.flat = materialise(patterns.select("p", "n", F.inline("codes")), "vote-patterns")
        start = [F.element_at(F.array(*[F.lit(float(5 * self.prior_rows[c, y] - self.prior_rows[c, y])) for y in range(self.k)]), F.col("label") + 1).alias(f"x{c}") for c in range(self.k)]
        every = self.flat.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0), F.lit(self.k - 1))).alias("label"))
        self.sums = materialise(every.select("model", "label", *start), "judge-counts")

    def _log_table(self) -> DataFrame:
        """(model, label, l0, l1, ...): expected logs of the label's probability for each class."""
        k = range(self.k)
        total = self.sums.groupBy("model").agg(*[(F.sum(f"x{c}") + float(self.prior_rows[c].sum())).alias(f"t{c}") for c in k])
        prior = lambda c: F.element_at(F.array(*[F.lit(float(v)) for v in self.prior_rows[c]]), F.col("label") + 1)
        return self.sums.join(total, "model").select("model", "label", *[(psi(F.col(f"x{c}") + prior(c)) - psi(F.col(f"t{c}"))).alias(f"l{c}") for c in k])

    def _posteriors(self, flat: DataFrame, keys: list[str]) -> DataFrame:
        """keys, q0, q1, ..., n_votes: the class posterior of each group of votes."""
        k = range(self.k)
        prior = digamma(self.classes) - digamma(self.classes.sum())
        met = flat.join(self._log_table(), ["model", "label"]).groupBy(*keys).agg(*[(F.sum(f"l{c}") + float(prior[c])).alias(f"s{c}") for c in k], F.count("*").cast("int").alias("n_votes"))
        top = F.greatest(*[F.col(f"s{c}") for c in k])
        met = met.select(*keys, "n_votes", *[F.exp(F.col(f"s{c}") - top).alias(f"e{c}") for c in k])
        return met.select(*keys, "n_votes", *[(F.col(f"e{c}") / sum((F.col(f"e{d}") for d in k), F.lit(0.0))).alias(f"q{c}") for c in k])

    def round(self) -> float:
        k = range(self.k)
        post = materialise(self._posteriors(self.flat, ["p", "n"]), "pattern-posteriors")
        given = self.flat.join(post.drop("n"), "p").groupBy("model", "label").agg(*[F.sum(F.col("n") * F.col(f"q{c}")).alias(f"y{c}") for c in k])
        old = self.sums
        new = materialise(old.join(given, ["model", "label"], "left").select("model", "label", *[F.coalesce(f"y{c}", F.lit(0.0)).alias(f"x{c}") for c in k], *[F.abs(F.coalesce(f"y{c}", F.lit(0.0)) - F.col(f"x{c}")).alias(f"d{c}") for c in k]), "judge-counts")
        r = new.agg(F.max(F.greatest(*[f"d{c}" for c in k])).alias("d"), F.max(F.greatest(*[f"x{c}" for c in k])).alias("x")).first()
        classes = np.array([v or 0.0 for v in post.agg(*[F.sum(F.col("n") * F.col(f"q{c}")) for c in k]).first()])
        self.sums = new.select("model", "label", *[f"x{c}" for c in k])
        step = max((r.d or 0.0) / max(1.0, r.x or 0.0), np.abs(classes + self.prior_class - self.classes).max() / max(1.0, classes.max()))
        self.classes = classes + self.prior_class
        return step

    def posterior(self) -> DataFrame:
        each = self._posteriors(self.items.select("eval_id", F.inline("codes")), ["eval_id"])
        q = F.array(*[F.col(f"q{c}") for c in range(self.k)])
        top = F.array_max(q)
        label = F.array_position(F.transform(q, lambda x: x >= top - 1e-12), True).cast("int") - 1
        return each.select("eval_id", label.alias("label"), top.alias("confidence"), "n_votes")

    def reliability(self, z: float = 1.96) -> DataFrame:
        k, share = range(self.k), self.classes / self.classes.sum()
        own = [F.sum(F.when(F.col("label") == c, F.col(f"x{c}"))).alias(f"a{c}") for c in k]
        by = self.sums.groupBy("model").agg(*own, *[F.sum(f"x{c}").alias(f"t{c}") for c in k])
        a = [F.col(f"a{c}") + float(self.prior_rows[c, c]) for c in k]
        t = [F.col(f"t{c}") + float(self.prior_rows[c].sum()) for c in k]
        centre = sum((a[c] / t[c] * float(share[c]) for c in k), F.lit(0.0))
        spread = F.sqrt(sum((a[c] * (t[c] - a[c]) / (t[c] * t[c] * (t[c] + 1)) * float(share[c] ** 2) for c in k), F.lit(0.0)))
        votes = F.round(sum((F.col(f"t{c}") for c in k), F.lit(0.0)))
        return by.select("model", votes.alias("n_votes"), centre.alias("reliability"), F.greatest(F.lit(0.0), centre - z * spread).alias("low"), F.least(F.lit(1.0), centre + z * spread).alias("high"))


def agreement_parts(votes: DataFrame) -> DataFrame:
    """Per item: n judgements, share of agreeing pairs (null below two)."""
    counts = votes.groupBy("eval_id", "label").agg(F.count("*").alias("c"))
    return counts.groupBy("eval_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).select("eval_id", "n", F.when(F.col("n") > 1, F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("agreement"))


def krippendorff(votes: DataFrame) -> DataFrame:
    """One row: nominal alpha over all items with at least two judgements."""
    counts = votes.groupBy("eval_id", "label").agg(F.count("*").alias("c"))
    items = counts.groupBy("eval_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).filter("n > 1")
    observed = items.agg(F.sum(F.col("n")).alias("n"), F.sum((F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") - 1)).alias("diff"), F.count("*").alias("n_items"))
    label = counts.join(items.select("eval_id"), "eval_id", "left_semi").groupBy("label").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("sq"))
    expected = (F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") - 1)
    return observed.join(label).select("n_items", F.col("n").alias("n_votes"), F.when(expected > 0, F.lit(1.0) - F.col("diff") / expected).otherwise(F.lit(1.0)).alias("alpha"))
