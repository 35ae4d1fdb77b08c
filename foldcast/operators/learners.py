"""Base learners over walk-forward folds: tree ensemble, robust linear and factorisation sequence models.

Symbols are pooled in one fit per fold, so fold edges are dates shared by all symbols
(positions in the calendar of all dates), and inputs and targets are scaled per
symbol on training rows. With one symbol this is the plain per-symbol scheme.

Tree folds are independent Spark jobs, several at a time (``FOLD_THREADS``); each writes its forecasts and models to a
``FoldStore`` when it is done, so a run that was cut off goes on with the folds that are missing, and a caller that
needs one model fits only its fold. The sequence models of all folds are fitted together, pass by pass (``sequence_fit``).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
import itertools
import random
import time

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import numpy as np

from foldcast.operators import sequence_fit as SF
from foldcast.operators.folds import FoldSpec, NoFoldsError
from foldcast.operators.joins import attach
from foldcast.operators.scaling import minmax_stats, scale_rows, standard_stats
from foldcast.operators.series import SeriesSpec, number_rows
from foldcast.operators.windows import shift
from foldcast.schema import feature_columns
from foldcast.session import materialise, scratch_path

FOLD_THREADS = 8  # folds fitted at a time; each is a row of small jobs that leaves most of a cluster idle
TRAIN_BYTES = 64 << 20  # bytes of training rows in one partition
SEQUENCE_BLOCK = 512  # rows of one symbol that a task of a sequence fit takes together

TREE, HUBER, FM = "Tree Ensemble", "Sequence Huber", "Sequence FM"


@dataclass(frozen=True)
class TreeConfig:
    """Sizes of both halves; fewer rounds for quick runs."""

    boost_rounds: int = 500
    boost_depth: int = 6
    step: float = 0.05
    row_share: float = 0.8
    column_share: str = "0.8"
    forest_trees: int = 300
    forest_depth: int = 12
    min_leaf: int = 3
    early_stop: bool = False
    seed: int = 42


@dataclass(frozen=True)
class SequenceConfig:
    """``patience`` steps without a better loss on the last ``judged`` share of a fold's training days end an FM fit (0: never)."""

    time_step: int = 90
    max_iter: int = 100
    reg: float = 1.0
    fm_reg: float = 0.01
    epsilon: float = 1.35
    tol: float = 1e-6
    factor_size: int = 8
    step: float = 0.0005
    patience: int = 0
    judged: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class LearnerRun:
    """Forecasts of the fitted folds and what the last of them leaves behind: a Spark model, or the parameters of a sequence model."""

    model_name: str
    predictions: DataFrame
    last_model: PipelineModel | None
    last_stats: DataFrame
    features: list[str]
    time_step: int = 0
    params: np.ndarray | None = None
    extra: dict = field(default_factory=dict)


@dataclass(frozen=True)
class FoldStore:
    """Finished folds of learners below a shared folder, with a table of what is done.

    A fold is in the table only when its forecasts and models are written, so whatever a lost run left behind is written again.
    """

    spark: SparkSession
    path: str

    def done(self, learner: str) -> set[int]:
        try:
            return {r["fold_id"] for r in self.seconds(learner).select("fold_id").collect()}
        except AnalysisException:  # nothing is done yet
            return set()

    def _of(self, learner: str, fold: int, what: str) -> str:
        return f"{self.path}/{learner.lower().replace(' ', '_')}/{what}/fold_id={fold}"

    def add(self, learner: str, fold: int, predictions: DataFrame, model: PipelineModel, seconds: float) -> None:
        predictions.drop("fold_id").write.mode("overwrite").parquet(self._of(learner, fold, "predictions"))
        model.write().overwrite().save(self._of(learner, fold, "model"))
        # A folder for each row: folds end at the same time, and two appends to one folder would undo each other.
        row = self.spark.createDataFrame([(learner, fold, float(seconds))], "learner string, fold_id int, seconds double")
        row.coalesce(1).write.mode("overwrite").parquet(self._of(learner, fold, "done"))

    def predictions(self, learner: str, folds: list[int]) -> DataFrame:
        """Forecasts of the given folds, in one scan that prunes the others."""
        base = f"{self.path}/{learner.lower().replace(' ', '_')}/predictions"
        rows = self.spark.read.option("basePath", base).parquet(*[self._of(learner, k, "predictions") for k in folds])
        return rows.withColumn("fold_id", F.col("fold_id").cast("int"))

    def model(self, learner: str, fold: int) -> PipelineModel:
        return PipelineModel.load(self._of(learner, fold, "model"))

    def seconds(self, learner: str) -> DataFrame:
        """``fold_id`` and ``seconds`` of the folds that are done."""
        return self.spark.read.parquet(f"{self.path}/{learner.lower().replace(' ', '_')}/done").select("fold_id", "seconds")


def with_calendar(features: DataFrame, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Replace per-symbol positions by positions in the calendar of all dates; own positions move to ``row_no``."""
    days = features.select(F.lit("all").alias("_all"), spec.time).distinct()
    calendar = number_rows(days, spec.with_(keys=("_all",))).drop("_all")
    rows = features.withColumnsRenamed({"rn": "row_no", "n": "row_n"})
    return attach(rows, calendar, [spec.time])


def calendar_folds(cal: DataFrame, folds: FoldSpec) -> list[tuple[int, int, int]]:
    """(fold, train_end, test_end) in calendar positions: a handful of integers."""
    n = cal.agg(F.max("n")).first()[0] or 0
    if n >= folds.min_train + folds.test:
        count = (n - folds.min_train - folds.test) // folds.step + 1
    else:
        count = 1 if n > folds.min_train else 0
    if not count:
        raise NoFoldsError("no series has enough rows for a fold; reduce min_train or use more history")
    return [(k, folds.min_train + k * folds.step, min(folds.min_train + k * folds.step + folds.test, n)) for k in range(count)]


def with_target(features: DataFrame, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Next row's close and date; rows without one have NULL."""
    return shift(features, spec, {"Target_Close": ("close", -1), "target_date": (spec.time, -1)})


def _boosting(cfg: TreeConfig) -> GBTRegressor:
    flag = {"validationIndicatorCol": "validating", "validationTol": 0.001} if cfg.early_stop else {}
    return GBTRegressor(
        featuresCol="x", labelCol="target", predictionCol="boosted", maxIter=cfg.boost_rounds, maxDepth=cfg.boost_depth,
        stepSize=cfg.step, subsamplingRate=cfg.row_share, featureSubsetStrategy=cfg.column_share, seed=cfg.seed, maxMemoryInMB=1024, **flag,
    )


def _forest(cfg: TreeConfig) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="x", labelCol="target", predictionCol="bagged", numTrees=cfg.forest_trees, maxDepth=cfg.forest_depth,
        minInstancesPerNode=cfg.min_leaf, featureSubsetStrategy="sqrt", seed=cfg.seed, cacheNodeIds=True, maxMemoryInMB=1024,
    )


def tree_output() -> Column:
    """Mean of both halves, back at the symbol's price level."""
    return (F.col("boosted") + F.col("bagged")) / 2 * F.col("std_close") + F.col("mean_close")


@dataclass(frozen=True)
class TreeFolds:
    """Everything tree fits share: numbered rows with their targets, fold edges, and the scaler of every fold."""

    rows: DataFrame
    edges: list[tuple[int, int, int]]
    stats: DataFrame
    names: list[str]
    time: str
    partitions: int

    @classmethod
    def of(cls, features: DataFrame, folds: FoldSpec, spec: SeriesSpec) -> TreeFolds:
        names = feature_columns(features.columns)
        base = materialise(with_calendar(with_target(features, spec), spec))
        edges = calendar_folds(base, folds)
        stats = materialise(standard_stats(base, folds, names))
        pos = base.select(spec.time, F.col("rn").alias("target_pos")).distinct().withColumnRenamed(spec.time, "target_date")
        rows = materialise(attach(base, pos, ["target_date"]))
        size = rows.count() * (8 * len(names) + 32)
        return cls(rows, edges, stats, names, spec.time, max(1, size // TRAIN_BYTES))

    def scaler(self, fold: int) -> DataFrame:
        return self.stats.where(F.col("fold_id") == fold)

    def scaled(self, fold: int) -> DataFrame:
        """Rows before the fold's test end, scaled, with their vector and target."""
        _, _, test_end = self.edges[fold]
        used = self.rows.where(F.col("rn") < test_end).withColumn("price", F.col("close"))
        ready = scale_rows(used, self.scaler(fold), self.names, "standard", ["symbol"], ["close"])
        ready = ready.withColumn("target", (F.col("Target_Close") - F.col("mean_close")) / F.col("std_close"))
        return VectorAssembler(inputCols=self.names, outputCol="x").transform(ready)

    def training(self, fold: int, scaled: DataFrame) -> DataFrame:
        """Rows whose target is known when the fold's first test row is forecast, in partitions of about TRAIN_BYTES."""
        _, train_end, _ = self.edges[fold]
        known = scaled.where((F.col("rn") < train_end) & (F.col("target_pos") <= train_end))
        rows = known.select("x", "target", (F.col("rn") >= int(train_end * 0.9)).alias("validating"))
        return rows.repartition(self.partitions)

    def forecasts(self, fold: int, scaled: DataFrame, model: PipelineModel) -> DataFrame:
        test = model.transform(scaled.where(F.col("rn") >= self.edges[fold][1]))
        return test.select(
            "symbol", F.lit(TREE).alias("model"), F.lit(fold).alias("fold_id"), F.col(self.time).alias("origin_date"),
            F.col("target_date").alias("date"), F.col("Target_Close").alias("y_true"), tree_output().alias("y_pred"),
        )


def fit_boosting(task: TreeFolds, fold: int, cfg: TreeConfig):
    """The boosting half of one fold alone: enough for importances and for the rounds that early stopping keeps."""
    train = task.training(fold, task.scaled(fold)).persist()
    try:
        return _boosting(cfg).fit(train)
    finally:
        train.unpersist()


def fit_tree_fold(task: TreeFolds, fold: int, cfg: TreeConfig, store: FoldStore) -> None:
    """Both halves of one fold, side by side on the same rows, and its forecasts; written before it counts as done."""
    began = time.time()
    scaled = task.scaled(fold)
    train = task.training(fold, scaled).persist()
    try:
        train.count()
        boost, forest = in_threads(lambda half: half.fit(train), [_boosting(cfg), _forest(cfg)])
    finally:
        train.unpersist()
    model = PipelineModel([boost, forest])
    store.add(TREE, fold, task.forecasts(fold, scaled, model), model, time.time() - began)


def in_threads(work, items: list, threads: int = FOLD_THREADS) -> list:
    """``work`` on every item, several at a time, with the caller's job properties (pool, group, description)."""
    inherited = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max(1, min(threads, len(items)))) as pool:
        return [f.result() for f in [pool.submit(inherited(work), x) for x in items]]


def learn_tree(
    features: DataFrame,
    folds: FoldSpec,
    cfg: TreeConfig = TreeConfig(),
    spec: SeriesSpec = SeriesSpec(),
    store: FoldStore | None = None,
    last_only: bool = False,
) -> LearnerRun:
    """Boosting and forest averaged, next-day target, fitted and tested fold by fold.

    Folds that ``store`` already holds are not fitted again; with ``last_only`` the last fold alone is wanted.
    """
    task = TreeFolds.of(features, folds, spec)
    store = store or FoldStore(features.sparkSession, scratch_path(features.sparkSession, "folds"))
    wanted = [k for k, _, _ in task.edges][-1 if last_only else 0 :]
    have = store.done(TREE)
    in_threads(lambda k: fit_tree_fold(task, k, cfg, store), [k for k in reversed(wanted) if k not in have])
    last = wanted[-1]
    return LearnerRun(TREE, store.predictions(TREE, wanted), store.model(TREE, last), materialise(task.scaler(last)), task.names, extra={"store": store})


def importance_table(boost, names: list[str], spark: SparkSession) -> DataFrame:
    values = boost.featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")


def feature_importance(run: LearnerRun) -> DataFrame:
    """Importances of the boosting half of the last fold's model."""
    return importance_table(run.last_model.stages[0], run.features, run.predictions.sparkSession)


def last_importance(features: DataFrame, folds: FoldSpec, cfg: TreeConfig = TreeConfig(), spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """The same without a run: only the boosting half of the last fold is fitted."""
    task = TreeFolds.of(features, folds, spec)
    return importance_table(fit_boosting(task, len(task.edges) - 1, cfg), task.names, features.sparkSession)


@dataclass(frozen=True)
class SequenceFolds:
    """Blocks of all symbols with the scalers of all folds, and the fold edges with training windows."""

    blocks: DataFrame
    stats: DataFrame
    edges: list[tuple[int, int, int]]
    names: list[str]

    @classmethod
    def of(cls, features: DataFrame, folds: FoldSpec, time_step: int, spec: SeriesSpec) -> SequenceFolds:
        names = feature_columns(features.columns, close_first=True)
        cal = with_calendar(shift(features, spec, {"prev_date": (spec.time, 1)}), spec)
        rows = materialise(cal.withColumnsRenamed({"rn": "cal", "n": "cal_n"}).withColumnsRenamed({"row_no": "rn", "row_n": "n"}))
        on_calendar = rows.drop("rn", "n").withColumnsRenamed({"cal": "rn", "cal_n": "n"})
        edges = [e for e in calendar_folds(on_calendar, folds) if e[1] > time_step]
        if not edges:
            raise NoFoldsError("no fold has both training and test sequences")
        stats = materialise(minmax_stats(on_calendar, folds, names))
        blocks = materialise(SF.sequence_blocks(rows, stats, names, time_step, spec.with_(row_block=SEQUENCE_BLOCK)))
        n = blocks.count()
        tasks = max(features.sparkSession.sparkContext.defaultParallelism, n * SEQUENCE_BLOCK * len(names) * 8 // TRAIN_BYTES)
        return cls(blocks.repartition(max(1, min(n, tasks))), stats, edges, names)


def learn_sequence(
    features: DataFrame,
    folds: FoldSpec,
    kind: str = HUBER,
    cfg: SequenceConfig = SequenceConfig(),
    spec: SeriesSpec = SeriesSpec(),
    last_only: bool = False,
    task: SequenceFolds | None = None,
) -> LearnerRun:
    """One-step close forecast from the look-back window, min-max scaled on each fold's training rows; all folds in the same passes.

    ``task`` shares the blocks of the same features, folds and look-back between fits; its owner persists them.
    """
    own = task is None
    task = task or SequenceFolds.of(features, folds, cfg.time_step, spec)
    edges = task.edges[-1:] if last_only else task.edges
    d, t = len(task.names), cfg.time_step
    problems, course = [], []
    for k, train_end, test_end in edges:
        inner = train_end - int((train_end - t) * cfg.judged) if kind == FM and cfg.patience else train_end
        problems.append(SF.Problem(k, inner, train_end, test_end, cfg.factor_size, cfg.step, cfg.fm_reg))
    blocks = task.blocks.persist() if own else task.blocks
    try:
        if kind == HUBER:
            params, taken = SF.fit_huber(blocks, problems, d, t, cfg.epsilon, cfg.reg, cfg.max_iter, cfg.tol)
            course = [{"rounds": int(k)} for k in taken]
        else:
            params, course = SF.fit_fm(blocks, problems, d, t, cfg.max_iter, cfg.seed, cfg.patience)
        tests = SF.predict_tests(blocks, problems, params, d, t, kind == HUBER)
        fold_of = F.array(*[F.lit(p.fold_id) for p in problems])
        preds = materialise(tests.select("symbol", F.lit(kind).alias("model"), fold_of[F.col("problem")].alias("fold_id"), "origin_date", "date", "y_true", "y_pred"))
    finally:
        if own:
            blocks.unpersist()
    last = task.stats.where(F.col("fold_id") == edges[-1][0])
    return LearnerRun(kind, preds, None, materialise(last), task.names, t, params[-1], {"course": course, "folds": [p.fold_id for p in problems]})


def tune_sequence(
    features: DataFrame,
    folds: FoldSpec,
    cfg: SequenceConfig = SequenceConfig(),
    grid: dict[str, list] | None = None,
    trials: int = 10,
    spec: SeriesSpec = SeriesSpec(),
) -> tuple[SequenceConfig, DataFrame]:
    """Search on the first fold's training rows only: fit on their first 80 % by date, score on the rest.

    Returns the best configuration of the factorisation model and a table of the trials. Candidates are a seeded sample of the
    grid; all of them are fitted in the same passes.
    """
    grid = grid or {"factor_size": [4, 8, 16], "step": [0.0005, 0.001, 0.005, 0.01], "fm_reg": [0.0, 0.001, 0.01]}
    options = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    chosen = random.Random(cfg.seed).sample(options, min(trials, len(options)))
    task = SequenceFolds.of(features, folds, cfg.time_step, spec)
    fold, train_end, _ = task.edges[0]
    inner_end = cfg.time_step + int((train_end - cfg.time_step) * 0.8)
    tried = [replace(cfg, **params) for params in chosen]
    problems = [SF.Problem(fold, inner_end, train_end, train_end, c.factor_size, c.step, c.fm_reg) for c in tried]
    blocks = task.blocks.persist()
    try:
        _, course = SF.fit_fm(blocks, problems, len(task.names), cfg.time_step, cfg.max_iter, cfg.seed)
    finally:
        blocks.unpersist()
    results = [(i, c["judged"], {k: float(v) for k, v in params.items()}) for i, (c, params) in enumerate(zip(course, chosen))]
    best = min(results, key=lambda r: (r[1], r[0]))
    table = features.sparkSession.createDataFrame(
        [(i, loss, params, i == best[0]) for i, loss, params in results],
        "trial int, loss double, params map<string,double>, best boolean",
    )
    return tried[best[0]], table


def sequence_stops(features: DataFrame, folds: FoldSpec, cfg: SequenceConfig = SequenceConfig(patience=15), spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Steps every fold took, and the step whose state was restored, when the last training days decide when to stop."""
    run = learn_sequence(features, folds, FM, cfg, spec)
    rows = [(k, cfg.max_iter, c["rounds"], c["best_round"], c["best_loss"]) for k, c in zip(run.extra["folds"], run.extra["course"])]
    return features.sparkSession.createDataFrame(rows, "fold_id int, max_rounds int, rounds int, best_round int, best_loss double")


def early_stop_rounds(features: DataFrame, folds: FoldSpec, cfg: TreeConfig, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Boosting rounds kept in the last fold when the last 10 % of its training part decides when to stop."""
    task = TreeFolds.of(features, folds, spec)
    boost = fit_boosting(task, len(task.edges) - 1, replace(cfg, early_stop=True))
    return features.sparkSession.createDataFrame([(cfg.boost_rounds, int(boost.getNumTrees))], "max_rounds int, kept_rounds int")


def train_base_models(
    features: DataFrame,
    folds: FoldSpec,
    tree: TreeConfig = TreeConfig(),
    sequence: SequenceConfig = SequenceConfig(),
    optimize: bool = False,
    spec: SeriesSpec = SeriesSpec(),
    store: FoldStore | None = None,
) -> dict[str, LearnerRun]:
    """The three learners on the same folds, side by side; the two sequence models share their blocks."""
    features = materialise(features)

    def fit_sequences() -> list[LearnerRun]:
        task = SequenceFolds.of(features, folds, sequence.time_step, spec)
        best = tune_sequence(features, folds, sequence, spec=spec)[0] if optimize else sequence
        task.blocks.persist()
        try:
            return in_threads(lambda of: learn_sequence(features, folds, of[0], of[1], spec, task=task), [(HUBER, sequence), (FM, best)])
        finally:
            task.blocks.unpersist()

    (tree_run,), sequence_runs = in_threads(lambda fit: fit(), [lambda: [learn_tree(features, folds, tree, spec, store)], fit_sequences])
    return dict(zip((TREE, HUBER, FM), [tree_run, *sequence_runs]))


def single_split(features: DataFrame) -> FoldSpec:
    """The 80/20 split used when no folds are given, as a fold specification over the calendar."""
    n = features.select("date").distinct().count()
    head = int(n * 0.8)
    return FoldSpec(head, n - head, n - head)


def score_rows(run: LearnerRun, features: DataFrame) -> DataFrame:
    """A tree run's last model on every row: ``symbol``, ``date`` and ``y_pred``, the next close."""
    rows = scale_rows(features.withColumn("price", F.col("close")), run.last_stats.drop("fold_id"), run.features, "standard", ["symbol"], ["close"])
    ready = VectorAssembler(inputCols=run.features, outputCol="x").transform(rows)
    return run.last_model.transform(ready).select("symbol", "date", tree_output().alias("y_pred"))


def save_run(run: LearnerRun, path: str) -> str:
    """Last fold's model, its scaler and the ordered feature list."""
    spark = run.predictions.sparkSession
    if run.last_model is not None:
        run.last_model.write().overwrite().save(f"{path}/model")
    else:
        spark.createDataFrame([(run.params.tolist(),)], "params array<double>").write.mode("overwrite").parquet(f"{path}/model")
    run.last_stats.write.mode("overwrite").parquet(f"{path}/scaler")
    info = [(i, f, run.model_name, run.time_step) for i, f in enumerate(run.features)]
    spark.createDataFrame(info, "position int, feature string, model string, time_step int").write.mode("overwrite").parquet(f"{path}/features")
    return path


def load_run(spark: SparkSession, path: str) -> LearnerRun:
    """What ``save_run`` wrote, ready to score and to forecast; there are no test forecasts in it."""
    info = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    names, name, time_step = [r["feature"] for r in info], info[0]["model"], info[0]["time_step"]
    params = np.array(spark.read.parquet(f"{path}/model").first()["params"]) if time_step else None
    model = None if time_step else PipelineModel.load(f"{path}/model")
    none = spark.createDataFrame([], "symbol string, model string, fold_id int, origin_date date, date date, y_true double, y_pred double")
    return LearnerRun(name, none, model, spark.read.parquet(f"{path}/scaler"), names, time_step, params)
