"""The detection model as tables: axes, priors, thresholds and a configuration, in versioned folders."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.functions.vectors import usable
from axisflow.operators import calibration, scoring, sketch
from axisflow.operators.storage import cut

FORMAT = "1"


@dataclass(frozen=True)
class Config:
    dim: int = 384
    cones: int = 4096
    r: int = 8
    temperature: float = 10.0
    seed: int = 13
    smoothing: float = 1e-6
    alpha: float = 1e-4
    effective_count: float = 1.0
    weights: dict[str, float] | None = None

    def __post_init__(self):
        if min(self.dim, self.cones, self.r) < 1 or self.r > self.cones:
            raise ValueError("dim, cones and r must be positive, and r at most cones")
        if not all(math.isfinite(x) for x in (self.temperature, self.smoothing, self.alpha, self.effective_count)):
            raise ValueError("temperature, smoothing, alpha and effective_count must be finite")
        if self.temperature <= 0 or self.smoothing < 0 or self.effective_count <= 0 or not 0 < self.alpha < 1:
            raise ValueError("temperature and effective_count must be positive, smoothing not negative, alpha between 0 and 1")


@dataclass(frozen=True)
class Model:
    config: Config
    axes: DataFrame
    benign: DataFrame
    malicious: DataFrame
    threshold: float | None = None
    groups: DataFrame | None = field(default=None)

    # --- making and keeping -----------------------------------------------------------------

    @staticmethod
    def fit(benign: DataFrame, malicious: DataFrame, config: Config, id_col: str = "vec_id", vector_col: str = "embedding", family: str = "family", axes: DataFrame | None = None) -> Model:
        """From embeddings; rows that are no usable vectors are an error. Axes are random by the seed unless they are given."""
        spark = benign.sparkSession
        require_usable(benign, vector_col, config.dim)
        require_usable(malicious, vector_col, config.dim)
        axes = sketch.random_axes(spark, config.cones, config.dim, config.seed) if axes is None else axes
        make = lambda df: sketch.exploded(sketch.sketch(df, axes, config.r, config.temperature, id_col, vector_col), id_col)
        cones = axes.select("cone")
        bad = make(malicious).join(malicious.select(id_col, F.col(family).alias("family")), id_col)
        return Model(config, axes, cut(scoring.priors(make(benign), cones, None, config.smoothing), "prior"), cut(scoring.priors(bad, cones, "family", config.smoothing), "prior"))

    def save(self, path: str) -> str:
        """A new version below `path`; the pointer to it is written last."""
        spark, version = self.axes.sparkSession, uuid.uuid4().hex
        at = f"{path}/{version}"
        for name in ("axes", "benign", "malicious"):
            getattr(self, name).write.parquet(f"{at}/{name}")
        if self.groups is not None:
            self.groups.write.parquet(f"{at}/groups")
        state = {"format": FORMAT, "config": asdict(self.config), "threshold": self.threshold, "groups": self.groups is not None}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{at}/state")
        spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
        return version

    @staticmethod
    def load(spark: SparkSession, path: str, version: str | None = None) -> Model:
        version = version or spark.read.text(f"{path}/current").first()["value"]
        at = f"{path}/{version}"
        state = json.loads(spark.read.text(f"{at}/state").first()["value"])
        if state["format"] != FORMAT:
            raise ValueError(f"unknown format {state['format']!r}")
        tables = [spark.read.parquet(f"{at}/{n}") for n in ("axes", "benign", "malicious")]
        model = Model(Config(**state["config"]), *tables, state["threshold"], spark.read.parquet(f"{at}/groups") if state["groups"] else None)
        model.check()
        return model

    def check(self, tolerance: float = 1e-5) -> None:
        """Axes are unit vectors of the right number; priors are distributions over all cones."""
        c = self.config
        n, bad = self.axes.agg(F.count_distinct("cone"), F.count_if(~usable(F.col("axis"), c.dim))).first()
        if n != c.cones or bad:
            raise ValueError(f"{n} axes, {bad} of them unusable; {c.cones} are due")
        for prior, keys in ((self.benign, []), (self.malicious, ["family"])):
            wrong = prior.groupBy(*keys).agg(F.sum("p").alias("s"), F.min("p").alias("least"), F.count_distinct("cone").alias("n")).filter((F.abs(F.col("s") - 1) > tolerance) | (F.col("least") < 0) | (F.col("n") != c.cones))
            if not wrong.isEmpty():
                raise ValueError("a prior is no distribution over the cones")
        if self.malicious.isEmpty():
            raise ValueError("the model has no malicious prior")
        if not self.malicious.filter(F.coalesce(F.trim("family"), F.lit("")) == "").isEmpty():
            raise ValueError("families need names")
        self.mixture()  # refuses weights that do not name exactly the families
        unfit = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        if self.threshold is not None and not math.isfinite(self.threshold) or self.groups is not None and not self.groups.filter(unfit(F.col("threshold"))).isEmpty():
            raise ValueError("thresholds must be finite")

    # --- using ------------------------------------------------------------------------------

    def sketches(self, vectors: DataFrame, r: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        return sketch.exploded(sketch.sketch(vectors, self.axes, r or self.config.r, self.config.temperature, id_col, vector_col), id_col)

    def mixture(self) -> DataFrame:
        return scoring.mixture_weights(self.malicious.select("family").distinct(), self.config.weights)

    def score(self, vectors: DataFrame, approximate: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """id, score; by the `approximate` nearest cones only, and for 1 by a table lookup. Axes and priors of broadcast size score batches in place."""
        if approximate != 1 and scoring.fits_in_batches(self.axes, self.malicious):
            return scoring.batch_scores(vectors, self.axes, self.benign, self.malicious, self.mixture(), approximate or self.config.r, self.config.temperature, self.config.effective_count, id_col, vector_col)
        some = self.sketches(vectors, approximate, id_col, vector_col)
        if approximate == 1:
            return scoring.fast_scores(some, scoring.cone_scores(self.benign, self.malicious, self.mixture(), self.config.effective_count), id_col)
        return scoring.scores(some, self.benign, self.malicious, self.mixture(), self.config.effective_count, id_col)

    def explain(self, vectors: DataFrame, top: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        return scoring.explanations(self.sketches(vectors, None, id_col, vector_col), self.benign, self.malicious, top, id_col)

    def calibrate(self, scored: DataFrame, group: str | None = None) -> Model:
        """With the threshold of benign scores, overall or by group as well; earlier group thresholds go."""
        row = calibration.thresholds(scored, self.config.alpha).first()
        if row is None:
            raise ValueError("no scores to calibrate with")
        groups = calibration.thresholds(scored, self.config.alpha, group).withColumnRenamed(group, "calibration_group") if group else None
        return replace(self, threshold=row["threshold"], groups=groups)

    def predict(self, scored: DataFrame, use_default: bool = True) -> DataFrame:
        if self.threshold is None:
            raise ValueError("the model is not calibrated")
        return calibration.decided(scored, self.groups, self.threshold if use_default or self.groups is None else None)

    def refresh(self, window: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", alpha: float | None = None, group: str | None = None, drop_groups: bool = False, approximate: int | None = None) -> tuple[Model, dict]:
        """A model with benign prior and thresholds of a new window, and a report of what changed; this one stays as it is.

        A model with group thresholds needs a column of new groups, or `drop_groups`.
        """
        if self.groups is not None and group is None and not drop_groups:
            raise ValueError("the model has group thresholds: name a column of new groups, or drop them with drop_groups")
        require_usable(window, vector_col, self.config.dim)
        prior = cut(scoring.priors(self.sketches(window, None, id_col, vector_col), self.axes.select("cone"), None, self.config.smoothing), "prior")
        config = replace(self.config, alpha=self.config.alpha if alpha is None else alpha)
        new = replace(self, config=config, benign=prior, groups=None)
        scored = new.score(window, approximate, id_col, vector_col)
        new = new.calibrate(scored.join(window.select(id_col, group), id_col) if group else scored, group)
        count = lambda m: 0 if m.groups is None else m.groups.count()
        dropped = self.groups is not None and group is None
        stats = calibration.thresholds(scored, config.alpha).first()
        return new, {
            "threshold": new.threshold, "alpha": config.alpha, "num_samples": stats["num_samples"], "rank": stats["rank"], "old_threshold": self.threshold, "old_n_calibration_groups": count(self), "n_calibration_groups": count(new),
            "threshold_source": "grouped_benign_refresh_scores" if group else "benign_refresh_scores", "grouped_thresholds_dropped": dropped, "benign_prior_l1_delta": scoring.l1_delta(self.benign, prior).first()["l1_delta"],
            "score_path": {"approximate": approximate is not None, "approximate_k": approximate},
            "refresh_scope": {"benign_prior_updated": True, "threshold_updated": True, "grouped_thresholds_updated": group is not None, "grouped_thresholds_dropped": dropped} | dict.fromkeys(("malicious_priors_fixed", "encoder_config_fixed", "cone_axes_fixed", "scoring_config_fixed"), True),
        }


def require_usable(vectors: DataFrame, column: str, dim: int) -> None:
    bad = vectors.filter(~usable(F.col(column), dim)).count()
    if bad:
        raise ValueError(f"{bad} rows have no finite non-zero vector of {dim} elements")
