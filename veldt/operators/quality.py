"""Gate on table counts: a value must lie within so many standard deviations of its history."""

from dataclasses import dataclass
from statistics import fmean, stdev

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Detector:
    low: float
    high: float
    mean: float
    std: float

    @staticmethod
    def from_history(values: list[float], deviations: float = 5.0) -> "Detector | None":
        """None for fewer than two values."""
        if len(values) < 2:
            return None
        m, s = fmean(values), stdev(values)
        return Detector(m - deviations * s, m + deviations * s, m, s)

    def check(self, value: float) -> tuple[bool, float]:
        """Whether the value lies in the closed interval, and its distance in standard deviations."""
        return self.low <= value <= self.high, abs(value - self.mean) / self.std if self.std > 0 else 0.0


def validate_counts(history: dict[str, list[float]], current: dict[str, float], deviations: float | dict[str, float] = 5.0) -> dict:
    """{passed, checks}: one check for each series with at least two values; shorter ones are skipped."""
    checks = []
    for name, values in history.items():
        d = deviations.get(name, 5.0) if isinstance(deviations, dict) else deviations
        if detector := Detector.from_history(values, d):
            ok, z = detector.check(current[name])
            checks.append({"label": name, "value": current[name], "passed": ok, "z_score": z, "low": detector.low, "high": detector.high})
    return {"passed": all(c["passed"] for c in checks), "checks": checks, "summary": "; ".join(f"{c['label']}: {'ok' if c['passed'] else 'FAILED'} ({c['value']:.2f}, z {c['z_score']:.2f})" for c in checks)}


def current_counts(interactions: DataFrame) -> dict[str, float]:
    row = interactions.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.count(F.lit(1)).alias("interactions")).first()
    return {k: float(v) for k, v in row.asDict().items()}


def gate(counts: DataFrame, series: str, value: str, at: str, deviations: float = 5.0) -> DataFrame:
    """series, n, mean, std, low, high, current, z_score, passed: the last value of each series against the ones before."""
    last = counts.groupBy(series).agg(F.max_by(value, at).alias("current"), F.max(at).alias("__last"))
    old = counts.join(last.select(series, "__last"), series).filter(F.col(at) < F.col("__last")).groupBy(series).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    s = F.col("std") * deviations
    rows = old.filter("n >= 2").join(last.drop("__last"), series).withColumn("low", F.col("mean") - s).withColumn("high", F.col("mean") + s)
    z = F.when(F.col("std") > 0, F.abs(F.col("current") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return rows.withColumn("z_score", z).withColumn("passed", F.col("current").between(F.col("low"), F.col("high")))
