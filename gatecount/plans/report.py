"""All answers of the dashboard from one shared input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecount.functions import times as T
from gatecount.functions.text import origin_of
from gatecount.operators import forecast as M
from gatecount.operators import official as O
from gatecount.operators import readings as R
from gatecount.operators import rollup as U
from gatecount.operators import settle as S


class LiveReport:
    """The dashboard's answers; each is planned when it is asked for.

    ``screenings`` are described (names joined) and settled. The week's rows are
    filtered out of the scan once and persisted as ``base``; ``release`` frees them
    when the answers are written. Every other answer is its own Catalyst plan.
    ``films`` (film_id, title, original_title) tell a film's origin where no report
    line names its country.
    """

    ANSWERS = (
        "today week films by_day week_days breakdowns cinemas top_cinemas fullest upcoming today_list "
        "ramp_hours ramp_summary official forecast forecast_trend ranking archive weekend coverage"
    ).split()

    def __init__(
        self,
        screenings: DataFrame,
        ramp: DataFrame,
        weekly: DataFrame,
        annual: DataFrame,
        daily_coverage: DataFrame,
        now: Column,
        today: Column,
        films: DataFrame | None = None,
    ):
        self.films_known = films
        self.screenings, self.ramp, self.weekly, self.annual = screenings, ramp, weekly, annual
        self.daily_coverage, self.now, self.day = daily_coverage, now, today

    @cached_property
    def base(self) -> DataFrame:
        return U.base(self.screenings, self.now, self.day).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        if "base" in self.__dict__:
            self.base.unpersist()

    def answers(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name)() for name in self.ANSWERS}

    def today(self) -> DataFrame:
        return U.day_totals(self.base)

    def week(self) -> DataFrame:
        return U.week_totals(self.base)

    def films(self) -> DataFrame:
        return U.film_period(self.base)

    def by_day(self) -> DataFrame:
        return U.film_by_day(self.base)

    def week_days(self) -> DataFrame:
        return U.week_spine(self.base, self.day)

    def breakdowns(self) -> DataFrame:
        return U.breakdowns(self.base)

    def cinemas(self) -> DataFrame:
        return U.cinemas_per_film(self.base)

    def top_cinemas(self) -> DataFrame:
        return U.top_cinemas(self.base)

    def fullest(self) -> DataFrame:
        return U.fullest(self.base)

    def upcoming(self) -> DataFrame:
        return U.upcoming(self.base)

    def today_list(self) -> DataFrame:
        return U.todays_list(self.base)

    def ramp_hours(self) -> DataFrame:
        return R.ramp_totals(self.ramp)

    def ramp_summary(self) -> DataFrame:
        return R.ramp_summary(self.ramp, self.day, T.week_start(self.day))

    def official(self) -> DataFrame:
        totals = O.latest_totals(self.weekly, self.now).drop("title")
        return U.official_plus_measured(totals, self.by_day())

    def _runs(self) -> DataFrame:
        """Runs of the films on show this week, with their planned screens."""
        series = O.run_series(self.weekly, self.now)
        if self.films_known is not None:
            series = series.join(self.films_known.select("film_id", "title", "original_title"), "film_id", "left")
        named = [F.col(c) if c in series.columns else F.lit(None).cast("string") for c in ("title", "original_title")]
        origin = origin_of(F.col("country"), *named)
        runs = M.collect_runs(series.withColumn("origin", origin), keep=("origin",))
        shown = self.base.select("film_id").distinct()
        planned = U.planned_ratio(self.screenings, self.now).select("film_id", "planned_ratio")
        return runs.join(shown, "film_id", "left_semi").join(planned, "film_id", "left")

    def forecast(self) -> DataFrame:
        return M.forecast(self._runs(), planned_ratio="planned_ratio")

    def forecast_trend(self) -> DataFrame:
        return M.forecast_trend(self._runs(), planned_ratio="planned_ratio")

    def ranking(self) -> DataFrame:
        return O.all_time_ranking(self.weekly, self.annual)

    def archive(self) -> DataFrame:
        return O.archive_summary(self.weekly)

    def weekend(self) -> DataFrame:
        return O.newest_weekend(self.weekly)

    def coverage(self) -> DataFrame:
        return S.recent_coverage(self.screenings, self.daily_coverage, self.now)

    def headline_figures(self) -> DataFrame:
        """The one-row answers as (section, measure, value)."""
        parts = []
        for section in ("today", "week", "ramp_summary", "coverage"):
            df = getattr(self, section)()
            pairs = F.map_from_arrays(
                F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("double") for c in df.columns])
            )
            parts.append(df.select(F.lit(section).alias("section"), F.explode(pairs).alias("measure", "value")))
        return reduce(DataFrame.unionByName, parts)

    def long_rows(self, parts: Mapping[str, tuple[Sequence[str], Sequence[str], Sequence[str]]]) -> DataFrame:
        """Answers as rows (section, key, measure, value, text).

        ``parts`` names of each answer the columns that make the key, those shown as numbers and those shown as text. A
        null key column is left out of the key; a null measure is a row without value and text.
        """
        types = {"value": "double", "text": "string"}

        def cells(names: Sequence[str], kind: str) -> list[Column]:
            shown = lambda name: [(F.col(name) if k == kind else F.lit(None)).cast(t).alias(k) for k, t in types.items()]
            return [F.struct(F.lit(name).alias("measure"), *shown(name)) for name in names]

        rows = []
        for section, (keys, numbers, texts) in parts.items():
            df = getattr(self, section)()
            key = F.concat_ws("|", *[F.col(c).cast("string") for c in keys]) if keys else F.lit("")
            of = F.explode(F.array(*cells(numbers, "value"), *cells(texts, "text"))).alias("_c")
            rows.append(df.select(F.lit(section).alias("section"), key.alias("key"), of).select("section", "key", "_c.*"))
        return reduce(DataFrame.unionByName, rows)

    def forecast_snapshots(self) -> DataFrame:
        """This run's forecasts as log rows; films without an official total are left out."""
        totals = O.latest_totals(self.weekly, self.now).select("film_id", "as_of")
        return self.forecast().join(totals, "film_id").select(
            "film_id",
            "as_of",
            "weeks",
            F.col("total").alias("predicted"),
            "low",
            "high",
            "screen_trend",
            self.now.alias("at_ts"),
        )
