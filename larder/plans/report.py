"""Results of a report with the models behind them and the frames it keeps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from larder.plans.models import Fitted, save_fitted


class Report(dict[str, DataFrame]):
    """Results by name, and ``models``: what was fitted on the way, by name.

    Shared frames stay in memory or on disk until ``release``, or the end of a ``with`` block; results that are asked
    for later are computed anew and are the same.
    """

    def __init__(self, results: dict[str, DataFrame], models: dict[str, Fitted], kept: Iterable[DataFrame]):
        super().__init__(results)
        self.models = models
        self._kept = list(kept)

    def save_models(self, path: str) -> None:
        """Each model as a bundle under its name, to be read by ``load_fitted``."""
        for name, model in self.models.items():
            save_fitted(next(iter(self.values())).sparkSession, model, f"{path}/{name}")

    def release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    def __enter__(self) -> Report:
        return self

    def __exit__(self, *failure) -> None:
        self.release()
