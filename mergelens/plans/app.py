"""What a user interface calls: reviews, their history, code around a finding."""

from __future__ import annotations

import os
from collections.abc import Sequence
from datetime import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from mergelens.operators.context import code_window
from mergelens.operators.rules import Rule, load_rules
from mergelens.plans.review import VERSION, Review, review
from mergelens.plans.store import Store
from mergelens.sources import config as configs
from mergelens.sources import models

HOME = ".mergelens"


@dataclass
class Settings:
    """The configuration of a repository with the rules and providers that it names."""

    config: dict
    rules: list[Rule]
    providers: list = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def settings(repo: str, explicit: str = "", home: str = "~") -> Settings:
    """Raises ConfigError or OSError for configuration that can't be used; rules that can't be read are warnings. Rule files
    are looked for in the repository's own folder, then its root, then the user's."""
    own = os.path.join(os.path.expanduser(home), HOME)
    config, warnings = configs.load_for_repo(repo, os.path.join(own, "config.yaml"), explicit)
    rules, more = load_rules([os.path.join(repo, HOME), repo, own], config["rules.include"] or [])
    return Settings(config, rules, models.providers(config), [*warnings, *more])


class App:
    def __init__(self, spark: SparkSession, store: str, detectors: Sequence[str] = ("secrets",)):
        self.spark, self.store, self.detectors = spark, Store(spark, store), detectors

    def version(self) -> str:
        return VERSION

    def review(self, repo: str, explicit: str = "") -> Review:
        s = settings(repo, explicit)
        got = review(self.spark, repo, s.config, s.rules, self.detectors, s.providers, self.store)
        got.warnings += s.warnings
        return got

    def list_repos(self) -> DataFrame:
        return self.store.list_repos()

    def list_reviews(self, repo: str, limit: int | None = None, after: tuple[datetime, str] | None = None) -> DataFrame:
        return self.store.list_reviews(repo, limit, after)

    def page_findings(self, repo: str, limit: int, after: tuple[datetime, str] | None = None) -> DataFrame:
        """The findings of a page of reviews."""
        return self.store.findings_of(self.store.list_reviews(repo, limit, after))

    def get_review(self, id_: str) -> tuple[dict, DataFrame]:
        return self.store.get_review(id_)

    def review_context(self, repo: str, file: str, line_start: int, line_end: int, radius: int = 0) -> DataFrame:
        return code_window(self.spark, repo, file, line_start, line_end, radius)

    def repo_mode(self, repo: str) -> str:
        return settings(repo).config["mode"]
