"""From search pages to developers and their repositories."""

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from ..operators import extract as ex
from ..sources.bucketed import Bucketed
from ..sources.pages import parse_pages
from ..storage import settle


@dataclass(frozen=True)
class CandidateRules:
    min_age_days: int = 60
    min_repositories: int = 2
    min_owner_ratio: float = 0.7
    reanalyse_after_days: int = 10
    languages: Sequence[str] = ("JavaScript", "C++", "C")


class Developers(NamedTuple):
    """``users`` (owner_id, owner_login, profile fields) and ``repositories`` (one row each)."""

    users: DataFrame
    repositories: DataFrame


def extract_candidates(pages: DataFrame, analysed: DataFrame, rules: CandidateRules,
                       as_of: Column, col: str = "value") -> DataFrame:
    """One row per candidate repository of owners that have enough of them."""
    found = settle(found_candidates(parse_pages(pages, col), rules), "found")
    return fresh_candidates(found, analysed, rules, as_of)


def found_candidates(nodes: DataFrame, rules: CandidateRules) -> DataFrame:
    """Repositories among the found nodes and below their owners that the rules admit, once each."""
    return ex.filter_candidates(
        ex.all_repositories(nodes), rules.min_age_days, rules.languages).distinct()


def fresh_candidates(repos: DataFrame, analysed: DataFrame, rules: CandidateRules,
                     as_of: Column) -> DataFrame:
    """Those that were not analysed lately, of owners that have enough of them."""
    fresh = settle(ex.drop_recent(repos, analysed, as_of, rules.reanalyse_after_days), "fresh")
    return ex.with_min_group(fresh, rules.min_repositories)


def enrich_users(repos: DataFrame, profiles: DataFrame | Bucketed, weeks: DataFrame | Bucketed,
                 rules: CandidateRules) -> Developers:
    """Add owner shares, archive addresses and profiles; drop repositories mostly written by
    others and then owners with too few left.

    ``profiles`` and ``weeks`` (owner_login, name, owner_commits, all_commits) are tables, or tables in
    buckets of requested_id and of owner_login, of which those of the batch are read.
    """
    keys = ["name", "owner_login"]  # sorts compare the first eight bytes, which logins may share
    if isinstance(weeks, Bucketed):
        weeks = weeks.of(repos, "owner_login")
    needed = weeks.join(repos.select(*keys), keys, "left_semi")
    rated = repos.join(ex.commit_ratios(needed, keys), keys)
    # the owners are counted in it, and both results are made from it
    mostly = settle(ex.filter_by_ratio(rated, rules.min_owner_ratio), "rated")
    own = ex.with_min_group(mostly, rules.min_repositories)
    owned = ex.with_archive_url(own).select(*ex.REPOSITORY, "archive_url", "owner_ratio")
    owners = owned.select(*ex.OWNER).distinct()
    if isinstance(profiles, Bucketed):
        owners = settle(owners, "owners")
        profiles = profiles.of(owners, "owner_id")
    users = ex.attach_profiles(owners, profiles)
    return Developers(users, owned)
