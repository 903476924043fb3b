"""Candidate repositories and their owners from the nodes of search pages."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import archive_url, decode_owner_id
from ..functions.text import empty_to_null
from ..schemas import OWNED_REPOSITORY
from .lists import sorted_lists

OWNER = ("owner_id", "owner_login")
REPOSITORY = (
    *OWNER, "repo_id", "name", "primary_language", "languages", "default_branch",
)
PROFILE_FIELDS = ("full_name", "description", "location", "company", "email", "blog")


def _flat(owner: Column, repo: Column, decoded: Column | None = None) -> list[Column]:
    decoded = decode_owner_id(owner.getField("id")) if decoded is None else decoded
    return [
        decoded.getField("user_type").alias("user_type"),
        decoded.getField("id").alias("owner_id"),
        owner.getField("login").alias("owner_login"),
        repo.getField("id").alias("repo_id"),
        repo.getField("name").alias("name"),
        repo.getField("primaryLanguage").getField("name").alias("primary_language"),
        repo.getField("languages").getField("nodes").getField("name").alias("languages"),
        repo.getField("defaultBranchRef").getField("name").alias("default_branch"),
        repo.getField("createdAt").alias("created_at"),
        repo.getField("pushedAt").alias("pushed_at"),
    ]


def found_repositories(nodes: DataFrame) -> DataFrame:
    """The repositories a search found. Forks and mirrors are left to the search text."""
    node = F.col("node")
    return nodes.select(*_flat(node.getField("owner"), node))


def _is_own(repo: Column, owner: Column) -> Column:
    return (
        (repo.getField("isFork") == F.lit(False)) & (repo.getField("isMirror") == F.lit(False))
        & (repo.getField("owner").getField("id") == owner.getField("id"))
    )


def owner_repositories(nodes: DataFrame, kind: str) -> DataFrame:
    """Original repositories of the owners; ``kind`` is pinnedRepositories or repositories."""
    owner, repo = F.col("owner"), F.col("repo")
    return (
        nodes.select(F.col("node.owner").alias("owner"),
                     F.explode(F.col(f"node.owner.{kind}.nodes")).alias("repo"))
        .filter(_is_own(repo, owner)).select(*_flat(owner, repo))
    )


def all_repositories(nodes: DataFrame) -> DataFrame:
    """Found, pinned and owned repositories in one pass over the nodes.

    The three lists of a node are joined as arrays and exploded once, where a union of three
    selections would parse every page three times.
    """
    owner = F.col("node.owner")
    empty = F.array().cast(f"array<{OWNED_REPOSITORY}>")
    found = F.array(F.struct(
        F.col("node.id").alias("id"), F.col("node.name").alias("name"),
        F.struct(F.col("node.owner.id").alias("id")).alias("owner"),
        F.lit(False).alias("isFork"), F.lit(False).alias("isMirror"),
        F.col("node.createdAt").alias("createdAt"), F.col("node.pushedAt").alias("pushedAt"),
        F.col("node.primaryLanguage").alias("primaryLanguage"),
        F.col("node.languages").alias("languages"),
        F.col("node.defaultBranchRef").alias("defaultBranchRef"),
    ))
    lists = [F.coalesce(F.col(f"node.owner.{kind}.nodes"), empty)
             for kind in ("pinnedRepositories", "repositories")]
    own = [F.filter(x, lambda r: _is_own(r, owner)) for x in lists]
    # the id of an owner is decoded once for the three lists
    rows = nodes.select(owner.alias("owner"), decode_owner_id(F.col("node.owner.id")).alias("decoded"),
                        F.explode(F.concat(found, *own)).alias("repo"))
    return rows.select(*_flat(F.col("owner"), F.col("repo"), F.col("decoded")))


def filter_candidates(repos: DataFrame, min_age_days: int, languages: Sequence[str]) -> DataFrame:
    """Repositories of people, active over a long enough span, in a supported language."""
    span = F.datediff(F.col("pushed_at").try_cast("date"), F.col("created_at").try_cast("date"))
    return repos.filter(
        (F.col("user_type") == "User") & (span >= min_age_days)
        & F.col("primary_language").isin(list(languages))
    ).select(*REPOSITORY)


def recently_analysed(analysed: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Ids analysed less than ``days`` before ``as_of``; a comparison the scan can use.

    ``analysed`` may hold several rows per id, such as stored changes: any recent one counts.
    """
    first = F.date_sub(as_of, days - 1).cast("timestamp_ntz")
    return analysed.filter(F.col("updated_by_analyzer") >= first).select(
        F.col("raw_id").alias("repo_id"))


def drop_recent(repos: DataFrame, analysed: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Drop repositories analysed a short while ago."""
    return repos.join(recently_analysed(analysed, as_of, days), "repo_id", "left_anti")


def with_min_group(rows: DataFrame, min_rows: int, keys: Sequence[str] = OWNER) -> DataFrame:
    """Rows of groups that have at least ``min_rows`` rows.

    Counted with partial sums and joined back: an owner with very many rows is never gathered in
    one task, as it would be by a window over the group.
    """
    large = rows.groupBy(*keys).count().filter(F.col("count") >= min_rows).select(*keys)
    return rows.join(large, list(keys), "left_semi")


def group_users(repos: DataFrame) -> DataFrame:
    """Display form (owner, repositories): one row per owner. For the owners that are shown."""
    rest = [c for c in repos.columns if c not in OWNER]
    return sorted_lists(repos, OWNER, F.struct(*rest), "repositories")


def commit_ratios(weeks: DataFrame, keys: Sequence[str] = ("owner_login", "name")) -> DataFrame:
    """Owner share of all commits from weekly rows (keys, owner_commits, all_commits)."""
    sums = weeks.groupBy(*keys).agg(
        F.sum(F.coalesce("owner_commits", F.lit(0))).alias("_owner"),
        F.sum(F.coalesce("all_commits", F.lit(0))).alias("_all"),
    )
    return sums.select(
        *keys, F.try_divide(F.col("_owner").cast("double"), F.col("_all").cast("double"))
        .alias("owner_ratio"),
    )


def filter_by_ratio(repos: DataFrame, min_ratio: float) -> DataFrame:
    """Repositories mostly written by their owner; an unknown ratio does not pass."""
    return repos.filter(F.col("owner_ratio") >= min_ratio)


def attach_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add profile fields by id, empty texts as null. Without a matching profile the user stays
    with null fields.

    ``profiles``: requested_id, id and the fields; a response for another id is not believed. They
    are first cut down to the users, so that a few users do not make all profiles move.
    """
    sane = profiles.filter(F.col("id") == F.col("requested_id")).select(
        F.col("requested_id").alias("owner_id"),
        *[empty_to_null(F.col(c)).alias(c) for c in PROFILE_FIELDS],
        F.col("job_seeker"),
    )
    known = sane.join(users.select("owner_id"), "owner_id", "left_semi")
    return users.join(known, "owner_id", "left")


def with_archive_url(repos: DataFrame) -> DataFrame:
    return repos.withColumn(
        "archive_url", archive_url(F.col("owner_login"), F.col("name"), F.col("default_branch"))
    )


def contacts_of(users: DataFrame) -> DataFrame:
    """(category, contact, user_id) for the contacts a user has."""
    return users.select(
        "user_id",
        F.explode(F.array(
            F.struct(F.lit("Email").alias("category"), F.col("email").alias("contact")),
            F.struct(F.lit("Website").alias("category"), F.col("blog").alias("contact")),
        )).alias("c"),
    ).filter(F.col("c.contact").isNotNull()).select("c.category", "c.contact", "user_id")


def languages_of(repos: DataFrame) -> DataFrame:
    """Distinct languages of all repositories, graded or not."""
    every = F.array_append(F.coalesce("languages", F.array().cast("array<string>")),
                           F.col("primary_language"))
    return (
        repos.select(F.explode(every).alias("language"))
        .filter(F.col("language").isNotNull()).distinct()
    )
