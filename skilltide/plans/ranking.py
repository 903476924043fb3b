"""The ranking of developers and the pages made from it."""

from collections import ChainMap

from pyspark.sql import DataFrame, functions as F

from ..operators import rank as r
from ..storage import replace, settle

Tables = dict[str, DataFrame]
VERIFIED = "verified"


def with_verified(tables: Tables) -> Tables:
    """The tables and, stored, their verified technologies, for several steps that need these. To be made
    anew when technologies_users, their settings or developers change."""
    rows = settle(verified_technologies(tables), "verified")
    return ChainMap({VERIFIED: rows}, tables)


def verified_technologies(tables: Tables, users: DataFrame | None = None) -> DataFrame:
    """(user_id, language, technology) that were verified, of these ``users`` (user_id) only, if given; read
    from the tables of ``with_verified``, else made."""
    def of(name: str) -> DataFrame:
        return tables[name] if users is None else tables[name].join(users, "user_id", "left_semi")

    if VERIFIED in tables:
        return of(VERIFIED)
    return r.verified_technologies(
        of("technologies_users"), of("technologies_users_settings"), of("developers"))


def figures(tables: Tables, users: DataFrame | None = None) -> DataFrame:
    """(user_id, login, full_name, avg_grade, updated_by_analyzer, total_lines_of_code) of developers
    with a verified technology and complete figures; of these ``users`` (user_id) only, if given."""
    verified = verified_technologies(tables, users)
    repositories = tables["repositories"]
    if users is not None:
        repositories = repositories.join(users, "user_id", "left_semi")
    stats = r.user_stats(repositories, r.category_sums(repositories, tables["grades"]))
    known = stats.join(tables["users"].select("user_id", "login", "full_name"), "user_id")
    return known.join(verified.select("user_id"), "user_id", "left_semi")


def rank_users(tables: Tables, order: str = "grade") -> DataFrame:
    """The ``figures`` of all developers with their rank."""
    return r.ranked(figures(tables), order)


def with_documents(ranks: DataFrame, tables: Tables) -> DataFrame:
    """Add grades (JSON texts), languages and technologies as lists, for the rows to be shown."""
    verified = verified_technologies(tables).join(ranks.select("user_id"), "user_id", "left_semi")
    shown = tables["repositories"].join(ranks.select("user_id"), "user_id", "left_semi")
    means = r.category_means(r.category_sums(shown, tables["grades"]))
    return (
        ranks.join(r.grade_documents(means), "user_id", "left")
        .join(r.name_lists(verified), "user_id", "left")
    )


def refresh(df: DataFrame, path: str) -> DataFrame:
    """Store a view and read it back. Readers see the state before or the new one, never a part."""
    return replace(df, path)


def user_pages(tables: Tables) -> DataFrame:
    """One row per developer: profile, contacts, grades, names, averages and last update."""
    users = tables["users"].join(
        tables["developers"].select(
            "user_id", "job_seeker", "available_for_relocation", "programming_experience_months",
            "work_experience_months", "description"),
        "user_id",
    )
    contact = F.to_json(F.struct("category", "contact"))
    contacts = tables["contacts"].groupBy("user_id").agg(
        F.array_sort(F.collect_list(contact)).alias("contacts"))
    sums = r.category_sums(tables["repositories"], tables["grades"])
    means = r.category_means(sums)
    averages = sums.groupBy("user_id").agg(
        F.try_divide(F.sum("total"), F.sum("n")).alias("avg_grade"))
    analysed = tables["repositories"].groupBy("user_id").agg(
        F.max("updated_by_analyzer").alias("_analysed"))
    verified = tables["technologies_users"].select("user_id", "language", "technology")
    page = users
    for part in (contacts, r.grade_documents(means), averages, analysed, r.name_lists(verified)):
        page = page.join(part, "user_id", "left")
    return page.withColumn("updated", F.greatest("updated_by_user", "_analysed")).drop(
        "_analysed", "updated_by_user")


def top_page(tables: Tables, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of developers by grade, update and lines of code, best first."""
    stats = r.user_stats(
        tables["repositories"], r.category_sums(tables["repositories"], tables["grades"]))
    best = [F.desc("avg_grade"), F.desc("updated_by_analyzer"), F.desc("total_lines_of_code"),
            F.col("user_id")]
    return (
        stats.join(tables["developers"].select("user_id"), "user_id", "left_semi")
        .join(tables["users"].select("user_id", "login", "full_name"), "user_id")
        .orderBy(*best).offset((page - 1) * page_size).limit(page_size)
    )
