"""The streaming job for spark-submit: landing folder of search pages in, stored tables out.

Tables are Parquet folders below ``--tables``: profiles, weeks, warnings (the joined catalog),
gazetteer, files and findings, with the columns named in ``skilltide.plans``.
"""

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.analysing import analyse_with
from ..plans.candidates import CandidateRules
from ..sources.bucketed import Bucketed
from ..sources.pages import read_pages
from ..sources.tables import read_table
from .jobs import DeveloperJob, run_stream


def parse(arguments: Sequence[str] | None = None) -> argparse.Namespace:
    defaults = CandidateRules()
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--pages", required=True, help="landing folder, one JSON page per line")
    parser.add_argument("--tables", required=True, help="folder of the input tables")
    parser.add_argument("--store", required=True, help="folder of the stored tables")
    parser.add_argument("--checkpoint", required=True, help="folder of the stream's position")
    parser.add_argument("--interval", default="5 seconds", help="time between batches")
    parser.add_argument("--once", action="store_true", help="handle what is there and stop")
    parser.add_argument("--max-files", type=int, help="page files per batch")
    parser.add_argument("--max-repository-kib", type=int,
                        help="leave out repositories of more unpacked KiB (default: none)")
    parser.add_argument("--buckets", type=int,
                        help="files, findings, weeks and profiles are stored in so many buckets of "
                             "repo_id, repo_id, owner_login and requested_id")
    parser.add_argument("--responses", action="store_true", help="the lines are raw responses")
    parser.add_argument("--merge-every", type=int, default=DeveloperJob.merge_every,
                        help="batches after which stored ones are merged (0: never)")
    parser.add_argument("--languages", default=",".join(defaults.languages))
    parser.add_argument("--min-age-days", type=int, default=defaults.min_age_days)
    parser.add_argument("--min-repositories", type=int, default=defaults.min_repositories)
    parser.add_argument("--min-owner-ratio", type=float, default=defaults.min_owner_ratio)
    parser.add_argument("--reanalyse-after-days", type=int, default=defaults.reanalyse_after_days)
    return parser.parse_args(arguments)


def start(spark: SparkSession, options: argparse.Namespace) -> StreamingQuery:
    def table(name: str, key: str | None = None):
        if key and options.buckets:
            return Bucketed(spark, f"{options.tables}/{name}", key, options.buckets)
        return read_table(spark, name, options.tables)

    job = DeveloperJob(
        root=options.store,
        rules=CandidateRules(
            options.min_age_days, options.min_repositories, options.min_owner_ratio,
            options.reanalyse_after_days, tuple(options.languages.split(","))),
        profiles=table("profiles", "requested_id"), weeks=table("weeks", "owner_login"),
        catalog=table("warnings"),
        gazetteer=table("gazetteer"),
        analyse=analyse_with(
            table("files", "repo_id"), table("findings", "repo_id"),
            options.max_repository_kib * 1024 if options.max_repository_kib else None),
        responses=options.responses, merge_every=options.merge_every or None,
    )
    pages = read_pages(spark, options.pages, options.max_files)
    return run_stream(pages, job, options.checkpoint, None if options.once else options.interval)


if __name__ == "__main__":
    start(SparkSession.builder.getOrCreate(), parse()).awaitTermination()
