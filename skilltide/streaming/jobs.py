"""Streaming jobs: search pages to stored grades, and any per-batch work."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.grade import dependencies_of
from ..operators.locations import resolve_location
from ..plans.candidates import (
    CandidateRules, Developers, enrich_users, found_candidates, fresh_candidates,
)
from ..plans.grading import grade
from ..plans.persisting import ROWS, Batch
from ..schemas import TABLES
from ..sources.bucketed import Bucketed
from ..sources.pages import parsed_pages
from ..storage import settle, small_broadcasts
from .changes import append_changes, merge_committed
from .commits import Commits, id_bits


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str,
                interval: str | None = "5 seconds") -> StreamingQuery:
    """Call ``work(batch, id)`` for every micro-batch that has rows.

    The position in the source is kept in the checkpoint, which must lie in storage every node
    reaches. A failing batch fails the query and is repeated after a restart, so ``work`` has to be
    repeatable. Without an interval the query handles what is there and stops.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            work(batch, batch_id)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


@dataclass
class DeveloperJob:
    """Inputs of the stream besides the pages.

    A batch is stored whole or not at all (``commits``) and has one time, also when it is repeated. A batch
    without a graded repository stores no users either. Pages that are broken, and responses that hold errors
    or nothing, are kept in the side table ``rejected``; what a page text gave is counted with the batch.
    """

    root: str
    rules: CandidateRules
    profiles: DataFrame | Bucketed
    weeks: DataFrame | Bucketed
    catalog: DataFrame
    gazetteer: DataFrame
    analyse: Callable[[Developers], DataFrame]
    """Messages about the repositories of a batch, for example by ``analyze_files``."""
    now: Callable[[], Column] = F.current_timestamp
    responses: bool = False
    """Whether the texts are raw responses instead of pages."""
    merge_every: int | None = 100
    """Batches after which the stored ones are merged; None: never."""

    def __call__(self, pages: DataFrame, batch_id: int) -> None:
        log = Commits(pages.sparkSession, self.root)
        with small_broadcasts(pages.sparkSession):
            if not log.has(batch_id):  # else it was cut off between its commit and the stream's own
                self.store(log, pages, batch_id)
            if self.merge_every:
                merge_committed(pages.sparkSession, self.root, self.merge_every)

    def store(self, log: Commits, pages: DataFrame, batch_id: int) -> None:
        now = log.time_of(batch_id, self.now())
        seen = Observation("pages")
        kinds = ("node", "error", "failure", "broken", "empty")
        parsed = self.step("parsed", parsed_pages(pages, responses=self.responses).observe(
            seen, *[F.count_if(F.col("kind") == k).alias(k) for k in kinds]))
        repos = self.step("candidates", self.candidates(log, parsed, now))
        enriched = enrich_users(repos, self.profiles, self.weeks, self.rules)
        repositories = self.step("repositories", enriched.repositories)
        users = self.step("users", enriched.users)
        messages = self.step("messages", self.analyse(Developers(users, repositories)))
        grades = self.step("grades", grade(messages, self.catalog).withColumnRenamed("repo_id", "raw_id"))
        tables = {"rejected": parsed.filter(F.col("kind").isin("error", "failure", "broken")).select(
            "kind", "text")}
        if not grades.isEmpty():
            technologies = self.step("technologies", dependencies_of(messages).select(
                F.col("repo_id").alias("raw_id"), "language", "technology"))
            known = users.withColumnsRenamed({"owner_id": "user_id", "owner_login": "login"})
            batch = Batch(
                users=known,
                repositories=repositories.select(
                    F.col("owner_id").alias("user_id"), F.col("repo_id").alias("raw_id"),
                    "primary_language", "languages"),
                grades=grades,
                technologies=technologies,
                locations=resolve_location(
                    known.filter("location IS NOT NULL"), ["user_id"], "location", self.gazetteer),
            )
            tables |= {table: rows(batch, now) for table, rows in ROWS.items()}
        for table, rows in tables.items():
            self.append(table, rows, batch_id)
        log.commit(batch_id, tables, seen.get)

    def candidates(self, log: Commits, parsed: DataFrame, now: Column) -> DataFrame:
        """Candidates that no committed batch has analysed lately.

        Folders that are all older, or hold none of the candidates, are not opened. Any stored change
        tells when a repository was analysed, so nothing has to be merged.
        """
        found = self.step("found", found_candidates(parsed.filter("kind = 'node'").select("node"), self.rules))
        as_of = now.cast("date")
        first = F.date_sub(as_of, self.rules.reanalyse_after_days - 1).cast("timestamp")
        since = found.sparkSession.range(1).select(F.unix_micros(first).alias("t")).first()["t"]
        analysed = log.read("repositories", TABLES["repositories"], since=since, bits=id_bits(found, "repo_id"))
        return fresh_candidates(found, analysed, self.rules, as_of)

    def append(self, table: str, rows: DataFrame, batch_id: int) -> None:
        append_changes(rows, self.root, table, batch_id)

    def step(self, name: str, df: DataFrame) -> DataFrame:
        """Store an intermediate result next to the tables; each batch replaces the last one's."""
        return settle(df, name, f"{self.root}-work/{name}")


def run_stream(pages: DataFrame, job: DeveloperJob, checkpoint: str,
               interval: str | None = "5 seconds") -> StreamingQuery:
    """Search pages in, stored tables out."""
    return run_batches(pages, job, checkpoint, interval)
