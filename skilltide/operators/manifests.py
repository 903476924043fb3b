"""Package manifests: dependencies, origin and vendored folders."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import MANIFEST_PATTERN

DEPENDENCIES = "dependencies MAP<STRING, STRING>, devDependencies MAP<STRING, STRING>"
SCRIPTS = "scripts MAP<STRING, STRING>"
REPO = ("repo_id", "repo_name")


def folder(path: Column) -> Column:
    """Path without its last part, '' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_manifest(path: Column) -> Column:
    return path.rlike(MANIFEST_PATTERN)


def manifest_url(content: Column) -> Column:
    """Address of the repository stated in a manifest."""
    return F.get_json_object(content, "$.repository.url")


def _dependency_names(parsed: Column) -> Column:
    empty = F.array().cast("array<string>")
    names = F.concat(
        F.coalesce(F.map_keys(parsed.getField("dependencies")), empty),
        F.coalesce(F.map_keys(parsed.getField("devDependencies")), empty),
    )
    return F.filter(names, lambda n: ~F.startswith(n, F.lit("@")))


def _runs_node(parsed: Column) -> Column:
    scripts = F.map_values(parsed.getField("scripts"))
    return F.coalesce(F.exists(scripts, lambda s: F.startswith(s, F.lit("node "))), F.lit(False))


def package(content: Column) -> Column:
    """(dependencies, runs_node) of a manifest: the names in both dependency lists, without scoped ones, and
    whether a script starts Node.js.

    The parsed text is the item of a list of one: for each field taken from it directly it would be parsed anew.
    """
    parsed = F.array(F.from_json(content, f"{DEPENDENCIES}, {SCRIPTS}"))
    return F.get(F.transform(parsed, lambda p: F.struct(
        _dependency_names(p).alias("dependencies"), _runs_node(p).alias("runs_node"))), F.lit(0))


def manifests(facts: DataFrame) -> DataFrame:
    """Manifest files with their folder, stated address and dependencies."""
    return facts.filter("is_manifest").select(
        "repo_id", "repo_name", "login", "path", folder(F.col("path")).alias("dir"),
        F.col("manifest_url").alias("url"), "dependencies", "runs_node",
    )


def _path_order() -> Column:
    return F.struct(F.length("path"), F.col("path"))


def top_manifest_dirs(manifest_rows: DataFrame) -> DataFrame:
    """(repo_id, top_dir): folder of the manifest with the shortest path."""
    return manifest_rows.groupBy("repo_id").agg(F.min_by("dir", _path_order()).alias("top_dir"))


def manifest_origin_ok(manifest_rows: DataFrame) -> DataFrame:
    """Ids of repositories whose first stated address names the login and the repository.

    A repository without any address passes. Login and name are compared as text, not as patterns.
    """
    stated = (F.col("url") != "") & (F.col("url") != "null")
    first = manifest_rows.groupBy("repo_id", "repo_name", "login").agg(
        F.min_by("url", F.when(stated, _path_order())).alias("url")
    )
    name = F.concat(F.col("login"), F.lit("/"), F.col("repo_name"))
    named = F.contains("url", F.concat(F.lit(":"), name)) | F.contains(
        "url", F.concat(F.lit("/"), name))
    return first.filter(F.col("url").isNull() | named).select("repo_id")


def top_manifests(manifest_rows: DataFrame) -> DataFrame:
    """Manifests that lie in the top folder; the others belong to copied libraries."""
    top = top_manifest_dirs(manifest_rows).withColumnRenamed("top_dir", "dir")
    return manifest_rows.join(top, ["repo_id", "dir"], "left_semi")


def vendored_dirs(manifest_rows: DataFrame) -> DataFrame:
    """Distinct (repo_id, dir) of manifests outside the top folder."""
    top = top_manifest_dirs(manifest_rows).withColumnRenamed("top_dir", "dir")
    return manifest_rows.select("repo_id", "dir").join(
        top, ["repo_id", "dir"], "left_anti").distinct()


def drop_vendored(files: DataFrame, vendored: DataFrame) -> DataFrame:
    """Rows with repo_id and path that do not lie below a vendored folder (repo_id, dir).

    The folders of a repository are one array, which few repositories have, so a row is looked up by one
    join and never repeated. Folders below another vendored one are left out of it.
    """
    listed = vendored.groupBy("repo_id").agg(F.array_sort(F.collect_set("dir")).alias("_dirs"))
    # in order, a folder comes after those that hold it; its "/" sorts it before their later neighbours
    outer = F.aggregate(
        F.array_sort(F.transform("_dirs", lambda d: F.when(d == "", d).otherwise(F.concat(d, F.lit("/"))))),
        F.array().cast("array<string>"),
        lambda held, d: F.when((F.size(held) > 0) & F.startswith(d, F.element_at(held, -1)), held).otherwise(
            F.array_append(held, d)))
    folders = listed.select("repo_id", outer.alias("_dirs"))
    inside = F.exists("_dirs", lambda d: F.startswith(F.col("path"), d))
    return files.join(folders, "repo_id", "left").filter(~F.coalesce(inside, F.lit(False))).select(*files.columns)


def manifest_dependencies(manifest_rows: DataFrame) -> DataFrame:
    """(repository, dependency) per entry of the dependency lists."""
    # the outer form: for the inner one Spark tests the lists first, and parses each manifest again for it
    entries = F.explode_outer(F.transform("dependencies", lambda n: F.struct(n.alias("dependency"))))
    return manifest_rows.select(*REPO, entries.alias("_entry")).filter("_entry IS NOT NULL").select(
        *REPO, "_entry.dependency")


def uses_node(manifest_rows: DataFrame, shebang_repositories: DataFrame) -> DataFrame:
    """Distinct repositories that run Node.js, by a script or by a shebang line."""
    scripts = manifest_rows.filter("runs_node").select(*REPO)
    shebang = manifest_rows.select(*REPO).join(shebang_repositories, "repo_id", "left_semi")
    return scripts.unionByName(shebang).distinct()
