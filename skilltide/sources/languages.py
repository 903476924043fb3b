"""Language of a file by its extension."""

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def extension(path: Column) -> Column:
    """Last extension of the file name with its dot, '' without one; leading dots do not count."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]*)$", 1)


def language_of_source(path: Column) -> Column:
    """``.c`` is C, any other file the C checker reports on is C++."""
    return F.when(F.replace(extension(path), F.lit(":"), F.lit("")) == ".c", "C").otherwise("C++")


SOURCE_EXTENSIONS = {
    ".c": "C",
    ".cpp": "C++", ".cxx": "C++", ".cc": "C++", ".c++": "C++",
    ".tpp": "C++", ".txx": "C++", ".ipp": "C++", ".ixx": "C++",
    ".js": "JavaScript",
}


def language_of(path: Column, extensions: Mapping[str, str] = SOURCE_EXTENSIONS) -> Column:
    """Language by extension, null for files no analyzer reads."""
    table = F.create_map(*[F.lit(x) for pair in extensions.items() for x in pair])
    return F.try_element_at(table, extension(path))
