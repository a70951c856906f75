"""Column functions over file names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import PRUNED_GLOBS, PRUNED_NAMES


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_path(path: Column) -> Column:
    """Everything before the last slash; ``''`` for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """From the last dot of the name on, case kept; ``''`` for dotfiles and bare names."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)


def repo_name(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty, else ``unknown``."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit("unknown"))


def without_zip(name: Column) -> Column:
    return F.regexp_replace(name, r"\.zip$", "")


def run_tag(repo: Column, iso_timestamp: Column) -> Column:
    """File-name-safe tag of a run."""
    safe_repo = F.regexp_replace(F.coalesce(F.nullif(repo, F.lit("")), F.lit("unknown")), "[^a-zA-Z0-9_-]", "_")
    return F.concat_ws("_", safe_repo, F.regexp_replace(iso_timestamp, "[:.]", "-"))


def is_pruned(relative_path: Column, names: list[str] | None = None) -> Column:
    """True when any segment below the walk's root is exactly a pruned name."""
    return F.arrays_overlap(
        F.split(relative_path, "/"), F.array(*[F.lit(n) for n in (names or PRUNED_NAMES)])
    )


def matches_pruned_glob(relative_path: Column, globs: list[str] | None = None) -> Column:
    hit = F.lit(False)
    for glob in globs or PRUNED_GLOBS:
        hit = hit | relative_path.like(glob.replace("*", "%").replace("_", r"\_"))
    return hit


def url_path(url: Column) -> Column:
    """Host and path of a URL: no scheme, query, fragment or trailing slash."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"/*([?#].*)?$", "")
