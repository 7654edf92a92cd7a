"""Repository addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .text import trimmed


def repository(url: Column, branch: Column | None = None) -> Column:
    """An address as struct(owner, repo, branch, display_name, error); `error` is null when it is usable.

    An explicit branch wins over one named in the address.
    """
    branch = F.lit(None).cast("string") if branch is None else branch
    clean = F.regexp_replace(trimmed(F.coalesce(url, F.lit(""))), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r";[^/]*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    owner, repo = part(1), F.regexp_replace(part(2), r"\.git$", "")
    in_tree = (F.size(parts) >= 4) & (part(3) == "tree")
    from_url = F.when(in_tree, F.array_join(F.slice(parts, 4, 1_000_000), "/"))
    chosen = F.nullif(trimmed(F.coalesce(F.nullif(branch, F.lit("")), from_url, F.lit(""))), F.lit(""))
    bad = lambda name: ~name.rlike(fv.REPOSITORY_NAME_PATTERN)
    error = (
        F.when(clean == "", fv.REPOSITORY_ERRORS["missing"])
        .when((scheme != "https") | (host != fv.REPOSITORY_HOST), fv.REPOSITORY_ERRORS["host"])
        .when(F.size(parts) < 2, fv.REPOSITORY_ERRORS["parts"])
        .when(bad(owner) | bad(repo), fv.REPOSITORY_ERRORS["characters"])
        .when((F.size(parts) > 2) & ~in_tree, fv.REPOSITORY_ERRORS["path"])
        .when(chosen.contains("..") | chosen.startswith("/"), fv.REPOSITORY_ERRORS["branch"])
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, owner).alias("owner"), F.when(ok, repo).alias("repo"), F.when(ok, chosen).alias("branch"),
        F.when(ok, F.concat_ws("/", owner, repo)).alias("display_name"), error.alias("error"),
    )
