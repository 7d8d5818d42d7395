"""Column functions over repository paths and remotes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Files that are inputs of the build, whatever their ending.
BUILD_FILES = ("go.mod", "go.sum", "go.work", "go.work.sum")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_build_file(path: Column) -> Column:
    return basename(path).isin(*BUILD_FILES)


def is_eligible(path: Column) -> Column:
    """Whether the analysis reads a path: source files and build files."""
    return path.endswith(".go") | is_build_file(path)


def is_wide_change(path: Column) -> Column:
    """Whether a changed path can change everything: build files and the vendor tree."""
    return is_build_file(path) | path.rlike(r"(^|/)vendor/")


def clean_path(path: Column) -> Column:
    """The path without empty, ``.`` and ``..`` segments; null if it is empty, absolute, has NUL or leaves its root."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    segments = F.filter(F.split(slashed, "/", -1), lambda s: (s != "") & (s != "."))
    # ``..`` takes the last segment away; below the root it marks the path as escaped.
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(state, s):
        up, kept = s == "..", state["kept"]
        below = up & (F.size(kept) == 0)
        rest = F.when(up & (F.size(kept) > 0), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(up, kept).otherwise(F.concat(kept, F.array(s)))
        return F.struct(rest.alias("kept"), (state["out"] | below).alias("out"))

    folded = F.aggregate(segments, start, step)
    bad = path.isNull() | slashed.startswith("/") | F.contains(path, F.lit("\x00")) | folded["out"] | (F.size(folded["kept"]) == 0)
    return F.when(~bad, F.array_join(folded["kept"], "/"))


def escapes(path: Column) -> Column:
    """Whether a path is absolute or leaves its root; false for a missing one, for the root itself and for ``a/..``."""
    segments = F.filter(F.split(path, "/", -1), lambda s: (s != "") & (s != "."))

    def step(state, s):
        depth = F.when(s == "..", state["depth"] - 1).otherwise(state["depth"] + 1)
        return F.struct(depth.alias("depth"), (state["out"] | (depth < 0)).alias("out"))

    folded = F.aggregate(segments, F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out")), step)
    return F.coalesce(path.startswith("/") | folded["out"], F.lit(False))


def canonical_remote(url: Column) -> Column:
    """host[:port]/path of a remote: scp form or with a scheme, lower-case host, no user, no ``.git``, no query; file URLs keep their path."""
    u = F.trim(url)
    scp = F.when(~F.contains(u, F.lit("://")), F.regexp_replace(u, r"^(?:[^@/]+@)?([^:/]+):/?(.*)$", "ssh://$1/$2")).otherwise(u)
    host = F.lower(F.regexp_extract(scp, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(scp, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.git$", "")
    return F.when(path == "", host).otherwise(F.concat_ws("/", host, path))


def repository_id(identity: Column) -> Column:
    return F.concat(F.lit("repo-"), F.sha2(identity, 256))
