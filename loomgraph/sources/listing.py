"""Parsers of tree listings and of working-tree statuses, and identities of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.paths import clean_path

_ENTRY = r"^(\d{6}) (\w+) ([0-9a-f]+) +(-|\d+)\t(.+)$"


def tree_manifest(raw: DataFrame) -> DataFrame:
    """raw: id, listing (NUL-delimited ``mode type object size<TAB>path``). id, path, blob_sha, mode, size. A listing with a malformed entry, a submodule or an unsafe path is an error."""
    lines = raw.select("id", F.explode(F.split("listing", "\x00", -1)).alias("line")).where("line <> ''")
    part = lambda k: F.regexp_extract("line", _ENTRY, k)
    rows = lines.select("id", "line", part(1).alias("mode"), part(2).alias("type"), part(3).alias("blob_sha"), part(4).alias("size"), part(5).alias("path"))
    said = (
        F.when(F.col("path") == "", "malformed tree entry ").when((F.col("type") == "commit") | (F.col("mode") == "160000"), "unsupported submodule at ")
        .when(F.col("type") != "blob", "unsupported tree object ").when(F.col("path").startswith("/") | F.coalesce(clean_path(F.col("path")) == "", F.lit(True)), "unsafe tree path ")
    )
    checked = rows.withColumn("path", F.when(said.isNull(), F.col("path")).otherwise(F.raise_error(F.concat(said, "line"))))
    return checked.select("id", "path", "blob_sha", "mode", F.coalesce(F.expr("try_cast(size as bigint)"), F.lit(0).cast("long")).alias("size"))


def parse_status(listing: str) -> list[tuple[str, str, str, str, str, int]]:
    """index, worktree, kind, old path, new path, tracked of each entry.

    Of the two status bytes a rename or copy counts first, then an addition, a deletion, and a change of type. A renamed
    or copied path takes the next token as its old one; ``!!`` is skipped. A malformed record is an error.
    """
    out, tokens = [], iter(listing.split("\0"))
    for token in tokens:
        if not token:
            continue
        if len(token) < 4 or token[2] != " ":
            raise ValueError(f"malformed status record {token!r}")
        both, path = token[:2], token[3:]
        if both == "!!":
            continue
        old, new, kind = path, path, "modified"
        if both == "??" or not set(both) & set("RC") and "A" in both:
            old, kind = "", "added"
        elif set(both) & set("RC"):
            kind, old = "copied" if "C" in both else "renamed", next(tokens, "")
            if not old:
                raise ValueError(f"status record {token!r} has no original path")
        elif "D" in both:
            new, kind = "", "deleted"
        elif set(both) & set("TU"):
            kind = "type_changed"
        out.append((both[0], both[1], kind, old, new, int(both != "??")))
    return out


def worktree_status(raw: DataFrame) -> DataFrame:
    """raw: id, listing. Entries span tokens, so each listing is parsed as one text, in Arrow batches."""
    import pandas as pd

    schema = "id string, index_status string, worktree_status string, kind string, old_path string, new_path string, tracked long"

    def parsed(batches):
        for batch in batches:
            rows = [(i, *entry) for i, text in zip(batch["id"], batch["listing"], strict=True) for entry in parse_status(text or "")]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return raw.select("id", "listing").mapInPandas(parsed, schema)


def file_identity(files: DataFrame) -> DataFrame:
    """files: path, content (binary), executable (0/1). path, sha256, mode; paths that leave the tree are left out."""
    mode = F.when(F.col("executable") == 1, "100755").otherwise("100644")
    return files.where(clean_path(F.col("path")) == F.col("path")).select("path", F.sha2("content", 256).alias("sha256"), mode.alias("mode"), F.octet_length("content").cast("long").alias("size"))
