"""Line tables: searches within k lines when lines are rows and a file may be of any length."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import evidence, masked, lines_of


def explode_lines(files: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """One row per line, numbered from 1."""
    out = files.select(*keys, "path", F.posexplode(lines_of(F.col("text"))).alias("_pos", "line"))
    return out.select(*keys, "path", (F.col("_pos") + 1).alias("line_no"), "line")


def _block(line_no: Column, size: int) -> Column:
    return F.floor(line_no / F.lit(size)).cast("int")


def _blocks_in_reach(line_no: Column, k: int, size: int) -> Column:
    """Every block that holds a line within k of this one: its own and, near an edge, the next."""
    return F.explode(F.sequence(_block(line_no - k, size), _block(line_no + k, size)))


def near_by_window(
    lines: DataFrame, keys: Sequence[str], flags: Mapping[str, tuple[Column, int]], keep: Column | None = None,
    block: int = 4096,
) -> DataFrame:
    """Adds `near_<name>`: does any line within k hold the flag? One exchange serves all flags.

    Files are cut into blocks of `block` lines. A line near the edge is copied into the next block
    too, so every window finds its lines in one block and no task holds more than
    block + 2k lines of a file. `keep` chooses the lines to return; all others only serve as context.
    """
    reach = max(k for _, k in flags.values())
    held = lines.withColumns(
        {f"_{name}": flag.cast("int") for name, (flag, _) in flags.items()}
        | {"_keep": F.lit(True) if keep is None else keep}
    )
    # A context line that carries no flag cannot change a result, so it gets no block and drops out
    # here. (As a filter this test would be pushed down and match every pattern a second time.)
    matters = F.col("_keep")
    for name in flags:
        matters = matters | (F.col(f"_{name}") == 1)
    blocks = F.sequence(_block(F.col("line_no") - reach, block), _block(F.col("line_no") + reach, block))
    held = held.withColumn("_block", F.explode(F.when(matters, blocks)))
    part = W.partitionBy(*keys, "path", "_block").orderBy("line_no")
    for name, (_, k) in flags.items():
        held = held.withColumn(
            f"near_{name}", F.coalesce(F.max(f"_{name}").over(part.rangeBetween(-k, k)), F.lit(0)) == 1
        )
    own = (F.col("_block") == _block(F.col("line_no"), block)) & F.col("_keep")
    return held.filter(own).drop("_block", "_keep", *[f"_{name}" for name in flags])


def far_from(
    findings: DataFrame, hits: DataFrame, keys: Sequence[str], k: int, block: int = 256
) -> DataFrame:
    """Findings with no hit line within k lines in the same file (band anti join).

    Files are cut into blocks again. The hit lines of a block, at most block + 2k numbers, become one
    row, combined on the map side, so a finding meets exactly one row of an equi join on
    (keys, path, block) and no pairs are formed. The aggregation and the join share one exchange.
    """
    on = [*keys, "path", "_block"]
    left = findings.withColumn("_block", _block(F.col("line_no"), block)).alias("f")
    right = (
        hits.select(*keys, "path", "line_no", _blocks_in_reach(F.col("line_no"), k, block).alias("_block"))
        .groupBy(*on).agg(F.collect_set("line_no").alias("_hits")).alias("h")
    )
    cond = F.exists(F.col("h._hits"), lambda hit: F.abs(hit - F.col("f.line_no")) <= k)
    for c in on:
        cond = cond & (F.col(f"f.{c}") == F.col(f"h.{c}"))
    return left.join(right, cond, "left_anti").drop("_block")


def in_files(findings: DataFrame, files: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Findings whose file is present; the others are skipped without an error.

    `files` may be a line table: its (keys, path) are made distinct on the map side first.
    """
    return findings.join(files.select(*keys, "path").distinct(), [*keys, "path"], "left_semi")


def with_evidence(
    findings: DataFrame, lines: DataFrame, keys: Sequence[str] = ("project_id",), limit: int | None = None
) -> DataFrame:
    """Evidence looked up in a line table; '' when the line does not exist. Values of secrets are blanked out."""
    found = lines.select(*keys, "path", "line_no", F.col("line").alias("_line"))
    line = F.when(F.col("rule") == "secret", masked(F.col("_line"))).otherwise(F.col("_line"))
    return (
        findings.drop("evidence").join(found, [*keys, "path", "line_no"], "left")
        .withColumn("evidence", F.coalesce(evidence(line, limit), F.lit(""))).drop("_line")
    )
