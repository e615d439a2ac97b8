"""File-name search over files on disk and members of archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

MEMBER_MARK = " ▶ "


def search_names(files: DataFrame, members: DataFrame, pattern: str, exact: bool = False) -> DataFrame:
    """Case-insensitive search: a file matches on its name, an archive
    member on its full member path; substring match, or equality with
    ``exact``. Returns ``found`` (file path, or ``<zip> ▶ <member>``) and
    ``kind``."""
    pat = pattern.lower()

    def hit(c):
        lc = F.lower(c)
        return (lc == pat) if exact else (F.instr(lc, pat) > 0)

    f = files.select(F.col("path").alias("found"), F.lit("file").alias("kind")) \
        .where(hit(P.basename("found")))
    m = members.where(hit(F.col("member"))).select(
        F.concat(F.col("zip_path"), F.lit(MEMBER_MARK), F.col("member")).alias("found"),
        F.lit("archive_member").alias("kind"))
    return f.unionByName(m)
