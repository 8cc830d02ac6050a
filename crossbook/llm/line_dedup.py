"""Cross-site line removal by distinct-site spread, in DataFrame functions only.

Each line's sites (the ``source`` column) go into a HyperLogLog sketch per
line hash; sketches merge by aggregation, so a hot line is reduced before the
shuffle. Lines whose estimate is clearly over the threshold are boilerplate;
lines within the sketch's error of it get an exact distinct count. A
boilerplate line leaves every document but the first (smallest doc_id) that
holds it, so text that many sites copy stays once.

Defined cases: a null text stays null and has no lines; empty lines are never
boilerplate; a null source is no site, an empty one is; a null doc_id comes after all others
when the first document of a line is chosen; repeated rows share one decision;
an empty table stays empty. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossbook.llm.common import checkpointed, join_small, row_columns, whole_rows

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers, and the relative margin around the threshold
#: that is counted exactly (over four standard errors of 1.04 / 2 ** 6).
SKETCH_BITS = 12
MARGIN = 0.1


def _row_key(text_col: str):
    """128 bits that stand for (doc_id, text)."""
    return [F.xxhash64("doc_id", text_col).alias("_k1"),
            F.xxhash64(F.lit(1), text_col, "doc_id").alias("_k2")]


#: The 128 bits that stand for a line.
LINE = ["_l1", "_l2"]


def _line_key(line_col: str):
    return [F.xxhash64(line_col).alias("_l1"), F.xxhash64(F.lit(1), line_col).alias("_l2")]


def document_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per non-empty line: document key, doc_id, source, line number, line key."""
    split = docs.where(F.col(text_col).isNotNull()).select(
        *_row_key(text_col), "doc_id", "source",
        F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return split.where("line <> ''").select(
        "_k1", "_k2", "doc_id", "source", "line_no", *_line_key("line"))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, int]:
    """The lines that stand on ``min_sites`` or more sites, by key, with their
    first document; and a bound on how many there are."""
    # an empty string is a site, which a sketch alone would not count
    site = F.concat(F.lit("="), F.col("source").cast("string"))
    spread = lines.groupBy(*LINE).agg(
        F.hll_sketch_agg(site, F.lit(SKETCH_BITS)).alias("sketch"),
        F.min("doc_id").alias("first_doc"))
    estimated = spread.select(*LINE, "first_doc", F.hll_sketch_estimate("sketch").alias("sites"))
    # written first (few lines): joins with it can split a very common line
    candidates = checkpointed(estimated.where(F.col("sites") >= min_sites * (1 - MARGIN)))
    count = candidates.count()
    sure = candidates.where(F.col("sites") > min_sites * (1 + MARGIN)).select(*LINE, "first_doc")
    near = candidates.where(F.col("sites") <= min_sites * (1 + MARGIN)).select(*LINE, "first_doc")
    exact = (join_small(lines.select(*LINE, "source"), near, count, LINE, "inner")
             .groupBy(*LINE, "first_doc").agg(F.countDistinct("source").alias("sites"))
             .where(F.col("sites") >= min_sites).select(*LINE, "first_doc"))
    return sure.unionByName(exact), count


def removed_lines(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text") -> DataFrame:
    """Per document key, the numbers of the lines to remove."""
    lines = document_lines(docs, text_col)
    bad, count = boilerplate_lines(lines, min_sites)
    return (join_small(lines, bad, count, LINE, "inner")
            .where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
            .groupBy("_k1", "_k2").agg(F.collect_set("line_no").alias("_removed")))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text") -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text_col``, plus n_lines
    and n_removed (bigint, 0 for a null text)."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    removed = removed_lines(docs, min_sites, text_col)
    keyed = whole_rows(docs, *_row_key(text_col))
    old = F.col("row").getField(text_col)
    lines = F.split(old, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_removed"))
    text = F.when(F.col("_removed").isNull(), old).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n"))
    out = keyed.join(removed, ["_k1", "_k2"], "left")
    return out.select(
        *row_columns(columns, **{text_col: text}),
        F.when(old.isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed")).cast("bigint").alias("n_removed"))


#: The same rows in SQL, over the whole of ``documents``.
LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents WHERE text IS NOT NULL),
spread AS (
  SELECT line, min(doc_id) AS first_doc FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT l.doc_id, l.text, l.line_no, l.line,
         (s.line IS NOT NULL AND l.doc_id IS DISTINCT FROM s.first_doc) AS gone
  FROM lines l LEFT JOIN spread s ON l.line = s.line),
rebuilt AS (
  SELECT doc_id, text, count(DISTINCT line_no) AS n_lines,
         count(DISTINCT CASE WHEN gone THEN line_no END) AS n_removed,
         array_to_string([x.t FOR x IN list_sort(list(DISTINCT struct_pack(n := line_no, t := line))
           FILTER (WHERE NOT gone))], chr(10)) AS kept
  FROM marked GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed,
       CAST(length(r.kept) AS BIGINT) AS n_chars_kept, md5(r.kept) AS kept_md5
FROM documents d LEFT JOIN rebuilt r
  ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND d.text = r.text
"""
