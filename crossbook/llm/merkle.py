"""Merkle manifest of a dataset: one tree per source, one over the sources.

A row's leaf is the hash of its fields. Leaves of a source, by ascending
doc_id, are cut into runs of FAN consecutive nodes, each run hashed to its
parent, until one node remains (the source's subroot); the subroots, by
source, form the tree of the root in the same way.

Per level, lag and lead columns at the fixed offsets 1 .. FAN - 1 over the
nodes of a run supply siblings: a lag counts up to the node's slot, a lead up
to the run's length. A run's first child has all others as leads and hashes
the parent. Windows hold one run each, so a source with a third of all rows
is spread like any other. Leaves get their places from range-partitioned rows
with range totals added, so no task ever holds a whole source or all sources.

A proof is the siblings of each level up to the root; ``verify`` folds a leaf
over them.

Defined cases: a null field is written ``-``, so it differs from an empty
text; rows with a null doc_id come first in their source, ties of doc_id are
ordered by leaf, equal rows have a leaf each; a null source is a source of its
own and comes first; an empty table has no leaves and no root. A column that
is missing from the table counts as null, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossbook.llm.common import SMALL_ROWS, checkpointed

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digests travel as 32 bytes; hashes are of their hexadecimal text.
STEP = "struct<left:binary,right:binary>"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hex_text(digests: Column) -> Column:
    """One or more digests, one after the other, as hexadecimal text."""
    return F.lower(F.hex(digests))


def field_text(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return digest(F.concat(*[field_text(v) for v in fields.values()]))


def source_key(source: Column) -> Column:
    """A text that orders sources by their bytes, the null source first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 within the key, in the order) and ``n``
    (rows of the key). Rows are range-partitioned and written, counted per
    range and key, and get their key's earlier ranges added."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(rows.repartitionByRange(parts, key, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range", key).agg(F.count(F.lit(1)).alias("_c"))
    edges = checkpointed(counts.select(
        "_range", key, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy(key)).alias("n")))
    small = edges.count() <= SMALL_ROWS
    inside = Window.partitionBy("_range", key).orderBy(*order)
    return ranged.join(F.broadcast(edges) if small else edges, ["_range", key]).select(
        *rows.columns, (F.col("_before") + F.row_number().over(inside) - 1).alias("pos"), "n")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (key, pos, n, digest, ...) with ``left`` and ``right``: the
    digests before and after each in its run."""
    run = F.floor(F.col("pos") / FAN)
    slot = F.pmod(F.col("pos"), F.lit(FAN))
    length = F.least(F.lit(FAN).cast("bigint"), F.col("n") - run * FAN)
    order = Window.partitionBy("key", "run").orderBy("pos")
    offsets = range(1, FAN)
    beside = nodes.withColumn("run", run).select(
        "*", slot.alias("_slot"), length.alias("_length"),
        *[F.lag("digest", k).over(order).alias(f"_lag{k}") for k in offsets],
        *[F.lead("digest", k).over(order).alias(f"_lead{k}") for k in offsets])
    none = F.lit(b"")
    left = F.concat(*[F.when(F.col("_slot") >= k, F.col(f"_lag{k}")).otherwise(none) for k in reversed(offsets)])
    right = F.concat(*[F.when(F.col("_slot") + k < F.col("_length"), F.col(f"_lead{k}")).otherwise(none)
                       for k in offsets])
    return beside.select(*nodes.columns, "run", left.alias("left"), right.alias("right"))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: every run's first child hashes the run."""
    return with_siblings(nodes).where(F.pmod("pos", F.lit(FAN)) == 0).select(
        "key", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"),
        digest(hex_text(F.concat("digest", "right"))).alias("digest"))


def forest(leaves: DataFrame) -> list[DataFrame]:
    """Levels of the trees over ``leaves`` (key, pos, n, digest), from the
    parents of the leaves up; a tree whose node count reaches one has its root
    in that level and is in none above."""
    levels, level = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = checkpointed(parents(level.where("n > 1")))
        levels.append(level)
        most = -(-most // FAN)
    return levels


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(key, digest) of every tree."""
    out = leaves.where("n = 1").select("key", "digest")
    for level in levels:
        out = out.unionByName(level.where("n = 1").select("key", "digest"))
    return out


def paths_from(rows: DataFrame, above: DataFrame | None) -> DataFrame:
    """The path of trees' roots: that of ``above`` (key, path), or nothing."""
    if above is None:
        return rows.withColumn("path", F.array().cast(f"array<{STEP}>"))
    return rows.join(above, "key")


def under(nodes: DataFrame, parent_paths: DataFrame) -> DataFrame:
    """Nodes with their siblings put before the path of their parent."""
    up = parent_paths.select("key", F.col("pos").alias("run"), F.col("path").alias("_up"))
    return with_siblings(nodes).join(up, ["key", "run"]).select(
        *nodes.columns, F.concat(F.array(F.struct("left", "right")), "_up").alias("path"))


def proofs(leaves: DataFrame, levels: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """``leaves`` with ``path``: the siblings of each level up to the root of
    the tree, then the path that ``above`` (key, path) has for the tree."""
    path = None
    for level in reversed(levels):
        found = paths_from(level.where("n = 1"), above)
        if path is not None:
            found = found.unionByName(under(level.where("n > 1"), path))
        path = checkpointed(found.select("key", "pos", "path"))
    found = paths_from(leaves.where("n = 1"), above).select(*leaves.columns, "path")
    return found if path is None else found.unionByName(under(leaves.where("n > 1"), path))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(
        hex_text(F.concat(step["left"], node, step["right"]))))


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot, root, path and ``other`` (the
    leaf of the row with the columns ``altered``; null where it is the same)."""
    present = {f: F.col(f"`{f}`") if f in docs.columns else F.lit(None).cast("string") for f in FIELDS}
    other = leaf_digest(present | (altered or {}))
    leaf = leaf_digest(present)
    base = docs.select(
        present["doc_id"].cast("bigint").alias("doc_id"), present["source"].cast("string").alias("source"),
        source_key(present["source"]).alias("key"), leaf.alias("digest"), other.alias("_other"))
    written = checkpointed(base.select(
        "doc_id", "source", "key", "digest", F.when(F.col("_other") != F.col("digest"), F.col("_other")).alias("other"),
        F.monotonically_increasing_id().alias("_row")))
    # ties of doc_id and leaf are equal rows; _row only makes the order whole
    leaves = checkpointed(placed(written, "key", ["doc_id", "digest", "_row"]).drop("_row"))
    levels = forest(leaves)
    subroots = checkpointed(roots(leaves, levels))
    one = checkpointed(placed(subroots.select(F.lit("").alias("tree"), "key", "digest"), "tree", ["key"])
                       .select(F.col("key").alias("source_key"), F.col("tree").alias("key"), "pos", "n", "digest"))
    top = forest(one.select("key", "pos", "n", "digest"))
    root = roots(one, top).select("digest").first()
    root = F.lit(bytes(root[0]) if root else None).cast("binary")
    above = checkpointed(proofs(one, top).select(F.col("source_key").alias("key"), F.col("digest").alias("subroot"), "path"))
    out = proofs(leaves, levels, above.select("key", "path"))
    return join_sources(out, above.select("key", "subroot")).select(
        "doc_id", "source", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path", "other")


def join_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """A source's columns beside its rows. Few sources are sent to every task;
    of very many, Spark splits the partitions of large ones (skew join)."""
    few = sources.count() <= SMALL_ROWS
    return rows.join(F.broadcast(sources) if few else sources, "key")


def verify(rows: DataFrame) -> DataFrame:
    """``folded_root`` of each row of a manifest, from its altered leaf if it
    has one, and whether that is the root."""
    return rows.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path"))).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    joined = F.aggregate(path, F.lit(b""), lambda a, step: F.concat(a, step["left"], step["right"]))
    return digest(hex_text(joined))


#: Digest of every fifth text (by crc32 of the id) is taken with A-Z lower-cased.
TAMPERED_OF = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_text() -> Column:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_OF == 0
    text = F.col("text").cast("string")
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def digest_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, its proofs and its check against tampering, as hexadecimal digests."""
    rows = verify(manifest(docs, {"text": tampered_text()}))
    digests = {c: hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")}
    return rows.select("doc_id", digests["leaf"], digests["subroot"], digests["root"],
                       hex_text(proof_digest(F.col("path"))).alias("proof_sha256"), digests["folded_root"], "verified")


#: Levels that the SQL form unrolls: enough for FAN ** SQL_LEVELS rows of a source.
SQL_LEVELS = 5


def _sql_tree(prefix: str, leaves: str, levels: int) -> str:
    """CTEs of one tree: ``{prefix}l`` nodes by level, then the path of every leaf."""
    out = [f"{prefix}0 AS ({leaves})"]
    for i in range(1, levels + 1):
        out.append(f"""{prefix}{i} AS (
  SELECT key, pos // {FAN} AS pos, any_value((n + {FAN - 1}) // {FAN}) AS n,
         sha256(string_agg(digest, '' ORDER BY pos)) AS digest
  FROM {prefix}{i - 1} WHERE n > 1 GROUP BY key, pos // {FAN})""")
    for i in range(levels):
        out.append(f"""{prefix}s{i} AS (
  SELECT key, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {prefix}{i} WHERE n > 1 WINDOW w AS (PARTITION BY key, pos // {FAN} ORDER BY pos))""")
    steps = ", ".join(f"s{i}.l AS l{i}, s{i}.r AS r{i}" for i in range(levels))
    joins = " ".join(f"LEFT JOIN {prefix}s{i} s{i} ON s{i}.key = b.key AND s{i}.pos = b.pos // {FAN ** i}"
                     for i in range(levels))
    out.append(f"{prefix}path AS (SELECT b.key, b.pos, {steps} FROM {prefix}0 b {joins})")
    union = " UNION ALL ".join(f"SELECT key, digest FROM {prefix}{i} WHERE n = 1" for i in range(levels + 1))
    out.append(f"{prefix}root AS ({union})")
    return ",\n".join(out)


def merkle_sql() -> str:
    """The manifest in SQL: string aggregates over runs, levels unrolled."""
    def field(c):
        return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text):
        return f"sha256({' || '.join([*map(field, FIELDS[:-1]), field(text)])})"

    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    table = ("list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), "
             "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))")
    crc = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) "
           "FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), "
           "lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)")
    steps = [(f"p.l{i}", f"p.r{i}") for i in range(SQL_LEVELS)] + [(f"t.l{i}", f"t.r{i}") for i in range(SQL_LEVELS)]
    folds, last = [], "start"
    for i, (left, right) in enumerate(steps):
        folds.append(f"f{i} AS (SELECT * EXCLUDE (c), CASE WHEN l{i} IS NULL THEN c ELSE sha256(l{i} || c || r{i}) END AS c "
                     f"FROM {last})")
        last = f"f{i}"
    listed = ", ".join(f"{left} AS l{i}, {right} AS r{i}" for i, (left, right) in enumerate(steps))
    proof = " || ".join(f"coalesce(l{i} || r{i}, '')" for i in range(len(steps)))
    return f"""
WITH crc AS (SELECT {table} AS crc_table),
base AS (
  SELECT d.*, coalesce('s' || source, 'n') AS key, {leaf('text')} AS leaf,
         CASE WHEN ({crc}) % {TAMPERED_OF} = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS other
  FROM documents d, crc),
numbered AS (
  SELECT doc_id, key, leaf, other, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY key) AS n
  FROM base),
{_sql_tree('a', 'SELECT key, pos, n, leaf AS digest FROM numbered', SQL_LEVELS)},
{_sql_tree('b', "SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n, digest, key AS source_key FROM aroot", SQL_LEVELS)},
start AS (
  SELECT m.doc_id, m.leaf, s.digest AS subroot, (SELECT digest FROM broot) AS root, m.other AS c, {listed}
  FROM numbered m JOIN apath p ON p.key = m.key AND p.pos = m.pos
  JOIN b0 s ON s.source_key = m.key JOIN bpath t ON t.pos = s.pos),
{', '.join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, c AS folded_root, c = root AS verified
FROM {last}
"""
