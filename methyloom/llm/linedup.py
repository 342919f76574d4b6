"""Removal of repeated line runs by distributed prefix doubling over line ids.

The corpus is one sequence of line ids (64-bit hashes), documents in order of doc_id, each ended by
a mark of its own, so no run crosses documents. A position's name at level k stands for the run of
2**k lines that begins there: the name at level k + 1 is the hash of two names 2**k apart. Positions
of one name are one interval of the suffix order whose longest common prefix is 2**k lines or more;
the interval's first member in corpus order is the original. Positions whose name is unique drop out,
and rounds go on until nothing repeats; each works on what still does. Names stand for ranks: they
tell intervals apart, which is all that is read from the suffix order.

**Maximal runs.** For every position the largest level is kept at which its run also begins earlier in
the corpus (in the same document too, overlaps included). A maximal run of m lines with an earlier
copy is the union of two runs of the largest level with 2**k <= m, one at its start and one at its
end, and both begin earlier too; so the union of the runs of largest levels is exactly that of all
later copies of maximal runs, and those lines go. A run counts from ``min_lines`` lines on. A single
line of ``LINE_WORDS`` words or ``LINE_BYTES`` bytes is a run too (bytes for texts that do not part
words by spaces); blank, short and stock lines need a neighbour that repeats with them.

A very common line is not gathered in one task: the few names that hold more than a thousandth of
all positions are joined by broadcast.

Null texts stay null and have no lines. An empty text has one empty line. Rows with the same doc_id
and text are one place in the corpus and get the same result; rows with the same doc_id and other
texts are ordered by the texts' hashes. A null doc_id comes first. All built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_key_values

MIN_LINES = 2
LINE_WORDS, LINE_BYTES = 25, 200  # from either, one line alone is a run


def _places(docs: DataFrame) -> DataFrame:
    """Every line's place (struct of doc_id, text hash, line number), the hash of the line, and whether
    it is a run by itself."""
    lines = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("line", "value"))
    alone = (F.octet_length("value") >= LINE_BYTES) | (F.size(F.split(F.trim("value"), r"\s+")) >= LINE_WORDS)
    return lines.select(F.struct("doc_id", "th", "line").alias("p"), F.xxhash64("value").alias("name"), alone.alias("alone"))


def _repeated(named: DataFrame, total: int) -> DataFrame:
    """Places whose name stands at another place too, with the first of those places."""
    classes = named.groupBy("name").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.count(F.lit(1)).alias("c")).filter("first <> last")
    return with_key_values(named, classes.select("name", "first", "c"), "name", "c", total).drop("c")


def _ahead(active: DataFrame, by: int) -> DataFrame:
    """Names of two runs ``by`` lines apart in the same text, as one."""
    key = lambda shift: [F.xxhash64("p.doc_id", "p.th", F.col("p.line") - shift).alias("key"), F.col("p")]
    one = active.select(*key(0), "name")
    two = active.select(key(by)[0], F.col("name").alias("name2"), F.col("p").alias("p2"))
    same = (F.col("p.doc_id").eqNullSafe(F.col("p2.doc_id"))) & (F.col("p.th") == F.col("p2.th")) & (F.col("p.line") + by == F.col("p2.line"))
    return one.join(two, "key").filter(same).select("p", F.xxhash64("name", "name2").alias("name")).distinct()


def intervals(docs: DataFrame, min_lines: int = MIN_LINES) -> list[tuple[int, DataFrame]]:
    """For each length (1, 2, 4, ... and ``min_lines``) the stored table of the places (p, name, first and,
    for single lines, alone) whose run of that many lines begins elsewhere too, doubling until
    nothing repeats."""
    total = docs.select(F.sum(F.size(F.split("text", "\n")))).first()[0] or 0
    active, reach = stored(_repeated(_places(docs), total), "lines"), 1
    found = [(reach, active)]
    while (total := active.count()):
        if reach < min_lines < 2 * reach:
            found.append((min_lines, stored(_repeated(_ahead(active, min_lines - reach), total), "lines")))
        active, reach = stored(_repeated(_ahead(active, reach), total), "lines"), 2 * reach
        found.append((reach, active))
    return found


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """p and size: for every place where a run with an earlier copy begins, the largest of the lengths
    of :func:`intervals` for which that holds."""
    out = None
    for size, table in intervals(docs, min_lines):
        later = table.filter("p <> first" if size >= min_lines else "p <> first and alone" if size == 1 else "false")
        later = later.select("p", F.lit(size).alias("size"))
        out = later if out is None else out.unionByName(later)
    return out.groupBy("p").agg(F.max("size").alias("size"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with ``text`` left without later copies of line runs, and the columns n_lines,
    n_removed, n_runs (stretches of removed lines) and longest_run (the longest of these)."""
    more = ["n_lines", "n_removed", "n_runs", "longest_run"]
    own = [c for c in docs.columns if c not in more]
    rest = [F.col(f"`{c}`") for c in own if c not in ("doc_id", "text")]  # kept apart, whatever their names
    later = later_copies(docs.select("doc_id", "text"), min_lines)
    gone = later.select("p.doc_id", "p.th", F.explode(F.sequence(F.col("p.line"), F.col("p.line") + F.col("size") - 1)).alias("line"))
    gone = gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("_gone")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "_gone")
    rows = docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_none")).alias("_rest"), F.xxhash64("text").alias("_h"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")), "left")
    gap = F.expr("transform(_gone, (x, i) -> x - if(i = 0, -1, _gone[i - 1]) - 1)")
    rows = rows.withColumn("_lines", F.split("text", "\n")).withColumn("_gaps", gap)
    keep = F.expr("concat(flatten(transform(_gaps, g -> concat(array_repeat(true, g), array(false)))), array_repeat(true, size(_lines) - 1 - element_at(_gone, -1)))")
    kept = F.expr("transform(filter(arrays_zip(_lines, _keep), z -> z._keep), z -> z._lines)")
    starts = F.expr("filter(_gone, (x, i) -> i = 0 or x <> _gone[i - 1] + 1)")
    ends = F.expr("filter(_gone, (x, i) -> i = size(_gone) - 1 or _gone[i + 1] <> x + 1)")
    rows = rows.withColumn("_keep", keep).withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long"),
        "n_removed": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"),
        "n_runs": F.when(F.col("_gone").isNull(), 0).otherwise(F.size(starts)).cast("long"),
        "longest_run": F.coalesce(F.array_max(F.zip_with(ends, starts, lambda b, a: b - a + 1)), F.lit(0)).cast("long"),
    })
    rows = rows.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`") for c in own], *more)


def digests(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


#: The same by plain SQL: lines that lie in a run of two lines with an earlier place, or that are long
#: and stand at an earlier place.
DIGEST_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS n
           FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT doc_id, n, line, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS line2 FROM l),
numbered AS (SELECT doc_id, n, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, n) AS place FROM pairs WHERE line2 IS NOT NULL),
alone AS (SELECT doc_id, n, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS place FROM l
          WHERE octet_length(encode(line)) >= 200 OR len(regexp_split_to_array(trim(line, ' '), '[ \t\n\x0B\f\r]+')) >= 25),
gone AS (SELECT DISTINCT doc_id, n + k AS n FROM numbered, (SELECT 0 AS k UNION ALL SELECT 1) WHERE place > 1
         UNION SELECT doc_id, n FROM alone WHERE place > 1),
marked AS (SELECT l.doc_id, l.n, l.line, g.n IS NOT NULL AS gone FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.n = l.n),
runs AS (SELECT doc_id, grp, count(*) AS size FROM (SELECT doc_id, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM gone) GROUP BY 1, 2),
per_run AS (SELECT doc_id, count(*) AS n_runs, max(size) AS longest_run FROM runs GROUP BY 1),
per_doc AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                   coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(p.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(p.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(r.n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(r.longest_run, 0) AS BIGINT) AS longest_run,
       sha256(coalesce(p.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per_doc p USING (doc_id) LEFT JOIN per_run r USING (doc_id)
"""
