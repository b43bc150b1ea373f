"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A run of WINDOW or more lines that stood earlier, in a document with a smaller id or further up, is deleted. Of each window of
WINDOW consecutive lines the last least hash is chosen, and only chosen positions become rows: about half of all lines. Equal
windows choose the same place, so a run that repeats is sure to share a fingerprint. Fingerprints chosen at one position only
go; at the others the match is extended both ways, to the lines on either side that a window with this choice holds, and
windows that aren't the first with their lines are repeats. Those that overlap merge into the runs that are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import common

#: Lines of the shortest run that is deleted.
WINDOW = 3


def _split(text: str) -> F.Column:
    return F.split(F.col(text), "\n", -1)


def fingerprints(df: DataFrame, window: int) -> DataFrame:
    """doc, hash (of the text), at (place among the lines that aren't blank), mark (line hash) and begins of each chosen position.

    begins has an entry for each window of lines: its hashes if the window chose this position, else null. The first one ends here.
    """
    hashes = F.transform(F.filter(F.transform(_split("text"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x))
    near = range(1 - window, window)
    name = lambda k: f"h{k + window}"
    one = lambda i: F.struct(i.alias("at"), *[F.get("hashes", i + k).alias(name(k)) for k in near])
    rows = df.withColumn("hashes", hashes).where(F.size("hashes") >= window)
    rows = rows.select("doc", "hash", F.explode(F.transform(F.sequence(F.lit(0), F.size("hashes") - 1), one)).alias("p")).select("doc", "hash", "p.*")
    mark = F.col(name(0))
    chosen = []
    for first in near[:window]:
        test = F.lit(True)
        for k in range(first, first + window):
            side = F.col(name(k))
            test = test & (side.isNotNull() if k == 0 else side >= mark if k < 0 else side > mark)
        chosen.append(F.when(test, F.struct(*[F.col(name(k)).alias(f"k{k - first}") for k in range(first, first + window)])))
    rows = rows.select("doc", "hash", "at", mark.alias("mark"), *[c.alias(f"w{k}") for k, c in enumerate(chosen)])
    return rows.where(F.coalesce(*[F.col(f"w{k}") for k in range(window)]).isNotNull())


def repeated_runs(df: DataFrame, window: int) -> DataFrame:
    """doc, hash and the sorted runs (low, high: places from and to among the lines that aren't blank) that repeat earlier lines."""
    every = common.written(fingerprints(df, window), "fingerprints")
    place = F.xxhash64("doc", "hash", "at")
    # written, like what follows, so that joins are those of two plain shuffles, which can be split where a key is hot; the hints
    # keep them so on small tables, which would be broadcast, so that one plan holds at every size
    marks = common.written(every.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("mark"), "marks")
    begins = F.array(*[F.struct((F.col("at") - (window - 1 - k)).alias("i"), F.col(f"w{k}").alias("w")) for k in range(window)])
    held = every.join(marks.hint("merge"), "mark", "left_semi").select("doc", "hash", F.inline(F.filter(begins, lambda x: x["w"].isNotNull())))
    held = common.written(held.select("doc", "hash", "i", "w.*"), "held")
    common.release(every, marks)
    key = [f"k{k}" for k in range(window)]
    where = F.struct(F.col("doc"), F.col("hash"), F.col("i"))
    firsts = held.groupBy(*key).agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select(*key, "first")
    firsts = common.written(firsts, "firsts")
    later = held.join(firsts.hint("merge"), key).where(where > F.col("first")).select("doc", "hash", "i")
    order = Window.partitionBy("doc", "hash").orderBy("i")
    begins = F.when(F.col("i") - F.lag("i").over(order) < window, 0).otherwise(1)
    runs = later.distinct().withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    runs = runs.groupBy("doc", "hash", "run").agg(F.min("i").alias("low"), (F.max("i") + (window - 1)).alias("high"))
    runs = common.written(runs.groupBy("doc", "hash").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs")), "runs")
    common.release(held, firsts)
    return runs


def dedup_lines(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the text's repeated runs deleted, and n_lines and n_removed (lines before, and how many of them went).

    Lines count as equal if they are so without spaces at their ends; lines of spaces only are passed over when lines are
    compared, and go where they stand within a deleted run. The first occurrence by id, then line, stays; a null id comes
    before all others. Rows with one id and text count as one document, so they repeat nothing of each other. Documents of
    fewer than window lines that aren't blank, and repeats of fewer lines, are left alone. A null text
    stays null, with no lines; an empty text is one line. Other columns are passed on, and may have any name but those
    that start with two underscores here; an n_lines or n_removed of df's own is replaced. An empty table stays empty.
    """
    named = df.drop("n_lines", "n_removed").withColumn("__doc", F.col(id_col)).withColumn("__hash", F.xxhash64(text_col))
    runs = repeated_runs(named.select(F.col("__doc").alias("doc"), F.col("__hash").alias("hash"), F.col(text_col).alias("text")), window)
    runs = runs.select(F.col("doc").alias("__of"), F.col("hash").alias("__to"), F.col("runs").alias("__places"))
    joined = named.join(runs.hint("merge"), F.col("__doc").eqNullSafe(F.col("__of")) & (F.col("__hash") == F.col("__to")), "left")
    cut = joined.withColumn("__cut", F.when(F.col("__places").isNotNull(), _cut(text_col, "__places")))
    has = F.col("__cut").isNotNull()
    columns = [F.when(has, F.col("__cut.text")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in named.columns if not c.startswith("__")]
    return cut.select(*columns, F.coalesce(F.size(_split(text_col)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("__cut.removed", F.lit(0)).cast("long").alias("n_removed"))


def _let(value: F.Column, body) -> F.Column:
    """body(value), with the value computed once however often and wherever in a lambda the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _cut(text: str, places: str) -> F.Column:
    """text without the runs of lines at places, and how many lines these are. Linear in the text."""

    def without(lines, runs):
        end = lambda k: F.when(k == 0, 0).otherwise(F.get(runs, k - 1)["high"] + 1)
        start = lambda k: F.when(k == F.size(runs), F.size(lines)).otherwise(F.get(runs, k)["low"])
        kept = F.transform(F.sequence(F.lit(0), F.size(runs)), lambda k: F.slice(lines, end(k) + 1, start(k) - end(k)))
        removed = F.aggregate(runs, F.lit(0), lambda n, r: n + (r["high"] - r["low"] + 1))
        return F.struct(F.array_join(F.flatten(kept), "\n").alias("text"), removed.alias("removed"))

    def numbered(lines, full):
        runs = F.transform(places, lambda r: F.struct(F.get(full, r["low"]).alias("low"), F.get(full, r["high"]).alias("high")))
        return _let(runs, lambda runs: without(lines, runs))

    full = lambda lines: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.trim(F.get(lines, i)) != "")
    return _let(_split(text), lambda lines: _let(full(lines), lambda full: numbered(lines, full)))


ORACLE = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
full_lines AS (SELECT doc_id, ln, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS i FROM lines WHERE trim(line) <> ''),
win AS (SELECT doc_id, i, ln AS low, lead(ln, {WINDOW - 1}) OVER w AS high, list(line) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, low, high FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win WHERE high IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT l.doc_id, l.ln FROM lines l JOIN later r ON l.doc_id = r.doc_id AND l.ln BETWEEN r.low AND r.high)
SELECT d.doc_id, CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (WHERE g.ln IS NULL), '') END AS text, CAST(count(l.ln) AS BIGINT) AS n_lines, CAST(count(g.ln) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.ln = l.ln GROUP BY d.doc_id
"""
