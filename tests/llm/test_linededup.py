import random

from pyspark.sql import functions as F

from tidelog.llm import common, linededup


def brute(rows, window=3):
    seen, out = set(), {}
    gone = {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone[doc] = set()
        for i in range(len(full) - window + 1):
            key = tuple(lines[j].strip(" ") for j in full[i : i + window])
            if key in seen:
                gone[doc].update(range(full[i], full[i + window - 1] + 1))
            seen.add(key)
    for doc, text in rows:
        lines = text.split("\n")
        out[doc] = ("\n".join(x for i, x in enumerate(lines) if i not in gone[doc]), len(lines), len(gone[doc]))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    blocks = [[rng.choice(["a", "b", " c ", "d", "", "  ", "é", "f g"]) for _ in range(rng.randint(1, 9))] for _ in range(40)]
    rows = [(i, "\n".join(x for _ in range(rng.randint(0, 6)) for x in rng.choice(blocks))) for i in range(150)]
    rows.append((500, "\n".join(["same"] * 3000)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(df).collect()}
    assert got == brute(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    text = "one\ntwo\nthree\nfour"
    rows = [(1, text), (1, text), (2, "x\n" + text + "\ny"), (3, None), (4, ""), (None, "two\nthree\nfour")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("doc", "hash", "i", "runs", "n_lines", "low"):
        df = df.withColumn(c, F.lit("clash"))
    got = linededup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "doc", "hash", "i", "runs", "low", "n_lines", "n_removed"]
    rows = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=lambda r: r[0])
    assert rows == [(0, "two\nthree\nfour", 3, 0), (1, "one", 4, 3), (1, "one", 4, 3), (2, "x\ny", 6, 4), (3, None, 0, 0), (4, "", 1, 0)]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_hot_lines_and_other_window_sizes(spark):
    rng = random.Random(12)
    rows = [(i, "\n".join(rng.choice(["hot", "hot", f"l{rng.randrange(40)}"]) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (1, 2, 4):
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(df, window).collect()}
        assert got == brute(rows, window)


def test_small_tables_are_joined_like_large_ones(spark, monkeypatch):
    plans, write = [], common.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(common, "written", written)
    rows = [(i, "\n".join(["one", "two", "three", f"own {i}"])) for i in range(20)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert got == brute(rows)
    plans = [p for p in plans if "Join" in p]
    assert len(plans) == 3 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
