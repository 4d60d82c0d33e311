import random

from pyspark.sql import functions as F

from matrixloom.llm import line_dedup as L


def plain(rows):
    first = {}
    for k, t in rows:
        lines = (t or "").split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if k is not None:
                first[w] = min(first.get(w, (k, i)), (k, i))
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        gone = {i + j for i in range(len(lines) - 2) if k is not None and first[tuple(lines[i : i + 3])] != (k, i) for j in range(3)}
        out.append((k, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=str)


def test_lines_equal_a_plain_loop(make):
    rng = random.Random(6)
    text = lambda: "\n".join(rng.choice(["a", "b", "c", "", "a longer line", "é"]) for _ in range(rng.randint(0, 12)))
    rows = [(k, text()) for k in range(80)] + [(None, "a\nb\nc"), (None, "a\nb\nc"), (200, None), (5, "a\nb\nc\nd"), (201, "x\n" * 50), (202, "x\n" * 50), (203, "\r\n\r\n\r\n")]
    docs = make(rows).withColumn("line", F.lit("clash")).withColumn("starts", F.lit(1)).withColumn("n_lines", F.lit("old"))
    out = L.line_dedup(docs)
    assert sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_removed", "kept_text").collect()), key=str) == plain(rows)
    assert out.columns[:7] == [*docs.columns[:5], "line", "starts"]
    assert L.line_dedup(docs.limit(0)).isEmpty()


def test_a_very_long_text(make):
    rows = [(1, "\n".join(f"line {k % 4000}" for k in range(9000))), (2, "one\ntwo")]
    docs = make(rows)
    assert sorted((tuple(r) for r in L.line_dedup(docs).select("doc_id", "n_lines", "n_removed", "kept_text").collect()), key=str) == plain(rows)
