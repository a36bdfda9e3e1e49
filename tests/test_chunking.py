import random

from pyspark.sql import functions as F

from opsloom.functions import chunking as ch


def run(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", expr(F.col("s")).alias("o"))
    return [r["o"] for r in df.orderBy("i").collect()]


def test_sections_and_titles(spark):
    texts = [
        "# Uno\n\nTexto A\n\n## Dos\n\nTexto B", "intro\n# T\nbody", "no heading", "#\nNext line\nbody",
        "# Empty\n\n# Full\nx", "##### five\n#### Four\ny", "# only",
    ]
    got = [[(c["title"], c["content"]) for c in o] for o in run(spark, texts, ch.knowledge_chunks)]
    assert got == [
        [("Uno", "Texto A"), ("Dos", "Texto B")], [("T", "body")], [("Documento", "no heading")],
        [("Next line", "body")], [("Full", "x")], [("Four", "y")], [("Documento", "# only")],
    ]


def test_bare_mark_before_heading_is_one_heading(spark):
    got = run(spark, ["#\n# Real\nbody"], ch.knowledge_chunks)[0]
    assert [(c["title"], c["content"]) for c in got] == [("# Real", "body")]


def greedy(parts, joiner, limit, overlap):
    """Independent restatement: how far does each chunk reach?"""
    out, current = [], None
    for part in parts:
        if current is None:
            current = part
        elif len(current) + len(joiner) + len(part) <= limit:
            current = current + joiner + part
        else:
            out.append(current)
            current = (current[-overlap:] + "\n" + part).strip() if overlap else part
    return out + ([current] if current is not None else [])


def test_packing_matches_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        lines = ["w" * rng.randint(0, 60) + " " * rng.randint(0, 5) for _ in range(rng.randint(0, 25))]
        texts.append("\n".join(lines))
    for overlap in (0, 12):
        want = [greedy([p.strip() for p in t.split("\n") if p.strip()], "\n", 100, overlap) for t in texts]
        assert run(spark, texts, lambda c, o=overlap: ch.line_chunks(c, 100, o)) == want
    blank = [t.replace("\n", "\n\n") for t in texts]
    want = [greedy([p.strip() for p in t.split("\n\n") if p.strip()], "\n\n", 100, 0) for t in blank]
    assert run(spark, blank, lambda c: ch.paragraph_chunks(c, 100)) == want


def test_long_line_stays_whole(spark):
    assert run(spark, ["a" * 2000], ch.line_chunks) == [["a" * 2000]]
