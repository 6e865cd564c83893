"""The pipeline's stages on planted rows and on the smallest table."""

import numpy as np

import corpus_pipeline
from corvane.llm import common

LINE = "This line of the licence stands word for word in very many documents of the corpus."


def staged(spark, docs, sf_dir, upto):
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return docs


def test_stages_on_planted_rows(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = max((r.text for r in base.where("lang = 'en'").collect()), key=len)
    other = base.where("lang = 'en' AND length(text) BETWEEN 500 AND 900").first().text
    rows = [(9001, None), (9002, ""), (9003, "1234 !!"), (9004, other + "\n" + LINE), (9005, text.replace("e", "a") + "\n" + LINE), (9006, other + " Write to some.one@mail.example today."), (None, other[::-1])]
    more = spark.createDataFrame([(i, t, "en", "p", 0) for i, t in rows], base.schema)
    docs = base.unionByName(more)
    one = staged(spark, docs, sf_dir, 1)
    ids = {r.doc_id for r in one.select("doc_id").collect()}
    assert not ids & {9001, 9002, 9003} and len(ids) >= 0.97 * base.count()
    two = common.materialize(corpus_pipeline.lines(spark, one, sf_dir))
    kept = {r.doc_id: r.text for r in two.collect()}
    assert sum(LINE in t for t in kept.values()) == 1 and two.columns == list(corpus_pipeline.COLUMNS)
    three = common.materialize(corpus_pipeline.near_copies(spark, two, sf_dir))
    assert three.count() == three.select("doc_id").distinct().count() <= two.count()
    four = corpus_pipeline.personal_data(spark, three, sf_dir).collect()
    assert len(four) == three.count() and not any("some.one@mail.example" in r.text for r in four)
    assert all(r.n_chars == len(r.text) for r in four)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048 and len(out) > 100
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "personal_data", "pack"]


def test_empty(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert staged(spark, empty, sf_dir, 5).count() == 0


def test_near_copies_go_by_id_and_text(spark, sf_dir):
    """Rows that share an id are kept unless they are near copies; of rows that repeat, one stays."""
    rows = [(5, "alpha"), (5, "beta"), (2, "beta"), (7, "gamma"), (7, "eps"), (7, "gamma"), (None, "zeta"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()), key=str)
    assert got == sorted([(5, "alpha"), (2, "beta"), (7, "gamma"), (7, "eps"), (None, "zeta"), (8, None)], key=str)


def test_planted_near_copies(spark, sf_dir):
    """Of copies with a similarity of 0.8 to 0.95 at least 95 in 100 go, and no other document does."""
    rng = np.random.default_rng(23)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 8)))
    rows, near = [], 0
    for i in range(400):
        base = [word() for _ in range(int(rng.integers(60, 400)))]
        rows.append((i, " ".join(base)))
        own = list(base)
        for _ in range(int(rng.integers(0, max(1, len(base) // 35)))):
            own[int(rng.integers(0, len(own)))] = "edited"
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (base, own))
        if len(a & b) >= 0.8 * len(a | b):
            near += 1
            rows.append((10_000 + i, " ".join(own)))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()}
    assert near > 200 and set(range(400)) <= kept and len(kept) - 400 <= 0.05 * near
