import random

import corpus_pipeline

from gradeloom.llm import minhash, pieces

WORDS = {"en": [f"the{c}ing" for c in "abcdefghijklmnopqrstuvwxyz"], "de": [f"und{c}keit" for c in "abcdefghijklmnopqrstuvwxyz"]}


def test_stages_in_order(spark, tmp_path):
    """One planted case for each stage, and clean documents that all stages leave alone."""
    rng = random.Random(11)
    make = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))
    item = make("en", 30)
    rows = [(i, make(lang := rng.choice(sorted(WORDS)), rng.randint(30, 60)), lang, "s", 0) for i in range(60)]
    clean = {r[0] for r in rows}
    rows += [(100, "12 34 -- !!", None, "s", 0), (101, None, None, "s", 0), (102, rows[5][1], "en", "s", 0), (103, rows[6][1] + " tail", "en", "s", 0), (104, make("en", 20) + " " + item + " " + make("en", 20), "en", "s", 0), (105, make("en", 30) + " mail bo.42@m.example.com", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
    stages = list(seen.values())
    assert stages[0] == clean | {102, 103, 104, 105} and stages[1] == clean | {104, 105} and stages[2] == clean | {105} == stages[3] == stages[4]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert all(texts[i] == t for i, t, *_ in rows if i in clean) and "bo.42@" not in texts[105] and "@m.example.com" in texts[105]
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) == stages[4] and all(r.round_trip for r in final.values())
    assert {r.doc_id: r.text for r in pieces.decode_documents(docs).collect()} == {i: t for i, t in texts.items() if i in stages[4]}
    groups = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.read.parquet(f"{tmp_path}/0"), 5, 80).collect()}
    assert groups[102] == 5 and groups[103] == 6
