import random

import corpus_pipeline
from test_text_operators import text


def test_foreign_and_junk_documents_go(spark):
    rng = random.Random(13)
    rows = [(i, text(rng, lang := ("en", "de", "fr")[i % 3], rng.randint(20, 80)), lang, "s", 0) for i in range(150)]
    rows += [(200 + i, text(rng, ("en", "de", "fr")[i % 3], 30), None, "s", 0) for i in range(9)]
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах", "すべての人間は、生まれながらにして自由であり", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "".join(rng.choice("0123456789abcdef") for _ in range(200)), " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)),
    ]
    docs = spark.createDataFrame(rows + [(300 + i, t, None, "s", 0) for i, t in enumerate(foreign)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").collect()} == {r[0] for r in rows}
