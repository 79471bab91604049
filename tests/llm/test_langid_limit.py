"""The pipeline's language stage rejects what no tree predicts."""

import base64
import random

import corpus_pipeline
from tests.llm.test_models import SYLLABLES, speak


def test_stage_rejects_what_no_language_predicts(spark):
    rng = random.Random(6)
    rows = [(i, speak(rng, lang, rng.randrange(8, 60)), lang, "s", 1) for i, lang in enumerate(sorted(SYLLABLES) * 60)]
    short = [(1000, "ka ti mo", None, "s", 1), (1001, "schung einlich", None, "s", 1)]
    other = ["Все люди рождаются свободными", "人人生而自由", base64.b64encode(rng.randbytes(300)).decode(), "".join(rng.choices("BCDFGHJKLMPQRSTVWXZ", k=300))]
    gone = [(2000 + i, t, None, "s", 1) for i, t in enumerate([*other, None, "12 34"])]
    df = spark.createDataFrame(rows + short + gone, "doc_id long, text string, lang string, source string, n_chars int")
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, df, "").collect()}
    assert kept == {r[0]: r[2] for r in rows} | {1000: "xx", 1001: "yy"}
