"""Names of rare words at every width, the widest included, which only corpora of 2**23.5 different words reach by themselves."""

import math
import random

import pytest

from lamella.llm import scoring


@pytest.mark.parametrize("vocabulary", [2**20, 2**24])
def test_any_width_of_names(spark, monkeypatch, vocabulary):
    """Words that occur once back off to their own count, whatever bytes their names take."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "b", "c", f"w{i}x{rng.randrange(9**9)}"]) for i in range(40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: r.log_score for r in scoring.score_documents(docs, bucket_words=300).collect()}
    real = scoring.Hot.__init__
    monkeypatch.setattr(scoring, "HOT_WORDS", 20)  # words that occur less often than in one of 20 are rare
    monkeypatch.setattr(scoring.Hot, "__init__", lambda self, words, total, _, size: real(self, words, total, vocabulary, size))
    got = {r.doc_id: r.log_score for r in scoring.score_documents(docs, bucket_words=300).collect()}
    assert got.keys() == plain.keys() and all(math.isclose(got[k], plain[k], abs_tol=1e-9) for k in got)
