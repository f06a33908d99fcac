"""Bands of languages with few documents."""

import numpy as np

from tests.llm.helpers import odd_documents
from tracewell.llm.quality import LEAST_DOCS, judge


def test_noise_in_a_rare_language_is_rejected(spark):
    rng = np.random.default_rng(5)
    parts = ["ther", "on", "is", "and", "re", "ing", "a", "tion"]
    prose = lambda: " ".join("".join(rng.choice(parts, 2)) for _ in range(80))
    junk = lambda: " ".join("".join(rng.choice(list("qxzjkvw%$#&"), 5)) for _ in range(80))
    clean = [(i, prose(), "en", "s") for i in range(200)]
    rare = [(1000 + i, prose(), lang, "s") for i, lang in enumerate(["es", "xx", None] * 2)]
    noise = [(2000 + i, junk(), lang, "s") for i, lang in enumerate(["es", "xx", None, "only noise"])]
    got = judge(odd_documents(spark, clean + rare + noise)).collect()
    assert {r.doc_id for r in got if r.kept} == {r[0] for r in clean + rare}
    assert all(r.low is not None and r.high is not None for r in got)


def test_few_documents_in_all_have_a_band(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join("".join(rng.choice(["ther", "on", "is", "and"], 2)) for _ in range(80)), "en", "s") for i in range(LEAST_DOCS // 2)]
    got = judge(odd_documents(spark, rows)).collect()
    assert all(r.low <= r.log_perplexity <= r.high for r in got if r.kept) and any(r.kept for r in got)
