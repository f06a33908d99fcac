"""Near duplicates among rows that share a doc_id or have none."""

from tests.llm.helpers import odd_documents
from tracewell.llm.jaccard import keep_first


def text(k):
    return " ".join(f"w{k}x{i}" for i in range(40))


def test_clean_rows_without_own_id_stay(spark):
    clean = [(None, text(k), "en", "s") for k in range(30)] + [(5, text(100 + k), "en", "s") for k in range(3)]
    near = [(7, text(0) + " more", "en", "s"), (8, text(100), "en", "s"), (5, text(102), "en", "s")]
    docs = odd_documents(spark, clean + near)
    kept = keep_first(docs, 3, 80)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    # the copy with an id stands for the row without one; of 5 and 8 the smaller id stays
    want = [r[:2] for r in clean if r[1] != text(0)] + [(7, text(0) + " more")]
    assert got == sorted(want, key=str) and kept.columns == docs.columns
